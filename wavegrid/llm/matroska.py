"""Media columns in Matroska form: writing 8-bit samples, and parsing files into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element identifiers of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, LACES = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SAMPLE_RATE = 8000
FRAME = 1024  # samples of a frame: 128 ms
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
LACED = 8  # frames of a block
CLUSTER_BLOCKS = 30  # the block's time in its cluster has 16 bits with sign
MARKERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


def vint(n: int, length: int = 0) -> bytes:
    """A size: as many leading zero bits as further bytes, then a one; all ones is kept for an unknown size."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int | None, int]:
    """The number and the place after it; None for an unknown size. With ``marker`` the length bit stays, as in identifiers."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length number at byte {at}")
    length = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError("the file ends within a number")
    if marker:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Flags and body of laced frames: fixed size where all are equal, else sizes as differences."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        k = next(k for k in range(1, 9) if abs(b - a) < 1 << (7 * k - 1))
        head += vint(b - a + (1 << (7 * k - 1)) - 1, k)
    return 0x06, head + b"".join(frames)


def xiph_lace(frames: list[bytes]) -> tuple[int, bytes]:
    head = bytearray([len(frames) - 1])
    for f in frames[:-1]:
        head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    return 0x02, bytes(head) + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """One audio track of unsigned 8-bit samples at 8 kHz, in clusters of laced simple blocks, with cues."""
    blocks = []
    for i in range(0, len(payload), FRAME * LACED):
        part = payload[i : i + FRAME * LACED]
        blocks.append((i // FRAME * FRAME_MS, _lace([part[k : k + FRAME] for k in range(0, len(part), FRAME)])))
    head = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    length_ms = len(payload) * 1000 / SAMPLE_RATE
    info = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", length_ms)) + element(MUXER, b"wavegrid") + element(WRITER, b"wavegrid"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    track = element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACES, 1) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    body = [info, element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    for i in range(0, len(blocks), CLUSTER_BLOCKS):
        start = blocks[i][0]
        inner = [_uint(TIME, start)]
        for t, (flags, data) in blocks[i : i + CLUSTER_BLOCKS]:
            inner.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", t - start, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE, _uint(CUE_TIME, start) + element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # (byte offset, time)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (time, track, byte offset of the cluster)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)  # (track, ns, offset, size, key)


def _children(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, first byte, start and end of the body). An unknown size ends at the next element of the parent's level."""
    while at < end:
        first = at
        ident, at = read_vint(data, at, marker=True)
        size, at = read_vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element {ident:x} reaches beyond its parent")
        if size is None and parent == SEGMENT:  # a cluster of unknown size: up to the next top-level element
            p = at
            while p < end:
                i, q = read_vint(data, p, marker=True)
                if i in MARKERS:
                    break
                n, q = read_vint(data, q)
                p = end if n is None else q + n
            stop = p
        yield ident, first, at, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _frames(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, time within the cluster, flags, and byte range of each laced frame of a block."""
    track, a = read_vint(data, a)
    t, flags = struct.unpack(">hB", data[a : a + 3])
    a += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, t, flags, [(a, b - a)]
    n = data[a] + 1
    a += 1
    if kind == 2:
        if (b - a) % n:
            raise ValueError("frames of fixed size don't fill their block")
        sizes = [(b - a) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while data[a] == 255:
                    size, a = size + 255, a + 1
                size, a = size + data[a], a + 1
            elif i == 0:
                size, a = read_vint(data, a)
            else:
                start = a
                diff, a = read_vint(data, a)
                length = a - start
                if diff is None:
                    diff = (1 << 7 * length) - 1
                size = sizes[-1] + diff - ((1 << (7 * length - 1)) - 1)
            sizes.append(size)
        sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed their block")
    places = []
    for s in sizes:
        places.append((a, s))
        a += s
    return track, t, flags, places


def parse(data: bytes) -> Media:
    """Reads the structure of a whole file; packets carry nanoseconds and byte ranges into it."""
    m = Media()
    for ident, _, a, b in _children(data, 0, len(data), 0):
        if ident == EBML:
            m.doc_type = next((data[x:y].rstrip(b"\0").decode() for i, _, x, y in _children(data, a, b, EBML) if i == DOC_TYPE), "matroska")
        elif ident == SEGMENT:
            _segment(data, a, b, m)
    return m


def _segment(data: bytes, a: int, b: int, m: Media) -> None:
    base, blocks = a, []
    for ident, first, x, y in _children(data, a, b, SEGMENT):
        if ident == INFO:
            for i, _, p, q in _children(data, x, y, INFO):
                if i == SCALE:
                    m.scale = _number(data, p, q)
                elif i == DURATION:
                    m.duration = _real(data, p, q)
        elif ident == TRACKS:
            for i, _, p, q in _children(data, x, y, TRACKS):
                if i == TRACK:
                    t = {"codec": "", "kind": 0, "rate": 8000.0, "channels": 1, "depth": 0, "frame_ns": 0, "number": 0}
                    for j, _, u, v in _children(data, p, q, TRACK):
                        if j == CODEC:
                            t["codec"] = data[u:v].decode()
                        elif j == AUDIO:
                            for k, _, s, e in _children(data, u, v, AUDIO):
                                if k == RATE:
                                    t["rate"] = _real(data, s, e)
                                elif k in (CHANNELS, DEPTH):
                                    t["channels" if k == CHANNELS else "depth"] = _number(data, s, e)
                        elif j in (NUMBER, KIND, DEFAULT_DURATION):
                            t[{NUMBER: "number", KIND: "kind", DEFAULT_DURATION: "frame_ns"}[j]] = _number(data, u, v)
                    m.tracks[t["number"]] = t
        elif ident == CLUSTER:
            time = 0
            for i, _, p, q in _children(data, x, y, CLUSTER):
                if i == TIME:
                    time = _number(data, p, q)
                elif i == SIMPLE_BLOCK:
                    blocks.append((time, None, p, q))
                elif i == BLOCK_GROUP:
                    inner = list(_children(data, p, q, BLOCK_GROUP))
                    key = all(j != 0xFB for j, *_ in inner)  # a block that refers to another is no key frame
                    blocks += [(time, key, u, v) for j, _, u, v in inner if j == BLOCK]
            m.clusters.append((first, time))
        elif ident == CUES:
            for i, _, p, q in _children(data, x, y, CUES):
                if i == CUE:
                    t, places = 0, []
                    for j, _, u, v in _children(data, p, q, CUE):
                        if j == CUE_TIME:
                            t = _number(data, u, v)
                        elif j == CUE_PLACE:
                            f = {k: _number(data, s, e) for k, _, s, e in _children(data, u, v, CUE_PLACE)}
                            places.append((f.get(CUE_TRACK, 0), base + f.get(CUE_CLUSTER, 0)))
                    m.cues += [(t, k, at) for k, at in places]
    for time, key, p, q in blocks:
        track, t, flags, places = _frames(data, p, q)
        step = m.tracks.get(track, {}).get("frame_ns", 0)
        key = bool(flags & 0x80) if key is None else key  # a simple block says so itself
        m.packets += [(track, (time + t) * m.scale + i * step, at, n, key) for i, (at, n) in enumerate(places)]


def payload_of(data: bytes, m: Media, track: int = 1) -> bytes:
    return b"".join(data[at : at + n] for k, _, at, n, _ in m.packets if k == track)


def pad64(data: bytes) -> bytes:
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def _feature(data: bytes, m: Media, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256)
    p = share[share > 0] / len(x)
    values = np.arange(256)
    mean = float((share * values).sum() / len(x))
    power = float((share * values * values).sum() / len(x))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    codec = m.tracks[1]["codec"] if 1 in m.tracks else ""
    last = m.packets[-1] if m.packets else (0, 0, 0, 0, False)
    good_cues = sum((at, t) in set(m.clusters) for t, _, at in m.cues)
    return f"{codec};clusters={len(m.clusters)};cues={good_cues};packets={len(m.packets)};last_ms={last[1] // 1_000_000};ms={m.duration:.3f};mean={mean:.4f};power={power:.3f};crossings={crossings};entropy={float(-(p * np.log2(p)).sum()):.4f}"


#: Files are handed on in batches of about this size.
BATCH_BYTES = 8 << 20


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as samples of a file.

    A null text counts as empty. Ids may be null or repeat; each row has its own file. Other columns don't come along.
    Texts become files one by one, and files are handed on by :data:`BATCH_BYTES`, so a batch of many long texts is never held as files at once;
    one very long text is held a few times over.
    """

    def write(batches):
        for b in batches:
            sizes, files, held, first = [], [], 0, 0
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode()
                sizes.append(len(raw))
                files.append(mux(pad64(raw)))
                held += len(files[-1])
                if held >= BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.record_batch({"doc_id": b.column(0).slice(first, len(files)), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(files, pa.binary())})
                    sizes, files, held, first = [], [], 0, i + 1

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet: id, ``n`` (place in the file), ``track, timestamp_ns, byte_offset, n_bytes, keyframe``.

    Null media have no packets; a file that can't be parsed stops the job with its error.
    """
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n int, track int, timestamp_ns long, byte_offset long, n_bytes long, keyframe boolean"

    def read(batches):
        for b in batches:
            for k in range(b.num_rows):
                data = b.column(1)[k].as_py()
                p = parse(data).packets if data is not None else []
                if p:
                    t, ns, at, n, key = zip(*p)
                    ids = pa.array([b.column(0)[k].as_py()] * len(p), b.column(0).type)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(range(len(p)), pa.int32()), pa.array(t, pa.int32()), pa.array(ns, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.bool_())],
                        names=[id_col, "n", "track", "timestamp_ns", "byte_offset", "n_bytes", "keyframe"],
                    )

    return media.select(id_col, media_col).mapInArrow(read, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """Parses each stored file, puts its samples together from the packets' byte ranges, and describes both.

    ``media`` has ``doc_id, n_bytes, media``. Where the file is null, what describes it is null. A file that can't be parsed stops
    the job with its error. Rows with null or repeated ids are described each by itself; other columns don't come along.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        for b in batches:
            rows = []
            for k in range(b.num_rows):  # one file at a time
                data = b.column(2)[k].as_py()
                if data is None:
                    rows.append((None,) * 6)
                    continue
                m = parse(data)
                p = payload_of(data, m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), _feature(data, m, p)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return media.select("doc_id", "n_bytes", F.col("media")).mapInArrow(read, schema)
