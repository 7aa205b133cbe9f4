"""Token ids in sorted-string-table shards.

A shard is: data blocks, sparse index, Bloom filter, footer. Keys are 9 bytes (0 for null or 1, then the id as an
unsigned big-endian number with its sign turned) and so sort as the ids do, null first. A block holds entries
``shared, unshared, value length`` (varints), the unshared end of the key, and the value: the token ids as
little-endian numbers of 2 bytes, or 4 for vocabularies beyond 65,536. Blocks are compressed with zstandard and
end with their crc32. The index has first key, offset, length and number of entries of each block. A reader
asks the filter, bisects the index for the block, and bisects nothing else than that block's entries.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import BLANKS, materialize, maybe_broadcast, partitions, put_file, scratch, slices

MAGIC = b"WGSST\x01\x00\x00"
FOOTER = struct.Struct("<QQQQQQI8s")
INDEX = struct.Struct("<9sQII")
BLOCK_BYTES = 32 << 10
SHARD_BYTES = 16 << 20
FILTER_BITS, FILTER_HASHES = 10, 7


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _filter_bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(n_bits) for i in range(FILTER_HASHES)])


class ShardWriter:
    """Takes entries in key order; equal keys may follow each other."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys = width, bytearray(), [], []
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0
        self.tokens = self.raw = 0
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0
        if self.entries:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(9 - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.tokens += len(ids)
        self.raw += len(value)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            data = self.zip.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.first, len(self.out), len(data), self.entries))
            self.out += data
            self.block, self.entries = bytearray(), 0

    def finish(self) -> bytes:
        self._close()
        index_at = len(self.out)
        for e in self.index:
            self.out += INDEX.pack(*e)
        filter_at = len(self.out)
        n_bits = max(64, -(-len(self.keys) * FILTER_BITS // 8) * 8)
        cells = np.zeros(n_bits, dtype=np.uint8)
        cells[_filter_bits(self.keys, n_bits).ravel().astype(np.int64)] = 1
        self.out += np.packbits(cells).tobytes()
        self.out += FOOTER.pack(index_at, len(self.index), filter_at, n_bits, len(self.keys), self.tokens, self.width, MAGIC)
        return bytes(self.out)


class ShardReader:
    def __init__(self, data: bytes):
        self.data = data
        self.index_at, n, self.filter_at, self.n_bits, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("no shard of this format")
        self.index = [INDEX.unpack_from(data, self.index_at + i * INDEX.size) for i in range(n)]
        self.zip = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _ = self.index[i]
        raw = self.data[at : at + size]
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        block, p, key = self.zip.decompress(raw[:-4]), 0, b""
        while p < len(block):
            shared, p = _read_varint(block, p)
            rest, p = _read_varint(block, p)
            size, p = _read_varint(block, p)
            key = key[:shared] + block[p : p + rest]
            p += rest
            yield key, np.frombuffer(block, "<u2" if self.width == 2 else "<u4", size // self.width, p)
            p += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield decode_key(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        at = _filter_bits([encode_key(doc_id)], self.n_bits).ravel().astype(np.int64)
        return all(self.data[self.filter_at + (p >> 3)] >> (7 - (p & 7)) & 1 for p in at.tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All entries of an id, in order; none if it isn't there."""
        if not self.may_hold(doc_id):
            return []
        key, out = encode_key(doc_id), []
        i = max(0, bisect.bisect_left([e[0] for e in self.index], key) - 1)  # equal keys may begin at the end of the block before
        while i < len(self.index) and self.index[i][0] <= key:
            out += [ids for k, ids in self._block(i) if k == key]
            i += 1
        return out


class Remembered(dict):
    """A dict that forgets what was not asked for in the last ``limit`` new entries, half at a time."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def absent(self, keys: set) -> list:
        """Keys that are not known; older ones are taken over."""
        out = []
        for k in keys.difference(self):
            v = self.older.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out

    def age(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


#: Fixed value: the normalizer and pre-tokenizer for which texts may be encoded by runs.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def encodes_by_runs(path: str) -> bool:
    """Whether a tokenizer file has the known steps and no token that may reach across runs (added ones that are not in ``<|...|>``, truncation)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    return all(spec.get(k) == v for k, v in KNOWN.items()) and added and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    """Token ids of texts, run by run.

    The tokenizer cuts a text into runs by a pattern, drops white space and encodes each run by itself, so a text's
    ids are its runs' ids on end. Where a text has only printable ASCII, Latin-1 letters and blanks, the pattern
    is applied here, to the text in lower case; many new runs are encoded in one text and told apart by the tokens
    that end a run. Other texts go by their stretches between blanks, as no normalisation reaches across those; odd
    stretches are encoded as they are. Runs and stretches of up to 64 characters are remembered for a while.

    All this holds for the steps of :data:`KNOWN` only. The tokenizer file is read for its own; where they differ, whole
    texts are encoded.
    """

    plain = re.compile(r"[\x20-\x7e\t-\rÀ-ÖØ-öø-ÿ]*")
    #: Fixed value: the tokenizer's pattern, for these characters in lower case.
    runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
    blanks = re.compile("[" + BLANKS + "]+")

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.by_runs = encodes_by_runs(path)
        vocab = self.of.get_vocab(True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self.kept, self.odd = Remembered(limit), Remembered(limit // 10)

    def _is_plain(self, text: str) -> bool:
        return self.plain.fullmatch(text) is not None and "<|" not in text

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_runs:
            return [np.frombuffer(x, dtype="<u4") for x in self._each(texts)]
        easy = [i for i, t in enumerate(texts) if self._is_plain(t)]
        split = [self.runs.findall(texts[i].lower()) for i in easy]
        out: list = [None] * len(texts)
        for i, ids in zip(easy, self._plain(split)):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._by_stretches([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _plain(self, split: list[list[str]]) -> list[np.ndarray]:
        new = self.kept.absent(set().union(*split))
        self.kept.update(zip(new, self._together(new)))
        get = self.kept.__getitem__
        out = [np.frombuffer(b"".join(map(get, rs)), dtype="<u4") for rs in split]
        for r in new:
            if len(r) > 64:
                del self.kept[r]
        self.kept.age()
        return out

    def _by_stretches(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.blanks.split(t) for t in texts]
        new = self.odd.absent(set().union(*split))
        easy = [w for w in new if self._is_plain(w)]
        other = [w for w in new if not self._is_plain(w)]
        self.odd.update(zip(easy, (x.tobytes() for x in self._plain([self.runs.findall(w.lower()) for w in easy]))))
        self.odd.update(zip(other, self._each(other)))
        get = self.odd.__getitem__
        out = [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") for ws in split]
        for w in new:
            if len(w) > 64:
                del self.odd[w]
        self.odd.age()
        return out

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.of.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _together(self, runs: list[str], at_once: int = 4000) -> list[bytes]:
        out = []
        for k in range(0, len(runs), at_once):
            some = runs[k : k + at_once]
            ids = np.array(self.of.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) != len(some):  # a vocabulary that doesn't mark ends
                out += self._each(some)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks: what it remembers is bounded and worth keeping."""
    return Encoder(path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, texts_at_once: int = 512) -> DataFrame:
    """Encodes ``doc_id, text`` and writes shards into ``folder``, in ascending order of ids; returns their list.

    Rows are dealt out by ranges of (id, hash of the text), so that even one id in many rows is spread. A task
    writes its shards one after another, each under a name made from its partition and number, and whole or not
    at all: a task that runs again after an executor was lost replaces them by equal ones. The list has
    ``shard, n_docs, n_tokens``, a row per shard.

    A null text counts as empty, a null id sorts first, repeated rows become repeated entries.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches):
        encode = encoder(tokenizer)
        part, made, shard = TaskContext.get().partitionId(), [], ShardWriter(encode.width)

        def flush():
            nonlocal shard
            if shard.keys:
                name = f"shard-{part:07d}-{len(made):05d}.sst"
                docs_, tokens = len(shard.keys), shard.tokens
                put_file(f"{folder}/{name}", shard.finish())
                made.append((name, docs_, tokens))
                shard = ShardWriter(encode.width)

        for some in slices(batches, texts_at_once):
            for i, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                shard.add(encode_key(i), np.append(ids, np.uint32(end_id)))
                if shard.raw >= SHARD_BYTES:
                    flush()
        flush()
        if made:
            names, n_docs, n_tokens = zip(*made)
            yield pa.record_batch({"shard": pa.array(names, pa.string()), "n_docs": pa.array(n_docs, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return materialize(rows.mapInArrow(write, "shard string, n_docs long, n_tokens long"), "sst-list")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every entry, from the files alone.

    ``start`` counts the ids of all entries before: those of the shards before, summed over the list of shards
    (a row per 16 MB), and those before it in its own shard.
    """
    spark = shards.sparkSession
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                ids, starts, sizes, crcs, start = [], [], [], [], 0
                for doc_id, tokens in ShardReader(data.as_buffer().to_pybytes()):
                    ids.append(doc_id)
                    starts.append(start)
                    sizes.append(len(tokens))
                    crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    start += len(tokens)
                yield pa.record_batch(
                    {
                        "name": pa.array([path.rpartition("/")[2]] * len(ids), pa.string()),
                        "doc_id": pa.array(ids, pa.int64()),
                        "at": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    rows = files.mapInArrow(read, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    base = maybe_broadcast(base, 64)
    return rows.join(base, F.expr("name = shard")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: writes the shards into a new folder of the shared store and reads them back.

    Takes ``doc_id, text``; other columns don't come along. A null text is empty and has the end id alone; null ids come
    first; repeated rows are entries of their own; an empty table gives no rows.
    """
    folder = scratch(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, folder, tokenizer, end_id), folder)
