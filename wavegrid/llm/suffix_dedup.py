"""Removal of passages that occur more than once, by column-wise suffix sorting of many short strings.

A byte goes if it lies in a string of ``width`` bytes that also starts anywhere else. Every window of that width
names an anchor in itself: the place of its smallest hashed k-gram. Equal windows name equal k-grams at equal
distances, so windows are only compared around equal anchors. The stretch of neighbouring windows with one
anchor is a segment.

1. Segments are dealt out by anchor, as hashes. An anchor seen once has no repeated window. Segments equal as a
   whole are repeated as a whole. What is left are anchors with different segments.
2. Those segments go as bytes, with one of each set of equal ones, to the task of their anchor. There the
   suffixes of all of them are sorted column by column from the right, one more symbol of every string in each
   round: the column of the collection's Burrows-Wheeler transform (the symbols before the sorted suffixes)
   is split by symbol, which gives the next order, and the common prefixes of neighbours are carried along
   by minima over ranges. Strings are aligned at their anchors, so a round touches one suffix of each. A window
   is repeated if its suffix shares ``width`` bytes with a neighbour.
   An anchor with very many different segments would be too much for one task: its windows are dealt out by
   their own hashes instead, as equal windows hash alike, and counted with partial sums.
3. The marks return to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavegrid.llm.common import groups, materialize, maybe_broadcast, partitions, set_apart

UNIT = 1 << 20  # bytes hashed at once
FLUSH = 600_000  # segments a task combines before it sends them
SORT_ROWS = 30_000  # strings sorted at once, rounded up to whole anchors
HOT_STRINGS = 2_000  # different segments of an anchor beyond which its windows are dealt out instead
WHOLE, PARTLY, SHIPPED = 1, 2, 3  # repeated as a whole; to be compared; repeated, and shown to those that are compared
_SEGMENT = np.dtype([("h", "<u8"), ("s", "<u8"), ("k", "<i8"), ("q", "<u4"), ("many", "u1")])
_MARK = np.dtype([("k", "<i8"), ("q", "<u4"), ("m", "u1")])
U = np.uint64


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers of an odd base and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    up, down = np.ones(n, dtype=U), np.ones(n, dtype=U)
    up[1:], down[1:] = U(base), U(pow(base, -1, 1 << 64))
    return np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=U), np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of the bytes, and the hash of the k-gram at each place."""
    k = max(1, width // 5)
    value, up, down = _tables(UNIT * 2 + 4096)
    sums = np.concatenate([[U(0)], np.cumsum(value[data] * up[: len(data)], dtype=U)])
    grams = _mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
    low = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=U)
    span, size = width - k + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return (low & U(0xFFFFFF)).astype(np.int64), grams


def segments(texts: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For bytes of several texts on end: the bytes; per segment its text, number in the text, first and last window
    and anchor as places in these bytes, the hash of the anchor; and the shift from these places to the text's.

    Texts beyond ``UNIT`` come in several pieces whose windows follow each other; segments are numbered through.
    """
    unit: list[tuple[int, int, bytes]] = []
    total, next_no = 0, {}

    def give():
        data = b"".join(p for _, _, p in unit)
        at = np.cumsum([0, *(len(p) for _, _, p in unit)])
        anchor, grams = _anchors(np.frombuffer(data, np.uint8), width)
        sizes = np.array([len(p) - width + 1 for _, _, p in unit])
        window = np.repeat(at[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a = anchor[window]
        start = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        first, last, a = window[start], window[np.append(start[1:], len(window)) - 1], a[start]
        piece = np.searchsorted(at, first, side="right") - 1
        begin = np.searchsorted(piece, np.arange(len(unit)))
        count = np.diff(np.append(begin, len(piece)))
        base = np.empty(len(unit), dtype=np.int64)
        for i, (row, _, _) in enumerate(unit):
            base[i] = next_no.get(row, 0)
            next_no[row] = base[i] + count[i]
        rows, shift = np.array([r for r, _, _ in unit]), np.array([o for _, o, _ in unit]) - at[:-1]
        return data, rows[piece], base[piece] + np.arange(len(piece)) - begin[piece], np.stack([first, last, a]), grams[a], shift[piece]

    for row, text in enumerate(texts):
        for off in range(0, len(text) - width + 1, UNIT):
            part = text[off : off + UNIT + width - 1]
            unit.append((row, off, part))
            total += len(part)
            if total >= UNIT:
                yield give()
                unit, total = [], 0
    if unit:
        yield give()


def _dealt(records: np.ndarray, field: str, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Records by range of a mixed field, so that equal values stay together."""
    bucket = (_mix(records[field].view(U)) >> U(32)) * U(n_buckets) >> U(32)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for i, j in zip(cut[:-1], cut[1:]):
        if j > i:
            yield int(bucket[i]), records[i:j]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows)
    return pa.record_batch({"bucket": pa.array(b, pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(d, pa.binary())})


def _marks(k: np.ndarray, q: np.ndarray, m) -> np.ndarray:
    out = np.empty(len(k), dtype=_MARK)
    out["k"], out["q"], out["m"] = k, q, m
    return out


def _send(texts: list[bytes], keys: list[int], width: int) -> Iterator[np.ndarray]:
    for data, row, no, (first, last, a), h, _ in segments(texts, width):
        view, out = memoryview(data), np.empty(len(row), dtype=_SEGMENT)
        out["h"], out["k"], out["q"], out["many"] = h, np.array(keys, dtype=np.int64)[row], no, 0
        ends = (last + width).tolist()
        out["s"] = [xxhash.xxh3_64_intdigest(view[i:j], seed=d) for i, j, d in zip(first.tolist(), ends, (a - first).tolist())]
        yield out


def _combine(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments of a task one goes on, for all; the marks of all of them are settled here."""
    records = records[np.lexsort((records["s"], records["h"]))]
    new = np.concatenate([[True], (records["h"][1:] != records["h"][:-1]) | (records["s"][1:] != records["s"][:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(records)))
    settled = records[np.repeat(size > 1, size)]
    sent = records[start]
    sent["many"] = size > 1
    return sent, _marks(settled["k"], settled["q"], WHOLE)


def _judge(records: np.ndarray, hot_strings: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of all segments of some anchors, and the anchors that have more different segments to compare than one task should sort."""
    records = records[np.lexsort((records["s"], records["h"]))]
    h, s = records["h"], records["s"]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
    start = np.flatnonzero(new)
    weight = np.add.reduceat(1 + records["many"].astype(np.int64), start)
    ch = h[start]
    group = np.cumsum(np.concatenate([[True], ch[1:] != ch[:-1]])) - 1
    classes, lone = np.bincount(group), np.bincount(group, weights=weight == 1) > 0
    mark = np.where(weight > 1, WHOLE, np.where(classes[group] > 1, PARTLY, 0))
    each = np.repeat(mark, np.diff(np.append(start, len(records))))
    each[start[(mark == WHOLE) & lone[group]]] = SHIPPED
    keep = each > 0
    compared = np.bincount(group, weights=(mark == PARTLY) | ((mark == WHOLE) & lone[group])).astype(np.int64)
    anchors = ch[np.concatenate([[True], ch[1:] != ch[:-1]])]
    return _marks(records["k"][keep], records["q"][keep], each[keep]), anchors[compared > hot_strings]


def pack(codes: np.ndarray) -> bytes:
    """Numbers 0 to 3, four to a byte."""
    c = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    c[: len(codes)] = codes
    c = c.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).ravel()


def repeated_columns(strings: list[bytes], left: np.ndarray, width: int) -> np.ndarray:
    """For each string and each distance 0..max(left) before its anchor: whether the ``width`` bytes from there occur at the same distance in another."""
    m, reach = len(strings), int(left.max())
    outside = 256
    columns = np.full((m, reach + width), outside, dtype=np.uint16)
    for i, (s, n) in enumerate(zip(strings, left.tolist())):
        columns[i, reach - n : reach - n + len(s)] = np.frombuffer(s, np.uint8)[: n + width]
    columns = np.ascontiguousarray(columns.T)
    order, lcp = np.arange(m), np.zeros(m + 1, dtype=np.int32)
    out = np.zeros((m, reach + 1), dtype=bool)
    for c in reversed(range(reach + width)):
        bwt = columns[c][order]
        by_symbol = np.argsort(bwt, kind="stable")
        sorted_ = bwt[by_symbol]
        cut = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [m]])
        longer = np.zeros(m + 1, dtype=np.int32)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if j - i > 1 and sorted_[i] != outside:
                longer[i + 1 : j] = np.minimum.reduceat(lcp, by_symbol[i:j] + 1)[:-1] + 1
        order, lcp = order[by_symbol], longer
        if c <= reach:
            long_ = lcp >= width
            out[order, reach - c] = (long_[:-1] | long_[1:]) & (sorted_ != outside)
    return out


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def mark_segments(docs: DataFrame, width: int, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """``row_key, codes, partly``: for each document with repeated anchors, a code of two bits per segment.

    Rows without codes are no documents: their ``row_key`` is the hash of an anchor with more than ``hot_strings`` segments to compare.
    """
    n_parts = partitions(docs.sparkSession)
    n_buckets = 4 * n_parts

    def send(batches):
        kept, total, turn = [], 0, 0

        def flush():
            nonlocal kept, total, turn
            sent, settled = _combine(np.concatenate(kept))
            rows = [(b, 0, r.tobytes()) for b, r in _dealt(sent, "h", n_buckets)]
            if len(settled):
                rows.append((turn % n_buckets, 1, settled.tobytes()))
            kept, total, turn = [], 0, turn + 1
            return _rows(rows)

        for b in batches:
            texts, keys = _bytes(b.column(0).to_pylist()), b.column(1).to_pylist()
            for records in _send(texts, keys, width):
                kept.append(records)
                total += len(records)
                if total >= FLUSH:
                    yield flush()
        if kept:
            yield flush()

    def judge(batches):
        def give(marks):
            return _rows([(k, 1, r.tobytes()) for k, r in _dealt(marks, "k", 2 * n_parts)])

        held, total = [], 0
        for _, refs in groups(batches, ["bucket"]):
            seen, marks = [], []
            for b, i in refs:
                raw = b.column(2)[i].as_buffer()
                (marks if b.column(1)[i].as_py() else seen).append(np.frombuffer(raw, _MARK if b.column(1)[i].as_py() else _SEGMENT))
            if seen:
                judged, hot = _judge(np.concatenate(seen), hot_strings)
                marks.append(judged)
                if len(hot):
                    yield _rows([(0, 2, hot.tobytes())])
            held += marks
            total += sum(map(len, marks))
            if total >= 2 * FLUSH:  # dealt out once or a few times in a task, so rows stay few
                yield give(np.concatenate(held))
                held, total = [], 0
        if total:
            yield give(np.concatenate(held))

    def gather(batches):
        for _, refs in groups(batches, ["bucket"]):
            hot = [np.frombuffer(b.column(2)[i].as_buffer(), np.int64) for b, i in refs if b.column(1)[i].as_py() == 2]
            if hot:
                h = np.concatenate(hot)
                yield pa.record_batch({"row_key": pa.array(h), "codes": pa.nulls(len(h), pa.binary()), "partly": pa.nulls(len(h), pa.bool_())})
            refs = [(b, i) for b, i in refs if b.column(1)[i].as_py() != 2]
            if not refs:
                continue
            marks = np.concatenate([np.frombuffer(b.column(2)[i].as_buffer(), _MARK) for b, i in refs])
            marks = marks[np.lexsort((marks["m"], marks["q"], marks["k"]))]
            start = np.concatenate([[0], np.flatnonzero(marks["k"][1:] != marks["k"][:-1]) + 1, [len(marks)]])
            keys, codes, partly = [], [], []
            for i, j in zip(start[:-1].tolist(), start[1:].tolist()):
                q, m = marks["q"][i:j], marks["m"][i:j]
                c = np.zeros(int(q[-1]) + 1, dtype=np.uint8)
                c[q] = m  # of several marks the last, which is the largest
                keys.append(int(marks["k"][i]))
                codes.append(pack(c))
                partly.append(bool((c > WHOLE).any()))
            yield pa.record_batch({"row_key": pa.array(keys, pa.int64()), "codes": pa.array(codes, pa.binary()), "partly": pa.array(partly, pa.bool_())})

    kind = "bucket int, kind int, data binary"
    sent = docs.select("text", _row_key().alias("row_key")).mapInArrow(send, kind)
    judged = sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, kind)
    return judged.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "row_key long, codes binary, partly boolean")


def compare_segments(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """``row_key, found array<struct<no, bits>>``: for segments to be compared, which of their windows are repeated."""

    def cut(batches):
        for b in batches:
            texts, keys, codes = _bytes(b.column(0).to_pylist()), b.column(1).to_pylist(), [unpack(c.as_py()) for c in b.column(2)]
            for data, row, no, (first, last, a), h, _ in segments(texts, width):
                code = np.array([codes[r][n] if n < len(codes[r]) else 0 for r, n in zip(row.tolist(), no.tolist())])
                at = np.flatnonzero(code > WHOLE)
                if len(at):
                    ends = last + width
                    yield pa.record_batch(
                        {
                            "h": pa.array(h[at].view(np.int64), pa.int64()),
                            "row_key": pa.array([keys[r] for r in row[at].tolist()], pa.int64()),
                            "no": pa.array(no[at], pa.int32()),
                            "ask": pa.array(code[at] == PARTLY, pa.bool_()),
                            "left": pa.array((a - first)[at], pa.int32()),
                            "string": pa.array([data[i:j] for i, j in zip(first[at].tolist(), ends[at].tolist())], pa.binary()),
                        }
                    )

    def sort(batches):
        def solve(rows):
            keys, nos, ask, left, strings = map(list, zip(*rows))
            dup = repeated_columns(strings, np.array(left), width)
            out = []
            for i, (k, n, wanted, far, s) in enumerate(zip(keys, nos, ask, left, strings)):
                if wanted:
                    windows = dup[i, far - (len(s) - width) : far + 1][::-1]  # from the first window to the last
                    if windows.any():
                        out.append((k, n, np.packbits(windows).tobytes()))
            if out:
                k, n, bits = zip(*out)
                return pa.record_batch({"row_key": pa.array(k, pa.int64()), "no": pa.array(n, pa.int32()), "bits": pa.array(bits, pa.binary())})

        held = []
        for _, refs in groups(batches, ["h"]):
            held += [tuple(b.column(c)[i].as_py() for c in range(1, 6)) for b, i in refs]
            if len(held) >= SORT_ROWS:
                if (r := solve(held)) is not None:
                    yield r
                held = []
        if held and (r := solve(held)) is not None:
            yield r

    some = maybe_broadcast(marks.where("partly").select(F.col("row_key").alias("__wg_key"), "codes"), 128)
    texts = docs.select("text", _row_key().alias("row_key")).join(some, F.expr("row_key = __wg_key")).select("text", "row_key", "codes")
    strings = texts.mapInArrow(cut, "h long, row_key long, no int, ask boolean, left int, string binary")
    hot = marks.where("codes is null").select(F.col("row_key").alias("h"))
    is_hot = hot.limit(1).count() > 0
    if is_hot:
        strings, hot = materialize(strings, "repeat-strings"), maybe_broadcast(hot, 16)
        strings, at_hot = strings.join(hot, "h", "left_anti"), strings.join(hot, "h", "left_semi")
    strings = strings.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h")
    found = strings.mapInArrow(sort, "row_key long, no int, bits binary")
    if is_hot:
        found = found.unionByName(_compare_windows(at_hot, width))
    return found.groupBy("row_key").agg(F.collect_list(F.struct("no", "bits")).alias("found"))


def _compare_windows(strings: DataFrame, width: int) -> DataFrame:
    """``row_key, no, bits`` as the sort gives them, for strings whose windows are told apart by hashes of 128 bits."""

    def windows(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = []
                for key, no, ask, s in zip(*(part.column(c).to_pylist() for c in range(3)), part.column(3)):
                    v = memoryview(s.as_buffer())
                    rows += [(xxhash.xxh3_128_digest(v[i : i + width]), key, no, ask, i) for i in range(len(v) - width + 1)]
                hashes, key, no, ask, place = zip(*rows)
                two = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                cols = {"w1": pa.array(two[:, 0]), "w2": pa.array(two[:, 1]), "row_key": pa.array(key, pa.int64()), "no": pa.array(no, pa.int32())}
                yield pa.record_batch(cols | {"ask": pa.array(ask, pa.bool_()), "place": pa.array(place, pa.int32())})

    def bits(batches):
        for b in batches:
            out = []
            for places in b.column(2).to_pylist():
                x = np.zeros(max(places) + 1, dtype=bool)
                x[places] = True
                out.append(np.packbits(x).tobytes())
            yield pa.record_batch({"row_key": b.column(0), "no": b.column(1), "bits": pa.array(out, pa.binary())})

    w = strings.select("row_key", "no", "ask", "string").mapInArrow(windows, "w1 long, w2 long, row_key long, no int, ask boolean, place int")
    w = materialize(w, "repeat-windows")
    many = w.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hit = w.where("ask").join(many, ["w1", "w2"]).groupBy("row_key", "no").agg(F.collect_list("place").alias("places"))
    return hit.mapInArrow(bits, "row_key long, no int, bits binary")


def remove_repeats(docs: DataFrame, width: int = 200, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept`` (binary) to every document (``doc_id, text`` and others).

    Texts count as UTF-8 bytes, a null text as empty. Removed is each byte covered by a string of ``width`` bytes
    that also starts anywhere else, in the same document or another, overlaps included, judged on the texts as
    they come. ``n_spans`` counts the maximal removed runs. Repeated rows are copies of each other and lose all
    that is long enough. Ids may be null or repeat. Columns of the added names are replaced. Texts are told
    apart by a hash of 64 bits of id and text on their way, segments by two. ``hot_strings`` changes the work, not the result.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs, named = set_apart(docs, {"doc_id": "doc_id", "text": "text"}, added)
    marks = materialize(mark_segments(docs, width, hot_strings), "repeat-marks")
    found = materialize(compare_segments(docs, marks, width), "repeat-found")
    names = docs.columns
    rows = docs.withColumn("__wg_key", _row_key())
    rows = rows.join(marks.select(F.col("row_key").alias("__wg_key"), F.col("codes").alias("__wg_codes")).where("__wg_codes is not null"), "__wg_key", "left")
    rows = rows.join(found.select(F.col("row_key").alias("__wg_key"), F.col("found").alias("__wg_found")), "__wg_key", "left")
    rows = rows.select(*names, "__wg_codes", "__wg_found")
    at = names.index("text")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])

    def remove(batches):
        for b in batches:
            texts = _bytes(b.column(at).to_pylist())
            codes, found_ = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            marked = [i for i, c in enumerate(codes) if c is not None]
            edges = {i: np.zeros(len(texts[i]) + 1, dtype=np.int32) for i in marked}
            code = {i: unpack(codes[i]) for i in marked}
            asked = {i: {f["no"]: f["bits"] for f in found_[i] or []} for i in marked}
            for _, row, no, (first, last, _), _, shift in segments([texts[i] for i in marked], width):
                cut = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    i = marked[row[x]]
                    n, p, q = no[x:y], first[x:y] + shift[x:y], last[x:y] + shift[x:y]
                    c = np.where(n < len(code[i]), code[i][np.minimum(n, len(code[i]) - 1)], 0)
                    whole = (c == WHOLE) | (c == SHIPPED)
                    np.add.at(edges[i], p[whole], 1)
                    np.add.at(edges[i], q[whole] + width, -1)
                    for z in np.flatnonzero(c == PARTLY).tolist():
                        if (bits := asked[i].get(int(n[z]))) is not None:
                            w = p[z] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                            np.add.at(edges[i], w, 1)
                            np.add.at(edges[i], w + width, -1)
            removed, spans, kept = [0] * len(texts), [0] * len(texts), list(texts)
            for i in marked:
                gone = np.cumsum(edges[i][:-1]) > 0
                removed[i] = int(gone.sum())
                spans[i] = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                if removed[i]:
                    kept[i] = np.frombuffer(texts[i], np.uint8)[~gone].tobytes()
            more = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *more], names=[*names, *added])

    return named(rows.mapInArrow(remove, schema))
