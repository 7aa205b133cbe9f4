"""N-gram Jaccard join: classes of documents that are linked by similar sets of word shingles.

Comparing all documents of like size would grow with the square of their number, so size-banded tiles are made
per shingle, of rows that may be linked, in a way that loses no link:

* A linked document shares at least the threshold's part of its shingles with another. Shingles are counted by
  hash; documents with fewer repeated ones drop out, and of rows with equal sets one goes on for all.
* Of the others, every row names its rarest shingles, as many as a partner can't lack all of (a prefix of the
  set in one order for all: by number of candidates that hold the shingle, then by hash). Shingles of
  boilerplate come last in that order and bring nothing together.
* A tile is a shingle and a size band. Bands grow by the threshold's ratio, so a link's two sizes lie in one
  band or in neighbours, and a tile has the rows of its band and those of the band below. Beyond ``tile_docs``
  rows it is cut into blocks.

In a tile, bitmap signatures bound the overlap of two sets from above, and only pairs that pass are intersected
exactly. The first round compares rows with one leader after another and keeps three pairs for each row, which
joins most of what belongs together. Components of the links found so far then say which pairs still matter: the
second round takes from each tile all pairs of different components that pass the bound. Components only ever run
over links that were verified.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import WordHash, groups, materialize, maybe_broadcast, partitions, slices, tidy
from wavegrid.llm.components import connected_components, contract

SIGNATURE_BITS = 1024
FLUSH_KEYS = 750_000
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingles(text: str | None, n: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=U)
    w = np.fromiter(map(cache.__getitem__, words), dtype=U, count=len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, dtype=U)
    for i in range(k):
        h = h * U(0x9E3779B97F4A7C15) + w[i : i + m]
    return np.unique(_mix(h))


def _low40(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)


def _cuts(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    if not len(sorted_):
        return []
    c = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]).tolist()
    return list(zip(c[:-1], c[1:]))


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Members a set of size n shares at least with a set it is linked to."""
    return -(-percent * n // 100)


_SENT = "bucket int, kind int, chunk long, data binary"
_COUNTED = "chunk long, kind int, data binary"
_SIZES = "doc_id long, n long, repeated long, set_a long, set_b long"


def repeated_shingles(docs: DataFrame, ngram: int) -> DataFrame:
    """``doc_id, n, repeated, set_a, set_b``: for each row the size of its set, how many members other rows hold too, and a hash of the set.

    Counts are by bucket and 40 more bits of the hash; equal ones of different shingles only raise ``repeated``. What
    repeats within a task's chunk of rows is sent once for all.
    """
    n_parts = partitions(docs.sparkSession)
    n_buckets = 4 * n_parts

    def send(batches):
        cache, sets, ids, total, turn = WordHash(), [], [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal sets, ids, total, turn
            chunk = part << 32 | turn
            sizes = np.array([len(h) for h in sets], dtype=np.int64)
            h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = s[1:] == s[:-1]
            many = np.zeros(len(h), dtype=bool)
            many[order[1:][same]] = many[order[:-1][same]] = True
            known = np.bincount(owner[many], minlength=len(sets))
            marks = b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets)
            rows = [(turn % n_buckets, 0, chunk, _ids(ids) + sizes.tobytes() + known.astype(np.int64).tobytes() + marks)]
            shared = np.unique(h[many])
            at = _bucket(shared, n_buckets)
            parts = {int(at[i]): shared[i:j] for i, j in _cuts(at)}
            h, owner = h[~many], owner[~many]
            at = _bucket(h, n_buckets)
            order = np.argsort(at, kind="stable")
            h, owner, at = h[order], owner[order], at[order]
            none = np.zeros(0, dtype=U)
            single = {int(at[i]): (i, j) for i, j in _cuts(at)}
            for b in sorted({*parts, *single}):
                i, j = single.get(b, (0, 0))
                m = parts.get(b, none)
                rows.append((b, 1, chunk, struct.pack("<II", len(m), j - i) + _low40(m) + _low40(h[i:j]) + owner[i:j].astype("<u2").tobytes()))
            sets, ids, total, turn = [], [], 0, turn + 1
            return _table(_SENT, rows)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = shingles(text.as_py(), ngram, cache)
                sets.append(h)
                ids.append(doc_id)
                total += len(h)
                if total >= FLUSH_KEYS or len(ids) >= 60_000:
                    yield flush()
        if ids:
            yield flush()

    def count(batches):
        for _, refs in groups(batches, ["bucket"]):
            parts = []
            for b, i in refs:
                data = b.column(3)[i].as_py()
                if b.column(1)[i].as_py() == 0:
                    yield _table(_COUNTED, [(b.column(2)[i].as_py(), 0, data)])
                    continue
                m, n = struct.unpack_from("<II", data)
                p = 8 + 5 * m
                parts.append((b.column(2)[i].as_py(), _from40(data[8:p]), _from40(data[p : p + 5 * n]), np.frombuffer(data, "<u2", n, p + 5 * n)))
            if not parts:
                continue
            h = np.concatenate([x for _, many, single, _ in parts for x in (many, many, single)])
            h.sort()
            twice = h[1:][h[1:] == h[:-1]]
            twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
            for chunk, _, single, owner in parts:
                at = np.searchsorted(twice, single)
                hit = twice[np.minimum(at, len(twice) - 1)] == single if len(twice) else np.zeros(len(single), dtype=bool)
                if hit.any():
                    yield _table(_COUNTED, [(chunk, 1, np.bincount(owner[hit]).astype("<u4").tobytes())])

    def total(batches):
        for _, refs in groups(batches, ["chunk"]):
            (b, i), *rest = refs
            data = b.column(2)[i].as_py()
            n = len(data) // 41
            ids = _read_ids(data, n)
            sizes, known = np.frombuffer(data, np.int64, 2 * n, 9 * n).reshape(2, n)
            known = known.copy()
            for b, i in rest:
                more = np.frombuffer(b.column(2)[i].as_py(), "<u4")
                known[: len(more)] += more
            mark = np.frombuffer(data, "<i8", 2 * n, 25 * n).reshape(n, 2)
            cols = {"n": sizes, "repeated": known, "set_a": mark[:, 0], "set_b": mark[:, 1]}
            yield pa.record_batch({"doc_id": ids, **{k: pa.array(v, pa.int64()) for k, v in cols.items()}})

    sent = docs.select("doc_id", "text").mapInArrow(send, _SENT).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    counted = sent.mapInArrow(count, _COUNTED).repartition(n_parts, "chunk").sortWithinPartitions("chunk", "kind")
    return counted.mapInArrow(total, _SIZES)


def _ids(ids: list[int | None]) -> bytes:
    return np.array([i is not None for i in ids], dtype=np.uint8).tobytes() + np.array([i or 0 for i in ids], dtype=np.int64).tobytes()


def _read_ids(data: bytes, n: int) -> pa.Array:
    return pa.array(np.frombuffer(data, np.int64, n, n), pa.int64(), mask=np.frombuffer(data, np.uint8, n) == 0)


_DEALT = "bucket int, kind int, data binary"
_MEMBER = np.dtype([("row", "<u8"), ("h", "<u8")])
_WEIGHED = np.dtype([("row", "<u8"), ("h", "<u8"), ("f", "<u4")])
_ROW = np.dtype([("row", "<u8"), ("node", "<i8"), ("n", "<u4")])
_PREFIX = "h long, row long, node long, n int, m int, signature binary, members binary"


def _dealt(kind: int, records: np.ndarray, at: np.ndarray) -> list[tuple]:
    order = np.argsort(at, kind="stable")
    records, at = records[order], at[order]
    return [(int(at[i]), kind, records[i:j].tobytes()) for i, j in _cuts(at)]


def _signatures(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bitmap of each set; ``h`` has the members of all sets on end."""
    bits = np.zeros((len(size), SIGNATURE_BITS), dtype=np.uint8)
    bits[np.repeat(np.arange(len(size)), size), (h & U(SIGNATURE_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def prefixes(docs: DataFrame, some: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Sets and prefixes of the rows to be compared; ``some`` has ``node, row``: an id and the set (its hash) to take under it.

    For each set a row with its ``members`` that other sets have, too (the others can't be in an intersection), and for each
    shingle ``h`` of its prefix one with the ``signature`` of those ``m`` members. ``n`` is the size of the whole set.
    """
    n_parts = partitions(docs.sparkSession)
    n_buckets, n_deal = 4 * n_parts, 2 * n_parts  # a task deals out once or a few times, so rows stay few
    texts = docs.select("doc_id", "text").join(maybe_broadcast(some, 64), F.expr("doc_id = node")).select("doc_id", "text", "row")

    def send(batches):
        cache, sets, rows, total = WordHash(), [], [], 0

        def flush():
            nonlocal sets, rows, total
            r = np.array(rows, dtype=_ROW)
            members = np.zeros(total, dtype=_MEMBER)
            members["h"], members["row"] = np.concatenate(sets), np.repeat(r["row"], [len(h) for h in sets])
            out = _dealt(0, members, _bucket(members["h"], n_buckets)) + _dealt(1, r, _bucket(r["row"], n_deal))
            sets, rows, total = [], [], 0
            return _table(_DEALT, out)

        for b in slices(batches):
            for doc_id, text, row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                h = shingles(text.as_py(), ngram, cache)
                if xxhash.xxh3_128_digest(h.tobytes())[:8] == row.to_bytes(8, "little", signed=True):
                    sets.append(h)
                    rows.append((row & 0xFFFFFFFFFFFFFFFF, doc_id, len(h)))
                    total += len(h)
                if total >= FLUSH_KEYS:
                    yield flush()
        if rows:
            yield flush()

    def weigh(batches):
        """The number of holders goes back with each shingle that has several, to where all of a row's meet."""

        def give(records):
            return _table(_DEALT, _dealt(0, records, _bucket(records["row"], n_deal)))

        held, total = [], 0
        for _, refs in groups(batches, ["bucket"]):
            m = np.concatenate([np.frombuffer(b.column(2)[i].as_buffer(), _MEMBER) for b, i in refs])
            m = m[np.argsort(m["h"], kind="stable")]
            size = np.diff([0, *(j for _, j in _cuts(m["h"]))])
            r = np.empty(len(m), dtype=_WEIGHED)
            r["row"], r["h"], r["f"] = m["row"], m["h"], np.repeat(size, size)
            held.append(r[r["f"] > 1])
            total += len(held[-1])
            if total >= FLUSH_KEYS:
                yield give(np.concatenate(held))
                held, total = [], 0
        if total:
            yield give(np.concatenate(held))

    def choose(batches):
        def give(seen, known):
            r, facts = np.concatenate(seen), np.unique(np.concatenate(known))
            r = r[np.lexsort((r["h"], r["f"], r["row"]))]
            # a repeated row of the table sends its set again
            r = r[np.concatenate([[True], (r["row"][1:] != r["row"][:-1]) | (r["h"][1:] != r["h"][:-1])])]
            cuts = _cuts(r["row"])
            start, size = np.array([i for i, _ in cuts]), np.array([j - i for i, j in cuts])
            at = np.searchsorted(facts["row"], r["row"][start])
            n, node = facts["n"][at].astype(np.int64), facts["node"][at]
            # n - size members are held by no other and come first in the order
            take = n - _needed(n, percent) + 1 - (n - size)
            for lo in range(0, len(cuts), 2000):
                yield from rows(r, start[lo : lo + 2000], size[lo : lo + 2000], take[lo : lo + 2000], n[lo : lo + 2000], node[lo : lo + 2000])

        def rows(r, start, size, take, n, node):
            r = r[start[0] : start[-1] + size[-1]]
            start = start - start[0]
            nth = np.arange(len(r)) - np.repeat(start, size)
            owner = np.repeat(np.arange(len(start)), size)
            signature = _signatures(r["h"], size)
            sets = np.flatnonzero(take > 0)
            if not len(sets):
                return
            members = [np.sort(r["h"][start[i] : start[i] + size[i]]).tobytes() for i in sets.tolist()]
            yield table(r["row"][start[sets]], None, node[sets], n[sets], size[sets], None, members)
            for lo in range(0, len(r), 20_000):
                k = np.flatnonzero(nth[lo : lo + 20_000] < take[owner[lo : lo + 20_000]]) + lo
                if len(k):
                    o = owner[k]
                    yield table(r["row"][k], r["h"][k], node[o], n[o], size[o], [signature[i].tobytes() for i in o.tolist()], None)

        def table(row, h, node, n, m, signature, members):
            none = [None] * len(row)
            cols = [none if h is None else h.view(np.int64), row.view(np.int64), node, n, m, signature or none, members or none]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _PREFIX.split(", ")])

        for _, refs in groups(batches, ["bucket"]):
            seen, known = [], []
            for b, i in refs:
                is_row = b.column(1)[i].as_py()
                (known if is_row else seen).append(np.frombuffer(b.column(2)[i].as_buffer(), _ROW if is_row else _WEIGHED))
            if seen:
                yield from give(seen, known)

    def by_bucket(df, f, schema):
        return df.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(f, schema)

    sent = materialize(texts.mapInArrow(send, _DEALT), "jaccard-sent")
    weighed = by_bucket(sent.where("kind = 0"), weigh, _DEALT)
    return by_bucket(weighed.unionByName(sent.where("kind = 1")), choose, _PREFIX)


def size_band(n: Column, percent: int) -> Column:
    """Sizes of a link lie in one band or in neighbours: bands grow by 100 / percent. The small addend keeps rounding from parting a power."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else n.cast("int")


def tiles_of(keys: DataFrame, percent: int) -> DataFrame:
    """Every key in the tile of its own band (``home``) and in the next one's."""
    band = size_band(F.col("n"), percent)
    each = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home"))))
    return keys.select("*", each.alias("__wg_at")).select(*keys.columns, "__wg_at.band", "__wg_at.home")


def large_tiles(keys: DataFrame, percent: int, tile_docs: int) -> DataFrame:
    """``h, band, hub, n_blocks`` of tiles of more than ``tile_docs`` rows; at most two for each ``tile_docs`` keys."""
    counted = tiles_of(keys.select("h", "row", "n"), percent).groupBy("h", "band").agg(F.count("*").alias("n_rows"), F.min("row").alias("hub"))
    return counted.where(F.col("n_rows") > tile_docs).select("h", "band", "hub", F.ceil(F.col("n_rows") / tile_docs).cast("int").alias("n_blocks"))


_TILE = ["h", "band", "block"]


def _whole_tiles(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as arrays, some whole tiles at a time; ``start`` marks where tiles begin."""

    def give(t):
        t = t.combine_chunks()
        out = {c: t[c].to_numpy(zero_copy_only=False) for c in t.column_names if c != "signature"}
        out["signature"] = np.frombuffer(b"".join(t["signature"].to_pylist()), U).reshape(t.num_rows, -1)
        return out

    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.num_rows
        if total < rows:
            continue
        t = pa.Table.from_batches(held)
        key = [t[c].to_numpy() for c in _TILE]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        if len(new):
            at = int(new[-1])
            yield give(t.slice(0, at))
            t = t.slice(at)
        held, total = t.to_batches(), t.num_rows
    if total:
        yield give(pa.Table.from_batches(held))
    tidy()


def _compare(c: dict[str, np.ndarray], percent: int, label: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places (first, other) within tiles that pass sizes and signatures, and the bound of their overlap.

    The first row of every tile is held against the rest of it, in all tiles at once, and leaves; so on until
    tiles are empty. Without labels, rows that passed leave with it (they found a leader). With labels, only rows of
    different labels are compared, and a tile ends when one label is left: the rarest label's rows come first.
    """
    tile = np.cumsum(np.concatenate([[True], np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in _TILE])]))
    n, m, sig, home, own = c["n"].astype(np.int64), c["m"].astype(np.int64), c["signature"], c["home"], c["own"]
    at = np.arange(len(n))
    if label is not None:
        order = np.lexsort((label, tile))
        new = np.concatenate([[True], (tile[order][1:] != tile[order][:-1]) | (label[order][1:] != label[order][:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        weight = np.empty(len(order), dtype=np.int64)
        weight[order] = np.repeat(size, size)
        at = np.lexsort((label, weight, tile))
    while len(at):
        t = tile[at]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(start, len(at)))
        if label is not None:  # rows are ordered by label, so a tile's last row differs if any does
            size_of = np.repeat(label[at[start]] != label[at[start + size - 1]], size)
            at = at[size_of]
            if not len(at):
                return
            t = tile[at]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(start, len(at)))
        first = np.zeros(len(at), dtype=bool)
        first[start] = True
        x, y = np.repeat(at[start], size)[~first], at[~first]
        at = y
        ask = (home[x] | home[y]) & (own[x] | own[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        if label is not None:
            ask &= label[x] != label[y]
        ask = np.flatnonzero(ask)
        gone = []
        for lo in range(0, len(ask), 20_000):
            k = ask[lo : lo + 20_000]
            a, b = x[k], y[k]
            only_a = np.bitwise_count(sig[a] & ~sig[b]).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(sig[b] & ~sig[a]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(m[a] - only_a, m[b] - only_b)
            fits = bound * (100 + percent) >= percent * (n[a] + n[b])
            if fits.any():
                yield a[fits], b[fits], bound[fits]
                gone.append(k[fits])
        if label is None and gone:
            keep = np.ones(len(at), dtype=bool)
            keep[np.concatenate(gone)] = False
            at = at[keep]


_PAIRS = "a long, b long, bound int"


def _pairs(c: dict[str, np.ndarray], found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ordered: bool) -> Iterator[pa.RecordBatch]:
    """The pairs as rows, each once in these tiles; ``ordered``: the smaller row first."""
    held, total = [], 0

    def give():
        a, b, bound = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, bound = a[order], b[order], bound[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.record_batch({"a": pa.array(a[new]), "b": pa.array(b[new]), "bound": pa.array(bound[new].astype(np.int32))})

    for x, y, bound in found:
        a, b = c["row"][x], c["row"][y]
        held.append((np.minimum(a, b), np.maximum(a, b), bound) if ordered else (a, b, bound))
        total += len(a)
        if total > 500_000:
            yield give()
            held, total = [], 0
    if held:
        yield give()


def _in_tiles(rows: DataFrame, f, more: list[str]) -> DataFrame:
    rows = rows.select(*_TILE, "row", "n", "m", "signature", "home", "own", *more)
    n = partitions(rows.sparkSession)
    # every shingle has an order of its own, so that a row meets other leaders in other tiles
    return rows.repartition(n, *_TILE).sortWithinPartitions(*_TILE, F.xxhash64("row", "h")).mapInArrow(f, _PAIRS)


def leader_pairs(keys: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for each row its pairs with the three leaders of the highest bounds, for each leader its best follower. Blocks of a large tile share one row."""
    rows = tiles_of(keys, percent)
    own = F.pmod("row", F.coalesce("n_blocks", F.lit(1)).cast("long")).cast("int")
    blocks = F.when(F.col("row") == F.col("hub"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(own))
    rows = rows.join(maybe_broadcast(large, 48), ["h", "band"], "left").withColumn("home_block", own).withColumn("block", F.explode(blocks))
    rows = rows.withColumn("own", F.col("block") == F.col("home_block"))

    def lead(batches):
        for c in _whole_tiles(batches):
            yield from _pairs(c, _compare(c, percent, None), False)

    pairs = materialize(_in_tiles(rows, lead, []), "jaccard-leaders")
    best = F.slice(F.sort_array(F.collect_set(F.struct("bound", "a")), asc=False), 1, 3)  # as many as the row has tiles at most
    taken = pairs.groupBy("b").agg(best.alias("p")).select("b", F.explode("p.a").alias("a"))
    taken = taken.unionByName(pairs.groupBy("a").agg(F.max_by("b", F.struct("bound", "b")).alias("b")))
    return taken.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def other_pairs(keys: DataFrame, labels: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of a tile whose rows have different components and pass the bound.

    In a tile of several blocks, the rows outside of its most frequent component visit every block.
    """
    named = keys.join(maybe_broadcast(labels, 48), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    rows = tiles_of(named, percent)
    hot = rows.join(maybe_broadcast(large, 48), ["h", "band"]).groupBy("h", "band", "label").agg(F.count("*").alias("n_rows"), F.first("n_blocks").alias("n_blocks"))
    top = materialize(hot.groupBy("h", "band").agg(F.first("n_blocks").alias("n_blocks"), F.max_by("label", F.struct("n_rows", "label")).alias("top")), "jaccard-large-tiles")
    own = F.pmod("row", F.coalesce("n_blocks", F.lit(1)).cast("long")).cast("int")
    blocks = F.when(F.col("label") != F.col("top"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(own))
    rows = rows.join(maybe_broadcast(top, 48), ["h", "band"], "left").withColumn("home_block", own).withColumn("block", F.explode(blocks))
    rows = rows.withColumn("own", F.col("block") == F.col("home_block"))

    def rest(batches):
        for c in _whole_tiles(batches):
            yield from _pairs(c, _compare(c, percent, c["label"]), True)

    return _in_tiles(rows, rest, ["label"]).select("a", "b").distinct()


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` (ids): the pairs whose sets, intersected exactly, are similar enough; a task sends its links contracted."""

    def verify(batches):
        got = []
        for b in batches:
            node = [b.column(i).to_pylist() for i in (0, 1)]
            size = [b.column(i).to_pylist() for i in (2, 3)]
            for x, y, n, k, p, r in zip(*node, *size, b.column(4), b.column(5)):
                p, r = np.frombuffer(p.as_buffer(), U), np.frombuffer(r.as_buffer(), U)
                if len(p) > len(r):
                    p, r = r, p
                at = np.searchsorted(r, p)
                both = int((r[np.minimum(at, len(r) - 1)] == p).sum())
                if both * 100 >= percent * (n + k - both):
                    got.append((x, y))
            if len(got) > 1_000_000:
                got = list(zip(*(c.tolist() for c in contract(*np.array(got, dtype=np.int64).T))))
        if got:
            x, y = contract(*np.array(got, dtype=np.int64).T)
            if len(x):
                yield pa.record_batch({"a": pa.array(x), "b": pa.array(y)})

    side = lambda s: sets.select(F.col("row").alias(s), F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("members").alias(f"members_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("node_a", "node_b", "n_a", "n_b", "members_a", "members_b").mapInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame, ngram: int = 5, percent: int = 80, tile_docs: int = 4096) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``; other columns don't come along.

    Words are stretches without blanks, A-Z lower-cased; a document's set has its distinct shingles of ``ngram``
    words, or its whole sequence if that is shorter. Two documents link when 100 * intersection >= percent *
    union; ``component_id`` is the smallest id that links lead to. Documents without words link with nothing.

    A tile of more than ``tile_docs`` rows is cut into blocks; that changes the work, not the result.

    A row with a null id has its size and a null component. Rows with equal ids count as one document: they
    share a component. Equal texts are linked if they have words. Empty tables give no rows. Shingles are told
    apart by 64-bit hashes, sets by 128 bits, of which 64 name a set while it is compared.
    """
    docs = docs.select("doc_id", "text")
    facts = materialize(repeated_shingles(docs, ngram), "jaccard-sizes")
    may_link = facts.where(f"doc_id is not null and n > 0 and 100 * repeated >= {percent} * n")
    some = materialize(may_link.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "jaccard-sets")

    found = materialize(prefixes(docs, some.select("node", F.col("set_a").alias("row")), ngram, percent), "jaccard-prefixes")
    keys, sets = found.where("members is null").drop("members"), found.where("members is not null").select("row", "node", "n", "members")
    large = materialize(large_tiles(keys, percent, tile_docs), "jaccard-large-tiles")
    first = materialize(leader_pairs(keys, large, percent), "jaccard-pairs")
    links = materialize(links_of(first, sets, percent), "jaccard-links")
    labels = materialize(connected_components(links), "jaccard-components")
    second = other_pairs(keys, labels, large, percent).join(first, ["a", "b"], "left_anti")
    more = materialize(links_of(second, sets, percent), "jaccard-links")
    links = links.unionByName(more)

    # ids that stand on several rows join what these rows belong to
    again = facts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("doc_id")
    again = materialize(again, "jaccard-ids")
    repeated = again.limit(1).count() > 0
    if repeated:
        tied = facts.join(maybe_broadcast(again, 24), "doc_id", "left_semi").join(some, ["set_a", "set_b"])
        links = links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    classes = materialize(connected_components(links), "jaccard-components")

    sets_at = some.join(classes, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    sets_at = materialize(sets_at, "jaccard-classes")
    out = facts.join(maybe_broadcast(sets_at, 48), ["set_a", "set_b"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    if repeated:
        out = out.drop("component").join(classes, F.expr("doc_id = node"), "left").drop("node").withColumnRenamed("component", "by_id")
        out = out.join(maybe_broadcast(sets_at, 48), ["set_a", "set_b"], "left")
        mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_id", "component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))
