"""Language-model scoring with a hierarchical Pitman-Yor model.

Every preceding word, whole and known by a 64-bit hash, has a restaurant; all of them share one parent restaurant
over single words, whose own base is uniform. A word is a dish: each table that serves it in a word's restaurant is
a customer of the parent. Seatings are sampled by blocked Gibbs: all customers of a dish in a restaurant leave and
come back one by one by the Chinese-restaurant rule, given the totals of the last sweep. Predictive probabilities
are averaged over the samples; each sample's are of one seating and its own totals, so they sum to one.

The pairs (preceding word, word) are dealt out on a grid: rows by the preceding word's hash, columns by the word's,
so a frequent word of either side is spread over a whole row or column. After each sweep every cell of the grid sends
its tables per preceding word to the row's owner and its tables per word to the column's; the owners add them up, seat
the parent, and send back the sums for the keys that the cell holds. These messages are files in the shared folder.
Draws are keyed by hashes of the pair, so the size of the grid does not matter.

The pairs that texts share are sent once: a task counts the pairs of a stretch of documents and asks, per cell, for
the probabilities of its distinct pairs; the answers come back in the order of the questions, as one file per
stretch, and the second pass over the same stretch looks them up.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavegrid.llm.common import get_file, groups, materialize, partitions, put_file, scratch, set_apart, tidy

STRETCH = 2_000_000  # tokens of a stretch
END = b"\n"  # no word holds it
DISCOUNT, STRENGTH = 0.75, 1.0  # of the preceding words' restaurants
PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 1.0
BURN_IN, SAMPLES = 2, 4
U = np.uint64


def _stretches(batches: Iterator[pa.RecordBatch], cols: list[str], step: int = 512) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """Consecutive rows of one file split, in pieces of about as many tokens; both passes cut alike. ``cols``: text, file, offset."""
    at, no, kept, size = None, 0, [], 0
    for b in batches:
        text, file, off = (b.schema.get_field_index(c) for c in cols)
        where = list(zip(b.column(file).to_pylist(), b.column(off).to_pylist()))
        lengths = [len(t) if t else 0 for t in b.column(text).to_pylist()]
        begin = 0
        for i, w in enumerate(where):
            if w != at or size >= STRETCH * 6:
                if i > begin:
                    kept.append(b.slice(begin, i - begin))
                if kept:
                    yield f"{xxhash.xxh3_64_hexdigest(repr(at))}-{no:06d}", kept
                kept, size, begin = [], 0, i
                at, no = w, no + 1 if w == at else 0
            size += lengths[i] + 7
        if begin < len(where):
            kept.append(b.slice(begin))
    if kept:
        yield f"{xxhash.xxh3_64_hexdigest(repr(at))}-{no:06d}", kept


def _texts(kept: list[pa.RecordBatch], name: str) -> list[str | None]:
    return [t for b in kept for t in b.column(b.schema.get_field_index(name)).to_pylist()]


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 that look random (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Keyed:
    """Stands in for a generator: the draw of each customer depends on its dish's key and its number only."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def draw(self, at: np.ndarray, seated: int, step: np.ndarray, p: np.ndarray) -> np.ndarray:
        key = self.keys[at]
        who = np.repeat(np.arange(len(at)), step)
        number = np.arange(len(who)) - np.repeat(np.cumsum(step) - step, step) + seated
        u = (_mix(key[who] + number.astype(U) * U(0x9E3779B97F4A7C15)) >> U(11)) * 2.0**-53
        return np.bincount(who, weights=u < p[who], minlength=len(at)).astype(np.int64)


def seat(count: np.ndarray, opens: np.ndarray, discount: float, rng: Keyed) -> np.ndarray:
    """Tables after the customers of each dish came in one by one.

    ``opens`` is the weight of a new table: (strength + discount * tables of the restaurant) * base probability; the
    dish's tables weigh customers - discount * tables. The first 16 customers decide singly, later ones in
    groups of a sixteenth of those seated, by one binomial draw at the weights before the group.
    """
    tables = (count > 0).astype(np.int64)
    at = np.flatnonzero(count > 1)
    left, t, o, seated = count[at] - 1, tables[at], opens[at], 1
    while len(at):
        step = np.minimum(left, max(1, seated // 16))
        p = o / (o + seated - discount * t)
        new = rng.draw(at, seated, step, p)
        t = t + new
        left = left - step
        seated += max(1, seated // 16)
        done = left == 0
        tables[at[done]] = t[done]
        keep = ~done
        at, left, t, o = at[keep], left[keep], t[keep], o[keep]
    return tables


class _Ids(dict):
    """Words of one stretch, numbered as they come, and their hashes. The end is number 0."""

    def __init__(self):
        self.hashes = []
        self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class Questions:
    """The distinct pairs of a stretch, by cell of the grid. A text starts as if after an end."""

    def __init__(self, texts: list[str | None], grid: tuple[int, int]):
        ids, parts, sizes = _Ids(), [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            seq = np.zeros(len(words) + 1, dtype=np.int64)
            seq[:-1] = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
            parts.append(seq)
            sizes.append(len(seq))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.hashes = np.array(ids.hashes, dtype=U)
        rank = np.empty(len(self.hashes), dtype=np.int64)
        by_hash = np.argsort(self.hashes)
        rank[by_hash] = np.arange(len(rank))
        self.hashes, seq = self.hashes[by_hash], rank[np.concatenate(parts)]  # words are numbered by their hashes from here
        code = np.append(rank[0], seq[:-1]) * len(rank) + seq  # every text ends by an end
        del ids, parts, seq
        pairs, where = np.unique(code, return_inverse=True)
        ctx, word = np.divmod(pairs, len(self.hashes))
        row, col = (((self.hashes >> U(32)) * U(n) >> U(32)).astype(np.int64) for n in grid)
        cell = row[ctx] * grid[1] + col[word]
        order = np.argsort(cell, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.ctx, self.word, self.where, cell = ctx[order], word[order], back[where], cell[order]
        self.cut = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        self.cells = cell[self.cut[:-1]]

    def cell_words(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of each cell: its pairs, its distinct words, and where these stand in its pairs."""
        for i, j in zip(self.cut[:-1], self.cut[1:]):
            yield slice(i, j), *np.unique(self.word[i:j], return_inverse=True)

    def ask(self, train: np.ndarray) -> Iterator[bytes]:
        n = np.bincount(self.where, weights=np.repeat(train, self.sizes), minlength=len(self.ctx)).astype(np.int64)
        for at, words, wi in self.cell_words():
            ctx, ci = np.unique(self.ctx[at], return_inverse=True)
            yield _zip(_gaps(self.hashes[ctx]), _gaps(self.hashes[words]), _steps(ci), wi, n[at])


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers below 2^64, each in as few bytes a number as its largest needs, first bytes first, compressed together."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max))
        out += [struct.pack("<QB", len(a), a.itemsize), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unzip(data: bytes) -> list[np.ndarray]:
    """The arrays as 64-bit integers."""
    raw = pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, size = struct.unpack_from("<QB", raw, at)
        out.append(np.frombuffer(raw, np.uint8, n * size, at + 9).reshape(size, n).T.copy().view(f"<u{size}").reshape(n).astype(np.int64))
        at += 9 + n * size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Numbers as differences, negative ones between the others; ``_sums`` undoes it."""
    d = np.diff(a, prepend=0)
    return np.where(d < 0, -2 * d - 1, 2 * d)


def _sums(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    return np.cumsum(np.where(d & 1, -(d + 1) // 2, d // 2))


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Ascending hashes as differences; ``_keys`` undoes it."""
    return np.diff(keys, prepend=U(0))


def _keys(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(U), dtype=U)


def _merge(asked: list[bytes]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """All pairs of a cell with counts summed over the stretches that asked; for each stretch where its pairs and words stand."""
    parts = [_unzip(a) for a in asked]
    ctx, c_at = np.unique(np.concatenate([_keys(p[0]) for p in parts]), return_inverse=True)
    words, w_at = np.unique(np.concatenate([_keys(p[1]) for p in parts]), return_inverse=True)
    c_off, w_off = (np.cumsum([0] + [len(p[k]) for p in parts]) for k in (0, 1))
    code = np.concatenate([c_at[_sums(p[2]) + c] * len(words) + w_at[p[3] + w] for p, c, w in zip(parts, c_off, w_off)])
    pairs, where = np.unique(code, return_inverse=True)
    n = np.bincount(where, weights=np.concatenate([p[4] for p in parts]), minlength=len(pairs)).astype(np.int64)
    at = np.split(where, np.cumsum([len(p[4]) for p in parts])[:-1])
    return [ctx, words, *np.divmod(pairs, len(words)), n], [[a, w_at[i:j]] for a, i, j in zip(at, w_off, w_off[1:])]


def _parent(c: np.ndarray, s: np.ndarray, total: tuple[int, int], base: float) -> np.ndarray:
    """Probability of words with ``c`` customers and ``s`` tables in the parent, which has ``total`` of both."""
    rest = (PARENT_STRENGTH + PARENT_DISCOUNT * total[1]) * base
    return (c - PARENT_DISCOUNT * s + rest) / (PARENT_STRENGTH + total[0])


def score_texts(docs: DataFrame, held_out: str, seed: int = 5) -> DataFrame:
    """Adds ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` to every document; learns where ``held_out`` is false.

    ``docs`` has ``text`` and the boolean column; it should be read from files, whose splits name the stretches;
    other frames are written to the shared folder first. A null text is empty; its one token is the end. A null in
    ``held_out`` counts as false. Repeated
    rows count as often as they come. Without training tokens all probability lies in the uniform base.
    Columns of the added names are replaced, others kept whatever their names are. Scores are log10 of averaged probabilities,
    and the perplexity is the inverse of their geometric mean over the tokens, of which every text has one at least.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs, named = set_apart(docs, {"text": "text", "__wg_held": held_out}, [*added, "perplexity"])
    spark = docs.sparkSession
    if not docs.inputFiles() or docs.select(F.input_file_name().alias("f")).where("f = ''").limit(1).count():
        docs = materialize(docs, "py-texts")
    n_parts = partitions(spark)
    n_rows = math.isqrt(4 * n_parts)
    grid = n_rows, 4 * n_parts // n_rows
    names = docs.columns
    cols = ["text", "__wg_file", "__wg_off"]
    rows = docs.select(*names, F.input_file_name().alias("__wg_file"), F.input_file_block_start().alias("__wg_off"))
    post, folder = scratch(spark, "py-post"), scratch(spark, "py-answers")

    def ask(batches):
        for name, kept in _stretches(batches, cols):
            q = Questions(_texts(kept, "text"), grid)
            data = list(q.ask(~np.array(_texts(kept, "__wg_held"), dtype=bool)))
            yield pa.record_batch({"cell": pa.array(q.cells, pa.int32()), "stretch": pa.array([name] * len(data), pa.string()), "asked": pa.array(data, pa.binary())})
            del q, data
            tidy()

    def shelve(batches):
        for (cell,), refs in groups(batches, ["cell"]):
            who, asked = zip(*sorted((b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b, i in refs))
            (ctx, words, ci, wi, n), at = _merge(asked)
            put_file(f"{post}/keys-row-{cell}", _zip(_gaps(ctx), np.bincount(ci, weights=n, minlength=len(ctx)).astype(np.int64)))
            put_file(f"{post}/keys-col-{cell}", _zip(_gaps(words), np.bincount(wi, weights=n, minlength=len(words)).astype(np.int64)))
            yield pa.record_batch(
                {
                    "cell": pa.array([cell], pa.int32()),
                    "pairs": pa.array([_zip(_steps(ci), wi, n)], pa.binary()),
                    "stretches": pa.array([who], pa.list_(pa.string())),
                    "places": pa.array([[_zip(_steps(p), _steps(w)) for p, w in at]], pa.list_(pa.binary())),
                }
            )

    asked = rows.select("text", "__wg_held", "__wg_file", "__wg_off").mapInArrow(ask, "cell int, stretch string, asked binary")
    shelf = asked.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(shelve, "cell int, pairs binary, stretches array<string>, places array<binary>")
    shelf = materialize(shelf, "py-dishes")
    cells = sorted(r["cell"] for r in shelf.select("cell").collect())  # 4 x shuffle partitions at most
    lines = [(kind, k, [c for c in cells if (c // grid[1] if kind == "row" else c % grid[1]) == k]) for i, kind in enumerate(("row", "col")) for k in range(grid[i])]
    owners = spark.range(0, len(lines), 1, len(lines))

    def owned(f):
        """Runs ``f`` for each line of the grid, and sums the three numbers it returns."""

        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    out = f(*lines[i])
                    yield pa.record_batch({k: pa.array([int(v)], pa.int64()) for k, v in zip("abc", out)})
            tidy()

        r = owners.mapInArrow(run, "a long, b long, c long").agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in "abc"]).first()
        return int(r[0]), int(r[1]), int(r[2])

    def index(kind, k, held_by):
        """Customers in training of each key, and for each cell where its keys stand."""
        if not held_by:
            return 0, 0, 0
        parts = [_unzip(get_file(f"{post}/keys-{kind}-{c}")) for c in held_by]
        keys, at = np.unique(np.concatenate([_keys(p[0]) for p in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
        put_file(f"{post}/line-{kind}-{k}", _zip(_gaps(keys)))
        for c, a in zip(held_by, np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])):
            put_file(f"{post}/index-{kind}-{c}", _zip(_steps(a)))
            put_file(f"{post}/count-{kind}-{c}", _zip(n[a]))
        return ((n > 0).sum(), n.sum(), 0) if kind == "col" else (0, 0, 0)

    n_types, train_tokens, _ = owned(index)
    base = 1.0 / (n_types + 1)

    def cell_sums(no, cell):
        """Of a sweep: tables of each preceding word; customers and tables in the parent of each word."""
        return _unzip(get_file(f"{post}/sums-row-{cell}-{no}"))[0], *_unzip(get_file(f"{post}/sums-col-{cell}-{no}"))

    def sweep(no, total):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    cell, (ci, wi, n) = b.column(0)[i].as_py(), _unzip(b.column(1)[i].as_py())
                    ctx, words = (_keys(_unzip(get_file(f"{post}/keys-{kind}-{cell}"))[0]) for kind in ("row", "col"))
                    ci = _sums(ci)
                    if no:
                        tables, c, s = cell_sums(no - 1, cell)
                        opens = (STRENGTH + DISCOUNT * tables[ci]) * _parent(c, s, total, base)[wi]
                        keys = _mix(_mix(words + U(2 * no))[wi] ^ _mix(ctx + U(seed))[ci])
                        t = seat(n, opens, DISCOUNT, Keyed(keys))
                    else:
                        t = (n > 0).astype(np.int64)
                    if no > 2 * BURN_IN:
                        put_file(f"{post}/tables-{cell}-{no}", _zip(t))
                    put_file(f"{post}/part-row-{cell}-{no}", _zip(np.bincount(ci, weights=t, minlength=len(ctx)).astype(np.int64)))
                    put_file(f"{post}/part-col-{cell}-{no}", _zip(np.bincount(wi, weights=t, minlength=len(words)).astype(np.int64)))
                    yield pa.record_batch({"cell": pa.array([cell], pa.int32())})
            tidy()

        def add(kind, k, held_by):
            if not held_by:
                return 0, 0, 0
            keys = _keys(_unzip(get_file(f"{post}/line-{kind}-{k}"))[0])
            at = [_sums(_unzip(get_file(f"{post}/index-{kind}-{c}"))[0]) for c in held_by]
            t = np.zeros(len(keys), dtype=np.int64)
            for c, a in zip(held_by, at):
                t[a] += _unzip(get_file(f"{post}/part-{kind}-{c}-{no}"))[0]  # a cell holds a key once
            sums = [t]
            if kind == "col":
                opens = np.full(len(t), (PARENT_STRENGTH + PARENT_DISCOUNT * total[1]) * base)
                sums.append(seat(t, opens, PARENT_DISCOUNT, Keyed(_mix(_mix(keys + U(2 * no + 1)) ^ U(seed)))))
            for c, a in zip(held_by, at):
                put_file(f"{post}/sums-{kind}-{c}-{no}", _zip(*[x[a] for x in sums]))
            return (sums[0].sum(), sums[1].sum(), 0) if kind == "col" else (0, 0, 0)

        shelf.select("cell", "pairs").mapInArrow(run, "cell int").agg(F.count("cell")).first()
        return owned(add)[:2]

    totals = [(0, n_types)]
    for no in range(2 * BURN_IN + SAMPLES + 1):  # the first only seats one table a pair
        totals.append(sweep(no, totals[-1]))
    kept_sweeps = [(no, totals[no + 1]) for no in range(2 * BURN_IN + 1, 2 * BURN_IN + SAMPLES + 1)]

    def answer(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell, (ci, wi, n), who = b.column(0)[i].as_py(), _unzip(b.column(1)[i].as_py()), b.column(2)[i].as_py()
                ci = _sums(ci)
                customers, known = (_unzip(get_file(f"{post}/count-{kind}-{cell}"))[0] for kind in ("row", "col"))
                p = np.zeros(len(n))
                for no, total in kept_sweeps:
                    tables, c, s = cell_sums(no, cell)
                    t = _unzip(get_file(f"{post}/tables-{cell}-{no}"))[0]
                    rest = (STRENGTH + DISCOUNT * tables[ci]) * _parent(c, s, total, base)[wi]
                    p += (n - DISCOUNT * t + rest) / (STRENGTH + customers[ci])
                p = (p / SAMPLES).astype("<f4").view("<u4")
                for name, place in zip(who, b.column(3)[i]):
                    at, words = map(_sums, _unzip(place.as_py()))
                    yield pa.record_batch({"stretch": pa.array([name], pa.string()), "cell": pa.array([cell], pa.int32()), "p": pa.array([_zip(p[at])], pa.binary()), "c": pa.array([_zip(known[words])], pa.binary())})
        tidy()

    def file(batches):
        for (name,), refs in groups(batches, ["stretch"]):
            p, c = (np.concatenate([_unzip(b.column(k)[i].as_py())[0] for b, i in refs]) for k in (2, 3))
            put_file(f"{folder}/{name}", _zip(p, c))
            yield pa.record_batch({"stretch": pa.array([name], pa.string()), "n": pa.array([len(p)], pa.int64())})

    answers = shelf.mapInArrow(answer, "stretch string, cell int, p binary, c binary")
    answers = answers.repartition(n_parts, "stretch").sortWithinPartitions("stretch", "cell").mapInArrow(file, "stretch string, n long")
    materialize(answers, "py-files")

    norm = np.log10(max(1, train_tokens + n_types + 1))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def score(batches):
        for name, kept in _stretches(batches, cols):
            q = Questions(_texts(kept, "text"), grid)
            p, of_word = _unzip(get_file(f"{folder}/{name}"))
            parts, first = [], 0
            for _, words, wi in q.cell_words():
                parts.append(of_word[first : first + len(words)][wi])
                first += len(words)
            if len(p) != len(q.ctx) or first != len(of_word):
                raise ValueError(f"stretch {name} differs between passes; write the documents to a table first")
            p, c = np.log10(p.astype("<u4").view("<f4").astype(np.float64)), np.concatenate(parts)
            sizes, where = q.sizes, q.where
            starts = np.cumsum(sizes) - sizes
            known = np.add.reduceat((c > 0)[where].astype(np.int64), starts)
            base = np.add.reduceat((np.log10(c + 1.0) - norm)[where], starts)
            total = np.add.reduceat(p[where], starts)
            first = 0
            for b in kept:
                s = slice(first, first + b.num_rows)
                first += b.num_rows
                more = [pa.array(sizes[s], pa.int64()), pa.array(known[s], pa.int64()), pa.array([train_tokens] * b.num_rows, pa.int64()), pa.array(base[s]), pa.array(total[s])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *more], names=[*names, *added])

    return named(rows.mapInArrow(score, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
