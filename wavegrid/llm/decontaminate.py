"""Benchmark decontamination: an FM-index per shard of training text, searched backward for the benchmark's word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from wavegrid.llm.common import materialize, set_apart, slices, tidy


#: Bytes to bytes: A-Z lower-cased, what is no part of a word to a blank. A word is `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text bytes of one shard, and suffix positions between samples.
SHARD_BYTES = 12 << 20
#: A shard also ends when all its columns, those that only come along included, take this much.
SHARD_HELD = 256 << 20
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = n - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks over an integer sequence, level by level from the highest bit, zeros of a level before its ones."""

    def __init__(self, seq: np.ndarray, n_levels: int):
        self.levels = []
        for k in reversed(range(n_levels)):
            bit = (seq >> k & 1).astype(bool)
            self.levels.append((k, Bits(bit)))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        first = np.zeros_like(i)
        for k, bits in self.levels:
            one = (c >> k & 1).astype(bool)
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, bits.zeros + a, first - a), np.where(one, bits.zeros + b, i - b)
        return i - first

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it occurs before."""
        first, c = np.zeros_like(i), np.zeros_like(i)
        for k, bits in self.levels:
            one = bits.get(i)
            c |= one.astype(np.int64) << k
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, bits.zeros + a, first - a), np.where(one, bits.zeros + b, i - b)
        return c, i - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: suffixes are ordered by their first 1, 2, 4, ... symbols until all differ. The last symbol must be unique."""
    n, rank, k = len(text), text.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (int(nxt.max()) + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, k * 2


class FMIndex:
    """Of symbols from 1 up; a 0 is added at the end."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.tree = WaveletTree(text[order - 1], max(1, int(n_symbols).bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns at once, symbol by symbol from their ends (patterns stand at the right of the matrix)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(patterns.shape[1]):
            at = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(at):
                break
            c = patterns[at, patterns.shape[1] - 1 - step].astype(np.int64)
            lo[at] = self.smaller[c] + self.tree.rank(c, lo[at])
            hi[at] = self.smaller[c] + self.tree.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the symbol before, until a sampled suffix is met."""
        out, at, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(rows):
            hit = self.sampled.get(rows)
            out[at[hit]] = self.samples[self.sampled.rank(rows[hit])] + steps
            rows, at = rows[~hit], at[~hit]
            if len(rows):
                c, r = self.tree.symbol_and_rank(rows)
                rows = self.smaller[c] + r
            steps += 1
        return out


class Windows:
    """A bounded block of benchmark windows over its own numbering of words."""

    def __init__(self, width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self.of: dict[tuple[int, ...], set[int]] = {}

    def add(self, item_id: str, words: list[bytes]) -> None:
        if not words:
            return
        ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        self.items.append(item_id)
        for k in range(max(1, len(ids) - self.width + 1)):
            self.of.setdefault(tuple(ids[k : k + self.width]), set()).add(len(self.items) - 1)

    def close(self) -> Windows:
        self.lengths = np.array([len(w) for w in self.of], dtype=np.int64)
        self.patterns = np.zeros((len(self.of), self.width), dtype=np.int32)
        for i, w in enumerate(self.of):
            self.patterns[i, self.width - len(w) :] = w
        self.item_at = np.cumsum([0, *(len(x) for x in self.of.values())])
        self.item_of = np.array([k for x in self.of.values() for k in sorted(x)], dtype=np.int64)
        self.shortest = int(self.lengths.min())
        self.of = {}
        return self


def benchmark_passes(items: DataFrame, width: int, max_windows: int, max_bytes: int, pass_windows: int) -> Iterator[tuple[list[Windows], bool]]:
    """``item_id, text`` in blocks of about ``max_windows`` windows, and whether it is the last pass.

    As many blocks as have about ``max_bytes`` characters or ``pass_windows`` windows are one pass. Only the next item is
    read ahead, so no two passes are held at a time; the last one may be without blocks.
    """
    block, blocks, total, n = Windows(width), [], 0, 0
    rows = iter(items.select("item_id", "text").toLocalIterator())
    ahead = next(rows, None)
    while ahead is not None:
        r, ahead = ahead, next(rows, None)
        block.add("null" if r["item_id"] is None else str(r["item_id"]), words_of(r["text"]))
        total += len(r["text"] or "")
        full = total >= max_bytes or n + len(block.of) >= pass_windows
        if len(block.of) >= max_windows or full:
            n += len(block.of)
            blocks += [block.close()] if block.of else []
            block = Windows(width)
        if full and ahead is not None:
            if blocks:
                yield blocks, False
            blocks, total, n = [], 0, 0
    yield blocks + ([block.close()] if block.of else []), True


def _search_shard(folded: list[bytes], block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, cover of all words on end, and pairs (text, item).

    Only stretches of benchmark words as long as the shortest window can hold a window, so only they are
    indexed, each behind a separator; that leaves out no occurrence.
    """
    get, counts, ids = block.vocab.get, [], []
    for t in folded:
        words = t.split()
        counts.append(len(words))
        ids.append(np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)))
    counts = np.array(counts, dtype=np.int64)
    seq = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    first = np.cumsum(counts) - counts
    cover = np.zeros(len(seq) + 1, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(seq) + 1, dtype=bool)
    cut[first[first < len(seq)]] = True
    known = seq > 0
    begins = known & (cut[:-1] | ~np.concatenate([[False], known[:-1]]))
    starts = np.flatnonzero(begins)
    if not len(starts):
        return counts, cover[:-1] > 0, none, none
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=len(starts))
    keep = sizes >= block.shortest
    if not keep.any():
        return counts, cover[:-1] > 0, none, none
    at = np.flatnonzero(known & keep[run])
    opens = np.flatnonzero(begins[at])
    n_symbols = len(block.vocab) + 1
    text = np.insert(seq[at], opens, n_symbols)  # the separator is the largest symbol
    origin = np.insert(at, opens, -1)
    index = FMIndex(text, n_symbols)
    lo, hi = index.search(block.patterns, block.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return counts, cover[:-1] > 0, none, none
    many = (hi - lo)[found]
    window = np.repeat(found, many)
    rows = np.repeat(lo[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = origin[index.locate(rows)]
    np.add.at(cover, place, 1)
    np.add.at(cover, place + block.lengths[window], -1)
    doc = np.searchsorted(first, place, side="right") - 1
    pair = np.unique(doc * len(block.item_at) + window)
    doc, window = pair // len(block.item_at), pair % len(block.item_at)
    n = block.item_at[window + 1] - block.item_at[window]
    item = block.item_of[np.repeat(block.item_at[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    pair = np.unique(np.repeat(doc, n) * len(block.items) + item)
    return counts, np.cumsum(cover[:-1]) > 0, pair // len(block.items), pair % len(block.items)


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, max_windows: int = 200_000, max_bytes: int = 32 << 20, pass_windows: int = 2_000_000) -> DataFrame:
    """Adds to every document ``n_words, n_hit``, ``item_ids`` (sorted as strings), ``contaminated``, ``spans`` and ``clean_text``.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. ``spans`` are the merged
    character ranges (start, end) from the first to the last word of each stretch of hit words; ``clean_text`` is
    the text without them, each replaced by a blank, and equals ``text`` where nothing is hit.

    Each task takes documents up to 12 MB of text as a shard, indexes it, searches all windows and locates
    the hits; nothing is shuffled. The benchmark comes in blocks of a bounded number of windows, each searched
    in every shard. Blocks of up to ``max_bytes`` of text and ``pass_windows`` windows (some 70 bytes each) are
    broadcast together; a larger benchmark takes further passes over the documents, which carry what was hit so far
    (a bit for each word). The driver holds one pass at a time.

    A null or empty text has no words; items without words have no windows; an item with a null id is listed
    as ``null``. Repeated rows are judged alike, each by itself; ids aren't looked at. Columns of the added
    names are replaced, others kept whatever their names are. An empty benchmark leaves every document clean.
    """
    docs, named = set_apart(docs, {"text": "text"}, ["n_words", "n_hit", "item_ids", "contaminated", "spans", "clean_text"])
    sc, names = docs.sparkSession.sparkContext, docs.columns
    now = docs
    for blocks, is_last in benchmark_passes(items, width, max_windows, max_bytes, pass_windows):
        shared = [sc.broadcast(b) for b in blocks]
        now = _search(now, names, shared, is_last)
        if not is_last:
            now = materialize(now, "contamination-so-far")
            for b in shared:
                b.destroy()
            del blocks
    return named(now)


def _search(docs: DataFrame, names: list[str], blocks: list, is_last: bool) -> DataFrame:
    """One pass over documents, which may have what earlier passes hit; the last one gives the columns of :func:`find_contamination`."""
    prior, at = len(docs.columns) > len(names), names.index("text")
    carried = StructType.fromDDL("__wg_cover binary, __wg_items array<string>")
    result = StructType.fromDDL("n_words long, n_hit long, item_ids array<string>, contaminated boolean, spans array<struct<start:int,end:int>>, clean_text string")
    more_fields = (result if is_last else carried).fields
    added = [f.name for f in more_fields]
    schema = StructType([*docs.select(*names).schema.fields, *more_fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def shard(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(at).to_pylist()
        folded = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
        hit_items: list[set[str]] = [set() for _ in texts]
        counts, cover = None, None
        for bc in blocks:
            counts, more, doc, item = _search_shard(folded, bc.value)
            cover = more if cover is None else cover | more
            for d, k in zip(doc.tolist(), item.tolist()):
                hit_items[d].add(bc.value.items[k])
        if counts is None:
            counts = np.array([len(f.split()) for f in folded], dtype=np.int64)
            cover = np.zeros(counts.sum(), dtype=bool)
        first = np.cumsum(counts) - counts
        if prior:
            for d, (bits, ids) in enumerate(zip(rows.column(len(names)).to_pylist(), rows.column(len(names) + 1).to_pylist())):
                hit_items[d].update(ids)
                cover[first[d] : first[d] + counts[d]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts[d])).astype(bool)
        found = pa.array([sorted(x) for x in hit_items], pa.list_(pa.string()))
        if not is_last:
            bits = [np.packbits(cover[a : a + n]).tobytes() for a, n in zip(first.tolist(), counts.tolist())]
            return pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(bits, pa.binary()), found], names=[*names, *added])
        sums = np.concatenate([[0], np.cumsum(cover)])
        hits = sums[first + counts] - sums[first]
        spans: list[list[dict]] = [[] for _ in texts]
        clean = list(texts)
        for d in np.flatnonzero(hits):
            hit = cover[first[d] : first[d] + counts[d]]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            runs = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1))
            places = [m.span() for m in _WORD.finditer(texts[d])]
            spans[d] = [{"start": places[a][0], "end": places[b][1]} for a, b in runs]
            out, last = [], 0
            for s in spans[d]:
                out.append(texts[d][last : s["start"]])
                last = s["end"]
            clean[d] = " ".join([*out, texts[d][last:]])
        more = [
            pa.array(counts, pa.int64()),
            pa.array(hits, pa.int64()),
            found,
            pa.array(hits > 0, pa.bool_()),
            pa.array(spans, span),
            pa.array(clean, pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *more], names=[*names, *added])

    def search(batches):
        kept, size, held = [], 0, 0

        def shards():  # a column beyond 2 GiB comes in several chunks
            return map(shard, pa.Table.from_batches(kept).combine_chunks().to_batches())

        for b in slices(batches, 2048):
            each = b.nbytes // max(b.num_rows, 1)
            lengths = [len(t) if t else 0 for t in b.column(at).to_pylist()]
            begin = 0
            for i, n in enumerate(lengths):
                size += n + 16  # rows without text end a shard, too
                held += each
                if size >= SHARD_BYTES or held >= SHARD_HELD:
                    kept.append(b.slice(begin, i + 1 - begin))
                    yield from shards()
                    kept, size, held, begin = [], 0, 0, i + 1
            if begin < len(lengths):
                kept.append(b.slice(begin))
        if kept:
            yield from shards()
            kept = []
        tidy()

    return docs.mapInArrow(search, schema)
