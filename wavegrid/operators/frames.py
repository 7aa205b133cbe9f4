"""Spectra and signals of recordings that are cut into segments of any lengths: results don't depend on the cuts.

Spark cuts recordings into chunks of one length with a margin, counts, joins and stitches; numpy does the arithmetic of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.operators.features import HOP
from wavegrid.operators.graphs import components
from wavegrid.operators.sizes import small
from wavegrid.sources.scratch import written

#: Frames of a chunk.
FRAMES = 2048


def rechunked(segments: DataFrame, rec: str, length: int, margin: int) -> DataFrame:
    """``rec, rate, chunk, first, total, samples``: chunks of ``length`` samples, each with up to ``margin`` samples more on both sides.

    ``segments`` (``rec, segment_no, rate, samples``) follow each other by ``segment_no``; each sends slices to the chunks it
    reaches, and a chunk puts its slices together, so no task holds more of a recording than a chunk or a given segment.
    ``first`` is the place of the first sample in the recording, ``total`` the recording's length. A recording without samples
    has one empty chunk; null samples count as none.
    """
    n = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    s = segments.select(F.col(f"`{rec}`").alias("rec"), "segment_no", "rate", F.coalesce("samples", F.array().cast(segments.schema["samples"].dataType)).alias("samples")).withColumn("n", n)
    whole = Window.partitionBy("rec")
    before = whole.orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)
    # lengths only: a row a segment, without its samples
    places = s.select("rec", "segment_no", "n").withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)})
    s = s.drop("n").join(places, ["rec", "segment_no"])
    low = F.greatest(F.floor((F.col("at") - margin) / length), F.lit(0))
    high = F.least(F.floor((F.col("at") + F.col("n") + margin) / length), F.floor(F.col("total") / length))
    s = s.withColumn("chunk", F.explode(F.sequence(low, F.greatest(low, high))))
    start = F.greatest(F.col("at"), F.col("chunk") * length - margin)
    end = F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * length + margin)
    part = F.slice("samples", (start - F.col("at") + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    s = s.select("rec", "rate", "chunk", "total", F.struct(start.alias("start"), part.alias("part")).alias("s")).where("size(s.part) > 0 or total = 0")
    got = s.groupBy("rec", "chunk").agg(F.first("rate").alias("rate"), F.first("total").alias("total"), F.array_sort(F.collect_list("s")).alias("all"))
    return got.select("rec", "rate", "chunk", F.get("all.start", F.lit(0)).alias("first"), "total", F.flatten("all.part").alias("samples"))


def recording_frames(segments: DataFrame, rec: str, n_fft: int = 2048, hop: int = HOP, frames: int = FRAMES, kind: str = "float") -> DataFrame:
    """``rec, rate, chunk, first_frame, n_frames, n_bins, spectrum``: magnitudes of the recording's frames, frame by frame on end.

    As ``features.spectrogram`` of the whole recording: frames are centred at multiples of ``hop``, zeros lie beyond its ends
    only. All frames of a chunk are transformed at once.
    """
    margin, length = n_fft // 2, hop * frames
    chunks = rechunked(segments, rec, length, margin)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        for pdf in it:
            for r in pdf.itertuples():
                first = r.chunk * frames
                n = min(frames, r.total // hop + 1 - first)
                x = np.zeros((n - 1) * hop + n_fft)
                samples = np.asarray(r.samples, dtype=np.float64)
                at = r.first - (first * hop - margin)
                part = samples[max(0, -at) : max(0, len(x) - at)]
                x[max(0, at) : max(0, at) + len(part)] = part
                cut = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
                s = np.abs(np.fft.rfft(cut * window, axis=1))
                yield pd.DataFrame(
                    {"rec": [r.rec], "rate": [r.rate], "chunk": [r.chunk], "first_frame": [first], "n_frames": [n], "n_bins": [s.shape[1]], "spectrum": [s.ravel().astype(np.float32 if kind == "float" else np.float64)]}
                )

    id_type = chunks.schema["rec"].dataType.simpleString()
    return chunks.mapInPandas(run, f"rec {id_type}, rate int, chunk long, first_frame long, n_frames int, n_bins int, spectrum array<{kind}>")


def _counted(frames: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """``rec, bin, rank, key, n``: how often the upper 16 bits of magnitudes occur, or in ``wanted`` buckets the lower ones."""
    id_type, upper = frames.schema["rec"].dataType.simpleString(), wanted is None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                bits = np.asarray(r.spectrum, dtype=np.float32).reshape(r.n_frames, r.n_bins).view(np.uint32)
                bins = np.broadcast_to(np.arange(r.n_bins, dtype=np.int64), bits.shape)
                if upper:
                    key, n = np.unique((bins << 16) | (bits >> 16), return_counts=True)
                    yield pd.DataFrame({"rec": r.rec, "bin": key >> 16, "rank": 0, "key": key & 0xFFFF, "n": n})
                    continue
                for rank in (0, 1):
                    hit = (bits >> 16) == np.asarray(r.buckets[rank], dtype=np.uint32)
                    key, n = np.unique((bins[hit] << 16) | (bits[hit] & 0xFFFF), return_counts=True)
                    yield pd.DataFrame({"rec": r.rec, "bin": key >> 16, "rank": rank, "key": key & 0xFFFF, "n": n})

    rows = frames.select("rec", "n_frames", "n_bins", "spectrum")
    if wanted is not None:
        rows = rows.join(wanted, "rec")
    got = rows.mapInPandas(run, f"rec {id_type}, bin int, rank int, key long, n long")
    return got.groupBy("rec", "bin", "rank", "key").agg(F.sum("n").alias("n"))


def _at_rank(counts: DataFrame, left: Column) -> DataFrame:
    """The key in which the value number ``left`` (from 0) of each (rec, bin, rank) lies, and how many values of that key come before it."""
    w = Window.partitionBy("rec", "bin", "rank").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("left", left)
    return c.where("before <= left and left < before + n").select("rec", "bin", "rank", "key", (F.col("left") - F.col("before")).alias("rest"))


def bin_medians(frames: DataFrame) -> DataFrame:
    """``rec, medians``: the exact median of every bin over all frames of a recording of any length, in single precision as stored.

    Magnitudes are not negative, so their bits are in order. Tasks count the upper halves; the bucket of either middle value is
    looked up in running sums over at most 32,768 keys, and a second pass counts the lower halves in those buckets. Values
    themselves are never gathered.
    """
    upper = _counted(frames, None)
    total = F.sum("n").over(Window.partitionBy("rec", "bin"))
    ranks = upper.withColumn("total", total).withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1))))
    middle = F.floor((F.col("total") - 1 + F.col("rank")) / 2)
    found = written(_at_rank(ranks, middle), "median-buckets")
    arrays = found.groupBy("rec", "rank").agg(F.array_sort(F.collect_list(F.struct("bin", "key"))).alias("a"))
    buckets = arrays.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("a.key").alias("keys")))).alias("r")).select("rec", F.col("r.keys").alias("buckets"))
    lower = _counted(frames, small(written(buckets, "median-arrays"), 16 * 1024))
    rest = found.select("rec", "bin", "rank", F.col("key").alias("upper"), F.col("rest").alias("left"))
    exact = _at_rank(lower.join(rest, ["rec", "bin", "rank"]).withColumnRenamed("left", "from_left"), F.col("from_left"))
    exact = exact.join(rest.drop("left"), ["rec", "bin", "rank"])
    rows = exact.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("bin", "rank", (F.col("upper") * 65536 + F.col("key")).alias("bits")))).alias("v"))
    id_type = frames.schema["rec"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            halves = [np.array([x["bits"] for x in v], dtype=np.uint32).view(np.float32).astype(np.float64).reshape(-1, 2).mean(axis=1) for v in pdf["v"]]
            yield pd.DataFrame({"rec": pdf["rec"], "medians": halves})

    return rows.mapInPandas(run, f"rec {id_type}, medians array<double>")


def _window_counts(mask: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """How many cells are set from ``before`` places back to ``after`` places on; places outside count for nothing."""
    sums = np.concatenate([np.zeros_like(np.take(mask, [0], axis), dtype=np.int32), np.cumsum(mask, axis=axis, dtype=np.int32)], axis=axis)
    n, i = mask.shape[axis], np.arange(mask.shape[axis])
    return np.take(sums, np.minimum(i + after + 1, n), axis) - np.take(sums, np.maximum(i - before, 0), axis)


def dilate(mask: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Frames by bins: a cell is set if any is in the window of ``wide`` frames and ``high`` bins around it. The window of an even size reaches further ahead."""
    for axis, k in ((0, wide), (1, high)):
        mask = _window_counts(mask, (k - 1) // 2, k // 2, axis) > 0
    return mask


def erode(mask: np.ndarray, high: int, wide: int) -> np.ndarray:
    """A cell stays if all in the window are set that lie inside; the window of an even size reaches further back, so that an opening moves nothing."""
    for axis, k in ((0, wide), (1, high)):
        mask = _window_counts(~mask, k // 2, (k - 1) // 2, axis) == 0
    return mask


def clean(mask: np.ndarray, kernel: int, high: int, wide: int) -> np.ndarray:
    """Opening by a square, then dilation by (high, wide) and erosion by (high // 10, wide)."""
    opened = dilate(erode(mask, kernel, kernel), kernel, kernel)
    return erode(dilate(opened, high, wide), max(1, high // 10), wide)


def labelled(mask: np.ndarray) -> tuple[list[list[int]], list[list[tuple[int, int, int]]]]:
    """Components of set cells (frames by bins) that touch, corners included: boxes ``[t0, t1, f0, f1, cells]``, and the runs ``(lo, hi, box)`` of the first and last frame.

    Runs of each frame are joined with those of the frame before; numbers point to the box they were joined into.
    """
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    last: list[tuple[int, int, int]] = []
    ends: list[list[tuple[int, int, int]]] = [[], []]
    for t in range(len(mask)):
        edge = np.diff(np.concatenate([[0], mask[t].astype(np.int8), [0]]))
        now, k = [], 0
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            while k < len(last) and last[k][1] < lo:
                k += 1
            i, j = -1, k
            while j < len(last) and last[j][0] <= hi:
                r = root(last[j][2])
                if i < 0:
                    i = r
                elif r != i:
                    a, b = min(i, r), max(i, r)
                    parent[b], x, y = a, boxes[a], boxes[b]
                    boxes[a] = [min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]), x[4] + y[4]]
                    i = a
                j += 1
            if i < 0:
                i = len(parent)
                parent.append(i)
                boxes.append([t, t + 1, lo, hi, 0])
            x = boxes[i]
            boxes[i] = [x[0], t + 1, min(x[2], lo), max(x[3], hi), x[4] + hi - lo]
            now.append((lo, hi, i))
        last = now
        if t == 0:
            ends[0] = now
    ends[1] = last
    keep = {i: n for n, i in enumerate(i for i in range(len(parent)) if parent[i] == i)}
    return [boxes[i] for i in keep], [[(lo, hi, keep[root(i)]) for lo, hi, i in e] for e in ends]


def detect_signals(segments: DataFrame, rec: str, n_fft: int = 2048, hop: int = HOP, frame_times: float = 2.0, bin_times: float = 3.0, kernel: int = 4, wide_seconds: float = 0.25, high_hz: float = 100.0, frames: int = FRAMES) -> DataFrame:
    """``rec, start, end, f_lo, f_hi, mass``: signals of whole recordings, the same whether a recording is one segment or twenty.

    Cells above ``frame_times`` their frame's median and ``bin_times`` their bin's median over the recording are cleaned up
    (:func:`clean`, with windows of ``wide_seconds`` and the bins up to ``high_hz``), and those that touch make a signal. Kept are signals
    wider than 0.65 of the window and higher than 0.9 of it. ``mass`` counts cells.

    Chunks exchange as many frames of their masks as the windows reach. Components are found chunk by chunk; where set runs of
    neighbouring border frames touch, their components are linked, and linked ones become one signal, however many chunks it spans.
    Recordings without samples have no signals. Other columns are ignored; all segments of a recording have one rate.
    """
    spectra = written(recording_frames(segments, rec, n_fft, hop, frames), "frames")
    medians = written(bin_medians(spectra), "medians")
    rates = [r[0] for r in spectra.select("rate").distinct().collect()]  # sampling rates in use: a handful
    window = {r: max(1, int(wide_seconds * r / hop)) for r in rates if r}
    reach = 2 * kernel + 2 * max(window.values(), default=1)
    if reach > frames:
        raise ValueError(f"chunks of {frames} frames are shorter than the windows' reach of {reach}")
    rows = spectra.join(small(medians, 8 * (n_fft // 2 + 1)), "rec")
    id_type = spectra.schema["rec"].dataType.simpleString()

    def masks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                s = np.asarray(r.spectrum, dtype=np.float64).reshape(r.n_frames, r.n_bins)
                m = np.packbits((s > frame_times * np.median(s, axis=1, keepdims=True)) & (s > bin_times * np.asarray(r.medians)), axis=1)
                out = [(r.chunk, 0, m), (r.chunk + 1, -1, m[-reach:]), (r.chunk - 1, 1, m[:reach])]
                out = [x for x in out if x[0] >= 0]
                yield pd.DataFrame({"rec": r.rec, "rate": r.rate, "n_bins": r.n_bins, "chunk": [x[0] for x in out], "side": [x[1] for x in out], "mask": [x[2].tobytes() for x in out]})

    packed = rows.mapInPandas(masks, f"rec {id_type}, rate int, n_bins int, chunk long, side int, mask binary")
    whole = packed.groupBy("rec", "rate", "n_bins", "chunk").agg(F.array_sort(F.collect_list(F.struct("side", "mask"))).alias("parts"))
    runs = "array<struct<lo:int,hi:int,part:int>>"

    def label(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                got = {p["side"]: np.frombuffer(p["mask"], np.uint8).reshape(-1, (r.n_bins + 7) // 8) for p in r.parts}
                if 0 not in got:
                    continue
                before = len(got.get(-1, ()))
                m = np.unpackbits(np.concatenate([got[k] for k in sorted(got)]), axis=1, count=r.n_bins).astype(bool)
                high = int(high_hz * n_fft / r.rate) + 2
                m = clean(m, kernel, high, window[r.rate])[before : before + len(got[0])]
                boxes, (left, right) = labelled(m)
                shift = r.chunk * frames
                boxes = [(i, b[0] + shift, b[1] + shift, b[2], b[3], b[4]) for i, b in enumerate(boxes)]
                yield pd.DataFrame({"rec": [r.rec], "rate": [r.rate], "n_bins": [r.n_bins], "chunk": [r.chunk], "boxes": [boxes], "left": [left], "right": [right]})

    parts = written(whole.mapInPandas(label, f"rec {id_type}, rate int, n_bins int, chunk long, boxes array<struct<part:int,t0:long,t1:long,f0:int,f1:int,mass:long>>, left {runs}, right {runs}"), "signal-parts")
    node = lambda chunk, part: F.struct(F.col("rec"), chunk.alias("chunk"), part.alias("part"))
    ends = parts.select("rec", F.col("chunk").alias("border"), F.explode("right").alias("r"))
    begins = parts.select("rec", (F.col("chunk") - 1).alias("border"), F.explode("left").alias("l"))
    touch = ends.join(begins, ["rec", "border"]).where("r.lo <= l.hi and l.lo <= r.hi")
    links = touch.select(node(F.col("border"), F.col("r.part")).alias("a"), node(F.col("border") + 1, F.col("l.part")).alias("b"))
    joined = components(links)
    b = parts.select("rec", "rate", "n_bins", "chunk", F.explode("boxes").alias("x")).withColumn("node", node(F.col("chunk"), F.col("x.part")))
    b = b.join(joined, "node", "left").groupBy("rec", "rate", "n_bins", F.coalesce("component", "node").alias("of"))
    b = b.agg(F.min("x.t0").alias("t0"), F.max("x.t1").alias("t1"), F.min("x.f0").alias("f0"), F.max("x.f1").alias("f1"), F.sum("x.mass").alias("mass"))
    wide = F.greatest(F.lit(1), (F.lit(wide_seconds) * F.col("rate") / hop).cast("int"))
    high = (F.lit(high_hz) * n_fft / F.col("rate")).cast("int") + 2
    b = b.where((F.col("t1") - F.col("t0") > 0.65 * wide) & (F.col("f1") - F.col("f0") > high - F.floor(high / 10)))
    seconds = lambda c: F.col(c) * hop / F.col("rate")
    hz = lambda c: c * F.col("rate") / F.lit(n_fft)
    return b.select(F.col("rec").alias(rec), seconds("t0").alias("start"), seconds("t1").alias("end"), hz(F.col("f0")).alias("f_lo"), hz(F.least("f1", F.col("n_bins") - 1)).alias("f_hi"), "mass")
