"""Folds whose steps depend on the ones before: signals to tracks, one concurrent track, trimming, shared peaks.

Spark deals out recordings and sorts each of them; tasks then work on columns of whole recordings, several in a
batch. A recording with a null id is one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the merge rules: times in seconds, frequencies in mel.
LOW_BAND, HIGH_START = 1500.0, 1000.0
LONG_OVERLAP, NEAR = 1.5, 2.0
MIN_SIGNAL, MIN_TRACK, MIN_MEL_RANGE, MAX_TRACK = 0.35, 0.7, 50.0, 6.0
#: Fixed values of the peaks: least height, least step to both neighbours, least width in places; a tenth of the first two in the upper band.
PEAK_HEIGHT, PEAK_STEP, PEAK_WIDTH = 0.001, 0.00001, 2.0

Columns = dict[str, np.ndarray]


def mel(f, break_: float = 700.0):
    return 2595.0 * np.log10(1.0 + np.asarray(f, dtype=float) / break_)


def shared(a0, a1, b0, b1):
    """Length two ranges share, negative for their gap."""
    return np.minimum(a1, b1) - np.maximum(a0, b0)


def _recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
    """Columns of one recording (rows with equal first column) after another, from sorted rows."""
    held: list[pa.RecordBatch] = []

    def split(t: pa.Table, whole: bool) -> tuple[list[Columns], pa.Table]:
        key = pc.fill_null(t.column(0), -(2**63)).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        ends = cut if whole else cut[:-1]
        out = []
        for i, j in zip(ends[:-1], ends[1:]):
            part = t.slice(i, j - i)
            out.append({c: part[c].to_numpy(zero_copy_only=False) for c in t.column_names[1:]} | {"key": part.column(0)[0].as_py()})
        return out, t.slice(ends[-1])

    for b in batches:
        if b.num_rows:
            found, rest = split(pa.Table.from_batches([*held, b]), False)
            yield from found
            held = rest.combine_chunks().to_batches()
    if held:
        yield from split(pa.Table.from_batches(held), True)[0]


def per_recording(df: DataFrame, order: list[Column | str], f: Callable[[Columns], Columns], schema: str, rows: int = 20_000) -> DataFrame:
    """``f`` of every recording; the first column of ``df`` names it, and comes back before the columns that ``f`` returns."""
    key, names = df.columns[0], [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        got: list[tuple[object, Columns]] = []
        total = 0

        def give():
            ids = [k for k, c in got for _ in range(len(c[names[1]]))]
            cols = [pa.array(ids, types[0]), *(pa.array(np.concatenate([c[n] for _, c in got]), t) for n, t in zip(names[1:], types[1:]))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for rec in _recordings(batches):
            got.append((rec["key"], f(rec)))
            total += len(got[-1][1][names[1]])
            if total >= rows:
                yield give()
                got, total = [], 0
        if total:
            yield give()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Signals:
    """The signals of one recording as columns, in order of start, at ties the higher band first."""

    def __init__(self, start, end, lo, hi, mass):
        at = np.lexsort((-np.asarray(hi, dtype=float), np.asarray(start, dtype=float)))
        self.start, self.end, self.lo, self.hi, self.mass = (np.array(c, dtype=float)[at] for c in (start, end, lo, hi, mass))
        self.live = np.ones(len(at), dtype=bool)
        self.low, self.top = mel(self.lo), mel(self.hi)

    def join(self, i: int, j: int) -> None:
        """Signal i takes in signal j."""
        for c, pick in ((self.start, min), (self.end, max), (self.lo, min), (self.hi, max)):
            c[i] = pick(c[i], c[j])
        self.low[i], self.top[i] = min(self.low[i], self.low[j]), max(self.top[i], self.top[j])
        self.mass[i] += self.mass[j]
        self.live[j] = False

    def settle(self) -> Signals:
        """Those left, in order again."""
        k = self.live
        return Signals(self.start[k], self.end[k], self.lo[k], self.hi[k], self.mass[k])

    def related(self, i: int) -> np.ndarray:
        """Places of the signals that are parts of one call with signal i, in order."""
        # later signals have their start of the sort, so none from here on is within reach
        to = np.searchsorted(self._begin, self.end[i] + NEAR, side="right")
        at = np.flatnonzero(self.live[:to] & (self.end[:to] >= self.start[i] - NEAR))
        at = at[at != i]
        if not len(at):
            return at
        low, top, my_low, my_top = self.low[at], self.top[at], self.low[i], self.top[i]
        side = (top < LOW_BAND) if my_top < LOW_BAND else (top > LOW_BAND) & (my_top > LOW_BAND)
        time = shared(self.start[i], self.end[i], self.start[at], self.end[at])
        band = shared(my_low, my_top, low, top)
        width, my_width = top - low, my_top - my_low
        much = band > width * np.where((my_low > HIGH_START) & (low > HIGH_START), 0.5, 0.75)
        over, under = np.where(top > my_width, my_width, width), np.where(top > my_width, width, my_width)
        alike = (under > 0) & (over >= 0.75 * under)
        close = (time > 0) | ((-time <= NEAR) & alike)
        return at[side & ((time > LONG_OVERLAP) | (time > 0.75 * (self.end[at] - self.start[at])) & (band > -20) | much & close)]

    def merged(self) -> Signals:
        """In each pass every signal left takes in its first related one, until a pass changes nothing."""
        now = self.settle()
        while True:
            now._begin, before = now.start.copy(), int(now.live.sum())
            for i in range(len(now.live)):
                if now.live[i] and len(at := now.related(i)):
                    now.join(i, int(at[0]))
            if int(now.live.sum()) == before:
                return now
            now = now.settle()

    def widened(self, end: float) -> Signals:
        """Short ones go; each other grows by 1.4 in time and band, then takes in what it overlaps much; narrow ones go at last."""
        for i in range(len(self.live)):
            if not self.live[i]:
                continue
            length = self.end[i] - self.start[i]
            if length < MIN_SIGNAL:
                self.live[i] = False
                continue
            extra = min(1.0, max(length * 1.4, MIN_TRACK) - length) / 2
            self.start[i], self.end[i] = max(0.0, self.start[i] - extra), min(end, self.end[i] + extra)
            wide = (self.hi[i] - self.lo[i]) * 0.2
            self.lo[i], self.hi[i] = int(max(0.0, self.lo[i] - wide)), int(self.hi[i] + wide)
            j = 0  # what it takes in lengthens it, so the rest is looked at again
            while True:
                rest = np.arange(j, len(self.live))
                time = shared(self.start[i], self.end[i], self.start[j:], self.end[j:])
                short = np.minimum(self.end[i] - self.start[i], self.end[j:] - self.start[j:])
                hit = rest[self.live[j:] & (rest != i) & ((time > 0.7 * short) | (time > LONG_OVERLAP))]
                if not len(hit):
                    break
                self.join(i, int(hit[0]))
                j = int(hit[0]) + 1
        self.live &= mel(self.hi) - mel(self.lo) >= MIN_MEL_RANGE
        k = self.live
        out = Signals([], [], [], [], [])
        out.start, out.end, out.lo, out.hi, out.mass, out.live = self.start[k], self.end[k], self.lo[k], self.hi[k], self.mass[k], np.ones(int(k.sum()), dtype=bool)
        return out


def merge_tracks(signals: DataFrame) -> DataFrame:
    """Tracks ``rec_id, track_no, start, end, f_lo, f_hi, mass`` from signals of these columns, ``signal_id`` and ``duration``.

    Signals are merged while any two belong together, then widened; tracks longer than 6 s are cut into equal parts. What
    overlaps longer than 6 s after widening ends at the recording's end. Ties in start and band are ordered by ``signal_id``.
    """

    def fold(r: Columns) -> Columns:
        s = Signals(r["start"], r["end"], r["f_lo"], r["f_hi"], r["mass"]).merged().widened(float(r["duration"].max()))
        parts = np.maximum(1, np.ceil((s.end - s.start) / MAX_TRACK)).astype(int)
        of = np.repeat(np.arange(len(parts)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        step = (s.end - s.start)[of] / parts[of]
        return {"track_no": np.arange(len(of)), "start": s.start[of] + k * step, "end": s.start[of] + (k + 1) * step, "f_lo": s.lo[of], "f_hi": s.hi[of], "mass": s.mass[of]}

    cols = signals.select("rec_id", "signal_id", "start", "end", "f_lo", "f_hi", "mass", "duration")
    schema = "rec_id long, track_no int, start double, end double, f_lo double, f_hi double, mass double"
    return per_recording(cols, ["start", F.desc("f_hi"), "signal_id"], fold, schema)


def absorb(r: Columns) -> Columns:
    """One concurrent track from ``track_id, start, end, f_lo, f_hi`` in order of start.

    A track that shares more than half of the current one's length stands in its place. One that shares more than half of its
    own goes, and so does one that overlaps at all and shares more than half of its band; in the band, the current
    one is lengthened to its end. Any other becomes the current one.
    """
    low, top = mel(r["f_lo"]), mel(r["f_hi"])
    taken, ends, at = [], r["end"].astype(float).copy(), -1
    for i in range(len(ends)):
        if at < 0:
            at = i
            continue
        time = float(shared(r["start"][at], ends[at], r["start"][i], ends[i]))
        in_band = float(shared(low[at], top[at], low[i], top[i])) > 0.5 * (top[i] - low[i]) > 0
        if time > 0.5 * (ends[at] - r["start"][at]) > 0:
            at = i
        elif time > 0 and (time > 0.5 * (ends[i] - r["start"][i]) or in_band):
            ends[at] = max(ends[at], ends[i]) if in_band else ends[at]
        else:
            taken.append(at)
            at = i
    taken += [at] if at >= 0 else []
    return {"track_id": r["track_id"][taken], "start": r["start"][taken], "end": ends[taken]}


def absorb_tracks(tracks: DataFrame) -> DataFrame:
    """``rec_id, track_id, start, end`` after :func:`absorb` of each recording's tracks (with ``f_lo, f_hi``); ties by ``track_id``."""
    cols = tracks.select("rec_id", "track_id", "start", "end", "f_lo", "f_hi")
    return per_recording(cols, ["start", "track_id"], absorb, "rec_id long, track_id long, start double, end double")


def trim_others(tracks: DataFrame, min_length: float = 1.0) -> DataFrame:
    """Tracks that aren't birds (``is_bird`` false) cut against the birds' that overlap them, in order of start: the longer side stays.

    A track cut to under ``min_length`` goes. Bird tracks stay as they are.
    """

    def fold(r: Columns) -> Columns:
        bird = r["is_bird"].astype(bool)
        x, y = r["start"][bird], r["end"][bird]
        a, b, cut = r["start"].astype(float).copy(), r["end"].astype(float).copy(), np.zeros(len(bird), dtype=bool)
        for i in np.flatnonzero(~bird):
            # a cut only shortens, so birds that don't touch the whole track never matter
            for k in np.flatnonzero((x < b[i]) & (y > a[i])):
                if a[i] < y[k] and x[k] < b[i]:
                    a[i], b[i] = (a[i], x[k]) if x[k] - a[i] >= b[i] - y[k] else (y[k], b[i])
                    cut[i] = True
        keep = ~cut | (b - a >= min_length)
        return {"track_id": r["track_id"][keep], "start": a[keep], "end": b[keep], "cut": cut[keep]}

    cols = tracks.select("rec_id", "track_id", "start", "end", "is_bird")
    return per_recording(cols, ["start", "track_id"], fold, "rec_id long, track_id long, start double, end double, cut boolean")


def file_layout(stretches: DataFrame, seconds: float = 10.0, run_rows: int = 100_000) -> DataFrame:
    """Stretches of each tag set put on end: ``file_no`` and ``offset``; a file is closed once it has ``seconds``.

    ``tags`` is text; order is that of ``rec_id, start``. A tag set with more than ``run_rows`` stretches is laid out in
    runs of recordings, each with files of its own; files are numbered through the runs of a tag set.
    """
    size = stretches.groupBy("tags").agg(F.count("*").alias("_n"))
    rows = stretches.select("tags", "rec_id", "start", "end").join(size.where(F.col("_n") > run_rows), "tags", "left")
    n_runs = F.coalesce(F.ceil(F.col("_n") / run_rows), F.lit(1).cast("long"))
    run = F.pmod(F.xxhash64("rec_id"), n_runs)
    rows = rows.select(F.xxhash64("tags", run).alias("_key"), "tags", run.alias("_run"), "rec_id", "start", "end")

    def fold(r: Columns) -> Columns:
        length = r["end"] - r["start"]
        no, at = np.zeros(len(length), dtype=int), np.zeros(len(length))
        k, filled = 0, 0.0
        for i, n in enumerate(length.tolist()):  # each file is summed from 0: a difference of sums over all files may miss a file that is just full
            if filled >= seconds:
                k, filled = k + 1, 0.0
            no[i], at[i] = k, filled
            filled += n
        return {"tags": r["tags"], "run": r["_run"], "rec_id": r["rec_id"], "start": r["start"], "file_no": no, "offset": at}

    laid = per_recording(rows, ["rec_id", "start"], fold, "key long, tags string, run long, rec_id long, start double, file_no int, offset double")
    files = laid.groupBy("tags", "run").agg((F.max("file_no") + 1).alias("_files"))
    before = F.coalesce(F.sum("_files").over(Window.partitionBy("tags").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select(F.col("tags").alias("_tags"), F.col("run").alias("_run"), before.cast("int").alias("_before"))
    joined = laid.join(base, F.col("tags").eqNullSafe(F.col("_tags")) & (F.col("run") == F.col("_run")))
    return joined.select("tags", "rec_id", "start", (F.col("file_no") + F.col("_before")).alias("file_no"), "offset")


def peaks(x: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the peaks of a curve, and the places where it crosses half of their prominence to the left and right.

    A peak is higher than both neighbours by the least step, has the least height (both times ``scale``) and width. Its
    prominence is its height over the higher one of the two lowest points up to where the curve is higher.
    """
    rise, fall = x[1:-1] - x[:-2], x[1:-1] - x[2:]
    found, left, right = [], [], []
    for p in np.flatnonzero((np.minimum(rise, fall) >= PEAK_STEP * scale) & (np.minimum(rise, fall) > 0) & (x[1:-1] >= PEAK_HEIGHT * scale)) + 1:
        higher = np.flatnonzero(x > x[p])
        k = np.searchsorted(higher, p)
        a = higher[k - 1] + 1 if k else 0
        b = higher[k] if k < len(higher) else len(x)
        level = (x[p] + max(x[a : p + 1].min(), x[p:b].min())) / 2
        under = np.flatnonzero(x[a:p] <= level)
        i = a + int(under[-1]) if len(under) else a
        over = np.flatnonzero(x[p + 1 : b] <= level)
        j = p + 1 + int(over[0]) if len(over) else b - 1
        lo = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        hi = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        if hi - lo >= PEAK_WIDTH:
            found.append(p)
            left.append(lo)
            right.append(hi)
    return np.array(found, dtype=int), np.array(left), np.array(right)


def blank_shared(bird: np.ndarray, noise: np.ndarray, upper: np.ndarray, hop: float, near: float = 0.1, alike: float = 0.55) -> np.ndarray:
    """Energy of the bird band without stretches whose peak is in all three bands at once.

    For each peak of the noise band, the first peak of the bird band and some peak of the upper band within ``near``
    seconds count; where the bird band's is like it in width and height, its stretch gets the mean of what is not 0
    afterwards, and so does every other 0. A curve of zeros stays.
    """
    out = np.array(bird, dtype=float)
    p, left, right = peaks(out)
    q, q_left, q_right = peaks(np.asarray(noise, dtype=float))
    u = peaks(np.asarray(upper, dtype=float), 0.1)[0]
    reach = near / hop
    first, third = (np.searchsorted(c, q - reach, side="right") for c in (p, u))
    for n in np.flatnonzero((first < len(p)) & (third < len(u))):
        i = first[n]
        if p[i] - q[n] >= reach or u[third[n]] - q[n] >= reach:
            continue
        a, b = int(left[i]), int(right[i])
        wide = sorted((b - a, int(q_right[n]) - int(q_left[n])))
        high = sorted((float(bird[p[i]]), float(noise[q[n]])))
        if wide[0] >= alike * wide[1] and high[0] >= alike * high[1]:
            out[a:b] = 0
    some = out != 0
    return np.where(some, out, out[some].mean()) if some.any() else out


def remove_shared_peaks(tracks: DataFrame, hop: float) -> DataFrame:
    """``track_id, bird_rms`` after :func:`blank_shared` of ``bird_rms, noise_rms, upper_rms``."""

    def run(it):
        for pdf in it:
            done = [blank_shared(*(np.asarray(v, dtype=float) for v in r), hop) for r in zip(pdf["bird_rms"], pdf["noise_rms"], pdf["upper_rms"])]
            yield pd.DataFrame({"track_id": pdf["track_id"], "bird_rms": [d.tolist() for d in done]})

    return tracks.select("track_id", "bird_rms", "noise_rms", "upper_rms").mapInPandas(run, "track_id long, bird_rms array<double>")
