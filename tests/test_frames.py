"""Recordings in segments of any lengths, against the whole recording in one array."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.operators import features, frames, graphs

RATE, N_FFT, HOP = 8000, 256, 64


def recording(seed: int, n: int = 40_000) -> np.ndarray:
    g = np.random.default_rng(seed)
    x = g.normal(0, 0.01, n)
    for _ in range(6):
        a = int(g.integers(0, n - 6000))
        k = int(g.integers(1500, 6000))
        f = float(g.uniform(400, 3000))
        x[a : a + k] += 0.3 * np.sin(2 * np.pi * (f + np.linspace(0, 200, k)) * np.arange(k) / RATE)
    return x


def cut(x, places):
    at = [0, *places, len(x)]
    return [x[a:b].tolist() for a, b in zip(at, at[1:])]


def table(spark, recs):
    rows = [(name, k, RATE, part) for name, parts in recs.items() for k, part in enumerate(parts)]
    return spark.createDataFrame(rows, "r string, segment_no int, rate int, samples array<double>").repartition(4)


def spectra(df):
    out = {}
    for r in df.orderBy("rec", "chunk").collect():
        out.setdefault(r["rec"], []).append(np.array(r["spectrum"]).reshape(r["n_frames"], r["n_bins"]))
    return {k: np.concatenate(v) for k, v in out.items()}


def test_frames_equal_those_of_the_whole_recording(spark):
    x = recording(1)
    places = sorted(random.Random(2).sample(range(1, len(x)), 19))
    short = x[: 64 * 60]
    recs = {"one": cut(x, []), "twenty": cut(x, places), "tiny": cut(short, list(range(10, len(short), 37))), "multiple": [short.tolist()], "empty": [[]], "brief": [[0.5] * 10]}
    got = spectra(frames.recording_frames(table(spark, recs), "r", N_FFT, HOP, frames=30, kind="double"))
    for name, parts in recs.items():
        want = features.spectrogram(np.array(sum(parts, [])), N_FFT, HOP).T
        assert got[name].shape == want.shape and np.allclose(got[name], want, atol=1e-9), name


def test_bin_medians_are_exact(spark):
    recs = {"odd": cut(recording(3, 64 * 100), [999]), "even": cut(recording(4, 64 * 101), []), "flat": [[0.0] * 900]}
    f = frames.recording_frames(table(spark, recs), "r", N_FFT, HOP, frames=13)
    whole = spectra(f)
    got = {r["rec"]: np.array(r["medians"]) for r in frames.bin_medians(f).collect()}
    for name in recs:
        assert np.array_equal(got[name], np.median(whole[name].astype(np.float64), axis=0)), name


def plain_window(mask, k_back, k_on, axis, every):
    out = np.zeros_like(mask)
    for i in range(mask.shape[axis]):
        part = np.take(mask, range(max(0, i - k_back), min(mask.shape[axis], i + k_on + 1)), axis)
        index = [slice(None)] * 2
        index[axis] = i
        out[tuple(index)] = part.all(axis=axis) if every else part.any(axis=axis)
    return out


@pytest.mark.parametrize("high, wide", [(1, 1), (4, 4), (5, 2), (3, 40)])
def test_windows_equal_plain_ones(high, wide):
    m = np.random.default_rng(high).random((30, 21)) < 0.6
    d = plain_window(plain_window(m, (wide - 1) // 2, wide // 2, 0, False), (high - 1) // 2, high // 2, 1, False)
    e = plain_window(plain_window(m, wide // 2, (wide - 1) // 2, 0, True), high // 2, (high - 1) // 2, 1, True)
    assert np.array_equal(frames.dilate(m, high, wide), d) and np.array_equal(frames.erode(m, high, wide), e)
    opened = frames.dilate(frames.erode(m, high, wide), high, wide)
    assert not (opened & ~m).any()  # an opening adds nothing
    assert np.array_equal(frames.dilate(frames.erode(opened, high, wide), high, wide), opened)


def flood(mask):
    """Boxes of cells that touch, corners included, one by one."""
    left, out = set(zip(*map(list, np.nonzero(mask)))), []
    while left:
        todo = [left.pop()]
        seen = list(todo)
        while todo:
            t, f = todo.pop()
            for n in itertools.product((t - 1, t, t + 1), (f - 1, f, f + 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
                    seen.append(n)
        ts, fs = [t for t, _ in seen], [f for _, f in seen]
        out.append([min(ts), max(ts) + 1, min(fs), max(fs) + 1, len(seen)])
    return sorted(out)


@pytest.mark.parametrize("share", [0.1, 0.35, 0.5])
def test_components_equal_flooding(share):
    m = np.random.default_rng(int(share * 100)).random((60, 30)) < share
    boxes, (first, last) = frames.labelled(m)
    assert sorted(boxes) == flood(m)
    assert sum(hi - lo for lo, hi, _ in first) == m[0].sum() and all(boxes[i][1] == 60 for _, _, i in last)
    assert frames.labelled(np.zeros((3, 4), bool)) == ([], [[], []])


def plain_signals(x, frame_times, bin_times, kernel, wide, high):
    s = features.spectrogram(x, N_FFT, HOP).T.astype(np.float32).astype(np.float64)
    m = (s > frame_times * np.median(s, axis=1, keepdims=True)) & (s > bin_times * np.median(s, axis=0))
    boxes = flood(frames.clean(m, kernel, high, wide))
    return sorted(tuple(b) for b in boxes if b[1] - b[0] > 0.65 * wide and b[3] - b[2] > high - high // 10)


def test_signals_do_not_depend_on_segments_or_chunks(spark):
    x, y = recording(5), recording(6, 30_000)
    long_tone = 0.2 * np.sin(2 * np.pi * 1500 * np.arange(50_000) / RATE) * (np.arange(50_000) > 3000) + np.random.default_rng(9).normal(0, 0.01, 50_000)
    long_tone[20_000:27_000] *= 0.01
    r = random.Random(4)
    places = lambda n, k: sorted(r.sample(range(1, n), k))
    recs = {"x1": cut(x, []), "x20": cut(x, places(len(x), 19)), "y1": cut(y, []), "y7": cut(y, places(len(y), 6)), "t1": cut(long_tone, []), "t20": cut(long_tone, places(50_000, 19)), "none": [[]]}
    wide, high = int(0.05 * RATE / HOP), int(60.0 * N_FFT / RATE) + 2
    want = {"x": plain_signals(x, 2.0, 1.5, 2, wide, high), "y": plain_signals(y, 2.0, 1.5, 2, wide, high), "t": plain_signals(long_tone, 2.0, 0.5, 2, wide, high)}
    for n, bin_times, names in ((24, 1.5, "xy"), (57, 1.5, "x"), (24, 0.5, "t")):
        some = {k: v for k, v in recs.items() if k[0] in names or k == "none"}
        out = frames.detect_signals(table(spark, some), "r", N_FFT, HOP, 2.0, bin_times, 2, 0.05, 60.0, frames=n).collect()
        by = {}
        for s in out:
            box = (round(s["start"] * RATE / HOP), round(s["end"] * RATE / HOP), round(s["f_lo"] * N_FFT / RATE), s["mass"])
            by.setdefault(s["r"], []).append(box)
        for name in some:
            assert sorted(by.get(name, [])) == sorted((b[0], b[1], b[2], b[4]) for b in want.get(name[0], [])), (name, n)
    assert want["x"] and want["y"] and any(b[1] - b[0] > 200 for b in want["t"])


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (None, 7)]
    ids = r.sample(range(10_000), 3000)
    links = [(None if a is None else ids[a], ids[b]) for a, b in links]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in graphs.components(df).collect()}
    assert got == {v: root(v) for v in parent}
    assert graphs.components(df.where(F.lit(False))).count() == 0
