"""Numeric features of recordings: WAV to samples, spectrograms, mel bands, band energy, signal detection, noise mixing.

Spark lists and deals out files or segments; numpy does the arithmetic of one segment.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions.arrays import let

N_FFT, HOP = 4096, 281
MEL_BANDS, F_MIN, F_MAX, BREAK = 160, 100.0, 11000.0, 1000.0


def read_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1] of a PCM file of 8, 16 or 32 bits; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate, channels, bits, body = 12, 0, 1, 16, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    kind = {8: "u1", 16: "<i2", 32: "<i4"}[bits]
    x = np.frombuffer(body[: len(body) // (bits // 8 * channels) * (bits // 8 * channels)], dtype=kind).astype(np.float64)
    x = (x - 128) / 128 if bits == 8 else x / float(1 << (bits - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def write_wav(x: np.ndarray, rate: int) -> bytes:
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def recordings_to_segments(spark: SparkSession, folder: str, seconds: float = 60.0) -> DataFrame:
    """``path, segment_no, rate, samples``: WAV files of a folder in segments; files that can't be read have one row with ``error``."""

    def run(it):
        for pdf in it:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rate, x = read_wav(data)
                except (ValueError, KeyError, struct.error) as e:
                    yield pd.DataFrame({"path": [path], "segment_no": [None], "rate": [None], "samples": [None], "error": [str(e)]})
                    continue
                n = max(1, int(seconds * rate))
                for k in range(0, max(1, len(x)), n):
                    yield pd.DataFrame({"path": [path], "segment_no": [k // n], "rate": [rate], "samples": [x[k : k + n].astype(np.float32)], "error": [None]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, segment_no int, rate int, samples array<float>, error string")


def spectrogram(x: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Magnitudes, bins by frames: Hann windows, frames centred, zeros beyond the ends."""
    padded = np.pad(np.asarray(x, dtype=np.float64), n_fft // 2)
    n = 1 + max(0, (len(padded) - n_fft) // hop)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:n]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(frames * window, axis=1)).T


def mel_filters(rate: int, n_fft: int = N_FFT, bands: int = MEL_BANDS, lo: float = F_MIN, hi: float = F_MAX, break_: float = BREAK) -> np.ndarray:
    """Triangles, evenly spaced on a mel scale with the given break frequency, of equal area."""
    to, back = (lambda f: 2595 * np.log10(1 + f / break_)), (lambda m: break_ * (10 ** (m / 2595) - 1))
    edges = back(np.linspace(to(lo), to(hi), bands + 2))
    freqs = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (freqs[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    lo, hi = float(x.min()), float(x.max())
    return 2 * ((x - lo) / (hi - lo + 1e-6)) - 1


def fit_length(x: np.ndarray, n: int) -> np.ndarray:
    """Cut to n samples, or zeros added evenly on both sides."""
    short = n - len(x)
    return x[:n] if short <= 0 else np.pad(x, (short // 2, short - short // 2))


def log_mel(x: np.ndarray, rate: int, filters: np.ndarray, seconds: float = 3.0, hop: int = HOP, subtract_mean: bool = True) -> np.ndarray:
    """Mel bands in dB (at most 80 below the largest) of one segment, each less its mean."""
    n_fft = (filters.shape[1] - 1) * 2
    bands = filters @ spectrogram(fit_length(_scaled(np.asarray(x, dtype=np.float64)), int(rate * seconds)), n_fft, hop) ** 2
    db = 10 * np.log10(np.maximum(1e-10, bands))
    db = np.maximum(db, db.max() - 80)
    return db - db.mean(axis=1, keepdims=True) if subtract_mean else db


def mel_features(segments: DataFrame, id_col: str, n_fft: int = N_FFT, hop: int = HOP, bands: int = MEL_BANDS, seconds: float = 3.0, lo: float = F_MIN, hi: float = F_MAX, breaks: tuple[float, ...] = (BREAK,), number: str = "float") -> DataFrame:
    """``id, n_bands, n_frames, features``: log-mel bands of ``samples`` (array) at ``rate``, row by row on end.

    Several break frequencies give as many stacked filterbanks. Empty and constant samples give zeros. ``number`` is float or double.
    """
    kind = segments.schema[id_col].dataType.simpleString()

    def run(it):
        kept: dict[int, list[np.ndarray]] = {}
        for pdf in it:
            rows = []
            for i, rate, x in zip(pdf[id_col], pdf["rate"], pdf["samples"]):
                if rate not in kept:
                    kept[rate] = [mel_filters(rate, n_fft, bands, lo, min(hi, rate / 2), b) for b in breaks]
                x = np.asarray(x if x is not None else [], dtype=np.float64)
                if len(x) == 0:
                    x = np.zeros(1)
                m = np.concatenate([log_mel(x, rate, f, seconds, hop) for f in kept[rate]])
                rows.append((i, m.shape[0], m.shape[1], m.ravel().astype(np.float32 if number == "float" else np.float64)))
            yield pd.DataFrame(rows, columns=[id_col, "n_bands", "n_frames", "features"])

    return segments.select(id_col, "rate", "samples").mapInPandas(run, f"`{id_col}` {kind}, n_bands int, n_frames int, features array<{number}>")


#: Bands in Hz of the bird, the noise below and what is above, by tag; the empty tag is the rule.
BANDS = {"": ((500.0, 5000.0), (0.0, 500.0), (5000.0, 11000.0)), "bittern": ((60.0, 300.0), (300.0, 600.0), (600.0, 11000.0)), "morepork": ((400.0, 1500.0), (0.0, 400.0), (1500.0, 11000.0))}


def band_energy(segments: DataFrame, id_col: str, n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """``id, bird_rms, noise_rms, upper_rms``: energy per frame of three bands that the row's ``tag`` chooses."""
    kind = segments.schema[id_col].dataType.simpleString()

    def run(it):
        for pdf in it:
            rows = []
            for i, rate, x, tag in zip(pdf[id_col], pdf["rate"], pdf["samples"], pdf["tag"]):
                s = spectrogram(np.asarray(x if x is not None else [], dtype=np.float64), n_fft, hop) ** 2
                f = np.fft.rfftfreq(n_fft, 1 / rate)
                rows.append((i, *(np.sqrt(s[(f >= a) & (f < b)].mean(axis=0)).tolist() if ((f >= a) & (f < b)).any() else [0.0] * s.shape[1] for a, b in BANDS.get(tag, BANDS[""]))))
            yield pd.DataFrame(rows, columns=[id_col, "bird_rms", "noise_rms", "upper_rms"])

    return segments.select(id_col, "rate", "samples", "tag").mapInPandas(run, f"`{id_col}` {kind}, bird_rms array<double>, noise_rms array<double>, upper_rms array<double>")


def regions(mask: np.ndarray, min_width: int, min_height: int) -> list[tuple[int, int, int, int]]:
    """Boxes (first frame, frame after the last, first bin, bin after the last) of connected cells, larger than the limits.

    Runs of each frame are joined with runs of the frame before that touch them.
    """
    boxes, last = [], []
    for t in range(mask.shape[1]):
        edge = np.diff(np.concatenate([[0], mask[:, t].astype(np.int8), [0]]))
        now = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            box = None
            for x, y, other in last:
                if x < b and a < y:
                    while other.get("into"):
                        other = other["into"]
                    if box is None:
                        box = other
                    elif box is not other:
                        box.update(t0=min(box["t0"], other["t0"]), t1=max(box["t1"], other["t1"]), f0=min(box["f0"], other["f0"]), f1=max(box["f1"], other["f1"]))
                        other["into"] = box
            if box is None:
                boxes.append(box := {"t0": t, "t1": t + 1, "f0": a, "f1": b})
            box.update(t1=t + 1, f0=min(box["f0"], a), f1=max(box["f1"], b))
            now.append((a, b, box))
        last = now
    return [(x["t0"], x["t1"], x["f0"], x["f1"]) for x in boxes if "into" not in x and x["t1"] - x["t0"] >= min_width and x["f1"] - x["f0"] >= min_height]


def detect_signals(segments: DataFrame, id_col: str, n_fft: int = 1024, hop: int = HOP, frame_times: float = 2.0, bin_times: float = 3.0, min_seconds: float = 0.05, min_hz: float = 100.0) -> DataFrame:
    """``id, start, end, f_lo, f_hi``: connected cells above ``frame_times`` their frame's median and ``bin_times`` their bin's."""
    kind = segments.schema[id_col].dataType.simpleString()

    def run(it):
        for pdf in it:
            rows = []
            for i, rate, x in zip(pdf[id_col], pdf["rate"], pdf["samples"]):
                s = spectrogram(np.asarray(x if x is not None else [], dtype=np.float64), n_fft, hop)
                mask = (s > frame_times * np.median(s, axis=0, keepdims=True)) & (s > bin_times * np.median(s, axis=1, keepdims=True))
                for t0, t1, f0, f1 in regions(mask, max(1, int(min_seconds * rate / hop)), max(1, int(min_hz * n_fft / rate))):
                    rows.append((i, t0 * hop / rate, t1 * hop / rate, f0 * rate / n_fft, f1 * rate / n_fft))
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "f_lo", "f_hi"])

    return segments.select(id_col, "rate", "samples").mapInPandas(run, f"`{id_col}` {kind}, start double, end double, f_lo double, f_hi double")


def mix_noise(signal: Column, noise: Column, snr_db: Column, flip: Column) -> Column:
    """signal + noise scaled to the ratio in dB (arrays of one length), the noise's polarity turned where ``flip``."""
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(a)
    scale = F.when(power(noise) > 0, F.sqrt(power(signal) / (power(noise) * F.pow(F.lit(10.0), snr_db / 10)))).otherwise(F.lit(0.0))
    return let(scale * F.when(flip, -1).otherwise(1), lambda k: F.zip_with(signal, noise, lambda s, n: s.cast("double") + n * k))
