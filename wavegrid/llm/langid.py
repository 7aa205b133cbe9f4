"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavegrid.llm.common import map_arrow, materialize, set_apart, slices

ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
#: Characters scored at once for four languages; fewer with more languages, to bound memory.
STEP = 1 << 19


def _buckets(texts: list[str], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all texts on end and the number of them in each text."""
    parts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    h = np.zeros(len(codes), dtype=np.uint64)
    bad = np.zeros(len(codes), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        shifted = codes[n - 1 :]
        h = h[: len(shifted)] * np.uint64(0x100000001B3) + shifted + np.uint64(n)
        if n > 1:  # n-grams that begin so close to a text's end would reach into the next
            last = ends - n + 1
            bad[last[last >= 0]] = True
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            idx = (mixed >> np.uint64(40)) % np.uint64(n_buckets)
            yield idx[~bad[: len(idx)]].astype(np.int64), np.maximum(lengths - n + 1, 0)


def _steps(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # (buckets, languages)


def fit(docs: DataFrame, n_buckets: int = 1 << 16, max_langs: int = 200) -> Model:
    """Counts over all rows with a text and a ``lang``, summed by language and bucket with partial sums.

    What comes to the driver has at most ``max_langs * (n_buckets + 1)`` rows of 16 bytes, as Arrow columns, whatever the
    input, and the matrix ``4 * max_langs * n_buckets`` bytes (52 MB); more languages are refused, unless a caller
    allows them. Rows whose text or lang is null are left out. Repeated rows count each.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, 1024):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                total = sums.setdefault(lang, np.zeros(n_buckets + 1, dtype=np.int64))
                total[n_buckets] += len(own)
                for i, j in _steps(own, STEP):
                    for idx, _ in _buckets(own[i:j], n_buckets):
                        total[:n_buckets] += np.bincount(idx, minlength=n_buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = map_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "langid-counts")
    langs = sorted(x[0] for x in sums.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    counts, prior = np.zeros((n_buckets, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):  # a column of the matrix at a time
        got = sums.where(F.col("lang") == lang).select("bucket", "n").toArrow()
        b, n = got["bucket"].to_numpy(), got["n"].to_numpy()
        prior[k] = n[b == n_buckets].sum()
        counts[b[b < n_buckets], k] = n[b < n_buckets]
    log_prob = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * n_buckets))
    return Model(langs, np.log(prior / prior.sum()) if langs else prior, log_prob.astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the posterior of that language) to every row; only ``text`` is looked at.

    A null text, a text without a letter, and any text under a model without languages give ``und`` and score 0.
    Ties go to the language first in code-point order. Columns of these names are replaced, others kept
    whatever their names are. The matrix that is broadcast has ``n_buckets`` rows and a column per language, both bounded.
    """
    docs, named = set_apart(docs, {"text": "text"}, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    at = docs.columns.index("text")

    def score(batches):
        m = shared.value
        n_buckets, n_langs = m.log_prob.shape
        step = max(1 << 14, STEP * 4 // max(n_langs, 4))
        for b in slices(batches, 1024):
            texts = b.column(at).to_pylist()
            pred, prob = ["und"] * len(texts), np.zeros(len(texts))
            for i, j in _steps(texts, step) if n_langs else ():
                rows = [k for k in range(i, j) if texts[k] is not None and _LETTER.search(texts[k])]
                if not rows:
                    continue
                total = np.tile(m.prior, (len(rows), 1))
                for idx, sizes in _buckets([texts[k] for k in rows], n_buckets):
                    some = sizes > 0
                    starts = (np.cumsum(sizes) - sizes)[some]
                    if len(starts):
                        total[some] += np.add.reduceat(m.log_prob[idx], starts, axis=0, dtype=np.float64)
                total -= total.max(axis=1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                prob[rows] = p[np.arange(len(rows)), best]
                for k, x in zip(rows, best):
                    pred[k] = m.langs[x]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(prob, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return named(docs.mapInArrow(score, schema))
