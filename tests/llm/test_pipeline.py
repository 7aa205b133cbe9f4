"""The pipeline's stages, each on its own input, against plain restatements."""

import re

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from test_operators import SF, docs_of, empty, jaccard_by_pairs, low, q, sha, tables  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark, tables):  # noqa: F811
    """Input and output of each stage over the awkward rows."""
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in p.STAGES:
        after = p.materialize(stage(spark, docs, tables), "step")
        out[name] = (docs, after)
        docs = after
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_return_the_columns_of_documents(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == p.COLUMNS and after.count() <= 2 * before.count(), name


def test_language_id_drops_texts_without_letters_only(steps):
    before, after = steps["language_id"]
    assert pairs(after) == sorted(((i, t) for i, t in pairs(before) if t and re.search(r"[^\W\d_]", t)), key=repr)


def test_one_of_each_class_stays(steps):
    before, after = steps["near_duplicates"]
    docs = pairs(before)
    keep = {i for i, _, c in jaccard_by_pairs(docs) if i == c}
    want = sorted({(i, t) for i, t in docs if i is not None and i in keep}, key=repr) + [d for d in docs if d[0] is None]
    assert pairs(after) == sorted(want, key=repr)
    assert len(want) < len(docs)


def test_benchmark_passages_are_cut(steps, spark, tables):  # noqa: F811
    before, after = steps["benchmark_decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = set()
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    hit = lambda t: any(tuple(words(t)[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(words(t)) - n + 1))
    old, new = {i: t for i, t in pairs(before)}, {i: t for i, t in pairs(after)}
    assert {i: t for i, t in old.items() if not hit(t)} == {i: t for i, t in new.items() if not hit(old[i])}
    assert any(hit(t) for t in old.values()) and all(len(words(new[i])) < len(words(t)) for i, t in old.items() if hit(t) and i in new)
    assert after.where("n_chars <> char_length(text)").count() == 0


def test_mix_repeats_documents(steps):
    before, after = steps["source_mixing"]
    mixed = p.mix_sources(before).select("doc_id", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    assert pairs(after) == pairs(mixed)


def test_shards_hold_what_came(steps):
    before, after = steps["token_shards"]
    assert after.count() == before.count()
    rows = sorted(tuple(r) for r in after.select("start", "n_tokens").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_pipeline_runs_on_tables_and_on_nothing(spark, empty):  # noqa: F811
    assert p.run(spark, SF).count() > 100
    assert p.run(spark, empty).count() == 0
