"""The numbered queries: thin uses of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The rules of op8.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

_RULES_SQL = " UNION ALL ".join(f"SELECT '{a}' AS action, '{h}' AS rhost, '{p}' AS rpath" for a, h, p in RULES)


@query(
    "op8_url_filter",
    f"""WITH rules AS ({_RULES_SQL}),
    u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    r AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
    m AS (SELECT page_id, host, path, rhost || rpath AS rule, action,
          row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
          FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
    FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.url_filter import filter_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op5_line_dedup",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    d AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    j AS (SELECT k.doc_id, pos, line, (last_doc IS NOT NULL AND k.doc_id <> last_doc) AS gone FROM k LEFT JOIN d USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM j GROUP BY doc_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.line_dedup import apply_keep_runs, line_keep_runs

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = apply_keep_runs(docs, line_keep_runs(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op10_mix_sources",
    r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
    f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS share
          FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, 2.0::DOUBLE * source_size <= weight * share AS is_full FROM f),
    t AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
          ELSE weight * (SELECT arg_min(share, source_size / weight) FROM g WHERE NOT is_full) END AS target FROM g),
    k AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class,
          md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, CAST('0x' || substr(key, 1, 4) AS BIGINT) % 32, size, key, doc_id NULLS LAST) AS n,
          CAST('0x' || substr(md5('11|offset|' || coalesce(source, '(none)')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM k),
    x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.n, r.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
          FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, size * CAST(floor(u + n * rate) - floor(u + (n - 1) * rate) AS BIGINT) AS taken FROM x""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.mixing import mix_sources

    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def langid_model(docs: DataFrame):
    """Fitted on the documents that are not held out: crc32(doc_id as text) mod 5 is not 0."""
    from wavegrid.llm import langid
    from wavegrid.llm.common import held

    return langid.fit(docs.where(~held(F.col("doc_id"), 5, 0)))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm import langid
    from wavegrid.llm.common import held

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid_model(docs))
    return out.select("doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.sstable import tokens_table

    return tokens_table(documents(spark, sf_dir).select("doc_id", "text"), word_tokenizer())


@query("op4_matroska_media")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.common import materialize
    from wavegrid.llm.matroska import digest_media, store_texts

    return digest_media(materialize(store_texts(documents(spark, sf_dir)), "media"))


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.decontaminate import find_contamination

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), items)
    ids = F.array_join("item_ids", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.suffix_dedup import remove_repeats

    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_pitman_yor")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.common import held
    from wavegrid.llm.pitman_yor import score_texts

    docs = documents(spark, sf_dir).select("doc_id", "text", held(F.col("doc_id"), 7, 2).alias("held_out"))
    return score_texts(docs, "held_out").drop("text")


#: crc32 of the id's decimals, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_prepend(ascii(c)::BIGINT + 256, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0])))),
    lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

_PART = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{0}")) + ")"


@query(
    "op11_merkle_manifest",
    f"""WITH RECURSIVE s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM documents GROUP BY source),
    d AS (SELECT *, {_LEAF.format('text')} AS leaf,
          CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
    l AS MATERIALIZED (SELECT d.doc_id, leaf, tampered, tree, n, row_number() OVER (PARTITION BY tree ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS pos
          FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
    up AS (SELECT tree, 0 AS level, pos, n, leaf AS hash FROM l
           UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n),
    sub AS MATERIALIZED (SELECT tree, hash FROM up WHERE n = 1),
    top AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM sub) AS n, hash FROM sub
            UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
    node AS MATERIALIZED (SELECT tree, level, pos, hash, n FROM up WHERE n > 1 UNION ALL SELECT -1, level, pos, hash, n FROM top),
    run AS MATERIALIZED (SELECT tree, level, pos // 16 AS pos, string_agg(hash, '' ORDER BY pos) AS kids FROM node WHERE n > 1 GROUP BY tree, level, pos // 16),
    lift AS (SELECT row_number() OVER () AS k, doc_id, leaf, tree AS home, coalesce(tampered, leaf) AS f, '' AS proof,
                    CASE WHEN n > 1 THEN tree ELSE -1 END AS tree, 0 AS level, CASE WHEN n > 1 THEN pos ELSE tree END AS pos, n FROM l
             UNION ALL
             SELECT k, doc_id, leaf, home, sha256(substr(kids, 1, (c.pos % 16) * 64) || f || substr(kids, (c.pos % 16) * 64 + 65)),
                    proof || substr(kids, 1, (c.pos % 16) * 64) || substr(kids, (c.pos % 16) * 64 + 65),
                    CASE WHEN c.tree >= 0 AND (c.n + 15) // 16 = 1 THEN -1 ELSE c.tree END,
                    CASE WHEN c.tree >= 0 AND (c.n + 15) // 16 = 1 THEN 0 ELSE c.level + 1 END,
                    CASE WHEN c.tree >= 0 AND (c.n + 15) // 16 = 1 THEN c.home ELSE c.pos // 16 END, (c.n + 15) // 16
             FROM lift c JOIN run ON run.tree = c.tree AND run.level = c.level AND run.pos = c.pos // 16),
    done AS (SELECT doc_id, leaf, home, f, proof FROM lift QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(proof) DESC, tree) = 1)
    SELECT doc_id, leaf, sub.hash AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
    FROM done JOIN sub ON sub.tree = done.home, (SELECT hash AS root FROM top WHERE n = 1)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.merkle import manifest

    out = manifest(documents(spark, sf_dir))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def _found(text: str, kind: str, number: int, pattern: str, value: int, least: int) -> str:
    """Matches of a pattern with their places, one a row."""
    return f"""SELECT k, {number} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop, value FROM (
        SELECT k, hit, value, CAST(sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT k, unnest(string_split_regex({text}, '{pattern}')) AS gap, unnest(regexp_extract_all({text}, '{pattern}', 0)) AS hit,
              unnest(regexp_extract_all({text}, '{pattern}', {value})) AS value, unnest(range(len(string_split_regex({text}, '{pattern}')))) AS i FROM t)
        WHERE hit IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE length(value) >= {least}"""


_STEPS = f"""list_transform(range(1, length(token) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE instr('{_ALPHABET}', token[i - 1]) END * 67 + instr('{_ALPHABET}', token[i]))"""


@query(
    "op13_secret_scan",
    f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
          list_aggregate(list_transform(list_zip(string_split_regex(coalesce(text, ''), '{_ASSIGN}'), regexp_extract_all(coalesce(text, ''), '{_ASSIGN}')),
            lambda z: z[1] || coalesce(repeat(' ', length(z[2])), '')), 'string_agg', '') AS rest FROM documents),
    base AS MATERIALIZED ({_found("text", "assign", 0, _ASSIGN, 2, 6)}
          UNION ALL {_found("text", "access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_found("text", "hex", 2, "[0-9a-f]+", 0, 24)}),
    sample AS MATERIALIZED (SELECT token, bool_or(secret) AS secret FROM (
          SELECT unnest(regexp_extract_all(value, '[A-Za-z0-9+/_-]{{8,}}')) AS token, true AS secret FROM base
          UNION ALL SELECT token, false FROM (SELECT unnest(regexp_extract_all(rest, '[A-Za-z0-9+/_-]{{8,}}')) AS token FROM t)
          WHERE NOT regexp_matches(token, 'AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}')) GROUP BY token),
    n AS (SELECT step, count(*) FILTER (secret) AS n1, count(*) FILTER (NOT secret) AS n0 FROM (SELECT secret, unnest({_STEPS}) AS step FROM sample) GROUP BY step),
    pair AS (SELECT r.step, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0 FROM (SELECT unnest(range(67 * 67)) AS step) r LEFT JOIN n ON n.step = r.step WHERE r.step % 67 > 0),
    w AS MATERIALIZED (SELECT step, ln(0.5::DOUBLE * (n1 + 0.5::DOUBLE) / (sum(n1) OVER b + 33.0::DOUBLE) + 0.5::DOUBLE / 66) - ln((n0 + 0.5::DOUBLE) / (sum(n0) OVER b + 33.0::DOUBLE)) AS w
          FROM pair WINDOW b AS (PARTITION BY step // 67)),
    cand AS MATERIALIZED (SELECT k, rank, kind, start, stop, value AS token FROM ({_found("rest", "markov", 3, "[A-Za-z0-9+/_-]{{16,}}".replace("{{", "{").replace("}}", "}"), 0, 16)})
          WHERE NOT regexp_matches(value, 'AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}') AND len(list_distinct(string_split(value, ''))) >= 8),
    scored AS (SELECT k, rank, kind, start, stop FROM (SELECT *, unnest({_STEPS}) AS step FROM cand) c JOIN w USING (step) GROUP BY ALL HAVING sum(w) >= 12),
    every AS (SELECT k, rank, kind, start, stop FROM base UNION ALL SELECT * FROM scored)
    SELECT any_value(doc_id) AS doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
      coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
    FROM t LEFT JOIN every USING (k) GROUP BY k""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavegrid.llm.secrets import find_secrets, listed, secrets_model

    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = [F.col(c) for c in ("assign", "access", "hex")]
    out = find_secrets(docs, secrets_model(docs))
    counts = [F.size(c).cast("long").alias(n) for c, n in zip(base, ("n_assign", "n_access", "n_hex"))]
    return out.select("doc_id", *counts, F.sha2(listed(*base).cast("binary"), 256).alias("base_sha256"), listed(*base, F.col("markov")).alias("spans"))
