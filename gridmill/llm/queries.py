"""The queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, vocabulary
from .bpe import encode_decode
from .centroids import K, ROUNDS, cluster
from .exact_dedup import exact_dedup
from .licenses import scan as license_scan
from .linear import quality_model, score, toxicity_model
from .lm_scoring import lm_scores, split
from .near_dedup import near_dedup
from .packing import pack
from .quality_rules import quality_rules
from .secrets import scan
from .spelling import spelling_variants
from .token_counts import rolled_up


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=3, percent=85)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), split())


def _judged(spark: SparkSession, sf_dir: str, fitter, n: int, remainder: int) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod(F.col("doc_id"), n) == remainder
    model = fitter(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, quality_model, 4, 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, toxicity_model, 3, 1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "rules.*")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets.*").drop("found")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_up(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_values=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "licenses.*").drop("found")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_secrets": op7_secrets,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_licenses": op12_licenses,
    "op13_centroids": op13_centroids,
}

def _rounds_in_sql() -> str:
    """CTEs c1, c2 ... (c, z): the centroids after each update; a1, a2 ... are the assignments before it."""
    near = "SELECT r, any_value(vec_id) AS vec_id, any_value(v.z) AS z, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, vec_id, v.z, c, list_sum(list_transform(list_zip(v.z, k.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {k} k) v GROUP BY r"
    parts = []
    for n in range(ROUNDS + 1):
        parts.append(f"a{n + 1} AS MATERIALIZED ({near.format(k=f'c{n}')})")
        if n < ROUNDS:
            sums = f"SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(z) AS x, unnest(range(64)) AS i FROM a{n + 1}) GROUP BY c, i"
            new = f"SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS z FROM ({sums}) GROUP BY c"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.z, o.z) AS z FROM c{n} o LEFT JOIN ({new}) w USING (c))")
    return ", ".join(parts)


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op8_token_counts": r"""
        WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents),
             gone AS (SELECT doc_id FROM d WHERE w < 5),
             k AS (SELECT *, length(t) > 2000 AND doc_id IS NOT NULL AS long FROM d WHERE doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL) OR doc_id IS NULL),
             u AS (SELECT CASE WHEN long THEN source || '/long' ELSE source END AS source, lang, 'words-1' AS version,
                          CASE WHEN long THEN len(regexp_extract_all(t, '[^\x20\x09-\x0D][^\x20\x09-\x0D]+')) ELSE w END AS n FROM k
                   UNION ALL
                   SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM k)
        SELECT source, lang, version, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM u GROUP BY ALL
    """,
    # crc32 byte by byte, with its table made from the polynomial; letters beyond ASCII are two bytes, C3 and theirs.  Near words meet under
    # a deletion, or the word itself, at the same place.
    "op11_spelling_variants": r"""
        WITH RECURSIVE
             tab AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
             runs AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
             told AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS k FROM runs GROUP BY ALL),
             coded AS (SELECT run, k, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)) AS bytes FROM told),
             hashed AS MATERIALIZED (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM coded, tab),
             cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed),
             w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
             del AS MATERIALIZED (SELECT DISTINCT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS d, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
             pairs AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
                       UNION SELECT a.word, w.word, w.n FROM del a JOIN w ON a.d = w.word
                       UNION SELECT w.word, a.word, a.n FROM del a JOIN w ON a.d = w.word),
             best AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-m, y)) AS y, max(m) AS m FROM pairs GROUP BY x),
             f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
             up AS (SELECT word, word AS now, 0 AS steps FROM f UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.now WHERE f.form IS NOT NULL)
        SELECT word, form, (SELECT arg_max(now, steps) FROM up WHERE up.word = f.word) AS root, n, n_near, form_n FROM f
    """,
    "op13_centroids": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS z FROM embeddings
                                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, z FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, z FROM v ORDER BY h LIMIT {K})),
             {_rounds_in_sql()}
        SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(list_aggregate(k.z, 'string_agg', ',')) AS centroid_sha256
        FROM a{ROUNDS + 1} a JOIN c{ROUNDS} k USING (c)
    """,
}
