"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, all in Spark's own functions.

Two multinomials over ``buckets`` hashed word n-grams (unigrams and bigrams) are counted over the whole
table: the raw corpus, and the trusted target, which is every document that passes the strict ``TRUST``
rules.  A document's score is the mean over its n-grams of log(p_target / p_raw).  It is kept
if the base rules pass and the score reaches ``threshold``; there is no sampling.

Defined cases: null counts as empty text.  A document without words has score 0 and fails the base rules.
If no document is trusted, all scores are 0 and the base rules alone decide.  Rows
are scored one by one, so repeated rows, ties and null ids need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, WORD, fresh, text_or_empty

BUCKETS = 8192
THRESHOLD = -0.04
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _tail(x: Column, n: int, size: Column) -> Column:
    """The array without its first ``n`` items; ``size`` is the array's size."""
    return F.slice(x, F.lit(n + 1), F.greatest(size - n, F.lit(0)))


def _paired(x: Column, step: int, size: Column) -> Column:
    """Hashes of x[i], x[i+step] for all i where both exist."""
    left = F.slice(x, F.lit(1), F.greatest(size - step, F.lit(0)))
    return F.zip_with(left, _tail(x, step, size), lambda a, b: F.xxhash64(a, b))


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a struct column of base counts and hashed n-grams; its name is the frame's last column."""
    out = fresh("_base", docs)
    words, h, n = (fresh(x, docs) for x in ("_words", "_h1", "_n"))
    text = text_or_empty(text_col)
    df = docs.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w))).withColumn(n, F.size(words))
    n_, h_ = F.col(n), F.col(h)
    two, four, eight = (fresh(x, docs) for x in ("_h2", "_h4", "_h8"))
    df = df.withColumn(two, _paired(h_, 1, n_))
    df = df.withColumn(four, _paired(F.col(two), 2, F.size(two)))
    df = df.withColumn(eight, _paired(F.col(four), 4, F.size(four)))
    win = F.col(eight)
    # Positions of windows that occur twice or more: sort (hash, position) and look at both neighbours.
    ordered = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs, at = fresh("_pairs", docs), fresh("_at", docs)
    df = df.withColumn(pairs, F.when(F.size(F.array_distinct(win)) < F.size(win), ordered))
    p = F.col(pairs)
    again = F.zip_with(_tail(p, 1, F.size(p)), F.slice(p, F.lit(1), F.size(p) - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    df = df.withColumn(at, F.when(p.isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.array_compact(again))))))
    a = F.col(at)
    gaps = F.zip_with(_tail(a, 1, F.size(a)), F.slice(a, F.lit(1), F.size(a) - 1), lambda x, y: F.least(x - y, F.lit(WINDOW)))
    repeats = F.when(a.isNull(), 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    chars = F.length(F.regexp_replace(text, SPACE, ""))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    made = F.struct(
        n_.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        h_.alias("h1"),
        F.col(two).alias("h2"),
    )
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(out))


def failed(base: Column) -> Column:
    return (base.n_words < MIN_WORDS) | (100 * base.n_repeat_words > MAX_REPEAT_PERCENT * base.n_words)


def trusted(base: Column) -> Column:
    """The rules that make a document part of the target."""
    return ~failed(base) & (base.n_words >= 40) & (100 * base.n_symbols <= base.word_chars) & (base.n_dup_lines == 0) & (100 * base.n_repeat_words <= 5 * base.n_words)


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ratio_table(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> list[float]:
    """log(p_target / p_raw) of each bucket, over all documents.  The driver gets ``buckets`` rows of counts."""
    df = counted(docs, text_col)
    base = F.col(df.columns[-1])
    grams = df.select(trusted(base).alias("good"), F.explode(F.concat(base.h1, base.h2)).alias("h"))
    rows = grams.groupBy(bucket(F.col("h"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    total = rows.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    smooth = lambda c, n: (F.col(c) + 1) / (F.col(n) + buckets)
    log_ratio = F.when(F.col("n_target") > 0, F.log(smooth("target", "n_target") / smooth("raw", "n_raw"))).otherwise(0.0)
    table = [0.0] * buckets
    for b, x in rows.crossJoin(F.broadcast(total)).select("b", log_ratio).collect():  # at most `buckets` rows
        table[b] = round(x, 6)
    return table


def quality_rules(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one more struct column, the last: base counts, base_failed, score and kept."""
    table = ratio_table(docs, text_col, buckets)
    ratios = F.from_json(F.lit(str(table)), "array<double>")
    df = counted(docs, text_col)
    base = F.col(df.columns[-1])
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.get(ratios, bucket(x, buckets)))
    n = F.size(base.h1) + F.size(base.h2)
    score = F.when(n > 0, (total(base.h1) + total(base.h2)) / n).otherwise(0.0)
    out = fresh("rules", docs)
    counts = [base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    df = df.withColumn(out, F.struct(*counts, failed(base).alias("base_failed"), score.alias("score")))
    r = F.col(out)
    df = df.withColumn(out, r.withField("kept", ~r.base_failed & (r.score >= threshold)))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], out)
