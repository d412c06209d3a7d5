"""Spelling variants: words one edit apart, grouped by rolling-hash deletions.

1.  Runs of letters become words, some with one letter taken out by a hash of document and run, and are counted: an explode and a
    grouped sum, so Spark combines on the map side and a hot word costs a row a task.
2.  Every word gives integer keys: the hash of the word itself and of the word without one letter, once for each run of equal
    letters.  With prefix and suffix sums of a polynomial modulo 2**64 a deletion's hash is prefix + suffix / P, so all
    keys of a block of words are a few numpy steps, and no string with a letter less is ever built.
3.  Keys are dealt by their top 16 bits and sorted by (key, place).  In a group of equal keys stand one whole word at most and the
    deletions that give it, with the places that the letter may have been at.  Two deletions whose places meet differ by one replaced
    letter; the whole word and any deletion by an inserted one.  A scan over neighbours finds exactly these, each pair once,
    and a group has no more members than (letters + 1) * alphabet, whatever the corpus.
4.  Strings decide: a pair counts only if its edit distance is one, so equal hashes of different strings do no harm.
5.  A word's form is its most frequent near word if that has ten times its occurrences, and its root is found by following forms, two steps
    for one a round; counts grow tenfold a step, so there are few rounds.

Defined cases: null text has no words, and a null id counts as the empty text in the hash.  Repeated rows count again.  Of near words with equal counts
the first in code-point order is the form.  An empty table, or one without words that occur twice, gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty, tidied, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = "[A-Za-zÀ-ÿ]"
#: The shortest word, its least occurrences, and by how much a form must be more frequent.
LEAST, TWICE, TIMES = 7, 2, 10
#: One run in so many loses a letter.
THINNED = 31
RADIX_BITS = 16
#: Letters of the words that one numpy step handles at once.
BLOCK = 1 << 18


def thinned(document: Column, run: Column) -> Column:
    """``run``, or without the letter at h % length where ``THINNED`` divides h, the crc32 of document and run."""
    h = F.crc32(F.concat(document, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % THINNED == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n) of all words with at least ``least`` letters and ``TWICE`` occurrences.

    A run shorter than that can't become such a word, so only longer ones are looked up.
    """
    lowered = F.translate(text_or_empty(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTER}{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    counted = found.select(thinned(F.col("d"), F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least) & (F.col("n") >= TWICE))


def deletion_keys(words: list[str]):
    """(key, word's place in ``words``, span) of each word and of its distinct deletions, as int64 arrays.

    A span is the first place of the deleted letter in the upper half and the last one in the lower; the word itself has -1 and the largest.
    """
    import numpy as np

    from ._vector import P, P_INVERSE, U, mixed

    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    end = np.cumsum(size)
    start = end - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[of]
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=U), np.full(int(size.max(initial=0)), P, dtype=U))))
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mixed(letters.astype(U) * U(P) + U(1)) * powers[place])))
    tagged = lambda h, n: mixed(h + n.astype(U) * U(0x632BE59BD9B4E019)).view(np.int64)
    whole = tagged(total[end] - total[start], size)
    # Of a run of equal letters the first stands for all: taking out any of them gives the same string.
    first = np.flatnonzero((place == 0) | (np.diff(letters, prepend=0) != 0))
    past = np.append(first[1:], len(letters))
    w = of[first]
    prefix = total[first] - total[start[w]]
    suffix = total[end[w]] - total[first + 1]
    gone = tagged(prefix + suffix * U(P_INVERSE), size[w] - 1)
    key = np.concatenate((whole, gone))
    node = np.concatenate((np.arange(len(words)), w))
    span = np.concatenate((np.full(len(words), (-1 << 32) | 0x7FFFFFFF), place[first] << 32 | (place[first] + past - first - 1)))
    return key, node, span


def close_pairs(key, node, span):
    """(a, b) of the nodes with equal keys whose spans meet; the arrays are sorted by key, then span."""
    import numpy as np

    first, last = span >> 32, span & 0xFFFFFFFF
    at, step, left, right = np.arange(len(key)), 1, [], []
    while len(at):
        at = at[at + step < len(key)]
        to = at + step
        at = at[(key[to] == key[at]) & (first[to] <= last[at])]
        left.append(node[at])
        right.append(node[at + step])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (node[:0], node[:0])


def _keyed(words: DataFrame) -> DataFrame:
    """(key, node, span) of ``words`` (node, word)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]) if len(ends) else 0, BLOCK))
            for low, high in zip([0, *(cuts + 1)], [*(cuts + 1), batch.num_rows]):
                if low < high:
                    part = batch.slice(low, high - low)
                    key, at, span = deletion_keys(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column(0).to_numpy()[at]), pa.array(span)], names=["key", "node", "span"])

    return words.select("node", "word").mapInArrow(tidied(run), "key long, node long, span long")


def near_candidates(words: DataFrame) -> DataFrame:
    """(a, b): each pair of ``words`` (node, word) that is one edit apart, once, but for colliding hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        for batch in chain(batches, [None]):
            if batch is None:
                ready = held
            else:
                now = tuple(np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held))
                closed = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last group may go on
                ready, held = tuple(x[:closed] for x in now), tuple(x[closed:] for x in now)
            a, b = close_pairs(*ready)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    dealt = _keyed(words).repartition(radix).sortWithinPartitions("key", "span")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def _roots(forms: DataFrame) -> DataFrame:
    """(node, root) from ``forms`` (node, up): where following ``up`` ends."""
    now = written(forms.select("node", "up"))
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("above"))
        now = written(now.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("node", F.col("up").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row for each word of ``docs``: word, form, root, n, n_near, form_n."""
    # Numbered as they are written: a later pass reads the same numbers.
    words = written(word_counts(docs, id_col, text_col, least).withColumn("node", F.monotonically_increasing_id()))
    side = lambda x: words.select(F.col("node").alias(x), F.col("word").alias(f"w{x}"), F.col("n").alias(f"n{x}"))
    pairs = near_candidates(words).join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("wa", "wb", 1) == 1)
    told = lambda x, y: F.struct(F.col(x).alias("node"), F.struct((-F.col(f"n{y}")).alias("less"), F.col(f"w{y}").alias("word"), F.col(y).alias("up")).alias("by"))
    both = pairs.select(F.explode(F.array(told("a", "b"), told("b", "a"))).alias("x")).select("x.*")
    near = both.groupBy("node").agg(F.count(F.lit(1)).alias("n_near"), F.min("by").alias("by"))
    formed = -F.col("by.less") >= times * F.col("n")  # null, so no form, without near words
    facts = [F.when(formed, x).alias(name) for x, name in ((F.col("by.word"), "form"), (-F.col("by.less"), "form_n"), (F.col("by.up"), "up"))]
    told_all = written(words.join(near, "node", "left").select("node", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *facts))
    roots = _roots(told_all.where("up IS NOT NULL"))
    names = words.select(F.col("node").alias("root"), F.col("word").alias("_root"))
    ended = roots.join(names, "root").select("node", "_root")
    return told_all.join(ended, "node", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
