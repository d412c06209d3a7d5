"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A word belongs to one of ``GROUPS * CLASSES`` classes by the bucket of its last three bytes; the end of a text is a class of its own.  The
model is

    P(w | h) = P(group(w) | h) * P(class(w) | group, h) * P(w | class, h)

with a softmax on each level.  The last one is over the class's most frequent words and a remainder, which
is shared out in proportion to smoothed counts, one unseen word included, so each counted word has its place.  Features of the history h:
the last word, the last two, the word before the last (a skip), the same with classes, the groups of the last four words, and a
constant; each is hashed to a row of weights.

1.  Words are counted over all training documents (a shuffle by 64-bit word hash), and so are pairs of a word's bucket and
    its predecessor's.  Buckets that follow alike buckets form the groups, and in each group the classes (weighted k-means of 2048 rows).
2.  Training passes over all training documents in ``ROUNDS`` disjoint parts, dealt to shards by a hash.  Each shard takes Adagrad steps on
    minibatches from the common weights, and hands back each row's change with its evidence, the squared gradients it has
    seen.  A grouped aggregate merges them: where the evidence is large the result is its weighted mean, and where each
    shard saw little it is the sum, so what more shards see counts as more.
3.  Scoring adds up log-probabilities in numpy.  Counts of at most ``HEAD`` frequent words travel with the model;
    the other words of each text meet their counts in a join, so nothing of the corpus' size passes the driver.

The weight tables have ``ROWS`` rows, a parameter: it is what every shard of the training holds and hands back, and a shard
has about ``TASK_TOKENS`` tokens where there are as many.  Rows equal in id and text are in one shard, read as a stream.

Defined cases: null counts as empty text, which is the end token alone.  Null ids count as the empty text in the
split.  Repeated rows are counted as often as they occur and get equal scores.  An empty table gives an empty result.  Without training rows all
counts are 0 and the weights stay 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, sliced, text_or_empty, tidied, written

BUCKETS = 2048
CONTEXTS = 256
GROUPS = 16
CLASSES = 16  # of a group
OUTCOMES = 16  # of a class: its most frequent words and the remainder
LEVELS = 3
ROWS = (1 << 16, 1 << 15, 1 << 15)  # of each level; powers of two, as BUCKETS is
HEAD = 200_000
ROUNDS = 2
FIRST, BATCH = 512, 100_000  # tokens of the first minibatches, and of the largest, about a block
TASK_TOKENS = 2_000_000
RATE = 0.4
PRIOR = 8.0
END, START = 11, 13
PAIR = -1  # stands for the bucket in rows that count pairs
OFF = -1e4


@dataclass
class Vocabulary:
    """Totals, the classes, and the frequent words: keys ascending, their counts, and each one's place in its class (or -1)."""

    n: int
    v: int
    keys: object
    counts: object
    place: object
    of_bucket: object  # class of each bucket; the end's comes last and is 0
    rest: object  # by class: log10 of (tokens outside the class's own words + half their number, and a half)
    masks: list  # by level: 0 where a choice exists, else OFF


def _tokens(data: bytes, starts):
    """(key, bucket, document) of each token of a block, ends included."""
    import numpy as np

    from ._vector import U, mixed, word_hashes

    h, first, end = word_hashes(data)
    a = np.frombuffer(data, dtype=np.uint8)
    doc = np.searchsorted(starts, first, side="right") - 1
    size = np.bincount(doc, minlength=len(starts)) + 1
    key = np.full(len(h) + len(starts), END, dtype=np.int64)
    bucket = np.full(len(key), BUCKETS, dtype=np.int64)
    at = np.arange(len(h)) + doc
    key[at] = h.view(np.int64)
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += U(32)
    if len(h):
        ending = np.zeros(len(h), dtype=np.uint64)
        for k in (3, 2, 1):
            ending = ending * U(257) + np.where(end - first >= k, low[a[np.maximum(end - k, 0)]], U(0))
        bucket[at] = (mixed(ending + U(1)) & U(BUCKETS - 1)).astype(np.int64)
    return key, bucket, np.repeat(np.arange(len(starts)), size)


def _history(key, kind, doc):
    """Hashed features of each token's history, by name; rows of weights are made of them by level."""
    import numpy as np

    from ._vector import P, U, mixed

    new = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)

    def shifted(x, fill):
        out = np.concatenate((x[:1], x[:-1]))
        out[new] = fill
        return out

    w1 = shifted(key.view(np.uint64), U(START))
    w2 = shifted(w1, U(START))
    c1 = shifted(kind.astype(np.uint64), U(GROUPS * CLASSES))
    c2 = shifted(c1, U(GROUPS * CLASSES))
    g = [c1 // U(CLASSES), c2 // U(CLASSES)]
    for _ in range(2):
        g.append(shifted(g[-1], U(GROUPS)))
    groups = ((g[0] * U(32) + g[1]) * U(32) + g[2]) * U(32) + g[3]
    raw = (w1, w1 * U(P) + w2, w2 * U(3), c1, c1 * U(512) + c2, groups)
    hashed = [(mixed(x * U(8) + U(k + 1) + (x >> U(61))) & U((1 << 40) - 1)).view(np.int64) for k, x in enumerate(raw)]
    out = np.zeros((len(key), len(hashed) + 1), dtype=np.int64)
    for k, x in enumerate(hashed):
        out[:, k] = x
    return out


#: The features of each level: groups by all, classes without the word pair and the skip, words without groups and the skip.
FEATURES = ([0, 1, 2, 3, 4, 5, 6], [0, 3, 4, 5, 6], [0, 1, 3, 6])


def _rows(history, level: int, given):
    """Rows of weights (n, features) of a level; ``given`` is what the levels above chose."""
    import numpy as np

    rows = history.take(FEATURES[level], 1)
    if level:
        rows += (given[:, None] + 1) * 2_097_169
    return np.bitwise_and(rows, ROWS[level] - 1, out=rows)


def _levels(words: Vocabulary, kind, place):
    """(level, which tokens, given, target) of each softmax; the end has the first alone."""
    import numpy as np

    word = np.flatnonzero(kind > 0)
    return ((0, slice(None), np.zeros(len(kind), dtype=np.int64), kind // CLASSES), (1, word, kind[word] // CLASSES, kind[word] % CLASSES), (2, word, kind[word], place[word]))


def _softmax(weights, rows, mask):
    import numpy as np

    z = weights.take(rows[:, 0], 0)
    z += mask
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], 0)
    np.minimum(z, 60, out=z)  # weights stay far below; a float's exponential must not overflow
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], dtype=z.dtype)))[:, None]
    return z


def _step(weights, squares, seen, rows, target, mask, rate):
    """One Adagrad step on a minibatch; ``squares`` has a row for each outcome."""
    import numpy as np

    g = _softmax(weights, rows, mask)
    g[np.arange(len(g)), target] -= 1
    by_outcome, at = np.ascontiguousarray(g.T, dtype=np.float64), rows.T.ravel()
    seen[at] = True
    change = np.empty_like(squares)
    spread = np.empty((rows.shape[1], len(rows)))  # one buffer: a new array for each outcome costs more than the counting
    for c, x in enumerate(by_outcome):
        spread[:] = x
        change[c] = np.bincount(at, spread.ravel(), len(weights))
    squares += change * change
    change /= np.sqrt(squares)
    change *= rate
    weights -= change.T


def _places(vocabulary: Vocabulary, key):
    """(index among the frequent words or -1) of each key."""
    import numpy as np

    if not len(vocabulary.keys):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
    return np.where(vocabulary.keys[at] == key, at, -1)


def _outcomes(vocabulary: Vocabulary, at):
    import numpy as np

    if not len(vocabulary.keys):
        return np.full(len(at), OUTCOMES - 1)
    return np.where(at >= 0, vocabulary.place[at], OUTCOMES - 1)


def grouped(pairs, size: int, least: float = 50.0):
    """The class of each bucket from counts of (bucket, context): groups of buckets that follow alike contexts, and classes within; 0 is kept for the end."""
    import numpy as np

    total = pairs.sum(1, keepdims=True)
    mean = (pairs.sum(0) + 1e-9) / (pairs.sum() + 1e-9 * pairs.shape[1])
    x, weight = np.sqrt((pairs + least * mean) / (total + least)), total[:, 0] + 1e-3

    def parted(rows, k):
        """k-means from the heaviest row and those farthest from what is chosen, by weight."""
        centres = [x[rows[np.argmax(weight[rows])]]]
        far = np.full(len(rows), np.inf)
        while len(centres) < min(k, len(rows)):
            far = np.minimum(far, ((x[rows] - centres[-1]) ** 2).sum(1))
            centres.append(x[rows[np.argmax(far * weight[rows])]])
        centres = np.array(centres)
        for _ in range(20):
            near = np.argmax(x[rows] @ centres.T - 0.5 * (centres**2).sum(1), 1)
            for c in range(len(centres)):
                own = rows[near == c]
                if len(own):
                    centres[c] = np.average(x[own], axis=0, weights=weight[own])
        return near

    every, out = np.arange(size), np.zeros(size + 1, dtype=np.int64)
    group = parted(every, GROUPS - 1) + 1
    for g in range(1, GROUPS):
        own = every[group == g]
        if len(own):
            out[own] = g * CLASSES + parted(own, CLASSES)
    return out


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, bucket, c) of every distinct token of ``docs``; rows whose bucket is ``PAIR`` count pairs of a word's bucket and its context."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ._vector import blocks

        pairs = np.zeros(BUCKETS * CONTEXTS, dtype=np.int64)
        made = lambda key, bucket, c: pa.RecordBatch.from_arrays([pa.array(key), pa.array(bucket), pa.array(c)], names=["key", "bucket", "c"])
        for batch in sliced(batches, 2048):
            for data, starts in blocks(x.as_py() or b"" for x in batch.column(0).cast(pa.binary())):
                key, bucket, doc = _tokens(data, starts)
                keys, at, n = np.unique(key, return_index=True, return_counts=True)
                both = (bucket[1:] < BUCKETS) & (bucket[:-1] < BUCKETS) & (doc[1:] == doc[:-1])
                pairs += np.bincount((bucket[1:] * CONTEXTS + bucket[:-1] * CONTEXTS // BUCKETS)[both], minlength=len(pairs))
                yield made(keys, bucket[at], n)
        at = np.flatnonzero(pairs)
        yield made(at, np.full(len(at), PAIR), pairs[at])

    counted = docs.select(text_or_empty(text_col)).mapInArrow(tidied(run), "key long, bucket long, c long")
    return counted.groupBy("key", "bucket").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Totals, classes and frequent words; at most ``head`` rows, BUCKETS * CONTEXTS pairs and a histogram reach the driver."""
    import numpy as np

    pairs = np.zeros(BUCKETS * CONTEXTS)
    found = counts.where(F.col("bucket") == PAIR).select("key", "c").toArrow()
    pairs[found["key"].to_numpy()] = found["c"].to_numpy()
    of_bucket = grouped(pairs.reshape(BUCKETS, CONTEXTS), BUCKETS)

    counts = counts.where(F.col("bucket") != PAIR)
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred rows
    least, room = 0, head
    for b, n in sorted(map(tuple, bins), reverse=True):
        if n > room:
            least = b + 1
            break
        room -= n
    frequent = counts.where(step >= least).toArrow().to_pandas().sort_values(["c", "key"], ascending=[False, True])
    kind = of_bucket[frequent["bucket"].to_numpy(np.int64)]
    rank = frequent.groupby(kind).cumcount().to_numpy() if len(frequent) else np.zeros(0, dtype=np.int64)
    place = np.where(rank < OUTCOMES - 1, rank, OUTCOMES - 1)

    every = GROUPS * CLASSES
    n, v = np.zeros(every), np.zeros(every)
    total = [0, 0]
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row a bucket
        n[of_bucket[r["bucket"]]] += r["n"]
        v[of_bucket[r["bucket"]]] += r["v"]
        total = [total[0] + r["n"], total[1] + r["v"]]
    own = place < OUTCOMES - 1
    n -= np.bincount(kind[own], frequent["c"].to_numpy(float)[own], every)
    v -= np.bincount(kind[own], minlength=every)

    there = np.zeros(every, dtype=bool)
    there[of_bucket] = True
    held = np.bincount(kind[own], minlength=every)
    choice = there.reshape(GROUPS, CLASSES)
    places = np.arange(OUTCOMES)[None, :]
    masks = [np.where(x, 0, OFF).astype(np.float32) for x in (choice.any(1)[None, :], choice, (places < held[:, None]) | (places == OUTCOMES - 1))]
    order = np.argsort(frequent["key"].to_numpy())
    return Vocabulary(*total, frequent["key"].to_numpy()[order], frequent["c"].to_numpy()[order], place[order], of_bucket, np.log10(n + 0.5 * (v + 1)), masks)


def train(docs: DataFrame, part: Column, words: Vocabulary, text_col: str, rounds: int = ROUNDS, id_col: str = "doc_id"):
    """The weight tables after ``rounds`` merged passes; round r reads the rows whose ``part`` is r.

    Steps depend on what was read before, so rows are dealt to shards, and read there, by a hash of id and text, and each shard
    starts from the common weights, whichever partition holds it.  However the table's files lie and however many partitions
    there are, the same rows give the same weights (up to the rounding of merged sums).
    """
    import numpy as np

    weights = [np.zeros((rows, n), dtype=np.float32) for rows, n in zip(ROWS, (GROUPS, CLASSES, OUTCOMES))]
    known = [np.zeros(rows, dtype=np.float32) for rows in ROWS]  # evidence so far
    columns = [f"w{k}" for k in range(max(GROUPS, CLASSES, OUTCOMES))]

    for r in range(rounds):

        def run(batches, begun=weights, before=known):
            import pyarrow as pa

            from ._vector import blocks

            def parts():
                for batch in sliced(batches, 2048):
                    shard = batch.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
                    yield from ((shard[a], batch.column(1).slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b)

            for _, found in groupby(parts(), lambda x: x[0]):
                now = [w.copy() for w in begun]
                squares = [np.repeat((PRIOR + e)[None, :], w.shape[1], 0) for w, e in zip(begun, before)]
                seen, done = [np.zeros(rows, dtype=bool) for rows in ROWS], 0
                for data, starts in blocks(x.as_py() or b"" for _, texts in found for x in texts.cast(pa.binary())):
                    key, bucket, doc = _tokens(data, starts)
                    kind = words.of_bucket[bucket]
                    history = _history(key, kind, doc)
                    place = _outcomes(words, _places(words, key))
                    a = 0
                    while a < len(key):
                        b = slice(a, a + min(BATCH, max(FIRST, done // 4)))  # a quarter of what was seen, so a small part gets many steps too
                        done, a = done + len(kind[b]), b.stop
                        for level, which, given, target in _levels(words, kind[b], place[b]):
                            if len(given):
                                rows = _rows(history[b][which], level, given)
                                _step(now[level], squares[level], seen[level], rows, target, words.masks[level][given], RATE)
                for level in range(LEVELS):
                    at = np.flatnonzero(seen[level])
                    held = squares[level].mean(0)[at]
                    change = (now[level] - begun[level])[at] * held[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(held - PRIOR - before[level][at]), *(pa.array(change[:, c]) for c in range(change.shape[1]))], names=["t", "row", "e", *columns])

        schema = "t int, row int, e float, " + ", ".join(f"{c} float" for c in columns)
        # What a shard hands back doesn't depend on its size, so shards grow with the tokens alone, and not with the session's partitions.
        shards = max(1, -(-words.n // (rounds * TASK_TOKENS)))
        text = text_or_empty(text_col)
        rows = docs.where(part == r).select(text.alias("_text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("_at"))
        dealt = rows.withColumn("_shard", F.pmod("_at", F.lit(shards))).repartition(shards, "_shard").sortWithinPartitions("_shard", "_at")
        changes = dealt.select("_shard", "_text").mapInArrow(tidied(run), schema)
        # Each change was held back by the prior and what was known before, besides its own evidence; all evidence together is held back by them once.
        merged = changes.groupBy("t", "row").agg(*[F.sum(c).cast("float").alias(c) for c in ("e", *columns)]).toArrow()  # at most sum(ROWS) rows
        levels = merged["t"].to_numpy()
        weights, known = [w.copy() for w in weights], [e.copy() for e in known]
        for level in range(LEVELS):
            here = np.flatnonzero(levels == level)
            at, e = merged["row"].to_numpy()[here], merged["e"].to_numpy()[here]
            base = PRIOR + known[level][at]
            for k, c in enumerate(columns):
                weights[level][at, k] += merged[c].to_numpy()[here] / (base + e)
            known[level][at] += e
    return weights


def _log_p(weights, words: Vocabulary, key, kind, doc, place):
    """log10 of each token's probability, but for a remainder's shares."""
    import numpy as np

    history = _history(key, kind, doc)
    log_p = np.empty(len(key))
    for a in range(0, len(key), BATCH):
        b = slice(a, a + BATCH)
        p = np.ones(len(kind[b]))
        for level, which, given, target in _levels(words, kind[b], place[b]):
            if len(given):
                p[which] *= _softmax(weights[level], _rows(history[b][which], level, given), words.masks[level][given])[np.arange(len(given)), target]
        log_p[b] = np.log10(np.maximum(p, 1e-30))
    return log_p


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), learning from rows not held out."""
    import numpy as np

    learn = docs.where(~held_out)
    counts = written(word_counts(learn, text_col))
    words = vocabulary(counts, head)
    part = F.pmod(F.floor(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) / 5), F.lit(ROUNDS))
    weights = train(learn, part, words, text_col, id_col=id_col)
    base_under = float(np.log10(words.n + 0.5 * (words.v + 1)))

    def run(batches):
        import pyarrow as pa

        from ._vector import blocks

        known_log = np.log10(words.counts + 0.5) if len(words.keys) else np.zeros(1)
        for batch in sliced(batches, 2048):
            out = {"n_tokens": [], "n_known": [], "base": [], "score": []}
            tail_keys, tail_n, sizes = [], [], []
            for data, starts in blocks(x.as_py() or b"" for x in batch.column(3).cast(pa.binary())):
                key, bucket, doc = _tokens(data, starts)
                kind, at = words.of_bucket[bucket], _places(words, key)
                place = _outcomes(words, at)
                found = np.where(at >= 0, known_log[at], 0.0)
                log_p = _log_p(weights, words, key, kind, doc, place)
                rest = (kind > 0) & (place == OUTCOMES - 1)
                log_p += np.where(rest, found - words.rest[kind], 0.0)
                total = lambda x, d=doc, m=len(starts): np.bincount(d, x, m)
                size = np.bincount(doc, minlength=len(starts))
                out["n_tokens"].append(size)
                out["n_known"].append(total(at >= 0).astype(np.int64))
                out["base"].append(total(found) - size * base_under)
                out["score"].append(total(log_p))
                # What isn't among the frequent words, by text.
                rare = at < 0
                for keys in np.split(key[rare], np.cumsum(np.bincount(doc[rare], minlength=len(starts)))[:-1]):
                    k, n = np.unique(keys, return_counts=True)
                    tail_keys.append(k)
                    tail_n.append(n)
                    sizes.append(len(k))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            flat = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)))
            columns = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns, flat(tail_keys), flat(tail_n)], names=["_row", "_id", "held_out", *out, "tail", "tail_n"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), held_out, text_or_empty(text_col))
    scored = written(picked.mapInArrow(tidied(run), f"_row long, _id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, tail_n array<long>"))

    tail = scored.select("_row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("_row", F.col("x.tail").alias("key"), F.col("x.tail_n").alias("_n"))
    met = tail.join(counts.where(F.col("bucket") != PAIR).select("key", "c"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("_row").agg(F.sum(F.col("_n") * F.log10(c + 0.5)).alias("_log"), F.sum(F.when(c > 0, F.col("_n")).otherwise(0)).alias("_known"))
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.drop("tail", "tail_n").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", add("n_known", "_known").alias("n_known"), F.lit(int(words.n)).cast("long").alias("train_tokens"), add("base", "_log").alias("base_score"), add("score", "_log").alias("score")
    )


def split(id_col: str = "doc_id") -> Column:
    """The rows that are held out: crc32 of the id modulo 5 is 1."""
    return crc_mod(F.col(id_col), 5) == 1
