"""Near duplicates: bottom-k sketches of one hash function, inverted lists, exact verification.

1.  One pass over the texts gives each row the size of its shingle set, a 128-bit fingerprint of the set and its
    bottom-k sketch.  Rows with equal sets form one class, so copies cost nothing further.
2.  Inverted lists of the retained values: a class is listed under its rarest values first.
    Sketches of sets at the threshold share at least ``c`` values, up to a chance below ``MISS`` (a binomial tail;
    for sets that fit in the sketch it is certain), so it is enough to list the rarest k - c + 1 of k.
3.  A list of at most ``SHORT`` classes gives all its pairs of fitting sizes.  Members of longer lists are listed anew,
    under the rarest values of their full sets by the exact prefix bound, which leaves those apart that only share a
    passage, and with a bound on what each set can share at all.  What is still long gives pairs with its most typical class; members that this doesn't connect are tried
    with further centres, and at last pairs in different components are found by what they differ in from a typical member
    of their list, again by prefixes, so no link that matters is lost.
4.  Candidates whose union sketch shares too few values go; the rest are verified on the full sets.
5.  Components of the verified links, by contraction.

Only links that join two components matter to the result, so pairs within a component are not expanded.

Defined cases: null counts as empty text; texts without words have an empty set, link with nothing and
stay.  A text with fewer words than a shingle is one shingle.  Null ids sort after all ids: a group that has only
such rows has component_id null.  Rows with equal id and text count as one document.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, sliced, text_or_empty, tidied, written
from ._graph import components

K = 32
MISS = 1e-9
SHORT = 32
ROUNDS = 3
PART = 512


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The most values that two full sketches of sets at the threshold share, but for a chance of ``miss``."""
    t, below = percent / 100, 0.0
    for c in range(k + 1):
        below += comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > miss:
            return max(1, c)
    return k


def listed(k: int, percent: int) -> list[int]:
    """How many of its rarest values a class with 0..k retained values is listed under."""
    t = percent / 100
    out = [0]
    for s in range(1, k + 1):
        shared = min(least_shared(k, percent), s) if s == k else ceil(min(t * s, s - max(0.0, s / t - k)) - 1e-9)
        out.append(s - max(1, shared) + 1)
    return out


def _row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text, the same in every pass over the rows."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"), text_or_empty(text_col)).cast("binary"))


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ._vector import U, mixed, shingles, words_by_text

        for batch in sliced(batches, 1024):
            texts = (x.as_py() or b"" for x in batch.column(2).cast(pa.binary()))
            n, f1, f2, sketch = [], [], [], []
            for found in words_by_text(texts):
                s = shingles(found, words)
                u = s.view(np.uint64)
                n.append(len(s))
                f1.append(int(np.add.reduce(mixed(u)).view(np.int64)) if len(s) else 0)
                f2.append(int(np.add.reduce(mixed(u ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                sketch.append(s[:k])
            arrays = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_key", "n", "f1", "f2", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), _row_key(id_col, text_col), text_or_empty(text_col))
    return rows.mapInArrow(tidied(run), f"_id {kind}, _key string, n long, f1 long, f2 long, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, n, set) for ``wanted`` (node, _key)."""

    def run(batches):
        import pyarrow as pa

        from ._vector import shingles, words_by_text

        for batch in sliced(batches):
            texts = (x.as_py() or b"" for x in batch.column(1).cast(pa.binary()))
            sets = [shingles(x, words) for x in words_by_text(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "set"])

    rows = docs.select(_row_key(id_col, text_col).alias("_key"), text_or_empty(text_col).alias("_text"))
    # Of repeated rows one is enough; where the join has dealt rows by key, this shuffles nothing, and never the sets.
    once = rows.join(wanted, "_key").dropDuplicates(["_key"])
    return once.select("node", "_text").mapInArrow(tidied(run), "node long, n long, set array<long>")


def _salt(size: Column) -> Column:
    """The part of a list of ``size`` members that a member is in: one for each ``PART`` of them."""
    return F.pmod(F.hash("node"), F.ceil(size / PART).cast("int"))


def _salts(size: Column) -> Column:
    """All parts of a list of ``size`` members."""
    return F.explode(F.sequence(F.lit(0), F.ceil(size / PART).cast("int") - 1))


class _Search:
    """The candidate search and verification over classes."""

    def __init__(self, classes: DataFrame, sets: DataFrame | None, k: int, percent: int):
        self.classes, self.sets, self.k, self.percent = classes, sets, k, percent

    def fits(self, na: Column, ra: Column, nb: Column, rb: Column) -> Column:
        """Could sets of these sizes be linked, if only r values of each are in any other set?"""
        most = F.least(ra, rb)
        return 100 * most >= self.percent * (na + nb - most)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose union sketch shares enough values."""
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
        near = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        low = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        shared = F.size(F.array_intersect(low, F.array_intersect("sa", "sb")))
        whole = F.size(low) < self.k
        return near.where(F.when(whole, 100 * shared >= self.percent * F.size(low)).otherwise(shared >= least_shared(self.k, self.percent))).select("a", "b")

    def verified(self, near: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked by their full sets."""
        full = lambda x: self.sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("set").alias(f"t{x}"))
        both = near.join(full("a"), "a").join(full("b"), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        return both.where(100 * common >= self.percent * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked: union-sketch estimate, then the full sets."""
        return self.verified(self.likely(pairs))

    def short_pairs(self, keys: DataFrame) -> DataFrame:
        """All pairs of each list of at most ``SHORT`` members whose sizes fit."""
        short = keys.where(F.col("m") <= SHORT)
        l, r = (short.select("v", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("r").alias(f"r{x}")) for x in "ab")
        return l.join(r, (l.v == r.v) & (F.col("a") < F.col("b")) & self.fits(*map(F.col, ("na", "ra", "nb", "rb")))).select("a", "b")

    def apart_pairs(self, lists: DataFrame) -> DataFrame:
        """The pairs (a, b) across components that ``lists`` (v, m, node, n, r, typical, comp) leave possible; long lists meet their pivot in parts.

        Each list has a pivot p, its most typical member; D(x) is the symmetric difference of x and p.  Sets x and y are
        linked if and only if |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= h (n(x) + n(y)), h = (1 - t) / (1 + t).  If x is not
        linked to p, that asks for a common member of D(x) and D(y), and the prefix bound holds for both.
        """
        lists = written(lists)
        pivot = F.max(F.struct("typical", "node", "n", "comp")).alias("p")
        open_ = lists.groupBy("v", "m").agg(pivot, F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        open_ = open_.select("v", _salts(F.col("m")).alias("s"), F.col("p.node").alias("p"), F.col("p.n").alias("np"), F.col("p.comp").alias("pcomp"))
        met = lists.withColumn("s", _salt(F.col("m"))).join(open_, ["v", "s"]).where("node <> p").select("p", "np", "pcomp", "node", "n", "r", "comp").distinct()
        full = lambda node, x: self.sets.select(F.col("node").alias(node), F.col("set").alias(x))
        both = met.join(full("node", "t"), "node").join(full("p", "tp"), "p")
        diff = F.concat(F.array_except("t", "tp"), F.array_except("tp", "t"))
        linked = (100 + self.percent) * F.size("d") <= (100 - self.percent) * (F.col("n") + F.col("np"))
        drawn = written(both.withColumn("d", diff).withColumn("linked", linked).drop("t", "tp"))
        direct = drawn.where("linked and comp <> pcomp").select(F.col("p").alias("x"), F.col("node").alias("y"))

        flat = drawn.select("p", "node", F.explode("d").alias("e"))
        common = flat.groupBy("p", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        per = flat.join(common, ["p", "e"]).groupBy("p", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
        rows = drawn.withColumn("m", F.size("d")).drop("d").join(per, ["p", "node"]).withColumn("q", F.size("es"))
        rows = written(rows.withColumn("left", (F.col("comp") != F.col("pcomp")) & ~F.col("linked")))

        def prefixes(part: DataFrame, least: Column, x: str) -> DataFrame:
            """Each row under its rarest differences, if it has ``least`` in common with another."""
            take = F.col("q") - F.greatest(F.lit(1), F.ceil(least - 1e-9)) + 1
            kept = part.withColumn("take", take.cast("int")).where("take > 0").withColumn("es", F.slice("es", F.lit(1), F.col("take")))
            return kept.select("p", F.explode("es.e").alias("e"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "r", "comp", "m", "q", "left")])

        h = (100 - self.percent) / (100 + self.percent)
        l = prefixes(rows.where("left"), (F.col("m") - F.col("n") * ((100 - self.percent) / self.percent)) / 2, "a")
        r = prefixes(rows, (F.col("m") + h * (F.col("np") - F.col("n"))) / 2, "b")
        cross = (F.col("comp_a") != F.col("comp_b")) & (~F.col("left_b") | (F.col("comp_a") < F.col("comp_b")))
        near = F.col("m_a") + F.col("m_b") - 2 * F.least("q_a", "q_b") <= h * (F.col("n_a") + F.col("n_b")) + 1e-9
        pairs = l.join(r, ["p", "e"]).where(cross & near & self.fits(*map(F.col, ("n_a", "r_a", "n_b", "r_b"))))
        pairs = pairs.select(F.col("node_a").alias("x"), F.col("node_b").alias("y")).distinct().union(direct)
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def long_links(self, long: DataFrame, links: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, labels) with those of the long lists (v, m, node, n, r, typical), m members each."""

        def labelled(rows: DataFrame) -> DataFrame:
            return rows.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

        left = labelled(long.select("v", "m", "node", "n", "r", "typical"))
        for _ in range(ROUNDS):
            centre = left.groupBy("v", "m").agg(F.max(F.struct("typical", "node", "n", "r", "comp")).alias("c"))
            centre = centre.select("v", _salts(F.col("m")).alias("s"), "c")
            apart = written(left.withColumn("s", _salt(F.col("m"))).join(centre, ["v", "s"]).where("comp <> c.comp"))
            if apart.isEmpty():
                break
            # A member tries one centre a round, the most typical of its lists.
            tried = apart.where(self.fits(*map(F.col, ("n", "r", "c.n", "c.r")))).groupBy("node").agg(F.max("c").alias("c"))
            links = written(links.union(self.links(tried.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")))))
            label = components(links)
            now = labelled(apart.select("v", "m", "node", "n", "r", "typical", F.col("c.node").alias("_c")))
            of = label.select(F.col("node").alias("_c"), F.col("comp").alias("_comp"))
            left = written(now.join(of, "_c", "left").where("comp <> coalesce(_comp, _c)").drop("_c", "_comp"))
        # Whatever is still apart: by what sets differ in from a member of their list.
        links = written(links.union(self.links(self.apart_pairs(labelled(long.select("v", "m", "node", "n", "r", "typical"))))))
        return links, components(links)


def _keys(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, node, n, r, typical): the inverted lists with two or more members; r bounds what a set can share."""
    flat = classes.select("node", F.explode("sketch").alias("v"))
    common = flat.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = flat.join(common, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("typical"))
    size = F.size("sketch")
    take = F.get(F.lit(listed(k, percent)), size) - (size - F.size("vs"))
    kept = per.join(classes.select("node", "n", "sketch"), "node").select("node", "n", "typical", F.slice("vs", F.lit(1), F.greatest(take, F.lit(0))).alias("vs"))
    return kept.select(F.explode("vs.v").alias("v"), "node", "n", F.col("n").alias("r"), "typical")


def _exact_keys(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """As ``_keys``, by the prefix bound on full sets: linked sets share one of each one's n - ceil(t n) + 1 rarest values.

    What no other listed set has can't be shared, so r counts the rest.
    """
    flat = sets.join(nodes, "node", "left_semi").select("node", "n", F.explode("set").alias("v"))
    common = flat.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = flat.join(common, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("typical"))
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    take = (prefix - (F.col("n") - F.size("vs"))).cast("int")
    return per.where(take > 0).select(F.explode(F.slice("vs", F.lit(1), take)).alias("x"), "node", "n", F.size("vs").cast("long").alias("r"), "typical").select("x.v", "node", "n", "r", "typical")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have _id, _key, n, f1, f2; classes have n, f1, f2, id and _key of the document that stays."""
    marks = written(_sketched(docs, id_col, text_col, words, k))
    best = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_key").alias("key"), "sketch")).alias("r")
    grouped = marks.where("n > 0").groupBy("n", "f1", "f2").agg(best)
    node = F.xxhash64(F.monotonically_increasing_id())  # a bijection on 64-bit numbers, so unique and in random order
    classes = written(grouped.select("n", "f1", "f2", "r.no_id", "r.id", "r.key", "r.sketch", node.alias("node")))

    keys = written(_keys(classes, k, percent))
    sizes = keys.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    keys = written(keys.join(sizes, "v"))
    # Full sets are made only for what the union sketches leave of short lists' pairs, and for members of long lists.
    search = _Search(classes, None, k, percent)
    near = written(search.likely(search.short_pairs(keys)))
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).union(keys.where(F.col("m") > SHORT).select("node")).distinct()
    wanted = wanted.join(classes.select("node", F.col("key").alias("_key")), "node")
    sets = search.sets = written(_full_sets(docs, wanted, id_col, text_col, words))

    links = written(search.verified(near))
    # Long lists are drawn up anew from the full sets of their members, by the exact prefix bound.
    keys = written(_exact_keys(sets, keys.where(F.col("m") > SHORT).select("node").distinct(), percent))
    keys = written(keys.join(keys.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "v"))
    links = written(links.union(search.links(search.short_pairs(keys))))
    label = components(links)
    long = keys.where(F.col("m") > SHORT)
    if not long.isEmpty():
        links, label = search.long_links(long, links, label)

    # (not label), so that a class without links is its own component.
    named = classes.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    stay = F.min(F.struct("no_id", "id", "key")).alias("stay")
    chosen = named.groupBy("comp").agg(stay)
    return marks, written(named.join(chosen, "comp").select("n", "f1", "f2", F.col("stay.id").alias("_stay_id"), F.col("stay.key").alias("_stay_key")))


def _decided(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    marks, classes = near_classes(docs, id_col, text_col, words, percent)
    full = marks.where("n > 0").join(classes, ["n", "f1", "f2"]).select("_id", "_key", "n", "_stay_id", "_stay_key")
    empty = marks.where("n = 0").select("_id", "_key", "n", F.col("_id").alias("_stay_id"), F.col("_key").alias("_stay_key"))
    return full.union(empty)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept (its id is the component's smallest)."""
    rows = _decided(docs, id_col, text_col, words, percent)
    return rows.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_stay_id").alias("component_id"), F.col("_id").eqNullSafe(F.col("_stay_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were.

    Of rows with equal id and text one stays; rows without words have no group, and all of them stay.
    """
    rows = written(_decided(docs, id_col, text_col, words, percent).select("_key", "_stay_key", "n"))
    gone = rows.where("_key <> _stay_key").select(F.col("_key").alias("_gone")).distinct()
    key, row, n = fresh("_key", docs), fresh("_row", docs), fresh("_copies", docs)
    left = docs.withColumn(key, _row_key(id_col, text_col)).join(gone, F.col(key) == F.col("_gone"), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Which rows are repeated is counted on keys alone, and only their texts are shuffled; each task keeps one of a key before that.
    twice = rows.where("n > 0 AND _key = _stay_key").groupBy("_key").agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    if twice.isEmpty():
        return left.select(*columns)
    marked = left.join(twice.withColumnRenamed("_key", "_twice"), F.col(key) == F.col("_twice"), "left")
    by = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    whole = F.struct(*columns).alias(row)
    once = marked.where(F.col(n).isNull()).select(*columns)
    again = marked.where(F.col(n).isNotNull()).groupBy(key).agg(F.min_by(whole, by).alias(row)).select(f"{row}.*")
    return once.unionByName(again)
