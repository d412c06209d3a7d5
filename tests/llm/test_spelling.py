"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, docs, edge  # noqa: F401

from gridmill.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute(rows, least=7):
    """What the query returns, by its definition: all pairs of words are compared."""
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    c = {w: n for w, n in c.items() if len(w) >= least and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in c:
        found = sorted((-c[v], v) for v in c if near(w, v))
        form = found[0][1] if found and -found[0][0] >= 10 * c[w] else None
        out[w] = (form, len(found))
    result = {}
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, c[w], k, c[form] if form else None)
    return result


def told(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_variants(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = told(spelling.spelling_variants(df))
    assert got == want and any(x[0] for x in want.values())


def test_spelling_chains_and_runs(spark, monkeypatch):
    """Chains of forms, doubled letters, letters beyond ASCII, ties, and blocks of a few letters."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rnd, rows = random.Random(2), []
    counts = {"aaaaaaaa": 3, "aaaaaaaaa": 40, "aaaaaaaaaa": 900, "aaabaaaa": 5, "bookkeeper": 1000, "bokkeeper": 90, "bokkeper": 8, "bokeper": 2, "straßeüber": 60, "strasseüber": 2, "straseuber": 3, "ééétudes": 30, "éétudes": 3, "Étudess": 2, "variant": 20, "varient": 2, "variest": 20, "abcdefg": 50, "bacdefg": 5}
    every = [w for w, n in counts.items() for _ in range(n)]
    rnd.shuffle(every)
    for k in range(0, len(every), 40):
        rows.append((k, ", ".join(w.upper() if rnd.random() < 0.2 and w.isascii() else w for w in every[k : k + 40])))
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    want = brute(rows)
    assert told(spelling.spelling_variants(df)) == want
    assert want["bokkeper"][1] == "bookkeeper" and want["variant"][0] is None


def test_spelling_random_words(spark):
    """A small alphabet, where most words are near many others."""
    rnd = random.Random(5)
    rows = [(k, " ".join("".join(rnd.choice("abä") for _ in range(rnd.choice((7, 7, 8, 9)))) for _ in range(60))) for k in range(40)]
    assert told(spelling.spelling_variants(docs(spark, [t for _, t in rows]))) == brute(rows)


def test_spelling_edges(spark, edge):  # noqa: F811
    got = told(spelling.spelling_variants(edge))
    assert got == brute([(r.doc_id, r.text) for r in edge.collect()])
    twice = docs(spark, ["y" * 40_000, "y" * 40_000, "y" * 20_000 + "z" + "y" * 19_999] * 2)
    found = told(spelling.spelling_variants(twice))
    assert {w: x[3] for w, x in found.items() if len(w) == 40_000} == {"y" * 40_000: 1, "y" * 20_000 + "z" + "y" * 19_999: 1}
    assert spelling.spelling_variants(edge.limit(0)).count() == 0
    assert spelling.spelling_variants(docs(spark, [None, "", "short words only"])).count() == 0


def test_spelling_checks_strings(spark):
    """Pairs that only share a hash don't count, and keys hold no strings."""
    keys = spelling._keyed(spark.createDataFrame([(1, "abcdefg")], "node long, word string"))
    assert keys.columns == ["key", "node", "span"] and keys.count() == 8
    plan = spelling.near_candidates(spark.createDataFrame([(1, "abcdefg")], "node long, word string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_deletion_keys_are_those_of_the_strings(seed):
    import numpy as np

    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    key, node, span = spelling.deletion_keys(words)
    by = {}
    for k, w, s in zip(key.tolist(), node.tolist(), span.tolist()):
        low, high = s >> 32, s & 0xFFFFFFFF
        text = words[w] if low < 0 else words[w][:low] + words[w][low + 1 :]
        assert low < 0 or all(words[w][:j] + words[w][j + 1 :] == text for j in range(low, high + 1))
        assert by.setdefault(k, text) == text
    assert len(by) == len(set(by.values()))
    order = np.lexsort((span, key))
    got = {tuple(sorted((words[a], words[b]))) for a, b in zip(*(x.tolist() for x in spelling.close_pairs(key[order], node[order], span[order]))) if words[a] != words[b]}
    near = {tuple(sorted((a, b))) for a in words for b in words if a < b and a in brute_neighbours(b)}
    assert got == near


def brute_neighbours(w):
    letters = "abc"
    out = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return out - {w}


def test_word_counts_combine_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = spelling.word_counts(df.withColumns({"word": F.lit("x"), "n": F.lit(1)}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
