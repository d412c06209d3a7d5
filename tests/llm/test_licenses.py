"""License scans: base phrases by brute force, the method against a plain version of itself, and planted licenses."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import docs, edge, prose  # noqa: F401

from gridmill.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def stands(w, phrase):
    p = words(phrase)
    return [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]


def brute_base(text):
    w = words(text)
    at = [(k, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for k in stands(w, phrase)]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def brute_matches(text, idf):
    """Labels and the best share, with strings, dictionaries and loops."""
    w, found, best = words(text), set(), 0.0
    for t in licenses.TEMPLATES:
        tw = words(t.text)
        rare = sorted(set(tw), key=lambda x: (-idf[x], x))[:8]
        slack, votes = max(4, len(tw) // 8), {}
        for p, x in enumerate(w):
            if x in rare:
                for q, y in enumerate(tw):
                    if x == y:
                        for b in ((p - q) // slack, (p - q) // slack - 1):
                            votes.setdefault(b, set()).add(x)
        for b, agree in votes.items():
            low, high = max(b * slack, 0), min((b + 2) * slack + len(tw), len(w))
            if 2 * len(agree) < len(rare) or low >= high:
                continue
            window, left = w[low:high], Counter(tw)
            if not all(stands(window, k) for k in t.keys) or any(stands(w[low : high + 64], k) for k in t.unless):
                continue
            common = left & Counter(window)
            share = sum(idf[x] * n for x, n in common.items()) / sum(idf[x] * n for x, n in left.items())
            if share >= 0.6:
                found.add(t.label)
                best = max(best, round(share, 6))
    return found, best


def told(df):
    return {r.doc_id: r.licenses for r in licenses.scan(df).select("doc_id", "licenses").collect()}


def compare(rows, got):
    n, df = len(rows), Counter(x for _, t in rows for x in set(words(t)))
    every = {x for t in licenses.TEMPLATES for x in words(t.text)}
    idf = {x: 1 + log((n + 1) / (df[x] + 1)) for x in every}
    for i, t in rows:
        g, base = got[i], brute_base(t)
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base
        labels, best = brute_matches(t, idf)
        assert g.labels == ",".join(sorted(labels | set(filter(None, base[4].split(","))))), i
        assert g.score == pytest.approx(1.0 if base[1] else best, abs=2e-6)
        assert set(x.label for x in g.found) == labels and all(0 <= x.start < x.end <= g.n_words for x in g.found)


def test_licenses(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rows, got = [tuple(r) for r in df.collect()], told(df)
    compare(rows, got)
    labels = Counter(x.labels for x in got.values())
    assert labels["gpl-3"] and labels["mit"] and labels["apache-2"] and labels["cc-by-nc"] and labels[""] > 0.9 * len(rows)


def test_planted_licenses(spark):
    """Every template in prose, after comment marks, with other names and a few words changed; two licenses in a file; cut ones don't count."""
    rnd, rows, want = random.Random(4), [], {}
    for k, t in enumerate(licenses.TEMPLATES):
        w = t.text.split()
        lines = "\n# ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9))
        rows.append((k, f"{prose(k, 300)}\n# Copyright 2020 Some Body\n# {lines}\n{prose(k + 50, 300)}"))
        want[k] = {t.label}
    full = {}
    for t in licenses.TEMPLATES:
        full.setdefault(t.label, t)
    changed = full["mit"].text.split()
    for j in (20, 45, 70):
        changed[j] = "altered"
    changed[30:30] = ["by", "the", "holder"]
    rows.append((100, " ".join(changed)))
    want[100] = {"mit"}
    rows.append((101, f"{full['isc'].text} {prose(9, 800)} {full['bsd-3'].text}"))
    want[101] = {"isc", "bsd-3"}
    rows.append((102, " ".join(full["apache-2"].text.split()[:30])))
    want[102] = {"apache-2"}  # a base phrase, but no whole notice
    shuffled = full["zlib"].text.split()
    rnd.shuffle(shuffled)
    rows.append((103, " ".join(shuffled)))
    want[103] = set()
    rows += [(104, "All rights. Reserved seats only"), (105, "the license version of the public"), (106, "x" * 100_000 + " all rights reserved " * 3000)]
    want |= {104: {"all-rights-reserved"}, 105: set(), 106: {"all-rights-reserved"}}
    got = told(docs(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert {i: set(filter(None, x.labels.split(","))) for i, x in got.items()} == want
    assert [x.label for x in got[102].found] == [] and got[102].base_labels == "apache-2"
    compare([r for r in rows if r[0] != 106], told(docs(spark, [t for i, t in rows if i != 106], [i for i, _ in rows if i != 106])))


def test_licenses_edges(spark, edge):  # noqa: F811
    df = edge.withColumns({"licenses": F.lit(1), "c0": F.lit(2)})
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "_licenses"] and out.count() == df.count()
    for r in out.collect():
        assert tuple(r._licenses)[:5] == brute_base(r.text) and r._licenses.labels == "" and r._licenses.score == 0.0
    assert licenses.scan(df.limit(0)).count() == 0


def test_long_text_is_read_in_parts(spark, monkeypatch):
    text = ("word, " * 3000 + "under the MIT-License; " + "é" * 500 + " ") * 3
    whole = licenses.numbered(text.encode())
    monkeypatch.setattr(licenses, "BLOCK_BYTES", 101)
    assert np.array_equal(licenses.numbered(text.encode()), whole) and len(whole) == len(words(text))
    assert told(docs(spark, [text]))[0].n_base == 3


def test_places_are_all_places():
    rnd = random.Random(3)
    for _ in range(50):
        ids = np.array([rnd.randrange(3) for _ in range(40)], dtype=np.int16)
        phrase = np.array([rnd.randrange(3) for _ in range(3)], dtype=np.int16)
        want = [k for k in range(38) if ids[k : k + 3].tolist() == phrase.tolist()]
        assert licenses.places(ids, phrase, np.array([0.3, 2.0, 1.0])).tolist() == want
