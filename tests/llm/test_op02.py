import random
import re

import numpy as np

from meridia.llm import op02_jaccard
from meridia.llm.op02_jaccard import jaccard_links, near_duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}


def rows_of(seed=1, copies=60):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["É", "ß!", "Zz"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a b"), (4, "A  B"), (5, "a b c")]
    base = [[r.choice(words) for _ in range(r.choice([3, 7, 30, 120]))] for _ in range(25)]
    for k in range(150):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((10 + k, r.choice([" ", "\n"]).join(t)))
    long = [r.choice(words) for _ in range(400)]
    for k in range(copies):  # one large group of near copies
        t = list(long)
        for _ in range(r.randrange(12)):
            t[r.randrange(len(t))] = r.choice(words).upper()
        rows.append((1000 + k, " ".join(t)))
    return rows


def test_against_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] * 2, "doc_id long, text string, g string")
    got = near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(3, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got] == [(3, 0, 3, 0)]


def brute_links(rows):
    """All pairs of different sets that link, each set as its least document."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    s = [x for x in least if x]
    pairs = {tuple(sorted((least[x], least[y]))) for k, x in enumerate(s) for y in s[:k] if 100 * len(x & y) >= 80 * len(x | y)}
    return pairs, {i: least[x] for i, x in sets.items()}


def test_all_links(spark, monkeypatch):
    rows = rows_of()
    want, least = brute_links(rows)
    degree = {}
    for pair in want:
        for x in pair:
            degree[x] = degree.get(x, 0) + 1
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in near_duplicates(docs).collect()} == {i: degree.get(least[i], 0) for i in least}
    monkeypatch.setattr(op02_jaccard, "BLOCK_SETS", 7)
    classes, links = jaccard_links(docs)
    of = {}
    for r in classes.collect():
        of[r.digest] = min(r.doc_id, of.get(r.digest, r.doc_id))
    assert sorted(tuple(sorted((of[r.a], of[r.b]))) for r in links.collect()) == sorted(want)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(op02_jaccard, "COLUMNS", 5)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (1, 30, 40, 50, 7, 60)]
    got = op02_jaccard.overlaps(np.concatenate(sets), np.repeat(np.arange(6), [len(s) for s in sets]), np.array([0, 2, 4]), np.array([1, 3, 5]))
    assert got.tolist() == [[len(np.intersect1d(sets[x], sets[y])) for y in (1, 3, 5)] for x in (0, 2, 4)]


def test_null_and_large_ids(spark):
    big = 2**60
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (big + 1, text), (big + 3, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.n_links) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, None, 0), (0, 56, None, 0), (big + 1, 56, big + 1, 1), (big + 3, 57, big + 1, 1)]


def test_lists_dealt_and_met_in_blocks(spark, monkeypatch):
    """Long lists in several tasks, several blocks of a list, and no pairs from small lists: the same components."""
    monkeypatch.setattr(op02_jaccard, "WHOLE_LIST", 3)
    monkeypatch.setattr(op02_jaccard, "FREQUENT", 2)
    monkeypatch.setattr(op02_jaccard, "SMALL_LIST", 2)
    monkeypatch.setattr(op02_jaccard, "BLOCK_LIST", 5)
    rows = rows_of(seed=5)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
