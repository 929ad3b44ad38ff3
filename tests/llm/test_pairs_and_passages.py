import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelog.llm import common, jaccard, substrings
from tidelog.llm.components import components

from .conftest import words


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def expected_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in members[find(i)] if rows[k][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return Counter(out)


@pytest.mark.parametrize(("size", "percent", "most"), [(4, 85, 64), (5, 80, 64), (4, 85, 2), (4, 60, 3)])
def test_join_equals_brute_force(documents, corpus, size, percent, most):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(corpus), size, percent, most).collect())
    assert got == expected_components(corpus, size, percent)


@pytest.mark.parametrize("tokens", [500_000, 900])
def test_join_in_small_chunks(documents, corpus, monkeypatch, tokens):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(corpus)).collect())
    assert got == expected_components(corpus, 4, 85)


def test_sets_that_link_have_a_part_in_common():
    rng = random.Random(5)
    seen = 0
    for _ in range(600):
        n, percent = rng.randrange(1, 120), rng.choice([60, 80, 85, 95])
        a = [rng.randrange(1 << 60) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.12] + [rng.randrange(1 << 60) for _ in range(rng.randrange(0, n // 10 + 2))]
        common = len(set(a) & set(b))
        if b and 100 * common >= percent * (len(a) + len(b) - common):
            seen += 1
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert set(jaccard.part_keys(x, percent).tolist()) & set(jaccard.part_keys(y, percent).tolist())
    assert seen > 100


def test_join_of_short_texts_and_hot_passages(documents):
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"q{rng.randrange(50)}" for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(rows), most_groups=2).collect())
    assert got == expected_components(rows, 4, 85)


def test_join_of_nothing(documents):
    assert jaccard.join(documents([])).collect() == []
    assert [tuple(r)[:3] for r in jaccard.join(documents([(1, None)])).collect()] == [(1, 0, 1)]


def test_one_of_each_group_stays(documents, corpus):
    kept = jaccard.first_of_each(documents(corpus), 5, 80)
    assert kept.columns == documents(corpus).columns
    want = expected_components(corpus, 5, 80)
    comps = {c for (_, n, c) in want if n and c is not None}
    got = Counter(r["doc_id"] for r in kept.collect())
    empties = Counter(d for d, t in corpus if not shingles(t, 5))
    assert got - empties == Counter({c: 1 for c in comps} | ({None: 1} if any(c is None for (_, n, c) in want if n) else {}))
    assert all(got[d] >= n for d, n in empties.items())


def test_one_of_each_group_stays_with_any_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", "b", "c", "d"), (2, text + " more", "e", "f", "g", "h"), (3, "other words of one", "i", "j", "k", "l"), (None, None, "m", "n", "o", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string, _class string, _n string, _tie string")
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_prefix_and_reserve_bounds():
    for n in range(1, 400):
        for percent in (60, 80, 85):
            p = jaccard.prefix(n, percent)
            assert p == n - -(-percent * n // 100) + 1 and 0 <= jaccard.reserve(n, percent) <= n - p
            assert jaccard.reserve(n, percent) <= jaccard.reserve(n + 1, percent) + 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def expected_removal(rows, width):
    docs = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, docs):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("width", "most"), [(35, 2000), (35, 5), (35, 1), (10, 2000), (10, 1), (50, 3)])
def test_removal_equals_brute_force(documents, corpus, width, most):
    got = Counter(tuple(r)[:4] for r in substrings.dedup(documents(corpus), width, most=most).collect())
    assert got == expected_removal(corpus, width)


def test_removal_of_a_hot_passage_in_many_contexts(documents):
    rng = random.Random(6)
    passage = words(rng, 45)
    rows = [(i, words(rng, rng.randrange(0, 30)) + " " + passage + " " + words(rng, rng.randrange(0, 30))) for i in range(150)]
    got = Counter(tuple(r)[:4] for r in substrings.dedup(documents(rows), most=20).collect())
    assert got == expected_removal(rows, 35)


def test_removal_gives_texts_back(documents):
    a = " ".join(f"w{i}" for i in range(40))
    got = {r["doc_id"]: r["kept"] for r in substrings.dedup(documents([(1, a + " end"), (2, "start " + a), (3, None)]), texts=True).collect()}
    assert got == {1: "end", 2: "start", 3: ""}
    assert substrings.dedup(documents([])).collect() == []
    with pytest.raises(ValueError):
        substrings.dedup(documents([]), 5)


def test_suffix_tree():
    rng = np.random.default_rng(1)
    strings = [rng.integers(0, 2, n).astype(np.uint64) for n in (1, 5, 40, 40, 63)]
    strings.append(strings[3].copy())
    suffixes = [tuple(x[i:]) for x in strings for i in range(len(x))]
    tree = substrings.SuffixTree(strings, np.arange(len(suffixes)))
    ordered = [suffixes[i] for i in tree.leaves]
    assert sorted(tree.leaves) == list(range(len(suffixes)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [common(a, b) for a, b in zip(ordered, ordered[1:])] == tree.common.tolist()
    for depth in (1, 3, 8):
        node = tree.nodes(depth)
        for i in range(0, len(ordered), 3):
            for j in range(0, len(ordered), 2):
                a, b = ordered[i], ordered[j]
                assert (node[i] == node[j]) == (i == j or common(a, b) >= depth)


def test_only_shared_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k % 9 if k % 4 else 100 + k, k) for k in range(60)] * 2
        df = spark.createDataFrame(rows, "a bigint, b bigint")
        for distinct in (False, True):
            base = set(rows) if distinct else rows
            keys = Counter(a for a, _ in base)
            assert Counter(map(tuple, common.only_shared(df, "a", ["b"], distinct).collect())) == Counter(x for x in base if keys[x[0]] > 1)
        salted = spark.createDataFrame([(a, b, int(a == 3) * (1 + b % 5)) for a, b in rows[:60]], "a bigint, b bigint, s int")
        assert Counter(map(tuple, common.only_shared(salted, "a", ["b"], True, "s").collect())) == Counter(x for x in rows[:60] if Counter(a for a, _ in rows[:60])[x[0]] > 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_any_bytes():
    import pyarrow as pa

    texts = ["a b", "", None, "é\u00a0x\u2003y\x1cz", " lead", "trail ", "\t\n", "x" * 100 + " y"]
    w = common.cut_words(pa.array(texts))
    got = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [[x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if x] for t in texts]
