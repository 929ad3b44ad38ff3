import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language, nearest, quality, secrets

SF = Path("/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


# ---- quality


def test_statistics_are_finite_for_any_text():
    texts = ["", None, "a", " \n", "| | |", "$$$###", "x" * 5000, "To " * 100, "é " * 30, "normal words on a line.\nAnd another."]
    x = quality.statistics(pa.array(texts))
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    assert np.array_equal(x[0], x[1])
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(x, alone)


def test_fit_equals_plain_moments(spark):
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x, y = rng.normal(size=(200, d)) + 0.0, (rng.random(200) < 0.7).astype(int)
    x[y == 1] += 0.5
    df = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(y, x)], "label int, features array<double>")
    model = quality.fit(df, 0.3, 0.05)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    common = sum(np.mean(y == c) * cov[c] for c in (0, 1))
    odds = []
    for c in (0, 1):
        s = 0.65 * cov[c] + 0.3 * common + 0.05 * np.diag(np.diag(common)) + 1e-6 * np.eye(d)
        z = x - x[y == c].mean(0)
        odds.append(np.log(np.mean(y == c)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(odds[0] - odds[1])))


def test_quality_without_labels_or_one_class(documents):
    docs = documents([(1, "a b"), (None, None), (2, "")])
    empty = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit("x").alias("text"))
    assert {r["score"] for r in quality.classify(docs, empty).collect()} == {0.5}
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {(r["score"], r["predicted"]) for r in quality.classify(docs, ones).collect()} == {(1.0, 1)}
    assert quality.classify(docs.limit(0), ones).collect() == []


@needs_tables
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


# ---- language


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    p = {x: (i + 1) / 15 for i, x in enumerate(pieces)}

    def plain(u):
        return 1.0 if not u else sum(p[x] * plain(u[len(x) :]) for x in pieces if u.startswith(x))

    lattice = language.Lattice(pieces)
    units = [b"a", b"ab", b"aba", b"abab", b"bbaab", b"abaaba"]
    ends = np.cumsum([len(u) for u in units])
    size = np.diff(np.append(0, ends))
    data = np.frombuffer(b"".join(units), np.uint8)
    got = language.forward(lattice, data, ends - size, size, (np.array(list(p.values())) * lattice.tilt)[None, :])
    assert np.allclose(np.exp(got[:, 0]), [plain(u) for u in units])
    counts = language.expected(lattice, data, ends - size, size, np.ones(len(units)), np.array(list(p.values())))
    assert np.isclose((counts * [len(x) for x in pieces]).sum(), size.sum())


def test_units():
    texts = pa.array(["Été À3b", None, "", "12 34", "x" * 150, "ÀÉÞ×ß"])
    data, doc, start, end = language.units(texts)
    got = [(int(d), data[a:b].tobytes().decode(errors="replace")) for d, a, b in zip(doc, start, end)]
    assert got[:3] == [(0, "été"), (0, "à"), (0, "b")] and [len(u) for d, u in got if d == 4] == [150] and got[-1][1] == "àéþ×ß"
    _, doc, start, end = language.units(texts, cut=True)  # what is learned from
    assert (end - start)[doc == 4].tolist() == [64, 64, 22]


def test_language_cases(documents, spark):
    docs = documents([(1, "the cat and the dog"), (2, None), (3, ""), (4, "12 ... 34"), (5, "“ ”"), (None, "le chat et le chien")])
    train = spark.createDataFrame([(10, "the dog and the cat sat", "en"), (11, "le chien et le chat", "fr"), (12, "nothing", None), (13, None, "de")], "doc_id bigint, text string, lang string")
    model = language.fit(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[None][0] == "fr" and all(0.5 < got[k][1] <= 1 for k in (1, None))
    assert all(got[k] == ("und", 0.0) for k in (2, 3, 4, 5))
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(train.limit(0))).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []


def test_long_runs_are_summed_over_all_segmentations():
    """A run of any length, against the plain recursion in logarithms."""
    rng = random.Random(7)
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"ca", b"bcabca", "日本".encode(), b"abcabcabcabcabcabcabcabc"})
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3)
    lattice = language.Lattice(pieces)
    runs = ["".join(rng.choice("abc") for _ in range(n)) for n in (65, 66, 300, 1000, 1000, 2500)] + ["日本語" * 40, "a", "abc" * 8]
    raw = [r.encode() for r in runs]
    size = np.array([len(r) for r in raw])
    got = language.forward(lattice, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, p * lattice.tilt)
    for r, values in zip(raw, got):
        for k in range(3):
            log = [0.0] + [-np.inf] * len(r)
            for end in range(1, len(r) + 1):
                log[end] = np.logaddexp.reduce([log[end - len(x)] + np.log(p[k, i]) for i, x in enumerate(pieces) if r.endswith(x, 0, end) and len(x) <= end])
            assert abs(log[-1] - values[k]) < 1e-6 * max(1, abs(log[-1]))


def test_letters_of_any_script_are_folded():
    data, doc, start, end = language.units(pa.array(["ÀB Ωσ ДА", None, "x" * 200]))
    assert [(d, data[a:b].tobytes().decode()) for d, a, b in zip(doc, start, end)] == [(0, "àb"), (0, "ωσ"), (0, "да"), (2, "x" * 200)]


def test_scores_dont_depend_on_the_cache(monkeypatch):
    model = language.train({"en": {b"the": 5, b"cat": 2}, "fr": {b"le": 5, b"chat": 2}}, [bytes([b]) for b in range(256)] + [b"the", b"at", b"ch"])
    texts = pa.array(["the cat", "le chat", "the the le", "x" * 70])
    full = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "CACHE", 0)
    small = language.Scorer(model)
    assert all(small.predict(texts.slice(i, 1))[0] == [full[0][i]] and np.isclose(small.predict(texts.slice(i, 1))[1][0], full[1][i]) for i in range(4))


@needs_tables
def test_language_held_out(spark):
    rows = language.op2_language(spark, str(SF)).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


# ---- decontamination


def distance(pattern, text):
    """Least edit distance of the pattern to a substring, by dynamic programming."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        before, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (p != c))
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        pattern = "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.myers(pattern, text) == distance(pattern, text)


def test_matches_equal_brute_force(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 6, 20])))) for i in range(12)] + [(90, None), (91, ""), (3, "Short"), (92, "x")]
    rows = []
    for k in range(60):
        text = [word() for _ in range(40)]
        item = list(rng.choice(items)[1] or "")
        for _ in range(rng.randrange(0, 6)):
            if item:
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["Z"], [item[at], "q"]])
        rows.append((k, " ".join(text[:20]) + " \n" + "".join(item).upper() + "\t " + " ".join(text[20:])))
    rows += [(None, None), (70, ""), (71, items[3][1]), (71, items[3][1])]
    docs, table = documents(rows), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, score string")
    want = set()
    for d, t in rows:
        for i, item in items:
            item, n = decontaminate.normal(item), int(decontaminate.RATE * len(decontaminate.normal(item)))
            if item and decontaminate.normal(t) and (got := distance(item, decontaminate.normal(t)))[0] <= n:
                want.add((d, i, got[0]))
    for block in (4_000_000, 100):
        assert {tuple(r)[:3] for r in decontaminate.matches(docs, table, block_chars=block).collect()} == want
        ends = {tuple(r) for r in decontaminate.matches(docs, table, block_chars=4_000_000).collect()}
        assert {tuple(r) for r in decontaminate.matches(docs, table, block_chars=block).collect()} == ends
        clean = decontaminate.clean(docs.withColumn("_key", F.lit(1)), table, block_chars=block)
        assert clean.columns == [*docs.columns, "_key"] and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in {w[0] for w in want})
    assert decontaminate.matches(docs.limit(0), table).collect() == [] and decontaminate.matches(docs, table.limit(0)).collect() == []


# ---- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, 1500))


def test_secrets_found_and_look_alikes_left(documents, forest):
    key, token = "AKIA" + "QZ7WM4KXN2LP5RTY", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    docs = documents([(1, f"words {key} words"), (2, f'set token = "{token}" here'), (3, "password=531ccd051a92ebcb68"), (4, f"commit {token} fixed"), (5, "see https://example.com/en/some-page-with-name-1234 now"), (6, None), (7, ""), (8, f"{key} and {key}"), (None, f"x {key}"), (9, "thetionerandwhichwas plain long words")])
    found = secrets.scan(docs, forest)
    got = sorted((str(r["doc_id"]), r["word_no"], r["secret"]) for r in found.collect())
    assert got == sorted([("1", 1, key), ("2", 3, token), ("3", 0, "531ccd051a92ebcb68"), ("8", 0, key), ("8", 2, key), ("None", 1, key)])
    clean = secrets.redact(docs, forest)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[8] == ("[SECRET] and [SECRET]", 21) and texts[4][0] == f"commit {token} fixed" and texts[6][0] is None and texts[7] == ("", 0) and len(texts) == 10
    assert secrets.scan(docs.limit(0), forest).collect() == []
    for df in (found, clean):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_false_positives_on_findings_held_out(spark, forest):
    """Findings that the forest hasn't seen: those made by the rule with other numbers."""
    from pyspark.ml.functions import vector_to_array

    rows = secrets.labelled_findings(spark, 4500).subtract(secrets.labelled_findings(spark, 1500))
    scored = forest.forest.transform(secrets.described(rows, forest.lexicon)).select("label", vector_to_array("_p")[1].alias("p")).collect()
    false = [r["p"] >= 0.5 for r in scored if r["label"] == 0]
    missed = [r["p"] < 0.5 for r in scored if r["label"] == 1]
    assert len(false) > 1000 and np.mean(false) < 0.03 and np.mean(missed) < 0.05


def test_features_equal_plain_ones(spark, forest):
    """Transitions between letters and dictionary coverage, against loops over characters."""
    lex = forest.lexicon
    texts = ["passwordzqkvhwxm", "AKIAQZ7WM4", "the-quick/brown_Fox12", "1234567890", "internationalization"]
    rows = spark.createDataFrame([(t, t, "", "", "") for t in texts], "secret string, word string, before string, after string, path string")
    got = {r["secret"]: (r["letter_pairs"], r["coverage"]) for r in secrets.described(rows, lex).collect()}
    pieces = sorted({t.lower()[i : i + k] for t in texts for k in secrets.WORD_SIZES for i in range(len(t) - k + 1)})
    frame = spark.createDataFrame([(p,) for p in pieces], "w string")
    at, mark = secrets._slot(frame["w"])
    known = {r["w"] for r in frame.select("w", at.alias("at"), mark.alias("mark")).collect() if lex.words[r["at"]] == r["mark"]}
    assert {"brown", "quick"} <= known
    for t in texts:
        low = t.lower()
        steps = [lex.pairs[(ord(a) - 97) * 26 + ord(b) - 97] for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
        i = covered = 0
        while i < len(low):
            size = next((k for k in reversed(secrets.WORD_SIZES) if low[i : i + k] in known and i + k <= len(low)), 0)
            covered, i = covered + size, i + (size or 1)
        assert got[t] == pytest.approx((np.mean(steps) if steps else 0.0, covered / len(t)))


def test_secrets_of_any_columns(spark, forest):
    key = "AKIA" + "QZ7WM4KXN2LP5RTY"
    names = ["_key", "_secrets", "_words", "_hit", "_p", "_x", "length", "prefix", "word", "path"]
    docs = spark.createDataFrame([(1, f"a {key} b", *names), (1, f"a {key} b", *names), (None, None, *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    clean = secrets.redact(docs, forest)
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([(1, "a [SECRET] b", *names)] * 2 + [(None, None, *names)], key=str)
    found = secrets.scan(docs, forest, keep=("doc_id", "_p", "length", "path"))
    assert [tuple(r)[:6] for r in found.collect()] == [(1, "_p", "length", "path", 1, key)] * 2


def test_secrets_without_digits(documents, forest):
    stripe, base, password, mixed = "sk_live_" + "QwErTyUiOpAsDfGhJkLzXcVb", "kQzWvXpRtLmNbGhJdSfY", "zqkvhwxmpjrtb", "GhTpLkRwQzXvBnMdKs"
    docs = documents([(1, f'x api_key = "{stripe}" y'), (2, f"words secret:{base} words"), (3, f"words password={password} words"), (4, f'set token = "{mixed}" here'), (5, "the internationalization of getUserNameByAddress and SOME_CONSTANT_NAME"), (6, "password authentication thetionerandwhichwas onreonwhndti"), (7, "see https://example.com/en/some-page-with-name now"), (8, "one path/to/some/file and another-long-hyphenated-name"), (9, "words AKIAQZXWMKVXNZLP words"), (10, "x secret=QZXWMKVXNZLPRTYHGQWK y"), (11, "THE GEKEITSCHEINBECH SHOUTS")])
    got = sorted((r["doc_id"], r["secret"]) for r in secrets.scan(docs, forest).collect())
    assert got == [(1, stripe), (2, base), (3, password), (4, mixed), (9, "AKIAQZXWMKVXNZLP"), (10, "QZXWMKVXNZLPRTYHGQWK")]


# ---- nearest neighbours


def exact(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            s = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in good if i != q and i is not None)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST_SIZE", 20)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(60)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] * 8), (305, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    asked = df.where("vec_id % 50 = 0")
    got = {}
    for r in sorted(nearest.search(df, asked, k=5, ratio=9.0, list_size=20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    narrow = [(i, [float(np.float32(x)) for x in v] if v and None not in v and len(v) == 8 else None) for i, v in rows]
    assert got == exact(narrow, {0, 50, 100, 200, 250}, 5)
    assert got[200] == [201, 202, 203, 204, 205]
    few = nearest.search(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]
    assert nearest.search(df.limit(0), df).collect() == [] and nearest.search(df, df.limit(0)).collect() == []


def test_nearest_of_repeated_and_null_ids_and_extreme_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    rows = [(i % 70, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 2 + [(None, v.tolist()) for v in x[:9]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in sorted(nearest.search(df, df.where("vec_id % 50 = 0 or vec_id is null"), ratio=9.0, slack=9.0, replicas=5, list_size=10, piece=1).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50}
    named = [(i, np.array(v)) for i, v in rows if i is not None]
    for q, found in got.items():
        # A query of each row of the id; every other row, repeated ones too, has its best place once.
        best = [(max(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) for i, v in named if i == q), i, k) for k, (i, w) in enumerate(named) if i != q]
        assert len(found) == 5 and max(abs(a - b[0]) for (_, a), b in zip(found, sorted(best, reverse=True))) < 1e-12
    wild = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e308, -1e308]), (3, [5e-324, 0.0]), (4, [3.0, 4.0])]
    scores = {r["vec_id"]: r["score"] for r in nearest.search(spark.createDataFrame(wild, df.schema), spark.createDataFrame(wild[:1], df.schema)).collect()}
    assert {k: round(v, 12) for k, v in scores.items()} == {1: 1.0, 2: 0.0, 3: round(0.5**0.5, 12), 4: round(7 / 5 / 2**0.5, 12)}


@needs_tables
def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    want = exact(table, {i for i, _ in table if i % 50 == 0}, 5)
    got = {}
    for r in nearest.op4_nearest(spark, str(SF)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9
