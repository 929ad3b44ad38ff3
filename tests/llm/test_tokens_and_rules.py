import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import encoding, packing, token_store, url_rules
from tidelog.llm.common import fresh_path

tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "Hello world", "<|endoftext|> ordinary <|endoftext|>", "don't I'll we've", "½ x² ٣٤ Ⅷ", "a\u00a0b\u3000c\x1cd\x85e", "été naïve ß ﬁ", "日本語 テキスト", "🙂🙂 ok", "a\n\n\n b   c \t d  ", "x" * 5000, "__a__ --b-- $$c$$", "\ud7ff", "a_b1c2"]


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(encoding.default_path())


def test_ids_equal_the_library(whole, monkeypatch):
    monkeypatch.setattr(encoding, "GENERATION", 20)
    e = encoding.Encoder(encoding.default_path())
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(8192, 12352), 10, 32])) for _ in range(200)) for _ in range(60)]
    for _ in range(2):
        for text, ids in zip(texts, e.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def ids_of(whole, text):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(documents, whole):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "the", "zz9"]) for _ in range(rng.choice([0, 3, 20, 60, 300])))) for i in range(80)] + [(7, None), (7, None), (None, "a b c"), *((900 + i, t) for i, t in enumerate(ODD))]
    cap = 64
    out = packing.pack_documents(documents(rows), capacity=cap).collect()
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(ids_of(whole, t))
    seen = Counter()
    for r in out:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in by[r["doc_id"]])
        assert r["length"] <= cap and (r["length"] == cap or r["piece"] == 0) and (r["start"] == 0) == (r["piece"] == 0)
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: sum(map(len, x)) for i, x in by.items()}
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-sum(seen.values()) // cap) + 2
    assert packing.pack_documents(documents([])).collect() == []


def test_plans_hold_every_piece_and_search_never_loses():
    rng = random.Random(6)
    for _ in range(150):
        cap = rng.choice([10, 50, 2048])
        items = Counter(rng.randint(1, cap) for _ in range(rng.choice([0, 1, 5, 60, 800])))
        plan = packing.Plan(items, cap)
        before, squares = plan.bins(), sum(n * sum(s) ** 2 for _, n, s in plan.classes)
        plan.improve(20_000)
        assert plan.least <= plan.bins() <= before and sum(n * sum(s) ** 2 for _, n, s in plan.classes) >= squares
        got = Counter()
        for free, n, sizes in plan.classes:
            assert free == cap - sum(sizes) >= 0
            for x in sizes:
                got[x] += n
        assert got == items


def test_local_search_empties_a_bin():
    plan = packing.Plan({}, 10)
    plan.classes, plan.least = [[1, 1, [3, 6]], [1, 1, [4, 5]], [8, 1, [2]]], 2
    assert plan.improve() == 1 and sorted(sum(s) for _, n, s in plan.classes for _ in range(n)) == [10, 10]


def steps_left(classes, cap):
    """Moves, one- and two-for-one exchanges that take tokens from a bin to one at least as full."""
    found = []
    for free, n, low in classes:
        gives = {x for x in low} | {low[i] + low[j] for i in range(len(low)) for j in range(i)}
        for other, m, high in classes:
            if free and 0 < other <= free and (high != low or n > 1):
                found += [(low, high) for d in gives for y in (0, *high) if 0 < d - y <= other]
    return found


def test_search_ends_only_where_no_step_is_left():
    rng = random.Random(8)
    plan = packing.Plan(Counter(rng.randint(250, 500) for _ in range(20_000)), 2048)
    before = plan.bins()
    plan.improve()
    assert plan.least < plan.bins() < before and not steps_left(plan.classes, 2048)


def test_two_for_one_takes_any_pair_of_a_bin():
    plan = packing.Plan({}, 40)
    plan.classes, plan.least = [[21, 1, [4, 6, 9]], [1, 1, [12, 27]]], 1
    plan.improve()
    assert sorted(sizes for _, _, sizes in plan.classes) == [[4, 9, 27], [6, 12]]


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        h = token_store.PerfectHash.build(keys)
        assert np.array_equal(np.sort(h.slots(keys)), np.arange(len(keys)))


def fewest_bins(sizes, capacity):
    """The optimum by trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {free: k for k, free in enumerate(bins) if free >= sizes[i]}.values():
            place(i + 1, [free - sizes[i] * (k == b) for k, free in enumerate(bins)])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def test_packing_near_the_optimum_of_small_inputs():
    rng = random.Random(21)
    over = 0
    for _ in range(150):
        sizes = sorted((rng.randrange(2, 15) for _ in range(rng.randrange(4, 11))), reverse=True)
        plan = packing.Plan(Counter(sizes), 16)
        plan.improve()
        assert sorted((x for _, n, held in plan.classes for x in held * n), reverse=True) == sizes and all(sum(held) <= 16 for _, _, held in plan.classes)
        over += plan.bins() - fewest_bins(sizes, 16)
    assert over <= 3


def test_a_file_that_cuts_otherwise_goes_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidelog.llm.encoding import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World's 123 tests", "", "ünïcode\n\n x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode_all(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_a_frequent_length_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 7)
    pieces = spark.createDataFrame([(i, 0, 0, 10 if i % 3 else 5, i) for i in range(200)], packing.PIECES)
    got = packing.numbered(pieces, {10: 133, 5: 67}).collect()
    for length, n in ((10, 133), (5, 67)):
        assert sorted(r["number"] for r in got if r["length"] == length) == list(range(n))


def test_shards(spark, documents, whole):
    rows = [(i * 3, "text number %d of many" % i) for i in range(200)] + [(5, "a"), (5, "b"), (5, "a"), (None, "null key"), (-7, ""), (9, None)]
    manifest = token_store.write_shards(documents(rows), fresh_path(spark, "test-tokens"), limit=700)
    assert manifest.count() > 3
    got = token_store.read_back(manifest).collect()
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t in rows for x in [ids_of(whole, t)])
    assert sorted(x.tolist() for x in token_store.lookup(manifest, 5)) == sorted(ids_of(whole, t).tolist() for t in "aba")
    assert token_store.lookup(manifest, 4) == [] and token_store.lookup(manifest, 1 << 40) == []
    assert token_store.read_back(token_store.write_shards(documents([]), fresh_path(spark, "none"))).collect() == []


def test_a_lookup_reads_few_bytes(tmp_path):
    rng = np.random.default_rng(2)
    for n in (1, 50, 30_000):
        keys = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.int64)
        ids = [rng.integers(0, 50_000, 1 + k % 7).astype("<u4").tobytes() for k in range(n)]
        path = tmp_path / f"{n}.tok"
        path.write_bytes(token_store.shard_bytes(keys, ids, n == 50))
        whole = token_store.Shard(path.read_bytes())
        with path.open("rb") as f:
            for k in rng.choice(n, min(n, 200), replace=False):
                shard = token_store.OpenShard(f)
                (got,) = shard.get(int(keys[k]))
                assert got.tobytes() == ids[k] == whole.get(int(keys[k]))[0].tobytes() and shard.reads < 1000
                assert token_store.OpenShard(f).get(int(keys[k]) + (1 << 41)) == [] == whole.get(int(keys[k]) + (1 << 41))


def test_a_cut_shard_is_refused():
    data = token_store.shard_bytes(np.array([1, 2]), [b"\1\0\0\0", b"\2\0\0\0"], False)
    with pytest.raises(ValueError):
        token_store.Shard(data[:-1])
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 100)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "", "block"), ("net", "/es/x/", "allow"), ("net", "/es/", "allow"), ("org", "/\U0001f642", "block"), (None, "/", "block"), ("x.com", None, "block")]


def plain_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for h, p, v in rules:
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v)
            best = max(best, (key, h + p)) if best else (key, h + p)
    return host, path, best[1] if best else None, best[0][2] if best else default


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "xexample.com", "a.b.net", "c.a.b.net", "net", "b.net", "org", "x.com", "", "..", "com.", ".com"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/x/y", "/es/", "/fr/", "/\U0001f642/z", "/%20", "//"]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?a#b'])}" for s in ("http", "https", "x") for _ in range(150)]
    urls += [None, "", "no scheme", "http:/one", "http://a\nb.com/en/", "a://b://c.com/", "http://com/" * 50]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: plain_judge(u, RULES) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), rules).collect() == []


def test_url_rules_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows: what is open at a range's end must be handed to the ranges after it."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    rng = random.Random(12)
    rules = [(".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), "/" + "".join(rng.choice(["x/", "y/"]) for _ in range(rng.randrange(0, 4))), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{'.'.join(rng.choice('abcd') for _ in range(rng.randrange(1, 5)))}/{''.join(rng.choice(['x/', 'y/', 'z']) for _ in range(rng.randrange(0, 6)))}{i if i % 3 else ''}" for i in range(20_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    monkeypatch.setattr(url_rules.stacks_of, "__defaults__", (7,))
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: plain_judge(u, rules) for i, u in enumerate(urls)}


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = url_rules.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
