"""Exact Jaccard self-join of word n-grams by a token-group matrix.

Documents with the same set of n-grams form a *class*; all work is on classes.
Similar classes are put into *groups* by the most frequent of their smallest
token hashes. The token-group matrix holds for each group the union of tokens.

Candidates. Tokens are ordered by hash. Two sets that link share at least
``min(e_a, e_b) + 1`` of their first ``p + e`` tokens, ``p`` being the usual
prefix length and ``e`` a reserve. Tokens that one class alone has fall out at
once. For two groups the tokens that both unions hold are counted, a bound on
what any two of their classes share; only pairs of groups that reach the least
number are opened. Tokens in more than ``MOST_GROUPS`` groups are left out of the
count, and what a class may have lost by that is taken off its bound.

Classes that lose more than their reserve get further groups. Two sets that link
differ in at most ``D`` tokens, which their sizes tell. All tokens are dealt by
hash to more than ``D`` parts, so one part at least is the same in both; the
classes with the same tokens in a part are a group. No pairs are listed for it.

Verification. A group is dealt into chunks, bounded by classes and by tokens. In
a chunk each query is first held against the union of its members' tokens and
only then against the members. Sets already connected are not compared again, so
a group of near copies costs a star and not all pairs. Members that are not
connected with their group's first class are queries to the other chunks.

Tokens that a sample of documents shows to be frequent are dealt to several
tasks. The sample decides on that only, never on what is found.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; a text of fewer than ``size`` words has one
n-gram, the whole sequence; equal sets link; repeated ``doc_id`` values are rows
of their own; a null ``doc_id`` is never the name of a component of others and
the component of a row that links only with such rows is null; an empty table
gives no rows; other columns are ignored. Tokens and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, as_long, cut_words, discard, gram_hashes, mix, only_shared, save, slices, table, unused, word_hashes
from .components import components

SIZE, PERCENT = 4, 85
#: Smallest tokens of a class looked at for its group, and how many of them a group has in common.
LOW, COMMON = 8, 3
MOST_GROUPS = 64
#: Classes of one chunk of a group, queries held against it at once, and about the most tokens of either.
CHUNK, QUERIES, CHUNK_TOKENS = 250, 500, 500_000
#: Documents of the sample for frequent tokens, of how many of them such a token is, and tasks it is dealt to.
SAMPLE, FREQUENT, SALTS = 2000, 20, 256
NONE = (1 << 63) - 1


def prefix(n, percent: int):
    """``p``: a set of ``n`` tokens must show one of its first ``p`` to link."""
    return n - (percent * n + 99) // 100 + 1


def reserve(n, percent: int):
    """``e``: never less for a larger set. Small sets have all their tokens."""
    return np.minimum(n - prefix(n, percent), np.maximum(64, n // 10))


def token_sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, one text after another; and where each begins."""
    w = cut_words(texts, lower=True)
    h = word_hashes(w)
    n = np.diff(w.first)
    doc = w.of()
    grams = gram_hashes(h, size)
    inside = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    tokens, owner = grams[inside], doc[: len(grams)][inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = n[d : d + 1].astype(np.uint64)
            for k in range(w.first[d], w.first[d + 1]):
                x = mix((x * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + 1])
            whole[i] = x[0]
        tokens, owner = np.concatenate([tokens, whole]), np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(texts) + 1))


def fingerprints(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    return mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64))


def _heads(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the first ``count`` entries of each set."""
    return np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batch):
        tokens, first = token_sets(batch.column(1), size)
        low = np.minimum(np.diff(first), LOW)
        ends = np.concatenate([[0], np.cumsum(low)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(tokens[_heads(first, low)])))
        yield {"doc_id": batch.column(0), "n_shingles": np.diff(first), "class": as_long(fingerprints(tokens, first)), "low": lists}

    return arrow_map(docs, ["doc_id", "text"], "doc_id bigint, n_shingles bigint, class bigint, low array<bigint>", run)


def grouped(classes: DataFrame) -> DataFrame:
    """``classes`` with their group ``g``: those with the same most frequent low tokens; a class without such is its own."""
    low = classes.select("class", F.explode("low").alias("t"))
    frequent = low.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = low.join(frequent, "t").groupBy("class").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "t"))), 1, COMMON).alias("top"))  # at most LOW entries
    joined = classes.drop("low").join(top, "class", "left")
    return joined.withColumn("g", F.when(F.size("top") == COMMON, F.xxhash64("top.t")).otherwise(F.col("class"))).drop("top")


def _prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``token`` and ``class`` of the prefix of every document's set, and ``salt``, 0 for tokens that aren't ``frequent`` (ascending)."""

    def run(batch):
        tokens, first = token_sets(batch.column(1), size)
        n = np.diff(first)
        classes, at = np.unique(fingerprints(tokens, first), return_index=True)
        keep = np.zeros(len(n), bool)
        keep[at] = True
        count = np.where(keep & (n > 0), prefix(n, percent) + reserve(n, percent), 0)
        token, class_ = tokens[_heads(first, count)], np.repeat(fingerprints(tokens, first), count)
        salt = np.zeros(len(token), np.int32)
        if len(frequent):
            hit = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token
            salt[hit] = mix(class_[hit]) % np.uint64(SALTS) + np.uint64(1)
        yield {"token": as_long(token), "class": as_long(class_), "salt": salt}

    return arrow_map(docs, ["doc_id", "text"], "token bigint, class bigint, salt int", run)


def prefix_tokens(docs: DataFrame, size: int, percent: int, n_docs: int) -> DataFrame:
    """``token`` and ``class`` of every prefix token that at least two classes have."""
    of = 1 << 30
    taken = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(of)) < min(of, -(-of * SAMPLE // max(1, n_docs))))
    none = np.zeros(0, np.uint64)
    often = _prefixes(taken, size, percent, none).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = often.orderBy(F.desc("n")).limit(100_000).select("token").collect()
    frequent = np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))
    return only_shared(_prefixes(docs, size, percent, frequent), "token", ["class"], distinct=True, salt="salt")


def _e(n, percent: int):
    """``reserve`` as a column."""
    p = n - F.floor((n * percent + 99) / 100) + 1
    return F.least(n - p, F.greatest(F.lit(64), F.floor(n / 10)))


def group_pairs(tokens: DataFrame, groups: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups (``g1``, ``g2``) that may hold a link, and the classes (``class``) that lost too many tokens for that.

    Both inputs can be read again at no great cost. Counts are written before they are joined, so that Spark can split a frequent token.
    """
    n = F.col("n_shingles")
    named = tokens.join(groups.select("class", "g", "n_shingles"), "class")
    cells = save(named.groupBy("token", "g").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")), "matrix")
    spread = save(cells.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1"), "spread")
    lost = tokens.join(spread, "token").groupBy("class").agg(F.count_if(F.col("groups") > most).alias("lost"))
    bounds = save(groups.join(lost, "class", "left").select("class", "g", n, F.coalesce("lost", F.lit(0)).alias("lost"), (F.coalesce("lost", F.lit(0)) > _e(F.floor(n * percent / 100), percent)).alias("heavy")), "bounds")
    of_group = save(bounds.groupBy("g").agg(F.min(_e(n, percent)).alias("e"), F.max("lost").alias("lost")), "bounds")
    few = save(cells.join(spread.where(F.col("groups") <= most).select("token"), "token"), "matrix")  # by itself, so that Spark can split what a frequent token has
    listed = few.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("g", "low", "high"))).alias("x"))  # at most `most` entries
    pairs = listed.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))
    near = (F.col("a.low") * percent <= F.col("b.high") * 100) & (F.col("b.low") * percent <= F.col("a.high") * 100)
    counted = save(pairs.where(near).groupBy(F.col("a.g").alias("g1"), F.col("b.g").alias("g2")).agg(F.count(F.lit(1)).alias("shared")), "counted")
    one, two = (of_group.select(F.col("g").alias(f"g{i}"), F.col("e").alias(f"e{i}"), F.col("lost").alias(f"lost{i}")) for i in "12")
    least = F.greatest(F.lit(1), F.least("e1", "e2") + 1 - F.least("lost1", "lost2"))
    opened = save(counted.join(one, "g1").join(two, "g2").where(F.col("shared") >= least).select("g1", "g2"), "pairs")
    discard(cells, few, spread, counted, of_group)
    return opened, bounds.where("heavy").select("class")


def schemes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """The ways in which a set of ``n`` tokens is dealt into parts: ``(scheme, parts, spare)``.

    Bounds of sizes grow by the least ratio of two that link, so both of a pair are of the smaller one's scheme. There they differ in at most
    ``parts - 1 - spare`` tokens, and so are the same in more than ``spare`` parts.
    """
    bound, k, out = 1, 0, []
    while True:
        above = max(bound + 1, bound * 100 // percent)
        if n <= above:  # of this scheme as the larger one, or as the smaller one, which also is of the next
            differ = bound * (100 - percent) // percent
            spare = 1 + differ // 20
            out.append((k, differ + 1 + spare, spare))
        if n <= bound:
            return out
        bound, k = above, k + 1


def part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of a set: equal for two sets that have the same tokens there. Empty parts have one only where a set has many."""
    hashed, out = mix(tokens ^ np.uint64(0x3C79AC492BA7B653)), []
    for scheme, parts, spare in schemes(len(tokens), percent):
        part = hashed % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashed[order]), dtype=np.uint64)])
        edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        empty = edge[1:] == edge[:-1]
        label = mix(np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme))
        keys = mix((total[edge[1:]] - total[edge[:-1]]) ^ label)
        out.append(keys if empty.sum() > spare else keys[~empty])
    return np.concatenate(out)


def part_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Groups of classes with the same tokens in a part: ``class``, ``n_shingles``, ``g``. ``sets``: ``class`` and ``tokens``. Of equal groups one is kept."""

    def run(batch):
        for class_, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = np.frombuffer(raw.as_buffer(), np.uint64)
            keys = part_keys(tokens, percent)
            yield {"g": as_long(keys), "class": np.full(len(keys), class_), "n_shingles": np.full(len(keys), len(tokens))}

    keyed = save(arrow_map(sets, ["class", "tokens"], "g bigint, class bigint, n_shingles bigint", run).distinct(), "parts")
    alike = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.max("class").alias("most"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("all")).where("n > 1")
    one = save(alike.groupBy("n", "least", "most", "all").agg(F.min("g").alias("g")).select("g"), "parts")
    return keyed.join(one, "g", "left_semi")


def linked(a: np.ndarray, n_a, n_b, percent: int):
    """Whether sets of ``n_a`` and ``n_b`` tokens that share ``a`` link."""
    return 100 * a >= percent * (n_a + n_b - a)


def compare(sets: list[np.ndarray], role: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all linked sets of a chunk, and the root of each set. ``role``: 0 member, 1 query, 2 first class of the group."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    members = np.flatnonzero(role != 1)
    flat = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
    owner = np.repeat(members, size[members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, begin = np.unique(flat, return_index=True)
    stop = np.append(begin[1:], len(flat))
    root = np.arange(n)
    links = []
    for q in [*np.flatnonzero(role == 2), *np.flatnonzero(role == 0), *np.flatnonzero(role == 1)]:
        apart = members[root[members] != root[q]]
        if not len(apart) or not len(union):
            continue
        at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
        at = at[union[at] == sets[q]]
        if 100 * len(at) < percent * size[q]:  # the union's overlap bounds that with any member
            continue
        count = stop[at] - begin[at]
        hits = np.repeat(begin[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        common = np.bincount(owner[hits], minlength=n)
        for m in apart[linked(common[apart], size[q], size[apart], percent)]:
            if root[m] != root[q]:
                links.append((int(q), int(m)))
                a, b = sorted((root[m], root[q]))
                root[root == b] = a
    return links, root


def sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """``class`` and ``tokens`` of the ``needed`` classes, read from one document of each. ``classes``: ``class`` and ``key``, that document."""
    wanted = needed.select("class").distinct().join(classes.select("class", "key"), "class")
    rows = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("key"), "text").join(wanted, "key")

    def read(batch):
        tokens, first = token_sets(batch.column(1), size)
        own = as_long(fingerprints(tokens, first)) == batch.column(0).to_numpy()
        raw = tokens.tobytes()
        keep = np.flatnonzero(own)
        yield {"class": batch.column(0).to_numpy()[keep], "tokens": [raw[8 * first[i] : 8 * first[i + 1]] for i in keep]}

    return arrow_map(rows, ["class", "text"], "class bigint, tokens binary", read)


def verify(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Rows ``a``, ``b``, ``g``: links (``g`` null), and members of many-chunk groups not connected with the first class (``b`` null).

    ``wanted``: ``class``, ``g``, ``role``, ``part``, ``piece``: where each class is needed. ``sets``: ``class`` and ``tokens``.
    """
    names = ["a", "b", "g"]

    def run(chunk: pa.Table) -> pa.Table:
        ids, role = chunk.column("class").to_numpy(), chunk.column("role").to_numpy()
        order = np.lexsort((ids, role == 1, role != 2))
        first = np.ones(len(order), bool)
        first[1:] = ids[order][1:] != ids[order][:-1]
        order = order[first]
        # A class may come from repeated rows, and the first class of a group also as a member.
        _, at = np.unique(ids[order], return_index=True)
        order = order[np.sort(at)]
        ids, role = ids[order], role[order]
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in chunk.column("tokens")]
        links, root = compare([raw[i] for i in order], role, percent)
        out = [(int(ids[a]), int(ids[b]), None) for a, b in links]
        if (role == 2).any() and chunk.column("piece")[0].as_py() == 0:
            base = root[np.flatnonzero(role == 2)[0]]
            out += [(int(i), None, chunk.column("g")[0].as_py()) for i in ids[(role == 0) & (root != base)]]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=names)

    # Dealt by ranges of chunks, which hold about as many rows each: by hash, some tasks would get several full chunks and others none.
    placed = sets.join(wanted, "class").repartitionByRange("g", "part", "piece")
    return placed.groupBy("g", "part", "piece").applyInArrow(run, "a bigint, b bigint, g bigint")


def _placed(groups: DataFrame, queries: DataFrame | None) -> DataFrame:
    """Where members of groups and ``queries`` are needed; both have ``class``, ``n_shingles`` and ``g``."""
    pieces = lambda most: F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n_shingles") / CHUNK_TOKENS)).cast("int")
    plan = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), pieces(CHUNK).alias("parts"), F.min("class").alias("first"))
    if queries is None:
        plan = plan.where("n > 1").withColumn("pieces", F.lit(1))
    else:
        asked = queries.groupBy("g").agg(pieces(QUERIES).alias("pieces"))
        plan = plan.join(asked, "g", "left").where("n > 1 or pieces is not null").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    plan = save(plan, "plan")
    of = lambda c, k: F.pmod(F.xxhash64(F.col("class"), F.lit(k)), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    out = groups.select("class", "g").join(plan, "g").select("class", "g", F.lit(0).alias("role"), of("parts", 1).alias("part"), spread("pieces").alias("piece"))
    firsts = plan.where("parts > 1").select(F.col("first").alias("class"), "g", F.lit(2).alias("role"), "pieces", spread("parts").alias("part")).select("class", "g", "role", "part", spread("pieces").alias("piece"))
    out = out.unionByName(firsts)
    if queries is not None:
        asking = queries.select("class", "g").join(plan, "g").select("class", "g", F.lit(1).alias("role"), of("pieces", 2).alias("piece"), spread("parts").alias("part"))
        out = out.unionByName(asking.select("class", "g", "role", "part", "piece"))
    return out


def links_of(groups: DataFrame, queries: DataFrame | None, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (``a``, ``b``) that connect all linked classes of a group, and queries with it. ``sets`` gives the tokens of classes."""
    places = save(_placed(groups, queries), "places")
    tokens = sets(places)
    found = save(verify(tokens, places, percent), "links")
    loose = save(found.where("b is null").select(F.col("a").alias("class"), "g").distinct(), "loose")
    links = found.where("b is not null").select("a", "b")
    if loose.limit(1).count():
        again = groups.join(loose.select("g").distinct(), "g", "left_semi")
        asking = groups.select("class", "g", "n_shingles").join(loose, ["class", "g"])
        more = save(verify(tokens, save(_placed(again, asking).where("role <> 2"), "places"), percent), "links")
        links = links.unionByName(more.where("b is not null").select("a", "b"))
    discard(places, tokens)
    return links


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, most_groups: int = MOST_GROUPS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``class_id`` (documents with the same set) and ``group_id`` (a class of the component)
    of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = save(signatures(docs, size), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.min(F.coalesce("doc_id", F.lit(NONE))).alias("key"))
    groups = save(grouped(classes), "groups")
    tokens = save(prefix_tokens(docs, size, percent, signed.count()), "tokens")
    pairs, heavy = group_pairs(tokens, groups, percent, most_groups)
    discard(tokens)
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    one, two = (sizes.select(F.col("g").alias(f"g{i}"), F.col("n").alias(f"n{i}")) for i in "12")
    turn = F.struct("n1", "g1") < F.struct("n2", "g2")  # the smaller group asks
    directed = save(pairs.join(one, "g1").join(two, "g2").select(F.when(turn, F.col("g1")).otherwise(F.col("g2")).alias("from"), F.when(turn, F.col("g2")).otherwise(F.col("g1")).alias("g")), "directed")
    queries = directed.join(groups.select(F.col("g").alias("from"), "class", "n_shingles"), "from").select("class", "g", "n_shingles")
    sets = lambda needed: save(sets_of(docs, groups, needed, size), "sets")
    found = links_of(groups, queries, sets, percent)
    if heavy.limit(1).count():
        of_heavy = sets(heavy)
        found = found.unionByName(links_of(save(part_groups(of_heavy, percent), "parts"), None, sets, percent))
        discard(of_heavy)
    labels = components(found).withColumnRenamed("node", "class")
    # Written, so that Spark can split a component with a large share of the classes.
    named = save(groups.select("class", "key").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "labels")
    least = save(named.groupBy("label").agg(F.min("key").alias("component")), "labels")
    component = named.join(least, "label").select("class", "label", "component")
    out = signed.drop("low").join(component, "class", "left")
    own = F.coalesce("component", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(own != NONE, own).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("class")).alias("class_id"), F.col("label").alias("group_id"))


def first_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; documents without words all stay."""
    rows = save(join(docs, size, percent), "components")
    # Whatever the columns of ``docs`` are called.
    id_, class_, n_, tie_ = unused(docs, "_id", "_class", "_n", "_tie")
    named = rows.select(F.coalesce("doc_id", F.lit(NONE)).alias(id_), F.coalesce("class_id", F.lit(0)).alias(class_), "group_id")
    stay = named.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(id_, class_)).alias("s")).select("s.*")
    stay = save(stay.unionByName(named.where("group_id is null").select(id_, class_).distinct()), "stay")
    at, schema = docs.columns.index("text"), docs.withColumns({class_: F.lit(0).cast("bigint"), n_: F.lit(0).cast("bigint")}).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                tokens, first = token_sets(part.column(at), size)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(n > 0, as_long(fingerprints(tokens, first)), 0)), pa.array(n)], names=schema.names)

    classed = docs.mapInArrow(run, schema).withColumn(id_, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)))
    tied = classed.withColumn(tie_, F.when(F.col(n_) == 0, F.monotonically_increasing_id()).otherwise(F.lit(0)))  # repeated rows with words are one
    return tied.join(stay, [id_, class_], "left_semi").dropDuplicates([id_, class_, tie_]).select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS row_no, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)
),
shingles AS (
  SELECT DISTINCT row_no, shingle FROM (
    SELECT row_no, i, n, string_agg(word, ' ') OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM words
  ) WHERE i + 3 <= n OR i = 1
),
sets AS (SELECT row_no, count(*) AS n_shingles, md5(string_agg(md5(shingle), '' ORDER BY shingle)) AS class FROM shingles GROUP BY row_no),
classes AS (SELECT class, min(row_no) AS row_no, any_value(n_shingles) AS n FROM sets GROUP BY class),
tokens AS (SELECT row_no, shingle, n FROM shingles JOIN classes USING (row_no)),
pairs AS (SELECT a.row_no AS x, b.row_no AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.row_no < b.row_no GROUP BY a.row_no, b.row_no),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * (nx + ny - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT row_no AS x, row_no AS y FROM classes UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
labels AS (SELECT x AS row_no, min(y) AS label FROM reach GROUP BY x),
named AS (SELECT s.row_no, l.label, s.n_shingles FROM sets s JOIN classes c USING (class) JOIN labels l ON l.row_no = c.row_no),
components AS (SELECT label, min(doc_id) AS component_id FROM named JOIN texts USING (row_no) GROUP BY label)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM texts LEFT JOIN named USING (row_no) LEFT JOIN components USING (label)
"""
