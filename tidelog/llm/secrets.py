"""Secret scans with a random forest that removes false findings; DataFrame functions and JVM learners only.

A *candidate* is a run of at least ``MIN_LENGTH`` letters, digits and ``+/_-``
inside one word that holds a letter; that it looks like a secret is the forest's
to say. It is described by its length, the transitions between kinds of
characters and from letter to letter, its digits, its coverage by dictionary
words, the path it was found under, and the words beside it. A random forest
trained from labelled findings keeps the real ones.

The letter pairs of the lower-case words of a public vocabulary file give the
probability of each transition, and the ``WORDS`` most common of them are the
dictionary. Whether a piece of a candidate is a word is asked of a small table, which
plans can carry: a byte of the hash at the place the hash gives. One word in twenty
or so gives way to another there, and hardly any other piece passes.

The labelled findings are a parameter. The default table is made by rule from
public key formats (true) and from the look-alikes a scanner trips over (false):
commit and file hashes, UUIDs, dates, phone and card numbers, URLs, identifiers,
placeholders and words run together.

Defined cases: a null or empty text has no candidates; every occurrence is a
row; repeated documents have their findings as often as they are there; a null
path counts as one with nothing in it, and so does a table without a column for
it; an empty table gives no rows; other columns, whatever their names, are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table, unused

MIN_LENGTH = 12
MASK = "[SECRET]"
#: Kinds of labelled findings.
FORMS = 41

# Words that speak for a secret, words that speak against one, parts of paths of files without real ones, common parts of words.
FOR = "password passwd pwd secret token apikey api_key key auth bearer credential credentials private access client_secret".split()
AGAINST = "commit sha sha1 sha256 md5 hash checksum digest uuid guid id etag version build revision isbn phone tel date example sample placeholder page url href".split()
HARMLESS_PATHS = "test tests example examples fixture fixtures sample samples docs mock".split()
DICTIONARY = (
    "the and that with for from this have not are was will can all one out use get set has new time name data file user page test main code "
    "list item type size index value count error info config example sample placeholder change default admin server client version build release image "
    "style layout header footer button content article section number string object class function return public static final about which their there "
    "would other after first also into could than them these only some what when your more over such make like back work well even want because"
).split()

FEATURES = ["length", "transitions", "letter_pairs", "digit_share", "upper_share", "lower_share", "hex", "common_words", "coverage", "vowel_share", "distinct_share", "dashes", "slashes", "quoted", "assigned", "word_for", "word_against", "path_harmless", "prefix"]


#: Words of the dictionary, bytes of its table, and lengths of the words looked up.
WORDS, SLOTS, WORD_SIZES = 3000, 1 << 15, (4, 5, 6, 7, 8)


class Lexicon(NamedTuple):
    """``pairs``: log probability of each letter after each, 26 x 26. ``words``: the table of words."""

    pairs: list[float]
    words: bytes


def _slot(word: Column) -> tuple[Column, Column]:
    """Place and mark of a word in the table."""
    h = F.xxhash64(word)
    return F.pmod(h, F.lit(SLOTS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(255)).cast("int") + 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lexicon(spark: SparkSession, vocabulary: str | None = None) -> Lexicon:
    """From the words of lower-case ASCII letters that a tokenizer file has with a space before them."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    # The earlier a piece is in the file, the more common it is.
    words = [w[1:] for w in sorted(pieces, key=pieces.get) if w[:1] == "\u0120" and len(w) > 3 and w[1:].isascii() and w[1:].isalpha() and w[1:].islower()]
    counts = [[0.5] * 26 for _ in range(26)]
    for w in words:
        for a, b in zip(w, w[1:]):
            counts[ord(a) - 97][ord(b) - 97] += 1
    pairs = [math.log(n / sum(row)) for row in counts for n in row]
    marks = bytearray(SLOTS)
    known = spark.createDataFrame([(w,) for w in words if len(w) in WORD_SIZES][:WORDS], "w string")
    at, mark = _slot(F.col("w"))
    for r in known.select(at.alias("at"), mark.alias("mark")).orderBy("at", "mark").collect():
        marks[r["at"]] = r["mark"]
    return Lexicon(pairs, bytes(marks))


def _letter_pairs(s: Column, lex: Lexicon) -> Column:
    """Mean log probability of the transitions between the letters of ``s`` that stand side by side; 0 if there are none."""
    codes = F.transform(F.split(F.lower(s), ""), lambda c: F.ascii(c) - 97)
    table_ = F.lit(lex.pairs)
    letter = lambda x: (x >= 0) & (x < 26)
    steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.when(letter(a) & letter(b), F.get(table_, a * 26 + b)))
    sums = F.aggregate(steps, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("n")), lambda acc, x: F.struct((acc["t"] + F.coalesce(x, F.lit(0.0))).alias("t"), (acc["n"] + F.when(x.isNull(), 0.0).otherwise(1.0)).alias("n")))
    return F.when(sums["n"] > 0, sums["t"] / sums["n"]).otherwise(0.0)


def _word_share(s: Column, lex: Lexicon) -> Column:
    """Share of the characters of ``s`` under words of the dictionary, taken from the left, the longest first."""
    low, marks = F.lower(s), F.lit(bytearray(lex.words))

    def known(piece: Column) -> Column:
        at, mark = _slot(piece)
        return F.hex(F.substring(marks, at + 1, F.lit(1))) == F.lpad(F.hex(mark), 2, "0")

    def step(end: Column, i: Column) -> Column:
        sizes = F.array(*(F.lit(k) for k in reversed(WORD_SIZES)))
        size = F.coalesce(F.get(F.filter(sizes, lambda k: (F.length(low) - i >= k - 1) & known(F.substring(low, i, k))), F.lit(0)), F.lit(0))
        return F.when((i >= end["at"]) & (size > 0), F.struct((i + size).alias("at"), (end["n"] + size).alias("n"))).otherwise(end)

    walked = F.aggregate(F.sequence(F.lit(1), F.length(s)), F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), step)
    return walked["n"] / F.length(s)


def _any_of(words: list[str]) -> str:
    return "(?i)(^|[^a-z])(" + "|".join(words) + ")($|[^a-z])"


def candidates(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, and for each candidate ``word_no`` (from 0), ``secret`` and what its features are made of."""
    kept = [F.col(c) for c in docs.columns if c != text]
    words = F.split(F.trim(F.regexp_replace(F.col(text), r"[\x00-\x20]+", " ")), " ")
    run = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
    # Whole texts without such a run are passed over before their words are cut.
    there = docs.where(F.col(text).rlike(run)).select(*kept, words.alias("_words"))
    named = F.transform("_words", lambda w, i: F.struct(i.alias("no"), w.alias("word")))
    hits = there.select(*kept, "_words", F.explode(F.filter(named, lambda x: (F.length(x["word"]) >= MIN_LENGTH) & x["word"].rlike(run))).alias("_hit"))
    near = lambda d: F.coalesce(F.get("_words", F.col("_hit.no") + d), F.lit(""))
    word = F.col("_hit.word")
    found = F.explode(F.filter(F.regexp_extract_all(word, F.lit(f"({run})"), F.lit(1)), lambda x: x.rlike("[A-Za-z]")))
    named_hits = hits.select(*kept, F.col("_hit.no").alias("word_no"), word.alias("word"), F.concat_ws(" ", near(-2), near(-1)).alias("before"), near(1).alias("after"), found.alias("secret"))
    return named_hits.withColumn("path", F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit(""))


def described(found: DataFrame, lex: Lexicon) -> DataFrame:
    """``found`` with ``FEATURES`` as doubles, from ``secret``, ``word``, ``before``, ``after`` and ``path``."""
    s = F.col("secret")
    n = F.length(s)
    count = lambda pattern, of=s: F.length(F.regexp_replace(of, f"[^{pattern}]", ""))
    kinds = F.translate(F.translate(F.translate(s, "abcdefghijklmnopqrstuvwxyz", "l" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u" * 26), "0123456789", "d" * 10)
    head = F.call_function("substring_index", F.col("word"), s, F.lit(1))
    context = F.concat_ws(" ", "before", head)
    covered = n - F.length(F.regexp_replace(s, "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    flag = lambda c: c.cast("double")
    columns: dict[str, Column] = {
        "length": n.cast("double"),
        "transitions": (n - F.length(F.regexp_replace(kinds, r"(.)(?=\1)", ""))).cast("double"),
        "digit_share": count("0-9") / n,
        "upper_share": count("A-Z") / n,
        "lower_share": count("a-z") / n,
        "hex": flag(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "common_words": covered / n,
        "coverage": _word_share(s, lex),
        "letter_pairs": _letter_pairs(s, lex),
        "vowel_share": count("aeiouAEIOU") / n,
        "distinct_share": F.size(F.array_distinct(F.split(s, ""))) / n,
        "dashes": count("_-").cast("double"),
        "slashes": (count("/") + F.when(F.col("word").contains("://"), 3).otherwise(0)).cast("double"),
        "quoted": flag(head.rlike("[\"'`]$")),
        "assigned": flag(context.rlike("(=|:)\\s*[\"'`]?\\s*$")),
        "word_for": flag(context.rlike(_any_of(FOR))),
        "word_against": flag(F.concat_ws(" ", context, "after").rlike(_any_of(AGAINST))),
        "path_harmless": flag(F.col("path").rlike(_any_of(HARMLESS_PATHS))),
        "prefix": flag(s.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|AIza|glpat-|eyJ)")),
    }
    return found.select("*", *(columns[f].alias(f) for f in FEATURES))


def labelled_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """``n`` findings made by rule: ``secret``, ``word``, ``before``, ``after``, ``path`` and ``label``."""
    base = spark.range(n).select("id", F.pmod("id", F.lit(FORMS)).alias("kind"))
    part = lambda salt: F.md5(F.concat_ws("-", F.lit(salt), F.col("id")))
    hexes = F.concat(part("a"), part("b"), part("c"))
    upper = F.translate(F.upper(hexes), "0189", "QXYZ")
    mixed = F.translate(F.base64(F.unhex(hexes)), "=", "")
    letters = F.translate(mixed, "0123456789+/", "ghkmpqrtvwXZ")
    lower = F.lower(letters)
    pick = lambda words, salt: F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    phrase = lambda k, sep: F.concat_ws(sep, *(pick(DICTIONARY, f"w{i}") for i in range(k)))
    size = lambda low, high: (F.pmod(F.xxhash64(F.lit("size"), "id"), F.lit(high - low + 1)) + low).cast("int")
    camel = lambda k: F.translate(F.initcap(phrase(k, " ")), " ", "")
    lit, none = F.lit, F.lit("")
    key = pick(["password", "secret", "token", "api_key", "apikey", "auth", "passwd", "client_secret"], "key")
    plain = pick(["the", "over", "which", "was", "and", "of", "un", "der", "que", "in"], "plain")
    short = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(9000)) + 1000
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    # label, value, text before the value in its word, word before
    forms: list[tuple[int, Column, Column, Column]] = [
        (1, F.concat(lit("AKIA"), F.substring(upper, 1, 16)), none, plain),
        (1, F.concat(lit("AKIA"), F.substring(upper, 1, 16)), none, plain),
        (1, F.substring(hexes, lit(1), size(16, 24)), F.concat(key, lit("=")), plain),
        (1, F.substring(hexes, lit(1), size(16, 24)), F.concat(key, lit("=")), plain),
        (1, F.substring(hexes, lit(1), size(32, 64)), lit('"'), F.concat(key, lit(" ="))),
        (1, F.substring(hexes, lit(1), size(32, 64)), lit('"'), F.concat(key, lit(" ="))),
        (1, F.concat(lit("ghp_"), F.substring(mixed, 1, 36)), none, plain),
        (1, F.concat(lit("sk_live_"), F.substring(mixed, 1, 24)), lit('"'), F.concat(key, lit(" ="))),
        (1, F.substring(mixed, lit(1), size(20, 44)), F.concat(key, lit(":")), plain),
        (0, F.substring(hexes, 1, 40), none, pick(["commit", "sha1", "revision", "build"], "c")),
        (0, F.substring(hexes, lit(1), lit(64)), none, pick(["sha256", "checksum", "digest", "hash"], "c")),
        (0, F.substring(hexes, 1, 32), F.concat(pick(["md5", "etag", "hash", "id"], "c"), lit("=")), plain),
        (0, uuid, none, pick(["uuid", "id", "guid", "the", "of"], "c")),
        (0, F.concat(phrase(3, "_"), short.cast("string")), none, plain),
        (0, F.concat(phrase(4, ""), short.cast("string")), none, plain),
        (0, F.concat(phrase(3, "-"), lit("-"), short.cast("string")), lit("https://example.com/en/"), plain),
        (0, F.concat(lit("2024-01-15T"), F.substring(short.cast("string"), 1, 2), lit("00Z")), none, pick(["date", "on", "at"], "c")),
        (0, F.concat(lit("555-"), short.cast("string"), lit("-x"), short.cast("string")), none, pick(["phone", "tel", "call"], "c")),
        (0, F.concat(lit("change"), phrase(2, ""), lit("123")), F.concat(key, lit("=")), pick(["example", "sample", "placeholder"], "c")),
        (0, F.concat(lit("example"), phrase(2, "_"), lit("12345")), lit('"'), F.concat(key, lit(" ="))),
        # without digits
        (1, F.substring(letters, lit(1), size(12, 40)), F.concat(key, lit("=")), plain),
        (1, F.substring(letters, lit(1), size(12, 44)), lit('"'), F.concat(key, lit(" ="))),
        (1, F.substring(lower, lit(1), size(12, 24)), F.concat(key, lit("=")), plain),
        (1, F.substring(lower, lit(1), size(12, 24)), lit('"'), F.concat(key, lit(" ="))),
        (1, F.concat(pick(["sk_live_", "ghp_", "glpat-"], "prefix"), F.substring(letters, lit(1), size(20, 36))), none, plain),
        (0, phrase(4, ""), none, plain),
        (0, phrase(4, ""), none, key),
        (0, phrase(4, ""), F.concat(pick(["note", "see", "name", "title"], "c"), lit("=")), plain),
        (0, F.substring(lower, lit(1), size(12, 24)), none, plain),
        (0, F.substring(lower, lit(1), size(12, 24)), none, key),
        (0, F.substring(lower, lit(1), size(12, 24)), lit('"'), plain),
        (0, F.upper(F.substring(lower, lit(1), size(12, 24))), none, plain),
        (0, F.upper(phrase(4, "")), none, plain),
        (0, F.initcap(F.substring(lower, lit(1), size(12, 24))), none, plain),
        (0, phrase(3, "_"), none, plain),
        (0, F.upper(phrase(3, "_")), none, plain),
        (0, phrase(3, "-"), lit("https://example.com/en/"), plain),
        (0, phrase(3, "/"), none, plain),
        (0, camel(3), none, plain),
        (0, camel(3), F.concat(key, lit("=")), plain),
        (0, phrase(3, "_"), lit('"'), F.concat(key, lit(" ="))),
    ]
    assert len(forms) == FORMS
    choose = lambda at: F.element_at(F.array(*(x[at] if isinstance(x[at], Column) else F.lit(x[at]) for x in forms)), (F.col("kind") + 1).cast("int"))
    return base.select(choose(0).alias("label"), choose(1).alias("secret"), F.concat(choose(2), choose(1)).alias("word"), choose(3).alias("before"), none.alias("after"), pick(["", "src/app.py", "tests/fixture.json", "web"], "path").alias("path"))


class Model(NamedTuple):
    forest: PipelineModel
    lexicon: Lexicon


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7, vocabulary: str | None = None) -> Model:
    """A forest over the described ``findings`` (``label`` 0 or 1); a table of findings is reviewed by hand and so small.

    The rows are put in one order in one partition, so that the forest is the same on any cluster.
    """
    lex = lexicon(findings.sparkSession, vocabulary)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
    rows = described(findings, lex).select("label", "secret", "word", *FEATURES)
    placed = rows.repartition(1).sortWithinPartitions("label", "secret", "word", *FEATURES).select("label", *FEATURES)
    return Model(Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_x"), forest]).fit(placed), lex)


def scan(docs: DataFrame, model: Model, text: str = "text", path: str | None = "source", threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``word_no``, ``secret`` and ``score`` of every finding that the forest takes for real."""
    held = [f"_kept{i}" for i in range(len(keep))]  # names that clash with none of the features
    there = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    wanted = docs.select(*(F.col(c).alias(h) for c, h in zip(keep, held)), F.col(text).alias("_text"), there.alias("_path"))
    scored = model.forest.transform(described(candidates(wanted, "_text", "_path"), model.lexicon))
    found = scored.select(*held, "word_no", "secret", vector_to_array("_p")[1].alias("score")).where(F.col("score") >= threshold)
    return found.select(*(F.col(h).alias(c) for h, c in zip(held, keep)), "word_no", "secret", "score")


def redact(docs: DataFrame, model: Model, text: str = "text", path: str | None = "source", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; a column ``n_chars`` is set to the new length where there is one."""
    key, secrets = unused(docs, "_key", "_secrets")
    rows = docs.withColumn(key, F.xxhash64(F.col(text), F.length(text), *([F.col(path)] if path in docs.columns else [])))
    found = scan(rows, model, text, path, keep=(key,)).groupBy(key).agg(F.array_sort(F.collect_set("secret"), lambda a, b: F.length(b) - F.length(a)).alias(secrets))
    # Written, so that the join is of plain tables and Spark can split a text that many rows have.
    changed = rows.join(save(found, "secrets"), key, "left")
    new = F.aggregate(F.coalesce(secrets, F.array().cast("array<string>")), F.col(text), lambda acc, s: F.replace(acc, s, F.lit(mask)))
    out = changed.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(secrets) > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
