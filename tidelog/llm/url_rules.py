"""Allow and block rules for URLs by a sort-merge range join, with DataFrame functions only.

A host is turned round by labels, ``www.example.com`` into ``com,example,www,``.
A rule's key is its turned host, a separator, and its path; a URL has a key for
each suffix of its host. A rule covers exactly the URL keys that start with its
own, an interval in key order, and two such intervals nest or are apart. So one
ordered sweep over rules and URL keys suffices. It keeps the stack of rules that
are open: at a rule's key those that the key doesn't start with have ended, and
the rule goes on top. The last rule begun before a URL key carries the stack as
it stood there. The sweep runs in key ranges, which are written once with their
numbers, and each range takes over what was open when the range before it ended.

Distinct (host, path) pairs are judged once, so a page that is there a million
times costs one key; a host with many pages spreads over ranges by path.

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule; repeated URLs get a row each; of equal rules on one (host, path)
``block`` wins; of rules with equally long text the one with the longer host
wins; with no rules every URL gets the default; rules with a null host or path
are left out; further columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

#: Below every character of a host or path that the sweep has to order.
SEPARATOR = "\u0001"
#: Rules of one range of the sweep over rules.
RANGE_RULES = 1000

# The rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def turned(host: Column) -> Column:
    """``www.example.com`` as ``com,example,www,``."""
    return F.concat_ws("", F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit(","))))


def suffixes(host: Column) -> Column:
    """The turned keys of a host and of every domain above it."""
    labels = F.reverse(F.split(host, r"\."))
    one = lambda i: F.concat_ws("", F.transform(F.slice(labels, F.lit(1), i), lambda x: F.concat(x, F.lit(","))))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), one)


def _still(stack: Column, key: Column) -> Column:
    """Of a stack the rules that are open at ``key``."""
    return F.filter(stack, lambda r: key.startswith(r["at"]))


def stacks_of(rules: DataFrame, range_rules: int = RANGE_RULES) -> DataFrame:
    """``key`` of each distinct rule and ``stack``: itself and all rules whose intervals hold its key, innermost first."""
    base = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.lower("host").alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' over 'allow'
        .withColumn("at", F.concat(turned(F.col("host")), F.lit(SEPARATOR), F.col("path")))
        .select("at", F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_size"))
    )
    parts = max(1, -(-base.count() // range_rules))
    # Numbered and written once: dealt again, the ranges could be others.
    dealt = save(base.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()), "rules")
    entry = "struct<at:string,rule:string,verdict:string,host_size:int>"
    none = lambda kind: F.array().cast(f"array<{kind}>")
    onto = lambda stack, r: F.concat(F.array(r), _still(stack, r["at"]))
    begun = F.struct(none(entry).alias("open"), none(f"array<{entry}>").alias("stacks"))

    def step(state: Column, r: Column) -> Column:
        return F.struct(onto(state["open"], r).alias("open"), F.concat(state["stacks"], F.array(onto(state["open"], r))).alias("stacks"))

    rows = F.array_sort(F.collect_list(F.struct("at", "rule", "verdict", "host_size")))  # about range_rules
    swept = dealt.groupBy("part").agg(rows.alias("rules")).withColumn("state", F.aggregate("rules", begun, step))
    ranges = swept.select("part", F.col("rules")[0]["at"].alias("first"), F.element_at("rules", -1)["at"].alias("last"), F.col("state.open").alias("open"), F.col("state.stacks").alias("stacks"))
    # What is open where each range begins: a step per range.
    carried = f"struct<part:int,open:array<{entry}>>"
    start = F.struct(none(entry).alias("open"), none(carried).alias("ranges"))

    def over(state: Column, x: Column) -> Column:
        before = _still(state["open"], x["first"])
        return F.struct(F.concat(x["open"], _still(before, x["last"])).alias("open"), F.concat(state["ranges"], F.array(F.struct(x["part"].alias("part"), before.alias("open")).cast(carried))).alias("ranges"))

    ends = ranges.agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "open"))).alias("x")).select(F.explode(F.aggregate("x", start, over)["ranges"]).alias("r"))
    both = ranges.select("part", F.explode("stacks").alias("stack")).join(ends.select(F.col("r.part").alias("part"), F.col("r.open").alias("before")), "part")
    key = F.col("stack")[0]["at"]
    return both.select(key.alias("key"), F.concat("stack", _still(F.col("before"), key)).alias("stack"))


def sweep(points: DataFrame, stacks: DataFrame) -> DataFrame:
    """Add to each point (``key`` and more) ``hit``: the innermost rule whose key starts its key, else null.

    ``points`` are dealt into ranges of key and other columns with the rules; the last rule of a range is handed to those after it.
    """
    columns = [c for c in points.columns if c != "key"]
    nothing = stacks.schema["stack"].dataType
    both = stacks.select("key", F.lit(0).alias("kind"), "stack", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns)).unionByName(
        points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(nothing).alias("stack"), *columns)
    )
    # Dealt out once and written: the same ranges for the rows and for what is handed on. A frequent key spreads by the other columns.
    ranged = save(both.repartitionByRange("key", "kind", *columns).withColumn("part", F.spark_partition_id()), "sweep")
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("last", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    ends = ranged.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("end"))  # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before)["stack"].alias("carried"))
    joined = swept.join(F.broadcast(carried), "part", "left")  # as many rows as ranges
    return joined.select("key", *columns, F.get(_still(F.coalesce("last", "carried"), F.col("key")), F.lit(0)).alias("hit"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page; ``rules`` has ``host``, ``path`` and ``verdict``."""
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    distinct = parsed.select("host", "path").distinct()
    points = distinct.select(F.explode(suffixes(F.col("host"))).alias("suffix"), "host", "path").select(F.concat("suffix", F.lit(SEPARATOR), "path").alias("key"), "host", "path")
    hits = sweep(points, stacks_of(rules)).where("hit is not null")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("hit.rule").alias("size"), "hit.host_size", "hit.verdict", "hit.rule")).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP8_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS row_no
  FROM pages
),
hit AS (
  SELECT row_no, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY row_no
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN hit USING (row_no)
"""
