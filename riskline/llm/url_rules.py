"""URL rules as a sort-merge range join, in DataFrame operations only.

A host becomes a key of its labels in reverse, each with a dot behind it (``www.example.com`` gives
``com.example.www.``). All hosts that a rule's host covers then begin with the rule's key, so a rule is
an interval of keys, and intervals are nested or disjoint. Where an interval opens or closes, the stack
of open rules changes; the stack at such a point is known from the rules alone (the rules of the host's
own suffixes, an equi-join). A sweep over URLs and points in key order gives every URL the stack that is
open there; the longest rule on it whose path prefix fits decides.

Rows are dealt to buckets by hash and every bucket holds all points, so a host with a third of all rows,
or one URL repeated, stays spread out. Points are two per rule host, streamed through a sort: they may
outgrow memory, only the rules of one host chain are held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs such as ``("block", "example.com/en/")`` as a table."""
    return spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")


def _points(rules: DataFrame) -> DataFrame:
    """Where the stack changes: ``key``, ``kind`` (0 opens, 1 closes), ``stack`` after it, longest rule first.

    An interval closes before all keys that sort above its own: at its key with the last dot replaced
    by the character after the dot, as keys only continue behind a dot."""
    r = rules.where(F.col("rule").contains("/")).select(
        "rule", "verdict", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("host"),
        F.expr("substring(rule, locate('/', rule))").alias("prefix"))
    r = r.groupBy("host", "rule", "prefix").agg(F.min("verdict").alias("verdict"))  # a rule given twice: allow wins
    item = F.struct(F.length("rule").alias("size"), "rule", "prefix", "verdict")
    own = r.groupBy("host").agg(F.collect_list(item).alias("own"))
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    suffixes = own.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.struct(
            i.alias("labels"), F.array_join(F.slice(labels, depth - i + 1, i), ".").alias("suffix")))).alias("s"))
    chain = suffixes.join(own.select(F.col("host").alias("suffix"), "own"), F.col("s.suffix") == F.col("suffix"))
    stacks = chain.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("open"),
        F.flatten(F.collect_list(F.when(F.col("suffix") != F.col("host"), F.col("own")))).alias("closed"))
    key = host_key(F.col("host"))
    return stacks.select(F.explode(F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind"), F.sort_array("open", False).alias("stack")),
        F.struct(F.concat(F.expr("substring(%s, 1, length(%s) - 1)" % ((_KEY_SQL,) * 2)), F.lit("/")).alias("key"),
                 F.lit(1).alias("kind"), F.sort_array("closed", False).alias("stack")))).alias("p")).select("p.*")


_KEY_SQL = r"concat(array_join(reverse(split(host, '\\.')), '.'), '.')"


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` has ``rule`` (host, then a path prefix from its first ``/``) and ``verdict``; it fits its
    host and all subdomains where the path begins with the prefix; the longest rule that fits wins, a
    URL without one gets ``otherwise`` and a null rule. Null URLs and those without ``://`` have empty
    host and path and fit no rule. Repeated rows, null and repeated ids each keep a row; a path of
    ``""`` fits no prefix; an empty rules table lets all through to ``otherwise``; rules without ``/``
    are void; other columns of ``pages`` are not read."""
    spark = pages.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(
        F.pmod(F.xxhash64(F.col("id").cast("string"), "host", "path"), F.lit(buckets)).cast("int").alias("bucket"),
        host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), "id", "host", "path")
    points = _points(rules).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    both = rows.unionByName(points, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy(F.col("key").cast("binary"), F.col("kind")).rowsBetween(
        Window.unboundedPreceding, 0)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    fit = F.filter("open", lambda r: F.col("path").startswith(r["prefix"]))
    won = swept.withColumn("won", F.get(fit, F.lit(0)))
    return won.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"),
                      F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict"))
