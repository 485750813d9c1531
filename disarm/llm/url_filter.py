"""URL filters: longest matching host-and-path rule, found by a sorted sweep over reversed hosts.

A reversed host (``net.example.www``) turns "this host and all its subdomains" into an interval of sorted
keys, and such intervals nest. Distinct hosts and rules are sorted together and cut into ranges. The sweep
keeps a stack with one slot for each number of labels: the rule host last opened there. A slot is active
for a host while the host's key lies in the slot's interval. Each range starts from the slots that the
ranges before it left open. The path, and the choice of the longest rule, are settled in the page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disarm.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABELS = 127  # in a host name, at most
_END = "\x01"  # closes each label of a key


def url_host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null or a url without it."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path between the host and ``?``, ``#`` or the end; empty for null or a url without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a character that sorts before all that hosts have."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), _END), F.lit(_END))


def _rule_hosts(rules: DataFrame) -> DataFrame:
    """One row per rule host: key, depth and its rules. A rule without host, path or verdict is void."""
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), F.col("verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
    )
    named = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna().where("host <> ''")
    return named.distinct().groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_list(rule).alias("rules")
    ).withColumn("depth", F.size(F.split("key", _END)) - 1)


def _sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules whose interval holds its key: the active part of the stack."""
    spark = hosts.sparkSession
    opened = _rule_hosts(rules)
    # at most 127 labels fit in a host name, so the stack has few slots whatever the number of rules
    deepest = opened.agg(F.max("depth")).first()[0] or 0
    if deepest > LABELS:
        raise ValueError(f"a rule host has {deepest} labels, at most {LABELS} fit in a host name")
    depths = sorted(r[0] for r in opened.select("depth").distinct().collect())
    if not depths:
        return hosts.select("host", F.lit(None).cast("array<struct<size:int,host_size:int,rule:string,verdict:string,rule_host:string,rule_path:string>>").alias("fitting")).where("false")
    events = opened.select("key", F.lit(0).alias("kind"), "depth", "rules", F.lit(None).cast("string").alias("host")).unionByName(
        hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"),
                     F.lit(None).cast(opened.schema["rules"].dataType).alias("rules"), "host"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(events.repartitionByRange(width, "key", "kind", "host").withColumn("part", F.spark_partition_id()), "url-sweep")
    slot = F.struct("key", "rules")
    so_far = W.partitionBy("part").orderBy("key", "kind", "host").rowsBetween(W.unboundedPreceding, 0)
    ends = cut.where("kind = 0").groupBy("part").agg(
        *[F.max_by(slot, F.when(F.col("depth") == d, F.col("key"))).alias(f"end{d}") for d in depths],
        *[F.max((F.col("depth") == d).cast("int")).alias(f"has{d}") for d in depths])
    # one row per range: few, whatever the number of hosts
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = cut.select("part").distinct().join(ends, "part", "left")
    carried = parts.select("part", *[
        F.last(F.when(F.col(f"has{d}") == 1, F.col(f"end{d}")), ignorenulls=True).over(before).alias(f"carry{d}") for d in depths])
    swept = cut.select(
        "part", "key", "kind", "host",
        *[F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), slot), ignorenulls=True).over(so_far).alias(f"slot{d}") for d in depths],
    ).where("kind = 1").join(carried, "part", "left")
    stack = F.array(*[F.coalesce(f"slot{d}", f"carry{d}") for d in depths])
    active = F.filter(stack, lambda s: s.isNotNull() & F.col("key").startswith(s["key"]))
    fitting = F.filter(
        F.flatten(F.transform(active, lambda s: s["rules"])),
        lambda r: (F.col("host") == r["rule_host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["rule_host"])))
    return swept.select("host", fitting.alias("fitting")).where(F.size("fitting") > 0)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict, for ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
    (host and path together, then host, then by text) wins. Without one, the rule is null and the verdict
    is ``default``. Null urls have an empty host and path. Repeated rules count once; conflicting ones of
    equal text are settled towards the verdict that sorts last. Columns of ``pages`` named like the four
    new ones are replaced; an empty table of either kind is fine. The rules of one host travel as one
    value and should number in the thousands at most. A rule host of more than 127 labels is an error.
    """
    made = ("host", "path", "rule", "verdict")
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in made])
    named = pages.select(page.alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    fitting = _sweep(named.select("host").distinct(), rules)
    longest = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return named.join(fitting, "host", "left").withColumn("won", longest).select(
        "page.*", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
