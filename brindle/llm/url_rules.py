"""URL allow and block rules by a sort-merge range join (native).

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest rule (host and path together, then the longer host) wins.

A url is probed once for each suffix of its host that is as deep as some rule's.  A probe's
canonical key is the reversed host suffix and the path; a rule turns into the interval of keys
with its own key as prefix.  Probes and interval ends are shuffled together, sorted, and swept:
an opening end puts its rule on top of the stack of nested rules, a closing end (key and byte
0xFF, above any UTF-8) uncovers the rule below.  Prefix intervals nest or are disjoint, so each
end carries the top of the stack that it leaves, and the sweep is a running last value.

A host with very many urls is dealt out to several sorted runs, to each of which its rules' ends
are copied; a host gets no more copies than it has urls to pay for them.

Defined cases: a url that is null or has no '://' has empty host and path, which only a rule with
empty host fits; repeated pages give repeated rows; of equal rules 'block' holds; with no rules
all urls get the default; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

RUN = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def url_parts(url):
    """Host and path columns of a url column."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(labels):
    return F.array_join(F.reverse(labels), ".")


def _key(host, path):
    return F.concat(host.cast("binary"), F.lit(bytearray(b"\x00")), path.cast("binary"))


def rule_ends(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> host_key, key, state: the rule on top from key on."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(
        reversed_host(F.split("host", r"\.")).alias("host_key"),
        "path",
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("state"),
    )
    # the rule below: the one with the longest proper prefix of the path
    shorter = rules.where(F.length("path") > 0).select(
        "host_key", "path", F.explode(F.expr("transform(sequence(0, length(path) - 1), n -> left(path, n))")).alias("below")
    )
    under = rules.select("host_key", F.col("path").alias("below"), F.col("state").alias("under"))
    under = shorter.join(under, ["host_key", "below"]).groupBy("host_key", "path").agg(F.max("under").alias("under"))
    opened = rules.select("host_key", _key(F.col("host_key"), F.col("path")).alias("key"), "state")
    closed = rules.join(under, ["host_key", "path"], "left").select(
        "host_key",
        F.concat(_key(F.col("host_key"), F.col("path")), F.lit(bytearray(b"\xff"))).alias("key"),
        F.coalesce(
            "under",
            F.struct(
                F.lit(-1).alias("size"),
                F.lit(-1).alias("host_size"),
                F.lit(None).cast("string").alias("rule"),
                F.lit(None).cast("string").alias("verdict"),
            ),
        ).alias("state"),
    )
    return opened.unionByName(closed)


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # rows are counted, swept and joined back by uid: written, so that it is the same each time
    urls = written(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    probes = urls.withColumn("labels", F.split("host", r"\.")).select(
        "uid",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(depth, 1)))),
                lambda n: F.array_join(F.reverse(F.slice("labels", F.size("labels") - n + 1, n)), "."),
            )
        ).alias("host_key"),
    )
    ends = rule_ends(rules)
    # runs per host: rows / max(RUN, ends), so copies of the ends never outnumber the probes
    counts = probes.groupBy("host_key").agg(F.count(F.lit(1)).alias("urls"))
    runs = (
        counts.join(ends.groupBy("host_key").agg(F.count(F.lit(1)).alias("ends")), "host_key")
        .select("host_key", F.ceil(F.col("urls") / F.greatest("ends", F.lit(RUN))).cast("int").alias("runs"))
    )
    nothing = ends.schema["state"].dataType
    points = probes.join(runs, "host_key").select(
        "host_key",
        F.pmod(F.xxhash64("uid"), F.col("runs")).cast("int").alias("run"),
        _key(F.col("host_key"), F.col("path")).alias("key"),
        F.lit(1).alias("kind"),
        "uid",
        F.lit(None).cast(nothing).alias("state"),
    )
    copies = ends.join(runs, "host_key").select(
        "host_key",
        F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"),
        "key",
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("uid"),
        "state",
    )
    sweep = Window.partitionBy("host_key", "run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        points.unionByName(copies)
        .withColumn("state", F.last("state", ignorenulls=True).over(sweep))
        .where("kind = 1 and state.rule is not null")
        .select("uid", "state")
    )
    best = found.groupBy("uid").agg(F.max("state").alias("state"))
    return urls.join(best, "uid", "left").select(
        "page_id",
        "host",
        "path",
        F.col("state.rule").alias("rule"),
        F.coalesce("state.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"))]) for r in rules]
    empty = F.expr("cast(array() as array<struct<host: string, path: string, verdict: string>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))
