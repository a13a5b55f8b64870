"""Host and path rules on URLs by a sorted sweep over reversed-host intervals.

A rule (host, path, verdict) fits its host and every subdomain when the URL's path starts with the rule's path.
Reversing a host's labels and closing each with a dot turns "this host and all below it" into one interval of
strings: ``example.com`` becomes ``[com.example., com.example/)``, since ``/`` follows ``.`` and no host holds it.
Such intervals nest or are disjoint. Each interval's start and end is an event that carries the stack of rules active
from there on; URLs and events are sorted together and the last event before a URL hands it its stack. Among the
stack's rules whose path fits, the longest (host and path characters, then host characters) wins.

The sweep runs in parallel strips: a URL is put in one of ``strips`` by its row's place in its input split, and every strip gets all events.
Events grow with the rules only, so no host, however frequent, fills one strip.

Null URLs or URLs without ``://`` have an empty host and path and get the default verdict; repeated rows are each judged. An empty table gives
an empty result, and without rules every URL gets the default verdict. URLs of any length are judged whole. Columns named host, path, rule
and verdict are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import lower_ascii

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack) in key order: from ``key`` on, the rules in ``stack`` are active until the next event.

    ``rules`` has host, path, verdict. Rules with a null in host or path are left out; of rules that share host and
    path, ``block`` beats ``allow``.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .where("host is not null and path is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", reversed_key(F.col("host")))
    )
    entry = F.struct(
        (F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"),
        "host", "path", "verdict",
    )
    own = rules.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    # The hosts above a host are the dot-closed prefixes of its key: a join on them finds each interval's ancestors.
    parts = F.slice(F.split("key", r"\."), 1, F.size(F.split("key", r"\.")) - 1)
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit(".")))).alias("up"))
    stacks = (
        above.join(own.select(F.col("key").alias("up"), "rules"), "up")
        .groupBy("key").agg(
            F.flatten(F.collect_list("rules")).alias("inside"),
            F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("rules")))).alias("outside"),
        )
    )
    end = F.concat(F.expr("substring(key, 1, char_length(key) - 1)"), F.lit("/"))
    return stacks.select("key", F.col("inside").alias("stack")).unionByName(stacks.select(end.alias("key"), F.col("outside").alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", strips: int | None = None) -> DataFrame:
    """All columns of ``pages`` but those named host, path, rule and verdict, and these four anew."""
    spark = pages.sparkSession
    strips = strips or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.struct(*own).alias("page"), F.pmod(F.monotonically_increasing_id(), F.lit(strips)).cast("int").alias("strip"))
    urls = urls.withColumn("host", host_of(F.col(f"page.{url}"))).withColumn("path", path_of(F.col(f"page.{url}")))
    urls = urls.select("strip", reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page", "host", "path", F.lit(None).alias("stack"))
    events = rule_events(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(urls.schema["page"].dataType).alias("page"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    # At one key an end carries the outer stack and a start the inner one; both cannot share a key, as starts end in a dot.
    sweep = Window.partitionBy("strip").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        events.unionByName(urls.withColumn("stack", F.col("stack").cast(events.schema["stack"].dataType)))
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    )
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select(
        "page.*", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """host, path, verdict of a fixed list."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows.cast("array<struct<host:string,path:string,verdict:string>>")))
