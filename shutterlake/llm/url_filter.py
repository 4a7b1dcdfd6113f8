"""URL filter: a sort-merge range join between page hosts and nested host rules.

A host becomes a canonical key of its labels in reverse order, each followed by
a dot (``www.example.net`` -> ``net.example.www.``).  All hosts below a rule's
host then lie in the interval ``[key, key with the last dot raised by one)``, and
two such intervals are nested or disjoint.  The sweep sorts interval bounds and
hosts together.  Every bound carries the stack of rules that are active from
there on, so one ``last_value`` that ignores nulls hands each host its stack.

Everything is a DataFrame expression; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (verdict, rule) with rule = host/path-prefix.
DEFAULT_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Copies of rules that may be sent to sweeps in all; fewer rules let the hosts of one domain be dealt over more sweeps.
COPIES = 10_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*+", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rules as rows (rule, rule_host, rule_path, verdict)."""
    rows = []
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        host, slash, path = rule.partition("/")
        rows.append((rule, host.lower(), slash + path, verdict))
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, verdict string")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row for each rule host: key, its own rules with those of all enclosing hosts, and the latter alone.

    A rule host finds its enclosing hosts by an equi-join on its label prefixes.
    """
    own = (
        rules.where(F.col("rule_host").isNotNull() & (F.col("rule_host") != ""))
        .select(
            host_key(F.col("rule_host")).alias("key"),
            F.struct(
                F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), F.col("rule"),
                F.coalesce("rule_path", F.lit("")).alias("path"), F.col("verdict"),
            ).alias("entry"),
        )
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("entry")).alias("own"))
    )
    labels = F.split(F.col("key"), r"\.")
    outer = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("outer_key"))
    enclosing = own.select(F.col("key").alias("outer_key"), F.col("own").alias("outer_own"))
    return (
        outer.join(enclosing, "outer_key")
        .groupBy("key")
        .agg(
            F.flatten(F.collect_list("outer_own")).alias("inside"),
            F.flatten(F.collect_list(F.when(F.col("outer_key") != F.col("key"), F.col("outer_own")))).alias("outside"),
        )
    )


def _bucket(domain: Column, salt: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(domain, salt), F.lit(buckets)).cast("int")


def sweep_hosts(hosts: DataFrame, rules: DataFrame, buckets: int) -> DataFrame:
    """Distinct ``host`` -> ``stack``, the rules whose host interval holds it (null: none).

    Hosts are dealt over all sweeps and every rule is sent to each, as long as that
    makes no more than ``COPIES`` rows.  With more rules, hosts are dealt by their
    first two labels and a salt, a rule of two labels or more goes to its domain's
    salts and a shorter one everywhere: as many salts as the bound allows.
    """
    salts = max(1, min(buckets, COPIES // max(1, rules.count())))
    domain = F.substring_index(F.col("key"), ".", 2) if salts < buckets else F.lit("")
    salt = F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int")
    points = hosts.select("host", host_key(F.col("host")).alias("key")).select(
        (_bucket(domain, salt, buckets) if salts < buckets else salt).alias("bucket"), "key", F.lit(2).alias("kind"), "host", F.lit(None).cast(ENTRIES).alias("stack"),
    )
    deep = (F.size(F.split(F.col("key"), r"\.")) > 2) & F.lit(salts < buckets)
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    of_domain = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: _bucket(domain, s, buckets))
    bounds = (
        _rule_stacks(rules)
        .withColumn("bucket", F.explode(F.when(deep, F.array_distinct(of_domain)).otherwise(everywhere)))
        .select(
            "bucket",
            F.explode(F.array(
                F.struct(F.col("key").alias("key"), F.lit(1).alias("kind"), F.col("inside").alias("stack")),
                F.struct(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"), F.col("outside").alias("stack")),
            )).alias("bound"),
        )
        .select("bucket", "bound.key", "bound.kind", F.lit(None).cast("string").alias("host"), F.col("bound.stack").cast(ENTRIES).alias("stack"))
    )
    # Ends come before starts at one key; of two ends at one key there are none, as keys are distinct.
    order = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        points.unionByName(bounds)
        .withColumn("active", F.last("stack", ignorenulls=True).over(order))
        .where(F.col("kind") == 2)
        .select("host", "active")
    )


ENTRIES = "array<struct<size:int,host_size:int,rule:string,path:string,verdict:string>>"


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
    default_verdict: str = "allow", buckets: int | None = None,
) -> DataFrame:
    """Every row's ``id_col, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path.  The longest rule string wins, then the longer host, then the greater
    string.  Null urls and urls without ``://`` have an empty host and path, fit
    no rule and get the default verdict.  Rules without a host are ignored;
    repeated rules count once.  Repeated pages stay repeated; other columns of
    ``pages`` are not looked at.  No pages: no rows.

    Hosts are made distinct before the sweep (map-side first), so a hot host is
    one point of it; the join that hands the stacks back is one that adaptive
    execution can split.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select(
        "id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path")
    )
    stacks = sweep_hosts(parts.select("host").distinct(), rules, buckets)
    best = F.array_max(F.filter("active", lambda r: F.col("path").startswith(r["path"])))
    return (
        parts.join(stacks.where(F.size("active") > 0), "host", "left")
        .withColumn("best", best)
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"),
        )
    )
