"""URL filters: reversed-host keys, prefix intervals and a sorted sweep with a rule stack.

A rule names a host and a path prefix. It fits its host and all subdomains whose path starts
with the prefix. The canonical key of a rule is its host reversed by labels, a separator, and
its path; all keys that it fits *on that host* form the interval from the key to the key
followed by the highest character. Intervals of prefixes nest, so a sweep over sorted keys
needs one stack.

* Each url takes part once for every host on the way up from its own (``a.b.c``, ``b.c``,
  ``c``) that some rule names: subdomains become equality on the host part of the key.
* Rules and urls are sorted together by (host part, path). The stack that is open after a rule
  is that rule with its enclosing rules, and travels on the rule's row; the sweep carries the
  last one forward to each url, which drops the rules already closed and takes the innermost.
* A host with many urls is swept in slices. Their number follows from the counted urls of the
  host, and only the rules of that host are repeated for its slices, so no slice is large.
* The longest rule of all hosts of a url wins (characters of host and path together, then the
  longer host); among equal rules a block wins over an allow.

Defined cases: a NULL url or one without ``://`` has an empty host and path; a NULL rule host
or path counts as empty; an empty rule host fits every host; a url that no rule fits gets the
default verdict and a NULL rule; repeated pages come back as often as they are given; an empty
table gives an empty result. Hosts lose no trailing dot or port: they are compared as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import ascii_lower, table

SLICE_ROWS = 50_000
BROADCAST_HOSTS = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _ancestors(host: Column, most: int) -> Column:
    """The host and every host above it of at most ``most`` labels, reversed, and the empty host."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, max(1, most))
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    return F.array_distinct(F.concat(F.array(F.lit("")), whole))


def _stacked(rules: DataFrame) -> DataFrame:
    """One row per (host, path): the rule with the stack of its enclosing rules, outermost first."""
    rule = (
        rules.select(
            reversed_host(F.coalesce(ascii_lower("host"), F.lit(""))).alias("rhost"),
            F.coalesce("host", F.lit("")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("rhost", "path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("blocks"), "verdict", "host")).alias("r"))
        .select(
            "rhost", "path", F.length("path").alias("long"), F.col("r.verdict").alias("verdict"),
            F.concat(ascii_lower(F.col("r.host")), "path").alias("rule"),
        )
    )
    prefixes = rule.select(
        "rhost", F.col("path").alias("inner"),
        F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("path"),
    )
    frame = F.struct("long", "path", "rule", "verdict")
    return (
        prefixes.join(rule, ["rhost", "path"])
        .groupBy("rhost", F.col("inner").alias("path"))
        .agg(F.sort_array(F.collect_list(frame)).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """id, host, path, rule and verdict of every row of ``pages``."""
    stacked = _stacked(rules)
    base = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    named = stacked.groupBy("rhost").agg(F.lit(1).alias("known"))
    # no rule has more labels than this, so none fits a longer ancestor
    most = named.agg(F.max(F.size(F.split("rhost", r"\.")))).first()[0] or 0
    every = base.select("id", "host", "path", F.explode(_ancestors(F.col("host"), most)).alias("rhost"))
    few = named.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    side = F.broadcast if few else lambda df: df
    slices = (
        every.join(side(named), "rhost").groupBy("rhost").count()
        .select("rhost", (F.floor(F.col("count") / slice_rows) + 1).cast("int").alias("slices"))
    )
    probes = every.join(side(slices), "rhost").select(
        "rhost", F.pmod(F.xxhash64("id", "host", "path"), F.col("slices")).cast("int").alias("slice"),
        "path", F.lit(1).alias("kind"), "id", "host", F.lit(None).cast(stacked.schema["stack"].dataType).alias("stack"),
    )
    starts = stacked.join(slices, "rhost").select(
        "rhost", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "path", F.lit(0).alias("kind"),
        F.lit(None).cast(base.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), "stack",
    )
    sweep = Window.partitionBy("rhost", "slice").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_rules = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    found = (
        starts.unionByName(probes)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .withColumn("top", F.element_at(F.concat(F.array(F.lit(None).cast(stacked.schema["stack"].dataType.elementType)), open_rules), -1))
        .select(
            "id", "host", "path",
            F.when(F.col("top").isNotNull(), F.struct(
                F.length("top.rule").alias("long"), (F.length("top.rule") - F.col("top.long")).alias("host_long"),
                (F.col("top.verdict") == "block").alias("blocks"), F.col("top.rule").alias("rule"),
                F.col("top.verdict").alias("verdict"))).alias("best"),
            F.lit(0).alias("rows"),
        )
    )
    kept = base.select("id", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best"), F.lit(1).alias("rows"))
    return (
        kept.unionByName(found)
        .groupBy("id", "host", "path")
        .agg(F.max("best").alias("best"), F.sum("rows").alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )


#: Fixed values of the query: the rules that it applies.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        for host, path, verdict in RULES
    ])))
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = r"""
WITH rules(rank, host, path, verdict) AS (VALUES
  (1, 'org', '/', 'allow'), (2, 'example.org', '/es/', 'block'), (3, 'example.org', '/en/1', 'block'),
  (4, 'com', '/fr/', 'allow'), (5, 'com', '/de/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN LATERAL (
  SELECT r.host || r.path AS rule, r.verdict FROM rules r
  WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  ORDER BY length(r.host) + length(r.path) DESC LIMIT 1) b ON true
"""
