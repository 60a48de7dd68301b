"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into its host's suffixes times its path's directories, no longer
than the rules'. Expressions meet rules on a short prefix of their digest; the full
digest and the rule's whole path then confirm. The longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url):
    """Columns: the host after the first "://" with A-Z lower-cased, and the path; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _expressions(labels: int, depth: int):
    """Host suffixes of up to ``labels`` labels, each with every directory of up to ``depth`` slashes, empty included."""
    parts = F.split("host", r"\.")
    steps = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    deep = F.least(F.size(steps) - 1, F.lit(depth))
    folders = F.transform(F.sequence(F.lit(0), deep), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: F.concat(s, f))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest host and path wins, then the longest host, then the first by text of rule and verdict.
    URLs that are null, empty or without "://" have empty host and path, and no rule
    with a host fits them. Ids may be null or repeat; other columns are ignored.
    Without rules every verdict is the default.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    folder = F.regexp_extract("path", r"^(.*/)?", 0)
    named = rules.where("host is not null and path is not null").distinct().select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), folder.alias("folder"))
    named = named.withColumn("rule_digest", F.sha2(F.concat("rule_host", "folder"), 256)).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    sizes = named.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("folder", "/")) - 1)).first()
    distinct = rows.select("host", "path").where("host <> ''").distinct()
    each = distinct.select("host", "path", F.explode(_expressions(sizes[0] or 1, sizes[1] or 0)).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    hits = each.join(named, "short").where("digest = rule_digest and startswith(path, rule_path)")
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(-F.length(rule), -F.length("rule_host"), rule, "verdict")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), "verdict"), order).alias("best"))
    # Rows without a host have no rule; they are dealt evenly, under keys that no host can be.
    spread = F.concat(F.lit("/"), F.spark_partition_id(), F.lit("/"), F.pmod(F.xxhash64("id", "host"), F.lit(1024)))
    keyed = rows.withColumn("at", F.when(F.col("host") == "", spread).otherwise(F.col("host")))
    out = keyed.join(best.withColumnRenamed("host", "at"), ["at", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (
  SELECT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parsed) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, parsed.host, parsed.path, rule, coalesce(v, 'allow') AS verdict
FROM parsed LEFT JOIN hits ON parsed.host = hits.host AND parsed.path = hits.path AND k = 1
"""
