"""URL filter: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Each distinct URL is expanded into the host suffixes and path prefixes that a rule could name, an
expression is the two glued together, and the first bytes of its SHA-256 are the equi-join key. A
candidate counts once the whole digests agree. Of the rules that fit, the longest wins (host and path
together; then the longer host; then block before allow). Without a rule the verdict is allow: the
list names exceptions only.

DataFrame functions alone are used. The rule table is broadcast while its checked count stays under
BROADCAST_RULES; beyond that the expressions are shuffled by their hash prefix.

Defined results: a null URL or one without ``://`` has host and path '' and no rule; a repeated row
comes back as often as it came in; null ids stay null; other input columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.runtime import repeated

#: Rules up to which the rule table (about 200 bytes a row) is broadcast.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the short hash prefix (4 bytes).
PREFIX_DIGITS = 8
RULES_SCHEMA = "rule_host string, rule_path string, verdict string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the separator keeps a host and a path without "/" apart
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url)."""
    rules = (
        rules.select("rule_host", "rule_path", "verdict")
        .where("rule_host is not null and rule_path is not null and verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))  # block wins where one rule is given both ways
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    shape = rules.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(_labels(F.col("rule_host")))).alias("labels"),  # as many as a host has labels
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    small = shape["n"] <= BROADCAST_RULES

    urls = (
        pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .groupBy("page_id", "host", "path")
        .agg(F.count("*").alias("copies"))
    )
    parts = F.split("host", r"\.", -1)
    if not shape["n"]:
        best = urls.withColumn("best", F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>"))
    else:
        suffixes = F.transform(
            F.filter(F.array(*[F.lit(int(k)) for k in shape["labels"]]), lambda k: k <= F.size(parts)),
            lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
        )
        prefixes = F.transform(
            F.filter(F.array(*[F.lit(int(k)) for k in shape["lengths"]]), lambda k: k <= F.length("path")),
            lambda k: F.substring(F.col("path"), F.lit(1), k),
        )
        expressions = F.flatten(
            F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))
        )
        asked = (
            urls.withColumn("e", F.explode_outer(expressions))
            .withColumn("asked", _digest(F.col("e.h"), F.col("e.p")))
            .withColumn("prefix", F.substring("asked", 1, PREFIX_DIGITS))
            .drop("e")
        )
        found = asked.join(F.broadcast(rules) if small else rules, "prefix", "left")
        fits = F.col("asked") == F.col("digest")
        best = found.groupBy("page_id", "host", "path").agg(
            F.first("copies").alias("copies"),
            F.max(
                F.when(
                    fits,
                    F.struct(
                        (F.length("rule_host") + F.length("rule_path")).alias("size"),
                        F.length("rule_host").alias("host_size"),
                        F.col("rule_verdict").alias("verdict"),
                        F.concat("rule_host", "rule_path").alias("rule"),
                    ),
                )
            ).alias("best"),
        )
    return repeated(best, "copies", "copy").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the query: (host, path, verdict).
QUERY_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = QUERY_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


_FITS = " UNION ALL ".join(
    f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in QUERY_RULES
)

ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS ({_FITS}),
f AS (
  SELECT u.page_id, u.host, u.path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
  GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.rv, 'allow') AS verdict
FROM u LEFT JOIN f ON u.page_id IS NOT DISTINCT FROM f.page_id AND u.host = f.host AND u.path = f.path
"""
