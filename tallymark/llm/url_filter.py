"""URL filters: host-suffix and path-prefix expressions against a rule table.

Each URL is expanded into the expressions that could name a rule (every suffix of its host at a label
boundary, joined with every path prefix of a length that some rule has). Expressions are equi-joined with
the rules on a short hash prefix, the full digest confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
RULE_SCHEMA = "host string, path string, verdict string"
#: Digits of the digest that the join compares before the whole digest is confirmed.
PREFIX = 8


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has (host, path, verdict). A rule fits its host and every subdomain of it when the URL's path
    starts with the rule's path. Of several, the longest expression (host then path, by characters) wins; of
    equally long ones the one with the longer host, then ``block`` before ``allow``, then the smaller text.
    Without a rule the verdict is ``default``: a list lookup lets pass what it does not list.

    Null URLs and URLs without ``://`` have an empty host and path and match no rule. Rules with a null or
    empty host are ignored; a rule's null path is empty and fits every path. Repeated rows of ``pages`` come
    back as often as they went in, rows with a null id too. Other columns are ignored, so their names cannot
    clash. Only distinct (host, path) pairs are expanded, so a hot URL costs one expansion.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select(
        "_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    known = (
        rules.where("host is not null and host <> ''")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .select(
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("_host_len"),
            F.length("path").alias("_path_len"),
            "verdict",
            F.sha2(F.concat_ws("\u0000", "host", "path"), 256).alias("_digest"),
        )
        .dropDuplicates(["_digest", "verdict"])
    )
    # The lengths of rule paths: as many as there are different lengths, so bounded by the longest path.
    lengths = known.agg(F.sort_array(F.collect_set("_path_len")).alias("_lengths"))
    distinct = own.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # Host suffixes and path prefixes make few expressions a URL: labels times different rule-path lengths.
    expressions = (
        distinct.where("host <> ''")
        .crossJoin(F.broadcast(lengths))  # one row
        .withColumn("_labels", labels)
        .withColumn(
            "_suffix",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("_labels")),
                    lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."),
                )
            ),
        )
        .withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))))
        .select(
            "host",
            "path",
            F.sha2(F.concat_ws("\u0000", F.col("_suffix"), F.substring("path", F.lit(1), F.col("_n"))), 256).alias("_full"),
        )
    )
    found = (
        expressions.withColumn("_short", F.substring("_full", 1, PREFIX))
        .join(known.withColumn("_short", F.substring("_digest", 1, PREFIX)), "_short")
        .where("_full = _digest")
    )
    best = found.groupBy("host", "path").agg(
        F.min(
            F.struct(
                (-F.length("rule")).alias("l"),
                (-F.col("_host_len")).alias("h"),
                F.when(F.col("verdict") == "block", 0).otherwise(1).alias("b"),
                "rule",
                "verdict",
            )
        ).alias("_best")
    )
    return own.join(best, ["host", "path"], "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` judged by the rules above."""
    return url_verdicts(read(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), RULE_SCHEMA))


OP6_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, coalesce(url, '') u FROM pages),
q AS (SELECT page_id, CASE WHEN position('://' IN u) = 0 THEN '' ELSE substr(u, position('://' IN u) + 3) END r FROM p),
h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') raw, r FROM q),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') path FROM h),
m AS (SELECT s.*, rhost || rpath rule, verdict FROM s JOIN rules
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT page_id, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict FROM m GROUP BY page_id)
SELECT s.page_id, host, path, b.rule rule, coalesce(b.verdict, 'allow') verdict FROM s LEFT JOIN b USING (page_id)
"""
