"""URL rules by host suffix and path prefix, matched through short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import lower_ascii

# Fixed values of the registered query: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _digest(host, path):
    return F.unhex(F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256))


def _short(digest):
    return F.substring(digest, 1, 4)


def match_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule per distinct (host, path): rule, verdict; only matched ones.

    Every pair expands into host suffixes (whole labels) times path prefixes
    (of the lengths that rule paths have). Expressions equi-join the rules on
    4 bytes of their digest; then the full digests must agree. Of the rules
    that fit, the longest (host plus path) wins, then the longer host, then the
    smaller text; of equal rules with different verdicts, ``block``.
    """
    # bounded by the longest rule path: distinct lengths, not rules
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    rules = rules.where("host is not null and path is not null").select(
        _digest(lower_ascii(F.col("host")), F.col("path")).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("hit"),
    )
    best = F.expr("max_by(hit, struct(hit.size, hit.host_size, hit.verdict))")
    rules = rules.groupBy("rule_digest").agg(best.alias("hit")).withColumn("short", _short(F.col("rule_digest")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    expressions = (
        urls.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes if lengths else F.array().cast("array<string>")))
        .where("prefix is not null")
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", _short(F.col("digest")))
    )
    hits = expressions.join(rules, "short").where("digest = rule_digest")
    order = F.struct("hit.size", "hit.host_size", "hit.rule")
    return hits.groupBy("host", "path").agg(F.max_by("hit", order).alias("hit")).select("host", "path", "hit.rule", "hit.verdict")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: on from there to ``?``, ``#`` or the end. A null url, or
    one without ``://``, has an empty host and path. A rule fits its host and
    all subdomains when the path starts with the rule's path. Where none fits,
    ``rule`` is null and the verdict is ``default`` (this filter blocks by
    listed rules only). Repeated urls are judged once and joined back, so
    repeated rows and null ids each keep their row. No pages: no rows; no
    rules: all default.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        lower_ascii(F.regexp_extract(url, URL_PARTS, 1)).alias("host"),
        F.regexp_extract(url, URL_PARTS, 2).alias("path"),
    )
    # written, so that a hot (host, path) is a join key that Spark can split
    matched = cut_lineage(match_urls(parts, rules))
    return parts.join(matched, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op8_url_filter(spark, sf_dir):
    return judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), rules_table(spark))


ORACLE = f"""
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path
  from pages
), r(rhost, rpath, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select distinct host, path, rhost || rpath as rule, v,
    row_number() over (partition by host, path order by length(rhost || rpath) desc, length(rhost) desc) as k
  from (select distinct host, path from u), r
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, u.host, u.path, rule, coalesce(v, '{DEFAULT_VERDICT}') as verdict
from u left join m on m.host = u.host and m.path = u.path and k = 1
"""
