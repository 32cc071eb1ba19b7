"""URL filters (8): host-suffix and path-prefix expressions against a rule table.

Each url becomes its expressions: every suffix of the host at a label border,
joined with every prefix of the path that has the length of some rule's path.
Expressions meet the rules in an equi-join on the first four bytes of a
SHA-256; the full digest and then the strings confirm a hit. Of a page's
confirmed rules the longest wins; of equally long ones that with the longer
host, then block before allow. All of it is DataFrame operations.

Scale: the rules are broadcast while they number at most ``BROADCAST_RULES``
(each at most a few hundred bytes); beyond that they are dealt out by hash
prefix, copied to ``SALTS`` salts, and a page's expressions go to the salt of
its row, so that one frequent host is split. A page's expressions are folded
to one row inside the task that made them before anything is shuffled.

Defined cases: a null url or one without ``://`` has an empty host and path
and takes the default verdict; a host or path that fits no rule does too;
repeated rows each give a row; null page_ids stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
SALTS = 16
DEFAULT = "allow"

#: (verdict, host, path) of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    raw = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule (host and path as one string, or null), verdict."""
    rules = rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path")).dropna()
    bounds = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    lengths = sorted(bounds["lengths"])  # at most as many as the longest path has characters
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, 8))
    base = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), F.monotonically_increasing_id().alias("row"))
    base = base.select("page_id", "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(_suffixes(F.col("host")), lambda h: F.transform(fits, lambda n: F.struct(h.alias("h"), F.substr(F.col("path"), F.lit(1), n).alias("p")))))
    expressions = base.withColumn("x", F.explode_outer(F.when(F.col("host") != "", pairs)))
    expressions = expressions.withColumn("x_digest", F.sha2(F.concat_ws("\n", "x.h", "x.p"), 256)).withColumn("short", F.substring("x_digest", 1, 8))
    if bounds["n"] <= broadcast_rules:
        joined = expressions.join(F.broadcast(rules), "short", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = expressions.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    sure = (F.col("x_digest") == F.col("digest")) & (F.col("x.h") == F.col("r_host")) & (F.col("x.p") == F.col("r_path"))
    found = F.when(sure, F.struct((F.length("r_host") + F.length("r_path")).alias("long"), F.length("r_host").alias("host_long"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")))
    best = joined.groupBy("row", "page_id", "host", "path").agg(F.max(found).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
