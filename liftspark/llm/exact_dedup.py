"""Exact dedup (7): tree-merge of sorted digest runs.

Rows become entries (doc_id, digest of the text, count). Each of L leaves,
chosen by a hash of doc_id, sorts its entries by digest and merges equal
ones: a sorted run that holds a digest once, with its best doc_id and a
count. Runs then meet in rounds. In round r, groups of ``fan_in`` runs
exchange slices: the run at place (d_0 .. d_r .. d_R) sends the slice whose
r-th digest digit is j to the run whose r-th place digit is j, and each run
merges the ``fan_in`` sorted slices that reach it. After all rounds each
place holds one slice of the digest space, merged over all leaves. A text
held by a third of all rows is one entry per run from the first merge on,
so no task meets more than ``fan_in`` entries of it in a round. The answers
go down by joining (leaf, digest), which again splits such a text over all
leaves.

Digest: SHA-256, the byte length and a 64-bit xxHash; entries merge only
where all three agree at that level, so that a colliding SHA-256 would stay
apart. Runs are merged in a stream; memory per task doesn't depend on the
number of rows.

Defined cases: a null text counts as empty; a null doc_id sorts below all
others; rows that repeat both doc_id and text count each, and one of them is
the kept row; an empty table gives an empty result; other columns are never
read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import first_of_each, only, small_batches, without, written
from .workers import task

FAN_IN = 8

_RUN = "slot int, sha binary, size long, check long, best long, n long"


def _digest(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("check")]


def _digit(sha: Column, r: int, fan_in: int) -> Column:
    """The r-th digest digit, from the leading bytes."""
    return F.pmod(F.conv(F.hex(F.substring(sha, 1 + r, 1)), 16, 10).cast("int"), F.lit(fan_in))


def _merge(keep: str):
    """Merges a stream of entries sorted by (slot, digest): equal neighbours become one."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        names = [x.split()[0] for x in _RUN.split(", ")]
        held: pa.Table | None = None
        best = "max" if keep == "max" else "min"

        def fold(t: pa.Table) -> pa.Table:
            keys = [t[c].to_numpy(zero_copy_only=False) for c in ("slot", "size", "check")]
            new = np.ones(len(t), dtype=bool)
            if len(t) > 1:
                same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
                sha = t["sha"].combine_chunks()
                same &= pc.equal(sha.slice(1), sha.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
                new[1:] = ~same
            run = pa.array(np.cumsum(new))
            g = pa.table({"run": run, "best": t["best"], "n": t["n"]}).group_by("run", use_threads=False).aggregate([("best", best), ("n", "sum")])
            heads = t.take(pa.array(np.flatnonzero(new)))
            return pa.table({**{c: heads[c] for c in ("slot", "sha", "size", "check")}, "best": g[f"best_{best}"], "n": g["n_sum"]}).select(names)

        for b in batches:
            t = pa.Table.from_batches([b]).select(names)
            if held is not None:
                t = pa.concat_tables([held, t])
            if not len(t):
                continue
            t = fold(t)
            yield from t.slice(0, len(t) - 1).combine_chunks().to_batches()
            held = t.slice(len(t) - 1)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return merged


def _round(runs: DataFrame, slot: Column, keep: str, parts: int) -> DataFrame:
    sent = runs.withColumn("slot", slot.cast("int")).select(*[x.split()[0] for x in _RUN.split(", ")])
    return sent.repartition(parts, "slot").sortWithinPartitions("slot", "sha", "size", "check").mapInArrow(task(_merge(keep)), _RUN)


def decisions(docs: DataFrame, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, sha, n_rows, keep_id, group_size; keep is ``max`` or ``min``.

    There are as many leaves as the session has shuffle partitions, rounded up to a power of fan_in."""
    small_batches(docs.sparkSession)
    rounds, leaves = 1, fan_in
    while leaves < int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rounds, leaves = rounds + 1, leaves * fan_in
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_digest(F.col("text")))
    entries = entries.groupBy("doc_id", "sha", "size", "check").agg(F.count(F.lit(1)).alias("n_rows"))
    leaf = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.col("check"))), F.lit(leaves)).cast("int")
    entries = written(entries.withColumn("leaf", leaf), "dedup-entries")
    # Place digits, most significant first, turn one by one from leaf digits into digest digits.
    local = _round(entries.select("leaf", "sha", "size", "check", F.col("doc_id").alias("best"), F.col("n_rows").alias("n")), F.col("leaf"), keep, leaves)
    local = written(local, "dedup-runs")
    top = local
    for r in range(rounds):
        unit = fan_in ** (rounds - 1 - r)
        place = F.floor(F.col("slot") / unit) % fan_in
        top = _round(top, F.col("slot") + (_digit(F.col("sha"), r, fan_in) - place) * unit, keep, leaves)
    key = ["sha", "size", "check"]
    down = local.select("slot", *key).join(top.select(*key, F.col("best").alias("keep_id"), F.col("n").alias("group_size")), key)
    return entries.withColumnRenamed("leaf", "slot").join(down, ["slot", *key]).select("doc_id", "sha", "n_rows", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    d = decisions(docs, keep).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return d.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are known by doc_id and the whole digest; of rows that
    repeat both, that whose JSON has the smallest SHA-256 stays."""
    d = written(decisions(docs, keep), "dedup-decisions")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    names = docs.columns
    sha, number = "sha", "number"
    while sha in names or number in names:
        sha, number = sha + "_", number + "_"
    tagged = docs.withColumn(number, F.col("doc_id").cast("long")).withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    key = [number, sha]
    drop = written(d.where(~stays).select(F.col("doc_id").alias(number), F.col("sha").alias(sha)), "dedup-drop")
    out = without(tagged, drop, key)
    again = written(d.where(stays & (F.col("n_rows") > 1)).select(F.col("doc_id").alias(number), F.col("sha").alias(sha)), "dedup-again")
    if not again.isEmpty():
        out = without(out, again, key).unionByName(first_of_each(only(out, again, key), key))
    return out.select(*[F.col(f"`{c}`") for c in names])
