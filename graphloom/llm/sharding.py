"""Rendezvous (highest-random-weight) sharding over weighted shards.

Every record scores each shard with a hash of (record key, shard id) and goes
to the best one: ``-weight / ln(u)``, ``u`` uniform in (0, 1), gives each
shard its weight's share of keys.  A shard that is added can only win records
for itself, and one that is removed only gives up its own, so a change of the
shard count moves no other record.  The rule is one expression over the key:
no shuffle, no state, nothing to look up.

Nulls and odd input.  A null key is the key of empty text; a null text has
size 1 and the checksum of no bytes.  Equal keys always meet in one shard,
whatever their texts.  Repeated rows each get a slot.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets by which slots of one shard are numbered in parallel.
SLOT_BUCKETS = 1024


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Score of one shard for a key (the highest wins)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.ln(unit)


def rendezvous_shard(key: Column, shards: Mapping[int, float]) -> Column:
    """Shard id of a key; shards: id -> positive weight.  Ties go to the larger id."""
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need positive weights")
    scored = [F.struct(shard_score(key, s, w).alias("score"), F.lit(int(s)).alias("shard")) for s, w in sorted(shards.items())]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def with_slots(df: DataFrame, shard: str, order: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``: 0, 1, ... without gaps within each shard.

    A shard's rows are numbered in ``buckets`` hash buckets side by side; the
    buckets' counts, at most shards x buckets rows, give each its first slot.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(F.col(shard).alias("_s"), F.col("_b").alias("_cb")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_s", "_cb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_b").orderBy(*order)
    return (
        df.join(F.broadcast(first), (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_cb")))
        .withColumn("slot", (F.col("_first") + F.row_number().over(within) - 1).cast("long"))
        .drop("_b", "_s", "_cb", "_first")
    )


def shard_records(docs: DataFrame, shards: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    grown: the shards after a change, to which ``grown_shard`` refers; null
    without it."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    after = rendezvous_shard(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), shards).alias("shard"),
        after.alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
