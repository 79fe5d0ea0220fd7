"""Identifier mapping: prioritised look-ups, and first or last row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order`` (a file position or like)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: later rows overwrite earlier ones."""
    return first_of(rows, keys, [F.desc(c) for c in order])


def exploded(rows: DataFrame, column: str, sep: str) -> DataFrame:
    """One row for each trimmed, non-empty part of a separated list."""
    parts = F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(column, F.explode(parts))


def mapper(genes: DataFrame) -> DataFrame:
    """kind, key, symbol of every identifier of a gene table (symbol, ensembl,
    entrez, uniprot, prev, alias; lists by |; pos: its file order).  Of keys
    given twice the later row counts."""
    listed = lambda c, kind: exploded(genes.select(F.col(c).alias("key"), "symbol", "pos"), "key", r"\|").select(F.lit(kind).alias("kind"), "key", "symbol", "pos")
    rows = listed("symbol", "symbol")
    for c, kind in (("ensembl", "ensembl"), ("entrez", "entrez"), ("uniprot", "uniprot"), ("prev", "alias"), ("alias", "alias")):
        rows = rows.unionByName(listed(c, kind))
    return last_of(rows, ["kind", "key"], ["pos", "symbol"]).drop("pos")


def normalised(symbols: DataFrame, maps: DataFrame) -> DataFrame:
    """raw, symbol: the approved symbol, else by alias, else null."""
    up = symbols.select(F.col("raw"), F.upper(F.trim("raw")).alias("key"))
    approved = maps.where("kind = 'symbol'").select("key", F.col("symbol").alias("a"))
    alias = maps.where("kind = 'alias'").select("key", F.col("symbol").alias("b"))
    return up.join(approved, "key", "left").join(alias, "key", "left").select("raw", F.coalesce("a", "b").alias("symbol"))


def embedding_keys(symbols: DataFrame, ids: DataFrame, cache: DataFrame) -> DataFrame:
    """symbol, key: an embedding's id by the exact symbol, by the cached id, or
    by equal letters in any case (the least such id)."""
    exact = ids.select(F.col("id").alias("symbol"), F.col("id").alias("a"))
    cached = cache.join(ids.withColumnRenamed("id", "ensembl"), "ensembl", "left_semi").select("symbol", F.col("ensembl").alias("b"))
    loose = ids.groupBy(F.upper("id").alias("u")).agg(F.min("id").alias("c"))
    out = symbols.select("symbol", F.upper("symbol").alias("u")).join(exact, "symbol", "left").join(cached, "symbol", "left").join(loose, "u", "left")
    return out.select("symbol", F.coalesce("a", "b", "c").alias("key"))


def batch_convert(rows: DataFrame, maps: DataFrame, source: str) -> DataFrame:
    """raw, converted by one kind of identifier; null if unknown."""
    own = maps.where(F.col("kind") == source).select(F.col("key").alias("raw"), F.col("symbol").alias("converted"))
    return rows.join(own, "raw", "left").select("raw", "converted")
