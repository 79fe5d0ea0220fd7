"""The corpus pipeline: five stages over documents, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, minhash, mixing, tokenfile
from graphloom.llm.common import crc32_of, staged, table
from graphloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those without
    a label get the language predicted."""
    model = langid.fit(docs, crc32_of(F.col("doc_id")) % 4 != 2)
    # other columns under names that can't clash with what is added
    names = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = langid.identify(plain, model, [n for n in names.values() if n != "doc_id"])
    own = {c: F.coalesce(n, "lang_pred") if c == "lang" else F.col(n) for c, n in names.items()}
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*[own[c].alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a Jaccard
    similarity of 0.80 on (op9's own query links from 0.85)."""
    return minhash.deduplicated(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token files, read back.  Workers
    remember fewer pieces here, since executors hold other stages' leftovers."""
    return tokenfile.read_documents(tokenfile.write_tokens(docs, tokenizer_path(), pieces=250_000))


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]

#: Learned models and token ids have no SQL form; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
