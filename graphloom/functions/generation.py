"""Generation with two models, in passes, and with retrieved context.

Clients are callables from a list of prompts to a list of texts (``llm_client``);
they run on executors, a few calls side by side, and are counted by accumulators.  A client over HTTP is the user's to bring: there is no network here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.llm_client import COUNTING, Client, described, generator
from graphloom.operators import rendering as R
from graphloom.operators import retrieval as V


@dataclass
class Counted:
    """A client that counts its calls and prompts on the driver's accumulators."""

    client: Client
    calls: object
    prompts: object

    def __call__(self, prompts: list[str]) -> list[str]:
        with COUNTING:
            self.calls.add(1)
            self.prompts.add(len(prompts))
        return self.client(prompts)


@dataclass
class DualClient:
    """A fast and a strong model; a failure of the strong one falls back to the fast."""

    spark: SparkSession
    fast: Client
    strong: Client
    counts: dict = field(default_factory=dict)

    def __post_init__(self):
        context = self.spark.sparkContext
        for kind in ("fast", "strong"):
            self.counts[kind] = (context.accumulator(0), context.accumulator(0))

    def counted(self, kind: str) -> Counted:
        return Counted(self.fast if kind == "fast" else self.strong, *self.counts[kind])

    def generate_fast(self, prompt: Column) -> Column:
        return generator(self.counted("fast"))(prompt)

    def generate_strong(self, prompt: Column) -> Column:
        """The fast model is asked only for prompts that the strong one left."""
        return generator(self.counted("strong"), self.counted("fast"))(prompt)

    def with_system(self, system: str, prompt: Column, strong: bool = False) -> Column:
        whole = F.concat(F.lit(system + "\n\n"), prompt)
        return self.generate_strong(whole) if strong else self.generate_fast(whole)

    def stats(self) -> dict[str, int]:
        """Calls and prompts so far by model; retried tasks count again."""
        return {f"{kind}_{what}": acc.value for kind, pair in self.counts.items() for what, acc in zip(("calls", "prompts"), pair, strict=True)}


# What further passes ask for.
PASSES = (
    "Refine this description. Keep the facts and improve its flow:\n",
    "Compress this description to its most telling facts:\n",
)


def in_passes(gene: Column, prompt: Column, client: Client, passes: int = 1) -> Column:
    """Text of one to three passes: each further one asks about the text before; a
    pass that fails or says nothing leaves that text."""
    text = described(gene, prompt, client)
    for ask in PASSES[: max(0, min(passes, 3) - 1)]:
        again = generator(client)(F.concat(F.lit(ask), text))
        text = F.coalesce(F.nullif(F.trim(again), F.lit("")), text)
    return text


def rag_prompts(genes: DataFrame, queries: DataFrame, index: DataFrame, template: str, k: int = 20) -> DataFrame:
    """gene, prompt: genes (gene, name) with the context that their vectors
    (query_id, q_emb) retrieve from an index (id, emb, edge_type, text)."""
    found = V.top_k(queries, index.select("id", "emb", "edge_type", "text"), k)
    context = R.contexts(found).select(F.col("query_id").alias("gene"), "context")
    rows = genes.join(context, "gene", "left")
    values = {"gene_id": F.col("gene"), "gene_name": F.coalesce("name", "gene"), "context": F.coalesce("context", F.lit("No context was retrieved."))}
    return rows.select("gene", R.filled(template, values).alias("prompt"))


def rag_descriptions(genes: DataFrame, queries: DataFrame, index: DataFrame, template: str, client: Client, k: int = 20, passes: int = 1) -> DataFrame:
    """gene, prompt, text: retrieval, prompt and generation of all genes at once."""
    p = rag_prompts(genes, queries, index, template, k)
    return p.withColumn("text", in_passes(F.col("gene"), F.col("prompt"), client, passes))


def mock_client(prompts: list[str]) -> list[str]:
    """Answers offline: a JSON strategy where a prompt mentions JSON, else a text."""
    return ['{"edge_types": ["PPI", "GO"], "max_neighbors": 50}' if "json" in p.lower() else f"A description of {len(p)} characters was asked for." for p in prompts]
