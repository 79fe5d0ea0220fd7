"""The pipeline: its stages' decisions take effect and clean documents stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("__x", F.lit("a"))
    odd = spark.createDataFrame([(10**9, "123 456", "en", "s", 7, 1, "a"), (10**9 + 1, None, None, None, None, 1, "a")], docs.schema)
    docs, names = docs.unionByName(odd), [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        if name == "language ID":
            assert out.count() == before - 2 and not out.where("doc_id >= 1000000000").count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_empty_stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def spread_copies(seed=5):
    """Texts of 200 words and copies with 1 to 6 spread-out words changed: best
    links of 0.95, 0.90, 0.86, 0.81, 0.77 and 0.73, and chains of them."""
    rng, rows = random.Random(seed), []
    for _ in range(6):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        for changes in (0, 4, 4, 5, 3, 6, 4, 2, 5, 1):
            own = list(base)
            for k in range(changes):
                own[10 + 30 * k + rng.randrange(20)] = f"v{rng.randint(0, 10**6)}"
            base = own if rng.random() < 0.3 else base
            rows.append((len(rows), " ".join(own), "en", "s", 0))
    return rows


def test_near_duplicates_at_80(spark):
    rows = spread_copies()
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    links = lambda t: [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
    least = list(range(len(rows)))
    for _ in rows:
        for i, j in links(80):
            least[i] = least[j] = min(least[i], least[j])
    assert len(links(80)) > len(links(85)) + 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 80).collect()}
    assert [got[i] for i in range(len(rows))] == least
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF).collect()) == sorted(set(least))


def test_sketches_reach_down_to_80(spark):
    one, other = bytes(minhash.K), bytes(110) + bytes([1]) * (minhash.K - 110)  # 0.69 of the coordinates
    nodes = [(b"a", one), (b"b", other), (b"c", bytes([2]) * minhash.K)]
    rows = spark.createDataFrame([(1, n) for n, _ in nodes], "key long, node binary")
    labels = spark.createDataFrame([], "node binary, label binary")
    classes = spark.createDataFrame(nodes, "node binary, sketch binary")
    near = lambda t: {bytes(r.label) for r in minhash.neighbourhoods(rows, labels, classes, t).collect()}
    assert near(80) == {b"a", b"b"} and near(85) == set()
