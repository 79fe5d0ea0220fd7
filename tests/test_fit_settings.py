"""Settings on which the time of fits hangs."""

import pytest

from graphloom.operators import evaluation as E
from graphloom.operators import tasks as T


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forests_keep_the_nodes_of_rows(spark, monkeypatch, kind):
    from pyspark.ml import classification, regression

    seen = {}

    def forest(**kw):
        seen.update(kw)
        raise InterruptedError

    monkeypatch.setattr(classification, "RandomForestClassifier", forest)
    monkeypatch.setattr(regression, "RandomForestRegressor", forest)
    rows = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(20)], "id long, label int, emb array<double>")
    with pytest.raises(InterruptedError):
        E.cross_validated(rows) if kind == "classification" else T.forest_regression(rows.selectExpr("id", "emb AS x", "double(label) AS y"), rows.selectExpr("id", "emb AS x"))
    assert seen["cacheNodeIds"] and seen["numTrees"] == 100 and seen["maxDepth"] == 30
