"""Steps whose last bit decides a result, against the arithmetic of the SQL."""

import duckdb
import pytest

from graphloom.operators import history as H
from graphloom.plans.queries import scaled

FALL = [0.6, 0.6, 0.6, 0.45, 0.45, 0.45]


def test_a_variance_at_the_threshold_is_no_plateau(spark):
    h = spark.createDataFrame([(1, i + 1, m) for i, m in enumerate(FALL)], "task long, iteration long, metric double")
    got = [(r.direction, r.duration) for r in H.trends(h).orderBy("iteration").collect()]
    assert got == [("unknown", 0)] * 2 + [("plateau", 1), ("declining", 1), ("declining", 2), ("plateau", 1)]


def test_variance_has_the_bits_of_sql(spark):
    rows = [[0.6, 0.6, 0.45], [0.1, 0.2, 0.7, 0.35, 0.9], [0.3], []]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k long, v array<double>").select("k", H.variance("v").alias("x")).orderBy("k").collect()
    want = [duckdb.execute("SELECT var_pop(x) FROM (SELECT unnest($1::double[]) AS x)", [v]).fetchall()[0][0] for v in rows]
    assert [r.x for r in got] == want


@pytest.mark.parametrize("places", [6, 11])
def test_halves_round_as_in_sql(spark, places):
    values = [(k + 0.5) / 10.0**places for k in range(1000, 3000)] + [-0.1 - 0.5 / 10.0**places, 0.0]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").select("k", scaled(H.F.col("v"), places).alias("x")).orderBy("k").collect()
    want = duckdb.execute(f"SELECT round(x, {places}) FROM (SELECT unnest($1::double[]) AS x)", [values]).fetchall()
    assert [r.x for r in got] == [w[0] for w in want]
