"""Versioned stores, run logs, clients and adaptive weights."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import generation as Ge
from graphloom.functions import llm_client as L
from graphloom.operators import adaptive as A
from graphloom.operators import policy as Po
from graphloom.sources import stores


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def xs(df):
    return sorted(r.x for r in df.collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "s"), []

    def write(k):
        try:
            for n in range(3):
                stores.Store(spark, path).commit({"t": frame(spark, 10 * k + n)})
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = stores.Store(spark, path)
    assert not failed and store.versions() == list(range(1, 10)) and xs(store.read("t")) == sorted(10 * k + n for k in range(3) for n in range(3))
    assert store.compacted("t") == 10 and len(store.manifest()["tables"]["t"]) == 1 and len(xs(store.read("t"))) == 9


def test_readers_see_one_version(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    assert store.manifest() == {"version": 0, "tables": {}} and not store.has("a")
    assert store.commit({"a": frame(spark, 1), "b": frame(spark, 1)}) == 1
    held = store.read("a", 1)
    assert store.commit({"a": frame(spark, 2), "b": frame(spark, 2)}, "overwrite") == 2
    assert xs(held) == [1] and xs(store.read("a")) == xs(store.read("b")) == [2] and xs(store.read("b", 1)) == [1]
    with pytest.raises(stores.Conflict):
        store.commit({"a": frame(spark, 3)}, expected=1)
    assert store.commit({"a": frame(spark, 3)}, expected=2) == 3 and xs(store.read("a")) == [2, 3] and xs(store.read("b")) == [2]
    for bad in (lambda: store.read("c"), lambda: store.read("a", 9), lambda: store.commit({}, "other")):
        with pytest.raises(ValueError, match="no "):
            bad()


def test_what_was_not_put_in_place_is_not_seen(spark, tmp_path, monkeypatch):
    store = stores.Store(spark, str(tmp_path / "s"))
    store.commit({"a": frame(spark, 1)})
    monkeypatch.setattr(stores.Store, "_put", lambda self, m: (_ for _ in ()).throw(OSError("the driver died")))
    with pytest.raises(OSError, match="died"):
        store.commit({"a": frame(spark, 2)}, "overwrite")
    assert xs(stores.Store(spark, store.path).read("a")) == [1]


def test_memory(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "m"))
    stores.book(store, "t1", {"best": {"metric": 0.5}, "init": {}})
    stores.book(store, "t2", {"best": {"metric": 0.1}})
    stores.book(store, "t1", {"best": {"metric": 0.7}})
    got = {(r.task, r.key): r.json for r in stores.remembered(store).collect()}
    assert got == {("t1", "best"): '{"metric": 0.7}', ("t1", "init"): "{}", ("t2", "best"): '{"metric": 0.1}'}
    assert stores.remembered(store, "t1", 2).where("key = 'best'").first().json == '{"metric": 0.5}'


def test_log_goes_on_counting(spark, tmp_path):
    path = str(tmp_path / "log")
    with stores.RunLog(spark, path, "r") as log:
        log.log("evaluation", 1, metric=0.7, n=1)
    again = stores.RunLog(spark, path, "r", every=2)
    again.log("evaluation", 2, metric=0.7, n=2)
    again.log("strategy", 2, hops=3)
    assert again.store.versions() == [1, 2] and not again.held
    again.log("evaluation", 2, metric=0.6)
    assert again.best() == {"metric": 0.7, "n": 1} and sorted(r.at for r in again.events().collect()) == [1, 2, 3, 4]
    rows = {r.iteration: r for r in again.iterations().collect()}
    assert rows[2].strategy == '{"hops": 3}' and rows[2].evaluation == '{"metric": 0.6}' and rows[1].strategy is None


# ---- clients


def test_order_count_and_failures_by_item(spark):
    def client(prompts):
        assert len(prompts) <= 7
        time.sleep(random.random() / 200)
        if any(p.endswith("3") for p in prompts):
            raise RuntimeError("a bad item")
        return [p.upper() for p in prompts]

    df = spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).coalesce(1)
    got = df.select("p", L.generation(client, size=7, calls=4)(F.col("p")).alias("g")).select("p", "g.*").collect()
    assert len(got) == 100
    for r in got:
        assert (r.text, r.error) == ((None, "RuntimeError('a bad item')") if r.p.endswith("3") else (r.p.upper(), None))


def test_retries_and_wrong_counts():
    seen = []

    def flaky(items):
        seen.append(list(items))
        if len(items) > 1:
            return items[:-1]  # an answer is missing
        if seen.count(items) == 1:
            raise OSError("once")
        return [i * 2 for i in items]

    assert L.answered(["a", "b"], (flaky,), tries=2) == [("aa", None), ("bb", None)] and [len(s) for s in seen].count(1) == 4
    assert L.answered([], (flaky,)) == [] and L.answered(["a"], (lambda x: x[:0],), tries=1)[0][0] is None
    shuffled = lambda items: [(k, items[k]) for k in reversed(range(len(items)))]
    assert L.answered(["x", "y", "z"], (shuffled,)) == [("x", None), ("y", None), ("z", None)]


def test_fast_model_only_where_the_strong_one_fails(spark):
    def strong(ps):
        if any("bad" in p for p in ps):
            raise RuntimeError("no")
        return [f"strong {p}" for p in ps]

    dual = Ge.DualClient(spark, lambda ps: [f"fast {p}" for p in ps], strong)
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    assert [r[0] for r in df.select(dual.generate_strong(F.col("p"))).collect()] == ["strong a", "fast bad", "strong c"]
    assert dual.stats()["fast_prompts"] == 1
    dual = Ge.DualClient(spark, lambda ps: ps, lambda ps: ps)
    df.select(dual.generate_strong(F.col("p"))).collect()
    assert dual.stats() == {"fast_calls": 0, "fast_prompts": 0, "strong_calls": 1, "strong_prompts": 3}


def test_repair_asks_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(ps):
        calls.add(len(ps))
        return ['{"a": 1}'] * len(ps)

    df = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "id long, p string").coalesce(1)
    asked = df.withColumn("text", L.generator(client)(F.col("p")))
    out = Po.repaired(asked, F.get_json_object("text", "$.a"), lambda t: L.generator(client)(t))
    assert [r.strategy for r in out.collect()] == ["1"] * 10 and calls.value == 10


def test_encoder(spark):
    client = lambda texts: [(k, [len(texts[k]), 1]) for k in reversed(range(len(texts)))]
    df = spark.createDataFrame([("ab", "old"), (None, ""), ("abc", None)], "t string, o string").coalesce(1)
    assert [r[0] for r in df.select(L.encoder(client, size=2)(F.col("t"))).collect()] == [[2.0, 1.0], [0.0, 1.0], [3.0, 1.0]]
    assert [r[0] for r in df.select(L.prefixed(F.col("t"), F.col("o"))).collect()] == ["old\n\nab", "", "abc"]


# ---- adaptive weights


def history(seed=3, tasks=5, n=40):
    rng = random.Random(seed)
    trends = ["plateau", "declining", "oscillating", "improving", "unknown", None]
    return [(t, i, rng.choice(trends)) for t in range(tasks) for i in range(1, n + (t == 0) * 60)]


def looped(rows, first=None):
    out, states = {}, {}
    for t, i, trend in sorted(rows):
        states[t] = states.get(t, A.State.loaded(None, first)).update(trend)
        out[t, i] = states[t]
    return out


def test_adapted_equals_a_loop(spark):
    rows = history()
    df = spark.createDataFrame(rows, "task long, iteration long, trend string").repartition(3)
    want = looped(rows)
    got = A.adapted(df).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.task, r.iteration]
        assert r.state == w.saved() and (r.baseline, r.relative, r.raw, r.bonus, r.plateau) == (w.weights.baseline, w.weights.relative, w.weights.raw, w.weights.bonus, w.weights.plateau)
        assert r.baseline + r.relative + r.raw == pytest.approx(1)
    early = A.last_states(A.adapted(df.where("iteration <= 17")))
    later = {(r.task, r.iteration): r.state for r in A.adapted(df.where("iteration > 17"), saved=early).collect()}
    assert all(s == want[k].saved() for k, s in later.items())


def test_weights_rule():
    s = A.State()
    assert [s := s.update("plateau"), s := s.update("plateau")][-1].weights == A.Weights()  # warm-up
    s = s.update("plateau")
    assert s.changed == 3 and s.weights.relative == pytest.approx(0.15 / 1.05) and s.update("plateau").weights == s.weights
    assert s.reset() == A.State() and A.State.loaded(s.saved()) == s
    assert A.State(A.Weights(0, 0, 0)).weights.shared() == A.Weights(0, 0, 0)


def test_streamed_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = history(n=20)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = str(tmp_path / "in")
        for lo, hi in ((0, 7), (7, 13), (13, 200)):
            spark.createDataFrame([r for r in rows if lo < r[1] <= hi], "task long, iteration long, trend string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("task long, iteration long, trend string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = A.streamed(stream).writeStream.outputMode("update").format("memory").queryName("adapted").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {(r.task, r.iteration): r.state for r in spark.table("adapted").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {k: s.saved() for k, s in looped(rows).items()}
