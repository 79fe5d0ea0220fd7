"""Heavy-hitter dedup, vector codes and fill-in-middle against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import codes, exact, fim

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in ("digest", "best", "top", "tie", "row", "h", "h0", "n", "form", "output", "group_size", "_key"):
            df = df.withColumn(c, F.lit(None).cast("long"))
        df = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    return df


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


# ---- 11 exact duplicates


def copies(n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        text = "hot text" if kind < 0.35 else rng.choice(["", None]) if kind < 0.4 else f"text {rng.randint(0, 60)}" if kind < 0.8 else f"own {i}"
        rows.append((i, text, rng.choice(["en", None]), "s", i))
    return [*rows, rows[5], rows[5], (None, "hot text", "en", "s", 1), (None, None, None, None, None), (n - 1, "hot text", "x", "s", 1), (n + 5, "word " * 50000, "en", "s", 1), (n + 6, "word " * 50000, "en", "s", 1)]


@pytest.mark.parametrize("share", [1 / 4000, 0.05, 0.3])
def test_groups(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "SHARE", share)
    rows = copies()
    got = exact.find(table(spark, rows).repartition(5)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r)
    assert len(got) == len(rows)
    for text, own in groups.items():
        mine = [r for r in got if r.text_sha256 == sha(text)]
        keep = max((r[0] for r in own if r[0] is not None), default=None)
        assert len(mine) == len(own) and {(r.keep_id, r.group_size) for r in mine} == {(keep, len(own))}
        assert [r.doc_id for r in mine if r.kept] == [keep]
        assert {r.heavy for r in mine} == {len(own) >= max(2, math.ceil(len(rows) * share))}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)


@pytest.mark.parametrize("share", [1 / 4000, 0.3])
def test_what_stays(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "SHARE", share)
    rows = copies()
    seen = set()
    for parts in (1, 4):
        df = table(spark, rows)
        kept = exact.deduplicated(df.repartition(parts))
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in kept.collect()), key=repr)
        best = {}
        for r in rows:
            best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
        assert sorted((t or "", i) for i, t, *_ in got) == sorted(best.items())
        seen.add(tuple(got))
    assert len(seen) == 1  # ties don't hang on partitions


def test_every_heavy_value_is_a_candidate(spark):
    rows = [(k % 7 if k % 2 else 1000 + k,) for k in range(20000)]
    df = spark.createDataFrame(rows, "h long").repartition(9)
    got = {r.h for r in exact.candidates(df).collect()}
    assert set(range(7)) <= got and len(got) < 20000 * exact.SHARE * 4000


def test_exact_of_nothing_and_normalised(spark):
    none = table(spark, [])
    assert exact.find(none).count() == 0 and exact.deduplicated(none).count() == 0
    df = table(spark, [(1, "A", None, None, 0), (2, "a", None, None, 0)])
    assert {r.keep_id for r in exact.find(df, F.lower).collect()} == {2} and exact.find(df).where("kept").count() == 2


def test_many_partitions_without_rows(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "90")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert exact.find(table(spark, copies(20))).where("kept").count() == exact.deduplicated(table(spark, copies(20))).count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


# ---- 12 vector codes


def plain_codes(x, parts, entries, rounds):
    """Lloyd's rounds by a full search, in Python's whole numbers."""
    d = -(-x.shape[1] // parts)
    full = np.zeros((len(x), parts * d), object)
    full[:, : x.shape[1]] = x
    cut = [[tuple(int(v) for v in r[p * d : (p + 1) * d]) for r in full] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut[p]:
                own.setdefault(near(v, books[p])[1], []).append(v)
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(books[p])]
    found = [[near(v, books[p]) for v in cut[p]] for p in range(parts)]
    return [bytes(found[p][n][1] for p in range(parts)) for n in range(len(x))], [sum(found[p][n][0] for p in range(parts)) for n in range(len(x))], books


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").withColumns({c: F.lit(1) for c in ("codes", "x", "error", "upper", "_n")})


@pytest.mark.parametrize(("parts", "entries", "rounds", "spread"), [(4, 8, 3, 1.0), (3, 5, 2, 0.02), (2, 64, 4, 1.0), (16, 3, 2, 0.3)])
def test_codes_equal_a_full_search(spark, parts, entries, rounds, spread):
    rng = np.random.default_rng(parts)
    x = (rng.normal(0, spread, (130, 12)) + 2 * rng.integers(0, 3, (130, 1)) * spread).astype(np.float32)
    x[7] = x[3]
    df = embeddings(spark, [(int(k), [float(v) for v in r], int(k) % 3) for k, r in enumerate(x)]).repartition(4)
    rows, books = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    code, error, want = plain_codes(np.floor(x.astype(np.float64) * 256).astype(int), parts, entries, rounds)
    got = {r.vec_id: (bytes(r.codes), r.error) for r in rows.collect()}
    assert got == {k: (code[k], error[k]) for k in range(len(x))}
    assert books.entries.tolist() == [[list(e) for e in b] for b in want]
    assert books.digest() == hashlib.sha256(",".join(str(v) for b in want for e in b for v in e).encode()).hexdigest()


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 1, (900, 8)) * 256).astype(np.int64) + (rng.integers(0, 6, (900, 1)) * 900)
    books = codes.Codebooks(np.stack([x[:32, :4], x[:32, 4:]]), np.zeros((2, 32)))
    c, u, low = books.search(x)
    for _ in range(4):
        new = books.entries.copy()
        for p, part in enumerate(books.cut(x)):
            for k in range(32):
                if (c[:, p] == k).any():
                    new[p, k] = part[c[:, p] == k].sum(0) // (c[:, p] == k).sum()
        books = codes.Codebooks(new, np.sqrt(((new - books.entries) ** 2).sum(2).astype(float)))
        c, u, low, n = books.update(x, c, u, low)
        want, _, far = books.search(x)
        assert (c == want).all() and n < 900 * 2 * 32 / 3
        exactly = np.stack([np.sqrt(codes.squared(p, e).astype(float)) for p, e in zip(books.cut(x), books.entries, strict=True)], 1)
        assert (low.astype(float) <= exactly + 1e-9).all() and (u >= np.take_along_axis(exactly, c[:, :, None].astype(int), 2)[:, :, 0] - 1e-9).all()


def test_codes_ties_go_to_the_lower_entry():
    e = np.array([[[0], [4], [2], [2], [0]]])
    books = codes.Codebooks(e, np.full((1, 5), 100.0))
    x = np.array([[0], [1], [2], [3], [4], [9]])
    c, u, low = books.search(x)
    assert c[:, 0].tolist() == [0, 0, 2, 1, 1, 1]
    # whatever entry a row had, bounds never hide an equal one of lower index
    for was in range(5):
        own = np.full((6, 1), was, np.uint8)
        d = np.sqrt(codes.squared(x, e[0]).astype(float))
        again = codes.Codebooks(e, np.zeros((1, 5))).update(x, own, codes.up(d[:, [was]]), codes.down(d)[:, None])[0]
        assert again[:, 0].tolist() == [0, 0, 2, 1, 1, 1]


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [0.5, 1.0], None), (1, None, 1), (2, [nan, 1.0], 1), (3, [None, 1.0], 1), (4, [inf, 0.0], 1), (6, [1e30, -1e30], 1), (7, [1.0], 1), (8, [], 2), (5, [0.5, 1.0], None), (None, [0.25, 0.25], None)]
    found, books = codes.compress(embeddings(spark, rows))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.error, r.label) for r in found.collect())
    assert [g[1] for g in got] == [5, 5, 6, 0] and books.entries.shape == (16, 4, 1) and books.entries[0, :, 0].tolist() == [128, 128, codes.LARGEST, 64]
    assert {(r.label, r.label_error) for r in codes.with_label_error(found).collect()} == {(None, 0), (1, 0)}
    none, nothing = codes.compress(embeddings(spark, []))
    assert none.count() == 0 and nothing is None and codes.with_label_error(none).count() == 0
    with pytest.raises(ValueError, match="entries"):
        codes.compress(embeddings(spark, []), entries=300)


def test_label_error_by_both_ways(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT", 0.2)
    rows = [(k, k % 3 if k < 200 else None if k < 320 else k, k) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, error long")
    sums = {}
    for _, label, e in rows:
        sums[label] = sums.get(label, 0) + e
    got = codes.with_label_error(df).collect()
    assert len(got) == 400 and all(r.label_error == sums[r.label] for r in got)


def test_decoded_is_near(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 16)).astype(np.float32)
    rows, books = codes.compress(embeddings(spark, [(int(k), [float(v) for v in r], 0) for k, r in enumerate(x)]), rounds=6)
    got = {r.vec_id: codes.decoded(np.frombuffer(bytes(r.codes), np.uint8)[None], books, 16)[0] for r in rows.collect()}
    assert np.mean([((got[k] - x[k]) ** 2).mean() for k in range(300)]) < 0.01


# ---- 13 fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def texts(n=300, seed=4):
    rng = random.Random(seed)
    pool = list("ab<>PSM \n\té漢𝒳́😀") + ["<P", "S>", "<M"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), "en", "s", 0) for i in range(n)]
    return [*rows, rows[3], rows[3], (None, "no id", None, None, None), (n, None, None, None, None), (n + 1, "", None, None, None), (n + 2, "a<S>b", None, None, None), *[(n + 3 + k, "wörd " * 100000, None, None, None) for k in range(3)], (-5, "negative", None, None, None)]


def test_fim_equals_slicing(spark):
    rows = texts()
    got = fim.restored(fim.transform(table(spark, rows).repartition(3))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *plain_fim(i, t)) for i, t, *_ in rows), key=key)
    assert sorted((repr(r.doc_id), r.text) for r in got) == sorted((repr(i), t or "") for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(table(spark, [])).count() == 0 and fim.restored(fim.transform(table(spark, []))).count() == 0


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fim_units(unit):
    import re

    rng = random.Random(5)
    pattern = {"char": r"(?s).", "word": r"[ \t-\r]+|[A-Za-z0-9\u0080-\U0010ffff]+|[^ \t-\rA-Za-z0-9\u0080-\U0010ffff]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    for _ in range(200):
        text = "".join(rng.choice("ab1.,! \n\né漢") for _ in range(rng.randint(0, 30)))
        ends = [0, *(m.end() for m in re.finditer(pattern, text))]
        assert fim.boundaries(fim.codepoints(text.encode()), unit).tolist() == ends
        h = tuple(rng.randrange(1 << 32) for _ in range(4))
        n, form, prefix, middle, out = fim.cut(text.encode(), h, unit)
        assert n == len(ends) - 1 and fim.joined(out, form) == text.encode()
        if form != "plain":
            assert prefix in ends and prefix + middle in ends
    with pytest.raises(ValueError, match="unit"):
        fim.boundaries(fim.codepoints(b"a"), "page")


def test_fim_of_bytes_that_are_no_text(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62C3E28263') AS string)").alias("text"))
    got = fim.restored(fim.transform(df))
    assert got.where("form <> 'plain'").count() > 40 and got.select(F.hex("text")).distinct().collect()[0][0] == "61FF62C3E28263" and got.select(F.hex("text")).distinct().count() == 1


def test_fim_shares_and_seed(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"))
    got = {r.form: r["count"] for r in fim.transform(df).groupBy("form").count().collect()}
    assert 0.07 < got["plain"] / 2000 < 0.13 and 0.15 < got["spm"] / (got["spm"] + got["psm"]) < 0.25
    assert fim.transform(df, share=0).where("form = 'plain'").count() == 2000 and fim.transform(df, share=100, spm=100).where("form = 'spm'").count() == 2000
    assert fim.transform(df, "2").select("output").collect() != fim.transform(df).select("output").collect()


# ---- 10 toxicity: forward pass, gradients, thresholds, what is left out


def small_net(seed=6, rows=30):
    from graphloom.llm import langid, toxicity

    rng = np.random.default_rng(seed)
    kernels = {w: rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}
    total = toxicity.FILTERS * len(toxicity.WIDTHS)
    embed = rng.normal(0, 1, (rows, toxicity.DIM))
    embed[0] = 0
    texts = [np.array([0, 0, *rng.integers(0, rows, rng.integers(0, 9)), 0, 0]) for _ in range(12)]
    return toxicity.Net({}, embed, kernels, rng.normal(0, 0.3, total), rng.normal(0, 1, total + 1), 0.0, {}, langid.build({})), texts, rng.integers(0, 2, 12).astype(float)


def plain_logit(net, ids):
    """Filters and max pooling word by word; positions to the text's end."""
    from graphloom.llm import toxicity

    out, k = net.out[-1], 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            at = lambda i, w, f=f, width=width: sum(net.embed[ids[i + w]][d] * net.kernels[width][w][d][f] for d in range(toxicity.DIM)) if i + w < len(ids) else 0.0
            best = max(sum(at(i, w) for w in range(width)) for i in range(len(ids)))
            out += max(best + net.bias[k], 0) * net.out[k]
            k += 1
    return out


def test_toxicity_forward_pass_by_loops():
    net, texts, _ = small_net()
    assert net.logits(texts) == pytest.approx([plain_logit(net, t) for t in texts])


def test_toxicity_gradients_by_differences():
    from graphloom.llm import toxicity

    net, texts, y = small_net()

    def loss():
        z = np.array([plain_logit(net, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + toxicity.DECAY / 2 * (net.out[:-1] ** 2).sum())

    grad, rows, moved = toxicity.gradients(net, texts, y)
    rng = np.random.default_rng(1)
    for array, g in [(net.bias, grad["bias"]), (net.out, grad["out"]), *[(net.kernels[w], grad[f"k{w}"]) for w in toxicity.WIDTHS]]:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in array.shape)
            was, e = array[at], 1e-5
            array[at] = was + e
            up = loss()
            array[at] = was - e
            low = loss()
            array[at] = was
            assert g[at] == pytest.approx((up - low) / (2 * e), abs=1e-6)
    for k in rng.choice(len(rows), 6):
        if rows[k]:
            at = (rows[k], 3)
            was, e = net.embed[at], 1e-5
            net.embed[at] = was + e
            up = loss()
            net.embed[at] = was - e
            low = loss()
            net.embed[at] = was
            assert moved[k, 3] == pytest.approx((up - low) / (2 * e), abs=1e-6)


def test_toxicity_thresholds_by_language():
    from graphloom.llm import toxicity

    class Given:
        def logits(self, ids):
            return np.array(ids, float)

    rng = np.random.default_rng(2)
    ya, yb = rng.integers(0, 2, 100), rng.integers(0, 2, 100)
    z = [*(np.where(ya, 3.0, 1.0) + rng.uniform(-0.5, 0.5, 100)), *(np.where(yb, -1.0, -3.0) + rng.uniform(-0.5, 0.5, 100))]
    shift = toxicity._thresholds(Given(), ["a"] * 100 + ["b"] * 100 + ["c"] * 5, [*z, 9, 9, 9, 9, 9], np.array([*ya, *yb, 1, 1, 1, 1, 1], float))
    assert 1.5 < shift["a"] < 2.5 and -2.5 < shift["b"] < -1.5 and "c" not in shift and "" in shift


def test_toxicity_labels_left_out_touch_no_weight():
    from graphloom.llm import langid, toxicity

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, 30) for _ in range(200)]
    labels = [int((d < 6).sum() > 4) for d in docs]
    held, learn = toxicity.left_out(200)
    assert sorted([*held, *learn]) == list(range(200)) and len(held) == 20
    flipped = [1 - y if k in set(held.tolist()) else y for k, y in enumerate(labels)]
    one, two = (toxicity.train(docs, ["x"] * 200, y, langid.build({})) for y in (labels, flipped))
    assert one.rows == two.rows and (one.embed == two.embed).all() and (one.out == two.out).all() and all((one.kernels[w] == two.kernels[w]).all() for w in toxicity.WIDTHS)
    moved = [docs[k] if k not in set(held.tolist()) else np.full(30, 99) for k in range(200)]
    assert 99 not in toxicity.train(moved, ["x"] * 200, labels, langid.build({})).rows


# ---- 5 mixing by given weights and schedules; ties that don't hang on partitions


def mixed_rows(n=300):
    rng = random.Random(8)
    return [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(n)]


def test_mixing_by_a_schedule_against_numerical_integration(spark):
    from graphloom.llm import mixing

    knots = {"a": [(0.0, 0.0), (0.4, 3.0), (0.5, 0.0), (1.0, 1.0)], "b": [(0.3, 2.0)], None: [(0.0, 1.0), (1.0, 0.0)]}
    schedule = spark.createDataFrame([(s, t, w) for s, k in knots.items() for t, w in k] + [("a", None, 1.0), ("x", 0.5, 1.0)], "source string, time double, weight double")
    df = spark.createDataFrame(mixed_rows(), DOCS)
    got = mixing.mix(df, schedule=schedule).select("source", "target", F.explode("copies").alias("c")).collect()
    grid = np.linspace(0, 1, 200001)
    plain = {(r.source, r.target): r for r in mixing.mix(df).collect()}
    for s, k in knots.items():
        w = np.interp(grid, [t for t, _ in k], [v for _, v in k])
        total = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        own = sorted((r for r in got if r.source == s), key=lambda r: r.c.position)
        assert own and (s, own[0].target) in plain
        begun = 0
        for r in own:  # words placed before a time are what the schedule asks for by then
            assert np.interp(r.c.position, grid, total / total[-1]) == pytest.approx(begun / r.target, abs=2e-4)
            begun += r.c.words
        assert begun == math.floor(own[0].target)
    line = {(r.doc_id, c.lap): c.position for r in mixing.mix(df).where("source = 'c'").collect() for c in r.copies}
    same = {(r.doc_id, c.lap): c.position for r in mixing.mix(df, schedule=schedule).where("source = 'c'").collect() for c in r.copies}
    assert line == same


def test_mixing_by_given_weights(spark):
    from graphloom.llm import mixing

    rows = mixed_rows()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    total = sum(size.values())
    weights = spark.createDataFrame([("a", 5.0), ("b", 1.0), (None, 2.0)], "source string, weight double")
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights).collect()}
    assert got["c"] == 0 and sum(got.values()) == pytest.approx(total)
    level = min(got[s] / w for s, w in (("a", 5.0), ("b", 1.0), (None, 2.0)))
    for s, w in (("a", 5.0), ("b", 1.0), (None, 2.0)):
        assert got[s] == pytest.approx(3 * size[s]) or got[s] / w == pytest.approx(max(got[b] / v for b, v in (("a", 5.0), ("b", 1.0), (None, 2.0)) if got[b] < 3 * size[b] - 1e-6))
    assert level > 0
    few = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, DOCS), weights=few).collect()}["a"] == pytest.approx(min(total, 3 * size["a"]))


def test_ties_end_alike_in_any_partitions(spark):
    from graphloom.llm import minhash, mixing

    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "s", k) for k in range(6)] + [(2, text + " nine", "en", "s", 0), (3, "other words of one more text here", "en", "s", 0)]
    seen = {"near": set(), "mix": set()}
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows, DOCS).withColumn("m", F.create_map(F.lit("k"), F.col("n_chars"))).repartition(parts, "n_chars")
        seen["near"].add(tuple(sorted((r.doc_id, r.m["k"]) for r in minhash.deduplicated(df, 80).collect())))
        seen["mix"].add(tuple(sorted((r.doc_id, r.m["k"], r.text) for r in mixing.mixed_documents(df).collect())))
    assert len(seen["near"]) == len(seen["mix"]) == 1


# ---- 7 token files that stay, and are read in part


def test_token_files_stay_and_any_part_reads_alone(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm import common, tokenfile

    name = public_tokenizers.path("word_bpe_49k.json")
    coder, rng = Tokenizer.from_file(name), random.Random(9)
    rows = [(i, " ".join(rng.choice("river stone Green w1ndow no, été".split()) for _ in range(rng.randint(0, 60))), None, None, None) for i in range(60)]
    rows += [(None, "no id", None, None, None), (7, "again seven", None, None, None), (80, "long " * 900, None, None, None), (81, None, None, None, None)]
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(table(spark, rows), name, 5, path=path, block=64)
    common.drop_stages(spark)
    blocks = tokenfile.open_tokens(spark, path)
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append([*coder.encode(t or "", add_special_tokens=False).ids, 1])
    starts = {(r.doc_id, r.n_tokens): r.start for r in tokenfile.read_documents(blocks).collect()}
    flat = [None] * sum(len(x) for own in ids.values() for x in own)
    for i, own in ids.items():
        assert sorted(x.tolist() for x in tokenfile.read_document(blocks, i)) == sorted(own)
        for x in own:
            flat[starts[i, len(x)] : starts[i, len(x)] + len(x)] = x
    assert None not in flat and tokenfile.read_document(blocks, 999) == []
    for lo, n in [(0, 1), (63, 2), (0, len(flat)), (len(flat) - 1, 9), (200, 700), (len(flat), 5), (5, 0)]:
        assert tokenfile.read_ids(blocks, lo, n).tolist() == flat[lo : lo + n]
    with pytest.raises(ValueError, match="start"):
        tokenfile.read_ids(blocks, -1, 1)
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 100)
    many = tokenfile.write_tokens(table(spark, rows), name)
    assert many.select("shard").distinct().count() > 20 and sorted(tokenfile.read_ids(many, 0, len(flat)).tolist()) == sorted(flat)


# ---- 3 neighbours: a table many times the sample


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_a_table_eleven_times_the_sample(spark, monkeypatch, clusters):
    from graphloom.llm import neighbours

    monkeypatch.setattr(neighbours, "SAMPLE", 900)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_000, 24))
    if clusters:
        x = rng.normal(size=(clusters, 24))[rng.integers(0, clusters, len(x))] * 3 + x * 0.6
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in range(0, len(x), 100):
        s = (x[q] * x).sum(axis=1)
        s[q] = -np.inf
        found += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & got[q])
    assert found / (20 * 100) >= 0.9


def test_toxicity_thresholds_count_every_labelled_document(spark):
    from graphloom.llm import toxicity

    rows = [(k, k / 100, "en") for k in range(300)] + [(1000 + k, k / 10 - 5, "de") for k in range(50)]
    marks = [(k, int(k >= 200)) for k in range(300)] + [(1000 + k, int(k >= 20)) for k in range(50)]
    raw, marked = spark.createDataFrame(rows, "doc_id long, logit double, lang_pred string"), spark.createDataFrame(marks, "doc_id long, _y int")
    got = toxicity.thresholds(raw, marked, [])
    assert got["en"] == pytest.approx(1.995, abs=0.01) and got["de"] == pytest.approx(-3.05, abs=0.01) and set(got) == {"", "en", "de"}
    # those learned from set nothing
    assert set(toxicity.thresholds(raw, marked, [1000 + k for k in range(11)])) == {"", "en"}
    shifted = marked.withColumn("_y", F.when(F.col("doc_id") == 199, 1).otherwise(F.col("_y")))
    assert toxicity.thresholds(raw, shifted, [])["en"] == pytest.approx(1.985, abs=0.01)
