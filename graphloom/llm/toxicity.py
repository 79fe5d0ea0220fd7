"""Toxicity: a convolutional text classifier trained in numpy.

A word is hashed (crc32 of its lower-case bytes, 22 bits) to an embedding; the
buckets that at least ``MIN_DOCS`` sampled documents hold have their own, all
others share one.  Filters of widths 1, 2 and 3 run over the whole text, each
filter's largest response is kept, and a logistic layer on the rectified
maxima gives the score.  Filters and embeddings are trained by Adam on
cross-entropy; one embedding dimension starts as the bucket's smoothed log-odds
between the classes, the rest at random from a fixed seed.  Since a filter is
linear before the maximum, its response is the sum of one table entry for each
word it covers, so a text costs a few gathers a word.

The logit is shifted by a threshold for the text's language, so that 0.5 is each
language's best cut.  ``scored`` chooses it from counts of all labelled documents
that were not learned from; ``fit`` alone, for later texts, from a tenth of the sample.
These are set aside first: their labels touch neither the log-odds, nor which buckets
have an embedding, nor any weight.  The language is predicted from the text alone (``langid``).

The fit takes a bounded sample: of each class the labelled documents with the
smallest hashes of doc_id until ``PER_CLASS`` documents or ``CHARS`` characters are
reached; documents of more than ``LONGEST`` characters are not among them.  Their
words are hashed and their languages predicted on executors, so that the driver gets
numbers, four bytes a word.  A language's threshold is only set from ``LEAST`` or
more left-out documents.

Nulls and odd input.  Null and empty texts get the score of a text of unknown
words.  Null labels take no part in the fit; a doc_id labelled twice with
different classes counts in both; of texts that share a doc_id one is learned
from.  Repeated rows each get a score.  Extra
columns are ignored.  Without labels of both classes the score is the share of
label 1 (0.5 with no label).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import langid
from graphloom.llm.common import slices, staged

PER_CLASS, CHARS, LONGEST = 3_000, 16 << 20, 1 << 18
MIN_DOCS = 3
BITS = 22
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Pull of the last layer's weights to zero.
DECAY = 1e-4
#: Embeddings move by this share of the rate, since rare words are seen in few batches.
SLOWER = 0.3
LEAST = 40
REMEMBER = 400_000
SCORED = "doc_id long, score double, lang_pred string"

#: Bytes of words (digits, a-z, all of a non-ASCII letter); others separate.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split() if text else []


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


@dataclass
class Net:
    """rows: bucket -> embedding row (0: shared); the rest are the weights."""

    rows: dict[int, int]
    embed: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    prior: float
    shift: dict[str, float]
    languages: langid.Model
    learned: list[int] = field(default_factory=list)  # places, in ``fit`` ids, of the documents learned from

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def ids(self, text: str | None) -> np.ndarray:
        """Rows of a text's words, two blank ones on each side."""
        memory = self.__dict__.setdefault("_memory", {})
        w = words(text)
        got = [memory.get(x) for x in w]
        if None in got:
            if len(memory) > REMEMBER:
                memory.clear()
            for x, g in zip(w, got, strict=True):
                if g is None and x not in memory:
                    memory[x] = self.rows.get(bucket(x), 0)
            got = [memory[x] if g is None else g for x, g in zip(w, got, strict=True)]
        return np.array([0, 0, *got, 0, 0], np.int32)

    def rows_of(self, buckets: np.ndarray) -> np.ndarray:
        """The same from the buckets of a text's words."""
        return np.array([0, 0, *(self.rows.get(b, 0) for b in buckets.tolist()), 0, 0], np.int32)

    def responses(self, flat: np.ndarray, starts: np.ndarray, embed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of every filter in each text and, where ``flat`` are
        rows of an ``embed`` given, its position."""
        best, where = [], []
        n = len(starts)
        for width in WIDTHS:
            if embed is not None:
                tables = np.einsum("rd,wdf->wrf", embed, self.kernels[width])
            else:
                kept = self.__dict__.setdefault("_tables", {})
                tables = kept[width] = kept[width] if width in kept else np.einsum("rd,wdf->wrf", self.embed, self.kernels[width])
            total = tables[0][flat]
            for k in range(1, width):
                total[:-k] += tables[k][flat[k:]]
            # the two blanks after a text keep a filter out of the next one
            top = np.maximum.reduceat(total, starts, axis=0)
            best.append(top)
            if embed is not None:
                spans = np.diff(np.append(starts, len(flat)))
                is_top = total == np.repeat(top, spans, axis=0)
                at = np.where(is_top, np.arange(len(flat))[:, None], len(flat))
                where.append(np.minimum.reduceat(at, starts, axis=0))
        return np.concatenate(best, axis=1).reshape(n, -1), np.concatenate(where, axis=1) if where else None

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        if not len(self.out):
            return np.full(len(ids), self.prior)
        starts = np.cumsum([0, *map(len, ids[:-1])])
        top, _ = self.responses(np.concatenate(ids), starts)
        return np.maximum(top + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        lang, _ = self.languages.predict(texts)
        shift = np.array([self.shift.get(x, self.shift.get("", 0.0)) for x in lang])
        return 1 / (1 + np.exp(-np.clip(self.logits([self.ids(t) for t in texts]) - shift, -50, 50))), lang


def left_out(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The documents that set thresholds, a tenth of n, and those learned from."""
    order = np.random.default_rng([seed, n]).permutation(n)
    return order[: n // 10], order[n // 10 :]


def train(docs: list[np.ndarray], found: list[str], labels: list[int], languages: langid.Model, seed: int = 7) -> Net:
    """Net from the buckets of each document's words, its language and label."""
    y = np.array(labels, np.float64)
    share = y.mean() if len(y) else 0.5
    blank = Net({}, np.zeros((1, DIM), np.float32), {}, np.zeros(0), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), {}, languages)
    if not len(y) or not 0 < share < 1:
        return blank
    held, learn = left_out(len(docs), seed)
    if not 0 < y[learn].mean() < 1:  # a few documents: all are learned from
        held, learn = learn[:0], np.arange(len(docs))
    rng, own = np.random.default_rng(seed), [np.unique(docs[k]) for k in learn]
    kept, seen = np.unique(np.concatenate(own), return_counts=True)
    toxic = np.zeros(len(kept), np.int64)
    for d, label in zip(own, y[learn], strict=True):
        if label:
            toxic[np.searchsorted(kept, d)] += 1
    kept, toxic, seen = kept[seen >= MIN_DOCS], toxic[seen >= MIN_DOCS], seen[seen >= MIN_DOCS]
    net = blank
    net.rows = {b: k + 1 for k, b in enumerate(kept.tolist())}
    pos, neg = y[learn].sum(), len(learn) - y[learn].sum()
    odds = np.log((toxic + 0.5) / (pos + 1)) - np.log((seen - toxic + 0.5) / (neg + 1))
    net.embed = rng.normal(0, 0.05, (len(kept) + 1, DIM)).astype(np.float32)
    net.embed[0] = 0
    net.embed[1:, 0] += np.clip(odds, -4, 4)
    net.kernels = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for k in net.kernels.values():
        k[:, 0, : FILTERS // 2] += 0.5 / len(k)
    total = FILTERS * len(WIDTHS)
    net.bias = np.zeros(total, np.float32)
    net.out = np.append(rng.normal(0.2, 0.1, total), -0.5)
    ids = [net.rows_of(d) for d in docs]
    _optimise(net, [ids[k] for k in learn], y[learn], rng)
    net.learned = learn.tolist()
    net.shift = _thresholds(net, [found[k] for k in held], [ids[k] for k in held], y[held])
    return net


def gradients(net: Net, batch: list[np.ndarray], y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean cross-entropy: by weight, the rows of embeddings used, and theirs."""
    rows, flat = np.unique(np.concatenate(batch), return_inverse=True)
    starts, embed = np.cumsum([0, *map(len, batch[:-1])]), net.embed[rows]
    top, at = net.responses(flat, starts, embed)
    hidden = np.maximum(top + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out[:-1] + net.out[-1], -50, 50)))
    d = (p - y) / len(batch)
    back = (d[:, None] * net.out[:-1]) * (hidden > 0)
    grad = {"bias": back.sum(axis=0).astype(net.bias.dtype), "out": np.append(hidden.T @ d + DECAY * net.out[:-1], d.sum()), **{f"k{w}": np.zeros_like(k) for w, k in net.kernels.items()}}
    flat, moved = np.append(flat, [0, 0]), np.zeros_like(embed)
    for j, width in enumerate(WIDTHS):
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        b, where, kernel = back[:, cols], at[:, cols], net.kernels[width]
        for k in range(width):
            used = flat[where + k]
            grad[f"k{width}"][k] += np.einsum("nfd,nf->df", embed[used], b)
            np.add.at(moved, used.ravel(), (b[:, :, None] * kernel[k].T[None]).reshape(-1, DIM))
    moved[rows == 0] = 0
    return grad, rows, moved


def _optimise(net: Net, ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
    """Adam; of the embeddings a batch moves those of its own words."""
    params = {"bias": net.bias, "out": net.out, **{f"k{w}": net.kernels[w] for w in WIDTHS}}
    first, second, t = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    m, v = np.zeros_like(net.embed), np.zeros_like(net.embed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            grad, rows, moved = gradients(net, [ids[k] for k in own], y[own])
            t += 1
            rate, fix1, fix2 = RATE * (1 - epoch / EPOCHS), 1 - 0.9**t, 1 - 0.999**t
            for k, x in params.items():
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.001 * (grad[k] ** 2 - second[k])
                x -= (rate * (first[k] / fix1) / (np.sqrt(second[k] / fix2) + 1e-8)).astype(x.dtype)
            m[rows] += 0.1 * (moved - m[rows])
            v[rows] += 0.001 * (moved**2 - v[rows])
            net.embed[rows] -= (SLOWER * rate * (m[rows] / fix1) / (np.sqrt(v[rows] / fix2) + 1e-8)).astype(np.float32)


def _thresholds(net: Net, found: list[str], ids: list[np.ndarray], y: np.ndarray) -> dict[str, float]:
    """The logit that best splits each language's left-out documents ("" for all)."""
    if not len(y):
        return {}
    logit, lang = net.logits(ids), np.array(found)
    out = {}
    for name in ["", *sorted(set(lang))]:
        own = np.ones(len(y), bool) if not name else lang == name
        if own.sum() < LEAST or not 0 < y[own].sum() < own.sum():
            continue
        z, order = logit[own], np.argsort(logit[own])
        z, t = z[order], y[own][order]
        # right answers with a cut below each document, in either class evenly
        right = np.append(np.cumsum((1 - t) / (1 - t).sum()), 1)[:-1]
        right = np.concatenate([[0], right]) + np.concatenate([np.cumsum((t / t.sum())[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        # the middle of the best cuts, which says most about unseen documents
        good = np.flatnonzero(right >= right.max() - 1e-9)
        out[str(name)] = float((edges[good[0]] + edges[good[-1]]) / 2)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Net:
    """Net from the labelled rows of ``docs`` where ``learn`` holds."""
    languages = langid.fit(docs, learn)
    marked = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    # Three times the documents wanted of each class, by their hashes alone, come to its window.
    n = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    unit, share = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5, F.lit(0.0)
    for y, own in n.items():
        share = F.when(F.col("_y") == y, min(1.0, 3.0 * PER_CLASS / own)).otherwise(share)
    few = marked.where(unit <= share)
    sizes = docs.where(learn).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_n"), F.xxhash64("text").alias("_x")).where(F.col("_n") <= LONGEST)
    by = Window.partitionBy("_y").orderBy("_h", "doc_id", "_x").rowsBetween(Window.unboundedPreceding, -1)
    # of texts that share a doc_id the one with the least hash
    sizes = sizes.join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("_x", "_n")).alias("_s"))
    sized = few.join(sizes, "doc_id").select("doc_id", "_y", "_s.*")
    chosen = sized.withColumn("_h", F.xxhash64("doc_id")).withColumn("_c", F.coalesce(F.sum("_n").over(by), F.lit(0))).withColumn("_r", F.coalesce(F.count("*").over(by), F.lit(0)))
    chosen = chosen.where((F.col("_c") < CHARS) & (F.col("_r") < PER_CLASS)).select("doc_id", "_x", "_y")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_x"), "text").join(F.broadcast(chosen), ["doc_id", "_x"]).dropDuplicates(["doc_id", "_x", "_y"])
    held = docs.sparkSession.sparkContext.broadcast(languages)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            own = batch.column(3).to_pylist()
            ids = pa.array([[bucket(w) for w in words(t)] for t in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), ids, pa.array(held.value.predict(own)[0], pa.string())], names=["doc_id", "x", "y", "ids", "lang"])

    rows = texts.select("doc_id", "_x", "_y", "text").mapInArrow(hashed, "doc_id long, x long, y int, ids array<int>, lang string").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending"), ("y", "ascending")])
    ids = rows.column("ids").combine_chunks()
    at = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    net = train([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows.column("lang").to_pylist(), rows.column("y").to_pylist(), languages)
    net.learned = rows.column("doc_id").take(pa.array(net.learned, pa.int64())).to_pylist()
    return net


#: Logits are counted in steps of this for thresholds, and held to +-50.
STEP = 1 / 256


def thresholds(raw: DataFrame, marked: DataFrame, learned: list[int]) -> dict[str, float]:
    """The logit that best splits each language's labelled documents ("" for all),
    from counts of all that were not learned from.

    raw: doc_id, logit, lang_pred; marked: doc_id, _y.  The driver gets counts by
    language, class and step of the logit, whose number doesn't follow the rows."""
    known = raw.sparkSession.createDataFrame([(x,) for x in learned], "doc_id long")
    own = raw.join(marked, "doc_id").join(F.broadcast(known), "doc_id", "left_anti")  # PER_CLASS ids of a class at most
    step = F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("logit"))) / STEP).cast("int")
    seen = own.groupBy("lang_pred", step.alias("z")).agg(F.sum(F.col("_y").cast("long")).alias("p"), F.count("*").alias("n")).toArrow()
    lang, z = np.array(seen.column("lang_pred").to_pylist()), seen.column("z").to_numpy()
    pos = seen.column("p").to_numpy()
    neg, out = seen.column("n").to_numpy() - pos, {}
    for name in ["", *sorted(set(lang.tolist()))]:
        at = np.ones(len(z), bool) if not name else lang == name
        steps, place = np.unique(z[at], return_inverse=True)
        p, n = np.bincount(place, pos[at]), np.bincount(place, neg[at])
        if p.sum() + n.sum() < LEAST or not p.sum() or not n.sum():
            continue
        # right answers with a cut below each step, in either class evenly
        right = np.concatenate([[0], np.cumsum(n / n.sum())]) + np.concatenate([np.cumsum((p / p.sum())[::-1])[::-1], [0]])
        edges = np.concatenate([[steps[0] - 1 / STEP], (steps[1:] + steps[:-1]) / 2, [steps[-1] + 1 / STEP]]) * STEP
        good = np.flatnonzero(right >= right.max() - 1e-9)
        out[str(name)] = float((edges[good[0]] + edges[good[-1]]) / 2)
    return out


def scored(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> DataFrame:
    """doc_id, score, lang_pred of every document, with a net learned from a sample
    and thresholds from all other labelled documents where ``learn`` holds.

    Every document goes through the net once: its logit is written, and thresholds
    come from the written ones."""
    net = fit(docs, labels, learn, label)
    if not len(net.out):  # one class, or no label
        return score(docs, net)
    marked = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    net.shift = {}  # scores without thresholds are logits through a sigmoid
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            own = batch.column(1).to_pylist()
            z = held.value.logits([held.value.ids(t) for t in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(z, pa.float64()), pa.array(held.value.languages.predict(own)[0], pa.string())], names=["doc_id", "logit", "lang_pred"])

    raw = staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, logit double, lang_pred string"), "logits")
    shift = thresholds(raw, marked, net.learned)
    cut = F.lit(shift.pop("", 0.0))
    for name, x in shift.items():
        cut = F.when(F.col("lang_pred") == name, F.lit(x)).otherwise(cut)
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("logit") - cut))
    return raw.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "lang_pred")


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score, lang_pred of every document.  No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            p, lang = held.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array(lang, pa.string())], names=["doc_id", "score", "lang_pred"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)
