"""Near-duplicate detection with circulant MinHash and exact verification.

A document is the set of its distinct five-word shingles (64-bit hashes).  Two
permutations of 2^20 positions make all signature coordinates: the first
spreads a shingle to position i, the second, circularly shifted by k, gives it
the value pi[i - k]; coordinate k is the least of these over the set.  Since the
values for k = 0 .. K-1 lie side by side in pi, a signature is the minimum of
slices of one array.

1. Documents with equal sets form a class; only classes go on, so copies never
   meet in a bucket.
2. K = 160 coordinates make 32 bands of 5.  A pair at the threshold 0.85 shares
   no band with probability (1 - 0.85^5)^32 < 1e-8, one at 0.80 with 3e-6.
3. Full sets are made for the classes that share a bucket.  Each class of a
   bucket is paired with one leader (stars, so pairs stay linear in buckets):
   first the least class, then, for those not yet in the leader's component,
   the one with most links.  Pairs are verified on full sets,
   100 |A n B| >= 85 |A u B|, and verified links give components.
4. Where a bucket still holds several components, their classes are compared by
   byte sketches of the signatures; estimates of ``near_estimate`` (four and a
   half standard deviations under the threshold) or more join components into
   neighbourhoods.  In each of these every class outside the largest component
   is intersected with all others, exactly, in blocks of bounded size.  Only a
   spanning forest of the links found leaves a task, never all pairs, and
   nothing is capped.

Nulls and odd input.  A text without words, or null, has the empty set and is
linked with nothing, itself alone.  A text with fewer than five words is one
shingle, its whole sequence.  Rows that share a doc_id are separate documents
with the same name; repeated rows fall in one class.  The component of a
document whose id is null is named by the least id that is not null, or null.
Extra columns are ignored.  No documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import hash_of_row, slices, staged, worker_memory
from graphloom.llm.components import components

WIDTH, THRESHOLD = 5, 85
BANDS, ROWS = 32, 5
K = BANDS * ROWS
UNIVERSE = 1 << 20
BLOCK = 4096
#: Shingles of a neighbourhood that one task holds, about.
HELD = 1_500_000
SIGNED = "doc_id long, x long, n_shingles long, node binary, bands array<long>, sketch binary"

def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and rows of pi for every position: row i is pi[i-K+1 .. i]."""
    tables = worker_memory("minhash")
    if not tables:
        rng = np.random.default_rng(20240229)
        tables["sigma"] = rng.permutation(UNIVERSE).astype(np.uint32)
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = np.concatenate([pi[-(K - 1) :], pi])
        tables["rows"] = np.lib.stride_tricks.sliding_window_view(ring, K)
    return tables["sigma"], tables["rows"]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n, mixed = len(w) - width + 1, np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(own: np.ndarray) -> np.ndarray:
    sigma, rows = _permutations()
    at, out = sigma[own & np.uint64(UNIVERSE - 1)], None
    for lo in range(0, len(at), 4096):
        part = rows[at[lo : lo + 4096]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, in which its number is mixed."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in sig.reshape(BANDS, ROWS).T:
        key = (key ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def node_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """Set size, class, band keys and sketch of each document, x: a hash of its
    text.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                own = shingles(text)
                sig = signature(own) if len(own) else None
                row = (len(own), node_of(own), band_keys(sig).tolist(), sig.astype(np.uint8).tobytes()) if len(own) else (0, None, None, None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "x", "n_shingles", "node", "bands", "sketch"])

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SIGNED)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, n, own: the full sets of the given classes, made again from the
    text of a document of each; other texts go no further than the semi-join."""
    named = [F.coalesce("doc_id", F.lit(0)).alias("_m"), F.col("doc_id").isNull().alias("_n")]
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("member").alias("doc_id")).select(*named).distinct()
    # a doc_id that stands for several texts brings them all; nodes tell them apart
    rows = docs.select(*named, "text").join(wanted, ["_m", "_n"], "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t) for t in batch.column(0).to_pylist()]
            cols = [pa.array([node_of(x) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "own"])

    return staged(rows.mapInArrow(sets, "node binary, n long, own array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold.

    Sets meet row by row inside the join, so memory is that of two sets, however
    long the texts of a pair and however many pairs a class has."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    close = 100 * both >= threshold * (F.col("n_a") + F.col("n_b") - both)
    return pairs.join(one("b"), "b").join(one("a"), "a").where(close).select("a", "b")


class Union:
    """Disjoint sets of numbers; the forest is what joined them."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _pair_table(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def _in_blocks(own: DataFrame, group: str, more: list[str]) -> DataFrame:
    """Rows of each group dealt to tasks (group, o, b): every row outside the
    group's main component meets every row of the group in one of them.  own:
    node, label, main, nb and no (numbers of blocks of all and of outside rows)."""
    spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = own.select(group, "node", "label", *more, F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("o"), spot(F.col("nb"), 1).alias("b"))
    outside = own.where(F.col("label") != F.col("main"))
    outside = outside.select(group, "node", "label", *more, F.lit(True).alias("outside"), spot(F.col("no"), 2).alias("o"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    # dealt by task, for a join by group would leave all of a group's tasks in one
    return each.unionByName(outside).repartition(group, "o", "b")


def _labels_of(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, Union, np.ndarray]:
    """Names and numbers of labels, rows outside and not, and disjoint sets."""
    out = np.array(table.column("outside").to_pylist(), bool)
    names, label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)
    return [bytes.fromhex(x) for x in names], label, np.flatnonzero(out), Union(len(names)), np.flatnonzero(~out)


def near_estimate(threshold: int = THRESHOLD) -> float:
    """The share of equal coordinates that a pair at the threshold reaches but
    for four and a half standard deviations: 0.723 at 85, 0.658 at 80."""
    t = threshold / 100
    return t - 4.5 * (t * (1 - t) / K) ** 0.5


def neighbourhoods(rows: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """label, hood: components that sketches bring near each other."""
    least = near_estimate(threshold) * K
    marked = rows.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    several = parts.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"))
    # of buckets with the same classes, one; two classes alone were compared
    several = several.where("c > 1 and n > 2").groupBy("n", "h").agg(F.min_by(F.struct("key", "main", "most"), "key").alias("s"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    several = several.select("s.key", "s.main", blocks(F.col("n")).alias("nb"), blocks(F.col("n") - F.col("s.most")).alias("no"))
    own = marked.join(several, "key").join(classes.select("node", "sketch"), "node")

    def compare(table: pa.Table) -> pa.Table:
        names, label, outside, sets, rest = _labels_of(table)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, K)
        mine, pairs = sketch[rest], []
        for i in outside:
            near = (mine == sketch[i]).sum(axis=1) >= least
            for j in np.unique(label[rest[near]]):
                if sets.join(int(label[i]), int(j)):
                    pairs.append((names[label[i]], names[j]))
        return _pair_table(pairs)

    near = _in_blocks(own, "key", ["sketch"]).groupBy("key", "o", "b").applyInArrow(compare, "a binary, b binary")
    return components(near).select(F.col("node").alias("label"), F.col("label").alias("hood"))


def exact_links(hoods: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: links between components (by their labels) within neighbourhoods."""
    own = sets.join(labels, "node", "left").select("node", "n", "own", F.coalesce("label", "node").alias("label")).join(hoods, "label")
    parts = own.groupBy("hood", "label").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / HELD)).cast("int")
    sizes = parts.groupBy("hood").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("n").alias("all"), F.max_by("n", F.struct("c", "label")).alias("most"))
    sizes = sizes.select("hood", "main", blocks(F.col("all")).alias("nb"), blocks(F.col("all") - F.col("most")).alias("no"))

    def link(table: pa.Table) -> pa.Table:
        names, label, outside, sets_, rest = _labels_of(table)
        own = table.column("own").combine_chunks()
        values, cuts = own.values.to_numpy(zero_copy_only=False), own.offsets.to_numpy()
        each = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if not len(outside) or not len(rest):
            return _pair_table([])
        # for each shingle, the rows that hold it, one after another
        size = np.array([len(each[j]) for j in rest])
        flat = np.concatenate([each[j] for j in rest])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], np.repeat(np.arange(len(rest)), size)[order]
        pairs = []
        for i in outside:
            lo, hi = np.searchsorted(flat, each[i], "left"), np.searchsorted(flat, each[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holder[at], minlength=len(rest))
            linked = 100 * both >= threshold * (size + len(each[i]) - both)
            for j in np.unique(label[rest[linked]]):
                if sets_.join(int(label[i]), int(j)):
                    pairs.append((names[label[i]], names[j]))
        return _pair_table(pairs)

    return _in_blocks(own.join(sizes, "hood"), "hood", ["own"]).groupBy("hood", "o", "b").applyInArrow(link, "a binary, b binary")


def grouped(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """doc_id, x, n_shingles, node of each document, and node, member, label of
    each class: label is the least class of its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(sign(docs), "signed")
    first = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("member"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = staged(first, "classes")
    exploded = classes.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    rows = staged(exploded.join(shared, "key").select("key", "node", "a"), "rows")
    sets = full_sets(rows.select("node").distinct(), classes, docs)
    pairs = staged(rows.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = staged(verified(pairs, sets, threshold), "links")
    labels = components(links)
    rows = rows.select("key", "node")
    # again, with each bucket's most linked class in the lead
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    marked = rows.join(labels, "node", "left").join(degree, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("d", F.lit(0)).alias("d"))
    lead = marked.groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct("d", "node")).alias("lead"))
    again = marked.join(lead, "key").where(F.col("label") != F.col("lead.label")).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    links = links.unionByName(staged(verified(staged(again.join(pairs, ["a", "b"], "left_anti"), "pairs"), sets, threshold), "links"))
    labels = components(links)
    hoods = neighbourhoods(rows, labels, classes, threshold)
    if hoods.limit(1).count():
        by_label = components(staged(exact_links(hoods, labels, sets, threshold), "links"))
        least = by_label.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        every = rows.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        labels = every.join(least, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    named = classes.select("node", "member").join(labels, "node", "left").select("node", "member", F.coalesce("label", "node").alias("label"))
    return signed.select("doc_id", "x", "n_shingles", "node"), named


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    own, named = grouped(docs, threshold)
    by_node = named.join(named.groupBy("label").agg(F.min("member").alias("component_id")), "label").select("node", "component_id")
    linked = own.where(F.col("node").isNotNull()).join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    alone = own.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with its own columns: the least doc_id,
    then the least text hash, then the least hash of all columns.  Documents without words all stay, as they are
    linked with nothing."""
    own, named = grouped(docs, threshold)
    marked = own.join(named.select("node", "label"), "node")
    # least by (null last, doc_id, text hash), combined before the shuffle
    stays = marked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("__near_n"), F.coalesce("doc_id", F.lit(0)).alias("__near_m"), F.col("x").alias("__near_x"))).alias("s")).select("s.*").distinct()
    has_words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    keyed = docs.withColumns({"__near_n": F.col("doc_id").isNull(), "__near_m": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__near_x": F.xxhash64("text"), "__near_has": has_words, "__near_h": hash_of_row(docs)})
    own = ["__near_n", "__near_m", "__near_x"]
    place = F.row_number().over(Window.partitionBy(*own).orderBy("__near_h"))
    kept = keyed.where("__near_has").join(stays, own, "left_semi").withColumn("__near_r", place).where(F.col("__near_r") == 1).drop("__near_r")
    return kept.unionByName(keyed.where(~F.col("__near_has"))).select(*docs.columns)
