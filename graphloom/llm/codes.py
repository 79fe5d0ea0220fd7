"""Vector code compression: product codebooks by Elkan's exact Lloyd rounds.

Vectors become integers, are cut into equal parts, and every part position has
its own codebook.  A round assigns each part to its nearest entry and moves
entries to the floored mean of their parts.  After a round each part's upper
bound (distance to its own entry) and one lower bound for every entry are
persisted beside its code.  The next round shifts them by how far entries have
moved and computes only distances that the bounds and the triangle inequality
can't rule out: an entry is skipped where its lower bound, or half its distance
from the part's own entry, is strictly larger than the upper bound.  Bounds are
floats rounded outwards, so an entry as near as the best one is never skipped,
and distances are compared as integers; ties go to the lower index.  Results
equal a full search.

Rows stay where they are: a round is one pass over the table of the round
before, and only sums by part, entry and place are shuffled (combined first).
The driver holds the codebooks, parts x entries x places numbers whatever the
number of vectors.  Each round's table is written to the shared folder; the one
before goes when it stands.

Nulls and odd input.  Vectors that are null, empty, or hold null or non-finite
components, and those of another length than the first kept one, are dropped.
Integers are held at +-2^24 (components of +-65,536), so that sums are exact.  A
length that no ``parts`` equal parts fill is filled up with zeros.  Null ids
come after all others; rows alike in id order by their vectors, and repeated
rows are rows.  With fewer rows than entries, codebooks have an entry a row.  Extra
columns are ignored.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond this are held at it.
LARGEST = 1 << 24
#: Rows of which a task holds distances at once.
BLOCK = 2048
#: Labels with this share of the rows are settled by broadcast.
HOT = 1 / 1000
_AWAY = np.iinfo(np.int64).max
_LESS, _MORE = 1 - 1e-9, 1 + 1e-9


def integers(table: DataFrame, vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (array of whole numbers) of the vectors that take part."""
    x = F.col(vector)
    whole = F.size(x) > 0
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(v.cast("double") * scale).cast("double"))).cast("int"))
    return table.where(whole & finite).select("vec_id", F.col(label).alias("label"), held.alias("x"))


def down(d: np.ndarray) -> np.ndarray:
    """Distances as half floats, none larger than it was."""
    d = np.minimum(d, 65504.0)
    h = d.astype(np.float16)
    return np.where(h > d, np.nextafter(h, np.float16(0)), h)


def up(d: np.ndarray) -> np.ndarray:
    h = d.astype(np.float32)
    return np.where(h < d, np.nextafter(h, np.float32(np.inf)), h)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of rows and entries, in whole numbers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


@dataclass
class Codebooks:
    """entries[part, entry, place], and how far each moved in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(parts, rows, places) of rows of whole vectors."""
        p, _, d = self.entries.shape
        full = np.zeros((len(x), p * d), np.int64)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), p, d).transpose(1, 0, 2)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes, upper and lower bounds by computing every distance."""
        codes, upper, lower = [], [], []
        for part, c in zip(self.cut(x), self.entries, strict=True):
            d = squared(part, c)
            own = d.argmin(1)  # the first of the nearest
            far = np.sqrt(d.astype(np.float64))
            codes.append(own)
            upper.append(up(far[np.arange(len(own)), own]))
            lower.append(down(far))
        return np.stack(codes, 1).astype(np.uint8), np.stack(upper, 1), np.stack(lower, 1)

    def update(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the round before by its bounds; and the number of
        distances computed.  codes (rows, parts), lower (rows, parts, entries)."""
        codes, upper, lower, n = codes.astype(np.int64), upper.astype(np.float64), lower.astype(np.float64), 0
        for p, (part, c) in enumerate(zip(self.cut(x), self.entries, strict=True)):
            a = codes[:, p].copy()
            u = upper[:, p] + self.moved[p, a] * _MORE
            low = np.maximum(lower[:, p] - self.moved[p] * _MORE, 0.0)
            half = 0.5 * np.sqrt(squared(c, c).astype(np.float64)) * _LESS
            nearest = np.where(np.eye(len(c), dtype=bool), np.inf, half).min(1)
            rows = np.flatnonzero(u >= nearest[a])

            def open_(rows: np.ndarray, low=low, half=half, u=u, a=a) -> np.ndarray:
                may = (low[rows] <= u[rows, None]) & (half[a[rows]] <= u[rows, None])
                may[np.arange(len(rows)), a[rows]] = False
                return may

            rows = rows[open_(rows).any(1)]
            own = ((part[rows] - c[a[rows]]) ** 2).sum(1)
            u[rows] = np.sqrt(own.astype(np.float64)) * _MORE
            low[rows, a[rows]] = np.sqrt(own.astype(np.float64)) * _LESS
            r, e = np.nonzero(open_(rows))
            found = ((part[rows[r]] - c[e]) ** 2).sum(1)
            low[rows[r], e] = np.sqrt(found.astype(np.float64)) * _LESS
            n += len(rows) + len(r)
            d = np.full((len(rows), len(c)), _AWAY)
            d[np.arange(len(rows)), a[rows]] = own
            d[r, e] = found
            best = d.argmin(1)  # integers: of equal ones the lower index
            codes[rows, p] = best
            u[rows] = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64)) * _MORE
            upper[:, p], lower[:, p] = u, low
        return codes.astype(np.uint8), up(upper), down(lower), n

    def error(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances to own entries, summed over parts."""
        return sum((((part - c[codes[:, p]]) ** 2).sum(1) for p, (part, c) in enumerate(zip(self.cut(x), self.entries, strict=True))), np.zeros(len(x), np.int64))


def _vectors(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _bytes(batch: pa.RecordBatch, column: str, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(column)).to_pylist()), kind).reshape(batch.num_rows, *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    raw, width = rows.tobytes(), rows[0].nbytes
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            yield b.slice(lo, BLOCK)


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, x with codes, upper and lower: found by a full search where
    ``rows`` has no bounds, else by those of the round before."""
    known, own = "codes" in rows.columns, {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name in ("vec_id", "label", "x")}
    parts, entries, _ = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x = _vectors(b).astype(np.int64)
            if known:
                found = books.update(x, _bytes(b, "codes", np.uint8, parts), _bytes(b, "upper", np.float32, parts), _bytes(b, "lower", np.float16, parts, entries))[:3]
            else:
                found = books.search(x)
            yield pa.RecordBatch.from_arrays([*b.select(list(own)).columns, *map(_binary, found)], names=[*own, "codes", "upper", "lower"])

    schema = ", ".join(f"`{c}` {t}" for c, t in own.items()) + ", codes binary, upper binary, lower binary"
    return rows.select(*own, *(["codes", "upper", "lower"] if known else [])).mapInArrow(run, schema)


def moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floored means of their parts; unused ones stay."""
    parts, entries, places = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, places), np.int64), np.zeros((parts, entries), np.int64)
        for b in _blocks(batches):
            x, codes = books.cut(_vectors(b).astype(np.int64)), _bytes(b, "codes", np.uint8, parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for d in range(places):  # exact: 2,048 rows of 2^24 at most
                    total[p, :, d] += np.bincount(codes[:, p], x[p, :, d], entries).astype(np.int64)
        used = np.argwhere(np.broadcast_to(count[:, :, None], total.shape))
        p, e, d = used.T
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(d), pa.array(total[p, e, d]), pa.array(count[p, e])], names=["part", "entry", "place", "total", "n"])

    sums = state.select("x", "codes").mapInArrow(run, "part long, entry long, place long, total long, n long")
    new = books.entries.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts x entries x places at most
        new[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(new, np.sqrt(((new - books.entries) ** 2).sum(2).astype(np.float64)))


def started(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the parts of the rows with the smallest ids; none without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    places = -(-len(first[0].x) // parts)
    books = Codebooks(np.zeros((parts, 0, places), np.int64), np.zeros((parts, 0)))
    start = books.cut(np.array([r.x for r in first if len(r.x) == len(first[0].x)], np.int64))
    return Codebooks(start, np.zeros(start.shape[:2]))


def compress(table: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, codes (a byte a part), error; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = integers(table, vector, label, scale)
    length = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).limit(1).collect()
    rows = staged(rows.where(F.size("x") == (length[0][0] if length else 0)), "vectors")
    books, own = started(rows, parts, entries), {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = ", ".join(f"`{c}` {t}" for c, t in own.items()) + ", codes binary, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema), None
    state = rows
    for _ in range(rounds):
        before, state = state, staged(assigned(state, books), "bounds")
        dropped(before)
        books = moved(state, books)
    last = books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x, codes = _vectors(b).astype(np.int64), _bytes(b, "codes", np.uint8, parts)
            yield pa.RecordBatch.from_arrays([*b.select(list(own)).columns, _binary(codes), pa.array(last.error(x, codes))], names=[*own, "codes", "error"])

    final = assigned(state, books).select(*own, "x", "codes").mapInArrow(run, schema)
    final, before = staged(final, "codes"), state
    dropped(before)
    return final, books


def decoded(codes: np.ndarray, books: Codebooks, length: int, scale: int = SCALE) -> np.ndarray:
    """Vectors of which codes (rows, parts) are the code: the middle of each step."""
    parts = [books.entries[p][codes[:, p]] for p in range(books.entries.shape[0])]
    return (np.concatenate(parts, 1)[:, :length] + 0.5) / scale


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels, nulls together.  Labels
    of a thousandth of all rows, a thousand at most, come by broadcast; no other
    has so many, and they are joined by a shuffle."""
    key = F.struct("label")  # a struct of null is a key like any other
    rows = rows.withColumn("_key", F.to_json(key))
    sums = staged(rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    least = max(1, -(-rows.count() * HOT // 1))
    hot = F.broadcast(sums.where(F.col("_n") >= least).select("_key", "label_error"))
    met = rows.join(hot, "_key", "left")
    rest = met.where(F.col("label_error").isNull()).drop("label_error").join(sums.where(F.col("_n") < least).select("_key", "label_error").hint("shuffle_hash"), "_key")
    return met.where(F.col("label_error").isNotNull()).unionByName(rest).drop("_key")
