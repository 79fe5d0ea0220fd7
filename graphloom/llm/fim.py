"""Fill-in-the-middle transformation of texts.

A text is decoded to a numpy array of UTF-32 code points.  Every code point has
a class, and a unit is a run of one class: comparing neighbouring classes and
``flatnonzero`` give the boundaries of all units.  Numbers hashed from the
document's id choose two boundaries by rank; the three pieces between are
sliced, encoded again and put together around the sentinels, prefix first
(psm) or suffix first (spm), or the text stays plain.

Units: ``char`` (each code point is one: classes alternate), ``word`` (runs of
letters, of spaces, of others) and ``line`` (a line with its end).

Nulls and odd input.  A null text counts as empty; an empty one is plain, as is
a text that holds a sentinel.  A null id hashes as empty text.  Equal ids cut
alike.  Repeated rows are transformed each.  A text is handled whole, whatever
its length.  Bytes that are no UTF-8 are a code point each and come back as they were.
Extra columns are ignored.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices

#: Begin of prefix, of suffix and of middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents, so many are cut; of 100 of those, so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: The order of pieces in each form: sentinel and piece (prefix, suffix, middle by number).
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


def hashed_numbers(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers: the first hex groups of the id's SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def codepoints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; where neighbours differ a unit ends."""
    if unit == "char":
        return np.arange(len(points)) & 1
    if unit == "line":
        ends = points == 10
        return np.cumsum(ends) - ends
    if unit != "word":
        raise ValueError(f"no such unit: {unit}")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    low = points | 32
    letter = (points > 127) | ((low >= 97) & (low <= 122)) | ((points >= 48) & (points <= 57))
    return np.where(space, 0, np.where(letter, 1, 2))


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    own = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(points)]])


def cut(raw: bytes, h: tuple[int, int, int, int], unit: str = "char", share: int = CUT, spm: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """units, form, prefix_chars, middle_chars and the output of one text."""
    points = codepoints(raw)
    edges = boundaries(points, unit)
    n, marks = len(edges) - 1, [s.encode() for s in SENTINELS]
    if not raw or h[2] % 100 >= share or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    lo, hi = sorted((int(edges[h[0] % (n + 1)]), int(edges[h[1] % (n + 1)])))
    pieces = [encoded(points[:lo]), encoded(points[hi:]), encoded(points[lo:hi])]
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, lo, hi - lo, b"".join(marks[k] + pieces[k] for k in FORMS[form])


def joined(output: bytes, form: str) -> bytes:
    """The text from output and form alone.  A sentinel ends with a sign that it
    holds once and begins with another, so none arises across a seam."""
    if form == "plain":
        return output
    order, marks = FORMS[form], [s.encode() for s in SENTINELS]
    at = len(marks[order[0]])
    second = output.index(marks[order[1]], at)
    third = output.index(marks[order[2]], second + len(marks[order[1]]))
    piece = {order[0]: output[at:second], order[1]: output[second + len(marks[order[1]]) : third], order[2]: output[third + len(marks[order[2]]) :]}
    return piece[0] + piece[2] + piece[1]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)  # bytes as they are


def transform(docs: DataFrame, seed: str = "1", unit: str = "char", share: int = CUT, spm: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output."""
    rows = docs.select("doc_id", "text", *[h.alias(f"h{k}") for k, h in enumerate(hashed_numbers(F.col("doc_id"), seed))])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = np.stack([b.column(k + 2).to_numpy(zero_copy_only=False) for k in range(4)], 1).tolist()
            done = [cut(raw or b"", tuple(own), unit, share, spm) for raw, own in zip(b.column(1).cast(pa.binary()).to_pylist(), h, strict=True)]
            n, form, prefix, middle, out = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(list(out))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` with ``text``: rebuilt from output and form alone."""
    names = [c for c in transformed.columns if c != "text"]
    rows, kept = transformed.select(*names), transformed.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "output"):
            out, form = (b.column(names.index(c)) for c in ("output", "form"))
            text = _strings([joined(o, f) for o, f in zip(out.cast(pa.binary()).to_pylist(), form.to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*names, "text"])

    return rows.mapInArrow(run, kept.add("text", "string"))
