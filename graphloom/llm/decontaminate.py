"""Benchmark decontamination with an FM-index for each training shard.

Words of benchmark items get numbers; every other word is 0.  Only a stretch
of training words that are all benchmark words, as long as the shortest phrase
at least, can hold a phrase, so each shard (a bounded slice of documents)
indexes just its stretches, exactly.  The index of a shard is the
Burrows-Wheeler transform of its stretches as a wavelet tree of bit vectors
with rank counts, and every ``SAMPLE``-th suffix position.  All phrases are
searched backward at once, a rank step for each word, as arrays; their suffix
intervals are located by stepping to the next sampled position.  Occurrences
become word spans of their documents, which are merged.

Phrases are windows of ``width`` consecutive words of an item, or the whole
item if it is shorter; they are held as places in one array of word numbers.  A
shard first drops every phrase with a word that none of its stretches has, one
pass of a running sum over that array, and has nothing to search or to index if
none is left.  Items come in blocks of about ``ITEM_BLOCK`` bytes as encoded (long
items in parts that overlap), each broadcast by itself, so that what is broadcast
is bounded however many and however long items are; each further block is one
more pass over the documents.

Nulls and odd input.  A null or wordless text has no words and is clean; an
item without words has no phrase.  Items with equal text all count.  Repeated
documents each get a row.  Null item_ids are left out.  Extra columns are
ignored.  Without items or documents the result has no hits or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, spans_union, staged, worker_memory

WIDTH = 10
ITEM_BLOCK = 16 << 20
#: Bytes that a distinct word takes beside its own, and phrases searched at once.
WORD_COST, AT_ONCE = 100, 1 << 16
SAMPLE = 8
FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"

#: Bytes that make up words after folding A-Z; others become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class FMIndex:
    """FM-index of a sequence of numbers 0 .. top, 0 being a separator.

    Inside, numbers are one larger and a lowest one ends the sequence, so that
    no two suffixes are equal."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE):
        seq, top = np.concatenate([seq + 1, [0]]), top + 1
        n = len(seq)
        rank, step = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
        while rank.max() < n - 1:  # prefix doubling
            rank = np.unique(rank * n + np.roll(rank, -step), return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank)
        self.n, bwt = n, seq[order - 1]
        self.first = np.searchsorted(np.sort(seq), np.arange(top + 2))  # first row of each number
        self.levels, self.bits = max(1, int(top).bit_length()), []
        self.ones: list[np.ndarray] = []
        cur = bwt.astype(np.int64)
        for k in range(self.levels - 1, -1, -1):  # a wavelet tree, level by level, zeros before ones
            bit = (cur >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.bits.append(bit)
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.sampled = np.where(order % sample == 0, order, -1)

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each number in the transform before row ``at``."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, k in enumerate(range(self.levels - 1, -1, -1)):
            ones, bit = self.ones[level], (number >> k) & 1
            zeros_total = self.n - ones[-1]
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros_total + a, lo - a), np.where(bit, zeros_total + b, hi - b)
        return hi - lo

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The number that the transform has in each row."""
        out, at = np.zeros_like(row), row.copy()
        for level in range(self.levels):
            ones, bit = self.ones[level], self.bits[level][at]
            out = out * 2 + bit
            at = np.where(bit, self.n - ones[-1] + ones[at], at - ones[at])
        return out

    def back(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[number] + self.rank(number, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases (rows of equal length) occur, and their row intervals."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            number = phrases[which, k] + 1
            lo, hi = self.back(number, lo), self.back(number, hi)
            left = lo < hi  # those that occur no more are searched no further
            which, lo, hi = which[left], lo[left], hi[left]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to sampled ones."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            got = self.sampled[at[left]]
            hit = got >= 0
            out[left[hit]] = (got[hit] + steps[left[hit]]) % self.n
            left = left[~hit]
            at[left] = self.back(self.symbol(at[left]), at[left])
            steps[left] += 1
        return out


class Phrases:
    """The phrases of a block of items, as places in an array of word numbers."""

    def __init__(self, parts: list[tuple[str, list[bytes]]], width: int = WIDTH):
        ids: dict[bytes, int] = {}
        names = sorted({item for item, _ in parts})
        number, seq, starts, sizes, owners, at = {item: k for k, item in enumerate(names)}, [], [], [], [], 0
        for item, own in parts:
            if own:
                seq.append(np.array([ids.setdefault(w, len(ids) + 1) for w in own], np.int32))
                n = max(1, len(own) - width + 1)
                starts.append(np.arange(at, at + n, dtype=np.int32))
                sizes.append(np.full(n, min(width, len(own)), np.int16))
                owners.append(np.full(n, number[item], np.int32))
                at += len(own)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.names, self.blob = names, b" ".join(ids)  # words hold no space
        self.seq, self.starts, self.sizes, self.owners = join(seq, np.int32), join(starts, np.int32), join(sizes, np.int16), join(owners, np.int32)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    @property
    def ids(self) -> dict[bytes, int]:
        if not hasattr(self, "_ids"):
            self._ids = {w: k for k, w in enumerate(self.blob.split(), 1)}
        return self._ids

    @property
    def n_words(self) -> int:
        return len(self.ids)

    def possible(self, present: np.ndarray) -> np.ndarray:
        """Phrases all of whose words are ``present`` (a flag for each number)."""
        lacks = np.zeros(len(self.seq) + 1, np.int32)
        np.cumsum(~present[self.seq], out=lacks[1:])
        return np.flatnonzero(lacks[self.starts + self.sizes] == lacks[self.starts])


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, merged hit word spans, items."""
    get, counts, kept, starts, docs = phrases.ids.get, [], [], [], []
    for d, text in enumerate(texts):
        w = words(text)
        counts.append(len(w))
        if not w or not phrases.least:
            continue
        ids = np.fromiter(map(get, w, _ZEROS), np.int32, len(w))
        inside = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        for a, b in zip(inside[::2], inside[1::2], strict=True):
            if b - a >= phrases.least:
                kept += [ids[a:b], _SEPARATOR]
                starts.append(a)
                docs.append(d)
    spans, items = _occurrences(kept, np.array(starts), np.array(docs), phrases) if kept else ({}, {})
    return [(n, spans.get(d, []), items.get(d, [])) for d, n in enumerate(counts)]


def _occurrences(kept: list[np.ndarray], starts: np.ndarray, docs: np.ndarray, phrases: Phrases) -> tuple[dict, dict]:
    """Merged spans and item names of each text with any, from stretches that
    begin at word ``starts`` of ``docs``, each followed by a separator."""
    text = np.concatenate(kept)
    present = np.zeros(phrases.n_words + 1, bool)
    present[text] = True
    present[0] = False
    possible = phrases.possible(present)
    if not len(possible):
        return {}, {}
    rank = np.cumsum(present, dtype=np.int64)  # words of this shard alone
    rank[~present] = 0
    index, found = FMIndex(rank[text], int(rank.max())), []
    for n in np.unique(phrases.sizes[possible]).tolist():
        own = possible[phrases.sizes[possible] == n]
        for k in range(0, len(own), AT_ONCE):
            part = own[k : k + AT_ONCE]
            which, lo, hi = index.search(rank[phrases.seq[phrases.starts[part][:, None] + np.arange(n)]])
            found.append((np.full(len(which), n), lo, hi, phrases.owners[part[which]]))
    size, lo, hi, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(lo):
        return {}, {}
    # phrases with equal words have one interval, which is located once
    same, first, of = np.unique(size * index.n + lo, return_index=True, return_inverse=True)
    lo, n, size = lo[first], (hi - lo)[first], size[first]
    phrase = np.repeat(np.arange(len(same)), n)
    at = index.locate(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
    lengths = np.array([len(x) for x in kept[::2]]) + 1
    begin = np.cumsum(lengths) - lengths
    piece = np.searchsorted(begin, at, side="right") - 1
    doc, word = docs[piece], starts[piece] + at - begin[piece]
    spans, items = {}, {}
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    by_phrase = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[by_phrase], np.arange(len(same) + 1))
    for own in np.split(order, cuts):
        low, high = spans_union(word[own], word[own] + size[phrase[own]])
        d = int(doc[own[0]])
        spans[d] = list(zip(low.tolist(), high.tolist(), strict=True))
        mine = np.concatenate([owner[by_phrase[edge[p] : edge[p + 1]]] for p in np.unique(phrase[own])])
        items[d] = [phrases.names[k] for k in np.unique(mine)]
    return spans, items


class _Zeros:
    """An endless supply of default words for map(dict.get, words, _)."""

    def __iter__(self):
        from itertools import repeat

        return repeat(0)


_ZEROS, _SEPARATOR = _Zeros(), np.zeros(1, np.int32)


def item_blocks(benchmark: DataFrame, most: int | None = None, width: int = WIDTH) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Parts of items with their words, in blocks of bounded size, streamed to the
    driver one at a time.  Parts of one item share ``width`` - 1 words, so that
    each window is in one of them."""
    most = most or ITEM_BLOCK
    block, held, known = [], 0, set()
    step = max(1, most // (8 * WORD_COST))  # words of a part: an eighth of a block at most
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for item, text in rows.toLocalIterator():
        own = words(text)
        for k in range(0, max(1, len(own) - width + 1), step):
            part = own[k : k + step + width - 1]
            new = set(part) - known
            # numbers of words, one phrase for each (start, size, item), and new words
            cost = 14 * len(part) + sum(len(w) + WORD_COST for w in new)
            if block and held + cost > most:
                yield block
                block, held, known = [], 0, set()
            known.update(part)
            block.append((item, part))
            held += cost
    yield block


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, extra: list[str] | None = None, cut: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for each document; spans are merged
    half-open word spans.  extra: further columns of docs to carry along, whose
    names must not be among these; cut: text among them comes without the
    words of any span.  Nothing is shuffled; with more than one
    block of items, passes add to what was found, with a written table between."""
    blocks, extra = item_blocks(benchmark, width=width), list(extra or [])
    block, following = next(blocks), next(blocks, None)
    found = _find(docs, Phrases(block, width), extra if following is None else [*dict.fromkeys(["text", *extra])], cut=cut and following is None)
    while following is not None:
        block, following = following, next(blocks, None)
        found = _find(staged(found, "found"), Phrases(block, width), extra if following is None else [*dict.fromkeys(["text", *extra])], True, cut and following is None)
    return found


def _find(docs: DataFrame, phrases: Phrases, extra: list[str], more: bool = False, cut: bool = False) -> DataFrame:
    """more: docs holds items and spans of earlier blocks, to be added to."""
    held = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = FOUND + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    rest = [c for c in extra if c != "text"]
    lead = 4 if more else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            worker_memory("decontaminate")
            texts = batch.column(1).to_pylist()
            got = search_shard(texts, held.value)
            if more:
                old = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                got = [(n, _merged(spans, before), sorted({*items, *known})) for (n, spans, items), (known, before) in zip(got, old, strict=True)]
            text = pa.array([cut_spans(t, x[1]) if x[1] else t for t, x in zip(texts, got, strict=True)], pa.string()) if cut else batch.column(1)
            cols = [
                batch.column(0).cast(pa.int64()),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([sum(b - a for a, b in x[1]) for x in got], pa.int64()),
                pa.array([x[2] for x in got], pa.list_(pa.string())),
                pa.array([[{"begin": a, "end": b} for a, b in x[1]] for x in got], kind),
            ]
            carried = [text if c == "text" else batch.column(lead + rest.index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays(cols + carried, names=["doc_id", "n_words", "n_hit", "items", "spans", *extra])

    own = ["doc_id", F.col("text").alias("_text"), *(["items", "spans"] if more else [])]
    return docs.select(*own, *rest).mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]], before: list[dict]) -> list[tuple[int, int]]:
    both = np.array([*spans, *((x["begin"], x["end"]) for x in before)], np.int64).reshape(-1, 2)
    lo, hi = spans_union(both[:, 0], both[:, 1])
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans (from the first byte of a span's
    first word to the last byte of its last)."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their own columns, without the words of any hit span;
    texts without a hit stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # other columns under names that can't clash with what the search adds
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(f"x_{k}") for k, c in enumerate(rest)])
    out = find(renamed, benchmark, width, ["text", *[f"x_{k}" for k in range(len(rest))]], cut=True)
    back = {c: F.col(f"x_{k}").alias(c) for k, c in enumerate(rest)}
    if "n_chars" in rest:
        back["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[back.get(c, F.col(c)) for c in docs.columns])
