"""Exact substring deduplication by a distributed merge sort of suffixes.

A byte goes if a string of ``SPAN`` (50) bytes that covers it also starts in a
document with a smaller doc_id.  Sorting every suffix of a corpus would move
many times its size, so suffixes are sampled, without loss: each window of 50
bytes has an anchor, the first of its 24-byte grams with the least hash.
Windows next to each other mostly share their anchor; the bytes of such a run
are one string, split at the anchor: the suffix that begins there (up to the
last window's end) and what stands before it.  Equal windows have equal grams
at equal offsets, so all occurrences of a window are in strings whose suffixes
share their first 24 bytes, and meet in sorted order.

1. Texts are laid in blocks (written once, compressed).  Copies of a text that
   fall together are kept once with all their ids.
2. Every block sends its sorted anchor hashes, delta-coded, by ranges; an answer
   of one bit each says which occur in more than one text.  Only strings at
   such anchors go on.
3. Every block sends its sorted, front-coded run of such strings to each range,
   where a loser tree merges the runs.  Each run's head carries the length of
   its prefix shared with the last string put out; heads with different lengths
   are ordered by these alone, and equal ones are compared beyond them, so no
   known prefix is compared again.  Strings that share 24 bytes with the one
   before form a group.  A window may begin before its anchor, so that shared
   prefixes alone don't decide it: each window's least doc_id is found within the
   group.  The number of ranges follows the bytes of text, so that what a task
   merges stays the same however many there are.
4. A mask for each string, of windows that a smaller doc_id has, returns to its
   block, where windows become removed bytes.

Copies of a passage in one block are one string of its run, so what a range
receives of a passage grows with the blocks, not with the documents.

Nulls and odd input.  A null text is an empty one.  A null doc_id is larger
than any other: its bytes go where a numbered document has them, and it never
takes bytes from others.  Documents with equal doc_ids take nothing from each
other; repeated rows each get their row.  A text under 50 bytes keeps all.
Extra columns are ignored.  No documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged

SPAN, GRAM = 50, 24
SLIDE = SPAN - GRAM + 1
BLOCK_BYTES = 4 << 20
#: Text for each range of suffixes; a range is merged by one task.
RANGE_BYTES = 4 << 20
CHUNK = (1 << 16) - SPAN
#: Copies of a text are collected in so many groups, so that none gathers a third of all rows.
SALTS = 16
NO_ID = np.iinfo(np.int64).max
BLOCKS = "block long, texts binary, sizes binary, n_ids binary, ids binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the gram at each position, by doubling lengths."""
    h = (buf.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    n, eight = 1, None
    while n < 16:
        h = h[:-n] * _M2 + h[n:]
        h ^= h >> np.uint64(32)
        n *= 2
        eight = h if n == 8 else eight
    count = len(buf) - GRAM + 1
    h = h[:count] * _M2 + eight[16 : 16 + count]
    h ^= h >> np.uint64(31)
    h *= _M3
    return h ^ (h >> np.uint64(33))


class Block:
    """Texts side by side, each followed by a byte that no text holds."""

    def __init__(self, row: tuple):
        self.id, raw, sizes, n_ids, ids = row
        self.sizes = np.frombuffer(sizes, np.int64)
        self.n_ids, self.ids = np.frombuffer(n_ids, np.int64), np.frombuffer(ids, np.int64)
        self.buf = np.frombuffer(_unpress(raw), np.uint8)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.first_id = self.ids[np.cumsum(self.n_ids) - self.n_ids]  # ids of a text ascend

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first window, last window, anchor, anchor hash (48 bits), text of each
        run of windows with one anchor."""
        n = len(self.buf) - SPAN + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # windows that reach over the end of their text are none
        outside = np.zeros(n + 1, np.int8)
        ends = self.begin + self.sizes + 1
        np.add.at(outside, np.minimum(np.maximum(self.begin, ends - SPAN), n), 1)
        np.add.at(outside, np.minimum(ends, n), -1)
        outside = np.cumsum(outside[:-1], dtype=np.int8) > 0
        offset, firsts, anchors, hashes, stops, last = np.uint64(0xFFFF), [], [], [], [], -1
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            h = gram_hashes(self.buf[lo : hi + SPAN - 1])
            least = (h & ~offset) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width * 2 <= SLIDE:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = SLIDE - width
            least = np.minimum(least[: len(least) - rest], least[rest:])[: hi - lo]
            anchor, out = (least & offset).astype(np.int64) + lo, outside[lo:hi]
            # a run of windows begins at another anchor or after windows outside
            change = np.diff(anchor, prepend=last) != 0
            change[1:] |= out[:-1]
            change[0] |= lo > 0 and outside[lo - 1]
            at = np.flatnonzero(change & ~out)
            firsts.append(at + lo)
            anchors.append(anchor[at])
            hashes.append(least[at] >> np.uint64(16))
            stops.append(np.flatnonzero(change | out) + lo)
            last = anchor[-1]
        first, stop = np.concatenate(firsts), np.append(np.concatenate(stops), n)
        text = np.searchsorted(self.begin, first, side="right") - 1
        # least hashes crowd near zero: mixed again, they spread over all ranges
        mixed = np.concatenate(hashes) * _M1 >> np.uint64(16)
        return first, stop[np.searchsorted(stop, first, side="right")] - 1, np.concatenate(anchors), mixed, text


def make_blocks(docs: DataFrame, partitions: int) -> DataFrame:
    """Blocks of distinct texts; the one shuffle of texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("text").alias("x"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id", "text")
    placed = rows.repartition(partitions, "x", "salt").sortWithinPartitions("x", "id")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        texts: list[bytes] = []
        ids: list[list[int]] = []

        def block() -> pa.RecordBatch:
            sizes, n_ids = np.array([len(t) for t in texts], np.int64), np.array([len(x) for x in ids], np.int64)
            row = (part << 32 | nth, _press(b"\xff".join([*texts, b""])), sizes.tobytes(), n_ids.tobytes(), np.array([d for x in ids for d in x], np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["block", "texts", "sizes", "n_ids", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                if texts and texts[-1] == raw:
                    ids[-1].append(doc)
                    continue
                if held + len(raw) > BLOCK_BYTES and texts:
                    yield block()
                    nth, held = nth + 1, 0
                    texts.clear()
                    ids.clear()
                texts.append(raw)
                ids.append([doc])
                held += len(raw)
        if texts:
            yield block()

    return staged(placed.select("id", "text").mapInArrow(lay, BLOCKS), "blocks")


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list]]:
    """Blocks one at a time, with what further columns hold for each."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
            yield Block(tuple(row[:5])), row[5:]


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, bytes of one rank side by side."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _press(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Ranges:
    """Which of ``parts`` ranges a 48-bit hash falls in, and its leading bits,
    as many as leave few chance meetings among ``total`` bytes of text."""

    def __init__(self, parts: int, total: int):
        self.parts, self.cut = parts, np.uint64(48 - min(48, max(8, int(total // 14 + 1).bit_length() + 6)))

    def short(self, hashed: np.ndarray) -> np.ndarray:
        return hashed >> self.cut

    def of(self, short: np.ndarray) -> np.ndarray:
        return ((short << self.cut) // np.uint64(-(-(1 << 48) // self.parts))).astype(np.int64)


def _anchors(block: Block, ranges: Ranges) -> tuple[tuple, np.ndarray, np.ndarray]:
    """A block's strings, their short hashes and the distinct ones, sorted."""
    found = block.strings()
    short = ranges.short(found[3])
    return found, short, np.unique(short)


def repeated_anchors(blocks: DataFrame, ranges: Ranges) -> DataFrame:
    """block, part, bits: for each block's distinct hashes of a range, in
    order, whether they occur in another text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks_in(batches):
            found, short, distinct = _anchors(block, ranges)
            if not len(distinct):
                continue
            at = np.searchsorted(distinct, short)
            low, high = np.full(len(distinct), 1 << 62, np.int64), np.full(len(distinct), -1, np.int64)
            np.minimum.at(low, at, found[4])
            np.maximum.at(high, at, found[4])
            part = ranges.of(distinct)
            cuts = np.flatnonzero(np.diff(part)) + 1
            lows, highs = [0, *cuts], [*cuts, len(part)]
            several = low != high
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.id] * len(lows), pa.int64()),
                    pa.array(part[np.array(lows)].astype(np.int32), pa.int32()),
                    pa.array([_pack(distinct[a:b]) for a, b in zip(lows, highs, strict=True)], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(lows, highs, strict=True)], pa.binary()),
                ],
                names=["block", "part", "hashes", "several"],
            )

    def answer(runs: pa.Table) -> pa.Table:
        each = [_unpack(x) for x in runs.column("hashes").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(h)) for s, h in zip(runs.column("several").to_pylist(), each, strict=True)])
        whole, count = np.unique(np.concatenate(each), return_inverse=True)[1], None
        count = np.bincount(whole) + np.bincount(whole, twice)
        bits = np.split(count[whole] > 1, np.cumsum([len(h) for h in each])[:-1])
        return pa.table({"block": runs.column("block"), "part": runs.column("part"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    runs = blocks.mapInArrow(send, "block long, part int, hashes binary, several binary").repartition(ranges.parts, "part")
    return runs.groupBy("part").applyInArrow(answer, "block long, part int, bits binary")


def _repeated(block: Block, ranges: Ranges, answers: list[dict]) -> tuple[tuple, np.ndarray]:
    """The block's strings whose anchors are repeated, and their ranges."""
    found, short, distinct = _anchors(block, ranges)
    part, on = ranges.of(distinct), np.zeros(len(distinct), bool)
    for a in answers:
        lo, hi = np.searchsorted(part, [a["part"], a["part"] + 1])
        on[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
    keep = on[np.searchsorted(distinct, short)]
    return tuple(x[keep] for x in found), ranges.of(short[keep])


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7 >> 3) if x else n


def block_runs(block: Block, found: tuple, part: np.ndarray) -> tuple[dict[int, list[bytes]], dict[bytes, int], list[bytes]]:
    """Sorted distinct strings for each range, the least doc_id of each, and
    the string of each run of windows."""
    raw, least, keys = block.buf.tobytes(), {}, []
    for s, e, a, d in zip(found[0].tolist(), (found[1] + SPAN).tolist(), found[2].tolist(), block.first_id[found[4]].tolist(), strict=True):
        key = raw[a:e] + b"\xff" + raw[s:a]
        keys.append(key)
        if least.setdefault(key, d) > d:
            least[key] = d
    by: dict[int, set[bytes]] = {}
    for key, p in zip(keys, part.tolist(), strict=True):
        by.setdefault(p, set()).add(key)
    return {p: sorted(own) for p, own in by.items()}, least, keys


def front_code(strings: list[bytes], ids: list[int]) -> bytes:
    """A sorted run: prefix lengths shared with the string before, lengths of
    the rests, doc_ids and the rests themselves."""
    width = max(map(len, strings))
    # a byte that no string holds fills up, so that it differs from any other
    even = np.frombuffer(b"".join([x.ljust(width, b"\xfe") for x in strings]), np.uint8).reshape(-1, width)
    shared = [0, *(even[1:] != even[:-1]).argmax(axis=1).tolist()]
    rests = [x[k:] for x, k in zip(strings, shared, strict=True)]
    head = np.array([len(strings)], np.int64).tobytes() + np.array(ids, np.int64).tobytes()
    return _press(head + bytes(shared) + bytes(map(len, rests)) + b"".join(rests))


def front_decode(raw: bytes) -> tuple[list[int], list[bytes], np.ndarray]:
    """Shared lengths, strings and doc_ids of a run."""
    raw = _unpress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, at = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n
    shared, sizes = raw[at : at + n], raw[at + n : at + 2 * n]
    strings, at, last = [], at + 2 * n, b""
    for k, size in zip(shared, sizes, strict=True):
        last = last[:k] + raw[at : at + size]
        strings.append(last)
        at += size
    return list(shared), strings, ids


def loser_tree(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(shared, run, nth) of all strings of sorted runs in sorted order; shared:
    the length of the prefix in common with the string put out before."""
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    strings, shares = [r[1] for r in runs], [r[0] for r in runs]
    ends, at = [len(s) for s in strings], [0] * n
    # an entry is (run, shared); -1 is a run at its end, which loses to all
    heads: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (size - n)
    tree: list[tuple[int, int]] = [(-1, 0)] * size

    def play(node: int) -> tuple[int, int]:
        if node >= size:
            r = node - size
            return (r, 0) if r < n and heads[r] is not None else (-1, 0)
        a, b = play(2 * node), play(2 * node + 1)
        if b[0] < 0 or a[0] < 0:
            win, tree[node] = (a, b) if b[0] < 0 else (b, a)
            return win
        x, y = heads[a[0]], heads[b[0]]
        k = common(x, y, 0)
        if x[k : k + 1] <= y[k : k + 1]:
            tree[node] = (b[0], k)
            return a
        tree[node] = (a[0], k)
        return b

    run, share = play(1) if size > 1 else ((0, 0) if n and heads[0] is not None else (-1, 0))
    while run >= 0:
        nth = at[run]
        yield share, run, nth
        nth += 1
        at[run] = nth
        node = run + size >> 1
        if nth < ends[run]:
            heads[run] = mine = strings[run][nth]
            share = shares[run][nth]
        else:
            heads[run], run = None, -1
        while node:
            other, known = tree[node]
            if other >= 0:
                if run < 0 or known > share:
                    tree[node] = (run, share)
                    run, share = other, known
                    mine = heads[run]
                elif known == share:
                    theirs = heads[other]
                    k = common(mine, theirs, share)
                    if theirs[k : k + 1] < mine[k : k + 1]:  # all before k is equal
                        tree[node] = (run, k)
                        run, mine = other, theirs
                    else:
                        tree[node] = (other, k)
            node >>= 1


def group_masks(group: list[tuple[bytes, int, int, int]], masks: list[np.ndarray]) -> None:
    """Masks of a group's strings: (string, doc_id, run, nth), equal ones side
    by side.  Bit i: the string's i-th window is in a smaller doc_id."""
    least: dict[bytes, int] = {}
    for string, doc, _, _ in group:
        if least.get(string, NO_ID) >= doc:
            least[string] = doc
    if len(least) == 1:
        (string, low), = least.items()
        full = (1 << len(string) - SPAN) - 1
        for _, doc, run, nth in group:
            if low < doc:
                masks[run][nth] = full
        return
    windows: dict[bytes, int] = {}
    bodies = {}
    for string, low in least.items():
        right, left = string.split(b"\xff")
        body = left + right
        bodies[string] = own = [body[k : k + SPAN] for k in range(len(body) - SPAN + 1)]
        for w in own:
            if windows.get(w, NO_ID) >= low:
                windows[w] = low
    for string, doc, run, nth in group:
        mask = 0
        for k, w in enumerate(bodies[string]):
            if windows[w] < doc:
                mask |= 1 << k
        masks[run][nth] = mask


def merge_masks(blocks: DataFrame, answers: DataFrame, ranges: Ranges) -> DataFrame:
    """block, part, masks: of each block's run of a range, in its order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (own,) in _blocks_in(batches):
            found, part = _repeated(block, ranges, own or [])
            runs, least, _ = block_runs(block, found, part)
            if runs:
                coded = [front_code(x, [least[s] for s in x]) for x in runs.values()]
                yield pa.RecordBatch.from_arrays([pa.array([block.id] * len(runs), pa.int64()), pa.array(list(runs), pa.int32()), pa.array(coded, pa.binary())], names=["block", "part", "run"])

    def merge(table: pa.Table) -> pa.Table:
        runs = [front_decode(x) for x in table.column("run").to_pylist()]
        masks = [np.zeros(len(r[1]), np.uint32) for r in runs]
        group: list[tuple[bytes, int, int, int]] = []
        ids = [r[2].tolist() for r in runs]
        for share, run, nth in loser_tree([r[:2] for r in runs]):
            if share < GRAM and group:
                if len(group) > 1:
                    group_masks(group, masks)
                group = []
            group.append((runs[run][1][nth], ids[run][nth], run, nth))
        if len(group) > 1:
            group_masks(group, masks)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "masks": pa.array([_press(m.tobytes()) for m in masks], pa.binary())})

    runs = blocks.join(answers, "block", "left").select(*blocks.columns, "answers").mapInArrow(send, "block long, part int, run binary").repartition(ranges.parts, "part")
    return runs.groupBy("part").applyInArrow(merge, "block long, part int, masks binary")


def removed_bytes(block: Block, ranges: Ranges, answers: list[dict], masks: list[dict]) -> np.ndarray:
    """Which bytes of a block go, judged for each text's least doc_id."""
    gone = np.zeros(len(block.buf) + 1, np.int32)
    found, part = _repeated(block, ranges, answers)
    runs, least, keys = block_runs(block, found, part)
    mask: dict[bytes, int] = {}
    for m in masks:
        mask.update(zip(runs[m["part"]], np.frombuffer(_unpress(m["masks"]), np.uint32).tolist(), strict=True))
    own = block.first_id[found[4]].tolist()
    n = (found[1] - found[0] + 1).tolist()
    bits = np.array([mask[k] if d == least[k] else (1 << c) - 1 for k, d, c in zip(keys, own, n, strict=True)], np.int64)
    for k in range(SLIDE):
        at = found[0][(bits >> k & 1) == 1] + k
        np.add.at(gone, at, 1)
        np.add.at(gone, at + SPAN, -1)
    return np.cumsum(gone[:-1]) > 0


def results(block: Block, gone: np.ndarray) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed spans."""
    out, at = [], 0
    for begin, size, n in zip(block.begin.tolist(), block.sizes.tolist(), block.n_ids.tolist(), strict=True):
        ids, at = block.ids[at : at + n].tolist(), at + n
        raw, own = block.buf[begin : begin + size], gone[begin : begin + size]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        first = (size, int(own.sum()), len(edges) // 2, hashlib.sha256(raw[~own].tobytes() if len(edges) else raw.tobytes()).hexdigest(), edges.tolist())
        # a copy with a larger id has every window in the first one
        copy = (size, size, 1, hashlib.sha256(b"").hexdigest(), [0, size]) if size >= SPAN else first
        out += [(None if d == NO_ID else d, *(first if d == ids[0] else copy)) for d in ids]
    return out


def remove_repeats(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document;
    spans: also the removed half-open byte spans, as begin, end, begin, ..."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = make_blocks(docs, partitions)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = Ranges(max(1, -(-total // RANGE_BYTES)), total)
    listed = lambda df, *c: df.groupBy("block").agg(F.collect_list(F.struct(*c)).alias("list"))
    answers = staged(listed(repeated_anchors(blocks, ranges), "part", "bits").withColumnRenamed("list", "answers"), "answers")
    masks = staged(listed(merge_masks(blocks, answers, ranges), "part", "masks").withColumnRenamed("list", "masks"), "masks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (own, mask) in _blocks_in(batches):
            rows = results(block, removed_bytes(block, ranges, own or [], mask or []))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols[: 5 + spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"][: 5 + spans])

    both = answers.join(masks, "block", "left")
    joined = blocks.join(both, "block", "left").select(*blocks.columns, "answers", "masks")
    return joined.mapInArrow(finish, RESULT + ", spans array<long>" * spans)
