"""Token ids in fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary (16 for 49,408 ids).
A file is a Parquet dataset with a row for each block of at most ``BLOCK`` ids:

    shard int, block int, first long, n int, bits int, payload binary,
    doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>,
    least_doc long, most_doc long

``payload`` holds ids first .. first+n-1 of the shard, id j in bits j*bits to
(j+1)*bits, least significant bit first; the documents listed are those that
begin in the block, with their first id in the shard and their length, and the
least and most of their doc_ids.  Id k of a shard stands in block k // BLOCK, and a
payload unpacks with a few numpy operations (``unpack``).  ``read_ids`` and
``read_document`` read any stretch of ids or any document alone: Parquet's own
statistics of shard, block and doc_ids leave out all other blocks.

Documents stand in ascending doc_id order over shards and within them: shard
bounds are quantiles of doc_id, so that the shards' ranges follow each other.

Pieces are encoded once each: where the tokenizer's own settings say that it cuts
at white space (``cuts_at_spaces``), a text's ids are its pieces' ids in sequence,
and a bounded memory of pieces spares most calls; it never changes a result.  Any
other tokenizer is given whole texts.

Nulls and odd input.  A null text is an empty one: only the end id.  Null
doc_ids stand first.  Equal doc_ids are ordered by a checksum of their ids and
length, and are dealt over several shards by it where they are many; repeated rows each keep their own.  Extra columns are ignored.  No rows, no blocks.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import slices, staged, utf8, worker_memory

BLOCK = 1 << 15
#: Pieces of text whose ids a worker remembers (about 80 MB).
PIECES = 400_000
END = 1
ENCODED = "doc_id long, checksum long, n long, bits int, ids binary, shard int"
_LEAST = -(1 << 63)
BLOCKS = "shard int, block int, first long, n int, bits int, payload binary, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>, least_doc long, most_doc long"
#: UTF-8 bytes of text that a shard holds, about, where their number isn't given.
SHARD_BYTES = 256 << 20


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a stream of ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids of a payload as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def coder_for(path: str, most: int) -> PieceEncoder:
    """A worker's encoder of this path, kept between tasks."""
    coders = worker_memory("tokens")
    if (path, most) not in coders:
        coders[path, most] = PieceEncoder(path, most)
    return coders[path, most]


#: The normalizer and pre-tokenizer whose pieces may be encoded
#: one by one.  A tokenizer with others gets whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its pieces in sequence:
    it normalizes and splits as above, and no added token reaches over a space,
    or stands in a text without ``<|``."""
    model, added = settings.get("model", {}), settings.get("added_tokens") or []
    return (
        settings.get("normalizer") == NORMALIZER
        and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        and settings.get("truncation") is None
        and settings.get("padding") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or "<|" not in t["content"] or t["content"].split() != [t["content"]] for t in added)
    )


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each byte 0 space, 1 ASCII letter or digit, 2 a sign that joins neither
    (no quote, which begins contractions, nor part of ``<|``), 3 anything else;
    and for each pair of kinds (4 * left + right) whether pieces end between."""
    kind = np.full(256, 3, np.uint8)
    for k, own in enumerate((b" \t\n\v\f\r", string.ascii_letters.encode() + string.digits.encode(), b".,!?;:#$%&*()[]{}@=+/-_")):
        kind[list(own)] = k
    left, right = np.divmod(np.arange(16), 4)
    return kind, ((left == 0) != (right == 0)) | (left + right == 3) & (left * right == 2)


_KINDS, _CUTS = _kinds()


class PieceEncoder:
    """Ids of whole texts through a memory of pieces without white space.

    Pieces end at white space and between an ASCII letter or digit and a sign,
    where the tokenizer cuts as well.  The pieces of a slice are numbered by Arrow,
    so that Python sees each distinct one once and numpy lays out the ids of all."""

    def __init__(self, path: str, most: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.by_piece = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.symbols = _Symbols()
        self.vocab = self.tokenizer.get_vocab_size()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has.  A
        null text has none."""
        if not self.by_piece:
            got = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            n = np.array([len(e.ids) for e in got], np.int64)
            return np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32, n.sum()), n
        data, begin = utf8(texts)
        # letters A-Z fold, as the tokenizer does, unless a special token may stand in the text
        low = data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
        marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for k in np.unique(np.searchsorted(begin, marked, "right") - 1):
            low[begin[k] : begin[k + 1]] = data[begin[k] : begin[k + 1]]
        cut, kind = np.zeros(len(low) + 1, bool), _KINDS[low]
        cut[1:-1] = _CUTS[kind[:-1] * 4 + kind[1:]]
        cut[begin] = True
        width = np.int64 if len(low) >= 1 << 30 else np.int32  # four bytes do for all but a huge text
        ends = np.flatnonzero(cut).astype(width)
        at = np.searchsorted(ends, begin)
        kind, make = (pa.binary(), pa.BinaryArray) if width is np.int32 else (pa.large_binary(), pa.LargeBinaryArray)
        numbered = make.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low)]).dictionary_encode()
        del cut, ends, low
        sizes, store = self._ids(numbered.dictionary.to_pylist())
        sizes, which = sizes.astype(width), numbered.indices.to_numpy()
        n = sizes[which]
        upto = np.zeros(len(n) + 1, width)
        np.cumsum(n, out=upto[1:])
        where = np.repeat((np.cumsum(sizes, dtype=width) - sizes)[which] - upto[:-1], n)
        where += np.arange(len(where), dtype=width)
        return store[where], np.diff(upto[at].astype(np.int64))

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct piece has, and all of them in sequence."""
        known = self.known
        got = [known.get(p) for p in pieces]
        new = [k for k, g in enumerate(got) if g is None]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
            self._learn([pieces[k] for k in new])
            for k in new:
                got[k] = known[pieces[k]]
        return np.fromiter(map(len, got), np.int64, len(got)) // 4, np.frombuffer(b"".join(got), np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new pieces, of which white space has none."""
        known, tokenize, rest = self.known, self.tokenizer.model.tokenize, []
        for p in new:
            if p.isalpha() and p.islower():  # bytes: a-z only, one word whatever the normalizer does
                known[p] = array("I", [t.id for t in tokenize(p.decode())]).tobytes()
            elif p.isspace():
                known[p] = b""
            elif not self._plain(p):
                rest.append(p)
        # one call on this thread, since workers already fill the cores
        got = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
        known.update(zip(rest, [array("I", e.ids).tobytes() for e in got], strict=True))

    def _plain(self, piece: bytes) -> bool:
        """Learns a piece of small Latin letters in normal form, which the
        normalizer leaves as it is, from the model alone."""
        s = piece.decode()
        if not (s.isalpha() and s.islower() and max(s) < "\u0250" and s == s.lower() and is_normalized("NFC", s)):
            return False
        self.known[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(s.translate(self.symbols))]).tobytes()
        return True


class _Symbols(dict):
    """The byte-level symbols of a letter, asked of the library once each."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[code] = out = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        return out


def encode_documents(docs: DataFrame, tokenizer_path: str, end: int = END, pieces: int = PIECES, bounds: list[int] | None = None) -> DataFrame:
    """doc_id, checksum, n, bits, ids: each whole text's ids, packed, and the
    shard by ``bounds``.  No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(tokenizer_path, pieces)
        bits = bits_for(max(coder.vocab, end + 1))
        for batch in slices(batches, most=4 << 20):
            ids, n = coder.encode(batch.column(1))
            stop = np.cumsum(n + 1)
            whole = np.full(int(stop[-1]), end, "<u4")
            inside = np.ones(len(whole), bool)
            inside[stop - 1] = False
            whole[inside] = ids
            begin = stop - n - 1
            sums = np.array([zlib.crc32(whole[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
            if bits == 16:
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 2 * stop])), pa.py_buffer(whole.astype("<u2"))]).cast(pa.binary())
            else:
                packed = pa.array([pack(whole[a:b], bits) for a, b in zip(begin, stop, strict=True)], pa.binary())
            doc = batch.column(0).cast(pa.int64())
            cols = [doc, pa.array(sums), pa.array(n + 1), pa.array(np.full(len(n), bits, np.int32)), packed, pa.array(shard_of(doc, sums, bounds or []))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "checksum", "n", "bits", "ids", "shard"])

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def shard_of(doc: pa.Array, checksum: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Shard of each row: how many bounds are below its doc_id, null being the
    least.  A doc_id that is several bounds at once holds several shards' rows:
    they are dealt over that many by checksum, which follows it in the order."""
    at, null = np.array(bounds, np.int64), np.asarray(doc.is_null())
    own = pc.fill_null(doc, _LEAST).to_numpy(zero_copy_only=False).astype(np.int64)
    low, high = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
    share = (high - low) * checksum >> 32
    # a document that really has the least id stands behind all nulls
    share = np.where((own == _LEAST) & ~null, np.maximum(high - low - 1, 0), share)
    return (low + share).astype(np.int32)


def _ends(docs: list[int | None]) -> tuple[int | None, int | None]:
    """The least and most of doc_ids, null as the least of all."""
    known = [_LEAST if d is None else d for d in docs]
    return (min(known), max(known)) if known else (None, None)


def _blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows in (shard, doc_id) order to blocks; holds one block and one text."""
    rows, state = [], {"shard": None}

    def flush(final: bool) -> None:
        while state["held"] >= block or (final and state["held"]):
            ids = np.concatenate(state["ids"])
            n = min(block, len(ids))
            begun = [d for d in state["docs"] if d[1] < state["first"] + n]
            state["docs"] = state["docs"][len(begun) :]
            rows.append((state["shard"], state["block"], state["first"], n, state["bits"], pack(ids[:n], state["bits"]), *([d[k] for d in begun] for k in range(3)), *_ends([d[0] for d in begun])))
            state["ids"], state["held"] = [ids[n:]], len(ids) - n
            state["block"], state["first"] = state["block"] + 1, state["first"] + n

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        for shard, doc, n, bits, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if shard != state["shard"]:
                if state["shard"] is not None:
                    flush(True)
                state = {"shard": shard, "block": 0, "first": 0, "held": 0, "ids": [], "docs": [], "bits": bits}
            state["docs"].append((doc, state["first"] + state["held"], n))
            state["ids"].append(unpack(ids, n, bits))
            state["held"] += n
            if state["held"] >= block:
                flush(False)
            if len(rows) >= 64:
                yield out()
    if state["shard"] is not None:
        flush(True)
    if rows:
        yield out()


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Upper doc_id bounds of all shards but the last, in ascending order; a
    doc_id of many rows is several of them.  Null counts as the least id."""
    at = [(k + 1) / shards for k in range(shards - 1)]
    if not at:
        return []
    return list(docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), at, 100 * shards)).first()[0] or [])


def write_tokens(docs: DataFrame, tokenizer_path: str, shards: int | None = None, end: int = END, pieces: int = PIECES, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Encodes, orders and writes the documents; returns the written blocks.

    shards: by default one for each ``SHARD_BYTES`` of text, and as many as the
    session's shuffle partitions at least.  pieces: how many a worker remembers;
    fewer take less memory and more time.  path: where the files are to stay;
    without one they go with the driver.  block: ids of a block, BLOCK at most.  Only packed ids are shuffled, once, to
    the shard of their doc_id."""
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    bounds = shard_bounds(docs, shards)
    encoded = encode_documents(docs, tokenizer_path, end, pieces, bounds)
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "checksum", "n")
    blocks = placed.select("shard", "doc_id", "n", "bits", "ids").mapInArrow(lambda batches: _blocks(batches, min(block, BLOCK)), BLOCKS)
    if path is None:
        return staged(blocks, "tokens")
    blocks.write.parquet(path)
    return open_tokens(spark, path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of files written before."""
    return spark.read.schema(BLOCKS).parquet(path)


def shard_sizes(blocks: DataFrame) -> list[tuple[int, int, int]]:
    """shard, ids before it, ids in it; a row for each shard."""
    rows = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    first = np.cumsum([0, *(n for _, n in rows)])
    return [(shard, int(at), n) for (shard, n), at in zip(rows, first[:-1], strict=True)]


def _stretch(blocks: DataFrame, shard: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo .. hi-1 of one shard, from their blocks alone (of up to BLOCK ids)."""
    own = blocks.where((F.col("shard") == shard) & (F.col("first") > lo - BLOCK) & (F.col("first") < hi)).select("block", "first", "n", "bits", "payload")
    rows = sorted(own.collect())  # what was asked for
    if not rows:
        return np.zeros(0, np.uint32)
    ids = np.concatenate([unpack(r.payload, r.n, r.bits) for r in rows])
    return ids[lo - rows[0]["first"] : hi - rows[0]["first"]]


def read_ids(blocks: DataFrame, start: int, n: int) -> np.ndarray:
    """Ids start .. start+n-1 of all files in sequence; fewer where they end."""
    if start < 0 or n < 0:
        raise ValueError("start and n are 0 or more")
    parts = [np.zeros(0, np.uint32)]
    for shard, at, size in shard_sizes(blocks):
        lo, hi = max(start, at), min(start + n, at + size)
        if lo < hi:
            parts.append(_stretch(blocks, shard, lo - at, hi - at))
    return np.concatenate(parts)


def read_document(blocks: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document of that doc_id, in the order of the files."""
    key = _LEAST if doc_id is None else doc_id
    own = blocks.where((F.col("least_doc") <= key) & (F.col("most_doc") >= key))
    each = own.select("shard", F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_lengths")).alias("d")).where(F.col("d.doc_ids").eqNullSafe(F.lit(doc_id).cast("long")))
    found = sorted((r.shard, r.d.doc_starts, r.d.doc_lengths) for r in each.collect())
    return [_stretch(blocks, shard, at, at + n) for shard, at, n in found]


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from written blocks.

    A document's ids may run over several blocks: each block gives the crc32
    of its part, and parts are joined in order by crc32 combination."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, block, first, n, bits, payload, docs, starts, lens in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                ids = unpack(payload, n, bits)
                lead = (starts[0] if starts else first + n) - first
                if lead:  # the end of a document that began before
                    rows.append((shard, block, first, None, None, lead, zlib.crc32(ids[:lead].astype("<u4"))))
                for doc, start, length in zip(docs, starts, lens, strict=True):
                    own = ids[start - first : start - first + length]
                    rows.append((shard, block, start, doc, length, len(own), zlib.crc32(own.astype("<u4"))))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "block", "at", "doc_id", "length", "n", "crc"])

    pieces = staged(blocks.mapInArrow(parts, "shard int, block int, at long, doc_id long, length long, n long, crc long"), "pieces")
    whole = F.col("length") == F.col("n")
    done = pieces.where(whole).select("shard", "at", "doc_id", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # Only documents that cross a block: their first piece starts a group.
    cross = pieces.where(F.col("length").isNull() | ~whole)
    run = Window.partitionBy("shard").orderBy("at")
    grouped = cross.withColumn("g", F.max(F.when(F.col("length").isNotNull(), F.col("at"))).over(run)).groupBy("shard", "g").agg(
        F.max("length").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("p")
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for p in batch.column(4).to_pylist():
                crc = p[0]["crc"]
                for x in p[1:]:
                    crc = crc32_combine(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crcs, pa.int64())], names=["shard", "at", "doc_id", "n_tokens", "ids_crc32"])

    crossed = grouped.select("shard", F.col("g").alias("at"), "doc_id", "n_tokens", "p").mapInArrow(combine, "shard int, at long, doc_id long, n_tokens long, ids_crc32 long")
    # One row for each shard, however many documents.
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = done.unionByName(crossed).join(F.broadcast(base), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def crc32_combine(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings' concatenation from theirs; n: bytes of the second.

    Appending n zero bytes multiplies a checksum by x^(8n) modulo the CRC's
    polynomial; powers come by squaring."""
    def times(p: int, q: int) -> int:  # product of reflected polynomials
        out = 0
        for k in range(31, -1, -1):
            if q >> k & 1:
                out ^= p
            p = p >> 1 ^ (0xEDB88320 if p & 1 else 0)
        return out

    power, base = 1 << 31, 1 << 23  # x^0 and x^8
    while n:
        if n & 1:
            power = times(power, base)
        base, n = times(base, base), n >> 1
    return times(a, power) ^ b
