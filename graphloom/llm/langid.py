"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text recognises every
substring of it.  A text is parsed into phrases: each is the longest match that
the automaton allows from where the last phrase ended, then parsing begins
anew at the letter that broke it.  c phrases over n letters with m letters of
labelled text give the cross-entropy estimate c * log2(m) / n (Ziv and Merhav);
the language with the fewest normalised phrases, c * log2(m), wins.

Texts are folded to lower case; every letter of the labelled texts has a number,
whatever its script, all others are one symbol that no automaton matches; runs of
everything else are one space.  The automata's edges lie in one array, in which each
state has a place of its own and finds its edges at their symbols' distances (row
displacement; 8 bytes a slot, three slots an edge), so memory grows with the letters
learned from, not with the alphabet.  Parsing is a walk over that table, in step over many
texts and languages as arrays.  A long text is walked in stretches side by side,
and each stretch is then entered with the state in which the one before ended:
from the first place where both walks break a phrase they are the same, so the
count is that of one parse of the whole text.

The fit takes a bounded sample: of each language the labelled documents with the
smallest hashes of doc_id, whole, until ``LETTERS`` characters or ``PER_LANG``
documents are reached.  Of a document longer than ``LETTERS`` the sample has a
stretch of that length at a place drawn by hash.  More than ``LANGUAGES`` distinct
labels are refused, since each needs an automaton.

Nulls and odd input.  A text that is null or has no letter is ``und`` with
score 0.  Labels that are null take no part in the fit.  Ties go to the name
that sorts first.  Repeated rows each get a result; null doc_ids count as
empty text where rows are chosen.  Extra columns are ignored.  With no
labelled text every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import slices, worker_memory

PER_LANG = 400
LETTERS = 40_000
LANGUAGES = 1_000
#: Letters that one lane of the parse walks; lanes of one table lookup.
STRETCH, LANES = 2_048, 1 << 14
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"

def _letter_table() -> np.ndarray:
    """For every code point, whether it is a letter (made once in a worker)."""
    codes = worker_memory("langid")
    if "letters" not in codes:
        codes["letters"] = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8)
    return codes["letters"]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``seq``."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Edges:
    """Edges of all automata.  A state is the number of its place; its edge with
    symbol c, if it has one, is in slot place + c: the place, and where it leads."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int):
        rng, size = np.random.default_rng(12), 3 * len(state) + 2 * states + width
        owner, self.place = np.full(size + width, -1, np.int64), np.full(states, -1, np.int64)
        taken = np.zeros(size, bool)  # as a state's place
        order = np.argsort(state, kind="stable")
        symbol, to, degree = symbol[order], to[order], np.bincount(state, minlength=states)
        begin = np.cumsum(degree) - degree
        for d in np.unique(degree)[::-1].tolist():  # those with most edges while there is most room
            left = np.flatnonzero(degree == d)
            while len(left):
                at = rng.integers(0, size, len(left))
                at = np.where(taken[at], -1, at)
                slots = np.maximum(at, 0)[:, None] + symbol[begin[left][:, None] + np.arange(d)]
                fits = (at >= 0) & (owner[slots] < 0).all(axis=1)
                # several may want a slot or place: the last to be written has it
                wanted = np.full(size, -1, np.int64)
                wanted[at[fits]] = left[fits]
                fits &= wanted[np.maximum(at, 0)] == left
                owner[slots[fits]] = left[fits][:, None]
                lost = fits & (owner[slots] != left[:, None]).any(axis=1)
                mine = lost[:, None] & (owner[slots] == left[:, None])
                owner[slots[mine]] = -1
                fits &= ~lost
                self.place[left[fits]] = at[fits]
                taken[at[fits]] = True
                left = left[~fits]
        self.table = np.full(size + width, -1, np.int64)
        own = np.repeat(self.place, degree)
        self.table[own + symbol] = own << 32 | self.place[to]

    def one(self, state: int, symbol: int) -> int:
        """Where one edge leads, -1 where there is none."""
        e = int(self.table[state + symbol])
        return e & 0xFFFFFFFF if e >> 32 == state else -1


@dataclass
class Model:
    """Automata of all languages; roots: the state of each where phrases begin."""

    languages: list[str]
    alphabet: str
    letters: list[int]
    roots: np.ndarray
    edges: Edges | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    @property
    def width(self) -> int:
        """Symbols: 0 is space, the last one any unknown letter."""
        return len(self.alphabet) + 2

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols, each text's offsets, and letters in each."""
        if not hasattr(self, "_symbol"):
            self._symbol = np.where(_letter_table() == 1, len(self.alphabet) + 1, 0).astype(np.int32)
            self._symbol[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        low = [t.lower() if t else "" for t in texts]
        flat = self._symbol[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in low])
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
        keep[(ends[:-1])[ends[:-1] < len(flat)]] = True
        upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
        flat = flat[keep]
        at = upto[np.concatenate([[0], ends])]
        real = np.concatenate([[0], np.cumsum(flat != 0, dtype=np.int32)])
        return flat, at, real[at[1:]] - real[at[:-1]]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by language, and letters of each text."""
        flat, at, real = self.symbols(texts)
        n = np.diff(at)
        parts = np.maximum(1, -(-n // STRETCH))
        owner = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[owner] + nth * STRETCH
        size = np.minimum(at[owner + 1] - begin, STRETCH)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(n), len(self.languages)), np.int64)
        several = np.flatnonzero(parts > 1)
        place = np.empty_like(order)  # where each stretch stands in the order
        place[order] = np.arange(len(order))
        base = np.cumsum(parts) - parts
        group = max(1, LANES // max(1, len(order)))
        for lo in range(0, len(self.languages), group):
            langs = np.arange(lo, min(lo + group, len(self.languages)))
            broke, state, broken = self._walk(flat, begin[order], size[order], parts[owner[order]] > 1, langs)
            for k in range(len(langs)):
                out[:, langs[k]] = np.bincount(owner[order], broke[k], len(n)).astype(np.int64) + 1
                for t in several:
                    own = place[base[t] : base[t] + parts[t]]
                    out[t, langs[k]] = 1 + self._joined(flat, begin[order][own], size[order][own], broke[k][own], state[k][own], broken[k], int(langs[k]))
        return out, real

    def _walk(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, joined: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Breaks in each lane by language, the state after it, and for lanes
        that are to be ``joined`` where they broke.  Sizes descend."""
        table = self.edges.table
        active = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # lanes longer than each step
        which = np.flatnonzero(joined)
        marked = np.searchsorted(which, active)
        broken = np.zeros((len(langs), len(flat) if len(which) else 0), bool)
        state = np.repeat(self.roots[langs][:, None], len(begin), axis=1)
        count = np.zeros(state.shape, np.int32)
        first = self._first()[langs]
        for step, lanes in enumerate(active):
            sym, own = flat[begin[:lanes] + step], state[:, :lanes]
            edge = table[own + sym]
            broke = edge >> 32 != own
            count[:, :lanes] += broke
            state[:, :lanes] = np.where(broke, first[:, sym], edge & 0xFFFFFFFF)
            if marked[step]:
                own = which[: marked[step]]
                broken[:, begin[own] + step] = broke[:, own]
        return count, state, broken

    def _first(self) -> np.ndarray:
        """For each language the state after a phrase's first symbol."""
        if not hasattr(self, "_starts"):
            edge = self.edges.table[self.roots[:, None] + np.arange(self.width)]
            self._starts = np.where(edge >> 32 == self.roots[:, None], edge & 0xFFFFFFFF, self.roots[:, None])
        return self._starts

    def _joined(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, count: np.ndarray, end: np.ndarray, broken: np.ndarray, lang: int) -> int:
        """Breaks of one parse over a text's stretches, from their own walks."""
        edges, first = self.edges, self._first()[lang]
        total, state = int(count[0]), int(end[0])
        for at, n, after in zip(begin[1:].tolist(), size[1:].tolist(), end[1:].tolist(), strict=True):
            for pos in range(at, at + n):
                sym = int(flat[pos])
                to = edges.one(state, sym)
                if to < 0:
                    total, to = total + 1, int(first[sym])
                    if broken[pos]:  # from here on both walks are one
                        total, to = total + int(broken[pos + 1 : at + n].sum()), after
                        break
                state = to
            state = to
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.  The score compares cross-entropies
        in bits a letter over up to 64 letters as if they were likelihoods."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        count, real = self.phrases(texts)
        bits = count * np.log2(np.maximum(2, self.letters))
        best = bits.argmin(axis=1)
        over = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(1, real)[:, None] * np.minimum(real, 64)[:, None]
        score = np.where(real > 0, 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1), 0.0)
        return [self.languages[b] if r else UNKNOWN for b, r in zip(best, real, strict=True)], score


def build(samples: dict[str, list[str]]) -> Model:
    """Model from texts of each language."""
    letter, joined = _letter_table(), {}
    for lang in sorted(samples):
        words = [" ".join("".join(c if letter[ord(c)] else " " for c in text.lower()).split()) for text in dict.fromkeys(samples[lang])]
        whole = f" {' '.join(w for w in words if w)} "
        if whole.strip():
            joined[lang] = whole
    alphabet = "".join(sorted(set().union(*joined.values()) - {" "}))
    index, width = {c: k + 1 for k, c in enumerate(alphabet)} | {" ": 0}, len(alphabet) + 2
    parts, roots, states = [np.zeros((0, 3), np.int64)], [], 0
    for whole in joined.values():
        go = suffix_automaton([index[c] for c in whole])
        edges = [(s, c, t) for s, step in enumerate(go) for c, t in step.items()]
        parts.append(np.array(edges, np.int64).reshape(-1, 3) + [states, 0, states])
        roots.append(states)
        states += len(go)
    state, symbol, to = np.concatenate(parts).T
    edges = Edges(state, symbol, to, states, width)
    return Model(list(joined), alphabet, [len(x) for x in joined.values()], edges.place[np.array(roots, np.int64)], edges)


def fit(docs: DataFrame, learn: Column) -> Model:
    """Model from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct labels")
    if not sizes:
        return build({})
    # Three times the rows wanted of each language, by their hashes alone, come
    # to its window, however many it has; counts are a row for each language.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3.0 * PER_LANG / r["n"])) for r in sizes], "lang string, _share double")
    unit = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5
    few = rows.select("lang", "doc_id", F.least(F.length("text"), F.lit(LETTERS)).alias("_n"), F.xxhash64("doc_id").alias("_h"), unit.alias("_u"))
    few = few.join(F.broadcast(share), "lang").where("_u <= _share")
    by = Window.partitionBy("lang").orderBy("_h", "doc_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    chosen = few.withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0))).withColumn("_r", F.coalesce(F.count("*").over(by), F.lit(0)))
    ids = [r[0] for r in chosen.where((F.col("_before") < LETTERS) & (F.col("_r") < PER_LANG)).select("doc_id").distinct().collect()]
    known = [i for i in ids if i is not None]
    among = F.col("doc_id").isin(known)
    if len(known) < len(ids):
        among = among | F.col("doc_id").isNull()
    # of a text over LETTERS a stretch at a place drawn by hash; all others whole
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - LETTERS + 1, F.lit(1))).cast("int") + 1
    own = F.when(F.length("text") > LETTERS, F.substring(F.col("text"), place, F.lit(LETTERS))).otherwise(F.col("text"))
    texts = rows.where(among).select("lang", own.alias("t"), F.xxhash64("doc_id").alias("_h"), "doc_id").distinct()
    by = Window.partitionBy("lang").orderBy("_h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("_before", F.coalesce(F.sum(F.length("t")).over(by), F.lit(0))).withColumn("_r", F.coalesce(F.count("*").over(by), F.lit(0)))
    samples: dict[str, list[str]] = {}
    for r in texts.where((F.col("_before") < LETTERS) & (F.col("_r") < PER_LANG)).orderBy("lang", "_r").collect():
        samples.setdefault(r["lang"], []).append(r["t"])
    return build(samples)


def identify(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every document and its columns in ``extra``
    (not named as these three; text may be among them).  No shuffle."""
    held, extra = docs.sparkSession.sparkContext.broadcast(model), list(extra or [])
    rest = [c for c in extra if c != "text"]
    schema = PREDICTED + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            lang, score = held.value.predict(batch.column(1).to_pylist())
            cols = [batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(1 if c == "text" else 2 + rest.index(c)) for c in extra], names=["doc_id", "lang_pred", "score", *extra])

    return docs.select("doc_id", "text", *rest).mapInArrow(run, schema)
