"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: best-two-fit. A bin opens with the longest piece left and is filled
greedily with the longest piece that fits; then its smallest piece is replaced
by two unpacked pieces that fit the gap so opened more tightly. The plan works
on the histogram of piece lengths, at most one count per length up to the
capacity, so it is as large for a billion pieces as for a thousand: a pattern
of lengths is used as often as the counts allow before the next one is sought.
Pieces then get their places by their rank among those of their length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import spread
from tracewright.llm.kernels import NULL_ID

CAPACITY = 4096
#: Words a worker remembers with their ids, from one task to the next; further ones are encoded each time.
REMEMBERED = 600_000
#: Words of a text that are looked up at once.
PART = 50_000


#: Words of Latin-1 letters with ASCII marks (no apostrophe) behind them: two pre-tokens, which need no normaliser.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ["the", "The,", "straße", "ÉTÉ!!", "naïve...", "x", "word|", "Ab***", "über-", "!"]


@functools.cache
def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others in order for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts, word by word with a bounded memory.

    The tokenizer lower-cases, drops white space and never merges across it,
    so a text's ids are its words' ids in order. A new word that is plain goes
    to the library's merging model at once, others through all of the library;
    probes at the start say whether both give the same for this tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.slot: dict[str, int] = {}
        self.flat, self.at = np.zeros(1 << 20, np.uint32), np.zeros(REMEMBERED + PART + 2, np.int64)
        self.merge, self.marks, self.plain = self.library.model.tokenize, {}, True
        whole = [e.ids for e in self.library.encode_batch(_PROBES, add_special_tokens=False)]
        self.plain = all(p is None or p == w for p, w in zip(map(self._plain, _PROBES), whole, strict=True))

    def _plain(self, word: str) -> list[int] | None:
        """The ids of a plain word, None for any other."""
        m = _PLAIN.fullmatch(word) if self.plain else None
        if m is None:
            return None
        letters, marks = m.groups()
        ids = [t.id for t in self.merge(letters.lower().encode().decode("latin-1").translate(_byte_letters()))]
        if marks:
            if marks not in self.marks and len(self.marks) < PART:
                self.marks[marks] = [t.id for t in self.merge(marks)]
            ids += self.marks[marks] if marks in self.marks else [t.id for t in self.merge(marks)]
        return ids

    def _learn(self, words: list[str], base: int) -> dict[str, int]:
        """Ids of new words from slot base on; their slots."""
        slots = {}
        known = [self._plain(w) for w in words]
        rest = iter(self.library.encode_batch([w for w, k in zip(words, known, strict=True) if k is None], add_special_tokens=False))
        for w, ids in zip(words, known, strict=True):
            i = base + len(slots)
            ids = next(rest).ids if ids is None else ids
            top = int(self.at[i])
            if top + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat) // 2), np.uint32)])
            self.flat[top : top + len(ids)] = ids
            self.at[i + 1] = top + len(ids)
            slots[w] = i
        return slots

    def __call__(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        parts = [self._ids(words[k : k + PART]) for k in range(0, len(words), PART)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _ids(self, words: list[str]) -> np.ndarray:
        places = list(map(self.slot.get, words))
        if None in places:
            slots = self._learn(list({w for w, p in zip(words, places, strict=True) if p is None}), len(self.slot))
            if len(self.slot) + len(slots) <= REMEMBERED:
                self.slot.update(slots)
            places = [slots[w] if p is None else p for w, p in zip(words, places, strict=True)]
        p = np.array(places, np.int64)
        start, size = self.at[p], self.at[p + 1] - self.at[p]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordIds:
    """This process's encoder: its memory outlives a task."""
    return WordIds(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end: int, ids: bool):
    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                tokens = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(tokens), capacity)):
                    own = tokens[at : at + capacity]
                    for name, v in zip(out, (doc, k, at, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32) if ids else None), strict=True):
                        out[name].append(v)
            kinds = dict(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), ids=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items() if ids or k != "ids"], names=[k for k in kinds if ids or k != "ids"])

    return cut


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in their order, times used) that pack counts[length] pieces of every length 1..capacity."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    out: list[tuple[list[int], int]] = []
    fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest length left, up to each one
    while fits[capacity]:
        used: dict[int, int] = {}
        pattern: list[int] = []

        def longest(most: int) -> int:
            n = int(fits[most]) if most > 0 else 0
            while n and left[n] <= used.get(n, 0):
                n = int(fits[n - 1])
            return n

        gap = capacity
        while n := longest(gap):
            pattern.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(pattern) > 1:
            small = pattern[-1]
            room = gap + small
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            free[small] += 1
            have = np.flatnonzero(free[: room + 1] > 0)
            have = have[have > 0]
            if len(have):
                top = np.maximum.accumulate(np.where(free[: room + 1] > 0, lengths[: room + 1], 0))
                pair = top[room - have]
                pair[(pair == have) & (free[have] < 2)] = 0
                two = np.where(pair > 0, have + pair, 0)
                best = int(np.argmax(two))
                if two[best] > small:
                    pattern[-1:] = sorted((int(have[best]), int(pair[best])), reverse=True)
        used = {}
        for n in pattern:
            used[n] = used.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in used.items())
        low = capacity + 1
        for n, k in used.items():
            left[n] -= k * times
            low = min(low, n) if not left[n] else low
        if low <= capacity:
            fits[low:] = np.maximum.accumulate(np.where(left[low:] > 0, lengths[low:], fits[low - 1]))
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and distinct length in it: length, first rank, copies of that length in one bin, times, first sequence, offset of the first copy."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            k = pattern.count(n)
            rows.append((n, taken.get(n, 0), k, times, sequence, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return rows


def _place(shared):
    """Adds sequence_id and offset to pieces that carry upto, their rank by length over the whole table. shared: places() as sorted rows, and how many pieces are shorter than each length."""
    def place(batches):
        table, before = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            n = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("upto").to_numpy(zero_copy_only=False) - 1 - before[n]
            r = table[np.searchsorted(key, n * (1 << 44) + rank, side="right") - 1]
            i = rank - r[:, 1]
            names = [x for x in b.schema.names if x not in ("upto", "one")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(r[:, 4] + i // r[:, 2]), pa.array(r[:, 5] + i % r[:, 2] * n)], names=[*names, "sequence_id", "offset"])

    return place


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) with their places in packed sequences.

    doc_id, piece (from 0), start (the document's ids before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), sequence_id, offset
    (gapless from 0); with ids also the piece's token ids. tokenizer: file of a
    word-level BPE for the tokenizers library; each document ends with id
    `end`. Only documents over the capacity are cut. A null text is empty (one
    piece holding the end id); null doc_ids stay null; repeated rows are packed
    each; other columns are ignored; an empty table gives no rows. A very long
    text is one task's: its ids, 4 bytes each, must fit there.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity, end, ids), PIECE + (", ids array<int>" if ids else "")).withColumn("one", F.lit(1).cast("long"))
    pieces = spread.cut(pieces)  # range partitioning samples its input first: without this the texts would be encoded twice
    ranked = spread.running(pieces, ["length", F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"], "one")
    counts = np.zeros(capacity + 1, np.int64)
    for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row a length
        counts[r["length"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # the plan has a few patterns a length at most, so its size has a bound that the table does not move
    table = np.array(sorted(places(plan(counts, capacity))), np.int64).reshape(-1, 6)
    out = ranked.mapInArrow(_place(spark.sparkContext.broadcast((table, before))), PIECE + (", ids array<int>" if ids else "") + ", sequence_id long, offset long")
    return out.withColumn("doc_id", spread.given(F.col("doc_id")))
