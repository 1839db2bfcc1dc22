"""Token counts of whole texts by a two-tier, map-side lookup of pre-tokens.

The sentence-piece vocabulary never merges across the edge between a run of
spaces and what stands before it, nor across a line feed, so a text's tokens
are those of its pre-tokens. Tier one: a compact table of frequent pre-tokens
and their token counts, broadcast; its size is fixed (`frequent` entries).
Tier two: a bounded cache in each worker, filled by encoding misses. Counting
shuffles nothing. To find the frequent ones, every partition sums up its
pre-tokens in a list of bounded size, and only these lists are exchanged, merged
in groups until one remains: some 16,000 entries a partition, whatever it holds.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import spread

#: Entries of the broadcast table and of every summary on the way to it.
FREQUENT = 1 << 14
#: Pre-tokens a worker remembers.
REMEMBERED = 300_000
#: Summaries that the driver merges at once.
FAN_IN = 32
MARK = "▁"


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a text: words after single spaces as they stand, words after a line feed with it. None where the plain rule doesn't hold."""
    if "  " in text or MARK in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
        return None
    return text.replace("\n", " \n").split(" ") if text else []


class Lengths:
    """Token counts of pre-tokens and of texts, with a bounded cache over a table of frequent ones."""

    def __init__(self, path: str, table: dict[str, int]):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table, self.cache = table, {}
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and len(self.library.encode("\n")) == len(self.library.encode("\n\n")) - 1

    def _learn(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > REMEMBERED:
            self.cache.clear()
        for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True):
            self.cache[w] = len(ids) - (w[:1] == "\n")  # the mark that encode() puts first stands only before words after a space

    def count(self, text: str) -> int:
        words = pre_tokens(text) if self.splits else None
        if words is None or (words and words[0][:1] in ("\n", "")):
            return len(self.library.encode(text))
        if len(words) > REMEMBERED // 2:
            return sum(self._sum(words[k : k + REMEMBERED // 4]) for k in range(0, len(words), REMEMBERED // 4))
        return self._sum(words)

    def _sum(self, words: list[str]) -> int:
        found = list(map(self.table.get, words))
        if None not in found:
            return sum(found)
        rest = [w for w, n in zip(words, found, strict=True) if n is None]
        total = sum(n for n in found if n is not None)
        known = list(map(self.cache.get, rest))
        if None in known:
            self._learn(list(set(rest)) if len(self.cache) > REMEMBERED // 2 else list({w for w, n in zip(rest, known, strict=True) if n is None}))
            known = list(map(self.cache.get, rest))
            if None in known:  # the cache was cleared
                self._learn(list({w for w, n in zip(rest, known, strict=True) if n is None}))
                known = list(map(self.cache.__getitem__, rest))
        return total + sum(known)


@functools.lru_cache(maxsize=1)
def _worker(path: str) -> Lengths:
    """This process's second tier: its cache outlives a task."""
    return Lengths(path, {})


def _summary(counts: Counter, keep: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["words", "counts"])


def _summarise(keep: int):
    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(pre_tokens(text.as_py()) or ())
                if len(counts) > 8 * keep:  # lossy counting: rare ones go, their count is at most the least that stays
                    low = sorted(counts.values())[-2 * keep]
                    counts = Counter({w: n for w, n in counts.items() if n > low})
        yield _summary(counts, keep)

    return summarise


def _merge(keep: int):
    def merge(batches):
        counts: Counter = Counter()
        for batch in batches:
            for words, numbers in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for w, n in zip(words, numbers, strict=True):
                    counts[w] += n
                if len(counts) > 8 * keep:
                    counts = Counter(dict(counts.most_common(4 * keep)))
        yield _summary(counts, keep)

    return merge


def frequent_pre_tokens(docs: DataFrame, keep: int = FREQUENT) -> list[str]:
    """Up to keep frequent pre-tokens of all texts. Which ones are chosen only decides how fast counting is."""
    kind = "words array<string>, counts array<long>"
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_summarise(keep), kind)
    n = max(1, docs.rdd.getNumPartitions())
    while n > 1:
        n = math.ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(_merge(keep), kind)
    row = parts.first()
    return list(row["words"]) if row else []


def _count(path: str, limit: int, table):
    def count(batches):
        lengths = _worker(path)
        lengths.table = table.value
        for batch in batches:
            n = [lengths.count(t.as_py()) for t in batch.column("text")]
            size = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(np.array(n, np.int64) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); one row a row of docs.

    tokenizer: a sentencepiece model file. A null text counts as empty and has
    no tokens; null doc_ids stay null; repeated rows are counted each; other
    columns are ignored; an empty table gives no rows. A very long text is one
    task's, as a whole and as a list of its pre-tokens.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = frequent_pre_tokens(rows, frequent)
    lengths = Lengths(tokenizer, {})
    for at in range(0, len(words), 4096):
        lengths._learn(words[at : at + 4096])
    table = spark.sparkContext.broadcast({w: lengths.cache[w] for w in words} if lengths.splits else {})
    return rows.mapInArrow(_count(tokenizer, limit, table), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
