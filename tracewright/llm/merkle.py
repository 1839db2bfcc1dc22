"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut into sections (blank lines end them, and so does a paragraph
whose digest falls into one of 16 slots, so that cuts depend on content
alone), sections into paragraphs (lines), paragraphs into leaves (20 to 120
characters, cut by content again). A node's digest is that of its children's. The
fingerprint writes the tree down: the root, then sections, their paragraphs and
the leaves of those, each as digest and length. Equal roots say equal texts; where
roots differ, digests are compared level by level, down only into branches that
differ.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import spread
from tracewright.llm.kernels import NULL_ID

#: Characters of the digest of a leaf, paragraph or section; roots have 32.
LEAF = 12
_LEAF = re.compile(r".{19,119}?[.!?,;:dnst]\s+|.{120}|.+")
#: Lengths as they are written.
_HEX = [f"{n:x}" for n in range(512)]


def _digest(data: bytes, size: int = 16) -> str:
    return blake2b(data, digest_size=size).hexdigest()


def leaves(paragraph: str) -> list[str]:
    """Pieces of a line that end after a sentence, or after a word as its last letter says; joined they give the line."""
    return _LEAF.findall(paragraph)


#: A line: its node, the node as it is written, its characters, its leaves, whether its section ends with it.
Line = tuple[str, str, int, list[str], bool]


def _line(line: str) -> Line:
    pieces = leaves(line)
    try:
        data = list(map(str.encode, pieces))
    except UnicodeEncodeError:  # surrogates
        data = [x.encode("utf-8", "surrogatepass") for x in pieces]
    own = [blake2b(x, digest_size=LEAF // 2).hexdigest() + (_HEX[n] if n < 512 else f"{n:x}") for x, n in zip(data, map(len, pieces), strict=True)]
    if len(own) == 1:
        return own[0], own[0], len(line), own, own[0][LEAF - 1] == "0" or not line.strip()
    node = f"{_digest(','.join(own).encode(), LEAF // 2)}{len(line):x}"
    return node, f"{node}={','.join(own)}" if own else node, len(line), own, not own or own[-1][LEAF - 1] == "0" or not line.strip()


class Tree:
    """A text's sections, each a list of lines, with their nodes and characters; lines come from `known` where it has them, which stays under KNOWN."""

    def __init__(self, text: str, known: dict[str, Line]):
        self.sections: list[list[Line]] = [[]]
        if len(known) > KNOWN:
            known.clear()
        for line in text.split("\n"):
            own = known.get(line)
            if own is None:
                own = _line(line)
                if len(known) <= KNOWN:
                    known[line] = own
            self.sections[-1].append(own)
            if own[4]:
                self.sections.append([])
        self.nodes, self.sizes = [], []
        for s in self.sections:
            n = sum([x[2] for x in s])
            self.sizes.append(n)
            self.nodes.append(s[0][0] if len(s) == 1 else f"{_digest(','.join([x[0] for x in s]).encode(), LEAF // 2)}{n:x}")
        # the nodes' digests are short; the root also takes the text's own, so that equal roots mean equal texts
        self.root = _digest(("|".join(self.nodes) + _digest(text.encode("utf-8", "surrogatepass"))).encode())

    def written(self) -> str:
        return f"{self.root}/{'|'.join([f'{n}:{";".join([x[1] for x in s])}' for n, s in zip(self.nodes, self.sections, strict=True)])}"

    def like(self, other: Tree) -> float:
        """likeness() of what the two trees are written as."""
        if self.root == other.root:
            return 1.0
        total = 2 + sum(self.sizes) + sum(other.sizes)
        shared, one, two = _apart(self.nodes, other.nodes, self.sections, other.sections)
        one, two = [x for s in one for x in s], [x for s in two for x in s]
        more, one, two = _apart([x[0] for x in one], [x[0] for x in two], one, two)
        one, two = [x for line in one for x in line[3]], [x for line in two for x in line[3]]
        return 2.0 * (shared + more + _common(one, two)[0]) / total


#: Lines that are kept to be looked up at most.
KNOWN = 20_000


def _common(one: list[str], two: list[str]) -> tuple[int, dict[str, int]]:
    """The characters of nodes that both sides have, and how often both have them."""
    names = set(one)
    if names.isdisjoint(two):
        return 0, {}
    names.intersection_update(two)
    both = Counter([x for x in one if x in names]) & Counter([x for x in two if x in names])
    return sum([_weight(node) * n for node, n in both.items()]), both


def _apart(one: list[str], two: list[str], left: list, right: list) -> tuple[int, list, list]:
    """The characters of nodes that both sides have, and left and right without their places."""
    n, both = _common(one, two)
    return (n, _rest(left, one, both), _rest(right, two, both)) if both else (n, left, right)


def fingerprint(text: str) -> str:
    """root / sections parted by '|': a node, ':' and its paragraphs parted by ';': a node, and where it has more leaves than one '=' and they, parted by ','.

    A node or leaf is LEAF characters of digest and its length in characters (hexadecimal, line feeds apart).
    """
    return Tree(text, {}).written()


def _weight(node: str) -> int:
    return int(node[LEAF:], 16)


def _children(nodes: list[str], mark: str, inner: str) -> list[str]:
    """The written children, parted by inner, of written nodes."""
    return [x for n in nodes for x in n.partition(mark)[2].split(inner) if x]


def likeness(one: str, two: str) -> float:
    """Twice the characters in branches that both trees have, over all characters and one more of each text.

    1 for equal roots, and for those alone; 0 for texts without a common leaf.
    """
    (root, _, left), (other, _, right) = one.partition("/"), two.partition("/")
    if root == other:
        return 1.0
    left, right = left.split("|"), right.split("|")
    shared, total = 0, 2
    for level, mark in enumerate((":", "=", "")):
        names = [[x.partition(mark)[0] if mark else x for x in side] for side in (left, right)]
        if not level:
            total += sum(map(_weight, names[0])) + sum(map(_weight, names[1]))
        counts = [Counter(n) for n in names]
        both = counts[0] & counts[1]
        shared += sum(_weight(node) * n for node, n in both.items())
        if mark:  # down into what differs
            left, right = (_children(_rest(side, n, both), mark, ";") if not level else _leaves(_rest(side, n, both)) for side, n in zip((left, right), names, strict=True))
    return 2.0 * shared / total


def _rest(written: list[str], names: list[str], both: Counter) -> list[str]:
    """The nodes without those that both trees have."""
    left, out = Counter(both), []
    for x, name in zip(written, names, strict=True):
        if left[name]:
            left[name] -= 1
        else:
            out.append(x)
    return out


def _leaves(paragraphs: list[str]) -> list[str]:
    return [x for p in paragraphs for x in (p.partition("=")[2] or p).split(",") if _weight(x)]


def differing(one: str, two: str) -> list[tuple[int, int]]:
    """Character ranges of the first text in leaves that the second one's tree lacks: where edits are."""
    lines = [_children(f.partition("/")[2].split("|"), ":", ";") for f in (one, two)]
    have = Counter(_leaves(lines[1]))
    out, at = [], 0
    for k, line in enumerate(lines[0]):
        at += k > 0  # the line feed
        for leaf in _leaves([line]):
            n = _weight(leaf)
            if have[leaf]:
                have[leaf] -= 1
            else:
                out.append((at, at + n))
            at += n
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(group: pa.Table) -> pa.Table:
    tails, ids, texts = (group.column(c).to_pylist() for c in ("tail", "doc_id", "text"))
    order = sorted(range(len(ids)), key=lambda i: (tails[i], ids[i], texts[i]))
    out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    ahead, known = None, {}  # the edited text has most of its lines from the two documents
    for i, j in zip(order, [*order[1:], None], strict=True):
        if tails[i]:
            break
        text, after = texts[i], texts[j]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = ahead if ahead is not None else Tree(text, known)
        ahead = Tree(after, known)
        new = Tree(edited, known)
        row = (ids[i], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.written(), new.written(), own.like(new), own.like(ahead))
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def _place(edges: np.ndarray, heads: dict[int, int]):
    """Each row to its range of doc_ids; the first document of a range also to the range before, as its tail."""
    def place(batches):
        first = np.array(sorted(heads), np.int64)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            own = np.searchsorted(edges, ids, side="right")
            at = np.flatnonzero(np.isin(ids, first))
            rows = np.concatenate([np.arange(len(ids)), at]).astype(np.int64)
            to = np.concatenate([own, [heads[i] for i in ids[at].tolist()]]).astype(np.int32)
            tail = np.arange(len(rows)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(tail), b.column("doc_id").take(pa.array(rows)), b.column("text").take(pa.array(rows))], names=["part", "tail", "doc_id", "text"])

    return place


def document_fingerprints(docs: DataFrame, each: int = 8 << 20) -> DataFrame:
    """Merkle fingerprints of every whole text, and of the text edited with the next document: one row a row of docs.

    doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (likeness() of fingerprints).
    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document in ascending
    doc_id; the last document is followed by the first one, a single one by
    itself. A null text is empty. A null doc_id sorts last and stays null; rows
    with one doc_id are ordered by text. Other columns are ignored; an empty
    table gives no rows. Ranges of doc_ids hold about `each` bytes.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = spread.chunk_count(rows, each)
    cuts = rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    edges = np.unique(np.array(cuts, np.float64).astype(np.int64))
    kind = "part int, tail boolean, doc_id long, text string"
    heads = {r["part"]: r["head"] for r in rows.select("doc_id").withColumn("text", F.lit("")).mapInArrow(_place(edges, {}), kind).groupBy("part").agg(F.min("doc_id").alias("head")).collect()}  # a row a range
    order = sorted(heads)
    before = {heads[p]: order[k - 1] for k, p in enumerate(order)}  # the first one's head follows the last range
    placed = rows.mapInArrow(_place(edges, before), kind)
    return placed.groupBy("part").applyInArrow(_compare, RESULT).withColumn("doc_id", spread.given(F.col("doc_id")))
