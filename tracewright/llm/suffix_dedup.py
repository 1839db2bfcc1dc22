"""Suffix-array dedup: removal of long repeats by a run-compressed Burrows-Wheeler index.

Which bytes go: every byte covered by a `length`-byte string that also starts in
a document with a smaller doc_id. How:

1. *Routing.* Each window of `length` bytes has an anchor, the smallest hash
   among its `ANCHOR`-byte substrings (a minimizer), so equal windows have
   equal anchors wherever they stand. Consecutive windows with one anchor
   position form a segment. Hash chunks of documents send their distinct
   anchors, sorted and packed, to anchor buckets; the reply says which ones two
   documents or more have. All segments on those travel further, each distinct
   one once a chunk, with its smallest doc_id, so thousands of copies cost one
   row a chunk.
2. *Index.* Every bucket sorts the windows of its segments (suffixes cut at
   `length` bytes, eight bytes at a time, ties only), and builds the
   Burrows-Wheeler transform over them: for each group of equal windows the
   symbols that stand before it. Its runs are kept only: a run is a stretch of
   groups with one symbol before them whose steps to the left (LF) go to
   consecutive groups too, with its head, its end and where the head leads.
   Copies of a text share all groups, and near copies most runs, so the index
   grows with what differs, not with the copies. Each group samples the smallest
   document that has it.
3. *Streaming.* Segments stream through the runs right to left: a step finds the
   run of the group it is in and the symbol before it, and the run's head says
   where that leads. The match stays `length` long at each step, and the group
   reached gives the smallest document that has it. These come back to the
   chunks, which mark the bytes.

There are as many buckets as chunks, so a bucket's share of segments is about a
chunk's. Hot passages are one segment a chunk, however many documents hold them.
An anchor on more than `hot` segments is hot: its segments are cut in two, the
windows with more bytes before the anchor and those with more behind it, and
each part is routed by the anchor with the bytes on that side, which all its
windows hold. A chunk sends a row to each bucket that it has something for: with more
executor memory, larger chunks make fewer and fuller rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import kernels as K
from tracewright.llm import spread

ANCHOR = 24
_POS = np.uint64((1 << 24) - 1)
U64 = np.uint64


def _anchors(part: np.ndarray, length: int) -> np.ndarray:
    """For each window start of a short buffer, the position of its anchor: the smallest hash, the leftmost of equals."""
    width = length - ANCHOR + 1
    eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
    m = len(part) - ANCHOR + 1
    h = eight[:m] * U64(0x9FB21C651E98DF25)
    h ^= h >> U64(35)
    h += eight[8 : m + 8]
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(31)
    h += eight[16 : m + 16]
    key = (K.mix(h) & ~_POS) | np.arange(m, dtype=U64)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if width > span:
        rest = width - span
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & _POS).astype(np.int64)


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of a chunk's documents: document index, first byte, end byte, 64-bit anchor hash, where the anchor stands.

    A segment cut by a block's edge is put together again: segments follow from their document's bytes alone, as
    answers go by their content, and rows of a chunk can come in another order each time it is read.
    """
    firsts, ends, anchors, places = [], [], [], []
    for at in range(0, len(raw) - length + 1, K.BLOCK):
        part = np.ascontiguousarray(raw[at : at + K.BLOCK + length - 1])
        pos = _anchors(part, length)
        valid = np.ones(len(pos), bool)
        for o in offsets[np.searchsorted(offsets, at + 1) : np.searchsorted(offsets, at + len(part))].tolist():
            valid[max(0, o - at - length + 1) : o - at] = False  # windows that would cross into the next document
        change = np.ones(len(pos) + 1, bool)
        change[1:-1] = (pos[1:] != pos[:-1]) | (valid[1:] != valid[:-1])
        first, last = np.flatnonzero(change[:-1] & valid), np.flatnonzero(change[1:] & valid)
        eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        p = pos[first]
        anchors.append(K.mix(K.mix(K.mix(eight[p]) + eight[p + 8]) * U64(5) + eight[p + 16]))
        firsts.append(first + at)
        ends.append(last + (at + length))
        places.append(p + at)
    if not firsts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), z
    a, b, h, p = (np.concatenate(x) for x in (firsts, ends, anchors, places))
    head = np.ones(len(a), bool)
    head[1:] = (p[1:] != p[:-1]) | (a[1:] != b[:-1] - length + 1)
    own = np.flatnonzero(head)
    a, b, h, p = a[own], b[np.append(own[1:], len(b)) - 1] if len(own) else b, h[own], p[own]
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(a, offsets))), a, b, h, p


def _read_chunk(table: pa.Table, length: int, keys: bool = True):
    """All segments of a chunk: doc_ids, raw bytes, offsets; per segment document, start, end, anchor, content hash (if keys are asked for), the anchor's place."""
    raw, offsets = K.texts(table.column("text"))
    raw = np.ascontiguousarray(raw)
    doc, a, b, h, p = _segments(raw, offsets, length)
    return K.ids(table.column("doc_id")), raw, offsets, doc, a, b, h, K.span_hashes(raw, a, b) if keys else None, p


def _halves(raw: np.ndarray, doc, a, b, p, length: int):
    """Segments cut in two: document, start, end, routing hash, content hash. The windows of a part all hold the bytes that it is routed by."""
    more = (length - ANCHOR) // 2
    out = []
    for left in (True, False):
        s, e = (a, np.minimum(b, p - more + length)) if left else (np.maximum(a, p - more + 1), b)
        own = np.flatnonzero(e - s >= length)
        s, e, at = s[own], e[own], p[own]
        route = K.span_hashes(raw, at - more, at + ANCHOR) if left else K.span_hashes(raw, at, at + length - more + 1)
        out.append((doc[own], s, e, route, K.span_hashes(raw, s, e)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a new value begins."""
    head = np.zeros(len(columns[0]), bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(head)


def _anchor_sets(docs, doc, h, buckets: int):
    """A chunk's distinct anchors by bucket and value, whether two documents have them, on how many segments (65,535 at most), the edges of buckets, and the place of each segment's anchor."""
    order = np.argsort(h)
    at = _heads(h[order])
    hs = h[order[at]]
    if not len(hs):
        return hs, np.zeros(0, bool), np.zeros(0, np.uint16), np.zeros(buckets + 1, np.int64), np.zeros(0, np.int64)
    ds = docs[doc[order]]
    many = np.minimum.reduceat(ds, at) != np.maximum.reduceat(ds, at)
    bucket = _bucket(hs, buckets)
    by = np.argsort(bucket, kind="stable")
    counts = np.diff(np.append(at, len(h)))
    place, own = np.empty(len(hs), np.int64), np.empty(len(h), np.int64)
    place[by] = np.arange(len(hs))
    own[order] = np.repeat(place, counts)
    return hs[by], many[by], np.minimum(counts, 65535).astype(np.uint16)[by], np.searchsorted(bucket[by], np.arange(buckets + 1)), own


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U64(20)) % U64(buckets)).astype(np.int32)


SENT = "bucket int, chunk int, data binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _send_anchors(length: int, buckets: int):
    @spread.lean
    def send(table: pa.Table) -> pa.Table:
        docs, _, _, doc, _, _, h, _, _ = _read_chunk(table, length, keys=False)
        hs, many, counts, edges, _ = _anchor_sets(docs, doc, h, buckets)
        chunk = table.column("chunk")[0].as_py()
        return _sent([(k, chunk, spread.pack(spread.pack_sorted(hs[edges[k] : edges[k + 1]]), np.packbits(many[edges[k] : edges[k + 1]]), counts[edges[k] : edges[k + 1]])) for k in np.flatnonzero(np.diff(edges)).tolist()])

    return send


#: Answers about an anchor: one document has it, two or more have it, so many segments have it that they are cut in two.
ALONE, SHARED, HOT = 0, 1, 2


def _answer_anchors(hot: int):
    @spread.lean
    def answer(table: pa.Table) -> pa.Table:
        lists = [spread.unpack(x.as_py()) for x in table.column("data")]
        values = np.concatenate([np.cumsum(x[0], dtype=U64) for x in lists])
        many = np.concatenate([np.unpackbits(x[1], count=len(x[0])) for x in lists])
        order = np.argsort(values)
        at = _heads(values[order])
        chunks = np.diff(np.append(at, len(values)))
        segments = np.add.reduceat(np.concatenate([x[2] for x in lists])[order].astype(np.int64), at)
        said = np.where((chunks > 1) | (np.bitwise_or.reduceat(many[order], at) > 0), np.where(segments > hot, HOT, SHARED), ALONE).astype(np.uint8)
        answer = np.empty(len(values), np.uint8)
        answer[order] = np.repeat(said, chunks)
        ends = np.cumsum([len(x[0]) for x in lists])
        return _sent([(b.as_py(), c.as_py(), spread.pack(answer[e - len(x[0]) : e])) for b, c, x, e in zip(table.column("bucket"), table.column("chunk"), lists, ends, strict=True)])

    return answer


def _gather(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = b - a
    to = np.cumsum(size)
    return raw[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(a - (to - size), size)]


def _send_segments(length: int, buckets: int):
    """Distinct segments on shared anchors, with the smallest document and their bytes."""
    @spread.lean
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _sent([])
        docs, raw, _, doc, a, b, h, key, p = _read_chunk(table, length)
        hs, _, _, edges, own = _anchor_sets(docs, doc, h, buckets)
        answer = np.zeros(len(hs), np.uint8)
        for k, data in zip(replies.column("bucket").to_pylist(), replies.column("data"), strict=True):
            answer[edges[k] : edges[k + 1]] = spread.unpack(data.as_py())[0]
        own = answer[own]
        chosen, hot = np.flatnonzero(own == SHARED), np.flatnonzero(own == HOT)
        if len(hot):
            parts = _halves(raw, doc[hot], a[hot], b[hot], p[hot], length)
            doc, a, b, h, key = (np.concatenate([x[chosen], y]) for x, y in zip((doc, a, b, h, key), parts, strict=True))
            chosen = np.arange(len(key))
        by = chosen[np.argsort(key[chosen])]
        at = _heads(key[by])
        least = np.minimum.reduceat(docs[doc[by]], at) if len(at) else np.zeros(0, np.int64)
        one = by[at]
        to = _bucket(h[one], buckets)
        by = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[by], np.arange(buckets + 1))
        rows, chunk = [], table.column("chunk")[0].as_py()
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = by[edges[k] : edges[k + 1]]
            s = one[own]
            rows.append((k, chunk, spread.pack(spread.pack_sorted(key[s]), least[own], (b[s] - a[s]).astype(np.uint16), _gather(raw, a[s], b[s]), np.full(1, len(hot) > 0))))
        return _sent(rows)

    return send


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that orders as they do."""
    return np.ndarray((len(text),), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))


def _ranked(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Dense ranks of the windows that start at some places: by eight bytes after eight, each time those that are still tied."""
    words = _words(text)
    key = words[at].astype(U64)
    order = np.argsort(key)
    new = np.zeros(len(at), bool)
    new[_heads(key[order])] = True
    for offset in [*range(8, length - 8, 8), length - 8]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(group) else group
        if not len(tied):
            break
        own, of = order[tied], group[tied]
        key = words[at[own] + offset].astype(U64)
        by = np.lexsort((key, of))
        order[tied] = own[by]
        new[tied[_heads(of, key[by])]] = True
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


class RunIndex:
    """Run-compressed Burrows-Wheeler index of the windows of `length` bytes in distinct segments.

    text: the segments' bytes, one after the other; size, least: each one's
    length and smallest document. Groups of equal windows are numbered in order.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, least: np.ndarray, length: int):
        self.text, self.size, self.length = text, size, length
        self.ends = np.cumsum(size)
        self.windows = size - length + 1
        upto = np.cumsum(self.windows)
        at = _ramp(self.ends - size, self.windows)
        rank = _ranked(text, at, length)
        self.groups = int(rank.max(initial=-1)) + 1
        self.least = np.full(self.groups, np.iinfo(np.int64).max)
        np.minimum.at(self.least, rank, np.repeat(least, self.windows))
        self.tail = rank[upto - 1]  # where each segment's last window stands
        inner = np.ones(len(at), bool)
        inner[upto - self.windows] = False
        inner = np.flatnonzero(inner)  # windows with a symbol before them
        place, first = np.unique(self._place(text[at[inner] - 1], rank[inner]), return_index=True)  # the transform: symbols, each with the groups it stands before
        leads = rank[inner[first] - 1]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (leads[1:] != leads[:-1] + 1)
        heads = np.flatnonzero(new)
        self.heads, self.leads = place[heads], leads[heads]
        self.tails = place[np.append(heads[1:], len(place)) - 1] if len(heads) else place

    @staticmethod
    def _place(symbol: np.ndarray, group: np.ndarray) -> np.ndarray:
        return (symbol.astype(np.int64) << 40) | group

    def left(self, group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """LF: the group that symbol before each group leads to, -1 if no segment has it."""
        if not len(self.heads):
            return np.full(len(group), -1)
        place = self._place(symbol, group)
        run = np.searchsorted(self.heads, place, side="right") - 1
        return np.where((run >= 0) & (place <= self.tails[run]), self.leads[run] + place - self.heads[run], -1)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of every segment: per window, the smallest document that holds it; windows in text order, with len+1 offsets."""
        offsets = np.concatenate([[0], np.cumsum(self.windows)])
        out = np.zeros(int(offsets[-1]), np.int64)
        state, live = self.tail.copy(), np.arange(len(self.size))
        for step in range(int(self.windows.max(initial=0))):
            live = live[self.windows[live] > step]
            out[offsets[live + 1] - 1 - step] = self.least[state[live]]
            more = live[self.windows[live] > step + 1]
            state[more] = self.left(state[more], self.text[self.ends[more] - self.length - step - 1])
        return out, offsets


def _grouped(keys: np.ndarray, least: np.ndarray):
    """Smallest document of each distinct key: the group of every row, one row of each group, its smallest document."""
    order = np.argsort(keys)
    at = _heads(keys[order])
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    return group, order[at], np.minimum.reduceat(least[order], at) if len(at) else least[:0]


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] numbers for each i."""
    to = np.cumsum(size)
    return np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - size), size)


def _answer_segments(length: int):
    @spread.lean
    def answer(table: pa.Table) -> pa.Table:
        lists = [spread.unpack(x.as_py()) for x in table.column("data")]
        key, own, size, raw = (np.concatenate([np.cumsum(x[k], dtype=U64) if k == 0 else x[k] for x in lists]) for k in range(4))
        counts, cuts = [len(x[0]) for x in lists], [x[4] for x in lists]
        del lists
        group, one, low = _grouped(key, own)
        size = size.astype(np.int64)
        starts = np.cumsum(size) - size
        first, offsets = RunIndex(raw[_ramp(starts[one], size[one])], size[one], low, length).stream()
        # a segment whose windows all have one smallest document is answered by that number alone
        low, high = np.minimum.reduceat(first, offsets[:-1]), np.maximum.reduceat(first, offsets[:-1])
        rows, at = [], 0
        for b, c, n, cut in zip(table.column("bucket"), table.column("chunk"), counts, cuts, strict=True):
            g, keys = group[at : at + n], key[at : at + n]
            at += n
            same = low[g] == high[g]
            g, several = g[same], g[~same]
            windows = offsets[several + 1] - offsets[several]
            rows.append((b.as_py(), c.as_py(), spread.pack(spread.pack_sorted(keys[same]), low[g], spread.pack_sorted(keys[~same]), windows.astype(np.uint16), first[_ramp(offsets[several], windows)], cut)))
        return _sent(rows)

    return answer


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REMAINS = {"kept": "binary", "text": "string", "spans": "array<struct<start:long,stop:long>>"}
#: Bytes of text marked at once.
SLICE = 2 << 20


def _found(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of own are among keys, and where."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ks = keys[order]
    at = np.minimum(np.searchsorted(ks, own), len(ks) - 1)
    hit = np.flatnonzero(ks[at] == own)
    return hit, order[at[hit]]


def _mark(length: int, outputs: tuple[str, ...], carry: tuple[str, ...]):
    @spread.lean
    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        docs, raw, offsets, doc, a, b, _, key, p = _read_chunk(table, length)
        parts = [spread.unpack(x.as_py()) for x in replies.column("data")] if len(replies) else []
        if any(x[5].any() for x in parts):  # some segments were sent in two parts; answers go by content
            doc, a, b, _, key = (np.concatenate(x) for x in zip((doc, a, b, key, key), _halves(raw, doc, a, b, p, length), strict=True))
        step = np.zeros(len(raw) + 1, np.int8)  # where marked windows begin and end
        if parts and len(a):
            whole, low, differ, windows, first = (np.concatenate([np.cumsum(x[k], dtype=U64) if k in (0, 2) else x[k] for x in parts]) for k in range(5))
            hit, at = _found(whole, key)
            old = hit[low[at] < docs[doc[hit]]]
            np.add.at(step, a[old], 1)
            np.add.at(step, b[old] - length + 1, -1)
        marked = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        if parts and len(a):
            hit, at = _found(differ, key)
            n = windows.astype(np.int64)
            src = (np.cumsum(n) - n)[at]
            old = first[_ramp(src, n[at])] < np.repeat(docs[doc[hit]], n[at])
            marked[_ramp(a[hit], n[at])[old]] = True
        out, i = [], 0
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            own = slice(offsets[i], offsets[j])
            out.append(_cleared(docs[i:j], raw[own], offsets[i : j + 1] - offsets[i], marked[own], length, outputs))
            i = j
        if not out:
            out.append(_cleared(docs, raw, offsets, marked, length, outputs))
        done = pa.concat_tables(out)
        for c in carry:
            done = done.append_column(c, table.column(c))
        return done

    return mark


def _cleared(docs, raw, offsets, marked, length: int, outputs: tuple[str, ...]) -> pa.Table:
    """What is left of some documents, where marked says at which bytes a window goes."""
    sums = np.concatenate([np.zeros(length, np.int32), np.cumsum(marked, dtype=np.int32)])
    cover = sums[length:] > sums[:-length]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    other = edge.copy()
    other[1:-1] |= ~cover[:-1]
    heads = np.flatnonzero(cover & other[:-1])
    other = edge.copy()
    other[1:-1] |= ~cover[1:]
    tails = np.flatnonzero(cover & other[1:]) + 1
    sums = np.concatenate([[0], np.cumsum(cover)])
    removed = sums[offsets[1:]] - sums[offsets[:-1]]
    cuts = np.searchsorted(heads, offsets)
    kept, to = raw[~cover], offsets - sums[offsets]
    sha = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
    out = {"doc_id": docs, "n_bytes": np.diff(offsets), "n_removed": removed.astype(np.int64), "n_spans": np.diff(cuts).astype(np.int64), "kept_sha256": pa.array(sha, pa.string())}
    if "kept" in outputs:
        out["kept"] = _strings(kept, to, pa.large_binary()).cast(pa.binary())
    if "text" in outputs:
        whole = cover  # a character goes if all its bytes go
        if cover.any():
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.repeat(np.logical_and.reduceat(cover, lead), np.diff(np.append(lead, len(raw))))
        sums = np.concatenate([[0], np.cumsum(whole)])
        out["text"] = _strings(raw[~whole], offsets - sums[offsets], pa.large_string()).cast(pa.string())
    if "spans" in outputs:
        base = np.repeat(offsets[:-1], np.diff(cuts))
        both = pa.StructArray.from_arrays([pa.array(heads - base, pa.int64()), pa.array(tails - base, pa.int64())], names=["start", "stop"])
        out["spans"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), both)
    return pa.table(out)


def _strings(raw: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)])


def suffix_dedup(docs: DataFrame, length: int = 50, outputs: tuple[str, ...] = tuple(REMAINS), carry: tuple[str, ...] = (), chunk_bytes: int = spread.CHUNK, hot: int = 1 << 14) -> DataFrame:
    """Long repeats of documents (doc_id, text): one row a row of docs.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256; of outputs, kept (the
    remaining bytes, which can end inside a character), text (a string of all
    characters but those that go with all their bytes) and spans (byte ranges
    removed); then the columns of docs named by carry. Texts are judged as given, whole, and matches never cross
    documents. A null text is empty; a null doc_id sorts after all others and
    stays null. Rows with one doc_id never remove each other's bytes. A text
    under `length` bytes stays whole. Other columns are ignored. An empty
    table gives no rows. hot: segments of one anchor beyond which they are cut in
    two and routed further. A very long text is one task's: some ten times its
    bytes must fit there.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} or more")
    spread.ready(docs.sparkSession)
    n = spread.chunk_count(docs, chunk_bytes)
    rows = spread.keyed(docs, n, *carry)  # shuffled once, read three times
    anchors = rows.groupBy("chunk").applyInArrow(_send_anchors(length, n), SENT)
    shared = anchors.groupBy("bucket").applyInArrow(_answer_anchors(hot), SENT)
    segments = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_segments(length, n), SENT)
    matches = segments.groupBy("bucket").applyInArrow(_answer_segments(length), SENT)
    outputs = tuple(c for c in REMAINS if c in outputs)
    kind = T.StructType([*T._parse_datatype_string(", ".join([DIGEST, *(f"{c} {REMAINS[c]}" for c in outputs)])).fields, *(docs.schema[c] for c in carry)])
    marked = rows.groupBy("chunk").cogroup(matches.groupBy("chunk")).applyInArrow(_mark(length, outputs, carry), kind)
    return marked.withColumn("doc_id", spread.given(F.col("doc_id")))
