"""N-gram Jaccard join: exact near-duplicate links by a prefix-tree join.

Sets of word shingles link when their Jaccard similarity reaches a threshold
(a ratio of whole numbers, so the test is exact). How:

1. *Classes.* Documents with equal sets form a class, which has a number of
   its own from here on: doc_ids, which can repeat or be null, name no sets.
   Its smallest doc_id says where its set is read. Copies cost one counted row.
2. *Global order.* Hash chunks send the distinct shingles of their
   representatives, sorted and packed, to shingle buckets, which count
   documents; the reply is the binary logarithm of the count. Shingles are
   ordered by that, then by hash: rare ones first. Shingles that one class has
   count in its size and are not stored.
3. *Tries.* Each set is stored once, in the trie of its lead: of its prefix (the
   first n - ceil(t n) + 1 shingles, one of which any link shares) the shingle
   that hashes lowest, so near copies meet. A lead whose sets are too large for
   one trie is dealt over several. Probes walk a trie together, level by level:
   sets with a common beginning share one partial overlap, and a subtree goes
   where its remaining length can't reach the threshold, or where all its sets
   are in the probe's component. In each trie all sets are probed but those of
   its largest component, so every link inside it is found or implied.
4. *Directory.* Prefix shingles say which tries hold them. Where a shingle's
   sets are in more than one component, its pivot (of the largest component)
   probes the other tries; two rounds join most of what belongs together. Then
   every set outside the shingle's largest component probes each trie that can
   hold a link by sizes and positions: of two sets in different components one
   at least is outside, so no link is lost.

What travels for probing is a set for each trie it probes, and what comes back
is at most a link for each two components joined. A group of near copies of which
many do not link makes (sets that do not) x (tries of the group) probes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import kernels as K
from tracewright.llm import spread

U64 = np.uint64
#: Rounds of pivots before the exact rest.
ROUNDS = 2
#: Shingles in one trie, about, and in a node's own run.
TRIE = 1 << 19
RUN = 64
#: Bits of a shingle hash that sets are compared by.
LOW = np.uint64((1 << 56) - 1)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, ascending, with len+1 offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[head], np.searchsorted(d[head], np.arange(len(offsets)))


def _sets(table, size: int):
    """(doc_ids, distinct shingles, offsets) of a table, in pieces that bound memory."""
    for part in K.batches(table):
        raw, offsets = K.texts(part.column("text"))
        h, o = K.shingles(raw, offsets, size)
        yield K.ids(part.column("doc_id")), *_distinct(h & LOW, o)


CLASS = "doc_id long, n_shingles long, class binary"


def _classify(size: int, carry: tuple[str, ...]):
    def classify(batches):
        for batch in batches:
            at = 0
            for docs, h, o in _sets(batch, size):
                n = np.diff(o)
                own = batch.slice(at, len(docs))
                at += len(docs)
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)]) for x in (h, K.mix(h * U64(3)))]
                keys = np.stack([(s[o[1:]] - s[o[:-1]]) for s in sums] + [n.astype(U64)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n.astype(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary()), *(own.column(c) for c in carry)], names=["doc_id", "n_shingles", "class", *carry])

    return classify


SENT = "bucket int, chunk int, data binary"


def _sent(rows) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _representatives(table: pa.Table, reps: pa.Table, size: int):
    """The sets of the chunk's classes: their numbers, shingles, offsets. A doc_id that comes twice stands once for each of its classes."""
    own = dict(zip(zip(K.ids(reps.column("doc_id")).tolist(), reps.column("class").to_pylist(), strict=True), reps.column("node").to_pylist(), strict=True)) if len(reps) else {}
    wanted = {d for d, _ in own}
    nodes, sets = [], []
    keep = np.isin(K.ids(table.column("doc_id")), np.fromiter(wanted, np.int64, len(wanted)))
    for ids, h, o in _sets(table.filter(pa.array(keep)), size):
        n = np.diff(o)
        sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)]) for x in (h, K.mix(h * U64(3)))]
        keys = np.stack([(s[o[1:]] - s[o[:-1]]) for s in sums] + [n.astype(U64)], axis=1)
        for i, d in enumerate(ids.tolist()):
            if (k := (d, keys[i].tobytes())) in own:
                nodes.append(own.pop(k))
                sets.append(h[o[i] : o[i + 1]])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.array(nodes, np.int64), np.concatenate(sets) if sets else np.zeros(0, U64), offsets


def _bucketed(h: np.ndarray, buckets: int):
    """Distinct values with counts, and their order by bucket with the buckets' edges."""
    values, counts = np.unique(h, return_counts=True)
    b = ((values >> U64(16)) % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    return values, counts, order, np.searchsorted(b[order], np.arange(buckets + 1))


def _send_shingles(size: int, buckets: int):
    @spread.lean
    def send(table: pa.Table, reps: pa.Table) -> pa.Table:
        if not len(table) or not len(reps):
            return _sent([])
        _, h, _ = _representatives(table, reps, size)
        values, counts, order, edges = _bucketed(h, buckets)
        rows, chunk = [], table.column("chunk")[0].as_py()
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            rows.append((k, chunk, spread.pack(spread.pack_sorted(values[own]), counts[own].astype(np.uint32))))
        return _sent(rows)

    return send


@spread.lean
def _answer_shingles(table: pa.Table) -> pa.Table:
    """For each chunk's shingles: 0 if one document has it, else the bits of the number of documents."""
    lists = [spread.unpack(x.as_py()) for x in table.column("data")]
    values = np.concatenate([np.cumsum(x[0], dtype=U64) for x in lists])
    counts = np.concatenate([x[1] for x in lists]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    v = values[order]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(head)
    total = np.add.reduceat(counts[order], at)
    level = np.empty(len(v), np.uint8)
    level[order] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(head) - 1] + (total > 1)[np.cumsum(head) - 1]
    ends = np.cumsum([len(x[0]) for x in lists])
    return _sent([(b.as_py(), c.as_py(), spread.pack(level[e - len(x[0]) : e])) for b, c, x, e in zip(table.column("bucket"), table.column("chunk"), lists, ends, strict=True)])


SET = "node long, n long, lead long, data binary"


def _send_sets(size: int, buckets: int, num: int, den: int):
    """Sets that share a prefix shingle with another class: their shingles but those that are theirs alone, in global order."""
    @spread.lean
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"node": [], "n": [], "lead": [], "data": []}
        tables = replies.filter(pc.is_valid(replies.column("class"))) if len(replies) else replies
        marks = replies.filter(pc.is_null(replies.column("class"))) if len(replies) else replies
        if len(table) and len(tables):
            nodes, h, o = _representatives(table, tables, size)
            values, _, order, edges = _bucketed(h, buckets)
            level = np.zeros(len(values), np.uint8)
            for k, data in zip(marks.column("bucket").to_pylist(), marks.column("data"), strict=True):
                level[order[edges[k] : edges[k + 1]]] = spread.unpack(data.as_py())[0]
            ranks = level[np.searchsorted(values, h)]
            for i in range(len(nodes)):
                own, r = h[o[i] : o[i + 1]], ranks[o[i] : o[i + 1]]
                n, shared = len(own), r > 0
                key = (r[shared].astype(U64) << U64(56)) | own[shared]
                prefix = _prefix(n, len(key), num, den)
                if prefix > 0:
                    key.sort()
                    tokens = key[:prefix] & LOW
                    out["node"].append(int(nodes[i]))
                    out["n"].append(n)
                    out["lead"].append(int(tokens[np.argmin(K.mix(tokens * U64(11)))]))
                    out["data"].append(spread.pack(spread.pack_sorted(key)))
        return pa.table([pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["lead"], pa.int64()), pa.array(out["data"], pa.binary())], names=list(out))

    return send


def _prefix(n: int, stored: int, num: int, den: int) -> int:
    """How many of a set's stored shingles are among its first n - ceil(num n / den) + 1."""
    return n - -(-num * n // den) + 1 - (n - stored)


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] numbers for each i."""
    to = np.cumsum(size)
    return np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - size), size)


class Trie:
    """Path-compressed trie of globally ordered sets, walked by many probes at once.

    A node covers a range of the sorted sets: those that begin with the shingles
    on its path. Of it the trie keeps its own shingles (at most RUN: longer runs
    are chains, so that walks can end inside), its children, the sets that end
    there, the least size and the most shingles below.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets: ascending shingles of each set; sizes: how many it has, with those that are not stored."""
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()), np.int64)
        sets, self.sizes = [sets[i] for i in self.order], sizes[self.order].astype(np.int64)
        length = np.array([len(s) for s in sets], np.int64)
        begin = np.cumsum(length) - length
        self.shingles, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.zeros(len(sets), np.int64)  # with the set before
        for i in range(1, len(sets)):
            k = min(length[i - 1], length[i])
            differ = np.flatnonzero(sets[i - 1][:k] != sets[i][:k])
            common[i] = differ[0] if len(differ) else k
        nodes, kids, queue = [], [], [(0, len(sets), 0)]
        for a, b, depth in queue:  # children come one after the other
            whole = int(common[a + 1 : b].min()) if b - a > 1 else int(length[a])
            stop = min(whole, depth + RUN)
            ends = int((length[a:b] == stop).sum()) if stop == whole else 0
            nodes.append((a, b, depth, stop, ends))
            kids.append(len(queue))
            if stop < whole:
                queue.append((a, b, stop))
            elif a + ends < b:
                edges = [a + ends, *(np.flatnonzero(common[a + ends + 1 : b] == stop) + a + ends + 1).tolist(), b]
                queue += [(x, y, stop) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        self.a, self.b, depth, stop, self.ends = np.array(nodes, np.int64).T
        self.kid = np.array(kids, np.int64)
        self.kids = np.diff(np.append(self.kid, len(nodes)))
        self.start, self.run = begin[self.a] + depth, stop - depth
        self.last = np.maximum(begin[self.a] + stop - 1, 0)
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(self.a, self.b, strict=True)])
        self.most = np.array([length[a:b].max() for a, b in zip(self.a, self.b, strict=True)]) - depth

    def probe(self, queries: list[np.ndarray], sizes: np.ndarray, num: int, den: int, group: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, set) of which the similarity is num/den or more. With groups of the sets and of the queries: only pairs of different groups."""
        wide = len(self.shingles)
        at = np.searchsorted(self.shingles, np.concatenate(queries))
        whose = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        inside = self.shingles[np.minimum(at, wide - 1)] == np.concatenate(queries)
        has = np.zeros((len(queries), wide), bool)
        has[whose[inside], at[inside]] = True
        upto = np.cumsum(has, axis=1, dtype=np.int32)
        total = upto[:, -1].astype(np.int64)
        if group is not None:
            steps = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
            alike, mark = steps[self.a] == steps[self.b - 1], group[self.a]

        def open_(p, k, overlap, used):
            best = overlap + np.minimum(total[p] - used, self.most[k])
            keep = den * best >= num * (sizes[p] + self.least[k] - best)
            return keep if group is None else keep & ~(alike[k] & (mark[k] == own[p]))

        p = np.arange(len(queries))
        k = overlap = used = np.zeros(len(p), np.int64)
        found = []
        while True:
            keep = open_(p, k, overlap, used)
            p, k, overlap, used = p[keep], k[keep], overlap[keep], used[keep]
            if not len(p):
                break
            run = self.run[k]
            hits = np.concatenate([[0], np.cumsum(has[np.repeat(p, run), self.at[_ramp(self.start[k], run)]])])
            to = np.cumsum(run)
            overlap = overlap + hits[to] - hits[to - run]
            used = np.where(run > 0, upto[p, self.at[self.last[k]]], used)
            ends = np.flatnonzero(self.ends[k])
            if len(ends):
                s = _ramp(self.a[k[ends]], self.ends[k[ends]])
                q, o = np.repeat(p[ends], self.ends[k[ends]]), np.repeat(overlap[ends], self.ends[k[ends]])
                links = den * o >= num * (sizes[q] + self.sizes[s] - o)
                if group is not None:
                    links &= group[s] != own[q]
                found.append((q[links], s[links]))
            many = self.kids[k]
            p, k, overlap, used = np.repeat(p, many), _ramp(self.kid[k], many), np.repeat(overlap, many), np.repeat(used, many)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in found]), self.order[np.concatenate([x[1] for x in found])]

    def together(self) -> int:
        """Probes that may walk at once: what they hold stays within some 16 MB."""
        return int(max(1, min(256, (1 << 21) // max(len(self.shingles), len(self.a)))))


class Groups:
    """Union-find; the smallest member names a group."""

    def __init__(self, members: np.ndarray):
        self.up = {m: m for m in members.tolist()}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def of(self, members: np.ndarray) -> np.ndarray:
        return np.fromiter((self.find(m) for m in members.tolist()), np.int64, len(members))


def _joined(sets: list[np.ndarray], sizes: np.ndarray, nodes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The component of every set of one trie, by its links inside the trie."""
    groups = Groups(nodes)
    if len(sets) > 1:
        trie = Trie(sets, sizes)
        waiting = np.argsort(K.mix(nodes.astype(U64)))
        step = 1
        while len(waiting):
            now, waiting = waiting[:step], waiting[step:]
            own = groups.of(nodes)
            for a, b in zip(*trie.probe([sets[i] for i in now], sizes[now], num, den, own[trie.order], own[now]), strict=True):
                groups.join(int(nodes[now[a]]), int(nodes[b]))
            own = groups.of(nodes)
            names, counts = np.unique(own, return_counts=True)
            waiting = waiting[own[waiting] != names[np.argmax(counts)]]  # one of two sets in different components is outside the largest
            step = min(2 * step, trie.together())
    return groups.of(nodes)


def _unpacked(column) -> list[np.ndarray]:
    return [np.cumsum(spread.unpack(x.as_py())[0], dtype=U64) for x in column]


def _ranges(values: np.ndarray):
    """Index arrays of equal values."""
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(np.diff(values[order])) + 1
    return np.split(order, edges) if len(order) else []


STORED = "node long, n long, trie long, component long, weight long, data binary, postings array<struct<token:long,at:long>>"


def _store(num: int, den: int):
    @spread.lean
    def store(table: pa.Table) -> pa.Table:
        """The sets of some tries with their components in them, how many sets those have, and the prefix shingles for the directory."""
        nodes, sizes, tries = (table.column(c).to_numpy() for c in ("node", "n", "trie"))
        component, weight = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        postings = [None] * len(nodes)
        for own in _ranges(tries):
            sets = _unpacked(table.column("data").take(pa.array(own)))
            component[own] = _joined(sets, sizes[own], nodes[own], num, den)
            names, at, counts = np.unique(component[own], return_inverse=True, return_counts=True)
            weight[own] = counts[at]
            for i, s in zip(own.tolist(), sets, strict=True):
                first = int(sizes[i]) - len(s)
                postings[i] = [{"token": t, "at": first + j} for j, t in enumerate((s[: _prefix(int(sizes[i]), len(s), num, den)] & LOW).tolist())]
        kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64())]))
        return pa.table({"node": nodes, "n": sizes, "trie": tries, "component": component, "weight": weight, "data": table.column("data"), "postings": pa.array(postings, kind)})

    return store


def _probe(num: int, den: int):
    @spread.lean
    def probe(stored: pa.Table, probes: pa.Table) -> pa.Table:
        """Links between components: of each probe with the sets of the trie it is sent to."""
        out = []
        if len(stored) and len(probes):
            tries, asked = stored.column("trie").to_numpy(), probes.column("probe_trie").to_numpy()
            mine = {int(asked[r[0]]): r for r in _ranges(asked)}
            for own in _ranges(tries):
                todo = mine.get(int(tries[own[0]]))
                if todo is None:
                    continue
                sets, component = _unpacked(stored.column("data").take(pa.array(own))), stored.column("component").to_numpy()[own]
                trie = Trie(sets, stored.column("n").to_numpy()[own])
                sizes, known = probes.column("probe_n").to_numpy(), probes.column("probe_component").to_numpy()
                groups = Groups(np.concatenate([component, known[todo]]))
                for at in range(0, len(todo), step := trie.together()):
                    now = todo[at : at + step]
                    queries = _unpacked(probes.column("probe_data").take(pa.array(now)))
                    for a, b in zip(*trie.probe(queries, sizes[now], num, den, groups.of(component[trie.order]), groups.of(known[now])), strict=True):
                        if groups.join(x := int(known[now[a]]), y := int(component[b])):
                            out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return probe


def _renamed(df: DataFrame, roots: DataFrame | None, *more: str) -> DataFrame:
    """df with its components joined as roots (node, component, and more columns to take over) say."""
    if roots is None:
        return df
    new = spread.small(roots.select(F.col("node").alias("known"), F.col("component").alias("joined"), *(F.col(c).alias(f"new_{c}") for c in more)))
    kept = [c for c in df.columns if c != "component" and c not in more]
    return df.join(new, df["component"] == new["known"], "left").select(*kept, F.coalesce("joined", "component").alias("component"), *(F.coalesce(f"new_{c}", c).alias(c) for c in more))


def jaccard_join(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, chunk_bytes: int = spread.CHUNK) -> DataFrame:
    """Near-duplicate components: doc_id, n_shingles, component_id; one row a row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
    set holds the distinct `size`-word shingles, or the whole sequence where
    there are fewer words. Sets link when den * |intersection| >= num *
    |union|; the empty set links with nothing. component_id is the smallest
    doc_id reachable by links, itself included. Pairs inside a component that is
    already connected are not tested, so links are not counted. A null text is
    empty; rows with a null doc_id take part, sort last and show null. Repeated
    rows are copies of each other; different texts that bear one doc_id, or a
    null one, are looked at each for itself and do not link by that. Other
    columns are ignored; an empty table gives no rows. A very long text is one
    task's: its shingles, 8 bytes each, must fit there.
    """
    out = near_groups(docs, size, num, den, chunk_bytes)
    return out.select(spread.given(F.col("doc_id")).alias("doc_id"), "n_shingles", spread.given(F.col("component_id")).alias("component_id"))


def near_groups(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, chunk_bytes: int = spread.CHUNK, carry: tuple[str, ...] = (), most: int = TRIE) -> DataFrame:
    """jaccard_join's rows with null ids as NULL_ID, the component's number (null where a set is empty: it is in no component) and the columns of docs named by carry.

    Two components can have one component_id, as different texts can bear one doc_id. most: shingles in one trie, about.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    n = spread.chunk_count(docs, chunk_bytes)
    rows = spread.keyed(docs, n)
    kind = T.StructType([*T._parse_datatype_string(CLASS).fields, *(docs.schema[c] for c in carry)])
    sized = spread.cut(spread.keyed(docs, n, *carry).drop("chunk").mapInArrow(_classify(size, carry), kind))
    classes = sized.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = spread.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    chunk = F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    reps = classes.select(chunk.alias("chunk"), F.col("rep").alias("doc_id"), "class", "node", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"))
    shingles = rows.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(_send_shingles(size, n), SENT)
    levels = shingles.groupBy("bucket").applyInArrow(_answer_shingles, SENT)
    replies = reps.unionByName(levels.select("chunk", "bucket", "data"), allowMissingColumns=True)
    sets = spread.cut(rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_send_sets(size, n, num, den), SET))
    own = classes.join(_linked(sets, num, den, most), "node", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "of")
    found = own.join(least, F.col("component") == F.col("of"), "left").select("class", F.coalesce("component", "node").alias("component"), F.coalesce("least", "rep").alias("rep"))
    out = sized.join(found, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"), "component", *carry)


def _linked(sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Components of sets (node, n, lead, data): node, component. A set in no link has its own number."""
    spark = sets.sparkSession
    weigh = sets.groupBy("lead").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    dealt = spread.small(spread.cut(weigh.select(F.col("lead").alias("hot"), F.ceil(F.col("n") / most).alias("tries"))))
    total = sets.agg(F.sum("n")).first()[0] or 0
    tasks = max(spread.partitions(spark), math.ceil(total / (4 * most)))
    at = F.pmod(F.xxhash64("trie"), F.lit(tasks)).cast("int").alias("task")
    trie = F.xxhash64("lead", F.pmod(F.xxhash64("node", "lead"), F.coalesce("tries", F.lit(1)))).alias("trie")
    sets = sets.join(dealt, F.col("lead") == F.col("hot"), "left").select("node", "n", "data", trie).select("*", at)
    stored = spread.cut(sets.groupBy("task").applyInArrow(_store(num, den), STORED))
    nodes = spread.cut(stored.select("node", "component", "weight"))
    weights = nodes.groupBy("component").agg(F.max("weight").alias("weight"))
    members = stored.drop("postings", "weight")
    posted = spread.cut(stored.select("node", "n", "trie", "component", "weight", F.inline("postings")))
    parts = spread.parts_for(posted.count())
    roots = None
    for step in range(ROUNDS + 1):
        exact = step == ROUNDS
        heavy = roots and roots.join(_renamed(weights, roots).groupBy("component").agg(F.sum("weight").alias("weight")), "component")
        now = spread.cut(_renamed(posted, heavy, "weight"), parts) if roots else posted
        best = F.max(F.struct("weight", F.xxhash64("node", F.lit(step)).alias("dice"), "node", "n", "at", "component")).alias("best")
        held = now.groupBy("token", "trie").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("short"), F.max("n").alias("long"), F.max(F.expr("n - at")).alias("room"), best)
        held = spread.cut(held, parts)
        crossing = held.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("best").alias("best")).where("low < high").select("token", "best.*")
        fits = f"{den} * h.long >= {num} * p.n and {den} * p.n >= {num} * h.short"
        if exact:  # at the first shingle that a set shares with another, what follows bounds the overlap
            crossing = now.alias("p").join(crossing.alias("c"), F.expr("p.token = c.token and p.component <> c.component")).select("p.token", "p.node", "p.n", "p.at", "p.component")
            fits += f" and {num + den} * least(p.n - p.at, h.room) >= {num} * (p.n + greatest(h.short, ceil({num} * p.n / {den})))"
        sent = crossing.alias("p").join(held.alias("h"), F.expr(f"p.token = h.token and (h.low <> p.component or h.high <> p.component) and {fits}"))
        sent = spread.cut(sent.select("p.node", "h.trie").distinct(), parts)
        if sent.isEmpty():
            continue  # another pivot may still fit
        asked = members.drop("trie", "task").join(spread.small(sent), "node")
        wanted = members.drop("task").join(spread.small(sent.select("trie").distinct()), "trie", "left_semi")
        wanted = _renamed(wanted, roots).select("*", at)
        asked = _renamed(asked, roots).select("*", at).select(*(F.col(c).alias(f"probe_{c}") for c in ("task", "trie", "n", "component", "data")))
        links = wanted.groupBy("task").cogroup(asked.groupBy("probe_task")).applyInArrow(_probe(num, den), "a long, b long")
        fresh = spread.components(links)
        roots = fresh if roots is None else spread.cut(_renamed(roots, fresh).union(fresh).distinct(), parts)
    return _renamed(nodes.drop("weight"), roots)
