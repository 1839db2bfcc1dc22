"""Quality classifier by co-training of two views.

View one sees the text only: shares of byte classes, word and line statistics.
View two sees the page's metadata only: source, language, length. Each round,
either view labels the unlabelled documents it is surest of for the other one:
all unlabelled documents are scored, and a histogram of the scores says from
where on a view is sure. Both views then learn by Newton steps whose sums run
over all documents labelled so far, task by task. At the end both are calibrated
on labelled documents that neither has learnt from, and a small logistic model
over the two calibrated log-odds scores all documents.

Labels given in a round follow from the models and edges of the rounds before, so
nothing is kept for each document but its two views, some 220 bytes.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import kernels as K
from tracewright.llm import spread

#: Labelled documents that the views are fitted on, at most about (chosen by a digest of doc_id). Unlabelled ones take part all.
SAMPLE = 12_000
ROUNDS = 4
#: Newton steps in a round.
STEPS = 2
#: Share of the unlabelled documents that a view may label in one round, to a step of the histogram of its scores.
SURE = 0.05
#: Steps of that histogram for each unit of log-odds, which lie within LIMIT.
FINE, LIMIT = 20, 30
#: A view is sure only from these log-odds on, and only where they are so far from the prior's: one that learns nothing labels nothing.
LEAST, BEYOND = 3, 2
CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
for _k, _bytes in enumerate((range(65, 91), [*range(97, 123), *range(128, 256)], range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"|", b"<>{}[]=/\\")):
    _CLASS[list(_bytes)] = _k
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
TEXT_VIEW = CLASSES + 9


def text_view(column) -> np.ndarray:
    """A row of TEXT_VIEW numbers for every text: nothing but its content counts."""
    raw, offsets = K.texts(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    out = [c for c in np.bincount(doc * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES).T / size]
    start, end, first = K.word_spans(raw, offsets)
    words = np.maximum(np.diff(first), 1).astype(float)
    of = np.repeat(np.arange(n), np.diff(first))
    odd = np.isin(_CLASS[raw[end - 1]], (6, 7, 8, 9)) if len(end) else np.zeros(0, bool)
    length = (end - start).astype(float)
    out += [np.bincount(of, odd, n) / words, np.bincount(of, length, n) / words, np.bincount(of, length > 25, n) / words]
    for gap, least in ((_LINE, 1), (K.SPACE, 50)):  # repeated lines, repeated words
        s, e, f = (start, end, first) if gap is K.SPACE else K.word_spans(raw, offsets, gap)
        h = K.span_hashes(raw, s, e, cased=False)
        own = np.repeat(np.arange(n), np.diff(f))
        order = np.lexsort((h, own))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
        total = np.diff(f)
        if gap is K.SPACE:  # words said again at once
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            out.append(np.bincount(own, again, n) / words)
        out.append(np.where(total > least, 1 - np.bincount(own[order][new], minlength=n) / np.maximum(total, 1), 0.0))
    lines = np.maximum(np.bincount(doc, raw == 10, n) + 1, 1)
    out += [np.log1p(words / lines), np.log1p(np.diff(offsets)), (np.diff(offsets) == 0).astype(float)]
    return np.stack(out, axis=1)


SLOTS = 64


def page_view(source, lang, n_chars) -> np.ndarray:
    """A row for every document from its metadata: hashed source and language, and its stated length in steps."""
    n = len(source)
    out = np.zeros((n, SLOTS + 16 + 12))
    for column, at, slots in ((source, 0, SLOTS), (lang, SLOTS, 16)):
        raw, offsets = K.texts(column)
        full = np.flatnonzero(np.diff(offsets))
        slot = np.zeros(n, np.int64)  # null and empty: the first slot
        if len(full):
            slot[full] = 1 + (K.span_hashes(raw, offsets[full], offsets[full + 1]) % np.uint64(slots - 1)).astype(np.int64)
        out[np.arange(n), at + slot] = 1.0
    chars = pc.fill_null(n_chars.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    out[np.arange(n), SLOTS + 16 + np.clip(np.log2(np.maximum(chars, 1)).astype(int) - 4, 0, 11)] = 1.0
    return out


class Logistic:
    """L2 logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        self.w = np.zeros(x.shape[1] + 1)
        self.ridge = np.full(len(self.w), penalty)
        self.ridge[-1] = 1e-6
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-6:
                break

    def _rows(self, x):
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._rows(x) @ self.w, -LIMIT, LIMIT)

    def sums(self, x: np.ndarray, y: np.ndarray, safe: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss over some rows. safe: the curvature of a parabola that stays above the loss, so that no step makes it worse."""
        a = self._rows(x)
        logit = np.clip(a @ self.w, -LIMIT, LIMIT)
        p = 1 / (1 + np.exp(-logit))
        weight = np.tanh(np.maximum(np.abs(logit), 1e-6) / 2) / (2 * np.maximum(np.abs(logit), 1e-6)) if safe else p * (1 - p) + 1e-9
        return a.T @ (p - y), (a * weight[:, None]).T @ a

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """One Newton step; its largest part."""
        by = np.linalg.solve(curvature + np.diag(self.ridge), gradient + self.ridge * self.w)
        self.w = self.w - by
        return float(np.abs(by).max())


#: A round: the models of both views, and for each the scores up to which and from which on it labels.
Round = tuple[list[Logistic], list[tuple[float, float]]]


def given_labels(views: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """For each view, the labels that the other one has given to some unlabelled documents, -1 where none."""
    labels = [np.full(len(views[0]), -1.0) for _ in views]
    for models, edges in rounds:
        scores = [m.logit(x) for m, x in zip(models, views, strict=True)]
        free = [own < 0 for own in labels]
        for k, (low, high) in enumerate(edges):
            labels[1 - k][free[1 - k] & (scores[k] <= low)] = 0.0
            labels[1 - k][free[1 - k] & (scores[k] >= high)] = 1.0
    return labels


def histogram(views, rounds: list[Round], models: list[Logistic]) -> np.ndarray:
    """For each view, how many documents that the other has no label for have each score, in steps."""
    labels = given_labels(views, rounds)
    step = [np.floor((m.logit(x) + LIMIT) * FINE).astype(int) for m, x in zip(models, views, strict=True)]
    return np.stack([np.bincount(at[labels[1 - k] < 0], minlength=2 * LIMIT * FINE + 1) for k, at in enumerate(step)])


def newton_sums(views, rounds: list[Round], models: list[Logistic]) -> np.ndarray:
    """Gradients and curvatures of both views over the documents that have labels, one after the other."""
    out = []
    for x, y, m in zip(views, given_labels(views, rounds), models, strict=True):
        out += [part.reshape(-1) for part in m.sums(x[y >= 0], y[y >= 0], safe=True)]
    return np.concatenate(out)


def sure_edges(counts: np.ndarray, most: int, prior: float) -> tuple[float, float]:
    """The scores up to which, and from which on, about `most` documents are the surest: the step that reaches the number counts whole."""
    def reach(row, wanted):
        upto = np.cumsum(row)
        return int(np.searchsorted(upto, min(wanted, upto[-1]))) if wanted > 0 and upto[-1] else -1

    low, high = reach(counts, round(most * (1 - prior))), reach(counts[::-1], round(most * prior))
    down = (low + 1) / FINE - LIMIT - 1e-9 if low >= 0 else -np.inf
    up = (len(counts) - 1 - high) / FINE - LIMIT if high >= 0 else np.inf
    usual = np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
    return min(down, -LEAST, usual - BEYOND), max(up, LEAST, usual + BEYOND)


class Pool:
    """The unlabelled documents: what one pass over them adds up to. Here they are arrays."""

    def __init__(self, text: np.ndarray, page: np.ndarray):
        self.views, self.count = (text, page), len(text)

    def add(self, sums, *args) -> np.ndarray:
        return sums(self.views, *args)


class CoTrained:
    """Two views, calibrated and combined. y: 0 or 1; held: labelled rows kept for calibration; pool: the unlabelled documents."""

    def __init__(self, text: np.ndarray, page: np.ndarray, y: np.ndarray, held: np.ndarray, pool: Pool, rounds: int = ROUNDS, sure: float = SURE):
        views, known = (text, page), ~held
        self.prior = float(y[known].mean()) if known.any() else 0.5
        self.joint = None
        if len(set(y[known])) < 2:
            return
        self.models = [Logistic(x[known], y[known]) for x in views]
        most, past = int(sure * pool.count), []
        for _ in range(rounds if most else 0):
            counts = pool.add(histogram, past, self.models).reshape(2, -1)
            past.append((copy.deepcopy(self.models), [sure_edges(row, most, self.prior) for row in counts]))
            for _ in range(STEPS):
                flat, at = pool.add(newton_sums, past, self.models), 0
                for m, x in zip(self.models, views, strict=True):
                    n = len(m.w)
                    gradient, curvature = m.sums(x[known], y[known], safe=True)
                    m.step(gradient + flat[at : at + n], curvature + flat[at + n : at + n + n * n].reshape(n, n))
                    at += n + n * n
        at = held if len(set(y[held])) == 2 else known
        both = np.stack([m.logit(x[at]) for m, x in zip(self.models, views, strict=True)], axis=1)
        self.calibrated = [Logistic(both[:, [k]], y[at], 0.1) for k in (0, 1)]
        self.joint = Logistic(np.stack([c.logit(both[:, [k]]) for k, c in enumerate(self.calibrated)], axis=1), y[at], 0.1)

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        if self.joint is None:
            return np.full(len(text), self.prior)
        logits = [c.logit(m.logit(x)[:, None]) for m, c, x in zip(self.models, self.calibrated, (text, page), strict=True)]
        return 1 / (1 + np.exp(-self.joint.logit(np.stack(logits, axis=1))))


def _both_views(part) -> np.ndarray:
    """Both views of some documents side by side, in two bytes a number: learning and scoring see the same."""
    return np.concatenate([text_view(part.column("text")), page_view(part.column("source"), part.column("lang"), part.column("n_chars"))], axis=1).astype(np.float16)


def _apart(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return both[:, :TEXT_VIEW].astype(float), both[:, TEXT_VIEW:].astype(float)


def _view_rows(batches):
    for batch in batches:
        data = [x.tobytes() for part in K.batches(batch) for x in _both_views(part)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])


def _scored(model):
    def score(batches):
        for batch in batches:
            got = model.value.score(*_unpacked(batch.column("data"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return score


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars"))


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    return _apart(np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1))


class SparkPool(Pool):
    """Unlabelled documents as a table of their views; a pass sends one row of sums a partition to a few tasks."""

    def __init__(self, table: DataFrame):
        self.table = spread.cut(table)
        self.count = self.table.count()
        self.table = self.table.coalesce(spread.parts_for(self.count, 50_000))

    def add(self, sums, *args) -> np.ndarray:
        def part(batches):
            total = None
            for batch in batches:
                if len(batch):
                    own = sums(_unpacked(batch.column("data")), *args).astype(float)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(total.tobytes()) % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "data"])

        def meet(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x, float) for x in sorted(table.column("data").to_pylist())], axis=0)
            return pa.table({"task": table.column("task")[:1], "data": pa.array([total.tobytes()], pa.binary())})

        kind = "task int, data binary"
        rows = self.table.mapInArrow(part, kind).groupBy("task").applyInArrow(meet, kind).collect()  # 16 rows at most
        return np.sum([np.frombuffer(r["data"], float) for r in sorted(rows)], axis=0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[CoTrained, DataFrame]:
    """A model fitted on about sample labelled documents and all unlabelled ones, and the views (doc_id, data) of all rows of docs. Null labels are left out; of repeated ones the largest counts."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    part = F.abs(F.xxhash64("doc_id", F.lit("views"))) / F.lit(float(2**63))
    have = labels.count()
    chosen = F.broadcast(labels.where(part < sample / max(have, 1)))  # about sample rows at most
    viewed = spread.cut(_inputs(docs).mapInArrow(_view_rows, "doc_id long, data binary"))  # every text is read once
    a = viewed.join(chosen, "doc_id").collect()
    order = sorted(a, key=lambda r: (r["doc_id"], r["data"]))
    if not order:
        none = np.zeros((0, TEXT_VIEW)), np.zeros((0, SLOTS + 28))
        return CoTrained(*none, np.zeros(0), np.zeros(0, bool), Pool(*none)), viewed
    text, page = _unpacked(pa.array([r["data"] for r in order]))
    y = np.array([r["y"] for r in order])
    ids = np.array([r["doc_id"] for r in order])
    pool = SparkPool(viewed.where("doc_id is not null").join(labels, "doc_id", "left_anti").select("data"))
    return CoTrained(text, page, y, K.mix(ids.astype(np.uint64) + np.uint64(7)) % np.uint64(4) == 0, pool), viewed


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Quality of every document: doc_id, score (0 to 1, higher: label 1 likelier), keep (score >= threshold); one row a row of docs.

    docs: doc_id, text, source, lang, n_chars; labels: doc_id, quality. Nulls
    count as empty or 0; a null doc_id stays null and is never learnt from;
    repeated rows are scored each; other columns are ignored. Without labels of
    both kinds every document scores the labels' mean (0.5 without any).
    """
    spark = docs.sparkSession
    spread.ready(spark)
    model, viewed = train(docs, labels, sample)
    out = viewed.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.withColumn("keep", F.col("score") >= F.lit(threshold))


def _kept(model, threshold: float):
    def keep(batches):
        for batch in batches:
            got = [model.value.score(*_apart(_both_views(part))) for part in K.batches(batch)]
            yield batch.filter(pa.array(np.concatenate(got) >= threshold)) if got else batch

    return keep


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, n_chars) that quality() keeps; only these columns."""
    spark = docs.sparkSession
    spread.ready(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, sample)[0])
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return rows.mapInArrow(_kept(model, threshold), rows.schema)
