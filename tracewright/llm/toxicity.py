"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words (whole, and by their first bytes, so that
inflected forms meet), word pairs and pairs with one word between, hashed to
`2**BITS` coordinates. A coordinate takes part once `SEEN` documents of the
sample have it. The learner keeps a rate for each coordinate and an L1 penalty
that leaves few weights, which are broadcast for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import kernels as K
from tracewright.llm import spread

BITS = 22
U64 = np.uint64
#: Labelled documents that a model is fitted on, at most about (chosen by a digest of doc_id).
SAMPLE = 12_000
EPOCHS = 6
SEEN = 3
STEMS = (5, 7)
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.01


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed coordinates of every document's words, stems, pairs and skip pairs, with each one's document."""
    raw, offsets = K.texts(column)
    start, end, first = K.word_spans(raw, offsets, K.NOT_ALNUM)
    words = K.span_hashes(raw, start, end, cased=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts, docs = [words], [doc]
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        parts.append(K.span_hashes(raw, start[long], start[long] + n, cased=False) ^ U64(n))
        docs.append(doc[long])
    for gap, salt in ((1, 0x9E37), (2, 0x85EB)):
        if len(words) > gap:
            inside = doc[gap:] == doc[:-gap]
            parts.append(K.mix(words[:-gap] * U64(3) + words[gap:] * U64(5) + U64(salt))[inside])
            docs.append(doc[gap:][inside])
    return (np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _extract(batches):
    """(doc_id, label, packed distinct coordinates) of labelled documents."""
    for batch in batches:
        data = []
        for part in K.batches(batch):
            x, doc = features(part.column("text"))
            pairs = np.unique(doc * (1 << BITS) + x)
            cuts = np.searchsorted(pairs, np.arange(part.num_rows + 1) * (1 << BITS))
            data += [spread.pack(np.diff(pairs[a:b] - i * (1 << BITS), prepend=0).astype(np.uint32)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], names=["doc_id", "label", "data"])


def fit(examples: list[tuple[int, bytes]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias from (label, packed coordinates), in the order given."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    zb = nb = bias = 0.0
    weigh = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    seen = np.zeros(1 << BITS, np.int32)
    rows = [(label, np.cumsum(spread.unpack(data)[0], dtype=np.int64)) for label, data in examples]
    for _, x in rows:
        seen[x] += 1
    rows = [(label, x[seen[x] >= SEEN].astype(np.int32)) for label, x in rows]
    for _ in range(epochs):
        for label, x in rows:
            zx, nx = z[x], n[x]
            w = weigh(zx, nx)
            g = 1.0 / (1.0 + np.exp(-np.clip(float(w.sum()) + bias, -30, 30))) - label
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
    w = weigh(z, n)
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32), float(bias)


def _fit_group(epochs: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("order").to_pylist(), table.column("label").to_pylist(), table.column("data").to_pylist(), strict=True))
        at, w, bias = fit([(y, x) for _, y, x in rows], epochs)
        return pa.table({"at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from labels (doc_id, label 0/1), where a document has one. Null and repeated labels: null ones are left out, of several the largest counts."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    have = labels.count()
    order = F.abs(F.xxhash64("doc_id", F.lit("ftrl")))
    chosen = labels.where(order < F.lit(min(1.0, sample / max(have, 1)) * 2.0**63))
    examples = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    packed = examples.select("doc_id", "label", "text").mapInArrow(_extract, "doc_id long, label int, data binary")
    rows = packed.select(F.lit(0).alias("one"), F.xxhash64("doc_id", "data").alias("order"), "label", "data")
    got = rows.groupBy("one").applyInArrow(_fit_group(epochs), "at binary, w binary, bias double").first()  # one bounded sample
    return (np.frombuffer(got["at"], np.int32).astype(np.int64), np.frombuffer(got["w"], np.float32), got["bias"]) if got else (np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)


def _score(model):
    def score(batches):
        at, w, bias = model.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = w
        for batch in batches:
            out = []
            for part in K.batches(batch):
                x, doc = features(part.column("text"))
                hit = np.flatnonzero(weights[x])
                pairs = np.unique(doc[hit] * (1 << BITS) + x[hit])
                total = np.bincount(pairs >> BITS, weights=weights[pairs & ((1 << BITS) - 1)], minlength=part.num_rows) + bias
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5); one row a row of docs.

    labels: doc_id, toxic. A document is held out, never learnt from, if crc32
    of its doc_id as text is divisible by 5. Scores see the text only. A null
    text scores as an empty one, by the bias; a null doc_id stays null and isn't
    held out; repeated rows are scored each. Without any label all score 0.5.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    held = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.where(~held).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")), sample)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(shared), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
