"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded digest and repeated up to
`repeats` times. A copy's virtual finish time is its source's words up to and
including it, divided by the source's target; all copies are range-sorted by it
and the mix is truncated at the total budget. Running sums are global prefix
sums over range-partitioned rows, so a source that holds a third of all rows
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import spread
from tracewright.llm.kernels import NULL_ID

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, before (words of earlier sources), rank, target for rows (source, size).

    Sources by code point, null last, take the weights in turn. The targets add
    up to share times all sizes (as far as the caps allow); a target stops at
    repeats times its source's size, and the excess goes to the others by
    weight until none is above.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("source").asc_nulls_last()]
    ranked = spread.running(totals, order, "one", "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = spread.running(ranked, order, "source_size", "upto").withColumn("before", F.col("upto") - F.col("source_size"))
    ranked = spread.cut(ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats))))
    total = float(ranked.agg(F.sum("source_size").alias("t")).first()["t"] or 0) * share
    level, capped = 0.0, -1
    while True:  # two sums a round; the level only rises
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"), F.count_if(full).alias("n")).first()
        if r["n"] == capped or not r["weights"]:
            break
        capped, level = r["n"], (total - r["caps"]) / r["weights"]
    full = F.col("cap") <= F.col("weight") * F.lit(level)
    return ranked.select("source", "source_size", "before", "rank", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def words_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """A mix of documents (doc_id, source, text): one row a row of docs.

    doc_id, size (words), source_size, target (of its source), taken (words the
    mix takes, size times the copies taken), copies (an empty text is taken
    once), and the columns of docs named by carry. Whole documents only: a source's taken words differ
    from its target by at most about one document. A null text has size 0, a
    null source is a source that sorts last, null doc_ids stay null and repeated
    rows are documents of their own; ties of the digest go by doc_id. Reruns
    agree. An empty table gives no rows.
    """
    spark = docs.sparkSession
    spread.ready(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), *carry)
    rows = spread.cut(rows)
    targets = spread.cut(source_targets(rows.select("source", "size"), weights, share, repeats))
    total = min(share, repeats) * float(targets.agg(F.sum("source_size").alias("t")).first()["t"] or 0)  # what the targets add up to, without their rounding
    joined = rows.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    joined = joined.withColumn("dice", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    queued = spread.running(joined, ["rank", "dice", "doc_id", "size"], "size").withColumn("row", F.monotonically_increasing_id())
    queued = spread.cut(queued.withColumn("own", F.col("upto") - F.col("before")).drop("upto", "before"))
    copy = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    copies = queued.where("target > 0 and size > 0").select("row", "rank", "size", "target", "source_size", "own", copy.alias("copy"))
    copies = copies.select("row", "rank", "size", ((F.col("copy") * F.col("source_size") + F.col("own")) / F.col("target")).alias("finish"))
    copies = copies.where(F.col("finish") < 2.0)  # every source reaches its target at 1; past twice that the budget is long spent
    sent = spread.running(copies.select("row", "rank", "size", "finish"), ["finish", "rank", "row"], "size", "spent").where(F.col("spent") <= F.lit(total))
    taken = sent.groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    out = queued.join(taken, "row", "left")
    return out.select(
        spread.given(F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(F.lit(1)).cast("int").alias("copies"), *carry,
    )
