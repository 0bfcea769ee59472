"""Mixing sources to target weights by entropy balancing.

Sources (in code point order, null last) have the weights 1, 2, 3, repeating, and share all words
by them; a target stops at ``MOST`` times its source's size, and the excess is shared anew by
weight until no target is above.

Rates. Among all document rates w_i in [0, MOST] that take exactly the target's words from each
source, sum w_i * size_i = target, entropy balancing takes those closest to 1 in relative entropy.
The solution is exponentially tilted, w_i = min(MOST, exp(lambda_s * size_i / mean size)), and
lambda maximises the concave dual (its negative is convex). It is found for all sources at once by
Newton steps, safeguarded by a bracket: each step is one distributed aggregate over the histogram
(source, size, number of documents), which a partial aggregate makes from all documents; a source
that holds a third of all rows is as many rows there as it has different sizes.

Copies. A document's rate is rounded to the whole number below or above. For each source, sizes
go from the largest down, and each size takes that number of upward roundings that brings the
words taken so far nearest to the words due, so what is left over at the end is at most about half
the smallest documents. Which documents of a size are rounded up is decided by the rank of a
keyed hash of the document; sizes with many documents are ranked within hash parts of bounded
size, so no task ranks a whole hot group. The same rows give the same mix in every run.

Defined cases: null texts have size 0 and rate 1; a source of size 0 has target 0; documents of
size 0 take no words; repeated rows (same id and text) are interchangeable; an empty table gives
an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, id_text, map_arrow, materialise, text_bytes

MOST = 3
WEIGHTS = (1, 2, 3)
STEPS = 60
CLOSE = 1e-7
PART = 4096
SEED = "mix"


def _count_words(raw: str, out: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(raw)).to_pylist()
            own = {out: pa.array([len(t.split()) for t in texts], pa.int64()), raw: pa.array([b""] * len(texts), pa.binary())}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def with_size(docs: DataFrame, out: str, text_col: str) -> DataFrame:
    """``docs`` with the number of white space words of the text."""
    (raw,) = fresh(docs, "__raw")
    ready = docs.withColumns({raw: text_bytes(text_col), out: F.lit(0).cast("long")})
    return map_arrow(ready, _count_words(raw, out)).drop(raw)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size). Sharing takes rounds; each is an
    aggregate of two numbers over the sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    ranked = materialise(sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    full = F.lit(False)
    while True:
        capped, n, free = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.count(F.when(full, 1)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == before or not free:
            break
        before, level = n, (total - (capped or 0)) / free
        full = F.col("weight") * level >= F.col("source_size") * most
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * level)
    return materialise(ranked.select("source", "source_size", target.alias("target")), "targets")


def tilts(histogram: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, scale, tilt): lambda for each source, by Newton steps on the dual's gradient."""
    stats = histogram.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = targets.join(stats, targets["source"].eqNullSafe(stats["source"])).select(
        targets["source"], "target", "scale", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), (F.col("target") >= F.col("source_size") * most).alias("done"))
    state = materialise(state, "tilts")
    for _ in range(STEPS):
        s = state.where("not done").withColumnRenamed("source", "s")
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * x))
        words = F.col("n") * F.col("size") * rate
        each = histogram.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("s")))
        sums = each.groupBy("s", "target", "scale", "tilt", "low", "high").agg(
            F.sum(words).alias("got"), F.sum(F.when(rate < most, words * x).otherwise(0.0)).alias("slope"))
        over = F.col("got") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        # a step that leaves the bracket, or has no slope, halves or doubles it instead
        safe = F.when(low.isNull(), F.least(high * 2, high - 1.0)).when(high.isNull(), F.greatest(low * 2, low + 1.0)).otherwise((low + high) / 2)
        inside = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("tilt")) <= 16)
        near = F.abs(F.col("got") - F.col("target")) <= CLOSE * F.col("target")
        moved = sums.select(F.col("s").alias("source"), "target", "scale", F.when(near, F.col("tilt")).when(inside, newton).otherwise(safe).alias("tilt"),
                            low.alias("low"), high.alias("high"), near.alias("done"))
        state = materialise(state.where("done").union(moved), "tilts")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "scale", "tilt")


def _round_up(most: float):
    """Of one source's sizes, how many documents of each size get the upper rounding."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        size, n, rate = (pdf[c].to_numpy() for c in ("size", "n", "rate"))
        low = np.floor(rate)
        due, got, up = 0.0, 0.0, []
        for s, m, w, b in zip(size.tolist(), n.tolist(), rate.tolist(), low.tolist()):
            due += s * m * w
            got += s * m * b
            k = int(min(m if b < most else 0, max(0, round((due - got) / s)))) if s else 0
            got += s * k
            up.append(k)
        return pdf.assign(low=low.astype(int), up=up)

    return run


def _parts_up(dealt: DataFrame) -> DataFrame:
    """(source, size, part, up): a size's upward roundings shared among its hash parts in order."""
    order = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("m").over(order)
    share = lambda k: F.floor(k * F.col("up") / F.col("n"))
    return dealt.withColumn("upto", upto).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("take"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sized`` (row, id, source, size, h; h: the keyed hash) with source_size, target, rate and
    copies."""
    histogram = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    tilt = tilts(histogram, targets, most).withColumnRenamed("source", "s")
    named = targets.select(F.col("source").alias("t"), "source_size", "target")
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("source_size") * most, float(most))
            .otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("scale")))))
    rated = materialise(
        histogram.join(tilt, F.col("source").eqNullSafe(F.col("s")), "left").join(named, F.col("source").eqNullSafe(F.col("t")))
        .select("source", "size", "n", "source_size", "target", rate.alias("rate")), "rates")
    kind = "source string, size long, n long, source_size long, target double, rate double, low long, up long"
    sizes = materialise(rated.groupBy("source").applyInPandas(_round_up(most), kind), "rounded").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "rate", "low", "up")
    whole = sized.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    whole = whole.withColumn("part", F.pmod("h", F.ceil(F.col("n") / F.lit(PART))))
    take = _parts_up(whole.groupBy("source", "size", "n", "up", "part").agg(F.count(F.lit(1)).alias("m")))
    each = whole.join(take, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "row"))
    return each.withColumn("copies", F.col("low") + (rank <= F.col("take")).cast("long")).select(
        "row", "id", "source", "size", "source_size", "target", "rate", "copies")


def keyed_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), id_text(id_col), F.coalesce(col(text_col), F.lit("")))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for each document."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), col(source_col).cast("string").alias("source"),
                       keyed_hash(id_col, text_col).alias("h"), col(text_col).alias("text"))
    sized = materialise(with_size(read, "size", "text").drop("text"), "sizes")
    return plan(sized, weights, most).drop("row")


def mixture(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
            weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes at least once, with a column ``copies`` for how often."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that the columns added clash with none
    by = dict(zip(docs.columns, names))
    renamed = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)])
    table = materialise(with_size(renamed.withColumns({
        "row": F.monotonically_increasing_id(), "h": keyed_hash(by[id_col], by[text_col])}), "size", by[text_col]), "sizes")
    sized = table.select("row", F.col(by[id_col]).alias("id"), F.col(by[source_col]).cast("string").alias("source"), "size", "h")
    taken = plan(sized, weights, most).where("copies > 0").select(F.col("row").alias("r"), "copies")
    out = table.join(taken, F.col("row") == F.col("r"))
    return out.select(*[col(n).alias(c) for c, n in zip(docs.columns, names) if c.lower() != "copies"], "copies")
