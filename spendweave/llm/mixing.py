"""Mixing sources to target weights by entropy balancing.

Sources in order of code point (null last) have the weights in turn and share all words; a target stops at
``MOST_COPIES`` times its source's words, and what is above goes to the others by weight until none is
above. A document's rate is what changes the plain mix least (in relative entropy) while its source's words
meet the target: ``exp(dual * size)``, at most ``MOST_COPIES``. The convex dual has one number for each
source; distributed Newton steps solve all sources at once on the counts of documents by source and size,
kept inside a bracket so that each step that leaves it becomes a bisection.

Rates become copies by cell: documents of one source and size have one rate, and a running sum over the
sizes, largest first, gives each cell a whole number of additional copies, so a source misses its target by
about one document. Within a cell the documents with the smallest hash of the id get them. Cells with many
rows are cut by hash first, so no key is large. Sums of the steps are decimals: reruns agree.

Defined results: a null text has size 0; such rows take no words and are kept once. Rows that repeat an id
are separate rows. A table without words has targets of 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.llm.common import HOT_SHARE, fresh, stored
from spendweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Newton stops when every source's words are so near the target, relatively, or after so many steps.
TOLERANCE = 1e-9
MOST_STEPS = 60
#: Rows of a cell beyond which it is cut by hash.
CELL_ROWS = 5000


def source_targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n)."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # sources meet their limit in order of limit over weight; the others share what is left by weight
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(float(most)) * F.col("source_size")
    left = F.sum("source_size").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = sources.withColumn("level", left / F.sum("weight").over(after)).withColumn("limit", limit)
    level = level.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    free = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy(F.lit(1)))
    return level.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def solve_duals(cells: DataFrame, targets: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """(source, unit, dual): rates are ``least(most, exp(dual * size / unit))``; unit is the source's mean size."""
    used = cells.where("size > 0")
    state = used.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"), F.min("size").alias("smallest"))
    high = math.log(most) * F.col("unit") / F.col("smallest")  # from here on every document is taken ``most`` times
    full = F.col("target") >= (1 - 1e-12) * most * F.col("source_size")
    state = cut_lineage(state.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), "unit", "target", F.when(full, high).otherwise(0.0).alias("dual"), F.lit(None).cast("double").alias("low"),
        high.alias("high"), full.alias("done")))
    kept = ["_source", "unit", "target", "dual", "low", "high", "done"]
    for _ in range(MOST_STEPS):
        both = used.join(state, F.col("source").eqNullSafe(F.col("_source")))
        raw = F.exp(F.least(F.col("dual") * F.col("size") / F.col("unit"), F.lit(700.0)))
        words = F.col("size") * F.col("n") * F.least(raw, F.lit(float(most)))
        slope = F.when(raw < most, words * F.col("size") / F.col("unit")).otherwise(0.0)
        # finished sources go along in the same aggregate: a union would add its partitions to the state at every step
        sums = both.groupBy(*kept).agg(*[
            F.sum(F.when(~F.col("done"), value.cast("decimal(38,9)"))).cast("double").alias(name) for name, value in (("words", words), ("slope", slope))])
        near = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("dual"))
        high = F.when(over, F.col("dual")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("dual") - F.col("words") / F.col("slope") * F.ln(F.col("words") / F.col("target")))
        middle = F.when(low.isNull(), high * 2 - 1.0).otherwise((low + high) / 2)
        inside = step.isNotNull() & (F.coalesce(step > low, F.lit(True))) & (step < high)
        flat = (high - F.coalesce(low, F.lit(-1e9))) <= 1e-13
        moved = {"dual": F.when(near | flat, F.col("dual")).when(inside, step).otherwise(middle), "low": low, "high": high, "done": near | flat}
        state = cut_lineage(sums.select("_source", "unit", "target", *[
            F.when(F.col("done"), F.col(c)).otherwise(value).alias(c) for c, value in moved.items()]))
        if state.where("not done").isEmpty():
            break
    return state.select(F.col("_source").alias("source"), "unit", "dual")


def _round_cells(cells: DataFrame, most: int) -> DataFrame:
    """(source, size, slot, source_size, target, base, extra): copies of all rows of a cell, and how many rows get one more."""

    def carry(cells: pa.Table) -> pa.Table:
        table = cells.sort_by([("size", "descending"), ("slot", "ascending")])
        rate, n, size = (table.column(c).to_pylist() for c in ("rate", "n", "size"))
        base, extra, missing = [], [], 0.0  # words still missing from the target
        for r, k, s in zip(rate, n, size, strict=True):
            whole = min(most, int(r))
            missing += (r - whole) * k * s
            more = 0 if not s or whole >= most else max(0, min(k, math.floor(missing / s + 0.5)))
            missing -= more * s
            base.append(whole)
            extra.append(more)
        return table.select(["source", "size", "slot", "source_size", "target"]).append_column("base", pa.array(base, pa.int32())).append_column("extra", pa.array(extra, pa.int64()))

    source = cells.schema["source"].dataType.simpleString()
    # a source's cells are as many as it has different sizes and cut cells, not as it has rows
    return cells.groupBy("source").applyInArrow(
        carry, f"source {source}, size bigint, slot int, source_size bigint, target double, base int, extra bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h")), "mix-rows")
    counts = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(CELL_ROWS, math.ceil(total / (10 * HOT_SHARE)))  # so at most 10 * HOT_SHARE cells are cut
    large = F.broadcast(counts.where(F.col("n") >= least).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.ceil(F.col("n") / least).cast("int").alias("slots")))
    slotted = rows.join(large, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left").select(
        "id", "source", "size", "h", F.coalesce(F.pmod(F.xxhash64("h"), F.col("slots")), F.lit(0)).cast("int").alias("slot"))
    targets = stored(source_targets(counts, weights, most), "mix-targets")
    duals = solve_duals(counts, targets, most)
    shares = targets.withColumnRenamed("source", "_source").join(
        duals, F.col("_source").eqNullSafe(F.col("source")), "left").select("_source", "source_size", "target", "unit", "dual")
    cells = slotted.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("dual") * F.col("size") / F.col("unit"), F.lit(700.0)))))
    rated = cells.join(shares, F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "slot", "n", "source_size", "target", rate.alias("rate"))
    rounded = _round_cells(rated, most)
    rank = Window.partitionBy("source", "size", "slot").orderBy("h", "id")
    placed = slotted.withColumn("rank", F.row_number().over(rank)).alias("r").join(
        rounded.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")) & (F.col("r.slot") == F.col("c.slot")))
    copies = F.when(F.col("r.size") == 0, F.lit(1)).otherwise(F.col("base") + (F.col("rank") <= F.col("extra")).cast("int"))
    # the source's figures come with the cell: a join of all rows by source would gather a hot one
    return placed.select(
        F.col("r.id").alias(id_col), F.col("r.size").alias("size"), "c.source_size", "c.target", copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, with their columns. Rows that repeat an id count alike."""
    key, copies, copy = fresh(docs, "_key"), fresh(docs, "_copies"), fresh(docs, "_copy")
    found = mix(docs, id_col, text_col, source_col, **options).where("copies <> 1")
    changed = found.groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(copies))
    placed = docs.join(changed, F.col(id_col).eqNullSafe(F.col(key)), "left").withColumn(copies, F.coalesce(F.col(copies), F.lit(1)))
    return placed.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
