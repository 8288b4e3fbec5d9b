"""What filters remove in any order of applying them: relations of failing ids, joined left-anti and left-semi.

One pass over the texts writes a narrow row for each document and one table of failing row ids per filter. The
survivors of a set of filters are the rows left-anti its tables. All sets are computed together: for each
filter in turn a row goes on with and without it, and only the former takes part in the left-anti join. So every
join is on the row id, along which the rows are dealt out once. What filter f removes after a set of others are
the rows left-semi its own table, taken left-anti the others in the same way; what is redundant are its other failing rows.
An order of the filters only looks up the set before each step, so results are per set (2^k of them) until the
small table of counts meets the orders.

Defined results: a null text counts as empty (no words: it fails A and, with a smaller row of the same text, E); a null
source as the empty string. Texts are identical if their SHA-256 is. A null id is not larger than any id, nor
smaller; rows that share an id are rows of their own, each counted. Labels are looked up by id; of several
labels of one id any 1 counts, and null ids have none. Extra columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import attach, stored
from spendweave.session import new_dir

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD, MARKS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    size = F.length(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (size - F.length(F.translate(text, UPPER, ""))) > 2 * size,
        "D": text.rlike(MARKS),
    }


def failing_ids(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents as (row, part, good, toxic) and for each filter its table of failing rows (row)."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    alone = F.array(*[F.when(fails, F.lit(name)) for name, fails in text_failures(F.col("text")).items()])
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stored(read.select(
        F.monotonically_increasing_id().alias("row"), "id", "part", F.array_compact(alone).alias("fails"), F.unhex(F.sha2("text", 256)).alias("sha")), "audit-rows")

    groups = rows.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = stored(groups, "audit-copies")
    copies = attach(rows.select("row", "id", "sha"), groups, "sha", "size", rows.count()).where("id > least")

    path = new_dir(spark, "audit-failing")
    failing = rows.select(F.explode("fails").alias("filter"), "row").unionByName(copies.select(F.lit("E").alias("filter"), "row"))
    failing.write.partitionBy("filter").option("compression", "zstd").parquet(path)
    tables = spark.read.schema("row long, filter string").parquet(path)

    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    base = rows.select("row", "id", "part").join(marks, "id", "left").select(
        "row", "part", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    return stored(base, "audit-base"), {name: tables.where(F.col("filter") == name).select("row") for name in FILTERS}


def _after(rows: DataFrame, tables: dict[str, DataFrame], names: str) -> DataFrame:
    """``rows`` once for every set of the named filters that they survive, with the set as ``before``."""
    rows = rows.withColumn("before", F.lit(0))
    for name in names:
        rows = rows.withColumn("used", F.explode(F.array(F.lit(False), F.lit(True))))
        fails = tables[name].withColumnRenamed("row", "failed")
        rows = rows.join(fails, (F.col("row") == F.col("failed")) & F.col("used"), "left_anti")
        rows = rows.withColumn("before", F.col("before") + F.when(F.col("used"), 1 << FILTERS.index(name)).otherwise(0)).drop("used")
    return rows


def set_counts(base: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, before, n, good, toxic): rows that a filter removes after the set ``before``; without a filter, rows that survive the set."""
    def counted(rows: DataFrame, name: str | None) -> DataFrame:
        return rows.groupBy("part", "before").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select(
            "part", F.lit(name).cast("string").alias("filter"), "before", "n", "good", "toxic")

    out = counted(_after(base, tables, FILTERS), None)
    for name in FILTERS:
        failing = base.join(tables[name], "row", "left_semi")
        out = out.unionByName(counted(_after(failing, tables, FILTERS.replace(name, "")), name))
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step, with the counts of ``COUNTS``."""
    spark = docs.sparkSession
    base, tables = failing_ids(docs, labels, id_col, text_col, part_col)
    counts = stored(set_counts(base, tables), "audit-counts")

    all_used = (1 << len(FILTERS)) - 1
    others = {name: all_used - (1 << k) for k, name in enumerate(FILTERS)}
    key = F.concat_ws(":", "filter", "before")
    weight = F.create_map(*[F.lit(x) for k in range(1 << len(FILTERS)) for x in (k, factorial(k.bit_count()) * factorial(max(0, len(FILTERS) - 1 - k.bit_count())))])
    # at most 32 + 80 entries a part
    parts = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct("n", "good", "toxic")))).alias("sets"),
        *[F.sum(F.when(F.col("filter") == name, F.col("n") * weight[F.col("before")]).otherwise(0)).alias(f"shapley_{name}") for name in FILTERS])

    steps = [("".join(order), k + 1, order[k], sum(1 << FILTERS.index(f) for f in order[:k])) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, name string, before int"))  # 600 rows
    named = parts.select("part", "sets", F.explode(F.create_map(*[x for name in FILTERS for x in (F.lit(name), F.col(f"shapley_{name}"))])).alias("name", "shapley"))
    rows = named.join(steps, "name")

    def at(name: Column, before: Column, field: str) -> Column:
        return F.coalesce(F.col("sets")[F.concat_ws(":", name, before)][field], F.lit(0))

    nth = F.create_map(*[F.lit(x) for k, name in enumerate(FILTERS) for x in (name, 1 << k)])
    rest = F.create_map(*[F.lit(x) for name in FILTERS for x in (name, others[name])])
    name, before = F.col("name"), F.col("before")
    removed = at(name, before, "n")
    return rows.select(
        "part", "filter_order", "step", at(F.lit(None).cast("string"), before + nth[name], "n").alias("kept"), removed.alias("removed"),
        (at(name, F.lit(0), "n") - removed).alias("redundant"), at(name, rest[name], "n").alias("unique_fails"),
        at(name, before, "good").alias("good_lost"), at(name, before, "toxic").alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"))
