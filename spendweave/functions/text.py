"""Text retrieval: chunks of documents, their ids, nearest vectors and overlap removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.operators.ranking import top_per_group

# Chunk size and overlap in characters, and the distance beyond which nothing is relevant.
CHUNK_CHARS = 800
OVERLAP_CHARS = 100
MAX_DISTANCE = 1.2
EXTRA_CANDIDATES = 3
SHARED_WORDS = 0.5


# White space as Python's strip() sees it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def heading(line: Column) -> Column:
    """The title of a level 2 or 3 heading; NULL for other lines."""
    bare = F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", "")
    title = F.regexp_replace(F.regexp_replace(bare, "^#+", ""), f"^{BLANK}+", "")
    return F.when(F.contains(line, F.lit("## ")), F.when(bare.rlike("^###? "), title))


def chunk_spans(sizes: Column, headings: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Array of (first line, end line, section) of the chunks of a document, given the lengths and headings of its lines.

    A chunk is a run of whole lines of at most ``size`` characters, unless one line is longer. It
    starts with those trailing lines of the chunk before it that together fit in ``overlap``. Its
    section is the newest level 2 or 3 heading up to and including the line that closed it.

    A fold over the lines; its state is the open chunk's first line, length and section, and the closed chunks. The arguments
    should be columns, not expressions, as the fold looks into them at every line.
    """
    span = "struct<first:int,end:int,section:string>"

    def tail(state: Column, here: Column) -> Column:
        """How many of the lines before ``here`` begin the next chunk, and their length."""
        back = F.reverse(F.slice(sizes, state["first"] + 1, here - state["first"]))
        start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("held"), F.lit(True).alias("open"))

        def step(kept: Column, n: Column) -> Column:
            fits = kept["open"] & (kept["held"] + n <= overlap)
            more = F.struct((kept["lines"] + 1).alias("lines"), (kept["held"] + n).alias("held"), F.lit(True).alias("open"))
            return F.when(fits, more).otherwise(F.struct(kept["lines"].alias("lines"), kept["held"].alias("held"), F.lit(False).alias("open")))

        return F.aggregate(back, start, step)

    def closed(state: Column, end: Column, newest: Column) -> Column:
        one = F.struct(state["first"].alias("first"), end.alias("end"), newest.alias("section"))
        return F.concat(state["done"], F.array(one))

    def step(state: Column, here: Column) -> Column:
        n = F.get(sizes, here)
        newest = F.coalesce(F.get(headings, here), state["section"])
        full = (here > state["first"]) & (state["held"] + n > size)
        opened = F.transform(F.array(tail(state, here)), lambda kept: F.struct(
            (here - kept["lines"]).alias("first"), (kept["held"] + n).alias("held"), newest.alias("section"), closed(state, here, newest).alias("done")))
        longer = F.struct(state["first"].alias("first"), (state["held"] + n).alias("held"), newest.alias("section"), state["done"].alias("done"))
        return F.when(full, F.get(opened, F.lit(0))).otherwise(longer)

    empty = F.array().cast(f"array<{span}>")
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("held"), F.lit("").alias("section"), empty.alias("done"))
    return F.aggregate(
        F.sequence(F.lit(0), F.size(sizes) - 1), start, step, lambda state: closed(state, F.size(sizes), state["section"]))


def chunk_docs(docs: DataFrame) -> DataFrame:
    """Chunks of every non-blank document (columns source, text), numbered in reading order.

    Documents are independent, so there is no shuffle; the lines are split once and folded in the JVM.
    """
    # Blank as Python's strip() sees it: any Unicode white space.
    written = docs.where(F.col("text").rlike(r"(?U)\S")).select("source", F.split("text", "\n").alias("_lines"))
    lines = written.select("source", "_lines", F.transform("_lines", F.length).alias("_sizes"), F.transform("_lines", heading).alias("_headings"))
    spans = lines.select("source", "_lines", F.posexplode(chunk_spans(F.col("_sizes"), F.col("_headings"))).alias("chunk_no", "_span"))
    body = F.array_join(F.slice("_lines", F.col("_span.first") + 1, F.col("_span.end") - F.col("_span.first")), "\n")
    return spans.select("source", "chunk_no", F.col("_span.section").alias("section"), body.alias("text"))


def chunk_id(source: Column, section: Column, text: Column) -> Column:
    """Id that depends on content only."""
    return F.substring(F.sha2(F.concat_ws(":", source, section, text), 256), 1, 16)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("section"), F.col("text")))


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(
    vectors: DataFrame, queries: Column, key: str, embedding: str, n: int = 5, max_distance: float = MAX_DISTANCE
) -> DataFrame:
    """Nearest ``n + 3`` vectors of each query, those beyond the distance limit dropped.

    ``queries`` is a short array of (query_id, vector) structs, a request parameter. The vectors are
    scanned once, and each task keeps only its nearest rows before the shuffle.
    """
    spread = vectors.withColumn("_q", F.explode(queries))
    scored = spread.select(
        F.col("_q.query_id").alias("query_id"), *vectors.columns,
        cosine_distance(F.col(embedding), F.col("_q.vector")).alias("distance"),
    )
    return top_per_group(scored, ["query_id"], [F.col("distance"), F.col(key)], n + EXTRA_CANDIDATES).where(
        F.col("distance") <= max_distance
    )


def dedupe_overlap(candidates: DataFrame, n: int = 5) -> DataFrame:
    """Keeps at most ``n`` candidates per query, nearest first, dropping those that repeat a kept one.

    A candidate repeats another when they share more than half the words of the smaller. Candidates
    come from :func:`vector_topk`, so a query has at most ``n + 3`` of them.
    """
    rest = [c for c in candidates.columns if c not in ("query_id", "rank")]
    words = F.filter(F.array_distinct(F.split("text", r"(?U)\s+")), lambda w: w != "")
    row = F.struct(F.col("rank"), words.alias("words"), F.struct(*rest).alias("row"))
    ordered = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    element = candidates.select(row.alias("e")).schema["e"].dataType.simpleString()

    def repeats(kept: Column, c: Column) -> Column:
        def shared(k: Column) -> Column:
            smaller = F.least(F.size(k["words"]), F.size(c["words"]))
            common = F.size(F.array_intersect(k["words"], c["words"]))
            return (smaller > 0) & (common > smaller * F.lit(SHARED_WORDS))

        return F.exists(kept, shared)

    kept = F.aggregate(
        F.col("c"),
        F.array().cast(f"array<{element}>"),
        lambda acc, c: F.when((F.size(acc) >= n) | repeats(acc, c), acc).otherwise(F.concat(acc, F.array(c))),
    )
    return ordered.select("query_id", F.explode(kept).alias("k")).select("query_id", F.col("k.rank").alias("rank"), "k.row.*")
