"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself.

Rows are documents, columns are 5-word shingles. Documents with equal shingle sets are one class and one
row. Two classes reach the similarity only if they share a column among the first ``n - ceil(t n) + 1`` of
their shingles in any common order, so the product reads those alone; the order puts shingles first that a
count sketch of the whole corpus holds for rare. Columns are dealt in blocks by their hash. In a block the
product of each column gives pairs, which the bounds discard when the sizes, or what either text has from the
column on, leave too little overlap for it to be the first that they share. For the pairs that are left the product goes over all columns, in
``PARTS`` blocks one after the other: a block adds what the two rows share in it to the pair's overlap, and a pair is discarded once its
overlap and the fewer columns that either row has left are less than the similarity asks for.

Only components are asked for, so no column multiplies all its rows at once. In each of ``PIVOT_ROUNDS``
rounds a column pairs its rows with one of them (first that which shares most), and columns whose rows have become one component are done.
The last round pairs the rows of the other columns across components, except with the earlier pivots, so no
possible link is left out, while a group of copies costs as many pairs as it has rows.

Defined results: A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D. A text with one to
four words has one shingle, a null or empty text none and its own id as component. Rows with equal texts
are linked. Words and shingles are compared by 64-bit hashes: two that differ are taken for equal with a chance of about 2^-64.
Ids are whole numbers. Rows that repeat an id are one document. A row without an id has no component and no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import attach, block_count, bloom_filter, connected_components, fresh, maybe_in, stored
from spendweave.llm.kernels import LOWER, chunks, mix, shingles, text_bytes, token_hashes

WORDS = 5
#: Two documents link when 100 * overlap >= PERCENT * union.
PERCENT = 80
#: The sketch counts shingles by the first bits of their hash; its logarithms take 8 MB.
SKETCH_BITS = 22
_SKETCH_PARTS = 16
#: Shingles in a block of columns, about.
BLOCK_SHINGLES = 1 << 19
PIVOT_ROUNDS = 2
#: Pairs of one document that meet in one task; more are dealt over several copies of its text.
PAIRS_PER_COPY = 2000
#: Blocks of columns, by the first bits of their hash, that overlaps are summed over one by one.
PART_BITS = 2
PARTS = 1 << PART_BITS
_EDGES = np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PART_BITS)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, bounds = text_bytes(batch.column(column))
    found, first = shingles(*token_hashes(LOWER[data], bounds), WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(found[a:b])


def _sketch(docs: DataFrame) -> np.ndarray:
    """How often each of ``2**SKETCH_BITS`` hash prefixes occurs in the shingles of all texts, as 1000 * log2(1 + n)."""
    cells, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // _SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(cells, np.int64), []
        for batch in chunks(batches, 1):
            data, bounds = text_bytes(batch.column(1))
            held.append((shingles(*token_hashes(LOWER[data], bounds), WORDS)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            if len(held) >= 16:
                total += np.bincount(np.concatenate(held), minlength=cells)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(_SKETCH_PARTS, dtype=np.int32)),
                pa.array([pa.Codec("zstd").compress(total[k * part:(k + 1) * part].tobytes(), asbytes=True) for k in range(_SKETCH_PARTS)], pa.binary())],
                names=["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(pa.Codec("zstd").decompress(c, 8 * part), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.round(1000 * np.log2(1 + total)).astype(np.uint16).tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros(cells, np.uint16)
    for row in docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[row["part"] * part:(row["part"] + 1) * part] = np.frombuffer(row["counts"], np.uint16)  # _SKETCH_PARTS rows
    return out


def _signatures(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(id, n, signature, columns): the set's size, a 128-bit hash of the set, and the shingles that the product reads."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    id_type = docs.schema[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in chunks(batches, 1):
            sizes, signatures, columns = [], [], []
            for found in _sets(batch, 1):
                n = len(found)
                sizes.append(n)
                if not n:
                    signatures.append(None)
                    columns.append(None)
                    continue
                both = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
                signatures.append(both.tobytes())
                order = np.argsort(counts[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                columns.append(found[order[:n - (PERCENT * n + 99) // 100 + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(columns, pa.binary())],
                names=["id", "n", "signature", "columns"])

    return stored(docs.mapInArrow(rows, f"id {id_type}, n bigint, signature binary, columns binary"), "shingle-sets")


_COLUMNS = "block int, column long, node long, n int, place int, rows long"


def _fits(n1: np.ndarray, n2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose first shared column has places i and j may have enough overlap.

    All shared columns then come from there on. A pair that links passes at its first one, so it may fail at later ones.
    """
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    most = np.minimum(n1 - i, n2 - j)
    return (100 * small >= PERCENT * large) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def _shared_columns(classes: DataFrame, blocks: int) -> DataFrame:
    """Stored (block, column, node, n, place, weight) rows of the columns with several rows; dealt as whole arrays by block.

    A node's weight is the number of rows in its columns: large for a text whose shingles many others have.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [np.frombuffer(c, np.uint64) for c in batch.column("columns").to_pylist()]
            lengths = np.array([len(a) for a in arrays])
            column = np.concatenate(arrays)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lengths)
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), lengths).astype(np.int32)
            place = (np.arange(len(column)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            block = (column % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1)).tolist()
            parts = [[k, *(x[order[a:b]].tobytes() for x in (column, node, n, place))] for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts, strict=True), kinds, strict=True)], names=["block", "column", "node", "n", "place"])

    def multiply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        column, node, n, place = (
            np.concatenate([np.frombuffer(x, kind) for batch in held for x in batch.column(name).to_pylist()])
            for name, kind in (("column", np.uint64), ("node", np.int64), ("n", np.int32), ("place", np.int32)))
        order = np.argsort(column, kind="stable")
        same = np.diff(column[order]) == 0
        edges = np.append(np.flatnonzero(np.concatenate(([True], ~same))), len(order))
        rows = np.empty(len(order), np.int64)
        rows[order] = np.repeat(np.diff(edges), np.diff(edges))
        several = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if len(several):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(several), key[0].as_py(), np.int32)), pa.array(column[several].view(np.int64)),
                pa.array(node[several]), pa.array(n[several]), pa.array(place[several]), pa.array(rows[several])],
                names=["block", "column", "node", "n", "place", "rows"])

    parts = classes.mapInArrow(deal, "block int, column binary, node binary, n binary, place binary")
    columns = stored(parts.groupBy("block").applyInArrow(multiply, _COLUMNS), "shared-columns")
    return stored(columns.join(columns.groupBy("node").agg(F.sum("rows").alias("weight")), "node"), "weighted-columns")


def _pairs(columns: DataFrame, round_: int, last: bool) -> DataFrame:
    """Distinct (a, b) pairs that the bounds allow, of columns that span several components; ``columns`` has ``component``."""

    def first_of(node: np.ndarray, column: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        """Rows in order of column and then of round k's pivots: the heaviest, then by chance."""
        if k == 0:
            return np.lexsort((node, -weight, column))
        return np.lexsort((node, mix(node.view(np.uint64) + np.uint64(977 * (k + 1))), column))

    def multiply(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows])
        column, node, n, place, component, weight = (held.column(c).to_numpy() for c in ("column", "node", "n", "place", "component", "weight"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.argsort(column, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(column[order]) != 0)))
        low, high = np.minimum.reduceat(component[order], starts), np.maximum.reduceat(component[order], starts)
        open_ = np.empty(len(order), bool)
        open_[order] = np.repeat(low != high, np.diff(np.append(starts, len(order))))
        column, node, n, place, component, weight = (x[open_] for x in (column, node, n, place, component, weight))
        if not len(column):
            return
        pivots = []
        for k in range(PIVOT_ROUNDS if last else round_ + 1):
            order = first_of(node, column, weight, k)
            starts = np.flatnonzero(np.concatenate(([True], np.diff(column[order]) != 0)))
            pivot = np.empty(len(order), np.int64)
            pivot[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
            pivots.append(pivot)
        found = []
        if not last:
            i, j = np.arange(len(column)), pivots[-1]
            ok = (component[i] != component[j]) & _fits(n[i], n[j], place[i], place[j])
            found.append(np.stack([node[i[ok]], node[j[ok]]]))
        else:
            order = np.lexsort((n, column))
            starts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(column[order]) != 0))), len(order))
            used = np.zeros(len(column), bool)
            for pivot in pivots:
                used |= pivot == np.arange(len(column))
            size = 0
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                rows = order[a:b]
                rows = rows[~used[rows]]
                for k in range(len(rows) - 1):
                    i = rows[k]
                    j = rows[k + 1:k + 1 + int(np.searchsorted(n[rows[k + 1:]], n[i] * 100 // PERCENT, side="right"))]
                    j = j[(component[j] != component[i]) & _fits(n[j], n[i], place[j], place[i])]
                    if len(j):
                        found.append(np.stack([np.full(len(j), node[i]), node[j]]))
                        size += len(j)
                        if size > 1 << 20:
                            yield distinct(found)
                            found, size = [], 0
        if found:
            yield distinct(found)

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        both = np.unique(np.sort(both, axis=0), axis=1) if both.shape[1] else both
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return columns.groupBy("block").applyInArrow(multiply, "a long, b long").where("a <> b").distinct()


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """What two rows (sorted columns) share, summed over the blocks of columns; 0 once it cannot reach the similarity any more."""
    need = PERCENT * (len(x) + len(y))
    at_x, at_y = np.searchsorted(x, _EDGES).tolist(), np.searchsorted(y, _EDGES).tolist()
    total = i = j = 0
    for p, q in zip([*at_x, len(x)], [*at_y, len(y)], strict=True):
        total += len(np.intersect1d(x[i:p], y[j:q], assume_unique=True))
        i, j = p, q
        if (100 + PERCENT) * (total + min(len(x) - i, len(y) - j)) < need:
            return 0
    return total


def overlaps(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of the pairs (a, b) that reach the similarity. Rows that repeat id and text must be one.

    The rows of the matrix travel as the texts that they come from, which compress; a text is cut into columns once for all its pairs.
    """
    hashed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.xxhash64("id").alias("h"))
    blocks = block_count(2 * pairs.count())
    wanted = bloom_filter(hashed, "h", blocks)
    texts = maybe_in(docs.withColumn("_h", F.xxhash64("id")), "_h", wanted, blocks, "_wanted").where("_wanted").select("id", "text")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies"))
    left = texts.join(copies, texts["id"] == copies["a"]).select("a", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("text_a"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    both = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(dealt, "b").join(left.drop("copies"), ["a", "copy"]).select("a", "b", "text_a", "text_b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2):
            found = []
            for part in chunks([batch], 3):
                earlier, own = None, None
                for text, other in zip(part.column(2).to_pylist(), _sets(part, 3), strict=True):
                    if text != earlier:
                        earlier, own = text, next(_sets(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["t"]), 0))
                    found.append((len(own), len(other), _overlap(own, other)))
            sizes = [pa.array(x, pa.int32()) for x in zip(*found, strict=True)]
            keep = pa.array([overlap > 0 for *_, overlap in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), batch.column(1), *sizes)], names=["a", "b", "n_a", "n_b", "overlap"])

    return stored(both.mapInArrow(multiply, "a long, b long, n_a int, n_b int, overlap int"), "overlaps")


def _class_components(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that are linked with others, or None."""
    shingles_read = classes.agg(F.sum(F.octet_length("columns")) / 8).first()[0] or 0
    columns = _shared_columns(classes, max(64, math.ceil(shingles_read / BLOCK_SHINGLES)))
    links = components = None
    for k in range(PIVOT_ROUNDS + 1):
        if components is None:
            state = columns.withColumn("component", F.col("node"))
        else:
            state = columns.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = stored(_pairs(state, k, k == PIVOT_ROUNDS), "pairs")
        if pairs.isEmpty():
            continue  # no row fits its column's pivot, which says nothing of rows other than pivots
        new = overlaps(pairs, docs).select("a", "b")
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            components = stored(connected_components(links), "components")
    return components


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = docs if docs.groupBy("id").count().where("count > 1 AND id IS NOT NULL").isEmpty() else docs.dropDuplicates(["id", "text"])
    sets = _signatures(docs, _sketch(docs))
    total = sets.count()
    classes = stored(
        sets.where("n > 0 AND id IS NOT NULL").groupBy("signature").agg(
            F.min(F.struct("id", "n", "columns")).alias("c"), F.count(F.lit(1)).alias("size"))
        .select("signature", "size", F.col("c.id").alias("node"), F.col("c.n").cast("int").alias("n"), "c.columns"), "classes")
    components = _class_components(classes.select("node", "n", "columns"), once)
    groups = classes.select("signature", "size", "node")
    if components is None:
        groups = groups.withColumn("component", F.col("node"))
    else:
        groups = groups.join(components.dropDuplicates(["node"]), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = stored(groups.select("signature", "size", "component"), "class-components")
    rows = sets.select("id", "n", F.when(F.col("id").isNotNull(), F.col("signature")).alias("signature"))
    return attach(rows, groups, "signature", "size", total).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest id, with the columns of ``docs``.

    Rows without a link pass straight through; the ids to drop meet the rows by a Bloom filter first.
    """
    found = jaccard_components(docs, id_col, text_col)
    drop, hashed, flag = fresh(docs, "_drop"), fresh(docs, "_hash"), fresh(docs, "_maybe")
    own = F.col(id_col).cast("long")
    dropped = stored(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(drop)).distinct(), "near-copies")
    blocks = block_count(dropped.count())
    bloom = bloom_filter(dropped.select(F.xxhash64(drop).alias(hashed)), hashed, blocks)
    flagged = maybe_in(docs.withColumn(hashed, F.xxhash64(own)), hashed, bloom, blocks, flag)
    tested = flagged.where(F.col(flag)).join(dropped, own == F.col(drop), "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(tested.select(*docs.columns))
