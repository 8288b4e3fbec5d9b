"""Embedding near-duplicates by PCA-ordered tiles, exact at a cosine threshold.

Vectors are scaled to length one and turned to the axes of their second moments, largest first. Rows go in
order of the first axis into tiles of a few thousand. Pairs of tiles whose boxes are farther apart than the
threshold allows are not compared. Tiles travel in groups: a task compares the pairs of two groups of tiles, so a tile is sent once for each group
that it has partners in, not for each partner. In a pair the products of the leading dimensions are accumulated some at
a time; what the rest can add is at most the product of the suffix norms, and pairs of rows that can no
longer reach the threshold stop. What is left is decided by the cosine of the original vectors in double
precision. Equal vectors are one row of a tile. A tile pair returns each row's links as a number and the
edges of a spanning forest, not all its links, so dense groups cost as many rows as they have vectors.

Defined results: a vector that is null, zero or has a null or non-finite component has no links and is its
own component. Ids are whole numbers. Vectors of different lengths are not compared. Rows that repeat an id and vector are separate
rows that link. A null id with links gets the component of its vector, else null. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendweave.llm.common import attach, connected_components, stored

THRESHOLD = 0.95
TILE_ROWS = 2048
#: Bins of the first axis, whose values lie in -1..1.
BINS = 4096
#: Dimensions accumulated between two tests of the bound.
STEP = 16
#: Bytes of vectors in a group of tiles; a task holds two groups.
GROUP_BYTES = 16 << 20
#: Room for rounding in bounds; pairs within it are decided by the exact cosine.
SLACK = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Stored (id, key, dim, data) rows: the vector as doubles, and a key equal for equal vectors; null if it cannot link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, dims = [], []
            for row in batch.column(1):
                values = None if not row.is_valid else row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if values is None or row.values.null_count or not len(values) or not np.isfinite(values).all() or not values.any():
                    data.append(None)
                    dims.append(None)
                else:
                    data.append((values + 0.0).tobytes())  # -0.0 is 0.0
                    dims.append(len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "dim", "data"])

    rows = vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(read, "id long, dim int, data binary")
    return stored(rows.withColumn("key", F.sha2("data", 256)), "vectors")


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes of the second moments, largest first: dim * dim sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                unit = _unit(_matrix(batch.column(1).filter(pa.array(dims == dim)), dim))
                sums[dim] = sums.get(dim, 0) + unit.T @ unit
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["dim", "axis", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.column("row").to_pylist())  # the same sum in any order of arrival
        total = np.sum([np.frombuffer(r) for r in rows], axis=0).tobytes()
        return pa.table({"dim": table.column("dim")[:1], "axis": table.column("axis")[:1], "row": pa.array([total], pa.binary())})

    schema = "dim int, axis int, row binary"
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in classes.select("dim", "data").mapInArrow(moments, schema).groupBy("dim", "axis").applyInArrow(add, schema).collect():
        found.setdefault(r["dim"], {})[r["axis"]] = np.frombuffer(r["row"])
    return {dim: np.linalg.eigh(np.stack([rows[k] for k in range(dim)]))[1][:, ::-1] for dim, rows in found.items()}


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], tile_rows: int, group_bytes: int) -> DataFrame:
    """Stored (tile, group, dim, nodes, sizes, data, low, high): rows in order of the first axis, and their box on all axes."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            bins = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                same = dims == dim
                at = _unit(_matrix(batch.column("data").filter(pa.array(same)), dim)) @ shared.value[dim][:, 0]
                bins[same] = np.clip(np.floor((np.round(at, 9) + 1) * BINS / 2), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins)], names=[*batch.schema.names, "bin"])

    placed = stored(classes.mapInArrow(first_axis, "node long, size long, dim int, data binary, bin int"), "vector-bins")
    # at most BINS rows for each vector length; a bin with more rows than a tile is cut by hash
    bins = placed.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("dim", "bin", F.floor(F.coalesce(before, F.lit(0)) / tile_rows).cast("int").alias("first"), F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiled = placed.join(F.broadcast(bins), ["dim", "bin"]).withColumn("part", F.when(F.col("parts") > 1, part + 1).otherwise(0))

    def to_tile(table: pa.Table) -> pa.Table:
        order = table.sort_by([("bin", "ascending"), ("node", "ascending")]).combine_chunks()
        dim = order.column("dim")[0].as_py()
        raw = _matrix(order.column("data"), dim)
        turned = _unit(raw) @ shared.value[dim]
        return pa.table({
            "dim": order.column("dim")[:1], "nodes": pa.array([order.column("node").to_numpy().tobytes()], pa.binary()),
            "sizes": pa.array([order.column("size").to_numpy().tobytes()], pa.binary()), "data": pa.array([raw.tobytes()], pa.binary()),
            "low": pa.array([turned.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([turned.max(axis=0)], pa.list_(pa.float64())), "group": order.column("group")[:1]})

    # tiles that follow each other, or parts of one bin, are a group
    each = {dim: max(1, group_bytes // (8 * dim * tile_rows)) for dim in axes}
    size = F.create_map(*[F.lit(x) for item in each.items() for x in item])[F.col("dim")]
    tiled = tiled.withColumn("group", F.xxhash64("dim", F.floor(F.col("first") / size), F.floor(F.col("part") / size)))
    tiles = tiled.groupBy("dim", "first", "part", "group").applyInArrow(
        to_tile, "dim int, nodes binary, sizes binary, data binary, low array<double>, high array<double>, group long")
    tiles = tiles.withColumn("tile", F.xxhash64("nodes"))
    return stored(tiles, "vector-tiles")


def _compare(a: dict, b: dict, same: bool, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the linked pairs of two tiles; j > i if they are the same."""
    dim = a["dim"]
    raw_a, raw_b = (np.frombuffer(t["data"], "<f8").reshape(-1, dim) for t in (a, b))
    x, y = _unit(raw_a) @ turn, _unit(raw_b) @ turn
    left_x, left_y = (np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in (x, y))
    lead = min(STEP, dim)
    i, j = [], []
    for k in range(0, len(x), 256):
        part = x[k:k + 256, :lead] @ y[:, :lead].T
        if lead < dim:
            part += np.outer(left_x[k:k + 256, lead], left_y[:, lead])
        r, c = np.nonzero(part >= threshold - SLACK)
        i.append(r + k)
        j.append(c)
    i, j = np.concatenate(i), np.concatenate(j)
    if same:
        i, j = i[j > i], j[j > i]
    dots = np.zeros(len(i))
    for d in range(0, dim, STEP):  # leading dimensions again for the few pairs left, then the next ones
        end = min(d + STEP, dim)
        dots += np.einsum("nd,nd->n", x[i, d:end], y[j, d:end])
        rest = left_x[i, end] * left_y[j, end] if end < dim else 0.0
        keep = dots + rest >= threshold - SLACK
        i, j, dots = i[keep], j[keep], dots[keep]
    keep = dots >= threshold + SLACK
    close = np.flatnonzero(~keep)
    if len(close):  # near the threshold the plain formula on the original vectors decides
        p, q = raw_a[i[close]], raw_b[j[close]]
        keep[close] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= threshold
    return i[keep], j[keep]


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for p, q in zip(u.tolist(), v.tolist(), strict=True):
        rp, rq = find(p), find(q)
        if rp != rq:
            root[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return out


def _tile_links(tiles: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Stored (node, links, a, b): numbers of linked vectors in other classes, and edges of forests."""
    shared = tiles.sparkSession.sparkContext.broadcast(axes)
    reach = (2 - 2 * threshold) ** 0.5 + 1e-6
    boxes = tiles.select("tile", "group", "dim", "low", "high", F.explode(F.sequence(  # cells of the first axis that the box or its reach touches
        F.floor((F.col("low")[0] - reach) / reach).cast("int"), F.floor((F.col("high")[0] + reach) / reach).cast("int"))).alias("cell"))
    other = boxes.select(F.col("tile").alias("tile_b"), F.col("group").alias("group_b"), "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), "cell")
    gap = F.aggregate(F.arrays_zip("low", "high", "low_b", "high_b"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(
        F.lit(0.0), z["low"] - z["high_b"], z["low_b"] - z["high"]), 2))
    pairs = boxes.join(other, ["dim", "cell"]).where("tile <= tile_b").where(gap <= reach * reach).select(
        F.least("group", "group_b").alias("g"), F.greatest("group", "group_b").alias("h"), "tile", "tile_b").distinct()
    pairs = stored(pairs, "tile-pairs")
    needed = pairs.select("g", "h", F.explode(F.array("tile", "tile_b")).alias("tile")).distinct()
    names = ["dim", "nodes", "sizes", "data"]
    sent = needed.join(tiles.select("tile", *names), "tile")
    kinds = dict(tiles.dtypes)
    todo = pairs.select("g", "h", "tile", "tile_b", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    both = todo.unionByName(sent.select("g", "h", "tile", F.lit(None).cast("long").alias("tile_b"), *names))

    def links(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = {}, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["tile_b"] is None:
                    held[row["tile"]] = row
                else:
                    asked.append((row["tile"], row["tile_b"]))
        for p, q in sorted(asked):
            a, b = held[p], held[q]
            i, j = _compare(a, b, p == q, shared.value[a["dim"]], threshold)
            if not len(i):
                continue
            node_a, node_b, size_a, size_b = (np.frombuffer(t[c], np.int64) for c in ("nodes", "sizes") for t in (a, b))
            ends, counts = np.concatenate([node_a[i], node_b[j]]), np.concatenate([size_b[j], size_a[i]])
            nodes, at = np.unique(ends, return_inverse=True)
            edges = _forest(node_a[i], node_b[j])
            n, m = len(nodes), len(edges)
            yield pa.RecordBatch.from_arrays([
                pa.array([*nodes.tolist(), *[None] * m], pa.int64()), pa.array([*np.bincount(at, weights=counts).astype(np.int64).tolist(), *[None] * m], pa.int64()),
                pa.array([*[None] * n, *[e[0] for e in edges]], pa.int64()), pa.array([*[None] * n, *[e[1] for e in edges]], pa.int64())], names=["node", "links", "a", "b"])

    return stored(both.groupBy("g", "h").applyInArrow(links, "node long, links long, a long, b long"), "vector-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS,
                 group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = _classes(vectors, id_col, vector_col)
    total = rows.count()
    # classes are known by a number of their own, as an id may be null or repeat with another vector
    classes = stored(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("dim").alias("dim"), F.first("data").alias("data")).withColumn(
        "node", F.xxhash64("key")), "vector-classes")
    axes = _axes(classes)
    groups = classes.select("key", "size", "least", "node")
    if axes:
        found = _tile_links(_tiles(classes.select("node", "size", "dim", "data"), axes, tile_rows, group_bytes), axes, threshold)
        counts = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
        components = connected_components(found.where("a IS NOT NULL").select("a", "b"))
        groups = groups.join(counts, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        groups = stored(groups, "vector-groups")
        least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
        groups = stored(groups.join(least, "component").select("key", "size", "links", "component_id"), "vector-components")
    else:
        groups = groups.select("key", "size", F.lit(0).cast("long").alias("links"), F.col("least").alias("component_id"))
    out = attach(rows.select("id", "key"), groups, "key", "size", total)
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
