"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters and digits or runs of punctuation, upper and lower case apart. Features are the
1-grams and 2-grams of a text, hashed to ``2**HASH_BITS`` weights, each with the square root of its share of
the text's n-grams, and a bias. Training reads a bounded sample of labelled rows (``SAMPLE_ROWS`` with the
smallest hash of their id), dealt over ``SHARDS``; each pass runs FTRL in every shard from the common state
and averages the shards' states. The weights have a fixed size, so they are broadcast, and every text is
scored as a sparse dot product in the task that reads it.

Defined results: a null or empty text has the bias as its only feature. Without labelled rows the score is
0.5. Rows with a null id count as held out of training but are scored; of several labels of one id each is
a training row. Labels other than 0 and 1 are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.common import fresh, stored
from spendweave.llm.kernels import SEPARATOR, chunks, mix, text_bytes, token_hashes

HASH_BITS = 17
SAMPLE_ROWS = 20_000
SHARDS = 8
PASSES = 8
#: Parts in which a state of weights is averaged.
SLICES = 16
THRESHOLD = 0.3
#: FTRL: learning rate, its smoothing, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.02, 0.001
#: Byte classes: separators 0, letters, digits and non-ASCII 1, punctuation 2.
KINDS = np.full(256, 2, np.uint8)
KINDS[SEPARATOR] = 0
KINDS[0x30:0x3A] = KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = KINDS[0x80:] = 1
SIZE = (1 << HASH_BITS) + 1  # the last weight is the bias


def held_out(id_col: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == 0, F.lit(True))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weights' numbers of all 1-grams and 2-grams of the texts, and where each text's begin."""
    data, bounds = text_bytes(texts)
    words, first = token_hashes(data, bounds, KINDS)
    shift = np.uint64(64 - HASH_BITS)
    ones = (mix(words + np.uint64(1)) >> shift).astype(np.int32)
    counts = np.diff(first)
    out = np.empty(2 * len(words) - int((counts > 0).sum()), np.int32)
    pairs = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> shift).astype(np.int32) if len(words) else ones
    inner = np.ones(len(words), bool)  # the last word of a text begins no pair
    inner[first[1:][counts > 0] - 1] = False
    order = np.arange(len(words)) + np.concatenate(([0], np.cumsum(inner)))[:-1]
    out[order] = ones
    out[order[inner] + 1] = pairs[inner[:-1]] if len(words) else pairs
    per_text = np.maximum(2 * counts - 1, 0)
    return out, np.concatenate(([0], np.cumsum(per_text)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    step = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / step)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (numbers, values, label) rows; changes z and n."""
    for index, value, label in rows:
        zi, ni = z[index], n[index]
        w = _weights(zi, ni)
        gradient = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value))))) - label) * value
        squares = ni + gradient * gradient
        z[index] = zi + gradient - (np.sqrt(squares) - np.sqrt(ni)) / ALPHA * w
        n[index] = squares


def _row(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, counts = np.unique(numbers, return_counts=True)
    return np.append(index, SIZE - 1), np.append(np.sqrt(counts / max(1, len(numbers))), 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> np.ndarray:
    """The weights; reads labels of rows that are not held out only."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(~held_out(F.col("_id")) & F.col("_label").isin(0, 1))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows))
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = sample.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARDS)).cast("int"))

    def to_features(table: pa.Table) -> pa.Table:
        order = table.sort_by([("_id", "ascending"), ("_text", "ascending"), ("_label", "ascending")])
        rows = []
        for batch in chunks(order.to_batches(), order.schema.get_field_index("_text")):
            numbers, first = features(batch.column("_text"))
            rows += [_row(numbers[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({
            "shard": pa.array([order.column("_shard")[0].as_py()], pa.int32()), "labels": pa.array([order.column("_label").to_pylist()], pa.list_(pa.int32())),
            "numbers": pa.array([[r[0].astype("<i4").tobytes() for r in rows]], pa.list_(pa.binary())),
            "amounts": pa.array([[r[1].astype("<f4").tobytes() for r in rows]], pa.list_(pa.binary()))})

    shards = stored(sample.groupBy("_shard").applyInArrow(
        to_features, "shard int, labels array<int>, numbers array<binary>, amounts array<binary>"), "quality-sample")
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    context = docs.sparkSession.sparkContext
    for _ in range(passes):
        state = context.broadcast((z, n))

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    examples = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float), y)
                                for i, v, y in zip(row["numbers"], row["amounts"], row["labels"], strict=True)]
                    own = [a.copy() for a in state.value]
                    _ftrl([examples[i] for i in np.random.default_rng(row["shard"]).permutation(len(examples))], *own)
                    parts = [[_small(x) for x in np.array_split(a, SLICES)] for a in own]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(np.full(SLICES, row["shard"], np.int32)),
                        pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["slice", "shard", "z", "n"])

        def average(table: pa.Table) -> pa.Table:
            order = table.sort_by("shard")
            z, n = (np.mean([_large(v) for v in order.column(c).to_pylist()], axis=0) for c in ("z", "n"))
            return pa.table({"slice": order.column("slice")[:1], "z": pa.array([_small(z)], pa.binary()), "n": pa.array([_small(n)], pa.binary())})

        states = shards.mapInArrow(one_pass, "slice int, shard int, z binary, n binary")
        means = sorted(states.groupBy("slice").applyInArrow(average, "slice int, z binary, n binary").collect())  # one state of a fixed size
        state.destroy()
        if not means:
            break
        z, n = (np.concatenate([_large(r[c]) for r in means]) for c in ("z", "n"))
    return _weights(z, n)


def _small(values: np.ndarray) -> bytes:
    """32-bit floats as zstd, after their size."""
    data = values.astype("<f4").tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little")), "<f4").astype(float)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, in place of a column of that name."""
    docs = docs.drop(out_col) if out_col != text_col else docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = [np.zeros(0)]
            for chunk in chunks([batch], at):
                numbers, first = features(chunk.column(at))
                margins = np.zeros(chunk.num_rows)
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a:
                        index, value = _row(numbers[a:b])
                        margins[k] = w[index] @ value
                    else:
                        margins[k] = w[-1]
                found.append(1 / (1 + np.exp(-np.clip(margins, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=schema.names)

    return docs.mapInArrow(dot, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows predicted 1, with the columns of ``docs``."""
    name = fresh(docs, "_score")
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= threshold).drop(name)
