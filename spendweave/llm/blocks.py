"""Texts as blocks of word codes, and the shuffle of distinct words that gives every word a value once.

A block is some megabytes of whole texts: its distinct words, and for every text the positions of those
words as codes into that list. The words of a block are dealt into buckets by their hash and sorted there,
so a bucket's words go as one value and need no numbers. Only distinct words of blocks are shuffled, never
single occurrences. What a bucket finds for its words goes back to their blocks in the same order, where
the codes put it in the order of the texts again. """

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.kernels import merged_groups, string_hashes

#: Buckets grow with the rows, so that the distinct words of one fit in a task.
LEAST_BUCKETS = 48
ROWS_PER_BUCKET = 200_000
#: A byte that no UTF-8 text has.
BETWEEN = b"\xff"


def pack(codes: np.ndarray) -> bytes:
    """Numbers of 32 bits, their bytes apart by rank, as zstd."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 6).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D: (words, their counts by text, order of the texts)."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    before = np.concatenate(([0], np.cumsum(real)))
    counts = np.diff(before[np.concatenate(([0], ends))])
    return words.filter(pa.array(real)), counts, np.arange(len(texts))


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return ascii_words(pc.ascii_lower(texts))


def words_of(blob: bytes, size: int) -> list[bytes]:
    """The words of a bucket of a block, from their zstd value and its unpacked size."""
    return pa.Codec("zstd").decompress(blob, size, asbytes=True).split(BETWEEN)


def to_blocks(docs: DataFrame, id_col: str, text_col: str, split: Callable, marked: Callable | None = None) -> DataFrame:
    """A row for each block: block, ids, counts (words by text), n_codes, codes, mark, words.

    The rows are read more than once. Either store them, or let ``docs`` be a table of files, whose rows come in
    the same order each time; ``mark`` is a checksum of a block's words by which ``with_values`` users can tell.
    ``words`` has (bucket, n, size, words, marks) for each bucket with words. With ``marked`` (a function of the
    ids) ``marks`` counts each word's occurrences in marked texts.
    """
    buckets = max(LEAST_BUCKETS, math.ceil(docs.count() / ROWS_PER_BUCKET))
    words_type = T.ArrayType(T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("size", T.LongType()),
        T.StructField("words", T.BinaryType()), T.StructField("marks", T.BinaryType())]))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("n_codes", T.LongType()),
        T.StructField("codes", T.BinaryType()), T.StructField("mark", T.LongType()), T.StructField("words", words_type)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for k, group in enumerate(merged_groups(batches, 1)):
            words, counts, order = split(group.column(1))
            coded = words.dictionary_encode()
            ids = group.column(0).take(pa.array(order))
            found = coded.dictionary.to_pylist()
            bucket = (string_hashes(coded.dictionary) % np.uint64(buckets)).astype(np.int64) if found else np.zeros(0, np.int64)
            alphabetic = pc.sort_indices(coded.dictionary).to_numpy()
            place = alphabetic[np.argsort(bucket[alphabetic], kind="stable")]
            new = np.empty(len(place), np.int32)
            new[place] = np.arange(len(place))
            codes = new[coded.indices.to_numpy(zero_copy_only=False)] if found else np.zeros(0, np.int32)
            # frequent words get small numbers in the stored codes, which compress better
            uses = np.bincount(codes, minlength=len(place))
            by_use = np.argsort(-uses, kind="stable")
            rank = np.empty(len(place), np.int32)
            rank[by_use] = np.arange(len(place))
            marks = None
            if marked is not None:
                marks = np.bincount(codes, weights=np.repeat(marked(ids), counts), minlength=len(place)).astype(np.int32)
            cuts = np.searchsorted(bucket[place], np.arange(buckets + 1)).tolist()
            dealt, mark = [], 0
            for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if j > i:
                    blob = BETWEEN.join([found[w].encode() for w in place[i:j]])
                    mark = zlib.crc32(blob, mark)
                    dealt.append({"bucket": b, "n": j - i, "size": len(blob), "words": pa.Codec("zstd", 6).compress(blob, asbytes=True),
                                  "marks": None if marks is None else pack(marks[i:j])})
            kind = pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("words", pa.binary()), ("marks", pa.binary())])
            data = np.concatenate([rank[codes], by_use.astype(np.int32)]) if found else codes
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()), one(ids), one(pa.array(counts.astype(np.int32))),
                pa.array([len(codes)], pa.int64()), pa.array([_joined(data, len(codes))], pa.binary()), pa.array([mark], pa.int64()), one(pa.array(dealt, kind))],
                names=["block", "ids", "counts", "n_codes", "codes", "mark", "words"])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def _joined(data: np.ndarray, n: int) -> bytes:
    codes, by_use = pack(data[:n]), pack(data[n:])
    return np.array([len(codes), len(data) - n], "<i8").tobytes() + codes + by_use


def codes_of(blob: bytes, n: int) -> np.ndarray:
    """Each word's number among the words of its block in order of bucket."""
    cut, words = np.frombuffer(blob, "<i8", 2).tolist()
    ranks, by_use = unpack(blob[16:16 + cut], n), unpack(blob[16 + cut:], words)
    return by_use[ranks]


def bucket_words(blocks: DataFrame) -> DataFrame:
    """(bucket, block, mark, n, size, words, marks): what each bucket gets of each block."""
    return blocks.select("block", "mark", F.explode("words").alias("w")).select("w.bucket", "block", "mark", "w.n", "w.size", "w.words", "w.marks")


def with_values(blocks: DataFrame, valued: DataFrame) -> DataFrame:
    """Blocks with ``found``: the rows of ``valued`` (bucket, block, ...) of a block in order of bucket."""
    names = [c for c in valued.columns if c not in ("bucket", "block")]
    back = valued.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *names))).alias("found"))
    return blocks.select("block", "mark", "ids", "counts", "n_codes", "codes").join(back, "block", "left")
