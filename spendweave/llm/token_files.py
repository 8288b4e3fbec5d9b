"""Token ids as Parquet files: list columns with dictionary encoding, small row groups and page indexes.

Texts are dealt by id range and sorted, so the files are in ascending id order; each task encodes its texts
and writes one file. A file's rows hold the id, the file's part number, the offset of the text in the part,
the number of ids and the ids. Parquet encodes ids by a dictionary, as a vocabulary is far smaller than a
row group, and offsets and ids of version-2 pages by deltas; the page index lets a reader skip to some
texts or read only the metadata columns.

Words without white space are encoded apart from each other, as neither the normaliser nor the split
pattern of the vocabulary looks across white space. Distinct words of some megabytes are encoded together.

The names of special tokens in a text have ids of their own, as the library gives them by default. They are found in the
text as it stands and become words of one capital letter, which no other word is once the text is in lower case.

Defined results: a null or empty text has the end id alone. Null ids come first; rows with equal ids stand
side by side in any order. An empty table gives files without rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spendweave.llm.blocks import ascii_words, ragged
from spendweave.llm.kernels import merged_groups, text_bytes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: The split pattern always cuts between a letter and an ASCII mark after it; then fewer words differ.
LETTER_THEN_MARK = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([!-/:-@\[-`{-~])"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words whose ids a worker keeps for its later texts, about 250 bytes each.
KEPT_WORDS = 80_000


class _Words:
    """Ids of words, with a bounded memory of earlier ones."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # in a word, where only another spelling of a name can be left
        named = sorted((t.content, n) for n, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized)
        self.marks = {name: chr(ord("A") + k) for k, (name, _) in enumerate(named)}
        self.special = {self.marks[name]: np.array([n], "<i4").tobytes() for name, n in named}
        self.names = re.compile("(" + "|".join(re.escape(name) for name, _ in named) + ")") if named else None
        self.kept: dict[str, bytes] = {}

    def lowered(self, texts: pa.Array) -> pa.Array:
        """The texts with A-Z in lower case, and special names as the words that stand for them."""
        low = pc.ascii_lower(texts)
        data = text_bytes(texts)[0].tobytes()
        if not any(name.encode() in data for name in self.marks):
            return low
        named = pc.match_substring_regex(texts, self.names.pattern)
        found = [[f" {self.marks[part]} " if part in self.marks else part.translate(LOWER) for part in self.names.split(text)]
                 for text in texts.filter(named).to_pylist()]
        return pc.replace_with_mask(low, named, pa.array(["".join(parts) for parts in found], low.type))

    def ids(self, words: list[str]) -> list[bytes]:
        found: dict[str, bytes] = dict(self.special)
        new = []
        for w in words:
            if w not in self.kept and w not in self.special:
                if w.isascii() and w.isalpha():  # neither normalised nor split
                    found[w] = np.array([t.id for t in self.tokenizer.model.tokenize(w)], "<i4").tobytes()
                else:
                    new.append(w)
        if new:
            coded = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in new[:-1]])
            flat = np.array(coded.ids, "<i4")
            first = np.array([a for a, _ in coded.offsets], np.int64)
            cuts = np.searchsorted(first, starts).tolist() + [len(flat)]
            data = flat.tobytes()
            found.update({w: data[4 * a:4 * b] for w, a, b in zip(new, cuts, cuts[1:], strict=False)})
        out = [self.kept.get(w) if w in self.kept else found[w] for w in words]
        if len(self.kept) < KEPT_WORDS:
            self.kept.update(found)
        return out


@functools.lru_cache(maxsize=1)
def _words(vocabulary: str) -> _Words:
    """One for all tasks of a Python worker."""
    return _Words(vocabulary)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Writes (id, part, offset, n_tokens, ids) of every text in ascending id order."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_by_id = _words(vocabulary.value)
        part, offset = TaskContext.get().partitionId(), 0
        for group in merged_groups(batches, 1):
            texts = pc.replace_substring_regex(words_by_id.lowered(group.column(1)), LETTER_THEN_MARK, r"\1 \2")
            words, counts, _ = ascii_words(texts)
            coded = words.dictionary_encode()
            found = words_by_id.ids(coded.dictionary.to_pylist()) + [np.array([end_id], "<i4").tobytes()]
            lengths = np.array([len(b) // 4 for b in found], np.int64)
            flat = np.frombuffer(b"".join(found), "<i4")
            ends = np.cumsum(counts)
            codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(found) - 1)
            per_code = lengths[codes]
            ids = ragged(flat, (np.cumsum(lengths) - lengths)[codes], per_code)
            bounds = np.concatenate(([0], np.cumsum(per_code)))[np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))]
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([
                group.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offset + bounds[:-1]), pa.array(n),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=schema.names)
            offset += int(bounds[-1])

    dealt = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    (dealt.mapInArrow(encode, schema).write
     .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
     .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(path))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The files' rows with ``start``: the number of ids of all texts before. Parts are summed from metadata columns alone."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(  # a row for each file
        "base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(parts.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("offset")).select(id_col, "start", "n_tokens", "ids")


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of rows that ``read_tokens`` returns."""
    schema = T.StructType([tokens.schema[id_col], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=schema.names)

    return tokens.select(id_col, "start", "n_tokens", "ids").mapInArrow(crc, schema)
