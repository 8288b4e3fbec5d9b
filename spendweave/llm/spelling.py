"""Spelling variants: words one edit apart, found by dense comparison of prefix-suffix blocks.

Two words, the longer of ``L`` code points, are one insertion, deletion or replacement apart exactly if their
common prefix plus their common suffix reaches ``L - 1``. So they share a prefix of about half that length or
a suffix of the other half. Words meet in blocks of one length ``L`` (and ``L - 1``) with a shared prefix and
suffix. A block of too many words is split again, always exactly: of the agreement that is still asked for,
either the prefix has the first half or the suffix has the rest. Blocks where all of it is given hold at most
one word for each letter, so sizes are bounded without a cap. The columns ``asked`` (agreement still to show) and
``most`` (the pair's prefix must be shorter) give every pair one block.

Blocks lie side by side in padded code-point matrices of some hundred rows; whole matrices are compared column
by column, forwards for the prefixes and backwards for the suffixes. Letters are up to U+00FF, a byte each.

Defined results: null and empty texts have no words; a null id counts as the empty string in the hashed key.
Repeated rows count as often as they stand there. Of near words with the same count the smallest in code-point
order is the form. Other columns are ignored, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, fewest occurrences, how much more frequent a form must be, one in how many runs loses a code point.
LEAST_POINTS, LEAST_COUNT, FORM_RATIO, DROP_ONE_IN = 7, 2, 10, 31
#: A block with more words or bytes is split; a matrix has at least TILE_ROWS rows unless its blocks end or it has TILE_BYTES.
BLOCK_ROWS, BLOCK_BYTES, TILE_ROWS, TILE_BYTES = 512, 16 << 20, 128, 4 << 20
KEY = ["length", "head", "tail", "asked", "most"]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS,
                least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters, some without one code point, that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]{%d,}" % least_points), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("hashed"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("hashed") % drop_one_in == 0, cut).otherwise(F.col("run"))
    return (found.withColumn("hashed", hashed).select(word.alias("word")).where(F.length("word") >= least_points)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row of a block in the two blocks that its pairs are in: a longer prefix, or a longer suffix."""
    asked, head, tail = F.col("asked"), F.length("head"), F.length("tail")
    first = F.ceil(asked / 2).cast("int")
    more = F.array(
        F.struct((head + first).alias("head"), tail.alias("tail"), (asked - first).alias("asked"), F.col("most").alias("most")),
        F.struct(head.alias("head"), (tail + asked - first + 1).alias("tail"), (first - 1).alias("asked"), (head + first).alias("most")))
    return rows.select("word", "n", "length", F.explode(more).alias("to")).select(
        "word", "n", "length", F.substring(F.col("word"), F.lit(1), F.col("to.head")).alias("head"),
        F.substring(F.col("word"), F.length("word") - F.col("to.tail") + 1, F.col("to.tail")).alias("tail"), "to.asked", "to.most")


def blocks(words: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(word, n, length, head, tail, asked, most): the words of every block that holds two words or more.

    Each round reads stored rows and splits what is too large; after the binary logarithm of the longest word's
    length nothing is.
    """
    size = F.length("word")
    rows = _halves(words.select("word", "n", F.explode(F.array(size, size + 1)).alias("length")).select(
        "*", F.lit("").alias("head"), F.lit("").alias("tail"), (F.col("length") - 1).alias("asked"), F.col("length").alias("most")))
    done = None
    while True:
        rows = stored(rows, "spelling-blocks")
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("word")).alias("bytes"))
        large = ((F.col("rows") > block_rows) | (F.col("bytes") > block_bytes)) & (F.col("asked") > 0)
        sizes = stored(sizes.where("rows > 1").select(*KEY, large.alias("large")), "spelling-sizes")
        fit = rows.join(sizes.where("not large").select(*KEY), KEY, "left_semi")
        done = fit if done is None else done.unionByName(fit)
        if sizes.where("large").isEmpty():
            return done
        rows = _halves(rows.join(sizes.where("large").select(*KEY), KEY, "left_semi"))


def _matrix(words: list[bytes]) -> np.ndarray:
    """One row per word, padded with zeros."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(sizes.max())), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _common(matrix: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each marked pair of rows the length of the common prefix."""
    alive, out = pairs.copy(), np.zeros(pairs.shape, np.int32)
    for column in matrix.T:
        alive &= column[:, None] == column[None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[bytes], block: np.ndarray, length: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b), a < b, of the pairs of one block that are one edit apart and belong to this block."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    pairs = np.triu(block[:, None] == block[None, :], 1) & ((size == length)[:, None] | (size == length)[None, :])
    prefix = _common(_matrix(words), pairs)
    pairs &= prefix < most[:, None]
    suffix = _common(_matrix([w[::-1] for w in words]), pairs)
    return np.nonzero(pairs & (prefix + suffix >= length[:, None] - 1))


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(word, near, near_n), both ways, for the distinct words of (word, n) that are one edit apart."""
    dealt = blocks(words, block_rows, block_bytes)
    dealt = dealt.repartition(*KEY).sortWithinPartitions(*KEY).select(
        "word", "n", "length", "most", F.xxhash64(*KEY).alias("key"), "head", "tail", "asked")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Whole blocks in a row, cut at the first block end past TILE_ROWS rows or TILE_BYTES of padded matrix."""
        tile, last, widest, n_blocks = [], None, 0, 0
        for batch in batches:
            for word, n, length, most, key, head, tail, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                this = (key, length, most, asked, head, tail)
                if this != last:
                    if tile and (len(tile) >= TILE_ROWS or len(tile) * max(widest, length) > TILE_BYTES):
                        yield tile
                        tile, widest = [], 0
                    last, n_blocks = this, n_blocks + 1
                widest = max(widest, length)
                tile.append((word, n, n_blocks, length, most))
        if tile:
            yield tile

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches):
            word, n, block, length, most = zip(*tile, strict=True)
            a, b = near_pairs([w.encode("latin-1") for w in word], np.array(block), np.array(length), np.array(most))
            if len(a):
                left, right, texts = np.concatenate([a, b]), np.concatenate([b, a]), pa.array(word, pa.string())
                yield pa.RecordBatch.from_arrays([texts.take(pa.array(left)), texts.take(pa.array(right)), pa.array(np.array(n)[right])], names=["word", "near", "near_n"])

    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain. Chains double their reach each round and a form is more frequent
    by a constant factor, so rounds are a logarithm of the logarithm of the counts."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(steps.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    words = stored(word_counts(docs, id_col, text_col), "spelling-words")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has_form = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
