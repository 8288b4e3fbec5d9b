"""Byte-level BPE encoding and decoding over a shuffle of distinct words.

Texts become blocks of units with positions (``blocks.py``); a unit is a run without white space with one
space before it if there is one, or white space itself, so no match of the split pattern crosses units.
Every distinct unit of the corpus is encoded once, its ids join back to the blocks, and the positions put
them in order. Decoding joins the token-byte table, which is as large as the vocabulary and broadcast.

``docs`` must be a table of files (or stored first), as its rows are read twice and must come in the same
order; a checksum of each block tells if they did not.

Defined results: a null or empty text has no ids. Rows are encoded one by one, whatever ids repeat; a null
id stays null. Decoding an unknown id raises. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.blocks import bucket_words, codes_of, pack, ragged, to_blocks, unpack, with_values, words_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Unicode's White_Space, as the split pattern's \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts in which white space is not always one space or one line break between words, or that hold the mark.
ODD = (r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
       r"|[ \n][ \n]")
MARK = "\0"
#: Rows that are decoded together.
DECODED_ROWS = 500


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, their counts by text, order of the texts): a vectorised split, and the pattern for odd texts."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
    plain = texts.filter(pa.array(~odd))
    marked = pc.replace_substring(pc.replace_substring(plain, "\n", f"{MARK}\n{MARK}"), " ", f"{MARK} ")
    lists = pc.split_pattern(marked, MARK)
    found = [UNIT.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    flat = pa.concat_arrays([lists.flatten(), pa.array([u for f in found for u in f], pa.string())])
    counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.array([len(f) for f in found], np.int64)])
    return flat, counts, np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])


def _read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _shared_file(spark: SparkSession, path: str):
    """The vocabulary file, under a megabyte, broadcast, so executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, tokens): tokens as little-endian unsigned 32-bit numbers in one binary value."""
    vocabulary = _shared_file(docs.sparkSession, ranks)
    blocks = to_blocks(docs, id_col, text_col, units)  # cut twice: codes on disk would cost more than cutting again

    def encode_words(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_read_ranks(vocabulary.value), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            rows = batch.select(["bucket", "block", "mark", "words", "size"]).to_pylist()
            for row in rows:
                found = []
                for word in words_of(row["words"], row["size"]):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = bpe.encode_ordinary(word.decode())
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids], np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["bucket"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([row["mark"]], pa.int64()), pa.array([len(found)], pa.int32()),
                    pa.array([pack(np.array([len(ids) for ids in found], np.int32))], pa.binary()),
                    pa.array([len(flat)], pa.int64()), pa.array([pack(flat)], pa.binary())],
                    names=["bucket", "block", "mark", "n", "lengths", "n_tokens", "tokens"])

    coded = bucket_words(blocks).groupBy("bucket").applyInArrow(
        encode_words, "bucket int, block long, mark long, n int, lengths binary, n_tokens long, tokens binary")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("tokens", T.BinaryType())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("ids", "counts", "n_codes", "codes", "found")}
                counts = row["counts"].values.to_numpy(zero_copy_only=False)
                n = row["n_codes"].as_py()
                if n:
                    found = row["found"].as_py()
                    if any(f["mark"] != batch.column("mark")[k].as_py() for f in found):
                        raise RuntimeError("the rows came in another order the second time; store the table before encoding it")
                    lengths = np.concatenate([unpack(f["lengths"], f["n"]) for f in found]).astype(np.int64)
                    flat = np.concatenate([unpack(f["tokens"], f["n_tokens"]) for f in found]).astype("<u4")
                    codes = codes_of(row["codes"].as_py(), n)
                    per_code = lengths[codes]
                    out = ragged(flat, (np.cumsum(lengths) - lengths)[codes], per_code)
                    before = np.concatenate(([0], np.cumsum(per_code)))
                else:
                    out, before = np.zeros(0, "<u4"), np.zeros(1, np.int64)
                ends = before[np.cumsum(counts)]
                starts = np.concatenate(([0], ends[:-1]))
                data = out.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, pa.array([data[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=[id_col, "tokens"])

    return with_values(blocks, coded).mapInArrow(reassemble, schema)


def decode(encoded: DataFrame, tokens_col: str = "tokens", out_col: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """``encoded`` with the bytes of its tokens, from the broadcast token-byte table, in place of a column of that name."""
    encoded = encoded.drop(out_col) if out_col != tokens_col else encoded
    vocabulary = _shared_file(encoded.sparkSession, ranks)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = encoded.columns.index(tokens_col)

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in _read_ranks(vocabulary.value).items()}
        table = [by_id.get(i) for i in range(max(by_id) + 1)]
        for batch in (whole.slice(k, DECODED_ROWS) for whole in batches for k in range(0, whole.num_rows, DECODED_ROWS)):
            found = [None if t is None else b"".join([table[i] for i in np.frombuffer(t, "<u4").tolist()]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return encoded.mapInArrow(join_bytes, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text: (id, n_tokens, ids_sha256, decoded_sha256)."""
    both = decode(encode(docs, id_col, text_col))
    return both.select(
        id_col, F.floor(F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
