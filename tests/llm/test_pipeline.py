"""The corpus pipeline against the single operators."""

from collections import Counter

import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from spendweave.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(words[(k * 7 + j * (1 + k % 3)) % 400] for j in range(30 + k)) for k in range(40)]
    texts += [texts[3]] * 4 + [texts[5] + " more"] + ["### junk!! ### BUY NOW!!! " * 5 + str(k) for k in range(20)] + [None, "", "one"]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1", len(texts[7])), (None, texts[8], "en", "s2", len(texts[8]))]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < 45), 0) for k in range(65)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_apply_one_after_the_other(spark, tmp_path):
    rows = tables(spark, tmp_path)
    folder = str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "source mix", "byte-level BPE"]
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    wanted = [lambda d: quality.keep_good(d, labels), exact_dedup.drop_duplicates, ngram_join.keep_one, mixing.repeat]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], wanted, strict=False):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert sorted(map(repr, out.collect())) == sorted(map(repr, plain(docs).collect()))
        path = f"{folder}/{len(sizes)}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        sizes.append(docs.count())
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > 0  # every filter decides something
    kept = {r.text for r in docs.collect()}
    assert kept <= {r[1] for r in rows} and len(kept) == len({t for t in kept})
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._read_ranks(open(byte_bpe.RANKS, "rb").read()), special_tokens={})
    want = Counter((r.doc_id, len(bpe.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_pipeline_over_empty_tables(spark, tmp_path):
    tables(spark, tmp_path / "full")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
