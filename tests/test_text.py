"""Document chunks, ids, nearest vectors and overlap removal."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from spendweave.functions import text


def naive_chunks(doc, size=800, overlap=100):
    """Chunk texts found line by line with explicit buffers, as a check of the index arithmetic."""
    out, held, section = [], [], ""
    for line in doc.split("\n"):
        if line.strip()[:3] == "## " or line.strip()[:4] == "### ":
            section = line.strip().lstrip("#").strip()
        if held and sum(map(len, held)) + len(line) > size:
            out.append((section, "\n".join(held)))
            kept = []
            while held and sum(map(len, kept)) + len(held[-1]) <= overlap:
                kept.insert(0, held.pop())
            held = kept
        held.append(line)
    return out + [(section, "\n".join(held))]


def test_chunks_against_naive(spark):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        rows = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            rows.append("## Head " + str(rng.randint(0, 9)) if kind < 0.08 else "  ### Deep " if kind < 0.12
                        else "" if kind < 0.2 else "w" * rng.choice([5, 40, 60, 100, 101, 300, 799, 800, 801, 1700]))
        docs.append((str(i), "\n".join(rows)))
    docs += [("blank", " \n\t\n"), ("nbsp", " "), ("one", "x")]
    df = spark.createDataFrame(docs, "source string, text string").repartition(3)
    got = {}
    for r in text.chunk_docs(df).orderBy("source", "chunk_no").collect():
        got.setdefault(r.source, []).append((r.section, r.text))
    assert got == {s: naive_chunks(t) for s, t in docs if t.strip()}


def test_chunk_ids(spark):
    df = spark.createDataFrame([("a.md", "Sec", "body é")], "source string, section string, text string")
    assert text.chunk_ids(df).first().chunk_id == hashlib.sha256("a.md:Sec:body é".encode()).hexdigest()[:16]


def test_topk_and_threshold(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8))
    asked = {"q1": vectors[3], "q2": -vectors[3]}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, v array<double>")
    queries = F.array(*[F.struct(F.lit(k).alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("vector")) for k, v in asked.items()])
    rows = text.vector_topk(df, queries, "id", "v", 5).collect()
    for name, q in asked.items():
        distance = 1 - vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
        want = [int(i) for i in np.argsort(distance)[:8] if distance[i] <= 1.2]
        assert [r.id for r in sorted((r for r in rows if r.query_id == name), key=lambda r: r["rank"])] == want
    far = text.vector_topk(df, queries, "id", "v", 5, max_distance=0.1).where("query_id = 'q1'")
    assert [r.id for r in far.collect()] == [3]


def test_overlap_removal(spark):
    rng = random.Random(9)
    rows = []
    for q in ("a", "b", "c"):
        for rank in range(1, 9):
            rows.append((q, rank, " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 5))), rank / 10))
    df = spark.createDataFrame(rows, "query_id string, rank int, text string, distance double")
    for n in (2, 5):
        got = {(r.query_id, r["rank"]) for r in text.dedupe_overlap(df, n).collect()}
        want = set()
        for q in "abc":
            kept = []
            for _, rank, words, _ in sorted(r for r in rows if r[0] == q):
                mine = set(words.split())
                clash = any(min(len(mine), len(k)) and len(mine & k) / min(len(mine), len(k)) > 0.5 for k in kept)
                if not clash and len(kept) < n:
                    kept.append(mine)
                    want.add((q, rank))
        assert got == want
