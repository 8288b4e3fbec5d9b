"""The corpus operators against brute force, on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendweave.llm import byte_bpe, exact_dedup, html_extract, lattice_lm, mixing, ngram_join, quality, sharding, token_files, vector_join

DOCS = "doc_id long, text string, lang string, source string, _hash string, score int, id string"
WORD = rb"[^\x20\x09-\x0d]+"


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "a b c d"), (5, "A b  C\td"), (6, "  spaced \n\n out\u00a0 text \x00 \x1c x\r\n"),
            (7, "It's 12 o'clock, isn't it?!! <|endoftext|>"), (7, "see the <|endoftext|> mark"), (7, "A<|startoftext|><|endoftext|>b<|ENDOFTEXT|> B <|endoftext|"), (8, "日本語 のテキスト 𝒳 e\u0301 \u0130"), (9, " ".join(rng.choice(vocabulary) for _ in range(20000))), (10, "x" * 50000)]
    for k in range(11, 30):  # near copies of one text, some too far from each other
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(k, rows[12][1]) for k in range(30, 40)]  # exact copies
    rows += [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(40, 140)]
    rows += [(k, "### junk!! ### " + " ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=30))) for k in range(140, 180)]
    rows += [(200, "same row"), (200, "same row"), (None, "no id"), (None, None)]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 4}", "clash", 3, "x") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_byte_bpe_is_what_the_library_gives(docs, rows, none):
    ranks = byte_bpe._read_ranks(open(byte_bpe.RANKS, "rb").read())
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = bpe.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert found(byte_bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert byte_bpe.digests(none).count() == 0


def test_token_files_round_trip(spark, docs, rows, none, tmp_path):
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER)
    token_files.write_tokens(docs, str(tmp_path / "a"))
    got = token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
    start = 0
    for r in got:
        assert r.start == start
        assert any(r.n_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.doc_id])
        start += r.n_tokens
    token_files.write_tokens(docs, str(tmp_path / "small"), row_group_bytes=1 << 16)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "small").glob("*.parquet")]
    assert max(f.num_row_groups for f in files) > 1
    columns = {c.path_in_schema.split(".")[0]: c for f in files if f.num_rows for c in (f.row_group(0).column(k) for k in range(f.num_columns))}
    assert set(columns) == {"doc_id", "part", "offset", "n_tokens", "ids"} and all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert "RLE_DICTIONARY" in columns["ids"].encodings and {c.compression for c in columns.values()} == {"ZSTD"}
    assert any("DELTA" in e for c in columns.values() for e in c.encodings) or all("RLE_DICTIONARY" in c.encodings for c in columns.values())
    plan = token_files.read_tokens(spark, str(tmp_path / "small")).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("ReadSchema")[1].split("\n")[0]  # metadata are read without the ids
    token_files.write_tokens(none, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_word_hashes_of_related_words_differ():
    from spendweave.llm.kernels import string_hashes, token_hashes

    bits = "a"
    while len(bits) < 4096:  # the Thue-Morse sequence, which polynomials modulo a power of two cannot tell from its complement
        bits += bits.translate(str.maketrans("ab", "ba"))
    words = [w for n in (1, 63, 64, 65, 128, 1024, 2048, 4096) for w in (bits[:n], bits[:n].translate(str.maketrans("ab", "ba")))]
    words += ["a" * n for n in range(2, 200)] + ["b" + "a" * n for n in range(200)] + ["a" * n + "b" for n in range(1, 200)]
    words = sorted(set(words))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes, _ = token_hashes(data, np.array([0, len(data)]))
    assert len(np.unique(hashes)) == len(words) == len(np.unique(string_hashes(pa.array(words))))
    again, _ = token_hashes(np.frombuffer(("x\n" + "  ".join(words)).encode(), np.uint8), np.array([0, 1, 2 + sum(map(len, words)) + 2 * (len(words) - 1)]))
    assert (again[1:] == hashes).all()  # wherever a word stands


def test_complementary_texts_are_not_linked(spark):
    bits = "ab"
    while len(bits) < 2048:
        bits += bits.translate(str.maketrans("ab", "ba"))
    other = bits.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, bits), (2, other), (3, " ".join(bits)), (4, " ".join(other)), (5, bits)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert (got[1], got[2], got[5]) == (1, 2, 1)


def jaccard_brute(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(WORD, (r[1] or "").encode().translate(low))
        sets.append(({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set())
    least = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if least[a] is None or least[b] is None or least[a] == least[b]:
                    continue
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, least, strict=True)), key=repr)


def test_ngram_join_finds_all_components(docs, rows, none):
    assert found(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_brute(rows)
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    components = {i: c for i, _, c in jaccard_brute(rows)}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in components.items() if i == c}


def test_overlaps_are_summed_over_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_COPY", 5)
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] < 60}
    words = {i: re.findall(WORD, t.encode().translate(low)) for i, t in texts.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in words.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    docs = spark.createDataFrame([*sorted(texts.items()), (13, "another text under the same id")], "id long, text string")
    got = ngram_join.overlaps(spark.createDataFrame(pairs, "a long, b long"), docs)
    want = [(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b in pairs]
    assert found(got, "a", "b", "n_a", "n_b", "overlap") == sorted((x for x in want if x[4] and 100 * x[4] >= 80 * (x[2] + x[3] - x[4])), key=repr)


def test_ngram_join_without_candidates_in_a_pivot_round(spark):
    passages = [[f"c{k}w{i}" for i in range(904)] for k in range(5)]
    texts = [p + [f"{side}{k}w{i}" for i in range(100)] for k, p in enumerate(passages) for side in "ab"]
    texts.append([w for p in passages for w in p])  # the heaviest row of every shared column, and too long for a link
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    want = jaccard_brute(rows)
    assert [c for _, _, c in sorted(want)] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8, 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {0, 2, 4, 6, 8, 10}


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    assert found(exact_dedup.mark_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert found(exact_dedup.mark_duplicates(docs, max_blocks=1), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    wide = docs.unionByName(docs.sparkSession.range(1000, 6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("unique "), "id").alias("text"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text")]))
    flagged, flag, total = exact_dedup._flagged(wide, "text", 1)  # more rows than one block's filter has room for
    shuffled = flagged.where(F.col(flag)).count()
    assert total > 5000 and sum(len(ids) for ids in groups.values() if len(ids) > 1) <= shuffled < 100
    dropped = exact_dedup.drop_duplicates(docs)
    assert dropped.columns == docs.columns
    assert found(dropped, "doc_id") == sorted(((i,) for i in keep.values()), key=repr)
    assert exact_dedup.mark_duplicates(none).count() == 0


def test_sharding_splits_oversized_buckets_only(docs, rows, none, spark, tmp_path):
    limit = 20_000
    got = sharding.assign_shards(docs, limit=limit).collect()
    assert len(got) == len(rows)
    hashes = {r[0]: int(hashlib.md5(str(r[0] if r[0] is not None else "\0").encode()).hexdigest()[:15], 16) for r in rows}
    sizes = [(hashes[r[0]], len((r[1] or "").encode())) for r in rows]
    for r in got:
        h = hashes[r.doc_id]
        for depth in range(61):
            same = [(x, n) for x, n in sizes if x >> (60 - depth) == h >> (60 - depth)]
            if sum(n for _, n in same) <= limit or len({x for x, _ in same}) == 1:
                break
        assert (r.shard_depth, r.shard_bytes, r.shard_rows) == (depth, sum(n for _, n in same), len(same))
        assert r.shard == (format(h >> (60 - depth), f"0{depth}b") if depth else "")
    assert sharding.assign_shards(none).count() == 0
    many = docs.withColumn("shard", F.lit("mine")).withColumn("_key", F.lit(1)).withColumn("depth", F.lit(2)).withColumn("prefix", F.lit(3))
    column = sharding.write_shards(many, str(tmp_path / "shards"), limit=limit)
    back = sharding.read_shards(spark, str(tmp_path / "shards"), many.schema, column)
    assert column == "_shard" and back.drop(column).exceptAll(many).isEmpty() and many.exceptAll(back.drop(column)).isEmpty()
    names = ("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_rows")
    assert found(sharding.shard_report(back, column), *names) == sorted((tuple(r[c] for c in names) for r in got), key=repr)
    sharding.write_shards(none, str(tmp_path / "none"))
    assert sharding.shard_report(sharding.read_shards(spark, str(tmp_path / "none"), none.schema)).count() == 0


def test_quality_learns_from_rows_not_held_out(docs, none, spark):
    labels = spark.createDataFrame([(i, int(i < 140), 0) for i in range(11, 180)] + [(None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    by_text = {r.text: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    same = lambda g, r: g.score == by_text[r.text]  # noqa: E731 (rows may share an id)
    assert len(got) == docs.count()
    test = [r for r in got if r.held_out and r.doc_id is not None and 11 <= r.doc_id < 180]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = [r.score for r in test if r.doc_id < 140], [r.score for r in test if r.doc_id >= 140]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert found(kept, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in docs.collect() if any(g.doc_id == r.doc_id and g.predicted and same(g, r) for g in got)), key=repr)


def test_outputs_replace_columns_of_their_names(docs):
    clashing = docs.withColumn("decoded", F.lit("mine")).withColumn("score", F.lit("mine"))
    assert byte_bpe.decode(byte_bpe.encode(clashing)).columns.count("decoded") == 1
    scored = quality.score(clashing, np.zeros(quality.SIZE))
    assert scored.columns.count("score") == 1 and scored.schema["score"].dataType.simpleString() == "double"


def test_mix_meets_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(WORD, (r[1] or "").encode()))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = float(sum(size.values())), list(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken = Counter()
    for r in got:
        s = next(s for s in order if size[s] == r.source_size)
        assert math.isclose(r.target, target[s]) and r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert len(got) == len(rows)
    largest = 20000
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] or size[s] > largest / 2 and abs(taken[s] - target[s]) <= largest for s in order)
    assert found(mixing.mix(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    copies = Counter({i: max(n for j, n in ((r.doc_id, r.copies) for r in got) if j == i) for i in {r.doc_id for r in got}})
    times = Counter(r[0] for r in rows)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n * times[i] for i, n in copies.items() if n})
    assert mixing.mix(none).count() == 0


def test_vector_join_is_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 24))
    vectors = [b + rng.normal(size=24) * s for b in base for s in (0, 0, 0.1, 0.2, 0.25, 0.3)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, []), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (506, [None] * 24), (507, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = vector_join.near_vectors(df, tile_rows=32).collect()
    valid = {k: np.array(v) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = defaultdict(set)
    for a, x in valid.items():
        for b, y in valid.items():
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a].add(b)
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min((least[b] for b in {a, *links[a]} if least[b] is not None), default=None) for a in range(len(rows))]
    want = sorted(((r[0], len(links[a]), least[a]) for a, r in enumerate(rows)), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    small_groups = vector_join.near_vectors(df, tile_rows=8, group_bytes=2 * 8 * 8 * 24).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in small_groups), key=repr) == want
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_html_extract(spark):
    pages = [
        (1, "u", "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
                 "<div class=\"ad\">Buy this now please.</div><article><h1>A  title &amp; more</h1><p>First   line of the text that goes on for a while.<br>Next.</p>"
                 "<p>Second paragraph of the text, which is also long enough to read.</article><footer>&copy; Someone &middot; Rights.</footer></body></html>"),
        (2, "u", None), (3, "u", ""), (4, "u", "<nav><a href=x>only</a></nav>"), (5, "u", "<article><p>Cut off text that is long enough to be real &am")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == ("A title & more\n\nFirst line of the text that goes on for a while. Next.\n\n"
                           "Second paragraph of the text, which is also long enough to read.")
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[5].text.endswith("real &am")
    weights, trans, start = html_extract.train()
    wrong = total = 0
    for seed in range(9000, 9060):  # pages that were not trained on
        blocks = html_extract.blocks_of(html_extract.labelled_page(seed))
        marks = [int(html_extract._MARKS[1] in b[1]) for b in blocks]
        clean = [b[1].translate({ord(c): None for c in html_extract._MARKS.values()}).strip() or "." for b in blocks]
        scores = [sum(weights.get(f, 0) for f in (*dict.fromkeys(b[0]), *html_extract._text_features(t, b[2]))) for b, t in zip(blocks, clean, strict=True)]
        wrong += sum(a != b for a, b in zip(marks, html_extract.best_labels(scores, trans.tolist(), start), strict=True))
        total += len(marks)
    assert wrong <= 0.01 * total


def test_html_extract_on_pages_labelled_by_hand(spark):
    from hand_pages import PAGES as pages

    rows = [(k, page, "old", 1) for k, (page, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = {r.page_id: r.text.split("\n\n") if r.text else [] for r in html_extract.extract(df).collect()}
    hit = sum(len(set(got[k]) & set(want)) for k, (_, want) in enumerate(pages))
    precision, recall = hit / sum(map(len, got.values())), hit / sum(len(want) for _, want in pages)
    print(f"blocks of hand-labelled pages: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.97
    assert html_extract.extract(df).columns == ["page_id", "text", "n_chars"] and html_extract.extract(df.limit(0)).count() == 0
    assert html_extract.extract(df.unionAll(df)).count() == 2 * len(pages)


def test_viterbi_and_gradients_against_all_labelings():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        scores, trans, start = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist(), float(rng.normal())

        def value(labels):
            return start * labels[0] + sum(s * y for s, y in zip(scores, labels, strict=True)) + sum(trans[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert html_extract.best_labels(scores, trans, start) == list(best)
    # the trained field is a maximum: the penalised likelihood, summed over all labelings, falls in random directions
    weights, trans, start = html_extract.train(12, 2000)
    names = sorted(weights)
    pages = []
    for seed in range(12):
        blocks = html_extract.blocks_of(html_extract.labelled_page(seed))
        marks = [int(next((c for c in b[1] if c in html_extract._MARKS.values()), html_extract._MARKS[0]) == html_extract._MARKS[1]) for b in blocks]
        clean = [b[1].translate({ord(c): None for c in html_extract._MARKS.values()}).strip() or "." for b in blocks]
        pages.append(([[names.index(f) for f in (*dict.fromkeys(b[0]), *html_extract._text_features(t, b[2]))] for b, t in zip(blocks, clean, strict=True)], marks))

    def likelihood(w, t, s):
        total = -0.05 * (w @ w + (t ** 2).sum() + s * s)
        for features, marks in pages:
            if marks:
                emit = [w[f].sum() for f in features]
                ahead = np.array([0.0, emit[0] + s])
                for e in emit[1:]:
                    ahead = np.array([np.logaddexp(ahead[0] + t[0, 0], ahead[1] + t[1, 0]), np.logaddexp(ahead[0] + t[0, 1], ahead[1] + t[1, 1]) + e])
                own = s * marks[0] + sum(e * y for e, y in zip(emit, marks, strict=True)) + sum(t[a, b] for a, b in zip(marks, marks[1:], strict=False))
                total += own - np.logaddexp(*ahead)
        return total

    w = np.array([weights[f] for f in names])
    here = likelihood(w, trans, start)
    for _ in range(20):
        assert likelihood(w + 0.3 * rng.normal(size=len(w)), trans + 0.3 * rng.normal(size=(2, 2)), start + 0.3 * rng.normal()) < here


def test_html_extract_keeps_text_after_unclosed_elements(spark):
    article = "<article><h1>A title of some words</h1>%s<p>The main text of the page, which goes on for a while and ends here.</p></article>"
    text = "A title of some words\n\nThe main text of the page, which goes on for a while and ends here."
    starts = ["<svg class=\"icon\"/>", "<svg/>", "<SVG />", "<svg-icon></svg-icon>", "<svg-icon>", "<button-group></button-group>", "<template-x>", "<script-x>",
              *(f"<{name}>" for name in "button iframe noscript select svg template textarea".split()), "<Button class=x>", "<button><button>", "<SCRIPT>var a = '<p>x</p>'</SCRIPT>",
              "<script>var a = 1</SCRIPT>", "<SCRIPT>var a = 1</script >", "<STYLE>p {color: red}</STYLE>", "<style>p {color: red}</Style>",
              "<svg><title>Icon</title><path d='x'/></svg>", "<BUTTON type=button>Share</BUTTON>", "<noscript>Enable scripts.</noscript>",
              "<template><p>Never shown words.</p></template>", "<select><option>One<option>Two</select>"]
    pages = [(2 * k + inside, article % s if inside else s + article % "") for k, s in enumerate(starts) for inside in (0, 1)]
    pages += [(1000, article % "" + "<script>var a = 1 <p>no text"), (1001, article % "" + "<!-- no <p>text"), (1002, article % "" + "<STYLE>p {} <p>no text")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {r.page_id: r.text for r in got if r.text != text} == {}


def test_lattice_sums_all_segmentations(docs, rows, none):
    pieces, p = [START for START in ("▁".encode(), "▁a".encode(), b"ab", b"b", b"a", b"bc", b"abc", b"c", b"\xe2", b"\x96", b"\x81")], np.arange(1, 12) / 66
    lattice = lattice_lm._Lattice(pieces, np.log(p))

    def total(text):
        return 1.0 if not text else sum(q * total(text[len(x):]) for x, q in zip(pieces, p, strict=True) if text.startswith(x))

    for word in (b"a", b"abc", b"aabcb"):
        assert math.isclose(lattice.log_probabilities([word])[0], math.log(total("▁".encode() + word)), rel_tol=1e-9)
    uses = lattice.expected_counts([b"abc"], np.ones(1))
    step = 1e-6
    for k in range(len(pieces)):  # expected uses are the derivative of the log-probability by the piece's log-weight
        moved = np.log(p) + step * (np.arange(len(p)) == k)
        assert math.isclose((lattice_lm._Lattice(pieces, moved).log_probabilities([b"abc"])[0] - lattice.log_probabilities([b"abc"])[0]) / step, uses[k], abs_tol=1e-4)
    many = [b"abcbc", b"aabcb", b"bcbcb"] * 5  # a length that many words have goes as rows of bytes, others one by one
    assert np.allclose(lattice.log_probabilities(many), [lattice.log_probabilities([w])[0] for w in many], rtol=1e-12)
    assert np.allclose(lattice.expected_counts(many, np.ones(15)), sum(lattice.expected_counts([w], np.ones(1)) for w in many), rtol=1e-9)
    assert math.isfinite(lattice.log_probabilities([b"abc" * 20_000])[0])
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(WORD, (r[1] or "").encode().translate(low)) + [None] for r in rows]
    out = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    seen = Counter(w for ws, h in zip(words, out, strict=True) if not h for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = sorted(((r[0], h, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4))
                   for r, ws, h in zip(rows, words, out, strict=True)), key=repr)
    got = lattice_lm.lm_scores(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.mixed_score < 0 for r in got)
    # the score by plain recursions over strings: expected piece counts of every training word, then all segmentations of every text's words
    names, weights = lattice_lm.read_pieces()
    longest, log_p = max(map(len, names)), dict(zip(names, np.log(weights / weights.sum()).tolist(), strict=True))

    def sums(word):
        ahead = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            paths = [ahead[a] + log_p[word[a:end]] for a in range(max(0, end - longest), end) if word[a:end] in log_p]
            most = max(paths)
            ahead[end] = most + math.log(sum(math.exp(x - most) for x in paths))
        return ahead

    for _ in range(lattice_lm.EM_STEPS):
        uses = dict.fromkeys(names, 0.1)
        for word, times in seen.items():
            if word is not None:
                word = "▁".encode() + word
                ahead = sums(word)
                back = [-math.inf] * len(word) + [0.0]
                for a in range(len(word) - 1, -1, -1):
                    paths = [log_p[word[a:b]] + back[b] for b in range(a + 1, min(len(word), a + longest) + 1) if word[a:b] in log_p]
                    most = max(paths)
                    back[a] = most + math.log(sum(math.exp(x - most) for x in paths))
                for a in range(len(word)):
                    for b in range(a + 1, min(len(word), a + longest) + 1):
                        if word[a:b] in log_p:
                            uses[word[a:b]] += times * math.exp(ahead[a] + log_p[word[a:b]] + back[b] - ahead[-1])
        whole = sum(uses.values())
        log_p = {x: math.log(u / whole) for x, u in uses.items()}
    marginal = {w: sums("▁".encode() + w)[-1] for ws in words for w in ws if w is not None}
    ends = seen[None]
    want = sorted(((r[0], sum(marginal[w] for w in ws[:-1]) / math.log(10) + (len(ws) - 1) * math.log10((n - ends) / n) + math.log10(ends / n))
                   for r, ws in zip(rows, words, strict=True)), key=repr)
    mine = sorted(((r.doc_id, r.score) for r in got), key=repr)
    assert [i for i, _ in mine] == [i for i, _ in want] and np.allclose([x for _, x in mine], [x for _, x in want], rtol=1e-7)
    assert lattice_lm.lm_scores(none).count() == 0


def test_lattice_uses_pieces_of_any_length():
    read, weights = lattice_lm.read_pieces()
    assert len(read) == len(weights)
    assert {"▁representation".encode(), "▁infrastructure".encode(), "▁который".encode(), "▁области".encode()} <= set(read)
    long = "который".encode() + b"ab" * 17
    pieces, p = ["▁".encode(), "▁который".encode(), "▁".encode() + long, b"ab" * 17, b"abab", *[bytes([b]) for b in range(256)]], np.arange(1, 262) / 34191
    lattice = lattice_lm._Lattice(pieces, np.log(p))
    by_piece = {x: q for x, q in zip(pieces, p, strict=True)}

    def total(text):
        sums = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            sums[end] = sum(sums[start] * by_piece.get(text[start:end], 0.0) for start in range(end))
        return sums[-1]

    words = [long, "который".encode(), b"ab" * 20]
    want = [math.log(total("▁".encode() + w)) for w in words]
    assert np.allclose(lattice.log_probabilities(words), want, rtol=1e-9)
    many = [w for w in words for _ in range(60)]  # as rows of bytes
    assert np.allclose(lattice.log_probabilities(many), np.repeat(want, 60), rtol=1e-9)
    assert np.allclose(lattice.expected_counts(many, np.ones(180)), 60 * sum(lattice.expected_counts([w], np.ones(1)) for w in words), rtol=1e-9)
