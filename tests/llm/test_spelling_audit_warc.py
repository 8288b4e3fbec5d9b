"""Spelling variants, the filter audit and WARC archives against brute force."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import UTC, datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spendweave.llm import filter_audit, spelling, warc

DOCS = "doc_id long, text string, source string, n long, word string, row string, sha int, part int, fails int"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string, bytes string, sha int, captured string, value int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one_edit(word, rng):
    k, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:k] + (rng.choice("abcé×ÿ") if kind else "") + word[k + (kind != 1):]


def words_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(40)] + ["ÀÉ÷" * 3, "a" * 9, "a" * 10, "ab" * 6, "x" * 3000, "x" * 2999]
    words = base * 12 + [one_edit(rng.choice(base), rng) for _ in range(800)] + [one_edit(one_edit(rng.choice(base), rng), rng) for _ in range(300)]
    rng.shuffle(words)
    texts = [" ".join(w.upper() if k % 9 == 0 and w.isascii() else w + rng.choice(["", ".", "1"]) for k, w in enumerate(words[at:at + 10])) for at in range(0, len(words), 10)]
    texts += [None, "", "short ones", texts[0], texts[0], " ".join(words), "𝒳grammar日本語grammar " * 40]
    return [(None if k == 7 else k // 2 if k < 6 else k, t) for k, t in enumerate(texts)]


def spelling_brute(rows, least=7):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    out = {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    rows = []
    for w, (form, n, near_count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near_count, form_n))
    return sorted(rows, key=repr)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(spark):
    rows = words_rows()
    docs = spark.createDataFrame([(i, t, "s", 1, "w", "r", 1, 1, 1) for i, t in rows], DOCS).repartition(3)
    want = spelling_brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and max(r[4] for r in want) > 5
    assert found(spelling.variants(docs), *NAMES) == want
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block_rows", "block_bytes"), [(1, 1 << 20), (5, 1 << 20), (512, 60)])
def test_split_blocks_find_the_same_pairs_once(spark, block_rows, block_bytes):
    words = spark.createDataFrame([(r[0], r[3]) for r in spelling_brute(words_rows())], "word string, n long")
    whole = found(spelling.near_words(words), "word", "near", "near_n")
    assert len(whole) == len(set(whole)) > 100
    assert found(spelling.near_words(words, block_rows, block_bytes), "word", "near", "near_n") == whole
    largest = spelling.blocks(words, 5).groupBy(*spelling.KEY).count().agg(F.max("count")).first()[0]
    assert largest <= 118  # one word a letter where nothing more can be split


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f")], "word string, form string")
    assert found(spelling._roots(forms), "word", "root") == [(w, "f") for w in "abcdex"]


def audit_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeXé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [None, "", "", "A", " ", "#", "  x", "word " * 250, "Ä " * 210]
    for _ in range(120):
        t = " ".join(rng.choice(vocabulary[:rng.choice([60, 400])]) for _ in range(rng.choice([20, 199, 200, 260, 400])))
        texts.append((t.lower() if rng.random() < 0.6 else t) + (" 5 % " if rng.random() < 0.3 else ""))
    texts += [texts[12]] * 30 + [texts[14]] * 3 + [texts[12] + "."]
    docs = [(k, t, [None, "", "web", "hot"][min(3, k % 7)]) for k, t in enumerate(texts)]
    docs += [(20, texts[20], "web"), (20, "other text of the same id", "web"), (None, texts[12], "web"), (None, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 130, 2)] + [(20, 0, 0), (20, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def audit_brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        words = re.findall(WORD, t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, rows in parts.items():
        steps, sums = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                sums[f] += len(gone)
                steps.append((f, (part, "".join(order), step + 1, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out += [(*row, sums[f]) for f, row in steps]
    return sorted(out, key=repr)


def test_filter_audit(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame([(i, t, s, 1, "w", "r", 1, 1, 1) for i, t, s in docs], DOCS).repartition(3)
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit(table, marks)
    assert found(got, "part", "filter_order", "step", *filter_audit.COUNTS) == audit_brute(docs, labels)
    assert filter_audit.audit(table.limit(0), marks.limit(0)).count() == 0
    clean = table.where("doc_id = 6").withColumn("text", F.lit(" ".join(f"w{k}" for k in range(300))))  # fails nothing: all tables of failing ids are empty
    assert found(filter_audit.audit(clean, marks.limit(0)).select("kept", "removed").distinct(), "kept", "removed") == [(1, 0)]


def pages_rows():
    rng = random.Random(6)
    html = ["<p>" + "".join(rng.choice("abé\r\n ") for _ in range(rng.randint(1, 4000))) for _ in range(60)]
    html += ["WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60, "\r\n\r\nWARC/1.1\r\n" * 100, "x" * 1000, "x" * 999, "", None, "é" * 500, "𝒳" * 200_000]
    html += [html[0]] * 3 + ["x" * 1000, "x" * 999, "x" * 1000] + ["<p>" + "copy " * 400] * 1500
    urls = [None, "", "https://www.Example.org:8080/a?b=C#d", "http://user@b.example.org/x\r\ny", "ftp://example.org", "https://hot.example.org/"]
    rows = [(k, urls[k % 6] if k % 4 else f"https://s{k % 7}.example.org/{k}", t) for k, t in enumerate(html)]
    return rows + [(2, urls[5], html[2]), (2, urls[5], html[2]), (rows[-1][0], urls[5], html[-1]), (None, urls[5], html[3]), (None, None, None), (-5, None, html[1])]


def warc_brute(rows):
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", i))
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        top = last.get(t or "")
        again = len(data) >= 1000 and top is not None and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ROW = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2) for i, u, h in pages_rows()], PAGES).repartition(4)


@pytest.mark.parametrize(("archive_bytes", "compression"), [(50_000, "none"), (64 << 20, "gzip")])
def test_warc_round_trip(spark, pages, tmp_path, archive_bytes, compression):
    path = str(tmp_path / "archives")
    warc.write_warc(pages, path, archive_bytes=archive_bytes, compression=compression)
    captures = warc.read_warc(spark, path, payloads=True)
    assert found(captures, *ROW) == warc_brute(pages_rows())
    html = {(i, (h or "").encode()) for i, _, h in pages_rows()}
    responses = captures.where("record_type = 'response'").collect()
    assert all((r.page_id, bytes(r.payload)) in html for r in responses)
    assert captures.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert {(r.page_id, r.url) for r in captures.collect()} == {(i, u and u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in pages_rows()}
    assert captures.select("archive").distinct().count() > (3 if archive_bytes < 1 << 20 else 0)


def test_warc_index_is_in_global_order(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    timed = pages.withColumn("seen", F.expr("timestamp_seconds(1600000000 - 60 * coalesce(page_id % 50, 0))"))
    warc.write_warc(timed, path, time_col="seen", archive_bytes=20_000)
    index = warc.merged_index(warc.read_warc(spark, path), range_rows=100).orderBy("range_no", "place").collect()
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in index]
    assert keys == sorted(keys) and len(keys) == len(pages_rows())
    assert len({r.range_no for r in index}) > 5 and len({r.archive for r in index}) > 3
    assert len({r.range_no for r in index if r.url_key == "org,example,hot)/"}) > 1  # a hot URL spans ranges
    assert {r.url_key for r in index} >= {"", "org,example)/a?b=C", "org,example,b)/x%0D%0Ay", "org,example)"}


def test_warc_records_stand_where_the_index_says(spark, pages, tmp_path):
    path = tmp_path / "archives"
    warc.write_warc(pages, str(path))
    for r in warc.read_warc(spark, str(path)).limit(40).collect():
        data = gzip.decompress((path / r.archive).read_bytes())[r.offset:]
        _, headers, block = next(warc.records(io.BytesIO(data)))
        assert headers["warc-record-id"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
        assert headers["warc-type"] == r.record_type
        assert r.record_type == "revisit" or hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).hexdigest() == r.payload_digest


def test_warc_dates_are_utc_in_any_session(spark, pages, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        warc.write_warc(pages, str(tmp_path / "archives"), compression="none")
        captures = warc.read_warc(spark, str(tmp_path / "archives"))
        wrong = captures.where(F.unix_timestamp("captured") != warc.EPOCH + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)))
        assert wrong.count() == 0 and captures.count() == len(pages_rows())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    text = b"".join(f.read_bytes() for f in (tmp_path / "archives").glob("part-*"))
    assert b"WARC-Record-ID: <urn:page:1>" in text and b"WARC-Date: 2020-01-01T00:00:01Z" in text


def test_warc_without_rows(spark, pages, tmp_path):
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.merged_index(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0


def test_broken_archives_are_refused():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    good = head % (hashlib.sha1(b"abc").hexdigest().encode(), len(http)) + http + b"\r\n\r\n"
    (at, headers, block), = warc.records(io.BytesIO(good))
    row = warc.capture(headers, block)
    assert (at, row["page_id"], row["payload_bytes"], row["captured"]) == (0, 1, 3, datetime(2020, 1, 1, tzinfo=UTC))
    assert warc.capture({"warc-type": "warcinfo"}, b"") is None
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(good[:-5])))
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(io.BytesIO(b"x" + good)))
    with pytest.raises(ValueError, match="digest"):
        warc.capture(headers, block.replace(b"abc", b"abd"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), n) for n in range(rng.choice([0, 1, 20]))) for _ in range(k)]
    runs = [sorted(r, key=lambda x: x[0]) for r in runs]
    want = sorted(((x[0], n, at, x) for n, r in enumerate(runs) for at, x in enumerate(r)), key=lambda y: y[:3])
    assert list(warc.LoserTree(runs, lambda x: x[0])) == [y[3] for y in want]
