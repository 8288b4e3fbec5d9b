"""One query per operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendweave.llm import (byte_bpe, exact_dedup, filter_audit, html_extract, lattice_lm, mixing, ngram_join, quality, sharding, spelling, token_files, vector_join,
                            warc)
from spendweave.llm.common import table
from spendweave.session import new_dir


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), new_dir(spark, "shards")
    column = sharding.write_shards(docs, path)
    return sharding.shard_report(sharding.read_shards(spark, path, docs.schema, column), column)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.merged_index(warc.read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_vector_join": op8_vector_join,
    "op9_html_extract": op9_html_extract,
    "op10_lattice_lm": op10_lattice_lm,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
}

ORACLES = {
    "op2_ngram_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words),
        grams AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
        FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_vector_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND list_dot_product(embedding, embedding) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM components LEFT JOIN counts USING (vec_id)""",
    "op5_sharding": f"""
        WITH rows AS (
            SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS h
            FROM documents),
        levels AS (SELECT d::INTEGER AS d FROM range(0, {sharding.HASH_BITS + 1}) t(d)),
        sums AS (
            SELECT d, h >> ({sharding.HASH_BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
            FROM rows, levels GROUP BY ALL
            HAVING sum(n_bytes) <= {sharding.SHARD_BYTES} OR min(h) = max(h)),
        found AS (
            SELECT doc_id, n_bytes, h, min(s.d) AS d
            FROM rows CROSS JOIN levels l JOIN sums s ON s.d = l.d AND s.prefix = h >> ({sharding.HASH_BITS} - l.d)
            GROUP BY ALL)
        SELECT doc_id, n_bytes, CASE WHEN f.d = 0 THEN '' ELSE lpad(bin(prefix), f.d, '0') END AS shard, f.d AS shard_depth,
               shard_bytes, shard_rows
        FROM found f JOIN sums s ON s.d = f.d AND s.prefix = h >> ({sharding.HASH_BITS} - f.d)""",
    "op11_spelling": r"""
        WITH RECURSIVE byte_sums AS (
            SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
            FROM range(0, 256) r(b)),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
            FROM documents),
        counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
        octets AS (
            SELECT id, run, n, list_transform(range(0, octet_length(encode(id || ':' || run))),
                lambda k: ('0x' || substr(hex(encode(id || ':' || run)), 2 * k + 1, 2))::BIGINT) AS o FROM counted),
        hashed AS (
            SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], o), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS h
            FROM octets, byte_sums),
        words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word,
                   sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
        gaps AS (SELECT word, n, k, substr(word, 1, k::INTEGER) || substr(word, k::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.k = b.k AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS top FROM near GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * w.n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * w.n THEN -top[1] END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS root, 0 AS depth FROM forms
            UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
        roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
        SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)""",
    "op12_filter_audit": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
        fails AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (len(w) < 200)::INTEGER + 2 * (100 * list_unique(w) < 50 * len(w))::INTEGER
                   + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INTEGER + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
                   + 16 * coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask
            FROM words LEFT JOIN marks USING (doc_id)),
        masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
        orders AS (
            SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
        steps AS (
            SELECT filter_order, k::INTEGER AS step, substr(filter_order, k::INTEGER, 1) AS f, 1 << (ascii(substr(filter_order, k::INTEGER, 1)) - 65) AS bit,
                   list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(filter_order, j::INTEGER, 1)) - 65))) AS before_or_null
            FROM orders, range(1, 6) r(k) WHERE length(filter_order) = 5),
        placed AS (SELECT * EXCLUDE before_or_null, coalesce(before_or_null, 0)::BIGINT AS used FROM steps),
        counts AS (
            SELECT part, filter_order, step, f,
                   coalesce(sum(n) FILTER (mask & (used + bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & used > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & used = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
            FROM masks, placed GROUP BY ALL)
        SELECT * EXCLUDE f, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counts""",
    "op13_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
        last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM payloads),
        kinds AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM response AS again FROM last)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN response END AS refers_to
        FROM kinds""",
}
