"""WARC archives of pages, and the global index of their captures by merging locally sorted runs.

Writing: of captures with equal payloads (SHA-256) of ``REVISIT_BYTES`` or more, the one with the largest id is a
``response`` record, the others are ``revisit`` records without payload. Spark's text writer writes the records, each
ended by the empty line that the format asks for, so files appear only when their job commits. Payloads meet their
digest's group in as many partitions as give archives of ``ARCHIVE_BYTES``; digests with very many copies join by a
broadcast of at most ``HOT_SHARE`` rows, and their captures are dealt out as records without payload.

Reading: one archive a task at a time, by the lengths in the record headers, decompressed as a stream. Digests are
computed anew from the payloads and compared with the headers.

Index: the captures of each archive, sorted by (URL key, time, id), are a run. Runs are cut at the same bounds (range
partitions over the whole key, so that a URL with very many captures is cut too). In each range a loser tree
merges the runs' slices; ``range_no`` and ``place`` give the global order, in which a URL's captures stand
together, oldest first.

Defined results: ids are whole numbers; null html is the empty payload; a null URL has no target header and the empty key. A null id is
smaller than any other; rows that share the payload and the largest id are all responses. Without a column of
times a capture's time is ``EPOCH`` plus its id in seconds (null: 0). Extra columns are ignored. Line breaks in a
URL are written percent-encoded. A truncated or altered archive raises ``ValueError``. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm.common import HOT_SHARE, stored

REVISIT_BYTES = 1000
#: Payload bytes of an archive before compression, and captures of a range of the index.
ARCHIVE_BYTES, RANGE_ROWS = 64 << 20, 250_000
#: Bytes of a revisit record with its headers, about.
REVISIT_RECORD = 1000
EPOCH = 1_577_836_800  # 2020-01-01 in UTC
VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The host's labels in reverse, then path and query: ``https://www.a.org/x?y`` becomes ``org,a)/x?y``."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[^/?]*@)?([^/?:]*)", 1)), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest))


def _decided(pages: DataFrame, least_bytes: int, archive_bytes: int) -> DataFrame:
    """``pages`` (id, url, captured, payload, bytes, sha) with ``refers`` (null: a response) in partitions of ``archive_bytes``.

    Revisits come without payload.
    """
    narrow = stored(pages.select("id", "sha", "bytes"), "warc-digests")
    total, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    groups = narrow.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = stored(groups, "warc-groups")
    hot = F.broadcast(groups.where(F.col("copies") >= max(1000, math.ceil(total / HOT_SHARE))))
    hot_rows = groups.where(F.col("copies") >= max(1000, math.ceil(total / HOT_SHARE))).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / archive_bytes))

    refers = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    lean = [F.when(refers.isNull(), F.col("payload")).alias("payload"), refers.alias("refers")]
    kept = ["id", "url", "captured", "bytes", "sha"]
    many = pages.join(hot, "sha").select(*kept, *lean).repartition(max(1, math.ceil(hot_rows * REVISIT_RECORD / archive_bytes)))
    few = pages.join(hot.select("sha"), "sha", "left_anti").repartition(parts, "sha")
    few = few.join(groups.repartition(parts, "sha"), "sha", "left").select(*kept, *lean)
    return few.unionByName(many) if hot_rows else few


def _record(row: dict[str, Column]) -> Column:
    """The record's text up to the empty line after it. Absent headers are null and left out."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), header("Content-Length", F.col("bytes").cast("string")),
                     F.lit(CRLF), F.coalesce(F.col("payload"), F.lit("")))
    revisit = F.col("refers").isNotNull()
    lines = F.concat_ws(
        "", F.lit(VERSION + CRLF), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")), header("WARC-Record-ID", row["record"]),
        header("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")),
        header("WARC-Date", F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, header("WARC-Profile", F.lit(PROFILE))), F.when(revisit, header("WARC-Refers-To", row["refers"])),
        header("Content-Type", F.lit("application/http;msgtype=response")), header("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(lines, F.lit(CRLF), block)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None,
               least_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Writes a record for every row of ``pages`` into archives under ``path``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    seconds = F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(10**9)), F.lit(0))
    captured = F.col(time_col) if time_col else F.timestamp_seconds(seconds + EPOCH)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), captured.alias("captured"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.unhex(F.sha2("payload", 256))})
    # a revisit's SHA-1 is its response's, so it is computed before payloads are left out
    rows = rows.withColumn("url", F.struct("url", F.sha1("payload").alias("digest")))
    rows = _decided(rows, least_bytes, archive_bytes).select("id", "url.url", "url.digest", "captured", "payload", "bytes", "refers")
    record = _record({"record": _urn(F.col("id")), "refers": _urn(F.col("refers"))})
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def _headers(stream: Any) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in iter(stream.readline, b"\r\n"):
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not line.endswith(b"\r\n"):
            raise ValueError(f"broken header line {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream: Any) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of an uncompressed archive, one after another."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}: {line[:80]!r}")
        headers = _headers(stream)
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, headers, block
        at = stream.tell()


def capture(headers: dict[str, str], block: bytes) -> dict[str, Any] | None:
    """A record of this writer as a row; None for records of other types."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http = io.BytesIO(block)
    http.readline()
    size = int(_headers(http).get("content-length", -1))
    payload = http.read()
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if len(digest) == 32:
        digest = base64.b32decode(digest).hex()
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or size not in (-1, len(payload)):
            raise ValueError(f"the payload of {headers['warc-record-id']} does not fit its digest")
        size = len(payload)

    def page(name: str) -> int | None:
        number = headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {"page_id": page("warc-record-id"), "url": headers.get("warc-target-uri"), "captured": datetime.fromisoformat(headers["warc-date"]).astimezone(UTC),
            "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The captures of all archives under ``path``, with ``archive`` and ``offset`` (uncompressed); with ``payload`` if asked for."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    names = ["page_id", "url", "captured", "record_type", "payload_bytes", "payload_digest", "refers_to", "archive", "offset"]
    schema = ("page_id long, url string, captured timestamp, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"
              + (", payload binary" if payloads else ""))
    names += ["payload"] if payloads else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                raw = io.BytesIO(content.as_buffer())
                rows, held = [], 0
                for at, headers, block in records(gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw):
                    if row := capture(headers, block):
                        rows.append(row | {"archive": name.as_py(), "offset": at})
                        held += len(block) if payloads else 0
                    if held > ARCHIVE_BYTES // 8:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(read, schema)


_TYPES = {"captured": pa.timestamp("us", "UTC"), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES.get(n, pa.string())) for n in names], names=names)


class LoserTree:
    """Merges k sorted sequences: inner nodes hold the loser of their match, so the next winner replays one path."""

    def __init__(self, runs: list[list], key: Callable[[Any], Any]):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [self._head(k) for k in range(self.size)]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _head(self, k: int) -> Any:
        """The key of run k's next element; None behind its end."""
        return self.key(self.runs[k][self.at[k]]) if k < len(self.runs) and self.at[k] < len(self.runs[k]) else None

    def _before(self, a: int, b: int) -> bool:
        """Whether run a goes first. Equal keys go by run, ended runs last."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator[Any]:
        while self.runs and self.heads[self.winner] is not None:
            k = self.winner
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self.heads[k] = self._head(k)
            node = (k + self.size) // 2
            while node:
                if self._before(self.losers[node], k):
                    k, self.losers[node] = self.losers[node], k
                node //= 2
            self.winner = k


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The captures of each archive in the order of the index, written as one run: ``place`` grows along it.

    An archive is read by one task, so its run needs a local sort only.
    """
    keyed = captures.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("archive", "url_key", "captured", "page_id")
    return stored(keyed.withColumn("place", F.monotonically_increasing_id()), "warc-runs")


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order: ``range_no``, then ``place`` in the range."""
    runs = sorted_runs(captures)
    ranges = max(1, math.ceil(runs.count() / range_rows))
    names = [c for c in runs.columns if c != "place"]
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    dealt = dealt.withColumn("range_no", F.spark_partition_id()).sortWithinPartitions("archive", "place").select(*names, "range_no")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys = list(zip(table.column("url_key").to_pylist(), table.column("captured").cast(pa.int64()).to_pylist(),
                        [(i is not None, i or 0) for i in table.column("page_id").to_pylist()], strict=True))
        slices: dict[str, list[int]] = {}
        for row, archive in enumerate(table.column("archive").to_pylist()):
            slices.setdefault(archive, []).append(row)
        order = list(LoserTree(list(slices.values()), keys.__getitem__))
        yield from table.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int32())).combine_chunks().to_batches()

    return stored(dealt.mapInArrow(merge, ", ".join(f"{c} {dict(dealt.dtypes)[c]}" for c in [*names, "range_no"]) + ", place int"), "warc-index")
