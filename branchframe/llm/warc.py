"""WARC: write pages as request, response or revisit, and metadata records; read archives back.

Archives are written by Spark's text writer: a record's last four bytes (CRLF CRLF) are the line
separator, so each part file is a WARC file in gzip, on any file system Spark can write to. They
are read by length (Content-Length), never by searching for a separator, so a payload may hold
anything. Records are then assembled into transactions: requests and metadata name their response
or revisit in WARC-Concurrent-To, and each capture becomes one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, fresh_path, materialise, small_batches

#: Bytes of payload in an archive, about: a reader holds one archive, compressed, at a time.
ARCHIVE_BYTES = 8 << 20
#: What the largest pages could fill an archive with at most: a file is read as one value, which has a limit of 2 GB.
MOST_BYTES = 1 << 30

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "record_id string, kind string, concurrent_to string, refers_to string, uri string, digest string, length bigint, page_id bigint, payload binary"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _RECORDS.split(", "))])


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, in SQL functions: 40 bits at a time by way of base 32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    """A record id from what it is made of."""
    code = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    cut = [F.substring(code, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record without its last CRLF CRLF; a header with a null value is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, its SHA-256, its base32 SHA-1 digest and its length."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"),
    )
    base = base.withColumns({"sha": F.unhex(F.sha2(F.col("payload").cast("binary"), 256)), "digest": base32_sha1(F.col("payload").cast("binary")), "length": F.octet_length("payload").cast("bigint")})
    return base


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_from: int = 0) -> None:
    """Write each page as a request, a response or revisit, and a metadata record under ``path``.

    Of pages with equal payloads of at least ``revisit_from`` bytes, the largest (page_id, url) is
    the response; the others are revisits without payload that refer to it. Only payloads that
    occur more than once are joined back, so the payloads are shuffled only if those are many.
    """
    base = captures(pages, id_col, url_col, html_col)
    groups = base.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("win"), F.count("*").alias("n"), F.max("length").alias("size"))
    size, largest = base.agg(F.avg("length"), F.max("length")).first()
    repeated = materialise(groups.filter((F.col("n") > 1) & (F.col("size") >= revisit_from)).select("sha", "win"), "repeated-payloads")
    rows = base.join(repeated, "sha", "left")
    own = F.struct("page_id", "url")
    revisit = F.coalesce(~F.col("win").eqNullSafe(own), F.lit(False)) & F.col("win").isNotNull()
    rid = lambda kind, at: _uuid(F.lit(kind), F.col(f"{at}page_id"), F.col(f"{at}url"), F.hex("sha"))
    target = ("WARC-Target-URI", F.col("url"))
    when = ("WARC-Date", F.lit(date))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), rid("main", ""),
        [target, when, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, rid("main", "win."))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    request = _record("request", rid("request", ""), [target, when, ("WARC-Concurrent-To", rid("main", "")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", rid("metadata", ""), [target, when, ("WARC-Concurrent-To", rid("main", "")), ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    end = F.lit("\r\n\r\n")
    lines = rows.select(F.concat(request, end, main, end, metadata).alias("value"))
    most = max(1, min(100_000, int(ARCHIVE_BYTES / max(1.0, size or 1)), MOST_BYTES // max(1, largest or 1)))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    discard(repeated)


def parse_archive(content: bytes):
    """(headers, block) of each record of a WARC file, in gzip (one or many members) or plain."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


def _row(headers: dict, block: bytes, keep_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    digest = length = page = payload = None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        else:
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            fields = dict(x.split(b":", 1) for x in head.split(b"\r\n")[1:])
            length = int(fields.get(b"Content-Length", b"0"))
        payload = payload if keep_payload else None
    elif kind == "metadata":
        fields = dict(x.split(b":", 1) for x in block.split(b"\r\n") if b":" in x)
        page = int(fields[b"page-id"]) if b"page-id" in fields else None
    elif kind == "request":
        payload = block if keep_payload else None
    return headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, length, page, payload


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; digests and lengths of responses come from the payload bytes read."""
    small_batches(spark)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_archive(content.as_py()):
                    rows.append(_row(headers, block, payloads))
                    held += len(block) if payloads else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, copies.

    Requests and metadata join the response or revisit that they are concurrent to. Equal captures
    (same page, URL and payload) share a record id and count as copies. Requests and metadata whose
    response is missing are left out; a response without them has nulls.
    """
    part = records.withColumn("capture_id", F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")))
    main = F.col("kind").isin("response", "revisit")
    one = lambda test, *fields: F.max(F.when(test, F.struct(*fields)))
    return (
        part.filter("capture_id is not null").groupBy("capture_id")
        .agg(
            one(main, "kind", "uri", "digest", "length", "refers_to", "payload").alias("response"),
            one(F.col("kind") == "request", "record_id", "uri", "payload").alias("request"),
            one(F.col("kind") == "metadata", "record_id", "page_id").alias("metadata"),
            F.count(F.when(main, 1)).alias("copies"),
        )
        .filter("response is not null")
    )


def warc_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble, and return one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload,
    null urls are empty. Pages that repeat the page_id, URL and payload of the response are
    responses too. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    if pages.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    write_archives(pages, path, revisit_from=revisit_from)
    nested = materialise(assemble(read_archives(spark, path, payloads=False)), "captures")
    gone = spark.read.text(path)
    gone.shared_path = path
    discard(gone)
    targets = nested.filter("response.kind = 'response'").select(F.col("capture_id").alias("target"), F.col("metadata.page_id").alias("target_page"))
    revisits = nested.filter("response.kind = 'revisit'").join(targets, F.col("response.refers_to") == F.col("target"), "left")
    every = nested.filter("response.kind = 'response'").withColumn("target_page", F.lit(None).cast("bigint")).unionByName(revisits.drop("target"))
    return every.select(
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        F.col("metadata.page_id").alias("page_id"), F.col("response.length").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("target_page").alias("refers_to"),
    ).drop("copy")
