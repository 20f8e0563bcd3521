"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is up to three kinds of records: the request, the response (or a revisit, which
refers to an earlier response of equal payload) and metadata. They name each other by
WARC-Concurrent-To; ``transactions`` joins them through it into one nested row a capture.
Archives are written and read by Spark's own file formats, so they can be in any store
that Spark reaches and a lost task leaves nothing half-written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm.common import cut, join_groups, likely_in, maybe_in, saved

CRLF = "\r\n"
#: Payloads of fewer bytes are stored again, whatever their copies.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of the payloads of one archive file, at most, unless one payload is larger; by size class, a power of SIZE_STEP.
FILE_BYTES, SIZE_STEP, LEAST_CLASS = 1 << 28, 1 << 6, 1 << 14


def one_line(value: Column) -> Column:
    """The value without line ends, which would end a header."""
    return F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")


def header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def record(kind: Column, id_: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """A WARC record without the line end after its last one."""
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", id_),
        header("WARC-Date", F.lit(DATE)),
        *headers,
        header("Content-Type", F.lit(content_type)),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )


def urn(id_: Column, n: Column) -> Column:
    """A capture's name: its page's id, and a number since ids may repeat."""
    return F.concat(F.lit("urn:x-capture:"), F.coalesce(one_line(id_), F.lit("")), F.lit(":"), n.cast("string"))


def record_name(name: Column, kind: str) -> Column:
    return F.concat(F.lit("<"), name, F.lit(f":{kind}>"))


def with_revisits(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``rows`` (id, n, payload) with ``refers_to``: the response record of the largest id among rows of equal payload, null for rows of that id and for small payloads.

    Equal payloads are found by their digests; of the rows, only those that may be revisits move.
    """
    keyed = rows.where(F.octet_length("payload") >= least).select("id", "n", F.sha2(F.col("payload").cast("binary"), 256).alias("k"))
    groups = cut(keyed.groupBy("k").agg(F.max(F.struct("id", "n")).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    found = join_groups(likely_in(keyed, "k", groups.select("k")), groups, "k", "size").where(~F.col("id").eqNullSafe(F.col("top.id")))
    again = cut(found.select(F.col("n").alias("again"), record_name(urn(F.col("top.id"), F.col("top.n")), "response").alias("refers_to")))
    marked = maybe_in(rows, "n", again.select("again"))
    first = marked.where("NOT __maybe").withColumn("refers_to", F.lit(None).cast("string"))
    some = marked.where("__maybe").join(again, F.col("n") == F.col("again"), "left").drop("again")
    return first.unionByName(some).drop("__maybe")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write each row of ``pages`` as request, response or revisit, and metadata records to gzipped archives in ``path``.

    Null html is an empty payload, a null url leaves the target out. Rows that repeat an
    id are captures of their own. Other columns are ignored; an empty table gives
    archives without records. An archive holds payloads of one size class only, as many
    as ``file_bytes`` has room for, so that reading one takes bounded memory.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    # Written once, so that the numbers in the records' names are the same wherever they are read.
    rows = saved(rows.withColumn("n", F.monotonically_increasing_id()), "pages")
    found = with_revisits(rows, least)
    name = urn(F.col("id"), F.col("n"))
    rows = found.select("id", "payload", "refers_to", name.alias("urn"), one_line(F.col("url")).alias("url"))
    ids = {kind: record_name(F.col("urn"), kind) for kind in ("request", "response", "metadata")}
    target = header("WARC-Target-URI", F.col("url"))
    concurrent = header("WARC-Concurrent-To", ids["response"])
    path_part = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    get = F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(CRLF + CRLF),
    )
    again = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))
    response = record(
        F.when(again, "revisit").otherwise("response"),
        ids["response"],
        [target, header("WARC-Payload-Digest", digest), header("WARC-Profile", F.when(again, PROFILE)), header("WARC-Refers-To", F.col("refers_to"))],
        "application/http;msgtype=response",
        F.when(again, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = record(F.lit("request"), ids["request"], [target, concurrent], "application/http;msgtype=request", get)
    fields = F.concat(header("captureId", one_line(F.col("id"))), header("hop", F.lit("seed")))
    metadata = record(F.lit("metadata"), ids["metadata"], [target, concurrent], "application/warc-fields", fields)
    text = F.concat(request, F.lit(CRLF), response, F.lit(CRLF), metadata)
    mode, lower = "overwrite", 0
    largest = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    while lower <= largest:
        upper = max(LEAST_CLASS, lower * SIZE_STEP)
        some = rows.where(F.octet_length("payload").between(lower, upper - 1)) if lower or largest >= upper else rows
        writer = some.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip")
        writer.option("maxRecordsPerFile", max(1, file_bytes // upper)).mode(mode).text(path)
        mode, lower = "append", upper


def parsed(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, gzipped (one member or many) or not."""
    raw = io.BytesIO(data)
    f = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := f.readline().rstrip(b"\r\n")) and line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        if "content-length" not in headers:
            raise ValueError("a WARC record has no Content-Length")
        size = int(headers["content-length"][0])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("date", pa.string()), ("target_uri", pa.string()),
        ("refers_to", pa.string()), ("file", pa.string()), ("ordinal", pa.int64()), ("http_start", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ]
)
RECORD_DDL = "record_id string, record_type string, concurrent_to array<string>, date string, target_uri string, refers_to string, file string, ordinal long, http_start string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def row(headers: dict[str, list[str]], block: bytes, file: str, ordinal: int, keep: bool) -> dict:
    """A record as a row of RECORD; sizes and digests are of the payload, for a revisit as its headers state them."""
    one = {k: v[0] for k, v in headers.items()}
    kind = one.get("warc-type", "")
    out = {
        "record_id": one.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "date": one.get("warc-date"),
        "target_uri": one.get("warc-target-uri"), "refers_to": one.get("warc-refers-to"), "file": file, "ordinal": ordinal, "fields": [],
    }
    payload = block
    if one.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        start, *rest = head.decode("utf-8", "replace").split(CRLF)
        out["http_start"] = start
        pairs = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in rest)}
        out["fields"] = list(pairs.items())
        if kind == "revisit" and "warc-payload-digest" in one:
            out["payload_digest"] = one["warc-payload-digest"].partition(":")[2]
            out["payload_bytes"] = int(pairs["content-length"]) if pairs.get("content-length", "").isdigit() else None
    elif one.get("content-type", "").startswith("application/warc-fields"):
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)
        out["fields"] = list({a.strip(): b.strip() for a, _, b in lines}.items())
    if "payload_digest" not in out:
        out |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
    return out | {"payload": payload if keep and kind != "revisit" else None}


def records(spark: SparkSession, path: str, payloads: bool = True, glob: str = "*gz") -> DataFrame:
    """One row per record of the archives in ``path``; without ``payloads`` only their size, digest and place.

    An archive is one task's; each is read as it streams out of its compressed bytes.
    Records that repeat an id are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, size = [], 0
                for k, (headers, block) in enumerate(parsed(data.as_py())):
                    out.append(row(headers, block, file, k, payloads))
                    size += len(block) if payloads else 0
                    if len(out) >= 2000 or size >= 1 << 23:
                        yield pa.RecordBatch.from_pylist(out, RECORD)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_DDL)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), requests, metadata.

    Requests and metadata name their response by concurrent_to, or a response names them;
    metadata may also name a request of the response. Records that lead to no response
    make a capture of their own with a null response. Records without an id are left out,
    since nothing can name them; concurrent_to ids that no record has are ignored. A
    record that names several responses belongs to the one of least id. Responses that
    repeat an id are captures of their own, each with all records that name the id;
    requests and metadata that repeat an id all belong to the id's capture.
    """
    # Records are needed several times; the archives are parsed once.
    rows = cut(found.where("record_id IS NOT NULL"))
    is_response = F.col("record_type").isin("response", "revisit")
    named = rows.select("record_id", is_response.alias("is_response"), F.explode("concurrent_to").alias("other"))
    responses = rows.where(is_response).select(F.col("record_id").alias("capture_id"))
    direct = named.where("NOT is_response").join(responses, F.col("other") == F.col("capture_id")).select("record_id", "capture_id")
    back = named.where("is_response").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    first = direct.unionByName(back).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    via = first.select(F.col("record_id").alias("other"), "capture_id")
    second = named.where("NOT is_response").join(via, "other").groupBy("record_id").agg(F.min("capture_id").alias("second_id"))
    members = rows.where(~is_response).join(first, "record_id", "left").join(second, "record_id", "left")
    members = members.withColumn("key", F.coalesce("capture_id", "second_id", "record_id")).drop("capture_id", "second_id")
    whole = F.struct(*[F.col(c) for c in found.columns])
    parts = members.groupBy("key").agg(
        F.collect_list(F.when(F.col("record_type") == "request", whole)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") != "request", whole)).alias("metadata"),
    )
    heads = rows.where(is_response).select(F.col("record_id").alias("head"), whole.alias("response"))
    joined = heads.join(parts, F.col("head") == F.col("key"), "full")
    none = F.filter(F.array(whole_null(found)), lambda _: F.lit(False))
    return joined.select(
        F.coalesce("head", "key").alias("capture_id"), "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )


def whole_null(found: DataFrame) -> Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields])
