"""A content-addressed archive of WARC records: payloads are stored once by digest, exact record headers apart from them.

Folders below the archive's path: `headers` (one row a record, with the header's bytes as written, WARC and HTTP) and `payloads` (one
row a digest, bucketed by it, so that a join moves headers and not payloads). Records are rebuilt by joining the two.
"""

from __future__ import annotations

import math
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import new_folder, shared_table, type_of

CRLF = "\r\n"
END = CRLF * 2
#: What a null id is in a record's name; no encoded id has it.
NO_ID = "!"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page.cast("string")), F.lit(NO_ID)), F.lit(":"), row.cast("string"), F.lit(">"))


def payload_table(path: str) -> str:
    """The name under which an archive's payloads are known to the session as a bucketed table."""
    return f"orrery_payloads_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def write_archive(pages: DataFrame, path: str, least_bytes: int = 1000, date: datetime | None = None, bucket_bytes: int = 32 << 20) -> None:
    """Write one record for each row of `pages` (page_id of any type, url, html), dated `date` (null: now).

    The payload is the html in UTF-8 (null: empty). Of the records with equal payloads of at least `least_bytes` bytes, that with
    the largest page_id (of several, the last read; null ids come before all others) is a response and the others revisit it; all
    smaller ones are responses. Equal payloads are told by SHA-256 and length. An empty table gives an archive without records; other
    columns are not archived.
    """
    spark = pages.sparkSession
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    slim = shared_table(rows.select("row", "page_id", "url", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("digest")), "records")
    last = F.max(F.struct("page_id", "row"))
    winners = slim.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(last.alias("w"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "w")
    winners = shared_table(winners, "winners")  # written, so that the join can split a payload that a third of all rows have
    told = slim.join(winners, ["digest", "bytes"], "left")
    revisit = F.col("w").isNotNull() & (F.col("row") != F.col("w.row"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    block = F.octet_length(http).cast("long") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", F.lit(when)),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("w.page_id"), F.col("w.row")))).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    told.select("row", "digest", "bytes", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    # the hash of equal digests is the same on the map side, so each task sends a digest's payload once
    store = rows.select(F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), "payload").groupBy("digest").agg(F.first("bytes").alias("bytes"), F.first("payload").alias("payload"))
    total = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    spark.sql(f"DROP TABLE IF EXISTS {payload_table(path)}")
    store.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{path}/payloads").format("parquet").saveAsTable(payload_table(path))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payloads, as a bucketed table if this session wrote them, else as files."""
    name = payload_table(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records' fields, read from the headers' bytes: page_id, record_type, refers_to, declared sha1, declared bytes of the block and
    of the payload, bytes of the HTTP header; and with them digest, bytes, and the header."""
    text = F.decode("header", "UTF-8")
    take = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    name = lambda field: F.url_decode(F.nullif(take(rf"\r\n{field}: <urn:page:([^:>]*):"), F.lit(NO_ID))).cast(id_type)
    return spark.read.parquet(f"{path}/headers").select(
        "row",
        name("WARC-Record-ID").alias("page_id"),
        take(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"),
        name("WARC-Refers-To").alias("refers_to"),
        take(r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]+)\r\n").alias("declared_sha1"),
        take(r"\r\nContent-Length: (\d+)\r\n\r\nHTTP/").cast("long").alias("block_bytes"),
        take(r"\r\nContent-Length: (\d+)\r\n\r\n$").cast("long").alias("declared_bytes"),
        F.length(take(r"\r\n\r\n(HTTP/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n)$")).cast("long").alias("http_bytes"),
        "digest",
        "bytes",
        "header",
    )


def read_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The original records: the headers' fields and `record`, its bytes: header, payload (none for revisits) and two line ends."""
    heads = read_headers(spark, path, id_type)
    whole = F.col("record_type") == "response"
    end = F.encode(F.lit(END), "UTF-8")
    full = heads.where(whole).join(_payloads(spark, path).select("digest", "payload"), "digest")
    alone = heads.where(~whole).withColumn("record", F.concat("header", end))
    return full.withColumn("record", F.concat("header", "payload", end)).drop("payload").select(*alone.columns).unionByName(alone)


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the rebuilt records say: page_id, payload_bytes, payload_digest (SHA-1), record_type, refers_to, sound.

    A response's payload is as many bytes after its header as the header declares; a revisit's length and digest are those of the
    response with its payload. `sound` tells that the bytes still give both digests that were written for them, and that the lengths
    that the header declares, of the block and of the payload, are those of the record.
    """
    records = read_records(spark, path, id_type)
    body = F.substring(F.col("record"), F.octet_length("header") + 1, F.col("declared_bytes").cast("int"))
    size = F.octet_length(body).cast("long")
    there = F.octet_length("record") - F.octet_length("header") - len(END)
    lengths = (F.col("declared_bytes") == there) & (F.col("block_bytes") == F.col("http_bytes") + there)
    whole = F.col("record_type") == "response"
    told = records.where(whole).select("row", "page_id", "digest", size.alias("payload_bytes"), F.sha1(body).alias("payload_digest"), "record_type", "refers_to", ((F.sha1(body) == F.col("declared_sha1")) & (F.sha2(body, 256) == F.col("digest")) & F.coalesce(lengths, F.lit(False))).alias("sound"))
    told = shared_table(told, "responses")
    revisits = read_headers(spark, path, id_type).where(~whole).select("page_id", "record_type", "refers_to", "digest", "declared_sha1", "declared_bytes", (F.col("block_bytes") == F.col("http_bytes")).alias("empty"))
    # each payload that is revisited has one response
    seen = told.join(revisits.select("digest").distinct(), "digest", "left_semi").select("digest", "payload_bytes", "payload_digest", "sound")
    seen = shared_table(seen, "revisited")
    agrees = F.col("sound") & F.col("empty") & (F.col("payload_digest") == F.col("declared_sha1")) & (F.col("payload_bytes") == F.col("declared_bytes"))
    of_revisits = revisits.join(seen, "digest", "left").withColumn("sound", F.coalesce(agrees, F.lit(False)))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
    return told.select(*columns).unionByName(of_revisits.select(*columns))


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write `pages` to a new archive in the shared folder and read its records back; nulls, ties and repeated rows as in
    write_archive()."""
    spark = pages.sparkSession
    path = f"{new_folder(spark)}/archive"
    write_archive(pages, path, least_bytes)
    return read_archive(spark, path, type_of(pages, "page_id"))
