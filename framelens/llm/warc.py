"""WARC archives written from and read into DataFrames, with revisits in place of repeated payloads.

Repeats are found by shuffling headers, never payloads, by payload digest. Of records with equal payloads
the one with the smallest id is the response; the others become revisit records that refer to it and carry
no payload. Reading an archive back, revisits are joined to their responses by digest, so each record gets
its full payload's size and digest again.

Archives are plain WARC/1.1 files, compressed as whole files, of a bounded number of payload bytes. Spark
writes and reads them, so they may lie in any store that Spark reaches.

Nulls: a null payload is empty, a null url has no target header, a null id is a record without an id; null
ids come after all others. Repeated ids are separate records; rows equal in id, url and payload are one
record that is written as often as it is given, each time in the same role. Payloads under `least` bytes are never
revisits. An empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import spread, stored

# Fixed value: the profile of a revisit found by its payload's digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
ARCHIVE_BYTES = 16 << 20
SALTS = 64
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to_record string, "
    "refers_to_digest string, payload_digest string, payload_bytes long, payload binary"
)


def records(pages: DataFrame) -> DataFrame:
    """Payload, size, digest and record id of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(payload, 256)
    return pages.select(
        "page_id",
        "url",
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws("|", _or_none("page_id"), _or_none("url"), digest), 256)).alias(
            "record_id"
        ),
    )


def _or_none(name: str) -> Column:
    """The value as text, told apart from a missing one."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("none"))


def revisits(rows: DataFrame, least: int = 100) -> DataFrame:
    """record_id of every revisit, refers_to (the response's page_id) and that response's record id.

    A digest may be that of a third of all rows: its headers are dealt over salts and each salt summed up.
    """
    order = F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1))
    heads = rows.where(F.col("payload_bytes") >= least).select(
        "payload_digest",
        spread("record_id", ways=SALTS).alias("salt"),
        F.struct(order.alias("order"), "record_id", "page_id").alias("head"),
    )
    parts = heads.groupBy("payload_digest", "salt").agg(F.min("head").alias("head"), F.count("*").alias("n"))
    first = (
        parts.groupBy("payload_digest")
        .agg(F.min("head").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
        .where("n > 1")
        .select("payload_digest", "first", F.explode("salts").alias("salt"))
    )
    return (
        heads.join(first, ["payload_digest", "salt"])
        .where("head.record_id != first.record_id")
        .select(
            F.col("head.record_id").alias("record_id"),
            F.col("first.page_id").alias("refers_to"),
            F.col("first.record_id").alias("refers_to_record"),
        )
        .distinct()
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in as many parts as archives of about ARCHIVE_BYTES take, by a hash of the record id: a large
    group of copies does not land in one part, and payloads move once, to where revisits are joined too."""
    total = rows.agg(F.sum("payload_bytes")).first()[0] or 0
    return rows.repartition(-(-total // ARCHIVE_BYTES) or 1, "record_id")


def with_revisits(rows: DataFrame, least: int = 100) -> DataFrame:
    """Rows dealt to archives, with refers_to and refers_to_record; both null for responses."""
    return dealt(rows).join(revisits(rows, least), "record_id", "left")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that are not null. Control signs in values, as in urls, are escaped."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20"), F.lit("\r\n"))
        for name, value in fields
    ]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def write_archive(rows: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row, with headers made anew; one archive per part of the rows, as from
    with_revisits, html in full."""
    revisit = F.col("refers_to_record").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit(HTTP), _lines(("Content-Length", F.octet_length(body))), F.lit("\r\n"))
    block = F.concat(http, body)
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
        ("X-Page-ID", F.col("page_id")),
    )
    # The writer ends every row by one line feed, the last sign of a record's closing blank lines.
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block, F.lit("\r\n\r"))
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _field_map(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive, in the columns of RECORDS; lengths are taken from the headers."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while True:
        head = bytearray()
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError("the archive ends within a header")
                return
            if head or line.strip():  # blank lines between records
                head += line
        fields = _field_map(bytes(head[:-4]))
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = fields["warc-type"] == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if not revisit and digest != hashlib.sha256(payload).hexdigest():
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        page = fields.get("x-page-id")
        yield (
            fields["warc-record-id"].strip("<>"),
            None if page is None else int(page),
            fields.get("warc-target-uri"),
            fields["warc-type"],
            fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            digest if revisit else None,
            None if revisit else digest,
            None if revisit else len(payload),
            payload,
        )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below the path. Without payloads, that column is null."""
    schema = pa.schema(
        [
            (name, {"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.string()))
            for name, kind in (c.split() for c in RECORDS.split(", "))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch[0]:
                rows = []
                for row in parse_archive(content.as_py()):
                    rows.append(row if payloads else (*row[:-1], None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def resolved(read: DataFrame) -> DataFrame:
    """Records read back, revisits joined to their responses by digest: both get the payload's size,
    digest, and refers_to, the response's page_id (null for responses)."""
    heads = read.drop("payload")
    responses = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"),
        F.col("payload_digest").alias("refers_to_digest"),
        F.col("payload_bytes").alias("bytes_"),
        F.col("page_id").alias("refers_to"),
    ).distinct()
    # A record with revisits may have many; the response's row is dealt to the salts that they use.
    revisits = heads.where("record_type = 'revisit'").withColumn("salt", spread("record_id", ways=SALTS))
    wanted = revisits.select("refers_to_digest", "refers_to_record", "salt").distinct()
    given = wanted.join(responses, ["refers_to_digest", "refers_to_record"])
    joined = revisits.drop("payload_bytes", "payload_digest").join(
        given, ["refers_to_digest", "refers_to_record", "salt"], "left"
    )
    columns = ["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return (
        heads.where("record_type = 'response'")
        .withColumn("refers_to", F.lit(None).cast("long"))
        .select(*columns)
        .unionByName(
            joined.withColumn("payload_bytes", F.col("bytes_")).withColumn("payload_digest", F.col("refers_to_digest")).select(*columns)
        )
    )


def archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write the pages as deduplicated archives."""
    write_archive(with_revisits(records(pages), least), path)


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 100) -> None:
    """Read archives, with or without revisits in them, and write them anew without repeated payloads."""
    read = stored(read_archive(spark, source), "records")
    rows = resolved(read).drop("refers_to")
    bodies = read.where("record_type = 'response'").select("record_id", F.col("payload").cast("string").alias("html"))
    # An old revisit has no body of its own; its response, which has, comes from the same archives and
    # has the same digest, so the response of the new archive is chosen among those with a body.
    found = with_revisits(rows.join(bodies.select("record_id"), "record_id", "left_semi"), least)
    held = found.join(bodies, "record_id")
    first = found.where("refers_to_record is null and payload_bytes >= %d" % least).select(
        "payload_digest", F.col("page_id").alias("refers_to"), F.col("record_id").alias("refers_to_record")
    )
    old = rows.where("record_type = 'revisit'").join(first, "payload_digest", "left").withColumn("html", F.lit(""))
    write_archive(held.unionByName(old), target)
