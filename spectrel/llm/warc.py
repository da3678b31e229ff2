"""Content-addressed WARC archive.

An archive is a folder with two tables. `payloads` holds each distinct payload once: sha256, payload, checked against its
digest when read. `headers` holds each record's exact header bytes (WARC and, for responses, HTTP), its ids and the sha256 of its
payload. The original records come back by a join of both on the digest: header bytes, payload (of responses; revisits have
none of their own), and the closing blank lines.

Of the records with equal payloads of at least `least` bytes, the one with the largest page_id is the response, all others
revisit it; smaller payloads are all responses. Null html is an empty payload. Of repeated rows (same page_id and payload) only
one is the response. Null page_ids count as smallest. An empty table gives an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: All records of an archive carry one date, a parameter, so that equal input gives equal bytes.
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits (SHA-1): five at a time are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, sha256, payload_bytes, copy, record_type, refers_to of each record; the payloads themselves are not moved."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.base64(F.unhex(F.sha1(payload))).alias("sha1"))
    keys = keys.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "sha256").orderBy("url")))
    first = keys.groupBy("sha256").agg(F.max("page_id").alias("response"))
    joined = keys.join(first, "sha256")
    revisit = (F.col("payload_bytes") >= least) & ~(F.col("page_id").eqNullSafe(F.col("response")) & (F.col("copy") == 1))
    return joined.select("page_id", "url", "sha256", "sha1", "payload_bytes", "copy", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_id(page_id: Column, copy: Column) -> Column:
    name = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def header(record: DataFrame, date: str = DATE) -> Column:
    """The exact bytes of a record up to its payload."""
    is_revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    # line ends would end the field; they stand as in a URL
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    digest = base32(F.lower(F.hex(F.unbase64("sha1"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), line("Content-Type", F.lit("text/html; charset=UTF-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    body = F.when(is_revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    return F.encode(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", record_id(F.col("page_id"), F.col("copy"))),
            line("WARC-Target-URI", url),
            line("WARC-Date", F.lit(date)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("refers_to"), F.lit(1))))).otherwise(""),
            line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
            F.when(is_revisit, line("X-Refers-To-Page-ID", F.coalesce(F.col("refers_to").cast("string"), F.lit("")))).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", body.cast("string")),
            F.lit(CRLF),
            http,
        ),
        "UTF-8",
    )


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write the archive of pages(page_id, url, html) to a new folder of a shared store."""
    from spectrel.llm import common

    found = common.cut(records(pages, least))
    found.select("page_id", "copy", "sha256", header(found).alias("header")).write.parquet(f"{folder}/headers")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))  # noqa: E731  a null page_id is the smallest
    kept = found.where("record_type = 'response'").groupBy("sha256").agg(F.max(number("page_id")).alias("own_id")).withColumnRenamed("sha256", "own_sha")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    source = pages.select(number("page_id").alias("own_id"), payload.alias("payload")).withColumn("own_sha", F.sha2("payload", 256))
    # by page_id as well as digest, so that a payload that many pages share is no hot key
    stored = source.join(kept, ["own_id", "own_sha"], "left_semi")
    stored.dropDuplicates(["own_id", "own_sha"]).select(F.col("own_sha").alias("sha256"), "payload").write.parquet(f"{folder}/payloads")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: page_id, copy, header, sha256, payload (null if no stored payload has the digest that is verified
    here), payload_bytes, payload_sha1 (hex)."""
    payloads = spark.read.parquet(f"{folder}/payloads").where(F.sha2("payload", 256) == F.col("sha256"))
    payloads = payloads.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    return spark.read.parquet(f"{folder}/headers").join(payloads, "sha256", "left")


def rebuilt(found: DataFrame) -> DataFrame:
    """Adds record: the exact bytes of each original record."""
    is_revisit = field(F.col("header"), "WARC-Type") == "revisit"
    return found.withColumn("record", F.concat("header", F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((CRLF + CRLF).encode())))


def opened(records: DataFrame) -> DataFrame:
    """Reads the records of rebuilt() again, from their bytes alone: adds head (the record's own header), http_head, content (the payload of
    a response, null for a revisit) and whole: the bytes are as many as Content-Length says, and close with two line ends."""
    text = F.decode("record", "ISO-8859-1")  # one character for each byte
    split = F.instr(text, CRLF + CRLF)
    rows = records.withColumn("head", F.encode(F.substring(text, F.lit(1), split + 1), "ISO-8859-1"))
    begin = F.octet_length("head") + 3  # of the content, from 1
    length = field(F.col("head"), "Content-Length").cast("long")
    rows = rows.withColumn("whole", (F.octet_length("record") == F.octet_length("head") + 2 + length + 4) & (F.expr("substring(record, octet_length(record) - 3, 4)") == F.lit((CRLF + CRLF).encode())))
    body = F.substring(text, begin, length.cast("int"))
    inner = F.instr(body, CRLF + CRLF)
    rows = rows.withColumn("http_head", F.encode(F.substring(body, F.lit(1), inner + 1), "ISO-8859-1"))
    content = F.encode(F.substring(body, inner + 4, length.cast("int")), "ISO-8859-1")
    return rows.withColumn("content", F.when(field(F.col("head"), "WARC-Type") == "response", content))


def field(head: Column, name: str) -> Column:
    """A header field's value, null without it."""
    value = F.regexp_extract(F.decode(head, "UTF-8"), f"(?:^|\\n){name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(value != "", value)
