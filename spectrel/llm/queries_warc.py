from pyspark.sql import functions as F

from spectrel.llm import common, warc


def op6_warc(spark, sf_dir):
    folder = common.new_folder(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), folder, least=0)
    # every record is put together again, and what is returned is read from its bytes; a revisit's payload is that of its response
    found = warc.opened(warc.rebuilt(warc.read(spark, folder)))
    head = F.col("head")
    digest = F.concat(F.lit("sha1:"), warc.base32(F.coalesce(F.sha1("content"), F.col("payload_sha1"))))
    return found.select(
        warc.field(head, "X-Page-ID").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("content").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.substring(digest, 6, 32).alias("payload_digest"),
        warc.field(head, "WARC-Type").alias("record_type"),
        warc.field(head, "X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        (F.col("whole") & (digest == warc.field(head, "WARC-Payload-Digest")) & (warc.field(F.col("http_head"), "Content-Length").cast("long") == F.coalesce(F.octet_length("content").cast("long"), F.col("payload_bytes")))).alias("verified"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT t, max(page_id) AS r FROM p GROUP BY t),
d AS (SELECT p.page_id, p.t, g.r, list_transform(range(0, 8), lambda k: CAST(('0x' || substr(p.s, CAST(1 + 5 * k AS INTEGER), 5)) AS INTEGER)) AS v FROM p JOIN g ON p.t = g.t)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 15) % 32 + 1 AS INTEGER), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 10) % 32 + 1 AS INTEGER), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 5) % 32 + 1 AS INTEGER), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to, TRUE AS verified
FROM d
"""
