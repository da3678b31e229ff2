import base64
import hashlib

from spectrel.llm import common, warc

SCHEMA = "page_id long, url string, html string, sha256 string, copy int"


def test_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é😀\r\n\r\nWARC-Type: revisit\r\n", "<p>a</p>", "b", "x" * 100_000]
    rows = [(i, f"http://h/{i}\r\n", t, "x", 1) for i, t in enumerate(html)] + [(6, "http://h/6", "b", "x", 1), (None, None, "<p>a</p>", "x", 1), (None, "u", "null id", "x", 1)]
    for least in (0, 2):
        folder = common.new_folder(spark, "warc-test")
        warc.write(spark.createDataFrame(rows, SCHEMA).select("page_id", "url", "html"), folder, least)
        got = warc.rebuilt(warc.read(spark, folder)).collect()
        assert len(got) == len(rows)
        again = {(r["page_id"], r["sha256"], r["copy"]): r for r in warc.opened(warc.rebuilt(warc.read(spark, folder))).collect()}
        assert len(again) == len(rows) and all(r["whole"] and bytes(r["header"]) == bytes(r["head"]) + b"\r\n" + bytes(r["http_head"]) + b"\r\n" for r in again.values())
        assert all((r["content"] is None) == (b"WARC-Type: revisit" in bytes(r["head"])) for r in again.values())
        assert all(r["content"] is None or hashlib.sha256(bytes(r["content"])).hexdigest() == r["sha256"] for r in again.values())
        assert any(b"WARC-Target-URI: http://h/0%0D%0A\r\n" in bytes(r["head"]) for r in again.values())
        payloads = [r["sha256"] for r in spark.read.parquet(f"{folder}/payloads").collect()]
        assert len(payloads) == len(set(payloads)) == len({(t or "") for _, _, t, _, _ in rows})
        for r in got:
            head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            content = body[: int(fields["Content-Length"])]
            assert body[len(content) :] == b"\r\n\r\n"
            payload = (next(t for i, _, t, _, _ in rows if i == r["page_id"] and hashlib.sha256((t or "").encode()).hexdigest() == r["sha256"]) or "").encode()
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            equal = [i for i, _, t, _, _ in rows if (t or "").encode() == payload]
            if fields["WARC-Type"] == "response":
                assert content.split(b"\r\n\r\n", 1)[1] == payload
                assert len(payload) < least or r["page_id"] == max((i for i in equal if i is not None), default=None)
            else:
                assert fields["X-Refers-To-Page-ID"] == str(max(i for i in equal if i is not None)) and content.endswith(b"\r\n\r\n")
        for data in {(t or "").encode() for _, _, t, _, _ in rows}:
            n = sum(bytes(r["header"]).startswith(b"WARC/1.1\r\nWARC-Type: response") for r in got if r["sha256"] == hashlib.sha256(data).hexdigest())
            assert n == 1 or len(data) < least


def test_empty_table(spark):
    folder = common.new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0
