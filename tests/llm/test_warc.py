import hashlib
import random

from tessella.llm import warc


def brute(pages):
    first = {}
    for p, _, h in pages:
        b = (h or "").encode()
        first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= 100 and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out)


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = [None, "", "short", "x" * 99, "x" * 100, "é" * 50, "a\r\n\r\nb" * 40, "WARC/1.1\r\n\r\n" * 20, "z" * 300_000]
    pages = [(i, rng.choice(["http://a.com/x", "https://www.B.org/?b=2&a=1", None, "bad url", "http://[x"]), rng.choice(bodies)) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", warc.F.lit("clash"))
    index = warc.capture_index(df)
    rows = index.collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages)
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys)
    assert warc.capture_index(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    body = "y" * 200
    rows = warc.capture_index(spark.createDataFrame([(5, "u", body), (5, "u", body), (7, "u", body), (None, "u", body)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in rows) == [(-1, "response", None), (5, "response", None), (5, "response", None), (7, "revisit", 5)]


def test_archives(spark, tmp_path, monkeypatch):
    """Archives are bounded by bytes, every entry cuts its record out of its file, and many small ranges give one order."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "BUFFER", 7)
    rng = random.Random(4)
    pages = [(i, f"http://{rng.choice('abc')}.org/{rng.randint(0, 9)}", f"{rng.choice(['x', 'é'])}{i % 90}" * rng.choice([1, 30, 900])) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    rows = warc.capture_index(df, archives=str(tmp_path / "warc")).collect()
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == 400
    files = {r.file: open(r.file.removeprefix("file:"), "rb").read() for r in rows}
    assert len(files) > 5
    html = {p: h for p, _, h in pages}
    for r in rows:
        record = warc.record_of(files[r.file], r.offset, r.length).decode()
        assert f"<urn:x-page:{r.page_id}>" in record and record.endswith("\r\n\r\n")
        assert (html[r.page_id] in record) == (r.record_type == "response")
    whole = b"".join(warc.gzip.decompress(c) for c in files.values())
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == 400


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        sources = [sorted((str(rng.randint(0, 9)), "", rng.randint(0, 9)) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        merged = list(warc.LoserTree([iter(s) for s in sources]))
        assert merged == sorted(x for s in sources for x in s)


def test_url_key():
    assert warc.url_key("https://www.B.org/?b=2&a=1") == "org,b)/?a=1&b=2"
    assert warc.url_key(None) == ""
