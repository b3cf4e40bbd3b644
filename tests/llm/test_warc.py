import hashlib
import random

from tidemark.llm import warc


def test_read_back(spark, tmp_path):
    rng = random.Random(3)
    big = "".join(rng.choice("añ\n\r€🙂<p>") for _ in range(40_000))
    pages = [(1, "http://a/\r\nb", big), (2, "u", big), (9, "u", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "WARC/1.1\r\n\r\n"), (8, "u", "é" * 700 + "\n"), (8, "u", "é" * 700 + "\n"), (None, "u", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    rows = warc.archive_and_read(df, chunk=1000).collect()
    assert len(rows) == len(pages)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max((p[0] or -1) for p in pages if (p[2] or "") == (html or ""))
        refers = top if len(data) >= 1000 and (i is None or i < top) else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_chunks_are_bounded_and_whole(spark, tmp_path):
    html = "€" * 5000 + "\n" + "b" * 5000
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(df), path, 1024)
    rows = warc.read_chunks(spark, path).orderBy("chunk_number").collect()
    assert len(rows) > 10 and max(len(r["chunk"]) for r in rows) <= 1024
    assert b"".join(bytes(r["chunk"]) for r in rows).decode() == html
    so_far = b""
    for r in rows:
        so_far += bytes(r["chunk"])
        assert r["digest_so_far"] == hashlib.sha1(so_far).hexdigest() and r["bytes_so_far"] == len(so_far)
