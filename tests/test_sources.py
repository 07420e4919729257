"""File sources: broken records, shapes, archives and resumed appends."""

from __future__ import annotations

import gzip
import json

from textloom.sources import text_files


def test_json_lines_skip_broken_ones_and_pick_the_text(spark, tmp_path):
    lines = ['{"id": 1, "text": "a"}', "{broken", '{"id": 2, "text": " ", "content": "b"}', '{"id": 3, "body": "c", "other": [1]}', '{"id": 4}']
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as out:
        out.write("\n".join(lines))
    got = sorted(tuple(r) for r in text_files.json_lines(spark, str(tmp_path)).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, None)]


def test_json_arrays_of_either_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "sample": "x"}, {"id": 2, "text": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps({"samples": [{"id": 3, "text": "z\nz"}]}))
    assert sorted(tuple(r) for r in text_files.json_arrays(spark, str(tmp_path)).collect()) == [(1, "x"), (2, "y"), (3, "z\nz")]


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,"a ""b""\nc"\n2,d\n3')
    assert sorted(tuple(r) for r in text_files.csv_rows(spark, str(tmp_path)).collect()) == [(1, 'a "b"\nc'), (2, "d")]
    (tmp_path / "y.csv").write_text('id,text\n4,"e"\n5,"cut off\nhere')
    assert sorted(tuple(r) for r in text_files.csv_rows(spark, str(tmp_path)).collect()) == [(1, 'a "b"\nc'), (2, "d"), (4, "e")]


def test_archive_index_and_pages(spark, tmp_path):
    rows = [{"urlkey": k, "timestamp": t, "url": f"http://{k}", "mime": m, "status": s} for k, t, m, s in (("a", "2", "text/html", "200"), ("a", "1", "text/html", "200"), ("b", "1", "text/html", "404"), ("c", "1", "image/png", "200"))]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [(r["urlkey"], r["timestamp"]) for r in text_files.archive_index(spark, str(tmp_path / "index")).collect()] == [("a", "1")]
    (tmp_path / "warc").mkdir()

    def record(kind, uri, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>tw\r\n5\r\no</p>\r\n0\r\n\r\n"
    (tmp_path / "warc" / "x.warc").write_bytes(record("request", "u0", b"GET /") + record("response", "u1", plain) + record("response", "u2", chunked))
    want = [("u1", "<p>one</p>"), ("u2", "<p>two</p>")]
    assert sorted(tuple(r) for r in text_files.archive_pages(spark, str(tmp_path / "warc")).collect()) == want
    (tmp_path / "gz").mkdir()
    cut = record("response", "u3", plain)[:-12]
    (tmp_path / "gz" / "y.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (record("request", "u0", b"GET /"), record("response", "u1", plain), record("response", "u2", chunked), cut)))
    assert sorted(tuple(r) for r in text_files.archive_pages(spark, str(tmp_path / "gz")).collect()) == want


def test_append_skips_what_is_there(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.range(5).withColumnRenamed("id", "k")
    assert text_files.append_new(rows, at, "k").count() == 5
    more = spark.range(3, 8).withColumnRenamed("id", "k")
    assert text_files.append_new(more.union(more), at, "k").count() == 3
    assert sorted(r["k"] for r in spark.read.parquet(at).collect()) == list(range(8))
