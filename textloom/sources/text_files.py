"""Text corpora from JSON, JSON lines, CSV, gzip and web-archive files, and resumable appends.

Readers keep one row per record whatever its shape, and skip records that do not
parse; the files of a folder are read in parallel, compressed ones by their codec.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions import scan
from textloom.operators.stylometry import documents

#: Names under which records hold their text; the first that is not empty counts.
TEXT_FIELDS = ("text", "content", "sample", "body")
_RECORD = "id bigint, " + ", ".join(f"{f} string" for f in TEXT_FIELDS)


def picked_text(columns: list[str]) -> Column:
    """The first text field that is there and not blank."""
    some = [F.when(F.trim(F.col(f)) != "", F.col(f)) for f in TEXT_FIELDS if f in columns]
    return F.coalesce(*some) if some else F.lit(None).cast("string")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON-lines files, compressed or not; lines that are no record are skipped."""
    raw = spark.read.schema(_RECORD + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull()).select("id", picked_text(raw.columns).alias("text"))


def json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of files that hold one JSON list of records, or one object with the list under ``samples``."""
    item = f"array<struct<{_RECORD.replace(' ', ':')}>>".replace(",:", ",")
    whole = spark.read.text(path, wholetext=True)
    lists = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json("value", f"samples {item}")["samples"])
    records = whole.select(F.explode(lists).alias("r")).select("r.*")
    return records.select("id", picked_text(records.columns).alias("text"))


def csv_rows(spark: SparkSession, path: str, fields: str = "id bigint, text string") -> DataFrame:
    """Rows of CSV files with a header, whose quoted fields may hold line breaks; a last row that is cut off goes.

    A row that lacks fields is broken and goes.  A file cut off inside quotes holds an
    odd number of them, which a count over its lines tells; the last row of such a
    file goes too.
    """
    wanted = [f.split()[0] for f in fields.split(", ")]
    raw = spark.read.schema(fields + ", _bad string").option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    quotes = F.sum(F.regexp_count("value", F.lit('"')))
    cut = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("_file")).agg(quotes.alias("q")).where("q % 2 = 1").select("_file")
    if not cut.take(1):
        return raw.where(F.col("_bad").isNull()).select(*wanted)
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    last = placed.join(cut, "_file", "left_semi").groupBy("_file").agg(F.max("_place").alias("_place"))
    return placed.where(F.col("_bad").isNull()).join(last, ["_file", "_place"], "left_anti").select(*wanted)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a web-archive index (JSON lines): good HTML pages, one per urlkey, the earliest."""
    rows = spark.read.schema("urlkey string, timestamp string, url string, mime string, status string, length string, offset string, filename string").json(path)
    good = rows.where("status = '200' and mime = 'text/html'")
    return good.groupBy("urlkey").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "urlkey"]), F.struct("timestamp", "url")).alias("r")).select("urlkey", "r.*")


def _dechunked(body: bytes) -> bytes:
    whole = []
    while b"\r\n" in body:
        length, body = body.split(b"\r\n", 1)
        n = int(length.split(b";")[0] or b"0", 16)
        if not n:
            break
        whole.append(body[:n])
        body = body[n + 2 :]
    return b"".join(whole)


def _page(record: bytes) -> tuple[str, str] | None:
    """(target, body) of one archive record if it is a whole response."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = fields.get("Content-Length", "")
    if fields.get("WARC-Type") != "response" or not size.isdigit() or len(rest) < int(size):
        return None
    block = rest[: int(size)]
    if b"\r\n\r\n" not in block:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        body = _dechunked(body)
    return fields.get("WARC-Target-URI", ""), body.decode("utf-8", "replace")


def _page_columns(records: pa.Array) -> pa.StructArray:
    found = [_page(x.as_py()) or (None, None) for x in records]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["url", "html"])


#: What stands between two records of a web archive, up to the version's last digit.
RECORD_EDGE = "\r\n\r\nWARC/1."


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of the response records of web-archive files, dechunked; gzip files by their suffix, member by member.

    Records are read as lines with RECORD_EDGE between them, so that files stream
    through their codec, plain ones are split, and a task holds one batch of records.
    A record that is shorter than its length says (cut off, or with a record's edge
    in its own text) is dropped.
    """

    @F.arrow_udf("struct<url:string,html:string>")
    def page(records: pa.Array) -> pa.Array:
        # records and pages as objects only for a slice, not for a batch
        return pa.concat_arrays([_page_columns(part) for part in scan.slices(records)])

    raw = spark.read.option("lineSep", RECORD_EDGE).text(path)
    return raw.where(F.col("value").contains("WARC-Type: response")).select(page(F.col("value").cast("binary")).alias("r")).where("r.html is not null").select("r.*")


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the Parquet table at ``path`` does not hold yet, one row a key; returns what was appended."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    fresh = rows.dropDuplicates([key])
    if there:
        done = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(path).select(key)
        fresh = fresh.join(done.distinct(), key, "left_anti")
    part = f"{path}/run={uuid.uuid4().hex}"
    fresh.write.parquet(part)
    return spark.read.schema(rows.schema).parquet(part)


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/textloom-files-{uuid.uuid4().hex}"


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as gzip JSON lines under changing field names, read back."""
    at = _folder(spark)
    rows = documents(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("id"), *[F.when(F.pmod("doc_id", F.lit(len(TEXT_FIELDS))) == i, F.col("text")).alias(f) for i, f in enumerate(TEXT_FIELDS)])
    rows.write.option("compression", "gzip").json(at)
    return json_lines(spark, at).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV with embedded line breaks, read back."""
    at = _folder(spark)
    documents(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("id"), "text").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return csv_rows(spark, at).select("id", F.length("text").cast("bigint").alias("size"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null and url is not null")


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as gzip web archives, with a request before each response, read back."""
    at = _folder(spark)
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))
    request = F.concat(F.lit("WARC/1.0\r\nWARC-Type: request\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: 5\r\n\r\nGET /"))
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block)
    # a writer sets its separator behind every record, as the format asks
    _pages(spark, sf_dir).select(F.explode(F.array(request, response))).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(at)
    return archive_pages(spark, at).select("url", F.sha2(F.col("html").cast("binary"), 256).alias("html_sha256"))


def array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as files of one JSON list or object each, read back."""
    at = _folder(spark)
    lot = F.floor(F.col("page_id") / 500).alias("lot")
    lists = _pages(spark, sf_dir).groupBy(lot).agg(F.to_json(F.collect_list(F.struct(F.col("page_id").alias("id"), F.col("html").alias("content")))).alias("value"))
    lists.select("lot", F.when(F.col("lot") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"samples": '), F.col("value"), F.lit("}"))).alias("value")).write.partitionBy("lot").text(at)
    return json_arrays(spark, at).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def index_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the pages, with captures that repeat a key or failed, scanned for the earliest good one."""
    at = _folder(spark)
    i = F.col("page_id")
    lines = _pages(spark, sf_dir).select(
        F.concat(F.lit("key"), F.floor(i / 3).cast("string")).alias("urlkey"),
        F.lpad(((i * 7919) % 100_003).cast("string"), 14, "0").alias("timestamp"),
        "url",
        F.when(i % 5 == 0, "image/png").otherwise("text/html").alias("mime"),
        F.when(i % 7 == 0, "404").otherwise("200").alias("status"),
    )
    lines.write.json(at)
    return archive_index(spark, at).select("urlkey", "timestamp", "url")


def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the pages written in two runs, the second one over all pages twice."""
    at = _folder(spark)
    rows = _pages(spark, sf_dir).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("html_sha256"))
    append_new(rows.where("page_id % 3 = 0"), at, "page_id")
    append_new(rows.union(rows), at, "page_id")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(at)


_GOOD_PAGES = "pages WHERE html IS NOT NULL AND url IS NOT NULL"
QUERIES = {"json_round_trip": json_round_trip, "csv_round_trip": csv_round_trip, "archive_round_trip": archive_round_trip, "array_round_trip": array_round_trip, "index_of_pages": index_of_pages, "resumed_append": resumed_append}
ORACLE_SQL = {
    "json_round_trip": r"SELECT doc_id AS id, CASE WHEN trim(text, ' ') <> '' THEN sha256(text) END AS text_sha256 FROM documents WHERE text IS NOT NULL",
    "csv_round_trip": "SELECT doc_id AS id, length(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL",
    "archive_round_trip": f"SELECT url, sha256(html) AS html_sha256 FROM {_GOOD_PAGES}",
    "array_round_trip": f"SELECT page_id AS id, CASE WHEN trim(html, ' ') <> '' THEN sha256(html) END AS text_sha256 FROM {_GOOD_PAGES}",
    "index_of_pages": f"SELECT urlkey, min((timestamp, url))[1] AS timestamp, min((timestamp, url))[2] AS url FROM (SELECT 'key' || (page_id // 3) AS urlkey, lpad(((page_id * 7919) % 100003)::VARCHAR, 14, '0') AS timestamp, url FROM {_GOOD_PAGES} AND page_id % 5 <> 0 AND page_id % 7 <> 0) GROUP BY urlkey",
    "resumed_append": f"SELECT page_id, sha256(html) AS html_sha256 FROM {_GOOD_PAGES}",
}
