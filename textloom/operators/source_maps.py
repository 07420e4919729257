"""Visible text of pages with runs that lead each of its places back to the source; row-local and native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.rules import UNSEEN, _decoded, _decoded_sql, _q
from textloom.operators.writing_rules import _bound

# Fixed patterns: tags and references, and tags that end a line.
TOKEN = r"(?i)<[^>]*>|&(?:#x?[0-9a-f]+|[a-z]+);"
BLOCK_TAG = r"(?i)^<(?:br|/?(?:p|div|section|article|li|h[1-6]|blockquote|tr))(?:[^\w]|$)"
BEYOND = r"[\x{10000}-\x{10FFFF}]"
PIECE = "array<struct<size:int,value:string>>"


def _pieces(html: Column) -> Column:
    """array<struct<size, value>>: the source in order, each piece with its length and what of it is visible."""
    blank = lambda x: F.regexp_replace(x, "(?s).", " ")
    safe = F.array_join(F.zip_with(F.split(html, UNSEEN, -1), F.regexp_extract_all(html, F.lit(UNSEEN), F.lit(0)), lambda x, y: F.concat(x, F.coalesce(blank(y), F.lit("")))), "")
    shown = lambda t: F.when(t.rlike(BLOCK_TAG), "\n").when(t.startswith("&"), _decoded(t)).otherwise("")
    piece = lambda x, value: F.struct(F.length(x).alias("size"), value.alias("value"))

    def of(t: Column) -> Column:
        pairs = F.zip_with(F.split(t, TOKEN, -1), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda x, y: F.array(piece(x, x), piece(F.coalesce(y, F.lit("")), F.coalesce(shown(y), F.lit("")))))
        return F.flatten(pairs).cast(PIECE)

    return _bound(safe, of)


def utf16_place(text: Column, place: Column) -> Column:
    """UTF-16 units before a code point's place: characters beyond the basic plane count twice."""
    return place + F.regexp_count(F.substring(text, F.lit(1), place), F.lit(BEYOND))


def code_point_place(text: Column, units: Column) -> Column:
    """The code point at a UTF-16 place; a place within a pair is that of its character.  Linear in the text."""
    step = lambda z, c: F.when(z["u"] + F.length(c) + F.regexp_count(c, F.lit(BEYOND)) > units, F.struct(F.lit(1 << 30).alias("u"), z["p"].alias("p"))).otherwise(F.struct((z["u"] + F.length(c) + F.regexp_count(c, F.lit(BEYOND))).alias("u"), (z["p"] + 1).alias("p")))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.struct(F.lit(0).alias("u"), F.lit(0).alias("p")), step, lambda z: z["p"])


def visible(pages: DataFrame) -> DataFrame:
    """(page_id, visible): the projection that the runs speak of; unlike visible_text, blanks stay as they are."""
    return pages.where("html is not null").select("page_id", F.array_join(F.transform(_pieces(F.col("html")), lambda x: x["value"]), "").alias("visible"))


def source_runs(pages: DataFrame) -> DataFrame:
    """(page_id, run, visible_start, visible_end, source_start, source_end, source_start_utf16): places of every visible piece in the source.

    Text keeps its length; a tag that ends a line, and a reference, are runs of their
    own.  Scripts, styles, templates and comments show as blanks.
    """
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("v"), F.array().cast("array<struct<visible_start:int,visible_end:int,source_start:int,source_end:int>>").alias("out"))

    def step(z: Column, x: Column) -> Column:
        end, seen = z["s"] + x["size"], z["v"] + F.length(x["value"])
        row = F.struct(z["v"].alias("visible_start"), seen.alias("visible_end"), z["s"].alias("source_start"), end.alias("source_end"))
        return F.struct(end.alias("s"), seen.alias("v"), F.when(x["value"] == "", z["out"]).otherwise(F.concat(z["out"], F.array(row))).alias("out"))

    runs = pages.where("html is not null").select("page_id", "html", F.posexplode(F.aggregate(_pieces(F.col("html")), zero, step, lambda z: z["out"])).alias("run", "r"))
    places = [F.col(f"r.{x}").cast("bigint").alias(x) for x in ("visible_start", "visible_end", "source_start", "source_end")]
    return runs.select("page_id", F.col("run").cast("bigint").alias("run"), *places, utf16_place(F.col("html"), F.col("r.source_start")).cast("bigint").alias("source_start_utf16"))


RUNS_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, html, string_split_regex(html, '{_q(UNSEEN)}') AS b, list_transform(regexp_extract_all(html, '{_q(UNSEEN)}'), lambda x: repeat(' ', length(x))) AS u FROM pages WHERE html IS NOT NULL),
s AS (SELECT id, page_id, html, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(u[i], '')), '') AS t FROM p),
c AS (SELECT id, page_id, html, string_split_regex(t, '{TOKEN}') AS x, regexp_extract_all(t, '{TOKEN}') AS y FROM s),
k AS (SELECT id, page_id, html, unnest(range(1, len(x) + 1)) AS i, x, y FROM c),
z AS (SELECT id, page_id, html, 2 * i AS k, x[i] AS source, x[i] AS value FROM k
  UNION ALL SELECT id, page_id, html, 2 * i + 1, r, CASE WHEN regexp_matches(r, '{BLOCK_TAG}') THEN chr(10) WHEN r[1] = '&' THEN {_decoded_sql()} ELSE '' END FROM (SELECT *, y[i] AS r FROM k WHERE i <= len(y))),
w AS (SELECT *, sum(length(source)) OVER q AS e, sum(length(value)) OVER q AS v FROM z WINDOW q AS (PARTITION BY id ORDER BY k))
SELECT page_id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS run, (v - length(value))::BIGINT AS visible_start, v::BIGINT AS visible_end, (e - length(source))::BIGINT AS source_start, e::BIGINT AS source_end,
  (e - length(source) + len(regexp_extract_all(substr(html, 1, (e - length(source))::INT), '{BEYOND}')))::BIGINT AS source_start_utf16 FROM w WHERE value <> ''
"""
QUERIES = {"source_runs": lambda s, d: source_runs(s.read.parquet(f"{d}/pages.parquet"))}
ORACLE_SQL = {"source_runs": RUNS_SQL}
