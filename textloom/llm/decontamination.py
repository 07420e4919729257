"""Benchmark decontamination by template windows (native).

Texts are bared of punctuation and split into words; in their template, words that
are numbers, names (capitalised) or units become typed placeholders and
everything else is folded (a word all in capitals is no name, so shouted texts keep
their words).  Every place of an item starts windows of SPAN words,
as they are (folded) and as template; they are hash-joined with the windows at
every place of the documents.  Windows whose distance to the item's place is
about the same belong to one occurrence.  An item is in a document if one
occurrence covers enough of its words, nearly all of a short item's.  Numbers and
units may differ freely; item names and document names must map one to one for
most names.

Windows that many different items hold ("which of the following") need not join on
their own: with ``rare_first`` documents are met with the rarer windows first, and the
frequent ones are then joined by document and window for the pairs that these found.
The query and the pipeline join every window, so that they pass over no item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.common import written

#: Words of a window, and of the template windows of items that are full of slots.
SPAN, LONG_SPAN = 4, 8
#: Least literal (not placeholder) words of a template window.
MIN_LITERALS = 2
#: Least share of an item's words that one occurrence covers, and of its names (and their slots) that map one to one.
MIN_SHARE, MIN_NAMES = 0.45, 0.6
#: Of its first SHORT words, so to say, an occurrence covers this share at least: short items stand there nearly whole.
SHORT, SHORT_SHARE = 8, 0.85
#: Windows that more items than this hold (equal items are one) are frequent.
MAX_HOLDERS = 16
#: More item windows than this are joined by shuffle instead of broadcast; the rows are the same.
MAX_BROADCAST_WINDOWS = 500_000
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "lbs", "oz", "miles", "mile", "mph", "kmh", "feet", "inches", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "years", "year", "dollars", "euros", "cents", "percent", "litres", "liters", "ml", "l", "degrees")


def _bare(text: Column) -> Column:
    """Letters and digits only, words one space apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+", " "))


def template(bare: Column) -> Column:
    """The bare text with placeholders, word for word; what a word becomes hangs on it and the number before it only."""
    out = F.regexp_replace(bare, r"(?<!\S)\p{Lu}\p{L}*\p{Ll}\p{L}*(?!\S)", "<name>")
    out = F.regexp_replace(out, r"(?<!\S)\d\S*", "<num>")
    return F.regexp_replace(F.lower(out), rf"(?<=<num>[ ])(?:{'|'.join(UNITS)})(?!\S)", "<unit>")


def _split(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, words): folded words and template words, as many."""
    bare = rows.select(id_col, _bare(F.col(text_col).cast("string")).alias("bare")).where("bare <> ''")
    return bare.select(id_col, F.split(F.lower("bare"), " ").alias("raw"), F.split(template(F.col("bare")), " ").alias("words"))


def _key(words: str, at: Column, span: int) -> Column:
    return F.xxhash64(F.lit(span), *[F.get(F.col(words), at - 1 + i) for i in range(span)])


def _literals(at: Column, span: int) -> Column:
    return sum((F.when(F.get(F.col("words"), at - 1 + i).startswith("<"), 0).otherwise(1) for i in range(span)), F.lit(0))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, alike, n_words, n_windows, place, span, literal, key, names): every window of every item.

    An item of fewer than SPAN words is one window.  Template windows hold
    MIN_LITERALS literal words at least; items that those of SPAN words do not
    cover by MIN_SHARE have ones of LONG_SPAN words too.  names: (place, folded
    name) of a template window's name slots.  Equal items are items of their own;
    an item without letters and digits has no window.
    """
    items = _split(benchmark.where("text is not null"), "item_id", "text").withColumn("n_words", F.size("words"))
    own = F.least(F.col("n_words"), F.lit(SPAN))
    places = items.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n_words") - own + 1)))
    place = F.col("place")
    spans = [*range(1, SPAN + 1), LONG_SPAN]
    some = F.array(*[
        F.struct(
            F.lit(span).alias("span"),
            F.lit(literal).alias("literal"),
            _key("raw" if literal else "words", place, span).alias("key"),
            (F.lit(span) == own if literal else ((F.lit(span) == own) | (F.lit(span) == LONG_SPAN)) & (place + span - 1 <= F.col("n_words")) & (_literals(place, span) >= MIN_LITERALS)).alias("fits"),
        )
        for span in spans for literal in (True, False) if not literal or span <= SPAN
    ])
    every = places.select("item_id", "n_words", "raw", "words", "place", (F.col("n_words") - own + 1).alias("n_windows"), F.explode(F.filter(some, lambda w: w["fits"])).alias("w"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("w.literal") & (F.col("w.span") <= SPAN), F.sequence(place, place + F.col("w.span") - 1))).over(Window.partitionBy("item_id")))))
    kept = every.withColumn("covered", covered).where((F.col("w.span") <= SPAN) | (F.col("covered") < F.col("n_words") * MIN_SHARE))
    slots = F.filter(F.transform(F.sequence(place, place + F.col("w.span") - 1), lambda i: F.struct(i.alias("place"), F.element_at("raw", i).alias("name"), F.element_at("words", i).alias("t"))), lambda x: x["t"] == "<name>")
    names = F.when(F.col("w.literal"), F.array().cast("array<struct<place:int,name:string>>")).otherwise(F.transform(slots, lambda x: F.struct(x["place"].alias("place"), x["name"].alias("name"))))
    return kept.select("item_id", F.xxhash64("raw").alias("alike"), "n_words", "n_windows", "place", "w.span", "w.literal", "w.key", names.alias("names"))


def _rare(windows: DataFrame) -> DataFrame:
    """The windows with ``rare``: MAX_HOLDERS different items or fewer hold it, or its item has no such window."""
    holders = windows.groupBy("key").agg(F.count_distinct("alike").alias("holders"))
    counted = windows.join(holders, "key").withColumn("few", F.col("holders") <= MAX_HOLDERS)
    some = F.max("few").over(Window.partitionBy("item_id"))
    return counted.withColumn("rare", F.col("few") | ~some).drop("few", "holders")


def _mapped(pairs: Column) -> Column:
    """Whether MIN_NAMES of the item's names, and of their slots, have a document name of their own.

    pairs: (place, item name, document name).  A name's own one is that of its most
    frequent pair, if that is the most frequent of the document name too.
    """
    kinds = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["ours"].alias("ours"), p["theirs"].alias("theirs"))))
    counts = F.transform(kinds, lambda k: F.struct(F.size(F.filter(pairs, lambda p: (p["ours"] == k["ours"]) & (p["theirs"] == k["theirs"]))).alias("n"), k["ours"].alias("ours"), k["theirs"].alias("theirs")))
    best = F.filter(counts, lambda c: ~F.exists(counts, lambda o: (o > c) & ((o["ours"] == c["ours"]) | (o["theirs"] == c["theirs"]))))
    names = F.size(F.array_distinct(F.transform(pairs, lambda p: p["ours"])))
    return (F.size(best) >= names * MIN_NAMES) & (F.aggregate(best, F.lit(0), lambda n, c: n + c["n"]) >= F.size(pairs) * MIN_NAMES)


def _probes(docs: DataFrame, sizes: list, longest: int) -> DataFrame:
    """(doc_id, at, key, values) of the windows at every place of the documents, of the spans and kinds that ``sizes`` names."""
    at = F.col("at")
    places = _split(docs, "doc_id", "text").select("doc_id", "raw", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    # a key past the text's end is hashed with nulls, which no item's is
    wanted = [(r["span"], kind) for r in sizes for kind, has in (("raw", r["as_is"]), ("words", r["as_template"])) if has]
    probes = places.select("doc_id", "raw", "at", F.explode(F.array_distinct(F.array(*[_key(kind, at, span) for span, kind in wanted]))).alias("key"))
    return probes.select("doc_id", "at", "key", F.slice("raw", at, longest).alias("values"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_first: bool = True) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, verbatim) of items found in documents.

    n_matched: places of the item's windows that the best occurrence holds, of
    n_windows.  verbatim: it holds the item word for word, case and punctuation
    apart.  Null and empty texts, and rows without a doc_id, hold nothing; rows
    that repeat a doc_id count as one document.  Of occurrences of one item the one
    that holds most places counts.  One pass over the texts, whole texts whatever
    their length; only windows that an item has leave it.  Columns besides id and
    text are not read, whatever their names.

    rare_first: an item is only looked for in documents that hold one of its rarer
    windows.  Without it every window joins, and no item is passed over, at the cost
    of a row for each item that holds a window of a document.
    """
    windows = item_windows(benchmark)
    items = written(_rare(windows) if rare_first else windows.withColumn("rare", F.lit(True)))
    sizes = items.groupBy("span", "rare").agg(F.max("literal").alias("as_is"), F.max(~F.col("literal")).alias("as_template"), F.count("*").alias("n")).collect()
    if not sizes:
        return docs.limit(0).select(F.col(id_col).alias("doc_id")).join(items.limit(0), F.lit(True)).select("doc_id", "item_id", "n_windows", F.lit(0).alias("n_matched"), F.lit(False).alias("verbatim"))
    slim = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longest = max(r["span"] for r in sizes)
    first = [r for r in sizes if r["rare"]]
    small = F.broadcast if sum(r["n"] for r in first) <= MAX_BROADCAST_WINDOWS else (lambda df: df)
    met = _probes(slim, first, longest).join(small(items.where("rare").drop("rare", "alike")), "key")
    often = [r for r in sizes if not r["rare"]]
    if often:
        met = written(met)
        pairs = met.select("doc_id", "item_id").distinct()
        wanted = pairs.join(items.where("not rare").drop("rare", "alike"), "item_id")
        again = _probes(slim.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), often, longest)
        met = met.unionByName(again.join(wanted, ["doc_id", "key"]))
    shifts = (
        met.groupBy("doc_id", "item_id", "n_words", "n_windows", (F.col("at") - F.col("place")).alias("shift")).agg(
            F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("place"), F.col("place") + F.col("span") - 1)))).alias("words"),
            F.collect_set("place").alias("places"),
            F.count_distinct(F.when(F.col("literal"), F.col("place"))).alias("n_same"),
            F.array_distinct(F.flatten(F.collect_set(F.transform("names", lambda x: F.struct(x["place"].alias("place"), x["name"].alias("ours"), F.element_at("values", x["place"] - F.col("place") + 1).alias("theirs")))))).alias("pairs"),
        )
    )
    # words put in or left out shift the rest: shifts that differ by up to a quarter of the item share one of two overlapping ranges
    reach = F.greatest(F.lit(4), F.ceil(F.col("n_words") / 4))
    near = shifts.withColumn("range", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor((F.col("shift") + i * reach) / (2 * reach)).alias("at")) for i in (0, 1)])))
    occurrences = near.groupBy("doc_id", "item_id", "n_words", "n_windows", "range").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n_covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"),
        F.max("n_same").alias("n_same"),
        F.flatten(F.collect_list("pairs")).alias("pairs"),
    )
    least = F.greatest(F.col("n_words") * MIN_SHARE, F.least("n_words", F.lit(SHORT)) * SHORT_SHARE)
    held = occurrences.where((F.col("n_covered") >= least) & _mapped(F.col("pairs")))
    return held.groupBy("doc_id", "item_id", "n_windows").agg(F.max("n_matched").cast("bigint").alias("n_matched"), F.max(F.col("n_same") == F.col("n_windows")).alias("verbatim"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rare_first=False)
