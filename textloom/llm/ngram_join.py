"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection.

Equal shingle sets are one *class*, named by 128 bits of its set; only classes
are compared.  Two classes link when 100 * |A and B| >= percent * |A or B|; 85
percent below.  A link of A misses at most d = |A| - ceil(0.85 |A|) of A's
shingles, so any d + 1 shingles of A hold one that every partner has.

Round 1, all classes.  A class exposes the shingles whose hash lies under a bound
that shrinks with its size; the bound is the same for all sizes that can link,
so partners expose it too.  The classes of one shingle are a tile if there are
at most TILE; its pairs of fitting size are candidates.  Larger groups are *hot*
and only counted.  A class with d + 1 exposed shingles that are not hot has met
all its partners; only links between two classes that lack them (*loose* ones)
can be missing.

Round 2, loose classes among themselves.  They expose all their shingles.  Hot
groups (families of near copies, passages that many share) are cut into size
bands, and each class is paired with its band's leader and the next lower
band's; those links come first, and pairs that they connect are not compared.
Still open are classes that consist of hot shingles but for d or fewer (*dense*).

Round 3, dense classes.  1 - Jaccard is a metric: a class lies within 0.15 of
its hub (a partner), so classes of two hubs can link only if the hubs are within
0.45.  Hubs meet in size-banded tiles under that bound; the members of those
that pass, and are not connected yet, meet in tiles with their sorted arrays and
give a spanning forest of the links found there, not all of them.

Every candidate passes the bitmaps first: a bit that A has and B lacks is a
shingle (at least one) that A has and B lacks, which bounds the overlap from
above.  What is left is settled by intersecting the sorted arrays.

No shingle's rows meet in one task unthinned: a map task that holds more than
TILE classes of a shingle knows it as hot, ships TILE + 1 of them and the
leaders, and counts the others itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import named, parts_of, row_chunks, rowed, strings, word_hashes, word_spans, written
from textloom.llm.windows import U64, SpanHash, mix

#: Classes of one tile; a larger shingle group is hot.
TILE = 24
#: Least width of a bitmap.
MIN_BITS = 512
#: Exposed shingles a map task holds before it packs them.
FLUSH = 1_000_000
#: Leaders a class is compared with.
LEADERS = 2
#: Members of a hub that one task compares.
HUB_LOT = 256
#: Bounds of one lot of a size band in round 3: rows, and shingles in all.
LOT_ROWS, LOT_ITEMS = 2_000, 1_000_000


@dataclass(frozen=True)
class Link:
    """When two sets link: 100 * |A and B| >= percent * |A or B|, on shingles of so many words."""

    percent: int = 85
    shingle: int = 4
    tile: int = TILE
    flush: int = FLUSH
    lot_rows: int = LOT_ROWS

    @property
    def base(self) -> float:
        """Share of a large set's shingles that it exposes: what it must, and a little more."""
        return 0.02 + (100 - self.percent) / 100

    @property
    def least(self) -> float:
        return self.percent / 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents back to back, document bounds)."""
    folded = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    starts, ends, first = word_spans(folded, offsets)
    docs = len(offsets) - 1
    count = np.diff(first)
    hashes = SpanHash(word_hashes(folded, starts, ends))
    doc_of = np.repeat(np.arange(docs), count)
    grams = hashes.grams(n)
    inside = doc_of[: len(grams)] == doc_of[n - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))  # the whole sequence is the only shingle
    h = np.concatenate((grams[inside], mix(hashes.spans(first[short], first[short + 1]) + count[short].astype(U64))))
    doc = np.concatenate((doc_of[: len(grams)][inside], short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.searchsorted(doc[fresh], np.arange(docs + 1))


def _bound(n: np.ndarray, link: Link) -> np.ndarray:
    """Upper bound of the hashes a set of n exposes for itself, as a share of 2^64; falls with n."""
    n = np.maximum(n, 1)
    return np.where(n < 32, 1.0, np.minimum(1.0, link.base + 1.0 / np.sqrt(n)))


def _under(h: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) < share * float(1 << 53)


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n: four to eight a shingle, a power of two, so wider ones fold."""
    return np.maximum(MIN_BITS, 1 << (np.int64(3) + np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64)))


def bitmaps(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set the bytes of its bitmap, bit i least significant first."""
    n = np.diff(bounds)
    wide = width(n)
    stop = np.cumsum(wide)
    bits = np.zeros(int(stop[-1]) if len(stop) else 0, bool)
    doc = np.repeat(np.arange(len(n)), n)
    bits[(stop - wide)[doc] + (h & (wide[doc] - 1).astype(U64)).astype(np.int64)] = True
    raw = np.packbits(bits, bitorder="little").tobytes()
    return [raw[(e - w) // 8 : e // 8] for e, w in zip(stop.tolist(), wide.tolist(), strict=True)]


def folded(bits: bytes, size: int) -> int:
    """The bitmap as an integer of ``size`` bytes: a shingle's bit is its hash modulo the width."""
    x, have = int.from_bytes(bits, "little"), len(bits)
    while have > size:
        have //= 2
        x = (x >> (8 * have)) | (x & ((1 << (8 * have)) - 1))
    return x


# --- rounds 1 and 2: tiles of shingles ---------------------------------------------

_REF = np.dtype([("hi", "<u8"), ("lo", "<u8")])
_TOKEN = np.dtype([("token", "<u8"), ("ref", _REF), ("n", "<i4")])
_TOKENS, _SET, _PAIR, _HOT, _STAR = range(5)
_FOUND = "kind int, a binary, b binary, n int, rid bigint, total int, bits binary"
_MET = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int32()), ("rid", pa.int64()), ("total", pa.int32()), ("bits", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), *_MET])


def _refs(x: np.ndarray) -> pa.Array:
    """As 16 bytes, most significant first, so that they order like the numbers."""
    raw = np.stack((x["hi"], x["lo"]), axis=1).astype(">u8")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 16 * len(x) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def _rows(schema: pa.Schema, m: int, **columns) -> pa.RecordBatch:
    """m rows; columns that are not given are null."""
    fill = lambda f: pa.nulls(m, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
    return pa.RecordBatch.from_arrays([fill(f) for f in schema], schema=schema)


def _numbered(ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct refs in order, number of each row's ref)."""
    hi, lo = ref["hi"].astype(U64), ref["lo"].astype(U64)
    order = np.lexsort((lo, hi))
    head = np.ones(len(ref), bool)
    head[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    code = np.empty(len(ref), np.int64)
    code[order] = np.cumsum(head) - 1
    return ref[order][head], code


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    fresh &= a != b
    return a[fresh], b[fresh]


def _groups(token: np.ndarray, tile: int) -> np.ndarray:
    """Rows of sorted tokens -> size of each row's group."""
    head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(token)))
    return np.repeat(size, size)


def _stars(token: np.ndarray, code: np.ndarray, n: np.ndarray, link: Link) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of hot groups -> (whether a row leads its size band, (class, leader, shingles that say so))."""
    none = np.zeros(0, np.int64)
    if not len(token):
        return np.zeros(0, bool), (none, none, none)
    band = (np.log(n) / -np.log(link.least)).astype(np.int64)
    order = np.lexsort((code, band, token))
    token, code, band = token[order], code[order], band[order]
    head = np.concatenate(([True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])))
    start = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    leader = code[start]
    below = np.maximum(which - 1, 0)
    near = (which > 0) & (token[start[below]] == token) & (band[start[below]] == band - 1)
    member, leads = np.concatenate((code, code[near])), np.concatenate((leader[which], leader[below[near]]))
    by = np.lexsort((leads, member))
    member, leads = member[by], leads[by]
    first = np.flatnonzero(np.concatenate(([True], (member[1:] != member[:-1]) | (leads[1:] != leads[:-1]))))
    times = np.diff(np.append(first, len(member)))
    other = member[first] != leads[first]
    mask = np.zeros(len(head), bool)
    mask[order] = head
    return mask, (member[first][other], leads[first][other], times[other])


def _own(token: np.ndarray, n: np.ndarray, link: Link, whole: bool) -> np.ndarray:
    return np.ones(len(token), bool) if whole else _under(token, _bound(n.astype(np.int64), link))


def _tell_hot(refs: np.ndarray, token: np.ndarray, code: np.ndarray, n: np.ndarray, link: Link, whole: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of hot groups -> how many of its own shingles are hot, per class."""
    cls, times = np.unique(code[_own(token, n, link, whole)], return_counts=True)
    yield _rows(schema, len(cls), kind=np.full(len(cls), _HOT, np.int32), a=_refs(refs[cls]), n=times.astype(np.int32))


def _tell_stars(refs: np.ndarray, stars: tuple[np.ndarray, np.ndarray, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    member, leader, times = stars
    yield _rows(schema, len(member), kind=np.full(len(member), _STAR, np.int32), a=_refs(refs[member]), b=_refs(refs[leader]), n=times.astype(np.int32))


def _thinned(rows: np.ndarray, link: Link, whole: bool) -> Iterator[np.ndarray | pa.RecordBatch]:
    """Rows of one flush -> rows to ship; what is known of those kept back."""
    rows = rows[np.argsort(rows["token"], kind="stable")]
    size = _groups(rows["token"], link.tile)
    hot = np.flatnonzero(size > link.tile + 1)
    if not len(hot):
        yield rows
        return
    refs, code = _numbered(rows["ref"][hot])
    token, n = rows["token"][hot], rows["n"][hot]
    leads, stars = _stars(token, code, n, link)
    head = np.concatenate(([True], token[1:] != token[:-1]))
    place = np.arange(len(hot)) - np.maximum.accumulate(np.where(head, np.arange(len(hot)), 0))
    back = ~leads & (place > link.tile)
    yield from _tell_hot(refs, token[back], code[back], n[back], link, whole, _SENT)
    if whole:
        yield from _tell_stars(refs, stars, _SENT)
    keep = np.ones(len(rows), bool)
    keep[hot[back]] = False
    yield rows[keep]


def _expose(keyed: DataFrame, buckets: int, link: Link, whole: bool) -> DataFrame:
    """Per document one row (class, size, bitmap), and exposed shingles packed by bucket."""

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for got in _thinned(np.concatenate(held), link, whole):
            if isinstance(got, pa.RecordBatch):
                yield got.set_column(0, "bucket", pa.array(np.arange(got.num_rows) % buckets, pa.int32()))
                continue
            where = (mix(got["token"].astype(U64)) % U64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            got, where = got[order], where[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(got)])) if len(got) else np.zeros(1, np.int64)
            if len(cut) > 1:
                lots = [got[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                # column by column: equal and small values then compress well in the shuffle
                packed = [b"".join(x[c].tobytes() for c in _TOKEN.names) for x in lots]
                yield _rows(_SENT, len(lots), bucket=where[cut[:-1]], kind=np.full(len(lots), _TOKENS, np.int32), packed=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], link.shingle)
                m, n = hi - lo, np.diff(bounds)
                ref = np.zeros(m, _REF)
                for name, salt in (("hi", U64(0x2545F491)), ("lo", U64(0x9E6C63D0))):
                    sums = np.zeros(len(h) + 1, U64)
                    np.cumsum(mix(h ^ salt), out=sums[1:])
                    ref[name] = np.where(n > 0, mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ n.astype(U64)), U64(0))
                doc = np.repeat(np.arange(m), n)
                total = np.bincount(doc, weights=_own(h, n[doc], link, whole), minlength=m).astype(np.int32)
                new = np.zeros(m, bool)  # equal sets expose once
                for i, r in enumerate(ref.tolist()):
                    if r not in seen and n[i]:
                        seen.add(r)
                        new[i] = True
                bits = bitmaps(h, bounds)
                yield _rows(_SENT, m, bucket=(mix(rids[lo:hi].view(U64)) % U64(buckets)).astype(np.int32), kind=np.full(m, _SET, np.int32), a=_refs(ref), n=n.astype(np.int32), rid=rids[lo:hi], total=total, bits=[bits[i] if new[i] else None for i in range(m)])
                shown = new[doc] & (True if whole else _under(h, _bound(link.percent * n // 100, link)[doc]))
                rows = np.zeros(int(shown.sum()), _TOKEN)
                rows["token"], rows["ref"], rows["n"] = h[shown], ref[doc[shown]], n[doc[shown]]
                held.append(rows)
                size += len(rows)
                if size >= link.flush:
                    yield from pack(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from pack(held)

    return keyed.select("rid", "text").mapInArrow(run, "bucket int, packed binary, " + _FOUND)


def tiles(rows: np.ndarray, link: Link, whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within tiles, stars of hot groups (if whole), and how many own shingles of a class are hot."""
    refs, code = _numbered(rows["ref"])
    order = np.lexsort((code, rows["token"]))
    token, code, n = rows["token"][order], code[order], rows["n"][order].astype(np.int64)
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (code[1:] != code[:-1])
    token, code, n = token[fresh], code[fresh], n[fresh]
    of = _groups(token, link.tile)
    small = (of > 1) & (of <= link.tile)
    t, c, m = token[small], code[small], n[small]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, link.tile):
        same = t[d:] == t[:-d]
        if not same.any():
            break
        same &= 100 * np.minimum(m[d:], m[:-d]) >= link.percent * np.maximum(m[d:], m[:-d])
        left.append(c[:-d][same])
        right.append(c[d:][same])
    a, b = _unique_pairs(np.concatenate(left), np.concatenate(right))
    yield _rows(_MET, len(a), kind=np.full(len(a), _PAIR, np.int32), a=_refs(refs[a]), b=_refs(refs[b]))
    hot = of > link.tile
    yield from _tell_hot(refs, token[hot], code[hot], n[hot], link, whole, _MET)
    if whole:
        yield from _tell_stars(refs, _stars(token[hot], code[hot], n[hot], link)[1], _MET)


def _meet(keyed: DataFrame, link: Link, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[np.ndarray] = []
        for batch in batches:
            packed = batch.column(1)
            for raw in packed.drop_null().to_pylist():
                m = len(raw) // _TOKEN.itemsize
                rows, at = np.zeros(m, _TOKEN), 0
                for c in _TOKEN.names:
                    rows[c] = np.frombuffer(raw, _TOKEN[c], m, at)
                    at += m * _TOKEN[c].itemsize
                lots.append(rows)
            told = batch.filter(packed.is_null())
            if told.num_rows:
                yield pa.RecordBatch.from_arrays(told.columns[2:], schema=_MET)
        if lots:
            yield from tiles(np.concatenate(lots), link, whole)

    parts = parts_of(keyed)
    return _expose(keyed, 4 * parts, link, whole).repartition(parts, F.col("bucket")).mapInArrow(run, _FOUND)


# --- bitmaps and intersection ---------------------------------------------------------


def may_link(x: int, y: int, n: int, m: int, jaccard: float) -> bool:
    """Can sets of n and m with these bitmaps of one width have this Jaccard value?"""
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return most * (1.0 + jaccard) >= jaccard * (n + m) - 1e-6


def _screen(pairs: DataFrame, classes: DataFrame, link: Link) -> DataFrame:
    """Candidate pairs (a, b) that their sizes and bitmaps allow."""
    side = lambda x: classes.select(F.col("ref").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                size = min(len(x), len(y))
                good.append(100 * min(n, m) >= link.percent * max(n, m) and may_link(folded(x, size), folded(y, size), n, m, link.least))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a binary, b binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Items that two sorted arrays share."""
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


def _verify(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, link: Link) -> DataFrame:
    """The pairs (a, b) that link, with Jaccard, by intersecting the sorted arrays.

    Arrays meet at the hub a, in lots of HUB_LOT members, so that no hub fills
    a task.  Rows of a lot stream: the hub's array first, then the members'.
    """
    lots = written(pairs.select("a", "b").withColumn("lot", F.pmod(F.xxhash64("b"), F.lit(1 << 20))))
    weight = lots.groupBy("a").agg(F.ceil(F.count("*") / HUB_LOT).alias("lots"))
    member = lots.join(weight, "a").select("a", (F.col("lot") % F.col("lots")).cast("int").alias("lot"), F.col("b").alias("ref"))
    hub = weight.select("a", F.explode(F.sequence(F.lit(0), F.col("lots").cast("int") - 1)).alias("lot"), F.col("a").alias("ref"))
    uses = member.unionByName(hub).join(classes.select("ref", "rid"), "ref")
    wanted = uses.groupBy("rid").agg(F.collect_list(F.struct("a", "lot", "ref")).alias("uses"))
    joined = keyed.select("rid", "text").join(wanted, "rid").select("text", "uses")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(0))
            lists = batch.column(1)
            edges, flat = np.asarray(lists.offsets), lists.values
            for lo, hi in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], link.shingle)
                for i in range(hi - lo):  # a hub's array goes out once per lot
                    raw = h[bounds[i] : bounds[i + 1]].tobytes()
                    use = flat.slice(edges[lo + i], edges[lo + i + 1] - edges[lo + i])
                    step = max(1, (8 << 20) // max(1, len(raw)))
                    for at in range(0, len(use), step):
                        some = use.slice(at, step)
                        yield pa.RecordBatch.from_arrays([some.field(0), some.field(1), some.field(2), pa.array([raw] * len(some), pa.binary())], names=["a", "lot", "ref", "items"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub_items = None, np.zeros(0, U64)
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "jaccard": []}
            for a, lot, ref, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = np.frombuffer(items, U64)
                if ref == a:
                    at, hub_items = (a, lot), mine
                    continue
                assert at == (a, lot)
                both = _common(hub_items, mine)
                either = len(mine) + len(hub_items) - both
                if 100 * both >= link.percent * either:
                    out["a"].append(a)
                    out["b"].append(ref)
                    out["jaccard"].append(both / either)
            if out["a"]:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary()), "jaccard": pa.array(out["jaccard"], pa.float64())})

    lot_rows = joined.mapInArrow(arrays, "a binary, lot int, ref binary, items binary").repartition(F.col("a"), F.col("lot"))
    ordered = lot_rows.sortWithinPartitions("a", "lot", F.col("ref") != F.col("a"))
    return written(ordered.mapInArrow(intersect, "a binary, b binary, jaccard double"))


# --- components ------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """(ref, component): smallest ref reachable, for every ref in a link.

    Labels spread along links and then jump to their own label's label, so long
    chains take a logarithmic number of rounds; a hub's labels are partly
    aggregated before the shuffle.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    label = written(both.groupBy(F.col("a").alias("ref")).agg(F.min("b").alias("m")).select("ref", F.least("ref", "m").alias("component")))
    for _ in range(rounds):
        spread = both.join(label.select(F.col("ref").alias("a"), "component"), "a").groupBy(F.col("b").alias("ref")).agg(F.min("component").alias("near"))
        step = label.join(spread, "ref", "left").select("ref", F.least("component", F.coalesce("near", "component")).alias("c"), F.col("component").alias("old"))
        jump = label.select(F.col("ref").alias("c"), F.col("component").alias("far"))
        label = written(step.join(jump, "c", "left").select("ref", F.least("c", F.coalesce("far", "c")).alias("component"), "old"))
        if not label.where("component != old").take(1):
            break
        label = label.select("ref", "component")
    else:
        raise RuntimeError("components did not settle")
    return label.select("ref", "component")


def _hubs(links: DataFrame) -> DataFrame:
    """(ref, component): a class that ref reaches in two steps or fewer, each to the smallest partner."""
    both = links.select(F.col("a").alias("ref"), F.col("b").alias("m")).union(links.select("b", "a"))
    near = both.groupBy("ref").agg(F.min("m").alias("m")).select("ref", F.least("ref", "m").alias("hub"))
    jump = near.select(F.col("ref").alias("hub"), F.col("hub").alias("far"))
    return written(near.join(jump, "hub", "left").select("ref", F.coalesce("far", "hub").alias("component")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    side = lambda x: labels.select(F.col("ref").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


# --- round 3: size-banded tiles of dense classes -------------------------------------------


def _banded(rows: DataFrame, link: Link, reach: int) -> DataFrame:
    """``rows`` (ref, n, ...) once for each tile they belong to: cell (band, lot) against cell, with ``side``.

    Sizes of a band differ by less than 2, and cells of bands further apart than
    ``reach`` never meet.  The table of lots has a row per band, 32 at most.
    """
    banded = written(rows.withColumn("band", F.length(F.bin("n"))))
    lots = banded.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / link.lot_rows, F.sum("n") / LOT_ITEMS)).cast("int").alias("lots"))
    lots = written(lots)
    mine = banded.join(F.broadcast(lots), "band").withColumn("lot", F.pmod(F.xxhash64("ref"), F.col("lots")).cast("int")).drop("lots")
    other = F.broadcast(lots.select(F.col("band").alias("_band"), F.col("lots").alias("_lots")))
    met = mine.withColumn("_band", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach))).join(other, "_band").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))
    here, there = F.struct(F.col("band").alias("band"), F.col("lot").alias("lot")), F.struct(F.col("_band").alias("band"), F.col("_lot").alias("lot"))
    side: Column = F.when(here == there, 0).when(here < there, 1).otherwise(2)
    return met.withColumn("first", F.least(here, there)).withColumn("second", F.greatest(here, there)).withColumn("side", side).drop("_band", "_lots", "_lot", "band", "lot")


def _bit_bound(bits: np.ndarray, n: np.ndarray, i: int, some: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of set i with the others."""
    only_i = np.bitwise_count(bits[i] & ~bits[some]).sum(axis=1, dtype=np.int64)
    only_j = np.bitwise_count(bits[some] & ~bits[i]).sum(axis=1, dtype=np.int64)
    return np.minimum(n[i] - only_i, n[some] - only_j)


def _close_hubs(hubs: DataFrame, link: Link) -> DataFrame:
    """Hubs (ref, n, bits, component, radius) that another component's may be near enough to."""

    def compare(table: pa.Table) -> pa.Table:
        side, n, radius = (table.column(c).to_numpy() for c in ("side", "n", "radius"))
        raw = table.column("bits").to_pylist()
        size = min(map(len, raw))
        bits = np.array([np.frombuffer(folded(x, size).to_bytes(size, "little"), np.uint64) for x in raw])
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        n = n.astype(np.int64)
        close = np.zeros(len(n), bool)
        second = np.flatnonzero(side != 1)
        for i in np.flatnonzero(side != 2).tolist():
            least = np.maximum(0.0, link.least - radius[i] - radius[second])
            ok = (component[second] != component[i]) & ((second > i) if side[i] == 0 else True)
            ok &= np.minimum(n[second], n[i]) >= least * np.maximum(n[second], n[i]) - 1e-6
            ok &= ~(close[second] & close[i])
            some, least = second[ok], least[ok]
            if len(some):
                hit = some[_bit_bound(bits, n, i, some) * (1.0 + least) >= least * (n[i] + n[some]) - 1e-6]
                close[hit] = True
                close[i] |= len(hit) > 0
        return pa.table({"hub": table.column("ref").filter(pa.array(close))})

    reach = int(np.ceil(-np.log2(max(0.02, 3 * link.least - 2))))
    return _banded(hubs, link, reach).groupBy("first", "second").applyInArrow(compare, "hub binary").distinct()


def _forest(members: DataFrame, link: Link) -> DataFrame:
    """Links (a, b) that connect members (ref, n, cold, component, items) of different components.

    A tile gives at most one link per two components that it joins.  Two classes
    that share no cold shingle have all cold ones outside their overlap.
    """

    def compare(table: pa.Table) -> pa.Table:
        side, n, cold = (table.column(c).to_numpy().astype(np.int64) for c in ("side", "n", "cold"))
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        refs, raw = table.column("ref").to_pylist(), table.column("items").to_pylist()
        items = [np.frombuffer(x, U64) for x in raw]
        wide = max(64, 1 << int(8 * n.max() - 1).bit_length())
        flags = np.zeros((len(n), wide), bool)
        for i, x in enumerate(items):
            flags[i, (x & U64(wide - 1)).astype(np.int64)] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        del flags
        second = np.flatnonzero(side != 1)
        a, b = [], []
        for i in np.flatnonzero(side != 2).tolist():
            ok = (component[second] != component[i]) & ((second > i) if side[i] == 0 else True)
            both = n[second] + n[i]
            ok &= 100 * np.minimum(n[second], n[i]) >= link.percent * np.maximum(n[second], n[i])
            ok &= (cold[second] + cold[i]) * (1.0 + link.least) <= (1.0 - link.least) * both + 1e-6
            some = second[ok]
            if not len(some):
                continue
            some = some[_bit_bound(bits, n, i, some) * (1.0 + link.least) >= link.least * (n[i] + n[some]) - 1e-6]
            for j in some.tolist():
                if component[i] == component[j]:
                    continue
                shared = _common(items[i], items[j])
                if 100 * shared >= link.percent * (n[i] + n[j] - shared):
                    a.append(refs[i])
                    b.append(refs[j])
                    component[component == component[j]] = component[i]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    reach = int(np.ceil(-np.log2(link.least)))
    found = _banded(members, link, reach).groupBy("first", "second").applyInArrow(compare, "a binary, b binary")
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("double").alias("jaccard")))


def _dense_links(keyed: DataFrame, dense: DataFrame, links: DataFrame, link: Link) -> DataFrame | None:
    """Links between dense classes (ref, rid, n, bits, cold) that no tile of shingles could show."""
    labels = components(links)
    ends = links.select(F.col("a").alias("hub"), F.col("b").alias("ref"), "jaccard").union(links.select(F.col("b"), F.col("a"), "jaccard"))
    both = dense.select("ref").join(ends, "ref").join(dense.select(F.col("ref").alias("hub")), "hub", "left_semi").where("hub < ref")
    near = both.groupBy("ref").agg(F.min(F.struct("hub", "jaccard")).alias("s"))
    # a dense class goes with its smallest dense partner, if that is smaller than itself
    star = written(dense.join(near, "ref", "left").join(labels, "ref", "left").select("ref", "rid", "n", "bits", "cold", F.coalesce("component", "ref").alias("component"), F.coalesce("s.hub", "ref").alias("hub"), F.coalesce(1 - F.col("s.jaccard"), F.lit(0.0)).alias("away")))
    radius = star.groupBy("hub").agg(F.max("away").alias("radius")).withColumnRenamed("hub", "ref")
    active = written(_close_hubs(star.select("ref", "n", "bits", "component").join(radius, "ref"), link))
    if not active.take(1):
        return None
    members = star.join(active, "hub", "left_semi").select("rid", "ref", "n", "cold", "component")
    wanted = keyed.select("rid", "text").join(members, "rid").select("text", "ref", "n", "cold", "component")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for lo, hi in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], link.shingle)
                raw = [h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(raw, pa.binary())], names=["ref", "n", "cold", "component", "items"])

    return _forest(wanted.mapInArrow(arrays, "ref binary, n int, cold int, component binary, items binary"), link)


# --- the join --------------------------------------------------------------------------------


def _short(total: Column, link: Link) -> Column:
    """Too few shingles that are not hot to have met every partner."""
    return total - F.coalesce("hot", F.lit(0)) < F.col("n") - F.ceil(F.col("n") * link.percent / 100) + 1


def join(keyed: DataFrame, link: Link = Link()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((rid, ref, n_shingles) of every row, links between classes, classes (ref, rid of its first row))."""
    found = written(_meet(keyed, link, False), ["kind"])
    told = lambda rows, kind: rows.where(F.col("kind") == kind)
    hot = lambda rows: told(rows, _HOT).groupBy(F.col("a").alias("ref")).agg(F.sum("n").alias("hot"))
    sets = told(found, _SET).select("rid", F.col("a").alias("ref"), "n", "total", "bits")
    classes = sets.where("n > 0").groupBy("ref").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("total").alias("total"), F.max("bits").alias("bits"))
    classes = written(classes.join(hot(found), "ref", "left").select("ref", "rid", "n", "bits", _short(F.col("total"), link).alias("loose")))
    links = _verify(keyed, classes, _screen(told(found, _PAIR), classes, link), link)
    loose = classes.where("loose")
    if loose.take(1):
        texts = written(keyed.select("rid", "text").join(loose.select("rid"), "rid", "left_semi"))
        again = written(_meet(texts, link, True), ["kind"])
        # a class tries the leaders that most of its hot shingles name; which ones is a matter of speed alone
        voted = told(again, _STAR).groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = voted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, LEADERS).alias("best"))
        stars = best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.unionByName(_verify(texts, loose, _screen(stars, loose, link), link))
        # families are connected through their leaders now; pairs inside one need no further look
        apart = _apart(told(again, _PAIR).select("a", "b").distinct(), _hubs(links))
        links = links.unionByName(_verify(texts, loose, _screen(apart, loose, link), link))
        counted = loose.join(hot(again), "ref", "left")
        dense = written(counted.where(_short(F.col("n"), link)).select("ref", "rid", "n", "bits", (F.col("n") - F.coalesce("hot", F.lit(0))).cast("int").alias("cold")))
        if dense.take(1):
            more = _dense_links(texts, dense, links, link)
            if more is not None:
                links = links.unionByName(more)
    return sets.select("rid", "ref", F.col("n").cast("bigint").alias("n_shingles")), links, classes.select("ref", "rid")


def ngram_join(docs: DataFrame, link: Link = Link(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null texts and texts without words have no shingles, link with nothing and
    are components of their own.  Rows that repeat or lack a doc_id are
    documents of their own; their component's smallest doc_id may be null only
    if all its doc_ids are.  Columns besides id and text are not read, whatever
    their names.  A long text is one set; a task holds the arrays of about 2 MB
    of text, or of one longer text, at a time.
    """
    keyed, plain = rowed(docs, id_col, text_col)
    sets, links, classes = join(keyed, link)
    if not plain:  # the first row of a class may lack a doc_id that others have
        classes = sets.where("n_shingles > 0").join(keyed.select("rid", "doc_id"), "rid").groupBy("ref").agg(F.min("doc_id").alias("rid"))
    grouped = classes.join(components(links), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    smallest = grouped.groupBy("component").agg(F.min("rid").alias("component_id"))
    of_class = grouped.join(smallest, "component").select("ref", "component_id")
    out = sets.join(of_class, "ref", "left")
    if plain:
        return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("rid")).alias("component_id"))
    return out.join(keyed.select("rid", "doc_id"), "rid").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
m AS (SELECT node, min(seen) AS smallest FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.smallest, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""
