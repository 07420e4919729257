"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Terms are words and word stems (the first STEM letters) of whole texts.  A term
weighs (1 + log tf) * idf * contrast: document frequencies are those of the whole
corpus, and the contrast, z^2 / (z^2 + SOFT) of the two-proportion test that
toxic examples hold the term more often than others, is a smooth weight without
a cut: every term that leans to toxic examples counts, the surer the more.
(Without it nearly all of a text's weight lies in words that mark nothing.)

A text's neighbours are the K examples of highest cosine, found exactly: examples
lie in blocks, every (term, block) holds its largest weight, and a text opens the
blocks of largest bound first and then those whose bound beats its K-th best.
Texts come in batches, so that one pass over an opened block serves all texts
that need it; the DENSE most frequent terms of a block lie in a matrix, the
others in inverted lists.  Neighbours vote with their similarity; a logistic
curve fitted to the leave-one-out votes of all examples turns votes into
probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import crc_bucket, row_chunks, span_codes, strings, word_spans, written

#: Bounds of the labelled sample, taken in order of the id's hash: rows, bytes of all their texts, bytes of one text.
#: A text beyond the last, or that does not fit what is left, is passed over and the next ones are tried.
MAX_EXAMPLES, MAX_SAMPLE_BYTES, MAX_EXAMPLE_BYTES = 4_096, 48 << 20, 1 << 20
STEM = (4, 5)
SOFT = 30.0
K, BLOCK, DENSE, BATCH = 15, 256, 512, 256
THRESHOLD = 0.7
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_"


def word_terms(word: str) -> tuple[str, ...]:
    """The terms of one word: itself without outer marks, and its stems."""
    bare = word.strip(_EDGE)
    return (bare, *(f"{bare[:n]}~" for n in STEM if len(bare) > n)) if bare else ()


def text_terms(column: pa.Array, ids_of: Callable[[bytes], tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, times, text bounds) of a few MB of texts at a time: terms of a text ascend; ids_of gives a word's terms."""
    _, offsets = strings(column)
    for lo, hi in row_chunks(offsets):
        data, at = strings(pc.utf8_lower(column.slice(lo, hi - lo)))
        starts, ends, first = word_spans(data, at)
        if not len(starts):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64)
            continue
        code, distinct = span_codes(data, starts, ends)
        found = [ids_of(w) for w in distinct.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        pair, times = np.unique(doc * len(found) + code, return_counts=True)
        doc, code = np.divmod(pair, len(found))
        n = size[code]
        stop = np.cumsum(n)
        term = flat[np.repeat(begin[code] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        doc, times = np.repeat(doc, n), np.repeat(times, n)
        order = np.lexsort((term, doc))
        term, doc, times = term[order], doc[order], times[order]
        head = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) if len(term) else np.zeros(0, np.int64)
        yield term[head], np.add.reduceat(times, head) if len(head) else times, np.searchsorted(doc[head], np.arange(hi - lo + 1))


@dataclass
class Index:
    """Examples in blocks; a matrix of frequent terms, postings of the others by (block, term), and block maxima."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of a term: idf * contrast
    column: np.ndarray  # of a term: its column of the matrix, or -1
    matrix: np.ndarray  # frequent terms x examples, padded to whole blocks
    run_term: np.ndarray  # term of every run of postings, ascending within its block
    run_start: np.ndarray  # first posting of every run, and the end
    block_runs: np.ndarray  # first run of every block, and the end
    row: np.ndarray  # of a posting: example number within the block
    value: np.ndarray  # of a posting: TF-IDF weight over the example's norm
    maxima: np.ndarray  # float32, terms x blocks
    prior: float

    def unit(self, term: np.ndarray, tf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """TF-IDF weights of texts over their norms."""
        w = (1.0 + np.log(tf)) * self.weights[term]
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        return w / np.sqrt(np.bincount(doc, weights=w * w, minlength=len(edges) - 1))[doc]

    def nearest(self, term: np.ndarray, weight: np.ndarray, edges: np.ndarray, k: int = K, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), texts x k, best first, ties by example number; cosine 0 is no neighbour.

        skip: per text the number of an example that does not count, or -1.
        """
        n, blocks = len(edges) - 1, self.maxima.shape[1]
        doc = np.repeat(np.arange(n), np.diff(edges))
        bounds = np.zeros((n, blocks))
        some = np.flatnonzero(np.diff(edges))
        if len(some):
            bounds[some] = np.add.reduceat(weight[:, None] * self.maxima[term], edges[some], axis=0)
        frequent = self.column[term] >= 0
        dense = np.zeros((n, self.matrix.shape[0]))
        dense[doc[frequent], self.column[term[frequent]]] = weight[frequent]
        doc, term, weight = doc[~frequent], term[~frequent], weight[~frequent]
        score, opened = np.zeros((n, blocks * BLOCK)), np.zeros((n, blocks), bool)

        def open_(block: int, texts: np.ndarray) -> None:
            lo, hi = self.block_runs[block : block + 2]
            there = self.run_term[lo:hi]
            place = np.full(n, -1)
            place[texts] = np.arange(len(texts))
            mine = np.flatnonzero(place[doc] >= 0)
            at = np.minimum(np.searchsorted(there, term[mine]), max(len(there) - 1, 0))
            hit = np.flatnonzero(there[at] == term[mine]) if len(there) else at[:0]
            run, mine = lo + at[hit], mine[hit]
            length = self.run_start[run + 1] - self.run_start[run]
            stop = np.cumsum(length)
            posting = np.repeat(self.run_start[run] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)
            cell = np.repeat(place[doc[mine]], length) * BLOCK + self.row[posting]
            sums = np.bincount(cell, weights=np.repeat(weight[mine], length) * self.value[posting], minlength=len(texts) * BLOCK)
            score[texts, block * BLOCK : (block + 1) * BLOCK] = sums.reshape(len(texts), BLOCK) + dense[texts] @ self.matrix[:, block * BLOCK : (block + 1) * BLOCK]
            opened[texts, block] = True
            if skip is not None:
                left_out = texts[skip[texts] // BLOCK == block]
                score[left_out, skip[left_out]] = 0.0

        best = np.argsort(-bounds, axis=1, kind="stable")[:, :2]
        for block in np.unique(best).tolist():
            open_(block, np.flatnonzero((best == block).any(axis=1)))
        k = min(k, score.shape[1])
        for turn, block in enumerate(np.argsort(-bounds.sum(axis=0), kind="stable").tolist()):
            if turn % 6 == 0:
                floor = np.partition(score, -k, axis=1)[:, -k]
            need = np.flatnonzero(~opened[:, block] & (bounds[:, block] > np.maximum(floor - 1e-6, 0.0)))
            if len(need):
                open_(block, need)
        top = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)
        least = np.take_along_axis(score, top, 1).min(axis=1)
        tied = np.flatnonzero((score >= least[:, None]).sum(axis=1) > k)  # more candidates than places: the smallest numbers stay
        for i in tied.tolist():
            top[i] = np.sort(np.lexsort((np.arange(score.shape[1]), -score[i]))[:k])
        cosines = np.take_along_axis(score, top, 1)
        order = np.argsort(-cosines, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(cosines, order, 1)

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each weighed by its cosine, drawn to the prior when they are far."""
        mass = 0.05
        label = np.append(self.labels, np.zeros(BLOCK))[np.minimum(examples, len(self.labels))]
        return ((cosines * label).sum(axis=1) + mass * self.prior) / (cosines.sum(axis=1) + mass)


def build(examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: np.ndarray, prior: float) -> Index:
    """examples: (id, label, terms, tf).  Sorting by strongest term gathers like with like in blocks."""
    vectors = []
    for i, y, f, tf in examples:
        w = (1.0 + np.log(tf)) * weights[f]
        vectors.append((i, y, f, w / np.sqrt(w @ w) if len(f) else w))
    vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, v[0]))
    n, blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
    row = np.repeat(np.arange(n), [len(v[2]) for v in vectors])
    term = np.concatenate([v[2] for v in vectors] or [np.zeros(0)]).astype(np.int64)
    value = np.concatenate([v[3] for v in vectors] or [np.zeros(0)])
    maxima = np.zeros((len(weights), blocks), np.float32)
    np.maximum.at(maxima, (term, row // BLOCK), value)
    maxima = np.nextafter(maxima, np.float32(2)) * (maxima > 0)  # rounding to float32 must not lower a bound
    often = np.bincount(term, minlength=len(weights))
    column = np.full(len(weights), -1)
    frequent = np.argsort(-often, kind="stable")[:DENSE]
    column[frequent] = np.arange(len(frequent))
    matrix = np.zeros((len(frequent), blocks * BLOCK))
    listed = column[term] >= 0
    matrix[column[term[listed]], row[listed]] = value[listed]
    row, term, value = row[~listed], term[~listed], value[~listed]
    block = row // BLOCK
    order = np.lexsort((row, term, block))
    row, term, value, block = row[order], term[order], value[order], block[order]
    head = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(row) else np.zeros(0, np.int64)
    return Index(
        np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], float), weights, column, matrix, term[head], np.append(head, len(row)),
        np.searchsorted(block[head], np.arange(blocks + 1)), row % BLOCK, value, maxima, prior,
    )


def platt(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic curve by damped Newton steps; the slope has a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).mean() + 1e-4 * a, (p - y).mean()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).mean() + 1e-4, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -3, 3), b - np.clip(db, -3, 3)
    return float(a), float(b)


def contrasts(sample: DataFrame) -> tuple[dict[str, int], np.ndarray, float]:
    """(term -> number, contrast of each, share of label 1) of (text, label) rows; counts are by distinct text.

    Terms that toxic examples do not hold more often than others have contrast 0
    and no number.  Their number is bounded by the sample's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        known: dict[bytes, tuple[int, ...]] = {}
        times: list[np.ndarray] = []

        def ids_of(word: bytes) -> tuple[int, ...]:
            if word not in known:
                known[word] = tuple(number.setdefault(t, len(number)) for t in word_terms(word.decode()))
            return known[word]

        n = np.zeros(2, np.int64)
        for batch in batches:
            label, at = batch.column(1).to_numpy(), 0
            n += np.bincount(label, minlength=2)
            for term, _, edges in text_terms(batch.column(0), ids_of):
                mine = np.repeat(label[at : at + len(edges) - 1], np.diff(edges))
                times.append(np.stack([np.bincount(term[mine == y], minlength=len(number)) for y in (0, 1)]))
                at += len(edges) - 1
        total = sum((np.pad(x, ((0, 0), (0, len(number) - x.shape[1]))) for x in times), np.zeros((2, len(number)), np.int64))
        yield pa.RecordBatch.from_pydict({"term": pa.array([*number, None], pa.string()), "pos": pa.array([*total[1], n[1]], pa.int64()), "neg": pa.array([*total[0], n[0]], pa.int64())})

    counts = written(sample.dropDuplicates(["text"]).mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    total = counts.where("term is null").first()
    n1, n0 = (float(total["pos"]), float(total["neg"])) if total else (0.0, 0.0)
    if not n1 or not n0:
        return {}, np.zeros(0), 0.0
    lead = F.col("pos") / n1 - F.col("neg") / n0
    p = (F.col("pos") + F.col("neg") + 0.5) / (n1 + n0 + 1.0)
    z2 = lead * lead / (p * (1 - p) * (1 / n1 + 1 / n0))
    rows = counts.where(F.col("term").isNotNull() & (lead > 0)).select("term", (z2 / (z2 + SOFT)).alias("contrast")).collect()
    rows.sort(key=lambda r: r["term"])
    return {r["term"]: i for i, r in enumerate(rows)}, np.array([r["contrast"] for r in rows]), n1 / (n1 + n0)


def features(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(doc_id, f, tf): a text's numbered terms and their times; every row, whole texts, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(number)  # terms of the sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known: dict[bytes, tuple[int, ...]] = {}

        def ids_of(word: bytes) -> tuple[int, ...]:
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(number[t] for t in word_terms(word.decode()) if t in number)
            return got

        for batch in batches:
            at = 0
            for term, times, edges in text_terms(batch.column(1), ids_of):
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(edges) - 1), *lists], names=["doc_id", "f", "tf"])
                at += len(edges) - 1
                if len(known) > 300_000:
                    known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, f array<int>, tf array<int>")


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, terms, times, bounds) of BATCH texts at a time."""
    f, tf = batch.column(1), batch.column(2)
    edges, terms = np.asarray(f.offsets), f.values.to_numpy()
    shift = int(np.asarray(tf.offsets)[0]) - int(edges[0])
    times = tf.values.to_numpy()
    for lo in range(0, batch.num_rows, BATCH):
        hi = min(batch.num_rows, lo + BATCH)
        a, b = int(edges[lo]), int(edges[hi])
        yield lo, hi, terms[a:b].astype(np.int64), times[a + shift : b + shift].astype(float), (edges[lo : hi + 1] - a).astype(np.int64)


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label): labelled rows in order of the id's hash, each that fits the bounds; equal rows count once."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    chosen = [(r[0], r[1]) for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES).collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint, label int"))  # MAX_EXAMPLES rows at most
    rows = written(docs.join(wanted, "doc_id").where(F.octet_length("text") <= MAX_EXAMPLE_BYTES).select("doc_id", "text", "label").dropDuplicates(["doc_id", "text"]))
    keyed = rows.withColumn("_text", F.xxhash64("text"))
    fitting, left = [], MAX_SAMPLE_BYTES
    for r in keyed.select("doc_id", "_text", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(MAX_EXAMPLES).collect():
        if r["size"] <= left:
            left -= r["size"]
            fitting.append((r["doc_id"], r["_text"]))
    kept = F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id bigint, _text bigint"))  # MAX_EXAMPLES rows at most
    return keyed.join(kept, ["doc_id", "_text"], "left_semi").select("doc_id", "text", "label")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, vote, evidence (neighbour ids), similarity (their cosines).

    labels: (doc_id, toxic) of rows to learn from; a null toxic is no label, a
    doc_id labelled more than once is toxic if any says so; rows that repeat a
    labelled doc_id with other texts are examples each.  A text without a term that leans to toxic
    examples (null and empty ones too) has no neighbours and gets the curve's
    value at the prior.  With nothing to learn from, every score is 0.  Repeated
    rows score alike; a long text is one vector, and a task holds the words of
    one text, or of about 2 MB of shorter ones, at a time.  Columns besides id
    and text are not read, whatever their names.  Neighbours of equal cosine
    come in order of their block.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    sample = _sampled(slim, labels)
    number, contrast, prior = contrasts(sample.select("text", "label"))
    found = written(features(slim, number))
    stats = {r["x"]: r["n"] for r in found.select(F.explode("f").alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()} if number else {}
    n_docs = found.count()
    idf = np.log((1 + n_docs) / (1 + np.array([stats.get(i, 0) for i in range(len(number))], float))) + 1.0
    rows = features(sample, number).join(F.broadcast(sample.select(F.col("doc_id").alias("_id"), "label").distinct()), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "f", "tf").collect() if number else []
    examples = sorted(((r[0], int(r[1]), np.array(r[2], np.int64), np.array(r[3], float)) for r in rows), key=lambda e: (e[0], e[1]))
    index = build(examples, idf * contrast, prior)
    sent = spark.sparkContext.broadcast(index)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        place = {int(d): i for i, d in enumerate(index.ids)}
        for batch in batches:
            for lo, hi, term, tf, edges in _vectors(batch):
                ids = batch.column(0).slice(lo, hi - lo)
                skip = np.array([place.get(d, -1) for d in ids.to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "vote": index.vote(*index.nearest(term, index.unit(term, tf, edges), edges, skip=skip))})

    slope, offset = 0.0, -30.0
    if examples:
        label = {e[0]: e[1] for e in examples}
        own = found.join(F.broadcast(spark.createDataFrame([(d,) for d in label], "doc_id bigint")), "doc_id", "left_semi")
        votes = own.mapInArrow(leave_out, "doc_id bigint, vote double").collect()
        slope, offset = platt(np.array([r[1] for r in votes]), np.array([label[r[0]] for r in votes], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for lo, hi, term, tf, edges in _vectors(batch):
                if len(index.ids):
                    near, cosines = index.nearest(term, index.unit(term, tf, edges), edges)
                    votes = index.vote(near, cosines)
                    scores = 1.0 / (1.0 + np.exp(-np.clip(slope * votes + offset, -30, 30)))
                else:
                    near, cosines, votes, scores = np.zeros((hi - lo, 0), np.int64), np.zeros((hi - lo, 0)), np.zeros(hi - lo), np.zeros(hi - lo)
                met = cosines > 0
                bounds = pa.array(np.concatenate(([0], np.cumsum(met.sum(axis=1)))), pa.int32())
                evidence = index.ids[near[met]] if met.any() else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "score": pa.array(scores, pa.float64()), "vote": pa.array(votes, pa.float64()), "evidence": pa.ListArray.from_arrays(bounds, pa.array(evidence, pa.int64())), "similarity": pa.ListArray.from_arrays(bounds, pa.array(cosines[met], pa.float64()))})

    scored = found.mapInArrow(run, "doc_id bigint, score double, vote double, evidence array<bigint>, similarity array<double>")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "vote", "evidence", "similarity")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_bucket(F.col("doc_id"), 3) != 1)
    held = (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(docs, labels).select("doc_id", held, "score", "predicted", "vote", "evidence")
