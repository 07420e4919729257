"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 letters, case folded, runs of
other characters as one blank) with TF-IDF weights: the term frequency is
relative to the text's n-grams, so length does not count.  Weights are learned
by follow-the-regularised-leader with elastic-net penalties on a bounded sample
of labelled rows, then a temperature is fitted on rows kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.common import crc_bucket, row_chunks, strings

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
DIM = len(ORDERS) << BUCKET_BITS
#: Bounds of the labelled sample: texts per language, chosen by hash, and texts in all, of which each language has LEAST_ROWS at least;
#: bytes of one text.  Languages are as many as there are.
MAX_ROWS_PER_LANGUAGE, MAX_ROWS, LEAST_ROWS = 1_200, 12_000, 20
MAX_EXAMPLE_BYTES = 1 << 20
#: More languages than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_LANGUAGES = 50_000
UNDETERMINED = "und"


def _fold_table() -> np.ndarray:
    """Code point -> lower case of a letter, else a blank."""
    table = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_FOLD: np.ndarray | None = None


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts back to back (blanks squeezed) and text starts."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _fold_table()
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    starts = lead[offsets]
    folded = _FOLD[points]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    kept = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return folded[keep], kept[starts]


def grams(points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (feature per position, text per position); none crosses a text's end."""
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    h = np.zeros(len(points), np.uint32)
    for level, n in enumerate(ORDERS):
        m = len(points) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x9E3779B1) + points[n - 1 : n - 1 + m]
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x85EBCA6B)
        feature = (x >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (level << BUCKET_BITS)
        if n > 1:
            inside = doc[:m] == doc[n - 1 : n - 1 + m]
            yield feature[inside], doc[:m][inside]
        else:
            yield feature, doc


@dataclass
class Model:
    """Sparse weights: rows of features that have none are not kept, nor sent."""

    languages: list[str]
    feature: np.ndarray  # features with a weight other than 0
    weight: np.ndarray  # float32, those features x languages: idf * weight
    bias: np.ndarray
    temperature: float

    @cached_property
    def place(self) -> np.ndarray:
        """Row of ``rows`` per feature; the first row is that of features without a weight."""
        out = np.zeros(DIM, np.int32)
        out[self.feature] = np.arange(1, len(self.feature) + 1)
        return out

    @cached_property
    def rows(self) -> np.ndarray:
        return np.concatenate((np.zeros((1, len(self.languages)), np.float32), self.weight))

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages, whether a text has a letter)."""
        n = len(offsets) - 1
        points, starts = code_points(data, offsets)
        total, logits = np.zeros(n), np.zeros((n, len(self.languages)))
        for feature, doc in grams(points, starts):
            total += np.bincount(doc, minlength=n)
            at = self.place[feature]
            some = np.flatnonzero(at)
            at, doc = at[some], doc[some]
            step = max(1 << 12, (1 << 21) // len(self.languages))  # bounds the rows that are gathered at once
            for lo in range(0, len(at), step):
                mine = doc[lo : lo + step]
                edge = np.flatnonzero(np.diff(mine, prepend=-1))
                logits[mine[edge]] += np.add.reduceat(self.rows[at[lo : lo + step]], edge, axis=0, dtype=np.float64)
        letter = np.bincount(np.repeat(np.arange(n), np.diff(starts)), weights=points != 0x20, minlength=n) > 0
        logits = (logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True), letter


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 1e-4, seed: int = 7) -> Model:
    """FTRL-proximal on (label, features, relative frequencies) rows; every fifth row fits the temperature."""
    met = np.unique(np.concatenate([f for _, f, _ in rows]))  # only these can get a weight
    rows = [(label, np.searchsorted(met, f), tf) for label, f, tf in rows]
    df = np.zeros(len(met))
    for _, feature, _ in rows:
        df[feature] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1.0
    k = len(languages)
    z, n2 = np.zeros((len(met), k)), np.zeros((len(met), k))
    bias, bias_n = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(seed).permutation(len(rows))
    train, held = [i for j, i in enumerate(order) if j % 5], [i for j, i in enumerate(order) if j % 5 == 0]

    def weights(feature: np.ndarray) -> np.ndarray:
        zf, nf = z[feature], n2[feature]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))

    for _ in range(epochs):
        for i in train:
            label, feature, tf = rows[i]
            x = tf * idf[feature] * SCALE
            w = weights(feature)
            logit = x @ w + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            nf = n2[feature]
            z[feature] += g - (np.sqrt(nf + g2) - np.sqrt(nf)) / alpha * w
            n2[feature] = nf + g2
            bias_n += p * p
            bias -= 0.1 * p / (1.0 + np.sqrt(bias_n))
    w = weights(np.arange(len(met)))
    logits = np.array([(rows[i][2] * idf[rows[i][1]] * SCALE) @ w[rows[i][1]] + bias for i in held]).reshape(len(held), k)
    labels = np.array([rows[i][0] for i in held], int)
    some = np.flatnonzero(w.any(axis=1))
    return Model(languages, met[some], (w[some] * idf[some, None] * SCALE).astype(np.float32), bias, _temperature(logits, labels))


#: Relative frequencies are small; this brings them to the order of one.
SCALE = 20.0


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a grid from sharp to flat."""
    if not len(labels):
        return 1.0
    best, least = 1.0, np.inf
    for t in np.geomspace(0.05, 20.0, 121):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        loss = np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels])
        if loss < least - 1e-9:
            best, least = float(t), loss
    return best


def _level() -> Column:
    """Trailing zero bits of the text's hash: half of all texts have 1 or more, a quarter 2 or more, ..."""
    return F.expr("bit_count((xxhash64(text) & -xxhash64(text)) - 1)")


def sampled(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE, max_all: int = MAX_ROWS) -> DataFrame:
    """Rows of (lang, text) to learn from: per language its texts, or ``max_rows`` of them by hash.

    Equal texts count once, so that no group of copies fills the sample.  Distinct
    texts are estimated by language and hash level in one pass with map-side sketches;
    only levels that hold some ``max_rows`` of a language's texts are shuffled, and
    of these the first by hash are kept.  With many languages each has an equal
    share of ``max_all``, LEAST_ROWS at least; none is left out.  Texts of more than
    MAX_EXAMPLE_BYTES are no examples.
    """
    good = labelled.where((F.col("lang").isNotNull()) & (F.octet_length("text") <= MAX_EXAMPLE_BYTES)).select("lang", "text", _level().alias("_level"))
    counts: dict[str, dict[int, int]] = {}
    for r in good.groupBy("lang", "_level").agg(F.approx_count_distinct(F.xxhash64("text"), 0.03)).collect():  # 65 rows a language at most
        counts.setdefault(r[0], {})[r[1]] = r[2]
    each = max(LEAST_ROWS, min(max_rows, max_all // max(1, len(counts))))
    least = []
    for lang, by_level in counts.items():
        at, left = max(by_level) + 1, 0
        while at and left < 1.2 * each:  # the estimate's error is far less
            at -= 1
            left += by_level.get(at, 0)
        least.append((lang, at))
    levels = labelled.sparkSession.createDataFrame(least, "lang string, _least int")
    small = F.broadcast if len(least) <= MAX_BROADCAST_LANGUAGES else (lambda df: df)
    some = good.join(small(levels), "lang").where("_level >= _least").dropDuplicates(["lang", "text"])
    first = some.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")))
    return first.where(F.col("_place") <= each).select("lang", "text")


def train(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> Model:
    """labelled: (text, lang) and any further columns.  At most ``max_rows`` texts per language are used."""
    sample = sampled(labelled, max_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                points, starts = code_points(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                found = [f for f, _ in grams(points, starts)]
                if not found:
                    continue
                feature, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "f": [feature.astype("<i4").tobytes()], "tf": [(times / times.sum()).astype("<f4").tobytes()]})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        languages = sorted({lang for lang, _, _ in got})
        if languages:
            model = fit([(languages.index(lang), np.frombuffer(f, "<i4"), np.frombuffer(tf, "<f4").astype(np.float64)) for lang, f, tf in got], languages)
            numbers = {"feature": model.feature.astype("<i4"), "weight": model.weight.astype("<f4"), "bias": model.bias.astype("<f8")}
            yield pa.RecordBatch.from_pydict({"languages": [languages], **{k: [v.tobytes()] for k, v in numbers.items()}, "temperature": [model.temperature]})

    # the sample, of bounded size, is fitted in one task: the driver gets the weights only
    rows = sample.mapInArrow(vectors, "lang string, f binary, tf binary").repartition(1)
    for r in rows.mapInArrow(fitted, "languages array<string>, feature binary, weight binary, bias binary, temperature double").collect():
        languages = list(r["languages"])
        weight = np.frombuffer(r["weight"], "<f4").reshape(-1, len(languages))
        return Model(languages, np.frombuffer(r["feature"], "<i4"), weight, np.frombuffer(r["bias"], "<f8"), r["temperature"])
    return Model([UNDETERMINED], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros(1), 1.0)


def verdicts(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language of at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = strings(batch.column(at))
            good = []
            for lo, hi in row_chunks(offsets, 1 << 20):
                p, letter = model.probabilities(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                good.append(letter & (p.max(axis=1) >= min_score))
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; no shuffle.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing was learned.  Of languages that score alike the first by
    name counts.  Repeated rows are predicted alike; a long text is one text, and
    a task holds about 1 MB of texts, or one longer text, at a time.  Columns
    besides id and text are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets, 1 << 20):
                p, letter = model.probabilities(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "lang_pred": pa.array(np.where(letter, names[best], UNDETERMINED), pa.string()), "score": np.where(letter & (names[best] != UNDETERMINED), p.max(axis=1), 0.0)})

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def learned(docs: DataFrame) -> Model:
    """The model of documents whose crc32(doc_id) mod 5 is not 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return train(rows.where(crc_bucket(F.col("doc_id"), 5) != 0))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learned(docs)).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
