"""Training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from tests.llm import brute
from textloom.llm import decontamination, language_id, mixing, ngram_join, quality, sharding, substring_dedup, suffix_array_dedup, token_output, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, slot string, bits binary"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i if ids is None else ids[i], t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [None, "", " \n\t ", "one", "a b c", LONG, LONG, "Ä ß é 12 % €", "word. " * 300]


def rows(spark, table="documents"):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/{table}.parquet").collect())


# --- codecs and orders ---------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 4000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.zipf(1.4, n) % 50_000, np.full(n, 7)):
        ids = ids.astype(np.uint32)
        payload, offsets = token_output.encode_blocks(ids)
        assert (token_output.decode_blocks(payload, offsets) == ids).all()
        assert len(offsets) == -(-n // token_output.BLOCK)


def test_orders():
    random.seed(1)
    for _ in range(100):
        some = [bytes(random.choice(b"ab") for _ in range(random.choice([0, 3, 40]))) for _ in range(30)]
        order, lcp = suffix_array_dedup.deep_shallow(some, 8)
        ranked = [some[i] for i in order]
        assert ranked == sorted(some)
        assert all(lcp[i] == substring_dedup.common_prefix(ranked[i - 1], ranked[i]) for i in range(1, len(ranked)))
        words = [b"".join(random.choice([b"a" * 8, b"b" * 8]) for _ in range(random.choice([0, 2, 9]))) for _ in range(30)]
        groups = list(substring_dedup.prefix_groups(words, 4))
        assert sorted(i for g in groups for i in g) == list(range(30))
        leaves = [i for g in groups for i in substring_dedup.suffix_tree(words, g)[0]]
        assert [words[i] for i in leaves] == sorted(words)


# --- token output --------------------------------------------------------------


def test_token_output(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [*EDGE, "Don't <|ENDOFTEXT|> x<|endoftext|>.", "a\x1cb c d", "İx ΣΣ. é", *[t for _, t in rows(spark)[:60]]]
    got = {r["doc_id"]: r for r in token_output.token_output(table(spark, texts), path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_output_repeated_ids_and_empty(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_output.token_output(table(spark, ["b", "a", "a", "c"], [5, 5, 5, None]), path).collect()
    assert sorted((r["start"], r["doc_id"]) for r in got) == [(0, None), (2, 5), (4, 5), (6, 5)]
    assert token_output.token_output(table(spark, []), path).count() == 0


def test_encoder_forgets_rare_words(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_output, "CACHE_WORDS", 50)
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for lo in (0, 60, 30, 0, 200):
        text = " ".join(f"w{i} x{i % 7}" for i in range(lo, lo + 80))
        ids, cut = encoder(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and cut.tolist() == [0, len(ids)]


# --- sharding --------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    full = sharding.lookup_table()
    counts = np.bincount(full)
    assert len(full) == sharding.TABLE_SIZE and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, fewer))
    assert moved < 3 * sharding.TABLE_SIZE / len(sharding.SHARDS)


def test_shard(spark):
    out = sharding.shard(table(spark, EDGE)).collect()
    names = sharding.lookup_table()
    assert all(r["shard"] == sharding.SHARDS[names[r["slot"]]] for r in out)
    assert sharding.shard(table(spark, [])).count() == 0


# --- toxicity --------------------------------------------------------------------


@pytest.mark.parametrize("dense", [0, 5, 512])
def test_nearest_is_exact(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(0)
    weights = rng.uniform(0.1, 5, 60)
    examples = []
    for i in range(900):
        f = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        examples.append((i, int(rng.integers(2)), f, rng.integers(1, 5, len(f)).astype(float)))
    index = toxicity.build(examples, weights, 0.5)
    full = np.zeros((900, 60))
    for i, _, f, tf in examples:
        w = (1 + np.log(tf)) * weights[f]
        full[i, f] = w / np.sqrt(w @ w) if len(f) else w
    some = examples[:150]
    edges = np.concatenate(([0], np.cumsum([len(e[2]) for e in some])))
    term, tf = np.concatenate([e[2] for e in some]), np.concatenate([e[3] for e in some])
    for skip in (None, np.array([int(np.flatnonzero(index.ids == e[0])[0]) for e in some])):
        near, cosines = index.nearest(term, index.unit(term, tf, edges), edges, skip=skip)
        for j, e in enumerate(some):
            want = full @ full[e[0]]
            if skip is not None:
                want[e[0]] = 0
            assert np.allclose(cosines[j], np.sort(want)[::-1][: toxicity.K])
            assert np.allclose(cosines[j], want[index.ids[near[j]]])


def test_toxicity_edges(spark):
    texts = [*EDGE, *["you vile zzgrub person"] * 9, *["kind words here"] * 9]
    docs = table(spark, [f"{t} {i}" if t and i > 8 else t for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1 if 9 <= i < 18 else 0) for i in range(4, 27)] + [(9, 0), (None, 1), (1, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    assert min(got[i]["score"] for i in range(9, 18)) > max(got[i]["score"] for i in (0, 1, 2, 20))
    assert toxicity.score(table(spark, []), labels).count() == 0
    assert all(r["score"] == 0 for r in toxicity.score(docs, labels.limit(0)).collect())


def test_toxicity_sample_goes_on_behind_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_SAMPLE_BYTES", 3_000)
    monkeypatch.setattr(toxicity, "MAX_EXAMPLE_BYTES", 900)
    texts = [f"text number {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    docs = lambda long: table(spark, [*(("y " * size if i == at else t) for i, t in enumerate(texts) for at, size in [long]), *["again"] * 50], [*range(60), *[3] * 50])
    for at in (0, 17, 59):
        for size in (2_000, 430):
            got = toxicity._sampled(docs((at, size)), labels).collect()
            assert len(got) == 61 - (size == 2_000) and sum(len(r["text"]) for r in got) <= 3_000


def test_toxicity_held_out(spark):
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert bad.score.rank().size and (bad.score.to_numpy()[:, None] > good.score.to_numpy()[None, :]).mean() >= 0.9
    assert bad.predicted.mean() >= 0.6 and good.predicted.mean() <= 0.01
    for lo, hi in ((0.0, 0.2), (0.8, 1.0)):  # calibrated
        some = got[(got.score >= lo) & (got.score <= hi)]
        assert abs(some.toxic.mean() - some.score.mean()) < 0.1


# --- language ----------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_edges(spark):
    docs = table(spark, [*EDGE, "12 34 !!", "\U0001f600 12", "\U00010330\U00010331", "\U0001d400 1"])
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.learned(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9, 10)] == ["und"] * 5 and {got[i]["lang_pred"] for i in (3, 11, 12)} == {"en"}
    assert language_id.predict(table(spark, []), language_id.learned(table(spark, []))).count() == 0


def test_language_sample_is_bounded_and_weights_are_sparse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r["lang"]: r["count"] for r in language_id.sampled(docs.select("doc_id", "text", "lang"), 60).groupBy("lang").count().collect()}
    assert len(counts) == 4 and all(15 <= n <= 60 for n in counts.values())
    model = language_id.learned(docs)
    assert 0 < len(model.feature) < 0.02 * language_id.DIM and (model.weight == 0).mean() > 0.2


def test_language_sample_loses_no_language(spark):
    same = [(7, f"some english words number {i}", "en") for i in range(60)] + [(100 + i, f"ein deutscher Satz mit Nummer {i}", "de") for i in range(60)]
    got = language_id.sampled(spark.createDataFrame(same, "doc_id bigint, text string, lang string"), 50).groupBy("lang").count().collect()
    assert {r[0]: r[1] for r in got} == {"en": 50, "de": 50}
    copies = [(i, "one text copied", "en") for i in range(500)] + [(i, f"another text {i}", "en") for i in range(80)]
    assert language_id.sampled(spark.createDataFrame(copies, "doc_id bigint, text string, lang string"), 50).count() == 50
    signs = [chr(0x4E00 + 40 * k + j) for k in range(70) for j in range(30)]
    rng = random.Random(1)
    many = [(i, "".join(rng.choice(signs[30 * k : 30 * k + 30]) for _ in range(40)), f"l{k:02}") for k in range(70) for i in range(12)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string, lang string")
    pred = language_id.predict(docs, language_id.train(docs)).collect()
    want = {t: k for _, t, k in many}
    assert {r["lang_pred"] for r in pred} == set(want.values())
    long = spark.createDataFrame([(1, "x" * (language_id.MAX_EXAMPLE_BYTES + 1), "en"), (2, "kurz", "de")], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in language_id.sampled(long).collect()] == [("de", "kurz")]


# --- mixing --------------------------------------------------------------------------


def test_mixing_edges(spark):
    got = mixing.mix(table(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] for r in got)
    sizes = {r["source"]: r for r in got}
    assert abs(sum(r["target"] for r in sizes.values()) - 1.5 * sum(r["source_size"] for r in sizes.values())) < 1e-6
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixing_of_rows_alike_comes_near_its_targets(spark):
    """Rows without ids, with one id, and equal in all columns; three sources."""
    made = [(None, f"w x y z{i % 40}", "a") for i in range(400)] + [(5, f"q r s {i}", "b") for i in range(400)] + [(None, "one and the same", "c")] * 500
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).groupBy("source", "source_size", "target").agg({"taken": "sum", "*": "count"}).collect()
    assert len(got) == 3 and sum(r["count(1)"] for r in got) == len(made)
    assert all(abs(r["sum(taken)"] - r["target"]) <= 2 + 0.01 * r["source_size"] for r in got), got


def test_mixing_comes_near_its_targets(spark):
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    by = got.assign(key=list(zip(got.source_size, got.target))).groupby("key").agg(taken=("taken", "sum"))
    for (size, target), taken in by.taken.items():
        assert abs(taken - target) <= 0.02 * size + 2_000 or taken % size == 0


# --- dedup ----------------------------------------------------------------------------


@pytest.mark.parametrize("tiny", [False, True])
def test_substring_dedup(spark, tiny):
    spec = replace(substring_dedup.SPEC, flush=50, piece=60, hot_hulls=1, lot=5) if tiny else substring_dedup.SPEC
    some = [*enumerate(EDGE), *[(100 + i, t) for i, t in rows(spark)]]
    docs = table(spark, [t for _, t in some], [i for i, _ in some])
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.substring_dedup(docs, spec).collect()}
    assert got == brute.substring_dedup(some)


@pytest.mark.parametrize("tiny", [False, True])
def test_suffix_array_dedup(spark, tiny):
    spec = replace(suffix_array_dedup.SPEC, flush=50, piece=900, hot_hulls=1, lot=5) if tiny else suffix_array_dedup.SPEC
    some = [*enumerate(EDGE), *[(100 + i, t) for i, t in rows(spark)[:120]]]
    docs = table(spark, [t for _, t in some], [i for i, _ in some])
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_array_dedup.suffix_array_dedup(docs, spec).collect()}
    assert got == brute.suffix_array_dedup(some)


def test_dedup_repeated_ids(spark):
    docs = table(spark, [LONG, LONG, "short"], [3, 3, None])
    gone = sorted(r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect())
    assert gone[-1] > 29_000 and gone[0] == 0
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0
    assert suffix_array_dedup.suffix_array_dedup(table(spark, [])).count() == 0


def near_copies(seed=5):
    rng = random.Random(seed)
    base = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.choice([3, 9, 60, 300]))) for _ in range(12)]
    out = []
    for text in base:
        for _ in range(rng.choice([1, 4, 40])):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
            out.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(40))
    return [*out, *[f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]]


@pytest.mark.parametrize("link", [ngram_join.Link(), ngram_join.Link(tile=2), ngram_join.Link(percent=80, shingle=5, tile=3)])
def test_ngram_join(spark, link):
    texts = [*EDGE, *near_copies()]
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.ngram_join(table(spark, texts), link).collect()}
    assert got == brute.ngram_join(list(enumerate(texts)), link.percent, link.shingle)


def test_ngram_join_empty_and_repeated(spark):
    assert ngram_join.ngram_join(table(spark, [])).count() == 0
    got = ngram_join.ngram_join(table(spark, ["a b c d e", "a b c d e", "", None], [7, 7, 8, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(7, 2, 7), (7, 2, 7), (8, 0, 8)]


# --- decontamination ---------------------------------------------------------------------


ITEM = "If Anna had 12 km and Bert took 7 km then Anna walks altogether nineteen more steps than Bert today."


def test_decontamination(spark):
    other = ITEM.replace("Anna", "Carl").replace("Bert", "Dora").replace("12", "30").replace("7", "9")
    mixed = ITEM.replace("Anna walks", "Dora walks").replace("than Bert", "than Dora").replace("Bert", "Dora")
    texts = [None, "", "clean text of its own", f"before, {ITEM} after", f"x {other} y", LONG, mixed.replace("Anna", "Dora")]
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.find(table(spark, texts), bench).collect()}
    assert {k for k in got} == {(3, 1), (4, 1)} and not got[4, 1]
    assert decontamination.find(table(spark, []), bench).count() == 0
    assert decontamination.find(table(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_every_passage(spark):
    docs, items = rows(spark), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op9_decontamination(spark, SF).collect()}
    assert {(d, i) for d, t in docs for i, q in items if q in (t or "")} <= got


QUIZ = "A baker sells nine loaves before noon, and the (small) shop across the street sells twice as many loaves; how many loaves do they sell?"


def found(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.find(table(spark, texts), bench).collect()}


def test_decontamination_of_edited_and_quoted_items(spark):
    words = QUIZ.split()
    edits = [" ".join("zz" if i in at else w for i, w in enumerate(words)) for at in ([0], [7], [12], [3, 17], [8, 19])]
    halves = [" ".join(words[: len(words) // 2 + 1]), " ".join(words[len(words) // 2 :])]
    moved = QUIZ.replace("before noon", "long before the noon bell")
    texts = [f"some words before {t} and some after" for t in (*edits, *halves, moved)] + ["the shop across the street is a baker", "how many loaves"]
    got = found(spark, texts, [QUIZ])
    assert set(got) == {(i, 0) for i in range(8)} and not any(got.values())


def test_decontamination_of_short_and_number_heavy_items(spark):
    heavy = "Add 12 and 7 to 30 then 5 and 9 to 4"
    items = ["two words", heavy, "12 7 30 4", "...", "lone"]
    texts = ["here are two words more", "two more words", f"x {heavy} y", "x Add 1 and 2 to 3 then 4 and 5 to 6 y", "12 7 30 4", "9 7 30 5", "... - ..."]
    assert set(found(spark, texts, items)) == {(0, 0), (2, 1), (3, 1), (4, 2)}


@pytest.mark.parametrize("limit", [0, decontamination.MAX_BROADCAST_WINDOWS])
def test_decontamination_is_the_same_by_either_join_and_without_punctuation(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_WINDOWS", limit)
    bare = "".join(c for c in QUIZ if c.isalpha() or c == " ")
    marked = " ".join(f"({w}," if i % 2 else f"{w} -" for i, w in enumerate(bare.split()))
    assert found(spark, [f"x {bare} y", f"x {marked} y", bare.lower(), "x y z"], [QUIZ]) == {(i, 0): True for i in range(3)}


def test_decontamination_with_values_that_coincide(spark):
    item = "The farmer has 3 apples and 5 pears in one basket, 3 plums in the other and eats 2 of them"
    texts = [f"x {item} y".replace(" 3 a", f" {a} a").replace("5", b).replace(" 3 p", f" {c} p").replace("2", d) for a, b, c, d in (("4", "4", "4", "4"), ("4", "9", "7", "1"), ("3", "3", "3", "3"))]
    assert set(found(spark, texts, [item])) == {(i, 0) for i in range(3)}


# --- quality ------------------------------------------------------------------------------


def test_quality_base(spark):
    some = [*enumerate(EDGE), (50, "Line one here.\nLine one here.\n\n \nOther | # line"), *[(100 + i, t) for i, t in rows(spark)]]
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.clean(table(spark, [t for _, t in some], [i for i, _ in some])).collect()}
    assert got == {i: brute.quality_base(t) for i, t in some}


def test_quality_verdict_and_text(spark):
    good = "\n".join(" ".join(f"term{i}x{j}" for j in range(9)) + "." for i in range(9))
    nav = "Home | About | Contact | Help\n" * 3
    got = {r["doc_id"]: r for r in quality.clean(table(spark, [good, f"{nav}{good}", "BUY!! NOW!! " * 60]), with_text=True).collect()}
    assert [got[i]["kept"] for i in range(3)] == [True, True, False]
    assert got[1]["clean_text"] == good
    assert quality.clean(table(spark, [])).count() == 0


# --- identity of words, lines and shingles ------------------------------------------------


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_told_apart(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids_crc32"] for r in token_output.token_output(table(spark, [a, b, f"{a} {b}"]), path).collect()}
    for i, text in enumerate((a, b, f"{a} {b}")):
        assert got[i] == zlib.crc32(np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())
    lines = quality.clean(table(spark, [f"{a}\n{b}", f"{a}\n{a}", f"{a} x y {b} x y"])).collect()
    assert [(r["n_dup_lines"], r["n_repeat_words"]) for r in sorted(lines, key=lambda r: r["doc_id"])] == [(0, 0), (1, 0), (0, 0)]
    sets = ngram_join.ngram_join(table(spark, [f"{a} q r s t", f"{b} q r s t", "".join("xy "[c == "b"] for c in a)])).collect()
    assert {r["component_id"] for r in sets} == {0, 1, 2}
    some = list(enumerate([" ".join([x, *(f"w{i}" for i in range(19))]) for x in (a, b, a)]))
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.substring_dedup(table(spark, [t for _, t in some])).collect()}
    assert got == brute.substring_dedup(some)
    some = [(0, a + "-" + b), (1, b + "+" + a)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_array_dedup.suffix_array_dedup(table(spark, [t for _, t in some])).collect()}
    assert got == brute.suffix_array_dedup(some)


def test_spans_hash_apart():
    from textloom.llm.windows import SpanHash

    rng = np.random.default_rng(3)
    items = np.concatenate((rng.integers(0, 3, 3000), np.tile([1, 2, 1, 1], 200))).astype(np.uint64)
    hashes = SpanHash(items)
    start = rng.integers(0, len(items) - 40, 4000)
    end = start + rng.integers(1, 40, 4000)
    h = hashes.spans(start, end)
    seen = {}
    for s, e, x in zip(start, end, h):
        assert seen.setdefault(int(x), tuple(items[s:e])) == tuple(items[s:e])
    assert len(seen) == len({tuple(items[s:e]) for s, e in zip(start, end)})


def test_ngram_join_of_a_large_family(spark):
    rng = random.Random(11)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(700):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(120)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 9, 12]))) for _ in range(120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.ngram_join(table(spark, texts), ngram_join.Link(flush=9_000, lot_rows=100)).collect()}
    assert got == brute.ngram_join(list(enumerate(texts)))


# --- queries against brute force ------------------------------------------------------------


def test_op2_equals_brute_force(spark):
    got = sharding.op2_sharding(spark, SF).collect()
    owner = brute.slots(sharding.SHARDS, sharding.TABLE_SIZE)
    size = {d: len((t or "").encode()) for d, t in rows(spark)}
    load = {}
    for r in got:
        assert r["shard"] == sharding.SHARDS[owner[r["slot"]]] and r["n_bytes"] == size[r["doc_id"]]
        n, b = load.get(r["shard"], (0, 0))
        load[r["shard"]] = (n + 1, b + r["n_bytes"])
    assert len(got) == len(size) and all((r["shard_docs"], r["shard_bytes"]) == load[r["shard"]] for r in got)


def test_op10_verdict_equals_brute_force(spark):
    texts = dict(rows(spark))
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc, r in got.items():
        kept, left = brute.line_verdict(texts[doc], quality.BOILERPLATE)
        assert (r["kept"], r["n_words_kept"]) == (kept and not r["base_failed"], left), doc


def test_decontamination_recall_on_items_with_other_values(spark):
    """Items with numbers and names, asked again with other ones inside other texts; and texts that hold none."""
    rng = random.Random(2)
    names, things = [f"{a}{b}" for a in ("An", "Be", "Ca", "Du", "El") for b in ("ra", "lo", "mi", "tus")], [f"thing{i}" for i in range(400)]

    def item(who, numbers, stuff):
        (a, b), (x, y, z) = who, numbers
        return f"{a} buys {x} {stuff[0]} and {y} {stuff[1]} at the {stuff[2]} near the {stuff[3]}, while {b} sells {z} {stuff[4]} of the {stuff[5]}; how many {stuff[6]} do {a} and {b} hold when the {stuff[7]} closes?"

    forms = [rng.sample(things, 8) for _ in range(60)]
    asked = [item(rng.sample(names, 2), rng.sample(range(2, 99), 3), f) for f in forms]
    again = [item(rng.sample(names, 2), rng.sample(range(2, 99), 3), f) for f in forms]
    filler = lambda: " ".join(rng.choice(things) for _ in range(60))
    texts = [f"{filler()} {q} {filler()}" for q in again] + [filler() for _ in range(60)]
    got = set(found(spark, texts, asked))
    assert len(got & {(i, i) for i in range(60)}) >= 54
    assert not {d for d, _ in got if d >= 60}  # items of one form may be found in each other's texts


# --- decontamination: precision, and the whole result ------------------------------------------


INNOCENT = [
    "Please tell us what is the name of your dog, and where it sleeps.",
    "We know that the capital of France is Paris and it rains there.",
    "She asked which of the following is true, and nobody knew.",
    "How many of them are there on a day like this in the whole of the town?",
    "In the middle of the night the train from Leeds to York was late again.",
]
QUESTIONS = [
    "What is the name of the largest planet?",
    "What is the capital of France?",
    "Which of the following is true of the moon and its phases over a month?",
    "How many of them are there in the basket after two are taken?",
    "A train leaves from Leeds to York in the middle of the day at nine; when does it arrive if it needs two hours?",
]


def test_decontamination_leaves_innocent_sentences_alone(spark):
    assert found(spark, INNOCENT, QUESTIONS) == {}
    inside = [f"He said: {q} And then he left." for q in QUESTIONS]
    shouted = [q.upper() for q in inside]
    assert {k for k in found(spark, inside, QUESTIONS)} == {(i, i) for i in range(5)}
    assert set(found(spark, shouted, QUESTIONS)) == {(i, i) for i in range(5)}
    assert set(found(spark, [q.lower() for q in inside], QUESTIONS)) == {(i, i) for i in range(5)}
    other = ITEM.replace("Anna", "Carl").replace("Bert", "Dora").replace("12", "30").replace("7", "9")
    assert set(found(spark, [other.lower(), other.upper()], [ITEM])) == {(0, 0), (1, 0)}


@pytest.mark.parametrize("holders", [16, 1, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, holders):
    monkeypatch.setattr(decontamination, "MAX_HOLDERS", holders)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["Anna", "Bert", "Carl", "12", "7", "km", "kg", "which of the", "is the"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 8, 12, 20]))) for _ in range(25)]
    items += [QUIZ, ITEM, ITEM, "Add 12 and 7 to 30 then 5 and 9 to 4", "", "...", *QUESTIONS]
    texts = [None, "", *INNOCENT]
    for item in items:
        words = item.split()
        for _ in range(2):
            some = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in words]
            texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(rng.randrange(9))), *some, *(rng.choice(vocabulary) for _ in range(9))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["verbatim"]) for r in decontamination.find(table(spark, texts), bench).collect()}
    want = brute.decontaminate(list(enumerate(texts)), list(enumerate(items)), decontamination)
    assert got == want and len(want) > 40
