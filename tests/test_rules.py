"""Rules, facts and carriers fire on literal texts."""

from __future__ import annotations

from textloom.operators import carriers, forensics, measured_rules, rules, writing_rules


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_rules_fire(spark):
    texts = ["In conclusion, we delve into it. We delve into more.", "It is so here. It is so there. It is so now! It was.", "However, so. " * 12 + "word " * 20, "", None]
    got = {(r["doc_id"], r["rule_id"], r["matched"], r["n"]) for r in rules.findings(table(spark, texts)).collect()}
    assert {(0, "style.overused_phrase", "delve into", 2), (0, "style.overused_phrase", "in conclusion", 1), (1, "style.repeated_opening", "it is so", 3), (2, "style.transition_density", "however", 12)} <= got
    assert not {x for x in got if x[0] > 2}


def test_facts(spark):
    text = "Write to a.b@c.org by 2024-05-06 at 10:30 pm: it costs £1,200.50 for 12 kg [3], see https://x.org/a `code` “said so”."
    got = {(r["kind"], r["matched"]) for r in forensics.facts(table(spark, [text, None, ""])).collect()}
    assert {("email", "a.b@c.org"), ("date", "2024-05-06"), ("time", "10:30 pm"), ("currency", "£1,200.50"), ("unit", "12 kg"), ("citation", "[3]"), ("url", "https://x.org/a"), ("code", "`code`"), ("quote", "“said so”")} <= got


def test_integrity(spark):
    texts = ["plain", "a\u200bb", "a\u200b\u200c\u200bb", "x\U000e0041\U000e0042", None, "\U0001f468\u200d\U0001f469 \u2764\ufe0f", "\U0001f3f4\U000e0067\U000e0062\U000e007f", " ".join(["a\u2060b"] * 8), "p\u0430ssword", "\ue000 \ue001"]
    got = {r["doc_id"]: r["status"] for r in carriers.integrity(table(spark, texts)).collect()}
    assert got == {0: "clean", 1: "attention", 2: "manipulated", 3: "manipulated", 5: "clean", 6: "clean", 7: "manipulated", 8: "attention", 9: "attention"}
    tiers = {(r["doc_id"], r["start"]): (r["code_point"], r["severity"], r["tier"]) for r in carriers.carrier_findings(table(spark, texts)).collect()}
    assert tiers[1, 1] == (0x200B, "medium", "deliberate") and tiers[9, 0] == (0xE000, "medium", "supporting") and tiers[6, 1] == (0xE0067, "high", "excluded") and not {k for k in tiers if k[0] == 5}


def test_every_wording_rule_fires(spark):
    found = writing_rules.wording_findings(table(spark, writing_rules.PROBES)).collect()
    assert {r["rule"] for r in found} == {r.name for r in writing_rules.WORDING}
    for r in found:
        text = writing_rules.PROBES[r["doc_id"]]
        assert text[r["start"] :].lower().startswith(r["matched"]), r


#: Texts whose rhythm each rule looks for.
RHYTHM = {
    "sentence-flatline": "The old boat left the small harbour before the rain had begun again. " * 6,
    "uniformity": "\n\n".join(f"We met at the mill on day {i}. Then the rain came over the hill. After that all went home again." for i in range(5)),
    "smart-punct-signature": "She said “no” to the first, second, and third of them — " + "and so the whole crew of the ship walked home along the quiet road in the rain " * 6 + "at last.",
    "punct-distribution": "\n\n".join(f"One, two and three went out, then four came home; the rest stayed {w}, as planned." for w in ("late", "long", "there", "up", "in")),
    "cross-para-burstiness": "\n\n".join(f"We saw a {w} boat. It had a red sail up. The wind was {w} too." for w in ("fast", "slow", "new", "old", "big")),
    "fnword-trigram-entropy": "the " * 160 + "cat of the town and the sea.",
    "low-ttr": "one red boat and two blue ones went out to sea with nets. " * 20,
    "token-cutoff": "The crew mended nets and talked about weather in the long evening. " * 10 + "\nand then they all went down to the harbour with",
    "setup-expansion-cadence": "It was late. The rest of the crew had gone down to the harbour with the nets and all of the ropes. " * 6,
    "passive-ratio": "The boat was painted by them. The nets were mended in time. " * 6,
    "low-specificity": "people often think about things in many ways and this can help them to see how things work in general over time " * 16 + ".",
}


def test_measured_rules_fire(spark):
    got = {r["rule"] for r in measured_rules.measured_findings(table(spark, measured_rules.PROBES)).collect()}
    rhythm: dict = {}
    for r in measured_rules.measured_findings(table(spark, list(RHYTHM.values()))).collect():
        rhythm.setdefault(r["doc_id"], set()).add(r["rule"])
    assert all(rule in rhythm.get(i, ()) for i, rule in enumerate(RHYTHM)), rhythm
    assert {m.name for m in measured_rules.measures()} <= got | set(RHYTHM)
    assert {"tier2", "tier3", "tier3-phrase", "bold-label-bullets", "uniform-list-items", "bullet-np-list", "title-case-header", "invalid-isbn", "proximity-cluster"} <= got


def test_plain_prose_has_no_finding(spark):
    text = "The ferry left at nine in the rain. My sister had packed bread and two apples, and we ate them on the deck. Nobody spoke much."
    assert writing_rules.wording_findings(table(spark, [text, None, "", "too few words"])).count() == 0


def test_visible_text(spark):
    html = "<p>a &amp;lt; b&#33;</p><script>x<y</script><!-- no --><div>c&nbsp;<b>d</b><br>e &#xD800; &#128512;</div>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")
    assert [tuple(r) for r in rules.visible_text(pages).collect()] == [(1, "a &lt; b!\nc d\ne &#xD800; \U0001f600")]


def test_rows_that_repeat_a_doc_id_stay_apart(spark):
    from textloom.operators import carriers, measured_rules

    clean = "The cat sat on the mat and then it went home to eat its supper there."
    bad = "Moreover, we delve into a rich tapestry of robust ideas. I hope this helps! a​‌​b pаsswoрd"
    docs = spark.createDataFrame([(1, clean), (1, bad), (None, bad), (1, None), (2, "short")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["status"], r["longest_run"], r["n_deliberate"]) for r in carriers.integrity(docs).collect()))
    assert got == [(0, "manipulated", 3, 5), (1, "clean", 0, 0), (1, "manipulated", 3, 5), (2, "clean", 0, 0)]
    scored = sorted((r["doc_id"] or 0, r["score"] > 0, r["n_rules"] > 0) for r in measured_rules.scores(docs).collect())
    assert scored == [(0, True, True), (1, False, False), (1, True, True)]


def test_verdicts_raise_for_artefacts_and_keep_plain_prose(spark):
    from textloom.operators import verdicts

    plain = "The ferry left at nine in the rain. My sister had packed bread and two apples, and we ate them on the deck. Nobody spoke much. "
    texts = {
        "plain": plain,
        "artefact": plain + "Send it to INSERT_NAME_HERE please.",
        "citations": plain + "As told contentReference[oaicite:1]{index=1} and [web:12] so.",
        "none": "",
        "blank": " \n",
        "short": "two words",
        "long": "walk " * 10_001,
        "hidden": plain + "a​b c​d",
    }
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(0, texts["artefact"]), (None, None)]
    got = [(r["doc_id"], r["status"], r["classification"], r["escalation"]) for r in verdicts.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    name = lambda i: list(texts)[i]
    by = {}
    for i, *rest in got:
        by.setdefault("null" if i is None else name(i), []).append(tuple(rest))
    assert len(got) == len(rows)
    assert sorted(by["plain"], key=str) == [("scored", "human_like", None), ("scored", "mixed_signals", "artefact_score")]
    assert by["artefact"] == [("scored", "mixed_signals", "artefact_score")]
    assert by["citations"][0][1:] == ("ai_like", "citation_co_occurrence")
    assert by["none"] == by["blank"] == by["null"] == [("empty", None, None)] and by["short"] == [("too_short", None, None)] and by["long"] == [("too_long", None, None)]
    assert by["hidden"][0][0] == "scored"
    p = verdicts.verdicts(spark.createDataFrame([(1, plain)], "doc_id bigint, text string")).first()
    assert (p["score"], p["human"], p["mixed"], p["ai"], p["n_findings"]) == (0, 1.0, 0.0, 0.0, 0) and p["confidence"] == "medium"


#: Letters with marks at the edges of words, a Kelvin sign, a long s, white space of other kinds, marks that a scan puts in, stage directions with stars, matches without and with a group.
ODD = (
    "le caféboasts a vieẃ, and the boastsé of it; moreover\x0bit delves, delve DELVE and Key takeaways, ſhowcase and boaſtſ",
    "﷐moreover﷑ we delve﷒ into it ﷓ and furthermore﷔ a robust\U000f0000 tapestry, red, green, and blue, one, two, and three",
    "He *nodsé slowly* and *nods slowly* here, *smiles*. Thаnk me later. Then thank me later​ again: bookmark this post.\nthank me later",
    "One must-read, a b c d e f g: you won't want to miss this one! \\n\\n and \\n\\n and x\\\\n\\n; load-bearing walls, load-bearing ideas, load-bearing",
)


def test_wording_over_odd_texts_equals_sql(spark):
    import duckdb

    from tests.compare import differences

    con = duckdb.connect()
    con.execute("CREATE TABLE odd (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", [*enumerate(ODD), (99, None), (100, "")])
    docs = table(spark, [*ODD, None, ""])
    got = differences(writing_rules.wording_findings(docs), con, writing_rules.wording_sql("SELECT * FROM odd"))
    assert got[0] == got[1] > 0 and got[2] == 0, got
