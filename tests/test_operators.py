"""Small fixtures for quotes, skew helpers, segmentation, sinks, sources and text."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialsift.functions import text as T
from trialsift.operators import answers as A
from trialsift.operators import quotes as Q
from trialsift.operators import registry as R
from trialsift.operators import retrieval as RT
from trialsift.operators import skew
from trialsift.operators import structure as S
from trialsift.operators import trace as O
from trialsift.sources import readers, sinks

SOURCES = "doc_id long, priority int, source_document string, text string, page_required boolean, source_page int"


def resolve(spark, quotes, pages, extra=()):
    answers = Q.normalize_answers(spark.createDataFrame([(1, i, q) for i, q in enumerate(quotes)], "doc_id long, answer_id int, quote string"))
    page_df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc_id long, page int, text string")
    rows = [(1, 0, "paper", "\n".join(pages), True, None), *extra]
    out = Q.resolve(answers, Q.normalize_sources(spark.createDataFrame(rows, SOURCES)), Q.normalized_pages(page_df))
    return {r.answer_id: (r.quote_found, r.page, r.source_document) for r in out.collect()}


def test_quote_resolution_cases(spark):
    pages = [
        "Patients were recruited in twelve hospitals and the allocation was",
        "concealed with sealed opaque envelopes. Eﬃcacy was con-\nfirmed in both arms of the trial.",
        "A total of 120 participants completed the trial without major deviations.",
    ]
    quotes = [
        "sealed opaque envelopes",
        "efficacy was confirmed in both arms",
        "the allocation was concealed with sealed opaque",
        "a total of 120 participnts completed teh trial",
        "120 partixx",
        "nothing like this sentence can be found anywhere here",
        "",
        "registered as a parallel trial",
        "supplement only statement about masking",
    ]
    extra = [
        (1, 1, "registry", "Registered as a parallel trial", False, None),
        (1, 2, "supp", "A supplement only statement about masking.", True, 7),
    ]
    got = resolve(spark, quotes, pages, extra)
    assert got[0] == (True, 1, "paper")
    assert got[1] == (True, 1, "paper")
    assert got[2] == (True, 0, "paper")  # straddles a page break: earlier page
    assert got[3] == (True, 2, "paper")  # fuzzy
    assert got[4][0] is False  # too short for a fuzzy match
    assert got[5] == (False, None, None)
    assert got[6][0] is False
    assert got[7] == (True, None, "registry")
    assert got[8] == (True, 7, "supp")


def test_hot_key_join_equals_join(spark):
    big = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id % 50) AS k")
    small = spark.range(40).selectExpr("id AS k", "id * 2 AS v")
    for how in ("left", "inner"):
        want = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()))
        got = sorted(map(tuple, skew.hot_key_join(big, small, ["k"], how).select("id", "k", "v").collect()))
        assert [(a, b, c if c is not None else -1) for a, b, c in got] == [(a, b, c if c is not None else -1) for a, b, c in want]


def test_exact_rank_and_running_sum_with_a_hot_group(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id % 7) AS g", "id", "id * 7919 % 1000 AS score")
    ranked = skew.exact_rank(df, ["g"], [F.desc("score"), F.asc("id")], "r")
    w = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    want = df.withColumn("r", F.row_number().over(w))
    assert ranked.select("g", "id", "r").exceptAll(want.select("g", "id", "r")).isEmpty() and ranked.count() == 5000
    summed = skew.running_sum_before(df, ["g"], "id", F.col("score"), "s", block=64)
    ws = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("s", F.coalesce(F.sum("score").over(ws), F.lit(0)))
    assert summed.select("g", "id", "s").exceptAll(plain.select("g", "id", "s")).isEmpty()


def test_sections_nest_under_top_level(spark):
    text = "## ABSTRACT\nShort.\n## METHODS\nRandom allocation.\n## STATISTICAL ANALYSIS\nDone.\n## RESULTS\nGood."
    pages = spark.createDataFrame([(1, 0, text), (2, 0, "plain"), (3, 0, " ")], "doc_id long, page int, text string")
    rows = S.build_sections(pages).collect()
    by = {(r.doc_id, r.label): r for r in rows}
    assert by[1, "METHODS"].text.endswith("Done.") and "RESULTS" not in by[1, "METHODS"].text
    assert by[1, "STATISTICAL ANALYSIS"].text == "## STATISTICAL ANALYSIS\nDone."
    assert by[2, "FULL_TEXT"].parsing_quality == "STANDARD"
    assert by[3, "FULL_TEXT"].parsing_quality == "DEGRADED" and len(by[3, "FULL_TEXT"].domain_tags) == 5


def test_fragments_and_document_guards(spark):
    body = "x" * 80
    page = f"# Study design\n{body}\n# FAX\nshort\n# Outcome assessment\n{body}\n# Blinding\n{body}"
    many = "\n".join(f"# Topic {chr(65 + i % 26)}{i} heading\n{body}" for i in range(90))
    pages = spark.createDataFrame(
        [(1, 0, page), (2, 0, f"# Conflict of interest\n{body}"), (3, 0, many)], "doc_id long, page int, text string"
    )
    rows = S.segment_documents(pages).orderBy("doc_id", "seg_ord").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert [r.heading for r in first] == ["STUDY DESIGN", "OUTCOME ASSESSMENT", "BLINDING"]
    # a cut starts at the heading's own words, so the mark before the next heading stays behind
    assert first[0].raw_text.endswith("FAX\nshort\n#")
    assert [r.heading for r in rows if r.doc_id in (2, 3)] == ["FULL_DOCUMENT", "FULL_DOCUMENT"]


def test_layout_headings(spark):
    lines = [(1, 0, "Methods", 10.0, False), (1, 0, "Trial oversight", 12.0, False), (1, 0, "Body text here.", 10.0, True), (1, 0, "lower case", 14.0, True), (1, 0, "text", 10.0, False)]
    out = S.layout_boxes(spark.createDataFrame(lines, "doc_id long, page int, text string, size double, is_bold boolean"))
    assert {r.text for r in out.where("boxclass = 'section-header'").collect()} == {"Methods", "Trial oversight"}


def test_sentence_rerank_is_a_greedy_skip(spark):
    text = "Alpha one two. Random random words here now. Beta. Random tail."
    df = spark.createDataFrame([(text,)], "t string")
    # five tokens taken; the next best (two) and "Alpha one two." (three) do not fit six, "Beta." does
    out = df.select(RT.rerank_sentences(F.col("t"), {"random": 1}, 6)).first()[0]
    assert out == "Random random words here now. Beta."


def test_registered_outcome_match(spark):
    body = json.dumps({"protocolSection": {"outcomesModule": {"primaryOutcomes": [{"measure": "Overall survival"}], "secondaryOutcomes": [{"measure": "Quality of life"}]}}})
    recs = R.parse_records(spark.createDataFrame([("NCT00000001", body), ("NCT00000002", "[1]")], "nct string, body string"))
    asked = spark.createDataFrame([("NCT00000001", "Quality of life"), ("NCT00000001", "Adverse events"), ("NCT00000002", "x")], "nct string, outcome string")
    got = {r.outcome: r for r in R.match_outcomes(asked, recs).collect()}
    assert got["Quality of life"].outcome_similarity_score == 1.0
    assert (got["Quality of life"].outcome_change_detected, got["Quality of life"].registered_as_primary) == (False, False)
    assert got["Adverse events"].outcome_similarity_score < 0.85
    assert got["x"].registered_outcome is None and got["x"].outcome_change_detected is None


def test_costs_keep_unknown_apart_from_zero(spark):
    rows = [("gpt-oss-120b", 1_000_000, 1_000_000, None, None), ("gpt-oss-120b", 10, None, 5, None), ("nope", 1, 1, None, None), ("gpt-oss-120b-free", 9, 9, None, None), ("gpt-5.5", None, None, None, None)]
    calls = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long").withColumn("i", F.monotonically_increasing_id())
    costs = [r.cost for r in O.call_costs(calls, O.model_prices(spark)).orderBy("i").collect()]
    assert costs[0] == pytest.approx(0.219) and costs[1:3] == [None, None] and costs[3] == 0.0 and costs[4] is None


def test_failed_call_is_ni_and_flagged(spark):
    df = spark.createDataFrame([("Y", "Timeout", "q", 3, "j", True, 1, None), ("Y", None, "q", 3, "j", False, 1, None)], "answer string, error string, quote string, page int, justification string, quote_found boolean, segments_available int, retrieval_top_score double")
    a, b = A.finalize(df).collect()
    assert (a.final_answer, a.quote_verified, a.flag, a.page) == ("NI", True, "FLAGGED", None)
    assert (b.final_answer, b.quote_verified, b.flag, b.quote) == ("NI", False, "FLAGGED", "")


def test_upsert_is_idempotent_and_keeps_other_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "trial_id string, outcome string, effect_of_interest string, model_sq string, pipeline_version string, batch_seq int, assessment_id string, overall_judgment string"
    row = lambda t, seq, j: (t, "o", "assignment", "m", "v", seq, f"{t}{seq}", j)
    first = spark.createDataFrame([row(f"T{i}", 1, "Low") for i in range(50)], schema)
    second = spark.createDataFrame([row("T1", 2, "High"), row("T1", 3, "Low"), row("T99", 1, "High")], schema)
    for batch in (first, second, second):
        sinks.upsert(batch, path, buckets=4)
    got = {r.trial_id: (r.overall_judgment, r.batch_seq) for r in sinks.read_results(spark, path).collect()}
    assert len(got) == 51 and got["T1"] == ("Low", 3) and got["T99"] == ("High", 1) and got["T7"] == ("Low", 1)


def test_upsert_keeps_columns_and_bucket_count(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    kw = {"key": ("k",), "order": ("seq",), "buckets": 4}
    sinks.upsert(make([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, extra string"), path, **kw)
    sinks.upsert(make([("a", 2), ("c", 1)], "k string, seq int"), path, **kw)
    sinks.upsert(make([("d", 1, 7)], "k string, seq int, more int"), path, **kw)
    rows = {r.k: (r.seq, r.extra, r.more) for r in sinks.read_results(spark, path).collect()}
    assert rows == {"a": (2, None, None), "b": (1, "y", None), "c": (1, None, None), "d": (1, None, 7)}
    with pytest.raises(ValueError):
        sinks.upsert(make([("a", 3)], "k string, seq int"), path, **(kw | {"buckets": 8}))
    with pytest.raises(ValueError):
        sinks.upsert(make([("b", "3")], "k string, seq string"), path, **kw)


def _quotes(spark, quote):
    return Q.normalize_answers(spark.createDataFrame([("d", 1, quote)], "doc_id string, answer_id int, quote string"))


SOURCE = "doc_id string, priority int, source_document string, text string, page_required boolean, source_page int"
PAGE = "doc_id string, page int, text string"


def test_source_without_page_gives_way_to_the_next(spark):
    text = "patients were randomised by computer"
    sources = Q.normalize_sources(
        spark.createDataFrame([("d", 0, "paper", text, True, None), ("d", 1, "registry", text, False, None)], SOURCE)
    )
    none = Q.normalized_pages(spark.createDataFrame([], PAGE))
    row = Q.resolve(_quotes(spark, text), sources, none).first()
    assert (row.quote_found, row.page, row.source_document) == (True, None, "registry")


def test_word_broken_over_pages_is_found_on_the_first(spark):
    pages = Q.normalized_pages(spark.createDataFrame([("d", 0, "we used randomi-"), ("d", 1, "sation of sites")], PAGE))
    rows = Q.locate_pages(_quotes(spark, "we used randomisation of sites"), pages).collect()
    assert [(r.page, r.page_score) for r in rows] == [(0, 100.0)]


def test_quote_audit_names_empty_sources(spark):
    sources = Q.normalize_sources(spark.createDataFrame([("d", 0, "paper", " ", True, None)], SOURCE))
    row = Q.describe(_quotes(spark, "a quote of some length"), sources).first()
    assert (row.verified, row.failure_reason) == (False, "source text is empty")


def test_manifest_csv_and_json(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text("﻿trial_label,main_paper,supplements,nct_number,outcomes\nA 1,p.pdf, s1.pdf ;/abs/s2.pdf;,nct00000001,OS ;  Adverse   events;\nB,/x/q.pdf,,,\n", encoding="utf-8")
    rows = readers.read_manifest(spark, str(csv)).collect()
    assert rows[0].trial_label == "A 1" and rows[0].nct_number == "NCT00000001" and rows[0].outcomes == ["OS", "Adverse events"]
    assert rows[0].supplements == [f"{tmp_path}/s1.pdf", "/abs/s2.pdf"] and rows[0].main_paper == f"{tmp_path}/p.pdf"
    assert rows[1].outcomes is None and rows[1].supplements == [] and rows[1].main_paper == "/x/q.pdf"
    js = tmp_path / "m.json"
    for body in ({"entries": [{"main_paper": "/a.pdf", "outcomes": "X"}]}, [{"main_paper": "/a.pdf", "outcomes": "X"}]):
        js.write_text(json.dumps(body))
        spark.catalog.clearCache()
        assert [(r.main_paper, r.outcomes) for r in readers.read_manifest(spark, str(js)).collect()] == [("/a.pdf", ["X"])]


def test_gold_labels(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Trial,D1,D2,D3,D4,D5,Overall Risk\nT,L,S,H,L,L,Some Concerns\n")
    r = readers.read_gold(spark, {"OS": str(tmp_path / "g.csv")}).first()
    assert (r.d1, r.d2, r.d3, r.overall_as_published, r.outcome) == ("Low", "Some concerns", "High", "Some concerns", "OS")


def test_rows_to_markdown_and_label_tests(spark):
    df = spark.createDataFrame([([["a", "b|c"], [None, " "], ["d"]],)], "r array<array<string>>")
    assert df.select(T.rows_to_markdown(F.col("r"))).first()[0] == "|a|b\\|c|\n|---|---|\n|d||"
    tags = spark.createDataFrame([("Committee", "x")], "l string, t string").select(T.domain_tags(F.col("l"), F.col("t"))).first()[0]
    assert tags == ["D2"]  # "itt" is a substring test


def test_best_source_of_several(spark):
    from trialsift.operators import quotes as Q

    text = "patients were randomised by a central computer in blocks of four"
    texts = [(1, 0, "paper", "nothing of the kind"), (1, 1, "registry", text[:-9] + " of five sites"), (1, 2, "supplement", text), (1, 3, "copy", text),
             (2, 0, "paper", text[:20] + text[24:]), (2, 1, "registry", text[:30] + text[31:]), (3, 0, "paper", "")]
    sources = spark.createDataFrame(texts, "doc_id long, priority int, source_document string, norm_text string")
    quotes = spark.createDataFrame([(1, 0, text), (2, 0, text), (2, 1, ""), (3, 0, text)], "doc_id long, answer_id int, norm_quote string")
    all_scores = Q.verify(quotes, sources.where("norm_text <> ''"), 0.0).collect()
    best = {(r.doc_id, r.answer_id): r for r in Q.describe(quotes, sources, 50.0).collect()}
    for at, r in best.items():
        mine = [(-x.score, x.priority, x.source_document) for x in all_scores if (x.doc_id, x.answer_id) == at and x.norm_quote]
        assert r.match_score == (-min(mine)[0] if mine else 0.0) and r.matched_source_document == (min(mine)[2] if mine else None)
    kept = Q.verify(quotes, sources.where("norm_text <> ''"), 0.0, best_only=True).where("doc_id = 1")
    assert {r.source_document for r in kept.collect()} == {"supplement", "copy"}


def test_a_text_is_dealt_once_whatever_is_quoted_from_it(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [("d", 0, "paper", text, True, None), ("d", 1, "registry", text[:40], False, None), ("e", 0, "paper", "other words", True, None)]
    sources = Q.normalize_sources(spark.createDataFrame(rows, SOURCE))
    pages = Q.normalized_pages(spark.createDataFrame([("d", 0, text[:900]), ("d", 1, text[900:]), ("e", 0, "other words")], PAGE))
    given = [("d", i, text[i * 10 : i * 10 + 50].replace("word1", "wrd1")) for i in range(100)] + [("d", 100, text[:30]), ("e", 0, "other words"), (None, 7, "x")]
    quotes = Q.normalize_answers(spark.createDataFrame(given, "doc_id string, answer_id int, quote string"))
    # rows and the texts beside them: one exchange a table, none of a quote beside a text
    for df in (Q.describe(quotes, sources), Q.resolve(quotes, sources, pages), Q.first_verifying_source(quotes, sources)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "xxhash64(norm_text" not in plan and "MapInArrow" in plan
    told = {(r.doc_id, r.answer_id): r for r in Q.resolve(quotes, sources, pages).collect()}
    assert len(told) == 103 and all(r.quote_found for k, r in told.items() if k[0] == "d")
    assert told["e", 0].page == 0 and told["d", 60].page == 0 and told["d", 95].page == 1 and not told[None, 7].quote_found
    single = {(r.doc_id, r.answer_id): r for r in Q.first_verifying_source(quotes, sources).collect()}
    assert {k: r.source_document for k, r in single.items()} == {k: r.source_document for k, r in told.items() if r.quote_found}
