"""What keeps tasks, shuffles and repeated work small as the tables grow."""

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trialsift.functions import payload as P
from trialsift.operators import context as X
from trialsift.operators import retrieval as R
from trialsift.operators import structure as S
from trialsift.plans import context as PC
from trialsift.plans import decisions as PD
from trialsift.plans import quotes as PQ
from trialsift.plans import retrieval as PR
from trialsift.sources import corpus

SF = "/root/testdata/sf0.001"


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_orders_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, "1-URGENT") for i in range(500)]
    made = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string")
    made.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(corpus, "ORDERS_A_TASK", 20, raising=False)
    orders = corpus.table(spark, str(tmp_path), "orders")
    assert orders.rdd.getNumPartitions() == 25
    assert sorted(r[0] for r in orders.select("o_orderkey").collect()) == list(range(500))


def test_degradations_draw_each_answer_once(spark):
    # answer, error and quote_found
    assert _plan(PD.answer_degradations(spark, SF)).count("md5(") == 3


def test_a_body_is_parsed_once(spark):
    # the body and the object inside its envelope
    bodies = spark.createDataFrame([('{"result": {"name": 1}}',)], "body string")
    fields = P.fold_metadata(F.col("body"))
    plan = _plan(bodies.select(fields["title"].alias("t")))
    assert len(re.findall(r"parse_?json", plan, re.I)) <= 2


def test_metadata_of_loose_bodies(spark):
    bodies = [
        '{"result": {"title": ["a", " ", "b"], "masking": "open", "outcomes": ["x", "y"]}}',
        '{"title": "t", "title": "u", "blind": "no"}',
        '{"title": null, "nct": 7, "secondary_outcomes": "one"}',
        "no json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    m = P.fold_metadata(F.col("body"))
    got = df.select("i", m["title"], m["blinding"], m["nct_number"], m["all_outcomes"]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("a b", "open", None, ["x", "y"]),
        ("t", "no", None, None),
        (None, None, "7", ["one"]),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_pages_are_shuffled_before_they_unfold(spark):
    plan = _plan(PQ.quote_page_texts(spark, SF), "executedPlan")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_annotations_keep_texts_in_place_and_rows_whole(spark):
    chosen = spark.createDataFrame(
        [(1, "a", True, "x"), (1, "a", True, "y"), (1, "b", False, "z"), (2, "a", True, "w"), (None, "a", True, "v"), (3, None, True, "u")],
        "doc_id long, segment_id string, annotate boolean, raw_text string",
    )
    found = spark.createDataFrame(
        [(1, "a", " n ", None), (1, "a", "m", None), (2, "a", None, "E"), (3, None, "k", None), (None, "a", "l", None)],
        "doc_id long, segment_id string, annotation string, annotation_error string",
    )
    done = S.apply_annotations(chosen, found)
    got = sorted((r.raw_text, r.annotation_status, r.annotation) for r in done.collect())
    none = "No risk-of-bias relevant content."
    assert got == [
        ("u", "failed", none), ("v", "failed", none), ("w", "failed", none), ("x", "succeeded_substantive", "m"),
        ("x", "succeeded_substantive", "n"), ("y", "succeeded_substantive", "m"), ("y", "succeeded_substantive", "n"), ("z", "not_run", none),
    ]
    dealt = chosen.repartition(5, "doc_id")
    plan = _plan(S.apply_annotations(dealt, found.hint("merge")), "executedPlan")
    assert "hashpartitioning(doc_id#" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, segment_id", plan)


@pytest.fixture
def segments(spark):
    rows = [Row(trial_id=f"s{i % 2}", doc_id=i, seg_ord=0, domain_tags=["D1"] if i % 3 else [], body="random allocation bias " * (i + 1),
                vec=None if i == 4 else [float(i), 1.0]) for i in range(8)]
    return spark.createDataFrame(rows, "trial_id string, doc_id long, seg_ord int, domain_tags array<string>, body string, vec array<double>")


def _rows(df):
    return sorted((r.trial_id, r.domain, r.doc_id, round(r.bm25, 9), None if r.dense is None else round(r.dense, 9)) for r in df.collect())


def test_cosines_of_documents_equal_those_of_segments(spark, segments):
    queries = spark.createDataFrame([("D1", [1.0, 0.0]), ("D2", [1.0, 1.0])], "domain string, query_vec array<double>")
    cosines = R.document_cosines(segments.select("doc_id", "vec"), queries)
    beside = segments.drop("vec").join(cosines, "doc_id", "left")
    assert _rows(R.candidates(beside, "body", queries)) == _rows(R.candidates(segments, "body", queries))


def test_few_and_many_trials_score_alike(spark, segments, monkeypatch):
    few = _rows(R.candidates(segments, "body"))
    monkeypatch.setattr(R, "BROADCAST_TRIALS", 0, raising=False)
    assert _rows(R.candidates(segments, "body")) == few


def test_index_terms_hold_no_vectors(spark):
    terms = PR.index_terms(spark, SF)
    assert "dense_of" in terms.columns and not {"vec", "body", "raw_text"} & set(terms.columns)


def test_trims_make_their_texts_once(spark):
    # a cap each for the domain text, with its extra, and for the report
    assert _plan(PC.context_trims(spark, SF)).count("regexp_replace(") <= 4


def test_prompts_do_not_deal_texts_by_question(spark):
    keys = ["doc_id"]
    asked = spark.createDataFrame(
        [(1, "both", "1.1"), (1, "both", "1.1"), (1, "adhering", "2.3"), (2, "both", "1.1"), (3, "both", "9.1")],
        "doc_id long, effect string, sq_id string",
    )
    texts = spark.createDataFrame(
        [(1, "D1", " a ", "s", "p"), (1, "D2", "b", None, "p"), (2, "D2", "c", None, "q"), (None, "D1", "d", None, "r")],
        "doc_id long, domain string, domain_specific_text string, supplement_block string, shared_prefix string",
    )
    wording = [("1.1", "both", "Q1", "A1"), ("2.3", "both", "Q2", "A2"), ("2.3", "adhering", "Q2x", "A2x")]
    templates = spark.createDataFrame(wording, "sq_id string, effect string, question_text string, answer_definitions string")
    found = X.sq_prompts(asked, texts, templates, keys)
    assert "hashpartitioning(doc_id" not in re.sub(r"hashpartitioning\(doc_id#\d+L, \d+\)", "", _plan(found.hint("merge"), "executedPlan"))
    got = sorted((r.doc_id, r.sq_id, r.call_label, r.prefix_text, r.suffix_text) for r in found.collect())
    head = "[Domain source text]\n{}\n\n[Supplement source text]\n{}\n\n[Signaling question]\n{}\n\n[Answer definitions]\n{}"
    first = (1, "1.1", "1.1|both", "[Static trial prefix]\np", head.format("a", "s", "Q1", "A1"))
    assert got == [first, first, (1, "2.3", "2.3|adhering", "[Static trial prefix]\np", head.format("b", "", "Q2x", "A2x"))]


def test_window_texts_are_measured_once(spark):
    pages = spark.createDataFrame([(1, 0, "ab"), (1, 1, "# Note\nc"), (1, 2, "")], "doc_id long, page int, text string")
    windows = S.supplement_windows(pages)
    assert _plan(windows.select("page_starts")).count("length(") == 1
    assert windows.first().page_starts == [0, 3, 12]


def test_lines_are_headings_whatever_stands_around_them(spark):
    label = "METHODS"
    lines = ["## Methods", "  #Methods:", "\u2003**methods**\u00a0", "#######  METHODS ...", "methods of old", "\u00df" * 9, "x" * 500, "", "# #"]
    pages = spark.createDataFrame([(1, 0, "\n".join(lines))], "doc_id long, page int, text string")
    heads = S.paper_headings(S.page_offsets(pages))
    assert "regexp_replace" not in _plan(heads)
    found = sorted((r.offset, r.label) for r in heads.collect())
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(4)]
    assert found == [(o, label) for o in starts]


def test_a_folder_is_listed_by_a_task(spark, tmp_path):
    """Spark's own listing holds every file on the driver; what is found in the folder stays the same."""
    import gzip

    from trialsift.sources import readers

    texts = {"NCT00000001.json": '\ufeff{"a":\n 1}\n', "nct00000002.json": "", "x y%20é.json": "é\r\n", "_hidden.json": "h", ".dot.json": "d", "a=b.pdf": "p", "c.pdf": "q", "_k=v.pdf": "r"}
    folder = tmp_path / "in here"
    (folder / "below").mkdir(parents=True)
    (folder / "below" / "NCT00000009.json").write_text("deep")
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    with gzip.open(folder / "z.json.gz", "wt") as out:
        out.write("packed")
    for path in (str(folder), f"file://{folder}"):
        own = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(folder))
        found = readers.read_supplement_files(spark, path)
        assert "FileScan" not in _plan(found, "optimizedPlan") and "Relation" not in _plan(found, "optimizedPlan")
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in own.selectExpr("path", "length", "sha2(content, 256)").orderBy("path").collect()]
        records = readers.read_registry(spark, path)
        assert "Relation" not in _plan(records, "optimizedPlan")
        seen = [text.removeprefix("\ufeff") for name, text in texts.items() if name[0] != "." and name != "_hidden.json"]
        assert sorted(r.body for r in records.collect()) == sorted([*seen, "packed"])
        assert {r.nct: r.body for r in records.where("nct IS NOT NULL").collect()} == {
            "NCT00000001": '{"a":\n 1}\n', "NCT00000002": ""
        }


def test_documents_are_dealt_once_for_all_that_unfolds_of_them(spark, tmp_path, monkeypatch):
    """Pages, sections and rows of papers need one exchange of the documents and no table of their texts."""
    from trialsift import session
    from trialsift.plans import context as PC
    from trialsift.plans import retrieval as PR
    from trialsift.plans import structure as PS

    kept = []
    whole = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: kept.append(df.columns) or whole(df))
    texts = [(i, f"# Methods\nwe drew lots {i}\n## Results\nall were well {i}", "crawl", "en", 40) for i in range(40)]
    made = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    vectors = spark.createDataFrame([(1, 2, [0.5, 1.0])], "vec_id long, label int, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    for df in (PS.sections(spark, str(tmp_path)), PC.rows(spark, str(tmp_path))):
        plan = _plan(df, "executedPlan")
        assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("Broadcast", "")
        assert "Scan ExistingRDD" not in plan
    assert PC.rows(spark, str(tmp_path)).count() == 40
    PR.index_segments(spark, str(tmp_path)).count()
    assert not [columns for columns in kept if "vec" in columns or "secs" in columns or "body" in columns]
