import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from trialsift.functions.payload import fold_answer, fold_metadata, recover_json
from trialsift.functions.similarity import lcs_length, partial_ratio, ratio
from trialsift.functions.unicode import fold_quote, normalize_quote


def table_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def every_window(a, b):
    a, b = sorted((a, b), key=len)
    m = len(a)
    return max(ratio(a, b[max(0, s) : s + m]) for s in range(1 - m, len(b)))


@given(st.text("abc ", max_size=90), st.text("abc ", max_size=90))
@settings(max_examples=150, deadline=None)
def test_lcs(a, b):
    assert lcs_length(a, b) == table_lcs(a, b)


def test_partial_ratio_equals_every_window():
    rng = random.Random(7)
    for _ in range(300):
        letters = "abcdefg "[: rng.randint(2, 8)]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 140)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        best = every_window(a, b)
        assert partial_ratio(a, b) == pytest.approx(best)
        assert partial_ratio(a, b, 85) == pytest.approx(best if best >= 85 else 0)


def test_ratio_of_equal_and_disjoint():
    assert ratio("overall survival", "overall survival") == 100.0
    assert ratio("abc", "xyz") == 0.0


def test_fold_quote_ligature_and_hyphen_break():
    assert fold_quote("Eﬃcacy was con-\n firmed­  HERE") == "efficacy was confirmed here"


ENVELOPE = {"choices": [{"message": {"content": "```json\n{\"a\": 1}\n```"}}]}


def test_recover_json(spark):
    cases = [
        ('{"a": 1}', "raw", '{"a": 1}'),
        ('```json\n{"a": 1}\n```', "fence", '{"a": 1}'),
        ('so: {"a": "}{"} end', "balanced", '{"a": "}{"}'),
        ('a {broken} one, then {"b": {"c": 2}}', "balanced", '{"b": {"c": 2}}'),
        ('{\\"a\\": 1}', "unescaped", '{"a": 1}'),
        (json.dumps(json.dumps({"a": "[x"})), "unescaped", '{"a": "[x"}'),
        (json.dumps(ENVELOPE), "fence", '{"a": 1}'),
        ("[1, 2]", None, None),
        ("nothing", None, None),
        ("", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    rows = {r.i: r.r for r in df.select("i", recover_json(F.col("t")).alias("r")).collect()}
    for i, (_, step, payload) in enumerate(cases):
        assert (rows[i].step, rows[i].payload) == (step, payload), cases[i]
        assert (rows[i].payload is None) == (rows[i].error is not None)


def test_text_that_looks_like_json_is_kept(spark):
    bodies = [
        {"answer": "Y", "quote": "[12] patients were randomised by computer", "rationale": "[Table 2] allocation"},
        {"answer": "Y", "quote": ["a", " ", "b"], "reasoning": "{x"},
        {"answer": "Y", "quote": None, "source": "[", "metadata": "{no object", "title": "[1] T"},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    rows = df.select("i", *[c.alias(n) for n, c in fold_answer(F.col("body")).items()]).orderBy("i").collect()
    assert [r.quote for r in rows] == ["[12] patients were randomised by computer", "a\nb", "["]
    assert [r.justification for r in rows] == ["[Table 2] allocation", "{x", ""]
    assert df.where("i = 2").select(fold_metadata(F.col("body"))["title"]).first()[0] == "[1] T"


def test_quote_folding_paths_agree(spark):
    texts = ["A  b-\nc D", "  x-  y- z ", "randomi\u00ad sation", "Stra\u00dfe \ufb01ne-\n tuned", "tab\there", "", "\x1cq"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", normalize_quote(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [fold_quote(t) for t in texts]


def test_no_window_is_scored_that_cannot_beat_the_best(monkeypatch):
    from trialsift.functions import similarity

    scored = []
    whole = similarity._window_lcs
    monkeypatch.setattr(similarity, "_window_lcs", lambda m, masks, codes, starts: scored.append(len(starts)) or whole(m, masks, codes, starts))
    rng = random.Random(11)
    hay = "".join(rng.choice("abcdefghij klmno") for _ in range(4000))
    base = hay[2000:2070]
    damaged = "".join(base[i : i + 12] for i in range(0, 70, 13))
    assert partial_ratio(damaged, hay) == pytest.approx(every_window(damaged, hay))
    assert sum(scored) < 200
    assert partial_ratio("x\U0001F600é" * 9, "é\U0001F600x" * 40) == pytest.approx(every_window("x\U0001F600é" * 9, "é\U0001F600x" * 40))


def test_a_good_score_needs_windows_near_its_pieces_only(monkeypatch):
    from trialsift.functions import similarity

    rng = random.Random(5)
    cases = []
    for _ in range(60):
        hay = "".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(80, 400)))
        at = rng.randint(0, len(hay) - 70)
        base = rng.choice(["", "zz"]) + hay[at : at + 70]
        cases.append(("".join(base[i : i + 12] for i in range(0, len(base), 13)), hay))
    best = [every_window(q, hay) for q, hay in cases]
    assert min(best) > 88

    def refused(*_):
        raise AssertionError("windows of the whole text")

    monkeypatch.setattr(similarity, "_window_bounds", refused)
    for (q, hay), score in zip(cases, best):
        assert partial_ratio(q, hay) == pytest.approx(score)
        assert partial_ratio(q, hay, score) == pytest.approx(score)
        assert partial_ratio(q, hay, score + 0.1) == 0
        assert partial_ratio(q, hay, 85, 85) >= 85
