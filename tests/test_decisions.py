"""Exhaustive enumeration of answer states and named regressions."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import decisions as D

CODES = C.RAW_CODES


def states(spark, domain, effect="assignment"):
    """All supplied answer combinations of one domain, routed."""
    sqs = C.DOMAIN_SQS[domain]
    n = len(CODES) ** len(sqs)
    codes = "array(" + ",".join(f"'{c}'" for c in CODES) + ")"
    cols = [f"{codes}[CAST(floor(id / {5 ** i}) % 5 AS INT)] AS {D.col_of(s)}" for i, s in enumerate(sqs)]
    wide = spark.range(n).selectExpr("id", f"'{effect}' AS effect", *cols)
    rest = {D.col_of(s): F.lit(None).cast("string") for s in C.ALL_SQS if s not in sqs}
    return D.route(wide.withColumns(rest)).withColumn("v", D.domain_verdict(domain, effect if domain == "D2" else None))


@pytest.mark.parametrize(
    "domain,effect",
    [("D1", "assignment"), ("D2", "assignment"), ("D2", "adhering"), ("D4", "assignment"), ("D5", "assignment")],
)
def test_every_state_reaches_a_judgment(spark, domain, effect):
    routed = states(spark, domain, effect)
    assert routed.where("v IS NULL").count() == 0
    assert routed.where("NOT endswith(v.rationale, concat(' -> ', v.judgment))").count() == 0


def test_d3_hole_is_null_not_an_error(spark):
    routed = states(spark, "D3")
    hole = {(r.q31, r.q32, r.q33) for r in routed.where("v IS NULL").select("q31", "q32", "q33").distinct().collect()}
    assert hole == {("PN", "NI", "NA"), ("N", "NI", "NA"), ("NI", "NI", "NA")}


def _wave(effect, supplied):
    """Ask in waves from nothing, as an interactive run would, to a fixpoint."""
    yes, no = {"Y", "PY"}, {"N", "PN"}
    open_yes, open_no = yes | {"NI"}, no | {"NI"}
    known = {}
    while True:
        a = known.get
        ask, na = {"2.1", "2.2"}, set()
        if effect == "assignment":
            ask.add("2.6")
            chain = [("2.3", None), ("2.4", yes), ("2.5", open_yes)]
            if a("2.1") in open_yes or a("2.2") in open_yes:
                ask.add("2.3")
            elif a("2.1") and a("2.2"):
                na.add("2.3")
            for (prev, _), (sq, gate) in zip(chain, chain[1:]):
                if a(prev):
                    (ask if a(prev) in gate else na).add(sq)
            if a("2.6"):
                (ask if a("2.6") in open_no else na).add("2.7")
        else:
            ask |= {"2.4", "2.5"}
            na.add("2.7")
            if a("2.1") in open_yes or a("2.2") in open_yes:
                ask.add("2.3")
            elif a("2.1") and a("2.2"):
                na.add("2.3")
            if a("2.3") in open_no or a("2.4") in open_yes or a("2.5") in open_yes:
                ask.add("2.6")
            elif a("2.3") and a("2.4") and a("2.5"):
                na.add("2.6")
        fresh = {s: "NA" for s in na if s not in known} | {s: supplied[s] for s in ask if s not in known}
        if not fresh:
            return known
        known |= fresh


@pytest.mark.parametrize("effect", ["assignment", "adhering"])
def test_direct_gates_equal_wave_by_wave_asking(spark, effect):
    rows = states(spark, "D2", effect).where("id % 17 = 0").collect()
    codes = {r.id: [CODES[r.id // 5**i % 5] for i in range(7)] for r in rows}
    for r in rows:
        supplied = dict(zip(C.DOMAIN_SQS["D2"], codes[r.id]))
        assert {s: r[D.col_of(s)] for s in supplied} == _wave(effect, supplied)


@pytest.mark.parametrize("codes,expected", [(("Y", "Y", "N"), "Low"), (("Y", "Y", "Y"), "Some concerns"), (("Y", "NI", "Y"), "High")])
def test_direction_of_baseline_imbalance(spark, codes, expected):
    df = spark.createDataFrame([codes], "q11 string, q12 string, q13 string")
    assert df.select(D.domain_judgment("D1")).first()[0] == expected


def test_rollup_of_all_combinations(spark):
    rows = [("t", str(i), "assignment", f"D{d + 1}", j) for i, c in enumerate(product(C.JUDGMENTS, repeat=5)) for d, j in enumerate(c)]
    df = spark.createDataFrame(rows, "trial_id string, outcome string, effect string, domain string, judgment string")
    got = {int(r.outcome): (r.overall_judgment, r.policy_review) for r in D.rollup(df).collect()}
    for i, combo in enumerate(product(C.JUDGMENTS, repeat=5)):
        high, some = combo.count("High"), combo.count("Some concerns")
        want = "High" if high or some >= 3 else ("Some concerns" if some else "Low")
        assert got[i] == (want, not high and some >= 2)
