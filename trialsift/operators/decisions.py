"""Question routing, domain judgments, rollup and review flags.

Answers arrive long (one row per question) and are pivoted once to a wide row
per (trial, outcome, effect).  Everything after that pivot - gates, judgment
tables, dispatch - is plain column arithmetic inside one projection, so a batch
of any size costs a single shuffle.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C

PAIR_KEY = ["trial_id", "outcome", "effect"]

# A code class as written in the rule tables below.
CODE_CLASSES = {
    "Y": ("Y", "PY"),
    "N": ("N", "PN"),
    "Y?": ("Y", "PY", "NI"),
    "N?": ("N", "PN", "NI"),
    "?": ("NI",),
    "any": ("Y", "PY", "PN", "N", "NI"),
    "NA": ("NA",),
    "Y-": ("Y", "PY", "NA"),
    "N-": ("N", "PN", "NA"),
}


def col_of(sq_id: str) -> str:
    """Wide column of a question: 2.3 -> q23."""
    return "q" + sq_id.replace(".", "")


def is_in(sq_id: str, code_class: str) -> str:
    """SQL test of one routed answer; rule tables are built as SQL text and parsed once."""
    return f"{col_of(sq_id)} IN (" + ", ".join(f"'{code}'" for code in CODE_CLASSES[code_class]) + ")"


def _known(sq_ids) -> str:
    return " AND ".join(f"{col_of(sq)} IS NOT NULL" for sq in sq_ids)


# --------------------------------------------------------------------------
# routing

#: Answer codes in text order; a pivot compares their positions, which fit one byte, in place of their texts.
CODES = tuple(sorted({*C.RAW_CODES, "NA"}))


def code_position(value: Column) -> Column:
    found = None
    for i, code in enumerate(CODES, 1):
        hit = F.when(value == code, F.lit(i)) if found is None else found.when(value == code, F.lit(i))
        found = hit
    return found.cast("tinyint")


def _code_at(position: Column) -> Column:
    return F.get(F.array(*map(F.lit, CODES)), position.cast("int") - 1)  # null for null, unlike element_at's type says


def pivot_answers(raw: DataFrame, key: list[str], sq_ids=C.ALL_SQS, value: str = "answer", nested: str | None = None) -> DataFrame:
    """Long answers to one wide row per key; partial aggregation runs map-side, in hash tables of small numbers.

    Rows that hold a key's answers already, as a map by question in the column `nested`, are read off
    in place and keep that column.
    """
    if nested:
        at = lambda sq: code_position(F.col(nested)[sq][value])
        return raw.select(*key, nested, *[_code_at(at(sq)).alias(col_of(sq)) for sq in sq_ids])
    coded = raw.select(*key, "sq_id", code_position(F.col(value)).alias("_code"))
    wide = coded.groupBy(*key).agg(*[F.max(F.when(F.col("sq_id") == sq, F.col("_code"))).alias(col_of(sq)) for sq in sq_ids])
    return wide.select(*key, *[_code_at(F.col(col_of(sq))).alias(col_of(sq)) for sq in sq_ids])


def _then(gate: str, test: str) -> str:
    """`test` where the gate holds, else the gate itself (false or still open)."""
    return f"IF({gate}, {test}, {gate})"


def gates() -> dict[str, str]:
    """Gate per conditional question, over the supplied answers only.

    Three-valued: true asks the question, false makes it NA, null means its
    operands are still open.  Gates are acyclic, so each is written straight
    over the supplied columns and no iteration is needed.
    """
    g23 = f"({is_in('2.1', 'Y?')} OR {is_in('2.2', 'Y?')})"
    g24 = _then(g23, is_in("2.3", "Y"))
    g25 = _then(g24, is_in("2.4", "Y?"))
    g26 = f"({_then(g23, is_in('2.3', 'N?'))} OR {is_in('2.4', 'Y?')} OR {is_in('2.5', 'Y?')})"
    g32 = f"({is_in('3.1', 'N?')})"
    g33 = _then(g32, is_in("3.2", "N"))
    g43 = f"IF({_known(('4.1', '4.2'))}, {is_in('4.1', 'N?')} AND {is_in('4.2', 'N?')}, NULL)"
    g44 = _then(g43, is_in("4.3", "Y?"))
    g52 = f"({is_in('5.1', 'N?')})"

    def by_effect(assignment: str, adhering: str) -> str:
        return f"IF(effect = 'assignment', {assignment}, {adhering})"

    return {
        "2.3": g23,
        "2.4": by_effect(g24, "true"),
        "2.5": by_effect(g25, "true"),
        "2.6": by_effect("true", g26),
        "2.7": by_effect(is_in("2.6", "N?"), "false"),
        "3.2": g32,
        "3.3": g33,
        "3.4": _then(g33, is_in("3.3", "Y?")),
        "4.3": g43,
        "4.4": g44,
        "4.5": _then(g44, is_in("4.4", "Y?")),
        "5.2": g52,
        "5.3": g52,
    }


def _gate_col(sq: str) -> str:
    return "g" + col_of(sq)[1:]


def route(wide: DataFrame) -> DataFrame:
    """Overwrite structurally not-applicable answers with NA (needs column `effect`)."""
    gate = gates()
    question = {col_of(sq): sq for sq in gate}
    with_gates = wide.selectExpr("*", *[f"{g} AS {_gate_col(sq)}" for sq, g in gate.items()])
    return with_gates.selectExpr(
        *[
            f"CASE WHEN {_gate_col(question[c])} THEN {c} WHEN NOT {_gate_col(question[c])} THEN 'NA' END AS {c}"
            if c in question
            else f"`{c}`"
            for c in wide.columns
        ]
    )


def wave_frontier(wide_partial: DataFrame) -> DataFrame:
    """Questions askable now and questions already known not to apply, per pair."""
    gate = {sq: gates().get(sq, "true") for sq in C.ALL_SQS}
    with_gates = wide_partial.selectExpr("*", *[f"{g} AS {_gate_col(sq)}" for sq, g in gate.items()])

    def listed(test) -> str:
        return "concat_ws(',', " + ", ".join(f"IF({test(sq)}, '{sq}', NULL)" for sq in C.ALL_SQS) + ")"

    return with_gates.selectExpr(
        *PAIR_KEY,
        listed(lambda sq: f"{_gate_col(sq)} AND {col_of(sq)} IS NULL") + " AS ask_now",
        listed(lambda sq: f"NOT {_gate_col(sq)}") + " AS not_applicable",
    )


def to_long(wide: DataFrame, key: list[str], sq_ids=C.ALL_SQS) -> DataFrame:
    """Unpivot routed answers to (domain, sq_id, answer) rows."""
    rows = ", ".join(f"struct('D{sq[0]}' AS domain, '{sq}' AS sq_id, {col_of(sq)} AS answer)" for sq in sq_ids)
    return wide.selectExpr(*key, f"inline(array({rows}))")


def na_answers(routed: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Rows recorded for questions that structurally do not apply."""
    return (
        to_long(routed, key)
        .where(F.col("answer") == "NA")
        .withColumn("justification", F.lit(C.NA_JUSTIFICATION))
    )


# --------------------------------------------------------------------------
# judgment tables: first matching row wins, "sq=class" terms are and-ed

LOW, SOME, HIGH = C.JUDGMENTS

RULES = {
    "D1": [
        ("1.2=Y 1.1=Y? 1.3=N?", LOW, "1.2=Y/PY, 1.1=Y/PY/NI, 1.3=N/PN/NI"),
        ("1.2=Y 1.1=N 1.3=any", SOME, "1.2=Y/PY, 1.1=N/PN"),
        ("1.2=Y 1.1=Y? 1.3=Y", SOME, "1.2=Y/PY, 1.3=Y/PY"),
        ("1.2=? 1.1=any 1.3=N?", SOME, "1.2=NI, 1.3=N/PN/NI"),
        ("1.2=? 1.1=any 1.3=Y", HIGH, "1.2=NI, 1.3=Y/PY"),
        ("1.2=N", HIGH, "1.2=N/PN"),
    ],
    "D2 deviation": [
        ("2.1=N 2.2=N", LOW, ""),
        ("2.3=N", LOW, ""),
        ("2.3=?", SOME, ""),
        ("2.3=Y 2.4=N", SOME, ""),
        ("2.3=Y 2.4=Y? 2.5=Y", SOME, ""),
        ("2.3=Y 2.4=Y? 2.5=N?", HIGH, ""),
    ],
    "D2 analysis": [
        ("2.6=Y", LOW, ""),
        ("2.6=N? 2.7=N", SOME, ""),
        ("2.6=N? 2.7=Y?", HIGH, ""),
    ],
    "D2 adhering": [
        ("2.1=N 2.2=N 2.4=N- 2.5=N-", LOW, "adhering: 2.1=N/PN, 2.2=N/PN, 2.4/2.5=N/PN/NA"),
        ("2.3=Y- 2.4=N- 2.5=N-", LOW, "adhering: 2.3=Y/PY/NA, 2.4/2.5=N/PN/NA"),
        ("2.3=Y- 2.6=Y", SOME, "adhering: 2.4/2.5=Y/PY/NI, 2.6=Y/PY"),
        ("2.3=Y- 2.6=N?", HIGH, "adhering: 2.4/2.5=Y/PY/NI, 2.6=N/PN/NI"),
        ("2.3=N? 2.6=Y", SOME, "adhering: 2.3=N/PN/NI, 2.6=Y/PY"),
        ("2.3=N? 2.6=N?", HIGH, "adhering: 2.3=N/PN/NI, 2.6=N/PN/NI"),
    ],
    "D3": [
        ("3.1=Y", LOW, "3.1=Y/PY"),
        ("3.2=Y", LOW, "3.1=N/PN/NI, 3.2=Y/PY"),
        ("3.2=N? 3.3=N", LOW, "3.2=N/PN/NI, 3.3=N/PN"),
        ("3.2=N? 3.3=Y? 3.4=N", SOME, "3.3=Y/PY/NI, 3.4=N/PN"),
        ("3.2=N? 3.3=Y? 3.4=Y?", HIGH, "3.3=Y/PY/NI, 3.4=Y/PY/NI"),
    ],
    "D4": [
        ("4.1=Y", HIGH, "4.1=Y/PY or 4.2=Y/PY"),
        ("4.2=Y", HIGH, "4.1=Y/PY or 4.2=Y/PY"),
        ("4.2=N 4.3=N", LOW, "4.1=N/PN/NI, 4.2=N/PN, 4.3=N/PN"),
        ("4.2=N 4.4=N", LOW, "4.3=Y/PY/NI, 4.4=N/PN"),
        ("4.2=N 4.5=N", SOME, "4.4=Y/PY/NI, 4.5=N/PN"),
        ("4.2=N 4.5=Y?", HIGH, "4.4=Y/PY/NI, 4.5=Y/PY/NI"),
        ("4.2=? 4.3=N", SOME, "4.2=NI, 4.3=N/PN"),
        ("4.2=? 4.4=N", SOME, "4.2=NI, 4.4=N/PN"),
        ("4.2=? 4.5=N", SOME, "4.2=NI, 4.5=N/PN"),
        ("4.2=? 4.5=Y?", HIGH, "4.2=NI, 4.5=Y/PY/NI"),
    ],
    "D5": [
        ("5.1=Y 5.2=NA 5.3=NA", LOW, "5.1=Y/PY; 5.2/5.3 structurally NA"),
        ("5.1=Y 5.2=N 5.3=N", LOW, "5.2=N/PN, 5.3=N/PN, 5.1=Y/PY"),
        ("5.1=N? 5.2=N 5.3=N", SOME, "5.2=N/PN, 5.3=N/PN, 5.1=N/PN/NI"),
        ("5.2=Y", HIGH, "5.2=Y/PY or 5.3=Y/PY"),
        ("5.3=Y", HIGH, "5.2=Y/PY or 5.3=Y/PY"),
        ("5.1=any 5.2=any 5.3=any", SOME, "5.1/5.2/5.3 completed without Low or High pattern"),
    ],
}


def _rule_cases(name: str, value) -> str:
    cases = []
    for pattern, judgment, why in RULES[name]:
        test = " AND ".join(is_in(*term.split("=")) for term in pattern.split())
        cases.append(f"WHEN {test} THEN {value(judgment, why)}")
    return "CASE " + " ".join(cases) + " END"


def _verdict(judgment: str, rationale: str) -> str:
    return f"named_struct('judgment', {judgment}, 'rationale', {rationale})"


def _table_verdict(name: str) -> str:
    return _rule_cases(name, lambda judgment, why: _verdict(f"'{judgment}'", f"'{why} -> {judgment}'"))


def _assignment_verdict() -> str:
    deviation = _rule_cases("D2 deviation", lambda judgment, _: f"'{judgment}'")
    analysis = _rule_cases("D2 analysis", lambda judgment, _: f"'{judgment}'")
    both = f"array({deviation}, {analysis})"
    judgment = (
        f"CASE WHEN p[0] IS NULL OR p[1] IS NULL THEN NULL WHEN p[0] = '{LOW}' AND p[1] = '{LOW}' THEN '{LOW}' "
        f"WHEN array_contains(p, '{HIGH}') THEN '{HIGH}' ELSE '{SOME}' END"
    )
    why = f"concat('assignment: deviation component=', p[0], ', analysis component=', p[1], ' -> ', {judgment})"
    # bind both components once, then combine
    combined = f"transform(array({both}), p -> {_verdict(judgment, why)})[0]"
    return f"IF({combined}.judgment IS NOT NULL, {combined}, NULL)"


def verdict_sql(domain: str, effect: str | None = None) -> str:
    if domain not in C.DOMAINS:
        raise ValueError(f"unknown domain {domain!r}")
    if domain != "D2":
        verdict = _table_verdict(domain)
    elif effect == "assignment":
        verdict = _assignment_verdict()
    elif effect == "adhering":
        verdict = _table_verdict("D2 adhering")
    else:
        verdict = (
            f"CASE effect WHEN 'assignment' THEN {_assignment_verdict()} "
            f"WHEN 'adhering' THEN {_table_verdict('D2 adhering')} END"
        )
    return f"IF({_known(C.DOMAIN_SQS[domain])}, {verdict}, NULL)"


def domain_verdict(domain: str, effect: str | None = None) -> Column:
    """struct(judgment, rationale); null when the answers reach no table row."""
    return F.expr(verdict_sql(domain, effect))


def domain_judgment(domain: str) -> Column:
    """The judgment alone, named d1..d5."""
    return F.expr(f"({verdict_sql(domain)}).judgment").alias(domain.lower())


def judge(routed: DataFrame, key: list[str] = PAIR_KEY, domains=C.DOMAINS) -> DataFrame:
    """Long domain judgments: key, domain, scope, judgment, rationale, error."""
    entries = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                F.lit("trial" if d == "D1" else "outcome").alias("scope"),
                domain_verdict(d).alias("v"),
            )
            for d in domains
        ]
    )
    return (
        routed.select(*key, F.explode(entries).alias("e"))
        .select(
            *key,
            "e.domain",
            "e.scope",
            F.col("e.v.judgment").alias("judgment"),
            F.col("e.v.rationale").alias("rationale"),
        )
        .withColumn(
            "error",
            F.when(
                F.col("judgment").isNull(),
                F.concat(F.col("domain"), F.lit(" answers do not reach a judgment")),
            ),
        )
    )


# --------------------------------------------------------------------------
# rollup and review

def _overall(high: Column, some: Column, n: Column) -> dict[str, Column]:
    limit = C.OVERALL_HIGH_SC_THRESHOLD
    complete = n == 5
    return {
        "overall_judgment": F.when(
            complete,
            F.when(high > 0, HIGH).when(some == 0, LOW).when(some >= limit, HIGH).otherwise(SOME),
        ),
        "overall_rationale": F.when(
            complete,
            F.when(high > 0, ">=1 domain High -> High")
            .when(some == 0, "all domains Low -> Low")
            .when(some >= limit, F.format_string(f"%d domains Some concerns >= threshold {limit} -> High", some))
            .otherwise(F.format_string(f"%d domains Some concerns < threshold {limit} -> Some concerns", some)),
        ),
        "policy_review": F.when(complete, (high == 0) & (some >= 2)),
    }


def rollup(judgments: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Overall judgment per key from exactly five non-null domain judgments."""
    counted = judgments.groupBy(*key).agg(
        F.count_if(F.col("judgment") == HIGH).alias("n_high"),
        F.count_if(F.col("judgment") == SOME).alias("n_some"),
        F.count("judgment").alias("n_judged"),
    )
    parts = _overall(F.col("n_high"), F.col("n_some"), F.col("n_judged"))
    return counted.select(*key, "n_high", "n_some", "n_judged", *[c.alias(n) for n, c in parts.items()])


def wide_judgments(judgments: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """d1..d5 judgment columns plus the overall columns, one aggregation."""
    pivoted = judgments.groupBy(*key).agg(
        *[F.max(F.when(F.col("domain") == d, F.col("judgment"))).alias(d.lower()) for d in C.DOMAINS]
    )
    return with_overall(pivoted)


def with_overall(pivoted: DataFrame) -> DataFrame:
    def tally(test: str) -> Column:
        return F.expr(" + ".join(f"IF({d.lower()} {test}, 1, 0)" for d in C.DOMAINS))

    counted = pivoted.withColumns(
        {"n_high": tally(f"= '{HIGH}'"), "n_some": tally(f"= '{SOME}'"), "n_judged": tally("IS NOT NULL")}
    )
    parts = _overall(F.col("n_high"), F.col("n_some"), F.col("n_judged"))
    return counted.select(*pivoted.columns, *[c.alias(n) for n, c in parts.items()])


def _packed(final_answer: Column, flagged: Column, verified: Column) -> Column:
    flag = F.when(flagged == "FLAGGED", F.lit(2)).when(flagged == "UNCERTAIN", F.lit(1)).otherwise(F.lit(0))
    doubt = F.when(verified, F.lit(0)).when(verified.isNull(), F.lit(0)).otherwise(F.lit(1))
    return (code_position(final_answer).cast("short") * 8 + flag * 2 + doubt).cast("short")


def pivot_evidence(finished: DataFrame, key: list[str] = PAIR_KEY, sq_ids=C.ALL_SQS, nested: str | None = None) -> DataFrame:
    """Final answers to one row per key: code columns and, beside each, what makes its answer unreliable.

    Code, flag and verification share one small number per question, so the
    aggregation stays in hash tables.  `nested` as in `pivot_answers`.
    """
    if nested:
        of = lambda sq: [F.col(nested)[sq][c] for c in ("final_answer", "flag", "quote_verified")]
        kept, wide = [*key, nested], finished.select(*key, nested, *[_packed(*of(sq)).alias(f"_{col_of(sq)}") for sq in sq_ids])
    else:
        packed = _packed(F.col("final_answer"), F.col("flag"), F.col("quote_verified"))
        coded = finished.select(*key, "sq_id", packed.alias("_packed"))
        kept = key
        wide = coded.groupBy(*key).agg(*[F.max(F.when(F.col("sq_id") == sq, F.col("_packed"))).alias(f"_{col_of(sq)}") for sq in sq_ids])
    out = []
    for sq in sq_ids:
        p = F.col(f"_{col_of(sq)}").cast("int")
        out += [_code_at(F.floor(p / 8)).alias(col_of(sq)), (p % 8).alias(f"_{col_of(sq)}")]
    return wide.select(*kept, *out)


def reviewed(finished: DataFrame, key: list[str] = PAIR_KEY, nested: str | None = None) -> DataFrame:
    """Overall judgment, review flag and its basis: policy text first, then the answers that were asked but are weak."""
    routed = route(pivot_evidence(finished, key, nested=nested))
    kept = [*key, nested] if nested else key

    def listed(test, title: str) -> Column:
        items = [F.when((F.col(col_of(sq)) != "NA") & test(F.col(f"_{col_of(sq)}")), F.lit(f"D{sq[0]} {sq}")) for sq in sorted(C.ALL_SQS)]
        text = F.array_join(F.array_compact(F.array(*items)), ", ")
        return F.when(F.length(text) > 0, F.concat(F.lit(title), text))

    basis = F.nullif(
        F.concat_ws(
            "; ",
            listed(lambda x: F.floor(x / 2) == 2, "flagged SQ answer(s): "),
            listed(lambda x: F.floor(x / 2) == 1, "uncertain SQ answer(s): "),
            listed(lambda x: x % 2 == 1, "unverified quote(s): "),
        ),
        F.lit(""),
    )
    overall = with_overall(routed.select(*kept, basis.alias("reliability_basis"), *[domain_judgment(d) for d in C.DOMAINS]))
    policy = F.when(F.col("policy_review"), F.col("overall_rationale"))
    flag = F.coalesce(F.col("policy_review"), F.lit(False)) | F.col("reliability_basis").isNotNull()
    return overall.select(
        *kept,
        "overall_judgment",
        "overall_rationale",
        flag.alias("requires_human_review"),
        F.when(flag, F.concat_ws("; ", policy, F.col("reliability_basis"))).alias("review_basis"),
    )


def share_trial_domain(outcome_level: DataFrame, trial_level: DataFrame, salts: int = 16) -> DataFrame:
    """Attach the trial-grain D1 columns to every outcome of the trial.

    A trial may own a large part of all outcomes, so the join goes through the
    hot-key aware join.
    """
    from trialsift.operators.skew import hot_key_join

    return hot_key_join(outcome_level, trial_level, ["trial_id", "effect"], salts=salts)


def missing_answers(raw: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """One error row per (key, domain) that lacks expected answers at fan-in."""
    seen = raw.groupBy(*key).agg(F.collect_set("sq_id").alias("seen"))
    entries = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                F.array_except(F.array(*[F.lit(s) for s in C.DOMAIN_SQS[d]]), F.col("seen")).alias("missing"),
            )
            for d in C.DOMAINS
        ]
    )
    return (
        seen.select(*key, F.explode(entries).alias("e"))
        .where(F.size("e.missing") > 0)
        .select(
            *key,
            "e.domain",
            F.concat(F.col("e.domain"), F.lit(" missing expected SQ answer(s): "), F.array_join("e.missing", ", ")).alias(
                "error"
            ),
        )
    )


def answer_conflicts(raw: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Duplicate (key, question) rows that disagree; equal duplicates merge silently."""
    return (
        raw.groupBy(*key, "sq_id")
        .agg(
            F.min("answer").alias("first_answer"),
            F.max("answer").alias("last_answer"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .where(F.col("first_answer") != F.col("last_answer"))
    )


def judgment_audit(routed: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    """Audit event per domain judgment with its input answers as JSON."""
    inputs = {
        d: F.to_json(F.struct(*[F.col(col_of(s)).alias(s) for s in C.DOMAIN_SQS[d]]))
        for d in C.DOMAINS
    }
    entries = F.array(
        *[
            F.struct(F.lit(d).alias("domain"), inputs[d].alias("input_sq_answers"), domain_verdict(d).alias("v"))
            for d in C.DOMAINS
        ]
    )
    return routed.select(*key, F.explode(entries).alias("e")).select(
        *key,
        F.lit("judgment.domain.completed").alias("event_type"),
        F.when(F.col("e.v").isNull(), "failed").otherwise("completed").alias("status"),
        "e.domain",
        "e.input_sq_answers",
        F.col("e.v.judgment").alias("output_judgment"),
        F.col("e.v.rationale").alias("algorithm_rationale"),
    )


def overall_audit(reviewed: DataFrame, key: list[str] = PAIR_KEY) -> DataFrame:
    return reviewed.select(
        *key,
        F.lit("judgment.overall.completed").alias("event_type"),
        F.col("overall_judgment").alias("output_judgment"),
        F.col("overall_rationale").alias("algorithm_rationale"),
        "requires_human_review",
        "review_basis",
    )
