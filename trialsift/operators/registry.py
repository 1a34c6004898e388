"""Registry records, eligibility, trial metadata and outcome matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T
from trialsift.functions.similarity import best_match
from trialsift.functions.unicode import ascii_fold
from trialsift.operators.skew import hot_key_join

RECORD = (
    "protocolSection struct<studyType string, "
    "designModule struct<studyType string, designInfo struct<allocation string, interventionModel string, "
    "maskingInfo struct<masking string>>, enrollmentInfo struct<count variant>>, "
    "outcomesModule struct<primaryOutcomes array<struct<measure string, timeFrame string>>, "
    "secondaryOutcomes array<struct<measure string, timeFrame string>>>, "
    "armsInterventionsModule struct<armGroups array<struct<label string>>>>"
)


def parse_records(registry: DataFrame) -> DataFrame:
    """(nct, rec): only well-formed ids and JSON objects survive as records, others are null."""
    ok = F.try_parse_json("body").isNotNull() & F.ltrim("body").startswith("{")
    return registry.select(
        T.strict_nct(F.col("nct")).alias("nct"), F.when(ok, F.from_json("body", RECORD)).alias("rec")
    )


def _norm(value: Column) -> Column:
    return F.regexp_replace(
        F.trim(F.upper(F.replace(F.coalesce(value, F.lit("")), F.lit("-"), F.lit(" ")))), r"\s+", "_"
    )


def registry_design(rec: str = "rec") -> Column:
    """struct(design, basis, in_scope) from registry fields, null where they decide nothing."""
    p = f"{rec}.protocolSection"
    kind = _norm(F.coalesce(F.nullif(F.col(f"{p}.designModule.studyType"), F.lit("")), F.col(f"{p}.studyType")))
    allocation = _norm(F.col(f"{p}.designModule.designInfo.allocation"))
    model = _norm(F.col(f"{p}.designModule.designInfo.interventionModel"))

    def found(design: str, basis: str, in_scope: bool) -> Column:
        return F.struct(F.lit(design).alias("design"), F.lit(basis).alias("basis"), F.lit(in_scope).alias("in_scope"))

    return (
        F.when(kind.contains("OBSERVATIONAL"), found("non_rct", "ClinicalTrials.gov studyType is OBSERVATIONAL.", False))
        .when(
            model.contains("SINGLE_GROUP"),
            found("single_arm", "ClinicalTrials.gov interventionModel is SINGLE_GROUP.", False),
        )
        .when(
            model.contains("CROSSOVER"),
            found("crossover_rct", "ClinicalTrials.gov interventionModel is CROSSOVER.", False),
        )
        .when(
            kind.contains("INTERVENTIONAL") & allocation.contains("RANDOM") & model.contains("PARALLEL"),
            found(
                "parallel_rct",
                "ClinicalTrials.gov reports studyType=INTERVENTIONAL, allocation=RANDOMIZED, interventionModel=PARALLEL.",
                True,
            ),
        )
    )


def decide_eligibility(trials: DataFrame) -> DataFrame:
    """Eligibility over trials (study_design, study_design_basis, rec).

    Registry evidence wins over metadata; an unclear design goes on with a
    review flag.
    """
    reg = registry_design()
    design, basis = F.col("study_design"), F.nullif(F.col("study_design_basis"), F.lit(""))
    out_designs = ("cluster_rct", "crossover_rct", "single_arm", "non_rct")
    decided = trials.withColumn("_reg", reg)
    known = F.col("_reg").isNotNull()
    return decided.withColumns(
        {
            "eligible": F.when(known, F.col("_reg.in_scope")).otherwise(~design.isin(*out_designs)),
            "basis": F.when(known, F.col("_reg.basis"))
            .when(
                design == "parallel_rct",
                F.coalesce(basis, F.lit("LLM metadata classified the study as a parallel-group RCT.")),
            )
            .when(
                design.isin(*out_designs),
                F.coalesce(basis, F.lit("positive metadata evidence indicates an out-of-scope design.")),
            )
            .otherwise("eligibility ambiguous; proceeding with human-review flag instead of skipping on uncertainty"),
            "decided_design": F.coalesce("_reg.design", design),
            "needs_review": ~known & ~design.isin("parallel_rct", *out_designs),
        }
    ).drop("_reg")


def reconcile(decided: DataFrame) -> DataFrame:
    """Overwrite uncertain metadata with the decision's design and basis."""
    return decided.withColumns({"study_design": F.col("decided_design"), "study_design_basis": F.col("basis")})


def _measures(name: str, primary: bool, rec: str) -> Column:
    items = F.col(f"{rec}.protocolSection.outcomesModule.{name}")
    return F.transform(
        F.filter(F.coalesce(items, F.array()), lambda o: F.trim(o["measure"]) != ""),
        lambda o: F.struct(F.trim(o["measure"]).alias("measure"), F.lit(primary).alias("is_primary")),
    )


def registered_measures(rec: str = "rec") -> Column:
    """Primary then secondary outcomes with their flag, blanks dropped."""
    return F.concat(_measures("primaryOutcomes", True, rec), _measures("secondaryOutcomes", False, rec))


def registered_outcomes(records: DataFrame) -> DataFrame:
    return records.where("rec IS NOT NULL").select("nct", F.posexplode(registered_measures()).alias("ordinal", "o")).select(
        "nct", "ordinal", "o.measure", "o.is_primary"
    )


def enrollment_count(rec: str = "rec") -> Column:
    """Registered count when it is a JSON integer."""
    count = F.col(f"{rec}.protocolSection.designModule.enrollmentInfo.count")
    return F.when(F.schema_of_variant(count) == "BIGINT", F.try_variant_get(count, "$", "bigint"))


def match_outcomes(assessed: DataFrame, records: DataFrame, threshold: float = C.OUTCOME_MATCH_THRESHOLD) -> DataFrame:
    """Best registered outcome per assessed outcome (nct, outcome, ...).

    Equi-join on the registry id first; the Arrow UDF then looks at the few
    measures of one record.  The first of equal scores wins.
    """
    listed = records.where("rec IS NOT NULL").select("nct", registered_measures().alias("measures"))
    joined = hot_key_join(assessed, listed, ["nct"])
    best = best_match(F.col("outcome"), F.transform("measures", lambda m: m["measure"]))
    scored = joined.withColumn("_b", best)
    chosen = F.get("measures", F.col("_b.at"))
    has = F.col("_b.at").isNotNull()
    rounded = F.round("_b.score", 3)
    return scored.select(
        *assessed.columns,
        F.when(has, chosen["measure"]).alias("registered_outcome"),
        F.when(has, F.col("outcome")).alias("published_outcome"),
        rounded.alias("outcome_similarity_score"),
        (rounded < threshold).alias("outcome_change_detected"),
        F.when(has, chosen["is_primary"]).alias("registered_as_primary"),
    )


# ---- metadata rows

def choose_nct(config: Column, hint: Column, extracted: Column) -> Column:
    return F.coalesce(T.extract_nct(config), T.extract_nct(hint), T.extract_nct(extracted))


def normalize_outcomes(primary: Column, others: Column, cap: int = C.MAX_OUTCOMES) -> Column:
    """Primary first, blanks collapsed, case-insensitive first-wins dedupe, capped."""
    cleaned = F.filter(F.transform(F.concat(F.array(primary), others), T.squeeze), lambda x: x != "")
    lowered = F.transform(cleaned, F.lower)
    first = F.filter(cleaned, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, max(1, cap))


def trial_ids(df: DataFrame, nct: str, label: str, content: str, out: str = "trial_id") -> DataFrame:
    """NCT, else dash slug of the label, else 12 hex digits of the content."""
    folded = df.withColumn("_folded", F.when(F.col(nct).isNull(), ascii_fold(F.col(label))))
    return folded.withColumn(
        out, F.coalesce(F.col(nct), F.nullif(T.slug_dash_folded(F.col("_folded")), F.lit("")), T.hex_digest(F.col(content), 12))
    ).drop("_folded")


def assessed_outcomes(manifest: Column, metadata: Column, primary: Column) -> Column:
    def non_empty(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    return F.explode(F.coalesce(non_empty(manifest), non_empty(metadata), F.array(primary)))


# ---- text blocks

def registry_block(rec: str = "rec") -> Column:
    p = f"{rec}.protocolSection"
    value = lambda path: F.nullif(F.col(f"{p}.{path}"), F.lit(""))

    def outcome_lines(name: str, label: str) -> Column:
        items = F.filter(
            F.coalesce(F.col(f"{p}.outcomesModule.{name}"), F.array()), lambda o: F.coalesce(o["measure"], F.lit("")) != ""
        )
        return F.nullif(
            F.array_join(
                F.transform(
                    items,
                    lambda o: F.concat(
                        F.lit(f"{label}: "),
                        o["measure"],
                        F.when(F.coalesce(o["timeFrame"], F.lit("")) != "", F.concat(F.lit(" ("), o["timeFrame"], F.lit(")"))).otherwise(""),
                    ),
                ),
                "\n",
            ),
            F.lit(""),
        )

    arms = F.array_join(
        F.filter(
            F.transform(F.coalesce(F.col(f"{p}.armsInterventionsModule.armGroups"), F.array()), lambda a: a["label"]),
            lambda x: F.coalesce(x, F.lit("")) != "",
        ),
        "; ",
    )
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Allocation: "), value("designModule.designInfo.allocation")),
        F.concat(F.lit("Masking: "), value("designModule.designInfo.maskingInfo.masking")),
        F.concat(F.lit("Enrollment count: "), enrollment_count(rec).cast("string")),
        outcome_lines("primaryOutcomes", "Primary outcomes"),
        outcome_lines("secondaryOutcomes", "Secondary outcomes"),
        F.when(arms != "", F.concat(F.lit("Arms: "), arms)),
    )
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("[ClinicalTrials.gov]\n"), body)).otherwise("")


METADATA_LINES = (
    "trial_id", "title", "intervention", "comparator", "primary_outcome", "effect_of_interest", "blinding", "nct_number",
)


def metadata_block(columns) -> Column:
    present = [c for c in METADATA_LINES if c in columns]
    lines = [F.concat(F.lit(f"{c}: "), F.nullif(F.col(c), F.lit(""))) for c in present]
    if "all_outcomes" in columns:
        lines.append(F.when(F.size("all_outcomes") > 0, F.concat(F.lit("all_outcomes: "), F.array_join("all_outcomes", "; "))))
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit("[Trial metadata]\n"), body)).otherwise("")


def comparison_block() -> Column:
    """Outcome-comparison text; empty when nothing was compared."""
    shown = lambda c: F.when(F.col(c).isNull(), "None").when(F.col(c), "True").otherwise("False")
    return F.when(
        F.col("outcome_change_detected").isNotNull(),
        F.concat_ws(
            "\n",
            F.lit("[Registered outcome comparison]"),
            F.concat(F.lit("Published outcome: "), F.coalesce("published_outcome", F.lit(""))),
            F.concat(F.lit("Best registered outcome: "), F.coalesce("registered_outcome", F.lit(""))),
            F.concat(F.lit("Similarity score: "), F.col("outcome_similarity_score").cast("string")),
            F.concat(F.lit("Outcome change detected: "), shown("outcome_change_detected")),
            F.concat(F.lit("Registered as primary: "), shown("registered_as_primary")),
        ),
    ).otherwise("")
