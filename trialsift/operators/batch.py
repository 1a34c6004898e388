"""Manifest expansion, resume, upsert and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C

KEY = list(C.RESULT_KEY)
ENTRY = ["trial_id", "model_sq", "pipeline_version"]


def clean(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def outcome_list(value: Column) -> Column:
    """`;` list, inner whitespace collapsed, blanks dropped; nothing left gives null."""
    parts = F.filter(F.transform(F.split(value, ";"), squeeze), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def supplement_list(value: Column, base_dir: Column | str) -> Column:
    base = F.lit(base_dir) if isinstance(base_dir, str) else base_dir
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda p: resolve_path(p, base))


def resolve_path(path: Column, base: Column) -> Column:
    trimmed = F.trim(path)
    return F.when(trimmed.startswith("/"), trimmed).otherwise(F.concat(base, F.lit("/"), trimmed))


def overlay_defaults(entries: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Run defaults where a manifest entry leaves a setting empty."""
    return entries.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in entries.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )


def requested_pairs(entries: DataFrame) -> DataFrame:
    return entries.withColumn("outcome", F.explode("outcomes")).drop("outcomes")


def completed_keys(results: DataFrame) -> DataFrame:
    return results.select(*KEY).distinct()


def missing_pairs(requested: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Pairs still to assess; semi and anti joins keep the requested rows whole."""
    return requested if force else requested.join(results.select(*KEY), KEY, "left_anti")


def completed_pairs(requested: DataFrame, results: DataFrame) -> DataFrame:
    return requested.join(results.select(*KEY), KEY, "left_semi")


def entry_status(entries: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Decide per entry, before any expensive stage, whether it can be skipped.

    An entry is skipped when a skip record exists or when every listed outcome
    is done.  Entries without an outcome list are never complete here.
    """
    skips = results.where((F.col("outcome") == C.SKIP_OUTCOME) & (F.col("effect_of_interest") == C.SKIP_EFFECT))
    skips = skips.select(*ENTRY).distinct().withColumn("_skip", F.lit(True))
    done = completed_keys(results.where(F.col("outcome") != C.SKIP_OUTCOME)).withColumn("_done", F.lit(True))
    asked = entries.withColumn("outcome", F.explode_outer("outcomes"))
    per_entry = (
        asked.join(done, KEY, "left")
        .groupBy("entry_id", *ENTRY)
        .agg(
            F.count("outcome").alias("n_requested"),
            F.count_if(F.col("_done")).alias("n_done"),
        )
    )
    reason = F.when(F.lit(force), None).otherwise(
        F.when(F.col("_skip"), "existing_skip_record").when(
            (F.col("n_requested") > 0) & (F.col("n_done") == F.col("n_requested")), "all_requested_pairs_completed"
        )
    )
    return (
        per_entry.join(skips, ENTRY, "left")
        .withColumn("skip_reason", reason)
        .select("entry_id", "trial_id", "n_requested", "n_done", "skip_reason")
    )


def progress_line(index: Column, label: Column, skipped: Column, assessed: Column, skipped_pairs: Column) -> Column:
    head = F.concat(F.lit("["), index, F.lit("] "), label)
    return (
        F.when(skipped, F.concat(head, F.lit(": skipped")))
        .when((assessed == 0) & (skipped_pairs == 0), F.concat(head, F.lit(": ineligible")))
        .otherwise(F.concat(head, F.lit(": assessed "), assessed, F.lit(" pair(s), skipped "), skipped_pairs))
    )


def latest_wins(existing: DataFrame, new: DataFrame, key: list[str] = KEY, order=("batch_seq", "assessment_id")) -> DataFrame:
    """Upsert: per key the row of the newest batch, all other columns overwritten.

    `max_by` combines map-side, so many versions of one key never meet in one
    task as rows.
    """
    both = existing.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, "_row.*")


def skip_rows(ineligible: DataFrame) -> DataFrame:
    """Audit rows for trials outside scope: sentinel key, null judgments."""
    nulls = ["title", "overall_judgment", *[f"d{i}_judgment" for i in range(1, 6)]]
    return ineligible.select(
        "assessment_id",
        "created_at",
        "trial_id",
        "nct_number",
        F.lit(C.SKIP_OUTCOME).alias("outcome"),
        F.lit(C.SKIP_EFFECT).alias("effect_of_interest"),
        *[F.lit(None).cast("string").alias(c) for c in nulls],
        F.lit(None).cast("int").alias("flagged_sq_count"),
        F.lit(None).cast("int").alias("uncertain_sq_count"),
        F.lit(1).alias("requires_human_review"),
        "study_design",
        "model_sq",
        "model_aux",
        "pipeline_version",
        "inputs_hash",
        F.to_json(
            F.array(F.concat(F.lit("ineligible study_design="), "study_design", F.lit(": "), "study_design_basis"))
        ).alias("errors"),
    )


def manifest_error_rows(failed: DataFrame) -> DataFrame:
    """Skip-shaped rows for entries that failed; the batch goes on."""
    return failed.select(
        F.coalesce("trial_id", F.concat(F.lit("manifest-entry-"), F.col("entry_index"))).alias("trial_id"),
        F.lit(C.SKIP_OUTCOME).alias("outcome"),
        F.lit(C.SKIP_EFFECT).alias("effect_of_interest"),
        F.lit("unclear").alias("study_design"),
        F.lit("manifest entry failed before assessment").alias("study_design_basis"),
        F.concat(F.lit("manifest entry "), F.col("entry_index"), F.lit(" failed: "), F.col("error")).alias("errors"),
    )


def sticky_sum(value: Column) -> Column:
    """Sum that is null as soon as one addend is unknown."""
    return F.when(~F.bool_or(value.isNull()), F.sum(value))


def known_total(*values: Column) -> Column:
    """Row-wise sum of the known values; all unknown gives null."""
    total = None
    for v in values:
        term = F.coalesce(v, F.lit(0))
        total = term if total is None else total + term
    return F.when(F.coalesce(*values).isNotNull(), total)


def batch_totals(timings: DataFrame, group: list[str]) -> DataFrame:
    return timings.groupBy(*group).agg(
        F.count(F.lit(1)).alias("processed_entries"),
        F.sum("wall_time_s").alias("total_wall_time_s"),
        F.sum("call_latency_s").alias("total_call_latency_s"),
        F.sum("call_count").alias("total_calls"),
        sticky_sum(F.col("token_count")).alias("total_tokens"),
        sticky_sum(F.when(~F.col("pricing_unknown"), F.col("cost"))).alias("total_cost"),
    )


def slowest(timings: DataFrame, n: int = 5) -> DataFrame:
    return timings.orderBy(F.desc("wall_time_s"), "trial_id").limit(n)


def entry_events(status: DataFrame) -> DataFrame:
    """Audit event for every skipped entry."""
    return status.where(F.col("skip_reason").isNotNull()).select(
        F.lit("batch.entry.skipped").alias("event_type"),
        F.lit("skipped").alias("status"),
        "trial_id",
        "entry_id",
        F.to_json(F.struct(F.col("skip_reason").alias("reason"), "trial_id")).alias("payload"),
    )
