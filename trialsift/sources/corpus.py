"""Shape the given tables into the engine's input tables.

Every frame here is a row-local projection of a given table, so its size
follows that table.  Draws come from md5, which is the same in every engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift import constants as C


FAN_OUT = ("orders", "documents")
#: An order unfolds into 22 answers with several draws each.
ORDERS_A_TASK = 50_000


def order_tasks(orders: DataFrame) -> int:
    """Tasks that unfold at most `ORDERS_A_TASK` orders each; the rows are counted by the files' footers."""
    return max(orders.sparkSession.sparkContext.defaultParallelism, math.ceil(orders.count() / ORDERS_A_TASK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.

    The two tables whose rows fan out into many derived rows are spread over
    the cores when they come as fewer splits than there are cores (one small
    file), orders also when a task would hold too many; a large input of
    documents has enough splits and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = order_tasks(df) if name == "orders" else spark.sparkContext.defaultParallelism
    if name in FAN_OUT and df.rdd.getNumPartitions() < tasks:
        df = df.repartition(tasks)
    return df


def draw(seed: Column, modulus: int) -> Column:
    """Repeatable draw in [0, modulus) from the first 32 bits of md5."""
    return (F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") % F.lit(modulus)).cast("int")


def code_of(seed: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(C.RAW_CODES)), ","), draw(seed, 5) + 1)


def code_sql(seed: str) -> str:
    """Same draw as `code_of`, as SQL text."""
    codes = ", ".join(f"'{c}'" for c in C.RAW_CODES)
    return f"array({codes})[CAST(CAST(conv(substring(md5({seed}), 1, 8), 16, 10) AS BIGINT) % 5 AS INT)]"


def effect_of(custkey: Column) -> Column:
    return F.when(custkey % 3 == 0, "adhering").otherwise("assignment")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per customer."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey")).alias("trial_id"), effect_of(F.col("c_custkey")).alias("effect")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (trial, outcome) pair per order."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey")).alias("trial_id"),
        F.concat(F.lit("O"), F.col("o_orderkey")).alias("outcome"),
        effect_of(F.col("o_custkey")).alias("effect"),
    )


def _questions(df: DataFrame, sq_ids) -> DataFrame:
    return df.withColumn("sq_id", F.explode(F.array(*[F.lit(s) for s in sq_ids])))


def raw_answers(spark: SparkSession, sf_dir: str, sq_ids=C.ALL_SQS) -> DataFrame:
    """Supplied answer codes for every pair and question, long."""
    seed = F.concat_ws("|", "trial_id", "outcome", "sq_id")
    return _questions(pairs(spark, sf_dir), sq_ids).withColumn("answer", code_of(seed))


def trial_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied D1 answers, once per trial."""
    return _questions(trials(spark, sf_dir), C.DOMAIN_SQS["D1"]).withColumn(
        "answer", code_of(F.concat_ws("|", "trial_id", "sq_id"))
    )


def evidence_of(seed: Column) -> dict[str, Column]:
    """The verification and retrieval signals that back the answer drawn from `seed`."""
    s = lambda tag: F.concat(F.lit(tag), seed)
    available = draw(s("a"), 4)
    return {
        "error": F.when(draw(s("e"), 53) == 0, F.lit("TimeoutError: request timed out")),
        "quote_found": draw(s("v"), 10) < 8,
        "segments_available": available,
        "segments_retrieved": F.least(available, F.lit(2)),
        "retrieval_top_score": F.when(draw(s("d"), 3) > 0, draw(s("r"), 100) / F.lit(100.0)),
    }


def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers with the verification and retrieval signals that back them."""
    seed = F.concat_ws("|", "trial_id", "outcome", "sq_id")
    return raw_answers(spark, sf_dir).select("*", *[c.alias(n) for n, c in evidence_of(seed).items()])


# --------------------------------------------------------------------------
# page tables: one page per line of a document; some pages open with a heading

PAPER_HEADINGS = (*C.CANONICAL_SECTION_LABELS, "Study design", "Allocation concealment")
SUPPLEMENT_HEADINGS = (
    "Randomisation and allocation", "FAX", "Blinding of participants", "Page 3 of 9", "Missing outcome data",
    "Outcome assessment", "Study protocol", "Note", "Statistical analysis plan", "Interim analysis",
    "Supplementary appendix", "Date:", "CONFIDENTIAL", "Central review committee", "**Eligibility** __criteria__",
    "Declaration of interests", "Sample size", "1.2 Follow-up", "Registry entry", "CONFIDENTIAL",
    "Adherence and compliance",
)


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt by id, whole: what unfolds of them is grouped by document without a further shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def _pages(spark: SparkSession, sf_dir: str, headings, mark: str, every: int, stride: int, line: str = "line") -> DataFrame:
    listed = ", ".join("'" + h + "'" for h in headings)
    return (
        dealt_documents(spark, sf_dir)
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
        .selectExpr("doc_id", "page", f"{line} AS line")
        .selectExpr(
            "doc_id",
            "page",
            f"""IF(page % {every} = 0, concat('{mark} ',
                array({listed})[CAST((doc_id * {stride} + page div {every}) % {len(headings)} AS INT)], '\n', line), line) AS text""",
        )
    )


def paper_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some pages report a participant count
    flow = "IF(page % 5 = 1, concat(line, ' In all, ', 100 + page, ' participants were randomised.'), line)"
    return _pages(spark, sf_dir, PAPER_HEADINGS, "##", 3, 7, flow)


def supplement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, SUPPLEMENT_HEADINGS, "#", 2, 5)
