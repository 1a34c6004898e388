"""Queries over files: given tables are written in each source's format to shared storage and read back by its reader."""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import functions as F

from trialsift.functions import text as T
from trialsift.operators import registry as R
from trialsift.plans import batch as PB
from trialsift.plans import registry_records as PRR
from trialsift.plans.registry import REGISTRY, query
from trialsift.session import scratch_path
from trialsift.sources import corpus, readers, sinks
from trialsift.streaming import events as W


def _csv(df, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "manifest_file",
    """SELECT 'Trial '||doc_id AS trial_label, '/papers/p'||doc_id||'.pdf' AS main_paper, '/supp/a'||doc_id||'.pdf|/supp/b.pdf' AS supplements,
       CASE WHEN doc_id%4<>0 THEN 'NCT'||lpad(doc_id::VARCHAR,8,'0') END AS nct_number,
       CASE WHEN doc_id%3<>0 THEN source||'|Overall '||lang END AS outcomes FROM documents""",
)
def manifest_file(spark, sf):
    rows = corpus.table(spark, sf, "documents").selectExpr(
        "concat('Trial ', doc_id) AS trial_label",
        "concat(' /papers/p', doc_id, '.pdf') AS main_paper",
        "concat('/supp/a', doc_id, '.pdf ; /supp/b.pdf;') AS supplements",
        "IF(doc_id % 4 = 0, '', concat('registered as nct', lpad(doc_id, 8, '0'))) AS nct_number",
        "IF(doc_id % 3 = 0, ' ; ', concat(source, ';  Overall   ', lang, ' ;')) AS outcomes",
    )
    found = readers.read_manifest(spark, _csv(rows, "manifest"))
    return found.select(
        "trial_label", "main_paper", F.array_join("supplements", "|").alias("supplements"), "nct_number", F.array_join("outcomes", "|").alias("outcomes")
    )


@query(
    "gold_files",
    """WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'Low' WHEN 0 THEN 'High' END AS q, CASE toxic WHEN 1 THEN 'High' WHEN 0 THEN 'Some concerns' END AS t FROM labels)
     SELECT 'T'||doc_id AS trial_label, CASE WHEN doc_id%2=0 THEN 'Overall survival' ELSE 'Adverse events' END AS outcome, q AS d1, t AS d2, q AS d3, t AS d4, q AS d5, t AS overall_as_published FROM l""",
)
def gold_files(spark, sf):
    """One label file per outcome, short codes and full names in odd letter case."""
    rows = corpus.table(spark, sf, "labels").selectExpr(
        "doc_id",
        "concat('T', doc_id) AS Trial",
        *[f"CASE quality WHEN 1 THEN 'L' WHEN 0 THEN 'H' END AS D{i}" for i in (1, 3, 5)],
        *[f"CASE toxic WHEN 1 THEN 'H' WHEN 0 THEN 'S' END AS D{i}" for i in (2, 4)],
        "CASE toxic WHEN 1 THEN 'HIGH' WHEN 0 THEN 'Some Concerns' END AS `Overall Risk`",
    )
    columns = ["Trial", "D1", "D2", "D3", "D4", "D5", "Overall Risk"]
    files = {
        outcome: _csv(rows.where(F.col("doc_id") % 2 == part).select(*columns), "gold")
        for part, outcome in enumerate(("Overall survival", "Adverse events"))
    }
    return readers.read_gold(spark, files)


@query(
    "labelled_predictions",
    f"""WITH {PB._ENTRIES} SELECT r.trial_id, r.outcome, CASE WHEN o_custkey%2=0 THEN 'Trial '||o_custkey WHEN o_custkey IS NOT NULL THEN ' t'||o_orderkey ELSE r.trial_id END AS trial_label
     FROM results r LEFT JOIN orders ON r.trial_id='T'||o_orderkey WHERE r.outcome<>'__TRIAL__'""",
)
def labelled_predictions(spark, sf):
    """Assessed rows with the manifest's label where it gives one."""
    labels = corpus.table(spark, sf, "orders").selectExpr(
        "concat(' t', o_orderkey) AS nct_number", "IF(o_custkey % 2 = 0, concat('Trial ', o_custkey), NULL) AS trial_label"
    )
    return readers.read_predictions(PB.results(spark, sf).distinct(), labels).select("trial_id", "outcome", "trial_label")


def _event_lines(spark, sf) -> str:
    rows = corpus.table(spark, sf, "events").selectExpr(
        "'1' AS schema_version",
        "concat('run', user_id) AS run_id",
        "CAST(event_id AS STRING) AS event_id",
        "CAST(NULL AS STRING) AS parent_event_id",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS timestamp",
        "event_type",
        "IF(value > 100, 'ok', 'failed') AS status",
        "concat('T', user_id) AS trial_id",
        "array(concat('artifact', event_id), event_type) AS artifact_refs",
        "props AS payload",
    )
    path = scratch_path(spark, "event-lines")
    rows.write.json(path)
    return path


@query(
    "event_lines",
    """SELECT 'run'||user_id AS run_id, event_id::VARCHAR AS event_id, ts AS timestamp, event_type, CASE WHEN value>100 THEN 'ok' ELSE 'failed' END AS status,
       'artifact'||event_id||'|'||event_type AS artifacts, props AS payload FROM events""",
)
def event_lines(spark, sf):
    """Run events from JSON lines."""
    found = readers.read_events(spark, _event_lines(spark, sf))
    return found.select("run_id", "event_id", "timestamp", "event_type", "status", F.array_join("artifact_refs", "|").alias("artifacts"), "payload")


@query("stream_event_lines", REGISTRY["event_lines"][1])
def stream_event_lines(spark, sf):
    """The same JSON lines read as a stream."""
    found = W.to_table(spark, readers.stream_events(spark, _event_lines(spark, sf)), "append", "stream-lines")
    return found.select("run_id", "event_id", "timestamp", "event_type", "status", F.array_join("artifact_refs", "|").alias("artifacts"), "payload")


@query("registry_snapshots", f"WITH {PRR._REG} SELECT nct, NOT broken AS readable, rdesign AS design FROM des2")
def registry_snapshots(spark, sf):
    """Registry records out of one JSON file each, named by its id; a broken one is no record."""
    bodies = PRR.registry(spark, sf).select(F.concat("nct", F.lit(".json")).alias("name"), F.col("body").alias("text"))
    records = R.parse_records(readers.read_registry(spark, _written(bodies, "registry")))
    return records.select("nct", F.col("rec").isNotNull().alias("readable"), R.registry_design()["design"].alias("design"))


@query(
    "run_input_hashes",
    """SELECT '/papers/p'||doc_id||'.pdf' AS path, CASE WHEN doc_id%5<>0 THEN sha256(text) END AS sha256 FROM documents
     UNION ALL SELECT '/supp/a'||doc_id||'.pdf', NULL FROM documents""",
)
def run_input_hashes(spark, sf):
    """Input files of a run with their hashes, null for the missing ones."""
    docs = corpus.table(spark, sf, "documents")
    manifest = docs.selectExpr("concat('/papers/p', doc_id, '.pdf') AS main_paper", "array(concat('/supp/a', doc_id, '.pdf')) AS supplements")
    files = docs.where("doc_id % 5 <> 0").selectExpr("concat('file:///papers/p', doc_id, '.pdf') AS path", "sha2(text, 256) AS sha256")
    return readers.run_inputs(manifest, files).select("path", "sha256")


def _written(rows, folder: str) -> str:
    """Each row's text as a file of its name in a new shared folder, written by the task that holds it."""
    folder = scratch_path(rows.sparkSession, folder)

    def write(frames):
        files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(root, recursive=True)
        for frame in frames:
            for name, text in zip(frame["name"], frame["text"]):
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(text.encode())
            yield frame[["name"]]

    rows.select("name", "text").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _files(spark, sf) -> str:
    """Texts as files of a folder; every fifth is missing."""
    named = corpus.table(spark, sf, "documents").where("doc_id % 5 <> 0 AND text IS NOT NULL")
    # some are no PDF files and stay out
    return _written(named.selectExpr("concat('a', doc_id, IF(doc_id % 7 = 0, '.txt', '.pdf')) AS name", "text"), "supplements")


@query(
    "supplement_files",
    "SELECT 'a'||doc_id||'.pdf' AS name, strlen(text) AS length, sha256(text) AS sha256 FROM documents WHERE doc_id%5<>0 AND doc_id%7<>0 AND text IS NOT NULL",
)
def supplement_files(spark, sf):
    """PDF files of a folder with their sizes and hashes."""
    found = readers.read_supplement_files(spark, _files(spark, sf))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", "sha256")


@query(
    "run_file_hashes",
    """SELECT 'a'||doc_id||'.pdf' AS name, CASE WHEN doc_id%5<>0 AND doc_id%7<>0 AND text IS NOT NULL THEN sha256(text) END AS sha256 FROM documents""",
)
def run_file_hashes(spark, sf):
    """Input files of a run with the hashes of what is there; a missing file keeps a null hash."""
    folder = _files(spark, sf)
    at = F.concat(F.lit(urlparse(folder).path + "/a"), F.col("doc_id"), F.lit(".pdf"))
    manifest = corpus.table(spark, sf, "documents").select(at.alias("main_paper"), F.array().cast("array<string>").alias("supplements"))
    found = readers.run_inputs(manifest, readers.read_file_hashes(spark, folder))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "sha256")


@query(
    "trace_tables",
    """SELECT 'calls' AS name, event_type AS kind, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL
     UNION ALL SELECT 'spans', 'user'||(user_id%7), count(*), round(sum(value),4) FROM events GROUP BY ALL""",
)
def trace_tables(spark, sf):
    """Trace tables of a run, written and read back."""
    events = corpus.table(spark, sf, "events")
    path = scratch_path(spark, "trace")
    sinks.write_trace(
        {
            "calls": events.selectExpr("event_type AS kind", "value"),
            "spans": events.selectExpr("concat('user', user_id % 7) AS kind", "value"),
        },
        path,
    )
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("name"), "kind", "value") for name in ("calls", "spans")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "markdown_tables",
    """WITH w AS (SELECT conv_id, turn, replace(role,'|','\\|') AS a, regexp_replace(replace(split_part(text,' ',1),'|','\\|'),'\\s+',' ','g') AS b, regexp_replace(replace(split_part(text,' ',2),'|','\\|'),'\\s+',' ','g') AS c FROM conversations)
     SELECT conv_id, turn, '|'||a||'|x\\|y|'||chr(10)||'|---|---|'||chr(10)||CASE WHEN trim(b)='' AND trim(c)='' THEN '' ELSE '|'||trim(b)||'|'||trim(c)||'|'||chr(10) END||'|last||' AS table_md FROM w""",
)
def markdown_tables(spark, sf):
    """Tables as Markdown: a blank row goes, a short one is padded, bars are escaped."""
    rows = corpus.table(spark, sf, "conversations").selectExpr(
        "conv_id",
        "turn",
        "array(array(role, 'x|y'), array(split_part(text, ' ', 1), split_part(text, ' ', 2)), array(' ', CAST(NULL AS STRING)), array('last')) AS r",
    )
    return rows.select("conv_id", "turn", T.rows_to_markdown(F.col("r")).alias("table_md"))




@query(
    "report_cells",
    """SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN 'Unknown' WHEN o_orderstatus='F' THEN 'Yes' ELSE 'No' END AS flag,
      CASE WHEN o_custkey%3=0 THEN 'Unknown' ELSE printf('$%.4f', o_custkey/8.0::DOUBLE) END AS cost, CASE WHEN o_custkey%5=0 THEN 'Unknown' ELSE printf('%.3f', o_custkey/8.0::DOUBLE) END AS score FROM orders""",
)
def report_cells(spark, sf):
    """Yes/no, money and number cells of a report; what is not known says so."""
    orders = corpus.table(spark, sf, "orders")
    amount = F.col("o_custkey") / F.lit(8.0)
    return orders.select(
        "o_orderkey",
        T.yes_no(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")).alias("flag"),
        T.money(F.when(F.col("o_custkey") % 3 != 0, amount)).alias("cost"),
        T.number3(F.when(F.col("o_custkey") % 5 != 0, amount)).alias("score"),
    )
