"""Table sources: manifests, reference labels, predictions, registry snapshots, pages, run events."""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import batch as B
from trialsift.operators import evaluate as E
from trialsift.functions import text as T

MANIFEST = "main_paper string, supplements string, nct_number string, outcomes string, trial_label string"
EVENTS = (
    "schema_version string, run_id string, event_id string, parent_event_id string, timestamp string, "
    "event_type string, status string, trial_id string, outcome string, domain string, sq_id string, "
    "artifact_refs array<string>, payload string"
)
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (byte-order mark allowed) or JSON: a list, or an object with `entries`."""
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    if path.lower().endswith(".json"):
        listed = spark.read.option("multiLine", True).schema(f"entries array<struct<{_fields()}>>, {MANIFEST}").json(path)
        rows = listed.select(
            F.explode(F.coalesce("entries", F.array(F.struct(*[c.split()[0] for c in MANIFEST.split(", ")])))).alias("e")
        ).select("e.*")
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
        wanted = [c.split()[0] for c in MANIFEST.split(", ")]
        rows = named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    return rows.select(
        B.resolve_path(F.coalesce("main_paper", F.lit("")), F.lit(base)).alias("main_paper"),
        B.supplement_list(F.col("supplements"), base).alias("supplements"),
        T.extract_nct(F.col("nct_number")).alias("nct_number"),
        B.outcome_list(B.clean(F.col("outcomes"))).alias("outcomes"),
        B.clean(F.col("trial_label")).alias("trial_label"),
    )


def _fields() -> str:
    return ", ".join(f"{c.split()[0]}: string" for c in MANIFEST.split(", "))


#: Bytes of a file read at once when it is hashed, and entries of a folder in one batch of its listing.
CHUNK, LISTED = 1 << 20, 10_000
#: Files whose texts are in memory at once.
READ = 100
#: File systems that tasks can open themselves; files of others are listed and read by Spark's own reader.
_OPENED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _entries(folder: str) -> Iterator[tuple[str, str, int]]:
    """(name, path, length) of the files directly inside a folder, or of the one file of that path, as they are met."""
    if (urlparse(folder).scheme or "file") == "file":
        root = os.path.abspath(re.sub("^file:/+", "/", folder))
        if os.path.isfile(root):
            yield os.path.basename(root), f"file:{root}", os.path.getsize(root)
            return
        # a generator: a folder of millions of files is never held whole
        with os.scandir(root) as found:
            for e in found:
                if e.is_file():
                    yield e.name, f"file:{os.path.join(root, e.name)}", e.stat().st_size
        return
    files, root = fs.FileSystem.from_uri(folder)
    head = folder[: len(folder) - len(urlparse(folder).path)]
    at = files.get_file_info(root)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    path = urlparse(folder).path.rstrip("/")
    for info in [at] if at.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root)):
        if info.type == fs.FileType.File:
            yield info.base_name, f"{head}{path}" if info is at else f"{head}{path}/{info.base_name}", info.size


def _list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the files directly inside a folder, without the hidden ones, listed by a task and dealt out by path.

    Spark's own listing keeps every file of a folder on the driver.
    """

    def listed(frames):
        for frame in frames:
            for folder in frame["folder"]:
                held: list[tuple[str, int]] = []
                for name, path, length in _entries(folder):
                    # what Spark takes for no data
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
                    if not hidden and fnmatchcase(name, pattern):
                        held.append((path, length))
                    if len(held) == LISTED:
                        yield pd.DataFrame(held, columns=["path", "length"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "length"])

    found = spark.createDataFrame([(folder,)], "folder string").coalesce(1).mapInPandas(listed, "path string, length long")
    # a file is a row of a few bytes and much work
    return found.repartition(file_tasks(spark), "path")


def file_tasks(spark: SparkSession) -> int:
    """Tasks that share the files of a folder, whatever their names' few bytes would seem to need."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _hashed(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in paths:
        out = []
        for path in frame["path"]:
            files, name = _opened(path)
            digest = hashlib.sha256()
            with files.open_input_stream(name, compression=None) as source:
                while chunk := source.read(CHUNK):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield frame.assign(sha256=out)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a listed path; local names stand as they are, whatever signs they hold."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def read_file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files directly inside a folder.

    Files are listed by a task, dealt out by path, and read a MiB at a time, so a file
    may be of any size and a folder may hold any number.
    """
    if (urlparse(folder).scheme or "file") not in _OPENED:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return found.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return _list_files(spark, folder, pattern).mapInPandas(_hashed, "path string, length long, sha256 string")


def read_supplement_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files directly inside a folder with their content hash, sorted by path."""
    return read_file_hashes(spark, folder, "*.pdf").orderBy("path")


def read_gold(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Reference labels, one CSV per outcome; short codes expanded, letter case normalised."""
    parts = []
    for outcome, path in files.items():
        raw = spark.read.option("header", True).csv(path)
        named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
        parts.append(
            named.select(
                F.col("Trial").alias("trial_label"),
                F.lit(outcome).alias("outcome"),
                *[E.expand_label(F.col(d)).alias(d.lower()) for d in C.DOMAINS],
                E.expand_label(F.col("Overall Risk")).alias("overall_as_published"),
            )
        )
    gold = parts[0]
    for part in parts[1:]:
        gold = gold.unionByName(part)
    return gold


def read_predictions(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Assessed rows of the results table with manifest labels, the id where none is listed."""
    named = labels.select(
        F.upper(F.trim("nct_number")).alias("trial_id"), F.coalesce("trial_label", "nct_number").alias("trial_label")
    ).where("trial_id <> ''").dropDuplicates(["trial_id"])
    return (
        results.where(F.col("outcome") != C.SKIP_OUTCOME)
        .join(named, "trial_id", "left")
        .withColumn("trial_label", F.coalesce("trial_label", "trial_id"))
    )


def _bodies(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in paths:
        for at in range(0, len(frame), READ):
            some = frame["path"].iloc[at : at + READ]
            out = []
            for path in some:
                files, name = _opened(path)
                # a packed file is unpacked by its ending, as Spark does
                with files.open_input_stream(name) as source:
                    out.append(source.read().removeprefix(codecs.BOM_UTF8))
            yield pd.DataFrame({"path": some.to_numpy(), "body": out})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry snapshots, one JSON document per file named by its id; malformed bodies stay text."""
    name = r"([^/]*)\.json$"
    if (urlparse(path).scheme or "file") not in _OPENED:
        return spark.read.text(path, wholetext=True).select(
            T.strict_nct(F.regexp_extract(F.input_file_name(), name, 1)).alias("nct"), F.col("value").alias("body")
        )
    read = _list_files(spark, path, "*").mapInPandas(_bodies, "path string, body binary")
    return read.select(T.strict_nct(F.regexp_extract("path", name, 1)).alias("nct"), F.col("body").cast("string").alias("body"))


def _timed(events: DataFrame) -> DataFrame:
    """ISO times down to microseconds, with or without an offset; others are null."""
    return events.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _timed(spark.read.schema(EVENTS).json(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return _timed(spark.readStream.schema(EVENTS).json(path))


def run_inputs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Input files of a run with their hashes; a missing file keeps a null hash."""
    paths = manifest.select(F.explode(F.concat(F.array("main_paper"), "supplements")).alias("path"))
    known = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "sha256")
    return paths.join(known, "path", "left")
