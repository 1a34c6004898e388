"""Versioned latest-wins store: immutable layers, one small version file that names them.

    store/data/<id>/bucket=<b>/*.parquet     a layer: the latest row of each of its keys, never changed
    store/versions/<number>.json             the layers of a version, oldest first

An upsert writes its rows as a new layer and then the next version file, which appears whole by a
rename.  Until then readers see the version before it, and whatever a killed run has left is in no
version.  An upsert costs what it brings: older layers are read only when the newest ones together
have grown to the size of the one before them, so a row is written again a logarithmic number
of times.  Readers merge the layers of a version, by default the last one; single writer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialsift.operators.batch import latest_wins

#: Version files are read one by one only; their number is a run's number of upserts.
_DIGITS = 12


@dataclass
class Version:
    number: int
    key: list[str]
    order: list[str]
    buckets: int
    schema: StructType
    layers: list[dict]  # folder, rows


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    target, files = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions."""
    return [int(n[:_DIGITS]) for n in _listed(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith((".", "_"))]


def _read_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    known = versions(spark, path)
    if number is None:
        if not known:
            return None
        number = known[-1]
    elif number not in known:
        raise ValueError(f"{path} has no version {number}")
    target, files = _fs(spark, f"{path}/versions/{number:0{_DIGITS}d}.json")
    source = files.open(target)
    try:
        held = json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()
    return Version(number, held["key"], held["order"], held["buckets"], StructType.fromJson(held["schema"]), held["layers"])


def commit(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version visible: written beside the others under another name, then renamed."""
    name = f"{path}/versions/{version.number:0{_DIGITS}d}.json"
    body = {
        "key": version.key,
        "order": version.order,
        "buckets": version.buckets,
        "schema": json.loads(version.schema.json()),
        "layers": version.layers,
    }
    draft, files = _fs(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    final, _ = _fs(spark, name)
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(body), "utf-8"))
    finally:
        out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another writer has committed version {version.number} of {path}")


def _joined_schema(one: StructType, other: StructType) -> StructType:
    """Columns of both; a column of two types is an error."""
    have = {f.name: f.dataType for f in one}
    for f in other:
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"column {f.name}: {have[f.name].simpleString()} and {f.dataType.simpleString()}")
    return StructType([*one.fields, *(f for f in other if f.name not in have)])


def _write_layer(rows: DataFrame, path: str, key: list[str], buckets: int) -> dict:
    """A layer of `rows`; its buckets keep rows that may replace each other in one folder."""
    folder = f"data/{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    # Rebalanced, a bucket of very many rows is written by several tasks.
    placed = rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
    placed.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return {"folder": folder, "rows": rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{folder}").count()}


def _merged(spark: SparkSession, path: str, version: Version, layers: list[dict]) -> DataFrame:
    """The latest row of each key of some layers; of rows of one order the newer layer's."""
    rows = None
    for k, layer in enumerate(layers):
        # a column that a layer has not is null
        part = spark.read.schema(version.schema).parquet(f"{path}/{layer['folder']}").withColumn("_layer", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    if len(layers) == 1:
        return rows.drop("_layer")
    return latest_wins(rows, rows.limit(0), version.key, (*version.order, "_layer")).select(*version.schema.names)


def upsert(new: DataFrame, path: str, key, order, buckets: int) -> int:
    """Latest-wins upsert of `new`; gives the number of the version it commits.

    Per key the row of the greatest `order` stays, of equal ones the later upsert's, so a rerun gives the
    same table.  Columns that only the store or only the new rows have stay, null where a row lacks
    them; the same name with another type, and another key, order or bucket count than the
    store's, are errors.  Without new rows nothing is committed.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    key, order = list(key), list(order)
    old = _read_version(spark, path)
    if old and (old.key, old.order, old.buckets) != (key, order, buckets):
        raise ValueError(f"the store has {old.buckets} buckets, key {old.key} and order {old.order}")
    schema = _joined_schema(old.schema, new.schema) if old else new.schema
    schema = StructType([type(f)(f.name, f.dataType, True) for f in schema])
    layer = _write_layer(latest_wins(new, new.limit(0), key, order), path, key, buckets)
    if not layer["rows"]:
        return old.number if old else 0
    number = old.number + 1 if old else 1
    layers = [*(old.layers if old else []), layer]
    version = Version(number, key, order, buckets, schema, layers)
    first, rows = len(layers) - 1, layer["rows"]
    while first and rows >= layers[first - 1]["rows"]:
        first -= 1
        rows += layers[first]["rows"]
    if first < len(layers) - 1:
        together = _merged(spark, path, version, layers[first:])
        version.layers = [*layers[:first], _write_layer(together, path, key, buckets)]
    commit(spark, path, version)
    return number


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last one; later upserts do not change what was read."""
    path = path.rstrip("/")
    held = _read_version(spark, path, version)
    if held is None:
        raise ValueError(f"{path} holds no version")
    return _merged(spark, path, held, held.layers)


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Drop all but the last `keep` versions and every layer that none of those names; gives the folders dropped.

    Not while an upsert runs: its layer is in no version yet.
    """
    path = path.rstrip("/")
    known = versions(spark, path)
    kept = [_read_version(spark, path, n) for n in known[-keep:]]
    named = {layer["folder"].removeprefix("data/") for v in kept for layer in v.layers}
    gone = [f for f in _listed(spark, f"{path}/data") if f not in named] if kept else []
    for number in known[:-keep]:
        target, files = _fs(spark, f"{path}/versions/{number:0{_DIGITS}d}.json")
        files.delete(target, False)
    for folder in gone:
        target, files = _fs(spark, f"{path}/data/{folder}")
        files.delete(target, True)
    return gone
