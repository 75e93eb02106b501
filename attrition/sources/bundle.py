"""Model bundle, run metadata and run log on shared storage.

A bundle directory holds ``nodes/`` (the trees as one Parquet node table),
``threshold/`` and ``features/`` (one-row JSON tables) and ``manifest/``: for every
data file of the parts its length and SHA-256, written under another name and
renamed when all else is there. A bundle without a manifest, or one whose files
differ from it, is refused with the name of the part. Paths should name shared
storage on a cluster (for example a folder under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.plans.boost import Model, read_nodes
from attrition.session import Storage, local_rows


@dataclass
class Bundle:
    model: Model
    threshold: float
    features: list[str]


PARTS = ("nodes", "threshold", "features")


def _checksums(spark: SparkSession, path: str) -> dict[str, dict[str, list]]:
    """Length and SHA-256 of each data file of each part."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{path}/{part}" for part in PARTS])
    place = F.split("path", "/")
    rows = files.select(F.element_at(place, -2).alias("part"), F.element_at(place, -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).collect()
    return {part: {r["name"]: [r["length"], r["sha256"]] for r in rows if r["part"] == part} for part in PARTS}


def save_model_bundle(spark: SparkSession, path: str, model: Model, threshold: float, features: list[str]) -> None:
    """Writes the parts, then the manifest that makes the bundle whole."""
    storage = Storage(spark, path)
    storage.delete(f"{path}/manifest")
    model.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    local_rows(spark, [(float(threshold),)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/threshold")
    local_rows(spark, [(json.dumps(list(features)),)], "features string").coalesce(1).write.mode("overwrite").json(f"{path}/features")
    manifest = {"n_features": len(features), "rounds": len(model.trees), "max_depth": model.max_depth, "files": _checksums(spark, path)}
    draft = f"{path}/manifest-{uuid.uuid4().hex}"
    local_rows(spark, [(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(draft)
    storage.rename(draft, f"{path}/manifest")


def load_model_bundle(spark: SparkSession, path: str) -> Bundle:
    storage = Storage(spark, path)
    for part in (*PARTS, "manifest"):
        if not storage.exists(f"{path}/{part}"):
            raise FileNotFoundError(f"{path}/{part}")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    found = _checksums(spark, path)
    for part in PARTS:
        if found[part] != manifest["files"][part]:
            raise ValueError(f"{path}/{part} isn't what the manifest says")
    thr = spark.read.schema("threshold double").json(f"{path}/threshold").first()["threshold"]
    feats = json.loads(spark.read.schema("features string").json(f"{path}/features").first()["features"])
    model = Model(feats, read_nodes(spark, f"{path}/nodes"), manifest["max_depth"])
    return Bundle(model, float(thr), feats)


def bundle_table(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """The bundle's threshold and ordered feature list as rows
    (``position, feature, threshold``)."""
    rows = [(i, f, bundle.threshold) for i, f in enumerate(bundle.features)]
    return local_rows(spark, rows, "position int, feature string, threshold double")


def save_run_metadata(spark: SparkSession, path: str, metrics: dict) -> DataFrame:
    """Write a metrics dict as a one-row JSON table (timestamped)."""
    record = {"saved_at": time.strftime("%Y%m%d-%H%M%S"), **{k: v for k, v in metrics.items()}}
    df = local_rows(spark, [(json.dumps(record, default=str),)], "metadata string")
    df.coalesce(1).write.mode("overwrite").json(path)
    return df


RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def log_run(spark: SparkSession, path: str, params: dict, metrics: dict, run_id: str | None = None) -> str:
    """Append the params and metrics of one training run to an append-only
    Parquet run log (``run_id, logged_at, kind, key, value``)."""
    run_id = run_id or uuid.uuid4().hex
    rows = [(run_id, "param", k, json.dumps(v, default=str)) for k, v in params.items()]
    rows += [(run_id, "metric", k, json.dumps(v, default=str)) for k, v in metrics.items()]
    df = local_rows(spark, rows, "run_id string, kind string, key string, value string").coalesce(1).select(
        "run_id", F.current_timestamp().alias("logged_at"), "kind", "key", "value"
    )
    df.write.mode("append").parquet(path)
    return run_id


def read_run_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    log = spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
    return log if run_id is None else log.filter(F.col("run_id") == run_id)
