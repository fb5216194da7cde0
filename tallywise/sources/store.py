"""Datasets and run stores as Parquet and JSON tables: materialising, signatures, logging, reading back."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.functions.texts import sanitised_key, stringified
from tallywise.operators.order import positions
from tallywise.sources.staging import staged


def read_splits(spark: SparkSession, root: str, splits: list[str], fmt: str = "parquet") -> DataFrame:
    """All splits below ``root`` with a column ``split``; rows keep their columns by name."""
    parts = [spark.read.format(fmt).load(f"{root}/{s}").withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def json_records(rows: DataFrame, column: str, record: str) -> DataFrame:
    """Records of JSON objects keyed by id: (key, fields of ``record``, a struct in DDL); malformed text gives none."""
    parsed = F.from_json(F.col(column), f"map<string,{record}>")
    return rows.select(F.explode(parsed).alias("key", "record")).select("key", "record.*")


def read_json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The same from files that hold one object each; JSON lines scale better."""
    return json_records(spark.read.text(path, wholetext=True), "value", record)


def attach_paths(records: DataFrame, files: DataFrame, name: str = "file") -> DataFrame:
    """Each record with the ``path`` of its file: the exact path, else the only file of that base name, else an error."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    exact = files.select(F.col("path").alias("exact"), F.col("path").alias("__key"))
    single = files.groupBy(base(F.col("path")).alias("__base")).agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("by_base")).filter("n = 1").drop("n")
    found = records.withColumn("__base", base(F.col(name))).join(exact, F.col(name) == F.col("__key"), "left").join(single, "__base", "left")
    path = F.coalesce("exact", "by_base", F.raise_error(F.concat(F.lit("no single file for "), F.col(name))).cast("string"))
    return found.select(*records.columns, path.alias("path"))


def canonical_json(spec: object) -> str:
    return json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str)


def spec_key(spec: dict, operational: tuple[str, ...] = ("cache_dir", "verbose", "batch_size")) -> str:
    """SHA-1 of the fields that decide the content."""
    return hashlib.sha1(canonical_json({k: v for k, v in spec.items() if k not in operational}).encode()).hexdigest()


def materialise(df: DataFrame, spec: dict, root: str) -> DataFrame:
    """``df`` from its table below ``root``, computed and written only if no finished one is there."""
    spark, path = df.sparkSession, f"{root}/{spec_key(spec)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_signature(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, signature) of all files below a path, from their names, sizes and times; Spark does not list empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    h = F.xxhash64("path", "length", "modificationTime")
    # sums do not depend on the order of the files, so no list of them is gathered
    mark = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha1(mark.cast("binary")).alias("signature"))


def content_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """(rows, hash) that depends on content and keys but not on order: no list of rows is gathered."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sha1(F.concat_ws(":", F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).cast("binary")).alias("hash"))


def save_dataset(df: DataFrame, path: str, metadata: dict, force: bool = False) -> None:
    """By split, with a one-row JSON of metadata; an existing dataset is an error unless forced."""
    mode = "overwrite" if force else "errorifexists"
    df.write.mode(mode).partitionBy("split").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(canonical_json(metadata),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")


def flat_params(df: DataFrame, id_col: str, column: str, depth: int = 12, most: int = 50) -> DataFrame:
    """(id, key, value) of a nested column: keys ``a/b/c``, lists as JSON of at most ``most`` entries, null as ``null``."""
    found: list[tuple[str, Column]] = []

    def walk(path: list[str], field: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType) and len(path) < depth:
            for f in kind.fields:
                walk([*path, f.name], field[f.name], f.dataType)
        elif isinstance(kind, T.ArrayType):
            found.append(("/".join(path), F.to_json(F.slice(field, 1, most))))
        elif isinstance(kind, T.MapType | T.StructType):
            found.append(("/".join(path), F.to_json(field)))
        else:
            found.append(("/".join(path), field.cast("string")))

    walk([], F.col(column), df.schema[column].dataType)
    entries = F.array(*[F.struct(sanitised_key(F.lit(k)).alias("key"), stringified(v).alias("value")) for k, v in found])
    return df.select(id_col, F.explode(entries).alias("e")).select(id_col, "e.key", "e.value")


def flat_json_params(df: DataFrame, id_col: str, column: str, depth: int = 12, most: int = 50, lists: str = "json") -> DataFrame:
    """(id, key, value) of nested JSON text, a map or a struct: keys ``a/b/c``, null as ``null``; malformed text gives none.

    Lists are JSON of at most ``most`` entries, or by ``indices`` keys of their own (``a/b/0``).  What is nested deeper than ``depth`` stays
    JSON.  Each round takes one level off all rows that still have one.
    """
    if lists not in ("json", "indices"):
        raise ValueError(f"lists: {lists}")
    text = F.col(column) if isinstance(df.schema[column].dataType, T.StringType) else F.to_json(F.col(column), {"ignoreNullFields": "false"})
    now = df.select(id_col, F.lit(None).cast("string").alias("key"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")
    out, level = None, 0
    while True:
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | (kind.startswith("ARRAY") if lists == "indices" else F.lit(False))
        marked = staged(now.withColumn("inner", inner & F.lit(level <= depth)).withColumn("list", kind.startswith("ARRAY")))
        short = F.to_json(F.slice(F.expr("try_variant_get(v, '$', 'array<variant>')"), 1, most))
        value = F.when(F.col("list"), short).otherwise(F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.when(F.is_variant_null("v"), None).otherwise(F.to_json("v"))))
        leaves = marked.filter("NOT inner").select(id_col, sanitised_key(F.coalesce("key", F.lit(""))).alias("key"), stringified(value).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        deeper = marked.filter("inner")
        if deeper.isEmpty():
            return out
        found = df.sparkSession.sql(f"SELECT t.`{id_col}`, t.key AS above, e.key AS name, e.pos AS pos, e.value AS v FROM {{t}} t, LATERAL variant_explode(t.v) AS e", t=deeper)
        part = F.coalesce("name", F.col("pos").cast("string"))
        kept = found.filter(F.col("name").isNotNull() | (F.col("pos") < most))
        now, level = kept.select(id_col, F.when(F.col("above").isNull(), part).otherwise(F.concat_ws("/", "above", part)).alias("key"), "v"), level + 1


def config_roots(params: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Parameters whose first segment is included (all by default) and not excluded; ``choice/`` entries always stay."""
    root = F.split("key", "/")[0]
    keep = F.lit(True) if include is None else root.isin(include)
    return params.filter((root == "choice") | (keep & ~root.isin(exclude or [])))


def finite_metrics(metrics: DataFrame) -> DataFrame:
    v = F.col("value")
    return metrics.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def logged_metrics(metrics: DataFrame, log_every: int = 1) -> DataFrame:
    """Finite metrics of the steps that ``log_every`` divides."""
    return finite_metrics(metrics).filter(F.col("step") % log_every == 0)


def log_run(params: DataFrame, metrics: DataFrame, root: str, log_every: int = 1, batch: str | None = None) -> None:
    """Puts the runs into the long tables ``params`` and ``metrics`` below ``root``.

    What is logged together is a partition ``batch``, named after its runs if not by the caller; logging it again replaces it, so a
    retry adds nothing.
    """
    if batch is None:
        h = F.xxhash64("run_id")
        runs = params.select("run_id").union(metrics.select("run_id")).distinct()
        batch = runs.agg(F.sha1(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).cast("binary"))).first()[0]
    params.select("run_id", "key", "value").write.mode("overwrite").parquet(f"{root}/params/batch={batch}")
    logged_metrics(metrics, log_every).select("run_id", "step", "key", "value").write.mode("overwrite").parquet(f"{root}/metrics/batch={batch}")


def finished_runs(runs: DataFrame, params: DataFrame, experiments: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """(run_id, start_time, params map) of finished, active runs, with the newest first."""
    kept = runs.filter(F.col("status") == "FINISHED")
    if "lifecycle" in runs.columns:
        kept = kept.filter(F.col("lifecycle") == "active")
    if experiments is not None:
        kept = kept.join(experiments.filter(F.col("name") == name).select("experiment_id"), "experiment_id", "left_semi")
    maps = params.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))
    return kept.join(maps, "run_id", "left").select("run_id", "start_time", "params").orderBy(F.col("start_time").desc(), F.col("run_id").desc())


def runs_wide(params: DataFrame, metrics: DataFrame, param_keys: list[str], metric_keys: list[str]) -> DataFrame:
    """One row a run: ``param/...`` columns, and ``metric/...`` columns with the value of the last step."""
    p = params.groupBy("run_id").pivot("key", param_keys).agg(F.first("value"))
    m = metrics.groupBy("run_id").pivot("key", metric_keys).agg(F.max_by("value", "step"))
    p = p.select("run_id", *[F.col(f"`{k}`").alias(f"param/{k}") for k in param_keys])
    return p.join(m.select("run_id", *[F.col(f"`{k}`").alias(f"metric/{k}") for k in metric_keys]), "run_id", "full")


def metric_history(metrics: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(run_id, step, value) of one metric for the selected runs, in one join."""
    return metrics.filter(F.col("key") == key).join(runs.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "step", "value")


def numbered_rows(rows: DataFrame, order: str = "run_id") -> DataFrame:
    """``rows`` with ``row_idx`` from 0 in the order of a column, without a task that sees all of them."""
    return positions(rows, [order]).withColumnRenamed("pos", "row_idx").drop("n")


def write_manifest(rows: DataFrame, path: str, order: str = "run_id") -> None:
    """JSON lines with ``row_idx``, so that row i is a filter."""
    numbered_rows(rows, order).write.mode("errorifexists").json(path)


def manifest_row(spark: SparkSession, path: str, i: int) -> DataFrame:
    return spark.read.json(path).filter(F.col("row_idx") == i)


def images(spark: SparkSession, path: str, channels_first: bool = True) -> DataFrame:
    """(path, x) of image files: values in [0, 1], grey scale as three equal channels; all must have one shape.

    A file that is no image is an error.
    """
    import numpy as np
    import pandas as pd

    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    shape = raw.agg(F.min("height"), F.max("height"), F.min("width"), F.max("width"), F.min(F.when(F.col("height") < 0, F.col("origin")))).first()
    if shape[4] is not None:
        raise ValueError(f"not an image: {shape[4]}")
    if shape[0] != shape[1] or shape[2] != shape[3]:
        raise ValueError(f"images of different shapes: {tuple(shape)[:4]}")

    def run(parts):
        for part in parts:
            rows = []
            for d, h, w, c in zip(part["data"], part["height"], part["width"], part["nChannels"], strict=True):
                a = np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, ::-1].astype(np.float32) / 255
                a = np.repeat(a, 3, axis=2) if c == 1 else a[:, :, -3:]
                rows.append((a.transpose(2, 0, 1) if channels_first else a).ravel())
            yield pd.DataFrame({"path": part["origin"], "x": rows})

    return raw.mapInPandas(run, "path string, x array<float>")
