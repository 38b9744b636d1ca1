"""JSONL manifests and logs: discovery, scans, sinks and completion markers, on any Hadoop file system."""

from __future__ import annotations

import io
import tarfile
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.languages import FOLDERS

MANIFEST = (
    "id string, duration double, supervisions array<struct<id: string, recording_id: string, start: double, duration: double, text: string, language: string>>, "
    "custom string, tags map<string, string>, recording string, _corrupt string"
)
EMISSION = "time string, rank int, world_size int, worker_id int, batch_idx long, num_cuts int, cut_ids array<string>, _corrupt string"


#: A line that gave no known field is no record; Spark also refuses a scan of the corrupt column alone.
VALID = "_corrupt is null and (id is not null or duration is not null or supervisions is not null or custom is not null)"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees and that goes when Spark ends."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", home)
    path = f"{home.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def manifest_files(spark: SparkSession, source: str) -> list[str]:
    """Shards ``cuts.*.jsonl[.gz]`` of a source by stem; a plain file wins over its compressed twin."""
    by_stem = {f.removesuffix(".gz"): f for f in listed(spark, f"{source}/cuts.*.jsonl.gz")}
    by_stem |= {f: f for f in listed(spark, f"{source}/cuts.*.jsonl")}
    return [by_stem[s] for s in sorted(by_stem)]


def read_manifests(spark: SparkSession, sources: list[str], corrupt: str = "skip", unreadable: str = "fail") -> DataFrame:
    """Records of all sources in one scan, plain and gzip together; blank lines never count.

    ``custom`` stays JSON text, as sources disagree on its fields. Broken lines are skipped, or kept with ``_corrupt``.
    A file that cannot be read (a damaged gzip) fails the scan, or counts as empty from there on.
    """
    files = [f for s in sources for f in manifest_files(spark, s)]
    if not files:
        df = spark.createDataFrame([], MANIFEST)
    else:
        df = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", unreadable == "empty").json(files)
    df = df.withColumns({"file": F.col("_metadata.file_path")} if files else {"file": F.lit("")})
    df = df.withColumns({"shard": F.regexp_extract("file", r"cuts\.([^./]+)\.jsonl", 1), "source": F.regexp_replace("file", r"/[^/]*$", "")})
    return df.where(VALID).drop("_corrupt") if corrupt == "skip" else df


def read_cuts_file(spark: SparkSession, path: str, mode: str = "measure") -> DataFrame:
    """A single cuts file; the loader of runs refuses this kind of source."""
    if mode == "train":
        raise ValueError("a cuts file is no source of a run")
    return spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt").json(path).where(VALID).drop("_corrupt")


def first_record(spark: SparkSession, source: str) -> dict | None:
    """The first valid record of the first shard."""
    for f in manifest_files(spark, source):
        rows = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt").json(f).where("_corrupt is null and id is not null").limit(1).collect()
        if rows:
            return rows[0].asDict(recursive=True)
    return None


def read_emissions(spark: SparkSession, directory: str) -> DataFrame:
    """Emission logs; rank, world size, worker and process come from the file name, other files are left out."""
    df = spark.read.schema(EMISSION).option("columnNameOfCorruptRecord", "_corrupt").json(directory).where("_corrupt is null").drop("_corrupt", "rank", "world_size")
    name = F.regexp_extract("_metadata.file_path", r"rank(\d+)_ws(\d+)_worker(\d+)_pid(\d+)", 0)
    part = lambda i: F.regexp_extract("_metadata.file_path", r"rank(\d+)_ws(\d+)_worker(\d+)_pid(\d+)", i).cast("int")
    return df.where(name != "").withColumns({"rank": part(1), "world_size": part(2), "worker": part(3), "pid": part(4), "file_pos": F.monotonically_increasing_id()})


def read_history(spark: SparkSession, path: str, metrics: tuple = ("loss", "grad_norm", "learning_rate", "eval_loss")) -> DataFrame:
    """(step, metric, value) of a run's state; a later entry wins."""
    df = spark.read.option("multiLine", True).json(path).select(F.posexplode("log_history").alias("pos", "e"))
    have = [m for m in metrics if m in df.schema["e"].dataType.names]
    long = df.select("pos", F.col("e.step").alias("step"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"e.{m}").cast("double").alias("value")) for m in have])).alias("x"))
    return long.where("x.value is not null").groupBy("step", F.col("x.metric").alias("metric")).agg(F.max_by("x.value", "pos").alias("value"))


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a results file; broken lines are left out."""
    df = spark.read.schema("id string, file_id string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt is null").select(F.coalesce("id", "file_id").alias("id")).where("id is not null").distinct()


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar", recursive: bool = True) -> DataFrame:
    """(tar, name, stem, extension, content) of every file in matching tars, one tar per task at a time."""
    tars = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tar, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as f:
                    for m in f:
                        if m.isfile():
                            stem, _, ext = m.name.partition(".")
                            row = [tar, m.name, stem.removesuffix(".metadata"), ext]
                            yield pa.RecordBatch.from_arrays([*[pa.array([x]) for x in row], pa.array([f.extractfile(m).read()], pa.binary())], names=["tar", "name", "stem", "extension", "content"])

    return tars.select("path", "content").mapInArrow(members, "tar string, name string, stem string, extension string, content binary")


# Corpora whose variants are configurations of one language.
MONOLINGUAL = ("librispeech", "peoples_speech")


def dataset_tree(spark: SparkSession, root: str, known: tuple[str, ...] | None = None) -> list[dict]:
    """Entries of ``root/dataset/variant/split``; hidden folders are left out, with ``known`` other names too (with a warning).

    The variant of a multilingual corpus is its language, that of a monolingual one a configuration.
    """
    out, other = [], set()
    for p in listed(spark, f"{root}/*/*/*"):
        dataset, variant, split = p.rstrip("/").split("/")[-3:]
        if any(x.startswith((".", "_")) for x in (dataset, variant, split)):
            continue
        if known is not None and dataset not in known:
            other.add(dataset)
            continue
        lang = "en" if dataset in MONOLINGUAL else FOLDERS.get(variant.lower(), variant.lower())
        out.append({"dataset": dataset, "variant": variant, "split": split, "path": p, "lang": lang})
    if other:
        warnings.warn(f"unknown corpora are left out: {', '.join(sorted(other))}", stacklevel=2)
    return out


def write_shards(df: DataFrame, path: str, shard_size: int, gzip: bool = False) -> None:
    """JSONL shards of at most ``shard_size`` records; Spark's commit protocol replaces merging worker folders."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", shard_size).option("compression", "gzip" if gzip else "none").json(path)


def write_manifest(df: DataFrame, path: str, shard_size: int, gzip: bool = False) -> list[str]:
    """Shards ``cuts.NNNNNN.jsonl[.gz]`` of at most ``shard_size`` records, named once all are written."""
    write_shards(df, path, shard_size, gzip)
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    made = []
    for i, part in enumerate(listed(spark, f"{path}/part-*")):
        to = f"{path}/cuts.{i:06d}.jsonl{'.gz' if gzip else ''}"
        fs.rename(_fs(spark, part)[1], _fs(spark, to)[1])
        made.append(to)
    return made


def write_report(df: DataFrame, path: str, separator: str = ",") -> None:
    """A small report as one CSV file with a header; tab-separated with another separator."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON results without the arrays of single records."""
    df.select(*[c for c, kind in df.dtypes if not kind.startswith("array")]).write.mode("overwrite").json(path)


def write_emissions(plan: DataFrame, path: str, world_size: int, every: int = 1, most: int | None = None) -> None:
    """The batch plan (rank, worker, batch_idx, cut_ids) as emission logs, one folder per stream, every so many batches."""
    some = plan.where(F.col("batch_idx") % every == 0)
    some = some if most is None else some.where(F.col("batch_idx") < most * every)
    stream = F.format_string(f"rank%d_ws{world_size}_worker%d_pid0", "rank", "worker")
    rows = some.select(stream.alias("stream"), F.col("worker").alias("worker_id"), "batch_idx", F.size("cut_ids").alias("num_cuts"), "cut_ids")
    rows.repartition("stream").write.mode("overwrite").partitionBy("stream").json(path)


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    """What a run was made with, as one JSON row."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata of a run; {} where there is none or it is broken."""
    import json

    if not listed(spark, f"{path}/part-*"):
        return {}
    row = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(row[0]) if row else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_cache(df: DataFrame, path: str) -> None:
    """Measurements by source: only the partitions in ``df`` are replaced, each atomically."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)


def is_complete(spark: SparkSession, path: str, marker: str = ".complete") -> bool:
    """A marker is there, or the folder is not empty."""
    return bool(listed(spark, f"{path}/{marker}") or listed(spark, f"{path}/*"))


def mark_complete(spark: SparkSession, path: str, errors: int, marker: str = ".complete") -> bool:
    """Writes the marker only where nothing failed."""
    if errors:
        return False
    fs, p = _fs(spark, f"{path}/{marker}")
    fs.create(p, True).close()
    return True
