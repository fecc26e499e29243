"""Recording catalog, run directories, stage outputs, run log."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from signalops.functions.nulls import nan_to_null, require_columns

# Fixed patterns of the file layout.
RUN_PATTERN = r"^\d{4}-\d{2}-\d{2}_\d{6}$"
SUBJECT_PATTERN = r"/(D[^/]*)/[^/]+$"
CONDITION_PATTERN = r"[Ii][Gg][Ss]_(.+)\.[^./]+$"
CONDITION_STRIP = r"^2_IGS_"

# The field names of a quality record.
QC_SCHEMA = T.StructType([
    T.StructField("subject", T.StringType()), T.StructField("condition", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("duration_after_crop_sec", T.DoubleType()),
    T.StructField("n_epochs_before_reject", T.LongType()), T.StructField("n_epochs_after_reject", T.LongType()),
    T.StructField("n_epochs_dropped", T.LongType()), T.StructField("pct_epochs_dropped", T.DoubleType()),
    T.StructField("bad_channels", T.ArrayType(T.StringType())),
    T.StructField("ica_excluded_idx", T.ArrayType(T.IntegerType())),
    T.StructField("ica_excluded_labels", T.ArrayType(T.StringType())),
    T.StructField("autoreject_used", T.BooleanType()), T.StructField("threshold_uv_median", T.DoubleType()),
    T.StructField("viable", T.BooleanType()), T.StructField("base_viable", T.BooleanType()),
    T.StructField("decode_viable", T.BooleanType()),
])


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths under a root; the file contents are pruned from the scan."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(root).select("path"))


def recording_catalog(paths: DataFrame, path: str = "path", subject_re: str = SUBJECT_PATTERN,
                      condition_re: str = CONDITION_PATTERN, strip_re: str = CONDITION_STRIP) -> DataFrame:
    """(subject_id, condition, path); the last path wins when two files claim one recording."""
    subject = F.regexp_extract(path, subject_re, 1)
    raw = F.regexp_extract(path, condition_re, 1)
    return (paths.select(subject.alias("subject_id"), F.regexp_replace(raw, strip_re, "").alias("condition"),
                         F.col(path).alias("path"), raw.alias("raw"))
            .where((F.col("subject_id") != "") & (F.col("raw") != ""))
            .groupBy("subject_id", "condition").agg(F.max("path").alias("path")))


def match_longest_suffix(df: DataFrame, name: str, conditions: list[str]) -> DataFrame:
    """Split ``<subject>_<condition>``; the longest matching condition wins, NULL when none does.

    The condition list is configuration, so the match is one row-local expression: no join.
    """
    by_length = sorted(set(conditions), key=lambda c: (-len(c), c))
    cond = F.coalesce(*[F.when(F.endswith(F.col(name), F.lit("_" + c)), F.lit(c)) for c in by_length])
    tagged = df.withColumn("condition", cond)
    cut = F.length(F.col(name)) - F.length("condition") - 1
    return tagged.withColumn("subject_id", F.when(F.col("condition").isNotNull(),
                                                  F.substring(F.col(name), F.lit(1), cut)))


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(require_columns(spark.read.parquet(path), ["subject_id", "condition", "channel", "t", "value"]))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["subject_id", "condition", "epoch_id", "channel", "x"])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               required: list[str] | None = None) -> DataFrame:
    """Stage table from Parquet, or from CSV with an explicit schema."""
    if path.rstrip("/").endswith(".csv") or schema is not None:
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        df = spark.read.parquet(path)
    return nan_to_null(require_columns(df, required or []))


def read_sheet(spark: SparkSession, book: str, schema: T.StructType | str | None = None,
               required: list[str] | None = None, preferred: str = "Features") -> DataFrame:
    """A workbook exported as one folder of sheets: the preferred sheet, else the first by name."""
    sheets = children(spark, book)
    if not sheets:
        raise FileNotFoundError(f"no sheets in {book}")
    chosen = next((s for s in sheets if s.split(".")[0] == preferred), sheets[0])
    return read_table(spark, f"{book.rstrip('/')}/{chosen}", schema, required)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Optional input: an absent path gives an empty frame of the right type."""
    try:
        return read_table(spark, path, schema if path.rstrip("/").endswith(".csv") else None)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_qc(spark: SparkSession, path: str) -> DataFrame:
    """Ragged QC records: absent keys become NULL."""
    return spark.read.json(path, schema=QC_SCHEMA, multiLine=True)


def latest_run(runs: DataFrame, keys: list[str], run: str = "run_ts", pattern: str = RUN_PATTERN) -> DataFrame:
    """Newest well-formed run per key; run names sort by time."""
    return runs.where(F.col(run).rlike(pattern)).groupBy(*keys).agg(F.max(run).alias(run))


def pinned_or_latest(runs: DataFrame, pins: DataFrame, keys: list[str], run: str = "run_ts",
                     pin: str = "pinned", pattern: str = RUN_PATTERN) -> DataFrame:
    """The recorded upstream run when it still exists, else the newest one: one aggregate."""
    joined = runs.join(pins, keys, "left")
    return (joined.groupBy(*keys)
            .agg(F.max(pin).alias(pin),
                 F.max(F.when(F.col(run) == F.col(pin), F.col(run))).alias("__kept"),
                 F.max(F.when(F.col(run).rlike(pattern), F.col(run))).alias("latest"))
            .select(*keys, pin, "latest", F.coalesce("__kept", "latest").alias("resolved")))


def write_run(df: DataFrame, root: str, name: str, run_ts: str, fmt: str = "parquet") -> str:
    """Write one output table of a run under ``root/name/run_ts=...``."""
    target = os.path.join(root, name, f"run_ts={run_ts}")
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(target)
    return target


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Newest run of a table; the filter prunes partitions before the scan."""
    table = spark.read.option("basePath", os.path.join(root, name)).parquet(os.path.join(root, name))
    newest = table.where(F.col("run_ts").cast("string").rlike(RUN_PATTERN)).agg(F.max("run_ts").alias("r"))
    return table.where(F.col("run_ts") == newest.scalar())


def run_counts(df: DataFrame, stage: str | Column, subject: str, when: str) -> DataFrame:
    """Lineage row per stage: rows, subjects, first and last input seen."""
    key = F.col(stage) if isinstance(stage, str) else stage
    return (df.groupBy(key.alias("stage"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(subject).alias("n_subjects"),
                 F.min(when).alias("first_input"), F.max(when).alias("last_input")))


def lineage_row(df: DataFrame, stage: str, consumed: str, outputs: list[str], subject: str) -> DataFrame:
    """Run-log row: what was read, how much, what was written, when."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(subject).alias("n_subjects")).select(
        F.lit(stage).alias("stage"), F.lit(consumed).alias("consumed"), "n_rows", "n_subjects",
        F.array(*[F.lit(o) for o in outputs]).alias("outputs"), F.current_timestamp().alias("written_at"))


def qc_rollup(qc: DataFrame) -> DataFrame:
    """Counts by kind, status and viability in one pass."""
    emotion = F.coalesce(F.col("kind") == "emotion", F.lit(False))
    error = F.contains(F.coalesce("status", F.lit("")), F.lit("ERROR"))
    return qc.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(~emotion & (F.col("status") == "OK")).alias("n_ok"),
        F.count_if(~emotion & (F.col("status") == "LOW_EPOCH_COUNT")).alias("n_low_epoch"),
        F.count_if(error).alias("n_errors"),
        F.count_if(emotion).alias("n_emotion"),
        F.count_if(emotion & F.col("viable")).alias("n_emotion_viable"),
        F.count_if(emotion & F.col("base_viable")).alias("n_emotion_base_viable"),
        F.count_if(emotion & F.col("decode_viable")).alias("n_emotion_decode_viable"))


def quarantine_status(rules: dict[str, Column]) -> Column:
    """'OK' or 'ERROR: <first broken rule>'; a NULL check counts as broken."""
    status = F.lit("OK")
    for name, ok in reversed(list(rules.items())):
        status = F.when(F.coalesce(ok, F.lit(False)), status).otherwise(F.lit(f"ERROR: {name}"))
    return status


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the quarantined rest with its reason; nothing is lost."""
    tagged = df.withColumn("status", quarantine_status(rules))
    return tagged.where(F.col("status") == "OK"), tagged.where(F.col("status") != "OK")
