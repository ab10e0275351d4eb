"""Tables of a workspace: experiments, variants, runs, scripts, logs and scheduler snapshots.

Whole small files are read as text and taken apart by SQL functions, so ids like 0010 and limits like 196:00:00 stay
text.  Path globs bound what is listed; ``latest`` pointers, which globs follow, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, states, texts
from ..operators import catalog
from .listing import listing


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text, mtime) of the files that match; none is an empty table."""
    schema = "value string"
    files = spark.read.schema(schema).option("ignoreMissingFiles", "true")
    try:
        found = files.text(glob, wholetext=True)
    except Exception as e:  # an empty match is an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, text string, mtime timestamp")
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))


def _level(up: int) -> Column:
    """A directory's name, counted from the file upwards."""
    return F.url_decode(F.try_element_at(F.split("path", "/"), F.lit(-1 - up)))


def experiment_dirs(spark: SparkSession, root: str) -> DataFrame:
    dirs = listing(spark, f"{root}/experiments").filter("is_dir").select(F.col("name").alias("exp_name"), "path", "mtime")
    return catalog.experiments(dirs)


def experiments(spark: SparkSession, root: str) -> DataFrame:
    """Experiment records; the directory's name is the key, an experiment without a record is kept."""
    fields = ("exp_id", "created_date", "git_commit", "resumed_from_exp", "resume_checkpoint_dir", "resume_checkpoint_file")
    records = whole_files(spark, f"{root}/experiments/*/metadata.yaml").select(_level(1).alias("exp_name"), texts.yaml_map(F.col("text")).alias("m")).filter("exp_name <> 'latest'")
    records = records.select("exp_name", *[F.try_element_at("m", F.lit(k)).alias(k) for k in fields])
    dirs = experiment_dirs(spark, root).select("exp_name", "exp_no", "overflow")
    return dirs.join(records, "exp_name", "left").withColumn("created_date", F.try_to_timestamp("created_date", F.lit("yyyyMMdd")).cast("date"))


def variants(spark: SparkSession, root: str) -> DataFrame:
    """Completion records, exactly one level of variants deep; one that does not parse is ``corrupt``."""
    m = texts.json_map(F.col("text"))
    at = whole_files(spark, f"{root}/outputs/*/*/completion.json").select(_level(2).alias("exp_name"), _level(1).alias("variant_key"), m.alias("m")).filter("exp_name <> 'latest'")
    fixed = ("job_id", "array_task_id", "started_at", "completed_at", "guard_skipped_at", "status")
    moment = lambda k: F.try_to_timestamp(F.try_element_at("m", F.lit(k))).cast("timestamp_ntz").alias(k)
    value = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return at.select("exp_name", "variant_key", *[moment(k) if k.endswith("_at") else value(k) for k in fixed], F.map_filter("m", lambda k, _: ~k.isin(*fixed)).alias("extra"), F.col("m").isNull().alias("corrupt"))


def runs(spark: SparkSession, root: str) -> DataFrame:
    fields = ("job_id", "partition", "node", "git_commit", "time_limit", "run_mode", "array_task_id", "status", "fail_reason", "scheduler_state", "cancel_reason", "cancelled_by", "failure_phase")
    at = whole_files(spark, f"{root}/logs/*/*/run_metadata.yaml").select(_level(2).alias("exp_name"), _level(1).alias("job_dir"), texts.yaml_map(F.col("text")).alias("m"), "mtime")
    return at.filter("job_dir <> 'latest'").select("exp_name", "job_dir", *[F.try_element_at("m", F.lit(k)).alias(k) for k in fields], "mtime")


def log_dirs(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, f"{root}/logs").filter("is_dir").select(F.col("name").alias("exp_name"))


def loose_logs(spark: SparkSession, root: str) -> DataFrame:
    at = listing(spark, f"{root}/logs", depth=2).filter("not is_dir")
    return at.select(F.element_at(F.split("path", "/"), -2).alias("exp_name"), F.col("name").alias("file")).filter(F.col("file").rlike(r"_.*\.out$|^watcher_.*\.log$"))


def checkable(spark: SparkSession, root: str) -> DataFrame:
    """exp_name with the texts of run script, program and configuration (null where a file is missing)."""
    out = experiment_dirs(spark, root).select("exp_name")
    for column, file in (("run_slurm", "run_slurm.sh"), ("experiment_py", "experiment.py"), ("config_yml", "config.yml")):
        out = out.join(whole_files(spark, f"{root}/experiments/*/{file}").select(_level(1).alias("exp_name"), F.col("text").alias(column)), "exp_name", "left")
    return out


def configs(spark: SparkSession, root: str) -> DataFrame:
    """Flat configurations as maps; an experiment without one has an empty map, and seed defaults to 42."""
    out = checkable(spark, root).select("exp_name", texts.yaml_map(F.col("config_yml")).alias("config"))
    return out.withColumn("seed", F.coalesce(F.try_element_at("config", F.lit("seed")).try_cast("int"), F.lit(42)))


def time_limits(spark: SparkSession, root: str) -> DataFrame:
    return checkable(spark, root).select("exp_name", texts.time_directive(F.col("run_slurm")).alias("time_limit"))


def commands(spark: SparkSession, root: str) -> DataFrame:
    """Resolved commands, one row per line."""
    at = whole_files(spark, f"{root}/logs/*/*/command.sh").select(_level(2).alias("exp_name"), _level(1).alias("job_dir"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line", "command"))
    return at.filter("job_dir <> 'latest'")


def failures(spark: SparkSession, root: str) -> DataFrame:
    m = texts.yaml_map(F.regexp_replace("text", r"(?m)^([A-Za-z_]+)\s*:\s*", "$1: "))
    at = whole_files(spark, f"{root}/experiments/*/FAILED_REASON.txt").select(_level(1).alias("exp_name"), m.alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return at.select("exp_name", F.try_to_timestamp(get("failed_at")).cast("timestamp_ntz").alias("failed_at"), get("reason").alias("reason"), get("original_experiment").alias("original_experiment"))


def accounting(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of Slurm accounting: JobIDRaw|State."""
    return spark.read.schema("JobIDRaw string, State string").csv(path, sep="|", header=True)


def pbs_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Full PBS job reports, one per file: output, comment, exit_status and the state they mean."""
    text = F.col("text")
    at = whole_files(spark, glob).select("path", text.alias("output"), states.pbs_field(text, "comment").alias("comment"), states.pbs_field(text, "Exit_status").alias("exit_status"))
    nothing = F.lit(None).cast("string")
    return at.withColumn("state", states.scheduler_state(F.lit("pbs"), F.lit(True), F.col("output"), F.col("comment"), F.col("exit_status"), nothing, nothing))


def templates(spark: SparkSession, root: str) -> DataFrame:
    """Templates and, below them, header files: (file, text)."""
    found = whole_files(spark, f"{root}/templates/*.*").unionByName(whole_files(spark, f"{root}/templates/headers/*.*"))
    return found.select(F.regexp_extract("path", r"/templates/(.*)$", 1).alias("file"), "text")


def table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A Parquet, ORC, CSV or JSON table by its suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        options = {"header": "true"} | options
    return spark.read.options(**options).format(kind if kind in ("orc", "csv", "json") else "parquet").load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A table in one atomic commit; CSV has a header."""
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", "true") if kind == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Signals, bootstrap and finalization failures, notifications: append-only."""
    write_table(df, path, "json", "append")


def kept_key(requested: DataFrame) -> DataFrame:
    """Requested variants under their clean key; the raw one stays beside it where it differs."""
    clean = names.variant_key(F.col("variant_key"))
    return requested.withColumn("variant_key_raw", F.when(clean != F.col("variant_key"), F.col("variant_key"))).withColumn("variant_key", clean)
