"""What a clean-up of logs would delete or move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, states, times
from ..operators import catalog


def classified(runs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Runs with action and reason: failed runs go, then running ones not touched for ``hours``; others stay.

    ``within_time_limit`` tells of a hung run whose own limit (column time_limit, if there) has not passed yet.
    """
    at = runs.filter("job_dir <> 'latest'")
    hung = (F.col("status") == "RUNNING") & times.older_than(F.col("mtime"), as_of, hours)
    reason = F.when(states.is_terminal_failure(F.col("status")), "FAILED_RUN").when(F.coalesce(hung, F.lit(False)), "HUNG_RUN")
    at = at.withColumn("reason", reason).withColumn("action", F.when(reason.isNull(), "keep").otherwise("delete"))
    if "time_limit" in runs.columns:
        at = at.withColumn("within_time_limit", F.timestamp_add("SECOND", times.seconds(F.col("time_limit")), F.col("mtime")) > as_of)
    return at


def failed_logs(runs: DataFrame, log_dirs: DataFrame, exps: DataFrame, as_of: Column) -> DataFrame:
    """cleanup_plan(path, level, reason): job directories first, then log directories without an experiment."""
    jobs = classified(runs, as_of).filter("action = 'delete'").select(F.concat_ws("/", F.lit("logs"), "exp_name", "job_dir").alias("path"), F.lit("job").alias("level"), "reason")
    gone = catalog.orphans(log_dirs, exps).select(F.concat_ws("/", F.lit("logs"), "exp_name").alias("path"), F.lit("experiment").alias("level"), F.lit("ORPHANED_LOGS").alias("reason"))
    return jobs.unionByName(gone)


def tidied_logs(files: DataFrame) -> DataFrame:
    """Loose log files (exp_name, file) -> where each would move; ``collides`` marks those that share a place."""
    file = F.col("file")
    loose = files.filter(file.rlike(r"^.*_.*\.out$|^watcher_.*\.log$"))
    kind = F.when(F.startswith(file, F.lit("watcher_")), "watcher.log").otherwise("slurm.out")
    plan = loose.select("exp_name", file.alias("src"), F.concat_ws("/", "exp_name", names.job_of_log(file), kind).alias("dst"))
    shared = plan.groupBy("dst").agg(F.count(F.lit(1)).alias("_n"))
    return plan.join(shared, "dst").select("exp_name", "src", "dst", (F.col("_n") > 1).alias("collides"))


def scheduler_logs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(exp_name, scheduler, run_mode, job_id, array_job_id, task_id, job_dir) and output files (exp_name, file) -> planned moves (src, dst).

    Slurm's file has the run's ids and experiment in its name.  PBS's files begin with the experiment, ``.o`` or ``.e``, and the
    run's ids; the first by name that does is taken.
    """
    ids = F.when(F.col("run_mode") == "array", F.concat(F.col("array_job_id"), F.when(F.col("scheduler") == "pbs", "-").otherwise("_"), F.col("task_id"))).otherwise(F.col("job_id"))
    at = runs.filter("scheduler in ('pbs', 'slurm')").select("exp_name", "job_dir", "scheduler", ids.alias("ids"))
    slurm = at.filter("scheduler = 'slurm'").select("exp_name", "job_dir", F.concat("ids", F.lit("_"), "exp_name", F.lit(".out")).alias("file"), F.lit("slurm.out").alias("kind"))
    slurm = slurm.join(files.select("exp_name", "file").distinct(), ["exp_name", "file"])
    # What follows .o or .e in a file's name is short: all its beginnings meet the runs' ids.
    tail = F.regexp_extract("file", r"\.[oe](\d[^/]*)$", 1)
    own = files.filter((tail != "") & F.startswith("file", F.concat("exp_name", F.lit(".")))).select("exp_name", "file", F.regexp_extract("file", r"\.([oe])\d[^/]*$", 1).alias("stream"), tail.alias("_tail"))
    own = own.filter(F.col("file") == F.concat_ws(".", "exp_name", F.concat("stream", "_tail")))
    heads = own.select("exp_name", "file", "stream", F.explode(F.transform(F.sequence(F.lit(1), F.length("_tail")), lambda n: F.substring("_tail", F.lit(1), n))).alias("ids"))
    pbs = at.filter("scheduler = 'pbs'").join(heads, ["exp_name", "ids"])
    pbs = pbs.groupBy("exp_name", "job_dir", "stream").agg(F.min("file").alias("file")).select("exp_name", "job_dir", "file", F.when(F.col("stream") == "o", "slurm.out").otherwise("pbs.err").alias("kind"))
    found = slurm.select("exp_name", "job_dir", "file", "kind").unionByName(pbs)
    return found.select("exp_name", "job_dir", F.concat_ws("/", F.lit("logs"), "exp_name", "file").alias("src"), F.concat_ws("/", F.lit("logs"), "exp_name", "job_dir", "kind").alias("dst"))
