"""A job from its environment to its final state, as tables: validate, bind, prepare, classify.  Nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, notices, states, texts
from ..operators import grid, guard


def bound(jobs: DataFrame) -> DataFrame:
    """(exp_name, env, run_mode, ...) with scheduler, ids, partition, node and the log directory of each job."""
    at = jobs.withColumn("e", states.job_environment(F.col("env"))).select(*[c for c in jobs.columns if c != "env"], "e.*")
    return at.withColumn("job_dir", names.job_directory(F.col("run_mode"), F.col("array_job_id"), F.col("task_id"), F.col("job_id")))


def bootstrapped(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs that may start, and failure records (exp_name, job_dir, record) of those that may not and can say so.

    Jobs need project_root, run_mode, log_dir_ok, link_ok, helper_ok, time_limit and metadata_ok beside ``bound``'s columns.
    """
    reason = states.bootstrap_reason(*[F.col(c) for c in ("project_root", "exp_name", "run_mode", "log_dir_ok", "link_ok", "helper_ok", "time_limit", "metadata_ok")])
    at = jobs.withColumn("reason", reason)
    failed = at.filter(F.col("reason").isNotNull() & states.leaves_record(F.col("reason")))
    return at.filter("reason is null").drop("reason"), failed.select("exp_name", "job_dir", guard.bootstrap_record(F.col("reason")).alias("record"))


def commands(jobs: DataFrame, scripts: DataFrame, grids: DataFrame) -> DataFrame:
    """(exp_name, job_dir, line, command): one for single jobs and array tasks, one a combination for sequences.

    ``scripts`` has exp_name, base_command, run_command; an array task without a configuration has a null command.
    """
    configs = grid.expand(grids).select("exp_name", "idx", F.array_join("opts", " ").alias("opts"))
    at = jobs.join(scripts, "exp_name")
    single = at.filter("run_mode = 'single'").select("exp_name", "job_dir", F.lit(0).cast("long").alias("line"), F.col("run_command").alias("command"))
    command = F.when(F.col("opts").isNotNull(), texts.command(F.col("base_command"), F.col("opts")))
    task = at.filter("run_mode = 'array'").withColumn("idx", F.col("task_id").try_cast("long"))
    array = task.join(configs, ["exp_name", "idx"], "left").select("exp_name", "job_dir", F.lit(0).cast("long").alias("line"), command.alias("command"))
    each = at.filter("run_mode = 'seq'").join(configs, "exp_name").select("exp_name", "job_dir", F.col("idx").alias("line"), command.alias("command"))
    return single.unionByName(array).unionByName(each)


def started(jobs: DataFrame) -> DataFrame:
    """The RUNNING record of each job."""
    fields = {c: F.col(c) for c in ("exp_name", "job_id", "partition", "node", "git_commit", "time_limit") if c in jobs.columns}
    return jobs.select("exp_name", "job_dir", guard.run_record(F.col("run_mode"), fields, F.col("task_id")).alias("record"))


def sequence_codes(steps: DataFrame) -> DataFrame:
    """The exit code of each sequence (exp_name, job_dir, idx, code): that of its first failing step, else 0."""
    return guard.first_failure(steps, ["exp_name", "job_dir"])


def finished(jobs: DataFrame) -> DataFrame:
    """(exp_name, job_dir, job_id, state, code, line) -> final status and the notification it would send."""
    at = jobs.withColumn("f", states.final_state(F.col("state"), F.col("code"), F.col("line"))).select(*jobs.columns, "f.*")
    values = {"EXP": F.col("exp_name"), "JOB": F.col("job_id"), "STATE": F.col("shown")}
    body = F.lit(None).cast("string")
    for event in ("finish", "fail", "fail_fast"):
        body = F.when(F.col("notification") == event, notices.payload(event, F.col("job_id"), notices.fields(event, values))).otherwise(body)
    return at.withColumn("payload", body)


def staging(jobs: DataFrame) -> DataFrame:
    """(exp_name, job_id, user, root, local_input, local_output, has_output) -> planned actions around a run on node-local disk.

    Scratch is removed only where it lies below the user's own folder.
    """
    scratch = F.concat(F.lit("/scratch/"), F.coalesce("user", F.lit("")), F.lit("/"), "exp_name", F.lit("_"), "job_id")
    home = F.concat(F.lit("/scratch/"), F.coalesce("user", F.lit("")), F.lit("/"))
    outputs = F.concat_ws("/", "root", F.lit("outputs"), "exp_name")
    nothing = F.lit(None).cast("string")
    step = lambda k, action, src, dst, on: F.when(on, F.struct(F.lit(k).alias("step"), F.lit(action).alias("action"), src.alias("src"), dst.alias("dst")))
    below = F.startswith(scratch, home) & (scratch != home) & (F.coalesce("user", F.lit("")) != "")
    steps = [
        step(0, "mkdir", nothing, scratch, F.lit(True)),
        step(1, "sync", F.concat_ws("/", "root", F.lit("data")), F.concat(scratch, F.lit("/data")), F.col("local_input")),
        step(2, "mkdir", nothing, outputs, F.lit(True)),
        step(3, "mkdir", nothing, F.concat(scratch, F.lit("/outputs")), F.col("local_output")),
        step(4, "sync", F.concat(scratch, F.lit("/outputs/"), "exp_name"), outputs, F.col("local_output") & F.col("has_output")),
        step(5, "delete", scratch, nothing, below),
    ]
    return jobs.select("exp_name", "job_id", F.explode(F.array_compact(F.array(*steps))).alias("p")).select("exp_name", "job_id", "p.*")
