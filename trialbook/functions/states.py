"""Decision tables of a job: scheduler state, final state, bootstrap validation, environment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINAL_FAILURES = ("FAILED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL", "CANCELLED")
RUN_MODES = ("single", "array", "seq")
_ALIVE = ("COMPLETED", "RUNNING", "COMPLETING", "CONFIGURING")


def final_state(state: Column, code: Column, line: Column) -> Column:
    """struct(status, fail_reason, scheduler_state, notification, shown, bad_code) from the scheduler's state, the exit code as
    text or number, and the line of a script error.  The first rule that matches decides; an unreadable code
    counts as a failure and sets ``bad_code``.  ``shown`` is the STATE that a failure's notification tells."""
    n = code.try_cast("int")
    said = F.coalesce(state, F.lit(""))
    code_text = F.coalesce(code.cast("string"), F.lit(""))
    line_text = F.coalesce(line.cast("string"), F.lit("unknown"))
    ok = F.coalesce(n == 0, F.lit(False))
    unknown = said.isin("UNKNOWN", "")
    alive = said.isin(*_ALIVE)

    def row(status: str, reason: Column | None, note: str, shown: Column | None = None, extra: str | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(status).alias("status"), (nothing if reason is None else reason).alias("fail_reason"), F.lit(extra).cast("string").alias("scheduler_state"),
            F.lit(note).alias("notification"), (nothing if shown is None else shown).alias("shown"), n.isNull().alias("bad_code"),
        )

    nonzero = F.concat(F.lit("NONZERO_EXIT_"), code_text)
    told = lambda more: F.concat(F.lit("NONZERO_EXIT (code "), code_text, F.lit(more + ")"))
    script = F.concat(F.lit("SCRIPT_ERROR_LINE_"), line_text, F.lit("_CODE_"), code_text)
    script_told = F.concat(F.lit("SCRIPT_ERROR (line "), line_text, F.lit(", code "), code_text, F.lit(", state "), said, F.lit(")"))
    return (
        F.when(said == "TIMEOUT", row("TIMEOUT", F.lit("SLURM_TIMEOUT"), "fail", F.lit("TIMEOUT")))
        .when(said == "OUT_OF_MEMORY", row("OUT_OF_MEMORY", F.lit("OUT_OF_MEMORY"), "fail", F.lit("OUT_OF_MEMORY")))
        .when(F.startswith(said, F.lit("CANCELLED")), row("CANCELLED", F.lit("CANCELLED"), "fail_fast", F.lit("CANCELLED")))
        .when(said == "NODE_FAIL", row("NODE_FAIL", F.lit("NODE_FAIL"), "fail", F.lit("NODE_FAIL")))
        .when(alive & ok, row("COMPLETED", None, "finish"))
        .when(alive, row("FAILED", nonzero, "fail", told("")))
        .when(unknown & ok, row("COMPLETED", None, "finish", None, "UNKNOWN"))
        .when(unknown, row("FAILED", F.concat(nonzero, F.lit("_SCHEDULER_STATE_UNKNOWN")), "fail", told("; scheduler state unknown"), "UNKNOWN"))
        .otherwise(row("FAILED", script, "fail", script_told))
    )


def scheduler_state(scheduler: Column, has_tool: Column, output: Column, comment: Column, exit_status: Column, accounting: Column, control: Column) -> Column:
    """The state as the scheduler's tools report it.

    ``output``, ``comment`` and ``exit_status`` are PBS's; ``accounting`` and ``control`` are Slurm's two sources, tried in turn.
    """
    comment = F.coalesce(comment, F.lit(""))
    pbs = (
        F.when(~F.coalesce(has_tool, F.lit(False)), "UNKNOWN")
        .when(F.coalesce(output, F.lit("")) == "", "COMPLETED")
        .when(comment.rlike("(?i)walltime"), "TIMEOUT")
        .when(comment.rlike("(?i)oom|out of memory"), "OUT_OF_MEMORY")
        .when(exit_status == "271", "TIMEOUT")
        .when(exit_status == "137", "OUT_OF_MEMORY")
        .when(F.coalesce(exit_status, F.lit("")).isin("0", ""), "COMPLETED")
        .otherwise("FAILED")
    )
    slurm = F.coalesce(F.nullif(accounting, F.lit("")), F.nullif(F.regexp_extract(F.coalesce(control, F.lit("")), r"JobState=(\w+)", 1), F.lit("")), F.lit("UNKNOWN"))
    return F.when(scheduler == "local", "COMPLETED").when(scheduler == "pbs", pbs).otherwise(slurm)


def pbs_field(output: Column, field: str) -> Column:
    """A ``field = value`` line of a full PBS job report; null without one."""
    return F.nullif(F.trim(F.regexp_extract(output, rf"(?m)^\s*{field}\s*=\s*(.*)$", 1)), F.lit(""))


def is_terminal_failure(status: Column) -> Column:
    """Never null: a record without a status is no failure."""
    return F.coalesce(status, F.lit("")).isin(*TERMINAL_FAILURES)


def run_mode_ok(mode: Column) -> Column:
    return F.coalesce(mode, F.lit("")).isin(*RUN_MODES)


def bootstrap_reason(project_root: Column, exp_name: Column, run_mode: Column, log_dir_ok: Column, link_ok: Column, helper_ok: Column, time_limit: Column, metadata_ok: Column) -> Column:
    """Reason of the first bootstrap check that fails; null if all hold."""
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(absent(project_root), "MISSING_PROJECT_ROOT")
        .when(absent(exp_name), "MISSING_EXP_NAME")
        .when(~run_mode_ok(run_mode), "INVALID_RUN_MODE")
        .when(no(log_dir_ok), "LOG_DIRECTORY_CREATION_FAILED")
        .when(no(link_ok), "LATEST_LOG_LINK_FAILED")
        .when(no(helper_ok), "NOTIFICATION_HELPER_LOAD_FAILED")
        .when(absent(time_limit), "MISSING_TIME_LIMIT")
        .when(no(metadata_ok), "METADATA_INITIALIZATION_FAILED")
    )


def leaves_record(reason: Column) -> Column:
    """Only failures after the log directory exists can be recorded."""
    return ~reason.isin("MISSING_PROJECT_ROOT", "MISSING_EXP_NAME", "INVALID_RUN_MODE", "LOG_DIRECTORY_CREATION_FAILED")


def job_environment(env: Column) -> Column:
    """struct(scheduler, job_id, array_job_id, task_id, partition, node) from a map of environment variables; PBS comes before Slurm, then local.

    Array ids are empty outside arrays.  A PBS id keeps its index (``12[3]``) but for the array's own id.  A local
    job's id is its process (variable ``PID``).
    """
    get = lambda k: F.nullif(F.try_element_at(env, F.lit(k)), F.lit(""))
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    pbs, slurm, index, host = get("PBS_JOBID"), get("SLURM_JOB_ID"), get("PBS_ARRAY_INDEX"), known(get("HOSTNAME"))
    short = F.substring_index(pbs, ".", 1)
    kinds = F.when(pbs.isNotNull(), "pbs").when(slurm.isNotNull(), "slurm").otherwise("local")
    pick = lambda a, b, c: F.when(pbs.isNotNull(), a).when(slurm.isNotNull(), b).otherwise(c)
    return F.struct(
        kinds.alias("scheduler"),
        pick(short, slurm, F.coalesce(get("PID"), F.lit("local"))).alias("job_id"),
        pick(F.when(index.isNotNull(), F.substring_index(short, "[", 1)).otherwise(""), empty(get("SLURM_ARRAY_JOB_ID")), F.lit("")).alias("array_job_id"),
        pick(empty(index), empty(get("SLURM_ARRAY_TASK_ID")), F.lit("")).alias("task_id"),
        pick(known(get("PBS_QUEUE")), known(get("SLURM_JOB_PARTITION")), F.lit("local")).alias("partition"),
        pick(host, known(get("SLURMD_NODENAME")), host).alias("node"),
    )


def recorded_job_id(env: Column) -> Column:
    """The id that a variant records: Slurm before PBS here, empty without either."""
    get = lambda k: F.nullif(F.try_element_at(env, F.lit(k)), F.lit(""))
    return F.coalesce(get("SLURM_JOB_ID"), get("PBS_JOBID"), F.lit(""))
