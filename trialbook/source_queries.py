"""Readers of small files, sinks and streams as queries, each with the SQL it must equal.

The files are a workspace made of the suppliers, one experiment each, written to a scratch folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import names, texts
from .plans import preflight
from .registry import query, read
from .sources import scratch, workspace
from .streaming import runs as stream

_ROOTS: dict[tuple[str, str], str] = {}


def _name():
    k = F.col("s_suppkey")
    return F.when(k % 7 == 0, F.concat(F.lit("note"), k.cast("string"))).otherwise(names.compose(names.padded(k), F.lit("20260101"), F.lit("x")))


_NAMES_SQL = "(SELECT *, s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'note' || s_suppkey ELSE printf('%04d', CAST(s_suppkey AS BIGINT)) || '_20260101_x' END AS n FROM supplier)"


def _workspace(spark, d) -> str:
    """URI of the workspace, written once a session and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ROOTS:
        uri = scratch.folder(spark, "workspace")
        k, n = F.col("s_suppkey"), _name()
        id_ = k.cast("string")
        record = texts.flat_yaml({"exp_id": names.padded(k), "exp_name": n, "created_date": F.lit("20260101"), "git_commit": F.lit("abc"), "resumed_from_exp": F.when(k % 2 == 0, "old")})
        run = F.concat(F.lit("job_id: "), id_, F.lit("\ntime_limit: 196:00:00\nstatus: "), F.when(k % 3 == 0, "'FAILED'").when(k % 3 == 1, '"RUNNING"').otherwise("COMPLETED"), F.lit("\n"))
        done = F.when(k % 4 == 0, "{").otherwise(F.concat(F.lit('{\n  "status": "completed",\n  "started_at": "2026-01-01T00:00:00",\n  "lr": "'), id_, F.lit('"\n}')))
        files = [
            ("experiments/{}/metadata.yaml", F.when(k % 5 > 0, record)),
            ("experiments/{}/config.yml", F.when(k % 2 == 0, F.concat(F.lit("lr: 0.1\nseed: "), id_, F.lit("\n"))).otherwise("lr: 0.1\n")),
            ("experiments/{}/run_slurm.sh", F.concat(F.lit("#!/bin/bash\n#SBATCH --time="), names.padded(k % 90 + 10, 2), F.lit(":00:00\n"))),
            ("experiments/{}/experiment.py", F.when(k % 3 == 0, "x = config['missing']\n").otherwise("x = config['lr']\n")),
            ("experiments/{}/FAILED_REASON.txt", F.when(k % 6 == 0, F.concat(F.lit("failed_at: 2026-01-02 03:04:05\nreason: r"), id_, F.lit("\noriginal_experiment: o"), id_, F.lit("\n")))),
            ("logs/{}/7_0/run_metadata.yaml", run),
            ("logs/{}/7_0/command.sh", F.concat(F.lit("python a.py "), id_, F.lit("\n\npython b.py\n"))),
            ("logs/{}/9_exp.out", F.when(k % 2 == 0, "x")),
            ("logs/{}/other.txt", F.lit("x")),
            ("outputs/{}/v1/completion.json", done),
            ("outputs/{}/v1/deep/completion.json", F.lit("{}")),
        ]
        rows = F.array_compact(F.array(*[F.when(text.isNotNull(), F.struct(F.concat(F.lit(path.split("{}")[0]), n, F.lit(path.split("{}")[1])).alias("path"), text.alias("text"))) for path, text in files]))
        reports = F.struct(F.concat(F.lit("reports/"), id_, F.lit(".txt")).alias("path"), F.concat(F.lit("Job Id: "), id_, F.lit("\n    comment = "), F.when(k % 3 == 0, "Job killed: walltime").otherwise("ok"), F.lit("\n    Exit_status = "), F.when(k % 3 == 1, "137").otherwise("0"), F.lit("\n")).alias("text"))
        suppliers = read(spark, d, "supplier")
        scratch.write_files(suppliers.select(F.explode(F.concat(rows, F.array(reports))).alias("f")).select("f.*"), uri)
        fixed = [("templates/run.sh", "#SBATCH --time=01:00:00\n"), ("templates/headers/gpu.txt", "#PBS -q gpu\n"), ("accounting.txt", "JobIDRaw|State\n1|COMPLETED\n1.batch|FAILED\n")]
        scratch.write_files(spark.createDataFrame(fixed, "path string, text string"), uri)
        _ROOTS[key] = uri
    return _ROOTS[key]


@query(f"SELECT n AS exp_name, CAST(k AS INTEGER) AS exp_no, CASE WHEN k % 5 > 0 THEN printf('%04d', CAST(k AS BIGINT)) END AS exp_id, CASE WHEN k % 5 > 0 THEN DATE '2026-01-01' END AS created_date, CASE WHEN k % 5 > 0 AND k % 2 = 0 THEN 'old' END AS resumed_from_exp FROM {_NAMES_SQL} WHERE k % 7 > 0")
def q_read_experiments(spark, d):
    return workspace.experiments(spark, _workspace(spark, d)).select("exp_name", "exp_no", "exp_id", "created_date", "resumed_from_exp")


@query(f"SELECT n AS exp_name, '7_0' AS job_dir, CAST(k AS VARCHAR) AS job_id, '196:00:00' AS time_limit, ['FAILED', 'RUNNING', 'COMPLETED'][k % 3 + 1] AS status FROM {_NAMES_SQL}")
def q_read_runs(spark, d):
    return workspace.runs(spark, _workspace(spark, d)).select("exp_name", "job_dir", "job_id", "time_limit", "status")


@query(f"SELECT n AS exp_name FROM {_NAMES_SQL}")
def q_read_log_dirs(spark, d):
    return workspace.log_dirs(spark, _workspace(spark, d))


@query(f"SELECT n AS exp_name, '9_exp.out' AS file FROM {_NAMES_SQL} WHERE k % 2 = 0")
def q_read_loose_logs(spark, d):
    return workspace.loose_logs(spark, _workspace(spark, d))


@query(f"SELECT n AS exp_name, 'v1' AS variant_key, CASE WHEN k % 4 > 0 THEN 'completed' END AS status, CASE WHEN k % 4 > 0 THEN TIMESTAMP '2026-01-01 00:00:00' END AS started_at, CASE WHEN k % 4 > 0 THEN CAST(k AS VARCHAR) END AS lr, k % 4 = 0 AS corrupt FROM {_NAMES_SQL}")
def q_read_variants(spark, d):
    return workspace.variants(spark, _workspace(spark, d)).select("exp_name", "variant_key", "status", "started_at", F.try_element_at("extra", F.lit("lr")).alias("lr"), "corrupt")


@query(f"SELECT n AS exp_name, '0.1' AS lr, CAST(CASE WHEN k % 2 = 0 THEN k ELSE 42 END AS INTEGER) AS seed, printf('%02d', CAST(k % 90 + 10 AS BIGINT)) || ':00:00' AS time_limit FROM {_NAMES_SQL} WHERE k % 7 > 0")
def q_read_configs(spark, d):
    root = _workspace(spark, d)
    return workspace.configs(spark, root).join(workspace.time_limits(spark, root), "exp_name").select("exp_name", F.try_element_at("config", F.lit("lr")).alias("lr"), "seed", "time_limit")


@query(f"SELECT n AS exp_name, '7_0' AS job_dir, CAST(i AS INTEGER) AS line, CASE i WHEN 0 THEN 'python a.py ' || k ELSE 'python b.py' END AS command FROM {_NAMES_SQL}, range(2) r(i)")
def q_read_commands(spark, d):
    return workspace.commands(spark, _workspace(spark, d))


@query(f"SELECT n AS exp_name, TIMESTAMP '2026-01-02 03:04:05' AS failed_at, 'r' || k AS reason, 'o' || k AS original_experiment FROM {_NAMES_SQL} WHERE k % 6 = 0")
def q_read_failures(spark, d):
    return workspace.failures(spark, _workspace(spark, d))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'OUT_OF_MEMORY' ELSE 'COMPLETED' END AS state, CASE s_suppkey % 3 WHEN 1 THEN '137' ELSE '0' END AS exit_status FROM supplier")
def q_read_pbs_reports(spark, d):
    return workspace.pbs_reports(spark, f"{_workspace(spark, d)}/reports/*.txt").select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("s_suppkey"), "state", "exit_status")


@query("SELECT '1' AS \"JobIDRaw\", 'COMPLETED' AS \"State\" UNION ALL SELECT '1.batch', 'FAILED'")
def q_read_accounting(spark, d):
    return workspace.accounting(spark, f"{_workspace(spark, d)}/accounting.txt")


@query("SELECT 'run.sh' AS file, '#SBATCH --time=01:00:00' || chr(10) AS text UNION ALL SELECT 'headers/gpu.txt', '#PBS -q gpu' || chr(10)")
def q_read_templates(spark, d):
    return workspace.templates(spark, _workspace(spark, d))


@query(f"SELECT n AS exp_name, k % 3 > 0 AS passes FROM {_NAMES_SQL} WHERE k % 7 > 0")
def q_check_files(spark, d):
    return preflight.verdicts(workspace.checkable(spark, _workspace(spark, d))).select("exp_name", "passes")


def _sink(kind: str, sql: str):
    def run(spark, d):
        uri = f"{scratch.folder(spark, 'table')}/t.{kind}"
        workspace.write_table(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), uri, kind)
        return workspace.table(spark, uri).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")

    run.__name__ = f"q_write_{kind}"
    return query(sql)(run)


for _kind in ("parquet", "orc", "csv", "json"):
    _sink(_kind, "SELECT c_custkey, c_name, c_mktsegment FROM customer")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer")
def q_append_events(spark, d):
    uri = f"{scratch.folder(spark, 'events')}/e.json"
    rows = read(spark, d, "customer").select("c_custkey", "c_name")
    for _ in range(2):
        workspace.append_events(rows, uri)
    return workspace.table(spark, uri)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _streamed(spark, d, build, mode: str):
    """The rows of a stream over the events, run until all are read.

    Executors write each batch to a folder of its own, which a repeated batch replaces; no row passes the driver.
    """
    source = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out, rows = scratch.folder(spark, "stream"), build(source)
    spark.createDataFrame([], rows.schema).write.parquet(f"{out}/none")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = scratch.folder(spark, "stream-state")
        write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/{k}")
        rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(rows.schema).parquet(f"{out}/*")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def q_stream_states(spark, d):
    states = lambda e: stream.states(e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")), hours=None)
    out = _streamed(spark, d, states, "update")
    return out.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


@query("SELECT DISTINCT user_id AS exp_name, event_type AS variant_key FROM events")
def q_stream_submissions(spark, d):
    first = lambda e: stream.submissions(e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("exp_name"), F.col("event_type").alias("variant_key")), "60 days")
    return _streamed(spark, d, first, "append").select("exp_name", "variant_key")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN event_id % 2 = 1 THEN 'NONZERO_EXIT_1' END AS fail_reason FROM events")
def q_stream_final_states(spark, d):
    ended = lambda e: stream.final_states(e.select(F.col("event_id").alias("run_id"), F.lit("RUNNING").alias("state"), (F.col("event_id") % 2).alias("code"), F.lit("end").alias("line")))
    return _streamed(spark, d, ended, "append").select(F.col("run_id").alias("event_id"), "status", "fail_reason")
