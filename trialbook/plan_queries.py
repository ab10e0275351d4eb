"""Plans, notices and lookups as queries over the benchmark tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import names, notices, texts, times
from .operators import catalog, custom, grid, guard
from .plans import arguments, cleanup, lifecycle, preflight, running
from .registry import query, read
from .streaming import runs as stream


def _union(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EXPS_SQL = "(SELECT s_suppkey, printf('%04d', CAST(s_suppkey AS BIGINT)) || '_20260101_' || CASE s_suppkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'run_retry' ELSE 'run' END || CASE WHEN s_suppkey % 5 = 0 THEN '_FAILED_20260102_oom' ELSE '' END AS n FROM supplier)"


def _exps(spark, d):
    """Suppliers as experiments."""
    k = F.col("s_suppkey")
    label = F.when(k % 4 == 0, "base").when(k % 4 == 1, "run_retry").otherwise("run")
    return read(spark, d, "supplier").select(k, F.concat(names.compose(names.padded(k), F.lit("20260101"), label), F.when(k % 5 == 0, "_FAILED_20260102_oom").otherwise("")).alias("exp_name"))


@query(f"SELECT n AS exp_name, CAST(s_suppkey AS INTEGER) AS exp_no, s_suppkey > 9999 AS overflow FROM {_EXPS_SQL}")
def q_experiments(spark, d):
    other = spark.createDataFrame([("latest",), ("notes",), ("12_short",), ("0012",)], "exp_name string")
    return catalog.experiments(_exps(spark, d).select("exp_name").unionByName(other))


@query(f"SELECT 'id' AS by, n AS exp_name FROM {_EXPS_SQL} WHERE s_suppkey = 7 UNION ALL SELECT 'name', n FROM {_EXPS_SQL} WHERE s_suppkey = 8 UNION ALL SELECT 'part', min(n) FROM {_EXPS_SQL} WHERE contains(n, 'retry') UNION ALL SELECT 'latest', arg_max(n, s_suppkey) FROM {_EXPS_SQL}")
def q_select_one(spark, d):
    exps = _exps(spark, d).select("exp_name")
    said = lambda by, df: df.select(F.lit(by).alias("by"), "exp_name")
    return _union(said("id", catalog.select_one(exps, "7")), said("name", catalog.select_one(exps, "0008_20260101_base")), said("part", catalog.select_one(exps, "retry", loose=True)), said("latest", catalog.select_one(exps, None)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"JobIDRaw\", o_orderpriority AS \"State\" FROM orders WHERE o_orderkey = 12")
def q_accounting(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("JobIDRaw"), F.col("o_orderpriority").alias("State"))
    return catalog.accounting(rows.unionByName(rows.withColumn("JobIDRaw", F.concat("JobIDRaw", F.lit(".batch")))), "12")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS job_id FROM orders WHERE o_orderstatus = 'O'")
def q_active_jobs(spark, d):
    queue = read(spark, d, "orders").select(F.col("o_orderstatus").alias("user"), F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("job_id"))
    return catalog.active_jobs(queue, F.lit("O"))


@query("SELECT c.c_custkey, CAST(c.c_custkey // 2 AS VARCHAR) AS after_job, p.c_name AS after_exp, p.c_mktsegment AS after_status FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 2 WHERE c.c_custkey % 3 > 0")
def q_dependencies(spark, d):
    script = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("#SBATCH --dependency=afterok:"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("\n"))).otherwise("# #SBATCH --dependency=afterok:1\n")
    runs = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("exp_name"), F.col("c_mktsegment").alias("status"), texts.dependency(script).alias("after_job"))
    return catalog.dependencies(runs).select("c_custkey", "after_job", "after_exp", "after_status")


@query("SELECT o_orderkey, TIMESTAMP '2024-02-01 00:00:00' AS guard_skipped_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_stamped(spark, d):
    have = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("exp_name"), F.lit("v").alias("variant_key"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    want = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("exp_name"), F.lit("v").alias("variant_key"))
    return guard.stamped(have, want, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "guard_skipped_at")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS array_task_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'running' END AS status, event_type AS lr FROM events")
def q_start_record(spark, d):
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("status"), "event_type", F.lit("lr"), "event_type")).otherwise(F.create_map(F.lit("lr"), "event_type"))
    record = guard.start_record(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")), F.col("ts"), extra)
    return read(spark, d, "events").select("event_id", record.alias("r")).select("event_id", *[F.try_element_at("r", F.lit(k)).alias(k) for k in ("job_id", "array_task_id", "started_at", "status", "lr")])


@query("""SELECT c_custkey, c_name AS exp_name, CAST(c_custkey AS VARCHAR) AS job_id, 'abc' AS git_commit, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE '01:00:00' END AS time_limit,
 CASE WHEN c_custkey % 2 = 0 THEN 'array' ELSE 'single' END AS run_mode, 'RUNNING' AS status, CASE WHEN c_custkey % 2 = 0 THEN '5' END AS array_task_id, 'FAILED' AS boot_status, 'bootstrap' AS boot_phase, c_mktsegment AS boot_reason FROM customer""")
def q_run_record(spark, d):
    k = F.col("c_custkey")
    jobs = read(spark, d, "customer").select(k, F.col("c_name").alias("exp_name"), k.cast("string").alias("job_dir"), k.cast("string").alias("job_id"), F.lit("abc").alias("git_commit"), F.when(k % 4 == 0, "").otherwise("01:00:00").alias("time_limit"), F.when(k % 2 == 0, "array").otherwise("single").alias("run_mode"), F.lit("5").alias("task_id"), F.col("c_mktsegment").alias("reason"))
    at = running.started(jobs).select(F.col("job_dir").cast("long").alias("c_custkey"), "record").join(jobs.select("c_custkey", guard.bootstrap_record(F.col("reason")).alias("b")), "c_custkey")
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    fields = ("exp_name", "job_id", "git_commit", "time_limit", "run_mode", "status", "array_task_id")
    return at.select("c_custkey", *[get("record", k).alias(k) for k in fields], get("b", "status").alias("boot_status"), get("b", "failure_phase").alias("boot_phase"), get("b", "fail_reason").alias("boot_reason"))


@query("SELECT CAST(user_id AS VARCHAR) AS exp_name, event_type AS variant_key, min(event_id) AS seq, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q_once(spark, d):
    return guard.once(read(spark, d, "events").select(F.col("user_id").cast("string").alias("exp_name"), F.col("event_type").alias("variant_key"), F.col("event_id").alias("seq"), "value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '7_' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS job_dir, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS chosen, CASE c_custkey % 3 WHEN 0 THEN 'run --k ' || c_custkey WHEN 1 THEN 'one' ELSE '' END AS command, '04:30:00' AS template_time FROM customer")
def q_job_expressions(spark, d):
    k = F.col("c_custkey")
    mode = F.when(k % 3 == 0, "array").when(k % 3 == 1, "single").otherwise("seq")
    return read(spark, d, "customer").select(
        k, names.job_directory(F.when(k % 2 == 0, "array").otherwise("seq"), F.lit("7"), k.cast("string"), k.cast("string")).alias("job_dir"),
        names.fallback(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, ""), F.col("c_mktsegment")).alias("chosen"),
        texts.resolved_command(mode, F.lit("run"), F.concat(F.lit("--k "), k.cast("string")), F.lit("one")).alias("command"),
        texts.time_option(F.lit("# note --time=04:30:00\n#SBATCH --time=01:00:00\n")).alias("template_time"),
    )


@query("""SELECT file, CASE WHEN file LIKE '%.log' THEN regexp_replace(file, '^watcher_|\\.log$', '', 'g') ELSE split_part(file, '_', 1) END AS job, base
FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'watcher_' || s_suppkey || '.log' ELSE s_suppkey || '_3_run.out' END AS file, CAST(s_suppkey AS VARCHAR) AS base FROM supplier)""")
def q_job_of_log(spark, d):
    k = F.col("s_suppkey").cast("string")
    file = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("watcher_"), k, F.lit(".log"))).otherwise(F.concat(k, F.lit("_3_run.out")))
    return read(spark, d, "supplier").select(file.alias("file"), names.job_of_log(file).alias("job"), names.base_job(F.concat(k, F.lit("_3"))).alias("base"))


@query("""SELECT doc_id, file, CASE WHEN file = 'notes.txt' THEN t ELSE CASE WHEN file = 'run_slurm.sh' THEN replace(replace(t, '0001_a', '0002_b'), E'\n#SBATCH --dependency', E'\n# #SBATCH --dependency') ELSE replace(t, '0001_a', '0002_b') END END AS text
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'run_slurm.sh' WHEN 1 THEN 'config.yml' ELSE 'notes.txt' END AS file, E'x 0001_a\n#SBATCH --dependency=afterok:1\n' || lang || ' 0001_a' AS t FROM documents)""")
def q_rewritten(spark, d):
    k = F.col("doc_id") % 3
    files = read(spark, d, "documents").select("doc_id", F.when(k == 0, "run_slurm.sh").when(k == 1, "config.yml").otherwise("notes.txt").alias("file"), F.concat(F.lit("x 0001_a\n#SBATCH --dependency=afterok:1\n"), "lang", F.lit(" 0001_a")).alias("text"))
    return lifecycle.rewritten(files, "0001_a", "0002_b")


@query("SELECT p_partkey, 'run_' || p_partkey || '.sh' AS file FROM part WHERE p_partkey % 6 > 3")
def q_copied_files(spark, d):
    k = F.col("p_partkey") % 6
    file = F.when(k == 0, "FAILED_REASON.txt").when(k == 1, "uncommitted_changes.diff").when(k == 2, "metadata.yaml").when(k == 3, "lib/__pycache__/x.pyc").otherwise(F.concat(F.lit("run_"), F.col("p_partkey").cast("string"), F.lit(".sh")))
    return lifecycle.copied_files(read(spark, d, "part").select("p_partkey", file.alias("file")))


_TEMPLATE = "#SBATCH --job-name=__EXP_NAME__\n#SBATCH --partition=__PARTITION__\n#SBATCH --time=02:00:00\n#SBATCH --signal=B:USR1@__SIGNAL_MARGIN__\nexport PROJECT_ROOT=__PROJECT_ROOT__ # __EXP_NAME__\n"
_OWNERS = [("/work/g1/", "g1"), ("/work/files/", "shared")]
_SQL_TEXT = lambda text: "E'" + text.replace("'", "''").replace("\n", "\\n") + "'"


@query(f"""WITH t AS (SELECT printf('%04d', CAST(max(s_suppkey) + 1 AS BIGINT)) AS id FROM supplier), e AS (SELECT id, id || '_20260201_my_run' AS n FROM t)
SELECT 0 AS step, 'mkdir' AS action, NULL AS src, 'experiments/' || n AS dst, NULL AS detail FROM e UNION ALL SELECT 1, 'mkdir', NULL, 'outputs/' || n, NULL FROM e
UNION ALL SELECT 2, 'write', NULL, 'experiments/' || n || '/run_slurm.sh', replace(replace(replace(replace({_SQL_TEXT(_TEMPLATE)}, '__EXP_NAME__', n), '__PROJECT_ROOT__', '/work/files/p'), '__PARTITION__', 'medium-shared'), '__SIGNAL_MARGIN__', '72') FROM e
UNION ALL SELECT 3, 'copy', 'templates/experiment.py', 'experiments/' || n || '/experiment.py', NULL FROM e UNION ALL SELECT 4, 'copy', 'templates/config.yml', 'experiments/' || n || '/config.yml', NULL FROM e
UNION ALL SELECT 5, 'write', NULL, 'experiments/' || n || '/metadata.yaml', 'exp_id: ' || id || chr(10) || 'exp_name: ' || n || chr(10) || 'created_date: 20260201' || chr(10) || 'git_commit: abc' || chr(10) FROM e
UNION ALL SELECT 6, 'write', NULL, 'experiments/' || n || '/uncommitted_changes.diff', '+x' FROM e
UNION ALL SELECT 7, 'link', 'experiments/' || n, 'experiments/latest', NULL FROM e UNION ALL SELECT 8, 'link', 'outputs/' || n, 'outputs/latest', NULL FROM e
UNION ALL SELECT 0, 'error', '/home/me', NULL, 'UNKNOWN_OWNER'""")
def q_create_plan(spark, d):
    owners = spark.createDataFrame(_OWNERS, "prefix string, owner string")
    exps = _exps(spark, d).select("exp_name")
    made = lifecycle.create(exps, "my run", "20260201", "/work/files/p", owners, _TEMPLATE, "abc", "+x")
    return made.unionByName(lifecycle.create(exps, "my run", "20260201", "/home/me", owners, _TEMPLATE))


@query(f"""WITH t AS (SELECT printf('%04d', CAST(max(s_suppkey) + 1 AS BIGINT)) AS id FROM supplier), s AS (SELECT n AS src FROM {_EXPS_SQL} WHERE s_suppkey = 5), e AS (SELECT id, src, id || '_20260201_run_resumed' AS n FROM t, s)
SELECT 0 AS step, 'mkdir' AS action, NULL AS src, 'outputs/' || n AS dst, NULL AS detail FROM e
UNION ALL SELECT 1, 'copy', 'experiments/' || src, 'experiments/' || n, 'without FAILED_REASON.txt, uncommitted_changes.diff, metadata.yaml, __pycache__/' FROM e
UNION ALL SELECT 2, 'rewrite', src, n, 'run_slurm.sh, config.yml; dependency off' FROM e
UNION ALL SELECT 3, 'write', NULL, 'experiments/' || n || '/metadata.yaml', 'exp_id: ' || id || chr(10) || 'exp_name: ' || n || chr(10) || 'created_date: 20260201' || chr(10) || 'git_commit: git_not_available' || chr(10) || 'resumed_from_exp: ' || src || chr(10) || 'resume_checkpoint_dir: /p/outputs/' || src || chr(10) || 'resume_checkpoint_file: null' || chr(10) FROM e
UNION ALL SELECT 4, 'link', 'experiments/' || n, 'experiments/latest', NULL FROM e UNION ALL SELECT 5, 'link', 'outputs/' || n, 'outputs/latest', NULL FROM e""")
def q_resume_plan(spark, d):
    return lifecycle.resume(_exps(spark, d).select("exp_name"), "5", "20260201", root="/p")


_MOVES_SQL = """UNION ALL SELECT 'experiments/' || src, 'experiments/' || n, 'move', NULL FROM e UNION ALL SELECT 'outputs/' || src, 'outputs/' || n, 'move', NULL FROM e WHERE k % 2 = 0
UNION ALL SELECT 'experiments/' || n, 'experiments/latest', 'link', NULL FROM e WHERE top UNION ALL SELECT 'outputs/' || n, 'outputs/latest', 'link', NULL FROM e WHERE top"""


@query(f"""WITH x AS (SELECT s_suppkey AS k, n AS src, s_suppkey = max(s_suppkey) OVER () AS top FROM {_EXPS_SQL}), e AS (SELECT *, src || '_FAILED_20260301_no_disk' AS n FROM x WHERE k IN (2, 3) OR top AND NOT contains(src, '_FAILED_'))
SELECT NULL AS src, 'experiments/' || n || '/FAILED_REASON.txt' AS dst, 'write' AS action, 'failed_at: 2026-03-01 00:00:00' || chr(10) || 'reason: no disk' || chr(10) || 'original_experiment: ' || src || chr(10) AS detail FROM e {_MOVES_SQL}""")
def q_mark_failed(spark, d):
    exps = _exps(spark, d)
    outputs = exps.filter("s_suppkey % 2 = 0").select("exp_name")
    plan = lambda which: lifecycle.mark_failed(exps.select("exp_name"), outputs, which, "no disk", "20260301", "2026-03-01 00:00:00")
    return _union(plan("2"), plan("3"), plan("5"), plan("latest")).select("src", "dst", "action", "detail")


@query(f"""WITH x AS (SELECT s_suppkey AS k, n AS src, s_suppkey = max(s_suppkey) OVER () AS top FROM {_EXPS_SQL}), e AS (SELECT *, substr(src, 1, 14) || 'new' || CASE WHEN k % 5 = 0 THEN '_FAILED_20260102_oom' ELSE '' END AS n FROM x WHERE k IN (2, 5))
SELECT src, n AS dst, 'rewrite' AS action, 'run_slurm.sh, config.yml' AS detail FROM e {_MOVES_SQL} UNION ALL SELECT NULL, src, 'error', 'TARGET_EXISTS' FROM x WHERE k = 3""")
def q_rename_plan(spark, d):
    exps = _exps(spark, d)
    outputs = exps.filter("s_suppkey % 2 = 0").select("exp_name")
    plan = lambda which, label: lifecycle.rename(exps.select("exp_name"), outputs, which, label)
    return _union(plan("2", "new"), plan("5", "new"), plan("3", "run")).select("src", "dst", "action", "detail")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'qdel' AS tool, 'qdel ' || o_orderkey AS command, NULL AS payload FROM orders WHERE o_custkey = 7
UNION ALL SELECT NULL, NULL, NULL, '{"text":"⚡ INTERRUPTED","attachments":[{"color":"#' || substr(md5('7'), 1, 6) || '","fields":[{"title":"EXP","value":"' || coalesce(min(CAST(o_orderkey AS VARCHAR)), 'unknown') || '","short":true},{"title":"JOB","value":"7","short":true},{"title":"STATE","value":"USER_CANCEL (reason: budget, by: me)","short":true}]}]}' FROM orders WHERE o_custkey = 7""")
def q_cancel_plan(spark, d):
    runs = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("exp_name"), F.concat(F.col("o_custkey").cast("string"), F.lit("_0")).alias("job_dir"), F.col("o_custkey"), F.col("o_orderkey").cast("string").alias("job_id"))
    plan = lifecycle.cancel_plan(runs.filter("o_custkey = 7"), ["kill", "qdel"]).withColumn("payload", F.lit(None).cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("job_id", "tool", "command")]
    return plan.unionByName(lifecycle.cancel_notice(runs, "7", "budget", "me").select(*none, "payload"))


@query(f"""SELECT n AS exp_name, '# ' || n || ' <実験名>' || chr(10) || n || '/x NNNN_YYYYMMDD_<name>' || chr(10) || n || ' ' || n || chr(10) AS document FROM {_EXPS_SQL}
UNION ALL SELECT min(n), 'one ' || min(n) FROM {_EXPS_SQL} WHERE contains(n, '0007')""")
def q_review(spark, d):
    exps = _exps(spark, d).select("exp_name")
    text = "# <実験名> <実験名>\nNNNN_YYYYMMDD_<name>/x NNNN_YYYYMMDD_<name>\n<実験名> NNNN_YYYYMMDD_<name>\n"
    return lifecycle.reviewed(exps, F.lit(text)).unionByName(lifecycle.review(exps, "one <実験名>", None, "7"))


@query("""WITH r AS (SELECT *, o_orderkey % 4 AS k, 'e' || o_custkey AS e, CAST(o_orderkey AS VARCHAR) AS id FROM orders)
SELECT e AS exp_name, CASE k WHEN 0 THEN id || '_2' WHEN 1 THEN id WHEN 2 THEN id || '_2' ELSE id END AS job_dir,
 'logs/' || e || '/' || CASE k WHEN 0 THEN id || '_2_' || e || '.out' WHEN 1 THEN id || '_' || e || '.out' WHEN 2 THEN e || '.o' || id || '-2.s' ELSE e || '.o' || id END AS src,
 'logs/' || e || '/' || CASE k WHEN 0 THEN id || '_2' WHEN 1 THEN id WHEN 2 THEN id || '_2' ELSE id END || '/slurm.out' AS dst FROM r WHERE k < 2 OR k = 2
 OR k = 3 AND NOT EXISTS (SELECT 1 FROM r q WHERE q.e = r.e AND q.k = 2 AND starts_with(q.id, r.id))
UNION ALL SELECT e, id || '_2', 'logs/' || e || '/' || e || '.e' || id || '-2.s', 'logs/' || e || '/' || id || '_2/pbs.err' FROM r WHERE k = 2
UNION ALL SELECT r.e, r.id, 'logs/' || r.e || '/' || least(r.e || '.o' || r.id, min(r.e || '.o' || q.id || '-2.s')), 'logs/' || r.e || '/' || r.id || '/slurm.out' FROM r JOIN r q ON q.e = r.e AND r.k = 3 AND q.k = 2 AND starts_with(q.id, r.id) GROUP BY r.e, r.id
UNION ALL SELECT r.e, r.id, 'logs/' || r.e || '/' || min(r.e || '.e' || q.id || '-2.s'), 'logs/' || r.e || '/' || r.id || '/pbs.err' FROM r JOIN r q ON q.e = r.e AND r.k = 3 AND q.k = 2 AND starts_with(q.id, r.id) GROUP BY r.e, r.id""")
def q_scheduler_logs(spark, d):
    k, e, i = F.col("o_orderkey") % 4, F.concat(F.lit("e"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string")
    runs = read(spark, d, "orders").select(
        e.alias("exp_name"), F.when(k < 2, "slurm").otherwise("pbs").alias("scheduler"), F.when(k % 2 == 0, "array").otherwise("single").alias("run_mode"), i.alias("job_id"), F.when(k % 2 == 0, i).otherwise("").alias("array_job_id"),
        F.when(k % 2 == 0, "2").otherwise("").alias("task_id"), names.job_directory(F.when(k % 2 == 0, "array").otherwise("single"), i, F.lit("2"), i).alias("job_dir"), k.alias("k"),
    )
    file = F.when(F.col("k") == 0, F.concat("job_id", F.lit("_2_"), "exp_name", F.lit(".out"))).when(F.col("k") == 1, F.concat("job_id", F.lit("_"), "exp_name", F.lit(".out"))).when(F.col("k") == 2, F.concat("exp_name", F.lit(".o"), "job_id", F.lit("-2.s"))).otherwise(F.concat("exp_name", F.lit(".o"), "job_id"))
    files = runs.select("exp_name", file.alias("file")).unionByName(runs.filter("k = 2").select("exp_name", F.concat("exp_name", F.lit(".e"), "job_id", F.lit("-2.s")).alias("file")))
    return cleanup.scheduler_logs(runs, files)


@query("SELECT p_brand AS path, CASE WHEN starts_with(p_brand, 'Brand#23') THEN 'cho' WHEN starts_with(p_brand, 'Brand#1') THEN 'ana' WHEN starts_with(p_brand, 'Brand#2') THEN 'ben' END AS owner FROM part")
def q_repeated_owners(spark, d):
    table = spark.createDataFrame([("Brand#1", "ana"), ("Brand#2", "ben"), ("Brand#23", "cho")], "prefix string, owner string")
    return catalog.owners(read(spark, d, "part").select(F.col("p_brand").alias("path")), table)


@query("""WITH e AS (SELECT event_id, event_id % 4 AS k, event_id % 5 AS j, CAST(user_id AS VARCHAR) AS job, event_type AS exp FROM events),
l AS (SELECT *, [ {'t': 'EXP', 'v': exp}, {'t': 'JOB', 'v': job} ] || CASE k WHEN 0 THEN [ {'t': 'PART', 'v': 'unknown'}, {'t': 'TIME', 'v': '01:00:00'} ] WHEN 1 THEN [] ELSE [ {'t': 'STATE', 'v': 'bad'} ] END
 || CASE WHEN j = 0 THEN [ {'t': 'TASK', 'v': (event_id + 1) || '/9'}, {'t': 'OPTS', 'v': '--k v'} ] ELSE [] END || CASE WHEN j = 1 THEN [ {'t': 'NOTE', 'v': 'mine'} ] ELSE [] END AS f FROM e WHERE NOT (j = 2 AND k = 1) AND NOT (j = 3 AND k > 1))
SELECT event_id, '{"text":"' || CASE k WHEN 0 THEN '🚀 STARTED' WHEN 1 THEN '✅ FINISHED' WHEN 2 THEN '❌ FAILED' ELSE '⚡ INTERRUPTED' END || '","attachments":[{"color":"#' || substr(md5(job), 1, 6) || '","fields":[' || array_to_string(list_transform(f, lambda x: '{"title":"' || x.t || '","value":"' || x.v || '","short":true}'), ',') || ']}]}' AS payload FROM l""")
def q_notifications(spark, d):
    k, j = F.col("event_id") % 4, F.col("event_id") % 5
    off = lambda key: F.create_map(F.lit(key), F.lit("0"))
    events = read(spark, d, "events").select(
        "event_id", F.when(k == 0, "start").when(k == 1, "finish").when(k == 2, "fail").otherwise("fail_fast").alias("event"),
        F.when(j == 2, off("SLACK_NOTIFY_ON_FINISH")).when(j == 3, off("SLACK_NOTIFY_ON_FAIL")).otherwise(F.create_map(F.lit("SLACK_NOTIFY_ON_START"), F.lit(""))).alias("flags"),
        F.col("event_type").alias("exp_name"), F.col("user_id").cast("string").alias("job_id"), F.lit("").alias("partition"), F.lit("01:00:00").alias("time_limit"), F.lit("bad : worse").alias("state"),
        F.when(j == 0, "array").otherwise("single").alias("run_mode"), F.col("event_id").cast("string").alias("task_id"), F.lit("9").alias("total"), F.lit("--k v").alias("options"), F.when(j == 1, "NOTE : mine").otherwise("").alias("extra"),
    )
    return notices.notifications(events).select("event_id", "payload")


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'UNKNOWN' WHEN 'purchase' THEN 'TIMEOUT' WHEN 'signup' THEN 'CANCELLED by 1' ELSE 'PREEMPTED' END AS s, event_id % 2 AS code, CAST(user_id AS VARCHAR) AS job FROM events),
f AS (SELECT *, CASE WHEN s = 'TIMEOUT' THEN s WHEN s LIKE 'CANCELLED%' THEN 'CANCELLED' WHEN s = 'PREEMPTED' OR code > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN s = 'TIMEOUT' THEN s WHEN s LIKE 'CANCELLED%' THEN 'CANCELLED' WHEN s = 'PREEMPTED' THEN 'SCRIPT_ERROR (line end, code ' || code || ', state PREEMPTED)' WHEN code = 0 THEN NULL WHEN s = 'UNKNOWN' THEN 'NONZERO_EXIT (code 1; scheduler state unknown)' ELSE 'NONZERO_EXIT (code 1)' END AS shown FROM e)
SELECT event_id, status, '{"text":"' || CASE WHEN status = 'COMPLETED' THEN '✅ FINISHED' WHEN status = 'CANCELLED' THEN '⚡ INTERRUPTED' ELSE '❌ FAILED' END || '","attachments":[{"color":"#' || substr(md5(job), 1, 6) || '","fields":[{"title":"EXP","value":"e","short":true},{"title":"JOB","value":"' || job || '","short":true}' || CASE WHEN shown IS NULL THEN '' ELSE ',{"title":"STATE","value":"' || shown || '","short":true}' END || ']}]}' AS payload FROM f""")
def q_finished(spark, d):
    state = F.when(F.col("event_type") == "click", "COMPLETED").when(F.col("event_type") == "view", "UNKNOWN").when(F.col("event_type") == "purchase", "TIMEOUT").when(F.col("event_type") == "signup", "CANCELLED by 1").otherwise("PREEMPTED")
    jobs = read(spark, d, "events").select("event_id", F.lit("e").alias("exp_name"), F.lit("d").alias("job_dir"), F.col("user_id").cast("string").alias("job_id"), state.alias("state"), (F.col("event_id") % 2).alias("code"), F.lit("end").alias("line"))
    return running.finished(jobs).select("event_id", "status", "payload")


_JOBS = ("single", "array", "seq", "batch")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS exp_name, CASE WHEN c_custkey % 4 = 1 THEN '9_' || c_custkey % 5 ELSE CAST(c_custkey AS VARCHAR) END AS job_dir, CAST(CASE WHEN c_custkey % 4 = 2 THEN i ELSE 0 END AS BIGINT) AS line,
 CASE c_custkey % 4 WHEN 0 THEN 'one' WHEN 2 THEN 'run --k ' || ['u', 'v', 'w'][i + 1] ELSE CASE WHEN c_custkey % 5 < 3 THEN 'run --k ' || ['u', 'v', 'w'][c_custkey % 5 + 1] END END AS command
FROM customer, range(3) r(i) WHERE c_custkey % 4 < 3 AND (c_custkey % 4 = 2 OR i = 0) AND c_custkey % 7 <> 0""")
def q_commands(spark, d):
    k = F.col("c_custkey")
    env = F.create_map(F.lit("SLURM_JOB_ID"), k.cast("string"), F.lit("SLURM_ARRAY_JOB_ID"), F.lit("9"), F.lit("SLURM_ARRAY_TASK_ID"), (k % 5).cast("string"))
    mode = F.array(*map(F.lit, _JOBS))[(k % 4).cast("int")]
    jobs = read(spark, d, "customer").select(k.cast("string").alias("exp_name"), env.alias("env"), mode.alias("run_mode"), F.when(k % 7 == 0, "").otherwise("01:00:00").alias("time_limit"), F.lit("/p").alias("project_root"), *[F.lit(True).alias(c) for c in ("log_dir_ok", "link_ok", "helper_ok", "metadata_ok")])
    ready, _ = running.bootstrapped(running.bound(jobs))
    one = jobs.select("exp_name")
    scripts = one.select("exp_name", F.lit("run").alias("base_command"), F.lit("one").alias("run_command"))
    grids = one.select("exp_name", F.lit(0).alias("pos"), F.lit("--k").alias("arg"), F.array(*map(F.lit, "uvw")).alias("values"))
    return running.commands(ready, scripts, grids)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS exp_name, CASE WHEN c_custkey % 4 = 1 THEN '9_' || c_custkey % 5 ELSE CAST(c_custkey AS VARCHAR) END AS job_dir, 'FAILED' AS status, 'bootstrap' AS failure_phase, 'MISSING_TIME_LIMIT' AS fail_reason FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 7 = 0""")
def q_bootstrap_failures(spark, d):
    k = F.col("c_custkey")
    env = F.create_map(F.lit("SLURM_JOB_ID"), k.cast("string"), F.lit("SLURM_ARRAY_JOB_ID"), F.lit("9"), F.lit("SLURM_ARRAY_TASK_ID"), (k % 5).cast("string"))
    mode = F.array(*map(F.lit, _JOBS))[(k % 4).cast("int")]
    jobs = read(spark, d, "customer").select(k.cast("string").alias("exp_name"), env.alias("env"), mode.alias("run_mode"), F.when(k % 7 == 0, "").otherwise("01:00:00").alias("time_limit"), F.lit("/p").alias("project_root"), *[F.lit(True).alias(c) for c in ("log_dir_ok", "link_ok", "helper_ok", "metadata_ok")])
    _, failed = running.bootstrapped(running.bound(jobs))
    return failed.select("exp_name", "job_dir", *[F.try_element_at("record", F.lit(c)).alias(c) for c in ("status", "failure_phase", "fail_reason")])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS exp_name, min(CASE WHEN l_quantity >= 45 THEN l_linenumber END) AS failed_at, coalesce(arg_min(CAST(l_quantity AS INTEGER), l_linenumber) FILTER (l_quantity >= 45), 0) AS exit_code, count(*) AS n_steps FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey")
def q_sequence_codes(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    steps = lines.select(F.col("l_orderkey").cast("string").alias("exp_name"), F.lit("d").alias("job_dir"), F.col("l_linenumber").alias("idx"), F.when(F.col("q") >= 45, F.col("q").cast("int")).otherwise(0).alias("code"))
    return running.sequence_codes(steps).drop("job_dir")


_GRID_CASES = (
    # script, detail of the blocker or none
    ('RUN_MODE="array"\nCONFIGS=("--a 1" "--a 2")\n', "array mode without an active array directive"),
    ('RUN_MODE = array\nCONFIGS=("--a 1")\n  #SBATCH --array=0-4\n', None),
    ('RUN_MODE=array\nGRID_ARGS = ("--a")\n#SBATCH --array=0-7%2\n', None),
    ('GRID_ARGS=("--a")\nGRID_VALUES=(\n"x y"\n)\n', "grid with run mode single"),
    ('RUN_MODE=seq\nRUN_MODE=\'array\'\nGRID_ARGS=("--a")\nGRID_VALUES=(\n"x y"\n)\n#SBATCH --array=0-2\n', "array ends at 2, the grid at 1"),
    ('RUN_MODE=array\nGRID_ARGS=("--a")\nGRID_VALUES=(\n"x y"\n)\n#SBATCH --array=0-1\n', None),
    ('\t# RUN_MODE=array\nRUN_COMMAND="x"\n', None),
)


@query("SELECT p_partkey, [" + ", ".join("NULL" if v is None else f"'{v}'" for _, v in _GRID_CASES) + "][p_partkey % 7 + 1] AS detail, [" + ", ".join(str(v is None).lower() for _, v in _GRID_CASES) + "][p_partkey % 7 + 1] AS passes FROM part")
def q_verdicts(spark, d):
    script = F.array(*[F.lit(t) for t, _ in _GRID_CASES])[(F.col("p_partkey") % 7).cast("int")]
    work = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("exp_name"), script.alias("run_slurm"), F.lit("a = config['x']").alias("experiment_py"), F.lit("x: 1").alias("config_yml"))
    found = preflight.findings(work).select("exp_name", "detail")
    return preflight.verdicts(work).join(found, "exp_name", "left").select(F.col("exp_name").cast("long").alias("p_partkey"), "detail", "passes")


@query("""WITH j AS (SELECT c_custkey, 'e' || c_custkey AS e, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'me' END AS u, '/scratch/' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'me' END || '/e' || c_custkey || '_7' AS s FROM customer)
SELECT c_custkey, 0 AS step, 'mkdir' AS action, NULL AS src, s AS dst FROM j UNION ALL SELECT c_custkey, 1, 'sync', '/p/data', s || '/data' FROM j WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'mkdir', NULL, '/p/outputs/' || e FROM j
UNION ALL SELECT c_custkey, 3, 'mkdir', NULL, s || '/outputs' FROM j WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 4, 'sync', s || '/outputs/' || e, '/p/outputs/' || e FROM j WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 5, 'delete', s, NULL FROM j WHERE u <> ''""")
def q_staging(spark, d):
    k = F.col("c_custkey")
    jobs = read(spark, d, "customer").select(F.concat(F.lit("e"), k.cast("string")).alias("exp_name"), F.lit("7").alias("job_id"), F.when(k % 5 == 0, "").otherwise("me").alias("user"), F.lit("/p").alias("root"), (k % 2 == 0).alias("local_input"), (k % 3 == 0).alias("local_output"), (k % 2 == 0).alias("has_output"))
    return running.staging(jobs).select(F.substring("exp_name", 2, 20).cast("long").alias("c_custkey"), "step", "action", "src", "dst")


_CALLS = ("uv_sync", "create_exp", "mark_fail", "resume_exp", "rename_exp", "review", "jupyter", "setup")


def _calls(spark, d):
    k = F.col("p_partkey")
    args = F.when(k % 3 == 0, F.create_map(F.lit("p"), F.lit("fast"), F.lit("mem"), F.lit("32g"), F.lit("name"), F.lit("x"), F.lit("reason"), F.lit(""))).when(k % 3 == 1, F.create_map(F.lit("exp"), F.lit("7"), F.lit("name"), F.lit(""), F.lit("mem"), F.lit("1g"))).otherwise(F.create_map(F.lit("name"), F.lit("x"), F.lit("new"), F.lit("y"), F.lit("reason"), F.lit("r")))
    return read(spark, d, "part").select("p_partkey", F.array(*map(F.lit, _CALLS))[(k % 8).cast("int")].alias("command"), args.alias("args"))


@query("""SELECT p_partkey, CASE p_partkey % 3
 WHEN 0 THEN CASE p_partkey % 8 WHEN 2 THEN 'reason is required' WHEN 4 THEN 'new is required' END
 WHEN 1 THEN CASE p_partkey % 8 WHEN 0 THEN 'p is required' WHEN 1 THEN 'name is required' WHEN 2 THEN 'name and reason are required' WHEN 3 THEN 'name is required' WHEN 4 THEN 'name and new are required' WHEN 6 THEN 'p is required' END
 ELSE CASE p_partkey % 8 WHEN 0 THEN 'p is required' WHEN 6 THEN 'p and mem are required' END END AS error FROM part""")
def q_arguments(spark, d):
    return arguments.checked(_calls(spark, d)).select("p_partkey", "error")


@query("SELECT CASE p_partkey % 8 WHEN 0 THEN 'uv_sync' ELSE 'jupyter' END AS command, CASE p_partkey % 8 WHEN 0 THEN 'sbatch --partition=fast jobs/sync.sh' ELSE 'sbatch --partition=fast --mem=32g jobs/notebook.sh' END AS line FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 8 IN (0, 6)")
def q_submitted(spark, d):
    return arguments.submitted(_calls(spark, d), {"uv_sync": "jobs/sync.sh", "jupyter": "jobs/notebook.sh"}).drop("args")


@query("SELECT n_name AS root, CASE WHEN f = '.env' THEN 'touch' ELSE 'mkdir' END AS action, n_name || '/' || f AS dst FROM nation, (SELECT unnest(['.env', 'logs', 'notebooks', 'data', 'outputs', 'libraries', 'experiments']) AS f)")
def q_set_up(spark, d):
    return arguments.set_up(read(spark, d, "nation").select(F.col("n_name").alias("root")))


@query("SELECT c_custkey, 'lr ' || c_custkey % 3 AS opts, 'run lr ' || c_custkey % 3 AS command FROM customer WHERE c_custkey % 5 < 3")
def q_direct_configs(spark, d):
    """Configurations that are listed, not expanded."""
    configs = grid.commands(spark.createDataFrame([(k, [f"lr {v}"], "run") for k, v in enumerate((0, 1, 2))], "idx long, opts array<string>, base_command string"))
    tasks = read(spark, d, "customer").filter("c_custkey % 5 < 3").select("c_custkey", (F.col("c_custkey") % 3).alias("task_id"))
    return grid.bind(tasks, configs).select("c_custkey", F.array_join("opts", " ").alias("opts"), "command")


@query("SELECT event_id, ts + INTERVAL (CASE event_id % 3 WHEN 0 THEN 3600 - 36 WHEN 1 THEN 600 - 30 ELSE 705600 - 7056 END) SECOND AS warn_at FROM events")
def q_limit_warnings(spark, d):
    limit = F.when(F.col("event_id") % 3 == 0, "01:00:00").when(F.col("event_id") % 3 == 1, "00:10:00").otherwise("196:00:00")
    return stream.limit_warnings(read(spark, d, "events").select(F.col("event_id").alias("run_id"), "ts", limit.alias("time_limit"))).select(F.col("run_id").alias("event_id"), F.col("warn_at").cast("timestamp_ntz").alias("warn_at"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_activity(spark, d):
    return stream.activity(read(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'a/b' || user_id ELSE NULL END AS variant_key_raw, CASE WHEN user_id % 3 = 0 THEN 'b' || user_id ELSE 'k' || user_id END AS variant_key FROM events")
def q_kept_key(spark, d):
    from .sources import workspace

    key = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("a/b"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("k"), F.col("user_id").cast("string")))
    return workspace.kept_key(read(spark, d, "events").select("user_id", key.alias("variant_key")).distinct()).select("user_id", "variant_key_raw", "variant_key")


@query("SELECT user_id, max(ts) + INTERVAL 1 HOUR > TIMESTAMP '2024-01-31 12:00:00' AS within_time_limit, CASE WHEN max(ts) < TIMESTAMP '2024-01-30 12:00:00' THEN 'delete' ELSE 'keep' END AS action FROM events GROUP BY user_id")
def q_hung_runs(spark, d):
    last = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("mtime"))
    runs = last.select("user_id", F.col("user_id").cast("string").alias("job_dir"), F.lit("RUNNING").alias("status"), "mtime", F.lit("01:00:00").alias("time_limit"))
    return cleanup.classified(runs, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).select("user_id", "within_time_limit", "action")


@query("SELECT c_custkey, strftime(DATE '2026-01-01' + CAST(c_custkey % 28 AS INTEGER), '%Y%m%d') AS day, DATE '2026-01-01' + CAST(c_custkey % 28 AS INTEGER) AS created, CASE WHEN c_custkey % 28 >= 14 THEN 'late' ELSE 'early' END AS half FROM customer")
def q_created(spark, d):
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyyMMdd")
    name = names.compose(names.padded(F.col("c_custkey")), day, F.lit("x"))
    old = times.older_than(names.created(name).cast("timestamp_ntz"), F.lit("2026-01-16 00:00:00").cast("timestamp_ntz"))
    return read(spark, d, "customer").select("c_custkey", day.alias("day"), names.created(name).alias("created"), F.when(old, "early").otherwise("late").alias("half"))


@query("SELECT CAST(user_id AS VARCHAR) AS exp_name, event_type AS variant_key, count(*) AS n, CAST(max(event_id) - min(event_id) AS BIGINT) AS span FROM events GROUP BY user_id, event_type")
def q_per_variant(spark, d):
    def main(rows):
        return rows.groupby(["exp_name", "variant_key"], as_index=False).agg(n=("event_id", "size"), span=("event_id", lambda x: x.max() - x.min()))

    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("exp_name"), F.col("event_type").alias("variant_key"), "event_id")
    return custom.per_variant(rows, main, "exp_name string, variant_key string, n long, span long")


@query("SELECT c_custkey, substr(translate(base64(unhex(sha256(c_name))), '+/=', 'xyz'), 1, 32) AS token FROM customer")
def q_token(spark, d):
    return read(spark, d, "customer").select("c_custkey", names.token(F.col("c_name")).alias("token"))
