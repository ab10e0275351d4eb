import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialbook.operators import catalog, grid, guard
from trialbook.plans import cleanup, lifecycle, preflight


def test_grid_order(spark):
    g = spark.createDataFrame([("e", 0, "--model", ["bert", "roberta"]), ("e", 1, "--dataset", ["pubmed", "pmc", "x"])], "exp_name string, pos int, arg string, values array<string>")
    got = [(r.idx, " ".join(r.opts)) for r in grid.expand(g).orderBy("idx").collect()]
    assert got[:4] == [(0, "--model bert --dataset pubmed"), (1, "--model bert --dataset pmc"), (2, "--model bert --dataset x"), (3, "--model roberta --dataset pubmed")]
    assert len(got) == 6 and grid.counts(g).first().n_configs == 6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_grid_is_a_bijection(spark, sizes):
    rows = [("e", k, f"--d{k}", [str(v) for v in range(n)]) for k, n in enumerate(sizes)]
    got = grid.expand(spark.createDataFrame(rows, "exp_name string, pos int, arg string, values array<string>")).collect()
    total = 1
    for n in sizes:
        total *= n
    assert sorted(r.idx for r in got) == list(range(total)) and len({tuple(r.opts) for r in got}) == total


def script(spark, text):
    return spark.createDataFrame([("e", text)], "exp_name string, run_slurm string")


def grid_text(n, mode="seq", more=""):
    return f'{more}RUN_MODE="{mode}"\nGRID_ARGS=("--a")\nGRID_VALUES=(\n"{" ".join(map(str, range(n)))}"\n)\n'


def test_preflight_thresholds(spark):
    severity = lambda text: [r.severity for r in preflight.grid_findings(script(spark, text)).collect()]
    assert [severity(grid_text(n)) for n in (20, 21, 50, 51)] == [[], ["warning"], ["warning"], ["blocker"]]
    assert severity(grid_text(3, "single")) == ["blocker"] and severity(grid_text(3, "array")) == ["blocker"]
    assert severity(grid_text(3, "array", "#SBATCH --array=0-2%2\n")) == [] and severity(grid_text(3, "array", "#SBATCH --array=0-3\n")) == ["blocker"]
    assert severity(grid_text(3, "array", "# #SBATCH --array=0-2\n")) == ["blocker"]
    assert severity("\n".join("# " + x for x in grid_text(60).splitlines())) == []


def test_line_count_differs_from_expansion(spark):
    n, lint = preflight.grid_counts(F.col("run_slurm"))
    r = script(spark, 'GRID_VALUES=("a b c" "d e")').select(n.alias("n"), lint.alias("lint")).first()
    assert (r.n, r.lint) == (6, 5)


def test_config_and_writes(spark):
    py = "a = config['x']\nb = config.get(\"y\")\nc = config['z']\nopen('outputs/a')\ndf.to_csv('./data/b')\nopen(path)\n"
    work = spark.createDataFrame([("e", "", py, "x: 1\n# y: 2\n  z: 3\n"), ("f", "", None, None)], "exp_name string, run_slurm string, experiment_py string, config_yml string")
    found = preflight.findings(work).collect()
    assert sorted(r.detail for r in found if r.check == "config_match") == ["y", "z"]
    assert len([r for r in found if r.check == "direct_write"]) == 2
    assert {r.exp_name: r.passes for r in preflight.verdicts(work).collect()} == {"e": False, "f": True}


def test_guard_splits(spark):
    have = spark.createDataFrame([("e", "a", "completed", False), ("e", "b", "running", False), ("e", "c", None, True)], "exp_name string, variant_key string, status string, corrupt boolean")
    want = spark.createDataFrame([("e", k) for k in "abcd"], "exp_name string, variant_key string")
    run = {r.variant_key: r.warning for r in guard.to_run(want, have).collect()}
    assert [r.variant_key for r in guard.to_skip(want, have).collect()] == ["a"] and run == {"b": "ALREADY_RUNNING", "c": None, "d": None}


def test_record_folds(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    r = spark.range(1).select(
        guard.start_record(F.lit("7"), F.lit(None).cast("string"), now, F.create_map(F.lit("status"), F.lit("mine"), F.lit("lr"), F.lit("0.1"))).alias("a"),
        guard.completed_record(F.lit(None).cast("map<string,string>"), now).alias("b"),
    ).first()
    assert r.a["status"] == "mine" and r.a["lr"] == "0.1" and r.a["array_task_id"] == "" and r.b["status"] == "completed"
    log = spark.createDataFrame([("r", "status", "RUNNING", 1), ("r", "status", "FAILED", 3), ("r", "status", "X", 2), ("r", "k", "v", 1)], "run string, key string, value string, seq int")
    assert guard.fold(log, ["run"]).first().record == {"status": "FAILED", "k": "v"}


NAMES = ["latest", "0001_20260101_baseline", "0002_20260102_x_FAILED_20260103_oom", "0008_20260103_a", "0010_20260104_b_retry", "notes"]


def names(spark, more=()):
    return spark.createDataFrame([(n,) for n in [*NAMES, *more]], "exp_name string")


def test_catalog(spark):
    assert catalog.next_id(names(spark)).first().next_id == "0011"
    assert catalog.next_id(names(spark, ["9999_x", "10000_y"])).first().next_id == "10001"
    assert catalog.next_id(names(spark).limit(0)).first().next_id == "0001"
    assert catalog.latest(names(spark)).first().exp_name == "0010_20260104_b_retry"
    assert catalog.select_one(names(spark), "8").first().exp_name == "0008_20260103_a"
    assert catalog.select_one(names(spark), "base", loose=True).first().exp_name == "0001_20260101_baseline"


def test_lifecycle(spark):
    outputs = spark.createDataFrame([("0008_20260103_a",)], "exp_name string")
    owners = spark.createDataFrame([("/work/g1", "g1")], "prefix string, owner string")
    made = lifecycle.create(names(spark), "my run/1", "20260201", "/work/g1/p", owners, "#SBATCH --time=02:00:00 __EXP_NAME__ __PARTITION__ __SIGNAL_MARGIN__").collect()
    assert made[0].dst == "experiments/0011_20260201_my_run_1" and "my_run_1 medium-g1 72" in made[2].detail
    assert [r.detail for r in lifecycle.create(names(spark), "a", "20260201", "/x", owners, "").collect()] == ["UNKNOWN_OWNER"]
    again = lifecycle.resume(names(spark), "10", "20260201").collect()
    assert again[1].dst == "experiments/0011_20260201_b_resumed"
    failed = {(r.action, r.dst) for r in lifecycle.mark_failed(names(spark), outputs, "8", "no disk", "20260201", "2026-02-01 00:00:00").collect()}
    assert ("move", "outputs/0008_20260103_a_FAILED_20260201_no_disk") in failed
    assert lifecycle.mark_failed(names(spark), outputs, "2", "x", "20260201", "").count() == 0
    renamed = {(r.action, r.dst) for r in lifecycle.rename(names(spark), outputs, "2", "new").collect()}
    assert ("move", "experiments/0002_20260102_new_FAILED_20260103_oom") in renamed and not any(d.startswith("outputs") for _, d in renamed)
    clash = lifecycle.rename(names(spark, ["0008_20260103_z"]), outputs, "0008_20260103_a", "z").collect()
    assert [(r.action, r.detail) for r in clash] == [("error", "TARGET_EXISTS")]


def test_cancel(spark):
    runs = spark.createDataFrame([("e", "12", "RUNNING"), ("e", "12_0", "RUNNING"), ("e", "123", "RUNNING")], "exp_name string, job_dir string, status string")
    assert [r.status for r in lifecycle.cancel(runs, "12").orderBy("job_dir").collect()] == ["CANCELLED", "RUNNING", "CANCELLED"]
    assert lifecycle.cancel_plan(runs.select(F.col("job_dir").alias("job_id")), ["kill", "qdel"]).first().tool == "qdel"
    assert '"EXP"' in lifecycle.cancel_notice(runs, "12").first().payload


def test_cleanup(spark):
    at = dt.datetime(2026, 1, 10)
    hours = lambda h, m: at - dt.timedelta(hours=h, minutes=m)
    rows = [("e", "1", "FAILED", at), ("e", "2", "RUNNING", hours(23, 59)), ("e", "3", "RUNNING", hours(24, 1)), ("e", "4", None, at), ("e", "latest", "FAILED", at), ("e", "5", "COMPLETED", hours(99, 0))]
    runs = spark.createDataFrame(rows, "exp_name string, job_dir string, status string, mtime timestamp_ntz")
    dirs = spark.createDataFrame([("e",), ("gone",), ("latest",)], "exp_name string")
    plan = cleanup.failed_logs(runs, dirs, spark.createDataFrame([("e",)], "exp_name string"), F.lit(at).cast("timestamp_ntz")).collect()
    assert sorted((r.path, r.reason) for r in plan) == [("logs/e/1", "FAILED_RUN"), ("logs/e/3", "HUNG_RUN"), ("logs/gone", "ORPHANED_LOGS")]
    files = spark.createDataFrame([("e", f) for f in ("77_exp.out", "5_0_exp.out", "5_1_exp.out", "watcher_9.log", "x.txt")], "exp_name string, file string")
    got = {r.src: (r.dst, r.collides) for r in cleanup.tidied_logs(files).collect()}
    assert got == {"77_exp.out": ("e/77/slurm.out", False), "5_0_exp.out": ("e/5/slurm.out", True), "5_1_exp.out": ("e/5/slurm.out", True), "watcher_9.log": ("e/9/watcher.log", False)}


def test_first_failure(spark):
    steps = spark.createDataFrame([("s", 0, 0), ("s", 1, 4), ("s", 2, 5), ("t", 0, 0)], "seq string, idx int, code int")
    got = {r.seq: (r.failed_at, r.exit_code) for r in guard.first_failure(steps, ["seq"]).collect()}
    assert got == {"s": (1, 4), "t": (None, 0)}


def test_job_from_start_to_end(spark):
    from trialbook.plans import running

    env = F.create_map(F.lit("SLURM_JOB_ID"), F.col("job"), F.lit("SLURM_ARRAY_JOB_ID"), F.lit("9"), F.lit("SLURM_ARRAY_TASK_ID"), F.col("task"))
    jobs = spark.createDataFrame([("a", "10", "1", "array", "01:00:00"), ("a", "11", "7", "array", "01:00:00"), ("s", "12", "", "seq", "01:00:00"), ("x", "13", "", "single", ""), ("o", "14", "", "single", "01:00:00")], "exp_name string, job string, task string, run_mode string, time_limit string")
    jobs = jobs.withColumn("env", env).withColumns({"project_root": F.lit("/p"), **{c: F.lit(True) for c in ("log_dir_ok", "link_ok", "helper_ok", "metadata_ok")}})
    ready, failed = running.bootstrapped(running.bound(jobs))
    assert {r.job_dir for r in ready.collect()} == {"9_1", "9_7", "12", "14"}
    assert failed.first().record["fail_reason"] == "MISSING_TIME_LIMIT"
    scripts = spark.createDataFrame([(e, "run", "one") for e in "asxo"], "exp_name string, base_command string, run_command string")
    grids = spark.createDataFrame([(e, 0, "--k", ["u", "v"]) for e in "as"], "exp_name string, pos int, arg string, values array<string>")
    got = sorted((r.job_dir, r.line, r.command) for r in running.commands(ready, scripts, grids).collect())
    assert got == [("12", 0, "run --k u"), ("12", 1, "run --k v"), ("14", 0, "one"), ("9_1", 0, "run --k v"), ("9_7", 0, None)]
    records = {r.job_dir: r.record for r in running.started(ready).collect()}
    assert records["9_1"]["array_task_id"] == "1" and "array_task_id" not in records["12"] and records["12"]["status"] == "RUNNING"
    ended = running.finished(spark.createDataFrame([("a", "9_1", "10", "RUNNING", "0", 1)], "exp_name string, job_dir string, job_id string, state string, code string, line int")).first()
    assert ended.status == "COMPLETED" and "FINISHED" in ended.payload
