import json
import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from trialbook import source_queries
from trialbook.sources import workspace as w
from trialbook.streaming import runs as stream


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("ws")

    def put(path, text):
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("experiments/0010_20260101_a/metadata.yaml", "exp_id: 0010\nexp_name: 0010_20260101_a\ncreated_date: 20260101\ngit_commit: abc\n")
    put("experiments/0010_20260101_a/config.yml", "lr: 0.1\nseed: 7\n")
    put("experiments/0010_20260101_a/run_slurm.sh", "#SBATCH --time=196:00:00\n")
    (base / "experiments/0011_20260102_empty").mkdir()
    os.symlink(base / "experiments/0010_20260101_a", base / "experiments/latest")
    put("outputs/0010_20260101_a/v1/completion.json", json.dumps({"status": "completed", "started_at": "2026-01-01T00:00:00", "lr": "0.1"}, indent=2))
    put("outputs/0010_20260101_a/v2/completion.json", '{"status": ')
    put("logs/0010_20260101_a/12_0/run_metadata.yaml", "status: 'FAILED'\njob_id: 99\ntime_limit: 196:00:00\n")
    put("logs/0010_20260101_a/13/run_metadata.yaml", 'status: "RUNNING"\n')
    put("logs/0010_20260101_a/13/command.sh", "python a.py\n\npython b.py\n")
    os.symlink(base / "logs/0010_20260101_a/13", base / "logs/0010_20260101_a/latest")
    put("logs/0010_20260101_a/77_exp.out", "x")
    put("reports/1.txt", "Job Id: 1\n    comment = Job killed: walltime\n    Exit_status = 271\n")
    put("acct.txt", "JobIDRaw|State\n1|COMPLETED\n1.batch|FAILED\n")
    return f"file://{base}"


def test_tables(spark, root):
    exps = {r.exp_name: r for r in w.experiments(spark, root).collect()}
    assert set(exps) == {"0010_20260101_a", "0011_20260102_empty"}
    assert exps["0010_20260101_a"].exp_id == "0010" and exps["0011_20260102_empty"].exp_id is None
    got = {r.variant_key: r for r in w.variants(spark, root).collect()}
    assert got["v1"].status == "completed" and got["v1"].extra == {"lr": "0.1"} and got["v2"].corrupt
    runs = {r.job_dir: r for r in w.runs(spark, root).collect()}
    assert set(runs) == {"12_0", "13"} and runs["12_0"].status == "FAILED" and runs["12_0"].time_limit == "196:00:00"
    assert [r.command for r in w.commands(spark, root).orderBy("line").collect()] == ["python a.py", "python b.py"]
    assert w.configs(spark, root).filter("exp_name like '0010%'").first().seed == 7
    assert w.configs(spark, root).filter("exp_name like '0011%'").first().seed == 42
    assert w.time_limits(spark, root).filter("time_limit is not null").first().time_limit == "196:00:00"
    assert [r.file for r in w.loose_logs(spark, root).collect()] == ["77_exp.out"]
    assert w.failures(spark, root).count() == 0


def test_scheduler_snapshots(spark, root):
    from trialbook.operators import catalog

    assert w.pbs_reports(spark, f"{root}/reports/*.txt").first().state == "TIMEOUT"
    assert catalog.accounting(w.accounting(spark, f"{root}/acct.txt"), "1").first().State == "COMPLETED"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    for kind in ("parquet", "orc", "csv", "json"):
        w.write_table(df, f"{tmp_path}/t.{kind}", kind)
        assert w.table(spark, f"{tmp_path}/t.{kind}").count() == 2
    w.append_events(df, f"{tmp_path}/e.json")
    w.append_events(df, f"{tmp_path}/e.json")
    assert w.table(spark, f"{tmp_path}/e.json").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    from trialbook.operators import guard

    rows = [(f"r{k % 5}", ("RUNNING", "FAILED", "COMPLETED")[(k * 7) % 3], k) for k in range(40)]
    events = spark.createDataFrame(rows, "run_id string, status string, seq long")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("run_id string, status string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.states(source, hours=None).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.run_id: r.status for r in spark.table("states").groupBy("run_id").agg(F.max_by("status", "seq").alias("status")).collect()}
    assert got == {r.run_id: r.status for r in guard.latest_state(events, ["run_id"], "status", ["seq"]).collect()}


def test_stream_of_submissions(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01' as ts, 'e' as exp_name, id % 2 as variant_key from range(6)").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, exp_name string, variant_key long").parquet(f"{tmp_path}/in")
    q = stream.submissions(source).writeStream.format("memory").queryName("subs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("subs").count() == 2


def test_stream_rows_stay_off_the_driver(spark):
    """A stream's rows are files that executors wrote, all of them and no other column."""
    got = source_queries.q_stream_final_states(spark, DATA)
    assert got.inputFiles() and got.columns == ["event_id", "status", "fail_reason"]
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in events.collect())
