import pytest
from pyspark.sql import functions as F

from trialbook.functions import names, notices, states, texts, times


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(x):
    return F.lit(x) if x is not None else F.lit(None).cast("string")


T1 = [
    ("TIMEOUT", "0", "TIMEOUT", "SLURM_TIMEOUT", None, "fail"),
    ("OUT_OF_MEMORY", "1", "OUT_OF_MEMORY", "OUT_OF_MEMORY", None, "fail"),
    ("CANCELLED by 1000", "0", "CANCELLED", "CANCELLED", None, "fail_fast"),
    ("NODE_FAIL", "0", "NODE_FAIL", "NODE_FAIL", None, "fail"),
    *[(s, "0", "COMPLETED", None, None, "finish") for s in ("COMPLETED", "RUNNING", "COMPLETING", "CONFIGURING")],
    *[(s, "3", "FAILED", "NONZERO_EXIT_3", None, "fail") for s in ("COMPLETED", "RUNNING", "COMPLETING", "CONFIGURING")],
    ("UNKNOWN", "0", "COMPLETED", None, "UNKNOWN", "finish"),
    ("", "0", "COMPLETED", None, "UNKNOWN", "finish"),
    (None, "2", "FAILED", "NONZERO_EXIT_2_SCHEDULER_STATE_UNKNOWN", "UNKNOWN", "fail"),
    ("PREEMPTED", "1", "FAILED", "SCRIPT_ERROR_LINE_9_CODE_1", None, "fail"),
]


@pytest.mark.parametrize("state,code,status,reason,extra,note", T1)
def test_final_state(spark, state, code, status, reason, extra, note):
    f = one(spark, f=states.final_state(lit(state), lit(code), F.lit(9))).f
    assert (f.status, f.fail_reason, f.scheduler_state, f.notification, f.bad_code) == (status, reason, extra, note, False)


def test_unreadable_code_fails(spark):
    f = one(spark, f=states.final_state(F.lit("RUNNING"), F.lit("warning 0"), F.lit(1))).f
    assert f.status == "FAILED" and f.bad_code


T2 = [
    ("local", None, None, None, None, None, None, "COMPLETED"),
    ("pbs", False, "x", None, None, None, None, "UNKNOWN"),
    ("pbs", True, "", None, None, None, None, "COMPLETED"),
    ("pbs", True, "x", "Job exceeded WALLTIME", "1", None, None, "TIMEOUT"),
    ("pbs", True, "x", "killed: out of memory", "1", None, None, "OUT_OF_MEMORY"),
    ("pbs", True, "x", None, "271", None, None, "TIMEOUT"),
    ("pbs", True, "x", None, "137", None, None, "OUT_OF_MEMORY"),
    ("pbs", True, "x", None, "0", None, None, "COMPLETED"),
    ("pbs", True, "x", None, None, None, None, "COMPLETED"),
    ("pbs", True, "x", None, "5", None, None, "FAILED"),
    ("slurm", None, None, None, None, "FAILED", "JobState=RUNNING", "FAILED"),
    ("slurm", None, None, None, None, "", "a JobState=RUNNING b", "RUNNING"),
    ("slurm", None, None, None, None, None, None, "UNKNOWN"),
]


@pytest.mark.parametrize("scheduler,tool,output,comment,code,acct,control,want", T2)
def test_scheduler_state(spark, scheduler, tool, output, comment, code, acct, control, want):
    has = F.lit(tool).cast("boolean")
    assert one(spark, s=states.scheduler_state(lit(scheduler), has, lit(output), lit(comment), lit(code), lit(acct), lit(control))).s == want


def test_missing_status_is_kept(spark):
    assert one(spark, x=states.is_terminal_failure(lit(None))).x is False


@pytest.mark.parametrize("limit,scale,margin", [
    ("00:10:00", "small", 30), ("01:00:00", "small", 36), ("01:00:59", "small", 36), ("01:01:00", "medium", 36), ("02:00:00", "medium", 72),
    ("04:00:00", "large", 144), ("04:00:01", "large", 144), ("04:01:00", "x-large", 144), ("196:00:00", "x-large", 7056), ("1-00:00:00", None, None),
])
def test_limits(spark, limit, scale, margin):
    r = one(spark, s=times.scale(F.lit(limit)), m=times.margin(F.lit(limit)), n=times.seconds(F.lit(limit)))
    assert r.s == scale and (r.m == margin if margin else r.n is None)


def test_names(spark):
    name = "0002_20260102_train_x_FAILED_20260103_oom_FAILED_20260104_disk"
    r = one(spark, p=names.parts(F.lit(name)), n=names.number(F.lit("0010_x")), pad=names.padded(F.lit(10000)), tail=names.failure_tail(F.lit(name)),
            resumed=names.resumed_label(F.lit(name)), again=names.resumed_label(F.lit("0001_20260101_a_retry"), F.lit("")), ren=names.renamed(F.lit(name), F.lit("new name/x!")),
            key=names.variant_key(F.lit("google/gemma-x")), back=names.variant_key(F.lit("a\\b")), end=names.variant_key(F.lit("a/")),
            sel=names.selects(F.lit("8"), F.lit("0008_20260101_a")), zero=names.selects(F.lit("0010"), F.lit("0010_b")), over=names.overflows(F.lit("10000_x")))
    assert tuple(r.p) == ("0002", "20260102", "train_x_FAILED_20260103_oom_FAILED_20260104_disk")
    assert (r.n, r.pad, r.tail) == (10, "10000", "_FAILED_20260104_disk")
    assert (r.resumed, r.again) == ("train_x_resumed", "a_resumed")
    assert r.ren == "0002_20260102_new_name_x_FAILED_20260104_disk"
    assert (r.key, r.back, r.end) == ("gemma-x", "b", "")
    assert r.sel and r.zero and r.over


def test_job_matching(spark):
    dirs = ["12", "12_0", "123", "1"]
    got = [one(spark, a=names.matches_job(F.lit(d), F.lit("12")), b=names.matches_job(F.lit(d), F.lit("12"), True)) for d in dirs]
    assert [r.a for r in got] == [True, True, False, False] and [r.b for r in got] == [True, True, True, False]


def test_yaml(spark):
    text = "exp_id: 0010\nlimit: 196:00:00\nname: 'a: b'\nq: \"x\"\nempty: null\nexp_id: 0011\n  nested: 1\n# c: 2\n"
    m = one(spark, m=texts.yaml_map(F.lit(text))).m
    assert m == {"exp_id": "0011", "limit": "196:00:00", "name": "a: b", "q": "x", "empty": None}
    assert one(spark, m=texts.yaml_map(lit(None))).m == {}


def test_json(spark):
    r = one(spark, a=texts.json_map(F.lit('{"status": "completed", "n": 1}')), b=texts.json_map(F.lit('{"a": ')), c=texts.json_map(F.lit('{"a": 1}{')))
    assert r.a == {"status": "completed", "n": "1"} and r.b is None and r.c is None


def test_notices(spark):
    f = one(spark, f=notices.parse_fields(F.lit("STATE : a : b\nnothing\n"))).f
    assert [(x.title, x.value, x.short) for x in f] == [("STATE", "a", True), ("nothing", None, True), (None, None, True)]
    r = one(spark, a=notices.progress(F.lit("0"), F.lit("6")), b=notices.progress(F.lit("x"), F.lit("6")), c=notices.progress(lit(None), F.lit("6")), on=notices.wanted("fail_fast", F.create_map(F.lit("SLACK_NOTIFY_ON_FAIL"), F.lit("0"))), grey=names.color(lit(None)))
    assert (r.a, r.b, r.c, r.on, r.grey) == ("TASK : 1/6", "TASK : unknown/6", "TASK : unknown/6", False, "#808080")
