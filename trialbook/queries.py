"""The catalogue's operators as queries over the benchmark tables, each with the SQL it must equal.

The tables are not an experiment workspace; every query maps an operator's semantics onto columns of fitting shape
(names, states, paths, keys).  Queries that need no files or streams all have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import names, notices, states, texts, times
from .operators import catalog, evaluate, grid, guard
from .plans import cleanup, preflight
from .registry import ORACLES, QUERIES, query
from .registry import read as _read

__all__ = ["ORACLES", "QUERIES"]

AS_OF = "2024-01-31 12:00:00"
STOP_WORDS = ("the", "of", "and", "de", "la", "der", "und")


#: Event types as scheduler states, in Spark and in SQL.
_STATES = {"click": "COMPLETED", "view": "RUNNING", "purchase": "TIMEOUT", "signup": "CANCELLED by 1000", "error": "PREEMPTED"}


def _state(c="event_type"):
    out = F.when(F.lit(False), "")
    for k, v in _STATES.items():
        out = out.when(F.col(c) == k, v)
    return out.otherwise("UNKNOWN")


_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " ELSE 'UNKNOWN' END"
_STATUS = {"click": "COMPLETED", "view": "RUNNING", "purchase": "TIMEOUT", "signup": "CANCELLED", "error": "FAILED"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


def _status(c="event_type"):
    out = F.when(F.lit(False), "")
    for k, v in _STATUS.items():
        out = out.when(F.col(c) == k, v)
    return out


#: Parts as experiments.
_PARTS_SQL = "(SELECT p_partkey, printf('%04d', CAST(p_partkey AS BIGINT)) || '_20260101_' || replace(p_name, ' ', '_') AS exp_name FROM part)"


def _parts(spark, d):
    return _read(spark, d, "part").select("p_partkey", names.compose(names.padded(F.col("p_partkey")), F.lit("20260101"), F.translate("p_name", " ", "_")).alias("exp_name"))


@query("SELECT printf('%04d', CAST(max(p_partkey) + 1 AS BIGINT)) AS next_id FROM part")
def q_next_id(spark, d):
    return catalog.next_id(_parts(spark, d).select("exp_name"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id")
def q_latest_by_key(spark, d):
    return guard.latest_state(_read(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query(f"SELECT arg_max(exp_name, p_partkey) AS exp_name FROM {_PARTS_SQL}")
def q_latest_experiment(spark, d):
    return catalog.latest(_parts(spark, d).select("exp_name"))


@query(f"SELECT p_partkey, exp_name FROM {_PARTS_SQL} ORDER BY exp_name DESC LIMIT 10")
def q_top_n(spark, d):
    return catalog.newest(_parts(spark, d), 10)


_GRID_SQL = """
WITH p AS (SELECT o_orderpriority AS prio, row_number() OVER (ORDER BY o_orderpriority) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderpriority FROM orders)),
r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region),
g AS (SELECT CAST(i * n + j AS BIGINT) AS idx, '--region ' || r_name || ' --priority ' || prio AS opts FROM r, p)
"""


def _grid(spark, d):
    dims = _read(spark, d, "region").agg(F.lit(0).alias("pos"), F.lit("--region").alias("arg"), F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("values"))
    more = _read(spark, d, "orders").agg(F.lit(1).alias("pos"), F.lit("--priority").alias("arg"), F.array_sort(F.collect_set("o_orderpriority")).alias("values"))
    return dims.unionByName(more).withColumn("exp_name", F.lit("grid"))


@query(_GRID_SQL + "SELECT idx, opts FROM g")
def q_grid(spark, d):
    return grid.expand(_grid(spark, d)).select("idx", F.array_join("opts", " ").alias("opts"))


@query(_GRID_SQL + "SELECT idx, r_name, prio FROM (SELECT CAST(i * n + j AS BIGINT) AS idx, r_name, prio FROM r, p)")
def q_grid_cross(spark, d):
    prio = _read(spark, d, "orders").select(F.col("o_orderpriority").alias("prio")).distinct()
    return grid.cross([_read(spark, d, "region").select("r_regionkey", "r_name"), prio], [["r_regionkey"], ["prio"]]).select("idx", "r_name", "prio")


@query(_GRID_SQL + "SELECT event_id, idx, 'python run.py ' || opts AS command FROM events JOIN g ON event_id % 25 = idx")
def q_bind_task(spark, d):
    tasks = _read(spark, d, "events").select("event_id", (F.col("event_id") % 25).alias("task_id"))
    bound = grid.bind(tasks, grid.expand(_grid(spark, d)))
    return bound.select("event_id", "idx", texts.command(F.lit("python run.py"), F.array_join("opts", " ")).alias("command"))


@query(_GRID_SQL + "SELECT event_id, event_id % 27 AS task_id, 'TASK_INDEX_OUT_OF_RANGE' AS reason FROM events WHERE event_id % 27 NOT IN (SELECT idx FROM g)")
def q_unbound_task(spark, d):
    tasks = _read(spark, d, "events").select("event_id", (F.col("event_id") % 27).alias("task_id"))
    return grid.unbound(tasks, grid.expand(_grid(spark, d)))


@query("SELECT CAST(5 * count(DISTINCT o_orderpriority) AS BIGINT) AS n_configs, CAST(2 AS BIGINT) AS n_dimensions, CASE WHEN 5 * count(DISTINCT o_orderpriority) > 50 THEN 'blocker' WHEN 5 * count(DISTINCT o_orderpriority) > 20 THEN 'warning' ELSE 'ok' END AS verdict FROM orders")
def q_grid_count(spark, d):
    return grid.counts(_grid(spark, d)).drop("exp_name")


_FINAL_SQL = f"""
SELECT event_id,
 CASE WHEN s IN ('TIMEOUT', 'OUT_OF_MEMORY', 'NODE_FAIL') THEN s WHEN s LIKE 'CANCELLED%' THEN 'CANCELLED'
  WHEN s IN ('COMPLETED', 'RUNNING', 'COMPLETING', 'CONFIGURING', 'UNKNOWN') AND code = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
 CASE WHEN s = 'TIMEOUT' THEN 'SLURM_TIMEOUT' WHEN s IN ('OUT_OF_MEMORY', 'NODE_FAIL') THEN s WHEN s LIKE 'CANCELLED%' THEN 'CANCELLED'
  WHEN s IN ('COMPLETED', 'RUNNING', 'COMPLETING', 'CONFIGURING', 'UNKNOWN') AND code = 0 THEN NULL
  WHEN s = 'UNKNOWN' THEN 'NONZERO_EXIT_' || code || '_SCHEDULER_STATE_UNKNOWN'
  WHEN s IN ('COMPLETED', 'RUNNING', 'COMPLETING', 'CONFIGURING') THEN 'NONZERO_EXIT_' || code ELSE 'SCRIPT_ERROR_LINE_' || line || '_CODE_' || code END AS fail_reason,
 CASE WHEN s LIKE 'CANCELLED%' THEN 'fail_fast' WHEN s IN ('COMPLETED', 'RUNNING', 'COMPLETING', 'CONFIGURING', 'UNKNOWN') AND code = 0 THEN 'finish' ELSE 'fail' END AS notification
FROM (SELECT event_id, {_STATE_SQL} AS s, CAST(floor(abs(value)) AS BIGINT) % 3 AS code, user_id AS line FROM events)
"""


@query(_FINAL_SQL)
def q_final_state(spark, d):
    code = (F.floor(F.abs("value")).cast("long") % 3).cast("string")
    return _read(spark, d, "events").select("event_id", states.final_state(_state(), code, F.col("user_id")).alias("f")).select("event_id", "f.status", "f.fail_reason", "f.notification")


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN 'COMPLETED' WHEN k = 1 THEN
  CASE WHEN o_custkey % 7 = 0 THEN 'UNKNOWN' WHEN o_custkey % 7 = 1 THEN 'COMPLETED' WHEN o_custkey % 7 = 2 THEN 'TIMEOUT' WHEN o_custkey % 7 = 3 THEN 'OUT_OF_MEMORY'
   WHEN x = '271' THEN 'TIMEOUT' WHEN x = '137' THEN 'OUT_OF_MEMORY' WHEN x = '0' THEN 'COMPLETED' ELSE 'FAILED' END
  ELSE CASE WHEN o_custkey % 7 < 3 THEN o_orderpriority WHEN o_custkey % 7 < 5 THEN 'NODE_FAIL' ELSE 'UNKNOWN' END END AS state
FROM (SELECT *, o_orderkey % 3 AS k, CASE o_orderkey % 4 WHEN 0 THEN '271' WHEN 1 THEN '137' WHEN 2 THEN '0' ELSE '9' END AS x FROM orders)""")
def q_scheduler_state(spark, d):
    o = _read(spark, d, "orders")
    c, k = F.col("o_custkey") % 7, F.col("o_orderkey") % 3
    kind = F.when(k == 0, "local").when(k == 1, "pbs").otherwise("slurm")
    output = F.when(c == 1, "").otherwise("job report")
    comment = F.when(c == 2, "job killed: walltime exceeded").when(c == 3, "Out of memory")
    code = F.when(F.col("o_orderkey") % 4 == 0, "271").when(F.col("o_orderkey") % 4 == 1, "137").when(F.col("o_orderkey") % 4 == 2, "0").otherwise("9")
    control = F.when((c >= 3) & (c < 5), "JobId=1 JobState=NODE_FAIL Reason=None").otherwise("")
    return o.select("o_orderkey", states.scheduler_state(kind, c != 0, output, comment, code, F.when(c < 3, F.col("o_orderpriority")).otherwise(""), control).alias("state"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def q_status_filter(spark, d):
    return _read(spark, d, "events").filter(states.is_terminal_failure(_status())).select("event_id", "event_type")


@query(f"SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")
def q_stale(spark, d):
    last = _read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.filter(times.older_than(F.col("last_ts"), F.lit(AS_OF).cast("timestamp_ntz")))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_orphans(spark, d):
    logs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("exp_name"), "doc_id", "source")
    return catalog.orphans(logs, _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("exp_name"))).select("doc_id", "source")


def _requests(spark, d):
    requested = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("exp_name"), F.lit("default").alias("variant_key"), "o_orderkey")
    done = _read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("exp_name"), F.lit("default").alias("variant_key"), F.lit("completed").alias("status"), F.lit(False).alias("corrupt"))
    return requested, done


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_guard_skip(spark, d):
    return guard.to_skip(*_requests(spark, d)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_guard_run(spark, d):
    return guard.to_run(*_requests(spark, d)).select("o_orderkey")


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_outputs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_left_pair(spark, d):
    exps = _read(spark, d, "documents").select(F.col("doc_id").alias("exp_name"))
    return catalog.with_outputs(exps, _read(spark, d, "labels").select(F.col("doc_id").alias("exp_name"), "quality")).select(F.col("exp_name").alias("doc_id"), "quality", "has_outputs")


@query("""SELECT p_partkey, p_brand AS path, arg_max(o.owner, length(o.prefix)) AS owner FROM part
LEFT JOIN (VALUES ('Brand#1', 'ana'), ('Brand#2', 'ben'), ('Brand#23', 'cho'), ('Brand#3', 'dia')) o(prefix, owner) ON starts_with(p_brand, o.prefix) GROUP BY p_partkey, p_brand""")
def q_prefix_owner(spark, d):
    table = spark.createDataFrame([("Brand#1", "ana"), ("Brand#2", "ben"), ("Brand#23", "cho"), ("Brand#3", "dia")], "prefix string, owner string")
    return catalog.owners(_read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path")), table)


@query("SELECT o_orderkey FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')")
def q_prefix_match(spark, d):
    return _read(spark, d, "orders").filter(names.matches_job(F.col("o_orderkey").cast("string"), F.lit("12"), legacy_prefix=True)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderkey = 12 AS hit FROM orders")
def q_exact_match(spark, d):
    dirs = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("_0"))).otherwise(F.col("o_orderkey").cast("string"))
    return _read(spark, d, "orders").select("o_orderkey", names.matches_job(dirs, F.lit("12")).alias("hit"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS variant_key FROM pages")
def q_variant_key(spark, d):
    return _read(spark, d, "pages").select("page_id", names.variant_key(F.col("url")).alias("variant_key"))


@query("SELECT doc_id, 'org-' || lang || '__' || source AS variant_key FROM documents")
def q_compose_variant(spark, d):
    return _read(spark, d, "documents").select("doc_id", names.composed_variant(F.concat(F.lit("org/"), "lang"), F.col("source")).alias("variant_key"))


@query("SELECT p_partkey, regexp_replace(translate(p_name || ' v/1.0', ' /', '__'), '[^A-Za-z0-9_-]', '', 'g') AS label FROM part")
def q_sanitize(spark, d):
    return _read(spark, d, "part").select("p_partkey", names.sanitize(F.concat("p_name", F.lit(" v/1.0"))).alias("label"))


@query("SELECT doc_id, '#' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS color FROM documents")
def q_color(spark, d):
    return _read(spark, d, "documents").select("doc_id", names.color(F.col("doc_id").cast("string")).alias("color"))


@query("""SELECT event_id, strftime(ts, '%H:%M:%S') AS limit_text, h * 60 + m AS minutes,
 CASE WHEN h * 60 + m <= 60 THEN 'small' WHEN h * 60 + m <= 120 THEN 'medium' WHEN h * 60 + m <= 240 THEN 'large' ELSE 'x-large' END AS scale,
 greatest(CAST(floor((h * 3600 + m * 60 + s) / 100) AS BIGINT), 30) AS margin
FROM (SELECT event_id, ts, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(floor(second(ts)) AS BIGINT) AS s FROM events)""")
def q_time_bucket(spark, d):
    limit = times.clock(F.col("ts"))
    return _read(spark, d, "events").select("event_id", limit.alias("limit_text"), times.minutes(limit).alias("minutes"), times.scale(limit).alias("scale"), times.margin(limit).alias("margin"))


_NAMED = """(SELECT doc_id, printf('%04d', CAST(doc_id AS BIGINT)) || '_20260101_' || source || CASE doc_id % 4 WHEN 1 THEN '_FAILED_20260102_oom' WHEN 2 THEN '_FAILED_20260102_oom_FAILED_20260103_disk' WHEN 3 THEN '_retry' ELSE '' END AS n FROM documents)"""


def _named(spark, d):
    n = F.col("doc_id") % 4
    tail = F.when(n == 1, "_FAILED_20260102_oom").when(n == 2, "_FAILED_20260102_oom_FAILED_20260103_disk").when(n == 3, "_retry").otherwise("")
    return _read(spark, d, "documents").select("doc_id", F.concat(names.compose(names.padded(F.col("doc_id")), F.lit("20260101"), F.col("source")), tail).alias("n"))


@query(f"SELECT doc_id, regexp_extract(n, '^([0-9]+)_', 1) AS exp_id, CAST(regexp_extract(n, '^([0-9]+)_', 1) AS INTEGER) AS exp_no, '20260101' AS exp_date, regexp_extract(n, '^[0-9]+_[0-9]+_(.*)$', 1) AS body, contains(n, '_FAILED_') AS failed FROM {_NAMED}")
def q_name_parts(spark, d):
    at = _named(spark, d)
    return at.select("doc_id", names.parts(F.col("n")).alias("p"), names.number(F.col("n")).alias("exp_no"), names.is_failed(F.col("n")).alias("failed")).select("doc_id", "p.*", "exp_no", "failed")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(n, '^[0-9]+_[0-9]+_', ''), '_FAILED_.*$', ''), '_(resumed|retry|resume)$', '') || '_resumed' AS label FROM {_NAMED}")
def q_resumed_label(spark, d):
    return _named(spark, d).select("doc_id", names.resumed_label(F.col("n")).alias("label"))


@query(f"SELECT doc_id, printf('%04d', CAST(doc_id AS BIGINT)) || '_20260101_newname' || regexp_extract(n, '^.*(_FAILED_.*)$', 1) AS renamed, n || '_FAILED_20260301_no_disk' AS failed FROM {_NAMED}")
def q_renamed(spark, d):
    n = F.col("n")
    return _named(spark, d).select("doc_id", names.renamed(n, F.lit("newname!")).alias("renamed"), names.failed_name(n, F.lit("20260301"), F.lit("no disk")).alias("failed"))


@query("""SELECT event_id, title, value, pos FROM (
 SELECT event_id, 'USER' AS title, CAST(user_id AS VARCHAR) AS value, 0 AS pos FROM events UNION ALL SELECT event_id, 'TYPE', event_type, 1 FROM events)""")
def q_fields(spark, d):
    text = F.concat(F.lit("USER : "), F.col("user_id").cast("string"), F.lit("\nTYPE : "), "event_type", F.lit(" : more"))
    return _read(spark, d, "events").select("event_id", F.posexplode(notices.parse_fields(text)).alias("pos", "f")).select("event_id", "f.title", "f.value", "pos")


@query("""SELECT event_id, 'EXP : ' || event_type || chr(10) || 'JOB : ' || user_id || chr(10) || 'STATE : ' || event_type || chr(10) || 'TASK : ' || (user_id % 10 + 1) || '/10' AS fields FROM events""")
def q_notice_fields(spark, d):
    task = notices.progress((F.col("user_id") % 10).cast("string"), F.lit("10"))
    values = {"EXP": F.col("event_type"), "JOB": F.col("user_id").cast("string"), "STATE": F.col("event_type")}
    return _read(spark, d, "events").select("event_id", notices.fields("fail", values, task, F.lit("")).alias("fields"))


@query("SELECT DISTINCT doc_id, w AS missing FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'und')")
def q_key_diff(spark, d):
    wanted = F.split("text", " ")
    return _read(spark, d, "documents").select("doc_id", F.explode(catalog.key_difference(wanted, F.array(*map(F.lit, STOP_WORDS)))).alias("missing"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS k, 'completed' AS status FROM events")
def q_map_upsert(spark, d):
    base = F.from_json("props", "map<string,string>")
    over = F.create_map(F.lit("k"), F.col("user_id").cast("string"))
    return _read(spark, d, "events").select("event_id", guard.completed_record(guard.right_union(base, over), F.col("ts")).alias("r")).select("event_id", F.col("r")["k"].alias("k"), F.col("r")["status"].alias("status"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def q_metadata_fold(spark, d):
    log = _read(spark, d, "events").select("user_id", F.col("event_type").alias("key"), "value", F.col("event_id").alias("seq"))
    out = guard.fold(log, ["user_id"])
    return out.select("user_id", *[F.try_element_at("record", F.lit(k)).alias(k) for k in ("click", "view")])


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_distinct(spark, d):
    return _read(spark, d, "events").select("user_id", "event_type").distinct()


@query("SELECT l_orderkey, bool_and(l_quantity < 45) AS all_ok FROM lineitem GROUP BY l_orderkey")
def q_and_reduce(spark, d):
    return catalog.all_ok(_read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") < 45).alias("ok")), ["l_orderkey"])


@query("""SELECT user_id, min(event_id) FILTER (code <> 0) AS failed_at, coalesce(arg_min(code, event_id) FILTER (code <> 0), 0) AS exit_code, count(*) AS n_steps
FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 + CAST(floor(abs(value)) AS BIGINT) % 5 ELSE 0 END AS code FROM events) GROUP BY user_id""")
def q_first_failure(spark, d):
    code = F.when(F.col("event_type") == "error", 1 + F.floor(F.abs("value")).cast("long") % 5).otherwise(F.lit(0).cast("long"))
    return guard.first_failure(_read(spark, d, "events").select("user_id", F.col("event_id").alias("idx"), code.alias("code")), ["user_id"])


@query("""SELECT page_id, 'direct_write' AS "check", 'blocker' AS severity, 'open("outputs/' || page_id || '"' AS detail FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'config_match', 'blocker', 'beta' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'grid_size', CASE WHEN n > 50 THEN 'blocker' ELSE 'warning' END, 'grid has ' || n || ' combinations' || CASE WHEN n > 50 THEN ', more than 50' ELSE '' END FROM (SELECT page_id, 3 * (page_id % 20 + 1) AS n FROM pages) WHERE n > 20""")
def q_findings(spark, d):
    p = F.col("page_id")
    values = F.array_join(F.transform(F.sequence(F.lit(0), (p % 20).cast("int")), lambda k: k.cast("string")), " ")
    work = _read(spark, d, "pages").select(
        p.cast("string").alias("exp_name"),
        F.concat(F.lit('RUN_MODE="seq"\n#RUN_MODE="array"\nGRID_ARGS=("--a" "--b")\nGRID_VALUES=(\n"x y z"\n"'), values, F.lit('"\n)\n')).alias("run_slurm"),
        F.concat(F.lit("a = config['alpha']\nb = config.get('beta', 1)\n"), F.when(p % 3 == 0, F.concat(F.lit('open("outputs/'), p.cast("string"), F.lit('")\n'))).otherwise(F.lit('open("tmp/x")\n'))).alias("experiment_py"),
        F.concat(F.lit("alpha: 1\n# gamma: 2\n"), F.when(p % 2 == 1, "beta: 2\n").otherwise("  beta: 2\n")).alias("config_yml"),
    )
    return preflight.findings(work).select(F.col("exp_name").cast("long").alias("page_id"), "check", "severity", "detail")


@query("""SELECT doc_id, regexp_extract(t, '--time=([^ ]+)', 1) AS time_limit, '# #SBATCH --dependency=afterok:' || doc_id AS dependency, CAST(doc_id % 50 AS BIGINT) AS bound FROM (SELECT doc_id, '--time=' || printf('%02d', CAST(doc_id % 100 AS BIGINT)) || ':30:00 ' AS t FROM documents)""")
def q_directives(spark, d):
    i = F.col("doc_id")
    script = F.concat(F.lit("#!/bin/bash\n# #SBATCH --time=99:00:00\n#SBATCH --time="), F.format_string("%02d", i % 100), F.lit(":30:00\n#SBATCH --dependency=afterok:"), i.cast("string"), F.lit("\n#SBATCH --array=0-"), (i % 50).cast("string"), F.lit("%4\n"))
    off = texts.without_dependency(script)
    return _read(spark, d, "documents").select("doc_id", texts.time_directive(script).alias("time_limit"), F.regexp_extract(off, r"(?m)^(# #SBATCH --dependency=.*)$", 1).alias("dependency"), texts.array_bound(script).alias("bound"))


@query("SELECT doc_id, lang AS status, source AS exp_name, printf('%04d', CAST(doc_id AS BIGINT)) AS exp_id, CAST(NULL AS VARCHAR) AS file FROM documents")
def q_yaml_values(spark, d):
    text = F.concat(F.lit("exp_id: "), names.padded(F.col("doc_id")), F.lit("\nstatus: x\nstatus: '"), "lang", F.lit("'\nexp_name: \""), "source", F.lit('"\nfile: null\n'))
    m = texts.yaml_map(text)
    return _read(spark, d, "documents").select("doc_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("status", "exp_name", "exp_id", "file")])


@query("SELECT event_id, event_id % 3 = 0 AS corrupt, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def q_tolerant_json(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("{"))).otherwise(F.col("props"))
    return _read(spark, d, "events").select("event_id", texts.json_map(text).alias("m")).select("event_id", F.col("m").isNull().alias("corrupt"), F.try_element_at("m", F.lit("k")).alias("k"))


@query("SELECT src, dst, count(*) OVER (PARTITION BY dst) > 1 AS collides FROM (SELECT CAST(o_custkey AS VARCHAR) || '_' || o_orderkey || '_run.out' AS src, 'logs/' || o_custkey || '/slurm.out' AS dst FROM orders)")
def q_tidy_logs(spark, d):
    files = _read(spark, d, "orders").select(F.lit("logs").alias("exp_name"), F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("run.out")).alias("file"))
    return cleanup.tidied_logs(files).select("src", "dst", "collides")


_BOOT = ("MISSING_PROJECT_ROOT", "MISSING_EXP_NAME", "INVALID_RUN_MODE", "LOG_DIRECTORY_CREATION_FAILED", "LATEST_LOG_LINK_FAILED", "NOTIFICATION_HELPER_LOAD_FAILED", "MISSING_TIME_LIMIT", "METADATA_INITIALIZATION_FAILED")


@query("SELECT c_custkey, CASE c_custkey % 9 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_BOOT)) + " END AS reason FROM customer")
def q_bootstrap_reason(spark, d):
    k = F.col("c_custkey") % 9
    text = lambda n: F.when(k == n, "").otherwise("set")
    mode = F.when(k == 2, "batch").otherwise("array")
    return _read(spark, d, "customer").select("c_custkey", states.bootstrap_reason(text(0), text(1), mode, k != 3, k != 4, k != 5, text(6), k != 7).alias("reason"))


@query("""WITH e AS (SELECT c_custkey, c_custkey % 6 AS k, CAST(c_custkey AS VARCHAR) AS id FROM customer)
SELECT c_custkey, CASE WHEN k < 2 THEN 'pbs' WHEN k < 4 THEN 'slurm' ELSE 'local' END AS scheduler,
 CASE k WHEN 0 THEN id || '[3]' WHEN 1 THEN id WHEN 2 THEN id WHEN 3 THEN id WHEN 4 THEN '77' ELSE 'local' END AS job_id,
 CASE k WHEN 0 THEN id WHEN 2 THEN '9' ELSE '' END AS array_job_id, CASE k WHEN 0 THEN '3' WHEN 2 THEN '7' ELSE '' END AS task_id,
 CASE k WHEN 0 THEN 'q1' WHEN 1 THEN 'unknown' WHEN 2 THEN 'p1' WHEN 3 THEN 'unknown' ELSE 'local' END AS partition,
 CASE k WHEN 0 THEN 'h1' WHEN 1 THEN 'h1' WHEN 2 THEN 'n1' WHEN 3 THEN 'unknown' WHEN 4 THEN 'h1' ELSE 'unknown' END AS node,
 CASE k WHEN 0 THEN '1' WHEN 1 THEN id || '.server' WHEN 2 THEN id WHEN 3 THEN id ELSE '' END AS recorded
FROM e""")
def q_job_environment(spark, d):
    id_, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    env = lambda **x: F.create_map(*[c for key, v in x.items() for c in (F.lit(key), F.lit(v) if isinstance(v, str) else v)])
    envs = [
        env(PBS_JOBID=F.concat(id_, F.lit("[3].server")), PBS_ARRAY_INDEX="3", PBS_QUEUE="q1", HOSTNAME="h1", SLURM_JOB_ID="1"),
        env(PBS_JOBID=F.concat(id_, F.lit(".server")), HOSTNAME="h1", SLURM_JOB_ID=""),
        env(SLURM_JOB_ID=id_, SLURM_ARRAY_JOB_ID="9", SLURM_ARRAY_TASK_ID="7", SLURM_JOB_PARTITION="p1", SLURMD_NODENAME="n1", HOSTNAME="h1"),
        env(SLURM_JOB_ID=id_, PBS_JOBID="", PBS_ARRAY_INDEX="5", HOSTNAME="h1"),
        env(HOSTNAME="h1", PID="77"),
        env(SLURM_ARRAY_TASK_ID="7"),
    ]
    chosen = envs[-1]
    for i, e in enumerate(envs[:-1]):
        chosen = F.when(k == i, e).otherwise(chosen)
    return _read(spark, d, "customer").select("c_custkey", states.job_environment(chosen).alias("e"), states.recorded_job_id(chosen).alias("recorded")).select("c_custkey", "e.*", "recorded")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 12 THEN 'CANCELLED' ELSE o_orderstatus END AS status, CASE WHEN o_custkey = 12 THEN 'budget' END AS cancel_reason, o_custkey = 12 AS cancel_requested FROM orders")
def q_cancel(spark, d):
    from .plans import lifecycle

    runs = _read(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.col("o_custkey").cast("string"), F.lit("0")).alias("job_dir"), F.col("o_orderstatus").alias("status"))
    return lifecycle.cancel(runs, "12", "budget", "me").select("o_orderkey", "status", "cancel_reason", "cancel_requested")


@query("SELECT c.c_custkey, c.c_name AS exp_name, c.up AS resumed_from_exp, p.c_custkey IS NOT NULL AS parent_known FROM (SELECT *, 'Customer#' || CASE WHEN c_custkey % 5 = 1 THEN 'gone' ELSE printf('%09d', CAST(c_custkey // 2 AS BIGINT)) END AS up FROM customer WHERE c_custkey > 1) c LEFT JOIN customer p ON p.c_name = c.up")
def q_lineage(spark, d):
    up = F.concat(F.lit("Customer#"), F.when(F.col("c_custkey") % 5 == 1, "gone").otherwise(F.format_string("%09d", F.floor(F.col("c_custkey") / 2))))
    exps = _read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("exp_name"), F.when(F.col("c_custkey") > 1, up).alias("resumed_from_exp"), F.lit("20260101").alias("created_date"))
    return catalog.lineage(exps).select("c_custkey", "exp_name", "resumed_from_exp", "parent_known")


_PLAN_SQL = f"""
WITH last AS (SELECT user_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status, max(ts) AS mtime FROM events GROUP BY user_id),
jobs AS (SELECT user_id, CASE WHEN status IN ('FAILED', 'TIMEOUT', 'OUT_OF_MEMORY', 'NODE_FAIL', 'CANCELLED') THEN 'FAILED_RUN'
  WHEN status = 'RUNNING' AND mtime < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS THEN 'HUNG_RUN' END AS reason FROM last)
SELECT 'logs/' || user_id % 50 || '/' || user_id AS path, 'job' AS level, reason FROM jobs WHERE reason IS NOT NULL
UNION ALL SELECT 'logs/' || d.doc_id, 'experiment', 'ORPHANED_LOGS' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


@query(_PLAN_SQL)
def q_cleanup_plan(spark, d):
    events = _read(spark, d, "events").withColumn("status", _status())
    last = events.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("mtime"))
    runs = last.select((F.col("user_id") % 50).cast("string").alias("exp_name"), F.col("user_id").cast("string").alias("job_dir"), "status", "mtime")
    dirs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("exp_name"))
    exps = _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("exp_name"))
    return cleanup.failed_logs(runs, dirs, exps, F.lit(AS_OF).cast("timestamp_ntz"))


@query("""WITH x AS (SELECT l.quality AS t, CAST(d.n_chars > 1000 AS INTEGER) AS g FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT k, sum(CAST(t = k AND g = k AS INTEGER)) AS hit, sum(CAST(t = k AS INTEGER)) AS t, sum(CAST(g = k AS INTEGER)) AS g FROM x, (SELECT DISTINCT k FROM (SELECT t AS k FROM x UNION ALL SELECT g FROM x)) GROUP BY k)
SELECT round(sum(hit) / sum(t), 6) AS accuracy, round(avg(2.0 * hit / (t + g)), 6) AS macro_f1 FROM c""")
def q_macro_f1(spark, d):
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents"), "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("guess"))
    return evaluate.macro_f1(rows, "quality", "guess")


# The queries of plans, of files and of streams register themselves.
from . import plan_queries, source_queries  # noqa: E402, F401
