"""Notification payloads, built and never sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import color

# Fields, emoji, title and switch of each event.
FIELDS = {"start": ("EXP", "JOB", "PART", "TIME"), "finish": ("EXP", "JOB"), "fail": ("EXP", "JOB", "STATE"), "fail_fast": ("EXP", "JOB", "STATE")}
TITLES = {"start": "🚀 STARTED", "finish": "✅ FINISHED", "fail": "❌ FAILED", "fail_fast": "⚡ INTERRUPTED"}
SWITCHES = {"start": "SLACK_NOTIFY_ON_START", "finish": "SLACK_NOTIFY_ON_FINISH", "fail": "SLACK_NOTIFY_ON_FAIL", "fail_fast": "SLACK_NOTIFY_ON_FAIL"}
EVENTS = tuple(FIELDS)


def _or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def parse_fields(text: Column) -> Column:
    """Lines ``TITLE : value`` as structs; text after a second separator is left out, a line without one has no value, an
    empty line has neither, and an empty text has no lines."""

    def one(line: Column) -> Column:
        at = F.split(line, " : ")
        return F.struct(F.when(line != "", F.get(at, F.lit(0))).alias("title"), F.get(at, F.lit(1)).alias("value"), F.lit(True).alias("short"))

    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")), one)


def progress(task: Column, total: Column) -> Column:
    """``TASK : 3/10`` counted from one; a task that is not a number, and an absent total, are ``unknown``."""
    place = F.when(task.rlike(r"^[0-9]+$"), (task.try_cast("long") + 1).cast("string")).otherwise("unknown")
    return F.concat(F.lit("TASK : "), place, F.lit("/"), _or_unknown(total))


def array_fields(mode: Column, task: Column, total: Column, options: Column) -> Column:
    """Progress and options of an array task; empty in other modes."""
    lines = F.concat(progress(task, total), F.lit("\nOPTS : "), _or_unknown(options))
    return F.when(mode == "array", lines).otherwise("")


def fields(event: str, values: dict[str, Column], task: Column | None = None, extra: Column | None = None) -> Column:
    """The event's fields as text, with an array task's lines and extra ones when they are not empty."""
    shown = lambda title: F.coalesce(values[title], F.lit("")) if title == "STATE" else _or_unknown(values[title])
    lines = [F.concat(F.lit(f"{title} : "), shown(title)) for title in FIELDS[event]]
    more = [F.nullif(c, F.lit("")) for c in (task, extra) if c is not None]
    return F.concat_ws("\n", *lines, *more)


def payload(event: str, job: Column, text: Column) -> Column:
    """The JSON body of an event's notification."""
    attachment = F.struct(color(_or_unknown(job)).alias("color"), parse_fields(text).alias("fields"))
    return F.to_json(F.struct(F.lit(TITLES[event]).alias("text"), F.array(attachment).alias("attachments")), {"ignoreNullFields": "false"})


def wanted(event: str, flags: Column) -> Column:
    """Events are on where their switch is 1, unset or empty."""
    return F.coalesce(F.nullif(F.try_element_at(flags, F.lit(SWITCHES[event])), F.lit("")), F.lit("1")) == "1"


def notifications(events: DataFrame) -> DataFrame:
    """(event, flags, exp_name, job_id, partition, time_limit, state, run_mode, task_id, total, options, extra) -> the same with
    the payload, for the events that are switched on."""
    values = {"EXP": F.col("exp_name"), "JOB": F.col("job_id"), "PART": F.col("partition"), "TIME": F.col("time_limit"), "STATE": F.col("state")}
    lines = array_fields(F.col("run_mode"), F.col("task_id"), F.col("total"), F.col("options"))
    on, body = F.lit(False), F.lit(None).cast("string")
    for event in EVENTS:
        here = F.col("event") == event
        on = on | (here & wanted(event, F.col("flags")))
        body = F.when(here, payload(event, F.col("job_id"), fields(event, values, lines, F.col("extra")))).otherwise(body)
    return events.filter(on).withColumn("payload", body)
