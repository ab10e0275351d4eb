"""Lookups over the catalogue: newest, next, selected, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def experiments(listing: DataFrame) -> DataFrame:
    """Rows of a listing (column ``exp_name``) that are experiments, with their number and overflow flag."""
    n = F.col("exp_name")
    return listing.filter(names.is_experiment(n)).withColumn("exp_no", names.number(n)).withColumn("overflow", names.overflows(n))


def next_id(listing: DataFrame) -> DataFrame:
    """The greatest id and one; 0001 for an empty catalogue."""
    return experiments(listing).agg(names.padded(F.coalesce(F.max("exp_no"), F.lit(0)) + 1).alias("next_id"))


def latest(listing: DataFrame) -> DataFrame:
    """The experiment with the greatest id; equal ids by name."""
    return experiments(listing).agg(F.max_by("exp_name", F.struct("exp_no", "exp_name")).alias("exp_name"))


def newest(listing: DataFrame, n: int = 10) -> DataFrame:
    return listing.orderBy(F.desc("exp_name")).limit(n)


def select_one(listing: DataFrame, selector: str | None, loose: bool = False) -> DataFrame:
    """The experiment a selector means: id, name, or (``loose``) a part of a name; none means the latest."""
    if not selector or selector == "latest":
        return latest(listing)
    match = names.contains_selector if loose else names.selects
    return experiments(listing).filter(match(F.lit(selector), F.col("exp_name"))).orderBy("exp_name").limit(1).select("exp_name")


def with_outputs(exps: DataFrame, outputs: DataFrame) -> DataFrame:
    """Experiments beside their outputs, which may be absent."""
    return exps.join(outputs.withColumn("has_outputs", F.lit(True)), "exp_name", "left").fillna(False, ["has_outputs"])


def orphans(log_dirs: DataFrame, exps: DataFrame) -> DataFrame:
    """Log directories of experiments that no longer exist."""
    return log_dirs.filter("exp_name <> 'latest'").join(exps, "exp_name", "left_anti")


def accounting(rows: DataFrame, job: str) -> DataFrame:
    """The accounting row of exactly this job (not of its steps)."""
    return rows.filter(F.col("JobIDRaw") == job).orderBy("State").limit(1)


def owners(paths: DataFrame, table: DataFrame, path: str = "path") -> DataFrame:
    """Paths with the owner whose prefix they have, the longest one if several (the least owner if a prefix has several); null without any.

    An equi-join for each length that a prefix has; every row of ``paths`` stays one row.
    """
    by_prefix = table.filter("prefix is not null").groupBy("prefix").agg(F.min("owner").alias("_owner"))
    lengths = [r["n"] for r in by_prefix.select(F.length("prefix").alias("n")).distinct().orderBy(F.desc("n")).collect()]  # no more than a path has letters
    out, found = paths, F.lit(None).cast("string")
    for k, n in enumerate(lengths):
        here = by_prefix.filter(F.length("prefix") == n).select(F.col("prefix").alias(f"_prefix{k}"), F.col("_owner").alias(f"_owner{k}"))
        out = out.join(here, F.substring(F.col(path), 1, n) == F.col(f"_prefix{k}"), "left")
        found = F.coalesce(found, F.col(f"_owner{k}"))
    return out.select(*[paths[c] for c in paths.columns], found.alias("owner"))


def active_jobs(queue: DataFrame, user: Column) -> DataFrame:
    """A user's jobs without their tasks."""
    return queue.filter(F.col("user") == user).select(names.base_job(F.col("job_id")).alias("job_id")).distinct()


def lineage(exps: DataFrame) -> DataFrame:
    """Resumed experiments beside the experiment they resume."""
    parent = exps.select(F.col("exp_name").alias("resumed_from_exp"), F.col("created_date").alias("parent_created"), F.lit(True).alias("_known"))
    return exps.filter("resumed_from_exp is not null").join(parent, "resumed_from_exp", "left").withColumn("parent_known", F.coalesce("_known", F.lit(False))).drop("_known")


def dependencies(runs: DataFrame) -> DataFrame:
    """Runs beside the run they wait for (column ``after_job``)."""
    first = runs.select(F.col("job_id").alias("after_job"), F.col("exp_name").alias("after_exp"), F.col("status").alias("after_status"))
    return runs.filter("after_job is not null").join(first, "after_job", "left")


def all_ok(findings: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    return findings.groupBy(*by).agg(F.bool_and(ok).alias("all_ok"))


def key_difference(wanted: Column, known: Column) -> Column:
    """Distinct wanted keys that are not known."""
    return F.array_except(wanted, known)
