"""Checks of experiments before submission: grid size, configuration keys, direct writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..operators.grid import BLOCK_ABOVE, WARN_ABOVE

FINDING = ("exp_name", "check", "severity", "detail")


def grid_counts(script: Column) -> tuple[Column, Column]:
    """Combinations of a script's grid as the expander makes them, and as a line-wise reading counts them."""
    body = texts.first_list(texts.active_lines(script), "GRID_VALUES")
    size = lambda text: F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    product = lambda sizes: F.aggregate(sizes, F.lit(1).cast("long"), lambda n, k: n * k)
    expanded = product(F.transform(texts.list_items(body), size))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    by_line = product(F.transform(lines, lambda x: size(F.translate(x, "\"'", ""))))
    return F.when(body.isNotNull(), expanded), F.when(body.isNotNull(), by_line)


def grid_findings(scripts: DataFrame) -> DataFrame:
    """(exp_name, run_slurm) -> findings; the first blocker of an experiment decides, a warning may stand before it.

    Array mode needs an active array directive, whether the configurations come from a grid or are listed; its end is
    compared where there is a grid to count.
    """
    text = F.col("run_slurm")
    n, lint = grid_counts(text)
    at = scripts.filter("run_slurm is not null").select(
        "exp_name", n.alias("n"), lint.alias("lint_count"),
        texts.active_lines(text).rlike(r"GRID_ARGS\s*=\s*\(").alias("has_grid"),
        texts.last_assignment(texts.active_lines(text), "RUN_MODE", "single").alias("mode"),
        texts.array_bound(text).alias("bound"),
    )
    array = F.col("mode") == "array"
    blocker = (
        F.when(F.col("n") > BLOCK_ABOVE, F.format_string("grid has %d combinations, more than %d", F.col("n"), F.lit(BLOCK_ABOVE)))
        .when(F.col("has_grid") & ~F.col("mode").isin("array", "seq"), F.concat(F.lit("grid with run mode "), F.col("mode")))
        .when(array & F.col("bound").isNull(), F.lit("array mode without an active array directive"))
        .when(array & (F.col("bound") != F.col("n") - 1), F.format_string("array ends at %d, the grid at %d", F.col("bound"), F.col("n") - 1))
    )
    warning = F.when((F.col("n") > WARN_ABOVE) & (F.col("n") <= BLOCK_ABOVE), F.format_string("grid has %d combinations", F.col("n")))
    both = F.array_compact(F.array(F.when(warning.isNotNull(), F.struct(F.lit("warning").alias("severity"), warning.alias("detail"))), F.when(blocker.isNotNull(), F.struct(F.lit("blocker").alias("severity"), blocker.alias("detail")))))
    return at.select("exp_name", F.lit("grid_size").alias("check"), F.explode(both).alias("f")).select("exp_name", "check", "f.severity", "f.detail")


def config_findings(sources: DataFrame) -> DataFrame:
    """(exp_name, config_yml, experiment_py) -> a blocker for each key that is read and not set; a missing file passes."""
    missing = F.array_except(texts.config_references(F.col("experiment_py")), texts.config_keys(F.col("config_yml")))
    at = sources.filter("config_yml is not null and experiment_py is not null")
    return at.select("exp_name", F.lit("config_match").alias("check"), F.lit("blocker").alias("severity"), F.explode(missing).alias("detail"))


def write_findings(sources: DataFrame) -> DataFrame:
    """(exp_name, experiment_py) -> a blocker for each direct write."""
    return sources.select("exp_name", F.lit("direct_write").alias("check"), F.lit("blocker").alias("severity"), F.explode(texts.direct_writes(F.col("experiment_py"))).alias("detail"))


def findings(workspace: DataFrame) -> DataFrame:
    """All findings of (exp_name, run_slurm, experiment_py, config_yml)."""
    return grid_findings(workspace).unionByName(config_findings(workspace)).unionByName(write_findings(workspace))


def verdicts(workspace: DataFrame) -> DataFrame:
    """exp_name and passes: no check has a blocker, and all checks are made."""
    blocked = findings(workspace).filter("severity = 'blocker'").groupBy("exp_name").agg(F.count(F.lit(1)).alias("n_blockers"))
    return workspace.select("exp_name").join(blocked, "exp_name", "left").select("exp_name", F.col("n_blockers").isNull().alias("passes"), F.coalesce("n_blockers", F.lit(0)).alias("n_blockers"))
