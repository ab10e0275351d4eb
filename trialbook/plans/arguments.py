"""Commands and the arguments that they cannot do without, and what set-up commands would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required arguments of each command; of ``review`` either will do.
REQUIRED = {
    "uv_sync": ("p",), "create_exp": ("name",), "mark_fail": ("name", "reason"), "resume_exp": ("name",),
    "rename_exp": ("name", "new"), "review": ("exp|name",), "jupyter": ("p", "mem"),
}
# What a new workspace is made of.
FOLDERS = ("logs", "notebooks", "data", "outputs", "libraries", "experiments")


def checked(calls: DataFrame) -> DataFrame:
    """(command, args: map) -> the same with ``missing``, the required arguments that are absent or empty, and ``error``."""
    have = lambda k: F.coalesce(F.try_element_at("args", F.lit(k)), F.lit("")) != ""
    either = lambda names: F.array_max(F.array(*[have(k).cast("int") for k in names.split("|")])) == 1
    missing = F.array().cast("array<string>")
    for command, needed in REQUIRED.items():
        lacking = F.array_compact(F.array(*[F.when(~either(n), F.lit(n.split("|")[-1])) for n in needed]))
        missing = F.when(F.col("command") == command, lacking).otherwise(missing)
    out = calls.withColumn("missing", missing)
    return out.withColumn("error", F.when(F.size("missing") > 0, F.concat(F.array_join("missing", " and "), F.when(F.size("missing") > 1, F.lit(" are required")).otherwise(F.lit(" is required")))))


def submitted(calls: DataFrame, scripts: dict[str, str]) -> DataFrame:
    """The command lines of environment and notebook jobs (whose ``scripts`` are given) with their arguments there: (command, args, line); nothing is run."""
    arg = lambda k: F.try_element_at("args", F.lit(k))
    sync = F.concat(F.lit("sbatch --partition="), arg("p"), F.lit(" " + scripts["uv_sync"]))
    notebook = F.concat(F.lit("sbatch --partition="), arg("p"), F.lit(" --mem="), arg("mem"), F.lit(" " + scripts["jupyter"]))
    ready = checked(calls).filter("error is null and command in ('uv_sync', 'jupyter')")
    return ready.select("command", "args", F.when(F.col("command") == "uv_sync", sync).otherwise(notebook).alias("line"))


def set_up(roots: DataFrame) -> DataFrame:
    """(root) -> the planned actions of a first set-up: (root, action, dst)."""
    steps = [F.struct(F.lit("touch").alias("action"), F.lit(".env").alias("dst")), *[F.struct(F.lit("mkdir").alias("action"), F.lit(f).alias("dst")) for f in FOLDERS]]
    return roots.select("root", F.explode(F.array(*steps)).alias("p")).select("root", "p.action", F.concat_ws("/", "root", "p.dst").alias("dst"))
