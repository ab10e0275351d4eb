"""Create, resume, fail, rename, cancel, review and list experiments: planned actions as rows.

A plan has (step, action, src, dst, detail); a conflict comes out as one ``error`` row instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, notices, texts, times
from ..operators import catalog

# What a resumed copy leaves behind, and the marks of templates.
NOT_COPIED = ("FAILED_REASON.txt", "uncommitted_changes.diff", "metadata.yaml", "__pycache__/")
SCRIPT_MARKS = ("__EXP_NAME__", "__PROJECT_ROOT__", "__PARTITION__", "__SIGNAL_MARGIN__")
REVIEW_MARKS = ("<実験名>", "NNNN_YYYYMMDD_<name>")


def _steps(plan: DataFrame, rows: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    out = [F.struct(F.lit(k).alias("step"), F.lit(a).alias("action"), s.cast("string").alias("src"), d.cast("string").alias("dst"), t.cast("string").alias("detail")) for k, (a, s, d, t) in enumerate(rows)]
    return plan.select(F.explode(F.array(*out)).alias("p")).select("p.*")


def _checked(proposal: DataFrame, listing: DataFrame, rows: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """The steps, or an error where the target name (column ``target``) exists already."""
    taken = listing.select(F.col("exp_name").alias("target")).distinct()
    clash = proposal.join(taken, "target", "left_semi").select(F.lit(0).alias("step"), F.lit("error").alias("action"), F.lit(None).cast("string").alias("src"), F.col("target").alias("dst"), F.lit("TARGET_EXISTS").alias("detail"))
    return _steps(proposal.join(taken, "target", "left_anti"), rows).unionByName(clash)



def create(listing: DataFrame, label: str, date: str, root: str, owners: DataFrame, template: str, git: str = "git_not_available", diff: str = "") -> DataFrame:
    """A new experiment: directories, filled run script, copied program and configuration, record, uncommitted diff, pointers.

    A project root without an owner is an error row.
    """
    proposal = catalog.next_id(listing).withColumn("target", names.compose(F.col("next_id"), F.lit(date), names.sanitize(F.lit(label))))
    proposal = catalog.owners(proposal.withColumn("path", F.lit(root)), owners)
    limit = texts.time_option(F.lit(template))
    values = (F.col("target"), F.lit(root), F.concat_ws("-", times.scale(limit), "owner"), times.margin(limit).cast("string"))
    script = texts.substitute(F.lit(template), {mark: F.coalesce(v, F.lit("")) for mark, v in zip(SCRIPT_MARKS, values, strict=True)})
    record = texts.flat_yaml({"exp_id": F.col("next_id"), "exp_name": F.col("target"), "created_date": F.lit(date), "git_commit": F.lit(git)})
    nothing = F.lit(None)
    place = lambda file: F.concat_ws("/", F.lit("experiments"), "target", F.lit(file))
    known = _checked(proposal.filter("owner is not null"), listing, [
        ("mkdir", nothing, F.concat(F.lit("experiments/"), F.col("target")), nothing),
        ("mkdir", nothing, F.concat(F.lit("outputs/"), F.col("target")), nothing),
        ("write", nothing, place("run_slurm.sh"), script),
        ("copy", F.lit("templates/experiment.py"), place("experiment.py"), nothing),
        ("copy", F.lit("templates/config.yml"), place("config.yml"), nothing),
        ("write", nothing, place("metadata.yaml"), record),
        *([("write", nothing, place("uncommitted_changes.diff"), F.lit(diff))] if diff else []),
        *_pointers(F.col("target")),
    ])
    lost = proposal.filter("owner is null").select(F.lit(0).alias("step"), F.lit("error").alias("action"), F.lit(root).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("UNKNOWN_OWNER").alias("detail"))
    return known.unionByName(lost)


def _pointers(target: Column) -> list[tuple[str, Column, Column, Column]]:
    """Both ``latest`` pointers."""
    return [("link", F.concat(F.lit(f"{kind}/"), target), F.lit(f"{kind}/latest"), F.lit(None)) for kind in ("experiments", "outputs")]


def resume(listing: DataFrame, selector: str, date: str, suffix: str | None = None, git: str = "git_not_available", root: str = "") -> DataFrame:
    """A copy of an experiment under a new id, its dependency disabled and its lineage recorded."""
    source = catalog.select_one(listing, selector)
    label = names.resumed_label(F.col("exp_name"), F.lit(suffix))
    proposal = source.crossJoin(catalog.next_id(listing)).withColumn("target", names.compose(F.col("next_id"), F.lit(date), label))  # a row on either side
    outputs = F.concat(F.lit(f"{root}/outputs/" if root else "outputs/"), F.col("exp_name"))
    record = texts.flat_yaml({
        "exp_id": F.col("next_id"), "exp_name": F.col("target"), "created_date": F.lit(date), "git_commit": F.lit(git),
        "resumed_from_exp": F.col("exp_name"), "resume_checkpoint_dir": outputs, "resume_checkpoint_file": F.lit(None),
    })
    return _checked(proposal, listing, [
        ("mkdir", F.lit(None), F.concat(F.lit("outputs/"), F.col("target")), F.lit(None)),
        ("copy", F.concat(F.lit("experiments/"), F.col("exp_name")), F.concat(F.lit("experiments/"), F.col("target")), F.lit("without " + ", ".join(NOT_COPIED))),
        ("rewrite", F.col("exp_name"), F.col("target"), F.lit("run_slurm.sh, config.yml; dependency off")),
        ("write", F.lit(None), F.concat_ws("/", F.lit("experiments"), "target", F.lit("metadata.yaml")), record),
        *_pointers(F.col("target")),
    ])


def copied_files(files: DataFrame) -> DataFrame:
    """Files (file, a path below the experiment) that a resumed copy takes along: none of the names, nor what is in such a directory."""
    parts = F.split("file", "/")
    whole = F.exists(parts, lambda x: x.isin(*[n for n in NOT_COPIED if not n.endswith("/")]))
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*[n[:-1] for n in NOT_COPIED if n.endswith("/")]))
    return files.filter(~whole & ~inside)


def rewritten(files: DataFrame, old: str, new: str) -> DataFrame:
    """Scripts and configurations (file, text) under the new name, dependencies of run scripts off."""
    text = texts.rename_in(F.col("text"), F.lit(old), F.lit(new))
    return files.withColumn("text", F.when(F.col("file") == "run_slurm.sh", texts.without_dependency(text)).when(F.col("file") == "config.yml", text).otherwise(F.col("text")))


def _moves(proposal: DataFrame, listing: DataFrame, outputs: DataFrame, more: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    at = catalog.with_outputs(proposal, outputs.select("exp_name").distinct())
    newest = catalog.latest(listing).select(F.col("exp_name").alias("_latest"))
    at = at.crossJoin(newest)  # a row
    rows = [
        ("move", F.concat(F.lit("experiments/"), F.col("exp_name")), F.concat(F.lit("experiments/"), F.col("target")), F.lit(None)),
        ("move", F.when(F.col("has_outputs"), F.concat(F.lit("outputs/"), F.col("exp_name"))), F.when(F.col("has_outputs"), F.concat(F.lit("outputs/"), F.col("target"))), F.lit(None)),
        *more,
        *[(a, F.when(F.col("_latest") == F.col("exp_name"), src), dst, detail) for a, src, dst, detail in _pointers(F.col("target"))],
    ]
    return _checked(at, listing, rows).filter("src is not null or action in ('write', 'error')")


def mark_failed(listing: DataFrame, outputs: DataFrame, selector: str, reason: str, date: str, at: str) -> DataFrame:
    """The experiment and its outputs under a failure name; empty if it is marked already.  Logs stay where they are."""
    source = catalog.select_one(listing, selector).filter(~names.is_failed(F.col("exp_name")))
    proposal = source.withColumn("target", names.failed_name(F.col("exp_name"), F.lit(date), F.lit(reason)))
    note = texts.flat_yaml({"failed_at": F.lit(at), "reason": F.lit(reason), "original_experiment": F.col("exp_name")})
    return _moves(proposal, listing, outputs, [("write", F.lit(None), F.concat_ws("/", F.lit("experiments"), "target", F.lit("FAILED_REASON.txt")), note)])


def rename(listing: DataFrame, outputs: DataFrame, selector: str, label: str) -> DataFrame:
    """The experiment and its outputs under another label; id, date and failure tail stay."""
    proposal = catalog.select_one(listing, selector).withColumn("target", names.renamed(F.col("exp_name"), F.lit(label)))
    return _moves(proposal, listing, outputs, [("rewrite", F.col("exp_name"), F.col("target"), F.lit("run_slurm.sh, config.yml"))])


def cancel(runs: DataFrame, job: str, reason: str = "user_request", user: str = "", legacy_prefix: bool = False) -> DataFrame:
    """All runs; those of the job get status CANCELLED, the reason and who asked (``cancel_requested`` marks them)."""
    hit = names.matches_job(F.col("job_dir"), F.lit(job), legacy_prefix)
    had = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast("string")
    return runs.withColumns({
        "status": F.when(hit, "CANCELLED").otherwise(F.col("status")), "cancel_reason": F.when(hit, reason).otherwise(had("cancel_reason")),
        "cancelled_by": F.when(hit, user).otherwise(had("cancelled_by")), "cancel_requested": hit,
    })


def cancel_plan(jobs: DataFrame, tools: list[str]) -> DataFrame:
    """The command that would end each job, by the first tool there is."""
    tool = next((t for t in ("scancel", "qdel", "kill") if t in tools), None)
    return jobs.select("job_id", F.lit(tool).alias("tool"), F.concat_ws(" ", F.lit(tool), "job_id").alias("command"))


def cancel_notice(runs: DataFrame, job: str, reason: str = "user_request", user: str = "") -> DataFrame:
    """The notification of a cancelled job, with the experiment of its first run."""
    hit = runs.filter(names.matches_job(F.col("job_dir"), F.lit(job)))
    first = hit.agg(F.min_by("exp_name", F.struct("job_dir", "exp_name")).alias("exp"))
    fields = notices.fields("fail_fast", {"EXP": F.col("exp"), "JOB": F.lit(job), "STATE": F.lit(f"USER_CANCEL (reason: {reason}, by: {user})")})
    return first.select(notices.payload("fail_fast", F.lit(job), fields).alias("payload"))


def reviewed(exps: DataFrame, template: Column) -> DataFrame:
    """Experiments with their review document: of each line the first occurrence of each mark is filled."""
    text = template
    for mark in REVIEW_MARKS:
        text = texts.first_in_line(text, mark, F.col("exp_name"))
    return exps.withColumn("document", text)


def review(listing: DataFrame, template: str, exp: str | None, name: str | None) -> DataFrame:
    """A review document of the experiment whose name holds the selector."""
    return reviewed(catalog.select_one(listing, exp or name, loose=True), F.lit(template))
