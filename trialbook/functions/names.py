"""Column expressions over experiment names, variant keys, job ids and paths.

An experiment is named ``{id}_{YYYYMMDD}_{label}``: the id has four digits or more, the date may be missing.
All expressions are built from SQL functions, total (no ANSI errors), and null on null input unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^[0-9]{4,}_"
_FAILED = "_FAILED_"


def is_experiment(name: Column) -> Column:
    """A valid experiment name: at least four digits and an underscore, and not the ``latest`` pointer."""
    return name.rlike(NAME) & (name != "latest")


def overflows(name: Column) -> Column:
    """Ids above 9999, which four-digit tools overlook."""
    return name.rlike(r"^[0-9]{5,}_")


def number(name: Column) -> Column:
    """The id as a number, always read in base ten; null without an id."""
    return F.regexp_extract(name, r"^([0-9]{4,})_", 1).try_cast("int")


def parts(name: Column) -> Column:
    """struct(exp_id, exp_date, body); the parts that are absent are null."""
    some = lambda k: F.nullif(F.regexp_extract(name, r"^(?:([0-9]{4,})_)?(?:([0-9]{8})_)?(.*)$", k), F.lit(""))
    return F.struct(some(1).alias("exp_id"), some(2).alias("exp_date"), some(3).alias("body"))


def created(name: Column) -> Column:
    return F.try_to_timestamp(parts(name)["exp_date"], F.lit("yyyyMMdd")).cast("date")


def padded(n: Column, width: int = 4) -> Column:
    """Zero-padded, never cut: 10000 stays 10000."""
    return F.format_string(f"%0{width}d", n.cast("long"))


def sanitize(label: Column) -> Column:
    """Blanks and slashes become underscores; all but ASCII letters, digits, underscore and hyphen goes."""
    return F.regexp_replace(F.translate(label, " /", "__"), r"[^A-Za-z0-9_\-]", "")


def variant_key(key: Column) -> Column:
    """The text after the last slash or backslash."""
    return F.substring_index(F.translate(key, "\\", "/"), "/", -1)


def composed_variant(model: Column, seed: Column) -> Column:
    """``{model}__{seed}`` with slashes of the model as hyphens."""
    return F.concat_ws("__", F.replace(model, F.lit("/"), F.lit("-")), seed.cast("string"))


def compose(exp_id: Column, date: Column, label: Column) -> Column:
    return F.concat_ws("_", exp_id, date, label)


def is_failed(name: Column) -> Column:
    return F.contains(name, F.lit(_FAILED))


def failed_name(name: Column, date: Column, reason: Column) -> Column:
    return F.concat(name, F.lit(_FAILED), date, F.lit("_"), sanitize(reason))


def resumed_label(name: Column, suffix: Column | None = None) -> Column:
    """The label of a resumed experiment: no prefix, cut at the first failure mark, one trailing resume word off, suffix on."""
    body = F.regexp_replace(name, r"^[0-9]{4,}_(?:[0-9]{8}_)?", "")
    body = F.regexp_replace(F.regexp_replace(body, r"_FAILED_.*$", ""), r"_(?:resumed|retry|resume)$", "")
    return F.concat(body, F.lit("_"), sanitize(F.coalesce(F.nullif(suffix, F.lit("")), F.lit("resumed")) if suffix is not None else F.lit("resumed")))


def failure_tail(name: Column) -> Column:
    """The tail from the last failure mark; empty without one."""
    return F.regexp_extract(name, r"^.*(_FAILED_.*)$", 1)


def renamed(name: Column, label: Column) -> Column:
    """Another label between the same id and date in front and the same failure tail behind."""
    p = parts(name)
    return F.concat(F.concat_ws("_", p["exp_id"], p["exp_date"], sanitize(label)), failure_tail(name))


def selector_prefix(selector: Column) -> Column:
    """A numeric selector as the name prefix ``0012_``; null for a name."""
    return F.when(selector.rlike(r"^[0-9]+$"), F.concat(padded(selector.try_cast("long")), F.lit("_")))


def selects(selector: Column, name: Column) -> Column:
    """Numeric selectors match the id, others the whole name."""
    return F.coalesce(F.startswith(name, selector_prefix(selector)), name == selector)


def contains_selector(selector: Column, name: Column) -> Column:
    padded_or_text = F.when(selector.rlike(r"^[0-9]+$"), padded(selector.try_cast("long"))).otherwise(selector)
    return F.contains(name, padded_or_text)


def fallback(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def job_directory(mode: Column, array_job: Column, task: Column, job: Column) -> Column:
    """``{array job}_{task}`` in array mode, else the job's id."""
    return F.when(mode == "array", F.concat(array_job, F.lit("_"), task)).otherwise(job)


def job_of_log(file: Column) -> Column:
    """Job id in a loose log's name: between ``watcher_`` and ``.log``, else before the first underscore."""
    return F.when(F.startswith(file, F.lit("watcher_")), F.regexp_extract(file, r"^watcher_(.*)\.log$", 1)).otherwise(F.substring_index(file, "_", 1))


def base_job(job: Column) -> Column:
    """A job id without its task."""
    return F.substring_index(job, "_", 1)


def matches_job(job_dir: Column, job: Column, legacy_prefix: bool = False) -> Column:
    """The job itself or one of its tasks; with ``legacy_prefix`` any directory that starts with the id."""
    if legacy_prefix:
        return F.startswith(job_dir, job)
    return (job_dir == job) | F.startswith(job_dir, F.concat(job, F.lit("_")))


def color(job: Column) -> Column:
    """A colour for a job: # and six hex digits of its MD5; grey without a job."""
    return F.coalesce(F.concat(F.lit("#"), F.substring(F.md5(job.cast("binary")), 1, 6)), F.lit("#808080"))


def token(secret: Column) -> Column:
    """32 letters and digits that only who knows the secret can tell; callers bring the randomness."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(secret.cast("binary"), 256))), "+/=", "xyz"), 1, 32)
