"""Column expressions over whole small files: run scripts, flat YAML, JSON records, job commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_directive(script: Column) -> Column:
    """The active ``#SBATCH --time=`` value; null without one."""
    return F.nullif(F.regexp_extract(script, r"(?m)^#SBATCH --time=(\S+)", 1), F.lit(""))


def time_option(template: Column) -> Column:
    """The first ``--time=`` anywhere in a template."""
    return F.nullif(F.regexp_extract(template, r"--time=(\S+)", 1), F.lit(""))


def array_bound(script: Column) -> Column:
    """Upper bound of an active ``#SBATCH --array=a-N``; a throttle is ignored, a list does not match."""
    return F.regexp_extract(script, r"(?m)^\s*#SBATCH\s+--array=\d+-(\d+)", 1).try_cast("long")


def active_lines(script: Column) -> Column:
    """The text without lines that are comments."""
    return F.array_join(F.filter(F.split(script, "\n"), lambda line: ~line.rlike(r"^\s*#")), "\n")


def last_assignment(script: Column, name: str, default: str) -> Column:
    """The word that is assigned last, quoted or not, blanks around the sign allowed."""
    found = F.regexp_extract_all(script, F.lit(rf"""{name}\s*=\s*["']?(\w+)["']?"""), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(default))


def first_list(script: Column, name: str) -> Column:
    """The body of the first ``NAME=( ... )``, up to the first closing bracket; null without one."""
    return F.try_element_at(F.regexp_extract_all(script, F.lit(rf"(?s){name}=\((.*?)\)"), F.lit(1)), F.lit(1))


def list_items(body: Column) -> Column:
    """The quoted or bare items of a shell list."""
    raw = F.regexp_extract_all(body, F.lit(r"""("[^"]*"|'[^']*'|[^\s"']+)"""), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def config_keys(config: Column) -> Column:
    """Top-level keys of a flat YAML text."""
    return F.array_distinct(F.regexp_extract_all(config, F.lit(r"(?m)^([a-zA-Z_][a-zA-Z0-9_]*):"), F.lit(1)))


def config_references(source: Column) -> Column:
    """Keys that a program reads as ``config['k']`` or ``config.get('k'``."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"""config(?:\.get\(|\[)\s*["']([a-zA-Z_][a-zA-Z0-9_]*)["']"""), F.lit(1)))


def direct_writes(source: Column) -> Column:
    """Calls that write or open a literal path below ``outputs/`` or ``data/``."""
    return F.regexp_extract_all(source, F.lit(r"""((?:to_parquet|to_csv|open)\(\s*[rfb]?["'](?:\./)?(?:outputs|data)/[^"']*["'])"""), F.lit(1))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""^(["'])(.*)\1$""", "$2")


def yaml_map(text: Column) -> Column:
    """Top-level ``key: value`` lines of flat YAML as a map of strings; no typing, so 0010 and 196:00:00 stay text.
    The last of equal keys holds; null or empty text is an empty map."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:(\s|$)"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), unquoted(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:\s*", ""), r"\s+#.*$", "")).alias("v")))
    # The pairs are worked out once, and only then compared.
    keep = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    last = F.transform(F.array(pairs), keep)[0]
    return F.transform_values(F.map_from_entries(last), lambda _, v: F.when(~v.isin("null", "~", ""), v))


def yaml_value(text: Column, key: str) -> Column:
    return F.try_element_at(yaml_map(text), F.lit(key))


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; null if it does not parse."""
    # The parser overlooks text after the object.
    ok = F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(ok, F.from_json(text, "map<string,string>"))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """Replace placeholders literally, in the given order."""
    for mark, value in values.items():
        template = F.replace(template, F.lit(mark), value)
    return template


def first_in_line(text: Column, mark: str, value: Column) -> Column:
    """The mark's first occurrence in each line replaced, as it is."""
    safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(rf"(?m)^(.*?){mark}"), F.concat(F.lit("$1"), safe))


def flat_yaml(values: dict[str, Column]) -> Column:
    """``key: value`` lines; a null value is written as null."""
    return F.concat(*[x for k, v in values.items() for x in (F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("null")), F.lit("\n"))])


def rename_in(text: Column, old: Column, new: Column) -> Column:
    """Every occurrence of the old name, read literally."""
    return F.replace(text, old, new)


def without_dependency(script: Column) -> Column:
    """Active dependency directives turned into comments."""
    return F.regexp_replace(script, r"(?m)^#SBATCH(\s+--dependency=.*)$", "# #SBATCH$1")


def dependency(script: Column) -> Column:
    """The job id after ``afterok:`` in an active dependency directive."""
    return F.nullif(F.regexp_extract(script, r"(?m)^#SBATCH\s+--dependency=afterok:(\d+)", 1), F.lit(""))


def command(base: Column, options: Column) -> Column:
    return F.concat_ws(" ", base, options)


def resolved_command(mode: Column, base: Column, options: Column, single: Column) -> Column:
    """Array tasks run the base command with their options, single runs their own command, sequences none of these."""
    return F.when(mode == "array", command(base, options)).when(mode == "single", single).otherwise("")
