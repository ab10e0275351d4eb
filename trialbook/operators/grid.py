"""Parameter grids: ordered expansion, task binding, counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grids above the first number are blocked, above the second warned about.
BLOCK_ABOVE, WARN_ABOVE = 50, 20


def dimensions(grids: DataFrame) -> DataFrame:
    """(exp_name, pos, arg, values array) -> one row per value, with its place vi and the dimension's size n."""
    return grids.select("exp_name", "pos", "arg", F.size("values").cast("long").alias("n"), F.posexplode("values").alias("vi", "value"))


def expand(grids: DataFrame) -> DataFrame:
    """(exp_name, pos, arg, values) -> (exp_name, idx, opts): all combinations, the first dimension slowest.

    Rows are made from the index alone: dimension d of combination idx has place (idx div stride) mod n.  So a
    grid of any number of dimensions needs one aggregation and no product of joins.  A dimension without values
    leaves the grid empty.
    """
    spec = grids.groupBy("exp_name").agg(F.sort_array(F.collect_list(F.struct("pos", "arg", "values"))).alias("dims"))
    total = F.aggregate("dims", F.lit(1).cast("long"), lambda n, d: n * F.size(d["values"]))
    spec = spec.withColumn("total", total).filter("total > 0")
    rows = spec.select("exp_name", "dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("idx"))

    def stride(k):
        return F.aggregate(F.slice(F.col("dims"), k + 2, F.greatest(F.size("dims") - k - 1, F.lit(0))), F.lit(1).cast("long"), lambda n, d: n * F.size(d["values"]))

    opts = F.transform("dims", lambda d, k: F.concat_ws(" ", d["arg"], F.get(d["values"], (F.floor(F.col("idx") / stride(k)) % F.size(d["values"])).cast("int"))))
    return rows.select("exp_name", "idx", opts.alias("opts"))


def cross(tables: list[DataFrame], keys: list[list[str]]) -> DataFrame:
    """Ordered product of small tables: ``idx`` counts with the first table slowest, each ordered by its keys.

    Each table becomes one sorted array; rows are made from the index alone, as in ``expand``.
    """
    spec = None
    for k, (df, by) in enumerate(zip(tables, keys, strict=True)):
        rest = [c for c in df.columns if c not in by]
        one = df.agg(F.array_sort(F.collect_list(F.struct(*by, *rest))).alias(f"_t{k}"))
        spec = one if spec is None else spec.crossJoin(one)  # a row on either side
    sizes = [F.size(f"_t{k}").cast("long") for k in range(len(tables))]
    total = reduce(lambda x, y: x * y, sizes)
    out = spec.filter(total > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("idx"))
    stride = lambda k: reduce(lambda x, y: x * y, sizes[k + 1 :], F.lit(1).cast("long"))
    rows = [F.get(f"_t{k}", (F.floor(F.col("idx") / stride(k)) % sizes[k]).cast("int")) for k in range(len(tables))]
    return out.select("idx", *[rows[k][c].alias(c) for k, df in enumerate(tables) for c in df.columns])


def bind(tasks: DataFrame, configs: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks with the configuration of their index."""
    return tasks.join(configs, F.col(task) == configs.idx)


def unbound(tasks: DataFrame, configs: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks whose index no configuration has: each would abort."""
    return tasks.join(configs, F.col(task) == configs.idx, "left_anti").withColumn("reason", F.lit("TASK_INDEX_OUT_OF_RANGE"))


def commands(configs: DataFrame, base: str = "base_command") -> DataFrame:
    return configs.withColumn("command", F.concat_ws(" ", F.col(base), F.array_join("opts", " ")))


def counts(grids: DataFrame) -> DataFrame:
    """(exp_name, n_configs, n_dimensions, verdict) from the sizes of the dimensions."""
    sized = grids.groupBy("exp_name").agg(F.product(F.size("values")).cast("long").alias("n_configs"), F.count(F.lit(1)).alias("n_dimensions"))
    verdict = F.when(F.col("n_configs") > BLOCK_ABOVE, "blocker").when(F.col("n_configs") > WARN_ABOVE, "warning").otherwise("ok")
    return sized.withColumn("verdict", verdict)
