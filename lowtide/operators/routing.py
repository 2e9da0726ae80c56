"""Routing tables (matrix_id, i, w, o): input channel, way, output channel.

Routes are distinct, so one matrix has at most inputs x ways x outputs rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = "matrix_id"


def encode(routes: DataFrame) -> DataFrame:
    text = F.concat_ws("/", F.col("i").cast("string"), F.col("w").cast("string"), F.col("o").cast("string"))
    return routes.select(ID, text.alias("route"))


def decode(lines: DataFrame) -> DataFrame:
    part = F.split("route", "/")
    return lines.select(ID, *[part[k].try_cast("int").alias(c) for k, c in enumerate(("i", "w", "o"))])


def fed_by(routes: DataFrame) -> DataFrame:
    """(matrix, o, fed): the sorted (i, w) pairs of each output. Routes are dealt by
    matrix, and that one shuffle serves every grouping below."""
    return routes.repartition(ID).groupBy(ID, "o").agg(F.array_sort(F.collect_set(F.struct("i", "w"))).alias("fed"))


def direct(routes: DataFrame) -> DataFrame:
    """Outputs fed by exactly one input, unless it is the channel itself."""
    only = F.col("fed")[0]
    single = fed_by(routes).where((F.size("fed") == 1) & (only["i"] != F.col("o")))
    return single.select(ID, only["i"].alias("i"), only["w"].alias("w"), "o")


def summed(routes: DataFrame) -> DataFrame:
    """(matrix, o, inputs): outputs fed by several inputs, inputs sorted as ``i_w``."""
    names = F.transform("fed", lambda x: F.concat_ws("_", x["i"].cast("string"), x["w"].cast("string")))
    return fed_by(routes).where(F.size("fed") > 1).select(ID, "o", F.array_sort(names).alias("inputs"))


def collated(routes: DataFrame) -> DataFrame:
    """Summed outputs with the same inputs together: (matrix, inputs, outputs)."""
    return summed(routes).groupBy(ID, "inputs").agg(F.array_sort(F.collect_set("o")).alias("outputs"))


def free_outputs(routes: DataFrame, outputs: DataFrame) -> DataFrame:
    return outputs.join(routes, [ID, "o"], "left_anti").select(ID, "o")


def outputs_by_way(routes: DataFrame) -> DataFrame:
    """(matrix, i, ways): the sorted outputs of each way of each input."""
    ways = routes.groupBy(ID, "i", "w").agg(F.array_sort(F.collect_set("o")).alias("outputs"))
    return ways.groupBy(ID, "i").agg(F.array_sort(F.collect_list(F.struct("w", "outputs"))).alias("ways"))


def violations(routes: DataFrame) -> DataFrame:
    """(matrix, o, problem): a direct route onto another input, and a summed output
    that another summed group reads. Groups are outputs with the same inputs."""
    fed = fed_by(routes)
    several, only = F.size("fed") > 1, F.col("fed")[0]["i"]
    # Whether an output is an input as well, and which summed groups read it: one row per matrix and input.
    by_input = fed.select(ID, "fed", F.explode(F.array_distinct(F.col("fed.i"))).alias("_i"))
    readers = by_input.groupBy(ID, F.col("_i").alias("o")).agg(
        F.min(F.when(several, F.col("fed"))).alias("_first"), F.max(F.when(several, F.col("fed"))).alias("_last"), F.lit(True).alias("_input")
    )
    rows = fed.join(readers, [ID, "o"], "left")
    onto_input = ~several & (only != F.col("o")) & F.coalesce("_input", F.lit(False))
    # Another group reads it if the least or the greatest of its readers is not its own.
    read = several & ((F.col("_first") != F.col("fed")) | (F.col("_last") != F.col("fed")))
    problem = F.when(onto_input, "overwrites input").when(read, "feeds another sum")
    return rows.select(ID, "o", problem.alias("problem")).where("problem IS NOT NULL")
