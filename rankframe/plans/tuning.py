"""Grid search over the parameters of a stage tree.

All settings are scored and evaluated in one job: a parameter struct tells
their runs apart and is part of the grouping key, so they share one join with
the judgments. Settings that differ only in the last stage, if that stage can
sweep (``Interpolate``), share one plan as well: each candidate is repeated once
per setting, behind everything costly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from .algebra import Stage, Then


@dataclass
class GridSearch:
    table: DataFrame   # one column per parameter, ``value``, ``best``
    stage: Stage       # the tree with the best setting
    setting: dict
    value: float


def _struct(number: int, setting: dict) -> Column:
    # the number keeps the order of the grid: the first of equal settings wins
    return F.struct(F.lit(number).alias("_n"), *[F.lit(v).alias(name) for name, v in setting.items()])


def grid_runs(stage: Stage, settings: list[dict], topics: DataFrame) -> DataFrame:
    """(qid, docno, score, setting): the runs of all settings."""
    last = stage.parts[-1] if isinstance(stage, Then) else None
    swept = set(last.parameters()) if hasattr(last, "sweep") else set()
    # settings with the same values before the last stage go together
    together: dict[tuple, list[tuple[int, dict]]] = {}
    for number, setting in enumerate(settings):
        before = tuple((name, v) for name, v in setting.items() if name not in swept)
        together.setdefault(before, []).append((number, setting))
    built: dict = {}
    runs = []
    for before, group in together.items():
        if swept:
            head = Then(stage.parts[:-1]).with_parameters(dict(before))
            # parameters of the last stage that the grid leaves out keep their value
            full = [(n, last.parameters() | s) for n, s in group]
            run = last.sweep(head.build(topics, built), F.array(*[_struct(n, s) for n, s in full]))
            named = F.struct(F.col("setting._n").alias("_n"), *[F.col(f"setting.{p}").alias(p) for p in group[0][1]])
            runs.append(run.select("qid", "docno", "score", named.alias("setting")))
        else:
            for number, setting in group:
                run = stage.with_parameters(setting).build(topics, built)
                runs.append(run.select("qid", "docno", "score", _struct(number, setting).alias("setting")))
    return reduce(DataFrame.unionByName, runs)


def grid_search(stage: Stage, grid: dict[str, list], topics: DataFrame, qrels: DataFrame,
                metric: str = "map", missing: str = "zero") -> GridSearch:
    """Evaluate ``stage`` on ``topics`` (qid, query) for every combination of
    ``grid``, ``{"stage__parameter": values}``; the highest mean wins, of equal
    ones the first. ``missing`` as in ``evaluate_run``: with ``zero`` a judged
    topic without results counts 0, so that a setting gains nothing by losing
    topics. Without any judged topic the first setting stays, its value null."""
    unknown = set(grid) - set(stage.parameters())
    if unknown or not grid or not all(grid.values()):
        raise ValueError(f"parameters {sorted(stage.parameters())}, each with values: {grid}")
    # a list that mixes whole numbers with others has one type
    grid = {p: [float(v) for v in vs] if any(isinstance(v, float) for v in vs) else vs for p, vs in grid.items()}
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    every = F.array(*[_struct(n, s) for n, s in enumerate(settings)])
    judged = qrels.withColumn("qid", F.col("qid").cast("string")).join(
        topics.select(F.col("qid").cast("string").alias("qid")).distinct(), "qid", "left_semi")
    per_query = ev.per_query(grid_runs(stage, settings, topics), judged, [metric], ("setting",))
    if missing == "zero":
        per_query = ev.with_missing_zero(per_query, judged, [metric], groups={"setting": every})
    means = per_query.groupBy("setting").agg(F.avg("value").alias("value"))
    # bounded: one row per combination of the grid
    rows = topics.sparkSession.range(1).select(F.explode(every).alias("setting"))
    order = Window.orderBy(F.round("value", 9).desc_nulls_last(), F.col("setting._n"))
    table = (rows.join(means, "setting", "left").withColumn("best", F.row_number().over(order) == 1)
             .select("setting.*", "value", "best"))
    found = table.orderBy("_n").collect()
    best = next(r for r in found if r["best"])
    spark = topics.sparkSession
    table = spark.createDataFrame(found, table.schema).drop("_n")
    setting = settings[best["_n"]]
    return GridSearch(table, stage.with_parameters(setting), setting, best["value"])
