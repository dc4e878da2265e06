"""Report files of a run (A14, K12, S-json): metrics records, CSV tables, a markdown summary.

Every file is written by Spark into the folder it is given, latest run only.
The tables are bounded by their meaning (a row per horizon, class pair, sampled
point or histogram bin), not by the rows scored.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate, sampling
from ..sources.store import write_report


def write_records(df: DataFrame, path: str) -> None:
    """S-json: one JSON object a line, missing values written as null."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_records`` wrote; a line that is no such object raises an error."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _cell(c: str, kind: str, digits: int) -> Column:
    shown = F.format_number(F.col(c), digits) if kind in ("double", "float") else F.col(c).cast("string")
    return F.replace(F.coalesce(shown, F.lit("")), F.lit("|"), F.lit("\\|"))


def write_markdown(df: DataFrame, path: str, title: str, order: Sequence[str], digits: int = 4) -> None:
    """A titled markdown table, rows in order of the named columns, as one text file."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c, t, digits) for c, t in df.dtypes]), F.lit(" |"))
    head = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{'|'.join(' --- ' for _ in df.columns)}|"]
    top = df.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "at long, value string")
    body = df.orderBy(*order).select(F.monotonically_increasing_id().alias("at"), line.alias("value"))
    top.unionByName(body).repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def test_stage(scored: DataFrame, path: str, by: Sequence[str] = ("horizon",)) -> dict[str, str]:
    """Score forecasts (y, q10, q50, q90), write every report of the test stage under ``path``; the paths by name.

    metrics: K11 as JSON records; confusion: K9, sample: T6, residuals: T7 as
    CSV; summary: the main metrics as markdown.
    """
    paths = {name: os.path.join(path, name) for name in ("metrics", "confusion", "sample", "residuals", "summary")}
    metrics = evaluate.evaluate_all(scored)
    write_records(metrics, paths["metrics"])
    write_report(evaluate.confusion_matrix(scored), paths["confusion"])
    write_report(sampling.interval_sample(scored, by), paths["sample"])
    write_report(sampling.residual_hist(scored, by), paths["residuals"])
    write_markdown(metrics, paths["summary"], "Test metrics", list(by))
    return paths


test_stage.__test__ = False  # not a pytest function
