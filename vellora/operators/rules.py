"""Rule sets: defaults, unions, numbering. Rule sets are small; everything is a plain DataFrame all the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_type(own: Column, of_file: Column) -> Column:
    """Type of a rule: its own, else its file's, else block; the old name block_level is block."""
    t = F.coalesce(F.nullif(own, F.lit("")), F.nullif(of_file, F.lit("")), F.lit("block"))
    return F.when(t == "block_level", "block").otherwise(t)


def report_rules(rules: DataFrame) -> DataFrame:
    """Rules for reporting: severity medium and category other where missing."""
    return rules.select("id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("category", F.lit("other")).alias("category"))


def _in_order(files: list[DataFrame]) -> DataFrame:
    numbered = [f.withColumns({"file_no": F.lit(i), "rule_no": F.monotonically_increasing_id()}) for i, f in enumerate(files)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered).filter(F.coalesce(F.col("id"), F.lit("")) != "")


def repeated_ids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("id").count().filter("count > 1").select("id")


def union_strict(files: list[DataFrame]) -> DataFrame:
    """All rules with an id; a repeated id is an error."""
    every = _in_order(files)
    if bad := [r.id for r in repeated_ids(every).orderBy("id").limit(5).collect()]:
        raise ValueError(f"rule ids given twice: {', '.join(bad)}")
    return every


def union_last(files: list[DataFrame]) -> DataFrame:
    """All rules with an id, the last of each id (U02), in the place of its first."""
    w = Window.partitionBy("id")
    ordered = _in_order(files).withColumn("place", F.min(F.struct("file_no", "rule_no")).over(w))
    return ordered.withColumn("k", F.row_number().over(w.orderBy(F.desc("file_no"), F.desc("rule_no")))).filter("k = 1").drop("k")


def renumber(rules: DataFrame, order: list[str]) -> DataFrame:
    """Ids R001, R002 .. in order (P34); rule sets are small enough for one window."""
    return rules.withColumn("id", F.format_string("R%03d", F.row_number().over(Window.orderBy(*order))))
