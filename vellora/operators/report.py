"""Reports over the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellora.operators.manifest import entries, violations


def report_rows(manifest: DataFrame) -> DataFrame:
    """Findings of entries flagged as violating (F04), with the report's defaults; source_id is start|end."""
    v = violations(entries(manifest)).filter("e_is_violation")
    e = lambda c: F.coalesce(c, F.lit(""))
    end = F.coalesce("uuid_end", "e_uuid_end", F.lit(""))
    return v.select(
        "entry_id", "violation_no", F.col("e_doc_id").alias("doc_id"), e("e_uuid").alias("uuid"), end.alias("uuid_end"), F.concat(e("e_uuid"), F.lit("|"), end).alias("source_id"), e("e_heading").alias("heading"),
        F.coalesce("category", F.lit("other")).alias("category"), e("rule_id").alias("rule_id"), e("violation_text").alias("violation_text"), e("violation_reason").alias("violation_reason"),
        F.coalesce("fix_action", F.lit("manual")).alias("fix_action"), e("revised_text").alias("revised_text"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def totals(manifest: DataFrame) -> DataFrame:
    """total_blocks counts all entries; max_category_count is 0 without findings."""
    all_ = entries(manifest).agg(F.count("*").alias("total_blocks")).withColumn("one", F.lit(1))
    c = by_category(report_rows(manifest)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violation_count"), F.coalesce(F.max("n"), F.lit(0)).alias("max_category_count")).withColumn("one", F.lit(1))
    return all_.join(c, "one").drop("one")


def source_contents(manifest: DataFrame) -> DataFrame:
    """Content of each source id, of the first finding with it."""
    content = entries(manifest).select("entry_id", F.coalesce("p_content", F.lit("")).alias("p_content"))
    first = report_rows(manifest).groupBy("doc_id", "source_id").agg(F.min("entry_id").alias("entry_id"))
    return first.join(content, "entry_id").select("doc_id", "source_id", F.col("p_content").alias("content"))


def used_rules(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that have findings (A03, J02): from the rule set, else as the first finding tells, severity medium."""
    used = report_rows(manifest).filter("rule_id <> ''").groupBy("rule_id").agg(F.min_by("category", F.struct("entry_id", "violation_no")).alias("seen"))
    r = rules.dropDuplicates(["id"]).select(F.col("id").alias("rule_id"), "severity", "category", "description", F.lit(True).alias("known"))
    j = used.join(r, "rule_id", "left")
    return j.select(
        "rule_id", F.when(F.col("known"), F.coalesce("category", F.lit("other"))).otherwise(F.col("seen")).alias("category"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("description", F.lit("")).alias("description")
    )


def preview(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in order, for a look."""
    return rows.orderBy(*order).limit(n)


def block_stats(blocks: DataFrame) -> DataFrame:
    """Blocks, distinct headings, characters and their whole average."""
    return blocks.dropDuplicates(["doc_id", "block_idx"]).agg(
        F.count("*").alias("n_blocks"), F.countDistinct("heading").alias("n_headings"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"),
    ).withColumn("average", F.when(F.col("n_blocks") > 0, F.floor(F.col("n_chars") / F.col("n_blocks"))).otherwise(0))
