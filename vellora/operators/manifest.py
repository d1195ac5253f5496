"""The manifest of findings: joins, resume, strip and merge, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellora.operators.flatten import VIOLATION_FIELDS, flatten

ENTRY = ["doc_id", "uuid", "uuid_end", "p_heading"]


def entries(manifest: DataFrame) -> DataFrame:
    """Manifest rows once per entry_id."""
    return manifest.dropDuplicates(["entry_id"])


def violations(manifest: DataFrame) -> DataFrame:
    """One row per non-null violation with its entry: e_* columns of the entry, violation_no, violation fields.

    Entry ids win nothing here; ``uuid_end`` falls back to the entry's (S18).
    """
    keys = ["entry_id", "e_doc_id", "e_uuid", "e_uuid_end", "e_heading", "e_is_violation"]
    m = manifest.select("entry_id", F.col("doc_id").alias("e_doc_id"), F.col("uuid").alias("e_uuid"), F.col("uuid_end").alias("e_uuid_end"), F.col("p_heading").alias("e_heading"), F.col("is_violation").alias("e_is_violation"), "violations")
    return flatten(m, keys, ["violations"], ["violation_no"]).dropDuplicates(["entry_id", "violation_no"])


def with_category(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rule's category, other where the rule or its category is unknown."""
    r = rules.select(F.col("id").alias("rule_id"), F.col("category").alias("rule_category")).dropDuplicates(["rule_id"])
    return found.join(r, "rule_id", "left").withColumn("category", F.coalesce("rule_category", F.lit("other"))).drop("rule_category")


def block_key(uuid: Column, idx: Column) -> Column:
    """A block's id: its uuid, else its number as text."""
    return F.coalesce(F.nullif(uuid, F.lit("")), idx.cast("string"))


def completed(manifest: DataFrame) -> DataFrame:
    """Ids of audited blocks."""
    return manifest.filter(F.coalesce(F.col("uuid"), F.lit("")) != "").select("doc_id", F.col("uuid").alias("key")).distinct()


def pending(blocks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blocks not audited yet (J03, R04): a left anti-join below any Python step."""
    return blocks.withColumn("key", block_key(F.col("uuid"), F.col("block_idx"))).join(completed(manifest), ["doc_id", "key"], "left_anti")


def last_index(blocks: DataFrame) -> DataFrame:
    """Block number of each block id; of equal ids the last."""
    return blocks.select("doc_id", block_key(F.col("uuid"), F.col("block_idx")).alias("uuid"), "block_idx").groupBy("doc_id", "uuid").agg(F.max("block_idx").alias("block_idx"))


def with_block(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries with their block's number; entries of unknown blocks drop out."""
    return entries(manifest).join(last_index(blocks), ["doc_id", "uuid"])


def unknown_blocks(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries whose block is not there: to be warned about."""
    return entries(manifest).join(last_index(blocks), ["doc_id", "uuid"], "left_anti")


def strip_rules(manifest: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Entries without the violations of some rules, flag recomputed where any went; adds removed."""
    if not rule_ids:
        return manifest.withColumn("removed", F.lit(0))
    keep = F.filter("violations", lambda v: ~F.coalesce(v["rule_id"], F.lit("")).isin(*rule_ids))
    gone = F.coalesce(F.size("violations") - F.size(keep), F.lit(0))
    return manifest.withColumn("removed", gone).withColumn("is_violation", F.when(F.col("removed") > 0, F.size(keep) > 0).otherwise(F.col("is_violation"))).withColumn("violations", keep)


def merge_violations(old: DataFrame, new: DataFrame, blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Old and new findings per block, flat: doc_id, uuid, source, violation fields.

    New findings without an id or of an unknown block drop out; of new ones equal in rule, text and end id the first
    counts, and none that an old one equals. Old ones all stay, repeated or not. Both have doc_id and the violation
    fields; ``new`` is ordered by ``no``.
    """
    key = ["doc_id", "uuid", "rule_id", "violation_text", "uuid_end"]
    known = last_index(blocks).select("doc_id", "uuid")
    fresh = new.filter(F.coalesce(F.col("uuid"), F.lit("")) != "").join(known, ["doc_id", "uuid"], "left_semi")
    fill = lambda d: d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_id", "violation_text", "uuid_end")})
    fresh = fill(fresh).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("no"))).filter("k = 1").drop("k")
    fresh = with_category(fresh.join(fill(old).select(*key).distinct(), key, "left_anti"), rules)
    cols = ["doc_id", *VIOLATION_FIELDS]
    return old.select(*cols, F.lit("old").alias("source")).unionByName(fresh.select(*cols, F.lit("new").alias("source")))


def compact(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries with their block's number and violations in order of rule (stable) and without nulls."""
    by_rule = F.transform(
        F.array_sort(F.transform(F.filter("violations", lambda v: v.isNotNull()), lambda v, i: F.struct(F.coalesce(v["rule_id"], F.lit("")).alias("r"), i.alias("i"), v.alias("v")))),
        lambda x: x["v"],
    )
    return with_block(manifest, blocks).withColumn("violations", by_rule)


def run_stats(manifest: DataFrame) -> DataFrame:
    """Entries, entries with findings, findings, flags that disagree with the findings, and failed entries."""
    error = F.col("error") if "error" in manifest.columns else F.lit(None).cast("string")
    n = F.coalesce(F.size(F.filter("violations", lambda v: v.isNotNull())), F.lit(0))
    return entries(manifest).select(n.alias("n"), "is_violation", error.alias("error")).agg(
        F.count("*").alias("processed"), F.count_if(F.col("n") > 0).alias("with_violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
        F.count_if(F.coalesce(F.col("is_violation"), F.lit(False)) != (F.col("n") > 0)).alias("wrong_flags"), F.count("error").alias("failed"),
    )


def complete_documents(blocks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether every block of each document is audited (U05): doc_id, complete."""
    left = pending(blocks, manifest).select("doc_id").distinct().withColumn("open", F.lit(True))
    return blocks.select("doc_id").distinct().join(left, "doc_id", "left").select("doc_id", F.col("open").isNull().alias("complete"))


def is_complete(blocks: DataFrame, manifest: DataFrame) -> bool:
    """Whether every block is audited."""
    return pending(blocks, manifest).isEmpty()
