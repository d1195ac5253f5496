"""Orphan references: foreign keys that name no parent row existing at the time of use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_ref(c: Column) -> Column:
    """Reference without outer blanks (any Unicode blank) in upper case."""
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def references(items: DataFrame, key: str, fields: list[str], scope: str, at: str, table: str = "edit_items") -> DataFrame:
    """One row per non-empty reference of every row: table_name, key, ref_field, scope, ref, at.

    Null and blank references name nothing and give no row. Repeated rows of the input give one row each time;
    callers that report count distinct (key, ref_field).
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("ref_field"), clean_ref(F.col(f)).alias("ref")) for f in fields])
    return (
        items.select(F.lit(table).alias("table_name"), F.col(key).alias("item_id"), F.col(scope).alias("doc_id"), F.col(at).alias("at"), F.explode(pairs).alias("p"))
        .select("table_name", "item_id", "doc_id", "at", "p.ref_field", "p.ref")
        .filter(F.col("ref") != "")
    )


def parents(paragraphs: DataFrame, ids: list[str], scope: str, since: str, until: str) -> DataFrame:
    """Distinct parent keys with the time they exist: doc_id, ref, since (inclusive), until (exclusive, null: still there)."""
    return (
        paragraphs.select(F.col(scope).alias("doc_id"), F.col(since).alias("since"), F.col(until).alias("until"), F.explode(F.array(*[F.upper(F.col(c)) for c in ids])).alias("ref"))
        .filter(F.col("ref").isNotNull() & F.col("since").isNotNull() & F.col("doc_id").isNotNull())
        .distinct()
    )


def orphan_keys(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """Distinct (doc_id, ref, at) without a parent existing at that time.

    Left anti-join of the distinct foreign keys on (doc_id, ref) with the interval as residual. The distinct step
    combines map-side, so a reference used by a third of the rows shuffles once per task and time; what is left of a
    hot key is split by adaptive skew handling, which may split the left side of an anti-join.
    A null scope or time matches no parent, so such a reference is an orphan.
    """
    fk = refs.select("doc_id", "ref", "at").distinct().alias("f")
    p = parent.alias("p")
    cond = (
        (F.col("f.doc_id") == F.col("p.doc_id"))
        & (F.col("f.ref") == F.col("p.ref"))
        & (F.col("p.since") <= F.col("f.at"))
        & (F.col("p.until").isNull() | (F.col("f.at") < F.col("p.until")))
    )
    return fk.join(p, cond, "left_anti")


def _same(a: str, b: str) -> Column:
    return (
        F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
        & (F.col(f"{a}.ref") == F.col(f"{b}.ref"))
        & F.col(f"{a}.at").eqNullSafe(F.col(f"{b}.at"))
    )


def orphans(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """The references whose key is an orphan, once per (item_id, ref_field): item_id, ref_field, doc_id, ref, at."""
    o = orphan_keys(refs, parent)
    return refs.alias("r").join(o.alias("o"), _same("r", "o"), "left_semi").distinct()


def explain_orphans(found: DataFrame, parent: DataFrame) -> DataFrame:
    """Orphans with a reason: missing (never a parent), arrives_later (first exists after use), withdrawn (existed before)."""
    life = parent.groupBy("doc_id", "ref").agg(F.min("since").alias("first_since"))
    return found.join(life, ["doc_id", "ref"], "left").withColumn(
        "reason",
        F.when(F.col("first_since").isNull(), "missing").when(F.col("at") < F.col("first_since"), "arrives_later").otherwise("withdrawn"),
    )


def orphan_report(refs: DataFrame, parent: DataFrame, period: str = "month") -> DataFrame:
    """Counts per table, field and period of use: refs, orphan_refs, distinct orphan_keys; a null time is period null."""
    o = orphan_keys(refs, parent).withColumn("orphan", F.lit(1))
    once = refs.distinct().alias("r")
    j = once.join(o.alias("o"), _same("r", "o"), "left").select("r.*", "o.orphan")
    return (
        j.withColumn("period", F.date_trunc(period, "at"))
        # distinct keys by two counted levels, so that a period holding a third of all rows is still spread by key
        .groupBy("table_name", "ref_field", "period", "doc_id", "ref")
        .agg(F.count("*").alias("n"), F.count("orphan").alias("m"))
        .groupBy("table_name", "ref_field", "period")
        .agg(F.sum("n").alias("refs"), F.sum("m").alias("orphan_refs"), F.count_if(F.col("m") > 0).alias("orphan_keys"))
    )
