"""Order-dependent structure of documents: runs, headings, prefix sums.

A document may hold a third of all rows, so nothing here sorts a whole document in one task: each document is cut into
stretches of consecutive places, the windows run inside a stretch, and what the stretches before have to say comes from
one summary row per stretch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellora.functions.text import estimate_tokens, is_blank
from vellora.session import checkpointed

STRETCH = 4096
PREFACE = "Preface/Uncategorized"


def present_paragraphs(paragraphs: DataFrame, at: Column | None = None) -> DataFrame:
    """Paragraphs present at a time (default: now), without blank texts and null places (F01); repeated rows stay."""
    there = F.col("deleted_at").isNull() if at is None else (F.col("loaded_at") <= at) & (F.col("deleted_at").isNull() | (at < F.col("deleted_at")))
    keep = ["doc_id", "pos", "text", "para_id", "para_id_end", "is_table", "level"]
    return paragraphs.filter(there & ~is_blank(F.col("text")) & F.col("pos").isNotNull() & F.col("doc_id").isNotNull()).select(*keep)


def current_paragraphs(paragraphs: DataFrame, at: Column | None = None) -> DataFrame:
    """Paragraphs present at a time (default: now), without repeated rows, blank texts and null places."""
    return present_paragraphs(paragraphs, at).dropDuplicates(["doc_id", "pos"])


def _stretched(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("_s", F.floor(F.col(pos) / size))


def _joined(df: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """Rows with their stretch's carry; the carry has one row per stretch."""
    return df.join(carry, [key, "_s"], "left").drop("_s")


def prefix_sum(df: DataFrame, key: str, order: list[str], value: Column, out: str, size: int = STRETCH) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same key before each row (W09); ``order[0]`` is a whole number."""
    d = _stretched(df, order[0], size).withColumn("_v", F.coalesce(value, F.lit(0)))
    before = Window.partitionBy(key, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(key, "_s").agg(F.sum("_v").alias("_t")).withColumn(
        "_c", F.coalesce(F.sum("_t").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    local = d.withColumn(out, F.coalesce(F.sum("_v").over(before), F.lit(0)))
    return _joined(local, carry.drop("_t"), key).withColumn(out, F.col(out) + F.col("_c")).drop("_v", "_c")


def previous(df: DataFrame, key: str, order: list[str], value: Column, out: str, size: int = STRETCH) -> DataFrame:
    """Adds ``value`` of the row before in the same key; null for the first row."""
    d = _stretched(df, order[0], size).withColumn("_v", value)
    w = Window.partitionBy(key, "_s").orderBy(*order)
    last = d.groupBy(key, "_s").agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    carry = last.withColumn("_c", F.lag("_l").over(Window.partitionBy(key).orderBy("_s"))).drop("_l")
    local = d.withColumn(out, F.lag("_v").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return _joined(local, carry, key).withColumn(out, F.when(F.col("_first"), F.col("_c")).otherwise(F.col(out))).drop("_v", "_c", "_first")


def number_runs(df: DataFrame, key: str, order: list[str], value: Column, starts: Callable[[Column, Column], Column], out: str, size: int = STRETCH) -> DataFrame:
    """Adds the number, from 0, of the run each row is in: ``starts(value, value of the row before)`` begins a new one."""
    d = _stretched(df, order[0], size).withColumn("_v", value)
    w = Window.partitionBy(key, "_s").orderBy(*order)
    begin = lambda a, b: F.coalesce(starts(a, b), F.lit(False)).cast("int")
    local = d.withColumn("_b", F.when(F.row_number().over(w) == 1, 0).otherwise(begin(F.col("_v"), F.lag("_v").over(w))))
    o = F.struct(*order)
    ends = local.groupBy(key, "_s").agg(F.sum("_b").alias("_t"), F.min_by("_v", o).alias("_f"), F.max_by("_v", o).alias("_l"))
    over = Window.partitionBy(key).orderBy("_s")
    ends = ends.withColumn("_e", begin(F.col("_f"), F.lag("_l").over(over)))
    carry = ends.select(key, "_s", (F.coalesce(F.sum(F.col("_t") + F.col("_e")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_e")).alias("_c"))
    local = local.withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(local, carry, key).withColumn(out, (F.col(out) + F.col("_c")).cast("int")).drop("_v", "_b", "_c")


def last_known(df: DataFrame, key: str, order: list[str], value: Column, out: str, size: int = STRETCH) -> DataFrame:
    """Adds the last ``value`` that is not null, of this row or those of the same key before it."""
    d = _stretched(df, order[0], size).withColumn("_v", value)
    upto = Window.partitionBy(key, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = d.groupBy(key, "_s").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_l"))
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_c", F.last("_l", ignorenulls=True).over(before)).drop("_l")
    local = d.withColumn(out, F.last("_v", ignorenulls=True).over(upto))
    return _joined(local, carry, key).withColumn(out, F.coalesce(out, "_c")).drop("_v", "_c")


def split_heading(level: Column, fixlevel: int | None = None) -> Column:
    """Whether a paragraph of this outline level starts a block: any level, or up to ``fixlevel`` if above 0."""
    test = level.isNotNull() if not fixlevel else level <= fixlevel
    return F.coalesce(test, F.lit(False))


def number_blocks(paragraphs: DataFrame, fixlevel: int | None = None, size: int = STRETCH) -> DataFrame:
    """Adds block_no from 0 (W01): a heading starts a block if the paragraph before is none; so do forced places.

    ``force`` (optional boolean column) and ``sub`` (optional order within a place) come from table placement.
    """
    order = ["pos", "sub"] if "sub" in paragraphs.columns else ["pos"]
    forced = F.coalesce(F.col("force"), F.lit(False)) if "force" in paragraphs.columns else F.lit(False)
    p = paragraphs.withColumn("is_split", split_heading(F.col("level"), fixlevel))
    v = F.struct(F.col("is_split").alias("h"), forced.alias("f"))
    return checkpointed(number_runs(p, "doc_id", order, v, lambda x, before: (x["h"] & ~before["h"]) | (x["f"] & before.isNotNull()), "block_no", size))


def parent_headings(headings: DataFrame, size: int = STRETCH) -> DataFrame:
    """Adds parent_headings (W02) to heading rows (doc_id, pos, text, level): the open headings above each, outermost first.

    A heading of level L closes all of level L and deeper. The last heading of level k counts if none of a higher
    rank came after it.
    """
    h = _stretched(headings, "pos", size)
    here = [F.when(F.col("level") == k, F.struct("pos", "text")) for k in range(1, 10)]
    w = Window.partitionBy("doc_id", "_s").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = h.groupBy("doc_id", "_s").agg(*[F.max(x).alias(f"_m{k}") for k, x in enumerate(here, 1)])
    up = Window.partitionBy("doc_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = top.select("doc_id", "_s", *[F.max(f"_m{k}").over(up).alias(f"_c{k}") for k in range(1, 10)])
    local = h.select("*", *[F.max(x).over(w).alias(f"_l{k}") for k, x in enumerate(here, 1)])
    j = _joined(local, carry, "doc_id")
    at = {k: F.coalesce(F.col(f"_l{k}"), F.col(f"_c{k}")) for k in range(1, 10)}

    def open_(k: int) -> Column:
        above = [at[i]["pos"] for i in range(1, k)]
        cover = reduce(lambda a, b: F.greatest(a, b), [F.coalesce(x, F.lit(-1)) for x in above], F.lit(-1).cast("bigint"))
        return F.when((F.col("level") > k) & (at[k]["pos"] > cover), at[k]["text"])

    out = j.withColumn("parent_headings", F.array_compact(F.array(*[open_(k) for k in range(1, 10)])))
    return out.drop(*[f"_{a}{k}" for a in "lc" for k in range(1, 10)])


def assemble(paragraphs: DataFrame, by: list[str], order: list[str], join: str = "\n", also: list[Column] | None = None) -> DataFrame:
    """One row per group (A11, W04): content in order, first id, last end id, number of paragraphs, and ``also``."""
    o = F.struct(*order)
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return paragraphs.groupBy(*by).agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), join).alias("content"),
        F.min_by("para_id", o).alias("uuid"), F.max_by(F.coalesce("para_id_end", "para_id"), o).alias("uuid_end"), F.count("*").alias("n_paragraphs"), *(also or []),
    )


def unsplit_blocks(paragraphs: DataFrame, fixlevel: int | None = None, size: int = STRETCH) -> DataFrame:
    """Blocks by headings alone (W01-W04): doc_id, block_no, uuid, uuid_end, heading, level, parent_headings, content, tokens."""
    p = number_blocks(paragraphs, fixlevel, size) if "block_no" not in paragraphs.columns else paragraphs
    order = ["pos", "sub"] if "sub" in p.columns else ["pos"]
    parents = parent_headings(p.filter(F.col("is_split")).select("doc_id", "pos", "text", "level"), size).select("doc_id", "pos", "parent_headings")
    none = F.array().cast("array<string>")
    head = F.min_by(F.struct("pos", F.when(F.col("is_split"), F.col("text")).alias("text"), "level", "is_split"), F.struct(*order)).alias("h")
    b = assemble(p, ["doc_id", "block_no"], order, also=[head]).withColumn("pos", F.col("h.pos"))
    named = b.join(parents, ["doc_id", "pos"], "left").drop("pos").withColumns(
        {"heading": F.when(F.col("h.is_split"), F.col("h.text")).otherwise(PREFACE), "level": F.when(F.col("h.is_split"), F.col("h.level")).otherwise(1), "parent_headings": F.coalesce("parent_headings", none)}
    )
    return named.drop("h").withColumn("tokens", estimate_tokens(F.col("content")))


def fixlevel_warnings(blocks: DataFrame, limit: int = 8000) -> DataFrame:
    """What a fixed level leaves to warn about (W03): oversize blocks, and documents without any matching heading."""
    over = blocks.filter(F.col("tokens") > limit).select("doc_id", "block_no", F.lit("oversize").alias("warning"))
    none = blocks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("heading").alias("h")).filter((F.col("n") == 1) & (F.col("h") == PREFACE)).select("doc_id", F.lit(0).alias("block_no"), F.lit("no match").alias("warning"))
    return over.unionByName(none)
