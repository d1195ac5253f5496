"""Auditing: a rule engine of expressions, model calls with retries, and consistency over blocks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.functions.text import estimate_tokens
from vellora.operators.flatten import VIOLATION_FIELDS, flatten


@dataclass(frozen=True)
class PatternRule:
    """A rule the deterministic auditor can apply: a pattern (Java syntax), and a correction or none."""

    id: str
    pattern: str
    reason: str
    correction: str | None = None
    category: str = "other"


#: Rules of the default auditor: an extension, so that audits run without a model.
DEFAULT_RULES = [
    PatternRule("X001", r"\b(\w+) \1\b", "the same word twice", None, "grammar"),
    PatternRule("X002", r"[（(][^()（）]{120,}[)）]", "very long parenthesis", None, "structure"),
    PatternRule("X003", r" {2,}", "several blanks", " ", "format"),
    PatternRule("X004", r"[0-9]{5,}", "long number without separators", None, "number"),
]


def rule_engine(content: Column, rules: list[PatternRule] | None = None) -> Column:
    """array<violation> of a text: every match of every rule, in order of rule and place; stays in the JVM."""
    parts = [_matches(content, r) for r in (DEFAULT_RULES if rules is None else rules)]
    return F.flatten(F.array(*parts)) if parts else F.array()


def _matches(content: Column, r: PatternRule) -> Column:
    action, revised = ("manual", "") if r.correction is None else ("replace", r.correction)
    fixed = {"violation_reason": r.reason, "fix_action": action, "revised_text": revised, "category": r.category}
    return F.transform(
        F.regexp_extract_all(content, F.lit(r.pattern), 0),
        lambda m: F.struct(F.lit(r.id).alias("rule_id"), m.alias("violation_text"), *[F.lit(v).alias(k) for k, v in fixed.items()]),
    )


def audit_by_rules(blocks: DataFrame, rules: list[PatternRule] | None = None) -> DataFrame:
    """Manifest entries of blocks by the rule engine (G01, G07): the flag follows from the findings."""
    return blocks.select("doc_id", "block_idx", "uuid", "uuid_end", F.col("heading").alias("p_heading"), F.col("content").alias("p_content"), F.coalesce(rule_engine(F.col("content"), rules), F.array()).alias("violations")).withColumn(
        "is_violation", F.size("violations") > 0
    )


def rules_from(rules: DataFrame) -> list[PatternRule]:
    """Rules the deterministic auditor can apply: those whose description is a pattern between slashes, in order of id."""
    rows = rules.filter(F.col("description").rlike("^/.+/$")).orderBy("id").toLocalIterator()  # a rule set is small by nature
    return [PatternRule(r.id, r.description[1:-1], r.description, None, r.category or "other") for r in rows]


def block_range(blocks: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Blocks with numbers from start to end, both included (F02); an end below 0 means the last block."""
    taken = F.col("block_idx") >= start
    return blocks.filter(taken if end < 0 else taken & (F.col("block_idx") <= end))


def dry_run(blocks: DataFrame) -> DataFrame:
    """What an audit would take (R08): documents, blocks, and tokens of their contents, in one row; no auditor is asked."""
    b = blocks.dropDuplicates(["doc_id", "block_idx"])
    return b.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks"), F.coalesce(F.sum(estimate_tokens(F.col("content"))), F.lit(0)).alias("tokens"))


class NonRetryable(Exception):
    """An error that another try cannot mend."""


def with_retries(call: Callable[[dict], list[dict]], row: dict, tries: int = 3, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The call's answer (G05): up to ``tries`` more tries with doubling waits and a tenth of jitter; NonRetryable ends at once."""
    for k in range(tries + 1):
        try:
            return call(row)
        except NonRetryable:
            raise
        except Exception:
            if k == tries:
                raise
            wait = min(first * 2**k, most)
            sleep(wait * random.uniform(0.9, 1.1))
    raise AssertionError


VIOLATION_LIST = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in VIOLATION_FIELDS]))


def audit_by_model(blocks: DataFrame, auditor: Callable[[dict], list[dict]], workers: int = 5, delay: float = 0.05, tries: int = 3, first_wait: float = 1.0) -> DataFrame:
    """Manifest entries by a pluggable auditor.

    ``auditor`` gets doc_id, uuid, heading, content and parent_headings of a block and gives violations. At most
    ``workers`` tasks call it, with a pause after each call. A failed block has its error, no findings and no flag,
    and stays pending. Findings get the block's ids where they carry none.
    """
    kept = ["doc_id", "block_idx", "uuid", "uuid_end", "heading", "content", "parent_headings"]
    schema = T.StructType([blocks.schema[c] for c in kept[:4]] + [T.StructField("p_heading", T.StringType()), T.StructField("p_content", T.StringType()), T.StructField("violations", VIOLATION_LIST), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for row in p.to_dict("records"):
                found, error = [], None
                try:
                    answer = with_retries(auditor, row, tries, first_wait)
                    found = [{f: v.get(f) for f in VIOLATION_FIELDS} | {"uuid": v.get("uuid") or row["uuid"], "uuid_end": v.get("uuid_end") or row["uuid_end"]} for v in answer]
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:500]
                out.append((row["doc_id"], row["block_idx"], row["uuid"], row["uuid_end"], row["heading"], row["content"], found, error))
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(out, columns=schema.names)

    return blocks.select(*kept).repartition(workers).mapInPandas(run, schema).withColumn("is_violation", F.when(F.col("error").isNull(), F.size("violations") > 0))


def extraction_items(extractions: DataFrame, keys: list[str]) -> DataFrame:
    """Flat items of extraction entries (D11, D12): the keys, result_no, rule_id, item_no, entity and fields, each item with its places."""
    results = flatten(extractions, keys, ["results"], ["result_no"]).filter("rule_id is not null")
    return flatten(results.select(*keys, "result_no", "rule_id", "extracted_results"), [*keys, "result_no", "rule_id"], ["extracted_results"], ["item_no"])


def rule_buckets(rules: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """Items of each known rule in a fixed order; rules without items have none."""
    r = rules.select(F.col("id").alias("rule_id")).distinct()
    got = r.join(items, "rule_id", "left")
    packed = F.array_sort(F.collect_list(F.when(F.col(order[0]).isNotNull(), F.struct(*order, *[c for c in items.columns if c not in (*order, "rule_id")]))))
    return got.groupBy("rule_id").agg(packed.alias("items")).withColumn("n_items", F.size("items"))


def value_conflicts(values: DataFrame) -> DataFrame:
    """Consistency check (G03): rule, entity and field with more than one value that is not blank, and how many.

    Two counted levels, so that an entity holding most rows is spread by value first.
    """
    v = values.filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    one = v.groupBy("rule_id", "entity", "field", "value").agg(F.count("*").alias("n"))
    return one.groupBy("rule_id", "entity", "field").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_items")).filter("n_values > 1")


def conflict_violations(values: DataFrame) -> DataFrame:
    """One manual finding per item of a conflict."""
    c = value_conflicts(values).select("rule_id", "entity", "field", "n_values")
    return values.filter(F.coalesce(F.trim("value"), F.lit("")) != "").join(c, ["rule_id", "entity", "field"]).withColumn("fix_action", F.lit("manual"))
