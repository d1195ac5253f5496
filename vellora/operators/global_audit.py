"""Audits over whole documents: values extracted from every block, verified together rule by rule."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.operators import chunking as ch
from vellora.operators import manifest as mf
from vellora.operators.audit import VIOLATION_LIST, extraction_items, with_retries
from vellora.operators.flatten import VIOLATION_FIELDS
from vellora.operators.rules import rule_type
from vellora.session import checkpointed

FIELD = "struct<name:string,value:string,evidence:string>"
RESULT = f"struct<rule_id:string,extracted_results:array<struct<entity:string,fields:array<{FIELD}>>>>"
EXTRACTION = f"doc_id string, block_idx int, uuid string, uuid_end string, p_heading string, results array<{RESULT}>, error string"
ITEM = f"doc_id string, rule_id string, block_idx int, item_no int, uuid string, uuid_end string, p_heading string, entity string, fields array<{FIELD}>"


def split_by_type(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block rules and global rules (F03); a rule without a type is a block rule."""
    typed = rules.withColumn("type", rule_type(F.col("type"), F.lit(None).cast("string")))
    return typed.filter("type <> 'global'"), typed.filter("type = 'global'")


@dataclass(frozen=True)
class FieldPattern:
    """What the deterministic extractor takes from a block: each match is an item, its group 1 the value of ``name``."""

    rule_id: str
    name: str
    pattern: str
    entity: str = "document"


def pattern_extractor(patterns: list[FieldPattern]) -> Callable[[dict], list[dict]]:
    """An extractor that needs no model: one item per match, with the match as evidence."""
    compiled = [(p, re.compile(p.pattern)) for p in patterns]

    def extract(block: dict) -> list[dict]:
        out = []
        for p, c in compiled:
            found = [{"entity": p.entity, "fields": [{"name": p.name, "value": m.group(1), "evidence": m.group(0)}]} for m in c.finditer(block["content"] or "")]
            if found:
                out.append({"rule_id": p.rule_id, "extracted_results": found})
        return out

    return extract


def extract(blocks: DataFrame, extractor: Callable[[dict], list[dict]], workers: int = 5, delay: float = 0.0, tries: int = 3, first_wait: float = 1.0) -> DataFrame:
    """Extraction entries (G02, R03), columns of EXTRACTION, one per block.

    ``extractor`` gets doc_id, uuid, heading, content and parent_headings of a block and gives results
    {rule_id, extracted_results: [{entity, fields: [{name, value, evidence}]}]}. At most ``workers`` tasks call it. A
    failed block has its error and no results.
    """
    kept = ["doc_id", "block_idx", "uuid", "uuid_end", "heading", "content", "parent_headings"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for row in p.to_dict("records"):
                found, error = [], None
                try:
                    found = [{"rule_id": r.get("rule_id"), "extracted_results": [{"entity": x.get("entity"), "fields": [{k: f.get(k) for k in ("name", "value", "evidence")} for f in x.get("fields") or []]} for x in r.get("extracted_results") or []]} for r in with_retries(extractor, row, tries, first_wait)]
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((row["doc_id"], row["block_idx"], row["uuid"], row["uuid_end"], row["heading"], found, error))
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "uuid", "uuid_end", "p_heading", "results", "error"])

    return blocks.select(*kept).repartition(workers, "doc_id", "block_idx").mapInPandas(run, EXTRACTION)


def items(extractions: DataFrame) -> DataFrame:
    """Flat items, columns of ITEM (D11, D12): entries, results and items without an id or null have none.

    ``item_no`` counts the items of a block over all its results, in order.
    """
    keys = ["doc_id", "block_idx", "uuid", "uuid_end", "p_heading"]
    flat = extraction_items(extractions, keys)
    return flat.select("doc_id", "rule_id", "block_idx", (F.col("result_no") * 1_000_000 + F.col("item_no")).cast("int").alias("item_no"), "uuid", "uuid_end", "p_heading", "entity", "fields")


def with_topic(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Items with their rule's topic and category; '' and other where it has none or is unknown."""
    r = rules.select(F.col("id").alias("rule_id"), F.col("topic").alias("_t"), F.col("category").alias("_c")).dropDuplicates(["rule_id"])
    return found.join(r, "rule_id", "left").withColumns({"topic": F.coalesce("_t", F.lit("")), "category": F.coalesce("_c", F.lit("other"))}).drop("_t", "_c")


def of_known_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Items whose rule is there."""
    return found.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")


def entity_counts(extractions: DataFrame) -> DataFrame:
    """Per rule: blocks with results, items and fields (A07), straight from the nested entries."""
    r = extractions.select("doc_id", "block_idx", F.explode(F.filter("results", lambda x: x.isNotNull() & x["rule_id"].isNotNull())).alias("r"))
    n = F.coalesce(F.size(F.filter("r.extracted_results", lambda x: x.isNotNull())), F.lit(0))
    fields = F.aggregate(F.coalesce("r.extracted_results", F.array()), F.lit(0), lambda acc, x: acc + F.greatest(F.coalesce(F.size(x["fields"]), F.lit(0)), F.lit(0)))
    per = r.select("doc_id", "block_idx", F.col("r.rule_id").alias("rule_id"), n.alias("n"), fields.alias("f")).filter("n > 0")
    return per.groupBy("rule_id", "doc_id", "block_idx").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).groupBy("rule_id").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_items"), F.sum("f").alias("n_fields"))


def item_text(c: str = "") -> Column:
    """An item as the verifier reads it: its id and entity, then a line per field."""
    e = lambda x: F.coalesce(x, F.lit(""))
    lines = F.array_join(F.transform(F.coalesce("fields", F.array()), lambda f: F.concat(F.lit("\n  "), e(f["name"]), F.lit(": "), e(f["value"]))), "")
    return F.concat(F.lit("["), e(F.col("uuid")), F.lit("] "), e(F.col("entity")), lines)


def chunks(found: DataFrame, budget: int = 120_000, size: int = ch.IDEAL) -> DataFrame:
    """Items with chunk_no (X05): those of a document and rule in order of block and place, as many as fit the budget."""
    i = ch.with_counts(found.withColumn("_t", item_text()), "_t").drop("_t").withColumn("_k", F.concat_ws("\x00", "doc_id", "rule_id"))
    return ch.pack_by_budget(i, "_k", ["block_idx", "item_no"], ["n_cjk", "n_json", "n_other"], budget).drop("_k", "n_cjk", "n_json", "n_other", "tokens_so_far")


def differing_values(rule_id: str, rows: list[dict]) -> list[dict]:
    """A verifier that needs no model: items of one entity and field that do not all have the same value."""
    values: dict[tuple, set] = {}
    for r in rows:
        for f in r["fields"]:
            if (f["value"] or "").strip():
                values.setdefault((r["entity"], f["name"]), set()).add(f["value"])
    out = []
    for r in rows:
        for f in r["fields"]:
            if len(seen := values.get((r["entity"], f["name"]), ())) > 1 and (f["value"] or "").strip():
                out.append({"uuid": r["uuid"], "uuid_end": r["uuid_end"], "violation_text": f["evidence"], "violation_reason": f"{f['name']} has {len(seen)} values", "fix_action": "manual", "revised_text": ""})
    return out


_VERIFIED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("violations", VIOLATION_LIST), T.StructField("error", T.StringType())])


def verify(packed: DataFrame, verifier: Callable[[str, list[dict]], list[dict]] = differing_values, tries: int = 3, first_wait: float = 1.0) -> DataFrame:
    """One row per document, rule and chunk with the verifier's findings or its error.

    ``verifier`` gets a rule's id and the items of one chunk in order; a group is bounded by the chunk's budget.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["block_idx", "item_no"])
        rule = p["rule_id"].iloc[0]
        rows = [{**r, "fields": [dict(f) for f in (() if r["fields"] is None else r["fields"]) if f is not None]} for r in p[["uuid", "uuid_end", "p_heading", "entity", "fields"]].to_dict("records")]
        found, error = [], None
        try:
            answer = with_retries(lambda _: verifier(rule, rows), {}, tries, first_wait)
            found = [{f: v.get(f) for f in VIOLATION_FIELDS} | {"rule_id": rule} for v in answer]
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
        return pd.DataFrame([(p["doc_id"].iloc[0], rule, p["chunk_no"].iloc[0], found, error)], columns=_VERIFIED.names)

    return packed.groupBy("doc_id", "rule_id", "chunk_no").applyInPandas(run, _VERIFIED)


@dataclass
class Outcome:
    """Result of an audit in two phases: done, or aborted after a phase with failures; entries of the block phase, findings of the global one."""

    status: str
    entries: DataFrame
    extractions: DataFrame | None = None
    findings: DataFrame | None = None


def two_phases(
    blocks: DataFrame, rules: DataFrame, audit: Callable[[DataFrame], DataFrame], extractor: Callable[[dict], list[dict]], verifier: Callable[[str, list[dict]], list[dict]] = differing_values,
    budget: int = 120_000, workers: int = 5, tries: int = 3, first_wait: float = 1.0,
) -> Outcome:
    """Block audit, then extraction and verification for global rules.

    A failed block ends the run after its phase: global findings on part of a document would be wrong. Without global
    rules the block phase is all. Each phase is written once before the next begins, so this runs jobs.
    """
    _, wanted = split_by_type(rules)
    entries = checkpointed(audit(blocks))
    if "error" in entries.columns and not entries.filter("error is not null").isEmpty():
        return Outcome("aborted: audit", entries)
    if wanted.isEmpty():
        return Outcome("done", entries)
    extractions = checkpointed(extract(blocks, extractor, workers, tries=tries, first_wait=first_wait))
    if not extractions.filter("error is not null").isEmpty():
        return Outcome("aborted: extraction", entries, extractions)
    verified = checkpointed(verify(chunks(of_known_rules(items(extractions), wanted), budget), verifier, tries, first_wait))
    if not verified.filter("error is not null").isEmpty():
        return Outcome("aborted: verification", entries, extractions)
    found = verified.select("doc_id", "chunk_no", F.posexplode("violations").alias("at", "v")).select("doc_id", F.col("v.*"), (F.col("chunk_no") * 1_000_000 + F.col("at")).alias("no"))
    return Outcome("done", entries, extractions, found)


def merged(manifest: DataFrame, findings: DataFrame, blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """The manifest's findings with those of the global rules, flat (R06): what a run before left of these rules goes first, so a run again adds nothing."""
    _, wanted = split_by_type(rules)
    ids = [r.id for r in wanted.select("id").distinct().collect()]  # a rule set is small by nature
    v = mf.violations(mf.strip_rules(mf.entries(manifest), ids))
    old = v.drop("uuid").withColumnRenamed("e_doc_id", "doc_id").withColumnRenamed("e_uuid", "uuid")
    return mf.merge_violations(old, findings, blocks, rules)


# ---- backups -------------------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, *names: str):
    jvm = spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def move(spark: SparkSession, source: str, target: str) -> str:
    """Moves a folder; copies it where it cannot be renamed (R05): moved or copied."""
    fs, (a, b) = _paths(spark, source, target)
    if fs.rename(a, b):
        return "moved"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, conf):
        raise OSError(f"cannot move or copy {source}")
    return "copied"


def recover(spark: SparkSession, blocks: DataFrame, manifest_dir: str, backup_dir: str | None = None) -> str:
    """What to do with a manifest's backup from a run that did not end (R05): none, restored or continued.

    A backup that covers all blocks becomes the manifest again and nothing is left to audit (restored). One that does
    not takes the manifest's place, too, and the audit goes on from there (continued). A manifest left beside the backup
    is the unfinished rewriting of it and is dropped first.
    """
    backup_dir = backup_dir or manifest_dir.rstrip("/") + "_backup"
    fs, (manifest, backup) = _paths(spark, manifest_dir, backup_dir)
    if not fs.exists(backup):
        return "none"
    complete = mf.is_complete(blocks, spark.read.parquet(backup_dir))
    if fs.exists(manifest):
        fs.delete(manifest, True)
    move(spark, backup_dir, manifest_dir)
    return "restored" if complete else "continued"
