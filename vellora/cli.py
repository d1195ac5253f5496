"""Command line: python -m vellora.cli rules | parse | audit | report | apply | query."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellora.operators import audit as au
from vellora.operators import chunking as ch
from vellora.operators import edits as ed
from vellora.operators import manifest as mf
from vellora.operators import report as rp
from vellora.operators import rules as rl
from vellora.session import checkpointed, session
from vellora.sources import docx as dx
from vellora.sources import jsonl as jl

#: Stages with their options beyond source and target.
STAGES = {
    "rules": ["--merge"], "parse": ["--fixlevel", "--strict?"], "audit": ["--rules", "--start", "--end", "--dry-run?"], "report": ["--xlsx"], "apply": ["--items", "--author", "--skip-hash?", "--dry-run?"],
}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)


def rules(spark: SparkSession, args: argparse.Namespace) -> int:
    """Rule files brought to one set (R09, K09): later files win, ids are kept; written as one readable JSON file."""
    files = [args.source, *(args.merge.split(",") if args.merge else [])]
    every = rl.union_last([jl.read_rules(spark, f) for f in files])
    # a rule set is small by nature: it is one prompt
    rows = [r.asDict(recursive=True) for r in every.orderBy("id").toLocalIterator()]
    with open(args.target, "w", encoding="utf-8") as f:
        f.write(jl.rules_json(rows))
    print(json.dumps({"rules": len(rows)}))
    return 0


def parse(spark: SparkSession, args: argparse.Namespace) -> int:
    """Documents to blocks; 1 if a document was unreadable or a block stayed above the limit."""
    paras = dx.read_binary(_documents(spark, args.source))
    bad = paras.filter("pos is null").count()
    level = None if args.fixlevel is None else int(args.fixlevel)
    ch.build_blocks(paras.filter("pos is not null").drop("source_hash"), level, args.strict).write.mode("overwrite").parquet(args.target)
    over = spark.read.parquet(args.target).filter("oversize").count()
    print(json.dumps({"unreadable": bad, "oversize": over}))
    return int(bad + (over if level is None else 0) > 0)


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Blocks to manifest entries by the rule engine (R07): 1 if a block failed. A dry run only counts the blocks it would audit."""
    blocks = spark.read.parquet(args.source)
    blocks = blocks if "block_idx" in blocks.columns else blocks.withColumnRenamed("block_no", "block_idx")
    blocks = au.block_range(blocks, int(args.start or 0), -1 if args.end is None else int(args.end))
    if args.dry_run:
        print(json.dumps(au.dry_run(blocks).first().asDict()))
        return 0
    known = au.rules_from(jl.read_rules(spark, args.rules)) if args.rules else None
    out = au.audit_by_rules(blocks, known).withColumn("entry_id", F.xxhash64("doc_id", "block_idx"))
    shape = F.transform("violations", lambda v: F.struct(*[(v[f] if f in ("rule_id", "violation_text", "violation_reason", "fix_action", "revised_text", "category") else F.lit(None).cast("string")).alias(f) for f in mf.VIOLATION_FIELDS]))
    out.withColumn("violations", shape).write.mode("overwrite").parquet(args.target)
    done = spark.read.parquet(args.target)
    failed = done.filter("error is not null").count() if "error" in done.columns else 0
    return int(failed > 0)


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    """Report rows as JSON lines, counts as report.json beside them (K08), and a workbook if asked for."""
    m = spark.read.parquet(args.source)
    rows = rp.report_rows(m)
    jl.write_lines(rows, args.target)
    counts = {**rp.totals(m).first().asDict(), "by_category": {r.category: r.n for r in rp.by_category(rows).collect()}}
    text = json.dumps(counts, ensure_ascii=False)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(args.target.rstrip("/") + "_summary")
    print(text)
    if args.xlsx:  # for people: read back and written row by row
        with open(args.xlsx, "wb") as f:
            jl.write_xlsx(f, jl.SHEET, (tuple(r) for r in jl.sheet(rows).orderBy("uuid").toLocalIterator()))
    return 0


def apply(spark: SparkSession, args: argparse.Namespace) -> int:
    """Findings into documents (R09): edited documents as files below the target, failed items as JSON lines beside it.

    Items are lines with doc_id, or meant for the only document of the source. Documents whose bytes changed since they
    were audited stop the run, unless skipped. A dry run applies without writing documents. 1 if an item failed.
    """
    docs = _documents(spark, args.source).select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")
    lines = spark.read.json(args.items)
    if "doc_id" not in lines.columns:
        names = [r.doc_id for r in docs.select("doc_id").limit(2).collect()]
        if len(names) != 1:
            raise SystemExit("items without doc_id need a source of one document")
        lines = lines.withColumn("doc_id", F.lit(names[0]))
    meta = lines.filter("type = 'meta'") if "type" in lines.columns else lines.limit(0)
    if not args.skip_hash and "source_hash" in lines.columns and not ed.verify_hashes(docs, meta.select("doc_id", "source_hash")).isEmpty():
        print("a document is not the one that was audited", file=sys.stderr)
        return 1
    items = ed.items_of(lines)
    edited, results = ed.apply_edits(docs, items, args.author or "AI")
    results = checkpointed(results)
    failed = items.join(results.filter("not success or warning").select("doc_id", "item_id", "status", F.col("message").alias("_error")), ["doc_id", "item_id"])
    jl.write_lines(failed, args.target.rstrip("/") + "_failed")
    print(json.dumps(ed.summary(results).first().asDict()))
    if not args.dry_run:
        ed.write_documents(edited, args.target)
    return int(not results.filter("not success").isEmpty())


def main(argv: list[str] | None = None) -> int:
    """Runs one stage (R09); 0 if it went well, 1 if blocks or items failed."""
    ap = argparse.ArgumentParser(prog="vellora", description="Audits of structured documents on Spark.")
    sub = ap.add_subparsers(dest="stage", required=True)
    for name, more in STAGES.items():
        p = sub.add_parser(name, help=globals()[name].__doc__.split(".")[0])
        p.add_argument("source")
        p.add_argument("target", **({"nargs": "?"} if name == "audit" else {}))
        for m in more:
            p.add_argument(m.rstrip("?"), **({"action": "store_true"} if m.endswith("?") else {}))
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("tables")
    args = ap.parse_args(argv)
    spark = session("vellora-" + args.stage)
    if args.stage in STAGES:
        return globals()[args.stage](spark, args)
    from vellora.plans import ALL

    found = {k: q for r in ALL for k, q in r.queries.items()}
    if args.name not in found:
        print("queries: " + " ".join(sorted(found)), file=sys.stderr)
        return 2
    found[args.name](spark, args.tables).show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
