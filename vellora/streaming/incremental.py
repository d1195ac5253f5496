"""Incremental audits: new blocks are audited once, progress survives restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vellora.operators import manifest as mf
from vellora.session import checkpointed


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _audit(spark: SparkSession, blocks: DataFrame, manifest_dir: str, failed_dir: str, audit: Callable[[DataFrame], DataFrame]) -> None:
    """Audits the blocks that are not in the manifest; findings go there, blocks whose audit failed to ``failed_dir``."""
    todo = blocks.dropDuplicates(["doc_id", "block_idx"])
    done = _read(spark, manifest_dir)
    todo = mf.pending(todo, done).drop("key") if done is not None else todo
    out = audit(todo)
    if "error" not in out.columns:
        out.write.mode("append").parquet(manifest_dir)
        return
    out = checkpointed(out)  # an auditor is asked once, not for each of the two results
    bad = out.filter("error is not null").select("doc_id", "block_idx")
    blocks.dropDuplicates(["doc_id", "block_idx"]).join(bad, ["doc_id", "block_idx"], "left_semi").write.mode("append").parquet(failed_dir)
    out.filter("error is null").drop("error").write.mode("append").parquet(manifest_dir)


def audit_stream(spark: SparkSession, blocks_dir: str, schema: StructType, manifest_dir: str, checkpoint_dir: str, audit: Callable[[DataFrame], DataFrame], failed_dir: str | None = None) -> int:
    """Audits all files that arrived in ``blocks_dir`` since the last run (R01, R04, K03) and gives the number of batches.

    ``audit`` turns blocks into manifest entries (doc_id, uuid, ..). Each batch appends to the manifest; blocks whose
    id is there already are left out by an anti-join below the auditor, so a batch replayed after a failure, or a block
    delivered twice, adds nothing. Blocks with an error are kept in ``failed_dir`` (default: the manifest's folder with
    _failed behind it) before the batch counts as done, and every later run begins with them, until they are in the
    manifest.
    """
    failed_dir = failed_dir or manifest_dir.rstrip("/") + "_failed"
    retry_failed(spark, manifest_dir, failed_dir, audit)
    one = lambda batch, _: _audit(spark, batch, manifest_dir, failed_dir, audit)
    q = spark.readStream.schema(schema).parquet(blocks_dir).writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).foreachBatch(one).start()
    q.awaitTermination()
    return len(q.recentProgress)


def retry_failed(spark: SparkSession, manifest_dir: str, failed_dir: str, audit: Callable[[DataFrame], DataFrame]) -> int:
    """Audits the blocks of ``failed_dir`` that are not in the manifest yet (R05); gives how many are left."""
    left = lambda: None if (f := _read(spark, failed_dir)) is None else f if (m := _read(spark, manifest_dir)) is None else mf.pending(f, m).drop("key")
    todo = left()
    if todo is None or todo.isEmpty():
        return 0
    _audit(spark, checkpointed(todo), manifest_dir, failed_dir, audit)
    return left().select("doc_id", "block_idx").distinct().count()
