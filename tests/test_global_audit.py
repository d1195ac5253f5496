import pytest

from vellora.operators import audit as au
from vellora.operators import global_audit as ga
from vellora.plans.findings import _global_rules

BLOCKS = "doc_id string, block_idx int, uuid string, uuid_end string, heading string, content string, parent_headings array<string>"
PATTERNS = [ga.FieldPattern("G1", "credits", r"([0-9]+) credits"), ga.FieldPattern("G9", "x", "(x)")]


def rows(spark, *texts):
    return spark.createDataFrame([("d", i, f"U{i}", f"E{i}", "h", t, []) for i, t in enumerate(texts)], BLOCKS)


def run(spark, blocks, extractor=None, verifier=ga.differing_values, rules=None, **more):
    return ga.two_phases(blocks, rules if rules is not None else _global_rules(spark), lambda b: au.audit_by_rules(b, []), extractor or ga.pattern_extractor(PATTERNS), verifier, workers=2, tries=0, first_wait=0, **more)


def test_values_that_differ_are_found(spark):
    out = run(spark, rows(spark, "5 credits x", "7 credits and 5 credits", None, ""))
    assert out.status == "done"
    assert sorted((r.rule_id, r.uuid, r.violation_text) for r in out.findings.collect()) == [("G1", "U0", "5 credits"), ("G1", "U1", "5 credits"), ("G1", "U1", "7 credits")]
    assert run(spark, rows(spark, "5 credits", "5 credits")).findings.count() == 0
    assert run(spark, rows(spark, "x").limit(0)).findings.count() == 0


def test_no_global_rules_no_global_phase(spark):
    out = run(spark, rows(spark, "5 credits"), rules=_global_rules(spark).filter("type <> 'global'"))
    assert out.status == "done" and out.findings is None and out.entries.count() == 1


def test_a_failure_ends_the_run_after_its_phase(spark):
    def fails(*_):
        raise au.NonRetryable("no")

    assert run(spark, rows(spark, "a"), extractor=fails).status == "aborted: extraction"
    assert run(spark, rows(spark, "1 credits"), verifier=fails).status == "aborted: verification"


def test_chunks_keep_the_order_and_the_budget(spark):
    i = ga.items(ga.extract(rows(spark, *[f"{k} credits" for k in range(12)]), ga.pattern_extractor(PATTERNS), workers=2))
    got = ga.chunks(i, budget=40).orderBy("block_idx").collect()
    assert [r.chunk_no for r in got] == sorted(r.chunk_no for r in got) and got[-1].chunk_no > 1
    assert {r.chunk_no for r in ga.chunks(i, budget=10**6).collect()} == {0}


def test_odd_entries(spark):
    e = spark.createDataFrame(
        [("d", 0, None, None, None, [None, {"rule_id": None, "extracted_results": [{"entity": "e", "fields": []}]}, {"rule_id": "G1", "extracted_results": [None, {"entity": None, "fields": None}]}], None), ("d", 1, None, None, None, None, "down")],
        ga.EXTRACTION,
    )
    assert [(r.rule_id, r.item_no) for r in ga.items(e).collect()] == [("G1", 2_000_001)]
    assert [tuple(r) for r in ga.entity_counts(e).collect()] == [("G1", 1, 1, 0)]
    assert ga.verify(ga.chunks(ga.items(e))).collect()[0].violations == []


def test_recovery(spark, tmp_path):
    m, b = str(tmp_path / "m"), rows(spark, "a", "b")
    entries = au.audit_by_rules(b, []).drop("violations")
    assert ga.recover(spark, b, m) == "none"
    entries.write.parquet(m + "_backup")
    entries.limit(1).write.parquet(m)  # the rewriting that did not end
    assert ga.recover(spark, b, m) == "restored" and spark.read.parquet(m).count() == 2
    assert not (tmp_path / "m_backup").exists() and ga.recover(spark, b, m) == "none"
    entries.filter("block_idx = 0").write.parquet(m + "_backup")
    assert ga.recover(spark, b, m) == "continued" and spark.read.parquet(m).count() == 1
    with pytest.raises(Exception):
        ga.move(spark, str(tmp_path / "absent"), str(tmp_path / "to"))
