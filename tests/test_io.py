import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.test_docx import STYLES, make, p
from vellora import cli
from vellora.operators import audit as au
from vellora.operators import manifest as mf
from vellora.operators import match as mt
from vellora.operators import rules as rl
from vellora.operators import structure as st
from vellora.sources import jsonl as jl
from vellora.streaming.incremental import audit_stream, retry_failed


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_tolerant_and_strict_lines(spark, tmp_path):
    at = lines(tmp_path / "m.jsonl", [{"type": "meta", "source_hash": "h"}, "", {"uuid": "A", "violations": []}, "  ", '{"uuid": "B", "viol'])
    got = jl.read_lines(spark, at, jl.MANIFEST)
    assert sorted(r.uuid or "" for r in got.collect()) == ["", "A"]
    assert jl.read_lines(spark, str(tmp_path / "none"), jl.MANIFEST).count() == 0
    with pytest.raises(Exception):
        jl.read_lines(spark, at, jl.MANIFEST, True).collect()


def test_blocks_rules_items(spark, tmp_path):
    block = {"uuid": "A", "uuid_end": "B", "heading": "h", "content": "c", "type": "text", "parent_headings": ["x"], "level": 1}
    for name, rows in (("b.jsonl", [{"type": "meta", "source_hash": "s"}, block]), ("l.json", [[{"type": "meta"}, block]]), ("o.json", [{"blocks": [block], "meta": {"source_hash": "s"}}])):
        meta, blocks = jl.read_blocks(spark, lines(tmp_path / name, rows))
        assert [(r.uuid, r.parent_headings) for r in blocks.collect()] == [("A", ["x"])]
        assert [r.source_hash for r in meta.collect()] == ([] if name == "l.json" else ["s"])
    with pytest.warns(UserWarning, match="no base rules"):
        assert jl.read_base_rules(spark, str(tmp_path / "none.json")).count() == 0
    r = jl.read_rules(spark, lines(tmp_path / "r.json", [{"type": "global", "rules": [{"id": "R1"}, {"id": "R2", "type": "block_level"}]}]))
    assert {x.id: x.type for x in r.collect()} == {"R1": "global", "R2": "block"}
    assert [x.type for x in jl.read_rules(spark, lines(tmp_path / "q.json", [[{"id": "R1"}]])).collect()] == ["block"]
    nested = {"uuid": "A", "uuid_end": "B", "violations": [{"violation_text": "x", "uuid": "C"}, {"violation_text": "y", "uuid_end": "D"}]}
    got = jl.read_edit_items(spark, lines(tmp_path / "e.jsonl", [{"type": "meta"}, nested, {"uuid": "E", "uuid_end": "F", "violation_text": "z"}]))
    assert sorted((x.violation_text, x.uuid, x.uuid_end) for x in got.collect()) == [("x", "C", "B"), ("y", "A", "D"), ("z", "E", "F")]
    with pytest.raises(Exception, match="uuid_end"):
        jl.read_edit_items(spark, lines(tmp_path / "f.jsonl", [{"uuid": "E", "violation_text": "z"}])).collect()


def test_rule_unions(spark):
    s = "id string, description string, severity string, category string"
    a, b = spark.createDataFrame([("R1", "a", None, None), (None, "x", None, None)], s), spark.createDataFrame([("R1", "b", "high", "c"), ("R2", "d", None, None)], s)
    assert {r.id: r.description for r in rl.union_last([a, b]).collect()} == {"R1": "b", "R2": "d"}
    with pytest.raises(ValueError, match="R1"):
        rl.union_strict([a, b])
    assert rl.union_strict([a, b.filter("id = 'R2'")]).count() == 2
    assert {(r.id, r.severity, r.category) for r in rl.report_rules(b).collect()} == {("R1", "high", "c"), ("R2", "medium", "other")}


BLOCKS = "doc_id string, block_idx int, uuid string, uuid_end string, heading string, content string, parent_headings array<string>"


def test_model_auditor_retries_and_errors(spark):
    b = spark.createDataFrame([("d", 0, "A", "B", "h", "ok", []), ("d", 1, "C", "D", "h", "bad", []), ("d", 2, None, None, None, "none", None)], BLOCKS)

    def auditor(row):
        if row["content"] == "bad":
            raise au.NonRetryable("no")
        return [{"rule_id": "R1", "violation_text": "x"}] if row["content"] == "ok" else []

    got = {r.block_idx: r for r in au.audit_by_model(b, auditor, workers=2, delay=0, first_wait=0).collect()}
    assert got[0].is_violation and got[0].violations[0].uuid == "A" and got[1].is_violation is None and "NonRetryable" in got[1].error and got[2].is_violation is False
    tries, waits = [], []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [{}]

    assert au.with_retries(flaky, {}, sleep=waits.append) == [{}] and len(waits) == 2 and 0.9 <= waits[0] <= 1.1 and 1.8 <= waits[1] <= 2.2


def test_stream_is_idempotent(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    b = spark.createDataFrame([("d", 0, "A", "B", "h", "the the end", []), ("d", 1, "C", "D", "h", "fine", [])], BLOCKS)
    audit = lambda x: au.audit_by_rules(x)
    b.write.parquet(src)
    audit_stream(spark, src, b.schema, out, cp, audit)
    assert spark.read.parquet(out).count() == 2
    b.unionByName(spark.createDataFrame([("d", 2, "E", "F", "h", "new", [])], BLOCKS)).write.mode("append").parquet(src)
    audit_stream(spark, src, b.schema, out, cp, audit)
    assert spark.read.parquet(out).count() == 3
    audit_stream(spark, src, b.schema, out, str(tmp_path / "cp2"), audit)  # everything again
    assert spark.read.parquet(out).count() == 3
    assert mf.is_complete(b, spark.read.parquet(out))


def test_failed_blocks_come_again(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    b = spark.createDataFrame([("d", k, f"A{k}", "B", "h", "c", []) for k in range(4)], BLOCKS)
    b.write.parquet(src)
    audit = lambda bad: lambda x: au.audit_by_rules(x).withColumn("error", F.when(F.col("block_idx").isin(bad), "down"))
    done = lambda: sorted(r.block_idx for r in spark.read.parquet(out).collect())
    audit_stream(spark, src, b.schema, out, cp, audit([1, 3]))
    assert done() == [0, 2]
    audit_stream(spark, src, b.schema, out, cp, audit([3]))
    assert done() == [0, 1, 2]
    assert retry_failed(spark, out, out + "_failed", audit([3])) == 1 and retry_failed(spark, out, out + "_failed", audit([-1])) == 0
    audit_stream(spark, src, b.schema, out, cp, audit([-1]))
    assert done() == [0, 1, 2, 3]


def test_lines_with_meta(spark, tmp_path):
    at = str(tmp_path / "m")
    e = spark.createDataFrame([("d", 0, "A", "B", "h", "c", [])], BLOCKS)
    made = au.audit_by_rules(e.unionByName(e.withColumn("block_idx", F.lit(1)))).withColumn("error", F.when(F.col("block_idx") == 1, "down"))
    jl.write_lines(jl.entry_lines(made), at, {"source_hash": "h"})
    jl.write_lines(jl.entry_lines(made.limit(0)), at, append=True)
    rows = spark.read.json(at)
    assert rows.filter("type = 'meta'").count() == 1 and rows.filter("_error is not null and violations is null").count() == 1 and rows.count() == 3


def test_location(spark):
    P = "doc_id string, pos long, text string, para_id string, para_id_end string, is_table boolean, level int"
    paras = spark.createDataFrame([("d", 0, "1st", "A", None, False, None), ("d", 1, "find me  \nhere", "B", None, False, None), ("d", 200, "x<sup>2</sup>", "C", None, False, None), ("d", 201, "tail find me", "D", None, False, None)], P)
    items = [("i1", "a ", "D", "find me"), ("i2", "A", "D", "find me\nhere"), ("i3", "A", "gone", "x2"), ("i4", "B", "B", "tail"), ("i5", "Z", "D", "x"), ("i6", "A", "D", "3. tail"), ("i7", "C", "D", "</sup>\ntail"), ("i8", "A", "D", None)]
    got = {r.item_id: r for r in mt.locate(spark.createDataFrame([(*x[:1], "d", *x[1:]) for x in items], "item_id string, doc_id string, uuid string, uuid_end string, violation_text string"), paras).collect()}
    assert (got["i1"].rank, got["i1"].pos, got["i1"].offset) == (1, 1, 0) and got["i2"].rank == 2 and (got["i3"].rank, got["i3"].pos) == (7, 200)
    assert got["i4"].status == "not_found" and got["i5"].status == "no_anchor" and got["i6"].rank == 3 and got["i7"].rank == 5 and got["i8"].status == "not_found"
    runs = spark.createDataFrame([("d", 0, 0, 0, 5, None), ("d", 0, 1, 5, 9, "ins"), ("d", 0, 2, 9, 12, None)], "doc_id string, para int, run_no int, start_off int, end_off int, revision string")
    m = spark.createDataFrame([("d", 0, 3, 9), ("d", 0, 9, 10)], "doc_id string, para int, m_start int, m_end int")
    assert {(r.m_start, r.run_no, r.from_off, r.to_off) for r in mt.overlapping(runs, m).collect()} == {(3, 0, 3, 5), (3, 1, 5, 9), (9, 2, 9, 10)}
    assert [r.m_start for r in mt.revised_overlap(runs, m).collect()] == [3]


def test_quotes_in_tables(spark):
    P = "doc_id string, pos long, text string, para_id string, para_id_end string, is_table boolean, level int"
    rows = [["1", 'say "hi"\tnow', "plain"], ["2", "back\\slash here", "tail cell"], ["3", "first line\nsecond line", None]]
    text = f"<table>{json.dumps(rows, ensure_ascii=False)}</table>"
    paras = spark.createDataFrame([("d", 0, "before the table", "A", None, False, None), ("d", 1, text, "B", "C", True, None), ("d", 2, "after the table comes text", "D", None, False, None)], P)
    quotes = {
        "row": '["7", "back\\\\slash here", "tail cell"]', "rows": '["1", "back\\\\slash here", "tail cell"], ["9", "first line\\nsecond line", null]', "cell": 'say "hi"\tnow', "lines": "first line\nsecond line",
        "crossed": 'gone", "tail cell', "border": "absent words\nafter the table comes", "tag": "after the table <table>x</table>", "none": 'not "here"', "plain": "tail cell",
    }
    items = spark.createDataFrame([(k, "d", "A", "D", q, "replace" if k == "tag" else "manual") for k, q in quotes.items()], "item_id string, doc_id string, uuid string, uuid_end string, violation_text string, fix_action string")
    got = {r.item_id: (r.status, r.rank, r.pos) for r in mt.locate(items, paras).collect()}
    assert got == {
        "row": ("found", 6, 1), "rows": ("found", 6, 1), "cell": ("found", 8, 1), "lines": ("found", 8, 1), "crossed": ("found", 9, 1), "border": ("found", 9, 2), "tag": ("fallback", 0, 2), "none": ("not_found", None, None), "plain": ("found", 1, 1),
    }
    body = json.dumps(rows, ensure_ascii=False)[1:-1]
    for c in mt.table_cells(paras).collect():
        shown = "null" if c.cell is None else json.dumps(c.cell, ensure_ascii=False)[1:-1]
        assert body[c.at : c.at + len(shown)] == shown and rows[c.row][c.col] == c.cell


def test_no_pair_is_missed_by_words(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "§", "1.", "2)", "x<sup>2</sup>", "gamma-ray", "电池。", "•", "delta", "\n", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    P = "doc_id string, pos long, text string, para_id string, para_id_end string, is_table boolean, level int"
    paras = spark.createDataFrame([("d", i, t, f"P{i}", None, False, None) for i, t in enumerate(texts)], P)
    quotes = [t[a:b] for t in texts for a in [rng.randrange(len(t))] for b in [rng.randrange(a, len(t)) + 1]] + ["1. beta", "2) alpha  ", "x2"]
    items = spark.createDataFrame([(i, "d", "P0", "gone", q) for i, q in enumerate(quotes)], "item_id int, doc_id string, uuid string, uuid_end string, violation_text string")
    forms = mt.ranges(items, paras).join(items.select("item_id", *mt.quote_forms(F.col("violation_text"))), "item_id")
    t = paras.select("doc_id", "pos", *mt.text_forms(F.col("text")))
    hits = lambda pairs: {(r.item_id, r.pos, r.rank) for r in pairs.join(t, ["doc_id", "pos"]).join(forms.select("item_id", "q1", "q2", "q3", "q4", "q7"), "item_id").withColumn("hit", mt.ladder()).filter("hit is not null").select("item_id", "pos", "hit.rank").collect()}
    every = mt.paragraphs_in_range(forms.select("item_id", "doc_id", "start_pos", "end_pos"), t.select("doc_id", "pos")).select("item_id", "doc_id", "pos")
    assert hits(mt.candidates(forms, t)) == hits(every)


def test_location_moves_each_text_once(spark, monkeypatch):
    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        seen = sc.statusStore().executorList(False)
        return sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))

    rng = random.Random(5)
    words = [f"common{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + f" end{i}" for i in range(600)]
    P = "doc_id string, pos long, text string, para_id string, para_id_end string, is_table boolean, level int"
    paras = spark.createDataFrame([("d", i, t, f"P{i}", None, False, None) for i, t in enumerate(texts)] + [("d", 5, texts[5], "P5", None, False, None)], P)
    at = {i: (rng.randrange(600), rng.choice([0, 3, 40, None])) for i in range(600)}
    quotes = {i: rng.choice([texts[rng.randrange(600)][100:160], texts[s][40:90], words[3] + " none " + words[4], "d50", "zz"]) for i, (s, _) in at.items()}
    items = spark.createDataFrame([(i, "d", f"P{s}", "gone" if n is None else f"P{min(s + n, 599)}", quotes[i]) for i, (s, n) in at.items()], "item_id int, doc_id string, uuid string, uuid_end string, violation_text string")
    want = {i: next((k for k in range(s, 600 if n is None else min(s + n, 599) + 1) if quotes[i] in texts[k]), None) for i, (s, n) in at.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    for near, bucket, most in ((128, 32, 10**9), (8, 4, 30_000)):  # all that is beyond in one part, and in several
        for k, v in {"NEAR": near, "NEAR_BUCKET": bucket, "BROADCAST": most}.items():
            monkeypatch.setattr(mt, k, v, raising=False)
        before = moved()
        assert {r.item_id: r.pos for r in mt.locate(items, paras).collect()} == want
        assert moved() - before < 4 * sum(map(len, texts))  # pairs of quotes and texts that share a word are far more
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_search_alone(spark, sf, monkeypatch):
    import __spark_entry__ as e
    from vellora.session import table

    want = {(r.item_id, r.pos, r.offset) for r in mt.locate(table(spark, sf, "edit_items"), st.current_paragraphs(table(spark, sf, "paragraphs"))).filter("rank = 1").collect()}
    asked = []
    form = mt.RUNGS[7]
    monkeypatch.setattr(mt, "_in_several", lambda *a: asked.append(a) or a[0], raising=False)
    monkeypatch.setitem(mt.RUNGS, 7, ("no such column", form[1]))  # fails if the seventh rung is looked at
    got = {tuple(r) for r in e.queries()["match_exact"](spark, sf).collect()}
    assert got == want and len(got) > 100 and not asked


def test_way_back_from_trimmed_lines(spark):
    t = "ab  \ncd\t \n\nef"
    plain = "ab\ncd\n\nef"
    at = [r.o for r in spark.range(len(plain) + 1).select(mt.original_offset(F.lit(t), F.col("id").cast("int")).alias("o")).collect()]
    assert at == [0, 1, 2, 5, 6, 7, 10, 11, 12, 13]


def test_sheet_and_page():
    f = io.BytesIO()
    assert jl.write_xlsx(f, ["a", "b"], [("<x>", None)]) == 1
    assert b"&lt;x&gt;" in zipfile.ZipFile(f).read("xl/worksheets/sheet1.xml")
    f = io.BytesIO()  # rows beyond a sheet go on in the next
    assert jl.write_xlsx(f, ["a"], ((k,) for k in range(7)), most=4) == 3
    z = zipfile.ZipFile(f)
    assert [z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row") for k in (1, 2, 3)] == [4, 4, 2] and z.read("xl/workbook.xml").count(b"<sheet ") == 3
    assert jl.write_xlsx(io.BytesIO(), ["a"], []) == 1
    assert "&lt;b&gt;" in jl.html_report("t", {"c": 1}, [{"heading": "<b>"}]) and "<b>" in jl.html_report("t", {}, [{"heading": "<b>"}], True)
    assert jl.extraction_path("a/b_manifest.jsonl") == "a/b_manifest_extractions.jsonl"


def test_stages(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(make(p("Head", "A1", '<w:pStyle w:val="H1"/>') + p("the the number 123456", "A2"), styles=STYLES))
    at = lambda x: str(tmp_path / x)
    assert cli.main(["parse", at("in"), at("blocks")]) == 0 and cli.main(["audit", at("blocks"), at("manifest")]) == 0
    assert cli.main(["report", at("manifest"), at("report"), "--xlsx", at("r.xlsx")]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["total_blocks"] == 1 and out["by_category"] == {"grammar": 1, "number": 1} and zipfile.is_zipfile(at("r.xlsx"))
    assert cli.main(["query", "none", "x"]) == 2
    assert cli.main(["audit", at("blocks"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["blocks"] == 1
    assert spark.read.text(at("report_summary")).count() == 1
    base, more = lines(tmp_path / "a.json", [[{"id": "R1", "description": "a"}, {"id": "R2", "description": "/[0-9]{3}/", "category": "number"}]]), lines(tmp_path / "b.json", [[{"id": "R1", "description": "b"}]])
    assert cli.main(["rules", base, at("rules.json"), "--merge", more]) == 0
    assert [r["description"] for r in json.loads((tmp_path / "rules.json").read_text())["rules"]] == ["b", "/[0-9]{3}/"]
    assert cli.main(["audit", at("blocks"), at("m2"), "--rules", at("rules.json")]) == 0
    assert [v.violation_text for r in spark.read.parquet(at("m2")).collect() for v in r.violations] == ["123", "456"]
    item = {"uuid": "A2", "uuid_end": "A2", "violation_text": "the the", "violation_reason": "twice", "fix_action": "replace", "revised_text": "the", "category": "grammar"}
    items = lines(tmp_path / "items.jsonl", [{"type": "meta", "source_hash": "sha256:x"}, item, {**item, "uuid": "ZZ"}])
    assert cli.main(["apply", at("in"), at("edited"), "--items", items]) == 1  # another document
    assert cli.main(["apply", at("in"), at("edited"), "--items", items, "--skip-hash", "--dry-run"]) == 1 and not (tmp_path / "edited").exists()
    assert cli.main(["apply", at("in"), at("edited"), "--items", items, "--skip-hash"]) == 1
    assert zipfile.is_zipfile(tmp_path / "edited/a.docx") and [r.status for r in spark.read.json(at("edited_failed")).collect()] == ["no_anchor"]
