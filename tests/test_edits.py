import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_docx import make, p
from vellora.operators import edits as ed
from vellora.sources import docx as dx


@settings(max_examples=200, deadline=None)
@given(st.text("ab <", max_size=30), st.text("ab <", max_size=30))
def test_diff_gives_both_texts(a, b):
    d = ed.diff(a, b)
    assert "".join(t for o, t in d if o != "insert") == a and "".join(t for o, t in d if o != "delete") == b
    assert ed.revised_segment(a, b, 0, len(a)) == b


def test_markup():
    assert ed.segments("x<sup>2</sup>y") == [("x", None), ("2", "sup"), ("y", None)]
    assert ed.markup_diff("x<sup>2</sup>", "x<sup>3</sup>") == [("equal", "x", None), ("delete", "2", "sup"), ("insert", "3", "sup")]
    assert ed.markup_diff("x2", "x<sub>2</sub>") == [("equal", "x", None), ("delete", "2", None), ("insert", "2", "sub")]
    assert ed.touches_special("a <equation>x</equation>", "a") and not ed.touches_special("a <equation>x</equation> b", "c <equation>x</equation> b")
    assert ed.cell_edits('["a", "b"]', '["a", "c"]') == [(0, 1, "b", "c")] and ed.cell_edits('["a", "b"]', '["a"]') is None


def item(n, quote, action="replace", revised="", uuid="A1", end="A9", **k):
    return {"item_id": n, "uuid": uuid, "uuid_end": end, "violation_text": quote, "violation_reason": f"why{n}", "fix_action": action, "revised_text": revised, "category": "grammar"} | k


def views(data):
    """(text accepted, text before)"""
    root = dx.parse_xml(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    new = "|".join("".join(t.text or "" for t in q.iter(dx.W + "t")) for q in root.iter(dx.W + "p"))
    doc = ed.Document(data, "a", "a", "d")
    return new, "|".join("".join(x.text for x in doc.pieces(q)) for q in doc.paras)


BODY = p("The pump was was checked.", "A1") + p("Second line here.", "A2") + p("Second line here.", "A3") + p("End", "A9")


def test_changes_keep_the_original():
    out, res = ed.apply_items(make(BODY), [
        item(1, "was was", revised="was"), item(2, "Second line", "delete"), item(3, "Second line", revised="Third line"), item(4, "Second line", revised="Fourth"),
        item(5, "checked", "manual", "tested"), item(6, "absent text", revised="x"), item(7, "End", uuid="ZZ", revised="x"), item(8, "here.\nSecond line here.", revised="gone.\nSecond line here."),
    ])
    assert [r.status for r in res] == ["success", "success", "success", "conflict", "commented", "not_found", "no_anchor", "success"]
    new, old = views(out)
    assert old == "The pump was was checked.|Second line here.|Second line here.|End"
    assert new == "The pump was checked.| gone.|Third line here.|End"
    z = zipfile.ZipFile(io.BytesIO(out))
    notes = z.read("word/comments.xml").decode()
    assert "Suggestion: tested" in notes and "[FALLBACK]" in notes and "AI-grammar" in notes
    assert "comments.xml" in z.read("[Content_Types].xml").decode() and "comments.xml" in z.read("word/_rels/document.xml.rels").decode()
    ids = [e.get(dx.W + "id") for e in dx.parse_xml(z.read("word/document.xml")).iter() if e.tag in (dx.W + "ins", dx.W + "del")]
    assert len(ids) == len(set(ids))
    again, res = ed.apply_items(out, [item(9, "End", revised="Fin")])
    assert res[0].status == "success" and again.count(b"x") >= 0 and len(zipfile.ZipFile(io.BytesIO(again)).read("word/comments.xml")) > len(notes)


def test_tables_numbering_special():
    cell = lambda t, i: f"<w:tc>{p(t, i)}</w:tc>"
    body = f'<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>{cell("pump", "A1")}{cell("old value", "A2")}</w:tr></w:tbl>' + p("numbered text", "A3") + p("", "A9", raw='<w:r><w:drawing/><w:t>pic</w:t></w:r>')
    out, res = ed.apply_items(make(body), [item(1, '["pump", "old value"]', revised='["pump", "new value"]', end="A2"), item(2, "1. numbered text", revised="1. other text", uuid="A3"), item(3, "pic", revised="x", uuid="A3"), item(4, "<equation>a</equation>", revised="b", uuid="A3")])
    assert [r.status for r in res] == ["success", "success", "special", "equation"]
    assert views(out)[0].startswith("pump|new value|other text")


def test_edits_over_paragraphs():
    body = p("First one ends", "A1") + p("middle", "A2") + p("begins the last.", "A3") + p("End", "A9")
    out, res = ed.apply_items(make(body), [item(1, "ends\nmiddle\nbegins", "delete")])
    root = dx.parse_xml(zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml"))
    marks = [q.get(dx.W14 + "paraId") for q in root.iter(dx.W + "p") if q.find(f"{dx.W}pPr/{dx.W}rPr/{dx.W}del") is not None]
    assert res[0].status == "success" and views(out) == ("First one || the last.|End", "First one ends|middle|begins the last.|End") and marks == ["A1", "A2"]
    assert len(list(root.iter(dx.W + "commentRangeStart"))) == len(list(root.iter(dx.W + "commentRangeEnd"))) == 1
    out, res = ed.apply_items(make(body), [item(1, "ends\nmiddle", revised="closes\nmiddle\nmore"), item(2, "middle\nbegins", "manual", "x"), item(3, "ends\nmiddle", "delete")])
    assert [r.status for r in res] == ["success", "commented", "conflict"] and views(out)[0].startswith("First one closes|middle")


def test_rows_of_tables():
    cell = lambda t, i, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t, i)}</w:tc>"
    tr = lambda *c: f"<w:tr>{''.join(c)}</w:tr>"
    tbl = "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>" + tr(cell("1", "B1"), cell("180", "B2"), cell("a", "B3")) + tr(cell("2", "C1"), cell("180", "C2"), cell("b", "C3")) + tr(cell("M", "D1", "<w:vMerge w:val='restart'/>"), cell("wide", "D2", "<w:gridSpan w:val='2'/>")) + tr(cell("", "E1", "<w:vMerge/>"), cell("x", "E2"), cell("y", "E3")) + "</w:tbl>"
    run = lambda *items: ed.apply_items(make(p("180", "A1") + tbl + p("End", "A9")), list(items))
    out, res = run(item(1, '["7", "180", "b"]', revised='["7", "200", "b"]'))  # the row's own cell, not the first 180; its number aside
    assert res[0].status == "success" and views(out)[0] == "180|1|180|a|2|200|b|M|wide||x|y|End"
    out, res = run(item(1, '["1", "180", "a"], ["2", "180", "b"]', "delete"), item(2, '["M", "wide", ""]', revised='["M", "wider", ""]'), item(3, '["M", "x", "y"]', "manual", "z"))
    assert [r.status for r in res] == ["success", "success", "commented"] and views(out)[0] == "180|||||||M|wider||x|y|End"
    out, res = run(item(1, '["1", "180", "zz"]', revised='["1", "1", "zz"]'), item(2, '["1", "180", "a"], ["9", "9", "9"]', "delete"), item(3, '["1", "180", "a"]', revised='["1", "180"]'))
    assert [r.status for r in res] == ["cross_cell", "cross_row", "cross_cell"] and views(out)[0] == views(out)[1]


def test_drawings_stay_in_what_is_kept():
    raw = '<w:r><w:t xml:space="preserve">see </w:t></w:r><w:r><w:drawing/><w:t>pic</w:t></w:r><w:r><w:t xml:space="preserve"> and more</w:t></w:r>'
    out, res = ed.apply_items(make(p("", "A1", raw=raw)), [item(1, "see pic and more", revised="look at pic and more", end="A1")])
    body = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert res[0].status == "success" and body.count("<w:drawing") == 1 and views(out)[0] == "look at pic and more"
    out, res = ed.apply_items(make(p("", "A1", raw=raw)), [item(1, "see pic and", revised="see and", end="A1")])
    assert res[0].status == "special" and views(out)[0] == views(out)[1]


def test_operator(spark):
    docs = spark.createDataFrame([("d", make(BODY), "sha256:x"), ("e", make(p("x", "A1")), None)], "doc_id string, content binary, source_hash string")
    rows = [{**item(1, "was was", revised="was"), "doc_id": "d"}, {**item(2, None, "delete", None), "doc_id": "d"}, {**item(1, "was was", revised="was"), "doc_id": "d"}, {**item(3, "x", revised="y"), "doc_id": "gone"}]
    items = spark.createDataFrame(rows, "item_id int, uuid string, uuid_end string, violation_text string, violation_reason string, fix_action string, revised_text string, category string, doc_id string")
    edited, results = ed.apply_edits(docs, items)
    assert {r.doc_id: r.status for r in results.filter("item_id = 1").collect()} == {"d": "success"}
    assert views(bytes(edited.filter("doc_id = 'd'").first().content))[0].startswith("The pump was checked.")
    assert tuple(ed.summary(results).first()) == (1, 1, 0)
    assert [r.doc_id for r in ed.verify_hashes(docs, docs).collect()] == ["d"]
