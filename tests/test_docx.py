import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellora.functions import text as tx
from vellora.operators.chunking import build_blocks
from vellora.sources import docx as dx
from vellora.sources.omml import omml_to_latex

NS = 'xmlns:w="%s" xmlns:w14="%s" xmlns:m="%s" xmlns:r="%s" xmlns:wp="%s" xmlns:a="%s"' % tuple(x[1:-1] for x in (dx.W, dx.W14, dx.M, dx.R, dx.WP, dx.A))


def p(text, pid, ppr="", raw=""):
    body = f"<w:r><w:t>{text}</w:t></w:r>" if text else ""
    return f'<w:p w14:paraId="{pid}"><w:pPr>{ppr}</w:pPr>{body}{raw}</w:p>'


def make(body, numbering="", styles="", rels="", parts=()):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{dx.TYPES[1:-1]}"><Default Extension="png" ContentType="image/png"/><Override PartName="/word/media/b.bin" ContentType="image/x-emf"/></Types>')
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr/></w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{numbering}</w:numbering>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{dx.PKG[1:-1]}">{rels}</Relationships>')
        for n, b in parts:
            z.writestr(n, b)
    return f.getvalue()


STYLES = '<w:style w:styleId="H1"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="X"><w:basedOn w:val="H1"/></w:style><w:style w:styleId="C1"><w:basedOn w:val="C2"/></w:style><w:style w:styleId="C2"><w:basedOn w:val="C1"/></w:style>'
NUM = """<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="chineseCountingThousand"/><w:lvlText w:val="%1、"/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/><w:isLgl/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>
<w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>"""
numpr = lambda n, k: f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="{n}"/></w:numPr>'


def rows(data, **k):
    return list(dx.paragraphs(data, "d.docx", **k))


def test_paragraphs_styles_numbering():
    body = p("Head", "A1", '<w:pStyle w:val="X"/>') + p("", "A2") + p("one", "A3", numpr(1, 0)) + p("sub", "A4", numpr(1, 1)) + p("sub", "A5", numpr(1, 1)) + p("two", "A6", numpr(1, 0)) + p("on", "A7", numpr(2, 0)) + p("sub", "A8", numpr(2, 1))
    got = rows(make(body, NUM, STYLES))
    assert [r[2] for r in got] == ["Head", "一、 one", "1.1 sub", "1.2 sub", "二、 two", "三、 on", "3.1 sub"]
    assert got[0][6] == 1 and got[1][6] is None and [r[1] for r in got] == list(range(7))
    assert [r[2] for r in rows(make(p("x", "A1", numpr(2, 0)), NUM))] == ["五、 x"]
    with pytest.raises(dx.MissingId):
        rows(make("<w:p><w:r><w:t>x</w:t></w:r></w:p>"))
    assert rows(make("<w:p><w:r><w:t>x</w:t></w:r></w:p>"), strict=False)[0][3] is None


def test_runs_revisions_equations():
    raw = '<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:tab/><w:t>t</w:t><w:br/><w:br w:type="page"/></w:r><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>'
    assert rows(make(p("m", "A1", raw=raw)))[0][2] == "m<sup>2</sup>new\tt\n<equation>{x}^{2}</equation>"


def test_table_merges():
    cell = lambda t, pid, pr="": f'<w:tc><w:tcPr>{pr}</w:tcPr>{p(t, pid)}</w:tc>'
    tbl = "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>" + "".join(
        f"<w:tr><w:trPr>{'<w:tblHeader/>' if i == 0 else ''}</w:trPr>{cell('M' if i == 0 else '', f'V{i}', f'<w:vMerge {v}/>')}{x}</w:tr>"
        for i, (v, x) in enumerate([('w:val="restart"', cell("wide", "W0", '<w:gridSpan w:val="2"/>')), ("", cell("b", "B1") + cell("c", "C1")), ("", cell("d", "D2") + cell("", "E2"))])
    ) + "</w:tbl>"
    (r,) = rows(make(tbl))
    assert r[2] == '<table>[["M", "wide", ""], ["M", "b", "c"], ["M", "d", ""]]</table>' and r[3] == "V0" and r[4] == "E2" and r[5] and r[7] == [["M", "wide", ""]]


def test_drawings_and_images():
    d = lambda i, rel: f'<w:r><w:drawing><wp:docPr id="{i}" name="P &quot;{i}&quot;"/><a:blip {rel}/></w:drawing></w:r>'
    rels = f'<Relationship Id="r1" Type="{dx.IMAGE}" Target="media/a.png"/><Relationship Id="r2" Type="{dx.IMAGE}" Target="media/b.bin"/><Relationship Id="r3" Type="{dx.IMAGE}" Target="https://h/x.jpg?y" TargetMode="External"/>'
    data = make(p("", "A1", raw=d(1, 'r:embed="r1"') + d(2, 'r:embed="r2"') + d(3, 'r:embed="r1" r:link="r3"') + d(4, "")), rels=rels, parts=[("word/media/a.png", b"1"), ("word/media/b.bin", b"2")])
    t = rows(data, folder="x.image")[0][2]
    assert 'path="x.image/a.png" format="png"' in t and 'format="emf"' in t and 'path="https://h/x.jpg?y" format="jpeg"' in t and 'id="4" name="P &quot;4&quot;" />' in t
    assert [(n, f) for n, f, _ in dx.images(data)] == [("a.png", "png"), ("b.bin", "emf")]


def test_source_and_pipeline(spark, tmp_path):
    spark.dataSource.register(dx.DocxSource)
    (tmp_path / "a.docx").write_bytes(make(p("Head", "A1", '<w:pStyle w:val="H1"/>') + p("text", "A2"), NUM, STYLES))
    (tmp_path / "b.docx").write_bytes(make(p("only", "B1")))
    (tmp_path / "bad.bin").write_bytes(b"no zip")
    df = spark.read.format("docx").load(str(tmp_path))
    assert df.count() == 3
    blocks = {r.doc_id: r for r in build_blocks(df.drop("table_header", "source_hash")).collect()}
    assert blocks["a.docx"].content == "Head\ntext" and blocks["a.docx"].heading == "Head" and blocks["a.docx"].uuid_end == "A2"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = dx.read_binary(files)
    assert got.filter("pos is null").count() == 1 and got.filter("pos is not null").count() == 3
    assert dx.sources(files).join(df.select("source_hash").distinct(), "source_hash").count() == 2


CASES = {
    "<m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f>": "\\frac{a}{b}",
    "<m:rad><m:deg><m:r><m:t>3</m:t></m:r></m:deg><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>": "\\sqrt[3]{x}",
    '<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:nary>': "\\sum_{i}{x}",
    "<m:d><m:e><m:r><m:t>x</m:t></m:r></m:e></m:d>": "\\left( x \\right)",
    '<m:acc><m:accPr><m:chr m:val="̃"/></m:accPr><m:e><m:r><m:t>x</m:t></m:r></m:e></m:acc>': "\\tilde{x}",
    "<m:func><m:fName><m:r><m:t>cos</m:t></m:r></m:fName><m:e><m:r><m:t>x</m:t></m:r></m:e></m:func>": "\\cos_{}^{}{x}",
    "<m:d><m:e><m:m><m:mr><m:e><m:r><m:t>a</m:t></m:r></m:e><m:e><m:r><m:t>b</m:t></m:r></m:e></m:mr></m:m></m:e></m:d>": "\\begin{pmatrix} a & b \\end{pmatrix}",
    "<m:r><m:t>a ≤ b</m:t></m:r>": "a \\leq  b", "<m:zzz/>": "",
}


def test_equations(spark):
    df = spark.createDataFrame([(i, f"<m:oMath {NS}>{x}</m:oMath>") for i, x in enumerate(CASES)] + [(98, "<broken"), (99, None)], "i int, x string")
    got = [r.y for r in df.select("i", omml_to_latex("x").alias("y")).orderBy("i").collect()]
    assert got == [*CASES.values(), "", None]


def test_columns_and_scan_agree_on_numbers(spark):
    fmts = ["decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "chineseCountingThousand", "ideographTraditional", "bullet", "none", "other"]
    df = spark.createDataFrame([(n, f) for n in (1, 4, 9, 10, 11, 19, 20, 26, 27, 40, 99, 100, 1994, 3999, 4000) for f in fmts], "n long, f string")
    assert all(r.s == dx.number(r.n, r.f) for r in df.select("n", "f", tx.format_number(F.col("n"), F.col("f")).alias("s")).collect())
