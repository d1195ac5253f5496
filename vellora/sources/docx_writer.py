"""Paragraphs as Word packages: the way back from what the scan gives, for exports and round trips."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellora.sources import docx as dx

_NS = " ".join(f'xmlns:{p}="{u[1:-1]}"' for p, u in (("w", dx.W), ("w14", dx.W14), ("m", dx.M), ("r", dx.R), ("wp", dx.WP), ("a", dx.A)))
_DIGITS = re.compile(r"([0-9]+)")
#: Paragraphs of one package: what is longer goes on in a further one.
SECTION = 512


def _text(s: str, tag: str = "t") -> str:
    """Text as children of a run: tabs and line feeds are elements of their own."""
    parts = {"\t": "<w:tab/>", "\n": "<w:br/>"}
    return "".join(parts.get(x) or f'<w:{tag} xml:space="preserve">{escape(x)}</w:{tag}>' for x in re.split(r"([\t\n])", s) if x)


def _run(s: str, props: str = "") -> str:
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{_text(s)}</w:r>" if s else ""


def _rich(s: str, pos: int, heading: bool) -> str:
    """Runs with raised digits, a tracked deletion in front, the last word as a tracked insertion; headings end in an equation and a drawing."""
    head, _, last = s.rpartition(" ")
    raised = lambda t: "".join(_run(x, '<w:vertAlign w:val="superscript"/>' if i % 2 else "") for i, x in enumerate(_DIGITS.split(t)))
    change = 'w:id="1" w:author="x" w:date="2000-01-01T00:00:00Z"'
    out = f"<w:del {change}><w:r>{_text('gone ', 'delText')}</w:r></w:del>" + raised(head + " " if head else "") + f"<w:ins {change}>{raised(last)}</w:ins>"
    if heading:
        math = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
        out += f"<m:oMath><m:sSup><m:e>{math('x')}</m:e><m:sup>{math(pos)}</m:sup></m:sSup></m:oMath>"
        out += f'<w:r><w:drawing><wp:docPr id="{pos}" name="P {pos}"/><a:blip r:{"link" if pos % 2 else "embed"}="{"r2" if pos % 2 else "r1"}"/></w:drawing></w:r>'
    return out


def _paragraph(body: str, para_id: str | None, props: str = "") -> str:
    return f"<w:p{f' w14:paraId={quoteattr(para_id)}' if para_id else ''}>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"


def _table(rows: list[list[str]], first: str | None, last: str | None) -> str:
    """A table on its grid: equal neighbours in the first column are merged downwards, empty cells go to the span of the cell before them."""
    width = max((len(r) for r in rows), default=0)
    out, n = [], 0
    end = len(rows) - 1
    for i, r in enumerate(rows):
        r = [*r, *[""] * (width - len(r))]
        cells, k = [], 0
        while k < width:
            span = 1
            while k + span < width and r[k + span] == "" and r[k] != "":
                span += 1
            above, below = i > 0 and rows[i - 1][0] == r[0] != "", i < end and rows[i + 1][:1] == r[:1] != [""]
            merge = "" if k or not (above or below) else "<w:vMerge/>" if above else '<w:vMerge w:val="restart"/>'
            wide = f'<w:gridSpan w:val="{span}"/>' if span > 1 else ""
            pid = first if n == 0 else last if i == end and k + span == width else f"{first or 'T'}.{i}.{k}"
            n += 1
            lines = [""] if merge == "<w:vMerge/>" else r[k].split("\n")
            cells.append(f"<w:tc><w:tcPr>{wide}{merge}</w:tcPr>" + "".join(_paragraph(_run(x), pid if j in (0, len(lines) - 1) else None) for j, x in enumerate(lines)) + "</w:tc>")
            k += span
        out.append(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if i == 0 else ''}{''.join(cells)}</w:tr>")
    return f"<w:tbl><w:tblGrid>{'<w:gridCol/>' * width}</w:tblGrid>{''.join(out)}</w:tbl>"


def package(rows: list[dict], labels: bool = False, rich: bool = False) -> bytes:
    """One document of paragraphs (pos, text, para_id, para_id_end, is_table, level) in order.

    Headings have a style that takes its outline level from the style it is based on. ``labels`` numbers them over all
    levels; ``rich`` writes runs of many kinds, with two images beside.
    """
    body = []
    for r in rows:
        if r["is_table"]:
            cells = [["" if c is None else str(c) for c in row] for row in json.loads(r["text"].removeprefix("<table>").removesuffix("</table>"))]
            body.append(_table(cells, r["para_id"], r["para_id_end"]))
            continue
        level = None if r["level"] is None or r["level"] != r["level"] else int(r["level"])
        props = "" if level is None else f'<w:pStyle w:val="Own{level}"/>'
        body.append(_paragraph(_rich(r["text"], int(r["pos"]), level is not None) if rich else _run(r["text"]), r["para_id"], props))
    numbered = lambda k: f'<w:numPr><w:ilvl w:val="{k - 1}"/><w:numId w:val="1"/></w:numPr>' if labels else ""
    styles = "".join(f'<w:style w:styleId="H{k}"><w:pPr>{numbered(k)}<w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style><w:style w:styleId="Own{k}"><w:basedOn w:val="H{k}"/></w:style>' for k in range(1, 10))
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="{".".join(f"%{j + 1}" for j in range(k + 1))}"/></w:lvl>' for k in range(9))
    rels = f'<Relationship Id="r1" Type="{dx.IMAGE}" Target="media/a.png"/><Relationship Id="r2" Type="{dx.IMAGE}" Target="https://host.invalid/b.jpg?v=1" TargetMode="External"/><Relationship Id="r3" Type="{dx.IMAGE}" Target="media/c.bin"/>' if rich else ""
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)  # noqa: E731 - no time stamp: equal rows give equal bytes
        put("[Content_Types].xml", f'<Types xmlns="{dx.TYPES[1:-1]}"><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/media/c.bin" ContentType="image/x-emf"/></Types>')
        put("word/document.xml", f"<w:document {_NS}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
        put("word/styles.xml", f"<w:styles {_NS}>{styles}</w:styles>")
        put("word/numbering.xml", f'<w:numbering {_NS}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
        put("word/_rels/document.xml.rels", f'<Relationships xmlns="{dx.PKG[1:-1]}">{rels}</Relationships>')
        if rich:
            put("word/media/a.png", b"first")
            put("word/media/c.bin", b"second")
    return f.getvalue()


def packages(paragraphs: DataFrame, section: int = SECTION, labels: bool = False, rich: bool = False) -> DataFrame:
    """Documents (path, content) of paragraphs in order of pos, one for every ``section`` places of a document.

    Named <doc_id>-<section number>.docx; a group is bounded by its section, however long the document is.
    """

    def write(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        name = f"{p['doc_id'].iloc[0]}-{p['section'].iloc[0]}.docx"
        rows = p.astype(object).where(p.notna(), None).to_dict("records")
        return pd.DataFrame({"path": [name], "content": [package(rows, labels, rich)]})

    p = paragraphs.select("doc_id", "pos", "text", "para_id", "para_id_end", "is_table", "level", F.floor(F.col("pos") / section).alias("section"))
    return p.groupBy("doc_id", "section").applyInPandas(write, "path string, content binary")
