"""Word documents as ordered paragraphs: a Spark data source, one partition per file."""

from __future__ import annotations

import glob
import hashlib
import html
import io
import json
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import Element, fromstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellora.sources.omml import M, to_latex

# Namespaces and relationship types of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
IMAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
SCHEMA = "doc_id string, pos bigint, text string, para_id string, para_id_end string, is_table boolean, level int, table_header array<array<string>>, row_ids array<array<string>>, row_ends array<array<string>>, source_hash string"


class MissingId(ValueError):
    """A body paragraph without an id: the document must be saved by a current word processor first."""


def parse_xml(data: bytes) -> Element:
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document type declarations are refused")
    return fromstring(data)


def _val(el: Element | None, path: str) -> str | None:
    hit = el.find("/".join(W + p for p in path.split("/"))) if el is not None else None
    return None if hit is None else hit.get(W + "val")


def _int(s: str | None) -> int | None:
    return int(s) if s is not None and s.lstrip("-").isdigit() else None


def image_format(s: str | None) -> str | None:
    """Format name of a content type or extension."""
    v = (s or "").strip().lower()
    if v.startswith("image/"):
        v = v[6:].split("+")[0].removeprefix("x-")
    v = v.lstrip(".")
    return {"jpg": "jpeg", "": None}.get(v, v)


class Package:
    """The parts of one document that the scan needs."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.levels, self.style_num = self._styles()
        self.numbering = Numbering(self._part("word/numbering.xml"), self.style_num)
        self.relations = self._relations()

    def _part(self, name: str) -> Element | None:
        try:
            return parse_xml(self.zip.read(name)) if name in self.names else None
        except Exception:  # noqa: BLE001 - unreadable side parts count as absent
            return None

    @staticmethod
    def _inherit(own: dict[str, object], base: dict[str, str]) -> dict[str, object]:
        """What each style has itself or from its nearest ancestor; cycles end."""
        out = {}
        for s in {*own, *base}:
            seen, at = set(), s
            while at is not None and at not in seen and at not in own:
                seen.add(at)
                at = base.get(at)
            if at in own:
                out[s] = own[at]
        return out

    def _styles(self) -> tuple[dict, dict]:
        root = self._part("word/styles.xml")
        level, num, base = {}, {}, {}
        for s in root.findall(W + "style") if root is not None else []:
            sid = s.get(W + "styleId")
            if not sid:
                continue
            if (b := _val(s, "basedOn")) is not None:
                base[sid] = b
            lv = _int(_val(s, "pPr/outlineLvl"))
            if lv is not None and 0 <= lv <= 8:
                level[sid] = lv
            if (n := _val(s, "pPr/numPr/numId")) is not None:
                num[sid] = (n, _int(_val(s, "pPr/numPr/ilvl")) or 0)
        return self._inherit(level, base), self._inherit(num, base)

    def _relations(self) -> dict[str, dict]:
        """Relationships with the target part's type: an override beats its extension's default."""
        types = self._part("[Content_Types].xml")
        by_part = {x.get("PartName"): x.get("ContentType") for x in types.findall(TYPES + "Override")} if types is not None else {}
        by_ext = {(x.get("Extension") or "").lower(): x.get("ContentType") for x in types.findall(TYPES + "Default")} if types is not None else {}
        out = {}
        root = self._part("word/_rels/document.xml.rels")
        for r in root.findall(PKG + "Relationship") if root is not None else []:
            target, outer = r.get("Target") or "", r.get("TargetMode") == "External"
            part = None if outer else posixpath.normpath(posixpath.join("/word", target))
            ext = posixpath.splitext(re.sub(r"[?#].*$", "", target))[1]
            kind = None if outer else by_part.get(part) or by_ext.get(ext.lstrip(".").lower())
            out[r.get("Id")] = {"target": target, "type": r.get("Type"), "part": part, "format": image_format(kind or ext), "external": outer}
        return out


class Numbering:
    """Labels of numbered paragraphs in document order."""

    def __init__(self, root: Element | None, style_num: dict) -> None:
        self.levels: dict[str, dict[int, dict]] = {}
        self.abstract: dict[str, str] = {}
        self.override: dict[tuple[str, int], int] = {}
        self.style_num = style_num
        self.count: dict[str, dict[int, int]] = {}
        self.last: tuple[str, str] | None = None
        for a in root.findall(W + "abstractNum") if root is not None else []:
            self.levels[a.get(W + "abstractNumId")] = {
                _int(v.get(W + "ilvl")) or 0: {"start": s if (s := _int(_val(v, "start"))) is not None else 1, "fmt": _val(v, "numFmt") or "decimal", "text": _val(v, "lvlText") or "", "legal": (lg := v.find(W + "isLgl")) is not None and lg.get(W + "val") not in ("0", "false")}
                for v in a.findall(W + "lvl")
            }
        for n in root.findall(W + "num") if root is not None else []:
            num = n.get(W + "numId")
            self.abstract[num] = _val(n, "abstractNumId")
            for o in n.findall(W + "lvlOverride"):
                if (s := _int(_val(o, "startOverride"))) is not None:
                    self.override[num, _int(o.get(W + "ilvl")) or 0] = s

    def reset(self) -> None:
        """Forget the paragraph before: at tables, cells and section ends."""
        self.last = None

    def of(self, p: Element) -> str:
        """The label of the next paragraph; empty if it has none."""
        num, lv = _val(p, "pPr/numPr/numId"), _int(_val(p, "pPr/numPr/ilvl")) or 0
        if num is None:
            num, lv = self.style_num.get(_val(p, "pPr/pStyle"), (None, 0))
        return "" if num is None else self.label(num, lv)

    def label(self, num: str, lv: int) -> str:
        a = self.abstract.get(num)
        levels = self.levels.get(a, {})
        if lv not in levels:
            self.last = None
            return ""
        if self.last and self.last[0] != num and self.last[1] == a and self.last[0] in self.count:
            self.count[num] = dict(self.count[self.last[0]])  # one list under two numbers runs on
        c = {k: v for k, v in self.count.get(num, {}).items() if k <= lv}
        start = lambda k: self.override.get((num, k), levels[k]["start"])
        for k in range(lv):
            if k in levels:
                c.setdefault(k, start(k))
        c[lv] = c[lv] + 1 if lv in c else start(lv)
        self.count[num], self.last = c, (num, a)
        text, legal = levels[lv]["text"], levels[lv]["legal"]
        for k in range(lv + 1):
            if k in levels and k in c:
                text = text.replace(f"%{k + 1}", number(c[k], "decimal" if legal and k < lv else levels[k]["fmt"]))
        return text


def number(n: int, fmt: str) -> str:
    """A counter in a number format (P08): the Python twin of functions.text.format_number."""
    from vellora.functions import text as tx

    if fmt in ("lowerLetter", "upperLetter"):
        return chr((97 if fmt[0] == "l" else 65) + (n - 1) % 26)
    if fmt in ("lowerRoman", "upperRoman") and 0 < n < 4000:
        s = "".join(w[n // 10 ** (3 - i) % 10] for i, w in enumerate(tx._ROMAN))
        return s.lower() if fmt[0] == "l" else s
    if fmt == "chineseCountingThousand" and 0 < n < 100:
        t, o = divmod(n, 10)
        return ("" if t == 0 else "十" if t == 1 else tx._CN[t] + "十") + (tx._CN[o] if o else "")
    if fmt == "ideographTraditional":
        return tx._STEMS[(n - 1) % 10]
    return {"bullet": "•", "none": ""}.get(fmt, str(n))


def drawing(el: Element, pkg: Package, folder: str | None) -> str:
    """Placeholder of a drawing (P13): id and name, and place and format of its image; a link beats an embedded copy."""
    doc = el.find(f".//{WP}docPr")
    attrs = {"id": doc.get("id", "") if doc is not None else "", "name": doc.get("name", "") if doc is not None else ""}
    for blip in el.iter(A + "blip"):
        link, embed = blip.get(R + "link"), blip.get(R + "embed")
        rel = pkg.relations.get(link or embed or "")
        if rel and link:
            attrs |= {"path": rel["target"], "format": rel["format"]}
        elif rel and rel["type"] == IMAGE and not rel["external"]:
            attrs |= {"path": f"{folder}/{posixpath.basename(rel['part'])}" if folder else rel["part"].lstrip("/"), "format": rel["format"]}
        if link or embed:
            break
    return "<drawing " + " ".join(f'{k}="{html.escape(v, quote=True)}"' for k, v in attrs.items() if v is not None) + " />"


def run_text(r: Element, pkg: Package, folder: str | None) -> str:
    """Text of a run (S07): tabs, soft breaks, drawings, raised and lowered text in tags."""
    out = ""
    for c in r:
        if c.tag == W + "t":
            out += c.text or ""
        elif c.tag == W + "tab":
            out += "\t"
        elif c.tag == W + "br" and c.get(W + "type") in (None, "textWrapping"):
            out += "\n"
        elif c.tag == W + "drawing":
            out += drawing(c, pkg, folder)
    tag = {"superscript": "sup", "subscript": "sub"}.get(_val(r, "rPr/vertAlign") or "")
    return f"<{tag}>{out}</{tag}>" if tag and out else out


def content(el: Element, pkg: Package, folder: str | None = None) -> str:
    """Text of a paragraph in order (S06, S08): deleted and moved-away parts left out, equations as LaTeX in tags."""
    if el.tag in (W + "del", W + "moveFrom"):
        return ""
    if el.tag == W + "r":
        return run_text(el, pkg, folder)
    if el.tag == M + "oMath":
        s = to_latex(el)
        return f"<equation>{s}</equation>" if s else ""
    if el.tag == M + "oMathPara":
        return "".join(content(c, pkg, folder) for c in el.findall(M + "oMath"))
    return "".join(content(c, pkg, folder) for c in el)


def _labelled(p: Element, pkg: Package, folder: str | None) -> str:
    label, text = pkg.numbering.of(p), content(p, pkg, folder)
    return (f"{label} {text}" if label else text).strip()


def table(tbl: Element, pkg: Package, folder: str | None = None) -> dict:
    """A table on its grid (S09, D5): rows, first and last id of every cell, header rows.

    A spanning cell stands in its first column. The rows of a vertical merge repeat the content and id of its start,
    each with its own end id; so does an empty plain cell below a merge that is still open. No grid, no rows.
    """
    n = len(tbl.findall(f"{W}tblGrid/{W}gridCol"))
    out = {"rows": [], "ids": [], "ends": [], "headers": []}
    opened: dict[int, tuple] = {}
    for i, tr in enumerate(tbl.findall(W + "tr") if n else []):
        if tr.find(f"{W}trPr/{W}tblHeader") is not None:
            out["headers"].append(i)
        row: list[tuple] = [("", None, None)] * n
        at = 0
        for tc in tr.findall(W + "tc"):
            pkg.numbering.reset()
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            going_on = merge is not None and merge.get(W + "val") in (None, "continue")
            ids = [x for p in tc.findall(W + "p") if (x := p.get(W14 + "paraId"))]
            if going_on:
                top = opened.get(at)
                cell = (top[0], top[1], ids[-1] if ids else None) if top else ("", None, None)
            else:
                lines = [t for p in tc.findall(W + "p") if (t := _labelled(p, pkg, folder))]
                cell = ("\n".join(lines).replace("\x07", ""), ids[0] if ids else None, ids[-1] if ids else None)
                if merge is not None:
                    opened[at] = cell
                elif cell[0]:
                    opened.pop(at, None)
                elif at in opened:
                    cell = opened[at]
            if at < n:
                row[at] = cell
            at += _int(_val(tc, "tcPr/gridSpan")) or 1
        for k, name in enumerate(("rows", "ids", "ends")):
            out[name].append([c[k] for c in row])
    return out


def paragraphs(data: bytes, doc_id: str, strict: bool = True, folder: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA of one document in body order (S01, P06, P07); blank paragraphs and empty tables are left out."""
    pkg = Package(data)
    digest = "sha256:" + hashlib.sha256(data).hexdigest()
    body = parse_xml(pkg.zip.read("word/document.xml")).find(W + "body")
    pos = 0
    for el in body if body is not None else []:
        if el.tag == W + "p":
            text = _labelled(el, pkg, folder)
            pid = el.get(W14 + "paraId")
            own = _int(_val(el, "pPr/outlineLvl"))
            lv = own if own is not None else pkg.levels.get(_val(el, "pPr/pStyle"))
            if el.find(f"{W}pPr/{W}sectPr") is not None:
                pkg.numbering.reset()
            if not text:
                continue
            if pid is None and strict:
                raise MissingId(f"{doc_id}: no paragraph id at {text[:60]!r}")
            yield doc_id, pos, text, pid, None, False, lv + 1 if lv is not None and 0 <= lv <= 8 else None, None, None, None, digest
        elif el.tag == W + "tbl":
            pkg.numbering.reset()
            t = table(el, pkg, folder)
            pkg.numbering.reset()
            if not t["rows"]:
                continue
            ids, ends = ([x for r in t[k] for x in r if x] for k in ("ids", "ends"))
            head = [t["rows"][i] for i in t["headers"]] or None
            yield doc_id, pos, f"<table>{json.dumps(t['rows'], ensure_ascii=False)}</table>", ids[0] if ids else None, ends[-1] if ends else None, True, None, head, t["ids"], t["ends"], digest
        else:
            if el.tag == W + "sectPr":
                pkg.numbering.reset()
            continue
        pos += 1


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.strict = options["path"], options.get("strict", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        at = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(at, "**", "*.docx"), recursive=True) if os.path.isdir(at) else glob.glob(at))
        return [_File(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        with open(partition.value, "rb") as f:
            yield from paragraphs(f.read(), os.path.basename(partition.value), self.strict)


class DocxSource(DataSource):
    """``spark.read.format("docx").load(path)``: a file, a pattern or a folder on a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_binary(files: DataFrame, strict: bool = False) -> DataFrame:
    """The same rows from a binaryFile DataFrame (any storage Spark reads): columns path, content.

    Unreadable documents give one row with a null pos and the error as text.
    """
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    strings = pa.list_(pa.list_(pa.string()))
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), strings, strings, strings, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                doc = posixpath.basename(path.as_py() or "")
                try:
                    rows = list(paragraphs(data.as_py(), doc, strict))
                except Exception as e:  # noqa: BLE001
                    rows = [(doc, None, f"{type(e).__name__}: {e}", *[None] * (len(names) - 3))]
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def sources(files: DataFrame) -> DataFrame:
    """Meta rows of documents (D2, S19): source_file, source_hash."""
    return files.select(F.col("path").alias("source_file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_hash"))


def images(data: bytes) -> list[tuple[str, str, bytes]]:
    """Embedded images (K10): (name in the folder, format, bytes); a part once, equal names numbered _2, _3 .."""
    pkg = Package(data)
    out, parts, used = [], set(), {}
    for rel in pkg.relations.values():
        if rel["type"] != IMAGE or rel["external"] or rel["part"] in parts or rel["part"].lstrip("/") not in pkg.names:
            continue
        parts.add(rel["part"])
        stem, ext = posixpath.splitext(posixpath.basename(rel["part"]))
        used[stem + ext] = k = used.get(stem + ext, 0) + 1
        out.append((stem + (f"_{k}" if k > 1 else "") + ext, rel["format"], pkg.zip.read(rel["part"].lstrip("/"))))
    return out


def image_rows(files: DataFrame) -> DataFrame:
    """Embedded images of documents (K10): doc_id, name, format, content; unreadable documents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                try:
                    got = images(data.as_py())
                except Exception:  # noqa: BLE001
                    got = []
                doc = posixpath.basename(path.as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(got), pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.binary())], names=["doc_id", "name", "format", "content"]
                )

    return files.select("path", "content").mapInArrow(run, "doc_id string, name string, format string, content binary")


def write_images(rows: DataFrame, folder: str) -> None:
    """Writes images into ``<document>.image`` below a folder all executors share."""

    def put(part: Iterator) -> None:
        for r in part:
            at = os.path.join(folder, os.path.splitext(r.doc_id)[0] + ".image")
            os.makedirs(at, exist_ok=True)
            with open(os.path.join(at, r.name), "wb") as f:
                f.write(r.content)

    rows.foreachPartition(put)
