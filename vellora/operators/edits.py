"""Writing findings back into Word documents as tracked changes and comments."""

from __future__ import annotations

import copy
import difflib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from vellora.functions import tables as tb
from vellora.sources.docx import PKG, TYPES, W, W14, parse_xml

XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
# Content and relationship type of the comments part.
COMMENTS_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
COMMENTS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
_TAG = re.compile(r"</?(sup|sub)>", re.I)
_SPECIAL = re.compile(r"<drawing\b[^>]*?/>|<equation>.*?</equation>", re.S)

# ---- differences ---------------------------------------------------------------------------------------------------


def diff(old: str, new: str) -> list[tuple[str, str]]:
    """Character differences as (equal | delete | insert, text); a replacement is a deletion, then an insertion."""
    out = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if op == "equal":
            out.append(("equal", old[a:b]))
        else:
            out += [("delete", old[a:b])] * (b > a) + [("insert", new[c:d])] * (d > c)
    return out


def segments(text: str) -> list[tuple[str, str | None]]:
    """Text parted by raised and lowered tags: (text, None | sup | sub)."""
    out, at, now = [], 0, None
    for m in [*_TAG.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            out.append((text[at:end], now))
        if m:
            at, now = m.end(), None if m.group().startswith("</") else m.group(1).lower()
    return out


def markup_diff(old: str, new: str) -> list[tuple[str, str, str | None]]:
    """Differences of the plain texts, each piece with its raised or lowered form; a changed form is a change."""
    styled = lambda t: [(c, v) for s, v in segments(t) for c in s]
    a, b = styled(old), styled(new)
    out: list[tuple[str, str, str | None]] = []

    def put(op: str, chars: list) -> None:
        for c, v in chars:
            if out and out[-1][0] == op and out[-1][2] == v:
                out[-1] = (op, out[-1][1] + c, v)
            else:
                out.append((op, c, v))

    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            put("equal", a[i:j])
        else:
            put("delete", a[i:j])
            put("insert", b[k:m])
    return out


def touches_special(old: str, new: str) -> bool:
    """Whether an edit inserts, deletes or changes a drawing or an equation."""
    return _SPECIAL.findall(old) != _SPECIAL.findall(new)


def revised_segment(old: str, new: str, start: int, end: int) -> str:
    """What the part old[start:end] becomes in the new text (E03); insertions at its left border belong to it."""
    out, at = "", 0
    for op, s in diff(old, new):
        if op == "insert":
            out += s if start <= at < end or at == end == len(old) else ""
        else:
            if op == "equal":
                out += s[max(0, start - at) : max(0, end - at)]
            at += len(s)
    return out


def cell_edits(old: str, new: str) -> list[tuple[int, int, str, str]] | None:
    """Changed cells (row, column, old, new) of an edit of quoted table rows (E07); None if it is none or changes the shape."""
    a, b = tb.parse_rows(old), tb.parse_rows(new)
    if a is None or b is None or [len(r) for r in a[0]] != [len(r) for r in b[0]]:
        return None
    return [(i, j, str(x), str(y)) for i, (r, s) in enumerate(zip(a[0], b[0])) for j, (x, y) in enumerate(zip(r, s)) if x != y]


_OPS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType()), StructField("valign", StringType())]))


@pandas_udf(_OPS)
def diff_ops(old: pd.Series, new: pd.Series) -> pd.Series:
    """E02 over columns: array<struct<op, text, valign>>; null texts count as empty."""
    return pd.Series([[{"op": o, "text": t, "valign": v} for o, t, v in markup_diff(a or "", b or "")] for a, b in zip(old, new)], dtype=object)


# ---- the document --------------------------------------------------------------------------------------------------


@dataclass
class Piece:
    """Some text of a run as it was before any edit (M04): deleted text counts, inserted text does not."""

    run: ET.Element
    text: str
    start: int
    changed: bool
    whole: bool  # the run cannot be cut


@dataclass
class Result:
    item_id: object
    status: str
    success: bool
    warning: bool
    message: str = ""


@dataclass
class Document:
    """An open document: its paragraphs in order, ids to continue, comments to add."""

    data: bytes
    author: str
    initials: str
    date: str
    comments: list[tuple[int, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(self.data))
        raw = self.zip.read("word/document.xml")
        for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), events=["start-ns"]):
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        self.root = parse_xml(raw)
        self.paras = list(self.root.iter(W + "p"))
        tables = {p: t for t in self.root.iter(W + "tbl") for p in t.iter(W + "p")}
        self.table = [tables.get(p) for p in self.paras]
        old = self.zip.read("word/comments.xml") if "word/comments.xml" in self.zip.namelist() else None
        self.old_comments = parse_xml(old) if old else None
        ids = lambda els: [int(v) for e in els if (v := e.get(W + "id", "")).isdigit()]
        self.next_comment = max(ids(self.old_comments.iter(W + "comment")) if self.old_comments is not None else [], default=-1) + 1
        self.next_change = max(ids(e for e in self.root.iter() if e.get(W + "author") is not None), default=-1) + 1

    def within(self, uuid: str, uuid_end: str) -> list[int]:
        """Places of the paragraphs from the start id to the end id (J09); none without a start."""
        pid = [(p.get(W14 + "paraId") or "").upper() for p in self.paras]
        first = next((i for i, x in enumerate(pid) if x == uuid), None)
        if first is None:
            return []
        ends = [i for i in range(first, len(pid)) if pid[i] == uuid_end]
        if self.table[first] is not None and (same := [i for i in ends if self.table[i] is self.table[first]]):
            return list(range(first, same[-1] + 1))
        return list(range(first, ends[0] + 1 if ends else len(pid)))

    def pieces(self, p: ET.Element) -> list[Piece]:
        out: list[Piece] = []

        def walk(el: ET.Element, changed: bool) -> None:
            for c in el:
                if c.tag == W + "ins":
                    continue
                if c.tag == W + "r":
                    t = "".join(x.text or "" if x.tag in (W + "t", W + "delText") else "\t" if x.tag == W + "tab" else "\n" if x.tag == W + "br" and x.get(W + "type") in (None, "textWrapping") else "" for x in c)
                    if t:
                        out.append(Piece(c, t, sum(len(x.text) for x in out), changed, any(x.tag == W + "drawing" for x in c)))
                elif c.tag not in (W + "pPr", W + "moveFrom"):
                    walk(c, changed or c.tag == W + "del")

        walk(p, False)
        return out

    def _run(self, like: ET.Element, text: str, valign: str | None = None, deleted: bool = False) -> ET.Element:
        r = ET.Element(W + "r")
        props = like.find(W + "rPr")
        if props is not None:
            r.append(copy.deepcopy(props))
        if valign:
            pr = r.find(W + "rPr")
            pr = ET.SubElement(r, W + "rPr") if pr is None else pr
            ET.SubElement(pr, W + "vertAlign", {W + "val": {"sup": "superscript", "sub": "subscript"}[valign]})
        for part in re.split(r"(\n|\t)", text):
            if part in ("\n", "\t"):
                ET.SubElement(r, W + ("br" if part == "\n" else "tab"))
            elif part:
                ET.SubElement(r, W + ("delText" if deleted else "t"), {XML_SPACE: "preserve"}).text = part
        return r

    def _change(self, kind: str, author: str, run: ET.Element) -> ET.Element:
        el = ET.Element(W + kind, {W + "id": str(self.next_change), W + "author": author, W + "date": self.date})
        self.next_change += 1
        el.append(run)
        return el

    def text(self, i: int) -> str:
        """Original text of the i-th paragraph."""
        return "".join(x.text for x in self.pieces(self.paras[i]))

    def touched(self, p: ET.Element, start: int, ops: list[tuple[str, str, str | None]]) -> tuple[str, list[Piece]]:
        """Whether differences can be applied from ``start`` of a paragraph: success, conflict or special, and the pieces they touch."""
        end = start + sum(len(t) for op, t, _ in ops if op != "insert")
        hit = [x for x in self.pieces(p) if x.start < end and x.start + len(x.text) > start]
        status = "special" if not hit else "conflict" if any(x.changed for x in hit) else "success"
        if status == "success" and any(x.whole for x in hit):
            # a run that cannot be cut stays as it is: the change must leave all of it alone
            at = start
            for op, t, _ in ops:
                if op != "insert":
                    if op == "delete" and any(x.whole and x.start < at + len(t) and x.start + len(x.text) > at for x in hit):
                        status = "special"
                    at += len(t)
            if any(x.whole and (x.start < start or x.start + len(x.text) > end) for x in hit):
                status = "special"
        return status, hit

    def edit_range(self, places: list[int], offset: int, ops: list[tuple[str, str, str | None]], author: str, reason: str) -> str:
        """Applies differences of a text that runs over paragraphs, joined by line feeds (E06), under one comment.

        A deleted line feed deletes the paragraph's mark, so that it runs on in the next; an inserted one is a line break.
        All paragraphs are looked at before the first is changed.
        """
        parts: list[list[tuple[str, str, str | None]]] = [[] for _ in places]
        marks: set[int] = set()
        k = 0
        for op, t, v in ops:
            for j, line in enumerate(t.split("\n")):
                if j and op == "insert":
                    parts[k].append(("insert", "\n", v))
                elif j:
                    if op == "delete":
                        marks.add(k)
                    k += 1
                if line:
                    parts[k].append((op, line, v))
        changes = any(op != "equal" for op, _, _ in ops)  # then paragraphs that stay as they are need not be touched
        jobs = [(k, offset if k == 0 else 0) for k, x in enumerate(parts) if any(op != "insert" for op, _, _ in x) and (not changes or any(op != "equal" for op, _, _ in x))]
        bad = [status for k, at in jobs if (status := self.touched(self.paras[places[k]], at, parts[k])[0]) != "success"]
        if bad or not jobs:
            return "conflict" if "conflict" in bad else "special"
        for n, (k, at) in enumerate(jobs):
            self.edit(self.paras[places[k]], at, parts[k], author, reason, opens=n == 0, closes=n == len(jobs) - 1)
        for k in sorted(marks):
            self._delete_mark(self.paras[places[k]], author)
        return "success"

    def _delete_mark(self, p: ET.Element, author: str) -> None:
        props = p.find(W + "pPr")
        if props is None:
            props = ET.Element(W + "pPr")
            p.insert(0, props)
        run = props.find(W + "rPr")
        run = ET.SubElement(props, W + "rPr") if run is None else run
        run.insert(0, ET.Element(W + "del", {W + "id": str(self.next_change), W + "author": author, W + "date": self.date}))
        self.next_change += 1

    def table_rows(self, places: list[int]) -> list[tuple[int, list[tuple[bool, list[int]]]]]:
        """Rows of the tables among the paragraphs (M05): (number of the table, grid columns as (filled from above, places)).

        A cell over several columns stands in its first one; the others are empty.
        """
        at = {id(p): i for i, p in enumerate(self.paras)}
        tables = list({id(self.table[i]): self.table[i] for i in places if self.table[i] is not None}.values())
        out = []
        for n, t in enumerate(tables):
            for tr in t.findall(W + "tr"):
                row: list[tuple[bool, list[int]]] = []
                for tc in tr.findall(W + "tc"):
                    merge, span = tc.find(f"{W}tcPr/{W}vMerge"), tc.find(f"{W}tcPr/{W}gridSpan")
                    above = merge is not None and merge.get(W + "val") in (None, "continue")
                    row.append((above, [at[id(p)] for p in tc.findall(W + "p")]))
                    row += [(False, [])] * (int(span.get(W + "val") or 1) - 1 if span is not None else 0)
                out.append((n, row))
        return out

    def quoted_rows(self, places: list[int], quoted: list[list]) -> list[list[tuple[bool, list[int]]]] | None:
        """The neighbouring table rows a quote of rows stands for, row numbers aside; None if there are none."""
        plain = lambda s: tb.unnumbered_lines(_TAG.sub("", str(s if s is not None else ""))).strip()
        rows = self.table_rows(places)

        def same(row: list[tuple[bool, list[int]]], want: list) -> bool:
            if len(row) != len(want):
                return False
            for j, ((above, at), w) in enumerate(zip(row, want)):
                text = "\n".join(self.text(i) for i in at)
                number = j == 0 and tb._ROW.fullmatch(str(w or "").strip()) and (not text.strip() or tb._ROW.fullmatch(text.strip()))
                if not (number or above and not text.strip() or plain(text) == plain(w)):
                    return False
            return True

        for a in range(len(rows) - len(quoted) + 1):
            part = rows[a : a + len(quoted)]
            if len({n for n, _ in part}) == 1 and all(same(r, w) for (_, r), w in zip(part, quoted)):
                return [r for _, r in part]
        return None

    def comment_range(self, first: int, last: int, text: str, author: str) -> None:
        """A comment over whole paragraphs, in their order in the document."""
        first, last = min(first, last), max(first, last)
        cid = {W + "id": str(self.next_comment)}
        p = self.paras[first]
        p.insert(1 if len(p) and p[0].tag == W + "pPr" else 0, ET.Element(W + "commentRangeStart", cid))
        self.paras[last].append(ET.Element(W + "commentRangeEnd", cid))
        self.comment_on(self.paras[last], text, author)

    def edit(self, p: ET.Element, start: int, ops: list[tuple[str, str, str | None]], author: str, reason: str, opens: bool = True, closes: bool = True) -> str:
        """Applies differences to the text from ``start`` of a paragraph (E04, E05): success, conflict or special.

        ``opens`` and ``closes`` tell whether the comment's range begins and ends here.
        """
        end = start + sum(len(t) for op, t, _ in ops if op != "insert")
        status, hit = self.touched(p, start, ops)
        if status != "success":
            return status
        parent = {c: e for e in p.iter() for c in e}
        marks = [(max(x.start, start), min(x.start + len(x.text), end), x) for x in hit]
        new: dict[int, list[ET.Element]] = {id(x.run): [] for x in hit}
        put = lambda x, el: new[id(x.run)].append(el)
        if start > hit[0].start:
            put(hit[0], self._run(hit[0].run, hit[0].text[: start - hit[0].start]))
        cid, at = self.next_comment, start
        if opens:
            put(hit[0], ET.Element(W + "commentRangeStart", {W + "id": str(cid)}))
        for op, t, v in ops:
            if op == "insert":
                x = next((m for m in marks if m[0] <= at <= m[1]), marks[-1])[2]
                put(x, self._change("ins", author, self._run(x.run, t, v)))
                continue
            for a, b, x in marks:
                lo, hi = max(a, at), min(b, at + len(t))
                if lo < hi and x.whole:
                    put(x, x.run)
                elif lo < hi:
                    r = self._run(x.run, x.text[lo - x.start : hi - x.start], deleted=op == "delete")
                    put(x, self._change("del", author, r) if op == "delete" else r)
            at += len(t)
        last = hit[-1]
        if closes:
            put(last, ET.Element(W + "commentRangeEnd", {W + "id": str(cid)}))
            put(last, self._reference(cid))
        if end < last.start + len(last.text):
            put(last, self._run(last.run, last.text[end - last.start :]))
        for x in hit:
            host = parent[x.run]
            k = list(host).index(x.run)
            host.remove(x.run)
            for el in reversed(new[id(x.run)]):
                host.insert(k, el)
        if closes:
            self._note(reason, author)
        return "success"

    def _reference(self, cid: int) -> ET.Element:
        r = ET.Element(W + "r")
        ET.SubElement(ET.SubElement(r, W + "rPr"), W + "rStyle", {W + "val": "CommentReference"})
        ET.SubElement(r, W + "commentReference", {W + "id": str(cid)})
        return r

    def _note(self, text: str, author: str) -> None:
        self.comments.append((self.next_comment, text, author))
        self.next_comment += 1

    def comment_on(self, p: ET.Element, text: str, author: str) -> None:
        """A comment that only refers to a paragraph."""
        p.append(self._reference(self.next_comment))
        self._note(text, author)

    def save(self) -> bytes:
        """The package with the changed document and its comments part."""
        out = io.BytesIO()
        names = self.zip.namelist()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                if n == "word/document.xml":
                    body = ET.tostring(self.root, encoding="UTF-8", xml_declaration=True)
                elif n == "word/comments.xml" and self.comments:
                    continue
                elif n == "[Content_Types].xml" and self.comments:
                    t = parse_xml(self.zip.read(n))
                    if not any(x.get("PartName") == "/word/comments.xml" for x in t):
                        ET.SubElement(t, TYPES + "Override", {"PartName": "/word/comments.xml", "ContentType": COMMENTS_TYPE})
                    body = ET.tostring(t, encoding="UTF-8", xml_declaration=True)
                elif n == "word/_rels/document.xml.rels" and self.comments:
                    t = parse_xml(self.zip.read(n))
                    if not any(x.get("Type") == COMMENTS_REL for x in t):
                        taken = {x.get("Id") for x in t}
                        free = next(f"rId{k}" for k in range(1, 10**6) if f"rId{k}" not in taken)
                        ET.SubElement(t, PKG + "Relationship", {"Id": free, "Type": COMMENTS_REL, "Target": "comments.xml"})
                    body = ET.tostring(t, encoding="UTF-8", xml_declaration=True)
                else:
                    body = self.zip.read(n)
                z.writestr(n, body)
            if self.comments:
                root = self.old_comments if self.old_comments is not None else ET.Element(W + "comments")
                for cid, text, author in self.comments:
                    c = ET.SubElement(root, W + "comment", {W + "id": str(cid), W + "author": author, W + "date": self.date, W + "initials": self.initials})
                    c_p = ET.SubElement(c, W + "p")
                    c_p.append(self._run(c_p, re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)))
                z.writestr("word/comments.xml", ET.tostring(root, encoding="UTF-8", xml_declaration=True))
        return out.getvalue()


# ---- items ---------------------------------------------------------------------------------------------------------

#: Outcome of each status (E12): success, warning.
MATRIX = {"success": (True, False), "commented": (True, False), "conflict": (True, True), "special": (True, True), "cross_row": (True, True), "cross_cell": (True, True), "equation": (True, True), "not_found": (True, True), "no_anchor": (False, False)}


def _occurrences(doc: Document, places: list[int], quote: str) -> Iterator[tuple[ET.Element, int]]:
    for i in places:
        text = "".join(x.text for x in doc.pieces(doc.paras[i]))
        at = text.find(quote)
        while at >= 0:
            yield doc.paras[i], at
            at = text.find(quote, at + 1)


def _joined(doc: Document, places: list[int], quote: str) -> tuple[list[int], int] | None:
    """The paragraphs a quote of several lines begins and ends in, and its place in the first; None if they do not hold it."""
    lines = quote.split("\n")
    for k in range(len(places) - len(lines) + 1):
        span = places[k : k + len(lines)]
        texts = [doc.text(i) for i in span]
        if texts[0].endswith(lines[0]) and texts[-1].startswith(lines[-1]) and texts[1:-1] == lines[1:-1]:
            return span, len(texts[0]) - len(lines[0])
    return None


def _edit_rows(doc: Document, places: list[int], old: list[list], new: list[list] | None, author: str, why: str) -> str:
    """Changes quoted table rows cell by cell (E07); without ``new`` the text of all their cells is deleted.

    The outcome is cross_row or cross_cell where the rows are not in the document or change their shape.
    """
    lost = "cross_row" if len(old) > 1 else "cross_cell"
    if new is not None and [len(r) for r in old] != [len(r) for r in new]:
        return lost
    rows = doc.quoted_rows(places, old)
    if rows is None:
        return lost
    jobs = []
    for i, row in enumerate(rows):
        for j, (above, at) in enumerate(row):
            was = "\n".join(doc.text(k) for k in at)
            if above or not at or not was:
                continue
            if new is None:
                jobs.append((at, was, ""))
            elif old[i][j] != new[i][j]:
                jobs.append((at, was, str(new[i][j] if new[i][j] is not None else "")))
    if not jobs:
        return lost
    ready = [(at, markup_diff(a, b) if b else [("delete", a, None)]) for at, a, b in jobs]
    for at, ops in ready:  # all cells are looked at before the first is changed
        if len(at) == 1 and (bad := doc.touched(doc.paras[at[0]], 0, ops)[0]) != "success":
            return bad
    for at, ops in ready:
        got = doc.edit_range(at, 0, ops, author, why)
        if got != "success":
            return got
    return "success"


def apply_item(doc: Document, item: dict) -> Result:
    """One item in its turn (E11): the first place of the quote that no earlier edit touched is changed.

    Quotes are tried as they are, then without numbering, then without tags, then over paragraphs (E06). Quoted table
    rows change in the cells of the rows they stand for (E07); manual items get a comment over what they quote (E08).
    What cannot be changed gets a comment with the reason in its place.
    """
    get = lambda k: item.get(k) or ""
    quote, action, why = get("violation_text"), get("fix_action") or "manual", get("violation_reason")
    revised = "" if action == "delete" else get("revised_text")
    author = f"{doc.author}-{get('category').strip() or 'uncategorized'}"
    done = lambda status, text="": Result(item.get("item_id"), status, *MATRIX[status], text)
    places = doc.within(get("uuid").strip().upper(), get("uuid_end").strip().upper())
    if not places:
        return done("no_anchor", "start paragraph not found")
    where = doc.paras[places[0]]
    reasons = {"conflict": "text changed by an earlier edit", "special": "the text holds a drawing", "equation": "an equation or drawing would change", "cross_row": "the edit runs over table rows", "cross_cell": "the edit runs over table cells"}

    def fall_back(status: str, reason: str | None = None) -> Result:
        reason = reason or reasons.get(status, "violation text not found")
        doc.comment_on(where, f"[FALLBACK]{reason}\n{{WHY}}{why} {{WHERE}}{quote} {{SUGGEST}}{revised}", author)
        return done(status, reason)

    rows = got[0] if quote.lstrip().startswith("[") and (got := tb.parse_rows(quote)) and all(isinstance(r, list) for r in got[0]) else None
    if action == "manual":
        plain = _TAG.sub("", quote)
        text = why + (f"\nSuggestion: {revised}" if revised else "")
        spot = next(_occurrences(doc, places, plain), None) if quote else None
        if spot and doc.edit(spot[0], spot[1], [("equal", plain, None)], author, text) == "success":
            return done("commented")
        if "\n" in plain and (over := _joined(doc, places, plain)) and doc.edit_range(*over, [("equal", plain, None)], author, text) == "success":
            return done("commented")
        if rows and (found := doc.quoted_rows(places, rows)) and (cells := [i for r in found for _, at in r for i in at]):
            doc.comment_range(cells[0], cells[-1], text, author)
            return done("commented")
        return fall_back("not_found" if spot is None else "conflict")
    if not quote:
        return fall_back("not_found", "no text to change")
    if touches_special(quote, revised) and action == "replace":
        return fall_back("equation" if "<equation>" in quote + revised else "special", reasons["equation"])
    if rows:
        new = None if action == "delete" else p[0] if (p := tb.parse_rows(revised)) else []
        status = _edit_rows(doc, places, rows, new, author, why)
        return done(status) if status == "success" else fall_back(status)
    status = "not_found"
    bare = tb.unnumbered_lines(quote)
    for a, b in dict.fromkeys([(quote, revised), (bare, tb.unnumbered_lines(revised))] if bare != quote else [(quote, revised)]):
        plain = _TAG.sub("", a)
        ops = markup_diff(a, b) if b else [("delete", plain, None)]
        for p, at in _occurrences(doc, places, plain) if plain else []:
            status = doc.edit(p, at, ops, author, why)
            if status == "success":
                return done("success")
        if "\n" in plain and (over := _joined(doc, places, plain)):
            status = doc.edit_range(*over, ops, author, why)
            if status == "success":
                return done("success")
    return fall_back(status)


def apply_items(data: bytes, items: list[dict], author: str = "AI", initials: str | None = None, date: str = "2000-01-01T00:00:00Z") -> tuple[bytes, list[Result]]:
    """A document with its items applied in order, and their results."""
    doc = Document(data, author, initials or author[:2], date)
    results = [apply_item(doc, i) for i in items]
    return doc.save(), results


ITEM = ["item_id", "uuid", "uuid_end", "violation_text", "violation_reason", "fix_action", "revised_text", "category"]


def apply_edits(documents: DataFrame, items: DataFrame, author: str = "AI", date: str = "2000-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Edited documents (doc_id, content) and results (doc_id, item_id, status, success, warning, message).

    ``documents``: doc_id, content (bytes), source_hash. Items of one document depend on each other, so a document
    and its items are one cogroup; a document is bounded by its own file.
    """
    from pyspark.sql import functions as F

    schema = "doc_id string, content binary, results array<struct<item_id:string,status:string,success:boolean,warning:boolean,message:string>>"

    def run(d: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({"doc_id": pd.Series(dtype=str), "content": pd.Series(dtype=object), "results": pd.Series(dtype=object)})
        rows = i.sort_values("item_id")[ITEM].astype(object).where(i.notna(), None).to_dict("records") if len(i) else []
        out, res = apply_items(bytes(d["content"].iloc[0]), rows, author, date=date)
        return pd.DataFrame({"doc_id": [d["doc_id"].iloc[0]], "content": [out], "results": [[{"item_id": str(r.item_id), "status": r.status, "success": r.success, "warning": r.warning, "message": r.message} for r in res]]})

    done = documents.select("doc_id", "content").groupBy("doc_id").cogroup(items.select("doc_id", *ITEM).dropDuplicates(["doc_id", "item_id"]).groupBy("doc_id")).applyInPandas(run, schema)
    return done.select("doc_id", "content"), done.select("doc_id", F.inline("results"))


def items_of(lines: DataFrame) -> DataFrame:
    """Edit items of flat lines (S18): doc_id and ITEM, item_id from the line where it has one, else its place; metas are left out."""
    from pyspark.sql import functions as F

    rows = lines.filter("type is null or type <> 'meta'") if "type" in lines.columns else lines
    have = set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ITEM if c not in have and c != "item_id"})
    item_id = F.col("item_id").cast("string") if "item_id" in have else F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return rows.select("doc_id", item_id.alias("item_id"), *[c for c in ITEM if c != "item_id"])


def write_documents(edited: DataFrame, folder: str) -> None:
    """Writes edited documents as files into a folder all executors share."""
    import os

    def put(part: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in part:
            with open(os.path.join(folder, os.path.basename(r.doc_id)), "wb") as f:
                f.write(r.content)

    edited.foreachPartition(put)


def summary(results: DataFrame) -> DataFrame:
    """Succeeded, with warnings, failed."""
    from pyspark.sql import functions as F

    return results.agg(F.count_if(F.col("success") & ~F.col("warning")).alias("succeeded"), F.count_if(F.col("success") & F.col("warning")).alias("warnings"), F.count_if(~F.col("success")).alias("failed"))


def verify_hashes(documents: DataFrame, meta: DataFrame) -> DataFrame:
    """Documents whose bytes are not those the findings were made on."""
    from pyspark.sql import functions as F

    return documents.join(meta.select("doc_id", F.col("source_hash").alias("expected")), "doc_id").filter(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("expected")).select("doc_id")
