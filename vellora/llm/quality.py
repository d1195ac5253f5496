"""Text quality statistics from associative partial counts over chunks."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.llm.codes import join_hashes, points, run_hashes, runs

# Frequent function words, and characters of that use in Chinese.
COMMON = frozenset(
    """the a an and or but of to in on at for with from by is are was were be been it its this that my your our i me we you he she they not no so if as than then too very have has had do does did would could will can all more one after since mine what who when which there just only even about out up over
    der die das den dem des ein eine einen einem einer und oder aber von zu im in am an auf für mit aus bei ist sind war waren es sich ich wir sie er man nicht kein keine so wenn als auch noch schon nur sehr hat habe haben wird würde nach über dass denn weil mein meine unser zum zur vom was wer
    le la les un une des du de et ou mais à au aux en dans sur pour avec par est sont était c qu que qui ce cette mon ma mes notre je j on nous il elle ne pas plus très si a ont ai s l d m n y même reste sans depuis
    el los las una unos del al y o pero en con por para es son era está que lo mi mis me nos se no ni sin muy más como si ya ha han hasta desde este esta su todo nada porque cuando antes
    il lo gli uno di da con per che non sono era ho ci è e i
    o os um uma do da dos das em no na por não com mais foi é
    het een van op te dat niet met voor zijn ik er maar ook
    и в во не на я что он она с со как это но по к у за от для из мы мне был была все так же его
    i w z na nie się jest to do że
    och att det som en på är av för inte jag""".split()
)
COMMON_CJK = frozenset("的了是我在有不很也都就和用还没这那个一好要会着到说吗吧")


#: Names of the additive counts of a run of text.
COUNTS = (
    "chars", "solid", "letters", "digits", "symbols", "cjk", "cjk_common", "kana", "stops", "delims", "tabs", "pipes", "colons", "hard", "gaps",
    "tokens", "words", "word_chars", "common", "odd", "marked", "long", "links",
)
_N = len(COUNTS)
C = {c: i for i, c in enumerate(COUNTS)}
KINDS = ("lines", "listed", "tabular", "junk", "junk_chars", "prose", "prose_chars", "sentences", "stopped")
_BUCKETS = 64
_BULLET = re.compile(r"(?:[-*•+·–—▪◦‣●○■□]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\])\s+\S|[①-⑳]|[•●▪◦]\S|\d{1,3}、")
_PAIR = re.compile(r"[^:=.!?。！？：]{1,30}(?:[:：]| =)\s*[^.!?。！？]{0,48}$")
_CELLS = re.compile(r'"[^"]*"(?:[;,]"[^"]*")+$|[^,;.!?]{1,30}(?:[,;]\d+)+$')
_URL = re.compile(r"(?:https?://|www\.)\S")
_HEAD = 96
#: Characters counted in one go; a text is cut into chunks of so many.
CHUNK = 4096
#: Characters that stay in one task: the chunks of a longer text are spread over the cluster.
STRETCH = 1 << 20
FAN_IN = 64
#: Characters by their part in a line.
_SETS = {
    "stop": ".!?。！？…", "wide_stop": "。！？", "close": "\"'”’»)）」』", "delim": ",;", "colon": ":：=", "slash": "/", "lt": "<", "gt": ">", "eq": "=", "quote": "\"'", "brace": "{", "angle": "{}<>",
    "at": "@", "dot": ".", "odd_first": "ÂÃÅâæçèéåäï", "odd_second": "€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ" + "".join(map(chr, range(0x80, 0xC0))), "q": "qQ",
}
_PLAIN = set(".,!?;:'\"’“”„«»‘()-–—…¿¡。，！？、；：（）《》「」%&/")
#: Vowels of alphabets that write them; their other letters are consonants.
_VOWELS = set("aeiouyæœøıəαεηιουωаеёиоуыэюяіїєў")
_BITS = {b: np.uint32(1 << i) for i, b in enumerate(["space", "letter", "digit", "symbol", "cjk", "cjk_common", "kana", "tab", "pipe", "word", "consonant", "unspaced", *_SETS])}


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its classes (bits) and its lower case."""
    cls, low = np.zeros(0x110000, dtype=np.uint32), np.arange(0x110000, dtype=np.uint32)
    cls[0x20000:] = _BITS["symbol"]
    cls[0x20000:0x32000] = _BITS["letter"] | _BITS["word"] | _BITS["cjk"]
    for cp in range(0x20000):
        c = chr(cp)
        kind, b = unicodedata.category(c), np.uint32(0)
        if c.isspace():
            b |= _BITS["space"]
        elif kind[0] == "L" or kind in ("Mn", "Mc") and not 0xFE00 <= cp <= 0xFE0F:
            b |= _BITS["letter"] | _BITS["word"]
            if 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF:
                b |= _BITS["cjk"]
                if cp <= 0x30FF:
                    b |= _BITS["kana"]
            elif 0xE00 <= cp <= 0x109F or 0x1780 <= cp <= 0x17FF:  # Thai to Myanmar, Khmer
                b |= _BITS["unspaced"]
            elif cp < 0x530 or 0x1E00 <= cp <= 0x1FFF:
                base = unicodedata.normalize("NFD", c.lower())[0]
                if kind[0] == "L" and base not in _VOWELS and kind != "Lm":
                    b |= _BITS["consonant"]
        elif kind[0] == "N":
            b |= _BITS["word"] | (_BITS["digit"] if kind == "Nd" else np.uint32(0))
        elif c not in _PLAIN:
            b |= _BITS["symbol"]
        if len(c.lower()) == 1:
            low[cp] = ord(c.lower())
        cls[cp] = b
    for name, chars in {**_SETS, "tab": "\t", "pipe": "|", "cjk_common": COMMON_CJK}.items():
        for c in chars:
            cls[ord(c)] |= _BITS[name]
    return cls, low


@lru_cache
def _common_hashes() -> np.ndarray:
    return np.sort(np.array([run_hashes(points(w), np.array([0]), np.array([len(w)]))[0] for w in COMMON], dtype=np.uint64))


def _is_common(h: np.ndarray) -> np.ndarray:
    known = _common_hashes()
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58)).astype(np.int64)


#: Counts of a run of characters without blanks, before it is known whether it is a word, a link, markup or noise.
RAW = ("length", "unspaced", "ascii", "words", "word_chars", "common", "odd", "marks", "angles", "at_any", "at", "dot", "url", "tag")
R = {c: i for i, c in enumerate(RAW)}


def _decide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What whole tokens (rows of RAW) add to the counts from "tokens" on, and whether their words count."""
    length, cjk = raw[:, R["length"]], raw[:, R["unspaced"]] > 0
    link = (raw[:, R["url"]] > 0) | (raw[:, R["at"]] > 0) & (raw[:, R["dot"]] >= raw[:, R["at"]] + 2)
    marked = ~link & ((raw[:, R["marks"]] > 0) | (raw[:, R["tag"]] > 0) | (raw[:, R["angles"]] == length))
    long = ~link & ~marked & ~cjk & (length > 30)
    counted = ~link & ~long
    out = np.zeros((len(raw), 8), dtype=np.int64)
    out[:, 0] = 1
    for k, name in enumerate(("words", "word_chars", "common", "odd"), 1):
        out[:, k] = raw[:, R[name]] * (counted if name != "odd" else ~link)
    out[:, 5] = np.where(marked, np.where(cjk, raw[:, R["ascii"]], length), 0)
    out[:, 6] = length * long
    out[:, 7] = link
    return out, counted


def _near(cp: np.ndarray, cls: np.ndarray) -> dict[str, np.ndarray]:
    """Places of the patterns of up to three neighbouring characters; past the end is a blank."""
    has = lambda x, *names: (x & np.bitwise_or.reduce([_BITS[n] for n in names])) != 0
    follows = np.append(cls[1:], _BITS["space"])
    hard = has(cls, "consonant")
    triple = hard.copy()
    triple[2:] &= hard[1:-1] & hard[:-2]
    triple[:2] = False
    return {
        "stops": has(cls, "stop") & ~has(follows, "stop") & (has(follows, "space", "close") | has(cls, "wide_stop")),
        "delims": has(cls, "delim") & ~has(follows, "space", "delim"),
        "hard": triple.astype(np.int64) + 2 * (has(cls, "q") & has(follows, "consonant")),
        "odd": has(cls, "odd_first") & has(follows, "odd_second") & ~has(follows, "space") | (cp == 0xFFFD),
        "marks": has(cls, "lt") & has(follows, "letter", "slash") | has(cls, "slash") & has(follows, "gt") | has(cls, "eq") & has(follows, "quote") | has(cls, "brace") & has(follows, "brace"),
        "dot": has(cls, "dot") & has(follows, "word"),
    }


def _border(a: str, b: str) -> dict[str, int]:
    """What joining the ends a and b adds to each pattern of neighbouring characters."""
    sums = []
    for x in (a + b, a, b):
        cp = points(x)
        sums.append({k: int(v.sum()) for k, v in _near(cp, _tables()[0][cp]).items()})
    return {k: sums[0][k] - sums[1][k] - sums[2][k] for k in sums[0]}


class Counted:
    """Counts of a list of texts, line by line: all characters of all texts at once, by class tables and runs.

    n: a row of COUNTS per line; h: a histogram of hashed words and ideographs per group of lines; text_of, start, end:
    the text and the characters of each line; last: the last visible character of a line (0 if none).
    """

    def __init__(self, texts: list[str], borders: bool = False) -> None:
        """With ``borders`` a text's first, inner and last lines are groups of their own, and what its tokens are made of is kept."""
        cls_table, low_table = _tables()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        cp = points("\n".join(texts) + "\n")
        n = len(cp)
        sep = np.cumsum(sizes + 1) - 1
        is_sep = np.zeros(n + 1, dtype=bool)
        is_sep[sep] = True
        cls = cls_table[cp]
        has = lambda *names: (cls & np.bitwise_or.reduce([_BITS[x] for x in names])) != 0
        near = _near(cp, cls)
        carriage = np.flatnonzero(cp == 13)
        paired = carriage[(cp[np.minimum(carriage + 1, n - 1)] == 10) & ~is_sep[carriage + 1]]
        ends = np.union1d(np.union1d(np.flatnonzero(cp == 10), sep), np.setdiff1d(carriage, paired))
        start = np.concatenate([[0], ends[:-1] + 1])
        stop_at = ends - np.isin(ends - 1, paired)
        lines = len(ends)
        line_of = np.repeat(np.arange(lines), ends + 1 - start)
        self.lines, self.text_of = lines, np.searchsorted(sep, start)
        first = np.concatenate([[0], sep[:-1] + 1])[self.text_of]
        self.start, self.end = start - first, stop_at - first
        self.opening = np.append(True, self.text_of[1:] != self.text_of[:-1])
        self.closing = np.append(self.opening[1:], True)
        group_of, groups = self.text_of, len(texts)
        if borders:
            group_of, groups = self.text_of * 3 + np.where(self.opening, 0, np.where(self.closing, 2, 1)), 3 * len(texts)
        count = lambda mask: np.bincount(line_of[mask], minlength=lines)
        solid = ~has("space")
        out = np.zeros((lines, _N), dtype=np.int64)
        cjk, letter = has("cjk"), has("letter")
        masks = {
            "solid": solid, "letters": letter, "digits": has("digit"), "symbols": has("symbol"), "cjk": cjk, "cjk_common": has("cjk_common"), "kana": has("kana"),
            "stops": near["stops"], "delims": near["delims"], "tabs": has("tab"), "pipes": has("pipe"), "colons": has("colon"),
        }
        for name, mask in masks.items():
            out[:, C[name]] = count(mask)
        hard = np.flatnonzero(near["hard"])
        out[:, C["hard"]] = np.bincount(line_of[hard], weights=near["hard"][hard], minlength=lines)
        out[:, C["chars"]] = stop_at - start
        # tokens: runs without blanks
        t_start, t_end = runs(solid)
        k = len(t_start)
        opens = np.zeros(n, dtype=np.int8)
        opens[t_start] = 1
        tok_of = np.cumsum(opens, dtype=np.int64) - 1
        t_line = line_of[t_start]
        same = np.flatnonzero(t_line[1:] == t_line[:-1]) if k else np.empty(0, dtype=np.int64)
        wide = same[t_start[same + 1] - t_end[same] >= 3]
        if len(wide):
            plain = np.concatenate([[0], np.cumsum(cp == 32)])
            size = t_start[wide + 1] - t_end[wide]
            wide = wide[plain[t_start[wide + 1]] - plain[t_end[wide]] == size]
            out[:, C["gaps"]] = np.bincount(t_line[wide], minlength=lines)
        self.last = np.zeros(lines, dtype=np.uint32)
        self.last[t_line] = cp[t_end - 1]
        raw = np.zeros((k, len(RAW)), dtype=np.int64)
        per_token = lambda mask: np.bincount(tok_of[mask], minlength=k)
        raw[:, R["length"]] = t_end - t_start
        raw[:, R["unspaced"]] = per_token(cjk | has("unspaced"))  # scripts without blanks between words
        raw[:, R["odd"]] = 2 * per_token(near["odd"])
        raw[:, R["marks"]] = per_token(near["marks"])
        raw[:, R["angles"]] = per_token(has("angle"))
        raw[:, [R["at_any"], R["at"], R["dot"]]] = -1
        at = np.flatnonzero(has("at"))
        raw[tok_of[at[::-1]], R["at_any"]] = (at - t_start[tok_of[at]])[::-1]
        at = at[at > t_start[tok_of[at]]] if len(at) else at
        raw[tok_of[at[::-1]], R["at"]] = (at - t_start[tok_of[at]])[::-1]
        dots = np.flatnonzero(near["dot"])
        raw[tok_of[dots], R["dot"]] = dots - t_start[tok_of[dots]]
        lead = cp[t_start]
        for i in np.flatnonzero(((lead == 104) | (lead == 119)) & (raw[:, 0] > 4)):
            raw[i, R["url"]] = _URL.match(cp[t_start[i] : t_start[i] + 9].tobytes().decode("utf-32-le", "surrogatepass")) is not None
        raw[:, R["tag"]] = (lead == 35) & (raw[:, 0] > 1) & ((cls[np.minimum(t_start + 1, n - 1)] & _BITS["word"]) != 0)
        mixed = (raw[:, R["unspaced"]] > 0) & (raw[:, R["marks"]] > 0)
        if mixed.any():
            raw[:, R["ascii"]] = per_token(solid & (cp < 128))
        # words: runs of letters that are no ideographs
        low = low_table[cp]
        w_start, w_end = runs(letter & ~cjk)
        w_hash = run_hashes(low, w_start, w_end)
        w_tok = tok_of[w_start]
        raw[:, R["words"]] = np.bincount(w_tok, minlength=k)
        raw[:, R["word_chars"]] = np.bincount(w_tok, weights=w_end - w_start, minlength=k)
        raw[:, R["common"]] = np.bincount(w_tok[_is_common(w_hash)], minlength=k)
        add, counted = _decide(raw)
        for j in range(add.shape[1]):
            out[:, C["tokens"] + j] = np.bincount(t_line, weights=add[:, j], minlength=lines)
        c_at = np.flatnonzero(cjk)
        c_at = c_at[counted[tok_of[c_at]]]
        kept = counted[w_tok]
        cell = np.concatenate([group_of[line_of[w_start[kept]]] * _BUCKETS + _bucket(w_hash[kept]), group_of[line_of[c_at]] * _BUCKETS + _bucket(low[c_at] + np.uint64(1))])
        self.h = np.bincount(cell, minlength=groups * _BUCKETS).reshape(groups, _BUCKETS)
        self.n = out
        if borders:
            c_all = np.flatnonzero(cjk)
            self.raw, self.t_line, self.t_start, self.t_end = raw, t_line, t_start, t_end
            self.words, self.ideographs = (w_tok, w_start, w_end, w_hash), (tok_of[c_all], low[c_all] + np.uint64(1))


def _word(length: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """RAW row and histogram of one word."""
    raw, hist, a = np.zeros(len(RAW), dtype=np.int64), np.zeros(_BUCKETS, dtype=np.int64), np.array([h], dtype=np.uint64)
    raw[R["words"]], raw[R["word_chars"]], raw[R["common"]] = 1, length, _is_common(a)[0]
    hist[_bucket(a)[0]] = 1
    return raw, hist


class Token:
    """An open token: a run without blanks of which more may follow or have gone before. Of fixed size, however long it is.

    raw and h leave out the words touching its ends; those are kept as length and hash, which grow by what is joined on.
    """

    __slots__ = ("raw", "h", "head", "ends", "left", "right", "one")

    @staticmethod
    def of(c: Counted, i: int, s: str) -> Token:
        """The i-th token ``s`` of what was counted."""
        t = Token()
        w_tok, w_start, w_end, w_hash = c.words
        c_tok, c_hash = c.ideographs
        w, z = slice(*np.searchsorted(w_tok, [i, i + 1])), slice(*np.searchsorted(c_tok, [i, i + 1]))
        t.raw, t.h = c.raw[i].copy(), np.bincount(_bucket(np.concatenate([w_hash[w], c_hash[z]])), minlength=_BUCKETS)
        t.head, t.ends = s[:9], (s[0], s[-1])
        begin, size, hashes = w_start[w] - c.t_start[i], w_end[w] - w_start[w], w_hash[w]
        t.left = t.right = None  # (length, hash) of the words at the ends
        t.one = False
        if len(begin) and begin[0] == 0:
            t.left = (int(size[0]), int(hashes[0]))
            t.one = int(size[0]) == len(s)
        if len(begin) and begin[-1] + size[-1] == len(s) and not t.one:
            t.right = (int(size[-1]), int(hashes[-1]))
        t.raw[R["ascii"]] = np.count_nonzero(points(s) < 128)
        for x in (t.left, t.right):
            if x:
                raw, h = _word(*x)
                t.raw -= raw
                t.h = t.h - h
        return t

    def __add__(self, o: Token) -> Token:
        r = Token()
        size = int(self.raw[R["length"]])
        r.raw, r.h = self.raw + o.raw, self.h + o.h
        border = _border(self.ends[1], o.ends[0])
        r.raw[R["odd"]] += 2 * border["odd"]
        r.raw[R["marks"]] += border["marks"]
        shifted = lambda x: int(x) + size if x >= 0 else -1
        pick = lambda a, b: int(a) if a >= 0 else b
        r.raw[R["at_any"]] = pick(self.raw[R["at_any"]], shifted(o.raw[R["at_any"]]))
        r.raw[R["at"]] = pick(self.raw[R["at"]], shifted(o.raw[R["at_any"]]))
        crossing = size - 1 if border["dot"] else -1
        r.raw[R["dot"]] = max(shifted(o.raw[R["dot"]]), crossing, int(self.raw[R["dot"]]))
        r.head, r.ends = (self.head + o.head)[:9], (self.ends[0], o.ends[1])
        a, b = (self.left if self.one else self.right), o.left
        both = None
        if a and b:
            both = (a[0] + b[0], join_hashes(a[1], b[1], b[0]))
        middle = both or a or b
        r.one = self.one and o.one
        r.left, r.right = self.left, o.right
        if r.one:
            r.left, r.right, middle = middle, None, None
        elif self.one:
            r.left, r.right = middle, o.right
            middle = None
        elif o.one:
            r.right, middle = middle, None
        if middle:
            raw, h = _word(*middle)
            r.raw, r.h = r.raw + raw, r.h + h
        return r

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """What the token adds to the counts from "tokens" on, and its histogram, now that no more is to come."""
        raw, h = self.raw.copy(), self.h
        for w in (self.left, self.right):
            if w:
                more, hist = _word(*w)
                raw, h = raw + more, h + hist
        raw[R["url"]] = _URL.match(self.head) is not None
        raw[R["tag"]] = self.head[0] == "#" and len(self.head) > 1 and (_tables()[0][ord(self.head[1])] & _BITS["word"]) != 0
        add, counted = _decide(raw[None, :])
        return add[0], h if counted[0] else np.zeros_like(h)


class Part:
    """Counts of a run of characters inside one line, with the state at its borders: the open tokens, the blanks and the two outermost characters."""

    __slots__ = ("n", "h", "head", "last", "left", "right", "solid", "ends", "lead", "trail")

    def __init__(self) -> None:
        self.n, self.h = np.zeros(_N, dtype=np.int64), np.zeros(_BUCKETS, dtype=np.int64)
        self.head, self.last = "", ""  # first characters, last visible character
        self.left: Token | None = None  # tokens touching the borders; all of the run is the left one if solid
        self.right: Token | None = None
        self.solid = False
        self.ends = ("", "")  # two characters of each end
        self.lead, self.trail = (0, True), (0, True)  # blanks at the ends: how many, all of them spaces

    @staticmethod
    def of(c: Counted, line: int, s: str, h: np.ndarray) -> Part:
        """Of a counted line ``s``, which is not yet whole."""
        p, n = Part(), c.n[line]
        if not s:
            return p
        p.n, p.h, p.head, p.ends = n.copy(), h.copy(), s[:_HEAD], (s[:2], s[-2:])
        body = s.strip()
        at = s.index(body) if body else len(s)
        blanks = lambda x: (len(x), not x.strip(" "))
        p.lead, p.trail = blanks(s[:at]), blanks(s[at + len(body) :] if body else s)
        if body:
            p.last = body[-1]
            begin, end = np.searchsorted(c.t_line, [line, line + 1])
            size = c.t_end - c.t_start
            p.solid = bool(size[begin] == len(s))
            p.left = Token.of(c, begin, s[: size[begin]]) if not p.lead[0] else None
            if not p.solid and not p.trail[0]:
                p.right = Token.of(c, end - 1, s[-size[end - 1] :])
            for t in (p.left, p.right):
                if t:
                    add, hist = t.whole()
                    p.n[C["tokens"] :] -= add
                    p.h = p.h - hist
        return p

    def __add__(self, o: Part) -> Part:
        if not self.n[0] or not o.n[0]:
            return o if not self.n[0] else self
        r = Part()
        r.n, r.h = self.n + o.n, self.h + o.h
        a, b = self.ends[1], o.ends[0]
        near = _border(a, b)
        for name in ("stops", "delims", "hard"):
            r.n[C[name]] += near[name]
        r.head = (self.head + o.head)[:_HEAD] if self.n[0] < _HEAD else self.head
        r.ends = ((self.ends[0] + o.ends[0])[:2], (self.ends[1] + o.ends[1])[-2:])
        r.last = o.last or self.last
        blank = (self.trail[0] + o.lead[0], self.trail[1] and o.lead[1])
        r.lead = blank if not self.last else self.lead
        r.trail = blank if not o.last else o.trail
        if self.last and o.last and blank[0] >= 3 and blank[1]:
            r.n[C["gaps"]] += 1
        r.solid = self.solid and o.solid
        x, y = (self.left if self.solid else self.right), o.left
        middle = x + y if x and y else x or y
        r.left, r.right = self.left, o.right
        if r.solid:
            r.left, middle = middle, None
        elif self.solid:
            r.left, middle = middle, None
        elif o.solid:
            r.right, middle = middle, None
        if middle:
            add, hist = middle.whole()
            r.n[C["tokens"] :] += add
            r.h = r.h + hist
        return r

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts with the tokens at the borders."""
        n, h = self.n.copy(), self.h
        for t in (self.left, self.right):
            if t:
                add, hist = t.whole()
                n[C["tokens"] :] += add
                h = h + hist
        return n, h


def line_kinds(n: np.ndarray, head) -> np.ndarray:
    """Kind of each line by its counts and its first characters (``head`` of its number): an index into the names below.

    blank, listed, tabular, junk, link (nothing but one or two links) or prose. Words none of which is common make junk
    only where the letters themselves are no language's: more than one in eight closes a run of three consonants. So
    scripts and languages without a word list are prose.
    """
    c = lambda name: n[:, C[name]]
    solid, stops, whole = c("solid"), c("stops"), c("chars") <= _HEAD
    unstopped = stops == 0
    bullet, cells, pair = (np.zeros(len(n), dtype=bool) for _ in range(3))
    listable = (solid > 0) & (stops <= 1)
    celled = unstopped & (c("delims") > 0) & whole
    paired = unstopped & (c("colons") > 0) & whole
    for i in np.flatnonzero(listable | celled | paired):
        text = head(i).strip().lstrip("> ")
        bullet[i] = listable[i] and _BULLET.match(text) is not None
        cells[i] = celled[i] and _CELLS.match(text) is not None
        pair[i] = paired[i] and _PAIR.match(text) is not None
    rules = [
        (solid == 0, "blank"),
        ((c("pipes") >= 2) | (c("pipes") == 1) & unstopped & whole | (c("tabs") >= 1) & unstopped | (c("gaps") >= 1) & unstopped, "tabular"),
        ((c("marked") * 2 > solid) | (c("odd") * 8 > solid) & (solid > 8), "junk"),
        (bullet, "listed"),
        (unstopped & ((c("delims") >= 2) & (c("delims") * 3 >= c("tokens")) | cells), "tabular"),
        (pair, "listed"),
        ((c("long") * 2 > solid) | (c("links") >= 3) & (c("links") * 2 > c("tokens")), "junk"),
        ((c("links") > 0) & (c("links") == c("tokens")), "link"),
        ((c("letters") * 2 < solid) & (solid >= 12), "junk"),
        ((c("cjk") == 0) & (c("words") >= 6) & (c("common") * 16 < c("words")) & (c("hard") * 8 > c("word_chars")), "junk"),
        ((c("cjk") * 2 > solid) & (c("cjk") >= 16) & (c("kana") * 8 < c("cjk")) & (c("cjk_common") * 25 < c("cjk")), "junk"),
    ]
    return np.select([r for r, _ in rules], [LINE_KINDS.index(k) for _, k in rules], LINE_KINDS.index("prose"))


LINE_KINDS = ("blank", "listed", "tabular", "junk", "link", "prose")
_ENDINGS = np.array(sorted(map(ord, ".!?。！？…;:,；：，\"”’»)）」』")), dtype=np.uint32)


def _tally(n: np.ndarray, kind: np.ndarray, last: np.ndarray) -> np.ndarray:
    """KINDS of each line."""
    is_ = {k: kind == i for i, k in enumerate(LINE_KINDS)}
    out = np.zeros((len(n), len(KINDS)), dtype=np.int64)
    out[:, 0] = ~is_["blank"]
    out[:, 1], out[:, 2], out[:, 3], out[:, 5] = is_["listed"], is_["tabular"], is_["junk"], is_["prose"]
    out[:, 4], out[:, 6] = n[:, C["solid"]] * is_["junk"], n[:, C["solid"]] * is_["prose"]
    out[:, 7] = np.maximum(1, n[:, C["stops"]]) * is_["prose"]
    out[:, 8] = np.isin(last, _ENDINGS) & ~is_["blank"]
    return out


class State:
    """Partial counts of a run of text: whole lines counted by kind, with the cut lines at both ends."""

    __slots__ = ("n", "h", "k", "first", "rest")

    def __init__(self) -> None:
        self.n, self.h, self.k = np.zeros(_N, dtype=np.int64), np.zeros(_BUCKETS, dtype=np.int64), np.zeros(len(KINDS), dtype=np.int64)
        self.first: Part = Part()
        self.rest: Part | None = None  # None: no line break inside

    def _close(self, line: Part) -> None:
        n, h = line.whole()
        kind = line_kinds(n[None, :], lambda _: line.head)
        self.n, self.h = self.n + n, self.h + h
        self.k = self.k + _tally(n[None, :], kind, np.array([ord(line.last) if line.last else 0], dtype=np.uint32))[0]

    def __add__(self, o: State) -> State:
        r = State()
        r.n, r.h, r.k = self.n + o.n, self.h + o.h, self.k + o.k
        if self.rest is None:
            r.first, r.rest = self.first + o.first, o.rest
        else:
            r.first = self.first
            joined = self.rest + o.first
            if o.rest is None:
                r.rest = joined
            else:
                r._close(joined)
                r.rest = o.rest
        return r

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, word histogram and line kinds of the whole text."""
        r = State()
        r.n, r.h, r.k = self.n, self.h, self.k
        r._close(self.first)
        if self.rest is not None:
            r._close(self.rest)
        return r.n, r.h, r.k

    def pack(self) -> str:
        def plain(x):
            if isinstance(x, np.ndarray):
                return x.tolist()
            if isinstance(x, (Token, Part, State)):
                return {s: plain(getattr(x, s)) for s in x.__slots__}
            return x

        return json.dumps(plain(self))

    @staticmethod
    def unpack(text: str) -> State:
        def fill(x, d: dict):
            for s, v in d.items():
                if isinstance(v, dict):
                    v = fill(Token() if s in ("left", "right") else Part(), v)
                elif s in ("n", "h", "k", "raw"):
                    v = np.array(v, dtype=np.int64)
                elif isinstance(v, list):
                    v = tuple(v)
                setattr(x, s, v)
            return x

        return fill(State(), json.loads(text))


def states(chunks: list[str]) -> list[State]:
    """The state of each chunk, all chunks counted together."""
    sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    out: list[State] = []
    at = 0
    while at < len(chunks):  # bounded arrays, whatever the batch holds
        reach = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 18, side="right")) + at)
        out += _states(chunks[at:reach])
        at = reach
    return out


def _states(chunks: list[str]) -> list[State]:
    c = Counted(chunks, borders=True)
    inner = ~c.opening & ~c.closing
    head = lambda i: chunks[c.text_of[i]][c.start[i] : min(c.end[i], c.start[i] + _HEAD)]
    rows = np.flatnonzero(inner)
    kind = line_kinds(c.n[rows], lambda j: head(rows[j]))
    tally = _tally(c.n[rows], kind, c.last[rows])
    out = []
    begin, finish = np.flatnonzero(c.opening), np.flatnonzero(c.closing)
    lo, hi = np.searchsorted(c.text_of[rows], np.arange(len(chunks))), np.searchsorted(c.text_of[rows], np.arange(len(chunks)), side="right")
    for t, s in enumerate(chunks):
        st, a, z = State(), begin[t], finish[t]
        st.n, st.k, st.h = c.n[rows[lo[t] : hi[t]]].sum(axis=0), tally[lo[t] : hi[t]].sum(axis=0), c.h[3 * t + 1]
        st.first = Part.of(c, a, s[c.start[a] : c.end[a]], c.h[3 * t])
        if z != a:
            st.rest = Part.of(c, z, s[c.start[z] : c.end[z]], c.h[3 * t + 2])
        out.append(st)
    return out


def cut(text: str, size: int) -> list[str]:
    """The text in chunks of about ``size`` characters, never between the two characters of a line break."""
    at = [0]
    while at[-1] + size < len(text):
        p = at[-1] + size
        at.append(p + 1 if text[p - 1 : p + 1] == "\r\n" else p)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def merged(parts: list[State]) -> State:
    """Neighbouring states merged pairwise, level by level."""
    while len(parts) > 1:
        parts = [parts[k] + parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def tallies(texts: list[str], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, histograms and line kinds of whole texts: those of one chunk are counted together, the others by their chunks' states."""
    n, h, k = (np.zeros((len(texts), w), dtype=np.int64) for w in (_N, _BUCKETS, len(KINDS)))
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    at = 0
    sizes = np.cumsum([len(texts[i]) for i in short]) if short else np.empty(0)
    while at < len(short):
        before = sizes[at - 1] if at else 0
        reach = max(at + 1, int(np.searchsorted(sizes, before + (1 << 18), side="right")))
        group = [texts[i] for i in short[at:reach]]
        c = Counted(group)
        kind = line_kinds(c.n, lambda i: group[c.text_of[i]][c.start[i] : min(c.end[i], c.start[i] + _HEAD)])  # noqa: B023
        tally = _tally(c.n, kind, c.last)
        starts = np.searchsorted(c.text_of, np.arange(len(group)))
        rows = short[at:reach]
        n[rows], k[rows], h[rows] = np.add.reduceat(c.n, starts), np.add.reduceat(tally, starts), c.h
        at = reach
    long = [(i, cut(t, chunk)) for i, t in enumerate(texts) if len(t) > chunk]
    parts = iter(states([s for _, chunks in long for s in chunks]))
    for i, chunks in long:
        n[i], h[i], k[i] = merged([next(parts) for _ in chunks]).done()
    return n, h, k


STATS = (
    "n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines bigint, stopped_lines double, "
    "listed_lines double, tabular_lines double, junk_lines double, common_words double, distinct_share double, sentences bigint, prose boolean, kind string"
)


def outcomes(n: np.ndarray, h: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """Ratios and the rule's outcome from the counts of whole texts, a column for each of STATS.

    kind: blank, list, table, junk or prose. A text is not prose if at most three sentences of prose stand beside
    at least four listed or tabular lines, or beside junk of more characters; or if its words are next to all
    uncommon, or few repeated over and over.
    """
    c, t = {x: n[:, i] for x, i in C.items()}, {x: k[:, i] for i, x in enumerate(KINDS)}
    words = c["words"] + c["cjk"]
    lines, solid = np.maximum(1, t["lines"]), np.maximum(1, c["solid"])
    counted, distinct = h.sum(axis=1), (h > 0).sum(axis=1)
    known = c["common"] + c["cjk_common"]
    structured = t["listed"] + t["tabular"]
    listed = (structured >= 4) & (t["sentences"] <= 3) & (structured > t["sentences"])
    junk = (t["junk"] > 0) & (t["junk_chars"] >= 12) & ((t["sentences"] <= 3) & (t["junk_chars"] >= t["prose_chars"]) | (t["junk_chars"] >= 4 * t["prose_chars"]))
    repeated = (counted >= 12) & (distinct * 3 <= counted) & (distinct <= 16) & (known * 12 < words)
    kind = np.select([c["solid"] == 0, listed & (t["tabular"] > t["listed"]), listed, junk | repeated], ["blank", "table", "list", "junk"], "prose")
    share = lambda a, b: np.where(b > 0, np.round(a / np.maximum(b, 1), 6), np.nan)
    return [
        c["chars"], words, share(c["word_chars"], c["words"]), share(c["symbols"], solid), share(c["digits"], solid), t["lines"], share(t["stopped"], lines),
        share(t["listed"], lines), share(t["tabular"], lines), share(t["junk"], lines), share(known, words), share(distinct, counted), t["sentences"], kind == "prose", kind,
    ]


@lru_cache
def _stat_types() -> T.StructType:
    return T._parse_datatype_string(STATS)


def text_statistics(df: DataFrame, key: str, text: str, chunk: int = CHUNK, stretch: int = STRETCH, fan_in: int = FAN_IN) -> DataFrame:
    """Statistics of every text: key and the columns of STATS; one row per input row with a non-null text.

    A text above ``chunk`` characters is cut into chunks. Their partial counts are associative: cut words, tokens and
    lines are carried as boundary state of fixed size, whatever their length, and the chunks of one text merge in a
    tree. Texts above ``stretch`` characters are spread over the cluster, a stretch of chunks per row, and merge by
    ``fan_in`` per level of a tree of shuffles, so that neither the text nor its states meet in one task. Counts and
    outcome depend on neither parameter. Empty and blank texts are of kind blank; ratios of nothing are null.
    """
    stats = _stat_types()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)] + stats.fields)
    src = df.select(F.col(key), F.col(text).alias("__t")).filter(F.col("__t").isNotNull())

    def rows(keys: pa.Array, got: list[np.ndarray]) -> pa.RecordBatch:
        kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}
        return pa.RecordBatch.from_arrays([keys] + [pa.array(c, kinds[type(f.dataType)], from_pandas=True) for c, f in zip(got, stats.fields)], names=schema.names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            yield rows(b.column(0), outcomes(*tallies(b.column(1).to_pylist(), chunk)))

    one = src.filter(F.length("__t") <= stretch).mapInArrow(near, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for no, s in enumerate(cut(b.column(1)[i].as_py(), stretch)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([no], pa.int64()), pa.array([s])], names=["k", "u", "no", "s"])

    kd = df.schema[key].dataType
    head = [T.StructField("k", kd), T.StructField("u", T.StringType()), T.StructField("no", T.LongType())]
    long = src.filter(F.length("__t") > stretch).withColumn("u", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
    parts = long.mapInArrow(spread, T.StructType([*head, T.StructField("s", T.StringType())])).repartition(F.col("u"), F.col("no"))
    state_schema = T.StructType([*head, T.StructField("state", T.StringType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"k": p["k"], "u": p["u"], "no": p["no"], "state": [merged(states(cut(s, chunk))).pack() for s in p["s"]]})

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("no")
        return pd.DataFrame({"k": [p["k"].iloc[0]], "u": [p["u"].iloc[0]], "no": [p["no"].iloc[0] // fan_in], "state": [merged([State.unpack(x) for x in p["state"]]).pack()]})

    tree = parts.mapInPandas(count, state_schema)
    reach = stretch
    while reach < 2**31:  # the longest text there can be
        reach *= fan_in
        tree = tree.withColumn("g", F.floor(F.col("no") / fan_in)).groupBy("u", "g").applyInPandas(merge, state_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [State.unpack(x.as_py()).done() for x in b.column(1)]
            if got:
                yield rows(b.column(0), outcomes(*(np.stack(x) for x in zip(*got))))

    return one.unionByName(tree.select("k", "state").mapInArrow(finish, schema))
