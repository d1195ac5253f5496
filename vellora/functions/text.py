"""Text functions as Columns: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size estimate's weights, factor and offset, and its character classes.
CJK_WEIGHT, JSON_WEIGHT, OTHER_WEIGHT, FACTOR, OFFSET = 0.75, 1.0, 0.4, 1.05, 2
CJK_CLASS = r"[一-龥]"
JSON_CLASS = r'[\[\]",{}]'


def trim_u(c: Column) -> Column:
    """Without outer blanks of any kind (Unicode white space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of blanks only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def estimate_tokens(c: Column) -> Column:
    """Token estimate of a text (P01): weighted counts times a factor, truncated, plus an offset; empty or null: 0."""
    cjk, js = F.regexp_count(c, F.lit(CJK_CLASS)), F.regexp_count(c, F.lit(JSON_CLASS))
    other = F.length(c) - cjk - js
    w = cjk * F.lit(CJK_WEIGHT) + js * F.lit(JSON_WEIGHT) + other * F.lit(OTHER_WEIGHT)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(F.floor(w * F.lit(FACTOR)) + F.lit(OFFSET))


# ---- cleaning and limits -------------------------------------------------------------------------------------------

HEADING_LIMIT = 200


def sanitize_xml(c: Column) -> Column:
    """Without the control characters XML 1.0 forbids; tab and line ends stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate_heading(c: Column, limit: int = HEADING_LIMIT) -> Column:
    """Headings above the limit cut to it, ending in three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def checked_heading(c: Column, limit: int = HEADING_LIMIT) -> Column:
    """The heading, or an error where it is above the limit."""
    return F.when(F.length(c) > limit, F.raise_error(F.concat(F.lit(f"heading above {limit} characters: "), F.substring(c, 1, 60)))).otherwise(c)


def first_id(ids: Column) -> Column:
    """First non-null id of a two-level array; null if none."""
    return F.get(F.array_compact(F.flatten(F.filter(ids, lambda x: x.isNotNull()))), F.lit(0))


def last_id(ids: Column) -> Column:
    """Last non-null id of a two-level array; null if none."""
    return F.try_element_at(F.array_compact(F.flatten(F.filter(ids, lambda x: x.isNotNull()))), F.lit(-1))


def preview(c: Column, limit: int = 50) -> Column:
    """One line with single spaces, cut to the limit and three dots (P25)."""
    one = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\n\t]", " "), r"\r", ""), " {2,}", " "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def rtrim_lines(c: Column) -> Column:
    """Every line without trailing blanks."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), "\n")


def strip_before_newline(c: Column) -> Column:
    """Without blanks right before a line end, real or written as backslash n."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\r\n]+(?=\r?\n)", ""), r"(?U)[^\S\r\n]+(?=\\n)", "")


# ---- numbering -----------------------------------------------------------------------------------------------------

#: Prefixes that automatic numbering puts before a text, and lines that are nothing but such a prefix.
AUTO_NUMBER = r"^(?:\d+(?:[\.\d)）]+)\s+|[a-zA-Z][.)）]\s+|•\s*|[表图]\s*\d+\s*|注[:：]\s*)"
ONLY_NUMBER = r"^(?:\d+(?:\.\d+|[)）.])*|[a-zA-Z][.)）]|•|[表图]\s*\d+|注[:：]?)$"


def has_auto_number(c: Column) -> Column:
    return c.rlike("(?U)" + AUTO_NUMBER)


def strip_auto_number(c: Column) -> Column:
    """Without one automatic numbering prefix."""
    return F.regexp_replace(c, "(?U)" + AUTO_NUMBER, "")


def strip_auto_number_lines(c: Column) -> Column:
    """Every line without its prefix; lines of numbering only are emptied once a line of content came before.

    Lines are parted by line feeds, or by written backslash-n where there is no line feed; a single line is P16.
    """

    def by(sep: str, pattern: str) -> Column:
        def step(acc: Column, line: Column) -> Column:
            orphan = trim_u(line).rlike("(?U)" + ONLY_NUMBER) & acc["seen"]
            bare = F.when(orphan, F.lit("")).otherwise(strip_auto_number(line))
            content = ~is_blank(bare) & ~trim_u(bare).rlike("(?U)" + ONLY_NUMBER)
            return F.struct((acc["seen"] | (content & ~orphan)).alias("seen"), F.concat(acc["out"], F.array(bare)).alias("out"))

        start = F.struct(F.lit(False).alias("seen"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.split(c, pattern), start, step, lambda a: F.array_join(a["out"], sep))

    return F.when(F.contains(c, F.lit("\n")), by("\n", "\n")).when(F.contains(c, F.lit("\\n")), by("\\n", r"\\n")).otherwise(strip_auto_number(c))


def numbering_variants(c: Column) -> Column:
    """Search texts with numbering stripped, as array<struct<text, mode>> without repeats."""
    prefix, lines = strip_auto_number(c), strip_auto_number_lines(c)
    v = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("mode"))
    return F.array_compact(F.array(F.when(prefix != c, v(prefix, "prefix")), F.when((lines != c) & (lines != prefix), v(lines, "lines"))))


#: Digits of the number formats.
_CN, _STEMS = "零一二三四五六七八九", "甲乙丙丁戊己庚辛壬癸"
_ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def _pick(words: tuple[str, ...] | str, at: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), at.cast("int"))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers as digits."""
    parts = [_pick(w, F.floor(n / 10 ** (3 - i)) % 10) for i, w in enumerate(_ROMAN)]
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def chinese(n: Column) -> Column:
    """Chinese numeral of 1 to 99; other numbers as digits."""
    tens, ones = F.floor(n / 10), n % 10
    head = F.when(tens == 0, "").when(tens == 1, "十").otherwise(F.concat(_pick(_CN, tens), F.lit("十")))
    return F.when(n.between(1, 99), F.concat(head, F.when(ones == 0, "").otherwise(_pick(_CN, ones)))).otherwise(n.cast("string"))


def format_number(n: Column, fmt: Column) -> Column:
    """A counter in a number format; unknown formats are decimal."""
    letter = lambda base: F.chr(F.lit(base) + F.pmod(n - 1, F.lit(26)))
    return (
        F.when(fmt == "lowerLetter", letter(97)).when(fmt == "upperLetter", letter(65))
        .when(fmt == "lowerRoman", F.lower(roman(n))).when(fmt == "upperRoman", roman(n))
        .when(fmt == "chineseCountingThousand", chinese(n)).when(fmt == "ideographTraditional", _pick(_STEMS, F.pmod(n - 1, F.lit(10))))
        .when(fmt == "bullet", "•").when(fmt == "none", "").otherwise(n.cast("string"))
    )


def format_label(text: Column, levels: Column, legal: Column) -> Column:
    """A label template with %1, %2 .. filled.

    ``levels``: array<struct<n bigint, fmt string>> from the outermost level to the label's own; with ``legal``, all
    but the last are decimal. Null counters leave their mark in place.
    """
    size = F.size(levels)
    numbered = F.transform(levels, lambda x, i: F.struct((i + 1).alias("i"), format_number(x["n"], F.when(legal & (i < size - 1), "decimal").otherwise(x["fmt"])).alias("s")))
    return F.aggregate(numbered, text, lambda acc, x: F.coalesce(F.replace(acc, F.concat(F.lit("%"), x["i"].cast("string")), x["s"]), acc))


# ---- markup and tables ---------------------------------------------------------------------------------------------


def strip_markup(c: Column) -> Column:
    """Without superscript and subscript tags."""
    return F.regexp_replace(c, "(?i)</?(?:sup|sub)>", "")


def longest_segment(c: Column) -> Column:
    """Longest text outside table tags, the first on ties; null without tags or text."""
    parts = F.filter(F.transform(F.split(c, "</?table>"), trim_u), lambda x: x != "")
    best = F.aggregate(parts, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))
    return F.when(c.rlike("</?table>"), best)


def matching_row(c: Column, marker: Column) -> Column:
    """First row of a run of JSON rows that holds the marker; null if none."""
    body = F.when(c.endswith('"]'), F.substring(c, F.lit(3), F.length(c) - 4)).otherwise(F.substring(c, F.lit(3), F.length(c)))
    hit = F.get(F.filter(F.split(body, r'"\], \["'), lambda x: F.contains(x, marker)), F.lit(0))
    return F.when(c.startswith('["'), F.concat(F.lit('["'), hit, F.lit('"]')))


def fix_table_json(c: Column) -> Column:
    """Without a doubled bracket at either end of quoted table rows (P20)."""
    head = F.when(c.startswith('[["'), F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    tail = F.when(head.endswith('"]]'), F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head)
    return F.when(c.startswith('["') | c.startswith('[["'), tail).otherwise(c)


def json_escape(c: Column) -> Column:
    """Text as it stands inside JSON quotes, other than ASCII kept."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":"|"\}$', "")


def json_unescape(c: Column) -> Column:
    """Text that stands inside JSON quotes as it reads (P23); null where it is cut inside an escape or otherwise no JSON."""
    return F.from_json(F.concat(F.lit('{"v":"'), c, F.lit('"}')), "v string")["v"]


def unescaped_offset(escaped: Column, at: Column) -> Column:
    """Place in the plain text of a place in its escaped form (P23); inside an escape, that of the escaped character.

    An escape has at most six characters, so the text up to one of the six places before can be read.
    """
    read = [F.length(json_unescape(F.substring(escaped, F.lit(1), at - k))) for k in range(6)]
    return F.coalesce(*[F.when(at - k >= 0, r) for k, r in enumerate(read)])


def in_order_once(values: Column) -> Column:
    """Elements of an array in order, each once, nulls left out."""
    return F.array_distinct(F.array_compact(values))


TABLE_CHECK_LIMIT = 8000


def table_over_limit(c: Column, limit: int = TABLE_CHECK_LIMIT) -> Column:
    """Whether a table's text is above the limit in the size estimate."""
    return F.coalesce(c.startswith("<table>") & (estimate_tokens(c) > limit), F.lit(False))


def quote_shape(c: Column) -> Column:
    """What a quote is (F09): table (a whole one, or tagged), rows (several JSON rows), row (one), text; null stays null."""
    return (
        F.when(c.isNull(), None).when(c.contains("<table>") | c.startswith('[["'), "table")
        .when(c.startswith('["') & c.rlike(r'"\], *\["'), "rows").when(c.startswith('["'), "row").otherwise("text")
    )


def json_row(cells: Column) -> Column:
    """An array of texts as a JSON list with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(cells, lambda x: F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), json_escape(x), F.lit('"')))), ", "), F.lit("]"))


def json_table(rows: Column) -> Column:
    """Rows of cells as JSON with a blank after each comma, as written into block contents."""
    return F.concat(F.lit("["), F.array_join(F.transform(rows, json_row), ", "), F.lit("]"))


_DRAWING = r"<drawing\b[^>]*?/?>"


def drawing_attribute(c: Column, name: str) -> Column:
    """One attribute of the first drawing placeholder in the text, entities resolved; null if absent."""
    v = F.regexp_extract(F.regexp_extract(c, _DRAWING, 0), rf'\b{name}="([^"]*)"', 1)
    for a, b in (("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.nullif(v, F.lit(""))


def normalize_drawings(c: Column) -> Column:
    """Drawing placeholders reduced to id and name, the part that survives in the document."""
    return F.regexp_replace(c, r'<drawing\b[^>]*?\bid="([^"]*)"[^>]*?\bname="([^"]*)"[^>]*?/?>', r'<drawing id="$1" name="$2" />')


def image_format(c: Column) -> Column:
    """Image format of a content type, extension or name."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(trim_u(c)), "^image/", ""), r"^x-", ""), r"\+xml$", "")
    s = F.regexp_replace(s, r"^\.", "")
    return F.when(s == "jpg", "jpeg").otherwise(s)


# ---- comments, authors, prompts ------------------------------------------------------------------------------------


def comment_text(reason: Column, where: Column, suggest: Column, fallback: Column | None = None) -> Column:
    """The comment of an item that could not be applied."""
    e = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(F.lit("{WHY}"), e(reason), F.lit(" {WHERE}"), e(where), F.lit(" {SUGGEST}"), e(suggest))
    return body if fallback is None else F.when(e(fallback) != "", F.concat(F.lit("[FALLBACK]"), fallback, F.lit("\n"), body)).otherwise(body)


def manual_comment(reason: Column, suggest: Column, fallback: Column | None = None) -> Column:
    """The comment of a manual item."""
    e = lambda c: F.coalesce(c, F.lit(""))
    head = e(reason) if fallback is None else F.when(e(fallback) != "", F.concat(F.lit("[FALLBACK]"), fallback, F.lit("\n"), e(reason))).otherwise(e(reason))
    return F.when(e(suggest) != "", F.concat(head, F.lit("\nSuggestion: "), suggest)).otherwise(head)


def word_comment(c: Column, soft_break: str = "\u000b") -> Column:
    """Comment text for the comments part: of a fallback comment only the first line end is a soft break."""
    n = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    at = F.instr(n, "\n")
    split = F.concat(F.substring(n, F.lit(1), at - 1), F.lit(soft_break), F.replace(F.substring(n, at + 1, F.length(n)), F.lit("\n"), F.lit("\\n")))
    return F.when(n.startswith("[FALLBACK]") & (at > 0), split).otherwise(n)


def author(base: str, category: Column) -> Column:
    """Author of an item's changes: base and category."""
    return F.concat(F.lit(base + "-"), F.coalesce(F.nullif(trim_u(category), F.lit("")), F.lit("uncategorized")))


def status_summary(c: Column, limit: int = 48) -> Column:
    """First clause of a detail, on one line, cut to the limit."""
    one = trim_u(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    cut = F.when(F.contains(one, F.lit("; ")), trim_u(F.substring_index(one, "; ", 1))).when(F.contains(one, F.lit(". ")), trim_u(F.substring_index(one, ". ", 1))).otherwise(one)
    return F.when(F.length(cut) > limit, F.concat(F.regexp_replace(F.substring(cut, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(cut)


def _python_text(c: Column) -> Column:
    esc = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def block_prompt(heading: Column, parents: Column, table_header: Column, content: Column) -> Column:
    """A block as the auditor reads it: hierarchy, table header if any, content."""
    clean = lambda c, d: F.coalesce(F.nullif(trim_u(c), F.lit("")), F.lit(d))
    up = F.array_join(F.filter(F.transform(parents, trim_u), lambda x: x.isNotNull() & (x != "")), " → ")
    h = clean(heading, "Unknown")
    path = F.when(F.coalesce(up, F.lit("")) != "", F.concat(up, F.lit("  → "), h)).otherwise(h)
    rows = F.array_join(F.transform(table_header, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, _python_text), ", "), F.lit("]"))), ", ")
    header = F.when(F.coalesce(F.size(table_header), F.lit(0)) > 0, F.concat(F.lit("\nTable header context: ["), rows, F.lit("]"))).otherwise("")
    return F.concat(F.lit("Section hierarchy context: "), path, header, F.lit("\n\nContent:\n"), clean(content, ""))


def rule_prompt(rule_id: Column, description: Column, examples: Column) -> Column:
    """One block rule with its examples."""
    e = lambda c: F.coalesce(c, F.lit(""))

    def example(x: Column, i: Column) -> Column:
        v, k = e(x["violation"]), e(x["correction"])
        text = F.concat(
            F.lit("\n  - Example "), (i + 1).cast("string"), F.lit(":"),
            F.when(v != "", F.concat(F.lit("\n       ✗ violation: "), v)).otherwise(""), F.when(k != "", F.concat(F.lit("\n       ✓ correction: "), k)).otherwise(""),
        )
        return F.when((v != "") | (k != ""), text).otherwise("")

    return F.concat(F.lit("- ["), e(rule_id), F.lit("] "), e(description), F.coalesce(F.array_join(F.transform(examples, example), ""), F.lit("")))


def extracted_fields(raw: Column) -> Column:
    """Field definitions array<map> as array<struct<name, desc, evidence_desc>>, new and legacy shape."""
    e = lambda c: F.coalesce(trim_u(c), F.lit(""))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    made = lambda n, d, v: F.struct(n.alias("name"), d.alias("desc"), v.alias("evidence_desc"))

    def one(m: Column) -> Column:
        legacy = F.transform(F.filter(F.map_entries(m), lambda x: x["key"] != "evidence"), lambda x: made(e(x["key"]), e(x["value"]), e(get(m, "evidence"))))
        return F.when(F.array_contains(F.map_keys(m), "name"), F.array(made(e(get(m, "name")), e(get(m, "desc")), e(get(m, "evidence"))))).otherwise(legacy)

    return F.flatten(F.transform(F.filter(raw, lambda m: m.isNotNull()), one))


# ---- failures ------------------------------------------------------------------------------------------------------


def status_retryable(kind: Column, status: Column) -> Column:
    """Whether a call that failed with an error kind or HTTP status is worth another try."""
    return (
        F.when(kind.isin("AuthenticationError", "PermissionDeniedError", "BadRequestError", "NotFoundError"), False)
        .when(kind.isin("RateLimitError", "APIConnectionError", "InternalServerError"), True)
        .when(kind == "APIStatusError", F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False)))
        .otherwise(True)
    )


def message_retryable(message: Column) -> Column:
    """The same judged by the message alone (F08): the first refusal or quota sign decides, all else is retried."""
    m = F.lower(F.coalesce(message, F.lit("")))
    refused = (
        m.rlike("api[_ ]key|authenticat(?:ion|e)|forbidden|403") | (m.contains("permission") & m.contains("denied")) | (m.contains("invalid") & m.rlike("request|argument"))
        | (m.contains("400") & m.contains("bad request")) | (m.contains("model") & m.rlike("not found|not exist")) | m.contains("404") | m.contains("billing")
    )
    return ~refused


def not_found_reason(c: Column) -> Column:
    """Whether a reason says that the text was not found."""
    return F.coalesce(trim_u(c).rlike(r"^(?:NF_[CSM]:\s*)?violation text not found\([CSM]\)$"), F.lit(False))


def model_name(c: Column) -> Column:
    """Last part of a model path."""
    return F.regexp_extract(c, r"([^/]+)$", 1)


def is_reasoning_model(c: Column) -> Column:
    return F.coalesce(model_name(c).rlike("^(?:o1|o3|o4|gpt-5)"), F.lit(False))


# ---- display and linear equations ----------------------------------------------------------------------------------


def display_table(rows: Column, widest: int = 40) -> Column:
    """A table as lines of padded cells (P33): columns as wide as their widest cell up to the cap, 20 beyond the first row's."""
    cell = lambda c: F.coalesce(c, F.lit("None"))
    first = F.get(rows, F.lit(0))
    widths = F.transform(first, lambda _, i: F.least(F.lit(widest), F.array_max(F.transform(rows, lambda r: F.when(i < F.size(r), F.length(cell(F.get(r, i))))))))

    def line(r: Column, w: Column) -> Column:
        width = lambda i: F.coalesce(F.get(w, i), F.lit(20))
        return F.array_join(F.transform(r, lambda c, i: F.rpad(F.substring(cell(c), F.lit(1), width(i)), width(i), F.lit(" "))), " | ")

    # a list of one binds the widths, so that they are computed once per table
    shown = F.get(F.transform(F.array(widths), lambda w: F.array_join(F.transform(rows, lambda r: line(r, w)), "\n")), F.lit(0))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "(empty table)").otherwise(shown)


#: Repairs of linear equations, in order.
LINEAR_REPAIRS = [
    (r"\\degf", "&deg;F"), (r"\\degc", "&deg;C"), (r"(\\cbrt)(\w+)", r"\\sqrt[3]{$2}"), (r"(\\qdrt)(\w+)", r"\\sqrt[4]{$2}"), (r"\\sfrac", r"\\frac"), (r"(\\o[i]+nt)(\w+)", r"$1{$2}"), (r"\\bullet(\w+)", r"\\bullet $1"),
    *[(rf"\\{n}([a-zA-Z0-9]+)", rf"\\{n}{{$1}}") for n in ("sum", "prod", "amalg", "bigcup", "bigcap", "bigvee", "bigwedge", "lfloor", "lceil")],
    *[(rf"\\{n}\\below\{{(.+)\}}\{{(.+)\}}", rf"\\{n}_{{$1}}{{$2}}") for n in ("lim", "min", "max")],
]


def clean_linear(c: Column) -> Column:
    """A linear equation with its invalid commands repaired."""
    for pattern, to in LINEAR_REPAIRS:
        c = F.regexp_replace(c, "(?U)" + pattern, to)
    return c


def positive_int(value: str | None, default: int, name: str = "setting") -> int:
    """A configured whole number above zero, or the default where it is not set."""
    if value is None or not str(value).strip():
        return default
    if not str(value).strip().isdigit() or int(value) < 1:
        raise ValueError(f"{name} must be a whole number above zero, not {value!r}")
    return int(value)
