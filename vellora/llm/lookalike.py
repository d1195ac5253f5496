"""One consistent form for text that looks the same, by DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and hyphens drawn like an ordinary one, and the ordinary one.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "ӏ": "l", "Ӏ": "I", "ѵ": "v", "Ѵ": "V", "ү": "y", "Ү": "Y", "ԍ": "G", "ԑ": "ɛ", "ԟ": "k",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϱ": "p", "ϰ": "k", "ϒ": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin, Cherokee and Lisu capitals
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Ս": "U", "Լ": "L", "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʏ": "y",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮩ": "V", "Ꮮ": "L",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # hyphens and dashes, quotation marks, other signs
    "‐": "-", "‑": "-", "﹣": "-", "－": "-", "−": "-", "⁃": "-", "˗": "-", "Ⲻ": "-", "–": "-", "‒": "-", "﹘": "-", "―": "—",
    "’": "'", "‘": "'", "‛": "'", "ʼ": "'", "ʹ": "'", "′": "'", "“": '"', "”": '"', "‟": '"', "″": '"', "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "·": "·", "‧": "·", "∙": "·", "⋅": "·",
}
#: Ranges of characters that leave no mark on the page.
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Kinds of compatibility form that are seen as something else than the ordinary character: raised, lowered, circled, turned, and fractions.
DISTINCT = ("<super>", "<sub>", "<circle>", "<vertical>", "<fraction>", "<noBreak>")
#: Blanks. A line break ends a paragraph on the page and is not one of them.
BLANKS = [(0x09, 0x09), (0x0B, 0x0C), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def _spans(cps: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(set(cps)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _class(spans: Iterable[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _within(spans: list[tuple[int, int]]) -> Iterator[str]:
    return (chr(c) for a, b in spans for c in range(a, b + 1))


def _fold(s: str) -> str:
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", s)))


@lru_cache
def folding() -> tuple[dict[str, str], dict[str, str]]:
    """Character to character, and joined character to characters: from the Unicode decompositions by rule.

    Every compatibility form is taken but those of DISTINCT and those that begin with a blank (spacing accents).
    """
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    blank, gone = {*_within(BLANKS)}, {*_within(INVISIBLE)}
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        if c in blank or c in gone or 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        kind = unicodedata.decomposition(c).split(" ")[0]
        compatible = unicodedata.normalize("NFKC", c)
        t = _fold(compatible if kind not in DISTINCT and compatible[:1] != " " else c)
        if t != unicodedata.normalize("NFC", c):
            (one if len(t) == 1 else many)[c] = t
    return one, many


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache
def form_sql() -> str:
    """The SQL of the consistent form of column ``t``; each step runs only on texts holding something it changes."""
    one, many = folding()
    inv, blank = _class(INVISIBLE), _class(BLANKS)
    composing = _class(_spans(cp for cp in range(0x300, 0x30000) if not 0xD800 <= cp < 0xE000 and (unicodedata.combining(chr(cp)) or unicodedata.category(chr(cp)) in ("Mn", "Mc") or 0x1160 <= cp < 0x1200 or unicodedata.normalize("NFC", chr(cp)) != chr(cp))))
    # a joined character stands in a text between its neighbours: split off, each is looked up
    table = "MAP {" + ", ".join(f"{_quote(c)}: {_quote(to)}" for c, to in many.items()) + "}"
    names = _class(_spans(map(ord, many)))
    joined = f"array_to_string(list_transform(regexp_extract_all(t, '{names}|[^{names[1:]}+'), lambda x: coalesce({table}[x], x)), '')"
    steps = [
        (inv, f"regexp_replace(t, '{inv}', '', 'g')"),
        (composing, "nfc_normalize(t)"),
        (names, joined),
        (_class(_spans(map(ord, one))), f"translate(t, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"),
        (composing, "nfc_normalize(t)"),
        (blank, f"regexp_replace(t, '{blank}', ' ', 'g')"),
    ]
    sql = "SELECT n, t FROM texts"
    for test, change in steps:
        sql = f"SELECT n, CASE WHEN regexp_matches(t, '{test}') THEN {change} ELSE t END AS t FROM ({sql})"
    return sql


def consistent(df: DataFrame, columns: dict[str, str], threads: int = 1, memory: str = "256MB") -> DataFrame:
    """Adds, for each ``source: name`` of ``columns``, the consistent form of the text column.

    Invisible characters are dropped, every blank is U+0020, canonical composition holds, and compatibility forms (wide,
    narrow, joined and presentation forms, mathematical letters, Roman numerals, units, radicals and compatibility
    ideographs), look-alike letters, hyphens, dashes of the same length, quotation marks and primes are the ordinary
    characters. What is seen as something else stays: raised, lowered, circled and turned characters, fractions. Case,
    accents, the number of blanks and line breaks stay; the form of a form is itself. Null stays null, empty stays
    empty. Whole texts are used; one DuckDB connection per partition works on one Arrow batch at a time.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.StringType()) for n in columns.values()])
    places = [df.columns.index(c) for c in columns]
    sql, names = form_sql(), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": threads, "memory_limit": memory, "preserve_insertion_order": True})
        try:
            for b in batches:
                new = []
                for k in places:
                    texts = pa.table({"n": pa.array(range(b.num_rows), pa.int64()), "t": b.column(k).cast(pa.string())})
                    con.register("texts", texts)
                    got = con.sql(f"SELECT t FROM ({sql}) ORDER BY n").to_arrow_table().column(0).combine_chunks()
                    con.unregister("texts")
                    new.append((got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(b.columns + new, names=names)
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def unmasked_quotes(items: DataFrame, blocks: DataFrame, key: str, scope: str, ref: str, quote: str, content: str, clean: Callable[[Column], Column]) -> DataFrame:
    """Keys of the items whose quote is found in its block only in the consistent form.

    Items meet the blocks of the same scope and (cleaned) reference; an item is out if any of its blocks holds the
    quote literally. Each side is brought to the form once, before the join; containment is tested inside the join's
    pipeline, so that no block text is copied per item. Null and blank quotes, null references and null contents give
    no row; repeated rows give one.
    """
    i = consistent(
        items.select(F.col(key).alias("k"), F.col(scope).alias("s"), clean(F.col(ref)).alias("r"), F.col(quote).alias("q"))
        .filter(F.col("q").rlike(r"(?U)\S") & F.col("s").isNotNull() & (F.col("r") != "")).distinct(),
        {"q": "qf"},
    ).filter(F.col("qf").rlike(r"(?U)\S"))
    b = consistent(
        blocks.select(F.col(scope).alias("s"), F.upper(F.col(ref)).alias("r"), F.col(content).alias("c")).filter(F.col("r").isNotNull() & F.col("s").isNotNull() & F.col("c").isNotNull()),
        {"c": "cf"},
    ).withColumn("cf", F.when(F.col("cf") != F.col("c"), F.col("cf")))
    literal = F.contains("c", "q")
    seen = F.contains(F.coalesce("cf", "c"), F.col("qf"))
    return (
        i.join(b.hint("merge"), ["s", "r"])  # both sides are texts: never sent to every executor
        .select("k", literal.alias("literal"), seen.alias("seen")).filter("literal or seen")
        .groupBy("k").agg(F.bool_or("literal").alias("literal"), F.bool_or("seen").alias("seen")).filter("seen and not literal").select(F.col("k").alias(key))
    )
