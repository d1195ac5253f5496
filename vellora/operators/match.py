"""Locating quotes: ranges of paragraphs, the search ladder, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellora.functions import tables as tb
from vellora.functions import text as tx
from vellora.operators.references import clean_ref
from vellora.session import checkpointed

BUCKET = 64
#: Places after an item's start that are searched at once; buckets of places for that; bytes of quotes broadcast for what lies beyond.
NEAR, NEAR_BUCKET, BROADCAST = 128, 32, 32_000_000


def ranges(items: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Items (a row each) with start_pos and end_pos (J09): item_id, doc_id, start_pos, end_pos, in_table.

    The start is the first paragraph with the item's uuid; items without one drop out. The end is, if the start stands
    in a table, the last paragraph with the end id, else the first at or after the start; an end that is not there
    means the end of the document (null).
    """
    p = paragraphs.select("doc_id", "pos", F.upper("para_id").alias("pid"), F.upper("para_id_end").alias("pend"), "is_table")
    i = items.select("item_id", "doc_id", clean_ref(F.col("uuid")).alias("u"), clean_ref(F.col("uuid_end")).alias("e"))
    starts = p.select("doc_id", F.col("pid").alias("u"), "pos", "is_table").groupBy("doc_id", "u").agg(F.min(F.struct("pos", "is_table")).alias("s"))
    start = i.join(starts, ["doc_id", "u"]).select("item_id", "doc_id", "e", F.col("s.pos").alias("start_pos"), F.col("s.is_table").alias("in_table"))
    ends = p.select("doc_id", F.explode(F.array_compact(F.array_distinct(F.array("pid", "pend")))).alias("e"), F.col("pos").alias("p"))
    there = F.when(F.col("p") >= F.col("start_pos"), F.col("p"))
    j = start.join(ends, ["doc_id", "e"], "left").groupBy("item_id", "doc_id", "start_pos", "in_table").agg(F.max(there).alias("last"), F.min(there).alias("first"))
    return j.select("item_id", "doc_id", "start_pos", F.when(F.col("in_table"), F.col("last")).otherwise(F.col("first")).alias("end_pos"), "in_table")


def paragraphs_in_range(located: DataFrame, paragraphs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of items and the paragraphs of their range (J09), as a range join on buckets of places.

    Both sides meet on (doc_id, bucket), so a document holding a third of all rows is spread over its buckets.
    """
    last = paragraphs.groupBy("doc_id").agg(F.max("pos").alias("last_pos"))
    i = located.join(last, "doc_id").withColumn("to", F.coalesce("end_pos", "last_pos")).filter("start_pos <= to")
    i = i.select("*", F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor(F.col("to") / bucket))).alias("_b")).drop("last_pos")
    p = paragraphs.withColumn("_b", F.floor(F.col("pos") / bucket))
    return i.join(p, ["doc_id", "_b"]).filter(F.col("pos").between(F.col("start_pos"), F.col("to"))).drop("_b", "to")


def tables_in_range(located: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Places of the tables an item's range touches."""
    t = paragraphs.filter("is_table").select("doc_id", "pos")
    return paragraphs_in_range(located, t).select("item_id", "doc_id", "pos").distinct()


#: Rungs of the ladder: rank, the form of the quote, the form of the text it is looked for in.
RUNGS = {1: ("q1", "t1"), 2: ("q2", "t2"), 3: ("q3", "t1"), 4: ("q4", "t1"), 7: ("q7", "t7")}


def quote_forms(q: Column) -> list[Column]:
    """Forms of a quote, once per item: as it is, without trailing blanks, without numbering (first, all lines), without tags."""
    none = lambda c: F.when((c != q) & (c != ""), c)
    return [F.nullif(q, F.lit("")).alias("q1"), F.nullif(tx.rtrim_lines(q), F.lit("")).alias("q2"), none(tx.strip_auto_number(q)).alias("q3"), none(tx.strip_auto_number_lines(q)).alias("q4"), F.nullif(tx.strip_markup(q), F.lit("")).alias("q7")]


def text_forms(t: Column) -> list[Column]:
    """Forms of a paragraph, once per paragraph; null where equal to the text itself."""
    other = lambda c: F.when(c != t, c)
    return [t.alias("t1"), other(tx.rtrim_lines(t)).alias("t2"), other(tx.strip_markup(t)).alias("t7")]


def _at(q: str, t: str) -> Column:
    return F.position(F.col(q), F.coalesce(F.col(t), F.col("t1")))


def ladder(upto: int = 9) -> Column:
    """(rank, offset) of the first rung that holds the quote, over columns q1.. and t1..; null if none.

    1 as it is; 2 lines without trailing blanks; 3 numbering prefix stripped; 4 numbering of all lines stripped;
    7 without superscript and subscript tags. Offsets count from 0 in the text the rung looks at. Rungs above ``upto``
    are left out.
    """
    return F.coalesce(*[F.when(_at(q, t) > 0, F.struct(F.lit(r).alias("rank"), (_at(q, t) - 1).alias("offset"))) for r, (q, t) in RUNGS.items() if r <= upto])


def holds(upto: int = 9) -> Column:
    """Whether any rung holds the quote; true exactly where ladder() is not null, but cheaper where none does."""
    rung = {r: F.contains(F.coalesce(F.col(t), F.col("t1")), F.col(q)) for r, (q, t) in RUNGS.items() if r <= upto}
    if 2 in rung:  # else the same search as the first
        rung[2] = (F.col("t2").isNotNull() | (F.col("q2") != F.col("q1"))) & rung[2]
    return F.coalesce(reduce(lambda a, b: a | b, rung.values()), F.lit(False))


#: What parts the words of a text.
_BETWEEN = r"[^\p{L}\p{N}\p{M}]+"


def inner_word(q: Column) -> Column:
    """The longest word of a quote that is whole for sure: neither the first nor the last of its line; null if there is none.

    What stands before and after it in the quote stands there in a text holding the quote, too, so it is a word of that text.
    """
    inner = F.flatten(F.transform(F.split(q, r"\n|\\n"), lambda line: _middle(F.split(line, _BETWEEN))))
    return F.array_max(F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]


def _middle(words: Column) -> Column:
    return F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))


def _met(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``forms`` (range and q1 .. q7) with the paragraphs of their range (doc_id, pos, t1 .. t7) that may hold them.

    Quotes meet paragraphs by an inner word within the document, so an item whose range is a whole document does not
    meet all of it; only quotes without such a word meet every paragraph, by the empty word. The quotes are broadcast
    and nothing is shuffled, so ``forms`` has to be small.
    """
    words = F.array_compact(F.array_distinct(F.array(inner_word(F.coalesce("q4", "q3", "q1")), inner_word(F.col("q7")))))
    keyed = forms.filter(F.col("q1").isNotNull()).withColumn("words", words)
    keyed = keyed.withColumn("word", F.explode(F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit(""))))).drop("words")
    every = F.array_union(F.array(F.lit("")), F.array_union(F.split("t1", _BETWEEN), F.split(F.coalesce("t7", "t1"), _BETWEEN)))
    met = texts.withColumn("word", F.explode(every)).join(F.broadcast(keyed), ["doc_id", "word"])
    return met.filter((F.col("pos") >= F.col("start_pos")) & (F.col("end_pos").isNull() | (F.col("pos") <= F.col("end_pos")))).drop("word")


def candidates(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id, pos) of quotes and the paragraphs of their range that may hold them; none that does is missing."""
    return _met(forms, texts).select("item_id", "doc_id", "pos").distinct()


def _best(upto: int) -> Column:
    """First rank, then first place, over rows of quotes and paragraphs."""
    hit = ladder(upto)
    return F.min(F.when(F.col("pos").isNotNull() & hit.isNotNull(), F.struct(hit["rank"].alias("rank"), F.col("pos"), hit["offset"].alias("offset")))).alias("m")


def _near(items: DataFrame, paragraphs: DataFrame, upto: int) -> DataFrame:
    """Items with m, the best place among the first NEAR places of their range; q is null where m is of rank 1 and all is done.

    Both sides meet on (doc_id, bucket), quotes and texts move once each, and what leaves the join is the hits.
    """
    parts = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda c: F.floor(c / NEAR_BUCKET)
    p = paragraphs.select("doc_id", "pos", "text", bucket(F.col("pos")).alias("_b")).repartition(parts, "doc_id", "_b").dropDuplicates(["doc_id", "_b", "pos"])
    p = p.select(F.col("doc_id").alias("_d"), F.col("_b").alias("_pb"), "pos", *text_forms(F.col("text")))
    to = F.least(F.col("end_pos"), F.col("start_pos") + (NEAR - 1))
    spread = F.when(F.col("q") != "", F.sequence(bucket(F.col("start_pos")), bucket(to)))
    i = items.select("*", to.alias("_to"), F.explode_outer(spread).alias("_b")).repartition(parts, "doc_id", "_b").select("*", *quote_forms(F.col("q")))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("_b") == F.col("_pb")) & F.col("pos").between(F.col("start_pos"), F.col("_to")) & holds(upto)
    rest = F.when(F.coalesce(ladder(upto)["rank"] > 1, F.lit(True)), F.col("q"))
    return i.join(p, on, "left").groupBy("item_id", "doc_id", "tagged", "action", "start_pos", "end_pos").agg(_best(upto), F.max(rest).alias("q"))


def _far(near: DataFrame, paragraphs: DataFrame, upto: int) -> DataFrame | None:
    """item_id and m for what _near() left without a place of rank 1 and whose range goes on; null if there is none such.

    Paragraphs of their documents are read once for every BROADCAST bytes of quotes.
    """
    beyond = F.col("start_pos") + NEAR
    left = near.filter((F.col("q") != "") & F.coalesce(F.col("m.rank") > 1, F.lit(True)) & F.col("start_pos").isNotNull() & (F.col("end_pos").isNull() | (F.col("end_pos") >= beyond)))
    left = left.select("item_id", "doc_id", beyond.alias("start_pos"), "end_pos", "q")
    size = left.agg(F.sum(6 * F.length("q") + 300)).first()[0]
    if not size:
        return None
    # what is looked for costs more than the bytes of the texts tell: as many tasks as the session has partitions
    parts = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, found = -(-size // BROADCAST), []
    for k in range(n):
        part = left.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        docs = part.groupBy("doc_id").agg(F.min("start_pos").alias("_from"))
        texts = paragraphs.select("doc_id", "pos", "text").join(F.broadcast(docs), "doc_id").filter(F.col("pos") >= F.col("_from")).drop("_from").repartition(parts, "doc_id", "pos").dropDuplicates(["doc_id", "pos"])
        met = _met(part.select("*", *quote_forms(F.col("q"))).drop("q"), texts.select("doc_id", "pos", *text_forms(F.col("text"))))
        found.append(checkpointed(met.filter(holds(upto)).groupBy("item_id").agg(_best(upto))))
    return F.broadcast(found[0]) if n == 1 else reduce(DataFrame.unionByName, found)


def table_cells(paragraphs: DataFrame) -> DataFrame:
    """Cells of table paragraphs (W10, F13): doc_id, pos, row, col, cell, at (place of its text within the table's own).

    Places count in the rows as JSON with a blank after each comma, without the outer brackets, as quotes of rows have it.
    """
    body = F.regexp_extract("text", r"(?s)^<table>(.*)</table>$", 1)
    t = paragraphs.filter("is_table").select("doc_id", "pos", F.from_json(body, "array<array<string>>").alias("rows")).filter("rows is not null")
    length = lambda r: F.length(tx.json_row(r))
    starts = F.aggregate("rows", F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + length(r) + 2)))
    rows = t.withColumn("starts", starts).select("doc_id", "pos", "starts", F.posexplode("rows").alias("row", "r")).filter("r is not null").select("doc_id", "pos", "row", "r", F.get("starts", F.col("row")).alias("start"))
    size = lambda c: F.when(c.isNull(), 4).otherwise(F.length(tx.json_escape(c)) + 2)
    before = F.aggregate("r", F.array(F.lit(1)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + size(c) + 2)))
    cells = rows.withColumn("before", before).select("doc_id", "pos", "row", "start", "before", F.posexplode("r").alias("col", "cell"))
    return cells.select("doc_id", "pos", "row", "col", "cell", (F.col("start") + F.get("before", F.col("col")) + F.when(F.col("cell").isNull(), 0).otherwise(1)).cast("int").alias("at"))


def _in_tables(left: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Ranks 6, 8 and 9 of the items in ``left`` (range and q1 ..): item_id, m. Only items and tables of one range meet."""
    tables = paragraphs.filter("is_table").select("doc_id", "pos", "text")
    span = ["item_id", "doc_id", "start_pos", "end_pos"]
    place = lambda quote, text, rank: F.when(F.position(F.col(quote), F.col(text)) > 0, F.struct(F.lit(rank).alias("rank"), F.col("pos"), (F.position(F.col(quote), F.col(text)) - 1).alias("offset")))
    body = F.regexp_extract("text", r"(?s)^<table>\[(.*)\]</table>$", 1)
    rows = left.filter(F.col("q1").startswith('["') | F.col("q1").startswith('[["')).select(*span, tb.strip_row_numbers(tx.fix_table_json(F.col("q1")), F.lit(True)).alias("q"))
    json = paragraphs_in_range(rows, tables.select("doc_id", "pos", tb.strip_row_numbers(body, F.lit(True)).alias("t"))).withColumn("m", place("q", "t", 6))
    # a quote that reads the same inside JSON would have been found in the table's paragraph
    odd = left.filter(tx.json_escape(F.col("q1")) != F.col("q1")).select(*span, "q1", "q3", "q4")
    cells = table_cells(paragraphs).filter("cell is not null").select("doc_id", "pos", "cell")
    raw = paragraphs_in_range(odd, cells).withColumn("m", F.coalesce(*[place(k, "cell", 8) for k in ("q1", "q3", "q4")]))
    part = F.array_max(F.transform(F.split("q1", r'</?table>|\n|"\], *\["|", "|^\[+"|"\]+$'), lambda x: F.struct(F.length(tx.trim_u(x)).alias("n"), tx.trim_u(x).alias("x"))))["x"]
    parts = left.select(*span, "q1", part.alias("q")).filter("q <> '' and q <> q1 and length(q) >= 8").drop("q1")
    crossed = paragraphs_in_range(parts, cells).withColumn("m", place("q", "cell", 9))
    text = paragraphs_in_range(parts, paragraphs.filter("not is_table").select("doc_id", "pos", "text")).withColumn("m", place("q", "text", 9))
    every = [x.filter("m is not null").select("item_id", "m") for x in (json, raw, crossed, text)]
    return reduce(DataFrame.unionByName, every).groupBy("item_id").agg(F.min("m").alias("m"))


def locate(items: DataFrame, paragraphs: DataFrame, quote: str = "violation_text", upto: int = 9) -> DataFrame:
    """Where each item's quote is (M01-M03, L05): item_id, doc_id, status, rank, pos, offset.

    First single paragraphs (ladder()), then, for what is in none, rank 5 the range joined by line feeds, 6 table rows
    without row numbers on either side, 8 single cells as they read, 9 the longest part of a quote that runs over the
    borders of cells, rows or table and text. A quote with a table tag is looked for by its longest text outside of
    tables (rank 0), and its item falls back to a comment if it is to be replaced or deleted. The rest is not_found, or
    no_anchor where the start paragraph is missing. The first rank, then the first place wins; with ``upto``, no search of
    a later rank is made. Most quotes stand at the start of their range, so that is searched first and the rest of a long
    range only for what is not there as it reads. Items without ``fix_action`` are manual. Of ``paragraphs`` repeated at
    a place one counts.
    """
    action = F.coalesce("fix_action", F.lit("manual")) if "fix_action" in items.columns else F.lit("manual")
    i = items.select("item_id", "doc_id", "uuid", "uuid_end", F.col(quote).alias("own"), action.alias("action")).dropDuplicates(["item_id"])
    tagged = F.coalesce(F.contains("own", F.lit("<table>")), F.lit(False))
    i = i.withColumn("tagged", tagged).withColumn("q", F.when(tagged, tx.longest_segment(F.col("own"))).otherwise(F.col("own")))
    r = ranges(i, paragraphs.select("doc_id", "pos", "para_id", "para_id_end", "is_table").dropDuplicates(["doc_id", "pos"]))
    placed = i.select("item_id", "doc_id", "tagged", "action", "q").join(r.select("item_id", "start_pos", "end_pos"), "item_id", "left")
    near = checkpointed(_near(placed, paragraphs, upto))
    far = _far(near, paragraphs, upto)
    best = near if far is None else near.join(far.withColumnRenamed("m", "_far"), "item_id", "left").withColumn("m", F.least("m", "_far")).drop("_far")
    if upto >= 5:
        best = _in_several(best, paragraphs, upto)
    status = F.when(F.col("start_pos").isNull(), "no_anchor").when(F.col("tagged") & (F.col("action") != "manual"), "fallback").when(F.col("m").isNotNull(), "found").otherwise("not_found")
    return best.select("item_id", "doc_id", status.alias("status"), F.when(F.col("m").isNotNull() & F.col("tagged"), 0).otherwise(F.col("m.rank")).alias("rank"), "m.pos", "m.offset")


def _in_several(best: DataFrame, paragraphs: DataFrame, upto: int) -> DataFrame:
    """``best`` with m of ranks 5, 6, 8 and 9 for the items in no single paragraph."""
    left = best.filter(F.col("start_pos").isNotNull() & (F.col("q") != "") & F.col("m").isNull())
    # quotes of one line without anything of a table have no further place: the searches for others are planned only where there are others
    lines, marks = F.contains(F.col("q"), F.lit("\n")), F.col("q").rlike(r'["\\\t\n]|</?table>')
    there = left.agg(F.bool_or(lines).alias("lines"), F.bool_or(marks).alias("marks")).first()
    if not (there.lines or there.marks):
        return best
    once = paragraphs.select("doc_id", "pos", "text", "is_table").dropDuplicates(["doc_id", "pos"])
    left = checkpointed(left.filter(lines | marks).select("item_id", "doc_id", "start_pos", "end_pos", *quote_forms(F.col("q"))))
    found = []
    if there.lines:
        wide = paragraphs_in_range(left.filter(F.contains(F.col("q1"), F.lit("\n"))).select("item_id", "doc_id", "start_pos", "end_pos", "q1"), once.select("doc_id", "pos", "text"))
        joined = wide.groupBy("item_id", "q1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"), F.min("pos").alias("pos"))
        found.append(joined.filter(F.position(F.col("q1"), F.col("t")) > 0).select("item_id", F.struct(F.lit(5).alias("rank"), "pos", (F.position(F.col("q1"), F.col("t")) - 1).alias("offset")).alias("m")))
    if there.marks and upto > 5:
        found.append(_in_tables(left, once))
    more = reduce(DataFrame.unionByName, found).groupBy("item_id").agg(F.min("m").alias("_more"))
    return best.join(more, "item_id", "left").withColumn("m", F.coalesce("m", "_more")).drop("_more")


def original_offset(text: Column, at: Column) -> Column:
    """Place in a text of a place in the same text without trailing blanks of its lines (M02): the way back from rank 2."""
    blanks = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(x, r"(?U)\s+\z", "")).alias("kept"), F.length(x).alias("all")))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("all"), F.lit(None).cast("int").alias("hit"))

    def step(acc: Column, line: Column) -> Column:
        inside = acc["hit"].isNull() & (at <= acc["kept"] + line["kept"])
        hit = F.when(acc["hit"].isNotNull(), acc["hit"]).when(inside, (acc["all"] + at - acc["kept"]).cast("int"))
        return F.struct((acc["kept"] + line["kept"] + 1).alias("kept"), (acc["all"] + line["all"] + 1).alias("all"), hit.alias("hit"))

    return F.aggregate(blanks, start, step, lambda acc: acc["hit"])


def real_runs(runs: DataFrame, flags: tuple[str, ...] = ("is_drawing", "is_equation")) -> DataFrame:
    """Runs of the document's own text (F06): those that only stand for a drawing or an equation are left out."""
    made_up = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return runs.filter(~made_up)


def overlapping(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Runs that a match touches (J11): runs (doc_id, para, run_no, start_off, end_off), matches (doc_id, para, m_start, m_end)."""
    return matches.join(runs, ["doc_id", "para"]).filter("end_off > m_start and start_off < m_end").withColumns(
        {"from_off": F.greatest("start_off", "m_start"), "to_off": F.least("end_off", "m_end")}
    )


def revised_overlap(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches that touch a run inside an earlier insertion or deletion."""
    return matches.join(
        overlapping(runs.filter("revision is not null"), matches).select("doc_id", "para", "m_start", "m_end").distinct(), ["doc_id", "para", "m_start", "m_end"], "left_semi"
    )


def paragraph_segments(runs: DataFrame) -> DataFrame:
    """Runs grouped by paragraph and cell (A10): first and last offset, number of runs."""
    return runs.groupBy("doc_id", "para", "cell").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.count("*").alias("n_runs"))
