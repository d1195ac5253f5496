"""Evaluation texts in a corpus: shared n-grams as seeds, then local alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.llm import codes
from vellora.session import checkpointed

_WORD = re.compile(r"[^\W_]+")
GRAM = 5
#: Size of the filter of the test items' grams, as a power of two: 2 MB of bits.
FILTER_BITS = 24
#: Bytes of words of the test items up to which they are broadcast.
MOST_BROADCAST = 32 << 20


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in folded case."""
    return _WORD.findall(text.casefold()) if text else []


def gram_hashes(ids: np.ndarray, n: int = GRAM) -> np.ndarray:
    """64-bit hash of each run of ``n`` word hashes."""
    ids = ids.view(np.uint64)
    if len(ids) < n:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _grams(df: DataFrame, key: str, text: str, bits: np.ndarray | None = None) -> DataFrame:
    """Rows with a gram (that passes the filter ``bits``, if given): key, words array<bigint>, hits array<struct<pos, gram>>."""
    hit = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("gram", T.LongType())]))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("hits", hit)])

    def some(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        hashes, at = codes.words(texts)
        g = gram_hashes(hashes)
        inside = np.repeat(np.arange(len(texts)), np.diff(at))  # the text of each word
        ok = inside[: len(g)] == inside[GRAM - 1 :][: len(g)] if len(g) else np.empty(0, dtype=bool)
        if bits is not None:
            place = g.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            ok &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        pos = np.flatnonzero(ok)
        row = inside[pos]
        rows, sizes = np.unique(row, return_counts=True)
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        length = at[rows + 1] - at[rows]
        kept = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(rows) else np.empty(0, dtype=np.int64)
        values = pa.StructArray.from_arrays([pa.array((pos - at[row]).astype(np.int32)), pa.array(g[pos])], names=["pos", "gram"])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.ListArray.from_arrays(offsets(length), pa.array(hashes[kept])), pa.ListArray.from_arrays(offsets(sizes), values)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                yield some(s.column(0), s.column(1).to_pylist())

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _filter(grams: DataFrame) -> np.ndarray:
    """One bit per hash value the grams take, in 2**FILTER_BITS bits: of that size however many grams there are."""
    rows = grams.select(F.expr(f"shiftrightunsigned(gram, {64 - FILTER_BITS}) AS place")).selectExpr("CAST(shiftright(place, 3) AS INT) AS at", "shiftleft(1, CAST(place & 7 AS INT)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bit"))
    t = rows.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    bits[t.column(0).to_numpy()] = t.column(1).to_numpy().astype(np.uint8)
    return bits


def _slices(column: str, size: int) -> Column:
    """An array in arrays of at most ``size`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / size).cast("int")), lambda k: F.slice(column, k * size + 1, size))


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """Smith-Waterman over words with linear gaps: best score, its end in a and in b, and the longest common run.

    One vectorised row per word of ``a``: gaps along the row are a running maximum of score plus distance.
    """
    if not len(a) or not len(b):
        return 0, 0, 0, 0
    if len(a) > len(b):  # a row per word of the shorter side
        score, j, i, longest = align(b, a, match, mismatch, gap)
        return score, i, j, longest
    step = np.arange(len(b) + 1, dtype=np.int32) * -gap
    row = np.zeros(len(b) + 1, dtype=np.int32)
    run = np.zeros(len(b) + 1, dtype=np.int32)
    best = (0, 0, 0)
    longest = 0
    for i, w in enumerate(a):
        same = b == w
        new = row + gap
        new[0] = 0
        np.maximum(new[1:], row[:-1] + np.where(same, np.int32(match), np.int32(mismatch)), out=new[1:])
        np.maximum(new, 0, out=new)
        new += step
        np.maximum.accumulate(new, out=new)
        new -= step
        row = new
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
        run[1:] = (run[:-1] + 1) * same
        longest = max(longest, int(run.max()))
    return *best, longest


def scores(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 16) -> np.ndarray:
    """The best score of ``align`` of many pairs of small word numbers (int16, all at least 0).

    Pairs of similar length run side by side. A step takes one anti-diagonal of all of them, so no place waits for its
    neighbour; shorter pairs are filled up with numbers that match nothing, where no score grows.
    """
    got = np.zeros(len(pairs), dtype=np.int64)
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    left = sorted((k for k, (a, _) in enumerate(short) if len(a)), key=lambda k: (len(short[k][0]) // 8, len(short[k][1])))
    while left:
        lanes = len(short[left[-1]][0])
        group = left[-max(1, cells // lanes) :]
        while len(group) > 1 and len(short[group[0]][0]) * 4 < lanes * 3:  # not too unlike
            group = group[-(len(group) // 2) :]
        del left[-len(group) :]
        lanes, width, size = max(len(short[k][0]) for k in group), max(len(short[k][1]) for k in group), len(group)
        kind = np.uint8 if lanes < 125 else np.uint16 if lanes < 32_000 else np.uint32  # of scores: at most 2 a word, 3 more on the way
        a = np.full((size, lanes), -1, dtype=np.int16)
        # the longer sides backwards, so that a diagonal is one stretch of them
        b = np.full((size, width + 2 * lanes), -2, dtype=np.int16)
        for r, k in enumerate(group):
            x, y = short[k]
            a[r, : len(x)] = x
            b[r, lanes + width - len(y) : lanes + width] = y[::-1]
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        before, last, new = (np.zeros((lanes + 1, size), dtype=kind) for _ in range(3))
        best, same, gain = np.zeros((lanes, size), dtype=kind), np.empty((lanes, size), dtype=bool), np.empty((lanes, size), dtype=kind)
        three, one = kind(3), kind(1)
        for d in range(lanes + width - 1):
            at = lanes + width - 1 - d
            np.equal(a, b[at : at + lanes], out=same)
            np.multiply(same.view(np.uint8), three, out=gain)
            gain += before[:-1]
            inner = new[1:]
            np.maximum(last[:-1], last[1:], out=inner)
            np.maximum(inner, gain, out=inner)
            np.maximum(inner, one, out=inner)
            inner -= one
            np.maximum(best, inner, out=best)
            before, last, new = last, new, before
        got[group] = best.max(axis=0)
    return got


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 15) -> list[tuple[int, int, int, int]]:
    """``align`` of many pairs of word numbers (all at least 0): pairs of similar length run side by side, a row of each at a time.

    Shorter pairs are filled up with numbers that match nothing, so no score or run grows there.
    """
    got: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(pairs)
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    left = sorted((k for k, (a, _) in enumerate(short) if len(a)), key=lambda k: (len(short[k][1]), len(short[k][0])))
    while left:
        width = len(short[left[-1]][1])
        group = left[-max(1, cells // (width + 1)) :]
        del left[-len(group) :]
        a = np.full((max(len(short[k][0]) for k in group), len(group)), -1, dtype=np.int32)
        b = np.full((len(group), width), -2, dtype=np.int32)
        for r, k in enumerate(group):
            a[: len(short[k][0]), r] = short[k][0]
            b[r, : len(short[k][1])] = short[k][1]
        step = np.arange(width + 1, dtype=np.int32)
        row = np.zeros((len(group), width + 1), dtype=np.int32)
        run = np.zeros_like(row)
        best, best_i, best_j, longest = (np.zeros(len(group), dtype=np.int32) for _ in range(4))
        every = np.arange(len(group))
        for i, w in enumerate(a):
            same = b == w[:, None]
            new = row - 1
            new[:, 0] = 0
            np.maximum(new[:, 1:], row[:, :-1] + (same * np.int32(3) - np.int32(1)), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new += step
            np.maximum.accumulate(new, axis=1, out=new)
            new -= step
            row = new
            top = row.argmax(axis=1)
            high = row[every, top]
            up = high > best
            best[up], best_i[up], best_j[up] = high[up], i + 1, top[up]
            run[:, 1:] = (run[:, :-1] + 1) * same
            np.maximum(longest, run.max(axis=1), out=longest)
        for r, k in enumerate(group):
            i, j = int(best_i[r]), int(best_j[r])
            got[k] = (int(best[r]), *((i, j) if len(pairs[k][0]) <= len(pairs[k][1]) else (j, i)), int(longest[r]))
    return got


def leaks(corpus: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, least_score: int = 24, least_share: float = 0.25) -> DataFrame:
    """Pairs of a corpus row and a test item that align with ``least_score`` or ``least_share`` at least.

    key, item_key, score (Smith-Waterman over words: match 2, mismatch and gap -1), share (score over the item's best
    possible score), doc_end and item_end (words up to the end of the best alignment), longest_run (most consecutive
    common words). A run of n common words scores 2n. A seed is any gram of five words the two share, whichever it is and
    however many rows hold it, so each pair has its rarest: an edit removes only the grams across it, and every copy is
    found that keeps five words in a row.

    One scan of the corpus keeps the rows with a gram that passes a filter of fixed size, whatever the number of items;
    an exact join on grams follows. Only the surroundings of seeds are aligned, not whole texts: seeds fall into tiles of
    at least four times the item's length, and a tile is aligned with three quarters of a tile on both sides, which no
    alignment through its seeds can exceed. A tile's words travel once for some 256 items. Scores on numbers of 15 bits
    come first; as they are never too low, only pairs that reach a bound by them are aligned in full. Null and empty
    texts have no words and no pairs, nor have items under five words; a repeated row gives its pair once. The words of
    the items are broadcast up to MOST_BROADCAST bytes, which is measured. The filter and the cut of lineage run jobs
    when this is called.
    """
    spark = corpus.sparkSession
    item = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text")).filter("item_key is not null and item_text is not null").distinct()
    bench = checkpointed(_grams(item, "item_key", "item_text").withColumn("item", F.monotonically_increasing_id()))
    total = bench.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words") * 8 + 64), F.lit(0)).alias("bytes")).first()
    wide = F.greatest(F.lit(512), F.pow(F.lit(2), F.ceil(F.log2(F.size("words") * 4))).cast("int"))
    grams = bench.select("item", wide.alias("wide"), F.explode(F.array_distinct("hits.gram")).alias("gram"))
    hits = checkpointed(_grams(corpus, key, text, _filter(grams)).withColumn("rid", F.monotonically_increasing_id()))
    found = hits.select("rid", F.inline("hits")).join(grams, "gram").select("rid", "item", "wide", F.floor(F.col("pos") / F.col("wide")).cast("int").alias("tile")).distinct()
    some = F.pmod(F.xxhash64("item"), F.lit(1 + total.n // 256)).alias("some")
    tiles = found.groupBy("rid", "wide", "tile", some).agg(F.collect_list("item").alias("items"))
    begin = F.greatest(F.lit(0), F.col("tile") * F.col("wide") - (F.col("wide") * 3 / 4).cast("int"))
    end = (F.col("tile") + 1) * F.col("wide") + (F.col("wide") * 3 / 4).cast("int")
    bands = tiles.join(hits.select("rid", "key", "words"), "rid").select("key", begin.alias("begin"), F.slice("words", begin + 1, end - begin).alias("words"), "items")
    sides = bench.select("item", F.col("key").alias("item_key"), F.col("words").alias("item_words"))
    if total.bytes <= MOST_BROADCAST:
        sides = F.broadcast(sides)
    # alignment costs far more than its rows are large: keep every core busy
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = bands.select("key", "begin", "words", F.explode(_slices("items", 16)).alias("items")).repartition(parts, "key", "begin", "items")
    both = both.withColumn("item", F.explode("items")).join(sides, "item").select("key", "item_key", "begin", "words", "item_words")
    schema = T.StructType([T.StructField("key", corpus.schema[key].dataType), T.StructField("item_key", items.schema[item_key].dataType)] + [T.StructField("score", T.IntegerType()), T.StructField("share", T.DoubleType())] + [T.StructField(c, T.IntegerType()) for c in ("doc_end", "item_end", "longest_run")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            exact, small = [], []
            for k in (3, 4):
                flat = b.column(k).flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(b.column(k).value_lengths().to_numpy(zero_copy_only=False))])
                low = (flat & 0x7FFF).astype(np.int16)
                exact.append([flat[i:j] for i, j in zip(at, at[1:])])
                small.append([low[i:j] for i, j in zip(at, at[1:])])
            best = 2 * np.fromiter(map(len, exact[1]), dtype=np.int64, count=b.num_rows)
            enough = lambda s, m: (s >= least_score) | (s >= least_share * m)
            rows = np.flatnonzero(enough(scores(list(zip(*small))), best))
            pairs = [(exact[0][k], exact[1][k]) for k in rows]
            number = np.unique(np.concatenate([x for p in pairs for x in p] or [np.empty(0, dtype=np.int64)]), return_inverse=True)[1].astype(np.int32)
            at = np.cumsum([0] + [len(x) for p in pairs for x in p])
            cols = np.array(align_many([(number[at[k] : at[k + 1]], number[at[k + 1] : at[k + 2]]) for k in range(0, 2 * len(pairs), 2)]), dtype=np.int32).reshape(-1, 4)
            sure = enough(cols[:, 0], best[rows])
            rows, cols = rows[sure], cols[sure]
            take = pa.array(rows)
            first = b.column(2).take(take).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(cols[:, 0]), pa.array(cols[:, 0] / best[rows]), pa.array((cols[:, 1] + first).astype(np.int32)), pa.array(cols[:, 2]), pa.array(cols[:, 3])], names=schema.names
            )

    top = F.max(F.struct("score", "share", "doc_end", "item_end")).alias("top")
    found = both.mapInArrow(run, schema).groupBy("key", "item_key").agg(top, F.max("longest_run").alias("longest_run"))
    return found.select(F.col("key").alias(key), F.col("item_key").alias(item_key), "top.*", "longest_run")
