"""Filling containers of fixed capacity, with the sources mixed in target proportions."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.session import checkpointed

#: Place of a vocabulary file of byte-pair ranks; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern for splitting a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def encoder(vocabulary: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replaces the text by its number of tokens (null and empty: 0); whole texts, special tokens are ordinary text."""
    kept = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def pack_partition(
    sizes: np.ndarray, source: np.ndarray, share: dict[str, float], carry: dict[str, float], capacity: int, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Container and window of each item (sizes at most capacity) by deficit round-robin and best fit.

    Each window adds ``share`` of its token budget to every source's deficit and takes items from the source's queue
    while they fit the deficit; what a source could not take or took too much stays in its deficit, as ``carry`` does
    from the partitions before. The items of a window go, largest first, to the fullest container they fit; containers
    that are not nearly full stay open for the next windows.
    """
    n = len(sizes)
    place, drawn = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    turn = 0
    names = sorted(share)
    queue = {s: np.flatnonzero(source == s) for s in names}
    head = dict.fromkeys(names, 0)
    deficit = {s: float(carry.get(s, 0.0)) for s in names}
    budget = float(window * capacity)
    left = n
    room: list[tuple[int, int]] = []  # (free tokens, container), sorted
    made = 0
    small = max(1, capacity // 128)
    while left:
        taken: list[int] = []
        live = [s for s in names if head[s] < len(queue[s])]
        got = 0.0
        for s in names:
            deficit[s] += share[s] * budget
        # sources whose queue is empty leave their share to the others for this window only
        while live and got < budget:
            moved = False
            for s in live:
                q, h = queue[s], head[s]
                while h < len(q) and sizes[q[h]] <= deficit[s]:
                    deficit[s] -= sizes[q[h]]
                    got += sizes[q[h]]
                    taken.append(int(q[h]))
                    h += 1
                    moved = True
                head[s] = h
            live = [s for s in live if head[s] < len(queue[s])]
            if not moved:
                if got >= budget / 2:
                    break
                if live:  # nothing fits its deficit yet: the live sources advance in their proportions
                    total = sum(share[s] for s in live)
                    for s in live:
                        deficit[s] += (share[s] / total if total else 1 / len(live)) * budget / 8
        drawn[taken] = turn
        turn += 1
        taken.sort(key=lambda i: (-sizes[i], i))
        left -= len(taken)
        for i in taken:
            z = int(sizes[i])
            k = bisect.bisect_left(room, (z, -1))
            if k == len(room):
                free, c = capacity, made
                made += 1
            else:
                free, c = room.pop(k)
            place[i] = c
            bisect.insort(room, (free - z, c))
        if len(room) > 4 * window:  # the fullest can hardly take more
            room = [x for x in room if x[0] >= small][-4 * window :]
    return place, drawn


def pack(
    df: DataFrame, key: str, text: str, source: str, capacity: int = 2048, window: int = 64, rows_per_part: int = 100_000, mix: dict[str, float] | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Assigns every text to containers: key, source, piece, token_from, n_tokens, window, container.

    An item above the capacity is cut into full containers and a rest, which is packed like any other item; no other
    item is divided. ``container`` is unique over the whole result, ``window`` too. What is mixed in the target
    proportions is the window, that is what ``window`` containers hold together, not each container: best fit puts the
    largest items together. Full containers of cut items are of no window. ``mix`` gives the target share of tokens per
    source (null is the source ""; sources left out get a share of zero and are packed last); without it, the shares
    of the corpus. Items are spread over partitions of about ``rows_per_part`` rows by a hash of key, source and text,
    which also gives their order, so that the same rows are packed alike however their files are laid out, and a source
    holding most rows is in all partitions; a partition starts with the deficits left by those before it, known from the
    token totals per partition and source. Null and empty texts have size 0 and share a container; repeated rows are
    items of their own. The token sizes are written once when this is called, which runs a job.
    """
    d = df.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(source).cast("string"), F.col(text)).alias("id"))
    counted = checkpointed(token_counts(d, "t", vocabulary=vocabulary))
    parts = max(1, -(-counted.count() // rows_per_part))  # of sizes already written
    sized = counted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    cut = F.col("n_tokens") > capacity
    full = F.when(cut, F.floor(F.col("n_tokens") / capacity)).otherwise(F.lit(0))
    items = sized.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * capacity)
    # repeated rows have one id: numbered where they are cut
    copies = items.filter("full > 0").groupBy("k", "src", "id", "full").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    whole = copies.select("k", "src", "id", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece")).select(
        "k", "src", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("token_from"), F.lit(capacity).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("window"),
        F.concat_ws("-", F.lit("f"), "id", "copy", "piece").alias("container"),
    )
    rest = items.filter("full = 0 or rest > 0")
    totals = rest.groupBy("part", "src").agg(F.sum("rest").alias("n"))
    share = totals.groupBy("src").agg(F.sum("n").alias("m"))
    if mix is None:
        share = share.select("src", (F.col("m") / F.greatest(F.sum("m").over(Window.partitionBy()), F.lit(1))).alias("share"))
    else:
        total = sum(mix.values())
        given = F.create_map(*[F.lit(x) for kv in mix.items() for x in (kv[0], kv[1] / total)]) if mix else F.create_map().cast("map<string,double>")
        share = share.select("src", F.coalesce(F.try_element_at(given, F.col("src")), F.lit(0.0)).alias("share"))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per 100 000 items, and one per source beside it
    so_far = totals.groupBy("part").agg(F.sum("n").alias("all")).withColumn("all_before", F.coalesce(F.sum("all").over(earlier()), F.lit(0)))
    carry = (
        totals.withColumn("src_before", F.coalesce(F.sum("n").over(earlier("src")), F.lit(0))).join(so_far, "part").join(share, "src")
        .select(F.col("part").alias("p"), F.col("src").alias("s"), "share", (F.col("share") * F.col("all_before") - F.col("src_before")).alias("carry"))
    )
    schema = "k {}, src string, piece int, token_from bigint, n_tokens bigint, window string, container string".format(df.schema[key].dataType.simpleString())

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"k": a["k"], "src": a["src"], "piece": [], "token_from": [], "n_tokens": [], "window": [], "container": []})
        a = a.sort_values(["id", "src", "rest"], ignore_index=True)
        c, w = pack_partition(a["rest"].to_numpy(), a["src"].to_numpy(), dict(zip(b["s"], b["share"])), dict(zip(b["s"], b["carry"])), capacity, window)
        part = str(a["part"].iloc[0])
        return pd.DataFrame({"k": a["k"], "src": a["src"], "piece": a["full"].astype("int32"), "token_from": a["full"] * capacity, "n_tokens": a["rest"], "window": [f"{part}-{x}" for x in w], "container": [f"{part}-{x}" for x in c]})

    packed = rest.select("k", "src", "id", "part", "full", "rest").groupBy("part").cogroup(carry.groupBy("p")).applyInPandas(run, schema)
    return packed.unionByName(whole).withColumnRenamed("k", key).withColumnRenamed("src", source)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, tokens, the fullest container and the share of room left over."""
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (1 - F.sum("n") / (F.count("*") * capacity)).alias("left_over")
    )


def mix_report(packed: DataFrame, source: str) -> DataFrame:
    """Per source: its share of all tokens in windows, and how far its share of a window lies from it, on average and at most, over full windows.

    A window is full if it has at least half of the tokens of the largest; the last one of a partition is mostly not.
    Three totals over all windows are taken first, in a job.
    """
    per = packed.filter("window is not null").groupBy("window", source).agg(F.sum("n_tokens").alias("n"))
    window = per.groupBy("window").agg(F.sum("n").alias("all"))
    total = window.agg(F.coalesce(F.max("all"), F.lit(0)).alias("most"), F.coalesce(F.sum("all"), F.lit(0)).alias("tokens")).first()
    full = window.filter(F.col("all") * 2 >= total.most)
    n = full.count()
    share = per.groupBy(source).agg((F.sum("n") / max(1, total.tokens)).alias("share"))
    here = per.join(full, "window").join(share.withColumnRenamed(source, "s"), F.col(source) == F.col("s"))
    off = F.abs(F.col("n") / F.col("all") - F.col("share"))
    there = here.groupBy(source, "share").agg(F.count("*").alias("present"), F.sum(off).alias("sum"), F.max(off).alias("most"))
    # a source absent from a window is off by all of its share there
    missing = n - F.col("present")
    return there.select(
        source, "share", F.lit(n).alias("windows"), ((F.col("sum") + missing * F.col("share")) / max(1, n)).alias("mean_off"), F.when(missing > 0, F.greatest("most", "share")).otherwise(F.col("most")).alias("most_off")
    )
