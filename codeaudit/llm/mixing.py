"""Mixing sources to target weights, as fixed-length blocks drawn by index.

The words of a source are laid end to end and cut into blocks of `block` words;
what is left over is the source's short tail block.  A source's target is met in
passes over its blocks: whole passes first, then a part of one, whose last block
is cut so that the words taken equal the rounded target.  Slot i of a pass holds
the block at place i of that pass's pseudorandom permutation of the source's
block indices (the tail comes last).  Slots and documents meet in a join on
(source, block index).

Every output shard holds `shard_slots` slots, the last one what is left.  How many of
them come from each source is drawn shard by shard.  Independent multinomial draws
would leave the sources' totals to chance, so a draw takes from the slots that are
left: the counts of all shards are multivariate hypergeometric, which is the
multinomial law with the totals held.  They are drawn down a tree: of the slots of
a range of shards, so many of each source go to its first half.  Each range is
a row with a seed of its own, so ranges are drawn in parallel.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and
share `share` = 150 % of all words; a target stops at `most` = 2 times its
source's words, and the excess is shared again by weight among the others.  The
limit of that sharing is one level of words per weight, which is solved for.

Two passes at most touch a word, so no document exceeds 2 times its size.  All
draws are keyed by the seed, the source and the pass, or the range of shards, and
the order of a source's words by the rows' own content, so reruns agree, however
the rows are dealt out over files and tasks.

Defined results: a null text has no words; it takes part with size 0 and is never
taken.  A null source is a source.  Rows equal in id, source and text are one row
with a number of copies, each laid out and returned by itself.  An empty table
gives an empty result.  Other columns do not take part, whatever their names.  A
very long text is counted and cut whole by the task that reads it; its words lie
in as many blocks as they need.  The table of sources (one row each) is ranked in
one task; documents never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import WORD, join_checked, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK = 512
SHARD_SLOTS = 1 << 16
SEED = 42
# Copies of one row that one task makes, and the slots up to which numpy draws exactly.
COPIES, LARGE = 1 << 16, 10 ** 9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, sid, source_size, target for sizes(source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))) + 1))
    cap = F.col("source_size") * F.lit(most)
    # In the order in which sources fill up, the level that the rest would share if all before were full.
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.partitionBy(F.lit(0)).orderBy((cap / F.col("weight")).asc(), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level)
    # The level falls from the first source that does not fill up onwards; that source sets it for all.
    shared = F.max(F.when(cap / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("shared", shared).select(
        "source", F.col("sid").cast("int").alias("sid"), "source_size",
        F.least(cap.cast("double"), F.col("weight") * F.coalesce("shared", F.lit(float("inf")))).alias("target"))


def laid_out(sizes: DataFrame) -> DataFrame:
    """key, check, copy, doc_id, sid, size and `start`, the words of the same source that come before, for every copy of a row.

    Rows are ordered by a hash bucket, then by their marks.  Buckets number the
    square root of the rows, so neither a bucket nor the list of buckets of a hot
    source is long.
    """
    buckets = max(1, int(sizes.count() ** 0.5))
    rows = sizes.filter("size > 0").withColumn("bucket", F.pmod("key", F.lit(buckets))).withColumn("all", F.col("size") * F.col("copies"))
    totals = rows.groupBy("sid", "bucket").agg(F.sum("all").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_start")))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "check").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("all").over(inside), F.lit(0)))
    begin = F.col("bucket_start") + F.col("inside")
    return by_copy(join_checked(placed, starts, ["sid", "bucket"]).withColumn("begin", begin), sizes).select(
        "key", "check", "copy", "doc_id", "sid", "size", (F.col("begin") + F.col("copy") * F.col("size")).alias("start"))


def by_copy(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each copy of rows, which are those of sizes(copies), numbered from 0; very many copies are made by many tasks."""
    few = rows.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    if (sizes.agg(F.max("copies")).first()[0] or 0) <= COPIES:
        return few
    runs = rows.filter(F.col("copies") > COPIES).withColumn("run", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("key", "run")
    low = F.col("run") * COPIES
    many = runs.withColumn("copy", F.explode(F.sequence(low, F.least(low + COPIES, F.col("copies")) - 1))).drop("run")
    return few.unionByName(many)


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of every row that lies in each block: key, check, copy, doc_id, sid, block, begin (in the block), words, first_word."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("key", "check", "copy", "doc_id", "sid", "block", (begin - F.col("block") * block).alias("begin"),
                      (end - begin).alias("words"), (begin - F.col("start")).alias("first_word"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of range(size), element by element: a Feistel network that walks until it is inside."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        value, h, m = out[todo], half[todo], mask[todo]
        left, right = value >> h, value & m
        for r in range(rounds):
            mixed = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (mixed >> np.uint64(32))) & m
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _halved(low: int, high: int, counts: np.ndarray, shard_slots: int, total: int, seed: int) -> np.ndarray:
    """Of the slots (counts by source) of shards low to high - 1, those of each source in the first half of the shards."""
    left = min((low + high) // 2 * shard_slots, total) - low * shard_slots
    rng = np.random.default_rng([seed, low, high])
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        rest -= n
        if rest + n > LARGE:
            # Beyond what numpy draws exactly, the normal law differs by less than a slot in a million.
            share = left / (rest + n)
            drawn = round(rng.normal(n * share, (n * share * (1 - share) * rest / max(1, rest + n - 1)) ** 0.5))
            out[i] = min(max(drawn, left - rest, 0), n, left)
        else:
            out[i] = rng.hypergeometric(n, rest, left) if left and n else 0
        left -= int(out[i])
    return out


def draws(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, sid, first_slot, slots, source_size, wanted: how many slots of each source every shard holds."""
    wanted = F.round("target").cast("long")
    rest, per_pass = F.col("wanted") % F.col("source_size"), F.ceil(F.col("source_size") / block)
    passes = F.floor(F.col("wanted") / F.col("source_size"))
    asked = stored(targets.withColumn("wanted", wanted).filter("wanted > 0").select(
        "sid", "source_size", "wanted", (passes * per_pass + F.ceil(rest / block)).cast("long").alias("slots")))
    total = asked.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // shard_slots)
    tree = "low long, high long, sids array<int>, firsts array<long>, counts array<long>"

    def down(to: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                todo = [(r.low, r.high, np.array(r.sids, np.int32), np.array(r.firsts, np.int64), np.array(r.counts, np.int64))
                        for r in frame.itertuples()]
                while todo:
                    low, high, sids, firsts, counts = todo.pop()
                    if high - low <= to:
                        yield pd.DataFrame({"low": [low], "high": [high], "sids": [sids], "firsts": [firsts], "counts": [counts]})
                        continue
                    left = _halved(low, high, counts, shard_slots, total, seed)
                    for a, b, first, n in ((low, (low + high) // 2, firsts, left), ((low + high) // 2, high, firsts + left, counts - left)):
                        todo.append((a, b, sids[n > 0], first[n > 0], n[n > 0]))
        return run

    ordered = F.array_sort(F.collect_list(F.struct("sid", "slots")))
    root = asked.groupBy().agg(ordered.alias("s")).filter(F.size("s") > 0).select(
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.col("s.sid").alias("sids"),
        F.transform("s", lambda x: F.lit(0).cast("long")).alias("firsts"), F.col("s.slots").alias("counts"))
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upper = root.mapInPandas(down(max(1, shards // (4 * n))), tree)
    leaves = upper.repartition(n, "low").mapInPandas(down(1), tree).select("low", F.explode(F.arrays_zip("sids", "firsts", "counts")).alias("d"))
    drawn = leaves.select(F.col("low").alias("shard"), F.col("d.sids").alias("sid"), F.col("d.firsts").alias("first_slot"), F.col("d.counts").alias("slots"))
    return join_checked(drawn, asked.select("sid", "source_size", "wanted"), ["sid"])


def slots(drawn: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """shard, sid, slot, block, take: the block that each slot holds and the words it takes of it."""
    each = drawn.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard").select(
        "sid", "shard", "source_size", "wanted", F.explode(F.sequence(
            F.col("first_slot"), F.col("first_slot") + F.col("slots") - 1)).alias("slot"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size, wanted, slot = (f[c].to_numpy(np.int64) for c in ("source_size", "wanted", "slot"))
            sid = f["sid"].to_numpy(np.uint64)
            full, per_pass = size // block, -(-size // block)
            turn, place = slot // per_pass, slot % per_pass
            key = (np.uint64(seed) * np.uint64(1_000_003) + sid) * np.uint64(8191) + turn.astype(np.uint64)
            tail = place >= full
            at = np.where(tail, full, permuted(np.where(tail, 0, place), np.maximum(full, 1), key))
            left = wanted - turn * size - place * block
            yield pd.DataFrame({"shard": f["shard"], "sid": f["sid"], "slot": slot, "block": at,
                                "take": np.minimum(np.where(tail, size - full * block, block), left)})

    return each.mapInPandas(place, "shard long, sid int, slot long, block long, take long")


def _marks(docs: DataFrame) -> list[Column]:
    """128 bits that tell rows of different id, source or text apart."""
    known = [F.struct(docs[c]) for c in ("doc_id", "source", "text")]
    return [F.xxhash64(*known).alias("key"), F.xxhash64(F.lit(1), *known).alias("check")]


def sized(docs: DataFrame) -> DataFrame:
    """key, check, doc_id, source, size and copies: equal rows are one."""
    counted = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), *_marks(docs),
                          F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return stored(counted.groupBy("key", "check", "doc_id", "source", "size").agg(F.count("*").alias("copies")))


def mix_spans(sizes: DataFrame, targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
              seed: int = SEED) -> DataFrame:
    """The mix: shard, sid, slot, key, check, copy, doc_id, first_word, words, in units of words of documents.

    `sizes` is what `sized` returns and `targets` what `source_targets` does.
    """
    with_sid = join_checked(sizes, targets.select("source", "sid"), ["source"]).drop("source")
    filled = slots(draws(targets, block, shard_slots, seed), block, seed)
    # Both sides grow with the words; Spark would take the slots, made from a small table, for few and broadcast them.
    met = filled.hint("merge").join(segments(laid_out(with_sid), block), ["sid", "block"])
    taken = F.least(F.col("words"), F.col("take") - F.col("begin"))
    return met.withColumn("words", taken).filter("words > 0").select(
        "shard", "sid", "slot", "key", "check", "copy", "doc_id", "first_word", "words")


def _targets_of(sizes: DataFrame) -> DataFrame:
    return stored(source_targets(sizes.select("source", (F.col("size") * F.col("copies")).alias("size"))))


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    sizes = sized(docs)
    targets = _targets_of(sizes)
    spans = mix_spans(sizes, targets, block, shard_slots, seed)
    taken = spans.groupBy("key", "check", "copy").agg(F.sum("words").alias("taken"))
    known = by_copy(join_checked(sizes, targets.select("source", "source_size", "target"), ["source"]), sizes)
    return known.join(taken, ["key", "check", "copy"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as it is trained on: shard, sid, slot, doc_id, source, first_word, words, text.

    One row per part of a document in a slot; `text` is that part, its words
    joined by blanks.  Documents of which the mix takes nothing are absent.  Each
    text moves once, to its parts.
    """
    sizes = sized(docs)
    spans = mix_spans(sizes, _targets_of(sizes), block, shard_slots, seed)
    parts = spans.groupBy("key", "check").agg(F.collect_list(F.struct("shard", "sid", "slot", "first_word", "words")).alias("parts"))
    # Equal rows are one text here; their parts are all there.
    texts = docs.groupBy(*_marks(docs)).agg(F.max("doc_id").alias("doc_id"), F.max("source").alias("source"), F.max("text").alias("text"))
    met = texts.join(parts, ["key", "check"]).select(
        "doc_id", "source", F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+").alias("said"),
        F.explode("parts").alias("part"))
    return met.select("part.shard", "part.sid", "part.slot", "doc_id", "source", "part.first_word", "part.words",
                      F.array_join(F.slice("said", F.col("part.first_word").cast("int") + 1, F.col("part.words").cast("int")),
                                   " ").alias("text"))
