"""Spelling variants of words, found through the sorted rotations of a permuterm index.

Words come from whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, of
which only A-Z is lower-cased.  Of the words of at least `least_points` = 6 code
points that occur `least_n` = 5 times or more overall, two are near when exactly
one code point is inserted, deleted or replaced between them.

1. Counting: the texts of an Arrow batch are cut and counted together, then the
   counts of all batches are summed.
2. Rotations: a word A c B, marked by a terminator, has the rotation B$A c for each
   of its code points c.  B$A, what the rotation holds before the edited code
   point, is at the same time a whole rotation of the word A B, and what the
   rotation of A d B holds before d.  So all rotations, whole ones and ones
   without their last code point, are grouped by these texts: in a group, words
   that came with an edited code point are replacements of each other, and the
   word that came with none is each one's deletion.
3. Each group is sorted by count and scanned once.  Every member gets its number of
   near words there and the best of them (the first of the group, or the second
   for the first itself): a group returns as many rows as it has members, never
   its pairs.  A group has a member for each code point of the alphabet at most,
   and one more.
4. Where c stands in a run of equal code points, deleting any of them gives the
   same word: only the first counts, so each near word is counted once.
5. A word's form is its near word of largest n (ties: smallest in code-point
   order) if that n is `times` = 5 times its own or more.  Counts grow from form
   to form, so following them ends; each round doubles the steps taken.

Defined results: null and empty texts have no words; a text is read whole, and its
memory is in proportion to it.  Repeated rows count once each.  Empty tables give
empty results, other columns do not take part, and so do ids here; words that are
equal are one row.  The alphabet is that of `counted_words`; `word_forms` takes
words of any code points but the terminator (U+0000).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import stored
from codeaudit.llm.wordcodes import codes, slices, split_words, text_bytes

LEAST_POINTS, LEAST_N, TIMES = 6, 5, 5
END = "\u0000"
_KEPT = np.zeros(256, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[65:91] = np.arange(97, 123)


def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a blank for every byte outside of the words' alphabet."""
    raw, at = text_bytes(texts)
    out = np.where(_KEPT[raw], _KEPT[raw], 32).astype(np.uint8)
    # In UTF-8, U+00C0 to U+00FF are the byte C3 and one more; C3 begins nothing else.
    lead = np.flatnonzero(raw == 0xC3)
    out[lead], out[lead + 1] = raw[lead], raw[lead + 1]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))


def document_words(ids: list[int | None], texts: pa.Array, deleted: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of all texts and how often they occur.

    With `deleted`, some words of some texts are misspelt: where it divides the
    crc32 h of `<id>:<word>`, the word's code point h % length goes.
    """
    words, row = split_words(letters_only(texts))
    code, names = codes(words)
    if deleted is None or not len(names):
        return names, np.bincount(code, minlength=len(names))
    pair, n = np.unique(row.astype(np.int64) * len(names) + code, return_counts=True)
    row, code = pair // len(names), pair % len(names)
    heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    spelt = names.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(zlib.crc32, map(spelt.__getitem__, code.tolist()), map(heads.__getitem__, row.tolist())), np.int64, len(code))
    hit = np.flatnonzero(h % deleted == 0)
    changed = []
    for k in hit.tolist():
        word = spelt[code[k]].decode()
        cut = int(h[k]) % len(word)
        changed.append(word[:cut] + word[cut + 1:])
    rest = n.copy()
    rest[hit] = 0
    totals = np.bincount(code, weights=rest, minlength=len(names)).astype(np.int64)
    return pa.concat_arrays([names, pa.array(changed, pa.string())]), np.concatenate([totals, n[hit]])


def counted_words(docs: DataFrame, deleted: int | None = None, least_points: int = LEAST_POINTS, least_n: int = LEAST_N) -> DataFrame:
    """word and n of the words of docs that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                names, n = document_words(some.column(0).to_pylist(), some.column(1), deleted)
                good = pc.and_(pc.greater_equal(pc.utf8_length(names), least_points), pa.array(n > 0))
                yield pa.RecordBatch.from_arrays([names.filter(good), pa.array(n).filter(good)], names=["word", "n"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """key, word, n, and edited for every rotation of words(word, n).

    edited is null for a whole rotation; else the rotation has lost its last code
    point, and edited tells whether that one follows another than itself.
    """
    size = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    before, after = F.substr("word", F.lit(1), F.col("at")), F.substr(F.col("word"), F.col("at") + 1)
    point = F.substr(F.col("word"), F.col("at") + 1, F.lit(1))
    last = F.substr(F.col("word"), F.col("at"), F.lit(1))
    whole = F.struct(F.concat(after, F.lit(END), before).alias("key"), F.lit(None).cast("boolean").alias("edited"))
    cut = F.struct(F.concat(F.substr(F.col("word"), F.col("at") + 2), F.lit(END), before).alias("key"),
                   ((F.col("at") == 0) | (point != last)).alias("edited"))
    both = F.when(F.col("at") < size, F.array(whole, cut)).otherwise(F.array(whole))
    return placed.select("word", "n", F.inline(both))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near and near_n (the near word of largest n, ties the smallest) for all words that have a near word."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word")
    everyone = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("word", "n")
    scanned = rotations(words).select(
        "word", "edited", F.row_number().over(ranked).alias("rank"), F.count("*").over(group).alias("members"),
        F.first(entry).over(everyone).alias("best"), F.nth_value(entry, 2).over(everyone).alias("second"),
        F.count("edited").over(group).alias("edits"), F.count_if("edited").over(group).alias("firsts")).filter("members > 1")
    # Whole rotations meet the words of one more code point, edited ones those of one replaced and the one of one less.
    n_near = F.when(F.col("edited").isNull(), F.col("firsts")).otherwise(
        F.col("edits") - 1 + F.when(F.col("edited") & (F.col("members") > F.col("edits")), 1).otherwise(0))
    best = F.when(F.col("rank") > 1, F.col("best")).otherwise(F.col("second"))
    return (scanned.select("word", n_near.alias("n_near"), (-best["n"]).alias("minus"), best["word"].alias("near"))
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "near")).alias("top"))
            .select("word", "n_near", F.col("top.near").alias("near"), (-F.col("top.minus")).alias("near_n")))


def word_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root for every row of words(word, n), a word being in one row."""
    words = stored(words.select("word", "n"))
    likely = F.col("near_n") >= times * F.col("n")
    known = stored(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(likely, F.col("near")).alias("form"), F.when(likely, F.col("near_n")).alias("form_n")))
    steps = stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hopped = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        steps = hopped.select("word", "root")
        if hopped.filter("next IS NOT NULL").isEmpty():
            break
    return known.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, deleted: int | None = None, least_points: int = LEAST_POINTS,
                      least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """word_forms of the words of docs."""
    return word_forms(counted_words(docs, deleted, least_points, least_n), times)
