"""Benchmark decontamination: short test items found inside long documents.

An item is contained in a document when at least `threshold` = 0.8 of its
distinct shingles (five words; an item of fewer words is one shingle of all its
words) occur in the document.  Words are runs of letters and digits, lower-cased.

Search.  Items are partitioned by size, and each item is sketched by its smallest
shingle hashes.  An item of n shingles may miss at most n - ceil(0.8 n) of them,
so among its n - ceil(0.8 n) + 1 smallest hashes at least one occurs in every
document that contains it: the sketch length depends on the size partition, and
no containment is lost, however long the document is.  (Banded signatures of
whole documents would miss short items: an item of 30 shingles has a Jaccard
similarity of 0.003 with a document of 10,000.)  Documents look up only hashes
up to the largest sketched one.

Verification.  For each candidate pair the distinct shingles that both texts
share are counted by comparing their words.

Everything is columns: the shingles of a document are generated, hashed and
probed inside one generated loop, and its text never moves.

Defined results: null and empty texts contain nothing and are contained nowhere.
Rows that share a doc_id count as one document (rows with a null doc_id as well),
items likewise by item_id.  Repeated rows change nothing.  Empty tables give no
pairs.  Other columns are ignored by the search and carried by `drop_contaminated_rows`, whatever their names.
`drop_contaminated_rows`, the pipeline's stage, judges each row by its own text,
whatever the other rows of its doc_id say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import join_checked, row_mark, rows_without, stored

WIDTH, THRESHOLD = 5, 0.8
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    """rows(…, words) times the positions of their shingles, with the hash h."""
    long_enough = rows.filter(F.size("words") >= width)
    at = long_enough.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - F.lit(width))))
    return at.withColumn("h", F.xxhash64(*_parts(width)))


def _parts(width: int) -> list[Column]:
    return [F.col("words")[F.col("i") + F.lit(j)] for j in range(width)]


def item_shingles(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, width, h, shingle, n, need, sketched: the distinct shingles of each item.

    `size_class` is the size partition, floor(log2 n).
    """
    rows = items.select("item_id", words(items["text"]).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("words")))
    shingles = reduce(DataFrame.unionByName, [
        _shingled(rows.filter(F.col("width") == w), w).select(
            "item_id", "width", "h", F.concat_ws(" ", *_parts(w)).alias("shingle")).distinct()
        for w in range(1, width + 1)])
    per_item = Window.partitionBy("item_id")
    counted = shingles.withColumn("n", F.count("*").over(per_item)).withColumn(
        "place", F.row_number().over(per_item.orderBy("h", "shingle")))
    # The guard keeps 0.8 * n from being rounded up past a whole number.
    need = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return counted.withColumn("need", need).select(
        "item_id", "width", "h", "shingle", "n", "need", F.floor(F.log2("n")).cast("int").alias("size_class"),
        (F.col("place") <= F.col("n") - F.col("need") + 1).alias("sketched"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, size_class, n_shingles, n_shared, containment for every contained item."""
    shingles = stored(item_shingles(items, width, threshold))
    top = {r["width"]: r["top"] for r in shingles.filter("sketched").groupBy("width").agg(F.max("h").alias("top")).collect()}
    rows = docs.select("doc_id", words(docs["text"]).alias("words"))

    def per_width(find) -> DataFrame:
        found = [find(w, top[w]) for w in sorted(top)]
        empty = docs.select("doc_id").join(items.select("item_id"), F.lit(False)) if not found else None
        return reduce(DataFrame.unionByName, found) if found else empty

    def search(w: int, largest: int) -> DataFrame:
        sketch = shingles.filter((F.col("width") == w) & F.col("sketched")).select("h", "item_id")
        probes = _shingled(rows, w).filter(F.col("h") <= F.lit(largest)).select("doc_id", "h")
        return join_checked(probes, sketch, ["h"], nulls_match=False).select("doc_id", "item_id")

    candidates = stored(per_width(search).distinct())
    wanted = stored(candidates.select("doc_id").distinct())

    def verify(w: int, _: int) -> DataFrame:
        known = shingles.filter(F.col("width") == w).select("h", "item_id", "shingle")
        chosen = join_checked(rows, wanted, ["doc_id"], "left_semi")
        probes = _shingled(chosen, w).select("doc_id", "h", F.concat_ws(" ", *_parts(w)).alias("said"))
        return join_checked(probes, known, ["h"], nulls_match=False).filter("said = shingle").select(
            "doc_id", "item_id", "shingle")

    shared = per_width(verify)
    if "shingle" not in shared.columns:
        shared = shared.withColumn("shingle", F.lit(""))
    counts = shared.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = stored(shingles.select("item_id", "size_class", F.col("n").alias("n_shingles"), "need").distinct())
    pairs = join_checked(counts, sizes, ["item_id"]).filter("n_shared >= need")
    asked = candidates.select(F.col("doc_id").alias("cand_doc"), F.col("item_id").alias("cand_item"))
    pairs = pairs.join(asked, F.col("doc_id").eqNullSafe(F.col("cand_doc")) & F.col("item_id").eqNullSafe(F.col("cand_item")),
                       "left_semi")
    return pairs.select("doc_id", "item_id", "size_class", "n_shingles", "n_shared",
                        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated_rows(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose own text contains an item.

    A row is known by doc_id and text, so rows that share one of them are judged apart.
    """
    rows = docs.select(row_mark(docs).alias("doc_id"), "text")
    found = contained_items(rows, items, width, threshold).select(F.col("doc_id").alias("mark")).distinct()
    return rows_without(docs, stored(found))
