"""Near copies by SimHash and by the Jaccard similarity of word shingles, for the corpus pipeline.

Two documents link when their sets of distinct 5-word shingles (a shorter text is
one shingle of all its words) have a Jaccard similarity of at least `least` = 0.8;
with `by_bits`, as the pipeline asks, also when the SimHash operator links them: its
fingerprints, of 3-word shingles with repeats, differ in three bits or fewer.  The
components of all these links are the groups.

SimHash distances do not bound the similarity of sets: at 0.8 about ten of 64 bits
differ, with a spread of three, and repeated passages weigh in a fingerprint but not
in a set.  So the links of the operator come through its own pivot tables, whole.
For those of the sets documents meet in cells: in SimHash cells, where the
fingerprints of two sets agree in three of six bit blocks, and in those of MinHash
bands: 24 bands of four minima.  Two texts of similarity 0.8 share no band with a
probability of 0.59 ^ 24 = 3e-6, and more similar ones with less.  All cells are
compared by the shingle sets themselves.

1. Documents of equal shingle sets are one node.
2. Of cells that hold the same nodes one stays; cells of one node go.
3. Every node of a cell brings its whole shingle set there, once.  Cells too large
   for a task, by the bytes of their sets or by nodes, are cut into chunks, and
   each two chunks are a cell of their own.
4. In a cell, the shingles that two nodes share are counted over the lists of the
   nodes that hold a shingle.  Nodes already joined there are not compared again,
   and joining ones are noted as an edge: a cell returns the edges of a forest, one
   less than its nodes at most, and no row ever stands for a pair that is not
   linked or that other links make needless.

Defined results: words are cut at ASCII white space, A-Z lower-cased; null texts
and texts without words are copies of each other.  A row is known by 128 bits of
its doc_id and text, so rows with a null or repeated id are judged apart; rows
equal in both stay or go together.  Of a group the row with the smallest doc_id
stays, a null id last.  Empty tables give empty results; other columns are carried
inside a struct, whatever their names.  A very long text is read in pieces of
1 MiB; the hashes of its shingles (8 bytes a word) are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm import simhash
from codeaudit.llm.common import join_checked, row_mark, rows_without, stored
from codeaudit.llm.components import components
from codeaudit.llm.simhash import FLUSH, _bit_counts, block_masks, shingle_hashes

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
# A chunk of a cell holds half as many nodes and bytes of sets.
CELL_ROWS, CELL_BYTES = 4096, 32 << 20
_DRAWN = np.random.default_rng(42).integers(0, 2 ** 64, (2, BANDS * ROWS), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    got = [np.array(some, np.uint64) for some in shingle_hashes(text, width)]
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.uint64)


def _mixed(h: np.ndarray, flip: int, times: int) -> np.ndarray:
    x = (h ^ np.uint64(flip)) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def set_fingerprints(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes: a bit is 1 if set in over half of them.  Bits are unpacked for FLUSH hashes at a time."""
    ones = np.zeros((len(starts), 64), np.int64)
    for at in range(0, len(h), FLUSH):
        first, last = np.searchsorted(starts, [at, min(at + FLUSH, len(h)) - 1], "right") - 1
        runs = np.arange(first, last + 1)
        np.add.at(ones, runs, _bit_counts(h[at:at + FLUSH], np.maximum(starts[runs] - at, 0)))
    bits = (2 * ones > np.diff(np.append(starts, len(h)))[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1)


def sketches(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingle set of each text: the minima of all hash functions, its SimHash, 128 bits that name the set, and its size."""
    least = np.full((len(texts), BANDS * ROWS), 2 ** 64 - 1, np.uint64)
    name, size = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    prints = np.zeros(len(texts), np.uint64)
    pending: list[np.ndarray] = []
    owners: list[int] = []

    def flush():
        if pending:
            h = np.concatenate(pending)
            starts = np.cumsum(size[owners]) - size[owners]
            prints[owners] = set_fingerprints(h, starts)
            for k in range(BANDS * ROWS):
                least[owners, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _TIMES[k], starts)
            name[owners, 0] = np.add.reduceat(_mixed(h, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15), starts)
            name[owners, 1] = np.add.reduceat(_mixed(h, 0x632BE59BD9B4E019, 0xD6E8FEB86659FD93), starts)
            pending.clear(), owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        held = shingle_set(text, width)
        size[i] = len(held)
        if len(held):
            pending.append(held)
            owners.append(i)
            waiting += len(held)
        if waiting >= FLUSH:
            flush()
            waiting = 0
    flush()
    return least, prints, name, size


def band_cells(least: np.ndarray) -> np.ndarray:
    """One cell for each band of each row of minima; the band is part of the cell."""
    x = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(least), axis=0)
    for r in range(ROWS):
        x = (x ^ least[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def block_cells(prints: np.ndarray) -> np.ndarray:
    """One cell for each choice of three of the six bit blocks of a SimHash; the choice is part of the cell."""
    masks = np.array(block_masks(), np.int64).view(np.uint64)
    x = prints[:, None] & masks[None, :]
    return _mixed(x, 0xD1B54A32D192ED03, 0x9E3779B97F4A7C15).view(np.int64) ^ masks.view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """mark, doc_id, name (of the shingle set), size and cells for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, prints, name, size = sketches(batch.column(2).to_pylist(), width)
            names = pa.StructArray.from_arrays([pa.array(name[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])
            cells = np.concatenate([block_cells(prints), band_cells(least)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names, pa.array(size), pa.array(list(cells), pa.list_(pa.int64()))],
                names=["mark", "doc_id", "name", "size", "cells"])

    return docs.select(row_mark(docs).alias("mark"), docs["doc_id"].cast("long").alias("doc_id"),
                       docs["text"].cast("binary").alias("text")).mapInArrow(
        run, "mark struct<a: long, b: long>, doc_id long, name struct<a: long, b: long>, size long, cells array<long>")


def set_nodes(signed: DataFrame) -> DataFrame:
    """One row for each shingle set of signed: node, name, size, cells, rows, and first (its row of smallest id)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    grouped = signed.groupBy("name").agg(
        first, F.max("size").alias("size"), F.first("cells").alias("cells"), F.count("*").alias("rows"))
    # A number to join by; it decides nothing.
    return grouped.withColumn("node", F.monotonically_increasing_id())


def cell_forest(sets: list[np.ndarray], side: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Edges that join the linked sets of a cell; sets of one side are not compared if there are two."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, holders = hashes[order], owner[order]
    # Where the holders of each set's shingles begin and end.
    begins = np.append(True, hashes[1:] != hashes[:-1]) if hashes.size else np.empty(0, bool)
    starts = np.append(np.flatnonzero(begins), len(hashes))
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(begins) - 1
    at = np.cumsum(size) - size
    two_sides = side.min() != side.max()
    label, edges = np.arange(n), []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        open_ = later[(label[later] != label[i]) & (side[later] != side[i] if two_sides else True)]
        open_ = open_[np.minimum(size[open_], size[i]) >= least * np.maximum(size[open_], size[i]) - 1e-9]
        if not open_.size:
            continue
        mine = number[at[i]: at[i] + size[i]]
        low, high = starts[mine], starts[mine + 1]
        length = high - low
        reach = np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())
        shared = np.bincount(holders[reach], minlength=n)[open_]
        # The guard keeps 0.8 * n from being rounded up past a whole number.
        for j in open_[shared >= least * (size[i] + size[open_] - shared) - 1e-9]:
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


def _cell_forests(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, x, y, chunk, node, held) arrive sorted by the first three; the last cell of a batch waits for the next one."""
        def forest(rows: list[tuple]) -> pa.RecordBatch:
            nodes = np.array([r[1] for r in rows])
            found = np.array(cell_forest([r[2] for r in rows], np.array([r[0] for r in rows]), least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for k, (*here, chunk, node) in enumerate(zip(*columns)):
                if here != key and len(rows) > 1:
                    yield forest(rows)
                if here != key:
                    key, rows = here, []
                rows.append((chunk, node, np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)))
        if len(rows) > 1:
            yield forest(rows)

    return run


def held_sets(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """node and held (its shingle set) for nodes(node, mark)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = shingle_set(text.as_py(), width).tobytes()
                yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "held": pa.array([held], pa.binary())})

    texts = docs.select(row_mark(docs).alias("mark"), docs["text"].cast("binary").alias("text"))
    chosen = join_checked(texts, nodes, ["mark"]).select("node", "text")
    # Rows equal in id and text are one node.
    return chosen.mapInArrow(run, "node long, held binary").dropDuplicates(["node"])


def links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: float = LEAST,
          cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Edges (a, b) whose components equal those of all similar sets among nodes, as `set_nodes` returns them."""
    placed = nodes.filter("size > 0").select("node", "size", F.explode("cells").alias("cell"))
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") * 2 / cell_rows, F.col("bytes") * 2 / cell_bytes)).cast("int")
    asked = stored(cells.groupBy("n", "x", "y").agg(F.min("cell").alias("cell"), F.max("bytes").alias("bytes"))
                   .select("cell", chunks.alias("chunks")))
    members = stored(join_checked(placed.select("cell", "node"), asked, ["cell"]))
    wanted = stored(members.select("node").distinct())
    marked = stored(join_checked(nodes.select("node", F.col("first.mark").alias("mark")), wanted, ["node"], "left_semi"))
    held = stored(held_sets(docs, marked, width))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .join(held, "node").select("cell", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"),
                                        "chunk", "node", "held"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(
        _cell_forests(least), "a long, b long")


def fingerprint_links(docs: DataFrame, signed: DataFrame, nodes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that join the nodes of every component of the SimHash operator, each to the smallest of them."""
    prints = stored(simhash.fingerprints(docs, row_mark(docs).alias("mark")).dropDuplicates(["mark"]))
    distinct = stored(prints.groupBy("fp").agg(F.count("*").alias("n")))
    roots = components(simhash.links(distinct.select("fp"), cell_rows)).withColumnRenamed("node", "fp")
    shared = stored(distinct.join(roots, "fp", "left").filter("n > 1 OR root IS NOT NULL")
                    .select("fp", F.coalesce("root", "fp").alias("class")))
    met = stored(join_checked(prints, shared, ["fp"]).select("mark", "class"))
    # Rows of one shingle set may have several fingerprints: repeats count in these.
    named = stored(join_checked(signed.select("mark", "name"), met, ["mark"]).select("name", "class").distinct())
    placed = stored(join_checked(nodes.select("name", "node"), named, ["name"]).select("class", "node"))
    least = stored(placed.groupBy("class").agg(F.min("node").alias("a")))
    return join_checked(placed, least, ["class"]).filter("node <> a").select("a", F.col("node").alias("b"))


def drop_similar(docs: DataFrame, width: int = WIDTH, least: float = LEAST,
                 cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES, by_bits: bool = False) -> DataFrame:
    """docs with one row of each group of near copies; `by_bits` takes the links of the SimHash operator as well."""
    signed = stored(signatures(docs, width))
    nodes = stored(set_nodes(signed))
    edges = links(docs, nodes, width, least, cell_rows, cell_bytes)
    if by_bits:
        edges = edges.unionByName(fingerprint_links(docs, signed, nodes, cell_rows))
    roots = components(edges)
    linked = nodes.select("node", "name", "first", "rows").join(roots, "node", "left").filter("rows > 1 OR root IS NOT NULL")
    groups = stored(linked.select("name", "first", F.coalesce("root", "node").alias("root")))
    stays = stored(groups.groupBy("root").agg(F.min("first").alias("best")).select("root", F.col("best.mark").alias("stay")))
    named = stored(join_checked(groups.select("name", "root"), stays, ["root"]).select("name", "stay"))
    gone = join_checked(signed.select("mark", "name"), named, ["name"]).filter("mark <> stay").select("mark").distinct()
    return rows_without(docs, stored(gone))
