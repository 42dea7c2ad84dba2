"""SimHash near-duplicates, compared through tables of distances to pivots.

A document's fingerprint is taken over its 3-word shingles (repeats included).
Two fingerprints link when at most `most` = 3 of their 64 bits differ, and the
links' components are the groups.

Equal fingerprints are one node.  Every node goes to one cell for each choice of
three of six bit blocks: three flipped bits leave three blocks alone, so linked
nodes always meet in a cell.  In a cell, the Hamming distances of every node to
the pivots are tabulated.  By the triangle inequality two nodes whose distances
to any pivot differ by more than `most` cannot link, so the rows are ordered by
the first pivot, only neighbours within `most` are paired, the other pivots
discard most pairs by the largest coordinate difference, and the survivors are
verified.  Pairs that are already joined inside the cell are skipped: a cell
returns the edges of a forest, never all its pairs.  Cells above `cell_rows`
nodes are cut into chunks, and each pair of chunks is a cell of its own.

Defined results: a null or empty text has fingerprint zero and links like any
other.  Words are cut at ASCII white space, A-Z lower-cased.  Rows with a null
doc_id are fingerprinted and take part; a component without any id has a null
component_id.  Repeated rows give repeated result rows.  Empty tables give empty
results; other columns are ignored.  Texts are read in pieces of 1 MiB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeaudit.llm.common import join_checked, pieces, stored
from codeaudit.llm.components import components

SHINGLE, MOST, PIVOTS = 3, 3, 24
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
CELL_ROWS = 4096
FLUSH = 1 << 17


def shingle_hashes(text: bytes | None, words: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 (seed 42) of the shingles of a text, in lists of bounded length."""
    from xxhash import xxh64_intdigest

    rest: list[bytes] = []
    seen = False
    for piece in pieces(text or b""):
        got = rest + piece.lower().split()
        if len(got) >= words:
            joined = b" ".join(got)
            length = np.fromiter(map(len, got), np.int64, len(got)) + 1
            end = np.cumsum(length) - 1
            start = end - length + 1
            cuts = map(slice, start[: len(got) - words + 1].tolist(), end[words - 1:].tolist())
            seen = True
            yield list(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)))
            rest = got[len(got) - words + 1:]
        else:
            rest = got
    if not seen and rest:
        yield [xxh64_intdigest(b" ".join(rest), 42)]


def _bit_counts(hashes: list[int], starts: list[int]) -> np.ndarray:
    """Ones per bit (most significant first) of each run of hashes."""
    raw = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(np.unpackbits(raw, axis=1), starts, axis=0, dtype=np.int64)


def _fingerprint_batch(texts: list[bytes | None]) -> np.ndarray:
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    pending: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def flush():
        if pending:
            np.add.at(ones, owners, _bit_counts(pending, starts))
            pending.clear(), owners.clear(), starts.clear()

    for i, text in enumerate(texts):
        for some in shingle_hashes(text):
            owners.append(i)
            starts.append(len(pending))
            pending.extend(some)
            total[i] += len(some)
            if len(pending) >= FLUSH:
                flush()
    flush()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1).view(np.int64)


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id (or the named column `key`) and fp (the 64 bits as a signed long) for every row of docs."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id") if key is None else key, docs["text"].cast("binary").alias("text"))
    name = known.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fingerprint_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[name, "fp"])

    return known.mapInArrow(run, StructType([StructField(name, known.schema[0].dataType), StructField("fp", LongType())]))


def pivots(n: int = PIVOTS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 64, n, dtype=np.uint64)


def block_masks() -> list[int]:
    """Signed 64-bit masks of every choice of three of the six blocks."""
    blocks, at = [], 0
    for bits in BLOCK_BITS:
        blocks.append(((1 << bits) - 1) << at)
        at += bits
    return [int(np.uint64(a | b | c).view(np.int64)) for a, b, c in combinations(blocks, 3)]


def cell_forest(cell: np.ndarray, fp: np.ndarray, most: int = MOST, n_pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the linked fingerprints of each cell; rows of a cell are adjacent."""
    refs = pivots(n_pivots)
    first = np.bitwise_count(fp ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, cell))
    cell, fp, first = cell[order], fp[order], first[order]
    distance = np.bitwise_count(fp[None, :] ^ refs[1:, None]).astype(np.int8)
    label = np.arange(len(fp))
    left, right = [], []
    at, k = np.arange(len(fp)), 0
    while at.size:
        k += 1
        at = at[at + k < len(fp)]
        at = at[(cell[at] == cell[at + k]) & (first[at + k] - first[at] <= most)]
        i = at[label[at] != label[at + k]]
        for coordinate in distance:
            if not i.size:
                break
            i = i[np.abs(coordinate[i + k] - coordinate[i]) <= most]
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= most]
        if i.size:
            left.append(fp[i])
            right.append(fp[i + k])
            a, b = label[i], label[i + k]
            while a.size:
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[a], label[b]
                a, b = a[a != b], b[a != b]
    none = np.empty(0, np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (table, cell, chunk pair, fp) arrive sorted by cell; the last cell of a batch waits for the next one."""
    def emit(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        code = np.cumsum(new)
        size = np.bincount(code)
        many = size[code] > 1
        a, b = cell_forest(code[many], fp[many].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys, fp = np.empty((0, 4), np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        keys, fp = np.concatenate([keys, np.stack(columns[:4], axis=1)]), np.concatenate([fp, columns[4]])
        differ = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if differ.size:
            cut = differ[-1] + 1
            yield emit(keys[:cut], fp[:cut])
            keys, fp = keys[cut:], fp[cut:]
    if len(fp):
        yield emit(keys, fp)


def links(nodes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) whose components equal those of all links between the fingerprints of nodes(fp)."""
    masks = block_masks()
    tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell"))
                       for t, m in enumerate(masks)])
    cells = nodes.select("fp", F.inline(tables))
    sizes = stored(cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
                   .select("t", "cell", F.ceil(F.col("n") * 2 / cell_rows).cast("int").alias("chunks")))
    if sizes.isEmpty():
        placed = cells.select("t", "cell", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    else:
        marked = join_checked(cells, sizes, ["t", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        placed = (marked.withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                  .select("t", "cell", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "fp"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "t", "cell", "x", "y").sortWithinPartitions("t", "cell", "x", "y")
    return dealt.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    prints = stored(fingerprints(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), cell_rows)).withColumnRenamed("node", "fp")
    linked = stored(nodes.join(roots, "fp").select("fp", "root", "first_id"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    named = join_checked(linked, stored(smallest), ["root"]).select("fp", "smallest")
    classes = stored(nodes.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first_id").alias("component_id")))
    return join_checked(prints, classes, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

