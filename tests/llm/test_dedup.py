import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codeaudit.llm import common, exact_dedup, simhash
from codeaudit.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "ÉTÉ"), (7, "été"), (8, "ÉTé"),
        (None, "same text"), (9, "alone"), (None, "nobody"), (None, "nobody"), (10, "twice"), (10, "twice"), (11, "x" * 300_000),
        (12, "X" * 300_000)]


def brute_dedup(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(AZ), []).append(doc_id)
    return groups


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_exact_dedup_equals_brute_force(docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(common.join_checked, "__defaults__", ("inner", broadcast, True))
    got = exact_dedup.dedup_groups(docs_of(ROWS)).collect()
    groups = brute_dedup(ROWS)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(ROWS)
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.doc_id in ids
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest, ids in by_hash.items():
        kept = [r for r in got if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_drop_copies_keeps_columns_and_one_row_a_group(docs_of):
    docs = docs_of(ROWS)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(brute_dedup(ROWS))
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_texts_of_one_digest_are_told_apart(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same for all"))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup_groups(docs_of([(1, "a"), (2, "A"), (3, "b"), (4, "c")])).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, linked):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 4])
def test_near_duplicates_equal_brute_force(docs_of, cell_rows):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 300))) for _ in range(12)]
    rows = [(5, None), (3, ""), (4, " \t"), (6, "One"), (7, "one"), (8, "one two"), (None, base[0]), (9, "é É"), (10, "a b c d")]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    rows += rows[-5:]
    got = simhash.near_duplicates(docs_of(rows), cell_rows).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    smallest = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    expected = sorted((str(d), f"{p:016x}", smallest.get(r)) for (d, _), p, r in zip(rows, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected
    assert len(set(root)) < len({p for p in prints})  # some different fingerprints do link


def test_cells_lose_no_link_of_up_to_three_bits(spark):
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 2 ** 63, 60, dtype=np.int64)
    rows = [(int(s),) for s in seed]
    for s in seed:
        flipped = int(s)
        for b in rng.choice(63, int(rng.integers(1, 5)), replace=False):
            flipped ^= 1 << int(b)
        rows.append((flipped,))
    nodes = spark.createDataFrame(rows, "fp long").distinct()
    points = sorted(r[0] for r in nodes.collect())
    root = brute_components(points, lambda a, b: bin(a ^ b).count("1") <= 3)
    expected = {points[i]: points[r] for i, r in enumerate(root) if root.count(r) > 1}
    assert {r.node: r.root for r in components(simhash.links(nodes)).collect()} == expected


def test_long_texts_are_fingerprinted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash._fingerprint_batch([text, b"a b"])
    monkeypatch.setattr(simhash, "pieces", lambda t: common.pieces(t, 100))
    assert (simhash._fingerprint_batch([text, b"a b"]) == whole).all()
    assert list(common.pieces(b"abc", 1)) == [b"abc"] and b"".join(common.pieces(b"a bc d", 1)) == b"a bc d"


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(path.limit(0)).count() == 0



def test_edges_are_evaluated_once(spark):
    """Edges of which another forest comes out when they are evaluated again still join all of a component."""
    def forest(batches):
        draw = random.SystemRandom()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                # To the node before, or to the smallest: either way one component.
                yield pa.RecordBatch.from_pydict({"a": [draw.choice([i - 1, 0])], "b": [i]})

    edges = spark.range(1, 400).mapInArrow(forest, "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}
