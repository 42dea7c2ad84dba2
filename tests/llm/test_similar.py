import random

import numpy as np
import pytest

import corpus_pipeline
from codeaudit.llm import simhash, similar
from test_dedup import AZ, brute_components

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate(AZ).split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    """Rows (doc_id, text) that stay: of each component by Jaccard >= 0.8 the smallest id, a null id last."""
    sets = [shingles(t) for _, t in rows]
    root = brute_components(sets, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))
    stays = {}
    for row, r in zip(rows, root):
        stays[r] = min(stays.get(r, row), row, key=lambda x: (x[0] is None, x[0] or 0))
    return stays.values(), root


def sample():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 300)) for _ in range(8)]
    rows = [(1, "one"), (2, "One two"), (3, "ONE"), (4, " \t"), (5, None), (6, "a b c d e f g"), (None, "alone without an id")]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    # An id of two texts, of which one is a near copy; near copies of which none has an id; one of them has.
    rows += [(100, "a clean text of an id that stands elsewhere too")]
    lost = rng.choices(vocabulary, k=200)
    rows += [(None, " ".join(lost)), (None, " ".join([*lost[:-1], "end"])), (None, rows[20][1] + " more")]
    return rows


@pytest.mark.parametrize("cell_rows", [similar.CELL_ROWS, 4])
def test_stage_equals_brute_force(docs_of, cell_rows):
    rows = sample()
    docs = docs_of(rows)
    kept, root = brute_kept(rows)
    left = similar.drop_similar(docs, cell_rows=cell_rows)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    named = sorted(r for r in kept if r[0] is not None)
    assert sorted(r for r in got if r[0] is not None) == named
    # Of a group without any id, which row stays is a matter of hashes.
    assert len(got) == len(set(root)) and sum(d is None for d, _ in got) == 2
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_shipped_near_copies(spark):
    docs = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept, root = brute_kept(rows)
    assert len(set(root)) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(d for d, _ in kept)


def crowd(n, similarity_words=22, seed=11):
    """Copies of one text of 200 words, each with so many words replaced that two of them lie just under the limit."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in range(rng.randrange(9), 200, 200 // max(1, similarity_words // 4)):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_crowd_just_under_the_limit_makes_no_pairs(docs_of):
    """Twice the members of a group give twice the rows, not four times, and no more than cells have members."""
    made = []
    for n in (150, 300):
        docs = docs_of(crowd(n))
        nodes = similar.stored(similar.set_nodes(similar.signatures(docs)))
        found = similar.links(docs, nodes)
        made.append(found.count())
        _, root = brute_kept(crowd(n))
        groups = {(r.node, r.root) for r in similar.components(found).collect()}
        assert n - len(groups) + len({r for _, r in groups}) == len(set(root))
        assert made[-1] <= 24 * n
    assert made[1] <= 2.6 * max(made[0], 20)


def test_forest_of_a_cell_equals_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        base = [rng.sample(range(300), rng.randint(5, 60)) for _ in range(3)]
        sets = [np.array(sorted({x if rng.random() < 0.93 else rng.randrange(300) for x in rng.choice(base)}), np.uint64) for _ in range(25)]
        edges = similar.cell_forest(sets, np.zeros(25, int))
        near = lambda x, y: 10 * len(set(x) & set(y)) >= 8 * len(set(x) | set(y))
        assert all(near(sets[a].tolist(), sets[b].tolist()) for a, b in edges)
        root = brute_components([s.tolist() for s in sets], near)
        parent = list(range(25))

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in edges:
            assert top(a) != top(b)
            parent[max(top(a), top(b))] = min(top(a), top(b))
        assert [top(i) for i in range(25)] == root
        # Two sides meet only each other.
        side = np.arange(25) % 2
        assert all(side[a] != side[b] for a, b in similar.cell_forest(sets, side))


def test_measured_recall_just_above_the_limit(docs_of):
    """400 pairs planted at similarities of 0.80 to 0.85, each pair of words of its own: all are found."""
    rng = random.Random(13)
    rows, pairs = [], 0
    while pairs < 400:
        words = [f"p{pairs}w{i}" for i in range(rng.randint(80, 200))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
            other[at] = "changed"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    left = {r.doc_id for r in similar.drop_similar(docs_of(rows)).collect()}
    assert left == set(range(0, 800, 2))


def test_long_and_odd_texts(docs_of, monkeypatch):
    long = [f"w{i % 5000}x{i // 5000}" for i in range(200_000)]
    rows = [(1, " ".join(long)), (2, "\n".join(long[:-9000])), (3, " ".join(long[:120_000])), (4, None), (5, ""), (5, ""), (None, " "), (6, "a")]
    left = sorted((str(r.doc_id), len(r.text or "")) for r in similar.drop_similar(docs_of(rows), cell_bytes=1 << 20).collect())
    assert left == sorted([("1", len(rows[0][1])), ("3", len(rows[2][1])), ("4", 0), ("6", 1)])


def test_simhash_cells_find_near_copies_on_their_own(docs_of, monkeypatch):
    """Without a MinHash band in common, texts of nearly equal fingerprints still meet; those that are not similar stay."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    near = [*words[:-1], "end"]
    texts = [" ".join(words), " ".join(near), " ".join(rng.sample(words, 3000))]
    prints = similar.sketches([t.encode() for t in texts])[1]
    for text, found in zip(texts, prints):
        held = [int(h) for h in similar.shingle_set(text.encode())]
        assert int(found) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in held) > len(held))
    assert int(prints[0] ^ prints[1]).bit_count() <= 3
    made = iter(range(10 ** 9))
    monkeypatch.setattr(similar, "band_cells", lambda least: np.array([[next(made)] for _ in least], np.int64))
    signed = [similar.block_cells(prints[k:k + 1])[0] for k in range(3)]
    assert set(signed[0]) & set(signed[1]) and not set(signed[0]) & set(signed[2])
    assert len(set(signed[0])) == 20


def test_fingerprints_of_long_sets_are_counted_in_parts(monkeypatch):
    h = np.random.default_rng(3).integers(0, 2 ** 64, 1000, dtype=np.uint64)
    starts = np.array([0, 3, 400, 401, 407])
    whole = similar.set_fingerprints(h, starts)
    monkeypatch.setattr(similar, "FLUSH", 7)
    assert (similar.set_fingerprints(h, starts) == whole).all()


def test_stage_joins_what_only_simhash_cells_bring_together(docs_of, monkeypatch):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    blocks = similar.block_cells
    signed = similar.signatures

    def without_bands(docs, width=similar.WIDTH):
        return signed(docs, width).selectExpr("mark", "doc_id", "name", "size", "slice(cells, 1, 20) AS cells")

    assert blocks(np.zeros(1, np.uint64)).shape == (1, 20)
    monkeypatch.setattr(similar, "signatures", without_bands)
    docs = docs_of([(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(rng.sample(words, 3000)))])
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == [1, 3]


def test_stage_drops_all_that_the_simhash_operator_links(docs_of):
    """A passage that is repeated decides the fingerprint, and is a few shingles of the set: linked by bits, not by sets."""
    def text(own):
        return " ".join([*(["the same few words again"] * 400), *(f"{own}{i}" for i in range(60))])

    further = text("b").replace("b59", "end")
    docs = docs_of([(1, text("a")), (2, text("b")), (3, further), (4, " ".join(f"c{i}" for i in range(60))), (None, text("d"))])
    assert len(brute_kept([(r.doc_id, r.text) for r in docs.collect()])[0]) == 4
    by_bits = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert by_bits[2] == by_bits[None] == 1 and by_bits[4] == 4
    for cell_rows in (similar.CELL_ROWS, 2):
        assert sorted(r.doc_id for r in similar.drop_similar(docs, cell_rows=cell_rows, by_bits=True).collect()) == [1, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, SF).collect()) == [1, 4]
