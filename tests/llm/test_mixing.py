import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeaudit.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


ROWS = ([(i, text_of(17 * i % 90, i), "en", f"s{i % 4}") for i in range(200)]
        + [(500 + i, text_of(25, i), "en", "hot") for i in range(150)]
        + [(1, None, "en", "s0"), (2, "", "en", None), (3, text_of(40), "en", None), (3, text_of(40), "en", None),
           (None, text_of(7), None, None), (900, text_of(6000), "en", "long"), (901, " \t\n", "en", "blank")])


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in names if s not in full]
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        left = 0.0
        for s in free:
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("block,shard_slots", [(mixing.BLOCK, mixing.SHARD_SLOTS), (16, 8), (1, 50)])
def test_mix_meets_targets_and_bounds(docs_of, block, shard_slots):
    docs = docs_of(ROWS)
    got = mixing.mixed(docs, block, shard_slots).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = brute_targets(sizes)
    source_of = {}
    for r in ROWS:
        source_of.setdefault((r[0], len(WORD.findall(r[1] or ""))), r[3])
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = source_of[(r.doc_id, r.size)]
        taken[source] += r.taken
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * r.size
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.5 + 1e-6


def test_reruns_agree_and_other_seeds_do_not(docs_of):
    runs = [sorted(map(str, mixing.mixed(docs_of(ROWS), 16, 8, seed).collect())) for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]


def test_reruns_agree_however_rows_are_dealt_out(spark, docs_of, monkeypatch):
    repeated = docs_of([*ROWS, *ROWS[:5], ROWS[7], ROWS[7]])
    runs = [sorted(map(str, mixing.mixed(repeated.repartition(n), 16, 8).collect())) for n in (3, 5, 17)]
    assert runs[0] == runs[1] == runs[2]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [sorted(map(str, mixing.mixed(docs.repartition(n)).collect())) for n in (3, 17)]
    assert runs[0] == runs[1]
    parts = [sorted(map(str, mixing.mixed_documents(docs.repartition(n), 16, 8).collect())) for n in (3, 5)]
    assert parts[0] == parts[1]
    # Many copies of one row are made by many tasks.
    monkeypatch.setattr(mixing, "COPIES", 2)
    assert sorted(map(str, mixing.mixed(repeated, 16, 8).collect())) == sorted(map(str, mixing.mixed(repeated.repartition(9), 16, 8).collect()))


def test_shards_are_drawn_one_by_one_with_totals_held(spark):
    targets = spark.createDataFrame([(0, 5000, 7300.0), (1, 800, 1600.0), (2, 300, 0.0), (3, 64, 64.0)], "sid int, source_size long, target double")
    shares = []
    for seed in range(3):
        drawn = mixing.draws(targets, 16, 8, seed).collect()
        by_shard, by_source = {}, {}
        for d in drawn:
            by_shard[d.shard] = by_shard.get(d.shard, 0) + d.slots
            by_source.setdefault(d.sid, []).append((d.first_slot, d.first_slot + d.slots, d.shard))
        total = sum(by_shard.values())
        assert by_shard == {k: 8 for k in range(total // 8)} | ({total // 8: total % 8} if total % 8 else {})
        assert {s: max(b for _, b, _ in v) for s, v in by_source.items()} == {0: 313 + 144, 1: 100, 3: 4}
        # The slots of a source follow each other from shard to shard.
        for spans in by_source.values():
            spans.sort(key=lambda x: x[2])
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        shares.append([sum(d.slots for d in drawn if d.shard == k and d.sid == 1) for k in range(total // 8)])
    assert shares[0] != shares[1] != shares[2]
    # Hypergeometric: the mean share of source 1 in a shard and its spread.
    counts = np.array(sum(shares, []))
    assert abs(counts.mean() - 8 * 100 / 561) < 0.1 and abs(counts.var() - 8 * 100 / 561 * 461 / 561) < 0.35


def test_halves_of_very_many_slots():
    for counts in (np.array([3 * 10 ** 9, 5, 10 ** 8]), np.array([0, 7]), np.array([40 * 10 ** 9] * 3)):
        total = int(counts.sum())
        left = mixing._halved(0, 1 << 20, counts, -(-total // (1 << 20)), total, 1)
        assert left.sum() == min((1 << 19) * -(-total // (1 << 20)), total) and (left >= 0).all() and (left <= counts).all()


def test_spans_are_parts_of_the_texts(docs_of):
    rows = [r for r in ROWS if r[0] is not None and r[0] not in (1, 2, 3)]
    parts = mixing.mixed_documents(docs_of(rows), 16, 8).collect()
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    taken = {}
    for p in parts:
        assert p.text.split() == words[p.doc_id][p.first_word:p.first_word + p.words]
        taken[p.doc_id] = taken.get(p.doc_id, 0) + p.words
    assert taken == {r.doc_id: r.taken for r in mixing.mixed(docs_of(rows), 16, 8).collect() if r.taken}
    # A slot holds at most one block, and every shard is used.
    slots = {}
    for p in parts:
        slots[(p.sid, p.slot)] = slots.get((p.sid, p.slot), 0) + p.words
    assert max(slots.values()) <= 16
    assert len({p.shard for p in parts}) == max(p.shard for p in parts) + 1 > 10


def test_equal_rows_of_one_id_are_both_mixed(docs_of):
    docs = docs_of([(3, "a b c d"), (3, "a b c d"), (4, "e f")])
    assert sum(p.words for p in mixing.mixed_documents(docs, 2, 8).collect()) == 15


def test_permutations_are_permutations_and_keyed():
    for n in (1, 2, 3, 64, 1000):
        got = [mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)) for key in (1, 2)]
        assert sorted(got[0]) == sorted(got[1]) == list(range(n))
    assert (got[0] != got[1]).any() and (got[0] != np.arange(n)).mean() > 0.9


def test_empty_and_wordless_tables(docs_of):
    assert mixing.mixed(docs_of(ROWS).limit(0)).count() == 0
    assert mixing.mixed_documents(docs_of(ROWS).limit(0)).count() == 0
    got = mixing.mixed(docs_of([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
