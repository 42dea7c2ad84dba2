import random
import re

import pytest

from codeaudit.llm import common, decontaminate


def brute(rows, items):
    def shingles(text, k=None):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        k = k or min(5, len(words))
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words and k <= len(words) else set()

    out = set()
    for item_id, item in items:
        own = shingles(item)
        if not own:
            continue
        k = len(next(iter(own)))
        for doc_id in {d for d, _ in rows}:
            said = set().union(*(shingles(t, k) for d, t in rows if d == doc_id))
            n = len(own & said)
            if n * 10 >= 8 * len(own):
                out.add((doc_id, item_id, len(own), n))
    return out


def sample():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "x1"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(5, 60))) for i in range(30)] + [(100, None), (101, "!?"), (102, "Été"), (103, "two Words")]
    items.append((104, "same same same same same same same same"))
    rows = [(i, say(rng.randint(0, 400))) for i in range(60)]
    for i, (_, item) in enumerate(items[:30]):
        words = item.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, f"{say(200)}. {' '.join(words).upper()}, {say(100)}"))
    rows += [(2000, None), (2001, ""), (2002, "an été there"), (None, items[3][1]), (None, "nothing"), rows[-1],
             (2003, "same, same; same same same same"), (2004, say(50_000) + " " + items[5][1])]
    half = items[7][1].split()
    rows += [(2005, " ".join(half[: len(half) // 2 + 4])), (2005, " ".join(half[len(half) // 2:]))]
    return rows, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_search_equals_brute_force(spark, docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(common.join_checked, "__defaults__", ("inner", broadcast, True))
    rows, items = sample()
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contained_items(docs_of(rows), benchmark).collect()
    expected = brute(rows, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == expected
    assert len(got) == len(expected) > 30
    assert all(2 ** r.size_class <= r.n_shingles < 2 ** (r.size_class + 1) for r in got)


def test_drop_contaminated_keeps_clean_rows_whole(spark, docs_of):
    rows, items = sample()
    docs, benchmark = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.drop_contaminated_rows(docs, benchmark)
    # Rows are judged one by one, whatever ids they share.
    bad = {n for n, *_ in brute([(n, t) for n, (_, t) in enumerate(rows)], items)}
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for n, (d, _) in enumerate(rows) if n not in bad)


def test_empty_tables(spark, docs_of):
    rows, items = sample()
    docs, benchmark = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    for d, b in ((docs.limit(0), benchmark), (docs, benchmark.limit(0)), (docs, benchmark.filter("item_id IN (100, 101)"))):
        assert decontaminate.contained_items(d, b).count() == 0
        assert decontaminate.drop_contaminated_rows(d, b).count() == d.count()


def test_the_search_finds_every_candidate_through_its_sketch(spark):
    _, items = sample()
    shingles = decontaminate.item_shingles(spark.createDataFrame(items, "item_id long, text string")).collect()
    for item in {r.item_id for r in shingles}:
        own = sorted((r for r in shingles if r.item_id == item), key=lambda r: (r.h, r.shingle))
        n, need = own[0].n, own[0].need
        assert n == len(own) and need == -(-8 * n // 10)
        assert [r.sketched for r in own] == [i < n - need + 1 for i in range(n)]
