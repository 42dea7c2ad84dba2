import random
import re
import zlib
from collections import Counter

import pytest
from test_dedup import AZ

from codeaudit.llm import variants
from codeaudit.llm.queries import op11_spelling_variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, deleted=None, least_points=6, least_n=5):
    count = Counter()
    for d, text in rows:
        for run in RUN.findall((text or "").translate(AZ)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if deleted and h % deleted == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_points and n >= least_n}


def brute_forms(words, times=5):
    lengths, out = {}, {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in lengths.get(len(w) + k, []) if near(w, x)]
        top = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (top if top is not None and words[top] >= times * n else None, len(close))
    rows = set()
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, words[w], n_near, words.get(form)))
    return rows


def test_near_words_equal_brute_force(spark):
    rng = random.Random(3)
    for alphabet in ("ab", "abß", "aé世𝒳"):
        words = {"".join(rng.choices(alphabet, k=rng.randint(1, 6))): rng.choice([1, 1, 2, 5, 5, 25, 130]) for _ in range(250)}
        table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
        got = variants.word_forms(table).collect()
        assert {tuple(r) for r in got} == brute_forms(words) and len(got) == len(words)
    assert variants.word_forms(table.limit(0)).count() == 0


def test_no_group_returns_pairs(spark):
    """Replacements of one code point by every letter: all are near each other, and rows stay in proportion."""
    letters = [chr(c) for c in range(0x100, 0x100 + 400)]
    table = spark.createDataFrame([(f"stem{c}ing", 5 + i) for i, c in enumerate(letters)], "word string, n long")
    assert variants.rotations(table).count() == 400 * 17
    got = {r.word: r for r in variants.near_words(table).collect()}
    assert all(r.n_near == 399 for r in got.values())
    assert got[f"stem{letters[-1]}ing"].near == f"stem{letters[-2]}ing" and got[f"stem{letters[0]}ing"].near_n == 404


@pytest.mark.parametrize("deleted", [None, 3])
def test_counts_over_odd_texts(docs_of, deleted):
    rng = random.Random(4)
    vocabulary = ["Straße", "straÿe", "ÉTÉétéx", "cliché-verre", "ABCDEFg", "naïveté", "x×÷yabcd", "zweiwörter", "a1bcdefg", "日本語abcdef"]
    rows = [(i if i % 7 else None, rng.choice([" ", "\n", " ", ", "]).join(rng.choices(vocabulary, k=40))) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "longtext " * 200_000), rows[0], rows[0]]
    got = variants.counted_words(docs_of(rows), deleted).collect()
    assert {r.word: r.n for r in got} == brute_words(rows, deleted) and got
    assert variants.spelling_variants(docs_of(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    got = op11_spelling_variants(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_forms(brute_words([tuple(r) for r in docs], 199))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert any(r.form for r in got)
