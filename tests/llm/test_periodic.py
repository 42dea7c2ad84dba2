import hashlib
import random
import re
import zlib

import numpy as np

from codeaudit.llm import periodic
from codeaudit.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=12):
    """(start, length, period) of all runs, lag by lag; of one stretch the smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return [(s, n, p) for s, p, n in sorted((s, p, n) for (s, n), p in found.items())]


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    words = [f"w{rng.randrange(rng.choice([2, 4, 30]))}" for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 2)):
        p = rng.randint(1, 40)
        period = [f"w{rng.randrange(rng.choice([2, 30]))}" for _ in range(p)]
        at = rng.randint(0, len(words))
        words[at:at] = (period * 8)[:rng.randint(p, 8 * p)]
    for _ in range(rng.choice([0, len(words) // 12])):
        words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        code = np.array([names[w] for t in texts for w in t], np.int32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.searchsorted(row, np.arange(len(texts)))
        got = [[] for _ in texts]
        for s, n, p in zip(*periodic.runs(code, row)):
            got[row[s]].append((s - first[row[s]], n, p))
        assert got == [brute(t) for t in texts]


def test_long_texts_and_agreeing_hashes(monkeypatch):
    long = np.tile(np.arange(7000), 9)
    assert [x.tolist() for x in periodic.runs(long, np.zeros(len(long), np.int64))] == [[0], [63000], [7000]]
    same = np.zeros(50_000, np.int64)
    assert [x.tolist() for x in periodic.runs(same, same)] == [[0], [50_000], [1]]
    # Where all hashes of the first draw agree, other ones are drawn.
    real = periodic._window_hashes
    monkeypatch.setattr(periodic, "_window_hashes", lambda x, m, seed: [h * np.uint64(seed != 42) for h in real(x, m, seed)])
    words = [f"w{i % 20}" for i in range(50)] + [f"v{i % 17 % 11}" for i in range(60)]
    code = np.unique(words, return_inverse=True)[1]
    assert list(zip(*(x.tolist() for x in periodic.runs(code, np.zeros(len(code), np.int64))))) == brute(words)


def test_operator_over_odd_rows(docs_of):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a\x0b" * 12), (5, "A a " * 6), (None, "ä\x85ö " * 12),
            (6, "x y " * 40_000 + "end")] + [(10 + i, "  ".join(random_words(rng)) + "\n") for i in range(40)]
    got = periodic.periodic_runs(docs_of([*rows, rows[-1]])).collect()
    assert len(got) == len(rows) + 1
    expected = [(d, brute(WORD.findall(t or "")), collapsed(WORD.findall(t or ""), brute(WORD.findall(t or "")))) for d, t in rows if d != 6]
    expected += [expected[-1], (6, [(0, 80_000, 2)], "x y end")]
    key = repr
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(expected, key=key)
    assert periodic.periodic_runs(docs_of(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = best[1] and 1000 * best[1] // best[2]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[d]) == (d, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))
    assert planted > 5
