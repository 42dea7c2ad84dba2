import random

from codeaudit.llm import licenses as lic

KNOWN = [lic.Template(name, text) for name, text in lic.TEMPLATES.items()]


def words_of(text):
    return lic.WORDS.findall(text.lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_longest_increasing_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        values = rng.sample(range(20), rng.randint(0, 9))
        places = lic.longest_increasing(values)
        chosen = [values[i] for i in places]
        assert chosen == sorted(chosen) and places == sorted(places)
        best = max((bin(m).count("1") for m in range(1 << len(values))
                    if (s := [v for i, v in enumerate(values) if m >> i & 1]) == sorted(s)), default=0)
        assert len(places) == best


def test_alignment_is_increasing_and_near_the_longest_common_subsequence():
    rng = random.Random(3)
    template = words_of(lic.TEMPLATES["Apache-2.0 notice"])
    for changes in range(0, 18, 3):
        text = template[:]
        for _ in range(changes):
            spot = rng.randrange(len(text))
            text[spot:spot + rng.randint(0, 1)] = rng.choices(["foo", "the", "license"], k=rng.randint(0, 2))
        pairs = lic.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.85 * lcs(text, template)


def test_planted_licenses_are_found_and_clean_texts_left_alone(docs_of):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "under", "version", "of", "work"]) for _ in range(n))
    rows, expected = [], set()
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        words = text.upper().split()
        for k in range(0 if len(words) < 20 else len(words) // 9):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((i, f"{say(50)}\n{' '.join(words)}\n{say(50)}"))
        expected.add((i, name))
    rows += [(100, None), (101, ""), (102, say(3000)), (103, "license " * 40), (104, lic.TEMPLATES["MIT"] + " " + lic.TEMPLATES["MIT"]),
             (105, say(70_000) + " " + lic.TEMPLATES["GPL-3.0"]), (None, lic.TEMPLATES["MIT"]), (107, lic.TEMPLATES["MIT"]),
             (107, lic.TEMPLATES["MIT"])]
    got = lic.scan_licenses(docs_of(rows)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert expected <= found and not found & {(d, n) for d in (100, 101, 102, 103) for n in lic.TEMPLATES}
    assert {(r.first_word, r.words, r.matched, r.coverage) for r in got if r.doc_id == 104} == {(0, 5, 5, 1.0), (5, 5, 5, 1.0)}
    assert {(r.first_word, r.license) for r in got if r.doc_id == 105} == {(70_000, "GPL-3.0")}
    assert sum(r.doc_id == 107 for r in got) == 2 and (None, "MIT") in found
    # The notice contains the short form, which is found in it as well.
    assert {n for d, n in found if d == 5} == {"Apache-2.0", "Apache-2.0 notice"}
    assert lic.scan_licenses(docs_of(rows).limit(0)).count() == 0
    assert lic.scan_licenses(docs_of(rows), {"empty": "!"}).count() == 0


def test_recall_of_notices_with_words_strewn_in():
    """Every template with up to as many inserted words as it has, somewhere in other text: all are found, at their place."""
    rng = random.Random(6)
    common = [w for t in KNOWN for w in t.words if len(w) < 5]
    missed = tried = 0
    for share in (0.1, 0.3, 0.6, 0.9):
        for foreign in (True, False):
            for t in KNOWN:
                words = list(t.words)
                for k in range(int(len(words) * share)):
                    words.insert(rng.randint(1, len(words) - 1), f"q{k}" if foreign else rng.choice(common))
                lead = [f"a{i}" for i in range(rng.randint(0, 400))]
                found = [f for f in lic.scan_text(" ".join([*lead, *words, "z", "z"]), [t]) if f[0] == t.name]
                tried += 1
                missed += not any(first >= len(lead) and matched >= t.need and span <= lic.SPREAD * len(t.words) for _, first, span, matched in found)
    # Strewn common words can rob a short template of its unique ones; words of their own cannot.
    assert tried == 8 * len(KNOWN) and missed <= 0.02 * tried


def test_finds_equal_brute_force_over_all_windows():
    """A template is found in a text just where some stretch of 2 n words holds 0.8 of its words in order."""
    rng = random.Random(7)
    t = lic.Template("t", "the quick brown fox jumps over a lazy dog near seven old wooden bridges")
    n = len(t.words)
    agree = found = 0
    for _ in range(150):
        text = [f"f{rng.randrange(50)}" for _ in range(60)]
        kept = [w for w in t.words if rng.random() < rng.choice([0.7, 0.85, 1.0])]
        for w in kept:
            for _ in range(rng.choice([0, 0, 1, 3])):
                text.append(f"g{rng.randrange(50)}")
            text.append(w)
        text += [f"h{i}" for i in range(40)]
        brute = any(lcs(text[i:i + 2 * n], t.words) >= t.need for i in range(len(text)))
        agree += bool(lic.scan_text(" ".join(text), [t])) == brute
        found += brute
    assert agree == 150 and 20 < found < 140


def test_stretches_of_a_long_text_lose_nothing():
    rng = random.Random(5)
    parts = []
    for i in range(60):
        parts.append(" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 40))))
        parts.append(rng.choice(list(lic.TEMPLATES.values())))
    text = " ".join(parts)
    assert lic.scan_text(text, KNOWN, stretch=150) == lic.scan_text(text, KNOWN)
