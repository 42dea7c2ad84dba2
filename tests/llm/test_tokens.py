import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeaudit.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a", "aaaaaaaaaaaaaaaaaaaa", "AAA aaa", "<|endoftext|> hi <|startoftext|>", "<|ENDOFTEXT|>", "it's I'LL we've 'S",
       "ΣΊΣΥΦΟΣ Σ", "İstanbul", "naïve café é", "日本語 テスト", "a b c\x85d\x1ce", "½ ²³ ١٢٣ 12345", "🙂🙂 👩‍👩‍👧", "x" * 3000,
       "\x00\x01", "«quoted»—dash…", "word­soft", "ﬁne", "ǅ ß ẞ", "'s't're", "a<|endoftext|>b", "a" * 20 + "b" * 21, "no break"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    wide = [chr(c) for r in ((32, 127), (0xA0, 0x250), (0x300, 0x310), (0x390, 0x3D0), (0x400, 0x460), (0x4E00, 0x4E10),
                             (0x1F600, 0x1F610)) for c in range(*r)] + [" ", "\n", "'", "ss", "the"] * 20
    latin = [chr(c) for c in range(32, 0x250) if not 127 <= c <= 0xA0 and c != 0xAD] + [" ", "\n", "the"] * 20
    return ODD + ["".join(rng.choices(a, k=rng.randint(1, 150))) for a in (wide, latin) for _ in range(400)]


def test_counts_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_CHARS", 5000)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 50)
    rows = list(enumerate(texts())) + [(None, "two words"), (0, "again")]
    got = tokens.token_counts(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int"), limit=60)
    expected = [(str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 60)
                for i, t in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted(expected)
    assert tokens.token_counts(got.selectExpr("doc_id", "'' AS text").limit(0)).count() == 0


def test_merging_a_long_pre_token_and_overlaps(library):
    import json

    with open(PATH) as f:
        merges = tokens.Merges(json.load(f))
    words = ["a" * n for n in range(1, 40)] + ["abcabcabc" * 50, "in" * 33, "the" * 101]
    got = merges.count([w.encode() for w in words]).tolist()
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merges.count([]).tolist() == []
