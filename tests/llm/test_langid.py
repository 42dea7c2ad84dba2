import random

import numpy as np
import pyarrow as pa
import pytest

from codeaudit.llm import langid

WORDS = {"en": ["the", "house", "with", "string", "thought"], "de": ["der", "über", "straße", "nicht", "schön"],
         "fr": ["été", "quelle", "maison", "les", "aujourd"]}


def say(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def corpus(rng, n):
    return [(i, say(rng, lang := rng.choice(list(WORDS)), rng.randint(5, 60)), lang, f"h{rng.randrange(3)}.example.{rng.choice(['com', 'de'])}")
            for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(random.Random(1), 300)
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(900, None, "en"), (901, "x", None)], "id long, text string, lang string")
    return langid.fit_text_model(df)


def judged(spark, model, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "id long, text string, declared string, host string, language string, score double")
    return {r.id: r for r in langid.identify(df, model, ["id"]).collect()}


def test_held_out_accuracy(spark, model):
    rows = corpus(random.Random(2), 300)
    got = judged(spark, model, [(i, t, None, h) for i, t, _, h in rows])
    assert np.mean([got[i].language == lang for i, _, lang, _ in rows]) > 0.98
    assert all(r.kept for r in got.values())


def test_each_kind_of_evidence_counts(spark, model):
    rng = random.Random(3)
    rows = [(100 + i, say(rng, "fr", 30), "fr", "www.paris.example") for i in range(40)]
    rows += [(1, "", "de", "elsewhere"), (2, None, "fr-CA", None), (4, "", None, "www.paris.example"),
             (5, "", None, "other.paris.example"), (6, say(rng, "en", 40), "de", "x.de"), (7, None, "klingon", None)]
    got = judged(spark, model, rows)
    assert [got[i].language for i in (1, 2, 4, 5, 6)] == ["de", "fr", "fr", "fr", "en"]
    assert judged(spark, model, [(3, "", None, "x.de")])[3].language == "de"
    assert got[1].text_language is None and got[6].text_language == "en"
    assert got[2].declared == "fr" and got[2].host == ""


def test_foreign_script_is_rejected_and_languages_are_kept(spark, model):
    rng = random.Random(4)
    foreign = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    got = judged(spark, model, [(1, foreign, None, "a"), (2, say(rng, "de", 1), "de", "a"), (3, say(rng, "en", 20_000), None, "b"), (3, "", None, "b")])
    assert (got[1].language, got[1].kept) == ("und", False) and got[2].kept


def test_scores_equal_a_plain_sum(model, spark):
    texts = ["The house!", "", None, "ab", "abc", "über  12 straße"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.score for r in langid.text_scores(df, model, ["id"]).collect()}
    for i, text in enumerate(texts):
        u = [b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode()]
        grams = [t for t in zip(u, u[1:], u[2:]) if t != (32, 32, 32)]
        ids = [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 17 for a, b, c in grams]
        n = len(ids)
        expected = [float(t[ids].astype(np.float64).sum()) / n * (40 * n / (40 + n)) if n else 0.0 for t in model[1]]
        assert got[i] == pytest.approx(expected, abs=1e-6)


def test_chunks_do_not_change_trigrams(monkeypatch):
    column = pa.array([b"abcdef", b"", None, b"xy", b"hello world again", b"z"], pa.binary()).slice(1)

    def gathered():
        total = {}
        for rows, begins, bucket, valid in langid.trigrams(column):
            stops = np.append(begins[1:], len(bucket))
            for row, a, b in zip(rows, begins, stops):
                total.setdefault(int(row), []).extend(bucket[a:b][valid[a:b]].tolist())
        return {k: v for k, v in total.items() if v}

    whole = gathered()
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert gathered() == whole


def test_nothing_labelled_and_empty_tables(spark, model, docs_of):
    assert langid.fit_text_model(spark.createDataFrame([(1, "x", None)], "id long, text string, lang string")) is None
    got = judged(spark, None, [(1, "x", "en", None)])
    assert (got[1].language, got[1].kept, got[1].host) == (None, True, "")
    assert judged(spark, model, [])  == {}
    docs = docs_of([(1, "x", None), (2, None, None)])
    assert langid.keep_identified(docs).count() == 2 and langid.keep_identified(docs.limit(0)).count() == 0


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML class=a lang="fr-CA"><script>var the = "<b>";</script><!-- x --><p>Été</p></html>'
    df = spark.createDataFrame([(1, "http://A.Example.fr:80/x", html, 1), (2, None, None, 1)], "page_id long, url string, html string, text int")
    a, b = langid.page_evidence(df).orderBy("page_id").collect()
    assert (a.text.split(), a.declared, a.host) == (["Été"], "fr", "a.example.fr:80") and (b.text, b.declared, b.host) == ("", None, "")
