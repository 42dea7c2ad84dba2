import random

from codeaudit.llm import langid
from test_langid import say


def test_rare_languages_keep_a_table_at_every_size(spark):
    rng = random.Random(11)
    rows = [(i, say(rng, "en", 12), "en") for i in range(3000)]
    rows += [(9000 + i, say(rng, "de", 12), "de") for i in range(3)] + [(9100, "été quelle maison", "fr"), (9200, " 12 ", "xx"), (9201, "ab", "yy")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    for sample_rows in (langid.SAMPLE_ROWS, 20, 1):
        assert langid.fit_text_model(df, sample_rows)[0] == ["de", "en", "fr", "und"]


def test_rare_clean_documents_of_a_foreign_script_stay(spark, docs_of):
    rng = random.Random(12)
    rows = [(i, say(rng, "en", 12), "en") for i in range(3000)]
    rows += [(9000 + i, "".join(rng.choices("東西南北春夏秋冬", k=150)), "ja") for i in range(3)]
    docs = docs_of(rows)
    model = langid.document_model(docs, 20)
    judged = langid.identify(langid.document_evidence(docs), model, ["doc_id"]).filter("doc_id >= 9000").collect()
    assert [(r.language, r.kept) for r in judged] == [("ja", True)] * 3
