import corpus_pipeline
from codeaudit.llm import decontaminate
from test_decontaminate import brute, sample


def test_rows_are_judged_by_their_own_text(spark, docs_of):
    rows, items = sample()
    half = items[8][1].split()
    rows += [(None, " ".join(half[: len(half) // 2 + 2])), (None, " ".join(half[len(half) // 2 - 2:])), (2004, "a clean text of an id that stands elsewhere")]
    docs, benchmark = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    bad = {n for n, *_ in brute([(n, t) for n, (_, t) in enumerate(rows)], items)}
    left = decontaminate.drop_contaminated_rows(docs, benchmark)
    assert left.columns == docs.columns
    expected = sorted((str(d), str(t)) for n, (d, t) in enumerate(rows) if n not in bad)
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == expected
    assert ("None", "nothing") in expected and ("2004", rows[-1][1]) in expected


def test_the_stage_keeps_clean_rows_without_an_id(spark, docs_of):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    docs = docs_of([(None, items.text), (None, "clean"), (1, "clean too"), (1, f"so {items.text}")])
    left = corpus_pipeline.decontaminate(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(r.text for r in left) == ["clean", "clean too"]
