import importlib
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from codeaudit.llm import langid, queries
from test_decontaminate import brute as brute_contained
from test_dedup import AZ
from test_similar import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "exact dedup":
            last = {}
            for d, t in kept.items():
                last[t.translate(AZ)] = max(d, last.get(t.translate(AZ), d))
            kept = {d: kept[d] for d in last.values()}
        elif name == "near-dedup":
            before = len(kept)
            kept = dict(brute_kept(sorted(kept.items()))[0])
            assert len(kept) < before
        elif name == "benchmark decontamination":
            bad = {d for d, *_ in brute_contained(list(kept.items()), items)}
            assert bad
            kept = {d: t for d, t in kept.items() if d not in bad}
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == kept, name
    parts = docs.collect()
    assert {p.doc_id for p in parts} <= set(kept)
    assert all(p.text.split() == kept[p.doc_id].split()[p.first_word:p.first_word + p.words] for p in parts)
    total = sum(len(t.split()) for t in kept.values())
    assert abs(sum(p.words for p in parts) - 1.5 * total) <= 10


def test_stages_carry_columns_of_any_name(spark, docs_of):
    """Names that the stages use inside, and a dot, on rows that stay and rows that go."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = " ".join(f"word{i}" for i in range(60))
    names = ["mark", "row", "__mark", "__node", "__salt", "node", "name", "cells", "a.b", "tag", "key", "salt"]
    docs = docs_of([(1, text), (2, text + " more"), (3, f"so {item} it is"), (4, "the house and the string of thoughts"), (None, None)])
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-len(names):] == names
    left = docs.collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "4", "None"]
    assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for r in left for n in names)


def test_language_stage_drops_only_what_is_rejected(spark, docs_of):
    rows = [(i, f"the house of the thoughts number and the string {i}") for i in range(50)] + [(99, "言" * 50 + "語" * 300, None), (None, None, None)]
    left = {r.doc_id for r in langid.keep_identified(docs_of(rows)).collect()}
    assert left == {r[0] for r in rows} - {99}


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    registered = entry.queries()
    assert set(queries.QUERIES) < set(registered) and registered["pipeline"] is corpus_pipeline.run
    assert [sum(q.startswith(f"op{n}_") for q in registered) for n in range(1, 14)] == [1] * 13
    assert set(queries.ORACLES) < set(entry.oracle_sql())
    ran = corpus_pipeline.run(spark, SF)
    assert ran.count() > 0 and ran.columns == ["shard", "sid", "slot", "doc_id", "source", "first_word", "words", "text"]


def test_entry_without_the_training_modules(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("codeaudit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("corpus_pipeline", "codeaudit.llm", "codeaudit.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    # A None in sys.modules makes the import raise ModuleNotFoundError with that name.
    assert not any(q.startswith("op") or q == "pipeline" for q in importlib.reload(entry).queries())
    assert entry.oracle_sql()
