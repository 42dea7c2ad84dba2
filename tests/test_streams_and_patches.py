import os

from pyspark.sql import functions as F

from codeaudit.operators import ai as AI
from codeaudit.operators.patches import apply_snippet
from codeaudit.operators.provenance import verify_chain
from codeaudit.operators.scan_rules import scan_rules
from codeaudit.queries import QUERIES
from codeaudit.queries import inputs as I
from codeaudit.sources.corpus import hash_files, read_corpus
from codeaudit.sources.sinks import append_history, read_history, write_findings

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_scan_equals_batch(spark):
    batch = scan_rules(I.document_files(spark, SF), ["security"]).select("project_id", "file", F.col("line").cast("long"), "rule")
    assert rows(QUERIES["stream_scan"](spark, SF)) == rows(batch)


def test_stream_chain_equals_batch(spark):
    batch = verify_chain(I.log_lines(spark, SF)).select("store_id", "line_no", "rule")
    assert rows(QUERIES["stream_chain"](spark, SF).select("store_id", "line_no", "rule")) == rows(batch)


def test_snippets_apply_in_four_ways():
    text = "a\n  b  \nc\nd = e"
    assert apply_snippet(text, "c", "C", 3) == "a\n  b  \nC\nd = e"
    assert apply_snippet(text, "  b\nc", "X", 2) == "a\nX\nd = e"
    assert apply_snippet("x\n\tb(1)\ny", "b(1) ", "z", 2) == "x\nz\ny"
    assert apply_snippet("x\ny\nq b(1) w", "  b(1)", "z", 1) == "x\ny\nq z w"
    assert apply_snippet(text, "nothing here", "z", 1) is None


def test_responses_strict(spark):
    df = spark.createDataFrame([('{"explanation":"e","severity":"LOW","confidence":0.4,"falsePositiveProbability":0,"impact":"i","suggestedFix":"s"}',),
                                ('{"severity":"LOW"}',), ("none",)], "response string")
    kept = df.select(AI.parse_response(F.col("response"), strict=True).alias("a")).filter("a IS NOT NULL")
    assert [(r.a.severity, r.a.confidence) for r in kept.collect()] == [("LOW", 0.4)]


def test_corpus_from_folders(spark, tmp_path):
    for path, text in (("p1/src/a.js", "eval(x)"), ("p1/node_modules/b.js", "eval(x)"), ("p2/c.py", "é = 1"), ("p2/d.png", "x"), ("p2/.hid/e.py", "")):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    got = {(r.project_id, r.path, r.content) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert got == {("p1", "src/a.js", "eval(x)"), ("p2", "c.py", "é = 1")}
    # Hidden files are hashed as well.
    assert hash_files(spark, str(tmp_path / "p2")).count() == 3


def test_sinks(spark, tmp_path):
    found = I.findings(spark, SF).limit(50)
    write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 50
    scans = spark.createDataFrame([("p", 1, 90, "A", 3)], "project_id string, seq long, score int, grade string, findingsCount long").withColumn("ts", F.current_timestamp())
    append_history(scans, str(tmp_path / "h"))
    append_history(scans, str(tmp_path / "h"))
    assert read_history(spark, str(tmp_path / "h")).count() == 2
