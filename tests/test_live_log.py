import datetime
import random

import pytest
from pyspark.sql import functions as F

from codeaudit.operators.provenance import check_replay, verify_chain
from codeaudit.operators.scoring import dedupe_findings
from codeaudit.queries import inputs as I
from codeaudit.session import shared_folder
from codeaudit.sources import provenance
from codeaudit.streaming.log_check import stream_check_log
from codeaudit.streaming.upsert import best_findings, windowed_best

SCHEMA = "store_id string, line_no long, record_hash string, prev_record_hash string, valid boolean, ts timestamp"


def damaged_log(rng, stores=2, n=70):
    """Lines in order, with malformed lines, broken links and replays (also of the line before, and three times)."""
    rows = []
    for s in range(stores):
        before = None
        for line in range(1, n + 1):
            own = f"h{s}-{rng.randrange(line - 5, line) if rng.random() < 0.1 else line}"
            valid = rng.random() > 0.1
            prev = f"x{line}" if rng.random() < 0.1 else before
            rows.append((f"s{s}", line, own if valid else None, prev if valid else None, valid, None))
            before = own if valid else None
    return rows


def batch_findings(spark, rows):
    lines = spark.createDataFrame(rows, SCHEMA)
    parsed = lines.select("store_id", "line_no", F.when(~F.col("valid"), "is invalid").alias("problem"),
                          F.when(F.col("valid"), F.struct("record_hash", "prev_record_hash")).alias("record"))
    records = lines.filter("valid")
    found = verify_chain(parsed).unionByName(check_replay(records)).select("store_id", "line_no", "rule", "message").collect()
    return sorted(map(tuple, found))


def streamed(spark, batches, **options):
    """Findings of a stream that gets one file a micro-batch."""
    folder = shared_folder(spark, "live")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = stream_check_log(lines, bucket=16, shards=2, **options).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.store_id, r.line_no, r.rule, r.message) for r in found)


@pytest.mark.parametrize("order", ["shuffled", "backwards", "one batch"])
def test_live_check_equals_batch_for_any_order_and_borders(spark, order):
    rng = random.Random(order)
    rows = damaged_log(rng)
    expected = batch_findings(spark, rows)
    assert {r[2] for r in expected} == {"VG-PROV-001", "VG-PROV-006"} and len(expected) > 20
    if order == "shuffled":
        rng.shuffle(rows)
    elif order == "backwards":
        rows.reverse()
    cuts = [] if order == "one batch" else sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    assert streamed(spark, batches) == expected


def test_a_gap_is_judged_when_its_time_is_over(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    first = [("s", 1, "a", None, True, at(0)), ("s", 2, "b", "a", True, at(0)), ("s", 4, "d", "c", True, at(1)), ("s", 5, "e", "d", True, at(1)),
             ("t", 1, "a", None, True, at(0)), ("t", 3, "c", "b", True, at(1))]
    late = [("t", 2, "b", "a", True, at(5)), ("u", 2, "b", "a", True, at(2))]
    # Time goes on: line 3 of s never comes, line 2 of t did.
    on = [("clock", 1, "x", None, True, at(40))]
    got = streamed(spark, [first, late, on, [("clock", 2, "y", "x", True, at(59))]], ts="ts", delay="10 minutes")
    assert got == batch_findings(spark, first + late + on) == [
        (s, n, "VG-PROV-001", f"line {n} prev_record_hash does not match the previous record") for s, n in (("s", 4), ("u", 2))]


def test_best_table_survives_repeated_and_broken_batches(spark):
    found = I.findings(spark, "/root/testdata/sf0.001").filter("seq % 3 = 0").persist()
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    batches = [found.filter(part == k) for k in range(3)]
    kept = best_findings(spark, shared_folder(spark, "best"), found.schema, buckets=4)
    assert kept.read().count() == 0
    rows = lambda df: sorted((r.project_id, r.fingerprint, r.severity, r.seq) for r in df.select("project_id", "fingerprint", "severity", "seq").collect())
    kept.merge(batches[0], 0)
    kept.merge(batches[0], 0)
    assert rows(kept.read()) == rows(dedupe_findings(batches[0]))
    # A batch that wrote its rows and died before its commit leaves no trace, and can be run again.
    commit, kept._write_commits = kept._write_commits, lambda *a: None
    kept.merge(batches[1], 1)
    kept._write_commits = commit
    assert rows(kept.read()) == rows(dedupe_findings(batches[0]))
    kept.merge(batches[1], 1)
    kept.merge(batches[2], 2)
    assert rows(kept.read()) == rows(dedupe_findings(found))
    again = best_findings(spark, kept.folder, found.schema, buckets=4)
    assert rows(again.read()) == rows(dedupe_findings(found))
    found.unpersist()


def test_windowed_state_in_front_of_the_table(spark):
    found = I.findings(spark, "/root/testdata/sf0.001").filter("seq % 5 = 0").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") % 7200))
    folder = shared_folder(spark, "windowed")
    found.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = best_findings(spark, shared_folder(spark, "best"), found.schema, buckets=2)
    kept.keep_up(windowed_best(stream, "ts", delay="3 hours"), mode="update").awaitTermination()
    rows = lambda df: sorted((r.project_id, r.fingerprint, r.severity, r.seq) for r in df.collect())
    assert rows(kept.read()) == rows(dedupe_findings(found))


def test_logs_are_numbered_over_many_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    logs = {"s1": [rng.choice(["", "{}", "x" * rng.randrange(300), "é\r", " "]) for _ in range(3000)], "s2": [""], "s3": [], "s4": ["a", "b"],
            "s5": ["", "", "only blank before", "", ""]}
    for name, lines in logs.items():
        (tmp_path / name).mkdir()
        end = "" if name == "s4" else "\n"
        (tmp_path / name / "provenance.log").write_bytes(("\n".join(lines) + end).encode() if lines else b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got = {}
    try:
        assert spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(str(tmp_path)).rdd.getNumPartitions() > 10
        for limit in (100_000, 0):
            monkeypatch.setattr(provenance, "BROADCAST_BLOCKS", limit)
            got[limit] = {}
            for r in provenance.read_provenance_log(spark, str(tmp_path)).collect():
                got[limit].setdefault(r.store_id, []).append((r.line_no, r.raw))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for read in got.values():
        assert {s: [x for _, x in sorted(v)] for s, v in read.items()} == {s: v for s, v in logs.items() if v}
        assert all(sorted(n for n, _ in v) == list(range(1, len(v) + 1)) for v in read.values())
