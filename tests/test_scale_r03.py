"""Steps whose driver memory or shuffled bytes grew faster than their input."""

from pyspark.sql import functions as F

from codeaudit.operators import graph as G
from codeaudit.session import tune


def test_import_joins_send_no_large_side_to_the_driver(spark):
    """100,000 files are about 5 MB for the planner, and many times that as a hash table in the driver."""
    n = F.col("id")
    files = tune(spark).range(100_000).select(
        F.concat(F.lit("proj"), F.floor(n / 100)).alias("project_id"), F.concat(F.lit("lib/f"), n % 100, F.lit(".js")).alias("path"),
        F.when(n % 100 >= 2, F.concat(F.lit("const x = require('./f"), n % 100 - 2, F.lit("');"))).otherwise("").alias("content"))
    edges = G.import_edges(files)
    assert edges.count() == 98_000
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()


def _findings(spark, rows):
    from codeaudit.functions.findings import build_findings

    raw = spark.createDataFrame(rows, "project_id string, seq long, tool string, category string, severity string, file string, "
                                      "line int, column int, rule string, message string, suggestedFix string")
    return raw, build_findings(raw)


ODD = [("p", 1, "ruff", "bug", "LOW", "a.py", 3, None, "", "m", None), ("p", 1, "ruff", "bugs", "LOW", "a.py", 3, None, None, "m", None),
       ("p", 2, "ruff", "bugs", None, "a.py", 3, 1, "r", "m", "f"), ("p", 3, "ruff", "bugs", "BLOCKER", "a.py", 3, 1, "r", "m", "f"),
       ("p", 3, "ruff", "bugs", "BLOCKER", "a.py", 3, 1, "r", "l", "f"), (None, 3, "ruff", "bugs", "HIGH", "a.py", 3, 1, "r", "m", "f"),
       (None, 1, "ruff", "bugs", "HIGH", "a.py", 3, 1, "r", "m", "f"), ("p", 9, "ruff", "bugs", "INFO", "a.py", None, 1, "r", "m", "f")]


def test_dedupe_moves_only_what_is_read(spark):
    """A score reads severities: suggested fixes do not pass through the shuffle."""
    from codeaudit.operators import scoring as A

    _, found = _findings(spark, ODD)
    kept = A.dedupe_findings(found).select("project_id", "seq", "severity", "message")
    shuffled = [line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in line or "Scan" in line]
    assert shuffled and not any("suggestedFix" in line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
                                if "Window" in line or "Project" in line)
    # No severity sorts first, as in the rank of the list; equal seq is decided by the message.
    assert sorted(map(str, kept.collect())) == sorted([
        "Row(project_id='p', seq=2, severity=None, message='m')", "Row(project_id='p', seq=9, severity='INFO', message='m')",
        "Row(project_id=None, seq=1, severity='HIGH', message='m')"])


def test_distinct_findings_equal_the_distinct_rows_of_built_ones(spark):
    from codeaudit.functions.findings import distinct_findings

    raw, found = _findings(spark, ODD + ODD)
    assert sorted(map(str, distinct_findings(raw).collect())) == sorted(map(str, found.distinct().collect()))
    assert distinct_findings(raw).count() == 7


def test_longer_tables_are_dealt_to_more_tasks(spark):
    from codeaudit.queries import inputs as I

    assert I.dealt(spark.range(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert I.dealt(spark.range(8 * I.DEALT_ROWS + 1)).rdd.getNumPartitions() == 9


def test_lineage_walks_line_numbers_instead_of_hashes(spark, monkeypatch):
    from codeaudit.operators import provenance as P

    ref = "array<struct<artifact:string,sha256:string>>"
    rows = [("s", 1, "a", [], ["m"]), ("s", 2, "b", ["a"], ["x"]), ("s", 3, "a", ["gone"], ["y"]), ("s", 4, "c", ["b", "c"], ["m"]), ("t", 1, "c", ["c", "d"], ["m"])]
    records = spark.createDataFrame([(s, n, h, p, [], [(o, "0") for o in out]) for s, n, h, p, out in rows],
                                    f"store_id string, line_no long, record_hash string, parent_record_hashes array<string>, inputs {ref}, outputs {ref}")
    walked, walk = [], P.reachable
    monkeypatch.setattr(P, "reachable", lambda edges, roots, *names: walked.extend([edges, roots]) or walk(edges, roots, *names))
    wanted = spark.createDataFrame([("s", "m"), ("s", "m"), ("t", "m"), ("t", "z")], "store_id string, artifact string")
    # A repeated hash is one record: its last line.
    assert sorted(map(tuple, P.lineage(records, wanted).collect())) == [("s", "m", 2, "b"), ("s", "m", 3, "a"), ("s", "m", 4, "c"), ("t", "m", 1, "c")]
    assert [dict(walked[0].dtypes)[c] for c in ("_src", "_dst")] + [dict(walked[1].dtypes)["_node"]] == ["bigint"] * 3


def test_best_table_appends_batches_and_merges_them_by_levels(spark, monkeypatch):
    from codeaudit.operators.scoring import dedupe_findings
    from codeaudit.session import shared_folder
    from codeaudit.streaming import upsert as U

    raw, _ = _findings(spark, ODD)
    rows = [(r.project_id, n, *r[2:6], f"{n % 5}.py", *r[6:]) for n, r in enumerate(raw.collect() * 3)]
    _, found = _findings(spark, [(*r[:6], *r[7:]) for r in rows])
    found = found.persist()
    kept = U.best_findings(spark, shared_folder(spark, "best"), found.schema, buckets=2)
    told = lambda df: sorted(map(str, df.select("project_id", "fingerprint", "severity", "seq", "message").collect()))
    batches = [found.filter(F.col("seq") % 5 == k) for k in range(5)]
    written = lambda g: spark.read.parquet(f"{kept.folder}/rows/generation={g}").count()
    for k, batch in enumerate(batches[:3]):
        kept.merge(batch, k)
        # A batch writes its own rows only, however many the table holds.
        assert written(k) == dedupe_findings(batch).count()
    monkeypatch.setattr(U, "FAN", 2)
    for k, batch in enumerate(batches[3:], start=3):
        kept.merge(batch, k)
        kept.merge(batch, k)
        assert told(kept.read()) == told(dedupe_findings(found.filter(F.col("seq") % 5 <= k)))
    assert max(level for _, _, level in kept._current()) >= 1
    kept.merge(found.limit(0), 5)
    assert told(kept.read()) == told(dedupe_findings(found))
    found.unpersist()


def test_longer_streams_come_in_more_files(spark, monkeypatch):
    from codeaudit.queries import inputs as I
    from codeaudit.queries import q_streaming as Q

    monkeypatch.setattr(I, "DEALT_ROWS", 10)
    lines = Q.in_batches(spark, "/root/testdata/sf0.001", "events", *Q.BATCHED["events"])
    files = lines.sparkSession.read.parquet(lines._jdf.queryExecution().analyzed().collectLeaves().head().dataSource().options().apply("path"))
    assert len(files.inputFiles()) > 32 and files.columns == ["event_id"] and files.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_replay_state_is_written_by_shard_and_not_by_hash(monkeypatch):
    import pandas as pd

    from codeaudit.streaming import log_check as L

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Map(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    def told(check, batches):
        return sorted(r[1] for rows in batches for r in check._replays("s", iter([pd.DataFrame(rows, columns=["record_hash", "line_no"])])))

    lines = [(f"h{n % 70}", n) for n in range(200)]
    batches = [lines[150:], lines[:100], lines[100:150]]
    for recent in (1000, 10):
        monkeypatch.setattr(L, "RECENT", recent)
        check = L.LogCheck(64, False)
        check.recent, check.first = Value(), Map()
        assert told(check, batches) == list(range(70, 200))
        if recent == 1000:
            assert check.recent.calls == 6 and check.first.calls == 0
        else:
            assert {k[0]: v[0] for k, v in check.first.items()} | dict(zip(*check.recent.held[:2])) == {f"h{n}": n for n in range(70)}


def test_file_rules_run_after_the_files_are_dealt_out(spark):
    """Rules that reach below the repartition run in the few tasks that read the table, and once more above it."""
    from codeaudit.operators.one_pass import tagged_rows

    files = spark.range(10).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), "id", F.lit(".js")).alias("path"),
                                   F.concat(F.lit("eval(x);\nrequire('./f"), "id", F.lit("');")).alias("content"))
    rows = tagged_rows(files, ["security"], partitions=3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Filter" not in plan.split("Repartition 3", 1)[1]
    assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    assert rows.groupBy("tag").count().filter("tag = 'path'").first()["count"] == 10


def test_the_verdict_is_planned_by_dimension(spark):
    """The driver plans one dimension at a time: the verdict's own plan holds none of the checks below it."""
    from codeaudit.operators import assurance as AS

    found = spark.createDataFrame([], "store_id string, rule string, severity string, path string, detail string, message string")

    def checked(columns, rows):
        names = columns.split(", ")
        kept = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'line_no' else 'string'}" for n in names))
        return found, kept.groupBy(*names[:-1]).agg(F.max(names[-1]).alias(names[-1]))

    named = "store_id, name, version, status"
    runs = checked("store_id, line_no, output_status, status", [("a", 4, "PASS", "PASS"), ("a", 10, "FAIL", "PASS"), ("b", 1, "NOT_CHECKED", "PASS")])
    _, verdicts = AS.assurance_report(
        checked(named, [("a", "d", "1", "PASS"), ("a", "e", "1", "UNANCHORED"), ("b", "d", "1", "PASS")]),
        checked("store_id, id, version, status", [("a", "m", "1", "PASS"), ("b", "m", "1", "PASS")]),
        checked(named, [("a", "p", "1", "PASS")]), runs, checked("store_id, status", [("a", "UNSIGNED"), ("b", "PASS")]))
    assert verdicts._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert sorted(tuple(r[c] for c in ("store_id", *AS.DIMENSIONS, "overall", "failed_dimensions")) for r in verdicts.collect()) == [
        ("a", "UNANCHORED", "PASS", "PASS", "PASS", "FAIL", "UNSIGNED", AS.VIOLATION, "output"),
        ("b", "PASS", "PASS", "NOT_CHECKED", "PASS", "NOT_CHECKED", "PASS", AS.INCOMPLETE, "")]


def _dedups(df):
    """Shuffles by fingerprint in the plan of `df`."""
    return sum("Exchange hashpartitioning" in line and "fingerprint" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_gate_counts_findings_while_it_reads_them(spark):
    """The gate's own count of findings: no second dedup of the same findings beside it."""
    from codeaudit.operators import scoring as A
    from codeaudit.queries import QUERIES

    assert _dedups(QUERIES["gate_exit"](spark, "/root/testdata/sf0.001")) == 1
    _, found = _findings(spark, ODD)
    gate = A.deploy_readiness(A.dedupe_findings(found))
    # A project without a name has a gate as well.
    assert sorted(map(str, gate.select("project_id", "findings").collect())) == ["Row(project_id='p', findings=2)", "Row(project_id=None, findings=1)"]
    assert sorted((r.project_id or "", r.exit_code) for r in A.gate_exit(gate).collect()) == [("", 1), ("p", 1)]


def test_scores_of_a_merged_scan_read_the_findings_once(spark):
    from codeaudit.operators import assurance as AS
    from codeaudit.operators.scoring import dedupe_findings, project_score
    from codeaudit.queries import QUERIES

    assert _dedups(QUERIES["merge_into_scan"](spark, "/root/testdata/sf0.001")) == 1
    report = spark.createDataFrame(
        [("p", 1, "VG-DATA-001", "BLOCKER", "d"), ("p", 2, "VG-DATA-001", "HIGH", "d"), ("p", 3, "VG-DATA-002", "HIGH", "d"),
         ("q", 4, "VG-DATA-001", "WARN", None), (None, 5, "VG-DATA-001", "HIGH", "d")],
        "project_id string, seq long, rule string, severity string, path string").withColumn("detail", F.lit("x"))
    # Findings that are there already: one of the report's own ids (twice, by category), and one of a project without a name.
    _, found = _findings(spark, ODD + [(p, 9, "assurance", c, "LOW", "d", None, None, "VG-DATA-001", "m", None)
                                       for p, c in (("p", "security"), ("p", "bugs"), (None, "security"))])
    verdicts = spark.createDataFrame([("p", AS.VIOLATION, "dataset")], "store_id string, overall string, failed_dimensions string")
    merged, scores = AS.merge_into_scan(dedupe_findings(found), report, verdicts)
    names = ["project_id", "total", "blocker", "high", "low", "score", "penalty", "breakdown"]
    assert sorted(map(str, scores.select(names).collect())) == sorted(map(str, project_score(merged).select(names).collect()))
    assert sorted((r.project_id or "", r.total, r.blocker) for r in scores.collect()) == [("", 3, 0), ("p", 5, 0), ("q", 1, 0)]


def test_longer_tables_are_shuffled_to_more_tasks(spark, monkeypatch):
    """A task after a shuffle sorts no more rows than one before it, whatever number the session starts with."""
    from codeaudit.operators.scoring import dedupe_findings
    from codeaudit.queries import inputs as I

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = spark.newSession()
    rows = own.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    I.dealt(own.range(10))
    assert own.conf.get(name, None) is None
    monkeypatch.setattr(I, "DEALT_ROWS", 100)
    found = dedupe_findings(I.findings(own, "/root/testdata/sf0.001"))
    tasks = -(-rows // 100)
    assert own.conf.get(name) == str(tasks) and f", {tasks})" in "".join(
        line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)
    I.dealt(own.range(10))
    assert own.conf.get(name) == str(tasks)
