import hashlib
import random
from heapq import merge

from codeaudit.llm import warc
from codeaudit.llm.common import shared_folder

BIG = "<p>" + "é" * 700 + "</p>"
HTML = [BIG, None, "", "small", "small", BIG, "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb", BIG.upper(), "\r\n\r\n", "x" * 2_000_000, BIG]


def pages(spark):
    rows = [(i, f"http://h{i % 2}.example.org:80/A?p={i}#f", h, "20240101000000", "x") for i, h in enumerate(HTML)]
    rows += [(50, None, "no url", None, "x"), (51, "http://a\r\nb", "split", "20240101000001", "x"), (None, "http://n.org/", "nobody", "2", "x"),
             (10, "http://h0.example.org/again", BIG, "20240101000000", "x"), (60, "", BIG, "", "x")]
    rows += [(1000 + i, "http://hot.example.org/", f"v{i}", f"2024010100{i % 60:02}{i % 7:02}", "x") for i in range(400)]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, captured string, block string").repartition(7)


def test_archives_come_back_as_written(spark):
    rows, df = pages(spark)
    got = warc.archive_and_index(df).collect()
    payloads = {}
    for page_id, _, html, *_ in rows:
        payloads.setdefault((html or "").encode(), []).append(page_id)
    expected = []
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        top = max((p for p in payloads[data] if p is not None), default=None)
        again = len(data) >= 1000 and page_id != top
        expected.append((str(page_id), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                         top if again else None, (url or "").replace("\r", "%0D").replace("\n", "%0A") or None))
    assert sorted(map(str, expected)) == sorted(
        str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url)) for r in got)


def test_blocks_are_read_back_whole_and_damage_is_noticed(spark):
    rows, df = pages(spark)
    folder = shared_folder(spark, "warc-test")
    archive_id = warc.write_archives(warc.with_record_types(df), folder)
    got = warc.read_archives(spark, folder, archive_id).filter("record_type = 'response'").collect()
    by_id = {}
    for page_id, _, html, *_ in rows:
        by_id.setdefault(page_id, set()).add(html or "")
    assert all(r.block in by_id[r.page_id] for r in got)
    lines = spark.read.option("lineSep", "\n").text(folder)
    assert lines.filter("value = 'WARC/1.0\r'").count() >= len(rows)
    other = shared_folder(spark, "warc-test")
    spark.read.text(folder, wholetext=True).selectExpr("replace(value, 'no url', 'No url') AS value").write.option(
        "lineSep", "\r\n\r\n").text(other)
    try:
        warc.read_archives(spark, other, archive_id).collect()
        raise AssertionError("damage went unnoticed")
    except Exception as err:
        assert "damaged record of page 50" in str(err)


def test_runs_merge_into_one_global_order(spark):
    _, df = pages(spark)
    captures = df.drop("html", "block")
    got = warc.capture_histories(captures, range_rows=16).collect()
    assert len(got) == captures.count() and len({r.merge_range for r in got}) > 8
    ordered = sorted(got, key=lambda r: (r.merge_range, r.merge_position))
    keys = [(r.url_key, r.captured or "", -1 if r.page_id is None else r.page_id) for r in ordered]
    assert [k[0] for k in keys] == sorted(k[0] for k in keys)
    numbers, last = {}, None
    for r, k in zip(ordered, keys):
        numbers[k[0]] = numbers.get(k[0], 0) + 1
        assert r.history_no == numbers[k[0]]
        if last and last[0] == k[0] and last[1] and k[1]:
            assert last <= k
        last = k
    assert numbers["org,example,hot)/"] == 400  # one URL over many ranges
    assert warc.archive_and_index(df.limit(0)).count() == 0


def test_loser_tree_equals_heap_merge():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 12))) for _ in range(k)]
        got = [(runs[r][i], r, i) for r, i in warc.loser_tree_merge(runs)]
        assert got == list(merge(*[[(v, r, i) for i, v in enumerate(run)] for r, run in enumerate(runs)]))


def test_range_bounds_stay_few(spark):
    runs = warc.sorted_runs(spark.range(5000).selectExpr("id AS page_id", "concat('http://a.org/', id % 50) AS url", "'1' AS captured"))
    bounds = warc.range_bounds(runs, 10, sample_keys=200)
    assert len(bounds) == 9 and bounds == sorted(bounds)
