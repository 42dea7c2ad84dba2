"""WARC archives with revisit records, and the merge of their sorted capture runs.

Writing.  One record per page; its payload is the html in UTF-8.  Of records with
equal payloads of at least `smallest` = 1000 bytes the one with the largest
page_id is a response and the others are revisits without a block.  Spark's text
writer puts the records into archive files, so a lost task leaves no half file:
the separator of rows is the blank line that ends a record.

Reading.  Every record names its archive set right after the version line, by an
id drawn for that set.  That head separates the records for Spark's text reader,
so large archives are read in splits.  Block lengths and digests are checked;
a record that does not agree fails the job.

Index.  The captures of a read task, sorted by URL key, timestamp and page id,
are one run on shared storage.  Regular samples of the runs (a bounded number of
keys in all) cut the keys into ranges.  A range's piece of every run goes to one
task, and a loser tree merges the pieces.  The key is unique to the page, so a
host or URL with a third of all captures is cut like any other.  Ranges and
positions in them are the global order; `history_no` numbers the captures of a
URL across ranges.

Defined results: null html is an empty payload; a null url has no target header,
the URL key '' and is read back as null; line breaks in a url are written as %0D
and %0A.  A null page_id sorts first.  Rows that repeat the page_id of a response
are responses too.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import join_checked, shared_folder, stored

SMALLEST = 1000
MAX_RUNS = 4096
SAMPLE_KEYS = 100_000
RANGE_ROWS = 100_000
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY = ["url_key", "captured", "page_order"]


def with_record_types(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, captured, payload, payload_bytes, payload_digest, record_type and refers_to of pages.

    `pages` has page_id, url, html and captured (14 digits or null).
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("captured", F.lit("")).alias("captured"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload.cast("binary")).alias("payload_digest"),
                        F.xxhash64(payload).alias("second_digest"))
    same = ["payload_digest", "second_digest", "payload_bytes"]
    shared = rows.filter(F.col("payload_bytes") >= smallest).groupBy(*same).agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = join_checked(rows, stored(shared), same, "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return marked.select(
        "page_id", "url", "captured", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"))


def _head(archive_id: str) -> str:
    return f"WARC/1.0{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive_id}>{CRLF}"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archives(records: DataFrame, folder: str) -> str:
    """Write what `with_record_types` returns below folder; returns the id of the archive set."""
    archive_id = str(uuid.uuid4())
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.regexp_replace("captured", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    value = F.concat(
        F.lit(_head(archive_id)), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", urn(F.col("page_id"))),
        _line("WARC-Target-URI", url), _line("WARC-Date", F.when(date != "", date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Refers-To", urn(F.col("refers_to"))), _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")), F.lit(f"Content-Type: text/html{CRLF}"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)
    records.select(value.alias("value")).write.option("lineSep", CRLF + CRLF).text(folder)
    return archive_id


def read_archives(spark: SparkSession, folder: str, archive_id: str) -> DataFrame:
    """page_id, url, captured, record_type, refers_to, payload_bytes, payload_digest and block of the records."""
    raw = spark.read.option("lineSep", _head(archive_id)).text(folder).filter("value <> ''")
    head = F.concat(F.lit(CRLF), F.substring_index("value", CRLF + CRLF, 1), F.lit(CRLF))
    cut = raw.withColumn("head", head)
    # The head stands between two line breaks of its own, and a record ends with a blank line.
    block = F.substr("value", F.char_length("head") + 1, F.char_length("value") - F.char_length("head") - 4)

    def field(name: str, pattern: str = r"([^\r]*)") -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))

    record = cut.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.coalesce(F.regexp_replace(field("WARC-Date"), "[^0-9]", ""), F.lit("")).alias("captured"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"), field("WARC-Payload-Digest", "sha1:([0-9a-f]*)").alias("said"),
        field("Content-Length").cast("long").alias("length"), block.alias("block"))
    seen = F.when(F.col("record_type") == "revisit", F.col("said")).otherwise(F.sha1(F.col("block").cast("binary")))
    agrees = (F.octet_length("block") == F.col("length")) & (seen == F.col("said"))
    checked = F.when(F.coalesce(agrees, F.lit(False)), seen).otherwise(
        F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return record.select("page_id", "url", "captured", "record_type", "refers_to", "payload_bytes",
                         checked.alias("payload_digest"), "block")


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, in lower case: com,example)/a?b=c."""
    full = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(full, r"://([^/?#:]*)", 1)
    rest = F.regexp_extract(full, r"://[^/?#]*([^#]*)", 1)
    return F.when(host == "", full).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def loser_tree_merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of every element of the sorted runs, in order; equal elements in the order of their runs."""
    k = len(runs)
    at = [0] * k

    def key(r: int):
        return (1,) if at[r] >= len(runs[r]) else (0, runs[r][at[r]], r)

    # losers[1:] are the inner nodes of a complete tree whose leaf of run r is node k + r.
    losers = [0] * max(k, 1)
    winner_of = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner_of[2 * node], winner_of[2 * node + 1]
        winner_of[node], losers[node] = (a, b) if key(a) <= key(b) else (b, a)
    winner = winner_of[1] if k > 1 else 0
    for _ in range(sum(map(len, runs))):
        yield winner, at[winner]
        at[winner] += 1
        best, node = key(winner), (winner + k) // 2
        while node:
            other = key(losers[node])
            if other < best:
                winner, losers[node], best = losers[node], winner, other
            node //= 2


def sorted_runs(captures: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    """The partitions of captures as stored runs, each sorted by KEY."""
    ordered = captures.withColumns({
        "url_key": url_key(F.col("url")), "captured": F.coalesce("captured", F.lit("")),
        "page_order": F.coalesce("page_id", F.lit(-(2 ** 63)))})
    return stored(ordered.coalesce(max_runs).sortWithinPartitions(*KEY))


def _keys(rows: pa.Table | pa.RecordBatch | pa.StructArray) -> list[tuple]:
    columns = [rows.field(k) if isinstance(rows, pa.StructArray) else rows.column(k) for k in KEY]
    return list(zip(*(c.to_pylist() for c in columns)))


def range_bounds(runs: DataFrame, ranges: int, sample_keys: int = SAMPLE_KEYS) -> list[tuple]:
    """Keys that cut the runs into ranges of like size, from regular samples of at most `sample_keys` keys in all."""
    n_runs = max(1, runs.rdd.getNumPartitions())
    every = max(1, -(-runs.count() // max(1, sample_keys - n_runs)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % every, batch.num_rows, every), pa.int64()))
            seen += batch.num_rows

    keys = sorted(map(tuple, runs.select(*KEY).mapInArrow(sample, runs.select(*KEY).schema).collect()))
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of the runs with merge_range and merge_position, which are their global order by KEY."""
    from bisect import bisect_left

    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    bounds = spark.sparkContext.broadcast(range_bounds(runs, ranges))
    row_type = runs.schema.simpleString()
    names = runs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's rows as one list for each range, in order."""
        from pyspark import TaskContext

        run, part = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch)
            ends = [bisect_left(keys, b) for b in bounds.value] + [len(keys)]
            starts = [0] + ends[:-1]
            full = [i for i, (a, b) in enumerate(zip(starts, ends)) if b > a]
            rows = pa.StructArray.from_arrays(batch.columns, names=names)
            lists = pa.ListArray.from_arrays(pa.array([starts[i] for i in full] + [len(keys)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([run] * len(full), pa.int32()), pa.array([part] * len(full), pa.int32()), lists],
                names=["merge_range", "run", "part", "rows"])
            part += 1

    def merged(number: int, pieces: list[pa.StructArray]) -> pa.RecordBatch:
        rows = pa.concat_arrays(pieces)
        base = [0]
        for piece in pieces:
            base.append(base[-1] + len(piece))
        order = pa.array([base[r] + i for r, i in loser_tree_merge([_keys(p) for p in pieces])], pa.int64())
        columns = [pc.take(rows.field(n), order) for n in names]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([number] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())],
            names=[*names, "merge_range", "merge_position"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces arrive sorted by range, run and part; one range is held at a time."""
        held, pieces, last = None, [], None
        for batch in batches:
            for number, run, _, piece in zip(*(batch.column(i) for i in range(4))):
                number, run, piece = number.as_py(), run.as_py(), piece.values
                if number != held:
                    if pieces:
                        yield merged(held, pieces)
                    held, pieces, last = number, [], None
                if run == last:
                    pieces[-1] = pa.concat_arrays([pieces[-1], piece])
                else:
                    pieces.append(piece)
                last = run
        if pieces:
            yield merged(held, pieces)

    cut_runs = runs.mapInArrow(cut, f"merge_range int, run int, part int, rows array<{row_type}>")
    placed = cut_runs.repartitionById(ranges, "merge_range").sortWithinPartitions("merge_range", "run", "part")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return placed.mapInArrow(merge, f"{fields}, merge_range int, merge_position long")


def capture_histories(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures in their global order, each with its number in the history of its URL key."""
    merged = stored(merge_runs(sorted_runs(captures), range_rows))
    inside = F.row_number().over(Window.partitionBy("merge_range", "url_key").orderBy("merge_position"))
    counts = merged.groupBy("url_key", "merge_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("url_key").orderBy("merge_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("earlier", F.sum("n").over(earlier)).filter("earlier > 0").drop("n"))
    numbered = join_checked(merged.withColumn("inside", inside), offsets, ["url_key", "merge_range"], "left")
    return numbered.withColumn("history_no", F.col("inside") + F.coalesce("earlier", F.lit(0))).drop(
        "inside", "earlier", "page_order")


def archive_and_index(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html, captured) as archives, read them back, and merge their index."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    archive_id = write_archives(with_record_types(pages), folder)
    return capture_histories(read_archives(spark, folder, archive_id).drop("block"))
