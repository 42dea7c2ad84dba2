"""Live check of append-only logs: broken links, malformed lines and replays, as lines arrive in any order.

The stream is one stateful operator.  Its key is (store, part): parts are runs of
`LINES_PER_BUCKET` line numbers, for links, and shards of record hashes, for
replays, so a busy store is spread over as many keys as its log has runs and
shards.  A line goes to its run and its shard; the last line of a run also goes to the next one.

* Links.  A line can be judged when the line before is known.  The state of a run
  holds only lines that still wait for a neighbour, the open ends of what has
  come: one entry for a log that arrives in order.
* Gaps.  With an event time, a line whose predecessor has not come by the time the
  watermark passes is judged by a timer, against the nearest earlier line of its
  run that has come, as the batch check does in a log with a gap.
* Replays.  The state of a shard maps every hash to its smallest line so far.  Of
  two lines of one hash the later line is reported when the second one arrives, so
  whatever the order, all occurrences but the smallest line are reported, once each.
  A call to the state store is a round trip between two processes, so the newest
  hashes of a shard are one value, read and written by one call; beyond `RECENT` of them
  they go to a map that is asked hash by hash, and a value never grows with the log.

The result over all batches equals `verify_chain` and `check_replay` over the
whole log, wherever batches begin and end.  Each line must be delivered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeaudit.operators.provenance import LINES_PER_BUCKET

SHARDS = 1 << 10
RECENT = 1 << 9
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "store_id string, line_no long, rule string, message string"
END = "hash string, prev string, valid boolean, own boolean, before boolean, after boolean, at long"


def _finding(store: str, line: int, rule: str, message: str) -> tuple:
    return store, line, rule, message


def _broken(store: str, line: int, entry: tuple, previous: tuple | None) -> list[tuple]:
    """The finding of a line against the one before it, which is null at the start of a log."""
    _, prev, valid, own, *_ = entry
    if own and valid and (previous is None or previous[2]) and prev != (previous and previous[0]):
        return [_finding(store, line, "VG-PROV-001", f"line {line} prev_record_hash does not match the previous record")]
    return []


class LogCheck(StatefulProcessor):
    def __init__(self, bucket: int, timers: bool):
        self.bucket, self.timers = bucket, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "line long", END)
        self.first = handle.getMapState("first", "hash string", "line long")
        # The newest hashes, their smallest lines, and whether older ones are in the map.
        self.recent = handle.getValueState("recent", "hashes array<string>, lines array<long>, older boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        check = self._links if key[1] == "links" else self._replays
        found = check(key[0], rows)
        if found:
            yield pd.DataFrame(found, columns=["store_id", "line_no", "rule", "message"])

    def _replays(self, store: str, frames: Iterator[pd.DataFrame]) -> list[tuple]:
        hashes, lines, older = self.recent.get() or ([], [], False)
        out, known, mapped = [], dict(zip(hashes, lines)), {}
        for rows in frames:
            for name, line in zip(rows["record_hash"], rows["line_no"]):
                if name not in known and older:
                    value = self.first.getValue((name,))
                    if value:
                        known[name] = mapped[name] = value[0]
                smallest = known.get(name)
                if smallest is not None:
                    out.append(_finding(store, int(max(smallest, line)), "VG-PROV-006",
                                        f"record {name} appears more than once (replay)"))
                known[name] = int(line) if smallest is None else int(min(smallest, line))
        for name, line in mapped.items():
            if known[name] != line:
                self.first.updateValue((name,), (known[name],))
            del known[name]
        if len(known) > RECENT:
            for name, line in known.items():
                self.first.updateValue((name,), (line,))
            known, older = {}, True
        self.recent.update((list(known), list(known.values()), older))
        return out

    def _links(self, store: str, frames: Iterator[pd.DataFrame]) -> list[tuple]:
        ends = {k[0]: tuple(v) for k, v in self.ends.iterator()}
        held, out, new, latest = set(ends), [], [], 0
        for rows in frames:
            for line, name, prev, valid, own, at in zip(*(rows[c] for c in ("line_no", "record_hash", "prev_record_hash", "valid", "own", "at"))):
                # A line of the run before is known already; the last line of a run is followed in the next one.
                ends[int(line)] = (name if isinstance(name, str) else None, prev if isinstance(prev, str) else None, bool(valid), bool(own),
                                   not own, bool(own and (line + 1) % self.bucket == 0), int(at))
                new.append(int(line))
                latest = max(latest, int(at))
                if own and not valid:
                    out.append(_finding(store, int(line), "VG-PROV-001", f"line {line} is invalid"))

        def judge(line: int, previous: int | None) -> None:
            out.extend(_broken(store, line, ends[line], None if previous is None else ends[previous]))
            ends[line] = (*ends[line][:4], True, *ends[line][5:])
            if previous is not None:
                ends[previous] = (*ends[previous][:5], True, ends[previous][6])

        for line in new:
            if not ends[line][4] and (line == 1 or line - 1 in ends):
                judge(line, None if line == 1 else line - 1)
            if line + 1 in ends and not ends[line + 1][4]:
                judge(line + 1, line)
        self._keep(ends, held, set(new))
        if self.timers and any(not e[4] for e in ends.values() if not (e[4] and e[5])):
            self.handle.registerTimer(latest + 1)
        return out

    def _keep(self, ends: dict, held: set, changed: set) -> None:
        """Write what still waits for a neighbour; forget the rest."""
        for line, entry in ends.items():
            if entry[4] and entry[5]:
                if line in held:
                    self.ends.removeKey((line,))
            else:
                self.ends.updateValue((line,), entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Judge the lines whose predecessor has not come in time against the nearest line before them."""
        ends = {k[0]: tuple(v) for k, v in self.ends.iterator()}
        held, out = set(ends), []
        lines = sorted(ends)
        for at, line in enumerate(lines):
            if ends[line][4] or ends[line][6] >= expiredTimerInfo.getExpiryTimeInMs():
                continue
            previous = lines[at - 1] if at else None
            out += _broken(key[0], line, ends[line], None if previous is None else ends[previous])
            ends[line] = (*ends[line][:4], True, *ends[line][5:])
            if previous is not None:
                ends[previous] = (*ends[previous][:5], True, ends[previous][6])
        self._keep(ends, held, held)
        yield pd.DataFrame(out, columns=["store_id", "line_no", "rule", "message"])

    def close(self) -> None:
        pass


def stream_check_log(lines: DataFrame, ts: str | None = None, delay: str = "10 minutes", replays: bool = True,
                     bucket: int = LINES_PER_BUCKET, shards: int = SHARDS) -> DataFrame:
    """Findings (store_id, line_no, rule, message) of a stream of log lines.

    Columns: store_id, line_no, record_hash, prev_record_hash, valid, and `ts` where
    an event time is named.  Map state needs the RocksDB provider: it is set here for
    the streams this session starts from now on.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.lit(0).cast("long") if ts is None else F.unix_millis(ts)
    rows = lines if ts is None else lines.withWatermark(ts, delay)
    run = F.floor(F.col("line_no") / bucket)

    def part(kind: str, number, own: bool, wanted=None):
        made = F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), F.lit(own).alias("own"))
        return made if wanted is None else F.when(wanted, made)

    parts = [part("links", run, True), part("links", run + 1, False, (F.col("line_no") + 1) % bucket == 0)]
    if replays:
        parts.append(part("replays", F.pmod(F.xxhash64("record_hash"), F.lit(shards)), True,
                          F.col("valid") & F.col("record_hash").isNotNull()))
    keep = ["store_id", "line_no", "record_hash", "prev_record_hash", F.coalesce("valid", F.lit(False)).alias("valid"), at.alias("at")]
    spread = rows.select(*keep, *([ts] if ts else []), F.explode(F.array_compact(F.array(*parts))).alias("p")).select("*", "p.*").drop("p")
    return spread.groupBy("store_id", "kind", "number").transformWithStateInPandas(
        LogCheck(bucket, ts is not None), OUTPUT, "Append", "None" if ts is None else "EventTime")
