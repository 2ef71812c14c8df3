"""Latest revision in a stream with bounded state: a state row per key, with a timer that takes it away."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS, _NUMBER = "micros", "number"


class _Latest(StatefulProcessor):
    """Keeps the greatest version of a key; only a greater one is given out. The state goes ``keep`` ms after its time.

    Every call of the state store is a round trip, so a key has one timer at a time: a newer version leaves it as it is, and
    a timer that comes too early for the version then held is set anew.
    """

    def __init__(self, keep: int, out: Sequence[str]) -> None:
        self.keep, self.out = keep, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.out)
        self.best = handle.getValueState("best", "version string, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r[_MICROS], r[_NUMBER]))
        version = f"{last[_MICROS]:020d}{last[_NUMBER]}"
        held = self.best.get()
        if held is not None and version <= held[0]:
            return
        due = last[_MICROS] // 1000 + self.keep
        if held is None:
            self.handle.registerTimer(due)
        self.best.update((version, due))
        yield self.row(*[last[c] for c in self.out])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[Row]:
        held = self.best.get()
        if held is not None and held[1] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(held[1])
        else:
            self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_bounded(
    stream: DataFrame, keys: Sequence[str], event_time: str, keep: Sequence[str], delay: str, hold: str | None = None, version: str | None = None
) -> DataFrame:
    """(keys, event_time, keep) of each row that is newer than all before it of its key: a stream of changes (update mode).

    ``event_time``, a TIMESTAMP from 1970 on, orders revisions; ``version``, whole and not negative, orders those of one
    moment. Rows more than ``delay`` behind the newest event are too late and dropped; a row that is late but not too late never replaces a
    newer one. The state of a key is a row of its version, and falls ``hold`` (by default ``delay``, and never less) after
    its event time is passed by the watermark: by then everything that could be older is too late. The greatest row of each
    key in the output is therefore ``latest_revision`` of the rows that weren't too late, with a state that holds recent
    keys only, where a plain aggregate keeps every key for ever.

    Needs the RocksDB state store, which this sets for queries started later in the session. Rows with a null event time are
    dropped; null keys are keys.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    late, held = (_milliseconds(stream, d) for d in (delay, hold or delay))
    number = F.lpad((F.col(version) if version else F.lit(0)).cast("string"), 20, "0")
    columns = list(dict.fromkeys([*keys, event_time, *keep]))
    rows = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    rows = rows.select(*columns, F.unix_micros(F.col(event_time)), number)
    # plain names on the way: any are allowed, and some may be those of the version's columns
    plain = [f"c{i}" for i in range(len(columns))]
    rows = rows.toDF(*plain, _MICROS, _NUMBER)
    groups = rows.groupBy(*[plain[columns.index(k)] for k in keys])
    schema = T.StructType([rows.schema[c] for c in plain])
    return groups.transformWithState(_Latest(max(late, held), plain), schema, "Update", "EventTime").toDF(*columns)


def _milliseconds(stream: DataFrame, delay: str) -> int:
    part = stream.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00 UTC' + interval {delay})"))
    return part.first()[0]
