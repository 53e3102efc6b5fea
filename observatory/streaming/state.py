"""Keyed state on streams: cached documents that expire, days without rows, and rows older than a series' anchor.

Rows that wait for their turn are kept as state until the watermark has passed them, so
that within the watermark's delay the order of arrival changes nothing; each operator
names the batch operator it equals. They wait in an aggregate of the engine's own, by
shard of keys and by UTC day. A day that the watermark has passed comes out whole, and a
fold over the shard's days keeps what later ones need of each key. A call, and a read or
write of state, costs the same for one row and for thousands, so a shard's day takes
them and not each row. A task holds one shard's day; more shards hold fewer rows. A
checkpoint keeps the number of shards that it was made with.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from observatory.shared import cut

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that state with timers needs, while a stream is started."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


#: Shards that keys are dealt to.
SHARDS = 1024


def _shard(key: str, at: str, shards: int) -> Column:
    """The shard of a key; rows without a key are dealt by their instant."""
    return F.pmod(F.xxhash64(key, F.when(F.col(key).isNull(), F.col(at))), F.lit(shards)).cast("int").alias("__shard")


def _known(key: Any) -> Any:
    """A key under which a dictionary finds equal keys: NaN and 0.0 are equal to themselves of either sign."""
    return key if isinstance(key, (int, str)) else repr(key + 0.0 if isinstance(key, float) else key)


_DAY = 86_400_000


def _days(source: DataFrame, key: str, at: str, delay: str, shards: int, made: Column, fields: list[str]) -> DataFrame:
    """(__shard, __end, __day, *fields): what ``made``, an aggregate, holds of a shard's UTC day, once the watermark has passed it."""
    rows = source.withWatermark(at, delay).groupBy(_shard(key, at, shards), F.window(at, "1 day")).agg(made.alias("__rows"))
    day = F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("int")
    return rows.select("__shard", F.window_time("window").alias("__end"), day.alias("__day"), *(F.col(f"__rows.{f}" if len(fields) > 1 else "__rows").alias(f) for f in fields))


def _listed(key: str, fields: dict[str, Column]) -> Column:
    """An aggregate: the rows that have a key."""
    return F.collect_list(F.when(F.col(key).isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items()))))


class _Fold(StatefulProcessor):
    """Days of one shard in their order, by what is kept of each of its keys; instants are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "keys binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self._load()
        out = [x for day in sorted(rows, key=lambda r: r["__day"]) if (x := self.take(kept, day)) is not None]
        self._store(kept)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self._load()
        out = self.expire(kept, timerValues.getCurrentWatermarkInMs())
        self._store(kept)
        return iter(() if out is None else (out,))

    def _load(self) -> dict:
        return pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def _store(self, kept: dict) -> None:
        self.kept.update((pickle.dumps(kept),)) if kept else self.kept.clear()
        due = self.due(kept) if kept else None
        if due is not None:
            self.handle.registerTimer(due)

    def take(self, kept: dict, day: Row) -> Row | None:
        """What the rows of one day give, as arrays."""
        raise NotImplementedError

    def due(self, kept: dict) -> int | None:
        """The millisecond at which ``expire`` has something to do next."""
        return None

    def expire(self, kept: dict, now: int) -> Row | None:
        """What the watermark alone gives, and takes from what is kept."""
        return None

    def close(self) -> None:
        pass


class _Answers(_Fold):
    """Keeps the entry of each key."""

    def __init__(self, ttl: int, keep: int) -> None:
        self.ttl, self.keep = ttl, keep

    def take(self, kept: dict, day: Row) -> Row | None:
        out = []
        for at, request, seq, key, value in sorted(zip(day["at"], day["request"], day["seq"], day["key"], day["value"]), key=lambda x: x[:3]):
            name = _known(key)
            if not request:
                kept[name] = (at, value)
                continue
            entry = kept.get(name)
            age = None if entry is None else at - entry[0]
            answer = "miss" if age is None or age >= self.keep else "hit" if age < self.ttl else "stale"
            out.append((key, seq, answer, None if answer == "miss" else entry[1]))
        return Row(**dict(zip(("key", "seq", "answer", "value"), map(list, zip(*out))))) if out else None

    def due(self, kept: dict) -> int | None:
        # an entry is needed until the day of its end is closed
        return -(-(min(at for at, _ in kept.values()) + self.keep) // (1000 * _DAY)) * _DAY

    def expire(self, kept: dict, now: int) -> Row | None:
        begin = now // _DAY * _DAY * 1000  # of the first open day
        for name in [n for n, (at, _) in kept.items() if at + self.keep <= begin]:
            del kept[name]
        return None


def answers(source: DataFrame, key: str, at: str, seq: str, document: str, value: str, ttl: timedelta, keep: timedelta, delay: str, shards: int = SHARDS) -> DataFrame:
    """(key, seq, answer, value) of each request: hit below ``ttl``, stale below ``keep``, else miss, by its key's last document.

    ``source`` is a stream of requests and of documents (``document`` true). A document
    counts for requests of its own instant. Answers come once the watermark, ``delay``
    behind, has passed the request's UTC day; an entry's state goes ``keep`` after its
    document. Rows of a null key only move the watermark. Equals ``ingest.cached_answers``.
    """
    kind = source.schema[key].dataType.simpleString()
    fields = {"at": F.unix_micros(at), "request": ~F.coalesce(F.col(document), F.lit(False)), "seq": F.col(seq).cast("bigint"), "key": F.col(key), "value": F.col(value).cast("string")}
    rows = _days(source, key, at, delay, shards, _listed(key, fields), list(fields))
    made = _Answers(int(ttl.total_seconds() * 1e6), int(keep.total_seconds() * 1e6))
    out = rows.groupBy("__shard").transformWithState(made, f"key array<{kind}>, seq array<bigint>, answer array<string>, value array<string>", "Append", "EventTime")
    return out.selectExpr("inline(arrays_zip(key, seq, answer, value))")


class _Changes(_Fold):
    """Keeps the last fields of each key."""

    def __init__(self, columns: int, fields: list[int]) -> None:
        self.columns, self.fields = [f"c{i}" for i in range(columns)], fields

    def take(self, kept: dict, day: Row) -> Row | None:
        columns = [day[c] for c in self.columns]
        states = list(zip(*(columns[i] for i in self.fields)))
        changed = []
        for _, _, key, i in sorted(zip(day["at"], day["seq"], day["key"], range(len(states))), key=lambda x: x[:2]):
            name = _known(key)
            if name not in kept or kept[name] != states[i]:
                changed.append(i)
            kept[name] = states[i]
        return Row(**{n: [c[i] for i in changed] for n, c in zip(self.columns, columns)}) if changed else None


def changes_only(source: DataFrame, key: str, at: str, seq: str, fields: list[str], delay: str, shards: int = SHARDS) -> DataFrame:
    """The rows whose ``fields`` differ from those of the row before in their key, by ``at``, then ``seq``.

    A row comes once the watermark, ``delay`` behind, has passed its UTC day, so rows of
    any order within that delay are compared in their own; what comes later still is
    dropped. Nulls are equal to each other. Rows of a null key only move the watermark.
    Equals ``temporal.changed_only``.
    """
    names = {f"c{i}": c for i, c in enumerate(source.columns)}
    sent = {"at": F.unix_micros(at), "seq": F.col(seq).cast("bigint"), "key": F.col(key)} | {n: F.unix_micros(c) if c == at else F.col(c) for n, c in names.items()}
    rows = _days(source, key, at, delay, shards, _listed(key, sent), list(sent))
    made = _Changes(len(names), [i for i, c in enumerate(source.columns) if c in fields])
    schema = ", ".join(f"{n} array<{'bigint' if c == at else source.schema[c].dataType.simpleString()}>" for n, c in names.items())
    out = rows.groupBy("__shard").transformWithState(made, schema, "Append", "EventTime").selectExpr(f"inline(arrays_zip({', '.join(names)}))")
    return out.select(*((F.timestamp_micros(n) if c == at else F.col(n)).cast(source.schema[c].dataType).alias(c) for n, c in names.items()))


class _Gaps(_Fold):
    """Keeps of each key itself and the first day that isn't told of."""

    def take(self, kept: dict, day: Row) -> Row | None:
        out, today = [], day["__day"]
        for key in day["key"]:
            entry = kept.setdefault(_known(key), [key, today])
            out += [(key, d) for d in range(entry[1], today)]
            entry[1] = today + 1
        return self._row(out)

    def due(self, kept: dict) -> int | None:
        return (min(first for _, first in kept.values()) + 1) * _DAY

    def expire(self, kept: dict, now: int) -> Row | None:
        closed, out = now // _DAY, []
        for entry in kept.values():
            out += [(entry[0], d) for d in range(entry[1], closed)]
            entry[1] = max(entry[1], closed)
        return self._row(out)

    def _row(self, out: list[tuple]) -> Row | None:
        return Row(key=[k for k, _ in out], day=[d for _, d in out]) if out else None


def gap_days(source: DataFrame, key: str, at: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """(key, day) for each UTC day after a key's first one on which it has no row, once, when the watermark has passed the day.

    Rows of a null key only move the watermark. Over the days that are closed it equals
    ``temporal.missing_days``. What is kept of a key is one day; its rows wait as the
    distinct keys of open days.
    """
    kind = source.schema[key].dataType.simpleString()
    rows = _days(source, key, at, delay, shards, F.collect_set(key), ["key"])
    out = rows.groupBy("__shard").transformWithState(_Gaps(), f"key array<{kind}>, day array<int>", "Append", "EventTime")
    return out.selectExpr("inline(arrays_zip(key, day))").select("key", F.date_from_unix_date("day").alias("day"))


class _Anchored(StatefulProcessor):
    """The newest instant of one key, at first the stored one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "at bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState["__anchor"] is not None:
            self.anchor.update((initialState["__anchor"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = self.anchor.get()[0] if self.anchor.exists() else None
        start = newest
        for r in sorted(rows, key=lambda r: (r["__seq"], r["__at"])):
            accepted = newest is None or r["__at"] >= newest
            if accepted:
                newest = r["__at"]
            fields = r.asDict()
            del fields["__at"], fields["__seq"]
            yield Row(**fields, accepted=accepted)
        if newest != start:
            self.anchor.update((newest,))

    def close(self) -> None:
        pass


def quarantine(source: DataFrame, newest: DataFrame, key: str, at: str, seq: str, advance: bool = False, kept: str | None = None) -> DataFrame:
    """The rows of ``source`` with accepted: false before the anchor of their key, which is its newest instant in ``newest``.

    Without ``advance`` anchors stay, so the order of arrival changes nothing and the
    result equals ``runs.refuse_older``: rows are joined with them. They are read once,
    into the folder ``kept``; a restart takes them from there. With ``advance`` they are
    keyed state, and an accepted row becomes its key's anchor, in the order of ``seq``
    within a micro-batch: what a poller that runs late would do.
    """
    spark = source.sparkSession
    first = newest.groupBy(key).agg(F.unix_micros(F.max(at)).alias("__anchor")).withColumnRenamed(key, "__key")
    if not advance:
        anchors = once(first, kept) if kept else cut(first, "anchors")
        rows = source.join(anchors, F.col(key) == F.col("__key"), "left")
        return rows.select(*source.columns, F.coalesce(F.unix_micros(at) >= F.col("__anchor"), F.lit(True)).alias("accepted"))
    rows = source.withColumn("__at", F.unix_micros(at)).withColumn("__seq", F.col(seq).cast("bigint")).withColumn("__key", F.col(key))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", `__key` " + source.schema[key].dataType.simpleString() + ", accepted boolean"
    with state_store(spark):
        out = rows.groupBy("__key").transformWithState(_Anchored(), schema, "Append", "None", initialState=first.groupBy("__key"))
    return out.drop("__key")


def once(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as the folder ``path`` has them; the first call writes them there."""
    spark = rows.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def split(batch: DataFrame, number: int, accepted: str, refused: str) -> None:
    """Two sinks of one micro-batch; a batch that is tried again replaces what it has written."""
    for path, rows in ((accepted, batch.where("accepted")), (refused, batch.where("not accepted"))):
        rows.drop("accepted").write.mode("overwrite").parquet(f"{path}/batch={number}")

