"""Run a batch fold as a stateful streaming operator, so both give the same rows.

``state_fold`` keeps the fold's named attributes as typed state, with a time to live and a shorter one once the fold has
ended. ``stream_fold`` keeps a whole fold for operators whose state is no flat record and ends by event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from captrail.operators.folds import Fold

STATE = T.StructType([T.StructField("fold", T.BinaryType())])
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StateFold(Fold):
    """A fold whose whole state is the attributes that ``STATE`` names.

    ``ended``: no later row can change what it says. ``silence``: seconds after which it wants to be called by ``silent``
    if no row comes; none where there is nothing to wait for.
    """

    STATE: str
    ended = False

    def silence(self) -> float | None:
        return None

    def silent(self, key: dict) -> Iterable[dict]:
        return ()


class _Keeper(StatefulProcessor):
    """Typed state of one fold per key: ``live`` while it goes on, ``ended`` for a while afterwards."""

    def __init__(self, factory: Callable[[], StateFold], keys: list[str], order: list[str], schema: T.StructType, live: float | None, linger: float | None):
        self.factory, self.keys, self.order = factory, keys, order
        self.names = [f.name for f in schema]
        self.ttl = [None if t is None else int(t * 1000) for t in (live, linger)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = self.factory().STATE
        self.states = [handle.getValueState(name, schema, ttl) for name, ttl in zip(("live", "ended"), self.ttl, strict=True)]

    def _load(self) -> StateFold:
        fold = self.factory()
        held = next((s.get() for s in self.states if s.exists()), None)
        if held is not None:
            for field, value in zip(self._fields(fold), held, strict=True):
                setattr(fold, field, value)
        return fold

    @staticmethod
    def _fields(fold: StateFold) -> list[str]:
        return [part.split()[0] for part in fold.STATE.split(", ")]

    def _store(self, fold: StateFold) -> None:
        kept, other = self.states[::-1] if fold.ended else self.states
        kept.update(tuple(getattr(fold, f) for f in self._fields(fold)))
        if other.exists():
            other.clear()

    def _wait(self, fold: StateFold, now: int) -> None:
        """One timer at most: the newest silence."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not fold.ended and fold.silence() is not None:
            self.handle.registerTimer(now + int(fold.silence() * 1000))

    def _rows(self, found: Iterable[dict]) -> Iterator[Row]:
        return iter([Row(**{c: r[c] for c in self.names}) for r in found])

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[Row]:
        fold, out = self._load(), []
        began = fold.silence()
        known = sorted((r.asDict() for r in rows), key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        for row in known:
            out.extend(fold.push(row))
        self._store(fold)
        if began is not None or fold.silence() is not None:
            self._wait(fold, timerValues.getCurrentProcessingTimeInMs())
        return self._rows(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        fold = self._load()
        out = list(fold.silent(dict(zip(self.keys, key, strict=True))))
        self._store(fold)
        return self._rows(out)


def state_fold(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], factory: Callable[[], StateFold], schema: T.StructType,
    live: float | None = 86_400.0, linger: float | None = 600.0,
) -> DataFrame:
    """Fold each key over micro-batches; within one batch rows are sorted by ``order``.

    State unused for ``live`` seconds is dropped, that of an ended fold after ``linger`` seconds; what arrives later starts
    anew. ``None`` keeps it for good. Needs the RocksDB state store, which is set for the session.
    """
    stream.sparkSession.conf.set(STORE, ROCKS)
    timed = live is not None or linger is not None or factory().silence() is not None
    keeper = _Keeper(factory, list(keys), list(order), schema, live, linger)
    return stream.groupBy(*keys).transformWithState(keeper, schema, "Append", "ProcessingTime" if timed else "None")


def stream_fold(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], factory: Callable[[], Fold],
    schema: T.StructType, event_time: str, idle_seconds: float = 0.0,
) -> DataFrame:
    """Fold each key over micro-batches, by event time (a watermarked timestamp).

    A key is finished, and its state dropped, once the watermark passes its last row by ``idle_seconds``. What a fold
    lists as ``SPARE`` can be worked out again and is not stored.
    """
    names, keys, order = [f.name for f in schema], list(keys), list(order)

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame([[r[c] for c in names] for r in rows], columns=names).astype(object)

    def step(key, batches, state: GroupState):
        fold = factory()
        if state.exists:
            fold.__dict__.update(cloudpickle.loads(bytes(state.get[0])))
        if state.hasTimedOut:
            state.remove()
            out = list(fold.finish())
            if out:
                yield frame(out)
            return
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(order, kind="stable")
        out = []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            out.extend(fold.push(row))
        spare = getattr(fold, "SPARE", ())
        state.update((cloudpickle.dumps({k: v for k, v in fold.__dict__.items() if k not in spare}),))
        last = int(rows[event_time].max().timestamp() * 1000 + idle_seconds * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        if out:
            yield frame(out)

    return stream.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
