"""Keyed state of the streaming frontier; shipped by value, so that workers need not have the package."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hotspot import schemas

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY, FRONT = schemas.DAILY_RUNOUT, schemas.FRONTIER
_KEY = T.StructType([T.StructField("date_only", T.DateType()), T.StructField("satellite", T.StringType())])
OUT = T.StructType([T.StructField("project_id", T.LongType()), *FRONT.fields])


def _plain(value, whole: bool):
    """A pandas cell as state holds it."""
    if value is None or value != value:
        return None
    return int(value) if whole else value


def _rank(row: tuple) -> tuple:
    """Of several deliveries of a day the farthest counts; then the greater position."""
    return tuple((x is not None, x or 0.0) for x in (row[2], row[4], row[5]))


def _order(row: tuple) -> tuple:
    return row[0], row[1] is not None, row[1] or ""


class FrontierState(StatefulProcessor):
    """Per project the farthest row of every (day, satellite), and the rows of its frontier.

    A day is taken in where it lies: the frontier before it stays, and only the days from it on are
    replayed. Both maps are bounded by the calendar, whatever the number of detections."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", _KEY, DAY)
        self.front = handle.getMapState("front", _KEY, FRONT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = [isinstance(f.dataType, T.IntegerType) for f in DAY.fields]
        first: dt.date | None = None
        for batch in rows:
            for cells in zip(*(batch[f.name] for f in DAY.fields)):
                row = tuple(_plain(x, w) for x, w in zip(cells, whole))
                if row[0] is None:
                    continue
                at = row[:2]
                if self.days.containsKey(at) and _rank(tuple(self.days.getValue(at))) >= _rank(row):
                    continue
                self.days.updateValue(at, row)
                first = row[0] if first is None else min(first, row[0])
        if first is not None:  # else all was known
            yield pd.DataFrame([(key[0], *r) for r in self._replay(first)], columns=OUT.names)

    def _replay(self, first: dt.date) -> list[tuple]:
        held = sorted((tuple(v) for _, v in self.front.iterator()), key=_order)
        for r in held:
            if r[0] >= first:
                self.front.removeKey(r[:2])
        front = [r for r in held if r[0] < first]
        for row in sorted((tuple(v) for k, v in self.days.iterator() if k[0] >= first), key=_order):
            before = front[-1][8] if front else 0.0
            if row[2] is None or not row[2] > before:
                continue
            hours = float((row[0] - front[-1][0]).days * 24) if front else None
            gained = (row[2] - before) * 1000.0
            new = (*row, row[0], row[2], before, hours, gained, gained / hours if hours else 0.0)
            self.front.updateValue(row[:2], new)
            front.append(new)
        return front

    def close(self) -> None:
        pass
