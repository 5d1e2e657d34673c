"""Rows that a key of a stream holds until the watermark has passed them, by pieces of time: no more than a piece is in memory at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

GATHERED = 200_000  # rows of a trigger that are put into the state together


class Pieces:
    """State of rows (at, ...), times in microseconds; columns: (name, type) beside ``at``, ``width``: microseconds of a piece.

    A piece of time is one entry for each lot of rows that came for it, so adding rows reads none that are there.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: dict[str, str], width: int):
        self.columns, self.width = ("at", *columns), max(1, width)
        fields = ", ".join(f"{c} array<{t}>" for c, t in {"at": "long", **columns}.items())
        self.rows = handle.getMapState("held", "piece long, lot long", fields)
        self.lots = handle.getValueState("lots", "n long")

    def add(self, parts: Iterable[pd.DataFrame]) -> None:
        gathered, n = [], 0
        for part in parts:
            gathered.append(part[list(self.columns)])
            n += len(part)
            if n >= GATHERED:
                self._put(pd.concat(gathered))
                gathered, n = [], 0
        if n:
            self._put(pd.concat(gathered))

    def _put(self, rows: pd.DataFrame) -> None:
        lot = self.lots.get()[0] if self.lots.exists() else 0
        for piece, some in rows.groupby(rows["at"] // self.width):
            self.rows.updateValue((int(piece), lot), tuple(some[c].tolist() for c in self.columns))
        self.lots.update((lot + 1,))

    def __iter__(self) -> Iterator[tuple[int, list[tuple]]]:
        """(start, entries) of the pieces, earliest first."""
        found = sorted(tuple(k) for k in self.rows.keys())
        for piece, entries in groupby(found, key=lambda k: k[0]):
            yield piece * self.width, list(entries)

    def read(self, entries: list[tuple]) -> dict[str, list]:
        """The rows of a piece by column, in no order."""
        values = [self.rows.getValue(k) for k in entries]
        return {c: list(chain.from_iterable(v[i] for v in values)) for i, c in enumerate(self.columns)}

    def replace(self, entries: list[tuple], rows: dict[str, list] | None = None) -> None:
        """A piece goes, or only ``rows`` of it stay."""
        for k in entries if not rows or not rows["at"] else entries[1:]:
            self.rows.removeKey(k)
        if rows and rows["at"]:
            self.rows.updateValue(entries[0], tuple(rows[c] for c in self.columns))
