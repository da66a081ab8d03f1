"""Row accounting inside the job that computes a result: what entered an analysis, what it set aside, what its groups hold.

Both ends are observed where the rows pass by, so no row is read twice for it. Filters and column pruning still reach the scan, as
the rows are observed after the scope's tests.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from grainwise.errors import LostRows, ScopeError

#: Seconds a job's counts may take to arrive after it ended, as they are sent apart from its rows.
ARRIVES = 30.0


class Account:
    """One run of one analysis. An analysis names its rows once with `entering` and its groups once with `held`; later calls pass through."""

    def __init__(self, name: str):
        self.name = name
        self._seen: Observation | None = None
        self._held: Observation | None = None

    def entering(self, rows: DataFrame, aside: Column | None = None) -> DataFrame:
        if self._seen is not None:
            return rows
        self._seen = Observation()
        away = F.count_if(F.lit(False) if aside is None else F.coalesce(aside, F.lit(False)))
        return rows.observe(self._seen, F.count(F.lit(1)).alias("entered"), away.alias("set_aside"))

    def held(self, groups: DataFrame, rows: Column) -> DataFrame:
        if self._held is not None or self._seen is None:
            return groups
        self._held = Observation()
        return groups.observe(self._held, rows.alias("held"))

    def counts(self) -> dict[str, int]:
        """entered, set_aside, held, once the result has been read or written."""
        out: dict[str, int] = {}
        for one in (self._seen, self._held):
            if one is None:
                raise ScopeError(f"{self.name} names no rows or no groups to account for")
            until = time.monotonic() + ARRIVES
            while not one._jo.future().isCompleted():
                if time.monotonic() > until:
                    raise ScopeError(f"the result of {self.name} has not been read yet")
                time.sleep(0.02)
            out |= {k: int(v or 0) for k, v in one.get.items()}
        return out

    def check(self) -> dict[str, int]:
        """The counts, refused where they do not add up."""
        c = self.counts()
        if c["held"] + c["set_aside"] != c["entered"]:
            raise LostRows(f"{self.name} holds {c['held']} rows and set {c['set_aside']} aside, of {c['entered']} that entered")
        return c
