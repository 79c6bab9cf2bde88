"""Reports kept for a while, so that repeated requests do not scan the fact table again."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from weekpulse.plans.report import Report
from weekpulse.spec import ReportSpec

TTL_SECONDS = 300


class ReportCache:
    """One cached report per selection. Past its time a report is rebuilt at the asked `as_of`."""

    def __init__(
        self,
        load_fact: Callable[[ReportSpec], DataFrame],
        ttl_seconds: float = TTL_SECONDS,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self._load_fact = load_fact
        self._ttl = ttl_seconds
        self._clock = clock
        self._kept: dict[ReportSpec, tuple[float, Report]] = {}

    def get(self, spec: ReportSpec) -> Report:
        self._drop_expired()
        selection = spec.at(datetime.min)
        if selection not in self._kept:
            report = Report(self._load_fact(spec), spec).cache()
            self._kept[selection] = (self._clock(), report)
        return self._kept[selection][1]

    def refresh(self) -> None:
        for _, report in self._kept.values():
            report.close()
        self._kept.clear()

    def _drop_expired(self) -> None:
        now = self._clock()
        for selection, (since, report) in list(self._kept.items()):
            if now - since >= self._ttl:
                report.close()
                del self._kept[selection]
