"""Runs: one at a time, resumed only under the same configuration, stale ones closed."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Run:
    run_id: str
    config: str
    started: datetime.datetime
    status: str = "running"


def acquire(runs: list[Run], run_id: str, config: str, now: datetime.datetime, stale: datetime.timedelta = datetime.timedelta(hours=24)) -> tuple[list[Run], Run]:
    """The runs as they are afterwards, and the one to work in. A running one is resumed if its configuration is the same, fails if it is stale, and else forbids a new one. The list is the driver's: a row a run."""
    live = [r for r in runs if r.status == "running"]
    if len(live) > 1:
        raise RuntimeError("more than one run is running")
    if any(r.run_id == run_id and r.status != "running" for r in runs):
        raise RuntimeError(f"{run_id} has ended")
    if live:
        (old,) = live
        if now - old.started > stale:
            runs = [replace(r, status="failed") if r is old else r for r in runs]
        elif old.config != config:
            raise RuntimeError("the configuration has changed since the run began")
        else:
            return runs, old
    new = Run(run_id, config, now)
    return [*runs, new], new


def finish(runs: list[Run], run_id: str, status: str) -> list[Run]:
    if status not in ("completed", "failed"):
        raise ValueError(status)
    return [replace(r, status=status) if r.run_id == run_id else r for r in runs]
