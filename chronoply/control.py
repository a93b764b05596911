"""Resumable jobs on the driver: step state, retries, the step runner."""

from __future__ import annotations

import functools
import json
import logging
import os
import time
from collections.abc import Callable
from pathlib import Path

_log = logging.getLogger("chronoply")


class ConfigError(Exception):
    """A setting that no retry can mend."""


class JobState:
    """Step states in a small JSON file, replaced as a whole. An unreadable file counts as empty."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.steps: dict[str, dict] = {}
        if self.path.exists():
            try:
                self.steps = json.loads(self.path.read_text())
            except (OSError, ValueError) as e:
                _log.warning("state of %s can't be read: %s", path, e)

    def _put(self, step: str, **what: object) -> None:
        self.steps[step] = self.steps.get(step, {}) | what | {"at": time.time()}
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(self.steps))
        os.replace(new, self.path)

    def done(self, step: str) -> bool:
        return bool(self.steps.get(step, {}).get("done"))

    def mark_done(self, step: str, **meta: object) -> None:
        self._put(step, done=True, error=None, **meta)

    def mark_failed(self, step: str, error: str) -> None:
        self._put(step, done=False, error=error)

    def meta(self, step: str, key: str, default: object = None) -> object:
        return self.steps.get(step, {}).get(key, default)


def retry(attempts: int = 3, delay: float = 2.0, errors: tuple[type[Exception], ...] = (Exception,)) -> Callable:
    """Call again after ``delay`` seconds, twice as long each time; the last error goes on."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args: object, **kwargs: object) -> object:
            for k in range(attempts):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if k == attempts - 1:
                        raise
                    time.sleep(delay * 2**k)

        return call

    return wrap


def run_step(state: JobState, step: str, ready: Callable[[], bool], work: Callable[[], dict | None]) -> bool:
    """Do a step unless it is done and its outputs are there. True: it was done now."""
    if state.done(step) and ready():
        return False
    try:
        meta = work() or {}
    except Exception as e:
        state.mark_failed(step, repr(e))
        raise
    state.mark_done(step, **meta)
    return True
