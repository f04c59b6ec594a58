"""Flows and tasks on the driver: one run id, timings, retries, a log file per run and a summary."""

from __future__ import annotations

import functools
import json
import logging
import os
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger("skyfold")


@dataclass
class Settings:
    """Taken from ``SKYFOLD_*`` variables, or else from lines of that form in ``.env``, where not given."""

    data_root: Path = Path("data")
    log_dir: Path | None = None
    log_level: str = "INFO"
    log_json: bool = False
    log_retention: int = 20
    strict_checks: bool = False
    output_files: int | None = None  # how many files each published table is written as; as many as it has parts if None

    @classmethod
    def load(cls, **given: object) -> Settings:
        kinds = {"data_root": Path, "log_dir": Path, "output_files": int, "log_level": str, "log_json": lambda v: v.lower() in ("1", "true", "yes"), "log_retention": int, "strict_checks": lambda v: v.lower() in ("1", "true", "yes")}
        lines = Path(".env").read_text(encoding="utf-8").splitlines() if Path(".env").is_file() else []
        written = {k.strip(): v.strip().strip("\"'") for k, eq, v in (line.partition("=") for line in lines) if eq and not k.lstrip().startswith("#")}
        values = written | dict(os.environ)
        named = {k: kind(values[f"SKYFOLD_{k.upper()}"]) for k, kind in kinds.items() if f"SKYFOLD_{k.upper()}" in values}
        return cls(**named | {k: v for k, v in given.items() if v is not None})

    @property
    def raw_root(self) -> Path:
        return self.data_root / "raw"

    @property
    def processed_root(self) -> Path:
        return self.data_root / "processed"

    @property
    def logs_root(self) -> Path:
        return self.log_dir or self.data_root / "logs"


@dataclass
class Run:
    flow: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    tasks: list[dict] = field(default_factory=list)


_run: ContextVar[Run | None] = ContextVar("run", default=None)


def current_run() -> Run | None:
    return _run.get()


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        run = _run.get()
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "run_id": run and run.run_id, "flow": run and run.flow, "message": record.getMessage()})


def _open_log(settings: Settings, run: Run) -> logging.Handler:
    folder = settings.logs_root / run.flow
    folder.mkdir(parents=True, exist_ok=True)
    for old in sorted(folder.glob("*.jsonl"), key=lambda p: p.stat().st_mtime, reverse=True)[max(0, settings.log_retention - 1) :]:
        old.unlink()
    handler = logging.FileHandler(folder / f"{run.run_id}.jsonl", encoding="utf-8")
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    return handler


def task(name: str | None = None, *, key: str | None = None, retries: int = 0, retry_delay: float = 0.0) -> Callable:
    """Times a step and records its outcome; tries again ``retries`` times, then raises the last error."""

    def wrap(step: Callable) -> Callable:
        @functools.wraps(step)
        def timed(*args: object, **kwargs: object) -> object:
            label = name or step.__name__
            if key:
                import inspect

                label += f"[{inspect.signature(step).bind(*args, **kwargs).arguments[key]}]"
            run, began = _run.get(), time.monotonic()
            for attempt in range(1, retries + 2):
                try:
                    result = step(*args, **kwargs)
                except Exception as error:
                    log.warning("%s: attempt %d of %d: %s", label, attempt, retries + 1, error)
                    if attempt <= retries:
                        time.sleep(retry_delay)
                        continue
                    if run:
                        run.tasks.append({"task": label, "status": "failed", "attempts": attempt, "seconds": time.monotonic() - began, "error": str(error)})
                    raise
                if run:
                    run.tasks.append({"task": label, "status": "ok", "attempts": attempt, "seconds": time.monotonic() - began})
                return result

        return timed

    return wrap


def flow(name: str) -> Callable:
    """The outermost flow opens a run with its log; flows called within it join it."""

    def wrap(steps: Callable) -> Callable:
        @functools.wraps(steps)
        def ran(settings: Settings, *args: object, **kwargs: object) -> object:
            if _run.get():
                return steps(settings, *args, **kwargs)
            run = Run(name)
            token = _run.set(run)
            handler = _open_log(settings, run)
            began = time.monotonic()
            try:
                return steps(settings, *args, **kwargs)
            finally:
                failed = sum(t["status"] == "failed" for t in run.tasks)
                log.info("%s %s: %d tasks, %d failed, %.1f s", name, run.run_id, len(run.tasks), failed, time.monotonic() - began)
                for t in run.tasks:
                    log.info(json.dumps(t))
                log.removeHandler(handler)
                handler.close()
                _run.reset(token)

        return ran

    return wrap
