"""Queries for the public archives, and the download of batches through a client."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import Protocol
from urllib.parse import urlencode

from skyfold.sources.schemas import GAIA, PSCOMPPARS

PLANET_ARCHIVE = "https://exoplanetarchive.ipac.caltech.edu/TAP/sync"
STAR_TABLE = "gaiadr3.gaia_source"


def select(table: str, columns: Iterable[str], order: str, where: str = "") -> str:
    return f"SELECT {','.join(columns)} FROM {table} {f'WHERE {where} ' if where else ''}ORDER BY {order}"


def planets_query() -> str:
    return select("pscomppars", PSCOMPPARS.names, "pl_name")


def planets_url() -> str:
    return f"{PLANET_ARCHIVE}?{urlencode({'query': planets_query(), 'format': 'csv'})}"


def sources_query(ids: Sequence[int]) -> str:
    if not ids:
        raise ValueError("no source ids")
    return select(STAR_TABLE, GAIA.names, "source_id", f"source_id IN ({','.join(map(str, ids))})")


class Job(Protocol):
    jobid: str

    def get_phase(self) -> str: ...


class Client(Protocol):
    def launch_job_async(self, query: str, **options: object) -> Job: ...


def default_client() -> Client:
    try:
        from astroquery.gaia import Gaia
    except ImportError as error:
        raise RuntimeError("astroquery is not installed; pass a client") from error
    return Gaia


def download_batch(number: int, ids: Sequence[int], folder: Path, client: Client | None = None) -> Path:
    """One batch as ``gaia-host-NNNN.csv``; written under another name until complete, and removed on failure."""
    target = Path(folder) / f"gaia-host-{number:04d}.csv"
    part = target.with_suffix(".csv.part")
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        job = (client or default_client()).launch_job_async(sources_query(ids), output_file=str(part), output_format="csv", dump_to_file=True, background=False, verbose=False)
        phase = job.get_phase()
        if phase != "COMPLETED":
            raise RuntimeError(f"batch {number}, job {job.jobid}: phase {phase}")
        if not part.is_file() or not part.stat().st_size:
            raise RuntimeError(f"batch {number}, job {job.jobid}: no rows delivered")
        part.replace(target)
    except Exception as error:
        part.unlink(missing_ok=True)
        reply = getattr(getattr(error, "response", None), "text", "")
        if reply:
            error.add_note(str(reply)[:2000])
        raise
    return target
