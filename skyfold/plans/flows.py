"""The build: identity, planets, host ids, host sources and host records, each checked before it is written."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators.hosts import build_host_sources, host_records, host_source_ids
from skyfold.operators.identity import build_aliases, build_stars, link_hosts
from skyfold.operators.planets import build_hosts, build_planets, build_systems, count_mismatches, host_conflicts, invalid_rows
from skyfold.operators.quality import expect
from skyfold.operators.rank import numbered_batches
from skyfold.plans.runtime import JsonLines, Settings, current_run, flow, task
from skyfold.session import get_session
from skyfold.sources import archives, snapshots
from skyfold.sources.catalogues import load_faint_stars, load_named_planets, load_planets, load_sources, load_star_names
from skyfold.sources.published import HOST_RECORDS, Build, write_arrow, write_build, write_tables

# Row counts of the pinned snapshots.
EXPECTED = {
    "stars": 605, "stars_with_coordinates": 154, "linked_hosts": 163, "unmatched_hosts": 1, "dropped_stars": 1, "aliases": 2875,
    "planets": 6336, "hosts": 4749, "systems": 4749, "invalid_rows": 0, "stellar_conflicts": 596, "system_count_mismatches": 14,
    "gaia_host_ids": 4396, "gaia_host_sources": 4396, "gaia_host_sources_without_distance": 109,
    "position_status": {"available": 4287, "no_accepted_distance": 109, "no_exact_gaia_source": 353},
}
BATCH = 500


@task("write", key="names")
def _publish(settings: Settings, tables: dict[str, DataFrame], names: str, checks: dict[str, Callable[[], object]]) -> None:
    for name, actual in checks.items():
        expect(name, actual(), EXPECTED[name], strict=settings.strict_checks)
    write_tables(tables, settings.processed_root, files=settings.output_files)


@flow("build-identity")
def build_identity(settings: Settings, spark: SparkSession) -> None:
    at = lambda source: str(snapshots.resolve(settings.raw_root, source))
    names, faint, pairs = load_star_names(spark, at("iau_csn")), load_faint_stars(spark, at("wgsn_faints")), load_named_planets(spark, at("exoplanet_names"))
    stars = build_stars(names, faint).persist()
    aliases = build_aliases(stars).persist()
    linked, unmatched = link_hosts(stars, pairs)
    dropped = invalid_rows(names, "incomplete IAU-CSN row (missing constellation or proper_name)")
    checks = {
        "stars": stars.count, "stars_with_coordinates": stars.where("ra_deg is not null").count, "linked_hosts": linked.count, "unmatched_hosts": unmatched.count,
        "dropped_stars": dropped.count, "aliases": aliases.count,
    }
    tables = {"stars.parquet": stars, "alias.parquet": aliases, "exoplanet_host_links.parquet": linked, "review_unmatched_hosts.parquet": unmatched, "review_dropped_stars.parquet": dropped}
    _publish(settings, tables, "identity", checks)


@flow("build-exoplanets")
def build_exoplanets(settings: Settings, spark: SparkSession) -> None:
    staged = load_planets(spark, str(snapshots.resolve(settings.raw_root, "nasa_pscomppars", "pscomppars.csv"))).persist()
    planets, hosts = build_planets(staged), build_hosts(staged).persist()
    systems = build_systems(hosts, planets).persist()
    tables = {"planets": planets, "hosts": hosts, "systems": systems, "invalid_rows": invalid_rows(staged, "failed PSCompPars staging validation"), "stellar_conflicts": host_conflicts(staged), "system_count_mismatches": count_mismatches(systems)}
    files = {"planets": "exoplanets.parquet", "hosts": "exoplanet_hosts.parquet", "systems": "exoplanet_systems.parquet", "invalid_rows": "review_invalid_exoplanet_rows.parquet", "stellar_conflicts": "review_host_stellar_conflicts.parquet", "system_count_mismatches": "review_system_planet_count_mismatches.parquet"}
    _publish(settings, {files[n]: df for n, df in tables.items()}, "exoplanets", {n: df.count for n, df in tables.items()})


@flow("build-gaia-host-ids")
def build_host_ids(settings: Settings, spark: SparkSession) -> None:
    ids = host_source_ids(spark.read.parquet(str(settings.processed_root / "exoplanet_hosts.parquet"))).persist()
    _publish(settings, {"gaia_host_ids.parquet": ids}, "host-ids", {"gaia_host_ids": ids.count})


@flow("build-gaia-host-sources")
def build_sources(settings: Settings, spark: SparkSession) -> None:
    sources = build_host_sources(load_sources(spark, str(snapshots.current(settings.raw_root, "gaia_hosts")))).persist()
    checks = {"gaia_host_sources": sources.count, "gaia_host_sources_without_distance": sources.where("distance_pc is null").count}
    _publish(settings, {"gaia_host_sources.parquet": sources}, "host-sources", checks)


@flow("build-host-visualization")
def build_records(settings: Settings, spark: SparkSession) -> None:
    hosts, systems, sources = (spark.read.parquet(str(settings.processed_root / f"{n}.parquet")) for n in ("exoplanet_hosts", "exoplanet_systems", "gaia_host_sources"))
    records = host_records(hosts, systems, sources).persist()
    status = {r["position_status"]: r["n"] for r in records.groupBy("position_status").agg(F.count("*").alias("n")).collect()}
    expect("position_status", status, EXPECTED["position_status"], strict=settings.strict_checks)
    write_arrow(records, settings.data_root / "frontend" / HOST_RECORDS)


@flow("build")
def build(settings: Settings, spark: SparkSession) -> None:
    """All tables, and at last the pointer to them: readers see the build before until then."""
    for step in (build_identity, build_exoplanets, build_host_ids, build_sources, build_records):
        step(settings, spark)
    tables = sorted(p.name for p in settings.processed_root.glob("*.parquet"))
    counts = {n: spark.read.parquet(str(settings.processed_root / n)).count() for n in tables}
    sources = {p.parent.parent.name: json.loads(p.read_text(encoding="utf-8"))["sha256"] for p in sorted(settings.raw_root.glob("*/current/snapshot.json"))}
    created = datetime.now(UTC).isoformat(timespec="seconds")
    write_build(Build(current_run().run_id, created, sources, counts), settings.processed_root / "build.json")


@flow("refresh-pscomppars")
def refresh_planets(settings: Settings, spark: SparkSession) -> Path:
    return snapshots.store_url(archives.planets_url(), "nasa_pscomppars", settings.raw_root, filename="pscomppars.csv", timeout=120.0)


@flow("refresh-gaia-hosts")
def refresh_sources(settings: Settings, spark: SparkSession, client: archives.Client | None = None) -> Path:
    """Downloads every batch of host ids to a folder beside the snapshot, which is replaced only when all are there."""
    ids = spark.read.parquet(str(settings.processed_root / "gaia_host_ids.parquet"))
    batches = numbered_batches(ids, "gaia_source_id", BATCH).groupBy("batch_number").agg(F.sort_array(F.collect_list("gaia_source_id")).alias("ids")).orderBy("batch_number")
    settings.raw_root.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=settings.raw_root, prefix=".batches-") as work:
        for row in batches.toLocalIterator():  # a part of the batches at a time
            archives.download_batch(row["batch_number"], row["ids"], Path(work) / "batches", client)
        return snapshots.store_folder(Path(work), "gaia_hosts", settings.raw_root, origin=archives.STAR_TABLE, online=True)


@flow("refresh-snapshots")
def refresh_files(settings: Settings, spark: SparkSession) -> None:
    """Takes the naming catalogues from ``data_root/inputs``, one CSV named after each source."""
    for source in ("iau_csn", "wgsn_faints", "exoplanet_names"):
        snapshots.store_file(settings.data_root / "inputs" / f"{source}.csv", source, settings.raw_root, origin="local file")


COMMANDS = {"build": build, "refresh-snapshots": refresh_files, "refresh-pscomppars": refresh_planets, "refresh-gaia-hosts": refresh_sources}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m skyfold", description="Builds and refreshes the catalogue tables.")
    parser.add_argument("command", nargs="?", default="build", choices=list(COMMANDS))
    parser.add_argument("--strict", action="store_true", default=None, help="fail when a check misses")
    parser.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    parser.add_argument("--log-json", action="store_true", default=None)
    args = parser.parse_args(argv)
    settings = Settings.load(strict_checks=args.strict, log_level=args.log_level, log_json=args.log_json)
    logging.basicConfig(level=settings.log_level)
    if settings.log_json:
        for handler in logging.getLogger().handlers:
            handler.setFormatter(JsonLines())
    try:
        COMMANDS[args.command](settings, get_session())
    except SystemExit as stop:
        return stop.code if isinstance(stop.code, int) else 1
    except Exception:
        logging.getLogger("skyfold").exception("%s failed", args.command)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
