import csv
import io
import json
import logging

import pytest

from skyfold.plans import flows
from skyfold.plans.runtime import Settings, current_run, flow, task
from skyfold.sources import archives, snapshots
from skyfold.sources.catalogues import FAINT_STARS, NAMED_PLANETS, STAR_NAMES, load_faint_stars, load_named_planets, load_planets, load_sources, load_star_names
from skyfold.sources.published import Build, NotPublishedError, open_views, read_arrow, read_build, require, write_arrow, write_build, write_tables
from skyfold.sources.schemas import GAIA, PSCOMPPARS
from skyfold.streaming.ingest import ingest_available, windowed_counts


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    out = io.StringIO()
    csv.writer(out).writerows([header, *rows])
    path.write_text(out.getvalue(), encoding="utf-8")
    return str(path)


def planet(**more):
    return [{"pl_name": "11 Com b", "hostname": "11 Com", "ra": 1.0, "dec": 2.0, "sy_snum": 1, "sy_pnum": 1, "cb_flag": 0, "pl_controv_flag": 0, **more}.get(c, "") for c in PSCOMPPARS.names]


def source(n, **more):
    return [{"source_id": n, "designation": f"Gaia DR3 {n}", "ra": 1.0, "dec": 2.0, "l": 0.0, "b": 0.0, "distance_gspphot": 10.0, **more}.get(c, "") for c in GAIA.names]


def test_planets(spark, tmp_path):
    path = write_csv(tmp_path / "p.csv", PSCOMPPARS.names, [planet(), planet(pl_name="x", gaia_dr3_id="not a GAIA DR3 designation"), planet(pl_name='a, "b"', gaia_dr3_id="Gaia DR3 5")])
    got = {r["planet_name"]: r for r in load_planets(spark, path).collect()}
    assert got["11 Com b"]["is_valid"] and not got["x"]["is_valid"] and got["x"]["gaia_source_id"] is None and got['a, "b"']["gaia_source_id"] == 5
    with pytest.raises(ValueError):
        load_planets(spark, write_csv(tmp_path / "q.csv", PSCOMPPARS.names[1:], []))
    with pytest.raises(Exception):  # noqa: B017
        load_planets(spark, write_csv(tmp_path / "r.csv", PSCOMPPARS.names, [planet(ra="abc")])).collect()


def test_batches(spark, tmp_path):
    names = list(reversed(GAIA.names))
    batch = lambda n, *rows: write_csv(tmp_path / f"batches/gaia-host-000{n}.csv", names, [[dict(zip(GAIA.names, r))[c] for c in names] for r in rows])
    batch(2, source(42))
    batch(1, source(7), source(9, designation="Gaia DR3 999", ra=400))
    assert [(r["gaia_source_id"], r["is_valid"]) for r in load_sources(spark, str(tmp_path)).collect()] == [(7, True), (9, False), (42, True)]
    batch(3, source(7))
    assert [r["is_valid"] for r in load_sources(spark, str(tmp_path)).where("gaia_source_id = 7").collect()] == [False, False]
    with pytest.raises(FileNotFoundError):
        load_sources(spark, str(tmp_path / "none"))


def test_naming_catalogues(spark, tmp_path):
    header = [f"<span>{c}</span>" for c in STAR_NAMES]
    got = load_star_names(spark, write_csv(tmp_path / "n.csv", header, [["Sirius ", "x", "--", "", "α CMa", "s", "CMa", "", "", "", ""], ["Unurgunite", *[""] * 10]])).collect()
    assert [(r["proper_name"], r["designation"], r["is_valid"]) for r in got] == [("Sirius", None, True), ("Unurgunite", None, False)]
    row = lambda **k: [k.get(c, "_") for c in FAINT_STARS]
    got = load_faint_stars(spark, write_csv(tmp_path / "f.csv", FAINT_STARS, [row(Name="a", HIP="HIP 1547", RA2000="3.96", DE2000="5"), row(Name="b", HIP="HIP "), row(Name="c", RA2000="400", DE2000="1")])).collect()
    assert [(r["hip"], r["ra_deg"], r["is_valid"]) for r in got] == [("1547", 3.96, True), (None, None, None), (None, 400.0, False)]
    got = load_named_planets(spark, write_csv(tmp_path / "b.csv", NAMED_PLANETS, [["1", "p", "", "d", "", "h", "", "", "", ""], ["2", "", "", "d", "", "h", "", "", "", ""]])).collect()
    assert [r["is_valid"] for r in got] == [True, False]


def test_snapshots(tmp_path):
    path = snapshots.store_bytes(b"hello", "a.csv", "src", tmp_path, origin="o")
    about = snapshots.manifest(tmp_path, "src")
    assert path.read_bytes() == b"hello" and about["sha256"] == snapshots.sha256(b"hello") and about["bytes"] == 5
    with pytest.raises(ValueError):
        snapshots.store_bytes(b"other", "a.csv", "src", tmp_path, origin="o", expected_sha256="0")
    folder = tmp_path / "in"
    (folder / "d").mkdir(parents=True)
    with pytest.raises(ValueError):
        snapshots.store_folder(folder, "src", tmp_path, origin="o")
    (folder / "d/b.csv").write_text("b")
    (folder / "a.csv").write_text("a")
    assert snapshots.resolve(tmp_path, "src").read_bytes() == b"hello"
    target = snapshots.store_folder(folder, "src", tmp_path, origin="o")
    assert [f["path"] for f in snapshots.manifest(tmp_path, "src")["files"]] == ["a.csv", "d/b.csv"] and (target / "d/b.csv").read_text() == "b"
    assert sorted(p.name for p in (tmp_path / "src").iterdir()) == ["current"]
    with pytest.raises(FileNotFoundError):
        snapshots.resolve(tmp_path, "nothing")
    got = snapshots.store_url("http://x", "net", tmp_path, filename="n.csv", opener=lambda url, timeout: io.BytesIO(b"n"))
    assert got.read_bytes() == b"n" and snapshots.manifest(tmp_path, "net")["fetched_online"]


class Fake:
    def __init__(self, phase="COMPLETED", body="x\n"):
        self.phase, self.body, self.jobid = phase, body, "j1"

    def launch_job_async(self, query, *, output_file, **options):
        with open(output_file, "w") as out:
            out.write(self.body)
        return self

    def get_phase(self):
        return self.phase


def test_archives(tmp_path):
    assert archives.planets_query().startswith("SELECT pl_name,") and archives.planets_query().endswith("FROM pscomppars ORDER BY pl_name")
    assert archives.sources_query([1, 2]).endswith("WHERE source_id IN (1,2) ORDER BY source_id") and "format=csv" in archives.planets_url()
    with pytest.raises(ValueError):
        archives.sources_query([])
    assert archives.download_batch(3, [1], tmp_path, Fake()).name == "gaia-host-0003.csv"
    for fake in (Fake("ERROR"), Fake(body="")):
        with pytest.raises(RuntimeError):
            archives.download_batch(4, [1], tmp_path, fake)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["gaia-host-0003.csv"]


def test_published(spark, tmp_path):
    df = spark.createDataFrame([(3946945413106333696, "a"), (None, None)], "id long, s string")
    write_tables({"stars.parquet": df}, tmp_path, files=1)
    with open_views(spark, tmp_path, {"stars": "stars.parquet"}) as session:
        assert session.sql("select count(id) n from stars").first()["n"] == 1
    with pytest.raises(NotPublishedError):
        require(tmp_path, "alias.parquet")
    assert write_arrow(df, tmp_path / "x/hosts.arrow") == 2
    assert sorted(map(str, read_arrow(spark, tmp_path / "x/hosts.arrow").collect())) == sorted(map(str, df.collect()))
    assert read_build(tmp_path / "build.json") is None
    write_build(Build("b1", "now", {"a": "1"}, {"t": 2}), tmp_path / "build.json")
    assert read_build(tmp_path / "build.json").row_counts == {"t": 2}


def test_runtime(tmp_path):
    tries = []

    @task("step", key="name", retries=2)
    def step(name):
        tries.append(current_run().run_id)
        if len(tries) < 3:
            raise OSError("again")
        return name

    @flow("inner")
    def inner(settings):
        return step("x")

    @flow("outer")
    def outer(settings):
        assert inner(settings) == "x"
        return current_run()

    settings = Settings.load(data_root=tmp_path, log_retention=2)
    run = outer(settings)
    assert len(set(tries)) == 1 and run.tasks[0] | {"seconds": 0} == {"task": "step[x]", "status": "ok", "attempts": 3, "seconds": 0}
    for _ in range(3):
        outer(settings)
    logs = list((tmp_path / "logs/outer").glob("*.jsonl"))
    assert len(logs) == 2 and all(json.loads(line)["flow"] == "outer" for line in logs[0].read_text().splitlines())
    assert logging.getLogger("skyfold").handlers == []


def test_build_end_to_end(spark, tmp_path, monkeypatch):
    settings = Settings.load(data_root=tmp_path / "data")
    inputs = {"iau_csn": (STAR_NAMES, [["Sirius", "x", "HR 1", "1547", "α CMa", "s", "CMa", "", "", "", ""]]), "wgsn_faints": (FAINT_STARS, [["1", "Sirius", "1547", "10", "20", "1", "A", "", "48915", "W-1", "CMa", "8.6", "0", "", ""]]), "exoplanet_names": (NAMED_PLANETS, [["1", "p", "", "d b", "", "Sirius", "", "", "", ""], ["2", "q", "", "e b", "", "Mazalaai", "", "", "", ""]])}
    for name, (header, rows) in inputs.items():
        write_csv(settings.data_root / f"inputs/{name}.csv", header, rows)
    flows.refresh_files(settings, spark)
    text = write_csv(tmp_path / "pscomppars.csv", PSCOMPPARS.names, [planet(gaia_dr3_id="Gaia DR3 7"), planet(pl_name="Abc b", hostname="Abc")])
    snapshots.store_file(text, "nasa_pscomppars", settings.raw_root, origin="test")
    flows.build_exoplanets(settings, spark)
    flows.build_host_ids(settings, spark)
    out = io.StringIO()
    csv.writer(out).writerows([GAIA.names, source(7)])
    flows.refresh_sources(settings, spark, Fake(body=out.getvalue()))
    flows.build(settings, spark)
    records = {r["host_name"]: r["position_status"] for r in read_arrow(spark, settings.data_root / "frontend/exoplanet_hosts.arrow").collect()}
    assert records == {"11 Com": "available", "Abc": "no_exact_gaia_source"}
    with pytest.raises(AssertionError):
        flows.build_host_ids(Settings.load(data_root=settings.data_root, strict_checks=True), spark)
    monkeypatch.setattr(flows, "get_session", lambda: spark)
    monkeypatch.setenv("SKYFOLD_DATA_ROOT", str(tmp_path / "nowhere"))
    assert flows.main(["build"]) == 1


def test_streaming(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    df.write.parquet(str(tmp_path / "in"))
    run = lambda: ingest_available(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "journal")).awaitTermination()
    run()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' kind union all select timestamp'2024-01-01 01:10:00', 'x'")
    assert windowed_counts(events, time="ts", by=["kind"], window="1 hour", late="1 minute").count() == 2
