"""Checked host records, markers, names, lookups and search over a build."""

import pytest
from pyspark.sql import functions as F

from skyfold.operators.hosts import RECORD_KINDS, RecordError, decode_records, density_cells, display_name, marker_radius, record_faults, scatter_points
from skyfold.operators.identity import build_name_table
from skyfold.operators.rank import with_unique_flag
from skyfold.operators.search import lookup
from skyfold.plans.runtime import Settings
from skyfold.plans.search import search_build
from skyfold.sources.published import NotPublishedError, write_arrow, write_tables

TYPES = {"text": "string", "id?": "long", "number": "int", "flag": "boolean", "text?": "string", "number?": "double"}
SCHEMA = ", ".join(f"{c} {TYPES[k]}" for c, k in RECORD_KINDS.items()) + ", fault2 string"
GOOD = ["h1", "Host", 3946945413106333696, 4, 4, True, False, "available", 10.0, "gaia_gspphot", "positive_gspphot_estimate", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


def records(spark, *changes):
    rows = [tuple((c | {}).get(n, v) for n, v in zip(RECORD_KINDS, GOOD)) + ("clash",) for c in changes]
    return spark.createDataFrame(rows, SCHEMA)


def test_strict_records(spark):
    nothing = dict.fromkeys([c for c, k in RECORD_KINDS.items() if k.endswith("?")])
    got = decode_records(records(spark, {}, nothing)).collect()
    assert got[0]["gaia_source_id"] == "3946945413106333696" and tuple(got[0]["heliocentric"]) == (1.0, 2.0, 3.0)
    assert got[1]["gaia_source_id"] is None and got[1]["heliocentric"] is None and decode_records(records(spark, {}).limit(0)).count() == 0
    for change, fault in (({"host_name": None}, "host_name is missing"), ({"position_status": "new"}, "unknown position_status"), ({"heliocentric_y_pc": None}, "heliocentric position in part"), ({"distance_method": "guess"}, "unknown distance_method")):
        df = records(spark, {}, change)
        assert {r["fault"] for r in record_faults(df).collect()} == {None, fault}
        with pytest.raises(RecordError, match=fault):
            decode_records(df)
    with pytest.raises(RecordError, match="is_circumbinary must be a flag"):
        decode_records(records(spark, {}).withColumn("is_circumbinary", F.lit(1)))
    with pytest.raises(RecordError, match="missing"):
        decode_records(records(spark, {}).drop("host_id"))


def test_markers_names_and_cells(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, "inverse_parallax"), ("b", 4, 1.0, 2.0, None), ("c", 9, 0.0, 0.0, "gaia_gspphot"), ("d", 99, None, 1.0, None)], "host_id string, planet_count int, x double, y double, distance_method string")
    assert {r["host_id"]: (r["radius"], r["colour"]) for r in scatter_points(df, "x", "y").collect()} == {"a": (3.0, "amber"), "b": (6.0, "blue"), "c": (9.0, "blue")}
    assert df.select(marker_radius("planet_count", F.lit(1))).first()[0] == 6.0
    names = spark.createDataFrame([(None, " ", "HIP 1"), ("A", "b", None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in names.select(display_name("a", "b", "c")).collect()] == ["HIP 1", "A", None]
    sky = spark.createDataFrame([(0.5, 0.5, 0.0, 1.0, float("nan")), (0.6, 0.6, None, float("inf"), None), (1.0, 0.9, 5.0, 3.0, 2.0), (None, 0.1, 1.0, 1.0, 1.0)], "x double, y double, m double, c double, q double")
    (cell,) = density_cells(sky, "x", "y", (1,), (0.0, 0.0, 1.0, 1.0), magnitude="m", colour="c", quality="q").collect()
    assert cell["points"] == 3 and abs(cell["weighted_brightness"] - 1.01) < 1e-9 and (cell["mean_colour"], cell["mean_quality"]) == (2.0, 2.0)
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, _n string")
    assert sorted((r["k"] or 0, r["once"]) for r in with_unique_flag(keys, "k", "once").collect()) == [(0, False), (0, False), (1, False), (1, False), (2, True)]
    assert lookup(keys, "k", "2").count() == 1 and lookup(keys, "k", 9).count() == 0


def test_search_over_a_build(spark, tmp_path):
    with pytest.raises(NotPublishedError):
        search_build(spark, tmp_path, "Sir")
    stars = spark.createDataFrame([("iau:sirius", "star", "Sirius", 1.0, 2.0), ("iau:sirona", "star", "Sirona", None, None), ("iau:none", "star", "None", None, None)], "star_id string, object_type string, canonical_display_name string, ra_deg double, dec_deg double")
    aliases = spark.createDataFrame([("iau:sirius", "Sirius", "IAU", 1, "sirius"), ("iau:sirius", "HD 1", "HD", 4, "hd1"), ("iau:sirona", "Sirona", "IAU", 1, "sirona")], "star_id string, alias string, catalogue string, priority int, alias_search_key string")
    write_tables({"stars.parquet": stars, "alias.parquet": aliases}, tmp_path)
    assert [(r["star_id"], r["is_exact"]) for r in search_build(spark, tmp_path, "sirius").collect()] == [("iau:sirius", True)]
    assert [r["star_id"] for r in search_build(spark, tmp_path, "Sir").collect()] == ["iau:sirius", "iau:sirona"]
    table = {r["entity_id"]: r for r in build_name_table(stars, aliases).collect()}
    assert table["iau:sirius"]["aliases"] == ["Sirius", "HD 1"] and table["iau:none"]["aliases"] == [] and [table[k]["name_index"] for k in ("iau:none", "iau:sirius", "iau:sirona")] == [0, 1, 2]
    assert write_arrow(stars.limit(0), tmp_path / "empty.arrow") == 0


def test_settings_from_a_file(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# none\nSKYFOLD_LOG_DIR=logs\nSKYFOLD_OUTPUT_FILES='1'\nSKYFOLD_LOG_LEVEL=DEBUG\n")
    monkeypatch.setenv("SKYFOLD_LOG_LEVEL", "ERROR")
    settings = Settings.load(strict_checks=True)
    assert (str(settings.logs_root), settings.output_files, settings.log_level, settings.strict_checks) == ("logs", 1, "ERROR", True)
