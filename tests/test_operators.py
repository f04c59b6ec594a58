"""Operators on small frames, with the values that are known of them."""

import math

import pytest
from pyspark.sql import functions as F

from skyfold.functions.names import designation, designation_forms, fold, parse_designation, search_key
from skyfold.functions.text import plain_decimal, reference_text, strip
from skyfold.operators.clean import captured_long, lenient_double, null_placeholders, rename_strictly, strip_strings, tidy_headers, without_prefix
from skyfold.operators.hosts import host_records
from skyfold.operators.identity import build_aliases, build_stars, link_hosts
from skyfold.operators.planets import build_hosts, build_planets, build_systems, count_mismatches, host_conflicts, invalid_rows
from skyfold.operators.quality import CardinalityError, ExpectationError, assert_unique, expect, validated_join
from skyfold.operators.rank import numbered_batches
from skyfold.operators.search import search
from skyfold.operators.spatial import with_distance, with_galactocentric, with_heliocentric
from skyfold.sources.catalogues import planet_staging
from skyfold.sources.schemas import PSCOMPPARS


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_fold():
    for a, b in (("Rosaliadecastro", "Rosalíadecastro"), ("ϵ Her", "ε Her"), ("Uñallamacha", "Unallamacha"), ("BATSŨ̀", "Batsu"), ("Straße", "strasse"), ("O’Neil", "oneil"), ("Ωrin-1", "ωRIN 1")):
        assert fold(a) == fold(b) != ""
    assert fold("!!!") == "" and fold("11 Com b") == "11comb"


def test_search_key_column(spark):
    assert values(column(spark, ["A-b", None, "É", "!!"]), search_key("v")) == ["ab", None, "e", ""]


def test_designations(spark):
    assert designation("V5652 Sgr")[0] == "variable" and designation_forms("V5652 Sgr") == []
    assert designation("6 Equ")[:2] == ("flamsteed", "6") and designation("")[0] == "unparsed"
    assert designation("ε1 Lyr A") == ("bayer", "eps", "1", "Lyr", "A")
    assert {fold(x) for x in designation_forms("del Equ")} == {fold(x) for x in designation_forms("δ Equ")}
    assert designation_forms("ε1 Lyr A") == ["ε1 Lyr A", "eps1 Lyr A", "Epsilon1 Lyr A"]
    got = values(column(spark, ["Iota Her", None, "xyz Cyg"]), parse_designation("v"))
    assert got[0]["kind"] == "bayer" and got[1]["kind"] is None and got[2]["kind"] == "unparsed"


def test_clean(spark):
    df = spark.createDataFrame([("ok", 1), ("", 2), ("_", 3), ("-", 4), ("--", 5), ("  _  ", 6), (None, 7)], "a string, n int")
    assert [r["a"] for r in null_placeholders(df).collect()] == ["ok"] + [None] * 6
    assert values(strip_strings(column(spark, [" x\t", " ", None])), "v") == ["x", "", None]
    assert tidy_headers(df.toDF("<span>a b</span> ", "n")).columns == ["a b", "n"]
    assert values(column(spark, ["HIP 1547", "hip 1547", "1547", "HIP1547", "-"]), without_prefix("v", "HIP")) == ["1547"] * 4 + ["-"]
    assert values(column(spark, ["Gaia DR3 42", "Gaia DR3 42\n", "x", None, "Gaia DR3 99999999999999999999"]), captured_long("v", "Gaia DR3 ([0-9]+)")) == [42, None, None, None, None]
    assert values(column(spark, ["1.5", "1d", "x", None, " 2 ", ".5"]), lenient_double("v")) == [1.5, None, None, None, 2.0, 0.5]
    with pytest.raises(ValueError):
        rename_strictly(df, {"missing": "x"})


def test_text_helpers(spark):
    assert values(column(spark, ["  a b　", "", None, "x" + " " * 50000 + "y"]), F.length(strip("v"))) == [3, 0, None, 50002]
    assert values(column(spark, ["+1.50", " -2", "1.", ".5", "1e3", "12h", "٣", None]), plain_decimal("v")) == [1.5, -2.0] + [None] * 6
    assert values(column(spark, [" A ", "-", " ", None]), reference_text("v")) == ["a", None, None, None]


def test_quality(spark):
    left, twice = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string"), spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k int, y int")
    assert expect("n", 605, 605) and not expect("n", 1, 605)
    with pytest.raises(ExpectationError):
        expect("n", 1, 605, strict=True)
    assert_unique(left, ["k"])
    with pytest.raises(CardinalityError):
        validated_join(left, twice, ["k"])
    assert sorted(map(str, validated_join(left, twice.limit(1), ["k"]).collect())) == ["Row(k=1, x='a', y=5)", "Row(k=3, x='c', y=None)", "Row(k=None, x='b', y=None)"]


def test_batches(spark):
    got = sorted(tuple(r) for r in numbered_batches(column(spark, [50, 10, 40, 20, 30, None, 10], "long"), "v", 2).collect())
    assert got == [(10, 1), (20, 1), (30, 2), (40, 2), (50, 3)]
    with pytest.raises(ValueError):
        numbered_batches(column(spark, [1], "long"), "v", 0)


def test_distances(spark):
    rows = [(25.0, 20.0, 30.0, 10.0, 1.0, 10.0, 1.0), (None, None, None, 10.0, 1.0, 10.0, 1.0), (None, None, None, 10.0, 4.0, 2.5, 1.0), (None, None, None, 10.0, 1.0, 10.0, None), (None, None, None, 10.0, 1.0, 10.0, 1.4), (None, None, None, 10.0, 11.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "distance_gspphot_pc double, distance_gspphot_lower_pc double, distance_gspphot_upper_pc double, parallax_mas double, parallax_error_mas double, parallax_over_error double, ruwe double")
    got = [(r["distance_pc"], r["distance_lower_pc"], r["distance_upper_pc"], r["distance_method"]) for r in with_distance(df).collect()]
    assert got == [(25, 20, 30, "gaia_gspphot"), (100, 1000 / 11, 1000 / 9, "inverse_parallax"), (None, None, None, "unavailable"), (100, 1000 / 11, 1000 / 9, "inverse_parallax"), (None, None, None, "unavailable"), (100, None, None, "inverse_parallax")]


def test_positions(spark):
    rows = [(0.0, 0.0, 10.0), (90.0, 0.0, 10.0), (0.0, 90.0, 10.0), (180.0, 0.0, 10.0), (0.0, 0.0, None), (0.0, 0.0, 0.0), (0.0, 0.0, 8122.0), (90.0, 0.0, 1000.0)]
    df = spark.createDataFrame(rows, "galactic_longitude_deg double, galactic_latitude_deg double, distance_pc double")
    got = df.transform(with_heliocentric).transform(with_galactocentric).collect()
    for r, at in zip(got, [(10, 0, 0), (0, 10, 0), (0, 0, 10), (-10, 0, 0)]):
        assert all(abs(r[f"heliocentric_{c}_pc"] - v) < 1e-12 for c, v in zip("xyz", at))
    assert got[4]["heliocentric_x_pc"] is None and got[4]["galactocentric_z_kpc"] is None
    assert math.isclose(got[5]["galactocentric_x_kpc"], -8.121973366, abs_tol=1e-8) and got[5]["galactocentric_z_kpc"] == 0.0208
    assert all(abs(got[6][f"galactocentric_{c}_kpc"]) < 2e-5 for c in "xyz") and abs(got[7]["galactocentric_y_kpc"] - 1) < 1e-6


def staged(spark):
    base = dict.fromkeys(PSCOMPPARS.names) | {"ra": 1.0, "dec": 2.0, "sy_snum": 1, "sy_pnum": 2, "cb_flag": 0, "pl_controv_flag": 1}
    rows = [
        base | {"pl_name": "Abc b", "hostname": "Abc", "st_teff": 5000.0, "gaia_dr3_id": "Gaia DR3 7"},
        base | {"pl_name": "Abc c", "hostname": "Abc", "st_teff": 5100.0, "st_mass": 1.0},
        base | {"pl_name": "Xyz b", "hostname": " Xyz ", "sy_pnum": 1},
        base | {"pl_name": "Bad b", "hostname": "Bad", "gaia_dr3_id": "not one"},
        base | {"pl_name": "Far b", "hostname": "Far", "ra": None},
    ]
    return planet_staging(spark.createDataFrame([tuple(r[c] for c in PSCOMPPARS.names) for r in rows], PSCOMPPARS))


def test_planets_hosts_systems(spark):
    df = staged(spark)
    assert [r["is_valid"] for r in df.orderBy("planet_name").collect()] == [True, True, False, False, True]
    planets, hosts = build_planets(df), build_hosts(df)
    assert [r["planet_id"] for r in planets.collect()] == ["nea:planet:abcb", "nea:planet:abcc", "nea:planet:xyzb"]
    assert [(r["host_id"], r["stellar_source_planet_name"], r["stellar_values_conflict"], r["gaia_source_id"]) for r in hosts.collect()] == [("nea:host:abc", "Abc c", True, None), ("nea:host:xyz", "Xyz b", False, None)]
    assert [(r["source_planet_name"], r["is_selected"], r["stellar_temperature_k_value_count"]) for r in host_conflicts(df).collect()] == [("Abc b", False, 2), ("Abc c", True, 2)]
    systems = build_systems(hosts, planets)
    assert [(r["planet_count"], r["planet_count_matches_archive"]) for r in systems.collect()] == [(2, True), (1, True)]
    assert count_mismatches(build_systems(hosts, planets.limit(0))).select("planet_count_difference").collect()[0][0] == -2
    assert invalid_rows(df, "x").count() == 2


def test_identity_and_search(spark):
    names = spark.createDataFrame([("Sirius", "HR 2491", None, "α CMa", "* alf CMa", "CMa", True), ("Sirona", None, "5", None, None, "Leo", True), ("Drop", None, None, None, None, None, False)], "proper_name string, designation string, hip string, bayer_raw string, simbad_spelling string, constellation string, is_valid boolean")
    faint = spark.createDataFrame([("sirius", 101.287, -16.716, 1.0, "A", "48915", None, "WASP-1", 8.6, 0.0, "1547")], "name string, ra_deg double, dec_deg double, vmag double, spectral_type string, hd string, hr string, other_id string, distance_ly double, bv_color double, hip string")
    stars = build_stars(names, faint)
    aliases = build_aliases(stars)
    mine = {r["alias"]: r for r in aliases.where("star_id = 'iau:sirius'").collect()}
    assert {"Sirius", "HIP 1547", "HD 48915", "WASP-1", "Alpha CMa", "HR 2491"} <= set(mine) and mine["Sirius"]["priority"] == 1
    assert [r["is_exact"] for r in search(stars, aliases, "Sirius").collect()] == [True]
    assert [r["star_id"] for r in search(stars, aliases, "Sir").collect()] == ["iau:sirius", "iau:sirona"]
    assert search(stars, aliases, "!!!").count() == 0
    linked, lost = link_hosts(stars, spark.createDataFrame([("Sirona",), ("Mazalaai",)], "host_name string"))
    assert [r["star_id"] for r in linked.collect()] == ["iau:sirona"] and [r["host_name"] for r in lost.collect()] == ["Mazalaai"]


def test_host_records(spark):
    hosts = spark.createDataFrame([("c", "g", None, False), ("a", "a", 101, False), ("b", "b", 202, True)], "host_id string, host_name string, gaia_source_id long, is_circumbinary boolean")
    systems = spark.createDataFrame([("b", 1, 1, True), ("c", 4, 4, True), ("a", 2, 3, False)], "host_id string, planet_count int, archive_planet_count int, planet_count_matches_archive boolean")
    kinds = "distance_pc double, distance_method string, distance_quality string, heliocentric_x_pc double, heliocentric_y_pc double, heliocentric_z_pc double, galactocentric_x_kpc double, galactocentric_y_kpc double, galactocentric_z_kpc double, phot_g_mean_magnitude double, bp_rp_color double"
    sources = spark.createDataFrame([(202, None, "unavailable", "unavailable", *[None] * 8), (101, 10.0, "inverse_parallax", "x", *[1.0] * 8)], f"gaia_source_id long, {kinds}")
    assert [(r["host_id"], r["position_status"]) for r in host_records(hosts, systems, sources).collect()] == [("a", "available"), ("b", "no_accepted_distance"), ("c", "no_exact_gaia_source")]
    with pytest.raises(CardinalityError):
        host_records(hosts, systems.union(systems), sources)
