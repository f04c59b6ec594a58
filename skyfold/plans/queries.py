"""One query per operator over the tables of a data folder, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.names import ascii_search_key, designation_aliases, parse_designation, search_key
from skyfold.functions.text import reference_text
from skyfold.operators.clean import captured_long, lenient_double, null_placeholders, rename_strictly, strip_strings, without_prefix
from skyfold.operators.hosts import SOURCE_COLUMNS, SPATIAL, build_host_sources, density_cells, display_name, host_records, host_source_ids, record_faults, scatter_extent, scatter_points
from skyfold.operators.identity import PRIORITY, build_aliases, build_name_table, build_stars, link_hosts
from skyfold.operators.nearby import regions_containing
from skyfold.operators.planets import CONFLICT_REASON, COUNT_REASON, STELLAR, build_hosts, build_planets, build_systems, count_mismatches, host_conflicts, invalid_rows
from skyfold.operators.quality import validated_join
from skyfold.operators.rank import distinct_counts, first_per_key, non_null_count, numbered_batches, unique_flag, value_of_first
from skyfold.operators.search import lookup, search
from skyfold.operators.spatial import with_distance, with_galactocentric, with_heliocentric
from skyfold.plans.problems import table
from skyfold.sources.catalogues import PLANET_NAMES, SOURCE_NAMES, planet_staging, source_staging
from skyfold.streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Table = Callable[[str], DataFrame]


def query(sql: str | None = None) -> Callable:
    """Registers a function of a table reader as a query of its name."""

    def add(f: Callable[[Table], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL twins of column helpers. The key's SQL form needs names of letters that decompose to themselves, as ours do.
def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def folded(c: str) -> str:
    return rf"regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]', '', 'g')"


def cleaned(c: str) -> str:
    return f"case when {trimmed(c)} not in ('', '_', '-', '--') then {trimmed(c)} end"


def counted(flag: str) -> str:
    return f"coalesce({flag}, false)"


NUMBER_SQL = r"case when regexp_full_match({0}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') then try_cast({0} as double) end"


@query("select c_custkey customer_id, c_name customer_name, c_acctbal balance, c_mktsegment segment from customer")
def typed_projection_rename(t: Table) -> DataFrame:
    return rename_strictly(t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), {"c_custkey": "customer_id", "c_name": "customer_name", "c_acctbal": "balance", "c_mktsegment": "segment"})


_TEXTS = ["wgsn_id", "star_name", "hip", "hr", "hd", "other_id", "spectral_type"]


@query(f"select {', '.join(f'{cleaned(c)} {c}' for c in _TEXTS)} from wgsn_faints")
def trim_and_placeholders(t: Table) -> DataFrame:
    return null_placeholders(strip_strings(t("wgsn_faints").select(*_TEXTS)))


@query(rf"select wgsn_id, regexp_replace({trimmed('hip')}, '^HIP\s*', '', 'i') hip, regexp_replace({trimmed('hd')}, '^HD\s*', '', 'i') hd from wgsn_faints")
def prefix_strip(t: Table) -> DataFrame:
    df = strip_strings(t("wgsn_faints").select("wgsn_id", "hip", "hd"))
    return df.withColumns({"hip": without_prefix("hip", "HIP"), "hd": without_prefix("hd", "HD")})


@query("select row_id, case when regexp_full_match(designation, 'Gaia DR3 [0-9]+') then try_cast(designation[10:] as bigint) end parsed_id from gaia")
def regex_extract_try_cast(t: Table) -> DataFrame:
    return t("gaia").select("row_id", captured_long("designation", "Gaia DR3 ([0-9]+)").alias("parsed_id"))


@query(f"select wgsn_id, {', '.join(f'{NUMBER_SQL.format(c)} {c}' for c in ('ra2000', 'de2000', 'vmag', 'distance_ly', 'bv_color'))} from wgsn_faints")
def lenient_numbers(t: Table) -> DataFrame:
    return t("wgsn_faints").select("wgsn_id", *[lenient_double(c).alias(c) for c in ("ra2000", "de2000", "vmag", "distance_ly", "bv_color")])


_PLANETS_SQL = f"""
with s as (select * replace ({", ".join(f"{trimmed(c)} as {c}" for c in ("pl_name", "hostname", "pl_letter", "hd_name", "hip_name", "tic_id", "gaia_dr3_id", "pl_bmassprov", "discoverymethod", "disc_facility"))}),
  pl_name planet_name, hostname host_name from pscomppars),
n as (select * replace ({trimmed("pl_name")} as planet_name, {trimmed("hostname")} as host_name), gaia_dr3_id g from s),
p as (select *, case when regexp_full_match(g, 'Gaia DR3 [0-9]+') then try_cast(g[10:] as bigint) end gaia_source_id from n),
v as (select *, {counted("length(planet_name) > 0 and length(host_name) > 0 and ra between 0 and 360 and dec between -90 and 90 and sy_snum >= 1 and sy_pnum >= 1 and (g is null or gaia_source_id is not null)")} is_valid from p)
"""


@query(_PLANETS_SQL + "select snapshot_no, planet_name, host_name, gaia_source_id, cb_flag = 1 is_circumbinary, is_valid from v")
def row_validity_planets(t: Table) -> DataFrame:
    return planet_staging(t("pscomppars")).select("snapshot_no", "planet_name", "host_name", "gaia_source_id", "is_circumbinary", "is_valid")


def _sources(t: Table) -> DataFrame:
    gaia = t("gaia")
    raw = gaia.select("row_id", *[F.col("gaia_source_id" if c == "source_id" else f"{c}_deg" if c in ("ra", "dec") else c).alias(c) for c in [*SOURCE_NAMES, "parallax_over_error", "ruwe", "duplicated_source", "astrometric_params_solved", "visibility_periods_used", "non_single_star", "phot_variable_flag"]])
    return source_staging(raw)


_SOURCES_SQL = """
with n as (select *, count(*) over (partition by gaia_source_id) = 1 once from gaia),
v as (select *, coalesce(gaia_source_id is not null and regexp_replace(designation, '^\\s+|\\s+$', '', 'g') = 'Gaia DR3 ' || gaia_source_id and once
  and ra_deg between 0 and 360 and dec_deg between -90 and 90, false) is_valid from n)
"""


@query(_SOURCES_SQL + "select row_id, gaia_source_id, is_valid from v")
def row_validity_sources(t: Table) -> DataFrame:
    return _sources(t).select("row_id", "gaia_source_id", "is_valid")


@query(f"""with f as (select wgsn_id, {NUMBER_SQL.format(trimmed("ra2000"))} ra, {NUMBER_SQL.format(trimmed("de2000"))} de, {cleaned("star_name")} n from wgsn_faints)
select wgsn_id, ra ra_deg, de dec_deg, ra between 0 and 360 and de between -90 and 90 and n is not null is_valid from f""")
def row_validity_faint_stars(t: Table) -> DataFrame:
    df = null_placeholders(strip_strings(t("wgsn_faints").select("wgsn_id", "star_name", "ra2000", "de2000"))).withColumns({"ra_deg": lenient_double("ra2000"), "dec_deg": lenient_double("de2000")})
    return df.select("wgsn_id", "ra_deg", "dec_deg", (F.col("ra_deg").between(0, 360) & F.col("dec_deg").between(-90, 90) & F.col("star_name").isNotNull()).alias("is_valid"))


@query(_PLANETS_SQL + "select snapshot_no, is_valid, count(*) n from v group by all")
def valid_split(t: Table) -> DataFrame:
    return planet_staging(t("pscomppars")).groupBy("snapshot_no", "is_valid").agg(F.count("*").alias("n"))


@query(_PLANETS_SQL + "select snapshot_no, planet_name, host_name, 'failed staging validation' review_reason from v where not is_valid")
def invalid_review(t: Table) -> DataFrame:
    return invalid_rows(planet_staging(t("pscomppars")), "failed staging validation").select("snapshot_no", "planet_name", "host_name", "review_reason")


@query(f"select row_id, {' + '.join(f'({c} is not null)::tinyint' for c in STELLAR)} fields_available from exoplanets")
def horizontal_completeness(t: Table) -> DataFrame:
    return t("exoplanets").select("row_id", non_null_count(STELLAR).alias("fields_available"))


_COUNTS_SQL = ", ".join(f"count(distinct {c}) {c}_value_count" for c in STELLAR)


@query(f"select host_id, {_COUNTS_SQL}, greatest({', '.join(f'count(distinct {c})' for c in STELLAR)}) > 1 values_conflict from exoplanets group by host_id")
def group_distinct_conflicts(t: Table) -> DataFrame:
    return distinct_counts(t("exoplanets"), ["host_id"], STELLAR)


@query("select o_orderkey, o_custkey, n - 1 others, n = 1 is_only from (select *, count(*) over (partition by o_custkey) n from orders)")
def column_difference_and_flag(t: Table) -> DataFrame:
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("orders").join(n, "o_custkey").select("o_orderkey", "o_custkey", (F.col("n") - 1).alias("others"), (F.col("n") == 1).alias("is_only"))


@query("select c_custkey, c_name, coalesce(n_name, 'unknown') nation from customer left join (select * from nation where n_regionkey <> 0) on n_nationkey = c_nationkey")
def left_join_enrich_coalesce(t: Table) -> DataFrame:
    c, n = t("customer"), t("nation").where("n_regionkey <> 0")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


_REF = f"nullif(nullif(lower({trimmed('host_id')}), ''), '-')"


@query(f"select row_id, h.host_name from (select row_id, {_REF} k from exoplanets) c join (select {_REF} k, min(host_name) host_name from exoplanet_hosts group by 1) h using (k)")
def inner_link(t: Table) -> DataFrame:
    hosts = t("exoplanet_hosts").groupBy(reference_text("host_id").alias("k")).agg(F.min("host_name").alias("host_name"))
    return t("exoplanets").select("row_id", reference_text("host_id").alias("k")).join(hosts, "k").select("row_id", "host_name")


@query(f"select row_id, host_id, 'host not found' review_reason from exoplanets where ({_REF}) is null or ({_REF}) not in (select k from (select {_REF} k from exoplanet_hosts) where k is not null)")
def anti_unmatched(t: Table) -> DataFrame:
    keyed = t("exoplanets").withColumn("k", reference_text("host_id"))
    return keyed.join(t("exoplanet_hosts").select(reference_text("host_id").alias("k")), "k", "left_anti").select("row_id", "host_id", F.lit("host not found").alias("review_reason"))


@query("select row_id, e.host_id, e.source from exoplanets e join (select host_id, source from exoplanets group by all having count(distinct stellar_temperature_k) > 1) c on e.host_id = c.host_id and e.source = c.source")
def composite_inner_join(t: Table) -> DataFrame:
    conflicted = t("exoplanets").groupBy("host_id", "source").agg(F.count_distinct("stellar_temperature_k").alias("n")).where("n > 1")
    return t("exoplanets").join(conflicted, ["host_id", "source"]).select("row_id", "host_id", "source")


@query("select c_custkey, coalesce(n, 0) large_orders from customer left join (select o_custkey, count(*) n from orders where o_totalprice > 400000 group by 1) on o_custkey = c_custkey")
def left_join_count_fill_zero(t: Table) -> DataFrame:
    n = t("orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("large_orders"))


@query("select c_custkey, n, last_order from customer left join (select o_custkey, count(*) n, max(o_orderkey) last_order from orders group by 1) on o_custkey = c_custkey")
def validated_one_to_one(t: Table) -> DataFrame:
    totals = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))
    return validated_join(t("customer").select("c_custkey"), totals, ["c_custkey"], validate="1:1")


@query("select s_suppkey, n_name from supplier left join nation on n_nationkey = s_nationkey")
def validated_many_to_one(t: Table) -> DataFrame:
    nations = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return validated_join(t("supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"], validate="m:1").select("s_suppkey", "n_name")


# The SQL's smallint ends at 32,767 parts of a brand, where DuckDB fails; here the count stays a bigint, which holds any.
@query("select p_brand, count(*)::smallint n from part group by 1")
def group_count(t: Table) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("select o_orderstatus, count(*) n from orders group by 1")
def status_counts(t: Table) -> DataFrame:
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select count(*) total, count(gaia_source_id) identified, count(*) filter (where coalesce(parallax > 0, false)) positive from gaia")
def global_counts(t: Table) -> DataFrame:
    return t("gaia").agg(F.count("*").alias("total"), F.count("gaia_source_id").alias("identified"), F.count_if(F.col("parallax") > 0).alias("positive"))


@query("select count(*) / nullif(count(distinct host_id), 0) reports_per_host from exoplanets")
def mean_per_group_guarded(t: Table) -> DataFrame:
    return t("exoplanets").agg(F.try_divide(F.count("*").cast("double"), F.count_distinct("host_id")).alias("reports_per_host"))


@query("select max(n) most_variants from (select count(distinct stellar_mass_solar) n from exoplanets group by host_id)")
def max_variants_per_group(t: Table) -> DataFrame:
    return t("exoplanets").groupBy("host_id").agg(F.count_distinct("stellar_mass_solar").alias("n")).agg(F.max("n").alias("most_variants"))


@query("select least(0, min(c_acctbal)) low, greatest(0, max(c_acctbal)) high, greatest(1, max(c_nationkey)) most from customer")
def extent_min_max(t: Table) -> DataFrame:
    return t("customer").agg(F.least(F.lit(0.0), F.min("c_acctbal")).alias("low"), F.greatest(F.lit(0.0), F.max("c_acctbal")).alias("high"), F.greatest(F.lit(1), F.max("c_nationkey")).alias("most"))


@query("select sky_field, count(*) total, count(*) filter (where ra_deg is not null and dec_deg is not null) positioned from gaia group by 1")
def positioned_counts(t: Table) -> DataFrame:
    return t("gaia").groupBy("sky_field").agg(F.count("*").alias("total"), F.count_if(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()).alias("positioned"))


@query("select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) = 1 is_unique from lineitem")
def is_unique_flag(t: Table) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", unique_flag(["l_orderkey", "l_linenumber"]).alias("is_unique"))


@query("select p_brand, p_partkey, p_name, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1")
def keep_first_representative(t: Table) -> DataFrame:
    return first_per_key(t("part").select("p_brand", "p_partkey", "p_name", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")])


@query("""select p_partkey, first_value(p_name) over w selected_name, first_value(p_partkey) over w = p_partkey is_selected from part window w as (partition by p_type order by p_size desc, p_partkey)""")
def selected_row_flag(t: Table) -> DataFrame:
    order = [F.col("p_size").desc(), F.col("p_partkey")]
    return t("part").select("p_partkey", value_of_first("p_name", ["p_type"], order).alias("selected_name"), (value_of_first("p_partkey", ["p_type"], order) == F.col("p_partkey")).alias("is_selected"))


@query("""with o as (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1)
select * from o order by o_totalprice desc, o_orderkey limit 20""")
def distinct_on_topk(t: Table) -> DataFrame:
    best = first_per_key(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return best.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("select gaia_source_id, ((row_number() over (order by gaia_source_id) - 1) // 500 + 1)::int batch_number from (select distinct gaia_source_id from exoplanet_hosts where gaia_source_id is not null)")
def batch_plan(t: Table) -> DataFrame:
    return numbered_batches(t("exoplanet_hosts"), "gaia_source_id", 500)


@query("select 'customer' kind, c_custkey id, c_name name from customer union all select 'supplier', s_suppkey, s_name from supplier union all select 'nation', n_nationkey, n_name from nation")
def union_all_aliases(t: Table) -> DataFrame:
    parts = [t(n).select(F.lit(n).alias("kind"), F.col(k).cast("bigint").alias("id"), F.col(v).alias("name")) for n, k, v in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(t: Table) -> DataFrame:
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("select l_orderkey, l_partkey, l_quantity, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity, l_extendedprice, l_partkey, l_suppkey, l_linenumber) = 1")
def distinct_on_key(t: Table) -> DataFrame:
    return first_per_key(t("lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")]).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("select distinct gaia_source_id from exoplanet_hosts where gaia_source_id is not null order by 1")
def drop_nulls_distinct_sorted(t: Table) -> DataFrame:
    return host_source_ids(t("exoplanet_hosts"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def difference_by_key(t: Table) -> DataFrame:
    return t("customer").join(t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


# Spark orders NaN above all numbers and finds it equal to itself, as DuckDB does.
_DISTANCE_SQL = """
d as (select *, coalesce(distance_gspphot > 0, false) ph from gaia),
q as (select *, not ph and coalesce(parallax > 0 and parallax_over_error >= 5 and (ruwe is null or ruwe < 1.4), false) pa from d),
b as (select *, pa and coalesce(parallax_error > 0 and parallax - parallax_error > 0, false) bo from q),
p as (select *, case when ph then distance_gspphot when pa then 1000 / parallax end distance_pc, case when ph then distance_gspphot_lower when bo then 1000 / (parallax + parallax_error) end lower_pc,
  case when ph then distance_gspphot_upper when bo then 1000 / (parallax - parallax_error) end upper_pc,
  case when ph then 'gaia_gspphot' when pa then 'inverse_parallax' else 'unavailable' end distance_method,
  case when ph then 'positive_gspphot_estimate' when pa then 'snr_ge_5_ruwe_acceptable' else 'unavailable' end distance_quality from b)
"""


def _placed(t: Table) -> DataFrame:
    return t("gaia").withColumnsRenamed({k: v for k, v in SOURCE_NAMES.items() if k not in ("source_id", "ra", "dec")})


@query(f"with {_DISTANCE_SQL} select row_id, round(distance_pc, 6) distance_pc, round(lower_pc, 6) distance_lower_pc, round(upper_pc, 6) distance_upper_pc, distance_method, distance_quality from p")
def distance_priority(t: Table) -> DataFrame:
    return with_distance(_placed(t)).select("row_id", *[F.round(c, 6).alias(c) for c in ("distance_pc", "distance_lower_pc", "distance_upper_pc")], "distance_method", "distance_quality")


# Positions are compared in parts of the distance (at least one parsec or kiloparsec): rounding must not compare the noise of large numbers.
_HELIO = "distance_pc * cos(radians(b)) * cos(radians(l)) hx, distance_pc * cos(radians(b)) * sin(radians(l)) hy, distance_pc * sin(radians(b)) hz"
_HELIO_SQL = f"with {_DISTANCE_SQL}, h as (select *, {_HELIO} from p), g as (select *, 0.99999672443758247 * hx / 1000 + 9.3396296357779800e-07 * hy / 1000 + 2.5595142573179744e-03 * hz / 1000 - 8.1219733661223 gx, -9.3020648297014539e-07 * hx / 1000 + 0.99999999999848865 * hy / 1000 - 1.4688441515474427e-06 * hz / 1000 gy, -2.5595142586859292e-03 * hx / 1000 + 1.4664584634852765e-06 * hy / 1000 + 0.99999672443693988 * hz / 1000 + 0.0208 gz from h)"


def _in_parts(c: str, unit: float) -> F.Column:
    return F.round(F.col(c) / F.greatest(F.lit(1.0), F.col("distance_pc") / unit), 6)


@query(_HELIO_SQL + " select row_id, " + ", ".join(f"round(h{c} / greatest(1.0, distance_pc), 6) {c}" for c in "xyz") + " from g")
def heliocentric_xyz(t: Table) -> DataFrame:
    return _placed(t).transform(with_distance).transform(with_heliocentric).select("row_id", *[_in_parts(f"heliocentric_{c}_pc", 1).alias(c) for c in "xyz"])


@query(_HELIO_SQL + " select row_id, " + ", ".join(f"round(g{c} / greatest(1.0, distance_pc / 1000.0), 6) {c}" for c in "xyz") + " from g")
def galactocentric_xyz(t: Table) -> DataFrame:
    placed = _placed(t).transform(with_distance).transform(with_heliocentric).transform(with_galactocentric)
    return placed.select("row_id", *[_in_parts(f"galactocentric_{c}_kpc", 1000).alias(c) for c in "xyz"])


_SOURCE_SQL_NAMES = {v: {"source_id": "gaia_source_id", "ra": "ra_deg", "dec": "dec_deg"}.get(k, k) for k, v in SOURCE_NAMES.items()} | {c: c for c in ("gaia_source_id", "parallax_over_error", "ruwe", "duplicated_source", "astrometric_params_solved", "visibility_periods_used", "phot_variable_flag", "non_single_star", "distance_method", "distance_quality")} | {"gaia_dr3_designation": trimmed("designation"), "phot_variable_flag": trimmed("phot_variable_flag")}
_ROUNDED = ["distance_pc", "distance_lower_pc", "distance_upper_pc"]


@query(f"""with {_DISTANCE_SQL}, c as (select gaia_source_id from gaia where gaia_source_id is not null group by 1 having count(*) = 1),
h as (select p.*, {_HELIO} from p semi join c using (gaia_source_id) where regexp_replace(designation, '^\\s+|\\s+$', '', 'g') = 'Gaia DR3 ' || gaia_source_id and ra_deg between 0 and 360 and dec_deg between -90 and 90)
select {", ".join(f"{_SOURCE_SQL_NAMES[c]} {c}" for c in SOURCE_COLUMNS if c in _SOURCE_SQL_NAMES)}, round(distance_pc, 6) distance_pc, round(lower_pc, 6) distance_lower_pc, round(upper_pc, 6) distance_upper_pc,
  {", ".join(f"round(h{c} / greatest(1.0, distance_pc), 6) heliocentric_{c}" for c in "xyz")}, 'gaia_hosts' source from h""")
def host_sources(t: Table) -> DataFrame:
    df = build_host_sources(_sources(t))
    places = [_in_parts(f"heliocentric_{c}_pc", 1).alias(f"heliocentric_{c}") for c in "xyz"]
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else c for c in SOURCE_COLUMNS if "centric" not in c], *places)


_PLANET_SQL_NAMES = {v: k for k, v in PLANET_NAMES.items()} | {"planet_name": "planet_name", "host_name": "host_name", "is_controversial": "pl_controv_flag <> 0", "is_circumbinary": "cb_flag <> 0", "gaia_source_id": "gaia_source_id", "hd_name": "hd_name", "hip_name": "hip_name", "tic_id": "tic_id"}


def _sql_columns(names: list[str]) -> str:
    return ", ".join(f"{_PLANET_SQL_NAMES[n]} {n}" for n in names)


_PLANET_VALUES = ["planet_letter", "radius_earth", "mass_earth", "mass_provenance", "density_g_cm3", "equilibrium_temperature_k", "insolation_earth", "orbital_period_days", "semi_major_axis_au", "eccentricity", "inclination_deg", "discovery_method", "discovery_year", "discovery_facility", "is_controversial"]


@query(_PLANETS_SQL + f"select 'nea:planet:' || {folded('planet_name')} planet_id, 'nea:host:' || {folded('host_name')} host_id, 'nea:system:' || {folded('host_name')} system_id, planet_name, {_sql_columns(_PLANET_VALUES)}, 'nasa_pscomppars' source from v where is_valid")
def planets(t: Table) -> DataFrame:
    return build_planets(planet_staging(t("pscomppars")))


_HOST_VALUES = ["hd_name", "hip_name", "tic_id", "gaia_dr3_designation", "gaia_source_id", "ra_deg", "dec_deg", "system_distance_pc", "star_count", "planet_count", "is_circumbinary", *STELLAR]
_HOSTS_SQL = (
    _PLANETS_SQL
    + f""", c as (select 'nea:host:' || {folded("host_name")} host_id, host_name, planet_name, {_sql_columns(_HOST_VALUES)},
  ((st_teff is not null)::int + (st_mass is not null)::int + (st_rad is not null)::int + (st_lum is not null)::int)::tinyint stellar_fields_available from v where is_valid),
k as (select host_id, host_name, {", ".join(f"count(distinct {c}) {c}_value_count" for c in STELLAR)} from c group by all),
w as (select c.*, row_number() over o place, first_value(planet_name) over o chosen from c window o as (partition by host_id order by host_name, stellar_fields_available desc, planet_name, {", ".join(f"{c} nulls first" for c in _HOST_VALUES)})),
j as (select w.*, k.* exclude (host_id, host_name), greatest({", ".join(f"{c}_value_count" for c in STELLAR)}) > 1 stellar_values_conflict from w join k using (host_id, host_name)),
h as (select host_id, host_name, {", ".join(_HOST_VALUES)}, stellar_fields_available, planet_name stellar_source_planet_name, 'most_complete_then_planet_name' stellar_selection_method, stellar_values_conflict, 'nasa_pscomppars' source from j where place = 1)
"""
)


@query(_HOSTS_SQL + "select * from h")
def representative_hosts(t: Table) -> DataFrame:
    return build_hosts(planet_staging(t("pscomppars")))


@query(_HOSTS_SQL + f"""select host_id, host_name, planet_name source_planet_name, chosen selected_source_planet_name, planet_name = chosen is_selected, stellar_fields_available, {", ".join(STELLAR)}, {", ".join(f"{c}_value_count" for c in STELLAR)},
  '{CONFLICT_REASON}' review_reason, 'nasa_pscomppars' source from j where stellar_values_conflict""")
def host_conflict_review(t: Table) -> DataFrame:
    return host_conflicts(planet_staging(t("pscomppars")))


def _systems(t: Table) -> DataFrame:
    staged = planet_staging(t("pscomppars"))
    return build_systems(build_hosts(staged), build_planets(staged))


_SYSTEMS_SQL = _HOSTS_SQL + """, y as (select replace(host_id, ':host:', ':system:') system_id, host_id, host_name, star_count, n::smallint planet_count, h.planet_count archive_planet_count, n = h.planet_count planet_count_matches_archive,
  system_distance_pc, is_circumbinary, 'exact_host_name' system_grouping_method, source from h join (select host_id, count(*) n from c group by 1) using (host_id))"""


@query(_SYSTEMS_SQL + " select * from y")
def systems(t: Table) -> DataFrame:
    return _systems(t)


@query(_SYSTEMS_SQL + f" select * exclude (planet_count_matches_archive, system_distance_pc), (planet_count - archive_planet_count)::smallint planet_count_difference, '{COUNT_REASON}' review_reason from y where not planet_count_matches_archive")
def count_mismatch_review(t: Table) -> DataFrame:
    return count_mismatches(_systems(t))


_RECORDS_SQL = f"""
with {_DISTANCE_SQL},
u as (select *, {_HELIO} from p qualify row_number() over (partition by gaia_source_id order by row_id) = 1),
h as (select * from exoplanet_hosts qualify row_number() over (partition by host_id order by host_row_id) = 1),
e as (select host_id, count(*) planet_count from exoplanets where host_id is not null group by 1)
"""


@query(_RECORDS_SQL + """select h.host_id, h.host_name, h.gaia_source_id, e.planet_count, h.planet_count archive_planet_count, e.planet_count = h.planet_count planet_count_matches_archive,
case when h.gaia_source_id is null then 'no_exact_gaia_source' when distance_pc is null then 'no_accepted_distance' else 'available' end position_status, distance_method, distance_quality
from h left join e using (host_id) left join u on u.gaia_source_id = h.gaia_source_id""")
def host_visualization(t: Table) -> DataFrame:
    return _records(t).select("host_id", "host_name", "gaia_source_id", "planet_count", "archive_planet_count", "planet_count_matches_archive", "position_status", "distance_method", "distance_quality")


def _records(t: Table) -> DataFrame:
    hosts = first_per_key(t("exoplanet_hosts"), ["host_id"], [F.col("host_row_id")])
    counts = t("exoplanets").dropna(subset=["host_id"]).groupBy("host_id").agg(F.count("*").alias("planet_count"))
    known = hosts.select("host_id", F.col("planet_count").alias("archive_planet_count")).join(counts, "host_id", "left").withColumn("planet_count_matches_archive", F.col("planet_count") == F.col("archive_planet_count"))
    sources = first_per_key(_placed(t).dropna(subset=["gaia_source_id"]), ["gaia_source_id"], [F.col("row_id")]).transform(with_distance).transform(with_heliocentric).transform(with_galactocentric)
    return host_records(hosts, known, sources.select("gaia_source_id", *SPATIAL, "phot_g_mean_magnitude", "bp_rp_color"))


@query(_RECORDS_SQL + """, r as (select case when h.gaia_source_id is null then 'no_exact_gaia_source' when distance_pc is null then 'no_accepted_distance' else 'available' end position_status
from h left join u on u.gaia_source_id = h.gaia_source_id) select position_status, count(*) n from r group by 1""")
def position_status_counts(t: Table) -> DataFrame:
    return _records(t).groupBy("position_status").agg(F.count("*").alias("n"))


_SCATTER_SQL = _RECORDS_SQL + ", r as (select h.host_id, hx, hy, e.planet_count, u.distance_method from h left join e using (host_id) join u on u.gaia_source_id = h.gaia_source_id where hx is not null and hy is not null)"


@query(_SCATTER_SQL + """, ext as (select least(0.0, min(hx)) x0, greatest(0.0, max(hx)) x1, least(0.0, min(hy)) y0, greatest(0.0, max(hy)) y1, count(*) positioned, greatest(1, max(planet_count)) most_planets from r)
select round(x0, 3) min_x, round(x1, 3) max_x, round(y0, 3) min_y, round(y1, 3) max_y, positioned, most_planets, round(greatest(x1 - x0, y1 - y0) / 2 * 1.08, 3) half_width from ext""")
def scatter_domain(t: Table) -> DataFrame:
    d = scatter_extent(_records(t), "heliocentric_x_pc", "heliocentric_y_pc")
    return d.select(*[F.round(f"{m}_heliocentric_{c}_pc", 3).alias(f"{m}_{c}") for c in "xy" for m in ("min", "max")], "positioned", "most_planets", F.round("half_width", 3).alias("half_width"))


@query(_SCATTER_SQL + """ select host_id, case when planet_count is not null then round(3 + 6 * least(1.0, greatest(0.0, (sqrt(planet_count) - 1) / (sqrt(m) - 1))), 6) end radius, case when distance_method = 'inverse_parallax' then 'amber' else 'blue' end colour
from r, (select greatest(1, max(planet_count)) m from r)""")
def scatter_markers(t: Table) -> DataFrame:
    return scatter_points(_records(t), "heliocentric_x_pc", "heliocentric_y_pc").select("host_id", F.round("radius", 6).alias("radius"), "colour")


@query(_RECORDS_SQL + """select h.host_id, case when h.host_id is null then 'host_id is missing' when host_name is null then 'host_name is missing' when e.planet_count is null then 'planet_count is missing' when h.planet_count is null then 'archive_planet_count is missing'
  when is_circumbinary is null then 'is_circumbinary is missing' end fault from h left join e using (host_id)""")
def record_review(t: Table) -> DataFrame:
    return record_faults(_records(t)).select("host_id", "fault")


@query("select row_id, gaia_source_id, designation, loaded_at from gaia where gaia_source_id = (select min(gaia_source_id) from gaia)")
def source_lookup(t: Table) -> DataFrame:
    gaia = t("gaia").select("row_id", "gaia_source_id", "designation", "loaded_at")
    return lookup(gaia, "gaia_source_id", gaia.agg(F.min("gaia_source_id")).first()[0])


_TRIANGLES = [(i, [30.0 * i + 1, 30.0 * i + 28, 30.0 * i + 10], [-60.0, 5.0 * i - 50, 60.0]) for i in range(12)]
_TRIANGLE_SQL = ", ".join(f"({i}, {x[0]}, {x[1]}, {x[2]}, {y[0]}, {y[1]}, {y[2]})" for i, x, y in _TRIANGLES)
_CROSSES = " + ".join(f"(((y{i} > dec_deg) <> (y{j} > dec_deg)) and ra_deg < x{i} + (dec_deg - y{i}) * (x{j} - x{i}) / nullif(y{j} - y{i}, 0))::int" for i, j in ((0, 1), (1, 2), (2, 0)))


@query(f"""with r(region_id, x0, x1, x2, y0, y1, y2) as (values {_TRIANGLE_SQL}) select distinct row_id, region_id from gaia join r
on ra_deg between least(x0, x1, x2) and greatest(x0, x1, x2) and dec_deg between -60 and 60 where coalesce({_CROSSES}, 0) % 2 = 1""")
def sources_in_regions(t: Table) -> DataFrame:
    gaia = t("gaia").select("row_id", "ra_deg", "dec_deg")
    regions = gaia.sparkSession.createDataFrame(_TRIANGLES, "region_id int, ra_list array<double>, dec_list array<double>")
    return regions_containing(gaia, regions, point_id="row_id", region_id="region_id", cell_deg=5.0)


def _stars(t: Table) -> DataFrame:
    """Canonical stars of the named faint stars: each catalogue's columns as its loader gives them."""
    clean = null_placeholders(strip_strings(t("wgsn_faints").select("star_name", "hip", "hr", "hd", "other_id", "constellation", "ra2000", "de2000", "vmag", "spectral_type", "distance_ly", "bv_color")))
    names = clean.select(F.col("star_name").alias("proper_name"), F.col("hr").alias("designation"), F.lit(None).cast("string").alias("hip"), F.lit(None).cast("string").alias("bayer_raw"), F.col("other_id").alias("simbad_spelling"), "constellation")
    names = names.withColumn("is_valid", F.col("proper_name").isNotNull() & F.col("constellation").isNotNull())
    faint = clean.withColumn("hip", without_prefix("hip", "HIP")).select(F.col("star_name").alias("name"), *[lenient_double(c).alias(n) for c, n in (("ra2000", "ra_deg"), ("de2000", "dec_deg"), ("vmag", "vmag"), ("distance_ly", "distance_ly"), ("bv_color", "bv_color"))], "spectral_type", "hd", "hr", "other_id", "hip")
    return build_stars(names, faint)


_STARS_SQL = f"""
with n as (select {", ".join(f"{cleaned(c)} {c}" for c in ("star_name", "hip", "hr", "hd", "other_id", "constellation"))}, {NUMBER_SQL.format("ra2000")} ra_deg from wgsn_faints),
k as (select *, {folded("star_name")} name_key from n),
s as (select 'iau:' || a.name_key star_id, a.name_key, a.star_name canonical_display_name, a.hr designation, a.other_id simbad_spelling, regexp_replace(b.hip, '^HIP\\s*', '', 'i') hip, b.hd, b.other_id, b.ra_deg
  from k a left join k b on a.name_key = b.name_key where a.star_name is not null and a.constellation is not null),
u as (select star_id, canonical_display_name alias, 'IAU' catalogue, 1 priority, true official from s union all select star_id, simbad_spelling, 'SIMBAD', 3, false from s union all select star_id, designation, 'HR', 6, false from s
  union all select star_id, 'HIP ' || hip, 'HIP', 5, false from s union all select star_id, 'HD ' || hd, 'HD', 4, false from s union all select star_id, other_id, 'other', 6, false from s),
a as (select star_id, alias, catalogue, priority, {folded("alias")} alias_search_key from u where alias <> '' and {folded("alias")} <> ''
  qualify row_number() over (partition by star_id, {folded("alias")} order by priority, official desc, catalogue, alias) = 1)
"""


@query(_STARS_SQL + "select star_id, name_key, canonical_display_name, designation, simbad_spelling, hip, hd, other_id, ra_deg, 'unavailable' distance_method from s")
def canonical_stars(t: Table) -> DataFrame:
    return _stars(t).select("star_id", "name_key", "canonical_display_name", "designation", "simbad_spelling", "hip", "hd", "other_id", "ra_deg", "distance_method")


@query(_STARS_SQL + "select * from a")
def star_aliases(t: Table) -> DataFrame:
    return build_aliases(_stars(t)).select("star_id", "alias", "catalogue", "priority", "alias_search_key")


_PAIRS_SQL = _STARS_SQL + f", d as (select distinct star_id, name_key from s), p as (select host_name, {folded('host_name')} host_key from (select distinct host_name from exoplanet_hosts) union all select distinct canonical_display_name, name_key from s)"


def _linked(t: Table) -> tuple[DataFrame, DataFrame]:
    stars = _stars(t)
    pairs = t("exoplanet_hosts").select("host_name").distinct().union(stars.select("canonical_display_name").distinct())
    return link_hosts(stars.select("star_id", "name_key").distinct(), pairs)


@query(_PAIRS_SQL + " select host_name, host_key, star_id from p join d on host_key = name_key")
def linked_hosts(t: Table) -> DataFrame:
    return _linked(t)[0].select("host_name", "host_key", "star_id")


@query(_PAIRS_SQL + " select host_name, host_key, 'host name not found in canonical stars' review_reason from p where not exists (select 1 from d where name_key = host_key)")
def unlinked_hosts(t: Table) -> DataFrame:
    return _linked(t)[1].select("host_name", "host_key", "review_reason")


@query(_STARS_SQL + """, o as (select star_id, list(alias order by priority, catalogue, alias) aliases, list(catalogue order by priority, catalogue, alias)[1] name_source, min(priority) label_priority from a group by 1),
e as (select star_id entity_id, min(canonical_display_name) display_name from s group by 1)
select (row_number() over (order by entity_id) - 1)::int name_index, 'star' entity_type, entity_id, display_name, name_source, aliases, label_priority from e left join o on star_id = entity_id""")
def star_name_table(t: Table) -> DataFrame:
    stars = _stars(t)
    one = stars.groupBy("star_id").agg(F.min("canonical_display_name").alias("canonical_display_name"), F.min("object_type").alias("object_type"))
    return build_name_table(one, build_aliases(stars))


def _names(t: Table) -> tuple[DataFrame, DataFrame]:
    clean = null_placeholders(strip_strings(t("wgsn_faints").select("wgsn_id", "star_name", "hip", "hd", "other_id")))
    stars = clean.where("star_name is not null").select(F.col("wgsn_id").alias("star_id"), F.col("star_name").alias("canonical_display_name"), F.lit(None).cast("double").alias("ra_deg"), F.lit(None).cast("double").alias("dec_deg"))
    kinds = (("star_name", "IAU", "iau_proper_name"), ("other_id", "other", "other_catalogue"), ("hip", "HIP", "hip"), ("hd", "HD", "hd"))
    rows = F.array(*[F.struct(F.col(c).alias("alias"), F.lit(k).alias("catalogue"), F.lit(PRIORITY[p]).alias("priority")) for c, k, p in kinds])
    aliases = clean.select(F.col("wgsn_id").alias("star_id"), F.explode(rows).alias("x")).select("star_id", "x.*").where("alias is not null")
    return stars, aliases.withColumn("alias_search_key", search_key("alias")).where("alias_search_key != ''")


_ALIAS_SQL = f"""
with f as (select wgsn_id star_id, {cleaned("star_name")} star_name, {cleaned("hip")} hip, {cleaned("hd")} hd, {cleaned("other_id")} other_id from wgsn_faints),
a as (select star_id, star_name alias, 'IAU' catalogue, 1 priority from f union all select star_id, other_id, 'other', 6 from f union all select star_id, hip, 'HIP', 5 from f union all select star_id, hd, 'HD', 4 from f),
k as (select *, {folded("alias")} key from a where alias is not null)
"""


@query(_ALIAS_SQL + """, m as (select k.*, star_name from k join f using (star_id) where starts_with(key, 'vel') and star_name is not null
  qualify row_number() over (partition by star_id order by key = 'vel' desc, priority, length(key), alias) = 1)
select star_id, star_name display_name, alias matched_alias, catalogue, key = 'vel' is_exact from m order by key = 'vel' desc, priority, length(key), star_name, star_id limit 20""")
def name_search_exact_prefix(t: Table) -> DataFrame:
    return search(*_names(t), "Vel", 20).select("star_id", "display_name", "matched_alias", "catalogue", "is_exact")


@query(_ALIAS_SQL + "select star_id, list_sort(list(distinct key)) keys from k where key <> '' group by 1")
def name_table(t: Table) -> DataFrame:
    return _names(t)[1].groupBy("star_id").agg(F.array_sort(F.collect_set("alias_search_key")).alias("keys"))


@query(f"select host_row_id, coalesce({', '.join(f"case when trim({c}) <> '' then {c} end" for c in ('host_name', 'hd_name', 'hip_name', 'gaia_dr3_designation'))}) display_name from exoplanet_hosts")
def display_name_fallback(t: Table) -> DataFrame:
    return t("exoplanet_hosts").select("host_row_id", display_name("host_name", "hd_name", "hip_name", "gaia_dr3_designation").alias("display_name"))


@query("select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') k from part")
def ascii_key(t: Table) -> DataFrame:
    return t("part").select("p_partkey", ascii_search_key("p_name").alias("k"))


@query(f"select distinct hostname, {folded('hostname')} k from pscomppars where hostname is not null")
def unicode_search_key(t: Table) -> DataFrame:
    return t("pscomppars").select("hostname").dropna().distinct().withColumn("k", search_key("hostname"))


# Heads of designations with their kind and the heads of their forms.
_HEADS = [
    ("α", "bayer", ("α", "alf", "Alpha")), ("beta", "bayer", ("β", "bet", "Beta")), ("gam", "bayer", ("γ", "gam", "Gamma")), ("δ1", "bayer", ("δ1", "del1", "Delta1")), ("Epsilon", "bayer", ("ε", "eps", "Epsilon")),
    ("zet02", "bayer", ("ζ02", "zet02", "Zeta02")), ("η", "bayer", ("η", "eta", "Eta")), ("V1054", "variable", ()), ("61", "flamsteed", ()), ("unknown", "unparsed", ()),
]
_HEAD_SQL = ", ".join(f"({i}, '{h}', '{k}', {list(f)}::varchar[])" for i, (h, k, f) in enumerate(_HEADS))


@query(f"""with h(i, head, kind, heads) as (values {_HEAD_SQL}), w as (select wgsn_id, {cleaned("constellation")} c, length(wgsn_id) + coalesce(length(star_name), 0) n from wgsn_faints)
select wgsn_id, head || ' ' || c raw, case when c is not null then kind end kind, case when c is null then []::varchar[] else list_transform(heads, lambda x: x || ' ' || c) end forms from w join h on n % 10 = i""")
def bayer_forms(t: Table) -> DataFrame:
    heads = F.array(*[F.lit(h) for h, _, _ in _HEADS])
    at = F.pmod(F.char_length("wgsn_id") + F.coalesce(F.char_length("star_name"), F.lit(0)), F.lit(10))
    clean = null_placeholders(strip_strings(t("wgsn_faints").select("constellation", "wgsn_id", at.cast("string").alias("at"))))
    made = clean.select("wgsn_id", F.concat(F.get(heads, F.col("at").cast("int")), F.lit(" "), F.col("constellation")).alias("raw"))
    return made.select("wgsn_id", "raw", parse_designation("raw")["kind"].alias("kind"), designation_aliases("raw").alias("forms"))


@query("select doc_id, sha256(text) digest, length(text) characters from documents")
def text_digest(t: Table) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.char_length("text").alias("characters"))


@query("select host_row_id, round(least(9, greatest(3, 3 + 6 * sqrt(planet_count / 8.0))), 6) radius from exoplanet_hosts")
def marker_radius(t: Table) -> DataFrame:
    return t("exoplanet_hosts").select("host_row_id", F.round(F.least(F.lit(9.0), F.greatest(F.lit(3.0), 3 + 6 * F.sqrt(F.col("planet_count") / 8.0))), 6).alias("radius"))


@query("""with c as (select ra_deg x, dec_deg y, unnest([128, 256, 512]) grid_level from gaia where ra_deg between 0 and 360 and dec_deg between -90 and 90)
select grid_level, least(grid_level - 1, floor(x / 360.0 * grid_level))::int cell_x, least(grid_level - 1, floor((y - -90.0) / 180.0 * grid_level))::int cell_y, count(*) points from c group by all""")
def density_grid(t: Table) -> DataFrame:
    return density_cells(t("gaia"), "ra_deg", "dec_deg", (128, 256, 512), (0.0, -90.0, 360.0, 90.0))


@query("""with f as (select ra_deg x, dec_deg y, case when abs(phot_g_mean_mag) < 'inf'::double then phot_g_mean_mag end m, case when abs(bp_rp) < 'inf'::double then bp_rp end c, case when abs(ruwe) < 'inf'::double then ruwe end q from gaia
  where ra_deg between 0 and 360 and dec_deg between -90 and 90)
select 32 grid_level, least(31, floor(x / 360.0 * 32))::int cell_x, least(31, floor((y - -90.0) / 180.0 * 32))::int cell_y, count(*) points, round(ln(sum(pow(10.0, -0.4 * m))), 6) brightness, round(avg(c), 6) mean_colour, round(avg(q), 4) mean_quality from f group by all""")
def density_means(t: Table) -> DataFrame:
    cells = density_cells(t("gaia"), "ra_deg", "dec_deg", (32,), (0.0, -90.0, 360.0, 90.0), magnitude="phot_g_mean_mag", colour="bp_rp", quality="ruwe")
    return cells.select("grid_level", "cell_x", "cell_y", "points", F.round(F.ln("weighted_brightness"), 6).alias("brightness"), F.round("mean_colour", 6).alias("mean_colour"), F.round("mean_quality", 4).alias("mean_quality"))


@query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n from events group by all")
def events_by_hour(t: Table) -> DataFrame:
    return windowed_counts(t("events"), time="ts", by=["event_type"], window="1 hour", late="10 minutes")


_CHANGED = "gaia_dr3_id sy_pnum sy_snum st_teff st_mass st_rad st_lum pl_rade pl_bmasse pl_orbper disc_year".split()
SQL["p1_found"] = f"""
with r as (select {folded("pl_name")} planet_key, snapshot_no, delivered_at, nullif({trimmed("gaia_dr3_id")}, '') gaia_dr3_id, {", ".join(_CHANGED[1:])} from pscomppars),
l as (select * from r where planet_key <> '' qualify row_number() over (partition by planet_key, snapshot_no order by delivered_at desc) = 1),
s as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) later from (select distinct snapshot_no from pscomppars)),
o as (select l.*, later from l join s using (snapshot_no) where later is not null),
n as (select l.* from l where snapshot_no > (select min(snapshot_no) from s)),
j as (select coalesce(o.planet_key, n.planet_key) planet_key, coalesce(o.later, n.snapshot_no) snapshot_no,
  case when o.planet_key is null then 'added' when n.planet_key is null then 'removed' when {" or ".join(f"o.{c} is distinct from n.{c}" for c in _CHANGED)} then 'changed' end change_kind
  from o full join n on o.planet_key = n.planet_key and o.later = n.snapshot_no)
select planet_key, snapshot_no, change_kind from j where change_kind is not null
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["host_visualization"](spark, sf_dir)
