"""DuckDB SQL giving the same rows as the pN_ queries of the core that SQL can express."""

from skyfold.sources.schemas import PSCOMPPARS

_KEY = r"nullif(nullif(lower(regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), ''), '-')"
_H, _C = _KEY.format("h.host_id"), _KEY.format("c.host_id")
_NUMBER = r"case when regexp_full_match(trim({0}), '[+-]?[0-9]+(\.[0-9]+)?') then try_cast(trim({0}) as double) end"

P2 = f"""
with s as (select distinct wgsn_id, {_NUMBER.format("ra2000")} ra, {_NUMBER.format("de2000")} de from wgsn_faints),
t as (select *, floor(de * 100) b from s where ra between 0 and 360 and de between -90 and 90),
x as (select wgsn_id, ra, de, unnest([b - 1, b, b + 1]) b from t),
g as (select distinct gaia_source_id, ra_deg, dec_deg, floor(dec_deg * 100) b from gaia where ra_deg between 0 and 360 and dec_deg between -90 and 90 and gaia_source_id is not null)
select distinct wgsn_id, gaia_source_id from x join g using (b)
where 2 * asin(least(1, sqrt(pow(sin(radians(dec_deg - de) / 2), 2) + cos(radians(de)) * cos(radians(dec_deg)) * pow(sin(radians(ra_deg - ra) / 2), 2)))) <= radians(5 / 3600.0)
"""

P3 = f"""
with refs as (
  select 'exoplanets.host_id' ref_column, row_id child_row_id, {_C} k, null::bigint g, loaded_at t from exoplanets c
  union all select 'exoplanets.gaia_source_id', row_id, null, gaia_source_id, loaded_at from exoplanets
  union all select 'exoplanet_hosts.gaia_source_id', host_row_id, null, gaia_source_id, loaded_at from exoplanet_hosts),
hosts as (select {_H} k, loaded_at, deleted_at from exoplanet_hosts h),
sources as (select gaia_source_id g, min(loaded_at) first from gaia where gaia_source_id is not null group by 1),
h as (select ref_column, child_row_id, r.t, count(h.k) n, coalesce(bool_or(h.loaded_at <= r.t), false) started,
        coalesce(bool_or(h.loaded_at <= r.t and (h.deleted_at is null or h.deleted_at > r.t)), false) there
      from refs r left join hosts h on h.k = r.k where r.k is not null group by all),
j as (select ref_column, child_row_id, t, case when n = 0 then 'missing' when there then null when started then 'deleted' else 'late' end reason from h
      union all select ref_column, child_row_id, t, case when s.g is null then 'missing' when first <= t then null else 'late' end from refs r left join sources s on s.g = r.g where r.g is not null)
select ref_column, child_row_id, reason, strftime(t, '%Y-%m') load_month from j where reason is not null
"""

P3_REPORT = f"select ref_column, load_month, reason, count(*) orphans from ({P3}) group by all"

P6 = r"""
with l as (select raw_id, coalesce(raw_line, '') line from pscomppars_raw),
q as (select *, not regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*') broken from l),
f as (select *, case when not broken then list_transform(regexp_extract_all(line || ',', '((?:"(?:[^"]|"")*"|[^",\r\n]*)),', 1),
        lambda v: case when v like '"%' then replace(v[2:-2], '""', '"') else v end) end fields from q),
v as (select raw_id, broken, len(fields) n, trim(fields[8], ' ') ra, trim(fields[7], ' ') id from f),
c as (select *, case when regexp_full_match(ra, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(ra as double) end deg from v),
r as (select raw_id, case when broken then 'broken_quote' when n <> 31 then 'column_count' when deg is null or deg not between 0 and 360 then 'bad_ra'
        when not (id = '' or (regexp_full_match(id, 'Gaia DR3 [0-9]+') and try_cast(id[10:] as bigint) is not null)) then 'bad_gaia_dr3_id' end reason from c)
select raw_id, reason from r where reason is not null
"""

_STRINGS, _SHORTS = (1, 2, 3, 4, 5, 6, 7, 20, 28, 30), (11, 12, 13, 29, 31)


def _field(i: int, name: str) -> str:
    if i in _STRINGS:
        return f"nullif(fields[{i}], '') {name}"
    kind = "double" if i not in _SHORTS else "tinyint" if name in ("cb_flag", "pl_controv_flag") else "smallint"
    pattern = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?" if kind == "double" else "[+-]?[0-9]+"
    return f"case when regexp_full_match(trim(fields[{i}], ' '), '{pattern}') then try_cast(trim(fields[{i}], ' ') as {kind}) end {name}"


def loaded_sql(names: list[str]) -> str:
    """The lines that load, typed; the grammar and the checks are those of ``P6``."""
    lines = P6[: P6.index("v as (select raw_id, broken")].rstrip().rstrip(",").replace("select raw_id, coalesce", "select raw_id, file_name, line_no, coalesce")
    return f"{lines} select raw_id, file_name, line_no, {', '.join(_field(i, n) for i, n in enumerate(names, 1))} from f anti join ({P6}) x using (raw_id)"


P7_PROFILE = """
with v as (
  select retrieval_id, load_no, 'parallax' column_name, parallax v, parallax between -50 and 800 and not isnan(parallax) ok from gaia
  union all select retrieval_id, load_no, 'ruwe', ruwe, ruwe > 0 and ruwe <= 100 and not isnan(ruwe) from gaia
  union all select retrieval_id, load_no, 'distance_gspphot', distance_gspphot, distance_gspphot > 0 and distance_gspphot <= 50000 and not isnan(distance_gspphot) from gaia),
c as (select retrieval_id, load_no, column_name, v, count(*) m from v where ok group by all),
t as (select retrieval_id, load_no, column_name, max(m) m, arg_max(v, m) v from c group by all),
p as (select retrieval_id, load_no, column_name, count(*) as rows, count(*) - count(v) nulls, count(*) filter (where ok) usable, count(v) - count(*) filter (where ok) bad,
        min(v) filter (where ok) least, max(v) filter (where ok) most, median(v) filter (where ok) median from v group by all)
select p.retrieval_id, p.load_no, p.column_name, rows, nulls, nulls / rows null_share, usable, bad, bad / nullif(bad + usable, 0)::double bad_share, least, most, median,
  case when m > 0.25 * usable then t.v end top_value, case when m > 0.25 * usable then m / usable end top_share
from p left join t using (retrieval_id, load_no, column_name)
"""

P7 = f"""
with p as ({P7_PROFILE}), b as (select retrieval_id, load_no + 1 load_no, column_name, null_share ns, median md from p),
j as (select p.*, ns, md from p left join b using (retrieval_id, load_no, column_name))
select retrieval_id, load_no, column_name, 'null_jump' finding from j where abs(null_share - ns) > 0.15
union all select retrieval_id, load_no, column_name, 'median_jump' from j where median > 2 * md or median < md / 2
union all select retrieval_id, load_no, column_name, 'bad_values' from j where bad_share > 0.03
union all select retrieval_id, load_no, column_name, 'constant_fill' from j where top_share is not null
"""

P7_DIFFERENT = f"""
with d as (select retrieval_id, load_no, unnest(['parallax', 'ruwe', 'distance_gspphot']) column_name, unnest([parallax, ruwe, distance_gspphot]) v from gaia)
select p.* replace (round(median, 9) as median), n different
from ({P7_PROFILE}) p join (select retrieval_id, load_no, column_name, count(distinct v) n from d group by all) using (retrieval_id, load_no, column_name)
"""

P7_COLUMNS = """
with d as (select unnest(['parallax', 'ruwe', 'distance_gspphot']) column_name, unnest([parallax, ruwe, distance_gspphot]) v from gaia)
select column_name, count(*) as rows, count(*) - count(v) nulls, min(v) filter (where not isnan(v)) least, max(v) filter (where not isnan(v)) most, count(distinct v) different from d group by 1
"""

P7_PATTERNS = """
with d as (select retrieval_id, load_no, 'designation' column_name, designation t, 'Gaia DR3 [0-9]+' p from gaia union all select retrieval_id, load_no, 'phot_variable_flag', phot_variable_flag, 'VARIABLE|CONSTANT|NOT_AVAILABLE' from gaia)
select retrieval_id, load_no, column_name, count(*) as rows, count(*) - count(t) nulls, count(*) filter (where not regexp_full_match(t, p)) violations, violations / nullif(count(t), 0) violation_share from d group by all
"""

SQL = {"p6_loaded": loaded_sql(PSCOMPPARS.names), "p2_found": P2, "p3_found": P3, "p3_report": P3_REPORT, "p6_found": P6, "p7_profile": P7_DIFFERENT, "p7_columns": P7_COLUMNS, "p7_patterns": P7_PATTERNS, "p7_found": P7}
