"""SQL twins of the named queries, for an engine that reads the same tables.

They are written from the definitions, not from the Spark plans: distance joins
compare all pairs, geometry is taken apart into rows of vertices, medians and
quartiles use the engine's own aggregates.
"""

from __future__ import annotations

from geoledger.sources import derived as D

_TABLES = {n: n for n in ("orders", "customer", "part", "events", "buildings")}


def _cte(text: str) -> str:
    return text.format(**_TABLES)


_HAVERSINE = (
    "2 * 6371000 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
    " + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
)


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _HAVERSINE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


_PAIR_DISTANCE = metres("b.latitude", "b.longitude", "c.center_lat", "c.center_lon")

_STYLE_YEAR = (
    "case lower(style_tag) when 'victorian' then 1890 when 'edwardian' then 1905 when 'art_deco' then 1925"
    " when 'modernist' then 1955 when 'contemporary' then 1990 end"
)

_CTES = {
    "businesses": ([], _cte(D.BUSINESSES)),
    "buildings": ([], _cte(D.BUILDINGS)),
    "tags": (["buildings"], _cte(D.TAGS)),
    "history": ([], _cte(D.HISTORY)),
    "refreshes": ([], _cte(D.REFRESHES)),
    "loads": ([], _cte(D.LOADS)),
    "located": (["businesses"], "select * from businesses where longitude is not null and latitude is not null"),
    "vertices": (["buildings"], """
        select osm_id, i, cast(split_part(p, ' ', 1) as double) as x, cast(split_part(p, ' ', 2) as double) as y
        from (select osm_id, generate_subscripts(ps, 1) as i, trim(unnest(ps)) as p
              from (select osm_id, string_split(replace(replace(geom_wkt, 'POLYGON ((', ''), '))', ''), ',') as ps
                    from buildings where geom_wkt is not null) s) v"""),
    "edges": (["vertices"], """
        select a.osm_id, a.i, o.x as ox, o.y as oy, a.x as ax, a.y as ay, b.x as qx, b.y as qy
        from vertices a join vertices b on a.osm_id = b.osm_id and b.i = a.i + 1
             join vertices o on o.osm_id = a.osm_id and o.i = 1"""),
    "moments": (["edges"], """
        select osm_id, ox, oy, sum(cr) as a2, sum(((ax - ox) + (qx - ox)) * cr) as mx, sum(((ay - oy) + (qy - oy)) * cr) as my
        from (select *, (ax - ox) * (qy - oy) - (qx - ox) * (ay - oy) as cr from edges) e
        group by osm_id, ox, oy"""),
    "centred": (["buildings", "moments"], """
        select m.osm_id, building_type, building_category,
               round(ox + mx / (3 * a2), 7) as center_lon, round(oy + my / (3 * a2), 7) as center_lat
        from moments m join buildings b on b.osm_id = m.osm_id where a2 <> 0"""),
    "pairs": (["located", "centred"], """
        select c.osm_id as building_id, building_type, building_category, center_lon as building_center_lon,
               center_lat as building_center_lat, unique_id as business_id, naics_code, naics_description,
               business_start_date, business_end_date,
               sqrt((longitude - center_lon) * (longitude - center_lon) + (latitude - center_lat) * (latitude - center_lat)) as distance_degrees
        from located b join centred c
          on longitude between center_lon - 0.001 and center_lon + 0.001
         and (longitude - center_lon) * (longitude - center_lon) + (latitude - center_lat) * (latitude - center_lat) <= cast(0.0005 as double) * cast(0.0005 as double)"""),
    "reach": (["located", "centred"], f"""
        select unique_id as business_unique_id, longitude as business_lon, latitude as business_lat,
               dba_name as business_name, c.osm_id as building_osm_id, building_type, center_lon as building_lon,
               center_lat as building_lat, {_PAIR_DISTANCE} as distance_meters
        from located b join centred c
          on latitude between center_lat - 0.002 and center_lat + 0.002
         and longitude between center_lon - 0.003 and center_lon + 0.003"""),
    "ranked": (["reach"], """
        select *, row_number() over (partition by business_unique_id order by distance_meters, building_osm_id) as k from reach"""),
    "nearest": (["ranked"], "select * exclude (k) from ranked where k = 1 and distance_meters <= 100"),
    "raw": (["businesses"], """
        select *, case when unique_id % 101 = 0 then null else longitude end as raw_lon,
               case when unique_id % 101 = 0 then null else latitude end as raw_lat,
               case when unique_id % 333 = 0 then null else business_start_date end as raw_start,
               case when unique_id % 500 = 0 then null else zipcode end as raw_zip,
               case when unique_id % 101 = 0 then 'POINT (unknown place)'
                    when longitude is not null then concat('POINT (', cast(longitude as varchar), ' ', cast(latitude as varchar), ')') end as location
        from businesses"""),
    "aged": (["tags"], f"""
        select *, case when regexp_matches(start_date_tag, '\\b(19|20)\\d\\d\\b') then cast(regexp_extract(start_date_tag, '\\b((19|20)\\d\\d)\\b', 1) as integer) end as y1,
               case when regexp_matches(construction_tag, '\\b(19|20)\\d\\d\\b') then cast(regexp_extract(construction_tag, '\\b((19|20)\\d\\d)\\b', 1) as integer) end as y2,
               {_STYLE_YEAR} as y3
        from tags"""),
    "typed": (["aged"], """
        select osm_id, geom_wkt, style_tag, street_tag, element_type,
               case when coalesce(building_tag, 'yes') = '' then 'unknown' else coalesce(building_tag, 'yes') end as building_type,
               case lower(coalesce(building_tag, 'yes')) when 'house' then 'residential' when 'retail' then 'commercial'
                    when 'warehouse' then 'industrial' when 'school' then 'institutional' when 'garage' then 'utility'
                    when 'yes' then 'unknown' when '' then 'unknown' else 'other' end as building_category,
               case when height_tag like '%ft' then cast(split_part(height_tag, ' ', 1) as double) * cast(0.3048 as double)
                    else cast(split_part(height_tag, ' ', 1) as double) end as height,
               cast(trunc(try_cast(levels_tag as double)) as integer) as levels,
               coalesce(y1, y2, y3) as construction_year, 2024 - coalesce(y1, y2, y3) as estimated_age_years,
               case when y1 is not null then 'start_date' when y2 is not null then 'construction_date'
                    when y3 is not null then 'architectural_style' end as age_source
        from aged"""),
}


def sql(select: str, *needs: str, recursive: dict[str, str] | None = None, **extra: str) -> str:
    """``select`` under the named common tables and everything they need."""
    extra = {**extra, **(recursive or {})}
    order: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} as ({_CTES[n][1].strip()})" for n in order]
    parts += [f"{n} as ({text.strip()})" for n, text in extra.items()]
    head = ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" if parts else ""
    return head + select.strip()


def kinds(column: str) -> str:
    """Distinct values, null counted as one."""
    return f"count(distinct {column}) + cast(max(case when {column} is null then 1 else 0 end) as bigint)"


def mean(column: str) -> str:
    """Mean of a coordinate as whole ten-millionths."""
    return f"cast(sum(cast(round({column} * 10000000) as bigint)) as double) / count(*) / cast(10000000 as double)"


def bands(n: str, *steps: tuple[int, str], rest: str) -> str:
    return "case " + " ".join(f"when {n} >= {t} then '{label}'" for t, label in steps) + f" else '{rest}' end"


def top_value(source: str, keys: str, column: str) -> str:
    """Most frequent non-null value per keys, smallest on a tie."""
    return (
        f"select {keys}, {column} as top_{column} from (select {keys}, {column}, row_number() over (partition by {keys} "
        f"order by count(*) desc, {column}) as k from {source} where {column} is not null group by {keys}, {column}) q where k = 1"
    )


B_BANDS = bands("business_count", (10, "very_high"), (5, "high"), (2, "medium"), (1, "low"), rest="none")
F_BANDS = bands("business_count", (20, "very_high"), (10, "high"), (5, "medium"), (2, "low"), rest="minimal")
S_BANDS = bands("business_count", (10, "very_high"), (5, "high"), (2, "medium"), rest="low")

ORACLES: dict[str, str] = {}
O = ORACLES

# Scans, sources, sinks
O["scan_registrations"] = sql("""
select cast(unique_id as varchar) as unique_id, concat('  ', dba_name, ' ', chr(9)) as dba_name, raw_zip as zipcode, naics_code,
       case when unique_id % 333 = 0 then '13/45/2020' else strftime(business_start_date, '%m/%d/%Y') end as start_text,
       location, cast(null as varchar) as mail_city from raw""", "raw")
O["scan_pruned"] = "select o_orderkey as business_id, o_orderdate as started from orders"
O["scan_osm_elements"] = sql("""
select t.osm_id, element_type as osm_type, building_type, building_category, street_tag as addr_street, round(height, 3) as height, levels,
       construction_year, estimated_age_years, age_source, 1 as version, ring.wkt as geom_wkt
from typed t join (select osm_id, concat('POLYGON ((', string_agg(concat(cast(x as varchar), ' ', cast(y as varchar)), ', ' order by i), '))') as wkt
                   from vertices group by osm_id) ring on ring.osm_id = t.osm_id
where t.osm_id % 29 <> 0 and element_type = 'way'""", "typed", "vertices")
O["sink_parquet"] = sql("select unique_id, naics_code, longitude, latitude, business_start_date from businesses", "businesses")
O["sink_partitioned"] = sql("select unique_id, naics_code, neighborhood from businesses where neighborhood in ('BUILDING', 'MACHINERY')", "businesses")
O["sink_snapshot"] = sql("""
select s as snapshot_ts, count(*) as row_count, cast(sum(osm_id) as bigint) as id_sum
from buildings, (values ('20240101_000000'), ('20240102_000000')) v(s) group by s""", "buildings")
_PROXY = """
case building_category when 'commercial' then osm_id % 15 + 5 when 'residential' then osm_id % 8 + 1 else osm_id % 3 end"""
_LEVEL = "case building_category when 'commercial' then 'high' when 'residential' then 'medium' else 'low' end"
_COUNTED = f"""
select osm_id, building_type, building_category, center_lon, center_lat, coalesce(n, 0) as business_count,
       case when n is null then 'none' else {bands("n", (20, "very_high"), (10, "high"), (5, "medium"), (2, "low"), rest="minimal")} end as density_category
from centred left join (select building_id, count(*) as n from pairs group by 1) k on building_id = osm_id"""
O["sink_geojson"] = sql(f"""
select concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', cast(center_lon as varchar), ',', cast(center_lat as varchar),
  ']}},"properties":{{"osm_id":', cast(osm_id as varchar), ',"building_type":"', building_type, '","building_category":"', building_category,
  '","business_count":', cast(business_count as varchar), ',"density_category":"', density_category, '"}}}}') as feature from ({_COUNTED}) c""", "centred", "pairs")
O["sink_csv"] = sql("select unique_id, dba_name, zipcode, naics_code from businesses", "businesses")
O["append_refresh_events"] = sql("""
select strftime(ts, '%Y%m') as month, event_type, status, count(*) as event_count from refreshes group by all""", "refreshes")
O["sink_jdbc"] = sql("""
select b.osm_id, b.building_type, cast(null as varchar) as address, geom_wkt, center_lon as centroid_lon, center_lat as centroid_lat
from buildings b left join centred c on c.osm_id = b.osm_id""", "buildings", "centred")
O["verify_load"] = sql(f"""
select count(*) as source_rows, count(*) as target_rows, count(longitude) as rows_with_coordinates, true as counts_match,
       count(longitude) > 0 as has_coordinates, round({metres("37.7749::double", "(-122.4194)::double", "37.7849::double", "(-122.4094)::double")}, 4) as distance_test
from businesses""", "businesses")

# Projections, parsing, cleaning
O["parse_point"] = sql("select cast(unique_id as varchar) as unique_id, raw_lon as longitude, raw_lat as latitude from raw", "raw")
O["clean_text"] = sql("select cast(unique_id as varchar) as unique_id, dba_name, street_address, city, state from businesses", "businesses")
O["parse_us_date"] = sql("""
select cast(unique_id as varchar) as unique_id, raw_start as start_date, business_end_date as end_date from raw""", "raw")
O["clean_registrations"] = sql("""
select cast(unique_id as varchar) as unique_id, cast(business_account_number as varchar) as business_account_number,
       cast(location_id as varchar) as location_id, ownership_name, dba_name, street_address, city, state, raw_zip as zipcode,
       raw_start as business_start_date, business_end_date, business_start_date as location_start_date,
       cast(null as timestamp) as location_end_date, naics_code, naics_description, raw_lon as longitude, raw_lat as latitude,
       cast(supervisor_district as varchar) as supervisor_district, neighborhood
from raw where raw_lon between -122.6 and -122.3 and raw_lat between 37.7 and 37.9""", "raw")
O["classify_building"] = sql("select osm_id, building_type, building_category from typed", "typed")
O["estimate_building_age"] = sql("select osm_id, construction_year, estimated_age_years, age_source from typed", "typed")
O["parse_height"] = sql("select osm_id, round(height, 6) as height_m from typed", "typed")
O["parse_levels"] = sql("select osm_id, levels from typed", "typed")
O["build_polygon_wkt"] = sql("""
select b.osm_id, wkt from buildings b left join (
  select osm_id, concat('POLYGON ((', string_agg(concat(cast(x as varchar), ' ', cast(y as varchar)), ', ' order by i), '))') as wkt
  from vertices where osm_id % 29 <> 0 group by osm_id) r on r.osm_id = b.osm_id""", "vertices")
O["simplify_terraces"] = """
WITH h AS (SELECT p_partkey AS osm_id, CAST(p_partkey % 50 AS BIGINT) AS i, CAST(p_partkey // 50 AS BIGINT) AS j FROM part),
c AS (SELECT osm_id, i, j, (7 * i + 3 * j) % 4 = 0 AS low, (7 * (i + 1) + 3 * j) % 5 = 0 AS rightmost, (7 * i + 3 * (j + 1)) % 4 = 0 AS high,
  (7 * i + 3 * j) % 5 = 0 AS leftmost FROM h),
n AS (SELECT *, low::INT + rightmost::INT + high::INT + leftmost::INT AS bends FROM c)
SELECT osm_id, 9 AS vertices_before, CAST(5 + bends AS INTEGER) AS vertices_after,
  CAST(4 * 100 * i + 200 + bends * 100 * i + 50 * (low::INT + high::INT) + 130 * rightmost::INT + 30 * leftmost::INT AS BIGINT) AS x_total,
  CAST(4 * 100 * j + 200 + bends * 100 * j + 30 * low::INT + 130 * high::INT + 50 * (rightmost::INT + leftmost::INT) AS BIGINT) AS y_total
FROM n
"""
O["simplify_footprints"] = sql("""
select b.osm_id, wkt as geom_wkt, case when wkt is not null then 9 end as vertices_before, case when wkt is not null then 5 end as vertices_after
from buildings b left join (
  select osm_id, concat('POLYGON ((', string_agg(concat(cast(x as varchar), ' ', cast(y as varchar)), ', ' order by i), '))') as wkt
  from vertices group by osm_id) r on r.osm_id = b.osm_id""", "vertices")
O["wkt_centroid"] = sql("select osm_id, center_lon, center_lat from centred", "centred")
O["wkt_vertex_mean"] = sql("""
select osm_id, round(sum(x) / count(*), 7) as mean_lon, round(sum(y) / count(*), 7) as mean_lat from vertices group by osm_id""", "vertices")
O["wkt_first_vertex"] = sql("select osm_id, x as first_lon, y as first_lat from vertices where i = 1", "vertices")
O["haversine_m"] = sql(f"""
select unique_id, round({metres("latitude", "longitude", "37.7749::double", "(-122.4194)::double")}, 4) as meters from businesses""", "businesses")
_FROM_CENTRE = """sqrt((longitude - (-122.4194)::double) * (longitude - (-122.4194)::double)
  + (latitude - 37.7749::double) * (latitude - 37.7749::double))"""
O["distance_degrees"] = sql(f"select unique_id, round({_FROM_CENTRE}, 9) as degrees from businesses", "businesses")
O["grid_cell_floor"] = sql("""
select unique_id, s as grid_size, cast(floor(longitude / s) as bigint) as grid_x, cast(floor(latitude / s) as bigint) as grid_y,
       concat(cast(cast(floor(longitude / s) as bigint) as varchar), '_', cast(cast(floor(latitude / s) as bigint) as varchar)) as grid_key
from located, (values (0.01::double), (0.001::double), (0.0001::double)) v(s)""", "located")


def rounded(column: str, size: str) -> str:
    return f"cast(round_even({column} / {size}, 0) as bigint)"


_S12, _S10 = "(0.001::double * 3)", "(0.001::double * 5 / 10)"
O["grid_cell_round"] = sql(
    "select unique_id, "
    + ", ".join(
        f"{rounded('longitude', s)} as {n}_x, {rounded('latitude', s)} as {n}_y"
        for n, s in (("fixed", "0.002::double"), ("z12", _S12), ("c10", _S10))
    )
    + " from located", "located")
_HEX_Q = "cast(round_even(sqrt(3::double) / 3 * (longitude / s) - 1::double / 3 * (latitude / s), 0) as bigint)"
_HEX_R = "cast(round_even(2::double / 3 * (latitude / s), 0) as bigint)"
_HEX_ZOOMS = "(select z, 0.1::double / pow(2, z - 1) as s from range(1, 9) t(z))"
O["hex_cell"] = sql(f"""
select unique_id, cast(z as integer) as zoom_level, {_HEX_Q} as hex_q, {_HEX_R} as hex_r from located, {_HEX_ZOOMS} q""", "located")
_CLASS = "cast('0x' || substr(md5(naics_code), 1, 8) as bigint) % 10"
O["hash_bucket"] = sql(f"select unique_id, {_CLASS} as bucket from businesses", "businesses")
O["age_proxy"] = sql("select unique_id, cast(coalesce(2024 - year(business_start_date), 5) as integer) as age from businesses", "businesses")


def channel(values: tuple[int, ...]) -> str:
    return "case coalesce(cls, 9) " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


_RED, _GREEN, _BLUE = (255, 254, 252, 227, 177, 128, 102, 35, 0, 65), (237, 178, 78, 26, 0, 0, 166, 139, 109, 105), (160, 76, 42, 28, 38, 38, 30, 69, 119, 225)
O["pack_points"] = sql(f"""
select unique_id, longitude as lon, latitude as lat,
       cast(case when age <= 5 then 4 when age <= 10 then 3 else 2 end as double) as size,
       cast({channel(_RED)} as double) as red, cast({channel(_GREEN)} as double) as green, cast({channel(_BLUE)} as double) as blue,
       200::double as alpha
from (select *, {_CLASS} as cls, coalesce(2024 - year(business_start_date), 5) as age from located) q""", "located")
_BY_ACCOUNT = "(select business_account_number, count(*) as n, count(distinct naics_description) as d from businesses group by 1) q"
O["density_category"] = sql(f"""
select business_account_number, n,
  {bands("n", (10, "very_high"), (5, "high"), (2, "medium"), (1, "low"), rest="none")} as building,
  {bands("n", (10, "very_high"), (5, "high"), (2, "medium"), rest="low")} as slim_building,
  {bands("n", (20, "very_high"), (10, "high"), (5, "medium"), (2, "low"), rest="minimal")} as full_building,
  {bands("n", (50, "very_high"), (25, "high"), (10, "medium"), (1, "low"), rest="none")} as grid,
  {bands("n", (50, "very_high"), (20, "high"), (5, "medium"), rest="low")} as slim_grid,
  {bands("n", (100, "very_high"), (50, "high"), (20, "medium"), (5, "low"), rest="minimal")} as full_grid,
  {bands("n", (20, "very_high"), (10, "high"), (5, "medium"), (1, "low"), rest="none")} as business_grid
from {_BY_ACCOUNT}""", "businesses")
O["intensity_score"] = sql(f"""
select business_account_number, least(100, 10 * n + 5 * d) as first_score, least(100, 10 * n) as slim_score, least(100, 5 * n + 3 * d) as full_score
from {_BY_ACCOUNT}""", "businesses")
O["mixed_use_flag"] = sql(f"select business_account_number, d >= 3 as mixed_use from {_BY_ACCOUNT}", "businesses")
O["proximity_quality"] = sql(f"select unique_id, round(1 / (1 + {_FROM_CENTRE} * 1000), 9) as quality from businesses", "businesses")
O["category_density_proxy"] = sql(f"""
select osm_id, cast({_PROXY} as integer) as business_count, {_LEVEL} as business_intensity, cast(osm_id % 10 as integer) as business_density from centred""", "centred")

# Filters and lookups
_IN_BOX = "longitude between -122.42 and -122.40 and latitude between 37.765 and 37.78"
O["bbox_filter"] = O["sink_located"] = sql(f"select unique_id, longitude, latitude from businesses where {_IN_BOX}", "businesses")
O["businesses_in_bbox"] = sql(f"""
select unique_id, dba_name, longitude, latitude, naics_code, naics_description, neighborhood, supervisor_district
from businesses where {_IN_BOX} and naics_code = '7207' and neighborhood = 'BUILDING'""", "businesses")
O["businesses_near_building"] = sql("""
select unique_id, business_account_number, dba_name, naics_description, street_address, longitude, latitude
from located, (select center_lon, center_lat from centred where osm_id = 1) c
where longitude between center_lon - 0.002::double and center_lon + 0.002::double and latitude between center_lat - 0.002::double and center_lat + 0.002::double
order by sqrt((longitude - center_lon) * (longitude - center_lon) + (latitude - center_lat) * (latitude - center_lat)), unique_id limit 20""", "located", "centred")
O["not_null_filter"] = sql("select unique_id, naics_code from located where unique_id is not null and naics_code is not null", "located")
O["buildings_in_bbox"] = sql(f"""
select * from ({_COUNTED}) c where center_lon between -122.42 and -122.40 and center_lat between 37.765 and 37.78""", "centred", "pairs")

# Joins
O["nearest_building_join"] = sql("select * replace (round(distance_meters, 4) as distance_meters) from nearest", "nearest")
O["topn_building_join"] = sql("""
select business_unique_id, business_lon, business_lat, business_name,
       string_agg(cast(building_osm_id as varchar), ',' order by k) as building_osm_ids, string_agg(building_type, ',' order by k) as building_types,
       string_agg(cast(building_lon as varchar), ',' order by k) as building_lons, string_agg(cast(building_lat as varchar), ',' order by k) as building_lats,
       string_agg(cast(cast(round(distance_meters * 1000) as bigint) as varchar), ',' order by k) as distances_mm, count(*) as match_count
from ranked where k <= 3 and distance_meters <= 200 group by 1, 2, 3, 4""", "ranked")
O["radius_join"] = sql("""
select * exclude (business_start_date, business_end_date) replace (round(distance_degrees, 9) as distance_degrees) from pairs""", "pairs")
O["radius_join_meters"] = sql("""
select building_osm_id as building_id, business_unique_id as business_id, round(distance_meters, 4) as distance_meters
from reach where distance_meters <= 50""", "reach")
O["attach_attributes"] = sql("""
select p.building_id, p.business_id, dba_name, neighborhood, b.business_start_date
from pairs p left join businesses b on b.unique_id = p.business_id""", "pairs")
O["point_in_polygon_join"] = sql("""
select unique_id, osm_id from (
  select unique_id, e.osm_id, sum(case when longitude < (qx - ax) * (latitude - ay) / (qy - ay) + ax then 1 else 0 end) as crossings
  from located b join edges e on (ay > latitude) <> (qy > latitude) and longitude between ox - 0.001 and ox + 0.001
  group by 1, 2) q
where crossings % 2 = 1""", "located", "edges")
_OLD = "select unique_id, dba_name, zipcode from businesses where unique_id % 3 <> 0"
_NEW = "select unique_id, concat('NEW ', dba_name) as dba_name, zipcode from businesses where unique_id % 3 <> 1"
O["upsert_ignore"] = sql(f"{_OLD} union all select * from ({_NEW}) n where unique_id % 3 = 0", "businesses")
O["upsert_update"] = sql(f"{_NEW} union all select * from ({_OLD}) n where unique_id % 3 = 1", "businesses")

# Aggregations
_B_KEYS = "building_id, building_type, building_category, building_center_lon as center_lon, building_center_lat as center_lat"
O["agg_by_building"] = sql(f"""
select *, {B_BANDS} as density_category, least(100, business_count * 10 + business_diversity * 5) as intensity_score, business_diversity >= 3 as mixed_use
from (select {_B_KEYS}, count(*) as business_count, {kinds("naics_code")} as unique_business_types,
             arg_min_null(naics_description, business_id) as primary_business_type, {kinds("naics_description")} as business_diversity,
             min(business_start_date) as earliest_business, max(business_end_date) as latest_business
      from pairs group by 1, 2, 3, 4, 5) q""", "pairs")
_FULL = f"""
select g.*, top_naics_description as primary_business_type, {F_BANDS} as density_category,
       least(100, business_count * 5 + business_diversity * 3) as intensity_score, business_diversity >= 3 as mixed_use
from (select {_B_KEYS}, count(*) as business_count, {kinds("naics_code")} as unique_business_types,
             {kinds("naics_description")} as business_diversity, avg(distance_degrees) as avg_distance,
             min(distance_degrees) as min_distance, max(distance_degrees) as max_distance
      from pairs group by 1, 2, 3, 4, 5) g
left join ({top_value("pairs", "building_id", "naics_description")}) t on t.building_id = g.building_id"""
O["agg_by_building_full"] = sql(f"""
select * replace (round(avg_distance, 9) as avg_distance, round(min_distance, 9) as min_distance, round(max_distance, 9) as max_distance),
       round(1 / (1 + avg_distance * 1000), 9) as proximity_quality from ({_FULL}) f""", "pairs")
O["agg_by_building_slim"] = sql(f"""
select g.*, top_naics_description as primary_business_type, {S_BANDS} as density_category, least(100, business_count * 10) as intensity_score
from (select {_B_KEYS}, count(*) as business_count, {kinds("naics_code")} as unique_business_types from pairs group by 1, 2, 3, 4, 5) g
left join ({top_value("pairs", "building_id", "naics_description")}) t on t.building_id = g.building_id""", "pairs")


def grid_oracle(size: str, ratio: str, band: str) -> str:
    return sql(f"""
select g.grid_x, g.grid_y, total_businesses, building_count, business_type_diversity, center_lon, center_lat,
       top_building_category as dominant_building_type, total_businesses / building_count as {ratio}, {size} as grid_size, {band} as density_category
from (select grid_x, grid_y, count(*) as total_businesses, count(distinct building_id) as building_count, {kinds("naics_code")} as business_type_diversity,
             {mean("building_center_lon")} as center_lon, {mean("building_center_lat")} as center_lat from celled group by 1, 2) g
left join ({top_value("celled", "grid_x, grid_y", "building_category")}) t on t.grid_x = g.grid_x and t.grid_y = g.grid_y""",
        "pairs", celled=f"""
select *, cast(floor(building_center_lon / {size}) as bigint) as grid_x, cast(floor(building_center_lat / {size}) as bigint) as grid_y from pairs""")


O["agg_by_grid"] = grid_oracle("0.002::double", "density_ratio", bands(
    "total_businesses", (100, "very_high"), (50, "high"), (20, "medium"), (5, "low"), rest="minimal"))
O["agg_by_grid_fine"] = grid_oracle("0.001::double", "avg_businesses_per_building", bands(
    "total_businesses", (50, "very_high"), (25, "high"), (10, "medium"), (1, "low"), rest="none"))
_GRID = f"""count(*) as business_count, {kinds("naics_code")} as business_types, {mean("longitude")} as center_lon, {mean("latitude")} as center_lat"""
O["business_grid"] = sql(f"""
select *, 0.002::double as grid_size, {bands("business_count", (20, "very_high"), (10, "high"), (5, "medium"), (1, "low"), rest="none")} as density_category
from (select {rounded("longitude", "0.002::double")} as grid_x, {rounded("latitude", "0.002::double")} as grid_y, {_GRID},
             arg_min_null(naics_description, unique_id) as primary_type, arg_min_null(neighborhood, unique_id) as neighborhood
      from located group by 1, 2) q""", "located")
O["grid_on_demand"] = sql(f"""
select {rounded("longitude", _S12)} as grid_x, {rounded("latitude", _S12)} as grid_y, {_GRID}, arg_min_null(naics_description, unique_id) as primary_type
from located where {_IN_BOX} group by 1, 2""", "located")
_HEX = f"""
select cast(z as integer) as zoom_level, s as hex_size, {_HEX_Q} as hex_q, {_HEX_R} as hex_r, count(*) as business_count,
       {kinds("naics_code")} as business_types, arg_min_null(naics_description, unique_id) as primary_naics,
       {mean("longitude")} as avg_lon, {mean("latitude")} as avg_lat
from located, {_HEX_ZOOMS} zs group by 1, 2, 3, 4"""
O["hex_aggregate"] = sql(f"""
select *, round(hex_q * hex_size * sqrt(3::double), 9) as center_lon, round(hex_r * hex_size * 3 / 2, 9) as center_lat
from ({_HEX}) h where zoom_level = 8""", "located")
O["hex_top"] = f"{O['hex_aggregate']} order by business_count desc, hex_q, hex_r limit 200"
_CLUSTER_ZOOMS = "(select z, 0.001::double * (15 - z) / 10 as s from range(9, 13) t(z))"
_CLUSTER = f"""
select cast(z as integer) as zoom_level, s as grid_size, {rounded("longitude", "s")} as grid_x, {rounded("latitude", "s")} as grid_y,
       count(*) as business_count, {kinds("naics_code")} as business_types, arg_min_null(naics_description, unique_id) as primary_naics,
       {mean("longitude")} as center_lon, {mean("latitude")} as center_lat, stddev_samp(longitude) as lon_std, stddev_samp(latitude) as lat_std,
       max(business_start_date) as newest_business, min(business_start_date) as oldest_business
from located, {_CLUSTER_ZOOMS} zs group by 1, 2, 3, 4"""
O["cluster_aggregate"] = sql(f"""
select c.* replace (round(lon_std, 9) as lon_std, round(lat_std, 9) as lat_std), round(coalesce(lon_std, 0) + coalesce(lat_std, 0), 9) as spatial_variance,
       top_naics_code as dominant_naics
from ({_CLUSTER}) c
left join ({top_value("celled", "cx, cy", "naics_code")}) t on t.cx = grid_x and t.cy = grid_y
where zoom_level = 9""", "located", celled=f"""
select naics_code, {rounded("longitude", "(0.001::double * 6 / 10)")} as cx, {rounded("latitude", "(0.001::double * 6 / 10)")} as cy from located""")
_LEVELS = f"""
select zoom_level, hex_q as cell_x, hex_r as cell_y, business_count, business_types, primary_naics, avg_lon as center_lon, avg_lat as center_lat from ({_HEX}) h
union all select zoom_level, grid_x, grid_y, business_count, business_types, primary_naics, center_lon, center_lat from ({_CLUSTER}) c"""
O["zoom_levels"] = sql(_LEVELS, "located")
O["zoom_pyramid"] = sql(f"""
select zoom_level, case when zoom_level <= 8 then 'hexagonal' else 'statistical' end as aggregation_type, count(*) as features,
       cast(sum(business_count) as bigint) as businesses, round(count(*) * case when zoom_level <= 8 then 0.05::double else 0.5::double end, 4) as size_kb
from ({_LEVELS}) l group by zoom_level""", "located")
def _cube(lon: str, lat: str, size: str, rest: str, source: str) -> str:
    """Axial coordinates hq, hr by rounding three axes."""
    return f"""
select {rest}, cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as hq, cast(case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end as bigint) as hr
from (select *, abs(rq - fq) as dq, abs(rr - fr) as dr, abs(rs - fs) as ds
      from (select *, round_even(fq, 0) as rq, round_even(fr, 0) as rr, round_even(fs, 0) as rs
            from (select *, -fq - fr as fs from (select *, (sqrt(3::double) / 3) * ({lon} / {size}) - ({lat} / {size}) / 3 as fq, ({lat} / {size}) * 2 / 3 as fr from {source}) a) b) c) d"""


O["true_hexagons"] = sql(f"""
select cast(8 as integer) as zoom_level, h.hq as hex_q, h.hr as hex_r, round(x, 9) as center_lon, round(y, 9) as center_lat, h.n as business_count,
       coalesce((select cast(sum(n) as bigint) from hexes o where {{near}}), 0) as neighbour_count, (select count(*) from hexes o where {{near}}) as neighbours, p.hq as parent_q, p.hr as parent_r
from hexes h join parents p on p.cq = h.hq and p.cr = h.hr""".replace("{near}", "o.hq - h.hq between -1 and 1 and o.hr - h.hr between -1 and 1 and o.hq - h.hq + o.hr - h.hr between -1 and 1 and (o.hq <> h.hq or o.hr <> h.hr)"), "located",
    hexes=f"select hq, hr, count(*) as n from ({_cube('longitude', 'latitude', '(0.1::double / 128)', 'unique_id', 'located')}) q group by 1, 2",
    centres="select hq as cq, hr as cr, (0.1::double / 128) * sqrt(3::double) * (hq + hr / 2) as x, (0.1::double / 128) * 3 * hr / 2 as y from hexes",
    parents=_cube("x", "y", "(0.1::double / 64)", "cq, cr, x, y", "centres"))
O["zoom_lookup"] = sql(f"""
select zoom_level, case when zoom_level <= 8 then 'hexagonal' else 'statistical' end as feature_type,
       concat(cast(cell_x as varchar), ':', cast(cell_y as varchar)) as feature_id, center_lon, center_lat, business_count from ({_LEVELS}) l
where zoom_level in (8, 12) and center_lon between -122.42 and -122.40 and center_lat between 37.765 and 37.78
union all select 16, 'building', cast(osm_id as varchar), center_lon, center_lat, business_count from ({_COUNTED}) c
where center_lon between -122.42 and -122.40 and center_lat between 37.765 and 37.78""", "located", "centred", "pairs")
O["business_stats"] = sql(f"""
select count(*) as total_businesses, {kinds("naics_code")} as unique_naics_codes, {kinds("neighborhood")} as unique_neighborhoods,
       {kinds("supervisor_district")} as unique_districts, min(business_start_date) as earliest_start_date, max(business_start_date) as latest_start_date
from businesses""", "businesses")
O["building_stats"] = sql(f"""
select count(*) as total_buildings, {kinds("building_type")} as unique_building_types, {kinds("building_category")} as unique_building_categories,
       count(street_tag) as buildings_with_addresses, round(avg(height), 2) as avg_height_meters, round(avg(levels), 2) as avg_levels,
       count(construction_year) as buildings_with_age_data, round(avg(estimated_age_years), 2) as avg_age_years, count(style_tag) as buildings_with_style_data
from typed""", "typed")
O["category_breakdown"] = sql('select building_category, count(*) as "count" from buildings group by 1', "buildings")
O["match_summary"] = sql(f"""
select count(*) as total_matches, round(avg(distance_meters), 4) as avg_distance_meters, round(min(distance_meters), 4) as min_distance_meters,
       round(max(distance_meters), 4) as max_distance_meters, {kinds("building_type")} as unique_building_types,
       round(median(distance_meters), 4) as median_distance_meters from nearest""", "nearest")
O["match_types_top10"] = sql("""
select coalesce(building_type, 'Unknown') as building_type, count(*) as business_count from nearest group by 1 order by 2 desc, 1 limit 10""", "nearest")
O["density_distribution"] = sql(f"""
select density_category, count(*) as groups, round(avg(business_count), 9) as avg_count, max(business_count) as max_count from ({_FULL}) f group by 1""", "pairs")
O["coverage_stats"] = sql(f"""
select (select count(*) from businesses) as businesses_loaded, (select count(*) from buildings) as buildings_loaded, n as buildings_with_centroids,
       p.*, f.*, round(n / (select count(*) from buildings) * 100, 2) as centroid_success_rate,
       round(buildings_with_businesses / n * 100, 2) as coverage_rate, 55.5::double as proximity_radius_meters
from (select count(*) as n from centred) c,
     (select count(*) as spatial_associations, {kinds("naics_code")} as total_unique_business_types,
             round(avg(distance_degrees) * 111000, 1) as avg_association_distance_meters,
             round(max(distance_degrees) * 111000, 1) as max_association_distance_meters from pairs) p,
     (select count(*) as buildings_with_businesses, round(avg(business_count), 2) as avg_businesses_per_building,
             max(business_count) as max_businesses_per_building, count(*) filter (where mixed_use) as mixed_use_buildings from ({_FULL}) q) f""", "pairs")
O["processing_stats"] = sql(f"""
select b.*, c.*, m.*, round(total_matches / total_records, 6) as match_rate
from (select count(*) as total_records, {kinds("naics_code")} as unique_naics_codes, {kinds("neighborhood")} as unique_neighborhoods,
             min(business_start_date) as earliest_start, max(business_start_date) as latest_start, min(latitude) as min_lat, max(latitude) as max_lat,
             min(longitude) as min_lon, max(longitude) as max_lon from businesses) b,
     (select count(*) as total_buildings, {kinds("building_type")} as building_types from buildings) c,
     (select count(*) as total_matches, round(avg(distance_meters), 6) as avg_distance from nearest) m""", "nearest")
_COLUMNS = (
    "unique_id business_account_number location_id ownership_name dba_name street_address city state zipcode business_start_date"
    " business_end_date naics_code naics_description longitude latitude supervisor_district neighborhood"
).split()
O["column_profile"] = sql(
    "\nunion all\n".join(f"select '{c}' as column_name, count(*) - count({c}) as null_count from businesses" for c in _COLUMNS), "businesses")
O["description_sample"] = sql("select distinct naics_description from businesses where naics_description is not null order by 1 limit 10", "businesses")

# Data quality
_FIELDS = "unique_id ownership_name dba_name street_address longitude latitude naics_code".split()


def completeness(fields: list[str]) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as field, count({c}) as non_null_count, count(*) as total_count, count({c}) / count(*) as completeness_rate from businesses" for c in fields)


_CITY = "latitude between 37.7049 and 37.8089 and longitude between -122.5110 and -122.3816"
_NA = "concat_ws('|', case when street_address is not null then dba_name end, case when dba_name is not null then street_address end)"
O["check_completeness"] = sql(f"select *, completeness_rate >= 0.8 as passes_threshold from ({completeness(_FIELDS)}) q", "businesses")
O["check_coordinates"] = sql(f"""
select count(*) as total_records, count(*) filter (where {_CITY}) as coordinates_in_city, count(*) filter (where {_CITY}) / count(*) as city_coverage_rate,
       count(latitude) / count(*) as latitude_completeness, count(longitude) / count(*) as longitude_completeness,
       count(*) filter (where {_CITY}) / count(*) >= 0.95 as passes_geographic_validation from businesses""", "businesses")
O["check_naics"] = sql(f"""
select count(*) as total_records, count(naics_code) / count(*) as naics_coverage_rate, {kinds("naics_code")} as unique_naics_count,
       count(*) filter (where length(naics_code) between 2 and 6) / count(*) as valid_format_rate, count(naics_code) / count(*) >= 0.8 as passes_naics_validation
from businesses""", "businesses")
O["detect_duplicates"] = sql(f"""
select *, round(1 - unique_accounts / total_records, 12) as account_duplicate_rate, round(1 - unique_name_address / total_records, 12) as name_address_duplicate_rate
from (select count(*) as total_records, {kinds("business_account_number")} as unique_accounts, count(distinct {_NA}) as unique_name_address from businesses) q""", "businesses")
_OUTLIERS = """
select count(*) as total_records, count(*) filter (where latitude < lat_lower or latitude > lat_upper or longitude < lon_lower or longitude > lon_upper) as outlier_count,
       any_value(lat_lower) as lat_lower, any_value(lat_upper) as lat_upper, any_value(lon_lower) as lon_lower, any_value(lon_upper) as lon_upper,
       avg(latitude) as lat_mean, avg(longitude) as lon_mean
from businesses, (
  select q1y - 1.5 * (q3y - q1y) as lat_lower, q3y + 1.5 * (q3y - q1y) as lat_upper, q1x - 1.5 * (q3x - q1x) as lon_lower, q3x + 1.5 * (q3x - q1x) as lon_upper
  from (select quantile_cont(latitude, 0.25) as q1y, quantile_cont(latitude, 0.75) as q3y,
               quantile_cont(longitude, 0.25) as q1x, quantile_cont(longitude, 0.75) as q3x from businesses) a) b"""
O["detect_outliers"] = sql(f"""
select total_records, outlier_count, outlier_count / total_records as outlier_rate, round(lat_lower, 7) as lat_lower, round(lat_upper, 7) as lat_upper,
       round(lon_lower, 7) as lon_lower, round(lon_upper, 7) as lon_upper, round(lat_mean, 7) as lat_mean, round(lon_mean, 7) as lon_mean,
       outlier_count / total_records <= 0.02 as passes_outlier_check from ({_OUTLIERS}) o""", "businesses")
O["check_geometries"] = sql("""
select count(*) as total_buildings, count(geom_wkt) / count(*) as geometry_completeness, count(*) filter (where geom_wkt like 'POLYGON%') / count(*) as valid_polygon_rate,
       count(*) filter (where geom_wkt like 'POLYGON%') / count(*) >= 0.9 as passes_geometry_validation from buildings""", "buildings")
_WORDS = "(street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|way|ct|circle|pl|place)"
O["check_addresses"] = sql(f"""
select count(*) as total_records, count(street_address) / count(*) as address_completeness,
       count(*) filter (where regexp_matches(street_address, '^[0-9]')) / count(*) as valid_format_rate,
       count(*) filter (where regexp_matches(lower(street_address), '{_WORDS}')) / count(*) as street_type_coverage,
       count(*) filter (where regexp_matches(street_address, '^[0-9]')) / count(*) >= 0.85 as passes_format_validation from businesses""", "businesses")
_REPORT = f"""
select completeness, coordinates, naics, outliers, addresses, geometries,
       (completeness + coordinates + naics + outliers + addresses + geometries) / 6 as overall_score
from (select avg(completeness_rate) as completeness from ({completeness(_FIELDS)}) c) c,
     (select count(*) filter (where {_CITY}) / count(*) as coordinates, count(naics_code) / count(*) as naics, count(street_address) / count(*) as addresses from businesses) b,
     (select case when outlier_count / total_records <= 0.02 then 1.0::double else 0.5::double end as outliers from ({_OUTLIERS}) o) o,
     (select count(*) filter (where geom_wkt like 'POLYGON%') / count(*) as geometries from buildings) g"""
_ROUNDED = ", ".join(f"round({c}, 9) as {c}" for c in "completeness coordinates naics outliers addresses geometries overall_score".split())
O["validation_report"] = O["sink_report_json"] = sql(f"select {_ROUNDED}, 6 as total_checks from ({_REPORT}) r", "businesses", "buildings")
_ACCURACY = f"""
select count(*) filter (where {_CITY}) / count(*) as geographic_accuracy, count(*) filter (where length(naics_code) between 2 and 6) / count(*) as naics_format_accuracy,
       count(*) filter (where regexp_matches(street_address, '^[0-9]')) / count(*) as address_format_accuracy from businesses"""
_CONSISTENCY = """
select name_consistency, date_consistency, greatest(0, 1 - (s.lat + s.lon) * 100) as coordinate_consistency
from (select count(*) filter (where lower(dba_name) = lower(ownership_name)) / count(*) as name_consistency,
             count(*) filter (where business_start_date <= business_end_date) / count(*) filter (where business_start_date is not null and business_end_date is not null) as date_consistency
      from businesses) n,
     (select avg(lat) as lat, avg(lon) as lon from (select stddev_samp(latitude) as lat, stddev_samp(longitude) as lon from businesses
                                                    group by zipcode having count(*) >= 5) z) s"""
_VALIDITY = """
select count(*) filter (where business_start_date between timestamp '1850-01-01' and timestamp '1998-01-01') / count(business_start_date) as start_date_validity,
       count(*) filter (where regexp_full_match(naics_code, '[0-9]{2,6}')) / count(naics_code) as naics_validity,
       least(count(*) filter (where round(latitude, 6) = latitude), count(*) filter (where round(longitude, 6) = longitude)) / count(*) as coordinate_precision_validity from businesses"""
_UNIQUENESS = f"""
select {kinds("business_account_number")} as a, count(distinct {_NA}) as n, count(distinct (latitude, longitude)) as p, count(*) as t
from (select *, 1 as one from businesses) q"""
_UNIQUENESS = f"""
select ({kinds("business_account_number")}) / count(*) as account_uniqueness, count(distinct {_NA}) / count(*) as name_address_uniqueness,
       ({kinds("concat(cast(latitude as varchar), ',') || cast(longitude as varchar)")}) / count(*) as coordinate_uniqueness from businesses"""


def scored(text: str, *names: str) -> str:
    return f"select *, ({' + '.join(names)}) / {len(names)} as score from ({text}) q"


_SCORES = {
    "accuracy": scored(_ACCURACY, "geographic_accuracy", "naics_format_accuracy", "address_format_accuracy"),
    "consistency": scored(_CONSISTENCY, "name_consistency", "date_consistency", "coordinate_consistency"),
    "validity": scored(_VALIDITY, "start_date_validity", "naics_validity", "coordinate_precision_validity"),
    "uniqueness": scored(_UNIQUENESS, "account_uniqueness", "name_address_uniqueness", "coordinate_uniqueness"),
}
for _name, _text in _SCORES.items():
    _extra = ", round(coordinate_consistency, 9) as coordinate_consistency" if _name == "consistency" else ""
    O[f"score_{_name}"] = sql(f"select * replace (round(score, 9) as score{_extra}) from ({_text}) s", "businesses")
_SCORE_FIELDS = "unique_id dba_name street_address latitude longitude naics_code".split()
_QUALITY = f"""
select *, completeness * 0.25::double + accuracy * 0.25::double + consistency * 0.2::double + validity * 0.2::double + uniqueness * 0.1::double as overall_score
from (select avg(completeness_rate) as completeness, any_value(total_count) as total_records from ({completeness(_SCORE_FIELDS)}) c) c,
""" + ", ".join(f"(select score as {n} from ({t}) s) {n}_s" for n, t in _SCORES.items())
O["quality_score"] = sql(f"""
select {", ".join(f"round({c}, 9) as {c}" for c in ("completeness", *_SCORES, "overall_score"))}, total_records,
       case when overall_score >= 0.95 then 'excellent' when overall_score >= 0.85 then 'good' when overall_score >= 0.7 then 'fair' else 'poor' end as quality_grade
from ({_QUALITY}) q""", "businesses")
_CHECKS = {
    "accuracy": "geographic_accuracy naics_format_accuracy address_format_accuracy",
    "consistency": "name_consistency date_consistency coordinate_consistency",
    "validity": "start_date_validity naics_validity coordinate_precision_validity",
    "uniqueness": "account_uniqueness name_address_uniqueness coordinate_uniqueness",
}
O["score_checks"] = sql(
    f"select 'completeness' as dimension, field as \"check\", round(completeness_rate, 9) as score from ({completeness(_SCORE_FIELDS)}) c\nunion all\n"
    + "\nunion all\n".join(
        f"select '{d}', '{c}', round({c}, 9) from ({_SCORES[d]}) s" for d, names in _CHECKS.items() for c in names.split()),
    "businesses")
O["quality_alerts"] = sql(f"""
select type, severity, round(current_value, 9) as current_value, threshold from (
  select 'overall_quality' as type, 'high' as severity, overall_score as current_value, 0.7::double as threshold from ({_QUALITY}) q
  union all select 'completeness', 'medium', completeness, 0.8::double from ({_QUALITY}) q
  union all select 'accuracy', 'medium', accuracy, 0.85::double from ({_QUALITY}) q
  union all select 'validity', 'medium', validity, 0.8::double from ({_QUALITY}) q) a
where current_value < threshold""", "businesses")

# Trends over time
_TREND = """
select dataset, latest_score, previous_score, analysis_period, latest_score - previous_score as score_change,
       case when latest_score - previous_score > 0.01 then 'improving' when latest_score - previous_score < -0.01 then 'declining' else 'stable' end as trend_direction
from (select dataset, score as latest_score, lead(score) over w as previous_score, count(*) over (partition by dataset) as analysis_period, row_number() over w as k
      from history window w as (partition by dataset order by ts desc, event_id desc)) q where k = 1 and analysis_period >= 2"""
O["quality_trend"] = sql(f"""
select * replace (round(latest_score, 9) as latest_score, round(previous_score, 9) as previous_score, round(score_change, 9) as score_change) from ({_TREND}) t""", "history")
O["dimension_trend"] = sql("""
select dataset, ts, event_id, round(score, 9) as current, round(previous, 9) as previous, round(score - previous, 9) as change,
       case when score - previous > 0 then 'improving' else 'declining' end as trend
from (select *, lag(score) over (partition by dataset order by ts, event_id) as previous
      from (select *, row_number() over (partition by dataset order by ts desc, event_id desc) as k from history) a where k <= 10) b
where previous is not null""", "history")

# Sort, limit, sample, set operators
_HEAT = """
select cast(floor(longitude / 0.001::double) as bigint) as grid_x, cast(floor(latitude / 0.001::double) as bigint) as grid_y, count(*) as business_count
from located group by 1, 2"""
O["top_k_cells"] = sql(f"{_HEAT} order by business_count desc, grid_x, grid_y limit 200", "located")
O["sample_points"] = sql("""
select unique_id, longitude, latitude, (select count(*) from located) as total_available from located
order by md5(concat(cast(unique_id as varchar), ':42')), unique_id limit 1000""", "located")
O["map_points"] = sql(f"""
select unique_id, longitude as lon, cast(case when age <= 5 then 4 when age <= 10 then 3 else 2 end as double) as size
from (select *, coalesce(2024 - year(business_start_date), 5) as age from located) q where {_IN_BOX}
order by md5(concat(cast(unique_id as varchar), ':42')), unique_id limit 500""", "located")
O["union_batches"] = sql("select unique_id, neighborhood from businesses where neighborhood is not null", "businesses")
O["distinct_pairs"] = sql("select business_id, building_id from pairs", "pairs")
# Change detection, freshness, refresh
O["detect_changes"] = sql("""
select dataset_id, cast(version as varchar) as version, row_count_change, last_updated_changed, added, removed,
       row_count_change > 10 or added <> '' or removed <> '' as keep_version
from (select dataset_id, version, total_rows - lag(total_rows) over w as row_count_change, last_updated <> lag(last_updated) over w as last_updated_changed,
             case when extra <> lag(extra) over w then extra else '' end as added, case when extra <> lag(extra) over w then lag(extra) over w else '' end as removed,
             row_number() over w as k
      from (select event_type as dataset_id, cast(ts as date) as version, count(*) as total_rows, max(ts) as last_updated,
                   case when day(cast(any_value(ts) as date)) % 2 <> 0 and day(cast(any_value(ts) as date)) % 3 = 0 then 'email' else 'name' end as extra
            from events group by 1, 2) v
      window w as (partition by dataset_id order by version)) q where k > 1""")
O["schema_diff"] = f"""
with d as ({O["detect_changes"]})
select dataset_id, version, added as column_name, 'added' as change from d where added <> ''
union all select dataset_id, version, removed, 'removed' from d where removed <> ''"""
O["run_status"] = sql("""
select strftime(ts, '%Y%m%d') as run_id, count(*) as steps, count(*) filter (where status in ('success', 'skipped')) as good_steps,
       count(*) filter (where status = 'error') as failed_steps, min(ts) as started, max(ts) as ended,
       case when count(*) filter (where status in ('success', 'skipped')) = count(*) then 'success'
            when count(*) filter (where status in ('success', 'skipped')) = 0 then 'failure' else 'partial_failure' end as overall_status
from refreshes group by 1""", "refreshes")
_LIMITS = "(values ('business_data', 168::double), ('building_data', 720::double), ('spatial_joins', 168::double), ('quality_reports', 24::double)) l(dataset, threshold_hours)"
_FRESH = f"""
select l.dataset, threshold_hours, last_updated, coalesce(cached_rows, 0) as cached_rows,
       epoch_us(timestamp '2024-02-20') / 3600000000 - epoch_us(last_updated) / 3600000000 as age_hours_raw,
       (epoch_us(timestamp '2024-02-20') - epoch_us(last_updated)) / 3600000000 as age_hours, last_updated is not null as table_exists
from {_LIMITS} left join (select dataset, max(ts) as last_updated, count(*) as cached_rows from loads group by 1) e on e.dataset = l.dataset"""
O["freshness_check"] = sql(f"""
select dataset, threshold_hours, last_updated, cached_rows, round(age_hours, 6) as age_hours, coalesce(age_hours <= threshold_hours, false) as is_fresh, table_exists
from ({_FRESH}) f""", "loads")
O["needs_refresh"] = sql("""
select l.event_type, threshold_hours, last_success, round((epoch_us(timestamp '2024-02-01') - epoch_us(last_success)) / 3600000000, 6) as age_hours,
       coalesce((epoch_us(timestamp '2024-02-01') - epoch_us(last_success)) / 3600000000 > threshold_hours, true) as needs_refresh
from (values ('business_refresh', 24::double), ('buildings_refresh', 168::double), ('never_run', 24::double)) l(event_type, threshold_hours)
left join (select event_type, max(ts) as last_success from refreshes where status = 'success' group by 1) s on s.event_type = l.event_type""", "refreshes")
O["refresh_summary"] = sql("""
select t.*, (select count(*) from refreshes r where r.event_type = t.event_type and status = 'error' and (last_success is null or r.ts > last_success)) as consecutive_failures,
       (success_count + skipped_count) / total_events as success_ratio,
       case when success_count + skipped_count = total_events then 'success' else 'partial_failure' end as overall_status
from (select event_type, count(*) as total_events, count(*) filter (where status = 'success') as success_count, count(*) filter (where status = 'skipped') as skipped_count,
             count(*) filter (where status = 'error') as error_count, max(case when status = 'success' then ts end) as last_success from refreshes group by 1) t""", "refreshes")
O["monitor_alerts"] = sql(f"""
select 'data_freshness' as alert_type, 'warning' as severity, dataset as subject, round(age_hours, 6) as value
from ({_FRESH}) f where table_exists and age_hours > threshold_hours
union all select 'missing_table', 'high', dataset, cast(null as double) from ({_FRESH}) f where not table_exists
union all select 'quality_degradation', case when latest_score < 0.7 then 'high' else 'medium' end, dataset, round(latest_score, 6)
from ({_TREND}) t where latest_score < 0.7 or (latest_score < 0.85 and latest_score <= previous_score)""", "loads", "history")
O["content_fingerprint"] = sql("""
select count(*) as row_count, cast(sum(cast('0x' || substr(md5(concat_ws(chr(31), cast(unique_id as varchar), coalesce(dba_name, chr(0)), coalesce(naics_code, chr(0)),
       coalesce(cast(longitude as varchar), chr(0)), coalesce(cast(latitude as varchar), chr(0)))), 1, 15) as hugeint)) as varchar) as fingerprint from businesses""", "businesses")
O["content_fingerprint_fast"] = sql("""
select count(*) as row_count, true as order_ignored, count(naics_code) > 0 as move_seen from businesses""", "businesses")
_V_COLUMNS = "unique_id, dba_name, naics_code, longitude"
O["version_changes"] = sql(f"""
select coalesce(n.unique_id, o.unique_id) as unique_id, case when o.unique_id is null then 'added' when n.unique_id is null then 'removed' else 'changed' end as change
from (select * from older except select * from newer) o full join (select * from newer except select * from older) n on n.unique_id = o.unique_id""", "businesses",
    older=f"select {_V_COLUMNS} from businesses where unique_id % 211 <> 0",
    newer=f"select unique_id, case when unique_id % 101 = 0 then concat('NEW ', dba_name) else dba_name end as dba_name, naics_code, longitude from businesses where unique_id % 307 <> 0")
O["incremental_ingest"] = sql("""
select cast(unique_id as varchar) as unique_id, case when unique_id % 3 = 0 then concat('NEW ', dba_name) else dba_name end as dba_name, raw_zip as zipcode,
       raw_lon as longitude, raw_lat as latitude,
       case when unique_id % 3 = 0 then '2030-01-01' else strftime(business_start_date, '%Y-%m-%d') end as data_as_of
from raw where raw_lon between -122.6 and -122.3 and raw_lat between 37.7 and 37.9 and unique_id % 15 <> 0""", "raw")

_KEYED = """
select cast(unique_id as varchar) as unique_id, case when unique_id % 70 = 0 then dba_name when unique_id % 3 = 0 then concat('NEW ', dba_name) else dba_name end as dba_name, raw_zip as zipcode,
       case when unique_id % 70 = 0 then -122.42 when unique_id % 15 = 0 then -100.5 else raw_lon end as longitude,
       case when unique_id % 70 = 0 then 37.77 when unique_id % 15 = 0 then 40.5 else raw_lat end as latitude,
       case when unique_id % 70 = 0 then '2031-01-01' when unique_id % 3 = 0 then '2030-01-01' else strftime(business_start_date, '%Y-%m-%d') end as data_as_of,
       naics_code, naics_description, raw_start as business_start_date
from raw"""
O["keyed_ingest"] = sql(f"select unique_id, dba_name, zipcode, longitude, latitude, data_as_of from ({_KEYED}) k", "raw")
O["ingest_changes"] = sql("""
select 0 as batch, 1 as sign, count(*) as row_count, cast(sum(unique_id) as bigint) as id_sum from raw
union all select 1, s, count(*), cast(sum(unique_id) as bigint) from raw, (values (-1), (1)) v(s) where unique_id % 3 = 0 group by s
union all select 2, s, count(*), cast(sum(unique_id) as bigint) from raw, (values (-1), (1)) v(s) where unique_id % 70 = 0 group by s""", "raw")
O["live_pyramid"] = sql(f"""
select zoom_level, cell_x, cell_y, business_count, business_types, primary_naics, center_lon, center_lat,
       dominant_naics, spatial_variance, oldest_business, newest_business
from (select zoom_level, hex_q as cell_x, hex_r as cell_y, business_count, business_types, primary_naics, avg_lon as center_lon, avg_lat as center_lat,
             cast(null as varchar) as dominant_naics, cast(null as double) as spatial_variance, cast(null as timestamp) as oldest_business, cast(null as timestamp) as newest_business
      from ({_HEX}) h
      union all select zoom_level, grid_x, grid_y, business_count, business_types, primary_naics, center_lon, center_lat,
             top_naics_code, round(coalesce(lon_std, 0) + coalesce(lat_std, 0), 9), oldest_business, newest_business
      from ({_CLUSTER}) c left join ({top_value("celled", "z, cx, cy", "naics_code")}) t on t.z = zoom_level and t.cx = grid_x and t.cy = grid_y) l""", "raw",
    located=f"select * from ({_KEYED}) k where longitude between -122.6 and -122.3 and latitude between 37.7 and 37.9",
    celled=f"select cast(z as integer) as z, naics_code, {rounded('longitude', 's')} as cx, {rounded('latitude', 's')} as cy from located, {_CLUSTER_ZOOMS} zs")

O["incremental_footprints"] = sql("""
select t.osm_id, case when t.osm_id % 3 = 0 then 'house' else building_type end as building_type,
       case when t.osm_id % 3 = 0 then 'residential' else building_category end as building_category,
       case when t.osm_id % 3 = 0 then 2 else 1 end as version, ring.wkt as geom_wkt
from typed t join (select osm_id, concat('POLYGON ((', string_agg(concat(cast(x as varchar), ' ', cast(y as varchar)), ', ' order by i), '))') as wkt
                   from vertices group by osm_id) ring on ring.osm_id = t.osm_id
where t.osm_id % 29 <> 0 and element_type = 'way'""", "typed", "vertices")

# SQL functions
O["sql_functions"] = sql(f"""
select unique_id, naics_code, round({metres("latitude", "longitude", "37.7749::double", "(-122.4194)::double")}, 4) as meters,
       longitude <= -122.41 as in_west_half from businesses where {_IN_BOX} and neighborhood = 'BUILDING'""", "businesses")

# Declared analytics
O["multi_filter"] = sql("""
select unique_id, naics_code, neighborhood, business_start_date from businesses
where naics_code in ('7207', '7214', '7221', '7220-7229') and neighborhood in ('BUILDING', 'MACHINERY')
  and business_start_date between date '1992-01-01' and date '1997-12-31' and longitude between -122.43 and -122.39 and latitude between 37.76 and 37.79
  and business_account_number in (select business_account_number from businesses group by 1 having count(*) >= 5)""", "businesses")
O["openings_closings_trend"] = sql("""
select *, openings - closings as net,
       cast(sum(openings - closings) over (partition by neighborhood order by period rows unbounded preceding) as bigint) as active_total
from (select neighborhood, period, cast(sum(o) as bigint) as openings, cast(sum(c) as bigint) as closings from (
        select neighborhood, cast(date_trunc('quarter', business_start_date) as timestamp) as period, 1 as o, 0 as c from businesses where business_start_date is not null
        union all select neighborhood, cast(date_trunc('quarter', business_end_date) as timestamp), 0, 1 from businesses where business_end_date is not null) e
      group by 1, 2) q""", "businesses")
O["heatmap"] = sql(f"select *, business_count / max(business_count) over () as intensity from ({_HEAT}) h", "located")
O["co_location"] = sql("""
select g.kind_1, g.kind_2, pair_count,
       round(pair_count / ((a.n / t.n) * (b.n / t.n) * case when g.kind_1 = g.kind_2 then 1 else 2 end * sum(pair_count) over ()), 9) as lift
from (select least(a.naics_code, b.naics_code) as kind_1, greatest(a.naics_code, b.naics_code) as kind_2, count(*) as pair_count
      from coded a join coded b on a.unique_id < b.unique_id and b.longitude between a.longitude - 0.0004 and a.longitude + 0.0004
       and (a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude) <= cast(0.0003 as double) * cast(0.0003 as double)
      group by 1, 2) g
join sizes a on a.naics_code = g.kind_1 join sizes b on b.naics_code = g.kind_2, (select count(*) as n from coded) t""", "located",
    coded="select unique_id, longitude, latitude, naics_code from located where naics_code is not null",
    sizes="select naics_code, count(*) as n from coded group by 1")
O["dbscan_districts"] = sql("""
select p.unique_id, coalesce(l.label, near.label) as cluster_id, l.label is not null as is_core
from points p left join labels l on l.id = p.unique_id
left join (select n.a, min(l.label) as label from reach n join labels l on l.id = n.b group by 1) near on near.a = p.unique_id""", "located",
    points="select unique_id, cast(round(longitude * 10000000) as bigint) as x, cast(round(latitude * 10000000) as bigint) as y from located",
    reach="""
select p.unique_id as a, q.unique_id as b from points p join points q
  on q.x between p.x - 3000 and p.x + 3000 and (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 9000000""",
    core="select a as id from reach group by a having count(*) >= 5",
    links="select a, b from reach where a in (select id from core) and b in (select id from core) and a <> b",
    recursive={"labels(id, label) using key (id)": """
select id, id from core
union
(select e.b, min(c.label) from labels c join links e on e.a = c.id join recurring.labels u on u.id = e.b where c.label < u.label group by e.b)"""})
O["survival_rates"] = sql("""
select cohort, years, at_risk, surviving, surviving / at_risk as survival_rate
from (select cast(year(business_start_date) as integer) as cohort, k as years,
             count(*) filter (where business_start_date + to_years(k) <= timestamp '1999-01-01') as at_risk,
             count(*) filter (where business_start_date + to_years(k) <= timestamp '1999-01-01'
                      and (business_end_date is null or business_end_date >= business_start_date + to_years(k))) as surviving
      from businesses, (values (1), (2), (3), (5)) v(k) group by 1, 2) q where at_risk > 0""", "businesses")
_NOW = "timestamp '1996-01-01'"
O["survival_curve"] = sql(f"""
select cohort, kind, age_days, at_risk, closings, round(case when left_over = 0 then 0 else survival end, 9) as survival,
       case when left_over > 0 then round(survival * sqrt(spread), 9) end as std_error
from (select *, min(at_risk - closings) over w as left_over, product(1 - closings / at_risk) over w as survival,
             sum(case when at_risk > closings then closings / (at_risk * (at_risk - closings)) else 0 end) over w as spread
      from (select d.cohort, d.kind, d.age_days, count(*) as at_risk, count(*) filter (a.closed and a.age_days = d.age_days) as closings
            from (select distinct cohort, kind, age_days from ages where closed) d
            join ages a on a.cohort = d.cohort and a.kind is not distinct from d.kind and a.age_days >= d.age_days group by 1, 2, 3) q
      window w as (partition by cohort, kind order by age_days)) c""", "businesses",
    ended="select *, case when unique_id % 3 = 0 then business_end_date - to_days(cast(unique_id % 300 as integer)) else business_end_date end as until from businesses",
    ages=f"""
select cast(year(business_start_date) as integer) as cohort, naics_description as kind, until is not null and until <= {_NOW} as closed,
       date_diff('day', business_start_date, case when until <= {_NOW} then until else {_NOW} end) as age_days
from ended where business_start_date <= {_NOW}""")
O["distributions"] = sql("""
select neighborhood, naics_description, count(*) as business_count, count(*) / sum(count(*)) over (partition by neighborhood) as area_share
from businesses group by 1, 2""", "businesses")
O["export_bundle"] = sql("""
select 'businesses' as name, count(*) as record_count, 4 as column_count, 'unique_id,dba_name,longitude,latitude' as columns,
       'csv,json,geojson,parquet' as formats from businesses""", "businesses")
O["kmeans_districts"] = sql("select count(*) as rows_assigned, cast(8 as bigint) as districts, cast(0 as bigint) as rows_elsewhere from located", "located")
