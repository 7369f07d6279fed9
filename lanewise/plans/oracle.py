"""The same reports as SQL, run by another engine to check the Spark results.

Each query is a plain SELECT over the views below; :func:`oracle_sql` puts the
views a query needs in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

VIEWS["fx_shipments_raw"] = """
SELECT
  CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN NULL WHEN l_suppkey % 7 = 3 THEN 'FR 20'
       ELSE substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', s_nationkey*2+1, 2)
            || ' ' || lpad(cast(s_suppkey % 100 AS string), 2, '0') END AS zc_from,
  CASE WHEN (l_orderkey + l_partkey) % 89 = 0 THEN NULL WHEN o_custkey % 11 = 5 THEN 'DE 01'
       ELSE substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', c_nationkey*2+1, 2)
            || ' ' || lpad(cast(c_custkey % 100 AS string), 2, '0') END AS zc_to,
  CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE cast(l_shipdate AS date) END AS ship_date,
  CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN NULL
       WHEN l_partkey % 13 = 0 THEN cast(0 AS decimal(18,3))
       ELSE cast(cast(l_quantity AS int)*l_linenumber*l_linenumber*l_linenumber AS decimal(18,3)) END AS kg,
  CASE WHEN l_partkey % 13 = 0 AND l_suppkey % 2 = 0 THEN cast(0 AS decimal(18,3))
       WHEN l_linenumber >= 5 THEN cast((l_partkey % 155)*0.1 AS decimal(18,3))
       ELSE cast((l_partkey % 12)*0.1 AS decimal(18,3)) END AS ldm,
  CASE WHEN l_partkey % 13 = 0 THEN cast(0 AS decimal(18,3))
       ELSE cast((l_orderkey % 40)*0.05 AS decimal(18,3)) END AS m3,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS branch,
  l_returnflag AS category1, l_linestatus AS category2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
"""

VIEWS["fx_zone_region"] = """
WITH d AS (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS t(d)),
z AS (SELECT substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', n_nationkey*2+1, 2) AS code,
             a.d*10 + b.d AS z FROM nation CROSS JOIN d a CROSS JOIN d b),
n AS (SELECT CASE WHEN code = 'GB' THEN 'UK' ELSE code END AS code, z,
             code IN ('AD','ME','RU','XK','UA','BY','BA') AS collapsed FROM z)
SELECT CASE WHEN collapsed THEN code ELSE code || ' ' || lpad(cast(z AS string), 2, '0') END AS zone,
       code AS nuts0,
       code || cast(z % 2 AS string) AS nuts1,
       code || cast(z % 2 AS string) || cast(d % 2 AS string) AS nuts2,
       code || cast(z % 2 AS string) || cast(d % 2 AS string) || CASE WHEN d >= 2 THEN '1' ELSE '0' END AS nuts3,
       d AS seq
FROM n CROSS JOIN d
WHERE z % 10 <> 9 AND (NOT collapsed OR z = 0)
  AND d < CASE z % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END
"""

VIEWS["fx_region_attrs"] = """
SELECT DISTINCT lvl, region_id, 'Region ' || region_id AS name,
       cast(40 + length(region_id) AS double) AS lat,
       cast(ascii(region_id) - 60 AS double) AS lon
FROM (SELECT 0 AS lvl, nuts0 AS region_id FROM fx_zone_region
      UNION ALL SELECT 1, nuts1 FROM fx_zone_region
      UNION ALL SELECT 2, nuts2 FROM fx_zone_region
      UNION ALL SELECT 3, nuts3 FROM fx_zone_region) u
WHERE substr(region_id, 1, 2) <> 'PL'
"""

VIEWS["fx_branches"] = """
SELECT substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', s_nationkey*2+1, 2) AS country,
       cast(40 + s_suppkey % 20 AS double) AS lat, cast(s_suppkey % 30 - 5 AS double) AS lon,
       s_name AS office_name,
       substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', s_nationkey*2+1, 2)
         || ' ' || lpad(cast(s_suppkey % 100 AS string), 2, '0') AS zone,
       '+00 ' || lpad(cast(s_suppkey AS string), 6, '0') AS phone, '08:00-18:00' AS opening_hours
FROM supplier
"""

VIEWS["fx_country_names"] = """
SELECT n_nationkey AS ord, iso2, country_1, lower(iso2) AS country_2,
       CASE WHEN n_nationkey % 2 = 0 THEN 'republic of ' || country_1 END AS country_3,
       cast(NULL AS string) AS country_4
FROM nation JOIN (VALUES (0,'FR','france'),(1,'DE','germany'),(2,'ES','spain'),(3,'IT','italy'),(4,'PL','poland'),
  (5,'GB','united kingdom'),(6,'BE','belgium'),(7,'NL','netherlands'),(8,'SE','sweden'),(9,'NO','norway'),
  (10,'DK','denmark'),(11,'FI','finland'),(12,'AT','austria'),(13,'CZ','czech republic'),(14,'PT','portugal'),
  (15,'IE','ireland'),(16,'HU','hungary'),(17,'RO','romania'),(18,'UA','ukraine'),(19,'RU','russia'),
  (20,'BA','bosnia'),(21,'ME','montenegro'),(22,'BY','belarus'),(23,'AD','andorra'),(24,'XK','kosovo')) AS c(k, iso2, country_1)
  ON n_nationkey = k
"""

VIEWS["fx_postal_ref"] = """
SELECT iso2 AS country, iso2 || ' ' || cast(a.d AS string) || cast(b.d AS string) || '000' AS full_zc,
       iso2 || ' ' || cast(a.d AS string) || cast(b.d AS string) AS zc, a.d*10 + b.d AS ord
FROM fx_country_names
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS a(d)
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS b(d)
WHERE iso2 <> 'XK'
"""

VIEWS["fx_bid_raw"] = """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE
    CASE c_custkey % 5 WHEN 0 THEN o.country_1 WHEN 1 THEN upper(o.country_1)
      WHEN 2 THEN substr(o.country_1, 1, 2) || substr(o.country_1, 4) WHEN 3 THEN o.iso2 ELSE o.country_1 || '  ' END END AS "Collection country",
  CASE WHEN c_custkey % 50 = 0 OR c_custkey % 8 = 3 THEN NULL ELSE
    CASE c_custkey % 4 WHEN 1 THEN lpad(cast((c_custkey*37) % 100000 AS string), 5, '0') || '.0'
      WHEN 2 THEN 'F-' || lpad(cast((c_custkey*37) % 100000 AS string), 5, '0')
      ELSE lpad(cast((c_custkey*37) % 100000 AS string), 5, '0') END END AS "Collection zipcode",
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE
    CASE c_custkey % 3 WHEN 0 THEN t.country_1 WHEN 1 THEN upper(t.country_1)
      ELSE substr(t.country_1, 1, 2) || substr(t.country_1, 4) END END AS "Delivery country",
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE lpad(cast((c_custkey*53) % 100000 AS string), 5, '0') END AS "Delivery zipcode",
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_mktsegment END AS "Goods"
FROM customer JOIN fx_country_names o ON c_nationkey = o.ord
JOIN fx_country_names t ON (c_nationkey*7 + 3) % 25 = t.ord
"""

VIEWS["fx_answers"] = """
SELECT p_partkey AS answer_id,
  'Summary of ' || p_name || chr(10) || chr(10) || '- Customer name: ' || p_brand || chr(10)
  || '- Sector: ' || p_type || ': size ' || cast(p_size AS string) || chr(10) || '- no colon here' || chr(10)
  || array_to_string(list_transform(range(1, 25 + p_size), lambda i: '- Item ' || cast(i AS varchar) || ': ' || p_brand
       || ': no. ' || cast(i * p_size AS varchar)), chr(10)) || chr(10) || '- Go/NoGo: ' || CASE WHEN p_size % 2 = 0 THEN 'Go: none' ELSE 'NoGo: penalties' END AS text
FROM part
"""

VIEWS["fx_outlines"] = """
SELECT 'R' || lpad(cast(c_custkey AS varchar), 9, '0') AS region_id, part, ring, seq,
       cast(c_custkey % 360 - 180 AS double) + dx AS lon, cast(c_custkey % 140 - 70 AS double) + dy AS lat
FROM customer CROSS JOIN (VALUES
  (0, 0, 0, 0.0e0, 0.0e0), (0, 0, 1, 2.0e0, 0.0e0), (0, 0, 2, 2.0e0, 2.0e0), (0, 0, 3, 0.0e0, 2.0e0), (0, 0, 4, 0.0e0, 0.0e0),
  (0, 1, 0, 0.5e0, 0.5e0), (0, 1, 1, 1.0e0, 0.5e0), (0, 1, 2, 1.0e0, 1.0e0), (0, 1, 3, 0.5e0, 1.0e0), (0, 1, 4, 0.5e0, 0.5e0),
  (1, 0, 0, 5.0e0, 5.0e0), (1, 0, 1, 6.0e0, 5.0e0), (1, 0, 2, 6.0e0, 6.0e0), (1, 0, 3, 5.0e0, 6.0e0), (1, 0, 4, 5.0e0, 5.0e0)) AS c(part, ring, seq, dx, dy)
WHERE NOT (part = 0 AND ring = 0 AND seq = 3 AND c_custkey % 3 = 0)
  AND (ring = 0 OR c_custkey % 3 = 2) AND (part = 0 OR c_custkey % 4 = 1)
"""

VIEWS["fx_catchments"] = """
SELECT substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', c_nationkey*2+1, 2)
         || ' ' || lpad(cast(c_custkey AS varchar), 9, '0') AS zone,
       'R' || lpad(cast(greatest(c_custkey - back, 0) AS varchar), 9, '0') AS nuts3,
       cast(c_custkey % 3 - back AS int) AS seq
FROM customer JOIN (VALUES (0), (1), (2)) AS b(back) ON back <= c_custkey % 3
"""

VIEWS["fx_name_table"] = """
SELECT c_custkey AS ord, iso2, country_1, lower(c_name) AS country_2,
       CASE WHEN c_custkey % 2 = 0 THEN 'republic of ' || country_1 END AS country_3, cast(NULL AS varchar) AS country_4
FROM customer JOIN fx_country_names n ON c_nationkey = n.ord
"""

VIEWS["usable"] = """
SELECT *, zc_from IS NOT NULL AND zc_to IS NOT NULL
          AND (coalesce(kg, 0) <> 0 OR coalesce(ldm, 0) <> 0 OR coalesce(m3, 0) <> 0) AS ok
FROM fx_shipments_raw
"""

VIEWS["clean"] = """
SELECT CASE WHEN substr(zc_from, 1, 2) IN ('AD','ME','RU','XK','UA','BY','BA') THEN substr(zc_from, 1, 2)
            WHEN substr(zc_from, 1, 2) = 'GB' THEN 'UK' || substr(zc_from, 3) ELSE zc_from END AS zc_from,
       CASE WHEN substr(zc_to, 1, 2) IN ('AD','ME','RU','XK','UA','BY','BA') THEN substr(zc_to, 1, 2)
            WHEN substr(zc_to, 1, 2) = 'GB' THEN 'UK' || substr(zc_to, 3) ELSE zc_to END AS zc_to,
       ship_date, coalesce(kg, 0) AS kg, coalesce(ldm, 0) AS ldm, coalesce(m3, 0) AS m3,
       coalesce(branch, 'undefined') AS branch, category1, category2
FROM usable WHERE ok
"""


def _enriched(source: str, home: str = "FR") -> str:
    return f"""
SELECT *,
  CASE WHEN pay_weight > 0 AND pay_weight <= 30 THEN 30 WHEN pay_weight > 30 AND pay_weight <= 100 THEN 100
       WHEN pay_weight <= 250 THEN 250 WHEN pay_weight <= 500 THEN 500 WHEN pay_weight <= 1000 THEN 1000
       WHEN pay_weight <= 2500 THEN 2500 WHEN pay_weight <= 5000 THEN 5000 WHEN pay_weight <= 7500 THEN 7500
       WHEN pay_weight <= 10000 THEN 10000 WHEN pay_weight <= 15000 THEN 15000
       WHEN pay_weight <= 20000 THEN 20000 ELSE 25500 END AS bracket,
  CASE WHEN pay_weight <= 30 THEN 'Parcel' WHEN pay_weight <= 2500 THEN 'GRP'
       WHEN pay_weight <= 20000 THEN 'LTL' ELSE 'FTL' END AS product
FROM (SELECT *, substr(zc_from, 1, 2) AS cntry_from, substr(zc_to, 1, 2) AS cntry_to,
        CASE WHEN substr(zc_from, 1, 2) = '{home}' AND substr(zc_to, 1, 2) <> '{home}' THEN 'Exp'
             WHEN substr(zc_to, 1, 2) = '{home}' AND substr(zc_from, 1, 2) <> '{home}' THEN 'Imp'
             WHEN substr(zc_from, 1, 2) = '{home}' AND substr(zc_to, 1, 2) = '{home}' THEN 'Dom'
             ELSE 'X-trade' END AS way,
        CASE WHEN kg IS NOT NULL THEN greatest(kg, ldm * 1750, m3 * 330) END AS pay_weight
      FROM {source}) p
"""


VIEWS["ship"] = _enriched("clean")
VIEWS["ship_uk"] = _enriched("clean", "UK")
VIEWS["with_factor"] = """
SELECT * REPLACE (greatest(cast(ldm AS double), cast(kg AS double) / 1750) AS ldm),
       greatest(cast(ldm AS double), cast(kg AS double) / 1750) AS ldm_eq
FROM clean
"""
VIEWS["ship_factor"] = _enriched("with_factor")
VIEWS["summ"] = """
SELECT * REPLACE (cast(trunc(pay_weight) AS bigint) AS pay_weight) FROM ship WHERE pay_weight IS NOT NULL
"""

BRACKETS = (30, 100, 250, 500, 1000, 2500, 5000, 7500, 10000, 15000, 20000, 25500)
B = [f"b{b}" for b in BRACKETS]
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def pct(part: str, whole: str, decimals: int = 2) -> str:
    """Percentage rounded half up, on whole numbers."""
    unit = 10**decimals
    return f"cast((({200 * unit} * ({part}) + ({whole})) // (2 * ({whole}))) AS double) / {unit}.0e0"


def d(expr: str) -> str:
    return f"cast(coalesce({expr}, 0) AS double)"


# ---------------------------------------------------------------- sources

QUERIES["shipments_source"] = """
SELECT zc_from, zc_to, ship_date, cast(kg AS double) AS kg, cast(ldm AS double) AS ldm, cast(m3 AS double) AS m3,
       branch, category1, category2 FROM fx_shipments_raw
"""
QUERIES["shipments_source_plain"] = """
SELECT zc_from, zc_to, cast(NULL AS date) AS ship_date, cast(kg AS double) AS kg, cast(ldm AS double) AS ldm,
       cast(m3 AS double) AS m3, branch FROM fx_shipments_raw
"""
QUERIES["region_vertices"] = """
SELECT region_id, part, ring, cast(row_number() OVER (PARTITION BY region_id, part, ring ORDER BY seq) - 1 AS int) AS seq,
       lon, lat
FROM fx_outlines
"""
QUERIES["branch_points"] = "SELECT office_name, zone, phone, opening_hours, lat, lon FROM fx_branches"
QUERIES["branch_countries"] = "SELECT DISTINCT country FROM fx_branches"
QUERIES["bid_source"] = 'SELECT * FROM fx_bid_raw'
QUERIES["bid_head_csv"] = """
SELECT 'Collection country,Collection zipcode,Delivery country,Delivery zipcode,Goods' AS line
UNION ALL
SELECT concat_ws(',', "Collection country", "Collection zipcode", "Delivery country", "Delivery zipcode", "Goods")
FROM (SELECT * FROM bid_cells ORDER BY row_id LIMIT 5) h
"""
_REJECTED = """
SELECT zc_from, zc_to, ship_date, cast(kg AS double) AS kg, cast(ldm AS double) AS ldm, cast(m3 AS double) AS m3,
       branch, category1, category2 FROM usable WHERE NOT ok
"""
QUERIES["export_table"] = _REJECTED
QUERIES["read_bridge"] = """
SELECT zone, arg_min(nuts3, seq) AS first_nuts3, count(nuts0) AS rows FROM fx_zone_region GROUP BY zone
"""
QUERIES["read_offices"] = "SELECT country, lat, lon, office_name, zone, phone, opening_hours FROM fx_branches"
QUERIES["read_postal"] = """
SELECT country, full_zc, full_zc AS zc, cast(row_number() OVER (PARTITION BY country ORDER BY ord) AS int) AS place
FROM fx_customer_zones
"""
QUERIES["read_regions"] = "SELECT lvl, region_id, name, lat, lon FROM fx_region_attrs WHERE lvl = 0"

# ---------------------------------------------------------------- cleaning and enrichment

QUERIES["clean_shipments"] = """
SELECT zc_from, zc_to, ship_date, cast(kg AS double) AS kg, cast(ldm AS double) AS ldm, cast(m3 AS double) AS m3,
       branch, category1, category2 FROM clean
"""
QUERIES["rejected_rows"] = _REJECTED
QUERIES["rejected_count"] = "SELECT count(*) AS rejected FROM usable WHERE NOT ok"
QUERIES["zone_normalise"] = """
SELECT zone, CASE WHEN substr(zone, 1, 2) IN ('AD','ME','RU','XK','UA','BY','BA') THEN substr(zone, 1, 2)
                  WHEN substr(zone, 1, 2) = 'GB' THEN 'UK' || substr(zone, 3) ELSE zone END AS normalised,
       count(*) AS rows
FROM (SELECT zc_from AS zone FROM fx_shipments_raw UNION ALL SELECT zc_to FROM fx_shipments_raw) z
GROUP BY zone
"""
QUERIES["coerce_types"] = """
SELECT l_orderkey, l_linenumber,
       cast(CASE WHEN l_linenumber = 1 THEN l_quantity * 10 WHEN l_linenumber <> 3 THEN l_quantity END AS double) AS kg,
       cast(l_discount AS double) AS ldm, cast(CASE WHEN l_linenumber <> 4 THEN l_tax END AS double) AS m3,
       CASE WHEN l_linenumber <> 2 THEN cast(l_shipdate AS date) END AS ship_date
FROM lineitem
"""
for _order in ("dates_day_first", "dates_month_first"):
    QUERIES[_order] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN cast(l_shipdate AS date) END AS ship_date FROM lineitem
"""
_ENRICHED_COLUMNS = """zc_from, zc_to, cntry_from, cntry_to, way, cast(pay_weight AS double) AS pay_weight,
       bracket, product"""
QUERIES["enrich_shipments"] = f"SELECT {_ENRICHED_COLUMNS} FROM ship"
QUERIES["enrich_home_gb"] = "SELECT way, product, count(*) AS shipments FROM ship_uk GROUP BY way, product"
QUERIES["enrich_with_factor"] = f"SELECT {_ENRICHED_COLUMNS}, ldm, ldm_eq FROM ship_factor"
QUERIES["lane_key"] = """
SELECT zc_from || ' - ' || zc_to AS lane, count(*) AS shipments FROM ship GROUP BY 1
"""
QUERIES["format_thousands"] = """
SELECT zc_from, replace(format('{:,}', cast(sum(kg) AS bigint)), ',', ' ') AS kg FROM ship GROUP BY zc_from
"""

# ---------------------------------------------------------------- facets

_FACET = "branch IS NOT NULL AND cntry_from IN ('FR', 'DE', 'IT') AND zc_from IS NOT NULL AND cntry_to IS NOT NULL"
QUERIES["facet_filter"] = f"""
SELECT {_ENRICHED_COLUMNS}, branch FROM ship
WHERE {_FACET} AND zc_to IS NOT NULL AND product IN ('GRP', 'LTL') AND way IS NOT NULL
"""
QUERIES["facet_filter_categories"] = f"""
SELECT {_ENRICHED_COLUMNS}, branch, category1, category2 FROM ship
WHERE {_FACET} AND category1 IN ('A', 'N') AND category2 IS NOT NULL AND product IS NOT NULL AND way IN ('Exp', 'X-trade')
"""
QUERIES["date_range_filter"] = """
SELECT zc_from, zc_to, ship_date, cast(kg AS double) AS kg FROM ship
WHERE ship_date IS NOT NULL AND ship_date BETWEEN date '1996-01-01' AND date '1998-12-31'
"""
QUERIES["date_range_off"] = """
SELECT zc_from, count(*) AS shipments FROM ship
WHERE (SELECT count(*) FROM ship WHERE ship_date IS NULL) > 0 OR ship_date BETWEEN date '1996-01-01' AND date '1998-12-31'
GROUP BY zc_from
"""
QUERIES["date_bounds"] = "SELECT min(ship_date) AS first_date, max(ship_date) AS last_date FROM ship"
QUERIES["facet_options"] = """
SELECT DISTINCT facet_no, facet, value FROM (
  SELECT 0 AS facet_no, 'branch' AS facet, branch AS value FROM ship
  UNION ALL SELECT 1, 'category1', category1 FROM ship WHERE branch IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 2, 'category2', category2 FROM ship WHERE branch IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 3, 'cntry_from', cntry_from FROM ship WHERE branch IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 4, 'zc_from', zc_from FROM ship WHERE branch IN ('1-URGENT', '2-HIGH') AND cntry_from IN ('FR', 'DE')
  UNION ALL SELECT 5, 'cntry_to', cntry_to FROM ship WHERE branch IN ('1-URGENT', '2-HIGH') AND cntry_from IN ('FR', 'DE')
  UNION ALL SELECT 6, 'zc_to', zc_to FROM ship WHERE branch IN ('1-URGENT', '2-HIGH') AND cntry_from IN ('FR', 'DE')
  UNION ALL SELECT 7, 'product', product FROM ship WHERE branch IN ('1-URGENT', '2-HIGH') AND cntry_from IN ('FR', 'DE')
  UNION ALL SELECT 8, 'way', way FROM ship WHERE branch IN ('1-URGENT', '2-HIGH') AND cntry_from IN ('FR', 'DE')) o
"""
QUERIES["map_filter"] = f"""
SELECT {_ENRICHED_COLUMNS} FROM ship WHERE product IN ('LTL', 'FTL') AND branch IN ('3-MEDIUM')
"""
QUERIES["map_filter_dates"] = f"""
SELECT {_ENRICHED_COLUMNS}, ship_date FROM ship WHERE product IN ('LTL', 'FTL') AND branch IN ('3-MEDIUM')
  AND ship_date BETWEEN date '1996-01-01' AND date '1998-12-31'
"""
QUERIES["facet_filter_dates"] = f"""
SELECT {_ENRICHED_COLUMNS}, ship_date FROM ship
WHERE product IN ('GRP', 'LTL') AND branch IS NOT NULL AND ship_date BETWEEN date '1996-01-01' AND date '1998-12-31'
"""
QUERIES["facet_filter_dates_off"] = f"""
SELECT {_ENRICHED_COLUMNS} FROM ship WHERE product IN ('GRP', 'LTL') AND branch IS NOT NULL
"""
QUERIES["zone_list"] = "SELECT DISTINCT zc_from AS zone FROM ship"

# ---------------------------------------------------------------- summary

QUERIES["summary_way"] = """
SELECT w.way, count(zc_from) AS shipments
FROM (VALUES ('Dom'), ('Exp'), ('Imp'), ('X-trade')) w(way) LEFT JOIN summ ON summ.way = w.way GROUP BY w.way
"""
QUERIES["summary_product_count"] = "SELECT product, count(*) AS shipments FROM summ GROUP BY product"
QUERIES["summary_bracket"] = f"""
SELECT bracket, shipments, {pct('shipments', 'n')} AS share,
       cast({pct('shipments', 'n')} AS varchar) || '%' AS share_text
FROM (SELECT bracket, count(*) AS shipments FROM summ GROUP BY bracket) b, (SELECT count(*) AS n FROM summ) t
"""
QUERIES["top_delivery"] = f"""
SELECT zc_to, count(zc_from) AS shipments, {d('sum(kg)')} AS kg, {d('sum(ldm)')} AS ldm, {d('sum(pay_weight)')} AS pay_weight
FROM summ GROUP BY zc_to ORDER BY shipments DESC, zc_to LIMIT 10
"""
QUERIES["top_collection"] = f"""
SELECT zc_from, count(zc_to) AS shipments, {d('sum(kg)')} AS kg, {d('sum(ldm)')} AS ldm, {d('sum(pay_weight)')} AS pay_weight
FROM summ GROUP BY zc_from ORDER BY shipments DESC, zc_from LIMIT 10
"""
QUERIES["top_lanes"] = f"""
SELECT zc_from, zc_to, count(pay_weight) AS shipments, {d('sum(kg)')} AS kg, {d('sum(ldm)')} AS ldm,
       zc_from || ' - ' || zc_to AS lane
FROM summ GROUP BY zc_from, zc_to ORDER BY shipments DESC, zc_from, zc_to LIMIT 10
"""
QUERIES["seasonality"] = f"""
SELECT strftime(ship_date, '%Y-%m') AS month, count(ship_date) AS shipments, {d('sum(kg)')} AS kg,
       {d('sum(ldm)')} AS ldm, {d('sum(pay_weight)')} AS pay_weight
FROM summ WHERE ship_date IS NOT NULL GROUP BY 1
"""


def _sheet(name: str, sql: str, texts: tuple[str, ...], *numbers: str) -> str:
    text = " || '|' || ".join(f"coalesce(cast({c} AS varchar), 'null')" for c in texts)
    padded = [*numbers, *["NULL"] * (4 - len(numbers))]
    columns = ", ".join(f"cast({n} AS double) AS number{i}" for i, n in enumerate(padded, 1))
    return f"SELECT '{name}' AS name, {text} AS texts, {columns} FROM ({sql}) q"


QUERIES["export_tables"] = "\nUNION ALL ".join(
    (
        _sheet("rejected", _REJECTED, ("branch", "category1", "category2", "ship_date", "zc_from", "zc_to"), "kg", "ldm", "m3"),
        _sheet("ways", QUERIES["summary_way"], ("way",), "shipments"),
        _sheet("brackets", QUERIES["summary_bracket"], ("share_text",), "bracket", "share", "shipments"),
        _sheet("branches", QUERIES["branch_points"], ("office_name", "opening_hours", "phone", "zone"), "lat", "lon"),
        _sheet("months", QUERIES["seasonality"], ("month",), "kg", "ldm", "pay_weight", "shipments"),
    )
)
_METRICS = {
    "Shipments": "count(zc_to)",
    "kg": "trunc(coalesce(sum(kg), 0))",
    "ldm": "trunc(coalesce(sum(ldm), 0))",
    "Pay weight": "trunc(coalesce(sum(pay_weight), 0))",
}
QUERIES["product_matrix"] = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, "
    + ", ".join(
        f"cast(coalesce(max(CASE WHEN product = '{p}' THEN v END), 0) AS bigint) AS {p.lower()}"
        for p in ("Parcel", "GRP", "LTL", "FTL")
    )
    + f", cast(sum(v) AS bigint) AS total FROM (SELECT product, {expr} AS v FROM summ GROUP BY product) m"
    for name, expr in _METRICS.items()
)
QUERIES["way_product"] = """
SELECT way, count(CASE WHEN product = 'Parcel' THEN pay_weight END) AS parcel,
       count(CASE WHEN product = 'GRP' THEN pay_weight END) AS grp,
       count(CASE WHEN product = 'LTL' THEN pay_weight END) AS ltl,
       count(CASE WHEN product = 'FTL' THEN pay_weight END) AS ftl, count(pay_weight) AS total
FROM summ GROUP BY way
"""
QUERIES["lane_pareto"] = f"""
SELECT zc_from, zc_to, shipments, {pct('shipments', 'n')} AS share, {pct('reached', 'n')} AS cumulative_share
FROM (SELECT *, cast(sum(shipments) OVER (ORDER BY shipments DESC RANGE UNBOUNDED PRECEDING) AS bigint) AS reached,
             cast(sum(shipments) OVER () AS bigint) AS n
      FROM (SELECT zc_from, zc_to, count(pay_weight) AS shipments FROM summ GROUP BY zc_from, zc_to) l) w
"""

# ---------------------------------------------------------------- lane profile

VIEWS["lanes"] = f"""
SELECT cntry_from, zc_from, cntry_to, zc_to,
       {', '.join(f'count(CASE WHEN bracket = {b} THEN pay_weight END) AS b{b}' for b in BRACKETS)},
       count(pay_weight) AS total
FROM ship GROUP BY cntry_from, zc_from, cntry_to, zc_to HAVING count(pay_weight) > 0
"""
VIEWS["alls"] = f"""
SELECT {', '.join(f'cast(sum({b}) AS bigint) AS {b}' for b in B)}, cast(sum(total) AS bigint) AS total,
       cast(min(total) AS bigint) AS lo, cast(max(total) AS bigint) AS hi FROM lanes
"""
QUERIES["lane_profile"] = f"SELECT l.*, {pct('l.total', 'a.total')} AS share FROM lanes l CROSS JOIN alls a"
QUERIES["profile_totals"] = f"""
SELECT 0 AS ord, '%' AS label, {', '.join(f'{pct(b, "total", 1)} AS {b}' for b in B)}, 100.0e0 AS total FROM alls
UNION ALL
SELECT 1, 'Total', {', '.join(f'cast({b} AS double)' for b in B)}, cast(total AS double) FROM alls
"""
VIEWS["bracket_pct"] = " UNION ALL ".join(
    f"SELECT {b} AS bracket, b{b} AS n, {pct(f'b{b}', 'total', 1)} AS pct FROM alls WHERE b{b} > 0" for b in BRACKETS
)
QUERIES["profile_extents"] = f"""
SELECT {pct('lo', 'total')} AS min_share, {pct('hi', 'total')} AS max_share, lo AS min_total, hi AS max_total,
       (SELECT min(pct) FROM bracket_pct) AS min_bracket_pct, (SELECT max(pct) FROM bracket_pct) AS max_bracket_pct
FROM alls
"""
QUERIES["profile_bands"] = f"""
SELECT cntry_from, zc_from, cntry_to, zc_to, total, share, p AS share_position,
       CASE WHEN p >= 75 THEN 'high' WHEN p >= 50 THEN 'middle' ELSE 'low' END AS share_band,
       CASE WHEN total >= 80 THEN '>=80' WHEN total >= 60 THEN '>=60' WHEN total >= 30 THEN '>=30' ELSE '<30' END AS total_band
FROM (SELECT *, CASE WHEN hs <> ls THEN (share - ls) / (hs - ls) * 100.0e0 END AS p
      FROM (SELECT l.*, {pct('l.total', 'a.total')} AS share, {pct('a.lo', 'a.total')} AS ls, {pct('a.hi', 'a.total')} AS hs
            FROM lanes l CROSS JOIN alls a) s) q
"""
QUERIES["profile_bracket_bands"] = """
SELECT bracket, pct, p AS pct_position,
       CASE WHEN p >= 80 THEN 'high' WHEN p >= 30 THEN 'middle' ELSE 'low' END AS pct_band
FROM (SELECT bracket, pct, CASE WHEN hi <> lo THEN (pct - lo) / (hi - lo) * 100.0e0 END AS p
      FROM bracket_pct, (SELECT min(pct) AS lo, max(pct) AS hi FROM bracket_pct) e) q
"""

# ---------------------------------------------------------------- collection

VIEWS["days"] = """
SELECT ship_date, count(ship_date) AS shipments, coalesce(sum(kg), 0) AS kg, coalesce(sum(ldm), 0) AS ldm,
       coalesce(sum(pay_weight), 0) AS pay_weight
FROM ship WHERE ship_date IS NOT NULL GROUP BY ship_date
"""
_SUMS = "{0} AS kg, {1} AS ldm, {2} AS pay_weight".format(d("sum(kg)"), d("sum(ldm)"), d("sum(pay_weight)"))
QUERIES["daily_totals"] = """
SELECT ship_date, shipments, cast(kg AS double) AS kg, cast(ldm AS double) AS ldm,
       cast(pay_weight AS double) AS pay_weight FROM days
"""
QUERIES["weekday_totals"] = f"""
SELECT w.day_no, w.day, count(ship_date) AS collections, cast(coalesce(sum(shipments), 0) AS bigint) AS shipments, {_SUMS}
FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'),
             (6, 'Sunday')) w(day_no, day)
LEFT JOIN days ON isodow(ship_date) - 1 = w.day_no GROUP BY w.day_no, w.day
"""
QUERIES["collection_totals"] = f"SELECT cast(sum(shipments) AS bigint) AS shipments, {_SUMS} FROM days"
QUERIES["daily_describe"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, count(v) AS days, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM (SELECT cast({m} AS double) AS v FROM days) q"""
    for m in ("shipments", "kg", "ldm", "pay_weight")
)
QUERIES["working_days"] = """
SELECT count(*) AS total_days, count(CASE WHEN isodow(ship_date) <= 5 THEN 1 END) AS working_days,
       cast(count(CASE WHEN isodow(ship_date) <= 5 THEN 1 END) AS double) / count(*) * 5.0e0 AS per_week
FROM days
"""
QUERIES["ldm_buckets"] = """
SELECT ord, CASE ord WHEN 0 THEN '0.5' WHEN 11 THEN 'FTL' WHEN 12 THEN 'sup.FTL' ELSE cast(ord AS varchar) END AS bucket,
       count(*) AS collections
FROM (SELECT CASE WHEN ldm <= 0.5 THEN 0 WHEN ldm <= 10 THEN cast(ceil(greatest(ldm, 1)) AS int) WHEN ldm <= 13.6 THEN 11
                  ELSE 12 END AS ord FROM days) b
GROUP BY ord
"""
QUERIES["ldm_buckets_by_lane"] = """
SELECT ord, CASE ord WHEN 0 THEN '0.5' WHEN 11 THEN 'FTL' WHEN 12 THEN 'sup.FTL' ELSE cast(ord AS varchar) END AS bucket,
       count(*) AS collections
FROM (SELECT CASE WHEN ldm <= 0.5 THEN 0 WHEN ldm <= 10 THEN cast(ceil(greatest(ldm, 1)) AS int) WHEN ldm <= 13.6 THEN 11
                  ELSE 12 END AS ord
      FROM (SELECT ship_date, sum(ldm) AS ldm FROM ship WHERE ship_date IS NOT NULL AND zc_from = 'FR 20'
            GROUP BY ship_date) z) b
GROUP BY ord
"""
QUERIES["collection_seasonality"] = """
SELECT strftime(ship_date, '%Y-%m') AS month, count(kg) AS collections FROM ship
WHERE ldm IS NOT NULL AND ship_date IS NOT NULL GROUP BY 1
"""

# ---------------------------------------------------------------- regions


def split(zone: str, level: int, measure: str = "count(pay_weight)", where: str = "true") -> str:
    """Zone values, divided by the number of bridge rows of the zone, summed per region."""
    return f"""
SELECT nuts{level} AS region_id, round(sum(v / fan), 6) AS value
FROM (SELECT {zone} AS zone, cast({measure} AS double) AS v FROM ship WHERE {where} GROUP BY {zone}) s
JOIN fx_zone_region z ON z.zone = s.zone
JOIN (SELECT zone, count(*) AS fan FROM fx_zone_region GROUP BY zone) f ON f.zone = s.zone
WHERE nuts{level} IS NOT NULL GROUP BY nuts{level}"""


def named(totals: str, level: int) -> str:
    return f"""
SELECT t.region_id, a.name, a.lat, a.lon, t.value
FROM ({totals}) t LEFT JOIN fx_region_attrs a ON a.region_id = t.region_id AND a.lvl = {level}
"""


QUERIES["region_delivery"] = split("zc_to", 0)
QUERIES["region_collection"] = split("zc_from", 0)
QUERIES["region_join"] = named(split("zc_to", 0), 0) + "WHERE a.name IS NULL"
for _level in range(4):
    QUERIES[f"region_by_level_{_level}"] = named(split("zc_to", _level), _level)
for _variable in ("pay_weight", "kg", "ldm", "m3"):
    QUERIES[f"outbound_{_variable}"] = named(split("zc_to", 1, f"sum({_variable})", "zc_from = 'FR 20'"), 1)
QUERIES["outbound_map"] = named(split("zc_to", 2, where="zc_from = 'FR 20'"), 2)
QUERIES["inbound_map"] = named(split("zc_from", 2, where="zc_to = 'DE 01'"), 2)
QUERIES["inbound_kg"] = named(split("zc_from", 1, "sum(kg)", "zc_to = 'DE 01'"), 1)
QUERIES["top_zones_by_variable"] = f"""
SELECT zc_from AS zone, {d('sum(pay_weight)')} AS pay_weight, {d('sum(kg)')} AS kg, {d('sum(ldm)')} AS ldm, {d('sum(m3)')} AS m3
FROM ship WHERE ldm IS NOT NULL GROUP BY zc_from ORDER BY ldm DESC, zone LIMIT 10
"""
QUERIES["top_zones_by_shipments"] = f"""
SELECT zc_to AS zone, count(pay_weight) AS shipments, {d('sum(kg)')} AS kg, {d('sum(ldm)')} AS ldm, {d('sum(m3)')} AS m3
FROM ship GROUP BY zc_to ORDER BY shipments DESC, zone LIMIT 10
"""
QUERIES["marker_radius"] = f"""
SELECT region_id, value, round(coalesce(CASE WHEN hi <> lo THEN (value - lo) / (hi - lo) * 15 + 5 END, 10), 6) AS radius
FROM (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM ({split('zc_from', 0)}) t) m
"""
VIEWS["rings"] = """
SELECT region_id, ring, sum(c) AS a, sum((lon + nlon) * c) AS mx, sum((lat + nlat) * c) AS my
FROM (SELECT *, lon * nlat - nlon * lat AS c
      FROM (SELECT *, lead(lon, 1, lon) OVER w AS nlon, lead(lat, 1, lat) OVER w AS nlat FROM fx_outlines
            WINDOW w AS (PARTITION BY region_id, part, ring ORDER BY seq)) e) x
GROUP BY region_id, part, ring
"""
VIEWS["centroids"] = """
SELECT region_id, sum(s * mx) / (3 * sum(s * a)) AS lon, sum(s * my) / (3 * sum(s * a)) AS lat
FROM (SELECT *, sign(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS s FROM rings) r GROUP BY region_id
"""
QUERIES["region_centroid"] = "SELECT region_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM centroids"
QUERIES["zone_anchor"] = "SELECT zone, arg_min(nuts3, seq) AS region_id FROM fx_catchments GROUP BY zone"
QUERIES["zone_centroid"] = """
SELECT zone, a.region_id, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM (SELECT zone, arg_min(nuts3, seq) AS region_id FROM fx_catchments GROUP BY zone) a
JOIN centroids c ON c.region_id = a.region_id
"""

# ---------------------------------------------------------------- regularity

VIEWS["week"] = f"""
SELECT zc_from || ' - ' || zc_to AS lane, branch, product, way,
       cast(sum(ldm) AS double) / count(ldm) AS average_ldm,
       {', '.join(f'count(CASE WHEN isodow(ship_date) = {n + 1} THEN pay_weight END) AS {day}' for n, day in enumerate(DAYS))},
       count(pay_weight) AS total
FROM ship WHERE ship_date IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(pay_weight) > 0
"""
QUERIES["regularity"] = "SELECT * FROM week"
QUERIES["weekly_trend"] = f"SELECT lane, branch, product, way, concat_ws(',', {', '.join(DAYS)}) AS trend FROM week"


def band(day: str) -> str:
    steps = " ".join(
        f"WHEN {day} * 100 > total * {s} THEN '>{s}'" for s in (92, 83, 75, 67, 58, 50, 42, 33, 25, 17, 8)
    )
    return f"CASE WHEN {day} = total THEN '=100' {steps} WHEN {day} * 100 < total * 8 THEN '<8' END AS {day}"


QUERIES["regularity_band"] = f"SELECT lane, branch, product, way, {', '.join(band(x) for x in DAYS)} FROM week"

# ---------------------------------------------------------------- tender files

_CELLS = ("Collection country", "Collection zipcode", "Delivery country", "Delivery zipcode", "Goods")


def cell(name: str) -> str:
    text = f"coalesce(\"{name}\", '')"
    number = f"regexp_full_match({text}, '[0-9]+\\.?[0-9]*|\\.[0-9]+')"
    return (
        f"regexp_replace(CASE WHEN {number} THEN split_part({text}, '.', 1) ELSE {text} END, "
        f"'^\\s+|\\s+$', '', 'g') AS \"{name}\""
    )


VIEWS["bid_cells"] = f"""
SELECT * FROM (SELECT row_id, {', '.join(cell(c) for c in _CELLS)} FROM fx_bid_raw) c
WHERE {' OR '.join(f'"{c}" <> ' + "''" for c in _CELLS)}
"""
def names_of(table: str) -> str:
    return f"""
SELECT country, arg_min(iso2, place) AS iso2, cast(min(place) AS bigint) AS ord
FROM (SELECT country_1 AS country, iso2, ord + 0 * 1099511627776 AS place FROM {table}
      UNION ALL SELECT country_2, iso2, ord + 1 * 1099511627776 FROM {table}
      UNION ALL SELECT country_3, iso2, ord + 2 * 1099511627776 FROM {table}
      UNION ALL SELECT country_4, iso2, ord + 3 * 1099511627776 FROM {table}) n
WHERE country IS NOT NULL GROUP BY country
"""


VIEWS["names"] = names_of("fx_country_names")


def plain(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"array_to_string(list_sort(string_split({text}, ' ')), ' ')"


def sim(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    shortest = f"least(length({a}), length({b}))"
    near = f"least(levenshtein({a}, {b}), levenshtein({a}_t, {b}_t))"
    close = f"CASE WHEN {longest} > 0 THEN ((200 * ({longest} - {near}) + {longest}) // (2 * {longest})) ELSE 0 END"
    prefix = (
        f"CASE WHEN {shortest} > 0 AND 2 * {longest} >= 3 * {shortest} AND {longest} <= 8 * {shortest} "
        f"AND (starts_with({a}, {b}) OR starts_with({b}, {a})) THEN 90 ELSE 0 END"
    )
    return f"CASE WHEN {b} IS NOT NULL THEN cast(greatest({close}, {prefix}) AS bigint) END"


def best(keys: str, choices: str, block: bool) -> str:
    """Brute force: every text with every entry of its block, the best score, then the lowest ord."""
    on = "k.block = c.block" if block else "true"
    return f"""
SELECT block, text, score, ord FROM (
  SELECT k.block, k.text, c.ord, {sim('k.n', 'c.n')} AS score,
         row_number() OVER (PARTITION BY k.block, k.text ORDER BY {sim('k.n', 'c.n')} DESC, c.ord) AS rn
  FROM (SELECT *, {tokens('n')} AS n_t FROM (SELECT *, {plain('text')} AS n FROM ({keys}) k0) k1) k
  LEFT JOIN (SELECT *, {tokens('n')} AS n_t FROM (SELECT *, {plain('text')} AS n FROM ({choices}) c0) c1) c ON {on}) r
WHERE rn = 1"""


def country_match(column: str) -> str:
    keys = f"SELECT DISTINCT '' AS block, \"{column}\" AS text FROM bid_cells WHERE \"{column}\" <> ''"
    choices = "SELECT '' AS block, country AS text, ord FROM names"
    return f"""
SELECT b.text, n.country AS matched, b.score, n.iso2 FROM ({best(keys, choices, False)}) b JOIN names n ON n.ord = b.ord
"""


VIEWS["origin_country"] = country_match("Collection country")
VIEWS["destination_country"] = country_match("Delivery country")


def zip_of(text: str, iso: str) -> str:
    return (
        f"CASE WHEN {iso} IN ('GB', 'IE') THEN regexp_replace({text}, '[^A-Za-z0-9]', '', 'g') "
        f"ELSE regexp_replace({text}, '[^0-9]', '', 'g') END"
    )


VIEWS["bid_zones"] = f"""
SELECT *, CASE WHEN iso_origin <> '' AND oz <> '' THEN iso_origin || ' ' || oz END AS origin_zone,
       CASE WHEN iso_destination <> '' AND dz <> '' THEN iso_destination || ' ' || dz END AS destination_zone
FROM (SELECT b.*, o.iso2 AS iso_origin, o.score AS origin_country_score, t.iso2 AS iso_destination,
             t.score AS destination_country_score,
             {zip_of('b."Collection zipcode"', 'o.iso2')} AS oz, {zip_of('b."Delivery zipcode"', 't.iso2')} AS dz
      FROM bid_cells b LEFT JOIN origin_country o ON o.text = b."Collection country"
      LEFT JOIN destination_country t ON t.text = b."Delivery country") z
"""


def zone_match(side: str) -> str:
    keys = f"SELECT DISTINCT iso_{side} AS block, {side}_zone AS text FROM bid_zones WHERE iso_{side} IS NOT NULL AND {side}_zone IS NOT NULL"
    choices = "SELECT country AS block, full_zc AS text, ord FROM fx_postal_ref"
    return f"""
SELECT b.block AS country, b.text, p.full_zc, b.score, p.zc
FROM ({best(keys, choices, True)}) b LEFT JOIN fx_postal_ref p ON p.country = b.block AND p.ord = b.ord
"""


VIEWS["origin_match"] = zone_match("origin")
VIEWS["destination_match"] = zone_match("destination")
VIEWS["points"] = """
SELECT z.*, o.full_zc AS origin_match, o.score AS origin_score, o.zc AS origin_zc,
       t.full_zc AS destination_match, t.score AS destination_score, t.zc AS destination_zc,
       coalesce(origin_country_score, 0) + coalesce(o.score, 0) + coalesce(t.score, 0) AS legacy_points,
       coalesce(origin_country_score, 0) + coalesce(o.score, 0) + coalesce(t.score, 0)
         + coalesce(destination_country_score, 0) AS points
FROM bid_zones z LEFT JOIN origin_match o ON o.country = z.iso_origin AND o.text = z.origin_zone
LEFT JOIN destination_match t ON t.country = z.iso_destination AND t.text = z.destination_zone
"""


def scored(points: str) -> str:
    return f"""
SELECT *, CASE WHEN needs_review THEN 'oui' ELSE 'non' END AS review_flag
FROM (SELECT *, match_score <= 0.9e0 OR origin_zc IS NULL OR destination_zc IS NULL AS needs_review
FROM (SELECT *, CASE WHEN hi = lo AND hi = 0 THEN 0.1e0 WHEN hi = lo THEN 1.0e0
               ELSE cast((2 * (10 * (hi - lo) + 90 * ({points} - lo)) + (hi - lo)) // (2 * (hi - lo)) AS double) / 100.0e0
               END AS match_score
      FROM (SELECT *, min({points}) OVER () AS lo, max({points}) OVER () AS hi FROM points) m) s) f
"""


QUERIES["bid_normalise"] = "SELECT * FROM bid_cells"
VIEWS["profile"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS cells,
       cast((2000 * count(n.known) + count(*)) // (2 * count(*)) AS double) / 1000.0e0 AS country_share,
       cast((2000 * count(CASE WHEN regexp_matches(cell, '^[A-Za-z0-9][A-Za-z0-9 -]+$')
             AND regexp_matches(cell, '[0-9]') THEN 1 END) + count(*)) // (2 * count(*)) AS double) / 1000.0e0 AS zip_share,
       cast({i} AS bigint) AS position, {'true' if 'Collection' in c else 'false'} AS names_origin, {'true' if 'Delivery' in c else 'false'} AS names_destination
FROM (SELECT "{c}" AS cell FROM bid_cells WHERE "{c}" <> '') v
LEFT JOIN (SELECT DISTINCT x, 1 AS known FROM (SELECT {plain('country')} AS x FROM names
           UNION ALL SELECT {plain('iso2')} FROM names) u) n ON n.x = {plain('cell')}"""
    for i, c in enumerate(_CELLS)
)
QUERIES["column_role_profile"] = "SELECT * FROM profile"
VIEWS["roles"] = """
SELECT role, "column", share FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY share DESC, position) AS rn FROM (
    SELECT 'origin_cntry' AS role, "column", position, country_share AS share FROM profile
      WHERE names_origin AND country_share > zip_share
    UNION ALL SELECT 'origin_zipcode', "column", position, zip_share FROM profile
      WHERE names_origin AND zip_share > country_share
    UNION ALL SELECT 'destination_cntry', "column", position, country_share FROM profile
      WHERE names_destination AND country_share > zip_share
    UNION ALL SELECT 'destination_zipcode', "column", position, zip_share FROM profile
      WHERE names_destination AND zip_share > country_share) r) q
WHERE rn = 1
"""
QUERIES["column_roles"] = 'SELECT role, "column", share FROM roles'
QUERIES["bid_feasible"] = """
SELECT count(CASE WHEN role LIKE '%cntry' THEN 1 END) > 0 AND count(CASE WHEN role LIKE '%zipcode' THEN 1 END) > 0
         AS has_country_and_zip, count(DISTINCT role) = 4 AS has_both_ends FROM roles
"""
QUERIES["country_names_long"] = names_of("fx_name_table")
QUERIES["read_country_names"] = f"SELECT country, iso2 FROM ({names_of('fx_name_table')}) n"
QUERIES["fuzzy_country"] = "SELECT * FROM origin_country UNION SELECT * FROM destination_country"
QUERIES["clean_zip"] = f"""
SELECT row_id, iso, zip, {zip_of('zip', 'iso')} AS cleaned
FROM (SELECT row_id, iso2 AS iso, "Collection zipcode" AS zip FROM fx_bid_raw
      JOIN fx_country_names ON ord = row_id % 25) b
"""
QUERIES["compose_zone"] = """
SELECT row_id, CASE WHEN iso2 <> '' AND "Delivery zipcode" <> '' THEN iso2 || ' ' || "Delivery zipcode" END AS zone
FROM fx_bid_raw JOIN fx_country_names ON ord = row_id % 25
"""
QUERIES["short_zone"] = """
SELECT row_id, CASE WHEN iso2 <> '' AND "Delivery zipcode" <> '' THEN iso2 || ' ' || substr("Delivery zipcode", 1, 2) END AS zone
FROM fx_bid_raw JOIN fx_country_names ON ord = row_id % 25
"""
QUERIES["pad_zip"] = f"""
SELECT row_id, "end", zip,
       CASE WHEN length(zip) = 2 OR n IS NULL OR length(zip) >= n THEN zip ELSE lpad(zip, n, '0') END AS padded
FROM (SELECT row_id, "end", regexp_replace({zip_of('text', 'iso2')}, '^0+', '') AS zip, n
      FROM (SELECT row_id, 'from' AS "end", "Collection zipcode" AS text FROM fx_bid_raw
            UNION ALL SELECT row_id, 'to', "Delivery zipcode" FROM fx_bid_raw) b
      JOIN fx_country_names ON ord = row_id % 25
      LEFT JOIN (VALUES ('AT', 4), ('BA', 5), ('BE', 4), ('CZ', 5), ('DE', 5), ('DK', 4), ('ES', 5), ('FI', 5), ('FR', 5),
                        ('HU', 4), ('IT', 5), ('ME', 5), ('NL', 4), ('NO', 4), ('PL', 5), ('PT', 7), ('RO', 6), ('SE', 5),
                        ('XK', 5)) l(c, n) ON c = iso2) z
"""
QUERIES["fuzzy_zone"] = "SELECT * FROM origin_match UNION SELECT * FROM destination_match"
QUERIES["match_score"] = f"SELECT row_id, match_score, needs_review, review_flag FROM ({scored('legacy_points')}) s"
QUERIES["bid_zone_pairs"] = f"""
SELECT row_id, iso_origin, origin_zone, origin_match, origin_zc, origin_country_score, origin_score, iso_destination,
       destination_zone, destination_match, destination_zc, destination_country_score, destination_score,
       match_score, needs_review, review_flag FROM ({scored('points')}) s
"""
QUERIES["bid_next_file"] = QUERIES["bid_zone_pairs"]
QUERIES["column_assignment"] = """
SELECT r.role, r."column", ((2000 * r.part + s.n) // (2 * s.n)) / 1000e0 AS share
FROM (SELECT count(*) AS n, count_if(row_id % 10 >= 6) AS codes, count_if(row_id % 20 < 11) AS names,
             count_if(row_id % 4 > 0) AS last FROM fx_bid_raw) s,
     LATERAL (VALUES ('origin_cntry', 'Collection 2', names), ('origin_zipcode', 'Collection 1', codes),
                     ('destination_zipcode', 'Delivery 2', last)) r(role, "column", part)
"""
QUERIES["bid_corrected"] = f"""
SELECT row_id, origin_zc, destination_zc, match_score, review AS needs_review, CASE WHEN review THEN 'oui' ELSE 'non' END AS review_flag,
       row_id % 7 = 0 AS corrected
FROM (SELECT row_id, match_score, CASE WHEN row_id % 7 = 0 THEN 'FR 99' ELSE origin_zc END AS origin_zc,
             CASE WHEN row_id % 14 = 0 THEN 'DE 99' ELSE destination_zc END AS destination_zc,
             CASE WHEN row_id % 7 <> 0 THEN needs_review ELSE row_id % 14 <> 0 AND destination_zc IS NULL END AS review
      FROM ({scored('points')}) s) c
"""
QUERIES["bid_without_roles"] = """
SELECT row_id, cast(NULL AS varchar) AS origin_zc, cast(NULL AS varchar) AS destination_zc, 0.1e0 AS match_score,
       true AS needs_review, 'oui' AS review_flag FROM bid_cells
"""
QUERIES["bid_part_mapping"] = f"SELECT row_id, origin_zc, destination_zc, match_score, review_flag FROM ({scored('points')}) s"
VIEWS["fx_customer_zones"] = """
SELECT substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', c_nationkey*2+1, 2) AS country,
       substr('FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK', c_nationkey*2+1, 2)
         || ' ' || lpad(cast(c_custkey AS varchar), 9, '0') AS full_zc, c_custkey AS ord
FROM customer
"""
_CUSTOMERS = best(
    "SELECT DISTINCT country AS block, substr(full_zc, 1, 6) || substr(full_zc, 8) AS text FROM fx_customer_zones",
    "SELECT country AS block, full_zc AS text, ord FROM fx_customer_zones",
    True,
)
QUERIES["fuzzy_customer_zone"] = f"""
SELECT b.block AS country, b.text, p.full_zc, b.score, p.full_zc AS zc
FROM ({_CUSTOMERS}) b JOIN fx_customer_zones p ON p.country = b.block AND p.ord = b.ord
"""
VIEWS["prefix_keys"] = """
SELECT DISTINCT iso2 AS country, CASE WHEN row_id % 2 = 0 THEN iso2 || ' ' || "Delivery zipcode"
                                      ELSE iso2 || '-' || "Delivery zipcode" END AS text
FROM fx_bid_raw JOIN fx_country_names ON ord = row_id % 25 WHERE "Delivery zipcode" IS NOT NULL
"""
VIEWS["prefix_found"] = """
SELECT k.country, k.text, arg_max(p.zc, length(p.zc)) AS prefix
FROM prefix_keys k LEFT JOIN fx_postal_ref p ON starts_with(k.text, p.zc) GROUP BY k.country, k.text
"""
_REST = best(
    "SELECT country AS block, text FROM prefix_found WHERE prefix IS NULL",
    "SELECT country AS block, full_zc AS text, ord FROM fx_postal_ref",
    True,
)
QUERIES["prefix_zone"] = f"""
SELECT country, text, prefix AS zc, cast(100 AS bigint) AS score FROM prefix_found WHERE prefix IS NOT NULL
UNION ALL
SELECT b.block, b.text, p.zc, b.score FROM ({_REST}) b
LEFT JOIN fx_postal_ref p ON p.country = b.block AND p.ord = b.ord
"""

# ---------------------------------------------------------------- answers

VIEWS["answer_parts"] = """
SELECT answer_id, i - 1 AS line_no, len(l) AS n, substr(l[i], 2) AS line
FROM (SELECT answer_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT answer_id, string_split(text, chr(10)) AS l FROM fx_answers) a) g
"""
_FIRST = "split_part(line, ': ', 1)"
_AFTER_FIRST = "substr(line, strpos(line, ': ') + 2)"
_THREE = (
    f"{_FIRST} AS question, split_part({_AFTER_FIRST}, ': ', 1) AS {{0}}, "
    f"CASE WHEN contains({_AFTER_FIRST}, ': ') THEN substr({_AFTER_FIRST}, strpos({_AFTER_FIRST}, ': ') + 2) ELSE '' END AS {{1}}"
)
QUERIES["answer_lines"] = f"""
SELECT answer_id, cast(line_no AS int) AS line_no, {_THREE.format('answer', 'description')} FROM answer_parts
WHERE line_no < 33 AND contains(line, ': ')
"""
QUERIES["fuel_lines"] = f"""
SELECT answer_id, cast(line_no - 33 AS int) AS line_no, {_FIRST} AS question, {_AFTER_FIRST} AS answer FROM answer_parts
WHERE line_no >= 33 AND line_no < n - 1 AND contains(line, ': ')
"""
QUERIES["verdict_line"] = f"""
SELECT answer_id, {_THREE.format('verdict', 'reason')} FROM answer_parts WHERE line_no = n - 1 AND contains(line, ': ')
"""
QUERIES["summary_split"] = """
SELECT answer_id, regexp_replace(split_part(text, chr(10) || chr(10), 1), '^\\s+|\\s+$', '', 'g') AS summary,
       CASE WHEN contains(text, chr(10) || chr(10))
            THEN regexp_replace(substr(text, strpos(text, chr(10) || chr(10)) + 2), '^\\s+|\\s+$', '', 'g')
            ELSE '' END AS recommendations
FROM fx_answers
"""
QUERIES["summary_split_conversations"] = """
SELECT conv_id, turn, regexp_replace(split_part(text, chr(10) || chr(10), 1), '^\\s+|\\s+$', '', 'g') AS summary,
       CASE WHEN contains(text, chr(10) || chr(10))
            THEN regexp_replace(substr(text, strpos(text, chr(10) || chr(10)) + 2), '^\\s+|\\s+$', '', 'g')
            ELSE '' END AS recommendations
FROM conversations
"""
QUERIES["token_chunks"] = """
SELECT doc_id, cast(i AS int) AS chunk_no, cast(len(piece) AS int) AS words, array_to_string(piece, ' ') AS chunk
FROM (SELECT doc_id, i, w[i * 1500 + 1 : (i + 1) * 1500] AS piece
      FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 1499) // 1500)) AS i
            FROM (SELECT doc_id, string_split_regex(t, '\\s+') AS w
                  FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) c
                  WHERE t <> '') s) u) p
"""


def _needed(sql: str, found: list[str]) -> list[str]:
    """Views that a statement uses, each after the views it uses itself."""
    for name in VIEWS:
        if name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def oracle_sql() -> dict[str, str]:
    statements = {}
    for key, sql in QUERIES.items():
        views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql, []))
        statements[key] = f"WITH {views}\n{sql.strip()}" if views else sql.strip()
    return statements
