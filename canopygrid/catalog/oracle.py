"""SQL that the named queries must equal, over the same tables.

Every statement is composed from shared common table expressions and runs over
whole tables.
"""

from __future__ import annotations

import re

# Hectares of a pixel, as a DOUBLE literal.
HA = "9e-2"

# Shared tables.  A table may use any table above it.
TABLES: dict[str, str] = {
    "px": """SELECT o_orderkey AS id, CAST(floor(o_orderkey / 128.0) AS INT) AS r, CAST(o_orderkey % 128 AS INT) AS c,
  CAST(1 + (CAST(floor(o_orderkey / 1024.0) AS BIGINT) * 7 + CAST(floor((o_orderkey % 128) / 8.0) AS BIGINT) * 13
    + o_orderkey % 3) % 8 AS INT) AS fcbm,
  CASE WHEN o_orderkey % 128 < 112 THEN 1 ELSE 2 END AS aoi,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS excl,
  c_nationkey + 2 AS division, o_totalprice / 500000.0 AS etp_cal, (c_acctbal + 1000.0) / 11000.0 AS etp_cnf,
  c_acctbal AS balance, n_regionkey AS regionkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "mk": """SELECT id, r, c, aoi, excl, division, etp_cal, etp_cnf,
  CASE WHEN aoi = 1 AND excl <> 1 THEN 1 ELSE 0 END AS mask, CASE WHEN aoi = 1 THEN 1 ELSE 0 END AS area,
  CASE WHEN aoi = 1 AND excl <> 1 THEN fcbm END AS fcbm FROM px""",
    "dm": """SELECT *, CAST(fcbm IN (6, 7, 8) AS INT) AS hrp_deforestation, CAST(fcbm IN (5, 6, 7, 8) AS INT) AS t1_forest,
  CAST(fcbm IN (1, 2, 3, 4) AS INT) AS t1_non_forest, CAST(fcbm IN (6, 7) AS INT) AS t1t2_deforestation,
  CAST(fcbm IN (5, 8) AS INT) AS t2_forest, CAST(fcbm IN (1, 2, 3, 4, 6, 7) AS INT) AS t2_non_forest,
  CAST(fcbm = 8 AS INT) AS t2t3_deforestation, CAST(fcbm = 5 AS INT) AS t3_forest,
  CAST(fcbm IN (1, 2, 3, 4, 6, 7, 8) AS INT) AS t3_non_forest FROM mk""",
    "tg": """SELECT 1 AS l, r, c FROM dm WHERE t1_non_forest = 1 UNION ALL SELECT 2, r, c FROM dm WHERE t2_non_forest = 1
  UNION ALL SELECT 3, r, c FROM dm WHERE t3_non_forest = 1 UNION ALL SELECT 4, r, c FROM dm WHERE fcbm = 1""",
    "vertical": """SELECT l, b.r, t.c, min((b.r - t.r) * (b.r - t.r)) AS g
  FROM (SELECT DISTINCT r FROM px) b, tg t GROUP BY l, b.r, t.c""",
    "nearest": """SELECT l, p.r, p.c, min((p.c - v.c) * (p.c - v.c) + g) AS d2
  FROM px p JOIN vertical v ON v.r = p.r GROUP BY l, p.r, p.c""",
    "dist": """SELECT dm.*, CASE WHEN mask = 1 THEN 30.0 * sqrt(a.d2) END AS t1_distance,
  CASE WHEN mask = 1 THEN 30.0 * sqrt(b.d2) END AS t2_distance, CASE WHEN mask = 1 THEN 30.0 * sqrt(e.d2) END AS t3_distance
  FROM dm LEFT JOIN nearest a ON a.l = 1 AND a.r = dm.r AND a.c = dm.c
  LEFT JOIN nearest b ON b.l = 2 AND b.r = dm.r AND b.c = dm.c
  LEFT JOIN nearest e ON e.l = 3 AND e.r = dm.r AND e.c = dm.c""",
    "lossd": "SELECT t1_distance AS v FROM dist WHERE mask = 1 AND hrp_deforestation = 1 AND t1_distance > 0",
    "bounds": "SELECT min(v) AS lo, max(v) AS hi, greatest(1, CAST(ceil((max(v) - min(v)) / 30) AS BIGINT)) AS nb FROM lossd",
    "hist": """SELECT s.bin, lo + s.bin * 30 AS bin_start, lo + (s.bin + 1) * 30 AS bin_end, coalesce(h.n, 0) AS n
  FROM bounds, (SELECT unnest(generate_series(0, (SELECT nb - 1 FROM bounds))) AS bin) s LEFT JOIN
  (SELECT least(CAST(floor((v - lo) / 30) AS BIGINT), nb - 1) AS bin, count(*) AS n FROM lossd, bounds GROUP BY 1) h
  ON h.bin = s.bin""",
    "cums": """SELECT *, sum(n) OVER (ORDER BY bin) AS cum_n, sum(n) OVER () AS total_n,
  sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cum_share FROM hist""",
    "nrt": """SELECT CAST(floor((bin_start + bin_end) / 2) AS INT) AS nrt, bin_start, bin_end, cum_share FROM cums
  WHERE cum_n * 1000 >= total_n * 995 ORDER BY bin LIMIT 1""",
    "bedges": """SELECT 1 AS class, CAST(NULL AS DOUBLE) AS "upper", CAST(nrt AS DOUBLE) AS "lower" FROM nrt UNION ALL
  SELECT i + 2, CASE WHEN i = 0 THEN nrt ELSE nrt * pow(30.0 / nrt, i / 29.0) END,
  CASE WHEN i = 28 THEN 30.0 ELSE nrt * pow(30.0 / nrt, (i + 1) / 29.0) END
  FROM nrt, (SELECT unnest(generate_series(0, 28)) AS i)""",
    "aedges": """SELECT n, m + 1 AS class, 3 - pow(2, (n - m) / CAST(n AS DOUBLE)) AS "lower",
  CASE WHEN m = n - 1 THEN 9.0 ELSE 3 - pow(2, (n - m - 1) / CAST(n AS DOUBLE)) END AS "upper"
  FROM (SELECT n, unnest(generate_series(0, n - 1)) AS m FROM (VALUES (30), (254)) v(n))""",
    "cal": """SELECT d.*, CASE WHEN t1_distance < 30 THEN 0 ELSE e.class END AS risk_class
  FROM dist d LEFT JOIN bedges e ON t1_distance >= e."lower" AND (e."upper" IS NULL OR t1_distance < e."upper")""",
    "cnf": """SELECT d.*, CASE WHEN t2_distance < 30 THEN 0 ELSE e.class END AS risk_class
  FROM dist d LEFT JOIN bedges e ON t2_distance >= e."lower" AND (e."upper" IS NULL OR t2_distance < e."upper")""",
    "vp": """SELECT d.*, CASE WHEN t3_distance < 30 THEN 0 ELSE e.class END AS risk_class
  FROM dist d LEFT JOIN bedges e ON t3_distance >= e."lower" AND (e."upper" IS NULL OR t3_distance < e."upper")""",
    "calr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM cal",
    "cnfr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM cnf",
    "vpr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM vp",
    "freq": """SELECT region_id, count(*) FILTER (t1t2_deforestation = 1) AS defor_px, count(*) AS area_px,
  count(*) FILTER (t1t2_deforestation = 1) / CAST(count(*) AS DOUBLE) AS rel_freq
  FROM calr WHERE region_id IS NOT NULL GROUP BY region_id""",
    "hrpfreq": """SELECT region_id, count(*) AS area_px,
  count(*) FILTER (hrp_deforestation = 1) / CAST(count(*) AS DOUBLE) AS rel_freq
  FROM calr WHERE region_id IS NOT NULL GROUP BY region_id""",
    # Alternative model: rescaled potentials and their classes for 30 and 254 classes.
    "resc": """SELECT dm.*, 1 + etp_cal / (SELECT max(etp_cal) FROM px) AS v_cal, 1 + etp_cnf / (SELECT max(etp_cnf) FROM px) AS v_cnf
  FROM dm""",
    "acal": """SELECT e.n, d.*, CASE WHEN t1_forest IS NULL THEN NULL WHEN t1_forest = 1 THEN e.class ELSE 0 END AS risk_class
  FROM resc d JOIN aedges e ON v_cal >= e."lower" AND v_cal < e."upper" """,
    "acnf": """SELECT e.n, d.*, CASE WHEN t2_forest IS NULL THEN NULL WHEN t2_forest = 1 THEN e.class ELSE 0 END AS risk_class
  FROM resc d JOIN aedges e ON v_cnf >= e."lower" AND v_cnf < e."upper" """,
    "ahrp": "SELECT * FROM acal",
    "avp": """SELECT e.n, d.*, CASE WHEN t3_forest IS NULL THEN NULL WHEN t3_forest = 1 THEN e.class ELSE 0 END AS risk_class
  FROM resc d JOIN aedges e ON v_cnf >= e."lower" AND v_cnf < e."upper" """,
    "acalr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM acal",
    "acnfr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM acnf",
    "avpr": "SELECT *, CASE WHEN risk_class > 0 THEN risk_class * 1000 + division END AS region_id FROM avp",
}


def gap_tables(name: str, fit: str, loss: str, wanted: str) -> dict[str, str]:
    """Fine regions fitted on ``fit`` and wanted for ``wanted``: fitted rows, missing ones, zone averages, all rows."""
    return {
        f"{name}fit": f"""SELECT region_id, count(*) FILTER ({loss} = 1) AS defor_px, count(*) AS area_px,
  count(*) FILTER ({loss} = 1) / CAST(count(*) AS DOUBLE) AS rel_freq
  FROM {fit} WHERE n = 254 AND region_id IS NOT NULL GROUP BY region_id""",
        f"{name}miss": f"""SELECT DISTINCT region_id FROM {wanted} WHERE n = 254 AND region_id IS NOT NULL
  AND region_id NOT IN (SELECT region_id FROM {name}fit)""",
        f"{name}zones": f"""SELECT region_id // 1000 AS zone, sum(area_px * rel_freq) AS zone_defor, sum(area_px) AS zone_area,
  sum(area_px * rel_freq) / sum(area_px) AS zone_freq FROM {name}fit
  WHERE region_id // 1000 IN (SELECT region_id // 1000 FROM {name}miss) GROUP BY 1""",
        f"{name}full": f"""SELECT region_id, defor_px, area_px, rel_freq, false AS imputed FROM {name}fit UNION ALL
  SELECT region_id, CAST(round(coalesce(zone_defor, 0)) AS BIGINT), CAST(coalesce(zone_area, 0) AS BIGINT),
  coalesce(zone_freq, 0.0), true FROM {name}miss LEFT JOIN {name}zones ON zone = region_id // 1000""",
    }


# A gap: fitted on the fine regions of CNF, wanted for those of CAL; and the other way round.
TABLES |= gap_tables("gap", "acnfr", "t2t3_deforestation", "acalr")
for period, name, potential in ((1, "swapfit", "v_cnf"), (2, "swapwant", "v_cal")):
    TABLES[name] = f"""SELECT n, d.*, e.class * 1000 + division AS region_id FROM resc d
  JOIN aedges e ON {potential} >= e."lower" AND {potential} < e."upper" WHERE t{period}_forest = 1"""
TABLES |= gap_tables("stage", "swapfit", "t1t2_deforestation", "swapwant")


def adjustment_tables(prefix: str, counts: str, total: str) -> dict[str, str]:
    """Five unrolled rounds of the capped rescaling over a region table.

    ``counts`` yields ``region_id, n_px, d``; ``total`` the actual hectares.
    """
    out = {f"{prefix}0": counts, f"{prefix}t": f"SELECT {total} AS ad"}
    for i in range(6):
        out[f"{prefix}m{i}"] = (
            f"SELECT {i} AS iter, sum(n_px * d) AS md, (SELECT ad FROM {prefix}t) AS ad, "
            f"(SELECT ad FROM {prefix}t) / sum(n_px * d) AS ar FROM {prefix}{i}"
        )
        if i < 5:
            out[f"{prefix}{i + 1}"] = (
                f"SELECT region_id, n_px, CASE WHEN ar > 1.00001 OR ar < 1 / 1.00001 THEN least(d * ar, {HA}) ELSE d END AS d "
                f"FROM {prefix}{i}, {prefix}m{i}"
            )
    steps = " UNION ALL ".join(f"SELECT * FROM {prefix}m{i}" for i in range(6))
    out[f"{prefix}s"] = steps
    out[f"{prefix}log"] = (
        f"SELECT iter, md, ad, ar, (SELECT ar BETWEEN 1 / 1.00001 AND 1.00001 FROM {prefix}m5) AS converged FROM {prefix}s "
        f"WHERE iter <= coalesce((SELECT min(iter) FROM {prefix}s WHERE ar BETWEEN 1 / 1.00001 AND 1.00001), 5)"
    )
    return out


TABLES.update(
    adjustment_tables(
        "ac",
        f"""SELECT region_id, n_px, coalesce(rel_freq, 0.0) * {HA} AS d FROM
  (SELECT region_id, count(*) AS n_px FROM cnfr WHERE region_id IS NOT NULL GROUP BY region_id) LEFT JOIN freq USING (region_id)""",
        f"(SELECT count(*) FILTER (t2t3_deforestation = 1) * {HA} FROM dm)",
    )
)
# The benchmark regions of VP all occur in HRP or belong to a zone that does.
TABLES.update(
    {
        "vpmiss": """SELECT DISTINCT region_id FROM vpr WHERE region_id IS NOT NULL
  AND region_id NOT IN (SELECT region_id FROM hrpfreq)""",
        "vpfull": """SELECT region_id, rel_freq FROM hrpfreq UNION ALL SELECT region_id, coalesce(f, 0.0) FROM vpmiss
  LEFT JOIN (SELECT region_id // 1000 AS zone, sum(area_px * rel_freq) / sum(area_px) AS f FROM hrpfreq GROUP BY 1)
  ON zone = region_id // 1000""",
    }
)


def vp_total(share: int) -> str:
    return f"(SELECT count(*) FILTER (hrp_deforestation = 1) * {HA} / {share} FROM dm)"


VP_COUNTS = f"""SELECT region_id, n_px, coalesce(rel_freq, 0.0) * {HA} AS d FROM
  (SELECT region_id, count(*) AS n_px FROM vpr WHERE region_id IS NOT NULL GROUP BY region_id) LEFT JOIN vpfull USING (region_id)"""
TABLES.update(adjustment_tables("av", VP_COUNTS, vp_total(2)))
TABLES.update(adjustment_tables("aw", VP_COUNTS, vp_total(4)))


def alternative_fit(name: str, loss: str) -> dict[str, str]:
    return {
        name: f"""SELECT region_id, count(*) AS area_px, count(*) FILTER ({loss} = 1) / CAST(count(*) AS DOUBLE) AS rel_freq
  FROM acalr WHERE n = 30 AND region_id IS NOT NULL GROUP BY region_id"""
    }


def alternative_prediction(name: str, fit: str, pixels: str) -> dict[str, str]:
    """Predicted regions with the zone average where fitting never saw the region."""
    return {
        f"{name}z": f"SELECT region_id // 1000 AS zone, sum(area_px * rel_freq) / sum(area_px) AS f FROM {fit} GROUP BY 1",
        f"{name}c": f"""SELECT region_id, n_px, coalesce(rel_freq, f, 0.0) * {HA} AS d FROM
  (SELECT region_id, count(*) AS n_px FROM {pixels} WHERE n = 30 AND region_id IS NOT NULL GROUP BY region_id)
  LEFT JOIN {fit} USING (region_id) LEFT JOIN {name}z ON zone = region_id // 1000""",
    }


TABLES.update(alternative_fit("afc", "t1t2_deforestation"))
TABLES.update(alternative_fit("afh", "hrp_deforestation"))
TABLES.update(alternative_prediction("apc", "afc", "acnfr"))
TABLES.update(alternative_prediction("apv", "afh", "avpr"))
TABLES.update(
    adjustment_tables("ax", "SELECT * FROM apcc", f"(SELECT count(*) FILTER (t2t3_deforestation = 1) * {HA} FROM dm)")
)
TABLES.update(adjustment_tables("ay", "SELECT * FROM apvc", vp_total(4)))

TABLES.update(
    {
        # Connected parts of the second-period forest, by transitive closure.
        "forestpx": "SELECT r, c, r * 128 + c AS pos FROM dm WHERE t2_forest = 1",
        "contact": """SELECT a.pos AS a, b.pos AS b FROM forestpx a JOIN forestpx b ON abs(a.r - b.r) + abs(a.c - b.c) = 1""",
        "reach": """SELECT pos AS start, pos AS here FROM forestpx UNION SELECT start, b FROM reach JOIN contact ON a = here""",
        # Evaluation cells of 16 pixels.
        "cellpx": """SELECT *, (2 * r + 17) // 32 AS cell_r, (2 * c + 17) // 32 AS cell_c FROM dm
  WHERE (2 * r + 17) // 32 <= ((SELECT max(r) FROM px) + 16) // 16 - 1 AND (2 * c + 17) // 32 <= 7""",
        "adjpx": "SELECT cnfr.*, CASE WHEN risk_class IS NOT NULL THEN coalesce(ac5.d, 0.0) END AS adjusted FROM cnfr LEFT JOIN ac5 USING (region_id)",
        "adjcell": """SELECT *, (2 * r + 17) // 32 AS cell_r, (2 * c + 17) // 32 AS cell_c FROM adjpx
  WHERE (2 * r + 17) // 32 <= ((SELECT max(r) FROM px) + 16) // 16 - 1 AND (2 * c + 17) // 32 <= 7""",
        "cells": f"""SELECT row_number() OVER (ORDER BY cell_r, cell_c) AS cell_id, cell_r, cell_c, mask_px * {HA} AS area_ha,
  loss_px * {HA} AS actual_ha, pred_ha, pred_ha - loss_px * {HA} AS residual_ha FROM
  (SELECT cell_r, cell_c, count(*) FILTER (area = 1) AS area_px, count(*) FILTER (mask = 1) AS mask_px,
   coalesce(sum(t2t3_deforestation) FILTER (mask = 1), 0) AS loss_px, coalesce(sum(adjusted) FILTER (mask = 1), 0) AS pred_ha,
   max(count(*) FILTER (area = 1)) OVER () AS top FROM adjcell GROUP BY cell_r, cell_c)
  WHERE area_px / CAST(top AS DOUBLE) > 0.999 AND mask_px > 0""",
        "sample": """SELECT * FROM cells WHERE actual_ha > 0.01 OR pred_ha > 0.01
  OR (SELECT count(*) FROM cells WHERE actual_ha > 0.01 OR pred_ha > 0.01) < 2""",
        # Allocation.
        "al": f"""SELECT r, c, fcbm AS lulc, division AS region, regionkey AS area, etp_cal * ({HA} / 5) AS density,
  etp_cnf * 11000.0 - 1000.0 AS etp FROM px""",
        "alt": f"""SELECT area, region, sum(density) * 1.5 AS target_ha,
  CAST(ceil(sum(density) * 1.5 / {HA} - 1e-9) AS BIGINT) AS target_px FROM al GROUP BY area, region""",
        "ale": "SELECT *, row_number() OVER (PARTITION BY area, region ORDER BY etp DESC, r, c) AS k FROM al WHERE lulc IN (5, 8) AND etp > 0",
        "alf": "SELECT ale.*, k <= target_px AS first_pass FROM ale JOIN alt USING (area, region)",
        "alr": f"""SELECT area, region, target_ha, target_px, coalesce(a, 0) AS available_px, least(target_px, coalesce(a, 0)) AS allocated_px,
  least(target_px, coalesce(a, 0)) * {HA} AS allocated_ha,
  greatest(0, target_ha - least(target_px, coalesce(a, 0)) * {HA}) AS deficit_ha
  FROM alt LEFT JOIN (SELECT area, region, count(*) AS a FROM ale GROUP BY area, region) USING (area, region)""",
        "ald": f"""SELECT area, sum(deficit_ha) AS deficit_ha,
  CAST(greatest(0, ceil(sum(deficit_ha) / {HA} - 1e-9)) AS BIGINT) AS deficit_px FROM alr GROUP BY area""",
        "al2": """SELECT r, c FROM (SELECT r, c, deficit_px, row_number() OVER (PARTITION BY area ORDER BY etp DESC, r, c) AS k
  FROM alf JOIN ald USING (area) WHERE NOT first_pass) WHERE k <= deficit_px""",
        "alout": """SELECT al.*, CAST(coalesce(first_pass, false) AS INT) AS first_pass,
  CAST(coalesce(first_pass, false) OR al2.r IS NOT NULL AS INT) AS allocated
  FROM al LEFT JOIN (SELECT r, c, first_pass FROM alf) f ON f.r = al.r AND f.c = al.c LEFT JOIN al2 ON al2.r = al.r AND al2.c = al.c""",
        # The same with the density as score.
        "bf": """SELECT b.*, k <= target_px AS first_pass FROM
  (SELECT *, row_number() OVER (PARTITION BY area, region ORDER BY density DESC, r, c) AS k FROM al WHERE lulc IN (5, 8) AND density > 0) b
  JOIN alt USING (area, region)""",
        "bd": f"""SELECT area, CAST(greatest(0, ceil(sum(d) / {HA} - 1e-9)) AS BIGINT) AS deficit_px FROM
  (SELECT area, greatest(0, target_ha - least(target_px, coalesce(a, 0)) * {HA}) AS d FROM alt LEFT JOIN
   (SELECT area, region, count(*) AS a FROM bf GROUP BY area, region) USING (area, region)) GROUP BY area""",
        "b2": """SELECT r, c FROM (SELECT r, c, deficit_px, row_number() OVER (PARTITION BY area ORDER BY density DESC, r, c) AS k
  FROM bf JOIN bd USING (area) WHERE NOT first_pass) WHERE k <= deficit_px""",
        # Opening of block strata.
        "op0": "SELECT r, c, r // 20 AS area, c // 24 AS region, (r // 20) * 100000 + (c // 24) * 100 + 1 AS stratum FROM px WHERE fcbm >= 5",
        "op1": """SELECT o.* FROM op0 o JOIN op0 n ON n.stratum = o.stratum AND abs(n.r - o.r) + abs(n.c - o.c) = 1
  GROUP BY ALL HAVING count(*) = 4""",
        "op2": """SELECT DISTINCT o.* FROM op0 o JOIN op1 n ON n.stratum = o.stratum AND abs(n.r - o.r) + abs(n.c - o.c) <= 1""",
        "ot": f"""SELECT area, region, sum(density) AS target_ha, CAST(ceil(sum(density) / {HA} - 1e-9) AS BIGINT) AS target_px FROM
  (SELECT r // 20 AS area, c // 24 AS region, etp_cal * ({HA} / 5) AS density FROM px) GROUP BY area, region""",
        "oe": """SELECT o.*, px.etp_cnf * 11000.0 - 1000.0 AS etp,
  row_number() OVER (PARTITION BY o.area, o.region ORDER BY px.etp_cnf * 11000.0 - 1000.0 DESC, o.r, o.c) AS k
  FROM op3 o JOIN px ON px.r = o.r AND px.c = o.c""",
        # Faulty class table.
        "ct": """SELECT p_partkey AS part, CASE WHEN p_size = 1 THEN 'n/a' WHEN p_size = 2 THEN '-' || p_partkey
  WHEN p_size = 3 THEN p_partkey || '.5' ELSE ' ' || (p_partkey % 997) END AS id, p_brand AS label,
  CASE WHEN p_size = 50 THEN p_brand || '-x' ELSE p_brand END AS label_reclass,
  CASE WHEN p_size = 7 THEN NULL ELSE p_type END AS category, CAST(p_size * 6 AS VARCHAR) AS r,
  CASE WHEN p_size = 9 THEN 'red' ELSE CAST(p_size AS VARCHAR) END AS g, CAST(p_size - 3 AS VARCHAR) AS b,
  CASE WHEN p_size < 10 THEN 'YES' WHEN p_size < 40 THEN 'no' ELSE 'maybe' END AS confusion FROM part""",
        "gt": """SELECT 'orders' AS layer, max(o_orderkey) // 128 + 1 AS height, 30.0 AS px, 'EPSG:32618' AS crs FROM orders UNION ALL
  SELECT 'lineitem', max(l_orderkey) // 128 + 1, 30.0, 'EPSG:32618' FROM lineitem UNION ALL
  SELECT 'customer', max(c_custkey) // 128 + 1, 30.0, 'EPSG:32619' FROM customer UNION ALL
  SELECT 'part', max(p_partkey) // 128 + 1, 10.0, 'EPSG:4326' FROM part""",
        "ext": """SELECT event_type || '-' || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS layer, min(user_id) AS min_x,
  min(value) AS min_y, max(user_id) AS max_x, max(value) AS max_y FROM events GROUP BY 1""",
        "pts": "SELECT count(*) + o_custkey % 97 AS x, sum(o_totalprice) AS y FROM orders GROUP BY o_custkey",
        "dia": f"""SELECT s_suppkey AS seq, s_suppkey * 37 % 128 + 0.2 AS cx,
  s_suppkey * 53 % (SELECT max(r) + 1 FROM px) + 0.25 AS cy, 3.0 + floor((s_acctbal + 1000.0) / 1000.0) AS half FROM supplier""",
        "dates": """SELECT o_orderkey, o_orderkey % 5 AS layout, CAST(o_orderdate AS DATE) AS d, s FROM orders
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
        "years": """SELECT o_orderkey, CASE WHEN layout <= 2 THEN year(d) + (dayofyear(d) - 1) / dayofyear(make_date(year(d), 12, 31))
  WHEN layout = 3 THEN CAST(year(d) AS DOUBLE) END AS ordered,
  year(s) + (dayofyear(s) - 1) / dayofyear(make_date(year(s), 12, 31)) AS shipped FROM dates""",
    }
)
TABLES["op3"] = TABLES["op2"]


def statement(body: str) -> str:
    """``body`` with the shared tables it needs, directly or indirectly."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in re.findall(r"[a-z][a-z0-9_]*", text):
            if name in TABLES and name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                collect(TABLES[name])

    collect(body)
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(needed):
            if other != name and re.search(rf"(FROM|JOIN|,)\s+{other}\b", TABLES[name]):
                place(other)
        ordered.append(name)

    for name in sorted(needed):
        place(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered) + "\n" + body




def evaluation_tables(name: str, pixels: str, values: str, value: str, loss: str) -> None:
    """Cells and metrics of one phase: ``value`` by region from ``values``, ``loss`` from the layer."""
    TABLES[f"{name}cell"] = f"""SELECT cell_r, cell_c, count(*) FILTER (area = 1) AS area_px, count(*) FILTER (mask = 1) AS mask_px,
  coalesce(sum({loss}) FILTER (mask = 1), 0) * {HA} AS x,
  coalesce(sum(CASE WHEN risk_class IS NOT NULL THEN coalesce({value}, 0.0) END) FILTER (mask = 1), 0) AS y,
  max(count(*) FILTER (area = 1)) OVER () AS top FROM
  (SELECT p.*, (2 * r + 17) // 32 AS cell_r, (2 * c + 17) // 32 AS cell_c, {value} FROM {pixels} p LEFT JOIN {values} USING (region_id))
  WHERE cell_r <= ((SELECT max(r) FROM px) + 16) // 16 - 1 AND cell_c <= 7 GROUP BY cell_r, cell_c"""
    TABLES[f"{name}all"] = f"SELECT x, y FROM {name}cell WHERE area_px / CAST(top AS DOUBLE) > 0.999 AND mask_px > 0"
    TABLES[f"{name}use"] = f"""SELECT * FROM {name}all WHERE x > 0.01 OR y > 0.01
  OR (SELECT count(*) FROM {name}all WHERE x > 0.01 OR y > 0.01) < 2"""


TABLES["fitbc"] = f"SELECT region_id, rel_freq * {HA} AS v FROM freq"
TABLES["fitac"] = f"SELECT region_id, rel_freq * {HA} AS v FROM afc"
TABLES["prebc"] = "SELECT region_id, d AS v FROM ac5"
TABLES["preac"] = "SELECT region_id, d AS v FROM ax5"
TABLES["acal30"] = "SELECT * FROM acalr WHERE n = 30"
TABLES["acnf30"] = "SELECT * FROM acnfr WHERE n = 30"
EVALUATIONS = {
    "ebc": ("benchmark", "CAL", "calr", "fitbc", "t1t2_deforestation"),
    "ebn": ("benchmark", "CNF", "cnfr", "prebc", "t2t3_deforestation"),
    "eac": ("alternative", "CAL", "acal30", "fitac", "t1t2_deforestation"),
    "ean": ("alternative", "CNF", "acnf30", "preac", "t2t3_deforestation"),
}
for _name, (_model, _phase, _pixels, _values, _loss) in EVALUATIONS.items():
    evaluation_tables(_name, _pixels, _values, "v", _loss)

POSITION = 'r AS "row", c AS col'

BODIES: dict[str, str] = {
    "coregistered_layers": f"SELECT {POSITION}, CASE WHEN fcbm >= 6 THEN 1 END AS lost, division FROM px",
    "tile_layer": """SELECT r // 16 AS tile_r, c // 16 AS tile_c, 256 AS n_cells,
  CAST(sum(CASE WHEN fcbm >= 6 THEN fcbm ELSE 255 END) + (256 - count(*)) * 255 AS BIGINT) AS total,
  coalesce(max(CASE WHEN r % 16 = 0 AND c % 16 = 0 AND fcbm >= 6 THEN fcbm END), 255) AS first_cell,
  coalesce(max(CASE WHEN r % 16 = 15 AND c % 16 = 15 AND fcbm >= 6 THEN fcbm END), 255) AS last_cell
  FROM px GROUP BY 1, 2""",
    "tile_layer_values": """SELECT tile_r, tile_c, CAST(pos AS INTEGER) AS pos, coalesce(v, 255) AS v
  FROM (SELECT DISTINCT r // 16 AS tile_r, c // 16 AS tile_c FROM px) CROSS JOIN range(256) x(pos)
  LEFT JOIN (SELECT r // 16 AS tile_r, c // 16 AS tile_c, (r % 16) * 16 + c % 16 AS pos, fcbm AS v FROM px WHERE fcbm >= 6) USING (tile_r, tile_c, pos)""",
    "tile_pixels": f"SELECT {POSITION}, fcbm AS v FROM px WHERE fcbm >= 6",
    "encoded_layer": f"""SELECT {POSITION}, CASE WHEN etp_cal > 0.2 THEN CAST(floor(least(etp_cal * 300, 255) + 0.5) AS INT) ELSE 255 END AS v
  FROM px""",
    "combined_mask": f"SELECT {POSITION}, mask FROM mk",
    "area_mask": f"SELECT {POSITION}, CASE WHEN aoi = 2 THEN 1 ELSE 0 END AS area FROM px",
    "masked_change": f"SELECT {POSITION}, fcbm FROM mk",
    "derived_maps": f"""SELECT {POSITION}, hrp_deforestation, t1_forest, t1_non_forest, t1t2_deforestation, t2_forest, t2_non_forest,
  t2t3_deforestation, t3_forest, t3_non_forest FROM dm""",
    "applied_masks": f"""SELECT {POSITION}, CASE WHEN fcbm IS NOT NULL THEN division ELSE 0 END AS to_zero,
  CASE WHEN fcbm IS NOT NULL THEN division END AS to_null, CASE WHEN fcbm IS NOT NULL THEN division ELSE -9999 END AS to_number,
  CASE WHEN mask <> 0 THEN division ELSE 0 END AS by_zero_mask, CASE WHEN fcbm IS NOT NULL THEN division END AS by_template FROM mk""",
    "review_map": f"""SELECT {POSITION}, CASE WHEN t2t3_deforestation = 1 THEN 3 WHEN t2t3_deforestation = 0 AND t1t2_deforestation = 1 THEN 2
  WHEN t2t3_deforestation = 0 AND t1t2_deforestation = 0 AND t1_forest = 1 THEN 1 ELSE t1_forest END AS review FROM dm""",
    "map_algebra_conditions": f"""SELECT {POSITION}, CASE WHEN fcbm = 8 THEN 1 WHEN fcbm IS NULL THEN NULL ELSE 0 END AS lost,
  CASE WHEN fcbm IS NOT NULL THEN division END AS valid, CASE WHEN fcbm IN (6, 7) THEN 1 ELSE 0 END AS either,
  CASE WHEN etp_cal > 0.5 THEN division ELSE 0 END AS product,
  CASE WHEN fcbm IS DISTINCT FROM 5 AND etp_cal <= 0.5 THEN 2 ELSE 1 END AS not_five FROM mk""",
    "map_algebra_functions": f"""SELECT {POSITION}, round(ln(etp_cal), 9) AS v_ln, round(log10(etp_cal), 9) AS v_log10,
  CASE WHEN etp_cal >= 0.5 THEN round(sqrt(greatest(etp_cal - 0.5, 0)), 9) END AS v_sqrt, round(etp_cal * etp_cal, 9) AS v_square,
  round(sin(etp_cal) + cos(etp_cal) - tan(etp_cal), 9) AS v_trig,
  round(asin(etp_cal) + acos(etp_cal) * atan(etp_cal), 9) AS v_arc, round(abs(-etp_cal), 9) AS v_abs,
  ceil(etp_cal * 10) - floor(etp_cal * 10) AS v_round,
  CASE WHEN fcbm <> 5 THEN round(etp_cal / (CASE WHEN fcbm = 5 THEN 1 ELSE fcbm - 5 END), 9) END AS v_ratio,
  round(pow(etp_cal, 2) + 1, 9) AS v_power FROM px""",
    "map_algebra_no_numbers": f"""SELECT {POSITION}, CASE WHEN fcbm >= 7 THEN 1 ELSE 0 END AS root_above,
  CASE WHEN fcbm >= 5 THEN 1 ELSE 0 END AS root_equal, CASE WHEN fcbm >= 5 THEN 0 ELSE 1 END AS root_missing,
  CASE WHEN fcbm = 5 THEN CASE WHEN etp_cal > 0 THEN 1 ELSE 0 END
    WHEN etp_cal / nullif(fcbm - 5, 0) > 0.5 THEN 1 ELSE 0 END AS ratio_above,
  CASE WHEN fcbm = 5 THEN 1 ELSE 0 END AS log_below,
  CASE WHEN fcbm >= 5 THEN ceil(sqrt(greatest(fcbm - 5, 0))) END AS root_up, round(etp_cal, 9) AS huge_up FROM mk""",
    "map_algebra_layer_scalars": f"""SELECT {POSITION}, round((etp_cal - lo) / (hi - lo), 6) AS stretched
  FROM px, (SELECT min(etp_cal) AS lo, max(etp_cal) AS hi FROM px)""",
    "storage_types": f"""SELECT {POSITION}, CAST(least(greatest(w, 0), 255) AS INT) AS as_uint8,
  CAST(least(greatest(w, -32768), 32767) AS INT) AS as_int16, CAST(w AS INT) AS as_int32 FROM
  (SELECT r, c, CASE WHEN v < 0 THEN -floor(-v + 0.5) ELSE floor(v + 0.5) END AS w FROM
   (SELECT r, c, (etp_cal - 0.5) * 100000 AS v FROM px))""",
    "rescaled_potential": f"SELECT {POSITION}, round(v_cal, 6) AS rescaled FROM resc",
    "euclidean_distance": f"""SELECT {POSITION}, round(t1_distance, 6) AS t1_distance, round(t2_distance, 6) AS t2_distance,
  round(t3_distance, 6) AS t3_distance FROM dist""",
    "stored_layer_distance": f"SELECT {POSITION}, round(30.0 * sqrt(d2), 6) AS distance FROM nearest WHERE l = 4",
    "euclidean_distance_tiled": f"SELECT {POSITION}, round(30.0 * sqrt(d2), 6) AS distance FROM nearest WHERE l = 4",
    "distance_histogram": "SELECT bin, bin_start, bin_end, n FROM hist",
    "cumulative_share": "SELECT bin, cum_n, round(cum_share, 6) AS cum_share FROM cums",
    "price_histogram": """SELECT s.bin, lo + s.bin * 2500 AS bin_start, lo + (s.bin + 1) * 2500 AS bin_end, coalesce(h.n, 0) AS n FROM
  (SELECT min(l_extendedprice) AS lo, greatest(1, CAST(ceil((max(l_extendedprice) - min(l_extendedprice)) / 2500) AS BIGINT)) AS nb FROM lineitem) b,
  (SELECT unnest(generate_series(0, (SELECT greatest(1, CAST(ceil((max(l_extendedprice) - min(l_extendedprice)) / 2500) AS BIGINT)) - 1 FROM lineitem))) AS bin) s
  LEFT JOIN (SELECT least(CAST(floor((l_extendedprice - lo) / 2500) AS BIGINT), nb - 1) AS bin, count(*) AS n FROM lineitem,
   (SELECT min(l_extendedprice) AS lo, greatest(1, CAST(ceil((max(l_extendedprice) - min(l_extendedprice)) / 2500) AS BIGINT)) AS nb FROM lineitem)
   GROUP BY 1) h ON h.bin = s.bin""",
    "risk_threshold": "SELECT nrt, bin_start, bin_end, round(cum_share, 6) AS cum_share FROM nrt",
    "class_edges": 'SELECT class, round("upper", 6) AS "upper", round("lower", 6) AS "lower" FROM bedges',
    "geo_classes_benchmark": f"SELECT {POSITION}, risk_class FROM cal",
    "geo_classes_alternative": f"SELECT {POSITION}, risk_class FROM acal WHERE n = 30",
    "region_ids": f"SELECT {POSITION}, region_id, region_id // 1000 AS zone FROM acalr WHERE n = 254",
    "frequency_table": "SELECT region_id, defor_px, area_px, round(rel_freq, 6) AS rel_freq FROM freq",
    "frequency_with_background": """SELECT region_id, defor_px, area_px, round(rel_freq, 6) AS rel_freq FROM freq
  UNION ALL SELECT 0, 0, 0, 0.0""",
    "frequency_table_alternative": """SELECT region_id, count(*) FILTER (t1t2_deforestation = 1) AS defor_px, count(*) AS area_px,
  round(count(*) FILTER (t1t2_deforestation = 1) / CAST(count(*) AS DOUBLE), 6) AS rel_freq FROM acalr
  WHERE n = 30 AND region_id IS NOT NULL GROUP BY region_id""",
    "merged_counts": """SELECT region_id, coalesce(defor_px, 0) AS defor_px, coalesce(area_px, 0) AS area_px FROM
  (SELECT region_id, count(*) AS defor_px FROM acalr WHERE n = 254 AND region_id IS NOT NULL AND t1t2_deforestation = 1 GROUP BY 1) a
  FULL JOIN (SELECT region_id, count(*) AS area_px FROM acnfr WHERE n = 254 AND region_id IS NOT NULL GROUP BY 1) b USING (region_id)""",
    "region_total": "SELECT count(DISTINCT region_id) AS n_regions FROM acalr WHERE n = 254",
    "missing_regions": "SELECT region_id FROM gapmiss",
    "unseen_zones": """SELECT DISTINCT region_id // 1000 AS zone FROM gapmiss
  WHERE region_id // 1000 NOT IN (SELECT region_id // 1000 FROM gapfit)""",
    "zone_averages": "SELECT zone, round(zone_defor, 6) AS zone_defor, zone_area, round(zone_freq, 6) AS zone_freq FROM gapzones",
    "imputed_frequency": "SELECT region_id, defor_px, area_px, round(rel_freq, 6) AS rel_freq, imputed FROM gapfull",
    "frequency_map": f"""SELECT {POSITION}, CASE WHEN t1t2_deforestation IS NOT NULL THEN round(coalesce(rel_freq, 0.0), 6) END AS rel_freq
  FROM calr LEFT JOIN freq USING (region_id)""",
    "density_fit": f"""SELECT {POSITION}, CASE WHEN risk_class IS NOT NULL THEN round(coalesce(rel_freq, 0.0) * {HA}, 6) END AS density
  FROM calr LEFT JOIN freq USING (region_id)""",
    "density_predict": f"""SELECT {POSITION}, CASE WHEN risk_class IS NOT NULL THEN round(coalesce(rel_freq, 0.0) * {HA}, 6) END AS density
  FROM acalr LEFT JOIN gapfull USING (region_id) WHERE n = 254""",
    "adjustment_ratio": "SELECT round(md, 6) AS md, round(ad, 6) AS ad, round(ar, 6) AS ar FROM acm0",
    "adjustment_log": "SELECT iter, round(md, 6) AS md, round(ad, 6) AS ad, round(ar, 6) AS ar, converged FROM aclog",
    "adjustment_log_expected": "SELECT iter, round(md, 6) AS md, round(ad, 6) AS ad, round(ar, 6) AS ar, converged FROM avlog",
    "adjusted_density": f"SELECT {POSITION}, round(adjusted, 6) AS adjusted FROM adjpx",
    "annual_density": f"SELECT {POSITION}, round(adjusted / 10, 8) AS adjusted FROM adjpx",
    "eval_cells": "SELECT cell_r, cell_c, count(*) AS area_px FROM cellpx WHERE area = 1 GROUP BY 1, 2",
    "edge_filter": """SELECT cell_r, cell_c, area_px FROM (SELECT cell_r, cell_c, count(*) AS area_px, max(count(*)) OVER () AS top
  FROM cellpx WHERE area = 1 GROUP BY 1, 2) WHERE area_px / CAST(top AS DOUBLE) > 0.999""",
    "zonal_sums": """SELECT cell_r, cell_c, round(coalesce(sum(etp_cal), 0), 6) AS potential,
  CAST(coalesce(sum(hrp_deforestation), 0) AS DOUBLE) AS losses FROM cellpx GROUP BY 1, 2""",
    "evaluation_cells": """SELECT cell_id, cell_r, cell_c, round(area_ha, 6) AS area_ha, round(actual_ha, 6) AS actual_ha,
  round(pred_ha, 6) AS pred_ha, round(residual_ha, 6) AS residual_ha FROM cells""",
    "regression_cells": "SELECT cell_id, round(actual_ha, 6) AS actual_ha, round(pred_ha, 6) AS pred_ha FROM sample",
    "evaluation_statistics": """SELECT count(*) AS n, round(regr_slope(pred_ha, actual_ha), 6) AS ols_slope,
  round(regr_intercept(pred_ha, actual_ha), 6) AS ols_intercept, round(pow(corr(actual_ha, pred_ha), 2), 6) AS r2,
  round(median(abs(actual_ha - pred_ha)), 6) AS medae, round(median(abs(actual_ha - pred_ha)) / 24 * 100, 6) AS medae_pct,
  round(max(s), 6) AS ts_slope, round(median(pred_ha) - max(s) * median(actual_ha), 6) AS ts_intercept,
  round(min(actual_ha), 6) AS min_actual, round(max(actual_ha), 6) AS max_actual, round(avg(actual_ha), 6) AS avg_actual,
  round(stddev_pop(actual_ha), 6) AS sd_actual, round(min(pred_ha), 6) AS min_pred, round(max(pred_ha), 6) AS max_pred,
  round(avg(pred_ha), 6) AS avg_pred, round(stddev_pop(pred_ha), 6) AS sd_pred FROM sample,
  (SELECT median((b.pred_ha - a.pred_ha) / (b.actual_ha - a.actual_ha)) AS s FROM sample a JOIN sample b ON b.actual_ha > a.actual_ha)""",
    "median_and_slope_distributed": """SELECT count(*) AS n, round(median(y), 3) AS med_y, round((SELECT median((b.y - a.y) / (b.x - a.x))
  FROM pts a JOIN pts b ON b.x > a.x), 3) AS ts_slope FROM pts""",
    "evaluation_cells_strict": f"""SELECT row_number() OVER (ORDER BY cell_r, cell_c) AS cell_id, cell_r, cell_c, round(mask_px * {HA}, 6) AS area_ha,
  round(loss_px * {HA}, 6) AS actual_ha, round(pred_ha, 6) AS pred_ha, round(pred_ha - loss_px * {HA}, 6) AS residual_ha FROM
  (SELECT cell_r, cell_c, count(*) FILTER (area = 1) AS area_px, count(*) FILTER (mask = 1) AS mask_px,
   coalesce(sum(hrp_deforestation) FILTER (mask = 1), 0) AS loss_px, coalesce(sum(etp_cal * {HA}) FILTER (mask = 1), 0) AS pred_ha,
   max(count(*) FILTER (area = 1)) OVER () AS top FROM cellpx GROUP BY cell_r, cell_c)
  WHERE area_px / CAST(top AS DOUBLE) > 0.999 AND mask_px > 0""",
    "evaluation_cells_of_parts": f"""SELECT row_number() OVER (ORDER BY cell_r, cell_c) AS cell_id, cell_r, cell_c, round(mask_px * {HA}, 6) AS area_ha,
  round(loss_px * {HA}, 6) AS actual_ha, round(pred_ha, 6) AS pred_ha, round(pred_ha - loss_px * {HA}, 6) AS residual_ha FROM
  (SELECT cell_r, cell_c, count(*) FILTER (mask = 1) AS mask_px, coalesce(sum(hrp_deforestation) FILTER (mask = 1), 0) AS loss_px,
   coalesce(sum(etp_cal * {HA}) FILTER (mask = 1), 0) AS pred_ha FROM cellpx GROUP BY cell_r, cell_c)
  JOIN (SELECT DISTINCT cell_r, cell_c FROM (SELECT cell_r, cell_c, part, count(*) AS n, max(count(*)) OVER () AS top FROM
   (SELECT cell_r, cell_c, CASE WHEN r < 56 THEN (r + c) // 16 ELSE 1000 + (c + 8) // 16 END AS part FROM cellpx
    WHERE area = 1 AND r <> 56 AND NOT (r < 56 AND (r + c) % 16 = 0) AND NOT (r > 56 AND (c + 8) % 16 = 0)) GROUP BY cell_r, cell_c, part)
   WHERE n / CAST(top AS DOUBLE) > 0.999) USING (cell_r, cell_c) WHERE mask_px > 0""",
    "part_coverage": """SELECT cell_r, cell_c, component, count(*) AS area_px FROM cellpx
  JOIN (SELECT start, min(here) AS component FROM reach GROUP BY start) ON start = r * 128 + c GROUP BY 1, 2, 3""",
    "mask_parts": """SELECT component, count(*) AS n_px FROM (SELECT start, min(here) AS component FROM reach GROUP BY start)
  GROUP BY component""",
    "evaluation_stage": " UNION ALL ".join(
        f"""SELECT '{model}' AS model, '{phase}' AS phase, count(*) AS n, round(regr_slope(y, x), 5) AS ols_slope,
  round(pow(corr(x, y), 2), 5) AS r2, round(median(abs(x - y)), 5) AS medae, round(max(s), 5) AS ts_slope,
  round(median(y) - max(s) * median(x), 5) AS ts_intercept FROM {name}use,
  (SELECT median((b.y - a.y) / (b.x - a.x)) AS s FROM {name}use a JOIN {name}use b ON b.x > a.x)"""
        for name, (model, phase, _, _, _) in EVALUATIONS.items()
    ),
    "alloc_targets": "SELECT area, region, round(target_ha, 6) AS target_ha, target_px FROM alt",
    "alloc_report": """SELECT area, region, round(target_ha, 6) AS target_ha, target_px, available_px, allocated_px,
  round(allocated_ha, 6) AS allocated_ha, round(deficit_ha, 6) AS deficit_ha FROM alr""",
    "alloc_deficits": "SELECT area, round(deficit_ha, 6) AS deficit_ha, deficit_px FROM ald",
    "alloc_mask": f"SELECT {POSITION}, first_pass, allocated FROM alout",
    "alloc_mask_by_density": """SELECT al.r AS "row", al.c AS col, CAST(coalesce(first_pass, false) OR b2.r IS NOT NULL AS INT) AS allocated
  FROM al LEFT JOIN (SELECT r, c, first_pass FROM bf) f ON f.r = al.r AND f.c = al.c LEFT JOIN b2 ON b2.r = al.r AND b2.c = al.c""",
    "modified_cover": """SELECT area, region, lulc, CASE WHEN allocated = 1 THEN 0 ELSE lulc END AS modified_lulc, count(*) AS n_px
  FROM alout GROUP BY ALL""",
    "modified_cover_pixels": f"SELECT {POSITION}, lulc, CASE WHEN allocated = 1 THEN 0 ELSE lulc END AS modified_lulc FROM alout",
    "stratum_opening": 'SELECT r AS "row", c AS col, stratum FROM op2',
    "top_pixels_per_division": """SELECT r AS "row", c AS col, division FROM (SELECT *, row_number() OVER (PARTITION BY division ORDER BY etp_cnf DESC, r, c) AS k,
  max(r) OVER (PARTITION BY division) + min(c) OVER (PARTITION BY division) AS wanted FROM px) WHERE k <= wanted""",
    "rasterized_divisions": """SELECT r AS "row", c AS col, CASE WHEN max(mask) = 1 THEN coalesce(max(seq) + 2, 1) END AS division FROM mk
  LEFT JOIN dia ON abs(c + 0.5 - cx) + abs(r + 0.5 - cy) < half GROUP BY r, c""",
    "layers_aligned": """SELECT g.layer, f.field, f.expected, f.found FROM gt g, gt o, LATERAL (VALUES
  ('height', CAST(o.height AS VARCHAR), CAST(g.height AS VARCHAR)), ('pixel_x', CAST(CAST(o.px AS DOUBLE) AS VARCHAR), CAST(CAST(g.px AS DOUBLE) AS VARCHAR)),
  ('pixel_y', CAST(CAST(o.px AS DOUBLE) AS VARCHAR), CAST(CAST(g.px AS DOUBLE) AS VARCHAR)), ('crs', o.crs, g.crs)) f(field, expected, found)
  WHERE o.layer = 'orders' AND g.layer <> 'orders' AND f.expected <> f.found""",
    "layer_crs": """SELECT layer, crs, CASE WHEN layer = 'part' THEN 'not projected' ELSE 'differs' END AS problem FROM gt
  WHERE layer = 'part' OR crs <> 'EPSG:32618'""",
    "layer_extents": """SELECT e.layer, 'no overlap' AS problem FROM ext e, ext o WHERE o.layer = 'view-0' AND e.layer <> 'view-0'
  AND (o.max_x < e.min_x OR e.max_x < o.min_x OR o.max_y < e.min_y OR e.max_y < o.min_y)""",
    "missing_pixels": f"""SELECT {POSITION}, 'layer' AS side FROM px WHERE excl = 0 AND aoi <> 1 UNION ALL
  SELECT {POSITION}, 'template' FROM px WHERE aoi = 1 AND excl <> 0""",
    "quality_ids": """SELECT part, id, CASE WHEN try_cast(trim(id) AS DOUBLE) IS NULL THEN 'not numeric'
  WHEN try_cast(trim(id) AS DOUBLE) <> floor(try_cast(trim(id) AS DOUBLE)) THEN 'not an integer' ELSE 'negative' END AS problem FROM ct
  WHERE try_cast(trim(id) AS DOUBLE) IS NULL OR try_cast(trim(id) AS DOUBLE) <> floor(try_cast(trim(id) AS DOUBLE)) OR try_cast(trim(id) AS DOUBLE) < 0""",
    "quality_duplicates": """SELECT part, id, copies FROM (SELECT part, id, count(*) OVER (PARTITION BY try_cast(trim(id) AS DOUBLE)) AS copies
  FROM ct WHERE try_cast(trim(id) AS DOUBLE) IS NOT NULL) WHERE copies > 1""",
    "quality_labels": "SELECT label, count(DISTINCT id) AS n_ids FROM ct GROUP BY label HAVING count(DISTINCT id) > 1",
    "quality_reclass": "SELECT DISTINCT label_reclass AS value FROM ct WHERE label_reclass NOT IN (SELECT label FROM ct)",
    "quality_transitions": """SELECT DISTINCT 'from_class' AS side, p_type || '?' AS value FROM part WHERE p_size = 11 UNION ALL
  SELECT DISTINCT 'to_class', p_name FROM part WHERE p_size = 12""",
    "quality_flags": "SELECT part, confusion FROM ct WHERE lower(confusion) NOT IN ('yes', 'no')",
    "quality_colours": """SELECT part, component, CASE WHEN try_cast(x AS DOUBLE) IS NULL THEN 'not numeric' ELSE 'out of range' END AS problem FROM
  (SELECT part, 'r' AS component, r AS x FROM ct UNION ALL SELECT part, 'g', g FROM ct UNION ALL SELECT part, 'b', b FROM ct)
  WHERE try_cast(x AS DOUBLE) IS NULL OR try_cast(x AS DOUBLE) NOT BETWEEN 0 AND 255""",
    "quality_clean_rows": "SELECT category, count(*) AS n FROM ct WHERE category IS NOT NULL GROUP BY category",
    "quality_cleaned_table": "SELECT * FROM ct WHERE category IS NOT NULL",
    "quality_null_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) FILTER ({n} IS NULL) AS n_null, count(*) AS n_rows FROM ct"
        for n in ("part", "id", "label", "label_reclass", "category", "r", "g", "b", "confusion")
    ),
    "quality_schema": " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", '{p}' AS problem, count(*) AS n_rows FROM ct"
        for n, p in (("id", "string is not integer"), ("r", "string is not float"), ("nope", "missing"))
    ),
    "text_numbers": """SELECT part, coalesce(try_cast(trim(id) AS DOUBLE), -1.0) AS number,
  coalesce(CAST(trunc(try_cast(trim(id) AS DOUBLE)) AS BIGINT), 0) AS whole FROM ct""",
    "decimal_years": """SELECT o_orderkey, round(ordered, 6) AS ordered,
  CASE WHEN abs(shipped - ordered) > 0 THEN round(abs(shipped - ordered), 6) END AS years FROM years""",
    "workflow_benchmark": f"""SELECT 'CAL' AS phase, count(DISTINCT region_id) AS n_regions, count(region_id) AS n_px,
  round(sum(coalesce(rel_freq, 0.0) * {HA}), 5) AS total_ha FROM calr LEFT JOIN freq USING (region_id) UNION ALL
  SELECT 'HRP', count(DISTINCT region_id), count(region_id), round(sum(coalesce(rel_freq, 0.0) * {HA}), 5) FROM calr LEFT JOIN hrpfreq USING (region_id) UNION ALL
  SELECT 'CNF', count(*), CAST(sum(n_px) AS BIGINT), round(sum(n_px * d), 5) FROM ac5 UNION ALL
  SELECT 'VP', count(*), CAST(sum(n_px) AS BIGINT), round(sum(n_px * d) / 10, 5) FROM aw5""",
    "workflow_alternative": f"""SELECT 'CAL' AS phase, count(*) AS n_regions, CAST(sum(area_px) AS BIGINT) AS n_px,
  round(sum(area_px * rel_freq * {HA}), 5) AS total_ha FROM afc UNION ALL
  SELECT 'HRP', count(*), CAST(sum(area_px) AS BIGINT), round(sum(area_px * rel_freq * {HA}), 5) FROM afh UNION ALL
  SELECT 'CNF', count(*), CAST(sum(n_px) AS BIGINT), round(sum(n_px * d), 5) FROM ax5 UNION ALL
  SELECT 'VP', count(*), CAST(sum(n_px) AS BIGINT), round(sum(n_px * d) / 10, 5) FROM ay5""",
    "stored_layer": f"SELECT {POSITION}, CASE WHEN fcbm >= 6 THEN division END AS value FROM px",
    "stored_frequency": """SELECT 'testing' AS stage, 0 AS revision, region_id, defor_px, area_px, round(rel_freq, 6) AS rel_freq, false AS imputed
  FROM stagefit UNION ALL SELECT 'testing', 1, region_id, defor_px, area_px, round(rel_freq, 6), imputed FROM stagefull""",
    "staged_unseen_zones": """SELECT DISTINCT region_id // 1000 AS zone FROM stagemiss
  WHERE region_id // 1000 NOT IN (SELECT region_id // 1000 FROM stagefit)""",
    "stored_statistics": """SELECT 'testing' AS stage, 'alternative' AS model, 'CAL' AS phase, count(*) AS n, round(regr_slope(y, x), 5) AS ols_slope,
  round(pow(corr(x, y), 2), 5) AS r2, round(median(abs(x - y)), 5) AS medae, round(max(s), 5) AS ts_slope,
  round(median(y) - max(s) * median(x), 5) AS ts_intercept FROM eacuse,
  (SELECT median((b.y - a.y) / (b.x - a.x)) AS s FROM eacuse a JOIN eacuse b ON b.x > a.x)""",
    "stored_after_failed_write": "SELECT region_id, defor_px, area_px, round(rel_freq, 6) AS rel_freq FROM freq",
    "stored_threshold": "SELECT bin, n, round(cum_share, 6) AS cum_share, (SELECT nrt FROM nrt) AS nrt FROM cums",
    "exported_cells": """SELECT cell_id, cell_r, cell_c, round(area_ha, 6) AS area_ha, round(actual_ha, 6) AS actual_ha,
  round(pred_ha, 6) AS pred_ha, round(residual_ha, 6) AS residual_ha, '01_demo_cells_v2.csv' AS file FROM cells""",
}

# Allocation with isolated pixels removed: score > 0 first, then opening.
TABLES["op0p"] = """SELECT r, c, r // 20 AS area, c // 24 AS region, etp_cnf * 11000.0 - 1000.0 AS etp FROM px
  WHERE fcbm >= 5 AND etp_cnf * 11000.0 - 1000.0 > 0"""
TABLES["op1p"] = """SELECT o.r, o.c, o.area, o.region, o.etp FROM op0p o JOIN op0p n ON n.area = o.area AND n.region = o.region
  AND abs(n.r - o.r) + abs(n.c - o.c) = 1 GROUP BY ALL HAVING count(*) = 4"""
TABLES["op2p"] = """SELECT DISTINCT o.* FROM op0p o JOIN op1p n ON n.area = o.area AND n.region = o.region
  AND abs(n.r - o.r) + abs(n.c - o.c) <= 1"""
TABLES["cf"] = """SELECT e.*, k <= target_px AS first_pass FROM
  (SELECT *, row_number() OVER (PARTITION BY area, region ORDER BY etp DESC, r, c) AS k FROM op2p) e JOIN ot USING (area, region)"""
TABLES["cd"] = f"""SELECT area, CAST(greatest(0, ceil(sum(d) / {HA} - 1e-9)) AS BIGINT) AS deficit_px FROM
  (SELECT area, greatest(0, target_ha - least(target_px, coalesce(a, 0)) * {HA}) AS d FROM ot LEFT JOIN
   (SELECT area, region, count(*) AS a FROM op2p GROUP BY area, region) USING (area, region)) GROUP BY area"""
TABLES["c2"] = """SELECT r, c FROM (SELECT r, c, deficit_px, row_number() OVER (PARTITION BY area ORDER BY etp DESC, r, c) AS k
  FROM cf JOIN cd USING (area) WHERE NOT first_pass) WHERE k <= deficit_px"""
BODIES["alloc_mask_filtered"] = """SELECT px.r AS "row", px.c AS col, CAST(coalesce(first_pass, false) OR c2.r IS NOT NULL AS INT) AS allocated
  FROM px LEFT JOIN (SELECT r, c, first_pass FROM cf) f ON f.r = px.r AND f.c = px.c LEFT JOIN c2 ON c2.r = px.r AND c2.c = px.c"""
del TABLES["oe"], TABLES["op3"]

ORACLE: dict[str, str] = {name: statement(body) for name, body in BODIES.items()}
