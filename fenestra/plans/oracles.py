"""The driver-facing queries once more, as SQL over the same tables.

Written from the meaning of each query, not from its plan: source values are
computed from the columns they were rendered from. Queries whose result cannot be
said in plain SQL (assignments, order-dependent merging) are absent.
"""

from __future__ import annotations

from fenestra.functions.geometry import TILE_PX

# one row per order line as a unit; w, h first panel, composite units also have a 36 in door
UNITS = """
u AS (
  SELECT l_orderkey AS project, l_suppkey AS supplier, l_linenumber AS line, l_partkey AS partkey,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS unit_id,
    CASE p_type WHEN 'PROMO' THEN 'door' WHEN 'LARGE' THEN 'composite' ELSE 'window' END AS kind,
    20 + p_size + (l_partkey % 16) / 16::DOUBLE AS w, 40 + p_size + (l_suppkey % 16) / 16::DOUBLE AS h,
    CASE l_returnflag WHEN 'A' THEN 'annealed' WHEN 'R' THEN 'tempered' END AS glass,
    0.2::DOUBLE + l_tax AS uf, CASE WHEN l_discount > 0 THEN l_linestatus = 'O' END AS egress,
    l_discount * 100 AS clear, CAST(l_quantity AS INT) AS qty, p_brand AS mark, p_size AS size,
    l_returnflag AS returnflag, l_linestatus AS linestatus, l_discount AS discount, l_tax AS tax,
    l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def steps(v: str) -> str:
    return f"CAST(round_even(({v}) / 0.5::DOUBLE, 0) AS BIGINT)"


def bucket(v: str) -> str:
    return f"printf('%.2f', round_even(({v}) / 0.01::DOUBLE, 0) * 0.01::DOUBLE)"


def key(w: str = "w", h: str = "h", rest: str = "") -> str:
    """Readable group key; a composite lists its door panel first."""
    role = "CASE kind WHEN 'door' THEN 'door' ELSE 'window' END"
    tail = rest or "coalesce(glass, '-') || ':' || ub || ':' || coalesce(CAST(egress AS VARCHAR), '-')"
    one = lambda r, ww: f"{r} || ':' || {ww} || ':' || {steps(h)} || ':' || {tail}"
    return (f"kind || '|' || CASE kind WHEN 'composite' THEN {one(chr(39) + 'door' + chr(39), '72')} || '+' || "
            f"{one(chr(39) + 'window' + chr(39), steps(w))} ELSE {one(role, steps(w))} END")


KEYED = UNITS + f""",
k AS (SELECT *, {bucket('uf')} AS ub FROM u)"""

RUNS = """
r AS (
  SELECT substr('ABCDEFG', CAST(1 + user_id % 7 AS INT), 1) AS variant, event_type AS model,
    'p' || (user_id % 10) AS project, CASE WHEN kk % 3 = 0 THEN 'offer' ELSE 'extraction' END AS gt_level,
    kk / 100::DOUBLE AS group_f1, value / 1000 AS unit_count_error,
    CASE WHEN kk % 5 <> 0 THEN kk / 10::DOUBLE END AS qty_mae, value / 100 AS cost_usd,
    CASE WHEN kk % 7 <> 0 THEN 0.9::DOUBLE + kk / 1000::DOUBLE END AS glass_acc, kk / 50::DOUBLE AS elapsed_sec,
    CASE WHEN event_type = 'error' AND kk % 4 = 0 THEN 'timeout' END AS error, ts AS mtime, event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS kk FROM events))"""

BOARD = RUNS + """,
b AS (
  SELECT * FROM r QUALIFY row_number() OVER (
    PARTITION BY variant, model, project, gt_level ORDER BY mtime DESC, event_id DESC) = 1)"""

PASS = "group_f1 >= 0.70::DOUBLE AND unit_count_error <= 0.05::DOUBLE"

ROUTE = r"""
d AS (
  SELECT source || '-' || lang AS doc_id, doc_id AS page_key, n_chars, lang = 'es' AS scanned,
    CASE lang WHEN 'fr' THEN 'WINDOW SCHEDULE' || chr(10) || text
      WHEN 'de' THEN 'Rough Opening / Mark' || chr(10) || text 
      ELSE CASE WHEN n_chars > 2000 THEN text || chr(10) || 'Weather  Shield' ELSE text END END AS text
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_key) AS page_no,
    CASE WHEN scanned THEN 0 ELSE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS chars FROM d),
g AS (
  SELECT doc_id, count(*) AS n_pages, count(*) FILTER (chars > 40) / count(*)::DOUBLE AS frac,
    max(chars) AS max_chars,
    min(page_no) FILTER (chars > 200 AND (regexp_matches(text, '(?i)(window|door)\s+schedule')
      OR (contains(upper(text), 'ROUGH OPENING') AND regexp_matches(upper(text), 'UNIT|MARK|WINDOW|DOOR')))) AS sched,
    max(CASE WHEN regexp_matches(text, '(?i)weather\s*shield') THEN 'weather_shield' END) AS profile
  FROM p GROUP BY doc_id),
v AS (
  SELECT g.doc_id, min(page_no) FILTER (quality = 0 AND toxic = 0) AS table_page,
    count(*) FILTER (toxic = 1) AS hands
  FROM g JOIN p ON p.doc_id = g.doc_id JOIN labels l ON l.doc_id = p.page_key
  WHERE sched IS NULL AND frac < 0.15 AND max_chars < 120 AND page_no IN (1, n_pages // 2 + 1, n_pages)
  GROUP BY g.doc_id),
routed AS (
  SELECT g.*, coalesce(sched, table_page) AS page, sched IS NOT NULL AS vec,
    coalesce(table_page IS NULL AND hands > 0, FALSE) AS hand
  FROM g LEFT JOIN v USING (doc_id)),
branches AS (
  SELECT *, CASE WHEN hand THEN 4 WHEN page IS NOT NULL AND vec THEN 1 WHEN page IS NOT NULL THEN 2 ELSE 3 END AS branch
  FROM routed),
named AS (
  SELECT *, CASE branch WHEN 1 THEN 'vector-table' WHEN 2 THEN 'raster-table' WHEN 3 THEN 'elevations'
    ELSE 'handwritten' END AS branch_name FROM branches)"""

ELEVATION = """
t AS (
  SELECT source AS doc_id, doc_id AS page_no, upper(replace(replace(replace(replace(text, 'the', 'First Level'),
    ' and ', ' elevation '), 're', 't.o. parapet'), 'es', 'second level')) AS t FROM documents),
n AS (
  SELECT doc_id, page_no,
    (length(t) - length(replace(t, 'FIRST LEVEL', ''))) // 11 + (length(t) - length(replace(t, 'SECOND LEVEL', ''))) // 12
      + (length(t) - length(replace(t, 'THIRD LEVEL', ''))) // 11
      + (length(t) - length(replace(t, 'FOURTH LEVEL', ''))) // 12
      + (length(t) - length(replace(t, 'FIFTH LEVEL', ''))) // 11 AS level_hits,
    (length(t) - length(replace(t, 'T.O. PARAPET', ''))) // 12
      + (length(t) - length(replace(t, 'ELEVATION', ''))) // 9 AS others FROM t),
e AS (
  SELECT doc_id, page_no, level_hits, 11 * level_hits + others AS score, row_number() OVER (
    PARTITION BY doc_id ORDER BY 11 * level_hits + others DESC, page_no) AS rank
  FROM n WHERE level_hits >= 2 QUALIFY rank <= 2)"""

# schedule rows of the two readers, decoded by arithmetic
SCHEDULE = """
a AS (
  SELECT o_custkey AS project, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Door' ELSE 'window' END AS type,
    2 + o_orderkey % 3 AS f1, o_orderkey % 10 AS i1, 5 + o_orderkey % 3 AS f2, o_custkey % 10 AS i2,
    1 + o_orderkey % 12 AS qty FROM orders),
rows_a AS (
  SELECT *, CASE c % 4 WHEN 0 THEN '2-' || f1 || i1 || f2 || i2 WHEN 1 THEN '2''-' || i1 || '" x 6''-0"'
      WHEN 2 THEN f1 || '' || i1 || f2 || i2 ELSE 'n/a' END AS code,
    CASE c % 4 WHEN 0 THEN 2 * (f1 * 12 + i1) WHEN 1 THEN 24 + i1 WHEN 2 THEN f1 * 12 + i1 END::DOUBLE AS w,
    CASE WHEN c % 4 = 1 THEN 72 WHEN c % 4 < 3 THEN f2 * 12 + i2 END::DOUBLE AS h FROM a),
rows_b AS (
  SELECT * EXCLUDE (code, qty, w, h), CASE WHEN st = 'P' THEN '2870' ELSE replace(code, '-', ' - ') END AS code,
    qty + CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END AS qty,
    CASE WHEN st = 'P' THEN 32 ELSE w END::DOUBLE AS w, CASE WHEN st = 'P' THEN 84 ELSE h END::DOUBLE AS h FROM rows_a)"""

DIFF = """
a AS (SELECT 'K' || o_orderkey AS mark, CAST(o_custkey AS VARCHAR) AS c1, o_orderstatus AS c2, o_orderpriority AS c3 FROM orders),
b AS (
  SELECT 'K' || o_orderkey AS mark, CAST(o_custkey AS VARCHAR) AS c1,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS c2, o_orderpriority AS c3
  FROM orders WHERE o_totalprice >= 50000),
j AS (SELECT mark, a.c1 AS a1, a.c2 AS a2, a.c3 AS a3, b.c1 AS b1, b.c2 AS b2, b.c3 AS b3 FROM a FULL JOIN b USING (mark)),
c AS (
  SELECT mark, 'WINDOW SIZE' AS "column", a1 AS a, b1 AS b FROM j UNION ALL SELECT mark, 'QTY', a2, b2 FROM j
  UNION ALL SELECT mark, 'DAY OPEN (SF)', a3, b3 FROM j)"""

PAGES = """
pg AS (
  SELECT o_custkey AS doc_id, o_orderkey AS page_no, o_orderstatus AS st, 3000 + o_orderkey % 5 * 700 AS wpx,
    2000 + o_orderkey % 3 * 900 AS hpx FROM orders),
rg AS (
  SELECT doc_id, page_no, 1000 + page_no % 400 AS x, 400 + page_no % 90 AS y, 900 AS w, 600 AS h, wpx, hpx FROM pg
  UNION ALL SELECT doc_id, page_no, 100 + page_no % 300, 410 + page_no % 70, 700, 500, wpx, hpx FROM pg),
nr AS (
  SELECT doc_id, page_no, x, y, w, h, row_number() OVER (
    PARTITION BY doc_id, page_no ORDER BY y // 50, x, y, w, h) AS region_no
  FROM rg WHERE w * h >= wpx * hpx * 0.005),
crop AS (
  SELECT nr.*, CASE region_no WHEN 1 THEN 30 + page_no % 20 ELSE 50 + page_no % 10 END AS width, 1 + page_no % 9 AS qty
  FROM nr WHERE region_no <= 2)"""

CELLS = """
cl AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_no,
    CASE l_linestatus WHEN 'O' THEN 'd' ELSE 'W' END || l_partkey AS unit_id,
    CASE l_linestatus WHEN 'O' THEN 'door' ELSE 'window' END AS kind, CAST(l_quantity AS BIGINT) AS qty,
    20 + p_size + (1 + l_partkey % 15) / 16::DOUBLE AS width_in, (40 + p_size)::DOUBLE AS height_in,
    CASE l_returnflag WHEN 'A' THEN 'annealed' WHEN 'R' THEN 'tempered' END AS glass,
    CAST(printf('%.2f', 0.2::DOUBLE + l_tax) AS DOUBLE) AS u_factor, l_discount AS dc, 0.95::DOUBLE AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

INJECT = """
p AS (
  SELECT p_brand AS project, p_partkey AS id, p_size AS s, 60.0::DOUBLE + p_partkey % 30 AS h,
    CASE p_type WHEN 'PROMO' THEN 'door' WHEN 'LARGE' THEN 'composite' ELSE 'window' END AS kind,
    p_type = 'SMALL' AS annealed, 1 + p_partkey % 60 AS qty FROM part),
v AS (SELECT 'v' || lpad(CAST(n AS VARCHAR), 2, '0') AS variant_id, n FROM range(1, 11) t(n)),
x AS (
  SELECT project, variant_id, n, id, CASE n WHEN 8 THEN kind = 'composite' AND s < 10
      WHEN 4 THEN FALSE ELSE kind = 'window' AND s = 2 * n + 1 - CASE WHEN n > 4 THEN 2 ELSE 0 END
        - CASE WHEN n > 8 THEN 2 ELSE 0 END END AS hit,
    kind, s, qty, annealed FROM p, v),
sc AS (
  -- a touched unit raises its own flag; only the size and facade edits can miss it
  SELECT project, variant_id, hit, CASE WHEN NOT hit THEN 0 WHEN n = 1 THEN CASE WHEN abs(50 - (20 + s)) > 1 THEN 1 ELSE 0 END
      WHEN n = 5 THEN CASE WHEN abs(30 - qty) > 1 THEN 1 ELSE 0 END ELSE 1 END AS found FROM x),
m AS (
  SELECT project, variant_id, count(*) FILTER (hit AND found = 1) + CASE WHEN variant_id = 'v04' THEN 1 ELSE 0 END AS caught,
    count(*) FILTER (hit AND found = 0) AS missed FROM sc GROUP BY project, variant_id),
scored AS (
  SELECT project, variant_id, caught, missed, 0 AS false_flags, caught / (caught + missed)::DOUBLE AS recall,
    caught / greatest(1, caught)::DOUBLE AS precision FROM m WHERE caught + missed > 0)"""

_METRICS = """
  round(CASE WHEN m + fp > 0 THEN m / (m + fp)::DOUBLE ELSE 0 END, 6) AS group_precision,
  round(CASE WHEN m + fn > 0 THEN m / (m + fn)::DOUBLE ELSE 0 END, 6) AS group_recall,
  round(CASE WHEN m > 0 THEN 2 * m / (2 * m + fp + fn)::DOUBLE ELSE 0 END, 6) AS group_f1"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    q = lambda v: f"WITH {v.strip()}\n"

    sql["parse_inches_codes"] = """
SELECT p_partkey,
  CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 THEN NULL ELSE 20 + p_size + (p_partkey % 16) / 16::DOUBLE END AS inches,
  p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS bad_inches,
  CASE WHEN p_type <> 'PROMO' THEN ((1 + p_size % 9) * 12 + p_partkey % 10)
    * CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 1 + p_partkey % 3 END END::DOUBLE AS code_w,
  CASE WHEN p_type <> 'PROMO' THEN (1 + p_partkey % 9) * 12 + p_size % 10 END::DOUBLE AS code_h,
  CASE WHEN p_type <> 'PROMO' THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 1 + p_partkey % 3 END END::BIGINT AS mull_count,
  CASE WHEN p_type = 'PROMO' THEN 'unknown notation profile' END AS code_error,
  ((1 + p_size % 9) * 12 + p_partkey % 10)::DOUBLE AS literal_w,
  (1 + p_partkey % 9) * 12 + p_size % 10 + 0.5::DOUBLE AS literal_h
FROM part"""
    sql["rounding_buckets"] = f"""
SELECT {bucket('0.2::DOUBLE + l_tax + l_discount / 4')} AS u_bucket,
  CAST(sum({steps('l_extendedprice / 64')}) AS BIGINT) AS steps, count(*) AS n FROM lineitem GROUP BY 1"""
    sql["provider_specs"] = """
SELECT 'vendor' AS provider, event_type || '_v' || (user_id % 3) AS slug,
  'vendor_' || event_type || '_v' || (user_id % 3) AS safe, count(*) AS n,
  count(*) FILTER (event_type NOT IN ('click', 'view', 'signup')) AS unpriced,
  round(sum(CASE event_type WHEN 'click' THEN it / 1e6 * 2.5 + ot / 1e6 * 10 WHEN 'view' THEN it / 1e6 * 0.15 + ot / 1e6 * 0.6
    WHEN 'signup' THEN it / 1e6 * 15 + ot / 1e6 * 75 END), 6) AS cost_usd
FROM (SELECT *, user_id * 10 AS it, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ot FROM events) GROUP BY 1, 2, 3"""

    sql["bucketed_spec_groups"] = q(KEYED) + f"""
SELECT supplier, {key()} AS spec_key, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_units FROM k GROUP BY 1, 2"""
    sql["spec_groups_by_size"] = q(UNITS) + f"""
SELECT supplier, {key(rest="'-:-:-'")} AS spec_key, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n_units FROM u GROUP BY 1, 2"""
    sql["distinct_groups"] = q(UNITS) + """
SELECT supplier, count(DISTINCT (kind, w)) AS n_groups, count(DISTINCT (kind, w, h)) AS n_sizes FROM u GROUP BY 1"""
    sql["ro_to_frame"] = q(UNITS) + """
SELECT project, unit_id, kind, w + CASE WHEN discount > 0 THEN 1.0::DOUBLE - 0.75::DOUBLE ELSE 0 END AS frame_w,
  h + CASE WHEN discount > 0 THEN 1.5::DOUBLE - CASE kind WHEN 'door' THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END ELSE 0 END AS frame_h,
  CASE kind WHEN 'composite' THEN 2 ELSE 1 END::BIGINT AS n_panels,
  CASE WHEN discount > 0 THEN w + 1.0::DOUBLE - 1.0::DOUBLE END AS legacy_w FROM u"""

    part_groups = """
p AS (
  SELECT p_brand AS project, CASE p_type WHEN 'PROMO' THEN 'door' WHEN 'LARGE' THEN 'composite' ELSE 'window' END AS kind,
    p_type = 'SMALL' AS annealed, (20 + p_size) * 2 AS w, (60 + p_partkey % 30) * 2 AS h,
    CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS shift FROM part),
tn AS (
  SELECT project, kind, CASE kind WHEN 'composite' THEN 72 END AS dw, w, h, count(DISTINCT annealed) AS units FROM p GROUP BY ALL),
pn AS (
  SELECT project, kind, CASE kind WHEN 'composite' THEN 72 + shift END AS dw, w + shift AS w, h,
    count(DISTINCT annealed) AS units FROM p GROUP BY ALL)"""
    node = lambda t: f"concat_ws(',', {t}.dw, CASE WHEN {t}.dw IS NOT NULL THEN {t}.h END, {t}.w, {t}.h)"
    sql["tolerance_match_edges"] = q(part_groups) + f"""
SELECT pn.project, pn.kind, {node('pn')} AS p, {node('tn')} AS t,
  CAST(abs(pn.w - tn.w) + abs(pn.h - tn.h) + coalesce(abs(pn.dw - tn.dw) + abs(pn.h - tn.h), 0) AS BIGINT) AS d,
  pn.units AS supply, tn.units AS demand
FROM pn JOIN tn ON pn.project = tn.project AND pn.kind = tn.kind
  AND abs(pn.w - tn.w) + abs(pn.h - tn.h) + coalesce(abs(pn.dw - tn.dw) + abs(pn.h - tn.h), 0)
    <= CASE pn.kind WHEN 'composite' THEN 4 ELSE 2 END"""

    exact = UNITS + f""",
tg AS (
  SELECT project, kind, {steps('w')} AS ww, {steps('h')} AS hh, glass, {bucket('uf')} AS ub, egress, sum(qty) AS qty,
    sum(qty * CASE kind WHEN 'composite' THEN 2 ELSE 1 END) AS frames, 0 AS dd FROM u GROUP BY 1, 2, 3, 4, 5, 6, 7),
pu AS (
  SELECT *, CASE WHEN discount = 0.05::DOUBLE THEN 3.0 WHEN tax = 0.02::DOUBLE THEN 0.5 ELSE 0 END::DOUBLE AS wider FROM u),
pg AS (
  SELECT project, kind, {steps('w + wider')} AS ww, {steps('h')} AS hh,
    CASE WHEN tax = 0.04::DOUBLE THEN 'mixed' ELSE glass END AS glass, {bucket('uf')} AS ub, egress,
    sum(qty + CASE returnflag WHEN 'R' THEN 1 ELSE 0 END) AS qty,
    sum((qty + CASE returnflag WHEN 'R' THEN 1 ELSE 0 END) * CASE kind WHEN 'composite' THEN 2 ELSE 1 END) AS frames,
    CASE kind WHEN 'composite' THEN {steps('36 + wider')} ELSE 0 END AS dd
  FROM pu GROUP BY project, kind, ww, hh, CASE WHEN tax = 0.04::DOUBLE THEN 'mixed' ELSE glass END, ub, egress, dd),
tr AS (SELECT *, CASE kind WHEN 'composite' THEN 72 ELSE 0 END AS d2, row_number() OVER (
  PARTITION BY project, kind, ww, hh ORDER BY glass NULLS FIRST, ub, egress NULLS FIRST) AS rk FROM tg),
pr AS (SELECT *, row_number() OVER (
  PARTITION BY project, kind, ww, hh, dd ORDER BY glass NULLS FIRST, ub, egress NULLS FIRST) AS rk FROM pg),
j AS (
  SELECT coalesce(tr.project, pr.project) AS project, coalesce(tr.kind, pr.kind) AS kind, pr.qty AS pq, tr.qty AS tq,
    tr.glass AS tglass, pr.glass AS pglass, tr.ub AS tub, pr.ub AS pub, tr.egress AS te, pr.egress AS pe,
    pr.frames AS pf, tr.frames AS tf, CASE coalesce(tr.kind, pr.kind) WHEN 'composite' THEN 2 ELSE 1 END AS np
  FROM tr FULL JOIN pr ON tr.project = pr.project AND tr.kind = pr.kind AND tr.ww = pr.ww AND tr.hh = pr.hh
    AND tr.d2 = pr.dd AND tr.rk = pr.rk),
s AS (
  SELECT project, count(*) FILTER (pq IS NOT NULL AND tq IS NOT NULL) AS m, count(*) FILTER (tq IS NULL) AS fp,
    count(*) FILTER (pq IS NULL) AS fn, coalesce(sum(pq), 0) AS p, coalesce(sum(tq), 0) AS t, sum(abs(pq - tq)) AS aq,
    sum(pf) AS pf, sum(tf) AS tf,
    sum(np) FILTER (pq IS NOT NULL AND tglass IS NOT NULL) AS g0, sum(np) FILTER (pglass = tglass) AS g1,
    sum(np) FILTER (pq IS NOT NULL AND tub IS NOT NULL) AS u0, sum(np) FILTER (pub = tub) AS u1,
    sum(np) FILTER (pq IS NOT NULL AND te IS NOT NULL) AS e0, sum(np) FILTER (pe = te) AS e1
  FROM j GROUP BY 1)"""
    sql["match_metrics"] = q(exact) + f"""
SELECT project, {_METRICS}, round(CASE WHEN m > 0 THEN aq / m::DOUBLE END, 6) AS qty_mae,
  round(CASE WHEN t > 0 THEN abs(p - t) / t::DOUBLE ELSE 0 END, 6) AS unit_count_error,
  round(abs(pf - tf) / tf::DOUBLE, 6) AS frame_count_error,
  round(CASE WHEN g0 > 0 THEN coalesce(g1, 0) / g0::DOUBLE END, 6) AS glass_acc,
  round(CASE WHEN u0 > 0 THEN coalesce(u1, 0) / u0::DOUBLE END, 6) AS ufactor_acc,
  round(CASE WHEN e0 > 0 THEN coalesce(e1, 0) / e0::DOUBLE END, 6) AS egress_acc,
  round(CASE WHEN m + fp > 0 THEN fp / (m + fp)::DOUBLE ELSE 0 END, 6) AS hallucination_rate,
  round(CASE WHEN m + fn > 0 THEN fn / (m + fn)::DOUBLE ELSE 0 END, 6) AS miss_rate,
  m AS matched_groups, fp AS fp_groups, fn AS fn_groups, CAST(p AS BIGINT) AS pred_units_total,
  CAST(t AS BIGINT) AS gt_units_total FROM s"""
    # all flows of a block, edge after edge; the most units, then the least distance, then the least tie numbers win
    name = lambda t, door: f"concat_ws(',', CASE kind WHEN 'composite' THEN {t}.{door} || ',' || {t}.hh END, {t}.ww, {t}.hh)"
    used = lambda side: (f"coalesce(list_sum([fl[k] FOR k IN range(1, i + 1) IF es[k].{side} = es[i + 1].{side}]), 0)")
    tolerant = "RECURSIVE " + exact[:exact.index("j AS (")].strip() + f"""
pn AS (SELECT project, kind, ww, hh, dd, count(*) AS units, {name('pr', 'dd')} AS p FROM pr GROUP BY 1, 2, 3, 4, 5),
tn AS (SELECT project, kind, ww, hh, d2, count(*) AS units, {name('tr', 'd2')} AS t FROM tr GROUP BY 1, 2, 3, 4, 5),
e AS (
  SELECT pn.project, pn.kind, p, t, abs(pn.ww - tn.ww) + abs(pn.hh - tn.hh) + CASE pn.kind WHEN 'composite' THEN
      abs(dd - d2) + abs(pn.hh - tn.hh) ELSE 0 END AS d, pn.units AS s, tn.units AS q,
    ('0x' || substr(md5(p || '|' || t), 1, 12))::BIGINT AS tie
  FROM pn JOIN tn ON pn.project = tn.project AND pn.kind = tn.kind),
b AS (
  SELECT project, kind, list({{'p': p, 't': t, 'd': d, 's': s, 'q': q, 'tie': tie}} ORDER BY p, t) AS es
  FROM e WHERE d <= CASE kind WHEN 'composite' THEN 4 ELSE 2 END GROUP BY 1, 2),
st AS (
  SELECT project, kind, es, 0::BIGINT AS i, []::BIGINT[] AS fl FROM b
  UNION ALL
  SELECT project, kind, es, i + 1, list_append(fl, f) FROM (
    SELECT *, unnest(range(0, least(es[i + 1].s - {used('p')}, es[i + 1].q - {used('t')})::BIGINT + 1)) AS f
    FROM st WHERE i < len(es))),
best AS (
  SELECT project, kind, es, fl FROM st WHERE i = len(es) QUALIFY row_number() OVER (PARTITION BY project, kind ORDER BY
    list_sum(fl) DESC, list_sum([fl[k] * es[k].d FOR k IN range(1, len(es) + 1)]),
    list_sum([(fl[k] * es[k].tie)::HUGEINT FOR k IN range(1, len(es) + 1)])) = 1),
flow AS (
  SELECT project, kind, es[k].p AS p, es[k].t AS t, es[k].d AS d, fl[k] AS f
  FROM (SELECT *, unnest(range(1, len(es) + 1)) AS k FROM best)),
placed AS (
  SELECT *, coalesce(sum(f) OVER (PARTITION BY project, kind, p ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0,
    coalesce(sum(f) OVER (PARTITION BY project, kind, t ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0
  FROM flow WHERE f > 0),
pairs AS (SELECT *, p0 + k AS p_rk, t0 + k AS t_rk FROM (SELECT *, unnest(range(1, f + 1)) AS k FROM placed)),
pp AS (
  SELECT pr.*, pairs.t, pairs.t_rk, pairs.d FROM pr LEFT JOIN pairs
  ON pairs.project = pr.project AND pairs.kind = pr.kind AND pairs.p = {name('pr', 'dd').replace('CASE kind', 'CASE pr.kind')}
    AND pairs.p_rk = pr.rk),
j AS (
  SELECT coalesce(tr.project, pp.project) AS project, coalesce(tr.kind, pp.kind) AS kind, pp.qty AS pq, tr.qty AS tq,
    tr.glass AS tglass, pp.glass AS pglass, tr.ub AS tub, pp.ub AS pub, tr.egress AS te, pp.egress AS pe,
    pp.frames AS pf, tr.frames AS tf, CASE coalesce(tr.kind, pp.kind) WHEN 'composite' THEN 2 ELSE 1 END AS np,
    tr.ww AS tww, tr.hh AS thh, tr.d2, pp.ww AS pww, pp.hh AS phh, pp.dd, pp.d
  FROM tr FULL JOIN pp ON tr.project = pp.project AND tr.kind = pp.kind
    AND {name('tr', 'd2').replace('CASE kind', 'CASE tr.kind')} = pp.t AND tr.rk = pp.t_rk),
""" + exact[exact.index("s AS ("):]
    sql["tolerance_metrics"] = q(tolerant) + sql["match_metrics"][sql["match_metrics"].index("SELECT project, \n"):].replace(
        "round(abs(pf - tf) / tf::DOUBLE, 6) AS frame_count_error", "NULL::DOUBLE AS frame_count_error")
    one = lambda role, w, h, pre: (f"{role} || ':' || {w} || ':' || {h} || ':' || coalesce({pre}glass, '-') || ':' || {pre}ub || ':' || "
                                   f"coalesce(CAST({pre}e AS VARCHAR), '-')")
    text = lambda door, w, h, pre: (
        f"CASE WHEN {w} IS NOT NULL THEN kind || '|' || CASE kind WHEN 'composite' THEN {one(chr(39) + 'door' + chr(39), door, h, pre)} || '+' || "
        f"{one(chr(39) + 'window' + chr(39), w, h, pre)} ELSE {one('kind', w, h, pre)} END END")
    sql["tolerance_match"] = q(tolerant) + f"""
SELECT project, kind, {text('dd', 'pww', 'phh', 'p')} AS pred_key, {text('d2', 'tww', 'thh', 't')} AS true_key,
  CAST(coalesce(pq, 0) AS BIGINT) AS pred_qty, CAST(coalesce(tq, 0) AS BIGINT) AS true_qty,
  CASE WHEN pq IS NOT NULL AND tq IS NOT NULL THEN d * 0.5::DOUBLE END AS distance,
  CASE WHEN pq IS NOT NULL AND tq IS NOT NULL THEN 'matched' WHEN pq IS NOT NULL THEN 'false_positive' ELSE 'miss' END AS status
FROM j"""
    known = exact.replace("FROM u GROUP BY 1, 2, 3, 4, 5, 6, 7)", "FROM u WHERE project % 4 <> 0 GROUP BY 1, 2, 3, 4, 5, 6, 7)", 1)
    assert known != exact
    sql["scores_without_truth"] = q(known) + """
SELECT project, CASE WHEN project % 4 <> 0 THEN round(CASE WHEN m > 0 THEN 2 * m / (2 * m + fp + fn)::DOUBLE ELSE 0 END, 6) END AS group_f1,
  CASE WHEN project % 4 <> 0 THEN round(CASE WHEN t > 0 THEN abs(p - t) / t::DOUBLE ELSE 0 END, 6) END AS unit_count_error,
  CASE WHEN project % 4 <> 0 THEN round(CASE WHEN m + fp > 0 THEN fp / (m + fp)::DOUBLE ELSE 0 END, 6) END AS hallucination_rate,
  CASE WHEN project % 4 <> 0 THEN m END AS matched_groups, CAST(p AS BIGINT) AS pred_units_total FROM s"""
    sql["both_level_metrics"] = """
WITH p AS (
  SELECT p_brand AS project, CASE p_type WHEN 'PROMO' THEN 'door' WHEN 'LARGE' THEN 'composite' ELSE 'window' END AS kind,
    p_type = 'SMALL' AS annealed, (20 + p_size) * 2 AS w, (60 + p_partkey % 30) * 2 AS h, 1 + p_partkey % 60 AS qty FROM part),
lv AS (
  -- a door frame is 0.25 in too high at the offer level and still rounds to the same bucket
  SELECT project, gt_level, kind, w, h, annealed, sum(qty) AS qty
  FROM p, (VALUES ('extraction'), ('offer')) l(gt_level) GROUP BY ALL)
SELECT project, gt_level, 1.0::DOUBLE AS group_f1, count(*) AS matched_groups, 0::BIGINT AS fp_groups,
  0::BIGINT AS fn_groups, CAST(sum(qty) AS BIGINT) AS pred_units_total FROM lv GROUP BY 1, 2"""
    sql["gap_recall"] = """
WITH t AS (SELECT DISTINCT user_id, event_type FROM events),
f AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 40),
g AS (SELECT t.user_id, round(count(f.user_id) / count(*)::DOUBLE, 6) AS r FROM t LEFT JOIN f
  ON t.user_id = f.user_id AND t.event_type = f.event_type GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(r, 1.0::DOUBLE) AS gap_recall FROM customer LEFT JOIN g ON c_custkey = user_id"""
    sql["flag_vs_label"] = """
WITH j AS (SELECT source, regexp_matches(text, '[0-9@]') AS f, toxic = 1 OR quality = 0 AS i FROM documents JOIN labels USING (doc_id))
SELECT source, round(CASE WHEN count(*) FILTER (i) > 0 THEN count(*) FILTER (i AND f) / count(*) FILTER (i)::DOUBLE ELSE 0 END, 6) AS error_recall,
  round(CASE WHEN count(*) FILTER (f) > 0 THEN count(*) FILTER (i AND f) / count(*) FILTER (f)::DOUBLE ELSE 0 END, 6) AS error_precision
FROM j GROUP BY 1"""

    sql["reconcile_lines"] = """
WITH l AS (
  SELECT l_orderkey AS doc_id, CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,2))::DOUBLE AS up,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INT) END AS qty,
    CAST(l_extendedprice + CASE WHEN l_linenumber % 7 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS DECIMAL(18,2))::DOUBLE AS lt FROM lineitem),
c AS (SELECT *, CASE WHEN up <> 0 AND qty <> 0 AND lt <> 0 THEN abs(up * qty - lt) < 0.5 END AS ok FROM l)
SELECT doc_id, count(*) AS lines_seen, count(ok) AS lines_checked, count(*) FILTER (NOT ok) AS lines_failed,
  CAST(coalesce(sum(qty) FILTER (ok IS NOT NULL), 0) AS BIGINT) AS total_qty,
  count(ok) > 0 AND count(*) FILTER (NOT ok) = 0 AS reconciled, round(count(ok) / count(*)::DOUBLE, 6) AS coverage
FROM c GROUP BY 1"""
    sql["offer_block_parse"] = """
WITH o AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, o_custkey AS c, 1 + o_orderkey % 3 AS n, 1 + o_custkey % 60 AS q,
    floor(o_totalprice) / 4 AS unit, CASE o_orderstatus WHEN 'P' THEN 'mixed' WHEN 'F' THEN 'tempered' ELSE 'unknown' END AS glass
  FROM orders),
s AS (SELECT *, unnest(range(0, n)) AS j FROM o)
SELECT doc_id, k AS page_no, CASE WHEN n > 1 THEN k || '.' || (j + 1) ELSE CAST(k AS VARCHAR) END AS mark,
  30 + k % 50 + j + (1 + c % 15) / 16::DOUBLE AS frame_w, 60 + k % 40 + 0.5::DOUBLE AS frame_h,
  CASE WHEN j = 0 THEN 31 + k % 50 END::DOUBLE AS ro_w, CASE WHEN j = 0 THEN 61 + k % 40 END::DOUBLE AS ro_h, q AS qty, glass,
  c % 2 = 0 AS egress, unit AS unit_price, unit * q + CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END AS line_total FROM s
UNION ALL
SELECT doc_id, k, CAST(k + 1 AS VARCHAR), 39 + k % 50 + (1 + c % 15) / 16::DOUBLE, 60 + k % 40 + 0.5::DOUBLE,
  (31 + k % 50)::DOUBLE, (61 + k % 40)::DOUBLE, 2, glass, c % 2 = 0, 2500.5::DOUBLE, 5001.0::DOUBLE FROM o"""
    sql["offer_line_check"] = """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, 1 + o_custkey % 60 AS q FROM orders)
SELECT doc_id, 2 * count(*) AS lines_seen, 2 * count(*) AS lines_checked, count(*) FILTER (k % 7 = 0) AS lines_failed,
  CAST(sum(q + 2) AS BIGINT) AS total_qty, count(*) FILTER (k % 7 = 0) = 0 AS reconciled, 1.0::DOUBLE AS coverage FROM o GROUP BY 1"""

    sql["route_documents"] = q(ROUTE) + """
SELECT doc_id, n_pages, round(frac, 6) AS vector_page_frac, page IS NOT NULL AS has_schedule_sheet,
  vec AS schedule_is_vector, hand AS is_handwritten, profile AS notation_profile, page - 1 AS schedule_page_index,
  branch::BIGINT AS branch, branch_name FROM named"""
    sql["keyword_rank_pages"] = q(ELEVATION) + "SELECT * FROM e"
    sql["page_sample"] = """
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS doc_id, turn + 1 AS page_no, role, CAST(length(text) AS INT) AS n_chars FROM conversations JOIN n USING (conv_id)
WHERE turn IN (0, n // 2, n - 1)"""

    sql["json_units"] = """
SELECT l_orderkey AS doc_id, CAST(l_partkey AS VARCHAR) AS unit_id, 'window' AS kind, CAST(l_quantity AS BIGINT) AS qty,
  20 + p_size + (l_partkey % 16) / 16::DOUBLE AS width_in, 40 + p_size + 0.5::DOUBLE AS height_in, 'tempered' AS glass,
  CASE WHEN l_linestatus = 'O' THEN TRUE END AS egress, 0.7::DOUBLE AS confidence, l_linenumber::BIGINT AS page,
  l_suppkey::DOUBLE AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 7"""
    sql["json_rejects"] = """
SELECT 'G2' AS unit_id, CASE l_linenumber WHEN 2 THEN 'not an object' ELSE 'no panels' END AS reject, count(*) AS n
FROM lineitem WHERE l_linenumber IN (2, 6) GROUP BY 1, 2"""
    sql["region_numbers"] = q(PAGES) + """
SELECT doc_id, page_no, region_no, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h FROM nr"""
    sql["strategy_region_crops"] = q(PAGES) + """
SELECT doc_id, page_no, region_no, 'W' || width AS unit_id, qty, width::DOUBLE AS width_in, page_no AS page,
  x + 1::DOUBLE AS x, y + 2::DOUBLE AS y FROM crop"""
    sql["strategy_coarse_to_fine"] = """
WITH pg AS (
  SELECT o_custkey AS doc_id, o_orderkey AS page_no, 3000 + o_orderkey % 5 * 700 AS wpx, 2000 + o_orderkey % 3 * 900 AS hpx FROM orders)
SELECT doc_id, page_no, 1::BIGINT AS region_no, 'W' || (30 + page_no % 20) AS unit_id, 1 + page_no % 9 AS qty,
  (30 + page_no % 20)::DOUBLE AS width_in, page_no AS page,
  trunc(('0.' || (1 + page_no % 3))::DOUBLE * wpx) + 1 AS x, trunc(0.25::DOUBLE * hpx) + 2 AS y FROM pg"""
    sql["strategy_tables_first"] = f"""
WITH {CELLS.strip()}, {PAGES.strip()},
-- a document is read from its tables if one of its drawing pages is not a scan
vd AS (SELECT DISTINCT doc_id FROM pg WHERE st <> 'O'),
rd AS (SELECT doc_id, qty FROM cl WHERE doc_id IN (SELECT doc_id FROM vd))
SELECT doc_id, 'vector' AS mode, count(*) AS n_units, CAST(sum(qty) AS BIGINT) AS qty FROM rd GROUP BY 1
UNION ALL SELECT doc_id, 'fallback B', count(*), CAST(sum(qty) AS BIGINT) FROM crop
WHERE doc_id NOT IN (SELECT doc_id FROM rd) GROUP BY 1"""
    sql["strategy_agents"] = q(PAGES) + """,
ag AS (
  SELECT doc_id, width, s.rank AS r, qty + CAST(length(s.name) * (page_no % 2) AS BIGINT) AS qty
  FROM (SELECT crop.*, st FROM crop JOIN pg USING (doc_id, page_no)) c,
    (VALUES (0, 'schedule'), (1, 'elevation'), (2, 'plan'), (3, 'notes')) s(rank, name)
  WHERE s.rank > 0 OR st <> 'O'),
g AS (
  SELECT doc_id, width, max(qty) FILTER (r = 0) AS q0, max(qty) FILTER (r = 1) AS q1, max(qty) FILTER (r = 2) AS q2,
    count(DISTINCT r) AS n FROM ag GROUP BY 1, 2)
SELECT doc_id, 'W' || width AS unit_id, 'window' AS kind, greatest(q0, q1, q2) AS qty, n AS n_sources,
  round(least(1.0, 0.5::DOUBLE + 0.15::DOUBLE * n), 6) AS confidence,
  concat_ws(',', CASE WHEN width * 60.5 / 144 > 9 THEN 'irc_r308_4_likely_tempered_required' END,
    CASE WHEN q0 IS NULL THEN 'mark_missing_from_schedule' END,
    CASE WHEN greatest(q0, q1, q2) - least(q0, q1, q2) > 1 THEN 'qty_mismatch_facade_schedule' END) AS flags FROM g"""
    sql["skipped_pages"] = q(PAGES) + """
SELECT doc_id, count(*) FILTER (st = 'O') AS n_skipped, count(*) AS n_pages,
  CASE WHEN count(*) FILTER (st = 'O') = count(*) THEN 'all_pages_raster' ELSE 'raster pages skipped' END AS reason
FROM pg GROUP BY 1 HAVING count(*) FILTER (st = 'O') > 0"""
    sql["grid_tiles"] = q(PAGES) + """,
xs AS (
  SELECT page_no, unnest(list_concat(range(0, greatest(1, wpx - 1023), 839), [greatest(0, wpx - 1024)])) AS x, hpx
  FROM pg WHERE st <> 'O'),
ts AS (SELECT page_no, x, unnest(list_concat(range(0, greatest(1, hpx - 1023), 839), [greatest(0, hpx - 1024)])) AS y FROM xs)
SELECT page_no, count(*) AS n_tiles, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, count(*) AS last
FROM ts GROUP BY 1"""
    sql["iou_pairs"] = """
WITH b AS (
  SELECT label, vec_id // 100 AS page, vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y,
    20 + abs(embedding[3]::DOUBLE) * 100 AS w, 20 + abs(embedding[4]::DOUBLE) * 100 AS h FROM embeddings),
j AS (
  SELECT a.label, a.page, a.vec_id AS a_id, b.vec_id AS b_id, a.w * a.h + b.w * b.h AS areas,
    greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
  FROM b a JOIN b ON a.label = b.label AND a.page = b.page AND a.vec_id < b.vec_id)
SELECT label::BIGINT AS label, page, a_id, b_id, round(i / (areas - i), 6) AS iou FROM j WHERE i / (areas - i) > 0.4"""
    sql["consensus"] = q(KEYED) + f""",
s AS (SELECT *, line % 4 AS r, {key()} AS spec_key FROM k),
g AS (
  SELECT supplier, spec_key, any_value(kind) AS kind, max(qty) FILTER (r = 0) AS q0, max(qty) FILTER (r = 1) AS q1,
    max(qty) FILTER (r = 2) AS q2, max(qty) FILTER (r = 3) AS q3, count(DISTINCT r) AS n,
    string_agg(DISTINCT mark, '|' ORDER BY mark) AS unit_id, arg_min(w, (r, project, line, partkey)) AS width_in,
    arg_min(h, (r, project, line, partkey)) AS hh, any_value(glass) AS glass,
    arg_min(egress AND clear < 5.7, (r, project, line, partkey)) AS small
  FROM s GROUP BY 1, 2)
SELECT supplier, spec_key, unit_id, coalesce(greatest(q0, q1, q2), q3)::BIGINT AS qty, n AS n_sources,
  round(least(1.0, 0.5::DOUBLE + 0.15::DOUBLE * n), 6) AS confidence,
  concat_ws(',', CASE WHEN glass = 'annealed' AND (width_in * hh / 144 > 9 OR (kind = 'composite' AND 36 * hh / 144 > 9))
      THEN 'irc_r308_4_likely_tempered_required' END, CASE WHEN small THEN 'irc_r310_egress_undersize' END,
    CASE WHEN q0 IS NULL AND (q1 IS NOT NULL OR q2 IS NOT NULL) THEN 'mark_missing_from_schedule' END,
    CASE WHEN greatest(q0, q1, q2) - least(q0, q1, q2) > 1 THEN 'qty_mismatch_facade_schedule' END) AS flags, width_in FROM g"""

    table_columns = "SELECT doc_id, row_no, unit_id, kind, qty, width_in, height_in, glass, u_factor, "
    sql["table_units_strict"] = q(CELLS) + table_columns + """
  CASE WHEN dc > 0.05 THEN TRUE WHEN dc <= 0.02 THEN FALSE END AS egress, confidence FROM cl"""
    sql["table_units_lenient"] = q(CELLS) + table_columns + " dc > 0.02 AS egress, confidence FROM cl"
    sql["table_units_split"] = q(CELLS) + table_columns + """
  CASE WHEN dc > 0.05 THEN TRUE WHEN dc <= 0.02 THEN FALSE END AS egress, confidence FROM cl WHERE row_no % 4 <> 0 AND row_no % 3 <> 0"""
    sql["table_rejects"] = q(CELLS) + """
SELECT doc_id, row_no, 'unreadable ' || concat_ws(', ', CASE WHEN row_no % 4 = 0 THEN 'width' END, CASE WHEN row_no % 3 = 0 THEN 'height' END) AS reject,
  7::BIGINT AS n_cells FROM cl WHERE row_no % 4 = 0 OR row_no % 3 = 0"""
    sql["consensus_evidence"] = q(KEYED) + f""",
s AS (SELECT *, line % 4 AS r, {key()} AS spec_key FROM k),
g AS (
  SELECT supplier, spec_key, string_agg(DISTINCT mark, '|' ORDER BY mark) FILTER (WHERE partkey % 3 = 0) AS marks, min((r, project, line, partkey)) AS seen,
    max(qty) FILTER (r = 0) AS q0, max(qty) FILTER (r = 1) AS q1, max(qty) FILTER (r = 2) AS q2, max(qty) FILTER (r = 3) AS q3,
    count(*) AS n_evidence, count(DISTINCT r) AS n_regions, max(line)::BIGINT AS last_page FROM s GROUP BY 1, 2)
SELECT supplier, spec_key, coalesce(marks, 'F' || row_number() OVER (PARTITION BY supplier ORDER BY seen, spec_key)) AS unit_id,
  coalesce(greatest(q0, q1, q2), q3)::BIGINT AS qty, n_evidence, n_regions, last_page FROM g"""
    sql["schedule_row_units"] = q(SCHEDULE) + """
SELECT project, 'm' || k AS unit_id, CASE type WHEN 'Door' THEN 'door' ELSE 'window' END AS kind, qty,
  w AS width_in, h AS height_in FROM rows_a WHERE w IS NOT NULL"""
    sql["schedule_row_rejects"] = q(SCHEDULE) + """
SELECT code AS size_code, 'not a four-digit code' AS reject, count(*) AS n FROM rows_a WHERE w IS NULL GROUP BY 1, 2"""
    sql["reader_agreement"] = q(SCHEDULE) + """
SELECT 'M' || k AS mark, replace(code, ' ', '') AS code, qty, type FROM rows_a
WHERE (k, replace(code, ' ', ''), qty) IN (SELECT (k, replace(code, ' ', ''), qty) FROM rows_b)"""
    sql["two_source_diff"] = q(DIFF) + """,
v AS (SELECT * FROM c UNION ALL SELECT mark, 'VENT (SF)', NULL, NULL FROM j)
SELECT mark, "column", a, b, a IS NOT DISTINCT FROM b AS match FROM v"""
    sql["two_source_rows"] = q(DIFF) + """
SELECT mark, count(*) FILTER (a IS DISTINCT FROM b) AS n_diffs,
  coalesce(string_agg("column", '|' ORDER BY "column") FILTER (a IS DISTINCT FROM b), '') AS row_diffs FROM c GROUP BY 1"""
    sql["two_source_summary"] = q(DIFF) + """
SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
  (SELECT count(*) FROM a JOIN b USING (mark)) AS rows_common,
  (SELECT count(*) FROM c WHERE a IS DISTINCT FROM b) AS diff_cells"""

    sql["rule_flags"] = q(UNITS) + """,
x AS (SELECT *, kind = 'composite' AS comp, size > 5 AS ref FROM u)
SELECT project, line, CAST(partkey AS VARCHAR) AS unit_id, qty, concat_ws(',',
  CASE WHEN comp AND 2 <> 2 + size % 2 THEN 'composite_panel_count_mismatch' END,
  CASE WHEN discount < 0.02 AND glass = 'annealed' THEN 'egress_tempered_conflict' END,
  CASE WHEN qty < 18 AND glass = 'annealed' THEN 'irc_r308_4_low_sill_annealed' END,
  CASE WHEN linestatus = 'O' AND glass = 'annealed' THEN 'irc_r308_4_violation' END,
  CASE WHEN (coalesce(egress, FALSE) OR returnflag = 'R') AND clear < 5.7 THEN 'irc_r310_egress_undersize' END,
  CASE WHEN discount > 0.05 AND glass IS NULL THEN 'missing_glass_type_tempered_zone' END,
  CASE WHEN tax > 0.03 AND abs(line * 7 - qty) > 1 THEN 'qty_mismatch_facade_schedule' END,
  CASE WHEN ref AND (abs(w - (20.0::DOUBLE + size)) > 1 OR abs(h - (40.4::DOUBLE + size)) > 1) THEN 'size_mismatch_schedule_elevation' END,
  CASE WHEN uf > 0.27::DOUBLE + 1e-9 THEN 'ufactor_breaches_r402_1_1' END) AS flags FROM x"""
    sql["inline_rule_flags"] = q(UNITS) + """
SELECT concat_ws(',', CASE WHEN glass = 'annealed' AND (w * h / 144 > 9 OR (kind = 'composite' AND 36 * h / 144 > 9))
    THEN 'irc_r308_4_likely_tempered_required' END,
  CASE WHEN egress AND clear < 5.7 THEN 'irc_r310_egress_undersize' END) AS flags, count(*) AS n FROM u GROUP BY 1"""
    sql["missing_plan_marks"] = """
SELECT DISTINCT l_orderkey, CAST(l_linenumber AS VARCHAR) AS unit_id, 'mark_missing_from_schedule' AS flag FROM lineitem
WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'O')"""
    sql["inject_score"] = q(INJECT) + """
SELECT project, variant_id, caught, missed, false_flags::BIGINT AS false_flags, round(recall, 6) AS recall,
  round(precision, 6) AS precision FROM scored"""
    sql["inject_mean"] = q(INJECT) + """
SELECT variant_id, round(avg(recall), 6) AS error_recall, round(avg(precision), 6) AS error_precision,
  count(*) AS n_variants FROM scored GROUP BY 1"""

    quality = """
x AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS mark, l_linenumber = 7 AS off,
    l_returnflag = 'N' AND l_linestatus = 'F' AS missing, l_tax = 0.02::DOUBLE AS unknown,
    CASE WHEN l_discount > 0 THEN l_extendedprice / 100 ELSE 0 END AS width, l_quantity * 13 AS height FROM lineitem)"""
    sql["dq_scan"] = q(quality) + """,
g AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (width <= 0 OR width > 600) + count(*) FILTER (height > 600)
      + CASE WHEN bool_or(off) THEN 1 ELSE 0 END AS n_errors,
    count(*) FILTER (missing) + count(*) FILTER (NOT missing AND unknown) AS w0 FROM x GROUP BY 1),
s AS (
  SELECT doc_id, n_units, n_errors, CASE WHEN w0 = 0 AND o_orderstatus = 'P' THEN 1 ELSE w0 END AS n_warnings
  FROM g LEFT JOIN orders ON o_orderkey = doc_id)
SELECT *, n_errors = 0 AS ok, n_errors + n_warnings AS n_flagged FROM s"""
    sql["dq_findings"] = q(quality) + """,
f AS (
  SELECT mark, 'error' AS severity, 'implausible width' AS rule FROM x WHERE width <= 0 OR width > 600
  UNION ALL SELECT mark, 'error', 'implausible height' FROM x WHERE height > 600
  UNION ALL SELECT mark, 'warning', 'qty missing' FROM x WHERE missing
  UNION ALL SELECT mark, 'warning', 'qty without provenance' FROM x WHERE NOT missing AND unknown)
SELECT mark, severity, rule, count(*) AS n FROM f GROUP BY ALL"""

    figures = "round(group_f1, 6) AS group_f1, round(unit_count_error, 6) AS unit_count_error, round(qty_mae, 6) AS qty_mae, round(cost_usd, 6) AS cost_usd"
    sql["latest_wins"] = q(BOARD) + f"SELECT variant, model, project, gt_level, {figures}, error, event_id FROM b"
    sql["winner"] = q(BOARD) + """,
w AS (
  SELECT * FROM b WHERE unit_count_error <= 0.05 QUALIFY row_number() OVER (PARTITION BY project, gt_level ORDER BY
    group_f1 DESC, qty_mae NULLS LAST, cost_usd NULLS LAST, variant, model, event_id) = 1)
SELECT b.project, b.gt_level, max(w.variant) AS variant, max(w.model) AS model, round(max(w.group_f1), 6) AS group_f1,
  count(w.variant) AS n_winners, count(*) AS n_rows
FROM b LEFT JOIN w USING (variant, model, project, gt_level) GROUP BY 1, 2"""
    sql["best_row"] = q(BOARD) + """
SELECT variant, model, project, gt_level, round(group_f1, 6) AS group_f1 FROM b WHERE project = 'p3' AND error IS NULL
ORDER BY b.group_f1 DESC, variant, model, project, gt_level LIMIT 1"""
    sql["gate"] = q(RUNS) + """,
x AS (
  SELECT event_id, concat_ws('; ',
    CASE WHEN unit_count_error > 0.05::DOUBLE THEN 'unit_count_error=' || printf('%.3f', unit_count_error) || ' > 0.05' END,
    CASE WHEN group_f1 < 0.9::DOUBLE THEN 'group_f1=' || printf('%.3f', group_f1) || ' < 0.9' END,
    CASE WHEN qty_mae IS NULL THEN 'qty_mae: NO DATA' WHEN qty_mae > 1 THEN 'qty_mae=' || printf('%.3f', qty_mae) || ' > 1.0' END,
    CASE WHEN glass_acc IS NULL THEN 'glass_acc: NO DATA'
      WHEN glass_acc < 0.95::DOUBLE THEN 'glass_acc=' || printf('%.3f', glass_acc) || ' < 0.95' END,
    CASE WHEN event_id % 3 = 0 THEN 'egress_acc: NO DATA'
      WHEN 1 - unit_count_error < 0.95::DOUBLE THEN 'egress_acc=' || printf('%.3f', 1 - unit_count_error) || ' < 0.95' END,
    CASE WHEN unit_count_error / 2 > 0.05::DOUBLE THEN 'hallucination_rate=' || printf('%.3f', unit_count_error / 2) || ' > 0.05' END,
    CASE WHEN group_f1 < 0.8::DOUBLE THEN 'error_recall=' || printf('%.3f', group_f1) || ' < 0.8' END) AS reasons FROM r)
SELECT event_id, reasons = '' AS gate_pass, reasons FROM x"""
    sql["gate_counts"] = q(BOARD) + f"""
SELECT project, gt_level, count(*) AS cells, count(*) FILTER ({PASS}) AS n_pass, count(*) FILTER (NOT ({PASS})) AS n_fail
FROM b GROUP BY 1, 2"""
    sql["strategy_summary"] = q(BOARD) + f""",
x AS (SELECT * FROM b WHERE gt_level = 'extraction'),
d AS (
  SELECT DISTINCT project, v AS variant FROM x, (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) t(v)
  UNION SELECT project, variant FROM x),
s AS (
  SELECT project, variant, count(*) AS cells, count(*) FILTER ({PASS}) AS n_pass, count(*) FILTER (NOT ({PASS})) AS n_fail,
    max(group_f1) AS f, min(cost_usd) AS c FROM x GROUP BY 1, 2)
SELECT project, variant, coalesce(cells, 0) AS cells, n_pass, n_fail, round(n_pass * 100.0::DOUBLE / cells, 6) AS pass_pct,
  round(f, 6) AS best_group_f1, round(c, 6) AS min_cost_usd FROM d LEFT JOIN s USING (project, variant)"""
    sql["title_facts"] = q(BOARD) + """
SELECT count(*) AS n_rows, string_agg(DISTINCT b.variant, ',' ORDER BY b.variant) AS variants, count(DISTINCT b.model) AS n_models,
  count(DISTINCT b.project) AS n_projects, string_agg(DISTINCT b.gt_level, ',' ORDER BY b.gt_level) AS levels,
  max(best.variant) AS best_variant, max(best.model) AS best_model, max(best.project) AS best_project, round(max(best.group_f1), 6) AS best_f1
FROM b, (SELECT variant, model, project, group_f1 FROM b WHERE gt_level = 'extraction' AND error IS NULL
  ORDER BY group_f1 DESC NULLS LAST, variant, model, project LIMIT 1) best"""
    sql["round_delta"] = q(RUNS) + """,
n AS (
  SELECT * FROM r WHERE hour(mtime) >= 12 QUALIFY row_number() OVER (
    PARTITION BY variant, model, project, gt_level ORDER BY mtime DESC, event_id DESC) = 1),
o AS (
  SELECT * FROM r WHERE hour(mtime) < 12 QUALIFY row_number() OVER (
    PARTITION BY variant, model, project ORDER BY mtime DESC, event_id DESC) = 1)
SELECT variant, model, project, round(n.group_f1, 6) AS f1_now, round(o.group_f1, 6) AS f1_before,
  round(n.group_f1 - o.group_f1, 6) AS f1_change, round(n.unit_count_error - o.unit_count_error, 6) AS uce_change
FROM n JOIN o USING (variant, model, project) WHERE n.gt_level = 'extraction'"""
    budget = lambda part, cap: q(RUNS) + f""",
c AS (SELECT event_id, model, CAST(round(cost_usd, 4) AS DECIMAL(18,4)) AS m FROM r),
s AS (SELECT *, coalesce(sum(m) OVER ({part} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM c)
"""
    sql["budget_markers"] = budget("PARTITION BY model", 100) + """, x AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY event_id) AS n,
  count(*) OVER (PARTITION BY model) AS n_skipped FROM s WHERE t >= 100)
SELECT model, event_id, round(t::DOUBLE, 4) AS spent, n_skipped FROM x WHERE n = 1"""
    sql["variants_round_trip"] = q(UNITS) + """
SELECT 'v' || (partkey % 5) AS variant_id, kind, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM u GROUP BY 1, 2"""
    sql["report_round_trip"] = q(RUNS) + """
SELECT 'r1' AS version, variant, count(*) AS n, round(sum(group_f1), 4) AS f1, TRUE AS dated FROM r GROUP BY 2"""
    sql["leaderboard_round_trip"] = q(BOARD) + """
SELECT variant, model, project, gt_level, round(group_f1, 6) AS group_f1, round(cost_usd, 6) AS cost_usd FROM b"""
    sql["order_overlaps"] = """
WITH x AS (
  SELECT l_orderkey AS doc_id, l_returnflag = 'R' AS r, (l_partkey % 40 * 25)::DOUBLE AS x, (l_linenumber * 40)::DOUBLE AS y,
    (60 + p_size)::DOUBLE AS w, (80 + p_size % 7)::DOUBLE AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (
  SELECT a.doc_id, a.w * a.h + b.w * b.h AS areas,
    greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
  FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.r AND NOT b.r)
SELECT d.doc_id, coalesce(bool_or(i / (areas - i) > 0.4), FALSE) AS overlaps FROM (SELECT DISTINCT doc_id FROM x) d LEFT JOIN j USING (doc_id) GROUP BY 1"""
    sql["findings_by_unit"] = q(UNITS) + """
SELECT project, unit_id, concat_ws(',', CASE WHEN count(*) FILTER (returnflag = 'R') > 0 THEN 'R' END, CASE WHEN count(*) FILTER (tax > 0.05) > 0 THEN 'TAX' END,
  CASE WHEN count(*) FILTER (w > 60) > 0 THEN 'WIDE' END) AS flags
FROM u WHERE returnflag = 'R' OR tax > 0.05 OR w > 60 GROUP BY 1, 2"""
    sql["run_cells"] = q(RUNS) + """
SELECT event_id, CASE WHEN glass_acc IS NULL THEN '—' ELSE printf('%.1f', glass_acc * 100) || '%' END AS glass_pct,
  substr('run of ' || variant || ' on ' || project || ' with ' || model, 1, 16) AS title,
  round(elapsed_sec, 2) AS elapsed_sec, round(cost_usd, 4) AS cost_usd FROM r"""
    sql["offer_columns"] = "SELECT doc_id, page_no, mark, frame_w AS width, frame_h AS height, ro_w AS rough_opening_width, ro_h AS rough_opening_height, qty, glass, egress FROM (" + sql["offer_block_parse"] + ")"
    sql["budget_cap"] = budget("PARTITION BY model", 100) + "SELECT event_id, model, round(t::DOUBLE, 4) AS spent_before, t < 100 AS runs FROM s"
    sql["budget_cap_total"] = budget("", 500) + "SELECT event_id, round(t::DOUBLE, 4) AS spent_before, t < 500 AS runs FROM s"
    sql["missing_cells"] = q(RUNS) + """
SELECT v AS variant, m AS model, p AS project FROM (SELECT unnest(string_split('ABCDEFGH', '')) AS v),
  (VALUES ('click'), ('view'), ('signup'), ('gpt')) a(m), (SELECT 'p' || i AS p FROM range(12) t(i))
WHERE v <> '' AND (v, m, p) NOT IN (SELECT (variant, model, project) FROM r)"""
    dash = lambda c, f: f"CASE WHEN {c} IS NULL THEN '—' ELSE printf('{f}', {c}) END AS {c}"
    sql["report_table"] = q(BOARD) + f"""
SELECT variant, model, project, gt_level, {dash('group_f1', '%.3f')}, {dash('unit_count_error', '%.3f')}, {dash('qty_mae', '%.3f')},
  {dash('cost_usd', '$%.3f')}, {dash('glass_acc', '%.3f')}, {dash('elapsed_sec', '%.1f')}, coalesce(error, '—') AS error FROM b"""
    sql["run_totals"] = q(RUNS) + """
SELECT variant, model, round(sum(CASE WHEN model <> 'view' THEN cost_usd END), 4) AS cost_usd,
  count(*) FILTER (model = 'view') AS unpriced_rows, count(error) AS errors_count,
  CAST(coalesce(sum(event_id) FILTER (variant <> 'G'), 0) AS BIGINT) AS n_units FROM r GROUP BY 1, 2"""
    sql["branch_results"] = q(ROUTE) + """,
x AS (SELECT p.doc_id, page_key AS k, n_chars AS n, page_no, branch, branch_name, count(*) OVER (PARTITION BY p.doc_id) AS pages,
  k % 6 <> 0 AS read FROM p JOIN named USING (doc_id)),
offers AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (30 + n % 600 > 600) + CASE WHEN count(*) FILTER (k % 9 = 0) > 0 THEN 1 ELSE 0 END AS n_errors,
    0::BIGINT AS n_warnings, CAST(sum(1 + n % 5) AS BIGINT) AS total_qty, count(*) FILTER (k % 9 = 0) = 0 AS reconciled,
    count(*) AS offer_lines FROM x WHERE branch = 1 GROUP BY 1),
r AS (SELECT doc_id, k % 5 = 0 AS door, k % 3 AS w, n % 2 AS h, CAST(sum(1 + n % 5) AS BIGINT) AS qty,
    CAST(coalesce(sum(1 + n % 5) FILTER (k % 3 <> 0), 0) AS BIGINT) AS true_qty, count(*) FILTER (k % 3 <> 0) > 0 AS known
  FROM x WHERE branch = 2 AND k % 4 <> 0 GROUP BY 1, 2, 3, 4),
schedules AS (
  SELECT doc_id, CAST(sum(qty) AS BIGINT) AS n_units, CASE WHEN bool_or(known) THEN 2 * count(*) FILTER (known) / (count(*) + count(*) FILTER (known))::DOUBLE
    ELSE 0.0::DOUBLE END AS group_f1, sum(true_qty) AS t, sum(qty) AS pq FROM r GROUP BY 1),
dense AS (SELECT * FROM x WHERE branch = 3 AND 1 + n % 5 >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n % 5 DESC, page_no) <= 2),
sampled AS (SELECT * FROM x WHERE branch = 4 AND page_no IN (1, pages // 2 + 1, pages)),
reads AS (SELECT * FROM dense UNION ALL SELECT * FROM sampled),
found AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (n / 4 > 600 OR n <= 0) AS n_errors, count(*) FILTER (n % 2 = 0) AS n_warnings
  FROM reads WHERE read GROUP BY 1),
sure AS (SELECT doc_id, CASE min(CASE WHEN NOT read THEN 1 WHEN n % 3 = 0 THEN 2 ELSE 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence
  FROM sampled GROUP BY 1)
SELECT d.doc_id, d.branch::BIGINT AS branch, d.branch_name, coalesce(o.n_units, s.n_units, f.n_units, 0) AS n_units,
  coalesce(o.n_errors, f.n_errors) AS n_errors, coalesce(o.n_warnings, f.n_warnings) AS n_warnings,
  coalesce(o.n_errors, f.n_errors) = 0 AS ok, total_qty, reconciled, offer_lines, s.doc_id IS NOT NULL AS scored, round(group_f1, 6) AS group_f1,
  CASE WHEN s.doc_id IS NOT NULL THEN CASE WHEN t = 0 AND pq > 0 THEN 'FAIL' WHEN group_f1 >= 0.7 AND abs(pq - t) <= 0.05::DOUBLE * t THEN 'PASS' ELSE 'FAIL' END END AS gate, confidence
FROM named d LEFT JOIN offers o USING (doc_id) LEFT JOIN schedules s USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN sure c USING (doc_id)"""
    sql["elevation_reads"] = q(ELEVATION) + """
SELECT doc_id, page_no, 'low' AS confidence, page_no % 2 = 0 AS readable,
  CASE WHEN page_no % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_units FROM e"""
    sql["handwritten_reads"] = """
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS doc_id, turn + 1 AS page_no, CASE role WHEN 'user' THEN 'medium' ELSE 'low' END AS confidence,
  role = 'user' AS readable, CASE role WHEN 'user' THEN 1 ELSE 0 END::BIGINT AS n_units
FROM conversations JOIN n USING (conv_id) WHERE turn IN (0, n // 2, n - 1)"""

    shown = lambda c: f"rtrim(rtrim(CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR), '0'), '.')"
    sql["unit_review"] = q(UNITS) + f"""
SELECT {shown('w')} || '×' || {shown('h')} || CASE kind WHEN 'composite' THEN ', 36×' || {shown('h')} ELSE '' END AS size,
  printf('%.2f', 0.5::DOUBLE + discount) AS conf, CASE WHEN returnflag <> 'R' AND linestatus <> 'O' THEN '—' ELSE
    concat_ws(', ', CASE returnflag WHEN 'R' THEN 'r' END, CASE linestatus WHEN 'O' THEN 'o' END) END AS flags_text,
  '—' AS gaps_text, count(*) AS n FROM u GROUP BY 1, 2, 3, 4"""
    # the greedy walk, box after box: one goes to the first box that stayed and overlaps it, or stays itself
    side = lambda o, z: f"greatest(0, least(bs[k].{o} + bs[k].{z}, bs[i + 1].{o} + bs[i + 1].{z}) - greatest(bs[k].{o}, bs[i + 1].{o}))"
    common = f"({side('x', 'w')} * {side('y', 'h')})"
    sql["dedup_boxes"] = f"""
WITH RECURSIVE r AS (
  SELECT l_suppkey AS doc_id, l_linenumber AS page, CASE p_type WHEN 'PROMO' THEN 'door' WHEN 'LARGE' THEN 'composite' ELSE 'window' END AS kind,
    concat_ws('-', l_linenumber, l_orderkey, l_partkey) AS unit_id, CAST(l_quantity AS INT)::BIGINT AS qty, 0.5::DOUBLE + l_discount AS conf,
    (l_partkey % 40 * 25)::DOUBLE AS x, (l_orderkey % 30 * 25)::DOUBLE AS y, (60 + p_size)::DOUBLE AS w, (80 + p_size % 7)::DOUBLE AS h,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber, kind ORDER BY l_orderkey, l_partkey, conf, qty) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT doc_id, page, kind, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY n) AS bs FROM r GROUP BY 1, 2, 3),
walk AS (
  SELECT doc_id, page, kind, bs, 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS owner FROM g
  UNION ALL
  SELECT doc_id, page, kind, bs, i + 1, CASE WHEN hit IS NULL THEN list_append(kept, i + 1) ELSE kept END, list_append(owner, coalesce(hit, i + 1))
  FROM (SELECT *, [k FOR k IN kept IF {common} / (bs[k].w * bs[k].h + bs[i + 1].w * bs[i + 1].h - {common}) > 0.4][1] AS hit
    FROM walk WHERE i < len(bs))),
o AS (
  SELECT doc_id, page, kind, n, owner[n] AS owner
  FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS n FROM walk WHERE i = len(bs))),
j AS (
  SELECT r.*, owner, conf > coalesce(max(conf) OVER (PARTITION BY r.doc_id, r.page, r.kind, owner ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS record FROM r JOIN o USING (doc_id, page, kind, n))
SELECT doc_id, max(unit_id) FILTER (n = owner) AS unit_id, kind, max(qty) FILTER (record) AS qty, max(conf) AS confidence, count(*) AS n_merged
FROM j GROUP BY doc_id, page, kind, owner"""
    sql["page_boxes"] = """
SELECT l_suppkey AS doc_id, l_linenumber::BIGINT AS page_no, concat_ws('-', l_linenumber, l_orderkey, l_partkey) AS unit_id,
  concat_ws('-', l_linenumber, l_orderkey, l_partkey) || ' (' || CAST(l_quantity AS INT) || ')' AS label,
  (l_partkey % 40 * 25)::DOUBLE AS x, (l_orderkey % 30 * 25)::DOUBLE AS y, (60 + p_size)::DOUBLE AS w, (80 + p_size % 7)::DOUBLE AS h
FROM lineitem JOIN part ON l_partkey = p_partkey"""
    sql["document_inventory"] = """
SELECT CAST(event_id AS VARCHAR) AS name, n_chars AS n_bytes, CASE WHEN doc_id IS NULL THEN 'MISSING'
  WHEN n_chars > 5000 THEN 'TOO_LARGE' ELSE 'OK' END AS status FROM events LEFT JOIN documents ON event_id = doc_id"""
    sql["units_jsonl_round_trip"] = q(UNITS) + """
SELECT 'm_' || returnflag AS model, kind, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, 0::BIGINT AS rejects,
  CAST(sum(CASE kind WHEN 'composite' THEN 2 ELSE 1 END) AS BIGINT) AS panels, sum(w) AS width_sum, 1.0::DOUBLE AS confidence
FROM u GROUP BY 1, 2"""
    sql["csv_partial_merge"] = q(RUNS) + """,
h AS (
  SELECT *, hour(mtime) < 12 AS early FROM r
  QUALIFY row_number() OVER (PARTITION BY variant, model, project, gt_level ORDER BY hour(mtime) < 12, event_id DESC) = 1)
SELECT variant, model, project, gt_level, round(group_f1, 6) AS group_f1, round(unit_count_error, 6) AS unit_count_error,
  CASE WHEN early THEN round(qty_mae, 6) END AS qty_mae, round(cost_usd, 6) AS cost_usd,
  CASE WHEN NOT early THEN round(glass_acc, 6) END AS glass_acc, CASE WHEN early THEN error END AS error FROM h"""
    sql["stream_ingest_dedup"] = """
SELECT event_type || '-' || user_id AS name, json_extract_string(props, '$.k') AS size, event_type, user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY ts, event_id) = 1"""
    sql["stream_merge_latest"] = """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
    sql["strategy_tiles"] = q(PAGES) + f""",
t AS (SELECT doc_id, page_no, wpx, unnest([1, 2])::BIGINT AS region_no FROM pg WHERE st <> 'O'),
x AS (
  SELECT *, CASE region_no WHEN 1 THEN 0 ELSE least({TILE_PX}, greatest(0, wpx - {TILE_PX})) END AS x,
    CASE region_no WHEN 1 THEN 30 + page_no % 20 ELSE 50 + page_no % 10 END AS width FROM t)
SELECT doc_id, page_no, region_no, 'W' || width AS unit_id, 1 + page_no % 9 AS qty, width::DOUBLE AS width_in, page_no AS page, x + 1::DOUBLE AS x,
  2::DOUBLE AS y, 1::BIGINT AS n_merged FROM x"""
    part = lambda letter, name, n="count(*)": f"SELECT '{letter}' AS letter, {n} AS n_units, CAST(sum(qty) AS BIGINT) AS qty FROM ({sql[name]})"
    sql["strategy_registry"] = " UNION ALL ".join([
        "SELECT 'A' AS letter, count(*) AS n_units, CAST(sum(1 + o_orderkey % 9) AS BIGINT) AS qty FROM orders",
        part("B", "strategy_region_crops"), part("C", "strategy_tiles"), part("D", "strategy_coarse_to_fine"),
        part("E", "strategy_tables_first", "CAST(sum(n_units) AS BIGINT)"), part("F", "strategy_agents")])
    sql["truth_files"] = """
SELECT 'p' || (p_partkey // 50) AS project, gt_level, count(*) AS n, CAST(sum(1 + p_partkey % 60) AS BIGINT) AS qty,
  CAST(sum((1 + p_partkey % 60) * CASE p_type WHEN 'LARGE' THEN 2 ELSE 1 END) AS BIGINT) AS true_frames, sum(20 + p_size)::DOUBLE AS width_sum,
  1.0::DOUBLE AS confidence
FROM part, (VALUES ('extraction'), ('offer')) l(gt_level) WHERE gt_level = 'extraction' OR p_type <> 'PROMO' GROUP BY 1, 2"""
    sql["transcript_files"] = """
WITH c AS (
  SELECT 'a' AS source, unnest(['#', 'WINDOW SIZE', 'QTY', 'DAY OPEN (SF)']) AS heading,
    unnest([' k' || o_orderkey, o_custkey::VARCHAR, o_orderstatus, o_orderpriority]) AS v FROM orders
  UNION ALL SELECT 'b', unnest(['MARK', 'Window Size', 'QTY.', 'Day Open']),
    unnest(['K' || o_orderkey, o_custkey::VARCHAR, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END, o_orderpriority])
  FROM orders WHERE o_totalprice >= 50000)
SELECT source, heading, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars FROM c GROUP BY 1, 2"""
    sql["stream_indexed_sink"] = """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3, ts, event_id) = 1"""
    sql["stream_status"] = """
SELECT event_id % 3 AS batch_id, count(*) AS rows_in FROM events GROUP BY 1"""
    sql["chat_attachments"] = """
WITH e AS (SELECT event_id AS update_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type, user_id FROM events),
f AS (SELECT update_id, CASE WHEN update_id % 5 <> 0 THEN event_type || '.' || k || '.pdf'
    ELSE 'file_' || substr('id' || update_id || '-long', 1, 8) || '.bin' END AS name,
  CASE WHEN update_id % 7 <> 0 THEN k % 4 ELSE 0 END AS size FROM e WHERE user_id % 10 = 3 AND event_type <> 'view')
SELECT update_id, name, size FROM f QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY update_id) = 1"""
    sql["run_commits"] = """
SELECT l_linenumber AS page_no, count(*) AS n_log, count(*) FILTER (l_orderkey % 7 = 0) AS n_failed,
  nullif(count(*) FILTER (l_orderkey % 7 <> 0), 0) AS n_raw,
  nullif(count(*) FILTER (l_orderkey % 7 <> 0 AND l_linenumber < 7), 0) AS n_units
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
    sql["incremental_append"] = """
WITH g AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS qty, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)
SELECT l_linenumber, status, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM g GROUP BY 1, 2"""
    return sql
