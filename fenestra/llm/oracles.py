"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from fenestra.llm import bisector_clusters as clusters
from fenestra.llm.lexical_masks import TOP
from fenestra.llm.poisson_mix import SEED, TEMPERATURE
from fenestra.llm.quality_rules import BASE, BIT, DEFAULT, STRICT

#: Words of a text: runs of anything but the space and the five control white spaces.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op1() -> str:
    bits = f"""(CASE WHEN n_words < 20 THEN {BIT['few_words']} ELSE 0 END
      + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN {BIT['repeated_windows']} ELSE 0 END
      + CASE WHEN 10 * n_symbols > 3 * n_words THEN {BIT['symbols']} ELSE 0 END
      + CASE WHEN 5 * n_upper > 2 * word_chars THEN {BIT['capitals']} ELSE 0 END
      + CASE WHEN 2 * n_exclaim > n_words THEN {BIT['exclamations']} ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN {BIT['word_length']} ELSE 0 END
      + CASE WHEN 2 * n_dup_lines > n_lines THEN {BIT['repeated_lines']} ELSE 0 END)"""
    keeps = lambda p, bits="fail_bits": f"(({bits} & {p.veto}) = 0 AND bit_count({bits} & {p.advisory}) <= {p.allowed})"
    decides = ", ".join(f"CASE WHEN NOT {keeps(DEFAULT)} AND {keeps(DEFAULT, f'(fail_bits & ~{b}::BIGINT)')} THEN '{n}' END"
                        for n, b in BIT.items() if b & (DEFAULT.veto | DEFAULT.advisory))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY r),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN again USING (r, g), range(0, 8) AS t(k) GROUP BY r),
m AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(w) for w in ws]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]'))::BIGINT AS n_upper,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaim
  FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, {bits}::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT {keeps(BASE)} AS base_failed, {keeps(BASE)} AND {keeps(DEFAULT)} AS kept,
  n_lines, n_upper, n_exclaim, fail_bits, '{DEFAULT.version}' AS policy, {keeps(BASE)} AND {keeps(STRICT)} AS kept_strict,
  concat_ws(',', {decides}) AS decided_by, count(*) OVER (PARTITION BY fail_bits) AS same_bits
FROM b"""


def _op9() -> str:
    return f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS v FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN v > 0 THEN pow(v, {TEMPERATURE}) ELSE 0.0 END AS w FROM s),
rates AS (SELECT source, CASE WHEN v > 0 THEN round(w / (SELECT sum(w) FROM w) * (SELECT sum(v) FROM w) / v, 9)
  ELSE 1.0 END AS rate FROM w),
terms AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT) + 1)) AS k FROM rates),
cdf AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM terms),
lists AS (SELECT source, rate, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, rate),
drawn AS (SELECT d.*, rate, len(list_filter(cdf, lambda c: c <=
    ('0x' || substr(md5('count:{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN lists ON d.source IS NOT DISTINCT FROM lists.source),
copies AS (SELECT *, unnest(range(0, n)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, rate,
  ('0x' || substr(md5('order:{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS order_key
FROM copies"""


def _op4() -> str:
    part = lambda i: f"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', {i})"
    host = f"regexp_replace(lower({part(2)}), '^.*@', '')"
    pairs = f"list_sort(list_filter(string_split(substr({part(4)}, 2), '&'), lambda x: x <> ''))"
    key = f"""lower({part(1)}) || '://' || CASE lower({part(1)}) WHEN 'http' THEN regexp_replace({host}, ':80$', '')
      WHEN 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END
      || CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END
      || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END"""
    return f"""
WITH p AS (SELECT page_id AS k, {key} AS url_key, '"' || substr(md5(html), 1, 16) || '"' AS etag, strlen(html) AS bytes,
  'day ' || (page_id % 24) AS modified FROM pages),
full_responses AS (SELECT 2 * k AS rid, url_key, etag, bytes, modified, k * 60 AS seen FROM p WHERE k % 13 <> 5
  UNION ALL SELECT -k - 1, url_key, '"old"', 7, modified, k * 60 - 100 FROM p WHERE k % 3 = 0
  UNION ALL SELECT -k - 1, url_key, '"new"', 7, modified, k * 60 + 9010 FROM p WHERE k % 3 = 1),
visits AS (SELECT k, url_key, k * 60 + 5000 AS seen, modified,
  CASE WHEN k % 5 = 0 THEN 'W/' || etag WHEN k % 11 = 1 THEN '"other"' WHEN k % 6 <> 1 THEN etag END AS etag FROM p),
j AS (SELECT v.k, v.url_key, v.seen, v.etag, f.rid, f.seen AS fat, f.bytes, f.etag AS fetag, f.modified AS fmodified,
  CASE WHEN f.rid IS NULL THEN 'orphan'
    WHEN CASE WHEN v.etag IS NOT NULL THEN regexp_replace(v.etag, '^W/', '') = f.etag ELSE v.modified = f.modified END
    THEN 'resolved' ELSE 'mismatch' END AS status
  FROM visits v ASOF LEFT JOIN full_responses f ON v.url_key = f.url_key AND v.seen > f.seen)
SELECT 2 * k + 1 AS record_id, url_key, seen AS date, status, CASE WHEN status = 'resolved' THEN rid END AS refers_to,
  CASE WHEN status = 'resolved' THEN fat END AS refers_to_date,
  CASE WHEN status = 'resolved' THEN array_to_string(['cache-control: max-age=60', 'content-length: ' || bytes,
    'content-type: text/html', 'date: ' || seen, 'etag: ' || coalesce(etag, fetag), 'expires: in ' || (k % 7),
    'last-modified: ' || fmodified], chr(10)) END AS headers
FROM j"""


def _op12() -> str:
    terms = lambda text: (f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {terms('text')} AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({terms('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM d, s),
found AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0)
WHERE rank <= {TOP}"""


def _op13() -> str:
    k, d = clusters.K, clusters.DIMENSION
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: floor({clusters.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: isfinite(x))) = {d})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id), vec_id) - 1 AS c, x FROM v
  QUALIFY c < {k})"""]
    for i in range(clusters.ROUNDS + 1):
        away = "list_sum(list_transform(list_zip(v.x, s.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(x) AS x, min(near) % {k} AS c, min(near) // {k} AS distance
  FROM (SELECT v.r, v.vec_id, v.x, ({away} * {k} + s.c)::BIGINT AS near FROM v, c{i} s) GROUP BY r, vec_id)""")
        if i < clusters.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN
  (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n
    FROM a{i}, range(1, {d + 1}) AS t(i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    last = clusters.ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_ledger": _op1(), "op4_warc_revisits": _op4(), "op9_poisson_mix": _op9(), "op12_mask_search": _op12(),
            "op13_bisector_clusters": _op13()}
