"""Registered queries: text -> route resolution and chat-history shaping (survey C11, C12, E5-E11, H21-H27, H33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skydelay.operators import chat as C
from skydelay.operators import geo_text as G
from skydelay.plans.queries import V, query
from skydelay.plans.queries_schedule import airports_idx

# ---- DuckDB expression builders for the oracles ---------------------------------------------------------------
EDGE_SQL = r"[ \t\r\n,.;:!?()\[\]{}]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in G.STOP_WORDS) + "]"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower(trim({x})), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def fragment_sql(x: str) -> str:
    edge = f"'^{EDGE_SQL}+|{EDGE_SQL}+$'"
    t = f"regexp_replace(COALESCE({x}, ''), {edge}, '', 'g')"
    t = f"regexp_replace({t}, '(?is)\\s+(?:{'|'.join(G.FRAGMENT_CUT_WORDS)})\\b.*$', '')"
    t = f"regexp_replace({t}, '(?i)^(?:{'|'.join(G.LEADING_ARTICLES)})\\s+', '')"
    return f"regexp_replace({t}, {edge}, '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({key_sql(x)}, ' '), lambda t: t <> '' AND NOT list_contains({STOP_SQL}, t)))"


def fragments_df(spark, sf):
    q = V(spark, sf, "questions")
    pieces = F.split(F.regexp_replace("question", " (para|to|for|de) ", "|"), r"\|")
    return q.select(F.explode(pieces).alias("fragment")).where(F.col("fragment") != "").distinct()


FRAGMENTS_SQL = """frags0 AS (SELECT DISTINCT fragment FROM (
  SELECT unnest(string_split(regexp_replace(question, ' (para|to|for|de) ', '|', 'g'), '|')) AS fragment FROM questions) t
  WHERE fragment <> ''),
frags AS (SELECT fragment AS fkey, c AS cleaned, """ + key_sql("c") + " AS key, " + tokens_sql("c") + """ AS tokens
  FROM (SELECT fragment, """ + fragment_sql("fragment") + """ AS c FROM frags0) t),
idx AS (SELECT iata_code, country, city, airport_name, """ + key_sql("country") + """ AS country_norm,
  COALESCE(""" + key_sql("city") + """, '') AS city_norm, COALESCE(""" + key_sql("airport_name") + """, '') AS name_norm,
  COALESCE(""" + tokens_sql("city") + """, []) AS city_tokens, COALESCE(""" + tokens_sql("airport_name") + """, []) AS name_tokens,
  row_number() OVER (ORDER BY country NULLS LAST, city NULLS LAST, airport_name NULLS LAST, iata_code NULLS LAST) AS ord
  FROM airports_idx)"""

EXACT_SQL = """
l0 AS (SELECT fkey, 0 AS level, arg_min(country, pos) AS country, arg_min(code, pos) AS airport FROM (
  SELECT fkey, unnest(arr) AS code, generate_subscripts(arr, 1) AS pos FROM (
    SELECT fkey, regexp_extract_all(upper(cleaned), '\\b([A-Za-z0-9]{3})\\b', 1) AS arr FROM frags WHERE cleaned <> '') a) c
  JOIN idx ON idx.iata_code = c.code GROUP BY fkey),
lv1 AS (SELECT fkey, count(DISTINCT iata_code) AS nc, count(DISTINCT country) AS nk, min(iata_code) AS code, min(country) AS ctry
  FROM frags JOIN idx ON frags.key = idx.name_norm WHERE frags.key <> '' GROUP BY fkey),
lv2 AS (SELECT fkey, count(DISTINCT iata_code) AS nc, count(DISTINCT country) AS nk, min(iata_code) AS code, min(country) AS ctry
  FROM frags JOIN idx ON frags.key = idx.city_norm WHERE frags.key <> '' GROUP BY fkey),
cidx AS (SELECT country_norm, arg_min(country, ord) AS country FROM idx GROUP BY 1),
exact AS (
  SELECT fkey, level, country, airport FROM l0
  UNION ALL SELECT fkey, 1, CASE WHEN nc = 1 OR nk = 1 THEN ctry END, CASE WHEN nc = 1 THEN code END FROM lv1 WHERE nc = 1 OR nk = 1
  UNION ALL SELECT fkey, 2, CASE WHEN nc = 1 OR nk = 1 THEN ctry END, CASE WHEN nc = 1 THEN code END FROM lv2 WHERE nc = 1 OR nk = 1
  UNION ALL SELECT fkey, 3, cidx.country, CAST(NULL AS VARCHAR) FROM frags JOIN cidx ON frags.key = cidx.country_norm
    WHERE frags.key <> '')"""


def partial_level_sql(level: int, rkey: str, rtok: str) -> str:
    """Brute-force DuckDB form of one partial level (the oracle may pair every fragment with every airport)."""
    cand = f"""cand{level} AS (SELECT f.fkey, i.*, len({rtok}) AS tc, length({rkey}) AS kl FROM frags f, idx i
  WHERE f.key <> '' AND {rkey} <> '' AND (contains({rkey}, f.key) OR (len(f.tokens) > 1 AND contains(f.key, {rkey}))
    OR (len(f.tokens) > 0 AND len({rtok}) > 0 AND (len(f.tokens) > 1 OR length(f.tokens[1]) >= 4)
        AND (len(list_filter(f.tokens, lambda t: NOT list_contains({rtok}, t))) = 0
             OR len(list_filter({rtok}, lambda t: NOT list_contains(f.tokens, t))) = 0)))),
best{level} AS (SELECT c.* FROM cand{level} c JOIN (SELECT fkey, max((tc, kl)) AS b FROM cand{level} GROUP BY 1) m
  ON c.fkey = m.fkey AND (c.tc, c.kl) = m.b),
kept{level} AS (SELECT b.*, r.filter_country FROM best{level} b LEFT JOIN restr r ON b.fkey = r.fkey
  WHERE r.filter_country IS NULL OR {key_sql('b.country')} = {key_sql('r.filter_country')}),
sc{level} AS (SELECT fkey, iata_code, country, length(name_norm) AS nl,
  (CASE WHEN len(list_intersect(name_tokens, ['airport', 'international', 'internacional', 'intl'])) > 0 THEN 4 ELSE 0 END
   + CASE WHEN city_norm <> '' AND contains(name_norm, city_norm) THEN 2 ELSE 0 END
   + CASE WHEN list_contains(name_tokens, 'airport') THEN 1 ELSE 0 END) AS s FROM kept{level} WHERE filter_country IS NOT NULL),
prim{level} AS (SELECT fkey, arg_max(iata_code, nl) AS p_code, arg_max(country, nl) AS p_country FROM (
  SELECT s1.* FROM sc{level} s1 JOIN (SELECT fkey, max(s) AS top FROM sc{level} GROUP BY 1) t ON s1.fkey = t.fkey AND s1.s = t.top) x
  GROUP BY fkey HAVING count(*) = 1 AND max(s) > 0),
agg{level} AS (SELECT fkey, bool_or(filter_country IS NOT NULL) AS restricted, count(DISTINCT iata_code) AS nc,
  count(DISTINCT country) AS nk, min(iata_code) AS code, min(country) AS ctry FROM kept{level} GROUP BY 1),
val{level} AS (SELECT a.fkey, {level} AS level,
  CASE WHEN nc = 1 THEN ctry WHEN restricted AND p.p_code IS NOT NULL THEN p.p_country WHEN nk = 1 THEN ctry END AS country,
  CASE WHEN nc = 1 THEN code WHEN restricted AND p.p_code IS NOT NULL THEN p.p_code END AS airport
  FROM agg{level} a LEFT JOIN prim{level} p ON a.fkey = p.fkey)"""
    return cand


RESTR_SQL = """
cn AS (SELECT country_norm, arg_min(country, ord) AS country, """ + tokens_sql("country_norm") + """ AS ctokens
  FROM idx WHERE country_norm <> '' GROUP BY country_norm),
cm AS (SELECT DISTINCT f.fkey, cn.country, len(cn.ctokens) AS t, length(cn.country_norm) AS l FROM frags f, cn
  WHERE f.key <> '' AND len(cn.ctokens) > 0 AND (contains(f.key, cn.country_norm)
    OR len(list_filter(cn.ctokens, lambda t: NOT list_contains(f.tokens, t))) = 0)),
restr AS (SELECT c.fkey, min(c.country) AS filter_country FROM cm c JOIN (SELECT fkey, max((t, l)) AS b FROM cm GROUP BY 1) m
  ON c.fkey = m.fkey AND (c.t, c.l) = m.b GROUP BY c.fkey HAVING count(DISTINCT c.country) = 1)"""

PARTIAL_SQL = RESTR_SQL + ",\n" + partial_level_sql(4, "name_norm", "name_tokens") + ",\n" + \
    partial_level_sql(5, "city_norm", "city_tokens") + """,
partial AS (SELECT * FROM val4 WHERE country IS NOT NULL OR airport IS NOT NULL
  UNION ALL SELECT * FROM val5 WHERE country IS NOT NULL OR airport IS NOT NULL)"""


def _frags_idx(spark, sf):
    idx = G.airports_search_index(airports_idx(spark, sf))
    return G.prepare_fragments(fragments_df(spark, sf), "fragment"), idx


# ---------------------------------------------------------------------------------------------- H21-H23
@query("H21_location_key", f"SELECT session_id, turn, {key_sql('content')} AS location_key FROM history", ("history",))
def q_h21(spark, sf):
    return V(spark, sf, "history").select("session_id", "turn", G.location_key("content").alias("location_key"))


@query("H22_location_fragment", f"""
SELECT fragment, {fragment_sql('fragment')} AS cleaned FROM (SELECT DISTINCT fragment FROM (
  SELECT unnest(string_split(regexp_replace(question, ' (para|to|for|de) ', '|', 'g'), '|')) AS fragment FROM questions) t
  WHERE fragment <> '') f""", ("questions",))
def q_h22(spark, sf):
    return fragments_df(spark, sf).select("fragment", G.location_fragment("fragment").alias("cleaned"))


@query("H23_location_tokens", f"""
SELECT session_id, turn, array_to_string(list_sort({tokens_sql('content')}), ' ') AS tokens FROM history""", ("history",))
def q_h23(spark, sf):
    return V(spark, sf, "history").select("session_id", "turn",
                                          F.array_join(F.array_sort(G.location_tokens("content")), " ").alias("tokens"))


# ---------------------------------------------------------------------------------------------- C11, C12, E8, E11
@query("C11_resolve_locations_exact", "WITH " + FRAGMENTS_SQL + ",\n" + EXACT_SQL + "\nSELECT * FROM exact",
       ("questions", "airports_idx"))
def q_c11(spark, sf):
    frags, idx = _frags_idx(spark, sf)
    return G.resolve_locations_exact(frags, idx)


@query("C12_resolve_locations_partial", "WITH " + FRAGMENTS_SQL + ",\n" + PARTIAL_SQL + "\nSELECT * FROM partial",
       ("questions", "airports_idx"))
def q_c12(spark, sf):
    frags, idx = _frags_idx(spark, sf)
    return G.resolve_locations_partial(frags, idx)


@query("E11_pick_country", "WITH " + FRAGMENTS_SQL + ",\n" + RESTR_SQL + "\nSELECT * FROM restr", ("questions", "airports_idx"))
def q_e11(spark, sf):
    frags, idx = _frags_idx(spark, sf)
    return G.country_restriction(frags, idx)


@query("E8_pick_resolution", "WITH " + FRAGMENTS_SQL + ",\n" + EXACT_SQL + ",\n" + PARTIAL_SQL + """
SELECT fkey AS fragment, arg_min_null(country, level) AS country, arg_min_null(airport, level) AS airport, min(level) AS level
FROM (SELECT * FROM exact UNION ALL SELECT * FROM partial) a GROUP BY fkey""", ("questions", "airports_idx"))
def q_e8(spark, sf):
    return G.resolve_fragments(fragments_df(spark, sf), "fragment", airports_idx(spark, sf))


@query("H24_extract_route_text")
def q_h24(spark, sf):
    return G.extract_route_text(V(spark, sf, "questions"), "request_id", "question", airports_idx(spark, sf))


# ---------------------------------------------------------------------------------------------- chat
@query("E5_last_messages", """
SELECT session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn
  FROM history WHERE role <> 'system') t WHERE rn <= 4""", ("history",))
def q_e5(spark, sf):
    return C.last_messages(V(spark, sf, "history"), 4, ["system"]).select("session_id", "turn", "role")


@query("E6_carry_route_forward", """
SELECT session_id, turn, o.airport AS carried_origin_airport, o.country AS carried_origin_country,
  d.airport AS carried_destination_airport, d.country AS carried_destination_country FROM (
  SELECT session_id, turn,
    last_value(CASE WHEN NULLIF(trim(origin_airport), '') IS NOT NULL OR NULLIF(trim(origin_country), '') IS NOT NULL
      THEN {'airport': origin_airport, 'country': origin_country} END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o,
    last_value(CASE WHEN NULLIF(trim(destination_airport), '') IS NOT NULL OR NULLIF(trim(destination_country), '') IS NOT NULL
      THEN {'airport': destination_airport, 'country': destination_country} END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d
  FROM history) t""", ("history",))
def q_e6(spark, sf):
    out = C.carry_route_forward(V(spark, sf, "history"))
    return out.select("session_id", "turn", "carried_origin_airport", "carried_origin_country",
                      "carried_destination_airport", "carried_destination_country")


@query("E7_latest_route_update", """
SELECT session_id, arg_max_null(turn, turn) AS turn, arg_max_null(origin_airport, turn) AS origin_airport,
  arg_max_null(destination_country, turn) AS destination_country FROM history
WHERE NULLIF(trim(origin_airport), '') IS NOT NULL OR NULLIF(trim(origin_country), '') IS NOT NULL
  OR NULLIF(trim(destination_airport), '') IS NOT NULL OR NULLIF(trim(destination_country), '') IS NOT NULL
GROUP BY session_id""", ("history",))
def q_e7(spark, sf):
    out = C.latest_route_update(V(spark, sf, "history"))
    return out.select("session_id", "turn", "origin_airport", "destination_country")


def _contains_sql(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


def _topic_sql(t: str, lists) -> str:
    whens = " ".join(f"WHEN {t} <> '' AND {_contains_sql(t, terms)} THEN '{name}'" for name, terms in lists.items())
    return f"CASE {whens} ELSE 'general' END"


_QT = "lower(regexp_replace(COALESCE(question, ''), '^\\s+|\\s+$', '', 'g'))"


@query("H25_question_classifiers", f"""
SELECT request_id, {_contains_sql('t', C.DELAY_TERMS)} AS wants_delay_assessment,
  {_topic_sql('t', C.TOPIC_TERMS)} AS topic, {_topic_sql('t', C.RUNTIME_TOPIC_TERMS)} AS runtime_topic,
  t <> '' AND ({_contains_sql('t', C.GUIDE_MARKERS)} OR ({_contains_sql('t', C.GUIDE_TERMS)}
    AND {_contains_sql('t', C.GUIDE_CONTENT_TERMS)})) AS travel_guide
FROM (SELECT request_id, {_QT} AS t FROM questions) q""", ("questions",))
def q_h25(spark, sf):
    q = V(spark, sf, "questions")
    return q.select("request_id", C.wants_delay_assessment("question").alias("wants_delay_assessment"),
                    C.topic("question").alias("topic"), C.topic("question", runtime=True).alias("runtime_topic"),
                    C.travel_guide("question").alias("travel_guide"))


def _trim_sql(x: str, limit: int, keep: int) -> str:
    t = f"regexp_replace(COALESCE({x}, ''), '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN length({t}) > {limit} THEN regexp_replace(substr({t}, 1, {keep}), '\\s+$', '') || '...' "
            f"ELSE {t} END")


@query("H26_trim_text", f"""
SELECT session_id, turn, {_trim_sql('content', 1200, 1200)} AS stored, {_trim_sql('content', 280, 277)} AS compact,
  {_trim_sql('content', 44, 41)} AS label FROM history""", ("history",))
def q_h26(spark, sf):
    h = V(spark, sf, "history")
    return h.select("session_id", "turn", C.trim_text("content", 1200).alias("stored"),
                    C.trim_text("content", 280, 277).alias("compact"), C.trim_text("content", 44, 41).alias("label"))


@query("H27_strip_reasoning", """
SELECT session_id, turn, CASE WHEN contains(t, '<think>') AND contains(t, '</think>')
  THEN regexp_replace(substr(t, strpos(t, '</think>') + 8), '^\\s+|\\s+$', '', 'g') ELSE t END AS answer
FROM (SELECT session_id, turn, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM history) h""", ("history",))
def q_h27(spark, sf):
    return V(spark, sf, "history").select("session_id", "turn", C.strip_reasoning("content").alias("answer"))


BOOT_PREFIX = "hello, i am the assistant."


@query("H33_drop_bootstrap", f"""
SELECT session_id, turn FROM history WHERE NOT COALESCE(role = 'assistant' AND advice_source = 'system'
  AND starts_with(lower({_trim_sql('content', 1200, 1200)}), '{BOOT_PREFIX}'), false)""", ("history",))
def q_h33(spark, sf):
    return C.drop_bootstrap(V(spark, sf, "history"), [BOOT_PREFIX]).select("session_id", "turn")
