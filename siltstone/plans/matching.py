"""Queries over matching and schema decisions, with their SQL.

The SQL derives the matching-block ratio by a recursion over the longest common substring and
the order-dependent assignment by a recursion over the attributes, so it shares no code with
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.operators import evolution as E
from siltstone.plans.texts_files import sql_group, sql_is_id, sql_normalize
from siltstone.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# --- SQL -----------------------------------------------------------------------------


def sql_longest(x: str, y: str) -> str:
    """The longest common substring of two texts, of several that which starts first in x; null when there is none."""
    parts = f"flatten(list_transform(range(length({x}), 0, -1), lambda n: list_transform(range(1, length({x}) - n + 2), lambda i: substring({x}, i, n))))"
    return f"list_filter({parts}, lambda s: contains({y}, s))[1]"


def sql_similarity(pairs: str) -> str:
    """CTEs ending in sim(a, b, score): the score of every pair of names of ``pairs``, a CTE with columns a and b, equal types assumed."""
    tokens = "list_distinct(regexp_extract_all({}, '[a-z]+'))".format
    x, y = tokens("na"), tokens("nb")
    return f"""norms AS (SELECT DISTINCT a, b, {sql_normalize('a')} AS na, {sql_normalize('b')} AS nb FROM {pairs}),
    open AS (SELECT DISTINCT na AS p, nb AS q FROM norms WHERE na <> nb),
    seg AS (SELECT p, q, p AS x, q AS y, {sql_longest('p', 'q')} AS s FROM open WHERE p <> '' AND q <> ''
        UNION ALL SELECT p, q, x, y, {sql_longest('x', 'y')} FROM (
            SELECT p, q, CASE side WHEN 0 THEN substring(x, 1, strpos(x, s) - 1) ELSE substring(x, strpos(x, s) + length(s)) END AS x,
                CASE side WHEN 0 THEN substring(y, 1, strpos(y, s) - 1) ELSE substring(y, strpos(y, s) + length(s)) END AS y
            FROM seg, range(2) sides(side) WHERE s IS NOT NULL) WHERE x <> '' AND y <> ''),
    ratio AS (SELECT p, q, 2.0::DOUBLE * sum(length(s)) / (length(p) + length(q)) AS r FROM seg WHERE s IS NOT NULL GROUP BY p, q),
    sim AS (SELECT a, b, 0.7::DOUBLE * CASE WHEN na = nb THEN 1.0::DOUBLE WHEN coalesce({sql_group('a')} = {sql_group('b')}, false) THEN 0.95::DOUBLE
        ELSE greatest(coalesce(r, 0.0::DOUBLE), 0.8::DOUBLE * CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE ELSE 0.0::DOUBLE END) END
        + 0.3::DOUBLE AS score FROM norms LEFT JOIN ratio ON na = p AND nb = q)"""


#: The attributes of the latest load of each file in the order of their names, and the catalog.
SQL_BOTH = f"""latest AS (SELECT file_no, arg_max(list_sort(list_concat(map_keys(mapping), coalesce(new_fields, []))), loaded_at) AS names FROM load_results GROUP BY file_no),
    incoming AS (SELECT CAST(file_no AS VARCHAR) AS source, i AS place, names[i] AS attr, {sql_is_id('names[i]')} AS isid FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM latest)),
    cat AS (SELECT table_name, col_no, column_name AS col, {sql_is_id('column_name')} AS isid FROM catalog_columns),
    pairs AS (SELECT DISTINCT attr AS a, col AS b FROM (SELECT DISTINCT attr FROM incoming WHERE NOT isid), (SELECT DISTINCT col FROM cat WHERE NOT isid))"""

SQL_CANDIDATES = f"""{SQL_BOTH}, {sql_similarity('pairs')},
    hits AS (SELECT DISTINCT source, table_name, {sql_normalize('attr')} AS norm FROM incoming JOIN sim ON attr = a JOIN cat ON col = b WHERE NOT incoming.isid AND NOT cat.isid AND score >= 0.4::DOUBLE),
    candidates AS (SELECT source, table_name, count(*) AS matches FROM hits GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY matches DESC, table_name) AS rank FROM candidates) WHERE rank <= 3)"""

_N, _C = sql_normalize("i.attr"), sql_normalize("c.col")
_FREE = "list_filter({}, lambda c: NOT list_contains(used, c))[1]".format
SQL_MATCHES = f"""{SQL_CANDIDATES},
    ids AS (SELECT t.source, t.table_name, i.place, i.attr, list(c.col ORDER BY c.col_no) FILTER ({_N} = {_C}) AS same, list(c.col ORDER BY c.col_no) AS every,
            list(c.col ORDER BY c.col_no) FILTER (contains({_N}, 'id') AND contains({_C}, 'id') AND (contains({_N}, {_C}) OR contains({_C}, {_N}))) AS within,
            (SELECT count(*) FROM incoming o WHERE o.source = t.source AND o.isid) AS n_new
        FROM top t JOIN incoming i ON i.source = t.source AND i.isid LEFT JOIN cat c ON c.table_name = t.table_name AND c.isid GROUP BY t.source, t.table_name, i.place, i.attr),
    others AS (SELECT t.source, t.table_name, i.place, i.attr, list(c.col ORDER BY s.score DESC, c.col_no) FILTER (s.score >= 0.6::DOUBLE) AS best
        FROM top t JOIN incoming i ON i.source = t.source AND NOT i.isid LEFT JOIN cat c ON c.table_name = t.table_name AND NOT c.isid LEFT JOIN sim s ON s.a = i.attr AND s.b = c.col GROUP BY t.source, t.table_name, i.place, i.attr),
    turns AS (SELECT *, row_number() OVER (PARTITION BY source, table_name ORDER BY isid DESC, place) AS turn FROM (
        SELECT source, table_name, place, attr, true AS isid, coalesce(same, []) AS first, CASE WHEN n_new = 1 AND len(list_filter(every, lambda c: c IS NOT NULL)) = 1 THEN every ELSE [] END AS second, coalesce(within, []) AS third FROM ids
        UNION ALL SELECT source, table_name, place, attr, false, coalesce(best, []), [], [] FROM others)),
    walk AS (SELECT DISTINCT source, table_name, 0::BIGINT AS turn, []::VARCHAR[] AS used, ''::VARCHAR AS found, []::VARCHAR[] AS taken, 0::BIGINT AS regular FROM turns
        UNION ALL SELECT source, table_name, turn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END,
            CASE WHEN pick IS NULL THEN found ELSE found || CASE WHEN found = '' THEN '' ELSE ',' END || to_json(attr) || ':' || to_json(pick) END,
            CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, attr) END, regular + CASE WHEN pick IS NULL OR isid THEN 0 ELSE 1 END
        FROM (SELECT w.source, w.table_name, t.turn, w.used, w.found, w.taken, w.regular, t.attr, t.isid, coalesce({_FREE('t.first')}, {_FREE('t.second')}, {_FREE('t.third')}) AS pick
            FROM walk w JOIN turns t ON t.source = w.source AND t.table_name = w.table_name AND t.turn = w.turn + 1)),
    ends AS (SELECT source, table_name, arg_max(found, turn) AS found, arg_max(taken, turn) AS taken, max(regular) AS regular FROM walk GROUP BY ALL),
    sources AS (SELECT source, list(attr ORDER BY place) AS names, count(*) FILTER (NOT isid) AS n_regular FROM incoming GROUP BY source),
    matches AS (SELECT e.source, e.table_name, CASE WHEN n_regular > 0 THEN regular / n_regular::DOUBLE WHEN found <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS match_ratio, '{{' || found || '}}' AS mapping, list_filter(names, lambda n: NOT list_contains(taken, n)) AS fresh FROM ends e JOIN sources s ON s.source = e.source)"""


def _incoming(spark: SparkSession, base: str) -> DataFrame:
    loads = table(spark, base, "load_results").groupBy("file_no").agg(F.max(F.struct("loaded_at", F.map_keys("mapping").alias("a"), F.coalesce("new_fields", F.expr("cast(array() as array<string>)")).alias("n"))).alias("m"))
    return loads.select(F.col("file_no").cast("string").alias("source"), F.posexplode(F.array_sort(F.concat("m.a", "m.n"))).alias("ordinal", "attribute"))


def _catalog(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "catalog_columns").select("table_name", F.col("col_no").alias("ordinal"), "column_name", "data_type")


_HEADERS = "pairs AS (SELECT DISTINCT h AS a, c AS b FROM (SELECT unnest(map_keys(mapping)) AS h FROM load_results), (SELECT DISTINCT column_name AS c FROM catalog_columns WHERE column_name IS NOT NULL))"


def header_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct header with every column name of the catalog, which is small."""
    columns = table(spark, base, "catalog_columns").where("column_name is not null").select("column_name").distinct()
    headers = table(spark, base, "load_results").select(F.explode(F.map_keys("mapping")).alias("header")).distinct()
    return headers.join(F.broadcast(columns))


@query(f"WITH RECURSIVE {_HEADERS}, {sql_similarity('pairs')} SELECT a AS header, b AS column_name, round(score, 6) AS similarity FROM sim")
def attr_similarity(spark, base):
    return header_pairs(spark, base).select("header", "column_name", F.round(A.attribute_similarity("header", "column_name"), 6).alias("similarity"))


@query(f"WITH RECURSIVE {_HEADERS}, {sql_similarity('pairs')} SELECT header, place, column_name, round(score, 6) AS similarity FROM (SELECT a AS header, b AS column_name, score, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS place FROM sim) WHERE place <= 5")
def attr_best_scores(spark, base):
    return E.best_scores(header_pairs(spark, base), "header", "column_name", 5)


@query(f"WITH RECURSIVE {SQL_CANDIDATES} SELECT source, table_name, matches FROM candidates")
def candidate_tables(spark, base):
    return E.candidate_tables(_incoming(spark, base), _catalog(spark, base))


@query(f"WITH RECURSIVE {SQL_MATCHES} SELECT source, table_name, round(match_ratio, 6) AS match_ratio, mapping, array_to_string(fresh, ',') AS new_fields FROM matches")
def attr_match(spark, base):
    i, c = _incoming(spark, base), _catalog(spark, base)
    top = E.top_candidates(E.candidate_tables(i, c))
    return E.table_matches(i, c, top).select("source", "table_name", F.round("match_ratio", 6).alias("match_ratio"), F.to_json("mapping").alias("mapping"), F.array_join("new_fields", ",").alias("new_fields"))


_RULE = "CASE WHEN match_ratio IS NULL THEN 'new_table' WHEN match_ratio >= CASE WHEN len(names) < 10 THEN 0.6 ELSE 0.8 END AND len(fresh) = 0 THEN 'same_table' WHEN match_ratio >= 0.5 AND len(fresh) <= 3 THEN 'evolved_table' WHEN match_ratio >= 0.5 THEN 'evolved_table_jsonb' ELSE 'new_table' END"


@query(
    f"""WITH RECURSIVE {SQL_MATCHES}, best AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY m.source ORDER BY match_ratio DESC, rank) AS r FROM matches m JOIN top USING (source, table_name) WHERE match_ratio > 0) WHERE r = 1),
    d AS (SELECT s.source, names, table_name, fresh, match_ratio, {_RULE} AS decision FROM sources s LEFT JOIN best b ON b.source = s.source)
    SELECT source, decision, CASE WHEN decision = 'new_table' THEN substring('table_' || array_to_string(list_transform(names[1:3], lambda x: {sql_normalize('x')}), '_'), 1, 50) ELSE table_name END AS table_name,
    CAST(CASE WHEN decision = 'new_table' THEN len(names) ELSE len(fresh) END AS INTEGER) AS n_new, round(coalesce(match_ratio, 0), 6) AS match_ratio FROM d"""
)
def schema_decision(spark, base):
    d = E.decide(_incoming(spark, base), _catalog(spark, base), None)
    return d.select("source", "decision", "table_name", F.size("new_fields").alias("n_new"), F.round("match_ratio", 6).alias("match_ratio"))
