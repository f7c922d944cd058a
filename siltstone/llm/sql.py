"""SQL that checks queries of this package on whole tables: brute force over all pairs."""

from __future__ import annotations

_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"


def sql_nodes(where: str = "true") -> str:
    """CTE nodes(id, e): the latest usable vector of each node in double precision."""
    return f"nodes AS (SELECT node_no AS id, CAST(arg_max(embedding, coalesce(written_at, TIMESTAMP '0001-01-01')) AS DOUBLE[64]) AS e FROM graph_nodes WHERE node_no IS NOT NULL AND {where} AND {_USABLE} GROUP BY node_no)"


def sql_groups(kind: str, edges: str) -> str:
    """Rows (member_kind, cluster_no, member_no) of the components of edges(a, b) with at least three members."""
    return f"""SELECT '{kind}' AS member_kind, root AS cluster_no, id AS member_no FROM (SELECT id, root, count(*) OVER (PARTITION BY root) AS n FROM (
        SELECT id, min(other) AS root FROM (SELECT a AS id, b AS other FROM {edges}_reach) GROUP BY id)) WHERE n >= 3"""


def sql_reach(edges: str) -> str:
    """CTE: every pair of a component, by steps along edges until nothing is new."""
    return f"{edges}_reach AS (SELECT a, a AS b FROM {edges} UNION SELECT r.a, e.b FROM {edges}_reach r JOIN {edges} e ON e.a = r.b)"


P1_FOUND = f"""WITH {sql_nodes()}, pairs AS (SELECT x.id AS id, y.id AS other, round(array_cosine_similarity(x.e, y.e), 6) AS s FROM nodes x, nodes y WHERE x.id <> y.id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM pairs) WHERE r <= 5 AND s >= 0.99)
    SELECT DISTINCT least(id, other) AS node_lo, greatest(id, other) AS node_hi FROM near"""

P4_FOUND = f"""WITH RECURSIVE {sql_nodes("metadata.node_type = 'file'")},
    links AS (SELECT x.id AS a, y.id AS b FROM nodes x, nodes y WHERE x.id <> y.id AND array_cosine_similarity(x.e, y.e) >= 0.866),
    plans AS (SELECT plan_no AS id, lower(arg_max(struct_pack(p := path), coalesce(planned_at, TIMESTAMP '0001-01-01')).p) AS path FROM path_plans WHERE plan_no IS NOT NULL GROUP BY plan_no),
    grams AS (SELECT id, list_distinct(list_transform(range(1, length(path) - 1), lambda i: substring(path, i, 3))) AS g FROM plans WHERE length(path) >= 4),
    alike AS (SELECT x.id AS a, y.id AS b FROM grams x, grams y WHERE x.id <> y.id AND least(len(x.g), len(y.g)) * 2 >= greatest(len(x.g), len(y.g)) AND 3 * len(list_intersect(x.g, y.g)) >= len(x.g) + len(y.g)),
    {sql_reach("links")}, {sql_reach("alike")}
    {sql_groups("embedding", "links")} UNION ALL {sql_groups("path", "alike")}"""

_RUN = "[^ \\t\\n\\r。！？]"
P5_FOUND = f"SELECT file_id, doc_id, CASE WHEN regexp_matches(text, '{_RUN}{{1000}}{_RUN}') THEN 'forced' ELSE 'natural' END AS cut FROM documents WHERE length(text) > 1000"

ORACLES = {"p1_found": P1_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
