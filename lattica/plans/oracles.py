"""DuckDB SQL of the catalogue's queries, each after the common table expressions it needs."""

from __future__ import annotations

_CTE = {
    "n": "SELECT count(*) AS n FROM supplier",
    "files": "SELECT n_nationkey AS nation, n_name, replace(lower(r_name), ' ', '_') || '/' || replace(lower(n_name), ' ', '_') || '.src' AS file FROM nation JOIN region ON n_regionkey = r_regionkey",
    "contracts": """SELECT 'c:' || s_suppkey AS id, s_suppkey AS k, s_name AS name, file, ['contract', 'interface', 'library', 'abstract'][1 + s_suppkey % 4] AS contract_kind,
        s_suppkey % 10 = 0 AS is_test, s_suppkey % 15 = 0 AS is_mock FROM supplier JOIN files ON s_nationkey = nation""",
    "inherits": "SELECT DISTINCT 'c:' || s_suppkey AS from_id, 'c:' || b AS to_id FROM (SELECT s_suppkey, unnest([s_suppkey // 2, s_suppkey // 3]) AS b FROM supplier WHERE s_suppkey >= 2) WHERE b <> s_suppkey",
    "functions": """SELECT 'f:' || p_partkey AS id, p_partkey AS k, CASE WHEN p_partkey >= n AND p_partkey < 2 * n AND p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS name,
        'c:' || (p_partkey % n) AS scope, p_partkey % n AS scope_k,
        CASE WHEN p_partkey < n THEN 'constructor' WHEN p_partkey < 2 * n AND p_partkey % 3 = 0 THEN 'modifier' ELSE 'function' END AS subkind,
        ['public', 'external', 'internal', 'private', 'default'][1 + p_size % 5] AS visibility, ['pure', 'view', 'nonpayable', 'payable'][1 + p_size % 4] AS state_mutability,
        NOT (p_partkey % n % 4 = 1 AND p_size % 2 = 1) AS has_body, p_size % 7 = 0 AS checks_sender, p_size, p_name, p_brand, p_type,
        CASE WHEN NOT (p_partkey % n % 4 = 1 AND p_size % 2 = 1) THEN md5(p_name || p_brand || p_type) ELSE '' END AS body_hash FROM part, n""",
    "variables": "SELECT 'v:' || c_custkey AS id, c_custkey AS k, c_name AS name, 'c:' || (c_custkey % n) AS scope, c_mktsegment AS type FROM customer, n",
    "modifiers": """SELECT a.id AS from_id, CASE WHEN m.id IS NOT NULL THEN m.id ELSE '?not-found:' || a.p_brand END AS to_id, coalesce(m.name, a.p_brand) AS name, coalesce(m.checks_sender, false) AS checks_sender
        FROM functions a CROSS JOIN n LEFT JOIN functions m ON m.subkind = 'modifier' AND m.k = n + a.k % n WHERE a.subkind = 'function' AND a.p_size % 3 = 0""",
    "lines": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'",
    "calls": """SELECT CASE WHEN l_suppkey % 10 <> 9 AND callee < n THEN 'creates' ELSE 'calls' END AS kind,
        CASE WHEN l_suppkey % 10 <> 9 AND callee < n THEN NULL ELSE ['internal', 'external', 'library', 'super', 'delegatecall', 'lowlevel'][1 + l_linenumber % 6] END AS subkind,
        'f:' || l_partkey AS from_id, CASE WHEN l_suppkey % 10 = 9 THEN '?' || ['low-level', 'function-pointer', 'dynamic-receiver', 'unattached-member', 'not-found'][1 + l_linenumber % 5] || ':' || p_name
          WHEN callee < n THEN 'c:' || callee ELSE 'f:' || callee END AS to_id,
        CASE WHEN l_suppkey % 10 = 9 THEN 'unresolved' WHEN l_suppkey % 10 >= 7 THEN 'ambiguous' ELSE 'heuristic' END AS resolution,
        CASE WHEN l_suppkey % 10 = 9 THEN 3 WHEN l_suppkey % 10 >= 7 THEN 2 ELSE 1 END AS rank, l_linenumber * 1000 + l_suppkey % 1000 AS off
        FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee FROM lines) x JOIN part ON p_partkey = callee, n""",
    "accesses": """SELECT CASE l_returnflag WHEN 'R' THEN 'reads' ELSE 'writes' END AS kind, CAST(NULL AS VARCHAR) AS subkind, 'f:' || l_partkey AS from_id, 'v:' || o_custkey AS to_id,
        'heuristic' AS resolution, 1 AS rank, l_linenumber * 1000 + l_suppkey % 1000 AS off FROM lines WHERE l_returnflag IN ('R', 'A')""",
    "emits": "SELECT 'emits' AS kind, CAST(NULL AS VARCHAR) AS subkind, 'f:' || user_id AS from_id, 'e:' || event_type AS to_id, 'heuristic' AS resolution, 1 AS rank, event_id AS off FROM events",
    "cedges": """SELECT from_id || '|' || to_id || '|' || kind || '|' || coalesce(subkind, '') AS id, from_id, to_id, kind, subkind, count(*) AS count,
        ['semantic', 'heuristic', 'ambiguous', 'unresolved'][1 + max(rank)] AS resolution, min(off) AS off FROM calls GROUP BY ALL""",
    "aedges": "SELECT from_id, to_id, kind, count(*) AS count, min(off) AS off FROM accesses GROUP BY ALL",
    "hops": "SELECT DISTINCT from_id AS src, to_id AS dst FROM calls WHERE kind IN ('calls', 'creates')",
    "guards": """SELECT id, access, guards FROM (
        SELECT f.id, CASE WHEN bool_or(m.name IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8')) THEN 'high' WHEN bool_or(m.checks_sender) OR any_value(f.checks_sender) THEN 'low' ELSE 'none' END AS access,
          coalesce(string_agg(DISTINCT m.name, ',' ORDER BY m.name) FILTER (m.name IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8') OR m.checks_sender), '') AS guards
        FROM functions f LEFT JOIN modifiers m ON m.from_id = f.id GROUP BY f.id)""",
    "deployable": """SELECT id FROM contracts WHERE contract_kind IN ('contract', 'library') UNION SELECT a.base FROM anc a JOIN contracts c ON c.id = a.id WHERE c.contract_kind IN ('contract', 'library')""",
    "entries": "SELECT f.id, f.scope FROM functions f WHERE subkind = 'function' AND visibility IN ('public', 'external') AND has_body AND scope IN (SELECT id FROM deployable)",
}
_RECURSIVE = {"anc": "SELECT from_id AS id, to_id AS base FROM inherits UNION SELECT anc.id, i.to_id FROM anc JOIN inherits i ON i.from_id = anc.base"}
_NEEDS = {
    "contracts": ["files"], "functions": ["n"], "variables": ["n"], "modifiers": ["functions", "n"], "calls": ["lines", "n"], "accesses": ["lines"], "cedges": ["calls"], "aedges": ["accesses"],
    "hops": ["calls"], "guards": ["functions", "modifiers"], "anc": ["inherits"], "deployable": ["contracts", "anc"], "entries": ["functions", "deployable"],
}


def after(*names: str, more: dict[str, str] | None = None) -> str:
    """WITH RECURSIVE ... of the named tables and all that they need, then of ``more``."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{x} AS ({(_CTE | _RECURSIVE)[x]})" for x in order] + [f"{k} AS ({v})" for k, v in (more or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_EXT = "subkind NOT IN ('modifier', 'constructor') AND visibility IN ('public', 'external')"
_SURFACE = f"SELECT f.*, g.access, g.guards, state_mutability NOT IN ('view', 'pure') AS mutates_state FROM functions f JOIN guards g USING (id) WHERE {_EXT}"
_ARCS = """SELECT DISTINCT from_id AS src, to_id AS dst FROM calls WHERE kind = 'calls' AND resolution <> 'unresolved'
  UNION SELECT from_id, replace(to_id, 'c:', 'f:') FROM calls WHERE kind = 'creates' UNION SELECT from_id, to_id FROM modifiers WHERE to_id LIKE 'f:%'"""
_HELD = "SELECT id, scope AS container FROM functions UNION ALL SELECT id, id FROM contracts"
_EVERY = "SELECT * FROM (SELECT kind, subkind, from_id, to_id, resolution, rank, off FROM calls UNION ALL SELECT * FROM accesses UNION ALL SELECT * FROM emits)"
_EDGES = """SELECT from_id || '|' || to_id || '|' || kind || '|' || coalesce(subkind, '') AS id, from_id, to_id, kind, subkind, count(*) AS count,
  ['semantic', 'heuristic', 'ambiguous', 'unresolved'][1 + max(rank)] AS resolution FROM every_draft GROUP BY from_id, to_id, kind, subkind"""
_SPANS = "SELECT f.id, c.file, f.k * 100 AS o, 80 AS l FROM functions f JOIN contracts c ON c.id = f.scope"
_FINDINGS = "SELECT DISTINCT s.file, l_partkey * 100 + l_linenumber * 12 AS \"offset\" FROM lineitem JOIN spans s ON s.id = 'f:' || l_partkey WHERE l_orderkey % 50 = 0"
_BEFORE = "SELECT id, name, 's' || (scope_k % 5) || '.src' AS file, scope, visibility, state_mutability, has_body, body_hash, k FROM functions WHERE subkind = 'function'"
_AFTER = """SELECT CASE WHEN k % 37 = 0 THEN id || 'r' WHEN k % 41 = 0 THEN id || 'm' WHEN k % 53 = 0 THEN id || 's' ELSE id END AS id, CASE WHEN k % 37 = 0 THEN name || ' new' ELSE name END AS name, file,
  CASE WHEN k % 37 <> 0 AND k % 41 = 0 THEN 'c:0' ELSE scope END AS scope, visibility, state_mutability, has_body,
  CASE WHEN (k % 47 = 0 OR k % 53 = 0) AND k % 37 <> 0 AND k % 41 <> 0 THEN md5(body_hash || 'x') ELSE body_hash END AS body_hash, k, false AS fresh FROM bef WHERE k % 43 <> 0
  UNION ALL SELECT id || 'n', name || ' added', 'new.src', scope, visibility, state_mutability, has_body, '', k, true FROM bef WHERE k % 50 = 1"""
_REVIEWS = "SELECT id AS node, 'reviewed' AS status, body_hash FROM functions WHERE k % 10 = 0 UNION ALL SELECT 'gone:' || s_suppkey, 'flagged', 'x' FROM supplier WHERE s_suppkey % 7 = 0"
_IMPORTED = "SELECT DISTINCT 'find:' || l_orderkey AS id, f.id AS nid, f.body_hash FROM lineitem JOIN functions f ON f.k = l_partkey WHERE l_orderkey % 50 = 0"
_BIGRAMS = "SELECT n, lower(substr(n, i, 2)) AS w, count(*) AS c FROM (SELECT p_name AS n, unnest(range(1, length(p_name))) AS i FROM (SELECT DISTINCT p_name FROM part)) GROUP BY ALL"
_ANCS = "SELECT DISTINCT id, base FROM anc"
_WALK = """SELECT 'f:42' AS id, 0 AS depth UNION SELECT CASE WHEN '{way}' = 'up' THEN src ELSE dst END, depth + 1 FROM walk_{way} JOIN hops ON CASE WHEN '{way}' = 'up' THEN dst ELSE src END = walk_{way}.id WHERE depth < {depth}"""


def _walk(way: str, depth: int) -> dict[str, str]:
    return {f"walk_{way}": _WALK.format(way=way, depth=depth)}


ORACLES = {
    "flagship_surface": after("functions", "guards", "contracts", "entries", more={"s": _SURFACE})
    + """SELECT s.id, s.name, c.name AS contract, c.file, s.visibility, s.state_mutability, s.mutates_state, s.access, s.guards, s.id IN (SELECT id FROM entries) AS is_entry, c.is_test OR c.is_mock AS scaffolding
        FROM s JOIN contracts c ON c.id = s.scope""",
    "edge_collapse": after("calls", "accesses", "emits", more={"every_draft": _EVERY}) + _EDGES,
    "edge_sites": after("calls") + """SELECT from_id || '|' || to_id || '|' || kind || '|' || coalesce(subkind, '') AS id, count(*) AS count, ['semantic', 'heuristic', 'ambiguous', 'unresolved'][1 + max(rank)] AS resolution,
        min(off) AS lo, max(off) AS hi, count(*) AS n_sites, coalesce(subkind = 'external', false) AS cross_trust_boundary FROM calls GROUP BY from_id, to_id, kind, subkind""",
    "resolution_scores": after("calls", "accesses", "emits", more={"every_draft": _EVERY, "e": _EDGES, "s": "SELECT 'overall' AS scope, * FROM e UNION ALL SELECT 'calls', * FROM e WHERE kind IN ('calls', 'creates')"})
    + """SELECT scope, CAST(0 AS BIGINT) AS semantic, CAST(coalesce(sum(count) FILTER (resolution = 'heuristic'), 0) AS BIGINT) AS heuristic, CAST(coalesce(sum(count) FILTER (resolution = 'ambiguous'), 0) AS BIGINT) AS ambiguous,
        CAST(coalesce(sum(count) FILTER (resolution = 'unresolved'), 0) AS BIGINT) AS unresolved, CAST(sum(count) AS BIGINT) AS total, round(coalesce(sum(count) FILTER (resolution = 'heuristic'), 0) / sum(count), 6) AS confident FROM s GROUP BY scope""",
    "mode_select": after("calls", "cedges") + "SELECT CASE WHEN sum(count) FILTER (resolution = 'heuristic') / sum(count) >= 0.7 THEN 'heuristic' ELSE 'structural' END AS mode FROM cedges",
    "graph_stats_nodes": after("files", "contracts", "functions", "variables", "calls")
    + """SELECT 'SourceUnit' AS kind, count(*) AS count FROM files UNION ALL SELECT 'Contract', count(*) FROM contracts UNION ALL SELECT 'Function', count(*) FROM functions UNION ALL SELECT 'StateVariable', count(*) FROM variables
        UNION ALL SELECT 'Event', count(DISTINCT event_type) FROM events UNION ALL SELECT 'Unresolved', count(DISTINCT to_id) FROM calls WHERE resolution = 'unresolved'""",
    "graph_stats_edges": after("calls", "accesses", "emits", more={"every_draft": _EVERY, "e": _EDGES}) + "SELECT kind, resolution, count(*) AS count FROM e GROUP BY ALL",
    "contract_stats": after("contracts") + "SELECT contract_kind, count(*) AS total, count(*) FILTER (is_test) AS test, count(*) FILTER (is_mock) AS mock, count(*) FILTER (NOT is_test AND NOT is_mock) AS real FROM contracts GROUP BY ALL",
    "symbol_stats": after("functions") + "SELECT subkind, visibility, state_mutability, count(*) AS count, count(*) FILTER (has_body) AS with_body, count(*) FILTER (checks_sender) AS checks_sender FROM functions GROUP BY ALL",
    "externals": after("functions", "guards", more={"s": _SURFACE}) + "SELECT id, name, scope, visibility, state_mutability, mutates_state, access FROM s",
    "externals_unprotected": after("functions", "guards", more={"s": _SURFACE}) + "SELECT id, name, scope, visibility, state_mutability FROM s WHERE mutates_state AND access = 'none'",
    "externals_payable": after("functions", "guards", more={"s": _SURFACE}) + "SELECT id, name, scope, access FROM s WHERE state_mutability = 'payable'",
    "unresolved_edges": after("cedges") + r"SELECT from_id, to_id, regexp_extract(to_id, '^\?([^:]*):', 1) AS category, regexp_extract(to_id, '^\?[^:]*:(.*)$', 1) AS callee, count FROM cedges WHERE resolution = 'unresolved'",
    "unresolved_by_category": after("calls") + r"SELECT regexp_extract(to_id, '^\?([^:]*):', 1) AS category, count(DISTINCT to_id) AS count FROM calls WHERE resolution = 'unresolved' GROUP BY 1",
    "writers_of": after("aedges", "functions") + 'SELECT from_id AS "function", count, visibility FROM aedges JOIN functions f ON f.id = from_id WHERE to_id = \'v:14\' AND kind = \'writes\'',
    "readers_of": after("aedges", "functions") + 'SELECT from_id AS "function", count, visibility FROM aedges JOIN functions f ON f.id = from_id WHERE to_id = \'v:14\' AND kind = \'reads\'',
    "writer_counts": after("aedges") + "SELECT to_id, count(*) FILTER (kind = 'writes') AS writers, count(*) FILTER (kind = 'reads') AS readers, CAST(sum(count) AS BIGINT) AS sites FROM aedges GROUP BY to_id",
    "callers_of_d1": after("hops") + "SELECT DISTINCT src AS id, 1 AS depth FROM hops WHERE dst = 'f:133' AND src <> 'f:133'",
    "callees_of_d2": after("hops", more=_walk("down", 2)) + "SELECT id, min(depth) AS depth FROM walk_down WHERE id <> 'f:42' GROUP BY id",
    "reachable_from": after("calls", more={"h": "SELECT DISTINCT from_id, to_id FROM calls WHERE kind = 'calls' AND resolution <> 'unresolved'", "r": "SELECT 'f:42' AS id UNION SELECT h.to_id FROM r JOIN h ON h.from_id = r.id"}) + "SELECT id FROM r WHERE id <> 'f:42'",
    "shortest_path_depth": after("hops", more=_walk("down", 4)) + "SELECT id, min(depth) AS hops FROM walk_down WHERE id <> 'f:42' GROUP BY id",
    "entrypoints": after("entries") + "SELECT id, scope FROM entries",
    "externally_reachable": after("entries", "calls", "modifiers", more={"arcs": _ARCS, "r": "SELECT id FROM entries UNION SELECT dst FROM r JOIN arcs ON src = r.id"}) + "SELECT id FROM r",
    "entrypoint_reachability": after("entries", "calls", "modifiers", more={"arcs": _ARCS, "r": "SELECT id AS origin, id FROM entries UNION SELECT origin, dst FROM r JOIN arcs ON src = r.id"})
    + "SELECT origin, count(*) AS reached FROM r GROUP BY origin",
    "backward_closure_writes": after("calls", "accesses", more={"r": "SELECT DISTINCT from_id AS id FROM accesses WHERE kind = 'writes' UNION SELECT c.from_id FROM r JOIN calls c ON c.to_id = r.id AND c.kind = 'calls'"}) + "SELECT id FROM r",
    "call_classes": after("cedges", more={"r": "SELECT DISTINCT from_id AS id FROM cedges WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') UNION SELECT c.from_id FROM r JOIN cedges c ON c.to_id = r.id AND c.kind = 'calls'"})
    + "SELECT id, CASE WHEN subkind IN ('external', 'delegatecall', 'lowlevel') THEN 'external' WHEN to_id IN (SELECT id FROM r) THEN 'reaches-external' ELSE 'internal' END AS class FROM cedges WHERE kind = 'calls'",
    "reentrancy_shape": after("calls", "accesses", more={"x": "SELECT from_id, min(off) AS o FROM calls WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') GROUP BY 1", "w": "SELECT from_id, max(off) AS o FROM accesses WHERE kind = 'writes' GROUP BY 1"})
    + "SELECT x.from_id AS id FROM x JOIN w USING (from_id) WHERE w.o > x.o",
    "reentrancy_transitive": after("calls", "accesses", more={
        "re": "SELECT DISTINCT from_id AS id FROM calls WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') UNION SELECT c.from_id FROM re JOIN calls c ON c.to_id = re.id AND c.kind = 'calls'",
        "rw": "SELECT DISTINCT from_id AS id FROM accesses WHERE kind = 'writes' UNION SELECT c.from_id FROM rw JOIN calls c ON c.to_id = rw.id AND c.kind = 'calls'",
        "x": "SELECT from_id, min(off) AS o FROM calls WHERE kind = 'calls' AND (subkind IN ('external', 'delegatecall', 'lowlevel') OR to_id IN (SELECT id FROM re)) GROUP BY 1",
        "w": "SELECT from_id, max(off) AS o FROM (SELECT from_id, off FROM accesses WHERE kind = 'writes' UNION ALL SELECT from_id, off FROM calls WHERE kind = 'calls' AND to_id IN (SELECT id FROM rw)) GROUP BY 1",
    }) + "SELECT x.from_id AS id FROM x JOIN w USING (from_id) WHERE w.o > x.o",
    "access_control": after("guards") + "SELECT id, access, guards FROM guards",
    "derived_from": after("anc") + "SELECT base AS id, count(DISTINCT id) AS derived FROM anc GROUP BY base",
    "c3_depth": after("anc") + "SELECT id, count(DISTINCT base) AS ancestors FROM anc GROUP BY id",
    "member_shadowing": after("anc", "contracts", "functions", more={"ch": "SELECT id, base, 1000000000 - CAST(replace(base, 'c:', '') AS BIGINT) AS pos FROM anc WHERE id <> base UNION SELECT id, id, 0 FROM contracts"})
    + """SELECT id, name, member FROM (SELECT ch.id, f.name, f.id AS member, row_number() OVER (PARTITION BY ch.id, f.name ORDER BY pos, f.k) AS r FROM ch JOIN functions f ON f.scope = ch.base AND f.subkind = 'function') WHERE r = 1""",
    "override_pairs": after("anc", "functions", more={"a": _ANCS}) + """SELECT f.id AS from_id, b.id AS to_id, CASE WHEN b.has_body THEN 'overrides' ELSE 'implements' END AS kind FROM functions f JOIN a ON a.id = f.scope
        JOIN functions b ON b.scope = a.base AND b.name = f.name AND b.subkind = 'function' WHERE f.subkind = 'function'""",
    "protocol_rollup": after("cedges", "functions", "contracts", more={"held": _HELD}) + """SELECT a.container AS from_id, b.container AS to_id, CAST(sum(count) AS BIGINT) AS count, CASE WHEN bool_or(resolution = 'ambiguous') THEN 'ambiguous' ELSE 'heuristic' END AS resolution
        FROM cedges JOIN held a ON a.id = from_id JOIN held b ON b.id = to_id WHERE a.container <> b.container AND resolution <> 'unresolved' GROUP BY ALL""",
    "cluster_members": after("functions", "contracts", more={"f": "SELECT file FROM contracts UNION ALL SELECT c.file FROM functions f JOIN contracts c ON c.id = f.scope", "d": "SELECT regexp_replace(file, '/[^/]*$', '') AS path FROM f"})
    + "SELECT path, CAST(NULL AS VARCHAR) AS parent, path AS label, 0 AS depth, count(*) AS members FROM d GROUP BY path",
    "cluster_edges": after("inherits", "contracts", more={"r": "SELECT id, 'dir:' || regexp_replace(file, '/[^/]*$', '') AS rep FROM contracts", "e": "SELECT a.rep AS f, b.rep AS t FROM inherits JOIN r a ON a.id = from_id JOIN r b ON b.id = to_id"})
    + "SELECT f AS from_id, t AS to_id, count(*) AS count, count(*) AS pairs, CASE WHEN f = t THEN 'internal' ELSE 'aggregate' END AS type FROM e GROUP BY f, t",
    "call_view_nodes": after("hops", more=_walk("down", 3) | _walk("up", 2)) + "SELECT DISTINCT id FROM (SELECT id FROM walk_down UNION ALL SELECT id FROM walk_up)",
    "state_access_view": after("aedges", "functions", "variables", "contracts", more={"k": "SELECT id, scope FROM functions UNION ALL SELECT id, scope FROM variables", "ok": "SELECT k.id FROM k JOIN contracts c ON c.id = k.scope WHERE NOT is_test AND NOT is_mock"})
    + "SELECT from_id, to_id, kind, count FROM aedges WHERE from_id IN (SELECT id FROM ok) AND to_id IN (SELECT id FROM ok)",
    "contract_view": after("anc", "functions", "variables", more={"b": "SELECT base AS scope FROM anc WHERE id = 'c:9' UNION SELECT 'c:9'"})
    + "SELECT id FROM functions JOIN b USING (scope) UNION SELECT id FROM variables JOIN b USING (scope) UNION SELECT scope FROM b",
    "induced_edges": after("cedges", "functions", more={"k": f"SELECT id FROM functions WHERE {_EXT}"}) + "SELECT id, count FROM cedges WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)",
    "call_endpoints": after("cedges") + "SELECT from_id AS id FROM cedges UNION SELECT to_id FROM cedges",
    "faded_functions": after("functions") + "SELECT id FROM functions WHERE NOT (visibility = 'external' OR state_mutability = 'payable')",
    "search_fuzzy": after("contracts", more={
        "h": "SELECT id, name, CASE WHEN name = 'spl' THEN 1 WHEN starts_with(name, 'spl') THEN 2 WHEN contains(name, 'spl') THEN 3 WHEN contains(lower(id), 'spl') THEN 4 WHEN length(regexp_extract(name, 's[^p]*p[^l]*l')) BETWEEN 1 AND 7.5 THEN 5 END AS tier, id AS whole FROM (SELECT file || ':' || name AS id, lower(name) AS name FROM contracts)",
    }) + "SELECT h.id, c.name, 'Contract' AS kind, ['name', 'prefix', 'contains', 'path', 'fuzzy'][tier] AS match FROM h JOIN contracts c ON c.file || ':' || c.name = h.id WHERE tier IS NOT NULL ORDER BY tier, length(h.id), h.id LIMIT 50",
    "search_palette": after("functions", "variables", "contracts", more={"nodes": "SELECT id, name, 'Function' AS kind FROM functions UNION ALL SELECT id, name, 'StateVariable' FROM variables UNION ALL SELECT id, name, 'Contract' FROM contracts",
        "m": "SELECT *, CASE WHEN lower(name) = q THEN 1 WHEN starts_with(lower(name), q) THEN 2 WHEN contains(lower(name), q) THEN 3 WHEN contains(lower(id), q) THEN 4 END AS tier FROM nodes, (SELECT 'supplier#00000000' AS q)"})
    + "SELECT id, name, kind, ['name', 'prefix', 'contains', 'path'][tier] AS match FROM m WHERE tier IS NOT NULL ORDER BY tier, length(id), id LIMIT 50",
    "node_ref_resolve": after("functions", "contracts", more={"nm": "SELECT replace(name, ' ', '_') AS w FROM functions WHERE k = 42"})
    + "SELECT DISTINCT CAST(3 AS BIGINT) AS form, c.file || ':' || c.name || '.' || replace(f.name, ' ', '_') || '(' || f.state_mutability || ')' AS id FROM functions f JOIN contracts c ON c.id = f.scope JOIN nm ON w = replace(f.name, ' ', '_')",
    "name_similarities": after(more={"g": _BIGRAMS, "t": "SELECT n, sum(c) AS t FROM g GROUP BY n"})
    + """SELECT a.n AS a, b.n AS b, round(2.0 * coalesce((SELECT sum(least(x.c, y.c)) FROM g x JOIN g y ON x.w = y.w WHERE x.n = a.n AND y.n = b.n), 0) / (a.t + b.t), 6) AS similarity
        FROM t a JOIN t b ON a.n < b.n AND split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) WHERE 2.0 * coalesce((SELECT sum(least(x.c, y.c)) FROM g x JOIN g y ON x.w = y.w WHERE x.n = a.n AND y.n = b.n), 0) / (a.t + b.t) >= 0.4""",
    "containment_join": after("functions", "contracts", more={"spans": _SPANS, "fi": _FINDINGS}) + 'SELECT fi.file, "offset", s.id AS node FROM fi LEFT JOIN spans s ON s.file = fi.file AND s.o <= "offset" AND "offset" + 5 <= s.o + s.l',
    "node_at_offset": after("functions", "contracts", more={"spans": _SPANS, "fi": _FINDINGS}) + 'SELECT fi.file, "offset" AS at, s.id FROM fi JOIN spans s ON s.file = fi.file AND s.o <= "offset" AND "offset" < s.o + s.l',
    "path_normalise": r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || '/y/z', '/+', '/', 'g') AS path FROM pages",
    "lookup_fallback": after("calls", "functions", more={"w": "SELECT DISTINCT c.from_id, regexp_extract(c.to_id, ':(.*)$', 1) AS name, f.scope, f.scope_k FROM calls c JOIN functions f ON f.id = c.from_id WHERE c.kind = 'calls' AND c.resolution = 'unresolved'",
        "l": "SELECT w.from_id, w.name, f.id AS target FROM w JOIN functions f ON f.scope = w.scope AND f.p_name = w.name"})
    + """SELECT from_id, name, target, 'local' AS via FROM l UNION ALL SELECT w.from_id, w.name, f.id, 'base' FROM w JOIN functions f ON f.scope = 'c:' || (w.scope_k // 2) AND f.p_name = w.name
        WHERE w.scope_k >= 2 AND NOT EXISTS (SELECT 1 FROM l WHERE l.from_id = w.from_id AND l.name = w.name)""",
    "shadow_anti_join": after("aedges", "calls") + "SELECT from_id, to_id FROM aedges a WHERE kind = 'reads' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.from_id = a.from_id AND c.to_id = replace(a.to_id, 'v:', 'f:'))",
    "diff_edges": after("cedges", more={"e": "SELECT kind || '|' || coalesce(subkind, '') || '|' || from_id || '|' || to_id AS key, CAST(replace(from_id, 'f:', '') AS BIGINT) AS k FROM cedges WHERE kind = 'calls'"})
    + "SELECT CASE WHEN k % 29 = 0 THEN 'removed' WHEN k % 31 = 0 THEN 'modified' ELSE 'unchanged' END AS status, key, CASE WHEN k % 29 <> 0 AND k % 31 = 0 THEN 'count' ELSE '' END AS changes FROM e",
    "review_staleness": after("functions", more={"bef": _BEFORE, "aft": _AFTER, "r": _REVIEWS}) + "SELECT node, status, CASE WHEN a.id IS NULL THEN 'orphaned' WHEN a.body_hash <> r.body_hash THEN 'stale' ELSE 'current' END AS state FROM r LEFT JOIN aft a ON a.id = node",
    "findings_staleness": after("functions", more={"bef": _BEFORE, "aft": _AFTER, "i": _IMPORTED, "s": "SELECT i.id, count(*) AS n, count(*) FILTER (a.id IS NULL) AS gone, count(*) FILTER (a.body_hash <> i.body_hash) AS changed FROM i LEFT JOIN aft a ON a.id = nid GROUP BY i.id"})
    + "SELECT id, CASE WHEN gone = n THEN 'orphaned' WHEN gone + changed > 0 THEN 'stale' ELSE 'current' END AS state FROM s",
    "audit_projection": after("functions", more={"r": _REVIEWS, "i": _IMPORTED, "c": "SELECT nid, count(DISTINCT id) AS n FROM i GROUP BY nid", "rs": "SELECT node, status, CASE WHEN f.id IS NULL THEN 'orphaned' ELSE 'current' END AS st FROM r LEFT JOIN functions f ON f.id = node"})
    + "SELECT coalesce(node, nid) AS node, status, st AS review_state, coalesce(n, 0) AS findings FROM rs FULL OUTER JOIN c ON nid = node",
    "storage_layout": after("variables") + "SELECT scope, string_agg(name, ',' ORDER BY k) AS layout FROM variables GROUP BY scope",
    "line_offsets": after(more={"l": "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"})
    + "SELECT doc_id, i AS line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", strlen(t) AS length FROM l",
    "doc_metrics": "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines FROM documents",
    "glob_filter": r"SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^(.*/)?(en|fr)/[^/]*$') AND NOT regexp_matches(path, '^(.*/)?en/1[^/]*$')",
    "json_props": "SELECT event_type, count(*) AS count, CAST(sum(length(props)) AS BIGINT) AS chars, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY event_type",
    "dot_export": after("contracts", "inherits") + """SELECT '  "' || id || '" [label="' || name || '", shape=box];' AS line FROM contracts UNION ALL SELECT '  "' || from_id || '" -> "' || to_id || '" [label="inherits", style=solid];' FROM inherits""",
    "mermaid_export": after("contracts", "inherits", more={"a": "SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS alias FROM contracts"})
    + """SELECT '  ' || a.alias || ' -->|"inherits (heuristic)"| ' || b.alias AS line FROM inherits JOIN a ON a.id = from_id JOIN a b ON b.id = to_id""",
    "file_lenses": after("functions", "cedges", "aedges", more={"f": "SELECT id FROM functions"})
    + """SELECT f.id, (SELECT count(DISTINCT from_id) FROM cedges WHERE to_id = f.id) AS callers,
        CAST(coalesce((SELECT sum(count) FROM cedges WHERE from_id = f.id AND kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel')), 0) AS BIGINT) AS external_sites,
        (SELECT count(DISTINCT to_id) FROM aedges WHERE from_id = f.id AND kind = 'writes') AS written, (SELECT count(DISTINCT to_id) FROM aedges WHERE from_id = f.id AND kind = 'reads') AS read FROM f""",
    "edge_widths": after("emits", more={"e": "SELECT from_id, to_id, count(*) AS c FROM emits GROUP BY ALL"}) + "SELECT from_id || '|' || to_id || '|emits|' AS id, round(least(6.0, 1 + log2(greatest(1, c))), 6) AS width FROM e",
    "weakest_resolution": after("calls") + "SELECT from_id, CAST(max(rank) AS BIGINT) AS rank, count(*) AS sites FROM calls GROUP BY from_id",
    "mutability_ranks": after("functions") + "SELECT CAST(list_position(['pure', 'view', 'nonpayable', 'payable'], state_mutability) - 1 AS BIGINT) AS rank, count(*) AS count FROM functions GROUP BY 1",
    "parse_sources": after("functions", "contracts", more={"v": "SELECT c_custkey AS k FROM customer"})
    + """SELECT 'src/S' || f.scope_k || '.sol:S' || f.scope_k || '.f' || f.k || '()' AS id, CASE WHEN f.visibility = 'default' AND c.contract_kind = 'interface' THEN 'external' ELSE f.visibility END AS visibility, f.state_mutability,
        v.k IS NOT NULL AS has_body, CAST(CASE WHEN v.k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS cyclomatic FROM functions f JOIN contracts c ON c.id = f.scope LEFT JOIN v ON v.k = f.k""",
    "body_walk": after("functions") + """SELECT 'src/S' || scope_k || '.sol:S' || scope_k || '.f' || k || '()' AS id, 'v' || k AS name, w AS "write" FROM functions JOIN customer ON c_custkey = k, (VALUES (true), (false)) t(w)""",
    "resolve_sources": after("functions", "variables", "contracts", "inherits", more={"b": "SELECT count(*) AS n FROM functions f JOIN customer ON c_custkey = f.k"})
    + """SELECT 'declares' AS kind, 'heuristic' AS resolution, (SELECT count(*) FROM functions) + (SELECT count(*) FROM variables) + (SELECT count(*) FROM contracts) AS count
        UNION ALL SELECT 'inherits', 'heuristic', count(*) FROM inherits UNION ALL SELECT 'reads', 'heuristic', n FROM b UNION ALL SELECT 'writes', 'heuristic', n FROM b""",
}
