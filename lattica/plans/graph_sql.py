"""DuckDB SQL of the queries over whole graphs."""

from __future__ import annotations

from .oracles import _AFTER, _BEFORE, _HELD, _WALK, _walk, after

_NAMES = "('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8')"
_NUMBER = "CAST(replace({0}, 'c:', '') AS BIGINT)"
_ANC = {"a": "SELECT DISTINCT id, base FROM anc WHERE id <> base"}
_CHAIN = _ANC | {
    "ch": f"SELECT id, id AS base, 0 AS pos FROM contracts UNION ALL SELECT id, base, row_number() OVER (PARTITION BY id ORDER BY {_NUMBER.format('base')} DESC) FROM a",
    "first_of": "SELECT scope, name, arg_min(id, k) AS id, arg_min(has_body, k) AS has_body FROM functions WHERE subkind = 'function' GROUP BY scope, name",
    "inherited": "SELECT id, name, has_body FROM (SELECT ch.id, f.name, f.has_body, row_number() OVER (PARTITION BY ch.id, f.name ORDER BY pos) AS r FROM ch JOIN first_of f ON f.scope = ch.base) WHERE r = 1",
}
_WHOLE = _ANC | {
    "overs": """SELECT f.id AS from_id, b.id AS to_id, CASE WHEN b.has_body THEN 'overrides' ELSE 'implements' END AS kind FROM functions f JOIN a ON a.id = f.scope
        JOIN functions b ON b.scope = a.base AND b.name = f.name AND b.subkind = 'function' WHERE f.subkind = 'function'""",
    "wedges": """SELECT id, from_id, to_id, kind, count, resolution FROM cedges UNION ALL SELECT from_id || '|' || to_id || '|' || kind || '|', from_id, to_id, kind, count, 'heuristic' FROM aedges
        UNION ALL SELECT from_id || '|' || to_id || '|' || kind || '|', from_id, to_id, kind, 1, 'heuristic' FROM overs UNION ALL SELECT from_id || '|' || to_id || '|inherits|', from_id, to_id, 'inherits', 1, 'heuristic' FROM inherits""",
    "wnodes": """SELECT id, 'Contract' AS kind, name, NULL AS scope FROM contracts UNION ALL SELECT id, 'Function', name, scope FROM functions UNION ALL SELECT id, 'StateVariable', name, scope FROM variables
        UNION ALL SELECT DISTINCT to_id, 'Unresolved', regexp_extract(to_id, ':(.*)$', 1), NULL FROM calls WHERE to_id LIKE '?%'""",
}
_WHOLE_NEEDS = ("anc", "contracts", "functions", "variables", "inherits", "calls", "cedges", "aedges")
_ROLLUP = """SELECT 'rollup:' || a.container || '->' || b.container AS id, a.container AS from_id, b.container AS to_id, arg_min(kind, cedges.id) AS kind, CAST(sum(count) AS BIGINT) AS count,
    ['semantic', 'heuristic', 'ambiguous', 'unresolved'][max(list_position(['semantic', 'heuristic', 'ambiguous', 'unresolved'], resolution))] AS resolution
    FROM cedges JOIN held a ON a.id = from_id JOIN held b ON b.id = to_id WHERE a.container <> b.container GROUP BY a.container, b.container"""
_ARCS = """SELECT DISTINCT from_id AS src, to_id AS dst FROM calls WHERE kind = 'calls' AND resolution <> 'unresolved'
  UNION SELECT from_id, replace(to_id, 'c:', 'f:') FROM calls WHERE kind = 'creates' UNION SELECT from_id, to_id FROM modifiers WHERE to_id LIKE 'f:%'"""


def _whole(*more: str, **own: str) -> str:
    return after(*_WHOLE_NEEDS, *more, more=_WHOLE | own)


def _alone(before: str, later: str, keys: str) -> str:
    """Pairs of the keys that one row on either side has."""
    one = f"SELECT {keys}, min(id) AS id FROM {{0}} GROUP BY {keys} HAVING count(*) = 1"
    return f"SELECT b.id AS before, a.id AS after FROM ({one.format(before)}) b JOIN ({one.format(later)}) a USING ({keys})"


def _left(side: str, found: str, key: str) -> str:
    return f"SELECT * FROM {side} WHERE id NOT IN (SELECT {key} FROM {found})"


MATCHING = {"bef": _BEFORE, "aft": _AFTER, "b1": "SELECT * FROM bef WHERE id NOT IN (SELECT id FROM aft)", "a1": "SELECT * FROM aft WHERE id NOT IN (SELECT id FROM bef)"}
MATCHING |= {"bb1": "SELECT * FROM b1 WHERE body_hash <> ''", "ab1": "SELECT * FROM a1 WHERE body_hash <> ''"}
for _i, _keys in enumerate(("body_hash, name", "body_hash, scope", "body_hash"), 1):
    MATCHING |= {f"t{_i}": _alone(f"bb{_i}", f"ab{_i}", _keys), f"bb{_i + 1}": _left(f"bb{_i}", f"t{_i}", "before"), f"ab{_i + 1}": _left(f"ab{_i}", f"t{_i}", "after")}
MATCHING |= {
    "body": "SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3", "bs": _left("b1", "body", "before"), "sa": _left("a1", "body", "after"), "sig": _alone("bs", "sa", "scope, name"),
    "matches": """SELECT bef.id AS before, bef.id AS after, 'exact' AS tier, 1.0::DOUBLE AS confidence FROM bef JOIN aft USING (id) UNION ALL SELECT before, after, 'body', 0.95 FROM body
        UNION ALL SELECT before, after, 'signature', 0.9 FROM sig""",
}
_FIELDS = ("body_hash", "file", "has_body", "name", "scope", "state_mutability", "visibility")
DIFFED = MATCHING | {
    "d": "SELECT CASE WHEN changes = '' THEN 'unchanged' WHEN moved THEN 'moved' WHEN renamed THEN 'renamed' ELSE 'modified' END AS status, id, changes FROM (SELECT a.id, b.scope <> a.scope OR b.file <> a.file AS moved, b.name <> a.name AS renamed, concat_ws(',', "
    + ", ".join(f"CASE WHEN b.{f} <> a.{f} THEN '{f}' END" for f in _FIELDS)
    + """) AS changes FROM matches m JOIN bef b ON b.id = m.before JOIN aft a ON a.id = m.after)
        UNION ALL SELECT 'removed', id, '' FROM bef WHERE id NOT IN (SELECT before FROM matches) UNION ALL SELECT 'added', id, '' FROM aft WHERE id NOT IN (SELECT after FROM matches)"""
}
_REVIEWS = "SELECT id AS node, 'reviewed' AS status, body_hash FROM functions WHERE k % 10 = 0 UNION ALL SELECT 'gone:' || s_suppkey, 'flagged', 'x' FROM supplier WHERE s_suppkey % 7 = 0"

_C = "SELECT s_suppkey AS k, 'lib/C' || s_suppkey || '.sol' AS file, 'lib/C' || s_suppkey || '.sol:C' || s_suppkey AS id FROM supplier"
_UP = "SELECT s_suppkey AS k, s_suppkey // 2 AS up FROM supplier WHERE s_suppkey >= 2 UNION SELECT k, up // 2 FROM up WHERE up >= 2"
_PEER = "'lib/C' || ((k + {0}) % n) || '.sol:C' || ((k + {0}) % n)"
_DRAFTS = f"""SELECT 'declares' AS kind, NULL AS subkind, file AS from_id, id AS to_id, 'heuristic' AS resolution FROM c
    UNION ALL SELECT 'declares', NULL, id, id || m, 'heuristic' FROM (SELECT id, unnest(['^E' || k || '(uint256)', '!X' || k || '()', '.v' || k, '.peer', '#m' || k || '()', '.constructor()', '.own' || k || '()', '.tick()', '.go' || k || '()']) AS m FROM c)
    UNION ALL SELECT 'inherits', NULL, id, 'lib/C' || (k // 2) || '.sol:C' || (k // 2), 'heuristic' FROM c WHERE k >= 2
    UNION ALL SELECT 'overrides', NULL, id || '.tick()', 'lib/C' || up || '.sol:C' || up || '.tick()', 'heuristic' FROM c JOIN up USING (k)
    UNION ALL SELECT 'modifiedBy', NULL, id || '.go' || k || '()', id || '#m' || k || '()', 'heuristic' FROM c
    UNION ALL SELECT 'reads', NULL, id || '.own' || k || '()', id || '.v' || k, 'heuristic' FROM c UNION ALL SELECT 'writes', NULL, id || '.own' || k || '()', id || '.v' || k, 'heuristic' FROM c
    UNION ALL SELECT 'writes', NULL, id || '.go' || k || '()', id || '.v' || k, 'heuristic' FROM c UNION ALL SELECT 'reads', NULL, id || '.go' || k || '()', id || '.peer', 'heuristic' FROM c
    UNION ALL SELECT 'emits', NULL, id || '.go' || k || '()', id || '^E' || k || '(uint256)', 'heuristic' FROM c UNION ALL SELECT 'reverts', NULL, id || '.go' || k || '()', id || '!X' || k || '()', 'heuristic' FROM c
    UNION ALL SELECT 'calls', 'internal', id || '.tick()', id || '.own' || k || '()', 'heuristic' FROM c
    UNION ALL SELECT 'calls', 'super', id || '.tick()', CASE WHEN k >= 2 THEN 'lib/C' || (k // 2) || '.sol:C' || (k // 2) || '.tick()' ELSE '?not-found:tick' END, CASE WHEN k >= 2 THEN 'heuristic' ELSE 'unresolved' END FROM c
    UNION ALL SELECT 'calls', 'external', id || '.go' || k || '()', id || '.tick()', 'heuristic' FROM c
    UNION ALL SELECT 'calls', 'external', id || '.go' || k || '()', {_PEER.format(1)} || '.tick()', 'heuristic' FROM c, n UNION ALL SELECT 'calls', 'external', id || '.go' || k || '()', {_PEER.format(2)} || '.tick()', 'heuristic' FROM c, n
    UNION ALL SELECT 'creates', NULL, id || '.go' || k || '()', {_PEER.format(3)}, 'heuristic' FROM c, n
    UNION ALL SELECT 'calls', 'internal', id || '.go' || k || '()', '?not-found:gone' || k, 'unresolved' FROM c UNION ALL SELECT 'calls', 'lowlevel', id || '.go' || k || '()', '?low-level:call', 'unresolved' FROM c"""
_RESOLVED = {"c": _C, "up": _UP, "drafts": _DRAFTS}

_PLACED = {
    "spot": "SELECT f.id, f.k, c.file FROM functions f JOIN contracts c ON c.id = f.scope",
    "owned": "SELECT file, n_name FROM files WHERE nation % 5 <> 0",
    "dr": "SELECT c.kind, c.from_id, c.to_id, c.resolution, c.off, spot.file, CASE WHEN c.to_id LIKE 'f:%' THEN CAST(replace(c.to_id, 'f:', '') AS BIGINT) END AS t FROM calls c JOIN spot ON spot.id = c.from_id",
    "refs": """SELECT dr.file, off, min(spot.id) AS target FROM dr JOIN owned o ON o.file = dr.file JOIN spot ON spot.k = CASE WHEN t % 4 = 0 THEN t + 2 ELSE t END WHERE t % 2 = 0 GROUP BY dr.file, off""",
    "placed": """SELECT dr.*, r.target, row_number() OVER (PARTITION BY from_id, kind, dr.file, dr.off ORDER BY CASE WHEN to_id <> coalesce(r.target, '') THEN 1 ELSE 0 END, to_id) AS i
        FROM dr LEFT JOIN refs r ON r.file = dr.file AND r.off = dr.off""",
}

_COMPILED = {
    "f": "SELECT p_partkey AS p, p_partkey % n AS k, 'lib/C' || (p_partkey % n) || '.sol' AS file, p_partkey * 100 + 1000 AS o FROM part, n",
    "c": "SELECT DISTINCT k, file FROM f",
    "bad": "SELECT DISTINCT k // 25 AS g FROM f",
    "stale": "SELECT DISTINCT k // 25 AS g FROM c WHERE k % 7 = 0",
}

_VARIED = """calls delegatecall M.low(address) ?low-level:delegatecall unresolved
calls external M.chained(uint256) ?dynamic-receiver:ping unresolved
calls external M.detached(address) ?unattached-member:nothing unresolved
calls external M.far(uint256) I.ping(uint256) heuristic
calls external M.getter(address) B.total heuristic
calls external M.none(uint256) ?not-found:pong unresolved
calls external M.own() B.step(address) ambiguous
calls external M.own() M.step(uint256) ambiguous
calls internal M.chained(uint256) M.make() heuristic
calls internal M.constructor() B.constructor(uint256) heuristic
calls internal M.local(uint256) ?function-pointer:f unresolved
calls internal M.loose(uint256) p{k}/lib.sol:free{k}(uint256) heuristic
calls internal M.narrowed() B.step(uint256,uint256) heuristic
calls internal M.overloads() B.step(address) ambiguous
calls internal M.overloads() M.step(uint256) ambiguous
calls internal M.pointed(uint256) ?function-pointer:pointer unresolved
calls internal M.spaced(uint256) p{k}/lib.sol:twice{k}(uint256) heuristic
calls internal M.unfit() B.step(address) ambiguous
calls internal M.unfit() B.step(uint256,uint256) ambiguous
calls internal M.unfit() M.step(uint256) ambiguous
calls library M.aliased(uint256) L.plus(uint256) heuristic
calls library M.attached(uint256) L.plus(uint256) ambiguous
calls library M.attached(uint256) L.plus(uint256,uint256) ambiguous
calls library M.listed(address) p{k}/lib.sol:free{k}(uint256) heuristic
calls library M.single(uint256) L.only(uint256) heuristic
creates - M.built() B heuristic
inherits - M B heuristic
modifiedBy - M.step(uint256) B#held(uint256) heuristic
overrides - M.step(uint256) B.step(uint256) heuristic
reads - M.far(uint256) M.peer heuristic
reads - M.none(uint256) M.peer heuristic
writes - M.stored(uint256) B.total heuristic"""
_OWNERS = {"M": "p{k}/main.sol:Main{k}", "B": "p{k}/lib.sol:Base{k}", "I": "p{k}/lib.sol:I{k}", "L": "p{k}/lib.sol:L{k}"}


def _varied() -> str:
    """A row of SQL for each line above, with the owners' letters written out."""
    full = lambda x: _OWNERS[x[0]] + x[1:] if x[0] in _OWNERS and x[1:2] in ("", ".", "#") else x
    lines = (line.split() for line in _VARIED.splitlines())
    rows = ", ".join(f"('{kind}', {'NULL' if sub == '-' else repr(sub)}, '{full(a)}', '{full(b)}', '{sure}')" for kind, sub, a, b, sure in lines)
    put = lambda c: f"replace({c}, '{{k}}', s_suppkey::VARCHAR) AS {c}"
    return f"SELECT kind, subkind, {put('from_id')}, {put('to_id')}, resolution FROM supplier, (VALUES {rows}) t(kind, subkind, from_id, to_id, resolution)"


_SURFACE = {
    "fn": f"""SELECT f.id, f.k, f.scope, f.name, f.visibility, f.state_mutability AS m0, CASE WHEN f.k % 53 = 0 THEN 'payable' ELSE f.state_mutability END AS m1, g.access, g.guards,
        split_part(f.scope, ':', 2) || '.' || f.name AS q FROM functions f JOIN guards g USING (id) WHERE f.subkind = 'function'""",
    "ev": """SELECT *, CASE WHEN m0 <> m1 OR k % 59 = 0 OR (k % 61 = 0 AND access <> 'none') THEN 'direct' ELSE 'consequence' END AS evidence FROM fn""",
    "out_before": "SELECT DISTINCT from_id FROM cedges WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') AND CAST(replace(from_id, 'f:', '') AS BIGINT) % 3 <> 0",
    "out_after": "SELECT DISTINCT from_id FROM cedges WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel')",
    "lay": """SELECT scope, coalesce(string_agg(name, ',' ORDER BY k), '') AS l0, coalesce(string_agg(name, ',' ORDER BY k) FILTER (k % 67 <> 0), '') AS l1 FROM variables GROUP BY scope""",
}

ORACLES = {
    "view_protocol": after("cedges", "functions", "contracts", "inherits", more={"keep": "SELECT id FROM contracts WHERE NOT is_test AND NOT is_mock", "held": f"SELECT * FROM ({_HELD}) WHERE container IN (SELECT id FROM keep)"})
    + f"SELECT from_id || '|' || to_id || '|inherits|' AS id, from_id, to_id, 'inherits' AS kind, 1 AS count, 'heuristic' AS resolution FROM inherits WHERE from_id IN (SELECT id FROM keep) AND to_id IN (SELECT id FROM keep) UNION ALL {_ROLLUP}",
    "view_sizes": _whole("hops", held=_HELD, roll=_ROLLUP, b="SELECT base AS id FROM a WHERE id = 'c:9' UNION SELECT 'c:9'", ck="SELECT id FROM b UNION SELECT id FROM wnodes WHERE scope IN (SELECT id FROM b)", **_walk("down", 3), **_walk("up", 2),
                         vk="SELECT id FROM walk_down UNION SELECT id FROM walk_up", ov="SELECT from_id AS id FROM overs UNION SELECT to_id FROM overs")
    + """SELECT 'protocol' AS view, (SELECT count(*) FROM contracts) AS nodes, (SELECT count(*) FROM inherits) + (SELECT count(*) FROM roll) AS edges
        UNION ALL SELECT 'inheritance', (SELECT count(*) FROM contracts) + (SELECT count(*) FROM ov), (SELECT count(*) FROM inherits) + (SELECT count(*) FROM overs)
        UNION ALL SELECT 'state-access', (SELECT count(*) FROM (SELECT from_id FROM aedges UNION SELECT to_id FROM aedges)), (SELECT count(*) FROM aedges)
        UNION ALL SELECT 'contract', (SELECT count(*) FROM ck), (SELECT count(*) FROM wedges WHERE from_id IN (SELECT id FROM ck) AND to_id IN (SELECT id FROM ck))
        UNION ALL SELECT 'call', (SELECT count(*) FROM vk), (SELECT count(*) FROM cedges WHERE from_id IN (SELECT id FROM vk) AND to_id IN (SELECT id FROM vk))""",
    "view_aggregate": after("inherits", "contracts", more={"r": "SELECT id, CASE WHEN file LIKE 'asia/%' THEN id ELSE 'dir:' || regexp_replace(file, '/[^/]*$', '') END AS rep FROM contracts",
        "e": "SELECT from_id, to_id, a.rep AS x, b.rep AS y FROM inherits JOIN r a ON a.id = from_id JOIN r b ON b.id = to_id"})
    + """SELECT CASE WHEN x = from_id AND y = to_id THEN 'edge' WHEN x = y THEN 'internal' ELSE 'aggregate' END AS type, x AS from_id, y AS to_id, count(*) AS count, count(*) AS pairs FROM e GROUP BY ALL
        UNION ALL SELECT 'node', CASE WHEN rep LIKE 'dir:%' THEN rep ELSE 'drawn' END, NULL, count(DISTINCT rep), count(DISTINCT rep) FROM r GROUP BY 2""",
    "view_nested": after("contracts", "functions", "variables", "inherits", "cedges") + """SELECT 'node' AS what, id AS from_id, NULL AS to_id, 'Contract' AS kind FROM contracts UNION ALL SELECT 'node', id, scope, 'Function' FROM functions
        UNION ALL SELECT 'node', id, scope, 'StateVariable' FROM variables UNION ALL SELECT 'edge', from_id, to_id, 'declares' FROM inherits
        UNION ALL SELECT 'edge', from_id, to_id, 'calls' FROM cedges WHERE to_id IN (SELECT id FROM contracts UNION ALL SELECT id FROM functions)""",
    "view_compound": after("inherits", "contracts", more={
        "d": "SELECT id, regexp_replace(file, '/[^/]*$', '') AS dir FROM contracts", "t": "SELECT id, dir, split_part(dir, '/', 1) AS top, split_part(dir, '/', 1) IN ('asia', 'africa') AS o FROM d",
        "r": "SELECT id, dir, o, CASE WHEN o AND dir = top THEN id WHEN o THEN 'dir:' || dir ELSE 'dir:' || top END AS rep FROM t",
        "p": "SELECT top AS path, count(*) AS members FROM t GROUP BY top UNION ALL SELECT dir, count(*) FROM t WHERE o AND dir <> top GROUP BY dir",
        "e": "SELECT from_id, to_id, a.rep AS x, b.rep AS y FROM inherits JOIN r a ON a.id = from_id JOIN r b ON b.id = to_id",
        "i": "SELECT x AS id, count(*) AS n FROM e WHERE x = y AND x <> from_id GROUP BY x",
    }) + """SELECT 'cluster' AS type, 'dir:' || path AS from_id, CASE WHEN path LIKE '%/%' THEN 'dir:' || split_part(path, '/', 1) END AS to_id, members AS count, coalesce(n, 0) AS pairs, path IN ('asia', 'africa') AS expanded FROM p LEFT JOIN i ON i.id = 'dir:' || path
        UNION ALL SELECT 'node', id, 'dir:' || dir, 0, 0, false FROM r WHERE rep = id
        UNION ALL SELECT CASE WHEN x = from_id AND y = to_id THEN 'edge' ELSE 'aggregate' END, x, y, count(*), count(*), false FROM e WHERE x <> y GROUP BY ALL""",
    "view_errors": """SELECT * FROM (VALUES ('call', 'a call view needs a focus: the whole function graph is not readable'), ('contract', 'a contract view needs a focus contract'),
        ('contract', '"e:none" is not a node of this graph'), ('orbit', 'there is no view "orbit"')) t(view, message)""",
    "inheritance_view": _whole(ok="SELECT id FROM contracts WHERE NOT is_test AND NOT is_mock", m="SELECT f.id FROM functions f JOIN ok ON ok.id = f.scope")
    + "SELECT from_id, to_id, 'inherits' AS kind FROM inherits WHERE from_id IN (SELECT id FROM ok) AND to_id IN (SELECT id FROM ok) UNION ALL SELECT from_id, to_id, kind FROM overs WHERE from_id IN (SELECT id FROM m) AND to_id IN (SELECT id FROM m)",
    "applied_modifiers": after("modifiers") + "SELECT from_id, name, checks_sender FROM modifiers",
    "guarded_functions": after("modifiers") + f"SELECT DISTINCT from_id AS id FROM modifiers WHERE name IN {_NAMES}",
    "fully_implemented": after("anc", "contracts", "functions", more=_CHAIN) + "SELECT c.id, c.contract_kind <> 'interface' AND coalesce(bool_and(i.has_body), true) AS is_fully_implemented FROM contracts c LEFT JOIN inherited i ON i.id = c.id GROUP BY c.id, c.contract_kind",
    "state_flags": after("functions", "aedges", "modifiers") + """SELECT f.id, f.id IN (SELECT from_id FROM aedges WHERE kind = 'reads') AS reads, f.id IN (SELECT from_id FROM aedges WHERE kind = 'writes') AS writes,
        coalesce((SELECT string_agg(DISTINCT to_id, ',' ORDER BY to_id) FROM modifiers m WHERE m.from_id = f.id), '') AS modifiers FROM functions f""",
    "trust_boundaries": after("cedges", "functions", "contracts", more={"o": "SELECT f.id FROM functions f JOIN contracts c ON c.id = f.scope WHERE c.file LIKE 'africa/%'"})
    + "SELECT id, coalesce(subkind = 'delegatecall', false) OR to_id IN (SELECT id FROM o) AS cross_trust_boundary FROM cedges",
    "structural_graph": _whole() + "SELECT 'node' AS what, kind, count(*) AS count FROM wnodes WHERE kind <> 'Unresolved' GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM wedges WHERE kind NOT IN ('calls', 'creates') GROUP BY kind",
    "score_by_version": after("cedges", "functions", more={"e": "SELECT c.* FROM cedges c JOIN functions f ON f.id = c.from_id WHERE f.scope_k % 7 NOT IN (0, 3)",
        "t": "SELECT coalesce(sum(count) FILTER (resolution = 'heuristic'), 0) AS h, coalesce(sum(count) FILTER (resolution = 'ambiguous'), 0) AS a, coalesce(sum(count) FILTER (resolution = 'unresolved'), 0) AS u FROM e"})
    + """SELECT scope, CAST(h AS BIGINT) AS heuristic, CAST(a AS BIGINT) AS ambiguous, CAST(u AS BIGINT) AS unresolved, CAST(h + a + u AS BIGINT) AS total, CAST(floor(h / (h + a + u) * 100 + 0.5) AS BIGINT) || '%' AS share
        FROM t, (VALUES ('overall'), ('calls')) s(scope)""",
    "entrypoint_sets": after("entries", "calls", "modifiers", "guards", more={"arcs": _ARCS, "r": "SELECT id AS origin, id FROM entries UNION SELECT origin, dst FROM r JOIN arcs ON src = r.id", "c": "SELECT id, count(*) AS n FROM r GROUP BY id"})
    + f"""SELECT f.id, coalesce(n, 0) > 0 AS externally_reachable, coalesce(n, 0) AS entrypoints, g.access, f.id IN (SELECT from_id FROM modifiers WHERE name IN {_NAMES}) AS guarded
        FROM functions f JOIN guards g USING (id) LEFT JOIN c USING (id)""",
    "entrypoint_set_sizes": after("entries", "calls", "modifiers", more={
        "arcs": _ARCS + " UNION SELECT to_id, from_id FROM calls WHERE kind = 'calls' AND resolution <> 'unresolved' AND to_id LIKE 'f:%' AND to_id > from_id", "r": "SELECT id AS origin, id FROM entries UNION SELECT origin, dst FROM r JOIN arcs ON src = r.id",
    }) + "SELECT id, count(*) AS origins FROM r GROUP BY id",
    "positions": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+'), 1) AS i FROM documents),
        s AS (SELECT doc_id, i, w, regexp_extract(w, '^[ \t-\r]*') AS gap FROM w),
        u AS (SELECT *, length(w) + length(regexp_replace(w, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units, length(gap) - length(replace(gap, chr(10), '')) AS nl, length(regexp_extract(gap, '[^\n]*$')) AS tail FROM s),
        c AS (SELECT *, sum(strlen(w)) OVER o - strlen(w) + strlen(gap) AS byte, sum(units) OVER o - units + length(gap) AS utf16, 1 + sum(nl) OVER o AS line FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        l AS (SELECT *, max(CASE WHEN nl > 0 THEN utf16 - tail END) OVER (PARTITION BY doc_id ORDER BY i) AS start FROM c)
        SELECT doc_id, CAST(byte AS BIGINT) AS "offset", CAST(utf16 AS BIGINT) AS utf16, CAST(line AS BIGINT) AS line, CAST(utf16 - coalesce(start, 0) AS BIGINT) AS column FROM l""".replace("\\\\", "\\"),
    "inheritance_layers": after("inherits", more={
        "arcs": """SELECT from_id AS a, to_id AS b FROM inherits UNION SELECT to_id, from_id FROM inherits WHERE CAST(replace(from_id, 'c:', '') AS BIGINT) % 7 = 0 AND to_id = 'c:' || (CAST(replace(from_id, 'c:', '') AS BIGINT) // 2)""",
        "r": "SELECT a, b FROM arcs UNION SELECT r.a, arcs.b FROM r JOIN arcs ON arcs.a = r.b",
        "comp": "SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a",
        "n": "SELECT 'c:' || s_suppkey AS id, coalesce(component, 'c:' || s_suppkey) AS g FROM supplier LEFT JOIN comp ON comp.id = 'c:' || s_suppkey",
        "e": "SELECT DISTINCT x.g AS a, y.g AS b FROM arcs JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.g <> y.g",
        "d": "SELECT DISTINCT g, 0 AS layer FROM n UNION SELECT e.b, layer + 1 FROM d JOIN e ON e.a = d.g",
    }) + "SELECT n.id, max(layer) AS layer, any_value(component) AS component FROM n JOIN d USING (g) LEFT JOIN comp ON comp.id = n.id GROUP BY n.id",
    "callers_of_top": after("hops", more={"top": "SELECT to_id AS id FROM calls WHERE to_id LIKE 'f:%' GROUP BY 1 ORDER BY count(DISTINCT from_id) DESC, to_id LIMIT 1",
        "walk_up": _WALK.format(way="up", depth=2).replace("SELECT 'f:42' AS id, 0 AS depth", "SELECT id, 0 AS depth FROM top")})
    + "SELECT id, min(depth) AS depth FROM walk_up WHERE id NOT IN (SELECT id FROM top) GROUP BY id",
    "c3_chain": """WITH RECURSIVE c AS (SELECT s_suppkey AS k, s_suppkey AS up, 'c:' || s_suppkey AS l FROM supplier UNION ALL SELECT k, up // 2, l || ',c:' || (up // 2) FROM c WHERE up >= 2)
        SELECT 'c:' || k AS id, l AS linearized, 'certain' AS certainty FROM c WHERE up < 2""",
    "node_relations": _whole() + """SELECT 'outgoing' AS direction, e.kind AS edge_kind, to_id AS other, n.name, resolution, count FROM wedges e LEFT JOIN wnodes n ON n.id = to_id WHERE from_id = 'c:9'
        UNION ALL SELECT 'incoming', e.kind, from_id, n.name, resolution, count FROM wedges e LEFT JOIN wnodes n ON n.id = from_id WHERE to_id = 'c:9'
        UNION ALL SELECT 'member', 'declares', id, name, 'heuristic', 1 FROM wnodes WHERE scope = 'c:9'""",
    "lens_titles": after("functions", "cedges", "aedges", more={
        "i": "SELECT to_id AS id, count(DISTINCT from_id) AS c FROM cedges GROUP BY 1",
        "x": "SELECT from_id AS id, sum(count) AS c FROM cedges WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') GROUP BY 1",
        "w": "SELECT from_id AS id, count(DISTINCT to_id) FILTER (kind = 'writes') AS w, count(DISTINCT to_id) FILTER (kind = 'reads') AS r FROM aedges GROUP BY 1"})
    + """SELECT f.id, concat_ws(' · ', CASE WHEN i.c = 1 THEN '1 caller' WHEN i.c > 1 THEN i.c || ' callers' END, CASE WHEN x.c = 1 THEN '1 external call' WHEN x.c > 1 THEN x.c || ' external calls' END,
        CASE WHEN w = 1 THEN '1 write' WHEN w > 1 THEN w || ' writes' END, CASE WHEN r = 1 THEN '1 read' WHEN r > 1 THEN r || ' reads' END) AS title FROM functions f LEFT JOIN i USING (id) LEFT JOIN x USING (id) LEFT JOIN w USING (id)""",
    "nodes_in_file": after("functions", "contracts") + 'SELECT f.id, f.k * 100 AS "offset" FROM functions f JOIN contracts c ON c.id = f.scope WHERE c.file = (SELECT file FROM contracts WHERE k = 9)',
    "suggestions": after("contracts") + "SELECT id FROM (SELECT file || ':' || name AS id FROM contracts) WHERE contains(id, '#00000000') ORDER BY id LIMIT 8",
    "type_names": "SELECT p_partkey, lower(p_type) || '[' || p_size || ']memory' AS type, lower(p_type) AS base, '(' || lower(p_type) || '[' || p_size || ']memory,uint256)' AS signature FROM part",
    "review_updates": after("functions") + """SELECT id AS node, 'reviewed' AS status, CASE WHEN k % 20 = 0 THEN 'old' ELSE body_hash END AS body_hash FROM functions WHERE k % 10 = 0 AND k % 15 <> 0 AND k NOT IN (10, 30)
        UNION ALL SELECT id, 'flagged', body_hash FROM functions WHERE k % 15 = 0 AND k NOT IN (10, 30) UNION ALL SELECT 'gone:' || s_suppkey, 'follow-up', 'x' FROM supplier WHERE s_suppkey % 7 = 0""",
    "review_deltas": after("functions", more={
        "st": "SELECT id, k, CASE WHEN k % 3 = 0 THEN 'flagged' ELSE 'reviewed' END AS status FROM functions", "s0": "SELECT * FROM st WHERE k % 2 = 0",
        "s1": "SELECT id, k, CASE WHEN k % 11 = 0 AND status = 'reviewed' THEN 'ignored' ELSE status END AS status FROM s0 WHERE k % 5 <> 0", "s3": "SELECT * FROM st WHERE k % 7 <> 0",
    }) + " UNION ALL ".join(f"""SELECT {n} AS batch, coalesce(y.id, x.id) AS node, CASE WHEN x.id IS NULL THEN 'set' WHEN y.id IS NULL THEN 'cleared' ELSE 'changed' END AS change, coalesce(y.status, x.status) AS status
        FROM {a} x FULL JOIN {b} y ON y.id = x.id WHERE x.status IS DISTINCT FROM y.status""" for n, a, b in ((0, "(SELECT * FROM s0 WHERE false)", "s0"), (1, "s0", "s1"), (3, "s1", "s3"))),
    "audit_summary": """SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) AS reviewed, CAST(0 AS BIGINT) AS flagged, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS follow_up, CAST(0 AS BIGINT) AS ignored,
        (SELECT count(*) FROM part WHERE p_partkey % 20 = 0) AS stale_reviews, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS orphaned_reviews, (SELECT count(*) FROM part WHERE p_partkey % 9 = 0) AS findings,
        (SELECT count(*) FROM part WHERE p_partkey % 18 = 0) AS stale_findings""",
    "suffix_paths": after("files") + """SELECT CASE nation % 4 WHEN 0 THEN file WHEN 1 THEN '/work/' || file WHEN 2 THEN '/work/deep/' || file ELSE regexp_extract(file, '[^/]*$') END AS path,
        CASE nation % 4 WHEN 2 THEN 'deep/' || file WHEN 3 THEN least(file, 'deep/' || file) ELSE file END AS file FROM files""",
    "findings_import": after("functions", "contracts", more={
        "sp": "SELECT f.id, f.k, c.file FROM functions f JOIN contracts c ON c.id = f.scope", "pair": "SELECT id, k, file FROM sp UNION ALL SELECT id || 'd', k, 'deep/' || file FROM sp",
        "r": "SELECT *, 'check' || (k % 3) AS c, unnest(range(CASE WHEN k % 6 = 1 THEN 2 ELSE 1 END)) AS again FROM pair",
    }) + """SELECT CASE WHEN reason IS NULL THEN c || '@' || file || ':' || (k * 100 + 70) || CASE WHEN again = 1 THEN '#1' ELSE '' END ELSE c END AS id, coalesce(reason, id) AS node,
        CAST(CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS BIGINT) AS places, id || ' ' || again AS description
        FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'the finding names no source element' WHEN k % 7 = 0 THEN 'no element carries a source mapping' WHEN k % 12 = 0 OR k % 8 = 0 THEN 'no node contains any of its places' END AS reason FROM r)""",
    "stored_graph": _whole() + "SELECT 'node' AS what, kind, count(*) AS count FROM wnodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM wedges WHERE kind <> 'calls' OR resolution <> 'unresolved' GROUP BY kind",
    "graph_json": _whole(bs=f"SELECT id, string_agg(base, ',' ORDER BY {_NUMBER.format('base')} DESC) AS bs FROM a GROUP BY id")
    + """SELECT 'node' AS what, n.id, kind, name, coalesce(bs, '') AS more, CAST(1 AS BIGINT) AS count FROM wnodes n LEFT JOIN bs USING (id)
        UNION ALL SELECT 'edge', id, kind, NULL, from_id || '>' || to_id, CAST(count AS BIGINT) FROM wedges WHERE kind <> 'calls' OR resolution <> 'unresolved'""",
    "import_resolution": after("inherits", more={"b": f"SELECT replace(from_id, 'c:', '') AS f, replace(to_id, 'c:', '') AS t, {_NUMBER.format('to_id')} % 5 AS m FROM inherits"})
    + """SELECT 'src/S' || f || '.sol' AS file, ['./', '../src/x/../', '@lib/', '', 'none/'][1 + m] || 'S' || t || '.sol' AS path, CASE WHEN m < 4 THEN 'src/S' || t || '.sol' END AS target FROM b""",
    "prefix_remap": r"""SELECT page_id, rtrim(regexp_replace(CASE WHEN starts_with(p, 'blog.th') THEN 'weblog/' || substr(p, 8) WHEN starts_with(p, 'blog.') THEN 'blog/' || substr(p, 6) WHEN starts_with(p, 'www.') THEN 'web/' || substr(p, 5)
        WHEN starts_with(p, 'm.') THEN CASE WHEN page_id % 2 = 0 THEN 'english/' ELSE 'mobile/' END || substr(p, 3) ELSE 'node_modules/' || p END, '/+', '/', 'g'), '/') AS path
        FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages)""",
    "visible_names": """SELECT 'src/S' || s_suppkey || '.sol' AS file, 'S' || s_suppkey AS name, 'c:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'src/S' || s_suppkey || '.sol', 'S' || (s_suppkey // 2), 'c:' || (s_suppkey // 2) FROM supplier WHERE s_suppkey >= 2
        UNION ALL SELECT 'src/S' || s_suppkey || '.sol', 'A' || (s_suppkey // 3), 'c:' || (s_suppkey // 3) FROM supplier WHERE s_suppkey >= 2 AND s_suppkey // 3 <> s_suppkey // 2""",
    "parsed_symbol_stats": """SELECT count(*) FILTER (s_suppkey % 4 = 0) AS contracts, count(*) FILTER (s_suppkey % 4 = 1) AS interfaces, count(*) FILTER (s_suppkey % 4 = 2) AS librarys, count(*) FILTER (s_suppkey % 4 = 3) AS abstracts,
        (SELECT count(*) FROM part) AS functions, (SELECT count(*) FROM customer) AS variables, (SELECT count(*) FROM part JOIN customer ON c_custkey = p_partkey) AS with_body, count(*) AS files FROM supplier""",
    "parse_diagnostics": """SELECT 'p/P' || s_suppkey || '.sol' AS file, ['', 'pragma is best-effort: pragma solidity >=0.5.0 <0.8.0', 'pragma is unsupported: pragma solidity ^0.4.11', 'pragma is best-effort: pragma solidity 0.6.12'][1 + s_suppkey % 4] AS message, 'info' AS severity
        FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'p/P' || s_suppkey || '.sol:P' || s_suppkey || '.g()', '2', 'duplicate' FROM supplier WHERE s_suppkey % 3 = 0""",
    "incremental_build": """WITH c AS (SELECT s_suppkey AS k, 'lib/C' || s_suppkey || '.sol' AS file FROM supplier),
        s AS (SELECT k, file, CASE WHEN k % 11 = 0 AND k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'added' WHEN k % 13 = 0 THEN 'removed' WHEN k % 10 = 0 THEN 'changed' ELSE 'same' END AS status FROM c)
        SELECT file, status, status = 'added' OR status = 'changed' AND k % 20 = 0 AS parsed, 2 AS round FROM s WHERE status IS NOT NULL
        UNION ALL SELECT file, 'same', false, 3 FROM c WHERE k % 13 <> 0 UNION ALL SELECT count(*) || ' units, fresh: true', 'total', false, 2 FROM c WHERE k % 13 <> 0""",
    "call_resolution": after("n", more=_RESOLVED) + "SELECT kind, subkind, from_id, to_id, resolution FROM drafts",
    "varied_calls": _varied(),
    "possible_targets": after("n", more=_RESOLVED | {"d": "SELECT 'lib/C' || up || '.sol:C' || up || '.tick()' AS to_id, count(*) AS targets FROM up GROUP BY up"})
    + "SELECT from_id, to_id, subkind, targets FROM drafts JOIN d USING (to_id) WHERE kind = 'calls' AND subkind = 'external' AND split_part(from_id, '.go', 1) <> split_part(to_id, '.tick', 1)",
    "build_graph": after("n", more=_RESOLVED)
    + """SELECT 'edge' AS what, kind, count(DISTINCT from_id || '|' || to_id || '|' || coalesce(subkind, '')) AS count FROM drafts GROUP BY kind
        UNION ALL SELECT 'node', unnest(['SourceUnit', 'Contract', 'Event', 'Error', 'StateVariable', 'Function']), unnest([n, n, n, n, 2 * n, 5 * n]) FROM n UNION ALL SELECT 'node', 'Unresolved', count(DISTINCT to_id) FROM drafts WHERE to_id LIKE '?%'""",
    "overlay_apply": after("functions", "contracts", "calls", more=_PLACED) + "SELECT from_id, coalesce(target, to_id) AS to_id, kind, CASE WHEN target IS NULL THEN resolution ELSE 'semantic' END AS resolution FROM placed WHERE target IS NULL OR i = 1",
    "overlay_selectors": after("functions", "contracts", more={"o": "SELECT file FROM files WHERE nation % 5 <> 0"})
    + "SELECT f.id, CASE WHEN f.k % 3 = 0 AND c.file IN (SELECT file FROM o) THEN '0x' || substr(md5(f.id), 1, 8) END AS selector FROM functions f JOIN contracts c ON c.id = f.scope",
    "overlay_coverage": "SELECT count(*) FILTER (n_nationkey % 5 <> 0) AS covered, count(*) FILTER (n_nationkey % 5 = 0) AS stale FROM nation",
    "build_info": after("n", more=_COMPILED) + """SELECT file, 'source' AS what, NULL::BIGINT AS "offset", NULL AS target_file, NULL::BIGINT AS target_offset, CASE WHEN k % 7 = 0 THEN 'older ' ELSE '' END || k AS value FROM c
        UNION ALL SELECT file, 'declaration', unnest([0, 10, 20, 30, 40]), NULL, NULL, NULL FROM c UNION ALL SELECT file, 'declaration', o, NULL, NULL, NULL FROM f
        UNION ALL SELECT file, 'selector', o, NULL, NULL, '0x' || substr(md5(p::VARCHAR), 1, 8) FROM f WHERE p % 3 = 0 UNION ALL SELECT file, 'slot', 10, NULL, k % 32, k::VARCHAR FROM c
        UNION ALL SELECT file, 'call', o + 10, file, CASE WHEN p + n IN (SELECT p FROM f) THEN o + n * 100 ELSE o END, NULL FROM f, n
        UNION ALL SELECT file, 'emit', o + 20, file, 20, NULL FROM f UNION ALL SELECT file, 'revert', o + 30, file, 30, NULL FROM f UNION ALL SELECT file, 'variable', o + 40, file, 10, NULL FROM f
        UNION ALL SELECT file, 'modifiedBy', o, file, 40, NULL FROM f WHERE p % 5 = 0
        UNION ALL SELECT x.file, 'inherits', 0, y.file, 0, NULL FROM c x JOIN c y ON y.k = x.k - 1 WHERE x.k % 25 <> 0 UNION ALL SELECT x.file, 'base', x.o, y.file, y.o, NULL FROM f x JOIN f y ON y.p = x.p - 1 WHERE x.k % 25 <> 0
        UNION ALL SELECT 'b' || lpad(g::VARCHAR, 6, '0'), 'unusable', NULL, NULL, NULL, ['not a JSON object', 'no output section', 'no syntax trees in its output'][1 + g % 3] FROM bad""",
    "overlay_relations": after("n", more=_COMPILED) + """SELECT 'inherits' AS kind, 'c:' || k AS from_id, 'c:' || (k - 1) AS to_id, CASE WHEN k % 25 <> 0 AND k % 7 <> 0 AND k - 1 IN (SELECT k FROM c) THEN 'semantic' ELSE 'heuristic' END AS resolution FROM c
        UNION ALL SELECT 'overrides', 'f:' || p, 'f:' || (p - 1), CASE WHEN k % 25 <> 0 AND k % 7 <> 0 AND p - 1 IN (SELECT p FROM f) THEN 'semantic' ELSE 'heuristic' END FROM f
        UNION ALL SELECT 'modifiedBy', 'f:' || p, 'm:' || k, CASE WHEN p % 5 = 0 AND k % 7 <> 0 THEN 'semantic' ELSE 'heuristic' END FROM f
        UNION ALL SELECT 'slot', 'v:' || k, CASE WHEN k // 25 NOT IN (SELECT g FROM stale) THEN k::VARCHAR END, CASE WHEN k // 25 NOT IN (SELECT g FROM stale) THEN (k % 32)::VARCHAR END FROM c""",
    "matched_tiers": after("functions", more=MATCHING) + "SELECT before, after, tier, confidence FROM matches",
    "body_match": after("functions", more=MATCHING) + "SELECT before, after, 'body' AS tier FROM body",
    "signature_match": after("functions", more=MATCHING) + f"SELECT before, after, 'signature' AS tier FROM ({_alone('b1', 'a1', 'scope, name')})",
    "signature_tier": after("functions", more={"s": "SELECT id, scope, name FROM functions WHERE subkind = 'function' AND k % 5 = 0"})
    + "SELECT min(id) AS before, min(id) || 's' AS after, 'signature' AS tier, 0.9::DOUBLE AS confidence FROM s GROUP BY scope, name HAVING count(*) = 1",
    "diff_nodes": after("functions", more=DIFFED) + "SELECT status, id, changes FROM d",
    "diff_summary": after("functions", more=DIFFED) + "SELECT status, count(*) AS count FROM d GROUP BY status",
    "review_migration": after("functions", more=MATCHING | {"r": _REVIEWS}) + "SELECT coalesce(after, node) AS node, status FROM r LEFT JOIN matches ON before = node",
    "diff_findings": after("functions", "guards", "cedges", "variables", "contracts", more=_SURFACE)
    + """SELECT 'new-external-entrypoint' AS kind, 'medium' AS severity, id || 'n' AS node, 'New ' || visibility || ' entrypoint ' || q || ' added' || CASE WHEN ac = 'none' THEN ', without recognised access control' ELSE '' END AS message, 'direct' AS evidence
        FROM (SELECT *, CASE WHEN k % 61 = 0 THEN 'none' ELSE access END AS ac FROM fn) WHERE k % 100 = 1
        UNION ALL SELECT 'new-dangerous-op', 'high', id || 'n', 'New function ' || q || ' added uses hasDelegatecall', 'direct' FROM fn WHERE k % 50 = 1 AND k % 150 = 1
        UNION ALL SELECT 'new-dangerous-op', 'high', id, q || ' now uses hasAssembly', evidence FROM ev WHERE k % 59 = 0
        UNION ALL SELECT 'became-payable', 'medium', id, q || ' became payable', evidence FROM ev WHERE m0 <> 'payable' AND m1 = 'payable'
        UNION ALL SELECT 'access-control-weakened', 'high', id, q || ' changes state and its access control went from ' || access || ' to none' || CASE WHEN guards = '' THEN '' ELSE ' (lost ' || replace(guards, ',', ', ') || ')' END, evidence
        FROM ev WHERE k % 61 = 0 AND access <> 'none' AND m1 IN ('nonpayable', 'payable')
        UNION ALL SELECT 'became-externally-reachable', 'medium', id, q || ' can now be reached from outside', evidence FROM ev WHERE k % 7 = 0
        UNION ALL SELECT 'new-external-call', 'info', id, q || ' now calls out of its contract', evidence FROM ev WHERE id IN (SELECT from_id FROM out_after) AND id NOT IN (SELECT from_id FROM out_before)
        UNION ALL SELECT 'storage-layout-changed', 'high', c.id, 'Storage layout of ' || c.name || ' changed from [' || l0 || '] to [' || l1 || ']', 'direct' FROM contracts c JOIN lay ON lay.scope = c.id WHERE l0 <> l1""",
    "graph_stats_full": after("files", "contracts", "functions", "variables", "calls", "accesses", "emits", "inherits", "guards", "entries", "modifiers", more={
        "every_draft": "SELECT kind, subkind, from_id, to_id, resolution, rank FROM calls UNION ALL SELECT kind, subkind, from_id, to_id, resolution, rank FROM accesses UNION ALL SELECT kind, subkind, from_id, to_id, resolution, rank FROM emits UNION ALL SELECT 'inherits', NULL, from_id, to_id, 'heuristic', 1 FROM inherits",
        "known": "SELECT id FROM functions UNION SELECT id FROM contracts UNION SELECT id FROM variables UNION SELECT 'e:' || event_type FROM events UNION SELECT to_id FROM calls WHERE to_id LIKE '?%'",
        "e": "SELECT from_id, to_id, kind, subkind, ['semantic', 'heuristic', 'ambiguous', 'unresolved'][1 + max(rank)] AS resolution FROM every_draft WHERE from_id IN (SELECT id FROM known) AND to_id IN (SELECT id FROM known) GROUP BY from_id, to_id, kind, subkind",
        "arcs": "SELECT from_id AS src, to_id AS dst FROM calls WHERE kind = 'calls' AND to_id LIKE 'f:%' UNION SELECT from_id, replace(to_id, 'c:', 'f:') FROM calls WHERE kind = 'creates'",
        "r": "SELECT id FROM entries UNION SELECT dst FROM r JOIN arcs ON src = r.id",
        "re": "SELECT DISTINCT from_id AS id FROM calls WHERE kind = 'calls' AND subkind IN ('external', 'delegatecall', 'lowlevel') UNION SELECT c.from_id FROM re JOIN calls c ON c.to_id = re.id AND c.kind = 'calls'",
        "x": "SELECT from_id, min(off) AS o FROM calls WHERE kind = 'calls' AND (subkind IN ('external', 'delegatecall', 'lowlevel') OR to_id IN (SELECT id FROM re)) GROUP BY 1",
        "w": "SELECT from_id, max(off) AS o FROM accesses WHERE kind = 'writes' GROUP BY 1",
        "ctw": "SELECT x.from_id FROM x JOIN w USING (from_id) WHERE w.o > x.o",
    }) + """SELECT 'nodes' AS measure, 'SourceUnit' AS key, count(*) AS count FROM files UNION ALL SELECT 'nodes', 'Contract', count(*) FROM contracts UNION ALL SELECT 'nodes', 'Function', count(*) FROM functions
        UNION ALL SELECT 'nodes', 'StateVariable', count(*) FROM variables UNION ALL SELECT 'nodes', 'Event', count(DISTINCT event_type) FROM events UNION ALL SELECT 'nodes', 'Unresolved', count(DISTINCT to_id) FROM calls WHERE to_id LIKE '?%'
        UNION ALL SELECT 'edges', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'resolution', resolution, count(*) FROM e GROUP BY resolution UNION ALL SELECT 'contract_kind', contract_kind, count(*) FROM contracts GROUP BY contract_kind
        UNION ALL SELECT 'unresolved', regexp_extract(to_id, '^\\?([^:]*):', 1), count(DISTINCT to_id) FROM calls WHERE to_id LIKE '?%' GROUP BY 2
        UNION ALL SELECT 'contracts', unnest(['total', 'test', 'mock', 'real']), unnest([count(*), count(*) FILTER (is_test), count(*) FILTER (is_mock), count(*) FILTER (NOT is_test AND NOT is_mock)]) FROM contracts
        UNION ALL SELECT 'functions', unnest(['total', 'callable', 'reachable', 'unprotected', 'payable', 'assembly', 'delegatecall', 'lowlevel', 'call_then_write']), unnest([count(*),
          count(*) FILTER (subkind NOT IN ('modifier', 'constructor') AND visibility IN ('public', 'external')), count(*) FILTER (id IN (SELECT id FROM r)),
          count(*) FILTER (subkind NOT IN ('modifier', 'constructor') AND visibility IN ('public', 'external') AND state_mutability NOT IN ('view', 'pure') AND NOT checks_sender),
          count(*) FILTER (state_mutability = 'payable'), 0, 0, 0, count(*) FILTER (id IN (SELECT from_id FROM ctw))]) FROM functions""",
}
