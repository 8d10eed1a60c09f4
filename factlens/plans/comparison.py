"""DuckDB SQL for each query, written apart from the operators, over the same test projection."""

from __future__ import annotations

from factlens.plans import samples, testbed

#: Derived relations that several texts share.
DERIVED: dict[str, str] = {
    "em": "SELECT entityId, regexp_replace(arg_max(containerId, ord), '^module:', '') AS module FROM (SELECT entityId, containerId, ord FROM {contains} UNION ALL SELECT entityId, entityId, ord - 1000000000000 FROM {declaration} WHERE entityType = 'module') GROUP BY entityId",
    "fm": "SELECT file, arg_max(module, ord) AS module FROM {declaration} JOIN {em} USING (entityId) GROUP BY file",
    "lastd": "SELECT entityId, arg_max(entityType, ord) AS entityType, arg_max(name, ord) AS name, arg_max(file, ord) AS file FROM {declaration} GROUP BY entityId",
    "uses": "SELECT callerId AS caller, calleeId AS target, file, 'calls' AS ctx, line, ord FROM {calls} UNION ALL SELECT callerId, classId, file, 'instantiates', line, ord FROM {instantiates} UNION ALL SELECT callerId, targetId, file, ctx, line, ord FROM {refs}",
    "mod_edges": "SELECT DISTINCT a.module AS src, b.module AS dst, u.ctx FROM {uses} u JOIN {em} a ON a.entityId = u.caller JOIN {em} b ON b.entityId = u.target WHERE a.module <> b.module",
    "mi": "SELECT DISTINCT importerFile AS src, exportedBy AS dst FROM {imports} WHERE NOT starts_with(exportedBy, 'external:') AND importerFile <> exportedBy",
    "hop1": "SELECT DISTINCT a.module AS src, b.module AS dst FROM (SELECT i.importerFile, coalesce((SELECT r.source FROM {reexport} r WHERE r.barrel = i.exportedBy AND (r.reexportedName IS NULL OR r.reexportedName = i.importedName) ORDER BY r.ord LIMIT 1), i.exportedBy) AS target FROM {imports} i WHERE NOT starts_with(i.exportedBy, 'external:')) x JOIN {fm} a ON a.file = x.importerFile JOIN {fm} b ON b.file = x.target WHERE a.module <> b.module",
    "edges": "SELECT 'calls' AS kind, callerId AS src, calleeId AS dst FROM {calls} UNION ALL SELECT 'instantiates', callerId, classId FROM {instantiates} UNION ALL SELECT 'references', callerId, targetId FROM {refs} UNION ALL SELECT kind, childId, parentId FROM {heritage}",
    "known": "SELECT DISTINCT entityId AS id FROM {declaration}",
    "considered": "SELECT * FROM {imports} i WHERE NOT starts_with(exportedBy, 'external:') AND NOT starts_with(importType, 'type-') AND NOT EXISTS (SELECT 1 FROM {reexport} r WHERE r.barrel = i.importerFile AND r.source = i.exportedBy)",
    "dead": "SELECT importerFile, exportedBy, importedName, importType FROM {considered} i WHERE NOT EXISTS (SELECT 1 FROM {uses} u JOIN {em} m ON m.entityId = u.target WHERE u.file = i.importerFile AND m.module = i.exportedBy)",
    "rc": "SELECT barrel AS src, barrel AS dst FROM {reexport} UNION SELECT r.src, x.source FROM rc r JOIN {reexport} x ON x.barrel = r.dst",
    "tiers": "SELECT p.src, p.dst, min(CASE WHEN e.ctx IN ('calls', 'instantiates') THEN 0 WHEN e.ctx IN ('value', 'shorthand', 'export', 'jsx') THEN 1 WHEN e.ctx = 'typeof' THEN 2 WHEN e.ctx = 'type' THEN 3 END) AS tier FROM (SELECT DISTINCT importerFile AS src, exportedBy AS dst FROM {considered} WHERE importerFile <> exportedBy) p LEFT JOIN (SELECT src, dst AS target FROM {rc}) q ON q.src = p.dst LEFT JOIN {mod_edges} e ON e.src = p.src AND (e.dst = p.dst OR e.dst = q.target) GROUP BY ALL",
    "udep": "SELECT DISTINCT callerId AS src, calleeId AS dst FROM {calls} WHERE calleeId <> callerId UNION SELECT callerId, classId FROM {instantiates} WHERE classId <> callerId",
    "cdep": "SELECT DISTINCT callerId AS src, calleeId AS dst FROM {calls} WHERE calleeId <> callerId",
    "inbound": "SELECT calleeId AS entityId, count(*) AS n FROM {calls} WHERE calleeId IS NOT NULL GROUP BY calleeId",
    "seeds": "SELECT d.entityId AS seed FROM {lastd} d JOIN {inbound} i USING (entityId) ORDER BY i.n DESC, d.entityId LIMIT 5",
    "rpairs": "SELECT callerId, calleeId, sum(samples)::BIGINT AS samples, bool_or(callerTier = 'exact' AND calleeTier = 'exact') AS exact, bool_or(viaNative) AS viaNative FROM {runtime} WHERE callerTier <> 'external' AND callerResolved AND calleeResolved GROUP BY callerId, calleeId",
    "shortcut": "SELECT callerId, calleeId FROM {rpairs} p WHERE EXISTS (SELECT 1 FROM {rpairs} a JOIN {rpairs} b ON a.calleeId = b.callerId WHERE a.callerId = p.callerId AND b.calleeId = p.calleeId AND a.calleeId NOT IN (p.callerId, p.calleeId))",
    "spairs": "SELECT DISTINCT callerId, calleeId FROM {calls} WHERE calleeId IS NOT NULL",
    "ra": "SELECT file, name, type, arg_min(fp, ord) AS fp, arg_min(n, ord) AS n, min(ord) AS ord, arg_min(entityId, ord) AS entityId, arg_min(structureId, ord) AS structureId, arg_min(contentId, ord) AS contentId, count(*) > 1 AS dup, split_part(name, '.', -1) AS seg FROM {snap_a} GROUP BY file, name, type",
    "rb": "SELECT file, name, type, arg_min(fp, ord) AS fp, arg_min(n, ord) AS n, min(ord) AS ord, arg_min(entityId, ord) AS entityId, arg_min(structureId, ord) AS structureId, arg_min(CASE WHEN contentId IS NULL THEN '' ELSE contentId END, ord) AS contentId0, count(*) > 1 AS dup, split_part(name, '.', -1) AS seg FROM {snap_b} GROUP BY file, name, type",
    "ea": "SELECT a.* FROM {ra} a LEFT JOIN {rb} b USING (file, name, type) WHERE NOT a.dup AND NOT coalesce(b.dup, false)",
    "eb": "SELECT b.* FROM {rb} b LEFT JOIN {ra} a USING (file, name, type) WHERE NOT b.dup AND NOT coalesce(a.dup, false)",
    "m1": "SELECT CASE WHEN a.fp = b.fp THEN 'unchanged' ELSE 'body_edit' END AS cat, type, a.ord AS a, b.ord AS b FROM {ea} a JOIN {eb} b USING (file, name, type)",
    "a1": "SELECT * FROM {ea} WHERE ord NOT IN (SELECT a FROM {m1})",
    "b1": "SELECT * FROM {eb} WHERE ord NOT IN (SELECT b FROM {m1})",
    "g2": "SELECT x.file, x.type, x.fp, na, nb, a, b, sa, sb FROM (SELECT file, type, fp, count(*) AS na, min(ord) AS a, arg_min(seg, ord) AS sa FROM {a1} WHERE n >= 12 GROUP BY ALL) x JOIN (SELECT file, type, fp, count(*) AS nb, min(ord) AS b, arg_min(seg, ord) AS sb FROM {b1} WHERE n >= 12 GROUP BY ALL) y USING (file, type, fp)",
    "m2": "SELECT CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous' WHEN sa = sb THEN 'rename_owner' ELSE 'rename' END AS cat, type, a, CASE WHEN na = 1 AND nb = 1 THEN b END AS b FROM {g2}",
    "a2": "SELECT * FROM {a1} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g2} g WHERE g.file = x.file AND g.type = x.type AND g.fp = x.fp))",
    "b2": "SELECT * FROM {b1} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g2} g WHERE g.file = x.file AND g.type = x.type AND g.fp = x.fp))",
    "g3": "SELECT * FROM (SELECT x.seg, x.type, x.fp, na, nb, a, b, fa, fb FROM (SELECT seg, type, fp, count(*) AS na, min(ord) AS a, arg_min(file, ord) AS fa FROM {a2} WHERE n >= 12 GROUP BY ALL) x JOIN (SELECT seg, type, fp, count(*) AS nb, min(ord) AS b, arg_min(file, ord) AS fb FROM {b2} WHERE n >= 12 GROUP BY ALL) y USING (seg, type, fp)) WHERE na > 1 OR nb > 1 OR fa <> fb",
    "m3": "SELECT CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous' ELSE 'move' END AS cat, type, a, CASE WHEN na = 1 AND nb = 1 THEN b END AS b FROM {g3}",
    "a3": "SELECT * FROM {a2} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g3} g WHERE g.seg = x.seg AND g.type = x.type AND g.fp = x.fp))",
    "b3": "SELECT * FROM {b2} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g3} g WHERE g.seg = x.seg AND g.type = x.type AND g.fp = x.fp))",
    "g4": "SELECT x.type, x.fp, na, nb, a, b FROM (SELECT type, fp, count(*) AS na, min(ord) AS a FROM {a3} WHERE n >= 12 GROUP BY ALL) x JOIN (SELECT type, fp, count(*) AS nb, min(ord) AS b FROM {b3} WHERE n >= 12 GROUP BY ALL) y USING (type, fp)",
    "m4": "SELECT CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous' ELSE 'rename_move' END AS cat, type, a, CASE WHEN na = 1 AND nb = 1 THEN b END AS b FROM {g4}",
    "a4": "SELECT * FROM {a3} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g4} g WHERE g.type = x.type AND g.fp = x.fp))",
    "b4": "SELECT * FROM {b3} x WHERE NOT (n >= 12 AND EXISTS (SELECT 1 FROM {g4} g WHERE g.type = x.type AND g.fp = x.fp))",
    "sdiff": "SELECT * FROM {m1} UNION ALL SELECT * FROM {m2} UNION ALL SELECT * FROM {m3} UNION ALL SELECT * FROM {m4} UNION ALL SELECT 'removed', type, ord, NULL FROM {a4} UNION ALL SELECT 'added', type, NULL, ord FROM {b4}",
    "la": "SELECT ord, unnest(['entityId', 'structureId', 'contentId']) AS scheme, unnest([entityId, structureId, contentId]) AS id FROM {ra}",
    "lb": "SELECT ord, unnest(['entityId', 'structureId', 'contentId']) AS scheme, unnest([entityId, structureId, nullif(contentId0, '')]) AS id FROM {rb}",
    "evs": "SELECT s.cat, s.scheme, s.outcome, coalesce(s.ida, s.idb) AS id, count(*) AS size, min(CASE WHEN s.a IS NOT NULL THEN s.a_in_a ELSE s.b_in_b END) AS alone, s.cat = 'removed' AND s.outcome = 'reappear' AS gone, bool_or(EXISTS (SELECT 1 FROM {scored} h WHERE h.scheme = s.scheme AND h.idb = s.ida AND h.b IS NOT NULL AND h.cat <> 'added')) AS other, min(x.n) AS nodes FROM {scored} s LEFT JOIN {ra} x ON x.ord = s.a WHERE s.outcome IN ('alias', 'reappear') GROUP BY ALL",
    "scored": """SELECT *, CASE WHEN (a IS NOT NULL AND ida IS NULL) OR (b IS NOT NULL AND idb IS NULL) THEN 'missing' WHEN a IS NOT NULL AND b IS NOT NULL AND ida = idb THEN 'survive'
 WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a_in_b > 0 THEN 'alias' ELSE 'vanish' END WHEN a IS NOT NULL THEN CASE WHEN a_in_b > 0 THEN 'reappear' ELSE 'none' END ELSE CASE WHEN b_in_a > 0 THEN 'reappear' ELSE 'none' END END AS outcome
 FROM (SELECT d.cat, s.scheme, d.a, d.b, x.id AS ida, y.id AS idb, coalesce(c1.n, 0) AS a_in_b, coalesce(c2.n, 0) AS b_in_a, coalesce(c3.n, 0) AS b_in_b, coalesce(c4.n, 0) AS a_in_a FROM {sdiff} d CROSS JOIN (SELECT unnest(['entityId', 'structureId', 'contentId']) AS scheme) s
 LEFT JOIN {la} x ON x.ord = d.a AND x.scheme = s.scheme LEFT JOIN {lb} y ON y.ord = d.b AND y.scheme = s.scheme
 LEFT JOIN (SELECT scheme, id, count(*) AS n FROM {lb} GROUP BY ALL) c1 ON c1.scheme = s.scheme AND c1.id = x.id LEFT JOIN (SELECT scheme, id, count(*) AS n FROM {la} GROUP BY ALL) c2 ON c2.scheme = s.scheme AND c2.id = y.id
 LEFT JOIN (SELECT scheme, id, count(*) AS n FROM {lb} GROUP BY ALL) c3 ON c3.scheme = s.scheme AND c3.id = y.id LEFT JOIN (SELECT scheme, id, count(*) AS n FROM {la} GROUP BY ALL) c4 ON c4.scheme = s.scheme AND c4.id = x.id
 WHERE d.cat <> 'ambiguous') t""",
}


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(100.0::DOUBLE * {part} / {whole}, 1) END"


def _reach(edges: str, back: bool = True) -> str:
    """Recursive closure from {seeds}: (seed, id) with the seed itself."""
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"SELECT seed, seed AS id FROM {{seeds}} UNION SELECT r.seed, e.{b} FROM reach r JOIN {{{edges}}} e ON e.{a} = r.id"


def _radius(edges: str) -> str:
    return f"WITH RECURSIVE reach AS ({_reach(edges)}) SELECT s.seed, count(r.id) AS callers, count(DISTINCT m.module) AS modules FROM {{seeds}} s LEFT JOIN reach r ON r.seed = s.seed AND r.id <> s.seed LEFT JOIN {{em}} m ON m.entityId = r.id GROUP BY s.seed"


SQL: dict[str, str] = {
    # Census
    "facts_by_kind": "SELECT * FROM (SELECT 'declaration' AS kind, count(*) AS n FROM {declaration} UNION ALL SELECT 'contains', count(*) FROM {contains} UNION ALL SELECT 'import', count(*) FROM {imports} UNION ALL SELECT 'reexport', count(*) FROM {reexport} UNION ALL SELECT 'calls', count(*) FROM {calls} UNION ALL SELECT 'instantiates', count(*) FROM {instantiates} UNION ALL SELECT 'references', count(*) FROM {refs} UNION ALL SELECT kind, count(*) FROM {heritage} GROUP BY kind) WHERE n > 0",
    "decls_by_type": "SELECT entityType, count(*) AS n FROM {declaration} GROUP BY entityType",
    "confidence_hist": "SELECT kind, round(confidence, 1) AS confidence, count(*) AS n FROM (SELECT 'calls' AS kind, confidence FROM {calls} UNION ALL SELECT 'instantiates', confidence FROM {instantiates} UNION ALL SELECT 'references', confidence FROM {refs}) GROUP BY ALL",
    "resolution_rates": f"SELECT kind, total, resolved, closed, {_pct('resolved', 'total')} AS resolved_pct, {_pct('closed', 'total')} AS closed_pct FROM (SELECT kind, count(*) AS total, count(dst) AS resolved, count(*) FILTER (src IN (SELECT id FROM {{known}}) AND dst IN (SELECT id FROM {{known}})) AS closed FROM {{edges}} GROUP BY kind)",
    "refs_by_ctx": "SELECT ctx, count(*) AS n, count(targetId) AS resolved FROM {refs} GROUP BY ctx",
    "call_reasons": "SELECT reason, count(*) AS n, count(*) FILTER (calleeId IS NULL) AS unresolved FROM {calls} GROUP BY reason",
    "method_calls": "SELECT count(*) AS calls, count(*) FILTER (contains(calleeName, '.')) AS method_calls, count(*) FILTER (contains(calleeName, '.') AND calleeId IS NULL) AS method_calls_unresolved FROM {calls}",
    "low_confidence_calls": "SELECT callerId, calleeName, calleeId, confidence, reason, callerKind, file, line FROM {calls} WHERE confidence < 0.7",
    "external_imports": "SELECT substr(exportedBy, 10) AS package, count(*) AS n, count(DISTINCT importerFile) AS files FROM {imports} WHERE starts_with(exportedBy, 'external:') GROUP BY 1",
    "resolved_calls": "SELECT callerId, calleeId, calleeName, confidence, line FROM {calls} WHERE calleeId IS NOT NULL",
    # Relations
    "entity_module": "SELECT * FROM {em}",
    "file_module": "SELECT * FROM {fm}",
    "module_entities": "SELECT DISTINCT substr(containerId, 8) AS module, entityId FROM {contains}",
    "entity_calls": "SELECT DISTINCT callerId AS src, calleeId AS dst FROM {calls} WHERE calleeId IS NOT NULL",
    "module_calls": "SELECT DISTINCT src, dst FROM {mod_edges} WHERE ctx IN ('calls', 'instantiates')",
    "module_imports": "SELECT * FROM {mi}",
    "module_imports_one_hop": "SELECT * FROM {hop1}",
    "module_refs_by_tier": "SELECT DISTINCT src, dst, CASE WHEN ctx IN ('type', 'typeof') THEN ctx ELSE 'value' END AS tier FROM {mod_edges} WHERE ctx NOT IN ('calls', 'instantiates')",
    "import_resolution": r"""
WITH RECURSIVE c AS (SELECT ord, unnest([1, 2, 3, 4, 5, 6]) AS rank, unnest([regexp_replace(specifier, '\.js$', '.ts'), specifier || '.ts', regexp_replace(specifier, '\.js$', '/index.ts'), specifier || '/index.ts', regexp_replace(specifier, '\.js$', '.d.ts'), regexp_replace(specifier, '\.js$', '') || '/index.ts']) AS c FROM {specifiers} WHERE starts_with(specifier, '.')),
p AS (SELECT ord, rank, CASE WHEN starts_with(c, './') THEN 'src/' || substr(c, 3) ELSE substr(c, 4) END AS path FROM c)
SELECT s.ord, s.importer, s.specifier, coalesce((SELECT arg_min(p.path, p.rank) FROM p WHERE p.ord = s.ord AND p.path IN (SELECT path FROM {source_files})), 'external:' || s.specifier) AS resolved FROM {specifiers} s""",
    # Structure
    "import_fan_in": "SELECT dst AS module, count(DISTINCT src) AS n FROM {mi} GROUP BY dst",
    "import_fan_out": "SELECT src AS module, count(DISTINCT dst) AS n FROM {mi} GROUP BY src",
    "import_fan_in_top": "SELECT dst AS module, count(DISTINCT src) AS n FROM {mi} GROUP BY dst ORDER BY n DESC, module LIMIT 5",
    "call_fan_in": "SELECT dst AS module, count(DISTINCT src) AS n FROM {mod_edges} WHERE ctx IN ('calls', 'instantiates') GROUP BY dst",
    "call_fan_out": "SELECT src AS module, count(DISTINCT dst) AS n FROM {mod_edges} WHERE ctx IN ('calls', 'instantiates') GROUP BY src",
    "inbound_calls": "SELECT * FROM {inbound}",
    "top_seeds": "SELECT d.entityId, d.name, i.n FROM {lastd} d JOIN {inbound} i USING (entityId) ORDER BY i.n DESC, d.entityId LIMIT 5",
    "coupling": "SELECT importerFile AS src, exportedBy AS dst, count(*) AS n FROM {imports} WHERE NOT starts_with(exportedBy, 'external:') AND importerFile <> exportedBy GROUP BY ALL HAVING count(*) >= 3",
    "importers_of_index": "SELECT DISTINCT src FROM {mi} WHERE contains(dst, 'index')",
    "mutual_imports": "SELECT a.src, a.dst, 2::BIGINT AS ordered FROM {mi} a JOIN {mi} b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
    "pure_barrels": "SELECT DISTINCT barrel AS file FROM {reexport} WHERE barrel NOT IN (SELECT file FROM {declaration} WHERE entityType <> 'module')",
    "isolated_modules": "SELECT DISTINCT substr(entityId, 8) AS module FROM {declaration} WHERE entityType = 'module' AND substr(entityId, 8) NOT IN (SELECT src FROM {mi} UNION SELECT dst FROM {mi})",
    "barrel_counts": r"SELECT (SELECT count(DISTINCT barrel) FROM {reexport}) AS barrels, (SELECT count(DISTINCT barrel) FROM {reexport} WHERE barrel NOT IN (SELECT file FROM {declaration} WHERE entityType <> 'module')) AS pure, (SELECT count(DISTINCT file) FROM {declaration} WHERE entityType = 'module') AS files, (SELECT count(DISTINCT file) FROM {declaration} WHERE entityType = 'module' AND regexp_matches(file, 'm[0-9]\.ts$')) AS locale_files",
    "first_seeds": "SELECT entityId, arg_min(name, ord) AS name FROM {declaration} GROUP BY entityId HAVING contains(split_part(arg_min(name, ord), '.', -1), '1') ORDER BY min(ord), entityId LIMIT 3",
    "static_edges": "SELECT * FROM (SELECT 'calls' AS kind, callerId AS caller, calleeId AS target, calleeName AS name, file, line FROM {calls} UNION ALL SELECT 'references', callerId, targetId, name, file, line FROM {refs}) WHERE starts_with(caller, 'user:1') AND ends_with(coalesce(target, name), '7')",
    "layer_edges": r"SELECT from_layer, to_layer, count(*) AS n FROM (SELECT regexp_extract(src, '([0-9])\.ts$', 1) AS from_layer, regexp_extract(dst, '([0-9])\.ts$', 1) AS to_layer FROM {mi}) x WHERE from_layer <> to_layer GROUP BY from_layer, to_layer",
    "dependency_density": "SELECT modules, import_edges, call_edges, round(import_edges / modules, 2) AS imports_per_module, round(call_edges / modules, 2) AS calls_per_module FROM (SELECT (SELECT count(DISTINCT entityId) FROM {declaration} WHERE entityType = 'module') AS modules, (SELECT count(*) FROM {mi}) AS import_edges, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {mod_edges} WHERE ctx IN ('calls', 'instantiates'))) AS call_edges)",
    # Recursion
    "blast_radius": _radius("udep"),
    "blast_radius_calls": _radius("cdep"),
    "blast_radius_by_file": f"WITH RECURSIVE reach AS ({_reach('cdep')}) SELECT r.seed, d.file, count(*) AS n, string_agg(d.name, ',' ORDER BY d.name) AS names FROM reach r JOIN {{lastd}} d ON d.entityId = r.id WHERE r.id <> r.seed GROUP BY ALL",
    "transitive_subtypes": "WITH RECURSIVE reach AS (SELECT 'region:' || r_regionkey AS seed, 'region:' || r_regionkey AS id FROM region UNION SELECT r.seed, h.childId FROM reach r JOIN {heritage} h ON h.parentId = r.id) SELECT seed, count(*) AS subtypes FROM reach WHERE id <> seed GROUP BY seed",
    "reexport_closure": "SELECT src, dst FROM {rc}",
    "shortest_path": """
WITH RECURSIVE bfs AS (SELECT seed AS src, seed AS id, 0 AS hops FROM {seeds} UNION SELECT b.src, e.dst, b.hops + 1 FROM bfs b JOIN {udep} e ON e.src = b.id WHERE b.hops < 40),
first AS (SELECT src, id, min(hops) AS hops FROM bfs GROUP BY ALL)
SELECT s.seed AS src, t.seed AS dst, f.hops::BIGINT AS hops FROM {seeds} s CROSS JOIN {seeds} t LEFT JOIN first f ON f.src = s.seed AND f.id = t.seed""",
    "forward_reach": f"WITH RECURSIVE reach AS ({_reach('udep', back=False)}) SELECT s.seed, count(r.id) AS reached, count(r.id) FILTER (contains(r.id, '1')) AS matching FROM {{seeds}} s LEFT JOIN reach r ON r.seed = s.seed AND r.id <> s.seed GROUP BY s.seed",
    "scoped_closure": """
WITH RECURSIVE real AS (SELECT * FROM {rpairs} p WHERE NOT EXISTS (SELECT 1 FROM {shortcut} s WHERE s.callerId = p.callerId AND s.calleeId = p.calleeId)),
reach AS (SELECT s.seed, p.callerId AS id FROM {seeds} s JOIN real p ON p.calleeId = s.seed AND p.callerId <> s.seed UNION SELECT r.seed, p.callerId FROM reach r JOIN real p ON p.calleeId = r.id WHERE p.exact AND p.callerId <> p.calleeId)
SELECT seed, count(*) AS n FROM reach GROUP BY seed""",
    "runtime_closure_gain": "WITH RECURSIVE "
    + ", ".join(
        f"{n} AS (SELECT seed, seed AS id FROM {{seeds}} UNION SELECT r.seed, e.src FROM {n} r JOIN (SELECT src, dst FROM {{cdep}}{more}) e ON e.dst = r.id AND e.src <> e.dst)"
        for n, more in (
            ("r0", ""),
            ("r1", " UNION SELECT callerId, calleeId FROM {runtime} WHERE callerTier = 'exact' AND calleeTier = 'exact'"),
            ("r2", " UNION SELECT callerId, calleeId FROM {runtime} WHERE callerTier <> 'external' AND callerResolved AND calleeResolved"),
        )
    )
    + " SELECT s.seed, (SELECT count(*) FROM r0 WHERE r0.seed = s.seed AND id <> s.seed) AS static_n, (SELECT count(*) FROM r1 WHERE r1.seed = s.seed AND id <> s.seed) AS exact_n, (SELECT count(*) FROM r2 WHERE r2.seed = s.seed AND id <> s.seed) AS joined_n, (SELECT count(*) FROM r1 WHERE r1.seed = s.seed AND id <> s.seed AND NOT EXISTS (SELECT 1 FROM r0 WHERE r0.seed = r1.seed AND r0.id = r1.id)) AS added FROM {seeds} s",
    "inclusive_samples": "SELECT conv_id, turn AS node, (sum(hits) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS inclusive FROM {profile} p WHERE NOT EXISTS (SELECT 1 FROM {profile} q WHERE q.conv_id = p.conv_id AND q.turn = p.turn - 1) = (p.turn = 0)",
    "collapsed_frames": "SELECT conv_id, turn AS node, last, coalesce(last < turn - 1, false) AS via FROM (SELECT conv_id, turn, corpus, max(CASE WHEN corpus THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {profile}) WHERE corpus",
    "frame_edges": """SELECT coalesce(q.frame, '<workload>') AS caller, p.frame AS callee, bool_or(coalesce(p.last < p.turn - 1, false)) AS via, sum(p.inclusive)::BIGINT AS samples FROM
 (SELECT *, sum(hits) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS inclusive, max(CASE WHEN corpus THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {profile}) p LEFT JOIN {profile} q ON q.conv_id = p.conv_id AND q.turn = p.last WHERE p.corpus GROUP BY ALL""",
    # Hygiene
    "dead_imports": "SELECT * FROM {dead}",
    "evidence_tiers": f"SELECT l.tier, count(*) AS considered, count(*) FILTER (t.tier IS NULL OR t.tier > l.tier) AS flagged, {_pct('count(*) FILTER (t.tier IS NULL OR t.tier > l.tier)', 'count(*)')} AS flagged_pct FROM {{tiers}} t CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS tier) l GROUP BY l.tier",
    "type_only_signatures": """
WITH RECURSIVE w AS (SELECT t.src, t.dst, q.dst AS target FROM {tiers} t JOIN {rc} q ON q.src = t.dst WHERE t.tier = 3 UNION SELECT src, dst, dst FROM {tiers} WHERE tier = 3),
k AS (SELECT DISTINCT w.src, w.dst, coalesce(d.entityType, '?') AS kind FROM w JOIN {em} a ON a.module = w.src JOIN {refs} r ON r.callerId = a.entityId AND r.ctx = 'type' JOIN {em} b ON b.entityId = r.targetId AND b.module = w.target LEFT JOIN {lastd} d ON d.entityId = r.targetId)
SELECT signature, count(*) AS n FROM (SELECT src, dst, string_agg(kind, '+' ORDER BY kind) AS signature FROM k GROUP BY ALL) GROUP BY signature""",
    "explain_evidence": """
WITH RECURSIVE w AS (SELECT t.src, t.dst, q.dst AS target FROM {tiers} t JOIN {rc} q ON q.src = t.dst WHERE t.tier IS NOT NULL UNION SELECT src, dst, dst FROM {tiers} WHERE tier IS NOT NULL)
SELECT w.src, w.dst, arg_min(r.line, r.ord) AS line, arg_min(r.name, r.ord) AS name FROM w JOIN {refs} r ON r.file = w.src JOIN {em} b ON b.entityId = r.targetId AND b.module = w.target GROUP BY w.src, w.dst""",
    "unused_imports": """
WITH RECURSIVE n AS (SELECT file, calleeName AS name FROM {calls} UNION SELECT file, className FROM {instantiates} UNION SELECT d.file, h.parentName FROM {heritage} h JOIN {lastd} d ON d.entityId = h.childId),
u AS (SELECT file, name FROM n UNION SELECT file, split_part(name, '.', 1) FROM n)
SELECT DISTINCT importerFile AS file, importedName AS name FROM {imports} i WHERE importType IN ('default', 'named') AND NOT EXISTS (SELECT 1 FROM u WHERE u.file = i.importerFile AND u.name = i.importedName)""",
    "accidental_deps_v1": """
SELECT src, dst FROM {hop1} h WHERE NOT EXISTS (SELECT 1 FROM {mod_edges} e WHERE e.ctx = 'calls' AND e.src = h.src AND e.dst = h.dst)
 AND NOT EXISTS (SELECT 1 FROM {contains} c JOIN {heritage} x ON x.childId = c.entityId JOIN {declaration} d ON d.name = x.parentName JOIN {em} m ON m.entityId = d.entityId WHERE substr(c.containerId, 8) = h.src AND m.module = h.dst)""",
    "dead_end_calls": "SELECT d.entityType, count(*) AS n, count(*) FILTER (c.confidence >= 0.8) AS confident FROM {calls} c JOIN {lastd} d ON d.entityId = c.calleeId WHERE d.entityType IN ('parameter', 'binding', 'type-method', 'type-property', 'type', 'interface', 'module') GROUP BY d.entityType",
    "link_exists": "SELECT s.seed AS src, t.seed AS dst, EXISTS (SELECT 1 FROM {uses} u WHERE u.ctx <> 'instantiates' AND u.caller = s.seed AND u.target = t.seed) AS linked FROM {seeds} s CROSS JOIN {seeds} t",
    # Integrity
    "closure_violations": "SELECT kind, endpoint, id, count(*) AS n FROM (SELECT kind, 'src' AS endpoint, src AS id FROM {edges} UNION ALL SELECT kind, 'dst', dst FROM {edges}) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM {known}) GROUP BY ALL",
    "closed_edges": "SELECT kind, count(*) AS n FROM {edges} WHERE src IN (SELECT id FROM {known}) AND dst IN (SELECT id FROM {known}) GROUP BY kind",
    "ambiguous_ids": "SELECT entityId, string_agg(DISTINCT entityType, '+' ORDER BY entityType) AS types, string_agg(DISTINCT space, '+' ORDER BY space) AS spaces, count(DISTINCT entityType) > count(DISTINCT space) AND NOT bool_or(space = 'both') AS violation FROM (SELECT DISTINCT entityId, entityType, CASE WHEN entityType IN ('interface', 'type', 'type-method', 'type-property') THEN 'type' WHEN entityType IN ('class', 'enum') THEN 'both' WHEN entityType IN ('module', 'sourcefile') THEN 'ns' ELSE 'value' END AS space FROM {declaration}) GROUP BY entityId HAVING count(DISTINCT entityType) > 1",
    "confidence_violations": "SELECT 'calls' AS kind, callerId, calleeName AS name, confidence, line FROM {calls} WHERE calleeId IS NULL AND confidence > 0.3 UNION ALL SELECT 'instantiates', callerId, className, confidence, line FROM {instantiates} WHERE classId IS NULL AND confidence > 0.3 UNION ALL SELECT 'references', callerId, name, confidence, line FROM {refs} WHERE targetId IS NULL AND confidence > 0.3",
    "id_collisions": """
WITH RECURSIVE p AS (SELECT scheme, id, count(DISTINCT (file, name)) AS n, count(DISTINCT entityType) AS types FROM (SELECT file, name, entityType, unnest(['entityId', 'structureId', 'contentId']) AS scheme, unnest([entityId, structureId, contentId]) AS id FROM {declaration}) WHERE id IS NOT NULL GROUP BY ALL)
SELECT scheme, count(*) AS ids, sum(n)::BIGINT AS entities, count(*) FILTER (n > 1) AS colliding_ids, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS colliding_entities, count(*) FILTER (types > 1) AS multi_type_ids, max(n) AS worst_n, first(id ORDER BY n DESC, id) AS worst_id FROM p GROUP BY scheme""",
    "question_verdicts": "SELECT 'what implements this interface' AS question, (SELECT count(*) FROM {heritage} WHERE parentId IS NULL) = 0 AS answered UNION ALL SELECT 'which imports are dead weight', (SELECT count(*) FROM {dead}) < (SELECT count(*) FROM {considered}) UNION ALL SELECT 'what breaks if this signature changes', true UNION ALL SELECT 'which modules carry the load', true UNION ALL SELECT 'what does a runtime-installed method dispatch to', false UNION ALL SELECT 'which call edges lead nowhere', true",
    # Temporal
    "snapshot_records": "SELECT file, name, type, fp, n, ord, dup, entityId, structureId, nullif(contentId0, '') AS contentId FROM {rb}",
    "snapshot_diff": "SELECT * FROM {sdiff}",
    "diff_categories": r"SELECT d.cat, count(*) AS n, count(*) FILTER (d.cat = 'rename_owner' AND regexp_matches(a.name || b.name, '@\w+?\d+')) AS positional FROM {sdiff} d LEFT JOIN {ra} a ON a.ord = d.a LEFT JOIN {rb} b ON b.ord = d.b GROUP BY d.cat",
    "scheme_scores": "SELECT cat, scheme, outcome, count(*) AS n, count(*) FILTER (outcome = 'survive' AND b_in_b > 1) AS shared FROM {scored} GROUP BY ALL",
    "distinct_events": "SELECT cat, scheme, outcome, sum(size)::BIGINT AS raw, count(*) AS events, max(size) AS largest, count(*) FILTER (size > 1) AS several, count(*) FILTER (alone = 1) AS from_unique, count(*) FILTER (alone = 1 AND gone AND NOT other) AS held_by_added, count(*) FILTER (alone = 1 AND gone AND other) AS held_by_other, count(*) FILTER (alone = 1 AND gone AND nodes < 12) AS small FROM {evs} GROUP BY ALL",
    "event_clusters": """
WITH RECURSIVE e AS (SELECT *, 'c' || (length(regexp_replace(id, '[^0-4]', '', 'g')) % 5) AS child FROM {evs}),
p AS (SELECT cat, scheme, outcome, child, sum(size) AS raw, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY cat, scheme, outcome ORDER BY raw DESC, child) AS r FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY cat, scheme, outcome ORDER BY size DESC, id) AS r FROM e)
SELECT e.cat, e.scheme, e.outcome, sum(e.size)::BIGINT AS raw, count(*) AS events, count(DISTINCT e.id) AS distinct_ids, count(DISTINCT e.child) AS commits, count(*) - (SELECT t.n FROM t WHERE t.r = 1 AND t.cat = e.cat AND t.scheme = e.scheme AND t.outcome = e.outcome) AS without_top,
 (SELECT string_agg(z.size, ',' ORDER BY z.r) FROM z WHERE z.r <= 8 AND z.cat = e.cat AND z.scheme = e.scheme AND z.outcome = e.outcome) AS top_sizes, (SELECT string_agg(t.child || ':' || t.raw, ' ' ORDER BY t.r) FROM t WHERE t.r <= 3 AND t.cat = e.cat AND t.scheme = e.scheme AND t.outcome = e.outcome) AS top_commits FROM e GROUP BY e.cat, e.scheme, e.outcome""",
    "reappearing_types": "SELECT cat, type, other_type, count(*) AS n FROM (SELECT d.cat, d.type, (SELECT arg_max(b.type, b.ord) FROM {rb} b WHERE b.structureId = a.structureId) AS other_type FROM {sdiff} d JOIN {ra} a ON a.ord = d.a WHERE d.cat = 'removed' UNION ALL SELECT d.cat, d.type, (SELECT arg_max(a.type, a.ord) FROM {ra} a WHERE a.structureId = b.structureId) FROM {sdiff} d JOIN {rb} b ON b.ord = d.b WHERE d.cat = 'added') WHERE other_type IS NOT NULL GROUP BY ALL",
    "scheme_scores_classes": "SELECT cat, scheme, outcome, count(*) AS n, count(*) FILTER (outcome = 'survive' AND b_in_b > 1) AS shared FROM {scored} s WHERE (SELECT type FROM {sdiff} d WHERE d.cat = s.cat AND d.a IS NOT DISTINCT FROM s.a AND d.b IS NOT DISTINCT FROM s.b) = 'class' GROUP BY ALL",
    "blind_spots": """
WITH RECURSIVE r AS (SELECT a.* FROM {sdiff} d JOIN {ra} a ON a.ord = d.a WHERE d.cat = 'removed'), n AS (SELECT b.* FROM {sdiff} d JOIN {rb} b ON b.ord = d.b WHERE d.cat = 'added')
SELECT count(*) AS removed, count(*) FILTER (EXISTS (SELECT 1 FROM n WHERE n.file = r.file AND n.type = r.type)) AS same_file_sibling, count(*) FILTER (EXISTS (SELECT 1 FROM n WHERE n.file <> r.file AND n.type = r.type AND n.name = r.name)) AS same_name_elsewhere, count(*) FILTER (r.file NOT IN (SELECT file FROM {rb})) AS file_gone FROM r""",
    "snapshot_join_rate": f"SELECT count(*) AS records, count(h.name) AS joined, {_pct('count(h.name)', 'count(*)')} AS pct FROM {{ra}} a LEFT JOIN (SELECT DISTINCT file, name, type FROM {{snap_b}}) h USING (file, name, type)",
    # Lenses
    "symbol_usages": "SELECT target, ctx, file, count(*) AS n FROM {uses} WHERE target IN (SELECT entityId FROM {declaration} WHERE split_part(name, '.', -1) = 'f7') GROUP BY ALL",
    "confident_calls": "SELECT DISTINCT callerId AS src, calleeId AS dst FROM {calls} WHERE calleeId IS NOT NULL AND confidence >= 0.85 UNION SELECT callerId, classId FROM {instantiates} WHERE confidence >= 0.85",
    "contradictions": "SELECT s.callerId, s.n AS static_to, o.n AS runtime_to FROM (SELECT callerId, count(*) AS n FROM {spairs} GROUP BY callerId) s JOIN (SELECT callerId, count(*) AS n FROM {rpairs} GROUP BY callerId) o USING (callerId) WHERE NOT EXISTS (SELECT 1 FROM {spairs} a JOIN {rpairs} b ON a.callerId = b.callerId AND a.calleeId = b.calleeId WHERE a.callerId = s.callerId)",
    "preferred_edges": "SELECT callerId, calleeId, CASE WHEN r.callerId IS NOT NULL THEN 'runtime' ELSE 'static' END AS source, CASE WHEN r.callerId IS NOT NULL THEN 0.95::DOUBLE ELSE s.confidence END AS confidence FROM (SELECT callerId, calleeId, max(confidence) AS confidence FROM {calls} WHERE calleeId IS NOT NULL GROUP BY ALL) s FULL JOIN (SELECT callerId, calleeId FROM {rpairs}) r USING (callerId, calleeId)",
    "dead_code": "SELECT d.entityId, d.entityType, d.file FROM (SELECT entityId, arg_max(entityType, ord) AS entityType, arg_max(file, ord) AS file, arg_max(exported, ord) AS exported FROM {declaration} GROUP BY entityId) d WHERE d.entityType IN ('function', 'method') AND NOT d.exported AND NOT EXISTS (SELECT 1 FROM {uses} u WHERE u.target = d.entityId AND u.caller <> u.target)",
    "impact_endpoints": f"WITH RECURSIVE reach AS ({_reach('udep')}) SELECT seed, id AS endpoint FROM reach WHERE id <> seed AND id IN (SELECT entityId FROM (SELECT entityId, arg_max(exported, ord) AS exported FROM {{declaration}} GROUP BY entityId) WHERE exported) AND id NOT IN (SELECT dst FROM {{udep}} WHERE dst IS NOT NULL)",
    "contract_violations": r"SELECT src, dst, from_layer, to_layer FROM (SELECT src, dst, regexp_extract(src, '([0-9])\.ts$', 1) AS from_layer, regexp_extract(dst, '([0-9])\.ts$', 1) AS to_layer FROM {mi}) x WHERE from_layer <> to_layer AND (from_layer::INT + to_layer::INT) % 3 = 0",
    "override_edges": "WITH RECURSIVE p AS (SELECT h.childId || '.run' AS a, h.parentId || '.run' AS b FROM {heritage} h WHERE h.childId IN (SELECT entityId FROM {declaration} WHERE entityType IN ('function', 'method')) AND h.parentId IN (SELECT entityId FROM {declaration} WHERE entityType IN ('function', 'method'))) SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p",
    "recovered_architecture": """
WITH RECURSIVE m AS (SELECT a.src, a.dst FROM {mi} a JOIN {mi} b ON a.src = b.dst AND a.dst = b.src), r AS (SELECT src AS id, src AS low FROM m UNION SELECT m.dst, r.low FROM r JOIN m ON m.src = r.id)
SELECT cluster, count(*) AS modules, 1::BIGINT AS directories FROM (SELECT id, min(low) AS cluster FROM r GROUP BY id) GROUP BY cluster""",
    # Runtime
    "runtime_merge": "SELECT callerFrame, calleeFrame, sum(samples)::BIGINT AS samples, bool_or(viaNative) AS viaNative, count(DISTINCT run) AS runs, arg_min(callerId, ord) AS callerId, arg_min(calleeId, ord) AS calleeId, arg_min(callerTier, ord) AS callerTier, arg_min(calleeTier, ord) AS calleeTier FROM {runtime} GROUP BY callerFrame, calleeFrame",
    "runtime_pairs": "SELECT * FROM {rpairs}",
    "runtime_join_rate": f"SELECT *, {_pct('joined', 'inside')} AS joined_pct, {_pct('exact', 'inside')} AS exact_pct, {_pct('joined_samples', 'samples')} AS weighted_pct FROM (SELECT count(*) AS edges, count(*) FILTER (i) AS inside, count(*) FILTER (i AND j) AS joined, count(*) FILTER (i AND x) AS exact, coalesce(sum(samples) FILTER (i), 0)::BIGINT AS samples, coalesce(sum(samples) FILTER (i AND j), 0)::BIGINT AS joined_samples FROM (SELECT samples, callerTier <> 'external' AS i, callerResolved AND calleeResolved AS j, callerTier = 'exact' AND calleeTier = 'exact' AS x FROM {{runtime}}))",
    "runtime_tiers": "SELECT 'caller' AS side, callerTier AS tier, count(*) AS n FROM {runtime} WHERE callerTier <> 'external' GROUP BY callerTier UNION ALL SELECT 'callee', calleeTier, count(*) FROM {runtime} GROUP BY calleeTier UNION ALL SELECT 'frame', tier, count(*) FROM (SELECT frame, arg_max(tier, pos) AS tier FROM (SELECT calleeFrame AS frame, calleeTier AS tier, ord * 2 AS pos FROM {runtime} UNION ALL SELECT callerFrame, callerTier, ord * 2 + 1 FROM {runtime} WHERE callerTier <> 'external') GROUP BY frame) GROUP BY tier",
    "runtime_novelty": "SELECT CASE WHEN s.callerId IS NOT NULL THEN 'static' WHEN p.callerId = p.calleeId THEN 'self_loop' WHEN starts_with(p.calleeId, 'module:') THEN 'module_callee' WHEN starts_with(p.callerId, 'module:') THEN 'module_caller' ELSE 'function_to_function' END AS class, count(*) AS n, count(*) FILTER (p.exact) AS exact, count(*) FILTER (p.viaNative) AS via_native, count(*) FILTER (x.callerId IS NOT NULL) AS shortcut FROM {rpairs} p LEFT JOIN {spairs} s ON s.callerId = p.callerId AND s.calleeId = p.calleeId LEFT JOIN {shortcut} x ON x.callerId = p.callerId AND x.calleeId = p.calleeId GROUP BY 1",
    "shortcut_edges": "SELECT * FROM {shortcut}",
    "sampling_recall": "SELECT runs, count(*) AS edges FROM (SELECT count(DISTINCT run) AS runs FROM {runtime} GROUP BY callerFrame, calleeFrame) GROUP BY runs",
    "hot_runtime_edges": "SELECT callerId, calleeId, sum(samples)::BIGINT AS samples FROM {runtime} WHERE contains(calleeId, '1') GROUP BY ALL ORDER BY samples DESC, callerId, calleeId LIMIT 12",
    "observed_static": f"SELECT count(*) AS static, count(p.callerId) AS observed, {_pct('count(p.callerId)', 'count(*)')} AS pct FROM {{spairs}} s LEFT JOIN {{rpairs}} p ON p.callerId = s.callerId AND p.calleeId = s.calleeId",
    "alias_edges": "SELECT DISTINCT n.callerId, n.calleeId || '.fn' AS calleeId FROM {rpairs} n JOIN {calls} h ON h.callerKind = 'variable' AND h.calleeId = n.calleeId JOIN {spairs} s ON s.callerId = n.callerId AND s.calleeId = h.callerId WHERE starts_with(n.calleeId, 'user:')",
    "frame_resolution": r"""
WITH RECURSIVE fn AS (SELECT 'src/m' || (u % 40) || '.ts' AS file, (u % 6 + 1)::INT AS line, u % 12 * 10 AS start, u % 12 * 10 + 5 AS nameStart, CASE WHEN u % 3 = 0 THEN NULL ELSE 'f' || (u % 4) END AS name, CASE WHEN u % 5 < 3 THEN 'user:' || u ELSE 'none:' || u END AS id, CASE WHEN u % 5 = 4 THEN 'none:0' ELSE 'module:src/m' || (u % 40) || '.ts' END AS encl, u AS ord FROM {users}),
fr AS (SELECT DISTINCT 'src/m' || (src % 40) || '.ts' AS file, CASE WHEN k % 7 = 0 THEN 1 ELSE (k % 6 + 1) END::INT AS line, CASE WHEN k % 7 = 0 THEN 0 ELSE k % 120 END::INT AS col, CASE WHEN k % 7 = 0 THEN '' ELSE 'f' || (k % 5) END AS fn, (k % 120)::BIGINT AS pos FROM {steps}),
c AS (SELECT r.*, 0 AS stage, abs(f.start - r.pos) AS gap, f.id, f.encl, f.ord FROM fr r JOIN fn f ON f.file = r.file AND r.pos IN (f.start, f.start + 1, f.nameStart) UNION ALL SELECT r.*, 1, 0, f.id, f.encl, f.ord FROM fr r JOIN fn f ON f.file = r.file AND f.line = r.line AND (f.name = r.fn OR f.name IS NULL OR r.fn = '')),
d AS (SELECT file, line, col, fn, pos, stage, 0 AS how, gap, ord, id AS got FROM c WHERE id IN (SELECT id FROM {known}) UNION ALL SELECT file, line, col, fn, pos, stage, 1, gap, ord, encl FROM c WHERE encl IN (SELECT id FROM {known})),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY file, line, col, fn, pos ORDER BY stage, how, gap, ord, got) = 1)
SELECT r.file, r.line, r.col, r.fn, CASE WHEN r.line = 1 AND r.col = 0 AND r.fn = '' THEN 'module:' || r.file ELSE b.got END AS id, CASE WHEN r.line = 1 AND r.col = 0 AND r.fn = '' THEN 'module' WHEN b.got IS NULL THEN 'none' WHEN b.how = 1 THEN 'enclosing' WHEN b.stage = 0 THEN 'exact' ELSE 'line' END AS tier FROM fr r LEFT JOIN b ON b.file = r.file AND b.line = r.line AND b.col = r.col AND b.fn = r.fn AND b.pos = r.pos""",
}


def texts() -> dict[str, str]:
    views = dict(testbed.VIEWS)
    return {**{k: testbed.with_views(v, {**views, **DERIVED}) for k, v in SQL.items()}, **samples.SQL}
