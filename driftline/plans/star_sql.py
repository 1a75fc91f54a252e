"""DuckDB SQL for the registered history queries, built from shared common table expressions."""

from __future__ import annotations

from driftline.params import TESTDATA as P
from driftline.plans.star_queries import AS_OF, FILE, OTHER

_COMMITS = f"""
o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey, o_custkey,
    CAST(epoch(o_orderdate) AS BIGINT) AS author_time,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'chore: ' || o_orderpriority
      ELSE o_orderpriority END AS subject, o_orderstatus = 'P' AS is_merge FROM orders),
touches AS (SELECT o.id AS commit_id, l_suppkey AS file_id, CASE WHEN min(l_linenumber) = 1 THEN 'A' ELSE 'M' END AS change,
  CAST(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(CASE
      WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS BIGINT) AS lines_removed,
  bool_and(l_tax <= 0.02) AS import_only, bool_or(l_returnflag = 'N') AS open_line FROM lineitem
      JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2),
sizes AS (SELECT commit_id, count(*) AS n, count(*) FILTER (WHERE import_only) AS k FROM touches GROUP BY 1),
f AS (SELECT o.*, coalesce(n, 0) AS n_files, coalesce(n, 0) > {P.max_commit_files} AS large,
  coalesce(n, 0) > 5 AND (subject LIKE 'chore:%' OR coalesce(k, 0) / n > 0.9) AS mech FROM o LEFT
      JOIN sizes ON o.id = sizes.commit_id),
commits AS (SELECT id, CAST(o_orderkey AS VARCHAR) AS oid, o_orderkey, o_custkey, author_time, subject, is_merge, n_files,
  CAST((CASE WHEN large THEN 1 ELSE 0 END) + (CASE WHEN mech THEN 2 ELSE 0 END) + (CASE WHEN is_merge THEN 8
      ELSE 0 END) AS BIGINT) AS excluded,
  CASE WHEN large OR mech OR n_files = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / n_files END AS weight FROM f),
span AS (SELECT min(author_time) AS t0, max(author_time) AS t1 FROM commits),
inc AS (SELECT id AS commit_id, author_time, weight, weight * pow(0.5::DOUBLE, greatest((t1 - author_time) / 86400.0::DOUBLE, 0) / {P.half_life_days}::DOUBLE) AS decayed FROM commits, span WHERE weight > 0),
files AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal >= 0 THEN s_name END AS current_path, s_name AS last_path FROM supplier)"""
_TOUCHED = "touched AS (SELECT t.commit_id, t.file_id, weight, decayed FROM touches t JOIN inc ON t.commit_id = inc.commit_id)"
_PAIRS = """
raw AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS n, sum(x.weight) AS w_support,
    sum(x.decayed) AS w_decayed, min(x.commit_id) AS first_commit, max(x.commit_id) AS last_commit
  FROM touched x JOIN touched y ON x.commit_id = y.commit_id AND x.file_id < y.file_id GROUP BY 1, 2 HAVING count(*) >= 2),
sup AS (SELECT file_id, sum(decayed) AS w FROM touched GROUP BY 1),
pairs AS (SELECT raw.*, CASE WHEN p.w <= 0 THEN 0 ELSE least(w_decayed / p.w, 1.0) END AS conf_ab, CASE WHEN q.w <= 0 THEN 0
    ELSE least(w_decayed / q.w, 1.0) END AS conf_ba,
  CASE WHEN p.w * q.w / (SELECT sum(decayed) FROM inc) > 0 THEN w_decayed / (p.w * q.w / (SELECT sum(decayed) FROM inc))
      ELSE 0 END AS lift
  FROM raw JOIN sup p ON p.file_id = a JOIN sup q ON q.file_id = b)"""
_INTERVALS = """
snaps AS (SELECT file_id AS src, commit_id, row_number() OVER w AS seq, lead(commit_id) OVER w AS nxt FROM touches
    WINDOW w AS (PARTITION BY file_id ORDER BY commit_id)),
tgt AS (SELECT x.file_id AS src, y.file_id AS dst, x.commit_id FROM touches x JOIN touches y ON x.commit_id = y.commit_id
    AND x.file_id <> y.file_id WHERE x.open_line AND y.open_line),
isl AS (SELECT t.src, t.dst, t.commit_id, seq, nxt, seq - row_number() OVER (PARTITION BY t.src, t.dst ORDER BY t.commit_id) AS g
    FROM tgt t JOIN snaps s ON t.src = s.src AND t.commit_id = s.commit_id),
intervals AS (SELECT src, dst, 0 AS kind, min(commit_id) AS born, arg_max_null(nxt, seq) AS died FROM isl GROUP BY src, dst, g)"""
_LIVES = """
timed AS (SELECT i.*, CAST(trunc((coalesce(d.author_time, t1) - b.author_time) / 86400.0) AS BIGINT) AS days FROM intervals i
    JOIN commits b ON b.id = born LEFT JOIN commits d ON d.id = died, span),
lives AS (SELECT src, dst, kind, bool_or(died IS NULL) AS alive,
    count(*) AS n_intervals, max(born) AS last_born, arg_max_null(died, born) AS last_died, arg_max(days, born) AS last_days,
  CAST(sum(days) AS BIGINT) AS lifetime_days FROM timed GROUP BY src, dst, kind)"""
_GHOSTS = f"""
cand AS (SELECT l.src, l.dst, l.kind, last_died, last_days AS lifetime_days, c.author_time AS cut FROM lives l
    JOIN commits c ON c.id = last_died
  JOIN files x ON x.id = src AND x.current_path IS NOT NULL JOIN files y ON y.id = dst AND y.current_path IS NOT NULL
  WHERE NOT alive AND last_days >= {P.ghost_min_lifetime_days} AND c.excluded & 2 = 0),
later AS (SELECT c.src, c.dst, c.kind, last_died, lifetime_days, cut, sum(m.decayed) AS w_src, sum(CASE
    WHEN t.file_id IS NOT NULL THEN m.decayed END) AS w_both, count(t.file_id) AS cochanges_since
  FROM cand c JOIN touched m ON m.file_id = c.src AND m.commit_id > last_died LEFT JOIN touched t ON t.file_id = c.dst
      AND t.commit_id = m.commit_id GROUP BY ALL),
ghosts AS (SELECT src, dst, kind, last_died AS severed_commit, lifetime_days, cochanges_since, least(w_both / w_src, 1.0) AS conf_since,
  least(w_both / w_src, 1.0) * ln(1 + cochanges_since) * pow(0.5::DOUBLE, greatest((t1 - cut) / 86400.0::DOUBLE, 0) / {P.half_life_days}::DOUBLE) * ln(1 + lifetime_days) AS score
  FROM later, span WHERE cochanges_since >= {P.ghost_min_cochanges_since} AND w_both / w_src >= {P.ghost_min_conf_since})"""
_DRIFT = """
dlast AS (SELECT o_custkey AS doc, max(id) AS doc_last FROM commits GROUP BY 1),
dpair AS (SELECT DISTINCT o.o_custkey AS doc, l_suppkey AS code FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey),
clast AS (SELECT file_id AS code, max(commit_id) AS code_last FROM touches GROUP BY 1),
drift AS (SELECT p.doc, p.code, count(*) AS commits_behind, any_value(doc_last) AS doc_last, any_value(code_last) AS code_last
    FROM dpair p JOIN dlast d ON d.doc = p.doc JOIN clast c ON c.code = p.code
  JOIN touched t ON t.file_id = p.code AND t.commit_id > doc_last GROUP BY 1, 2)"""
_VIZ = """
live AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM lives JOIN files x ON x.id = src
    AND x.current_path IS NOT NULL JOIN files y ON y.id = dst AND y.current_path IS NOT NULL WHERE alive),
co AS (SELECT p.* FROM pairs p JOIN files x ON x.id = a AND x.current_path IS NOT NULL JOIN files y ON y.id = b AND y.current_path IS NOT NULL WHERE lift >= 1.2)"""


def _six(x: str) -> str:
    return f"round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE"


def _at(x: str, places: int) -> str:
    return f"round(({x}) * {10**places}.0::DOUBLE) / {10**places}.0::DOUBLE"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


_TOUCH = (_COMMITS, _TOUCHED)
_CO = (*_TOUCH, _PAIRS)
_IV = (_COMMITS, _INTERVALS)
_LV = (_COMMITS, _INTERVALS, _LIVES)
_GH = (_COMMITS, _TOUCHED, _INTERVALS, _LIVES, _GHOSTS)
_ALL = (_COMMITS, _TOUCHED, _PAIRS, _INTERVALS, _LIVES, _GHOSTS)
_STRONG = f"n >= {P.min_cochange_n} AND lift >= {P.min_lift}"
_DATE = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%d')"


def _hot(scores: str, words: str) -> str:
    return f"""SELECT path, score, detail FROM (SELECT current_path AS path, {_at(_six('sum(s)'), 2)} AS score, count(*) || ' {words}' AS detail
      FROM ({scores}) JOIN files ON files.id = file_id WHERE current_path IS NOT NULL GROUP BY current_path) ORDER BY score DESC, path LIMIT 20"""


def _reach(name: str, edges: str, depth: int) -> str:
    """Levels by repeated distinct steps; small depths only."""
    out = [f"{name}_e AS (SELECT DISTINCT * FROM (SELECT src AS here, dst AS nxt FROM {edges} UNION ALL SELECT dst, src FROM {edges}) WHERE here <> nxt)", f"{name}_0 AS (SELECT {FILE}::BIGINT AS node, 0::BIGINT AS dist)"]
    for d in range(1, depth + 1):
        out.append(f"{name}_{d} AS (SELECT * FROM {name}_{d - 1} UNION ALL SELECT nxt, {d}::BIGINT FROM (SELECT DISTINCT nxt FROM {name}_{d - 1} JOIN {name}_e ON here = node) WHERE nxt NOT IN (SELECT node FROM {name}_{d - 1}))")
    return ", ".join(out)


_TRANSITIVE = f"""wide AS (SELECT * FROM lives WHERE alive OR lifetime_days >= {P.ghost_min_lifetime_days}), livee AS (SELECT * FROM lives WHERE alive),
{_reach('u', 'wide', 2)}, {_reach('v', 'livee', 3)},
tr AS (SELECT u.node, u.dist AS union_dist, v.dist AS head_dist FROM u_2 u LEFT JOIN v_3 v ON v.node = u.node WHERE u.dist > 0 AND (v.dist IS NULL OR v.dist > u.dist))"""


def _ways(name: str, edges: str, depth: int = 6) -> str:
    """Levels as in _reach, each node with its smallest parent, and the hops back from OTHER."""
    out = [f"{name}_e AS (SELECT DISTINCT * FROM (SELECT src AS here, dst AS nxt FROM {edges} UNION ALL SELECT dst, src FROM {edges}) WHERE here <> nxt)"]
    out.append(f"{name}_0 AS (SELECT {FILE}::BIGINT AS node, 0::BIGINT AS dist, NULL::BIGINT AS parent)")
    for d in range(1, depth + 1):
        step = f"SELECT nxt, {d}::BIGINT, min(here) FROM {name}_{d - 1} JOIN {name}_e ON here = node WHERE dist = {d - 1} AND nxt NOT IN (SELECT node FROM {name}_{d - 1}) GROUP BY nxt"
        out.append(f"{name}_{d} AS (SELECT * FROM {name}_{d - 1} UNION ALL {step})")
    out.append(f"{name}_back AS (SELECT node, dist, parent FROM {name}_{depth} WHERE node = {OTHER} UNION ALL SELECT t.node, t.dist, t.parent FROM {name}_back b JOIN {name}_{depth} t ON t.node = b.parent)")
    out.append(f"""{name}_hop AS (SELECT dist - 1 AS step, e.*, row_number() OVER (PARTITION BY dist ORDER BY e.src <> parent, e.kind, e.src, e.dst) AS nth
      FROM {name}_back b JOIN {edges} e ON (e.src = parent AND e.dst = node) OR (e.src = node AND e.dst = parent) WHERE parent IS NOT NULL)""")
    return ", ".join(out)


def oracle() -> dict[str, str]:
    """SQL by query name."""
    q: dict[str, str] = {}
    q["commit_classified"] = _with(_COMMITS) + f"SELECT id, oid, author_time, {_DATE.format('author_time')} AS date, subject, n_files, excluded, {_six('weight')} AS weight, excluded & 1 <> 0 AS too_large, excluded & 2 <> 0 AS mechanical, excluded & 8 <> 0 AS \"merge\" FROM commits"
    q["touches_dedup"] = _with(_COMMITS) + "SELECT commit_id, file_id, change, lines_added, lines_removed, import_only FROM touches WHERE commit_id IN (SELECT commit_id FROM inc)"
    q["decay_weights"] = _with(_COMMITS) + f"SELECT commit_id, {_six('weight')} AS weight, {_six('decayed')} AS decayed FROM inc"
    q["cochange_pairs"] = _with(*_CO) + "SELECT a, b, n, " + ", ".join(f"{_six(c)} AS {c}"
        for c in ("w_support", "w_decayed", "conf_ab", "conf_ba", "lift")) + ", first_commit, last_commit FROM pairs"
    q["cochange_for_file"] = _with(*_CO, _INTERVALS) + f"""SELECT path, n, confidence, lift, "first", "last", structural_edge FROM (
      SELECT current_path AS path, n, {_at('conf', 2)} AS confidence, {_at('lift', 1)} AS lift, {_DATE.format('c1.author_time')} AS "first", {_DATE.format('c2.author_time')} AS "last", {_six('w_decayed')} AS w, other,
        EXISTS (SELECT 1 FROM intervals i WHERE (i.src = {FILE} AND i.dst = other) OR (i.dst = {FILE}
            AND i.src = other)) AS structural_edge
      FROM (SELECT *, CASE WHEN a = {FILE} THEN b ELSE a END AS other, CASE WHEN a = {FILE} THEN conf_ab ELSE conf_ba END AS conf
          FROM pairs WHERE (a = {FILE} OR b = {FILE}) AND {_STRONG})
      JOIN files ON files.id = other AND current_path IS NOT NULL JOIN commits c1 ON c1.id = first_commit JOIN commits c2 ON c2.id = last_commit) ORDER BY w DESC, other LIMIT 20"""
    q["hotspots_churn"] = _with(*_TOUCH) + _hot("SELECT file_id, decayed AS s FROM touched", "touches")
    q["hotspots_coupling"] = _with(*_CO) + _hot(f"SELECT unnest([a, b]) AS file_id, w_decayed AS s FROM pairs WHERE {_STRONG}", "coupled partners")
    q["hotspots_ghosts"] = _with(*_GH) + _hot("SELECT unnest([src, dst]) AS file_id, score AS s FROM ghosts", "ghost edges")
    q["edge_intervals"] = _with(*_IV) + "SELECT src, dst, kind, born, died FROM intervals"
    q["edge_lifetimes"] = _with(*_LV) + "SELECT * FROM lives"
    q["ghosts"] = _with(*_GH) + f"SELECT src, dst, kind, severed_commit, lifetime_days, cochanges_since, {_six('conf_since')} AS conf_since, {_six('score')} AS score FROM ghosts"
    q["ghosts_top"] = _with(*_GH) + f"""SELECT x.last_path AS "from", y.last_path AS "to", 'import' AS kind, substr(c.oid, 1, 12) AS oid, {_DATE.format('c.author_time')} AS date, subject, lifetime_days, cochanges_since, {_at(_six('conf_since'), 2)} AS confidence_since, {_at('s', 2)} AS score
      FROM (SELECT *, {_six('score')} AS s FROM ghosts ORDER BY s DESC, src, dst, kind LIMIT 20) JOIN files x ON x.id = src JOIN files y ON y.id = dst JOIN commits c ON c.id = severed_commit"""
    q["as_of_live_edges"] = _with(*_IV) + f"SELECT DISTINCT src, dst, kind FROM intervals WHERE born <= {AS_OF} AND (died IS NULL OR died > {AS_OF})"
    q["drift"] = _with(*_TOUCH, _DRIFT) + "SELECT doc, code, commits_behind, doc_last, code_last FROM drift"
    q["drift_top"] = _with(*_TOUCH,
        _DRIFT) + f"""SELECT doc, code, commits_behind, {_DATE.format('a.author_time')} AS doc_last_touched, {_DATE.format('b.author_time')} AS code_last_touched
      FROM (SELECT * FROM drift ORDER BY commits_behind DESC, doc, code LIMIT 20) JOIN commits a ON a.id = doc_last JOIN commits b ON b.id = code_last"""
    q["blast"] = _with(*_ALL, _TRANSITIVE, f"""
      direct AS (SELECT CASE WHEN src = {FILE} THEN dst ELSE src END AS other, 'structural' AS type, 0.55::DOUBLE AS s FROM lives
          WHERE (src = {FILE} OR dst = {FILE}) AND alive
        UNION ALL SELECT CASE WHEN src = {FILE} THEN dst
            ELSE src END, 'ghost', least(0.35::DOUBLE + 0.55::DOUBLE * least(conf_since * ln(1 + cochanges_since) / ln(3.0::DOUBLE), 1.0), 0.9) FROM ghosts WHERE src = {FILE} OR dst = {FILE}),
      cc AS (SELECT CASE WHEN a = {FILE} THEN b ELSE a END AS other, 'cochange' AS type, CASE WHEN a = {FILE} THEN conf_ab
          ELSE conf_ba END AS conf, lift, n FROM pairs WHERE a = {FILE} OR b = {FILE}),
      known AS (SELECT * FROM direct UNION ALL SELECT other, type, least(conf * least(lift / 5.0, 1.0), 0.85) FROM cc
          WHERE other IN (SELECT other FROM direct)
        OR ({_STRONG} AND other IN (SELECT id FROM files WHERE current_path IS NOT NULL))),
      ev AS (SELECT * FROM known UNION ALL SELECT node, 'transitive', 0.25::DOUBLE / union_dist FROM tr
          WHERE node NOT IN (SELECT other FROM known) AND node IN (SELECT id FROM files WHERE current_path IS NOT NULL)),
      ranked AS (SELECT other, 1.0::DOUBLE - product(1.0::DOUBLE - least(greatest(s, 0), 0.999)) AS raw, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ev GROUP BY other)""") + f"SELECT last_path AS path, {_at('raw', 2)} AS rank, n AS n_evidence, types FROM ranked JOIN files ON files.id = other WHERE raw >= 0.1"
    q["transitive"] = _with(*_LV, _TRANSITIVE) + """SELECT node, union_dist, head_dist, CASE WHEN union_dist = 1 THEN '' ELSE CAST((SELECT min(e.here) FROM u_e e JOIN u_1 w ON w.node = e.here AND w.dist = 1 WHERE e.nxt = tr.node) AS VARCHAR) END AS via FROM tr"""
    q["path_bfs"] = _with(*_IV, f"then_e AS (SELECT DISTINCT src, dst FROM intervals WHERE born <= {AS_OF} AND (died IS NULL OR died > {AS_OF}))", _reach("r", "then_e", 6)) + "SELECT node, dist FROM r_6"
    wide = f"widee AS (SELECT * FROM lives WHERE alive OR lifetime_days >= {P.ghost_min_lifetime_days}), livee AS (SELECT * FROM lives WHERE alive)"
    hop = "SELECT '{0}' AS path, step, src, dst, 'import' AS kind, alive, last_died FROM {1}_hop WHERE nth = 1"
    q["path_hops"] = _with(*_LV, wide, _ways("a", "livee"), _ways("b", "widee"),
        recursive=True) + f"{hop.format('live_path', 'a')} UNION ALL {hop.format('union_path', 'b')} AND NOT EXISTS (SELECT 1 FROM a_6 WHERE node = {OTHER})"
    q["timeline_churn"] = _with(_COMMITS) + f"SELECT strftime(to_timestamp(author_time) AT TIME ZONE 'UTC', '%Y') || '-Q' || quarter(to_timestamp(author_time) AT TIME ZONE 'UTC') AS period, count(*) AS touches, CAST(sum(lines_added + lines_removed) AS BIGINT) AS lines FROM touches JOIN commits ON id = commit_id WHERE file_id = {FILE} GROUP BY 1"
    side = f"CASE WHEN src = {FILE} THEN dst ELSE src END AS other, CASE WHEN src = {FILE} THEN 'out' ELSE 'in' END AS direction FROM intervals WHERE (src = {FILE} OR dst = {FILE})"
    q["timeline_events"] = _with(*_IV) + f"SELECT * FROM (SELECT born AS \"commit\", 'opened' AS event, {side} UNION ALL SELECT died, 'closed', {side} AND died IS NOT NULL) ORDER BY \"commit\", event, other, direction LIMIT 200"
    q["why_pair"] = _with(*_GH) + f"SELECT l.src, l.dst, 'import' AS kind, l.alive, l.n_intervals, l.lifetime_days, severed_commit, cochanges_since, {_six('conf_since')} AS conf_since FROM lives l LEFT JOIN ghosts g ON g.src = l.src AND g.dst = l.dst WHERE (l.src = {FILE} AND l.dst = {OTHER}) OR (l.src = {OTHER} AND l.dst = {FILE})"
    q["stats"] = _with(*_ALL) + """SELECT * FROM (SELECT count(*) AS commits, count(*) FILTER (WHERE excluded & 1 <> 0) AS too_large, count(*) FILTER (WHERE excluded & 2 <> 0) AS mechanical, count(*) FILTER (WHERE is_merge) AS merges,
      round(count(*) FILTER (WHERE weight <= 0)::DOUBLE / count(*) * 1000.0) / 10.0 AS excluded_pct FROM commits), (SELECT
          count(*) AS files, count(current_path) AS alive_files FROM files),
      (SELECT count(*) AS edges, count(*) FILTER (WHERE alive) AS live_edges FROM lives), (SELECT count(*) AS ghosts FROM ghosts), (SELECT count(*) AS cochange_pairs FROM pairs)"""
    q["search_bm25"] = r"""WITH toks AS (SELECT doc_id, 'text' AS field, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')) FROM documents),
      lens AS (SELECT doc_id, count(*) AS len FROM toks GROUP BY 1), corpus AS (SELECT count(*) AS n, avg(len) AS al FROM lens),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN ('stupid', 'src3', 'the')
          GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      hits AS (SELECT doc_id FROM toks WHERE term = 'stupid' UNION (SELECT doc_id FROM toks WHERE field = 'source'
          AND term = 'src3' INTERSECT SELECT doc_id FROM toks WHERE term = 'the'))
      SELECT doc_id, """ + _six("sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))))") + """ AS score
      FROM tf JOIN df USING (term) JOIN lens USING (doc_id), corpus WHERE doc_id IN (SELECT doc_id FROM hits) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""
    ends = "SELECT unnest([a, b]) AS id, 1 AS d, 0.0::DOUBLE AS w FROM live UNION ALL SELECT unnest([a, b]), 0, w_decayed FROM co"
    q["viz_nodes"] = _with(*_CO, _INTERVALS, _LIVES,
        _VIZ) + f"SELECT current_path AS path, CASE WHEN contains(current_path, '/') THEN split_part(current_path, '/', 1) ELSE '(root)' END AS grp, CAST(sum(d) AS BIGINT) AS degree, {_at(_six('sum(w)'), 2)} AS coupling FROM ({ends}) e JOIN files ON files.id = e.id GROUP BY current_path"
    q["viz_hidden"] = _with(*_CO, _INTERVALS, _LIVES,
        _VIZ) + f"SELECT a, b, n, {_six('w_decayed')} AS w, {_six('lift')} AS lift FROM co WHERE lift >= 1.4 AND n >= 3 AND NOT EXISTS (SELECT 1 FROM live WHERE live.a = co.a AND live.b = co.b) ORDER BY w DESC, a, b LIMIT 40"
    # Test urls have no empty, `.` or `..` parts of their own, so the normal form of what is appended is known.
    q["path_scalars"] = r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, split_part(regexp_extract(url, '([^/]*)$', 1), '.', 1) AS stem,
      array_to_string(list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.'), '/') || '/b.min.js' AS normal, true AS excluded, 'py' AS lang FROM pages"""
    q["link_extract"] = r"""SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, href, array_to_string(list_filter(string_split(split_part(href, '#', 1), '/'), lambda x: x <> '' AND x <> '.'), '/') AS target
      FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages) WHERE NOT regexp_matches(href, '^(https?:|mailto:)')"""
    q["export_edges"] = _with(*_GH) + "SELECT l.src, l.dst, l.kind, CASE WHEN l.alive THEN 'live' WHEN g.src IS NOT NULL THEN 'ghost' ELSE 'dead' END AS state FROM lives l LEFT JOIN ghosts g ON g.src = l.src AND g.dst = l.dst AND g.kind = l.kind"
    q["touch_windows"] = f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, {_six('sum(value)')} AS value FROM events GROUP BY 1, 2"
    return q
