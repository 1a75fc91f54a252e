"""DuckDB SQL for the queries over the change log."""

from __future__ import annotations

from driftline.plans.log_queries import REVS
from driftline.plans.star_queries import FILE
from driftline.plans.star_sql import _COMMITS, _DRIFT, _TOUCHED, _at, _six, _with
from driftline.sources.changelog import COMMIT_DAYS, CUT_LINES, DIRS, EXTENSIONS, LANGUAGES, MOVE_LINES


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _lang(of: str) -> str:
    return f"{_list(LANGUAGES)}[{of} % {len(LANGUAGES)} + 1]"


_LOG = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY commit_id) AS n FROM touches),
cuts AS (SELECT *, n > 1 AND lines_removed >= {CUT_LINES} AS cut FROM numbered),
blocks AS (SELECT *, count(*) FILTER (WHERE NOT cut) OVER (PARTITION BY file_id ORDER BY commit_id) AS block FROM cuts),
counted AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY file_id, block ORDER BY commit_id) AS nth FROM blocks),
kinds AS (SELECT *, CASE WHEN n = 1 OR coalesce(lag(cut AND nth % 2 = 1) OVER (PARTITION BY file_id
    ORDER BY commit_id), false) THEN 'A' WHEN cut THEN 'D'
    WHEN lines_added BETWEEN 1 AND {MOVE_LINES} THEN 'R' ELSE 'M' END AS what FROM counted),
moved AS (SELECT *, count(*) FILTER (WHERE what = 'R') OVER (PARTITION BY file_id ORDER BY commit_id) AS moves,
    'd' || (file_id % {DIRS}) || '/s' || file_id || '.' || {_list(EXTENSIONS)}[file_id % {len(EXTENSIONS)} + 1] AS base
        FROM kinds),
log AS (SELECT commit_id, commit_id * {COMMIT_DAYS * 86400} AS author_time, file_id, what AS change, CASE
    WHEN moves % 2 = 1 THEN 'm/' || base ELSE base END AS path,
    CASE WHEN what = 'R' THEN CASE WHEN moves % 2 = 0 THEN 'm/' || base ELSE base END END AS old_path, CASE WHEN what <> 'D' THEN 'b' || (commit_id % 5) END AS new_blob, lines_added, lines_removed, open_line FROM moved)"""

# A file that comes back later than 90 days after its death, and changed, is another file.
_IDENTITY = """
prior AS (SELECT *, lag(author_time) OVER w AS before_time, lag(change) OVER w AS before_change,
    last_value(new_blob IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY commit_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) AS last_blob FROM log WINDOW w AS (PARTITION BY file_id ORDER BY commit_id)),
starts AS (SELECT *, change = 'A' AND (before_change IS NULL OR (author_time - before_time > 90 * 86400
    AND new_blob <> last_blob)) AS begins FROM prior),
grouped AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY commit_id) AS life FROM starts),
ids AS (SELECT file_id AS old_id, life, row_number() OVER (ORDER BY commit_id, path) AS new_id FROM grouped WHERE begins),
known AS (SELECT g.*, new_id FROM grouped g JOIN ids ON old_id = g.file_id AND ids.life = g.life)"""

_PATHS = """
steps AS (SELECT file_id, path, commit_id AS from_commit, lead(commit_id) OVER (PARTITION BY file_id
    ORDER BY commit_id) AS to_commit, change FROM log WHERE change IN ('A', 'R', 'D')),
places AS (SELECT * FROM steps WHERE change <> 'D')"""

_LINKS = """
said AS (SELECT x.file_id AS src, y.file_id AS dst, x.commit_id, x.path AS src_path, y.path AS dst_path FROM log x
    JOIN log y ON x.commit_id = y.commit_id AND x.file_id <> y.file_id
  WHERE x.open_line AND y.open_line AND x.change <> 'D' AND y.change <> 'D')"""

# Every event that may move a link, in order; a link is open while its target lives and what was last said of it holds.
_STATES = """
pairs_ever AS (SELECT DISTINCT src, dst FROM said),
told AS (SELECT p.src, p.dst, l.commit_id, 2 AS phase, '' AS path, 'read' AS what, s.src IS NOT NULL AS listed FROM pairs_ever p
    JOIN log l ON l.file_id = p.src AND l.change <> 'D'
    LEFT JOIN said s ON s.src = p.src AND s.dst = p.dst AND s.commit_id = l.commit_id
  UNION ALL SELECT p.src, p.dst, l.commit_id, CASE WHEN l.change = 'D' THEN 0 ELSE 1 END, l.path, CASE
      WHEN l.change = 'D' THEN 'src dies' ELSE 'src comes' END, false FROM pairs_ever p JOIN log l ON l.file_id = p.src
      AND l.change IN ('A', 'D')
  UNION ALL SELECT p.src, p.dst, l.commit_id, CASE WHEN l.change = 'D' THEN 0 ELSE 1 END, l.path, CASE
      WHEN l.change = 'D' THEN 'dst dies' ELSE 'dst comes' END, false FROM pairs_ever p JOIN log l ON l.file_id = p.dst
      AND l.change IN ('A', 'D')),
lived AS (SELECT *, coalesce(last_value(CASE what WHEN 'dst comes' THEN 1 WHEN 'dst dies' THEN 0 END IGNORE NULLS)
    OVER w, 0) AS dst_lives, coalesce(last_value(CASE what WHEN 'src comes' THEN 1 WHEN 'src dies' THEN 0 END IGNORE NULLS)
    OVER w, 0) AS src_lives
  FROM told WINDOW w AS (PARTITION BY src, dst ORDER BY commit_id, phase, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
spoken AS (SELECT *, CASE WHEN what = 'read' AND dst_lives = 1 THEN CASE WHEN listed THEN 1 ELSE 0 END WHEN what = 'src dies'
    AND dst_lives = 1 THEN 0 WHEN what = 'dst comes' AND src_lives = 0 THEN 0 END AS word FROM lived),
held AS (SELECT *, CASE WHEN dst_lives = 1 AND coalesce(last_value(word IGNORE NULLS) OVER (PARTITION BY src, dst
    ORDER BY commit_id, phase, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 THEN 1 ELSE 0 END AS is_open
    FROM spoken),
turns AS (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY src, dst ORDER BY commit_id, phase, path), 0) AS was_open FROM held),
changed AS (SELECT src, dst, commit_id, is_open, lead(commit_id) OVER (PARTITION BY src, dst ORDER BY commit_id, phase, path) AS upto FROM turns WHERE is_open <> was_open)"""

_REFS = f"""
refs AS (SELECT DISTINCT src, commit_id, {_lang('src')} AS lang, regexp_extract(src_path, '^(.*)/[^/]*$', 1) AS dir, CASE
    WHEN {_lang('src')} = 'go' THEN dst % {DIRS} ELSE dst END AS aim FROM said),
found AS (SELECT r.*, p.file_id AS dst FROM refs r LEFT JOIN places p ON lang <> 'go' AND p.file_id = aim
    AND from_commit <= commit_id AND (to_commit IS NULL OR to_commit > commit_id)
    AND regexp_extract(p.path, '^(.*)/[^/]*$', 1) = dir
    AND CASE WHEN lang IN ('ts', 'js', 'coffee') THEN {_lang('aim')} IN ('ts', 'js', 'coffee')
        WHEN lang = 'md' THEN {_lang('aim')} = 'ts' ELSE {_lang('aim')} = lang END),
packages AS (SELECT r.src, r.commit_id, r.aim, p.file_id AS dst, row_number() OVER (PARTITION BY r.src, r.commit_id, r.aim
    ORDER BY p.path, p.file_id) AS nth FROM refs r JOIN places p ON r.lang = 'go' AND {_lang('p.file_id')} = 'go'
    AND from_commit <= commit_id AND (to_commit IS NULL OR to_commit > commit_id)
        AND regexp_extract(p.path, '^(.*)/[^/]*$', 1) = regexp_extract(dir, '^(m/)?', 1) || 'd' || aim),
lives_of AS (SELECT file_id, commit_id AS enter, lead(commit_id) OVER (PARTITION BY file_id ORDER BY commit_id) AS death, change
    FROM log WHERE change IN ('A', 'D')),
named AS (SELECT f.*, l.file_id AS by_name FROM found f LEFT JOIN lives_of l ON dst IS NULL AND lang NOT IN ('go', 'md')
    AND aim >= 10 AND aim % 2 = 0 AND l.file_id = aim AND l.change = 'A' AND enter <= commit_id
    AND (death IS NULL OR death > commit_id)),
linked AS (SELECT src, commit_id, dst, CASE WHEN lang = 'md' THEN 3 ELSE 0 END AS kind, 0 AS resolution FROM named
    WHERE dst IS NOT NULL UNION ALL SELECT src, commit_id, by_name, 0, 1 FROM named WHERE by_name IS NOT NULL
  UNION ALL SELECT src, commit_id, dst, 0, 2 FROM packages WHERE nth <= 20)"""


# Every file of a package, however many it has.
_WHOLE = _REFS.replace(""", row_number() OVER (PARTITION BY r.src, r.commit_id, r.aim
    ORDER BY p.path, p.file_id) AS nth""", "").replace(" WHERE nth <= 20", "")


def oracle() -> dict[str, str]:
    log = (_COMMITS, _LOG)
    q: dict[str, str] = {}
    q["change_log"] = _with(*log) + "SELECT commit_id, author_time, file_id, change, path, old_path, new_blob, lines_added, lines_removed FROM log"
    q["identity_files"] = _with(*log,
        _IDENTITY) + """SELECT new_id AS file_id, max(path) FILTER (WHERE begins) AS first_path, max(commit_id) FILTER (WHERE begins) AS born_commit,
      count(*) FILTER (WHERE change IN ('A', 'R')) AS n_file_paths, count(*) AS n_touches, count(*) FILTER (WHERE change = 'D') AS n_deaths, count(*) FILTER (WHERE change = 'A' AND NOT begins) AS n_returns FROM known GROUP BY new_id"""
    q["identity_spans"] = _with(*log,
        _IDENTITY) + """SELECT file_id, path, from_commit, to_commit, confidence FROM (SELECT new_id AS file_id, path, commit_id AS from_commit, change, lead(commit_id) OVER (PARTITION BY new_id ORDER BY commit_id) AS to_commit,
      CASE WHEN change = 'R' AND new_blob <> last_blob THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM known WHERE change IN ('A', 'R', 'D')) WHERE change <> 'D'"""
    q["edge_intervals_with_deaths"] = _with(*log, _LINKS,
        _STATES) + "SELECT src, dst, 0 AS kind, commit_id AS born, upto AS died FROM changed WHERE is_open = 1"
    q["symbol_spans"] = _with(*log, """
      snaps AS (SELECT file_id, commit_id, change, lines_added, row_number() OVER w AS seq, lead(commit_id) OVER w AS nxt
          FROM log WINDOW w AS (PARTITION BY file_id ORDER BY commit_id)),
      defs AS (SELECT file_id, commit_id, seq, nxt, unnest(['s' || file_id, 'q' || (lines_added % 7)]) AS name FROM snaps
          WHERE change <> 'D'),
      isl AS (SELECT *, seq - row_number() OVER (PARTITION BY file_id, name ORDER BY commit_id) AS g FROM defs)""") + "SELECT name, file_id, 'fn' AS kind, min(commit_id) AS first_commit, arg_max_null(nxt, seq) AS last_commit FROM isl GROUP BY file_id, name, g"
    q["import_links"] = _with(*log, _LINKS, _PATHS,
        _WHOLE) + "SELECT src, commit_id, dst, kind, min(resolution) AS resolution FROM linked WHERE src <> dst GROUP BY ALL"
    q["import_health"] = _with(*log, _LINKS, _PATHS, _REFS) + """SELECT n.src, n.commit_id, count(*) AS imports_total,
      count(*) FILTER (WHERE n.dst IS NOT NULL OR by_name IS NOT NULL OR p.src IS NOT NULL) AS imports_resolved FROM named n LEFT JOIN (SELECT DISTINCT src, commit_id, aim FROM packages) p ON p.src = n.src AND p.commit_id = n.commit_id AND p.aim = n.aim AND n.lang = 'go' GROUP BY 1, 2"""
    q["source_extract"] = f"""SELECT CAST(s_suppkey AS VARCHAR) AS blob_oid, lang, CASE lang WHEN 'ts' THEN './s' || n WHEN 'js' THEN './s' || n WHEN 'coffee' THEN './s' || n WHEN 'py' THEN '.s' || n WHEN 'rb' THEN 'rel:s' || n WHEN 'rust' THEN 'crate::s' || n || '::a' || n WHEN 'go' THEN 'm/s' || n ELSE '' END AS specs,
      CASE WHEN lang IN ('ts', 'py', 'coffee') THEN 'a' || n ELSE '' END AS names, CASE
          WHEN lang = 'md' OR length('g' || n) < 3 THEN '' ELSE 'g' || n END AS calls, CASE lang WHEN 'md' THEN ''
          WHEN 'js' THEN 'f' || n || ':fn,a' || n || ':const' ELSE 'f' || n || ':fn' END AS defs,
      CASE WHEN lang = 'md' THEN 's' || n || '.md' ELSE '' END AS doc_links, CASE WHEN lang = 'md' THEN 'f' || n || '_x' ELSE '' END AS doc_tokens FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS n, {_lang('s_suppkey')} AS lang FROM supplier)"""
    folder = "['src', 'vendor', 'dist', 'lib/node_modules'][({0}) % 4 + 1] || '/p' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '.min.js' ELSE '.js' END"
    q["normalized_changes"] = f"""WITH raw AS (SELECT p_partkey, ['A', 'M', 'D', 'R'][p_partkey % 4 + 1] AS change, {folder.format('p_partkey // 4')} AS path, {folder.format('p_partkey // 16')} AS old_path, 'b' || p_partkey AS new_blob FROM part),
      marked AS (SELECT *, NOT (path LIKE 'src/%') OR path LIKE '%.min.js' AS skipped, change = 'R'
          AND (NOT (old_path LIKE 'src/%') OR old_path LIKE '%.min.js') AS old_skipped FROM raw),
      kept AS (SELECT *, CASE WHEN change <> 'R' THEN change WHEN old_skipped THEN 'A' WHEN skipped THEN 'D' ELSE 'R' END AS kind
          FROM marked WHERE CASE WHEN change = 'R' THEN NOT (skipped AND old_skipped) ELSE NOT skipped END)
      SELECT p_partkey, kind AS change, CASE WHEN change = 'R' AND skipped THEN old_path ELSE path END AS path, CASE WHEN kind = 'R' THEN old_path END AS old_path, CASE WHEN kind <> 'D' THEN new_blob END AS new_blob, CAST(instr('DRMA', kind) AS BIGINT) AS phase FROM kept"""
    share = "CASE WHEN a + b = 0 THEN 0.0::DOUBLE ELSE a::DOUBLE / (a + b) END"
    q["import_only_lines"] = f"SELECT p_partkey, {_six(share)} AS fraction, a + b + c > 0 AND {share} >= 0.9 AS import_only FROM (SELECT p_partkey, p_partkey % 5 * 3 AS a, p_partkey % 3 AS b, p_partkey % 2 AS c FROM part)"
    q["as_of_commit"] = " UNION ALL ".join(f"SELECT '{r}' AS rev, count(*) AS id FROM orders WHERE o_orderdate <= DATE '{r}'" for r in REVS)
    strength = "1.0::DOUBLE - 0.75::DOUBLE * (1.0::DOUBLE - least(0.1::DOUBLE + 0.05::DOUBLE * ln(1 + n), 0.4))"
    q["blast_docs"] = _with(_COMMITS, _TOUCHED, _DRIFT, f"""
      mine AS (SELECT p.doc, coalesce(d.commits_behind, 0) AS n FROM dpair p LEFT JOIN drift d ON d.doc = p.doc
          AND d.code = p.code WHERE p.code = {FILE}),
      ranked AS (SELECT doc, n, CASE WHEN n > 0 THEN {strength} ELSE 0.25::DOUBLE END AS raw FROM mine)""") + f"SELECT doc, {_at('raw', 2)} AS rank, CASE WHEN n > 0 THEN 'doc_drift,structural' ELSE 'structural' END AS types, n AS commits_behind FROM ranked WHERE raw >= 0.2"
    return q
