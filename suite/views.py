"""The views of the star-schema tables in DuckDB SQL, as named CTEs.

``with_views`` puts the ones a statement mentions, and what those mention, in front of it.
"""

from __future__ import annotations

import re

from twintrail import constants as C

LANGUAGES = "['Java','JavaScript','Go','Python']"
FOLDERS = "['src','test','config','dto','migrations','src/main','specs','src/lib']"
ENDINGS = "['.java','.py','.js','.go','.sql']"


def _list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def file_type_sql(path: str) -> str:
    low = f"lower({path})"
    name = f"list_extract(string_split({low}, '/'), -1)"
    ext = f"regexp_extract({name}, '(\\.[^.]*)$', 1)"
    return (
        f"CASE WHEN {_any(low, C.TEST_PATH_PARTS)} THEN 'test'"
        f" WHEN {name} IN ({_list(C.CONFIG_FILE_NAMES)}) OR {ext} IN ({_list(C.CONFIG_EXTENSIONS)})"
        f" OR {_any(low, C.CONFIG_PATH_PARTS)} THEN 'config'"
        f" WHEN {_any(low, C.DATA_PATH_PARTS)} OR {ext} IN ({_list(C.DATA_EXTENSIONS)}) THEN 'data' ELSE 'logic' END"
    )


def known(service: str) -> str:
    return f"lower(trim(coalesce({service}, ''))) NOT IN ({_list(C.UNKNOWN_SERVICES)})"


def pair_type_sql(x: str, y: str) -> str:
    return (
        f"CASE WHEN {x} = 'test' AND {y} = 'test' THEN 'test' WHEN {x} = 'data' AND {y} = 'data' THEN 'data'"
        f" WHEN {x} = 'config' AND {y} = 'config' THEN 'config' WHEN ({x} = 'test') <> ({y} = 'test') THEN 'mixed'"
        " ELSE 'logic' END"
    )


def _metric_views(p: str, loc: str, f: str) -> dict[str, str]:
    """Reference SQL of the three metric tables over one fragment view."""
    k = "project, language"
    return {
        f"{p}_commits": f"SELECT {k}, clone_id, fragment_index, service, file_path, unnest(list_distinct(modified_commits)) AS c FROM {f}",
        f"{p}_comod": f"SELECT {k}, clone_id, c FROM {p}_commits GROUP BY ALL HAVING count(DISTINCT fragment_index) >= 2",
        f"{p}_cf": f"SELECT x.* FROM {p}_commits x SEMI JOIN {p}_comod USING (project, language, clone_id, c)",
        f"{p}_span": f"SELECT {k}, clone_id, count(DISTINCT service) FILTER (service <> '') AS span FROM {f} GROUP BY ALL",
        f"{p}_set_metrics": f"""
            SELECT f.project, f.language, f.clone_id, any_value(s.span) AS service_count,
              CAST(CASE WHEN any_value(s.span) >= 2 THEN count(*) FILTER (service <> '') ELSE 0 END AS BIGINT) AS cross_service_fragment_count,
              round_even(CASE WHEN any_value(s.span) >= 2 THEN count(*) FILTER (service <> '') ELSE 0 END / count(*)::DOUBLE, 6) AS cross_service_fragment_ratio,
              CAST(CASE WHEN any_value(s.span) >= 2 THEN sum(line_count) FILTER (service <> '') ELSE 0 END AS BIGINT) AS cross_service_line_count,
              CAST(CASE WHEN any_value(s.span) >= 2 THEN count(*) FILTER (service <> '') * sum(line_count) FILTER (service <> '') ELSE 0 END AS BIGINT) AS cross_service_scale,
              CAST(CASE WHEN any_value(s.span) >= 2 THEN count(*) ELSE 0 END AS BIGINT) AS cross_service_element_count,
              coalesce(any_value(m.cc), 0) AS comod_count, coalesce(any_value(m.fc), 0) AS comod_fragment_count,
              round_even(coalesce(any_value(m.fc), 0) / count(*)::DOUBLE, 6) AS comod_fragment_ratio
            FROM {f} f JOIN {p}_span s USING (project, language, clone_id)
            LEFT JOIN (SELECT {k}, clone_id, count(DISTINCT c) AS cc, count(DISTINCT fragment_index) AS fc FROM {p}_cf GROUP BY ALL) m
              USING (project, language, clone_id)
            GROUP BY f.project, f.language, f.clone_id""",
        f"{p}_islands": f"""
            SELECT {k}, service, file_path, min(start_line) AS s, max(end_line) AS e FROM (
              SELECT *, sum(CASE WHEN start_line > prev + 1 OR prev IS NULL THEN 1 ELSE 0 END) OVER w2 AS island FROM (
                SELECT *, max(end_line) OVER w1 AS prev FROM {f} WHERE service <> ''
                WINDOW w1 AS (PARTITION BY project, language, service, file_path ORDER BY start_line, end_line, clone_id, fragment_index
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
              WINDOW w2 AS (PARTITION BY project, language, service, file_path ORDER BY start_line, end_line, clone_id, fragment_index
                            ROWS UNBOUNDED PRECEDING))
            GROUP BY project, language, service, file_path, island""",
        f"{p}_union": f"SELECT {k}, service, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM {p}_islands GROUP BY ALL",
        f"{p}_others": f"""
            SELECT a.project, a.language, a.service, count(DISTINCT b.service) AS n
            FROM (SELECT DISTINCT {k}, clone_id, c, service FROM {p}_cf WHERE service <> '') a
            JOIN (SELECT DISTINCT {k}, clone_id, c, service FROM {p}_cf WHERE service <> '') b USING (project, language, clone_id, c)
            WHERE a.service <> b.service GROUP BY ALL""",
        f"{p}_service_metrics": f"""
            SELECT b.*, u.lines AS total_clone_line_count,
              CASE WHEN l.total_loc > 0 THEN round_even(u.lines / l.total_loc::DOUBLE, 6) ELSE 0.0 END AS roc,
              coalesce(m.n, 0) AS comod_count, coalesce(o.n, 0) AS comod_other_service_count
            FROM (SELECT f.project, f.language, f.service, count(DISTINCT clone_id) AS clone_set_count,
                    count(DISTINCT clone_id) FILTER (span >= 2) AS inter_clone_set_count,
                    round_even(sum(line_count) / count(*)::DOUBLE, 2) AS clone_avg_line_count,
                    count(DISTINCT file_path) AS clone_file_count
                  FROM {f} f JOIN {p}_span USING (project, language, clone_id) WHERE service <> '' GROUP BY ALL) b
            JOIN {p}_union u USING (project, language, service)
            LEFT JOIN {loc} l USING (project, language, service)
            LEFT JOIN (SELECT {k}, service, count(DISTINCT c) AS n FROM {p}_cf WHERE service <> '' GROUP BY ALL) m USING (project, language, service)
            LEFT JOIN {p}_others o USING (project, language, service)""",
        f"{p}_own": f"""
            SELECT {k}, file_path, coalesce(arg_min(service, (-n, service)) FILTER (service <> ''), '') AS own
            FROM (SELECT {k}, file_path, service, count(*) AS n FROM {f} GROUP BY ALL) GROUP BY ALL""",
        f"{p}_svc": f"SELECT DISTINCT {k}, clone_id, service AS other FROM {f} WHERE service <> ''",
        f"{p}_x": f"""
            SELECT DISTINCT t.project, t.language, t.file_path, t.clone_id, s.other FROM
              (SELECT DISTINCT {k}, file_path, clone_id FROM {f}) t JOIN {p}_own USING (project, language, file_path)
              JOIN {p}_svc s USING (project, language, clone_id) WHERE s.other <> own""",
        f"{p}_xc": f"""
            SELECT DISTINCT a.project, a.language, a.file_path, a.clone_id, a.c, b.service AS other FROM {p}_cf a
              JOIN {p}_own o USING (project, language, file_path)
              JOIN {p}_cf b ON a.project = b.project AND a.language = b.language AND a.clone_id = b.clone_id AND a.c = b.c
            WHERE b.service <> '' AND b.service <> o.own""",
        f"{p}_file_metrics": f"""
            SELECT f.project, f.language, f.file_path, any_value(own) AS service,
              coalesce(any_value(x.so), 0) AS sharing_service_count, coalesce(any_value(t.n), 0) AS total_service_count,
              coalesce(any_value(x.cs), 0) AS cross_service_clone_set_count,
              round_even(coalesce(any_value(x.cs), 0) / count(DISTINCT f.clone_id)::DOUBLE, 6) AS cross_service_clone_set_ratio,
              CASE WHEN coalesce(any_value(t.n), 0) > 0 THEN round_even(coalesce(any_value(x.so), 0) / any_value(t.n)::DOUBLE, 6) ELSE 0.0 END AS sharing_service_ratio,
              CAST(coalesce(any_value(xl.n), 0) AS BIGINT) AS cross_service_line_count,
              coalesce(any_value(xc.n), 0) AS cross_service_comod_count, coalesce(any_value(xc.s), 0) AS comod_shared_service_count
            FROM {f} f JOIN {p}_own USING (project, language, file_path)
            LEFT JOIN (SELECT {k}, file_path, count(DISTINCT other) AS so, count(DISTINCT clone_id) AS cs FROM {p}_x GROUP BY ALL) x USING (project, language, file_path)
            LEFT JOIN (SELECT {k}, count(DISTINCT service) AS n FROM {f} WHERE service <> '' GROUP BY ALL) t USING (project, language)
            LEFT JOIN (SELECT g.project, g.language, g.file_path, sum(line_count) AS n FROM {f} g
                       SEMI JOIN {p}_x USING (project, language, file_path, clone_id) GROUP BY ALL) xl USING (project, language, file_path)
            LEFT JOIN (SELECT {k}, file_path, count(DISTINCT (clone_id, c)) AS n, count(DISTINCT other) AS s FROM {p}_xc GROUP BY ALL) xc USING (project, language, file_path)
            GROUP BY f.project, f.language, f.file_path""",
    }


def _pair_view(f: str, limit: str) -> str:
    return f"""
        SELECT x.project, x.language, x.clone_id, x.fragment_index AS fragment_index_x, y.fragment_index AS fragment_index_y,
          x.file_path AS file_path_x, y.file_path AS file_path_y, x.file_id AS file_id_x, y.file_id AS file_id_y,
          x.service AS service_x, y.service AS service_y, x.file_type AS file_type_x, y.file_type AS file_type_y,
          x.start_line AS start_line_x, y.start_line AS start_line_y, x.end_line AS end_line_x, y.end_line AS end_line_y,
          list_sort(list_intersect(list_distinct(x.modified_commits), list_distinct(y.modified_commits))) AS common,
          len(list_intersect(list_distinct(x.modified_commits), list_distinct(y.modified_commits)))::INT AS comodification_count,
          CASE WHEN x.service = '' OR y.service = '' THEN '' WHEN x.service = y.service THEN 'intra' ELSE 'inter' END AS relation
        FROM {f} x JOIN {f} y ON x.project = y.project AND x.language = y.language AND x.clone_id = y.clone_id
          AND x.fragment_index < y.fragment_index
        {limit}"""


VIEWS: dict[str, str] = {
    "order_fragments": f"""
        SELECT *, start_line + line_count - 1 AS end_line, {file_type_sql('file_path')} AS file_type,
          len(modified_commits)::INT AS modified_count FROM (
        SELECT concat('shop', l_orderkey % 5) AS project, {LANGUAGES}[l_orderkey % 4 + 1] AS language,
          CAST(l_orderkey AS VARCHAR) AS clone_id,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS INT) AS fragment_index,
          concat('mod', l_partkey % 7, '/', {FOLDERS}[l_partkey % 8 + 1], '/f', l_partkey, {ENDINGS}[l_partkey % 5 + 1]) AS file_path,
          l_partkey AS file_id, CASE WHEN l_suppkey % 23 = 0 THEN '' ELSE concat('svc', l_suppkey % 20) END AS service,
          CAST((l_suppkey * 7 + l_linenumber * 13) % 400 + 1 AS INT) AS start_line, CAST(l_quantity AS INT) AS line_count,
          list_filter([CASE WHEN l_discount < 0.075 THEN concat('q', year(l_shipdate), '-', quarter(l_shipdate)) END,
                       CASE WHEN l_tax > 0.035 THEN concat('y', year(l_shipdate)) END], lambda c: c IS NOT NULL) AS modified_commits
        FROM lineitem)""",
    "order_loc": f"""
        SELECT concat('shop', l_orderkey % 5) AS project, {LANGUAGES}[l_orderkey % 4 + 1] AS language,
          concat('svc', l_suppkey % 20) AS service, count(*) AS file_count, CAST(sum(CAST(l_quantity AS BIGINT) * 3) AS BIGINT) AS total_loc
        FROM lineitem WHERE l_suppkey % 23 <> 0 GROUP BY ALL""",
    "text_files": f"""
        SELECT concat('acme.repo', doc_id % 3) AS project, lang AS language, doc_id AS file_id,
          concat(source, '/', {FOLDERS}[doc_id % 8 + 1], '/f', doc_id, {ENDINGS}[doc_id % 5 + 1]) AS file_path,
          CASE WHEN source = 'src19' THEN '' WHEN source = 'src18' THEN 'legacy18'
               WHEN doc_id % 8 = 1 THEN concat(source, '-test') ELSE source END AS service,
          source, text,
          CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END) END AS INT) AS loc
        FROM documents""",
    "text_loc": "SELECT project, language, service, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS total_loc FROM text_files WHERE service <> '' GROUP BY ALL",
    "contexts": """
        SELECT project, folder AS context, source AS service, 1 AS tier, 1 AS ordinal FROM context_folders WHERE source <> 'src18'
        UNION ALL SELECT project, concat(folder, '/test/'), concat(source, '-test'), 1, 2 FROM context_folders WHERE source <> 'src18'
        UNION ALL SELECT project, source, 'legacy18', 2, 1 FROM context_folders WHERE source = 'src18'""",
    "context_folders": """
        SELECT DISTINCT concat('acme.repo', doc_id % 3) AS project, source, CASE WHEN source = 'src19' THEN concat('moved/', source) ELSE source END AS folder FROM documents""",
    "file_history": """
        SELECT event_id // 10 AS file_id, list_sort(list(DISTINCT {'type': CASE WHEN event_type = 'signup' THEN 'added' ELSE 'modified' END,
          'commit': CASE WHEN event_type IN ('click', 'view') THEN concat('u', user_id % 40) ELSE concat('c', strftime(ts, '%Y%m%d')) END})) AS modification
        FROM events GROUP BY ALL""",
    "text_lines": """
        SELECT project, language, file_id, file_path, service, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM text_files""",
    "text_fragments": f"""
        SELECT t.*, list_sort(list_distinct(list_transform(list_filter(coalesce(h.modification, []), lambda m: m.type = 'modified'), lambda m: m."commit"))) AS modified_commits,
          len(list_distinct(list_transform(list_filter(coalesce(h.modification, []), lambda m: m.type = 'modified'), lambda m: m."commit")))::INT AS modified_count,
          h.modification FROM (
        SELECT project, language, md5(line) AS clone_id, file_id, file_path, service, line_no AS start_line, line_no AS end_line, 1 AS line_count,
          CAST(row_number() OVER (PARTITION BY project, language, md5(line) ORDER BY file_id, line_no) - 1 AS INT) AS fragment_index,
          count(*) OVER (PARTITION BY project, language, md5(line)) AS copies, {file_type_sql('file_path')} AS file_type
        FROM text_lines) t LEFT JOIN file_history h USING (file_id) WHERE copies > 1""",
    "text_pairs": _pair_view("text_fragments", ""),
    "all_text_pairs": _pair_view("text_fragments", ""),
    "order_pairs": _pair_view("order_fragments", ""),
    "codebases": """
        SELECT DISTINCT concat('acme.repo', doc_id % 3) AS project, lang AS language, CASE WHEN source IN ('src17', 'src19') THEN concat('moved/', source) ELSE source END AS context,
          source AS service, CAST(substr(source, 4) AS INT) AS ordinal FROM documents""",
    "placed": """
        SELECT f.*, (SELECT arg_min(context, ordinal) FROM codebases c WHERE c.project = f.project AND c.language = f.language AND starts_with(f.file_path, c.context)) AS codebase
        FROM text_fragments f""",
    "set_category": """
        SELECT project, language, clone_id, concat(CASE WHEN count(DISTINCT codebase) >= 2 THEN 'inter' ELSE 'within' END, '-',
          CASE WHEN bool_and(contains(lower(file_path), 'test')) THEN 'testing' WHEN NOT bool_or(contains(lower(file_path), 'test')) THEN 'production' ELSE 'mixed' END) AS category
        FROM placed GROUP BY ALL HAVING count(codebase) >= 2""",
    "located": "SELECT p.*, s.category FROM placed p JOIN set_category s USING (project, language, clone_id) WHERE codebase IS NOT NULL",
    "commit_list": """
        SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY hour_no) - 1 AS INT) AS ord FROM (
        SELECT project, committed_ts, touches, hour_no, md5(concat(project, '@', hour_no)) AS sha, CAST(1 + hour_no % 2 AS INT) AS n_parents,
          CASE WHEN hour_no % 24 = 0 THEN concat('v', hour_no // 24) END AS tag, concat('state', (hour_no // 7) % 4) AS state FROM (
        SELECT concat('acme.repo', user_id % 3) AS project, date_trunc('hour', ts) AS committed_ts, count(*) AS touches,
          CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour_no FROM events GROUP BY ALL))""",
    "chunks": """
        SELECT project, min(ord) AS from_n, max(ord) AS to_n, arg_min(sha, ord) AS from_sha, arg_max(sha, ord) AS to_sha, any_value(state) AS state FROM (
        SELECT *, sum(CASE WHEN prior IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ord) AS run FROM (
        SELECT *, lag(state) OVER (PARTITION BY project ORDER BY ord) AS prior FROM commit_list)) GROUP BY project, run""",
    "line_versions": """
        SELECT project, language, file_id, file_path, line_no AS i, line, k, (line_no + file_id + k * 3) % 11 <> 0 AS present,
          (line_no + file_id * 5 + k) % 13 = 0 AS changes, (line_no + file_id + (k + 1) * 3) % 11 <> 0 AS older
        FROM text_lines, range(4) r(k)""",
    "version_lines": "SELECT *, CAST(row_number() OVER (PARTITION BY file_id, k ORDER BY i) AS INT) AS line_no FROM line_versions WHERE present",
    "numbered": """
        SELECT *, sum(present::INT) OVER w AS cn, sum(older::INT) OVER w AS pn FROM line_versions WHERE k < 3
        WINDOW w AS (PARTITION BY file_id, k ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    "side_numbers": """
        SELECT project, file_path, k, list(DISTINCT cn::INT) FILTER (present AND (NOT older OR changes)) AS plus,
          list(DISTINCT pn::INT) FILTER (older AND (NOT present OR changes)) AS minus FROM numbered GROUP BY ALL""",
    "hunk_table": """
        SELECT project, concat('v', k) AS child_sha, concat('v', k + 1) AS parent_sha, file_path AS path,
          list_filter(coalesce(plus, []), lambda x: NOT list_contains(coalesce(minus, []), x)) AS inserted,
          list_filter(coalesce(minus, []), lambda x: NOT list_contains(coalesce(plus, []), x)) AS deleted,
          list_filter(coalesce(plus, []), lambda x: list_contains(coalesce(minus, []), x)) AS modified FROM side_numbers""",
    "changed_lines": """
        SELECT project, child_sha, parent_sha, path, unnest(inserted) AS line, 'added' AS kind FROM hunk_table
        UNION ALL SELECT project, child_sha, parent_sha, path, unnest(deleted), 'deleted' FROM hunk_table
        UNION ALL SELECT project, child_sha, parent_sha, path, unnest(modified), 'modified' FROM hunk_table""",
    "version_loc": "SELECT project, file_path AS path, k, count(*) FILTER (present) AS loc FROM line_versions GROUP BY ALL",
    "child_numbers": "SELECT h.project, child_sha, parent_sha, h.path, unnest(range(1, loc + 1)) AS n FROM hunk_table h JOIN version_loc v ON v.project = h.project AND v.path = h.path AND concat('v', v.k) = child_sha",
    "parent_numbers": "SELECT h.project, child_sha, parent_sha, h.path, unnest(range(1, loc + 1)) AS n FROM hunk_table h JOIN version_loc v ON v.project = h.project AND v.path = h.path AND concat('v', v.k) = parent_sha",
    "child_ranked": """
        SELECT c.*, row_number() OVER (PARTITION BY project, child_sha, path ORDER BY n) AS r FROM child_numbers c
        ANTI JOIN changed_lines l ON l.kind = 'added' AND l.project = c.project AND l.child_sha = c.child_sha AND l.path = c.path AND l.line = c.n""",
    "parent_ranked": """
        SELECT c.*, row_number() OVER (PARTITION BY project, child_sha, path ORDER BY n) AS r FROM parent_numbers c
        ANTI JOIN changed_lines l ON l.kind = 'deleted' AND l.project = c.project AND l.child_sha = c.child_sha AND l.path = c.path AND l.line = c.n""",
    "line_map": """
        SELECT a.project, a.child_sha, a.parent_sha, a.path, a.n::INT AS child_line, b.pn::INT AS parent_line FROM child_numbers a
        LEFT JOIN (SELECT c.project, c.child_sha, c.path, c.n, p.n AS pn FROM child_ranked c
          LEFT JOIN parent_ranked p USING (project, child_sha, path, r)) b USING (project, child_sha, path, n)""",
    "version_fragments": """
        SELECT f.project, f.language, f.clone_id, f.fragment_index, f.file_path AS path, v.k, concat('v', v.k) AS sha,
          min(v.line_no) AS s, max(v.line_no) AS e FROM text_fragments f
        JOIN version_lines v ON v.file_id = f.file_id AND v.i BETWEEN f.start_line AND f.start_line + 4 GROUP BY ALL""",
    "child_side": """
        SELECT f.project, f.language, f.clone_id, f.fragment_index, f.path, f.k, f.s, f.e, max(m.parent_line) FILTER (m.child_line = f.s) AS os,
          max(m.parent_line) FILTER (m.child_line = f.e) AS oe, count(m.parent_line) AS survivors,
          bool_or(l.line IS NOT NULL) AS touched
        FROM version_fragments f JOIN line_map m ON m.project = f.project AND m.path = f.path AND m.child_sha = f.sha AND m.child_line BETWEEN f.s AND f.e
        LEFT JOIN (SELECT DISTINCT project, child_sha, path, line FROM changed_lines WHERE kind <> 'deleted') l
          ON l.project = f.project AND l.child_sha = f.sha AND l.path = f.path AND l.line = m.child_line
        GROUP BY ALL""",
    "parent_side": """
        SELECT f.project, f.language, f.clone_id, f.fragment_index, f.path, f.k - 1 AS k, f.s, f.e,
          (SELECT m.child_line FROM line_map m WHERE m.project = f.project AND m.path = f.path AND m.parent_sha = f.sha AND m.parent_line = f.s) AS os,
          (SELECT m.child_line FROM line_map m WHERE m.project = f.project AND m.path = f.path AND m.parent_sha = f.sha AND m.parent_line = f.e) AS oe,
          EXISTS (SELECT 1 FROM changed_lines l WHERE l.kind <> 'added' AND l.project = f.project AND l.path = f.path AND l.parent_sha = f.sha AND l.line BETWEEN f.s AND f.e) AS touched
        FROM version_fragments f WHERE f.k > 0""",
    "transitions": """
        SELECT c.project, c.language, c.path, c.clone_id, c.fragment_index, c.k, c.s, c.e, m.p.clone_id AS parent_clone_id, m.p.fragment_index AS parent_index,
          CASE WHEN m.p IS NULL THEN 'added' WHEN c.touched OR m.p.touched THEN 'modified' ELSE 'stable' END AS type
        FROM child_side c LEFT JOIN (
          SELECT c.project, c.language, c.path, c.clone_id, c.fragment_index, c.k,
            arg_min({'clone_id': p.clone_id, 'fragment_index': p.fragment_index, 'touched': p.touched}, (p.clone_id, p.fragment_index)) AS p
          FROM child_side c JOIN parent_side p ON p.project = c.project AND p.language = c.language AND p.path = c.path AND p.k = c.k
          WHERE c.survivors > 0 AND ((c.os = p.s AND c.oe = p.e)
            OR (p.e - p.s < c.e - c.s AND p.os BETWEEN c.s AND c.e AND p.oe BETWEEN c.s AND c.e)
            OR (p.e - p.s > c.e - c.s AND c.os BETWEEN p.s AND p.e AND c.oe BETWEEN p.s AND p.e))
          GROUP BY ALL) m USING (project, language, path, clone_id, fragment_index, k)
        WHERE c.k < 3""",
    "run_files": f"""
        SELECT concat('acme.repo', o_custkey % 40) AS project,
          concat('repo', o_custkey % 40, '_', ['normal','TKS12','RNR05','RNR50'][o_orderkey % 4 + 1], '_', 30 + o_orderkey % 3 * 10, '_',
            CASE WHEN o_orderkey % 2 = 0 THEN 'filtered' ELSE 'nofilter' END, '_', CASE WHEN o_orderkey % 5 = 0 THEN 'clonepair' ELSE 'cloneset' END, '_',
            ['merge','tag','freq20'][o_orderkey % 3 + 1], '_', CASE WHEN o_orderkey % 13 = 0 THEN 'sd7_' ELSE '' END, strftime(o_orderdate, '%Y%m%d'),
            CASE WHEN o_orderkey % 7 = 0 THEN '_mac9' ELSE '' END, '_', {LANGUAGES}[o_custkey % 4 + 1], CASE WHEN o_orderkey % 17 = 0 THEN '_unknown' ELSE '' END, '.csv') AS name,
          CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 19 AS n_rows, o_orderkey AS k, o_custkey AS ck, strftime(o_orderdate, '%Y%m%d') AS day FROM orders""",
    "runs": f"""
        SELECT project, {LANGUAGES}[ck % 4 + 1] AS language, name, size, concat('repo', ck % 40) AS repo, ['normal','TKS12','RNR05','RNR50'][k % 4 + 1] AS detection,
          CAST(30 + k % 3 * 10 AS INT) AS min_tokens, CASE WHEN k % 2 = 0 THEN 'filtered' ELSE 'nofilter' END AS filter,
          CASE WHEN k % 5 = 0 THEN 'clonepair' ELSE 'cloneset' END AS comod, ['merge','tag','freq20'][k % 3 + 1] AS analysis,
          CASE WHEN k % 3 = 2 THEN 20 ELSE 50 END AS frequency, day AS date, CASE WHEN k % 13 = 0 THEN 7 ELSE -1 END AS search_depth,
          CASE WHEN k % 7 = 0 THEN 9 ELSE -1 END AS max_commits FROM run_files WHERE k % 17 <> 0 AND n_rows > 0""",
    "listing": """
        SELECT concat('acme.repo', p_partkey % 20) AS project, concat(['', 'docker/', 'deploy/', 'src/', 'vendor/', 'docs/'][p_partkey % 6 + 1],
          CASE WHEN p_partkey % 4 = 0 THEN concat('svc', p_partkey % 90, '/') ELSE '' END,
          ['docker-compose.yml', 'docker-compose.prod.yml', 'docker-compose.override.yml', 'Dockerfile', 'Dockerfile.dev', 'compose-dev.yaml',
           'Dockerfile.txt', 'main.py', 'Docker-Compose.test.yml'][(p_partkey // 6) % 9 + 1]) AS path, p_size % 5 <> 0 AS has_code FROM part""",
}
VIEWS.update(_metric_views("o", "order_loc", "order_fragments"))
VIEWS.update(_metric_views("t", "text_loc", "text_fragments"))


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in _mentioned(VIEWS[name]):
            if dep != name:
                add(dep)
        ordered.append(name)

    for name in _mentioned(sql):
        add(name)
    sql = sql.strip()
    if not ordered:
        return sql
    if sql.startswith("WITH "):
        sql = ", " + sql[5:]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in ordered) + "\n" + sql
