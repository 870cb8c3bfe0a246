"""Line and fragment history, commit choice, chunks, declaration lines, clone grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import _list
from twintrail import constants as C
from twintrail.functions import names
from twintrail.operators import chunks, clones, detector, history
from twintrail.sources import star_tables as T
from twintrail.streaming.incremental import missing_work

PAIR = "project, child_sha, parent_sha"


def _transitions(spark, d):
    return history.transitions(T.version_fragments(spark, d), T.version_pairs(spark, d), T.hunk_table(spark, d), T.version_files(spark, d))


def _joined(*columns):
    return [F.array_join(F.array_sort(c), ",").alias(c) for c in columns]


@query("w7_patch_line_numbers", """SELECT project, child_sha, parent_sha, path AS child_path, array_to_string(list_sort(inserted), ',') AS inserted_lines,
  array_to_string(list_sort(deleted), ',') AS deleted_lines, array_to_string(list_sort(modified), ',') AS modified_lines FROM hunk_table
  WHERE len(inserted) + len(deleted) + len(modified) > 0""")
def w7_patch_line_numbers(spark, d):
    parsed = history.parse_patches(T.patches(spark, d))
    some = F.size("inserted_lines") + F.size("deleted_lines") + F.size("modified_lines") > 0
    return parsed.filter(some).select("project", "child_sha", "parent_sha", "child_path", *_joined("inserted_lines", "deleted_lines", "modified_lines"))


@query("j7_line_map", "SELECT project, child_sha, parent_sha, path, child_line, parent_line FROM line_map")
def j7_line_map(spark, d):
    return history.line_map(T.hunk_table(spark, d), T.version_files(spark, d))


@query("j8_fragment_parents", "SELECT project, concat('v', k) AS child_sha, language, path, clone_id, fragment_index, parent_clone_id, parent_index FROM transitions WHERE parent_clone_id IS NOT NULL")
def j8_fragment_parents(spark, d):
    rows = _transitions(spark, d).filter("parent_clone_id IS NOT NULL")
    return rows.select("project", "child_sha", "language", "path", "clone_id", "fragment_index", "parent_clone_id", "parent_index")


@query("j9_surviving_lines", "SELECT project, concat('v', k) AS child_sha, concat('v', k + 1) AS parent_sha, language, clone_id, fragment_index, survivors FROM child_side WHERE k < 3")
def j9_surviving_lines(spark, d):
    return history.surviving_lines(T.version_fragments(spark, d), T.version_pairs(spark, d), T.hunk_table(spark, d), T.version_files(spark, d))


@query("h1_line_changes", f"SELECT {PAIR}, path, line, kind FROM changed_lines")
def h1_line_changes(spark, d):
    return history.line_changes(T.hunk_table(spark, d))


@query("h2_transitions", "SELECT project, concat('v', k) AS child_sha, language, path, clone_id, fragment_index, s AS start_line, e AS end_line, parent_clone_id, parent_index, type FROM transitions")
def h2_transitions(spark, d):
    return _transitions(spark, d).drop("parent_sha", "set_order")


@query("h3_pairs_with_changes", f"SELECT DISTINCT {PAIR} FROM hunk_table")
def h3_pairs_with_changes(spark, d):
    return history.pairs_with_changes(T.hunk_table(spark, d), T.version_files(spark, d))


@query("h4_adjacent_commits", "SELECT project, ord AS step, sha AS child_sha, lead(sha) OVER (PARTITION BY project ORDER BY ord) AS parent_sha FROM commit_list QUALIFY parent_sha IS NOT NULL")
def h4_adjacent_commits(spark, d):
    return chunks.adjacent_commits(T.commit_list(spark, d))


_KEY = "project, language, clone_id, fragment_index"
_STEP = """onward{n} AS (SELECT t.project, t.language, t.parent_clone_id AS clone_id, t.parent_index AS fragment_index,
  arg_max({{'c': m.hc, 'i': m.hi}}, (t.clone_id, t.fragment_index)) AS h FROM transitions t JOIN m{n} m USING (project, language, clone_id, fragment_index)
  WHERE t.k = {n} AND type <> 'added' GROUP BY ALL),
  m{m} AS (SELECT project, language, clone_id, fragment_index, h.c AS hc, h.i AS hi FROM onward{n}
    UNION ALL SELECT * FROM m{n} WHERE (project, language) NOT IN (SELECT (project, language) FROM transitions WHERE k = {n})),"""


@query("h5_head_history", """WITH m0 AS (SELECT project, language, clone_id, fragment_index, clone_id AS hc, fragment_index AS hi FROM version_fragments WHERE k = 0), """
  + _STEP.format(n=0, m=1) + _STEP.format(n=1, m=2) + """
  logs AS (SELECT t.project, t.language, m.hc, m.hi, t.k, t.type FROM transitions t JOIN m0 m USING (project, language, clone_id, fragment_index) WHERE t.k = 0 AND type <> 'stable'
    UNION ALL SELECT t.project, t.language, m.hc, m.hi, t.k, t.type FROM transitions t JOIN m1 m USING (project, language, clone_id, fragment_index) WHERE t.k = 1 AND type <> 'stable'
    UNION ALL SELECT t.project, t.language, m.hc, m.hi, t.k, t.type FROM transitions t JOIN m2 m USING (project, language, clone_id, fragment_index) WHERE t.k = 2 AND type <> 'stable')
  SELECT v.project, v.language, v.clone_id, v.fragment_index, coalesce(l.entries, '') AS entries FROM version_fragments v LEFT JOIN
  (SELECT project, language, hc, hi, string_agg(concat(type, '@v', k), ',' ORDER BY k, type) AS entries FROM logs GROUP BY ALL) l
  ON l.project = v.project AND l.language = v.language AND l.hc = v.clone_id AND l.hi = v.fragment_index WHERE v.k = 0""")
def h5_head_history(spark, d):
    head = T.version_fragments(spark, d).filter("sha = 'v0'").select("project", "language", "clone_id", "fragment_index")
    moves = _transitions(spark, d).withColumn("step", F.substring("child_sha", 2, 9).cast("int"))
    out = history.head_history(head, moves, T.VERSIONS - 1)
    entries = F.transform("modification", lambda m: F.concat(m["type"], F.lit("@"), m["commit"]))
    return out.select("project", "language", "clone_id", "fragment_index", F.array_join(entries, ",").alias("entries"))


@query("h6_head_state", "SELECT project, language, clone_id, fragment_index, path AS file_path, s AS start_line, e AS end_line, 0 AS entries FROM version_fragments WHERE k = 0")
def h6_head_state(spark, d):
    head = history.head_state(T.version_fragments(spark, d).filter("sha = 'v0'"))
    return head.select("project", "language", "clone_id", "fragment_index", "file_path", "start_line", "end_line", F.size("modification").alias("entries"))


# --- commits and chunks ------------------------------------------------------------------


@query("w1_state_chunks", "SELECT * FROM chunks")
def w1_state_chunks(spark, d):
    return chunks.state_chunks(T.commit_list(spark, d).select("project", "ord", "sha", "state"))


# Every chunk is read; some belong to a project that has no commit.
_SPARSE = "SELECT CASE WHEN from_n % 2 = 0 THEN project ELSE concat(project, '-moved') END AS project, from_n, state FROM chunks"


@query("w2_state_as_of", f"""SELECT c.project, c.ord, c.sha, (SELECT arg_max(s.state, s.from_n) FROM ({_SPARSE}) s WHERE s.project = c.project AND s.from_n <= c.ord) AS state FROM commit_list c""")
def w2_state_as_of(spark, d):
    commits = T.commit_list(spark, d)
    starts = w1_state_chunks(spark, d).selectExpr("CASE WHEN from_n % 2 = 0 THEN project ELSE concat(project, '-moved') END AS project", "from_n", "state")
    return chunks.state_as_of(commits.select("project", "ord", "sha"), starts)


@query("j14_chunk_of_commit", "SELECT c.project, c.ord, c.sha, k.from_n, k.to_n FROM commit_list c LEFT JOIN (SELECT CASE WHEN from_n % 3 <> 0 THEN project ELSE concat(project, '-moved') END AS project, from_n, to_n FROM chunks) k ON k.project = c.project AND c.ord BETWEEN from_n AND to_n")
def j14_chunk_of_commit(spark, d):
    held = w1_state_chunks(spark, d).withColumn("project", F.expr("CASE WHEN from_n % 3 <> 0 THEN project ELSE concat(project, '-moved') END"))
    return chunks.chunk_of_commit(T.commit_list(spark, d).select("project", "ord", "sha"), held)


@query("a46_grouped_chunks", """SELECT project, state, string_agg(concat(from_n, '-', to_n), ',' ORDER BY from_n) AS ranges, CAST(sum(to_n - from_n + 1) AS BIGINT) AS commits FROM chunks GROUP BY ALL""")
def a46_grouped_chunks(spark, d):
    return chunks.group_chunks(w1_state_chunks(spark, d))


@query("s11_latest_chunk", "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY project ORDER BY from_n DESC) = 1")
def s11_latest_chunk(spark, d):
    return chunks.chunk_choice(w1_state_chunks(spark, d), "latest")


@query("a45_weighted_errors", """SELECT CAST(sum(n) AS BIGINT) AS commits, round_even(CAST(sum(n * missed) AS BIGINT) / CAST(sum(n) AS BIGINT), 6) AS missed, round_even(CAST(sum(n * wrong) AS BIGINT) / CAST(sum(n) AS BIGINT), 6) AS wrong
  FROM (SELECT to_n - from_n + 1 AS n, from_n % 5 AS missed, to_n % 3 AS wrong FROM chunks)""")
def a45_weighted_errors(spark, d):
    rows = w1_state_chunks(spark, d).selectExpr("from_n", "to_n", "from_n % 5 AS missed", "to_n % 3 AS wrong")
    return detector.weighted_errors(rows, "missed", "wrong")


_CUT = "committed_ts <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 9 HOUR"


@query("k8_merge_commits", f"SELECT project, sha, committed_ts FROM commit_list WHERE n_parents >= 2 AND {_CUT} QUALIFY row_number() OVER (PARTITION BY project ORDER BY committed_ts DESC) <= 20")
def k8_merge_commits(spark, d):
    return chunks.merge_commits(T.commit_list(spark, d), "2024-01-20 12:00:00", depth=30, cap=20).select("project", "sha", "committed_ts")


@query("k8_tagged_commits", "SELECT project, sha, tag FROM commit_list WHERE tag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY committed_ts DESC) <= 10")
def k8_tagged_commits(spark, d):
    return chunks.tagged_commits(T.commit_list(spark, d), cap=10).select("project", "sha", "tag")


@query("w8_every_nth_commit", f"SELECT project, sha FROM commit_list WHERE {_CUT} QUALIFY (row_number() OVER (PARTITION BY project ORDER BY committed_ts DESC) - 1) % 25 = 0")
def w8_every_nth_commit(spark, d):
    return chunks.every_nth_commit(T.commit_list(spark, d), 25, "2024-01-20 12:00:00").select("project", "sha")


@query("f33_before_cutoff", f"SELECT project, sha, {_CUT} AS kept FROM commit_list")
def f33_before_cutoff(spark, d):
    return T.commit_list(spark, d).select("project", "sha", chunks.before_cutoff(F.col("committed_ts"), "2024-01-20 12:00:00").alias("kept"))


@query("incremental_missing_work", "SELECT project, sha FROM commit_list WHERE hour_no % 3 <> 0")
def incremental_missing_work(spark, d):
    wanted = T.commit_list(spark, d).select("project", "sha", "hour_no")
    return missing_work(wanted, wanted.filter("hour_no % 3 = 0"), ["project", "sha"]).select("project", "sha")


# --- declaration lines ---------------------------------------------------------------------

_NAMES = "['Java','Python','JavaScript','Go','PHP','TypeScript','Rust','C++','C#','Ruby','Scala','C','Kotlin','Swift']"
_REQUIRE = "(regexp_matches(t, '^(?:const|let|var)\\s+[\\w${}\\[\\],\\s:]+\\s*=\\s*require\\s*\\(') OR regexp_matches(t, '^require\\s*\\('))"
_EXPORT = "regexp_matches(t, '^export\\b.+\\bfrom\\b')"
_DECLARATIONS = f"""raw AS MATERIALIZED (SELECT *, CASE
    WHEN (i - 1 + doc_id) % 11 = 0 THEN concat('import ', x) WHEN (i - 1 + doc_id) % 11 = 2 THEN 'import (' WHEN (i - 1 + doc_id) % 11 = 4 THEN ')'
    WHEN (i - 1 + doc_id) % 11 = 5 THEN concat('from lib import (', x) WHEN (i - 1 + doc_id) % 11 = 7 THEN concat('const a = require(', x)
    WHEN (i - 1 + doc_id) % 11 = 8 THEN concat(x, ');') WHEN (i - 1 + doc_id) % 11 = 9 THEN concat('use ', x) ELSE x END AS line FROM (
  SELECT doc_id, {_NAMES}[doc_id % 14 + 1] AS lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
cut AS MATERIALIZED (SELECT *, trim(line, ' ') AS t FROM raw),
delta AS MATERIALIZED (SELECT *, length(t) - length(replace(t, '(', '')) - length(t) + length(replace(t, ')', '')) AS dl FROM cut),
cum AS MATERIALIZED (SELECT *, sum(dl) OVER (PARTITION BY doc_id ORDER BY i) AS cs,
  (lang = 'Python' AND starts_with(t, 'from ') AND contains(t, ' import ') AND dl > 0) OR (lang = 'Go' AND starts_with(t, 'import (') AND NOT ends_with(t, ')'))
   OR (lang IN ('JavaScript', 'TypeScript') AND {_REQUIRE} AND NOT starts_with(t, 'import ') AND NOT {_EXPORT} AND NOT ends_with(t, ';')) AS opens FROM delta),
closes AS MATERIALIZED (SELECT o.doc_id, o.i AS a, coalesce(min(c.i), 1000000) AS b FROM cum o LEFT JOIN cum c ON c.doc_id = o.doc_id AND c.i > o.i
  AND CASE WHEN o.lang = 'Python' THEN c.cs <= o.cs - o.dl WHEN o.lang = 'Go' THEN starts_with(c.t, ')') ELSE ends_with(c.t, ';') END WHERE o.opens GROUP BY ALL),
inside AS MATERIALIZED (SELECT DISTINCT l.doc_id, l.i FROM cum l JOIN closes k ON k.doc_id = l.doc_id AND l.i > k.a AND l.i <= k.b),
flags AS MATERIALIZED (SELECT l.*, n.i IS NOT NULL OR coalesce(CASE WHEN lang = 'Python' THEN starts_with(t, 'import ') OR (starts_with(t, 'from ') AND contains(t, ' import '))
  WHEN lang IN ('Go', 'Java', 'Kotlin', 'Scala') THEN starts_with(t, 'package ') OR starts_with(t, 'import ')
  WHEN lang IN ('JavaScript', 'TypeScript') THEN starts_with(t, 'import ') OR {_EXPORT} OR {_REQUIRE}
  WHEN lang IN ('C', 'C++') THEN starts_with(t, '#include ') OR starts_with(t, 'import ') WHEN lang = 'Rust' THEN starts_with(t, 'use ') OR starts_with(t, 'import ')
  WHEN lang = 'PHP' THEN starts_with(t, 'use ') OR starts_with(t, 'require ') OR starts_with(t, 'include ') OR starts_with(t, 'import ')
  WHEN lang = 'Ruby' THEN starts_with(t, 'require ') OR starts_with(t, 'load ') ELSE starts_with(t, 'import ') END, false) AS d FROM cum l LEFT JOIN inside n USING (doc_id, i))"""


@query("f40_declaration_lines", f"""WITH {_DECLARATIONS} SELECT lang AS language, doc_id AS file_id, CAST(i AS INT) AS line_no, d AS is_declaration,
  md5(CASE WHEN d THEN concat(CASE WHEN lang IN ('Python', 'Ruby') THEN '# ' ELSE '// ' END, line) ELSE line END) AS digest FROM flags""")
def f40_declaration_lines(spark, d):
    rows = clones.declaration_lines(T.source_files(spark, d))
    return rows.select("language", "file_id", "line_no", "is_declaration", F.md5("masked_line").alias("digest"))


# --- clone grouping -------------------------------------------------------------------------

_K = 50


def _grouping_sql(tokens: str, k: int) -> str:
    """Token classes by their text, linked where every copy agrees on the neighbour."""
    return f"""WITH {tokens},
seq AS MATERIALIZED (SELECT project, language, file_id, list(tok ORDER BY line_no, n) AS words, list(line_no ORDER BY line_no, n) AS ln FROM toks GROUP BY ALL HAVING count(*) >= {k}),
win AS MATERIALIZED (SELECT project, language, file_id, p - 1 AS pos, md5(array_to_string(words[p : p + {k - 1}], ' ')) AS h, ln[p] AS l1, ln[p + {k - 1}] AS l2
  FROM (SELECT *, unnest(range(1, len(words) - {k} + 2)) AS p FROM seq)),
nb AS MATERIALIZED (SELECT *, lag(h) OVER w AS b, lead(h) OVER w AS a FROM win WINDOW w AS (PARTITION BY project, language, file_id ORDER BY pos)),
cls AS MATERIALIZED (SELECT project, language, h, CASE WHEN min(b) = max(b) AND count(b) = count(*) THEN min(b) END AS b1, CASE WHEN min(a) = max(a) AND count(a) = count(*) THEN min(a) END AS a1
  FROM nb GROUP BY ALL HAVING count(*) >= 2),
lnk AS MATERIALIZED (SELECT c.project, c.language, c.h, coalesce(p.a1 = c.h, false) AS joins FROM cls c LEFT JOIN cls p ON p.project = c.project AND p.language = c.language AND p.h = c.b1),
runs0 AS MATERIALIZED (SELECT n.*, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY n.project, n.language, n.file_id ORDER BY pos) AS run FROM nb n JOIN lnk USING (project, language, h)),
frag AS MATERIALIZED (SELECT project, language, file_id, arg_min(h, pos) AS clone_id, CAST(min(pos) AS INT) AS start_token, CAST(max(pos) + {k - 1} AS INT) AS end_token,
  CAST(min(l1) AS INT) AS start_line, CAST(max(l2) AS INT) AS end_line FROM runs0 GROUP BY project, language, file_id, run)"""


_PLAIN = """toks AS MATERIALIZED (SELECT project, language, file_id, line_no, unnest(w) AS tok, generate_subscripts(w, 1) AS n FROM (
  SELECT *, regexp_extract_all(regexp_replace(line, '[0-9]+', '0', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]') AS w FROM text_lines))"""
_GROUPED = _grouping_sql(_PLAIN, _K)


# A set is named by its first member, so the comparison does not depend on the digest.
_NAMED = """SELECT project, language, file_id, start_token, end_token, start_line, end_line, end_token - start_token + 1 AS token_count,
  min(file_id) OVER w AS first_file, CAST(min(CASE WHEN file_id = m THEN start_token END) OVER w AS INT) AS first_token
  FROM (SELECT *, min(file_id) OVER (PARTITION BY project, language, clone_id) AS m FROM frag) WINDOW w AS (PARTITION BY project, language, clone_id)"""


def _named(found):
    keys = ["project", "language", "clone_id"]
    first = F.min(F.struct("file_id", "start_token"))
    names = found.groupBy(*keys).agg(first.alias("m")).select(*keys, F.col("m.file_id").alias("first_file"), F.col("m.start_token").alias("first_token"))
    return found.join(names, keys).drop("clone_id")


@query("a49_clone_grouping", f"{_GROUPED} {_NAMED}")
def a49_clone_grouping(spark, d):
    return _named(clones.clone_fragments(T.text_files(spark, d), _K, mask=False))


@query("a49_clone_set_index", f"{_GROUPED} SELECT project, language, file_id, start_token, CAST(row_number() OVER (PARTITION BY project, language, clone_id ORDER BY file_id, start_token) - 1 AS INT) AS fragment_index FROM frag")
def a49_clone_set_index(spark, d):
    found = clones.clone_fragments(T.text_files(spark, d), _K, mask=False)
    return clones.index_fragments(found).select("project", "language", "file_id", "start_token", "fragment_index")


_MASKED = _DECLARATIONS + """, toks AS MATERIALIZED (SELECT project, language, file_id, line_no, unnest(w) AS tok, generate_subscripts(w, 1) AS n FROM (
  SELECT concat('acme.repo', doc_id % 3) AS project, lang AS language, doc_id AS file_id, i AS line_no,
    regexp_extract_all(regexp_replace(line, '[0-9]+', '0', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]') AS w FROM flags WHERE NOT d))"""


@query("a49_clone_grouping_masked", _grouping_sql(_MASKED, 30) + " " + _NAMED)
def a49_clone_grouping_masked(spark, d):
    return _named(clones.clone_fragments(T.source_files(spark, d), 30))


# --- detection tables ------------------------------------------------------------------------

_BASE = "list_extract(string_split(path, '/'), -1)"
_FOLDER_HIT = "CASE " + " ".join(f"WHEN contains(f, '{w}') THEN '{chr(ord('a') + i)}'" for i, w in enumerate(C.COMPOSE_FOLDER_ORDER)) + " END"
_RANK = (
    f"CASE WHEN lower({_BASE}) IN ({_list(C.COMPOSE_DEFAULT_NAMES)}) THEN 0 WHEN "
    + " OR ".join(f"contains(lower({_BASE}), '{w}')" for w in C.COMPOSE_AFFIX_REJECTED)
    + " THEN NULL "
    + " ".join(f"WHEN contains(lower({_BASE}), '{w}') THEN {i + 1}" for i, w in enumerate(C.COMPOSE_AFFIX_ORDER))
    + " END"
)
_COMPOSE = f"""SELECT project, path, array_to_string(codes, '') AS code, {_RANK} AS rank FROM (
  SELECT *, list_transform(string_split(lower(path), '/')[1:-2], lambda f: {_FOLDER_HIT}) AS codes FROM listing WHERE regexp_matches({_BASE}, 'compose.*\\.ya?ml$'))
  WHERE len(list_filter(codes, lambda c: c IS NULL)) = 0"""


@query("f35_compose_ranks", f"SELECT project, path, code, CAST(rank AS INT) AS rank FROM ({_COMPOSE})")
def f35_compose_ranks(spark, d):
    rows = T.file_listing(spark, d).filter(names.is_compose_file("path"))
    return rows.select("project", "path", names.compose_path_code("path").alias("code"), names.compose_name_rank("path").alias("rank")).filter("code IS NOT NULL")


@query("k10_best_compose_file", f"SELECT project, arg_min(path, (code, rank, length(path), path)) AS compose_file FROM ({_COMPOSE}) WHERE rank IS NOT NULL GROUP BY ALL")
def k10_best_compose_file(spark, d):
    return detector.best_compose_file(T.file_listing(spark, d))


_DOCKER = f"""SELECT * FROM listing WHERE contains({_BASE}, 'Dockerfile') AND NOT ends_with(path, '.txt') AND NOT ends_with(path, '.sh') AND NOT ends_with(path, '.ps1') AND NOT ends_with(path, '.nanowin')
  AND NOT contains(path, 'vendor') AND NOT contains(path, 'external') AND NOT contains(path, 'example') AND NOT contains(path, 'demo')"""


@query("f36_dockerfiles", f"SELECT project, path, has_code FROM ({_DOCKER})")
def f36_dockerfiles(spark, d):
    return detector.dockerfiles(T.file_listing(spark, d))


@query("k11_shortest_siblings", f"""SELECT project, regexp_replace(path, '/?[^/]*$', '') AS folder, arg_min(path, (length(path), path)) AS path FROM ({_DOCKER}) GROUP BY ALL""")
def k11_shortest_siblings(spark, d):
    return detector.shortest_siblings(detector.dockerfiles(T.file_listing(spark, d)))


_C = """SELECT concat('acme.repo', c_custkey % 20) AS project, c_custkey % 20 AS r, c_custkey // 20 AS u, c_custkey AS k,
  CASE WHEN c_custkey % 3 = 0 THEN concat('service-unit', c_custkey // 20, 'x') ELSE concat('unit', c_custkey // 20, '-service') END AS container_name,
  CASE WHEN c_custkey % 4 <> 3 THEN concat('registry/acme-repo', c_custkey % 20, '-unit', c_custkey // 20 + c_custkey % 2) END AS image,
  CASE WHEN c_custkey % 5 = 0 THEN concat('services/unit', c_custkey // 20, '/Dockerfile') END AS build_path, c_custkey % 10 <> 5 AS is_local FROM customer"""


@query("j17_detected_services", f"""WITH cont AS ({_C}), docker AS (SELECT concat('acme.repo', p_partkey % 20) AS project,
    concat('services/unit', p_partkey // 20, CASE WHEN p_partkey % 3 = 0 THEN '/Dockerfile.dev' ELSE '/Dockerfile' END) AS path, p_size % 5 <> 0 AS has_code FROM part),
  built AS (SELECT c.project, container_name, build_path AS dockerfile, CASE WHEN d.path IS NULL THEN 2 ELSE 1 END AS confidence FROM cont c LEFT JOIN docker d ON d.project = c.project AND d.path = build_path
    WHERE build_path IS NOT NULL AND is_local AND (d.path IS NULL OR d.has_code)),
  open AS (SELECT *, lower(regexp_replace(path, '/?[^/]*$', '')) AS folder FROM docker WHERE (project, path) NOT IN (SELECT (project, dockerfile) FROM built WHERE confidence = 1)
    QUALIFY row_number() OVER (PARTITION BY project, regexp_replace(path, '/?[^/]*$', '') ORDER BY length(path), path) = 1),
  cand AS (SELECT project, container_name, length(image) AS size, 4 AS c, unnest(list_distinct([concat('acme-repo', r, '-unit', u + k % 2), concat('repo', r, '-unit', u + k % 2), concat('acme-unit', u + k % 2), concat('unit', u + k % 2)])) AS name
    FROM cont WHERE image IS NOT NULL AND NOT (build_path IS NOT NULL AND is_local)
    UNION ALL SELECT project, container_name, length(image), 8, unnest(CASE WHEN k % 3 = 0 THEN [container_name, concat('unit', u, 'x')] ELSE [container_name, concat('unit', u)] END) FROM cont WHERE image IS NOT NULL AND NOT (build_path IS NOT NULL AND is_local)),
  one AS (SELECT c.project, container_name, size, c, name, min(path) AS path FROM cand c JOIN open o ON o.project = c.project AND contains(o.folder, c.name) GROUP BY ALL HAVING count(*) = 1 AND bool_and(has_code)),
  top AS (SELECT project, container_name, size, arg_min(path, (c, -length(name), name, path)) AS path, min(c) AS c FROM one GROUP BY ALL)
  SELECT * FROM built UNION ALL (SELECT project, container_name, path, c FROM top QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY size DESC, container_name) = 1)""")
def j17_detected_services(spark, d):
    return detector.detect_services(T.containers(spark, d), T.service_dockerfiles(spark, d))


@query("a47_language_extensions", """SELECT language, string_agg(DISTINCT ext, ',' ORDER BY ext) AS extensions, count(DISTINCT ext) AS n FROM
  (SELECT language, regexp_extract(file_path, '[^/]\\.([^./]+)$', 1) AS ext FROM order_fragments) GROUP BY ALL""")
def a47_language_extensions(spark, d):
    return detector.language_extensions(T.order_fragments(spark, d), ["Java", "JavaScript", "Go", "Python"])
