"""Path, category, URL and language functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from twintrail import constants as C
from twintrail.functions.numbers import _col


def _drop_prefix(path: Column, prefix: str | None) -> Column:
    if not prefix:
        return path
    full = prefix.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(full), F.substring(path, len(full) + 1, 1 << 30)).otherwise(path)


def _drop_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def _slashes(path) -> Column:
    return F.replace(F.trim(F.coalesce(_col(path), F.lit(""))), F.lit("\\"), F.lit("/"))


def file_path(path, project_dir: str | None = None) -> Column:
    """Repository-relative path of a fragment row."""
    return _drop_prefix(_drop_dot_slash(_slashes(path)), project_dir)


def repo_path(path, repo_dir: str | None = None) -> Column:
    """Repository-relative path used for service resolution: no outer slashes."""
    return F.btrim(_drop_dot_slash(_drop_prefix(_slashes(path), repo_dir)), F.lit("/"))


def drop_leading_slash(path) -> Column:
    return F.regexp_replace(_col(path), "^/", "")


def base_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(name) -> Column:
    """Last extension with its dot, '' when the name has none."""
    return F.regexp_extract(_col(name), r"(\.[^.]*)$", 1)


def _words(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


_TEST = _words(C.TEST_PATH_PARTS)
_CONFIG = (
    f"(?:^|/)(?:{_words(C.CONFIG_FILE_NAMES)})$|(?:{_words(C.CONFIG_EXTENSIONS)})$|{_words(C.CONFIG_PATH_PARTS)}"
)
_DATA = f"{_words(C.DATA_PATH_PARTS)}|(?:{_words(C.DATA_EXTENSIONS)})$"


def file_type(path) -> Column:
    """test, config, data or logic from the path alone; the first hit wins."""
    lower = F.replace(F.lower(F.coalesce(_col(path), F.lit(""))), F.lit("\\"), F.lit("/"))
    # One compiled pattern per category: a chain of contains() would lower the path each time.
    return F.when(lower.rlike(_TEST), "test").when(lower.rlike(_CONFIG), "config").when(lower.rlike(_DATA), "data").otherwise("logic")


def is_test_path(path) -> Column:
    """Substring test used by the taxonomy; 'latest' counts as a hit."""
    return F.lower(_col(path)).contains("test")


def test_name_false_positive(path) -> Column:
    return _col(path).rlike("(?i)contest|latest|attest")


def loc(text) -> Column:
    """Number of lines; a final newline does not open another line."""
    t = F.coalesce(_col(text), F.lit(""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(newlines + F.when(t.endswith("\n"), 0).otherwise(1)).cast("int")


def project_from_url(url) -> Column:
    """owner.repo"""
    parts = F.split(F.rtrim(_col(url), F.lit("/")), "/")
    return F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))


def repo_from_url(url) -> Column:
    return F.element_at(F.split(F.rtrim(_col(url), F.lit("/")), "/"), -1)


def service_relative_path(path, service) -> Column:
    """Path behind the service's short name, from src/ on where there is one."""
    p, s = F.coalesce(_col(path), F.lit("")), F.coalesce(_col(service), F.lit(""))
    short = base_name(s)
    at = F.position(short, p)
    behind = F.ltrim(F.substr(p, at + F.length(short)), F.lit("/"))
    src = F.position(F.lit("/src/"), behind)
    inner = F.when(src > 0, F.substr(behind, src + F.lit(1))).otherwise(behind)
    return (
        F.when((p == "") | (s == ""), p)
        .when((short != "") & (at > 0), inner)
        .otherwise(base_name(p))
    )


def detector_language(language) -> Column:
    out = F.lower(_col(language))
    for name, alias in C.DETECTOR_LANGUAGE_ALIASES.items():
        out = F.when(_col(language) == name, alias).otherwise(out)
    return out


def base_url(project, summary_url=None, services_url=None) -> Column:
    """Repository URL: the summary's, else the service file's, else built from owner.repo."""
    built = F.concat(F.lit("https://github.com/"), F.regexp_replace(_col(project), r"^([^.]*)\.", "$1/"))
    known = [F.nullif(_col(u), F.lit("")) for u in (summary_url, services_url) if u is not None]
    return F.coalesce(*known, built)


def file_link(base, path, ref, start_line, end_line) -> Column:
    """Permalink to a file at a ref with a line anchor; a missing ref reads 'master'."""
    start, end = _col(start_line), _col(end_line)
    anchor = (
        F.when(start.isNull(), "")
        .when(end.isNull() | (end == start), F.concat(F.lit("#L"), start))
        .otherwise(F.concat(F.lit("#L"), start, F.lit("-L"), end))
    )
    clean = F.ltrim(_col(path), F.lit("/"))
    at = F.coalesce(F.nullif(_col(ref), F.lit("")), F.lit("master"))
    return F.concat(_col(base), F.lit("/blob/"), at, F.lit("/"), clean, anchor)


def commit_link(base, commit) -> Column:
    return F.concat(_col(base), F.lit("/commit/"), _col(commit))


def diff_link(base, commit, path) -> Column:
    anchor = F.sha2(F.ltrim(_col(path), F.lit("/")), 256)
    return F.concat(commit_link(base, commit), F.lit("#diff-"), anchor)
