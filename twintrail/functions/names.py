"""Name rules for containers, container files and compose files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twintrail import constants as C
from twintrail.functions.numbers import _col
from twintrail.functions.paths import base_name


def _cut(text: Column, word: Column, before: bool = False) -> Column:
    """Remove every 'word' with the separator next to it."""
    quoted = F.concat(F.lit("\\Q"), word, F.lit("\\E"))
    pattern = F.concat(F.lit("[-_/]"), quoted) if before else F.concat(quoted, F.lit("[-_/]"))
    return F.regexp_replace(text, pattern, F.lit(""))


def names_from_image(image, user, repo) -> Column:
    """Service names an image name may stand for, without registry, user and repository."""
    low, u, r = F.lower(_col(image)), F.lower(_col(user)), F.lower(_col(repo))
    rest = F.when(low.contains("/"), F.regexp_replace(low, "^[^/]*/", "")).otherwise(low)
    has_user, has_repo = F.contains(rest, u), F.contains(rest, r)
    options = F.array(
        rest,
        F.when(has_user, _cut(rest, u)),
        F.when(has_repo, _cut(rest, r)),
        F.when(has_user & has_repo, _cut(_cut(rest, r), u)),
    )
    return F.array_distinct(F.array_compact(options))


def names_from_container(name) -> Column:
    """The container name and, where it carries a service affix, the name without it."""
    low = F.lower(_col(name))
    bare = F.lit(None).cast("string")
    for affix in reversed(C.SERVICE_AFFIXES):
        bare = F.when(low.endswith(affix), _cut(low, F.lit(affix), before=True)).otherwise(bare)
    for affix in reversed(C.SERVICE_AFFIXES):
        bare = F.when(low.startswith(affix), _cut(low, F.lit(affix))).otherwise(bare)
    return F.array_distinct(F.array_compact(F.array(low, bare)))


def _first_hit(text: Column, words: list[str]) -> Column:
    """Index of the first word in the list that the text contains, NULL for none."""
    return reduce(
        lambda acc, iw: F.when(text.contains(iw[1]), F.lit(iw[0])).otherwise(acc),
        reversed(list(enumerate(words))),
        F.lit(None).cast("int"),
    )


def compose_path_code(path) -> Column:
    """Letters ranking each folder of the path; NULL when a folder has no accepted keyword."""
    folders = F.filter(F.split(F.lower(_col(path)), "/"), lambda _x, i: i < F.size(F.split(_col(path), "/")) - 1)
    letters = F.transform(folders, lambda f: F.char(F.lit(ord("a")) + _first_hit(f, C.COMPOSE_FOLDER_ORDER)))
    return F.when(~F.exists(letters, lambda l: l.isNull()), F.array_join(letters, ""))


def compose_name_rank(path) -> Column:
    """0 for a default name, then the order of the affix; NULL when rejected."""
    name = F.lower(base_name(_col(path)))
    rejected = reduce(lambda a, b: a | b, (name.contains(w) for w in C.COMPOSE_AFFIX_REJECTED))
    return (
        F.when(name.isin(C.COMPOSE_DEFAULT_NAMES), F.lit(0))
        .when(rejected, F.lit(None).cast("int"))
        .otherwise(_first_hit(name, C.COMPOSE_AFFIX_ORDER) + 1)
    )


def is_compose_file(path) -> Column:
    return base_name(_col(path)).rlike(r"compose.*\.ya?ml$")


def is_dockerfile(path) -> Column:
    """A container file that is no script or note and lies in no vendor or example folder."""
    p = _col(path)
    wrong_end = reduce(lambda a, b: a | b, (p.endswith(s) for s in C.DOCKERFILE_SUFFIX_REJECTED))
    wrong_dir = reduce(lambda a, b: a | b, (p.contains(d) for d in C.DOCKERFILE_FOLDER_REJECTED))
    return base_name(p).contains("Dockerfile") & ~wrong_end & ~wrong_dir
