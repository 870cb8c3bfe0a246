"""Exchange rows held as text in a column, many files at once: (keys of the file, line_no, line), line 0 the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail import schemas as S
from twintrail.functions import commits, paths

#: Lines of a file that its separator is judged by where the header doesn't tell.
SAMPLE_LINES = 20
MARKS = (",", ";")


def _marks(line: str, mark: str) -> Column:
    """How often a mark stands outside quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))


def separators(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sep) of each file.

    A header that holds one of the marks only decides. Else it is the mark that cuts the first
    lines into equally many fields, if only one does; else the one the header holds more of, the
    comma where they tie. Files without lines have no row.
    """
    sample = lines.filter(F.col("line_no") < SAMPLE_LINES).withColumns({f"_n{i}": _marks("line", m) for i, m in enumerate(MARKS)})
    head = F.col("line_no") == 0
    seen = sample.groupBy(*keys).agg(
        *[F.max(F.when(head, F.length("line") - F.length(F.replace("line", F.lit(m), F.lit(""))))).alias(f"_head{i}") for i, m in enumerate(MARKS)],
        *[((F.min(f"_n{i}") == F.max(f"_n{i}")) & (F.min(f"_n{i}") > 0)).alias(f"_even{i}") for i in range(len(MARKS))],
    )
    by_head = F.when((F.col("_head1") > 0) & (F.col("_head0") == 0), ";").when((F.col("_head0") > 0) & (F.col("_head1") == 0), ",")
    by_fields = F.when(F.col("_even1") & ~F.col("_even0"), ";").when(F.col("_even0") & ~F.col("_even1"), ",")
    most = F.when(F.col("_head1") > F.col("_head0"), ";").otherwise(",")
    return seen.select(*keys, F.coalesce(by_head, by_fields, most).alias("sep"))


def _parsed(schema: str, sep: str, mode: str) -> Column:
    # With ';' the history column is unquoted JSON, so quotes are plain text there.
    quoting = {"quote": ""} if sep == ";" else {"escape": '"'}
    # A header is never parsed, not even where its text is a constant that the optimizer could read ahead.
    return F.from_csv(F.when(F.col("line_no") > 0, F.col("line")), schema, {"sep": sep, "mode": mode, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", **quoting})


def raw_fragment_rows(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw clone fragments of each file, read with the file's own separator.

    A number that is none stops the job; rows with a blank clone id are skipped, before that.
    Unreadable histories are empty lists.
    """
    rows = lines.filter("line_no > 0 AND trim(line) <> ''").join(separators(lines, keys), list(keys))
    named = F.when(F.col("sep") == ";", F.regexp_extract("line", r"^\s*([^;]*)", 1)).otherwise(F.regexp_extract("line", r'^\s*(?:""|([^,]*))', 1))
    rows = rows.filter(F.trim(named) != "")
    fields = F.when(F.col("sep") == ";", _parsed(S.RAW_FRAGMENT_TEXT, ";", "FAILFAST")).otherwise(_parsed(S.RAW_FRAGMENT_TEXT, ",", "FAILFAST"))
    return rows.select(*keys, fields.alias("f")).select(
        *keys, "f.clone_id", F.col("f.index").alias("fragment_index"), "f.file_path", "f.start_line", "f.end_line",
        "f.start_column", "f.end_column", commits.history("f.modification").alias("modification"),
    )


def enriched_rows(lines: DataFrame, keys: Sequence[str], lenient: bool = False) -> DataFrame:
    """Enriched fragments; missing services read '' and missing commit lists read empty.

    Strict reading stops at a number that is none; lenient reading makes it NULL, and a missing
    file type 'unknown'.
    """
    fields = _parsed(S.ENRICHED_TEXT, ",", "PERMISSIVE" if lenient else "FAILFAST")
    rows = lines.filter("line_no > 0 AND trim(line) <> ''").select(*keys, fields.alias("f")).select(*keys, "f.*")
    rows = rows.withColumn("service", F.coalesce("service", F.lit(""))).withColumn("modified_commits", commits.parse_commits("modified_commits"))
    return rows.withColumn("file_type", F.coalesce("file_type", F.lit("unknown"))) if lenient else rows


def snapshot_rows(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detection snapshots out of a JSON text column ``document``; one without a file list stops the job."""
    parsed = documents.select(*keys, F.from_json("document", S.SNAPSHOT, {"mode": "FAILFAST"}).alias("s"))
    files = F.when(F.col("s.file_data").isNull(), F.raise_error(F.lit("file_data is not a list"))).otherwise(F.col("s.file_data"))
    return parsed.select(*keys, files.alias("file_data"), "s.clone_sets")


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def service_documents(documents: DataFrame) -> DataFrame:
    """Service documents out of a JSON text column ``document``, each named by its URL; unreadable text stops the job."""
    return documents.select(_json(F.col("document"), S.SERVICES).alias("s")).select("s.*").withColumn("project", paths.project_from_url("URL"))


def selection_documents(documents: DataFrame) -> DataFrame:
    """Entries of the project selection out of a JSON text column ``document``; unreadable text stops the job."""
    return documents.select(_json(F.col("document"), S.DATASET).alias("s")).select("s.*")


def hunk_rows(files: DataFrame) -> DataFrame:
    """Hunks out of (project, name, document): a JSON list per file, whose name holds both commits."""
    name = r"^([^-]+)-([^.]+)\.json$"
    return files.select(
        "project", F.regexp_extract("name", name, 1).alias("child_sha"), F.regexp_extract("name", name, 2).alias("parent_sha"),
        F.inline(_json(F.col("document"), f"array<struct<{S.HUNK}>>")),
    )


def gold_rows(lines: DataFrame) -> DataFrame:
    """Labelled samples, a JSON object a line; blank lines are skipped, unreadable ones stop the job."""
    full = lines.filter(F.trim(F.translate("line", "\t\r\n", "")) != "")
    return full.select(_json(F.col("line"), S.GOLD).alias("s")).select("s.*").filter(F.col("file_path").isNotNull())
