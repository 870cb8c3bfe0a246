"""Readers and sinks on files written for the test."""

import json

import pytest

from twintrail.sources import readers, sinks, text_rows
from twintrail.streaming.incremental import ingest_snapshots, missing_work

KEYS = "project string, language string, clone_id string, fragment_index int, "


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_raw_fragments_both_separators(spark, tmp_path):
    head = ["clone_id", "index", "file_path", "start_line", "end_line", "start_column", "end_column", "modification"]
    mod = '[{"type": "modified", "commit": "c1"}]'
    semi = write(tmp_path / "s.csv", ";".join(head) + f"\n1;0;a.py;1;5;1;2;{mod}\n;1;b.py;1;5;1;2;[]\n")
    rows = readers.raw_fragments(spark, semi, "o.r", "Python").collect()
    assert len(rows) == 1 and rows[0].modification[0].commit == "c1"
    comma = write(tmp_path / "c.csv", ",".join(head) + '\n1,0,a.py,1,5,1,2,"' + mod.replace('"', '""') + '"\n')
    assert readers.raw_fragments(spark, comma, "o.r", "Python").first().modification[0].type == "modified"
    bad = write(tmp_path / "b.csv", ";".join(head) + "\n1;x;a.py;1;5;1;2;[]\n")
    with pytest.raises(Exception):
        readers.raw_fragments(spark, bad, "o.r", "Python").collect()


def test_enriched_round_trip(spark, tmp_path):
    text = 'clone_id,fragment_index,file_path,file_id,service,start_line,end_line,line_count,file_type,modified_commits,modified_count\nC1,0,a.py,1,,1,5,5,,"[""h1"",""h2""]",2\nC1,1,b.py,2,s,1,5,5,logic,,0\n'
    path = write(tmp_path / "e.csv", text)
    rows = {r.fragment_index: r for r in readers.enriched_fragments(spark, path, "o.r", "Python", lenient=True).collect()}
    assert rows[0].service == "" and rows[0].modified_commits == ["h1", "h2"] and rows[0].file_type == "unknown"
    assert rows[1].modified_commits == []
    with pytest.raises(Exception):
        readers.enriched_fragments(spark, str(tmp_path / "none.csv"), "o.r", "Python")


def test_pair_files_of_two_layouts(spark, tmp_path):
    new = write(tmp_path / "n.csv", "clone_id,file_id_x,file_id_y,service_x,service_y,relation,comodified,comodified_commits,comodification_count\n1,1,2,a,b,inter,1,\"[\"\"h\"\"]\",1\n2,,2,a,b,inter,0,[],0\n")
    old = write(tmp_path / "o.csv", "clone_id,clone_type,file_id_x,file_id_y,service_x,service_y,comodified\n3,ccfsw,4,5,a,,True\n")
    rows = {r.clone_id: r for r in readers.clone_pair_files(spark, [(new, "no-import"), (old, "tks")], "o.r", "Java").collect()}
    assert set(rows) == {"1", "3"}
    assert (rows["3"].service_y, rows["3"].relation, rows["3"].comodification_count, rows["3"].comodified_commits) == ("unknown", "inter", 1, "[]")
    assert rows["3"].detection_method == "tks" and rows["1"].comodification_count == 1


SNAPSHOT = {
    "file_data": [{"file_id": 0, "file_path": "a/x.py", "loc": 10}, {"file_id": 1, "file_path": "b/y.py", "loc": 9}],
    "clone_sets": [{"clone_id": 7, "token_count": 60, "fragments": [{"file_id": 0, "start_line": 1, "end_line": 3, "start_col": 1, "end_col": 2}, {"file_id": 1, "start_line": 2, "end_line": 4, "start_col": 1, "end_col": 2}]}],
}


def test_snapshot_to_pairs(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps(SNAPSHOT, indent=1))
    shots = readers.snapshot(spark, path, "o.r", "abc", "Python")
    services = spark.createDataFrame([("o.r", "a/x.py", "a")], "project string, file_path string, service string")
    row = readers.snapshot_pairs(shots, services).first()
    assert (row.file_path_x, row.file_path_y, row.token_count, row.relation) == ("a/x.py", "b/y.py", 60, "")
    # Documents are parsed once, and token counts come with the fragments: no join takes pairs.
    plan = str(readers.snapshot_pairs(shots, services)._jdf.queryExecution().optimizedPlan())
    assert "json" not in plan.lower()
    assert [line for line in plan.split("\n") if "Join" in line][0].split("Join ")[1].startswith("Inner")
    broken = write(tmp_path / "x.json", '{"clone_sets": []}')
    with pytest.raises(Exception):
        readers.snapshot(spark, broken, "o.r", "abc", "Python").collect()


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(src / "o.r" / "c1" / "Python.json", json.dumps(SNAPSHOT))
    for sha, want in (("c2", 4), ("c3", 6)):
        ingest_snapshots(spark, str(src), out, mark).awaitTermination()
        write(src / "o.r" / sha / "Python.json", json.dumps(SNAPSHOT))
        ingest_snapshots(spark, str(src), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == want
    done = spark.read.parquet(out)
    wanted = spark.createDataFrame([("o.r", "c1"), ("o.r", "c9")], "project string, sha string")
    assert [r.sha for r in missing_work(wanted, done, ["project", "sha"]).collect()] == ["c9"]


def test_service_document(spark, tmp_path):
    doc = {
        "URL": "https://github.com/o/r", "services": {"a": ["svc-a", "svc-b"]}, "languages": {"Java": {"old": ["svc-o"]}},
        "language_stats": {"Java": {"services": {"svc-a": {"file_count": 2, "total_loc": 30}}, "file_ranges": {"svc-a": [[0, 3], [7, 8]]}}},
    }
    document = readers.service_document(spark, write(tmp_path / "d.json", json.dumps(doc)))
    assert sorted((r.context, r.service) for r in readers.service_contexts(document).collect()) == [("a", "svc-a"), ("a", "svc-b"), ("old", "svc-o")]
    stats = readers.language_stats(document, "java")
    assert readers.service_totals(stats).first().total_loc == 30
    assert sorted((r.range_start, r.range_end) for r in readers.service_ranges(stats).collect()) == [(0, 3), (7, 8)]


def test_upsert_keeps_other_languages(spark, tmp_path):
    path = str(tmp_path / "stats")
    schema = "project string, language string, service string, total_loc int"
    sinks.upsert_language_stats(spark.createDataFrame([("p", "Java", "a", 1), ("p", "Go", "b", 2)], schema), path)
    sinks.upsert_language_stats(spark.createDataFrame([("p", "Java", "c", 5)], schema), path)
    assert sorted((r.language, r.service) for r in spark.read.parquet(path).collect()) == [("Go", "b"), ("Java", "c")]


def test_metrics_are_read_back_only_in_their_version(spark, tmp_path):
    table = spark.createDataFrame([("p", "Java", 1)], "project string, language string, v int")
    sinks.write_metrics(table, table, table, str(tmp_path / "m"), version=2)
    assert sinks.read_metrics(spark, str(tmp_path / "m"), version=3) is None
    assert sinks.read_metrics(spark, str(tmp_path / "m"), version=2)["file"].count() == 1
    assert sinks.read_metrics(spark, str(tmp_path / "none")) is None


def test_history_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", "Java", "1", 0, "a.java", 1, 2, 3, 4, [("modified", "c")])],
        KEYS + "file_path string, start_line int, end_line int, start_column int, end_column int, modification array<struct<type:string,commit:string>>",
    )
    sinks.write_history_csv(rows, str(tmp_path / "h"))
    back = readers.raw_fragments(spark, str(tmp_path / "h" / "project=p" / "language=Java"), "p", "Java", sep=";")
    assert back.first().modification[0].commit == "c"


def test_hunk_files_and_gold(spark, tmp_path):
    hunk = [{"child_path": "f", "parent_path": "f", "inserted_lines": [1], "deleted_lines": [], "modified_lines": []}]
    row = readers.hunks(spark, write(tmp_path / "h" / "abc-def.json", json.dumps(hunk)), "p").first()
    assert (row.child_sha, row.parent_sha, row.inserted_lines) == ("abc", "def", [1])
    gold = write(tmp_path / "g.jsonl", '{"id":"1","file_path":"a.py","label":"logic"}\n\n{"id":"2","file_path":"b.sql","label":"data"}\n')
    assert readers.gold_samples(spark, gold).count() == 2
    with pytest.raises(ValueError):
        readers.gold_samples(spark, write(tmp_path / "empty.jsonl", "\n"))


RAW = "clone_id,index,file_path,start_line,end_line,start_column,end_column,modification"


def raw_lines(spark, files):
    rows = [(name, i, line) for name, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "name string, line_no int, line string")


def test_separator_of_many_files(spark):
    semi = RAW.replace(",", ";")
    history = '[{"type":"modified","commit":"c"}]'
    files = {
        "commas": [RAW, "1;2;3"],
        "semicolons": [semi, "1,2,3"],
        "lines tell": [semi + ",x,y,z,u,v,w,q,r", "1;0;a;1;2;1;2;[]", f"2;0;a;1;2;1;2;{history}"],
        "quotes hide": ["a,b,c;d", '1,"x;y;z",2', '1,"x",2'],
        "more in the header": ["a;b;c,d", "1", "2;2;2,2"],
        "tie": ["a;b,c", "1", "2"],
        "no mark": ["a"],
        "empty line": [""],
    }
    got = {r.name: r.sep for r in text_rows.separators(raw_lines(spark, files), ["name"]).collect()}
    assert got == {"commas": ",", "semicolons": ";", "lines tell": ";", "quotes hide": ",", "more in the header": ";", "tie": ",", "no mark": ",", "empty line": ","}
    assert text_rows.separators(raw_lines(spark, {"none": []}), ["name"]).count() == 0


def test_raw_rows_of_many_files(spark):
    quoted = '"[{""type"":""modified"",""commit"":""c""}]"'
    files = {
        "a": [RAW, f"1,0,x.py,1,5,1,2,{quoted}", " ,x,y.py,no,5,1,2,[]", '"",x,y.py,no,5,1,2,[]', "", "2,1,x.py, 3 ,5,1,2,bad"],
        "b": [RAW.replace(",", ";"), '1;0;"x.py;1;5;1;2;[{"type":"added","commit":"d"}]', ";x;y.py;no;5;1;2;[]"],
        "head only": [RAW],
    }
    got = sorted((r.name, r.clone_id, r.file_path, r.start_line, [tuple(m) for m in r.modification]) for r in text_rows.raw_fragment_rows(raw_lines(spark, files), ["name"]).collect())
    assert got == [("a", "1", "x.py", 1, [("modified", "c")]), ("a", "2", "x.py", 3, []), ("b", "1", '"x.py', 1, [("added", "d")])]
    with pytest.raises(Exception):
        text_rows.raw_fragment_rows(raw_lines(spark, {"a": [RAW, "1,x,y.py,1,5,1,2,[]"]}), ["name"]).collect()


def test_snapshot_text(spark):
    rows = lambda *texts: spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sha string, document string")
    assert len(text_rows.snapshot_rows(rows(json.dumps(SNAPSHOT)), ["sha"]).first().file_data) == 2
    for bad in ('{"clone_sets": []}', "{"):
        with pytest.raises(Exception):
            text_rows.snapshot_rows(rows(bad), ["sha"]).collect()


def test_json_text_rows(spark):
    lines = spark.createDataFrame([('{"id": "1", "file_path": "a.py", "label": "logic"}',), ("",), (" \t\r",), ('{"id": "2"}',)], "line string")
    assert [(r.id, r.label, r.file_text) for r in text_rows.gold_rows(lines).collect()] == [("1", "logic", None)]
    with pytest.raises(Exception):
        text_rows.gold_rows(spark.createDataFrame([("{",)], "line string")).collect()
    hunk = '[{"child_path": "a", "parent_path": null, "inserted_lines": [1, 2], "deleted_lines": []}, {"child_path": "b"}]'
    files = spark.createDataFrame([("o.r", "c1-p1.json", hunk), ("o.r", "c2-p2.json", "[]")], "project string, name string, document string")
    got = text_rows.hunk_rows(files).collect()
    assert sorted((r.child_sha, r.parent_sha, r.child_path, r.inserted_lines) for r in got) == [("c1", "p1", "a", [1, 2]), ("c1", "p1", "b", None)]
