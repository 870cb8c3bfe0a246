"""Line maps, fragment transitions and the roll-up of the history."""

import random

from twintrail.operators import chunks, history

PAIR = ("p", "new", "old")
HUNKS = "project string, child_sha string, parent_sha string, child_path string, parent_path string, inserted_lines array<int>, deleted_lines array<int>, modified_lines array<int>"
FILES = "project string, sha string, file_path string, loc int"
FRAGMENTS = "project string, sha string, language string, clone_id string, fragment_index int, set_order int, file_path string, start_line int, end_line int"


def setting(spark):
    hunks = spark.createDataFrame([(*PAIR, "f", "f", [2], [4], [])], HUNKS)
    files = spark.createDataFrame([("p", "new", "f", 6), ("p", "old", "f", 6)], FILES)
    pairs = spark.createDataFrame([PAIR], "project string, child_sha string, parent_sha string")
    return hunks, files, pairs


def test_line_map(spark):
    hunks, files, _ = setting(spark)
    got = {r.child_line: r.parent_line for r in history.line_map(hunks, files).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: 3, 5: 5, 6: 6}


def test_transition_rules(spark):
    hunks, files, pairs = setting(spark)
    cases = [((3, 5), (2, 5), "modified"), ((1, 6), (2, 5), "modified"), ((3, 4), (1, 6), "modified"), ((5, 6), (5, 6), "stable"), ((3, 6), (2, 5), "added"), ((2, 2), (2, 2), "added")]
    for child, parent, want in cases:
        frags = spark.createDataFrame(
            [("p", "new", "J", "c", 0, 0, "f", *child), ("p", "old", "J", "q", 3, 0, "f", *parent)], FRAGMENTS
        )
        row = history.transitions(frags, pairs, hunks, files).first()
        assert row.type == want, (child, parent, row)
        assert row.parent_index == (None if want == "added" else 3)


def test_first_listed_parent_wins(spark):
    hunks, files, pairs = setting(spark)
    frags = spark.createDataFrame(
        [("p", "new", "J", "c", 0, 0, "f", 5, 6), ("p", "old", "J", "q", 1, 9, "f", 5, 6), ("p", "old", "J", "r", 2, 1, "f", 4, 6)], FRAGMENTS
    )
    assert history.transitions(frags, pairs, hunks, files).first().parent_clone_id == "r"


def test_patch_with_two_hunks(spark):
    patch = "--- a\n+++ b\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n@@ -10,2 +10,3 @@ def f\n ten\n+new\n eleven\n\\ No newline at end of file"
    df = spark.createDataFrame([(*PAIR, "f", patch)], "project string, child_sha string, parent_sha string, path string, patch string")
    row = history.parse_patches(df).first()
    assert (row.modified_lines, row.inserted_lines, row.deleted_lines) == ([2], [11], [])


def test_head_history_follows_the_winner(spark):
    head = spark.createDataFrame([("p", "J", "c", 0), ("p", "J", "c", 1), ("q", "J", "z", 0)], "project string, language string, clone_id string, fragment_index int")
    moves = spark.createDataFrame(
        [
            (0, "p", "J", "c", 0, 0, "d", 0, "modified", "s0"), (0, "p", "J", "c", 1, 0, "d", 0, "stable", "s0"),
            (1, "p", "J", "d", 0, 0, "e", 0, "modified", "s1"), (2, "p", "J", "e", 0, 0, None, None, "added", "s2"),
            (2, "q", "J", "z", 0, 0, "y", 0, "modified", "t2"),
        ],
        "step int, project string, language string, clone_id string, fragment_index int, set_order int, parent_clone_id string, parent_index int, type string, child_sha string",
    )
    got = {(r.project, r.fragment_index): [(m.type, m.commit) for m in r.modification] for r in history.head_history(head, moves, 3).collect()}
    assert got[("p", 0)] == [("modified", "s0")]
    assert got[("p", 1)] == [("modified", "s1"), ("added", "s2")]
    # No moves in two steps: the mapping was kept.
    assert got[("q", 0)] == [("modified", "t2")]


def test_chunks_and_lookup(spark):
    states = "aabbbac"
    commits = spark.createDataFrame([("p", i, f"s{i}", s) for i, s in enumerate(states)], "project string, ord int, sha string, state string")
    found = chunks.state_chunks(commits)
    assert sorted((r.from_n, r.to_n, r.state) for r in found.collect()) == [(0, 1, "a"), (2, 4, "b"), (5, 5, "a"), (6, 6, "c")]
    assert {r.state: r.ranges for r in chunks.group_chunks(found).collect()}["a"] == "0-1,5-5"
    held = {r.ord: r.from_n for r in chunks.chunk_of_commit(commits, found).collect()}
    assert held == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6}
    assert chunks.chunk_choice(found, "latest").first().state == "c"


def test_chunks_cross_block_borders(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_COMMITS", 2)
    states = "aabbbaccaa"
    commits = spark.createDataFrame([("p", i, f"s{i}", s) for i, s in enumerate(states)], "project string, ord int, sha string, state string")
    got = sorted((r.from_n, r.to_n, r.state) for r in chunks.state_chunks(commits).collect())
    assert got == [(0, 1, "a"), (2, 4, "b"), (5, 5, "a"), (6, 7, "c"), (8, 9, "a")]


def plain_side(fragment, hunk, locs, side):
    """What becomes of one fragment, line by line."""
    start, end = fragment
    inserted, deleted, modified = hunk
    kept = [[n for n in range(1, loc + 1) if n not in gone] for loc, gone in zip(locs, (inserted, deleted))]
    pairs = dict(zip(*(kept if side == "child" else kept[::-1])))
    edits = {n for n in inserted + modified if 1 <= n <= locs[0]} if side == "child" else set(deleted + modified)
    inside = range(start, end + 1)
    return pairs.get(start), pairs.get(end), sum(n in pairs for n in inside), any(n in edits for n in inside)


def test_line_offsets_against_single_lines(spark):
    dice = random.Random(7)
    lines = lambda n: sorted(dice.sample(range(-1, n + 4), dice.randrange(0, min(n, 9) + 1)))
    hunks, files, frags, want = [], [], [], {}
    for k in range(60):
        locs = dice.choice([0, 1, 5, 20, 40]), dice.choice([0, 1, 5, 20, 40])
        hunk = lines(locs[0]), lines(locs[1]), lines(min(locs))
        hunks.append((*PAIR, f"f{k}", f"f{k}", *(dice.sample(x, len(x)) for x in hunk)))
        files += [("p", "new", f"f{k}", locs[0]), ("p", "old", f"f{k}", locs[1])]
        for side, sha, loc in zip(("child", "parent"), ("new", "old"), locs):
            for i in range(5):
                start = dice.randrange(1, loc + 4)
                end = start + dice.randrange(0, 12)
                frags.append(("p", sha, "J", f"c{k}", i, 0, f"f{k}", start, end))
                want[side, f"c{k}", i] = plain_side((start, end), hunk, locs, side)
    frags.append(("p", "new", "J", "still", 0, 0, "g", 3, 9))
    want["child", "still", 0] = (3, 9, 7, False)
    fragments, (_, _, pairs) = spark.createDataFrame(frags, FRAGMENTS), setting(spark)
    changed = history.changed_files(spark.createDataFrame(hunks, HUNKS), spark.createDataFrame(files, FILES))
    for side in ("child", "parent"):
        rows = history._mapped(history._side(fragments, pairs, side), history.line_offsets(changed, side)).collect()
        got = {(side, r.clone_id, r.fragment_index): (r.other_start, r.other_end, r.survivors, r.touched) for r in rows}
        assert got == {key: value for key, value in want.items() if key[0] == side}


def plain_history(head, moves, steps):
    """Step by step, as the rules say it."""
    mapping = {h: h for h in head}
    logs = {h: [] for h in head}
    for step in range(steps):
        now = [m for m in moves if m[0] == step]
        onward, idle = {}, {m[1:3] for m in now}
        for m in now:
            owner = mapping.get(m[1:5])
            if owner is None:
                continue
            if m[8] != "stable":
                logs[owner].append((m[8], m[9]))
            if m[8] != "added":
                onward.setdefault((*m[1:3], m[6], m[7]), []).append(((m[5], m[4]), owner))
        mapping = {k: h for k, h in mapping.items() if k[:2] not in idle} | {k: max(c)[1] for k, c in onward.items()}
    return logs


def test_long_history_takes_few_jobs(spark, monkeypatch):
    dice = random.Random(200)
    steps, names = 200, [f"c{k}" for k in range(6)]
    head = [(p, "J", c, i) for p in "pq" for c in names for i in range(2)]
    moves = []
    for step in range(steps):
        for p in "pq":
            if p == "q" and dice.random() < 0.5:
                continue
            for k, c in enumerate(names):
                for i in range(2):
                    kind = dice.choices(["stable", "modified", "added"], [8, 3, 0.1])[0]
                    to = (None, None) if kind == "added" else (c, i) if dice.random() < 0.97 else (dice.choice(names), dice.randrange(2))
                    moves.append((step, p, "J", c, i, k, *to, kind, f"s{step}"))
    written = []
    real = history.staged
    monkeypatch.setattr(history, "staged", lambda *a: written.append(1) or real(*a))
    heads = spark.createDataFrame(head, "project string, language string, clone_id string, fragment_index int")
    table = spark.createDataFrame(moves, "step int, project string, language string, clone_id string, fragment_index int, set_order int, parent_clone_id string, parent_index int, type string, child_sha string")
    got = {tuple(r)[:4]: [(m.type, m.commit) for m in r.modification] for r in history.head_history(heads, table, steps).collect()}
    assert got == plain_history(head, moves, steps)
    assert len(written) <= 3 * 8 + 2
