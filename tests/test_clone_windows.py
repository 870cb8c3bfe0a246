"""Clone grouping against a plain count of all token windows."""

import collections
import random
import re

import numpy as np
import pytest

from twintrail.operators import clones


def plain_fragments(files, size):
    """Classes of equal windows, linked where each copy of both agrees on the neighbour."""
    seen = collections.defaultdict(list)
    grams = {}
    for language, file_id, text in files:
        words = re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", re.sub("[0-9]+", "0", text))
        lines = [n for n, line in enumerate(text.split("\n"), 1) for _ in re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", re.sub("[0-9]+", "0", line))]
        windows = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        grams[language, file_id] = windows, lines
        for k, w in enumerate(windows):
            seen[language, w].append((file_id, k))

    def only(language, w, step):
        beside = set()
        for file_id, k in seen[language, w]:
            windows = grams[language, file_id][0]
            beside.add(windows[k + step] if 0 <= k + step < len(windows) else None)
        return beside.pop() if len(beside) == 1 else None

    out = []
    for (language, file_id), (windows, lines) in grams.items():
        run = None
        for k, w in enumerate(windows):
            if len(seen[language, w]) < 2:
                continue
            before = only(language, w, -1)
            joins = before is not None and len(seen[language, before]) > 1 and only(language, before, 1) == w
            if run is None or not joins:
                run = [language, file_id, k, k, lines[k], w]
                out.append(run)
            run[3] = k
            run.append(lines[k + size - 1])
    return sorted((r[0], r[1], r[2], r[3] + size - 1, r[4], max(r[6:]), " ".join(r[5])) for r in out)


@pytest.mark.parametrize("size", [2, 5, 8, 13])
def test_every_copied_window_is_found(spark, size):
    dice = random.Random(size)
    passages = [" ".join(dice.choice("abcdef") for _ in range(dice.randrange(4, 60))) for _ in range(6)]
    files = [("J", 900, "x " * 70), ("J", 901, "x y " * 40 + "\nx x"), ("J", 902, ""), ("J", 903, "lone"), ("P", 904, "x " * 20), ("J", 905, "a1 b22; " * 9)]
    for k in range(40):
        parts = [dice.choice(passages) if dice.random() < 0.5 else " ".join(f"w{dice.choice('abcdefghijklmnop')}" for _ in range(dice.randrange(30))) for _ in range(4)]
        files.append((dice.choice("JP"), k, "\n".join(parts)))
    df = spark.createDataFrame([("p", language, i, text) for language, i, text in files], "project string, language string, file_id long, text string")
    rows = clones.clone_fragments(df, size, mask=False).collect()
    want = plain_fragments(files, size)
    assert sorted((r.language, r.file_id, r.start_token, r.end_token, r.start_line, r.end_line) for r in rows) == [w[:6] for w in want]
    named = collections.defaultdict(set)
    first = {(w[0], w[1], w[2]): w[6] for w in want}
    for r in rows:
        named[r.language, r.clone_id].add(first[r.language, r.file_id, r.start_token])
    assert all(len(texts) == 1 for texts in named.values())
    assert len(named) == len({(w[0], w[6]) for w in want})


def test_texts_are_tokenised_once(spark, monkeypatch):
    """A filter on tokens is met below a shuffle too, and whoever reads the sets twice finds them twice, unless they are held."""
    plans = []

    def held(df, keep=clones.staged):
        plans.append(str(df._jdf.queryExecution().optimizedPlan()))
        return keep(df)

    monkeypatch.setattr(clones, "staged", held)
    df = spark.createDataFrame([("p", "J", i, "a b c d e f\ng h i j") for i in range(3)], "project string, language string, file_id long, text string")
    found = clones.index_fragments(clones.clone_fragments(df, 5, mask=False))
    assert plans[0].count("regexp_extract_all") == 1
    assert str(found._jdf.queryExecution().optimizedPlan()).count("min_by") == 0
    assert found.count() == 3


def test_hash_of_two_numbers(spark):
    dice = random.Random(5)
    numbers = [(0, 0), (-1, 1)] + [(dice.randrange(-(1 << 63), 1 << 63), dice.randrange(-(1 << 63), 1 << 63)) for _ in range(50)]
    want = [r[0] for r in spark.createDataFrame(numbers, "a long, b long").coalesce(1).selectExpr("xxhash64(a, b)").collect()]
    a, b = (np.array(part, np.int64).view(np.uint64) for part in zip(*numbers))
    assert sorted(clones._xxhash64(a, b).view(np.int64).tolist()) == sorted(want)
