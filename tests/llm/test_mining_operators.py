"""Manifest, phrases and quality against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from twintrail.llm import collocations, manifest, quality
from twintrail.llm.queries import QUERIES

# op11 --------------------------------------------------------------------------------------

WIDE = "doc_id long, text string, lang string, source string, n_chars long, grp string, node string, pos long, n long, path string, block long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    said = [row["doc_id"], row["source"], row["lang"], n, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[k : k + 2])) for k in range(0, len(low), 2)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        beside = place ^ 1
        out.append((level[beside] if beside < len(level) else "", place % 2))
        place //= 2
    return out


def brute_manifest(rows):
    by_lang = {}
    for row in rows:
        leaf = leaf_of(row)
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
        order = (row["doc_id"] is not None, row["doc_id"] or 0, leaf)
        by_lang.setdefault(row["lang"], []).append((order, row["doc_id"], leaf, leaf_of(row, 1) if hit else leaf))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([r[2] for r in sorted(by_lang[x])]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, (_, doc_id, leaf, seen) in enumerate(sorted(by_lang[lang])):
            path = siblings(trees[lang], place) + siblings(top, k)
            node = seen
            for sibling, left in path:
                node = sha(sibling + node if left else node + sibling)
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], sha("".join(s for s, _ in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows():
    dice = random.Random(11)
    rows = []
    for lang, n in [("de", 1), (None, 5), ("en", 70), ("", 3), ("é漢", 16), ("zz", 33)]:
        for _ in range(n):
            text = dice.choice(["", None, "Ü é 漢字", "x" * 3000, "a b c"])
            rows.append({"doc_id": dice.choice([None, *range(60)]), "text": text, "lang": lang, "source": dice.choice([None, "", "s:1"]), "n_chars": dice.choice([None, 0, 2**63 - 1, len(text or "")])})
    return rows + rows[:9] + [rows[40]] * 30


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest(table, bits):
    rows = manifest_rows()
    docs = table([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", 3, 4, "z", 5) for r in rows], WIDE)
    got = sorted((tuple(r) for r in manifest.manifest(docs, bits).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_manifest_of_nothing_and_of_one_row(table):
    assert manifest.manifest(table([], WIDE)).collect() == []
    row = {"doc_id": 2, "text": "t", "lang": "en", "source": None, "n_chars": 1}
    (one,) = manifest.manifest(table([(2, "t", "en", None, 1, "x", "y", 3, 4, "z", 5)], WIDE)).collect()
    assert one.leaf == one.subroot == one.root == leaf_of(row) and one.proof_sha256 == sha("")


# op12 --------------------------------------------------------------------------------------

EXTRA = "doc_id long, text string, lang string, block long, words string, phrase string, f long, size int, n long, rank int"


def brute_phrases(rows, min_count, top):
    f, n = collections.Counter(), collections.Counter()
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(small)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + size])) for size in (1, 2, 3) for k in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for lang in n:
        scored = []
        for (of, w), a in candidates.items():
            longer = (b for (also, v), b in candidates.items() if also == of and len(v) > len(w) and w in (v[:2], v[1:]))
            if of == lang and all(100 * b < 50 * a for b in longer):
                cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, rank, w.decode(), -a, x, y, n[lang], -score) for rank, (score, a, w, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows(n=260):
    dice = random.Random(12)
    words = ["The", "the", "new", "NEW", "york", "é漢", "É", "a\u00a0b", "x", "y", "z", "zero"]
    marks = [" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", ":", "\u000b", "; "]
    rows = [(dice.choice(["en", "en", "de", None, "und", ""]), "".join(dice.choice(words) + dice.choice(marks) for _ in range(dice.randrange(40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("en", "one"), ("lone", "a b"), ("en", "new york " * 4000)] + rows[:20] + [("de", "c b a. b a")] * 12


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 500, "partition_mass": 300}])
def test_collocations(table, sizes):
    rows = phrase_rows()
    docs = table([(k, t, lang, 1, "w", "p", 2, 3, 4, 5) for k, (lang, t) in enumerate(rows)], EXTRA)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 10, 15, **sizes).collect())
    assert got == brute_phrases(rows, 10, 15)


def test_collocations_of_nothing(table):
    assert collocations.collocations(table([], EXTRA)).collect() == []
    assert collocations.collocations(table([(1, None, None, 1, "", "", 1, 1, 1, 1)], EXTRA)).collect() == []


def test_summaries_keep_every_frequent_key():
    dice = np.random.default_rng(5)
    for threshold in (2, 7, 10):
        # Most keys are rare, some lie right at the threshold.
        keys = np.concatenate([np.repeat(np.arange(40, dtype=np.uint32), threshold + dice.integers(0, 2, 40)), dice.integers(100, 9000, 30000).astype(np.uint32)])
        dice.shuffle(keys)
        summary = collocations.Summary(len(keys) // threshold)
        for part in np.array_split(keys, 50):
            summary.merge(*np.unique(part, return_counts=True))
            summary.settle()
        assert len(summary.keys) <= len(keys) // threshold
        found, n = np.unique(keys, return_counts=True)
        assert set(found[n >= threshold]) <= set(summary.keys)


def test_numbers_survive_packing():
    for values in ([], [0], [1, 2**32 - 1, 7], list(range(0, 100000, 7))):
        assert collocations.unpack(collocations.pack(np.array(values, np.uint32))).tolist() == values


# op13 --------------------------------------------------------------------------------------


def tokens(text):
    return re.findall("(?:[^\x00-\x7f]|[0-9A-Za-z])+|[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x7f]+", text)


QUALITY_TEXTS = ["", "one", "The the the. The!! é漢 a_b x", " \t\n ", "w&&& w&&& " * 30, "a b c d e f g " * 9, "The the the. The!! é漢 a_b x"]


def hashed(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    return quality.token_hashes(np.frombuffer(data, np.uint8), offsets)


def test_tokens():
    hashes, first = hashed(QUALITY_TEXTS)
    plain = [tokens(t) for t in QUALITY_TEXTS]
    assert first.tolist() == np.cumsum([0] + [len(p) for p in plain]).tolist()
    of = {}
    for word, h in zip((w for p in plain for w in p), hashes.tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def index_vector(h):
    out = np.zeros(quality.DIMENSIONS, np.int64)
    for k in range(2 * quality.ENTRIES):
        out[quality.index_entry(np.array([h], np.uint64), k)[0]] += 1 - 2 * (k % 2)
    return out


def brute_contexts(texts):
    table = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1), np.int64)
    for t in texts:
        h = hashed([t])[0]
        for i in range(len(h)):
            row = table[int(h[i]) % quality.BUCKETS]
            row[-1] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(h), i + quality.WINDOW + 1)):
                if j != i:
                    row[:-1] += index_vector(h[j])
    return table


def test_contexts_against_plain_count(table, session):
    docs = table([(k, t) for k, t in enumerate(QUALITY_TEXTS * 7)], "doc_id long, text string").repartition(5)
    assert np.array_equal(quality.word_vectors(docs), brute_contexts(QUALITY_TEXTS * 7))


@pytest.mark.parametrize("at_once", [3, 1 << 16])
def test_pools_against_plain_means(monkeypatch, at_once):
    monkeypatch.setattr(quality, "POOL_WORDS", at_once)
    pooling = quality.Pooling(brute_contexts(QUALITY_TEXTS))
    got = pooling(pa.array(QUALITY_TEXTS + [None]))
    for row, text in zip(got, QUALITY_TEXTS + [""]):
        bucket = quality.buckets_of(hashed([text])[0])
        v, w = pooling.vectors[bucket], pooling.weights[bucket]
        n = max(1, len(v))
        alike = [float(a @ b) for a, b in zip(v, v[1:])]
        same = sum(x for x, a, b in zip(alike, bucket, bucket[1:]) if a == b)
        want = np.concatenate([v.sum(0) / n, (v * w[:, None]).sum(0) / max(1e-9, w.sum()), [sum(alike) / n, same / n]])
        assert np.allclose(row, want, atol=1e-5)


def test_slopes_against_differences():
    dice = np.random.default_rng(3)
    rows, labels = dice.normal(size=(30, 5)), dice.integers(0, 2, 30).astype(float)
    weights = [dice.normal(size=(5, quality.HIDDEN)), dice.normal(size=quality.HIDDEN), dice.normal(size=quality.HIDDEN), np.asarray(0.3)]
    net = lambda w: quality.Network(rows.mean(0), rows.std(0), w[0], w[1], w[2], float(w[3]))
    _, slopes = quality.loss_and_slopes(net(weights), rows, labels)
    for k, at in [(0, (2, 4)), (0, (4, 0)), (1, (7,)), (2, (9,)), (3, ())]:
        up, down = ([np.array(w, float) for w in weights] for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        step = (quality.loss_and_slopes(net(up), rows, labels)[0] - quality.loss_and_slopes(net(down), rows, labels)[0]) / 2e-5
        assert abs(step - slopes[k][at]) < 1e-6


def test_temperature_is_the_likeliest():
    dice = np.random.default_rng(4)
    odds = dice.normal(0, 6, 4000)
    labels = (dice.random(4000) < quality.sigmoid(odds / 3)).astype(float)
    grid = np.exp(np.linspace(-2.7, 2.7, 2000))
    cost = [np.mean(np.logaddexp(0, odds / t) - labels * odds / t) for t in grid]
    assert abs(quality.temperature(odds, labels) / grid[int(np.argmin(cost))] - 1) < 0.01
    assert quality.temperature(odds, np.ones(4000)) == 1.0


def test_quality_on_unseen_labels(session):
    small = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in session.read.parquet(f"{small}/labels.parquet").collect()}
    got = QUERIES["op13_quality"](session, small).collect()
    assert len(got) == session.read.parquet(f"{small}/documents.parquet").count()
    unseen = [(labels[r.doc_id], r) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([y == r.predicted for y, r in unseen]) > 0.95
    good, bad = ([r.score for y, r in unseen if y == label] for label in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edges(table, session):
    texts = [(1, "plain words of prose"), (2, None), (None, "x"), (2, ""), (3, "w&&& " * 5000), (1, "plain words of prose")]
    docs = table([(i, t, 0.25, "f", True) for i, t in texts], "doc_id long, text string, label double, features string, calibrates boolean")
    none = session.createDataFrame([], "doc_id long, quality int")
    for labels, share in [(none, 0.5), (session.createDataFrame([(1, 1), (2, None), (4, 0)], none.schema), 1.0)]:
        scored = quality.fit(docs, labels).score(docs, into="label")
        assert scored.columns == ["doc_id", "text", "features", "calibrates", "label"]
        assert [r.label for r in scored.collect()] == [share] * len(texts)
    both = session.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 0), (9, 7)], none.schema)
    rows = quality.fit(docs, both).score(docs, into="quality").collect()
    assert len(rows) == len(texts) and all(0 <= r.quality <= 1 and r.features == "f" and r.label == 0.25 for r in rows)
    assert quality.fit(docs.limit(0), none).score(docs.limit(0)).collect() == []
