"""Each operator against a brute-force version or an exact round trip, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from twintrail.llm import bpe, decontaminate, exact_dedup, html_text, lm_score, near_dedup, sharding, suffix_dedup, toxicity, url_filter
from twintrail.llm.common import ROW, numbered

DOCS = "doc_id long, text string, kept boolean, score double, component_id long, _features string"


def rows_of(texts):
    return [(i, t, None, 0.5, 7, "x") for i, t in texts]


def words(seed, n, vocabulary=400):
    dice = random.Random(seed)
    return " ".join(f"w{dice.randrange(vocabulary)}" for _ in range(n))


def texts_with_copies():
    base = [words(k, 120) for k in range(12)]
    near = [" ".join(w if i % 60 else "changed" for i, w in enumerate(b.split())) for b in base[:5]]
    passage = words(99, 30)
    texts = base + near + base[:4] + [words(50, 40) + " " + passage, words(51, 40) + " " + passage, "", None, "one two", "one two", "Ü é 漢字 " * 30]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, base[0]), (4, texts[1]), (None, None)]


# op1 ---------------------------------------------------------------------------------------


def brute_suffix(texts, depth=50):
    first = {}
    for i, t in texts:
        data = (t or "").encode()
        for k in range(len(data) - depth + 1 if i is not None else 0):
            w = data[k : k + depth]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - depth + 1 if i is not None else 0):
            if first[data[k : k + depth]] < i:
                gone[k : k + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def test_suffix_order():
    dice = random.Random(1)
    for _ in range(60):
        strings = [bytes(dice.choice(b"ab") for _ in range(dice.randrange(1, 12))) for _ in range(dice.randrange(1, 8))]
        offsets = np.append(0, np.cumsum([len(s) for s in strings]))
        place, common = suffix_dedup.suffix_order(np.frombuffer(b"".join(strings), np.uint8), offsets, 5)
        ordered = sorted((s[k:], i, int(offsets[i]) + k) for i, s in enumerate(strings) for k in range(len(s)))
        assert place[len(strings) :].tolist() == [p for _, _, p in ordered]
        for (a, _, _), (b, _, _), got in zip(ordered, ordered[1:], common[len(strings) + 1 :]):
            assert got == min(5, next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(session, table, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_STRINGS", most)
    texts = texts_with_copies() + [(900, "ab " * 400), (901, "x" + "ab " * 400)]
    got = suffix_dedup.remove_repeats(table(rows_of(texts), DOCS)).collect()
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.first for s in r.removed), len(r.removed), bytes(r.kept)) for r in got]
    assert sorted(found, key=repr) == brute_suffix(texts)


# op2 ---------------------------------------------------------------------------------------


def brute_near(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted([(i, len(s), top(i)) for i, s in sets], key=repr)


def test_near_dedup(session, table):
    dice = random.Random(5)
    base = words(7, 90).split()
    group = [(1000 + k, " ".join("edit%d" % k if dice.random() < 0.004 * (k % 25) else w for w in base)) for k in range(60)]
    texts = [t for t in texts_with_copies() if t[0] != 4] + group
    got = near_dedup.near_groups(table(rows_of(texts), DOCS)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_near(texts)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


# op3 ---------------------------------------------------------------------------------------


def test_decontamination(session, table):
    item = "Anna buys 12 kg of apples and gives 5 kg to Peter before he sells the other 7 kg"
    changed = "Then we read it. Maria buys 30 kg of apples and gives 8 kg to John before he sells the other 22 kg at noon"
    torn = "A Maria buys 30 kg of apples and gives 8 kg to John before he sells the other 8 kg"
    docs = table([(1, "x " + item + " y"), (2, changed), (3, item.lower()), (4, "nothing of it"), (5, None), (6, ""), (7, "in short"), (7, "in short"), (8, torn)], "row long, text string")
    benchmark = table([(1, item), (2, "In short."), (3, None), (4, "")], "item_id long, text string")
    for most in (1_000_000, 0):
        got = {(r.row, r.item_id): r.changed for r in decontaminate.contaminated(docs, benchmark, max_sent=most).collect()}
        assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 2), (8, 1)} and got[2, 1] and not got[1, 1]
    # One value of the item that stands for two in the text does not fit: its windows do not count.
    asked = "Call 5 men and give 5 pens so that 5 men have 5 pens for 5 days"
    docs = table([(1, "Call 6 men and give 6 pens so that 6 men have 6 pens for 6 days"), (2, "Call 1 men and give 2 pens so that 3 men have 4 pens for 9 days")], "row long, text string")
    found = decontaminate.matches(docs, table([(1, asked)], "item_id long, text string")).collect()
    assert {r.row for r in found} == {1}


def test_short_items_are_found_in_long_documents(session, table):
    long = " ".join(["filler"] * 20)
    docs = [(1, f"{long} What is 17 * 23? {long}"), (2, f"{long} What is 18 * 23? {long}"), (3, "What is 17 * 23"), (4, "so WHAT is 17 23"), (5, "one 17"), (6, f"{long} what"), (7, f"is 17 23 {long} what"), (8, f"Hello. {long}"), (9, "what is 17 24")]
    items = [(1, "What is 17 * 23?"), (2, "hello"), (3, "one 17 and more than four words")]
    for most in (1_000_000, 0):
        got = decontaminate.contaminated(table(docs, "row long, text string"), table(items, "item_id long, text string"), max_sent=most).collect()
        # A document of the item's length meets it as a template too, as before.
        assert {(r.row, r.item_id, r.changed) for r in got} == {(1, 1, False), (3, 1, False), (4, 1, False), (8, 2, False), (9, 1, True)}


# op4 ---------------------------------------------------------------------------------------


def test_html(session, table):
    model = html_text.fit()
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>'
        '<article><h1>Caf&eacute; &amp; more</h1><p>First  <b>bold</b>\n line<br>goes on.<p>Second &#8211; one.</p><div class="comments"><p>Nice post!</p></div></article>'
        '<aside>Related</aside><form>Search</form><footer>&copy; me</footer>'
    )
    got = html_text.extract(table([(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (3, "v", "", 1)], "page_id long, url string, html string, n_chars int"), model).collect()
    assert got[0].text == "Café & more\nFirst bold line goes on.\nSecond – one." and got[0].n_chars == len(got[0].text)
    assert [(r.text, r.n_chars) for r in got[1:]] == [("", 0)] * 3
    right = total = 0
    for written, labels in html_text.written_pages(120, seed=77):
        found = model.decode(html_text.block_features(html_text.leaf_blocks(written)))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98


def test_training_pages_may_repeat_or_lack_an_id(session, table):
    page = "<html><body><nav>Menu</nav><article><p>Body text of the page goes here.</p></article></body></html>"
    rows = [(1, "u", page)] * 300 + [(None, "u", page), (2, "v", None), (3, None, page), (4, "w", "")]
    pages = table(rows, "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"Body text of the page goes here.", ""}


def test_html_keeps_what_is_not_raw():
    model = html_text.fit()
    head, tail = "<html><body><nav><a href=x>Home</a></nav><article><h1>Heading of the page</h1><p>The first paragraph says this.</p>", "<p>The last paragraph of the article says that.</p></article><footer>&copy; me</footer></body></html>"
    main = lambda inner: html_text.main_text(head + inner + tail, model)
    assert "where x=2 holds" in main("<p>A formula where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds in a line.</p>")
    for tag in ("object", "svg", "math", "noscript", "template", "select"):
        assert main(f"<{tag} class=y><p>Something within that is told here.</p></{tag}>").split("\n")[2:] == ["Something within that is told here.", "The last paragraph of the article says that."], tag
        for unclosed in (f"<{tag}>", f"<{tag} />"):
            assert main(unclosed).split("\n")[1:] == ["The first paragraph says this.", "The last paragraph of the article says that."], tag
    for tag in ("script", "style", "iframe", "textarea"):
        assert main(f"<{tag}>code</{tag}>") == main("") and "The last paragraph of the article says that." in main(f"<{tag}>")


# op5 ---------------------------------------------------------------------------------------


def test_url_rules(session, table):
    urls = {
        "http://A.Example.ORG/es/x?q=/en/": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/2": ("notexample.org", "/en/2", "org/", "allow"),
        "x://b.com/fr/1": ("b.com", "/fr/1", "com/fr/", "allow"),
        "x://b.com/fr": ("b.com", "/fr", None, None),
        "x://b.com?/de/": ("b.com", "", None, None),
        "example.com/de/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, "<a href='http://bad.net/'>", "x") for k, u in enumerate(urls)] + [(90, "http://bad.net/a", None, "x")]
    got = {r.page_id: r for r in url_filter.judge_urls(table(rows, "page_id long, url string, html string, host string")).collect()}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict is None or got[k].verdict == verdict


def test_rule_verdicts(session, table):
    said = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {host + path: what for host, path, what in url_filter.RULES} == said
    rows = [(k, f"http://{rule}" if "example" in rule else f"http://a.{rule}", None) for k, rule in enumerate(said)]
    got = url_filter.judge_urls(table(rows, "page_id long, url string, html string")).collect()
    assert {r.rule: r.verdict for r in got} == said


def test_trust_spreads(session):
    edges = [("good", "a", 1.0), ("a", "b", 2.0), ("c", "bad", 1.0), ("b", "c", 1.0), ("d", "c", 1.0), ("d", "a", 3.0)]
    seeds = [("good", 1.0, 0.0), ("bad", 0.0, 1.0)]
    got = url_filter.spread_trust(session.createDataFrame(edges, "src string, dst string, weight double"), session.createDataFrame(seeds, "host string, good double, bad double"), iterations=6)
    hosts = {h for e in edges for h in e[:2]}
    good, bad = ({h: next((s[k] for s in seeds if s[0] == h), 0.0) for h in hosts} for k in (1, 2))
    trust, distrust = dict(good), dict(bad)
    out, into = collections.Counter(), collections.Counter()
    for s, d, w in edges:
        out[s] += w
        into[d] += w
    for _ in range(6):
        trust = {h: 0.15 * good[h] + 0.85 * sum(trust[s] * w / out[s] for s, d, w in edges if d == h) for h in hosts}
        distrust = {h: 0.15 * bad[h] + 0.85 * sum(distrust[d] * w / into[d] for s, d, w in edges if s == h) for h in hosts}
    for r in got.collect():
        assert math.isclose(r.trust, trust[r.host], abs_tol=1e-12) and math.isclose(r.distrust, distrust[r.host], abs_tol=1e-12)


def test_distrust_reaches_far_and_small(session, table):
    # A chain of 20 links, and shares of 1/2001 taken four times.
    links = [(f"c{k}.net", f"c{k - 1}.net" if k > 1 else "x.com", 1) for k in range(1, 21)]
    links += [(f"d{k}.net", f"d{k - 1}.net" if k > 1 else "x.com", 1) for k in range(1, 5)]
    links += [("noise.net", h, 2000) for h in ("x.com", "d1.net", "d2.net", "d3.net")]
    rows = [(k, f"http://{src}/", f"<a href='http://{dst}/'>" * n) for k, (src, dst, n) in enumerate(links)]
    rows += [(100, "http://x.com/de/", ""), (101, "http://none.net/", "")]
    got = {r.host: r for r in url_filter.judge_urls(table(rows, "page_id long, url string, html string")).collect()}
    assert {h for h, r in got.items() if r.verdict == "allow"} == {"none.net"}
    assert 0 < got["d4.net"].distrust < 1e-12 and got["none.net"].distrust == 0


# op6 ---------------------------------------------------------------------------------------


def test_bpe(session, table):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(2)
    texts = [None, "", "a" * 3000, "Ünïcödé 漢字 🙂🙃 <|endoftext|>", " \n\t  x", "don't we'll 12345 --==", "ab" * 900]
    texts += ["".join(dice.choice("aeioutnsrhl é漢\n.1") for _ in range(dice.randrange(1, 400))) for _ in range(120)]
    docs = table([(k, t, 3) for k, t in enumerate(texts)] + [(1, "", 3)], "doc_id long, text string, n_tokens int")
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    for r in bpe.tokenized(docs, path, public_tokenizers.PATTERN).collect():
        assert r.text == texts[r.doc_id] and r.token_ids == known.encode_ordinary(r.text or "")


# op7 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_sharding(session, table, n):
    rows = [(None if k == 3 else k, None if k == 4 else "same" if k % 3 else f"t{k}", 0) for k in range(n)]
    docs = table(rows, "doc_id long, text string, shard int")
    got = sharding.shards(docs, 8).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shards(docs.repartition(5), 8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))


# op8 ---------------------------------------------------------------------------------------


def test_lm_scores_see_the_order_of_words(session, table):
    clean = "the old man walked down to the river and sat there for a while"
    texts = [(1, clean), (2, clean + " longer"), (3, " ".join(words(5, 9, 9))), (4, ""), (5, None), (6, " \t\r\n "), (7, "The   RIVER\nand é漢"), (7, "The   RIVER\nand é漢"), (8, "q " * 30), (None, "river the to down walked man old the and")]
    got = sorted(lm_score.score_by_words(table(rows_of(texts), DOCS), block_bytes=60, partition_grams=40).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    marked = [(i, ["<s>"] * 3 + t.lower().split()) for i, t in texts if t and t.split()]
    own = [collections.Counter(tuple(w[q - k + 1 : q + 1]) for q in range(2, len(w)) for k in range(4) if k or q) for _, w in marked]
    total = sum(own, collections.Counter())
    want = {}
    for (i, w), mine in zip(marked, own):
        score = 0.0
        for q in range(3, len(w)):
            for k in range(3, 0, -1):
                gram, context = tuple(w[q - k + 1 : q + 1]), tuple(w[q - k + 1 : q])
                if total[gram] > mine[gram]:
                    score += math.log((total[gram] - mine[gram]) / (total[context] - mine[context]))
                    break
                score += math.log(lm_score.BACKOFF)
            else:
                score -= math.log(total[()] + 1)
        want[i] = score
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.log_score, want.get(r.doc_id, 0.0), abs_tol=1e-4) and (r.bits_per_byte is None) == (r.doc_id in (4, 5, 6))
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].bits_per_byte > by_id[1].bits_per_byte + 1
    assert lm_score.score_by_words(table([], DOCS)).count() == 0


# op9 ---------------------------------------------------------------------------------------


def test_exact_dedup(session, table):
    texts = texts_with_copies()
    got = exact_dedup.exact_groups(table(rows_of(texts), DOCS)).collect()
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, last[t or ""], len(groups[t or ""])) for i, t in texts), key=repr)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.without_copies(table(rows_of(texts), DOCS)).count() == len(groups)


# op10 --------------------------------------------------------------------------------------


def test_toxicity(session, tiny):
    docs, labels = session.read.parquet("/root/testdata/sf0.1/documents.parquet"), session.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels, trees=15)
    held = labels.where(toxicity.held_out(labels.doc_id)).select("doc_id", "toxic")
    rows = model.score(docs.select("doc_id", "text")).join(held, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.score >= 0.5 for r in rows if not r.toxic) / len(rows) < 0.01
    odd = session.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 100_000, "x")], "doc_id long, text string, score string")
    assert all(0 <= r._score <= 1 for r in model.score(odd, into="_score").collect())


def test_without_labels_nothing_is_toxic(session, table):
    docs = table(rows_of([(1, "x")]), DOCS)
    none = table([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none).score(docs.select("doc_id", "text")).first().score == 0


# all ---------------------------------------------------------------------------------------


def test_empty_tables(session, table):
    docs = table([], DOCS)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert suffix_dedup.remove_repeats(docs).count() == near_dedup.near_groups(docs).count() == exact_dedup.exact_groups(docs).count() == 0
    assert bpe.round_trip(docs, path, public_tokenizers.PATTERN).count() == lm_score.score_by_words(docs).count() == 0
    assert decontaminate.contaminated(numbered(docs).withColumnRenamed(ROW, "row"), table([], "item_id long, text string")).count() == 0
    pages = table([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == url_filter.judge_urls(pages).count() == 0
