"""The pipeline keeps what a plain composition of its rules keeps."""

import collections

import corpus_pipeline as pipeline
from test_text_operators import brute_near


def test_stages_follow_their_rules(session, tiny):
    docs = session.read.parquet(f"{tiny}/documents.parquet")
    plain = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pipeline.run(session, tiny).collect()
    kept = {r.doc_id for r in got}
    from twintrail.llm.common import hold

    clean = {r.doc_id for r in hold(pipeline.drop_toxic(session, docs, tiny)).select("doc_id").collect()}
    last = collections.defaultdict(int)
    for i in clean:
        last[plain[i]] = max(last[plain[i]], i)
    single = set(last.values())
    apart = {i for i, _, c in brute_near(sorted((i, plain[i]) for i in single)) if i == c}
    words = lambda t: " ".join(t.lower().split())
    items = [words(r.text) for r in session.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    leaks = {i for i in apart if any(item in words(plain[i]) for item in items)}
    assert kept == apart - leaks
    assert set(docs.columns) <= set(got[0].asDict())
    assert all(r.text == plain[r.doc_id] and len(r.token_ids) == r.n_tokens for r in got)
    assert len(pipeline.STAGES) == 5
