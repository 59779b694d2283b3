"""The registered text queries on the smallest test data, if that is there."""

from __future__ import annotations

import os

import pytest

from weirflow.llm import leak, queries
from weirflow.sources.tables import table

from .test_spans import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_without_pairing_all_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert df.count() > 0 or name.startswith("p6") and SF.endswith("sf0.001")  # which has no leak


def test_spans_of_whole_texts_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.p8_found(spark, SF).collect()} == brute(docs, 400)


def test_leaks_of_whole_texts_match_brute_force(spark):
    """Chains over all documents and items, without an index."""
    items, want = {}, set()
    for r in leak.passages(table(spark, SF, "eval_items")).collect():
        items.setdefault(r.item_id, []).append((r.pos, r.term))
    for d in table(spark, SF, "documents").select("doc_id", "text").collect():
        at = {}
        for n, w in enumerate(leak.words(d.text or "")):
            at.setdefault(w, []).append(n)
        for item, own in items.items():
            if sum(w in at for _, w in own) >= leak.MIN_WORDS and leak.chain([(n, p) for p, w in own for n in at.get(w, ())])[0] >= leak.MIN_WORDS:
                want.add((d.doc_id, item))
    assert {tuple(r) for r in queries.p6_found(spark, SF).collect()} == want


def test_mix_keeps_to_its_limits(spark):
    limits = {r.source.strip().lower(): (r.target_share, r.max_repeats) for r in table(spark, SF, "mix_targets").collect()}
    rows = queries.p7_mix(spark, SF).collect()
    assert all(r.copies <= limits[r.source][1] for r in rows)
    total = sum(r.n_tokens * r.copies for r in rows)
    there = {r.source for r in rows}
    wanted = sum(limits[s][0] for s in there)
    largest = max(r.n_tokens for r in rows)
    for s in there:
        share = sum(r.n_tokens * r.copies for r in rows if r.source == s) / total
        assert abs(share - limits[s][0] / wanted) <= largest / total
