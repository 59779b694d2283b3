from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import spans

SCHEMA = "doc_id bigint, text string"


def brute(docs, length):
    """Spans by comparing all windows of all documents."""
    holders: dict[str, set] = {}
    for d, t in docs:
        for s in range(len(t or "") - length + 1):
            holders.setdefault(t[s : s + length], set()).add(d)
    found = set()
    texts: dict[int, list[str]] = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t or "")
    for d, own in texts.items():
        for t in own:
            open_ = None
            for s in range(len(t) - length + 1):
                if len(holders[t[s : s + length]]) > 1:
                    if open_ and s <= open_[1]:
                        open_[1] = s + length
                    else:
                        if open_:
                            found.add((d, *open_))
                        open_ = [s, s + length]
            if open_:
                found.add((d, *open_))
    return found


def corpus(seed, alphabet="abcdeé漢😀"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randrange(20, 200)) for _ in range(6)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(word(rng.randrange(60)))
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            parts.append(piece[cut : cut + rng.randrange(20, 200)] if rng.random() < 0.7 else piece)
        docs.append((d, "".join(parts)))
    docs += [(40, docs[3][1]), (41, docs[3][1] + word(5)), (42, ""), (43, None), (44, shared[0] * 3), (45, "a" * 300), (46, "a" * 120 + "b"), (47, docs[5][1] + "x" + docs[5][1])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_covered_matches_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA)
    for clash in ("pos", "partner", "seed"):
        df = df.withColumn(clash, F.lit("clash"))
    got = {tuple(r) for r in spans.covered(df, length=40, k=12).collect()}
    assert got == brute(docs, 40) and got


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    docs = [(1, base), (2, base[700:1900]), (3, "z" * 50)]
    whole = {tuple(r) for r in spans.covered(spark.createDataFrame(docs, SCHEMA), length=40, k=12).collect()}
    assert whole == brute(docs, 40)
    a = spans.sample(base, 40, 12)
    monkeypatch.setattr(spans, "PIECE", 256)
    b = spans.sample(base, 40, 12)
    # a seed that stands for windows on both sides of a cut comes twice, the windows once each
    starts = lambda s: {(p, w) for p, lo, hi in zip(*s[:3]) for w in range(lo, hi + 1)}
    assert starts(a) == starts(b)


def test_empty_and_single(spark):
    assert spans.covered(spark.createDataFrame([], SCHEMA), length=40, k=12).count() == 0
    assert spans.covered(spark.createDataFrame([(1, "abc" * 50)], SCHEMA), length=40, k=12).count() == 0
    twice = spark.createDataFrame([(1, "abcdefgh" * 30)] * 2, SCHEMA)  # one document, repeated
    assert spans.covered(twice, length=40, k=12).count() == 0


def test_shares(spark):
    docs = [(1, "q" * 10 + "abcdefghij" * 6), (2, "abcdefghij" * 6), (3, "none")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shares(df, spans.covered(df, length=40, k=12)).collect()}
    assert got == {1: (70, 60), 2: (60, 60)}


def best_chain_scores(positions, others, k):
    """Scores by looking at all pairs."""
    score = []
    for j in range(len(positions)):
        gains = [
            score[i] - spans.GAP_COST * (positions[j] - positions[i] + others[j] - others[i])
            for i in range(j)
            if positions[i] < positions[j] and others[i] < others[j]
        ]
        score.append(k + max([0.0, *gains]))
    return score


def test_chains_take_the_best_way_on():
    rng = random.Random(9)
    for _ in range(30):
        pairs = sorted({(rng.randrange(4000), rng.randrange(4000)) for _ in range(60)} | {(i * 50, 700 + i * 50) for i in range(12)})
        p, o = np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])
        chain = spans.chains(p, o, 64)
        want = best_chain_scores(p.tolist(), o.tolist(), 64)
        starts = {int(c): j for j, c in reversed(list(enumerate(chain)))}
        # a match begins a chain exactly if nothing before it is worth going on from
        assert {j for j, s in enumerate(want) if s == 64} == set(starts.values())
    diagonal = np.arange(10) * 170
    assert set(spans.chains(diagonal, diagonal + 5)) == {0}


def test_hot_classes_are_joined_by_broadcast(spark, monkeypatch):
    from weirflow.operators import skew

    rng = random.Random(3)
    house = "".join(rng.choice("abcdefgh") for _ in range(90))
    docs = [(d, (house if d % 2 else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))) for d in range(80)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute(docs, 40)
    monkeypatch.setattr(skew.join_groups, "__defaults__", (5, 1000))
    assert {tuple(r) for r in spans.covered(df, length=40, k=12).collect()} == want
    monkeypatch.setattr(skew.join_groups, "__defaults__", (5, 2))
    assert {tuple(r) for r in spans.covered(df, length=40, k=12).collect()} == want


def test_passages_follow_changed_copies(spark):
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    changed = list(text[300:1500])
    for i in range(60, 1200, 150):
        changed[i] = "X"
    docs = [(1, text), (2, "y" * 77 + "".join(changed)), (3, "".join(rng.choice("klmnop") for _ in range(900)))]
    found = spans.passages(spark.createDataFrame(docs, SCHEMA), length=100, k=16).collect()
    assert found and {(r.doc_id, r.partner) for r in found} == {(1, 2), (2, 1)}
    longest = max(found, key=lambda r: r.end - r.start)
    assert longest.end - longest.start > 900 and longest.identity > 0.98
    assert all(abs((r.start - r.partner_start) - (223 if r.doc_id == 1 else -223)) == 0 for r in found)


def test_alignment_counts():
    assert spans.aligned("abcdXefgh", "abcdYefgh", [(0, 0), (5, 5)], 4) == 8
    assert spans.aligned("abcdefgh", "abcdefgh", [(0, 0), (2, 2), (4, 4)], 4) == 8
    assert spans.aligned("abcd12efgh", "abcdefgh", [(0, 0), (6, 4)], 4) == 8


def test_passages_link_all_pairs(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text, other, house = word(900), word(900), word(60)
    docs = [(1, word(50) + text), (2, word(80) + text + word(30)), (3, text[:600] + word(70) + other), (4, other + word(9)), (5, text), (6, text)]
    docs += [(d, word(200) + house + word(100)) for d in range(10, 50)]  # short, and in very many documents
    found = spans.passages(spark.createDataFrame(docs, SCHEMA), length=100, k=16).collect()
    of_text = {(a, b) for a in (1, 2, 3, 5, 6) for b in (1, 2, 3, 5, 6) if a != b}
    assert {(r.doc_id, r.partner) for r in found} == of_text | {(3, 4), (4, 3)}
    assert {(r.doc_id, r.partner) for r in found if r.end - r.start > 400} == of_text | {(3, 4), (4, 3)}
    by = dict(docs)
    assert all(by[r.doc_id][r.start : r.end] == by[r.partner][r.partner_start : r.partner_end] for r in found if r.identity == 1)


def test_passages_of_frequent_seeds(spark, monkeypatch):
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = word(400)
    docs = [(d, word(d * 7) + text + word(90)) for d in range(8)] + [(8, text[:60] + word(300))]
    monkeypatch.setattr(spans, "FEW", 2)
    found = spans.passages(spark.createDataFrame(docs, SCHEMA), length=100, k=16).collect()
    assert {(r.doc_id, r.partner) for r in found} == {(a, b) for a in range(8) for b in range(8) if a != b}


def test_passages_of_the_shortest_length_are_found(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    docs, want = [], {}
    for i in range(30):
        shared = word(400 + i * 20)
        changed = list(shared)
        for at in (50, 200, 300)[: i % 4]:
            changed[at] = "X"
        docs += [(2 * i, word(150) + "1" + shared + "2" + word(170)), (2 * i + 1, word(90) + "3" + "".join(changed) + "4" + word(60))]
        want[2 * i, 2 * i + 1] = (151, 151 + len(shared), 91, 91 + len(shared), (len(shared) - i % 4) / len(shared))
    docs += [(98, word(200) + "1" + (short := word(399)) + "2" + word(100)), (99, word(150) + "3" + short + "4" + word(100))]
    found = spans.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r.doc_id, r.partner): (r.start, r.end, r.partner_start, r.partner_end, r.identity) for r in found if r.doc_id < r.partner} == want
    assert len(found) == 2 * len(want)


def test_extension_follows_changes():
    assert spans.extension("abcdefghijXklmnopqrst??", "abcdefghijYklmnopqrst!!") == (21, 21, 20)
    assert spans.extension("abcdefghijklmnopqrst", "abcdefghij12klmnopqrst") == (20, 22, 20)
    assert spans.extension("abcX", "abcY") == (3, 3, 3) and spans.extension("", "abc") == (0, 0, 0)


def test_anchors_of_equal_stretches_are_equal():
    rng = random.Random(31)
    word = lambda n, abc="abcdefgh": "".join(rng.choice(abc) for _ in range(n))
    for length, k in ((40, 12), (60, 16), (50, 40)):
        for i in range(60):
            shared = word(length, "ab" if i % 3 == 0 else "abcdefgh") if i % 5 else "xy" * (length // 2)
            places, steps = [], []
            for _ in range(2):
                before = word(rng.randrange(90))
                found, (pos, to, step) = spans.anchored(before + shared + word(rng.randrange(90)), length, k)
                inside = (pos >= len(before)) & (to + k <= len(before) + length)
                steps.append({(int(p) - len(before), int(t) - len(before), int(s)) for p, t, s in zip(pos[inside], to[inside], step[inside])})
                places.append({int(p) - len(before) for p, lo, hi in zip(*found[:3]) if lo <= len(before) <= hi})
            both = steps[0] & steps[1]
            ends = sorted({p for p, _, _ in both} | {t for _, t, _ in both})
            assert both and ends[-1] - ends[0] + k >= spans.least_span(length, k) and places[0] == places[1] <= set(ends)


def test_layout_stitches_partners():
    a = lambda *x: np.array(x)
    # two partners follow each other without a gap; after a gap the same partner goes on, later another one
    pos, others = spans.layout(a(0, 10, 40, 90), a(10, 25, 55, 99), a(7, 8, 8, 9), a(100, 5, 38, 0))
    assert pos.tolist() == [0, 10, 25, 40, 55, 90, 99]
    assert others[:5].tolist() == [0, 10, 25, 43, 58] and others[5] > 1 << 39 and others[6] - others[5] == 9
    # steps of two texts under one id
    pos, others = spans.layout(a(0, 4, 10, 16), a(10, 16, 22, 30), a(1, 1, 1, 1), a(0, 4, 10, 16))
    assert dict(zip(pos.tolist(), (others - pos).tolist())) == {0: 0, 10: 0, 22: 0, 4: spans._APART, 16: spans._APART, 30: spans._APART}
    assert spans.chains(pos, others).tolist() == [0, 1, 0, 1, 0, 1]


def test_rows_of_one_id_count_as_one_document(spark):
    rng = random.Random(33)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two = word(150), word(120)
    docs = [(1, one), (1, word(20) + two), (1, one), (2, word(31) + one[20:130]), (3, two[10:110])]
    got = {tuple(r) for r in spans.covered(spark.createDataFrame(docs, SCHEMA), length=40, k=12).collect()}
    assert (2, 31, 141) in got and (3, 0, 100) in got and {d for d, _, _ in got} == {1, 2, 3}


def test_spans_lie_in_chains(spark, monkeypatch):
    docs = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA)
    assert brute(docs, 40)
    monkeypatch.setattr(spans, "least_span", lambda length, k: 1 << 30)  # no chain is long enough
    assert spans.covered(df, length=40, k=12).count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(spans, "layout", lambda pos, to, partner, partner_pos: (pos, pos * 0))  # nothing lies in order
    assert spans.covered(df, length=40, k=12).count() == 0
