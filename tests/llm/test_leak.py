from __future__ import annotations

import random

from pyspark.sql import functions as F

from weirflow.llm import leak


def test_words_ignore_markup_and_hyphens():
    text = "The \\emph{Quick} bro\\-wn fox~jum-\n%  ped,\\footnotemark{} over {\\it the}\r\n% la-zy dog's"
    assert leak.words(text) == "the quick brown fox jumped over the lazy dog s".split()
    assert leak.words("ＡＢ ﬁne Élan") == ["ab", "fine", "élan"]
    assert leak.words("") == []


def test_chain_needs_order_and_nearness():
    n = 20
    assert leak.chain([(i, i) for i in range(n)]) == (n, 0, n - 1)
    assert leak.chain([(i, n - i) for i in range(n)])[0] == 1
    assert leak.chain([(i * 20, i) for i in range(n)])[0] == 1  # far apart
    assert leak.chain([(i, i) for i in range(n) if i % 3])[0] == len([i for i in range(n) if i % 3])  # words missing
    assert leak.chain([]) == (0, 0, 0)


VOCABULARY = [f"w{i}" for i in range(900)]
STOP = ["the", "of", "and", "to", "in"]
INSTRUCTION = "Read the extract below and choose the claim that follows from it now."


def fixture():
    rng = random.Random(6)
    text = lambda n, voc: [rng.choice(STOP) if rng.random() < 0.3 else rng.choice(voc) for _ in range(n)]
    passages = {i: text(40, VOCABULARY[:500]) for i in range(12)}
    items = []
    for i, p in passages.items():
        head = INSTRUCTION + " " if i % 2 else ""
        tail = " (A) w1 w2 (B) w3 w4" if i % 3 == 0 else ""
        items.append((i, head + " ".join(p).capitalize() + "." + tail))
    items += [(100, ""), (101, None), (102, INSTRUCTION), (103, "too short to be one")]
    noise = lambda n: text(n, VOCABULARY[400:])
    docs, want = [], set()

    def add(words, *leaked):
        d = len(docs)
        docs.append((d, " ".join(words)))
        want.update((d, i) for i in leaked)

    for i, p in passages.items():
        add(noise(100) + p + noise(80), i)  # exact
        add(noise(30) + p[5:27] + noise(30), i)  # a part
        changed = list(p)
        changed[7], changed[20] = "other", "another"
        del changed[30]
        add(noise(50) + changed[:12] + ["inserted"] + changed[12:] + noise(5), i)
        shuffled = list(p)
        rng.shuffle(shuffled)
        add(noise(50) + shuffled + noise(50))
        add(noise(50) + p[10:17] + noise(60) + p[25:32] + noise(50))  # seven words in a row
        add(INSTRUCTION.split() + noise(60))
    add(passages[1] + noise(10) + passages[2], 1, 2)
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "x " * 200_000)]
    return docs, items, want


def test_leaks_match_what_was_planted(spark):
    docs, items, want = fixture()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("clash")).withColumn("positions", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("pos", F.lit("clash"))
    got = leak.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want)
    whole = {(r.doc_id, r.item_id) for r in got if r.exact}
    assert {(6 * k, k) for k in range(12)} <= whole and not any((6 * k + 2, k) in whole for k in range(12))


def test_leaks_without_broadcast(spark, monkeypatch):
    docs, items, want = fixture()
    monkeypatch.setattr(leak, "MAX_BROADCAST_TERMS", 10)
    got = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leak.leaks(docs, items).count() == 0
    assert leak.leaks(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), items).count() == 0


def test_options_are_cut_and_nothing_else():
    cut = lambda t: " ".join(leak.without_options(t).split())
    assert cut("A passage. (A) one two (B) three") == "A passage."
    assert cut("A passage:\n(A) one\n(B) two\n(C) three\nand a remark behind it") == "A passage: and a remark behind it"
    assert cut("Which? (A) one (B) two. The passage goes on here.") == "Which? The passage goes on here."
    assert cut("Which? (A) one (B) " + "w " * 40) == "Which? " + "w " * 27 + "w"  # text behind without a mark: 12 words count as the option
    for text in ("as panels (A) and (B) show", "Only (A) here", "See. (A) and (C) differ", "(B) before. (C) last", ""):
        assert cut(text) == text
    assert cut("(A) x (B) y") == ""


def test_passages_that_items_share_are_kept(spark):
    rng = random.Random(8)
    voc = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    quoted, long = text(50), text(80)
    items = [(i, f"{quoted} Which of these follows {text(5)}") for i in range(3)] + [(10 + i, f"{long} {text(30)}") for i in range(3)]
    items += [(20 + i, f"{INSTRUCTION} {text(30)}") for i in range(3)] + [(30, "Which one? (A) one two (B) three four. " + text(40))]
    docs = [(1, f"{text(90)} {quoted} {text(60)}"), (2, f"{text(30)} {long}"), (3, INSTRUCTION + " " + text(80)), (4, text(20) + " " + items[-1][1].split("four. ")[1])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(d, i).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 10), (2, 11), (2, 12), (4, 30)}
    told = {r.item_id: (r.n_words, r.n_instruction, r.n_options) for r in leak.left_out(i).collect()}
    assert told[0] == (59, 0, 0) and told[10] == (110, 0, 0) and told[20] == (30, 13, 0) and told[30] == (42, 0, 6)


def test_one_index_serves_many_test_sets(spark):
    docs, items, want = fixture()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = leak.stored(leak.postings(d), "index")
    for own in (items[:5], items[5:]):
        i = spark.createDataFrame(own, "item_id bigint, text string")
        got = sorted(map(tuple, leak.leaks(d, i, index).collect()))
        assert got == sorted(map(tuple, leak.leaks(d, i).collect())) and got
    assert {r[:2] for r in sorted(map(tuple, leak.leaks(d, spark.createDataFrame(items, "item_id bigint, text string"), index).collect()))} == want
    # the index holds every word of every text, at its place
    words = {(r.doc_id, p): r.term for r in index.collect() for p in r.positions}
    assert words == {(n, p): w for n, t in docs for p, w in enumerate(leak.words(t or ""))}


def test_long_documents_are_searched_by_region(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(60)]  # every document holds all words somewhere
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    passage = text(40)
    long = text(6000)
    docs = [(1, long[:3000] + passage[:25] + long[3000:]), (2, long), (3, text(200) + [x for w in passage for x in (w, *["gap"] * 8)] + text(300))]
    d = spark.createDataFrame([(n, " ".join(w)) for n, w in docs], "doc_id bigint, text string")
    got = leak.leaks(d, spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, text string")).collect()
    by = {r.doc_id: r for r in got}
    want = {}
    for n, w in docs:
        at = [(i, p) for i, x in enumerate(w) for p, y in enumerate(passage) if x == y]
        want[n] = leak.chain(at)
    assert {n for n, c in want.items() if c[0] >= leak.MIN_WORDS} == set(by)
    assert all((by[n].n_words, by[n].first_word, by[n].last_word) == want[n] for n in by)
    assert by[3].n_words >= 40
