"""Problem 6: evaluation texts leaking into training text.

A positional inverted index of the corpus is written to shared storage: term, document, positions. An
index of all terms serves any number of test sets (`leaks(index=...)`); for one test set alone only the
postings of its terms are stored. Test passages are answered from the index, from their rarest terms: a case
holds MIN_WORDS words of a passage in order and in one place, of which all but RARE_HITS can be among the
passage's commonest words, so so many of the rarer ones must hit in one region of a document. There
the position lists are intersected, adjusted by the offset in the passage, with room for changed,
added and missing words.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.batches import small
from weirflow.operators.skew import join_groups
from weirflow.sources.tables import stored

MIN_WORDS = 18  # words of a passage, in order and in one place, that make a case
RARE_HITS = 3  # of these, at least so many must be among the terms that are looked up: with fewer there are more candidates, with more also commoner terms
MAX_GAP = 8  # words that may lie between two words that follow each other in a match
SHARED_BY = 3  # items that share eight words in a row have them from an instruction
INSTRUCTION_WORDS = 8
MOST_INSTRUCTION_WORDS = 60  # longer stretches that items share are passages that several items quote
REGION = 256  # words; a region of a document is two of these, so that MIN_WORDS words with gaps of MAX_GAP lie in one
MAX_BROADCAST_TERMS = 500_000  # beyond so many different test terms the index isn't restricted on the way in

_SPLIT_WORD = re.compile(r"(?<=\w)(?:\\-|[-\u00ad\u2010\u2011])(?:[ \t]*[\r\n]+[ \t%]*)?(?=\w)")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_WORD = re.compile(r"[^\W_]+")
_OPTION = re.compile(r"(?<!\S)\(([A-Z])\)(?!\S)")
_END = re.compile(r"[.?!](?=\s)|[\r\n]")


def words(text: str) -> list[str]:
    """The words of a text: lower case, hyphenated ones joined, without markup commands, comment marks and punctuation."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", _SPLIT_WORD.sub("", text))
    elif "-" in text or not text.isascii():
        text = _SPLIT_WORD.sub("", text)
    return _WORD.findall(text.lower())


def without_options(text: str) -> str:
    """The text without its answer options: "(A)" at the beginning of a line or sentence, and "(B)" and so on after it.

    An option ends at the next one, the last one with its line or sentence, or when it is three times as long as the longest other
    one and 12 words; text that goes on behind the options stays.
    """
    markers = list(_OPTION.finditer(text))
    for i, first in enumerate(markers):
        before = text[: first.start()].rstrip(" \t")
        if first[1] != "A" or before and before[-1] not in ".?!:\r\n":
            continue
        run = [first]
        for m in markers[i + 1 :]:
            if ord(m[1]) != ord(run[-1][1]) + 1:
                break
            run.append(m)
        if len(run) < 2:
            continue
        longest = max(len(text[a.end() : b.start()].split()) for a, b in zip(run, run[1:]))
        rest = text[run[-1].end() :]
        end = _END.search(rest, len(rest) - len(rest.lstrip()))
        most = list(re.finditer(r"\S+", rest))[: max(12, 3 * longest)]
        stop = min(end.end() if end else len(rest), most[-1].end() if most else 0)
        return text[: first.start()] + " " + without_options(rest[stop:])
    return text


def postings(documents: DataFrame, terms: frozenset[str] | None = None) -> DataFrame:
    """The positional index: term, doc_id, positions (word numbers from 0), one row per term of a document.

    Whole texts are indexed. `terms` restricts the index to the terms that will be looked up. Null
    and empty texts give no row.
    """
    schema = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            at, docs, lists = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if not text or doc is None:
                    continue
                found: dict[str, list[int]] = defaultdict(list)
                if terms is None:
                    for i, w in enumerate(words(text)):
                        found[w].append(i)
                else:
                    for i, w in enumerate(words(text)):
                        if w in terms:
                            found[w].append(i)
                at += found.keys()
                docs += [doc] * len(found)
                lists += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((at, docs, lists), schema)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(index, "term string, doc_id bigint, positions array<int>")


def _tokens(items: DataFrame) -> DataFrame:
    """Words of the items, without answer options: item_id, pos, term, run (the words from here on that an instruction has in a row at least), n_all (words with the options)."""
    k = INSTRUCTION_WORDS
    fields = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                own, every = words(without_options(text or "")), len(words(text or ""))
                rows += [(item, i, w, " ".join(own[i : i + k]) if i + k <= len(own) else None, every) for i, w in enumerate(own)]
            columns = zip(*rows) if rows else ([] for _ in fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields)], names=["item_id", "pos", "term", "run", "n_all"])

    return items.where("item_id is not null").select("item_id", "text").mapInArrow(split, "item_id bigint, pos int, term string, run string, n_all int")


def _instructions(tokens: DataFrame) -> DataFrame:
    """Words of instructions: item_id, pos.

    A stretch of words that SHARED_BY items share, INSTRUCTION_WORDS in a row or more, is an instruction only at an
    item's beginning or end, up to MOST_INSTRUCTION_WORDS long, and beside words of the item's own that are
    enough for a case. Else it is a passage that several items quote, and stays.
    """
    k, item = INSTRUCTION_WORDS, Window.partitionBy("item_id")
    shared = tokens.where("run is not null").groupBy("run").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= SHARED_BY)
    covered = tokens.join(shared, "run").select("item_id", F.explode(F.sequence("pos", F.col("pos") + k - 1)).alias("pos")).distinct()
    stretch = covered.withColumn("stretch", F.col("pos") - F.row_number().over(item.orderBy("pos")))
    edges = stretch.groupBy("item_id", "stretch").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    edges = edges.join(tokens.groupBy("item_id").agg(F.count("*").alias("length")), "item_id").withColumn("n", F.col("last") - F.col("first") + 1)
    edges = edges.where(((F.col("first") == 0) | (F.col("last") == F.col("length") - 1)) & (F.col("n") <= MOST_INSTRUCTION_WORDS))
    edges = edges.withColumn("own", F.col("length") - F.sum("n").over(item)).where(F.col("own") >= MIN_WORDS)
    return edges.select("item_id", F.explode(F.sequence("first", "last")).alias("pos"))


def passages(items: DataFrame) -> DataFrame:
    """The items' own words: item_id, pos, term. Answer options and instructions that several items share are left out (see left_out)."""
    tokens = _tokens(items)
    return tokens.select("item_id", "pos", "term").join(_instructions(tokens), ["item_id", "pos"], "left_anti")


def left_out(items: DataFrame) -> DataFrame:
    """What is not looked for, for every item with words: item_id, n_words (of its passage), n_instruction and n_options (words left out as such)."""
    tokens = _tokens(items)
    counts = tokens.groupBy("item_id").agg(F.count("*").alias("n"), F.max("n_all").alias("n_all"))
    gone = _instructions(tokens).groupBy("item_id").agg(F.count("*").alias("gone"))
    return counts.join(gone, "item_id", "left").select(
        "item_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n_words"), F.coalesce("gone", F.lit(0)).alias("n_instruction"), (F.col("n_all") - F.col("n")).alias("n_options")
    )


def chain(matches: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(words, first, last) of the longest run of (document position, passage position) that rises in both, with gaps of up to MAX_GAP words."""
    matches.sort()
    best: list[int] = []
    begun: list[int] = []
    at = [d for d, _ in matches]
    top = (0, 0, 0)
    for j, (d, p) in enumerate(matches):
        n, start = 0, d
        for i in range(bisect_left(at, d - MAX_GAP - 1), j):
            if at[i] < d and best[i] > n and 0 < p - matches[i][1] <= MAX_GAP + 1:
                n, start = best[i], begun[i]
        best.append(n + 1)
        begun.append(start)
        if n + 1 > top[0]:
            top = (n + 1, start, d)
    return top


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, item, length, hits in zip(*(batch[c].to_pylist() for c in ("doc_id", "item_id", "length", "hits"))):
            found = [(d, h["pos"]) for h in hits for d in h["positions"]]
            n, first, last = chain(found)
            if n >= MIN_WORDS:
                # Word for word: one offset that all words of the passage have.
                exact = n == length and length in Counter(d - p for d, p in set(found)).values()
                rows.append((doc, item, n, first, last, exact))
        columns = zip(*rows) if rows else [[] for _ in range(6)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "n_words", "first_word", "last_word", "exact"])


def candidates(index: DataFrame, rare: DataFrame, bounded: bool) -> DataFrame:
    """Documents in one region of which RARE_HITS of an item's rarer words stand: doc_id, item_id, first and last such region.

    `rare` has item_id, pos, term and df. Regions overlap by half, so what lies in one place lies in one of them.
    """
    here = F.transform("positions", lambda d: F.floor(d / REGION).cast("int"))
    regions = F.array_distinct(F.concat(here, F.transform(here, lambda r: r - 1)))
    held = index.select("term", "doc_id", "positions")
    # Unbounded test sets: common terms by a checked broadcast, others by a shuffle.
    found = held.join(F.broadcast(rare), "term") if bounded else join_groups(held, rare, ["term"], "df")
    by = found.select("doc_id", "item_id", F.explode(regions).alias("region")).groupBy("doc_id", "item_id", "region").agg(F.count("*").alias("hits"))
    return by.where(F.col("hits") >= RARE_HITS).groupBy("doc_id", "item_id").agg(F.min("region").alias("first"), F.max("region").alias("last"))


def leaks(documents: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Documents that hold a passage: doc_id, item_id, n_words matched, first_word and last_word in the document, exact (the whole passage, word for word).

    One row per document and item, of the longest match. `index` has the postings of all terms of the
    documents, stored (see postings); without it those of the items' terms are made and stored here.
    Repeated documents rows of one id count as
    one document whose positions lie over each other. Items of fewer than MIN_WORDS own words, null
    and empty texts never match; empty tables give an empty result.
    """
    small(documents.sparkSession)
    own = stored(passages(items), "passages")
    # The test set is a bounded query set; if it isn't, the index takes all terms and joins shuffle.
    bounded = own.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    if index is None:
        terms = frozenset(r.term for r in own.select("term").distinct().toLocalIterator()) if bounded else None
        index = stored(postings(documents, terms), "postings")

    wanted = own.select("term").distinct()
    frequency = index.join(F.broadcast(wanted) if bounded else wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("item_id").orderBy("df", "term", "pos")
    of_item = Window.partitionBy("item_id")
    ranked = (
        own.join(frequency, "term")
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("held", F.count("*").over(of_item))
        .join(own.groupBy("item_id").agg(F.count("*").alias("length")), "item_id")
        .where(F.col("held") >= MIN_WORDS)
    )
    ranked = stored(ranked, "ranked")
    rare = ranked.where(F.col("rank") <= F.col("held") - (MIN_WORDS - RARE_HITS)).select("item_id", "pos", "term", "df")
    passage = ranked.select("item_id", "pos", "term", "length")
    # A match reaches beyond its region by the passage's words and their gaps at most.
    reach = F.col("length") * (MAX_GAP + 1)
    near = F.filter("positions", lambda d: (d >= F.col("first") * REGION - reach) & (d < (F.col("last") + 2) * REGION + reach))
    hits = (
        candidates(index, rare, bounded).join(F.broadcast(passage) if bounded else passage, "item_id")
        .join(index, ["doc_id", "term"])
        .groupBy("doc_id", "item_id", "length")
        .agg(F.collect_list(F.struct("pos", near.alias("positions"))).alias("hits"))
    )
    return hits.mapInArrow(_verified, "doc_id bigint, item_id bigint, n_words int, first_word int, last_word int, exact boolean")
