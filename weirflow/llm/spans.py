"""Problem 8: long exact spans shared between records.

Every window of `length` characters is represented by one k-mer in it, its smallest by hash, so two
equal windows have the same seed at the same place, and every shared stretch of that length holds a
shared seed. Anchors are such seeds of shorter windows: a shared stretch holds two of them at
least, so the steps from one anchor to the next (both seeds and their distance) are joined by hash,
each with one partner in another document (linear in the size of a group, never all its pairs).
Matched anchors that lie in order are chained with gap costs through a Fenwick tree. Only what lies in a
chain as long as the anchors of a shared stretch must be goes on to the exact check, which compares
windows by content, over all documents, in shrinking blocks.
Fuzzy passages (`passages`) are chained for every pair of documents instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.batches import small
from weirflow.operators.skew import join_groups
from weirflow.sources.tables import stored

LENGTH = 400  # characters of the shortest stretch
K = 64  # characters of a seed
PIECE = 1 << 20  # windows of a text handled at once, so that memory doesn't grow with the text
GAP_COST = 0.05  # score lost per character skipped in either document; a seed gains K
_PLACE = 28  # bits for a position within a piece, below the bits of the hash
# Odd multipliers of two independent rolling hashes modulo 2**64, and their inverses.
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, extended as longer texts come."""

    def __init__(self, base: np.uint64):
        self._roots = (int(base), pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self._roots[0], m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self._roots[1], m, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers: list[_Powers] = []


def _prefix(codes: np.ndarray, which: int) -> np.ndarray:
    """Hash of every prefix of the text."""
    if not _powers:
        _powers.extend(_Powers(b) for b in _BASES)
    up, _ = _powers[which].upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return sums


def _hashes(prefix: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings from starts to ends, equal for equal content wherever it stands; well mixed."""
    _, down = _powers[which].upto(len(prefix))
    x = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint64)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(rows, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _minimizers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest seed of every window of so many seeds, of equal ones the first."""
    key = (seeds >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(seeds)).astype(np.uint64)
    return (_sliding_min(key, window) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def _pieces(text: str, length: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(where it begins, hashes of its prefixes, hashes of its k-mers) of each piece of a text; every window of `length` lies in one."""
    for begin in range(0, max(0, len(text) - length + 1), PIECE):
        prefix = _prefix(_codes(text[begin : begin + PIECE + length - 1]), 0)
        at = np.arange(len(prefix) - k)
        yield begin, prefix, _hashes(prefix, 0, at, at + k)


def _sampled(begin: int, prefix: np.ndarray, seeds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    chosen = _minimizers(seeds, length - k + 1)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(chosen)) - 1
    pos = chosen[first]
    context = _hashes(prefix, 0, first, last + length) ^ _mixed(pos - first)
    return pos + begin, first + begin, last + begin, seeds[pos].view(np.int64), context.view(np.int64)


def _joined(parts: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(n))


def sample(text: str, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Seeds of a text: (pos, lo, hi, seed, context).

    `pos` is where the seed stands; lo to hi are the starts of the windows that it represents;
    `context` hashes all that these windows cover, and where the seed stands in it. Texts shorter
    than `length` have none.
    """
    return _joined([_sampled(*piece, length, k) for piece in _pieces(text, length, k)], 5)


def anchor_run(length: int, k: int) -> int:
    """Characters in each run of which an anchor stands: half of `length`, so that a stretch of `length` holds two anchors at least."""
    return max(k, length // 2)


def least_span(length: int, k: int) -> int:
    """Characters that the anchors inside a stretch of `length` span at least: the first begins by the end of the stretch's first run, the last not before its last run."""
    return length - 2 * anchor_run(length, k) + 2 * k


def anchored(text: str, length: int = LENGTH, k: int = K) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(seeds as of `sample`, steps from each anchor to the next: pos, next, step).

    Anchors are the smallest k-mers of each run (see anchor_run); all seeds are among them. `step`
    hashes both anchors and their distance.
    """
    sampled, anchors = [], []
    for begin, prefix, seeds in _pieces(text, length, k):
        sampled.append(_sampled(begin, prefix, seeds, length, k))
        chosen = np.unique(_minimizers(seeds, anchor_run(length, k) - k + 1))
        anchors.append((chosen + begin, seeds[chosen]))
    pos, seed = (np.zeros(0, np.int64), np.zeros(0, np.uint64)) if not anchors else (np.concatenate(c) for c in zip(*anchors))
    pos, once = np.unique(pos, return_index=True)
    seed = seed[once]
    step = _mixed(seed[:-1] * np.uint64(0xD1342543DE82EF95) + (seed[1:] ^ (seed[1:] >> np.uint64(32))) * np.uint64(0xAEF17502108EF2D9) + _mixed(np.diff(pos)))
    return _joined(sampled, 5), (pos[:-1], pos[1:], (step * np.uint64(0x7FB5D329728EA185) ^ (step >> np.uint64(31))).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as well mixed ones of 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _rows(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def seeds(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Sampled seeds of all whole texts: doc_id, pos, lo, hi, seed, context (see sample). Null texts and ids give none."""
    names, types = ["doc_id", "pos", "lo", "hi", "seed", "context"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[list[np.ndarray]] = [[] for _ in names]
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    if doc is None or not text:
                        continue
                    found = sample(text, length, k)
                    for c, v in zip(out, (np.full(len(found[0]), doc, np.int64), *found)):
                        c.append(v)
                if out[0]:
                    yield _rows([np.concatenate(c) for c in out], types, names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, pos int, lo int, hi int, seed bigint, context bigint")


def _classes(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per keys the smallest and the largest (doc_id, at) and the number of rows; sums up before the shuffle, so large classes cost no more than small ones."""
    here = F.struct("doc_id", at)
    return df.groupBy(*keys).agg(F.min(here).alias("one"), F.max(here).alias("other"), F.count("*").alias("n_rows"))


def anchors(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Seeds (doc_id, pos, lo, hi, seed, context) and steps between anchors (doc_id, pos, next, step; see anchored) of all whole texts, each with the other's columns null."""
    names = ["doc_id", "pos", "lo", "hi", "seed", "context", "next", "step"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[list[np.ndarray]] = [[] for _ in range(9)]
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    if doc is None or not text:
                        continue
                    found, steps = anchored(text, length, k)
                    docs = [np.full(len(c[0]), doc, np.int64) for c in (found, steps)]
                    for c, v in zip(out, (docs[0], *found, *steps)):
                        c.append(v)
                    out[0].append(docs[1])
                if not out[0]:
                    continue
                docs, pos, lo, hi, seed, context, at, to, step = (np.concatenate(c) for c in (out[0][::2], *out[1:]))
                n, m = len(pos), len(at)
                null = lambda size, t: pa.nulls(size, t)
                whole = [pa.concat_arrays([pa.array(a, t), null(m, t)]) for a, t in zip((lo, hi, seed, context), types[2:6])]
                ends = [pa.concat_arrays([null(n, t), pa.array(a, t)]) for a, t in zip((to, step), types[6:])]
                both = [pa.array(np.concatenate([docs, *out[0][1::2]]), types[0]), pa.array(np.concatenate([pos, at]), types[1])]
                yield pa.RecordBatch.from_arrays([*both, *whole, *ends], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, pos int, lo int, hi int, seed bigint, context bigint, next int, step bigint")


def matches(steps: DataFrame) -> DataFrame:
    """Steps between anchors that another document takes too, each with one partner: adds partner and partner_pos.

    The partner is the document with the smallest id that takes the step, and for that one the document
    with the largest.
    """
    by = steps.groupBy("step").agg(
        F.min("doc_id").alias("one"), F.min_by("pos", "doc_id").alias("one_pos"), F.max("doc_id").alias("other"), F.max_by("pos", "doc_id").alias("other_pos"), F.count("*").alias("n_rows")
    )
    held = join_groups(steps, stored(by.where("one <> other"), "shared"), ["step"], "n_rows")
    first = F.col("doc_id") == F.col("one")
    return held.select("doc_id", "pos", "next", F.when(first, F.col("other")).otherwise(F.col("one")).alias("partner"), F.when(first, F.col("other_pos")).otherwise(F.col("one_pos")).alias("partner_pos"))


def _previous(positions: np.ndarray, others: np.ndarray, k: float | np.ndarray) -> tuple[list[int], list[float]]:
    """The match that each match goes on from, -1 where it starts a chain, and its score (see chains). k: what each match gains."""
    gains = np.broadcast_to(k, len(positions)).tolist()
    order = np.unique(others)
    ranks = (np.searchsorted(order, others) + 1).tolist()
    positions, others = positions.tolist(), others.tolist()
    n, top = len(positions), len(order)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (top + 1)
    score, before = [0.0] * n, [-1] * n
    pending: list[int] = []
    for j in range(n):
        if j and positions[j] != positions[j - 1]:  # matches at one position can't follow each other
            for i in pending:
                r, value = ranks[i], (score[i] + GAP_COST * (positions[i] + others[i]), i)
                while r <= top:
                    if tree[r] < value:
                        tree[r] = value
                    r += r & -r
            pending = []
        best, r = (-np.inf, -1), ranks[j] - 1
        while r:
            best = max(best, tree[r])
            r &= r - 1
        gain = best[0] - GAP_COST * (positions[j] + others[j])
        if gain > 0:
            score[j], before[j] = gain + gains[j], best[1]
        else:
            score[j] = gains[j]
        pending.append(j)
    return before, score


def chains(positions: np.ndarray, others: np.ndarray, k: float = K) -> np.ndarray:
    """Chain number of every match (position in one text, position in the other), sorted by position.

    A chain rises in both texts. Of all ways to go on from earlier matches each match takes the best
    score, k per match less GAP_COST per character skipped in either text; the Fenwick tree keeps the
    best score over all smaller positions in the other text. A match that gains nothing starts a chain.
    """
    chain, made = np.zeros(len(positions), np.int64), 0
    for j, i in enumerate(_previous(positions, others, k)[0]):
        chain[j] = made if i < 0 else chain[i]
        made += i < 0
    return chain


def branches(positions: np.ndarray, others: np.ndarray, k: float | np.ndarray = K) -> list[list[int]]:
    """The chains as lists of matches that rise in both texts; where several matches go on from one, the best way keeps the chain and each other one begins at the fork."""
    before, score = _previous(positions, others, k)
    used, found = [False] * len(before), []
    for j in sorted(range(len(before)), key=lambda j: -score[j]):
        path: list[int] = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        if path:
            found.append(([j] if j >= 0 else []) + path[::-1])
    return found


_APART = 1 << 40  # between parts of a layout that no chain can bridge


def _components(pos: list[int], to: list[int]) -> dict[int, int]:
    """Smallest anchor of those that each anchor is tied to by steps."""
    up = {x: x for x in (*pos, *to)}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pos, to):
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def layout(pos: np.ndarray, to: np.ndarray, partner: np.ndarray, partner_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a document's matched steps, and where they stand in the partners' texts stitched together: (positions, others).

    Steps that follow each other may have different partners; their texts are stitched at the anchor that both
    have. After a gap the text goes on where the partner does, if it is the same one and lies further on, else far away.
    Steps overlap only where rows of one id have different texts; then each text goes on by itself.
    """
    _, order = np.unique(pos << 32 | to, return_index=True)
    pos, to, partner, partner_pos = pos[order], to[order], partner[order], partner_pos[order]
    if (to[:-1] > pos[1:]).any():
        tied = _components(pos.tolist(), to.tolist())
        positions = np.array(sorted(tied))
        _, number = np.unique([tied[x] for x in positions.tolist()], return_inverse=True)
        return positions, positions + number * _APART
    gap = pos[1:] - to[:-1]
    onward = partner_pos[1:] - partner_pos[:-1] - (to - pos)[:-1]
    leap = np.where(gap == 0, 0, np.where((partner[1:] == partner[:-1]) & (onward > 0), onward, _APART))
    start = np.cumsum(np.append(0, (to - pos)[:-1] + leap))
    positions, at = np.unique(np.concatenate([pos, to]), return_index=True)
    return positions, np.concatenate([start, start + to - pos])[at]


def chained(held: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Chains of matched anchors that are long enough for a shared stretch (see least_span): doc_id, first, last (positions of anchors).

    A document's matches come together in one task; their number is bounded by the document's own
    length. The anchors inside a shared stretch follow each other step by step in both documents, so they
    are in one chain.
    """
    run = anchor_run(length, k)
    gain, least = max(k, 4 * GAP_COST * (run - k + 1)), least_span(length, k)
    fields = ["pos", "next", "partner", "partner_pos"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            docs, firsts, lasts = [], [], []
            spots = batch["steps"]
            columns = [spots.values.field(i).to_numpy(zero_copy_only=False) for i in range(len(fields))]
            offsets = spots.offsets.to_numpy()
            for doc, a, b in zip(batch["doc_id"].to_pylist(), offsets, offsets[1:]):
                positions, others = layout(*(c[a:b].astype(np.int64) for c in columns))
                if positions[-1] - positions[0] + k < least:
                    continue
                chain = chains(positions, others, gain)
                for number in range(int(chain.max()) + 1):
                    own = np.flatnonzero(chain == number)
                    if min(positions[own[-1]] - positions[own[0]], others[own[-1]] - others[own[0]]) + k >= least:
                        docs.append(doc)
                        firsts.append(positions[own[0]])
                        lasts.append(positions[own[-1]])
            yield _rows([docs, firsts, lasts], [pa.int64(), pa.int32(), pa.int32()], ["doc_id", "first", "last"])

    grouped = held.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("steps"))
    return grouped.mapInArrow(kept, "doc_id bigint, first int, last int")


def chained_seeds(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """The seeds (see sample) that stand among the anchors of a long enough chain, and with them all windows that may be shared."""
    if not k < length:
        raise ValueError("seeds must be shorter than the stretches that are looked for")
    found = stored(anchors(documents, length, k), "anchors")
    held = stored(matches(found.where("step is not null").select("doc_id", "pos", "next", "step")), "matches")
    by = chained(held, length, k).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("chains"))
    seeds = found.where("seed is not null").select("doc_id", "pos", "lo", "hi", "seed", "context").join(by, "doc_id")
    return seeds.where(F.exists("chains", lambda c: F.col("pos").between(c["first"], c["last"]))).drop("chains")


BLOCK = 16  # windows in a block of the exact check


def _blocks(spots: DataFrame, documents: DataFrame, length: int) -> DataFrame:
    """Windows of the spots in blocks: doc_id, seed, start (of the block's first window), inner, outer, windows.

    Blocks are cut by the distance of a window's start to its seed, so equal windows lie in blocks of
    one number in every document. `inner` hashes what all windows that a block can have hold in
    common, `outer` all that those which it has cover, `windows` each of them.
    """
    names = ["doc_id", "seed", "start", "inner", "outer", "windows"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spots"].to_pylist()):
                found = []
                for first, last, seed, pos in ((s["lo"], s["hi"], s["seed"], s["pos"]) for s in own):
                    prefix = _prefix(_codes(text[first : last + length]), 1)
                    top = pos - first - np.arange((pos - last) // BLOCK, (pos - first) // BLOCK + 1) * BLOCK  # last start that fits each block
                    begin, end = np.maximum(top - BLOCK + 1, 0), np.minimum(top, last - first)
                    at = np.arange(last - first + 1)
                    windows = _hashes(prefix, 1, at, at + length).view(np.int64)
                    inner = _hashes(prefix, 1, np.maximum(top, 0), top - BLOCK + 1 + length).view(np.int64)
                    outer = _hashes(prefix, 1, begin, end + length).view(np.int64)
                    found += [(doc, seed, first + int(b), int(i), int(o), windows[b : e + 1]) for b, e, i, o in zip(begin, end, inner, outer)]
                if found:
                    yield _rows(list(zip(*found)), types, names)

    wanted = spots.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "seed", "pos")).alias("spots"))
    texts = documents.where(F.length("text") >= length).select("doc_id", "text").join(wanted, "doc_id")
    return texts.mapInArrow(run, "doc_id bigint, seed bigint, start int, inner bigint, outer bigint, windows array<bigint>")


def _judged(df: DataFrame, content: str, at: str) -> DataFrame:
    """Adds `full`, whether another document has the same (seed, content), and `open`, whether the row is to be looked at in parts.

    Open are the rows that are not full, and of each class of full ones two rows of different
    documents that stand for it, since what is not full may still share parts with it.
    """
    classes = stored(_classes(df, ["seed", content], at), "classes")
    some = join_groups(df, classes, ["seed", content], "n_rows").withColumn("full", F.col("one.doc_id") != F.col("other.doc_id"))
    here = F.struct("doc_id", at)
    return some.withColumn("open", ~F.col("full") | (here == F.col("one")) | (here == F.col("other"))).drop("one", "other", "n_rows")


def _with_unresolved(judged: DataFrame, key: list[str]) -> DataFrame:
    """Open rows of keys under which some row is not full."""
    return judged.where("open").join(judged.where("not full").select(*key).distinct(), key, "left_semi")


def merged(intervals: DataFrame) -> DataFrame:
    """Disjoint spans (doc_id, span_start, span_end) of the intervals of each document; such that overlap or touch become one."""
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        intervals.withColumn("reach", reach)
        .withColumn("island", F.sum(F.when(F.col("reach") >= F.col("span_start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        .drop("island")
    )


def covered(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Parts of documents that stand verbatim, `length` characters or more, in another one: doc_id, span_start, span_end.

    Positions count characters from 0, the end is exclusive. Repeats within one document are no
    case; nor are null and empty texts and texts shorter than `length`. Rows that repeat a doc_id
    count as one document. An empty table gives an empty result.
    """
    small(documents.sparkSession)
    spots = stored(chained_seeds(documents, length, k), "chained")
    spots = stored(_judged(spots, "context", "lo"), "spots")
    span = lambda start, windows: [F.col(start).cast("bigint").alias("span_start"), (F.col(start) + windows + length).cast("bigint").alias("span_end")]
    of_spots = spots.where("full").select("doc_id", *span("lo", F.col("hi") - F.col("lo")))

    blocks = stored(_blocks(_with_unresolved(spots, ["seed"]), documents, length), "blocks")
    keys = blocks.select("doc_id", "seed", "start", "inner", "outer", F.size("windows").alias("n"))
    common = stored(_classes(keys, ["seed", "inner"], "start").where("one.doc_id <> other.doc_id").select("seed", "inner", "n_rows"), "common")
    some = stored(join_groups(keys, common, ["seed", "inner"], "n_rows").drop("n_rows"), "candidates")
    some = stored(_judged(some, "outer", "start"), "judged")
    of_blocks = some.where("full").select("doc_id", *span("start", F.col("n") - 1))

    rest = _with_unresolved(some, ["seed", "inner"]).select("doc_id", "seed", "start")
    single = (
        blocks.select("doc_id", "seed", "start", "windows")
        .join(rest, ["doc_id", "seed", "start"])
        .select("doc_id", "seed", F.col("start").alias("first"), F.posexplode("windows").alias("i", "window"))
    )
    single = stored(single.select("doc_id", "seed", (F.col("first") + F.col("i")).alias("start"), "window"), "windows")
    of_windows = _judged(single, "window", "start").where("full").select("doc_id", *span("start", F.lit(0)))
    return merged(of_spots.unionByName(of_blocks).unionByName(of_windows))


def shares(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document with a shared span: doc_id, n_chars, shared_chars and share."""
    by = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    lengths = documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    return by.join(lengths, "doc_id").withColumn("share", F.col("shared_chars") / F.col("n_chars"))


FEW = 16  # occurrences of a seed up to which all pairs of them are made
DENSER = 4  # shared runs of a passage's length by this hold a seed
OUTER = 2  # the seeds of a passage span its length by this, before it is extended
SKIP, RESUME = 8, 8  # characters that an extension may skip in a text, and that must be equal after it, at least; twice as many as skipped


def _gain(length: int, k: int) -> float:
    """What a chain gains per character that its seeds cover, so that it bridges as much as with one seed in each window of `length`."""
    return 2 * k / (length - k + 2)


def _gains(at: list[tuple[int, int]], k: int) -> np.ndarray:
    """Characters that each match covers and the one before on its diagonal doesn't."""
    last: dict[int, int] = {}
    found = np.full(len(at), k)
    for i, (p, q) in enumerate(at):
        found[i] = min(k, p - last.get(p - q, p - k))
        last[p - q] = p
    return found


def _ends(hot: DataFrame, least: int, k: int, gain: float) -> DataFrame:
    """Pairs of seeds between which a text can have a chain of `least` characters made of these seeds alone: text_id, a, b.

    A chain's score stays above that of its last seed, so its gaps cost less than its other seeds gain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch["text_id"].to_pylist(), batch["own"].to_pylist()):
                pos, seed = np.array([x["pos"] for x in own]), np.array([x["seed"] for x in own], np.int64)
                for i in range(len(pos)):
                    apart = pos[i + 1 :] - pos[i]
                    fits = (apart + k >= least) & (GAP_COST * (apart + least - k) < gain * k * np.arange(1, len(apart) + 1))
                    if fits.any():
                        b = np.unique(seed[i + 1 :][fits])
                        yield _rows([np.full(len(b), text), np.full(len(b), seed[i]), b], [pa.int64()] * 3, ["text_id", "a", "b"])

    by = hot.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seed"))).alias("own"))
    return by.mapInArrow(run, "text_id bigint, a bigint, b bigint").distinct()


def _paired(left: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each two rows with the same keys, of different texts once, of one text where that has copies; adds partner and partner_<column>."""
    right = left.select(*keys, F.col("text_id").alias("partner"), *(F.col(c).alias(f"partner_{c}") for c in columns))
    return left.join(right, keys).where("text_id < partner or (text_id = partner and twin)").drop("twin")


def pair_matches(texts: DataFrame, least: int, run: int, gain: float, k: int = K) -> DataFrame:
    """Shared seeds, one in each `run` characters, of all pairs of texts that can have a chain of `least`: text_id, partner, pos, partner_pos.

    `texts` has text_id and text, one row per copy. A pair comes once, the smaller id first; a text is
    its own partner if it has copies. Seeds with FEW occurrences are paired as they are. The others
    pair texts only where two of them can be the ends of a chain; a pair that is found
    either way then gets all of them.
    """
    found = seeds(texts.select(F.col("text_id").alias("doc_id"), "text"), run, k).select("seed", F.col("doc_id").alias("text_id"), "pos")
    found = found.repartition("seed").groupBy("seed", "text_id", "pos").agg((F.count("*") > 1).alias("twin"))
    same = Window.partitionBy("seed")
    found = found.withColumn("n", F.count("*").over(same)).withColumn("shared", F.min("text_id").over(same) != F.max("text_id").over(same))
    held = stored(found.where("shared or twin").drop("shared"), "held")
    few, hot = held.where(F.col("n") <= FEW).drop("n"), held.where(F.col("n") > FEW).drop("n")
    direct = stored(_paired(few, ["seed"], ["pos"]).drop("seed"), "direct")
    ends = stored(_ends(hot, least, k, gain).join(hot.groupBy("text_id").agg(F.first("twin").alias("twin")), "text_id"), "ends")
    pairs = direct.select("text_id", "partner").unionByName(_paired(ends, ["a", "b"], []).select("text_id", "partner")).distinct()
    other = hot.select("seed", F.col("text_id").alias("partner"), F.col("pos").alias("partner_pos"))
    rest = pairs.join(hot.select("seed", "text_id", "pos"), "text_id").join(other, ["partner", "seed"])
    return direct.unionByName(rest.select(*direct.columns))


def _pair_chains(matched: DataFrame, least: int, gain: float, k: int) -> DataFrame:
    """Chains of each pair that span `least` characters in both texts: text_id, partner, chains (of anchors)."""
    anchor = pa.struct([("pos", pa.int32()), ("partner_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts, partners, kept = [], [], []
            for text, partner, spots in zip(batch["text_id"].to_pylist(), batch["partner"].to_pylist(), batch["spots"].to_pylist()):
                at = sorted((x["pos"], x["partner_pos"]) for x in spots)
                if max(x[0] for x in at) - at[0][0] + k < least:
                    continue
                found = branches(np.array([x[0] for x in at]), np.array([x[1] for x in at]), gain * _gains(at, k))
                long = [[at[i] for i in c] for c in found if min(at[c[-1]][x] - at[c[0]][x] for x in (0, 1)) + k >= least]
                if long:
                    texts.append(text)
                    partners.append(partner)
                    kept.append([[{"pos": p, "partner_pos": q} for p, q in c] for c in long])
            yield _rows([texts, partners, kept], [pa.int64(), pa.int64(), pa.list_(pa.list_(anchor))], ["text_id", "partner", "chains"])

    by = matched.groupBy("text_id", "partner").agg(F.collect_list(F.struct("pos", "partner_pos")).alias("spots"))
    return by.mapInArrow(run, "text_id bigint, partner bigint, chains array<array<struct<pos:int,partner_pos:int>>>")


def passages(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Fuzzy passages: stretches of a document that follow, with changes, a stretch of its partner in the same order.

    One row per chain that spans `length` characters or more in both texts, for every pair of documents and
    in both directions: doc_id, partner, starts and ends (exclusive) in both, n_seeds, and identity,
    the share of the longer stretch's characters that an alignment matches. Seeds stand in every run of
    a quarter of `length`; chains that span half of it are extended by alignment at both ends before they
    are measured, so no equal stretch of `length` is lost. The alignment runs between seeds that follow
    each other in the chain, so its parts stay short where the texts agree. Equal texts are looked at
    once; every document that has the text gets the rows.
    """
    run_length, least, gain = max(k, length // DENSER), length // OUTER, _gain(length, k)
    small(documents.sparkSession)
    texts = documents.where((F.length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    kept = stored(_pair_chains(pair_matches(texts, least, run_length, gain, k), least, gain, k), "pairs")
    wanted = kept.select("text_id").unionByName(kept.select(F.col("partner").alias("text_id"))).distinct()
    own = stored(texts.select("text_id", "text").dropDuplicates(["text_id"]).join(wanted, "text_id"), "texts")
    both = kept.join(own, "text_id").join(own.select(F.col("text_id").alias("partner"), F.col("text").alias("partner_text")), "partner")
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    names = ["text_id", "partner_id", "start", "end", "partner_start", "partner_end", "n_seeds", "identity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, other_text, found = r["text"], r["partner_text"], {}
                for chain in r["chains"]:
                    a = [(x["pos"], x["partner_pos"]) for x in chain]
                    (start, other), (end, other_end) = a[0], (a[-1][0] + k, a[-1][1] + k)
                    before, after = extension(text[:start][::-1], other_text[:other][::-1]), extension(text[end:], other_text[other_end:])
                    place = (start - before[0], end + after[0], other - before[1], other_end + after[1])
                    longer = max(place[1] - place[0], place[3] - place[2])
                    if min(place[1] - place[0], place[3] - place[2]) >= length and found.get(place, (0,))[0] < len(a):
                        found[place] = (len(a), (before[2] + aligned(text, other_text, a, k) + after[2]) / longer)
                rows += [(r["text_id"], r["partner"], *place, *rest) for place, rest in found.items()]
            yield _rows(list(zip(*rows)) if rows else [[] for _ in names], types, names)

    once = stored(both.mapInArrow(run, "text_id bigint, partner_id bigint, start int, end int, partner_start int, partner_end int, n_seeds int, identity double"), "passages")
    back = once.where("text_id <> partner_id").select(
        F.col("partner_id").alias("text_id"), F.col("text_id").alias("partner_id"), F.col("partner_start").alias("start"), F.col("partner_end").alias("end"),
        F.col("start").alias("partner_start"), F.col("end").alias("partner_end"), "n_seeds", "identity",
    )
    members = texts.select("text_id", "doc_id").distinct()
    of = once.unionByName(back).join(members, "text_id").join(members.select(F.col("text_id").alias("partner_id"), F.col("doc_id").alias("partner")), "partner_id")
    return of.where("doc_id <> partner").select("doc_id", "partner", *names[2:])


def aligned(a: str, b: str, anchors: list[tuple[int, int]], k: int = K) -> int:
    """Characters of `a` that an alignment with `b` through the anchors (equal k-mers, rising in both) matches."""
    same, i, j = 0, anchors[0][0], anchors[0][1]
    for p, q in anchors:
        if p < i or q < j:  # overlaps what is matched already
            step = max(i - p, j - q)
            if step >= k:
                continue
            p, q, rest = p + step, q + step, k - step
        else:
            rest = k
        x, y = a[i:p], b[j:q]
        same += len(x) if x == y else sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        same, i, j = same + rest, p + rest, q + rest
    return same


_STEPS = sorted(((x, y) for x in range(SKIP + 1) for y in range(SKIP + 1) if x or y), key=lambda s: (max(s), abs(s[0] - s[1])))


def extension(a: str, b: str) -> tuple[int, int, int]:
    """How far an alignment from the beginning of both goes in `a` and in `b`, and how many characters it matches; it ends on equal ones."""
    i = j = 0
    same = 0
    while True:
        n, step = 0, 256
        while step:
            x, y = a[i + n : i + n + step], b[j + n : j + n + step]
            if len(x) == len(y) == step and x == y:
                n += step
            else:
                step //= 2
        i, j, same = i + n, j + n, same + n
        for x, y in _STEPS:
            need = max(RESUME, 2 * max(x, y))
            if len(part := a[i + x : i + x + need]) == need and part == b[j + y : j + y + need]:
                break
        else:
            return i, j, same
        i, j = i + x, j + y
