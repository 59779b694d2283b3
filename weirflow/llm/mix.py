"""Problem 7: mixing sources to target weights.

Sizes are counted in tokens of a public tokenizer. Weights come from temperature mixing: every
source's natural share of the tokens, exponentiated towards its target share, with the exponent
bisected to an entropy or a repetition limit. They are realised as budgeted block permutations:
full passes over a source, then blocks of its documents in permuted order up to the budget, the last
block cut document by document.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.batches import small
from weirflow.sources.tables import stored

BLOCK_DOCUMENTS = 4096  # documents of a source in a block, about
MAX_SOURCES = 100_000  # sources whose totals the driver plans with; more is an error
_BLANKS = " \t\r\n"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, Callable[[str], int]] = {}
_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, vocabulary: str) -> None:
    """Hand the vocabulary file to the executors, once per application, for those that don't have it at its path."""
    sent = (spark.sparkContext.applicationId, vocabulary)
    if sent not in _sent:
        spark.sparkContext.addFile(vocabulary)
        _sent.add(sent)


def _counter(vocabulary: str, pattern: str | None = None) -> Callable[[str], int]:
    """Token counter of a vocabulary file in tiktoken's form; made once in a Python worker. `pattern` splits texts before the merges."""
    if vocabulary not in _encoders:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[vocabulary] = lambda text: len(encoding.encode_ordinary(text))
    return _encoders[vocabulary]


def source_key(column: str = "source"):
    return F.lower(F.btrim(F.col(column), F.lit(_BLANKS)))


def sized(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, source and n_tokens of whole texts; null texts have 0 tokens. `vocabulary` is a file on the driver, `pattern` by default that of the public tokenizers."""
    path = vocabulary or default_vocabulary()
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    _send(documents.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        size = _counter(path, pattern)
        for batch in batches:
            tokens = pa.array([size(t) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], tokens], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


@dataclass(frozen=True)
class Allotment:
    source: str
    target: float
    tokens: int  # that the source has
    budget: float  # that the mix takes from it
    passes: int  # over the whole source
    rest: float  # tokens beyond the full passes


def tempered(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares on the geometric path from the natural ones (exponent 0) to the target (exponent 1)."""
    if exponent == 1:
        return dict(target)  # as given, without rounding
    weights = {s: natural[s] * (target[s] / natural[s]) ** exponent for s in natural}
    total = sum(weights.values())
    return {s: w / total for s, w in weights.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(fits: Callable[[float], bool], low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent that fits, of those up to high, where low fits."""
    if fits(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def plan(
    tokens: dict[str, int],
    targets: dict[str, tuple[float, int]],
    total: float | None = None,
    target_entropy: float | None = None,
    one_exponent: bool = False,
    scale: float | None = None,
) -> list[Allotment]:
    """How much of each source the mix takes.

    `tokens` has what each source holds, `targets` its target share and the number of times that a
    document may be used. Natural shares are exponentiated towards the target shares, with the largest
    exponent, of those up to 1, that meets the repetition limits of all sources at the mix's size. Without
    `total` that size is what the source with the scarcest share can fill at its target, so the exponent comes
    out as 1 and every source that has documents gets its target share. A larger `total`, or `scale`, the size as a
    multiple of what the listed sources hold, brings it down with `one_exponent`, so that all sources move together; without it sources
    that can't fill their target give all that their repetitions allow and the others share the rest by theirs.
    `target_entropy` (nats) bisects the exponent so that the shares' entropy comes down or up to it,
    as far as the path reaches. Sources without documents, target or repetitions get nothing.
    """
    held = {s: tokens.get(s, 0) for s, (share, repeats) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and repeats > 0}
    caps = {s: held[s] * targets[s][1] for s in held}
    budgets: dict[str, float] = {}
    if held:
        in_all, wanted = sum(held.values()), sum(targets[s][0] for s in held)
        natural = {s: n / in_all for s, n in held.items()}
        target = {s: targets[s][0] / wanted for s in held}
        if target_entropy is not None:
            rises = entropy(target) > entropy(natural)
            reach = lambda e: (entropy(tempered(natural, target, e)) <= target_entropy) == rises
            target = tempered(natural, target, bisect(reach))
        if total is None and scale is not None:
            total = scale * in_all
        scarcest = total is None
        if scarcest:
            total = min(caps[s] / target[s] for s in held)
        total = min(total, sum(caps.values()))
        if one_exponent or scarcest:
            fits = lambda e: all(total * p <= caps[s] * (1 + 1e-12) for s, p in tempered(natural, target, e).items())
            shares = tempered(natural, target, bisect(fits))
            budgets = {s: min(caps[s], total * p) for s, p in shares.items()}
        else:
            free, left = dict(target), total
            while free:
                scale = left / sum(free.values())
                full = [s for s, t in free.items() if t * scale > caps[s]]
                if not full:
                    budgets |= {s: t * scale for s, t in free.items()}
                    break
                for s in full:
                    budgets[s] = caps[s]
                    left -= caps[s]
                    del free[s]
    found = []
    for s, (share, _) in sorted(targets.items()):
        n, b = tokens.get(s, 0), budgets.get(s, 0.0)
        passes = int(b // n + 1e-9) if n else 0
        found.append(Allotment(s, share, n, b, passes, max(0.0, b - passes * n)))
    return found


def mix(
    documents: DataFrame,
    targets: DataFrame,
    vocabulary: str | None = None,
    total: float | None = None,
    target_entropy: float | None = None,
    one_exponent: bool = False,
    scale: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """The documents drawn: doc_id, source (lower case, trimmed), n_tokens and copies, one row per document.

    Sources are compared without case and outer blanks. Documents without source, of sources not
    listed, or without tokens are left out. The same seed draws the same documents, however the data
    is partitioned. A source's size misses its budget by half a document at most. Repeated rows of a
    document are documents of their own. Empty tables give an empty result.
    """
    small(documents.sparkSession)
    listed = targets.where(source_key().isNotNull() & F.col("target_share").isNotNull()).select(
        source_key().alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")
    )
    rows = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    wanted = {r.source: (r.target_share, r.max_repeats) for r in rows}
    own = documents.withColumn("source", source_key()).join(F.broadcast(listed.select("source").distinct()), "source", "left_semi")
    sizes = stored(sized(own, vocabulary).where("n_tokens > 0"), "sizes")
    totals = {r.source: (r.tokens, r.documents) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).collect()}
    plans = plan({s: t for s, (t, _) in totals.items()}, wanted, total, target_entropy, one_exponent, scale)
    control = documents.sparkSession.createDataFrame(
        [(p.source, p.passes, float(p.rest), max(1, -(-totals.get(p.source, (0, 0))[1] // BLOCK_DOCUMENTS))) for p in plans],
        "source string, passes int, rest double, blocks bigint",
    )
    shuffled = sizes.join(F.broadcast(control), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        shuffled.groupBy("source", "block")
        .agg(F.sum("n_tokens").alias("in_block"))
        .withColumn("before", F.coalesce(F.sum("in_block").over(order), F.lit(0)))
    )
    placed = shuffled.join(blocks, ["source", "block"])
    whole = (F.col("before") + F.col("in_block")) <= F.col("rest")
    cut = ~whole & (F.col("before") < F.col("rest"))
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(cut).withColumn("so_far", F.col("before") + F.sum("n_tokens").over(within))
    # A document is in if at least half of it fits.
    last = last.withColumn("extra", (F.col("so_far") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("so_far")
    others = placed.where(~cut).withColumn("extra", whole.cast("int"))
    drawn = others.unionByName(last).withColumn("copies", F.col("passes") + F.col("extra"))
    return drawn.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """What the mix reached, for every listed source: source, target_share, share, tokens, documents, most_copies."""
    by = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    listed = targets.select(source_key().alias("source"), "target_share").where("source is not null")
    every = listed.join(by, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    in_all = F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))  # over one row per source
    return every.select("source", "target_share", F.coalesce(F.col("tokens") / in_all, F.lit(0.0)).alias("share"), "tokens", "documents", "most_copies")
