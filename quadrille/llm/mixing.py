"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent and normalised. The exponent is bisected
until the mixture has a wanted entropy, or until no source is repeated more often than a limit. The weights
are then realised as whole and broken epochs: each epoch of a source is a permutation of its documents by
hash, and the last one is cut where the source's token budget ends. The mixture is a sequence of blocks, and every
source has the same token budget in each: its stream of epochs is cut into blocks by cumulative tokens.

Per-source figures stay in a distributed table and the bisection brings only sums to the driver, so the
number of sources isn't bounded. Cumulative tokens come from sums over 256 ranges of the permutation, then 256
ranges of each of these, then the rows of such a range: no task sees a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize

#: What the words of a text are trimmed of and split at.
_SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class MixPlan:
    """Exactly one of ``max_epochs`` (no source is seen more often) and ``entropy`` (share of the largest possible, 0 to 1).

    ``token_budget`` is the size of the mixture; by default it is such that the source seen least is seen
    once, and nothing is dropped. ``blocks`` is the number of parts of the mixture, each of the same weights.
    Of the mixtures within ``max_epochs`` the flattest is taken. A target that no exponent meets is a ValueError.
    """

    max_epochs: float | None = 1.25
    entropy: float | None = None
    token_budget: int | None = None
    blocks: int = 64
    seed: int = 7


def n_words(text: Column) -> Column:
    """Words between spaces, tabs and line ends; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _permuted(seed: int) -> Column:
    """A document's place in its source's permutations, as a fraction of 2**63; of id and text, so that documents without an id spread too."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)), 1)


def _figures(sources: DataFrame, plan: MixPlan, exponents: list[float]) -> list[float]:
    """The entropy of the mixture, as a share of the largest, or the epochs of the source that is repeated most, at each exponent.

    Both fall as the exponent grows (the latter up to 1). ``sources`` has tokens, share, and ``rel``, the share over the largest.
    """
    cols = []
    for i, a in enumerate(exponents):
        w = F.pow("rel", F.lit(a))
        if plan.entropy is not None:
            # H / log k of w / Z: (log Z - sum(w log w) / Z) / log k
            value = (F.log(F.sum(w)) - F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)) / F.sum(w)) / F.log(F.count("*"))
        else:
            repeat = F.pow("rel", F.lit(a - 1))
            if plan.token_budget is None:
                value = F.max(repeat) / F.min(repeat)
            else:
                value = F.max(repeat) / F.sum(w) * F.lit(float(plan.token_budget)) / F.max(F.col("tokens") / F.col("rel"))
        cols.append(value.alias(f"v{i}"))
    got = sources.agg(*cols).first()
    return [got[f"v{i}"] for i in range(len(exponents))]


def solve_exponent(sources: DataFrame, plan: MixPlan, passes: int = 9) -> float:
    """The least exponent whose figure is at most the target, to 45 bits of the bracket.

    The bracket is 0..1; for an entropy below that of the sources as they are it doubles upwards. One source alone is
    its own mixture at any exponent. Each pass evaluates 31 exponents at once, which is five bisections.
    """
    if (plan.max_epochs is None) == (plan.entropy is None):
        raise ValueError("give either max_epochs or entropy")
    if plan.entropy is not None:
        if not 0 <= plan.entropy <= 1:
            raise ValueError("entropy is a share of the largest possible, 0 to 1")
        if len(sources.take(2)) < 2:
            return 1.0
    target = plan.entropy if plan.entropy is not None else plan.max_epochs
    least, natural = _figures(sources, plan, [0.0, 1.0])
    if least <= target:
        return 0.0
    low, high = 0.0, 1.0
    if natural > target + 1e-12:
        if plan.entropy is None:
            raise ValueError(f"the mixture repeats its sources {natural:.4g} times at least, more than {target:g}")
        while _figures(sources, plan, [high])[0] > target:
            low, high = high, 2 * high
            if high > 2**40:
                raise ValueError(f"no exponent brings the entropy down to {target:g}: several sources are the largest")
    for _ in range(passes):
        grid = [low + (high - low) * i / 32 for i in range(1, 32)]
        # The exponents whose figure is still above the target are too small.
        above = sum(1 for v in _figures(sources, plan, grid) if v > target)
        low, high = ([low, *grid][above], [*grid, high][above])
    return high


def source_plan(narrow: DataFrame, plan: MixPlan) -> DataFrame:
    """(key, tokens, weight, epochs) of each source. Sources without tokens get weight 0 and one epoch."""
    sums = materialize(narrow.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    top = sums.agg(F.max("tokens")).first()[0] or 0
    shares = sums.where("tokens > 0").withColumn("rel", F.col("tokens") / F.lit(float(max(top, 1))))
    alpha = solve_exponent(shares, plan) if top else 1.0
    powered = F.pow("rel", F.lit(alpha))
    figures = shares.agg(F.sum(powered).alias("z"), F.min(powered / F.col("tokens")).alias("least")).first()
    z, least = (figures["z"] or 1.0), (figures["least"] or 1.0)
    budget = float(plan.token_budget) if plan.token_budget is not None else z / least
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(top, 1))), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    # A hair's breadth under a whole number of epochs is rounding.
    epochs = F.when(F.col("tokens") > 0, F.round(weight * F.lit(budget) / F.col("tokens"), 9)).otherwise(1.0)
    return materialize(sums.select("key", "tokens", weight.alias("weight"), epochs.alias("epochs")), "mix")


def _streamed(narrow: DataFrame) -> DataFrame:
    """``narrow`` with ``end``: the tokens of its source's permutation up to and with the row. Rows of one place go by id, then by tokens."""
    ranges = {"r1": F.shiftright("place", 55), "r2": F.shiftright("place", 47).bitwiseAND(F.lit(255))}
    rows, offsets = narrow.withColumns(ranges), None
    for by in (["key", "r1"], ["key", "r1", "r2"]):
        sums = rows.groupBy(*by).agg(F.sum("n_tokens").alias("t"))
        before = F.coalesce(F.sum("t").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        level = sums.withColumn("before", before).drop("t")
        if offsets is not None:
            level = level.join(offsets.withColumnRenamed("before", "outer"), by[:-1]).withColumn("before", F.col("before") + F.col("outer")).drop("outer")
        offsets = materialize(level, "offsets")
    inner = F.sum("n_tokens").over(W.partitionBy("key", "r1", "r2").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("inner", inner).join(offsets, ["key", "r1", "r2"]).withColumn("end", F.col("before") + F.col("inner")).drop("r1", "r2", "before", "inner")


def _cuts(streamed: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, tokens, weight, epochs, cut, taken): the last place that a source's broken epoch takes (none is -1) and its tokens.

    The epoch takes documents in order while their tokens fit the budget; rows that share a place go together.
    """
    need = sources.select("key", F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("left"))
    out = streamed.join(need, "key").where("end > left").groupBy("key").agg(F.min(F.struct("place", (F.col("end") - F.col("n_tokens")).alias("taken"))).alias("out"))
    # Without a row beyond it, the whole permutation fits: an epoch of no length beyond whole ones, or a source without tokens.
    return materialize(sources.join(out, "key", "left").select("key", "tokens", "weight", "epochs", (F.col("out.place") - 1).alias("cut"), F.coalesce("out.taken", F.lit(0)).alias("taken")), "cuts")


def _copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with key and place) with the source's figures, and ``epoch`` for each of their copies."""
    broken = (F.col("epochs") > F.floor("epochs")) & (F.col("cut").isNull() | (F.col("place") <= F.col("cut")))
    copies = F.floor("epochs").cast("int") + broken.cast("int")
    return rows.join(cuts, "key").withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))


def _narrow(docs: DataFrame, plan: MixPlan) -> DataFrame:
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("n_tokens"), _key(F.col("source")).alias("key"), _permuted(plan.seed).alias("place")), "tokens")


def mix_sources(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:  # noqa: B008
    """One row per copy of a document in the mixture: doc_id, source, n_tokens, epoch (from 0), epochs, weight, block, place.

    ``epochs`` and ``weight`` are the source's; reading by (block, place) gives the mixture's order. A source has in
    each block its tokens in the mixture over the number of blocks, but for the documents that the two ends of a block
    cut through; a document belongs where it begins. A null source is a source of its own; a null text has no tokens;
    documents without an id are permuted by their text. Documents without tokens take nothing of a budget and go with
    their place in the permutation. Rows of one id and text share their place and stay together. An empty table gives none.
    """
    streamed = materialize(_streamed(_narrow(docs, plan)), "streamed")
    cuts = _cuts(streamed, source_plan(streamed, plan))
    dealt = _copies(streamed, cuts)
    begin = F.col("epoch").cast("double") * F.col("tokens") + F.col("end") - F.col("n_tokens")
    whole = F.floor("epochs") * F.col("tokens") + F.col("taken")
    block = F.least(F.floor(begin * F.lit(plan.blocks) / F.greatest(whole, F.lit(1))), F.lit(plan.blocks - 1)).cast("int")
    return dealt.select("doc_id", "source", "n_tokens", "epoch", "epochs", "weight", block.alias("block"), "place")


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` as often as the mixture has them, under the same columns; otherwise as ``mix_sources``. Texts aren't shuffled."""
    streamed = materialize(_streamed(_narrow(docs, plan)), "streamed")
    cuts = _cuts(streamed, source_plan(streamed, plan))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), _key(F.col("source")).alias("key"), _permuted(plan.seed).alias("place"))
    return _copies(packed, cuts).select("__row.*")
