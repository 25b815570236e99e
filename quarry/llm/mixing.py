"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: w = p**a / sum(p**a). a = 1 keeps the corpus's
own mix, a = 0 weighs all sources alike. The exponent is found by repeated section for a target entropy of w, then
raised as far as needed to keep every source at or below a number of repetitions of its tokens in the budget.

A source's quota, w times the token budget, is realised as whole passes over its documents and a part of one more.
The part is a block permutation: documents fall into blocks of about BLOCK_TOKENS by a hash of the id, blocks are put
in a keyed order, and blocks are taken whole while they fit; of the block at the cut, documents are taken in hash
order while they fit. The cut is found by descent: tokens are summed by the first bits of the order, then, inside the
range that holds the cut, by the next ones, until one block is left. So no step orders more than 2^DIGIT sums of a
source, however large it is. A document's copies depend on its source's four numbers and two hashes: nothing but those
numbers is joined to the documents, and texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, small

BLOCK_TOKENS = 100_000
DIGIT = 12  # bits of the order that a step of the descent looks at
SECTIONS, ROUNDS = 24, 7
MAX_EXPONENT = 8.0


def count_words(text: Column) -> Column:
    """The tokens that shares are measured in: runs of [^\\x20\\x09-\\x0D]; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _profile(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest w / p) at each exponent, in one pass over the sources."""
    p = F.col("p")
    sums = []
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(p)).alias(f"s{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}")]
    r = totals.agg(*sums).first()
    return [(math.log(r[f"z{i}"]) - a * r[f"s{i}"] / r[f"z{i}"], r[f"m{i}"] / r[f"z{i}"]) for i, a in enumerate(exponents)]


def _section(totals: DataFrame, lo: float, hi: float, enough) -> float:
    """The smallest exponent in [lo, hi] at which enough(entropy, repetition) holds; enough must be monotone."""
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        good = [enough(*x) for x in _profile(totals, grid)]
        k = good.index(True) if True in good else SECTIONS
        lo, hi = grid[max(0, k - 1)], grid[k]
        if k == 0:
            return lo
    return hi


def find_exponent(totals: DataFrame, budget_share: float, entropy: float | None, repetitions: float | None) -> float:
    """totals: (p) with shares that sum to 1. budget_share: token budget over corpus tokens. entropy: in nats.

    The entropy of w falls as the exponent grows, and so does the most repeated source's number of passes up to 1.
    An entropy above the logarithm of the number of sources gives 0; a limit below budget_share gives 1, at which
    all sources repeat alike.
    """
    a = 1.0 if entropy is None else _section(totals, 0.0, MAX_EXPONENT, lambda h, _: h <= entropy + 1e-12)
    if repetitions is not None and a < 1.0 and _profile(totals, [a])[0][1] * budget_share > repetitions:
        a = _section(totals, a, 1.0, lambda _, m: m * budget_share <= repetitions * (1 + 1e-12))
    return a


def _hash(c: Column, key: int) -> Column:
    return F.xxhash64(F.coalesce(c.cast("string"), F.lit("")), F.lit(key))


def _block_hash(source: Column, block: Column, key: int) -> Column:
    return F.xxhash64(F.coalesce(source, F.lit("")), block, F.lit(key + 1))


class Plan:
    """What realises a mix: a row a source with passes, blocks, cut_block and cut_doc."""

    def __init__(self, sources: DataFrame, n_sources: int, exponent: float, key: int, id_col: str, source_col: str):
        self.sources, self.n_sources, self.exponent, self.key, self.id_col, self.source_col = sources, n_sources, exponent, key, id_col, source_col

    def copies(self, docs: DataFrame, name: str) -> DataFrame:
        """docs with `name`, the number of times that each row is taken."""
        of, passes, blocks, cut_block, cut_doc = (free_name([*docs.columns, name], x) for x in ("mix_source", "mix_passes", "mix_blocks", "mix_cut_block", "mix_cut_doc"))
        at = self.sources.select(
            F.col("source").alias(of), F.col("passes").alias(passes), F.col("blocks").alias(blocks), F.col("cut_block").alias(cut_block), F.col("cut_doc").alias(cut_doc))
        own, doc = F.col(f"`{self.source_col}`").cast("string"), _hash(F.col(f"`{self.id_col}`"), self.key)
        block = _block_hash(own, F.pmod(doc, F.col(blocks)), self.key)
        part = (block < F.col(cut_block)) | ((block == F.col(cut_block)) & (doc <= F.col(cut_doc)))
        found = docs.join(small(at, self.n_sources), own.eqNullSafe(F.col(of)), "left")
        n = F.col(passes) + F.coalesce(part, F.lit(False)).cast("bigint")
        return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(n, F.lit(0)).alias(name))

    def realise(self, docs: DataFrame) -> DataFrame:
        """docs with each row as often as the mix takes it; columns as they were."""
        n = free_name(docs.columns, "mix_copies")
        taken = self.copies(docs, n).where(F.col(n) > 0)
        return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).drop(n)


def _cuts(blocked: DataFrame, wanted: DataFrame, n_sources: int, scratch: Scratch) -> DataFrame:
    """(source, block, left): the first block, in order, that does not fit into its source's `rest` any more, and what
    is left for it. blocked: source, block, tokens."""
    state, known = wanted.select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix")), 64
    while True:
        shift = max(0, known - DIGIT)
        inside = F.lit(0).cast("bigint") if known == 64 else F.shiftright("block", known)
        at = small(state.select(F.col("source").alias("s"), "left", "prefix"), n_sources)
        met = blocked.join(at, F.col("source").eqNullSafe(F.col("s")) & (inside == F.col("prefix")))
        sums = met.groupBy("source", F.shiftright("block", shift).alias("next")).agg(
            F.sum("tokens").alias("tokens"), F.first("left").alias("left"), F.min("block").alias("block"), F.max("block").alias("last"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("next"))
        first = sums.withColumn("upto", upto).where("upto > left").groupBy("source").agg(
            F.min(F.struct("next", (F.col("left") - F.col("upto") + F.col("tokens")).alias("left"), "block", "last")).alias("c"))
        state = scratch.keep(first.select("source", F.col("c.next").alias("prefix"), "c.left", "c.block", "c.last"), "cuts")
        known = shift
        if known == 0 or state.where("block <> last").isEmpty():
            return state.select("source", "block", "left")


def plan_mix(spark: SparkSession, docs: DataFrame, budget_share: float = 1.0, entropy_gain: float | None = 0.5, repetitions: float | None = 4.0,
             key: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Plan, DataFrame]:
    """The plan, and (id, source, tokens) of every row of docs.

    The budget is budget_share of the corpus's tokens. The target entropy lies entropy_gain of the way from the
    corpus's own entropy to that of equal shares. A source gets at most its quota, and less by no more than one
    document in the block at the cut. Null sources are one source; a null text has no tokens; sources without tokens
    take no part. Rows that repeat an id are taken or left together, null ids too. An empty table gives an empty mix.
    Blocks whose hashes tie are one block. A text longer than what is left of the block at the cut is left out.
    """
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("tokens")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    corpus, n_sources = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    corpus = corpus or 0
    shares = scratch.keep(totals.withColumn("p", F.col("tokens") / F.lit(float(max(1, corpus)))), "shares")
    exponent, z = 1.0, 1.0
    if corpus:
        own = _profile(shares, [1.0])[0][0]
        target = None if entropy_gain is None else own + entropy_gain * (math.log(n_sources) - own)
        exponent = find_exponent(shares, budget_share, target, repetitions)
        z = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    quota = F.floor(F.pow("p", F.lit(exponent)) / F.lit(z) * F.lit(budget_share * corpus) + F.lit(1e-6))
    wanted = shares.select(
        "source", "tokens", quota.alias("quota"), F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("bigint").alias("blocks"))
    wanted = wanted.select("*", F.expr("quota div tokens").alias("passes"), F.expr("quota % tokens").alias("rest"))
    wanted = scratch.keep(wanted, "wanted")
    at = small(wanted.select(F.col("source").alias("s"), "blocks"), n_sources)
    own = sized.join(at, sized["source"].eqNullSafe(F.col("s"))).where("tokens > 0")
    doc = _hash(F.col("id"), key)
    blocked = own.select("source", doc.alias("doc"), "tokens", _block_hash(F.col("source"), F.pmod(doc, F.col("blocks")), key).alias("block"))
    cut = _cuts(blocked.select("source", "tokens", "block"), wanted, n_sources, scratch)
    # Only the block at each source's cut is put in order.
    inside = blocked.join(small(cut, n_sources), blocked["source"].eqNullSafe(cut["source"]) & (blocked["block"] == cut["block"]))
    inside = inside.select(blocked["source"], "doc", "tokens", "left").groupBy("source", "doc").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    fits = inside.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc"))).where("upto <= left")
    ends = fits.groupBy("source").agg(F.max("doc").alias("cut_doc"))
    found = wanted.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").join(
        ends.alias("e"), F.col("w.source").eqNullSafe(F.col("e.source")), "left")
    # Where no document of the cut block fits, cut_doc is null and none is taken.
    sources = scratch.keep(found.select(
        "w.source", "w.tokens", "w.quota", "w.passes", "w.blocks", F.col("c.block").alias("cut_block"), "e.cut_doc"), "sources")
    return Plan(sources, n_sources, exponent, key, id_col, source_col), sized


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, tokens, copies), one row for each row of docs."""
    plan, sized = plan_mix(spark, docs, **options)
    plan.id_col, plan.source_col = "id", "source"
    return plan.copies(sized, "copies").select(F.col("id").alias("doc_id"), "source", "tokens", "copies")
