"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: w ~ p^a. The exponent is found by sections over
the (monotone) entropy of the weights or over the most often repeated source: each pass evaluates a grid of
exponents in one aggregation over the sources, so the table of sources never leaves Spark. A source's budget is its
weight times the token budget, in epochs of its own tokens.

Rows lie in blocks by a hash of themselves, about `BLOCK_ROWS` of a source to a block. Each epoch permutes the blocks
(a bijection of their numbers) and the rows in them, so a row's `place` in an epoch is one number. Whole epochs take all
rows; the last one is cut where its budget ends. The cut is found digit by digit of the place: token sums of at most
`PARTS` parts of each source, then of the parts of the one part in which the budget ends, until that holds a block's
rows. A source that holds a third of all rows is never ordered in one task, however large; its rows meet its weight in
a join that deals hot sources out.

Defined results: a null text has no tokens; null sources form a source of their own; a source without tokens gets
weight 0 and keeps each row once; repeated rows share their place and are taken or left together; an empty table gives
an empty result; the input's columns stay together in the struct `doc`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, materialise, spread_join, words

SEED = 17
#: Exponents evaluated in one pass, and passes.
SECTIONS, PASSES = 64, 4
#: Rows of a source in a block of its permutation, about; parts of a source whose sums are ordered at a time.
BLOCK_ROWS = 4096
PARTS = 4096
#: Bits of a place.
_BITS = 62


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc (all columns of a row), source (its key), tokens (words) and row, the hash that gives it its places."""
    check_columns(docs, "source", "text")
    ids = [F.col("doc_id")] if "doc_id" in docs.columns else []
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), _key(F.col("source")).alias("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("tokens"), F.xxhash64(*ids, F.col("text"), F.lit(seed)).alias("row"),
    )


def source_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def block_bits(rows: int) -> int:
    """Bits of a block's number in a table of so many rows."""
    return min(31, (rows // BLOCK_ROWS).bit_length())


def block(row: Column, bits: int) -> Column:
    return F.shiftrightunsigned(row, 64 - bits) if bits else F.lit(0).cast("bigint")


def place(row: Column, epoch: Column, bits: int) -> Column:
    """The row's place in an epoch: the permuted number of its block, then the hash of the row in it."""
    mask = F.lit((1 << bits) - 1).cast("bigint")
    shift, factor = F.xxhash64(epoch, F.lit(1)).bitwiseAND(mask), F.xxhash64(epoch, F.lit(2)).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("bigint"))
    permuted = (block(row, bits).bitwiseXOR(shift) * factor).bitwiseAND(mask)
    return F.shiftleft(permuted, _BITS - bits).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row, epoch), 64 - _BITS + bits))


def _grid(sources: DataFrame, total: int, lo: float, hi: float) -> list:
    """(exponent, entropy, largest and smallest ratio of weight to share) for exponents from lo to hi."""
    p = F.col("tokens") / F.lit(float(total))
    exponents = F.array(*[F.lit(lo + (hi - lo) * k / SECTIONS) for k in range(SECTIONS + 1)])
    each = sources.where("tokens > 0").select(p.alias("p"), F.explode(exponents).alias("a")).withColumn("x", F.pow("p", "a"))
    return each.groupBy("a").agg(
        F.sum("x").alias("z"), (F.log(F.sum("x")) - F.sum(F.col("x") * F.col("a") * F.log("p")) / F.sum("x")).alias("entropy"),
        (F.max(F.col("x") / F.col("p")) / F.sum("x")).alias("most"), (F.min(F.col("x") / F.col("p")) / F.sum("x")).alias("least"),
    ).orderBy("a").collect()


def exponent(sources: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: float | None = 1.0) -> tuple[float, float]:
    """The exponent from 0 to 1, and the budget in epochs of the whole corpus.

    entropy: the target share of the largest entropy, log(number of sources); the exponent that meets it (or 1, where
    the sources as they are lie above it). repetitions: the smallest exponent that repeats no source more often.
    budget None: as many tokens as it takes to give every source one epoch at least.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give an entropy or a number of repetitions")
    seen = sources.where("tokens > 0").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not seen.t:
        return 1.0, budget or 1.0
    import math

    def fits(row) -> bool:
        """True from the exponent looked for upwards."""
        if entropy is not None:
            return row.entropy <= entropy * math.log(seen.n) + 1e-12
        epochs = row.most / row.least if budget is None else row.most * budget
        return epochs <= repetitions + 1e-12

    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        grid = _grid(sources, seen.t, lo, hi)
        k = next((k for k, row in enumerate(grid) if fits(row)), len(grid) - 1)
        found = grid[k]
        lo, hi = grid[max(0, k - 1)].a, found.a
        if lo == hi:
            break
    return found.a, budget if budget is not None else 1 / found.least


#: The epoch number by which the last, cut epoch of each source is permuted.
_LAST = -1


def _cuts(placed: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """source and cut, the last place taken, of sources (source, rest) whose budget `rest` ends among `placed` (source, tokens, place)."""
    # sources that need no cut have no row here
    inside, ends, known = placed, wanted.where("rest > 0").select("source", "rest", F.lit(0.0).alias("before"), F.lit(-1).cast("bigint").alias("low")), 0
    step = (PARTS - 1).bit_length()
    while known < block_bits(rows):
        known += step
        part = F.shiftright("place", _BITS - known)
        inside = inside.withColumn("part", part)
        sums = inside.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("source").orderBy("part"))
        reached = sums.withColumn("upto", upto).join(ends, "source").withColumn("upto", F.col("before") + F.col("upto"))
        # the part in which the budget ends: one for each source, and none where it never ends
        ends = materialise(reached.where("upto - sum <= rest AND upto > rest").select("source", "rest", (F.col("upto") - F.col("sum")).alias("before"), (F.shiftleft("part", _BITS - known) - 1).alias("low"), "part"), "parts")
        inside = inside.join(ends.select("source", "part"), ["source", "part"]).select("source", "tokens", "place")
        ends = ends.drop("part")
    order = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("tokens").over(order)).join(ends, "source").where("before + upto <= rest").groupBy("source").agg(F.max("place").alias("inner"))
    return ends.join(last, "source", "left").select("source", F.coalesce("inner", "low").alias("cut"))


def plan(rows: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: float | None = 1.0) -> DataFrame:
    """One row for each source of `rows` (source, tokens, row): n (rows), tokens, weight, exponent, epochs, whole (epochs),
    rest (tokens of the epoch after) and cut, the last place taken in it. Written to the shared folder.
    """
    sources = materialise(source_totals(rows), "sources")
    a, epochs = exponent(sources, entropy, repetitions, budget)
    total = sources.agg(F.sum("tokens").cast("double").alias("total"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)))).alias("z"), F.sum("n").alias("rows")).first()
    t, z, n = total.total or 1.0, total.z or 1.0, total.rows or 0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z)).otherwise(0.0)
    wanted = F.when(F.col("tokens") > 0, F.lit(epochs * t) * F.col("weight") / F.col("tokens")).otherwise(1.0)
    plans = sources.withColumn("weight", weight).withColumn("epochs", wanted).withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int"))
    plans = plans.withColumn("rest", F.greatest(F.lit(0.0), (F.col("epochs") - F.col("whole")) * F.col("tokens")))
    placed = rows.select("source", "tokens", place(F.col("row"), F.lit(_LAST), block_bits(n)).alias("place"))
    return materialise(plans.join(_cuts(placed, plans, n), "source", "left").withColumns({"exponent": F.lit(a), "rows": F.lit(n).cast("bigint")}), "plans")


def mix(docs: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: float | None = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed rows: doc (struct), tokens, weight, exponent, epochs and copies of it, then epoch (from 0), block and place there.

    Ordered by source, epoch and place, a source's rows are its budgeted block permutations.
    """
    rows = measured(docs, seed)
    plans = plan(materialise(rows.select("source", "tokens", "row"), "rows"), entropy, repetitions, budget)
    bits = block_bits(plans.agg(F.max("rows")).first()[0] or 0)
    once = F.coalesce((F.col("rest") > 0) & (place(F.col("row"), F.lit(_LAST), bits) <= F.col("cut")), F.lit(False)).cast("int")
    planned = spread_join(rows, plans.select("source", "n", "weight", "exponent", "epochs", "whole", "rest", "cut"), ["source"]).withColumn("copies", F.col("whole") + once)
    each = planned.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    by = F.when(F.col("epoch") < F.col("whole"), F.col("epoch")).otherwise(F.lit(_LAST))
    return each.select("doc", "tokens", "weight", "exponent", "epochs", "copies", "epoch", block(F.col("row"), bits).alias("block"), place(F.col("row"), by, bits).alias("place"))
