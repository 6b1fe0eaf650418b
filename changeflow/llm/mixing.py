r"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Each source has a target number of words: its share of all words by weight, but three times its own words at most, the
excess going to the other sources by weight. Among all rates r of documents that meet the targets, entropy balancing picks
the ones nearest to 1 in relative entropy (each word counts as one unit): r = exp(lambda of the source), where lambda
minimises the convex dual  sum(words * exp(lambda)) - sum(lambda * target).  Newton steps on the dual run over the sums of
words per source, which are aggregated once; they end when every source is within `tolerance` of its target.

Rates become copies by systematic rounding along each source's documents in order of size: of the first i documents,
floor(i * r + 1/2) copies are taken, so deviations cancel between neighbours of like size. What is left, one large
document's size at most, is evened out in a few passes by one copy more or less of the smallest documents that have room.
All this is on counts of (source, size); within those, documents are ranked in buckets of bounded size, so no task orders a
whole source.

Defined results: a null or empty text has size 0 and is never copied; null is a source of its own, the last; repeated rows
are rows of their own, whose order among equals is arbitrary but whose number of copies is the same on a rerun for rows
with distinct ids; an empty table gives no rows. Other columns are left out, but for those named in carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import WORD, save

CAP = 3.0
#: Rows that one task ranks, about.
BUCKET = 1024
#: How often what is left of a target is evened out.
PASSES = 4
#: Newton steps between two looks at the gradient.
STEPS = 10
_EPS = 1e-9


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, words) with weight and target. Null-safe; sorted windows run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    # Sources reach their cap in the order of cap / weight: with those before it capped, a source's level is what is left
    # over per unit of weight; it is capped if its own cap is below that.
    weighed = weighed.withColumn("ratio", F.col("words") * CAP / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("words").over(everything), F.sum("weight").over(everything)
    left = total - CAP * F.coalesce(F.sum("words").over(before), F.lit(0))
    per = left / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", per).withColumn("capped", F.col("ratio") <= F.col("level"))
    # Past the first source that isn't capped, levels only fall.
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("words") * CAP).otherwise(level * F.col("weight"))
    return leveled.select("source", "words", "weight", target.cast("double").alias("target"))


def balance(sums: DataFrame, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """sums (source, words, target) with rate: Newton's iterations on the dual, each one pass over the sums."""
    at = sums.withColumn("lambda", F.lit(0.0))
    words, target = F.col("words"), F.col("target")

    def newton(x: Column, _: Column) -> Column:
        # The dual has one term per source: the Hessian is diagonal. A step of at most 1 keeps exp in range.
        gradient, hessian = words * F.exp(x) - target, words * F.exp(x)
        return x - F.least(F.greatest(gradient / hessian, F.lit(-1.0)), F.lit(1.0))

    for _ in range(most // STEPS):
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("lambda"), newton)
        at = save(at.withColumn("lambda", F.when(words > 0, moved).otherwise(0.0)), "dual")
        worst = at.agg(F.max(F.abs(words * F.exp("lambda") - target) / F.greatest(target, F.lit(1.0)))).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"Newton's method did not come within {tolerance} of the targets in {most} steps")
    return at.withColumn("rate", F.least(F.round(F.exp("lambda"), 9), F.lit(CAP))).drop("lambda")


def _ranked(rows: DataFrame, by: list[str], key: str, rank: str) -> DataFrame:
    """rows with a rank from 0 within equal `by`, in buckets of keys; counts of buckets carry the offsets."""
    many = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    small = many.select(*[F.col(c).alias(f"_{c}") for c in by], F.ceil(F.col("_n") / BUCKET).alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    put = rows.join(small, same).withColumn("_bucket", F.pmod(F.xxhash64(key), F.col("_b"))).drop("_b", *[f"_{c}" for c in by])
    counts = put.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("__bucket"), ahead.alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key)) - 1
    out = put.join(offsets, [*same, F.col("_bucket") == F.col("__bucket")])
    return out.withColumn(rank, F.col("_ahead") + inner).drop("_ahead", "_bucket", "__bucket", *[f"_{c}" for c in by])


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, size, source, source_size, target, rate, copies (0 to 3), and the columns in carry."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = save(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), *carry), "sizes")
    # Documents are counted by (source, size) once; all that follows but the ranks is on those counts.
    counts = save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    rates = save(balance(targets(sums)), "rates")
    same = lambda r: F.col("source").eqNullSafe(F.col(r))
    rate = rates.select(F.col("source").alias("_s"), "words", "target", "rate")
    in_order = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(in_order), F.lit(0))
    classes = counts.withColumn("ahead", ahead).join(rate, same("_s")).drop("_s")
    # Copies among the documents of ranks a to b (exclusive) of a source: floor(b * r + 1/2) - floor(a * r + 1/2).
    upto = lambda i: F.floor(i * F.col("rate") + 0.5 + _EPS)
    classes = classes.withColumn("given", upto(F.col("ahead") + F.col("n")) - upto(F.col("ahead"))).drop("ahead")
    for k in range(PASSES):
        off = F.col("target") - F.sum(F.col("size") * F.col("given")).over(Window.partitionBy("source"))
        classes = classes.withColumn("off", off)
        room = F.least(F.col("n"), F.when(F.col("off") > 0, CAP * F.col("n") - F.col("given")).otherwise(F.col("given")))
        classes = classes.withColumn("room", F.when(F.col("size") == 0, 0).otherwise(room).cast("bigint"))
        spent = F.coalesce(F.sum(F.col("size") * F.col("room")).over(in_order), F.lit(0))
        # A pass but the last may go past the mark, if the next one can come back by the smaller documents it has used up.
        size = F.greatest(F.col("size"), F.lit(1))
        exact = (F.abs("off") - spent) / size
        near, past = F.floor(exact + 0.5), F.ceil(exact - _EPS)
        fit = F.when((past - exact) * size <= spent, past).otherwise(near) if k < PASSES - 1 else near
        flips = F.greatest(F.least(fit, F.col("room")), F.lit(0)) * F.signum("off")
        classes = classes.withColumn("given", (F.col("given") + flips).cast("bigint"))
    plan = save(classes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "words", "target", "rate", "given"), "plan")
    ranked = _ranked(sized, ["source", "size"], "key", "rank")
    chosen = ranked.join(plan, [same("_s"), F.col("size") == F.col("_z")])
    # Documents of one source and size are alike: copies are spread evenly over them, what remains goes to the first.
    low = F.floor(F.col("given") / F.col("n"))
    copies = low + F.when(F.col("rank") < F.col("given") - low * F.col("n"), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 0).otherwise(copies).cast("bigint")
    return chosen.select(
        F.col("key").alias(key), "size", F.col("source").alias(source), F.col("words").alias("source_size"), "target", "rate", copies.alias("copies"), *carry
    )
