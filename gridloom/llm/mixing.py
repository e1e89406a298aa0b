"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source s gets the mean repetition rate `epochs * N * w_s / (sum of w * n_s)`; a row's number of copies is the Poisson variate of
that mean at a uniform number hashed from (seed, row digest, occurrence), so reruns and lost tasks give the same copies. The row
digest is the MD5 of all columns; rows that agree in all of them are counted (pre-aggregated) and told apart by their number, so each
row has a draw of its own and the target mix is reached however often a doc_id, a null or a whole row repeats. Copies are spread by a
hashed key of (row digest, occurrence, copy) and sorted by it within each partition: a global shuffle, in which no key is hot.

Defined results: a null source is a source of its own; rows whose number is 0 go; a source missing from `weights` weighs 0; null and
empty texts are copied as any other; empty input gives no rows. Extra columns of any name are carried along, but a column called
`copy` or `shuffle_key` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_or_shuffled

SEED = "mix-1"
#: Equal rows that one task writes out.
CHUNK = 10_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate). Without weights a source weighs its count to the power `temperature`."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    n = n.withColumn("weight", weight)
    total = n.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    share = F.lit(float(epochs)) * F.col("all_n") * F.col("weight") / F.nullif("all_weight", F.lit(0.0)) / F.col("n")
    return n.join(F.broadcast(total)).select("source", F.coalesce(share, F.lit(0.0)).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, steps): cumulative probabilities of 0, 1, ... as far as a double can tell them from 1 (mean + 12 deviations + 30)."""
    rate, k = F.col("rate"), F.col("k")
    last = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 30)).otherwise(0).cast("int")
    each = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.ln(F.greatest(k, F.lit(1)).cast("double"))).over(upto)
    power = F.when(k > 0, k * F.ln(rate)).otherwise(0.0)
    each = each.withColumn("p", F.when(rate > 0, F.exp(-rate + power - factorial)).otherwise(1.0))
    summed = each.select("source", "k", F.sum("p").over(upto).alias("c"))
    return summed.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("steps"))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of seed and parts."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def row_digest(df: DataFrame) -> Column:
    """The MD5 of a row's values as text, in the order of the columns' names."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in sorted(df.columns)]))


def occurrences(docs: DataFrame, digest: str, number: str) -> DataFrame:
    """docs with each row's digest, and its number among the rows equal to it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(digest, row_digest(docs))
    repeated = keyed.groupBy(digest).count().where("count > 1").select(F.col(digest).alias(fresh(keyed, "of_digest")))
    repeated = Scratch(docs.sparkSession, "mixing").save(repeated, "repeated")
    if repeated.isEmpty():
        return keyed.withColumn(number, F.lit(0).cast("long"))
    found = small_or_shuffled(repeated)
    same = F.col(digest) == F.col(repeated.columns[0])
    once = keyed.join(found, same, "left_anti").withColumn(number, F.lit(0).cast("long"))
    # equal rows collapse to one and its count, and are written out again in chunks dealt to many tasks
    many = keyed.join(found, same, "left_semi").groupBy(digest).agg(F.first(F.struct(*columns)).alias("row"), F.count("*").alias("n"))
    chunks = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition(digest, "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
    again = chunks.select(digest, "row", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias(number))
    return once.unionByName(again.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], digest, number))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs' rows, each as often as drawn, with `copy` (from 1) and `shuffle_key`, in shuffled order."""
    docs = docs.drop("copy", "shuffle_key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest, number, source, steps, n = (fresh(docs, x) for x in ("digest", "number", "of_source", "steps", "n"))
    table = poisson_steps(rates(docs, weights, temperature, epochs)).select(F.col("source").alias(source), F.col("steps").alias(steps))
    drawn = occurrences(docs, digest, number).join(small_or_shuffled(table), F.col("source").eqNullSafe(F.col(source)))
    u = uniform(seed, F.col(digest), F.col(number))
    drawn = drawn.select(*columns, digest, number, F.size(F.filter(steps, lambda c: c <= u)).alias(n)).where(F.col(n) > 0)
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), digest, number, "copy")), 1, 15), 16, 10).cast("long")
    return copies.select(*columns, "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
