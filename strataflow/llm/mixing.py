"""Mixing sources to target weights by hash-seeded Poisson replication. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut, fresh, uniform

#: The sources' tables are broadcast up to so many doubles (16 MB); beyond, the join is dealt over salts, so that no source
#: is one task. Copies are exploded by runs of RUN, so that no array grows with a rate.
BROADCAST_DOUBLES, SALTS, RUN = 2_000_000, 64, 4096


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, size: float | None, measure: str) -> DataFrame:
    """Mean repetitions of a document of each source: s, rate. One row for each source, null being one."""
    amount = F.lit(1) if measure == "rows" else F.octet_length(F.coalesce("text", F.lit(""))) + 1
    have = docs.groupBy(F.col("source").alias("s")).agg(F.sum(amount.cast("bigint")).alias("have"))
    if weights is None:
        have = have.withColumn("weight", F.lit(1.0))
    else:
        wanted = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "t string, weight double")
        have = have.join(F.broadcast(wanted), F.col("s").eqNullSafe(F.col("t")), "left").drop("t").fillna(0.0, ["weight"])
    whole = have.agg(F.sum("weight").alias("weights"), F.sum("have").alias("all"))  # one row
    out = F.col("all").cast("double") if size is None else F.lit(float(size))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return have.join(F.broadcast(whole)).select("s", (share * out / F.col("have")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """s, rate, least, cdf: P(X <= k) for k = least, least + 1, ... as an array.

    The table reaches 12 standard deviations and 40 to both sides of the mean, beyond which less than a double can tell is
    left, so its length grows with the root of the rate. Terms follow from the mode's outwards by p(k) = p(k - 1) * rate /
    k, as running sums of logarithms, and are divided by their sum: nothing under- or overflows for any rate. Entries that
    can't be told from 0 or 1 are dropped.
    """
    reach = 12 * F.sqrt("rate") + 40
    span = F.sequence(F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("bigint"), F.ceil(F.col("rate") + reach).cast("bigint"))
    ks = rates.where("rate > 0").select("s", "rate", F.explode(span).alias("k"))
    upwards = Window.partitionBy("s", "rate").orderBy("k")
    mode = F.floor("rate")
    # log p(k) but for a constant: sums of log(rate / j) over j up to k, from the mode's neighbour on either side
    step = F.when(F.col("k") > 0, F.log(F.col("rate") / F.greatest(F.col("k"), F.lit(1)))).otherwise(0.0)
    logs = ks.withColumn("sum", F.sum(step).over(upwards)).withColumn("log_p", F.col("sum") - F.max(F.when(F.col("k") == mode, F.col("sum"))).over(Window.partitionBy("s", "rate")))
    terms = logs.withColumn("p", F.exp("log_p")).withColumn("c", F.sum("p").over(upwards) / F.sum("p").over(Window.partitionBy("s", "rate")))
    told = terms.where((F.col("c") > 2.0**-54) & (F.col("c") - F.col("p") < 1))
    some = told.groupBy("s", "rate").agg(F.min("k").alias("least"), F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    return some.unionByName(rates.where("rate = 0").select("s", "rate", F.lit(0).cast("bigint").alias("least"), F.array().cast("array<double>").alias("cdf")))


def inverted(u: Column, least: Column, cdf: Column) -> Column:
    """The smallest k with u < P(X <= k)."""
    return F.when(F.size(cdf) == 0, F.lit(0).cast("bigint")).otherwise(least + F.least(F.size(F.filter(cdf, lambda c: c <= u)), F.size(cdf) - 1))


def poisson_mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float | None = None, measure: str = "rows", seed: str = "mix", parts: int | None = None) -> DataFrame:
    """Repeat each document a Poisson number of times so that sources come in the target weights, in random order.

    A document of source s is repeated X times, where X inverts the Poisson distribution of mean
    weight(s) / all weights * size / amount(s) at a uniform number made of seed and doc_id alone: the result depends on
    neither partitions nor order of rows, and a lost task gives the same rows again. weights: of each source (others: 0),
    or None for equal ones. size: what comes out on average, in rows or text bytes + 1 (measure); None: as much as goes in.
    The global shuffle deals copies by range of a hash of seed, doc_id and copy and sorts by it: as the hash is uniform,
    the ranges need no sample. The written files, in order, are one random permutation; a source that holds a third of the
    rows is spread like any other.

    Adds rate, copies, copy (0 to copies - 1) and shuffle_key (0 to 1). Null source: a source of its own, apart from ''.
    Null doc_id: hashed as empty. Null, empty and very long texts: as any. Repeated rows: repeated alike each. Ties of
    shuffle_key: ordered by doc_id, copy. Empty table: no rows. Columns of docs that have the added names are replaced; no
    other name clashes.
    """
    docs = docs.drop("rate", "copies", "copy", "shuffle_key")
    tables = cut(poisson_tables(cut(source_rates(docs, weights, size, measure))))
    s, least, cdf, u, salt, run = fresh(docs, "_source", "_least", "_cdf", "_u", "_salt", "_run")
    named = tables.select(F.col("s").alias(s), "rate", F.col("least").alias(least), F.col("cdf").alias(cdf))
    if (tables.agg(F.sum(F.size("cdf") + 4)).first()[0] or 0) <= BROADCAST_DOUBLES:
        joined = docs.join(F.broadcast(named), docs["source"].eqNullSafe(F.col(s)))
    else:
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        other, at = fresh(dealt, "_other", "_at")
        spread = named.withColumnRenamed(s, other).withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(spread, F.col("source").eqNullSafe(F.col(other)) & (F.col(salt) == F.col(at))).drop(salt, at, other).withColumn(s, F.lit(None))
    counted = joined.withColumn(u, uniform(seed, F.col("doc_id"))).withColumn("copies", inverted(F.col(u), F.col(least), F.col(cdf)).cast("int")).drop(cdf, least, u, s)
    some = counted.where("copies > 0")
    runs = some.withColumn(run, F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int"))))
    copied = runs.withColumn("copy", F.explode(F.sequence(F.col(run) * RUN, F.least(F.col("copies"), (F.col(run) + 1) * RUN) - 1))).drop(run)
    keyed = copied.withColumn("shuffle_key", uniform(seed + "/order", F.col("doc_id"), F.col("copy")))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy")
