"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import draw, partitions, stored

#: Larger means are drawn as a sum of so many parts that each part's mean is at most this.
MAX_MEAN = 256.0
#: A table of rates is broadcast if it has at most so many rows and so many characters of names.
BROADCAST_ROWS, BROADCAST_CHARS = 10_000, 1_000_000
SALTS = 64


def poisson_count(mean: Column, seed: int, ident: Column) -> Column:
    """A Poisson draw: the inverse of its distribution function at a number hashed from ``ident``.

    The function is added up term by term until it passes the number; the sum runs far enough for the
    largest number that 52 bits give.
    """
    parts = F.greatest(F.ceil(mean / MAX_MEAN), F.lit(1)).cast("int")

    def one(part: Column) -> Column:
        m = mean / parts
        u = draw(F.lit(seed), ident, part)
        start = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-m).alias("term"), F.exp(-m).alias("upto"))
        last = F.ceil(m + 10 * F.sqrt(m) + 25).cast("int")

        def step(s: Column, k: Column) -> Column:
            term = s["term"] * m / k
            more = s["upto"] <= u
            return F.struct(
                F.when(more, k.cast("long")).otherwise(s["k"]).alias("k"),
                F.when(more, term).otherwise(s["term"]).alias("term"),
                F.when(more, s["upto"] + term).otherwise(s["upto"]).alias("upto"),
            )

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0).cast("long"), lambda a, b: a + b)


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """Mean repetitions a source: (``source``, ``n_rows``, ``rate``).

    ``weights`` (``source``, ``weight``) sets the shares of the mix; a source that it lacks gets none. Without it the
    share of a source is its row count to the power ``temperature`` (1: as found, 0: all alike). The mix is
    expected to hold ``total`` times the rows of ``docs``. Null is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_rows"))
    counts = stored(counts, "sources")
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    # summed from decimals, so that the sum doesn't depend on the order of rows
    sums = counts.agg(F.sum("n_rows").alias("all_rows"), F.sum(F.col("weight").cast("decimal(30,6)")).cast("double").alias("all_weight"))
    return counts.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "source", "n_rows",
        F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") * total / F.col("n_rows")).otherwise(0.0).alias("rate"),
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, temperature: float = 0.5, total: float = 1.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Repeats each document by a Poisson draw with its source's rate, and shuffles all copies globally.

    Returns the rows of ``docs``, each ``copies`` times, with ``copies``, ``copy`` (from 0) and ``shuffle_key`` (a double in [0, 1) hashed from id and copy; its
    order is the order of the mix: rows are dealt to partitions by it and sorted in them). The draw hangs on
    ``seed`` and the id alone, so reruns and recomputed tasks repeat it. Rows with the same id draw alike;
    null ids draw as the text ``null``. An empty table gives an empty mix. Columns of ``docs`` with the names of the added ones
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("copies", "copy", "shuffle_key", "_rate", "_key", "_salt")
    rates = stored(source_rates(docs, weights, temperature, total, source_col), "rates")
    rates = rates.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key"), F.col("rate").alias("_rate"))
    rows, chars = rates.agg(F.count("*"), F.sum(F.length("_key"))).first()
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
    if rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS:
        rated = keyed.join(F.broadcast(rates), "_key")
    else:  # a hot source is dealt over the salts, and its rate with it
        rated = keyed.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(SALTS))).join(rates.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_key", "_salt"]).drop("_salt")
    drawn = rated.withColumn("copies", poisson_count(F.col("_rate"), seed, ident)).where("copies > 0").drop("_rate", "_key")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    mixed = copies.withColumn("shuffle_key", draw(F.lit(seed + 1), ident, F.col("copy")))
    return mixed.repartition(partitions(spark), F.xxhash64("shuffle_key")).sortWithinPartitions("shuffle_key", "copy")
