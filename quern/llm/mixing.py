"""Mixing sources to target weights by Poisson replication.

A source with n rows and target weight w of T rows in all gets the repetition rate T w / n. Each row's number
of copies is the Poisson distribution of that rate, inverted at a hash of the row: expected totals are the
targets, and a row's copies don't depend on other rows, partitions or retries. Copies are then dealt and
sorted by a hash, which is a shuffle of them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Q, cut

#: Without weights, a source's weight is its number of rows to this power: small sources gain.
POWER = 0.5
#: Tables of up to so many sources and so many probabilities in all (of 8 bytes) are broadcast. Larger ones are joined
#: by shuffle, whose hot sources Spark can split.
BROADCAST_SOURCES, BROADCAST_PROBABILITIES = 20_000, 1 << 20
SEED = "mix"


def uniform(*parts: Column) -> Column:
    """A hash of the parts as a double in [0, 1), the same in any SQL engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate), rows pre-aggregated. weights: by source, 0 for those that it lacks."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), POWER))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        n = n.alias("a").join(F.broadcast(given).alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    n = cut(n)
    of_weights, of_rows = n.agg(F.sum("w"), F.sum("n")).first()
    goal = float(of_rows or 0) if total is None else float(total)
    return n.select("source", "n", (F.col("w") / F.lit(of_weights or 1.0) * F.lit(goal) / F.col("n")).alias("rate"))


def log_factorial(k: Column) -> Column:
    """ln k! for whole k, by Stirling's series beyond 20."""
    x = F.greatest(k, F.lit(21)).cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (x * 12) - 1 / (F.pow(x, 3) * 360) + 1 / (F.pow(x, 5) * 1260)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def distributions(rates: DataFrame) -> DataFrame:
    """(source, least, cdf): P(X <= k) for k = least, least + 1.. as far as a double tells it from 1; what lies below
    least has no more than e^-70. About 24 square roots of the rate; no row where the rate is 0."""
    around = F.sqrt("rate") * 12
    ends = rates.filter("rate > 0").withColumns({"least": F.greatest(F.lit(0), F.floor(F.col("rate") - around - 20)).cast("long"), "most": F.ceil(F.col("rate") + around + 40).cast("long")})
    k = ends.select("source", "rate", "least", F.explode(F.sequence("least", "most")).alias("k"))
    k = k.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial(F.col("k"))))
    k = k.withColumn("c", F.sum("p").over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])
    return k.groupBy("source").agg(F.min("least").alias("least"), cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, text: str = "text", source: str = "source", id: str = "doc_id", seed: str = SEED, copy: str | None = None, key: str | None = None) -> DataFrame:
    """Rows of docs, each 0 or more times, in shuffled order.

    total: rows aimed at (default: as many as docs has). copy, key: names of columns to add, with the number
    of the copy from 0 and the hash that orders it. Null sources are a source. A row's hash is that of its id,
    or of its text where the id is null; repeated rows get the same number of copies each.
    """
    named = [F.col(c).alias(f"{Q}{c}") for c in ("source", "least", "cdf")]
    table = cut(distributions(rates(docs, weights, total, source)).select(*named))
    sources, probabilities = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(f"{Q}cdf")), F.lit(0))).first()
    table = F.broadcast(table) if sources <= BROADCAST_SOURCES and probabilities <= BROADCAST_PROBABILITIES else table
    row = F.coalesce(F.col(id).cast("string"), F.col(text), F.lit(""))
    joined = docs.join(table, F.col(source).eqNullSafe(F.col(f"{Q}source"))).withColumn(f"{Q}u", uniform(F.lit(seed), row))
    joined = joined.withColumn(f"{Q}n", F.col(f"{Q}least") + F.size(F.filter(f"{Q}cdf", lambda c: c <= F.col(f"{Q}u")))).drop(f"{Q}cdf")
    copies = joined.filter(F.col(f"{Q}n") > 0).withColumn(f"{Q}copy", F.explode(F.sequence(F.lit(0), (F.col(f"{Q}n") - 1).cast("int"))))
    copies = copies.withColumn(f"{Q}key", uniform(F.lit(seed), row, F.col(f"{Q}copy").cast("string")))
    shuffled = copies.repartition(f"{Q}key").sortWithinPartitions(f"{Q}key")
    extra = [F.col(f"{Q}{k}").alias(name) for k, name in (("copy", copy), ("key", key)) if name]
    return shuffled.select(*[c for c in docs.columns if c not in (copy, key)], *extra)


SQL = f"""
WITH n AS (SELECT source, count(*) AS n, count(*)::DOUBLE ** {POWER} AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
f AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM f),
u AS (SELECT *, coalesce(doc_id::VARCHAR, text, '') AS row FROM documents),
m AS (SELECT doc_id, text, lang, u.source, n_chars, row, count(*) AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
      AND c.c <= ('0x' || substr(md5('{SEED}|' || row), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE
      GROUP BY ALL),
e AS (SELECT *, unnest(range(0, copies))::INTEGER AS copy FROM m)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || substr(md5('{SEED}|' || row || '|' || copy), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE AS shuffle_key
FROM e
"""
