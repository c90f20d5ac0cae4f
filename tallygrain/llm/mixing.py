"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mix over its share of
the bytes, times the epochs. Every document is repeated as often as a Poisson
variable of that mean says, found by inverting the distribution at a uniform
number hashed from seed and document id: the same everywhere, at every run.
A rate above ``SPLIT`` is the sum of several smaller ones, each with a number
of its own. Copies are then put in the order of another hash, globally.

A null source is a source of its own with the default weight. A null text has
no bytes; documents of a source without any byte get no copy. Rows with the
same id are repeated alike, and copies that tie in their order are equal in id
and number; a null id counts as the empty text. Texts of any length are only
measured. An empty table gives an empty result. Columns named like a result are
replaced: rename them before (``common.set_aside``) to keep them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.llm.common import table
from tallygrain.llm.registry import query
from tallygrain.session import written

WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
OTHER_WEIGHT = 1.0
EPOCHS = 1.0
SEED = 20240917
SPLIT = 16.0
# names the operator gives to columns of its own
OWN_COLUMNS = ("rate", "n_copies", "copy", "order_key", "draws", "_source", "_cdf")
# P(Poisson(16) > 96) is below 2**-53
MOST = 96


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(df: DataFrame, source_col: str, text_col: str, weights: Mapping[str, float], other: float, epochs: float) -> DataFrame:
    """Per source: bytes, documents, rate."""
    sizes = df.groupBy(F.col(source_col).alias("_source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("_bytes")
    )
    weight = F.lit(other)
    for name, w in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(w)).otherwise(weight)
    weighed = sizes.withColumn("_weight", F.when(F.col("_bytes") > 0, weight).otherwise(F.lit(0.0)))
    every, weights_sum = (weighed.agg(F.sum(c).cast("double")).scalar() for c in ("_bytes", "_weight"))
    rate = F.lit(epochs) * every * (F.col("_weight") / weights_sum) / F.col("_bytes")
    return weighed.select("_source", F.when(F.col("_bytes") > 0, rate).otherwise(0.0).alias("rate"))


def inverse_tables(rated: DataFrame) -> DataFrame:
    """Per source: rate, draws, and the distribution function of one draw at 0, 1, 2, .."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT).cast("int"))
    log_factorials = [0.0]
    for k in range(1, MOST + 1):
        log_factorials.append(log_factorials[-1] + math.log(k))
    steps = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(MOST)).alias("k"), F.array(*map(F.lit, log_factorials)).alias("f")))
    long = rated.withColumn("draws", draws).withColumn("_mean", F.col("rate") / F.col("draws")).select("*", steps.alias("_at"))
    k, log_fact, mean = F.col("_at.k"), F.col("_at.f"), F.col("_mean")
    chance = F.when(mean > 0, F.exp(k * F.log(mean) - mean - log_fact)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
    upto = W.partitionBy("_source").orderBy("_at.k").rowsBetween(W.unboundedPreceding, 0)
    summed = long.withColumn("_cdf", F.sum(chance).over(upto))
    cells = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.col("_cdf").alias("c"))))
    grouped = summed.groupBy("_source", "rate", "draws").agg(cells.alias("_cells"))
    return grouped.select("_source", "rate", "draws", F.col("_cells.c").alias("_cdf"))


def poisson_mix(
    df: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    other: float = OTHER_WEIGHT,
    epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Copies of the rows with all their columns, plus rate, n_copies, copy (from 1) and order_key; in that order."""
    tables = written(inverse_tables(rates(df, source_col, text_col, weights, other, epochs)), "mix-rates")
    given = df.drop("rate", "n_copies", "copy", "order_key")
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # each number is hashed once, then held against the distribution function
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: uniform(str(seed), "draw", doc, i.cast("string")))
    drawn = F.transform(numbers, lambda u: F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = F.aggregate(drawn, F.lit(0), lambda a, n: a + n)
    joined = given.join(tables, F.col(source_col).eqNullSafe(F.col("_source")))
    counted = joined.withColumn("n_copies", copies).drop("_source", "_cdf", "draws")
    some = F.when(F.col("n_copies") > 0, F.sequence(F.lit(1), F.col("n_copies")))
    each = counted.withColumn("copy", F.explode(some))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), doc, F.col("copy").cast("string")))
    return each.withColumn("order_key", key).orderBy("order_key", id_col, "copy")


def _check_sql() -> str:
    weight = " ".join(f"when source = '{s}' then {w!r}::double" for s, w in WEIGHTS.items())
    return f"""
with sizes as (select source, sum(coalesce(strlen(text), 0)) as bytes from documents group by source),
weighed as (
  select *, case when bytes = 0 then 0.0::double else case {weight} else {OTHER_WEIGHT!r}::double end end as weight
  from sizes
), rated as (
  select source, case when bytes > 0 then {EPOCHS!r}::double * (sum(bytes) over ())::double
    * (weight / sum(weight) over ()) / bytes::double else 0.0::double end as rate
  from weighed
), split as (select *, greatest(1, ceil(rate / {SPLIT!r}))::int as draws from rated),
logs as (
  select k::int as k, coalesce(sum(case when k > 0 then ln(greatest(k, 1)::double) end) over (order by k), 0) as f
  from generate_series(0, {MOST}) t(k)
), cdf as (
  select source, k, sum(case when rate > 0 then exp(k * ln(rate / draws) - rate / draws - f)
    when k = 0 then 1 else 0 end) over (partition by source order by k) as c
  from split, logs
), uniforms as (
  select doc_id, d.source, text, i, rate,
    ('0x' || substr(md5('{SEED}|draw|' || coalesce(doc_id::varchar, '') || '|' || i::varchar), 1, 13))::bigint::double
      / {float(1 << 52)!r} as u
  from documents d join split s on d.source is not distinct from s.source, unnest(range(1, draws + 1)) t(i)
), drawn as (
  select doc_id, u.source, text, rate, i, count(c.k) as n
  from uniforms u left join cdf c on u.source is not distinct from c.source and c.c <= u.u
  group by all
), counted as (
  select doc_id, source, text, rate, sum(n)::int as n_copies from drawn group by all
)
select doc_id, source, rate, n_copies, copy::int as copy,
  md5('{SEED}|order|' || coalesce(doc_id::varchar, '') || '|' || copy::varchar) as order_key, md5(text) as text_md5
from counted, unnest(range(1, n_copies + 1)) t(copy)"""


@query("op7_poisson_mix", _check_sql())
def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "rate", "n_copies", "copy", "order_key", F.md5("text").alias("text_md5"))
