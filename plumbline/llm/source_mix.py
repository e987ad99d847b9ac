"""Mixing sources to target weights by Pareto order sampling.

Of ``total`` rows each source gets a whole number by its weight (largest
remainders). Within a source a document's expected copies are that number times
its share of the source's size measure, the bit length of ``n_chars``. The whole
part of the expectation is allocated for certain; the rest, p, is an inclusion
probability. Documents are ranked by random odds over inclusion odds,
``u/(1-u) : p/(1-p)``, and the least are taken: exactly as many as are missing.
All shares are integers, so sizes are fixed and nothing depends on row order.

The rank a source needs isn't found by sorting it: a histogram of ranks finds
the bucket in which the last document falls, and that bucket alone is ordered.

Defined cases: a null source is a source of its own; a null or negative
``n_chars`` has size 1; rows without an id share one random number; equal rows
are ranked one after the other; a source with a weight and no documents gets
nothing, its weight counting for none; an empty table gives no rows; extra
columns are kept, whatever their names; ``sample`` replaces those named as its three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import materialize, own_names, small_side

SEED = 20
BUCKETS = 4096


def uniform(seed: int) -> Column:
    """In (0, 1), by the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def allocate(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(_pl_s, _pl_n, _pl_size): rows of each source and its size measure. Without weights: the root of its document count."""
    size = F.length(F.bin(F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0))))
    by = docs.groupBy(F.col("source").cast("string").alias("_pl_s")).agg(F.count("*").alias("_pl_c"), F.sum(size).cast("long").alias("_pl_size"))
    if weights is None:
        w = F.floor(F.sqrt(F.col("_pl_c").cast("double")) * 1000)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, int(round(v * 1_000_000)))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("_pl_s", F.lit(""))), F.lit(0)) if pairs else F.lit(0)
    all_rows = Window.partitionBy()
    goal = F.sum("_pl_c").over(all_rows) if total is None else F.lit(total)
    by = by.withColumn("_pl_w", w.cast("long")).withColumn("_pl_sum", F.sum("_pl_w").over(all_rows)).withColumn("_pl_goal", goal.cast("long")).filter("_pl_sum > 0")
    exact = by.withColumn("_pl_x", F.col("_pl_goal").cast("decimal(19,0)") * F.col("_pl_w").cast("decimal(19,0)"))
    exact = exact.withColumn("_pl_base", F.expr("_pl_x div _pl_sum")).withColumn("_pl_rest", F.expr("_pl_x % _pl_sum"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("_pl_rest"), F.asc_nulls_first("_pl_s")))
    more = F.col("_pl_goal") - F.sum("_pl_base").over(all_rows)
    return exact.withColumn("_pl_n", F.col("_pl_base") + F.when(rank <= more, 1).otherwise(0)).select("_pl_s", "_pl_n", "_pl_size")


@own_names
def sample(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` once a copy, with ``copy_no`` from 1, ``whole`` copies and the ``expected`` number."""
    shares = small_side(materialize(allocate(docs, weights, total)))

    def ranked(df: DataFrame, by: DataFrame) -> DataFrame:
        df = df.join(by, df["source"].cast("string").eqNullSafe(by["_pl_s"])).drop("_pl_s")
        size = F.length(F.bin(F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0)))).cast("long")
        df = df.withColumn("_pl_e", F.col("_pl_n") * size).withColumn("_pl_whole", F.expr("_pl_e div _pl_size")).withColumn("_pl_rem", F.expr("_pl_e % _pl_size")).withColumn("_pl_u", uniform(seed))
        q = (F.col("_pl_u") * (F.col("_pl_size") - F.col("_pl_rem"))) / ((1 - F.col("_pl_u")) * F.col("_pl_rem"))
        df = df.withColumn("_pl_q", F.when(F.col("_pl_rem") > 0, q))
        return df.withColumn("_pl_b", F.floor(F.col("_pl_q") / (F.col("_pl_q") + 1) * BUCKETS).cast("int"))

    narrow = ranked(docs.select("doc_id", "source", "n_chars"), shares)
    key = F.col("source").cast("string").alias("_pl_s")
    hist = narrow.groupBy(key, "_pl_b").agg(F.count("*").alias("_pl_k"), F.sum("_pl_whole").alias("_pl_sure"))
    of = Window.partitionBy("_pl_s")
    hist = hist.join(shares.withColumnRenamed("_pl_s", "_pl_t"), F.col("_pl_s").eqNullSafe(F.col("_pl_t"))).withColumn("_pl_m", F.col("_pl_n") - F.sum("_pl_sure").over(of)).filter("_pl_b is not null")
    hist = hist.withColumn("_pl_up", F.sum("_pl_k").over(of.orderBy("_pl_b")))
    edge = hist.filter("_pl_up >= _pl_m and _pl_up - _pl_k < _pl_m").select("_pl_s", F.col("_pl_b").alias("_pl_edge"), (F.col("_pl_m") - F.col("_pl_up") + F.col("_pl_k")).alias("_pl_need"))
    edge = small_side(materialize(edge))
    # the last document taken, within the edge's bucket alone; among equals it may be one of several
    e = edge.withColumnRenamed("_pl_s", "_pl_t")
    last = narrow.join(e, narrow["source"].cast("string").eqNullSafe(F.col("_pl_t")) & (F.col("_pl_b") == F.col("_pl_edge")))
    order = [F.asc("_pl_q"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("n_chars")]
    w = Window.partitionBy(key)
    last = last.withColumn("_pl_r", F.row_number().over(w.orderBy(*order))).withColumn("_pl_like", F.count("*").over(Window.partitionBy(key, "_pl_q", "doc_id", "n_chars"))).withColumn("_pl_below", F.rank().over(w.orderBy(*order)) - 1)
    cut = last.filter("_pl_r = _pl_need").select(key, F.col("_pl_q").alias("_pl_cq"), F.col("doc_id").alias("_pl_ci"), F.col("n_chars").alias("_pl_cn"), (F.col("_pl_need") - F.col("_pl_below")).alias("_pl_take"), "_pl_like")
    plan = shares.join(cut.withColumnRenamed("_pl_s", "_pl_t"), F.col("_pl_s").eqNullSafe(F.col("_pl_t")), "left").drop("_pl_t")
    cut = plan = materialize(plan)  # a row a source
    out = ranked(docs, small_side(plan))
    same_id = F.col("doc_id").eqNullSafe(F.col("_pl_ci"))
    less = (F.col("_pl_q") < F.col("_pl_cq")) | ((F.col("_pl_q") == F.col("_pl_cq")) & (
        F.when(same_id, F.when(F.col("n_chars").isNull(), F.col("_pl_cn").isNotNull()).otherwise(F.coalesce(F.col("n_chars") < F.col("_pl_cn"), F.lit(False))))
        .otherwise(F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") < F.col("_pl_ci"), F.lit(False))))))
    equal = (F.col("_pl_q") == F.col("_pl_cq")) & same_id & F.col("n_chars").eqNullSafe(F.col("_pl_cn"))
    out = out.withColumn("_pl_less", F.coalesce(less, F.lit(False))).withColumn("_pl_equal", F.coalesce(equal, F.lit(False)))
    if cut.filter("_pl_take < _pl_like").head(1):
        tie = out.filter("_pl_equal").withColumn("_pl_r", F.row_number().over(Window.partitionBy("source", "doc_id", "n_chars").orderBy("_pl_q")))
        out = out.filter("not _pl_equal").withColumn("_pl_r", F.lit(1)).unionByName(tie)
    else:
        out = out.withColumn("_pl_r", F.lit(1))
    hit = F.col("_pl_less") | (F.col("_pl_equal") & (F.col("_pl_r") <= F.col("_pl_take")))
    out = out.withColumn("_pl_copies", F.col("_pl_whole") + F.when(hit, 1).otherwise(0)).filter("_pl_copies > 0")
    out = out.withColumn("_pl_no", F.explode(F.sequence(F.lit(1), F.col("_pl_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy_no", "whole", "expected")], F.col("_pl_no").alias("copy_no"), F.col("_pl_whole").alias("whole"), (F.col("_pl_e") / F.col("_pl_size")).alias("expected"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The sampled rows with the columns of ``docs`` alone."""
    return sample(docs, **parameters).select(*[F.col(f"`{c}`") for c in docs.columns]) if not {"copy_no", "whole", "expected"} & set(docs.columns) else _mix_clash(docs, parameters)


def _mix_clash(docs: DataFrame, parameters: dict) -> DataFrame:
    names = {c: f"_own_{c}" for c in ("copy_no", "whole", "expected") if c in docs.columns}
    out = sample(docs.withColumnsRenamed(names), **parameters)
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return sample(docs).select("doc_id", "source", "n_chars", "copy_no", "whole", "expected")


SQL = """
with d as (select doc_id, source, n_chars, length(bin(greatest(coalesce(n_chars, 0), 0)))::bigint as size,
             (('0x' || substr(md5('20:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
s as (select source, count(*) as c, sum(size)::bigint as total_size from d group by source),
a as (select *, floor(sqrt(c::double) * 1000)::bigint as w from s),
b as (select *, sum(w) over () as sw, sum(c) over () as goal from a),
e as (select source, total_size, goal, (goal::hugeint * w) // sw as base, (goal::hugeint * w) % sw as rest from b),
n as (select source, total_size, base + case when row_number() over (order by rest desc, source nulls first) <= goal - sum(base) over () then 1 else 0 end as n from e),
x as (select d.doc_id, d.source, d.n_chars, d.u, n.n::bigint as n, n.total_size, n.n::bigint * d.size as e from d join n on d.source is not distinct from n.source),
y as (select *, e // total_size as whole, e % total_size as rem from x),
z as (select *, case when rem > 0 then (u * (total_size - rem)) / ((1 - u) * rem) end as q, n - sum(whole) over (partition by source) as m from y),
r as (select *, row_number() over (partition by source order by q nulls last, doc_id nulls first, n_chars nulls first) as rk from z),
c as (select *, whole + case when rem > 0 and rk <= m then 1 else 0 end as copies from r)
select doc_id, source, n_chars, unnest(range(1, copies::bigint + 1))::int as copy_no, whole::bigint as whole, e::double / total_size::double as expected from c where copies > 0
"""
