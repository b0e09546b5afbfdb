"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All of it is DataFrame operations. Sources are clamped at a maximum number of epochs; what they cannot take is
shared again by weight until no target is above its cap. A document is repeated ``floor(epochs)`` times, and once
more if it comes early enough in its source's seeded order. That order is never sorted as a whole: documents fall
in 4096 hash buckets, whole buckets are decided by prefix sums of bucket sizes, and only the one bucket of each
source that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Hexadecimal digits of the seeded hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and tab to carriage return; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size: one row per source) with ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn. ``share`` times all sizes is dealt out by
    weight; a source stops at ``max_epochs`` times its size and the rest is dealt to the others. The capped
    sources are a prefix in the order of cap / weight, so the fixed point needs sums over that order only.
    A source of size 0 has target 0. The table has a row per source, so its one-partition windows are small.
    """
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", weight).withColumns({"_cap": F.col("source_size") * F.lit(float(max_epochs)), "_budget": F.sum("source_size").over(every) * F.lit(float(share)), "_all_w": F.sum("_w").over(every)})
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumns({"_level": level, "_pos": F.row_number().over(by_ratio)})
    t = t.withColumn("_free_from", F.min(F.when(F.col("_ratio") > F.col("_level"), F.col("_pos"))).over(every))
    t = t.withColumn("_free", F.max(F.when(F.col("_pos") == F.col("_free_from"), F.col("_level"))).over(every))
    capped = F.col("_free_from").isNull() | (F.col("_pos") < F.col("_free_from"))
    return t.withColumn("target", F.when(capped, F.col("_cap")).otherwise(F.col("_free") * F.col("_w"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix repeats the document).

    Copies follow from the row's id, its source's target and the seed alone, so reruns agree. Within a source the
    words taken differ from the target by less than its one document at the cut. Null and empty texts have size
    0 and whatever copies their place gives them. Rows without an id are placed by their text; rows equal in id
    (or text, without one) share a place and are taken together. An empty table gives an empty table, and columns
    of the input named like the added ones are replaced.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumns({"size": word_count(F.col(text_col)), "_place": place})
    narrow = stored(sized.select(F.col(source_col).alias("source"), "size", "_place"), "mix-sizes").withColumn("_b", F.substring("_place", 1, BUCKET_DIGITS))
    buckets = narrow.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    per_source = targets(buckets.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = stored(per_source.withColumn("_whole", F.floor(epochs)).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-targets")
    cut = (
        buckets.alias("b")
        .join(per_source.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .select("b.*", "_part")
        .withColumn("_upto", F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")))
        .withColumn("_rest", F.col("_part") - F.col("_upto") + F.col("_sum"))
        .where("_part > 0 and _rest > 0 and _upto >= _part")
        .select("source", F.col("_b").alias("_cut"), "_rest")
    )
    edge = (
        narrow.alias("n")
        .join(cut.alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n._b") == F.col("c._cut")))
        .groupBy(F.col("n.source").alias("source"), "_place", "_cut", "_rest")
        .agg(F.sum("n.size").alias("_sum"))
        .withColumn("_upto", F.sum("_sum").over(Window.partitionBy("source").orderBy("_place")))
        .groupBy("source", "_cut")
        .agg(F.max(F.when(F.col("_upto") - F.col("_sum") / 2 < F.col("_rest"), F.col("_place"))).alias("_last"))
    )
    plan = per_source.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.source", "source_size", "target", "_whole", F.coalesce("_last", "_cut").alias("_last"))
    plan = stored(plan.withColumnRenamed("source", "_source"), "mix-plan")
    once_more = F.when(F.col("_place") <= F.col("_last"), 1).otherwise(0)
    return (
        sized.join(plan, F.col(source_col).eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", (F.col("_whole") + once_more).cast("int"))
        .drop("_place", "_source", "_whole", "_last")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix`` as often as its ``copies`` say."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy")


def op7_mixing(spark, sf_dir):
    """Contract query: doc_id, size, source_size, target and taken of every row of ``documents``; see ``mix`` for nulls, empty
    texts, ties, repeated rows and empty tables."""
    from .common import load

    docs = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('mix-1:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as place
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w from s),
r as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / w as ratio,
        cast(sum(source_size) over () as double) * 1.5::double as budget, sum(w) over () as all_w from w),
l as (select *, row_number() over o as pos,
        (budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) /
        (all_w - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as level
      from r window o as (order by ratio, source nulls last)),
f as (select min(pos) as free_from from l where ratio > level),
t as (select l.source, l.source_size,
        case when f.free_from is null or l.pos < f.free_from then l.cap else (select level from l l2 where l2.pos = f.free_from) * l.w end as target
      from l, f),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
c as (select d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size as part,
        sum(d.size) over (partition by d.source order by d.place) as upto,
        sum(d.size) over (partition by d.source, d.place) as own
      from d join e on d.source is not distinct from e.source),
k as (select *, max(case when part > 0 and upto - own / 2.0 < part then place end) over (partition by source) as last from c)
select doc_id, size, source_size, target, cast((whole + case when place <= last then 1 else 0 end) * size as bigint) as taken from k
"""
