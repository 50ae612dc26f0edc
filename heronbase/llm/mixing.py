"""Mixing sources to target weights by systematic sampling.

Every source gets a share of the words wanted, by weight; a share above
``cap`` times the source's own words is cut there and the excess goes to the
other sources by weight.  Within a source each document expects
``target / source size`` copies; the running sum of those expectations plus one
offset of the source is followed in a fixed order, and a document is emitted
once for every integer that its stretch crosses.

Order within a source: size class (the size's highest five bits), hash bucket of
the id (of the text, where the id is null), id, size.  Documents of like size therefore stand together, so that the
words taken follow the copies closely.  The running sum never puts a source into
one task: ranks are counted within (source, size class, bucket) and shifted by
the counts of the groups before.  Those counts do meet in one task a source: a row for
each class and bucket, at most 256 times the classes there are (32 below size 32, 16 for
each doubling beyond): 70,000 for texts of up to a million words, however many they are.

Defined cases: a null or empty text has size 0 and is still dealt copies; a null
source is a source of its own, last in order; equal rows are dealt in turn; a
table without words has targets 0 and takes nothing; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import materialize, pick

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets within a size class; a constant, so that reruns agree on any cluster.
BUCKETS = 256


def size_class(size: Column) -> Column:
    bits = F.length(F.bin(size))
    return F.when(size < 32, size).otherwise(bits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))"))


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], factor: float, cap: float) -> DataFrame:
    """``source, source_size`` -> with ``target``: the weight shares of ``factor`` times all words, none above ``cap`` times its source.

    With sources in order of cap per weight, the common level is the largest of the
    levels that result from cutting the first k sources.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(ws, ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    filled = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(float(factor)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("target", F.least("most", F.max("level").over(everything) * F.col("weight")))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, text`` -> per document ``doc_id, size, source_size, target, taken, copies`` and the columns of ``keep``."""
    own = pick(docs, "doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], *([] if "text" in keep else ["text"]))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    own = own.withColumn("__size", size).withColumn("__bucket", _hex(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")), 2))
    rest = [c for c in own.columns if c not in ("doc_id", "source", "__size", "__bucket") and (c != "text" or "text" in keep)]
    base = materialize(own.select("doc_id", "source", F.col("__size").alias("size"), F.col("__bucket").alias("bucket"), *rest), "mix-sizes")
    base = base.withColumn("class", size_class(F.col("size")))

    groups = base.groupBy("source", "class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    by_source = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, factor, cap)
    ahead = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    g = groups.alias("g").join(by_source.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select(
        F.col("g.source").alias("g_source"), F.col("class").alias("g_class"), F.col("bucket").alias("g_bucket"), "ahead", "source_size", "target"
    )
    within = Window.partitionBy("source", "class", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    ranked = base.withColumn("rank", F.row_number().over(within))
    dealt = ranked.join(g, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("class") == F.col("g_class")) & (F.col("bucket") == F.col("g_bucket")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))), 4) / F.lit(65536.0)
    dealt = dealt.withColumn("rate", rate).withColumn("offset", offset).withColumn("at", F.col("ahead") + F.col("rank"))
    copies = F.floor(F.col("rate") * F.col("at") + F.col("offset")) - F.floor(F.col("rate") * (F.col("at") - 1) + F.col("offset"))
    dealt = dealt.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1))).cast("long")))
    out = [F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), (F.col("copies") * F.col("size")).alias("taken"), F.col("copies")]
    return dealt.select(*out, *[F.col(c) for c in keep if c != "doc_id"])
