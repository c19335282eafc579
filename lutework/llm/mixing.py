"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / weight, u being a hash of its id: ascending keys are a weighted sample without
replacement. A source's target is filled with complete epochs first; the rest of it takes documents in key order as long as the
prefix sum of their sizes comes nearer to the target.

Defined results: a null or empty text has size 0 and is never lacking or in excess; a null source is a source of its own, the last;
rows equal in source, key, id and size are taken or left together; empty input gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words, row_of, written

#: Buckets of keys for each doubling of the key, and the parts of a bucket: the words of a source are summed by bucket, those of the bucket in which its fraction
#: ends by part, and only the rows of one part are ordered.
BUCKETS, PARTS = 64, 4096
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>{}[]=_~^@"


def quality_weight(text: Column) -> Column:
    """1 for a clean text; less for a greater share of symbols, for repeated lines, and by half for words of an unlikely mean length or none."""
    text = F.coalesce(text, F.lit(""))
    n, lines = F.length(text), F.split(text, "\n")
    symbols = F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1)))
    distinct = F.size(F.array_distinct(lines)) / F.size(lines)
    mean = F.length(F.translate(text, SPACE, "")) / F.greatest(n_words(text), F.lit(1))
    return symbols * distinct * F.when(mean.between(2, 15), F.lit(1.0)).otherwise(F.lit(0.5))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _keyed(docs: DataFrame, seed: int) -> list[Column]:
    source = F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs["source"].cast("string")))
    return [
        source.alias("__source"),
        n_words(docs["text"]).alias("__size"),
        exponential_key(docs["doc_id"], quality_weight(docs["text"]), seed).alias("__key"),
    ]


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """Of (__source, __source_size), one row per source: adds __target. Weights repeat over the sources by code point; the total is
    share times all sizes; what a source would have above cap times its size goes to the others by weight."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("__n", F.row_number().over(everything.orderBy("__source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("__n") % len(weights) + 1)
    ranked = ranked.withColumn("__w", w).withColumn("__cap", F.col("__source_size") * F.lit(cap))
    before = everything.orderBy(F.col("__cap") / F.col("__w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__source_size").over(everything) * F.lit(share)
    left = total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    left_w = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    capped = ranked.withColumn("__capped", F.col("__cap") / F.col("__w") <= left / left_w).withColumn("__total", total)
    free_w = F.sum(F.when(~F.col("__capped"), F.col("__w"))).over(everything)
    spent = F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(everything), F.lit(0.0))
    level = (F.col("__total") - spent) / free_w
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(level * F.col("__w"))
    return capped.select("__source", "__source_size", target.alias("__target"))


def _part(key: Column) -> Column:
    """The number of a key's part, ascending with the key."""
    return F.floor(F.log2(key) * F.lit(float(BUCKETS * PARTS)))


def source_plan(narrow: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per source: __source, __source_size, __target, __epochs and __cut, the last (key, id, size) of its fraction."""
    sizes = narrow.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    targets = written(source_targets(sizes, share, cap, weights), "mix-targets")
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__epochs", epochs)
    rows = (
        narrow.withColumn("__part", _part(F.col("__key"))).withColumn("__bucket", F.floor(F.col("__part") / PARTS))
        .groupBy("__source", "__bucket", "__part", "__key", "doc_id", "__size")
        .agg((F.count("*") * F.col("__size")).alias("__words"))
    )
    rest = F.col("__target") - F.col("__epochs") * F.col("__source_size")
    ends = targets.select(F.col("__source").alias("__s"), F.lit(0).alias("__start"), rest.alias("__rest"))
    inside = rows.join(ends, F.col("__source") == F.col("__s"))
    for unit in ("__bucket", "__part"):
        # of each source, the bucket in which its remainder ends, and of that the part
        sums = inside.groupBy("__source", "__rest", "__start", unit).agg(F.sum("__words").alias("__words"))
        earlier = Window.partitionBy("__source", "__start").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.col("__start") + F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
        ends = sums.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__words") >= F.col("__rest")) & (F.col("__words") > 0))
        ends = written(ends.select(F.col("__source").alias("__s"), F.col(unit).alias("__b"), F.col("__before").alias("__start"), "__rest"), "mix-ends")
        inside = rows.join(ends, (F.col("__source") == F.col("__s")) & (F.col(unit) == F.col("__b")))
    within = Window.partitionBy("__source", "__part").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        inside.withColumn("__at", F.col("__start") + F.coalesce(F.sum("__words").over(within), F.lit(0)))
        .withColumn("__in", F.col("__at") + F.col("__words") / 2 <= F.col("__rest"))
    )
    # a part of which nothing is taken still ends the fraction: it begins where the one before ends
    order = F.struct("__key", F.col("doc_id").alias("__id"), "__size")
    cuts = chosen.groupBy("__source").agg(
        F.max(F.when(F.col("__in"), order)).alias("__cut"), F.min("__part").alias("__from")
    )
    return written(targets.join(cuts, "__source", "left"), "mix-plan")


def _copies() -> Column:
    own = F.struct("__key", F.col("doc_id").alias("__id"), "__size")
    part = (_part(F.col("__key")) < F.col("__from")) | (own <= F.col("__cut"))
    return (F.col("__epochs") + F.when(part, F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix_report(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), seed: int = 1) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source and taken words (repeats counted)."""
    narrow = written(docs.select("doc_id", *_keyed(docs, seed)), "mix-sizes")
    plan = source_plan(narrow, share, cap, weights)
    return (
        narrow.join(plan, "__source")
        .select(
            "doc_id",
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            (_copies() * F.col("__size")).alias("taken"),
        )
    )


def mix_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), seed: int = 1) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns. The texts aren't shuffled: the plan, a row
    per source, is joined to them (broadcast by Spark where its written size is below autoBroadcastJoinThreshold)."""
    plan = source_plan(written(docs.select("doc_id", *_keyed(docs, seed)), "mix-sizes"), share, cap, weights)
    keyed = docs.select(row_of(docs), "doc_id", *_keyed(docs, seed))
    copies = keyed.join(plan, "__source").withColumn("__copies", _copies()).where("__copies > 0")
    return copies.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>{}[]=_~^@', '')))
              / greatest(length(coalesce(text, '')), 1))
              * (len(list_distinct(string_split(coalesce(text, ''), chr(10)))) / len(string_split(coalesce(text, ''), chr(10))))
              * CASE WHEN length(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
                          / greatest(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), 1) BETWEEN 2 AND 15 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS k
  FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size FROM base GROUP BY s),
numbered AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY s) - 1) % 3)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
filled AS (
  SELECT *, cap / w <= (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS capped
  FROM numbered WINDOW b AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () AS lvl FROM filled),
targets AS (SELECT s, source_size, CASE WHEN capped THEN cap ELSE lvl * w END AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS e FROM targets),
ordered AS (
  SELECT base.*, e, target, source_size,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base JOIN epochs USING (s))
SELECT doc_id, size, source_size, target, (e + CASE WHEN before + size / 2.0::DOUBLE <= target - e * source_size AND source_size > 0 THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM ordered
"""
