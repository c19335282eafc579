"""Joins, set operations, merges and splits by which a corpus is put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def checked_union(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of parts that must not share a key: fails when it runs into a repeated one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    n = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit("repeated key "), F.col(key).cast("string"))
    return whole.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("__n")


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of parts in their order: of rows with one key the first part's, rows with a null key left out."""
    whole = None
    for i, p in enumerate(parts):
        p = p.dropna(subset=keys).withColumn("__part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p)
    rest = [c for c in whole.columns if c not in keys]
    best = whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__part", *[c for c in rest if c != "__part"])).alias("__row"))
    return best.select(*keys, "__row.*").drop("__part")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """base with the rows of changes in place of or beside its own, without the excluded keys."""
    kept = base.join(changes.select(*keys), keys, "left_anti")
    out = kept.unionByName(changes.select(*base.columns))
    return out if excluded is None else out.join(excluded.select(*keys), keys, "left_anti")


def coalesced_stages(stages: list[str]) -> Column:
    """The first stage that isn't null, in order of precedence."""
    return F.coalesce(*[F.col(s) for s in stages])


def leaking(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.sort_array(F.collect_set(split)).alias("splits")).where("n_splits > 1")


def hashed_split(df: DataFrame, group: str, shares: dict[str, float], seed: int) -> DataFrame:
    """A split of whole groups, so that none leaks: each group's hash from 0 to 1 falls into one of the shares, laid end to end.
    Assignment is by group alone and needs no other row, at any size."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    total, at, out = sum(shares.values()), 0.0, F.when(F.lit(False), F.lit(""))
    for name, share in shares.items():
        at += share / total
        out = out.when(u < at, F.lit(name))
    return df.withColumn("split", out.otherwise(F.lit(list(shares)[-1])))


def balanced_shards(weights: DataFrame, key: str, weight: str, n_shards: int) -> DataFrame:
    """Whole keys dealt to shards, the heaviest first, forwards and backwards by turns: within one heaviest key of balance, without
    a running choice over all keys. Ranks come from sorted ranges and their sizes."""
    turn, place = F.floor(F.col("__r") / n_shards), F.col("__r") % n_shards
    return numbered(weights, [F.desc(weight), F.col(key)], "__r").withColumn("shard", F.when(turn % 2 == 0, place).otherwise(n_shards - 1 - place).cast("int")).drop("__r")


def last_targets(patches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of patches (keys, field, value, order) the value that each field has after all: last write wins."""
    return patches.groupBy(*keys, "field").agg(F.max_by("value", order).alias("value"))


def applied_edits(plan: DataFrame, edits: DataFrame, group: str, key: str) -> DataFrame:
    """All or nothing: a group's edits (group, key, expected, new) apply only if every one meets the value it expects."""
    met = edits.join(plan.select(group, key, "value"), [group, key], "left").withColumn("ok", F.coalesce(F.col("value") == F.col("expected"), F.lit(False)))
    sure = met.groupBy(group).agg(F.bool_and("ok").alias("all_ok")).where("all_ok").select(group)
    good = edits.join(sure, group, "left_semi").select(group, key, "new")
    return plan.join(good, [group, key], "left").select(group, key, F.coalesce("new", "value").alias("value"))


def minimal_patches(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One patch per field that differs: key, field, before and after as text, in long form."""
    both = before.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields]).join(after.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]), key)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields]))
    return both.select(key, each.alias("x")).select(key, "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def merged_turns(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Neighbouring turns of one role as one message: keys, position, role and text."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col("role").eqNullSafe(F.lag("role").over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    runs = turns.withColumn("__new", new).withColumn("position", F.sum("__new").over(w))
    texts = F.sort_array(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t"))))
    return runs.groupBy(*keys, "position").agg(F.first("role").alias("role"), F.array_join(F.transform(texts, lambda x: x["t"]), "\n").alias("text"))


#: Kinds of patches; any other one is an error.
PATCHES = ["REPOSITION", "ADD", "REMOVE", "NO_OP", "OTHER"]


def replayed_patches(plan: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Of a plan (key, string, techniques) and patches (key, order, kind, before, after, technique), what each key's action is after its patches, how many
    applied, and the errors of the others in their order: missing (no action, which only an added technique may begin), before (not what it
    expects), absent (a technique to be removed) and unknown. A fold over a key's patches, one row of them."""
    listed = patches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", "kind", "before", "after", "technique"))).alias("p"))
    none = F.array().cast("array<string>")
    rows = listed.join(plan.withColumn("there", F.lit(True)), key, "left")
    begin = F.struct(
        F.col("string").cast("long").alias("string"), F.coalesce("techniques", none).alias("t"), F.lit(0).alias("applied"), none.alias("errors"), F.coalesce("there", F.lit(False)).alias("there")
    )

    def step(s: Column, p: Column) -> Column:
        kind = p["kind"]
        error = (
            F.when(~s["there"] & (kind != "ADD"), "missing").when((kind == "REPOSITION") & p["before"].isNotNull() & ~p["before"].eqNullSafe(s["string"]), "before")
            .when((kind == "REMOVE") & ~F.array_contains(s["t"], p["technique"]), "absent").when(~kind.isin(*PATCHES[:4]), "unknown")
        )
        good = error.isNull()
        more = F.when(good & (kind == "ADD") & ~F.array_contains(s["t"], p["technique"]), F.array_append(s["t"], p["technique"])).when(good & (kind == "REMOVE"), F.array_remove(s["t"], p["technique"])).otherwise(s["t"])
        return F.struct(
            F.when(good & (kind == "REPOSITION"), p["after"].cast("long")).otherwise(s["string"]).alias("string"), more.alias("t"), (s["applied"] + good.cast("int")).alias("applied"),
            F.when(good, s["errors"]).otherwise(F.array_append(s["errors"], error)).alias("errors"), (s["there"] | (kind == "ADD")).alias("there"),
        )

    return rows.select(key, F.aggregate("p", begin, step).alias("x")).select(key, "x.string", F.col("x.t").alias("techniques"), "x.applied", "x.errors")


def warning_lifecycle(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Of turns (key, order, current: warnings, informed: edits that knew their candidates), the pending and attempted warnings of each key after the last one."""
    none = F.array().cast("array<bigint>")

    def step(s: Column, t: Column) -> Column:
        later = F.array_intersect(t["informed"], s["pending"])
        pending = F.array_except(F.array_union(s["pending"], t["current"]), F.array_except(later, t["current"]))
        return F.struct(pending.alias("pending"), F.array_union(s["attempted"], later).alias("attempted"))

    whole = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "current", "informed"))).alias("t"))
    return whole.select(key, F.aggregate("t", F.struct(none.alias("pending"), none.alias("attempted")), step).alias("x")).select(key, "x.*")


def keyed_merge(source: DataFrame, parts: list[DataFrame], keys: list[str], kept: list[str]) -> DataFrame:
    """The rows of parts by key, with at, which sorts as the source does, and unchanged, whether the kept fields are the source's. A key that comes twice or
    not at all fails the job."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    others = [c for c in whole.columns if c not in keys]
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    one = whole.groupBy(*keys).agg(F.first(F.struct(*others)).alias("row"), F.count("*").alias("n"))
    found = source.select(*keys, F.struct(*kept).alias("own"), F.monotonically_increasing_id().alias("at")).join(one, keys, "left")
    wrong = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("missing key "), name)).cast("boolean")).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key "), name)).cast("boolean"))
    same = F.struct(*[F.col(f"row.{c}").alias(c) for c in kept]).eqNullSafe(F.col("own"))
    return found.where(F.coalesce(wrong, F.lit(True))).select(*keys, "at", *[F.col(f"row.{c}").alias(c) for c in others], same.alias("unchanged"))


#: Markers of state, which aren't techniques.
STATE_MARKERS = ["泛起", "泛止"]


def without_markers(techniques: Column) -> Column:
    return F.filter(techniques, lambda x: ~x.isin(*STATE_MARKERS))


def same_tuning(rows: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """rows whose two statements of seven open strings agree; any that don't fail the job."""
    agree = (F.size(one) == 7) & (F.size(other) == 7) & F.forall(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x)
    message = F.concat(F.lit("tuning differs for "), F.col(key).cast("string"))
    return rows.where(F.when(F.coalesce(agree, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))
