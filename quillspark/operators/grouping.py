"""Grouping operators: keyed choice of rows, groups of identical text, name collisions, precedence and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by an aggregate of ordered structs: combined before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("row"))).alias("x"))
    return first.select(*keys, "x.row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("row"))).alias("x"))
    return last.select(*keys, "x.row.*").select(*df.columns)


def only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


def propagate_unique(items: DataFrame, text: str, translation: str) -> DataFrame:
    """The items, untranslated ones given their text's translation if it has exactly one."""
    one = only_one(items.where(F.col(translation).isNotNull()), [text], translation).withColumnRenamed(translation, "__one")
    return items.join(one, text, "left").withColumn(translation, F.coalesce(translation, "__one")).drop("__one").select(*items.columns)


def canonical_per_text(items: DataFrame, text: str, translation: str, order: list[Column]) -> DataFrame:
    """(text, translation, members): the translation of first order for every text of two items or more."""
    ordered = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(translation).alias("t"))
    out = items.groupBy(text).agg(F.min(F.when(F.col(translation).isNotNull(), ordered)).alias("x"), F.count("*").alias("members"))
    return out.where("members > 1 and x is not null").select(text, F.col("x.t").alias(translation), "members")


def resolve_collisions(df: DataFrame, scope: list[str], new: str, old: str, order: list[Column]) -> DataFrame:
    """The rows with ``new`` made distinct: the first row of each new name keeps it, others get __ and the old name."""
    w = Window.partitionBy(*scope, new).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).withColumn(new, F.when(F.col("__n") > 1, F.concat(new, F.lit("__"), old)).otherwise(F.col(new))).drop("__n")


def drop_ambiguous(df: DataFrame, scope: list[str], target: str, name: str) -> DataFrame:
    """Rows whose target is that of one name only within the scope."""
    counts = df.groupBy(*scope, target).agg(F.min(name).alias("__a"), F.max(name).alias("__b")).where("__a = __b").select(*scope, target)
    return df.join(counts, [*scope, target], "left_semi").select(*df.columns)


def by_precedence(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of layers where the row of the last layer that has a key counts."""
    tagged = [layer.withColumn("__p", F.lit(i)) for i, layer in enumerate(layers)]
    out = tagged[0]
    for layer in tagged[1:]:
        out = out.unionByName(layer)
    return keep_last(out, key, [F.col("__p")]).drop("__p")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return by_precedence([current, changes], keys)


def delete_keys(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys, keys.columns, "left_anti")


def refresh_states(previous: DataFrame, current: DataFrame, key: str, hashed: str) -> DataFrame:
    """(key, state): hit, miss, updated or deleted, by comparing the hashes of two versions."""
    a = previous.select(key, F.col(hashed).alias("was"))
    b = current.select(key, F.col(hashed).alias("now"))
    state = F.when(F.col("was").isNull(), "miss").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "hit").otherwise("updated")
    return a.join(b, key, "full").select(key, state.alias("state"))


def retained(df: DataFrame, key: str, order: Column, active: Column, n: int) -> DataFrame:
    """Per key, the n newest rows and every active one."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") <= n) | active).drop("__n")


def batches(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """The rows with batch: runs of ``size`` rows within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
