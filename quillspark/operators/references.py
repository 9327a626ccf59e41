"""Symbol references: impact of an item by namespace aliases and candidate keys, and keys passed on through calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.shared import saved

# Namespaces whose keys also name entries of others.
ALIASES = {
    "BASE": ["BASE", "MAXBASE", "DOWNBASE"],
    "DOWNBASE": ["DOWNBASE", "BASE", "MAXBASE"],
    "STRNAME": ["STRNAME", "STR"],
    "STR": ["STR", "STRNAME"],
    "ITEM": ["ITEM", "ITEMPRICE", "ITEMSALES"],
    "ITEMPRICE": ["ITEMPRICE", "ITEM", "ITEMSALES"],
    "ITEMSALES": ["ITEMSALES", "ITEM", "ITEMPRICE"],
    "PALAM": ["PALAM", "JUEL", "CUP", "CDOWN"],
    "JUEL": ["JUEL", "PALAM", "CUP", "CDOWN"],
    "SOURCE": ["SOURCE", "CUP", "CDOWN"],
    "CDOWN": ["CDOWN", "PALAM", "JUEL", "CUP"],
    "EX": ["EX", "NOWEX"],
    "NOWEX": ["NOWEX", "EX"],
}
ROUNDS = 8
KINDS = ["unresolved", "ambiguous", "indirect", "direct"]


def alias_groups(aliases: dict[str, list[str]]) -> dict[str, str]:
    """Each namespace with the least one of its group; what an item names is always in one group."""
    group: dict[str, str] = {}
    for own, others in aliases.items():
        joined = {group.get(x, x) for x in (own, *others)}
        members = joined | {x for x, g in group.items() if g in joined} | {own, *others}
        group |= dict.fromkeys(members, min(members))
    return group


def reference_impact(items: DataFrame, references: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Items (item_id, namespace, keys) with impact (distinct references that name them) and status.

    References have reference_id, namespace, key, candidates (array), kind.  Items, and references of a kind, that name the
    same are one class; classes are joined on equal names, each pair at the least name it shares, so neither members of
    classes nor pairs of them are put side by side.  Statuses follow unresolved > ambiguous > indirect > direct > none."""
    known = ALIASES if aliases is None else aliases
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    groups = F.create_map(*(F.lit(x) for pair in alias_groups(known).items() for x in pair))
    group = F.coalesce(F.try_element_at(groups, F.col("namespace")), F.col("namespace")).alias("group")
    none = F.array().cast("array<string>")

    def names(spaces: Column, keys: Column) -> Column:
        """Every namespace with every key, as one string that tells where the namespace ends."""
        keys = F.array_compact(keys)
        return F.array_sort(F.array_distinct(F.flatten(F.transform(spaces, lambda s: F.transform(keys, lambda k: F.concat(F.length(s).cast("string"), F.lit(":"), s, k))))))

    def whole(rows: DataFrame, *keys: str) -> DataFrame:
        """One row of the keys, with all that its rows name."""
        return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))

    def counted(a: DataFrame, b: DataFrame) -> DataFrame:
        """(item_id, impact, a column for each of KINDS) of items and references of (id, group, names)."""
        b = whole(b, "reference_id", "kind", "group").groupBy("names", "kind").agg(F.count("*").alias("members"))
        asked = a.select(F.col("names").alias("item_names")).distinct().select("item_names", F.explode("item_names").alias("name"))
        pairs = asked.hint("merge").join(b.select("names", "kind", "members", F.explode("names").alias("name")), "name")
        pairs = pairs.where(F.col("name") == F.array_min(F.array_intersect("item_names", "names")))
        out = pairs.groupBy("item_names").agg(F.sum("members").alias("impact"), *(F.bool_or(F.col("kind") == kind).alias(kind) for kind in KINDS))
        return a.join(out.hint("merge"), F.col("names") == F.col("item_names")).select("item_id", "impact", *KINDS)

    spaces = F.coalesce(F.try_element_at(table, F.col("namespace")), F.array("namespace"))
    a = items.where("namespace is not null").select("item_id", group, names(spaces, F.coalesce(F.col("keys").cast("array<string>"), none)).alias("names"))
    a = saved(whole(a, "item_id", "group"), "impact-items")
    named = F.filter(F.concat(F.array("key"), F.coalesce("candidates", none)), lambda k: F.trim(k) != "")
    b = references.where("namespace is not null").select("reference_id", "kind", group, names(F.array("namespace"), named).alias("names"))
    # an id whose rows are in several groups is held against all that a reference names
    several = a.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id")
    if several.isEmpty():
        found = counted(a, b)
    else:
        several = saved(several, "impact-several")
        found = counted(a.join(several, "item_id", "left_anti"), b)
        rest = whole(a.join(several, "item_id", "left_semi").withColumn("group", F.lit("")), "item_id", "group")
        found = found.unionByName(counted(rest, b.withColumn("group", F.lit(""))))
    ladder = F
    for kind in KINDS:
        ladder = ladder.when(F.col(kind), kind)
    found = found.select("item_id", "impact", ladder.otherwise("none").alias("status"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("impact", F.lit(0)).alias("impact"), F.coalesce("status", F.lit("none")).alias("status"))


def propagate_keys(known: DataFrame, calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Arguments that hold keys: known (function, argument, namespace) passed back along calls (caller, parameter,
    callee, argument), a caller's parameter given as a key argument being one itself; ``rounds`` rounds at most.

    Of several namespaces found for an argument, the earliest round's counts, then the least name."""
    done = saved(known.groupBy("function", "argument").agg(F.min("namespace").alias("namespace")), "keys-0")
    calls = saved(calls, "keys-calls")
    fresh = done
    for r in range(1, rounds + 1):
        # files of short names are small for their rows, so their size must not make them broadcast
        step = calls.join(fresh.withColumnRenamed("function", "callee").hint("merge"), ["callee", "argument"])
        step = step.groupBy(F.col("caller").alias("function"), F.col("parameter").alias("argument")).agg(F.min("namespace").alias("namespace"))
        fresh = saved(step.join(done.hint("merge"), ["function", "argument"], "left_anti"), f"keys-{r}")
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    return done
