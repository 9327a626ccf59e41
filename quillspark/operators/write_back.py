"""Writing translations back: which edits of a document count, the texts they make, and the files that come of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.particles import ends_in_leading, leading_particle

from quillspark.operators.intervals import apply_edits, inside, without_overlap

EDIT = ["document_id", "start", "length", "value"]


def chosen_edits(segments: DataFrame, planned: DataFrame, particles: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The edits (document_id, start, length, value, source) that count, of four sources.

    A segment inside a planned edit keeps its original.  Planned edits lose to segments and to particles, identifiers to
    everything, particles to segments."""
    place = ["document_id", "start", "length"]
    kept = segments.join(inside(segments, planned, "document_id"), place, "left_anti").select(*EDIT)
    renames = without_overlap(planned.select(*EDIT), kept.select(*place).union(particles.select(*place)), "document_id")
    taken = kept.select(*place).union(renames.select(*place)).union(particles.select(*place))
    names = without_overlap(identifiers.select(*EDIT), taken, "document_id")
    asked = without_overlap(particles.select(*EDIT), kept.select(*place), "document_id")
    out = kept.withColumn("source", F.lit("segment"))
    for source, rows in (("symbol", renames), ("identifier", names), ("particle", asked)):
        out = out.unionByName(rows.withColumn("source", F.lit(source)))
    return out


def led_particles(segments: DataFrame, key: str, order: str, value: str, reset: Column) -> DataFrame:
    """The segments of each key in order, a particle that a value begins with put right by what is put out before it.

    What is put out may itself have been put right, so a value follows from all before it.  But only the end of the value
    before counts, and that changes only where a value ends in its leading particle; so runs of such values are folded
    from their first on, and all others stand alone.  ``reset``: a segment that is left as it is and tells nothing."""
    w = Window.partitionBy(key).orderBy(order)
    own = segments.withColumn("__reset", reset)
    before = F.lag(F.when(~F.col("__reset"), F.col(value))).over(w)
    own = own.withColumn("__before", before).withColumn("__open", ~F.col("__reset") & ends_in_leading(F.col(value)))
    begins = F.col("__reset") | F.col("__before").isNull() | ~F.lag("__open").over(w)
    own = own.withColumn("__begins", begins).withColumn("__run", F.sum(F.col("__begins").cast("int")).over(w))
    own = own.withColumn("__alone", F.col("__begins") & F.coalesce(F.lead("__begins").over(w), F.lit(True)))
    alone = own.where("__alone").withColumn(value, F.when(F.col("__reset"), F.col(value)).otherwise(leading_particle(F.col("__before"), F.col(value))))
    rest = own.where("not __alone")
    rows = rest.groupBy(key, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__before").alias("b"), F.col(value).alias("v"), F.col("__reset").alias("r")))).alias("rows"))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        put = F.when(x["r"], x["v"]).otherwise(leading_particle(F.coalesce(a["last"], x["b"]), x["v"]))
        return F.element_at(F.transform(F.array(put), lambda p: F.struct(F.when(~x["r"], p).alias("last"), F.concat(a["out"], F.array(p)).alias("out"))), 1)

    folded = rows.select(key, "__run", F.col("rows.o").alias("o"), F.aggregate("rows", zero, step, lambda a: a["out"]).alias("out"))
    folded = folded.select(key, F.explode(F.arrays_zip("o", "out")).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.out").alias("__new"))
    put = rest.join(folded, [key, order]).withColumn(value, F.col("__new"))
    return alone.select(*segments.columns).unionByName(put.select(*segments.columns))


def written(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """(document_id, text, edits): documents (document_id, text) with their disjoint edits put in."""
    own = edits.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "value"))).alias("e"))
    out = documents.join(own, "document_id", "left")
    none = F.array().cast("array<struct<start:int,length:int,value:string>>")
    return out.select("document_id", F.when(F.col("e").isNull(), F.col("text")).otherwise(apply_edits(F.col("text"), F.col("e"))).alias("text"), F.size(F.coalesce(F.col("e").cast(none_type()), none)).alias("edits"))


def none_type() -> str:
    return "array<struct<start:int,length:int,value:string>>"


def export_list(files: DataFrame, documents: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, outcome) of a whole tree: written if it has edits, copied otherwise, skipped if it could not be read."""
    has = edits.select(F.col("document_id").alias("path"), F.lit(True).alias("__e")).distinct()
    known = documents.select(F.col("document_id").alias("path"), F.lit(True).alias("__d")).distinct()
    out = files.join(known, "path", "left").join(has, "path", "left")
    outcome = F.when(F.col("__e") & F.col("__d"), "written").when(F.col("__d").isNull() & F.col("is_source"), "skipped").otherwise("copied")
    return out.select("path", outcome.alias("outcome"))


def backup_list(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """The files that an in-place save changes, each once: what goes to the backup archive."""
    return documents.join(edits.select("document_id").distinct(), "document_id", "left_semi")


def inside_expression(text: Column, start: Column) -> Column:
    """Whether a place is inside a percent or brace expression, or the arguments of a call, judged by its line before it."""
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    bare = F.regexp_replace(before, '"[^"]*(?:"|$)', '""')

    def open_(opens: str, closes: str) -> Column:
        marks = F.regexp_extract_all(bare, F.lit(f"[{opens}{closes}]"), F.lit(0))
        return F.aggregate(marks, F.lit(0), lambda a, c: F.when(c == opens.strip("\\"), a + 1).otherwise(F.greatest(a - 1, F.lit(0)))) > 0

    called = open_("(", ")") & bare.rlike(r"[\p{L}\p{N}_]\s*\([^(]*$")
    return bare.contains("%") | open_("{", "}") | called
