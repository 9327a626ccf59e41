"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets of about ``bucket_bytes``, by a seeded hash of the whole record.
Pass two holds one bucket at a time: it is put into a canonical order (another seeded hash), Fisher-Yates shuffled, and
written.  Bucket k is task k of the scatter, and the shuffle is seeded with seed + k, so the order depends on the
records, the seed and the bucket size alone, not on the cluster, and a lost task is redone alike.

Law ``rows``: the buckets laid end to end are cut into shards whose row counts differ by one at most.  A bucket lies in
few shards, so few files are written.

Records that are equal in every column and come more than HOT_ROWS times are counted and written out again with a
number each, which is hashed with them; so no bucket holds all of them.  Equal records are exchangeable, so this changes
nothing but their places.

Defined results: null texts have no bytes (size 1, CRC-32 0); empty tables give no rows; repeated rows each get a place
of their own; very long texts only make their bucket longer; columns named like an added one are replaced, any other
names may be used.  Columns must be orderable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import Workspace

SHARDS = 16
BUCKET_BYTES = 24 << 20
SEED = 20240601
#: One row of two longs a bucket is broadcast up to here; beyond, the join is left to the planner.
BROADCAST_BUCKETS = 1 << 20
GROUP = 4096
#: Equal records from this number on are numbered; those of the MOST_HOT greatest counts, which bounds a broadcast.
HOT_ROWS, MOST_HOT = 1000, 4096


def record_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long")


def numbered(own: DataFrame, record: list[Column], seed: int) -> DataFrame:
    """The records with a hash each (h); records of many equal ones are numbered before they are hashed."""
    h = F.xxhash64(F.lit(seed), *record)
    counts = own.groupBy(h.alias("h")).agg(F.count("*").alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h", F.lit(True).alias("hot")))
    marked = own.withColumn("h", h).join(hot, "h", "left")
    plain = marked.where("hot is null").select(*record, "h")
    many = marked.where("hot").groupBy(*record).agg(F.count("*").alias("n"))
    # copies are written out by blocks of HOT_ROWS, which are dealt to the tasks
    blocks = many.select(*record, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / HOT_ROWS))).alias("b")).repartition(F.col("b"))
    number = F.explode(F.sequence(F.col("b") * HOT_ROWS, F.least((F.col("b") + 1) * HOT_ROWS, F.col("n")) - 1))
    copies = blocks.select(*record, number.alias("i")).select(*record, F.xxhash64(F.lit(seed), *record, F.col("i")).alias("h"))
    return plain.unionByName(copies)


def starts_of(counts: DataFrame) -> DataFrame:
    """(b, start) of bucket counts (bucket, n): prefix sums within groups of GROUP buckets, and over the groups."""
    own = counts.withColumn("g", F.floor(F.col("bucket") / GROUP))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    groups = own.groupBy("g").agg(F.sum("n").alias("all"))
    before = groups.select("g", F.coalesce(F.sum("all").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.withColumn("within", F.coalesce(within, F.lit(0))).join(before, "g").select(F.col("bucket").alias("b"), (F.col("before") + F.col("within")).alias("start"))


def external_shuffle(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The documents with shard and slot (gapless from 0 in each shard), each bucket's rows in their new order."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    # columns c0, c1, ... clash with nothing
    names = [f"c{k}" for k in range(len(columns))]
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    size = (F.coalesce(F.octet_length(F.col(f"c{columns.index(text_col)}")), F.lit(0)) + 1).cast("long")
    total, rows = own.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    record = [F.col(n) for n in names]
    placed = numbered(own, record, seed).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = starts_of(counts)
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    scattered = placed.repartitionById(buckets, F.col("bucket"))
    held = scattered.groupBy("bucket").agg(F.collect_list(F.struct(F.xxhash64(F.lit(~seed), "h").alias("key"), F.struct(*record).alias("row"))).alias("rows"))
    shuffled = held.select("bucket", F.posexplode(F.shuffle(F.sort_array("rows"), seed)).alias("p", "r"))
    at = shuffled.join(starts, F.col("bucket") == F.col("b")).select((F.col("start") + F.col("p")).alias("at"), "r.row")
    at = at.withColumn("shard", F.expr(f"(at * {shards}L) div {max(rows, 1)}L").cast("int"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return at.select(*(F.col(f"row.{n}").alias(c) for c, n in zip(columns, names, strict=True)), "shard", (F.col("at") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Shuffles the documents into folders shard=0, shard=1, ... of Parquet files, and reads those."""
    out = external_shuffle(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = write_shards(docs, f"{Workspace(spark, 'shards').path}/documents")
    return written.select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
