"""Target-distribution importance resampling in DataFrame functions only.

Features are all runs of 1 to ``longest`` consecutive words (0-9, a-z and non-ASCII characters of the text with A-Z
lower-cased), joined by a blank; each falls into the bucket of its crc32.  Two grouped counts over the buckets, one of
the whole corpus and one of the whole target, give each bucket an integer gain of log likelihood; features are joined
with that table (``buckets`` rows, broadcast) and summed by document.  Gumbel noise, seeded by the document's id, is
added, and the documents of highest score are drawn: a sample without replacement in proportion to importance.

Ranks come from a distributed sort: candidates are dealt by ranges of score, each range is sorted and numbered on its
own, and the ranges' row counts, added up in order, give each its offset.  Rows that are equal in id and text are one
group from the first count on, with the number of its copies, and are dealt out again at the end; so no key, however
hot, has to be sorted row by row.

Defined results: null texts and texts without a word have no features, weight 0, and are never drawn (unless
``least_words`` is 0); a null id counts as the empty one in the noise and comes last among ties; rows of equal id and
score are ordered by the hash of their text, repeated rows take ranks next to each other; an empty target gives each
bucket the gain of one without target features; an empty corpus gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import Workspace

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The words of a text, none for null."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.translate(plain, _UPPER, _LOWER), " "))


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, repeats included."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *map(runs, range(2, longest + 1))) if longest > 1 else words


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text: Column, longest: int, buckets: int, name: str) -> DataFrame:
    each = texts.select(F.explode(ngrams(word_array(text), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, text: Column, target: DataFrame, target_text: Column, space: Workspace, longest: int, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that the corpus or the target uses."""
    counts = bucket_counts(docs, text, longest, buckets, "s").join(bucket_counts(target, target_text, longest, buckets, "t"), "bucket", "full")
    counts = space.save(counts.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))), "counts")
    s_all, t_all = counts.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1) * F.lit(s_all + buckets) / ((F.col("s") + 1) * F.lit(t_all + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """Integer Gumbel noise in thousandths, a function of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(groups: DataFrame, order: list[Column], space: Workspace, name: str) -> DataFrame:
    """The groups (with their number of copies) and ``before``, the rows of all groups that come before each in order."""
    dealt = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the range, and of the row in it
    at = F.monotonically_increasing_id()
    dealt = space.save(dealt.withColumn("at", at).withColumn("range", F.shiftright("at", 33).cast("int")), f"{name}-ranges")
    totals = dealt.groupBy("range").agg(F.sum("copies").alias("rows"))
    # one row a range: as many as the sort has partitions
    offsets = totals.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("offset"))
    inside = F.sum("copies").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    return dealt.withColumn("inside", inside).join(F.broadcast(offsets), "range").withColumn("before", F.col("offset") + F.col("inside")).drop("at", "range", "offset", "inside")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null for those that are not drawn."""
    space = Workspace(docs.sparkSession, "resampling")
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    table = gains(docs, text, target, F.col(f"`{target_text_col}`"), space, longest, buckets)
    # copies of a row share a group; a feature's place tells how many there are
    words = docs.select(key.alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("fp"), word_array(text).alias("words"))
    each = words.select("id", "fp", F.size("words").alias("n_words"), F.posexplode_outer(ngrams(F.col("words"), longest)).alias("place", "feature"))
    each = each.withColumn("bucket", bucket(F.col("feature"), buckets)).drop("feature").join(F.broadcast(table), "bucket", "left")
    sums = each.groupBy("id", "fp", "n_words").agg(
        F.count_if(F.coalesce(F.col("place"), F.lit(0)) == 0).alias("copies"),
        F.count("place").alias("features"),
        F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"),
    )
    # every copy adds the same, so the divisions have no remainder
    share = sums.select("id", "fp", "n_words", "copies", F.expr("features div copies").alias("n_features"), F.expr("gains div copies").alias("weight"))
    scored = space.save(share.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("fp").asc()]
    drawn = ranked(fit, order, space, "drawn").union(scored.where(F.col("n_words") < least_words).withColumn("before", F.lit(None).cast("long")))
    rows = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rank = F.col("before") + F.col("copy")
    out = rows.select("id", "n_features", "weight", "score", F.when(rank <= math.floor(percent * n / 100), rank).alias("rank"))
    space.keep("scores", "drawn-ranges")
    return out


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, bench).withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)), k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(w) AS f FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS f FROM benchmark),
vocabulary AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
hashed AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(generate_series(1, length(x), 2),
    lambda i: CAST((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INTEGER)]))) % {BUCKETS} AS b FROM vocabulary, crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), totals),
w AS (SELECT r, sum(gain) AS weight FROM dw JOIN hashed USING (f) JOIN g USING (b) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
ranked AS (SELECT *, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS rank FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM ranked
"""
