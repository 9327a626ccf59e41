"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule has a condition that rejects a document.  On a sample of the documents (``sample_rows`` rows expected, the
documented bound) each rule's cost is timed, less that of a query without a rule, and its share of rejected rows
counted; the rules then run in order of rejection per cost as one CASE, which stops at a document's first rejecting
rule.  The order changes the work, never the verdict: a document is kept if no rule rejects it.  The figures of a text
are returned for every document, so their cost is paid whatever the order and is not part of a rule's.

Figures of a whole text (words are runs of other than blank, tab, line feed, VT, FF and CR): n_words, word_chars,
n_symbols, n_dup_lines, n_repeat_words; see ``figures``.

Defined results: null and empty texts have no words and only zero figures, so they fail the base rule; repeated rows
are judged alike; an empty table gives no rows; columns of the documents that clash with an added column are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import Workspace, positional

SAMPLE_ROWS = 2000
PROBES = 2
#: Seconds below which the cost of a rule cannot be told from none.
LEAST_COST = 1e-3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once.

    A column of its own would not do: where a filter is pushed below it, its expression is put in the place of every
    use, those inside lambdas included, and is then worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the five figures (long).  n_repeat_words counts the words that lie in a 3-word window found
    twice or more in the text: windows are sorted by a hash, then by their words and places, those equal to a neighbour
    are repeated, and each repeated place covers the words up to the next one, three at most."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    plain, name = positional(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names or c == text_col)))
    text = F.coalesce(F.col(name[text_col]), F.lit(""))

    def windows(w: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

        none = F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:int>>")
        return F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))).otherwise(none)

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(t: Column) -> Column:
        twice = F.filter(t, lambda x, j: same(F.get(t, j - 1), x) | same(F.get(t, j + 1), x))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            bound(windows(w), lambda t: bound(places(t), covered)).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    df = plain.select(*plain.columns, bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("f"), text.alias("whole"), lines.alias("lines"))
    return df.select(
        *(F.col(new).alias(old) for old, new in name.items() if old not in names),
        "f.n_words",
        "f.word_chars",
        (F.length("whole") - F.length(F.regexp_replace("whole", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "f.n_repeat_words",
    )


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 50), Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))]


def text_rules(text_col: str = "text") -> list[Rule]:
    """Rules on the figures and on the text; each rejects what prose does not do."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.greatest(F.regexp_count(text, F.lit(r"[^\x0A]+")), F.lit(1))
    words = F.col("n_words")
    return [
        Rule("mean_word_length", ~share(F.col("word_chars"), words).between(2, 20)),
        Rule("symbols", share(F.col("n_symbols"), words) > 0.3),
        Rule("repeated_lines", share(F.col("n_dup_lines"), lines) > 0.5),
        Rule("wordless", share(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]*+\p{L}")), words) < 0.6),
        Rule("bullets", share(F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*+[-*•]")), lines) > 0.9),
        Rule("ellipses", share(F.regexp_count(text, F.lit(r"(?m)(?:\.\.\.|…)[\x20\x09]*+$")), lines) > 0.3),
        Rule("capitals", share(F.length(F.regexp_replace(text, r"\P{Lu}++", "")), F.col("word_chars")) > 0.5),
    ]


def timed(probe: DataFrame) -> tuple[float, float | None]:
    """The least of PROBES times of a query of one row, and its value; the first run compiles it and does not count."""
    value, took = probe.first()[0], []
    for _ in range(PROBES):
        began = time.perf_counter()
        probe.collect()
        took.append(time.perf_counter() - began)
    return min(took), value


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejection per cost, with cost (seconds) and share of rejected rows on the sample."""
    space = Workspace(docs.sparkSession, "rule-sample")
    rows = docs.count()
    sample = space.save(figures(docs.sample(min(1.0, sample_rows / max(rows, 1)), seed=seed), text_col), "sample")
    out = []
    empty, _ = timed(sample.agg(F.count("*")))
    for rule in rules:
        took, rejected = timed(sample.agg(F.avg(F.coalesce(rule.rejects, F.lit(False)).cast("int"))))
        # what the job costs without a rule is not the rule's
        out.append((rule, max(took - empty, LEAST_COST), rejected or 0.0))
    space.drop("sample")
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1]))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, in the order given, else null; later rules are then not evaluated."""
    case = F
    for k, rule in enumerate(rules):
        case = case.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(k))
    return case.otherwise(F.lit(None).cast("int"))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with the figures, base_failed and kept."""
    base = base_rules()
    rules = base + text_rules(text_col) if rules is None else rules
    columns = [c for c in docs.columns if c not in ("base_failed", "kept")]
    own = docs.select(*(F.col(f"`{c}`") for c in columns))
    measured = figures(own, text_col)
    by_worth = [r for r, _, _ in ordered(own, rules, text_col, sample_rows)]
    failed = base[0].rejects | base[1].rejects
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(by_worth).isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS s(i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY r),
f AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         CAST(greatest(len(w), 1) AS DOUBLE) AS nw,
         CAST(greatest(len(regexp_extract_all(t, '[^\x0A]+')), 1) AS DOUBLE) AS nl,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS DOUBLE) AS lettered,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS bullets,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS ellipses,
         length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals
  FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nw BETWEEN 2 AND 20 AND n_symbols / nw <= 0.3 AND n_dup_lines / nl <= 0.5
       AND lettered / nw >= 0.6 AND bullets / nl <= 0.9 AND ellipses / nl <= 0.3
       AND capitals / CAST(greatest(word_chars, 1) AS DOUBLE) <= 0.5 AS kept
FROM b
"""
