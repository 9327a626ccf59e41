"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds.  Four patterns find emails, IP addresses, payment cards (Luhn) and phone numbers, leftmost and non-overlapping
for each kind; matches that fail their test are dropped, without a retry.  The patterns below accept the same strings
as the plain ones, written so that the regex engine neither recurses nor rescans a run of characters.

A fifth kind of seed, ``secret``, is the value given to a name such as token, password or api_key.

Patterns and instances.  Every seed, and every other token that holds a digit or an @ (a candidate), is a mention; its
instance is the token.  A candidate of digits and phone or card punctuation goes on over the tokens of that form after
single blanks.  A mention has lexical patterns of several widths, from specific to general (see ``patterns``): the two
words on the left (L2), the words on both sides (LR), the word on the left (L1), the word on the right (R1), each with
the characters that adjoin the mention on the left, and the shape of the instance itself (S).

The graph of patterns and instances is scored in rounds.  A pattern's score is the weight of its known instances over
all weight it has seen, shrunk by one unseen instance.  What it has seen depends on its width: L2 and LR count their
mentions, known or not; L1 and R1 count every occurrence of their word in the corpus, since a common word's neighbours
are mostly ordinary words; S counts the known instances only, as nothing is known of the others.  Patterns induced by
``least_seeds`` distinct seeds or more that score ``least_score`` or more are trusted.  An unseen instance scores as its
best trusted pattern, and is known from the next round on.  Unseen mentions in a trusted pattern are spans of kind
``context``, seeds of the fifth kind spans of kind ``secret``.  Base spans always stay.

Rows are keyed by an id that is written with them, so repeated rows and null ids do no harm.

Defined results: null and empty texts have no spans; repeated rows have equal spans; empty tables give no rows; a word
of more than CONTEXT_CHARS characters beside a mention stands by its nearest characters; a mention has no pattern of a
width for which its text has too few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import Workspace, salted_join

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SCORE = 0.8
LEAST_SEEDS = 3
CONTEXT_CHARS = 128
BLOCK = 256
SPANS = "array<struct<start:int,end:int,value:string>>"
SEEDS = (*KINDS, "secret")

#: A local part starts where a run of its characters does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
#: A whole run of digits with single blanks or hyphens between, of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13}[0-9])(?!(?:[0-9][\x20-]?){19}[0-9])[0-9](?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?i)(?<=(?:token|secret|passwd|password|api_?key)\s{0,3}[:=]\s{0,3}[\"']?)(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
#: The rest of a token of digits and phone or card punctuation, but no IP address.
_NUMBER = r"(?![0-9]++(?:\.[0-9]++){3})[().-]*+[0-9][0-9().-]*+(?=[,;:!?]*+(?!\S))"
#: A token from its start to its end that holds a digit or an @; a number goes on over single blanks.
CANDIDATE = rf"(?<!\S)(?:\+?+{_NUMBER}(?:(?<=[0-9)])\x20(?:[().-]++\x20)?{_NUMBER})*+|[^\s0-9@]*+[0-9@])\S*+"


def running_ends(steps: str) -> Column:
    """Prefix sums of an array<int> column, by blocks, so that no array of more than n/BLOCK or BLOCK parts is grown."""
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    empty = F.array().cast("array<int>")

    def grown(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(start.alias("at"), empty.alias("all")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")))

    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all")),
        lambda a, block: _joined(a, grown(block, a["at"])),
    )
    return F.when(n > 0, F.flatten(whole["all"])).otherwise(empty)


def _joined(a: Column, part: Column) -> Column:
    # part is used twice; a one-element transform binds it
    both = F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(a["all"], F.array(p["all"])).alias("all")))
    return F.element_at(both, 1)


def matched(df: DataFrame, text: str, pattern: str, out: str, gate: Column) -> DataFrame:
    """Adds the matches of a pattern: start and end in code points, end exclusive, value, and the text to the left and
    to the right, back to the start of the second match before and on to the end of the next, or CONTEXT_CHARS at most.

    Regex functions give no places; the texts between the matches do, as both lengths sum to the place.  Arrays are
    zipped, not looked up, where a column is used once: the optimizer would put its expression inside the lambda."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__v", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__g", F.when(F.size("__v") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("__s", F.zip_with("__v", F.slice("__g", 1, F.size("__v")), lambda v, g: F.length(v) + F.length(g)))
    df = df.withColumn("__e", running_ends("__s"))

    def tail(x: Column) -> Column:
        return F.coalesce(F.substring(x, F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS)), F.lit(""))

    def head(x: Column) -> Column:
        return F.coalesce(F.substring(x, F.lit(1), F.lit(CONTEXT_CHARS)), F.lit(""))

    def left(v: Column, i: Column) -> Column:
        return tail(F.concat(tail(F.get("__g", i - 2)), tail(F.get("__v", i - 2)), tail(F.get("__g", i - 1)), tail(F.get("__v", i - 1)), tail(F.get("__g", i))))

    def right(v: Column, i: Column) -> Column:
        return head(F.concat(head(F.get("__g", i + 1)), head(F.get("__v", i + 1))))

    df = df.withColumn("__l", F.transform("__v", left)).withColumn("__r", F.transform("__v", right))
    df = df.withColumn(out, F.zip_with("__v", "__e", lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))).cast(SPANS))
    df = df.withColumn(out, F.zip_with(out, "__l", lambda m, x: m.withField("left", x)))
    df = df.withColumn(out, F.zip_with(out, "__r", lambda m, x: m.withField("right", x)))
    return df.drop("__v", "__g", "__s", "__e", "__l", "__r")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits(value))

    def weighed(i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits(value))), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one array of spans for each kind of seed; secrets overlap no other kind."""
    t = F.col(text)
    df = matched(docs, text, EMAIL, "email", t.contains("@"))
    df = matched(df, text, IP, "ip", t.rlike(r"[0-9]\.[0-9]"))
    df = df.withColumn("ip", F.filter("ip", lambda m: F.forall(F.split(m["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))))
    df = matched(df, text, CARD, "card", t.rlike("[0-9]"))
    df = df.withColumn("card", F.filter("card", lambda m: luhn(m["value"])))
    df = matched(df, text, PHONE, "phone", t.contains("+"))
    df = df.withColumn("phone", F.filter("phone", lambda m: F.length(digits(m["value"])).between(10, 15)))
    df = matched(df, text, SECRET, "secret", t.rlike(r"[:=]"))
    taken = F.concat(*(F.transform(k, lambda m: m["end"]) for k in KINDS))
    starts = F.concat(*(F.transform(k, lambda m: m["start"]) for k in KINDS))
    spans = F.arrays_zip(starts.alias("a"), taken.alias("b"))
    return df.withColumn("secret", F.filter("secret", lambda m: ~F.exists(spans, lambda s: (s["a"] < m["end"]) & (m["start"] < s["b"]))))


def of_kind(kind: str, order: int) -> Column:
    """The spans of a column named for its kind as (start, i, end, kind)."""
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("i"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def patterns(left: Column, right: Column, instance: Column) -> Column:
    """The patterns of a mention; empty ones stand for a width that it lacks.  The word on the right is its letters."""
    before = F.regexp_replace(F.lower(left), r"\s+", " ")
    l2 = F.regexp_extract(before, r"(?:^| )(\S++ \S++ \S*+)$", 1)
    l1 = F.regexp_extract(before, r"(?:^| )(\S++ \S*+)$", 1)
    r1 = F.regexp_extract(F.lower(right), r"^[^\p{L}0-9]*+(\p{L}++)", 1)
    shape = F.when(instance.rlike("^[0-9a-f]{32,}$"), F.concat(F.lit("hex"), F.length(instance).cast("string"))).otherwise(
        F.regexp_replace(F.regexp_replace(instance, r"\p{L}++", "a"), "[0-9]", "9")
    )

    def named(kind: str, value: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"{kind} "), value)).otherwise("")

    return F.array(
        named("L2", l2, l2 != ""),
        named("LR", F.concat_ws("|", l1, r1), (l1 != "") & (r1 != "")),
        named("L1", l1, l1 != ""),
        named("R1", r1, r1 != ""),
        named("S", shape, shape.rlike("9|^hex")),
    )


def trimmed(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[\p{P}\p{S}]+$", "")


def mentions(df: DataFrame, text: str) -> DataFrame:
    """Adds seeds and candidates: arrays of (kind, start, end, left, right, instance); a candidate overlaps no seed."""
    df = matched(df, text, CANDIDATE, "__c", F.col(text).rlike("[0-9@]"))

    def mention(m: Column, kind: str | None) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["left"].alias("left"), m["right"].alias("right"), trimmed(m["value"]).alias("instance"))

    df = df.withColumn("seeds", F.concat(*(F.transform(k, lambda m, k=k: mention(m, k)) for k in SEEDS)))
    free = F.filter("__c", lambda m: ~F.exists("seeds", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return df.withColumn("candidates", F.transform(free, lambda m: mention(m, None))).drop("__c")


def occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often the words of the one-word patterns ``wanted`` (pattern) occur: rows (pattern, total)."""
    word = F.explode(F.split(F.lower("__text"), r"\s+"))
    right = F.regexp_extract("w", r"^[^\p{L}0-9]*+(\p{L}++)", 1)
    words = texts.select(word.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    both = words.select(F.explode(F.array(F.concat(F.lit("L1 "), "w"), F.when(right != "", F.concat(F.lit("R1 "), right)))).alias("word"), "n").where("word is not null")
    # a left word is followed by a blank and what adjoins the mention
    key = wanted.where("pattern like 'L1 %' or pattern like 'R1 %'").select("pattern", F.regexp_extract("pattern", r"^(\S+ \S+)", 1).alias("word"))
    return both.groupBy("word").agg(F.sum("n").alias("total")).join(key, "word").select("pattern", "total")


def trusted(edges: DataFrame, texts: DataFrame, space: Workspace, rounds: int, least_score: float, least_seeds: int) -> DataFrame:
    """The trusted patterns, from edges (pattern, instance, kind or null, n)."""
    induced = edges.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("kind").alias("seeds"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("known_n"))
    induced = space.save(induced.where(F.col("seeds") >= least_seeds), "induced")
    totals = space.save(occurrences(texts, induced), "totals")
    induced = space.save(induced.join(totals, "pattern", "left"), "patterns")
    small = F.col("total").isNull() & F.col("pattern").rlike("^[LR]1 ")
    wide = F.when(F.col("pattern").startswith("S "), F.lit(0)).when(small, F.col("n")).otherwise(F.coalesce("total", "n"))
    live = salted_join(edges, induced.select("pattern", wide.alias("seen")), "pattern", F.col("instance"))
    live = space.save(live.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)), "live")
    for r in range(rounds):
        known = live.groupBy("pattern", "seen").agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.sum(F.when(F.col("score") > 0, F.col("n")).otherwise(0)).alias("known"))
        scored = known.withColumn("p", F.col("weight") / (F.greatest("seen", "known") + 1)).where(F.col("p") >= least_score)
        good = space.save(scored.select("pattern", "p"), f"trusted-{r}")
        if r == rounds - 1:
            return good.select("pattern")
        unseen = salted_join(live.where("kind is null").select("pattern", "instance"), good, "pattern", F.col("instance"))
        fresh = space.save(unseen.groupBy("instance").agg(F.max("p").alias("p")), f"found-{r}")
        score = F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
        live = space.save(live.drop("score").join(fresh, "instance", "left").withColumn("score", score).drop("p"), f"live-{r}")


def personal_data(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """The documents' columns (those of ``carry``) with email, ip, card, phone (base spans), and secret
    and context (spans of the method)."""
    carry = [c for c in docs.columns if c not in (*SEEDS, "context")] if carry is None else carry
    found = found_spans(docs, text_col, carry, rounds, least_score, least_seeds)
    return found.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)), *SEEDS, "context")


def found_spans(docs: DataFrame, text_col: str, carry: list[str], rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """As personal_data, with the columns of ``carry`` named c_0, c_1, ..."""
    space = Workspace(docs.sparkSession, "pii")
    columns = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)]
    own = docs.select(*columns, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")).withColumn("rid", F.monotonically_increasing_id())
    marked = mentions(base_spans(own, "__text"), "__text").drop("__text")
    marked = space.save(marked, "marked")
    rows = marked.select("rid", F.explode(F.concat("seeds", "candidates")).alias("m")).select("rid", "m.*")
    rows = rows.select("rid", "start", "end", "kind", "instance", F.explode(F.array_distinct(patterns(F.col("left"), F.col("right"), F.col("instance")))).alias("pattern")).where("pattern != ''")
    edges = rows.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    good = trusted(space.save(edges, "edges"), own.select("__text"), space, rounds, least_score, least_seeds)
    unseen = rows.where("kind is null").select("rid", "start", "end", "pattern")
    found = salted_join(unseen, good, "pattern", F.struct("rid", "start")).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context"))
    found = space.save(found, "found")
    space.keep("marked", "found")
    none = F.array().cast("array<struct<start:int,end:int>>")
    # only rows with candidates can have found spans
    some = marked.where("size(candidates) > 0").join(found, "rid", "left")
    most = marked.where("size(candidates) = 0").withColumn("context", none)
    both = some.withColumn("context", F.coalesce("context", none)).select(*most.columns).union(most)
    return both.select(*(f"c_{k}" for k in range(len(carry))), *SEEDS, "context")


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    every = F.concat(*(of_kind(k, i) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with the union of the spans replaced, run by run, by [kind] of the first span of each run."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, m: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, m["start"] - a["at"])
        return F.when(m["start"] >= a["at"], F.struct(m["end"].alias("at"), F.concat(a["parts"], F.array(gap, F.concat(F.lit("["), m["kind"], F.lit("]")))).alias("parts"))).otherwise(
            F.struct(F.greatest(a["at"], m["end"]).alias("at"), a["parts"].alias("parts"))
        )

    return F.aggregate(spans, state, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span of their text replaced by [kind]; texts without a span are left as they are."""
    found = found_spans(docs, text_col, docs.columns)
    kinds = (*SEEDS, "context")
    out = found.withColumn("spans", F.array_sort(F.concat(*(of_kind(k, i) for i, k in enumerate(kinds)))))
    text = F.col(f"c_{docs.columns.index(text_col)}")
    new = F.when(F.size("spans") > 0, masked(text, F.col("spans"))).otherwise(text)
    return out.select(*(new.alias(c) if c == text_col else F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs, carry=["doc_id"])
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(span_list(KINDS), 256).alias("base_sha256"),
        span_list((*SEEDS, "context")).alias("spans"),
    )
