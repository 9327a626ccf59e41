"""Symbol references, variable values and identifiers of script lines, and the registries of lookup arrays.

Everything works on the logical lines of ``script.logical_lines``; places are exact.  Calls and their arguments come from
the token table (``tokens``), so they may be nested to any depth."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.places import bound, found, replaced
from quillspark.operators.references import propagate_keys
from quillspark.plans.shared import saved
from quillspark.sources.script import logical_lines, without_comment
from quillspark.sources.segments import segments, with_state
from quillspark.sources.syntax import KEY, NAME, NAMESPACES, QUOTED, symbol_reference
from quillspark.sources.tokens import call_table, choice, outer, token_table  # noqa: F401

VALUES, ROUNDS = 32, 8
ASSIGNS = rf"(?i)^\s*(?:(?:VARI|VARS)\s+)?({NAME})\s*(?:'=|=)\s*(.+?)\s*$"
LITERAL = re.compile(r'@?"((?:[^"\\]|\\.)*)"')
# Names that are no identifiers of a project.
RESERVED = "LOCAL LOCALS ARG ARGS RESULT RESULTS".split()
INFLECTIONS = ["から", "まで", "より", "なら", "です", "ます", "した", "して", "する"]
LOOKUP_FUNCTIONS = ["FINDELEMENT", "FINDLASTELEMENT"]
#: Functions that take a list of keys: the argument that names the namespace (or the namespace), and that of the list.
KEY_LISTS = [
    ("CALC_CHARA_SINGLE_DATA", 0, None, 2),
    ("CALC_CHARA_SINGLE_DATA_RULED", 0, None, 2),
    ("CALC_CHARA_MULTIPLE_DATA", 0, None, 2),
    ("CALC_CHARA_RANGED_DATA", 0, None, 2),
    ("GET_NONEXISTABLE_CHARA_NO_DEFAULTABLE_SINGLE_DATA", 0, None, 2),
    ("GET_NONEXISTABLE_VALUES_BYNAME", 0, None, 1),
    ("GET_NONEXISTABLE_CHARA_VALUES_NO_DEFAULTABLE", 0, None, 2),
    ("CALC_CHARA_MULTIPLE_DATA_BASE", 1, None, 3),
    ("GET_NONEXISTABLE_TALENT_BYNAME", None, "TALENT", 0),
    ("GET_NONEXISTABLE_ABL_BYNAME", None, "ABL", 0),
    ("GET_NONEXISTABLE_CFLAG_BYNAME", None, "CFLAG", 0),
    ("GET_NONEXISTABLE_EXP_BYNAME", None, "EXP", 0),
    ("GET_NONEXISTABLE_CSTR_BYNAME", None, "CSTR", 0),
]


def code_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.ltrim("code").startswith(";"))


def calls(lines: DataFrame, *more: str) -> DataFrame:
    """(document_id, line_number, start, at, function, arguments): every call outside plain strings, those in arguments
    and in the script inside raw strings as well; arguments are (start, value) without the blanks around.  ``more`` columns
    of the lines come along."""
    own = call_table(lines, *more)
    return own.select("document_id", "line_number", "start", "at", F.upper("name").alias("function"), "arguments", *more)


def naming(lines: DataFrame, functions: list[str]) -> DataFrame:
    """The lines that hold one of the names in any case: others need not be read for calls of them."""
    return lines.where(F.upper("code").rlike("|".join(functions)))


def literal(argument: Column) -> Column:
    return F.regexp_extract(argument, r'^@?"((?:[^"]|"")*)"$', 1)


def split_lookups(lines: DataFrame) -> DataFrame:
    """(name, delimiter, field, namespace) of arrays whose values are split into fields of which some are keys.

    SPLIT_STRING(source:..., delimiter, target) names a target; GETNUM(namespace, target:field) makes the field a key of
    the namespace, TOINT(target:field) makes it code (namespace null)."""
    own = saved(calls(naming(lines, ["SPLIT_STRING", "GETNUM", "TOINT"])).where(F.col("function").isin("SPLIT_STRING", "GETNUM", "TOINT")), "split-calls")
    argument = lambda k: F.get(F.col("arguments"), F.lit(k))["value"]
    array = lambda c: F.upper(F.regexp_extract(c, rf"^({NAME})", 1))
    split = own.where("function = 'SPLIT_STRING'").select("document_id", array(argument(0)).alias("name"), literal(argument(1)).alias("delimiter"), array(argument(2)).alias("target"))
    field = rf"^({NAME})\s*:\s*(\d+)$"
    keys = own.where("function = 'GETNUM'").select("document_id", F.upper(F.regexp_extract(argument(1), field, 1)).alias("target"), F.regexp_extract(argument(1), field, 2).try_cast("int").alias("field"), F.upper(argument(0)).alias("namespace"))
    code = own.where("function = 'TOINT'").select("document_id", F.upper(F.regexp_extract(argument(0), field, 1)).alias("target"), F.regexp_extract(argument(0), field, 2).try_cast("int").alias("field"), F.lit(None).cast("string").alias("namespace"))
    out = split.join(keys.union(code).where("field is not null"), ["document_id", "target"])
    out = out.groupBy("name", "field").agg(F.max("delimiter").alias("delimiter"), F.max("namespace").alias("namespace"))
    return out.join(out.where("namespace is not null").select("name").distinct(), "name", "left_semi").select("name", "delimiter", "field", "namespace")


def functions_of(lines: DataFrame) -> DataFrame:
    """The lines with the function they are in (upper-cased) and its parameters."""
    from pyspark.sql import Window

    define = rf"^\s*@\s*({NAME})\s*[(,]?([^)]*)"
    is_head = F.col("code").rlike(r"^\s*@")
    head = F.when(is_head, F.struct(F.upper(F.regexp_extract("code", define, 1)).alias("caller"), F.transform(F.split(F.regexp_extract("code", define, 2), ","), lambda p: F.upper(F.regexp_extract(p, rf"^\s*({NAME})", 1))).alias("parameters")))
    own = Window.partitionBy("document_id").orderBy("start")
    return lines.withColumn("h", F.last(head, True).over(own)).select("*", "h.caller", "h.parameters").drop("h")


def lookup_arrays(lines: DataFrame) -> DataFrame:
    """(name) of declared arrays that are searched, compared with strings, or chosen by in SELECTCASE."""
    code = F.col("code")
    declared = lines.select(F.upper(F.regexp_extract(code, rf"(?i)^\s*#DIMS?\s+(?:(?:CONST|SAVEDATA|DYNAMIC|GLOBAL|REF|CHARADATA)\s+|,\s*)*({NAME})", 1)).alias("name")).where("name != ''").distinct()
    own = code_lines(lines)
    chosen = own.select(F.regexp_extract(code, rf"(?i)^\s*SELECTCASE\s+({NAME})\s*:", 1).alias("name"))
    compared = own.select(F.explode(F.regexp_extract_all(code, F.lit(rf"""({NAME})\s*:[^"'\r\n=<>!]+\s*(?:==|!=|<>)\s*@?\""""), F.lit(1))).alias("name"))
    searched = calls(naming(lines, LOOKUP_FUNCTIONS)).where(F.col("function").isin(LOOKUP_FUNCTIONS) & (F.size("arguments") >= 2)).select(F.regexp_extract(F.get("arguments", F.lit(0))["value"], rf"^({NAME})$", 1).alias("name"))
    used = chosen.union(compared).union(searched).select(F.upper("name").alias("name")).where("name != ''").distinct()
    return declared.join(used.hint("merge"), "name")


def key_arguments(lines: DataFrame) -> DataFrame:
    """(function, argument, namespace): parameters that are searched for in an array, and those passed on to such ones."""
    own = calls(functions_of(lines).where("caller is not null"), "caller", "parameters")
    own = own.select("caller", "parameters", "function", F.posexplode("arguments").alias("argument", "a"), F.get("arguments", F.lit(0))["value"].alias("first"))
    own = own.withColumn("parameter", F.array_position("parameters", F.upper("a.value")).cast("int") - 1).where("parameter >= 0")
    # read once for what is known and what is passed on
    own = saved(own.select("caller", "parameter", "function", "argument", "first"), "key-uses")
    known = own.where(F.col("function").isin(LOOKUP_FUNCTIONS) & (F.col("argument") == 1)).select(F.col("caller").alias("function"), F.col("parameter").alias("argument"), F.concat(F.lit("DIMS:"), F.upper("first")).alias("namespace"))
    passed = own.select("caller", "parameter", F.col("function").alias("callee"), "argument").distinct()
    return propagate_keys(known.distinct(), passed)


def expression_values(expression: str, at: int, known: dict[str, dict[str, None]]) -> tuple[dict[str, None], list[tuple[str, int]]]:
    """The strings that an expression can hold, in the order they are met, and its literals with their places.

    A literal is itself, a choice both its sides, a sum the sums of its terms (VALUES at most, first ones first, and no
    literal is the whole value then), a variable what is known of it."""
    own = expression.strip()
    at += len(expression) - len(expression.lstrip())
    quoted = LITERAL.fullmatch(own)
    if quoted:
        return {quoted[1]: None}, [(quoted[1], at + quoted.start(1))]
    sides = choice(own)
    if sides:
        left = expression_values(own[sides[0] + 1 : sides[1]], at + sides[0] + 1, known)
        right = expression_values(own[sides[1] + 1 :], at + sides[1] + 1, known)
        return left[0] | right[0], left[1] + right[1]
    edges = [k for k, _ in outer(own, "+")]
    terms = [(lo + 1, own[lo + 1 : hi]) for lo, hi in zip([-1, *edges], [*edges, len(own)], strict=True) if own[lo + 1 : hi].strip()]
    if len(terms) > 1:
        out = {"": None}
        for _, term in terms:
            more = expression_values(term, 0, known)[0]
            out = dict.fromkeys(islice(dict.fromkeys(a + b for a in out for b in more), VALUES))
        return out, []
    return known.get(own.lower(), {}), []


def values_of(assignments: list[tuple[str, str]]) -> dict[str, dict[str, None]]:
    """The strings that variables (lower-cased) can hold, in the order they are met, by a fix-point of ROUNDS rounds."""
    known: dict[str, dict[str, None]] = {}
    for _ in range(ROUNDS):
        before = sum(map(len, known.values()))
        for variable, expression in assignments:
            if got := expression_values(expression, 0, known)[0]:
                known[variable.lower()] = known.get(variable.lower(), {}) | got
        if before == sum(map(len, known.values())):
            break
    return known


def assignments(lines: DataFrame) -> DataFrame:
    """(document_id, line_number, start, at, variable, expression) of the lines that assign; ``at`` is the expression's place."""
    own = code_lines(lines).where(~F.ltrim("code").startswith("#") & F.col("code").rlike(ASSIGNS))
    lead = F.length("code") - F.length(F.regexp_extract("code", ASSIGNS, 2)) - F.length(F.regexp_extract("code", r"\s*$", 0))
    return own.select("document_id", "line_number", "start", lead.alias("at"), F.regexp_extract("code", ASSIGNS, 1).alias("variable"), F.regexp_extract("code", ASSIGNS, 2).alias("expression"))


def variable_values(lines: DataFrame) -> DataFrame:
    """(document_id, variable, keys): the strings that the variables of a document can hold, lower-cased names."""
    grouped = assignments(lines).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "variable", "expression"))).alias("a"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, v, sorted(k)) for d, a in zip(part["document_id"], part["a"], strict=True) for v, k in values_of([(x["variable"], x["expression"]) for x in a]).items()]
            yield pd.DataFrame(rows, columns=["document_id", "variable", "keys"])

    return grouped.mapInPandas(run, "document_id string, variable string, keys array<string>")


def variable_literals(lines: DataFrame) -> DataFrame:
    """(document_id, line_number, start, length, variable, key): where a document's variables (lower-cased) get a string
    as it is, alone or as a side of a choice; a rename of an indirect reference is written there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, n, s, at, v, e in part.itertuples(index=False):
                rows += [(d, n, s + place, len(value), v.lower(), value) for value, place in expression_values(e, at, {})[1]]
            yield pd.DataFrame(rows, columns=["document_id", "line_number", "start", "length", "variable", "key"])

    own = assignments(lines).where(F.col("expression").contains('"')).select("document_id", "line_number", "start", "at", "variable", "expression")
    return own.mapInPandas(run, "document_id string, line_number int, start int, length int, variable string, key string")


def references(lines: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """(document_id, line_number, start, length, namespace, kind, key, variable, candidates, resolution) of lines.

    namespace:key and namespace:variable:key name a key; a component that is a variable stands for its values, of which
    there are none (unresolved), one (resolved) or several (ambiguous).  GETNUM(namespace, "key") names a key as well,
    and GETNUM(namespace, variable) what the variable holds."""
    own = NAMESPACES if namespaces is None else namespaces
    pattern = symbol_reference(own)
    code = F.col("code")

    def direct(m: Column) -> Column:
        space = F.upper(F.substring_index(m["value"], ":", 1))
        key = F.substring_index(m["value"], ":", -1)
        return F.struct((m["start"] + m["length"] - F.length(key)).alias("at"), space.alias("namespace"), key.alias("key"))

    rows = code_lines(lines).where(~F.ltrim(code).startswith("#"))
    plain = rows.select("document_id", "line_number", "start", F.explode(F.transform(found(code, pattern), direct)).alias("r")).select("document_id", "line_number", (F.col("start") + F.col("r.at")).alias("start"), "r.namespace", "r.key")
    argument = lambda k: F.get(F.col("arguments"), F.lit(k))
    # the namespace may carry a number of characters, as in ITEM@2
    space = F.upper(F.regexp_extract(argument(0)["value"], r"^(.+?)(?:@[0-9]+)?$", 1))
    asked = calls(naming(rows, ["GETNUM"])).where((F.col("function") == "GETNUM") & space.isin(own))
    key = argument(1)["value"]
    named = asked.where(literal(key) != "").select("document_id", "line_number", (F.col("start") + argument(1)["start"] + F.instr(key, '"')).alias("start"), space.alias("namespace"), literal(key).alias("key"), F.lit(True).alias("is_literal"))
    held = asked.where(key.rlike(f"^{NAME}$")).select("document_id", "line_number", (F.col("start") + argument(1)["start"]).alias("start"), space.alias("namespace"), key.alias("key"), F.lit(None).cast("boolean").alias("is_literal"))
    getnum = named.unionByName(held)
    every = plain.withColumn("is_literal", F.lit(False)).unionByName(getnum).where(~T.is_numeric_like(F.col("key")))
    values = variable_values(lines).withColumnRenamed("variable", "v")
    # a name of ASCII letters is a variable: keys of a project hold other characters, or are assigned nowhere
    variable = F.coalesce(~F.col("is_literal"), F.lit(True)) & F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$") | F.col("is_literal").isNull()
    out = every.withColumn("v", F.when(variable, F.lower("key"))).join(values, ["document_id", "v"], "left")
    candidates = F.when(F.col("v").isNull(), F.array("key")).otherwise(F.coalesce("keys", F.array().cast("array<string>")))
    resolution = F.when(F.col("v").isNull(), "direct").when(F.size(candidates) == 0, "unresolved").when(F.size(candidates) == 1, "resolved").otherwise("ambiguous")
    return out.select(
        "document_id", "line_number", "start", F.length("key").alias("length"), "namespace",
        F.when(F.col("v").isNull(), "direct").otherwise("indirect").alias("kind"),
        F.when(F.col("v").isNull(), F.col("key")).alias("key"), F.when(F.col("v").isNotNull(), F.col("key")).alias("variable"),
        candidates.alias("candidates"), resolution.alias("resolution"),
    ).distinct()


def lookup_references(lines: DataFrame, lookups: DataFrame | None = None, keys: DataFrame | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """(document_id, line_number, start, length, namespace, key) of quoted strings that name a key by where they stand:
    compared with an element of a lookup array (``lookups``: name), labels of a SELECTCASE over one or over the names of a
    namespace, searched for in one, given to a key argument (``keys``: function, argument, namespace), or given after the
    name of a namespace.  Registries are those of the lines where none are given."""
    # scripts are read once, whatever is asked of them
    lines = saved(lines.select("document_id", "line_number", "start", "code"), "lookup-lines")
    lookups = lookup_arrays(lines) if lookups is None else lookups
    keys = key_arguments(lines) if keys is None else keys
    spaces = NAMESPACES if namespaces is None else namespaces
    code = F.col("code")
    rows = lines.where(~F.ltrim(code).startswith(";") & ~F.ltrim(code).startswith("#"))
    known = saved(lookups.select(F.col("name").alias("array")).distinct(), "lookup-arrays").hint("merge")

    def content(m: Column) -> Column:
        """(at, key) of the last quoted string of a match."""
        own = F.regexp_extract(m["value"], r'@?"((?:[^"]|"")*)"[^"]*$', 1)
        at = m["start"] + m["length"] - F.length(F.regexp_extract(m["value"], r'(?:[^"]|"")*"[^"]*$', 0))
        return F.struct(at.alias("at"), own.alias("key"))

    def listed(df: DataFrame, found_: Column, space: Column) -> DataFrame:
        each = df.select("document_id", "line_number", "start", space.alias("space"), F.explode(found_).alias("m"))
        return each.select("document_id", "line_number", (F.col("start") + F.col("m.at")).alias("start"), "space", F.col("m.key").alias("key"))

    compare = rf"""({NAME})\s*:[^"'\r\n=<>!]+\s*(?:==|!=|<>)\s*{QUOTED}"""
    compared = rows.select("document_id", "line_number", "start", F.explode(found(code, compare)).alias("m"))
    compared = compared.select("document_id", "line_number", "start", F.upper(F.regexp_extract("m.value", rf"^({NAME})", 1)).alias("array"), F.array(content(F.col("m"))).alias("f")).join(known, "array")
    # only what opens, closes and labels a SELECTCASE counts for the array that it chooses by
    cases = with_state(lines.where(code.rlike(r"(?i)^\s*(?:SELECTCASE|ENDSELECT|CASE)\b"))).where(code.rlike(r"(?i)^\s*CASE\b"))
    labels = saved(cases.select("document_id", "line_number", "start", F.col("selected").alias("array"), F.transform(found(code, QUOTED), content).alias("f")), "lookup-labels")
    of_arrays = labels.join(known, "array")
    named = labels.withColumn("space", F.regexp_extract("array", "^(.+)NAME$", 1)).where(F.col("space").isin(spaces))
    own = calls(rows.where(code.contains('"')))
    literals = own.select("document_id", "line_number", "start", "function", F.get("arguments", F.lit(0))["value"].alias("first"), F.posexplode("arguments").alias("argument", "a"), "arguments")
    text = literal(F.col("a.value"))
    literals = literals.where(text != "").withColumn("f", F.array(F.struct((F.col("a.start") + F.instr("a.value", '"')).alias("at"), text.alias("key"))))
    literals = saved(literals, "lookup-literals")
    searched = literals.where(F.col("function").isin(LOOKUP_FUNCTIONS) & (F.col("argument") == 1)).withColumn("array", F.upper("first")).join(known, "array")
    given = literals.join(keys.hint("merge"), ["function", "argument"])
    before = F.upper(literal(F.get("arguments", F.col("argument") - 1)["value"]))
    after = literals.where(before.isin(spaces)).withColumn("space", before)
    dims = F.concat(F.lit("DIMS:"), F.col("array"))
    out = listed(compared, F.col("f"), dims).union(listed(of_arrays, F.col("f"), dims)).union(listed(named, F.col("f"), F.col("space")))
    out = out.union(listed(searched, F.col("f"), dims)).union(listed(given, F.col("f"), F.col("namespace"))).union(listed(after, F.col("f"), F.col("space")))
    out = out.where((F.trim("key") != "") & ~T.is_numeric_like(F.col("key")))
    return out.select("document_id", "line_number", "start", F.length("key").alias("length"), F.col("space").alias("namespace"), "key").distinct()


def key_list_references(lines: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """(document_id, line_number, start, length, namespace, key) of the keys in the lists that KEY_LISTS functions take:
    entries between commas (between bars for functions named ..._RULED), each a key with a weight after an asterisk."""
    spaces = NAMESPACES if namespaces is None else namespaces
    table = F.broadcast(lines.sparkSession.createDataFrame(KEY_LISTS, "function string, space_argument int, space string, list_argument int"))
    own = calls(naming(lines, [f for f, *_ in KEY_LISTS])).join(table, "function")
    value = lambda k: F.get("arguments", F.col(k))
    own = own.withColumn("namespace", F.upper(F.coalesce("space", literal(value("space_argument")["value"])))).where(F.col("namespace").isin(spaces))
    taken = value("list_argument")
    own = own.withColumn("list", literal(taken["value"])).withColumn("first", taken["start"] + F.instr(taken["value"], '"')).where("list != ''")
    mark = F.when(F.col("function").endswith("_RULED"), r"\|").otherwise(",")
    own = own.withColumn("entries", F.split("list", mark, -1)).select("*", F.posexplode("entries").alias("n", "entry"))
    before = F.aggregate(F.slice("entries", F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    lead = F.length(F.regexp_extract("entry", r"^\s*", 0))
    key = F.regexp_extract("entry", r"^\s*([^*,|]*?)\s*(?:[*,|].*)?$", 1)
    out = own.select("document_id", "line_number", (F.col("start") + F.col("first") + before + lead).alias("start"), F.length(key).alias("length"), "namespace", key.alias("key"))
    return out.where(is_symbol_key(F.col("key"))).distinct()


def split_key_references(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(document_id, line_number, start, length, namespace, key) of the fields of declared split arrays that are keys;
    ``splits`` is the registry of ``split_lookups``."""
    # no other lines have such fields
    declared = lines.where(F.col("code").rlike(r"(?i)^\s*#DIMS?\s"))
    own = segments(declared, splits=splits).where("segment_type = 'split-lookup-key'")
    return own.select("document_id", "line_number", "start", "length", "namespace", F.col("text").alias("key")).where(is_symbol_key(F.col("key")))


def is_symbol_key(key: Column) -> Column:
    """Not blank, no number, not in parentheses."""
    return ~T.is_blank(key) & ~T.is_numeric_like(key) & ~key.startswith("(")


def refreshed_references(docs: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """The references of documents (document_id, text) as they are now; a plan of renames starts from these."""
    return references(logical_lines(docs), namespaces)


def in_string_lookup(text: Column, start: Column) -> Column:
    """Whether a place is in the key argument of GETNUM: GETNUM and a comma in the 64 characters before, on its line."""
    head = F.substring(text, F.greatest(start - 64, F.lit(0)) + 1, F.least(start, F.lit(64)))
    after = F.regexp_extract(head, r"(?is)^.*GETNUM(.*)$", 1)
    return head.rlike("(?i)GETNUM") & after.contains(",") & ~after.contains("\n")


def rewritten_references(text: Column, renames: Column, namespaces: list[str] | None = None) -> Column:
    """The text with the keys of symbol references renamed by a map of NAMESPACE:key to the new key."""

    def one(m: Column) -> Column:
        space, key = F.upper(F.substring_index(m, ":", 1)), F.substring_index(m, ":", -1)
        new = F.try_element_at(renames, F.concat_ws(":", space, key))
        return F.when(new.isNull(), m).otherwise(F.concat(F.left(m, F.length(m) - F.length(key)), new))

    return replaced(text, symbol_reference(namespaces), one)


def identifiers(lines: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """(document_id, line_number, start, length, kind, role, name) of functions and variables named in a project's own
    script: definitions and their parameters, declarations, assignments, call targets, calls and uses.

    Names in quotes, keys of a namespace, properties, reserved words and particles do not count, nor do the words of
    print lines outside %...% and {...}."""
    spaces = NAMESPACES if namespaces is None else namespaces
    rows = code_lines(lines).withColumn("own", without_comment(F.col("code"))).where(F.col("own").rlike(f"[{T.TRANSLATABLE}]"))
    own = F.col("own")
    target = rf"(?i)^(\s*(?:TRY)?(?:CALL|JUMP|GOTO)(?:FORM)?\s+)({NAME})"
    assigned = rf"^(\s*(?:(?:VARI|VARS)\s+)?)({NAME})\s*(?::[^=]*)?(?:'=|[-+*/|&]?=(?!=))"
    # each step is a column of its own, so that it is worked out once a line, however often the next one names it
    rows = rows.select(
        "document_id", "line_number", "start", "own", own.rlike(r"^\s*@").alias("head"), own.rlike(r"(?i)^\s*#DIMS?\b").alias("declares"), own.rlike(r"^\s*#").alias("directive"),
        own.rlike(r"(?i)^\s*(?:PRINT|DATA|DRAWLINEFORM|CUSTOMDRAWLINE|REUSELASTLINE|THROW)").alias("prints"), F.regexp_extract(own, target, 1).alias("goal"),
    )
    head, declares, prints, goal = (F.col(c) for c in ("head", "declares", "prints", "goal"))
    # what counts is kept, everything else blanked, so that places stay
    rows = rows.withColumn("shown", F.when(prints, replaced(own, r"%[^%\r\n]+%|\{[^{}\r\n]+\}", lambda m: F.translate(m, "%{}", "\u0001\u0001\u0001"))).otherwise(own))
    rows = rows.withColumn("masked", replaced(F.col("shown"), QUOTED, lambda m: F.repeat(F.lit(" "), F.length(m))))
    rows = rows.withColumn("kept", F.when(prints, blanked(F.col("masked"))).otherwise(F.col("masked")))
    kept = F.col("kept")

    def spot(pattern: str, kind: str, role: str) -> Column:
        def one(name: Column) -> Column:
            return F.when(name != "", F.struct(F.length(F.regexp_extract(own, pattern, 1)).alias("at"), name.alias("name"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(0).alias("rank")))

        return bound(F.regexp_extract(own, pattern, 2), one)

    def listed(column: Column, pattern: str, kind: str, role: str, rank: int) -> Column:
        return F.transform(found(column, pattern), lambda m: F.struct(m["start"].alias("at"), m["value"].alias("name"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(rank).alias("rank")))

    single = F.array_compact(F.array(
        F.when(head, spot(rf"^(\s*@\s*)({NAME})", "function", "definition")),
        F.when(declares, spot(rf"(?i)^(\s*#DIMS?\s+(?:(?:CONST|SAVEDATA|DYNAMIC|GLOBAL|REF|CHARADATA)\s+|,\s*)*)({NAME})", "variable", "declaration")),
        F.when(~head & ~F.col("directive"), spot(assigned, "variable", "assignment")),
        F.when(goal != "", spot(target, "function", "call")),
    ))
    called = listed(kept, rf"(?<![\p{{L}}\p{{N}}_:]){NAME}(?=\s*\()", "function", "call", 1)
    used = listed(kept, rf"(?<![\p{{L}}\p{{N}}_:@.]){NAME}(?![\p{{L}}\p{{N}}_]|\s*\()", "variable", "reference", 2)
    used = F.filter(used, lambda u: (goal == "") | (u["at"] != F.length(goal)))
    parameters = listed(own, rf"(?<=[(,])\s*{NAME}", "variable", "argument", 0)
    parameters = F.transform(parameters, lambda p: p.withField("at", p["at"] + F.length(p["name"]) - F.length(F.ltrim(p["name"]))).withField("name", F.ltrim(p["name"])))
    # definitions have no calls and uses, nor have directives but declarations
    none = F.array().cast("array<struct<at: int, name: string, kind: string, role: string, rank: int>>")
    every = F.concat(single, F.when(head, parameters).otherwise(none), F.when(head | own.rlike(r"^\s*#(?!DIM)"), none).otherwise(F.concat(called, used)))
    flat = rows.select("document_id", "line_number", "start", "own", F.explode(every).alias("x"))
    # next to a point a name is a property, next to a colon a namespace or a key
    before, after = F.substring(own, F.col("x.at"), F.lit(1)), F.substring(own, F.col("x.at") + F.length("x.name") + 1, F.lit(1))
    flat = flat.where(~((F.col("x.at") > 0) & before.isin(".", ":")) & ~after.isin(".", ":"))
    flat = flat.select("document_id", "line_number", (F.col("start") + F.col("x.at")).alias("start"), "x.name", "x.kind", "x.role", "x.rank")
    name = F.col("name")
    fits = T.contains_translatable(name) & ~F.upper(name).isin([*RESERVED, *spaces]) & ~T.is_numeric_like(name) & ~name.isin(INFLECTIONS) & ~name.rlike(r"^[\x{3040}-\x{309F}]$")
    first = F.min(F.struct("rank", "role", "line_number", "name")).alias("x")
    out = flat.where(fits).groupBy("document_id", "kind", "start", F.length("name").alias("length")).agg(first)
    return out.select("document_id", "x.line_number", "start", "length", "kind", "x.role", "x.name")


def blanked(text: Column) -> Column:
    """The text with everything outside marked parts blanked, marks as well."""
    parts = F.split(text, "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.repeat(F.lit(" "), F.length(p)))), " ")
