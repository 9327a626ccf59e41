"""Scalar text functions: script classes, code and key heuristics, normalisers and review rules, as columns."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The character classes that decide results.
JAPANESE = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{4E00}-\x{9FFF}\x{3005}\x{3006}"
HANGUL = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
LATIN = "A-Za-z"
TRANSLATABLE = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}"
PLACEHOLDER = r"%[^%\r\n]+%|\{[^{}\r\n]+\}|<[^\r\n<>]+>"
NUMERIC = r"^(?:0x[0-9A-Fa-f]+|[-+]?\p{Nd}+(?:\.\p{Nd}+)?(?:/\p{Nd}+)*(?:%|％)?|TRUE|FALSE|ON|OFF)$"
DIGIT_CODAS = {"0": 1, "1": 8, "2": 0, "3": 1, "4": 0, "5": 0, "6": 1, "7": 8, "8": 8, "9": 0}
#: Full-width marks that take no blanks around them.
FULL_WIDTH_MARKS = "、。，．：；！？…‥・／＼｜【】〈〉《》「」『』（）［］｛｝＜＞％"
# What makes a translation one for review.
SLASH, ALTERNATIVES = "[/／]", r"\S+\s*(?:/|／)\s*\S+"
PARENTHESES, ADDED_PARENTHESES = "[()（）]", r"[\(（][^)）\r\n]{2,}[\)）]"
ASCII_WORD = r"(?<![A-Za-z])[A-Za-z][A-Za-z'-]{2,}(?![A-Za-z])"
LANGUAGES = {"ja": JAPANESE, "ko": HANGUL, "en": LATIN}


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\s\p{Z}]")


def trimmed(text: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def utf16_length(text: Column) -> Column:
    """UTF-16 units, where length() counts code points."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def contains_translatable(text: Column) -> Column:
    return ~is_blank(text) & text.rlike(f"[{TRANSLATABLE}]")


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def looks_like_code_only(text: Column) -> Column:
    """Nothing is left without placeholders, white space, digits, punctuation and symbols."""
    return F.regexp_replace(strip_placeholders(text), r"[\s\p{Z}\p{Nd}\p{P}\p{S}]+", "") == ""


def is_numeric_like(text: Column) -> Column:
    return trimmed(text).rlike(NUMERIC)


def looks_like_lookup_key(text: Column) -> Column:
    own = trimmed(text)
    plain = own.rlike(r"^[\p{L}\p{N}_\-]+$") & ~contains_translatable(own)
    return (own != "") & (is_numeric_like(own) | own.contains("/") | own.contains("／") | plain)


def meaningful(text: Column) -> Column:
    """The characters that count for a language: no placeholders, white space, punctuation, digits or sound marks."""
    return F.regexp_replace(strip_placeholders(text), r"[\s\p{Z}\p{P}\p{Nd}\x{30FC}\x{FF70}]+", "")


def script_count(text: Column, language: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{LANGUAGES[language]}]"))


def is_likely_language(text: Column, language: str) -> Column:
    own = F.regexp_replace(strip_placeholders(text), r"[\s\p{Z}\p{P}\p{Nd}]+", "")
    ja, ko, en = (script_count(own, x) for x in ("ja", "ko", "en"))
    rule = {"ja": (ja > 0) & (ko <= ja), "ko": (ko > 0) & (ko >= ja), "en": (en > 0) & (en >= ja) & (en >= ko)}[language]
    return F.coalesce((own != "") & rule, F.lit(False))


def is_entirely_language(text: Column, language: str) -> Column:
    return F.coalesce(meaningful(text).rlike(f"^[{LANGUAGES[language]}]+$"), F.lit(False))


def contains_language(text: Column, language: str) -> Column:
    return F.coalesce(meaningful(text).rlike(f"[{LANGUAGES[language]}]"), F.lit(False))


def has_letters_of(text: Column, language: str) -> Column:
    """Whether a character of the language is anywhere in a text, in markup as well."""
    return text.rlike(f"[{LANGUAGES[language]}]")


def is_key_shaped(text: Column) -> Column:
    """One run of letters, digits, _ and - with nothing but spaces around, or a slash anywhere."""
    return text.rlike(r"^\p{Zs}*[\p{L}\p{N}_\-]+\p{Zs}*\z") | text.contains("/")


def coda(token: Column) -> Column:
    """The final consonant of the last syllable (0 none, 8 rieul, other), of a Hangul syllable or a digit; else null."""
    last = F.right(token, F.lit(1))
    code = F.ascii(last)
    table = F.create_map(*(F.lit(x) for pair in DIGIT_CODAS.items() for x in pair))
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28).otherwise(table[last])


def particle(token: Column, with_coda: str, without: str, rieul_as_none: bool = False) -> Column:
    """The form of a particle after a token, e.g. 은/는; with ``rieul_as_none`` rieul counts as none (으로/로)."""
    own = F.coalesce(coda(token), F.lit(0))
    none = (own == 0) | (own == 8) if rieul_as_none else own == 0
    return F.when(none, F.lit(without)).otherwise(F.lit(with_coda))


def preview(text: Column) -> Column:
    """One line: the trimmed lines that are not empty, with a return mark between."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: trimmed(x)), lambda x: x != ""), " ↵ ")


def normalized_path(path: Column) -> Column:
    return F.upper(F.replace(path, F.lit("\\"), F.lit("/")))


def normalized_text(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_pattern(query: str) -> bool:
    """Whether the engine can compile the pattern."""
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(query)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def text_match(text: Column, query: str, regex: bool = False) -> Column:
    """Case-insensitive substring or pattern; a blank query matches all, a pattern that is none matches nothing."""
    if not query.strip():
        return F.lit(True)
    if regex and not is_pattern(query):
        return F.lit(False)
    own = F.coalesce(text, F.lit(""))
    return own.rlike(f"(?i){query}") if regex else F.contains(F.lower(own), F.lit(query.lower()))


def eligibility_hash(*parts: Column) -> Column:
    """Upper-case SHA-256 of the parts, each with its length before it."""
    pieces = [F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")), F.lit("|")) for p in parts]
    return F.upper(F.sha2(F.concat(*pieces), 256))


def rendered_length(source: Column, target: Column) -> Column:
    return F.length(source) + F.length(target) + 4


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))


def length_review(original: Column, translated: Column) -> Column:
    a, b = visible_length(original), visible_length(translated)
    return (a > 0) & (b > 0) & ((b < a) | (b >= a * 1.5))


def review_reason(original: Column, translated: Column) -> Column:
    """The first reason for review: added alternatives, parentheses, ASCII words, or length."""
    return (
        F.when(~original.rlike(SLASH) & translated.rlike(ALTERNATIVES), "alternatives")
        .when(~original.rlike(PARENTHESES) & translated.rlike(ADDED_PARENTHESES), "parentheses")
        .when(~original.rlike(ASCII_WORD) & translated.rlike(ASCII_WORD), "ascii_word")
        .when(length_review(original, translated), "length")
    )


def full_width_spacing(text: Column) -> Column:
    """The text without blanks around full-width marks."""
    return F.regexp_replace(text, rf"[\s\p{{Z}}]*([{FULL_WIDTH_MARKS}])[\s\p{{Z}}]*", "$1")


def csv_text(text: Column, preserve: Column) -> Column:
    """Text of a CSV field: no ASCII comma, and no blanks unless they are to be preserved."""
    own = full_width_spacing(F.replace(text, F.lit(","), F.lit("、")))
    return F.when(is_blank(text), text).when(preserve, own).otherwise(F.regexp_replace(own, r"[ \t\x{3000}]+", ""))


def masked_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|password|token|secret)\s*[=:]\s*)\S+", "$1***")
