"""Readings of names: Han characters to Hangul by a table of readings, with the initial-sound rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vowels (by number in a syllable) before which an initial r or n is silent: ya, yae, yeo, ye, yo, yu, i.
SILENT_BEFORE = (2, 3, 6, 7, 12, 17, 20)
SEPARATORS = "／/・"
# Readings of katakana pairs and single signs, and syllables that a small tsu before them makes tense.
PAIRS = {
    "キャ": "캬", "キュ": "큐", "キョ": "쿄", "シャ": "샤", "シュ": "슈", "ショ": "쇼", "チャ": "차", "チュ": "추", "チョ": "초",
    "ニャ": "냐", "ニュ": "뉴", "ニョ": "뇨", "ヒャ": "햐", "ヒュ": "휴", "ヒョ": "효", "ミャ": "먀", "ミュ": "뮤", "ミョ": "묘",
    "リャ": "랴", "リュ": "류", "リョ": "료", "ギャ": "갸", "ギュ": "규", "ギョ": "교", "ジャ": "자", "ジュ": "주", "ジョ": "조",
    "ヂャ": "자", "ヂュ": "주", "ヂョ": "조", "ビャ": "뱌", "ビュ": "뷰", "ビョ": "뵤", "ピャ": "퍄", "ピュ": "퓨", "ピョ": "표",
    "ファ": "파", "フィ": "피", "フェ": "페", "フォ": "포", "ティ": "티", "ディ": "디", "トゥ": "투", "ドゥ": "두",
    "ウィ": "위", "ウェ": "웨", "ウォ": "워", "ヴァ": "바", "ヴィ": "비", "ヴェ": "베", "ヴォ": "보", "ヴュ": "뷰",
    "ツァ": "차", "ツィ": "치", "ツェ": "체", "ツォ": "초", "シェ": "셰", "ジェ": "제", "チェ": "체",
}
SINGLES = {
    "ア": "아", "イ": "이", "ウ": "우", "エ": "에", "オ": "오", "カ": "카", "キ": "키", "ク": "쿠", "ケ": "케", "コ": "코",
    "サ": "사", "シ": "시", "ス": "스", "セ": "세", "ソ": "소", "タ": "타", "チ": "치", "ツ": "츠", "テ": "테", "ト": "토",
    "ナ": "나", "ニ": "니", "ヌ": "누", "ネ": "네", "ノ": "노", "ハ": "하", "ヒ": "히", "フ": "후", "ヘ": "헤", "ホ": "호",
    "マ": "마", "ミ": "미", "ム": "무", "メ": "메", "モ": "모", "ヤ": "야", "ユ": "유", "ヨ": "요",
    "ラ": "라", "リ": "리", "ル": "루", "レ": "레", "ロ": "로", "ワ": "와", "ヲ": "오",
    "ガ": "가", "ギ": "기", "グ": "구", "ゲ": "게", "ゴ": "고", "ザ": "자", "ジ": "지", "ズ": "즈", "ゼ": "제", "ゾ": "조",
    "ダ": "다", "ヂ": "지", "ヅ": "즈", "デ": "데", "ド": "도", "バ": "바", "ビ": "비", "ブ": "부", "ベ": "베", "ボ": "보",
    "パ": "파", "ピ": "피", "プ": "푸", "ペ": "페", "ポ": "포", "ヴ": "브", "ー": "", "・": "·",
}
TENSE = {
    "가": "까", "기": "끼", "구": "꾸", "게": "께", "고": "꼬", "다": "따", "디": "띠", "두": "뚜", "데": "떼", "도": "또",
    "바": "빠", "비": "삐", "부": "뿌", "베": "뻬", "보": "뽀", "사": "싸", "시": "씨", "스": "쓰", "세": "쎄", "소": "쏘",
    "자": "짜", "지": "찌", "주": "쭈", "제": "쩨", "조": "쪼", "차": "짜", "치": "찌", "추": "쭈", "체": "쩨", "초": "쪼",
}
_FIRST, _NIEUN, _RIEUL, _IEUNG = 0xAC00, 2, 5, 11


def initial_sound(syllable: Column) -> Column:
    """The syllable as it is spoken at the start of a word: r becomes n or silent, n before some vowels silent."""
    index = F.ascii(syllable) - _FIRST
    lead, rest = F.floor(index / 588), index % 588
    silent = F.floor(rest / 28).isin(*SILENT_BEFORE)
    new = F.when((lead == _RIEUL) & silent, _IEUNG).when(lead == _RIEUL, _NIEUN).when((lead == _NIEUN) & silent, _IEUNG).otherwise(lead)
    code = (new * 588 + rest + _FIRST).cast("int")
    # a code point of three UTF-8 bytes
    utf8 = F.concat(F.hex(F.lit(224) + F.shiftright(code, 12)), F.hex(F.lit(128) + F.shiftright(code, 6).bitwiseAND(63)), F.hex(F.lit(128) + code.bitwiseAND(63)))
    return F.when(index.between(0, 11171), F.decode(F.unhex(utf8), "UTF-8")).otherwise(syllable)


def han_readings(names: DataFrame, key: str, text: str, readings: DataFrame) -> DataFrame:
    """(key, reading) of names of two characters or more that are all Han with a reading, or separators.

    Characters are exploded and joined with (kanji, reading); a name with a character left over has no reading."""
    own = names.where(F.trim(text).rlike(rf"^[\x{{4E00}}-\x{{9FFF}}{SEPARATORS}]{{2,}}$"))
    chars = own.select(key, F.posexplode(F.split(F.trim(text), "")).alias("at", "kanji")).where("kanji != ''")
    read = chars.join(readings, "kanji", "left").withColumn("reading", F.when(F.col("kanji").rlike(f"[{SEPARATORS}]"), F.col("kanji")).otherwise(F.col("reading")))
    whole = read.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "reading"))).alias("parts"), F.bool_and(F.col("reading").isNotNull()).alias("known")).where("known")
    joined = F.array_join(F.transform("parts", lambda p: p["reading"]), "")
    words = F.transform(F.split(F.regexp_replace(joined, f"([{SEPARATORS}])", "\u0001$1\u0001"), "\u0001"), lambda w: F.concat(initial_sound(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return whole.select(key, F.array_join(words, "").alias("reading"))


def katakana_reading(text: Column) -> Column:
    """Katakana in Hangul: pairs before single signs, a small tsu makes the next syllable tense, n closes the syllable
    before it; null if a sign has no reading or there is no letter."""
    own = F.trim(text)
    signs = F.regexp_extract_all(own, F.lit("(?s)" + "|".join([*PAIRS, "."])), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in {**PAIRS, **SINGLES, "／": "／", "/": "/"}.items() for x in pair))
    tense = F.create_map(*(F.lit(x) for pair in TENSE.items() for x in pair))
    state = F.struct(F.lit(False).alias("small"), F.lit("").alias("out"), F.lit(True).alias("known"))

    def step(a: Column, sign: Column) -> Column:
        value = F.try_element_at(table, sign)
        first = F.left(value, F.lit(1))
        strong = F.concat(F.coalesce(F.try_element_at(tense, first), first), F.substring(value, F.lit(2), F.length(value)))
        put = F.when(a["small"] & (value != "") & ~sign.isin("／", "/"), strong).otherwise(value)
        return (
            F.when(sign == "ッ", F.struct(F.lit(True).alias("small"), a["out"].alias("out"), a["known"].alias("known")))
            .when(sign == "ン", F.struct(a["small"].alias("small"), F.concat(a["out"], F.lit("\u0001")).alias("out"), a["known"].alias("known")))
            .when(sign.isin("／", "/"), F.struct(a["small"].alias("small"), F.concat(a["out"], sign).alias("out"), a["known"].alias("known")))
            .otherwise(F.struct(F.lit(False).alias("small"), F.concat(a["out"], F.coalesce(put, F.lit(""))).alias("out"), (a["known"] & value.isNotNull()).alias("known")))
        )

    done = F.aggregate(signs, state, step, lambda a: F.when(a["known"], a["out"]))
    letters = own.rlike("[ァ-ヶー・]") & own.rlike("^[ァ-ヶー・／/]+$")
    return F.when(letters, F.nullif(F.trim(closed(done)), F.lit("")))


def closed(text: Column) -> Column:
    """The text with marks for n put into the open syllables before them, or written as a letter."""
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        before, after = F.get(chars, i - 1), F.get(chars, i + 1)
        open_ = F.ascii(c).between(_FIRST, 0xD7A3) & ((F.ascii(c) - _FIRST) % 28 == 0)
        code = F.ascii(c) + 4
        utf8 = F.concat(F.hex(F.lit(224) + F.shiftright(code, 12)), F.hex(F.lit(128) + F.shiftright(code, 6).bitwiseAND(63)), F.hex(F.lit(128) + code.bitwiseAND(63)))
        taken = F.coalesce(F.ascii(before).between(_FIRST, 0xD7A3) & ((F.ascii(before) - _FIRST) % 28 == 0), F.lit(False))
        return F.when((after == "\u0001") & open_, F.decode(F.unhex(utf8), "UTF-8")).when((c == "\u0001") & taken, "").when(c == "\u0001", "ㄴ").otherwise(c)

    return F.array_join(F.transform(chars, one), "")
