"""What script syntax looks like: names, namespaces, protected functions and commands, and patterns made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Names whose arguments are code, and the namespaces that the engine knows.
PROTECTED_FUNCTIONS = """
GETCONFIG VARSIZE LOADTEXT SAVETEXT GCREATEFROMFILE GCREATEFROMFILE2 GCREATEFROMFILE3 GCREATEFROMFILE4 GLOAD GLOADBASE64
GDISPOSE FONTSTYLE FONTBOLD FONTITALIC FONTREGULAR PLAYSOUND PLAYBGM STOPSOUND OUTPUTLOG XML_CREATE XML_OPEN XML_LOAD
XML_SAVE XML_GET XML_SET XML_REMOVE MAP_CREATE MAP_GET MAP_SET MAP_REMOVE DATATABLE_CREATE DATATABLE_LOAD DATATABLE_SAVE
DATATABLE_GET DATATABLE_SET CALC_CHARA_SINGLE_DATA CALC_CHARA_SINGLE_DATA_RULED CALC_CHARA_MULTIPLE_DATA
CALC_CHARA_MULTIPLE_DATA_BASE CALC_CHARA_RANGED_DATA GET_NONEXISTABLE_CHARA_NO_DEFAULTABLE_SINGLE_DATA
GET_NONEXISTABLE_VALUES_BYNAME GET_NONEXISTABLE_TALENT_BYNAME GET_NONEXISTABLE_ABL_BYNAME GET_NONEXISTABLE_CFLAG_BYNAME
GET_NONEXISTABLE_EXP_BYNAME GET_NONEXISTABLE_CSTR_BYNAME
""".split()
PROTECTED_COMMANDS = """
LOADTEXT SAVETEXT PLAYSOUND PLAYBGM OUTPUTLOG PRINT_IMG PRINT_RECT PRINT_SPACE GCREATEFROMFILE HTML_PRINT XML_CREATE
XML_OPEN XML_LOAD XML_SAVE MAP_CREATE DATATABLE_CREATE DATATABLE_LOAD DATATABLE_SAVE
""".split()
PALETTE_FUNCTIONS = "BARCOLORSET BARCOLORSET_HTML カラーパレット カラーパレット_透明度込 カラーパレット_HTML".split()
#: A line that holds one of these names images.
IMAGE_MARKS = ["EXIST画像FILE(", "ENUMFILES(", "顔グラ表示用文字列関数(", "任意顔グラ表示用文字列関数(", "GCREATE_拡張子(", "GCREATE_拡張子F(", "IMAGEPATH_", ":画像フォルダ%/", '"ダンジョン用_', "/ダンジョン用_"]
NAMESPACES = """
CALLNAME NAME NICKNAME MASTERNAME CFLAG TFLAG FLAG CSTR STR TSTR SAVESTR GLOBALS GLOBAL ITEM ITEMPRICE ITEMSALES BASE
MAXBASE DOWNBASE ABL CUP UP DOWN PALAM JUEL GOTJUEL CDOWN EXP MARK TALENT SOURCE EX NOWEX TEQUIP EQUIP STAIN RELATION
TCVAR CDFLAG DAY DAYNAME TIME TIMENAME MONEY MONEYNAME
""".split()
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
QUOTED = r'@?"(?:[^"]|"")*"'
INDEXED_CALL = rf"(?<![\p{{L}}\p{{N}}_]){NAME}:\((?:[^()\r\n]|\([^()\r\n]*\))*\)"
#: Namespaces are tried longest first.
BY_LENGTH = sorted(NAMESPACES, key=lambda x: (-len(x), x))
KEY = r"""[^\s,)(\]\[+\-*/<>=!&|%"']+"""


def symbol_reference(namespaces: list[str] | None = None) -> str:
    """A namespace and a key in braces, a key after a variable, or a key."""
    own = "|".join(BY_LENGTH if namespaces is None else sorted(namespaces, key=lambda x: (-len(x), x)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{own}):(?:\{{[^{{}}\r\n]+\}}|[A-Za-z_][A-Za-z0-9_]*:{KEY}|{KEY})"


SYMBOL = symbol_reference()
#: A percent expression, braces, a mark-up tag, a call without parentheses inside, or a name with keys.
SCRIPT_TOKEN = rf"(?:%[^%\r\n]+%|\{{[^{{}}\r\n]+\}}|<[^\r\n<>]+>|(?<![\p{{L}}\p{{N}}_]){NAME}(?:\s*\([^()\r\n]*\)|(?::(?:\{{[^{{}}\r\n]+\}}|{KEY}))+))"


def looks_like_symbol_expression(text: Column) -> Column:
    """Symbol references, names and operators, and nothing else; at least one reference."""
    rest = F.regexp_replace(text, SYMBOL, "")
    left = F.regexp_replace(F.regexp_replace(T.strip_placeholders(rest), "[A-Za-z_][A-Za-z0-9_]*", ""), r"[\s\p{Z}\p{Nd}\p{P}\p{S}]+", "")
    return F.coalesce((rest != text) & (left == ""), F.lit(False))
