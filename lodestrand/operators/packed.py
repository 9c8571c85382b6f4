"""Several values packed in one text field, one value per row with its place.

The text is cut at its structural quote characters: odd pieces are literals, even pieces are cut at delimiters, and an
array fold puts the values together again, so a delimiter inside a quoted or escaped value belongs to it.

A quote is structural where a value begins or ends, that is beside a delimiter, an outer bracket or the text's edge; one
inside a word (an apostrophe, an inch mark) is a character. Delimiters are comma, semicolon, bar, tab and line break in
their western and CJK forms, and a slash with white space on both sides. Null, empty and blank fields, and fields of
delimiters only, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import fan_out

# Private-use characters that stand for parts of the text while it is taken apart; such characters of the text itself are
# written as their code between two marks meanwhile.
_CUT, _END, _OWN = "\ue000", "\ue002", "\ue0ff"
_BLOCK = "[\ue000-\ue0ff]"
#: A backslash and the character after it become one character of this block, so neither is taken for syntax.
_ESCAPED = {"\\": "\ue010", '"': "\ue011", "'": "\ue012", ",": "\ue013", ";": "\ue014", "|": "\ue015", "/": "\ue016", "，": "\ue017", "；": "\ue018", "、": "\ue019", "[": "\ue01a", "]": "\ue01b"}
_CONTROL = {"n": "\n", "t": "\t", "r": "\r"}
_CONTROL_AT = {"n": "\ue01c", "t": "\ue01d", "r": "\ue01e"}
_SPACE = r"[\s\u00a0\u3000\u200b\ufeff]"
_DELIMITER = rf"[,;|\t\n\r\u000b\u000c\u2028\u2029，；、｜]|(?<={_SPACE})/(?={_SPACE})"
# A quote opens a value after the text's edge, a delimiter or an outer bracket, with any white space between, and closes one
# before them; the first alternative takes what stands before the quote along.
_QUOTE = rf"""((?:^|[,;|\t\n\r，；、｜\[]|{_SPACE}/{_SPACE}){_SPACE}*)["']|["'](?={_SPACE}*(?:$|[,;|\t\n\r，；、｜\]]|{_SPACE}/{_SPACE}))"""


def _woven(plain: Column, between: Column) -> Column:
    """The pieces of a text with what stands between them."""
    return F.array_join(F.zip_with(plain, between, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")


def _unescape_unicode(text: Column) -> Column:
    r"""``\uXXXX`` runs become the characters they stand for."""
    run = r"((?:\\u[0-9a-fA-F]{4})+)"
    coded = F.regexp_extract_all(text, F.lit(run), F.lit(1))
    plain = F.split(text, run)
    decoded = F.transform(coded, lambda c: F.decode(F.unhex(F.regexp_replace(c, r"\\u", "")), "UTF-16BE"))
    return F.when(text.rlike(r"\\u[0-9a-fA-F]{4}"), _woven(plain, decoded)).otherwise(text)


def unpack(field: Column) -> Column:
    """The values packed in ``field``, in order, as an array without empty values (never null)."""
    text = _unescape_unicode(field)
    own = F.transform(F.regexp_extract_all(text, F.lit(f"({_BLOCK})"), F.lit(1)), lambda c: F.concat(F.lit(_OWN), F.hex(F.encode(c, "UTF-16BE")), F.lit(_OWN)))
    text = F.when(text.rlike(_BLOCK), _woven(F.split(text, _BLOCK, -1), own)).otherwise(text)
    for c, to in _ESCAPED.items():
        text = F.replace(text, F.lit("\\" + c), F.lit(to))
    for c, to in _CONTROL_AT.items():
        text = F.replace(text, F.lit("\\" + c), F.lit(to))
    text = F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")
    text = F.regexp_replace(text, r"^\[([\s\S]*)\]$", "$1")
    # a doubled quote inside a quoted value is one quote character
    text = F.regexp_replace(text, rf'(?<![,;|\t\n\r，；、｜\[])(?<!^)(?<!{_SPACE})""(?=[^"])', _ESCAPED['"'])
    text = F.regexp_replace(text, _QUOTE, f"$1{_CUT}")
    pieces = F.split(text, _CUT)
    marked = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.regexp_replace(p, _DELIMITER, _END)))
    whole = F.aggregate(marked, F.lit(""), lambda acc, p: F.concat(acc, p))
    values = F.transform(F.split(whole, _END), _finish)
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v != "")


def _finish(v: Column) -> Column:
    for c, to in _ESCAPED.items():
        v = F.replace(v, F.lit(to), F.lit(c))
    for c, to in _CONTROL_AT.items():
        v = F.replace(v, F.lit(to), F.lit(_CONTROL[c]))
    coded = f"{_OWN}(E0[0-9A-F]{{2}}){_OWN}"
    own = F.transform(F.regexp_extract_all(v, F.lit(coded), F.lit(1)), lambda c: F.decode(F.unhex(c), "UTF-16BE"))
    v = F.when(v.contains(_OWN), _woven(F.split(v, coded, -1), own)).otherwise(v)
    return F.regexp_replace(v, rf"^{_SPACE}+|{_SPACE}+$", "")


def unpack_fields(df: DataFrame, tbl: str, key: str, fields: list[str]) -> DataFrame:
    """``tbl``, ``rec_id``, ``field``, ``pos`` (from 1), ``val`` of every value packed in ``fields``.

    A key counts once, however often its row is repeated; of rows that share a key and differ, each distinct text counts.
    """
    one = fan_out(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("rec_id"), *fields).dropDuplicates())
    stacked = one.select("rec_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in fields))).alias("x")).select("rec_id", "x.field", "x.body")
    return stacked.where(F.col("body").isNotNull()).select(F.lit(tbl).alias("tbl"), "rec_id", "field", F.posexplode(unpack(F.col("body"))).alias("p", "val")).select("tbl", "rec_id", "field", (F.col("p") + 1).alias("pos"), "val")
