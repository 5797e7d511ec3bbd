"""Text and number semantics of filings, as Column functions: no UDF anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the filings' notation.
AMOUNT_UNITS = "元|千元|万元|亿元|百万元"
OTHER_UNITS = "股|份|件|吨|千克|平方米|人|个|%"
UNIT = rf"单位[：:\s]*(?:人民币)?\s*({AMOUNT_UNITS}|{OTHER_UNITS})"
AMOUNT_UNIT = rf"单位[：:\s]*(?:人民币)?\s*({AMOUNT_UNITS})"
CURRENCY = r"币种[：:\s]*([一-龥]{2,6})"
PROSE_UNIT = rf"[（(][^（()）\n0-9]{{0,30}}?(?:人民币)?\s*({AMOUNT_UNITS})"
NUMERIC_CELL = r"^[-－(（]?[0-9,，]+(\.[0-9]+)?[)）%]?$"
GROUPED_NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
VALUE_CELL = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+(?:\.[0-9]+)?\s*%"
CJK = r"[一-鿿]"
TOC = r"\.{6,}\s*[0-9]+\s*$"
SECTION = r"^第[一二三四五六七八九十]{1,3}[节章]\s*(.+)$"
DECIMAL_SECTION = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){1,2})\s+(\S.{2,38})$"
DECIMAL_DEEP = r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}\s+\S"
SUBSECTION = r"^([一二三四五六七八九十]{1,3})[、．]\s*(.+)$"
ITEM = r"^[（(]([一二三四五六七八九十]{1,3})[）)]\s*(.+)$"
YEAR = r"(20[0-9]{2})\s*年"
YEAR_LABEL = r"20[0-9]{2}\s*年"
NOT_A_YEAR_COLUMN = r"增减|增长|变动|幅度|%|％"
STATEMENT_SCOPE = r"(合并|母公司)(资产负债表|利润表|现金流量表|所有者权益变动表|综合收益表)"
SUMMARY_TITLE = r"主要会计数据|主要财务数据|财务概要|财务指标摘要"
UNIT_SCALE = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}
SPOKEN_SCALE = UNIT_SCALE | {"万": 1e4, "亿": 1e8}
#: What Unicode takes for white space, written out, as regex dialects differ in \s.
WHITE = "[\\s 　]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def normalize_cell(c: Column) -> Column:
    """Null is empty; wide and fixed spaces are spaces; a line break in a cell joins; blanks collapse."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[　 ]", " ")
    c = F.regexp_replace(c, r"\s*\n\s*", "")
    return stripped(F.regexp_replace(c, "[ \t]+", " "))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_numeric(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("")).rlike(NUMERIC_CELL)


def heading_kind(line: Column) -> Column:
    """section, subsection or item; null for what is no heading. The order of the tests is part of the rule."""
    return (
        F.when(line.rlike(SECTION), "section")
        .when(line.rlike(SUBSECTION), "subsection")
        .when(line.rlike(ITEM), "item")
        .when(line.rlike(DECIMAL_SECTION), F.when(line.rlike(DECIMAL_DEEP), "item").otherwise("subsection"))
    )


def statement_type(joined: Column) -> Column:
    has = lambda *words: F.reduce(F.array(*(joined.contains(w) for w in words)), F.lit(False), lambda a, b: a | b)
    return F.when(has("资产负债表"), "balance").when(has("现金流量表"), "cashflow").when(has("利润表", "损益", "综合收益"), "income").when(has("所有者权益变动", "股东权益变动"), "equity")


def scale(unit: Column, scales: dict[str, float] = UNIT_SCALE) -> Column:
    """Yuan in one of a unit; null if the unit is not known."""
    out = F.lit(None).cast("double")
    for name, factor in scales.items():
        out = F.when(unit == name, F.lit(factor)).otherwise(out)
    return out


def est_tokens(c: Column) -> Column:
    """One for each CJK character, and one for three of the others."""
    han = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return (han + F.floor((F.length(c) - han) / 3)).cast("int")


def truncate_utf8(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within limit bytes."""
    raw = F.hex(F.encode(c, "UTF-8"))
    # a cut before byte k (from 1) is good where that byte does not continue a character: its high digit is not 8 to B
    good = F.filter(F.sequence(F.lit(limit + 1), F.lit(max(1, limit - 2)), F.lit(-1)), lambda k: ~F.substring(raw, 2 * k - 1, F.lit(1)).isin("8", "9", "A", "B"))
    cut = F.decode(F.unhex(F.substring(raw, F.lit(1), 2 * (F.element_at(good, 1) - 1))), "UTF-8")
    return F.when(F.octet_length(F.encode(c, "UTF-8")) <= limit, c).otherwise(cut)


def chunk_uid(doc_key: Column, strategy: Column, level: Column, seq: Column) -> Column:
    key = F.concat_ws("|", doc_key, strategy, level.cast("string"), seq.cast("string"))
    return F.concat(doc_key, F.lit("-"), strategy, F.lit("-L"), level.cast("string"), F.lit("-"), F.lpad(seq.cast("string"), 5, "0"), F.lit("-"), F.substring(F.sha1(key), 1, 16))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
