"""Money, currency, date and type parsing as Column expressions.

Each parser takes a string column and returns a struct of the value and a ``note``; a note on a value is a
warning, a note without one says why the cell didn't parse. Everything stays inside code generation: no
Python runs per row. Amounts are ``decimal(28,6)``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(28,6)"

# Currency signs and codes in the order in which they are looked for, and the code each stands for.
CURRENCIES = {
    "US$": "USD", "S$": "SGD", "A$": "AUD", "HK$": "HKD", "NZ$": "NZD", "C$": "CAD", "R$": "BRL",
    "SGD": "SGD", "USD": "USD", "GBP": "GBP", "JPY": "JPY", "EUR": "EUR", "AUD": "AUD", "HKD": "HKD", "NZD": "NZD", "CAD": "CAD", "CHF": "CHF", "CNY": "CNY", "RMB": "CNY", "INR": "INR",
    "£": "GBP", "€": "EUR", "¥": "JPY",
}
# The date formats that are tried in turn, day first.
DATE_FORMATS = ["yyyy-M-d", "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d/M/yy", "yyyy/M/d"]
MONTH_FIRST_FORMATS = ["M/d/yyyy", "M-d-yyyy", "M/d/yy"]
RECONCILE_FORMATS = ["yyyy-M-d", "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy/M/d", "d.M.yyyy"]
# Ordered vocabularies of ordinal columns.
ORDINAL_SCALES = [
    ["low", "medium", "high"], ["low", "med", "high"], ["low", "moderate", "high", "critical"], ["xs", "s", "m", "l", "xl", "xxl", "xxxl"],
    ["extra small", "small", "medium", "large", "extra large"], ["poor", "fair", "good", "very good", "excellent"], ["very poor", "poor", "average", "good", "very good"],
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"], ["never", "rarely", "sometimes", "often", "always"], ["cold", "warm", "hot"],
    ["bronze", "silver", "gold", "platinum", "diamond"], ["q1", "q2", "q3", "q4"], ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"], ["mon", "tue", "wed", "thu", "fri", "sat", "sun"],
]

_TOKENS = "|".join(re.escape(t).replace("\\$", "[$]") for t in sorted([*CURRENCIES, "$"], key=len, reverse=True))


def text(c: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def blank(c: Column) -> Column:
    return text(c) == ""


def _cast(c: Column) -> Column:
    return c.try_cast(AMOUNT)


def number(c: Column) -> Column:
    """struct(value, note): ``£1,234.50``, ``(500)``, ``1.2m``, ``15%``; whatever isn't a bare number after known tokens is refused."""
    s = text(c)
    bare = F.regexp_replace(s, r"^[()]+|[()]+$", "")
    unit = F.lower(F.right(bare, F.lit(1)))
    factor = F.when(unit == "m", F.lit(1_000_000)).when(unit == "k", F.lit(1000)).otherwise(F.lit(1))
    body = F.when(unit.isin("m", "k"), F.regexp_replace(bare, ".$", "")).otherwise(bare)
    percent = body.rlike(r"%\s*$")
    body = F.regexp_replace(body, r"%\s*$", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, ",", ""), f"(?i){_TOKENS}", ""), r"\s+", "")
    whole = body.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$")
    raw = F.regexp_replace(body, "[.]$", "").try_cast("decimal(28,8)")
    value = (raw * factor).cast("decimal(38,8)")
    value = F.when(s.startswith("(") & s.endswith(")"), -F.abs(value)).otherwise(value)
    value = F.when(percent, value / 100).otherwise(value).try_cast(AMOUNT)
    european = s.rlike(r"-?[0-9]{1,3}([.][0-9]{3})+,[0-9]+")
    value = F.when(whole & ~european & (s != ""), value)
    note = F.when(s == "", "empty").when(european, F.concat(F.lit("ambiguous European number format: "), s)).when(value.isNull(), F.concat(F.lit("not a number: "), s)).otherwise("")
    return F.struct(value.alias("value"), note.alias("note"))


def amount(c: Column) -> Column:
    """The number of a cell, or null."""
    return number(c)["value"]


def currency_code(c: Column) -> Column:
    """The ISO code that a cell names, null for a bare $ or none."""
    upper = F.upper(text(c))
    return F.coalesce(*(F.when(upper.contains(sign), code) for sign, code in CURRENCIES.items()))


def currency(c: Column) -> Column:
    """struct(value, code, note)."""
    n, code = number(c), currency_code(c)
    note = F.when(n["value"].isNull(), n["note"]).when(code.isNotNull(), "").when(text(c).contains("$"), "ambiguous '$': could be USD, SGD, AUD or HKD; give the expected currency").otherwise("no currency symbol: code unknown")
    return F.struct(n["value"].alias("value"), F.when(n["value"].isNotNull(), code).alias("code"), note.alias("note"))


def resolved_code(cell: Column, code_cell: Column | None = None, expected: str | None = None) -> Column:
    """Code of the amount's own cell, else of the code column, else the expected one, else empty."""
    options = [currency_code(cell)] + ([currency_code(code_cell)] if code_cell is not None else []) + [F.lit(expected or "")]
    return F.coalesce(*options)


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# What the letters of a format stand for; years of two digits up to 68 are of this century.
_LETTERS = {"yyyy": "[0-9]{4}", "M": "0?[1-9]|1[0-2]", "MM": "0[1-9]|1[0-2]", "MMM": "|".join(m[:3] for m in _MONTHS), "MMMM": "|".join(_MONTHS), "d": "[0-9]{1,2}", "dd": "[0-9]{2}"}
_CENTURIES = {"20": "[0-5][0-9]|6[0-8]", "19": "69|[7-9][0-9]"}


def _rules(formats: list[str]) -> list[tuple[str, str]]:
    """(pattern, replacement) that turn texts of the formats into year-month-day. Formats that differ in their one separator
    only, such as d/M/yyyy and d-M-yyyy, make one pattern."""
    alike: dict[tuple, list[str]] = {}
    for fmt in formats:
        parts = re.findall("y+|M+|d+|[^yMd]+", fmt)
        letters, marks = tuple(p for p in parts if p[0] in "yMd"), [p for p in parts if p[0] not in "yMd"]
        one = len(marks) == 2 and marks[0] == marks[1] and len(marks[0]) == 1
        alike.setdefault((letters, "one" if one else tuple(marks)), []).append(marks[0] if one else "")
    out = []
    for (letters, marks), seps in alike.items():
        for century, years in _CENTURIES.items() if "yy" in letters else {"": ""}.items():
            named = [f"(?<{p[0]}>{years if p == 'yy' else _LETTERS[p]})" for p in letters]
            if marks == "one":
                pattern = f"{named[0]}(?<s>[{re.escape(''.join(seps))}]){named[1]}\\k<s>{named[2]}"
            else:
                pattern = named[0] + "".join(re.escape(m) + n for m, n in zip(marks or ("", ""), named[1:], strict=True))
            out.append((f"(?i)^{pattern}$", f"{century}${{y}}-${{M}}-${{d}}"))
    return out


def _rewritten(s: Column, formats: list[str]) -> Column:
    for pattern, replacement in _rules(formats):
        s = F.regexp_replace(s, pattern, replacement)
    return s


def _formatted(s: Column, formats: list[str]) -> Column:
    """The day of a text in the first format that it has the shape of: year first, with a month's name, or in figures. It is
    rewritten by the few patterns of its kind and parsed once."""
    first = [f for f in formats if f.startswith("yyyy") and f != "yyyyMMdd"]
    named = [f for f in formats if "MMM" in f]
    words = _rewritten(s, named)
    name = F.regexp_extract(words, "^[0-9]{4}-([A-Za-z]{3,9})-", 1)
    month = ((F.instr(F.lit("".join(m[:3] for m in _MONTHS)), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int").cast("string")
    spelled = F.concat(F.substring(words, 1, 5), month, F.regexp_replace(words, "^[0-9]{4}-[A-Za-z]+", ""))
    figures = _rewritten(s, [f for f in formats if f not in first and f not in named])
    iso = F.when(s.rlike("^[0-9]{4}[^0-9]"), _rewritten(s, first)).when(s.rlike("[A-Za-z]"), spelled).otherwise(figures)
    return F.try_to_timestamp(F.when(iso.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), iso), F.lit("yyyy-M-d")).cast("date")


def date(c: Column, dayfirst: bool = True) -> Column:
    """struct(value, note): many formats and spreadsheet serials; an order that can be read two ways is noted."""
    s = text(c)
    serial = s.rlike(r"^[0-9]{5}([.][0-9]+)?$")
    days = F.when(serial, F.substring(s, 1, 5).try_cast("int"))
    from_serial = F.date_add(F.lit("1899-12-30").cast("date"), days)
    formats = DATE_FORMATS if dayfirst else [*MONTH_FIRST_FORMATS, *DATE_FORMATS]
    spaced = F.regexp_replace(s, r"\s+", " ")
    value = F.when(serial, from_serial).otherwise(_formatted(spaced, formats))
    pattern = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-][0-9]{2,4}$"
    a, b = (F.regexp_extract(s, pattern, i).try_cast("int") for i in (1, 2))
    unclear = F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))
    read = "day/month" if dayfirst else "month/day"
    fraction = s.rlike("[.][0-9]*[1-9]")
    note = (
        F.when(s == "", "empty")
        .when(serial, F.when(fraction, "parsed from Excel serial; date-time truncated to date").otherwise("parsed from Excel serial"))
        .when(value.isNull(), F.concat(F.lit("unrecognised date: "), s))
        .when(unclear, F.concat(F.lit("ambiguous date "), s, F.lit(f": read as {read}")))
        .otherwise("")
    )
    return F.struct(value.alias("value"), note.alias("note"))


def day(c: Column, dayfirst: bool = True) -> Column:
    """The date of a cell, or null; dates and timestamps pass through."""
    return date(c, dayfirst)["value"]


def boolean(c: Column) -> Column:
    s = F.lower(text(c))
    value = F.when(s.isin("yes", "true", "y", "1"), True).when(s.isin("no", "false", "n", "0"), False)
    return F.struct(value.alias("value"), F.when(s == "", "empty").when(value.isNull(), F.concat(F.lit("not a boolean: "), s)).otherwise("").alias("note"))


def lenient_amount(c: Column) -> Column:
    """The reconciliation's amounts: everything but digits, dots and minus signs goes."""
    s = text(c)
    bare = F.regexp_replace(s, "[^0-9.-]", "")
    value = _cast(bare)
    return F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value)


def reconcile_date(c: Column) -> Column:
    s = F.regexp_replace(text(c), r"\s+", " ")
    return _formatted(s, RECONCILE_FORMATS)


def reconcile_currency(c: Column) -> Column:
    """A code standing as a word, else a sign."""
    s = F.upper(text(c))
    codes = sorted(set(CURRENCIES.values()) | {"RMB"})
    word = F.regexp_extract(s, r"\b(" + "|".join(codes) + r")\b", 1)
    word = F.when(word == "RMB", "CNY").when(word != "", word)
    signs = [F.when(s.contains(k), v) for k, v in CURRENCIES.items() if not k.isalpha()]
    return F.coalesce(word, *signs)


_DATE_HINT = r"(?i)[/]|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"


def kind(c: Column) -> Column:
    """'date', 'number' or 'string' of a cell: what looks like a date is tried as one first."""
    return kind_from(text(c), day(c), amount(c))


def kind_from(s: Column, dated: Column, numeric: Column) -> Column:
    """The same from a cell's text and its readings."""
    return F.when(s == "", "string").when(s.rlike(_DATE_HINT) & dated.isNotNull(), "date").when(numeric.isNotNull(), "number").when(dated.isNotNull(), "date").otherwise("string")


def chart_number(c: Column) -> Column:
    """A finite double or null, never 0 for what isn't a number."""
    v = amount(c).cast("double")
    return F.when(~F.isnan(v), v)


def table_number(c: Column) -> Column:
    """The third dialect, of tables read from images: a double if the cell is only a number with signs and separators."""
    s = text(c)
    bare = F.regexp_replace(s, r"[,\s%$£€¥()]", "").try_cast("double")
    return F.when(s.startswith("(") & s.endswith(")"), -bare).otherwise(bare)


def converted(c: Column, kind_: str, code_cell: Column | None = None, expected: str | None = None, dayfirst: bool = True) -> Column:
    """struct(value, code, note, raw): a cell by its declared type. raw is kept where the conversion failed."""
    s = text(c)
    none = F.lit(None).cast("string")
    if kind_ == "number":
        n = number(c)
        return F.struct(n["value"].alias("value"), none.alias("code"), F.when(s == "", "").otherwise(n["note"]).alias("note"), F.when(n["value"].isNull() & (s != ""), s).alias("raw"))
    if kind_ == "currency":
        n, code = currency(c), resolved_code(c, code_cell, expected)
        note = F.when(s == "", "").when(n["value"].isNotNull() & (code != ""), "").otherwise(n["note"])
        return F.struct(n["value"].alias("value"), code.alias("code"), note.alias("note"), F.when(n["value"].isNull() & (s != ""), s).alias("raw"))
    if kind_ == "date":
        d = date(c, dayfirst)
        return F.struct(d["value"].alias("value"), none.alias("code"), F.when(s == "", "").otherwise(d["note"]).alias("note"), F.when(d["value"].isNull() & (s != ""), s).alias("raw"))
    if kind_ == "bool":
        b = boolean(c)
        return F.struct(b["value"].alias("value"), none.alias("code"), F.when(s == "", "").otherwise(b["note"]).alias("note"), F.when(b["value"].isNull() & (s != ""), s).alias("raw"))
    collapsed = F.regexp_replace(s, r"\s+", " ")
    return F.struct(collapsed.alias("value"), none.alias("code"), F.lit("").alias("note"), none.alias("raw"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
