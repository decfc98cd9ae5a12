import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import parsing as P
from ledgerloom.functions import texts as X


def cells(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_numbers(spark):
    want = {
        "£1,234.50": "1234.50", "(500)": "-500", "1.2m": "1200000", "15%": "0.15", "S$ 2.5m": "2500000", "-3": "-3", "+4": "4", ".5": "0.5", "7.": "7", "2k": "2000", "US$10": "10", "usd 3": "3",
        "1.234,56": None, "SKU-0001": None, "ACC-100": None, "1,234.50 CR": None, "": None, None: None, "n/a": None, "12/06/2026": None, "--5": None, "1e5": None,
    }
    got = cells(spark, list(want), P.amount(F.col("c")).alias("v"))
    assert [g[0] for g in got] == [None if w is None else Decimal(w) for w in want.values()]


def test_number_notes(spark):
    notes = [g[0] for g in cells(spark, ["", "1.234,56", "abc", "5"], P.number(F.col("c"))["note"].alias("n"))]
    assert notes[0] == "empty" and notes[1].startswith("ambiguous European") and notes[2].startswith("not a number") and notes[3] == ""


def test_currencies(spark):
    got = cells(spark, ["£5", "S$ 5", "US$5", "$5", "5", "eur 9", "RMB 3"], P.currency(F.col("c"))["code"].alias("a"), P.currency(F.col("c"))["note"].alias("n"))
    assert [g[0] for g in got] == ["GBP", "SGD", "USD", None, None, "EUR", "CNY"]
    assert "ambiguous" in got[3][1] and "unknown" in got[4][1] and got[0][1] == ""


def test_code_precedence(spark):
    df = spark.createDataFrame([("£5", "USD"), ("5", "USD"), ("5", "")], "c string, k string")
    assert [r.x for r in df.select(P.resolved_code(F.col("c"), F.col("k"), "SGD").alias("x")).collect()] == ["GBP", "USD", "SGD"]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2026-06-13", (2026, 6, 13)), ("20260613", (2026, 6, 13)), ("13/06/2026", (2026, 6, 13)), ("1-2-2026", (2026, 2, 1)), ("13-Jun-2026", (2026, 6, 13)), ("13.06.2026", (2026, 6, 13)), ("13 Jun 2026", (2026, 6, 13)), ("13 June 2026", (2026, 6, 13)),
        ("Jun 13, 2026", (2026, 6, 13)), ("June 13, 2026", (2026, 6, 13)), ("13/06/26", (2026, 6, 13)), ("13/06/69", (1969, 6, 13)), ("2026/06/13", (2026, 6, 13)), ("45000", (2023, 3, 15)), ("31/02/2026", None), ("soon", None), ("", None), ("1234567", None),
    ],
)
def test_dates(spark, text, day):
    assert cells(spark, [text], P.day(F.col("c")).alias("d"))[0][0] == (dt.date(*day) if day else None)


def test_date_notes_and_month_first(spark):
    notes = [g[0] for g in cells(spark, ["03/04/2026", "13/04/2026", "04/04/2026", "45000.5"], P.date(F.col("c"))["note"].alias("n"))]
    assert "ambiguous" in notes[0] and notes[1] == "" and notes[2] == "" and "truncated" in notes[3]
    assert cells(spark, ["03/04/2026"], P.day(F.col("c"), False).alias("d"))[0][0] == dt.date(2026, 3, 4)


def test_kinds_and_second_dialect(spark):
    assert [g[0] for g in cells(spark, ["15/02/2026", "1,000", "45000", "abc", "", "20260215"], P.kind(F.col("c")).alias("k"))] == ["date", "number", "number", "string", "string", "number"]
    assert [g[0] for g in cells(spark, ["SKU-0001", "1.2m", "(15)", "-", None], P.lenient_amount(F.col("c")).alias("v"))] == [Decimal(-1), Decimal("1.2"), Decimal(-15), None, None]


def test_texts(spark):
    one = lambda v, e: cells(spark, [v], e.alias("x"))[0][0]
    assert one("  a \n b ", X.collapsed(F.col("c"))) == "a b"
    assert one("o'neil mc-donald", X.cased(F.col("c"), "title")) == "O'Neil Mc-Donald"
    assert one("hELLO wORLD", X.cased(F.col("c"), "sentence")) == "Hello world"
    assert one("cafÃ©", X.repaired(F.col("c"))) == "café"
    assert one("Çafé Ltd.", X.folded(F.col("c"))) == "cafeltd"
    assert one("GB29 NWBK 6016 1331 9268 19", X.valid_iban(F.col("c"))) is True
    assert one("GB29NWBK60161331926818", X.valid_iban(F.col("c"))) is False
    assert one("Acme paid 1,234.50 to ACME Ltd", X.redacted(F.col("c"), ["acme ltd", "acme"], True)) == "[redacted] paid [amount] to [redacted]"
    assert one("привет", X.scripts(F.col("c"))) == ["Cyrillic"]


def test_amounts(spark):
    row = spark.sql("select date'2025-11-15' as d, cast(100 as decimal(28,6)) as a, cast(109 as decimal(28,6)) as b")
    got = row.select(A.period_key(F.col("d"), "quarter").alias("q"), A.periods_between(F.lit("2025-01-01").cast("date"), F.col("d"), "month").alias("n"), A.tax_hint(F.col("a"), F.col("b")).alias("h"), A.rounded(F.lit("1.005").cast("decimal(10,3)"), 2).alias("r")).first()
    assert (got.q, got.n, got.r) == ("2025-Q4", 10, Decimal("1.00")) and "9%" in got.h
    assert A.date_pattern("%d %b %Y") == "dd MMM yyyy"
