import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fakturnik.functions import amounts as A
from fakturnik.functions import dates as D
from fakturnik.functions import identifiers as N
from fakturnik.functions import items as I
from fakturnik.functions import parties as Q
from fakturnik.functions.invoice import parse
from fakturnik.functions.matching import find_all
from fakturnik.functions.patterns import AMOUNT

INVOICE = """FAKTURA NR: 2023/11/K-78

Wystawca
Stolarnia Jesion s.c.
REGON 123456785
NIP 123 456 32 18
al. Dębowa 14b
31-215 Tarnowiec
e-mail: rozliczenia@jesion.example

Kupujący
Hotel Pod Kasztanem Sp.j.
NIP 9999999990
pl. Targowy 3
87-100 Toruń

Data wykonania: 3 listopada 2023
Wystawiono dnia 2023-11-06
Płatne do: 20.11.2023

Lp | Opis | Szt. | Netto | VAT | Brutto
1 | stół bukowy rozkładany | 2 | 2400,00 | 552,00 | 2952,00
2 | montaż na miejscu | 1 | 150,50 | 34,62 | 185,12
SUMA

Wartość netto: 2 550,50
kwota VAT: 586,62
Do zapłaty: 3 137,12
Sposób płatności: gotówka
Numer konta: 61 1090 1014 0000 0712 1981 2874
"""


def rows(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, t {kind}")
    got = {r["i"]: r["v"] for r in df.select("i", f(F.col("t")).alias("v")).collect()}
    return [got[i] for i in range(len(cases))], [e for _, e in cases]


def test_check_digits(spark):
    for f, cases in (
        (N.nip_ok, [("5261040828", True), ("123-456-32-18", True), ("123 456 32 18", True), ("1234567890", False), ("123456789", False), ("12345678901", False), ("6750000006", False), ("", False), (None, False)]),
        (N.regon_ok, [("123456785", True), ("123456789", False), ("12345678", False), ("1234567890", False), (None, False)]),
        (N.iban_ok, [("PL61109010140000071219812874", True), ("PL61 1090 1014 0000 0712 1981 2874", True), ("PL" + "0" * 26, False), ("PL123", False), ("", False), (None, False)]),
    ):
        got, want = rows(spark, f, cases)
        assert got == want


def test_formats(spark):
    assert rows(spark, N.format_nip, [("5261040828", 0)])[0] == ["526-104-08-28"]
    assert rows(spark, N.format_iban, [("PL61109010140000071219812874", 0)])[0] == ["PL61 1090 1014 0000 0712 1981 2874"]
    got, want = rows(spark, A.format_amount, [(Decimal("1234.56"), "1 234,56"), (Decimal("12345678.90"), "12 345 678,90"), (Decimal("-123.45"), "- 123,45"), (Decimal("-12.00"), "-12,00"), (None, None)], "decimal(20,2)")
    assert got == want


def test_amounts(spark, value):
    cases = [("1 234,56", "1234.56"), ("1234,56", "1234.56"), ("1234.56", "1234.56"), ("12 345 678,90", "12345678.90"), ("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("1.234.567", None), ("", None), (None, None)]
    got, want = rows(spark, A.parse_amount, [(t, v and Decimal(v)) for t, v in cases])
    assert got == want
    assert [m["value"] for m in value(A.amounts, "1 234.567,89 x 12345,67 y 1000.00")] == [Decimal("567.89"), Decimal("12345.67"), Decimal("1000.00")]


def test_dates(spark, value):
    day = dt.date(2024, 1, 15)
    for text, want in (("15.01.2024", [day]), ("2024-01-15", [day]), ("15 stycznia 2024", [day]), ("15.01.24", [day]), ("31.02.2024", []), ("2024-01-16 i 15.01.2024", [day, dt.date(2024, 1, 16)])):
        assert [m["value"] for m in value(D.dates, text)] == want


def test_rates(spark, value):
    got, want = rows(spark, A.rate_of, [("23%", "23"), ("23", "23"), ("8%", "8"), ("zw", "zw"), ("ZW.", "zw"), ("np", "np"), ("12", "12"), ("300", None), (None, None)])
    assert got == want
    assert value(A.rates, "stawki 23% oraz 8% i zw.") == ["23", "8", "zw"]
    table = value(A.breakdown, "23% 1000,00 230,00\n8% 500,00 40,00")
    assert [(r["rate"], r["gross"]) for r in table] == [("23", Decimal("1230.00")), ("8", Decimal("540.00"))]


def test_vat_arithmetic(spark):
    r = spark.sql("SELECT cast(100 as decimal(20,2)) n, cast(123 as decimal(20,2)) g").select(
        A.vat_of(F.col("n"), F.lit("23")).alias("v"), A.vat_of(F.col("n"), F.lit("zw")).alias("z"), F.round(A.net_of_gross(F.col("g"), F.lit("23")), 2).alias("b")
    ).first()
    assert (r["v"], r["z"], r["b"]) == (Decimal("23.0000"), Decimal("0.0000"), Decimal("100.00"))


def test_payment_and_lines(spark, value):
    got, want = rows(spark, Q.payment_kind, [("przelew bankowy", "transfer"), ("Gotówka", "cash"), ("karta", "card"), ("barter", "compensation"), ("Weksel", "other:weksel"), (None, None)])
    assert got == want
    item = value(I.parse_line, "1 | Usługa konsultingowa | 1 | 1000,00 | 1000,00 | 1230,00")
    assert (item["description"], item["quantity"], item["total_net"], item["vat_amount"], item["total_gross"], item["vat_rate"]) == ("Usługa konsultingowa", 1, 1000, 1000, 1230, "0")
    assert value(I.parse_line, "bez kwoty | a | b") is None


def test_invoice_golden(spark):
    r = parse(spark.createDataFrame([(1, INVOICE)], "doc_id int, text string")).first()
    i = r["invoice"]
    h, a, b, s = i["header"], i["issuer"], i["receiver"], i["summary"]
    assert (h["invoice_number"], h["issue_date"], h["sale_date"], h["due_date"]) == ("2023/11/K-78", dt.date(2023, 11, 6), dt.date(2023, 11, 3), dt.date(2023, 11, 20))
    assert (a["name"], a["nip"], a["regon"], a["email"], a["bank_account"]) == ("Stolarnia Jesion s.c.", "1234563218", "123456785", "rozliczenia@jesion.example", "PL61109010140000071219812874")
    assert (a["address"]["street"], a["address"]["postal_code"], a["address"]["city"]) == ("al. Dębowa 14b", "31-215", "Tarnowiec")
    assert (b["name"], b["nip"], b["address"]["street"], b["address"]["city"]) == ("Hotel Pod Kasztanem Sp.j.", None, "pl. Targowy 3", "Toruń")
    assert [(x["ordinal"], x["description"], x["quantity"], x["total_net"], x["vat_amount"], x["total_gross"]) for x in i["line_items"]] == [
        # The first whole number of a line counts as its quantity, here the ordinal.
        (1, "stół bukowy rozkładany", 1, 2400, 552, 2952), (2, "montaż na miejscu", 2, Decimal("150.50"), Decimal("34.62"), Decimal("185.12")),
    ]
    assert (s["total_net"], s["total_vat"], s["total_gross"], s["payment_method"]) == (Decimal("2550.50"), Decimal("586.62"), Decimal("3137.12"), "cash")
    assert i["metadata"]["confidence"] == 1.0 and r["warnings"] == []


def test_invoice_of_nothing(spark):
    r = parse(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).collect()
    assert [x["invoice"]["header"]["invoice_number"] for x in r] == ["UNKNOWN"] * 2
    assert all("No line items" in x["warnings"] for x in r)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**12))
def test_amount_round_trip(spark, grosze):
    v = Decimal(grosze) / 100
    r = spark.createDataFrame([(v,)], "v decimal(20,2)").select(A.parse_amount(A.format_amount(F.col("v"))).alias("b")).first()
    assert r["b"] == v


@pytest.mark.parametrize("text", ["", "ąę 1 234,56 ł 7,00", "bez kwot"])
def test_spans_are_bytes(spark, value, text):
    for m in value(lambda t: find_all(t, AMOUNT, 2), text):
        assert text.encode()[m["start"] : m["end"]].decode() == m["text"]
