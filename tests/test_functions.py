"""Scalar rules on literal tables."""

import pytest
from folioframe.functions import lexicon as X
from folioframe.functions import messages as M
from folioframe.functions import numbers as N
from folioframe.functions import text as T
from folioframe.operators import layout as L
from pyspark.sql import functions as F


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, t {kind}")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


SHAPES = {
    "12": "NUM", "$1,195.20": "NUM", "1 195,20 €": "NUM", "(12.50)": "NUM", "-5": "NUM", "+5": "NUM", "−5": "NUM", "5 %": "NUM", "USD 5": "NUM", "NZ$3": "NUM", "1'234.5": "NUM",
    "$14.40 /bag": "NUMX", "600g total": "NUMX", "12 kg": "NUMX", "45x19": "NUMX", "12 running metres long": "TEXT", "Pine 45x19": "TEXT", "": "TEXT", "  ": "TEXT", "---": "TEXT", "XYZ 5": "TEXT", "4-NOT SPECIFIED": "TEXT",
}


def test_shapes_agree_in_the_jvm_and_in_the_fold(spark):
    assert dict(zip(SHAPES, values(spark, T.cell_shape, SHAPES))) == SHAPES
    assert {t: L.shape_of(t) for t in SHAPES} == SHAPES


def test_drawn_lines(spark):
    cases = {"---": True, "- - -": True, "====": True, "--": False, "$$$": False, "-a-": False, "": False, " ___ ": True}
    assert dict(zip(cases, values(spark, T.is_separator, cases))) == cases
    assert {t: L.is_drawn(t) for t in cases} == cases


PARTS = [
    # text, core, marker, percent, per, negative
    ("$1,195.20", "1,195.20", "$", False, None, False),
    ("1 195,20 €", "1 195,20", "€", False, None, False),
    ("(12.50)", "12.50", None, False, None, True),
    ("12.50 CR", "12.50", None, False, None, True),
    ("12.50 CR USD", "12.50", "USD", False, None, True),
    ("$12.50 CR", "12.50", "$", False, None, True),
    ("-$5", "5", "$", False, None, True),
    ("$-5", "5", "$", False, None, True),
    ("(-5)", None, None, False, None, True),
    ("5 %", "5", None, True, None, False),
    ("$14.40 /bag", "14.40", "$", False, "bag", False),
    ("$14.40/sq.m", "14.40", "$", False, "sq.m", False),
    ("AUD 7", "7", "AUD", False, None, False),
    ("XYZ 7", None, None, False, None, False),
    ("1..2", None, None, False, None, False),
    ("1,", None, None, False, None, False),
    ("$12.50 box", None, "$", False, None, False),
    ("Oak board grade 12", None, None, False, None, False),
    ("", None, None, False, None, False),
    ("£ 3", "3", "£", False, None, False),
]


def test_number_parts(spark):
    found = values(spark, N.analyse, [p[0] for p in PARTS])
    for (text, core, marker, percent, per, negative), got in zip(PARTS, found):
        assert (got.core, got.marker, got.percent, got.per, got.negative) == (core, marker, percent, per, negative), text


def by_hand(core, decimal, grouping):
    """A core under one convention, by splitting it: value, decimals, grouped; None if it isn't a number."""
    if any(c not in "0123456789" + decimal + grouping for c in core) or core.count(decimal) > 1:
        return None
    whole, _, fraction = core.partition(decimal)
    if decimal in core and not fraction.isdigit():
        return None
    groups = whole.split(grouping) if grouping and grouping in whole else [whole]
    if not all(g.isdigit() for g in groups) or (len(groups) > 1 and (groups[0][0] == "0" or len(groups[0]) > 3 or any(len(g) != 3 for g in groups[1:]))):
        return None
    return float("".join(groups) + "." + (fraction or "0")), len(fraction), len(groups) > 1


CORES = ["5", "007", "1.2", "1.20", "1.200", "1,200", "1.200,5", "1,200.5", "1 200", "1'200.25", "12.345.678", "1.2345", "0.123", "12,34,567", "1234.5678", "999,999", "1,234,567.89", "1 234 567,8", "0,5", "1.000"]


def test_readings_against_each_convention_by_hand(spark):
    rows = spark.createDataFrame([(c, m) for c in CORES for m in (255, 1, 15, 16, 240, 4, 0)], "t string, m int")
    parts = rows.withColumn("p", N.analyse(F.col("t"))).withColumn("valid", N.valid_mask(F.col("p"))).withColumn("r", N.read(F.col("p"), F.col("m")))
    for row in parts.collect():
        fits = {k: by_hand(row.t, *X.CONVENTIONS[k]) for k in range(8)}
        assert row.valid == sum(1 << k for k, v in fits.items() if v), row.t
        seen = list(dict.fromkeys(v[0] for k, v in fits.items() if v and row.m >> k & 1))
        first = next((v for k, v in fits.items() if v and row.m >> k & 1), None)
        if not seen:
            assert row.r.status == "unreadable", row
        elif len(seen) == 1:
            assert (row.r.status, row.r.value, row.r.dp, row.r.grouped) == ("ok", *first), row
        else:
            assert (row.r.status, row.r.value, row.r.other) == ("ambiguous", seen[0], seen[1]), row


def test_a_joining_space_groups_nothing(spark):
    row = spark.createDataFrame([("1 200",)], "t string").select(N.valid_mask(N.analyse(F.col("t"), F.array(F.lit(1)))).alias("a"), N.valid_mask(N.analyse(F.col("t"))).alias("b")).first()
    assert row.a == 0 and row.b == 0b100010


def test_votes_keep_ties_and_default_to_all(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 15), ("a", 255), ("b", 15), ("b", 240), ("c", 0)], "g string, m int")
    found = {r.g: r.m for r in rows.groupBy("g").agg(*N.vote_bits(F.col("m"))).select("g", N.voted_mask().alias("m")).collect()}
    assert found == {"a": 1, "b": 255, "c": 255}


@pytest.mark.parametrize("value,dp,mask,marker,after,expected", [
    (1234.565, 2, 1, "$", False, "$1,234.57"), (1234.5, 2, 16, "€", True, "1.234,50 €"), (-0.001, 2, 1, "$", False, "$0.00"), (-12.5, 0, 1, None, False, "-13"), (5.0, 1, 1, "AUD", False, "AUD 5.0"), (1234567.0, 0, 15, None, False, "1234567"), (2.5, 12, 1, None, False, "2.5000000000"),
])
def test_written_numbers(spark, value, dp, mask, marker, after, expected):
    row = spark.createDataFrame([(value, dp, mask, marker, after)], "v double, d int, m int, c string, a boolean").select(N.written(F.col("v"), F.col("d"), F.col("m"), F.col("c"), F.col("a")).alias("x")).first()
    assert row.x == expected


def test_very_long_texts(spark):
    """Nested loops of a pattern must not exhaust the stack."""
    texts = ["12 " * 3000, "1," * 20000 + "1", "a b " * 20000, "w: " * 5000, "1" * 300 + " boxes", "x" * 100000]
    for rule in (T.cell_shape, lambda t: N.valid_mask(N.analyse(t)), T.totals_kind, T.label_part, T.is_separator, lambda t: N.read(N.analyse(t), F.lit(255))["status"], lambda t: T.header_opinion(t, F.lit(True)), T.printed_value, T.singular, T.gst_basis):
        assert len(values(spark, rule, texts)) == len(texts)
    assert values(spark, T.cell_shape, texts) == ["NUM", "NUM", "TEXT", "TEXT", "NUMX", "TEXT"] == [L.shape_of(t) for t in texts]


def test_currencies(spark):
    cases = {"$": None, "€": "EUR", "NZ$": "NZD", "AUD": "AUD", "¥": None, "C$": None, None: None}
    assert values(spark, N.currency_code, list(cases)) == list(cases.values())


HEADINGS = {
    "Unit Price": "unitPrice", "UNIT PRICE:": "unitPrice", "Qty": "quantity", "Quantities": None, "Unit": "unit", "Units": "unit", "Line Total": "lineTotal", "Total": "lineTotal", "Amount (ex GST)": "lineTotal", "Item": "itemNo",
    "Part No": "code", "Product code": "code", "Product": "description", "#": "itemNo", "Weight": None, "Rate": "unitPrice", "Items": "itemNo", "Discount": None,
}


def test_heading_roles(spark):
    found = values(spark, lambda t: T.header_opinion(t, F.lit(True)), HEADINGS)
    assert {h: f.role for h, f in zip(HEADINGS, found)} == HEADINGS
    alone = values(spark, lambda t: T.header_opinion(t, F.lit(False)), ["Item", "Items", "Item no", "Price / Unit"])
    assert [(a.role, a.tie) for a in alone] == [("description", False), ("description", False), ("itemNo", False), (None, True)]


LABELS = {
    "Total:": "total", "Grand Totals": "total", "Sub-total": "subtotal", "SUBTOTAL.": "subtotal", "Total (excl. GST)": "subtotal", "Total ex of gst": "subtotal", "Total GST inclusive": "total", "GST 10%": "gst", "GST (10 %)": "gst",
    "Amount due": "amount_due", "Balances": "amount_due", "Total of": None, "Total hours": None, "Endbetrag": None, "Subtotal inc GST": "subtotal", "": None,
}


def test_total_labels(spark):
    assert dict(zip(LABELS, values(spark, T.totals_kind, LABELS))) == LABELS
    starts = {"Total: $5": True, "Totals": True, "Totally": False, "total-ish": False, "GST 10% $5": True, "a total": False, "Sub total x": True}
    assert dict(zip(starts, values(spark, T.starts_with_total, starts))) == starts
    assert {t: bool(L.TOTAL_FIRST.match(L.matching(t))) for t in starts} == starts
    basis = {"Total inc GST": "inclusive", "Amount (excl. gst)": "exclusive", "GST": None, "incl": None, "Total": None}
    assert dict(zip(basis, values(spark, T.gst_basis, basis))) == basis


def test_titles_and_labels(spark):
    cases = {"Date: 5 May": "Date", "Ship to address: x": "Ship to address", "one two three four: x": None, "at 12:30 sharp": None, "12 :30": "12", "No colon": None, "Ref 5:": "Ref 5"}
    assert dict(zip(cases, values(spark, T.label_part, cases))) == cases
    quotes = {"Acme - Credit Memo": "Credit Memo", "Returns Slip | north": "Returns Slip", "credit": "credit", "No word - here": "No word - here"}
    assert dict(zip(quotes, values(spark, lambda t: T.quoted_part(t, X.CREDIT_WORDS), quotes))) == quotes


def test_singular_and_printed_values(spark):
    words = {"Boxes": "box", "cherries": "cherry", "glass": "glass", "crates": "crate", "ties": "ty", "dishes": "dish", "ies": "ie", "as": "a"}
    assert dict(zip(words, values(spark, T.singular, words))) == words
    numbers = {"007": "7", "1,500": "1500", "1.500": "1500", "8.50": "8.5", "8,5": "8.5", "1.2.3": "1.2.3", "1,234,567": "1234567", "0": "0", "0.50": "0.5", "9" * 40: "9" * 40}
    assert dict(zip(numbers, values(spark, T.printed_value, numbers))) == numbers


def test_keys_lists_and_pages(spark):
    keys = {"Unit Price": "unitPrice", "Größe (mm)": "größeMm", "#": "col4", None: "col4", "éclat d'or": "éclatDOr"}
    assert values(spark, lambda t: T.column_key(t, F.lit(3)), list(keys)) == list(keys.values())
    lists = [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b and c")]
    assert values(spark, T.listed, [x for x, _ in lists], "array<string>") == [y for _, y in lists]
    pages = [([], "the document"), ([2], "page 2"), ([1, 2], "pages 1 and 2"), ([3, 1, 2, 2], "pages 1 to 3"), ([1, 3, 4], "pages 1, 3 and 4")]
    assert values(spark, T.pages_text, [x for x, _ in pages], "array<int>") == [y for _, y in pages]


def test_unique_keys(spark):
    from folioframe.operators.roles import keyed

    rows = spark.createDataFrame([([{"key": k} for k in ("a", "a", "a2", "a", "b")],)], "c array<struct<key:string>>")
    assert [c.key for c in rows.select(keyed(F.col("c")).alias("c")).first().c] == ["a", "a2", "a22", "a3", "b"]


def test_broken_share(spark):
    cases = {"": 0.0, "abc": 0.0, "a�": 0.5, " ": 1.0}
    assert dict(zip(cases, values(spark, T.broken_share, cases))) == cases


def test_every_wording_can_be_filled(spark):
    row = spark.range(1)
    for key, template in M.REFUSALS.items():
        import re

        names = re.findall(r"\{(\w+)\}", template)
        said = row.select(M.refusal(key, **{n: F.lit(n.upper()) for n in names}).alias("m")).first().m
        assert "{" not in said and all(n.upper() in said for n in names)
    assert row.select(M.megabytes(F.lit(4 * 1024 * 1024 + 1)).alias("m")).first().m == "4.1 MB"
    assert row.select(M.megabytes(F.lit(4 * 1024 * 1024), up=False).alias("m")).first().m == "4 MB"
