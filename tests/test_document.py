"""Documents made by hand, through the whole plan."""

import json

import pytest
from folioframe.operators import contract
from folioframe.plans.document import DocumentPlan, pages_per_part, reply_sizes, run_summary

HEADS = (("Item", 43), ("Description", 71), ("Qty", 326), ("Unit", 377), ("Unit Price", 428), ("Line Total", 502))
ROWS = (("1", "Pine batten 45x19", "12", "length", "$15.50", "$186.00"), ("2", "Deck screws 10g box", "8", "box", "$22.25", "$178.00"), ("3", "Joist hanger 90mm", "5", "ea", "$9.90", "$49.50"))
PAGES = "doc_id long, page int, image_count int, drawing_count int"
PIECES = "doc_id long, page int, ord int, str string, x double, y double, width double, font_size double, angle double"


def at(y, *cells, angle=0.0, size=9.0):
    return [(t, float(x), float(y), len(t) * size / 2, size, angle) for t, x in cells if t]


def page(rows=ROWS, heads=HEADS, title="Quote", after=(), above=()):
    out = at(77, (title, 43)) + [p for i, line in enumerate(above) for p in at(100 + 14 * i, *line)]
    out += at(176, *heads) if any(h for h, _ in heads) else []
    for i, row in enumerate(rows):
        out += at(198 + 17 * i, *zip(row, (x for _, x in heads)))
    for i, line in enumerate(after):
        out += at(198 + 17 * len(rows) + 34 + 17 * i, *line)
    return out


TOTAL = lambda label, amount: ((label, 428), (amount, 502))
NUMBERED = lambda n, unit="ea": tuple((str(i), f"Timber board {i} long", str(i + 1), unit, f"${3 * i}.50", f"${(i + 1) * (3 * i) + (i + 1) / 2:.2f}") for i in range(1, n + 1))
SIX = NUMBERED(6)
GERMAN = (("Pos", 43), ("Bezeichnung", 71), ("Menge", 326), ("Einheit", 377), ("Preis", 428), ("Gesamt", 502))
GERMAN_ROWS = tuple((str(i), f"Eichenbrett Klasse {i}", str(10 * i), "Stk", f"{i}.195,20 €", f"{i}1.952,00 €" if i == 1 else f"{i * i}1.952,00 €") for i in (1,)) + (("2", "Schrauben und Dübel", "4", "Pkg", "12,50 €", "50,00 €"), ("3", "Winkel verzinkt klein", "6", "Stk", "2,25 €", "13,50 €"))
WIDE = (("Description", 71), ("Qty", 250), ("Unit Price", 330), ("Disc", 400), ("Line Total", 502))

# name -> pages: pieces, or (pieces, images, drawings)
DOCUMENTS = {
    "clean": [page(after=(TOTAL("Total:", "$413.50"),))],
    "scan_between": [page(), ([], 1, 0), page(after=(TOTAL("Total", "$827.00"),))],
    "shapes": [([], 0, 3)],
    "blank": [page(), []],
    "garbled": [at(50, ("���", 10), ("ab", 100))],
    "sideways": [at(50, ("12", 10), ("13", 50), angle=90.0) + at(80, ("words", 10))],
    "all_sideways": [at(50, ("words", 10), ("more", 50), angle=90.0)],
    "stamp": [page() + at(300, ("PAID", 200), angle=45.0, size=36.0)],
    "few_words_on_a_picture": [(at(50, ("Scanned by", 10)), 1, 0)],
    "no_table": [at(50, ("Dear Sir", 10)) + at(70, ("All is well with the river.", 10))],
    "credit": [page(title="Acme - Returns Slip"), page(title="Credit Memo"), page()],
    "credit_label": [page(above=((("Credit note: 55", 43),),))],
    "summary": [page(title="Summary"), page(above=((("Summary: 9 crates packed", 43),),))],
    "mismatch": [page((ROWS[0], ("2", "Deck screws 10g box", "8", "box", "$22.25", "$187.00"), ROWS[2]))],
    "between": [page((("Pine batten long", "10", "$2.00", "50%", "$10.00"), ("Deck screws fine", "4", "$1.00", "x", "$4.00"), ("Nails for decks", "3", "$1.00", "x", "$3.00")), WIDE)],
    "unreadable": [page((ROWS[0], ("2", "Deck screws 10g box", "8", "box", "$12.50 box", "$178.00"), ROWS[2]))],
    "quantity_money": [page((ROWS[0], ("2", "Deck screws 10g box", "$8", "box", "$22.25", "$178.00"), ROWS[2]))],
    "nameless": [page((*ROWS, ("4", "", "6", "ea", "$3.00", "$18.00")))],
    "missing_total": [page((ROWS[0], ("2", "Deck screws 10g box", "8", "box", "$22.25", ""), ROWS[2]), after=(TOTAL("Total", "$413.50"),))],
    "per_unit": [page((("1", "Cement grey bagged", "4", "bag", "$14.40 /bag", "$57.60"), ("2", "Sand washed fine", "2", "m3", "$60.00", "$120.00")))],
    "wrong_total": [page(after=(TOTAL("Total", "$450.00"),))],
    "two_amounts": [page(after=(TOTAL("Total", "$413.50"), TOTAL("Total", "$413.60")))],
    "same_twice": [page(after=(TOTAL("Total", "$413.50"), TOTAL("Invoice total", "$413.50")))],
    "subtotal_and_tax": [page(after=(TOTAL("Subtotal", "$413.50"), TOTAL("GST 10%", "$41.35"), TOTAL("Total inc GST", "$454.85")))],
    "tax_without_subtotal": [page(after=(TOTAL("GST", "$41.35"), TOTAL("Total", "$454.85")))],
    "early_total": [page(after=(TOTAL("Total", "$413.50"),)), page()],
    "count_total": [page(after=(TOTAL("Total", "25"),))],
    "no_amount": [page(after=((("Total", 428),),))],
    "unreadable_total": [page(after=(TOTAL("Total", "12-50"),))],
    "unknown_label": [page(after=(TOTAL("Endbetrag:", "$413.50"),))],
    "unknown_wrong": [page(after=(TOTAL("Endbetrag:", "$400.00"),))],
    "one_piece_total": [page(after=((("Total: $413.50", 428),),))],
    "total_in_table": [page((*ROWS, ("", "", "", "", "", "")), after=()) + at(249, ("Total", 71), ("25", 326), ("$413.50", 502))],
    "running_total": [page((*SIX[:3], ("", "Timber so far here", "9", "", "", "$%.2f" % sum(float(r[5][1:]) for r in SIX[:3])), *SIX[3:]))],
    "rounding": [page((("1", "Pine batten long", "3", "ea", "$3.33", "$10.00"), ("2", "Deck screws fine", "2", "ea", "$5.00", "$10.00")), after=(TOTAL("Total", "$20.01"),))],
    "german": [page(GERMAN_ROWS, GERMAN)],
    "ambiguous": [page((("Pine batten long", "1.200"), ("Deck screws fine", "1.500")), (("Description", 71), ("Qty", 326))) + []],
    "ambiguous_three": [page((("a1", "Pine batten long", "1.200"), ("b2", "Deck screws fine", "1.500")), (("Code", 43), ("Description", 71), ("Qty", 326)))],
    "other_format": [page((ROWS[0], ("2", "Deck screws 10g box", "8", "box", "22,25", "$178.00"), ROWS[2], ("4", "Nails for decking", "2", "ea", "$1.10", "$2.20")))],
    "no_headings": [page(tuple(r for r in SIX), (("", 43), ("", 71), ("", 326), ("", 377), ("", 428), ("", 502)))],
    "strange_headings": [page(SIX, (("Pos", 43), ("Was", 71), ("Anz", 326), ("EH", 377), ("EP", 428), ("GP", 502)))],
    "same_role": [page((("Pine batten long", "2", "3", "$6.00"), ("Deck screws fine", "4", "5", "$9.00")), (("Description", 71), ("Qty", 326), ("Quantity", 380), ("Line Total", 502)))],
    "swapped": [page(tuple((r[1], r[2], r[4], r[5]) for r in SIX), (("Description", 71), ("Unit Price", 326), ("Qty", 428), ("Line Total", 502)))],
    "unknown_meaning": [page((("Pine batten long", "12.5", "ok"), ("Deck screws fine", "7.25", "no")), (("Description", 71), ("Weight", 326), ("State", 428)))],
    "two_meanings": [page(tuple((*r[:5], r[5]) for r in ROWS), (*HEADS[:4], ("Price or Total", 428), HEADS[5]))],
    "mixed_totals": [page((("1", "Pine batten long", "12", "600g total", "$15.50", "$186.00"), ("2", "Deck screws fine", "8", "20g", "$22.25", "$178.00")), (*HEADS[:3], ("Weight", 377), *HEADS[4:]))],
    "conflict": [page(above=((("8 crates packed on 12 May", 43),),), after=((("9 crates in docket", 43),), (("Docket no 55 crates", 43),), (("30 days", 43),)))],
    "same_line_conflict": [page(above=((("8 crates 9 crates", 43),),))],
    "wrapped": [page(ROWS[:1]) + at(208, ("treated H3 sawn", 71)) + at(232, *zip(ROWS[1], (x for _, x in HEADS))) + at(262, *zip(ROWS[2], (x for _, x in HEADS)))],
    "docket": [page(tuple((r[1], r[2], r[3]) for r in ROWS), (("Description", 43), ("Qty", 300), ("Unit", 360)))],
}
IDS = {name: i for i, name in enumerate(DOCUMENTS)}


@pytest.fixture(scope="module")
def plan(spark):
    pages, pieces = [], []
    for name, own in DOCUMENTS.items():
        for number, p in enumerate(own, 1):
            drawn, images, drawings = p if isinstance(p, tuple) else (p, 0, 0)
            pages.append((IDS[name], number, images, drawings))
            pieces += [(IDS[name], number, i, *piece) for i, piece in enumerate(drawn)]
    return DocumentPlan(spark.createDataFrame(pages, PAGES), spark.createDataFrame(pieces, PIECES))


@pytest.fixture(scope="module")
def found(plan):
    out = {}
    for name, frame in {"items": plan.line_items, "refusals": plan.refusals, "status": plan.page_status, "checks": plan.checks, "reports": plan.page_reports, "formats": plan.number_format}.items():
        by = {}
        for row in frame.collect():
            by.setdefault(row.doc_id, []).append(row)
        out[name] = lambda doc, by=by: by.get(IDS[doc], [])
    return out


STATUS = {
    "clean": ["extracted"], "scan_between": ["extracted", "refused", "extracted"], "shapes": ["refused"], "blank": ["extracted", "blank"], "garbled": ["refused"], "sideways": ["refused"], "all_sideways": ["refused"], "stamp": ["extracted"],
    "few_words_on_a_picture": ["refused"], "no_table": ["refused"], "credit": ["refused", "refused", "extracted"], "credit_label": ["refused"], "summary": ["extracted", "extracted"], "mismatch": ["partial"], "unreadable": ["partial"],
    "quantity_money": ["partial"], "nameless": ["partial"], "german": ["extracted"], "ambiguous_three": ["refused"], "other_format": ["partial"], "no_headings": ["extracted"], "strange_headings": ["extracted"], "same_role": ["refused"],
    "swapped": ["refused"], "unknown_meaning": ["partial"], "docket": ["extracted"], "ambiguous": ["refused"],
}


@pytest.mark.parametrize("name", STATUS)
def test_page_status(found, name):
    assert [r.status for r in sorted(found["status"](name), key=lambda r: r.page)] == STATUS[name]


CODES = {
    "clean": [], "shapes": ["p1-NO_TEXT_LAYER"], "garbled": ["p1-GARBLED_TEXT"], "sideways": ["p1-ROTATED_TEXT"], "all_sideways": ["p1-ROTATED_TEXT"], "few_words_on_a_picture": ["p1-NO_TEXT_LAYER"], "no_table": ["p1-NO_TABLE_FOUND"],
    "credit": ["p1-CREDIT_OR_RETURN_PAGE", "p2-CREDIT_OR_RETURN_PAGE"], "credit_label": ["p1-CREDIT_OR_RETURN_PAGE"], "mismatch": ["p1-r3-ARITHMETIC_MISMATCH"], "unreadable": ["p1-r3-UNPARSEABLE_NUMBER"], "quantity_money": ["p1-r3-UNPARSEABLE_NUMBER"],
    "nameless": ["p1-r5-NO_DESCRIPTION"], "other_format": ["p1-r3-UNPARSEABLE_NUMBER"], "same_role": ["p1-AMBIGUOUS_COLUMNS"], "swapped": ["p1-AMBIGUOUS_COLUMNS"], "unknown_meaning": ["p1-COLUMN_MEANING_UNKNOWN"],
    "ambiguous_three": ["p1-r2-AMBIGUOUS_NUMBER_FORMAT", "p1-r3-AMBIGUOUS_NUMBER_FORMAT"], "conflict": ["doc-CONFLICTING_FIGURES-crate"], "same_line_conflict": [], "wrong_total": ["totals-lines_vs_total"],
    "scan_between": ["p2-NO_TEXT_LAYER", "totals-lines_vs_total"], "two_amounts": ["totals-lines_vs_total"], "missing_total": ["totals-lines_vs_total"],
}


@pytest.mark.parametrize("name", CODES)
def test_refusals(found, name):
    assert [r.id for r in sorted(found["refusals"](name), key=lambda r: r.ord)] == CODES[name]


RULES = {
    "clean": ("lines_vs_total", "pass", "pass"), "wrong_total": ("lines_vs_total", "fail", "fail"), "two_amounts": ("lines_vs_total", "not_checked", "twoAmounts"), "same_twice": ("lines_vs_total", "pass", "pass"),
    "subtotal_and_tax": ("lines_vs_subtotal", "pass", "pass"), "tax_without_subtotal": ("lines_vs_total", "not_checked", "gstNoSubtotal"), "early_total": ("lines_vs_total", "not_checked", "earlyTotal"),
    "count_total": ("lines_vs_total", "not_checked", "totalLooksLikeCount"), "no_amount": ("lines_vs_total", "not_checked", "nothingStated"), "unreadable_total": ("lines_vs_total", "not_checked", "totalNotRead"),
    "unknown_label": ("lines_vs_total", "pass", "unknownUsed"), "unknown_wrong": ("lines_vs_total", "not_checked", "unknownFigure"), "one_piece_total": ("lines_vs_total", "pass", "pass"), "total_in_table": ("lines_vs_total", "pass", "pass"),
    "scan_between": ("lines_vs_total", "not_checked", "pageNotRead"), "missing_total": ("lines_vs_total", "not_checked", "missingLineTotal"), "rounding": ("lines_vs_total", "pass", "pass"), "docket": ("lines_vs_total", "not_checked", "nothingStated"),
}


@pytest.mark.parametrize("name", RULES)
def test_totals_rules(found, name):
    (check,) = found["checks"](name)
    assert (check.name, check.outcome, check.rule) == RULES[name]


def test_messages(found):
    said = lambda name: [r.message for r in sorted(found["refusals"](name), key=lambda r: r.ord)]
    assert said("wrong_total") == ["The lines on page 1 add up to $413.50 (calculated by us), but the total says $450.00. The difference is $36.50 (calculated by us)."]
    assert said("mismatch") == ["On page 1, 8 × $22.25 is $178.00 (calculated by us), but the document says $187.00. We can't tell which is right, so we left this line out."]
    assert said("between")[0].endswith("There is a 'Disc' column between the price and the total, which may explain the difference.")
    assert "'1.200' on page 1 could mean 1.2 or 1200" in said("ambiguous_three")[0]
    assert "different number format" in said("other_format")[0]
    assert said("same_role") == ["Page 1 has two columns that could be the quantity ('Qty' and 'Quantity'). We can't tell which is right, so we didn't read the lines on this page."]
    assert said("swapped")[0].startswith("On page 1, the numbers in the 'Qty' column look like unit prices, but its heading says quantity.")
    assert said("conflict") == ["The document says 8 crates in one place (page 1) and 9 crates in another (page 1). We can't tell which one is right."]
    assert said("two_amounts") == ["The document shows two different amounts for the total ($413.50 on page 1 and $413.60 on page 1), so we couldn't check it."]
    assert said("scan_between")[1] == "We couldn't check the total on page 3 because page 2 couldn't be read."
    assert said("missing_total") == ["We couldn't check the total on page 1 because a line on page 1 has no line total."]
    assert said("credit")[0] == "Page 1 is titled 'Returns Slip', so its amounts may be refunds or credits rather than sales. We didn't list them as normal items."
    assert said("nameless") == ["A row on page 1 has numbers but no description ('4 6 ea $3.00 $18.00'), so we didn't attach them to any line."]


def notes(found, name):
    return [n.code for r in sorted(found["reports"](name), key=lambda r: r.page) for n in r.notes]


def test_notes(found):
    assert "rotatedTextIgnored" in notes(found, "stamp")
    assert "blankPage" in notes(found, "blank")
    assert notes(found, "summary").count("summaryPage") == 1
    assert "totalNotMoney" in notes(found, "count_total")
    assert "totalLabelNoAmount" in notes(found, "no_amount")
    assert "totalAmountNotRead" in notes(found, "unreadable_total")
    assert "unknownLabelTotalUsed" in notes(found, "unknown_label")
    assert "unknownFigureNotPlaced" in notes(found, "unknown_wrong")
    assert "totalsRowSkipped" in notes(found, "running_total") and "totalsRowSkipped" in notes(found, "total_in_table")
    assert "noHeadings" in notes(found, "no_headings") and "unknownHeadings" in notes(found, "strange_headings")
    assert "headingTwoMeanings" in notes(found, "two_meanings")
    assert "mixedTotalWording" in notes(found, "mixed_totals")
    assert "columnNotRead" in notes(found, "unknown_meaning")


def test_items(found):
    one = found["items"]("clean")[0]
    assert (one.id, one.quantity, one.unit_price, one.line_total) in {("p1-r2", 12.0, 15.5, 186.0), ("p1-r3", 8.0, 22.25, 178.0), ("p1-r4", 5.0, 9.9, 49.5)}
    assert len(found["items"]("running_total")) == 6 and len(found["items"]("total_in_table")) == 3
    per = {f.role: f for i in found["items"]("per_unit") for f in i.fields if f.role == "unitPrice" and f.per}
    assert per["unitPrice"].per == "bag" and per["unitPrice"].raw == "$14.40 /bag"
    german = sorted(found["items"]("german"), key=lambda i: i.row)
    assert [i.line_total for i in german] == [11952.0, 50.0, 13.5] and german[0].unit_price == 1195.2
    assert found["items"]("missing_total") and any(i.missing == ["lineTotal"] for i in found["items"]("missing_total"))
    wrapped = sorted(found["items"]("wrapped"), key=lambda i: i.row)[0]
    assert wrapped.source_text == "1 Pine batten 45x19 12 length $15.50 $186.00\ntreated H3 sawn"
    unknown = found["items"]("unknown_meaning")
    assert unknown and all(i.quantity is None and {o.key for o in i.other_cells} >= {"weight"} for i in unknown)
    assert all(i.source_text[f.start : f.stop] == f.raw for name in DOCUMENTS for i in found["items"](name) for f in i.fields)


def test_number_formats(found):
    assert {name: tuple(found["formats"](name)[0])[1:] for name in ("clean", "german", "ambiguous_three")} == {"clean": (".", None, True), "german": (",", ".", True), "ambiguous_three": (None, None, False)}


def test_contract_holds(plan):
    assert {r.rule: r.violations for r in contract.violations(plan.page_reports, plan.line_items, plan.refusals, plan.checks).collect() if r.violations} == {}


def test_replies_are_whole_json(plan, found):
    replies = {r.doc_id: json.loads(r.json) for r in plan.replies.collect()}
    assert sorted(replies) == sorted(IDS.values())
    for name, i in IDS.items():
        reply = replies[i]
        assert reply["pageCount"] == len(DOCUMENTS[name]) and len(reply["items"]) == len(found["items"](name)) and len(reply["refusals"]) == len(found["refusals"](name))
        assert [x["id"] for x in reply["items"]] == [x["id"] for x in sorted(reply["items"], key=lambda x: (x["page"], x["row"]))]


def test_run_log_and_reply_sizes(plan):
    log = {r.doc_id: r for r in run_summary(plan).collect()}
    assert log[IDS["credit"]].refusal_codes == {"CREDIT_OR_RETURN_PAGE": 2} and log[IDS["clean"]].item_count == 3
    assert plan.replies.count() == len(DOCUMENTS)
    sizes = reply_sizes(plan.replies).collect()
    assert all(r.bytes > 0 and r.reply_bytes > r.bytes for r in sizes)


def test_pages_per_part(spark):
    sizes = [(1, p, b, 1000) for p, b in enumerate((100, 100, 500, 100), 1)] + [(2, 1, 900, 1000), (3, 1, 2000, 4000), (3, 2, 10, 4000)]
    found = {r.doc_id: r.parts for r in pages_per_part(spark.createDataFrame(sizes, "doc_id long, page int, bytes long, reply_bytes long"), 1000).collect()}

    def brute(own, reply, limit=1000):
        budget = limit * 0.9 - max(0, reply - sum(own))
        fits = [n for n in range(1, len(own)) if budget > 0 and all(sum(own[i : i + n]) <= budget for i in range(0, len(own), n))]
        return max(fits, default=None)

    assert found == {1: brute([100, 100, 500, 100], 1000), 2: None, 3: brute([2000, 10], 4000)}


def test_replies_over_the_limit_become_problems(plan):
    from folioframe.plans.reports import limited_replies

    whole = {r.doc_id: r for r in limited_replies(plan).collect()}
    assert set(whole) == set(IDS.values()) and {r.kind for r in whole.values()} == {"result"}
    sizes = {r.doc_id: len(r.json.encode()) for r in whole.values()}
    limit = sorted(sizes.values())[len(sizes) // 2]
    cut = {r.doc_id: r for r in limited_replies(plan, limit).collect()}
    assert set(cut) == set(sizes)
    for i, size in sizes.items():
        assert cut[i].kind == ("result" if size <= limit else "problem")
        if size > limit:
            problem = json.loads(cut[i].json)
            assert problem["code"] == "TOO_MANY_LINES" and problem["type"] == "/problems/too-many-lines" and "more lines than we can send back" in problem["detail"]


def test_a_failing_page_is_contained(spark):
    pieces = [(1, p, i, *piece) for p in (1, 2) for i, piece in enumerate(page())]
    pieces.append((1, 2, 99, "x", None, 50.0, 5.0, 9.0, 0.0))
    pages = spark.createDataFrame([(1, 1, 0, 0, None), (1, 2, 0, 0, None), (1, 3, 0, 0, "PAGE_LOAD_FAILED")], PAGES + ", code string")
    found = DocumentPlan(pages, spark.createDataFrame(pieces, PIECES))
    assert {r.page: r.status for r in found.page_status.collect()} == {1: "extracted", 2: "refused", 3: "refused"}
    assert sorted((r.page, r.code) for r in found.page_refusals.collect()) == [(2, "PAGE_LOAD_FAILED"), (3, "PAGE_LOAD_FAILED")]
    assert sorted((r.page, r.stage, r.cause, r.error_name) for r in found.diagnostics.collect()) == [(2, "layout", "error", "TypeError"), (3, "read", "error", None)]
    assert found.line_items.count() == 3


def test_replies_are_written_by_document(plan, tmp_path):
    from folioframe.plans.reports import write_replies

    write_replies(plan, str(tmp_path / "out"))
    folders = [d for d in (tmp_path / "out").iterdir() if d.name.startswith("doc_id=")]
    assert len(folders) == len(DOCUMENTS)
