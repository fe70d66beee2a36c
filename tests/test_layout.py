"""Rows, cells and tables from hand-made pieces: (text, x, y, width, font size)."""

import random

import pytest
from folioframe.operators import layout as L

COLUMNS = (("Item", 43), ("Description", 71), ("Qty", 326), ("Unit", 377), ("Unit Price", 428), ("Line Total", 502))
ROWS = (("1", "Pine batten 45x19", "12", "length", "$15.50", "$186.00"), ("2", "Deck screws 10g box", "8", "box", "$22.25", "$178.00"), ("3", "Joist hanger 90mm", "5", "ea", "$9.90", "$49.50"))


def piece(text, x, y, size=9.0):
    return (text, float(x), float(y), len(text) * size / 2, size)


def line(y, *cells):
    return [piece(t, x, y) for t, x in cells]


def table(rows=ROWS, columns=COLUMNS, head=176, first=198, pitch=17):
    out = line(head, *columns) if head else []
    for i, row in enumerate(rows):
        out += [piece(t, x, first + pitch * i) for t, (_, x) in zip(row, columns) if t]
    return out


def read(pieces):
    return L.page_layout(L.lines_of(pieces))


def cells(found):
    return [[c["text"] for c in row["cells"]] for row in found["body"]]


def test_lines_share_a_baseline_within_a_third_of_the_font():
    found = L.lines_of([piece("a", 0, 10), piece("b", 50, 13), piece("c", 100, 13.3), piece("d", 10, 30)])
    assert [x.text for x in found] == ["a b", "c", "d"]
    assert [x.row for x in found] == [0, 1, 2]


def test_pieces_merge_by_their_gaps():
    found = L.cells_of([("Deck", 0, 20, 10), ("screws", 22, 30, 10), ("x", 52.5, 5, 10), (" y", 58, 5, 10), ("far", 100, 15, 10)])
    assert [c.text for c in found] == ["Deck screwsx y", "far"]
    assert found[0].joins == [4, 12]


def test_lines_of_text_hold_their_cells():
    found = L.lines_of(line(10, ("1", 43), ("Pine", 71)) + line(20, ("---", 0), ("====", 50)))
    assert [x.text for x in found] == ["1 Pine"]
    assert all(x.text[c.start : c.stop] == c.text for x in found for c in x.cells)


def test_a_plain_table():
    found = read([piece("Quote 12", 43, 77), *table(), piece("Total:", 428, 266), piece("$413.50", 502, 266)])
    assert [c["header"] for c in found["columns"]] == [h for h, _ in COLUMNS]
    assert [c["kind"] for c in found["columns"]] == ["numeric", "text", "numeric", "text", "numeric", "numeric"]
    assert cells(found) == [list(r) for r in ROWS]
    assert (found["above"], found["header_rows"], found["below"], found["others"]) == ([0], [1], [5], [])


def test_empty_cells_keep_their_columns():
    rows = (ROWS[0], ("2", "", "8", "box", "$22.25", "$178.00"), ROWS[2])
    assert [[c["position"] for c in r["cells"]] for r in read(table(rows))["body"]] == [[0, 1, 2, 3, 4, 5], [0, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5]]


def test_wrapped_descriptions_belong_to_their_row():
    found = read(table((ROWS[0],)) + line(208, ("treated H3", 71)) + table(ROWS[1:], head=0, first=228, pitch=30))
    assert [r["more"] for r in found["body"]] == [[2], [], []]


def test_a_heading_in_two_lines():
    columns = tuple((h if h != "Unit Price" else "Price", x) for h, x in COLUMNS)
    found = read(line(166, ("Unit", 428)) + table(columns=columns))
    assert found["columns"][4]["header"] == "Unit Price" and found["header_rows"] == [0, 1]


def test_two_rows_without_a_heading_are_a_table_and_one_is_none():
    assert len(read(table(ROWS[:2], head=0))["body"]) == 2
    assert read(table(ROWS[:1], head=0))["columns"] is None


def test_two_columns_are_no_table():
    assert read(line(10, ("Name", 43), ("Pine", 100)) + line(30, ("Weight", 43), ("12", 100)))["columns"] is None


def test_section_headings_and_short_lines_stay_in_the_table():
    body = table(ROWS[:1]) + line(230, ("Second floor", 71)) + table(ROWS[1:], head=0, first=250)
    assert [(n["code"], n["text"]) for n in read(body)["notes"]] == [("sectionHeading", "Second floor")]
    assert len(read(body)["body"]) == 3
    short = table(ROWS[:2]) + line(232, ("Discount", 71), ("-$5.00", 502)) + table(ROWS[2:], head=0, first=249)
    found = read(short)
    assert [n["code"] for n in found["notes"]] == ["shortLineInTable"] and len(found["body"]) == 3


def test_carried_totals_are_set_aside():
    found = read(line(150, ("Carried forward", 71), ("$100.00", 502)) + table())
    assert [n["code"] for n in found["notes"]] == ["carriedForwardSkipped"] and found["above"] == [] and len(found["body"]) == 3


def test_another_table_is_passed_over_with_a_note():
    other = table((("a", "1", "2"), ("b", "3", "4")), columns=(("Name", 43), ("Length", 200), ("Width", 300)), head=20, first=40)
    found = read(other + table())
    assert [n["code"] for n in found["notes"]] == ["otherTableNotRead"]
    assert len(found["body"]) == 3 and found["others"] == [0, 1, 2]


def test_a_totals_box_gives_no_note():
    box = [p for i, (label, amount) in enumerate((("Subtotal", "$413.50"), ("GST 10%", "$41.35"), ("Total", "$454.85"))) for p in line(300 + 14 * i, (label, 300), ("AUD", 380), (amount, 502))]
    assert read(table() + box)["notes"] == []


def test_joined_numbers_lose_their_grouping_spaces():
    rows = tuple((str(i), f"thing {i}", f"{i}", "ea", f"{i}0.00", f"{i}00.00") for i in range(1, 6))
    pieces = table(rows) + [piece("6", 43, 283), piece("thing 6", 71, 283), piece("6", 326, 283), piece("ea", 377, 283), ("12 345.00", 428.0, 283.0, 95.0, 9.0)]
    last = read(pieces)["body"][-1]["cells"][-1]
    assert last["joins"] == [2]


def test_random_heights_give_the_same_table():
    expected = cells(read(table()))
    for seed in range(20):
        rng = random.Random(seed)
        assert cells(read([(t, x, y + rng.uniform(-1.5, 1.5) * 0.9, w, s) for t, x, y, w, s in table()])) == expected


def test_order_of_pieces_does_not_matter():
    expected = read(table())
    for seed in range(10):
        pieces = table()
        random.Random(seed).shuffle(pieces)
        assert read(pieces) == expected


def test_large_pages_are_quick():
    import time

    rows = [[str(100 + i + k) for k in range(25)] for i in range(400)]
    columns = tuple((f"H{k}", 20 + 40 * k) for k in range(25))
    began = time.time()
    assert len(read(table(rows, columns))["body"]) == 400
    assert time.time() - began < 10


def test_nothing_at_all():
    assert L.lines_of([]) == [] and read([])["columns"] is None


def test_pages_meet_whatever_the_batches(spark):
    from pyspark.sql import functions as F

    rows = [(d, p, i, *piece_) for d in range(7) for p in (1, 2) for i, piece_ in enumerate(table(ROWS[: 1 + d % 3]))]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ord int, str string, x double, y double, width double, font_size double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = L.lay_out(frame).select("doc_id", "page", F.size("body").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted((d, p, 1 + d % 3) for d in range(7) for p in (1, 2))
    assert L.lay_out(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text,shape", [("é" * 50000, "TEXT"), ("12 " * 3000, "NUM")])
def test_long_texts(text, shape):
    assert L.shape_of(text) == shape


def test_a_page_that_takes_too_long_is_refused():
    """The clock moves a second a reading; a page within its time is the same with and without a limit."""
    pieces = [(f"w{i}", 10.0 + 40 * (i % 4), 50.0 + 17 * (i // 4), 20.0, 9.0) for i in range(40)]
    clock = iter(range(10_000))
    late = L.contained_layout(pieces, 8.0, lambda: next(clock))
    assert late["problem"] == "Overtime: over 8 seconds" and late["lines"] == [] and late["columns"] is None
    clock = iter(range(10_000))
    assert L.contained_layout(pieces, 9_000.0, lambda: next(clock)) == L.page_layout(L.lines_of(pieces))


def test_a_page_is_read_whole_when_spark_splits_skewed_joins(spark):
    """After a join on the page Spark drops a repartition by page and may deal out the join's sides in parts."""
    from folioframe.plans.document import DocumentPlan
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01",
    }
    rows = [(d, 1, i, *piece_, 0.0) for d in range(60) for i, piece_ in enumerate(table(ROWS[:1] * (3 if d else 800)))]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ord int, str string, x double, y double, width double, font_size double, angle double").repartition(8)
    pages = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("image_count"), F.lit(0).alias("drawing_count"))
    pieces = frame.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = [[tuple(r) for r in layouts.select("doc_id", "page", F.size("lines"), F.size("body")).collect()] for layouts in (L.lay_out(pieces), DocumentPlan(pages, pieces).layouts)]
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = [(d, 1, 4 if d else 801, 3 if d else 800) for d in range(60)]
    assert [sorted(f) for f in found] == [expected, expected]
