"""Uploads, the small PDF reader, streams and the driver entry."""

import base64
import os
import random
import shutil
import subprocess
import sys
import zlib

import pytest
from folioframe.plans.document import DocumentPlan
from folioframe.sources import pdf, upload
from folioframe.streaming import incremental
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def make_pdf(pages, compress=True, extra=b""):
    """A PDF with one text command for each (text, x, y from the top)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    kids = []
    for i, page in enumerate(pages):
        body = b"BT /F1 9 Tf " + b" ".join(b"1 0 0 1 %g %g Tm (%s) Tj" % (x, 842 - y, t.replace("(", "\\(").replace(")", "\\)").encode("cp1252")) for t, x, y in page) + b" ET"
        data = zlib.compress(body) if compress else body
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compress else b"", data)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [ %s ] /Count %d >>" % (b" ".join(kids), len(pages))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"trailer << /Root 1 0 R " + extra + b" >>\n%%EOF"


HEADS = (("Item", 43), ("Description", 71), ("Qty", 326), ("Unit", 377), ("Unit Price", 428), ("Line Total", 502))
ROWS = (("1", "Pine batten 45x19", "12", "length", "$15.50", "$186.00"), ("2", "Deck screws (10g) box", "8", "box", "$22.25", "$178.00"))
PAGE = [("Quote", 43, 77)] + [(h, x, 176) for h, x in HEADS] + [(t, x, 198 + 17 * i) for i, r in enumerate(ROWS) for t, (_, x) in zip(r, HEADS)]


def test_files_become_items(spark, tmp_path):
    files = {"a.pdf": make_pdf([PAGE, PAGE]), "b.pdf": make_pdf([PAGE], compress=False), "locked.pdf": make_pdf([PAGE], extra=b"/Encrypt 9 0 R"), "broken.pdf": b"%PDF-1.4\nnothing", "text.pdf": b"hello", "empty.pdf": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    uploads = upload.read_uploads(spark, str(tmp_path)).withColumn("code", upload.upload_code(F.col("content"))).withColumn("message", upload.upload_message(F.col("content"), F.col("file_name")))
    codes = {r.file_name: r.code for r in uploads.collect()}
    assert codes == {"a.pdf": None, "b.pdf": None, "locked.pdf": None, "broken.pdf": None, "text.pdf": "NOT_A_PDF", "empty.pdf": "EMPTY_FILE"}
    accepted = uploads.filter("code is null")
    pages, pieces = pdf.read_files(accepted)
    found = {(r.doc_id.rsplit("/", 1)[1], r.page): r.code for r in pages.collect()}
    assert found == {("a.pdf", 1): None, ("a.pdf", 2): None, ("b.pdf", 1): None, ("locked.pdf", 0): "ENCRYPTED", ("broken.pdf", 0): "CORRUPT_FILE"}
    plan = DocumentPlan(pages.filter("page > 0").drop("code"), pieces)
    items = plan.line_items.collect()
    assert sorted((i.doc_id.rsplit("/", 1)[1], i.page, i.line_total) for i in items) == [("a.pdf", 1, 178.0), ("a.pdf", 1, 186.0), ("a.pdf", 2, 178.0), ("a.pdf", 2, 186.0), ("b.pdf", 1, 178.0), ("b.pdf", 1, 186.0)]
    problems = upload.problems(uploads.filter("code is not null")).collect()
    assert len(problems) == 2 and all('"kind":"problem"' in p.problem and "/problems/" in p.problem for p in problems)


def test_places_sizes_and_turns():
    file, pages = pdf.open_file(make_pdf([[("Hi (there)", 50, 100)]]))
    (piece,) = pdf.read_page(file, pages[0]).pieces
    assert piece[1:4] == ("Hi (there)", 50.0, 100.0) and piece[5] == 9.0 and piece[6] == 0.0


def lzw(data):
    """Codes of 9 to 12 bits that name the longest known text, the table filled as a reader does."""
    table, width, bits = {bytes([i]): i for i in range(256)}, 9, format(256, "09b")
    size, own = 258, b""
    for b in data:
        longer = own + bytes([b])
        if longer in table:
            own = longer
            continue
        bits += format(table[own], f"0{width}b")
        if size < 4096:
            table[longer] = size
            size += 1
        width = min(12, max(9, size.bit_length()))
        own = bytes([b])
    bits += format(table[own], f"0{width}b") + format(257, f"0{min(12, max(9, (size + 1).bit_length()))}b")
    return bytes(int((bits + "0" * (-len(bits) % 8))[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_filters_give_back_the_data():
    data = bytes(random.Random(5).choices(b"abcab \n()xyz", k=30_000)) + bytes(range(256))
    assert pdf.unfiltered("LZWDecode", lzw(data), {}) == data
    assert pdf.unfiltered("ASCII85Decode", b"<~" + base64.a85encode(data, wrapcol=70) + b"~>", {}) == data
    assert pdf.unfiltered("ASCIIHexDecode", data.hex(" ").encode() + b">", {}) == data
    assert pdf.unfiltered("ASCIIHexDecode", b"417>", {}) == b"Ap"
    assert pdf.unfiltered("RunLengthDecode", bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"rest", {}) == b"abcxxx"
    assert pdf.unfiltered("FlateDecode", zlib.compress(data), {"Predictor": 1}) == data
    with pytest.raises(pdf.Damaged):
        pdf.unfiltered("DCTDecode", data, {})


def test_every_row_prediction_is_undone():
    """Rows predicted from the left, above, both and the nearest of three, with three bytes a pixel."""
    rng, step = random.Random(3), 3
    rows = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(10)]
    coded, before = b"", bytes(12)
    for n, row in enumerate(rows):
        kind, line = n % 5, []
        for i, v in enumerate(row):
            a, b, c = (row[i - step], before[i], before[i - step]) if i >= step else (0, before[i], 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        coded += bytes([kind, *line])
        before = row
    assert pdf.unpredicted(coded, {"Predictor": 15, "Columns": 4, "Colors": 3}) == b"".join(rows)


def test_forms_and_inline_pictures():
    """A form draws through its matrix; a form that draws itself refuses the page; bytes of a picture are no operators."""
    form = b"30 0 obj\n<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 -20] /Length 46 >>\nstream\nBT /F1 9 Tf 1 0 0 1 5 700 Tm (in a form) Tj ET  \nendstream\nendobj\n"
    data = make_pdf([[("Hi", 50, 100)]], compress=False).replace(b"ET\nendstream", b"ET BI /W 1 /H 1 ID (\x01 EI /Fm Do\nendstream").replace(b"/F1 3 0 R >> >>", b"/F1 3 0 R >> /XObject << /Fm 30 0 R >> >>").replace(b"trailer", form + b"trailer")
    file, pages = pdf.open_file(data)
    page = pdf.read_page(file, pages[0])
    assert [p[1:4] for p in page.pieces] == [("Hi", 50.0, 100.0), ("in a form", 105.0, 842.0 - 680.0)] and page.images == 1
    loop = data.replace(b"(in a form) Tj ET  ", b"(in) Tj ET /Fm Do  ")
    file, pages = pdf.open_file(loop)
    with pytest.raises(pdf.Damaged):
        pdf.read_page(file, pages[0])


def test_damaged_pages_are_contained():
    data = make_pdf([PAGE, PAGE]).replace(b"/Contents 11 0 R", b"/Contents 99 0 R")
    file, pages = pdf.open_file(data)
    assert pdf.read_page(file, pages[0]).pieces == [] and len(pdf.read_page(file, pages[1]).pieces) == len(PAGE)


def test_upload_limits(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"x" * 50)), (4, bytearray(b"a%PDF-")), (5, bytearray(b"x" * 1020 + b"%PDF-")), (6, bytearray(b"x" * 1019 + b"%PDF-"))], "i int, c binary")
    assert {r.i: r.code for r in rows.select("i", upload.upload_code(F.col("c"), 2000).alias("code")).collect()} == {1: "NO_FILE", 2: "EMPTY_FILE", 3: "NOT_A_PDF", 4: None, 5: "NOT_A_PDF", 6: None}
    assert rows.filter("i = 3").select(upload.upload_code(F.col("c"), 49).alias("code")).first().code == "FILE_TOO_LARGE"
    message = rows.filter("i = 3").select(upload.upload_message(F.col("c"), F.lit("A.PDF"), 2000).alias("m")).first().m
    assert message.startswith("This file isn't a PDF, even though its name ends in .pdf.")


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    drawn = [(d, p, i, t, float(x), float(y), len(t) * 4.5, 9.0, 0.0) for d in range(6) for p in (1, 2) for i, (t, x, y) in enumerate(PAGE)]
    pieces = spark.createDataFrame(drawn, "doc_id long, page int, ord int, str string, x double, y double, width double, font_size double, angle double")
    pages = pieces.select("doc_id", "page").distinct().withColumn("image_count", F.lit(0)).withColumn("drawing_count", F.lit(0))
    incremental.arrivals_of(pages, pieces).repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    found = incremental.process(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), files_per_batch=1)
    batch = DocumentPlan(pages, pieces).line_items
    key = lambda df: sorted((r.doc_id, r.id, r.line_total) for r in df.collect())
    assert key(found) == key(batch) and len(key(batch)) == 24


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """The entry imports, and its other queries are there, when the llm folders and the pipeline are gone."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'line_items' in q and set(o) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_the_rest_stands_where_the_subpackage_cannot_be_imported(tmp_path):
    """A folder left without its files, and operators whose dependency is missing, leave the other queries alone."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'line_items' in q and set(o) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    left = tmp_path / "left"
    shutil.copytree(ROOT, left, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    (left / "folioframe" / "llm" / "__pycache__").mkdir(parents=True)
    missing = tmp_path / "missing"
    shutil.copytree(ROOT, missing, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    (missing / "folioframe" / "llm").mkdir()
    for name in ("__init__.py", "catalogue.py"):
        (missing / "folioframe" / "llm" / name).write_text("import a_module_that_is_not_installed\n")
    for folder in (left, missing):
        run = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)
        assert run.returncode == 0, run.stderr


def test_stages_are_swept(spark, tmp_path):
    from folioframe.plans.store import shared_dir, sweep, written

    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "folioframe", spark.sparkContext.applicationId)
    assert written(spark.range(3), "three").count() == 3 and os.path.isdir(folder)
    sweep(spark)
    assert not os.path.exists(folder)


def test_drawn_pieces_deal_out_the_lines_once(spark, tmp_path):
    from folioframe.sources import virtual

    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(o, 7, 1, n, 2.0, 10.0 + n, 0.0, 0.0, None) for o in (9, 11, 16) for n in range(1, 8)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    pages, pieces = virtual.virtual_documents(spark, str(tmp_path))
    assert pieces._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    counted = {tuple(r) for r in pieces.groupBy("doc_id", "page").count().collect()}
    assert counted == {(11, 1, 1 + 6 + 1 + 36), (11, 2, 1 + 6 + 2 + 6), (16, 1, 1 + 6 + 36), (16, 2, 1 + 6 + 6 + 2)}
    assert {tuple(r) for r in pages.select("doc_id", "page", "image_count").collect()} == {(o, p, int(o == 9)) for o in (9, 11, 16) for p in (1, 2)}
