"""Documents drawn from order lines: positioned text whose right reading is known from the tables.

An order is a document, six lines to a page, in one of sixteen variants by
its number: clean ones and ones with a single thing that a reader must
notice. The drawing is a projection of ``lineitem``, so SQL over the same
table says what an operator must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_PER_PAGE = 6
HEADINGS = (("Item", 43), ("Description", 71), ("Qty", 326), ("Unit", 377), ("Unit Price", 428), ("Line Total", 502))
(CLEAN, UNTOTALLED, EXACT, MISMATCH, NAMELESS, UNREADABLE, CREDIT, SUMMARY, GERMAN, SCAN, STAMPED, CONFLICT, WRONG_TOTAL, DOCKET, PLAIN, CARRIED) = range(16)

def order_lines(lineitem: DataFrame) -> DataFrame:
    """doc_id, line_no, page, place on the page, variant, quantity, price and total (cents), part."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    lines = lineitem.withColumnRenamed("l_orderkey", "doc_id").select(
        "doc_id",
        F.row_number().over(order).alias("line_no"),
        (F.col("doc_id") % 16).cast("int").alias("variant"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("paid"),
        F.col("l_partkey").alias("part"),
    )
    price = F.floor((2 * F.col("paid") + F.col("quantity")) / (2 * F.col("quantity"))).cast("long")
    priced = lines.withColumn("price", price)
    total = F.when(F.col("variant") == EXACT, F.col("price") * F.col("quantity")).when((F.col("variant") == MISMATCH) & (F.col("line_no") == 1), F.col("paid") + 100 * F.col("quantity")).otherwise(F.col("paid"))
    zero = F.col("line_no") - 1
    return priced.withColumn("total", total).withColumn("page", F.floor(zero / LINES_PER_PAGE).cast("int") + 1).withColumn("place", (zero % LINES_PER_PAGE).cast("int"))


def money(cents: Column, variant: Column) -> Column:
    whole, rest = F.format_number(F.floor(cents / 100), 0), F.lpad((cents % 100).cast("string"), 2, "0")
    english = F.concat(F.lit("$"), whole, F.lit("."), rest)
    german = F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), rest, F.lit(" €"))
    return F.when(variant == GERMAN, german).otherwise(english)


def _piece(text: Column, x: float, y: Column, ord_: Column, size: float = 9.0, angle: float = 0.0) -> Column:
    return F.struct(
        ord_.cast("int").alias("ord"),
        text.cast("string").alias("str"),
        F.lit(float(x)).alias("x"),
        y.cast("double").alias("y"),
        (F.length(text) * F.lit(4.5 * size / 9)).alias("width"),
        F.lit(size).alias("font_size"),
        F.lit(angle).alias("angle"),
    )


def pieces_of(lines: DataFrame) -> DataFrame:
    """doc_id, page, ord, str, x, y, width, font_size, angle of every drawn text.

    What a page says besides its lines goes with its first one, and windows over
    the order say what it needs, so lines are dealt out once.
    """
    v, y = F.col("variant"), F.lit(198) + 17 * F.col("place")
    first = F.col("line_no") == 1
    named = ~((v == NAMELESS) & first)
    priced = v != DOCKET
    at = lambda k: 100 + 10 * F.col("place") + k
    price = F.when((v == UNREADABLE) & first, F.lit("$12.50 box")).otherwise(money(F.col("price"), v))
    cells = [
        F.when(v != DOCKET, _piece(F.col("line_no").cast("string"), 43, y, at(0))),
        F.when(named, _piece(F.concat(F.lit("Oak board grade "), F.col("part").cast("string")), 71, y, at(1))),
        _piece(F.col("quantity").cast("string"), 326, y, at(2)),
        _piece(F.when(F.col("part") % 2 == 0, "ea").otherwise("box"), 377, y, at(3)),
        F.when(priced, _piece(price, 428, y, at(4))),
        F.when(priced, _piece(money(F.col("total"), v), 502, y, at(5))),
    ]
    order = Window.partitionBy("doc_id")
    whole = lines.filter(v != SCAN).withColumn("sum", F.sum("total").over(order)).withColumn("upto", F.max("line_no").over(order))
    pages = F.floor((F.col("upto") - 1) / LINES_PER_PAGE).cast("int") + 1
    is_last = F.col("page") == pages
    below = F.lit(198 + 34) + 17 * F.when(is_last, (F.col("upto") - 1) % LINES_PER_PAGE).otherwise(LINES_PER_PAGE - 1)
    title = F.when(v == CREDIT, "Credit Memo").when(v == SUMMARY, "Summary").otherwise(F.concat(F.lit("Quote "), F.col("doc_id").cast("string")))
    amount = F.when(v == WRONG_TOTAL, F.col("sum") + 3650).otherwise(F.col("sum"))
    labelled = F.when(v == EXACT, "Subtotal:").when(v.isin(CLEAN, WRONG_TOTAL, CARRIED, MISMATCH, NAMELESS), "Total:").when(v == GERMAN, "Endbetrag:")
    extra = [
        _piece(title, 43, F.lit(77.0), F.lit(1)),
        *(F.when(~F.lit(text in ("Item", "Unit Price", "Line Total")) | (v != DOCKET), _piece(F.lit(text), x, F.lit(176.0), F.lit(10 + k))) for k, (text, x) in enumerate(HEADINGS)),
        F.when(v == STAMPED, _piece(F.lit("PAID"), 300, F.lit(120.0), F.lit(30), 36.0, 45.0)),
        F.when(v == CONFLICT, _piece(F.lit("8 crates packed"), 43, F.lit(110.0), F.lit(31))),
        F.when((v == CONFLICT) & is_last, _piece(F.concat((F.lit(9) + pages - 1).cast("string"), F.lit(" crates delivered")), 43, below + 60, F.lit(90000))),
        F.when((v == CARRIED) & (F.col("page") > 1), _piece(F.lit("Carried forward"), 71, F.lit(150.0), F.lit(32))),
        F.when((v == CARRIED) & (F.col("page") > 1), _piece(F.lit("$100.00"), 502, F.lit(150.0), F.lit(33))),
        F.when(is_last & labelled.isNotNull(), _piece(labelled, 428, below, F.lit(90001))),
        F.when(is_last & labelled.isNotNull(), _piece(money(amount, v), 502, below, F.lit(90002))),
    ]
    drawn = F.when(F.col("place") == 0, F.array(*cells, *extra)).otherwise(F.array(*cells))
    return whole.select("doc_id", "page", F.explode(F.filter(drawn, lambda c: c.isNotNull())).alias("p")).select("doc_id", "page", "p.*")


def pages_of(lines: DataFrame) -> DataFrame:
    """doc_id, page, image_count and drawing_count; scanned documents have a picture on each page."""
    return lines.filter("place = 0").select("doc_id", "page", (F.col("variant") == SCAN).cast("int").alias("image_count"), F.lit(0).alias("drawing_count"))


def virtual_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, pieces) drawn from the order lines of a folder."""
    lines = order_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return pages_of(lines), pieces_of(lines)
