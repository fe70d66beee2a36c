"""Queries over documents with faults, and over texts drawn to reach every branch of a rule.

The documents come from customers (``sources.faults``); the SQL says from the
customer's number which of the thirty variants is drawn and what must come of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as T
from .operators import contract, evidence
from .plans import reports
from .plans.document import DocumentPlan, within_page_limit
from .registry import query
from .sources.faults import faulty_documents

_PLANS: dict[tuple[str, str], DocumentPlan] = {}


def forget() -> None:
    _PLANS.clear()


def plan(spark: SparkSession, sf_dir: str) -> DocumentPlan:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS[key] = DocumentPlan(*faulty_documents(spark, sf_dir))
    return _PLANS[key]


DRAWN = """
WITH base AS (SELECT c_custkey AS doc_id, CAST(c_custkey % 30 AS INT) AS variant, c_custkey AS k FROM customer),
sheets AS (SELECT *, unnest(CASE WHEN variant = 20 THEN [1, 2] ELSE [1] END) AS page FROM base),
names AS (SELECT * FROM (VALUES (1, 'Pine batten long'), (2, 'Deck screws fine'), (3, 'Joist hanger wide'), (4, 'Cement grey bagged'), (5, 'Sand washed fine'), (6, 'Nails for decking')) AS t(i, name)),
amounts AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'ea' ELSE 'box' END AS unit, i * i + 1 + k % 5 AS qty, 250 * i + 5 + 10 * (k % 40) AS price FROM base, names),
rows AS (
    SELECT *, qty * price AS total, '$' || price // 100 || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') AS price_text,
           '$' || qty * price // 100 || '.' || lpad(CAST(qty * price % 100 AS VARCHAR), 2, '0') AS total_text
    FROM amounts
), sums AS (
    SELECT doc_id, CAST(sum(qty) AS BIGINT) AS counted, '$' || CAST(sum(total) AS BIGINT) // 100 || '.' || lpad(CAST(CAST(sum(total) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS three,
           '$' || CAST(sum(total) + 10 AS BIGINT) // 100 || '.' || lpad(CAST(CAST(sum(total) + 10 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS over
    FROM rows WHERE i <= 3 GROUP BY doc_id
), listed AS (
    SELECT rows.*, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS line,
           CASE variant WHEN 10 THEN name || ' ' || (10 * i + k % 7) || '.5 ' || CASE WHEN i % 2 = 0 THEN 'ok' ELSE 'no' END
                WHEN 29 THEN concat_ws(' ', name, qty, price_text, total_text, 'see', i, 'see', i)
                ELSE concat_ws(' ', i, name, qty, unit, price_text, CASE WHEN variant <> 25 OR i <> 2 THEN total_text END) END
             || CASE WHEN variant = 12 AND i = 1 THEN chr(10) || 'treated H3 sawn' ELSE '' END AS source_text
    FROM rows JOIN sheets USING (doc_id, variant, k)
    WHERE variant NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 27) AND i <= CASE WHEN variant IN (11, 22, 23) THEN 6 WHEN variant = 21 THEN 4 ELSE 3 END AND NOT (variant = 21 AND i = 2)
)
"""


@query(
    DRAWN
    + """
SELECT doc_id, page, CASE WHEN variant = 6 THEN 'blank' WHEN variant IN (1, 2, 3, 4, 5, 7, 8, 9, 27) THEN 'refused' WHEN variant IN (10, 21) THEN 'partial' ELSE 'extracted' END AS status, coalesce(n, 0) AS item_count
FROM sheets LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM listed GROUP BY doc_id, page) USING (doc_id, page)
"""
)
def fault_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).page_status.select("doc_id", "page", "status", "item_count")


@query(
    DRAWN
    + """
SELECT doc_id, page, line, source_text, CASE WHEN variant <> 10 THEN CAST(qty AS DOUBLE) END AS quantity, CASE WHEN variant <> 10 THEN price / 100.0 END AS unit_price,
       CASE WHEN variant <> 10 AND (variant <> 25 OR i <> 2) THEN total / 100.0 END AS line_total, CASE WHEN variant = 25 AND i = 2 THEN 'lineTotal' ELSE '' END AS missing
FROM listed
"""
)
def fault_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row")).cast("long")
    return plan(spark, sf_dir).line_items.select("doc_id", "page", line.alias("line"), "source_text", "quantity", "unit_price", "line_total", F.array_join("missing", "|").alias("missing"))


@query(
    DRAWN
    + """
SELECT doc_id, 'doc-NO_LINE_ITEMS_FOUND' AS id, 'We read every page but found no table of line items.' AS message FROM base WHERE variant = 6
UNION ALL SELECT doc_id, 'p1-' || CASE WHEN variant = 1 THEN 'GARBLED_TEXT' WHEN variant IN (2, 3) THEN 'ROTATED_TEXT' WHEN variant = 4 THEN 'NO_TABLE_FOUND' WHEN variant IN (5, 27) THEN 'NO_TEXT_LAYER' WHEN variant = 10 THEN 'COLUMN_MEANING_UNKNOWN' ELSE 'AMBIGUOUS_COLUMNS' END,
       CASE variant WHEN 1 THEN 'The text on page 1 turned into random symbols when we read it, so we didn''t use any of it.'
            WHEN 2 THEN 'Most of the numbers on page 1 are printed sideways, so we could misread which column they belong to. We skipped the page.'
            WHEN 3 THEN 'All the text on page 1 is printed sideways, so we skipped the page.'
            WHEN 4 THEN 'Page 1 has text, but we couldn''t find a table of line items on it.'
            WHEN 5 THEN 'Page 1 has drawings but no text we can read. The text may have been saved as shapes. We don''t read drawings, so nothing on it was extracted.'
            WHEN 8 THEN 'Page 1 has two columns that could be the quantity (''Qty'' and ''Quantity''). We can''t tell which is right, so we didn''t read the lines on this page.'
            WHEN 9 THEN 'On page 1, the numbers in the ''Unit Price'' column look like quantities, but its heading says unit price. We can''t tell which is right, so we didn''t read the lines on this page.'
            WHEN 10 THEN 'We found a table on page 1, but we couldn''t tell which column is the quantity, the price or the total. So we didn''t read any numbers from it. Its rows are shown as printed.'
            ELSE 'Page 1 is mostly a scanned picture. Only a few words on it can be read as text. We don''t read scans, so nothing on it was extracted.' END
FROM base WHERE variant IN (1, 2, 3, 4, 5, 8, 9, 10, 27)
UNION ALL SELECT doc_id, 'p1-r' || (i + 1) || '-AMBIGUOUS_NUMBER_FORMAT', '''' || i || '.' || d || ''' on page 1 could mean ' || i || '.' || d || ' or ' || i || d || ', and nothing else in the document shows which one is right, so that line was left out.'
FROM (SELECT doc_id, i, 111 + 2 * (k % 400) AS d FROM base, names WHERE variant = 7 AND i <= 2)
UNION ALL SELECT doc_id, 'p1-r3-UNPARSEABLE_NUMBER', '''' || price // 100 || ',' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') || ''' on page 1 is written in a different number format from the other numbers on that page, so we can''t be sure what it means. That line was left out.'
FROM rows WHERE variant = 21 AND i = 2
UNION ALL SELECT doc_id, 'totals-lines_vs_total', CASE variant WHEN 13 THEN 'The document shows two different amounts for the total (' || three || ' on page 1 and ' || over || ' on page 1), so we couldn''t check it.' ELSE 'We couldn''t check the total on page 1 because a line on page 1 has no line total.' END
FROM base JOIN sums USING (doc_id) WHERE variant IN (13, 25)
"""
)
def fault_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).refusals.select("doc_id", "id", "message")


@query(
    DRAWN
    + """
SELECT doc_id, CASE WHEN variant IN (0, 17) THEN 'pass' ELSE 'not_checked' END AS outcome,
       CASE variant WHEN 0 THEN 'pass' WHEN 17 THEN 'pass' WHEN 11 THEN 'unknownFigure' WHEN 13 THEN 'twoAmounts' WHEN 14 THEN 'totalLooksLikeCount' WHEN 15 THEN 'totalNotRead' WHEN 16 THEN 'unknownFigure'
            WHEN 19 THEN 'gstNoSubtotal' WHEN 20 THEN 'earlyTotal' WHEN 25 THEN 'missingLineTotal' ELSE 'nothingStated' END AS rule,
       CASE variant WHEN 11 THEN 'The figures near the table have labels we don''t recognise, and none is the sum of the lines, so we didn''t check them.'
            WHEN 14 THEN 'The only total we found looks like a count, not an amount of money, so we didn''t check the lines against it.'
            WHEN 15 THEN 'A total is printed, but we couldn''t read its amount, so we didn''t check the lines against it.'
            WHEN 16 THEN 'The figures near the table have labels we don''t recognise, and none is the sum of the lines, so we didn''t check them.'
            WHEN 19 THEN 'A GST, tax or discount line is printed but no subtotal, so we can''t tell whether the total should equal the lines.'
            WHEN 20 THEN 'The subtotal or total is printed before some of the lines, so it can''t cover them all, and we didn''t check it.'
            WHEN 13 THEN 'The document shows two different amounts for the total (' || three || ' on page 1 and ' || over || ' on page 1), so we couldn''t check it.'
            WHEN 25 THEN 'We couldn''t check the total on page 1 because a line on page 1 has no line total.'
            WHEN 0 THEN NULL WHEN 17 THEN NULL ELSE 'We found no subtotal or total on the pages we could read, so there was nothing to check the lines against.' END AS reason
FROM base JOIN sums USING (doc_id)
"""
)
def fault_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).checks.select("doc_id", "outcome", "rule", "reason")


@query(
    DRAWN
    + """
SELECT doc_id, 1 AS page, code, text FROM (
    SELECT doc_id, CASE variant WHEN 6 THEN 'blankPage' WHEN 7 THEN 'headerOnlyRole' WHEN 10 THEN 'columnNotRead' WHEN 11 THEN 'totalsRowSkipped' WHEN 12 THEN 'descriptionWraps' WHEN 14 THEN 'totalNotMoney' WHEN 15 THEN 'totalAmountNotRead'
                WHEN 16 THEN 'unknownFigureNotPlaced' WHEN 22 THEN 'noHeadings' WHEN 23 THEN 'unknownHeadings' WHEN 24 THEN 'totalLabelNoAmount' WHEN 26 THEN 'imagesNotRead' WHEN 28 THEN 'headingTwoMeanings' WHEN 29 THEN 'columnNotRead' END AS code,
           CASE variant WHEN 6 THEN 'We found nothing to read on page 1.'
                WHEN 7 THEN 'On page 1, we read the ''Qty'' column as the quantity because of its heading. The numbers didn''t confirm it.'
                WHEN 10 THEN 'We couldn''t tell what the ''Weight'' column on page 1 holds, so we show its cells as printed.'
                WHEN 11 THEN 'On page 1, the line ''Stock so far here ' || counted || ' ' || three || ''' is a total, not a line item, so we didn''t list it.'
                WHEN 12 THEN 'On page 1, some descriptions go on to the next line. The description shows the first line; the line''s source text shows all of it.'
                WHEN 14 THEN 'On page 1, we didn''t use ''Total 25'' as a money total: it is a whole number with no currency sign, while the line totals have cents, so it may be a count.'
                WHEN 15 THEN 'On page 1, the line ''Total 12-50'' looks like a total, but we couldn''t read its amount, so we didn''t use it.'
                WHEN 16 THEN 'On page 1, we didn''t use ''Endbetrag: ' || over || ''' as the total: we don''t recognise its label, and it isn''t the sum of the lines.'
                WHEN 22 THEN 'The table on page 1 has no headings, so we couldn''t tell its language. Our check for returns and credit pages knows only English words, so it may not work on this page.'
                WHEN 23 THEN 'We didn''t recognise the headings on page 1. Our check for returns and credit pages knows only English words, so it may not work on this page.'
                WHEN 24 THEN 'On page 1, the line ''Total'' has a total''s label but no amount, so we didn''t use it as a total.'
                WHEN 26 THEN 'Page 1 has images as well as text. We read the text but not the images.'
                WHEN 28 THEN 'On page 1, the heading ''Price or Total'' could mean two different things, so we didn''t use it.'
                WHEN 29 THEN 'We couldn''t tell what the ''Note'' column on page 1 holds, so we show its cells as printed.' END AS text
    FROM base JOIN sums USING (doc_id)
    UNION ALL SELECT doc_id, 'unknownFigureNotPlaced', 'On page 1, we didn''t use ''Stock so far here ' || counted || ' ' || three || ''' as the total: we don''t recognise its label, and it isn''t the sum of the lines.' FROM base JOIN sums USING (doc_id) WHERE variant = 11
) WHERE code IS NOT NULL
"""
)
def fault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note of every page; a text said twice of a page comes once."""
    return plan(spark, sf_dir).page_notes.select("doc_id", "page", F.explode("notes").alias("n")).select("doc_id", "page", "n.code", "n.text")


@query(DRAWN + "SELECT doc_id, CASE variant WHEN 17 THEN 'inclusive' WHEN 18 THEN 'exclusive' ELSE 'unstated' END AS basis FROM base")
def fault_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).gst_basis


@query(
    DRAWN
    + """
SELECT doc_id, page,
       CASE variant WHEN 7 THEN 'code|description|quantity' WHEN 8 THEN 'description|-|-|-' WHEN 9 THEN 'description|-|-|-' WHEN 10 THEN 'description|-|unit' WHEN 29 THEN 'description|quantity|unitPrice|lineTotal|-|-' ELSE 'itemNo|description|quantity|unit|unitPrice|lineTotal' END AS roles,
       CASE variant WHEN 7 THEN 'both|both|header' WHEN 8 THEN 'both|-|-|-' WHEN 9 THEN 'both|-|-|-' WHEN 10 THEN 'both|-|numbers' WHEN 22 THEN 'numbers|numbers|numbers|numbers|numbers|numbers' WHEN 23 THEN 'numbers|numbers|numbers|numbers|numbers|numbers' WHEN 28 THEN 'both|both|both|both|numbers|both'
            WHEN 29 THEN 'both|both|both|both|-|-' ELSE 'both|both|both|both|both|both' END AS sources,
       CASE variant WHEN 7 THEN 'code|description|qty' WHEN 8 THEN 'description|qty|quantity|lineTotal' WHEN 9 THEN 'description|unitPrice|qty|lineTotal' WHEN 10 THEN 'description|weight|state' WHEN 18 THEN 'item|description|qty|unit|unitPrice|totalExGst' WHEN 22 THEN 'col1|col2|col3|col4|col5|col6'
            WHEN 23 THEN 'pos|was|anz|eh|ep|gp' WHEN 28 THEN 'item|description|qty|unit|priceOrTotal|lineTotal' WHEN 29 THEN 'description|qty|unitPrice|lineTotal|note|note2' ELSE 'item|description|qty|unit|unitPrice|lineTotal' END AS keys
FROM sheets WHERE variant NOT IN (1, 2, 3, 4, 5, 6, 27)
"""
)
def fault_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda part: F.array_join(f"columns.{part}", "|", "-")
    return plan(spark, sf_dir).roles.select("doc_id", "page", said("role").alias("roles"), said("source").alias("sources"), said("key").alias("keys"))


@query(DRAWN + """SELECT doc_id, CASE WHEN variant IN (1, 2, 3, 4, 5, 6, 7, 27) THEN NULL ELSE '.' END AS "decimal", variant <> 7 AS settled FROM base""")
def fault_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).number_format.select("doc_id", "decimal", "settled")


@query(
    DRAWN
    + """
SELECT doc_id, page, source_text, 'We found ' || CASE WHEN doc_id % 3 = 1 THEN 'a value' ELSE '''' || qty || '''' END || ' on page ' || page || ' but couldn''t match it to the exact text on the page, so we left it out.' AS message
FROM listed WHERE doc_id % 3 = 1 OR (doc_id % 3 = 0 AND variant <> 10)
"""
)
def evidence_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against pages whose text has lost its digits (every third document) or is missing (the next)."""
    p = plan(spark, sf_dir)
    dim = F.when(F.col("doc_id") % 3 == 0, F.translate("stream_text", "0123456789", "")).otherwise(F.col("stream_text"))
    return evidence.evidence_gate(p.line_items, p.streams.filter("doc_id % 3 <> 1").withColumn("stream_text", dim))[1].select("doc_id", "page", "source_text", "message")


@query(
    """
WITH said AS (
    SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS v, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS n FROM orders
)
SELECT o_orderkey, CASE v WHEN 0 THEN '(' || n || '.50)' WHEN 1 THEN '-€' || n || ',5' WHEN 2 THEN n || ' NZD' WHEN 3 THEN '$' || n || '.25 /bag' WHEN 4 THEN n || '%' WHEN 5 THEN n || ' CR' WHEN 6 THEN 'Lot ' || n ELSE '1,' || n END AS text,
       CASE v WHEN 0 THEN n || '.50' WHEN 1 THEN n || ',5' WHEN 3 THEN n || '.25' WHEN 6 THEN NULL WHEN 7 THEN '1,' || n ELSE n END AS core,
       CASE v WHEN 1 THEN 'EUR' WHEN 2 THEN 'NZD' END AS currency, v = 4 AS percent, CASE WHEN v = 3 THEN 'bag' END AS per, v IN (0, 1, 5) AS negative,
       CASE v WHEN 6 THEN 'text' WHEN 7 THEN 'ambiguous' ELSE 'ok' END AS status,
       CASE v WHEN 0 THEN -(CAST(n AS DOUBLE) + 0.5) WHEN 1 THEN -(CAST(n AS DOUBLE) + 0.5) WHEN 3 THEN CAST(n AS DOUBLE) + 0.25 WHEN 5 THEN -CAST(n AS DOUBLE) WHEN 6 THEN NULL WHEN 7 THEN CAST('1' || n AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS value,
       CASE v WHEN 7 THEN CAST('1.' || n AS DOUBLE) END AS other
FROM said
"""
)
def number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers of eight forms, taken apart and read under all conventions."""
    n = (F.col("o_orderkey") % 900 + 100).cast("string")
    forms = (("(", ".50)"), ("-€", ",5"), ("", " NZD"), ("$", ".25 /bag"), ("", "%"), ("", " CR"), ("Lot ", ""), ("1,", ""))
    text = F.element_at(F.array(*(F.concat(F.lit(a), n, F.lit(b)) for a, b in forms)), (F.col("o_orderkey") % 8).cast("int") + 1)
    parts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("text")).withColumn("p", N.analyse(F.col("text")))
    read = parts.withColumn("r", N.read(F.col("p"), F.lit(N.ALL)))
    return read.select("o_orderkey", "text", "p.core", N.currency_code(F.col("p.marker")).alias("currency"), "p.percent", "p.per", "p.negative", "r.status", "r.value", "r.other")


@query(
    """
WITH cents AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS dp, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, dp, '$' || CASE dp WHEN 0 THEN format('{:,}', (c + 50) // 100) WHEN 1 THEN format('{:,}', (c + 5) // 10 // 10) || '.' || (c + 5) // 10 % 10 ELSE format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || CASE WHEN dp = 3 THEN '0' ELSE '' END END AS text
FROM cents
"""
)
def rounded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with none to three decimals in one page's style."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("dp"), F.col("o_totalprice").cast("double").alias("value"))
    return orders.select("o_orderkey", "dp", N.written(F.col("value"), F.col("dp"), F.lit(1), F.lit("$"), F.lit(False)).alias("text"))


@query(
    """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Order ref' WHEN 4 THEN 'Docket no' END AS label FROM customer
"""
)
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a label, a time, no colon, too many words and a spaced label."""
    n = F.col("c_custkey").cast("string")
    forms = (("Order ref: ", ""), ("at 10:30 no ", ""), ("no label ", ""), ("one two three four: ", ""), ("  Docket no : ", ""))
    line = F.element_at(F.array(*(F.concat(F.lit(a), n, F.lit(b)) for a, b in forms)), (F.col("c_custkey") % 5).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.label_part(line).alias("label"))


@query(
    """
WITH sizes AS (SELECT o_orderkey, o_orderkey * 37 - 37 AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || CASE WHEN b = 1 THEN ' byte' ELSE ' bytes' END WHEN b * 10 < 1048576 THEN greatest(1, (b + 512) // 1024) || ' KB' ELSE (b * 10 + 524288) // 1048576 // 10 || '.' || (b * 10 + 524288) // 1048576 % 10 || ' MB' END AS size FROM sizes
"""
)
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", reports.file_size(F.col("o_orderkey") * 37 - 37).alias("size"))


@query(
    DRAWN
    + """
SELECT doc_id, CASE WHEN variant = 20 THEN 'TOO_MANY_PAGES' END AS code, CASE WHEN variant = 20 THEN 'This file has 2 pages. We read files of up to 1 pages. Split it into smaller files and try again.' END AS message,
       CASE WHEN variant = 20 THEN 0 ELSE 1 END AS pages, CASE WHEN variant IN (20, 5, 6) THEN FALSE ELSE TRUE END AS has_pieces
FROM base
"""
)
def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with faults under a limit of one page."""
    pages, pieces, refused = within_page_limit(*faulty_documents(spark, sf_dir), limit=1)
    kept = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages")).join(pieces.select("doc_id").distinct().withColumn("has_pieces", F.lit(True)), "doc_id", "left")
    return kept.join(refused, "doc_id", "full").select("doc_id", "code", "message", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("has_pieces", F.lit(False)).alias("has_pieces"))


@query(
    DRAWN
    + """
, state AS (
    SELECT doc_id, page, variant IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 27) AS bare FROM sheets
), counted AS (
    SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id
), totals AS (
    SELECT sum(n) FILTER (WHERE doc_id % 7 = 0) AS ids, count(*) FILTER (WHERE doc_id % 7 = 0) AS shared, sum(n) FILTER (WHERE doc_id % 7 = 1) AS currencies, sum(n) FILTER (WHERE doc_id % 7 = 2) AS spans,
           sum(n) FILTER (WHERE doc_id % 7 = 3) AS twofold, (SELECT count(*) FROM state WHERE doc_id % 7 = 4) AS counts, (SELECT count(*) FROM state WHERE doc_id % 7 = 4 AND bare) AS lists,
           (SELECT count(*) FROM base WHERE doc_id % 7 = 5) AS sums, sum(n) FILTER (WHERE doc_id % 7 = 6) AS units
    FROM counted
)
SELECT rule, CAST(coalesce(CASE rule WHEN 'item id names page and row' THEN ids WHEN 'item ids are unique' THEN shared WHEN 'a currency only on money' THEN currencies WHEN 'spans give the raw text' THEN spans
       WHEN 'no role is both present and missing' THEN twofold WHEN 'item counts are those listed' THEN counts WHEN 'refused and blank pages list nothing' THEN lists WHEN 'a sum is there when checked' THEN sums WHEN 'a unit only on a price' THEN units END, 0) AS BIGINT) AS violations
FROM totals, (VALUES ('item id names page and row'), ('number roles have values, others none'), ('a unit only on a price'), ('a currency only on money'),
  ('spans give the raw text'), ('no role is both present and missing'), ('item ids are unique'), ('pages are numbered from 1'), ('item counts are those listed'), ('refused and blank pages list nothing'),
  ('a role has a source'), ('refusal ids are unique'), ('refusals name pages that exist'), ('refusal ids name their place'), ('a check has a sum or a reason'), ('a sum is there when checked')) AS t(rule)
"""
)
def contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a reply over replies that were spoilt, each document in one of seven ways by its number."""
    p, way = plan(spark, sf_dir), F.col("doc_id") % 7
    spoilt = lambda name, k, value: F.when(way == k, value).otherwise(F.col(name)).alias(name)
    given = lambda part, value: F.transform("fields", lambda f: f.withField(part, F.lit(value)))
    fields = F.when(way == 1, given("currency", "EUR")).when(way == 6, given("per", "bag")).otherwise(F.col("fields")).alias("fields")
    items = p.line_items.select("doc_id", "page", "row", spoilt("id", 0, F.lit("one")), fields, spoilt("source_text", 2, F.concat(F.lit("~"), "source_text")), spoilt("missing", 3, F.array(F.lit("description"))))
    reports = p.page_reports.withColumn("item_count", F.when(way == 4, F.col("item_count") + 1).otherwise(F.col("item_count")))
    checked = F.col("outcome") != "not_checked"
    checks = p.checks.withColumn("derived", F.when((way == 5) & checked, F.lit(None)).when(way == 5, F.lit(1.0)).otherwise(F.col("derived")))
    return contract.violations(reports, items, p.refusals, checks)


@query(
    DRAWN
    + """
SELECT doc_id, 1 AS page, 'Total' AS label, CAST(sum(total) AS BIGINT) / 100.0 AS value
FROM rows WHERE i <= 3 AND variant IN (0, 17) GROUP BY doc_id, variant
"""
)
def stated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed totals that the checks rest on, named as a report names them."""
    return reports.stated_totals(plan(spark, sf_dir)).join(plan(spark, sf_dir).checks.filter("outcome = 'pass'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "page", "label", "value")


@query(
    """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{' || chr(10) || '  "key": ' || o_orderkey || ',' || chr(10) || '  "price": 1.50,' || chr(10) || '  "lines": [' || chr(10) || '    "a",' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  "none": {}' || chr(10) || '}'
       WHEN 1 THEN '{"key": ' || o_orderkey ELSE '[]' END AS text
FROM orders
"""
)
def pretty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts laid out for reading; one that isn't JSON stays as it is."""
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"key":'), key, F.lit(',"price":1.50,"lines":["a",null],"none":{}}'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"key": '), key)).otherwise("[ ]")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", reports.pretty_json(text).alias("text"))
