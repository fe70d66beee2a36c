"""Queries over the shared tables and their SQL.

Most read the documents drawn from order lines (``sources.virtual``); their
SQL says from the same table what the reader must find. The stages of a
document plan are written once for each folder and session and shared by the
queries; ``forget`` drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import faults_catalogue
from .functions import lexicon as X
from .functions import text as T
from .operators import conflicts, contract
from .plans import reports
from .plans.document import DocumentPlan, pages_per_part, run_summary
from .plans.store import shared_dir, written
from .registry import ORACLE_SQL, QUERIES, query
from .sources import upload
from .sources.virtual import virtual_documents
from .streaming import incremental

_PLANS: dict[tuple[str, str], DocumentPlan] = {}


def forget() -> None:
    _PLANS.clear()
    faults_catalogue.forget()


def plan(spark: SparkSession, sf_dir: str) -> DocumentPlan:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS[key] = DocumentPlan(*virtual_documents(spark, sf_dir))
    return _PLANS[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = """
WITH ordered AS (
    SELECT l_orderkey AS doc_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS line_no,
           CAST(l_orderkey % 16 AS INT) AS variant, CAST(l_quantity AS BIGINT) AS quantity,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS paid, l_partkey AS part
    FROM lineitem
), priced AS (
    SELECT *, (2 * paid + quantity) // (2 * quantity) AS price FROM ordered
), lines AS (
    SELECT *, CASE WHEN variant = 2 THEN price * quantity WHEN variant = 3 AND line_no = 1 THEN paid + 100 * quantity ELSE paid END AS total,
           CAST((line_no - 1) // 6 AS INT) + 1 AS page, CAST((line_no - 1) % 6 AS INT) AS place,
           CASE WHEN part % 2 = 0 THEN 'ea' ELSE 'box' END AS unit, 'Oak board grade ' || part AS description,
           (line_no = 1 AND variant IN (3, 4, 5)) AS faulty
    FROM priced
), money AS (
    SELECT *, CASE WHEN variant = 8 THEN replace(format('{:,}', price // 100), ',', '.') || ',' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') || ' €'
                   ELSE '$' || format('{:,}', price // 100) || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') END AS price_text,
              CASE WHEN variant = 8 THEN replace(format('{:,}', total // 100), ',', '.') || ',' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') || ' €'
                   ELSE '$' || format('{:,}', total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') END AS total_text
    FROM lines
), pages AS (
    SELECT doc_id, page, any_value(variant) AS variant, count(*) AS n, max(total) AS largest, bool_or(faulty) AS faulty FROM lines GROUP BY doc_id, page
), documents AS (
    SELECT doc_id, any_value(variant) AS variant, max(page) AS pages, sum(total) AS total, min(CASE WHEN faulty THEN page END) AS bad_page FROM lines GROUP BY doc_id
)
"""


def _ranked(items: DataFrame) -> DataFrame:
    return items.withColumn("line", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row")).cast("long"))


_ITEMS = (
    LINES
    + """
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place) AS line, description,
       CAST(quantity AS DOUBLE) AS quantity,
       CASE WHEN variant <> 13 THEN price / 100.0 END AS unit_price, CASE WHEN variant <> 13 THEN total / 100.0 END AS line_total,
       CASE WHEN variant = 8 THEN 'EUR' END AS currency, CAST(0 AS BIGINT) AS missing
FROM lines WHERE variant NOT IN (6, 9) AND NOT faulty
"""
)


def _item_columns(items: DataFrame) -> DataFrame:
    field = lambda role: F.get(F.filter("fields", lambda f: f["role"] == role), F.lit(0))
    return _ranked(items).select("doc_id", "page", "line", field("description")["raw"].alias("description"), "quantity", "unit_price", "line_total", field("lineTotal")["currency"].alias("currency"), F.size("missing").cast("long").alias("missing"))


@query(_ITEMS)
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_columns(plan(spark, sf_dir).line_items)


@query(_ITEMS)
def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    base = f"{shared_dir(spark)}/folioframe/{uuid.uuid4().hex}"
    incremental.arrivals_of(*virtual_documents(spark, sf_dir)).repartition(4, "doc_id").write.parquet(f"{base}/arrivals")
    return _item_columns(incremental.process(spark, f"{base}/arrivals", f"{base}/items", f"{base}/progress", files_per_batch=2))


@query(
    LINES
    + """
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place) AS line,
       CASE WHEN variant = 13 THEN concat_ws(' ', description, quantity, unit) ELSE concat_ws(' ', line_no, description, quantity, unit, price_text, total_text) END AS source_text
FROM money WHERE variant NOT IN (6, 9) AND NOT faulty
"""
)
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(plan(spark, sf_dir).line_items).select("doc_id", "page", "line", "source_text")


@query(
    LINES
    + """
SELECT doc_id, page, CASE WHEN variant = 9 THEN 'refused' ELSE 'text' END AS kind, CASE WHEN variant = 9 THEN 'NO_TEXT_LAYER' END AS code, CASE WHEN variant = 9 THEN 'scan' END AS form,
       CASE WHEN variant = 9 THEN 0 ELSE CASE WHEN variant = 13 THEN 3 * n + 3 ELSE 6 * n + 6 END + 1 - CASE WHEN variant = 4 AND faulty THEN 1 ELSE 0 END
         + CASE WHEN variant IN (10, 11) THEN 1 ELSE 0 END + CASE WHEN variant = 15 AND page > 1 THEN 2 ELSE 0 END
         + CASE WHEN page = documents.pages AND variant = 11 THEN 1 WHEN page = documents.pages AND variant IN (0, 2, 3, 4, 8, 12, 15) THEN 2 ELSE 0 END END AS piece_count
FROM pages JOIN documents USING (doc_id, variant)
"""
)
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).classified.select("doc_id", "page", "kind", "code", "form", F.col("piece_count").cast("long").alias("piece_count"))


@query(
    LINES
    + """
SELECT doc_id, page, 2 + n + CASE WHEN variant = 11 THEN 1 ELSE 0 END + CASE WHEN variant = 15 AND page > 1 THEN 1 ELSE 0 END + CASE WHEN page = documents.pages AND variant IN (0, 2, 3, 4, 8, 11, 12, 15) THEN 1 ELSE 0 END AS n_lines,
       CASE WHEN variant = 13 THEN 3 * n + 3 ELSE 6 * n + 6 END + 1 - CASE WHEN variant = 4 AND faulty THEN 1 ELSE 0 END + CASE WHEN variant = 11 THEN 1 ELSE 0 END
         + CASE WHEN variant = 15 AND page > 1 THEN 2 ELSE 0 END + CASE WHEN page = documents.pages AND variant = 11 THEN 1 WHEN page = documents.pages AND variant IN (0, 2, 3, 4, 8, 12, 15) THEN 2 ELSE 0 END AS n_cells
FROM pages JOIN documents USING (doc_id, variant) WHERE variant <> 9
"""
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x["cells"]))
    return plan(spark, sf_dir).layouts.select("doc_id", "page", F.size("lines").cast("long").alias("n_lines"), cells.cast("long").alias("n_cells"))


@query(
    LINES
    + """
SELECT doc_id, page, CASE WHEN variant = 13 THEN 'Description|Qty|Unit' ELSE 'Item|Description|Qty|Unit|Unit Price|Line Total' END AS headers,
       CASE WHEN variant = 13 THEN 'text|numeric|text' WHEN variant = 5 AND faulty AND n = 1 THEN 'numeric|text|numeric|text|numeric|numeric' ELSE 'numeric|text|numeric|text|numeric|numeric' END AS kinds, n AS body_rows
FROM pages WHERE variant <> 9
"""
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).layouts.filter("columns is not null").select("doc_id", "page", F.array_join("columns.header", "|").alias("headers"), F.array_join("columns.kind", "|").alias("kinds"), F.size("body").cast("long").alias("body_rows"))


@query(
    LINES
    + """
SELECT doc_id, page, CAST(CASE WHEN variant = 13 THEN 255 WHEN variant = 8 AND largest >= 100000 THEN 16 WHEN variant = 8 THEN 240 WHEN largest >= 100000 THEN 1 ELSE 15 END AS BIGINT) AS conventions
FROM pages WHERE variant NOT IN (6, 9)
"""
)
def number_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).conventions.select("doc_id", "page", F.col("conventions").cast("long").alias("conventions"))


@query(
    LINES
    + """
, grouped AS (SELECT doc_id, bool_or(largest >= 100000) AS grouped FROM pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN variant IN (6, 9, 13) THEN NULL WHEN variant = 8 THEN ',' ELSE '.' END AS "decimal",
       CASE WHEN variant IN (6, 9, 13) OR NOT grouped THEN NULL WHEN variant = 8 THEN '.' ELSE ',' END AS grouping, TRUE AS settled
FROM documents JOIN grouped USING (doc_id)
"""
)
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).number_format.select("doc_id", "decimal", "grouping", "settled")


@query(
    LINES
    + """
SELECT doc_id, page, CASE WHEN variant = 13 THEN 'description|quantity|unit' ELSE 'itemNo|description|quantity|unit|unitPrice|lineTotal' END AS roles,
       CASE WHEN variant = 13 THEN 'description|qty|unit' ELSE 'item|description|qty|unit|unitPrice|lineTotal' END AS keys
FROM pages WHERE variant NOT IN (6, 9)
"""
)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).roles.select("doc_id", "page", F.array_join("columns.role", "|").alias("roles"), F.array_join("columns.key", "|").alias("keys"))


@query(
    LINES
    + """
SELECT doc_id, page, CASE variant WHEN 3 THEN 'ARITHMETIC_MISMATCH' WHEN 4 THEN 'NO_DESCRIPTION' ELSE 'UNPARSEABLE_NUMBER' END AS code,
       CASE variant WHEN 3 THEN 'On page ' || page || ', ' || quantity || ' × ' || price_text || ' is $' || format('{:,}', quantity * price // 100) || '.' || lpad(CAST(quantity * price % 100 AS VARCHAR), 2, '0') || ' (calculated by us), but the document says ' || total_text || '. We can''t tell which is right, so we left this line out.'
                    WHEN 4 THEN 'A row on page ' || page || ' has numbers but no description (''' || concat_ws(' ', line_no, quantity, unit, price_text, total_text) || '''), so we didn''t attach them to any line.'
                    ELSE '''$12.50 box'' on page ' || page || ' isn''t a number we can read, so that line was left out.' END AS message
FROM money WHERE faulty
"""
)
def row_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).row_refusals.select("doc_id", "page", "code", "message")


@query(
    LINES
    + """
SELECT doc_id, page, CASE variant WHEN 9 THEN 'NO_TEXT_LAYER' ELSE 'CREDIT_OR_RETURN_PAGE' END AS code,
       CASE variant WHEN 9 THEN 'Page ' || page || ' is a scanned picture. We don''t read scans, so nothing on it was extracted.'
                    ELSE 'Page ' || page || ' is titled ''Credit Memo'', so its amounts may be refunds or credits rather than sales. We didn''t list them as normal items.' END AS message,
       CASE variant WHEN 9 THEN 0 ELSE n + 2 END AS evidence
FROM pages WHERE variant IN (6, 9)
"""
)
def page_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).page_refusals.select("doc_id", "page", "code", "message", F.size("evidence").cast("long").alias("evidence"))


_STATUS = (
    LINES
    + """
, state AS (
    SELECT doc_id, page, variant, n, CASE WHEN variant IN (6, 9) OR (faulty AND n = 1) THEN 'refused' WHEN faulty THEN 'partial' ELSE 'extracted' END AS status,
           CASE WHEN variant IN (6, 9) THEN 0 WHEN faulty THEN n - 1 ELSE n END AS item_count
    FROM pages
)
"""
)


@query(_STATUS + "SELECT doc_id, page, status, item_count FROM state")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).page_status.select("doc_id", "page", "status", "item_count")


@query(
    LINES
    + """
SELECT doc_id, pages AS page, CASE variant WHEN 2 THEN 'Subtotal:' WHEN 8 THEN 'Endbetrag:' ELSE 'Total:' END AS label, CASE variant WHEN 2 THEN 'subtotal' WHEN 8 THEN NULL ELSE 'total' END AS kind,
       (total + CASE WHEN variant = 12 THEN 3650 ELSE 0 END) / 100.0 AS value, CASE WHEN variant = 8 THEN 'EUR' END AS currency, TRUE AS proved
FROM documents WHERE variant IN (0, 2, 3, 4, 8, 12, 15)
"""
)
def totals_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).totals_found[0].select("doc_id", "page", "label", "kind", "value", "currency", "proved")


@query(
    LINES
    + """
SELECT doc_id, CASE WHEN variant = 2 THEN 'lines_vs_subtotal' ELSE 'lines_vs_total' END AS name,
       CASE WHEN variant IN (0, 2, 8, 15) THEN 'pass' WHEN variant = 12 THEN 'fail' ELSE 'not_checked' END AS outcome,
       CASE WHEN variant IN (0, 2, 15) THEN 'pass' WHEN variant = 8 THEN 'unknownUsed' WHEN variant = 12 THEN 'fail' WHEN variant IN (3, 4) THEN 'pageNotRead' ELSE 'nothingStated' END AS rule,
       CASE WHEN variant IN (0, 2, 8, 12, 15) THEN total / 100.0 END AS derived,
       CASE WHEN variant IN (0, 2, 3, 4, 8, 12, 15) THEN pages ELSE 0 END AS pages_covered, CASE WHEN variant IN (0, 2, 3, 4, 8, 12, 15) THEN 1 ELSE 0 END AS stated
FROM documents
"""
)
def totals_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).checks.select("doc_id", "name", "outcome", "rule", "derived", F.size("pages_covered").cast("int").alias("pages_covered"), F.size("stated").cast("int").alias("stated"))


@query(
    LINES
    + """
, said AS (
    SELECT documents.*, CASE WHEN pages = 1 THEN 'page 1' WHEN pages = 2 THEN 'pages 1 and 2' ELSE 'pages 1 to ' || pages END AS covered, pages.n AS bad_n
    FROM documents LEFT JOIN pages ON pages.doc_id = documents.doc_id AND pages.page = documents.bad_page
)
SELECT doc_id, CASE WHEN variant = 12 THEN 'TOTALS_DISAGREE' ELSE 'TOTALS_UNVERIFIABLE' END AS code, pages AS page,
       CASE WHEN variant = 12 THEN 'The lines on ' || covered || ' add up to $' || format('{:,}', total::BIGINT // 100) || '.' || lpad(CAST(total::BIGINT % 100 AS VARCHAR), 2, '0') || ' (calculated by us), but the total says $'
                 || format('{:,}', (total::BIGINT + 3650) // 100) || '.' || lpad(CAST((total::BIGINT + 3650) % 100 AS VARCHAR), 2, '0') || '. The difference is $36.50 (calculated by us).'
            ELSE 'We couldn''t check the total on page ' || pages || ' because page ' || bad_page || CASE WHEN bad_n = 1 THEN ' couldn''t be read.' ELSE ' was only partly read.' END END AS message
FROM said WHERE variant IN (3, 4, 12)
"""
)
def totals_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).checks.select("doc_id", F.explode("refusals").alias("r")).select("doc_id", "r.code", "r.page", "r.message")


@query(LINES + "SELECT doc_id, 'unstated' AS basis FROM documents")
def gst_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).gst_basis


@query(
    LINES
    + """
SELECT doc_id, 'crate' AS word, 'The document says 8 crates in one place (page 1) and ' || (pages + 8) || ' crates in another (page ' || pages || '). We can''t tell which one is right.' AS message
FROM documents WHERE variant = 11
"""
)
def conflicting_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).conflicts.select("doc_id", "word", "message")


@query(
    LINES
    + """
SELECT doc_id, page, CASE variant WHEN 6 THEN 'Credit Memo' WHEN 7 THEN 'Summary' ELSE 'Quote ' || doc_id END || CASE WHEN variant = 11 THEN '|8 crates packed' ELSE '' END AS title_lines,
       CASE WHEN variant = 6 THEN 'Credit Memo' END AS credit_title, CASE WHEN variant = 7 THEN 'Summary' END AS summary_title
FROM pages WHERE variant <> 9
"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).titles.select("doc_id", "page", F.array_join("title_lines", "|").alias("title_lines"), "credit_title", "summary_title")


@query(
    LINES
    + """
SELECT doc_id, page, 'rotatedTextIgnored' AS code, 'On page ' || page || ', some sideways text (like a stamp or watermark) was ignored.' AS text FROM pages WHERE variant = 10
UNION ALL SELECT doc_id, page, 'carriedForwardSkipped', 'On page ' || page || ', the line ''Carried forward $100.00'' carries a total from another page, so we skipped it to avoid counting it twice.' FROM pages WHERE variant = 15 AND page > 1
UNION ALL SELECT doc_id, page, 'summaryPage', 'Page ' || page || ' is titled ''Summary''. Its lines may repeat lines from other pages.' FROM pages WHERE variant = 7
"""
)
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes on what was skipped or doubted on a page."""
    notes = plan(spark, sf_dir).page_notes.select("doc_id", "page", F.explode("notes").alias("n")).select("doc_id", "page", "n.code", "n.text")
    return notes.filter(F.col("code").isin("rotatedTextIgnored", "carriedForwardSkipped", "summaryPage"))


@query(
    _STATUS
    + """
, codes AS (
    SELECT doc_id, CASE variant WHEN 9 THEN 'NO_TEXT_LAYER' ELSE 'CREDIT_OR_RETURN_PAGE' END AS code FROM pages WHERE variant IN (6, 9)
    UNION ALL SELECT doc_id, CASE variant WHEN 3 THEN 'ARITHMETIC_MISMATCH' WHEN 4 THEN 'NO_DESCRIPTION' ELSE 'UNPARSEABLE_NUMBER' END FROM lines WHERE faulty
    UNION ALL SELECT doc_id, CASE variant WHEN 11 THEN 'CONFLICTING_FIGURES' WHEN 12 THEN 'TOTALS_DISAGREE' ELSE 'TOTALS_UNVERIFIABLE' END FROM documents WHERE variant IN (3, 4, 11, 12)
)
SELECT code, count(*) AS n FROM codes GROUP BY code
"""
)
def refusal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).refusals.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(_STATUS + "SELECT doc_id, count(*) AS page_count, CAST(sum(item_count) AS BIGINT) AS item_count FROM state GROUP BY doc_id")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(plan(spark, sf_dir)).select("doc_id", "page_count", "item_count")


@query(_STATUS + "SELECT doc_id, page, item_count AS passed, CAST(0 AS BIGINT) AS failed FROM state WHERE item_count > 0")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, failed = plan(spark, sf_dir).gated
    both = passed.select("doc_id", "page", F.lit(1).alias("ok")).unionByName(failed.select("doc_id", "page", F.lit(0).alias("ok")))
    return both.groupBy("doc_id", "page").agg(F.count_if(F.col("ok") == 1).alias("passed"), F.count_if(F.col("ok") == 0).alias("failed"))


@query(
    """
SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('item id names page and row'), ('number roles have values, others none'), ('a unit only on a price'), ('a currency only on money'),
  ('spans give the raw text'), ('no role is both present and missing'), ('item ids are unique'), ('pages are numbered from 1'), ('item counts are those listed'), ('refused and blank pages list nothing'),
  ('a role has a source'), ('refusal ids are unique'), ('refusals name pages that exist'), ('refusal ids name their place'), ('a check has a sum or a reason'), ('a sum is there when checked')) AS t(rule)
"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    return contract.violations(p.page_reports, p.line_items, p.refusals, p.checks)


@query(
    _STATUS
    + """
SELECT doc_id, CAST(max(page) AS INT) AS page_count, CAST(sum(item_count) AS INT) AS items, CASE WHEN any_value(variant) IN (0, 2, 8, 15) THEN 'pass' WHEN any_value(variant) = 12 THEN 'fail' ELSE 'not_checked' END AS outcome
FROM state GROUP BY doc_id
"""
)
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read back from the JSON reply of each document."""
    read = F.from_json("json", "pageCount int, items array<struct<id:string>>, totals struct<check:struct<outcome:string>>")
    return plan(spark, sf_dir).replies.select("doc_id", read.alias("r")).select("doc_id", F.col("r.pageCount").alias("page_count"), F.size("r.items").alias("items"), F.col("r.totals.check.outcome").alias("outcome"))


@query(
    LINES
    + """
, sizes AS (SELECT doc_id, page, CAST(sum(total) // 100 AS BIGINT) AS bytes FROM lines GROUP BY doc_id, page),
whole AS (SELECT doc_id, max(page) AS pages FROM sizes GROUP BY doc_id),
tried AS (SELECT doc_id, unnest(range(1, pages)) AS n FROM whole),
buckets AS (SELECT doc_id, n, (page - 1) // n AS bucket, sum(bytes) AS bytes FROM sizes JOIN tried USING (doc_id) GROUP BY ALL),
fits AS (SELECT doc_id, n FROM buckets GROUP BY doc_id, n HAVING max(bytes) <= 300000 * 0.9 - 1000)
SELECT doc_id, CAST(max(n) AS INT) AS parts FROM whole LEFT JOIN fits USING (doc_id) GROUP BY doc_id
"""
)
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages a part of a reply may hold, with an order's dollars as bytes and 1000 bytes besides."""
    from .sources.virtual import order_lines

    sizes = order_lines(_table(spark, sf_dir, "lineitem")).groupBy("doc_id", "page").agg(F.floor(F.sum("total") / 100).alias("bytes"))
    whole = sizes.withColumn("reply_bytes", F.sum("bytes").over(Window.partitionBy("doc_id")) + 1000)
    return pages_per_part(whole, 300_000)


_PRICE = "[+-]?(?:(?:[A-Z]{1,2}\\p{Sc}|\\p{Sc})[ ]?)?[0-9]+(?:[.,'' ][0-9]+)*"


@query(
    f"""
WITH said AS (SELECT o_orderkey, o_orderpriority AS t FROM orders UNION ALL SELECT o_orderkey, '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders)
SELECT o_orderkey, t AS text, CASE WHEN regexp_full_match(t, '{_PRICE}') THEN 'NUM'
       WHEN regexp_matches(t, '^{_PRICE}') AND length(trim(regexp_replace(t, '^{_PRICE}', ''))) BETWEEN 1 AND 10 AND NOT contains(trim(regexp_replace(t, '^{_PRICE}', '')), ' ') THEN 'NUMX' ELSE 'TEXT' END AS shape
FROM said
"""
)
def cell_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    price = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    said = orders.select("o_orderkey", F.explode(F.array("o_orderpriority", price, "o_orderstatus")).alias("text"))
    return said.select("o_orderkey", "text", T.cell_shape(F.col("text")).alias("shape"))


@query(
    r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_full_match(trim(line), '[\p{P}\p{S}\s]{3,}') AND NOT regexp_matches(line, '\p{Sc}')) AS n_drawn FROM lines GROUP BY doc_id
"""
)
def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_separator(F.col("line"))).alias("n_drawn"))


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_MENTIONS = rf"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS row_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), plain AS (
    SELECT * FROM lines WHERE NOT regexp_matches(lower(trim(line)), '^(?:{"|".join(X.DOCUMENT_NUMBER_LABELS)})s?(?:[^\p{{L}}\p{{N}}-]|$)')
), tokens AS (
    SELECT doc_id, row_no, t[i] AS number, regexp_extract(t[i + 1], '^[\p{{L}}\p{{M}}]+') AS unit
    FROM (SELECT doc_id, row_no, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, row_no, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS t FROM plain))
    WHERE regexp_full_match(t[i], '[0-9]+(?:[.,][0-9]+)*') AND regexp_matches(t[i + 1], '^[\p{{L}}\p{{M}}]')
), singled AS (
    SELECT *, lower(unit) AS low, CASE WHEN length(unit) > 3 AND lower(unit) LIKE '%ies' THEN regexp_replace(lower(unit), 'ies$', 'y') WHEN regexp_matches(lower(unit), '(?:ches|shes|xes|sses)$') THEN regexp_replace(lower(unit), 'es$', '')
           WHEN lower(unit) LIKE '%s' AND lower(unit) NOT LIKE '%ss' THEN regexp_replace(lower(unit), 's$', '') ELSE lower(unit) END AS word
    FROM tokens
), mentions AS (
    SELECT doc_id, row_no, word, CASE WHEN regexp_full_match(number, '[0-9]+') THEN CAST(CAST(number AS DECIMAL(38, 0)) AS VARCHAR)
           WHEN regexp_full_match(number, '[0-9]{{1,3}}(?:[.,][0-9]{{3}})+') THEN CAST(CAST(regexp_replace(number, '[.,]', '', 'g') AS DECIMAL(38, 0)) AS VARCHAR)
           WHEN regexp_full_match(number, '[0-9]+[.,][0-9]+') THEN regexp_replace(regexp_replace(CAST(CAST(replace(number, ',', '.') AS DECIMAL(38, 10)) AS VARCHAR), '0+$', ''), '\.$', '') ELSE number END AS value
    FROM singled WHERE low NOT IN ({_words(X.NOT_COUNT_WORDS + X.MONTHS)}) AND word NOT IN ({_words(X.NOT_COUNT_WORDS + X.MONTHS)}) AND NOT (regexp_full_match(number, '[0-9]{{4,}}') AND regexp_matches(unit, '^\p{{Lu}}'))
)
"""


def _document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    texts = lines.select("doc_id", F.lit(1).alias("page"), "row", "line", F.lit(0).alias("part"), F.col("line").alias("text"))
    return conflicts.mentions(texts)


@query(_MENTIONS + "SELECT doc_id, word, value, count(*) AS n FROM mentions GROUP BY doc_id, word, value")
def count_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_mentions(spark, sf_dir).groupBy("doc_id", "word", "value").agg(F.count(F.lit(1)).alias("n"))


@query(_MENTIONS + "SELECT doc_id, word, least(count(DISTINCT value), 5) AS quoted, least(count(DISTINCT row_no), 5) AS evidence FROM mentions GROUP BY doc_id, word HAVING count(DISTINCT value) >= 2 AND count(DISTINCT row_no) >= 2")
def count_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conflicts.conflicting_figures(written(_document_mentions(spark, sf_dir), "mentions"))
    return found.select("doc_id", "word", F.size("mentions").cast("long").alias("quoted"), F.size("evidence").cast("long").alias("evidence"))


@query(
    """
SELECT doc_id, CASE WHEN text IS NULL THEN 'NO_FILE' WHEN strlen(text) = 0 THEN 'EMPTY_FILE' WHEN strlen(text) > 4096 THEN 'FILE_TOO_LARGE' WHEN contains(text, '%PDF-') THEN NULL ELSE 'NOT_A_PDF' END AS code,
       CASE WHEN strlen(text) > 4096 THEN replace(CAST(CAST(ceil(strlen(text) * 10 / 1048576) / 10 AS DECIMAL(18, 1)) AS VARCHAR), '.0', '') || ' MB' END AS size
FROM documents
"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload gate on texts as file contents, with a limit of 4 KiB."""
    from .functions.messages import megabytes

    content = F.encode("text", "UTF-8")
    files = _table(spark, sf_dir, "documents").select("doc_id", upload.upload_code(content, 4096).alias("code"), F.octet_length("text").alias("bytes"))
    return files.select("doc_id", "code", F.when(F.col("bytes") > 4096, megabytes(F.col("bytes"))).alias("size"))


@query(
    r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS labels FROM lines WHERE regexp_matches(line, '^\s*[^\s:]+(?:\s+[^\s:]+){0,2}\s*:') AND NOT regexp_matches(line, '^\s*[^\s:]*(?:\s+[^\s:]+){0,2}\p{N}:\p{N}') GROUP BY doc_id
"""
)
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(T.label_part(F.col("line")).isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("labels"))


@query(LINES + "SELECT doc_id, page, CAST(count(*) AS INT) AS pieces FROM lines WHERE variant <> 9 GROUP BY doc_id, page")
def drawn_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body rows found by the fold, counted by page: the round trip of layout without roles."""
    return plan(spark, sf_dir).layouts.select("doc_id", "page", F.size("body").alias("pieces"))


@query(
    LINES
    + """
, cells AS (
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place) AS line, variant, unnest(CASE WHEN variant = 13 THEN [description, CAST(quantity AS VARCHAR), unit] ELSE [CAST(line_no AS VARCHAR), description, CAST(quantity AS VARCHAR), unit, price_text, total_text] END) AS text,
           generate_subscripts(CASE WHEN variant = 13 THEN [1, 2, 3] ELSE [1, 2, 3, 4, 5, 6] END, 1) AS k
    FROM money WHERE variant NOT IN (6, 9) AND NOT faulty
)
SELECT doc_id, page, line, CAST(k - 1 AS INT) AS position, CASE WHEN variant = 13 THEN ['Description', 'Qty', 'Unit'][k] ELSE ['Item', 'Description', 'Qty', 'Unit', 'Unit Price', 'Line Total'][k] END AS heading, text FROM cells
"""
)
def items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reports.items_table(plan(spark, sf_dir)).withColumn("line", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("row")).cast("long"))
    return cells.select("doc_id", "page", "line", "position", "heading", "text")


@query(
    _STATUS
    + """
SELECT doc_id, page, CASE WHEN variant IN (6, 9) THEN 'Not read' WHEN status = 'refused' THEN 'No lines listed: its one line was left out' WHEN status = 'partial' THEN 'Partly read: 1 line left out' WHEN variant = 7 THEN 'Read, with a warning' ELSE 'Read' END AS label FROM state
"""
)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_labels(plan(spark, sf_dir))


@query(
    LINES
    + """
, grouped AS (SELECT doc_id, bool_or(largest >= 100000) AS grouped FROM pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN variant <> 8 THEN NULL WHEN grouped THEN 'Numbers on this document use ''.'' between thousands and '','' as the decimal mark, like 1.195,20.' ELSE 'Numbers on this document use '','' as the decimal mark, like 15,50.' END AS sentence
FROM documents JOIN grouped USING (doc_id)
"""
)
def format_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.format_sentences(plan(spark, sf_dir))


@query(
    _STATUS
    + """
, refused AS (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM pages WHERE variant IN (6, 9) UNION ALL SELECT doc_id FROM lines WHERE faulty UNION ALL SELECT doc_id FROM documents WHERE variant IN (3, 4, 11, 12)) GROUP BY doc_id
), counted AS (
    SELECT doc_id, count(*) AS pages, CAST(sum(item_count) AS BIGINT) AS items, count(*) FILTER (WHERE item_count > 0) AS pages_with_items, CASE WHEN any_value(variant) = 7 THEN count(*) ELSE 0 END AS warnings FROM state GROUP BY doc_id
)
SELECT doc_id, pages, items, pages_with_items, warnings, coalesce(n, 0) AS refusals,
       CASE WHEN items = 0 AND pages = 1 THEN 'No line items were read from this page' WHEN items = 0 THEN 'No line items were read from these ' || pages || ' pages'
            ELSE items || CASE WHEN items = 1 THEN ' line item' ELSE ' line items' END || ' read from ' || CASE WHEN pages_with_items = pages THEN pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END ELSE pages_with_items || ' of ' || pages || ' pages' END END
       || CASE WHEN coalesce(n, 0) > 0 THEN ' · ' || n || CASE WHEN n = 1 THEN ' thing' ELSE ' things' END || ' we couldn''t read or check' ELSE '' END
       || CASE WHEN warnings > 0 THEN ' · ' || warnings || CASE WHEN warnings = 1 THEN ' warning' ELSE ' warnings' END ELSE '' END || CASE WHEN coalesce(n, 0) + warnings > 0 THEN ', listed below.' ELSE '.' END AS sentence
FROM counted LEFT JOIN refused USING (doc_id)
"""
)
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summaries(plan(spark, sf_dir))


from . import stages_catalogue  # noqa: E402, F401  registers its queries, which read the plans above
