"""Queries over the stages between positioned text and line items, and over texts drawn to reach each rule.

The stages are those of the documents drawn from order lines; the SQL works
out from the same lines what each stage must hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import LINES, plan
from .functions import numbers as N
from .functions import text as T
from .operators import conflicts, roles
from .registry import query
from .sources.virtual import order_lines, virtual_documents

DRAWN = (
    LINES
    + """
, cells AS (
    SELECT doc_id, page, variant, place, faulty, n_cell AS k, CASE WHEN variant = 13 THEN n_cell - 1 ELSE n_cell END AS position,
           CASE n_cell WHEN 0 THEN CAST(line_no AS VARCHAR) WHEN 1 THEN description WHEN 2 THEN CAST(quantity AS VARCHAR) WHEN 3 THEN unit
                       WHEN 4 THEN CASE WHEN variant = 5 AND faulty THEN '$12.50 box' ELSE price_text END ELSE total_text END AS str
    FROM money, (SELECT unnest(range(6)) AS n_cell)
    WHERE variant <> 9 AND NOT (variant = 13 AND n_cell IN (0, 4, 5)) AND NOT (variant = 4 AND faulty AND n_cell = 1)
), places AS (
    SELECT * FROM (VALUES (0, 43, 'Item'), (1, 71, 'Description'), (2, 326, 'Qty'), (3, 377, 'Unit'), (4, 428, 'Unit Price'), (5, 502, 'Line Total')) AS t(k, x, heading)
), sheets AS (
    SELECT pages.*, documents.pages, documents.total + CASE WHEN variant = 12 THEN 3650 ELSE 0 END AS amount, pages.page = documents.pages AS is_last, 198 + 34 + 17 * (n - 1) AS below,
           CASE variant WHEN 2 THEN 'Subtotal:' WHEN 8 THEN 'Endbetrag:' WHEN 0 THEN 'Total:' WHEN 3 THEN 'Total:' WHEN 4 THEN 'Total:' WHEN 12 THEN 'Total:' WHEN 15 THEN 'Total:' END AS label
    FROM pages JOIN documents USING (doc_id, variant) WHERE variant <> 9
), pieces AS (
    SELECT doc_id, page, 100 + 10 * place + k AS ord, str, x, 198 + 17 * place AS y FROM cells JOIN places USING (k)
    UNION ALL SELECT doc_id, page, 10 + k, heading, x, 176 FROM sheets, places WHERE variant <> 13 OR k IN (1, 2, 3)
    UNION ALL SELECT doc_id, page, 1, CASE variant WHEN 6 THEN 'Credit Memo' WHEN 7 THEN 'Summary' ELSE 'Quote ' || doc_id END, 43, 77 FROM sheets
    UNION ALL SELECT doc_id, page, 30, 'PAID', 300, 120 FROM sheets WHERE variant = 10
    UNION ALL SELECT doc_id, page, 31, '8 crates packed', 43, 110 FROM sheets WHERE variant = 11
    UNION ALL SELECT doc_id, page, 90000, (8 + pages) || ' crates delivered', 43, below + 60 FROM sheets WHERE variant = 11 AND is_last
    UNION ALL SELECT doc_id, page, 32, 'Carried forward', 71, 150 FROM sheets WHERE variant = 15 AND page > 1
    UNION ALL SELECT doc_id, page, 33, '$100.00', 502, 150 FROM sheets WHERE variant = 15 AND page > 1
    UNION ALL SELECT doc_id, page, 90001, label, 428, below FROM sheets WHERE label IS NOT NULL AND is_last
    UNION ALL SELECT doc_id, page, 90002, CASE WHEN variant = 8 THEN replace(format('{:,}', CAST(amount AS BIGINT) // 100), ',', '.') || ',' || lpad(CAST(CAST(amount AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' €'
                     ELSE '$' || format('{:,}', CAST(amount AS BIGINT) // 100) || '.' || lpad(CAST(CAST(amount AS BIGINT) % 100 AS VARCHAR), 2, '0') END, 502, below FROM sheets WHERE label IS NOT NULL AND is_last
)
"""
)


@query(DRAWN + "SELECT doc_id, page, CAST(ord AS INT) AS ord, str, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN str = 'PAID' THEN 72.0 ELSE CAST(length(str) * 4.5 AS DOUBLE) END AS width, str = 'PAID' AS turned FROM pieces")
def render_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_documents(spark, sf_dir)[1].select("doc_id", "page", "ord", "str", "x", "y", "width", (F.col("angle") != 0).alias("turned"))


@query(
    DRAWN
    + """
SELECT pages.doc_id, pages.page, coalesce(said, '') AS stream_text
FROM pages LEFT JOIN (SELECT doc_id, page, replace(string_agg(str, '' ORDER BY ord), ' ', '') AS said FROM pieces GROUP BY doc_id, page) USING (doc_id, page)
"""
)
def stream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).streams.select("doc_id", "page", "stream_text")


@query(
    DRAWN
    + """
SELECT doc_id, page, CAST(place AS INT) AS n, CAST(position AS INT) AS position, str AS text,
       CAST(sum(length(str) + 1) OVER w - length(str) - 1 AS INT) AS start, CAST(sum(length(str) + 1) OVER w - 1 AS INT) AS stop
FROM cells WINDOW w AS (PARTITION BY doc_id, page, place ORDER BY k)
"""
)
def cell_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body cell's column and where it stands in its row's text."""
    rows = plan(spark, sf_dir).layouts.select("doc_id", "page", F.explode("body").alias("b"))
    return rows.select("doc_id", "page", "b.n", F.explode("b.cells").alias("c")).select("doc_id", "page", "n", "c.position", "c.text", "c.start", "c.stop")


@query(
    DRAWN
    + """
, extents AS (
    SELECT doc_id, page, k, min(x) AS low, max(x + 4.5 * length(str)) AS high
    FROM (SELECT doc_id, page, k, str, x FROM cells JOIN places USING (k) UNION ALL SELECT doc_id, page, k, heading, x FROM sheets, places WHERE variant <> 13 OR k IN (1, 2, 3)) GROUP BY doc_id, page, k
)
SELECT doc_id, page, CAST(row_number() OVER w - 1 AS INT) AS position, CAST(coalesce((lag(high) OVER w + low) / 2, low) AS DOUBLE) AS x0, CAST(coalesce((high + lead(low) OVER w) / 2, high) AS DOUBLE) AS x1
FROM extents WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)
"""
)
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each column begins and ends: halfway to its neighbours."""
    columns = plan(spark, sf_dir).layouts.filter("columns is not null").select("doc_id", "page", F.explode("columns").alias("c"))
    return columns.select("doc_id", "page", "c.position", "c.x0", "c.x1")


FACTS = (
    DRAWN
    + """
, listed AS (
    SELECT doc_id, page, variant, n, faulty, CAST(k AS INT) AS k, CAST(CASE WHEN variant = 13 THEN k - 1 ELSE k END AS INT) AS position FROM sheets, (SELECT unnest(range(6)) AS k)
    WHERE variant NOT IN (6, 9) AND NOT (variant = 13 AND k IN (0, 4, 5))
), counted AS (
    SELECT doc_id, page, k, n - CASE WHEN variant = 4 AND faulty AND k = 1 THEN 1 ELSE 0 END AS filled,
           n - CASE WHEN variant = 5 AND faulty AND k = 4 THEN 1 ELSE 0 END AS readable FROM listed
), steps AS (
    SELECT doc_id, page, 2 AS k, count(*) >= 2 AND max(quantity - place) = min(quantity - place) AS rising FROM lines GROUP BY doc_id, page
    UNION ALL SELECT doc_id, page, 0, count(*) >= 2 FROM lines GROUP BY doc_id, page
), facts AS (
    SELECT listed.*, filled, k IN (0, 2, 4, 5) AND 5 * readable >= 3 * filled AND filled > 0 AS numeric, k IN (4, 5) AS marked, coalesce(rising, FALSE) AS steps_up
    FROM listed JOIN counted USING (doc_id, page, k) LEFT JOIN steps USING (doc_id, page, k)
)
"""
)


@query(
    FACTS
    + """
SELECT doc_id, page, position, CAST(n AS BIGINT) AS row_count, CAST(filled AS BIGINT) AS filled, numeric, marked, steps_up, k = 3 OR filled = 0 AS all_units, CASE WHEN k IN (4, 5) THEN CASE WHEN variant = 8 THEN '€' ELSE '$' END END AS marker FROM facts
"""
)
def column_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column holds: how many cells, numbers, money, counting numbers, units."""
    return plan(spark, sf_dir).facts.select("doc_id", "page", "position", "row_count", "filled", "numeric", "marked", "steps_up", "all_units", "marker")


@query(
    FACTS
    + """
, numbers AS (
    SELECT doc_id, page, place, k, CASE k WHEN 0 THEN line_no WHEN 2 THEN quantity WHEN 4 THEN price ELSE total END AS v, CASE WHEN k >= 4 THEN 2 ELSE 0 END AS dp
    FROM lines, (SELECT unnest([0, 2, 4, 5]) AS k) WHERE NOT (variant = 5 AND faulty AND k = 4)
), usable AS (
    SELECT numbers.*, position, n, steps_up, CAST(v AS HUGEINT) AS i FROM numbers JOIN facts USING (doc_id, page, k) WHERE numeric AND v <> 0
), met AS (
    SELECT a.doc_id, a.page, a.position AS a, b.position AS b, c.position AS c, any_value(a.n) AS n, bool_or(a.steps_up OR b.steps_up OR c.steps_up) AS with_counting, count(*) AS checkable,
           count(*) FILTER (WHERE abs(a.i * b.i * CAST(power(10, 4 - a.dp - b.dp) AS HUGEINT) - c.i * CAST(power(10, 4 - c.dp) AS HUGEINT)) <= CAST(power(10, 4 - c.dp) AS HUGEINT)) AS support,
           count(*) FILTER (WHERE a.v <> CASE WHEN a.dp = 2 THEN 100 ELSE 1 END AND b.v <> CASE WHEN b.dp = 2 THEN 100 ELSE 1 END
                            AND abs(a.i * b.i * CAST(power(10, 4 - a.dp - b.dp) AS HUGEINT) - c.i * CAST(power(10, 4 - c.dp) AS HUGEINT)) <= CAST(power(10, 4 - c.dp) AS HUGEINT)) AS discriminating
    FROM usable AS a JOIN usable AS b ON a.doc_id = b.doc_id AND a.page = b.page AND a.place = b.place AND a.position < b.position
         JOIN usable AS c ON a.doc_id = c.doc_id AND a.page = c.page AND a.place = c.place AND c.position NOT IN (a.position, b.position)
    GROUP BY a.doc_id, a.page, a.position, b.position, c.position
)
SELECT doc_id, page, a, b, c, support, CAST(checkable AS BIGINT) AS checkable, with_counting FROM met WHERE support >= 2 AND 2 * support > checkable AND 2 * support >= n AND discriminating >= 2
"""
)
def product_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns a and b whose product is c on enough rows."""
    return roles.product_triples(plan(spark, sf_dir).facts).select("doc_id", "page", "a", "b", "c", "support", F.col("checkable").cast("long").alias("checkable"), "with_counting")


@query(
    """
WITH drawn AS (SELECT o_orderkey, list_extract(['Item', '# ', 'Part No.', 'Product Code', 'Description:', 'Qty', 'UOM', 'Unit Price', 'Price or Total', 'Extended', 'Weight', 'Items'], CAST(o_orderkey % 12 AS INT) + 1) AS header, o_orderkey % 24 >= 12 AS beside FROM orders)
SELECT o_orderkey, header, CASE header WHEN 'Item' THEN CASE WHEN beside THEN 'itemNo' ELSE 'description' END WHEN 'Items' THEN CASE WHEN beside THEN 'itemNo' ELSE 'description' END WHEN '# ' THEN 'itemNo' WHEN 'Part No.' THEN 'code'
       WHEN 'Product Code' THEN 'code' WHEN 'Description:' THEN 'description' WHEN 'Qty' THEN 'quantity' WHEN 'UOM' THEN 'unit' WHEN 'Unit Price' THEN 'unitPrice' WHEN 'Extended' THEN 'lineTotal' END AS role, header = 'Price or Total' AS tie
FROM drawn
"""
)
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What twelve headings name, with and without a description column beside them."""
    drawn = ("Item", "# ", "Part No.", "Product Code", "Description:", "Qty", "UOM", "Unit Price", "Price or Total", "Extended", "Weight", "Items")
    header = F.element_at(F.array(*(F.lit(h) for h in drawn)), (F.col("o_orderkey") % 12).cast("int") + 1)
    said = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", header.alias("header"), (F.col("o_orderkey") % 24 >= 12).alias("beside"))
    return said.withColumn("o", T.header_opinion(F.col("header"), F.col("beside"))).select("o_orderkey", "header", "o.role", "o.tie")


@query(
    """
WITH drawn AS (SELECT c_custkey, list_extract(['Sub-Total', 'Total ex GST', 'GST (15%)', 'Grand Total:', 'Balance due', 'Total incl. GST', 'Total weight', 'Totals', 'Amount payable'], CAST(c_custkey % 9 AS INT) + 1) AS label FROM customer)
SELECT c_custkey, label, CASE label WHEN 'Sub-Total' THEN 'subtotal' WHEN 'Total ex GST' THEN 'subtotal' WHEN 'GST (15%)' THEN 'gst' WHEN 'Grand Total:' THEN 'total' WHEN 'Balance due' THEN 'amount_due' WHEN 'Total incl. GST' THEN 'total' WHEN 'Totals' THEN 'total' WHEN 'Amount payable' THEN 'amount_due' END AS kind,
       CASE label WHEN 'Total ex GST' THEN 'exclusive' WHEN 'Total incl. GST' THEN 'inclusive' END AS basis, label IN ('Sub-Total', 'Total ex GST', 'GST (15%)', 'Total incl. GST', 'Total weight', 'Totals', 'Balance due', 'Grand Total:', 'Amount payable') AS begins
FROM drawn
"""
)
def totals_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and tax basis of nine labels of printed totals, and whether a row that begins so is one."""
    drawn = ("Sub-Total", "Total ex GST", "GST (15%)", "Grand Total:", "Balance due", "Total incl. GST", "Total weight", "Totals", "Amount payable")
    label = F.element_at(F.array(*(F.lit(x) for x in drawn)), (F.col("c_custkey") % 9).cast("int") + 1)
    said = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", label.alias("label"))
    return said.select("c_custkey", "label", T.totals_kind(F.col("label")).alias("kind"), T.gst_basis(F.col("label")).alias("basis"), T.starts_with_total(F.col("label")).alias("begins"))


@query(
    """
SELECT p_partkey, list_extract(['-----', '= = =', '--', '$$$$', '*** total ***', '... … ...', '', '_ _', '12'], CAST(p_partkey % 9 AS INT) + 1) AS text, p_partkey % 9 IN (0, 1, 5, 7) AS drawn FROM part
"""
)
def separator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of nine texts are drawn lines: three marks or more, and no money sign."""
    forms = ("-----", "= = =", "--", "$$$$", "*** total ***", "... … ...", "", "_ _", "12")
    text = F.element_at(F.array(*(F.lit(x) for x in forms)), (F.col("p_partkey") % 9).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text")).withColumn("drawn", T.is_separator(F.col("text")))


@query(
    """
WITH said AS (SELECT o_orderkey, CAST(o_orderkey % 6 AS INT) AS v, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS n FROM orders)
SELECT o_orderkey, CASE v WHEN 0 THEN '$' || n || '.00' WHEN 1 THEN 'US$' || n WHEN 2 THEN n || ' €' WHEN 3 THEN 'EUR ' || n WHEN 4 THEN n || ' nzd' ELSE '£' || n END AS text,
       CASE v WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'EUR' WHEN 5 THEN 'GBP' END AS currency
FROM said
"""
)
def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency that a printed amount names; a bare $ names none."""
    n = (F.col("o_orderkey") % 900 + 100).cast("string")
    forms = (("$", ".00"), ("US$", ""), ("", " €"), ("EUR ", ""), ("", " nzd"), ("£", ""))
    text = F.element_at(F.array(*(F.concat(F.lit(a), n, F.lit(b)) for a, b in forms)), (F.col("o_orderkey") % 6).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("text")).select("o_orderkey", "text", N.currency_code(N.analyse(F.col("text"))["marker"]).alias("currency"))


@query(
    LINES
    + """
, mentions AS (SELECT doc_id, page, place, quantity, quantity || ' crates on pallet ' || line_no AS line FROM lines),
firsts AS (SELECT doc_id, quantity, min(page * 1000 + place) AS spot FROM mentions GROUP BY doc_id, quantity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM firsts),
quoted AS (SELECT doc_id, max(n) AS n, string_agg(quantity || ' crates (page ' || spot // 1000 || ')', ', ' ORDER BY spot) AS listed, list(quantity || ' crates' ORDER BY spot) AS texts, list(spot // 1000 ORDER BY spot) AS spot FROM ranked WHERE r <= 5 GROUP BY doc_id),
kept AS (
    SELECT m.doc_id, m.page, m.place, m.line, row_number() OVER (PARTITION BY m.doc_id ORDER BY CASE WHEN r.r <= 5 THEN 0 ELSE 1 END, m.page, m.place) AS seat
    FROM mentions AS m LEFT JOIN ranked AS r ON m.doc_id = r.doc_id AND m.page * 1000 + m.place = r.spot
), shown AS (SELECT doc_id, string_agg(line, '|' ORDER BY page, place) AS evidence FROM kept WHERE seat <= 5 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 2 THEN 'The document says ' || texts[1] || ' in one place (page ' || spot[1] || ') and ' || texts[2] || ' in another (page ' || spot[2] || '). We can''t tell which one is right.'
       ELSE 'The document gives different figures: ' || regexp_replace(listed, ', ([^,]*)$', ' and \\1') || '. We can''t tell which one is right.' END AS message, evidence
FROM quoted JOIN shown USING (doc_id) WHERE n >= 2
"""
)
def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five figures of each order's pallets that don't agree, and five of their lines at most."""
    line = F.concat(F.col("quantity").cast("string"), F.lit(" crates on pallet "), F.col("line_no").cast("string"))
    texts = order_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select("doc_id", "page", F.col("place").alias("row"), line.alias("line"), F.lit(0).alias("part"), line.alias("text"))
    found = conflicts.mentions(texts).filter("word = 'crate'")
    return conflicts.conflicting_figures(found).select("doc_id", "message", F.array_join("evidence.line", "|").alias("evidence"))
