"""Which column is what: facts of columns, products among them, and what the headings say.

``grid`` gives one row for each body row and column. Facts are one
aggregation by column; everything after works on one row for each page, so
no further exchange is needed than the one that brings a page together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import messages as M
from ..functions import numbers as N
from ..functions import text as T
from ..functions.text import let

UNIT_CELL = r"^[\p{L}.]{1,10}$"
CODE_CELL = r"(?U)^\S{2,20}$"
MEASURE = r"(?U)^[0-9.,]+\s*\p{L}{1,3}$"
KEYS = ["doc_id", "page"]


def grid(layout: DataFrame) -> DataFrame:
    """doc_id, page, n, row, label, position, header, cell (null where there is none), parts and mask."""
    rows = layout.filter("columns is not null").select(*KEYS, "columns", F.explode("body").alias("b"))
    cells = rows.select(*KEYS, "b.n", "b.row", "b.label", F.col("b.cells").alias("own"), F.explode("columns").alias("c"))
    cell = F.get(F.filter("own", lambda x: x["position"] == F.col("c.position")), F.lit(0))
    out = cells.select(*KEYS, "n", "row", "label", F.col("c.position").alias("position"), F.col("c.header").alias("header"), F.col("c.kind").alias("kind"), cell.alias("cell"))
    parts = N.analyse(F.coalesce("cell.text", F.lit("")), F.coalesce("cell.joins", F.array().cast("array<int>")))
    return out.withColumn("parts", parts).withColumn("mask", N.valid_mask(F.col("parts")))


def page_conventions(cells: DataFrame) -> DataFrame:
    """doc_id, page, conventions: those that most number cells of number columns allow, ties kept."""
    filled = T.stripped(F.coalesce("cell.text", F.lit(""))) != ""
    columns = cells.groupBy(*KEYS, "position").agg(F.count_if(filled).alias("filled"), F.count_if(filled & (F.col("mask") > 0)).alias("valid"), *N.vote_bits(F.col("mask")))
    numeric = (F.col("filled") > 0) & (F.col("valid") >= X.NUMERIC_COLUMN_SHARE * F.col("filled"))
    votes = columns.groupBy(*KEYS).agg(*(F.sum(F.when(numeric, F.col(f"v{k}")).otherwise(0)).alias(f"v{k}") for k in range(len(X.CONVENTIONS))))
    return votes.select(*KEYS, N.voted_mask().alias("conventions"))


def first_mode(values: Column) -> Column:
    """The most frequent value, the first seen among equals."""

    def most(v: Column, d: Column) -> Column:
        ranked = F.transform(d, lambda x, i: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
        return F.array_max(ranked)["x"]

    return let(values, lambda v: let(F.array_distinct(v), lambda d: most(v, d)))


def column_facts(cells: DataFrame, conventions: DataFrame) -> DataFrame:
    """Facts of each column over the rows that don't begin with a total's label.

    ``reads`` are its numbers by row; ``counting`` says that they go up by one
    from 1 or more, without a currency.
    """
    read = cells.join(conventions, KEYS).withColumn("reading", N.read(F.col("parts"), F.col("conventions")))
    raw = T.stripped(F.coalesce("cell.text", F.lit("")))
    used = read.withColumn("raw", raw).withColumn("counts", ~T.starts_with_total(F.col("label")))
    seen = F.col("counts") & (F.col("raw") != "")
    listed = lambda value, when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(F.col("n"), value.alias("v"))))), lambda s: s["v"])
    ok = F.col("reading.status") == "ok"
    share = lambda test: F.coalesce(F.avg(F.when(seen, test.cast("int"))), F.lit(0.0))
    facts = used.groupBy(*KEYS, "position").agg(
        F.first("header").alias("header"),
        F.first("kind").alias("kind"),
        F.first("conventions").alias("conventions"),
        F.count_if("counts").alias("row_count"),
        F.count_if(seen).alias("filled"),
        (F.count_if(seen & (F.col("mask") > 0)) >= X.NUMERIC_COLUMN_SHARE * F.count_if(seen)).alias("mostly"),
        share(F.col("parts.percent")).alias("percent_share"),
        share(F.col("parts.marker").isNotNull()).alias("currency_share"),
        share(F.col("parts.per").isNotNull()).alias("per_share"),
        F.coalesce(F.avg(F.when(seen, F.length("raw"))), F.lit(0.0)).alias("mean_length"),
        share(F.col("raw").rlike(r"(?U)\s")).alias("space_share"),
        listed(F.col("raw"), seen).alias("texts"),
        listed(F.col("parts.marker"), seen & F.col("parts.marker").isNotNull()).alias("markers"),
        listed(F.struct(F.col("n"), F.col("reading.value").alias("value"), F.col("reading.dp").alias("dp"), F.col("reading.grouped").alias("grouped")), F.col("counts") & ok).alias("reads"),
        F.count_if(seen & ~ok).alias("unread"),
    )
    whole = F.forall("reads", lambda r: (r["dp"] == 0) & (r["value"] == F.floor(r["value"])))
    first = F.get("reads", F.lit(0))["value"]
    steps = F.forall(F.transform("reads", lambda r, i: r["value"] - i), lambda v: v == first)
    big = F.filter("reads", lambda r: F.abs(r["value"]) >= 1000)
    code = lambda t: t.rlike(CODE_CELL) & t.rlike("[0-9]") & t.rlike(r"[\p{L}-]") & ~t.rlike(MEASURE)
    return facts.select(
        *KEYS,
        "position",
        "header",
        "kind",
        "conventions",
        "row_count",
        "filled",
        ((F.col("filled") > 0) & F.col("mostly")).alias("numeric"),
        "percent_share",
        "currency_share",
        "per_share",
        "mean_length",
        "space_share",
        first_mode(F.col("markers")).alias("marker"),
        first_mode(F.transform("reads", lambda r: r["dp"])).alias("usual_dp"),
        ((F.col("filled") > 0) & F.col("mostly") & (F.col("percent_share") < X.PERCENT_SHARE)).alias("is_number"),
        (F.col("currency_share") >= X.MARKED_SHARE).alias("marked"),
        F.coalesce((F.col("filled") >= 2) & (F.col("currency_share") == 0) & (F.col("unread") == 0) & whole & (first >= 1) & steps, F.lit(False)).alias("steps_up"),
        F.size(big).alias("big"),
        F.size(F.filter(big, lambda r: r["grouped"])).alias("grouped"),
        F.size("texts").alias("n_texts"),
        F.forall("texts", lambda t: t.rlike(UNIT_CELL)).alias("all_units"),
        (F.forall("texts", code) & (F.size(F.array_distinct("texts")) == F.size("texts"))).alias("all_codes"),
        F.transform("reads", lambda r: F.struct(r["n"].alias("n"), r["value"].alias("value"), r["dp"].alias("dp"))).alias("reads"),
    )


def product_triples(facts: DataFrame) -> DataFrame:
    """doc_id, page, a, b, c and their counts: columns whose product a x b is c on enough rows.

    The numbers of a row meet inside that row, so no join of cells with cells
    is needed: each row gives its own pairs, and of the columns only those
    that a pair makes. On how many rows all three have numbers is counted
    for the triples that are left.
    """
    numbers = facts.filter("is_number").select(*KEYS, "position", "row_count", "steps_up", F.filter("reads", lambda r: r["value"] != 0).alias("reads"))
    rows = numbers.select(*KEYS, "position", F.explode("reads").alias("r")).groupBy(*KEYS, "r.n").agg(F.sort_array(F.collect_list(F.struct(F.col("position").alias("p"), F.col("r.value").alias("v"), F.col("r.dp").alias("dp")))).alias("x"))
    pairs = rows.select(*KEYS, "x", F.explode("x").alias("a")).select("*", F.explode(F.filter("x", lambda b: b["p"] > F.col("a.p"))).alias("b")).withColumn("product", F.col("a.v") * F.col("b.v"))
    fits = F.filter("x", lambda c: (c["p"] != F.col("a.p")) & (c["p"] != F.col("b.p")) & (F.abs(F.col("product") - c["v"]) <= F.pow(F.lit(10.0), -c["dp"]) + 1e-9))
    made = pairs.select(*KEYS, "a", "b", F.explode(fits).alias("c"))
    found = made.groupBy(*KEYS, F.col("a.p").alias("a"), F.col("b.p").alias("b"), F.col("c.p").alias("c")).agg(F.count(F.lit(1)).alias("support"), F.count_if((F.col("a.v") != 1) & (F.col("b.v") != 1)).alias("discriminating"))
    entry = F.struct(F.transform("reads", lambda r: r["n"]).alias("ns"), F.col("steps_up").alias("counting"))
    columns = numbers.groupBy(*KEYS).agg(F.first("row_count").alias("row_count"), F.map_from_entries(F.collect_list(F.struct("position", entry.alias("e")))).alias("of"))
    at = lambda p: F.col("of")[F.col(p)]
    shared = F.size(F.array_intersect(F.array_intersect(at("a")["ns"], at("b")["ns"]), at("c")["ns"]))
    counted = found.filter(F.col("support") >= 2).join(columns, KEYS).withColumn("checkable", shared).withColumn("with_counting", at("a")["counting"] | at("b")["counting"] | at("c")["counting"]).drop("of")
    return counted.filter((F.col("support") >= 2) & (2 * F.col("support") > F.col("checkable")) & (2 * F.col("support") >= F.col("row_count")) & (F.col("discriminating") >= X.MIN_DISCRIMINATING_ROWS))


def _more_like_total(other: Column, total: Column) -> Column:
    """Whether another number column could rather be the total: it alone is marked, or it is as precise and never smaller."""

    def never_smaller(both: Column) -> Column:
        return (F.size(both) >= 2) & F.forall(both, lambda x: x)

    pairs = F.filter(F.transform(other["reads"], lambda o: F.get(F.transform(F.filter(total["reads"], lambda t: t["n"] == o["n"]), lambda t: o["value"] >= t["value"]), F.lit(0))), lambda x: x.isNotNull())
    precise = F.coalesce(other["usual_dp"] >= total["usual_dp"], F.lit(False))
    return ~total["marked"] & (other["marked"] | (precise & let(pairs, never_smaller)))


def _price_and_quantity(a: Column, b: Column, c: Column) -> Column:
    """struct(price, quantity) positions: the price shares the total's currency marker, or else its grouped thousands."""

    def as_price(x: Column, y: Column) -> Column:
        return F.struct(x["position"].alias("price"), y["position"].alias("quantity"))

    shares = lambda x, y: c["marked"] & x["marked"] & (x["marker"] == c["marker"]) & (y["currency_share"] == 0)
    all_grouped = lambda x: (x["big"] > 0) & (x["grouped"] == x["big"])
    grouped = lambda x, y: all_grouped(c) & all_grouped(x) & (y["big"] > 0) & (y["grouped"] == 0)
    return F.when(shares(a, b), as_price(a, b)).when(shares(b, a), as_price(b, a)).when(grouped(a, b), as_price(a, b)).when(grouped(b, a), as_price(b, a))


def infer_from_numbers(facts: DataFrame, triples: DataFrame) -> DataFrame:
    """One row for each page: its columns' facts in order (cols), what the numbers say of each (numbers_say)."""
    cols = F.sort_array(F.collect_list(F.struct("position", *(c for c in facts.columns if c not in (*KEYS, "position", "conventions", "row_count")))))
    pages = facts.groupBy(*KEYS).agg(F.first("conventions").alias("conventions"), F.first("row_count").alias("row_count"), cols.alias("cols"))
    found = triples.groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b", "c", "with_counting")).alias("found"))
    joined = pages.join(found, KEYS, "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<a:int,b:int,c:int,with_counting:boolean>>")))
    counts = F.col("cols")
    plain = F.filter("found", lambda t: ~t["with_counting"])
    pool = joined.withColumn("pool", F.when(F.size(plain) > 0, plain).otherwise(F.col("found")))
    at = lambda p: F.get(F.filter("cols", lambda c: c["position"] == p), F.lit(0))
    only = F.when(F.size("pool") == 1, F.get("pool", F.lit(0)))
    chosen = pool.withColumn("triple", only).withColumn("total", at(F.col("triple.c"))).withColumn("fa", at(F.col("triple.a"))).withColumn("fb", at(F.col("triple.b")))
    rival = F.exists("cols", lambda o: o["is_number"] & (o["position"] != F.col("triple.a")) & (o["position"] != F.col("triple.b")) & (o["position"] != F.col("triple.c")) & _more_like_total(o, F.col("total")))
    trusted = chosen.withColumn("trusted", F.col("triple").isNotNull() & ~F.coalesce(rival, F.lit(False)))
    one_counts = F.col("fa.steps_up") != F.col("fb.steps_up")
    counted = F.struct(F.when(F.col("fa.steps_up"), F.col("triple.b")).otherwise(F.col("triple.a")).alias("price"), F.lit(None).cast("int").alias("quantity"))
    sides = F.when(one_counts, counted).when(~F.col("fa.steps_up"), _price_and_quantity(F.col("fa"), F.col("fb"), F.col("total")))
    sided = trusted.withColumn("sides", F.when(F.col("trusted"), sides))
    per_unit = F.filter("cols", lambda c: c["is_number"] & c["marked"] & (c["per_share"] >= X.MARKED_SHARE))
    is_factor = lambda c: F.col("trusted") & ((c["position"] == F.col("triple.a")) | (c["position"] == F.col("triple.b")))
    product = lambda c: (
        F.when(F.col("trusted") & (c["position"] == F.col("triple.c")), "lineTotal")
        .when(c["position"] == F.col("sides.price"), "unitPrice")
        .when(c["position"] == F.col("sides.quantity"), "quantity")
        .when((F.size("pool") == 0) & (F.size(per_unit) == 1) & (F.get(per_unit, F.lit(0))["position"] == c["position"]), "unitPrice")
    )
    first = sided.withColumn("says", F.transform(counts, product))
    role = lambda c: F.get("says", c["position"])
    sequences = F.filter("cols", lambda c: c["is_number"] & c["steps_up"] & role(c).isNull() & ~F.coalesce(is_factor(c), F.lit(False)))
    second = first.withColumn("sequences", sequences).withColumn("says", F.transform("cols", lambda c: F.coalesce(role(c), F.when((F.size("sequences") == 1) & (F.get("sequences", F.lit(0))["position"] == c["position"]), "itemNo"))))
    texts = F.filter("cols", lambda c: role(c).isNull() & ~c["numeric"] & (c["percent_share"] < X.PERCENT_SHARE) & (c["filled"] > 0))
    third = second.withColumn("texts", texts).withColumn("phrases", F.filter("texts", lambda c: (c["mean_length"] >= X.DESCRIPTION_MIN_LENGTH) & (c["space_share"] >= 0.5)))
    phrase = F.get("phrases", F.lit(0))
    longest = (F.size("phrases") == 1) & F.forall("texts", lambda c: (c["position"] == phrase["position"]) | (phrase["mean_length"] >= X.DESCRIPTION_LENGTH_RATIO * c["mean_length"]))
    is_text = lambda c: F.exists("texts", lambda t: t["position"] == c["position"])
    named = F.transform(
        "cols",
        lambda c: F.coalesce(
            role(c),
            F.when(F.coalesce(longest & (phrase["position"] == c["position"]), F.lit(False)), "description")
            .when(is_text(c) & (c["n_texts"] >= 2) & c["all_units"], "unit")
            .when(is_text(c) & (c["n_texts"] >= 2) & c["all_codes"], "code"),
        ),
    )
    return third.withColumn("numbers_say", named).select(*KEYS, "conventions", "row_count", "cols", "numbers_say")


def _is_number_role(role: Column) -> Column:
    return F.coalesce(role.isin(*X.NUMBER_ROLES), F.lit(False))


def decide_roles(inferred: DataFrame, layout: DataFrame) -> DataFrame:
    """One row for each page with a table: columns (with role and source), refusal (code, message) and notes.

    Where numbers and heading agree or only one speaks, it holds. A heading
    beats the numbers for a text role; for a number role the page is refused.
    A number role held twice refuses the page too; a text role held twice
    stays with the one column that its heading names.
    """
    page = F.col("page")
    beside = F.exists("said", lambda w: F.coalesce(w["role"] == "description", F.lit(False)))
    opinions = T.let(beside, lambda other: F.transform("said", lambda w: T.opinion_beside(w, other)))
    heads = inferred.withColumn("said", F.transform("cols", lambda c: T.heading_words(c["header"]))).withColumn("heads", opinions).drop("said")

    def meet(c: Column, i: Column) -> Column:
        said, head = F.get("numbers_say", i), F.get("heads", i)["role"]
        clash = said.isNotNull() & head.isNotNull() & (said != head)
        disputed = F.coalesce(clash & _is_number_role(said), F.lit(False))
        role = F.when(disputed, None).when(clash, head).otherwise(F.coalesce(said, head))
        source = F.when(disputed, None).when(clash, "header").when(said.isNotNull() & head.isNotNull(), "both").when(said.isNotNull(), "numbers").when(head.isNotNull(), "header")
        return F.struct(c["position"].alias("position"), c["header"].alias("header"), c["kind"].alias("kind"), role.alias("role"), source.alias("source"), disputed.alias("disputed"), said.alias("said"), head.alias("head"))

    met = heads.withColumn("met", F.transform("cols", meet)).withColumn("clash", F.get(F.filter("met", lambda m: m["disputed"]), F.lit(0)))
    holders = lambda role: F.filter("met", lambda m: m["role"] == role)
    twice = F.get(F.filter("met", lambda m: _is_number_role(m["role"]) & (F.size(holders(m["role"])) > 1)), F.lit(0))["role"]
    known = met.withColumn("twice", twice).withColumn("ambiguous", F.col("clash").isNotNull() | F.col("twice").isNotNull())

    def settle(m: Column) -> Column:
        same = holders(m["role"])
        named = F.filter(same, lambda s: s["source"] != "numbers")
        keeps = (F.size(same) == 1) | ((F.size(named) == 1) & (F.get(named, F.lit(0))["position"] == m["position"]))
        role = F.when(_is_number_role(m["role"]), F.when(~F.col("ambiguous"), m["role"])).when(F.coalesce(keeps, F.lit(False)), m["role"])
        return F.struct(
            m["position"].alias("position"),
            m["header"].alias("header"),
            m["kind"].alias("kind"),
            role.alias("role"),
            F.when(role.isNotNull(), m["source"]).alias("source"),
            m["said"].alias("said"),
            m["head"].alias("head"),
        )

    settled = known.withColumn("columns", F.transform("met", settle))
    none = ~F.exists("columns", lambda c: _is_number_role(c["role"]))
    code = F.when(F.col("ambiguous"), "AMBIGUOUS_COLUMNS").when(none, "COLUMN_MEANING_UNKNOWN")
    label = lambda c: F.when(F.coalesce(c["header"], F.lit("")) != "", F.concat(F.lit("the '"), c["header"], F.lit("' column"))).otherwise(F.concat(F.lit("column "), (c["position"] + 1).cast("string")))
    name = lambda c: F.when(F.coalesce(c["header"], F.lit("")) != "", F.concat(F.lit("'"), c["header"], F.lit("'"))).otherwise(F.concat(F.lit("column "), (c["position"] + 1).cast("string")))
    same = holders(F.col("twice"))
    message = (
        F.when(F.col("clash").isNotNull(), M.refusal("AMBIGUOUS_COLUMNS.numbersVsHeader", page=page, column=label(F.col("clash")), numbers=M.role_word(F.col("clash.said"), True), heading=M.role_word(F.col("clash.head"))))
        .when(F.col("twice").isNotNull(), M.refusal("AMBIGUOUS_COLUMNS.sameRole", page=page, count=M.count_word(F.size(same)), role=M.role_word(F.col("twice")), columns=T.listed(F.transform(same, name))))
        .when(none, M.refusal("COLUMN_MEANING_UNKNOWN", page=page))
    )

    def column_note(c: Column) -> Column:
        follows = (c["source"] == "header") & c["said"].isNotNull()
        return (
            F.when(c["role"].isNotNull() & follows, M.note("headingFollowed", page=page, text=c["header"], looks=M.role_word(c["said"], True), role=M.role_word(c["head"])))
            .when(c["role"].isNotNull() & (c["source"] == "header"), M.note("headerOnlyRole", page=page, text=c["header"], role=F.concat(F.lit("the "), M.role_word(c["role"]))))
            .when(c["role"].isNull() & c["header"].isNotNull(), M.note("columnNotRead", page=page, text=c["header"]))
        )

    ties = F.transform(F.filter(F.arrays_zip(F.col("cols.header").alias("header"), F.col("heads.tie").alias("tie")), lambda z: F.coalesce(z["tie"], F.lit(False))), lambda z: M.note("headingTwoMeanings", page=page, text=z["header"]))
    recognised = F.exists("heads", lambda h: F.coalesce(h["role"].isNotNull() | h["tie"], F.lit(False)))
    headless = layout.select(*KEYS, (F.size("header_rows") == 0).alias("headless"))
    empty = F.array().cast("array<struct<code:string,level:string,text:string>>")
    with_heads = settled.join(headless, KEYS)
    page_note = F.when(F.col("headless"), F.array(M.note("noHeadings", page=page))).when(~recognised, F.array(M.note("unknownHeadings", page=page))).otherwise(empty)
    column_notes = F.when(F.col("ambiguous"), empty).otherwise(F.filter(F.transform("columns", column_note), lambda n: n.isNotNull()))
    keys = F.transform("columns", lambda c: F.struct(c["position"].alias("position"), c["header"].alias("header"), T.column_key(c["header"], c["position"]).alias("key"), c["kind"].alias("kind"), c["role"].alias("role"), c["source"].alias("source")))
    return with_heads.select(*KEYS, "conventions", keyed(keys).alias("columns"), code.alias("refusal"), message.alias("message"), F.concat(column_notes, ties, page_note).alias("notes"))


def keyed(columns: Column) -> Column:
    """The columns with keys made unique: a key that is taken gets 2, 3, ... until it is free."""

    def add(done: Column, c: Column) -> Column:
        taken = F.transform(done, lambda d: d["key"])
        options = F.concat(F.array(c["key"]), F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda i: F.concat(c["key"], i.cast("string"))))
        free = F.get(F.filter(options, lambda k: ~F.array_contains(taken, k)), F.lit(0))
        return F.concat(done, F.array(c.withField("key", free)))

    return F.aggregate(columns, F.filter(columns, lambda c: F.lit(False)), add)
