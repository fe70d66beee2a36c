"""What keeps the stages of a plan cheap: values worked out once, headings looked up, and no cell written twice."""

import pyarrow as pa
import pytest
from folioframe.functions import lexicon as X
from folioframe.functions import text as T
from folioframe.operators import items
from folioframe.operators import layout as L
from pyspark.sql import functions as F


def test_a_value_named_often_takes_no_item_out_of_a_mapped_array(spark):
    """Such an item's type and nullability would be worked out anew for each row, through all that is nested in it."""
    nested = T.let(F.col("id"), lambda a: T.let(a + 1, lambda b: T.let(a * b, lambda c: F.when(c > 3, a + b + c))))
    made = spark.range(4).select(nested.alias("v"))
    assert [r["v"] for r in made.collect()] == [None, None, 11, 19]
    assert "transform(" not in made._jdf.queryExecution().analyzed().toString()
    assert [r["v"] for r in spark.range(1).select(T.let(F.lit(None).cast("string"), lambda t: F.coalesce(t, F.lit("none"))).alias("v")).collect()] == ["none"]


@pytest.mark.parametrize("beside", [True, False])
def test_plain_headings_name_what_a_search_finds(spark, beside):
    """Each heading word and its plural, alone and with a word that means nothing, which sends it to the search."""
    plain = T._plain_headings()
    assert {w for words in X.HEADER_WORDS.values() for w in words} <= set(plain)
    rows = spark.createDataFrame([(h, role) for h, role in plain.items()], "h string, role string")
    told = rows.select("h", "role", T.header_opinion(F.col("h"), F.lit(beside)).alias("p"), T.header_opinion(F.concat(F.col("h"), F.lit(" qqq")), F.lit(True)).alias("s")).collect()
    for r in told:
        assert not r["p"]["tie"] and r["s"]["role"] == r["role"]
        assert r["p"]["role"] == ("description" if r["h"] in ("item", "items") and not beside else r["role"])


def test_a_judged_row_holds_each_cell_whole_only_once(spark):
    """Beside the row's cells, each of some 15 values, stand only those that are read later on."""
    cell = "struct<position:int,header:string,key:string,role:string,text:string,start:int,stop:int,parts:struct<marker:string,per:string>,reading:struct<status:string,value:double,dp:int,other:double>,problem:string>"
    names = ("problem", "quantity", "price", "total", "description", "price_cell", "total_cell")
    kept = spark.createDataFrame([], ", ".join(f"{n} {cell}" for n in names)).select(*items._used()).schema
    assert kept.simpleString().count(":") < 40 and {f.name for f in kept} == set(names) - {"price_cell"}


@pytest.mark.parametrize("column", [pa.array([1.5, 2.0]), pa.array([1.5, None]), pa.array([1, 2], pa.int64()), pa.array([None, 3], pa.int32()), pa.array(["a", "ä b"]), pa.array(["a", None]), pa.array([], pa.string())])
def test_columns_are_read_as_plain_values(column):
    found = L.values_of(column)
    assert found == column.to_pylist() and [type(v) for v in found] == [type(v) for v in column.to_pylist()]


def test_a_cell_on_an_edge_is_at_no_distance():
    track = L.Track(L.Cell("a", 10, 20), L.Cell("b", 10, 30))
    assert [track.distance(L.Cell("c", *at)) for at in ((10, 99), (0, 30), (14, 26), (12, 26))] == [0, 0, 0, 1]
