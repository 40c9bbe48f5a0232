import pytest
from pyspark.sql import functions as F

from graphloom.extract.base import node_id as plain_id
from graphloom.functions import text as tx
from graphloom.operators.retrieve import header_cost, tokens_of

TOKENS = {
    "JWTMiddleware": ["jwt", "middleware"], "snake_case": ["snake", "case"], "HTTPServer2Go": ["http", "server2go"], "naïve": ["na", "ve"], "": [], "a b": [], "authenticateUser": ["authenticate", "user"],
    "XMLHttpRequest": ["xml", "http", "request"],
}


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", TOKENS)
def test_tokenize(spark, text):
    assert one(spark, tx.tokenize(F.col("t")), t=text) == TOKENS[text] == tokens_of(text)


def test_costs_count_utf16_units(spark):
    assert one(spark, tx.utf16_length(F.col("t")), t="a😀") == 3
    assert [one(spark, tx.token_cost(F.col("t")), t=t) for t in ("", "a", "abcd", "abcde", "😀😀")] == [0, 1, 1, 2, 1]
    assert header_cost("quantum chromodynamics meson decay", 1000) == 21


@pytest.mark.parametrize(("path", "name", "want"), [("src/a.b.ts", "x.y()", "src_a.b_x_y__"), ("a", "file", "a_file"), (r"a\b.js", "$k", "a_b_$k"), ("d.x/y", "n", "d_n")])
def test_node_id(spark, path, name, want):
    assert one(spark, tx.node_id(F.col("p"), F.col("n")), p=path, n=name) == plain_id(path, name) == want


def test_escape_extension_rounding(spark):
    assert one(spark, tx.escape_html(F.col("t")), t="<a href=\"x\">'&</script>") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&lt;/script&gt;"
    assert [one(spark, tx.extension(F.col("t")), t=t) for t in ("a/b.TS", "a.b/c", ".x", "a.tar.gz")] == [".TS", "", ".x", ".gz"]
    assert spark.range(1).select(tx.round3(F.lit(0.0005)), tx.round3(F.lit(0.12349))).first() == (0.001, 0.123)
    assert one(spark, tx.one_line(F.col("t")), t="  a\n\tb  c ") == "a b c"


def test_two_decimals(spark):
    """Every thousandth, against exact decimals of the binary value, ties up."""
    from decimal import ROUND_HALF_UP, Decimal

    from graphloom.functions.text import two_decimals

    got = spark.range(1001).select(two_decimals(F.col("id") / 1000).alias("s"), "id").collect()
    assert all(r["s"] == str(Decimal(r["id"] / 1000).quantize(Decimal("0.01"), ROUND_HALF_UP)) for r in got)
