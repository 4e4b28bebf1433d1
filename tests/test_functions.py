"""Literal cases of the scalar functions and of comparison."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loamwork.functions import compare, text


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + (kind if " " in kind else f"x {kind}"))
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_parse_money(spark):
    got = values(spark, ["£51.77", "1,299.00", "51.", "-3 x", "abc", "", None], text.parse_money(F.col("x")))
    assert got == [Decimal("51.77"), Decimal("1299"), Decimal("51"), Decimal("-3"), None, None, None]


def test_clean_text(spark):
    assert values(spark, [" a\t b\n", " a  b", "", None], text.clean_text(F.col("x"))) == ["a b", "a b", "", None]


@pytest.mark.parametrize("href,want", [("/p", "https://a.com/p"), ("../a", "https://a.com/a"), ("?q", "https://a.com/x/y?q"), ("#f", "https://a.com/x/y#f"), ("http://b.org/z", "http://b.org/z"), ("", None), (None, None)])
def test_absolutize(spark, href, want):
    assert values(spark, [("https://a.com/x/y", href)], text.absolutize(F.col("b"), F.col("h")), "b string, h string") == [want]
    if href is None or href == "" or href[0] in "/h":
        assert values(spark, [("https://a.com/x/y", href)], text.absolutize_rooted(F.col("b"), F.col("h")), "b string, h string") == [want]


def test_urls(spark):
    urls = ["HTTP://User@WWW.Ex.com:80/a-b/c?x", "https://h.org", "nonsense", None]
    assert values(spark, urls, text.host(F.col("x"))) == ["www.ex.com", "h.org", "", None]
    assert values(spark, urls[:2], text.derive_family(F.col("x"))) == ["www.ex.com/a-b", "h.org"]
    assert values(spark, urls[:2], text.derive_pattern(F.col("x"))) == [r"^https?://www\.ex\.com.*/a\-b(/|$)", r"^https?://h\.org"]


def test_slugs(spark):
    assert values(spark, ["a.com/p q", "a/b", "a__b", "..."], text.slug(F.col("x"))) == ["a_com__pq", "a__b", "a__b", "___"]
    one, two = values(spark, ["a/b", "a__b"], text.family_dir(F.col("x")))
    assert one != two and one[:5] == two[:5] == "a__b-"
    assert values(spark, ["books.x/list-a"], text.class_name(F.col("x"))) == ["BooksXListACrawler"]


def test_trim_html_hoists_data(spark):
    html = '<style>s</style><p>a  b</p><!-- c --><script>x</script><script type="application/json"> {"k": 1} </script>'
    assert values(spark, [html], text.trim_html(F.col("x"))) == ['[[STRUCTURED-DATA-JSON]] {"k": 1} [[HTML]] <p>a b</p>']
    assert values(spark, [html], text.trim_html(F.col("x"), 3, 30)) == ['[[STRUCTURED-DATA-JSON]] {"k": [[HTML]] <p>']
    assert values(spark, ["<p>" + "é" * 20], text.trim_html(F.col("x"), 5)) == ["<p>éé"]


def test_islands_skip_bad_json(spark):
    html = '<script type="application/json">{bad</script><script id="__NEXT_DATA__"></script><SCRIPT type="application/ld+json">[1]</SCRIPT>'
    assert values(spark, [html], text.json_islands(F.col("x"))) == [["[1]"]]


def test_fences(spark):
    assert values(spark, ["```json\n{}\n```", "{}"], text.strip_fences(F.col("x"))) == ["{}", "{}"]
    assert values(spark, ["a\n```python\nx = 1\n```\nb", "x"], text.code_block(F.col("x"))) == ["x = 1", "x"]


EQUAL = [
    ("null", None, "null", None, True), ("null", None, "str", "x", False), ("bool", "true", "num", "1", True), ("bool", "true", "str", "true", False),
    ("str", "£51.77", "num", "51.77", True), ("str", "Book 3", "str", "Page 3", True), ("str", "  a  b ", "str", "a b", True), ("str", "a", "str", "b", False), ("other", "[1]", "other", "[1]", True),
]


@pytest.mark.parametrize("ka,a,kb,b,want", EQUAL)
def test_field_equal(spark, ka, a, kb, b, want):
    column = compare.field_equal(F.col("ka"), F.col("a"), F.col("kb"), F.col("b"))
    assert values(spark, [(ka, a, kb, b)], column, "ka string, a string, kb string, b string") == [want]


def test_field_equal_strict_and_volatile(spark):
    args = [F.lit("str"), F.col("a"), F.lit("str"), F.col("b")]
    assert values(spark, [("Book 3", "Page 3")], compare.field_equal(*args, strict=True), "a string, b string") == [False]
    assert values(spark, [("1000000000.0", "1000000000.5")], compare.field_equal(*args, volatile=True), "a string, b string") == [True]
    assert values(spark, [("1000000000.0", "1000000000.5")], compare.field_equal(*args), "a string, b string") == [False]
