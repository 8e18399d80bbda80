import pytest
from pyspark.sql import functions as F

from lonetext.functions import text as tx


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn.alias("out")).first().out


@pytest.mark.parametrize("text, expected", [
    ("#REDIRECT [[Lisboa]]", True), ("x #redirect [[a]] y", True), ("#redirect [a]", False), ("", False),
    (None, False), ("#redirect [[a\nb]]", False), ("#redirect [[a b]]", True)])
def test_redirect(spark, text, expected):
    assert one(spark, text, tx.is_redirect("text")) is expected


def test_categories(spark):
    text = "a [[Categoria:Cultura]] b [[categoria:Economia|x]] [[Categoria:]]"
    assert one(spark, text, tx.categories("text")) == ["Cultura", "Economia|x", ""]
    assert one(spark, text, tx.without("text", tx.CATEGORY)) == "a  b  "


@pytest.mark.parametrize("cats, expected", [
    (["Cultura", "economia do Brasil"], "Economia"), (["Esporte"], None), ([], None),
    (["POLÍTICA externa", "Saúde"], "Política"), (["ciência e tecnologia"], "Ciência e tecnologia")])
def test_priority(spark, cats, expected):
    df = spark.createDataFrame([(cats,)], "c array<string>")
    assert df.select(tx.main_category(F.col("c")).alias("out")).first().out == expected


def test_templates_and_dates(spark):
    text = "{{Data|1 de maio}}{{fonte|x|y}}{{Fontes|z}}t"
    assert one(spark, text, tx.dates("text")) == ["1 de maio"]
    assert one(spark, text, tx.without("text", tx.SOURCE)) == "{{Data|1 de maio}}{{Fontes|z}}t"


@pytest.mark.parametrize("text, expected", [
    ("'''Bold''' and ''it''", "Bold and it"), ("[[a|b]] [[c]]", "b c"), ("[https://x.org/y site]", "site"),
    ("[http://x.org]z", "z"), ("a<ref name='q'>x\ny</ref>b<br/>c<!-- d\ne -->", "abc"), ("a<ref name='q' />b", "ab"),
    ("{{a|{{b|{{c}}}}}}d", "d"), ("== Title ==\ntext", "Title\ntext"), (" \n x \t", "x")])
def test_markup(spark, text, expected):
    assert one(spark, text, tx.strip_markup(F.col("text"))) == expected


@pytest.mark.parametrize("text, expected", [
    ("{{a{{b{{c{{d}}}}}}}} z", "z"), ("{{x|{y}|z}}w", "w"), ("{| class=t\n|-\n| a || b\n|}after", "after"),
    ("{|\n| {| inner |} |}x", "x"), ("a {b} c", "a {b} c"), ("{{open", "{{open"), ("{{a" * 50 + "x" + "}}" * 50 + "y", "y"),
    ("price 3 < 5 apples and\n then many words 7 > 2 end", "price 3 < 5 apples and\n then many words 7 > 2 end"),
    ("a&nbsp;b &amp;lt; &lt;c&gt;", "a b &lt; <c>"), ("if a<b then<br>c</br >d", "if a<b thencd")])
def test_markup_that_nests_and_text_that_looks_like_it(spark, text, expected):
    assert one(spark, text, tx.strip_markup(F.col("text"))) == expected


@pytest.mark.parametrize("text, kept", [("", False), (" \t\n 　", False), (" a ", True)])
def test_not_empty(spark, text, kept):
    assert one(spark, text, tx.not_empty("text")) is kept


def test_column_detection(spark):
    df = spark.createDataFrame([(1, "t", 3, "l")], "row_id long, body string, n int, kind string")
    assert tx.text_and_label(df, "row_id") == ("body", "kind")
    assert tx.text_and_label(df.withColumnsRenamed({"n": "label", "kind": "text"}), "row_id") == ("text", "label")


def test_as_corpus(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], 0), (2, None, 1)], "row_id long, text array<string>, label int")
    assert [tuple(r) for r in tx.as_corpus(df, "row_id").collect()] == [(1, "a None b", 0)]
    numbers = spark.createDataFrame([(1, 12, 0)], "row_id long, text int, label int")
    assert tx.as_corpus(numbers, "row_id").first().text == "12"


def test_costly_text_work_runs_once_and_after_the_cheap_filters(spark):
    pages = spark.createDataFrame([(1, 0, "x [[Categoria:Cultura]]")], "row_id long, ns int, text string")
    plan = tx.wiki_articles(pages, "row_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<!--.*?-->") <= 2  # once in the tree, once in the generator's output line
    assert tx.wiki_articles(pages, "row_id").first().asDict() == {"row_id": 1, "text": "x", "label": "Cultura"}


def test_many_and_long_templates(spark):
    import time

    long = "".join(f"{{{{t{i}|x {{y}} {{{{z}}}}}}}} word{i} {{| a || {i} |}}" for i in range(10_000))
    assert one(spark, "{{warm}}", tx.strip_markup(F.col("text"))) == ""
    start = time.time()
    got = one(spark, long, tx.strip_markup(F.col("text")))
    assert got.split() == [f"word{i}" for i in range(10_000)] and time.time() - start < 5
    assert one(spark, "a {{" + "{x} y}z " * 50_000 + "}} b", tx.strip_markup(F.col("text"))) == "a  b"
    deep = "{{a" * 300 + "x" + "}}" * 300
    assert one(spark, deep + "y" + "{|" * 300 + "|}" * 300, tx.strip_markup(F.col("text"))) == "y"
