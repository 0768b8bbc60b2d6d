import datetime as dt

from pyspark.sql import functions as F

from quillmine.functions import records as r


def values(spark, column, rows, schema):
    return [x[0] for x in spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_keys(spark):
    rows = [("A Title", "10.1/X", dt.date(2020, 1, 2)), ("A Title", None, dt.date(2020, 1, 2)), ("B", None, None)]
    assert values(spark, r.paper_key(F.col("t"), F.col("d"), F.col("y")), rows, "t string, d string, y date") == ["DOI-10.1/X", "a title|2020", "b|"]
    assert values(spark, r.publication_key(F.col("t"), F.col("s"), F.col("b")), [("T", "1-X", "9"), ("T", None, "9A"), ("T", None, None)], "t string, s string, b string") == ["ISSN-1-x", "ISBN-9a", "TITLE-t"]


def test_months_and_dates(spark):
    assert values(spark, r.month(F.col("m")), [("december",), ("jan",), ("February",), ("7",), ("13",), ("x",), ("",)], "m string") == ["12", "01", "02", "07", "01", "01", "01"]
    got = values(spark, r.date_or_new_year(F.col("d"), "d MMM yyyy", F.col("y")), [("01 Mar 2020", "2019"), ("soon", "2019"), (None, None)], "d string, y string")
    assert got == [dt.date(2020, 3, 1), dt.date(2019, 1, 1), None]


def test_pages(spark):
    assert values(spark, r.page_range_count(F.col("p")), [("1-4",), ("1094-105",), ("e12",), ("a-b",), (None,)], "p string") == [4, 990, None, None, None]
    assert values(spark, r.page_count(F.col("a"), F.col("b"), signed=True), [("5", "2"), ("2", "5")], "a string, b string") == [-2, 4]


def test_names(spark):
    rows = [(["Dr Ann Lee", "B"], dt.date(1999, 1, 1), "Café: a tale"), ([], None, "X")]
    assert values(spark, r.citation_key(F.col("a"), F.col("d"), F.col("t")), rows, "a array<string>, d date, t string") == ["drannlee1999café", "unknownXXXXx"]
    assert values(spark, r.file_name(F.col("d"), F.col("t")), [(dt.date(1999, 1, 1), "Café/a-b")], "d date, t string") == ["1999-Café_a-b.pdf"]
    assert values(spark, r.category(F.col("c")), [("book series",), ("Journal of Books",), ("Conference",), ("newspaper article",), (None,)], "c string") == ["Book", "Journal", "Conference Proceedings", None, None]


def test_addresses(spark):
    assert values(spark, r.host(F.col("u")), [("https://www.A.org:8/x",), ("ftp://u@b.org",), ("none",), (None,)], "u string") == ["a.org", "b.org", None, None]
    cases = {
        "https://dl.acm.org/doi/10.1/2": "https://dl.acm.org/doi/pdf/10.1/2",
        "https://ieeexplore.ieee.org/document/77/": "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=77",
        "https://ieeexplore.ieee.org/x?arnumber=5&y=1": "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=5",
        "https://ieeexplore.ieee.org/x": None,
        "https://link.springer.com/article/10.1%2F3": "https://link.springer.com/content/pdf/10.1/3.pdf",
        "https://www.ijcai.org/p/12": "https://www.ijcai.org/p/0012.pdf",
        "https://www.mdpi.com/1": "https://www.mdpi.com/1/pdf",
        "https://nowhere.org/1": None,
    }
    assert values(spark, r.pdf_url(F.col("u"), F.lit(None).cast("string")), [(u,) for u in cases], "u string") == list(cases.values())
    assert values(spark, r.pdf_url(F.col("u"), F.lit("10.9/z")), [("https://dl.acm.org/x",)], "u string") == ["https://dl.acm.org/doi/pdf/10.9/z"]


def test_collections(spark):
    assert values(spark, r.split_keywords(F.col("k")), [(" a, b;c ,a",), ("x; y",), ("one word",), (None,)], "k string") == [["a", "b;c"], ["x", "y"], ["one word"], None]
    assert values(spark, r.longest(F.col("v")), [(["a", "ccc", "bbb"],), ([],), (None,)], "v array<string>") == ["ccc", None, None]


def test_bibtex(spark):
    d = dt.date(1969, 1, 30)
    rows = [("T", ["Dr Paul", "B"], "V", "Journal", "P", True), ("T", [], "V", "Conference Proceedings", None, True), ("T", ["A"], "V", "Book", "P", True), ("T", ["A"], "V", None, None, True), ("T", ["A"], None, None, None, False)]
    df = spark.createDataFrame([(i, *x, d, ["http://b", "http://a"], "c", "1-4") for i, x in enumerate(rows)], "i int, title string, authors array<string>, publication_title string, category string, publisher string, has_publication boolean, publication_date date, urls array<string>, comments string, pages string")
    out = [x.e for x in df.orderBy("i").select(r.bibtex({c: F.col(c) for c in df.columns}).alias("e")).collect()]
    assert out[0] == "@article{drpaul1969t,\n    title = {T},\n    author = {Dr Paul and B},\n    journal = {V},\n    publisher = {P},\n    year = {1969},\n    pages = {1-4}\n}\n"
    assert out[1].startswith("@inproceedings{unknown1969t,") and "booktitle = {V}" in out[1] and "author" not in out[1]
    assert out[2].startswith("@book{") and "journal" not in out[2]
    assert "howpublished = {Available at http://a (1969/01/30)}" in out[3] and out[3].startswith("@misc{")
    assert "note = {Available at http://a (1969/01/30) | c}" in out[4] and out[4].startswith("@unpublished{")
