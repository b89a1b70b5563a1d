"""The interval table of a page's elements and its selectors."""

from html.parser import HTMLParser

import pytest
from gleaner.functions.elements import VOID, Find, attribute_of, elements, find_all, find_first, leaf_texts, page_elements, text_of
from pyspark.sql import functions as F

PAGE = (
    """<html><body><div id="a" class="x event-box" data-testid='when it is'>One <b>two</b><div class=inner title="a > b">three<br>four</div></div>"""
    """<ul><li>1<li>2</ul><p class="addres-pin big">Hall<p>Q<img src='a.png' alt=x hidden><script>var a='<div class="x">';</script><!-- <div> --></i></body>"""
)


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(PAGE,)], "h string").withColumn("t", elements(F.col("h")))


def texts(row, find):
    found = find_all(F.col("h"), F.col("t"), find)
    return row.select(F.transform(found, lambda e: text_of(F.col("h"), e))).first()[0]


def test_selectors(row):
    assert texts(row, Find("li")) == ["1", "2"]
    assert texts(row, Find(css="inner", inside=Find(element_id="a"))) == ['three\nfour']
    assert texts(row, Find("div", attribute=("data-testid", "when it is"))) != [] == texts(row, Find("div", attribute=("data-testid", "when")))
    assert len(texts(row, Find("div", attribute_part=("data-testid", "when")))) == 1
    assert texts(row, Find("p", css_part="addres")) == ["Hall"] and texts(row, Find(css="addres")) == []
    assert texts(row, Find("p", says="Q")) == ["Q"]
    assert texts(row, Find("b", inside=Find("ul"))) == []
    assert texts(row, Find("div", inside=Find("div"), of_first=True)) == ['three\nfour']


def test_attributes_and_alternatives(row):
    h, t = F.col("h"), F.col("t")
    image, box = find_first(h, t, Find("img")), find_first(h, t, Find("table"), Find("div", css="inner"))
    got = row.select(attribute_of(image, "src"), attribute_of(image, "hidden"), attribute_of(image, "width"), attribute_of(box, "title"), attribute_of(find_first(h, t, Find("table")), "x")).first()
    assert tuple(got) == ("a.png", "", None, "a > b", None)


def test_leaves(row):
    assert [tuple(x) for x in row.select(leaf_texts(F.col("h"), F.col("t"))).first()[0]] == [("b", 3, "two"), ("li", 3, "1"), ("li", 3, "2"), ("p", 2, "Hall")]


def test_odd_pages():
    assert page_elements("") == [] and page_elements("a < b > c </p>") == []
    assert [e[0] for e in page_elements("<a><b></a></b><I/>")] == ["a", "b", "i"]
    many = page_elements("<div>" * 20_000)
    assert len(many) == 20_000 and many[-1][1] == 19_999
    assert page_elements('<p a="x')[:1] == [] and [e[5] for e in page_elements('<p a="x>y</p>')] == ['a="x']


class Counter(HTMLParser):
    """Start tags with the number of open elements before them, where every end tag fits."""

    def __init__(self):
        super().__init__()
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, len(self.open)))
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def test_against_a_parser(spark, sf_dir):
    for (html,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").limit(50).collect():
        html = html.replace("<p>", "<div>").replace("</p>", "</div>").replace("<li>", "<s>").replace("</li>", "</s>")
        parser = Counter()
        parser.feed(html)
        assert [(e[0], e[1]) for e in page_elements(html)] == [x for x in parser.seen if x[0] not in ("script", "style")]
        for _, _, start, first, last, _ in page_elements(html):
            assert start < first <= last + 1 <= len(html) + 1
