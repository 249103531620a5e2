"""Markup to text, case by case."""

from __future__ import annotations

import html
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions.markup import ENTITIES, entities_decoded, markup_text
from wardline.sources import tables

CASES = {
    None: None, "": "", "plain": "plain", " \t a\n b ": "a b",
    "<p>one</p><p>two</p>": "one\ntwo", "a<br>b<BR/>c<br />d": "a\nb\nc\nd",
    "x <b>bold</b>ly <i>said</i>": "x boldly said",
    "a<script>var t='</p>';</script>b": "a b", "<SCRIPT src=x>1<2</Script >t": "t", "a<style>p{}</style>b": "a b",
    "a<!-- <p>no</p> -->b": "a b", "a<!-- open": "a", "a<script>never closed": "a",
    "<div\nclass='a'>one</div>\n\n<div>two</div>": "one\ntwo", "cut <a href=": "cut",
    "a &lt;b&gt; &amp;amp; &quot;q&quot; &#65;&#x42;&#xe9; &nope; & &;": "a <b> &amp; \"q\" ABé &nope; & &;",
    "&#0; &#55296; &#1114112; &#x110000; &#9999999;": "&#0; &#55296; &#1114112; &#x110000; &#9999999;",
    "&#128512;&copy;&middot;": "😀©·", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<pre>a</pre ><scripty>s</scripty>": "a\ns",
    "<title>T</title><h1>H</h1>": "T\nH", "<ul><li>a<li>b</ul>": "a\nb",
}


def test_cases(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "i int, h string")
    got = {r["i"]: r["t"] for r in frame.select("i", markup_text(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_known_entities_as_python_reads_them(spark):
    text = " ".join(f"&{name}; &amp;{name};" for name in ENTITIES) + " &#8364; &#x20AC;"
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(entities_decoded(F.col("t"))).first()[0] == html.unescape(text)


@pytest.mark.parametrize("tail", ["<!-- ", "<script>", "<p ", "&#", "&amp;", "<b>x</b>"])
def test_long_pages(spark, tail):
    page = "<p>word " * 20_000 + tail * 20_000
    text = spark.createDataFrame([(page,)], "h string").select(markup_text(F.col("h"))).first()[0]
    assert text.startswith("word\nword\n")


def test_no_markup_left(spark):
    rng = random.Random(1)
    parts = ["<p>", "</p>", "text ", "<b class='x'>", "<!-- c -->", "&lt;", "\n", "<script>s</script>", "<br>"]
    pages = [("".join(rng.choice(parts) for _ in range(40)),) for _ in range(200)]
    for r in spark.createDataFrame(pages, "h string").select(markup_text(F.col("h")).alias("t")).collect():
        left = r["t"].replace("<", "", r["t"].count("<"))
        assert ">" not in left and "&" not in left and "\n\n" not in r["t"] and r["t"] == r["t"].strip(" \n")


def test_every_page_is_a_text(spark, data):
    pages = tables.page_texts(spark, data)
    assert pages.columns == ["page_id", "url", "text"]
    assert pages.where("length(text) = 0 or contains(text, '</')").count() == 0 and pages.count() > 0
