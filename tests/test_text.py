import html as pyhtml
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from fitlens.functions import text as t


@pytest.mark.parametrize("raw,expected", [
    ("<p>a</p><p>b &amp;amp; c</p><script>x</script>", "ab &amp; c"),
    ("<ul><li>one</li><li>two</li></ul>", "onetwo"),
    ("a<!-- note <b> -->b<!DOCTYPE html>c", "abc"),
    ('<a title="x > y" href=\'q\'>link</a>', "link"),
    ("<p class=it's>don't</p>", "don't"),
    ("2 < 3 and 5 > 4", "2 < 3 and 5 > 4"),
    ("<STYLE>p{}</style >x<script>if (a<b) </script>y", "xy"),
    ("<script>never closed", ""),
    ("&eacute;&#233;&#xE9;&#150;&hearts;&nosuch; &copy", "ééé–♥&nosuch ©"),
    ("&#x1F600;|&#0;|&#99999999999;", "😀|\ufffd|\ufffd"),
    ("&amp;lt;b&amp;gt; &Aacute;", "&lt;b&gt; Á"),
    ("a&amp<b>c</b>|&am<b>p;</b>|&<i>amp;</i>|&#<i>38;</i>", "a&c|&amp;|&amp;|&#38;"),
    (None, ""),
])
def test_clean_html(one, raw, expected):
    assert one(t.clean_html, x=raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("a   b\n\n\n\nc \n", "a b\n\nc"),
    ("a\n \n \nb", "a\n\n\nb"),
    ("\u00a0 x \u2003\n\t y\r\n", "x\ny"),
    ("\n\n\n", ""),
    (None, ""),
])
def test_normalize_whitespace(one, raw, expected):
    assert one(t.normalize_whitespace, x=raw) == expected


def _whitespace_rule(text):
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r" {2,}", " ", text)
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def test_whitespace_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    messy = docs.select("doc_id", F.regexp_replace("text", "e", " \u00a0\n\n ").alias("text"))
    got = messy.select("text", t.normalize_whitespace("text").alias("out")).collect()
    assert len(got) == 1000
    assert all(r["out"] == _whitespace_rule(r["text"]) for r in got)
    assert not any("  " in r["out"] for r in got if "\u00a0" not in r["out"])


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_clean_html_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", t.clean_html("html").alias("out")).collect():
        reader = _Reader()
        reader.feed(row["html"])
        reader.close()
        assert row["out"] == "".join(reader.parts)


def test_named_entities_follow_the_standard_table(spark):
    names = [n for n in pyhtml.entities.html5 if n.endswith(";")][::7]
    rows = spark.createDataFrame([(f"x&{n}y",) for n in names], "s string")
    for row in rows.select("s", t.clean_html("s").alias("out")).collect():
        assert row["out"] == pyhtml.unescape(row["s"])


@pytest.mark.parametrize("ref, char", [
    ("&#0000000000000000000065;", "A"), ("&#x0000000000000000041;", "A"), ("&#X41;", "A"), ("&#0;", "�"), ("&#x0;", "�"),
    ("&#99999999999999999999;", "�"), ("&#xffffffffffffffffff;", "�"), ("&#128;", "€"), ("&#x1F600;", "\U0001f600")])
def test_numbers_of_any_length(one, ref, char):
    assert one(t.decode_entities, x=f"a{ref}b") == f"a{char}b"


def test_default_embedder_holds_one_slice_of_a_batch(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from fitlens.functions import vectors

    make = vectors.hashed_embedder

    def strict(dim):
        embed = make(dim)

        def run(texts):
            if len(texts) > 256:
                raise ValueError("a whole batch at once")
            return embed(texts)
        return run
    texts = [None, "", *(f"word{i % 7} and Ünder {i}" for i in range(898))]
    monkeypatch.setattr(vectors, "hashed_embedder", strict)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = [r.v for r in df.select("id", vectors.embed_text("text", dim=8).alias("v")).orderBy("id").collect()]
    assert np.array_equal(np.array(got, "float32"), np.stack(make(8)(pd.Series(texts))))
    assert df.filter("id < 0").select(vectors.embed_text("text", dim=8)).collect() == []
