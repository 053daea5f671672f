import json
import random

import pytest

from fitlens.sources import postings
from fitlens.sources.profile import read_profile
from fitlens.sources.splits import _Cutter, read_split

TEXTS = ["plain", "a } b", "a { b [ c ]", 'quote " here', 'end\\', '\\"', "],[", "é漢😀", "line\nbreak", "", '{"a": "}"}', "\\\\\"}", " , "]


def files(folder):
    rng = random.Random(2)

    def doc(k):
        return {"title": rng.choice(TEXTS), "nested": {"list": [1, {"x": rng.choice(TEXTS)}, []], "k": k}, "description": rng.choice(TEXTS) * rng.randint(1, 9)}
    good = {
        "compact": json.dumps([doc(k) for k in range(12)], separators=(",", ":")), "ascii": json.dumps([doc(k) for k in range(9)]),
        "indented": "﻿ \n" + json.dumps([doc(k) for k in range(6)], indent=3, ensure_ascii=False) + "\r\n ",
        "mixed": json.dumps([1, "two, }", None, [3, {"a": "]"}], doc(1), True, {}, []], ensure_ascii=False), "empty": " [ \n] ", "one": "[{}]",
        "object": json.dumps(doc(5), indent=1, ensure_ascii=False), "object_end": '{"a": {"b": "}"}}', "numbers": "[1, 2, 3]", "space name+a%20": '[{"a": 1}]'}
    text = good["compact"]
    bad = {"cut": text[:len(text) // 2], "trailing": text + "x", "two": text + text, "comma": "[{},]", "comma2": "[,{}]", "missing": '[{"a":1} {"b":2}]',
           "object_more": '{"a":1}{', "object_two": '{"a":1} {"b":1}', "no_json": "hello } there", "closing": "]}", "open": "[[{}]", "wrong": '[{"a":1}}', "blank": " \n ",
           "key": "[{a: 1}]", "number": "17", "string": '"[{}]"', "brace": "[{}}]", "garbage": 'x [{"a":1}]'}
    for name, body in (good | bad).items():
        (folder / f"{name}.json").write_text(body, encoding="utf-8", newline="")
    (folder / "other.txt").write_text("[{}]")


def rows(df):
    return sorted((r.file, r.pos, None if r.doc is None else r.doc.toJson(), r.reason) for r in df.collect())


@pytest.mark.parametrize("size", ["97b", "1k", "128m"])
def test_same_rows_as_the_whole_files(spark, tmp_path, size):
    """Ranges of any length: strings with braces, quotes and backslashes, long elements, bad files."""
    files(tmp_path)
    want = rows(postings.parse_postings(postings.read_posting_text(spark, str(tmp_path))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows(read_split(spark, str(tmp_path), 0))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({f for f, *_ in want}) == 27 and sum(r[3] == "invalid_file" for r in want) == 18
    assert got == want


def test_large_files_only(spark, tmp_path):
    """Small files whole, large ones in ranges, each once."""
    files(tmp_path)
    want = rows(postings.parse_postings(postings.read_posting_text(spark, str(tmp_path))))
    assert rows(postings.parse_files(spark, str(tmp_path), 700)) == want
    assert rows(postings.parse_files(spark, str(tmp_path))) == want
    (tmp_path / "nothing.json").write_text("")
    (tmp_path / "no bytes.json").write_text("")
    more = [(f, 0, None, "invalid_file") for f in ("no bytes.json", "nothing.json")]
    assert rows(postings.parse_files(spark, str(tmp_path), 0)) == sorted(want + more)
    assert rows(postings.parse_files(spark, str(tmp_path))) == sorted(want + more)


def test_indented_files_and_profiles(spark, tmp_path):
    """Documents over several lines are read whole."""
    (tmp_path / "p.json").write_text(json.dumps({"Summary": [{"Content": "one"}], "Name": "x"}, indent=2))
    assert [(r.profile_version, [s.section for s in r.sections]) for r in read_profile(spark, str(tmp_path / "p.json")).collect()] == [("p", ["Summary"])]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps([{"title": "t", "company": "c", "description": "d\ne"}], indent=2))
    assert [(r.job_title, r.job_description, r.reason) for r in postings.read_postings(spark, str(tmp_path / "raw")).collect()] == [("t", "d\ne", None)]


def test_one_list_is_many_tasks(spark, tmp_path):
    body = json.dumps([{"description": "x" * 900, "n": k} for k in range(600)])
    (tmp_path / "large.json").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 10
        assert read_split(spark, str(tmp_path), 0).filter("reason is null").selectExpr(
            "count(distinct pos) as a", "max(pos) as b", "sum(try_variant_get(doc, '$.n', 'long') - pos) as c").first() == (600, 599, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cutter_at_any_cut():
    body = json.dumps([{"a": t, "b": [t]} for t in TEXTS] + [1, "x"], ensure_ascii=False).encode()
    want = [json.dumps(x, ensure_ascii=False).encode() for x in json.loads(body)]
    for step in (1, 2, 3, 11):
        # Batches end at braces, so never between a backslash and what it escapes.
        parts = [p + b"}" for p in body.split(b"}")]
        parts = [b"".join(parts[i:i + step]) for i in range(0, len(parts), step)]
        cutter, found = _Cutter(0, 0, True, len(body)), []
        for part in parts:
            found += cutter.cut(part)
        assert [t.strip() for _, t in found] == want and [n for n, _ in found] == list(range(len(want)))
        assert (cutter.opened, cutter.closed, cutter.bad, cutter.depth, cutter.open) == (1, 1, False, 0, b"")
