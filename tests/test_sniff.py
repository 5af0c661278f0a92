"""Odd CSV files: dialects, headers, types that fail below the head."""

from datetime import date, datetime

import pytest

from chronolake.sources import sniff

FILES = {
    "semicolons and quotes": ('id;name;x\n1;"a;b";1.5\n2;"say ""hi""";2\n', [(1, "a;b", 1.5), (2, 'say "hi"', 2.0)], ["id", "name", "x"]),
    "tabs and single quotes": ("id\tname\n1\t'tab\there'\n2\t'plain'\n3\tb\n", [(1, "tab\there"), (2, "plain"), (3, "b")], ["id", "name"]),
    "pipes and backslashes": ('id|text|day\n1|"a \\"b\\" | c"|2020-01-02\n2|"d"|2021-12-31\n', [(1, 'a "b" | c', date(2020, 1, 2)), (2, "d", date(2021, 12, 31))], ["id", "text", "day"]),
    "byte-order mark": ("﻿person_id,flag\n7,true\n8,false\n", [(7, True), (8, False)], ["person_id", "flag"]),
    "no header": ("1,2020-01-01 10:00:00,x\n2,2020-01-01 11:30:00,y\n", [(1, datetime(2020, 1, 1, 10), "x"), (2, datetime(2020, 1, 1, 11, 30), "y")], ["_c0", "_c1", "_c2"]),
    "line breaks in fields": ('id,note\n1,"two\nlines"\n2,"one"\n3,four\n', [(1, "two\nlines"), (2, "one"), (3, "four")], ["id", "note"]),
    "empty fields and wide numbers": ("a,b,c,d\n1,,12345678901,\n,2.5,3,\n", [(1, None, 12345678901, None), (None, 2.5, 3, None)], ["a", "b", "c", "d"]),
    "one column": ("name\nx\ny\n", [("x",), ("y",)], ["name"]),
    "header only": ("a,b\n", [], ["a", "b"]),
}


@pytest.mark.parametrize("name", FILES)
def test_odd_files(spark, tmp_path, name):
    text, want, columns = FILES[name]
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    got = sniff.read_sniffed(spark, str(tmp_path / "f.csv"))
    assert got.columns == columns and [tuple(r) for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("RelationV2") <= 1, "one scan"


def test_types_that_fail_below_the_head(spark, tmp_path, monkeypatch):
    """A head of numbers does not decide: what comes later widens the type, and no value is lost."""
    monkeypatch.setattr(sniff, "HEAD", 20)
    lines = ["id,x,d,t,z,s"] + [f"{k},{k},2020-01-01,2020-01-01,{k},00{k}" for k in range(500)]
    lines[300] = "300,3.5,2020-01-01 12:00:00,unknown,99999999999,0300"
    (tmp_path / "f.csv").write_text("\n".join(lines))
    got = sniff.read_sniffed(spark, str(tmp_path / "f.csv"), text_columns=("s",))
    assert dict(got.dtypes) == {"id": "int", "x": "double", "d": "timestamp_ntz", "t": "string", "z": "bigint", "s": "string"}
    assert tuple(got.where("t = 'unknown'").first()) == (300, 3.5, datetime(2020, 1, 1, 12), "unknown", 99999999999, "0300")
    assert got.where("x IS NULL OR d IS NULL OR z IS NULL").count() == 0 and got.where("s = '007'").count() == 1


def test_a_given_separator_holds(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b,c\n1;2,3\n")
    assert sniff.read_sniffed(spark, str(tmp_path / "f.csv"), sep=";").columns == ["a", "b,c"]
