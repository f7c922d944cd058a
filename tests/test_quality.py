"""Schema drift and row validation: stated cases and a plain-Python parser."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import row_validation, schema_drift

T0 = datetime(2024, 1, 1)
LINES = "feed string, report_file string, reported_at timestamp, line_no int, raw_json string, extra string"


def reports(spark, files):
    rows = []
    for i, (feed, name, lines) in enumerate(files):
        rows += [(feed, name, T0 + timedelta(days=i), k, x if isinstance(x, str) or x is None else json.dumps(x), "e") for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, LINES)


def changes(spark, files):
    return {tuple(r)[2:] for r in schema_drift.drift(reports(spark, files)).select("feed", "report_file", "drift_kind", "old_field", "new_field").collect()}


def test_renamed_added_removed_retyped(spark):
    a = [{"file_id": "x", "ratio": 0.5, "gone": 1, "same": "s"}, {"file_id": "y", "ratio": 0.25, "gone": 2, "same": None}]
    b = [{"file_id": "x", "score": 0.5, "same": 1, "fresh": []}, {"file_id": "y", "score": 0.25, "same": 2, "fresh": [1]}, {"file_id": "z", "score": 9.5}]
    assert changes(spark, [("f", "1", a), ("f", "2", b)]) == {("renamed", "ratio", "score"), ("removed", "gone", ""), ("added", "", "fresh"), ("retyped", "same", "same")}


def test_no_cases(spark):
    a = [{"file_id": "x", "v": 1}]
    assert changes(spark, [("f", "1", a)]) == set(), "the first file has none"
    assert changes(spark, [("f", "1", a), ("g", "2", [{"file_id": "x", "w": 1}])]) == set(), "feeds do not mix"
    assert changes(spark, [("f", "1", a), ("f", "2", [{"v": None, "file_id": "x"}])]) == set(), "a field of nulls has no type"
    assert schema_drift.drift(spark.createDataFrame([], LINES)).count() == 0


def test_values_must_agree_everywhere(spark):
    a = [{"file_id": "x", "p": 1}, {"file_id": "y", "p": 2}]
    b = [{"file_id": "x", "q": 1}, {"file_id": "y", "q": 3}]
    assert changes(spark, [("f", "1", a), ("f", "2", b)]) == {("removed", "p", ""), ("added", "", "q")}
    nulls = [{"file_id": "x", "p": None}], [{"file_id": "x", "q": None}]
    assert changes(spark, [("f", "1", nulls[0]), ("f", "2", nulls[1])]) == {("removed", "p", ""), ("added", "", "q")}
    apart = [{"file_id": "x", "p": 1}], [{"file_id": "y", "q": 1}]
    assert changes(spark, [("f", "1", apart[0]), ("f", "2", apart[1])]) == {("removed", "p", ""), ("added", "", "q")}


def test_types_and_broken_lines(spark):
    a = [{"file_id": "x", "n": 1}, '{"file_id": "q", "other": 1', None, "[1]", '"text"']
    b = ['{"file_id": "x", "n": 1.0}', '{"file_id": "z", "n": 2}', '{"file_id": "w", "n": 3.5}']
    assert changes(spark, [("f", "1", a), ("f", "2", b)]) == {("retyped", "n", "n")}
    kinds = schema_drift.path_values(reports(spark, [("f", "1", ['{"a":true,"b":1,"c":1.5,"d":"s","e":[],"g":{},"h":null,"i":12345678901234567890}'])])).collect()
    assert {r["field"]: r["kind"] for r in kinds} == {"a": "boolean", "b": "integer", "c": "decimal", "d": "string", "e": "array", "g": "object", "h": None, "i": "decimal"}


def test_twice_delivered_lines_count_once(spark):
    a = reports(spark, [("f", "1", [{"file_id": "x", "v": 1}, {"file_id": "y", "v": "a"}, {"file_id": "z", "v": "b"}]), ("f", "2", [{"file_id": "x", "v": 1}])])
    twice = a.unionByName(a.where("line_no = 1")).unionByName(a.where("line_no = 1"))
    assert {tuple(r)[2:] for r in schema_drift.drift(twice).collect()} == {("retyped", "v", "v")}


def test_consistent_table(spark):
    a = [{"file_id": "x", "decision": {"name": "same_table"}, "match_ratio": 0.5, "mapping": {"A": "a"}, "new_fields": ["p"]}]
    b = [{"file_id": "x", "verdict": {"name": "same_table"}, "match_ratio": "66.7%", "mapping": ["A=a"], "new_fields": "p, q"}, {"file_id": "y", "verdict": "new_table", "match_ratio": 46, "mapping": '{"B": "b"}', "new_fields": 3}]
    got = {(r["report_file"], r["file_id"]): r for r in schema_drift.consistent_table(reports(spark, [("f", "1", a), ("f", "2", b)])).collect()}
    assert got["2", "x"]["decision"] == "same_table" and got["2", "y"]["decision"] == "new_table"
    assert [round(got[k]["match_ratio"], 3) for k in (("1", "x"), ("2", "x"), ("2", "y"))] == [0.5, 0.667, 0.46]
    assert got["2", "x"]["mapping"] == {"A": "a"} and got["2", "y"]["mapping"] == {"B": "b"}
    assert got["2", "x"]["new_fields"] == ["p", "q"] and got["2", "y"]["failed_casts"] == ["new_fields"]


# --- rows ----------------------------------------------------------------------------

CATALOG = [("t", "i", "INTEGER", None, False), ("t", "n", "NUMERIC", None, True), ("t", "b", "BOOLEAN", None, True), ("t", "d", "TIMESTAMP", None, True), ("t", "v", "VARCHAR", 3, True)]


def check(spark, raws, header="I,N,B,D,V,X", delim=",", file_no=1):
    rows = spark.createDataFrame([(file_no, i, r, "x") for i, r in enumerate([header, *raws])], "file_no bigint, row_no int, raw string, error string")
    loads = spark.createDataFrame([(file_no, delim, "t", {c: c.lower() for c in "INBDV"}, T0)], "file_no bigint, delim string, table_name string, mapping map<string,string>, loaded_at timestamp")
    cat = spark.createDataFrame(CATALOG, "table_name string, column_name string, data_type string, max_chars int, is_nullable boolean")
    return row_validation.checked_rows(rows, loads, cat)


def reasons(spark, raws, **kw):
    found = {r["row_no"]: r["reason"] for r in row_validation.failed_rows(check(spark, raws, **kw)).collect()}
    return [found.get(i) for i in range(1, len(raws) + 1)]


def test_values(spark):
    good = ["1,2.5,true,2024-02-29,abc,z", " 1 ,,,,,", "+7,-3,FALSE,2024-01-01T10:00:00,,", "-2147483648,0,True,2024-01-01 23:59:59,ééé,'", "0000000000000000000000000000005,1,,,,"]
    assert reasons(spark, good) == [None] * len(good)
    bad = [",1,true,,,", "2147483648,,,,,", "1.0,,,,,", "1,1.,,,,", "1,.5,,,,", "1,1e3,,,,", "1,,yes,,,", "1,,,2023-02-29,,", "1,,,2024-1-1,,", "1,,,2024-01-01 24:00:00,,", "1,,,2024-01-01 10:00,,", "1,,,,abcd,", "１,,,,,"]
    assert reasons(spark, bad) == ["invalid_value"] * len(bad)


def test_quotes_and_counts(spark):
    raws = ['1,,,,"a,b",z', '1,,,,"a""b",z', '1,,,,"",', '1,,,,a"b,', '1,,,,"ab"c,', '1,,,,"ab', '1,,,, "a",', "1,,,,", "", None, '"1",,,,"x\ny",', '"a"",,,,,']
    want = [None, None, None, "quoting", "quoting", "quoting", "quoting", "column_count", "column_count", "column_count", None, "quoting"]
    assert reasons(spark, raws) == want


@pytest.mark.parametrize("delim", [";", "\t", "|", "^", "."])
def test_delimiters(spark, delim):
    raws = [delim.join(["1", "2", "true", "", "abc", '"q' + delim + '"']), delim.join(["1", "2"])]
    assert reasons(spark, raws, header="﻿" + delim.join("INBDVX"), delim=delim) == [None, "column_count"]


def test_long_quoted_field(spark):
    assert reasons(spark, ['1,,,,,"' + 'a""' * 200_000 + '"']) == [None]


def test_typed_rows_and_summary(spark):
    checked = check(spark, ["1,2.5,true,2024-01-01T10:00:00,abc,z", "x,,,,,"])
    cells = {r["column_name"]: r["value"] for r in row_validation.valid_values(checked).collect()}
    assert cells["i"]["integer"] == 1 and cells["n"]["numeric"] == 2.5 and cells["b"]["flag"] is True and cells["v"]["text"] == "abc" and cells["X"]["text"] == "z"
    assert cells["d"]["moment"] == datetime(2024, 1, 1, 10)
    r = row_validation.load_summary(checked).first()
    assert (r["rows_inserted"], r["rows_failed"], r["error"]) == (1, 1, "row 2: invalid_value in I")


def plain_fields(s, d):
    out, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(s):
                    return None
                if s[j] == '"':
                    if s[j + 1 : j + 2] != '"':
                        break
                    buf, j = buf + '"', j + 2
                else:
                    buf, j = buf + s[j], j + 1
            i = j + 1
            if i < len(s) and s[i] != d:
                return None
        else:
            j = s.find(d, i)
            buf = s[i : j if j >= 0 else len(s)]
            if '"' in buf:
                return None
            i += len(buf)
        out.append(buf)
        if i >= len(s):
            return out
        i += 1


def test_fields_against_plain_parser(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('a",b "') for _ in range(rng.randrange(12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", row_validation.split_fields(F.col("t"), F.lit(",")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in got] == [(t, plain_fields(t, ",")) for t in texts]


def test_repeats_and_empty_tables(spark):
    checked = check(spark, ["x,,,,,"])
    twice = checked.unionByName(checked)
    assert twice.count() == 2
    rows = spark.createDataFrame([(1, 0, "I"), (1, 1, "x"), (1, 1, "x"), (2, 1, "1")], "file_no bigint, row_no int, raw string")
    loads = spark.createDataFrame([(1, ",", "t", {"I": "i"}, T0), (1, ",", "t", {"I": "i"}, T0 + timedelta(1)), (2, ",", "t", {"I": "i"}, T0)], "file_no bigint, delim string, table_name string, mapping map<string,string>, loaded_at timestamp")
    cat = spark.createDataFrame(CATALOG, "table_name string, column_name string, data_type string, max_chars int, is_nullable boolean")
    assert [tuple(r) for r in row_validation.failed_rows(row_validation.checked_rows(rows, loads, cat)).collect()] == [(1, 1, "invalid_value")]
    assert row_validation.failed_rows(row_validation.checked_rows(rows.where("false"), loads, cat)).count() == 0


def test_order_of_files_across_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), f"r{i}", T0 + timedelta(minutes=rng.randrange(10_000))) for i in range(500)]
    got = {(r["feed"], r["report_file"]): r["previous"] for r in schema_drift.file_order(spark.createDataFrame(rows, "feed string, report_file string, reported_at timestamp")).collect()}
    want, last = {}, {}
    for feed, name, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[feed, name] = last.get(feed)
        last[feed] = name
    assert got == want


def test_names_are_followed_through_long_chains(spark):
    chain = ["mapping", *[f"n{i:02d}" for i in range(36)]]
    rows = [("f", f"r{i}", "renamed", a, b) for i, (a, b) in enumerate(zip(chain, chain[1:]))]
    names = schema_drift.canonical_names(spark.createDataFrame(rows, "feed string, report_file string, drift_kind string, old_field string, new_field string"), ["mapping"])
    assert {r["field"]: r["canonical"] for r in names.collect()} == dict.fromkeys(chain, "mapping")
