import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.operators.packed import explode_packed, packed_values

DELIMS = set("|;,/、，；｜\t\n\r")


def brute(field):
    """A character-by-character reader of the same grammar."""
    if field is None:
        return []
    s = field.strip().strip("﻿ ").strip()
    if s.startswith("[") and s.endswith("]") and len(s) > 1:
        s = s[1:-1]
    pairs = {'"': '"', "“": "”", "'": "'"}
    out, cur, i, depth = [], "", 0, 0
    while i < len(s):
        c = s[i]
        if not cur.strip() and depth == 0 and c in pairs:
            m = re.compile({'"': r'"((?:[^"\\]|\\.|"")*)"', "“": r"“([^“”]*)”", "'": r"'((?:[^'\\]|\\.)*)'"}[c], re.S).match(s, i)
            rest = s[m.end() :].lstrip() if m else "x"
            if m and (not rest or rest[0] in DELIMS):
                cur, i = m.group(1).replace('""', '"').replace('\\"', '"').replace("\\'", "'"), m.end()
                while i < len(s) and s[i] not in DELIMS:
                    i += 1
                out.append(cur)
                cur, i = "", i + 1
                continue
        if c == "(" and ")" in s[i:]:
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        between = c in ",/" and i and i + 1 < len(s) and s[i - 1].isdigit() and s[i + 1].isdigit()
        if c in DELIMS and not depth and not between:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)
    return [v.strip() for v in out if v.strip()]


CASES = {
    "a|b||c": ["a", "b", "c"],
    "38/21 dry whey": ["38/21 dry whey"],
    "3,7-x; baker's yeast (Pop; gel), y": ["3,7-x", "baker's yeast (Pop; gel)", "y"],
    '["p \\"T\\"", "\\u0e40\\u0e08", "x, y"]': ['p "T"', "เจ", "x, y"],
    "['a', 'b/c']": ["a", "b/c"],
    '"k ""N""", “1,5-z”; q': ['k "N"', "1,5-z", "q"],
    "  a  ": ["a"],
    ",,": [],
    "": [],
    "  ": [],
    "a (b (c, d), e), f": ["a (b (c, d), e)", "f"],
    "a (b, c": ["a (b", "c"],
    "x|x": ["x", "x"],
    '"unclosed, y': ['"unclosed', "y"],
    "a\tb\nc、d": ["a", "b", "c", "d"],
}


def test_cases(spark):
    rows = list(CASES.items())
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "i int, f string")
    got = {r["i"]: r["v"] for r in df.select("i", packed_values("f").alias("v")).collect()}
    for i, (k, want) in enumerate(rows):
        assert got[i] == want, k


def test_null_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "a;b", 9), (2, "z", None, 9)], "row_id long, pos string, f string, val int")
    got = explode_packed(df, "f", ["row_id"]).collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (1, 2, "b")]
    assert explode_packed(df.limit(0), "f", ["row_id"]).count() == 0


def test_long_field(spark):
    df = spark.createDataFrame([(";".join(str(i) + "x" for i in range(3000)),)], "f string")
    assert df.select(packed_values("f").alias("v")).first()["v"][-1] == "2999x"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1, /;|\"'()“” \t ก", max_size=18), min_size=20, max_size=20))
def test_without_nested_marks_equals_reader(spark, fields):
    # quotes or brackets that open within one another have no single right reading; plain fields have
    fields = [f for f in fields if not re.search(r"[\"'“”()]", f)]
    if fields:
        df = spark.createDataFrame(list(enumerate(fields)), "i int, f string")
        got = {r["i"]: r["v"] for r in df.select("i", packed_values("f").alias("v")).collect()}
        assert got == {i: brute(f) for i, f in enumerate(fields)}


@pytest.mark.parametrize("table", ["ingredient_rulings", "thai_eval"])
def test_table_equals_reader(spark, table):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    bad = [(r["aliases"], r["v"], brute(r["aliases"])) for r in df.select("aliases", packed_values("aliases").alias("v")).collect() if "\\u" not in (r["aliases"] or "") and r["v"] != brute(r["aliases"])]
    assert not bad, bad[:3]


def test_long_quoted_and_bracketed_values(spark):
    """A value's length costs no stack."""
    long = "ก," * 50_000
    fields = [f'"{long}", b', f"x ({long}), b", f"'{long}' | b", '"' + 'a""' * 30_000 + '", b', "(" * 300 + "a, b" + ")" * 300 + ", c"]
    want = [[long, "b"], [f"x ({long})", "b"], [long, "b"], ['a"' * 30_000, "b"], ["(" * 300 + "a, b" + ")" * 300, "c"]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, f string")
    got = [r["v"] for r in df.select("i", packed_values("f").alias("v")).orderBy("i").collect()]
    assert got == want


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("x (a (b, (c, d)), e), f", ["x (a (b, (c, d)), e)", "f"]),
        ("(a, b", ["(a", "b"]), ("a), b", ["a)", "b"]), ("((a, b), c", ["((a, b)", "c"]), ("a)), (b, c), d", ["a))", "(b, c)", "d"]), ("(a, b)) , c", ["(a, b))", "c"]),
    ],
)
def test_nested_and_unmatched_brackets(spark, field, want):
    assert spark.createDataFrame([(field,)], "f string").select(packed_values("f").alias("v")).first()["v"] == want
