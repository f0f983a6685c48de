import pytest
from pyspark.sql import functions as F

from lodegraph.llm.canonical import PROVINCE_AFFIXES, THAI_SOUNDS, CanonicalList, damerau_levenshtein, keys, letters, map_column, most_edits

ENTRIES = [(1, "แก่งไม้หอม", 9), (1, "Kaeng Mai Hom", 2), (2, "เมืองวารี", 5), (2, "Mueang Wari", 0), (3, "เพชรลานนา", 1), (4, "เพชรลานนท์", 1), (3, "Phet Lanna", 0), (4, "Phet Lanon", 0), (5, "Tha Bulan", 3)]
LIST = CanonicalList(ENTRIES, PROVINCE_AFFIXES, THAI_SOUNDS)
CASES = [
    ("แกงไมหอม", 1), ("จังหวัดแก่งไม้หอม", 1), ("จ. แก่งไม้หอม", 1), ("แก่ง\u200bไม้หอม", 1), ("KAENG_MAI_HOM", 1), ("Keng May Hom", 1), ("Province of Kaeng Mai Hom", 1), ("Changwat kaeng mai hom, TH", 1), ("Kaneg Mai Hom province", 1),
    ("Muaeng Wai", 2), ("เมืองวีรี", 2), ("PhetLaaon", 4), ("Phet Lannaa", 3), ("ออนไลน์", -1), ("Thailand", -1), ("12345", -1), ("-", -1), ("Tumarecopa", -1), ("zzz", -1), ("Tha Bukhn", 5),
]


@pytest.mark.parametrize(("value", "want"), CASES)
def test_values(value, want):
    assert LIST.find([value]) == [want]


def _osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_dictionary_holds_every_pair_within_its_bound():
    import random

    r = random.Random(2)
    pairs = []
    for _ in range(600):
        a = "".join(r.choice("abcdef") for _ in range(r.randrange(1, 30)))
        b = list(a)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", "x", "ya"])
            if r.random() < 0.3 and len(b) > 2:
                k = r.randrange(len(b) - 1)
                b[k], b[k + 1] = b[k + 1], b[k]
        pairs.append((a, "".join(b)))
    got = damerau_levenshtein([a for a, _ in pairs], [b for _, b in pairs])
    assert [int(x) for x in got] == [_osa(a, b) for a, b in pairs]
    for (a, b), d in zip(pairs, got):
        if b and d <= most_edits(max(len(a), len(b))):
            assert keys(a) & keys(b), (a, b)


def test_distance():
    assert damerau_levenshtein(["", "abcd", ""], ["abc", "acbd", ""]).tolist() == [3, 1, 0]
    assert damerau_levenshtein(["ไม้"], ["ไม"], weighted=True)[0] == pytest.approx(0.3)
    assert letters(" A-1 é") == "aé"


def test_no_entry_is_an_argument():
    assert CanonicalList([(1, "online", 1)]).find(["on line"]) == [1]
    assert CanonicalList([(1, "online", 1)], no_entry=("online",)).find(["on line"]) == [-1]


def test_column(spark):
    canon = spark.createDataFrame([(1, "แก่งไม้หอม", "Kaeng Mai Hom", ["Alt One"]), (2, "เมืองวารี", "Mueang Wari", []), (3, "geo", None, None)], "pid long, name_th string, name_en string, alt_names array<string>")
    rows = [(1, "แก่งไม้หอม"), (2, "kaeng mai hom"), (3, None), (4, " nan "), (5, ""), (6, "ALT one"), (7, "kaeng mai hom"), (8, "qqqq"), (9, "geo."), (10, "x" * 5000)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "row_id long, province string, canon_id string")
    got = sorted(map(tuple, map_column(df, "row_id", "province", canon, "pid", "name_th", ["name_en", "alt_names"], PROVINCE_AFFIXES).collect()))
    assert got == [(2, "province", 1), (6, "province", 1), (7, "province", 1), (8, "province", -1), (9, "province", 3), (10, "province", -1)]
    assert map_column(df.limit(0), "row_id", "province", canon, "pid", "name_th", ["name_en"]).count() == 0
    none = map_column(df, "row_id", "province", canon.limit(0), "pid", "name_th", ["name_en", "alt_names"])
    assert {r["canon_id"] for r in none.collect()} == {-1}
    joined = map_column(df, "row_id", "province", canon, "pid", "name_th", ["name_en", "alt_names"], PROVINCE_AFFIXES, most_broadcast=0)
    assert sorted(map(tuple, joined.collect())) == got


def test_joined_list_equals_broadcast_list(spark):
    """A list too long to be broadcast gives the same ids."""
    canon = spark.createDataFrame([(i, n) for i, n, _ in ENTRIES], "pid long, name string").withColumn("form", F.lit(None).cast("string"))
    rows = [(i, v) for i, (v, _) in enumerate(CASES)] + [(100 + i, n) for i, (_, n, f) in enumerate(ENTRIES) for _ in range(f)]
    df = spark.createDataFrame(rows, "row_id long, v string")
    found = [sorted(map(tuple, map_column(df, "row_id", "v", canon, "pid", "form", ["name"], PROVINCE_AFFIXES, THAI_SOUNDS, most_broadcast=m).collect())) for m in (0, 100)]
    assert found[0] == found[1]
    assert [x[2] for x in found[0][: len(CASES)]] == [w for _, w in CASES]
