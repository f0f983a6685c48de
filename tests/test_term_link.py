"""Products linked to ingredients by whole names and packed aliases, against brute force."""

from lodegraph.plans import domain_queries as Q

RULINGS = [
    (1, "น้ำมันปาล์ม", "Palm oil", "palm fat | ไขมันปาล์ม", "E1700"),
    (2, "น้ำมันปาล์มแดง", None, None, None),
    (3, "น้ำมันปาล์ม", "Palm oil", "Oil of PALM;ab", None),
    (4, "นม", "Milk", '["นมผง", "dry whey"]', None),
    (5, "แป้งข้าว", "Rice flour", None, "none"),
    (6, None, "Nobody", "sugar", None),
]
PRODUCTS = [
    (1, "คุกกี้น้ำมันปาล์มแดง"), (2, "น้ำมันพืช"), (3, "Cake PALM FAT and palm oil"), (4, "ขนม oil of palm"), (5, "นมผง dry whey e1700"), (6, None), (7, ""), (8, "แป้งข้าว sugar ab"), (9, "นม"),
]
TERMS = {
    "น้ำมันปาล์ม": ["น้ำมันปาล์ม", "palm oil", "palm fat", "ไขมันปาล์ม", "e1700", "oil of palm"],
    "น้ำมันปาล์มแดง": ["น้ำมันปาล์มแดง"], "นม": ["milk", "นมผง", "dry whey"], "แป้งข้าว": ["แป้งข้าว", "rice flour"],
}


def _tables(spark, folder):
    text = "row_id long, ingredient_th string, ingredient_en string, aliases string, e_number string, source_th string, source_type string, ruling string, basis_th string"
    spark.createDataFrame([(*r, "s", "t", "halal", "b") for r in RULINGS], text).write.parquet(f"{folder}/ingredient_rulings.parquet")
    spark.createDataFrame(PRODUCTS, "row_id long, product_name string").write.parquet(f"{folder}/product_processed.parquet")
    return str(folder)


def _brute():
    out = set()
    for i, name in PRODUCTS:
        for ing, terms in TERMS.items():
            hits = [t for t in terms if t in (name or "").lower()]
            if hits:
                out.add((i, ing, min(hits, key=lambda t: (-len(t), t))))
    return out


def test_whole_names_and_aliases_link(spark, tmp_path):
    d = _tables(spark, tmp_path)
    assert sorted((r["row_id"], r["ingredient"], r["term"]) for r in Q.term_link(spark, d).collect()) == sorted(_brute())
    counts = {ing: len({i for i, x, _ in _brute() if x == ing}) for ing in TERMS}
    assert {r["ingredient"]: r["n_products"] for r in Q.ingredient_list(spark, d).collect()} == counts
    assert {(r["ingredient"], r["row_id"]) for r in Q.products_for(spark, d).collect()} == {(x, i) for i, x, _ in _brute()}
