"""The aliases of ingredients, of all their rows."""

from lodegraph.plans.domain_queries import alias_index


def test_aliases_per_ingredient(spark, tmp_path):
    rows = [("น้ำตาล", "sugar | Cane Sugar;ab"), ("น้ำตาล", "SUGAR, \"beet, white\""), (" น้ำตาล ", None), ("เกลือ", "sugar"), ("nan", "lost"), ("นม", "")]
    spark.createDataFrame(rows, "ingredient_th string, aliases string").write.parquet(f"{tmp_path}/ingredient_rulings.parquet")
    got = sorted((r["ingredient"], r["alias"]) for r in alias_index(spark, str(tmp_path)).collect())
    assert got == sorted([("น้ำตาล", "SUGAR"), ("น้ำตาล", "Cane Sugar"), ("น้ำตาล", "beet, white"), ("เกลือ", "sugar")])
