"""All evaluation items are scored by all retrievers but the vector search, which has every hundredth."""

from lodegraph.plans.eval_queries import score_detail
from lodegraph.session import table

SF = "/root/testdata/sf0.001"


def test_all_items_are_scored(spark):
    items = table(spark, SF, "thai_eval").filter("question IS NOT NULL AND answer IS NOT NULL")
    every, some = items.count(), items.filter("row_id % 100 = 0").count()
    got = {r["retriever"]: r["n"] for r in score_detail(spark, SF).filter("hop_type = 'ALL'").collect()}
    assert got == {k: n for k, n in (("ingredient", every), ("graph", every), ("temporal", every), ("vector", some)) if n}
