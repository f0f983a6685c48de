"""hop2_expand and pair_join over all suppliers and customers, against brute force on a small fixture."""

from pyspark.sql import functions as F

from lodegraph.plans import graph_queries as Q

NATIONS = [(0, "N0", 0), (1, "N1", 0), (2, "N2", 1)]
SUPPLIERS = [(k, f"S{k}", k % 3) for k in range(1, 10)]
CUSTOMERS = [(k, f"C{k}", k % 2, float(k * 2000 - 999)) for k in range(1, 7)]


def _tables(spark, folder):
    for name, rows, schema in (
        ("region", [(0, "R0"), (1, "R1")], "r_regionkey long, r_name string"), ("nation", NATIONS, "n_nationkey long, n_name string, n_regionkey long"),
        ("supplier", SUPPLIERS, "s_suppkey long, s_name string, s_nationkey long"), ("customer", CUSTOMERS, "c_custkey long, c_name string, c_nationkey long, c_acctbal double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_supplier_and_customer(spark, tmp_path):
    d = _tables(spark, tmp_path)
    want = set()
    for k, _, n in SUPPLIERS:
        node, start = f"Nation:{n}", f"Supplier:{k}"
        want.add((start, node, "IN_REGION", "Region", True, 1))
        want.add((start, node, "IN_NATION", "Supplier", False, sum(x[2] == n for x in SUPPLIERS)))
        if c := sum(x[2] == n for x in CUSTOMERS):
            want.add((start, node, "IN_NATION", "Customer", False, c))
    got = Q.hop2_expand(spark, d).select("start_id", "node_id", "rel", "mlabel", "outgoing", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    pairs = sorted((s[1], c[1], s[2]) for s in SUPPLIERS for c in CUSTOMERS if s[2] == c[2])
    assert sorted(map(tuple, Q.pair_join(spark, d).collect())) == pairs


def test_pairs_of_one_nation_are_made_in_several_tasks(spark, tmp_path):
    spark.createDataFrame([(k, f"S{k}", 7) for k in range(20)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"C{k}", 7) for k in range(200)], "c_custkey long, c_name string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    pairs = Q.pair_join(spark, str(tmp_path))
    assert pairs.distinct().count() == pairs.count() == 4000
    assert pairs.select(F.spark_partition_id()).distinct().count() > 4
