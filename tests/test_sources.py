import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import readers, writers


def test_csv_first_per_key_bom_and_missing(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,name,junk\n1, x ,q\n 1,later,q\n2,"a ""b""\nc",q\n,none,q\n3,NaN,q\n', encoding="utf-8")
    rows = {r["id"]: (r["name"], r["absent"]) for r in readers.load_rows(spark, str(p), ["id", "name", "absent"], "id").collect()}
    assert rows == {"1": ("x", None), "2": ('a "b"\nc', None), "3": (None, None)}
    assert readers.load_rows(spark, str(tmp_path / "none.csv"), ["id"], "id").count() == 0
    assert readers.load_rows(spark, str(p), ["id", "name"], "id", limit=2).count() == 2


def test_questions_and_checkpoint_with_torn_line(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id":"1","question":"q","answer":"a","aliases":["x"],"as_of":"2560"}\n{"id":"2","que\n')
    rows = readers.read_questions(spark, str(p)).collect()
    assert sorted(r["_corrupt_record"] is None for r in rows) == [False, True]
    assert rows[0]["file"] == "q.jsonl"
    log = tmp_path / "log"
    writers.append_progress(spark.createDataFrame([("1", "vector")], "question_id string, retriever string"), str(log))
    (log / "part-torn.json").write_text('{"question_id":"9","retr')
    got = readers.read_checkpoint(spark, str(log), "question_id string, retriever string").collect()
    assert [tuple(r) for r in got] == [("1", "vector")]
    assert readers.read_checkpoint(spark, str(tmp_path / "no"), "question_id string").count() == 0
    assert readers.read_questions(spark, str(tmp_path / "no.jsonl")).count() == 0


def test_geojson(spark, tmp_path):
    sq = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    fc = {"type": "FeatureCollection", "features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [sq, sq]}}, {"properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[sq], [sq]]}}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(fc))
    got = readers.read_geojson(spark, str(p))
    assert got.groupBy("name").agg(F.max("ring_no").alias("r"), F.count("*").alias("n")).orderBy("name").collect() == [("A", 2, 8), ("B", 2, 8)]
    assert tuple(got.filter("name = 'A' AND ring_no = 1 AND seq = 1").first()) == ("A", 1, 1, 1.0, 0.0)


def test_quarantine_and_sql(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("y", "boom")], "a string, llm_error string")
    assert not writers.write_or_quarantine(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out_FAILED")).count() == 2
    assert writers.write_or_quarantine(df.filter("a = 'x'"), str(tmp_path / "out"))
    df.createOrReplaceTempView("t_q")
    assert readers.run_sql(spark, "SELECT * FROM t_q WHERE a = :v", v="y").count() == 1
    writers.write_json_lines(df, str(tmp_path / "j"))
    writers.write_table(df, str(tmp_path / "o"), ["a"], "orc")
    assert spark.read.orc(str(tmp_path / "o")).count() == 2


def test_vector_rows(spark):
    n = spark.createDataFrame([("P:1", "P", "1", "n", "t")], "node_id string, label string, key string, name string, text string")
    v = spark.createDataFrame([("P:1", [1.0])], "node_id string, vector array<double>")
    assert writers.vector_rows(n, v).first()["id"] == hashlib.md5(b"P:1").hexdigest()


def test_file_order_decides_the_first_row(spark, tmp_path):
    """Files by name, not by size, whatever the scan packs together."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.csv").write_text("id,name\n1,from b\n")
    (tmp_path / "d" / "a.csv").write_text("id,name\n" + "".join(f"{i},x{i}\n" for i in range(5, 50)) + "1,from a\n1,later\n")
    got = {r["id"]: r["name"] for r in readers.load_rows(spark, str(tmp_path / "d"), ["id", "name"], "id").collect()}
    assert got["1"] == "from a"


def test_broken_lines_catalogue_and_paths(spark, tmp_path):
    p = tmp_path / "core.jsonl"
    p.write_text('{"id":"1","question":"q","hop_type":"single"}\n\n{"id":"2","que\n{"id":"3","question":"q","hop_type":"multi"}\n')
    assert [tuple(r) for r in readers.broken_lines(spark, str(p)).collect()] == [("core.jsonl", 3, '{"id":"2","que')]
    assert [tuple(r) for r in readers.catalogue(spark, str(p)).collect()] == [("core.jsonl", 2, 1, 1, 0)]
    assert readers.resolve(spark, "core.jsonl", str(tmp_path)) == str(p) and readers.resolve(spark, str(p), "/x") == str(p) and readers.resolve(spark, "hdfs://h/x", "/x") == "hdfs://h/x"
    assert readers.broken_lines(spark, str(tmp_path / "no.jsonl")).count() == 0


def test_rulings_with_bad_columns_or_values(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("ingredient_th,source_th,ruling\na,s,Halal\n")
    assert readers.load_rulings(spark, str(p)).first()["aliases"] is None
    p.write_text("ingredient_th,source_th\na,s\n")
    with pytest.raises(ValueError, match="lacks ruling"):
        readers.load_rulings(spark, str(p))
    p.write_text("ingredient_th,source_th,ruling\na,s,maybe\n")
    with pytest.raises(ValueError, match="maybe"):
        readers.load_rulings(spark, str(p))


def test_collection_is_made_once(spark):
    spark.sql("DROP TABLE IF EXISTS vectors_test")
    try:
        assert writers.create_collection(spark, "vectors_test", 64) and not writers.create_collection(spark, "vectors_test", 64)
        with pytest.raises(ValueError, match="size 64"):
            writers.create_collection(spark, "vectors_test", 32)
    finally:
        spark.sql("DROP TABLE IF EXISTS vectors_test")
