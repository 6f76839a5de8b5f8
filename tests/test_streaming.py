import datetime

from lumetext.operators.index import build_index, load_index
from lumetext.streaming import following


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id string, title string, body string, removed boolean, seq long"
    batches = [[("a", "A", "red boat", False, 1), ("b", "B", "blue boat", False, 2)], [("b", "B", "green hill", False, 3), ("b", "B", "blue hill", False, 4), ("c", "C", "boat", False, 5)], [("a", "A", "", True, 6)]]
    folder = tmp_path / "changes"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        query = following.follow(following.read_changes(spark, str(folder), schema), str(tmp_path), str(tmp_path / "cp"))
        query.awaitTermination()
    index = load_index(spark, following.current(str(tmp_path)))
    want = build_index(spark.createDataFrame([("b", "B", "blue hill"), ("c", "C", "boat")], "doc_id string, title string, body string"))
    key = lambda ix: sorted(map(str, ix.postings.select("term", "doc_id", "tf", "positions").collect()))
    assert key(index) == key(want)


def test_term_trends(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    spark.createDataFrame([("Red-boat red", at), ("boat", at + datetime.timedelta(hours=1))], "text string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    query = following.term_trends(stream, "text", "at").writeStream.format("memory").queryName("trends").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.window.start.hour, r.term, r.n) for r in spark.table("trends").collect()) == [(10, "boat", 1), (10, "red", 2), (11, "boat", 1)]
