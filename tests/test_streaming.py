from lattica.model import graph_of
from lattica.streaming.feed import append_arcs, running_outdegrees


def test_feed(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 1), (0, 2), (2, 1)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    append_arcs(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    g = graph_of(spark.read.parquet(str(tmp_path / "out")).select("src", "dst"))
    assert g.n == 3 and g.num_arcs() == 3
    q = running_outdegrees(stream).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert dict(map(tuple, spark.sql("select * from deg").collect())) == {0: 3, 2: 1}
