import datetime

from meandra.sources import store
from meandra.streaming import catalog


def test_each_scene_arrives_once(spark, tmp_path):
    schema = "river long, scene long, acq timestamp, width double"
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    spark.createDataFrame([(1, 1, day(0), 1.0), (1, 2, day(3), 2.0), (1, 1, day(0), 1.0)], schema).write.parquet(str(tmp_path / "in" / "a"))
    stream = catalog.read_folder(spark, str(tmp_path / "in" / "*"), schema)
    q = catalog.new_scenes(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["scene"] for r in spark.table("seen").collect()) == [1, 2]


def test_results_come_back_and_done_scenes_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 2.0, 3.0), (2, 0, 5.0, 6.0)], "scene long, seq long, x double, y double")
    store.save(rows, str(tmp_path / "out"))
    store.save(rows.filter("scene = 2"), str(tmp_path / "out"))
    back = store.load(spark, str(tmp_path / "out"))
    assert back.count() == 3
    todo = catalog.unprocessed(spark.createDataFrame([(2,), (3,)], "scene long"), back)
    assert [r["scene"] for r in todo.collect()] == [3]
    assert '"coordinates":[[1.0,2.0],[2.0,3.0]]' in store.to_geojson(rows).filter("scene = 1").first()["feature"]
