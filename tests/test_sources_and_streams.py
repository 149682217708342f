"""Sources, sinks and streams."""

import os
import sqlite3

from pyspark.sql import functions as F

from millrace import sources, streaming
from millrace.plans import load_pipeline

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    for name, data in (("a.txt", b"one\ntwo\n"), ("b.bin", bytes(range(10))), ("sub/c.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert sources.read_files(spark, str(tmp_path)).collect() == [b"one\ntwo\n", bytes(range(10))]
    assert sources.read_files(spark, str(tmp_path), "*.txt", least=1).collect() == [b"one\ntwo\n"]
    assert {r["size"] for r in sources.listing(spark, str(tmp_path)).collect()} == {8, 10}
    assert [r.line for r in sources.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    assert sorted(bytes(r.data) for r in sources.read_blocks(spark, str(tmp_path), 4, "b.bin").collect()) == [bytes(range(4)), bytes(range(4, 8)), bytes((8, 9))]


def test_dump(spark, tmp_path):
    frame = load_pipeline(spark, "put name | cca !").run(sources.emit(spark, b"x", b"../y"))
    done = sources.dump(frame, str(tmp_path), "{name}.out").collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in done) == ["x.out", "y.out"]
    assert (tmp_path / "x.out").read_bytes() == b"x!"
    sources.write_table(frame, str(tmp_path / "table"), "name")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""y"""\n')
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x "y"')]
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("create table users(name text, age int)")
    con.executemany("insert into users values (?, ?)", [("A", 20), ("B", 30), ("C", 40)])
    con.commit()
    con.close()
    assert sources.read_database(spark, str(tmp_path / "d.db"), "select * from users where age > 25").count() == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name)

    n = events.count()
    assert drain(streaming.each(read(), "md5", "event_type", "h", text=True), "s1", "append").count() == n
    assert drain(streaming.dedup(read(), ["event_type"], "ts", "1000 days"), "s2", "append").count() == events.select("event_type").distinct().count()
    assert drain(streaming.group_windows(read(), "event_type", "ts", "1 hour"), "s3", "complete").agg(F.sum("n")).first()[0] == n
    assert drain(streaming.running_state(read(), "user_id", "value"), "s4", "update").agg(F.sum("n")).first()[0] == n
