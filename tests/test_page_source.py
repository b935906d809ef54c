import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import page_source as P


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    P.register(spark)


def pages(folder, name, numbers, end="\n"):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"page_num": i, "width": 1.5, "height": 2.0, "text_blocks": [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": "é" * (i % 50), "font_size": 1.0, "font_flags": 0, "block_no": 0}], "table_blocks": [{"rows": [["a", None]]}]}) for i in numbers]
    part = folder / f".{name}"
    part.write_text("\n".join(lines) + end, encoding="utf-8")
    part.rename(folder / name)


def read(spark, folder, **options):
    r = spark.read.format("page_models").option("path", str(folder))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


@pytest.mark.parametrize("split", [1, 97, 250, 1000, 10**7])
@pytest.mark.parametrize("end", ["\n", "", "\n\n"])
def test_each_line_is_in_one_range(tmp_path, split, end):
    pages(tmp_path, "x.jsonl", range(20), end)
    size = os.path.getsize(tmp_path / "x.jsonl")
    fs, _ = P._fs(str(tmp_path))
    found = [json.loads(line)["page_num"] for r in P._ranges([(str(tmp_path / "x.jsonl"), size, 0)], split) for line in P._lines(fs, r) if line.strip()]
    assert found == list(range(20))


def test_pages_and_filters(spark, tmp_path):
    pages(tmp_path / "in", "a-B51.json", range(1, 30))
    pages(tmp_path / "in", "b-B50.json", range(1, 5))
    (tmp_path / "in" / "toc.json").write_text('{"toc": [[1, "x", 1]]}\n\n')
    df = read(spark, tmp_path / "in", split=300)
    assert df.count() == 33 and df.rdd.getNumPartitions() > 5
    row = df.filter("page_num = 7 AND version = '5.1'").first()
    assert row.source == "a-B51.json" and row.text_blocks[0].text == "é" * 7 and row.table_blocks[0].rows == [["a", None]]
    few = df.filter("version = '5.0' AND page_num >= 2 AND page_num IN (2, 3, 9) AND width > 1")
    assert sorted(r.page_num for r in few.collect()) == [2, 3]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "page_num" not in plan[plan.index("Filter") :].partition("\n")[0]  # what is left to Spark is the width
    assert few.rdd.getNumPartitions() < df.rdd.getNumPartitions()  # other versions' files are not opened
    assert read(spark, tmp_path / "none").count() == 0


def test_the_stream_reads_each_file_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("page_models").option("path", str(source)).load().select("source", "page_num")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("source string, page_num int").parquet(out).collect()))

    pages(source, "a.json", [1, 2])
    assert run() == [("a.json", 1), ("a.json", 2)]
    assert len(run()) == 2
    time.sleep(0.05)
    pages(source, "0.json", [3])
    assert run() == [("0.json", 3), ("a.json", 1), ("a.json", 2)]


def test_named_files_are_whole_or_absent(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.lit(".jsonl")).alias("file"), "id", F.when(F.col("id") > 5, "é\n").alias("t"))
    out = tmp_path / "out"
    P.write_named(df.unionByName(df.limit(1).withColumn("file", F.lit(None).cast("string"))), str(out), "file", ["id"])
    assert sorted(os.listdir(out)) == ["f0.jsonl", "f1.jsonl", "f2.jsonl"]
    rows = [json.loads(x) for x in (out / "f1.jsonl").read_text(encoding="utf-8").splitlines()]
    assert [r["id"] for r in rows] == list(range(1, 100, 3)) and rows[0]["t"] is None and rows[-1]["t"] == "é\n"
    bad = df.withColumn("id", F.when(F.col("id") == 98, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        P.write_named(bad.withColumn("file", F.concat(F.lit("new"), "file")), str(out), "file", ["id"])
    assert sorted(os.listdir(out)) == ["f0.jsonl", "f1.jsonl", "f2.jsonl"]
    spread = df.select(F.col("file").alias("name"), F.lit("x").alias("line")).repartition(4)
    with pytest.raises(Exception, match="several tasks|do not follow"):
        spread.write.format("named_lines").option("path", str(out)).mode("append").save()
    assert sorted(os.listdir(out)) == ["f0.jsonl", "f1.jsonl", "f2.jsonl"]
