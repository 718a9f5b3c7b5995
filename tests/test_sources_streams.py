import json

import pytest
from pyspark.sql import functions as F

from docengine.sources import datasource as D
from docengine.streaming import resume


def log(path, records, end="\n"):
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in records) + end)


RECORDS = [{"source_image": f"图{k}.png", "status": ["chart", "error", None][k % 3], "n": k} for k in range(50)] + ["{broken", "[1]", "", "7", {"status": 5}, {"source_image": {"a": 1}}]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_cut_no_line(spark, tmp_path, size):
    log(tmp_path / "a.jsonl", RECORDS)
    log(tmp_path / "b.jsonl", RECORDS[:3], end="")
    (tmp_path / "c.txt").write_text("{}")
    D.register(spark)
    rows = spark.read.format("jsonl_log").option("keys", "source_image,status,n").option("range_bytes", size).load(str(tmp_path)).collect()
    want = [r for r in RECORDS if isinstance(r, dict)] + RECORDS[:3]
    assert sorted(r["line"] for r in rows) == sorted(json.dumps(x, ensure_ascii=False) for x in want)
    for r in rows:
        found = json.loads(r["line"])
        assert all(r[k] == (found.get(k) if isinstance(found.get(k), (str, type(None))) else json.dumps(found[k])) for k in ("source_image", "status", "n"))
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert f.readline().decode().rstrip("\n") == r["line"]


def test_filters_are_applied_while_reading(spark, tmp_path):
    log(tmp_path / "a.jsonl", RECORDS)
    D.register(spark)
    rows = spark.read.format("jsonl_log").option("keys", "source_image,status,n").load(str(tmp_path))
    some = rows.where((F.col("status") == "chart") & F.col("n").isin("3", "4", "6") & (F.length("line") > 0))
    assert sorted(r["n"] for r in some.collect()) == ["3", "6"]
    assert rows.where(F.col("status").isin("chart", "error")).count() == 34
    assert rows.where("status is null").count() == 16 + 1
    reader = D.LogReader(D._Options({"path": str(tmp_path), "keys": "status"}, "*.jsonl"))
    left = list(reader.pushFilters([D.EqualTo(("status",), "chart"), D.EqualTo(("line",), "x"), D.In(("status",), ("chart", "y"))]))
    assert reader.wanted == {"status": {"chart"}} and len(left) == 1


def test_no_files(spark, tmp_path):
    D.register(spark)
    assert spark.read.format("jsonl_log").option("keys", "a").load(str(tmp_path)).count() == 0
    assert spark.read.format("chart_folder").load(str(tmp_path)).count() == 0


def test_a_stream_takes_whole_lines_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    source.mkdir()
    D.register(spark)

    def go():
        rows = spark.readStream.format("jsonl_log").option("keys", "n").option("range_bytes", 50).load(str(source))
        rows.select("n").writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r["n"]) for r in spark.read.parquet(f"file://{out}").collect())

    log(source / "a.jsonl", [{"n": 1}, {"n": 2}])
    log(source / "a.jsonl", ['{"n": '], end="")  # a line that is still being written
    assert go() == [1, 2]
    log(source / "a.jsonl", ["3}"])
    log(source / "b.jsonl", [{"n": 4}])
    assert go() == [1, 2, 3, 4]
    assert go() == [1, 2, 3, 4]


def test_charts_of_a_folder(spark, tmp_path):
    for k, text in enumerate(['{"is_chart": true, "chart_type": "bar"}', '{"is_chart": false}', "{", "[]", '﻿{"is_chart": true, "_source_image": "images/x.png"}']):
        folder = tmp_path / "doc" / ("charts" if k < 4 else "other")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"c{k}.json").write_text(text, encoding="utf-8")
    D.register(spark)
    rows = spark.read.format("chart_folder").load(str(tmp_path))
    assert sorted((r["chart_id"], r["chart_type"], r["source_image"]) for r in rows.collect()) == [("c0", "bar", None), ("c4", None, "images/x.png")]
    assert [r["chart_id"] for r in rows.where("chart_id = 'c4'").collect()] == ["c4"]
    assert spark.read.format("chart_folder").option("folder", "charts").load(str(tmp_path)).count() == 1


def test_work_goes_on_where_it_was_stopped(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    schema = "image string, seq long, signature string, status string"

    def go(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

        def work(image, signature):
            if signature == "bad":
                raise ValueError("no")
            return "chart"

        resume.run_once(spark.readStream.schema(schema).parquet(source), work, out, checkpoint)
        return sorted((r["image"], r["seq"], r["signature"], r["status"], r["error"]) for r in spark.read.parquet(out).collect())

    # a log record (with a status) counts as done; repeats do nothing; an error is not tried again with the same signature
    one = go([("a", 1, "s1", "chart"), ("a", 2, "s1", None), ("b", 3, "bad", None), ("b", 4, "bad", None), ("c", 6, "s2", None), ("c", 5, "s1", None), (None, 7, "s", None)])
    assert one == [("b", 3, "bad", "error", "ValueError: no"), ("c", 5, "s1", "chart", None), ("c", 6, "s2", "chart", None)]
    two = go([("a", 8, "s2", None), ("c", 9, "s2", None), ("b", 10, "good", None)])
    assert sorted(set(two) - set(one)) == [("a", 8, "s2", "chart", None), ("b", 10, "good", "chart", None)] and len(two) == 5


def test_paths_of_the_local_file_system():
    assert [D.local(p) for p in ("/a/b", "file:/a/b", "file:///a/b", "file:x")] == ["/a/b", "/a/b", "/a/b", "file:x"]


def test_chart_folders_are_listed_by_tasks(tmp_path, monkeypatch):
    from docengine.sources import datasource as S

    monkeypatch.setattr(S, "FILES", 4)
    for folder, n in (("a", 3), ("a/charts", 2), ("b/charts", 9), (".hidden", 2), ("c", 0)):
        (tmp_path / folder).mkdir(parents=True)
        for i in range(n):
            (tmp_path / folder / f"{folder[-1]}{folder[0]}{i}.json").write_text('{"is_chart": true}')
    (tmp_path / "a" / ".x.json").write_text('{"is_chart": true}')
    for folder, want in (("", 14), ("charts", 11)):
        reader = S.ChartReader(f"file:{tmp_path}", folder)
        parts = reader.partitions()
        found = [r[0] for p in parts for r in reader.read(p)]
        assert sorted(found) == [f for f in S.files_of(str(tmp_path), f"{folder}/*.json" if folder else "*.json")] and len(found) == want
        assert any(named is None for p in parts for _, named in p.value) and all(len(named or []) <= 4 for p in parts for _, named in p.value)
    one = S.ChartReader(str(tmp_path / "a" / "aa0.json"), "")
    assert [r[1] for p in one.partitions() for r in one.read(p)] == ["aa0"]
    one.wanted = {"other"}
    assert not [r for p in one.partitions() for r in one.read(p)]
