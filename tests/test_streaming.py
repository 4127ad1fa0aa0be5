import json

from sparkloom.streaming import records


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_arrivals_are_scored_once(spark, tmp_path):
    run = lambda: records.score_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put(tmp_path / "in", "a.json", [{"id": "1", "raw_output": "<think>x</think> fine"}, {"id": "2", "raw_output": ""}])
    run()
    put(tmp_path / "in", "b.json", [{"id": "3", "raw_output": "hello " * 400, "truncated": True}])
    run()
    got = {r.id: (r.final[:5], r.anomalies) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": ("fine", []), "2": ("", ["empty_output"]), "3": ("hello", ["repetition_loop", "truncated"])}


def test_rates_by_window(spark, tmp_path):
    schema = f"{records.RUN}, at timestamp"
    stamp = lambda h, m: f"2024-01-01T{h:02}:{m:02}:00Z"
    put(tmp_path / "in", "a.json", [{"id": "1", "raw_output": "ok then", "at": stamp(10, 1)}, {"id": "2", "raw_output": "", "at": stamp(10, 2)}, {"id": "3", "raw_output": "ok", "at": stamp(12, 0)}])
    stream = lambda: records.anomaly_rates(records.incoming(spark, str(tmp_path / "in"), schema), "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    stream()
    put(tmp_path / "in", "b.json", [{"id": "4", "raw_output": "much too late", "at": stamp(10, 3)}, {"id": "5", "raw_output": "ok", "at": stamp(14, 0)}])
    stream()
    rows = sorted((r.start.hour, r.n, r.odd) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows[0][1:] == (2, 1) and all(n == 1 for _, n, _ in rows[1:])
