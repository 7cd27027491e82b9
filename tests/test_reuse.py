"""A6 per input file."""

import json
import os

import pytest
from pyspark.sql import functions as F

from longdoc.sources import reuse as R


def _write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _compute(spark, asked):
    def compute(files):
        asked.append(sorted(os.path.basename(f) for f in files))
        df = spark.read.schema("id int, text string").json(files)
        return df.select("id", F.upper("text").alias("up"), F.col("_metadata.file_path").alias(R.INPUT_FILE)).where("id >= 0")
    return compute


def test_one_changed_file_of_many_recomputes_one(spark, tmp_path):
    src = tmp_path / "in put"
    src.mkdir()
    for i in range(100):
        _write(src, f"f {i:03d}.json", [{"id": i, "text": f"t{i}"}, {"id": 1000 + i, "text": "x"}])
    base, asked = str(tmp_path / "out"), []

    def run(config=None):
        rows = R.materialize_files(spark, _compute(spark, asked), str(src), base, config or {"v": 1}).collect()
        return sorted((r.id, r.up) for r in rows)

    want = sorted([(i, f"T{i}") for i in range(100)] + [(1000 + i, "X") for i in range(100)])
    assert run() == want and len(asked) == 1 and len(asked[0]) == 100
    folders = {f: os.stat(f"{base}/{d}/data/{f}").st_mtime_ns for d in os.listdir(base) for f in os.listdir(f"{base}/{d}/data")}
    assert run() == want and len(asked) == 1
    _write(src, "f 007.json", [{"id": 7, "text": "changed text"}])  # changed
    want = [w for w in want if w != (1007, "X") and w[0] != 7] + [(7, "CHANGED TEXT")]
    assert run() == sorted(want) and asked[1:] == [["f 007.json"]]
    now = {f: os.stat(f"{base}/{d}/data/{f}").st_mtime_ns for d in os.listdir(base) for f in os.listdir(f"{base}/{d}/data")}
    assert len(set(folders.items()) & set(now.items())) == 99 and len(now) == 100
    os.rename(src / "f 008.json", tmp_path / "elsewhere.json")  # vanished
    _write(src, "g.json", [{"id": -1, "text": "no row of this file is kept"}])  # new, and without a row
    want = [w for w in want if w[0] not in (8, 1008)]
    assert run() == sorted(want) and asked[2:] == [["g.json"]]
    assert run() == sorted(want) and len(asked) == 3  # a file without rows isn't computed again
    assert run({"v": 2}) == sorted(want) and len(asked[3]) == 100


def test_a_run_that_was_cut_off_is_made_good(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.json", [{"id": 1, "text": "a"}])
    asked = []
    good = _compute(spark, asked)

    def broken(files):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        R.materialize_files(spark, broken, str(src), str(tmp_path / "out"), {})
    _write(src, "b.json", [{"id": 2, "text": "b"}])
    assert sorted(r.id for r in R.materialize_files(spark, good, str(src), str(tmp_path / "out"), {}).collect()) == [1, 2]
    with pytest.raises(RuntimeError):
        _write(src, "c.json", [{"id": 3, "text": "c"}])
        R.materialize_files(spark, broken, str(src), str(tmp_path / "out"), {})
    assert sorted(r.id for r in R.materialize_files(spark, good, str(src), str(tmp_path / "out"), {}).collect()) == [1, 2, 3]
    assert asked == [["a.json", "b.json"], ["c.json"]]


def test_inputs_without_files(spark, tmp_path):
    asked = []
    with pytest.raises(FileNotFoundError):
        R.materialize_files(spark, _compute(spark, asked), str(tmp_path / "none"), str(tmp_path / "out"), {})
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.json", [{"id": 1, "text": "a"}])
    assert R.materialize_files(spark, _compute(spark, asked), str(src), str(tmp_path / "out"), {}).count() == 1
    os.rename(src / "a.json", tmp_path / "a.json")
    gone = R.materialize_files(spark, _compute(spark, asked), str(src), str(tmp_path / "out"), {})
    assert gone.columns == ["id", "up"] and gone.collect() == []
