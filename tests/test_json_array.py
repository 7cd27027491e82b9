"""The parallel reader of JSON arrays against the parser of whole files."""

import json
import random

import numpy as np
import pytest

from longdoc.sources import json_array as J

SCHEMA = "id string, ids array<int>, nested struct<a: string, b: array<struct<c: string>>>"


def _text(rng):
    return "".join(rng.choice(['{', '}', '[', ']', '"', '\\', ',', 'é', '😀', 'a', ' ', '\n', '\\"', '}}']) for _ in range(rng.randint(0, 12)))


def _records(rng, n):
    return [{"id": _text(rng) if rng.random() < 0.9 else None, "ids": [rng.randint(0, 9) for _ in range(rng.randint(0, 5))],
             "nested": {"a": _text(rng), "b": [{"c": _text(rng)} for _ in range(rng.randint(0, 3))]}} for _ in range(n)]


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (1, False), (4, False)])
def test_equal_to_the_whole_file_parser(spark, tmp_path, small_blocks, indent, ascii_only):
    rng = random.Random(indent or 0)
    records = _records(rng, 30)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    want = [r.asDict(True) for r in spark.read.schema(SCHEMA).option("multiLine", "true").json(str(path)).collect()]
    for size in (301, 1 << 20):
        small_blocks(size)
        found = J.read_array(spark, str(path), SCHEMA)
        rows = sorted((r.asDict(True) for r in found.collect()), key=lambda r: r["ordinal"])
        assert [r.pop("ordinal") for r in rows] == list(range(len(records)))
        assert rows == want
    small_blocks(300)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10  # one file, many tasks


def test_several_files_and_empty_arrays(spark, tmp_path, small_blocks):
    for name, records in (("b", [{"id": "3"}]), ("a", [{"id": "1"}, {"id": "2"}]), ("c", []), ("d", [{"id": "4"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(records) + "\n")
    small_blocks(10)
    got = {r.ordinal: r.id for r in J.read_array(spark, str(tmp_path), "id string").collect()}
    assert got == {0: "1", 1: "2", 2: "3", 3: "4"}


@pytest.mark.parametrize("text", ['[{"id": "1"}, {"id": "2"', '[{"id": "1"} {"id": "2"}]', '[{"id": "1"},, {"id": "2"}]', '[1, {"id": "1"}]',
                                  '[{"id": "1"}, "x"]', '[{"id": "1"}, []]', '{"id": "1"}', '[{"id": "1"}] [', '[{"id": "1"}]]', '[{"id": "1",}]',
                                  '[{"id": 1"}]', '"[{}]"'])
def test_corrupt_files_are_errors(spark, tmp_path, small_blocks, text):
    (tmp_path / "x.json").write_text(text)
    small_blocks(9)
    with pytest.raises(Exception):  # noqa: B017, PT011 - ours, or the parser's through Spark
        J.read_array(spark, str(tmp_path / "x.json"), "id string").collect()


def test_scan_from_any_state():
    rng = random.Random(5)
    data = json.dumps(_records(rng, 30), ensure_ascii=False).encode()
    whole = np.frombuffer(data, np.uint8)
    nesting, free, end = J.scan(whole, J.OUTSIDE, 0)
    assert end == J.OUTSIDE and nesting[-1] == 0
    for _ in range(200):
        at = rng.randint(0, len(data))
        a, fa, state = J.scan(whole[:at], J.OUTSIDE, 0)
        b, fb, end = J.scan(whole[at:], state, int(a[-1]) if at else 0)
        assert np.array_equal(np.r_[a, b], nesting) and np.array_equal(np.r_[fa, fb], free) and end == J.OUTSIDE
