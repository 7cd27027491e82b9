"""Reading JSON arrays of objects in parallel.

A file is read in the blocks that Spark splits it into, as the pieces between its closing braces; nothing has to be a line.
Where a block begins inside the JSON text is not known, so it is scanned twice:

1. For each state it can begin in (outside a string, inside one, behind a backslash) a block yields the state it ends in and
   how much deeper the nesting is then: a transfer function. Those of a file are composed in order, one row a block, which
   gives every block its state and depth at the start and tells a file that doesn't end as it should.
2. With these each block cuts out its elements. What an element has in other blocks is put together by the blocks' order.

The elements are parsed on their own. Anything but objects, commas and white space in the array is an error, as is a
corrupt element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longdoc.sources.io import written

OUTSIDE, STRING, ESCAPE = 0, 1, 2
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True
_FREE = np.zeros(256, bool)
_FREE[[ord(c) for c in " \t\r\n,"]] = True


class CorruptArray(ValueError):
    """A file that is no JSON array of objects."""


def scan(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(nesting behind each byte, whether the byte lies outside strings, state at the end) of bytes that begin in
    ``state`` at ``depth``."""
    lead = int(state == ESCAPE)
    b = np.r_[np.full(lead, ord("\\"), np.uint8), data]
    place = np.arange(len(b))
    other = np.maximum.accumulate(np.where(b != ord("\\"), place, -1))  # the last byte that is no backslash
    before = place - 1 - np.r_[-1, other[:-1]][:len(b)]  # backslashes right before each byte
    quotes = (b == ord('"')) & (before % 2 == 0)
    inside = (int(state != OUTSIDE) + np.cumsum(quotes)) % 2 == 1
    free = ~inside & ~quotes
    nesting = depth + np.cumsum((_OPEN[b] & free).astype(np.int64) - (_CLOSE[b] & free))
    pending = (len(b) - 1 - other[-1]) % 2 == 1 if len(b) else False
    end = (ESCAPE if pending else STRING) if len(b) and inside[-1] else state if not len(b) else OUTSIDE
    return nesting[lead:], free[lead:], end


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, bytes]]:
    """((file, block), row, bytes) in order. A closing brace stands before each piece but a file's first."""
    key = None
    for batch in batches:
        rows = batch.to_pylist()
        i = 0
        while i < len(rows):
            own = rows[i]["file"], rows[i]["at"]
            j = i
            while j < len(rows) and (rows[j]["file"], rows[j]["at"]) == own:
                j += 1
            text = "}".join(r["value"] for r in rows[i:j])
            yield own, rows[i], (("" if own != key and own[1] == 0 else "}") + text).encode("utf-8", "surrogatepass")
            key, i = own, j


TRANSFER = "file string, at long, " + ", ".join(f"end{s} int, deeper{s} long" for s in range(3))


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, now = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": key[0], "at": key[1]} | {f"end{s}": e for s, (e, _) in enumerate(now)}
                                           | {f"deeper{s}": d for s, (_, d) in enumerate(now)}],
                                          pa.schema([("file", pa.string()), ("at", pa.int64())] + [
                                              f for s in range(3) for f in ((f"end{s}", pa.int32()), (f"deeper{s}", pa.int64()))]))

    for own, _, data in _pieces(batches):
        if own != key:
            if key is not None:
                yield row()
            key, now = own, [(s, 0) for s in range(3)]
        b = np.frombuffer(data, np.uint8)
        nxt = []
        for state, depth in now:
            nesting, _, end = scan(b, state, depth)
            nxt.append((end, int(nesting[-1]) if len(nesting) else depth))
        now = nxt
    if key is not None:
        yield row()


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """The transfer functions of a file's blocks composed in order: state and depth at the start of each."""
    state, depth, out = OUTSIDE, 0, []
    for r in table.sort_by("at").to_pylist():
        out.append({"file": r["file"], "at": r["at"], "state": state, "depth": depth})
        state, depth = r[f"end{state}"], depth + r[f"deeper{state}"]
    if state != OUTSIDE or depth != 0:
        raise CorruptArray(f"{key[0].as_py()}: the JSON text doesn't end")
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("at", pa.int64()), ("state", pa.int32()), ("depth", pa.int64())]))


#: ``part``: 0 a whole element, 1 the end of one, 2 the middle of one, 3 the beginning of one; ``no`` counts the elements that begin
#: in the block. A block's last row has no text and its numbers of commas and array marks.
ELEMENTS = "file string, at long, no long, part int, text string, commas long, marks long"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, depth, held, no, commas, marks, entered, out = None, 0, 0, [], 0, 0, 0, False, []

    def put(part: int, number: int | None, text: bytes | None) -> None:
        out.append({"file": key[0], "at": key[1], "no": number, "part": part, "text": None if text is None else text.decode("utf-8", "surrogatepass"),
                    "commas": commas if text is None else None, "marks": marks if text is None else None})

    def close() -> None:
        if held:
            put(2 if entered else 3, None if entered else no - 1, b"".join(held))
        put(-1, None, None)

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("at", pa.int64()), ("no", pa.int64()), ("part", pa.int32()),
                                                          ("text", pa.string()), ("commas", pa.int64()), ("marks", pa.int64())]))
        out.clear()
        return rows

    for own, first, data in _pieces(batches):
        if own != key:
            if key is not None:
                close()
            key, state, depth, held, no, commas, marks = own, first["state"], first["depth"], [], 0, 0, 0
            entered = depth > 1
        b = np.frombuffer(data, np.uint8)
        nesting, free, state = scan(b, state, depth)
        begins = np.flatnonzero((b == ord("{")) & free & (nesting == 2))
        ends = np.flatnonzero((b == ord("}")) & free & (nesting == 1))
        at_one = free & (nesting == 1)
        at_one[ends] = False
        loose = b[at_one]
        commas += int((loose == ord(",")).sum())
        marks += int((free & (nesting == 1) & (b == ord("["))).sum()) + int((free & (nesting == 0) & (b == ord("]"))).sum())
        outer = b[free & (nesting == 0)]
        mark = at_one & (b == ord("["))
        if (~(_FREE[loose] | (loose == ord("["))) | False).any() or (mark & (np.r_[depth, nesting[:-1]][:len(b)] != 0)).any() \
                or (~(_FREE[outer] | (outer == ord("]")))).any() or (outer == ord(",")).any() or (nesting < 0).any() \
                or (~free & (np.minimum(np.r_[depth, nesting[:-1]][:len(b)], nesting) < 2)).any() \
                or ((b == ord("[")) & free & (nesting == 2)).any():
            raise CorruptArray(f"{key[0]}: something else than objects in the array")
        last = 0
        if depth > 1:  # inside an element
            if not len(ends):
                held.append(data)
                begins = begins[:0]
            else:
                held.append(data[:ends[0] + 1])
                put(1 if entered else 0, None if entered else no - 1, b"".join(held))
                held, entered, ends = [], False, ends[1:]
        for x, y in zip(begins.tolist(), ends.tolist(), strict=False):
            put(0, no, data[x:y + 1])
            no += 1
        if len(begins) > len(ends):
            last = int(begins[-1])
            held = [data[last:]]
            no += 1
        depth = int(nesting[-1]) if len(nesting) else depth
        if len(out) >= 1024:
            yield flush()
    if key is not None:
        close()
    if out:
        yield flush()


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text): the array's elements in order, files by name."""
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                                              F.col("_metadata.file_block_start").alias("at"))
    entries = written(raw.mapInArrow(_transfers, TRANSFER).groupBy("file").applyInArrow(
        _entries, "file string, at long, state int, depth long"), "json_array")
    # one row per block; a broadcast, as the pieces must stay in the order they are read in
    cut = raw.join(F.broadcast(entries), ["file", "at"]).select("file", "at", "value", "state", "depth")
    found = written(cut.mapInArrow(_elements, ELEMENTS), "json_array")

    blocks = found.groupBy("file", "at").agg(F.count_if(F.col("no").isNotNull()).alias("n"), F.sum("commas").alias("commas"), F.sum("marks").alias("marks"))
    blocks = written(blocks, "json_array")
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.sum("commas").alias("commas"), F.sum("marks").alias("marks"))
    bad = files.where((F.col("commas") != F.greatest(F.col("n") - 1, F.lit(0))) | (F.col("marks") != 2)).first()
    if bad:
        raise CorruptArray(f"{bad['file']}: {bad['n']} elements, {bad['commas']} commas")
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = found.where("part >= 0").join(F.broadcast(offsets), ["file", "at"]).withColumn("ordinal", F.col("offset") + F.col("no"))
    whole = placed.where("part = 0").select("ordinal", "text")
    # at most two fragments a block: an element's own begin with the one of part 3
    own = Window.partitionBy("file").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.where("part > 0").withColumn("element", F.max("ordinal").over(own))
    joined = parts.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("at", "part", "text"))).alias("t"))
    return whole.unionByName(joined.select(F.col("element").alias("ordinal"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text")))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` and ``ordinal`` (place in the array, from 0; files follow each other by name). A corrupt
    file or element is an error."""
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return read_elements(spark, path).select(parsed.alias("r"), "ordinal").select("r.*", "ordinal")
