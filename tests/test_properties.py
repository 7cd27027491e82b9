"""Array functions against plain-Python definitions on random id lists."""

import random

from longdoc.functions import arrays as A

C = 4


def py_pad(x, c):
    return x + [0] * ((c - len(x) % c) % c)


def py_chunks(x, c):
    p = py_pad(x, c)
    return [p[i:i + c] for i in range(0, len(p), c)]


def py_full(x, c):
    return [x[i:i + c] for i in range(0, len(x) - len(x) % c, c)]


def py_last_full(x, c):
    return x[-c:] if x and len(x) % c == 0 else None


def py_mask(x):
    if 1 not in x:
        return x
    f = x.index(1)
    return x[:f + 1] + [0] * (len(x) - f - 1)


def test_array_functions_match_python(spark):
    rnd = random.Random(11)
    data = [[rnd.choice([1, 3, 4, 5, 6]) for _ in range(rnd.randint(0, 13))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, ids array<int>")
    r = df.select("i", A.pad_to_multiple("ids", C).alias("pad"), A.chunk_array("ids", C).alias("ch"),
                  A.full_chunks("ids", C).alias("full"), A.last_full_chunk("ids", C).alias("last"),
                  A.mask_after_eos("ids").alias("mask"), A.drop_last("ids").alias("dl"),
                  A.lm_shift_label("ids").alias("lab"), A.pad_left("ids", 13, 0).alias("pl"),
                  A.pad_right("ids", 13, 1).alias("pr"), A.attention_mask("ids", 13).alias("am")).collect()
    for row in r:
        x = data[row.i]
        assert row.pad == py_pad(x, C)
        assert row.ch == py_chunks(x, C)
        assert row.full == py_full(x, C)
        assert row.last == py_last_full(x, C)
        assert row.mask == py_mask(x)
        assert row.dl == x[:-1] and row.lab == x[1:]
        assert row.pl == [0] * (13 - len(x)) + x and row.pr == x + [1] * (13 - len(x))
        assert row.am == [True] * len(x) + [False] * (13 - len(x))
