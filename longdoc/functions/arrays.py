"""Token-array expressions: C3-C5, C8-C10, C12 and padding.

All are higher-order SQL functions, evaluated row-locally on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longdoc.constants import EOS, PAD


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_last(ids) -> Column:
    """Prompt ids are the tokenized prompt without its trailing EOS."""
    c = _c(ids)
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def pad_to_multiple(ids, c: int, pad: int = PAD) -> Column:
    """C4: pad right so the length is a multiple of c (0 padding if exact)."""
    x = _c(ids)
    return F.concat(x, F.array_repeat(F.lit(pad), F.pmod(-F.size(x), F.lit(c))))


def full_chunks(ids, c: int) -> Column:
    """Only the full chunks, floor(n / c) of them (no padding). ``ids`` should be
    a column: an expression would be evaluated anew for every chunk."""
    x = _c(ids)
    n = F.floor(F.size(x) / c).cast("int")
    return F.transform(F.array_repeat(F.lit(0), n), lambda _, i: F.slice(x, i * c + 1, c))


def chunk_array(ids, c: int, pad: int = PAD) -> Column:
    """C4 + C5: [n, c], the last chunk padded right. Each chunk copies its own c ids only, so
    the work is linear in the length; ``ids`` should be a column, as above."""
    x = _c(ids)
    n = F.ceil(F.size(x) / c).cast("int")
    return F.transform(F.array_repeat(F.lit(0), n), lambda _, i: F.concat(
        F.slice(x, i * c + 1, c), F.array_repeat(F.lit(pad), F.greatest((i + 1) * c - F.size(x), F.lit(0)))))


def last_full_chunk(ids, c: int) -> Column:
    """The last c ids when the length is a positive multiple of c, else NULL."""
    x = _c(ids)
    return F.when((F.size(x) > 0) & (F.pmod(F.size(x), F.lit(c)) == 0), F.slice(x, -c, c))


def mask_after_eos(ids, eos: int = EOS, pad: int = PAD) -> Column:
    """Everything after the first EOS becomes PAD; EOS itself stays."""
    x = _c(ids)
    first = F.array_position(x, eos).cast("int")
    masked = F.concat(F.slice(x, 1, first), F.array_repeat(F.lit(pad), F.size(x) - first))
    return F.when(first > 0, masked).otherwise(x)


def lm_shift_input(ids) -> Column:
    """input = all but the last id."""
    return drop_last(ids)


def lm_shift_label(ids) -> Column:
    """label = all but the first id."""
    x = _c(ids)
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def pad_right(ids, length, value: int) -> Column:
    """Pad right with ``value`` up to ``length`` (F3, F4, F5 default side)."""
    x = _c(ids)
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(_len(length) - F.size(x), F.lit(0))))


def pad_left(ids, length, value: int) -> Column:
    """F5 left side; an empty row becomes all padding (quirk Q17 fixed)."""
    x = _c(ids)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(_len(length) - F.size(x), F.lit(0))), x)


def attention_mask(ids, length) -> Column:
    """true for positions before the unpadded length, false after."""
    n = F.size(_c(ids))
    return F.transform(F.array_repeat(F.lit(0), _len(length)), lambda _, i: i < n)


def _len(length) -> Column:
    return F.lit(length) if isinstance(length, int) else _c(length)


def ids_text(ids, sep: str = " ") -> Column:
    """Array of ints as one string (stable comparison form)."""
    return F.array_join(_c(ids).cast("array<string>"), sep)


def nested_text(ids, sep_outer: str = "|", sep_inner: str = " ") -> Column:
    return F.array_join(F.transform(_c(ids), lambda row: ids_text(row, sep_inner)), sep_outer)
