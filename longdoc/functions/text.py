"""Text expressions: B1-B3, B5, B7, B8 and the word splitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longdoc.constants import PAD_TOKEN, WS_REGEX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(col) -> Column:
    """Whitespace tokens: split on [ \\t\\n\\r]+, empty strings dropped."""
    return F.filter(F.split(_c(col), WS_REGEX), lambda t: t != "")


def flatten_abstract(col) -> Column:
    """B1: join sentences with one space, then delete "<S> ", then " </S>"."""
    return F.replace(F.replace(F.concat_ws(" ", _c(col)), F.lit("<S> "), F.lit("")),
                     F.lit(" </S>"), F.lit(""))


def flatten_text(col) -> Column:
    """B2: join body sentences with one space."""
    return F.concat_ws(" ", _c(col))


def build_prompt(title) -> Column:
    """B3: "<pad>title: " + title + " abstract: "."""
    return F.concat(F.lit(PAD_TOKEN + "title: "), _c(title), F.lit(" abstract: "))


def new_style_id(col) -> Column:
    """The id when it contains a dot (new-style identifier), else NULL."""
    c = _c(col)
    return F.when(F.contains(c, F.lit(".")), c)


# The characters Python's str.strip() removes (str.isspace()).
STRIP_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def strip_text(col) -> Column:
    """Remove leading and trailing whitespace as Python's ``strip`` does
    (all Unicode whitespace, not only spaces as ``trim``)."""
    return F.regexp_replace(_c(col), f"^{STRIP_CLASS}+|{STRIP_CLASS}+\\z", "")


def trim_sections(names, sections, start: str = "introduction",
                  end: str = "conclusion") -> Column:
    """Keep sections from the first whose name contains ``start`` up to and
    including the first (at or after it) whose name contains ``end``; a missing
    marker keeps that side. Result: the kept sentences, flattened."""
    # places by array functions: in a lambda, an outer place would be sought anew for every section
    def place(held: Column) -> Column:
        return F.array_position(held, True).cast("int") - 1

    s0 = F.greatest(place(F.transform(_c(names), lambda x: F.contains(F.lower(x), F.lit(start)))), F.lit(0))
    ends = F.transform(_c(names), lambda x: F.contains(F.lower(x), F.lit(end)))
    e_pos = place(F.slice(ends, s0 + 1, F.greatest(F.size(ends) - s0, F.lit(0))))
    e_last = F.when(e_pos < 0, F.size(_c(sections)) - 1).otherwise(s0 + e_pos)
    kept = F.slice(_c(sections), s0 + 1, F.greatest(e_last - s0 + 1, F.lit(0)))
    return F.flatten(kept)
