"""Text expressions: Python-style whitespace, pre-tokenization, JSON spelling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import kernels

# The code points Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Matches one character outside WHITESPACE.
NON_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"

# Pieces of the plain word dictionary.
WORDS = r"[^ \t\r\n]+"

# Fixed value: the tokenizer's pre-tokenization pattern.
PRETOKENS = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)"
    r"|[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+"
    r"|\p{N}"
    r"| ?[^\s\p{L}\p{M}\p{N}]+[\r\n]*"
    r"|\s*[\r\n]+"
    r"|\s+(?!\S)"
    r"|\s+"
)

# The tokenizer reads \s and \S as Unicode classes; Java does so only under this flag.
UNICODE = "(?U)"
_CLASSES = ("\\s", "\\S")


def is_nonblank(text: Column) -> Column:
    """True for text with at least one non-whitespace character; false for null and blank."""
    return F.coalesce(text.rlike(NON_BLANK), F.lit(False))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def pieces(text: Column, pattern: str = WORDS) -> Column:
    """All matches of ``pattern``, in order."""
    flag = UNICODE if any(c in pattern for c in _CLASSES) else ""
    return F.regexp_extract_all(text, F.lit(flag + pattern), F.lit(0))


def _escape(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "_</>" else "\\" + c for c in literal)


def pieces_with_special(text: Column, special: list[str], pattern: str = WORDS) -> Column:
    """Like ``pieces``, but each special token in the text is one piece of its own.

    The text is first cut on both sides of every special token. The tokens all start with ``<``
    and end with ``>``, which lets both look-arounds give up after one character elsewhere.
    """
    if not all(s.startswith("<") and s.endswith(">") for s in special):
        raise ValueError("special tokens must be enclosed in angle brackets")
    any_of = "|".join(_escape(s) for s in sorted(special, key=lambda s: (-len(s), s)))
    boundary = f"(?=<)(?={any_of})|(?<=>)(?<={any_of})"
    segments = F.split(text, boundary)
    whole = F.array(*[F.lit(s) for s in special])
    return F.flatten(F.transform(
        segments,
        lambda s: F.when(F.array_contains(whole, s), F.array(s)).otherwise(pieces(s, pattern)),
    ))


def json_text(text: Column, ensure_ascii: bool = True, indent: int | None = None) -> Column:
    """A JSON text as spelled by Python's encoder, keeping the order of names; null if it is not JSON.

    Of repeated names the last value stays, at the place of the first. ``indent`` puts every item
    on a line of its own.
    """

    @F.arrow_udf(T.StringType())
    def spelled(values: pa.Array) -> pa.Array:
        rows = [kernels.dump_value(v, ensure_ascii, indent) for v in values.to_pylist()]
        return pa.array(rows, type=pa.string())

    return spelled(text)


def json_items(text: Column, ensure_ascii: bool = True, indent: int | None = None) -> Column:
    """The items of a JSON list as spelled by Python's encoder, keeping the order of names."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def items(values: pa.Array) -> pa.Array:
        rows = [kernels.dump_list(v, ensure_ascii, indent) for v in values.to_pylist()]
        return pa.array(rows, type=pa.list_(pa.string()))

    return items(text)


def argument_blocks(arguments: Column, ensure_ascii: bool = True) -> Column:
    """Render ``array<array<json object>>`` (calls per message) to parameter tag text."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def blocks(values: pa.Array) -> pa.Array:
        rows = [
            None if row is None else [
                None if calls is None else [kernels.argument_block(c, ensure_ascii) for c in calls]
                for calls in row
            ]
            for row in values.to_pylist()
        ]
        return pa.array(rows, type=pa.list_(pa.list_(pa.string())))

    return blocks(arguments)


def json_equal(left: Column, right: Column) -> Column:
    """Compare two JSON texts by value."""

    @F.arrow_udf(T.BooleanType())
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([kernels.same_json(x, y) for x, y in pairs], type=pa.bool_())

    return equal(left, right)
