"""Several values packed in one field: a quote-aware finite-state tokenizer.

The tokenizer reads the field once, from left to right. Its state is: between
values, in an unquoted word, or in a quoted value (with the quote that closes
it), together with the nesting depth of brackets. Delimiters split only
outside quotes; a bracket or quote is structure only where a value may begin
or end, and part of the word otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
DELIMITERS = ",;|&，；、｜＆"
OPENERS = {"[": "]", "(": ")", "{": "}", "（": "）", "【": "】"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "「": "」", "`": "`", "„": "“", "＂": "＂"}
STAND_INS = {
    "", "none", "null", "nil", "n/a", "na", "nan", "n.a.", "unknown", "undefined", "tbd",
    "not available", "not applicable", "no identifier", "无", "暂无",
}
JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
# --------------------------------------------------------------------------

CLOSERS = set(OPENERS.values())
BLANKS = "﻿​⁠"
_PLAIN = re.compile(r"[A-Za-z0-9]+(?:[-:._/][A-Za-z0-9]+)*\Z")
_HAS_WORD = re.compile(r"[^\W_]")
_HEX4 = re.compile(r"[0-9A-Fa-f]{4}")


def _ends_value(text: str, at: int) -> bool:
    """Whether what stands at ``at`` may follow a quoted value."""
    if at >= len(text):
        return True
    ch = text[at]
    return ch.isspace() or ch in DELIMITERS or ch in CLOSERS or ch in BLANKS or ch == ":"


def _quoted(text: str, start: int, close: str) -> tuple[str, int] | None:
    """The value quoted from ``start`` (after its opening quote) and the place
    after the closing quote, or None if the quote never closes."""
    out: list[str] = []
    at, size = start, len(text)
    while at < size:
        ch = text[at]
        if ch == "\\" and at + 1 < size:
            follow = text[at + 1]
            if follow == "u" and _HEX4.match(text, at + 2):
                out.append(chr(int(text[at + 2 : at + 6], 16)))
                at += 6
                continue
            if follow in ('"', "'", "\\", "/", close):
                out.append(follow)
                at += 2
                continue
            if follow in JSON_ESCAPES and close == '"':
                out.append(JSON_ESCAPES[follow])
                at += 2
                continue
        elif ch == close:
            if text[at + 1 : at + 2] == close and close in "\"'`":
                out.append(ch)
                at += 2
                continue
            if close != "'" or _ends_value(text, at + 1):
                return "".join(out), at + 1
        out.append(ch)
        at += 1
    return None


def _surrogates(value: str) -> str:
    """Joins the halves of characters that were escaped as two units."""
    if any("\ud800" <= ch <= "\udfff" for ch in value):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return value


def tokenize(text: str | None) -> list[str]:
    """The values packed in ``text``, in order, repeated values repeated.

    Null, blank and stand-ins for "none" (quoted or not) give no value and take
    no place; a word without any letter or digit is no value either. A quote
    that never closes is ignored and what follows it is read unquoted. Linear
    in the length of the text.
    """
    if text is None:
        return []
    if _PLAIN.match(text):
        return [] if text.lower() in STAND_INS else [text]
    values: list[str] = []
    at, size, depth = 0, len(text), 0
    unclosed: set[str] = set()
    while at < size:
        ch = text[at]
        if ch.isspace() or ch in DELIMITERS or ch in BLANKS:
            at += 1
        elif ch in OPENERS:
            depth += 1
            at += 1
        elif ch in CLOSERS:
            depth = max(0, depth - 1)
            at += 1
        elif ch in QUOTES and QUOTES[ch] not in unclosed:
            found = _quoted(text, at + 1, QUOTES[ch])
            if found is None:
                unclosed.add(QUOTES[ch])
                at += 1
                continue
            value, at = found
            after = at
            while after < size and text[after].isspace():
                after += 1
            if depth and text[after : after + 1] == ":":
                at = after + 1  # the name of a member, not a value
                continue
            values.append(_surrogates(value).strip().strip(BLANKS))
        elif ch in QUOTES or ch == ":":
            at += 1
        else:
            start, inner = at, 0
            while at < size:
                ch = text[at]
                if ch.isspace() or ch in DELIMITERS or ch in BLANKS:
                    break
                if ch in OPENERS:
                    inner += 1
                elif ch in CLOSERS:
                    if not inner:
                        break
                    inner -= 1
                at += 1
            values.append(text[start:at])
    return [v for v in values if v.lower() not in STAND_INS and _HAS_WORD.search(v)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(tokenize)


def split_packed(df: DataFrame, column: str, keys: list[str], value_name: str, pos_name: str = "value_pos") -> DataFrame:
    """One row per value packed in ``column``: ``keys``, ``pos_name`` (bigint,
    from 1) and ``value_name``.

    Rows without values give no rows; an empty input gives an empty result.
    Other columns of ``df`` are not carried, so their names cannot clash. The
    operator is row-local: no shuffle, whatever repeats in the field.
    """
    packed = df.where(F.col(column).isNotNull()).select(*keys, tokenize_udf(F.col(column)).alias("__values"))
    return packed.select(*keys, F.posexplode("__values").alias("__pos", value_name)).select(
        *keys, (F.col("__pos") + 1).cast("bigint").alias(pos_name), value_name
    )
