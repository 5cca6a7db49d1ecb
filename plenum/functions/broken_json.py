"""Decode of model output that is almost JSON.

One scan with a stack of open brackets: quotes that cannot end their string become single
quotes, raw line breaks in strings are escaped, other control characters become blanks, commas before a
closing bracket go, a text that stops early is closed, and what follows the value is dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import let, parse_json, unwrap_json

_CLOSER = {"{": "}", "[": "]"}
_ESCAPED = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})')
#: What may stand behind a quote that ends a string: of a key, of a value of an object, of a value of an array.
_AFTER_KEY = re.compile(r"\s*:")
_AFTER_VALUE = re.compile(r'\s*(?:\Z|\}|,\s*(?:\Z|\}|"[^"\n]{0,200}"\s*:))')
_AFTER_ITEM = re.compile(r'\s*(?:\Z|\]|,\s*(?:\Z|\]|["{\[\-0-9]|true\b|false\b|null\b))')
_PLAIN_RUN = re.compile(r'[^"\\\x00-\x1f]+')
_LITERAL = re.compile(r"[^\s,:{}\[\]\"]+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")


def mend(text: str) -> str | None:
    """JSON for a text that should have been it; None when there is no bracket to start from."""
    start = re.search(r"[{\[]", text)
    if start is None:
        return None
    out: list[str] = []
    stack: list[str] = []
    state = ""  # what the innermost bracket waits for: k(ey), : (colon), v(alue), or , (comma)
    at, end = start.start(), len(text)

    def ended() -> None:
        nonlocal state
        state = ","

    def close() -> None:
        """Close the innermost bracket, whatever it waits for."""
        if state == ":":
            out.append(":null")
        elif state == "v" and stack[-1] == "{":
            out.append("null")
        if out[-1] == ",":
            out.pop()
        out.append(_CLOSER[stack.pop()])
        ended()

    while at < end:
        c = text[at]
        if c == '"':
            if state == ",":  # a forgotten comma
                out.append(",")
                state = "k" if stack[-1] == "{" else "v"
            elif state == ":":
                out.append(":")
                state = "v"
            key = state == "k"
            after = _AFTER_KEY if key else _AFTER_VALUE if stack[-1] == "{" else _AFTER_ITEM
            at, piece = _string(text, at + 1, after)
            out.append(piece)
            state = ":" if key else ","
        elif c in "{[":
            if state == "k" or (state == "," and stack[-1] == "{"):
                at += 1  # no key can begin here
                continue
            if state in (",", ":"):
                out.append(state)
            out.append(c)
            stack.append(c)
            state, at = ("k" if c == "{" else "v"), at + 1
        elif c in "}]":
            at += 1
            if c not in [_CLOSER[s] for s in stack[-8:]]:
                continue  # closes nothing that is open near by
            while _CLOSER[stack[-1]] != c:
                close()
            close()
            if not stack:
                break
        elif c == ":":
            if state == ":":
                out.append(":")
                state = "v"
            at += 1
        elif c == ",":
            if state == ",":
                out.append(",")
                state = "k" if stack[-1] == "{" else "v"
            at += 1
        elif c.isspace() or ord(c) < 32:
            at += 1
        else:
            word = _LITERAL.match(text, at)
            at = word.end()
            if state == ":":
                out.append(":")
                state = "v"
            if state == "v":
                out.append(_literal(word[0], at == end))
                ended()
    while stack:
        close()
    return "".join(out)


def _literal(word: str, last: bool) -> str:
    """A word outside strings: itself, null where the text broke off inside it, or a string."""
    if word in ("true", "false", "null") or _NUMBER.match(word):
        return word
    named = {"True": "true", "False": "false", "None": "null", "NaN": "null"}
    if word in named or last:
        return named.get(word, "null")
    return '"' + "".join(" " if ord(x) < 32 else "\\\\" if x == "\\" else x for x in word) + '"'


def _string(text: str, at: int, after: re.Pattern) -> tuple[int, str]:
    """The string that begins at ``at``, as JSON, and the place behind it."""
    out = ['"']
    while at < len(text):
        if run := _PLAIN_RUN.match(text, at):
            out.append(run[0])
            at = run.end()
            continue
        c = text[at]
        if c == "\\":
            if escape := _ESCAPE.match(text, at):
                out.append(escape[0])
                at = escape.end()
                continue
            if at + 1 < len(text):
                out.append("\\\\")
        elif c == '"':
            if after.match(text, at + 1):
                return at + 1, "".join([*out, '"'])
            out.append("'")
        else:
            out.append(_ESCAPED.get(c, " "))
        at += 1
    return at, "".join([*out, '"'])


def parse_broken_json(c: Column | str, schema: T.StructType) -> Column:
    """``parse_json``, and where that finds nothing the mended text decoded; null when that is no JSON either.

    Only texts that do not decode are sent to Python.
    """

    @F.arrow_udf("string")
    def mended(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mend(t) for t in texts.to_pylist()], pa.string())

    plain = parse_json(c, schema)
    again = F.from_json(mended(F.when(plain.isNull(), unwrap_json(c))), T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})
    return F.coalesce(plain, let(again, lambda v: F.when(v["_corrupt"].isNull(), v)).dropFields("_corrupt"))
