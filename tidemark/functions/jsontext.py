"""JSON texts as they are written: keys that repeat in an object."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:]', re.DOTALL)


def _name(token: str) -> str:
    """A key as it reads; half a surrogate pair, which no table can hold, as ?."""
    return json.loads(token, strict=False).encode("utf-8", "replace").decode() if "\\" in token else token[1:-1]


def _repeats(text: str) -> list[str]:
    open_: list[set[str] | None] = []
    last, out = "", []
    for t in TOKENS.findall(text):
        if t == ":":
            if open_ and open_[-1] is not None and last.startswith('"'):
                name = _name(last)
                if name in open_[-1]:
                    out.append(name)
                open_[-1].add(name)
        elif t in "{[":
            open_.append(set() if t == "{" else None)
        elif t in "}]" and open_:
            open_.pop()
        last = t
    return out


def repeated_keys(text: Column) -> Column:
    """The keys that stand more than once in one object of a JSON text, at any depth, in order of their repeats; each as often as it repeats.

    Parsers drop the repeats, so the text's own tokens are read with a stack of the keys of open objects, in one pass.
    Escapes are decoded first: "a" and "\\u0061" are one key. A null text gives null; the text is taken to be valid JSON.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _repeats(t) for t in texts], dtype="object")

    return run(text)
