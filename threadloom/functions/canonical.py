"""JSON in one fixed form, and the hash chain over it.

Variants don't keep 1.0 apart from 1 and order keys by UTF-16 units, so the form is written by an Arrow UDF.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def number(value: float) -> str:
    """Shortest digits that give the double back: plain from 1e-5 up to below 1e16, else with an exponent."""
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    exponent += len(digits) - len(text)
    point = len(text) + exponent
    if value == 0:
        body = "0.0"
    elif -5 < point <= 0:
        body = "0." + "0" * -point + text
    elif 0 < point <= 16:
        body = text.ljust(point, "0")[:point] + "." + (text[point:] or "0")
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"
    return "-" * sign + body


def canonical(value) -> str:
    """Keys in code-point order, no white space, shortest escapes. Walks with a stack of its own, so depth is free."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        now = todo.pop()
        if isinstance(now, _Raw):
            out.append(now)
        elif isinstance(now, dict):
            todo.append(_Raw("}"))
            for k, key in enumerate(sorted(now, reverse=True)):
                todo += [now[key], _Raw(("," if k < len(now) - 1 else "") + json.dumps(key, ensure_ascii=False) + ":")]
            todo.append(_Raw("{"))
        elif isinstance(now, list):
            todo.append(_Raw("]"))
            for k, item in enumerate(reversed(now)):
                todo += [item, _Raw("," if k < len(now) - 1 else "")]
            todo.append(_Raw("["))
        elif isinstance(now, float) or (isinstance(now, int) and not isinstance(now, bool) and not -(1 << 63) <= now < 1 << 64):
            out.append(number(float(now)))
        else:
            out.append(json.dumps(now, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that is written as it stands."""


def _refuse(name: str):
    raise ValueError(name)


def parsed(text: str):
    return json.loads(text, parse_constant=_refuse)


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null for null or what is no JSON. Of repeated keys the last counts."""

    def form(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return canonical(parsed(text))
        except (ValueError, RecursionError, OverflowError):
            return None

    return texts.map(form)


def receipt_hash(domain: str, prev: Column, body: Column) -> Column:
    """The link of a chain: SHA-256 of domain, previous hash and canonical body, a line each; null where the body is no JSON."""
    return F.sha2(F.concat(F.lit(domain + "\n"), prev, F.lit("\n"), canonical_json(body)), 256)
