"""Naming an intermediate value inside one expression, and look-up tables as literals."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    The optimizer merges neighbouring projections and copies an expression into every place
    that names it, inside a lambda even once for each element; a lambda's own variable is
    never copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(table: Mapping[str, object], kind: str) -> Callable[[Column], Column]:
    """A function that looks a text up in a literal table of values of SQL type ``kind``.

    A look-up in one map literal reads it from the start; so the table is an array of small
    maps, of which the CRC of the text names one.
    """
    n = 1 << max(0, (len(table) // 8).bit_length())
    buckets: list[dict] = [{} for _ in range(n)]
    for k, v in table.items():
        buckets[zlib.crc32(k.encode()) % n][k] = v
    maps = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), f"array<map<string,{kind}>>")  # folded to one literal
    return lambda c: F.try_element_at(F.element_at(maps, (F.crc32(F.encode(c, "UTF-8")) % n).cast("int") + 1), c)
