"""Schema-aware compiler of dotted paths into Column expressions.

A path such as ``a.b[0].c`` or ``lines[-1].ship`` is resolved against the
DataFrame schema at plan time and becomes ``getField`` / ``get`` /
``try_element_at`` calls, so extraction is native and column-pruned.

Semantics: any miss gives null; an index on a non-array, or a field on an
array without an index, gives null (quirk Q21); negative indexes count from
the end.  ``"a | b"`` gives the day difference b - a when both are full ISO
dates; three or more paths give null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import iso_date_strict

_TOKEN = re.compile(r"^([^\[\]]+)(?:\[(-?\d+)\])?$")


def _null(dtype: T.DataType | None = None) -> tuple[Column, T.DataType]:
    return F.lit(None).cast(dtype or T.StringType()), (dtype or T.StringType())


def path_steps(path: str) -> list[tuple[str, int | None]]:
    """(name, index) of every step of a dotted path; a path that is none: []."""
    found = [_TOKEN.match(tok) for tok in path.strip().split(".")]
    return [(m.group(1), None if m.group(2) is None else int(m.group(2))) for m in found] if all(found) else []


def compile_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Return (Column, dtype) for a dotted path; unresolvable -> null literal."""
    col: Column | None = None
    dtype: T.DataType = schema
    for key, i in path_steps(path):
        if not isinstance(dtype, T.StructType):
            return _null()
        fields = {f.name: f for f in dtype.fields}
        if key not in fields:
            return _null()
        col = F.col(f"`{key}`") if col is None else col.getField(key)
        dtype = fields[key].dataType
        if i is not None:
            if not isinstance(dtype, T.ArrayType):
                return _null()
            col = F.get(col, i) if i >= 0 else F.try_element_at(col, F.lit(i))
            dtype = dtype.elementType
    return (col, dtype) if col is not None else _null()


def value_from_paths(schema: T.StructType, spec: str) -> Column:
    """One path -> value; two paths -> day difference of ISO dates; else null."""
    parts = [p.strip() for p in spec.split("|")]
    if len(parts) == 1:
        return compile_path(schema, parts[0])[0]
    if len(parts) == 2:
        cols = [compile_path(schema, p)[0].cast("string") for p in parts]
        d1, d2 = iso_date_strict(cols[0]), iso_date_strict(cols[1])
        return F.datediff(d2, d1).cast("long")
    return F.lit(None).cast("long")
