"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
TEXTS = T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SYMBOL = struct(ordinal=I, name=S, kind=S, visibility=S, signature=S, decorators=TEXTS, implements=TEXTS, parent=S, line_start=I, line_end=I)
ANALYSIS = struct(path=S, language=S, imports=TEXTS, exports=TEXTS, symbols=T.ArrayType(SYMBOL), error=S)
FILE = struct(path=S, size_bytes=L, hash=S, content=T.BinaryType(), tracked=T.BooleanType())
CHANGE = struct(path=S, status=S, old_hash=S, new_hash=S)
CACHED_SYMBOL = struct(name=S, kind=S, visibility=S, signature=S, decorators=TEXTS)
SNAPSHOT = struct(path=S, hash=S, symbols=T.ArrayType(CACHED_SYMBOL))

# What kind, status and impact may be.
KINDS = ["class", "method", "function", "interface", "enum", "struct", "property", "field", "constructor"]
STATUSES = ["new", "modified", "deleted"]
IMPACTS = ["high", "medium", "low"]
#: Kinds that hold members.
CONTAINERS = ["class", "interface", "struct"]
