"""The tables' schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T



_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


SOURCE = struct(path=_S, content=T.BinaryType())
WARNING = struct(seq=T.LongType(), stage=_S, text=_S)
SYMBOL = struct(id=_S, path=_S, name=_S, module=_S, owner=_S, start=_I, end=_I, source=_S, preamble=_S, language=_S)
EDGE = struct(src=_S, dst=_S)
HASH = struct(path=_S, hash=_S)
LESSON = struct(id=T.LongType(), scope=_S, lesson=_S, evidence=_S, evidence_hash=_S, scope_hash=_S, status=_S, created_at=_S)
CALL = struct(symbol=_S, parts=T.ArrayType(_S), candidate=_S)
#: A call of a web-language file: local, import or unresolved.
WEB_CALL = struct(symbol=_S, kind=_S, name=_S, module=_S, export=_S)
#: What only a web-language file has: calls, relative imports, exports and reassigned names.
WEB = struct(calls=T.ArrayType(WEB_CALL), imports=T.ArrayType(struct(module=_S, base=_S)), exports=T.ArrayType(struct(export=_S, local=_S)), unsafe=T.ArrayType(_S))
#: What is found in one source file.
UNIT = struct(
    path=_S, hash=_S, module=_S, warnings=T.ArrayType(_S), aliases=T.MapType(_S, _S),
    symbols=T.ArrayType(SYMBOL), calls=T.ArrayType(CALL), web=WEB,
)
HUNK = struct(path=_S, seq=_I, kind=_S, old_start=_I, old_count=_I, new_start=_I, new_count=_I)
TRIAL = struct(task=_S, condition=_S, outcome=_S, input_tokens=T.LongType(), output_tokens=T.LongType(), cost=T.DoubleType())
