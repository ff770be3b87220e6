"""Functions over whole texts as Spark columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str) -> list[bytes]:
    """Words of the pattern ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes split at those blanks only."""
    return text.encode("utf-8", "surrogatepass").split()


_memo: list = ["", None]


def worker_memo(name: str, make: Callable[[], object]) -> object:
    """What a worker remembers from batch to batch. It has one memo, that of the last user."""
    if _memo[0] != name:
        _memo[:] = ["", None]
        pa.default_memory_pool().release_unused()
        _memo[:] = [name, make()]
    return _memo[1]


def in_slices(batches: Iterable, rows: int = 500) -> Iterator:
    """Smaller record batches or arrays, so that what is made from their texts stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def per_text(function: Callable[[str], tuple], schema: str) -> Callable[[Column], Column]:
    """A column function that maps a text to a struct of ``schema``; a null text counts as empty."""
    return per_texts(lambda texts: list(map(function, texts)), schema)


def per_texts(function: Callable[[list[str]], list[tuple]], schema: str) -> Callable[[Column], Column]:
    """``per_text`` with a function of some texts at a time."""
    kind = StructType.fromDDL(schema)
    types = [to_arrow_type(field.dataType) for field in kind]
    names = kind.names

    def batch(texts: pa.Array) -> pa.Array:
        rows = [row for part in in_slices([texts]) for row in function([text or "" for text in part.to_pylist()])]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        arrays = [pa.array(values, kind) for values, kind in zip(columns, types, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=names)

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, kind)
