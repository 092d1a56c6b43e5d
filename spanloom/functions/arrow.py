"""Rows made of rows by plain Python functions, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .types import struct


def byte_offsets(text: str):
    """Byte offset of each code point and of the end, in one pass."""
    if text.isascii():
        return range(len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))]).tolist()


def per_row(rows: DataFrame, keep: list[str], schema: str, run) -> DataFrame:
    """The columns ``keep`` and, for each row that run(*values of the row) yields, those of ``schema`` (see types.struct)."""
    names = rows.columns
    out = StructType([rows.schema[c] for c in keep] + struct(schema).fields)
    made_as = to_arrow_schema(out)
    places = [names.index(c) for c in keep]

    def go(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = zip(*(part.column(n).to_pylist() for n in names), strict=True)
                made = [(*(v[p] for p in places), *got) for v in values for got in run(*v)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), made_as, strict=True)], names=made_as.names)

    return rows.mapInArrow(go, out)
