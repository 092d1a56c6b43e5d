"""XXH3-64, which Spark's own hashes don't cover, by Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DecimalType(20, 0))
def xxh3_64(data: pd.Series) -> pd.Series:
    """Unsigned 64-bit XXH3 of UTF-8 text; null stays null."""
    from decimal import Decimal

    import xxhash

    return data.map(lambda x: None if x is None else Decimal(xxhash.xxh3_64_intdigest(x.encode() if isinstance(x, str) else bytes(x))))


@F.pandas_udf(T.ArrayType(T.DecimalType(20, 0)))
def xxh3_64_each(data: pd.Series) -> pd.Series:
    """The same of each text of an array; null stays null."""
    from decimal import Decimal

    import xxhash

    return data.map(lambda xs: None if xs is None else [None if x is None else Decimal(xxhash.xxh3_64_intdigest(x.encode())) for x in xs])


#: Marked so that the optimizer neither repeats it nor moves it into a lambda, where no Python function can run.
xxh3_64_each = xxh3_64_each.asNondeterministic()
