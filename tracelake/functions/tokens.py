"""Token counts by a tokenizer that the caller brings."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def counted_tokens(encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """A column function that counts a text's tokens, 0 for a null one. encoder makes the encoding function, once a task: it may load a vocabulary."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return count
