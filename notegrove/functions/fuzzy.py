"""Edit distance with transpositions (optimal string alignment) and typo suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str) -> int:
    """Edits between a and b, ASCII case aside; a transposed pair is one edit and isn't edited again."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    a, b = a.translate(fold), b.translate(fold)
    older, old = [], [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return old[-1]


def allowed(length: int) -> int:
    return 1 if length <= 3 else 2 if length <= 7 else 3


@F.pandas_udf(T.IntegerType())
def osa_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
