"""Time-ordered identifiers (version 7): 48 bits of milliseconds, 12 of a counter, 62 of chance."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def uuid7(count: int = 1) -> list[str]:
    out, last, counter = [], 0, 0
    for _ in range(count):
        now = time.time_ns() // 1_000_000
        if now <= last:
            counter += 1
            if counter > 0xFFF:
                last, counter = last + 1, 0
        else:
            last, counter = now, 0
        value = last << 80 | 7 << 76 | counter << 64 | 2 << 62 | int.from_bytes(os.urandom(8), "big") >> 2
        h = f"{value:032x}"
        out.append(f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
    return out


def event_id(of: Column) -> Column:
    """A new identifier for each row; never the same twice, so write it before it is used twice."""

    @pandas_udf("string")
    def make(v: pd.Series) -> pd.Series:
        return pd.Series(uuid7(len(v)))

    return make.asNondeterministic()(of)
