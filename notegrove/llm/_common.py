"""What the operators of this subpackage share: table access, stage tables, character classes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from ..storage import released, small_batches
from ..storage import settled as written

__all__ = ["BEYOND_LATIN", "LATIN_END", "LETTER", "NUMBER", "SPACE", "released", "small_batches", "table", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to this code point the Unicode classes below are the same in every library used here.
LATIN_END = 0x180


def _class(major: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == major)


LETTER, NUMBER = _class("L"), _class("N")
#: White_Space of Unicode below LATIN_END.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")
