"""Text functions as Column builders; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the token heuristic.
WORD_CLASS = "A-Za-z0-9_`"
WIDE_CLASS = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\uff00-\\uffef"


def token_count(text: Column) -> Column:
    """Heuristic token count: word runs, plus wide characters, plus a quarter of all the rest.

    Null counts as null, the empty string as 0, any other text as 1 at least.
    """
    no_words = F.regexp_replace(text, f"[{WORD_CLASS}]+", "")
    no_wide = F.regexp_replace(no_words, f"[{WIDE_CLASS}]+", "")
    words = F.regexp_count(text, F.lit(f"[{WORD_CLASS}]+"))
    rest = F.length(no_wide)
    wide = F.length(no_words) - rest
    count = words + F.floor(rest / 4).cast("int") + wide
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), count)).cast("int")
