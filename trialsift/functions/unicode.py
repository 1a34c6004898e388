"""Arrow UDFs for the Unicode foldings Spark has no built-in for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Text whose folding needs no Unicode tables.
PLAIN = r"^[\x20-\x7E\t\n\x0B\f\r]*$"
_BROKEN = re.compile(r"(\w)-\s+(\w)")
#: What every broken word has; it begins with a fixed character, so that the search skips to it.
_MAYBE_BROKEN = re.compile(r"-\s")


def fold_quote(text: str) -> str:
    """Quote form of any text: compatibility characters, words joined over line ends, single blanks, case folded."""
    whole = unicodedata.normalize("NFKC", text).replace("\u00ad", "").casefold()
    if _MAYBE_BROKEN.search(whole):
        whole = _BROKEN.sub(r"\1\2", whole)
    return " ".join(whole.split())


@F.pandas_udf(StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(fold_quote, na_action="ignore")


def normalize_quote(text: Column) -> Column:
    """`fold_quote` of a column; plain ASCII is folded by the JVM and only the rest goes to Python."""
    text = F.col(text) if isinstance(text, str) else text
    joined = F.regexp_replace(F.lower(text), r"(\w)-\s+(\w)", "$1$2")
    plain = F.trim(F.regexp_replace(joined, r"\s+", " "))
    is_plain = text.rlike(PLAIN)
    return F.when(is_plain, plain).otherwise(_fold_unicode(F.when(~is_plain, text)))


@F.pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    def fold(text: str) -> str:
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")

    return texts.map(fold, na_action="ignore")
