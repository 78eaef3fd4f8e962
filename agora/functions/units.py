"""Text forms that no built-in function gives, as vectorised functions over single values."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut_bytes(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` UTF-8 bytes, each as long as can be, cut between code points only."""
    data, pieces, start = text.encode("utf-8"), [], 0
    while start < len(data):
        end = min(start + most, len(data))
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            raise ValueError(f"a code point is longer than {most} bytes")
        pieces.append(data[start:end].decode("utf-8"))
        start = end
    return pieces


def byte_units(most: int):
    """Column function: a text as pieces of at most ``most`` bytes; null stays null, an empty text has no piece."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_bytes(t, most), na_action="ignore")

    return split


def byte_prefix(most: int):
    """Column function: the longest start of a text of at most ``most`` bytes."""

    @F.pandas_udf(T.StringType())
    def head(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.encode("utf-8")[:most].decode("utf-8", "ignore"), na_action="ignore")

    return head


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility form with white space around it removed and runs of it made one space."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_trimmed(texts: pd.Series) -> pd.Series:
    """Compatibility form with white space around it removed; inner white space stays."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with keys sorted at every depth and no spaces; text that is not JSON gives null."""

    def sorted_keys(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(sorted_keys, na_action="ignore")
