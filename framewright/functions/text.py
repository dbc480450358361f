"""Text cleaning, packing and similarity."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_html(text: Column) -> Column:
    """Without tags; a tag that holds a newline stays."""
    return F.regexp_replace(text, "<.*?>", "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def pack(texts: Column, mark: str = "#") -> Column:
    return F.array_join(texts, mark)


def unpack(text: Column, mark: str = "#") -> Column:
    return F.split(text, re.escape(mark))


def quote_url(text: Column) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def after_marker(page: Column, marker: str = 'class="t0">') -> Column:
    """What stands between the marker and the next tag."""
    return F.split_part(F.split_part(page, F.lit(marker), F.lit(2)), F.lit("<"), F.lit(1))


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def ratio(a: str, b: str) -> int:
    """Similarity from 0 to 100 by matching blocks, halves to even."""
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio()) if a or b else 0


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter text with any stretch of its length in the longer one that starts a matching block."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
    starts = {max(0, y - x) for x, y, _ in blocks}
    return max(ratio(short, long[s : s + len(short)]) for s in starts)


def similarity(a: Column, b: Column, func: Callable[[str, str], int] = ratio) -> Column:
    """func of two texts; null if either is null."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else func(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def translate(text: Column, words: dict[str, str] | None = None, func: Callable[[str], str] | None = None) -> Column:
    """Through func, or word by word through an offline dictionary; null where that fails. Nothing goes to a network."""
    words = words or {}
    func = func or (lambda t: " ".join(words.get(w, w) for w in t.split(" ")))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else func(t)
            except Exception:  # noqa: BLE001  any failure of a plugged-in service
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)
