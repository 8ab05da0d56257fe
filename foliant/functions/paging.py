"""Word-boundary paging of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PAGE_CHARS = 2000


def cut_pages(text: str, limit: int = PAGE_CHARS) -> list[str]:
    """Pages that concatenate to the text.

    A cut falls before a blank, else after the last blank (then line break) that fits,
    else in the middle of the word.
    """
    pages = []
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text) and text[end] not in " \n":
            for blank in " \n":
                spot = text.rfind(blank, at + 1, end)
                if spot > 0:
                    end = spot + 1
                    break
        pages.append(text[at:end])
        at = end
    return pages


@F.pandas_udf(ArrayType(StringType()))
def page_pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(cut_pages)
