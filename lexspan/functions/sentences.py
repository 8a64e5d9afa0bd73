"""Sentence spans: positions of all matches have no built-in, so this is the one Arrow UDF of the text functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Where a sentence ends, and abbreviations after which it doesn't.
SENTENCE_END = r"([.!?][”\"’)]?)(\s+)(?=[A-Z(“\"$\d])"
ABBREVIATION_END = r"\b(U\.S|Inc|No|Co|Corp|vs|e\.g|i\.e|Mr|Ms|Dr|Jr|Sr)\.$"
_END, _ABBREVIATION = re.compile(SENTENCE_END), re.compile(ABBREVIATION_END)


def spans_of(text: str) -> list[tuple[int, int]]:
    """[begin, end) of each sentence; what lies between them is white space."""
    breaks = [m for m in _END.finditer(text) if not _ABBREVIATION.search(text, max(0, m.end(1) - 6), m.end(1))]
    begins = [0, *(m.end() for m in breaks)]
    ends = [*(m.end(1) for m in breaks), len(text)]
    return [s for s in zip(begins, ends) if s[0] < s[1]]


_SPANS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_SPANS)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"begin": a, "end": b} for a, b in spans_of(t)] if t is not None else None)
