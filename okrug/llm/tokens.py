"""The public WordPunct tokens, in the JVM and in Python with the same classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PYTHON = re.compile(r"\w+|[^\w\s]+")

#: Python's \w and \s, spelt out for the JVM, whose own classes differ.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JVM = rf"[{WORD}]+|[^{WORD}{SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null and for texts without any."""
    return F.coalesce(F.regexp_count(text, F.lit(JVM)), F.lit(0))
