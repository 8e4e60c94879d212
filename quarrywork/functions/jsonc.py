"""JSON as people write it in configurations: with comments, commas before closing brackets, and a byte order mark.

Two passes, each by a pattern that knows strings and gives them back, so that marks inside of them stay: comments go, then commas that a bracket follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string with its escapes, closed or to the end of its line; a comment of either kind; a comma before a closing bracket.
_STRING = r'"[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+"?'
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_STRAY = r",(?=\s*[\]}])"


def plain_json(text: Column) -> Column:
    """The same document as plain JSON; what is no JSON stays none. White space stands for a comment, as it keeps words apart, and after every string."""
    body = F.regexp_replace(text, "^\ufeff", "")
    for aside in (_COMMENT, _STRAY):
        body = F.regexp_replace(body, f"({_STRING})|{aside}", "$1 ")
    return body
