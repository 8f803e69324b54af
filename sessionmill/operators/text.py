"""How a text is searched: in lower case, and with repeated characters collapsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_text(text: Column) -> Column:
    """Lower case, with the dotted capital I going to one plain i."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")
