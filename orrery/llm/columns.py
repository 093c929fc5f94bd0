"""Column builders that several operators share; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of words: 09-0D and 20.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs without white space; null for null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. Counts the pieces between white space, of which the
    first or the last is empty if the text begins or ends with white space."""
    text = F.coalesce(text, F.lit(""))
    blank = lambda c: (F.ascii(c) == 32) | F.ascii(c).between(9, 13)
    edges = ((text == "") | blank(F.substring(text, 1, 1))).cast("long") + blank(F.substring(text, -1, 1)).cast("long")
    return F.size(F.split(text, SPACE + "+")).cast("long") - edges
