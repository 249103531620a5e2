"""Text functions shared by admission and scoring. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character that counts as white space when a request text is stripped
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

NON_LETTERS = r"[^\p{L}]+"


def stripped(text: Column) -> Column:
    """The text without leading and trailing white space, Unicode spaces included."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Lower-case words; a word is a run of letters."""
    return F.split(F.lower(text), NON_LETTERS)


def vocabulary_hits(tokens: Column, vocabulary: tuple[str, ...]) -> Column:
    """The different words of the vocabulary among the tokens."""
    listed = F.split(F.lit(" ".join(vocabulary)), " ")  # folded to one literal
    return F.array_intersect(tokens, listed)


def fixed3(number: Column) -> Column:
    """Three decimals, ties to even, no grouping."""
    return F.replace(F.format_number(number, 3), F.lit(","), F.lit(""))
