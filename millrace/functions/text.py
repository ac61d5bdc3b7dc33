"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE = (r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
SPACE_POINTS = [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                0x2028, 0x2029, 0x202f, 0x205f, 0x3000]
SPACE_CHARS = "".join(map(chr, SPACE_POINTS))
MIN_CHARS = 120
NO_CONTEXT = "No relevant context found."


def strip(text: Column) -> Column:
    """Drop every kind of Unicode white space at both ends (plain `trim` drops
    only the ASCII space)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalise(text: Column) -> Column:
    """Strip, then turn three or more newlines into two."""
    stripped = strip(text)
    crowded = F.contains(stripped, F.lit("\n\n\n"))
    return F.when(crowded, F.regexp_replace(stripped, r"\n{3,}", "\n\n")).otherwise(stripped)


def words(text: Column) -> Column:
    return F.split(text, " ")


def word_ids(text: Column) -> Column:
    """Stand-in tokenizer that SQL can repeat: one id in 1..65536 per
    space-separated word, from its ends and its length.  Id 0 is free for the
    end marker."""
    code = lambda word: ((F.ascii(word) * 8191 + F.ascii(F.right(word, F.lit(1))) * 127
                          + F.length(word)) % 65536 + 1)
    return F.transform(words(text), code)


def prompt(context: Column, question: Column) -> Column:
    """The question prompt; nothing follows the last colon."""
    return F.concat(F.lit("Context: "), context, F.lit("\nQuestion: "), question,
                    F.lit("\nAnswer:"))


def clean_answer(text: Column) -> Column:
    """Strip, cut at the first `<|`, strip again."""
    return strip(F.substring_index(strip(text), "<|", 1))


def count_of(text: Column, needle: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def ends_sentences(text: Column) -> Column:
    """At least two periods, and the stripped text ends in one."""
    return (count_of(text, ".") >= 2) & F.endswith(strip(text), F.lit("."))
