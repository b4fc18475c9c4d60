"""Character classes of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes; the first that matches counts, O is the rest.
CHARACTER_CLASSES = [
    ("M", "[一二三四五六七八九十百千万億兆]"),
    ("H", "[一-龠々〆ヵヶ]"),
    ("I", "[ぁ-ん]"),
    ("K", "[ァ-ヺーｦ-ﾞ]"),
    ("A", "[a-zA-Zａ-ｚＡ-ＺÀ-ÖØ-öø-ÿĀ-ſ]"),
    ("N", "[0-9０-９]"),
]


def char_class(char: Column) -> Column:
    """Class of one character."""
    out = F
    for name, pattern in CHARACTER_CLASSES:
        out = out.when(char.rlike("^" + pattern), F.lit(name))
    return out.otherwise(F.lit("O"))


def class_string(text: Column) -> Column:
    """The classes of all characters of a text, as a string of the same length.

    Letters and digits go first: the class names written by the later steps are
    letters themselves.
    """
    by_name = dict(CHARACTER_CLASSES)
    out = text
    for name in ["A", "N", "M", "H", "I", "K"]:
        out = F.regexp_replace(out, by_name[name], name)
    return F.regexp_replace(out, "(?s)[^MHIKAN]", "O")


def class_table() -> bytes:
    """The class of each code point below 65536, as its place in ``MHIKANO``; all others are of the last class."""
    names, table = "MHIKANO", bytearray([6]) * 65536
    for name, pattern in reversed(CHARACTER_CLASSES):
        for found in re.finditer(pattern, "".join(map(chr, range(65536)))):
            table[found.start()] = names.index(name)
    return bytes(table)
