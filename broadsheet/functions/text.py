"""Text columns: stripping, reference decoding, title and body extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.binding import let

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The five references every markup document may use.
BASIC_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

# Named references decoded in body text, beyond the basic five.
PROSE_ENTITIES = {
    "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "deg": "°",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥",
    "sect": "§", "para": "¶", "times": "×", "frac12": "½",
}

BLANKS = r"[ \t\r\f\x{A0}]+"


def strip_all(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def code_point(number: Column) -> Column:
    """The character with this code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")


def decode_references(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Replace ``&name;``, ``&#n;`` and ``&#xn;`` by their characters in one pass."""
    table = {**PROSE_ENTITIES, **BASIC_ENTITIES} if entities is None else entities

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        # Leading zeros say nothing; a number of more than 10 digits is no character.
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(piece.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short)
        number = F.when(F.length(short) <= 10, number).try_cast("bigint")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        out = F.when(~piece.startswith("&"), piece)
        for name, char in table.items():
            out = out.when(piece == f"&{name};", F.lit(char))
        return out.when(piece.startswith("&#") & known, code_point(number)).otherwise(piece)

    pieces = F.regexp_extract_all(
        text, F.lit("&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"), F.lit(0)
    )
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def extract_title(html: Column) -> Column:
    """Text of the first ``<title>``, decoded and stripped; ``''`` if there is none."""
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return strip_all(let(raw, lambda t: decode_references(t)))


def extract_text(html: Column) -> Column:
    """Readable text of a page: one line per paragraph, heading, list item or break.

    The region is the first ``<article>``, else the ``<body>`` without navigation,
    header, footer and aside, else the whole page.
    """
    bare = F.regexp_replace(
        html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", ""
    )

    def region(page: Column) -> Column:
        article = F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)", 1)
        body = F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
        outer = F.regexp_replace(
            F.when(page.rlike(r"(?i)<body\b"), body).otherwise(page),
            r"(?is)<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<aside\b.*?</aside\s*>",
            "",
        )
        return F.when(page.rlike(r"(?i)<article\b"), article).otherwise(outer)

    lines = F.regexp_replace(let(bare, region), r"(?i)</p\s*>|<br\s*/?>|</h[1-6]\s*>|</li\s*>", "\n")
    plain = let(F.regexp_replace(lines, r"<[^>]*>", ""), lambda t: decode_references(t))
    tidy = F.regexp_replace(F.regexp_replace(plain, BLANKS, " "), r" ?\n[ \n]*", "\n")
    return strip_all(tidy)
