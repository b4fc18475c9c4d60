"""Markup as an array of tokens, and what each token is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import BASIC_ENTITIES

# The grammar of a start tag and of its attributes.
TAG_NAME = r"[a-zA-Z][-_.a-zA-Z0-9]*"
ATTRIBUTE = (
    r"\s*([a-zA-Z_][-:.a-zA-Z_0-9]*)"
    r"(?:\s*=\s*('[^']*'|\"[^\"]*\"|[\]\[\-a-zA-Z0-9./,:;+*%?!&$()_#=~'\"@]*))?"
)
# Fixed value: a reference inside an attribute value.
REFERENCE = r"&(?:[a-zA-Z][-.a-zA-Z0-9]*|#[0-9]+);?"

DEFAULT_LITERAL_TAGS = ("script", "style")


def token_pattern(
    literal_tags: tuple[str, ...] = DEFAULT_LITERAL_TAGS, short_tags: bool = False, rest_tags: tuple[str, ...] = ()
) -> str:
    """One alternation that cuts any text into tokens without loss.

    A start tag of ``rest_tags`` takes all that follows with it. The alternation is left to right, so
    one inside a comment or a literal element is none.

    Constructs still open at the end of the text run to its end and count as data.
    The same pattern serves Java and Python (which spells ``\\z`` as ``\\Z``).
    """
    literal = [rf"(?i:<{t}\b[^<>]*>)[\s\S]*?(?:(?i:</{t}\s*>)|\z)" for t in literal_tags]
    short = [r"<[a-zA-Z][-.a-zA-Z0-9]*/[^/]*/"] if short_tags else []
    return "|".join(
        [rf"(?i:<(?:{'|'.join(rest_tags)})(?![-_.a-zA-Z0-9])[^<>]*>)[\s\S]*"] * bool(rest_tags)
        + literal
        + short
        + [
            r"<!--(?s:.*?)--\s*>",
            r"<!--(?s:.*)",
            r"<!\[(?s:.*?)\]\s*\]?\s*>",
            r"<!\[(?s:.*)",
            r"<[?!][^>]*>?",
            r"<>",
            r"<[a-zA-Z][^<>]*>?",
            r"</[^<>]*>?",
            r"&#[0-9]+(?:;|(?=[^0-9]))",
            r"&[a-zA-Z][-.a-zA-Z0-9]*(?:;|(?=[^a-zA-Z0-9]))",
            r"&#?[-.a-zA-Z0-9]*\z",
            r"[^<&]+",
            r"[<&]",
        ]
    )


def literal_pattern(literal_tags: tuple[str, ...]) -> str:
    """Start tag, content and end tag of an element whose content is not markup."""
    names = "|".join(literal_tags)
    return rf"(?is)^(<(?:{names})\b[^<>]*>)(.*?)(</(?:{names})\s*>)?\z"


def rest_start(rest_tags: tuple[str, ...]) -> str:
    """A start tag after which all is text."""
    return rf"^(?i:<(?:{'|'.join(rest_tags)})(?![-_.a-zA-Z0-9])[^<>]*>)"


def raw_tokens(
    html: Column, literal_tags: tuple[str, ...] = DEFAULT_LITERAL_TAGS, short_tags: bool = False, rest_tags: tuple[str, ...] = ()
) -> Column:
    """The tokens of a page in order; their concatenation is the page."""
    found = F.regexp_extract_all(html, F.lit(token_pattern(literal_tags, short_tags, rest_tags)), F.lit(0))
    if rest_tags:
        rest = rf"(?s)({rest_start(rest_tags)})(.*)\z"

        def part(token: Column) -> Column:
            pieces = F.array(F.regexp_extract(token, rest, 1), F.regexp_extract(token, rest, 2))
            return F.when(token.rlike(rest), F.filter(pieces, lambda p: p != "")).otherwise(F.array(token))

        found = F.flatten(F.transform(found, part))
    if not literal_tags:
        return found
    names = "|".join(literal_tags)
    whole = literal_pattern(literal_tags)

    def cut(token: Column) -> Column:
        pieces = F.array(*[F.regexp_extract(token, whole, i) for i in (1, 2, 3)])
        return F.when(token.rlike(rf"(?i)^<(?:{names})\b[^<>]*>"), F.filter(pieces, lambda p: p != "")).otherwise(
            F.array(token)
        )

    return F.flatten(F.transform(found, cut))


def token_kind(token: Column, last: Column) -> Column:
    """start, end, comment, declaration, instruction, charref, entityref or data."""
    closed = token.endswith(">") | ~last
    return (
        F.when(token.startswith("<!--"), F.when(token.rlike(r"(?s)^<!--.*--\s*>\z"), F.lit("comment")).otherwise("data"))
        .when(token.startswith("<?") & token.endswith(">"), F.lit("instruction"))
        .when(token.startswith("<!["), F.when(token.rlike(r"\]\s*\]?\s*>\z"), F.lit("declaration")).otherwise("data"))
        .when(token.startswith("<!") & token.endswith(">"), F.lit("declaration"))
        .when(token.rlike(r"^<[>a-zA-Z]") & closed, F.lit("start"))
        .when(token.startswith("</") & closed, F.lit("end"))
        .when(token.rlike(r"^&#[0-9]+;?\z") & (token.endswith(";") | ~last), F.lit("charref"))
        .when(token.rlike(r"^&[a-zA-Z][-.a-zA-Z0-9]*;?\z") & (token.endswith(";") | ~last), F.lit("entityref"))
        .otherwise(F.lit("data"))
    )


def start_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, f"^<({TAG_NAME})", 1))


def end_name(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(token, "(?s)^</([^<>]*)", 1), r"^\s+|\s+$", ""))


def _decode_value(value: Column, entities: dict[str, str]) -> Column:
    """References inside an attribute value: known names, and numbers up to 127."""

    def decode(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^&#([0-9]+)", 1).try_cast("int")
        out = F.when(~piece.startswith("&"), piece).when(number.between(0, 127), F.char(number))
        for name, char in entities.items():
            out = out.when(piece == f"&{name};", F.lit(char))
        return out.otherwise(piece)

    pieces = F.regexp_extract_all(value, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))
    decoded = F.array_join(F.transform(pieces, decode), "")
    return F.when(value.contains("&"), decoded).otherwise(value)


def attributes(token: Column, entities: dict[str, str] | None = None) -> Column:
    """Ordered ``(name, value)`` pairs of a start tag; duplicates are kept."""
    inner = F.regexp_replace(token, f"^<(?:{TAG_NAME})?|>\\z", "")
    # The list of attributes ends at the first thing that is not one.
    # Possessive, so that a tag of any length is matched without recursion.
    run = F.regexp_extract(inner, f"^(?:{ATTRIBUTE})*+", 0)
    found = F.regexp_extract_all(run, F.lit(ATTRIBUTE), F.lit(0))
    table = BASIC_ENTITIES if entities is None else entities

    def pair(text: Column) -> Column:
        name = F.regexp_extract(text, ATTRIBUTE, 1)
        raw = F.regexp_extract(text, ATTRIBUTE, 2)
        bare = F.regexp_replace(raw, "(?s)^'(?:(.*)')?\\z|^\"(?:(.*)\")?\\z", "$1$2")
        value = F.when(text.contains("="), _decode_value(bare, table)).otherwise(name)
        return F.struct(F.lower(name).alias("name"), value.alias("value"))

    return F.transform(found, pair)


def attribute(attrs: Column, name: str) -> Column:
    """Value of the first attribute with this name; NULL if there is none."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]
