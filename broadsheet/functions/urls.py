"""URL columns: normalising, classifying, scoring and resolving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.binding import let
from broadsheet.functions.text import strip_all

# Endings of a URL that names a feed file.
FEED_ENDINGS = ["rss", "rdf", "xml", "atom"]

# Words that make a URL look like a feed.
FEED_WORDS = ["rss", "rdf", "xml", "atom", "feed"]

# Likelihood of a URL by the first word it contains.
FEED_LIKELIHOOD = [
    ("comments", -2),
    ("georss", -1),
    ("atom", 5),
    ("rss", 4),
    ("rdf", 3),
    (".xml", 2),
    ("feed", 1),
]

# Schemes whose references can be relative.
RELATIVE_SCHEMES = ["", "http", "https", "file", "ftp", "sftp", "ws", "wss"]

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def coerce_url(url: Column) -> Column:
    """Strip; ``feed://`` becomes ``http://``; a URL without scheme gets ``http://``."""
    u = strip_all(url)
    return (
        F.when(u.startswith("feed://"), F.regexp_replace(u, "^feed://", "http://"))
        .when(u.startswith("http://") | u.startswith("https://"), u)
        .otherwise(F.concat(F.lit("http://"), u))
    )


def is_feed_data(body: Column) -> Column:
    """True when the text is a feed document; NULL for a failed fetch."""
    low = F.lower(body)
    return ~low.contains("<html") & (
        low.contains("<rss") | low.contains("<rdf") | low.contains("<feed")
    )


def is_feed_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(" + "|".join(FEED_ENDINGS) + r")\z")


def is_feedlike_url(url: Column) -> Column:
    return F.lower(url).rlike("|".join(FEED_WORDS))


def url_feed_prob(url: Column) -> Column:
    """Likelihood that a URL is a feed; case-sensitive, the first word found decides."""
    score = F
    for word, value in FEED_LIKELIHOOD:
        score = score.when(url.contains(word), F.lit(value))
    return score.otherwise(F.lit(0))


def _split_url(url: Column) -> Column:
    groups = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}
    return F.struct(*[F.regexp_extract(url, "(?s)" + _SPLIT, g).alias(name) for name, g in groups.items()])


def _without_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    closed = F.array_join(kept, "/")
    ends_in_dots = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.when(ends_in_dots, F.concat(closed, F.lit("/"))).otherwise(closed)


def _relative_segments(base_path: Column, path: Column) -> Column:
    """Segments of a relative path below the folder of the base, without empty inner ones."""
    def below(folder: Column) -> Column:
        inner = F.filter(F.slice(folder, F.lit(2), F.size(folder)), lambda s: s != "")
        return F.concat(F.slice(folder, 1, 1), inner)

    folder = F.split(F.regexp_replace(base_path, "[^/]+$", ""), "/")
    # The empty segment after the last slash of the folder is not a step.
    steps = F.split(path, "/")
    middle = F.filter(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda s: s != "")
    return F.concat(below(folder), middle, F.slice(steps, -1, 1))


def _resolve(b: Column, r: Column, has_host: Column) -> Column:
    """Join split URLs that share a scheme."""
    segments = F.when(r["path"].startswith("/"), F.split(r["path"], "/")).otherwise(
        _relative_segments(b["path"], r["path"])
    )
    host = F.when(has_host, r["host"]).otherwise(b["host"])
    keeps_path = ~has_host & (r["path"] == "")
    path = (
        F.when(has_host, r["path"])
        .when(keeps_path, b["path"])
        .otherwise(let(let(segments, _without_dots), lambda p: F.when(p == "", F.lit("/")).otherwise(p)))
    )
    query = F.when(keeps_path & (r["query"] == ""), b["query"]).otherwise(r["query"])

    def whole(u: Column) -> Column:
        rooted = (u["host"] != "") & (u["path"] != "") & ~u["path"].startswith("/")
        return F.concat(
            F.when(b["scheme"] != "", F.concat(F.lower(b["scheme"]), F.lit(":"))).otherwise(""),
            F.when(u["host"] != "", F.concat(F.lit("//"), u["host"])).otherwise(""),
            F.when(rooted, F.lit("/")).otherwise(""),
            u["path"],
            F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""),
            F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""),
        )

    return let(F.struct(host.alias("host"), path.alias("path"), query.alias("query")), whole)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base`` without leaving the JVM."""
    clean = F.regexp_replace(ref, r"[\t\r\n]|^[\x00-\x20]+", "")
    has_host = clean.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]")

    def join(u: Column) -> Column:
        b, r = u["b"], u["r"]
        scheme = F.lower(b["scheme"])
        foreign = ((r["scheme"] != "") & (F.lower(r["scheme"]) != scheme)) | ~scheme.isin(RELATIVE_SCHEMES)
        return F.when(foreign, ref).otherwise(_resolve(b, r, u["has_host"]))

    split = F.struct(_split_url(base).alias("b"), _split_url(clean).alias("r"), has_host.alias("has_host"))
    return F.when(base == "", ref).when(ref == "", base).otherwise(let(split, join))
