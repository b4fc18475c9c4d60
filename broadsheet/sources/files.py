"""File URLs of a request table resolved against the files below a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Outcome of a request.
OK, BAD_REQUEST, FORBIDDEN, NOT_FOUND = 200, 400, 403, 404


def file_url_error(method: Column, url: Column) -> Column:
    """Why a request is refused outright; NULL if it is not."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(~method.isin("GET", "HEAD"), F.lit("invalid_method")).when(
        ~host.isin("", "localhost"), F.lit("host_not_permitted")
    )


def file_url_path(url: Column) -> Column:
    """Absolute path of a file URL; NULL if a part hides a separator, ``''`` if it is empty.

    Parts are percent-decoded, ``+`` stays ``+``, leading empty parts are dropped,
    and a first part ``C:`` or ``C|`` is a drive.
    """
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    rooted = F.regexp_replace(path, "^/+", "")
    decode = lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    parts = F.transform(F.split(rooted, "/"), decode)
    first = F.get(parts, F.lit(0))
    drive = F.regexp_replace(first, r"\|$", ":")
    below_drive = F.regexp_replace(
        F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "/"), "^/+", ""
    )
    return (
        F.when(rooted == "", F.lit(""))
        .when(F.exists(parts, lambda p: p.contains("/")), F.lit(None).cast("string"))
        .when(first.rlike(r"[:|]$"), F.concat(drive, F.lit("/"), below_drive))
        .otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))
    )


def plain_path(path: Column) -> Column:
    """The path without empty parts and ``.``, and with each ``..`` taking back the part before it."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        none,
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(path == "", path).otherwise(F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/")))


def folders_of(files: DataFrame) -> DataFrame:
    """``path``: every folder above the files."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(above).alias("path")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path"))).distinct()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content_length, body)`` of the files below a folder.

    ``body`` is only read when a query uses it.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    local = F.regexp_replace("path", "^file:/*", "/")
    decoded = F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local)
    return found.select(decoded.alias("path"), F.col("length").alias("content_length"), F.col("content").alias("body"))


def resolve_file_urls(
    requests: DataFrame, files: DataFrame, denied: DataFrame | None = None, set_content_length: bool = True
) -> DataFrame:
    """Requests with ``(status, content_length, body, error)``.

    ``files`` comes from ``list_files``; ``denied(path)`` names files that exist but
    may not be read. A refused request has no status, only an error.
    """
    asked = requests.withColumn("error", file_url_error(F.col("method"), F.col("url"))).withColumn(
        "path", F.when(F.col("error").isNull(), file_url_path(F.col("url")))
    )
    # A path that ends as a folder's can't be a file.
    as_folder = F.col("path").rlike(r"/\.{0,2}$")
    asked = asked.withColumn("as_folder", as_folder).withColumn("path", plain_path(F.col("path")))
    found = asked.join(files, "path", "left").join(folders_of(files).withColumn("is_folder", F.lit(True)), "path", "left")
    if denied is None:
        found = found.withColumn("denied", F.lit(False))
    else:
        marks = denied.select("path", F.lit(True).alias("denied")).distinct()
        found = found.join(marks, "path", "left")
    refused = F.col("error").isNotNull()
    status = (
        F.when(refused, F.lit(None).cast("int"))
        .when((F.col("path") == "") | F.col("is_folder"), F.lit(BAD_REQUEST))
        .when(F.col("as_folder") & F.col("content_length").isNotNull(), F.lit(BAD_REQUEST))
        .when(F.col("denied"), F.lit(FORBIDDEN))
        .when(F.col("content_length").isNull(), F.lit(NOT_FOUND))
        .otherwise(F.lit(OK))
    )
    # The texts that stand for the body of a failed request.
    reason = (
        F.when((status == BAD_REQUEST) & F.col("is_folder"), F.concat(F.lit("Is a directory: "), F.col("path")))
        .when((status == BAD_REQUEST) & F.col("as_folder"), F.concat(F.lit("Not a directory: "), F.col("path")))
        .when(status == BAD_REQUEST, F.lit("Invalid path"))
        .when(status == FORBIDDEN, F.concat(F.lit("Permission denied: "), F.col("path")))
        .when(status == NOT_FOUND, F.concat_ws(": ", F.lit("No such file or directory"), F.col("path")))
    )
    body = F.when(status == OK, F.col("body")).otherwise(reason.cast("binary"))
    length = F.when(status == OK, F.col("content_length")).otherwise(F.octet_length(reason).cast("bigint"))
    if not set_content_length:
        length = F.lit(None).cast("bigint")
    return found.select(
        *requests.columns, status.alias("status"), length.alias("content_length"), body.alias("body"), "error"
    )
