"""Language of a text by trigram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import MAX_BROADCAST_ROWS

# Relative frequency below which a trigram counts as unseen.
FLOOR = 1e-6


# Characters of texts whose trigrams are numbered together.
BATCH_CHARS = 400_000


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of the whole text, found in one pass over it."""
    return F.regexp_extract_all(_padded(text), F.lit("(?s)(?=(...))."), F.lit(1))


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Places and pieces of texts, about ``BATCH_CHARS`` characters together; pieces of one text share two characters."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or "") - 2, BATCH_CHARS):
            held.append((row, text[at : at + BATCH_CHARS + 2]))
            size += len(held[-1][1])
            if size > BATCH_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _trigram_numbers(pieces: list[str]) -> np.ndarray:
    """The trigrams of all pieces in order, 21 bits a character."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum([len(p) for p in pieces])
    inside[ends - 1] = inside[ends - 2] = False
    return (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[inside[:-2]]


def _trigram_texts(numbers: np.ndarray) -> list[str]:
    parts = np.stack([numbers >> 42, numbers >> 21 & 0x1FFFFF, numbers & 0x1FFFFF], axis=1)
    text = parts.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _counted_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)``, counted where the texts are read, so that no row is made for each character."""
    rows = docs.select(F.col(lang).alias("lang"), _padded(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for pieces in _pieces(texts):
                own: dict = {}
                for row, piece in pieces:
                    own.setdefault(langs[row], []).append(piece)
                for name, some in own.items():
                    found, counts = np.unique(_trigram_numbers(some), return_counts=True)
                    columns = [pa.array([name] * len(found), b.column("lang").type), pa.array(_trigram_texts(found), pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    kind = rows.schema["lang"].dataType.simpleString()
    return rows.mapInArrow(run, f"lang {kind}, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, weight)``: whole-number log weight of each trigram of a language."""
    grams = _counted_grams(docs, text, lang)
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total") / F.lit(FLOOR)
    return grams.join(totals, "lang").select(
        "lang", "gram", F.round(F.lit(1000.0) * F.ln(F.lit(1.0) + share)).cast("bigint").alias("weight")
    )


def language_scores(
    docs: DataFrame,
    key: str,
    text: str,
    profiles: DataFrame,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 64,
) -> DataFrame:
    """``(key, language, score)``; a text without a known trigram has one row without language.

    Profiles within the bound are broadcast as arrays: trigrams are matched where the text
    was read and only one sum per text and language is shuffled. Beyond it, counts per text
    meet the profiles in a shuffle join in which frequent trigrams are spread over
    ``salts`` copies. So do profiles with a NULL or with a trigram of another length.
    """
    model = _profile_arrays(profiles, max_broadcast_rows)
    if model is not None:
        found = _matched(docs, key, text, model)
        return found.groupBy(F.col("key").alias(key), "language").agg(F.coalesce(F.sum("score"), F.lit(-1)).alias("score"))
    lettered = F.when(F.col(text).rlike(r"\p{L}"), trigrams(F.col(text)))
    grams = docs.select(key, F.explode_outer(lettered).alias("gram"))
    table = profiles.select("gram", F.col("lang").alias("language"), "weight")
    counted = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    matched = counted.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(
        table.withColumn("salt", spread), ["gram", "salt"], "left"
    )
    return matched.groupBy(key, "language").agg(
        F.coalesce(F.sum(F.col("weight") * F.col("n")), F.lit(-1)).alias("score")
    )


def _profile_arrays(profiles: DataFrame, max_rows: int) -> dict | None:
    """Profiles of at most ``max_rows`` rows: sorted trigrams, and for each the weights of all languages and which of them have it."""
    rows = profiles.select("gram", "lang", "weight").limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or any(c.null_count for c in rows.columns):
        return None
    grams, langs, weights = (rows.column(c).to_pylist() for c in ("gram", "lang", "weight"))
    if any(len(g) != 3 for g in grams):
        return None
    languages = sorted(set(langs))
    keys, at = np.unique(_trigram_numbers(grams) if grams else np.zeros(0, np.int64), return_inverse=True)
    place = {name: i for i, name in enumerate(languages)}
    lang = np.array([place[x] for x in langs], np.int64)
    # The last row is that of an unknown trigram.
    table = np.zeros((len(keys) + 1, 2 * len(languages)), np.int64)
    np.add.at(table, (at, lang), np.array(weights, np.int64))
    table[at, len(languages) + lang] = 1
    return {"keys": keys, "table": table, "languages": languages}


def _matched(docs: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """``(key, language, score)`` of each text by the languages that share a trigram with it; a row of NULLs if a trigram is unknown or there is none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(text).rlike(r"\p{L}"), _padded(F.col(text))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, languages = (shared.value[k] for k in ("keys", "table", "languages"))
        names = pa.array([*languages, None], pa.string())
        for b in batches:
            texts = b.column("text").to_pylist()
            sums = np.zeros((b.num_rows, len(languages) * 2), np.int64)
            unknown = np.array([not t for t in texts], bool)
            for pieces in _pieces(texts):
                numbers = _trigram_numbers([p for _, p in pieces])
                at = np.minimum(np.searchsorted(keys, numbers), max(len(keys) - 1, 0))
                known = keys[at] == numbers if len(keys) else np.zeros(len(numbers), bool)
                starts = np.concatenate(([0], np.cumsum([len(p) - 2 for _, p in pieces])[:-1]))
                own = np.array([row for row, _ in pieces])
                np.add.at(sums, own, np.add.reduceat(table[np.where(known, at, len(keys))], starts, axis=0))
                np.logical_or.at(unknown, own, ~np.logical_and.reduceat(known, starts))
            row, lang = np.nonzero(sums[:, len(languages) :])
            alone = np.flatnonzero(unknown)
            places = np.concatenate((row, alone))
            score = pa.concat_arrays([pa.array(sums[row, lang], pa.int64()), pa.nulls(len(alone), pa.int64())])
            language = names.take(pa.array(np.concatenate((lang, np.full(len(alone), len(languages))))))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(places)), language, score], ["key", "language", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, language string, score long")


def detect_language(
    docs: DataFrame,
    key: str,
    text: str,
    profiles: DataFrame,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(key, language)`` per distinct key; ``unknown`` for text without letters.

    Equal scores go to the name that sorts last.
    """
    scores = language_scores(docs, key, text, profiles, max_broadcast_rows)
    best = F.max_by("language", F.struct("score", "language"))
    return scores.groupBy(key).agg(F.coalesce(best, F.lit("unknown")).alias("language"))
