"""Words of an unspaced text by a linear boundary model.

A gap lies before every character but the first. The six characters around it,
their classes and the last three decisions (U before the first, B split, O not)
select weights; the gap is a boundary when bias and weights sum to more than 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.chars import class_string, class_table
from broadsheet.operators import boundaries as B
from broadsheet.operators.boundaries import EDGES_AFTER, EDGES_BEFORE, STATES
from broadsheet.session import MAX_BROADCAST_ROWS, cut_lineage

# Features and the items they join, by window position (w characters,
# c classes, p decisions). UQ1 serves both the first and the third position.
CHARACTER_FEATURES = {
    "UW1": "w1", "UW2": "w2", "UW3": "w3", "UW4": "w4", "UW5": "w5", "UW6": "w6",
    "BW1": "w2 w3", "BW2": "w3 w4", "BW3": "w4 w5",
    "TW1": "w1 w2 w3", "TW2": "w2 w3 w4", "TW3": "w3 w4 w5", "TW4": "w4 w5 w6",
}
CLASS_FEATURES = {
    "UC1": "c1", "UC2": "c2", "UC3": "c3", "UC4": "c4", "UC5": "c5", "UC6": "c6",
    "BC1": "c2 c3", "BC2": "c3 c4", "BC3": "c4 c5",
    "TC1": "c1 c2 c3", "TC2": "c2 c3 c4", "TC3": "c3 c4 c5", "TC4": "c4 c5 c6",
}
HISTORY_FEATURES = [
    ("UP1", "p1"), ("UP2", "p2"), ("UP3", "p3"),
    ("BP1", "p1 p2"), ("BP2", "p2 p3"),
    ("UQ1", "p1 c1"), ("UQ2", "p2 c2"), ("UQ1", "p3 c3"),
    ("BQ1", "p2 c2 c3"), ("BQ2", "p2 c3 c4"), ("BQ3", "p3 c2 c3"), ("BQ4", "p3 c3 c4"),
    ("TQ1", "p2 c1 c2 c3"), ("TQ2", "p2 c2 c3 c4"), ("TQ3", "p3 c1 c2 c3"), ("TQ4", "p3 c2 c3 c4"),
]
# What stands outside the text, and the name of the bias weight.
EDGES = ["B3", "B2", "B1", "E1", "E2", "E3"]
BIAS = "BIAS"

# Inside plans an edge is one code point that is no character in any text, so that a window
# is a 6-character string.
_EDGE_CHARS = dict(zip(EDGES, EDGES_BEFORE + EDGES_AFTER, strict=True))
_BEFORE, _AFTER = EDGES_BEFORE, EDGES_AFTER


def _windows(padded: Column, width: int) -> Column:
    """All runs of ``width`` characters, in one pass over the text."""
    return F.regexp_extract_all(padded, F.lit("(?s)(?=(.{%d}))." % width), F.lit(1))


def gap_windows(text: Column) -> Column:
    """Array of ``(w, c)`` per gap: six characters and their classes."""
    outside = F.lit("OOO")
    w = _windows(F.concat(F.lit(_BEFORE), text, F.lit(_AFTER)), 6)
    c = _windows(F.concat(outside, class_string(text), outside), 6)
    gaps = F.greatest(F.size(w) - 2, F.lit(0))
    return F.zip_with(
        F.slice(w, F.lit(2), gaps), F.slice(c, F.lit(2), gaps), lambda a, b: F.struct(a.alias("w"), b.alias("c"))
    )


def segment_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, w, c)``, one row per gap; ``pos`` is the character after it, from 1."""
    return docs.select(key, F.posexplode(gap_windows(F.col(text))).alias("at", "g")).select(
        key, (F.col("at") + 1).alias("pos"), "g.w", "g.c"
    )


def _item(name: str) -> Column:
    return F.substring(name[0], int(name[1]), 1)


def feature_key(items: str) -> Column:
    """Key of a feature from the window columns ``w``, ``c`` and ``p``."""
    names = items.split()
    first, last = names[0], names[-1]
    if first[0] == last[0] and int(last[1]) - int(first[1]) == len(names) - 1:
        return F.substring(first[0], int(first[1]), len(names))
    return F.concat(*[_item(n) for n in names])


def _feature_rows(features) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), feature_key(i).alias("key")) for f, i in features])
    )


def _show_edges(key: Column) -> Column:
    shown = key
    for name, char in _EDGE_CHARS.items():
        shown = F.replace(shown, F.lit(char), F.lit(name))
    return F.when(key.rlike("[\ufdd0-\ufdd5]"), shown).otherwise(key)


def segment_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, feature, feature_key)``: the 26 features that do not depend on decisions."""
    features = [*CHARACTER_FEATURES.items(), *CLASS_FEATURES.items()]
    rows = segment_windows(docs, key, text).select(key, "pos", _feature_rows(features).alias("f"))
    return rows.select(key, "pos", "f.feature", _show_edges(F.col("f.key")).alias("feature_key"))


def segment_feature_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(feature, feature_key, n)``: how many gaps of all texts have each of the rows of ``segment_features``.

    Windows are counted where the texts are read; only distinct ones are taken apart.
    """
    windows = cut_lineage(B.window_counts(docs, text, spaced=False))  # distinct windows, read below in two ways
    by_class = _class_counts(windows).filter(F.col("feature").isin(list(CLASS_FEATURES)))
    counts = _character_counts(windows).unionByName(by_class)
    return counts.select("feature", _show_edges(F.col("key")).alias("feature_key"), F.col("n_kept").alias("n"))


def _with_edge_chars(weights: DataFrame) -> DataFrame:
    """Weight keys with edges as single characters. An edge name shows in a key that is
    longer than the number of its items."""
    items = F.when(F.col("feature").startswith("U"), 1).when(F.col("feature").startswith("B"), 2).otherwise(3)
    before, after = f"^([{_BEFORE}]*)", f"([{_AFTER}]*)$"
    left = right = F.col("key")
    for name in EDGES[:3]:
        left = F.regexp_replace(left, before + name, "$1" + _EDGE_CHARS[name])
    for name in reversed(EDGES[3:]):
        right = F.regexp_replace(right, name + after, _EDGE_CHARS[name] + "$1")
    # A feature reaches over one end of the text only.
    over = F.length("key") > items
    looks_left = F.col("feature").isin("UW1", "UW2", "UW3", "BW1", "TW1", "TW2")
    shown = F.when(over & looks_left, left).when(over, right).otherwise(F.col("key"))
    is_char = F.col("feature").isin(list(CHARACTER_FEATURES))
    return weights.withColumn("key", F.when(is_char, shown).otherwise(F.col("key")))


# What an n-gram of a text contributes to: the gaps from two characters before its
# start to three after it. The feature of each such offset, by length.
NGRAM_FEATURES = {
    1: {-2: "UW6", -1: "UW5", 0: "UW4", 1: "UW3", 2: "UW2", 3: "UW1"},
    2: {0: "BW3", 1: "BW2", 2: "BW1"},
    3: {0: "TW4", 1: "TW3", 2: "TW2", 3: "TW1"},
}
OFFSETS = range(-2, 4)


def _class_feature(feature: str) -> str:
    return feature.replace("W", "C")


def _at(offset: int) -> str:
    return f"g{offset + 2}"


def text_positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, at, t, c)``: the three characters from each place of the padded text, and their classes.

    ``at`` is the character number; the edges lie at -3 to -1 and after the end.
    """
    padded = F.concat(F.lit(_BEFORE), F.col(text), F.lit(_AFTER + _AFTER[:2]))
    t = _windows(padded, 3)
    c = _windows(F.concat(F.lit("OOO"), class_string(F.col(text)), F.lit("OOOOO")), 3)
    rows = F.arrays_zip(t, c)
    used = docs.filter(F.length(text) > 0)
    return used.select(key, F.posexplode(rows).alias("i", "r")).select(
        key, (F.col("i") - 3).alias("at"), F.col("r.0").alias("t"), F.col("r.1").alias("c")
    )


def _ngram_table(weights: DataFrame, n: int, rename) -> DataFrame:
    """``(key, g0..g5)``: the weights of each n-gram by the gap it contributes to."""
    sums = [
        F.sum(F.when(F.col("feature") == rename(f), F.col("weight"))).cast("int").alias(_at(o))
        for o, f in NGRAM_FEATURES[n].items()
    ]
    wanted = [rename(f) for f in NGRAM_FEATURES[n].values()]
    return weights.filter(F.col("feature").isin(wanted)).groupBy("key").agg(*sums)


def _class_table(weights: DataFrame) -> DataFrame:
    """``(c, g0..g5)`` for each three classes: 7^3 rows whatever the data."""
    grid = _class_grid(weights.sparkSession, 3)
    for n in (1, 2, 3):
        table = _ngram_table(weights, n, _class_feature)
        named = table.select(F.col("key").alias(f"k{n}"), *[F.col(c).alias(f"{c}_{n}") for c in table.columns[1:]])
        grid = grid.join(named, F.substring("c", 1, n) == F.col(f"k{n}"), "left")
    return grid.select("c", *[_sum_of(grid, o) for o in OFFSETS])


def _sum_of(rows: DataFrame, offset: int) -> Column:
    """Sum of all columns that contribute to one gap."""
    total = F.lit(0)
    for column in rows.columns:
        if column.startswith(_at(offset) + "_"):
            total = total + F.coalesce(column, F.lit(0))
    return total.cast("int").alias(_at(offset))


def _bias(weights: DataFrame) -> int:
    return weights.filter(F.col("feature") == BIAS).agg(F.sum("weight")).first()[0] or 0


def segment_static_scores(
    docs: DataFrame,
    weights: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(key, pos, static, c4)`` per gap: bias plus the 26 weights free of decisions.

    A model within the bound is broadcast as arrays and every text is scored where it is
    read, without a shuffle. A larger one is joined by n-gram, and so are texts whose key
    repeats: the places of one key are one sequence.
    """
    model = _model_arrays(weights, max_broadcast_rows)
    if model is None:
        return _static_by_joins(docs.repartition(key), weights, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    repeated = docs.groupBy(F.col(key).alias("repeated")).count().filter("count > 1").select("repeated")
    if repeated.isEmpty():
        return B.static_rows(docs, shared, key, text)
    same = F.col(key).eqNullSafe(F.col("repeated"))
    together = docs.join(repeated, same, "left_semi").repartition(key)
    return B.static_rows(docs.join(repeated, same, "left_anti"), shared, key, text).unionByName(
        _static_by_joins(together, weights, key, text)
    )


def _static_by_joins(docs: DataFrame, weights: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, static, c4)`` by joins with a model of any size.

    The model is arranged by n-gram, so a place of the text needs one look-up for its
    character, pair, triple and class triple each; neighbours then add up in a window.
    ``docs`` should be partitioned by ``key``, which names one text: everything stays in
    that partitioning.
    """
    bias = F.lit(_bias(weights))
    table = _with_edge_chars(weights.filter(F.col("feature") != BIAS).select("feature", "key", "weight"))
    rows = text_positions(docs, key, text)
    for n in (1, 2, 3):
        found = _ngram_table(table, n, str)
        named = found.select(F.col("key").alias(f"k{n}"), *[F.col(c).alias(f"{c}_{n}") for c in found.columns[1:]])
        rows = rows.join(named, F.substring("t", 1, n) == F.col(f"k{n}"), "left")
    classes = _class_table(weights)
    named = classes.select(F.col("c").alias("k4"), *[F.col(c).alias(f"{c}_4") for c in classes.columns[1:]])
    rows = rows.join(F.broadcast(named), F.col("c") == F.col("k4"), "left")
    rows = rows.select(key, "at", "c", *[_sum_of(rows, o) for o in OFFSETS])
    order = Window.partitionBy(key).orderBy("at")
    static = bias
    for offset in OFFSETS:
        static = static + F.lag(_at(offset), offset).over(order)
    c4 = F.concat(F.lag("c", 3).over(order), F.substring("c", 1, 1))
    last = F.lead("at", 3).over(order)
    scored = rows.select(key, F.col("at").alias("pos"), static.cast("int").alias("static"), c4.alias("c4"), last.alias("more"))
    # A gap has three places after it, and does not lie before the first character.
    return scored.filter("pos >= 1 AND more IS NOT NULL").drop("more")


def _class_grid(spark: SparkSession, width: int) -> DataFrame:
    """``(c)``: all strings of ``width`` classes."""
    classes = F.array(*[F.lit(c) for c in "MHIKANO"])
    grid = spark.range(1).select(F.lit("").alias("c"))
    for _ in range(width):
        grid = grid.select("c", F.explode(classes).alias("more")).select(F.concat("c", "more").alias("c"))
    return grid


def segment_history_scores(weights: DataFrame) -> DataFrame:
    """``(c4, scores)``: for each four classes, the history score of every state.

    7^4 rows whatever the data, one number per entry of ``STATES``.
    """
    grid = _class_grid(weights.sparkSession, 4)
    states = F.posexplode(F.array(*[F.lit(s) for s in STATES])).alias("state", "p")
    rows = grid.select("c", states).select("c", "state", _feature_rows(HISTORY_FEATURES).alias("x"), "p")
    keyed = rows.select(F.col("c").alias("c4"), "state", "x.feature", "x.key")
    summed = (
        keyed.join(weights.select("feature", "key", "weight"), ["feature", "key"], "left")
        .groupBy("c4", "state")
        .agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("int").alias("score"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("state", "score")))
    return summed.groupBy("c4").agg(F.transform(ordered, lambda s: s["score"]).alias("scores"))


def decision_masks(scored: DataFrame, history: DataFrame) -> DataFrame:
    """Gaps with ``mask``: bit ``s`` says that the gap is a boundary in state ``s``."""
    joined = scored.join(F.broadcast(history), "c4", "left")  # 7^4 rows
    mask = F.lit(0)
    for state in range(len(STATES)):
        score = F.col("static") + F.coalesce(F.get("scores", F.lit(state)), F.lit(0))
        mask = mask + F.when(score > 0, 1 << state).otherwise(0)
    return joined.withColumn("mask", mask).drop("c4", "scores")


def _model_arrays(weights: DataFrame, max_rows: int) -> dict[str, np.ndarray] | None:
    """The model as arrays of numbers if it has at most ``max_rows`` rows, else None."""
    if weights.limit(max_rows + 1).count() > max_rows:
        return None
    table = _with_edge_chars(weights.filter(F.col("feature") != BIAS).select("feature", "key", "weight"))
    model = {"bias": np.array([_bias(weights)], np.int64)}
    for n in (1, 2, 3):
        found = _ngram_table(table, n, str).filter(F.length("key") == n).toPandas()
        keys = np.zeros(len(found), np.int64)
        for k in range(n):
            keys = keys << 21 | np.array([ord(x[k]) for x in found["key"]], np.int64)
        order = np.argsort(keys)
        grams = np.zeros((len(found) + 1, len(OFFSETS)), np.int32)
        for offset in NGRAM_FEATURES[n]:
            grams[:-1, offset + 2] = found[_at(offset)].fillna(0).to_numpy()[order]
        model |= {f"keys{n}": keys[order], f"grams{n}": grams}
    classes, history = np.zeros((7**3, len(OFFSETS)), np.int32), np.zeros((7**4, len(STATES)), np.int32)
    for row in _class_table(weights).collect():
        classes[_class_index(row["c"])] = [row[_at(o)] for o in OFFSETS]
    for row in segment_history_scores(weights).collect():
        history[_class_index(row["c4"])] = row["scores"]
    return model | {"classes": classes, "history": history, "kinds": np.frombuffer(class_table(), np.uint8)}


def _class_index(classes: str) -> int:
    number = 0
    for c in classes:
        number = number * 7 + "MHIKANO".index(c)
    return number


def _masks_by_joins(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """What ``score_blocks`` gives, for a model of any size: n-grams are joined with it."""
    name = F.concat("id", F.lit(":"), F.col("block").cast("string"))
    named = blocks.withColumn("name", name).withColumn("around", F.concat("before", "part", "after"))
    scored = _static_by_joins(named.repartition("name"), weights, "name", "around")
    gaps = decision_masks(scored, segment_history_scores(weights))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mask")))
    found = gaps.groupBy("name").agg(ordered.alias("gaps"))
    # Positions count from the first character around the block, which has no gap.
    begin = F.length("before")
    own = F.filter("gaps", lambda g: (g["pos"] >= begin) & (g["pos"] < begin + F.length("part")))
    low_high = F.transform(own, lambda g: F.concat(F.lpad(F.hex(g["mask"].bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(g["mask"], 8)), 2, "0")))
    masks = F.unhex(F.concat(F.when(begin == 0, "0000").otherwise(""), F.coalesce(F.array_join(low_high, ""), F.lit(""))))
    return named.join(found, "name", "left").select("key", "id", "copies", "block", "part", masks.alias("masks"))


def segment(
    docs: DataFrame,
    weights: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(key, tokens)``; the tokens of a text concatenate to it, an empty text has none, a NULL one has NULL.

    A model within the bound is broadcast as arrays, and a text of up to ``LONG_BLOCKS`` blocks is
    scored and cut where it is read. Longer texts are dealt out by block; each block is a map of
    states, and only the maps meet again before all blocks decide. With a larger model
    all texts go by block and their n-grams are joined with the model.
    """
    model = _model_arrays(weights, max_broadcast_rows)
    if model is None:
        some = docs.filter(F.length(text) > 0)
        rows = B.block_tokens(_masks_by_joins(B.text_blocks(some, key, text), weights))
        empty = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
        return B.join_blocks(rows).withColumnRenamed("key", key).unionByName(
            docs.filter(F.coalesce(F.length(text) == 0, F.lit(True))).select(key, empty.alias("tokens"))
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    is_long = F.coalesce(F.length(text) > B.BLOCK * B.LONG_BLOCKS, F.lit(False))
    short = B.segment_short(docs, shared, key, text, is_long)
    scored = B.score_blocks(B.text_blocks(docs.filter(is_long), key, text), shared)
    return short.unionByName(B.join_blocks(B.block_tokens(scored))).withColumnRenamed("key", key)


def _class_counts(windows: DataFrame) -> DataFrame:
    """Counts of class and decision features, from distinct windows (at most 7^6 * 15 * 2)."""
    distinct = windows.filter("kind = 'c'").select(
        F.col("window").alias("c"), F.substring("marks", 1, 3).alias("p"), F.substring("marks", 4, 1).alias("b"), "n"
    )
    rows = distinct.select("b", "n", _feature_rows([*CLASS_FEATURES.items(), *HISTORY_FEATURES]).alias("f"))
    return rows.groupBy("f.feature", "f.key").agg(
        F.sum(F.when(F.col("b") == "B", F.col("n")).otherwise(0)).alias("n_split"),
        F.sum(F.when(F.col("b") == "O", F.col("n")).otherwise(0)).alias("n_kept"),
    )


def _character_counts(windows: DataFrame) -> DataFrame:
    """Counts of character features.

    Triples of characters come with the marks of the six gaps around them; each distinct
    one gives three n-grams and counts for all six gaps.
    """
    distinct = windows.filter("kind = 't'").select(F.col("window").alias("t"), F.col("marks").alias("m"), "n")
    grams = distinct.select(
        F.explode(F.array(*[F.substring("t", 1, n) for n in (1, 2, 3)])).alias("key"), "m", "n"
    )
    sums = [
        F.sum(F.when(F.substring("m", o + 3, 1) == mark, F.col("n")).otherwise(0)).alias(f"{_at(o)}_{mark}")
        for o in OFFSETS
        for mark in "BO"
    ]
    counts = grams.groupBy("key").agg(*sums)
    melted = F.array(
        *[
            F.when(
                F.length("key") == n,
                F.struct(
                    F.lit(feature).alias("feature"),
                    F.col(f"{_at(o)}_B").alias("n_split"),
                    F.col(f"{_at(o)}_O").alias("n_kept"),
                ),
            )
            for n, by_offset in NGRAM_FEATURES.items()
            for o, feature in by_offset.items()
        ]
    )
    return (
        counts.select("key", F.explode(F.array_compact(melted)).alias("f"))
        .select("f.feature", "key", "f.n_split", "f.n_kept")
        .filter("n_split + n_kept > 0")
    )


def fit_segment_weights(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``(feature, key, weight)`` from a corpus with blanks between words.

    A weight is the log odds of a boundary given the feature key, over the log odds
    of any boundary, times 100; the bias is the latter.
    """
    windows = cut_lineage(B.window_counts(corpus, text))  # distinct windows, read below in two ways
    by_class = cut_lineage(_class_counts(windows))  # read three times below
    counts = _character_counts(windows).unionByName(by_class)
    # A feature of one class sees every gap once.
    prior = by_class.filter("feature = 'UC1'").agg(
        F.sum("n_split").alias("all_split"), F.sum("n_kept").alias("all_kept")
    )

    def odds(split: str, kept: str) -> Column:
        return F.ln((F.col(split) + 1.0) / (F.col(kept) + 1.0))

    base = prior.select(odds("all_split", "all_kept")).scalar()
    weight = F.round((odds("n_split", "n_kept") - base) * 100).cast("int")
    fitted = counts.select("feature", _show_edges(F.col("key")).alias("key"), weight.alias("weight"))
    bias = prior.select(
        F.lit(BIAS).alias("feature"),
        F.lit("").alias("key"),
        F.round(odds("all_split", "all_kept") * 100).cast("int").alias("weight"),
    )
    return fitted.unionByName(bias)
