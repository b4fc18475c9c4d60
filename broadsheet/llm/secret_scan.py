"""Secret scans: a random forest decides which candidate strings are secrets.

Candidates are of two forms. One is all runs of at least 16 letters, digits and ``+ / _ -``
with ``=`` as padding at their end, of which whole texts hold many that are no secrets: long
words, numbers, paths, host names. The other is any value of at least 6 characters assigned
to a name with a key word: within quotes up to the closing one, otherwise up to a blank,
quote or next URL parameter, without the punctuation at its end. A name and its ``=`` are no
part of a candidate (a name of a single letter stays with a run). Each candidate gets
features of four kinds: its length; its character transitions (how often the class of
character changes, shares of classes, different characters); how much of it the commonest
words of the corpus cover; and its path and neighbouring words (slashes, dots, an
assignment or a key word before it, quotes around it). A random forest is trained on
labelled findings and every candidate is scored.

Labelled findings are a table of candidates with a label. Where there is no reviewed one,
``findings_by_rule`` labels those that rules can tell for sure: strings assigned to a name
that says secret are findings; candidates of letters only, of digits only and those that
most of the common words cover are false positives; the rest has no label and is left to
the forest. The forest sees none of the rules' own tests, and learns from at most
``MAX_FINDINGS`` of either kind, chosen by hash.

Defined results: NULL and empty texts have no candidates. Candidates are numbered by place
within a row; rows that repeat a ``doc_id`` give repeated findings. Without labelled
findings of both kinds the share of secrets among them (0 without any) is every score.
Extra columns are ignored; empty tables give no findings.

All of it is DataFrame functions and the library's own forest; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage

KEY_WORD = r"(?i)(secret|token|passw|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)"
# What stands between a name and its value.
BETWEEN = r"[\"'`\])]{0,2}\s{0,4}[:=]{1,3}>?\s{0,4}(?:(?i:bearer|basic)\s{1,2})?[\"'`]?"
# A value after a name with a key word. The first tests are short, so that few places need the long one.
NAMED = KEY_WORD.replace("(?i)(", "(?i:") + rf"[A-Za-z0-9_-]{{0,24}}{BETWEEN}"
KEYED = (
    r"(?<=[:=>\s\"'`])(?<=[:=>]|[:=>][\s\"'`]|[:=>]\s{1,4}[\"'`]?|(?i:bearer|basic)\s{1,2}[\"'`]?)"
    rf"(?<={NAMED})(?!(?i:bearer|basic)\s)"
    r"(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|(?<=`)[^`\r\n]{6,}+(?=`)"
    r"|(?![:=>])(?:(?!&\w{1,40}=)[^\s\"'`]){5,}(?<![&?])(?!&\w{1,40}=)[^\s\"'`,;.:)\]}>])"
)
# A run begins where no other run does; runs are taken whole, so no text is read twice.
RUN = r"(?<![A-Za-z0-9+/_-])(?:(?<!=)[A-Za-z]=)?[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/=_-]))?"
CANDIDATE = f"(?:{KEYED}|{RUN})"
# Characters of context kept before and after a candidate.
BEFORE, AFTER = 80, 40
ASSIGNED = r"[=:]\s*[\"'`]?$"
# Common words that count as the dictionary, and their length.
DICTIONARY, SHORTEST, LONGEST = 96, 3, 7
MAX_FINDINGS, TREES, DEPTH = 5000, 20, 6
THRESHOLD = 0.5

FEATURES = [
    "length", "changes", "digits", "uppers", "vowels", "different", "hex_run", "covered",
    "slashes", "dot_near", "at_near", "key_word", "assigned", "quoted", "words_before", "digits_before",
]


def common_words(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` commonest words of all documents of ``SHORTEST`` to ``LONGEST`` letters a to z, lower-cased."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("word"))
    words = words.filter(F.length("word").between(SHORTEST, LONGEST))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return [r["word"] for r in top.collect()]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, candidate, before, after``: every candidate of every text with its context."""
    # Few texts name a key word before an assignment; the others have no candidates but runs.
    named = F.col(text).rlike(NAMED)
    found = F.when(named, F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))).otherwise(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))
    between = F.when(named, F.split(F.col(text), CANDIDATE, -1)).otherwise(F.split(F.col(text), RUN, -1))
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("found"), between.alias("between")).filter(F.size("found") > 0)
    rows = rows.select("doc_id", "between", "found", F.posexplode("found").alias("place", "candidate"))
    rows = rows.withColumn("last", F.when(F.col("place") > 0, F.get("found", F.col("place") - 1))).drop("found")
    before, after = F.get("between", F.col("place")), F.get("between", F.col("place") + 1)
    # The name that a value is assigned to can be a candidate of its own.
    before = F.when(before.rlike(f"^{BETWEEN}$"), F.concat(F.coalesce("last", F.lit("")), before)).otherwise(before)
    return rows.select("doc_id", "place", "candidate", F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))


def with_features(rows: DataFrame, dictionary: list[str]) -> DataFrame:
    """Candidates with one column for each of ``FEATURES``, as doubles."""
    own, before, after = F.col("candidate"), F.col("before"), F.col("after")
    size = F.length(own)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    signs = "+/=_-!\"#$%&'()*,.:;<>?@[\\]^`{|}~ "
    classes = F.translate(own, lower + upper + "0123456789" + signs, "a" * 26 + "A" * 26 + "0" * 10 + "-" * len(signs))

    def share(pattern: str) -> Column:
        return F.regexp_count(own, F.lit(pattern)) / size

    rest = F.regexp_replace(F.lower(own), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "") if dictionary else own
    columns = {
        "length": F.log2(size),
        "changes": F.regexp_count(classes, F.lit("a+|A+|0+|-+")) / size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "different": F.size(F.array_distinct(F.split(own, ""))) / F.least(size, F.lit(40)),
        "hex_run": F.coalesce(F.length(F.array_max(F.transform(F.regexp_extract_all(own, F.lit("[0-9a-fA-F]{8,}"), F.lit(0)), lambda x: F.substring(x, 1, 64)))) / size, F.lit(0.0)),
        "covered": 1 - F.length(rest) / size,
        "slashes": share("/"),
        "dot_near": (F.right(before, F.lit(1)) == ".").cast("int") + F.coalesce(F.left(after, F.lit(2)).rlike(r"^\.[A-Za-z0-9]"), F.lit(False)).cast("int"),
        "at_near": (F.right(before, F.lit(1)) == "@").cast("int") + (F.left(after, F.lit(1)) == "@").cast("int"),
        "key_word": F.regexp_count(before, F.lit(KEY_WORD)),
        "assigned": before.rlike(ASSIGNED).cast("int"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int"),
        "words_before": F.regexp_count(before, F.lit(r"\S+")),
        "digits_before": F.regexp_count(before, F.lit("[0-9]")),
    }
    return rows.select("*", *[F.coalesce(columns[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES])


def findings_by_rule(rows: DataFrame) -> DataFrame:
    """Candidates that rules can tell for sure, with ``label`` 1 or 0."""
    named = F.col("before").rlike(r"(?i)(secret|token|password|passwd|api_?key)\s*[=:]\s*[\"']$|(SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY)[A-Z0-9_]*=$")
    plain = F.col("candidate").rlike("^(?:[A-Za-z]+|[0-9]+)$")
    label = F.when(named & ~plain, 1).when(~named & (plain | (F.col("covered") > 0.5)), 0)
    return rows.withColumn("label", label.cast("double")).filter(F.col("label").isNotNull())


def train(findings: DataFrame):
    """The forest of labelled findings (``label`` and ``FEATURES``), or the share of secrets without both kinds."""
    order = [F.xxhash64("candidate", "before"), F.col("candidate"), F.col("before")]
    sample = findings.filter("label = 1").orderBy(*order).limit(MAX_FINDINGS)
    sample = cut_lineage(sample.unionByName(findings.filter("label = 0").orderBy(*order).limit(MAX_FINDINGS)).select("label", *FEATURES))
    kinds, share = sample.agg(F.count_distinct("label"), F.coalesce(F.avg("label"), F.lit(0.0))).first()
    if kinds < 2:
        return share
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vector"), forest]).fit(sample)


def score(rows: DataFrame, model) -> DataFrame:
    """Candidates with features and a column ``score``, the share of trees' votes for a secret."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, place, secret, score``: the candidates that the forest takes for secrets.

    ``labelled`` are reviewed findings (``candidate, before, after, label``); without it rules label some.
    """
    dictionary = common_words(docs, text)
    rows = with_features(candidates(docs, doc_id, text), dictionary)
    findings = findings_by_rule(rows) if labelled is None else with_features(labelled, dictionary)
    scored = score(rows, train(findings)).filter(F.col("score") >= threshold)
    return scored.select("doc_id", "place", F.col("candidate").alias("secret"), "score")
