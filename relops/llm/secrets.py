"""Secrets in texts: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Everything is computed inside the row: a text is cut at its candidates once, each candidate gets features from
itself, from the text on both sides and from the row's path, and the trained trees are written out as nested
conditions over them. Training is Spark ML's random forest over all labelled findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.staging import stage

# What a candidate looks like. A private key block; a value after a secret's name and an assignment, in
# quotes up to the closing one; a password in a URL; a web token of three or five parts; dotted and plain long tokens.
# Loops over groups are possessive, which Java runs without recursion.
MARK = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
KEY_BLOCK = rf"-----BEGIN {MARK}(?:[^-]++|-(?!----(?:BEGIN|END) {MARK}))*+-----END {MARK}"
NAME = r"(?i:key|token|secret|passw(?:or)?d|passphrase|pwd|auth|credentials?|bearer)"
SIGN = r"(?:=>|:=|=|:)"
WIDE = r"A-Za-z0-9+/_-"
AFTER_NAME = rf"(?<=[=:>\s\"'])(?<={SIGN}\s{{0,8}}[\"']?)(?<={NAME}[\"']?\s{{0,8}}{SIGN}\s{{0,8}}[\"']?)"
QUOTED = rf"(?<=[\"']){AFTER_NAME}[^\"'\r\n]++(?=[\"'])"
VALUE = rf"{AFTER_NAME}(?![=:>])[^\s\"']*[^\s\"'.,;:)\]}}>]"
IN_URL = r"(?<=:)(?<=://[^\s/:@\"']{0,200}:)[^\s/@\"']++(?=@)"
WEB_TOKEN = rf"(?<![{WIDE}])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?+"
DOTTED = rf"(?<![.{WIDE}])[A-Za-z0-9_-]{{10,}}+\.[A-Za-z0-9_-]{{10,}}+\.[A-Za-z0-9_-]{{10,}}+"
# A run that ends in a secret's name before an assignment is the name of what follows.
TOKEN = rf"(?:(?<![{WIDE}])(?!(?<=:)//)|(?<=://))[{WIDE}]{{16,}}+(?!(?<={NAME})[\"']?\s{{0,8}}{SIGN})(?:={{1,2}}+(?![\"'{WIDE}]))?+"
# Public formats of access keys.
FORMATS = r"^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-.*|[sr]k_live_.*|xox[abprs]-.*|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]*){2,4})$"
CANDIDATE = "|".join([KEY_BLOCK, QUOTED, VALUE, IN_URL, WEB_TOKEN, DOTTED, TOKEN])
NAMED = r"(?i)(key|token|secret|passw(or)?d|passphrase|pwd|auth|credentials?|bearer)[\"']?\s*(=|:|=>|:=|is)?\s*[\"']?$"
ASSIGNED = r"(=|:|=>)\s*[\"']?$"
HARMLESS = r"(?i)(example|sample|dummy|test|hash|commit|checksum|sha\d*|md5|uuid|order|card|phone|page)"
HARMLESS_PATH = r"(?i)(example|sample|test|fixture|mock|doc)"
AROUND = 40

FEATURES = ["length", "distinct", "transitions", "digits", "upper", "format", "numeric", "hex", "dictionary", "named", "assigned", "quoted", "harmless", "path", "neighbours", "symbols", "word", "mail", "file", "url"]
TREES = 15
DEPTH = 5
# Words of the dictionary: those in most documents.
DICTIONARY_WORDS = 1000


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` letter-only words of three letters or more that stand in most documents, ties by the word."""

    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(col(text_col).cast("string")), r"[^a-z]+"))).alias("word"))
    counted = words.filter(F.length("word") >= 3).groupBy("word").count()
    return [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(size).collect()]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(candidate: Column, before: Column, after: Column, path: Column, known: list[str]) -> Column:
    """Features of one candidate, all doubles, in the order of ``FEATURES``."""

    length = F.length(candidate)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c")
    runs = F.regexp_extract_all(F.lower(candidate), F.lit("([a-z]{3,})"), 1)
    covered = F.aggregate(F.filter(runs, lambda w: w.isin(known)), F.lit(0), lambda n, w: n + F.length(w))
    values = [
        length,
        F.size(F.array_distinct(F.split(candidate, ""))) / length,
        F.length(kinds) / length,
        _count(candidate, "[0-9]") / length,
        _count(candidate, "[A-Z]") / length,
        candidate.rlike(FORMATS),
        candidate.rlike("^[0-9]+$"),
        candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        covered / length,
        before.rlike(NAMED),
        before.rlike(ASSIGNED),
        before.rlike("[\"']$") & after.rlike("^[\"']"),
        before.rlike(HARMLESS) | after.rlike(HARMLESS),
        path.rlike(HARMLESS_PATH),
        F.size(F.filter(F.split(F.concat_ws(" ", before, after), r"[^A-Za-z]+"), lambda w: F.lower(w).isin(known))),
        _count(candidate, "[^A-Za-z0-9]") / length,
        candidate.rlike("^([A-Z]?[a-z]+|[A-Z]+)([-/_+]([A-Z]?[a-z]+|[A-Z]+))*$"),
        after.rlike("^@[A-Za-z0-9]") | before.rlike("@$"),
        after.rlike(r"^\.[A-Za-z0-9]") | before.rlike(r"[A-Za-z0-9]\.$") | candidate.rlike(r"^[^.]+(\.[^.]+)+$"),
        before.rlike(r"://[^\s/:@\"']*:$") & after.rlike("^@"),
    ]
    return F.struct(*[v.cast("double").alias(name) for v, name in zip(values, FEATURES)])


def find_candidates(docs: DataFrame, known: list[str], text_col: str = "text", path_col: str = "source", name: str = "findings") -> DataFrame:
    """All rows with an array ``name`` of findings: start, length, candidate, before, after and features.

    Positions count characters from 0. A null text has an empty array, a null path counts as an empty one. A column
    already named ``name`` is replaced.
    """

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    spare = "_starts"
    while spare in docs.columns:
        spare += "_"

    # Pieces: the text before candidate i at 2i, the candidate itself at 2i + 1.
    pieces, places = F.col(name), F.sequence(F.lit(0), ((F.size(name) - 3) / 2).cast("int"))

    # Where candidate i starts: the texts before it and the candidates among them.
    def next_start(done: Column, i: Column) -> Column:
        upto = F.when(F.size(done) > 0, F.element_at(done, -1) + F.length(F.get(pieces, 2 * i - 1))).otherwise(0)
        return F.concat(done, F.array(upto + F.length(F.get(pieces, 2 * i))))

    def finding(i: Column) -> Column:
        candidate, left, right = F.get(pieces, 2 * i + 1), F.get(pieces, 2 * i), F.get(pieces, 2 * i + 2)
        before, after = F.right(left, F.lit(AROUND)), F.left(right, F.lit(AROUND))
        return F.struct(
            F.get(F.col(spare), i).alias("start"),
            F.length(candidate).alias("length"),
            candidate.alias("candidate"),
            before.alias("before"),
            after.alias("after"),
            _features(candidate, before, after, path, known).alias("features"),
        )

    some = F.size(name) > 1
    empty = F.array().cast(FINDINGS)
    cut = docs.withColumn(name, _pieces(text))
    held = cut.withColumn(spare, F.when(some, F.aggregate(places, F.array().cast("array<int>"), next_start)))
    return held.withColumn(name, F.when(some, F.transform(places, finding)).otherwise(empty)).drop(spare)


# Characters of which the first that a text lacks marks its candidates.
MARKS = [chr(c) for c in range(1, 9)]


def _pieces(text: Column) -> Column:
    """A text cut at its candidates, which stand between the pieces: one pass of the pattern, two for a text with all marks."""

    found, between = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), 1), F.split(text, CANDIDATE, -1)
    zipped = F.flatten(F.zip_with(between, found, lambda one, two: F.when(two.isNull(), F.array(one)).otherwise(F.array(one, two))))
    for mark in reversed(MARKS):
        marked = F.split(F.regexp_replace(text, f"({CANDIDATE})", f"{mark}$1{mark}"), mark, -1)
        zipped = F.when(~F.contains(text, F.lit(mark)), marked).otherwise(zipped)
    return zipped


FINDINGS = (
    "array<struct<start:int,length:int,candidate:string,before:string,after:string,features:struct<"
    + ",".join(f"{name}:double" for name in FEATURES)
    + ">>>"
)


def one_by_one(found: DataFrame, name: str = "findings", *columns: str) -> DataFrame:
    """A row per finding: ``columns``, its ``place`` in the row from 0, and the finding as ``one``.

    An outer explode: for an inner one Spark tests the array's size first, and so computes every feature in a filter,
    with the pattern run over the whole text for each of them.
    """

    return found.select(*map(col, columns), F.posexplode_outer(name).alias("place", "one")).filter("one.candidate is not null")


def label_findings(findings: DataFrame) -> DataFrame:
    """Labels for findings that are beyond doubt, by rules that name the value or its harmless kind; others are left out.

    1: a key block, a key of a public format, a password in a URL, or a named, assigned value of eight characters or more that is
    no plain word. 0: plain numbers, values covered by the dictionary, and without a name of a secret values beside a harmless word,
    plain words, and parts of addresses and file names.
    """

    f = F.col("features")
    named = (f["named"] == 1) & (f["assigned"] == 1) & (f["dictionary"] < 0.3) & (f["numeric"] == 0) & (f["word"] == 0) & (f["length"] >= 8)
    yes = F.col("candidate").rlike(KEY_BLOCK) | (f["format"] == 1) | (f["url"] == 1) | named
    other = (f["harmless"] == 1) | (f["word"] == 1) | (f["mail"] == 1) | (f["file"] == 1)
    no = (f["numeric"] == 1) | (f["dictionary"] >= 0.5) | (other & (f["named"] == 0))
    return findings.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).filter("label is not null")


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Callable[[Column], Column]:
    """A column function from ``features`` to the share of trees that call the finding a secret.

    Fitted on all different labelled findings (columns ``features`` and ``label``). With labels of one kind the
    answer is that label; without any, every candidate is a secret.
    """

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    # In the order of a hash, so that trees depend on the findings and not on where they were found.
    order = F.pmod(F.xxhash64("label", *FEATURES), F.lit(1 << 20))
    drawn = stage(labelled.select("features.*", "label").distinct().orderBy(order, "label", *FEATURES), "labelled")
    kinds = sorted(r["label"] for r in drawn.select("label").distinct().collect())
    if len(kinds) < 2:
        constant = kinds[0] if kinds else 1.0
        return lambda features: F.lit(constant)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(drawn)
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=1).fit(vectors)
    parsed = [_tree(t.toDebugString.splitlines()[1:]) for t in model.trees]

    def score(features: Column) -> Column:
        total = F.lit(0.0)
        for node in parsed:
            total = total + _condition(node, features)
        return total / len(parsed)

    return score


def _tree(lines: list[str]):
    """Nested (feature, threshold, then, else) or a leaf's class, from the printed form of a tree."""

    rows = iter(lines)

    def node():
        line = next(rows).strip()
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        then = node()
        next(rows)
        return int(feature), float(threshold), then, node()

    return node()


def _condition(node, features: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, then, other = node
    return F.when(features[FEATURES[feature]] <= threshold, _condition(then, features)).otherwise(_condition(other, features))


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    path_col: str = "source",
    known: list[str] | None = None,
    score: Callable[[Column], Column] | None = None,
    threshold: float = 0.5,
    name: str = "findings",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` (columns ``keep``, all if not given) with their findings, each with ``score`` and ``is_secret``.

    ``known`` is the dictionary and ``score`` the trained forest; where they are not given, both are made from
    ``docs`` itself, the forest from the findings its rules can label.

    A null or empty text has no findings, a null path is an empty one; equal rows have equal findings each. A column
    named ``name`` is replaced, an empty table stays empty.
    """

    known = dictionary(docs, text_col) if known is None else known
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    found = find_candidates(docs, known, text_col, path_col, name).select(*map(col, kept), name)
    if score is None:
        # Written once for training and scoring: the pattern is by far the dearest part.
        found = stage(found, "findings")
        score = train_forest(label_findings(one_by_one(found, name).select("one.*")))
    judged = F.transform(name, lambda one: one.withField("score", score(one["features"])))
    judged = F.transform(judged, lambda one: one.withField("is_secret", one["score"] >= threshold))
    return found.withColumn(name, judged)


def redact_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``; all else, and rows without a secret, unchanged.

    Texts with a secret alone are cut a second time.
    """

    name = "_findings"
    while name in docs.columns:
        name += "_"
    found = scan_secrets(docs, text_col, path_col, name=name)
    between = F.split(col(text_col).cast("string"), CANDIDATE, -1)
    shown = F.transform(name, lambda one: F.when(one["is_secret"], F.lit(mask)).otherwise(one["candidate"]))
    pieces = F.zip_with(between, shown, lambda text, one: F.concat(text, F.coalesce(one, F.lit(""))))
    redacted = F.when(F.exists(name, lambda one: one["is_secret"]), F.array_join(pieces, "")).otherwise(col(text_col))
    return found.withColumn(text_col, redacted).select(*[col(c) for c in docs.columns])
