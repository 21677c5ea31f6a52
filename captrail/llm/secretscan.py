"""Secrets in texts: candidates by shape, false positives removed by a random forest, in DataFrame functions alone.

A candidate is a run of key characters that is long, or has a digit, or is assigned in quotes. Findings whose form or
assignment settles what they are (keys of known issuers, random values given to a password or token; numbers, hosts,
placeholders) are the labelled ones. The forest learns from them by length, character classes and transitions, coverage
by words of the corpus, path-like surroundings and neighbouring words, and judges all candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

CANDIDATE = (r"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]{0,80}[0-9])[A-Za-z0-9+/_\-]{10,}|[A-Za-z0-9+/_\-]{24,})"
             r"|(?<=[:=] ?[\"'])[^\s\"']{8,}(?=[\"'])")
ISSUED = (r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
          r"|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{10,})$")
KEYWORDS = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_ \-]?key|access[_ \-]?key|auth|credential|private)"
ASSIGNED = KEYWORDS + r"[a-z0-9_]{0,12}[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"
PLACEHOLDER = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_\-]|xxxx|1234|abcd|test)"
LABELLED = 20_000
COMMON = 20
LEFT, RIGHT = 40, 24
SHORTEST = 8
TREES, DEPTH = 24, 6
FEATURES = ("length", "digits", "uppers", "symbols", "hexadecimal", "turns", "letter_digit", "digit_letter", "case_turns", "distinct", "covered",
            "in_path", "assigned_sign", "keyword", "placeholder", "quoted", "left_letters")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, at, candidate, left, right``: each candidate with its place among those of the text, and what surrounds it.

    The surroundings are those of the text, other candidates included. A candidate has ``SHORTEST`` characters or more, so
    a few neighbours on either side fill them, however long the text.
    """
    hit = docs.where(F.col("text").rlike(CANDIDATE))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    parts = hit.select("doc_id", found.alias("found"), F.split("text", CANDIDATE, -1).alias("around"))
    ends = parts.select("doc_id", "found", "around", *[
        F.transform(name, lambda x: cut(x, F.lit(n))).alias(f"{name}_{side}")
        for name in ("found", "around") for side, cut, n in (("left", F.right, LEFT), ("right", F.left, RIGHT))])
    back, ahead = -(-LEFT // SHORTEST), -(-RIGHT // SHORTEST)
    left = [x for k in range(back, 0, -1) for x in (("around_left", -k), ("found_left", -k))] + [("around_left", 0)]
    right = [("around_right", 1)] + [x for k in range(1, ahead + 1) for x in (("found_right", k), ("around_right", k + 1))]
    near = F.arrays_zip("found", *[_shifted(name, k).alias(f"{side}{j}") for side, pieces in (("l", left), ("r", right)) for j, (name, k) in enumerate(pieces)])
    rows = ends.select("doc_id", F.posexplode(near).alias("at", "x")).where("x.found is not null")
    return rows.select("doc_id", "at", F.col("x.found").alias("candidate"),
                       F.right(F.concat_ws("", *[f"x.l{j}" for j in range(len(left))]), F.lit(LEFT)).alias("left"),
                       F.left(F.concat_ws("", *[f"x.r{j}" for j in range(len(right))]), F.lit(RIGHT)).alias("right"))


def _shifted(name: str, by: int) -> Column:
    """The array with the element ``by`` places on at every place."""
    if by < 0:
        return F.concat(F.array_repeat(F.lit(""), -by), F.col(name))
    return F.slice(name, by + 1, F.greatest(F.lit(0), F.size(name) - by))


def _share(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1), F.length(text))


def described(rows: DataFrame) -> DataFrame:
    """Add the features that a candidate and its surroundings give by themselves."""
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    return rows.select(
        "*", F.length(c).cast("double").alias("length"), _share("[0-9]", c).alias("digits"), _share("[A-Z]", c).alias("uppers"),
        _share("[^A-Za-z0-9]", c).alias("symbols"), _share("[0-9a-f]", c).alias("hexadecimal"),
        _share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]", c).alias("turns"),
        _share("(?<=[A-Za-z])[0-9]", c).alias("letter_digit"), _share("(?<=[0-9])[A-Za-z]", c).alias("digit_letter"),
        _share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]", c).alias("case_turns"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.lit(1), F.length(c))).alias("distinct"),
        (left.rlike(r"(?:[/\\@.]|https?:\S*)$") | right.rlike(r"^(?:[/\\@]|\.[A-Za-z])")).cast("double").alias("in_path"),
        left.rlike(r"[:=]\s{0,2}[\"']?$").cast("double").alias("assigned_sign"),
        F.concat_ws(" ", left, right).rlike(KEYWORDS).cast("double").alias("keyword"),
        F.concat_ws(" ", left, c, right).rlike(PLACEHOLDER).cast("double").alias("placeholder"),
        left.rlike("[\"']$").cast("double").alias("quoted"), _share("[A-Za-z]", left).alias("left_letters"))


def with_coverage(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``covered``: the share of a candidate that words occurring ``COMMON`` times or more in the corpus make up."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("run")).where(F.length("run") >= 3)
    words = words.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("run")
    runs = rows.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    known = runs.join(words, "run").groupBy("candidate").agg(F.sum(F.length("run")).alias("known"))
    return rows.join(known, "candidate", "left").withColumn("covered", F.coalesce("known", F.lit(0)) / F.greatest(F.lit(1), F.length("candidate"))).drop("known")


def labelled(rows: DataFrame) -> DataFrame:
    """Add ``label``: 1 or 0 where the form or the assignment settles it, else null."""
    c, left = F.col("candidate"), F.col("left")
    random = (F.length(c) >= 12) & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.col("distinct") >= 0.2)
    never = c.rlike(r"^[0-9_\-+/]+$") | (F.col("in_path") > 0) | c.rlike(r"^[A-Za-z\-]+$") | c.rlike(PLACEHOLDER) | c.rlike(r"^[A-Za-z]+[\-_]?[0-9]{1,4}$")
    return rows.withColumn("label", F.when(c.rlike(ISSUED) & ~c.rlike(PLACEHOLDER), 1).when(left.rlike(ASSIGNED) & random & ~never, 1).when(never, 0))


def judged(rows: DataFrame) -> DataFrame:
    """Add ``probability`` and ``secret`` by a forest fitted on at most ``LABELLED`` labelled findings of each kind.

    Without findings of both kinds there is nothing to learn from, and the labels alone decide.
    """
    known = rows.where("label is not null")
    # The sample is a feature of the fit: the findings with the least hashes of what they are, the same in every run.
    order = F.xxhash64("candidate", "left", "right", "doc_id", "at")
    fit = known.where("label = 1").orderBy(order).limit(LABELLED).union(known.where("label = 0").orderBy(order).limit(LABELLED))
    fit = stage(fit.select(F.col("label").cast("double").alias("label"), *FEATURES))
    kinds = {r.label for r in fit.select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        return rows.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.0))).withColumn("secret", F.col("probability") >= 0.5)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label", maxMemoryInMB=64)
    model = forest.fit(assembler.transform(fit).select("features", "label"))
    model.setPredictionCol("").setRawPredictionCol("")
    scored = model.transform(assembler.transform(rows.drop("label")))
    return scored.withColumn("probability", vector_to_array("probability")[1]).withColumn("secret", F.col("probability") >= 0.5)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, at, candidate, left, right, probability, secret`` and the features: a row per candidate of every whole text.

    Null and empty texts, and texts without candidates, give no rows. Repeated rows give repeated findings; a null id
    stays null; further columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stage(described(candidates(rows)))
    return judged(labelled(stage(with_coverage(found, rows))))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Digest of ``findings`` that keeps the secret itself out of the result."""
    return findings(docs).select("doc_id", "at", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"),
                                 "covered", "probability", "secret")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every judged secret replaced by ``mark``; all rows and columns stay."""
    secrets = findings(docs).where("secret").groupBy("doc_id").agg(F.sort_array(F.collect_set("candidate"), asc=False).alias("found"))
    joined = docs.alias("d").join(secrets.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    text = F.aggregate(F.coalesce(F.col("s.found"), F.array().cast("array<string>")), F.col("d.text"), lambda t, x: F.replace(t, x, F.lit(mark)))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
