"""Secret scans: patterns find candidates, a random forest removes the false ones; DataFrame operations only.

A candidate is a run of 16 or more key characters.  Its features are its length, the
transitions between kinds of characters, the share of it that dictionary words cover,
the document's path and the words beside it.  The forest is trained by Spark's own
random-forest estimator from labelled findings and then written out as SQL ``CASE``
trees, so that scoring is part of the scan: one pass, no shuffle, no model on executors.

Training uses at most ``LABELLED`` findings of each label, those with the least hashes
of all labelled findings of all documents; candidates are looked for in every document,
and every one is scored.

Defined results: null and empty texts have no candidates; without findings of both labels
there is no forest, and the labelling rule itself decides; repeated rows are scanned one
by one; extra columns pass through and give way to result columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .spans import located, replaced

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
BESIDE = 32
LABELLED = 10_000
TREES, DEPTH, SEED = 15, 5, 7
THRESHOLD = 0.5

#: Words that name secrets, and ordinary words of names and prose (the dictionary of coverage).
NAMING = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|auth|credential|private_?key"
HARMLESS = "example|sample|dummy|placeholder|changeme|your_?key|test"
DICTIONARY = (
    "tion|ment|ing|the|and|that|with|for|from|have|this|not|are|was|were|been|which|their|would|there|about|other|into|than|then|them|"
    "der|die|das|und|nicht|ein|sich|mit|auf|den|ist|von|lich|keit|heit|schaft|"
    "les|des|que|une|est|pour|dans|avec|sur|eau|elle|oir|"
    "los|las|del|con|una|por|para|como|mente|ción|idad|"
    "id|name|path|file|data|index|page|user|list|item|type|code|value|error|http|www|com"
)
FEATURES = (
    "length", "transitions", "digits", "upper", "distinct", "hex_only", "coverage", "named", "assigned", "quoted", "harmless", "path_test", "vendor",
)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def features(found: Column, before: Column, after: Column, path: Column) -> Column:
    """Numbers about one candidate, in the order of FEATURES."""
    n = F.length(found)
    kinds = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "U" * 26 + "L" * 26 + "D" * 10)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*+", "x"))
    left = F.length(F.regexp_replace(F.lower(found), DICTIONARY, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(
        n.cast("double").alias("length"),
        share(runs - 1, n).alias("transitions"),
        share(F.length(F.regexp_replace(kinds, "[^D]", "")), n).alias("digits"),
        share(F.length(F.regexp_replace(kinds, "[^U]", "")), n).alias("upper"),
        share(F.size(F.array_distinct(F.split(found, ""))), n).alias("distinct"),
        flag(found.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"),
        (1.0 - share(left, n)).alias("coverage"),
        flag(F.lower(before).rlike(NAMING)).alias("named"),
        flag(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")).alias("quoted"),
        flag(F.lower(F.concat(before, found, after)).rlike(HARMLESS)).alias("harmless"),
        flag(F.lower(path).rlike("test|example|sample|fixture|docs?/")).alias("path_test"),
        flag(found.rlike("^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|glpat-)")).alias("vendor"),
    )


def candidates(text: Column, path: Column, beside: int = BESIDE) -> Column:
    """Candidates of a text with their places, words beside them and features."""

    def described(c):
        first = F.greatest(c["start"] - beside, F.lit(0))
        before = F.substring(text, first + 1, c["start"] - first)
        after = F.substring(text, c["end"] + 1, F.lit(beside))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), before.alias("before"), features(c["match"], before, after, path).alias("f"))

    return F.transform(located(text, CANDIDATE), described)


def rule_label(match: Column, f: Column) -> Column:
    """Labels of the findings at hand: 1 for provider formats and for mixed strings assigned to a secret's name, 0 for strings without digits."""
    provider = match.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^glpat-[A-Za-z0-9_-]{20}$|^AIza[A-Za-z0-9_-]{35}$")
    assigned = (f["named"] == 1) & (f["assigned"] == 1) & (f["digits"] > 0) & (f["harmless"] == 0)
    harmless = (f["digits"] == 0) & (f["assigned"] == 0) | match.rlike("^[0-9]+$")
    return F.when(provider | assigned, 1.0).when(harmless, 0.0)


def findings(docs: DataFrame, text: str = "text", path: str | None = "source") -> DataFrame:
    """``(match, before, f)`` of every candidate of every document."""
    at = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    own = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), at.alias("path"))
    return own.select(F.explode(candidates(F.col("text"), F.col("path"))).alias("c")).select("c.match", "c.before", "c.f")


def labelled_sample(found: DataFrame, label: Column | None = None, most: int = LABELLED) -> list:
    """At most ``most`` distinct findings of each label, those with the least hashes."""
    rows = found.withColumn("label", rule_label(F.col("match"), F.col("f")) if label is None else label).where("label is not null")
    path = scratch_path(found.sparkSession, "labelled-findings")
    rows.select("label", "match", "f").distinct().withColumn("h", F.xxhash64("match", "f")).write.parquet(path)
    rows = found.sparkSession.read.parquet(path)
    return [r for value in (0.0, 1.0) for r in rows.where(F.col("label") == value).orderBy("h", "match").limit(most).collect()]


def train_forest(docs: DataFrame, sample: list, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A fitted random forest, or None without findings of both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    if len({r["label"] for r in sample}) < 2:
        return None
    rows = [(r["label"], Vectors.dense([float(r["f"][name]) for name in FEATURES])) for r in sample]
    frame = docs.sparkSession.createDataFrame(rows, ["label", "features"]).coalesce(1)  # bounded by ``most``
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(frame)


def tree_sql(node) -> str:
    """Probability of label 1 below a node of a fitted tree."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return repr(stats[1] / sum(stats))
    split = node.split()
    return f"CASE WHEN f.`{FEATURES[split.featureIndex()]}` <= {split.threshold()!r}D THEN {tree_sql(node.leftChild())} ELSE {tree_sql(node.rightChild())} END"


def forest_score(model) -> str:
    """Mean probability of the trees as SQL over a struct ``f``."""
    trees = [tree_sql(tree._call_java("rootNode")) for tree in model.trees]
    return "(" + " + ".join(f"({t})" for t in trees) + f") / {len(trees)}D"


def scan(docs: DataFrame, text: str = "text", path: str | None = "source", label: Column | None = None, most: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``n_candidates`` and ``secrets`` (spans with their scores)."""
    model = train_forest(docs, labelled_sample(findings(docs, text, path), label, most))
    rows = docs.drop("n_candidates", "secrets", "__found")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    at = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    found = rows.withColumn("__found", candidates(own, at))
    if model is None:
        scored = F.transform("__found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.coalesce(rule_label(c["match"], c["f"]), F.lit(0.0)).alias("score")))
    else:
        # The trees read a column named f; inside the lambda that is the candidate's.
        sql = f"transform(__found, c -> named_struct('start', c.start, 'end', c.end, 'score', cast({forest_score(model).replace('f.`', 'c.f.`')} as double)))"
        scored = F.expr(sql)
    found = found.withColumn("secrets", F.filter(scored, lambda s: s["score"] >= threshold))
    return found.withColumn("n_candidates", F.size("__found").cast("bigint")).select(*[f"`{c}`" for c in rows.columns], "n_candidates", "secrets")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every secret replaced by ``mask``; a column ``n_chars`` follows."""
    found = scan(docs, text, **options)
    own = F.col(f"`{text}`").cast("string")
    out = found.withColumn(text, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).otherwise(replaced(own, F.col("secrets"), lambda s: F.lit(mask))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])

