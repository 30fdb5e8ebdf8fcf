"""Features from a tall table of tagged and parsed tokens.

Contract: ``doc_id, sent_id, i, text, pos, tag, dep, head_i, morph, is_punct,
is_space`` with ``i`` unique inside a document and ``head_i = i`` at a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio

# ---- fixed values ----
POS_TAGS = (
    "NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "SCONJ", "PART", "NUM", "INTJ",
)
DEPENDENCIES = {
    "nominal_subject": ("nsubj",),
    "passive_subject": ("nsubjpass", "csubjpass"),
    "object": ("dobj", "obj", "iobj", "pobj", "dative"),
    "clausal_subject": ("csubj", "csubjpass"),
    "clausal_complement": ("ccomp",),
    "open_clausal_complement": ("xcomp",),
    "adverbial_clause": ("advcl",),
    "relative_clause": ("relcl",),
    "coordination": ("conj",),
}
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "csubjpass")
FLAGS = ("word", "mark", "no_head", "no_sentence", "subject", "finite", *DEPENDENCIES)
NOWHERE = -(1 << 63)  # an id that no token has
MAX_ROUNDS = 40
SLICE_TOKENS = 1 << 19
# ----------------------


def is_word() -> Column:
    return ~F.col("is_punct") & ~F.col("is_space")


def is_finite_verb() -> Column:
    return is_word() & F.col("pos").isin("VERB", "AUX") & F.col("morph").contains("VerbForm=Fin")


def pos_features(tokens: DataFrame) -> DataFrame:
    """Counts and rates per 100 words of tags, verb forms and modals."""
    word = is_word()
    verb = word & F.col("pos").isin("VERB", "AUX")
    counts = {f"pos_{tag.lower()}_count": count_where(word & (F.col("pos") == tag)) for tag in POS_TAGS}
    counts |= {
        "finite_verb_count": count_where(is_finite_verb()),
        "past_verb_count": count_where(verb & F.col("morph").contains("Tense=Past")),
        "present_verb_count": count_where(verb & F.col("morph").contains("Tense=Pres")),
        "modal_auxiliary_count": count_where(word & (F.col("pos") == "AUX") & (F.col("tag") == "MD")),
    }
    counted = tokens.groupBy("doc_id").agg(
        count_where(word).alias("__n"), *[c.alias(name) for name, c in counts.items()]
    )
    per_100 = lambda c: ratio(c, "__n") * 100
    columns = []
    for tag in POS_TAGS:
        name = f"pos_{tag.lower()}"
        columns += [F.col(f"{name}_count").cast("double").alias(f"{name}_count"), per_100(f"{name}_count").alias(f"{name}_per_100_words")]
    columns += [
        F.col("finite_verb_count").cast("double").alias("finite_verb_count"),
        per_100("finite_verb_count").alias("finite_verbs_per_100_words"),
        F.col("past_verb_count").cast("double").alias("past_verb_count"),
        F.col("present_verb_count").cast("double").alias("present_verb_count"),
        F.col("modal_auxiliary_count").cast("double").alias("modal_auxiliary_count"),
        per_100("modal_auxiliary_count").alias("modal_auxiliaries_per_100_words"),
    ]
    return counted.select("doc_id", *columns)


def links(ids: np.ndarray, heads: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token's head (their number, if the head is not in the document) and the ancestors above each token.

    ``bounds`` part the tokens by document.  Depths follow by pointer jumping: every round
    doubles the distance a pointer covers.
    """
    size = len(ids)
    head = np.full(size, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            order = np.argsort(ids[a:b], kind="stable")
            own = ids[a:b][order]
            found = np.minimum(np.searchsorted(own, heads[a:b]), b - a - 1)
            head[a:b] = np.where(own[found] == heads[a:b], a + order[found], size)
    up, depth = np.append(head, size), np.append((head != np.arange(size)).astype(np.int64), 0)
    for _ in range(MAX_ROUNDS):
        more = depth[up]
        if not more.any():
            return head, depth[:size]
        depth, up = depth + more, up[up]
    raise ValueError("Heads do not form trees: a cycle or an absurd depth")


def measure_syntax(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sums and maxima of each document over its tokens and sentences."""
    lists = batch.column("i")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    ids, heads, sent, flags = (batch.column(c).flatten().to_numpy() for c in ("i", "head", "sent", "flags"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    has = {name: (flags >> k & 1).astype(bool) for k, name in enumerate(FLAGS)}
    word = has["word"]
    head, depth = links(ids, np.where(has["no_head"], NOWHERE, heads), bounds)
    head_is_mark = np.append(has["mark"], False)[head]
    far = word & ~has["no_head"] & (heads != ids) & ~head_is_mark
    order = np.lexsort((sent, has["no_sentence"], row))
    first = np.concatenate([[True], np.diff(row[order]).astype(bool) | np.diff(sent[order]).astype(bool) | (np.diff(has["no_sentence"][order].astype(np.int8)) != 0)])
    starts = np.flatnonzero(first)
    subject, finite = (np.logical_or.reduceat(has[n][order], starts) for n in ("subject", "finite"))
    of = row[order][starts]

    def total(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(at, value, batch.num_rows).astype(np.int64)

    distance, steps = np.where(far, np.abs(ids - heads), 0), np.where(word, depth, 0)
    found = {
        "s": total(of, np.ones(len(of))), "ds": total(row, distance), "dn": total(row, far), "dx": np.maximum.reduceat(distance, bounds[:-1]),
        "ps": total(row, steps), "pn": total(row, word), "px": np.maximum.reduceat(steps, bounds[:-1]),
        "with_subject": total(of, subject), "with_finite": total(of, finite), "complete": total(of, subject & finite),
    } | {name: total(row, has[name]) for name in DEPENDENCIES}
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, pa.int64()) for v in found.values()]], ["doc_id", *found])


def syntax_features(tokens: DataFrame) -> DataFrame:
    """Arc lengths, tree depths, dependency counts and sentence completeness.

    Labels become bits of a number, and a document's tokens meet once, as lists of numbers.
    """
    word = is_word()
    bits = {
        "word": word, "mark": F.col("is_punct") | F.col("is_space"), "no_head": F.col("head_i").isNull(), "no_sentence": F.col("sent_id").isNull(),
        "subject": word & F.col("dep").isin(*SUBJECTS), "finite": is_finite_verb(), **{name: word & F.col("dep").isin(*labels) for name, labels in DEPENDENCIES.items()},
    }
    flags = reduce(lambda x, y: x + y, [F.when(bits[name], 1 << k).otherwise(0) for k, name in enumerate(FLAGS)])
    number = lambda c: F.col(c).cast("bigint")
    compact = tokens.where(F.col("doc_id").isNotNull() & F.col("i").isNotNull()).select(
        "doc_id", number("i").alias("i"), F.coalesce(number("head_i"), number("i")).alias("head"), F.coalesce(number("sent_id"), F.lit(0).cast("bigint")).alias("sent"), flags.cast("int").alias("flags")
    )
    columns = ["i", "head", "sent", "flags"]
    # All without NULLs and filled row by row in one aggregate, so the lists stand in one order; alike numbers side by side pack well.
    packed = compact.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # Whole documents with about SLICE_TOKENS tokens, one document at least.
                sizes = np.diff(batch.column("i").offsets.to_numpy())
                part = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield measure_syntax(batch.slice(a, b - a))

    shape = f"doc_id {dict(tokens.dtypes)['doc_id']}, " + ", ".join(f"{name} bigint" for name in ("s", "ds", "dn", "dx", "ps", "pn", "px", "with_subject", "with_finite", "complete", *DEPENDENCIES))
    docs = packed.mapInArrow(run, shape)
    columns = [
        ratio(F.coalesce("ds", F.lit(0)), "dn").alias("mean_dependency_distance"),
        F.coalesce("dx", F.lit(0)).cast("double").alias("max_dependency_distance"),
        ratio(F.coalesce("ps", F.lit(0)), "pn").alias("mean_dependency_tree_depth"),
        F.coalesce("px", F.lit(0)).cast("double").alias("max_dependency_tree_depth"),
    ]
    for name in DEPENDENCIES:
        columns += [F.col(name).cast("double").alias(f"{name}_count"), ratio(name, "s").alias(f"{name}_per_sentence")]
    columns += [
        F.col("with_subject").cast("double").alias("sentences_with_subject_count"),
        F.col("with_finite").cast("double").alias("sentences_with_finite_verb_count"),
        F.col("complete").cast("double").alias("sentences_with_subject_and_finite_verb_count"),
        ratio("with_subject", "s").alias("sentences_with_subject_rate"),
        ratio("with_finite", "s").alias("sentences_with_finite_verb_rate"),
        ratio("complete", "s").alias("sentence_completeness_rate"),
    ]
    return docs.select("doc_id", *columns)
