"""Per-document text features.

Everything a document needs sits in its own row, so tokens, sentences and
n-grams are arrays inside the row and no feature shuffles.  Token columns are
added in steps, which keeps each tokenization evaluated once.  Steps with loops
over words stand in a ``let``: generated into one method with all else, the loops
would be in a method too long for the JVM to compile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.numeric import count_where, is_finite, let, ratio
from .ranking import exact_quantiles

# ---- fixed values: feature names in their fixed order ----
SURFACE = (
    "word_count", "unique_word_count", "type_token_ratio", "root_type_token_ratio", "sentence_count",
    "mean_sentence_length", "median_sentence_length", "std_sentence_length", "min_sentence_length",
    "max_sentence_length", "character_count", "mean_word_length", "punctuation_count",
    "punctuation_per_100_words", "question_mark_count", "exclamation_mark_count", "duration_seconds",
    "words_per_second", "words_per_minute",
)
SPOKEN = (
    "very_short_sentence_count", "very_short_sentence_rate", "adjacent_repeated_word_count",
    "adjacent_repeated_word_rate", "repeated_bigram_count", "repeated_bigram_rate",
    "repeated_trigram_count", "repeated_trigram_rate", "repeated_sentence_count",
    "repeated_sentence_rate", "filler_count", "fillers_per_100_words",
)
DISFLUENCY = (
    "disf_n_words", "disf_filler_rate", "disf_false_start_rate", "disf_repeat_rate",
    "disf_type_token_ratio", "disf_mean_word_length", "disf_mean_sentence_words",
)
FAMILIES = {"surface": SURFACE, "spoken": SPOKEN, "disfluency": DISFLUENCY}
# -----------------------------------------------------------


def with_spaced(df: DataFrame, text: str) -> DataFrame:
    """Add the text with single blanks, as it is and lower-cased."""
    return df.withColumn("__spaced", let(F.col(text), T.one_spaced)).withColumn("__lowered", F.lower("__spaced"))


def with_sentences(df: DataFrame) -> DataFrame:
    """Add the lower-cased words of the document, and each sentence as its words with blanks between."""
    lines = F.replace(F.replace("__joined", F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))
    return (
        df.withColumn("__tokens", let(F.col("__lowered"), T.sentence_words))
        .withColumn("__words", let(F.col("__tokens"), lambda t: F.array_remove(t, "\n")))
        .withColumn("__joined", F.array_join("__tokens", " "))
        .withColumn("__sents", F.when(F.col("__spaced") == "", F.array().cast("array<string>")).otherwise(F.split(lines, "\n")))
        .withColumn("__lens", F.transform("__sents", T.count_pieces))
        .withColumn("__unique", F.size(F.array_distinct("__words")))
    )


def add_surface(df: DataFrame, text: str, duration: str) -> DataFrame:
    n = F.size("__words")
    unique = F.col("__unique")
    work = df.withColumn("__marks", let(F.col(text), T.punctuation))
    punctuation = F.length("__marks")
    tokens = F.size("__tokens")
    letters = F.length("__joined") - F.greatest(tokens - 1, F.lit(0)) - (tokens - n)
    seconds = F.col(duration).cast("double")
    values = (
        n, unique, ratio(unique, n), ratio(unique, F.sqrt(n.cast("double"))), F.size("__lens"),
        T.array_mean(F.col("__lens")), T.array_median(F.col("__lens")), T.array_std(F.col("__lens")),
        F.coalesce(F.array_min("__lens"), F.lit(0)), F.coalesce(F.array_max("__lens"), F.lit(0)),
        F.length(text), ratio(letters, n), punctuation, ratio(punctuation, n) * 100,
        T.count_of("__marks", "?"), T.count_of("__marks", "!"), seconds,
        ratio(n, seconds), ratio(n, seconds) * 60,
    )
    return work.withColumns({name: v.cast("double") for name, v in zip(SURFACE, values)})


def with_ngram_counts(df: DataFrame) -> DataFrame:
    """Add the numbers of words that equal the one before, and of distinct pairs and triples of words.

    Words, and pairs for the triples, are compared by 32-bit codes wherever the
    document's distinct items have distinct codes, which is counted; a document
    where two items share a code is compared as text.
    """
    distinct = lambda c: F.size(F.array_distinct(c))
    flat = F.array_join("__words", " ")
    return (
        df.withColumn("__codes", T.short_codes("__words"))
        .withColumn("__pairs", T.followed("__codes", "__codes", 1))
        .withColumn("__pair_codes", T.short_codes("__pairs"))
        .withColumns({
            "__words_differ": distinct("__codes") == F.col("__unique"),
            "__distinct_pairs": distinct("__pairs"),
            "__distinct_pair_codes": distinct("__pair_codes"),
            "__distinct_triples": distinct(T.followed("__pair_codes", "__codes", 2)),
        })
        .withColumn("__pairs_differ", F.col("__words_differ") & (F.col("__distinct_pair_codes") == F.col("__distinct_pairs")))
        .withColumns({
            "__adjacent": F.when(~F.col("__words_differ"), T.adjacent_repeats(F.col("__words"))).otherwise(T.same_halves("__pairs")),
            "__distinct_pairs": F.when(~F.col("__words_differ"), T.distinct_ngrams(flat, 2)).otherwise(F.col("__distinct_pairs")),
            "__distinct_triples": F.when(~F.col("__pairs_differ"), T.distinct_ngrams(flat, 3)).otherwise(F.col("__distinct_triples")),
        })
    )


def add_spoken(df: DataFrame) -> DataFrame:
    n, sentences = F.size("__words"), F.size("__sents")
    pairs, triples = F.greatest(n - 1, F.lit(0)), F.greatest(n - 2, F.lit(0))
    short = F.size(F.filter("__lens", lambda k: k <= T.VERY_SHORT_SENTENCE))
    counts = {
        "__short": short,
        "__two": pairs - F.col("__distinct_pairs"),
        "__three": triples - F.col("__distinct_triples"),
        "__again": T.excess(F.col("__sents")),
        "__fillers": T.spoken_fillers("__joined"),
    }
    short, two, three, again, fillers = (F.col(c) for c in counts)
    adjacent = F.col("__adjacent")
    values = (
        short, ratio(short, sentences), adjacent, ratio(adjacent, pairs),
        two, ratio(two, pairs), three, ratio(three, triples),
        again, ratio(again, sentences), fillers, ratio(fillers, n) * 100,
    )
    return with_ngram_counts(df).withColumns(counts).withColumns({name: v.cast("double") for name, v in zip(SPOKEN, values)})


def add_disfluency(df: DataFrame, canonical: str, verbatim: str) -> DataFrame:
    """Rates per whitespace token of the verbatim text, the one that is spaced; denominators are at least 1."""
    work = (
        df.withColumn("__marked", let(F.col("__lowered"), T.marked_fillers))
        .withColumn("__content_line", let(F.col("__marked"), T.content_line))
        .withColumn("__content", let(F.col("__content_line"), T.parts))
    )
    pieces = F.greatest(T.count_pieces("__spaced"), F.lit(1))
    n = F.size("__content")
    floor = F.greatest(n, F.lit(1))
    letters = F.octet_length(F.replace("__content_line", F.lit(" "), F.lit("")))
    fillers = T.count_of("__marked", T.FILLER_MARK) - T.count_of(verbatim, T.FILLER_MARK)
    spans = F.regexp_count(F.col(canonical), F.lit(T.SENTENCE_TEXT))
    values = (
        n,
        fillers / pieces,
        F.regexp_count(F.col(verbatim), F.lit(T.FALSE_START_PATTERN)) / pieces,
        F.regexp_count(F.concat(F.lit(" "), verbatim), F.lit(T.REPEAT_PATTERN)) / pieces,
        F.size(F.array_distinct("__content")) / floor,
        letters / floor,
        (n if canonical == verbatim else F.size(T.content_tokens(canonical))) / F.greatest(spans, F.lit(1)),
    )
    return work.withColumns({name: v.cast("double") for name, v in zip(DISFLUENCY, values)})


def surface_features(df: DataFrame, key: Sequence[str], text: str, duration: str) -> DataFrame:
    work = add_surface(with_sentences(with_spaced(df, text)), text, duration)
    return work.select(*key, *SURFACE)


def spoken_features(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    return add_spoken(with_sentences(with_spaced(df, text))).select(*key, *SPOKEN)


def disfluency_rates(df: DataFrame, key: Sequence[str], canonical: str, verbatim: str) -> DataFrame:
    return add_disfluency(with_spaced(df, verbatim), canonical, verbatim).select(*key, *DISFLUENCY)


def feature_names(families: Sequence[str], exclude: Sequence[str] = (), prefix: str | None = None) -> list[str]:
    """Columns of the named families in fixed order, minus exclusions, by prefix."""
    names = [n for family in families for n in FAMILIES[family] if n not in exclude]
    return [n for n in names if prefix is None or n.startswith(prefix)]


def document_features(
    df: DataFrame, key: Sequence[str], text: str, duration: str, families: Sequence[str] = tuple(FAMILIES), exclude: Sequence[str] = ()
) -> DataFrame:
    """All families side by side from one scan, without a join."""
    work = with_spaced(df, text)
    if "surface" in families or "spoken" in families:
        work = with_sentences(work)
    if "surface" in families:
        work = add_surface(work, text, duration)
    if "spoken" in families:
        work = add_spoken(work)
    if "disfluency" in families:
        work = add_disfluency(work, text, text)
    return work.select(*key, *feature_names(families, exclude))


def document_violations(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Counts of blank identities and non-finite features."""
    blank = None
    for k in key:
        hit = F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
        blank = hit if blank is None else blank | hit
    bad = None
    for f in features:
        hit = ~F.coalesce(is_finite(f), F.lit(False))
        bad = hit if bad is None else bad | hit
    return df.agg(count_where(blank).alias("blank_identity"), count_where(bad).alias("not_finite"))


def repair_rates(df: DataFrame, key: Sequence[str], canonical: str, verbatim: str) -> DataFrame:
    """Share of verbatim content words without a partner in the canonical text.

    Words are matched as bags (each canonical word can serve once); their order
    is not compared.  Both texts' words go through one count per (pair, word).
    """
    both = F.concat(
        F.transform(T.content_tokens(canonical), lambda w: F.struct(w.alias("w"), F.lit(1).alias("c"), F.lit(0).alias("v"))),
        F.transform(T.content_tokens(verbatim), lambda w: F.struct(w.alias("w"), F.lit(0).alias("c"), F.lit(1).alias("v"))),
    )
    words = df.select(*key, F.explode_outer(both).alias("t"))
    counted = words.groupBy(*key, F.col("t.w").alias("w")).agg(F.sum("t.c").alias("c"), F.sum("t.v").alias("v"))
    return counted.groupBy(*key).agg(
        F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("n_words"),
        F.when(F.coalesce(F.sum("v"), F.lit(0)) > 0, 1 - F.try_divide(F.sum(F.least("c", "v")), F.sum("v")))
        .otherwise(F.lit(0.0))
        .alias("repair_rate"),
    )


def token_edit_distance(source: Column, target: Column) -> Column:
    """Levenshtein distance of two token arrays.

    Each distinct token of the pair becomes one code point (surrogates are
    skipped), and the built-in string distance compares the encoded texts.
    """

    def encoded(tokens: Column, vocabulary: Column) -> Column:
        def one(token: Column) -> Column:
            index = F.array_position(vocabulary, token) + 255
            code = F.when(index >= 0xD800, index + 0x800).otherwise(index)
            return F.lpad(F.hex(code.cast("bigint")), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(tokens, one), "")), "UTF-32")

    return F.when(F.size(source) == 0, F.size(target)).when(F.size(target) == 0, F.size(source)).otherwise(
        let(F.array_distinct(F.concat(source, target)), lambda known: F.levenshtein(encoded(source, known), encoded(target, known)))
    )


def sentence_pairs(df: DataFrame, key: Sequence[str], original: str, corrected: str) -> DataFrame:
    """Aligned sentences of two texts with their word tokens and edit distance.

    The shorter text is filled up: a sentence without a partner is not
    ``matched`` and costs all its tokens.
    """
    a = df.withColumn("__a", T.sentences(original)).withColumn("__b", T.sentences(corrected))
    paired = a.select(*key, F.posexplode(F.arrays_zip(F.col("__a").alias("a"), F.col("__b").alias("b"))).alias("pos", "p"))
    words = paired.select(
        *key,
        "pos",
        (F.col("p.a").isNotNull() & F.col("p.b").isNotNull()).alias("matched"),
        *[T.word_tokens(F.coalesce(F.col(f"p.{c}"), F.lit(""))).alias(name) for c, name in (("a", "source"), ("b", "target"))],
    )
    return words.withColumn("distance", token_edit_distance(F.col("source"), F.col("target")).cast("bigint"))


def edit_features(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edits per original word, share of changed or unmatched sentences, original words."""
    n = F.sum(F.size("source"))
    return pairs.groupBy(*key).agg(
        (F.sum("distance") / F.greatest(n, F.lit(1))).alias("gec_edit_rate"),
        (F.sum(F.when((F.col("distance") > 0) | ~F.col("matched"), 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1))).alias("gec_changed_fraction"),
        n.cast("bigint").alias("gec_n_words"),
    )


def token_length_audit(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Distribution of tokens per row and the share over a limit; quantiles are exact."""
    counted = df.select(F.size(T.unicode_tokens(text)).alias("k"))
    base = counted.agg(
        F.count("*").alias("n"),
        F.min("k").cast("bigint").alias("min"),
        F.avg("k").alias("mean"),
        F.max("k").cast("bigint").alias("max"),
        count_where(F.col("k") > limit).alias("over"),
        (F.avg(F.when(F.col("k") > limit, 1.0).otherwise(0.0)) * 100).alias("percent_over"),
    )
    return base.crossJoin(F.broadcast(exact_quantiles(counted, [], "k", {"median": 0.5, "p95": 0.95})))


def rates_by_source(features: DataFrame, source: str, metrics: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Mean of each metric times 100, one row per metric and one column per source."""
    tall = features.select(
        source, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("m")
    ).select(source, "m.*")
    return tall.groupBy("metric").pivot(source, list(sources)).agg(F.avg("v") * 100)
