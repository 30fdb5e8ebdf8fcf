"""Text features on documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions import ordinal as O
from rubrica.functions import tokens as T
from rubrica.functions.numeric import hash_int
from rubrica.operators import annotation as N
from rubrica.operators import text as X

from rubrica.sources.tables import spread

from .base import SCORED, query, scored, sql_hash

W = r"\p{L}\p{N}_"
FILLER_WORDS = "(?:u+m+|u+h+|h+m+|e+r+|a+h+|mm+)"


def sql_without_fillers(text: str) -> str:
    once = lambda t: rf"regexp_replace({t}, '(^|[^{W}]){FILLER_WORDS}([^{W}]|$)', '\1 \2', 'g')"
    return once(once(f"lower({text})"))


def sql_content(text: str) -> str:
    return rf"regexp_extract_all({sql_without_fillers(text)}, '[a-z'']+')"


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[a-z'']+|\d+')"


def sql_spans(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(trim(regexp_replace({text}, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(
    "tokenize_words",
    rf"""SELECT doc_id, CAST(len(a) AS INTEGER) AS letters, md5(array_to_string(a, ' ')) AS letters_hash, CAST(len(b) AS INTEGER) AS content, md5(array_to_string(b, ' ')) AS content_hash,
      CAST(len(c) AS INTEGER) AS words, md5(array_to_string(c, ' ')) AS words_hash FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a, {sql_content('text')} AS b, {sql_words('text')} AS c FROM documents)""",
)
def _(t):
    rows = t.documents.select(
        "doc_id", T.letter_tokens("text").alias("a"), T.content_tokens("text").alias("b"), T.word_tokens("text").alias("c")
    )
    out = ["doc_id"]
    for c, name in (("a", "letters"), ("b", "content"), ("c", "words")):
        out += [F.size(c).alias(name), F.md5(F.array_join(c, " ")).alias(f"{name}_hash")]
    return rows.select(*out)


SENTENCES = rf"""SELECT doc_id, span_pos, CAST(c AS INTEGER) AS chunk, array_to_string(list_slice(w, c * 40 + 1, c * 40 + 40), ' ') AS sentence
  FROM (SELECT doc_id, span_pos, w, unnest(range(0, (len(w) + 39) // 40)) AS c
    FROM (SELECT doc_id, generate_subscripts(s, 1) AS span_pos, list_filter(string_split(unnest(s), ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {sql_spans('text')} AS s FROM documents)))"""


@query(
    "split_sentences",
    f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY span_pos, chunk) - 1 AS INTEGER) AS pos, sentence FROM ({SENTENCES})",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


BASE = rf"""base AS (SELECT doc_id, text, n_chars / 15e0 AS duration, list_transform({sql_spans('text')}, lambda s: regexp_extract_all(lower(s), '[{W}'']+')) AS sents FROM documents),
  docs AS (SELECT *, flatten(sents) AS words, list_transform(sents, lambda s: len(s)) AS lens FROM base)"""

SURFACE_SQL = rf"""SELECT doc_id, CAST(len(words) AS DOUBLE) AS word_count, CAST(len(list_distinct(words)) AS DOUBLE) AS unique_word_count, coalesce(len(list_distinct(words)) / nullif(len(words), 0), 0) AS type_token_ratio,
   coalesce(len(list_distinct(words)) / nullif(sqrt(len(words)), 0), 0) AS root_type_token_ratio, CAST(len(lens) AS DOUBLE) AS sentence_count, CAST(coalesce(list_avg(lens), 0) AS DOUBLE) AS mean_sentence_length,
   CAST(coalesce(list_median(lens), 0) AS DOUBLE) AS median_sentence_length, CAST(coalesce(list_stddev_pop(lens), 0) AS DOUBLE) AS std_sentence_length, CAST(coalesce(list_min(lens), 0) AS DOUBLE) AS min_sentence_length,
   CAST(coalesce(list_max(lens), 0) AS DOUBLE) AS max_sentence_length, CAST(length(text) AS DOUBLE) AS character_count, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))) / nullif(len(words), 0), 0) AS DOUBLE) AS mean_word_length,
   CAST(p AS DOUBLE) AS punctuation_count, coalesce(100 * p / nullif(len(words), 0), 0) AS punctuation_per_100_words, CAST(length(text) - length(replace(text, '?', '')) AS DOUBLE) AS question_mark_count,
   CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) AS exclamation_mark_count, duration AS duration_seconds, coalesce(len(words) / nullif(duration, 0), 0) AS words_per_second, coalesce(60 * len(words) / nullif(duration, 0), 0) AS words_per_minute
  FROM (SELECT *, len(regexp_extract_all(text, '\p{{P}}')) AS p FROM docs)"""

SPOKEN_FILLER_SQL = "(?:uh|um|hmm|er|ah|you  know|i  mean)"
SPOKEN_SQL = rf"""SELECT doc_id, CAST(short AS DOUBLE) AS very_short_sentence_count, coalesce(short / nullif(len(sents), 0), 0) AS very_short_sentence_rate, CAST(adjacent AS DOUBLE) AS adjacent_repeated_word_count,
   coalesce(adjacent / nullif(greatest(len(words) - 1, 0), 0), 0) AS adjacent_repeated_word_rate, CAST(len(g2) - len(list_distinct(g2)) AS DOUBLE) AS repeated_bigram_count, coalesce((len(g2) - len(list_distinct(g2))) / nullif(len(g2), 0), 0) AS repeated_bigram_rate,
   CAST(len(g3) - len(list_distinct(g3)) AS DOUBLE) AS repeated_trigram_count, coalesce((len(g3) - len(list_distinct(g3))) / nullif(len(g3), 0), 0) AS repeated_trigram_rate,
   CAST(len(j) - len(list_distinct(j)) AS DOUBLE) AS repeated_sentence_count, coalesce((len(j) - len(list_distinct(j))) / nullif(len(j), 0), 0) AS repeated_sentence_rate,
   CAST(f AS DOUBLE) AS filler_count, coalesce(100 * f / nullif(len(words), 0), 0) AS fillers_per_100_words
  FROM (SELECT doc_id, sents, words, len(list_filter(lens, lambda k: k <= 3)) AS short, len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS adjacent,
     list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS g2, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS g3,
     list_transform(sents, lambda s: array_to_string(s, ' ')) AS j,
     coalesce(list_sum(list_transform(sents, lambda s: len(regexp_extract_all(' ' || array_to_string(s, '  ') || ' ', ' {SPOKEN_FILLER_SQL} ')))), 0) AS f FROM docs)"""


def timed(t):
    return spread(t.documents, "doc_id").select("doc_id", "text", "lang", (F.col("n_chars") / 15).alias("duration"))


@query("surface_features", f"WITH {BASE} {SURFACE_SQL}", " ".join(X.SURFACE))
def _(t):
    return X.surface_features(timed(t), ["doc_id"], "text", "duration")


@query("spoken_features", f"WITH {BASE} {SPOKEN_SQL}", " ".join(X.SPOKEN))
def _(t):
    return X.spoken_features(timed(t), ["doc_id"], "text")


def sql_disfluency(table: str, key: str, text: str) -> str:
    """Rates with verbatim = canonical = text; repeats counted as floor(run / 2)."""
    marked = rf"regexp_replace(regexp_replace(lower({text}), '([{W}])[,.]?\s+', '\1' || chr(1), 'g'), '[^{W}\x01]+', chr(2), 'g')"
    return rf"""SELECT x.*, coalesce(r.repeats, 0) / pieces AS disf_repeat_rate FROM (SELECT {key}, pieces, CAST(len(content) AS DOUBLE) AS disf_n_words,
       len(list_filter(regexp_extract_all(lower({text}), '[{W}]+'), lambda w: regexp_full_match(w, '{FILLER_WORDS}'))) / pieces AS disf_filler_rate,
       len(regexp_extract_all({text}, '[{W}]-(?:\s|$)')) / pieces AS disf_false_start_rate, len(list_distinct(content)) / greatest(len(content), 1) AS disf_type_token_ratio,
       CAST(coalesce(list_sum(list_transform(content, lambda w: length(w))), 0) / greatest(len(content), 1) AS DOUBLE) AS disf_mean_word_length,
       len(content) / greatest(len(list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda s: regexp_matches(s, '\S'))), 1) AS disf_mean_sentence_words
     FROM (SELECT *, {sql_content(text)} AS content, greatest(len(regexp_extract_all({text}, '\S+')), 1) AS pieces FROM {table})) x
     LEFT JOIN (SELECT {key}, sum(n // 2) AS repeats FROM (SELECT {key}, c, w, grp, count(*) AS n
       FROM (SELECT {key}, c, w, i - row_number() OVER (PARTITION BY {key}, c, w ORDER BY i) AS grp
         FROM (SELECT {key}, c, unnest(words) AS w, generate_subscripts(words, 1) AS i
           FROM (SELECT {key}, generate_subscripts(chunks, 1) AS c, string_split(unnest(chunks), chr(1)) AS words FROM (SELECT {key}, string_split({marked}, chr(2)) AS chunks FROM {table}))) WHERE w <> '')
       GROUP BY ALL) GROUP BY {key}) r USING ({key})"""


# Documents never show a false start, so every seventh text gets one planted.
PLANTED_DOCS = "(SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'I wen- I went, um ' || text ELSE text END AS text FROM documents)"


def planted_documents(t):
    return spread(t.documents, "doc_id").select(
        "doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("I wen- I went, um "), "text")).otherwise(F.col("text")).alias("text")
    )


@query("disfluency_rates", f"SELECT * EXCLUDE (pieces) FROM ({sql_disfluency(PLANTED_DOCS, 'doc_id', 'text')})", " ".join(X.DISFLUENCY))
def _(t):
    return X.disfluency_rates(planted_documents(t), ["doc_id"], "text", "text")


@query(
    "document_features",
    f"WITH {BASE} SELECT * EXCLUDE (pieces) FROM ({SURFACE_SQL}) JOIN ({SPOKEN_SQL}) USING (doc_id) JOIN ({sql_disfluency('documents', 'doc_id', 'text')}) USING (doc_id)",
    " ".join(X.SURFACE + X.SPOKEN + X.DISFLUENCY),
)
def _(t):
    return X.document_features(timed(t), ["doc_id"], "text", "duration")


@query(
    "disfluency_pivot",
    "WITH r AS (SELECT d.lang, f.* FROM (" + sql_disfluency(PLANTED_DOCS, "doc_id", "text") + ") f JOIN documents d USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"100 * avg({m}) FILTER (WHERE lang = '{lang}') AS {lang}" for lang in ("en", "fr", "de", "es")) + " FROM r"
        for m in ("disf_filler_rate", "disf_false_start_rate", "disf_repeat_rate")
    ),
    "en fr de es",
)
def _(t):
    rates = X.disfluency_rates(planted_documents(t), ["doc_id", "lang"], "text", "text")
    return X.rates_by_source(rates, "lang", ["disf_filler_rate", "disf_false_start_rate", "disf_repeat_rate"], ["en", "fr", "de", "es"])


TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text AS canonical, b.text AS verbatim FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def turns(t):
    c = t.conversations
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("verbatim"))
    return c.select("conv_id", "turn", F.col("text").alias("canonical")).join(after, ["conv_id", "turn"])


@query(
    "repair_rate",
    f"""WITH {TURNS}, words AS (SELECT conv_id, turn, unnest({sql_content('canonical')}) AS w, 1 AS c, 0 AS v FROM turns UNION ALL SELECT conv_id, turn, unnest({sql_content('verbatim')}), 0, 1 FROM turns),
      counted AS (SELECT conv_id, turn, w, sum(c) AS c, sum(v) AS v FROM words GROUP BY ALL)
      SELECT t.conv_id, t.turn, CAST(coalesce(sum(v), 0) AS BIGINT) AS n_words, CASE WHEN coalesce(sum(v), 0) > 0 THEN 1 - sum(least(c, v)) / sum(v) ELSE 0e0 END AS repair_rate
      FROM turns t LEFT JOIN counted USING (conv_id, turn) GROUP BY t.conv_id, t.turn""",
    "repair_rate",
)
def _(t):
    return X.repair_rates(turns(t), ["conv_id", "turn"], "canonical", "verbatim")


def sql_chunks(text: str) -> str:
    return rf"flatten(list_transform(list_transform({sql_spans(text)}, lambda s: list_filter(string_split(s, ' '), lambda x: x <> '')), lambda w: list_transform(range(0, (len(w) + 39) // 40), lambda c: array_to_string(list_slice(w, c * 40 + 1, c * 40 + 40), ' '))))"


PAIRED = rf"""{TURNS}, chunked AS (SELECT conv_id, turn, {sql_chunks('canonical')} AS a, {sql_chunks('verbatim')} AS b FROM turns),
 pairs AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, i <= least(len(a), len(b)) AS matched, {sql_words("coalesce(a[i], '')")} AS s, {sql_words("coalesce(b[i], '')")} AS g FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM chunked)),
 coded AS (SELECT *, list_distinct(s || g) AS d FROM pairs),
 measured AS (SELECT conv_id, turn, pos, matched, len(s) AS words, CAST(levenshtein(array_to_string(list_transform(s, lambda x: chr(CAST(list_position(d, x) AS INTEGER))), ''), array_to_string(list_transform(g, lambda x: chr(CAST(list_position(d, x) AS INTEGER))), '')) AS BIGINT) AS distance FROM coded)"""


@query("token_edit_distance", f"WITH {PAIRED} SELECT conv_id, turn, pos, distance FROM measured")
def _(t):
    return X.sentence_pairs(turns(t), ["conv_id", "turn"], "canonical", "verbatim").select("conv_id", "turn", "pos", "distance")


@query(
    "edit_features",
    f"""WITH {PAIRED} SELECT conv_id, turn, sum(distance) / greatest(sum(words), 1) AS gec_edit_rate, count(*) FILTER (WHERE distance > 0 OR NOT matched) / count(*) AS gec_changed_fraction, CAST(sum(words) AS BIGINT) AS gec_n_words FROM measured GROUP BY conv_id, turn""",
    "gec_edit_rate gec_changed_fraction",
)
def _(t):
    return X.edit_features(X.sentence_pairs(turns(t), ["conv_id", "turn"], "canonical", "verbatim"), ["conv_id", "turn"])


@query(
    "expected_score",
    f"""WITH {SCORED}, z AS (SELECT key, list_transform([1e0, 2e0, 3e0, 4e0, 5e0], lambda v: -(text - v) * (text - v)) AS l FROM scored), e AS (SELECT key, list_transform(l, lambda x: exp(x - list_max(l))) AS w FROM z),
      p AS (SELECT key, list_transform(w, lambda x: x / list_sum(w)) AS p FROM e), m AS (SELECT key, p, p[1] + 2 * p[2] + 3 * p[3] + 4 * p[4] + 5 * p[5] AS mean FROM p)
      SELECT key, mean, sqrt(p[1] * (1 - mean) * (1 - mean) + p[2] * (2 - mean) * (2 - mean) + p[3] * (3 - mean) * (3 - mean) + p[4] * (4 - mean) * (4 - mean) + p[5] * (5 - mean) * (5 - mean)) AS std FROM m""",
    "mean std",
)
def _(t):
    logits = F.transform(O.doubles(O.ANSWER_SCORES), lambda v: -(F.col("text") - v) * (F.col("text") - v))
    rows = scored(t).select("key", logits.alias("l"))
    return rows.select("key", O.answer_mean(F.col("l")).alias("mean"), O.answer_std(F.col("l")).alias("std"))


VALUES = "[" + ", ".join(f"{v}e0" for v in O.SCORE_VALUES) + "]"


@query(
    "ordinal_encode",
    f"WITH {SCORED} SELECT key, array_to_string(list_transform({VALUES}[1:9], lambda v: CASE WHEN label > v THEN '1' ELSE '0' END), '') AS targets FROM scored",
)
def _(t):
    return scored(t).select("key", F.array_join(F.transform(O.ordinal_targets("label"), lambda v: v.cast("string")), "").alias("targets"))


CUMULATIVE = f"SELECT key, CASE WHEN size = 11 THEN list_reverse(q) WHEN size = 12 THEN list_transform(q, lambda x: x + 0.5e0) ELSE q END AS q FROM (SELECT key, size, list_transform({VALUES}[1:9], lambda v: 1 / (1 + exp(v - text))) AS q FROM scored)"


@query(
    "ordinal_decode",
    f"""WITH {SCORED}, c AS ({CUMULATIVE}), ok AS (SELECT key, q, list_min(q) >= 0 AND list_max(q) <= 1 AND len(list_filter(range(1, 9), lambda i: q[i] < q[i + 1])) = 0 AS valid FROM c),
      p AS (SELECT key, valid, list_concat([1 - q[1]], list_transform(range(1, 9), lambda i: q[i] - q[i + 1]), [q[9]]) AS p FROM ok)
      SELECT key, valid, CASE WHEN valid THEN list_sum(list_transform(range(1, 11), lambda i: p[i] * {VALUES}[i])) END AS score, CASE WHEN valid THEN list_min(p) END AS min_probability FROM p""",
    "score min_probability",
)
def _(t):
    q = F.transform(O.doubles(O.SCORE_VALUES[:-1]), lambda v: 1 / (1 + F.exp(v - F.col("text"))))
    rows = scored(t).select("key", "size", q.alias("q")).select(
        "key",
        F.when(F.col("size") == 11, F.reverse("q")).when(F.col("size") == 12, F.transform("q", lambda x: x + 0.5)).otherwise(F.col("q")).alias("q"),
    )
    checked = rows.withColumn("valid", O.decreasing_within_unit(F.col("q"))).withColumn("p", O.class_probabilities(F.col("q")))
    return checked.select(
        "key",
        "valid",
        F.when(F.col("valid"), O.expectation(F.col("p"), O.SCORE_VALUES)).alias("score"),
        F.when(F.col("valid"), F.array_min("p")).alias("min_probability"),
    )


@query(
    "ordinal_loss",
    f"WITH {SCORED} SELECT fold, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS loss FROM (SELECT fold, text - v AS z, CASE WHEN label > v THEN 1e0 ELSE 0e0 END AS y FROM (SELECT *, unnest({VALUES}[1:9]) AS v FROM scored)) GROUP BY fold",
    "loss",
)
def _(t):
    pairs = F.arrays_zip(
        F.transform(O.doubles(O.SCORE_VALUES[:-1]), lambda v: F.col("text") - v).alias("z"), O.ordinal_targets("label").alias("y")
    )
    rows = scored(t).select("fold", F.explode(pairs).alias("p"))
    return rows.groupBy("fold").agg(F.avg(O.logistic_loss(F.col("p.z"), F.col("p.y").cast("double"))).alias("loss"))


@query(
    "token_length_audit",
    rf"""SELECT count(*) AS n, min(k) AS min, avg(k) AS mean, max(k) AS max, count(*) FILTER (WHERE k > 256) AS over, 100 * avg(CASE WHEN k > 256 THEN 1e0 ELSE 0e0 END) AS percent_over,
      quantile_cont(CAST(k AS DOUBLE), 0.5) AS median, quantile_cont(CAST(k AS DOUBLE), 0.95) AS p95 FROM (SELECT len(regexp_extract_all(text, '[{W}'']+')) AS k FROM documents)""",
    "mean percent_over median p95",
)
def _(t):
    return X.token_length_audit(t.documents, "text", 256)


# ---------------------------------------------------------------------------
# Annotated tokens: words and marks of every document, tagged by hash.
# ---------------------------------------------------------------------------
DEPS = ("nsubj", "nsubjpass", "csubj", "csubjpass", "dobj", "pobj", "ccomp", "xcomp", "advcl", "relcl", "conj", "det", "amod", "ROOT")
MORPHS = ("VerbForm=Fin|Tense=Past", "VerbForm=Fin|Tense=Pres", "VerbForm=Inf", "Number=Sing")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def annotated(t):
    sents = spread(t.documents, "doc_id").select("doc_id", F.posexplode(F.filter(T.sentence_spans("text"), lambda s: s != "")).alias("sent_id", "s"))
    toks = sents.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{N}_']+|[.!?,]"), F.lit(0))).alias("j", "text"))
    h = hash_int("text")
    mark = F.col("text").isin(".", "!", "?", ",")
    return toks.select(
        "doc_id",
        "sent_id",
        (F.col("sent_id").cast("bigint") * 1000000 + F.col("j")).alias("i"),
        (F.col("sent_id").cast("bigint") * 1000000 + F.floor(F.col("j") / 2)).alias("head_i"),
        "text",
        F.when(mark, "PUNCT").otherwise(pick(N.POS_TAGS, h)).alias("pos"),
        F.when(h % 3 == 0, "MD").otherwise("XX").alias("tag"),
        F.when(mark, "punct").otherwise(pick(DEPS, h + F.col("j"))).alias("dep"),
        pick(MORPHS, F.floor(h / 16)).alias("morph"),
        mark.alias("is_punct"),
        F.lit(False).alias("is_space"),
    )


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ANNOTATED = rf"""sents AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_id, unnest(s) AS s FROM (SELECT doc_id, {sql_spans('text')} AS s FROM documents)),
 toks AS (SELECT doc_id, sent_id, generate_subscripts(w, 1) - 1 AS j, unnest(w) AS text, unnest(list_transform(range(0, len(w)), lambda k: w[k // 2 + 1])) AS head_text FROM (SELECT doc_id, sent_id, regexp_extract_all(lower(s), '[{W}'']+|[.!?,]') AS w FROM sents)),
 hashed AS (SELECT *, {sql_hash('text')} AS h, text IN ('.', '!', '?', ',') AS is_punct FROM toks),
 tokens AS (SELECT doc_id, sent_id, sent_id * 1000000 + j AS i, sent_id * 1000000 + j // 2 AS head_i, j, text, is_punct, head_text IN ('.', '!', '?', ',') AS head_punct, CASE WHEN j = 0 THEN 0 ELSE CAST(floor(log2(j)) AS BIGINT) + 1 END AS depth, CASE WHEN is_punct THEN 'PUNCT' ELSE {sql_list(N.POS_TAGS)}[h % 14 + 1] END AS pos,
   CASE WHEN h % 3 = 0 THEN 'MD' ELSE 'XX' END AS tag, CASE WHEN is_punct THEN 'punct' ELSE {sql_list(DEPS)}[(h + j) % 14 + 1] END AS dep, {sql_list(MORPHS)}[(h // 16) % 4 + 1] AS morph FROM hashed)"""

POS_NAMES = [x for tag in N.POS_TAGS for x in (f"pos_{tag.lower()}_count", f"pos_{tag.lower()}_per_100_words")] + [
    "finite_verb_count", "finite_verbs_per_100_words", "past_verb_count", "present_verb_count", "modal_auxiliary_count", "modal_auxiliaries_per_100_words"]
WORD = "NOT is_punct"
FINITE = f"({WORD} AND pos IN ('VERB', 'AUX') AND contains(morph, 'VerbForm=Fin'))"


def sql_count(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE)"


def sql_per100(condition: str) -> str:
    return f"coalesce(100e0 * count(*) FILTER (WHERE {condition}) / nullif(count(*) FILTER (WHERE {WORD}), 0), 0)"


@query(
    "token_annotation_pos",
    f"WITH {ANNOTATED} SELECT doc_id, "
    + ", ".join(f"{sql_count(f'''{WORD} AND pos = '{tag}' ''')} AS pos_{tag.lower()}_count, {sql_per100(f'''{WORD} AND pos = '{tag}' ''')} AS pos_{tag.lower()}_per_100_words" for tag in N.POS_TAGS)
    + f""", {sql_count(FINITE)} AS finite_verb_count, {sql_per100(FINITE)} AS finite_verbs_per_100_words, {sql_count(f"{WORD} AND pos IN ('VERB', 'AUX') AND contains(morph, 'Tense=Past')")} AS past_verb_count,
      {sql_count(f"{WORD} AND pos IN ('VERB', 'AUX') AND contains(morph, 'Tense=Pres')")} AS present_verb_count, {sql_count(f"{WORD} AND pos = 'AUX' AND tag = 'MD'")} AS modal_auxiliary_count,
      {sql_per100(f"{WORD} AND pos = 'AUX' AND tag = 'MD'")} AS modal_auxiliaries_per_100_words FROM tokens GROUP BY doc_id""",
    " ".join(POS_NAMES),
)
def _(t):
    return N.pos_features(annotated(t))


SYNTAX_NAMES = ["mean_dependency_distance", "max_dependency_distance", "mean_dependency_tree_depth", "max_dependency_tree_depth"] + [
    x for d in N.DEPENDENCIES for x in (f"{d}_count", f"{d}_per_sentence")] + [
    "sentences_with_subject_count", "sentences_with_finite_verb_count", "sentences_with_subject_and_finite_verb_count",
    "sentences_with_subject_rate", "sentences_with_finite_verb_rate", "sentence_completeness_rate"]


def sql_in(labels) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


@query(
    "token_annotation_syntax",
    f"""WITH {ANNOTATED},
      per_sentence AS (SELECT doc_id, sent_id, sum(abs(i - head_i)) FILTER (WHERE {WORD} AND i <> head_i AND NOT head_punct) AS ds, count(*) FILTER (WHERE {WORD} AND i <> head_i AND NOT head_punct) AS dn, max(abs(i - head_i)) FILTER (WHERE {WORD} AND i <> head_i AND NOT head_punct) AS dx,
        sum(depth) FILTER (WHERE {WORD}) AS ps, count(*) FILTER (WHERE {WORD}) AS pn, max(depth) FILTER (WHERE {WORD}) AS px, bool_or({WORD} AND dep IN {sql_in(N.SUBJECTS)}) AS subject, bool_or({FINITE}) AS finite, """
    + ", ".join(f"count(*) FILTER (WHERE {WORD} AND dep IN {sql_in(labels)}) AS {name}" for name, labels in N.DEPENDENCIES.items())
    + """ FROM tokens GROUP BY doc_id, sent_id) SELECT doc_id, coalesce(sum(ds) / nullif(sum(dn), 0), 0) AS mean_dependency_distance, CAST(coalesce(max(dx), 0) AS DOUBLE) AS max_dependency_distance, coalesce(sum(ps) / nullif(sum(pn), 0), 0) AS mean_dependency_tree_depth, CAST(coalesce(max(px), 0) AS DOUBLE) AS max_dependency_tree_depth, """
    + ", ".join(f"CAST(sum({name}) AS DOUBLE) AS {name}_count, sum({name}) / count(*) AS {name}_per_sentence" for name in N.DEPENDENCIES)
    + """, CAST(count(*) FILTER (WHERE subject) AS DOUBLE) AS sentences_with_subject_count, CAST(count(*) FILTER (WHERE finite) AS DOUBLE) AS sentences_with_finite_verb_count, CAST(count(*) FILTER (WHERE subject AND finite) AS DOUBLE) AS sentences_with_subject_and_finite_verb_count,
      count(*) FILTER (WHERE subject) / count(*) AS sentences_with_subject_rate, count(*) FILTER (WHERE finite) / count(*) AS sentences_with_finite_verb_rate, count(*) FILTER (WHERE subject AND finite) / count(*) AS sentence_completeness_rate FROM per_sentence GROUP BY doc_id""",
    " ".join(SYNTAX_NAMES),
)
def _(t):
    return N.syntax_features(annotated(t))
