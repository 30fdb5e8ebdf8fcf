"""Tokenizers, lexicons and row-local token statistics as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, let, ratio

# ---- fixed values: these patterns and word lists decide the results ----
LETTER_TOKEN = r"[a-z]+"
WORD_OR_NUMBER = r"[A-Za-z']+|\d+"
UNICODE_WORD = r"[\p{L}\p{N}_']+"
# Listed characters are one table lookup to the matcher, ranges and categories a chain of calls: what is listed
# comes first and settles nearly every position.
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ASCII_WORD = _LOWER + _LOWER.upper() + "0123456789_"
_SPACE = r" \t\n\x0B\f\r"
FILLER_PATTERN = rf"(?=[uhema][uhemar])(?<![{_ASCII_WORD}])(?U)\b(?:u+m+|u+h+|h+m+|e+r+|a+h+|mm+)\b"
FALSE_START_PATTERN = rf"(?![{_ASCII_WORD} ][^-])(?U)\w-(?=\s|$)"
# Fillers are looked for in lower-cased texts, repeats in a text with a blank before it.  A word is read once, whether it is repeated or not.
REPEAT_PATTERN = rf"[^{_ASCII_WORD}](?U:\b)(?>([{_ASCII_WORD}]+(?U:\w*)|(?U:\w+)))(?iU)[,.]?+\s++\1\b"
IRREGULAR_SPACE = rf"[{_SPACE}](?:[{_SPACE}]+|(?<=[\t\n\x0B\f\r]))"
# Runs that begin with no word character and no blank, with the blanks inside and behind.
NO_WORD = rf"(?![{_LOWER}])[^\p{{L}}\p{{N}}_' \n][^\p{{L}}\p{{N}}_'\n]*"
NO_CONTENT = rf"[^{_LOWER}' ][^{_LOWER}']*"
NO_PUNCTUATION = (rf"[{_LOWER}{_LOWER.upper()}0123456789 ]+", r"\P{P}+")
SENTENCE_TEXT = r"[^.!?\s][^.!?]*"
FILLER_MARK = "\x01"
LOW_HALF = 0xFFFFFFFF
SENTENCE_BREAK = r"(?<=[.!?])\s+"
SEGMENT_FILLERS = ("um", "uh", "erm", "hmm")
SPOKEN_FILLERS = (("uh",), ("um",), ("hmm",), ("er",), ("ah",), ("you", "know"), ("i", "mean"))
VERY_SHORT_SENTENCE = 3
MAX_SENTENCE_WORDS = 40
# ------------------------------------------------------------------------


def letter_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(LETTER_TOKEN), F.lit(0))


def one_spaced(text: Column | str) -> Column:
    """The text with one blank for every run of whitespace, and none at its ends."""
    return F.trim(F.regexp_replace(col(text), IRREGULAR_SPACE, " "))


def punctuation(text: Column | str) -> Column:
    """Punctuation characters only."""
    letters, others = NO_PUNCTUATION
    return F.regexp_replace(F.regexp_replace(col(text), letters, ""), others, "")


def parts(text: Column | str) -> Column:
    """What stands between blanks, in any number of them."""
    return F.array_remove(F.split(col(text), " "), "")


def count_of(text: Column | str, character: str) -> Column:
    """Occurrences of one ASCII character."""
    return F.octet_length(col(text)) - F.octet_length(F.replace(col(text), F.lit(character), F.lit("")))


def count_pieces(joined: Column | str) -> Column:
    """Number of parts between single blanks."""
    return F.when(col(joined) == "", F.lit(0)).otherwise(count_of(joined, " ") + 1)


def marked_fillers(lowered: Column | str) -> Column:
    """A lower-cased text with a mark for every filler."""
    return F.regexp_replace(col(lowered), FILLER_PATTERN, FILLER_MARK)


def content_line(marked: Column | str) -> Column:
    """Words of a lower-cased text with blanks between."""
    return F.regexp_replace(col(marked), NO_CONTENT, " ")


def content_tokens(text: Column | str) -> Column:
    """Lower-cased words after filler removal."""
    return parts(content_line(marked_fillers(F.lower(col(text)))))


def word_tokens(text: Column | str) -> Column:
    """Lower-cased words and digit runs."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_OR_NUMBER), F.lit(0))


def unicode_tokens(text: Column | str) -> Column:
    """Case-kept words in any script: stands in for tagger tokens."""
    return F.regexp_extract_all(col(text), F.lit(UNICODE_WORD), F.lit(0))


def space_tokens(text: Column | str) -> Column:
    """Whitespace-separated pieces, none for a blank text."""
    return F.filter(F.split(col(text), r"\s+"), lambda t: t != "")


def sentence_spans(text: Column | str) -> Column:
    """Spans between sentence ends, before run-on chunking."""
    return F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), SENTENCE_BREAK)


def sentences(text: Column | str, max_words: int = MAX_SENTENCE_WORDS) -> Column:
    """Sentences; spans over ``max_words`` words are cut into chunks of that many."""

    def chunks(words: Column) -> Column:
        starts = F.when(
            F.size(words) > 0,
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(max_words)),
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(max_words)), " ")
        )

    return F.flatten(F.transform(sentence_spans(text), lambda span: let(space_tokens(span), chunks)))


def adjacent_repeats(tokens: Column) -> Column:
    """Positions whose token equals the one before."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: a == b,
    )
    return F.size(F.filter(pairs, lambda same: same))


def ngrams(tokens: Column, size: int) -> Column:
    """Consecutive runs of ``size`` tokens joined by a blank."""

    def grown(words: Column) -> Column:
        grams = words
        for n in range(2, size + 1):
            count = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), count), F.slice(words, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        return grams

    return let(tokens, grown)


def excess(items: Column) -> Column:
    """Occurrences beyond the first of each distinct item."""
    return F.size(items) - F.size(F.array_distinct(items))


def sentence_words(lowered: Column | str) -> Column:
    """Words of a lower-cased text without irregular whitespace, with a line feed between sentences."""
    lines = F.regexp_replace(col(lowered), "[.!?] ", "\n")
    return parts(F.replace(F.regexp_replace(lines, NO_WORD, " "), F.lit("\n"), F.lit(" \n ")))


def distinct_ngrams(line: Column | str, size: int) -> Column:
    """Number of distinct runs of ``size`` words of a line, compared as text.

    From each of the first ``size`` words on the line is cut into runs; a match
    starts at the beginning of a word only, so a long word is not read twice.
    """
    run = F.lit("(?<![^ ])[^ ]+" + " [^ ]+" * (size - 1))
    found, rest = None, col(line)
    for _ in range(size):
        runs = F.regexp_extract_all(rest, run, F.lit(0))
        found = runs if found is None else F.array_union(found, runs)
        rest = F.substr(rest, F.instr(rest, " ") + 1)
    return F.size(found)


def short_codes(items: Column | str) -> Column:
    """32-bit hashes of the items, as longs."""
    return F.transform(col(items), lambda x: F.xxhash64(x).bitwiseAND(F.lit(LOW_HALF)))


def followed(codes: Column | str, after: Column | str, step: int) -> Column:
    """Each code with the one ``step`` places on as its lower half."""
    count = F.greatest(F.size(after) - step, F.lit(0))
    return F.zip_with(
        F.slice(codes, F.lit(1), count), F.slice(after, F.lit(step + 1), count), lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)
    )


def same_halves(pairs: Column | str) -> Column:
    """Number of pairs of two equal codes."""
    return F.size(F.filter(col(pairs), lambda p: F.shiftrightunsigned(p, 32) == p.bitwiseAND(F.lit(LOW_HALF))))


def spoken_filler_pattern() -> str:
    """One alternation over the multi-word lexicon, longest match first in list order."""
    words = [" ".join(w) + " " for w in SPOKEN_FILLERS]
    first, second = ("".join(sorted({w[at] for w in words})) for at in (0, 1))
    return f" (?=[{first}][{second}])(?:" + "|".join(w[:-1] for w in words) + ")(?= )"


def spoken_fillers(joined: Column | str) -> Column:
    """Left-to-right, non-overlapping lexicon hits within each sentence.

    The words are joined with single blanks and padded, a line feed between
    sentences being a word, so a match consumes a leading blank and looks ahead
    to the next: whole tokens only, and never across sentences.
    """
    return F.regexp_count(F.concat(F.lit(" "), col(joined), F.lit(" ")), F.lit(spoken_filler_pattern()))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def array_mean(values: Column) -> Column:
    return ratio(array_sum(values), F.size(values))


def array_std(values: Column) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    squares = let(
        array_mean(values),
        lambda mean: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)),
    )
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(F.sqrt(ratio(squares, F.size(values))))


def array_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / F.lit(2.0)).cast("int")).cast("double")
    high = F.get(ordered, F.floor(n / F.lit(2.0)).cast("int")).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise((low + high) / 2)
