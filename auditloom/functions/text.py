"""Text columns: words, sentences, readability, n-grams, fingerprints. All run on the JVM over whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words that are no keywords ------------------------------------------------------------------------------
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "cannot could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these "
    "they this those through to too under until up very was we were what when where which while who whom why with would you "
    "your yours yourself yourselves click read learn view page home"
).split()
# ----------------------------------------------------------------------------------------------------------------------------
_ENTITY = r"(?<![A-Za-z0-9_])[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){1,2}(?![A-Za-z0-9_])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once. Repeated in a lambda it would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fields(text: Column) -> Column:
    """Parts between white space; none for null and blank texts."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"(?U)\s+"))


def clean_text(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nd}]+"))


def byte_count(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def sentence_count(text: Column) -> Column:
    """Full stops, exclamation and question marks, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]")))


def syllable_count(text: Column) -> Column:
    """Vowel groups of every part between white space, without a closing silent e, 1 at least for each part."""

    def one(part: Column) -> Column:
        groups = F.regexp_count(F.regexp_replace(part, r"[^\p{L}]", ""), F.lit("[aeiouy]+"))
        return F.greatest(F.lit(1), groups - F.when(part.endswith("e") & (groups > 1), 1).otherwise(0))

    return F.aggregate(fields(F.lower(text)), F.lit(0), lambda total, part: total + one(part))


def reading_ease(text: Column, words: Column) -> Column:
    """Flesch reading ease within 0 and 100; 100 without words."""
    n = words.cast("double")
    score = F.lit(206.835) - F.lit(1.015) * (n / sentence_count(text)) - F.lit(84.6) * (syllable_count(text) / n)
    return F.when(words == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def sampled_fingerprint(text: Column) -> Column:
    """MD5 of about thirty words taken at even steps."""

    def joined(parts: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.size(parts) / 30).cast("int"))
        taken = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), step)
        return F.when(F.size(parts) > 0, F.array_join(F.transform(taken, lambda k: F.get(parts, k)), " ")).otherwise(F.lit(""))

    return F.md5(let(fields(F.lower(text)), joined))


def keyword_tokens(text: Column) -> Column:
    """Lower-case parts without marks, of two bytes or more, that are no stop words."""
    plain = F.transform(fields(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{Nd}]", "")))
    return F.filter(plain, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def ngrams(tokens: Column) -> Column:
    """All terms of one to three neighbouring tokens: single ones of three bytes or more, pairs of two different ones."""

    def every(words: Column) -> Column:
        ones = F.filter(words, lambda w: F.octet_length(w) >= 3)
        second, third = F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.slice(words, 3, F.greatest(F.size(words), F.lit(1)))
        pairs = F.zip_with(words, second, lambda a, b: F.when(a != b, F.concat_ws(" ", a, b)))
        triples = F.zip_with(F.zip_with(words, second, lambda a, b: F.concat(a, F.lit(" "), b)), third, lambda ab, c: F.concat(ab, F.lit(" "), c))
        return F.concat(ones, F.array_compact(pairs), F.array_compact(triples))

    return let(tokens, every)


def named_entities(text: Column) -> Column:
    """Distinct runs of two or three capitalised words, of more than four bytes, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ENTITY), F.lit(0))
    return F.filter(F.array_distinct(found), lambda e: F.octet_length(e) > 4)


def shortened(text: Column, longest: int) -> Column:
    """At most `longest` characters, the last three of them dots where something is left out."""
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest - 3)), F.lit("..."))).otherwise(text)


def utc_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy HH:mm 'UTC'")
