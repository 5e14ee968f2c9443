"""Text expressions: cleaning, sentences, keys, filters, labels.

Offsets and lengths are code points.  Java's regex needs ``(?U)`` for Unicode
classes; nothing here mixes ``regexp_instr`` (UTF-16 units) with them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space, and letters with digits and the underscore, inside a character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER = r"\p{L}\p{N}_"
#: Elements of a running sum that are summed together.
CHUNK = 512


def running(lengths: str) -> Column:
    """For a column of integer arrays, the sum of what stands before each element.

    Summed chunk by chunk, so that work does not grow with the square of an array.
    """
    return F.expr(f"""
      aggregate(
        transform(sequence(0, greatest(size({lengths}) - 1, 0) div {CHUNK}), c -> slice({lengths}, cast(c * {CHUNK} + 1 as int), {CHUNK})),
        named_struct('total', 0, 'sums', cast(array() as array<array<int>>)),
        (a, chunk) -> named_struct(
          'total', a.total + aggregate(chunk, 0, (n, x) -> n + x),
          'sums', array_append(a.sums, aggregate(chunk, named_struct('at', a.total, 'own', cast(array() as array<int>)),
            (b, x) -> named_struct('at', b.at + x, 'own', array_append(b.own, b.at)), b -> b.own))),
        a -> flatten(a.sums))""")


#: Titles and the like that end no sentence (fixed values).
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "St", "Rev", "Capt", "No", "vol", "p", "fig")
_BREAK = r"""(?<=[.!?])["')\]]?[\t-\r ]+(?=[A-Z"'(\[])"""
_STRICT = "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS) + _BREAK


def strip_markup(html: Column) -> Column:
    """Tags become a space, white space collapses, none stays before punctuation."""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    text = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.regexp_replace(text, r" ([,.;:!?)\]])", "$1")


def sentences(rows, keep: list[str], text: str = "text", strict: bool = False):
    """``keep``, ord, start, end, sentence of each sentence.

    Sentences part at white space after . ! ? (and perhaps a closing quote or
    bracket) before a capital, quote or bracket.  By default titles (Mr.) end
    sentences too, and a sentence ends one character behind its full stop, so
    that its closing quote, or else one white-space character, is part of it.
    ``strict`` does neither.  A null or empty text has no sentence.
    """
    pattern = _STRICT if strict else _BREAK
    cut = rows.select(*keep, F.split(text, pattern, -1).alias("__parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("__breaks"))
    sized = cut.withColumn("__sizes", F.expr("transform(__parts, (p, i) -> length(p) + coalesce(length(get(__breaks, i)), 0))"))
    tail = "''" if strict else "substring(coalesce(get(__breaks, i), ''), 1, 1)"
    whole = sized.withColumn("__starts", running("__sizes")).withColumn("__texts", F.expr(f"transform(__parts, (p, i) -> concat(p, {tail}))"))
    each = whole.select(*keep, F.posexplode(F.arrays_zip("__starts", "__texts")).alias("ord", "__x"))
    placed = each.select(*keep, "ord", F.col("__x.__starts").alias("start"), (F.col("__x.__starts") + F.length("__x.__texts")).alias("end"), F.col("__x.__texts").alias("sentence"))
    return placed.filter(F.length("sentence") > 0)


def dedupe_key(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def alpha_share(text: Column) -> Column:
    """Letters over all characters; null for an empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.try_divide(letters.cast("double"), F.length(text))


def passage_ok(text: Column, shortest: int = 45, longest: int = 420, letters: float = 0.6) -> Column:
    return F.length(F.trim(text)).between(shortest, longest) & (alpha_share(text) >= letters)


def passage_id(source: Column, start: Column, text: Column, prefix: str = "") -> Column:
    key = F.concat_ws(":", source, start.cast("string"), text)
    return F.concat(F.lit(prefix), F.substring(F.sha1(key.cast("binary")), 1, 10))


def year_in(text: Column) -> Column:
    """The least year 1600-1999 that stands alone in the text, null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\b(1[6-9][0-9][0-9])\b"), F.lit(1))
    return F.array_min(F.transform(found, lambda y: y.cast("int")))


def period_of(year: Column, bands: list[tuple[str, int, int]]) -> Column:
    out = F.lit("outside_range")
    for name, first, last in reversed(bands):
        out = F.when(year.between(first, last), F.lit(name)).otherwise(out)
    return F.when(year.isNull(), F.lit("unknown")).otherwise(out)


def harmonise(label: Column, inventory: list[str], mapping: dict[str, str]) -> Column:
    """A label of the inventory: itself, by the map, or by the map of its upper case; else null."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(label.isin(inventory), label).otherwise(F.coalesce(F.element_at(pairs, label), F.element_at(pairs, F.upper(label))))


def plural(term: Column) -> Column:
    """A naive English plural: -ies, -es or -s."""
    return (
        F.when(term.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(term, "y$", ""), F.lit("ies")))
        .when(term.rlike("(s|x|z|ch|sh)$"), F.concat(term, F.lit("es")))
        .otherwise(F.concat(term, F.lit("s")))
    )


@F.pandas_udf(StringType())
def normalised(text: pd.Series) -> pd.Series:
    """Long s, accents, curly quotes and dashes folded, white space collapsed, lower case.

    Compatibility decomposition has no built-in counterpart; plain ASCII skips it.
    """
    folds = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'} | {chr(c): "-" for c in range(0x2010, 0x2016)})

    def fold(s: str | None) -> str | None:
        if s is None:
            return None
        if not s.isascii():
            whole = unicodedata.normalize("NFKD", s.replace("ſ", "s"))
            s = "".join(c for c in whole if not unicodedata.combining(c)).translate(folds)
        return " ".join(s.split()).lower()

    return text.map(fold)


def unfenced(text: Column) -> Column:
    """A model's answer without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def miss_reason(quote: Column, passage: Column) -> Column:
    """Why a quote was not grounded, from the mildest cause to the worst."""
    bare = F.regexp_replace(quote, r"""^[ .,;:'"]+|[ .,;:'"]+$""", "")
    words = F.filter(F.split(quote, f"[{SPACE}]+"), lambda w: F.length(w) > 0)
    folded = F.contains(normalised(passage), normalised(quote))
    plain = F.contains(F.translate(passage, "ſ", "s"), F.translate(quote, "ſ", "s"))
    return (
        F.when(F.length(F.coalesce(quote, F.lit(""))) == 0, "empty")
        .when(F.contains(passage, quote), "present_but_exhausted")
        .when(folded & F.contains(passage, F.lit("ſ")) & plain, "long_s_normalised")
        .when(folded, "other_normalisation")
        .when((F.length(bare) > 0) & F.contains(passage, bare), "whitespace_or_punctuation")
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(passage, w)), "words_present_reordered_or_gapped")
        .otherwise("not_in_passage_at_all")
    )


#: Capitalised words that name nothing, landscape nouns, distances.
NOT_NAMES = ("The", "This", "That", "There", "These", "Those", "When", "What")
GEO_NOUNS = tuple(
    "road roads lake lakes hill hills fell fells river rivers valley vale bridge mountain mountains village town church inn path track shore coast "
    "wood woods camp ghetto station border street field fields stream beck".split()
)
DISTANCE = r"mile|miles|league|leagues|yards?|hours?\s+(?:walk|ride|journey)"


def is_positive(text: Column, nouns: tuple[str, ...] = GEO_NOUNS, stops: tuple[str, ...] = NOT_NAMES) -> Column:
    """A capitalised word that is no stop word, a landscape noun, or a distance; word ends are those of any script."""
    whole = lambda x: rf"(?<![{LETTER}])({x})(?![{LETTER}])"
    capitals = F.regexp_extract_all(text, F.lit(whole("[A-Z][a-z]{2,}")), F.lit(1))
    named = F.size(F.array_except(capitals, F.array(*[F.lit(x) for x in stops]).cast("array<string>"))) > 0
    return named | text.rlike("(?i)" + whole("|".join(nouns))) | text.rlike("(?i)" + whole(DISTANCE))


#: Endings of persons, and terms that are no landscape feature (fixed values).
PERSON = r"(keeper|wright|smith|monger|maker|ist|man|men)$"
DENIED = ("roofer", "broom", "cathouse", "second-floor", "plumber", "glazier", "joiner", "mason", "carpenter", "tiler")


def risky_term(term: Column, denied: tuple[str, ...] = DENIED) -> Column:
    """Why a term of a word list may match too much; null where it may not.  Only a single word can be a person."""
    return (
        F.when(F.length(term) <= 3, "short")
        .when(F.lower(term).isin(*denied), "denied")
        .when(F.lower(term).rlike(PERSON) & ~F.contains(term, F.lit(" ")), "person")
    )


def git_blob_id(text: Column) -> Column:
    """The id that git gives a file of this text."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def revision(*parts: Column) -> Column:
    """What identifies a served configuration: the parts that are there."""
    return F.concat_ws("; ", *parts)


def match_key(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """A field's value for comparison: white space collapsed, lower case, aliases put under one name; empty is null."""
    folded = F.nullif(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit(""))
    if not aliases:
        return folded
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(pairs, folded), folded)


def transient(error: Column, markers: list[str]) -> Column:
    """True where an error's text holds one of the markers of passing trouble."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.lower(error), F.lit(m.lower()))
    return F.coalesce(hit, F.lit(False))
