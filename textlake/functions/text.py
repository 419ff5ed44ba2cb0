"""Text functions over columns: cleaning, splitting, matching, excerpts, tokens, quotes, numerals.

All are built-in expressions, so they stay in generated code and can be pushed through joins and filters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts as a blank, and the numerals one to ten.
UNICODE_SPACES = "               　"
NUMERALS = "一二三四五六七八九"
# Quotation marks that open and close a quote.
OPENING, CLOSING = "“「『", "”」』"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside a lambda for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column) -> Column:
    """LF line ends, plain blanks, no BOM, single blanks, at most one empty line, nothing at either end."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.replace(F.translate(out, UNICODE_SPACES, " " * len(UNICODE_SPACES)), F.lit("﻿"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), "\n{3,}", "\n\n")
    return strip(out)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{3000}\x{00A0}]+", "")


def letters_and_digits(text: Column) -> Column:
    """For comparing: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def unify_marks(text: Column) -> Column:
    """White space dropped, typographic quotes and brackets made plain."""
    return F.translate(without_space(text), "“”「」『』‘’（）", "\"\"\"\"\"\"''()")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Array of trimmed, non-empty paragraphs, in order."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), _quoted(separator))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Array of sentences: a run up to and including its end marks or line end, trimmed, non-empty."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?。！？\n]+[.!?。！？]*)"), 1), strip), lambda s: s != "")


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


# --- matching ------------------------------------------------------------------------------------------------------


def overlapping_positions(text: Column, word: Column | str) -> Column:
    """0-based positions of all matches, overlapping ones too, without regard to case."""
    word = F.lower(F.lit(word) if isinstance(word, str) else word)
    none = F.array().cast("array<int>")

    def found(low: Column) -> Column:
        """Cut before each match; the lengths of the pieces, summed from the left, are the places: linear in the text."""
        cut = F.concat(F.lit("(?=\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))

        def places(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), none.alias("out"))
            step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
            starts = F.aggregate(parts, start, step)["out"]
            return F.when(low.startswith(word), starts).otherwise(F.slice(starts, 2, F.size(parts)))

        return F.when(low.contains(word), bind(F.split(low, cut), places)).otherwise(none)

    return bind(F.lower(text), found)


def positions(text: Column, word: str) -> Column:
    """0-based positions of matches that don't overlap, found from the left."""
    size = len(word)

    def ends(parts: Column) -> Column:
        """Lengths of the pieces before each match, summed from the left."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + size).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
        return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step)["out"]

    return F.when(text.contains(word), bind(F.split(text, _quoted(word)), ends)).otherwise(F.array().cast("array<int>"))


def count_literal(text: Column, word: Column | str) -> Column:
    """Number of matches that don't overlap."""
    word = F.lit(word) if isinstance(word, str) else word
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, F.floor(gone / F.length(word)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def excerpt(text: Column, start: Column, end: Column, before: int, after: int, mark: str = "…") -> Column:
    """text[start - before, end + after) with marks where it is cut."""
    a = F.greatest(start - before, F.lit(0))
    z = F.least(end + after, F.length(text))
    return F.concat(F.when(a > 0, F.lit(mark)).otherwise(""), F.substring(text, a + 1, z - a), F.when(z < F.length(text), F.lit(mark)).otherwise(""))


def relevance(hits: Column, length: Column) -> Column:
    return hits / F.pow(length, F.lit(0.3))


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def highlight(text: Column, words: Sequence[str]) -> Column:
    """Each word in <mark>, without regard to case, in text that is escaped already."""
    import re

    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(w) for w in words) + ")", "<mark>$1</mark>")


def strip_tags(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


# --- tokens --------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def char_ngrams(text: Column, n: int) -> Column:
    """All n-character strings of a text, in order."""

    def grams(t: Column) -> Column:
        last = F.length(t) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return bind(text, grams)


def word_ngrams(tokens: Column, n: int) -> Column:
    """All strings of n tokens in a row, in order."""

    def grams(t: Column) -> Column:
        last = F.size(t) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bind(tokens, grams)


def fts_tokens(text: Column) -> Column:
    """Bigrams of each run of Chinese characters, and words of letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: char_ngrams(r, 2)))
    return F.concat(pairs, F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens that the document has."""
    own = F.array_distinct(query)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, document)) / F.size(own)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """Chinese characters at 1.5 to a token, others at 4, rounded down."""
    chinese = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.floor(chinese / 1.5 + (F.length(text) - chinese) / 4.0).cast("bigint")


# --- quotes, numerals, tags ----------------------------------------------------------------------------------------


def quotes(text: Column) -> Column:
    """The insides, of 4 to 300 characters, of typographic quotes."""
    return F.regexp_extract_all(text, F.lit(f"[{OPENING}]([^{OPENING}{CLOSING}]{{4,300}})[{CLOSING}]"), 1)


def chinese_number(text: Column) -> Column:
    """1 to 99 written in Chinese or plain digits; null for anything else."""
    digits = F.try_to_number(F.when(text.rlike(r"^[0-9]{1,2}$"), text), F.lit("99")).cast("int")
    value = lambda c: F.when(c == "", F.lit(None)).otherwise(F.instr(F.lit(NUMERALS), c))
    one = f"[{NUMERALS}]"
    tens = F.regexp_extract(text, f"^({one}?)十({one}?)$", 1)
    units = F.regexp_extract(text, f"^({one}?)十({one}?)$", 2)
    return (
        F.when(digits.isNotNull(), digits)
        .when(text.rlike(f"^{one}$"), value(text))
        .when(text.rlike(f"^{one}?十{one}?$"), F.coalesce(F.nullif(value(tens), F.lit(0)), F.lit(1)) * 10 + F.coalesce(value(units), F.lit(0)))
        .cast("int")
    )


def verbatim(quote: Column, source: Column, prefix: int = 12, window: int = 15, step: int = 5) -> Column:
    """Whether a quote stands in a source: as it is, in letters and digits in any case (ß is SS), by its first `prefix` of
    these, or by any `window` of them at multiples of `step`."""

    def found(both: Column) -> Column:
        q, s = both["q"], both["s"]
        starts = F.sequence(F.lit(0), F.greatest(F.length(q) - window, F.lit(0)), F.lit(step))
        return (
            (F.length(q) > 0) & s.contains(q)
            | (F.length(q) >= prefix) & s.contains(F.substring(q, 1, prefix))
            | (F.length(q) >= window) & F.exists(starts, lambda i: s.contains(F.substring(q, i + 1, F.lit(window))))
        )

    both = F.struct(letters_and_digits(quote).alias("q"), letters_and_digits(source).alias("s"))
    whole = bind(both, lambda b: (F.length(b["q"]) > 0) & F.upper(b["s"]).contains(F.upper(b["q"])))
    return (F.length(quote) > 0) & source.contains(quote) | bind(both, found) | whole


def typed_statement(text: Column, types: Sequence[str], default: str) -> tuple[Column, Column]:
    """`Type: statement` as (type, statement)."""
    kind = F.regexp_extract(text, "^(" + "|".join(types) + r")\s*[:：]\s*", 1)
    rest = F.regexp_replace(text, "^(" + "|".join(types) + r")\s*[:：]\s*", "")
    return F.when(kind != "", kind).otherwise(F.lit(default)), rest


def first_match(text: Column, rules: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """The name of the first rule one of whose words the text contains."""
    out = None
    for name, keys in rules.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | text.contains(k)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def expand_repeats(text: Column) -> Column:
    """A character followed by a repetition mark is doubled, unless it is a numeral."""
    return F.regexp_replace(text, "([一-鿿&&[^一二三四五六七八九十百千万零七匕]])[七匕]", "$1$1")


def sample(text: Column, size: int = 1000) -> Column:
    """Head, middle and tail of a longer text."""
    third = size // 3
    middle = F.floor(F.length(text) / 2).cast("int") - third // 2
    cut = F.concat_ws("\n…\n", F.substring(text, 1, third), F.substring(text, middle + 1, F.lit(third)), F.substring(text, F.length(text) - third + 1, F.lit(third)))
    return F.when(F.length(text) <= size, text).otherwise(cut)
