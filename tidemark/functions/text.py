"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L


def folded(c: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased Unicode words of at least two characters. Java's \\w is ASCII, so the classes are named."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: F.length(w) > 1)


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains any of the phrases, as substrings."""
    low, out = F.lower(c), F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def event_kind(c: Column) -> Column:
    """correct > conflict > supersede (the text starts so) > repeat (the text starts so) > assert."""
    low = F.lower(folded(c))
    starts = F.lit(False)
    for p in L.CHANGE_MARKERS:
        starts = starts | low.startswith(p)
    return (F.when(low.rlike(L.RETRACTION), "correct").when(any_of(low, L.ALTERNATIVE_SOURCE_MARKERS), "conflict")
            .when(starts, "supersede").when(low.rlike(L.RESTATEMENT), "repeat").otherwise("assert"))


def cheap_label(c: Column) -> tuple[Column, Column]:
    """(junk, importance): short greetings and thanks are junk; a digit raises the importance."""
    text = folded(c)
    bare = F.regexp_replace(F.lower(text), r"^[ .!?,:;]+|[ .!?,:;]+$", "")
    hit = F.lit(False)
    for m in L.JUNK_MARKERS:
        hit = hit | (bare == m) | bare.startswith(m + " ")
    junk = (F.length(bare) <= L.JUNK_LENGTH) & hit
    return junk, F.when(junk, 3).when(text.rlike(r"\d"), 7).otherwise(5)


def query_type(c: Column) -> Column:
    out = None
    for name, phrases in L.QUERY_TYPES:
        out = F.when(any_of(c, phrases), name) if out is None else out.when(any_of(c, phrases), name)
    return out.otherwise("factual")


def query_kind(c: Column) -> Column:
    """meta > self_history > temporal > content."""
    hit = lambda p: c.rlike("(?iU)" + p)
    return F.when(hit(L.META), "meta").when(hit(L.SELF_HISTORY), "self_history").when(hit(L.TEMPORAL), "temporal").otherwise("content")


def injected(c: Column) -> Column:
    out = F.lit(False)
    for p in L.INJECTION_PATTERNS:
        out = out | c.rlike("(?i)" + p)
    return out


def redacted(c: Column, extra: tuple[str, ...] = ()) -> Column:
    for p in (*L.SECRET_PATTERNS, *extra):
        c = F.regexp_replace(c, "(?i)" + p, "[REDACTED]")
    return c


def compacted(c: Column, most: int = 1800) -> Column:
    """Head and tail of texts over `most` characters, with a mark between them."""
    part = max(300, most // 3)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, part), F.lit("\n...[COMPACTED FOR MEMORY STABILITY]...\n"), F.right(c, F.lit(part)))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(c) + 3) / 4)).cast("bigint")


def without_first(c: Column, phrase: str) -> Column:
    """The text without the first place where the phrase stands."""
    return F.regexp_replace(c, "(?s)^(.*?)" + phrase, "$1")


def proposition(c: Column) -> Column:
    """What a sentence claims, in lower case, without the phrases that say how it relates to an earlier one: the restating
    beginning, all retractions, and of each change and hearsay marker, longest first, its first place."""
    out = F.regexp_replace(F.regexp_replace(F.lower(folded(c)), L.RESTATEMENT, ""), L.RETRACTION, "")
    for m in sorted((*L.CHANGE_MARKERS, *L.ALTERNATIVE_SOURCE_MARKERS), key=len, reverse=True):
        out = without_first(out, m)
    out = F.regexp_replace(F.regexp_replace(out, r"^[\s,;:.]+", ""), r"\s{2,}", " ")
    return F.regexp_replace(F.trim(out), r"[ .!?]+$", "")


def answer_normal(c: Column) -> Column:
    """Lower case without articles, punctuation and surplus spaces."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return folded(F.regexp_replace(bare, r"(^|\s)(a|an|the)(?=\s|$)", " "))


def fact_normal(c: Column) -> Column:
    """Diacritics dropped for Latin letters, everything else than ASCII letters and digits a space, 220 characters at most."""
    a, b = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçđ", "aaaaaaeeeeiiiiooooouuuuyyncd"
    return F.left(folded(F.regexp_replace(F.translate(F.lower(c), a, b), r"[^a-z0-9]+", " ")), F.lit(220))


def extractive_summary(parts: Column) -> Column:
    return F.left(F.array_join(F.transform(parts, lambda x: F.left(x, F.lit(140))), " · "), F.lit(900))


def chunks(c: Column, size: int) -> Column:
    """Fixed-width pieces of a text, in order; an empty text has none."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def content_hash(*parts: Column, width: int | None = None) -> Column:
    """sha256 of the parts joined by the unit separator, in hex, optionally its beginning."""
    h = F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    return F.left(h, F.lit(width)) if width else h
