"""Exact facts: what a text or a question names, how far its source is believed, and what contested facts need."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words of a subject that can have an exact value; what an exact value never holds; words that aren't part of a name
CUES = ("character", "symbol", "icon", "emoji", "code", "password", "passphrase", "token", "id", "identifier", "name", "alias", "model", "branch", "workspace", "project", "tenant", "rule", "procedure", "version", "key", "secret", "mat", "ma", "ky", "tu", "inh", "danh", "ten", "quy", "tac", "phien", "ban")
PROSE = ("avoid", "because", "therefore", "duy tri", "tinh dong nhat", "giu a cac kenh", "tranh tinh trang", "quy trinh", "safety guard", "guardrail")
FILLERS = r"\b(?:the|we|chosen|choose|selected|select|current|last|cuoi|cuối|la|là|is|was)\b"
NEGATIONS = ("not", "no", "never", "isn't", "wasn't", "aren't", "don't", "doesn't", "không", "khong", "chẳng", "chang", "đừng", "dung")
CHARACTER, CODE = r"(?:special character|ky tu dac biet|ký tự đặc biệt)", r"(?:secret code|code word|passphrase|password|verification code|mat ma|mật mã)"
IS = r"(?:is|was|la|là|=)"
NAMED = r"\s+(?:for|of)\s+([^.!?\n:=]{2,90}?)"
#: statements: kind, pattern; the last group is the value, a group before it the subject
SUBJECT_FACTS = (("special_character", CHARACTER + NAMED + rf"\s+{IS}\s+([^.!?\n]{{1,120}})"), ("verification_code", CODE + NAMED + rf"\s+{IS}\s+([^.!?\n]{{1,120}})"))
VALUE_FACTS = (
    ("special_character", CHARACTER + r"[^:]{0,80}?(?:là|la|is)\s+(.+?)(?:[.!?\n]|$)"),
    ("verification_code", r"(?:ký tự mật mã|ky tu mat ma|mật mã|mat ma|secret code|code word|passphrase|password)[^:]{0,80}?(?:là|la|is)\s+(.+?)(?:[.!?\n]|$)"),
    ("special_character", r"(?:remember exactly|ghi nhớ chính xác|ghi nho chinh xac)\s*[:\-]\s*(.+?)(?:[.!?\n]|$)"),
)
_SUBJECT = r"([A-Za-zÀ-ỹ0-9 _/\-]{2,60}?)"
GENERIC_FACTS = (rf"(?:the\s+)?{_SUBJECT}\s+{IS}\s+([^.!?\n]{{1,120}})", rf"(?:remember|ghi nhớ)\s+(?:that\s+)?{_SUBJECT}\s+{IS}\s+([^.!?\n]{{1,120}})")
#: where a question names whose character or code it asks for
_END = rf"(?:\s+{IS}\s+|\??$|$)"
SUBJECTS = {k: (p + NAMED + _END, rf"([^.!?\n:=]{{2,90}}?)\s+{p}\s+{IS}\s+") for k, p in (("special_character", CHARACTER), ("verification_code", CODE))}
ANY_SUBJECT = r"(?:for|of)\s+([^.!?\n:=]{2,90}?)" + _END
CONFLICT_PENALTY = 0.35


def _unaccented() -> tuple[str, str]:
    """Letters that are an ASCII letter with marks, and that letter."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, min(0x1F00, sys.maxunicode)) if unicodedata.category(chr(i))[0] == "L"]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", a)[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _unaccented()


def plain(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else a space."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^a-zA-Z0-9]+", " ")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once."""
    return F.transform(F.array(value), then)[0]


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match without emphasis marks and outer punctuation; null where nothing is left."""
    got = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, "(?iu)" + pattern, n), r"[*`_]+", ""), r"\s+", " ")
    out = F.regexp_replace(got, r"^[ .,:;!?-]+|[ .,:;!?-]+$", "")
    return let(out, lambda x: F.when(x != "", x))


def key_of(subject: Column) -> Column:
    words = F.trim(F.regexp_replace(F.regexp_replace(plain(subject), FILLERS, " "), r"\s+", " "))
    return let(words, lambda w: F.when(w == "", "exact_fact").otherwise(F.replace(w, F.lit(" "), F.lit("_"))))


def qualified(kind: str, subject: Column) -> Column:
    """kind, or kind_for_subject where a subject is named."""
    key = key_of(F.coalesce(subject, F.lit("")))
    return let(key, lambda k: F.when(k == "exact_fact", kind).otherwise(F.concat(F.lit(f"{kind}_for_"), k)))


def has_cue(subject: Column) -> Column:
    words = F.split(plain(subject), " ")
    return (F.size(F.array_distinct(words)) <= 8) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in CUES]))


def plausible(value: Column, exact: bool) -> Column:
    """Whether a text can be an exact value: short, not prose, and for characters and codes six words without a list."""
    norm = plain(value)
    n = F.size(F.split(norm, " "))
    ok = (norm != "") & (F.length(value) <= 96) & (n <= 12)
    for p in PROSE:
        ok = ok & ~norm.contains(p)
    return ok & (n <= 6) & ~value.contains(",") & ~value.contains(":") if exact else ok


def extracted(c: Column) -> Column:
    """(kind, value) of the fact that a text states, or null: named characters and codes, then unnamed ones, then any subject
    with a cue word, then unnamed ones in plain letters. An implausible value goes on to the next pattern."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    found = lambda base, subject, value: F.struct(F.lit(base).alias("base"), subject.alias("subject"), value.alias("value"))
    steps = [found(kind, group(text, p, 1), group(text, p, 2)) for kind, p in SUBJECT_FACTS]
    steps += [found(kind, F.lit(None).cast("string"), group(text, p)) for kind, p in VALUE_FACTS]
    steps += [found(None, group(text, p, 1), group(text, p, 2)) for p in GENERIC_FACTS]

    def holds(x: Column, i: Column) -> Column:
        exact = i < len(SUBJECT_FACTS) + len(VALUE_FACTS)
        named = (i >= len(SUBJECT_FACTS)) & exact | x["subject"].isNotNull()
        return x["value"].isNotNull() & named & F.when(exact, plausible(x["value"], True)).otherwise(has_cue(x["subject"]) & plausible(x["value"], False))

    first = F.slice(F.filter(F.array(*[s.cast("struct<base string, subject string, value string>") for s in steps]), holds), 1, 1)
    key = lambda x: key_of(F.coalesce(x["subject"], F.lit("")))
    kind = lambda x: F.when(x["base"].isNull(), key(x)).when(key(x) == "exact_fact", x["base"]).otherwise(F.concat(x["base"], F.lit("_for_"), key(x)))
    return F.try_element_at(F.transform(first, lambda x: F.struct(kind(x).alias("kind"), x["value"].alias("value"))), F.lit(1))


def asked_kind(c: Column) -> Column:
    """Kind of exact fact that a question asks for, or null."""
    return let(F.struct(F.trim(F.regexp_replace(c, r"\s+", " ")).alias("text"), plain(c).alias("norm")), lambda x: _asked(x["text"], x["norm"]))


def _asked(text: Column, norm: Column) -> Column:
    def subject(kind: str) -> Column:
        return F.coalesce(*[group(text, p) for p in (*SUBJECTS[kind], ANY_SUBJECT)])

    character = norm.contains("special character") | norm.contains("ky tu dac biet") | (norm.contains("ky tu") & norm.contains("mat ma"))
    code = F.lit(False)
    for m in ("mat ma", "secret code", "code word", "passphrase", "password"):
        code = code | norm.contains(m)
    out = F.when(character, qualified("special_character", subject("special_character"))).when(code, qualified("verification_code", subject("verification_code")))
    for p in (r"what(?:\s+was|\s+is)?\s+(?:the\s+)?([^?]+)", r"(.+?)\s+la gi\b"):
        named = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(norm, p, 1), r"\b(?:we chose|we selected|current|last|cuoi cung)\b", " "), r"\s+", " "))
        out = out.when(norm.rlike(p) & has_cue(named), key_of(named))
    return out


def anchored(c: Column) -> Column:
    """(kind, subject, value) of a text's anchor fact, or null. Values are six words at most, no list, and no negation."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))

    def ok(value: Column) -> Column:
        low = F.lower(F.trim(value))
        negated = F.split(low, " ")[0].isin(*NEGATIONS) | low.startswith("no longer") | low.startswith("không phải") | low.startswith("khong phai")
        return (F.length(value) <= 96) & (F.size(F.split(value, " ")) <= 6) & ~value.contains(",") & ~value.contains(":") & low.rlike(r"[\p{L}\p{N}]") & ~negated

    found = lambda kind, subject, value: F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), value.alias("value"))
    steps = [found(kind, group(text, p, 1), group(text, p, 2)) for kind, p in SUBJECT_FACTS]
    steps += [found(kind, F.lit(None).cast("string"), group(text, p.replace("[^:]{0,80}?", "[^:]*?"))) for kind, p in VALUE_FACTS]
    whole = F.filter(F.array(*steps), lambda x, i: x["value"].isNotNull() & ((i >= len(SUBJECT_FACTS)) | x["subject"].isNotNull()) & ok(x["value"]))
    return F.try_element_at(whole, F.lit(1))


def source_role(source: Column, roles: Column) -> Column:
    """The first known role among those of the references, else by the name of the source."""
    known = F.filter(F.transform(roles, plain), lambda r: r.isin("user", "assistant", "system"))
    name = plain(source)
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.when(name.contains("user"), "user").when(name.contains("assistant") | name.contains("jarvis") | name.contains("bio"), "assistant").otherwise("system"))


def channels(names: Column) -> Column:
    found = F.array_distinct(F.filter(F.transform(names, plain), lambda c: c != ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("default")))


def authority(role: Column, verbatim: Column, anchor: Column, has_value: Column) -> Column:
    base = F.when(role == "user", 1.0).when(role == "assistant", 0.82).otherwise(0.65)
    return F.least(base + F.when(verbatim, 0.08).otherwise(0.0) + F.when(anchor, 0.06).otherwise(0.0) + F.when(has_value, 0.05).otherwise(0.0), F.lit(1.15))


def revalidation(facts: DataFrame, most: int = 3) -> DataFrame:
    """facts: scope, kind, value, score, authority. Of each fact with several values the strongest, and the question that settles it.

    Contested is a fact whose two best values are less than CONFLICT_PENALTY apart.
    """
    w = Window.partitionBy("scope", "kind").orderBy(F.desc("score"), "value")
    top = facts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    line = F.transform(F.array_sort(F.collect_list(F.struct("n", "value", "score", "authority"))), lambda x: x.dropFields("n"))
    packed = top.groupBy("scope", "kind").agg(line.alias("candidates"))
    contested = (F.size("candidates") > 1) & (F.col("candidates")[0]["score"] - F.col("candidates")[1]["score"] < CONFLICT_PENALTY)
    values = F.array_join(F.transform("candidates", lambda x: x["value"]), "; ")
    question = F.concat(F.lit("I have conflicting exact memories for "), F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(": "), values, F.lit(". Please confirm which value should remain canonical."))
    return packed.where(contested).select("scope", "kind", "candidates", question.alias("question"))


def settled(facts: DataFrame) -> DataFrame:
    """facts: kind, value, seq. mentions and state of each value after all mentions in order.

    A first value is active; a further one makes it and those not superseded conflicting; a conflicting value's third mention
    settles it and supersedes all others. Only a value's first and third mention matter, so a kind is folded over its values, not
    its mentions: in the order of third mentions, one settles if the value came after the last settlement.
    """
    nth = F.row_number().over(Window.partitionBy("kind", "value").orderBy("seq"))
    rows = facts.withColumn("nth", nth).withColumn("came_so_far", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    third = F.min(F.when((F.col("nth") == 3) & (F.col("came_so_far") > 1), F.col("seq")))
    per = rows.groupBy("kind", "value").agg(F.count("*").alias("mentions"), F.min("seq").alias("came"), third.alias("third"))
    line = F.array_sort(F.collect_list(F.when(F.col("third").isNotNull(), F.struct("third", "came"))))
    last = F.aggregate(line, F.lit(-1).cast("long"), lambda acc, x: F.when(x["came"] > acc, x["third"]).otherwise(acc))
    kinds = per.groupBy("kind").agg(last.alias("last"), F.count("*").alias("n"), F.max("came").alias("newest"))
    one = per.join(kinds, "kind")
    state = (F.when(F.col("n") == 1, "active").when(F.col("last") < 0, "conflicting").when(F.col("third") == F.col("last"), F.when(F.col("newest") > F.col("last"), "conflicting").otherwise("active"))
             .when(F.col("came") > F.col("last"), "conflicting").otherwise("superseded"))
    return one.select("kind", "value", "mentions", state.alias("state"))
