"""What a question asks for: predicate, names, dates, existence, intent; and the operator that answers it."""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidemark.functions import lexicon as L
from tidemark.functions import text as T

# fixed values: phrases that name a predicate, and single words that name exactly one
ONTOLOGY = {
    "employer": ("làm ở đâu", "làm việc ở đâu", "công ty nào", "nơi làm việc", "nơi công tác", "đơn vị công tác", "đang làm cho", "làm cho ai", "đang làm tại", "làm việc tại", "đơn vị nào", "employer", "work at", "works at", "does .* work", "company"),
    "role": ("chức vụ", "giữ chức", "vị trí", "vai trò", "chức danh", "job title", "position", "role"),
    "location": ("sống ở đâu", "sống ở", "ở đâu", "địa chỉ", "thành phố", "nơi ở", "quê ở", "chuyển đến", "cư trú", "lives in", "address", "city"),
    "phone": ("số điện thoại", "điện thoại", "liên hệ", "số máy", "phone", "contact number"),
    "birthday": ("sinh ngày", "ngày sinh", "sinh nhật", "sinh năm", "năm sinh", "birthday", "date of birth", "born"),
    "project": ("dự án nào", "phụ trách dự án", "dự án", "đang phụ trách", "project"),
    "salary": ("lương", "mức lương", "thu nhập", "salary", "income", "pay"),
}
DISCRIMINATING = {"lương": "salary", "thu nhập": "salary", "sinh nhật": "birthday", "địa chỉ": "location", "chức vụ": "role", "salary": "salary", "birthday": "birthday", "work": "employer"}
# fixed values: first match decides
ROUTER = (("recall", ("hôm qua", "lần trước", "nhớ không", "đã nói", "bao giờ")), ("knowledge", ("giải thích", "là gì", "tại sao", "cách nào", "so sánh")), ("task", ("giúp", "làm", "tạo", "viết", "sửa", "deploy", "build")))
# fixed values: titles, words that name nothing, dates, and what tells a kind of time
TITLES = {"anh", "chị", "em", "ông", "bà", "cô", "chú", "bác", "mr", "mrs", "ms"}
STOP = {
    "vào", "ngày", "tháng", "năm", "hồi", "lúc", "khi", "thì", "là", "gì", "nào", "đâu", "ở", "của", "đang", "hiện", "tại", "bây", "giờ", "trước",
    "sau", "đã", "từng", "và", "có", "cho", "rằng", "sang", "rời", "một", "the", "was", "is", "did", "does", "what", "where", "which", "who",
    "in", "on", "at", "of", "do", "his", "her", "their",
}
ISO, DMY, MONTH = r"(\d{4})-(\d{2})-(\d{2})", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"(?i)tháng\s*(\d{1,2})\s*[/-]?\s*(\d{4})"
YEAR = r"\b((?:19|20)\d{2})\b"
HISTORY = r"(những lần nào|mấy lần|bao nhiêu lần|đã (từng )?(đổi|thay đổi|chuyển)|lịch sử|history of|how many times|list the changes)"
CURRENT = r"(hiện tại|bây giờ|hiện nay|đang|lúc này|currently|right now|now\b)"
HISTORICAL = r"(?i)(vào ngày|hồi|trước đây|lúc trước|trước khi|sau khi|đã từng|\bwas\b|\bused to\b)"
# fixed values: what each intent needs, and questions that an exact fact answers
PREFETCHED = {
    "deploy": ("policy", "procedure", "world_state", "exception"), "debug": ("procedure", "episode", "causal", "world_state"), "review": ("policy", "fact", "episode", "evidence"), "communicate": ("social", "identity", "policy", "fact"),
    "plan": ("prospective", "causal", "counterfactual", "world_state"), "operate": ("procedure", "policy", "world_state", "prospective"),
}
STARTERS, ENDERS = ("what ", "which ", "whats ", "what's ", "ky ", "ký ", "mat ", "mật ", "pass", "secret", "code", "password"), ("la gi?", "là gì?", "is what?", "is it?")
# fixed values: first match decides
PREFETCH = (("deploy", ("deploy", "release", "production", "triển khai")), ("debug", ("debug", "fix", "error", "sửa lỗi")), ("review", ("review", "audit", "soi", "đánh giá")), ("communicate", ("email", "reply", "customer", "khách")), ("plan", ("plan", "strategy", "kế hoạch", "what if")))

#: phrases of several words, the longest first; single words decide only through DISCRIMINATING
_PHRASES = sorted(((p, pred) for pred, ps in ONTOLOGY.items() for p in ps if " " in p), key=lambda x: (len(x[0]), x[1], x[0]), reverse=True)
#: all words of each predicate's phrases
VOCABULARY = {pred: sorted({w for p in ps for w in p.split()}) for pred, ps in ONTOLOGY.items()}


def first_of(c: Column, table: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    out = None
    for name, phrases in table:
        hit = T.any_of(c, phrases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def intent(c: Column) -> Column:
    return first_of(c, ROUTER, "casual")


def prefetch_intent(c: Column) -> Column:
    return first_of(c, PREFETCH, "operate")


def has(low: Column, phrase: str) -> Column:
    return low.rlike(phrase) if "." in phrase else low.contains(phrase)


def predicate(c: Column) -> tuple[Column, Column, Column]:
    """(predicate, confidence, method) of a question without its names and dates.

    The longest phrase found wins, less surely if phrases of another predicate are there too; then a word that names one
    predicate; then the predicate that shares most words, two at least, unless another shares as many. A common word alone
    decides nothing.
    """
    low = F.lower(T.folded(c))
    best = single = None
    for phrase, pred in _PHRASES:
        best = F.when(has(low, phrase), pred) if best is None else best.when(has(low, phrase), pred)
    some = lambda pred: [has(low, p) for p, other in _PHRASES if other == pred] or [F.lit(False)]
    rivals = sum((reduce(Column.__or__, some(pred)).cast("int") for pred in ONTOLOGY), F.lit(0))
    for word, pred in DISCRIMINATING.items():
        single = F.when(low.contains(word), pred) if single is None else single.when(low.contains(word), pred)
    words = F.array_except(F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))), lambda w: F.length(w) > 1), F.array(*[F.lit(w) for w in sorted(STOP)]))
    shared = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))).alias("n"), F.lit(pred).alias("p")) for pred, ws in VOCABULARY.items()])
    top = F.array_max(shared)
    alone = (top["n"] >= 2) & (F.size(F.filter(shared, lambda x: x["n"] == top["n"])) == 1)
    found = F.coalesce(best, single, F.when(alone, top["p"]), F.lit("unknown"))
    method = F.when(best.isNotNull(), "alias").when(single.isNotNull(), "discriminating").when(alone, "overlap").otherwise("none")
    return found, F.when(rivals == 1, 0.95).when(rivals > 1, 0.75).when(single.isNotNull(), 0.8).when(alone, 0.6).otherwise(0.0), method


_CLAUSE = frozenset(",;:.!?()[]\"'“”‘’…«»\n\r")
_KNOWN = frozenset(w for words in VOCABULARY.values() for w in words if w not in STOP and w.isalnum()) | {w for t in DISCRIMINATING for w in t.split()}
_COMMON = TITLES | STOP


def tidy(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def name_runs(text: str) -> list[str]:
    """Names in a tidy text: runs of capitalised words that are neither titles, nor stop words, nor words of the ontology.

    A clause's first word may be in lower case if a name follows directly. A run ends with its clause. A single capitalised
    word counts only where it doesn't open the text.
    """
    words = list(re.finditer(r"\w+", text))
    ends = [any(ch in _CLAUSE for ch in text[a.end() : b.start()]) for a, b in itertools.pairwise(words)] + [True]
    runs: list[tuple[int, list[str]]] = []
    grown = False  # whether the last run may still take a word in
    for i, match in enumerate(words):
        word, opens = match[0], i == 0 or ends[i - 1]
        low = word.lower()
        big = word[0].isupper() and low not in _COMMON and low not in _KNOWN
        if not big and opens and not ends[i] and not word[0].isupper() and len(word) > 1 and low not in _COMMON and low not in _KNOWN and not any(map(str.isdigit, word)):
            after = words[i + 1][0]
            big = after[0].isupper() and after.lower() not in _KNOWN
            opens = opens and not grown
        if big:
            if grown and not opens:
                runs[-1][1].append(word)
            else:
                runs.append((i, [word]))
        grown = big
    return [" ".join(run) for at, run in runs if len(run) > 1 or at > 0]


def longest_run(text: str, without: str | None = None) -> str | None:
    """The first longest run of capitalised words, across clauses, with words of another name left out."""
    skip = _COMMON | set((without or "").lower().split())
    best: list[str] = []
    run: list[str] = []
    for word in [*re.findall(r"\w+", text), ""]:
        if word[:1].isupper() and word.lower() not in skip:
            run.append(word)
        else:
            best, run = (run if len(run) > len(best) else best), []
    return " ".join(best) or None


def date_in(text: str) -> str | None:
    """The first date that a text states: ISO, then day/month/year, then month and year, then a year; as ISO."""
    if m := re.search(ISO, text):
        return "-".join(m.groups())
    if m := re.search(DMY, text):
        return f"{m[3]}-{int(m[2]):02d}-{int(m[1]):02d}"
    if m := re.search(MONTH, text):
        return f"{m[2]}-{int(m[1]):02d}-01"
    return f"{m[1]}-01-01" if (m := re.search(YEAR, text)) else None


#: what a question of existence asks about: the part behind one of these beginnings, without its closing particle
_ASKED = tuple(re.compile(p, re.IGNORECASE) for p in (r"\blà\s+(.+)$", r"\b(?:đã )?từng\s+(?:là|làm|ở|sống ở|giữ chức)\s+(.+)$", r"\bever\s+(?:been|had|worked at|lived in)\s+(.+)$"))
_CLOSING = re.compile(r"\s*(đúng không|phải không|hay chưa|không|chưa)?\s*[?.]?\s*$", re.IGNORECASE)
FRAME = ("subject", "anchor", "asked_date", "query_type", "temporal_kind", "belief", "value", "bare", "leftover")


def frame(text: str | None) -> tuple:
    """The parts of a question that a scan finds; see FRAME. bare is the text without names and dates, for predicate()."""
    whole = tidy(text)
    names = name_runs(whole)
    mark = re.search(L.BEFORE, whole, re.IGNORECASE) or re.search(L.AFTER, whole, re.IGNORECASE)
    anchor = next(iter(name_runs(whole[mark.end() :])), None) if mark else None
    subject = next((n for n in names if n != anchor), None)
    date = date_in(whole)
    dated = date if any(re.search(p, whole) for p in (ISO, DMY, MONTH)) else None
    kind = next((k for k, p in (("history", HISTORY), ("before", L.BEFORE), ("after", L.AFTER)) if re.search(p, whole, re.IGNORECASE)), None)
    kind = kind or ("point_in_time" if date else "current" if re.search(CURRENT, whole, re.IGNORECASE) else "point_in_time")
    value = next((_CLOSING.sub("", m[1]).strip() for p in _ASKED if (m := p.search(whole))), "")
    value = "" if subject and value.lower() == subject.lower() else value
    bare = whole
    for n in names:
        bare = bare.replace(n, " ")
    for p in (ISO, DMY, MONTH):
        bare = re.sub(p, " ", bare)
    drop = _COMMON | set(f"{subject or ''} {anchor or ''}".lower().split())
    leftover = " ".join(w for w in re.findall(r"\w+", whole.lower()) if w not in drop and not w.isdigit() and len(w) > 1)
    historical = dated is not None or re.search(HISTORICAL, whole) is not None
    return subject, anchor, date if kind in ("point_in_time", "current") else dated, "historical" if historical else "current", kind, re.search(L.BELIEF_MODE, whole, re.IGNORECASE) is not None, value, " ".join(bare.split()), leftover


@F.pandas_udf(Ty.StructType([Ty.StructField(c, Ty.BooleanType() if c == "belief" else Ty.StringType()) for c in FRAME]))
def frames(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([frame(t) for t in texts], columns=list(FRAME))


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def names(texts: pd.Series) -> pd.Series:
    """Names of each text: a scan with state, so it isn't a regular expression."""
    return texts.map(lambda t: name_runs(tidy(t)))


def framed(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds frame (struct), predicate, confidence, method, and operator: the one that answers, with the ones it falls back on.

    ever needs a subject, a predicate and a value; temporal a subject and a time or anchor; state a subject and a predicate;
    a class question needs neither; all else is recall. What a question lacks for its first operator is named in lacks.
    """
    rows = questions.withColumn("frame", frames(F.col(text)))
    found, sure, how = predicate(F.col("frame.bare"))
    rows = rows.withColumn("predicate", found).withColumn("confidence", sure).withColumn("method", how)
    subject, known, value = F.col("frame.subject").isNotNull(), F.col("predicate") != "unknown", F.col("frame.value") != ""
    at = lambda p: F.col(text).rlike("(?iU)" + p)
    timed = F.col("frame.asked_date").isNotNull() | F.col("frame.anchor").isNotNull() | (F.col("frame.temporal_kind") == "history")
    wants = (("ever", at(L.EVER), {"subject": subject, "predicate": known, "value": value}), ("temporal", at(L.TEMPORAL) | timed, {"subject": subject, "time": timed}), ("state", known, {"subject": subject}), ("class", at(L.SELF_HISTORY), {}))
    tried = F.array_compact(F.array(*[F.when(hit, name) for name, hit, _ in wants]))
    ready = F.array_compact(F.array(*[F.when(hit & reduce(Column.__and__, needs.values(), F.lit(True)), name) for name, hit, needs in wants]))
    first = None
    for name, hit, needs in wants:
        lack = F.array_compact(F.array(*[F.when(~c, n) for n, c in needs.items()])) if needs else F.array().cast("array<string>")
        first = F.when(hit, lack) if first is None else first.when(hit, lack)
    return rows.withColumn("operator", F.coalesce(F.try_element_at(ready, F.lit(1)), F.lit("recall"))).withColumn("tried", tried).withColumn("lacks", first.otherwise(F.array().cast("array<string>")))


def route(c: Column) -> Column:
    """ever > temporal > state (a predicate is recognised) > class > recall."""
    found, _, _ = predicate(c)
    return F.when(c.rlike("(?iU)" + L.EVER), "ever").when(c.rlike("(?iU)" + L.TEMPORAL), "temporal").when(found != "unknown", "state").when(c.rlike("(?iU)" + L.SELF_HISTORY), "class").otherwise("recall")


def prefetch(action: Column) -> tuple[Column, Column, Column]:
    """(intent, memory types, query) of a proposed action: what to fetch before it is asked for."""
    intent_ = prefetch_intent(action)
    types = F.create_map(*[x for k, ts in PREFETCHED.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])[intent_]
    return intent_, types, F.concat(action, F.lit(". Relevant "), F.array_join(types, " "))


def answered_directly(question: Column, kind: Column) -> Column:
    """Whether an exact fact may be given as the whole answer."""
    low, hit = F.lower(F.trim(question)), F.lit(False)
    for s in STARTERS:
        hit = hit | low.startswith(s)
    for s in ENDERS:
        hit = hit | low.endswith(s)
    return kind.isNotNull() & hit


def retrieval_state(mode: Column, stress: Column, risk: Column) -> Column:
    """What a request says about how to retrieve, its defaults filled in."""
    m, s, r = F.coalesce(mode, F.lit("implement")), F.coalesce(stress, F.lit("normal")), F.coalesce(risk, F.lit("medium"))
    return F.struct(m.alias("mode"), s.alias("stress"), r.alias("risk"), (m.isin("debug", "deploy") | (s == "failure") | (r == "high")).alias("prefer_exception"), F.when(r == "high", "organization").otherwise("project").alias("preferred_scope"))


def allowed_workspaces(explicit: Column, own: Column) -> Column:
    """The workspaces a request may read: the ones it names, else its own, else null for all. An empty list allows none."""
    return F.when(explicit.isNotNull(), F.array_sort(F.array_distinct(explicit))).when(F.coalesce(own, F.lit("")) != "", F.array(own))
