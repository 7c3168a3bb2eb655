"""Rules: polarity, subject and domain, how two rules relate, what may be promoted, and what needs approval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# fixed values: markers, domains and thresholds
NEGATIVE = ("never", "dont", "don't", "do not", "avoid", "forbid", "forbidden", "ban", "banned", "must not", "cannot", "can't", "cấm", "không")
POSITIVE = ("allow", "allowed", "always", "must", "should", "prefer", "recommended", "nên", "luôn")
DOMAINS = {
    "tenant_code": ("tenant", "customer", "code", "rename", "onboarding", "finance", "signoff"),
    "migration": ("migration", "schema", "destructive", "rollback", "dba", "business", "hours", "recovery"),
    "security_override": ("mfa", "incident", "ticket", "expiry", "rollback", "bypass", "security", "human"),
    "git_hotfix": ("git", "push", "branch", "hotfix", "audit", "approval", "production", "force"),
}
CONDITIONS = ("only", "if", "when", "during", "with", "approval", "approved", "audit", "logging", "hotfix", "exception", "runbook")
UNCONDITIONAL = ("except", "unless", "approval", "audit", "hotfix")
SENSITIVE = ("force push", "git push -f", "auth", "authentication", "security", "credential", "secret", "migration", "payment", "production", "prod", "delete")
VAGUE = ("always prioritize", "prioritize system stability", "follow best practices", "be careful", "maintain quality", "ensure safety")
ACTIONS = ("never", "do not", "don't", "must", "require", "avoid", "pin", "check", "verify", "allow", "only", "use ", "git push -f", "hotfix", "dependency")
RISKY = ("git push -f", "force push", "hotfix", "production", "approval", "audit logging")
OPERATIONAL = ("UserPromptSubmit", "SessionStart", "SessionEnd", "PreCompact", "PostCompact", "PreToolUse", "PostToolUse", "PostToolUseFailure", "Notification", "Stop", "PermissionRequest")
SCOPES = ("core", "project", "agent", "user", "session", "organization")
SCOPE_WORDS = (("organization", ("organization", "company", "global")), ("session", ("session", "turn")), ("user", ("user", "personal")), ("agent", ("agent", "assistant")), ("project", ("team", "repo", "project", "workspace", "frontend", "deployment", "production")))
POLICY_WORDS = ("repo", "branch", "deployment", "production", "git", "policy")
TEXT_NEGATIVE, TEXT_POSITIVE = ("never", "do not", "don't", "must not", "avoid", "forbid"), ("allow", "always", "must", "should", "prefer")


def low(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def polarity(c: Column) -> Column:
    return F.when(T.any_of(low(c), NEGATIVE), "negative").when(T.any_of(low(c), POSITIVE), "positive").otherwise("neutral")


def core(c: Column) -> Column:
    """The words of a rule over two characters, without its markers."""
    out = low(c)
    for m in sorted({*NEGATIVE, *POSITIVE}, key=lambda m: (-len(m), m)):
        out = F.replace(out, F.lit(m), F.lit(" "))
    return F.array_sort(F.array_distinct(F.filter(F.split(out, r"\s+"), lambda w: F.length(w) > 2)))


def domains(words: Column) -> Column:
    """Domains of which a rule's core has two words."""
    return F.array_compact(F.array(*[F.when(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))) >= 2, name) for name, ws in DOMAINS.items()]))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def count_of(c: Column, markers: tuple[str, ...]) -> Column:
    return sum((low(c).contains(m).cast("int") for m in markers), F.lit(0))


def described(rules: DataFrame, text: str = "text") -> DataFrame:
    """Adds what relation() compares: polarity, core, domains, conditional, general."""
    c = F.col(text)
    rows = rules.withColumn("polarity", polarity(c)).withColumn("core", core(c)).withColumn("domains", domains(F.col("core")))
    return rows.withColumn("conditional", (F.col("polarity") == "positive") & (count_of(c, CONDITIONS) >= 2)).withColumn("general", (F.col("polarity") == "negative") & (count_of(c, UNCONDITIONAL) == 0))


def relation(a: str, b: str) -> Column:
    """governed_exception, contradiction or neutral, for two described rules of one scope in the struct columns a and b."""
    get = lambda s, f: F.col(f"{s}.{f}")
    shared = overlap(get(a, "core"), get(b, "core"))
    near = (shared >= 0.45) | F.arrays_overlap(get(a, "domains"), get(b, "domains"))
    excepts = (get(a, "conditional") & get(b, "general")) | (get(b, "conditional") & get(a, "general"))
    opposed = (get(a, "polarity") != "neutral") & (get(b, "polarity") != "neutral") & (get(a, "polarity") != get(b, "polarity"))
    full = (F.size(get(a, "core")) > 0) & (F.size(get(b, "core")) > 0)
    return F.when(get(a, "scope") != get(b, "scope"), "neutral").when(near & excepts, "governed_exception").when(opposed & full & (shared >= 0.6), "contradiction").otherwise("neutral")


def escalates(a: str, b: str) -> Column:
    """Whether a pair is worth a closer look: one scope, and neutral, of a shared domain, or little alike."""
    get = lambda s, f: F.col(f"{s}.{f}")
    return (get(a, "scope") == get(b, "scope")) & ((relation(a, b) == "neutral") | F.arrays_overlap(get(a, "domains"), get(b, "domains")) | (overlap(get(a, "core"), get(b, "core")) < 0.7))


def pair_key(a: str, b: str) -> Column:
    """The same for both orders of a pair."""
    side = lambda s: F.concat(F.col(f"{s}.scope"), F.lit("::"), low(F.col(f"{s}.text")))
    return F.array_join(F.array_sort(F.array(side(a), side(b))), "||")


def promotable(text: Column, scope: Column, confidence: Column, importance: Column) -> Column:
    """Whether a rule may be promoted: neither core nor vague, says what to do in four words or more, 18 to 220 characters, and is
    sure or important enough."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.size(F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9\-/]+)"), F.lit(1)))
    return F.length(t).between(18, 220) & (scope != "core") & ((confidence >= 0.60) | (importance >= 8)) & ~T.any_of(t, VAGUE) & T.any_of(t, ACTIONS) & (words >= 4)


def promotion_threshold(text: Column, scope: Column, importance: Column) -> Column:
    """How often a rule must be seen before it is stable."""
    return F.when(scope == "core", 999).when(T.any_of(text, RISKY), 3).when((importance >= 8) | scope.isin("project", "organization"), 2).otherwise(3)


def normal_scope(raw: Column, topic: Column, user_state: Column, workspace: Column, bound: Column) -> Column:
    """The scope a rule belongs to. bound: whether it came with a workspace, version or task."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    context = F.concat_ws(" ", s, *[F.lower(F.coalesce(x, F.lit(""))) for x in (workspace, topic, user_state)])
    out = F.when(T.any_of(context, POLICY_WORDS), "project").when(s.isin(*SCOPES), s)
    for name, words in SCOPE_WORDS:
        out = out.when(T.any_of(s, words), name)
    return out.when(bound, "project").otherwise("agent")


def needs_approval(text: Column, scope: Column, confidence: Column) -> Column:
    return (scope == "core") | (confidence >= 0.9) | T.any_of(text, SENSITIVE)


def operational(source: Column) -> Column:
    """Whether a source is a hook of the tool itself: the part behind its last colon."""
    return source.contains(":") & F.trim(F.element_at(F.split(source, ":"), -1)).isin(*OPERATIONAL)


def effort(raw_notes: Column, challenged: Column, length: Column, importance: Column) -> Column:
    pressure = (raw_notes > 20).cast("int") + (challenged > 0).cast("int") + (length > 4000).cast("int") + (importance >= 8).cast("int")
    return F.when(pressure >= 4, "xhigh").when(pressure >= 3, "high").when(pressure >= 2, "medium").otherwise("low")


def scope_bonus(scope: Column, preferred: Column, risk: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    return (F.when(s == preferred, 0.35).when(s == "core", 0.30).when((s == "project") & preferred.isin("project", "organization"), 0.20).when((s == "organization") & (risk == "high"), 0.20)
            .when(s == "adaptive", 0.05).otherwise(0.0))


def provenance(rows: Column, state: Column) -> Column:
    """What a source of the agent's own workspace, version and task adds; both are structs."""
    same = lambda f, v: F.when(state[f].isNotNull() & (rows[f] == state[f]), v).otherwise(0.0)
    return same("workspace", 0.2) + same("version", 0.15) + same("task", 0.1)


def text_classes(rows: DataFrame, key: str, scope: str, *more: str) -> DataFrame:
    """key, scope, more, neg, pos, w and class of the rows with a marker: texts of the same words and markers share a class."""
    w = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")))
    out = rows.select(key, scope, *more, T.any_of(F.col("text"), TEXT_NEGATIVE).alias("neg"), T.any_of(F.col("text"), TEXT_POSITIVE).alias("pos"), w.alias("w")).where("neg or pos")
    return out.withColumn("class", F.unhex(F.sha2(F.concat_ws(" ", F.col("neg").cast("string"), F.col("pos").cast("string"), "w").cast("binary"), 256)))


def opposed_classes(a: DataFrame, b: DataFrame, scope: str) -> DataFrame:
    """a, b: one row a scope and class. Pairs of a scope of which one forbids and the other allows, with three words in common; they
    meet through their words, not pairwise."""
    side = lambda rows, s: rows.select(scope, F.col("class").alias(f"{s}_class"), F.col("neg").alias(f"{s}_neg"), F.col("pos").alias(f"{s}_pos"), F.explode("w").alias("word"))
    met = side(a, "a").join(side(b, "b"), [scope, "word"]).where("(a_neg and b_pos) or (a_pos and b_neg)")
    return met.groupBy(scope, "a_class", "b_class").agg(F.count("*").alias("shared")).where("shared >= 3")


def text_conflicts(left: DataFrame, right: DataFrame, scope: str) -> DataFrame:
    """left: left_id, scope, text. right: right_id, scope, text. Pairs of a scope of which one forbids and the other allows, with
    three words in common. Rows without a marker are left out first; different texts meet through their words, once each however
    many rows have them. The pairs of rows go straight into the result: each pair of classes is dealt over a grid, rows by their left
    and columns by their right members, so that no class gathers in one task."""
    a, b = text_classes(left, "left_id", scope), text_classes(right, "right_id", scope)
    one = lambda rows: rows.groupBy(scope, "class").agg(*[F.first(c).alias(c) for c in ("neg", "pos", "w")])
    shares = max(4, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = lambda key: F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    pairs = opposed_classes(one(a), one(b), scope)
    mine = a.select("left_id", scope, F.col("class").alias("a_class")).join(pairs, [scope, "a_class"]).select("left_id", scope, "b_class", "shared", own("left_id").alias("row"), every.alias("column"))
    other = b.select("right_id", scope, F.col("class").alias("b_class"), every.alias("row"), own("right_id").alias("column"))
    return mine.join(other, [scope, "b_class", "row", "column"]).select(scope, "left_id", "right_id", "shared")


def kept_beliefs(beliefs: DataFrame, memories: DataFrame, scope: str) -> DataFrame:
    """beliefs: left_id, text, score; memories: right_id, text, score. Beliefs that no stronger memory contradicts. Of each class of
    equal texts only the strongest memory counts, so no pair of rows is made."""
    a = text_classes(beliefs.select("left_id", scope, "text"), "left_id", scope)
    b = text_classes(memories, "right_id", scope, "score").groupBy(scope, "class").agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in ("neg", "pos", "w")])
    pairs = opposed_classes(a.groupBy(scope, "class").agg(*[F.first(c).alias(c) for c in ("neg", "pos", "w")]), b, scope)
    strongest = pairs.join(b.select(scope, F.col("class").alias("b_class"), "score"), [scope, "b_class"]).groupBy(scope, "a_class").agg(F.max("score").alias("other"))
    met = a.select("left_id", scope, F.col("class").alias("a_class")).join(strongest, [scope, "a_class"]).select("left_id", "other")
    dropped = met.join(beliefs.select("left_id", F.col("score").alias("own")), "left_id").where("other > own").select("left_id").distinct()
    return beliefs.join(dropped, "left_id", "left_anti")


def governed_pairs(rules: DataFrame, by: str) -> DataFrame:
    """rules: id, by, scope, text. exception_id, rule_id of conditional permissions and the general prohibitions of their scope that they
    except: alike in half their words, or of one domain. Only rules of these two kinds go on, and they meet through a word or a
    domain, not pairwise."""
    rows = described(rules)
    keys = F.array_distinct(F.concat(F.transform("core", lambda w: F.concat(F.lit("w:"), w)), F.transform("domains", lambda d: F.concat(F.lit("d:"), d))))
    side = lambda which, name: rows.where(which).select(by, "scope", F.col("id").alias(name), F.size("core").alias(f"n_{name}"), F.explode(keys).alias("key"))
    met = side("conditional", "exception_id").join(side("general", "rule_id"), [by, "scope", "key"])
    g = met.groupBy(by, "exception_id", "rule_id").agg(F.count_if(F.col("key").startswith("w:")).alias("shared"), F.count_if(F.col("key").startswith("d:")).alias("domains"), F.min("n_exception_id").alias("a"), F.min("n_rule_id").alias("b"))
    return g.where((F.col("domains") > 0) | (F.col("shared") / F.greatest(F.lit(1), F.least("a", "b")) >= 0.45)).select(by, "exception_id", "rule_id")
