"""Standing instructions in human messages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as X
from sessionloom.operators.events import is_human

MAX_CHARS, MIN_WORDS, MAX_KEPT = 240, 3, 40

# Families of directives by how their clause begins.
DIRECTIVES = {
    "prohibition": ["never ", "never,", "never ever"],
    "negative directive": ["do not ", "don't ", "dont ", "you must not ", "you must never ", "we must not ", "you should not ", "you shouldn't ", "you should never ", "must not ", "i need you to never "],
    "standing directive": ["always ", "at all times", "every time you", "you should always ", "you must always ", "i need you to always "],
    "untouchable": ["don't touch", "do not touch", "leave the ", "leave it alone", "hands off", "don't change", "do not change", "don't modify", "do not modify", "don't rename", "do not rename"],
    "reminder": ["don't forget", "do not forget", "never forget", "keep in mind that", "bear in mind that"],
    "permission gate": ["ask before", "ask me before", "check with me", "without my permission", "without permission", "needs my approval"],
    "emphasis": ["critical:", "important:", "crucial:"],
    "exclusivity": ["only ever ", "only use ", "stick to "],
}
# Fillers before a directive, beginnings of questions, marks of harness noise.
LEADING = ["please", "also", "and", "but", "then", "so", "plus", "finally", "lastly", "importantly", "however", "just", "note", "ps", "p.s.", "one more thing"]
QUESTIONS = ["why ", "how ", "what ", "when ", "where ", "which ", "who ", "can you", "could you", "would you", "is it", "are we", "did you", "do you", "does "]
NOISE = ["<command-name>", "<command-message>", "<local-command", "system-reminder", "<system-reminder", "[request interrupted", "caveat: the messages below"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(X.quoted(w) for w in words) + ")"


def directive_head(lower: Column) -> Column:
    """The clause without fillers and ``from now on`` before it."""
    filler = rf"(?:{_any(LEADING)}(?![\p{{L}}\p{{N}}])[.,:; -]*\s*|from now on[.,: -]*\s*)"
    return F.regexp_replace(lower, F.lit(rf"^\s*{filler}*"), F.lit(""))


def _begins(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.startswith(text, F.lit(w)) for w in words])


def markers(text: Column) -> Column:
    """The families of a clean sentence; empty if it is no standing instruction."""

    def named(x: Column) -> Column:
        # the dear conditions come last: most sentences begin with no directive
        found = F.array_compact(F.array(*[F.when(_begins(x["head"], starts), F.lit(family)) for family, starts in DIRECTIVES.items()]))
        fine = (
            (F.length(text) <= MAX_CHARS)
            & ~_begins(x["low"], QUESTIONS)
            & ~reduce(or_, [F.contains(x["low"], F.lit(n)) for n in NOISE])
            & (F.size(F.split(F.trim(text), r"\s+")) >= MIN_WORDS)
            & ~F.regexp_like(x["low"], F.lit(r"[?:]\s*$"))
            & ~X.is_shouted(text)
        )
        return X.let(found, lambda f: F.when((F.size(f) > 0) & fine, f).otherwise(F.array().cast("array<string>")))

    return X.let(F.lower(text), lambda low: X.let(F.struct(low.alias("low"), directive_head(low).alias("head")), named))


def candidates(events: DataFrame, mode: str = "default") -> DataFrame:
    """session_key, evt, seq, text, markers, key of the sentences that are standing instructions."""
    own = events.where("is_active AND kind = 'user_message'").where(is_human())

    def one(sentence: Column, seq: Column) -> Column:
        return X.let(X.clean_sentence(sentence), lambda t: F.struct(seq.alias("seq"), t.alias("text"), markers(t).alias("markers"), X.normalize_words(t).alias("key")))

    # all inside one array: a filter behind it would have the texts redacted and split once more
    said = X.let(R.redact(F.col("text"), mode), X.sentences)
    return own.select("session_key", F.col("idx").alias("evt"), F.inline(F.filter(F.transform(said, one), lambda c: (F.size(c["markers"]) > 0) & (c["key"] != ""))))


def _keep(found: DataFrame) -> DataFrame:
    """A rule said again adds its markers if it has more; one inside a longer rule that was first said before it goes.

    Whether that longer rule is kept itself makes no difference: if it went, then for one that holds both.
    """
    at = F.struct("evt", "seq")
    per = found.groupBy("session_key", "key").agg(F.min(at).alias("at"), F.min_by("text", at).alias("text"), F.min_by("markers", F.struct(-F.size("markers"), "evt", "seq")).alias("markers"))
    earlier = per.select(F.col("session_key").alias("_session"), F.col("key").alias("_key"), F.col("at").alias("_at"))
    inside = F.col("session_key").eqNullSafe(F.col("_session")) & (F.length("_key") > F.length("key")) & (F.col("_at") < F.col("at")) & F.contains("_key", F.col("key"))
    return per.join(earlier, inside, "left_anti").select("session_key", "at.evt", "at.seq", "text", "markers", "key")


def constraints(events: DataFrame, vocabulary: DataFrame | None = None, mode: str = "default", most: int = MAX_KEPT) -> DataFrame:
    """session_key, evt, text, markers, scope, rank: a session's standing instructions, strongest and latest first; ``most`` is the report's length.

    ``vocabulary`` (session_key, name) gives the scope: the names that stand in the text as words; an empty scope is global.
    """
    kept = _keep(candidates(events, mode))
    w = Window.partitionBy("session_key").orderBy(F.desc(F.size("markers")), F.desc("evt"), "text")
    ranked = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    if vocabulary is None:
        return ranked.select("session_key", "evt", "text", "markers", F.array().cast("array<string>").alias("scope"), "rank")
    names = vocabulary.groupBy("session_key").agg(F.collect_set("name").alias("names"))
    low = F.lower("text")
    has = lambda n: F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(n), F.lit(r"\E(?![\p{L}\p{N}])")))
    scope = F.array_sort(F.filter(F.coalesce("names", F.array().cast("array<string>")), has))
    return ranked.join(names, "session_key", "left").select("session_key", "evt", "text", "markers", scope.alias("scope"), "rank")


def governing(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """The constraints of each chunk (session_key, chunk, subsystems): the global ones and those whose scope meets its subsystems."""
    both = chunks.join(found, "session_key")
    return both.where((F.size("scope") == 0) | F.arrays_overlap("scope", "subsystems")).select("session_key", "chunk", "evt", "text", "rank")


def note(found: DataFrame) -> DataFrame:
    """session_key, note: the constraints as one block of text."""
    line = F.concat(F.lit("- "), F.col("text"), F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")"))
    return found.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("note"))


def restored(found: DataFrame, items: DataFrame) -> DataFrame:
    """The constraints that no active item of a state (session_key, kind, status, text) holds, to be put back."""
    held = items.where("kind = 'constraint' AND status = 'active'").select("session_key", X.normalize_words(F.col("text")).alias("key"))
    return found.withColumn("key", X.normalize_words(F.col("text"))).join(held, ["session_key", "key"], "left_anti").drop("key")
