"""Secret redaction: an ordered chain of replacements, JVM-side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions import text as X

REDACTED = "[REDACTED_SECRET]"

#: class -> pattern, in the order of use; patterns are in the common part of Java's and RE2's syntax.
DEFAULT = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----",
    "url_credentials": r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@",
    "bearer": r"[Bb]earer [A-Za-z0-9._~+/=-]{16,}",
    "sk_ant": r"sk-ant-[A-Za-z0-9_-]{16,}",
    "sk": r"sk-[A-Za-z0-9_-]{20,}",
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github": r"(?:ghp_|gho_|github_pat_)[A-Za-z0-9_]{20,}",
    "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"(?:sk_live_|rk_live_)[A-Za-z0-9]{16,}",
    "google": r"AIza[A-Za-z0-9_-]{30,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assignment": r"(?i)(?:secret|token|password|passwd|api_key|private_key)[a-z0-9_.-]{0,40}[\"']? ?[=:] ?[\"']?[a-z0-9_/+.=-]{8,}[\"']?",
}
STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "private_ip": r"(?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}",
}
#: class -> texts of which a match holds one, whatever else it holds; a text with none of them is not searched.
NEEDS = {
    "pem": ["-----BEGIN "],
    "url_credentials": ["://"],
    "bearer": ["earer "],
    "sk_ant": ["sk-ant-"],
    "sk": ["sk-"],
    "aws": ["AKIA", "ASIA"],
    "github": ["ghp_", "gho_", "github_pat_"],
    "slack": ["xox"],
    "stripe": ["k_live_"],
    "google": ["AIza"],
    "jwt": ["eyJ"],
    "email": ["@"],
    "private_ip": ["10.", "192.168.", "172."],
}
#: The same for assignments: one of the signs, and one of the words in lower case (parts without an i, whose lower case is not the same everywhere).
SIGNS, WORDS = ["=", ":"], ["secret", "token", "passw", "_key"]
#: Strings of 32 characters and more are secrets, in strict mode, from this entropy a character on.
TOKEN, ENTROPY = r"[A-Za-z0-9_+/=-]{32,}", 3.5
#: The same strings, looked for at their first characters only: they are taken whole, so none begins inside another.
TOKEN_START = rf"(?<![A-Za-z0-9_+/=-]){TOKEN}+"
MODES = ("off", "default", "strict")


def classes(mode: str) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return [] if mode == "off" else [*DEFAULT, *((*STRICT, "high_entropy") if mode == "strict" else ())]


def entropy(token: Column) -> Column:
    """Bits a character of a string's own distribution of characters; 0 for the empty one."""
    chars = F.split(token, F.lit(""))
    n = F.length(token)
    share = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _has(text: Column, needs: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needs])


def _assigns(text: Column) -> Column:
    return _has(text, SIGNS) & X.let(F.lower(text), lambda low: _has(low, WORDS))


def _may_hold(text: Column, mode: str) -> Column:
    """Whether a text holds what any class needs; most short ones don't."""
    needs = _has(text, [n for name in classes(mode) for n in NEEDS.get(name, [])]) | _assigns(text)
    return (F.octet_length(text) >= 32) | needs if mode == "strict" else needs


def _long_words(text: Column) -> Column:
    """The words between spaces that have room for a string of 32 characters; no string has a space, so all stand in these, in the same order."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: F.octet_length(w) >= 32), " ")


def _without(text: Column, name: str) -> Column:
    """The text with the secrets of one class replaced."""
    if name == "high_entropy":
        found = F.filter(F.array_distinct(F.regexp_extract_all(_long_words(text), F.lit(TOKEN_START), F.lit(0))), lambda t: entropy(t) >= ENTROPY)
        return F.aggregate(found, text, lambda own, t: F.replace(own, t, F.lit(REDACTED)))
    may = _assigns(text) if name == "assignment" else _has(text, NEEDS[name])
    return F.when(may, F.regexp_replace(text, F.lit((DEFAULT | STRICT)[name]), F.lit(REDACTED))).otherwise(text)


def redact(text: Column, mode: str = "default") -> Column:
    """The text with its secrets replaced.  ``strict`` adds mail addresses, private addresses and long strings of high entropy; ``off`` changes nothing.

    The text of each step is made once, and searched for a class only if it holds what every secret of the class holds.
    """
    if not classes(mode):
        return text
    chain = lambda t: reduce(lambda own, name: X.let(own, lambda u: _without(u, name)), classes(mode), t)
    return X.let(text, lambda t: F.when(_may_hold(t, mode), chain(t)).otherwise(t))


def redactions(before: Column, after: Column) -> Column:
    """How many replacements ``after`` has that ``before`` didn't."""
    taken = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(REDACTED), F.lit("")))
    return ((X.let(after, taken) - X.let(before, taken)) / len(REDACTED)).cast("long")


def redact_sql(column: str, mode: str = "default") -> str:
    """The same chain for the SQL oracle."""
    for name in classes(mode):
        if name == "high_entropy":
            bits = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -((length(t) - length(replace(t, c, ''))) / length(t)) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"
            found = f"list_filter(list_distinct(regexp_extract_all({column}, '{TOKEN}')), lambda t: {bits} >= {ENTROPY})"
            column = f"list_reduce({found}, lambda own, t: replace(own, t, '{REDACTED}'), {column})"
        else:
            pattern = (DEFAULT | STRICT)[name]
            column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{REDACTED}', 'g')"
    return column
