"""Scalar functions on text, all JVM-side Column expressions.

Budgets are in UTF-8 bytes (``octet_length``), previews in characters (``length``).  Every function gives null for null text unless
its docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
BYTES_PER_TOKEN = 4

# Words of failing output, in their order.
ERROR_MARKERS = [
    "error[", "error:", "Error:", "ERROR", "Traceback", "panicked at", "FAILED", "FAIL ", "✕", "npm ERR!", "Exception", "error TS",
    "AssertionError", "SyntaxError", "TypeError",
]

# How providers open the fragments that they inject as user messages.
HARNESS_OPENERS = {
    "tree": ["Caveat: The messages below were generated"],
    "rollout": ["# AGENTS.md instructions", "## My request for Codex:", "# Files mentioned by the user:"],
    "journal": [],
}


def _or_lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(text: str) -> str:
    """A literal for a Java pattern."""
    return "".join(c if c.isalnum() or c in " _/" else f"\\{c}" if ord(c) < 128 else c for c in text)


def tokens(text: Column) -> Column:
    """Estimated tokens: bytes / 4, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def tokens_of_bytes(n: Column) -> Column:
    return F.ceil(n / BYTES_PER_TOKEN).cast("long")


def head_bytes(text: Column, n: Column | int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    b = F.substring(F.encode(text, "UTF-8"), F.lit(1), n)
    whole = F.try_validate_utf8(b.cast("string"))
    cut = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), n - k).cast("string")) for k in (1, 2, 3)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(whole, *cut, F.lit("")))


def tail_bytes(text: Column, n: Column | int) -> Column:
    """The longest suffix of whole characters within n bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.octet_length(text)
    cut = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), size - n + 1 + k, n).cast("string")) for k in (0, 1, 2, 3)]
    return F.when(size <= n, text).when(n <= 0, F.lit("")).otherwise(F.coalesce(*cut, F.lit("")))


def truncate_middle(text: Column, n: Column | int) -> Column:
    """Within n bytes the text; else its first and last n / 2 bytes around a marker with the tokens taken out."""
    n = F.lit(n) if isinstance(n, int) else n
    half = F.floor(n / 2).cast("int")

    def around(ends: Column) -> Column:
        gone = tokens_of_bytes(F.octet_length(text) - F.octet_length(ends["head"]) - F.octet_length(ends["tail"]))
        return F.concat(ends["head"], F.lit("…"), gone.cast("string"), F.lit(" tokens truncated…"), ends["tail"])

    ends = F.struct(head_bytes(text, half).alias("head"), tail_bytes(text, half).alias("tail"))
    return F.when(F.octet_length(text) <= n, text).otherwise(let(ends, around))


def truncate_tokens(text: Column, n: Column | int) -> Column:
    return truncate_middle(text, n * BYTES_PER_TOKEN)


def lines(text: Column) -> Column:
    """The lines of a text; a closing line break opens no further line."""
    return F.split(F.regexp_replace(text, F.lit("\r?\n$"), F.lit("")), "\r?\n")


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(lines(text)))


def placeholder(text: Column) -> Column:
    """``[empty]``, ``[preview]``, or lines, bytes and the first 80 characters of the first line."""
    preview = F.left(F.trim(F.regexp_extract(text, "^[^\r\n]*", 0)), F.lit(80))
    n = line_count(text)
    short = (n <= 1) & (F.octet_length(text) <= 80)
    full = F.concat(F.lit("["), n.cast("string"), F.lit(" lines, "), F.octet_length(text).cast("string"), F.lit(" bytes: "), preview, F.lit("…]"))
    return F.when(F.trim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" "))) == "", "[empty]").when(short, F.concat(F.lit("["), preview, F.lit("]"))).otherwise(full)


def head_and_tail(text: Column, max_tokens: int, keep: int = 20) -> Column:
    """All lines, or the first and last ``keep`` around the number left out, within the token budget."""
    each = lines(text)
    n = F.size(each)
    cut = F.concat(
        F.array_join(F.slice(each, 1, keep), "\n"), F.lit("\n… "), (n - 2 * keep).cast("string"), F.lit(" lines …\n"), F.array_join(F.slice(each, -keep, keep), "\n")
    )
    return let(F.when(n > 2 * keep, cut).otherwise(text), lambda t: truncate_tokens(t, max_tokens))


def collapse_blank_lines(text: Column) -> Column:
    """No spaces at line ends, one blank line at most in a row."""
    return F.regexp_replace(F.regexp_replace(text, F.lit("[ \t]+(\n|$)"), F.lit("$1")), F.lit("\n{3,}"), F.lit("\n\n"))


def short_id(call_id: Column) -> Column:
    return F.when(F.length(call_id) > 12, F.right(call_id, F.lit(8))).otherwise(call_id)


def normalize_command(command: Column) -> Column:
    """``cd X &&`` taken off the front as often as it stands there, values of leading variables masked, spaces single."""
    rest = F.regexp_replace(F.trim(command), F.lit(r"(?s)^(?:cd (?:(?!&&).)*&&\s*)+"), F.lit(""))

    def masked(words: Column) -> Column:
        # variables count as leading only until the first other word; a masked one is a word too
        first = F.get(words, F.lit(0))
        own = F.when(F.regexp_like(first, F.lit("^[A-Z_]+=")), F.concat(F.regexp_extract(first, "^[A-Z_]+=", 0), F.lit("***"))).otherwise(first)
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(own), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))), " "))

    return let(F.filter(F.split(F.trim(rest), r"\s+"), lambda w: w != ""), masked)


def categorize(command: Column) -> Column:
    """test, build, lint, git, package manager, run or other, by the leading words."""
    return category_of(normalize_command(command))


def category_of(normalized: Column) -> Column:
    """The same of a command that is normalized already."""
    leading = lambda words, k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    parts = lambda low: let(F.split(low, " "), lambda w: F.struct(low.alias("low"), leading(w, 0).alias("one"), leading(w, 1).alias("two")))
    return let(let(F.lower(normalized), parts), lambda x: _category(x["low"], x["one"], x["two"]))


def _category(low: Column, one: Column, two: Column) -> Column:
    # The leading words of each category.
    test = (
        (two.isin("test", "tests") & ~F.contains(low, F.lit("--no-run")))
        | one.isin("pytest", "vitest", "jest", "phpunit", "rspec")
        | ((one == "go") & (two == "test"))
        | ((one == "cargo") & (two == "nextest"))
        | F.contains(low, F.lit(" vitest "))
        | F.endswith(low, F.lit(" vitest"))
    )
    return (
        F.when(test, "test")
        .when(two.isin("build", "compile", "check") | one.isin("make", "tsc", "webpack", "vite", "cmake", "bazel"), "build")
        .when(two.isin("clippy", "lint", "fmt", "format") | one.isin("eslint", "ruff", "prettier", "black", "shellcheck", "biome"), "lint")
        .when(one == "git", "git")
        .when(one.isin("npm", "pnpm", "yarn", "bun", "cargo", "pip", "uv", "poetry", "brew"), "package_manager")
        .when(one.isin("node", "python", "python3", "deno", "ruby", "bash", "sh"), "run")
        .otherwise("other")
    )


def looks_like_error(output: Column) -> Column:
    return reduce(or_, [F.contains(output, F.lit(m)) for m in ERROR_MARKERS])


def exit_code_in_output(output: Column) -> Column:
    """The number after ``exit code:`` in the first three lines; null if none."""
    hits = F.transform(F.slice(lines(output), 1, 3), lambda line: F.regexp_extract(line, r"exit code:\s*(-?[0-9]+)[},)]*(?:\s|$)", 1))
    return F.when(F.contains(output, F.lit("exit code:")), F.get(F.filter(hits, lambda h: h != ""), F.lit(0)).try_cast("int"))


def error_snippet(output: Column) -> Column:
    """The first line that looks like an error and two more; null if there is none."""

    def first(each: Column) -> Column:
        at = F.array_position(F.transform(each, lambda line: looks_like_error(line)), True)
        return let(at, lambda k: let(F.array_join(F.slice(each, F.greatest(k, F.lit(1)).cast("int"), 3), "\n"), lambda s: F.when((k > 0) & (F.trim(s) != ""), s)))

    return let(lines(output), first)


TOKEN = r"[\p{IsAlphabetic}\p{N}/._:\\-]+"


def normalize_signature(snippet: Column) -> Column:
    """Hex strings, numbers, paths, UUIDs and durations by their kind; white space single."""
    parts = F.regexp_extract_all(snippet, F.lit(rf"{TOKEN}|\p{{IsWhite_Space}}+|."), F.lit(0))

    def kind(t: Column) -> Column:
        return (
            F.when(F.regexp_like(t, F.lit("^[0-9a-fA-F]{7,}$")), "<hex>")
            .when(F.regexp_like(t, F.lit("^[0-9]+$")), "<n>")
            .when(F.contains(t, F.lit("/")) & (F.length(t) > 1), "<path>")
            .when(F.regexp_like(t, F.lit("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]*){4}$")), "<uuid>")
            .when(F.regexp_like(t, F.lit("^[0-9.]+[A-Za-z]+$")), "<dur>")
            .when(F.regexp_like(t, F.lit(r"^\p{IsWhite_Space}")), " ")
            .otherwise(t)
        )

    return F.trim(F.array_join(F.transform(parts, kind), ""))


def signature_id(snippet: Column) -> Column:
    """12 hexadecimal digits that stand for an error whatever its paths, numbers and times."""
    return F.left(F.sha2(normalize_signature(snippet).cast("binary"), 256), F.lit(12))


def normalize_words(text: Column) -> Column:
    """Lower-case alphanumeric words, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(text), F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def normalize_answer(text: Column) -> Column:
    """As ``normalize_words``, with ``/ . - _`` kept."""
    return F.trim(F.regexp_replace(F.lower(text), F.lit(r"[^\p{L}\p{N}/._-]+"), F.lit(" ")))


def normalize_quote(text: Column) -> Column:
    """Words without punctuation at their edges, lower case, single-spaced."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, F.lit(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"), F.lit(""))))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def sentences(text: Column) -> Column:
    """The sentences outside fenced code, line by line: an end is ! or ? or a full stop that follows no digit, before white space or the line's end."""
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        fence = F.regexp_like(line, F.lit(r"^\s*```"))
        keep = ~fence & ~s["fenced"]
        return F.struct((s["fenced"] != fence).alias("fenced"), F.when(keep, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"))

    kept = F.when(F.contains(text, F.lit("```")), F.aggregate(lines(text), start, step, lambda s: s["out"])).otherwise(lines(text))
    split = F.transform(kept, lambda line: F.split(F.regexp_replace(line, F.lit(r"([!?]|(?<![0-9])\.)(?:\s+|$)"), F.lit(f"$1{MARK}")), MARK))
    return F.filter(F.flatten(split), lambda s: F.trim(s) != "")


def clean_sentence(sentence: Column) -> Column:
    """Without Markdown emphasis, list marks and numbers, closing full stops; white space single."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(sentence, F.lit("[*`_]"), F.lit(""))), F.lit("^[-#> ]+"), F.lit(""))
    bare = F.regexp_replace(F.trim(bare), F.lit(r"^[0-9]{1,3}[.)]\s*"), F.lit(""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, F.lit(r"\s+"), F.lit(" "))), F.lit("[. ]+$"), F.lit("")))


def is_shouted(text: Column) -> Column:
    """At least four words of two letters and more, none with a lower-case letter."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(F.regexp_replace(w, F.lit(r"[^\p{L}]"), F.lit(""))) >= 2)
    return (F.size(words) >= 4) & F.forall(words, lambda w: ~F.regexp_like(w, F.lit(r"\p{Ll}")))


def is_harness_fragment(text: Column, provider: str | None = None) -> Column:
    """Whether a user message is injected context: an opener of the provider (of any, if none is given), or a tag at its start that is closed further on."""
    t = F.regexp_replace(text, F.lit(r"(?U)^\s+"), F.lit(""))
    openers = [o for p, own in HARNESS_OPENERS.items() if provider in (None, p) for o in own]
    opener = F.regexp_like(t, F.lit("(?i)^(?:" + "|".join(map(quoted, openers)) + ")")) if openers else F.lit(False)
    name = F.regexp_extract(t, "^<([A-Za-z0-9_-]+)[> \n]", 1)
    return opener | ((name != "") & F.contains(t, F.concat(F.lit("</"), name, F.lit(">"))))


def one_line(text: Column, max_tokens: int) -> Column:
    """White space single, cut at an earlier truncation marker, within the token budget."""
    flat = F.trim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" ")))
    return truncate_tokens(F.trim(F.regexp_replace(flat, F.lit("…[0-9]+ tokens truncated….*$"), F.lit("…"))), max_tokens)


def fence_for(text: Column) -> Column:
    """A fence longer than any run of back-ticks in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def headline(text: Column, n: int = 20) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def distinctive(text: Column, least: int = 8) -> Column:
    """The most telling token: a path with a suffix, then a path, then an identifier, then a word; among them the longest; null below ``least`` characters."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) >= least)

    def rank(w: Column) -> Column:
        path, dot = F.contains(w, F.lit("/")), F.contains(w, F.lit("."))
        return F.when(path & dot, 0).when(path, 1).when(F.regexp_like(w, F.lit("[_0-9]|[a-z][A-Z]")), 2).otherwise(3)

    ranked = F.array_sort(F.transform(words, lambda w: F.struct(rank(w).alias("r"), (-F.length(w)).alias("n"), w.alias("w"))))
    return F.get(ranked, F.lit(0))["w"]


def parse_range(text: Column) -> Column:
    """``A..B`` (B excluded), ``A..=B``, ``A`` or ``A..`` as (start, end), both included; a reversed or unreadable one is null."""
    pattern = r"^\s*([0-9]+)\s*(?:(\.\.=?)\s*([0-9]*))?\s*$"
    a, dots, b = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    start = a.try_cast("int")
    end = F.when(dots == "", start).when(b == "", F.lit((1 << 31) - 1)).when(dots == "..=", b.try_cast("int")).otherwise(b.try_cast("int") - 1)
    return F.when((a != "") & (start <= end), F.struct(start.alias("start"), end.alias("end")))
