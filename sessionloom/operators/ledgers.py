"""Ledgers of a session: files, commands, errors, plan, git and messages, as sibling tables of one event scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as X
from sessionloom.operators.events import COMMAND_KEYS, PATH_KEYS, is_human
from sessionloom.operators.joins import pair_once
from sessionloom.operators.masking import failed

HEAD, TAIL, EXAMPLE, MESSAGE = 400, 800, 300, 1500
_OPS = "array<struct<path:string,op:string,moved_to:string,inferred:boolean>>"


def _may_name(args: Column, *names: str) -> Column:
    """Whether a JSON text may hold one of the names: it stands there, or some character is written by its number."""
    return reduce(or_, [F.contains(args, F.lit(n)) for n in (*names, "\\u")])


def _first_key(args: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.when(_may_name(args, k), X.let(F.get_json_object(args, f"$.{k}"), lambda v: F.when(v != "", v))) for k in keys])


def command_of(args: Column) -> Column:
    """The command in a call's arguments: a string, or an argument list joined by spaces; a bare string is the command."""
    found = _first_key(args, COMMAND_KEYS)

    def of_list(f: Column) -> Column:
        listed = F.array_join(F.from_json(f, "array<string>"), " ")
        return F.when(F.startswith(f, F.lit("[")) & (listed != ""), listed).otherwise(f)

    bare = F.from_json(F.concat(F.lit('{"x":'), args, F.lit("}")), "x string")["x"]
    return F.coalesce(X.let(found, of_list), F.when(F.startswith(args, F.lit('"')), bare))


def path_of(args: Column) -> Column:
    return _first_key(args, PATH_KEYS)


def _op(path: Column, op: Column | str, inferred: bool, moved: Column | None = None) -> Column:
    return F.struct(path.alias("path"), (F.lit(op) if isinstance(op, str) else op).alias("op"), (F.lit(None).cast("string") if moved is None else moved).alias("moved_to"), F.lit(inferred).alias("inferred"))


def patch_ops(args: Column) -> Column:
    """The operations in a patch envelope's header lines."""
    bare = F.from_json(F.concat(F.lit('{"x":'), args, F.lit("}")), "x string")["x"]
    patch = F.coalesce(F.get_json_object(args, "$.input"), F.get_json_object(args, "$.patch"), F.when(F.startswith(args, F.lit('"')), bare), F.lit(""))
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* ((?:Add|Update|Delete) File|Move to): *(.*?) *$"), F.lit(0))
    kind = lambda h: F.regexp_extract(h, r"^\*\*\* (Add|Update|Delete|Move)", 1)
    path = lambda h: F.regexp_extract(h, ": *(.*?) *$", 1)

    def one(h: Column, i: Column) -> Column:
        after = F.get(heads, i + 1)
        moves = F.coalesce((kind(h) == "Update") & (kind(after) == "Move"), F.lit(False))
        op = F.when(moves, "move").when(kind(h) == "Add", "create").when(kind(h) == "Delete", "delete").otherwise("edit")
        return _op(F.when(kind(h) != "Move", path(h)), op, False, F.when(moves, path(after)))

    return F.when(_may_name(args, "*** "), F.filter(F.transform(heads, one), lambda o: o["path"].isNotNull())).otherwise(F.array().cast(_OPS))


def shell_ops(command: Column) -> Column:
    """File operations that a command line suggests: rm, mv, cp, touch (also under git), and redirections to a name with a dot."""
    none = F.array().cast(_OPS)
    bare = lambda w: F.regexp_replace(w, F.lit("^[\"']+|[\"']+$"), F.lit(""))

    def named(verb: Column, paths: Column) -> Column:
        last = F.get(paths, F.size(paths) - 1)
        moved = F.concat(F.when(F.size(paths) > 0, F.array(_op(F.get(paths, F.lit(0)), "move", True))).otherwise(none), F.when(F.size(paths) > 1, F.array(_op(last, "create", True))).otherwise(none))
        made = F.when(F.size(paths) > 0, F.array(_op(last, "create", True))).otherwise(none)
        return F.when(verb == "rm", F.transform(paths, lambda p: _op(p, "delete", True))).when(verb == "mv", moved).otherwise(made)

    def by_verb(words: Column) -> Column:
        at = F.when(F.get(words, F.lit(0)) == "git", 2).otherwise(1)
        rest = F.slice(words, at + 1, F.greatest(F.size(words), F.lit(1)))
        paths = F.filter(F.transform(F.filter(rest, lambda w: ~F.startswith(w, F.lit("-"))), bare), lambda w: w != "")
        verb = F.get(words, at - 1)
        return F.when(verb.isin("rm", "mv", "cp", "touch"), X.let(paths, lambda p: named(verb, p))).otherwise(none)

    def redirected(target: Column) -> Column:
        into = (target != "") & ~F.startswith(target, F.lit("&")) & F.contains(target, F.lit("."))
        return F.when(into, F.array(_op(bare(target), "create", True))).otherwise(none)

    def one(part: Column) -> Column:
        words = F.filter(F.split(F.trim(part), r"\s+"), lambda w: w != "")
        target = F.when(F.contains(part, F.lit(">")), F.regexp_extract(F.get(F.split(part, ">"), F.lit(1)), r"^\s*(\S+)", 1)).otherwise("")
        return F.concat(X.let(words, by_verb), X.let(target, redirected))

    # a line without any of these suggests nothing
    may = reduce(or_, [F.contains(command, F.lit(w)) for w in (">", "rm", "mv", "cp", "touch")])
    return F.when(may, F.flatten(F.transform(F.split(command, r";|\n|&&"), one))).when(command.isNotNull(), none)


def active(events: DataFrame) -> DataFrame:
    return events.where("is_active")


def file_ops(events: DataFrame) -> DataFrame:
    """session_key, evt, seq, path, op, moved_to, inferred.  A patched file counts as an edit and as what the patch does to it."""
    args, none = F.col("args"), F.array().cast(_OPS)
    listed = F.from_json(F.when(_may_name(args, "edits"), F.get_json_object(args, "$.edits")), "array<map<string,string>>")
    own = F.array_compact(F.concat(F.array(path_of(args)), F.coalesce(F.transform(listed, lambda m: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in PATH_KEYS])), F.array().cast("array<string>"))))
    edits = X.let(patch_ops(args), lambda patched: F.concat(F.transform(F.array_sort(F.array_distinct(F.concat(own, F.transform(patched, lambda o: o["path"])))), lambda p: _op(p, "edit", False)), patched))
    call, cls = F.col("kind") == "tool_call", F.col("tool_class")
    ops = (
        F.when(call & (cls == "edit"), edits)
        .when(call & (cls == "read"), F.transform(F.array_compact(F.array(path_of(args))), lambda p: _op(p, "read", False)))
        .when(call & (cls == "shell"), X.let(command_of(args), shell_ops))
        .when(F.col("kind") == "shell_execution", shell_ops(F.col("command")))
        .otherwise(none)
    )
    # results, most of a transcript, suggest nothing
    each = active(events).where(F.col("kind").isin("tool_call", "shell_execution")).select("session_key", F.col("idx").alias("evt"), F.posexplode(ops).alias("seq", "o"))
    return each.select("session_key", "evt", "seq", "o.*").where("path <> ''")


def files(events: DataFrame) -> DataFrame:
    """session_key, path, ops, created, deleted, moved_to, edits, reads, first_evt, last_evt, inferred."""
    at = F.struct("evt", "seq")
    moved = F.when(F.col("moved_to").isNotNull(), at)
    return file_ops(events).groupBy("session_key", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("evt", "seq", "op"))), lambda o: o["op"]).alias("ops"),
        F.bool_or(F.col("op") == "create").alias("created"),
        F.bool_or((F.col("op") == "delete") & ~F.col("inferred")).alias("deleted"),
        F.max_by("moved_to", moved).alias("moved_to"),
        F.count_if(F.col("op").isin("edit", "create", "move")).alias("edits"),
        F.count_if(F.col("op") == "read").alias("reads"),
        F.min("evt").alias("first_evt"),
        F.max("evt").alias("last_evt"),
        F.bool_and("inferred").alias("inferred"),
    )


def edit_outcomes(events: DataFrame) -> DataFrame:
    """session_key, path, last_edit_succeeded: by the result of the last edit call of the path that has one."""
    rows = active(events).withColumn("edits", (F.col("kind") == "tool_call") & (F.col("tool_class") == "edit"))
    paired = pair_once(rows, F.col("edits"), F.col("kind") == "tool_result", ["session_key", "call_id"], ["idx"], ["is_error", "output"])
    ok = F.coalesce(~F.col("result.is_error"), ~X.looks_like_error(F.coalesce("result.output", F.lit(""))))
    done = paired.select("session_key", F.col("call.idx").alias("evt"), F.col("result.idx").alias("at"), ok.alias("ok"))
    touched = file_ops(events).where("NOT inferred AND op <> 'read'").select("session_key", "evt", "path").distinct()
    return touched.join(done, ["session_key", "evt"]).groupBy("session_key", "path").agg(F.max_by("ok", "at").alias("last_edit_succeeded"))


def commands(events: DataFrame, mode: str = "default") -> DataFrame:
    """session_key, evt, command, normalized, category, exit_code, is_error, failed, status, output_head, output_tail: paired shell calls and shell executions."""
    called = (F.col("kind") == "tool_call") & (F.col("tool_class") == "shell")
    rows = active(events).where(called | (F.col("kind") == "tool_result")).withColumn("cmd", F.when(called, command_of(F.col("args"))))
    shell = called & F.col("cmd").isNotNull()
    paired = pair_once(rows, shell, F.col("kind") == "tool_result", ["session_key", "call_id"], ["idx"], ["cmd", "output", "is_error", "exit_code"])
    called = paired.select("session_key", F.col("call.idx").alias("evt"), F.col("call.cmd").alias("command"), *[F.col(f"result.{c}").alias(c) for c in ("output", "is_error", "exit_code")])
    direct = active(events).where("kind = 'shell_execution'").select("session_key", F.col("idx").alias("evt"), "command", "output", F.lit(None).cast("boolean").alias("is_error"), "exit_code")
    both = called.unionByName(direct).withColumns({"output": F.coalesce("output", F.lit("")), "exit_code": F.coalesce("exit_code", X.exit_code_in_output(F.coalesce("output", F.lit(""))))})
    status = F.when(failed(), "FAILED").when(F.col("is_error").isNull() & F.col("exit_code").isNull(), "unknown").otherwise("ok")
    both = both.withColumn("normalized", X.normalize_command(F.col("command")))
    return both.select(
        "session_key",
        "evt",
        R.redact(F.col("command"), mode).alias("command"),
        "normalized",
        X.category_of(F.col("normalized")).alias("category"),
        "exit_code",
        "is_error",
        failed().alias("failed"),
        status.alias("status"),
        R.redact(X.head_bytes(F.col("output"), HEAD), mode).alias("output_head"),
        R.redact(X.tail_bytes(F.col("output"), TAIL), mode).alias("output_tail"),
    )


def last_status(found: DataFrame) -> DataFrame:
    """The last run of each (session, category, normalized command)."""
    w = Window.partitionBy("session_key", "category", "normalized").orderBy(F.desc("evt"))
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def errors(events: DataFrame, runs: DataFrame, mode: str = "default") -> DataFrame:
    """session_key, sig, example, first_evt, last_evt, occurrences, command, status, resolved_evt."""
    out = F.coalesce("output", F.lit(""))
    bad = failed() | F.coalesce(X.exit_code_in_output(out) != 0, F.lit(False)) | X.looks_like_error(out)
    own = active(events).where(F.col("kind").isin("tool_result", "shell_execution")).where(bad)
    own = own.select("session_key", F.col("idx").alias("evt"), X.error_snippet(out).alias("snippet"), F.when(F.col("kind") == "shell_execution", X.normalize_command(F.col("command"))).alias("own"))
    own = own.where("snippet IS NOT NULL").withColumn("sig", X.signature_id(F.col("snippet")))
    grouped = own.groupBy("session_key", "sig").agg(
        F.min_by("snippet", "evt").alias("snippet"), F.min("evt").alias("first_evt"), F.max("evt").alias("last_evt"), F.count("*").alias("occurrences"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("evt"))).alias("own")
    )
    from sessionloom.operators.joins import as_of

    near = as_of(grouped, runs.select("session_key", F.col("evt").alias("run_evt"), "normalized"), ["session_key"], "first_evt", "run_evt", ["normalized"])
    found = near.withColumn("command", F.coalesce("own", "normalized")).drop("own", "normalized")
    r = runs.select("session_key", F.col("normalized").alias("command"), "evt", "failed")
    both = found.join(r, ["session_key", "command"], "left").groupBy(*found.columns).agg(
        F.max_by(F.struct("evt", "failed"), F.when(F.col("evt") > F.col("last_evt"), F.col("evt"))).alias("later"),
        F.max_by(F.struct("evt", "failed"), "evt").alias("any"),
    )
    later = F.when(F.col("later.evt") > F.col("last_evt"), F.col("later"))
    status = (
        F.when(F.col("command").isNull(), "unknown")
        .when(later.isNotNull(), F.when(later["failed"], "unresolved").otherwise("resolved"))
        .when(F.col("any.evt").isNull() | F.col("any.failed"), "unresolved")
        .otherwise("unknown")
    )
    return both.select("session_key", "sig", R.redact(X.head_bytes(F.col("snippet"), EXAMPLE), mode).alias("example"), "first_evt", "last_evt", "occurrences", "command", status.alias("status"), F.when(status == "resolved", later["evt"]).alias("resolved_evt"))


def unresolved(found: DataFrame) -> DataFrame:
    return found.where("status = 'unresolved'").orderBy("session_key", F.desc("occurrences"), "sig")


def dead_ends(found: DataFrame, least: int = 3) -> DataFrame:
    return found.where((F.col("status") == "unresolved") & (F.col("occurrences") >= least))


def messages(events: DataFrame, mode: str = "default") -> DataFrame:
    """session_key, evt, role (user or summary), text."""
    own = active(events)
    answer = F.concat(F.lit("(asked: "), F.col("question"), F.lit(") "), F.col("answer"))
    text = F.when(F.col("kind") == "user_answer", answer).otherwise(F.col("text"))
    summary = F.col("kind").isin("compaction_summary", "branch_summary")
    kept = own.where(is_human() | summary)
    return kept.select("session_key", F.col("idx").alias("evt"), F.when(summary, "summary").otherwise("user").alias("role"), R.redact(X.truncate_tokens(F.coalesce(text, F.lit("")), MESSAGE), mode).alias("text"))


def plan(events: DataFrame) -> DataFrame:
    """session_key, evt, items: the last plan."""
    return active(events).where("kind = 'plan_update'").groupBy("session_key").agg(F.max("idx").alias("evt"), F.max_by("plan", "idx").alias("items"))


def git(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_key, evt, sha, subject) of commits; (session_key, branches, pull_requests, pushed)."""
    out = F.concat("output_head", F.lit("\n"), "output_tail")
    pattern = r"(?m)^\s*\[\S+(?: [^\]]*)? ([0-9a-fA-F]{7,})\] *(.*?)\s*$"
    own = runs.where("category = 'git' AND NOT failed AND normalized LIKE '%commit%'")
    commits = own.select("session_key", "evt", F.regexp_extract(out, pattern, 1).alias("sha"), F.regexp_extract(out, pattern, 2).alias("subject")).where("sha <> ''")
    branch = F.regexp_extract("normalized", r"\b(?:checkout|switch)(?: -\S*)* ([^-\s]\S*)", 1)
    urls = F.transform(F.regexp_extract_all(out, F.lit(r"https://\S*/pull/\S*"), F.lit(0)), lambda u: F.regexp_replace(u, F.lit("[.,)]+$"), F.lit("")))
    each = runs.select("session_key", "evt", F.when(F.col("category") == "git", F.nullif(branch, F.lit(""))).alias("branch"), urls.alias("urls"), ((F.col("category") == "git") & F.contains("normalized", F.lit("push")) & ~F.col("failed")).alias("push"))

    def ordered(c: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("evt", c)))), lambda x: x[c]))

    facts = each.groupBy("session_key").agg(ordered("branch").alias("branches"), F.array_distinct(F.flatten(ordered("urls"))).alias("pull_requests"), F.bool_or("push").alias("pushed"))
    return commits, facts


def edited(found: DataFrame) -> DataFrame:
    return found.where("edits > 0").orderBy("session_key", F.desc("last_evt"), "path")


# Directory names that name no part of a project.
GENERIC = [
    "src", "lib", "dist", "build", "out", "target", "node_modules", "vendor", "bin", "obj", "tmp", "temp", "test", "tests", "__tests__", "spec", "specs", "fixtures", "fixture",
    "examples", "example", "assets", "static", "public", "coverage", "generated", "gen", "pkg", "packages", "apps", "app", "crates", "modules", "components", "shared", "common",
    "internal", "server", "client", "types", "utils", "helpers", "hooks", "styles", "images", "img", "docs", "doc",
]


def vocabulary(paths: DataFrame, least: int = 2) -> DataFrame:
    """session_key, name, n: names of three bytes at least in paths (session_key, path), without dots and not generic, that occur ``least`` times."""
    part = paths.select("session_key", F.explode(F.split("path", "/")).alias("name"))
    kept = part.where((F.octet_length("name") >= 3) & ~F.col("name").isin(GENERIC) & ~F.contains("name", F.lit(".")))
    return kept.groupBy("session_key", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def work_areas(found: DataFrame, cwd: Column | None = None, top: int = 5) -> DataFrame:
    """The busiest two-level folders: session_key, area, work."""
    path = F.col("path") if cwd is None else F.when(F.startswith("path", F.concat(cwd, F.lit("/"))), F.substr(F.col("path"), F.length(cwd) + 2)).otherwise(F.col("path"))
    area = F.array_join(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, 2), "/")
    work = found.groupBy("session_key", area.alias("area")).agg(F.sum(F.col("edits") + F.col("reads")).alias("work"))
    w = Window.partitionBy("session_key").orderBy(F.desc("work"), "area")
    return work.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
