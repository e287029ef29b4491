"""Transcript lines to canonical events, with the branch of history that is still live.

A line gives its events by itself (see ``parsing``).  What depends on other lines comes from windows over narrow rows, one for a line or an event: ordinals, streams, the pairing
of calls with what answers them, rollbacks; and from walks up the entries' tree (see ``live``).  These facts are joined to the events by place, so that a
session is spread over tasks however long it is.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators import live, parsing
from sessionloom.operators.parsing import CLASS_OF, COMMAND_KEYS, OPENERS, PATH_KEYS, PLAN_LISTS, TOOLS  # noqa: F401
from sessionloom.operators.steps import Steps, new_folder
from sessionloom.sources.transcripts import detect

SCHEMA = """session_key string, idx int, native_id string, parent string, ts string, stream int, kind string, is_active boolean,
 path_ix int, line_no int, text string, is_meta boolean, phase string, redacted boolean, call_id string, tool_name string, tool_class string,
 args string, output string, is_error boolean, exit_code int, command string, plan array<struct<text:string,status:string>>, question string,
 answer string, num_turns int, model string, sub_stream int, subtype string, windowed boolean"""


class TooManyBadLines(ValueError):
    """More lines are unreadable than allowed."""


def providers(lines: DataFrame) -> DataFrame:
    """session_key, provider of the sessions with a known one, by their first non-blank line."""
    first = lines.where((F.col("path_ix") == 0) & (F.trim("raw") != "")).groupBy("session_key").agg(F.min_by("raw", "line_no").alias("first"))
    return first.select("session_key", detect(F.col("first")).alias("provider")).where("provider IS NOT NULL")


LINE = ["session_key", "provider", "path_ix", "line_no"]
PLACE = ["path_ix", "line_no"]


@functools.cache
def _expressions(provider: str, gateway: int) -> dict[str, Column]:
    """What a provider's line (v) says of itself.  Large, so made once for each gateway to the JVM."""
    v = F.col("v")
    text = lambda *keys: parsing.string(v, *keys)
    if provider == "tree":
        kind = F.coalesce(parsing.text_of(parsing.get(v, "type")), F.lit(""))
        own = {"id": text("uuid"), "parent": text("parentUuid"), "other": text("logicalParentUuid"), "ts": text("timestamp"), "talks": kind.isin("user", "assistant")}
        own |= {"side": (F.col("path_ix") > 0) | F.coalesce(parsing.boolean(v, "isSidechain"), F.lit(False)), "note": parsing.tree_note(v), "events": parsing.tree_events(v)}
    elif provider == "rollout":
        own = {"ts": text("timestamp"), "note": parsing.rollout_note(v), "events": parsing.rollout_events(v)}
    else:
        own = {"id": text("id", "entryId"), "parent": text("parentId", "parent"), "ts": text("timestamp", "time"), "talks": F.lit(True), "header": parsing.journal_kind(v) == "session"}
        own |= {"version": parsing.whole(v, "version"), "note": parsing.journal_note(v), "events": parsing.journal_events(v)}
    types = {"id": "string", "parent": "string", "other": "string", "ts": "string", "side": "boolean", "talks": "boolean", "header": "boolean", "version": "int", "note": "string", "events": parsing.EVENTS}
    return {k: own.get(k, F.lit(False) if t == "boolean" else F.lit(None)).cast(t) for k, t in types.items()}


def parsed(lines: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """A row for each line that isn't blank: what it says of itself as an entry (id, parent, other, side, talks), whether it can't be read (bad), a note on its
    kind, and its events.  ``known`` gives the sessions' providers, ``names`` those that occur."""
    own = lines.join(known, "session_key").where(~parsing.is_blank(F.col("raw"))).withColumn("v", F.try_parse_json("raw"))
    own = own.select(*LINE, F.col("v").isNull().alias("bad"), F.when(parsing.is_object(F.col("v")), F.col("v")).otherwise(F.parse_json(F.lit("{}"))).alias("v"))
    of = {p: _expressions(p, id(SparkContext._gateway)) for p in names}
    each = {k: F.coalesce(*[F.when(F.col("provider") == p, e[k]) for p, e in of.items()]) if len(of) > 1 else e[k] for e in of.values() for k in e}
    return own.select(*LINE, "bad", *[F.when(~F.col("bad"), c).alias(k) for k, c in each.items()])


def _entries(own: DataFrame) -> DataFrame:
    """The lines that are entries of a tree, with pos: their number in the session."""
    return own.where("provider <> 'rollout' AND NOT bad AND NOT header").withColumn("pos", F.row_number().over(Window.partitionBy("session_key").orderBy(*PLACE)))


def _tree(own: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of parsed lines: the entries, with here (whether they are on the live path; null if the session has none), the ids on live paths with
    those above them, and the sessions that have a path."""
    entries = _entries(own.withColumn("summary", F.exists("events", lambda e: e["kind"] == "compaction_summary")).drop("events"))
    named = entries.where("id IS NOT NULL")
    versions = own.where("header AND NOT bad").groupBy("session_key").agg(F.max_by(F.coalesce("version", F.lit(0)), F.struct(*PLACE)).alias("version"))
    flat = F.coalesce("version", F.lit(0)) < 2
    leaf = F.when(F.col("provider") == "tree", F.col("talks") & ~F.col("side")).otherwise((F.col("n_events") > 0) & ~flat)
    leaves = steps.once("leaves", lambda: named.drop("version").join(versions, "session_key", "left").where(leaf).groupBy("session_key").agg(F.max_by(F.struct("id", "parent", "other"), "pos").alias("leaf")).select("session_key", "leaf.*"))
    # the last entry of an id stands for it; its parent is the first of the two that exists
    last = named.join(leaves.select("session_key"), "session_key", "left_semi").groupBy("session_key", "id").agg(F.max("pos").alias("pos"), F.max_by(F.struct("parent", "other"), "pos").alias("up"))
    # but for the leaf's id, it is the leaf itself
    of_leaf = leaves.select("session_key", "id", F.struct("parent", "other").alias("_leaf_up"))
    last = last.join(of_leaf, ["session_key", "id"], "left").withColumn("up", F.coalesce("_leaf_up", "up")).select("session_key", "id", "pos", "up.parent", "up.other")
    there = last.select("session_key", F.col("id").alias("_id"))
    known = last.join(there.withColumn("_p", F.lit(True)).withColumnRenamed("_id", "parent"), ["session_key", "parent"], "left")
    known = known.join(there.withColumn("_o", F.lit(True)).withColumnRenamed("_id", "other"), ["session_key", "other"], "left")
    linked = known.select("session_key", "id", "pos", F.when(F.col("_p"), F.col("parent")).when(F.col("_o"), F.col("other")).alias("up"), F.coalesce("parent", "other").alias("wanted"))
    linked = steps.once("linked", lambda: linked)
    path = steps.once("path", lambda: live.on_path(linked.drop("wanted"), leaves.select("session_key", "id"), steps))
    marked = entries.join(leaves.select("session_key", F.lit(True).alias("has")), "session_key", "left").join(path.withColumn("_on", F.lit(True)), ["session_key", "id"], "left")
    marked = marked.withColumn("here", F.when(F.col("has"), F.coalesce("_on", F.lit(False)))).drop("has", "_on")
    return marked, linked.join(path, ["session_key", "id"], "left_semi"), leaves


def _streams(own: DataFrame, steps: Steps) -> DataFrame:
    """Of the parsed lines of linked transcripts that are sidechains, or start subagents: path_ix, line_no, stream, and before, the number of the streams opened up to and
    with the line itself, its subagents not counted.

    A sidechain file is one stream; a line inside the main file inherits its parent's, or opens one; each call that starts a subagent opens one.
    """
    lines = own.where("provider = 'tree' AND NOT bad").withColumn("spawns", F.size(F.filter("events", lambda e: e["kind"] == "subagent_spawn"))).where("side OR spawns > 0")
    lines = steps.once("stream-lines", lambda: lines.select("session_key", *PLACE, "id", "parent", "side", "spawns").withColumn("pos", F.row_number().over(Window.partitionBy("session_key").orderBy(*PLACE))))
    inner = lines.where("side AND path_ix = 0")
    # the latest line before that has the parent's id
    defines = inner.where("id IS NOT NULL").select("session_key", "pos", F.col("id").alias("key"), F.col("pos").alias("def"), F.lit(True).alias("is_def"))
    asks = inner.where("parent IS NOT NULL").select("session_key", "pos", F.col("parent").alias("key"), F.lit(None).cast("int").alias("def"), F.lit(False).alias("is_def"))
    w = Window.partitionBy("session_key", "key").orderBy("pos", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    above = defines.unionByName(asks).withColumn("up", F.last("def", ignorenulls=True).over(w)).where("NOT is_def").select("session_key", "pos", "up")
    chains = inner.select("session_key", "pos").join(above, ["session_key", "pos"], "left").select("session_key", F.col("pos").alias("id"), "pos", "up")
    rooted = steps.once("stream-roots", lambda: live.roots(chains, steps).select("session_key", F.col("id").alias("pos"), "root"))
    of_file = F.row_number().over(Window.partitionBy("session_key", "path_ix").orderBy("line_no")) == 1
    opened = lines.join(rooted, ["session_key", "pos"], "left").withColumn("opens", F.when(F.col("path_ix") > 0, of_file).otherwise(F.coalesce(F.col("root") == F.col("pos"), F.lit(False))).cast("int"))
    total = F.sum(F.col("opens") + F.col("spawns")).over(Window.partitionBy("session_key").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0))
    counted = opened.withColumn("before", (total - F.col("spawns")).cast("int"))
    counted = steps.once("stream-counts", lambda: counted)
    of_root = counted.where("opens = 1 AND path_ix = 0").select("session_key", F.col("pos").alias("root"), F.col("before").alias("_root_stream"))
    files = counted.where("opens = 1 AND path_ix > 0").select("session_key", "path_ix", F.col("before").alias("_file_stream"))
    stream = F.when(F.col("path_ix") > 0, F.col("_file_stream")).otherwise(F.coalesce("_root_stream", F.lit(0)))
    return counted.join(of_root, ["session_key", "root"], "left").join(files, ["session_key", "path_ix"], "left").select("session_key", *PLACE, stream.alias("stream"), "before")


def _facts(own: DataFrame, steps: Steps, seen: dict[str, bool]) -> DataFrame:
    """A narrow row for each event: idx, is_active, stream, sub_stream, and for what answers a call that asked or started a subagent, the question or the stream.

    ``seen`` says what occurs at all; what doesn't is not looked for.
    """
    one = F.transform("events", lambda e, k: F.struct(k.alias("k"), e["kind"].alias("kind"), e["call_id"].alias("call_id"), e["question"].alias("question"), e["is_meta"].alias("is_meta"), e["num_turns"].alias("num_turns")))
    each = own.where("NOT bad").select("session_key", "provider", *PLACE, F.explode(one).alias("e")).select("session_key", "provider", *PLACE, "e.*")
    order = [*PLACE, "k"]
    each = each.withColumn("idx", (F.row_number().over(Window.partitionBy("session_key").orderBy(*order)) - 1).cast("int"))
    if seen["streams"]:
        streams = steps.once("streams", lambda: _streams(own, steps))
        each = each.join(streams, ["session_key", *PLACE], "left").withColumn("stream", F.coalesce("stream", F.lit(0)))
        spawn = F.col("kind") == "subagent_spawn"
        nth = F.sum(spawn.cast("int")).over(Window.partitionBy("session_key", *PLACE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        each = each.withColumn("sub_stream", F.when(spawn, (F.col("before") + nth).cast("int")))
    else:
        each = each.withColumns({"stream": F.lit(0), "sub_stream": F.lit(None).cast("int")})
    # what answers: the next result of the same call, if nothing else of it comes between
    if seen["streams"] or seen["asked"]:
        opens = F.col("sub_stream").isNotNull() | F.col("question").isNotNull()
        pairs = each.where(opens | (F.col("kind") == "tool_result")).select("session_key", "call_id", "idx", "kind", F.col("sub_stream").alias("_s"), F.col("question").alias("_q"))
        pairs = pairs.join(each.where(opens).select("session_key", "call_id").distinct(), ["session_key", "call_id"], "left_semi")
        w = Window.partitionBy("session_key", "call_id").orderBy("idx")
        paired = pairs.select("session_key", "idx", "kind", F.lag("_s").over(w).alias("answers_stream"), F.lag("_q").over(w).alias("answers_question")).where("kind = 'tool_result'").drop("kind")
        each = each.join(paired, ["session_key", "idx"], "left")
    else:
        each = each.withColumns({"answers_stream": F.lit(None).cast("int"), "answers_question": F.lit(None).cast("string")})

    if seen["entries"]:
        lines = _tree(own, steps)[0].select("session_key", *PLACE, "here", F.col("id").isNull().alias("loose"), "summary")
        each = each.join(lines, ["session_key", *PLACE], "left")
    else:
        each = each.withColumns({c: F.lit(None).cast("boolean") for c in ("here", "loose", "summary")})
    outside = F.col("loose") & ((F.col("provider") == "journal") | F.col("summary"))
    turn = F.col("answers_question").isNotNull() | ((F.col("kind") == "user_message") & ~F.coalesce("is_meta", F.lit(False)))
    back = F.when(F.col("kind") == "rollback", F.col("num_turns"))
    rolled = live.with_survivors(each.where("provider = 'rollout'"), turn, back, order).withColumn("is_active", F.col("survives")).drop("survives")
    kept = each.where("provider <> 'rollout'").withColumn("is_active", F.coalesce(F.col("here") | outside, F.lit(True)))
    return rolled.unionByName(kept).select("session_key", *order, "idx", "is_active", "stream", "sub_stream", "answers_stream", "answers_question")


def _parsed(lines: DataFrame) -> tuple[DataFrame, Steps]:
    spark = lines.sparkSession
    steps = Steps(spark, new_folder(spark, "events"))
    known = steps.once("providers", lambda: providers(lines))
    names = sorted(r["provider"] for r in known.select("provider").distinct().collect())
    own = steps.once("parsed", lambda: parsed(lines, known, names or ["tree"]))
    return own.withColumn("events", F.coalesce("events", parsing.none())).withColumn("n_events", F.size("events")), steps


def events(lines: DataFrame, bad_line_rate: float | None = 0.02) -> DataFrame:
    """The canonical events of raw lines.  Sessions of no known provider give none; one with too many unreadable lines fails."""
    own, steps = _parsed(lines)
    has = lambda f: F.exists("events", f)
    streams = F.col("side") | has(lambda e: e["kind"] == "subagent_spawn")
    seen = {"bad": F.col("bad"), "streams": streams, "asked": has(lambda e: e["question"].isNotNull()), "entries": (F.col("provider") != "rollout") & F.col("id").isNotNull()}
    seen = own.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in seen.items()]).first().asDict()
    if bad_line_rate is not None and seen["bad"]:
        counted = own.groupBy("session_key").agg(F.count_if("bad").alias("bad"), F.sum("n_events").alias("events"), F.count("*").alias("lines"))
        worst = counted.where((F.col("bad") > 0) & (F.col("bad") / F.greatest("events", "bad") > bad_line_rate)).limit(1).collect()
        if worst:
            raise TooManyBadLines(f"{worst[0]['bad']} of {worst[0]['lines']} lines of {worst[0]['session_key']} are unreadable")
    facts = steps.once("facts", lambda: _facts(own, steps, seen))
    each = own.where("NOT bad").select("session_key", "path_ix", "line_no", "id", "parent", "ts", "provider", F.posexplode("events").alias("k", "e"))
    all_ = each.join(facts, ["session_key", *PLACE, "k"])
    answers, asked = F.col("answers_stream").isNotNull(), F.col("answers_question").isNotNull()
    result = answers | asked
    e = lambda name: F.col(f"e.{name}")
    said = {
        "native_id": F.when(F.col("provider") == "rollout", e("native_id")).otherwise(F.col("id")),
        "parent": F.when(F.col("provider") != "rollout", F.col("parent")),
        "kind": F.when(answers, "subagent_result").when(asked, "user_answer").otherwise(e("kind")),
        "text": F.when(answers, e("output")).otherwise(e("text")),
        "call_id": F.when(~result & (e("kind") != "subagent_spawn"), e("call_id")),
        "output": F.when(~result, e("output")),
        "is_error": F.when(~result, e("is_error")),
        "exit_code": F.when(~result, e("exit_code")),
        "question": F.col("answers_question"),
        "answer": F.when(asked, F.coalesce(e("answer"), e("output"))),
        "sub_stream": F.coalesce("sub_stream", "answers_stream"),
    }
    schema = lines.sparkSession.createDataFrame([], SCHEMA).schema
    own_names = ("session_key", "idx", "ts", "stream", "is_active", "path_ix", "line_no")
    return all_.select(*[(said[f.name] if f.name in said else F.col(f.name) if f.name in own_names else e(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def diagnostics(lines: DataFrame) -> DataFrame:
    """session_key, kind, line_no, message, n: unreadable lines, unknown kinds, missing parents and abandoned branches."""
    own, steps = _parsed(lines)
    one = lambda kind, line, message: [F.lit(kind).alias("kind"), line.cast("int").alias("line_no"), message.cast("string").alias("message"), F.lit(1).cast("long").alias("n")]
    none = F.lit(None)
    out = own.where("bad").select("session_key", *one("bad_line", F.col("line_no"), F.lit("not JSON")))
    out = out.unionByName(own.where("note IS NOT NULL").select("session_key", *one("unknown_kind", F.col("line_no"), F.col("note"))))
    entries, path, _ = _tree(own, steps)
    out = out.unionByName(path.where("up IS NULL AND wanted IS NOT NULL").select("session_key", *one("missing_parent", none, F.col("wanted"))))
    # entries that talk and were left, by the next one on the path that ends their run
    w = Window.partitionBy("session_key").orderBy("pos")
    left = F.col("talks") & ~F.col("side") & F.col("id").isNotNull() & ~F.col("here")
    runs = entries.where("here IS NOT NULL").withColumn("run", F.sum(F.col("here").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = runs.groupBy("session_key", "run").agg(F.count_if(left).alias("c")).where("c > 0")
    return out.unionByName(gone.select("session_key", *one("abandoned_branch", none, F.concat(F.col("c").cast("string"), F.lit(" entries")))))


def kind_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("session_key", "kind").agg(F.count("*").alias("n"))


def is_human() -> F.Column:
    return ((F.col("kind") == "user_message") & ~F.coalesce("is_meta", F.lit(False))) | (F.col("kind") == "user_answer")


def user_turns(found: DataFrame) -> DataFrame:
    return found.groupBy("session_key").agg(F.count_if(F.col("is_active") & (F.col("stream") == 0) & is_human()).alias("user_turns"))


def violations(found: DataFrame) -> DataFrame:
    """Sessions whose ordinals aren't dense from 0 or occur twice."""
    per = found.groupBy("session_key").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("top"), F.min("idx").alias("low"))
    return per.where((F.col("n") != F.col("d")) | (F.col("top") != F.col("n") - 1) | (F.col("low") != 0))


def since_compaction(found: DataFrame) -> DataFrame:
    """The events from a session's boundary on: its last replacing compaction, else its first windowed one, else its start."""
    marks = found.where("kind = 'compaction_summary' OR (kind = 'system' AND subtype = 'native_compaction')")
    whole_, window = ~F.coalesce("windowed", F.lit(False)), F.coalesce("windowed", F.lit(False))
    edge = marks.groupBy("session_key").agg(F.coalesce(F.max(F.when(whole_, F.col("idx"))), F.min(F.when(window, F.col("idx")))).alias("edge"))
    return found.join(edge, "session_key", "left").where(F.col("idx") >= F.coalesce("edge", F.lit(0))).drop("edge")
