"""The fold: a state for each session, made by asking an injected function about one chunk after the other.

Operations are checked and applied by column expressions over a session's items (an array), so a replay of known operations is one aggregation.  Where a
function has to be asked, what it is told depends on what it said before: the fold runs in rounds.  Round k takes the k-th chunk of every session
that has one, all sessions at once; it builds their prompts, asks, checks, applies, and asks once more those whose operations were refused.  Each
step of a round is a table in the fold's folder.  A step whose table is there is read, not run again, so a fold that was killed goes on where it stopped
and never asks twice.

Nothing is ever deleted from a state: items are superseded, resolved or dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as X
from sessionloom.operators.steps import Steps

#: kind -> id prefix, in the order of importance; and how many may be active.
PREFIX = {"constraint": "C", "goal": "G", "current_step": "S", "next_action": "N", "dead_end": "X", "decision": "D", "open_thread": "O", "env_fact": "F", "question": "Q"}
LIMIT = {"goal": 1, "current_step": 1, "next_action": 3}
WORDS = {"text": 60, "why": 40, "quote": 50}
NAMES = ("add", "update", "supersede", "resolve", "drop", "merge", "confirm")
RANGES = "array<struct<start:int,end:int>>"
ITEM = f"struct<id:string,seq:int,kind:string,text:string,why:string,quote:string,sources:{RANGES},status:string,detail:string,confidence:string,last_confirmed:int>"
NEW = f"struct<kind:string,text:string,why:string,quote:string,sources:{RANGES},confidence:string>"
OP = f"struct<op:string,ids:array<string>,evt:int,reason:string,text:string,why:string,add_sources:{RANGES},item:{NEW},wrong:string>"
REFUSED = "struct<chunk:string,op_index:int,op:string,reason:string>"
STATE = f"struct<items:array<{ITEM}>,refused:array<{REFUSED}>>"
PREMAP_FROM, NOTES, STATE_TOKENS = 5, 12, 6000


# ---- replies: what a model wrote, as operations


def repaired(text: str) -> list[dict]:
    """Operations from a reply that may be fenced, wrapped in prose, cut off or have trailing commas; none if nothing can be read."""
    body = re.sub(r"^\s*```[a-z]*\n?|```\s*$", "", text.strip())
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        return []
    body = body[min(starts) :]
    closers, quoted, escaped, end = [], False, False, len(body)
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]" and closers:
            closers.pop()
            if not closers:
                end = i + 1
                break
    body = body[:end] + ('"' if quoted else "") + "".join(reversed(closers))
    try:
        value = json.loads(re.sub(r",\s*([}\]])", r"\1", body))
    except (ValueError, RecursionError):
        return []
    ops = value.get("ops", [value]) if isinstance(value, dict) else value
    return [o for o in ops if isinstance(o, dict) and "op" in o] if isinstance(ops, list) else []


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 31


def _pair(value) -> tuple | None:
    pair = (value.get("start"), value.get("end")) if isinstance(value, dict) else tuple(value) if isinstance(value, list) else ()
    return (min(pair), max(pair)) if len(pair) == 2 and all(map(_whole, pair)) else None


def malformed(op: dict) -> str | None:
    """What is wrong with an operation's fields, or None: they come from a model and may have any shape."""
    name = op.get("op")
    if not isinstance(name, str):
        return "no operation"
    ids = op.get("ids", [op["id"]] if "id" in op else [])
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        return "an id is no text"
    if name in ("update", "resolve", "drop", "confirm") and not isinstance(op.get("id"), str) or name in ("supersede", "merge") and not ids:
        return "no id"
    if name in ("resolve", "confirm") and not _whole(op.get("evt")):
        return "no evt"
    new = {"add": op, "supersede": op.get("replacement"), "merge": op.get("merged")}.get(name)
    if name in ("add", "supersede", "merge") and not isinstance(new, dict):
        return "no new item"
    for part, key in ((new, "sources"), (op, "add_sources")):
        ranges = part.get(key) if isinstance(part, dict) else None
        if ranges is not None and not (isinstance(ranges, list) and all(map(_pair, ranges))):
            return f"{key} are no ranges of events"
    texts = [(op, k) for k in ("text", "why", "reason")] + [(new, k) for k in (*WORDS, "kind", "confidence") if isinstance(new, dict)]
    return next((f"{k} is no text" for part, k in texts if part.get(k) is not None and not isinstance(part[k], str)), None)


def typed(op: dict) -> dict:
    """An operation in the fields of OP; ``wrong`` says why it can't be read."""
    wrong, name = malformed(op), op.get("op") if isinstance(op.get("op"), str) else None
    out = {"op": name if name is not None else str(op.get("op")), "wrong": wrong}
    if wrong is None:
        new = {"add": op, "supersede": op.get("replacement"), "merge": op.get("merged")}.get(name)
        ranges = lambda v: [dict(zip(("start", "end"), _pair(r), strict=True)) for r in v or []]
        out |= {"ids": op.get("ids") or ([op["id"]] if "id" in op else []), "add_sources": ranges(op.get("add_sources"))}
        out |= {k: op.get(k) for k in ("reason", "text", "why")} | {"evt": op.get("evt") if name in ("resolve", "confirm") else None}
        out["item"] = {"sources": ranges(new.get("sources")), **{k: new.get(k) for k in (*WORDS, "kind", "confidence")}} if new is not None else None
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        replies = b.column(b.schema.get_field_index("reply")).to_pylist()
        ops = pa.array([json.dumps([typed(o) for o in repaired(r or "")]) for r in replies], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, ops], [*b.schema.names, "ops"])


def with_ops(replies: DataFrame) -> DataFrame:
    """The rows with ops, an array of OP, out of the text in ``reply``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replies.schema)
    return replies.mapInArrow(_read, schema + ", ops string").withColumn("ops", F.from_json("ops", f"array<{OP}>"))


# ---- checks


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _count_words(text: Column) -> Column:
    return F.when(_strip(text) == "", 0).otherwise(F.size(F.split(_strip(text), r"(?U)\s+")))


def _mentions_unknown_path(text: Column, paths: Column) -> Column:
    bare = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[`'\",;:()\\[\\]]+|[`'\",;:()\\[\\]]+$", ""))
    own = F.filter(bare, lambda w: F.contains(w, F.lit("/")) & F.contains(w, F.lit(".")) & ~F.contains(w, F.lit("://")))
    return F.exists(own, lambda w: ~F.exists(paths, lambda p: F.contains(p, w)))


def _clean(op: Column, paths: Column) -> Column:
    """The operation with its new item's texts trimmed and redacted, and low confidence for a path that nothing mentions."""
    new = op["item"]
    text = {k: R.redact(_strip(new[k])) for k in WORDS}
    kept = F.when(_mentions_unknown_path(F.coalesce(text["text"], F.lit("")), paths), "low").otherwise(F.coalesce(new["confidence"], F.lit("medium")))
    item = F.struct(new["kind"].alias("kind"), *[text[k].alias(k) for k in ("text", "why", "quote")], new["sources"].alias("sources"), kept.alias("confidence"))
    return op.withField("item", F.when(new.isNotNull(), item))


def _find(items: Column, id_: Column) -> Column:
    return F.get(F.filter(items, lambda i: i["id"] == id_), F.lit(0))


def _why_not(op: Column, items: Column, batch: Column) -> Column:
    """The reason against an operation, without the limit on kinds; null for none.  Checks come in a fixed order."""
    inside = lambda a, b: (a >= batch["evt_start"]) & (b <= batch["evt_end"])
    outside = lambda rs: F.exists(rs, lambda r: ~inside(r["start"], r["end"]))
    new, name = op["item"], op["op"]
    status = F.transform(op["ids"], lambda i: F.struct(i.alias("id"), _find(items, i)["status"].alias("status")))
    bad = F.get(F.filter(status, lambda s: F.coalesce(s["status"], F.lit("")) != "active"), F.lit(0))
    visible = F.exists(new["sources"], lambda r: F.exists(batch["visible"], lambda e: e.between(r["start"], r["end"])))
    said = F.exists(batch["human"], lambda h: F.contains(X.normalize_quote(h), X.normalize_quote(new["quote"])))
    long_ = lambda k: _count_words(F.coalesce(new[k], F.lit(""))) > WORDS[k]
    constraint = new["kind"] == "constraint"
    return (
        F.when(op["wrong"].isNotNull(), op["wrong"])
        .when(bad.isNotNull(), F.when(bad["status"].isNull(), F.concat(F.lit("unknown item "), bad["id"])).otherwise(F.concat(F.lit("item "), bad["id"], F.lit(" is not active"))))
        .when((name == "drop") & (_find(items, F.get(op["ids"], F.lit(0)))["kind"] == "constraint"), "a constraint is superseded, never dropped")
        .when(name.isin("resolve", "confirm") & ~inside(op["evt"], op["evt"]), F.concat(F.lit("evt "), op["evt"].cast("string"), F.lit(" is outside the chunk")))
        .when((name == "update") & outside(op["add_sources"]), "a source is outside the chunk")
        .when(~name.isin(*NAMES), F.concat(F.lit("unknown operation "), name))
        .when(name.isin("update", "resolve", "drop", "confirm"), F.lit(None).cast("string"))
        .when(~F.coalesce(new["kind"].isin(*PREFIX), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce(new["kind"], F.lit("None"))))
        .when(F.coalesce(new["text"], F.lit("")) == "", "empty text")
        .when(long_("text"), f"text is longer than {WORDS['text']} words")
        .when(long_("why"), f"why is longer than {WORDS['why']} words")
        .when(F.size(new["sources"]) == 0, "no source")
        .when(outside(new["sources"]), "a source is outside the chunk")
        .when(~visible, "no cited event is visible")
        .when(constraint & (F.coalesce(new["quote"], F.lit("")) == ""), "a constraint needs a quote")
        .when(constraint & long_("quote"), f"quote is longer than {WORDS['quote']} words")
        .when(constraint & ~said, "the quote is in no human message")
    )


def _checked(items: Column, batch: Column) -> Column:
    """The batch's operations, each with ``against``: why it is refused, or null.  All are checked against the items before the batch; the limits on
    kinds count what the batch has added, too."""
    ops = F.transform(batch["ops"], lambda op: _clean(op, batch["paths"]))
    first = F.transform(ops, lambda op: F.struct(op.alias("op"), _why_not(op, items, batch).alias("against")))
    for kind, limit in LIMIT.items():
        if limit > 1:
            first = _within_limit(first, items, kind, limit)
    return first


def _within_limit(checked: Column, items: Column, kind: str, limit: int) -> Column:
    return X.let(checked, lambda own: _limited(own, items, kind, limit))


def _limited(checked: Column, items: Column, kind: str, limit: int) -> Column:
    room = F.lit(limit) - F.size(F.filter(items, lambda i: (i["kind"] == kind) & (i["status"] == "active")))
    adds = lambda c: F.coalesce((c["op"]["op"] == "add") & c["against"].isNull() & (c["op"]["item"]["kind"] == kind), F.lit(False))
    over = lambda c, i: adds(c) & (F.size(F.filter(F.slice(checked, F.lit(1), i), adds)) >= room)
    return F.transform(checked, lambda c, i: F.when(over(c, i), c.withField("against", F.lit(f"at most {limit} active of {kind}"))).otherwise(c))


# ---- application


def _last(sources: Column, otherwise: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sources, lambda r: r["end"])), otherwise)


def _cite(item: Column, ranges: Column) -> Column:
    sources = F.concat(item["sources"], F.array_except(ranges, item["sources"]))
    return item.withField("sources", sources).withField("last_confirmed", _last(sources, item["last_confirmed"]))


def _marked(items: Column, ids: Column, status: str, detail: Column) -> Column:
    hit = lambda i: F.array_contains(ids, i["id"])
    return F.transform(items, lambda i: F.when(hit(i), i.withField("status", F.lit(status)).withField("detail", detail)).otherwise(i))


def _applied(items: Column, op: Column) -> Column:
    """The items after one operation that was accepted."""
    new, ids = op["item"], op["ids"]
    kind = new["kind"]
    prefix = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    of_kind = F.size(F.filter(items, lambda i: i["kind"] == kind))
    id_ = F.concat(F.element_at(prefix, kind), (of_kind + 1).cast("string"))
    fields = {"id": id_, "seq": F.size(items), "kind": kind, "text": new["text"], "why": new["why"], "quote": new["quote"], "sources": new["sources"], "status": F.lit("active")}
    fields |= {"detail": F.lit(None).cast("string"), "confidence": new["confidence"], "last_confirmed": _last(new["sources"], F.lit(0))}
    longer = F.concat(items, F.array(F.struct(*[v.alias(k) for k, v in fields.items()])))
    active = F.transform(F.filter(longer, lambda i: (i["kind"] == kind) & (i["status"] == "active")), lambda i: i["id"])
    most = F.coalesce(*[F.when(kind == k, n) for k, n in LIMIT.items()], F.lit((1 << 31) - 1))
    old = F.slice(active, F.lit(1), F.greatest(F.size(active) - most, F.lit(0)))
    words = X.normalize_words(new["text"])
    same = F.when(kind == "constraint", F.get(F.filter(items, lambda i: (i["kind"] == "constraint") & (i["status"] == "active") & (X.normalize_words(i["text"]) == words) & (words != "")), F.lit(0))["id"])
    cited = F.transform(items, lambda i: F.when(i["id"] == same, _cite(i, new["sources"])).otherwise(i))
    hit = lambda i: F.array_contains(ids, i["id"])
    filled = lambda own, was: F.coalesce(F.nullif(own, F.lit("")), was)
    edited = lambda i: _cite(i.withField("text", filled(op["text"], i["text"])).withField("why", filled(op["why"], i["why"])), op["add_sources"])
    point = F.array(F.struct(op["evt"].alias("start"), op["evt"].alias("end")))

    def confirmed(i: Column) -> Column:
        c = _cite(i, point)
        return c.withField("last_confirmed", F.greatest(i["last_confirmed"], op["evt"], c["last_confirmed"]))

    name = op["op"]
    return (
        F.when((name == "add") & same.isNotNull(), cited)
        .when(name == "add", _marked(longer, old, "superseded", id_))
        .when(name.isin("supersede", "merge"), _marked(longer, ids, "superseded", id_))
        .when(name == "update", F.transform(items, lambda i: F.when(hit(i), edited(i)).otherwise(i)))
        .when(name == "resolve", _marked(items, ids, "resolved", op["evt"].cast("string")))
        .when(name == "drop", _marked(items, ids, "dropped", op["reason"]))
        .when(name == "confirm", F.transform(items, lambda i: F.when(hit(i), confirmed(i)).otherwise(i)))
        .otherwise(items)
        .cast(f"array<{ITEM}>")
    )


def step(items: Column, batch: Column) -> Column:
    """STATE after one batch (chunk, evt_start, evt_end, visible, human, paths, ops): the items, and what was refused."""
    both = X.let(
        _checked(items, batch),
        lambda all_: F.struct(
            F.aggregate(F.filter(all_, lambda c: c["against"].isNull()), items.cast(f"array<{ITEM}>"), lambda acc, c: _applied(acc, c["op"])).alias("items"),
            F.filter(
                F.transform(all_, lambda c, k: F.when(c["against"].isNotNull(), F.struct(batch["chunk"].alias("chunk"), k.alias("op_index"), c["op"]["op"].alias("op"), c["against"].alias("reason")))),
                lambda r: r.isNotNull(),
            ).alias("refused"),
        ),
    )
    return both.cast(STATE)


def empty_state() -> Column:
    return F.struct(F.array().cast(f"array<{ITEM}>").alias("items"), F.array().cast(f"array<{REFUSED}>").alias("refused"))


def replayed(batches: DataFrame) -> DataFrame:
    """session_key, state of each session out of its batches (session_key, chunk, evt_start, evt_end, visible, human, paths, ops: a JSON text), in the order of
    evt_start and chunk."""
    own = with_ops(batches.withColumnRenamed("ops", "reply"))
    each = F.struct("evt_start", "chunk", "evt_end", "visible", "human", "paths", "ops")
    ordered = own.groupBy("session_key").agg(F.array_sort(F.collect_list(each)).alias("batches"))

    def on(acc: Column, batch: Column) -> Column:
        return X.let(step(acc["items"], batch), lambda d: F.struct(d["items"].alias("items"), F.concat(acc["refused"], d["refused"]).alias("refused"))).cast(STATE)

    return ordered.select("session_key", F.aggregate("batches", empty_state(), on).alias("state"))


def items_of(states: DataFrame) -> DataFrame:
    return states.select("session_key", F.inline("state.items"))


def rejections_of(states: DataFrame) -> DataFrame:
    return states.select("session_key", F.inline("state.refused"))


# ---- prompts


def state_lines(items: Column) -> Column:
    """The active items by importance, a line each: id, kind, text, last event."""
    rank = F.array(*map(F.lit, PREFIX))
    line = lambda i: F.concat(i["id"], F.lit(" "), i["kind"], F.lit(": "), i["text"], F.lit("  (evt "), i["last_confirmed"].cast("string"), F.lit(")"))
    own = F.transform(F.filter(items, lambda i: i["status"] == "active"), lambda i: F.struct(F.array_position(rank, i["kind"]).alias("r"), i["id"].alias("id"), line(i).alias("line")))
    return F.array_join(F.transform(F.array_sort(own), lambda o: o["line"]), "\n")


def prompts(frontier: DataFrame, focus: str, role: str | None = None, window: int | None = None, state_tokens: int = STATE_TOKENS) -> DataFrame:
    """The frontier with prompt and prompt_tokens, and ``role`` if it is another one.  A state above ``state_tokens`` is said to be so; a prompt above ``window`` ends the run before
    anything is asked."""
    lines = state_lines(F.col("state.items"))
    over = X.tokens(lines) - state_tokens
    notice = F.when(over > 0, F.concat(F.lit("STATE BUDGET: the state is "), over.cast("string"), F.lit(f" tokens over {state_tokens}. Merge and drop the least valuable items first, never a constraint.")))
    said = F.array_join(F.transform("last_refused", lambda r: F.concat(F.lit("- "), r["op_index"].cast("string"), F.lit(" "), r["op"], F.lit(": "), r["reason"])), "\n")
    parts = {"FOCUS": F.lit(focus or None), "NOTICE": notice, "STATE": lines, "ABOUT": F.col("about"), "CHUNK": F.col("text"), "CANDIDATES": F.nullif("notes", F.lit("")), "REFUSED": F.nullif(said, F.lit(""))}
    prompt = F.concat_ws("\n\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"# {k}\n"), v)) for k, v in parts.items()])
    out = (frontier if role is None else frontier.withColumn("role", F.lit(role))).withColumn("prompt", prompt).withColumn("prompt_tokens", X.tokens(F.col("prompt")))
    if window is not None:
        told = F.concat(F.lit("the prompt of "), F.col("session_key"), F.lit(" "), F.col("chunk"), F.lit(" has "), F.col("prompt_tokens").cast("string"), F.lit(f" tokens, the window {window}"))
        out = out.withColumn("prompt", F.when(F.col("prompt_tokens") > window, F.raise_error(told)).otherwise(F.col("prompt")))
    return out


ASKED = ["session_key", "chunk", "evt_start", "evt_end", "role", "prompt"]


def asked(prompted: DataFrame, complete: Callable[[dict], str]) -> DataFrame:
    """session_key, reply (null where the function failed), failed.  One call a row, where the rows are; a failure loses its reply only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, failed = [], []
            for row in b.to_pylist():
                try:
                    replies.append(complete(row))
                    failed.append(None)
                except Exception as why:  # noqa: BLE001  a failed call loses its chunk, not the run
                    replies.append(None)
                    failed.append(str(why))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(replies, pa.string()), pa.array(failed, pa.string())], ["session_key", "chunk", "reply", "failed"])

    return prompted.select(ASKED).mapInArrow(run, "session_key string, chunk string, reply string, failed string")


def candidates(reply: Column) -> Column:
    """The new items of a premap reply (as ops), a line each, NOTES at most."""
    named = F.filter(reply, lambda o: F.coalesce(o["item"]["text"], F.lit("")) != "")
    cited = lambda i: F.array_join(F.transform(i["sources"], lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    line = lambda o: F.concat(F.lit("- candidate "), F.coalesce(o["item"]["kind"], F.lit("item")), F.lit(": "), o["item"]["text"], F.lit(" ["), cited(o["item"]), F.lit("]"))
    return F.array_join(F.transform(F.slice(named, 1, NOTES), line), "\n")


# ---- the rounds


def run(chunks: DataFrame, complete: Callable[[dict], str], folder: str, focus: str = "", premap: bool = True, window: int | None = None) -> DataFrame:
    """session_key, state, calls, repairs, failures, processed (the chunks, in order) of each session.

    ``chunks``: session_key, place (0, 1, ... in a session, dense), chunk (its name), role (fold, or final for the recency tail), evt_start, evt_end, text, about (what the ledgers
    say of it), visible (events that the text shows), human (messages that a constraint may quote), paths.  ``complete`` gets a row of ASKED and returns a JSON text.
    Sessions of PREMAP_FROM chunks and more are read first in a pass of independent calls, all at once, whose new items go along as candidates.  Rounds are as many
    as the longest session has chunks; ``folder`` must be shared and new for each fold.
    """
    steps = Steps(chunks.sparkSession, folder)
    kept = steps.once("chunks", lambda: chunks)
    sizes = kept.groupBy("session_key").agg(F.count("*").alias("n"))
    first = kept.join(sizes, "session_key")
    none = F.array().cast(f"array<{REFUSED}>")
    if premap:

        def noted() -> DataFrame:
            bare = first.where((F.col("n") >= PREMAP_FROM) & (F.col("role") == "fold")).withColumns({"state": empty_state(), "last_refused": none, "notes": F.lit("")})
            return asked(prompts(bare, focus, "premap", window), complete)

        notes = with_ops(steps.once("premap", noted)).select("session_key", "chunk", candidates(F.col("ops")).alias("notes"), F.col("failed").isNotNull().cast("long").alias("missed"))
    else:
        notes = kept.limit(0).select("session_key", "chunk", F.lit("").alias("notes"), F.lit(0).cast("long").alias("missed"))
    all_ = steps.once("frontiers", lambda: first.join(notes, ["session_key", "chunk"], "left").withColumns({"notes": F.coalesce("notes", F.lit("")), "premapped": F.col("missed").isNotNull().cast("long"), "missed": F.coalesce("missed", F.lit(0))}).sortWithinPartitions("place"))
    last = all_.agg(F.max("place")).first()[0]
    rounds = 0 if last is None else last + 1
    counts = ["calls", "repairs", "failures"]
    stepped = step(F.col("state.items"), F.struct("chunk", "evt_start", "evt_end", "visible", "human", "paths", "ops"))  # made once: it is large
    before, finished = None, None
    for k in range(rounds):
        here = all_.where(F.col("place") == k)
        if before is None:
            here = here.withColumns({"state": empty_state(), **{c: F.lit(0).cast("long") for c in counts}, "processed": F.array().cast("array<string>")})
        else:
            here = here.join(before.select("session_key", "state", *counts, "processed"), "session_key")
        here = here.withColumns({"calls": F.col("calls") + F.col("premapped"), "failures": F.col("failures") + F.col("missed"), "last_refused": none})
        said = steps.once(f"round-{k:06d}-first", lambda here=here: asked(prompts(here, focus, None, window), complete))
        told = here.join(with_ops(said).drop("reply", "chunk"), "session_key")
        after = steps.once(
            f"round-{k:06d}-applied",
            lambda told=told: told.withColumn("_s", stepped).withColumns(
                {
                    "state": F.struct(F.col("_s.items").alias("items"), F.concat(F.col("state.refused"), F.col("_s.refused")).alias("refused")),
                    "last_refused": F.col("_s.refused"),
                    "calls": F.col("calls") + 1,
                    "failures": F.col("failures") + F.col("failed").isNotNull().cast("long"),
                }
            ).drop("_s", "ops", "failed"),
        )
        # the repair turn: what was refused is said, once
        again = after.where(F.size("last_refused") > 0)
        mended = steps.once(f"round-{k:06d}-repair", lambda again=again: asked(prompts(again, focus, "repair", window), complete))
        both = after.join(with_ops(mended).drop("reply", "chunk").withColumn("again", F.lit(1)), "session_key", "left")
        both = both.withColumns({"again": F.coalesce("again", F.lit(0)), "ops": F.coalesce("ops", F.array().cast(f"array<{OP}>"))})
        before = steps.once(
            f"round-{k:06d}-state",
            lambda both=both: both.withColumn("_s", stepped).select(
                "session_key",
                "n",
                "place",
                F.struct(F.col("_s.items").alias("items"), F.concat(F.col("state.refused"), F.col("_s.refused")).alias("refused")).alias("state"),
                (F.col("calls") + F.col("again")).alias("calls"),
                (F.col("repairs") + F.col("again")).alias("repairs"),
                (F.col("failures") + F.col("failed").isNotNull().cast("long")).alias("failures"),
                F.array_union("processed", F.array("chunk")).alias("processed"),
            ),
        )
        ended = before.where(F.col("place") == F.col("n") - 1)
        finished = ended if finished is None else finished.unionByName(ended)
        before = before.where(F.col("place") < F.col("n") - 1)
    if finished is None:
        empty = f"session_key string, state {STATE}, calls long, repairs long, failures long, processed array<string>"
        return kept.sparkSession.createDataFrame([], empty)
    return finished.select("session_key", "state", *counts, "processed")
