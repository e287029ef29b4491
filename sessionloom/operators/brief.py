"""The document of a session: typed blocks within a budget, a header that states the document's own size, an index of what isn't carried, and pointers back to it.

Budgets are folds over narrow structs (place, whether the block is mandatory, tokens), one array for each session; texts are joined to what the fold keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import segment
from sessionloom.operators.state import provenance, span

BUDGET, BRIEF, CONSTRAINTS, INDEX = 8000, 1200, 700, 1200
SIZE = "{tokens}"
BUCKET = 64
PREAMBLE = "Facts with (evt n) come from the session and can be looked up. Hard constraints are binding.\n"


# ---- blocks


def fitted(blocks: DataFrame, budget: int) -> DataFrame:
    """The blocks (session_key, place, mandatory, text) that a budget keeps, with tokens and left, what remains after each.

    In the order of place; a mandatory block is charged and always kept, however little is left; an optional one is kept whole if it fits, else dropped whole.
    """
    sized = blocks.where(F.coalesce("text", F.lit("")) != "").withColumn("tokens", X.tokens(F.col("text")))
    each = F.struct("place", "mandatory", "tokens")
    kept = "array<struct<place:int,left:bigint>>"
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(kept).alias("kept"))

    def step(s: Column, b: Column) -> Column:
        fits = b["mandatory"] | (b["tokens"] <= s["left"])
        left = F.when(fits, F.greatest(s["left"] - b["tokens"], F.lit(0))).otherwise(s["left"]).cast("bigint")
        return F.struct(left.alias("left"), F.when(fits, F.concat(s["kept"], F.array(F.struct(b["place"].cast("int").alias("place"), left.alias("left"))))).otherwise(s["kept"]).alias("kept"))

    ordered = sized.groupBy("session_key").agg(F.array_sort(F.collect_list(each)).alias("b"))
    chosen = ordered.select("session_key", F.inline(F.aggregate("b", start, step, lambda s: s["kept"])))
    return sized.join(chosen, ["session_key", "place"])


def joined(blocks: DataFrame, name: str = "text") -> DataFrame:
    """session_key and the blocks' texts, one after the other."""
    own = F.array_sort(F.collect_list(F.struct("place", "text")))
    return blocks.groupBy("session_key").agg(F.array_join(F.transform(own, lambda b: b["text"]), "").alias(name))


def listed(lines: DataFrame, head: str, budget: int, more: Callable[[Column], Column], foot: str = "\n") -> DataFrame:
    """session_key, text: ``head`` and the lines (session_key, rank, line) while they fit, the first in any case; then, if some are left, what ``more`` says of their number."""
    cost = lambda line: X.tokens(line)
    state = "struct<used:bigint,shut:boolean,n:int,out:array<string>>"
    start = F.struct(X.tokens(F.lit(head)).alias("used"), F.lit(False).alias("shut"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        shut = s["shut"] | (s["n"] > 0) & (s["used"] + x["tokens"] > budget)
        return F.when(shut, s.withField("shut", F.lit(True))).otherwise(F.struct((s["used"] + x["tokens"]).alias("used"), F.lit(False).alias("shut"), (s["n"] + 1).alias("n"), F.concat(s["out"], F.array(x["line"])).alias("out"))).cast(state)

    each = lines.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("rank", cost(F.col("line")).alias("tokens"), "line"))).alias("a"))
    done = each.select("session_key", F.size("a").alias("all"), F.aggregate("a", start, step).alias("s"))
    rest = F.when(F.col("all") > F.col("s.n"), more(F.col("all") - F.col("s.n"))).otherwise("")
    return done.select("session_key", F.concat(F.lit(head), F.array_join("s.out", ""), rest, F.lit(foot)).alias("text"))


# ---- the brief


def _active(items: DataFrame, kind: str) -> DataFrame:
    return items.where((F.col("status") == "active") & (F.col("kind") == kind))


def _cited(c: str = "sources") -> Column:
    return provenance(F.col(c))


def constraints_block(items: DataFrame, budget: int = CONSTRAINTS) -> DataFrame:
    """The hard constraints in the user's words, each once, by their words."""
    quote = F.coalesce("quote", "text")
    own = _active(items, "constraint").select("session_key", "seq", "id", quote.alias("said"), "sources")
    key = X.normalize_words(F.col("said"))
    first = own.withColumn("key", F.when(key == "", F.col("id")).otherwise(key)).groupBy("session_key", "key").agg(F.min_by(F.struct("seq", "id", "said", "sources"), "seq").alias("c")).select("session_key", "c.*")
    line = F.concat(F.lit("- ("), F.col("id"), F.lit(') "'), F.col("said"), F.lit('" '), _cited(), F.lit("\n"))
    more = lambda n: F.concat(F.lit("- … and "), n.cast("string"), F.lit(" more\n"))
    return listed(first.select("session_key", F.col("seq").alias("rank"), line.alias("line")), "**Hard constraints** (standing instructions, in the user's words)\n", budget, more)


def _item_lines(items: DataFrame, kind: str, title: str, most: int, with_why: bool = False) -> DataFrame:
    why = F.when(F.col("why").isNotNull(), F.concat(F.lit(" — "), F.col("why"))).otherwise("") if with_why else F.lit("")
    line = F.concat(F.lit("- ("), F.col("id"), F.lit(") "), F.col("text"), why, F.lit(" "), _cited(), F.lit("\n"))
    own = F.slice(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), 1, most)
    return _active(items, kind).groupBy("session_key").agg(F.concat(F.lit(f"**{title}**\n"), F.array_join(F.transform(own, lambda x: x["line"]), ""), F.lit("\n")).alias("text"))


def blocks(messages: DataFrame, items: DataFrame, commands: DataFrame, findings: DataFrame, notices: DataFrame, resolutions: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """session_key, place, mandatory, text of the brief's blocks.

    Mandatory are the notice (session_key, text) that no model, or not all of it, had a part, the findings (session_key, rank, kind, text) that speak against the state, and the hard
    constraints.  The others: the first and the last wish (``messages``: session_key, evt, text), the active goal, the current step (an item, else one of ``steps``: session_key, evt,
    text), next actions, what is done already (``resolutions``: session_key, text, command, evt), dead ends, and what to run first (``commands``: session_key, normalized, category, evt).
    """
    said = messages.groupBy("session_key").agg(F.min_by(F.struct("evt", "text"), "evt").alias("first"), F.max_by(F.struct("evt", "text"), "evt").alias("last"), F.count("*").alias("n"))
    goals = _active(items, "goal").groupBy("session_key").agg(F.min_by(F.struct("id", "text", "sources"), "seq").alias("g")).select("session_key", "g.*")
    at = lambda c: F.concat(F.lit(" [evt "), c.cast("string"), F.lit("]\n\n"))
    label = F.when(F.col("g").isNotNull(), "**Original request** (where the work started): ").otherwise("**Goal** (from the first message): ")
    wish = said.join(goals.select("session_key", F.col("id").alias("g")), "session_key", "left")
    line = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"))
    against = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- *"), F.col("kind"), F.lit("*: "), X.one_line(F.col("text"), 100), F.lit("\n")).alias("line"))))
    step = _active(items, "current_step").groupBy("session_key").agg(F.min_by(F.struct("id", "text", "sources"), "seq").alias("s")).select("session_key", F.concat(F.lit("**Current step** ("), F.col("s.id"), F.lit("): "), F.col("s.text"), F.lit(" "), provenance(F.col("s.sources")), F.lit("\n\n")).alias("text"))
    if steps is not None:
        step = step.unionByName(steps.join(step.select("session_key"), "session_key", "left_anti").select("session_key", F.concat(F.lit("**Current step** — "), F.col("text"), at(F.col("evt"))).alias("text")))
    runs = commands.where(F.col("category").isin("test", "build", "lint")).groupBy("session_key", "normalized").agg(F.max("evt").alias("evt"))
    runs = runs.groupBy("session_key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("evt")).alias("o"), "normalized"))), 1, 3).alias("r"))
    verify = F.concat(F.array(F.lit("git status"), F.lit("git log --oneline -5")), F.transform(F.coalesce("r", F.array().cast("array<struct<o:int,normalized:string>>")), lambda r: r["normalized"]))
    ticked = F.array_join(F.transform(verify, lambda c: F.concat(F.lit("- `"), c, F.lit("`\n"))), "")
    parts = [
        (True, notices.select("session_key", line.alias("text"))),
        (True, findings.groupBy("session_key").agg(F.concat(F.lit("**Before you act — the evidence contradicts this document:**\n"), F.array_join(F.transform(against, lambda x: x["line"]), ""), F.lit("\n")).alias("text"))),
        (False, wish.select("session_key", F.concat(label, X.one_line(F.col("first.text"), 75), at(F.col("first.evt"))).alias("text"))),
        (False, goals.select("session_key", F.concat(F.lit("**Active goal** ("), F.col("id"), F.lit("): "), F.col("text"), F.lit(" "), _cited(), F.lit("\n\n")).alias("text"))),
        (True, constraints_block(items)),
        (False, said.where("n > 1").select("session_key", F.concat(F.lit("**Last user request**: "), X.one_line(F.col("last.text"), 75), at(F.col("last.evt"))).alias("text"))),
        (False, step),
        (False, _item_lines(items, "next_action", "Next actions", 3)),
        (False, _item_lines(items, "dead_end", "Don't retry", 5, True)),
        (False, said.select("session_key").join(runs, "session_key", "left").select("session_key", F.concat(F.lit("**Verify first**\n"), ticked, F.lit("\n")).alias("text"))),
    ]
    if resolutions is not None:
        done = F.array_sort(F.collect_list(F.struct("evt", F.concat(F.lit("- "), X.one_line(F.col("text"), 40), F.lit(" — `"), F.col("command"), F.lit("` succeeded [evt "), F.col("evt").cast("string"), F.lit("]\n")).alias("line"))))
        parts.insert(8, (False, resolutions.groupBy("session_key").agg(F.concat(F.lit("**Already done**\n"), F.array_join(F.transform(done, lambda x: x["line"]), ""), F.lit("\n")).alias("text"))))
    out = None
    for k, (mandatory, df) in enumerate(parts):
        own = df.select("session_key", F.lit(k).alias("place"), F.lit(mandatory).alias("mandatory"), "text")
        out = own if out is None else out.unionByName(own)
    return out


def brief(all_blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """session_key, text: the brief within the smaller of its own budget and the document's."""
    head = all_blocks.select("session_key").distinct().select("session_key", F.lit("\n## L0 · Brief\n\n").alias("head"))
    return head.join(joined(fitted(all_blocks, min(BRIEF, budget)), "body"), "session_key", "left").select("session_key", F.concat("head", F.coalesce("body", F.lit(""))).alias("text"))


# ---- the header and its size


def with_size(text: Column) -> Column:
    """The text with its own size in tokens where it says SIZE: the number that is still right when it stands there."""
    bare = F.octet_length(text) - len(SIZE)
    fixed = [X.tokens_of_bytes(bare + d).cast("string") for d in range(1, 12)]
    number = F.coalesce(*[F.when(F.length(n) == d, n) for d, n in enumerate(fixed, 1)], fixed[-1])
    return F.replace(text, F.lit(SIZE), number)


def title(title_: Column, goal: Column, wish: Column, agent: Column, id_: Column) -> Column:
    """The session's title, else its goal, else twelve words of the first wish, else its agent and id."""
    words = F.array_join(F.slice(F.filter(F.split(wish, r"(?U)\s+"), lambda w: w != ""), 1, 12), " ")
    return F.coalesce(title_, goal, F.nullif(words, F.lit("")), F.concat(agent, F.lit(" session "), id_))


def header(fields: dict[str, Column]) -> Column:
    """Front matter: a line for each field that isn't null, and the size of the document itself."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("", *lines), F.lit(f"tokens: {SIZE}\n---\n"))


def document(sessions: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """session_key, markdown: of sessions (session_key, header, title), the front matter, the title and the parts (session_key, text) that there are, in order; the front matter states the
    size of the whole."""
    out = sessions.select("session_key", F.concat("header", F.lit("\n# Handoff: "), "title", F.lit("\n\n" + PREAMBLE)).alias("_0"))
    for k, part in enumerate(parts.values(), 1):
        out = out.join(part.select("session_key", F.col("text").alias(f"_{k}")), "session_key", "left")
    return out.select("session_key", with_size(F.concat_ws("", *[f"_{k}" for k in range(len(parts) + 1)])).alias("markdown"))


# ---- what isn't carried, and the way back


def index(episodes: DataFrame, budget: int = INDEX) -> DataFrame:
    """session_key, text: the episodes (session_key, evt_start, evt_end, headline, tokens) before the tail, a pointer each, while they fit; the first in any case."""
    line = F.concat(F.lit("- evt "), F.col("evt_start").cast("string"), F.lit("–"), F.col("evt_end").cast("string"), F.lit(" · "), X.one_line(F.col("headline"), 30), F.lit(" · "), F.col("tokens").cast("string"), F.lit("\n"))
    more = lambda n: F.concat(F.lit("- … and "), n.cast("string"), F.lit(" more episode(s)\n"))
    total = episodes.groupBy("session_key").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    lines = listed(episodes.select("session_key", F.col("evt_start").alias("rank"), line.alias("line")), "", budget, more, "")
    head = F.concat(F.lit("\n## L3 · Retrieval\n\n**Not carried verbatim** — "), F.col("n").cast("string"), F.lit(" episode(s), "), F.col("t").cast("string"), F.lit(" token(s), all reachable:\n"))
    return lines.join(total, "session_key").select("session_key", F.concat(head, F.col("text")).alias("text"))


def pointers(text: Column) -> Column:
    """The ranges (start, end) that an index points at."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^- evt ([0-9]+–[0-9]+) ·"), F.lit(1))
    return F.transform(found, lambda p: F.struct(F.substring_index(p, "–", 1).cast("int").alias("start"), F.substring_index(p, "–", -1).cast("int").alias("end")))


def item_pointers(items: DataFrame, most: int = 4) -> DataFrame:
    """session_key, id, start, end: the spans of the current step, next actions and dead ends, the first ``most``."""
    rank = F.array_position(F.array(*map(F.lit, ["current_step", "next_action", "dead_end"])), F.col("kind")).cast("int")
    own = items.where((F.col("status") == "active") & (F.size("sources") > 0) & (rank > 0)).select("session_key", rank.alias("r"), "seq", "id", span(F.col("sources")).alias("span"))
    first = own.groupBy("session_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "seq", "id", "span"))), 1, most).alias("a"))
    return first.select("session_key", F.explode("a").alias("x")).select("session_key", "x.id", "x.span.start", "x.span.end")


def expanded(rows: DataFrame, ranges: DataFrame, context: int = 0) -> DataFrame:
    """session_key, range_id, start, end (with the context), evt, text, tokens: the rows (session_key, evt, text, tokens) of each range (session_key, range_id, start, end).  A range
    without rows has one with a null evt.

    Rows and ranges meet by blocks of BUCKET events, so a session's ranges meet only the rows near them.
    """
    wide = ranges.select("session_key", "range_id", F.greatest(F.col("start") - context, F.lit(0)).cast("int").alias("start"), (F.col("end") + context).cast("int").alias("end"))
    block = lambda c: F.floor(c / BUCKET)
    spread = wide.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.greatest("end", "start")))))
    met = spread.join(rows.select("session_key", "evt", "text", "tokens", block(F.col("evt")).alias("_block")), ["session_key", "_block"]).where("evt BETWEEN start AND end").drop("_block", "start", "end")
    return wide.join(met, ["session_key", "range_id"], "left")


def paged(found: DataFrame, tokens: int) -> DataFrame:
    """The rows of ``expanded`` with page and pages: consecutive rows of a range within ``tokens``; a larger row is a page of its own."""
    key = F.concat_ws("\x00", "session_key", F.col("range_id").cast("string"))
    own = found.where("evt IS NOT NULL").withColumn("_key", key)
    cut = segment.pages(own.select(F.col("_key").alias("session_key"), "evt", "tokens"), tokens).select(F.col("session_key").alias("_key"), "page", "row_start", "row_end")
    placed = segment.positions(own.withColumn("_session", F.col("session_key")).withColumn("session_key", F.col("_key")))
    last = cut.groupBy("_key").agg((F.max("page") + 1).alias("pages"))
    met = placed.join(cut, "_key").where("pos BETWEEN row_start AND row_end").join(last, "_key")
    return met.select(F.col("_session").alias("session_key"), "range_id", "start", "end", "evt", "text", "tokens", (F.col("page") + 1).cast("int").alias("page"), "pages")


def delivered(found: DataFrame, page: Column, tokens: int) -> DataFrame:
    """session_key, range_id, text: one page of each range with a head that says where it stands; ``page`` may depend on range_id, and one beyond the last gives the last."""
    pages = paged(found, tokens).withColumn("_want", F.least(page, F.col("pages"))).where(F.col("page") == F.col("_want"))
    body = F.array_sort(F.collect_list(F.struct("evt", F.concat("text", F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")\n")).alias("line"))))
    per = pages.groupBy("session_key", "range_id", "start", "end", "page", "pages").agg(body.alias("b"), F.sum("tokens").alias("t"))
    n = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("=== evt "), n("start"), F.lit("–"), n("end"), F.lit(" · page "), n("page"), F.lit("/"), n("pages"), F.lit(" · evt "), F.col("b")[0]["evt"].cast("string"), F.lit("–"), F.element_at("b", -1)["evt"].cast("string"), F.lit(" · "), n("t"), F.lit(" token(s) ===\n"))
    onward = F.when(F.col("pages") > 1, F.concat(F.lit("\n--- page "), n("page"), F.lit(" of "), n("pages"), F.lit("; next: "), F.when(F.col("page") == F.col("pages"), 1).otherwise(F.col("page") + 1).cast("string"), F.lit(" ---\n"))).otherwise("")
    shown = per.select("session_key", "range_id", F.concat(head, F.array_join(F.transform("b", lambda x: x["line"]), ""), onward).alias("text"))
    none = found.where("evt IS NULL").select("session_key", "range_id", F.concat(F.lit("=== evt "), n("start"), F.lit("–"), n("end"), F.lit(" ===\n(no rows in this range)\n")).alias("text"))
    return shown.unionByName(none)
