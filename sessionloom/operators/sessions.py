"""Facts on whole sessions: metadata, compactions, budgets, findings, rankings and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as X

LEDGER_TOKENS, ITEM_TOKENS, RECENCY_HOURS = 12_000, 200, {"day": 24, "week": 168, "month": 720}


def meta(lines: DataFrame) -> DataFrame:
    """session_key, id, cwd, git_branch, version, forked_from, title (the last), models (sorted), started_at, ended_at: the first of each in line order."""
    get = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object("raw", f"$.{k}"), F.lit("")) for k in keys])
    at = F.struct("path_ix", "line_no")
    header = get("type") == "session"
    rows = lines.select(
        "session_key",
        at.alias("at"),
        F.coalesce(get("sessionId", "payload.meta.id"), F.when(get("type") == "session_meta", get("payload.id")), F.when(header, get("id"))).alias("id"),
        get("cwd", "payload.meta.cwd", "payload.cwd").alias("cwd"),
        get("gitBranch", "payload.git.branch").alias("git_branch"),
        F.coalesce(get("payload.meta.cli_version", "agentVersion"), F.when(~header, get("version"))).alias("version"),
        get("payload.meta.forked_from_id", "parentSession", "parentSessionId").alias("forked_from"),
        F.coalesce(get("summary"), F.when(get("type").isin("label", "sessionInfo", "session_info"), get("title", "label", "name"))).alias("title"),
        F.coalesce(get("message.model"), F.when(get("type").isin("turn_context"), get("payload.model")), F.when(get("type").isin("modelChange", "model_change"), get("model", "to"))).alias("model"),
        get("timestamp", "time").alias("ts"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("session_key").agg(
        *map(first, ["id", "cwd", "git_branch", "version", "forked_from"]),
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("at"))).alias("title"),
        F.array_sort(F.collect_set("model")).alias("models"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
    )


def compactions(events: DataFrame) -> DataFrame:
    """session_key, evt, summary, windowed."""
    own = events.where("kind = 'compaction_summary' OR (kind = 'system' AND subtype = 'native_compaction')")
    return own.select("session_key", F.col("idx").alias("evt"), F.when(F.col("kind") == "compaction_summary", F.col("text")).alias("summary"), F.coalesce("windowed", F.lit(False)).alias("windowed"))


NO_SUMMARY = "(a boundary without a readable summary)"


def prior_summaries(found: DataFrame, chunks: DataFrame, most: int = 3, tokens: int = 400) -> DataFrame:
    """session_key, chunk, evt, text: of the summaries (session_key, evt, text) before each chunk (session_key, chunk, evt_start) the latest, in order; each cut to ``tokens``
    and on one line, a boundary without text with words that say so.

    One window over both sides, whose frame never holds more than ``most`` summaries of the rows before.
    """
    own = F.struct("evt", F.coalesce(F.replace(X.truncate_tokens(F.col("text"), tokens), F.lit("\n"), F.lit(" ")), F.lit(NO_SUMMARY)).alias("text"))
    a = chunks.select("session_key", "chunk", F.col("evt_start").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(found.select(own).schema[0].dataType).alias("_s"))
    b = found.select("session_key", F.lit(None).cast(chunks.schema["chunk"].dataType).alias("chunk"), F.col("evt").alias("_at"), F.lit(1).alias("_side"), own.alias("_s"))
    order = Window.partitionBy("session_key").orderBy("_at", "_side")  # of one place, the chunk comes first: its own boundary isn't before it
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_n", F.count("_s").over(upto))
    last = Window.partitionBy("session_key").orderBy("_n").rangeBetween(1 - most, 0)
    near = both.withColumn("_last", F.collect_list("_s").over(last)).where("_side = 0 AND _n > 0")
    return near.select("session_key", "chunk", F.explode("_last").alias("_s")).select("session_key", "chunk", "_s.evt", "_s.text")


def later_index(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_key, chunk, later: the numbers of the episodes after each chunk's last (``last_episode``).

    The numbers of a session are sorted once, and each chunk takes what comes behind the place of its last.
    """
    every = episodes.groupBy("session_key").agg(F.array_sort(F.collect_set("episode")).alias("_all"))
    both = chunks.join(every, "session_key", "left")
    behind = F.filter(F.coalesce("_all", F.array().cast(every.schema["_all"].dataType)), lambda e: e > F.col("last_episode"))
    return both.select("session_key", "chunk", behind.alias("later"))


def without_repeats(rows: DataFrame, value: str) -> DataFrame:
    """The rows (session_key, evt, value) whose value isn't the one just before."""
    w = Window.partitionBy("session_key").orderBy("evt")
    before = F.lag(value).over(w)
    return rows.withColumn("_same", F.coalesce(before.eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), F.lit(False))).where("NOT _same").drop("_same")


def numbered(rows: DataFrame, kind: str, order: str, prefix: Column) -> DataFrame:
    """The rows with an id: their prefix and their number in the session's rows of that kind."""
    return rows.withColumn("id", F.concat(prefix, F.row_number().over(Window.partitionBy("session_key", kind).orderBy(order)).cast("string")))


def token_accounting(lines: DataFrame, rows: DataFrame, tail_rows: DataFrame) -> DataFrame:
    """session_key, raw, masked, tail: tokens of the files (bytes / 4), of the masked rows and of the tail."""
    raw = lines.groupBy("session_key").agg(F.floor(F.sum(F.octet_length("raw") + 1) / 4).alias("raw"))
    total = lambda df, name: df.groupBy("session_key").agg(F.sum("tokens").alias(name))
    return raw.join(total(rows, "masked"), "session_key", "left").join(total(tail_rows, "tail"), "session_key", "left").na.fill(0)


def prompt_budget(base: Column, memory: Column, rows: Column, prior: Column, question: Column, reserve: Column, context: int, completion: int) -> Column:
    """What is left of a context window after a prompt's parts; negative if they don't fit."""
    return F.lit(context - completion) - (base + memory + rows + prior + question + reserve)


def semantic_status(requested: Column, available: Column, failures: Column) -> Column:
    return F.when(~requested, "not_requested").when(~available, "unavailable").when(failures > 0, "degraded").otherwise("ok")


def finding_counts(found: DataFrame) -> DataFrame:
    """session_key and the number of findings of each kind (session_key, finding)."""
    kinds = ["contradicted", "missing", "changed", "known"]
    return found.groupBy("session_key").agg(*[F.count_if(F.col("finding") == k).alias(k) for k in kinds])


def findings(counts: DataFrame, commits_since: DataFrame, missing_commits: DataFrame, errors: DataFrame) -> DataFrame:
    """session_key, label, text: what the evidence says at the end, by label.

    counts as from ``finding_counts``; commits_since and missing_commits (session_key, n); errors (session_key, sig, status).
    """
    stale = (F.col("missing") + F.col("changed")) / F.greatest(F.col("missing") + F.col("changed") + F.col("known") + F.col("contradicted"), F.lit(1))
    say = lambda df, label, text, cond: df.where(cond).select("session_key", F.lit(label).alias("label"), text.alias("text"))
    open_ = errors.where("status = 'unresolved'").groupBy("session_key").agg(F.count("*").alias("n"))
    parts = [
        say(commits_since, "repo_moved", F.concat(F.col("n").cast("string"), F.lit(" commits since the session")), F.col("n") > 0),
        say(counts, "contradicted", F.concat(F.col("contradicted").cast("string"), F.lit(" deleted files are there")), F.col("contradicted") > 0),
        say(counts, "missing", F.concat(F.col("missing").cast("string"), F.lit(" files are gone")), F.col("missing") > 0),
        say(counts, "stale", F.when(stale >= 0.25, "much of it is stale").otherwise("some of it is stale"), F.col("missing") + F.col("changed") > 0),
        say(missing_commits, "missing_commits", F.concat(F.col("n").cast("string"), F.lit(" commits aren't in the repository")), F.col("n") > 0),
        say(open_, "unresolved", F.concat(F.col("n").cast("string"), F.lit(" errors are open")), F.col("n") > 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CATEGORY_RANK = ["test", "build", "lint", "git", "package_manager", "run", "other"]


def next_actions(runs: DataFrame, errors: DataFrame, failures: int = 3, open_errors: int = 2, most: int = 4) -> DataFrame:
    """session_key, rank, action: the last failing commands by category and recency, each once, then open errors by frequency."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORY_RANK)), F.col("category")).cast("int")
    last = runs.groupBy("session_key", "normalized").agg(F.max_by(F.struct("failed", "category", "evt"), "evt").alias("l"))
    bad = last.where("l.failed").select("session_key", F.col("l.category").alias("category"), (-F.col("l.evt")).alias("back"), F.concat(F.lit("fix: "), "normalized").alias("action"))
    bad = bad.select("session_key", F.lit(0).alias("a"), rank.alias("b"), "back", "action")
    w = Window.partitionBy("session_key").orderBy("a", "b", "back", "action")
    bad = bad.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= failures).drop("_r")
    open_ = errors.where("status = 'unresolved'").select("session_key", F.lit(1).alias("a"), (-F.col("occurrences")).cast("int").alias("b"), F.lit(0).alias("back"), F.concat(F.lit("resolve: "), "sig").alias("action"))
    open_ = open_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= open_errors).drop("_r")
    return bad.unionByName(open_).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("session_key", "rank", "action")


def ledger_slice(entries: DataFrame, budget: int = LEDGER_TOKENS, item: int = ITEM_TOKENS) -> DataFrame:
    """session_key, section, rank, text of the entries (the same columns) that a shared budget holds: in order of section and rank, each cut to ``item`` tokens
    and costing two more, for its separator.  A section ends at the first that doesn't fit, but its first entry is always kept: an empty section would say that
    there is nothing."""
    cut = entries.withColumn("text", X.truncate_tokens(F.col("text"), item)).withColumn("cost", X.tokens(F.col("text")) + 2)
    a = cut.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("section", "rank", "cost"))).alias("a"))
    kept = "array<struct<section:int,rank:int>>"
    state = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(-1).alias("section"), F.lit(False).alias("shut"), F.array().cast(kept).alias("out"))

    def step(s: Column, x: Column) -> Column:
        first = s["section"] != x["section"]
        fits = first | ((x["cost"] <= s["left"]) & ~s["shut"])
        return F.struct(
            F.when(fits, F.greatest(s["left"] - x["cost"], F.lit(0))).otherwise(s["left"]).cast("bigint").alias("left"),
            x["section"].cast("int").alias("section"),
            (~fits).alias("shut"),
            F.when(fits, F.concat(s["out"], F.array(F.struct(x["section"].cast("int").alias("section"), x["rank"].cast("int").alias("rank"))))).otherwise(s["out"]).alias("out"),
        )

    chosen = a.select("session_key", F.explode(F.aggregate("a", state, step, lambda s: s["out"])).alias("k")).select("session_key", "k.section", "k.rank")
    return cut.join(chosen, ["session_key", "section", "rank"]).select("session_key", "section", "rank", "text")


def busiest(files: DataFrame) -> DataFrame:
    """session_key, path: the edited file with most edits; the longer path, then the later in order, if several have as many."""
    return files.where("edits > 0").groupBy("session_key").agg(F.max_by("path", F.struct("edits", F.length("path"), "path")).alias("path"))


def browse(summaries: DataFrame, agent: str | None = None, recency: str | None = None, now: str | None = None, query: str | None = None) -> DataFrame:
    """Summaries of an agent that ended within a day, week or month before ``now`` and match the query: beginnings of ids first, then text, latest first."""
    out = summaries if agent is None else summaries.where(F.col("agent") == agent)
    if recency is not None:
        edge = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(RECENCY_HOURS[recency]))
        out = out.where(F.try_to_timestamp("ended_at") >= edge)
    if query:
        q = query.lower()
        hay = F.lower(F.concat_ws(" ", "title", "first_message", "cwd"))
        loose = F.regexp_like(hay, F.lit(".*?".join(X.quoted(c) for c in q)))
        rank = F.when(F.startswith(F.lower("id"), F.lit(q)), 0).when(F.contains(hay, F.lit(q)), 1).when(loose, 2)
        out = out.withColumn("match", rank).where("match IS NOT NULL").orderBy("match", F.desc("ended_at"), "session_key")
    return out


def unknown_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """The items (session_key, id, text) that mention a path (with / and .) that is part of none of the session's paths (session_key, path)."""
    words = F.filter(F.transform(F.split(F.trim("text"), r"\s+"), lambda w: F.regexp_replace(w, F.lit("^[`'\",;:()\\[\\]]+|[`'\",;:()\\[\\]]+$"), F.lit(""))), lambda w: F.contains(w, F.lit("/")) & F.contains(w, F.lit(".")) & ~F.contains(w, F.lit("://")))
    each = items.select("session_key", "id", F.explode(F.array_distinct(words)).alias("word"))
    known = each.join(paths, "session_key").where(F.contains("path", F.col("word"))).select("session_key", "id", "word").distinct()
    return each.join(known, ["session_key", "id", "word"], "left_anti").select("session_key", "id").distinct()


def quoted_items(items: DataFrame, messages: DataFrame) -> DataFrame:
    """The items (session_key, id, quote) whose normalised quote is in a human message (session_key, text) of the session."""
    said = messages.select("session_key", X.normalize_quote(F.col("text")).alias("said"))
    own = items.withColumn("_q", X.normalize_quote(F.col("quote")))
    return own.join(said, (own["session_key"] == said["session_key"]) & (F.col("_q") != "") & F.contains("said", F.col("_q")), "left_semi").drop("_q")


def visible_sources(items: DataFrame, rows: DataFrame) -> DataFrame:
    """The items (session_key, id, sources) with a source range that holds the event of a row (session_key, evt)."""
    each = items.select("session_key", "id", F.explode("sources").alias("r"))
    hit = each.join(rows.select("session_key", "evt"), "session_key").where(F.col("evt").between(F.col("r.start"), F.col("r.end")))
    return items.join(hit.select("session_key", "id").distinct(), ["session_key", "id"], "left_semi")


def dry_run(events: DataFrame, rows: DataFrame, episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """session_key, events, rows, tokens, episodes, chunks, calls: what an extraction with a model would do, without one."""
    n = lambda df, name: df.groupBy("session_key").agg(F.count("*").alias(name))
    out = n(events, "events").join(rows.groupBy("session_key").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "session_key", "left")
    out = out.join(n(episodes, "episodes"), "session_key", "left").join(n(chunks, "chunks"), "session_key", "left").na.fill(0)
    return out.withColumn("calls", F.col("chunks") + 1)


def preview(files: DataFrame, runs: DataFrame, errors: DataFrame, most: int = 8) -> DataFrame:
    """session_key, files (the busiest), last_command, open_errors."""
    busy = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-(F.col("edits") + F.col("reads"))).alias("n"), "path"))), 1, most), lambda f: f["path"])
    last = runs.groupBy("session_key").agg(F.max_by("normalized", "evt").alias("last_command"))
    open_ = errors.groupBy("session_key").agg(F.count_if(F.col("status") == "unresolved").alias("open_errors"))
    return files.groupBy("session_key").agg(busy.alias("files")).join(last, "session_key", "full").join(open_, "session_key", "full").na.fill({"open_errors": 0})
