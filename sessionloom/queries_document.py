"""Queries over the document: budgeted blocks, the self-stating header, the index, its pointers and their expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import brief, finish, ledgers, segment, state, steps
from sessionloom.queries import BUDGET, CONV, ERRORS, MASKED, MERGED, MIN_EPISODE, OPS, WORK, query, rows, sessions, tool_sessions

BLOCKS, SHORT, PAGE = 150, 40, 120

KEPT = f"""{CONV}, b AS (
  SELECT session_key, idx AS place, idx % 3 = 0 AS m, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, text, row_number() OVER (PARTITION BY session_key ORDER BY idx) AS k FROM conv WHERE text <> ''), w AS (
  SELECT session_key, 0 AS k, CAST({BLOCKS} AS BIGINT) AS room, -1 AS place, false AS kept FROM b GROUP BY session_key
  UNION ALL
  SELECT b.session_key, b.k, CASE WHEN b.m OR b.tokens <= w.room THEN greatest(w.room - b.tokens, 0) ELSE w.room END, b.place, b.m OR b.tokens <= w.room FROM w JOIN b ON b.session_key = w.session_key AND b.k = w.k + 1)"""


def _kept(spark, sf_dir) -> DataFrame:
    """Each turn is a block, every third a mandatory one."""
    return brief.fitted(sessions(spark, sf_dir).select("session_key", F.col("idx").alias("place"), (F.col("idx") % 3 == 0).alias("mandatory"), "text"), BLOCKS)


@query(f"WITH RECURSIVE {KEPT} SELECT session_key, place, room FROM w WHERE kept")
def brief_blocks(spark, sf_dir):
    return _kept(spark, sf_dir).select("session_key", "place", F.col("left").alias("room"))


@query(
    f"""WITH RECURSIVE {KEPT}, body AS (SELECT w.session_key, string_agg(b.text, '' ORDER BY w.place) AS body FROM w JOIN b ON b.session_key = w.session_key AND b.place = w.place WHERE kept GROUP BY w.session_key),
s AS (SELECT session_key, count(*) AS n, arg_min(text, idx) FILTER (kind = 'user_message') AS wish FROM conv GROUP BY session_key), d AS (
  SELECT s.session_key, '---' || chr(10) || 'session: ' || s.session_key || chr(10) || 'events: ' || n || chr(10) || 'tokens: ' AS pre,
    chr(10) || '---' || chr(10) || chr(10) || '# Handoff: ' || CASE WHEN CAST(s.session_key AS BIGINT) % 2 = 1 THEN 'aim ' || s.session_key
      ELSE coalesce(nullif(array_to_string(list_slice(list_filter(string_split_regex(wish, '\\s+'), lambda x: x <> ''), 1, 12), ' '), ''), 'tree session ' || s.session_key) END || chr(10) || chr(10) || '{brief.PREAMBLE.strip()}' || chr(10) || coalesce(body, '') AS post
  FROM s LEFT JOIN body ON body.session_key = s.session_key), z AS (
  SELECT session_key, pre, post, (SELECT min(k) FROM (SELECT CAST(ceil((strlen(pre) + strlen(post) + g) / 4.0) AS BIGINT) AS k, g FROM range(1, 12) r(g)) WHERE length(CAST(k AS VARCHAR)) = g) AS stated FROM d)
SELECT session_key, stated, CAST(ceil(strlen(pre || stated || post) / 4.0) AS BIGINT) AS real, md5(pre || stated || post) AS hash FROM z"""
)
def sized_documents(spark, sf_dir):
    """The documents of all conversations: their headers state their own sizes."""
    s = sessions(spark, sf_dir)
    per = s.groupBy("session_key").agg(F.count("*").alias("n"), F.min_by(F.when(F.col("kind") == "user_message", F.col("text")), F.when(F.col("kind") == "user_message", F.col("idx"))).alias("wish"))
    goal = F.when(F.col("session_key").cast("long") % 2 == 1, F.concat(F.lit("aim "), "session_key"))
    named = per.select("session_key", brief.header({"session": F.col("session_key"), "events": F.col("n"), "branch": F.lit(None)}).alias("header"), brief.title(F.lit(None).cast("string"), goal, F.col("wish"), F.lit("tree"), F.col("session_key")).alias("title"))
    made = brief.document(named, {"body": brief.joined(_kept(spark, sf_dir))})
    return made.select("session_key", F.regexp_extract("markdown", r"tokens: ([0-9]+)\n---", 1).cast("long").alias("stated"), X.tokens(F.col("markdown")).alias("real"), F.md5("markdown").alias("hash"))


BEFORE = f"""{MERGED}, t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_key ORDER BY episode DESC) AS upto FROM merged), u AS (
  SELECT *, (upto - tokens = 0) OR (upto <= {BUDGET} AND upto - tokens < {BUDGET}) AS own FROM t), x AS (
  SELECT *, bool_and(own) OVER (PARTITION BY session_key ORDER BY episode DESC) AS in_tail FROM u), ev AS (
  SELECT x.session_key, x.episode, x.tokens, min(r.evt) AS a, max(r.evt) AS z, arg_min(left(trim(regexp_replace(r.raw_text, '\\s+', ' ', 'g')), 20), r.evt) AS head FROM x
  JOIN (SELECT session_key, evt, pos, text AS raw_text FROM rows_) r ON r.session_key = x.session_key AND r.pos BETWEEN x.row_start AND x.row_end WHERE NOT in_tail GROUP BY ALL)"""
LINE = "'- evt ' || a || '–' || z || ' · e' || episode || ' · ' || tokens || chr(10)"


def _before_tail(spark, sf_dir) -> DataFrame:
    """The episodes that the recency tail leaves out, as events."""
    own = rows(spark, sf_dir)
    marked = segment.tail(segment.episodes(own, MIN_EPISODE), BUDGET).where("NOT in_tail")
    placed = segment.positions(own).select("session_key", "pos", "evt")
    edge = lambda c: placed.select("session_key", F.col("pos").alias(f"row_{c}"), F.col("evt").alias(f"evt_{c}"))
    found = marked.join(edge("start"), ["session_key", "row_start"]).join(edge("end"), ["session_key", "row_end"])
    return found.withColumn("headline", F.concat(F.lit("e"), F.col("episode").cast("string")))


@query(
    f"""WITH RECURSIVE {BEFORE}, l AS (SELECT session_key, {LINE} AS line, CAST(ceil(strlen({LINE}) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY session_key ORDER BY a) AS k, count(*) OVER (PARTITION BY session_key) AS n, CAST(sum(tokens) OVER (PARTITION BY session_key) AS BIGINT) AS t FROM ev), w2 AS (
  SELECT session_key, k, cost AS used, line AS shown, 1 AS c, false AS shut FROM l WHERE k = 1
  UNION ALL
  SELECT l.session_key, l.k, CASE WHEN w2.shut OR w2.used + l.cost > {SHORT} THEN w2.used ELSE w2.used + l.cost END, CASE WHEN w2.shut OR w2.used + l.cost > {SHORT} THEN w2.shown ELSE w2.shown || l.line END,
    CASE WHEN w2.shut OR w2.used + l.cost > {SHORT} THEN w2.c ELSE w2.c + 1 END, w2.shut OR w2.used + l.cost > {SHORT} FROM w2 JOIN l ON l.session_key = w2.session_key AND l.k = w2.k + 1)
SELECT w2.session_key, chr(10) || '## L3 · Retrieval' || chr(10) || chr(10) || '**Not carried verbatim** — ' || n || ' episode(s), ' || t || ' token(s), all reachable:' || chr(10) || shown || CASE WHEN c < n THEN '- … and ' || (n - c) || ' more episode(s)' || chr(10) ELSE '' END AS text
FROM w2 JOIN l ON l.session_key = w2.session_key AND l.k = w2.k WHERE l.k = l.n"""
)
def retrieval_index(spark, sf_dir):
    return brief.index(_before_tail(spark, sf_dir), SHORT)


@query(f"WITH RECURSIVE {BEFORE} SELECT ev.session_key, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS stop, count(r.evt) AS n, CAST(sum(r.tokens) AS BIGINT) AS tokens FROM ev JOIN rows_ r ON r.session_key = ev.session_key AND r.evt BETWEEN a AND z GROUP BY ALL")
def resolved_pointers(spark, sf_dir):
    """Every pointer of every session's index, out of the index's own text, and the rows it leads to."""
    text = brief.index(_before_tail(spark, sf_dir))
    ranges = text.select("session_key", F.posexplode(brief.pointers(F.col("text"))).alias("range_id", "p")).select("session_key", "range_id", "p.start", "p.end")
    found = brief.expanded(rows(spark, sf_dir), ranges)
    return found.groupBy("session_key", "start", F.col("end").alias("stop")).agg(F.count("evt").alias("n"), F.sum("tokens").alias("tokens"))


@query(
    f"""WITH RECURSIVE {MASKED}, g AS (SELECT session_key, idx AS range_id, greatest(idx - 1, 0) AS a, idx + 3 AS z FROM conv WHERE idx % 2 = 0), r AS (
  SELECT g.session_key, range_id, a, z, m.evt, m.text, m.tokens, row_number() OVER (PARTITION BY g.session_key, range_id ORDER BY m.evt) AS k FROM g JOIN rows_ m ON m.session_key = g.session_key AND m.evt BETWEEN a AND z), p AS (
  SELECT session_key, range_id, k, evt, tokens AS acc, 1 AS page FROM r WHERE k = 1
  UNION ALL
  SELECT r.session_key, r.range_id, r.k, r.evt, CASE WHEN p.acc + r.tokens > {PAGE} THEN r.tokens ELSE p.acc + r.tokens END, CASE WHEN p.acc + r.tokens > {PAGE} THEN p.page + 1 ELSE p.page END FROM p JOIN r ON r.session_key = p.session_key AND r.range_id = p.range_id AND r.k = p.k + 1), c AS (
  SELECT session_key, range_id, max(page) AS pages FROM p GROUP BY ALL), o AS (
  SELECT r.session_key, r.range_id, a, z, p.page, c.pages, min(r.evt) AS lo, max(r.evt) AS hi, sum(r.tokens) AS t, string_agg(r.text || '  (evt ' || r.evt || ')' || chr(10), '' ORDER BY r.evt) AS body
  FROM r JOIN p ON p.session_key = r.session_key AND p.range_id = r.range_id AND p.k = r.k JOIN c ON c.session_key = r.session_key AND c.range_id = r.range_id WHERE p.page = least(r.range_id % 3 + 1, c.pages) GROUP BY ALL)
SELECT session_key, range_id, '=== evt ' || a || '–' || z || ' · page ' || page || '/' || pages || ' · evt ' || lo || '–' || hi || ' · ' || t || ' token(s) ===' || chr(10) || body
  || CASE WHEN pages > 1 THEN chr(10) || '--- page ' || page || ' of ' || pages || '; next: ' || CASE WHEN page = pages THEN 1 ELSE page + 1 END || ' ---' || chr(10) ELSE '' END AS text FROM o
UNION ALL SELECT session_key, range_id, '=== evt ' || a || '–' || z || ' ===' || chr(10) || '(no rows in this range)' || chr(10) FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.session_key = g.session_key AND r.range_id = g.range_id)"""
)
def expanded_pages(spark, sf_dir):
    """A range around every second turn of every session, one event of context, a page of each."""
    ranges = sessions(spark, sf_dir).where("idx % 2 = 0").select("session_key", F.col("idx").alias("range_id"), F.col("idx").alias("start"), (F.col("idx") + 2).alias("end"))
    return brief.delivered(brief.expanded(rows(spark, sf_dir), ranges, 1), F.col("range_id") % 3 + 1, PAGE)


# ---- the end of a session

ACTIONS = """acts AS (SELECT session_key, evt, 'N' || row_number() OVER (PARTITION BY session_key ORDER BY evt) AS id, normalized FROM run WHERE failed)"""


#: What the queries below read of a ledger; the rest is not made.
READ = {
    "commands": ["session_key", "evt", "normalized", "category", "failed", "output_head", "output_tail"],
    "files": ["session_key", "path", "deleted", "edits", "last_evt", "inferred"],
}


def _ledgers(spark, sf_dir, *names: str) -> list[DataFrame]:
    """The named ledgers (commands, files) of the sessions made from events, each made once in the shared folder, as several plans read them."""
    found, made = tool_sessions(spark, sf_dir), steps.Steps(spark, steps.new_folder(spark, "ledgers"))
    return [made.once(name, lambda make=getattr(ledgers, name): make(found).select(READ[name])) for name in names]


def _item(id_: Column, kind: str, text: Column, evt: str) -> list[Column]:
    at = F.array(F.struct(F.col(evt).cast("int").alias("start"), F.col(evt).cast("int").alias("end")))
    rest = [F.lit("active").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(0).alias("last_confirmed")]
    return [F.col("session_key"), id_.alias("id"), F.lit(kind).alias("kind"), text.alias("text"), at.alias("sources"), *rest]


def _actions(runs: DataFrame) -> DataFrame:
    """Each failed run makes an action of its command."""
    order = F.row_number().over(Window.partitionBy("session_key").orderBy("evt"))
    return runs.where("failed").select(*_item(F.concat(F.lit("N"), order), "next_action", F.concat(F.lit("mend, then run  "), F.upper("normalized")), "evt"))


def _decisions(files: DataFrame) -> DataFrame:
    """Each edited file makes a decision."""
    return files.where("edits > 0").select(*_item(F.concat(F.lit("D"), "path"), "decision", F.concat(F.lit("keep `"), F.col("path"), F.lit("`")), "last_evt"))


@query(f"WITH {WORK}, {ACTIONS} SELECT a.session_key, a.id, CASE WHEN min(r.evt) IS NULL THEN 'active' ELSE 'resolved' END AS status, coalesce(CAST(min(r.evt) AS VARCHAR), '') AS detail FROM acts a LEFT JOIN run r ON r.session_key = a.session_key AND r.normalized = a.normalized AND NOT r.failed AND r.evt > a.evt GROUP BY ALL")
def resolved_actions(spark, sf_dir):
    """Actions whose command succeeded later are done."""
    (runs,) = _ledgers(spark, sf_dir, "commands")
    items = _actions(runs)
    done = state.satisfied(items, runs)
    return finish.with_resolved(items, done).select("session_key", "id", "status", F.coalesce("detail", F.lit("")).alias("detail"))


THERE = ("src/m0.rs", "src/m1.rs", "src/m2.rs")


@query(
    f"""WITH {ERRORS}, {OPS}, fs AS (SELECT DISTINCT session_key, CAST(session_key AS BIGINT) % 3 AS k FROM w), ff AS (SELECT *, path IN {THERE} AS there FROM led WHERE NOT inferred),
fm AS (SELECT session_key, count(*) AS n, array_to_string(list_slice(list(path ORDER BY path), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ', and ' || (count(*) - 3) || ' more' ELSE '' END AS shown FROM ff WHERE NOT there GROUP BY session_key),
fg AS (SELECT session_key, list_sort(list(DISTINCT left(md5(CAST(event_id AS VARCHAR)), 8))) AS lost FROM run WHERE NOT failed AND event_id % 4 = 2 GROUP BY session_key),
fv AS (SELECT session_key, count(*) FILTER (NOT there OR path = 'src/m1.rs') AS stale, count(*) AS checked FROM ff WHERE edits > 0 GROUP BY session_key),
fe AS (SELECT session_key, arg_min(example, (-occurrences, sig)) AS worst FROM errs WHERE status = 'unresolved' GROUP BY session_key),
fa AS (SELECT DISTINCT session_key FROM run WHERE failed)
SELECT session_key, 0 AS rank, 'moved on' AS kind, k || ' commit(s) came after this session, the newest: c1' AS text FROM fs WHERE k > 0
UNION ALL SELECT session_key, 2, 'missing', n || ' file(s) that were worked on are gone: ' || shown FROM fm
UNION ALL SELECT session_key, 3, 'unreachable', len(lost) || ' recorded commit(s) can''t be reached any more: ' || array_to_string(list_slice(lost, 1, 3), ', ') || CASE WHEN len(lost) > 3 THEN ', and ' || (len(lost) - 3) || ' more' ELSE '' END FROM fg
UNION ALL SELECT session_key, 4, 'uncommitted', '2 change(s) lie uncommitted in the working tree' FROM fs WHERE k = 2
UNION ALL SELECT session_key, 5, 'stale', CASE WHEN stale * 4 >= checked THEN 'Most' ELSE 'Some' END || ' of what was checked no longer holds: ' || stale || ' of ' || checked FROM fv WHERE stale > 0
UNION ALL SELECT fe.session_key, 6, 'unresolved', 'the session ended with an open failure: ' || worst FROM fe JOIN fa ON fa.session_key = fe.session_key"""
)
def findings_of_sessions(spark, sf_dir):
    """The sessions made from events against a snapshot that has three of five files, none of their commits, and up to two later ones."""
    found = tool_sessions(spark, sf_dir)
    runs, files = _ledgers(spark, sf_dir, "commands", "files")
    there = files.where(F.col("path").isin(*THERE)).select("session_key", "path")
    k = (F.col("session_key").cast("long") % 3).cast("int")
    later = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    own = found.select("session_key").distinct().select("session_key", later.alias("later"), F.when(k == 2, 2).otherwise(0).alias("uncommitted"))
    against = state.reconcile(files, there, there.where("path = 'src/m1.rs'"))
    gone = state.missing_commits(ledgers.git(runs)[0], spark.createDataFrame([], "session_key string, sha string"))
    return finish.findings(own, against, gone, state.verified(_actions(runs).unionByName(_decisions(files)), against), ledgers.errors(found, runs))


@query(
    f"""WITH {WORK}, {OPS} SELECT session_key, path, CASE WHEN path NOT LIKE '%/%' THEN 'unchecked' WHEN path NOT IN {THERE} AND NOT (path = 'src/m3.rs' AND CAST(session_key AS BIGINT) % 4 = 0) THEN 'stale' WHEN path = 'src/m1.rs' THEN 'stale' ELSE 'verified' END AS verified FROM led WHERE edits > 0"""
)
def verified_again(spark, sf_dir):
    """A stored state after every fourth session's snapshot has got one more file."""
    (files,) = _ledgers(spark, sf_dir, "files")
    items = _decisions(files)
    first = files.where(F.col("path").isin(*THERE)).select("session_key", "path")
    changed = first.where("path = 'src/m1.rs'")
    more = files.where("path = 'src/m3.rs' AND CAST(session_key AS BIGINT) % 4 = 0").select("session_key", "path")
    where = steps.new_folder(spark, "state")
    seen = finish.digests(files.select("session_key", "path", "deleted", "edits"), first, changed)
    finish.store(state.verified(items, state.reconcile(files, first, changed)), seen, where)
    after, _ = finish.verify(spark, where, files, first.unionByName(more), changed)
    return after.select("session_key", F.regexp_extract("text", "`(.*)`", 1).alias("path"), "verified")
