"""Queries over states: the fold with an injected function, over chunks made from ``conversations``."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.operators import fold, rounds, steps
from sessionloom.queries import CONV, query, sessions

PREMAP_FROM = fold.PREMAP_FROM


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a chunk; the session's first wish may be quoted."""
    s = sessions(spark, sf_dir)
    first = F.first(F.when(F.col("kind") == "user_message", F.col("text")), ignorenulls=True).over(Window.partitionBy("session_key").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = s.select("session_key", "idx", "kind", first.alias("wish"))
    quote = F.regexp_extract("wish", r"^\s*(\S+)", 1)
    human = F.when(F.col("wish").isNotNull(), F.array("wish")).otherwise(F.array().cast("array<string>"))
    return own.select(
        "session_key",
        F.col("idx").alias("place"),
        F.format_string("c%06d", "idx").alias("chunk"),
        F.lit("fold").alias("role"),
        F.col("idx").alias("evt_start"),
        F.col("idx").alias("evt_end"),
        F.concat("idx", F.lit(" "), "kind").alias("text"),
        F.coalesce(quote, F.lit("")).alias("about"),
        F.array("idx").alias("visible"),
        human.alias("human"),
        F.array().cast("array<string>").alias("paths"),
    )


def scripted(asked: dict) -> str:
    """Answers by rule, in cycles of four turns: all seven operations, some that are refused, and their repair; it reads the state from its prompt only."""
    t, role, prompt = asked["evt_start"], asked["role"], asked["prompt"]
    q, turn, here = t // 4, t % 4, [[t, t]]
    parts = dict(p.split("\n", 1) for p in re.split(r"(?:^|\n\n)# ", prompt) if "\n" in p)
    active = re.findall(r"^([A-Z])([0-9]+) ", parts.get("STATE", ""), re.M)
    newest = lambda kind, n: [f"{kind}{i}" for i in sorted(int(i) for k, i in active if k == kind)[-n:]]
    add = lambda kind, text, **more: {"op": "add", "kind": kind, "text": text, "sources": here, **more}
    if role == "premap":
        ops = [add("decision", f"seen {q}")] if turn == 1 else []
    elif role == "repair":
        ops = [add("env_fact", f"fact {q}")] if turn == 1 else [{"op": "confirm", "id": i, "evt": t + 1} for i in newest("D", 1)] if turn == 2 else []
    elif turn == 0:
        ops = [add("goal", f"aim {q}"), add("constraint", "Rule one.", quote=parts.get("ABOUT", "")), add("constraint", "Invented", quote="nobody said zzqx"), add("dead_end", f"dead {q}")]
    elif turn == 1:
        ops = [add("decision", f"{'seen' if 'CANDIDATES' in parts else 'chosen'} {q}"), add("decision", "far", sources=[[t + 100_000, t + 100_000]])]
        ops += [add("next_action", f"do {k}") for k in range(4)] if q == 0 else []
    elif turn == 2:
        ops = [{"op": "confirm", "id": newest("D", 1)[0], "evt": t}, {"op": "update", "id": newest("D", 1)[0], "why": f"because {q}"}, {"op": "drop", "id": "Z9", "reason": "?"}]
    else:
        ops = [{"op": "supersede", "id": newest("D", 1)[0], "replacement": add("decision", f"settled {q}")}, add("open_thread", f"ask {q}")]
        ops += [{"op": "resolve", "id": f"O{q}", "evt": t}] if q else []
        ops += [{"op": "merge", "ids": newest("X", 2), "merged": add("dead_end", f"both {q}")}] if q % 2 else [{"op": "drop", "id": newest("F", 1)[0], "reason": "old"}]
    return "Here you are:\n```json\n" + json.dumps({"ops": ops}) + "\n```"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.run(chunks(spark, sf_dir), scripted, steps.new_folder(spark, "fold"))


CYCLES = f"""{CONV}, s AS (SELECT session_key, CAST(count(*) AS INTEGER) AS n, bool_or(kind = 'user_message') AS human FROM conv GROUP BY session_key),
  c AS (SELECT s.*, CAST(conv.idx // 4 AS INTEGER) AS q, conv.idx AS t FROM s JOIN conv USING (session_key) WHERE conv.idx % 4 = 0)"""


@query(
    f"""WITH {CYCLES}
SELECT session_key, 'G' || (q + 1) AS id, 'goal' AS kind, 'aim ' || q AS text, NULL AS why, CASE WHEN t + 4 < n THEN 'superseded' ELSE 'active' END AS status, CASE WHEN t + 4 < n THEN 'G' || (q + 2) END AS detail, CAST(t AS INTEGER) AS last_confirmed FROM c
UNION ALL SELECT session_key, 'C1', 'constraint', 'Rule one.', NULL, 'active', NULL, max(t) FROM c WHERE human GROUP BY session_key
UNION ALL SELECT session_key, 'X' || (3 * (q // 2) + 1 + q % 2), 'dead_end', 'dead ' || q, NULL, CASE WHEN 8 * (q // 2) + 7 < n THEN 'superseded' ELSE 'active' END, CASE WHEN 8 * (q // 2) + 7 < n THEN 'X' || (3 * (q // 2) + 3) END, t FROM c
UNION ALL SELECT session_key, 'X' || (3 * (q // 2) + 3), 'dead_end', 'both ' || q, NULL, 'active', NULL, t + 3 FROM c WHERE q % 2 = 1 AND t + 3 < n
UNION ALL SELECT session_key, 'D' || (2 * q + 1), 'decision', CASE WHEN n >= {PREMAP_FROM} THEN 'seen ' ELSE 'chosen ' END || q, CASE WHEN t + 2 < n THEN 'because ' || q END, CASE WHEN t + 3 < n THEN 'superseded' ELSE 'active' END, CASE WHEN t + 3 < n THEN 'D' || (2 * q + 2) END, CASE WHEN t + 2 < n THEN t + 2 ELSE t + 1 END FROM c WHERE t + 1 < n
UNION ALL SELECT session_key, 'D' || (2 * q + 2), 'decision', 'settled ' || q, NULL, 'active', NULL, t + 3 FROM c WHERE t + 3 < n
UNION ALL SELECT session_key, 'N' || k, 'next_action', 'do ' || (k - 1), NULL, 'active', NULL, 1 FROM s, (VALUES (1), (2), (3)) AS v(k) WHERE n > 1
UNION ALL SELECT session_key, 'F' || (q + 1), 'env_fact', 'fact ' || q, NULL, CASE WHEN q % 2 = 0 AND t + 3 < n THEN 'dropped' ELSE 'active' END, CASE WHEN q % 2 = 0 AND t + 3 < n THEN 'old' END, t + 1 FROM c WHERE t + 1 < n
UNION ALL SELECT session_key, 'O' || (q + 1), 'open_thread', 'ask ' || q, NULL, CASE WHEN t + 7 < n THEN 'resolved' ELSE 'active' END, CASE WHEN t + 7 < n THEN CAST(t + 7 AS VARCHAR) END, t + 3 FROM c WHERE t + 3 < n"""
)
def fold_state(spark, sf_dir):
    """The state that an injected function makes of each conversation: premap, fold and repair turns."""
    return fold.items_of(folded(spark, sf_dir)).select("session_key", "id", "kind", "text", "why", "status", "detail", "last_confirmed")


@query(
    f"""WITH {CYCLES}, r AS (
SELECT session_key, t, 2 AS op_index, 'add' AS op, 'the quote is in no human message' AS reason FROM c
UNION ALL SELECT session_key, t, 1, 'add', 'a constraint needs a quote' FROM c WHERE NOT human
UNION ALL SELECT session_key, t + 1, 1, 'add', 'a source is outside the chunk' FROM c WHERE t + 1 < n
UNION ALL SELECT session_key, t + 1, 5, 'add', 'at most 3 active of next_action' FROM c WHERE t + 1 < n AND q = 0
UNION ALL SELECT session_key, t + 2, 2, 'drop', 'unknown item Z9' FROM c WHERE t + 2 < n
UNION ALL SELECT session_key, t + 2, 0, 'confirm', 'evt ' || (t + 3) || ' is outside the chunk' FROM c WHERE t + 2 < n)
SELECT session_key, 'c' || lpad(CAST(t AS VARCHAR), 6, '0') AS chunk, op_index, op, reason FROM r"""
)
def fold_refusals(spark, sf_dir):
    return fold.rejections_of(folded(spark, sf_dir))


@query(
    f"""WITH {CYCLES}, m AS (SELECT session_key, count(*) FILTER (idx % 4 <> 3) AS repairs FROM conv GROUP BY session_key)
SELECT session_key, CAST(n * CASE WHEN n >= {PREMAP_FROM} THEN 2 ELSE 1 END + repairs AS BIGINT) AS calls, repairs, CAST(0 AS BIGINT) AS failures, CAST(n AS INTEGER) AS processed FROM s JOIN m USING (session_key)"""
)
def fold_calls(spark, sf_dir):
    return folded(spark, sf_dir).withColumn("processed", F.size("processed"))[["session_key", "calls", "repairs", "failures", "processed"]]


# ---- trials with expansions


def asking(prompt: str) -> str:
    """Asks for the turn in question, then for the ones before it, as often as the turn's number modulo 5 says; then answers."""
    evt = int(re.search(r"Question: ([0-9]+)\?$", prompt)[1])
    seen = prompt.count("You asked for evt ")
    if not prompt.startswith("You may look") or seen >= evt % 5:
        return f"It is turn {evt}."
    return f"Let me see: EXPAND {evt - seen}..={evt - seen}"


@query(
    f"""WITH {CONV}, a AS (SELECT * FROM (VALUES ('alone', '', false), ('look', 'You may look: ', true)) AS v(arm, context, can)), p AS (
  SELECT session_key, arm, idx AS evt, context, CASE WHEN can THEN least(idx % 5, 3) ELSE 0 END AS k, idx % 5 > 3 AND can AS lost FROM conv CROSS JOIN a), r AS (
  SELECT p.*, j, c.text || '  (evt ' || c.idx || ')' || chr(10) AS body, p.evt - j AS near FROM p JOIN (SELECT unnest(range(0, 3)) AS j) x ON j < p.k JOIN conv c ON c.session_key = p.session_key AND c.idx = p.evt - j), u AS (
  SELECT session_key, arm, evt, j, ceil(strlen(body) / 4.0) AS seen, strlen(chr(10) || 'You asked for evt ' || near || '..' || near || ':' || chr(10) || body) AS more FROM r), g AS (
  SELECT p.session_key, p.arm, p.evt, n, strlen(context) + strlen(chr(10) || 'Question: ' || p.evt || '?') + coalesce(sum(u.more), 0) AS bytes FROM p JOIN (SELECT unnest(range(0, 4)) AS n) x ON n <= p.k LEFT JOIN u ON u.session_key = p.session_key AND u.arm = p.arm AND u.evt = p.evt AND u.j < n GROUP BY p.session_key, p.arm, p.evt, n, context), t AS (
  SELECT session_key, arm, evt, sum(ceil(bytes / 4.0)) AS asked FROM g GROUP BY ALL), s AS (SELECT session_key, arm, evt, sum(seen) AS seen FROM u GROUP BY ALL)
SELECT p.session_key, p.arm, CAST(p.evt AS INTEGER) AS evt, NOT lost AS correct, CAST(t.asked + coalesce(s.seen, 0) AS BIGINT) AS tokens, CAST(k AS INTEGER) AS expansions
FROM p JOIN t ON t.session_key = p.session_key AND t.arm = p.arm AND t.evt = p.evt LEFT JOIN s ON s.session_key = p.session_key AND s.arm = p.arm AND s.evt = p.evt"""
)
def trial_rounds(spark, sf_dir):
    """Each turn is a question to two arms, of which one may look; turns of rest 4 would look more often than they may."""
    s = sessions(spark, sf_dir)
    arms = F.explode(F.array(F.struct(F.lit("alone").alias("arm"), F.lit("").alias("context"), F.lit(False).alias("can_expand")), F.struct(F.lit("look").alias("arm"), F.lit("You may look: ").alias("context"), F.lit(True).alias("can_expand"))))
    plan = s.select("session_key", F.col("idx").alias("evt"), F.lit("turn").alias("class"), F.concat("idx", F.lit("?")).alias("question"), F.concat(F.lit("turn "), "idx").alias("key"), arms.alias("a")).select("session_key", "evt", "class", "question", "key", "a.*")
    rows = s.select("session_key", F.col("idx").alias("evt"), "text", F.lit(0).alias("tokens"))
    return rounds.trials(plan, rows, asking, steps.new_folder(spark, "trials")).select("session_key", "arm", "evt", "correct", "tokens", "expansions")
