"""Queries through the adapters: transcripts of each provider made from ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import events as E
from sessionloom.queries import CONV, query, sessions


def _raw(s: DataFrame, raw: Column, *more: str) -> DataFrame:
    return s.select("session_key", F.lit(0).alias("path_ix"), (F.col("idx") + 1).alias("line_no"), raw.alias("raw"), *more)


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _uuid(n: Column) -> Column:
    return F.concat(F.lit("n"), n.cast("string"))


@query(
    f"""WITH {CONV}, t AS (SELECT session_key, idx, text, count(*) OVER (PARTITION BY session_key) AS n FROM conv)
SELECT session_key, idx, CASE idx WHEN 4 THEN 'subagent_spawn' WHEN 6 THEN 'subagent_result' ELSE 'user_message' END AS kind,
  CASE WHEN idx IN (2, 3) THEN 1 WHEN idx = 5 THEN 3 ELSE 0 END AS stream, CASE WHEN idx IN (4, 6) THEN 2 ELSE -1 END AS sub_stream, idx NOT IN (2, 3, 5) AS is_active FROM t"""
)
def sidechain_streams(spark, sf_dir):
    """Turns 2 and 3 are one sidechain, 5 another; turn 4 starts a subagent that turn 6 hears from."""
    s, n = sessions(spark, sf_dir), F.col("idx")
    side = n.isin(2, 3, 5)
    up = F.when(n == 0, None).when(n == 4, 1).when(n == 6, 4).otherwise(n - 1)
    call = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("c").alias("id"), F.lit("Task").alias("name"), F.struct(F.lit("look").alias("prompt")).alias("input")))
    result = F.array(F.struct(F.lit("tool_result").alias("type"), F.lit("c").alias("tool_use_id"), F.col("text").alias("content")))
    line = lambda kind, content: _json(type=F.lit(kind), uuid=_uuid(n), parentUuid=_uuid(up), isSidechain=side, message=F.struct(content.alias("content")))
    raw = F.when(n == 4, line("assistant", call)).when(n == 6, line("user", result)).otherwise(line("user", F.col("text")))
    return E.events(_raw(s, raw)).select("session_key", "idx", "kind", "stream", F.coalesce("sub_stream", F.lit(-1)).alias("sub_stream"), "is_active")


@query(
    f"""WITH {CONV}, t AS (SELECT session_key, idx, count(*) OVER (PARTITION BY session_key) AS n FROM conv)
SELECT session_key, idx AS turn, CASE idx WHEN 0 THEN n < 7 WHEN 1 THEN false WHEN 2 THEN n < 7 WHEN 3 THEN n < 5 WHEN 4 THEN false WHEN 5 THEN n < 7 WHEN 6 THEN false ELSE true END AS is_active FROM t"""
)
def rollback_stack(spark, sf_dir):
    """One turn is taken back after turn 1, two after turn 4, nine (more than there are) after turn 6."""
    s, n = sessions(spark, sf_dir).withColumn("idx", F.col("idx") * 2), F.col("idx") / 2
    item = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.concat(F.lit("turn "), n.cast("int")).alias("text"))).alias("content"))
    turns = _raw(s, _json(type=F.lit("response_item"), timestamp=F.lit("t"), payload=item))
    back = F.when(n == 1, 1).when(n == 4, 2).when(n == 6, 9)
    ends = _raw(s.withColumn("back", back).where("back IS NOT NULL").withColumn("idx", F.col("idx") + 1), _json(type=F.lit("event_msg"), timestamp=F.lit("t"), payload=F.struct(F.lit("thread_rolled_back").alias("type"), F.col("back").alias("num_turns"))))
    found = E.events(turns.unionByName(ends)).where("kind = 'user_message'")
    return found.select("session_key", F.regexp_extract("text", "turn ([0-9]+)", 1).cast("int").alias("turn"), "is_active")


@query(
    f"""WITH {CONV}
SELECT session_key, idx, CASE idx % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'user_answer' ELSE 'tool_result' END AS kind, CASE idx % 3 WHEN 1 THEN 'Question ' || (idx - 1) || '?' ELSE '' END AS question,
  CASE idx % 3 WHEN 1 THEN 'yes; ' || idx ELSE '' END AS answer, CASE idx % 3 WHEN 2 THEN text ELSE '' END AS output FROM conv"""
)
def question_answers(spark, sf_dir):
    """Turns ask, answer and answer again, always by the same call id: only the first answer to a question counts as one."""
    s, n = sessions(spark, sf_dir), F.col("idx")
    args = _json(question=F.concat(F.lit("Question "), n, F.lit("?")))
    ask = F.struct(F.lit("function_call").alias("type"), F.lit("request_user_input").alias("name"), F.lit("q").alias("call_id"), args.alias("arguments"))
    chosen = F.struct(F.struct(F.struct(F.array(F.lit("yes"), n.cast("string")).alias("answers")).alias("a")).alias("answers"))
    reply = lambda output: F.struct(F.lit("function_call_output").alias("type"), F.lit("q").alias("call_id"), output.alias("output"))
    line = lambda payload: _json(type=F.lit("response_item"), timestamp=F.lit("t"), payload=payload)
    raw = F.when(n % 3 == 0, line(ask)).when(n % 3 == 1, line(reply(chosen))).otherwise(line(reply(F.col("text"))))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return E.events(_raw(s, raw)).select("session_key", "idx", "kind", text("question"), text("answer"), text("output"))


JOURNAL = """path AS (
  SELECT session_key, max(idx) AS idx FROM conv GROUP BY session_key
  UNION ALL SELECT session_key, CASE idx WHEN 3 THEN 1 WHEN 6 THEN 4 ELSE idx - 1 END FROM path WHERE idx > 0)"""


@query(
    f"""WITH RECURSIVE {CONV}, {JOURNAL}
SELECT c.session_key, c.idx AS entry, CASE c.idx % 3 WHEN 0 THEN 'user_message' WHEN 1 THEN 'shell_execution' ELSE 'tool_call' END AS kind, c.idx IN (SELECT p.idx FROM path p WHERE p.session_key = c.session_key) AS is_active,
  CASE c.idx % 3 WHEN 0 THEN '' WHEN 1 THEN 'make ' || c.idx ELSE '{{"file":"a.py","n":' || c.idx || '}}' END AS given, CASE c.idx % 3 WHEN 1 THEN c.idx ELSE -1 END AS exit_code FROM conv c"""
)
def journal_branch(spark, sf_dir):
    """Entries 3 and 6 hang on 1 and 4: 2 and 5 are on branches that were left.  Users talk, shells run, tools are called."""
    s, n = sessions(spark, sf_dir), F.col("idx")
    up = F.when(n == 0, None).when(n == 3, 1).when(n == 6, 4).otherwise(n - 1)
    link = {"id": _uuid(n), "parentId": _uuid(up)}
    said = _json(type=F.lit("message"), **link, message=F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    ran = _json(type=F.lit("bash_execution"), **link, command=F.concat(F.lit("make "), n), exitCode=n)
    call = F.struct(F.concat(F.lit("k"), n).alias("id"), F.lit("read").alias("name"), F.struct(n.alias("n"), F.lit("a.py").alias("file")).alias("arguments"))
    called = _json(type=F.lit("message"), **link, message=F.struct(F.lit("assistant").alias("role"), F.array(call).alias("toolCalls")))
    raw = _raw(s, F.when(n % 3 == 0, said).when(n % 3 == 1, ran).otherwise(called)).withColumn("line_no", F.col("line_no") + 1)
    head = s.select("session_key").distinct().select("session_key", F.lit(0).alias("path_ix"), F.lit(1).alias("line_no"), F.lit('{"type":"session","version":2,"id":"s"}').alias("raw"))
    found = E.events(head.unionByName(raw))
    return found.select("session_key", (F.col("line_no") - 2).alias("entry"), "kind", "is_active", F.coalesce("args", "command", F.lit("")).alias("given"), F.coalesce("exit_code", F.lit(-1)).alias("exit_code"))


@query(
    f"""WITH {CONV}, t AS (SELECT session_key, idx, count(*) OVER (PARTITION BY session_key) AS n FROM conv)
SELECT session_key, 'bad_line' AS kind, idx + 1 AS line_no, 'not JSON' AS message FROM t WHERE idx = 2
UNION ALL SELECT session_key, 'unknown_kind', idx + 1, 'progress' FROM t WHERE idx = 3
UNION ALL SELECT session_key, 'missing_parent', -1, 'lost' FROM t WHERE idx = 4
UNION ALL SELECT session_key, 'abandoned_branch', -1, '2 entries' FROM t WHERE idx = 4"""
)
def transcript_notes(spark, sf_dir):
    """Line 3 is broken, line 4 of an unknown kind; turn 4 names a parent that isn't there, so the two before it are left."""
    s, n = sessions(spark, sf_dir), F.col("idx")
    up = F.when(n == 0, None).when(n == 4, F.lit("lost")).otherwise(_uuid(n - 1))
    line = lambda kind: _json(type=F.lit(kind), uuid=_uuid(n), parentUuid=up, message=F.struct(F.col("text").alias("content")))
    raw = F.when(n == 2, "{broken").when(n == 3, line("progress")).otherwise(line("user"))
    return E.diagnostics(_raw(s, raw)).select("session_key", "kind", F.coalesce("line_no", F.lit(-1)).alias("line_no"), "message")
