"""The registered queries of the session engine and their SQL counterparts.

``conversations`` serve as sessions, ``events`` as a stream of tool calls, ``documents`` as texts.  What the tables can't show (paths, directives,
rollbacks) runs over transcripts made from ``conversations``, or over a few inline rows that are the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as X
from sessionloom.operators import evaluation, joins, ledgers, render, segment, state, triage
from sessionloom.plans import extract as plans
from sessionloom.operators import sessions as S
from sessionloom.operators import events as E
from sessionloom.operators import masking as M
from sessionloom.sources import transcripts
from sessionloom.streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


# ---- conversations as sessions

CONV = """conv AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx,
    CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_text' ELSE 'system' END AS kind, text
  FROM conversations)"""
CLEAN = "regexp_replace(regexp_replace({0}, '[ \t]+(\n|$)', '\\1', 'g'), '\n{{3,}}', '\n\n', 'g')"
MASKED = f"""{CONV}, raw AS (
  SELECT session_key, idx AS evt, kind = 'user_message' AS is_human_turn, CASE kind WHEN 'user_message' THEN 'user' ELSE 'assistant_final' END AS tier,
    CASE kind WHEN 'user_message' THEN 0 ELSE 1 END AS tier_rank, CASE kind WHEN 'user_message' THEN '[user] ' ELSE '[assistant] ' END || text AS raw
  FROM conv WHERE kind <> 'system'), masked AS (
  SELECT session_key, evt, is_human_turn, tier, tier_rank, {R.redact_sql(CLEAN.format("raw"))} AS text FROM raw), rows_ AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, CAST(row_number() OVER (PARTITION BY session_key ORDER BY evt) - 1 AS INTEGER) AS pos FROM masked)"""
RAW_EP = f"""{MASKED}, ep AS (
  SELECT *, CAST(sum(CASE WHEN pos > 0 AND is_human_turn THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY evt) AS INTEGER) AS episode FROM rows_)"""
MIN_EPISODE, PAGE, BUDGET = 150, 200, 400
MERGED = f"""{RAW_EP}, eps AS (
  SELECT session_key, episode, min(pos) AS s, max(pos) AS e, CAST(sum(tokens) AS BIGINT) AS tokens FROM ep GROUP BY ALL), walk AS (
  SELECT session_key, episode, s, e, tokens, tokens AS acc, 0 AS g FROM eps WHERE episode = 0
  UNION ALL
  SELECT n.session_key, n.episode, n.s, n.e, n.tokens, CASE WHEN w.acc >= {MIN_EPISODE} THEN n.tokens ELSE w.acc + n.tokens END, CASE WHEN w.acc >= {MIN_EPISODE} THEN w.g + 1 ELSE w.g END
  FROM walk w JOIN eps n ON n.session_key = w.session_key AND n.episode = w.episode + 1), grp AS (
  SELECT session_key, g, min(s) AS s, max(e) AS e, CAST(sum(tokens) AS BIGINT) AS tokens FROM walk GROUP BY ALL), fixed AS (
  SELECT *, CASE WHEN g = max(g) OVER (PARTITION BY session_key) AND g > 0 AND tokens < {MIN_EPISODE} THEN g - 1 ELSE g END AS h FROM grp), merged AS (
  SELECT session_key, CAST(h AS INTEGER) AS episode, min(s) AS row_start, max(e) AS row_end, CAST(sum(tokens) AS BIGINT) AS tokens FROM fixed GROUP BY session_key, h)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` in the canonical event schema."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_text").otherwise("system")
    known = {
        "session_key": F.col("conv_id").cast("string"),
        "idx": (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"),
        "kind": kind,
        "text": F.col("text"),
        "is_active": F.lit(True),
        "stream": F.lit(0),
        "is_meta": F.lit(False),
        "phase": F.when(F.col("role") == "assistant", "final"),
        "subtype": F.when(kind == "system", "system"),
    }
    empty = spark.createDataFrame([], E.SCHEMA)
    return c.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.masked_rows(sessions(spark, sf_dir))


@query(f"WITH {CONV} SELECT session_key, idx, kind, CAST(strlen(text) AS BIGINT) AS bytes FROM conv")
def event_projection(spark, sf_dir):
    return sessions(spark, sf_dir).select("session_key", "idx", "kind", F.octet_length("text").cast("long").alias("bytes"))


@query(f"WITH {CONV} SELECT session_key, kind, count(*) AS n FROM conv GROUP BY ALL")
def kind_histogram(spark, sf_dir):
    return E.kind_histogram(sessions(spark, sf_dir))


@query(f"WITH {CONV} SELECT session_key, count(*) FILTER (kind = 'user_message') AS user_turns FROM conv GROUP BY ALL")
def user_turns(spark, sf_dir):
    return E.user_turns(sessions(spark, sf_dir))


@query(f"WITH {CONV} SELECT session_key, count(*) AS n FROM conv GROUP BY session_key HAVING max(idx) <> count(*) - 1")
def invariant_violations(spark, sf_dir):
    return E.violations(sessions(spark, sf_dir)).select("session_key", "n")


@query(f"WITH {MASKED} SELECT session_key, evt, tier, text, tokens, is_human_turn FROM rows_")
def masked_rows(spark, sf_dir):
    return rows(spark, sf_dir).drop("tier_rank")


@query(f"WITH {MASKED} SELECT session_key, evt, text || '  (evt ' || evt || ')' AS line FROM rows_")
def rendered_rows(spark, sf_dir):
    return M.rendered(rows(spark, sf_dir))


@query(f"WITH {RAW_EP} SELECT session_key, evt, episode FROM ep")
def episodes_raw(spark, sf_dir):
    return segment.raw_episodes(rows(spark, sf_dir)).select("session_key", "evt", "episode")


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM merged")
def episodes_merged(spark, sf_dir):
    return segment.episodes(rows(spark, sf_dir), MIN_EPISODE)


@query(
    f"""WITH RECURSIVE {MERGED}, p AS (
  SELECT session_key, episode, row_start, row_end, tokens, tokens AS acc, 0 AS c FROM merged WHERE episode = 0
  UNION ALL
  SELECT n.session_key, n.episode, n.row_start, n.row_end, n.tokens, CASE WHEN p.acc + n.tokens > {BUDGET} THEN n.tokens ELSE p.acc + n.tokens END, CASE WHEN p.acc + n.tokens > {BUDGET} THEN p.c + 1 ELSE p.c END
  FROM p JOIN merged n ON n.session_key = p.session_key AND n.episode = p.episode + 1)
SELECT session_key, CAST(c AS INTEGER) AS chunk, min(row_start) AS row_start, max(row_end) AS row_end, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY session_key, c"""
)
def chunks(spark, sf_dir):
    return segment.chunks(segment.episodes(rows(spark, sf_dir), MIN_EPISODE), BUDGET)


@query(
    f"""WITH RECURSIVE {MASKED}, p AS (
  SELECT session_key, pos, tokens, tokens AS acc, 0 AS g FROM rows_ WHERE pos = 0
  UNION ALL
  SELECT n.session_key, n.pos, n.tokens, CASE WHEN p.acc + n.tokens > {PAGE} THEN n.tokens ELSE p.acc + n.tokens END, CASE WHEN p.acc + n.tokens > {PAGE} THEN p.g + 1 ELSE p.g END
  FROM p JOIN rows_ n ON n.session_key = p.session_key AND n.pos = p.pos + 1)
SELECT session_key, CAST(g AS INTEGER) AS page, min(pos) AS row_start, max(pos) AS row_end, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY session_key, g"""
)
def pages(spark, sf_dir):
    return segment.pages(rows(spark, sf_dir), PAGE)


@query(
    f"""WITH RECURSIVE {MERGED}, t AS (
  SELECT *, sum(tokens) OVER (PARTITION BY session_key ORDER BY episode DESC) AS upto FROM merged), u AS (
  SELECT *, (upto - tokens = 0) OR (upto <= {BUDGET} AND upto - tokens < {BUDGET}) AS own FROM t)
SELECT session_key, episode, row_start, row_end, tokens, bool_and(own) OVER (PARTITION BY session_key ORDER BY episode DESC) AS in_tail FROM u"""
)
def recency_tail(spark, sf_dir):
    return segment.tail(segment.episodes(rows(spark, sf_dir), MIN_EPISODE), BUDGET)


@query(
    f"""WITH RECURSIVE {MASKED}, o AS (
  SELECT session_key, evt, tier_rank, tokens, row_number() OVER (PARTITION BY session_key ORDER BY tier_rank, evt DESC) AS k FROM rows_), w AS (
  SELECT session_key, 0 AS k, CAST({PAGE} AS BIGINT) AS room, -1 AS shut, CAST(NULL AS INTEGER) AS evt, CAST(NULL AS BIGINT) AS cut, false AS kept FROM o GROUP BY session_key
  UNION ALL
  SELECT o.session_key, o.k, CASE WHEN w.shut <> o.tier_rank AND o.tokens <= w.room THEN w.room - o.tokens ELSE w.room END,
    CASE WHEN w.shut <> o.tier_rank AND o.tokens > w.room THEN o.tier_rank ELSE w.shut END, o.evt,
    CASE WHEN o.tokens > w.room THEN w.room - 12 END, w.shut <> o.tier_rank AND (o.tokens <= w.room OR w.room >= 40)
  FROM w JOIN o ON o.session_key = w.session_key AND o.k = w.k + 1)
SELECT session_key, evt, coalesce(cut, -1) AS room FROM w WHERE kept"""
)
def digest(spark, sf_dir):
    return segment.digest(rows(spark, sf_dir), PAGE).select("session_key", "evt", F.coalesce("room", F.lit(-1)).alias("room"))


@query(f"WITH {MASKED} SELECT session_key, evt, tier, tokens FROM rows_ WHERE evt BETWEEN 1 AND 4")
def expand_range(spark, sf_dir):
    return segment.expand(rows(spark, sf_dir), 2, 3, 1).select("session_key", "evt", "tier", "tokens")


@query(
    """WITH t AS (SELECT user_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
inner_ AS (SELECT user_id, pos AS evt, pos - 1 AS k, greatest((n - 2) // 5, 1) AS step FROM t WHERE n >= 8 AND pos BETWEEN 1 AND n - 2),
shown AS (SELECT user_id, evt, row_number() OVER (PARTITION BY user_id ORDER BY k) AS line FROM inner_ WHERE k % step = 0)
SELECT user_id, evt FROM shown WHERE line <= 6"""
)
def arc_sample(spark, sf_dir):
    own = calls(spark, sf_dir).select(F.col("user_id").alias("session_key"), "evt")
    return segment.arc(own).select(F.col("session_key").alias("user_id"), "evt")


@query(f"WITH {CONV}, c AS (SELECT DISTINCT session_key, CASE CAST(session_key AS INTEGER) % 5 WHEN 0 THEN '/w/a/b' WHEN 1 THEN '/w/a' WHEN 2 THEN '/w/a/b/c' WHEN 3 THEN '/w/a/bc' ELSE '/' END AS cwd FROM conv) SELECT session_key, cwd FROM c WHERE cwd IN ('/w/a/b', '/w/a', '/w', '/')")
def project_filter(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, ["/w/a/b", "/w/a", "/w/a/b/c", "/w/a/bc", "/"])), F.col("session_key").cast("int") % 5 + 1)
    own = sessions(spark, sf_dir).select("session_key", folder.alias("cwd")).distinct().withColumns({c: F.lit(None).cast("string") for c in ("title", "first_message", "started_at")})
    return transcripts.matching(own, project="/w/a/b", up=True).select("session_key", "cwd")


@query(
    f"""WITH {CONV}, t AS (SELECT session_key, idx AS evt, row_number() OVER (PARTITION BY session_key ORDER BY idx) - 1 AS pos, CAST(floor(count(*) OVER (PARTITION BY session_key) * 0.85) AS BIGINT) AS size FROM conv),
u AS (SELECT *, greatest(size // 3, 1) AS stride FROM t)
SELECT session_key, evt FROM u WHERE pos < size AND pos // stride < 3 AND pos = (pos // stride) * stride + stride // 2"""
)
def stride_sample(spark, sf_dir):
    return segment.stride_sample(sessions(spark, sf_dir).select("session_key", F.col("idx").alias("evt")), 3)


@query(f"WITH {CONV} SELECT session_key, idx FROM conv")
def recent_window(spark, sf_dir):
    return segment.recent(sessions(spark, sf_dir)).select("session_key", "idx")


# ---- transcripts made from conversations, through the adapters


def _lines(found: DataFrame, raw: F.Column) -> DataFrame:
    return found.select("session_key", F.lit(0).alias("path_ix"), (F.col("idx") + 1).alias("line_no"), raw.alias("raw"))


def tree_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a linked transcript in which turn 3 rewinds to turn 1: turn 2 is abandoned."""
    s = sessions(spark, sf_dir)
    kind = F.when(F.col("kind") == "user_message", "user").when(F.col("kind") == "assistant_text", "assistant").otherwise("system")
    up = F.when(F.col("idx") == 0, None).when(F.col("idx") == 3, 1).otherwise(F.col("idx") - 1)
    raw = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("n"), F.col("idx")).alias("uuid"), F.concat(F.lit("n"), up).alias("parentUuid"), F.struct(F.col("text").alias("content")).alias("message"), F.col("text").alias("content")))
    return _lines(s, raw)


ACTIVE = """path AS (
  SELECT c.session_key, c.idx FROM conv c JOIN (SELECT session_key, max(idx) AS leaf FROM conv WHERE kind <> 'system' GROUP BY session_key) l ON c.session_key = l.session_key AND c.idx = l.leaf
  UNION ALL
  SELECT session_key, CASE idx WHEN 3 THEN 1 ELSE idx - 1 END FROM path WHERE idx > 0)"""


@query(
    f"WITH RECURSIVE {CONV}, {ACTIVE} SELECT c.session_key, c.idx, c.kind, (p.idx IS NOT NULL OR c.session_key NOT IN (SELECT session_key FROM path)) AS is_active FROM conv c LEFT JOIN path p ON p.session_key = c.session_key AND p.idx = c.idx"
)
def active_branch(spark, sf_dir):
    return E.events(tree_transcript(spark, sf_dir)).select("session_key", "idx", "kind", "is_active")


@query(f"WITH RECURSIVE {CONV}, {ACTIVE} SELECT session_key, count(*) AS n FROM conv WHERE kind <> 'system' AND session_key IN (SELECT session_key FROM path) AND (session_key, idx) NOT IN (SELECT session_key, idx FROM path) GROUP BY session_key")
def abandoned_branch(spark, sf_dir):
    found = E.diagnostics(tree_transcript(spark, sf_dir)).where("kind = 'abandoned_branch'")
    return found.groupBy("session_key").agg(F.sum(F.regexp_extract("message", "[0-9]+", 0).cast("long")).alias("n"))


@query(
    f"""WITH {CONV}, t AS (SELECT session_key, idx, kind, sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY idx) AS turn FROM conv WHERE kind <> 'system'),
e AS (SELECT session_key, kind, turn, row_number() OVER (PARTITION BY session_key ORDER BY idx) - 1 AS i FROM t)
SELECT session_key, CAST(i AS INTEGER) AS idx, kind, turn = 0 OR turn < (SELECT max(turn) FROM e x WHERE x.session_key = e.session_key) AS is_active FROM e
UNION ALL
SELECT session_key, CAST(count(*) AS INTEGER), 'rollback', false FROM e GROUP BY session_key"""
)
def rollback_replay(spark, sf_dir):
    s = sessions(spark, sf_dir)
    role = F.when(F.col("kind") == "user_message", "user").when(F.col("kind") == "assistant_text", "assistant").otherwise("system")
    item = F.struct(F.lit("message").alias("type"), role.alias("role"), F.array(F.struct(F.col("text").alias("text"))).alias("content"))
    raw = F.to_json(F.struct(F.lit("response_item").alias("type"), F.lit("t").alias("timestamp"), item.alias("payload")))
    back = F.lit('{"type":"event_msg","timestamp":"t","payload":{"type":"thread_rolled_back","num_turns":1}}')
    end = s.where("kind <> 'system'").groupBy("session_key").agg(F.lit(100_000).alias("idx"))
    return E.events(_lines(s, raw).unionByName(_lines(end, back))).select("session_key", "idx", "kind", "is_active")


# ---- documents as texts


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("hash"))


@query(
    """WITH d AS (SELECT doc_id, text, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS n, left(trim(regexp_extract(text, '^[^\r\n]*')), 80) AS preview FROM documents)
SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN '[empty]' WHEN n <= 1 AND strlen(text) <= 80 THEN '[' || preview || ']' ELSE '[' || n || ' lines, ' || strlen(text) || ' bytes: ' || preview || '…]' END AS shown FROM d"""
)
def placeholder(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.placeholder(F.col("text")).alias("shown"))


@query()
def truncate_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_middle(F.col("text"), 140).alias("shown"))


@query(f"SELECT doc_id, md5({R.redact_sql('text')}) AS hash FROM documents")
def redact_default(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.redact(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, md5({R.redact_sql('text', 'strict')}) AS hash FROM documents")
def redact_strict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.redact(F.col("text"), "strict")).alias("hash"))


_COUNT = "CAST((strlen({0}) - strlen(replace({0}, '[REDACTED_SECRET]', ''))) / 17 AS BIGINT)"


@query(f"SELECT doc_id, {_COUNT.format(R.redact_sql('text', 'strict'))} AS n FROM documents")
def redaction_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", R.redactions(t, R.redact(t, "strict")).alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS words, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}/._-]+', ' ', 'g'))) AS answer FROM documents")
def normalize_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_words(t)).alias("words"), F.md5(X.normalize_answer(t)).alias("answer"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(line, '([!?]|[^0-9]\\.|^\\.)(\\s+|$)', '\\1' || chr(1), 'g'), '\\x01(\\.)\\s+', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM l)
SELECT doc_id, count(*) AS n, CAST(sum(strlen(sentence)) AS BIGINT) AS bytes FROM s WHERE trim(sentence) <> '' GROUP BY doc_id"""
)
def sentence_split(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).cast("long").alias("bytes"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON length(b.text) >= 24 AND contains(d.text, b.text)")
def quote_containment(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.contained(quotes, texts, "quote", "text").select("item_id", "doc_id")


@query()
def error_signatures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_signature(t).alias("signature"), X.signature_id(t).alias("sig"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(html, '^<![^>]*>', '') AS t FROM pages), n AS (SELECT page_id, t, regexp_extract(t, '^<([A-Za-z0-9_-]+)[> \n]', 1) AS name FROM p)
SELECT page_id, name <> '' AND contains(t, '</' || name || '>') AS is_fragment FROM n"""
)
def harness_fragment(spark, sf_dir):
    t = F.regexp_replace("html", F.lit("^<![^>]*>"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", X.is_harness_fragment(t).alias("is_fragment"))


@query(
    f"""WITH p AS (SELECT p_brand AS session_key, CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'components/' WHEN 2 THEN '.cache/' ELSE 'scripts/' END || lower(p_type) || '/' || replace(p_name, ' ', '/') || '/v.' || p_size AS path FROM part),
n AS (SELECT session_key, unnest(string_split(path, '/')) AS name FROM p)
SELECT session_key, name, count(*) AS n FROM n WHERE strlen(name) >= 3 AND NOT contains(name, '.') AND name NOT IN ({', '.join(repr(g) for g in ledgers.GENERIC)}) GROUP BY ALL HAVING count(*) >= 2"""
)
def vocabulary(spark, sf_dir):
    top = F.element_at(F.array(*map(F.lit, ["src", "components", ".cache", "scripts"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat_ws("/", top, F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("/")), F.concat(F.lit("v."), F.col("p_size").cast("string")))
    return ledgers.vocabulary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("session_key"), path.alias("path")))


# ---- events as tool calls

EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS at, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS evt FROM events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, at (microseconds), event_type, evt (ordinal in the user's stream)."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("evt", (F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")) - 1).cast("long"))


@query(f"WITH {EV} SELECT user_id, event_type, max(evt) AS evt, arg_max(event_id, evt) AS event_id FROM ev GROUP BY ALL")
def command_last_status(spark, sf_dir):
    own = calls(spark, sf_dir).select(F.col("user_id").alias("session_key"), F.col("event_type").alias("category"), F.col("event_type").alias("normalized"), "evt", "event_id")
    return ledgers.last_status(own).select(F.col("session_key").alias("user_id"), F.col("category").alias("event_type"), "evt", "event_id")


@query(f"WITH {EV} SELECT e.user_id, e.event_id, coalesce(max(c.evt), -1) AS cmd_evt, arg_max(c.event_type, c.evt) AS command FROM ev e LEFT JOIN ev c ON c.user_id = e.user_id AND c.event_type <> 'error' AND c.evt <= e.evt WHERE e.event_type = 'error' GROUP BY ALL")
def error_attribution(spark, sf_dir):
    c = calls(spark, sf_dir)
    errors = c.where("event_type = 'error'").select("user_id", "event_id", "evt")
    runs = c.where("event_type <> 'error'").select("user_id", F.col("evt").alias("cmd_evt"), F.col("event_type").alias("command"))
    return joins.as_of(errors, runs, ["user_id"], "evt", "cmd_evt", ["cmd_evt", "command"]).select("user_id", "event_id", F.coalesce("cmd_evt", F.lit(-1)).alias("cmd_evt"), "command")


ERR = f"""{EV}, att AS (
  SELECT e.user_id, e.evt, arg_max(c.event_type, c.evt) AS command FROM ev e JOIN ev c ON c.user_id = e.user_id AND c.event_type <> 'error' AND c.evt <= e.evt WHERE e.event_type = 'error' GROUP BY ALL), led AS (
  SELECT user_id, command, count(*) AS occurrences, min(evt) AS first_evt, max(evt) AS last_evt FROM att GROUP BY ALL)"""


def error_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by user and the command before them."""
    c = calls(spark, sf_dir)
    errors = c.where("event_type = 'error'").select("user_id", "evt")
    runs = c.where("event_type <> 'error'").select("user_id", F.col("evt").alias("cmd_evt"), F.col("event_type").alias("command"))
    near = joins.as_of(errors, runs, ["user_id"], "evt", "cmd_evt", ["command"]).where("command IS NOT NULL")
    return near.groupBy("user_id", "command").agg(F.count("*").alias("occurrences"), F.min("evt").alias("first_evt"), F.max("evt").alias("last_evt"))


@query(f"WITH {ERR} SELECT l.user_id, l.command, l.occurrences, l.last_evt, coalesce(max(c.evt), -1) AS resolved_evt FROM led l LEFT JOIN ev c ON c.user_id = l.user_id AND c.event_type = l.command AND c.evt > l.last_evt GROUP BY ALL")
def error_resolution(spark, sf_dir):
    led = error_ledger(spark, sf_dir)
    runs = calls(spark, sf_dir).select("user_id", F.col("event_type").alias("command"), "evt")
    both = led.join(runs, ["user_id", "command"], "left")
    return both.groupBy("user_id", "command", "occurrences", "last_evt").agg(F.coalesce(F.max(F.when(F.col("evt") > F.col("last_evt"), F.col("evt"))), F.lit(-1)).alias("resolved_evt"))


@query(f"WITH {ERR} SELECT user_id, command, occurrences FROM led WHERE occurrences >= 3")
def dead_ends(spark, sf_dir):
    return ledgers.dead_ends(error_ledger(spark, sf_dir).withColumn("status", F.lit("unresolved"))).select("user_id", "command", "occurrences")


@query(
    f"""WITH {EV}, m AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY evt) AS n FROM ev WHERE event_type IN ('signup', 'purchase')),
c AS (SELECT user_id, n, min(evt) AS call_evt FROM m WHERE event_type = 'signup' GROUP BY ALL), r AS (SELECT user_id, n, min(evt) AS result_evt FROM m WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, call_evt, result_evt FROM c JOIN r USING (user_id, n)"""
)
def call_result_pairing(spark, sf_dir):
    c = calls(spark, sf_dir)
    paired = joins.pair_once(c, F.col("event_type") == "signup", F.col("event_type") == "purchase", ["user_id"], ["evt"], ["event_id"])
    return paired.select("user_id", F.col("call.evt").alias("call_evt"), F.col("result.evt").alias("result_evt"))


@query(
    f"""WITH {EV}, l AS (SELECT user_id, event_type, min(ev."at" // 3600000000) AS l_start, max(ev."at" // 3600000000) AS l_end FROM ev GROUP BY ALL),
r AS (SELECT user_id, event_id, ev."at" // 3600000000 - 24 AS r_start, ev."at" // 3600000000 + 24 AS r_end FROM ev WHERE event_type = 'purchase')
SELECT l.user_id, event_type, event_id FROM l JOIN r ON l.user_id = r.user_id AND l_start <= r_end AND r_start <= l_end"""
)
def interval_overlap(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("h", F.expr("at div 3600000000"))
    left = c.groupBy("user_id", "event_type").agg(F.min("h").alias("l_start"), F.max("h").alias("l_end"))
    right = c.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("h") - 24).alias("r_start"), (F.col("h") + 24).alias("r_end"))
    return joins.overlap(left, right, ["user_id"], 168).select("user_id", "event_type", "event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing, props AS args FROM events")
def json_args(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), F.col("props").alias("args"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_gap_30m(spark, sf_dir):
    found = streams.gap_sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return streams.tumbling_counts(table(spark, sf_dir, "events")).select(F.unix_micros("start").alias("start"), "event_type", "n")


# ---- relational shapes


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_entities(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_entities(spark, sf_dir):
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(building, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


ARMS = [("none",), ("tail",), ("artifact",), ("retrieval",)]


@query(f"SELECT arm, doc_id, quality FROM labels CROSS JOIN (VALUES {sql_values(ARMS)}) AS a(arm)")
def arms_cross(spark, sf_dir):
    return evaluation.arms_by_questions(values(spark, ARMS, "arm string"), table(spark, sf_dir, "labels")).select("arm", "doc_id", "quality")


@query(
    """WITH t AS (SELECT source AS session_key, CASE WHEN quality = 1 THEN 'tail' ELSE 'none' END AS arm, lang AS class, toxic = 0 AS correct, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, CAST(doc_id % 4 AS BIGINT) AS expansions FROM labels JOIN documents USING (doc_id))
SELECT session_key, arm, class, CAST(grouping(session_key, arm, class) AS INTEGER) AS level, count(*) AS asked, count(*) FILTER (correct) AS correct, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(expansions) AS BIGINT) AS expansions,
  CASE WHEN count(*) FILTER (correct) > 0 THEN CAST(sum(tokens) AS BIGINT) // count(*) FILTER (correct) ELSE -1 END AS tokens_per_correct
FROM t GROUP BY GROUPING SETS ((session_key, arm, class), (session_key, arm), (arm, class), (arm))"""
)
def score_grouping_sets(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    t = both.select(F.col("source").alias("session_key"), F.when(F.col("quality") == 1, "tail").otherwise("none").alias("arm"), F.col("lang").alias("class"), (F.col("toxic") == 0).alias("correct"), X.tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 4).alias("expansions"))
    return evaluation.score(t).drop("accuracy").withColumn("tokens_per_correct", F.coalesce("tokens_per_correct", F.lit(-1)))


@query("WITH i AS (SELECT source AS session_key, CASE lang WHEN 'en' THEN 'next_action' WHEN 'fr' THEN 'goal' ELSE 'decision' END AS kind, doc_id AS seq FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY session_key, kind ORDER BY seq DESC) AS k FROM i) SELECT session_key, kind, seq, k <= CASE kind WHEN 'goal' THEN 1 WHEN 'next_action' THEN 3 ELSE 2147483647 END AS kept FROM r")
def active_limit(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "next_action").when(F.col("lang") == "fr", "goal").otherwise("decision")
    return state.active_limit(table(spark, sf_dir, "documents").select(F.col("source").alias("session_key"), kind.alias("kind"), F.col("doc_id").alias("seq")))


@query(
    f"""WITH {CONV}, g AS (SELECT session_key, idx, row_number() OVER (PARTITION BY session_key ORDER BY idx) AS k, count(*) OVER (PARTITION BY session_key) AS n FROM conv WHERE kind = 'user_message')
SELECT session_key, 'G' || k AS id, CASE WHEN k = n THEN 'active' ELSE 'superseded' END AS status, CASE WHEN k < n THEN 'G' || (k + 1) END AS detail, idx AS last_confirmed FROM g"""
)
def state_replay(spark, sf_dir):
    """Every user turn sets the goal; each goal supersedes the one before."""
    s = sessions(spark, sf_dir).where("kind = 'user_message'")
    op = F.to_json(F.struct(F.array(F.struct(F.lit("add").alias("op"), F.lit("goal").alias("kind"), F.concat(F.lit("turn "), F.col("idx")).alias("text"), F.array(F.struct(F.col("idx").alias("start"), F.col("idx").alias("end"))).alias("sources"))).alias("ops")))
    none = F.array().cast("array<string>")
    batches = s.select("session_key", F.format_string("c%06d", "idx").alias("chunk"), F.col("idx").alias("evt_start"), F.col("idx").alias("evt_end"), F.array("idx").alias("visible"), none.alias("human"), none.alias("paths"), op.alias("ops"))
    return state.items(batches).select("session_key", "id", "status", "detail", "last_confirmed")


DIRECTIVES = [
    (1, "Please never push to main.", "prohibition"),
    (2, "And also, do not rename the public functions.", "negative directive,untouchable"),
    (3, "From now on always run the tests first.", "standing directive"),
    (4, "Can you never do that?", ""),
    (5, "The tests must never break.", ""),
    (6, "1. **Don't** touch the lock file", "negative directive,untouchable"),
    (7, "Only use the staging key for this.", "exclusivity"),
    (8, "NEVER PUSH TO MAIN AGAIN", ""),
    (9, "Ask before you delete any data", "permission gate"),
    (10, "Keep in mind that the port changes.", "reminder"),
    (11, "Never do:", ""),
    (12, "important: the header stays", "emphasis"),
]


@query(f"SELECT id, families FROM (VALUES {sql_values([(i, f) for i, _, f in DIRECTIVES])}) AS v(id, families)")
def directive_scan(spark, sf_dir):
    d = values(spark, [(i, t) for i, t, _ in DIRECTIVES], "id int, text string")
    return d.select("id", F.array_join(triage.markers(X.clean_sentence(F.col("text"))), ",").alias("families"))


GOLDENS = [
    ("normalize", "cd /repo && cargo test", "cargo test"),
    ("normalize", "TOKEN=abc123 cargo test", "TOKEN=*** cargo test"),
    ("normalize", "cd a && cd b &&   ls   -l", "ls -l"),
    ("category", "cargo test --all", "test"),
    ("category", "pnpm build", "build"),
    ("category", "cargo clippy", "lint"),
    ("category", "git commit -m x", "git"),
    ("category", "npm install", "package_manager"),
    ("category", "python3 a.py", "run"),
    ("category", "ls", "other"),
    ("signature", "error at /a/b.rs:12 after 35ms", "error at <path> after <dur>"),
    ("signature", "error at /c/d.rs:99 after 8ms", "error at <path> after <dur>"),
    ("signature", "commit deadbeef1 has 12 files", "commit <hex> has <n> files"),
    ("range", "3..7", "3-6"),
    ("range", "3..=7", "3-7"),
    ("range", "7..3", ""),
    ("headline", "a  b c", "a b c"),
    ("quote", "“Never” push, (please)!", "never push please"),
    ("fence", "a ```` b", "`````"),
]


@query(f"SELECT kind, input, output FROM (VALUES {sql_values(GOLDENS)}) AS v(kind, input, output)")
def scalar_goldens(spark, sf_dir):
    g, t = values(spark, [(k, i) for k, i, _ in GOLDENS], "kind string, input string"), F.col("input")
    r = X.parse_range(t)
    of = {
        "normalize": X.normalize_command(t),
        "category": X.categorize(t),
        "signature": X.normalize_signature(t),
        "range": F.coalesce(F.concat_ws("-", r["start"], r["end"]), F.lit("")),
        "headline": X.headline(t),
        "quote": X.normalize_quote(t),
        "fence": X.fence_for(t),
    }
    return g.select("kind", "input", F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in of.items()]).alias("output"))


SCOPES = [(1, "a,b"), (2, ""), (3, "c"), (4, "b,d")]
CHUNKS = [(1, "a"), (2, "b,c"), (3, "e")]


@query(
    f"""WITH s(id, scope) AS (VALUES {sql_values(SCOPES)}), c(chunk, subsystems) AS (VALUES {sql_values(CHUNKS)})
SELECT chunk, id FROM c, s WHERE scope = '' OR list_has_any(string_split(scope, ','), string_split(subsystems, ','))"""
)
def scope_overlap(spark, sf_dir):
    found = values(spark, SCOPES, "id int, scope string").select(F.lit("s").alias("session_key"), F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(F.split("scope", ",")).alias("scope"), F.col("id").alias("evt"), F.lit("t").alias("text"), F.lit(1).alias("rank"))
    own = values(spark, CHUNKS, "chunk int, subsystems string").select(F.lit("s").alias("session_key"), "chunk", F.split("subsystems", ",").alias("subsystems"))
    return triage.governing(found, own).select("chunk", F.col("evt").alias("id"))


# ---- facts on whole sessions


@query(f"WITH {EV}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY evt) AS before FROM ev) SELECT user_id, evt, event_type FROM l WHERE before IS NULL OR before <> event_type")
def consecutive_dedup(spark, sf_dir):
    own = calls(spark, sf_dir).select(F.col("user_id").alias("session_key"), "evt", "event_type")
    return S.without_repeats(own, "event_type").select(F.col("session_key").alias("user_id"), "evt", "event_type")


@query(f"WITH {EV} SELECT user_id, evt, upper(left(event_type, 1)) || row_number() OVER (PARTITION BY user_id, event_type ORDER BY evt) AS id FROM ev")
def item_ids(spark, sf_dir):
    own = calls(spark, sf_dir).select(F.col("user_id").alias("session_key"), "evt", "event_type")
    return S.numbered(own, "event_type", "evt", F.upper(F.left("event_type", F.lit(1)))).select(F.col("session_key").alias("user_id"), "evt", "id")


@query(
    f"""WITH {EV}, s AS (SELECT user_id, evt FROM ev WHERE event_type = 'signup'), c AS (SELECT user_id, evt AS chunk FROM ev WHERE event_type = 'purchase'),
r AS (SELECT c.user_id, chunk, s.evt, row_number() OVER (PARTITION BY c.user_id, chunk ORDER BY s.evt DESC) AS k FROM c JOIN s ON s.user_id = c.user_id AND s.evt < chunk)
SELECT user_id, chunk, evt FROM r WHERE k <= 3"""
)
def prior_summaries(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("session_key", F.col("user_id"))
    found = c.where("event_type = 'signup'").select("session_key", "evt", F.lit("").alias("text"))
    own = c.where("event_type = 'purchase'").select("session_key", F.col("evt").alias("chunk"), F.col("evt").alias("evt_start"))
    return S.prior_summaries(found, own).select(F.col("session_key").alias("user_id"), "chunk", "evt")


@query(
    f"""WITH RECURSIVE {MERGED} SELECT m.session_key, m.episode AS chunk, array_to_string(list(n.episode ORDER BY n.episode) FILTER (n.episode IS NOT NULL), ',') AS later
FROM merged m LEFT JOIN merged n ON n.session_key = m.session_key AND n.episode > m.episode GROUP BY ALL"""
)
def later_index(spark, sf_dir):
    found = segment.episodes(rows(spark, sf_dir), MIN_EPISODE)
    own = found.select("session_key", F.col("episode").alias("chunk"), F.col("episode").alias("last_episode"))
    later = F.array_join(F.transform("later", lambda x: x.cast("string")), ",")
    return S.later_index(found, own).select("session_key", "chunk", F.nullif(later, F.lit("")).alias("later"))


@query(f"WITH {EV}, n AS (SELECT user_id, event_type, count(*) FILTER (event_id % 8 = 0) AS n FROM ev GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, length(event_type), event_type)) AS path FROM n WHERE n > 0 GROUP BY user_id")
def busiest_path(spark, sf_dir):
    n = calls(spark, sf_dir).groupBy(F.col("user_id").alias("session_key"), F.col("event_type").alias("path")).agg(F.count_if(F.col("event_id") % 8 == 0).alias("edits"))
    return S.busiest(n).select(F.col("session_key").alias("user_id"), "path")


@query(
    f"""WITH RECURSIVE {MASKED}, e AS (SELECT session_key, tier_rank AS section, pos AS rank, tokens + 2 AS cost, row_number() OVER (PARTITION BY session_key ORDER BY tier_rank, pos) AS k,
  row_number() OVER (PARTITION BY session_key, tier_rank ORDER BY pos) AS nth FROM rows_), w AS (
  SELECT session_key, 0 AS k, CAST({PAGE} AS BIGINT) AS remaining, -1 AS section, -1 AS rank, false AS kept, false AS broken FROM e GROUP BY session_key
  UNION ALL
  SELECT session_key, k, CASE WHEN kept THEN greatest(remaining - cost, 0) ELSE remaining END, section, rank, kept, NOT kept FROM (
    SELECT e.session_key, e.k, w.remaining, e.cost, e.section, e.rank, CASE WHEN e.nth = 1 THEN true WHEN w.broken THEN false ELSE e.cost <= w.remaining END AS kept
    FROM w JOIN e ON e.session_key = w.session_key AND e.k = w.k + 1))
SELECT session_key, section, rank FROM w WHERE kept"""
)
def ledger_slice(spark, sf_dir):
    own = segment.positions(rows(spark, sf_dir)).select("session_key", F.col("tier_rank").alias("section"), F.col("pos").alias("rank"), "text")
    return S.ledger_slice(own, PAGE, 10_000).select("session_key", "section", "rank")


@query(f"WITH RECURSIVE {MERGED} SELECT c.session_key, count(*) AS events, (SELECT count(*) FROM merged m WHERE m.session_key = c.session_key) AS episodes FROM conv c GROUP BY c.session_key")
def dry_run(spark, sf_dir):
    r = rows(spark, sf_dir)
    found = segment.episodes(r, MIN_EPISODE)
    return S.dry_run(sessions(spark, sf_dir), r, found, segment.chunks(found, BUDGET)).select("session_key", "events", "episodes")


@query(f"WITH {EV}, l AS (SELECT user_id, event_type, max(evt) AS evt FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY evt DESC, event_type) AS rank FROM l WHERE event_type <> 'view') SELECT user_id, CAST(rank AS INTEGER) AS rank, 'fix: ' || event_type AS action FROM r WHERE rank <= 3")
def next_actions(spark, sf_dir):
    runs = calls(spark, sf_dir).select(F.col("user_id").alias("session_key"), F.col("event_type").alias("normalized"), (F.col("event_type") != "view").alias("failed"), F.lit("run").alias("category"), "evt")
    none = spark.createDataFrame([], "session_key long, sig string, status string, occurrences long")
    return S.next_actions(runs, none).select(F.col("session_key").alias("user_id"), "rank", "action")


# ---- events as sessions with tools, through the ledgers

WORK = f"""{EV}, w AS (
  SELECT CAST(user_id AS VARCHAR) AS session_key, evt * 2 AS evt, event_id, event_type, 'src/m' || event_id % 5 || '.rs' AS path, event_id % 3 = 0 AS broken,
    CASE event_id % 4 WHEN 0 THEN 'cargo test -q' WHEN 1 THEN 'cargo build > out.log' WHEN 2 THEN 'git commit -m step' ELSE 'git push origin main' END AS normalized,
    CASE event_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'build' ELSE 'git' END AS category FROM ev), run AS (
  SELECT session_key, evt, event_id, normalized, category, event_type = 'error' AS failed,
    CASE WHEN event_type = 'error' THEN 'error: task ' || CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END || ' failed'
      WHEN event_id % 4 = 2 THEN '[main ' || left(md5(CAST(event_id AS VARCHAR)), 8) || '] step ' || event_id WHEN event_id % 4 = 3 THEN 'see https://h.example/pull/' || event_id % 3 ELSE 'fine' END AS output
  FROM w WHERE event_type IN ('click', 'error'))"""
OPS = """ops AS (
  SELECT session_key, path, evt, 'edit' AS op, false AS inferred FROM w WHERE event_type = 'signup'
  UNION ALL SELECT session_key, path, evt, 'read', false FROM w WHERE event_type = 'view'
  UNION ALL SELECT session_key, 'out.log', evt, 'create', true FROM run WHERE event_id % 4 = 1), led AS (
  SELECT session_key, path, string_agg(op, ',' ORDER BY evt) AS ops, bool_or(op = 'create') AS created, count(*) FILTER (op <> 'read') AS edits, count(*) FILTER (op = 'read') AS reads,
    min(evt) AS first_evt, max(evt) AS last_evt, bool_and(inferred) AS inferred FROM ops GROUP BY ALL)"""


def tool_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's ``events`` as a session: views read a file, signups edit one (each third fails), clicks and errors run commands, purchases set the plan."""
    c, n = calls(spark, sf_dir), F.col("event_id")
    choose = lambda m, *values: F.element_at(F.array(*map(F.lit, values)), (n % m + 1).cast("int"))
    kind, digits = F.col("event_type"), n.cast("string")
    shell, plan = kind.isin("click", "error"), kind == "purchase"
    args = F.when(shell, F.to_json(F.struct(choose(4, "cargo test -q", "cd /w && cargo build > out.log", "git commit -m step", "git push origin main").alias("command"))))
    args = args.otherwise(F.to_json(F.struct(F.concat(F.lit("src/m"), n % 5, F.lit(".rs")).alias("file_path"))))
    failed = F.concat(F.lit("error: task "), choose(3, "alpha", "beta", "gamma"), F.lit(" failed"))
    told = F.when(n % 4 == 2, F.concat(F.lit("[main "), F.left(F.md5(digits.cast("binary")), F.lit(8)), F.lit("] step "), digits)).when(n % 4 == 3, F.concat(F.lit("see https://h.example/pull/"), n % 3)).otherwise("fine")
    broken = (kind == "error") | ((kind == "signup") & (n % 3 == 0))
    output = F.when(kind == "error", failed).when(broken, "error: no match").when(shell, told).otherwise("fine")
    own = c.select(F.col("user_id").cast("string").alias("session_key"), (F.col("evt") * 2).alias("at"), plan.alias("is_plan"), shell.alias("shell"), kind.alias("type"), n.alias("n"), args.alias("args"), output.alias("output"), broken.alias("broken"))
    call = {
        "idx": F.col("at"),
        "kind": F.when(F.col("is_plan"), "plan_update").otherwise("tool_call"),
        "tool_class": F.when(F.col("shell"), "shell").when(F.col("type") == "signup", "edit").when(F.col("type") == "view", "read"),
        "args": F.when(~F.col("is_plan"), F.col("args")),
        "plan": F.when(F.col("is_plan"), F.array(F.struct(F.concat(F.lit("step "), F.col("n")).alias("text"), F.when(F.col("n") % 2 == 0, "completed").otherwise("in_progress").alias("status")))),
    }
    result = {"idx": F.col("at") + 1, "kind": F.lit("tool_result"), "output": F.col("output"), "is_error": F.col("broken")}
    both = {"session_key": F.col("session_key"), "is_active": F.lit(True), "stream": F.lit(0), "call_id": F.concat(F.lit("c"), F.col("n"))}
    schema = spark.createDataFrame([], E.SCHEMA).schema
    shaped = lambda df, known: df.select(*[(both | known).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    return shaped(own, call).unionByName(shaped(own.where("NOT is_plan"), result))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in names})


@query(f"WITH {WORK} SELECT session_key, evt, normalized, category, failed, CASE WHEN failed THEN 'FAILED' ELSE 'ok' END AS status, output AS output_head FROM run")
def command_ledger(spark, sf_dir):
    return _long(ledgers.commands(tool_sessions(spark, sf_dir)), "evt").select("session_key", "evt", "normalized", "category", "failed", "status", "output_head")


ERRORS = f"""{WORK}, e AS (
  SELECT session_key, evt + 1 AS evt, output AS msg FROM run WHERE failed UNION ALL SELECT session_key, evt + 1, 'error: no match' FROM w WHERE event_type = 'signup' AND broken), g AS (
  SELECT session_key, msg, min(evt) AS first_evt, max(evt) AS last_evt, count(*) AS occurrences FROM e GROUP BY ALL), c AS (
  SELECT g.session_key, msg, first_evt, last_evt, occurrences, arg_max(r.normalized, r.evt) AS command FROM g LEFT JOIN run r ON r.session_key = g.session_key AND r.evt <= first_evt GROUP BY ALL), l AS (
  SELECT c.session_key, msg, first_evt, last_evt, occurrences, command, max(r.evt) FILTER (r.evt > last_evt) AS later, arg_max(r.failed, r.evt) FILTER (r.evt > last_evt) AS later_failed, arg_max(r.failed, r.evt) AS any_failed
  FROM c LEFT JOIN run r ON r.session_key = c.session_key AND r.normalized = command GROUP BY ALL), errs AS (
  SELECT session_key, left(sha256(msg), 12) AS sig, msg AS example, first_evt, last_evt, occurrences, coalesce(command, '') AS command,
    CASE WHEN command IS NULL THEN 'unknown' WHEN later IS NOT NULL THEN CASE WHEN later_failed THEN 'unresolved' ELSE 'resolved' END WHEN any_failed THEN 'unresolved' ELSE 'unknown' END AS status,
    CASE WHEN NOT later_failed THEN coalesce(later, -1) ELSE -1 END AS resolved_evt FROM l)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tool_sessions(spark, sf_dir)
    return ledgers.errors(found, ledgers.commands(found))


@query(f"WITH {ERRORS} SELECT * FROM errs")
def errors_of_sessions(spark, sf_dir):
    return _long(_errors(spark, sf_dir), "first_evt", "last_evt", "resolved_evt").withColumn("command", F.coalesce("command", F.lit("")))


@query(f"WITH {ERRORS} SELECT session_key, sig, occurrences FROM errs WHERE status = 'unresolved' AND occurrences >= 3")
def dead_ends_of_sessions(spark, sf_dir):
    return ledgers.dead_ends(_errors(spark, sf_dir)).select("session_key", "sig", "occurrences")


@query(f"WITH {WORK}, {OPS} SELECT * FROM led")
def file_ledger(spark, sf_dir):
    found = ledgers.files(tool_sessions(spark, sf_dir)).withColumn("ops", F.array_join("ops", ","))
    return _long(found, "first_evt", "last_evt").drop("deleted", "moved_to")


@query(f"WITH {WORK}, {OPS} SELECT session_key, path, edits FROM led WHERE edits > 0")
def edited_files(spark, sf_dir):
    return ledgers.edited(ledgers.files(tool_sessions(spark, sf_dir))).select("session_key", "path", "edits")


@query(f"WITH {WORK} SELECT session_key, path, arg_max(NOT broken, evt) AS last_edit_succeeded FROM w WHERE event_type = 'signup' GROUP BY ALL")
def edit_outcome_ledger(spark, sf_dir):
    return ledgers.edit_outcomes(tool_sessions(spark, sf_dir))


@query(f"WITH {WORK} SELECT session_key, max(evt) AS evt, CASE WHEN arg_max(event_id, evt) % 2 = 0 THEN '☑' ELSE '▸' END || ' step ' || arg_max(event_id, evt) AS shown FROM w WHERE event_type = 'purchase' GROUP BY session_key")
def last_plan(spark, sf_dir):
    return _long(ledgers.plan(tool_sessions(spark, sf_dir)), "evt").select("session_key", "evt", M.plan_line(F.col("items")).alias("shown"))


@query(f"WITH {WORK} SELECT session_key, evt, left(md5(CAST(event_id AS VARCHAR)), 8) AS sha, 'step ' || event_id AS subject FROM run WHERE NOT failed AND event_id % 4 = 2")
def git_commits(spark, sf_dir):
    return _long(ledgers.git(ledgers.commands(tool_sessions(spark, sf_dir)))[0], "evt")


@query(
    f"""WITH {WORK}, u AS (SELECT session_key, output, min(evt) AS evt FROM run WHERE NOT failed AND event_id % 4 = 3 GROUP BY ALL), p AS (SELECT session_key, string_agg(replace(output, 'see ', ''), ' ' ORDER BY evt) AS pull_requests FROM u GROUP BY ALL)
SELECT s.session_key, coalesce(pull_requests, '') AS pull_requests, pull_requests IS NOT NULL AS pushed FROM (SELECT DISTINCT session_key FROM run) s LEFT JOIN p ON p.session_key = s.session_key"""
)
def git_facts(spark, sf_dir):
    return ledgers.git(ledgers.commands(tool_sessions(spark, sf_dir)))[1].select("session_key", F.array_join("pull_requests", " ").alias("pull_requests"), "pushed")


@query(f"WITH {WORK}, {OPS}, a AS (SELECT session_key, path AS area, edits + reads AS work, row_number() OVER (PARTITION BY session_key ORDER BY edits + reads DESC, path) AS k FROM led) SELECT session_key, area, work FROM a WHERE k <= 5")
def work_areas(spark, sf_dir):
    return ledgers.work_areas(ledgers.files(tool_sessions(spark, sf_dir)))


@query(f"WITH {CONV} SELECT session_key, CAST(idx AS BIGINT) AS evt, 'user' AS role, {R.redact_sql('text')} AS text FROM conv WHERE kind = 'user_message'")
def message_ledger(spark, sf_dir):
    return _long(ledgers.messages(sessions(spark, sf_dir)), "evt")


@query(
    f"""WITH {CONV}, k AS (SELECT session_key, min(idx) AS evt FROM conv WHERE kind = 'user_message' GROUP BY session_key, idx % 3)
SELECT session_key, CAST(evt AS BIGINT) AS evt, row_number() OVER (PARTITION BY session_key ORDER BY evt DESC) AS rank FROM k"""
)
def top_constraints(spark, sf_dir):
    """Each user turn forbids one of three things; what is said again is kept once."""
    said = sessions(spark, sf_dir).withColumn("text", F.when(F.col("kind") == "user_message", F.concat(F.lit("Never push to branch number "), F.col("idx") % 3, F.lit("."))).otherwise(F.col("text")))
    return _long(triage.constraints(said), "evt", "rank").select("session_key", "evt", "rank")


@query(
    f"""WITH {CONV}, m AS (SELECT session_key, CASE WHEN CAST(session_key AS BIGINT) % 2 = 0 THEN min(idx) ELSE max(idx) END AS edge FROM conv WHERE idx IN (2, 5) GROUP BY session_key)
SELECT c.session_key, c.idx FROM conv c LEFT JOIN m ON m.session_key = c.session_key WHERE c.idx >= coalesce(edge, 0)"""
)
def since_compaction(spark, sf_dir):
    """Turns 2 and 5 are boundaries: windowed ones in even conversations, replacing ones in the others."""
    mark = F.col("idx").isin(2, 5)
    marked = sessions(spark, sf_dir).withColumns({"kind": F.when(mark, "system").otherwise(F.col("kind")), "subtype": F.when(mark, "native_compaction").otherwise(F.col("subtype")), "windowed": F.col("session_key").cast("long") % 2 == 0})
    return E.since_compaction(marked).select("session_key", "idx")


ANSWER = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}/._-]+', ' ', 'g'))"


@query(f"SELECT doc_id, {ANSWER.format('source')} <> '' AND contains({ANSWER.format('text')}, {ANSWER.format('source')}) AS correct FROM documents")
def answer_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.correct(F.col("text"), F.col("source")).alias("correct"))


@query("SELECT doc_id, CAST(doc_id AS INTEGER) || '-' || CAST(doc_id + 4 AS INTEGER) || ' ' || CAST(doc_id AS INTEGER) || '-' || CAST(doc_id + 1 AS INTEGER) AS ranges FROM documents")
def expansion_requests(spark, sf_dir):
    n = F.col("doc_id")
    answer = F.concat(F.lit("Let me see. EXPAND "), n, F.lit(".."), n + 5, F.lit(" and EXPAND "), n, F.lit("..="), n + 1)
    shown = F.transform(evaluation.expansions(answer), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, " ").alias("ranges"))


# ---- reconciliation of the ledgers with snapshots


@query(f"WITH {WORK}, {OPS} SELECT session_key, path, CASE WHEN path IN ('src/m3.rs', 'src/m4.rs') THEN 'missing' WHEN edits > 0 AND path = 'src/m1.rs' THEN 'changed' ELSE 'known' END AS finding FROM led WHERE NOT inferred")
def reconciled_files(spark, sf_dir):
    found = ledgers.files(tool_sessions(spark, sf_dir))
    there = found.where(F.col("path").isin("src/m0.rs", "src/m1.rs", "src/m2.rs")).select("session_key", "path")
    return state.reconcile(found, there, there.where("path = 'src/m1.rs'"))


@query(f"WITH {WORK} SELECT session_key, evt, left(md5(CAST(event_id AS VARCHAR)), 8) AS sha FROM run WHERE NOT failed AND event_id % 8 = 6")
def missing_commits(spark, sf_dir):
    """The repository has every second commit of a session."""
    commits = ledgers.git(ledgers.commands(tool_sessions(spark, sf_dir)))[0]
    known = calls(spark, sf_dir).where("event_id % 8 = 2").select(F.col("user_id").cast("string").alias("session_key"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    return _long(state.missing_commits(commits, known), "evt").select("session_key", "evt", "sha")


@query(
    f"""WITH {WORK}, p AS (SELECT session_key, max(evt) AS evt, arg_max(event_id, evt) AS n FROM w WHERE event_type = 'purchase' GROUP BY session_key),
r AS (SELECT session_key, max(evt) AS evt, arg_max(normalized, evt) AS c, arg_max(failed, evt) AS failed FROM run GROUP BY session_key)
SELECT coalesce(p.session_key, r.session_key) AS session_key, CASE WHEN n % 2 = 1 THEN 'from the plan: step ' || n ELSE 'last command: ' || c || ' — ' || CASE WHEN failed THEN 'FAILED' ELSE 'ok' END END AS text,
  CASE WHEN n % 2 = 1 THEN p.evt ELSE r.evt END AS evt FROM p FULL JOIN r ON p.session_key = r.session_key WHERE n % 2 = 1 OR c IS NOT NULL"""
)
def derived_step(spark, sf_dir):
    found = tool_sessions(spark, sf_dir)
    none = spark.createDataFrame([], "session_key string, kind string, status string")
    return _long(state.derived_step(none, ledgers.plan(found), ledgers.commands(found)), "evt").select("session_key", "text", "evt")


# ---- questions, provenance and projections


@query(
    f"""WITH {ERRORS}, {OPS}, conv AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text FROM conversations), s AS (SELECT DISTINCT session_key FROM w), q AS (
  SELECT session_key, 'goal' AS id, array_to_string(list_slice(string_split_regex(trim({R.redact_sql("arg_min(text, idx)")}), '\\s+'), 1, 8), ' ') AS key, min(idx) AS evt FROM conv WHERE role = 'user' GROUP BY session_key
  UNION ALL SELECT session_key, 'busiest-file', arg_max(path, (edits, length(path), path)), arg_max(last_evt, (edits, length(path), path)) FROM led WHERE edits > 0 GROUP BY session_key
  UNION ALL SELECT session_key, 'last-commit', 'step ' || arg_max(event_id, evt), max(evt) FROM run WHERE NOT failed AND event_id % 4 = 2 GROUP BY session_key
  UNION ALL SELECT session_key, 'unresolved', arg_min(sig, (-occurrences, sig)), arg_min(last_evt, (-occurrences, sig)) FROM errs WHERE status = 'unresolved' GROUP BY session_key
  UNION ALL SELECT session_key, 'user-turns', '0', 0 FROM s
  UNION ALL SELECT session_key, 'dir', CASE WHEN CAST(session_key AS BIGINT) % 2 = 0 THEN '/w' ELSE '' END, 0 FROM s) SELECT session_key, id, key, CAST(evt AS BIGINT) AS evt FROM q"""
)
def brief_questions(spark, sf_dir):
    """The sessions made from events; their first wish is that of the conversation of the same number."""
    found = tool_sessions(spark, sf_dir)
    runs = ledgers.commands(found)
    folders = found.select("session_key").distinct().where(F.col("session_key").cast("long") % 2 == 0).withColumn("cwd", F.lit("/w"))
    asked = evaluation.brief_questions(found, ledgers.messages(sessions(spark, sf_dir)), ledgers.files(found), ledgers.git(runs)[0], ledgers.errors(found, runs), folders)
    return _long(asked, "evt").select("session_key", "id", "key", "evt")


NAMED = """n AS (SELECT CAST(user_id AS VARCHAR) AS session_key, 2 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) + 1 AS evt, event_type, event_id FROM events),
a AS (SELECT session_key, evt, 'https://h.example/pull/' || event_id % 3 AS key, row_number() OVER (PARTITION BY session_key ORDER BY evt) - 1 AS pos, count(*) OVER (PARTITION BY session_key) AS n FROM n WHERE event_type = 'click' AND event_id % 4 = 3)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sessions made from events, the results that name an address: others have no telling word."""
    return tool_sessions(spark, sf_dir).where("kind = 'tool_result' AND output LIKE 'see %'")


@query(f"WITH {NAMED} SELECT session_key, evt, key FROM a WHERE n * 85 // 100 >= 2 AND pos < n * 85 // 100 AND pos // (n * 85 // 100 // 2) < 2 AND pos = (pos // (n * 85 // 100 // 2)) * (n * 85 // 100 // 2) + (n * 85 // 100 // 2) // 2")
def deep_questions(spark, sf_dir):
    return _long(evaluation.questions(_named(spark, sf_dir), 2), "evt").select("session_key", "evt", "key")


@query(f"WITH {NAMED} SELECT session_key, evt, key FROM a WHERE n - pos <= 2")
def recent_questions(spark, sf_dir):
    return _long(evaluation.recent_questions(_named(spark, sf_dir), 2), "evt").select("session_key", "evt", "key")


@query("SELECT doc_id, ' (+' || len(string_split(regexp_replace(text, '\n$', ''), chr(10))) || CASE WHEN doc_id % 2 = 0 THEN ' −1' ELSE '' END || ')' AS stat FROM documents WHERE text <> ''")
def edit_statistics(spark, sf_dir):
    args = F.to_json(F.struct(F.col("text").alias("new_string"), F.when(F.col("doc_id") % 2 == 0, "one line\n").alias("old_string")))
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", M.edit_stat(args).alias("stat"))


@query("SELECT l_orderkey, '[' || string_agg(CASE WHEN l_linenumber = l_suppkey % 7 THEN 'evt ' || l_linenumber ELSE 'evt ' || least(l_linenumber, l_suppkey % 7) || '–' || greatest(l_linenumber, l_suppkey % 7) END, ', ' ORDER BY l_linenumber, l_suppkey % 7) || ']' AS provenance, CAST(min(least(l_linenumber, l_suppkey % 7)) AS BIGINT) AS first_evt, CAST(max(greatest(l_linenumber, l_suppkey % 7)) AS BIGINT) AS last_evt FROM lineitem GROUP BY l_orderkey")
def item_provenance(spark, sf_dir):
    """Each order as an item that cites one range of events for each of its lines, bounds either way round."""
    own = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_suppkey") % 7).cast("long").alias("end"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(own)).alias("sources"))
    return items.select("l_orderkey", state.provenance(F.col("sources")).alias("provenance"), state.span(F.col("sources"))["start"].alias("first_evt"), state.span(F.col("sources"))["end"].alias("last_evt"))


@query(f"WITH {CONV} SELECT session_key, idx AS evt, 'evt ' || idx || ' ' || left(CASE kind WHEN 'user_message' THEN '[user] ' ELSE '[assistant] ' END || text, 1200) AS line FROM conv WHERE kind <> 'system'")
def described_events(spark, sf_dir):
    return render.described(sessions(spark, sf_dir))


@query(f"WITH {CONV} SELECT session_key, idx, kind, text FROM conv")
def projected_events(spark, sf_dir):
    """The events as one JSON object for each session, and out of it again."""
    own = sessions(spark, sf_dir).select("session_key", "idx", "kind", "text")
    return plans.unprojected(plans.projected({"events": own}), "events", own.schema.json())


# the queries of the other modules
import sessionloom.queries_document  # noqa: E402, F401
import sessionloom.queries_state  # noqa: E402, F401
import sessionloom.queries_transcripts  # noqa: E402, F401
