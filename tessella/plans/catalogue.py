"""Registered queries over the driver's tables, each beside the SQL that a plain engine runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasoning import normal_level, request_params
from ..functions.text import archive_key, first_command, json_object, looks_like_path, read_paths, shell_words
from ..operators import archive, graph, requests, retrieval, similarity, snapshots, touches, turns
from ..sources import code, providers
from ..sources.tables import files, links, messages, table, tool_calls
from ..streaming import clock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


# A: conversations

MARKED = """
counted AS (
  SELECT conv_id AS session, turn AS seq, role, text,
    CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS turn,
    sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER w AS talk,
    row_number() OVER w AS place,
    coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), 0) AS last_user
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
marked AS (
  SELECT session, seq, role, text, turn, last_user,
    CASE WHEN talk = 0 AND place <= 4 THEN 'pinned' WHEN seq >= last_user THEN 'live' ELSE 'done' END AS bucket
  FROM counted)"""
SNIPPET = r"substring(trim(regexp_replace({x}, '\s+', ' ', 'g')), 1, 280)"
TRANSCRIPT = "string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY seq)"
SUMMARY = "'[turn] ' || " + SNIPPET.format(x=TRANSCRIPT) + " || ' (recall: turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') || ')'"


def body_sql(n: int) -> str:
    return f"""
latest AS (SELECT *, max(turn) OVER (PARTITION BY session) AS cur FROM marked WHERE bucket = 'done'),
body AS (
  SELECT session, 'full_turn' AS kind, turn, seq, role, text FROM latest WHERE turn > cur - {n}
  UNION ALL
  SELECT session, 'summary', turn, min(seq), 'assistant', {SUMMARY} FROM latest WHERE turn <= cur - {n} GROUP BY session, turn)"""


def compact_sql(n: int) -> str:
    return f"""WITH {MARKED},{body_sql(n)}
SELECT session, kind, CAST(section AS INT) AS section, turn, seq, role, text FROM (
  SELECT session, 'pinned' AS kind, 0 AS section, turn, seq, role, text FROM marked WHERE bucket = 'pinned'
  UNION ALL SELECT session, kind, 1, turn, seq, role, text FROM body
  UNION ALL SELECT session, 'live', 3, turn, seq, role, text FROM marked WHERE bucket = 'live')"""


@query(compact_sql(1))
def compact_history(spark, sf_dir):
    return turns.compact(messages(spark, sf_dir), 1)


for _n in (0, 1, 2):
    QUERIES[f"recency_window_n{_n}"] = lambda spark, sf_dir, n=_n: turns.recency(turns.segment(messages(spark, sf_dir)), n)
    ORACLES[f"recency_window_n{_n}"] = f"WITH {MARKED},{body_sql(_n)} SELECT session, kind, turn, seq, role, text FROM body"


@query(f"WITH {MARKED} SELECT session, seq, role, turn FROM marked")
def turn_segments(spark, sf_dir):
    return turns.segment(messages(spark, sf_dir)).select("session", "seq", "role", "turn")


@query(f"WITH {MARKED} SELECT session, seq, text FROM marked WHERE bucket = 'pinned'")
def pinned_prefix(spark, sf_dir):
    return turns.segment(messages(spark, sf_dir)).where("bucket = 'pinned'").select("session", "seq", "text")


@query(f"WITH {MARKED} SELECT session, seq, seq >= last_user AS live FROM marked")
def inflight_split(spark, sf_dir):
    return turns.segment(messages(spark, sf_dir)).select("session", "seq", (F.col("seq") >= F.col("last_user")).alias("live"))


@query(f"""WITH {MARKED} SELECT session, count(*) FILTER (bucket = 'pinned') AS pinned, count(*) FILTER (bucket = 'done') AS done,
count(*) FILTER (bucket = 'live') AS live FROM marked GROUP BY session""")
def bucket_counts(spark, sf_dir):
    return turns.bucket_counts(turns.segment(messages(spark, sf_dir)), ["pinned", "done", "live"])


@query(f"WITH {MARKED} SELECT session, turn, min(seq) AS seq, {TRANSCRIPT} AS transcript FROM marked GROUP BY session, turn")
def turn_transcripts(spark, sf_dir):
    return turns.transcripts(turns.segment(messages(spark, sf_dir)), "session", "turn")


@query(f"""WITH {MARKED} SELECT session, turn, min(seq) AS seq, {SNIPPET.format(x=TRANSCRIPT)} AS snippet,
'turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS archive_key, {SUMMARY} AS summary FROM marked WHERE bucket = 'done' GROUP BY session, turn""")
def fallback_summaries(spark, sf_dir):
    return turns.summaries(turns.segment(messages(spark, sf_dir)).where("bucket = 'done'"))


@query("SELECT conv_id AS session, CAST(sum(length(text)) AS BIGINT) // 4 AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, sf_dir):
    return turns.token_estimate(messages(spark, sf_dir), "session")


@query(f"""WITH {MARKED},
archived AS (SELECT session, turn, 'turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS archive_key, {TRANSCRIPT} AS detail,
  {SNIPPET.format(x=TRANSCRIPT)} AS summary FROM marked WHERE bucket = 'done' GROUP BY session, turn),
asked AS (SELECT DISTINCT session, 'turn-' || lpad(CAST(turn + 1 AS VARCHAR), 4, '0') AS archive_key FROM marked)
SELECT r.session, r.archive_key, a.turn IS NOT NULL AS found,
  CASE WHEN a.turn IS NULL THEN 'No archived turn found for key ''' || r.archive_key || '''.'
  ELSE 'Recalled turn ' || a.turn || ' (key ' || r.archive_key || ') — turn' || chr(10) || 'Summary was: ' || a.summary || chr(10) || '--- full detail ---' || chr(10) || a.detail END AS text
FROM asked r LEFT JOIN archived a USING (session, archive_key)""")
def recall_lookup(spark, sf_dir):
    marked = turns.segment(messages(spark, sf_dir))
    asked = marked.select("session", archive_key(F.col("turn") + 1).alias("archive_key")).distinct()
    return archive.recall(asked, archive.archive_turns(marked))


@query("SELECT conv_id AS session, turn AS seq, role, text FROM conversations UNION ALL SELECT -1, turn, role, text FROM conversations WHERE conv_id = 0")
def session_fork(spark, sf_dir):
    return archive.fork(messages(spark, sf_dir), 0, -1)


@query(f"""WITH {MARKED},{body_sql(1)},
out AS (SELECT session, text FROM marked WHERE bucket <> 'done' UNION ALL SELECT session, text FROM body),
a AS (SELECT session, count(*) AS m, CAST(sum(length(text)) AS BIGINT) // 4 AS t FROM marked GROUP BY session),
b AS (SELECT session, count(*) AS m, CAST(sum(length(text)) AS BIGINT) // 4 AS t FROM out GROUP BY session)
SELECT session, a.m AS messages_before, a.t AS tokens_before, coalesce(b.m, 0) AS messages_after, coalesce(b.t, 0) AS tokens_after, 'rework' AS event FROM a LEFT JOIN b USING (session)""")
def compaction_audit(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return archive.audit_compaction(rows, turns.compact(rows, 1))


@query("SELECT conv_id AS session, turn AS seq, role, text FROM conversations WHERE conv_id % 2 = 1 OR turn >= 2")
def fresh_suffix(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return turns.fresh(rows, rows.where("session % 2 = 0").select("session", F.lit(2).alias("folded")).distinct())


@query(f"""WITH {MARKED}, lead AS (SELECT session, string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (talk = 0) AS host FROM counted GROUP BY session)
SELECT session, -1 AS seq, 'system' AS role, CASE WHEN host IS NULL THEN 'ours' ELSE 'ours' || chr(10) || chr(10) || host END AS text FROM lead
UNION ALL SELECT session, seq, role, text FROM counted WHERE talk > 0""")
def system_override(spark, sf_dir):
    return requests.override_system(messages(spark, sf_dir), "ours", "prefix")


HOSTED = f"""{MARKED}, told AS (SELECT *, CASE WHEN role = 'system' AND session % 2 = 0 THEN text || '<env>os ' || session || chr(10) || 'x</env> tail' ELSE text END AS said FROM counted),
lead AS (SELECT session, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY seq) FILTER (talk = 0), '') AS host FROM told GROUP BY session)"""


def _hosted(spark, sf_dir):
    """Conversations whose host adds an <env> block to the system prompts of every second session."""
    block = F.concat("text", F.lit("<env>os "), "session", F.lit("\nx</env> tail"))
    return messages(spark, sf_dir).withColumn("text", F.when((F.col("role") == "system") & (F.col("session") % 2 == 0), block).otherwise(F.col("text")))


def _overridden(text: str) -> str:
    return f"WITH {HOSTED} SELECT session, -1 AS seq, 'system' AS role, {text} AS text FROM lead UNION ALL SELECT session, seq, role, said FROM told WHERE talk > 0"


@query(_overridden("'ours'"))
def system_replaced(spark, sf_dir):
    return requests.override_system(_hosted(spark, sf_dir), "ours")


@query(_overridden("CASE host WHEN '' THEN 'ours' ELSE host || chr(10) || chr(10) || 'ours' END"))
def system_suffixed(spark, sf_dir):
    return requests.override_system(_hosted(spark, sf_dir), "ours", "suffix")


@query(_overridden("CASE WHEN contains(host, '<env>') THEN 'ours' || chr(10) || chr(10) || '<env>os ' || session || chr(10) || 'x</env>' ELSE 'ours' END"))
def system_with_env(spark, sf_dir):
    return requests.override_system(_hosted(spark, sf_dir), "ours", "prefix_env")


@query("""SELECT conv_id AS session, turn AS seq, role, text FROM conversations UNION ALL
SELECT conv_id, max(turn) + k, CASE k WHEN 1 THEN 'assistant' ELSE 'user' END, CASE k WHEN 1 THEN '' ELSE 'please continue.' END FROM conversations, (VALUES (1), (2)) t(k) WHERE conv_id % 3 = 0 GROUP BY conv_id, k""")
def nudged_requests(spark, sf_dir):
    rows = messages(spark, sf_dir)
    empty = rows.where("session % 3 = 0").select("session", F.lit("").alias("text")).distinct()
    return requests.nudged(rows, empty)


# A: tool calls

CALLS = """
calls AS (SELECT user_id AS session, CAST(dayofyear(ts) AS BIGINT) AS turn, event_id AS seq, event_type,
  'src/f' || json_extract_string(props, '$.k') || '.py' AS path FROM events WHERE event_type <> 'error'),
touches AS (SELECT session, turn, seq, path, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'write' ELSE 'read' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'apply_patch' WHEN 'signup' THEN 'write_file' WHEN 'view' THEN 'Read' ELSE 'cat ' || path || ' | wc -l' END AS evidence FROM calls)"""
LEDGER = """
ledger AS (SELECT session, path, min(turn) AS first_seen_turn, max(turn) AS last_touched_turn, count(*) FILTER (kind = 'read') AS reads,
  count(*) FILTER (kind = 'write') AS writes, '' AS description FROM touches GROUP BY session, path)"""


@query(f"WITH {CALLS} SELECT session, turn, seq, CAST(0 AS INT) AS place, path, kind, evidence FROM touches")
def tool_touches(spark, sf_dir):
    return touches.detect(tool_calls(spark, sf_dir))


@query(f"WITH {CALLS},{LEDGER} SELECT * FROM ledger")
def file_ledger(spark, sf_dir):
    return touches.ledger(touches.detect(tool_calls(spark, sf_dir)))


@query(f"""WITH {CALLS},{LEDGER} SELECT session, 'File ledger (files the agent has touched):' || chr(10) ||
string_agg('- ' || path || ' — (no description yet)  [r' || reads || '/w' || writes || ']', chr(10) ORDER BY path) AS text FROM ledger GROUP BY session""")
def ledger_text(spark, sf_dir):
    return touches.rendered(touches.ledger(touches.detect(tool_calls(spark, sf_dir))))


@query(f"""WITH {CALLS} SELECT session, turn, path, min(seq * 1000) AS first_at, string_agg(kind || ' (' || evidence || ')', '; ' ORDER BY seq) AS evidence
FROM touches GROUP BY session, turn, path""")
def touch_evidence(spark, sf_dir):
    return touches.evidence(touches.detect(tool_calls(spark, sf_dir)))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'bash' WHEN 'purchase' THEN 'apply_patch' ELSE 'write_file' END AS name
FROM events WHERE event_type <> 'error'""")
def tool_filter(spark, sf_dir):
    tools = tool_calls(spark, sf_dir).select(F.col("seq").alias("event_id"), F.to_json(F.struct(F.struct(F.col("name")).alias("function"))).alias("tool"))
    return touches.allowed_tools(tools).select("event_id", "name")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Read' ELSE 'bash' END AS name FROM events WHERE event_type IN ('view', 'click')""")
def tool_filter_allow(spark, sf_dir):
    """Only named tools, in the shape without a function object."""
    tools = tool_calls(spark, sf_dir).select(F.col("seq").alias("event_id"), F.to_json(F.struct(F.col("name"), F.col("input"))).alias("tool"))
    return touches.allowed_tools(tools, allow=("Read", "bash")).select("event_id", "name")


@query("""SELECT event_id AS request, CASE event_type WHEN 'error' THEN 'auto' WHEN 'view' THEN 'Read' WHEN 'click' THEN 'bash' WHEN 'purchase' THEN 'apply_patch' ELSE 'write_file' END AS choice FROM events""")
def tool_choice_reset(spark, sf_dir):
    rows = tool_calls(spark, sf_dir).select(F.col("seq").alias("request"), F.col("name").alias("choice"))
    return touches.tool_choice(rows, rows.select("request", F.col("choice").alias("name")).where("name <> 'glob'"))


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 8 WHEN 0 THEN 'cat -n' WHEN 1 THEN '/usr/bin/head' WHEN 2 THEN 'rm' WHEN 3 THEN 'sed' WHEN 4 THEN 'cat "unclosed' WHEN 5 THEN 'wc' WHEN 6 THEN 'grep' ELSE 'cp' END AS command FROM part)
SELECT id, CASE id % 8 WHEN 2 THEN NULL WHEN 7 THEN NULL WHEN 4 THEN split_part(name, ' ', 1) || '/a.py' ELSE name || '/a.py' END AS paths FROM n""")
def shell_reads(spark, sf_dir):
    """Shell lines with a quoted path of two words, a plain word and a second command; one in eight doesn't close a quote."""
    k = F.col("p_partkey") % 8
    command = F.when(k == 0, "cat -n").when(k == 1, "/usr/bin/head").when(k == 2, "rm").when(k == 3, "sed").when(k == 4, 'cat "unclosed').when(k == 5, "wc").when(k == 6, "grep").otherwise("cp")
    path = F.when(k == 4, F.concat(F.substring_index("p_name", " ", 1), F.lit("/a.py"))).otherwise(F.concat(F.lit("'"), "p_name", F.lit("/a.py'")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(command, F.lit(" "), path, F.lit(" word | tail other.py")).alias("command"))
    rows = rows.withColumn("words", shell_words(first_command(F.col("command"))))
    paths = read_paths(F.col("words"))
    return rows.select("id", F.when(F.size(paths) > 0, F.array_join(paths, ",")).alias("paths"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '-' || p_name || '.py' WHEN 1 THEN p_name || '.' WHEN 2 THEN replace(p_name, ' ', '/') WHEN 3 THEN p_name || '.txt' WHEN 4 THEN '' ELSE p_name END AS name FROM part)
SELECT p_partkey, p_partkey % 6 IN (2, 3) AS path_like FROM n""")
def path_like_names(spark, sf_dir):
    """Names that begin like an option, end in a dot, hold a slash or an extension, are empty, or plain."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    made = F.when(k == 0, F.concat(F.lit("-"), name, F.lit(".py"))).when(k == 1, F.concat(name, F.lit("."))).when(k == 2, F.replace(name, F.lit(" "), F.lit("/"))).when(k == 3, F.concat(name, F.lit(".txt"))).when(k == 4, "").otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", looks_like_path(made).alias("path_like"))


# A: providers and settings


def _chat(spark, sf_dir):
    return messages(spark, sf_dir).select("session", "seq", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message"))


@query("SELECT conv_id AS session, turn AS seq, role, text FROM conversations")
def block_chat_source(spark, sf_dir):
    rows = providers.from_block_chat(_chat(spark, sf_dir))
    return rows.select("session", "seq", "role", turns.message_text("blocks").alias("text"))


@query(f"""WITH {MARKED}, lead AS (SELECT session, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM counted WHERE talk = 0 GROUP BY session)
SELECT session, seq, role, text FROM counted WHERE talk > 0 UNION ALL SELECT session, -1, 'system', text FROM lead""")
def block_chat_round_trip(spark, sf_dir):
    sent = providers.to_block_chat(providers.from_block_chat(_chat(spark, sf_dir)))
    back = providers.from_block_chat(sent.where("seq IS NOT NULL")).select("session", "seq", "role", turns.message_text("blocks").alias("text"))
    return back.unionByName(sent.where("seq IS NULL").select("session", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"), F.col("message").alias("text")))


@query("SELECT conv_id AS session, turn AS seq, CAST(0 AS INT) AS part, role, text FROM conversations")
def function_chat_round_trip(spark, sf_dir):
    sent = providers.to_function_chat(providers.from_function_chat(_chat(spark, sf_dir)))
    back = providers.from_function_chat(sent.where("part = 0")).select("session", "seq", F.lit(0).alias("part"), "role", turns.message_text("blocks").alias("text"))
    return back


@query("SELECT conv_id AS stream, 'assistant' AS role, string_agg(text, '' ORDER BY turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def event_stream(spark, sf_dir):
    said = messages(spark, sf_dir).where("role = 'assistant'")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("delta"))).alias("choices")))
    line = F.concat(F.lit("data: "), delta, F.lit("\n"))
    cut = F.lit(17)  # lines break inside of chunks
    chunks = said.select(F.col("session").alias("stream"), F.posexplode(F.array(F.substring(line, 1, 17), F.substring(line, cut + 1, F.length(line)))).alias("half", "data"), (F.col("seq") * 2).alias("base"))
    return providers.from_event_stream(chunks.select("stream", (F.col("base") + F.col("half")).alias("at"), "data")).select("stream", "role", "content")


@query("""SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'off' WHEN 4 THEN 'off' WHEN 5 THEN 'off' WHEN 6 THEN 'off' WHEN 7 THEN lower(p_type) WHEN 8 THEN lower(p_brand) ELSE 'high' END AS level FROM part""")
def reasoning_levels(spark, sf_dir):
    """Levels that aren't set, blank, spellings of off, and words with white space and capitals."""
    k = F.col("p_partkey") % 10
    raw = F.when(k == 1, "").when(k == 2, "  ").when(k == 3, "Off").when(k == 4, "NONE").when(k == 5, "0").when(k == 6, "disabled").when(k == 7, F.concat(F.lit("  "), F.upper("p_type"), F.lit("\t"))).when(k == 8, F.col("p_brand")).when(k == 9, " High ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), normal_level(raw).alias("level"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama-openai' WHEN 2 THEN 'ollama' WHEN 3 THEN 'anthropic' ELSE 'other' END AS provider,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'off' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' ELSE lower(c_mktsegment) END AS level FROM customer)
SELECT id, CASE WHEN level IS NULL THEN '{}' WHEN provider IN ('openai', 'ollama-openai') THEN '{"reasoning_effort":"' || CASE level WHEN 'off' THEN 'none' ELSE level END || '"}'
  WHEN provider = 'ollama' THEN CASE level WHEN 'off' THEN '{"think":false}' ELSE '{"think":"' || level || '"}' END
  WHEN provider = 'anthropic' AND level IN ('low', 'medium', 'high') THEN '{"thinking":{"type":"enabled","budget_tokens":' || CASE level WHEN 'low' THEN 1024 WHEN 'medium' THEN 4096 ELSE 16384 END || '}}' ELSE '{}' END AS params FROM r""")
def reasoning_params(spark, sf_dir):
    """Every kind of provider, in small and capital letters, with levels that are known, off, unknown or not set."""
    n, k = F.col("c_nationkey") % 5, F.col("c_custkey") % 6
    provider = F.when(n == 0, "openai").when(n == 1, "ollama-openai").when(n == 2, "ollama").when(n == 3, "anthropic").otherwise("other")
    provider = F.when(F.col("c_custkey") % 2 == 0, F.upper(provider)).otherwise(provider)
    level = F.when(k == 1, "off").when(k == 2, "low").when(k == 3, "medium").when(k == 4, "high").when(k == 5, F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), request_params(provider, level).alias("params"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 4 THEN '{"name": "' || p_name || '", "of": {"size": ' || p_size || '}}' END AS body FROM part""")
def answer_json(spark, sf_dir):
    """Answers that are an object, one in a fence, one between words, one in a bare fence, none, and one that doesn't close."""
    k = F.col("p_partkey") % 6
    body = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "of": {"size": '), "p_size", F.lit("}}"))
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), body, F.lit(" done."))).when(k == 3, F.concat(F.lit("```\n"), body, F.lit("\n```\n"))).when(k == 4, F.col("p_name")).otherwise(F.concat(F.lit("{"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), json_object(answer).alias("body"))


# B: snapshots

SNAPSHOTS = """
cur AS (SELECT source || '/' || doc_id || '.py' AS file, sha1(text || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 7 <> 0),
man AS (SELECT source || '/' || doc_id || '.py' AS file, sha1(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
changes AS (SELECT file, CASE WHEN m.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' ELSE 'changed' END AS status
  FROM cur c FULL JOIN man m USING (file) WHERE c.hash IS DISTINCT FROM m.hash)"""


def _snapshots(spark, sf_dir):
    """Two snapshots of the tree: rules on the id stand for edits; both cover all documents that they keep."""
    rows = files(spark, sf_dir)
    edited = F.concat("text", F.when(F.col("doc_id") % 10 == 3, "!").otherwise(""))
    current = rows.where("doc_id % 7 <> 0").select("file", F.sha1(edited.cast("binary")).alias("hash"))
    return current, rows.where("doc_id % 5 <> 0").select("file", F.sha1(F.col("text").cast("binary")).alias("hash"))


@query(f"WITH {SNAPSHOTS} SELECT file, status FROM changes")
def snapshot_diff(spark, sf_dir):
    return snapshots.diff(*_snapshots(spark, sf_dir))


@query(f"""WITH {SNAPSHOTS} SELECT c.file AS node_id, c.hash AS code_hash, m.file AS reused, m.file IS NULL AS needs_work
FROM cur c LEFT JOIN man m ON c.file = m.file AND c.hash = m.hash""")
def checkpoint_reuse(spark, sf_dir):
    current, known = _snapshots(spark, sf_dir)
    named = lambda d: d.select(F.col("file").alias("node_id"), F.col("hash").alias("code_hash"))
    return snapshots.reuse(named(current), named(known).withColumn("summary", F.col("node_id")))


@query(f"""WITH {SNAPSHOTS} SELECT l.doc_id, d.source || '/' || l.doc_id || '.py' AS file, l.quality FROM labels l JOIN documents d USING (doc_id)
WHERE d.source || '/' || l.doc_id || '.py' NOT IN (SELECT file FROM changes WHERE status <> 'added')""")
def delete_cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(files(spark, sf_dir).select("doc_id", "file"), "doc_id").select("doc_id", "file", "quality")
    return snapshots.cascade(rows, snapshots.diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {SNAPSHOTS} SELECT m.file, m.hash FROM man m WHERE m.file NOT IN (SELECT file FROM cur) UNION ALL SELECT file, hash FROM cur")
def snapshot_upsert(spark, sf_dir):
    current, known = _snapshots(spark, sf_dir)
    return snapshots.upsert(known, current, "file")


@query("""SELECT o_custkey AS file, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS node_ids FROM orders GROUP BY o_custkey
UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def manifest_ids(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.lit("").alias("hash"))
    owned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").cast("string").alias("node_id"))
    return snapshots.manifest(current, owned).select("file", "node_ids")


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1""")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").withColumn("ordinal", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return snapshots.last_by(rows, "l_partkey", "ordinal").drop("ordinal")


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
100 * count(*) FILTER (event_type IN ('purchase', 'error')) // count(*) AS percent, min_by(props, event_id) FILTER (event_type = 'error') AS first_error FROM events""")
def build_progress(spark, sf_dir):
    e = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.when(e == "purchase", "done").when(e == "error", "failed").otherwise("open").alias("status"), F.col("props").alias("error"))
    return snapshots.progress(rows)


@query("""WITH n AS (SELECT p_partkey, 'src/' || replace(p_name, ' ', '/') || CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.md' ELSE '.tsx' END AS file, p_size * 20000 AS length FROM part)
SELECT p_partkey, file FROM n WHERE p_partkey % 6 IN (0, 2, 5) AND length <= 524288""")
def source_files(spark, sf_dir):
    k = F.col("p_partkey") % 6
    ending = F.when(k == 0, ".py").when(k == 1, ".min.js").when(k == 2, ".ts").when(k == 3, ".d.ts").when(k == 4, ".md").otherwise(".tsx")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), ending).alias("file"), (F.col("p_size") * 20000).alias("length"))
    return rows.where(code.is_source(F.col("file"), F.col("length"))).select("p_partkey", "file")


# B: vectors and graphs

COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
NEAR = f"""
near AS (SELECT a.vec_id AS id, b.vec_id AS other, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) <= 8)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _near(spark, sf_dir, lazy=False):
    return similarity.neighbours(_vectors(spark, sf_dir), 8, above=0.35, lazy=lazy)


def _semantic(spark, sf_dir, lazy=False):
    """lazy: nothing is written, for a query that uses the edges once."""
    return similarity.semantic_edges(_near(spark, sf_dir, lazy), 0.35)


@query(f"SELECT b.vec_id AS id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 5")
def cosine_topk_query(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return similarity.nearest(rows.where("id = 0").select(F.col("id").alias("query_id"), "vec"), rows, 5).select("id", "score")


@query(f"WITH {NEAR} SELECT id, other, score FROM near WHERE score > 0.35")
def similarity_edges(spark, sf_dir):
    return _near(spark, sf_dir).where("score > 0.35").select("id", "other", "score")


CHAIN = "chain AS (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings)"
HYBRID = f"""{NEAR}, {CHAIN},
edges AS (SELECT src, dst, 1.0 AS w FROM chain WHERE dst IS NOT NULL UNION ALL SELECT id, other, score - 0.35 FROM near WHERE score > 0.35)"""


def _chain(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("dst"))
    return rows.where("dst IS NOT NULL")


@query(f"WITH {HYBRID} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(w), 6) AS weight FROM edges GROUP BY 1, 2")
def hybrid_weights(spark, sf_dir):
    return graph.hybrid_weights(_chain(spark, sf_dir), _semantic(spark, sf_dir, lazy=True)).withColumn("weight", F.round("weight", 6))


@query("""SELECT 'o' || l_orderkey || '::C' AS src, '-::part' || l_partkey AS dst, 'calls' AS type FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'o' || l_orderkey || '::C', '-::part' || l_partkey, 'inherits' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'o' || o_orderkey || '::C', 'o' || o_orderkey || '::C.m', 'contains' FROM orders""")
def name_resolution_edges(spark, sf_dir):
    none = F.array().cast("array<string>")
    name = F.concat(F.lit("part"), "p_partkey")
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("-::"), name).alias("node_id"), F.when(F.col("p_type") == "ECONOMY", "class").otherwise("function").alias("kind"), F.lit("-").alias("file"), name.alias("name"), none.alias("calls"), none.alias("bases"))
    used = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("part"), "l_partkey")).alias("used"))
    orders = table(spark, sf_dir, "orders").join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    own = F.concat(F.lit("o"), "o_orderkey")
    head = orders.select(F.concat(own, F.lit("::C")).alias("node_id"), F.lit("class").alias("kind"), own.alias("file"), F.concat(own, F.lit("C")).alias("name"), F.coalesce("used", none).alias("calls"), F.coalesce("used", none).alias("bases"))
    inner = orders.select(F.concat(own, F.lit("::C.m")).alias("node_id"), F.lit("method").alias("kind"), own.alias("file"), F.concat(own, F.lit("m")).alias("name"), none.alias("calls"), none.alias("bases"))
    return graph.structural_edges(head.unionByName(inner).unionByName(part))


@query(f"""WITH RECURSIVE {NEAR},
e AS (SELECT id AS a, other AS b FROM near WHERE score > 0.35 UNION SELECT other, id FROM near WHERE score > 0.35),
r AS (SELECT a AS v, a AS x FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.x = e.a)
SELECT v, min(x) AS root FROM r GROUP BY v""")
def components(spark, sf_dir):
    return graph.components(_semantic(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"""WITH {NEAR},
e AS (SELECT id AS a, other AS b FROM near WHERE score > 0.35 UNION SELECT other, id FROM near WHERE score > 0.35),
h0 AS (SELECT vec_id AS v FROM embeddings WHERE label = 3),
h1 AS (SELECT v FROM h0 UNION SELECT b FROM h0 JOIN e ON v = a),
h2 AS (SELECT v FROM h1 UNION SELECT b FROM h1 JOIN e ON v = a)
SELECT v FROM h2""")
def two_hop_touched(spark, sf_dir):
    seeds = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("v"))
    return graph.neighbourhood(seeds, _semantic(spark, sf_dir))


OVERLAP = """
new AS (SELECT vec_id % 12 AS community, vec_id AS node_id FROM embeddings),
old AS (SELECT 'concept-' || lpad(CAST(CASE WHEN vec_id % 12 IN (1, 5) THEN 1 WHEN vec_id % 12 = 7 AND vec_id % 5 = 0 THEN 40 ELSE vec_id % 12 END AS VARCHAR), 4, '0') AS concept_id, vec_id AS node_id FROM embeddings),
sizes AS (SELECT community, concept_id, count(*) AS c FROM new JOIN old USING (node_id) GROUP BY 1, 2),
scored AS (SELECT community, concept_id, c / (n + m - c) AS jaccard FROM sizes
  JOIN (SELECT community, count(*) AS n FROM new GROUP BY 1) USING (community) JOIN (SELECT concept_id, count(*) AS m FROM old GROUP BY 1) USING (concept_id))"""


def _concepts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    m = F.col("vec_id") % 12
    number = F.when(m.isin(1, 5), 1).when((m == 7) & (F.col("vec_id") % 5 == 0), 40).otherwise(m)
    return rows.select(m.alias("community"), F.col("vec_id").alias("node_id")), rows.select(F.format_string("concept-%04d", number.cast("int")).alias("concept_id"), F.col("vec_id").alias("node_id"))


@query(f"WITH {OVERLAP} SELECT community, concept_id, round(jaccard, 6) AS jaccard FROM scored WHERE jaccard >= 0.1")
def jaccard_overlap(spark, sf_dir):
    return graph.overlaps(*_concepts(spark, sf_dir), 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {OVERLAP}, s AS (SELECT * FROM scored WHERE jaccard >= 0.5),
k AS (SELECT community, count(*) AS k_new, max(concept_id) AS own FROM s GROUP BY 1),
o AS (SELECT concept_id AS own, count(*) AS k_old FROM s GROUP BY 1),
rows AS (SELECT n.community, CASE WHEN k_new = 1 AND k_old = 1 THEN own END AS own FROM (SELECT DISTINCT community FROM new) n LEFT JOIN k USING (community) LEFT JOIN o USING (own))
SELECT community, coalesce(own, 'concept-' || lpad(CAST(100 + sum(CASE WHEN own IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY community) - 1 AS VARCHAR), 4, '0')) AS concept_id FROM rows""")
def concept_identity(spark, sf_dir):
    return graph.identify(*_concepts(spark, sf_dir), threshold=0.5, next_number=100).select("community", "concept_id")


@query(f"""WITH {OVERLAP}, s AS (SELECT * FROM scored WHERE jaccard >= 0.1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY jaccard DESC, concept_id DESC) AS r1, row_number() OVER (PARTITION BY concept_id ORDER BY jaccard DESC, community DESC) AS r2 FROM s),
own AS (SELECT community, concept_id AS own FROM ranked WHERE r1 = 1 AND r2 = 1),
k AS (SELECT community, count(*) AS k_new, string_agg(concept_id, ',' ORDER BY concept_id) AS near FROM s GROUP BY 1),
o AS (SELECT concept_id AS own, count(*) AS k_old FROM s GROUP BY 1),
rows AS (SELECT n.community, own, near, coalesce(k_new > 1, false) AS merge, coalesce(k_old > 1, false) AS split FROM (SELECT DISTINCT community FROM new) n LEFT JOIN own USING (community) LEFT JOIN k USING (community) LEFT JOIN o USING (own)),
kept AS (SELECT *, own IS NOT NULL AND NOT merge AND NOT split AS stays FROM rows)
SELECT community, CASE WHEN stays THEN own ELSE 'concept-' || lpad(CAST(100 + sum(CASE WHEN stays THEN 0 ELSE 1 END) OVER (ORDER BY community) - 1 AS VARCHAR), 4, '0') END AS concept_id,
  CASE WHEN split THEN own END AS split_from, CASE WHEN merge THEN near END AS merged_from FROM kept""")
def concept_lineage(spark, sf_dir):
    """Ids of new communities with what they were split from or merged from; one round of mutual best pairs is the whole greedy pass here."""
    return graph.identify(*_concepts(spark, sf_dir), threshold=0.1, next_number=100)


@query("SELECT max(try_cast(regexp_extract(n, '-([0-9]+)$', 1) AS BIGINT)) + 1 AS next FROM (SELECT 'concept-' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS n FROM part UNION ALL SELECT 'odd')")
def next_concept_number(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.format_string("concept-%04d", "p_size").alias("concept_id"))
    return graph.next_number(rows.unionAll(spark.createDataFrame([("odd",)], "concept_id string")))


QUOTIENT = f"""{NEAR}, e AS (SELECT id AS src, other AS dst FROM near WHERE score > 0.35), m AS (SELECT vec_id, label FROM embeddings),
p AS (SELECT DISTINCT x.label AS concept, y.label AS neighbour FROM e JOIN m x ON src = x.vec_id JOIN m y ON dst = y.vec_id WHERE x.label <> y.label),
q AS (SELECT concept, neighbour FROM p UNION SELECT neighbour, concept FROM p)"""


def _members(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("concept_id"), F.col("vec_id").alias("node_id"))


@query(f"WITH {QUOTIENT} SELECT concept, neighbour FROM q")
def concept_neighbors(spark, sf_dir):
    return graph.quotient_neighbours(_semantic(spark, sf_dir, lazy=True), _members(spark, sf_dir))


@query(f"""WITH {QUOTIENT}, seeds AS (SELECT * FROM (VALUES (4, 1), (2, 2)) t(concept_id, rank)),
near_ones AS (SELECT rank, neighbour AS concept_id, row_number() OVER (PARTITION BY rank ORDER BY neighbour) AS sub FROM seeds JOIN q ON concept_id = concept),
listed AS (SELECT rank, 0 AS sub, concept_id FROM seeds UNION ALL SELECT rank, sub, concept_id FROM near_ones),
firsts AS (SELECT concept_id, min(rank * 100000 + sub) AS spot FROM listed GROUP BY 1)
SELECT CAST(concept_id AS INT) AS concept_id, CAST(row_number() OVER (ORDER BY spot) AS INT) AS place FROM firsts""")
def digest_expand(spark, sf_dir):
    near = graph.quotient_neighbours(_semantic(spark, sf_dir), _members(spark, sf_dir))
    seeds = spark.createDataFrame([(4, 1), (2, 2)], "concept_id int, rank int")
    return retrieval.expand(seeds, near, _members(spark, sf_dir).select("concept_id").distinct())


@query("SELECT p_partkey AS concept_id, p_name AS tag FROM part WHERE contains(p_name, 'ring') OR contains('ring', p_name) OR contains(p_name, 'red widget') OR contains('red widget', p_name)")
def tag_match(spark, sf_dir):
    concepts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("tag"))
    return retrieval.match_tags(concepts, ["Ring", "red widget"])


@query("SELECT string_agg(p_name || ': ' || p_type, chr(10) ORDER BY p_partkey) AS text FROM part")
def concept_index(spark, sf_dir):
    return retrieval.index_text(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("tag"), F.col("p_type").alias("summary")))


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT x.page_id AS a, y.page_id AS b, count(*) AS weight FROM l x JOIN l y USING (target) WHERE x.page_id < y.page_id GROUP BY 1, 2""")
def shared_target_edges(spark, sf_dir):
    return graph.shared_targets(links(spark, sf_dir))


# clock

GAPS = """
gapped AS (SELECT user_id AS key, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL {n} SECOND, true) AS starts FROM events),
runs AS (SELECT key, ts, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS BIGINT) AS run FROM gapped)"""


def _clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))


@query(f"WITH {GAPS.format(n=3600)} SELECT key, run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM runs GROUP BY key, run")
def idle_gaps(spark, sf_dir):
    return clock.idle_gaps(_clock(spark, sf_dir), 3600)


@query("SELECT user_id AS key, ts, event_id AS value FROM events QUALIFY coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - ts >= INTERVAL 1800 SECOND, true)")
def debounced_events(spark, sf_dir):
    return clock.debounced(_clock(spark, sf_dir), 1800)


def entry(spark: SparkSession) -> DataFrame:
    return compact_history(spark, "/root/testdata/sf0.001")


__all__ = ["ORACLES", "QUERIES", "entry"]
