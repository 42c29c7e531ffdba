"""More registered queries: operators on tagged histories, blocks, concepts, ledgers and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import csv_set, fence, lines, session_key
from ..operators import enrich, requests, retrieval, snapshots, touches, turns
from ..sources import code, providers
from ..sources.tables import messages, table, tool_calls
from .catalogue import CALLS, query

# A: tagged histories and blocks


@query("""WITH t AS (SELECT conv_id AS session, turn AS seq, role, CASE turn % 5 WHEN 1 THEN 'summary' WHEN 2 THEN 'full_turn' WHEN 3 THEN 'file_ledger' END AS kind FROM conversations),
w AS (SELECT *, sum(CASE WHEN role <> 'system' OR kind IS NOT NULL THEN 1 ELSE 0 END) OVER o AS lead, row_number() OVER o AS place FROM t WINDOW o AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, CASE WHEN lead = 0 AND place <= 4 THEN 'pinned' ELSE coalesce(kind, 'new_activity') END AS bucket FROM w""")
def tagged_buckets(spark, sf_dir):
    kind = F.when(F.col("seq") % 5 == 1, "summary").when(F.col("seq") % 5 == 2, "full_turn").when(F.col("seq") % 5 == 3, "file_ledger")
    return turns.classify(messages(spark, sf_dir).withColumn("kind", kind)).select("session", "seq", "bucket")


@query("""WITH r AS (SELECT conv_id AS session, turn // 2 AS turn, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'full_turn' ELSE 'summary' END AS kind, text FROM conversations),
m AS (SELECT *, max(CASE WHEN kind = 'full_turn' THEN 1 ELSE 0 END) OVER (PARTITION BY session, turn) = 1 AS has_full, turn > max(turn) OVER (PARTITION BY session) - 1 AS recent,
  min(CASE WHEN kind = 'full_turn' THEN seq END) OVER (PARTITION BY session, turn) AS head, max(CASE WHEN kind = 'summary' THEN seq END) OVER (PARTITION BY session, turn) AS tail FROM r)
SELECT session, turn, seq, 'full_turn' AS kind, text FROM m WHERE kind = 'full_turn' AND recent
UNION ALL SELECT session, turn, seq, 'summary', 'short ' || text FROM m WHERE kind = 'full_turn' AND NOT recent AND seq = head
UNION ALL SELECT session, turn, seq, 'summary', text FROM m WHERE NOT has_full AND seq = tail""")
def demoted_turns(spark, sf_dir):
    reps = messages(spark, sf_dir).select("session", F.floor(F.col("seq") / 2).alias("turn"), "seq", F.when(F.col("seq") % 3 == 0, "full_turn").otherwise("summary").alias("kind"), "text", F.concat(F.lit("short "), "text").alias("summary"))
    return turns.demote(reps, 1)


def _blocks():
    """Thinking and an image in every message, text that is blank in every third, a tool call in every second."""
    block = lambda kind, **own: F.struct(F.lit(kind).alias("type"), *[own.get(c, F.lit(None).cast("string")).alias(c) for c in ("text", "thinking", "name", "input", "content", "source")])
    text = F.when(F.col("seq") % 3 == 0, "  \n").otherwise(F.col("text"))
    call = block("tool_use", name=F.lit("read_file"), input=F.to_json(F.struct(F.col("seq").alias("line"))))
    every = F.array(block("thinking", thinking=F.lit("hm")), block("text", text=text), block("image", source=F.lit("x.png")), F.when(F.col("seq") % 2 == 0, call))
    return F.filter(every, lambda b: b.isNotNull())


BLOCK_SQL = """
numbered AS (SELECT conv_id AS session, turn AS seq, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations),
kept AS (SELECT session, CAST(turn AS BIGINT) AS turn, seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE text END AS said, CASE WHEN seq % 2 = 0 THEN 'read_file({"line":' || seq || '})' END AS call FROM numbered)"""


@query(f"""WITH {BLOCK_SQL}
SELECT session, turn, seq, row_number() OVER (PARTITION BY session, turn ORDER BY seq) = 1 AS head, concat_ws(chr(10), said, call) AS text FROM kept WHERE coalesce(said, call) IS NOT NULL""")
def full_turn_blocks(spark, sf_dir):
    rows = turns.segment(messages(spark, sf_dir)).withColumn("blocks", _blocks())
    return turns.full_turns(rows).select("session", "turn", "seq", "head", turns.message_text("blocks").alias("text"))


@query(f"""WITH {BLOCK_SQL} SELECT session, seq, concat_ws(chr(10), 'hm', coalesce(said, '  ' || chr(10)), '[image x.png]', call) AS text FROM kept""")
def block_texts(spark, sf_dir):
    rows = turns.segment(messages(spark, sf_dir)).withColumn("blocks", _blocks())
    return rows.select("session", "seq", turns.message_text("blocks").alias("text"))


@query("""SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'read_file({"line":' || turn || '})' ELSE 'r' || turn || ' ok' END AS text FROM conversations""")
def block_chat_tools(spark, sf_dir):
    """Tool calls and results of chats in blocks."""
    rows = messages(spark, sf_dir)
    call = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "seq").alias("id"), F.lit("read_file").alias("name"), F.struct(F.col("seq").alias("line")).alias("input"))).alias("content")))
    result = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), F.col("seq") - 1).alias("tool_use_id"), F.concat(F.lit("r"), "seq", F.lit(" ok")).alias("content"))).alias("content")))
    chat = rows.select("session", "seq", F.when(F.col("seq") % 2 == 0, call).otherwise(result).alias("message"))
    return providers.from_block_chat(chat).select("session", "seq", turns.message_text("blocks").alias("text"))


@query("SELECT event_id AS request, event_type NOT IN ('view', 'error') AS is_turn, event_type = 'view' AS is_empty FROM events")
def request_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    tools = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).when(F.col("event_type") != "error", F.array("event_type"))
    said = F.when(F.col("event_type") == "error", "failed").otherwise(F.lit(" "))
    return rows.select(F.col("event_id").alias("request"), requests.is_turn(tools).alias("is_turn"), requests.is_empty(said, tools).alias("is_empty"))


# A: ledgers

LEDGERS = """
led AS (SELECT session, path, turn % 2 AS half, min(turn) AS a, max(turn) AS b, count(*) FILTER (kind = 'read') AS r, count(*) FILTER (kind = 'write') AS w FROM touches GROUP BY 1, 2, 3)"""


@query(f"""WITH {CALLS},{LEDGERS}
SELECT session, path, min(a) AS first_seen_turn, max(b) AS last_touched_turn, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(w) AS BIGINT) AS writes,
CASE WHEN count(*) FILTER (half = 1) > 0 THEN 'later' WHEN path LIKE '%1.py' THEN 'prior' ELSE '' END AS description FROM led GROUP BY session, path""")
def merged_ledger(spark, sf_dir):
    seen = touches.detect(tool_calls(spark, sf_dir))
    prior, now = (touches.ledger(seen.where(F.col("turn") % 2 == k)) for k in (0, 1))
    prior = prior.withColumn("description", F.when(F.col("path").endswith("1.py"), "prior").otherwise(" "))
    out = touches.merge_ledgers(prior, now.withColumn("description", F.lit("later")))
    return out.withColumn("description", F.trim("description"))


@query(f"""WITH {CALLS} SELECT session, path, CASE WHEN path LIKE '%3.py' THEN 'three' ELSE 'plain' END AS description FROM touches GROUP BY session, path""")
def refined_ledger(spark, sf_dir):
    own = touches.ledger(touches.detect(tool_calls(spark, sf_dir))).select("session", "path", F.lit("plain").alias("description"))
    better = own.select("session", "path", F.when(F.col("path").endswith("3.py"), " three ").otherwise(" ").alias("refined")).where("path LIKE '%3.py' OR path LIKE '%4.py'")
    return touches.refine(own, better)


@query("""SELECT event_id AS seq, 'src/f' || json_extract_string(props, '$.k') || '.py' AS path, CASE event_type WHEN 'view' THEN 'read' ELSE 'write' END AS kind
FROM events WHERE event_type IN ('view', 'purchase')""")
def custom_tool_touches(spark, sf_dir):
    """Tools and a path key of the caller's own, beside the built-in ones."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase', 'click')")
    path = F.concat(F.lit("src/f"), F.get_json_object("props", "$.k"), F.lit(".py"))
    calls = rows.select(
        F.col("user_id").alias("session"), F.lit(1).cast("long").alias("turn"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "My_Reader").when(F.col("event_type") == "click", "nobodys_tool").otherwise("MyEditor").alias("name"),
        F.to_json(F.struct(path.alias("srcPath"))).alias("input"),
    )
    return touches.detect(calls, write=("myeditor",), read=("my_reader",), path_keys=("srcPath",)).select("seq", "path", "kind")


# B: texts, files and concepts


@query("SELECT doc_id, coalesce(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), '') AS cut FROM documents")
def source_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines(F.col("text"), F.lit(2), F.lit(4)).alias("cut"))


ENDINGS = (".py", ".tsx", ".jsx", ".mts", ".js", ".md", ".min.js", ".d.ts")
_ENDING = f"list_extract([{', '.join(repr(e) for e in ENDINGS)}], CAST(doc_id % {len(ENDINGS)} AS INT) + 1)"


def _tree(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 5 == 0, "node_modules/").when(F.col("doc_id") % 5 == 1, ".git/").otherwise("src/")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % len(ENDINGS)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, "source", F.lit("/f"), F.col("doc_id").cast("string"), ending).alias("file"), F.octet_length("text").alias("length"))


@query(f"""WITH f AS (SELECT doc_id, {_ENDING} AS e, strlen(text) AS n FROM documents)
SELECT doc_id, CASE WHEN e = '.py' THEN 'python' WHEN e IN ('.tsx', '.jsx') THEN 'tsx' WHEN e IN ('.mts', '.d.ts') THEN 'typescript' WHEN e IN ('.js', '.min.js') THEN 'javascript' ELSE '' END AS fence,
doc_id % 5 > 1 AND e NOT IN ('.md', '.min.js', '.d.ts') AND coalesce(n, 0) <= 4096 AS is_source FROM f""")
def source_tree(spark, sf_dir):
    """Folders that are skipped, generated files, other endings and long files are no sources."""
    rows = _tree(spark, sf_dir)
    return rows.select("doc_id", fence(F.col("file")).alias("fence"), code.is_source(F.col("file"), F.coalesce("length", F.lit(0)), limit=code.size_limit("4")).alias("is_source"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}\-_.]', '_', 'g') AS key FROM pages")
def session_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", session_key(F.col("url")).alias("key"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS words FROM part")
def name_sets(spark, sf_dir):
    listed = F.concat(F.lit(" ,"), F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")), F.lit(",,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(csv_set(listed)), ",").alias("words"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || p_type WHEN p_partkey % 3 = 1 THEN p_type ELSE 'part-' || p_partkey END AS text FROM part")
def embedding_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = enrich.embedding_text(F.when(k % 3 == 0, F.col("p_name")), F.when(k % 3 < 2, F.col("p_type")).otherwise(""), F.concat(F.lit("part-"), k))
    return rows.select("p_partkey", text.alias("text"))


@query("SELECT doc_id % 20 AS concept_id, string_agg(DISTINCT source, ',' ORDER BY source) AS files FROM documents GROUP BY 1")
def member_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return requests.member_files(rows.select((F.col("doc_id") % 20).alias("concept_id"), F.col("doc_id").alias("node_id")), rows.select(F.col("doc_id").alias("node_id"), F.col("source").alias("file")))


@query("""WITH d AS (SELECT doc_id % 150 AS concept_id, doc_id AS node_id FROM documents),
a AS (SELECT concept_id, list(node_id ORDER BY node_id) AS m FROM d WHERE node_id % 31 <> 0 GROUP BY 1), b AS (SELECT concept_id, list(node_id ORDER BY node_id) AS m FROM d WHERE node_id % 29 <> 0 GROUP BY 1)
SELECT concept_id FROM a JOIN b USING (concept_id) WHERE a.m = b.m AND concept_id NOT IN (SELECT concept_id FROM d WHERE node_id % 31 <> 0 AND node_id % 37 = 0)""")
def unchanged_concepts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).alias("concept_id"), F.col("doc_id").alias("node_id"))
    return snapshots.unchanged_concepts(rows.where("node_id % 31 <> 0"), rows.where("node_id % 29 <> 0"), rows.where("node_id % 37 = 0"))


@query("SELECT vec_id AS concept_id, CASE WHEN vec_id % 2 = 0 THEN 'drop' ELSE 'embed' END AS action FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0 OR vec_id % 3 <> 0 AND vec_id % 2 <> 0")
def stale_embeddings(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("concept_id"))
    return snapshots.stale_embeddings(ids.where("concept_id % 3 <> 0"), ids.where("concept_id % 2 = 0"))


@query("""WITH e AS (SELECT l_orderkey AS src, -l_partkey AS dst FROM lineitem), c AS (SELECT o_orderkey AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT -p_partkey FROM part WHERE p_size = 1)
SELECT n AS node_id FROM c UNION SELECT dst FROM e WHERE src IN (SELECT n FROM c) UNION SELECT src FROM e WHERE dst IN (SELECT n FROM c)""")
def touched_nodes(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node_id"))
    parts = table(spark, sf_dir, "part").where("p_size = 1").select((-F.col("p_partkey")).alias("node_id"))
    return snapshots.touched(orders.unionAll(parts), edges)


QUERY_VECTOR = [((7 * k) % 11 - 5) / 4 for k in range(64)]
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


@query(f"""WITH s AS (SELECT vec_id AS concept_id, round(list_dot_product(embedding::DOUBLE[], {_VEC}) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12) * (sqrt(list_dot_product({_VEC}, {_VEC})) + 1e-12)), 6) AS score FROM embeddings)
SELECT concept_id, score, CAST(row_number() OVER (ORDER BY score DESC, concept_id) AS INT) AS rank FROM s ORDER BY score DESC, concept_id LIMIT 5""")
def nearest_concepts(spark, sf_dir):
    """The top-k report of a text query's vector."""
    return retrieval.nearest_concepts(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vec")), QUERY_VECTOR)


@query("""WITH m AS (SELECT p_size AS c, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n, 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS node_id, p_name AS code FROM part)
SELECT c AS concept_id, c AS place, '## size ' || c || chr(10) || 'parts' || chr(10) || string_agg('### ' || node_id || chr(10) || '```python' || chr(10) || code || chr(10) || '```', chr(10) ORDER BY n) AS text
FROM m WHERE n <= 40 GROUP BY c""")
def concept_digests(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    node = F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    concepts = part.select(F.col("p_size").alias("concept_id")).distinct().withColumn("tag", F.concat(F.lit("size "), "concept_id")).withColumn("summary", F.lit("parts"))
    entities = part.select(node.alias("node_id"), F.lit("x.py").alias("file"), F.col("p_name").alias("code"))
    placed = concepts.select("concept_id", F.col("concept_id").alias("place"))
    return retrieval.digest(placed, concepts, part.select(F.col("p_size").alias("concept_id"), node.alias("node_id")), entities)
