"""Registered queries over source files made of documents: parsed entities, their edges, and the graph that follows edits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import communities, concepts, enrich, graph, incremental, retrieval, similarity
from ..sources import code
from ..sources.shared import Tables, shared_folder
from ..sources.snapshots import SnapshotStore
from ..sources.tables import sources, table
from .catalogue import CHAIN, NEAR, OVERLAP, QUOTIENT, _chain, _concepts, _members, _semantic, query


def rule(name: str, where: str = "true", salt: str = "''") -> str:
    """CTEs name_docs, name_refs (the numbers that a document's lines call) and name_code, as sources.tables.sources() writes the files."""
    return f"""
{name}_docs AS (SELECT doc_id AS d, source || '/' || doc_id || '.py' AS file, greatest(0, doc_id - 1 - doc_id % 8) AS b, {salt} AS salt,
  CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents WHERE {where}),
{name}_each AS (SELECT d, salt, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM {name}_docs),
{name}_refs AS (SELECT d, i, abs(d + CAST('0x' || substr(md5(line || salt), 1, 4) AS BIGINT) % 97 - 48) AS k FROM {name}_each),
{name}_text AS (SELECT d, string_agg('        Doc' || k || '(x)' || chr(10), '' ORDER BY i) AS body, string_agg('Doc' || k, ',' ORDER BY i) || ',' AS names FROM {name}_refs GROUP BY d),
{name}_code AS (
  SELECT x.d, b, file, file || '::Doc' || x.d AS c, len(lines) AS n, coalesce(names, '') || 'step' || x.d AS calls, 'class Doc' || x.d || '(Doc' || b || '):' AS head,
    'def run(self, x):' || chr(10) || coalesce(body, '') || '        return self.step' || x.d || '(x)' AS run,
    'def step' || x.d || '(self, x):' || chr(10) || '        return x' AS step
  FROM {name}_docs x LEFT JOIN {name}_text t ON x.d = t.d),
{name}_files AS (SELECT *, head || chr(10) || '    ' || run || chr(10) || '    ' || step AS content FROM {name}_code)"""


def entities_sql(name: str) -> str:
    return f"""
SELECT c AS node_id, 'class' AS kind, 1 AS span_start, CAST(n + 5 AS INTEGER) AS span_end, sha1(content) AS code_hash, head AS signature, 'Doc' || b AS bases, calls FROM {name}_files
UNION ALL SELECT c || '.run', 'method', 2, CAST(n + 3 AS INTEGER), sha1(run), 'def run(self, x):', '', calls FROM {name}_files
UNION ALL SELECT c || '.step' || d, 'method', CAST(n + 4 AS INTEGER), CAST(n + 5 AS INTEGER), sha1(step), 'def step' || d || '(self, x):', '', '' FROM {name}_files"""


def edges_sql(name: str) -> str:
    return f"""
SELECT c AS src, c || '.run' AS dst, 'contains' AS type FROM {name}_files
UNION ALL SELECT c, c || '.step' || d, 'contains' FROM {name}_files
UNION ALL SELECT c, c || '.step' || d, 'calls' FROM {name}_files
UNION ALL SELECT c || '.run', c || '.step' || d, 'calls' FROM {name}_files
UNION ALL SELECT x.c, y.c, 'calls' FROM {name}_refs r JOIN {name}_files x ON x.d = r.d JOIN {name}_files y ON y.d = r.k WHERE x.d <> y.d
UNION ALL SELECT x.c || '.run', y.c, 'calls' FROM {name}_refs r JOIN {name}_files x ON x.d = r.d JOIN {name}_files y ON y.d = r.k
UNION ALL SELECT x.c, y.c, 'inherits' FROM {name}_files x JOIN {name}_files y ON y.d = x.b"""


@query(f"WITH {rule('all')} {entities_sql('all')}")
def code_entities(spark, sf_dir):
    rows = code.parse(sources(spark, sf_dir))
    return rows.select("node_id", "kind", "span_start", "span_end", "code_hash", "signature", F.array_join("bases", ",").alias("bases"), F.array_join("calls", ",").alias("calls"))


@query(f"WITH {rule('all')} {edges_sql('all')}")
def code_edges(spark, sf_dir):
    return incremental.build(sources(spark, sf_dir)).edges


# Edits: of the documents by id, a tenth is new, a tenth is changed and a tenth is removed.

BEFORE = "doc_id % 10 <> 5"
AFTER = "doc_id % 10 <> 3"
SALT = "CASE WHEN doc_id % 10 = 4 THEN '!' ELSE '' END"
EDITED = f"{rule('old', BEFORE)}, {rule('new', AFTER, SALT)}"


def edits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The files before and after."""
    return sources(spark, sf_dir).where(BEFORE), sources(spark, sf_dir, salt=F.expr(SALT)).where(AFTER)


def _synced(spark, sf_dir) -> incremental.Synced:
    before, after = edits(spark, sf_dir)
    return incremental.sync(incremental.build(before), after)


@query(f"""WITH {EDITED}, rows AS ({entities_sql('new')}),
old AS (SELECT o.node_id, o.code_hash FROM ({entities_sql('old')}) o)
SELECT r.node_id, r.code_hash, r.signature, r.calls, o.node_id IS NOT NULL AND o.code_hash = r.code_hash AS same FROM rows r LEFT JOIN old o USING (node_id)""")
def graph_sync_entities(spark, sf_dir):
    """Entities after a sync; same: their code is as it was, told by the summaries (here the hash itself) that the sync keeps."""

    def digest(entities: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is None:
            return entities.withColumn("summary", F.concat(F.lit("known "), "code_hash"))
        return incremental.without_summaries(entities, known)

    before, after = edits(spark, sf_dir)
    rows = incremental.sync(incremental.build(before, digest=digest), after, digest=digest).graph.entities
    return rows.select("node_id", "code_hash", "signature", F.array_join("calls", ",").alias("calls"), (F.col("summary") == F.concat(F.lit("known "), "code_hash")).alias("same"))


@query(f"WITH {EDITED} {edges_sql('new')}")
def graph_sync_edges(spark, sf_dir):
    return _synced(spark, sf_dir).graph.edges


@query(f"WITH {EDITED} SELECT file, sha1(content) AS hash, c || ',' || c || '.run,' || c || '.step' || d AS node_ids FROM new_files")
def graph_sync_manifest(spark, sf_dir):
    return _synced(spark, sf_dir).graph.manifest.select("file", "hash", "node_ids")


TOUCHED = f"""{EDITED},
old_edges AS ({edges_sql('old')}), new_edges AS ({edges_sql('new')}),
changed AS (SELECT coalesce(o.d, n.d) AS d FROM old_files o FULL JOIN new_files n ON o.d = n.d WHERE o.content IS DISTINCT FROM n.content),
gone AS (SELECT e.node_id FROM ({entities_sql('old')}) e SEMI JOIN (SELECT c FROM old_files SEMI JOIN changed USING (d)) f ON split_part(e.node_id, '.py::', 1) = split_part(f.c, '.py::', 1)),
fresh AS (SELECT e.node_id FROM ({entities_sql('new')}) e SEMI JOIN (SELECT c FROM new_files SEMI JOIN changed USING (d)) f ON split_part(e.node_id, '.py::', 1) = split_part(f.c, '.py::', 1)),
both_ways AS (SELECT src AS a, dst AS b FROM new_edges UNION SELECT dst, src FROM new_edges),
h0 AS (SELECT node_id AS v FROM gone UNION SELECT node_id FROM fresh UNION SELECT dst FROM old_edges SEMI JOIN gone ON src = node_id UNION SELECT src FROM old_edges SEMI JOIN gone ON dst = node_id),
h1 AS (SELECT v FROM h0 UNION SELECT b FROM h0 JOIN both_ways ON v = a),
h2 AS (SELECT v FROM h1 UNION SELECT b FROM h1 JOIN both_ways ON v = a),
now AS (SELECT node_id FROM ({entities_sql('new')}))"""


@query(f"WITH {TOUCHED} SELECT v AS node_id FROM h2 SEMI JOIN now ON v = node_id")
def graph_sync_touched(spark, sf_dir):
    return _synced(spark, sf_dir).touched


@query(f"WITH {EDITED} SELECT 1 AS version, file, sha1(content) AS hash FROM old_files UNION ALL SELECT 2, file, sha1(content) FROM new_files")
def graph_store_versions(spark, sf_dir):
    """The manifests of two versions of a stored graph: one built, the next synced from what the store holds."""
    before, after = edits(spark, sf_dir)
    store = SnapshotStore(spark, f"{shared_folder(spark)}/graph-store-{uuid.uuid4().hex}")
    with Tables(spark, "graph") as tables:
        first = store.commit(incremental.build(before, tables=tables).tables())
        held = incremental.CodeGraph(**store.tables(first))
        second = store.commit(incremental.sync(held, after, tables=tables).graph.tables(), base=first)
    rows = [store.read("manifest", v).select(F.lit(k).alias("version"), "file", "hash") for k, v in enumerate((first, second), 1)]
    return rows[0].unionAll(rows[1])


# communities of vectors, tied by likeness and by chains of labels; two codebases by label

WEIGHTS = f"""{NEAR}, {CHAIN},
of AS (SELECT vec_id, label, 'c' || label % 2 AS codebase FROM embeddings),
ties AS (SELECT src, dst, 1.0 AS w FROM chain WHERE dst IS NOT NULL UNION ALL SELECT id, other, score - 0.35 FROM near WHERE score > 0.35),
w AS (SELECT x.codebase, x.label AS a, y.label AS b, w FROM ties JOIN of x ON x.vec_id = src JOIN of y ON y.vec_id = dst WHERE x.codebase = y.codebase),
total AS (SELECT codebase, sum(w) AS total, sum(CASE WHEN a = b THEN w ELSE 0 END) AS inside FROM w GROUP BY 1),
mass AS (SELECT codebase, label, sum(w) AS mass FROM (SELECT codebase, a AS label, w FROM w UNION ALL SELECT codebase, b, w FROM w) GROUP BY 1, 2),
labels_q AS (SELECT codebase, round(any_value(inside) / any_value(total) - sum((mass / (2 * total)) ** 2), 6) AS of_labels FROM mass JOIN total USING (codebase) GROUP BY 1)"""


def _weighted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(weights, nodes) of two codebases."""
    of = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label", F.concat(F.lit("c"), F.col("label") % 2).alias("codebase"))
    ties = graph.hybrid_weights(_chain(spark, sf_dir), _semantic(spark, sf_dir))
    ends = ties.join(of.select(F.col("node").alias("a"), "codebase"), "a").join(of.select(F.col("node").alias("b"), F.col("codebase").alias("other")), "b")
    return ends.where("codebase = other").select("codebase", "a", "b", "weight"), of


@query(f"WITH {WEIGHTS} SELECT vec_id AS node, of.codebase, 1 AS places, true AS connected, true AS better, of_labels FROM of JOIN labels_q USING (codebase)")
def community_detection(spark, sf_dir):
    """What must hold of the communities, for every node: it is in one, which is connected; modularity is at least that of the labels (of_labels)."""
    with Tables(spark, "community-detection") as tables:
        weights, nodes = (tables.keep(x) for x in _weighted(spark, sf_dir))
        found = tables.keep(communities.communities(weights, nodes))
        side = lambda k: found.select("codebase", F.col("node").alias(k), F.col("community").alias(f"{k}_of"))
        inside = weights.join(side("a"), ["codebase", "a"]).join(side("b"), ["codebase", "b"]).where("a_of = b_of")
        roots = graph.components(inside.select("a", "b")).select(F.col("v").alias("node"), "root")
        rooted = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = rooted.groupBy("codebase", "community").agg((F.min("root") == F.max("root")).alias("connected"))
        own = communities.modularity(weights, found).withColumnRenamed("modularity", "own")
        labels = communities.modularity(weights, nodes.withColumnRenamed("label", "community")).withColumnRenamed("modularity", "labels")
        quality = own.join(labels, "codebase").select("codebase", (F.col("own") >= F.col("labels")).alias("better"), F.round("labels", 6).alias("of_labels"))
        rows = found.groupBy("codebase", "node").agg(F.count("*").cast("int").alias("places"), F.first("community").alias("community"))
        kept = Tables(spark, "community-rows")
        return kept.keep(rows.join(parts, ["codebase", "community"]).join(quality, "codebase").select("node", "codebase", "places", "connected", "better", "of_labels"))


TOUCHED_NODES = "label = 3 AND vec_id % 12 = 2"


@query(f"""WITH {OVERLAP}, s AS (SELECT * FROM scored WHERE jaccard >= 0.5),
k AS (SELECT community, count(*) AS k_new, max(concept_id) AS own FROM s GROUP BY 1),
o AS (SELECT concept_id AS own, count(*) AS k_old FROM s GROUP BY 1),
rows AS (SELECT n.community, CASE WHEN k_new = 1 AND k_old = 1 THEN own END AS own FROM (SELECT DISTINCT community FROM new) n LEFT JOIN k USING (community) LEFT JOIN o USING (own)),
top AS (SELECT max(CAST(substr(concept_id, 9) AS INTEGER)) + 1 AS next FROM old),
ids AS (SELECT community, own, coalesce(own, 'concept-' || lpad(CAST((SELECT next FROM top) + sum(CASE WHEN own IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY community) - 1 AS VARCHAR), 4, '0')) AS concept_id FROM rows),
hit AS (SELECT DISTINCT community FROM new JOIN embeddings ON node_id = vec_id WHERE {TOUCHED_NODES}),
same AS (SELECT community FROM s WHERE jaccard = 1 AND community NOT IN (SELECT community FROM hit)),
ranked AS (SELECT community, vec_id, 't' || label || ': s' || vec_id AS line FROM new JOIN embeddings ON node_id = vec_id QUALIFY row_number() OVER (PARTITION BY community ORDER BY vec_id) <= 40),
prompt AS (SELECT community, string_agg(line, ' ' ORDER BY vec_id) AS text FROM ranked GROUP BY 1)
SELECT concept_id, own IS NULL OR community NOT IN (SELECT community FROM same) AS called,
  CASE WHEN own IS NULL OR community NOT IN (SELECT community FROM same) THEN substr(sha1(text), 1, 8) ELSE 'tag of ' || own END AS tag,
  CASE WHEN own IS NULL OR community NOT IN (SELECT community FROM same) THEN substr(text, 1, 280) ELSE 'summary of ' || own END AS summary
FROM ids JOIN prompt USING (community)""")
def concept_recluster(spark, sf_dir):
    """Concepts after edits: one is split, one has lost members, one is touched; the others stay verbatim."""
    new, old = _concepts(spark, sf_dir)
    named = lambda kind: F.concat(F.lit(f"{kind} of "), "concept_id")
    before = old.select("concept_id").distinct().select("concept_id", named("tag").alias("tag"), named("summary").alias("summary"))
    rows = table(spark, sf_dir, "embeddings")
    entities = rows.select(F.col("vec_id").alias("node_id"), F.concat(F.lit("t"), "label").alias("tag"), F.concat(F.lit("s"), "vec_id").alias("summary"))
    touched = rows.where(TOUCHED_NODES).select(F.col("vec_id").alias("node_id"))
    return concepts.recluster(new, entities, before, old, touched).concepts.select("concept_id", "called", "tag", "summary")


# long jobs of calls, and retrieval for tables of queries


@query(f"WITH {rule('all')}, e AS ({entities_sql('all')}) SELECT node_id, substr(sha1(t), 1, 8) AS tag, substr(t, 1, 280) AS summary, 1 AS calls FROM (SELECT node_id, signature || ' ' || code_hash AS t FROM e)")
def enrichment_resumed(spark, sf_dir):
    """Digests of all entities by a job that finds a third of them in its log; calls: rows that the log has for an entity."""
    rows = code.parse(sources(spark, sf_dir)).select("node_id", "code_hash", "signature")
    log = enrich.ResultLog(spark, f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}")
    prompt = F.concat("signature", F.lit(" "), "code_hash")
    with Tables(spark, "entities") as tables:
        rows = tables.keep(rows)
        log.fill(rows.where(F.col("node_id").endswith(".run")), prompt, chunk=2000)
        log.fill(rows, prompt, chunk=2000)
    counts = log.rows().groupBy("node_id", "code_hash").agg(F.count("*").cast("int").alias("calls"))
    return log.answers().join(counts, ["node_id", "code_hash"]).select("node_id", "tag", "summary", "calls")


QUERY_TAGS = """
asked AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 150 = 0 THEN 'zz' || p_partkey WHEN p_partkey % 100 = 0 THEN 'one ' || p_name || ' more' ELSE ' ' || upper(substr(p_name, 2, p_size % 7 + 1)) END AS tag
  FROM part WHERE p_partkey % 25 = 0)"""


def _tag_queries(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 150 == 0, F.concat(F.lit("zz"), k)).when(k % 100 == 0, F.concat(F.lit("one "), "p_name", F.lit(" more"))).otherwise(F.concat(F.lit(" "), F.upper(F.substring(F.col("p_name"), F.lit(2), F.col("p_size") % 7 + 1))))
    return table(spark, sf_dir, "part").where(k % 25 == 0).select(k.alias("query_id"), tag.alias("tag"))


@query(f"""WITH {QUERY_TAGS}, w AS (SELECT query_id, lower(trim(tag)) AS tag FROM asked)
SELECT query_id, p_partkey AS concept_id FROM w JOIN part ON contains(lower(p_name), tag) OR contains(tag, lower(p_name)) WHERE tag <> ''""")
def query_tag_match(spark, sf_dir):
    """Queries by parts of names, by what holds a name, and without a hit, against the names of all parts."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("tag"))
    return retrieval.match_query_tags(names, _tag_queries(spark, sf_dir))


RECALL = f"""{QUOTIENT},
asked AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 5 = 4 THEN 'none such' ELSE ' TOPIC ' || n_nationkey % 12 END AS tag FROM nation),
c AS (SELECT DISTINCT label AS concept_id, 'topic ' || label AS tag, 'about ' || label AS summary FROM embeddings WHERE label <> 7),
seeds AS (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY concept_id) AS rank FROM asked a JOIN c ON contains(lower(trim(a.tag)), c.tag) OR contains(c.tag, lower(trim(a.tag)))),
near_ones AS (SELECT query_id, rank, neighbour AS concept_id, row_number() OVER (PARTITION BY query_id, rank ORDER BY neighbour) AS sub FROM seeds JOIN q ON concept_id = concept),
listed AS (SELECT query_id, rank, 0 AS sub, concept_id FROM seeds UNION ALL SELECT query_id, rank, sub, concept_id FROM near_ones),
firsts AS (SELECT query_id, concept_id, min(rank * 100000 + sub) AS spot FROM listed SEMI JOIN c USING (concept_id) GROUP BY 1, 2),
bodies AS (SELECT label AS concept_id, string_agg('### node ' || vec_id || ' (src/v' || vec_id || '.py:1-' || label || ')' || chr(10) || 's' || vec_id || chr(10) || '```python' || chr(10) || 'v = ' || vec_id || chr(10) || '```' || chr(10), chr(10) ORDER BY vec_id) AS body FROM embeddings GROUP BY 1),
texts AS (SELECT concept_id, '## ' || tag || chr(10) || summary || chr(10) || chr(10) || body AS text FROM c JOIN bodies USING (concept_id)),
whole AS (SELECT query_id, trim(string_agg(text, chr(10) ORDER BY spot), chr(10) || ' ') AS text FROM firsts JOIN texts USING (concept_id) GROUP BY 1)"""


@query(f"WITH {RECALL} SELECT query_id, coalesce(text, 'No matching code concepts found.') AS text FROM asked LEFT JOIN whole USING (query_id)")
def recall_for_queries(spark, sf_dir):
    """For a table of queries, the digests of the concepts that match, with their neighbours; one label has no concept."""
    rows = table(spark, sf_dir, "embeddings")
    near = graph.quotient_neighbours(_semantic(spark, sf_dir), _members(spark, sf_dir))
    label, k = F.col("label"), F.col("vec_id")
    found = rows.where("label <> 7").select(label.alias("concept_id"), F.concat(F.lit("topic "), label).alias("tag"), F.concat(F.lit("about "), label).alias("summary")).distinct()
    entities = rows.select(k.alias("node_id"), F.concat(F.lit("node "), k).alias("tag"), F.concat(F.lit("s"), k).alias("summary"), F.concat(F.lit("src/v"), k, F.lit(".py")).alias("file"), F.lit(1).alias("span_start"), label.alias("span_end"), F.concat(F.lit("v = "), k).alias("code"))
    n = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(n.alias("query_id"), F.when(n % 5 == 4, "none such").otherwise(F.concat(F.lit(" TOPIC "), n % 12)).alias("tag"))
    return retrieval.recall_by_tags(asked, found, near, _members(spark, sf_dir), entities)


NEAREST = """
asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
scores AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) AS score FROM asked, embeddings),
top AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)"""


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


@query(f"WITH {NEAREST} SELECT query_id, id, rank, score FROM top")
def nearest_for_queries(spark, sf_dir):
    """The five nearest vectors of each vector of a table of queries (those whose id is divisible by 20)."""
    rows = table(spark, sf_dir, "embeddings")
    return similarity.nearest(_asked(rows), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5).select("query_id", "id", "rank", "score")


@query(f"""WITH {NEAREST} SELECT CAST(count(*) AS BIGINT) AS queries, true AS whole, true AS recall_reached FROM asked""")
def nearest_by_index(spark, sf_dir):
    """The same through inverted lists over all vectors: whether every query has its five, and whether nine in ten are the exact ones."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    with Tables(spark, "nearest") as tables:
        exact = similarity.nearest(_asked(rows), vectors, 5).select("query_id", "id")
        found = tables.keep(similarity.InvertedLists.fit(vectors).search(_asked(rows), vectors, 5).select("query_id", "id"))
        both = found.join(exact, ["query_id", "id"], "left_semi").groupBy().agg(F.count("*").alias("hits"))
        n = found.groupBy().agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"))
        return Tables(spark, "recall").keep(n.crossJoin(both).select("queries", (F.col("n") == 5 * F.col("queries")).alias("whole"), (F.col("hits") >= 0.9 * F.col("n")).alias("recall_reached")))


BY_VECTOR = f"""{QUOTIENT},
asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT label AS concept_id, 'topic ' || label AS tag, 'about ' || label AS summary, min_by(CAST(embedding AS DOUBLE[]), vec_id) AS vec FROM embeddings GROUP BY label),
seeds AS (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, vec), 6) DESC, concept_id) AS rank FROM asked, c QUALIFY rank <= 2),
near_ones AS (SELECT query_id, rank, neighbour AS concept_id, row_number() OVER (PARTITION BY query_id, rank ORDER BY neighbour) AS sub FROM seeds JOIN q ON concept_id = concept),
listed AS (SELECT query_id, rank, 0 AS sub, concept_id FROM seeds UNION ALL SELECT query_id, rank, sub, concept_id FROM near_ones),
firsts AS (SELECT query_id, concept_id, min(rank * 100000 + sub) AS spot FROM listed GROUP BY 1, 2),
heads AS (SELECT label AS concept_id, '### n' || min(vec_id) || ' (src/v.md:1-2)' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || '```' || chr(10) AS body FROM embeddings GROUP BY 1),
texts AS (SELECT concept_id, '## ' || tag || chr(10) || summary || chr(10) || chr(10) || body AS text FROM c JOIN heads USING (concept_id))"""


@query(f"WITH {BY_VECTOR} SELECT query_id, trim(string_agg(text, chr(10) ORDER BY spot), chr(10) || ' ') AS text FROM firsts JOIN texts USING (concept_id) GROUP BY 1")
def recall_for_vectors(spark, sf_dir):
    """For a table of query vectors, the digests of the two nearest concepts (a label, with its first vector and member) and their neighbours."""
    rows = table(spark, sf_dir, "embeddings")
    near = graph.quotient_neighbours(_semantic(spark, sf_dir, lazy=True), _members(spark, sf_dir))
    near = Tables(spark, "recall").keep(near)  # pairs of labels, which are read several times
    label = F.col("concept_id")
    found = rows.groupBy(F.col("label").alias("concept_id")).agg(F.min_by("embedding", "vec_id").alias("vec"), F.min("vec_id").alias("node_id"))
    told = found.select("concept_id", F.concat(F.lit("topic "), label).alias("tag"), F.concat(F.lit("about "), label).alias("summary"), "vec")
    entities = found.select("node_id", F.concat(F.lit("n"), "node_id").alias("tag"), F.lit("").alias("summary"), F.lit("src/v.md").alias("file"), F.lit(1).alias("span_start"), F.lit(2).alias("span_end"), F.lit("").alias("code"))
    return retrieval.recall_by_vectors(_asked(rows), told, near, found.select("concept_id", "node_id"), entities, k=2)


__all__ = ["edits", "graph"]
