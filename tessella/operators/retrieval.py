"""Concept lookup by tag or vector, neighbourhood expansion, and the digest text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, fence, trim_all
from ..sources.shared import Tables
from .similarity import InvertedLists, nearest


def index_text(concepts: DataFrame) -> DataFrame:
    """One text: "tag-or-id: summary" of every concept that has either, by id.  It is one row by nature."""
    named = concepts.where("length(tag) > 0 OR length(summary) > 0")
    line = F.concat(F.when(F.length("tag") > 0, F.col("tag")).otherwise(F.col("concept_id").cast("string")), F.lit(": "), F.coalesce("summary", F.lit("")))
    return named.withColumn("line", line).agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY concept_id)").alias("text"))


def match_tags(concepts: DataFrame, queries: list[str], *, empty_matches: bool = False) -> DataFrame:
    """Concepts whose tag equals, holds or is held in one of the queried tags, in any case.

    The queries are literals of the plan, so the concepts are filtered in place, not joined.
    """
    tag = F.lower(F.coalesce("tag", F.lit("")))
    hit = F.lit(False)
    for q in queries:
        low = F.lit(q.lower())
        hit = hit | tag.contains(low) | low.contains(tag)
    return concepts.where(hit if empty_matches else hit & (F.length(tag) > 0))


def nearest_concepts(concepts: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k concepts (concept_id, vec) nearest to a query vector, with their rank."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = concepts.where("vec IS NOT NULL").select("concept_id", F.round(cosine(F.col("vec"), q), 6).alias("score")).orderBy(F.desc("score"), "concept_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "concept_id")))


def expand(seeds: DataFrame, neighbours: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, place): seeds (concept_id, rank), each followed by its neighbours (concept, neighbour), first occurrences only, known concepts only."""
    near = seeds.join(neighbours, seeds["concept_id"] == neighbours["concept"]).select("rank", F.col("neighbour").alias("concept_id"))
    after = F.row_number().over(Window.partitionBy("rank").orderBy("concept_id"))
    listed = seeds.select("rank", F.lit(0).alias("sub"), "concept_id").unionByName(near.select("rank", after.alias("sub"), "concept_id"))
    first = listed.groupBy("concept_id").agg(F.min(F.struct("rank", "sub")).alias("at")).join(concepts.select("concept_id"), "concept_id", "left_semi")
    return first.select("concept_id", F.row_number().over(Window.orderBy("at")).alias("place"))


def digest(placed: DataFrame, concepts: DataFrame, members: DataFrame, entities: DataFrame, *, most_members: int = 40) -> DataFrame:
    """(concept_id, place, text): each concept's heading, then its first members with their code in fences."""
    ranked = members.select("concept_id", "node_id", F.row_number().over(Window.partitionBy("concept_id").orderBy("node_id")).alias("m")).where(F.col("m") <= most_members)
    rows = placed.join(concepts, "concept_id").join(ranked, "concept_id").join(entities, "node_id")
    line = F.concat(F.lit("### "), "node_id", F.lit("\n```"), fence(F.col("file")), F.lit("\n"), "code", F.lit("\n```"))
    text = rows.withColumn("line", line).groupBy("concept_id", "place", "tag", "summary").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY m)").alias("body"))
    return text.select("concept_id", "place", F.concat(F.lit("## "), "tag", F.lit("\n"), "summary", F.lit("\n"), "body").alias("text"))


# for tables of queries

#: Substrings of up to so many characters are what needles and texts are joined by.
_GRAM = 3

NO_HIT = "No matching code concepts found."  # fixed value


def _grams(text: Column, sizes: Column) -> Column:
    """The distinct substrings of a text of the given sizes, none of which is more than its length."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) for every text that holds a needle, both distinct and not empty.

    A text is listed under its substrings of up to three characters.  A needle looks under one
    of its own, the one with the fewest texts, and what it finds there is compared in full.
    """
    sizes = F.filter(F.array(*[F.lit(n) for n in range(1, _GRAM + 1)]), lambda n: n <= F.length("text"))
    listed = texts.where("text <> ''").select("text", F.explode(_grams(F.col("text"), sizes)).alias("gram"))
    common = listed.groupBy("gram").agg(F.count("*").alias("n"))
    own = needles.where("needle <> ''").select("needle", F.explode(_grams(F.col("needle"), F.array(F.least(F.length("needle"), F.lit(_GRAM))))).alias("gram"))
    least = own.join(common, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return least.join(listed, "gram").where(F.contains("text", "needle")).select("needle", "text")


#: Concepts and queries that meet in one key of the last join, at most about.
_CONCEPTS, _QUERIES = 2048, 4096
#: Rows of the result for each task, about.
_MATCHES = 1 << 22


def match_query_tags(concepts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, concept_id): for each query (query_id, tag; it may have several) the concepts whose tag equals, holds or is held in one, in any case.

    Blank tags match nothing, on either side.  Concepts of the same tags are matched as one, so only
    the last join makes rows for each query and concept, and nothing sorts or shuffles these.
    """
    wanted = queries.select("query_id", F.lower(F.trim("tag")).alias("wanted")).where("wanted <> ''")
    tagged = concepts.select("concept_id", F.lower("tag").alias("own")).where("own <> ''")
    asked, there = wanted.select("wanted").distinct(), tagged.select("own").distinct()
    holds = contained(asked.withColumnRenamed("wanted", "needle"), there.withColumnRenamed("own", "text")).select(F.col("needle").alias("wanted"), F.col("text").alias("own"))
    held = contained(there.withColumnRenamed("own", "needle"), asked.withColumnRenamed("wanted", "text")).select(F.col("text").alias("wanted"), F.col("needle").alias("own"))
    pairs = holds.unionAll(held).distinct()
    tables = Tables(concepts.sparkSession, "tag-matches")
    kinds = tables.keep(tagged.groupBy("concept_id").agg(F.array_sort(F.collect_set("own")).alias("tags")))
    found = kinds.select("tags").distinct().select("tags", F.explode("tags").alias("own")).join(pairs, "own").join(wanted, "wanted")
    found = tables.keep(found.select("tags", "query_id").distinct())
    return _every_pair(kinds, found)


def _every_pair(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, concept_id) of concepts (concept_id, tags) and queries (query_id, tags) by tags; tags with many of either are dealt to many keys."""
    size = kinds.groupBy("tags").agg(F.count("*").alias("n")).join(found.groupBy("tags").agg(F.count("*").alias("m")), "tags")
    rows = size.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()[0]
    size = size.select("tags", F.ceil(F.col("n") / _CONCEPTS).cast("int").alias("parts"), F.ceil(F.col("m") / _QUERIES).cast("int").alias("groups"))
    deal = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = kinds.join(size, "tags").select("tags", "concept_id", deal("concept_id", "parts").alias("part"), each("groups").alias("group"))
    right = found.join(size, "tags").select("tags", "query_id", deal("query_id", "groups").alias("group"), each("parts").alias("part"))
    by, tasks = ["tags", "part", "group"], int(min(max(rows // _MATCHES, 8), 20000))  # by number: Spark would join keys by the bytes that come in
    lists = right.repartition(tasks, *by).groupBy(*by).agg(F.collect_list(F.struct("query_id")).alias("queries"))  # structs: a null id stays
    return left.repartition(tasks, *by).join(lists, by).select(F.explode("queries").alias("q"), "concept_id").select("q.query_id", "concept_id")


def expand_each(seeds: DataFrame, neighbours: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, concept_id, place): expand() for the seeds (query_id, concept_id, rank) of many queries."""
    near = seeds.join(neighbours, seeds["concept_id"] == neighbours["concept"]).select("query_id", "rank", F.col("neighbour").alias("concept_id"))
    after = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("concept_id"))
    listed = seeds.select("query_id", "rank", F.lit(0).alias("sub"), "concept_id").unionByName(near.select("query_id", "rank", after.alias("sub"), "concept_id"))
    first = listed.groupBy("query_id", "concept_id").agg(F.min(F.struct("rank", "sub")).alias("at")).join(concepts.select("concept_id"), "concept_id", "left_semi")
    return first.select("query_id", "concept_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"))


def digest_texts(concepts: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """(concept_id, text): a concept's heading, then its members (with tag, summary, file, span_start, span_end, code) by id."""
    either = lambda a, b: F.when(F.length(a) > 0, F.col(a)).otherwise(F.col(b).cast("string"))
    place = F.concat(F.lit(" ("), "file", F.lit(":"), "span_start", F.lit("-"), "span_end", F.lit(")\n"))
    body = F.concat(F.lit("### "), either("tag", "node_id"), place, F.coalesce("summary", F.lit("")), F.lit("\n```"), fence(F.col("file")), F.lit("\n"), F.coalesce("code", F.lit("")), F.lit("\n```\n"))
    lines = members.join(entities.select("node_id", body.alias("line")), "node_id").groupBy("concept_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY node_id)").alias("body"))
    head = F.concat(F.lit("## "), either("tag", "concept_id"), F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
    return concepts.join(lines, "concept_id", "left").select("concept_id", F.concat_ws("\n", head, "body").alias("text"))


def recall_by_tags(queries: DataFrame, concepts: DataFrame, neighbours: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, text): for each query the digests of the concepts that its tags match and of their neighbours, or a fixed text."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("concept_id"))
    seeds = match_query_tags(concepts, queries).withColumn("rank", rank)
    return _assembled(queries, expand_each(seeds, neighbours, concepts), concepts, members, entities)


EMPTY = "Concept index is empty."  # fixed value


def recall_by_vectors(queries: DataFrame, concepts: DataFrame, neighbours: DataFrame, members: DataFrame, entities: DataFrame, *, k: int = 5, index: InvertedLists | None = None) -> DataFrame:
    """(query_id, text): for each query (query_id, vec) the digests of the k nearest concepts (with their vec) and their neighbours.

    Exact, or through an index of the concepts' vectors; where no concept has a vector the text is fixed.
    """
    vectors = concepts.select(F.col("concept_id").alias("id"), "vec")
    found = nearest(queries, vectors, k) if index is None else index.search(queries, vectors, k)
    seeds = found.select("query_id", F.col("id").alias("concept_id"), "rank")
    return _assembled(queries, expand_each(seeds, neighbours, concepts), concepts, members, entities, EMPTY)


def _lists(placed: DataFrame) -> DataFrame:
    """(query_id, list): the concepts of each query in their order, as a list of (place, concept_id)."""
    return placed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "concept_id"))).alias("list"))


def _entries(lists: DataFrame) -> DataFrame:
    """(list, place, concept_id): the entries of each distinct list, however many queries have it."""
    return lists.select("list").distinct().select("list", F.explode("list").alias("at")).select("list", "at.place", "at.concept_id")


def _assembled(queries: DataFrame, placed: DataFrame, concepts: DataFrame, members: DataFrame, entities: DataFrame, missing: str = NO_HIT) -> DataFrame:
    """(query_id, text); the text of a list of concepts is put together once and then joined to all queries that have the list."""
    wanted = concepts.join(placed.select("concept_id").distinct(), "concept_id", "left_semi")
    lists = _lists(placed)
    texts = _entries(lists).join(digest_texts(wanted, members, entities), "concept_id")
    found = texts.groupBy("list").agg(trim_all(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY place)")).alias("text"))
    rows = queries.select("query_id").distinct().join(lists, "query_id", "left").join(found, "list", "left")
    return rows.select("query_id", F.coalesce("text", F.lit(missing)).alias("text"))
