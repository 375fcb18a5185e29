"""Entities and relations of topics as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTITY = "struct<name:string,type:string,properties:map<string,string>>"
RELATION = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,confidence:double>"
TRIPLE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>"


def kg_candidates(content: DataFrame, processed: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest processed contents of each topic."""
    p = processed.filter("status = 'completed' AND clean_content != ''").select(F.col("unified_id").alias("id"), "clean_content")
    best = W.partitionBy("topic_id").orderBy(F.desc("topic_similarity"), "id")
    return content.filter("topic_id IS NOT NULL").join(p, "id").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n)


def kg_pending(candidates: DataFrame, extractions: DataFrame) -> DataFrame:
    """Candidates without a completed or empty extraction; failed ones are tried again."""
    done = extractions.filter(F.col("status").isin("completed", "empty")).select("topic_id", F.col("unified_id").alias("id"))
    return candidates.join(done, ["topic_id", "id"], "left_anti")


def kg_text(df: DataFrame, chars: int = 500) -> DataFrame:
    head = F.concat(F.lit("["), F.col("platform"), F.lit("] ["), F.coalesce("sentiment", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return df.withColumn("kg_text", F.concat(head, F.substring(F.coalesce("content", F.lit("")), 1, chars)))


def triples_to_graph(df: DataFrame, col: str, confidence: float = 0.9) -> DataFrame:
    """``df`` with entities and relations of a JSON list of triples (or an object that holds one).

    Triples without head, tail or relation go; an end with a type is an entity, each once."""
    wrapped = F.from_json(F.col(col), f"triples array<{TRIPLE}>")
    t = F.coalesce(F.from_json(F.when(F.ltrim(F.col(col)).startswith("["), F.col(col)), f"array<{TRIPLE}>"), wrapped["triples"], F.array().cast(f"array<{TRIPLE}>"))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    t = F.filter(t, lambda x: filled(x["head"]) & filled(x["tail"]) & filled(x["relation"]))
    ends = F.flatten(F.transform(F.col("_t"), lambda x: F.array(F.struct(F.trim(x["head"]).alias("name"), F.trim(x["head_type"]).alias("type")), F.struct(F.trim(x["tail"]).alias("name"), F.trim(x["tail_type"]).alias("type")))))
    entities = F.transform(F.array_distinct(F.filter(ends, lambda e: filled(e["type"]))), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), F.create_map().cast("map<string,string>").alias("properties")))
    relations = F.transform(F.col("_t"), lambda x: F.struct(F.trim(x["head"]).alias("head"), x["head_type"].alias("head_type"), F.trim(x["relation"]).alias("relation"), F.trim(x["tail"]).alias("tail"), x["tail_type"].alias("tail_type"), F.lit(confidence).alias("confidence")))
    return df.withColumn("_t", t).withColumns({"entities": entities, "relations": relations}).drop("_t")


def extraction_status(df: DataFrame) -> DataFrame:
    """status (failed without a reply, empty without entities, completed) and counts."""
    n = F.coalesce(F.size("entities"), F.lit(0))
    return df.withColumns({"status": F.when(F.col("entities").isNull(), "failed").when(n == 0, "empty").otherwise("completed"), "entity_count": n, "relation_count": F.coalesce(F.size("relations"), F.lit(0))})


def _exploded(extractions: DataFrame, col: str, to: str) -> DataFrame:
    x = extractions.filter("status = 'completed'").select("topic_id", "unified_id", F.posexplode(col).alias("i", to))
    return x.withColumn("ord", F.struct("unified_id", "i"))


def merge_entities(extractions: DataFrame) -> DataFrame:
    """(topic_id, name, type, mentions, properties) merged on folded name and type: first spelling; of a
    property that is given twice the last value."""
    e = _exploded(extractions, "entities", "e").withColumns({"key": F.lower(F.trim("e.name")), "type": F.col("e.type")}).filter("key != ''")
    base = e.groupBy("topic_id", "key", "type").agg(F.min_by(F.trim("e.name"), "ord").alias("name"), F.count(F.lit(1)).alias("mentions"))
    p = e.filter(F.size("e.properties") > 0).select("topic_id", "key", "type", "ord", F.explode("e.properties").alias("k", "v"))
    p = p.groupBy("topic_id", "key", "type", "k").agg(F.max_by("v", "ord").alias("v"))
    p = p.groupBy("topic_id", "key", "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    out = base.join(p.hint("merge"), ["topic_id", "key", "type"], "left")
    return out.select("topic_id", "name", "type", "mentions", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def merge_relations(extractions: DataFrame) -> DataFrame:
    """(topic_id, head, relation, tail, confidence, sources) merged on folded ends and relation."""
    r = _exploded(extractions, "relations", "r")
    keys = {"h": F.lower(F.trim("r.head")), "t": F.lower(F.trim("r.tail")), "relation": F.col("r.relation")}
    g = r.withColumns(keys).groupBy("topic_id", "h", "t", "relation")
    return g.agg(
        F.min_by(F.trim("r.head"), "ord").alias("head"),
        F.min_by(F.trim("r.tail"), "ord").alias("tail"),
        F.round(F.avg(F.coalesce("r.confidence", F.lit(0.8))), 3).alias("confidence"),
        F.count(F.lit(1)).alias("sources"),
    ).select("topic_id", "head", "relation", "tail", "confidence", "sources")


def graph_tables(entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """nodes (name, type, mentions), belongs (name, type, topic_id) and edges; an edge needs both its ends
    as entities of its topic, and stands once."""
    nodes = entities.groupBy("name", "type").agg(F.sum("mentions").alias("mentions"))
    belongs = entities.select("name", "type", "topic_id").distinct()
    names = belongs.select("topic_id", "name").distinct()
    edges = relations.join(names.withColumnRenamed("name", "head").hint("merge"), ["topic_id", "head"], "left_semi").join(names.withColumnRenamed("name", "tail").hint("merge"), ["topic_id", "tail"], "left_semi")
    return {"nodes": nodes, "belongs": belongs, "edges": edges.dropDuplicates(["topic_id", "head", "relation", "tail"])}


def drop_topic_graph(graph: dict[str, DataFrame], topic: int) -> dict[str, DataFrame]:
    """The graph without a topic's links; nodes that no topic is left for go."""
    belongs = graph["belongs"].filter(F.col("topic_id") != topic)
    nodes = graph["nodes"].join(belongs.select("name", "type").hint("merge"), ["name", "type"], "left_semi")
    return {"nodes": nodes, "belongs": belongs, "edges": graph["edges"].filter(F.col("topic_id") != topic)}


def topic_graph_report(graph: dict[str, DataFrame], topic: int, n: int = 10) -> dict[str, DataFrame]:
    """Entity types with five examples, relation types, top entities and top relations of a topic."""
    own = graph["belongs"].filter(F.col("topic_id") == topic)
    e = graph["nodes"].join(own.select("name", "type").hint("merge"), ["name", "type"], "left_semi")
    r = graph["edges"].filter(F.col("topic_id") == topic)
    ranked = e.withColumn("r", F.row_number().over(W.partitionBy("type").orderBy(F.desc("mentions"), "name")))
    types = ranked.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "name")))), lambda x: x["name"]), ",").alias("examples"))
    return {
        "entity_types": types.orderBy(F.desc("n"), "type"),
        "relation_types": r.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation"),
        "entities": e.orderBy(F.desc("mentions"), "name", "type").limit(n),
        "relations": r.orderBy(F.desc("sources"), F.desc("confidence"), "head", "relation", "tail").limit(n),
    }


def kg_stats(extractions: DataFrame) -> DataFrame:
    """topics, extractions and counts by status, entities and relations."""
    return extractions.agg(
        F.count_distinct("topic_id").alias("topics"),
        F.count(F.lit(1)).alias("extractions"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "empty", "failed")],
        F.sum("entity_count").alias("entities"),
        F.sum("relation_count").alias("relations"),
    )


def latest_build(log: DataFrame) -> DataFrame:
    """The last build of each topic."""
    last = W.partitionBy("topic_id").orderBy(F.desc("built_at"))
    return log.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def check_schema(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """``relations`` (with head_type and tail_type) and ``valid``: whether a rule (relation, head_types,
    tail_types) allows the types; relations without a rule are valid."""
    r = rules.select("relation", "head_types", "tail_types")
    j = relations.join(r, "relation", "left")
    ok = F.array_contains("head_types", F.col("head_type")) & F.array_contains("tail_types", F.col("tail_type"))
    return j.withColumn("valid", F.col("head_types").isNull() | F.coalesce(ok, F.lit(False))).drop("head_types", "tail_types")
