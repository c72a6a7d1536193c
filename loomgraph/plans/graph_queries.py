"""Entities, relations, graphs, paths and topic packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import packets as P
from loomgraph.operators import questions as B
from loomgraph.operators import relations as R
from loomgraph.plans import common as K
from loomgraph.runtime import materialize
from loomgraph.sources.tables import load

query = K.Catalogue()
QUERIES, SQL = query.queries, query.sql


@query(
    """WITH ends AS (SELECT source AS node, target AS other FROM entity_edges WHERE weight >= 0.3 AND NOT isnan(weight) UNION SELECT target, source FROM entity_edges WHERE weight >= 0.3 AND NOT isnan(weight))
SELECT name AS query, coalesce(string_agg(DISTINCT other, ' ' ORDER BY other), '') AS expanded_query FROM (SELECT DISTINCT name FROM entity_catalog) LEFT JOIN ends ON node = lower(trim(name, ' ')) GROUP BY 1"""
)
def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return R.expand_queries(load(spark, folder, "entity_catalog").select(F.col("name").alias("query")), load(spark, folder, "entity_edges"))


@query(
    f"""WITH {K.E}, ends AS (SELECT edge_id, source AS name FROM e UNION SELECT edge_id, target FROM e)
SELECT k.name, count(*) AS edges FROM (SELECT DISTINCT name FROM entity_catalog) k JOIN ends USING (name) GROUP BY 1"""
)
def relation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with a catalogue name at either end: the disjunction as the union of two equi-joins."""
    e = load(spark, folder, "entity_edges")
    ends = e.select("edge_id", F.col("source").alias("name")).unionByName(e.select("edge_id", F.col("target").alias("name"))).distinct()
    return ends.join(load(spark, folder, "entity_catalog").select("name").distinct(), "name").groupBy("name").agg(F.count("*").alias("edges"))


@query("SELECT DISTINCT chunk_id, document_id, source_id FROM chunks WHERE chunk_id IN (SELECT target_chunk FROM chunk_edges WHERE similarity >= 0.72)")
def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "chunk_edges").where("similarity >= 0.72").select(F.col("target_chunk").alias("chunk_id"))
    return load(spark, folder, "chunks").select("chunk_id", "document_id", "source_id").join(ids, "chunk_id", "left_semi").distinct()


@query(f"WITH {K.E} SELECT edge_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, source, relation, target ORDER BY created_at, edge_id) AS n FROM e) WHERE n = 1")
def relation_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return R.first_relations(K.entity_edges(spark, folder), [F.col("created_at").asc_nulls_last(), F.col("edge_id")]).select("edge_id")


@query(
    f"""WITH {K.E}, k AS (SELECT DISTINCT chunk_id, least(source, target) AS x, greatest(source, target) AS y FROM e WHERE edge_type = 'semantic')
SELECT edge_id FROM e WHERE edge_type = 'semantic' OR (edge_type = 'contextual' AND NOT EXISTS (SELECT 1 FROM k WHERE k.chunk_id = e.chunk_id AND k.x = least(e.source, e.target) AND k.y = greatest(e.source, e.target)))"""
)
def relation_prune(spark: SparkSession, folder: str) -> DataFrame:
    return R.prune_contextual(K.entity_edges(spark, folder)).select("edge_id")


_NAMES = "n AS (SELECT relation AS phrase, relation AS canonical FROM relation_types UNION SELECT unnest(phrases), relation FROM relation_types), k AS (SELECT phrase, min(canonical) AS canonical FROM n GROUP BY 1)"


@query(f"WITH {_NAMES} SELECT relation_id, coalesce(canonical, relation) AS canonical FROM (SELECT DISTINCT * FROM llm_relations) r LEFT JOIN k ON phrase = relation WHERE coalesce(canonical, relation) IS NOT NULL")
def relation_canonical(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "llm_relations").distinct()
    return R.canonical_relations(rows, load(spark, folder, "relation_types")).select("relation_id", "canonical").where("canonical is not null")


@query(f"WITH {_NAMES} SELECT relation_id, coalesce(canonical, 'associated_with') AS canonical FROM (SELECT DISTINCT * FROM llm_relations) r LEFT JOIN k ON phrase = relation")
def ontology_mapping(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "llm_relations").distinct()
    return R.canonical_relations(rows, load(spark, folder, "relation_types"), fallback=R.FALLBACK).select("relation_id", "canonical")


@query(
    f"""WITH {K.C}, {K.E}, n AS (SELECT DISTINCT chunk_id, unnest(list_transform(entities, lambda x: x.normalized_text)) AS name FROM c)
SELECT edge_id FROM e WHERE source <> target AND EXISTS (SELECT 1 FROM n WHERE n.chunk_id = e.chunk_id AND name = source) AND EXISTS (SELECT 1 FROM n WHERE n.chunk_id = e.chunk_id AND name = target)"""
)
def relation_validate(spark: SparkSession, folder: str) -> DataFrame:
    return R.valid_relations(K.entity_edges(spark, folder), load(spark, folder, "chunks")).select("edge_id")


@query("WITH " + K.UNDIRECTED.format(fan=10) + " SELECT node, neighbour, weight, neighbour_rank FROM near")
def entity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return G.top_neighbours(G.undirected(load(spark, folder, "entity_edges"))).select("node", "neighbour", "weight", "neighbour_rank")


def path_sql(hops: int, strong: int, weak: int) -> str:
    sql = "WITH " + K.UNDIRECTED.format(fan="neighbour_rank") + ", h1 AS (SELECT node AS entity, neighbour AS last, weight AS score, semantic AS sem, [node, neighbour] AS nodes FROM near WHERE weight >= 0.2)"
    for h in range(2, hops + 1):
        sql += f", h{h} AS (SELECT entity, neighbour AS last, score * weight AS score, sem AND semantic AS sem, list_append(nodes, neighbour) AS nodes FROM h{h - 1} JOIN near ON node = last WHERE NOT list_contains(nodes, neighbour) AND score * weight >= 0.2)"
    return sql + f""", p AS (SELECT entity, CASE WHEN sem THEN 'strong' ELSE 'weak' END AS quality, round(score, 6) AS path_score, list_aggregate(nodes, 'string_agg', ' > ') AS nodes FROM h{hops})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, quality ORDER BY path_score DESC, nodes) AS path_rank FROM p) WHERE path_rank <= CASE WHEN quality = 'strong' THEN {strong} ELSE {weak} END"""


@query(path_sql(2, 5, 3))
def paths_2hop(spark: SparkSession, folder: str) -> DataFrame:
    return G.paths(G.undirected(load(spark, folder, "entity_edges")), 2, strong=5, weak=3).drop("path")


@query(path_sql(3, 3, 2))
def paths_3hop(spark: SparkSession, folder: str) -> DataFrame:
    return G.paths(G.undirected(load(spark, folder, "entity_edges")), 3, strong=3, weak=2).drop("path")


@query(
    f"""WITH {K.E} SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY created_at DESC NULLS LAST, edge_id DESC) AS n FROM e WHERE source IS NOT NULL AND target IS NOT NULL) WHERE n = 1"""
)
def simple_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.last_edges(K.entity_edges(spark, folder).where("source is not null and target is not null"), [F.col("created_at"), F.col("edge_id")]).select("edge_id")


@query(
    f"""WITH {K.C}, q AS (SELECT DISTINCT chunk_id, e.normalized_text AS equation FROM (SELECT chunk_id, unnest(entities) AS e FROM c) WHERE e.label = 'equation' AND e.normalized_text IS NOT NULL),
b AS (SELECT source AS node, target AS other FROM entity_edges WHERE relation = 'co_occurs' UNION SELECT target, source FROM entity_edges WHERE relation = 'co_occurs')
SELECT 'mentions' AS kind, chunk_id AS source, equation AS target FROM q UNION SELECT 'related', node, other FROM b WHERE other IN (SELECT equation FROM q) AND node IS NOT NULL"""
)
def equation_links(spark: SparkSession, folder: str) -> DataFrame:
    mentions, related = G.equation_links(K.chunks(spark, folder), load(spark, folder, "entity_edges"))
    return mentions.withColumn("kind", F.lit("mentions")).unionByName(related.where("source is not null").withColumn("kind", F.lit("related")))


@query(f"WITH {K.CE}, n AS (SELECT source_chunk AS chunk_id FROM ce UNION ALL SELECT target_chunk FROM ce) SELECT chunk_id, count(*) AS degree FROM n WHERE chunk_id IS NOT NULL GROUP BY 1")
def chunk_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.chunk_graph_nodes(K.chunk_edges(spark, folder))


@query("SELECT coalesce(source_chunk, '') AS source_chunk, coalesce(target_chunk, '') AS target_chunk, coalesce(max(similarity), -1) AS weight, max(coalesce(len(shared_entities), 0)) AS shared_entities FROM chunk_edges GROUP BY chunk_edges.source_chunk, chunk_edges.target_chunk")
def chunk_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = G.chunk_graph_edges(load(spark, folder, "chunk_edges"))
    return e.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("source_chunk", "target_chunk")], F.coalesce("weight", F.lit(-1.0)).alias("weight"), "shared_entities")


@query(
    f"""WITH {K.C}, g AS (SELECT DISTINCT chunk_id AS source, 'mentions' AS relation, unnest(list_transform(entities, lambda x: x.normalized_text)) AS target FROM c)
SELECT relation, count(*) AS edges FROM (SELECT source, relation, target, 0.5::DOUBLE AS weight FROM g WHERE target IS NOT NULL UNION ALL SELECT DISTINCT source, relation, target, weight FROM entity_edges) WHERE relation IS NOT NULL GROUP BY 1"""
)
def entity_graph(spark: SparkSession, folder: str) -> DataFrame:
    g = G.entity_graph_edges(K.chunks(spark, folder), load(spark, folder, "entity_edges"))
    return g.where("relation is not null").groupBy("relation").agg(F.count("*").alias("edges"))


def _packet_paths(hops: int, strong: int, weak: int) -> str:
    """The best paths of each topic's graph, rendered, as CTE r{hops}."""
    sql, at = "", f"w{hops}_"
    for h in range(1, hops + 1):
        if h == 1:
            sql += f", {at}1 AS (SELECT t, node AS entity, neighbour AS last, weight AS score, semantic AS sem, [node, neighbour] AS nodes, '- ' || relation || ' -> ' || neighbour AS chain FROM s WHERE weight >= 0.2)"
        else:
            sql += f", {at}{h} AS (SELECT w.t, entity, neighbour AS last, score * weight AS score, sem AND semantic AS sem, list_append(nodes, neighbour) AS nodes, chain || '- ' || relation || ' -> ' || neighbour AS chain FROM {at}{h - 1} w JOIN s ON s.t = w.t AND node = last WHERE NOT list_contains(nodes, neighbour) AND score * weight >= 0.2)"
    return sql + f""", q{hops} AS (SELECT t, entity, chain, CASE WHEN sem THEN 'strong' ELSE 'weak' END AS quality, round(score, 6) AS path_score, list_aggregate(nodes, 'string_agg', ' > ') AS nodes FROM {at}{hops}),
r{hops} AS (SELECT t, string_agg('[' || quality[1] || '|' || round(path_score::DECIMAL(18, 6), 4)::DECIMAL(18, 4)::VARCHAR || '] ' || entity || chain, chr(10) ORDER BY entity, quality, path_rank) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY t, entity, quality ORDER BY path_score DESC, nodes) AS path_rank FROM q{hops}) WHERE path_rank <= CASE WHEN quality = 'strong' THEN {strong} ELSE {weak} END GROUP BY t)"""


_PACKET = f"""WITH {K.C}, x AS (SELECT DISTINCT document_id AS t, chunk_id, text, e.normalized_text AS name, e.label AS label FROM (SELECT document_id, chunk_id, text, unnest(entities) AS e FROM c WHERE document_id IS NOT NULL)),
nm AS (SELECT DISTINCT t, name FROM x WHERE name IS NOT NULL),
tx AS (SELECT DISTINCT document_id AS t, text FROM c WHERE document_id IS NOT NULL AND text IS NOT NULL),
oe AS (SELECT c.document_id AS t, e.source, e.target, e.relation, e.weight, e.edge_type FROM entity_edges e JOIN c ON c.chunk_id = e.chunk_id WHERE c.document_id IS NOT NULL),
te AS (SELECT * FROM oe WHERE (t, source) IN (SELECT t, name FROM nm) AND (t, target) IN (SELECT t, name FROM nm) AND source <> target AND trim(source, ' ') <> '' AND trim(target, ' ') <> '' AND weight BETWEEN 0 AND 1 AND NOT isnan(weight)),
u AS (SELECT t, a, b, weight, semantic, relation FROM (SELECT t, least(source, target) AS a, greatest(source, target) AS b, weight, coalesce(edge_type = 'semantic', false) AS semantic, coalesce(relation, '') AS relation,
  row_number() OVER (PARTITION BY t, least(source, target), greatest(source, target) ORDER BY weight DESC, edge_type = 'semantic' DESC NULLS LAST, relation DESC NULLS LAST) AS n FROM te) WHERE n = 1),
s AS (SELECT t, a AS node, b AS neighbour, weight, semantic, relation FROM u UNION ALL SELECT t, b, a, weight, semantic, relation FROM u)
{_packet_paths(2, 5, 3)}{_packet_paths(3, 3, 2)},
eq AS (SELECT DISTINCT t, coalesce(text, '') AS source, name AS target FROM x WHERE label = 'equation' AND name IS NOT NULL),
co AS (SELECT DISTINCT t, coalesce(node, '') AS source, other AS target FROM (SELECT t, source AS node, target AS other FROM oe WHERE relation = 'co_occurs' UNION SELECT t, target, source FROM oe WHERE relation = 'co_occurs') WHERE (t, other) IN (SELECT t, target FROM eq)),
topic AS (SELECT DISTINCT document_id AS t FROM c WHERE document_id IS NOT NULL),
lists AS (SELECT t, 'core' AS kind, string_agg(name, ' | ' ORDER BY name) AS text, '[' || string_agg(chr(39) || name || chr(39), ', ' ORDER BY name) || ']' AS quoted FROM nm GROUP BY t
  UNION ALL SELECT t, 'texts', string_agg(text, ' | ' ORDER BY text), '[' || string_agg(chr(39) || text || chr(39), ', ' ORDER BY text) || ']' FROM tx GROUP BY t
  UNION ALL SELECT t, 'retrieved', string_agg('[EQ] ' || target || ' ' || chr(10) || ' INTUITION: ' || source, chr(10) ORDER BY target, source), NULL FROM eq GROUP BY t
  UNION ALL SELECT t, 'related', string_agg('[EQ] ' || target || ' ' || chr(10) || ' INTUITION: ' || source, chr(10) ORDER BY target, source), NULL FROM co GROUP BY t
  UNION ALL SELECT t, '2', text, NULL FROM r2 UNION ALL SELECT t, '3', text, NULL FROM r3),
packet AS (SELECT topic.t AS topic_id, coalesce(max(text) FILTER (kind = 'core'), '') AS core_concepts, coalesce(max(quoted) FILTER (kind = 'core'), '[]') AS core, coalesce(max(text) FILTER (kind = 'texts'), '') AS supporting_chunks,
  coalesce(max(quoted) FILTER (kind = 'texts'), '[]') AS texts, coalesce(max(text) FILTER (kind = '2'), '') AS concept_paths_2_hop, coalesce(max(text) FILTER (kind = '3'), '') AS concept_paths_3_hop,
  coalesce(max(text) FILTER (kind = 'retrieved'), 'None') AS retrieved_equations, coalesce(max(text) FILTER (kind = 'related'), 'None') AS related_equations FROM topic LEFT JOIN lists ON lists.t = topic.t GROUP BY 1)"""


@query(_PACKET + " SELECT topic_id, core_concepts, supporting_chunks, concept_paths_2_hop, concept_paths_3_hop, retrieved_equations, related_equations FROM packet")
def topic_packet(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and concepts joined, paths and equations as in the prompts."""
    return P.packet_texts(K.chunks(spark, folder), load(spark, folder, "entity_edges"))


@query(
    _PACKET
    + """ SELECT topic_id, difficulty, '## Available Entities' || chr(10) || core || chr(10) || chr(10) || '## Supporting Knowledge' || chr(10) || texts || chr(10) || CASE difficulty
  WHEN 'medium' THEN chr(10) || '## Concept Paths (2-Hop)' || chr(10) || concept_paths_2_hop || chr(10) || chr(10) || '## Retrieved Equations' || chr(10) || retrieved_equations || chr(10)
  WHEN 'hard' THEN chr(10) || '## Concept Paths (3-Hop)' || chr(10) || concept_paths_3_hop || chr(10) || chr(10) || '## Related Equations' || chr(10) || related_equations || chr(10) ELSE '' END AS context
FROM packet, (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty)"""
)
def rendered_context(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts' contexts per topic and difficulty, with the paths that start at the topic's concepts."""
    return P.contexts(K.chunks(spark, folder), load(spark, folder, "entity_edges"))


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY t, entity, quality ORDER BY path_score DESC, nodes) AS path_rank FROM {q}) WHERE path_rank <= CASE WHEN quality = 'strong' THEN {strong} ELSE {weak} END"


@query(
    _PACKET
    + f""", asked AS (SELECT t AS topic, 'easy' AS difficulty, name AS nodes, 'What is ' || name || '?' AS question, name AS primary_concept FROM nm
  UNION ALL SELECT t, 'medium', nodes, 'How does ' || entity || ' relate to ' || last || '?', entity FROM (SELECT *, string_split(nodes, ' > ')[-1] AS last FROM {_RANKED.format(q="q2", strong=5, weak=3)})
  UNION ALL SELECT t, 'hard', nodes, 'How does ' || entity || ' relate to ' || last || '?', entity FROM (SELECT *, string_split(nodes, ' > ')[-1] AS last FROM {_RANKED.format(q="q3", strong=3, weak=2)}))
SELECT topic, difficulty, sha256(concat_ws(chr(1), topic, difficulty, nodes)) AS question_id, question, primary_concept FROM asked"""
)
def question_bank(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of every topic and difficulty: its concepts, its best paths of two edges, and of three."""
    c = materialize(G.topic_chunks(K.chunks(spark, folder), "entities"))
    easy = G.topic_names(c).select(F.col("topic_id").alias("topic"), "name")
    out = easy.select("topic", F.lit("easy").alias("difficulty"), F.sha2(F.concat_ws("\x01", "topic", F.lit("easy"), "name"), 256).alias("question_id"), F.concat(F.lit("What is "), "name", F.lit("?")).alias("question"), F.col("name").alias("primary_concept"))
    found = G.topic_paths(materialize(G.undirected(G.topic_graph(c, load(spark, folder, "entity_edges")), ("topic_id",))))
    for difficulty, hops in (("medium", "2_hop"), ("hard", "3_hop")):
        out = out.unionByName(B.template_questions(found[hops].select(F.col("topic_id").alias("topic"), "nodes"), F.col("topic"), difficulty))
    return out


_LETTER = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_OTHER = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
_IN_SENTENCE = rf"""WITH {K.C}, parts AS (SELECT chunk_id, entities, list_filter(list_transform(string_split(regexp_replace(text, '\s*\n\s*|([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS p FROM c WHERE text IS NOT NULL),
sents AS (SELECT chunk_id, entities, unnest(p) AS sentence, unnest(range(len(p))) AS sent_no FROM parts),
ents AS (SELECT chunk_id, sent_no, sentence, regexp_replace(lower(sentence), '\[\d+\]', '', 'g') AS s, unnest(entities) AS e, unnest(range(len(entities))) AS pos FROM sents),
se AS (SELECT chunk_id, sent_no, sentence, pos, e.text AS text, e.normalized_text AS name FROM ents WHERE contains(s, e.text) AND e.normalized_text IS NOT NULL AND regexp_matches(s,
  CASE WHEN regexp_matches(e.text[1], '{_LETTER}') THEN '(?:^|{_OTHER})' ELSE '{_LETTER}' END || regexp_escape(e.text) || CASE WHEN regexp_matches(e.text[-1], '{_LETTER}') THEN '(?:$|{_OTHER})' ELSE '{_LETTER}' END))"""


@query(
    _IN_SENTENCE
    + """ SELECT chunk_id, sent_no, source, 'co_occurs' AS relation, target, explanation, 'contextual' AS edge_type, 0.2::DOUBLE AS weight FROM (
  SELECT a.chunk_id, a.sent_no, a.name AS source, b.name AS target, trim(a.sentence, ' ') AS explanation,
    row_number() OVER (PARTITION BY a.chunk_id, a.sent_no, least(a.name, b.name), greatest(a.name, b.name) ORDER BY a.pos, b.pos) AS n
  FROM se a JOIN se b ON a.chunk_id = b.chunk_id AND a.sent_no = b.sent_no AND a.pos < b.pos AND a.name <> b.name) WHERE n = 1"""
)
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return R.co_occurrences(K.chunks(spark, folder).select("chunk_id", "text", "entities"))


@query(
    rf"""WITH {K.C}, forms AS (SELECT text, name, label, array_to_string({K.TOK.format("text")}, ' ') AS gram FROM (
    SELECT name AS text, name, label FROM entity_catalog UNION SELECT unnest(aliases), name, label FROM entity_catalog) WHERE lower(text) NOT IN ({", ".join(f"'{x}'" for x in T.STOP_ENTITIES)})),
  form AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY name, text, label) AS n FROM forms) WHERE n = 1),
  sizes AS (SELECT DISTINCT len(string_split(gram, ' ')) AS k FROM form),
  w AS (SELECT chunk_id, {K.TOK.format("text")} AS w FROM c WHERE text IS NOT NULL),
  starts AS (SELECT chunk_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, sizes WHERE len(w) >= k),
  named AS (SELECT DISTINCT chunk_id, lower(text) AS text, name AS normalized_text, label FROM (SELECT DISTINCT chunk_id, array_to_string(w[i:i + k - 1], ' ') AS gram FROM starts) JOIN form USING (gram)),
  eqs AS (SELECT chunk_id, unnest(list_filter(regexp_extract_all(text, '(?s)\$\$(.*?)\$\$', 1), lambda e: len(e) > 0)) AS e FROM c WHERE text IS NOT NULL),
  own AS (SELECT DISTINCT chunk_id, regexp_replace(e, '^\s+|\s+$', '', 'g') AS text, 'equation' AS label FROM eqs
    UNION SELECT chunk_id, v, 'variable' FROM (SELECT chunk_id, unnest(regexp_extract_all(e, '\\?[a-zA-Z]+(?:_[a-zA-Z0-9]+)?')) AS v FROM eqs) WHERE length(v) <= 20)
SELECT chunk_id, text, label, min(normalized_text) AS normalized_text, 1.0::DOUBLE AS score FROM (SELECT chunk_id, text, normalized_text, label FROM named UNION ALL SELECT chunk_id, text, text, label FROM own) GROUP BY chunk_id, text, label"""
)
def entity_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return R.extract_entities(K.chunks(spark, folder).select("chunk_id", "text"), load(spark, folder, "entity_catalog"))


@query(
    _IN_SENTENCE
    + """, ph AS (SELECT lower(phrase) AS phrase, min(relation) AS relation FROM (SELECT replace(relation, '_', ' ') AS phrase, relation FROM relation_types UNION SELECT unnest(phrases), relation FROM relation_types) GROUP BY 1),
pairs AS (SELECT a.chunk_id, a.sent_no, a.pos, a.sentence, a.name AS source, b.name AS target, b.text AS text2, substr(lower(a.sentence), instr(lower(a.sentence), a.text) + length(a.text)) AS rest
  FROM se a JOIN se b ON a.chunk_id = b.chunk_id AND a.sent_no = b.sent_no AND a.name <> b.name)
SELECT chunk_id, source, relation, target, explanation, 'semantic' AS edge_type, 0.9::DOUBLE AS weight FROM (
  SELECT chunk_id, source, relation, target, trim(sentence, ' ') AS explanation, row_number() OVER (PARTITION BY chunk_id ORDER BY sent_no, pos, target, text2, relation) AS n
  FROM pairs JOIN ph ON ph.phrase = trim(split_part(rest, text2, 1), ' ') WHERE contains(rest, text2)) WHERE n <= 15"""
)
def relation_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return R.pattern_relations(K.chunks(spark, folder).select("chunk_id", "text", "entities"), load(spark, folder, "relation_types"))
