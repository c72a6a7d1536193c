"""Ingest, integrity, question bank, topics and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import hashing as H
from loomgraph.functions import text as T
from loomgraph.operators import audio, chunking, knowledge
from loomgraph.operators import questions as B
from loomgraph.operators import state as M
from loomgraph.operators import topics as W
from loomgraph.operators import validation as V
from loomgraph.plans import common as K
from loomgraph.plans.graph_queries import path_sql
from loomgraph.sources.schemas import RELATION_NAMES
from loomgraph.sources.tables import apply_synonyms, load

query = K.Catalogue()
QUERIES, SQL = query.queries, query.sql

# text


def _normal(c: str) -> str:
    t = f"regexp_replace({c}, '{K.SPACE}', ' ', 'g')"
    t = f"CASE WHEN instr({t}, '{T.PAGE_START}') > 0 THEN substr({t}, instr({t}, '{T.PAGE_START}') + {len(T.PAGE_START)}) ELSE {t} END"
    for m in T.PAGE_ENDS:
        t = f"split_part({t}, '{m}', 1)"
    return f"trim({t}, ' ')"


@query(f"WITH {K.D} SELECT doc_id, {_normal('text')} AS text FROM d WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return K.documents(spark, folder).where("text is not null").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(
    f"""WITH {K.D} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<(script|style|sup)\\b[^>]*>.*?</(script|style|sup)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \\t-\\r]+', ' ', 'g'), ' ') AS text FROM d WHERE text IS NOT NULL"""
)
def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    return K.documents(spark, folder).where("text is not null").select("doc_id", T.html_strip(F.col("text")).alias("text"))


@query()
def html_clean(spark: SparkSession, folder: str) -> DataFrame:
    page = F.concat(F.lit("<html><body><div class='toc'>contents</div><p>"), "text", F.lit("</p></body></html>"))
    return K.documents(spark, folder).where("text is not null").select("doc_id", T.html_clean(page).alias("text"))


@query()
def displaystyle(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunks(spark, folder).where("text is not null").select("chunk_id", T.replace_displaystyle(F.col("text")).alias("text"))


@query(
    f"""WITH {K.C}, q AS (SELECT chunk_id, list_transform(list_filter(regexp_extract_all(text, '(?s)\\$\\$(.*?)\\$\\$', 1), lambda e: len(e) > 0), lambda e: regexp_replace(e, '^\\s+|\\s+$', '', 'g')) AS e FROM c WHERE text IS NOT NULL)
SELECT chunk_id, list_aggregate(e, 'string_agg', ' | ') AS equations FROM q WHERE len(e) > 0"""
)
def equations(spark: SparkSession, folder: str) -> DataFrame:
    q = K.chunks(spark, folder).select("chunk_id", T.equations(F.col("text")).alias("e"))
    return q.where("size(e) > 0").select("chunk_id", F.array_join("e", " | ").alias("equations"))


@query(
    f"""WITH {K.C}, q AS (SELECT chunk_id, unnest(list_filter(regexp_extract_all(text, '(?s)\\$\\$(.*?)\\$\\$', 1), lambda e: len(e) > 0)) AS e FROM c WHERE text IS NOT NULL),
v AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(e, '\\\\?[a-zA-Z]+(?:_[a-zA-Z0-9]+)?')) AS variable FROM q)
SELECT chunk_id, string_agg(variable, ' ' ORDER BY variable) AS variables FROM v WHERE length(variable) <= 20 GROUP BY 1"""
)
def variables(spark: SparkSession, folder: str) -> DataFrame:
    q = K.chunks(spark, folder).select("chunk_id", T.variables(T.equations(F.col("text"))).alias("v"))
    return q.where("size(v) > 0").select("chunk_id", F.array_join("v", " ").alias("variables"))


@query(
    f"""SELECT DISTINCT relation_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(source), '^{K.SPACE}|{K.SPACE}$', '', 'g'), '\\[\\d+\\]', '', 'g'), '["''`]', '', 'g'), '{K.SPACE}', ' ', 'g') AS entity FROM llm_relations WHERE source IS NOT NULL"""
)
def normalize_entities(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "llm_relations").where("source is not null")
    return r.select("relation_id", T.normalize_entity(F.col("source")).alias("entity")).distinct()


@query()
def semantic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.semantic_chunks(K.documents(spark, folder), "doc_id", "text")


@query()
def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.embed(K.documents(spark, folder), "doc_id", "text")


# the offline build


def _built(spark: SparkSession, folder: str) -> knowledge.Knowledge:
    """Documents as pages: their text in a page's body. Repeated ones go in the build."""
    d = load(spark, folder, "documents")
    text = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    html = F.concat(F.lit("<html><body><div class='toc'>contents</div><p>"), text, F.lit("</p></body></html>"))
    pages = d.select(F.col("doc_id").alias("page_id"), "topic_id", F.col("source").alias("source_id"), html.alias("html"))
    return knowledge.build(pages, load(spark, folder, "entity_catalog"), load(spark, folder, "relation_types"))


@query()
def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder).chunks.select("chunk_id", "document_id", "source_id", "text", F.size("entities").alias("entities"))


@query()
def ingest_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder).relations


@query()
def ingest_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder).chunk_edges


@query(f"WITH {K.D} SELECT doc_id::VARCHAR AS item, 'page' AS stage, 'no readable text' AS reason FROM d WHERE text IS NULL OR {_normal('text')} = ''")
def ingest_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder).rejected


@query(
    f"""WITH {K.C}, s AS (SELECT DISTINCT a AS synonym, name FROM (SELECT unnest(aliases) AS a, name FROM entity_catalog)), x AS (SELECT chunk_id, unnest(list_transform(entities, lambda e: e.normalized_text)) AS name FROM c)
SELECT chunk_id, coalesce(s.name, x.name) AS entity, count(*) AS n FROM x LEFT JOIN s ON s.synonym = x.name WHERE x.name IS NOT NULL GROUP BY 1, 2"""
)
def synonym_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases become their catalogue names, through the plural list (empty here) and the synonym list."""
    s = load(spark, folder, "entity_catalog").select(F.explode("aliases").alias("synonym"), F.col("name").alias("canonical")).distinct()
    x = K.chunks(spark, folder).select("chunk_id", F.explode("entities.normalized_text").alias("name")).where("name is not null")
    return apply_synonyms(F.col("name"), x, s.where("false"), s, into="entity").groupBy("chunk_id", "entity").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {K.C}, p AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\[\d+\]', '', 'g'), '\s*\n\s*|([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 10) AS s FROM c WHERE text IS NOT NULL)
SELECT chunk_id, len(s) AS sentences, coalesce(s[1], '') AS first, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM p"""
)
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of more than 10 characters, citations left out."""
    s = K.chunks(spark, folder).where("text is not null").select("chunk_id", T.split_sentences(T.strip_citations(F.col("text"))).alias("s"))
    return s.select("chunk_id", F.size("s").alias("sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query("SELECT DISTINCT id, concat_ws(', ', CASE WHEN len(tags) BETWEEN 2 AND 6 THEN NULL ELSE 'tags of 2 to 6' END) AS broken FROM topics")
def array_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return V.judge(load(spark, folder, "topics").distinct(), [V.sized("tags", 2, 6)]).select("id", F.array_join("broken", ", ").alias("broken"))


# integrity


@query(
    f"""WITH {K.C}, j AS (SELECT document_id, source_id, chunk_id, '{{"chunk_id":' || to_json(chunk_id)::VARCHAR || ',"document_id":' || coalesce(to_json(document_id)::VARCHAR, 'null') || ',"source_id":' || coalesce(to_json(source_id)::VARCHAR, 'null') || '}}' AS o FROM c)
SELECT document_id, source_id, sha256('[' || string_agg(o, ',' ORDER BY chunk_id) || ']') AS source_hash FROM j WHERE document_id IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2"""
)
def membership_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of which chunks a source has, whatever their content."""
    c = K.chunks(spark, folder).where("document_id is not null and source_id is not null")
    o = H.json_object({k: H.json_string(F.col(k)) for k in ("chunk_id", "document_id", "source_id")})
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", o.alias("o")))), lambda x: x.o)
    return c.groupBy("document_id", "source_id").agg(F.sha2(H.json_array(listed), 256).alias("source_hash"))


def _canonical(c: str) -> str:
    """A prompt with LF line ends, without white space at line ends and without empty lines in a row, trimmed."""
    t = rf"regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '(?m)[ \t\f\v]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\v]+|[\s\v]+$', '', 'g')"


_J = lambda c: f"coalesce(to_json({c})::VARCHAR, 'null')"
_SOURCE = f"""WITH {K.C}, ej AS (SELECT chunk_id, '[' || list_aggregate(list_transform(entities, lambda e: '{{"label":' || {_J("e.label")} || ',"normalized_text":' || {_J("e.normalized_text")} || ',"score":' || coalesce(e.score::VARCHAR, 'null') || ',"text":' || {_J("e.text")} || '}}'), 'string_agg', ',') || ']' AS ents FROM c WHERE len(entities) > 0),
j AS (SELECT document_id, source_id, chunk_id, '{{"chunk_id":' || {_J("chunk_id")} || ',"document_id":' || {_J("document_id")} || ',"entities":' || CASE WHEN entities IS NULL THEN 'null' WHEN len(entities) = 0 THEN '[]' ELSE ents END
  || ',"source_id":' || {_J("source_id")} || ',"text":' || {_J("text")} || '}}' AS o FROM c LEFT JOIN ej USING (chunk_id)),
h AS (SELECT document_id, source_id, sha256('[' || string_agg(o, ',' ORDER BY chunk_id) || ']') AS source_hash FROM j GROUP BY 1, 2)"""


@query(_SOURCE + " SELECT coalesce(document_id, '') AS document_id, coalesce(source_id, '') AS source_id, source_hash FROM h")
def source_hash(spark: SparkSession, folder: str) -> DataFrame:
    return H.source_hashes(K.chunks(spark, folder)).fillna("", ["document_id", "source_id"])


@query(
    _SOURCE
    + f""", g AS (SELECT t.id AS topic, s.source_id, coalesce(source_hash, sha256('[]')) AS x FROM (SELECT DISTINCT id FROM topics) t CROSS JOIN (SELECT DISTINCT source_id FROM c WHERE source_id IS NOT NULL) s LEFT JOIN h ON h.document_id = t.id AND h.source_id = s.source_id)
SELECT topic, count(*) AS n_sources, sha256('{{' || string_agg({_J("source_id")} || ':' || {_J("x")}, ',' ORDER BY source_id) || '}}') AS knowledge_hash FROM g GROUP BY 1"""
)
def knowledge_hash(spark: SparkSession, folder: str) -> DataFrame:
    c = K.chunks(spark, folder)
    return H.knowledge_hashes(load(spark, folder, "topics"), c.select("source_id"), H.source_hashes(c)).select("topic", F.size("sources").alias("n_sources"), "knowledge_hash")


@query(
    rf"""WITH {K.D}, p AS (SELECT doc_id, {_canonical("title")} AS s, {_canonical("text")} AS u FROM d WHERE text IS NOT NULL AND title IS NOT NULL)
SELECT doc_id, sha256('{{"system_prompt":' || {_J("s")} || ',"user_prompt":' || {_J("u")} || '}}') AS prompt_hash FROM p"""
)
def prompt_hash(spark: SparkSession, folder: str) -> DataFrame:
    d = K.documents(spark, folder).where("text is not null and title is not null")
    return d.select("doc_id", H.prompt_hash(T.canonical_prompt(F.col("title")), T.canonical_prompt(F.col("text"))).alias("prompt_hash"))


@query(f"WITH {K.D} SELECT topic_id, source, doc_id FROM (SELECT topic_id, source, doc_id, row_number() OVER (PARTITION BY topic_id, source ORDER BY collected_at DESC NULLS LAST, doc_id DESC) AS n FROM d WHERE topic_id IS NOT NULL AND source IS NOT NULL) WHERE n = 1")
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    d = K.documents(spark, folder).where("topic_id is not null and source is not null")
    return B.latest(d, ["topic_id", "source"], [F.col("collected_at"), F.col("doc_id")]).select("topic_id", "source", "doc_id")


@query(f"WITH {K.D} SELECT doc_id FROM (SELECT doc_id, rank() OVER (PARTITION BY topic_id, lang ORDER BY year(collected_at) DESC) AS r FROM d WHERE topic_id IS NOT NULL AND lang IS NOT NULL AND collected_at IS NOT NULL) WHERE r = 1")
def latest_bank(spark: SparkSession, folder: str) -> DataFrame:
    d = K.documents(spark, folder).where("topic_id is not null and lang is not null and collected_at is not null").withColumn("version", F.year("collected_at"))
    return B.latest_bank(d, ["topic_id", "lang"], "version").select("doc_id")


@query(f"WITH {K.D}, h AS (SELECT topic_id AS topic, sha256(title) AS knowledge_hash, collected_at AS updated_at FROM d WHERE topic_id IS NOT NULL AND title IS NOT NULL AND collected_at IS NOT NULL) SELECT topic, max(struct_pack(u := updated_at, k := knowledge_hash)).k AS knowledge_hash FROM h GROUP BY 1")
def latest_topic_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of a topic's appended hashes; the titles' hashes stand for them."""
    d = K.documents(spark, folder).where("topic_id is not null and title is not null and collected_at is not null")
    rows = d.select(F.col("topic_id").alias("topic"), F.sha2("title", 256).alias("knowledge_hash"), F.col("collected_at").alias("updated_at"))
    return B.latest(rows, ["topic"], [F.col("updated_at"), F.col("knowledge_hash")]).select("topic", "knowledge_hash")


# question bank

_BUCKETS = """WITH n AS (SELECT source AS node, target AS other FROM entity_edges UNION SELECT target, source FROM entity_edges),
deg AS (SELECT node, count(DISTINCT other) AS degree FROM n GROUP BY 1),
r AS (SELECT label, node, row_number() OVER (PARTITION BY label ORDER BY degree DESC, node) AS k FROM (SELECT DISTINCT name AS node, label FROM entity_catalog WHERE label IS NOT NULL) JOIN deg USING (node))"""


@query(_BUCKETS + " SELECT name AS primary_concept, coalesce(r.label, 'Uncategorized') AS bucket_name FROM (SELECT DISTINCT name FROM entity_catalog) LEFT JOIN r ON node = name AND k <= 12")
def concept_bucket(spark: SparkSession, folder: str) -> DataFrame:
    catalog = load(spark, folder, "entity_catalog")
    buckets = B.group_concepts(load(spark, folder, "entity_edges"), catalog)
    return B.add_buckets(catalog.select(F.col("name").alias("primary_concept")).distinct(), buckets).select("primary_concept", "bucket_name")


@query(
    f"""SELECT 'all' AS topic, 'medium' AS difficulty, sha256(concat_ws(chr(1), 'all', 'medium', nodes)) AS question_id, 'How does ' || string_split(nodes, ' > ')[1] || ' relate to ' || string_split(nodes, ' > ')[-1] || '?' AS question, string_split(nodes, ' > ')[1] AS primary_concept
FROM ({path_sql(2, 5, 3)})"""
)
def generated_questions(spark: SparkSession, folder: str) -> DataFrame:
    from loomgraph.operators import graph as G

    paths = G.paths(G.undirected(load(spark, folder, "entity_edges")), 2)
    bank = spark.createDataFrame([], "topic string, difficulty string, question_id string, question string, primary_concept string")
    return B.fetch_or_generate(bank, lambda: B.template_questions(paths, "all", "medium"))


@query(f"WITH {K.D} SELECT doc_id, coalesce(title, '') AS title, coalesce(collected_at::VARCHAR, '') AS collected_at FROM d")
def export_bank(spark: SparkSession, folder: str) -> DataFrame:
    return B.export_rows(K.documents(spark, folder).select("doc_id", "title", "collected_at")).fillna("", ["title", "collected_at"])


@query(f"WITH {K.C} SELECT coalesce(document_id, '') AS document_id, coalesce(source_id, '') AS source_id, count(*) AS chunks, count(text) AS texts FROM c GROUP BY 1, 2")
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda k: F.coalesce(k, F.lit("")).alias(k)
    return K.chunks(spark, folder).groupBy(key("document_id"), key("source_id")).agg(F.count("*").alias("chunks"), F.count("text").alias("texts"))


# topics

_DETECT = f"""WITH {K.D}, q AS (SELECT DISTINCT split_part(title, ':', 1) AS query FROM d WHERE title IS NOT NULL), n AS (SELECT query, regexp_replace(lower(trim(query, ' ')), '[-_]+', ' ', 'g') AS q FROM q),
t AS (SELECT DISTINCT id, regexp_replace(lower(trim(id, ' ')), '[-_]+', ' ', 'g') AS i, regexp_replace(lower(trim(name, ' ')), '[-_]+', ' ', 'g') AS m, coalesce(tags, []) AS tags FROM topics),
s AS (SELECT query, id, q = i AS s1, len(list_filter(tags, lambda g: contains(q, g))) > 0 AS s3, row_number() OVER (PARTITION BY query ORDER BY id) AS k, CASE WHEN q = m THEN row_number() OVER (PARTITION BY query ORDER BY id) END AS own FROM n, t),
g AS (SELECT *, min(own) OVER (PARTITION BY query) AS p, bool_or(s1) OVER (PARTITION BY query) AS any1, bool_or(s3) OVER (PARTITION BY query) AS any3 FROM s),
f AS (SELECT query, id AS topic_id, CASE WHEN any1 THEN 1 WHEN p IS NOT NULL THEN 2 WHEN any3 THEN 3 ELSE 5 END AS stage FROM g WHERE CASE WHEN any1 THEN s1 WHEN p IS NOT NULL THEN k = p OR (k < p AND s3) WHEN any3 THEN s3 ELSE true END)"""


def _detected(spark: SparkSession, folder: str, fuzzy: bool) -> DataFrame:
    q = K.documents(spark, folder).select(F.substring_index("title", ":", 1).alias("query"))
    return W.detect_topics(q, load(spark, folder, "topics"), fuzzy=fuzzy)


@query(_DETECT + " SELECT * FROM f")
def topic_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(spark, folder, False)


@query()
def fuzzy_topics(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(spark, folder, True)


@query(
    _DETECT
    + """, m AS (SELECT doc_id, coalesce(source, '') AS source, collected_at, (SELECT min(topic_id) FROM f WHERE f.query = split_part(title, ':', 1) AND stage <= 2) AS topic FROM d WHERE collected_at IS NOT NULL),
w AS (SELECT doc_id, source, collected_at, last_value(topic IGNORE NULLS) OVER (PARTITION BY source ORDER BY collected_at, doc_id ROWS UNBOUNDED PRECEDING) AS topic FROM m)
SELECT doc_id, coalesce(topic, '') AS topic, coalesce(topic <> lag(topic) OVER (PARTITION BY source ORDER BY collected_at, doc_id), false) AS switched FROM w"""
)
def topic_switch(spark: SparkSession, folder: str) -> DataFrame:
    """The titles of a source, in order, as a conversation."""
    named = _detected(spark, folder, False).where("stage <= 2").groupBy("query").agg(F.min("topic_id").alias("topic"))
    d = K.documents(spark, folder).where("collected_at is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "collected_at", F.substring_index("title", ":", 1).alias("query"))
    m = d.join(named, "query", "left")
    return W.topic_switches(m, "source", ["collected_at", "doc_id"]).select("doc_id", F.coalesce("topic", F.lit("")).alias("topic"), "switched")


# state


@query("SELECT user_id, count(*) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT DISTINCT user_id, 0 FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def get_or_create(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    have = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("seen"))
    return M.get_or_create(have, e.select("user_id"), "user_id", {"seen": 0})


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events WHERE user_id IS NOT NULL) WHERE size <= 30 OR n <= 5")
def message_retention(spark: SparkSession, folder: str) -> DataFrame:
    return M.retain_messages(load(spark, folder, "events").where("user_id is not null"), "user_id", [F.col("ts"), F.col("event_id")]).select("event_id")


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def audio_stats(spark: SparkSession, folder: str) -> DataFrame:
    return audio.audio_stats(load(spark, folder, "events"), "event_type", "value")


@query(
    """WITH e AS (SELECT *, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS interview_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
u AS (SELECT user_id, min(ts)::VARCHAR AS started_at FROM e GROUP BY 1), p AS (SELECT user_id, count(*) AS purchases FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT interview_id, user_id, count(*) AS events, started_at, coalesce(any_value(purchases), -1) AS purchases, string_agg(event_type, ' ' ORDER BY event_id) AS messages FROM e JOIN u USING (user_id) LEFT JOIN p USING (user_id) GROUP BY 1, 2, 4"""
)
def conversation_context(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events of a day as a conversation, with the memories of the user."""
    e = load(spark, folder, "events").where("user_id is not null and ts is not null").withColumn("interview_id", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    sessions = e.groupBy("interview_id", "user_id").agg(F.count("*").alias("events"))
    episodic = e.groupBy("user_id").agg(F.min("ts").cast("string").alias("started_at"))
    procedural = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("purchases"))
    messages = e.select("interview_id", F.col("event_id").alias("turn_id"), F.col("event_type").alias("role"), F.col("value").cast("string").alias("content"))
    c = M.conversation_context(sessions, episodic, procedural, messages)
    return c.select("interview_id", "user_id", "session.events", "episodic.started_at", F.coalesce("procedural.purchases", F.lit(-1)).alias("purchases"), F.array_join("messages.role", " ").alias("messages"))


_SKILL = "CASE WHEN event_type = 'click' THEN 'hint' WHEN event_type = 'view' THEN 'ask' ELSE event_type END"


@query(
    f"""WITH s AS (SELECT user_id, max(value) AS last_eval_result FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, {_SKILL} AS skill, CASE WHEN {_SKILL} IN ('hint', 'explanation') THEN 'GENERATE' WHEN {_SKILL} = 'ask' THEN 'ASK_QUESTION' ELSE 'EVALUATE' END AS action,
  coalesce(CASE WHEN event_type = 'click' THEN value END, last_eval_result, 0) AS evaluation FROM events LEFT JOIN s USING (user_id)"""
)
def plan_actions(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    sessions = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("last_eval_result"))
    states = e.select("event_id", "user_id", F.expr(_SKILL).alias("skill"), F.when(F.col("event_type") == "click", F.col("value")).alias("execution_result"))
    last = states.join(sessions, "user_id", "left").select("event_id", "last_eval_result")
    return M.plan_actions(states, last, "event_id").select("event_id", "skill", "action", F.coalesce("evaluation", F.lit(0.0)).alias("evaluation"))


_UNIT = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} BETWEEN 0 AND 1"


@query(
    f"""WITH {K.E}, {K.CE}, r AS (
  SELECT 'entity_edges' AS name, CASE WHEN {_UNIT.format("weight")} THEN '' ELSE 'weight in [0, 1]' END AS broken FROM e
  UNION ALL SELECT 'chunk_edges', CASE WHEN {_UNIT.format("similarity")} THEN '' ELSE 'similarity in [0, 1]' END FROM ce
  UNION ALL SELECT 'llm_relations', concat_ws(', ', CASE WHEN {_UNIT.format("confidence")} THEN NULL ELSE 'confidence in [0, 1]' END, CASE WHEN relation IN ({", ".join(f"'{x}'" for x in RELATION_NAMES)}) THEN NULL ELSE 'relation in domain' END) FROM (SELECT DISTINCT * FROM llm_relations))
SELECT name, broken, count(*) AS n FROM r GROUP BY 1, 2"""
)
def validation(spark: SparkSession, folder: str) -> DataFrame:
    tables = [
        ("entity_edges", K.entity_edges(spark, folder), [V.between("weight")]),
        ("chunk_edges", K.chunk_edges(spark, folder), [V.between("similarity")]),
        ("llm_relations", load(spark, folder, "llm_relations").distinct(), [V.between("confidence"), V.one_of("relation", RELATION_NAMES)]),
    ]
    each = [V.judge(df, rules).groupBy(F.lit(name).alias("name"), F.array_join("broken", ", ").alias("broken")).agg(F.count("*").alias("n")) for name, df, rules in tables]
    return each[0].unionByName(each[1]).unionByName(each[2])
