"""Queries of the training-data operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import canonical, encoding, mixing, neardup, neighbours, reading, setpairs, splitting, topn
from loomgraph.sources.tables import load

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1: near-duplicates


def _near(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar_texts(load(spark, folder, "chunks"), "chunk_id", "text", threshold=0.6, width=3, least_words=20)


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.expanded(*_pairs_of(_near(spark, folder), "chunk_id"), "chunk_a", "chunk_b")


@query
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    members, links = _near(spark, folder)
    return neardup.groups(members, "chunk_id", links)


def _pairs_of(found: tuple[DataFrame, DataFrame], key: str) -> tuple[DataFrame, str, DataFrame]:
    return found[0], key, found[1]


_SHINGLES = """
WITH RECURSIVE texts AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks WHERE text IS NOT NULL),
shingles AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 20)),
sizes AS (SELECT chunk_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
"""
SQL["p1_found"] = _SHINGLES + "SELECT a AS chunk_a, b AS chunk_b FROM common JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9"



@query
def p1_components(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's group, without the name of its class."""
    return p1_groups(spark, folder).select("chunk_id", "group_id")


SQL["p1_components"] = _SHINGLES + """, near AS (SELECT a, b FROM common JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT chunk_id AS a, chunk_id AS b FROM sizes UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
SELECT a AS chunk_id, min(b) AS group_id FROM reach GROUP BY 1"""

# 2: splitting


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(load(spark, folder, "chunks"), "chunk_id", "text", limit=1200, overlap=100)


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("n_pieces > 1").select("chunk_id").distinct()


@query
def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


@query
def p2_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each text put together again from its pieces, as a hash, with the rules that the pieces keep."""
    p = _pieces(spark, folder).select("chunk_id", F.struct("piece_no", "start", "piece").alias("p"))
    all_ = p.groupBy("chunk_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.when(x.piece_no == 0, x.piece).otherwise(F.substr(x.piece, F.lit(101)))), "")
    overlaps = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == F.size("p")) | (F.substr(F.get("p", i - 1).piece, F.lit(-100)) == F.substr(F.get("p", i).piece, F.lit(1), F.lit(100))))
    return all_.select("chunk_id", F.md5(text).alias("text_md5"), F.forall("p", lambda x: F.length(x.piece) <= 1200).alias("short_enough"), overlaps.alias("overlaps"), (F.size("p") > 1).alias("cut"))


SQL["p2_rebuilt"] = "SELECT DISTINCT chunk_id, md5(text) AS text_md5, true AS short_enough, true AS overlaps, length(text) > 1200 AS cut FROM chunks WHERE text IS NOT NULL"
SQL["p2_found"] = "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1200"


# 3: canonical values


def _entity_values(spark: SparkSession, folder: str) -> DataFrame:
    chunks = load(spark, folder, "chunks").select("chunk_id", F.posexplode("entities").alias("pos", "e"))
    return chunks.where("e.label is null or e.label not in ('variable', 'equation')").select(F.col("chunk_id").alias("record_id"), "pos", F.col("e.normalized_text").alias("value"))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    relations = load(spark, folder, "llm_relations").select(F.col("relation_id").cast("string").alias("record_id"), F.lit(0).alias("pos"), F.col("relation").alias("value"))
    entities = _entity_values(spark, folder)
    found = [
        canonical.mapped(relations, ["record_id", "pos"], "value", load(spark, folder, "relation_types"), "relation", "phrases", verbs=True).withColumn("field_name", F.lit("relation")),
        canonical.mapped(entities, ["record_id", "pos"], "value", load(spark, folder, "entity_catalog"), "name", "aliases").withColumn("field_name", F.lit("entity")),
    ]
    return found[0].unionByName(found[1]).select("field_name", "record_id", "pos", "canonical")


@query
def p3_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Unmatched values per field."""
    return p3_found(spark, folder).groupBy("field_name").agg(F.count_if(F.col("canonical") == canonical.UNMATCHED).alias("unmatched"), F.count("*").alias("values"))


# 5: nearest vectors


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "chunks"), "chunk_id", "embeddings", k=5, dim=64).select("chunk_id", "neighbour_id")


#: The queries of a search: ids whose first eight hexadecimal digits are a number divisible by 50.
_ASKS = "conv(substr(chunk_id, 1, 8), 16, 10) % 50 = 0"


@query
def p5_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The exact neighbours of every 50th chunk, against all chunks."""
    found = neighbours.exact_nearest(load(spark, folder, "chunks").select("chunk_id", "embeddings").distinct(), "chunk_id", "embeddings", F.expr(_ASKS))
    return found.select("chunk_id", "neighbour_id", "cosine", "rank")


SQL["p5_exact"] = """
WITH v AS (SELECT DISTINCT chunk_id, embeddings AS v FROM chunks WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_id, b.chunk_id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE ('0x' || substr(a.chunk_id, 1, 8))::BIGINT % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY cosine DESC, neighbour_id) AS rank FROM s) WHERE rank <= 5"""


@query
def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the exact neighbours of every 50th chunk that p5_found has."""
    want = p5_exact(spark, folder).select("chunk_id", "neighbour_id")
    got = p5_found(spark, folder).where(_ASKS).withColumn("hit", F.lit(1))
    return want.join(got, ["chunk_id", "neighbour_id"], "left").agg(F.count("*").alias("neighbours"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


# 6: top N


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "entity_edges").where("weight between 0 and 1 and not isnan(weight)")
    return e.select(F.lower(F.trim("source")).alias("source_key"), "edge_id", "weight").where("source_key <> ''")


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(_edges(spark, folder), "source_key", "weight", "edge_id", 5).select("source_key", "edge_id")


SQL["p6_found"] = """
SELECT source_key, edge_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY weight DESC, edge_id) AS r FROM (
    SELECT DISTINCT lower(trim(source, ' ')) AS source_key, edge_id, weight FROM entity_edges WHERE weight BETWEEN 0 AND 1 AND NOT isnan(weight))
  WHERE source_key <> '') WHERE r <= 5"""


# 7: similar sets


def _sets(spark: SparkSession, folder: str) -> dict[str, tuple[tuple[DataFrame, DataFrame], str]]:
    chunks = load(spark, folder, "chunks").select("chunk_id", F.col("entities.normalized_text").alias("v"))
    edges = load(spark, folder, "chunk_edges").select("edge_id", F.col("shared_entities").alias("v"))
    return {"chunks": (setpairs.similar_sets(chunks, "chunk_id", F.col("v"), 0.6, 3), "chunk_id"), "chunk_edges": (setpairs.similar_sets(edges, "edge_id", F.col("v"), 0.6, 3), "edge_id")}


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    both = [neardup.expanded(*_pairs_of(found, key), "id_a", "id_b").select(F.lit(table).alias("set_table"), "id_a", "id_b") for table, (found, key) in _sets(spark, folder).items()]
    return both[0].unionByName(both[1])


@query
def p7_links(spark: SparkSession, folder: str) -> DataFrame:
    both = [setpairs.link_counts(members, key, links).withColumnRenamed(key, "record_id").withColumn("set_table", F.lit(table)) for table, ((members, links), key) in _sets(spark, folder).items()]
    return both[0].unionByName(both[1])


@query
def p7_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """p7_links without the name of the class."""
    return p7_links(spark, folder).select("set_table", "record_id", "copies", "links")


_SETS = """
WITH lists AS (
  SELECT 'chunks' AS set_table, chunk_id AS id, unnest(list_transform(entities, lambda e: lower(trim(e.normalized_text, ' ')))) AS v FROM chunks
  UNION ALL SELECT 'chunk_edges', edge_id, unnest(list_transform(shared_entities, lambda e: lower(trim(e, ' ')))) FROM chunk_edges),
items AS (SELECT DISTINCT * FROM lists WHERE v IS NOT NULL),
sizes AS (SELECT set_table, id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) >= 3),
kept AS (SELECT i.*, n FROM items i JOIN sizes USING (set_table, id)),
common AS (SELECT a.set_table, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM kept a JOIN kept b ON a.set_table = b.set_table AND a.v = b.v AND a.id < b.id GROUP BY ALL)
"""
SQL["p7_found"] = _SETS + "SELECT set_table, id_a, id_b FROM common WHERE c >= 0.6 * (na + nb - c) - 1e-9"
SQL["p7_degrees"] = _SETS + """, near AS (SELECT * FROM common WHERE c >= 0.6 * (na + nb - c) - 1e-9),
ends AS (SELECT set_table, id_a AS id, c = na AND c = nb AS same FROM near UNION ALL SELECT set_table, id_b, c = na AND c = nb FROM near)
SELECT s.set_table, s.id AS record_id, 1 + count(*) FILTER (same) AS copies, count(ends.id) AS links FROM sizes s LEFT JOIN ends ON ends.set_table = s.set_table AND ends.id = s.id GROUP BY 1, 2"""

# 8: encoding


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_texts(load(spark, folder, "documents"), "doc_id", "text")


# 9: mixing


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"), "doc_id")


@query
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


@query
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


@query
def p9_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture by characters: what each source was to give and could, and whether it gave that within its largest document."""
    d = load(spark, folder, "documents")
    shares = mixing.mix(d, load(spark, folder, "mix_targets"), "doc_id", size=F.length("text"))[1]
    most = d.groupBy("source").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest"))
    t = shares.join(most, "source", "left").join(load(spark, folder, "mix_targets").select("source", "max_repeats").distinct(), "source")
    gap = F.abs(F.col("mixed_tokens") - F.least("target_tokens", "available_tokens"))
    return t.select("source", "target_tokens", "available_tokens", (gap <= F.coalesce("longest", F.lit(0))).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


SQL["p9_by_length"] = """
WITH d AS (SELECT DISTINCT doc_id, source, length(text) AS n FROM documents WHERE length(text) > 0 AND source IN (SELECT source FROM mix_targets)),
own AS (SELECT source, sum(n) AS size FROM d GROUP BY 1)
SELECT source, round(target_share * (SELECT sum(n) FROM d))::BIGINT AS target_tokens, (coalesce(size, 0) * max_repeats)::BIGINT AS available_tokens, true AS reached, true AS within_repeats FROM (SELECT DISTINCT * FROM mix_targets) LEFT JOIN own USING (source)"""

# 10: reading level


def _model(spark: SparkSession, folder: str) -> reading.Model:
    return reading.train(load(spark, folder, "documents"), load(spark, folder, "doc_levels"), "doc_id", "text", "source", "reading_level")


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.levels(load(spark, folder, "documents"), "doc_id", "text", _model(spark, folder))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("level >= 4").select("doc_id").distinct()


@query
def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


@query
def p10_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out errors by fold of sources."""
    report = reading.validate(load(spark, folder, "documents"), load(spark, folder, "doc_levels"), "doc_id", "text", "source", "reading_level")
    return spark.createDataFrame(report, "fold int, texts long, mean_error double, within_half double, demanding_right double")
