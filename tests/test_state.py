import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing as H
from loomgraph.functions import rendering as X
from loomgraph.operators import audio, chunking
from loomgraph.operators import state as M
from loomgraph.operators import topics as W
from loomgraph.operators import validation as V
from loomgraph.sources import schemas, tables
from loomgraph.streaming import streams


def test_hash_is_that_of_canonical_json(spark):
    import hashlib

    ent = [{"text": "É\"x", "normalized_text": None, "label": "l", "score": 0.25}]
    rows = [("b", "d", "s", 'quo"te\né', ent), ("a", "d", "s", None, []), ("a", "d", "s", None, [])]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, source_id string, text string, entities array<struct<text:string,normalized_text:string,label:string,score:double>>")
    want = [dict(zip(("chunk_id", "document_id", "source_id", "text", "entities"), r)) for r in (rows[1], rows[0])]
    digest = hashlib.sha256(json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    got = H.source_hashes(c)
    assert got.first().source_hash == digest and H.source_hashes(c.orderBy(F.desc("chunk_id"))).first().source_hash == digest
    t = spark.createDataFrame([("d",), ("other",)], "id string")
    k = {r.topic: (r.sources, r.knowledge_hash) for r in H.knowledge_hashes(t, c.select("source_id"), got).collect()}
    empty = hashlib.sha256(b"[]").hexdigest()
    assert k["other"] == ({"s": empty}, hashlib.sha256(json.dumps({"s": empty}, separators=(",", ":")).encode()).hexdigest())


def test_rendering(spark):
    df = spark.createDataFrame([("strong", 0.5, [("a", "r", "b"), ("b", "q", "c")]), ("odd", None, [("a", "r", "b")])], "q string, s double, p array<struct<source:string,relation:string,target:string>>")
    assert [r[0] for r in df.select(X.render_path(F.col("q"), F.col("s"), F.col("p"))).collect()] == ["[s|0.5000] a- r -> b- q -> c", "[not_available|0.0000] a- r -> b"]
    e = spark.createDataFrame([([("t", "x=1")],), ([],)], "e array<struct<source:string,target:string>>")
    assert [r[0] for r in e.select(X.render_equations(F.col("e"))).collect()] == ["[EQ] x=1 \n INTUITION: t", "None"]
    d = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "d string")
    got = [r[0] for r in d.select(X.render_context(F.col("d"), *(F.lit(v) for v in ("[c]", "[k]", "two", "three", "ret", "rel")))).collect()]
    assert got[0] == "## Available Entities\n[c]\n\n## Supporting Knowledge\n[k]\n"
    assert "2-Hop)\ntwo\n" in got[1] and got[1].endswith("ret\n") and "3-Hop)\nthree\n" in got[2] and got[2].endswith("rel\n")


def test_state(spark):
    s = spark.createDataFrame([("u", 3, "x")], "user_id string, n int, note string")
    keys = spark.createDataFrame([("u",), ("v",), ("v",), (None,)], "user_id string")
    assert sorted(map(tuple, M.get_or_create(s, keys, "user_id", {"n": 0}).collect())) == [("u", 3, "x"), ("v", 0, None)]
    m = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1), ("b", 2)], "k string, turn int")
    kept = sorted((r.k, r.turn) for r in M.retain_messages(m, "k", [F.col("turn")], more_than=5, keep=2).collect())
    assert kept == [("a", 5), ("a", 6), ("b", 1), ("b", 2)]
    sessions = spark.createDataFrame([("i", "u", "open")], "interview_id string, user_id string, interview_status string")
    memory = spark.createDataFrame([("u", 1)], "user_id string, started int")
    msgs = spark.createDataFrame([("i", 2, "user", "b"), ("i", 1, "user", "a")], "interview_id string, turn_id int, role string, content string")
    row = M.conversation_context(sessions, memory, memory.where("false"), msgs).first()
    assert row.session.interview_status == "open" and row.episodic.started == 1 and row.procedural is None and [x.content for x in row.messages] == ["a", "b"]


def test_topics(spark):
    t = spark.createDataFrame([("log_reg", "Logistic Regression", ["glm", "odds"]), ("knn", "Neighbours", ["distance"]), ("none", "None", None)], "id string, name string, tags array<string>")
    q = spark.createDataFrame([("Log-Reg",), ("logistic regression",), ("all about odds and distance",), ("distanc",), ("zzzz",), (None,)], "query string")
    got = {}
    for r in W.detect_topics(q, t).collect():
        got.setdefault(r.query, (r.stage, set()))[1].add(r.topic_id)
    assert got == {"Log-Reg": (1, {"log_reg"}), "logistic regression": (2, {"log_reg"}), "all about odds and distance": (3, {"log_reg", "knn"}), "distanc": (4, {"knn"}), "zzzz": (5, {"log_reg", "knn", "none"})}
    m = spark.createDataFrame([("s", 1, None), ("s", 2, "a"), ("s", 3, None), ("s", 4, "b")], "k string, n int, topic string")
    assert [(r.topic, r.switched) for r in W.topic_switches(m, "k", ["n"]).orderBy("n").collect()] == [(None, False), ("a", False), ("a", False), ("b", True)]


def test_queries_are_read_as_asked(spark):
    t = spark.createDataFrame([("a_first", "First", ["logistic"]), ("log_reg", "Logistic Regression", ["glm"]), ("z_last", "Last", ["regression"])], "id string, name string, tags array<string>")
    q = spark.createDataFrame([("ask me on logistic regression",), ("Logistic-Regression",), ("glm",)], "query string")
    got = sorted(map(tuple, W.detect_topics(q, t).collect()))
    # a name match ends the search, with the tag matches before it
    assert got == [("Logistic-Regression", "a_first", 2), ("Logistic-Regression", "log_reg", 2), ("ask me on logistic regression", "a_first", 2), ("ask me on logistic regression", "log_reg", 2), ("glm", "log_reg", 3)]
    assert {r.stage for r in W.detect_topics(q.limit(1), t, fuzzy=False).collect()} == {3}
    with pytest.raises(ValueError):
        W.detect_topics(q, t, most=2)


def test_validation(spark):
    df = spark.createDataFrame([(0.5, [1, 2]), (1.5, [1]), (None, None), (float("nan"), [1, 2])], "w double, a array<int>")
    rules = [V.between("w"), V.sized("a", 2, 3)]
    good, bad = V.validate(df, rules)
    assert good.count() == 1 and sorted(len(r.broken) for r in bad.collect()) == [1, 2, 2]
    with pytest.raises(Exception, match="rejected row"):
        V.validate(df, rules, strict=True)[0].collect()


def test_chunking_and_audio(spark):
    d = spark.createDataFrame([(1, "Cats purr. Cats purr loudly. Stocks fell. Stocks fell today."), (2, None), (3, " "), (4, "One")], "id int, text string")
    got = {}
    for r in chunking.semantic_chunks(d, "id", "text", percentile=50, least=10).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert " ".join(got[1]) == "Cats purr. Cats purr loudly. Stocks fell. Stocks fell today." and len(got[1]) > 1 and set(got) == {1, 4}
    assert len(chunking.embed(d, "id", "text", 8).first().embedding) == 8
    a = audio.audio_stats(spark.createDataFrame([("s", 3.0), ("s", -4.0), ("s", None)], "k string, v double"), "k", "v").first()
    assert (a.low, a.high, a.rms) == (-4.0, 3.0, round((12.5) ** 0.5, 6))
    import io
    import wave

    w = wave.open(io.BytesIO(audio.wav_bytes(b"\x01\x00" * 10)))
    assert (w.getnframes(), w.getframerate(), w.getsampwidth(), w.getnchannels()) == (10, 24000, 2, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"a": "A name", "b": ["B name", ["x", "y"]]}))
    assert {r.id: (r.name, r.tags) for r in tables.topics(spark, str(tmp_path / "t.json")).collect()} == {"a": ("A name", []), "b": ("B name", ["x", "y"])}
    (tmp_path / "s.json").write_text(json.dumps({"mle": "maximum likelihood"}))
    syn = tables.synonyms(spark, str(tmp_path / "s.json"))
    rows = spark.createDataFrame([("mle",), ("other",)], "e string")
    assert {r.e: r.normalized_text for r in tables.apply_synonyms(F.col("e"), rows, syn.where("false"), syn).collect()} == {"mle": "maximum likelihood", "other": "other"}
    (tmp_path / "r.json").write_text(json.dumps({"uses": ["employs"]}))
    assert tables.relation_phrases(spark, str(tmp_path / "r.json")).first().phrases == ["employs"]
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "urls": ["u"]}, {"id": "b", "urls": []}]))
    assert tables.topic_sources(spark, str(tmp_path / "d.json")).count() == 2
    edges = spark.createDataFrame([("a", "b", ["x"], 0.5, "extra")], "source_chunk string, target_chunk string, shared_entities array<string>, similarity double, _id string")
    path = str(tmp_path / "edges")
    tables.append(edges, path, schemas.CHUNK_EDGE)
    tables.append(edges, path, schemas.CHUNK_EDGE)
    assert spark.read.parquet(path).count() == 2 and "_id" not in spark.read.parquet(path).columns
    with pytest.raises(ValueError):
        tables.append(edges.where("false"), path, schemas.CHUNK_EDGE)
    with pytest.raises(ValueError):
        tables.append(edges.drop("similarity"), path, schemas.CHUNK_EDGE)
    nodes = spark.createDataFrame([("a<",), ("b",)], "chunk_id string")
    tables.export_gexf(nodes, spark.createDataFrame([("a<", "b", 0.5)], "source string, target string, weight double"), str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part*")))
    root = ET.fromstring(text)
    assert len(root.findall(".//{*}node")) == 2 and root.find(".//{*}edge").get("source") == "a<"
    tables.export_json(spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), None)], "t timestamp_ntz, x string"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*"))) == {"t": "2024-01-02 03:04:05", "x": None}


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_audio_stream(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("s", 1, "start", None, t(1)), ("s", 2, "chunk", b"ab", t(2)), ("s", 3, "chunk", b"cd", t(3)), ("s", 4, "end", None, t(4)), ("r", 1, "chunk", b"xx", t(1)), ("q", 1, "end", None, t(1))]
    schema = "session string, seq long, kind string, pcm binary, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    pieces = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    run_stream(streams.audio_sessions(pieces), "audio")
    got = spark.sql("select session, n_bytes from audio").collect()
    assert [tuple(r) for r in got] == [("s", 4)]


def test_windows_and_upsert(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, h), "click", 1.0) for h in (0, 0, 1, 5)]
    schema = "user_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    run_stream(streams.event_windows(read()), "wins")
    assert sorted(r.n for r in spark.sql("select * from wins").collect()) == [1, 2]
    run_stream(streams.user_sessions(read()), "sess")
    assert spark.sql("select * from sess").count() == 2
    step = streams.keyed_upsert(str(tmp_path / "state"), "user_id", {"n": 0}, "user_id long, n int")
    for _ in range(2):
        q = read().writeStream.foreachBatch(step).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "state")).collect()] == [(1, 0)]
