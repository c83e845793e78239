"""Plug points, traces, stores, readers and the other parts that stand beside the registered queries."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from plinth import engine
from plinth.functions import display, extract, security
from plinth.operators import graph, retrieval, segment, vector
from plinth.schema import EVENT_SCHEMA
from plinth.sources import files
from plinth.sources.sinks import Mirror
from plinth.streaming import bus, trace

PRIVATE = "1. The Madras High Court heard Asha Rao v. State of Bihar.\n"
PUBLIC = "THE INDIAN PENAL CODE, 1860\n378. Theft. Whoever takes movable property dishonestly commits theft, says the Supreme Court of India.\n"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("ipc", "statute", PUBLIC, None), ("a", "judgment", PRIVATE, "m1"), ("b", "judgment", PRIVATE + "2. The Supreme Court of India agreed.\n", "m2")], "id string, kind string, text string, matter_id string")
    return engine.ingest(docs)


def _ask(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "qid int, question string, matter_scope string, ceiling int, as_of string")


def test_entities_stay_in_their_matter(corpus):
    nodes = {r.id: r.matter_id for r in corpus.nodes.filter("node_type in ('Court', 'Party')").collect()}
    assert nodes["court:supreme_court_of_india"] is None  # a public span names it
    assert nodes["court:madras_high_court@m1"] == "m1" and nodes["court:madras_high_court@m2"] == "m2" and "court:madras_high_court" not in nodes


def test_embedders_hand_over(spark, corpus):
    rows = spark.createDataFrame([(1, "theft of a bicycle"), (2, ""), (3, None)], "id int, text string")

    def broken():
        raise OSError("no model")

    def fails():
        return lambda texts: (_ for _ in ()).throw(RuntimeError())

    def counts():
        return lambda texts: [[float(len(t)), 4.0] for t in texts]

    by = lambda *models: {r.id: r.vec for r in vector.embed(rows, "id", "text", models).collect()}
    assert by(broken, fails, counts)[2] == [0.0, 1.0] and abs(by(counts)[1][0] - 18 / (18**2 + 16) ** 0.5) < 1e-12
    hashed = by(broken, fails)
    assert hashed[2] == [0.0] * 256 == hashed[3]
    sparse = {r.bucket: r.weight for r in vector.embed_sparse(rows, "id", "text").filter("id = 1").collect()}
    assert {k: round(v, 12) for k, v in sparse.items()} == {k: round(v, 12) for k, v in enumerate(hashed[1]) if v}
    found = engine.recall(_ask(spark, [(1, "dishonestly takes movable property", None), (2, "Madras court", "m1")]), corpus, 3, [broken]).collect()
    assert found and all(r.node == "section:ipc:378" for r in found if r.qid == 1)


def test_nearest_equals_topk(spark):
    import random

    rng = random.Random(2)
    points = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)], f"m{k % 3}" if k % 4 == 0 else None) for k in range(300)], "id int, vec array<double>, matter_id string").repartition(5)
    unit = F.transform("vec", lambda x: x / vector.norm(F.col("vec")))
    points = points.withColumn("vec", unit)
    asked = points.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec", F.when(F.col("id") % 100 == 0, "m1").alias("scope"))
    best = lambda df: sorted((r.qid, r.id, r.sim) for r in df.collect())
    want = best(vector.topk(asked, points, 7))
    assert best(vector.nearest(asked, points, 7)) == want
    small, vector.QUERY_ROWS = vector.QUERY_ROWS, 2
    try:
        assert best(vector.nearest(asked, points, 7)) == want == best(vector.topk(asked, points, 7))
    finally:
        vector.QUERY_ROWS = small


def test_providers_and_their_fallback(spark, corpus):
    asked = _ask(spark, [(1, "What is Section 378 of IPC?", None), (2, "Punishment under Section 378 of IPC", None)])
    stub, _ = engine.answer(asked, corpus)
    one = lambda df: {r.qid: r.answer for r in df.collect()}

    def half(prompts):
        assert "Question:\n" in prompts.first().prompt and "[S1]" in prompts.first().prompt
        return prompts.filter("qid = 1").select("qid", F.lit("Answer: Theft is taking [S1]. Ghosts speak.\nLegal basis:\n- [S1] code\nConfidence: HIGH\nInsufficient evidence: NO").alias("text"))

    def broken(prompts):
        raise ConnectionError("no network")

    def late(prompts):
        return prompts.select("qid", F.raise_error(F.lit("no model")).cast("string").alias("text"))

    got = one(engine.answer(asked, corpus, provider=half)[0])
    assert got[1] == "Theft is taking [S1]." and got[2] == one(stub)[2]
    assert one(engine.answer(asked, corpus, provider=broken)[0]) == one(stub) == one(engine.answer(asked, corpus, provider=late)[0])
    providers = {"remote": None, "local": half, "stub": None}
    assert engine.provider_for("auto", providers) is half is engine.provider_for(None, providers) and engine.provider_for("odd", providers) is None and engine.provider_for("REMOTE", providers) is None


def test_rerankers_seed_providers_and_mirrors(spark, corpus):
    asked = _ask(spark, [(1, "Section 378 of IPC", None), (2, "zzz", None)])
    seen = []

    class There:
        def add(self, episodes):
            seen.extend(episodes.select("name", "body", "source_description", "group_id").collect())

        def search(self, questions):
            return spark.createDataFrame([(1, "fact:9", None, 0.5, "an outside fact about theft"), (1, "section:ipc:378", 1, 9.0, "known"), (2, "fact:9", 3, 0.1, "an outside fact")], "qid int, node string, tier int, score double, excerpt string")

    mirror = Mirror(There)
    assert mirror.available and not Mirror().available and not Mirror(lambda: 1 / 0).available
    engine.ingest(spark.createDataFrame([("x", "notice", "Some text\n", "m1")], "id string, kind string, text string, matter_id string"), mirror=mirror)
    assert seen and seen[0].source_description.startswith("provenance_span:") and seen[0].group_id == "m1"
    by_name = lambda c: retrieval._ranked(c, F.desc("node"))
    proposed = lambda q, c, k: q.select("qid", F.lit("act:ipc").alias("node"))
    packs, _, _ = engine.evidence(asked, corpus, reranker=by_name, seed_provider=proposed, mirror=mirror)
    got = {q: [r.node for r in packs.filter(F.col("qid") == q).orderBy("pos").collect()] for q in (1, 2)}
    assert "fact:9" in got[1] and got[1] == sorted(got[1], reverse=True) and got[1].count("section:ipc:378") == 1 and "fact:9" in got[2] and "act:ipc" in got[2]
    assert Mirror().search(asked).count() == 0


def test_model_entities_join_the_patterns(spark):
    text = "The delhi high court heard Ram Singh v. State of Bihar, counsel Asha."

    def load():
        def model(t):
            if "fail" in t:
                raise RuntimeError
            at = t.index("Ram")
            return [{"entity_group": "B-LAWYER", "word": "Asha", "score": 0.98765}, {"entity": "PETITIONER", "word": "Ram Singh", "start": at, "end": at + 9}, {"label": "GPE", "word": "nowhere"}, {"entity_group": "RESPONDENT", "word": "State of Bihar, counsel"}, {"entity_group": "x", "word": ""}]

        return model

    rows = spark.createDataFrame([("1", text), ("2", "Ram fail Singh v. State")], "id string, text string")
    got = [(r.kind, r.raw, r.extra) for r in extract.extract_entities(rows, load).orderBy("id", "pos").collect()]
    assert got == [("Court", "delhi high court", "HC"), ("Party", "Ram Singh", "petitioner"), ("Party", "State of Bihar, counsel", "model;role=respondent"), ("Lawyer", "Asha", "model;score=0.9877"), ("Party", "Singh", "petitioner"), ("Party", "State", "respondent")]
    plain = extract.extract_entities(rows, lambda: 1 / 0).filter("id = '1'").count()
    assert plain == extract.extract_entities(rows).filter("id = '1'").count() == 3


def test_span_fallbacks_and_counts(spark):
    edges = spark.createDataFrame([("NODE_DERIVED_FROM_SOURCE", "a", "s1", None), ("MENTIONS", "e1", "b", None), ("RELATES_TO", "x", "y", "r"), ("MENTIONS", "e2", "y", None), ("MENTIONS", "e1", "a", None), ("NODE_DERIVED_FROM_SOURCE", "z", "gone", None)], "edge_type string, src string, dst string, id string")
    spans = spark.createDataFrame([("s1", "one"), ("s2", "two")], "id string, text string")
    episodes = spark.createDataFrame([("e1", "first", "provenance_span:s2"), ("e2", "second", "provenance_span:lost")], "id string, content string, source_description string")
    ids = spark.createDataFrame([(x,) for x in "abryz"], "node string")
    got = {r.node: (r.span_id, r.text, r.via) for r in graph.span_with_fallbacks(ids, edges, spans, episodes).collect()}
    assert got == {"a": ("s1", "one", "direct"), "b": ("s2", "two", "mention"), "r": ("e2", "second", "synthetic"), "y": ("e2", "second", "synthetic")}
    nodes = spark.createDataFrame([("1", "Act"), ("2", "Act")], "id string, node_type string")
    assert {(r.what, r.kind, r.n) for r in graph.counts_by_type(nodes, edges).collect()} == {("node", "Act", 2), ("edge", "MENTIONS", 3), ("edge", "RELATES_TO", 1), ("edge", "NODE_DERIVED_FROM_SOURCE", 2)}


def test_paragraph_roles_by_bisection():
    text = "1. FACTS OF THE CASE are these.\n2. ORDER follows.\n3. Appeal dismissed.\n"
    rows = segment.judgment(text)
    assert [r[6] for r in rows] == ["facts", "order", "order"]


# ---- sources ----------------------------------------------------------------------------------------


def test_parsing_by_media_type_with_problems(spark, tmp_path):
    raw = {"a.bin": b"<html><body><main>Main</main></body></html>", "b.txt": "café".encode(), "c.txt": "закон".encode("utf-16"), "d.txt": b"caf\xe9s", "e.pdf": b"not a pdf", "f.docx": b"broken", "g.html": "<p>café</p>".encode("latin-1") + b" "}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path)).withColumn("mime", F.when(F.col("name") == "a.bin", "text/html").otherwise(""))
    got = {r.name: r for r in files.parse(found).collect()}
    assert (got["a.bin"].parser, got["a.bin"].text) == ("html", "Main") and got["b.txt"].text == "café" and got["c.txt"].text == "закон" and got["d.txt"].text == "cafés"
    assert [(p.start, p.end) for p in got["b.txt"].page_offsets] == [(0, 4)]
    assert got["e.pdf"].text == "" and got["e.pdf"].problem and got["f.docx"].problem == "BadZipFile" and got["g.html"].text
    locked = files.parse(found).withColumn("encrypted", F.col("name") == "b.txt")
    assert files.readable(locked).count() == 6
    assert files.joined_pages(["ab", "", "c"]) == ("ab\n\nc", [(0, 2), (3, 3), (4, 5)])


def test_ocr_reads_short_scans(spark):
    rows = spark.createDataFrame([("a", "pdf", " ", bytearray(b"xy")), ("b", "pdf", "long " * 40, bytearray(b"z")), ("c", "text", "", bytearray(b"q"))], "path string, parser string, text string, content binary")

    def load():
        return lambda data: [("page one", [90, -1, 70]), ("two", [])]

    (one,) = files.ocr(rows, load).collect()
    assert (one.path, one.text, list(one.page_confidences), one.problem) == ("a", "page one\ntwo", [0.8, 0.0], None) and [(p.start, p.end) for p in one.page_offsets] == [(0, 8), (9, 12)]
    (none,) = files.ocr(rows, lambda: 1 / 0).collect()
    assert (none.text, none.problem) == ("", "ZeroDivisionError")


def test_bad_json_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "q": "a"}\n\n   \n{"id": "no number"}\nbroken\n')
    got = [(r.id, r.q, r.bad_line) for r in files.jsonl(spark, str(tmp_path / "x.jsonl"), "id int, q string").collect()]
    assert got[0] == (1, "a", None) and [b for _, _, b in got[1:]] == ['{"id": "no number"}', "broken"]


def test_uploads_are_verified(spark):
    import hashlib

    rows = spark.createDataFrame([(1, bytearray(b"a"), hashlib.sha256(b"a").hexdigest().upper()), (2, bytearray(b"b"), "0")], "id int, content binary, claimed string")
    assert files.require_verified(rows.filter("id = 1"), "id").count() == 1
    with pytest.raises(ValueError, match="2"):
        files.require_verified(rows, "id")


class Bucket:
    """An S3-compatible client whose buckets are dictionaries."""

    def __init__(self, failures=0):
        self.buckets, self.failures = {}, failures

    def bucket_exists(self, bucket):
        if self.failures:
            self.failures -= 1
            raise ConnectionError
        return bucket in self.buckets

    def make_bucket(self, bucket):
        self.buckets[bucket] = {}

    def _held(self, bucket):
        if bucket not in self.buckets:
            raise RuntimeError("S3 NoSuchBucket here")
        return self.buckets[bucket]

    def put(self, bucket, key, data):
        self._held(bucket)[key] = data

    def get(self, bucket, key):
        return self._held(bucket)[key]

    stat = get

    def presign(self, bucket, key, expires_s):
        return f"https://h/{bucket}/{key}?{expires_s}"


def test_stores(tmp_path):
    client = Bucket()
    store = files.store_for("b", str(tmp_path), lambda: client)
    assert store.put("k/x", b"1") == "s3://b/k/x" and store.get("k/x") == b"1" and store.exists("k/x") and not store.exists("y") and store.presign("k/x", 5).endswith("?5")
    with pytest.raises(KeyError):
        store.get("none")
    local = files.store_for("c", str(tmp_path), lambda: 1 / 0)
    assert local.put("a.txt", b"2").startswith("file://") and local.presign("a.txt").endswith("c/a.txt")
    assert files.load_bytes("s3://b/k/x", {"b": store}) == b"1" and files.load_bytes(local.presign("a.txt"), {}) == b"2" == files.load_bytes(f"{tmp_path}/c/a.txt", {})
    waits = []
    slow = files.BucketStore(Bucket(failures=3), "d")
    files.ensure_stores([slow], sleep=waits.append)
    assert waits == [0.25, 0.5, 0.75] and slow.client.buckets == {"d": {}}
    with pytest.raises(ConnectionError):
        files.ensure_stores([files.BucketStore(Bucket(failures=9), "d")], sleep=waits.append)
    assert len(files.write_demo(files.LocalStore(str(tmp_path / "demo")))) == 4 == len(list((tmp_path / "demo").rglob("*.txt")))


# ---- events and traces --------------------------------------------------------------------------------


def _rows(spark, n=60, start=0):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + dt.timedelta(seconds=37 * i), i % 3, f"t{i % 2}", float(i), "{}") for i in range(start, start + n)], EVENT_SCHEMA)


def test_one_bad_event_goes_alone(spark, tmp_path):
    _rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    strict = F.when(F.col("event_id").isin(13, 40), F.raise_error(F.lit("poison"))).otherwise(F.col("event_id"))
    paths = [str(tmp_path / n) for n in ("out", "dead", "ck")]
    bus.run_stage(bus.events(spark, str(tmp_path / "in")), lambda rows: rows.select(strict.cast("long").alias("event_id")), *paths)
    assert {r.event_id for r in spark.read.parquet(paths[1]).collect()} == {13, 40}
    assert sorted(r.event_id for r in spark.read.parquet(paths[0]).collect()) == [i for i in range(60) if i not in (13, 40)]


def test_stages_work_until_nothing_is_new(spark, tmp_path):
    root = str(tmp_path)
    _rows(spark, 20).write.parquet(f"{root}/ingest.request")
    next_ = lambda rows: rows.withColumn("event_id", F.col("event_id") + 100)
    stages = [bus.Stage("segment", "ingest.completed", "segment.completed", lambda r: next_(r.filter("event_id % 2 = 0"))), bus.Stage("ingest", "ingest.request", "ingest.completed", next_)]
    assert bus.run_stages(spark, stages, root) == {"ingest.request": 20, "ingest.completed": 20, "segment.completed": 10}
    assert bus.run_stages(spark, stages, root, expected={"segment.completed": 1})["segment.completed"] == 10


def test_consumers_from_now_on(spark, tmp_path):
    path = str(tmp_path / "in")
    _rows(spark, 10).write.parquet(path)
    time.sleep(1.1)
    stream = bus.from_now_on(spark, path)
    time.sleep(1.1)
    _rows(spark, 5, 100).write.mode("append").parquet(path)
    q = stream.select("event_id").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    assert q.awaitTermination(60) or q.stop()
    assert sorted(r.event_id for r in spark.table("fresh").collect()) == list(range(100, 105))


def test_stream_stream_join_and_late_events(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda i, minutes, user, kind: (i, at + dt.timedelta(minutes=minutes), user, kind, 0.0, "{}")
    batches = [[row(1, 0, 1, "ask"), row(2, 1, 2, "ask"), row(11, 5, 1, "said")], [row(3, 200, 3, "ask"), row(12, 201, 3, "said")], [row(4, 202, 9, "ask"), row(14, 205, 3, "said")], [row(5, 203, 9, "ask"), row(13, 6, 2, "said")]]
    path = str(tmp_path / "in")
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT_SCHEMA)
    for k, b in enumerate(batches):
        spark.createDataFrame(b, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    side = lambda df, kind: df.filter(F.col("event_type") == kind)
    pairs = lambda df: sorted((r.request_id, r.answer_id) for r in df.collect())
    assert pairs(bus.answered_within(side(whole, "ask"), side(whole, "said"))) == [(1, 11), (2, 13), (3, 12), (3, 14)]
    stream = lambda: bus.events(spark, path, max_files=1)
    q = bus.answered_within(side(stream(), "ask"), side(stream(), "said")).writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) or q.stop()
    assert pairs(spark.table("joined")) == [(1, 11), (3, 12), (3, 14)]  # event 13 comes when the watermark is past it


def test_traces():
    now = [0.0]
    traces = trace.Traces(keep=3, idle_s=10, clock=lambda: now[0])
    trace.emit("outside", traces=traces)
    with trace.scope("t"):
        for k in range(5):
            trace.emit(f"s{k}", "done", message=None, traces=traces, n=k)
    assert [s["stage"] for s in traces.history("t")] == ["s2", "s3", "s4"] and traces.history("t")[0]["details"] == {"n": 2} and "message" not in traces.history("t")[0]
    late = traces.subscribe("t")
    assert [late.get_nowait()["stage"] for _ in range(3)] == ["s2", "s3", "s4"]
    now[0] = 60.0
    traces.publish("u", {"stage": "x"})
    assert traces.history("t")  # someone listens
    traces.unsubscribe("t", late)
    now[0] = 61.0
    traces.publish("u", {"stage": "y"})
    assert traces.history("t") == []


def test_server_events():
    traces = trace.Traces()

    def work():
        for k in range(3):
            trace.emit(f"s{k}", traces=traces)
        return {"text": "done"}

    read = lambda frames: [json.loads(f.removeprefix(b"data: ")) for f in frames]
    got = read(trace.server_events("t", work, traces=traces))
    assert [e["stage"] for e in got] == ["trace.open", "s0", "s1", "s2", "answer.ready"] and got[-1]["answer"] == {"text": "done"} and all(e["trace_id"] == "t" for e in got)
    failed = read(trace.server_events("f", lambda: 1 / 0, traces=traces))
    assert failed[-1]["status"] == "end" and "zero" in failed[-1]["error"]
    slow = read(trace.server_events("w", lambda: time.sleep(0.4), wait_s=0.05, traces=traces))
    assert [e["stage"] for e in slow] == ["trace.open"]


# ---- texts for people, tokens ---------------------------------------------------------------------------


def test_display(spark):
    row = spark.sql("select 'a [S1][S2] b [Sx] [S10]' as t, '' as e, 512.4D as ms").select(display.marker_runs(F.col("t")).alias("runs"), display.marker_runs(F.col("e")).alias("none"), display.elapsed_text(F.col("ms")).alias("ms"), display.tier_text(F.lit(9)).alias("tier"), display.signals(F.lit("Section 302 IPC punishment, map to BNS, judgment"), F.lit("m")).alias("signals")).first()
    assert [(r.kind, r.value) for r in row.runs] == [("text", "a "), ("marker", "S1"), ("marker", "S2"), ("text", " b [Sx] "), ("marker", "S10")] and row.none == []
    assert row.ms == "512 ms" and row.tier == "Unknown" and len(row.signals) == 4 and row.signals[0].label == "Matter-scoped retrieval"


def test_tokens_and_passwords():
    token = security.issue_token("k", "me", 5, {"role": "r"}, now=1000)
    assert security.verify_token("k", token, now=1200)["role"] == "r"
    for bad, when in ((token[:-2] + "xx", 1200), (token, 2000), ("a.b", 1200), (security.issue_token("other", "me", now=1000), 1200)):
        with pytest.raises(ValueError):
            security.verify_token("k", bad, now=when)
    stored = security.hash_password("secret")
    assert security.verify_password("secret", stored) and not security.verify_password("Secret", stored) and not security.verify_password("secret", "x") and stored != security.hash_password("secret")
