import json

from pyspark.sql import functions as F

from tessella.functions import backoff, diagrams, loose_json
from tessella.operators import graph
from tessella.plans import search


def test_retry_hints(spark):
    now = F.lit("2026-10-21 07:27:00").cast("timestamp")
    hints = {"120": 120_000, " 0 ": 0, "99999": 300_000, "9" * 50: 300_000, "Wed, 21 Oct 2026 07:28:00 GMT": 60_000, "Tue, 20 Oct 2026 07:28:00 GMT": 0, "-10": None, "1.5": None, "soon": None, "": None, "Wed, 99 Foo 2026 07:28:00 GMT": None}
    df = spark.createDataFrame([(h,) for h in [*hints, None]], "h string")
    got = {r.h: r.w for r in df.select("h", backoff.retry_after_ms(F.col("h"), now).alias("w")).collect()}
    assert got == hints | {None: None}
    long = df.where("h = '99999'").select(backoff.retry_after_ms(F.col("h"), now, True)).first()[0]
    assert long == 21_600_000
    steps = spark.createDataFrame([(9, 0.0), (3, 0.0), (2, 1.0), (1, -1.0), (0, 0.0)], "left int, j double")
    assert [r[0] for r in steps.select(backoff.backoff_ms(F.lit(None).cast("string"), F.col("left"), now, F.col("j"))).collect()] == [2000, 2000, 5000, 6000, 8000]


def test_rate_limit_headers(spark):
    heads = {"X-RateLimit-Remaining-Requests": "12", "anthropic-ratelimit-requests-remaining": "99", "x-ratelimit-limit": "100", "anthropic-ratelimit-tokens-remaining": "-1", "x-ratelimit-reset": "1h2m3.5s", "x-ratelimit-reset-tokens": "500ms", "Retry-After": "7"}
    df = spark.createDataFrame([(heads,), ({},)], "h map<string,string>")
    got = df.select(*[c.alias(k) for k, c in backoff.rate_limits(F.col("h"), F.current_timestamp()).items()]).collect()
    assert got[0].asDict() == {"remaining_requests": 12.0, "remaining_tokens": None, "limit_requests": 100.0, "limit_tokens": None, "reset_requests_ms": 3_723_500, "reset_tokens_ms": 500, "retry_after_ms": 7000}
    assert set(got[1].asDict().values()) == {None}
    spent = spark.createDataFrame([(402, "Your BALANCE is low"), (429, "余额不足"), (429, "slow down"), (500, "billing"), (None, "billing"), (403, None)], "s int, b string")
    assert [r[0] for r in spent.select(backoff.account_spent(F.col("s"), F.col("b"))).collect()] == [True, True, False, False, False, False]


def test_knowledge_is_capped_and_checked():
    long = "x" * 90
    reply = {"microSummary": "m" * 200, "topics": [{"title": f"Topic {k}", "content": f" {long} "} for k in range(6)], "concepts": [{"title": "C", "content": long}, {"title": "Co", "content": "short"}, "no", {"title": 3, "content": long}], "claims": [{"title": "Claim", "content": long, "confidence": c} for c in (2, None)]}
    got = loose_json.knowledge("Here it is:\n```json\n" + json.dumps(reply) + "\n```")
    assert len(got["micro_summary"]) == 120 and [t["title"] for t in got["topics"]] == ["Topic 0", "Topic 1", "Topic 2"]
    assert got["concepts"] == [] and [c["confidence"] for c in got["claims"]] == [1.0, 0.7] and got["topics"][0]["content"] == long
    assert loose_json.knowledge("nothing") is None and loose_json.knowledge("[1]") is None


def test_diagrams(spark):
    df = spark.createDataFrame([("A Data  flow", None), ("plain", ""), ("图", "包含一张图"), ("Please include an architecture diagram", None), (None, None)], "a string, b string")
    t = diagrams.section_text(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(diagrams.needs_diagram(t), diagrams.diagram_type(t)).collect()] == [(False, "data-flow"), (False, "architecture"), (True, "architecture"), (True, "architecture"), (False, "architecture")]


def test_created_and_edited_entities(spark):
    nodes = spark.createDataFrame([("a", "t", "d", "s"), ("b", "t", "d", "s")], "id string, entity_type string, description string, source_id string")
    new = spark.createDataFrame([("a", "x", "y"), (" c ", "x", "y"), ("c", "z", "y"), (" ", "x", "y"), (None, "x", "y")], "id string, entity_type string, description string")
    more, refused = graph.create_entities(nodes, new)
    assert sorted(r.id for r in more.collect()) == ["a", "b", "c"] and sorted((r.id or "", r.error) for r in refused.collect()) == [("", "empty"), ("", "empty"), ("a", "exists"), ("c", "exists")]
    edits = spark.createDataFrame([("a", "description", "one", 1), ("a", "description", "two", 2), ("b", "entity_type", None, 1), ("c", "degree", "9", 1), ("zz", "description", "x", 1)], "id string, field string, value string, seq int")
    out, wrong = graph.edit_entities(more, edits)
    assert {r.id: (r.entity_type, r.description) for r in out.collect()} == {"a": ("t", "two"), "b": (None, "d"), "c": ("x", "y")}
    assert sorted(tuple(r) for r in wrong.collect()) == [("c", "degree", "field"), ("zz", "description", "missing")]


def test_evidence_falls_back_to_semantic_search(spark):
    chunks = spark.createDataFrame([("d", 1, "t", "about gamma rays", [1.0, 0.0]), ("d", 2, "t", "nothing", [0.0, 1.0])], "doc_id string, chunk_id long, title string, content string, embedding array<double>")
    nodes = spark.createDataFrame([("Beta", ["d/2"])], "name string, chunk_ids array<string>")
    docs = spark.createDataFrame([("d", "Doc")], "doc_id string, name string")
    known = search.entity_or_semantic(nodes, chunks, docs, "beta").collect()
    assert [(r.chunk_id, r.source, r.score) for r in known] == [("d/2", "entity_lookup", 1.0)]
    found = search.entity_or_semantic(nodes, chunks, docs, "gamma", [1.0, 0.0]).collect()
    assert found[0].chunk_id == "d/1" and {r.source for r in found} == {"semantic"} and found[0].document_name == "Doc"
