"""Model output validation (H10, H11, H12, C3, E4) and webhook handling."""

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from feedmine.functions.hmac import hmac_sha256_hex
from feedmine.operators import events as ev
from feedmine.operators import model as md
from feedmine.operators import validate as va

GOOD = {"category": "testing", "original_issue": "i", "requested_change": "c", "rationale": "r",
        "severity": "nitpick", "implemented": True, "include_in_vector_store": True,
        "selection_rationale": "s", "implementation_example": "e", "architecture_change": False,
        "supersedes_prior_architecture": False}


def _errors(spark, item):
    df = spark.createDataFrame([(json.dumps(item),)], "j string")
    return df.select(va.item_errors(F.parse_json("j")).alias("e")).first()["e"]


def test_valid_item_has_no_errors(spark):
    assert _errors(spark, GOOD) == []


def test_item_checks(spark):
    missing = {k: v for k, v in GOOD.items() if k != "rationale"}
    assert _errors(spark, missing) == ["lacks: rationale"]
    assert "implemented: true or false expected" in _errors(spark, {**GOOD, "implemented": "true"})
    assert "kept for the index though not implemented" in _errors(spark, {**GOOD, "implemented": False})
    assert "kept for the index without an example" in _errors(
        spark, {**GOOD, "implementation_example": "  "})
    assert "supersedes without an architecture change" in _errors(
        spark, {**GOOD, "supersedes_prior_architecture": True})
    assert "unknown severity 'critical'" in _errors(spark, {**GOOD, "severity": "critical"})
    assert "rationale: text expected" in _errors(spark, {**GOOD, "rationale": None})
    assert _errors(spark, [1]) == ["not an object"]


def test_pairing_never_truncates_and_first_valid_attempt_wins(spark):
    batches = spark.createDataFrame([(0, 2), (1, 1)], "batch_id long, n_items long")
    resp = spark.createDataFrame([
        (0, 1, json.dumps({"items": [GOOD]})),
        (0, 2, json.dumps({"items": [GOOD, GOOD]})),
        (1, 1, json.dumps({"items": [{**GOOD, "category": "nope"}]})),
        (1, 2, json.dumps({"items": {"a": 1}})),
    ], "batch_id long, attempt int, text string")
    parsed = resp.select("batch_id", "attempt", F.try_parse_json("text").alias("obj"),
                         F.lit(None).cast("string").alias("error"))
    items, rejects = va.pair_items(batches, parsed)
    reasons = {(r["batch_id"], r["attempt"]): r["reason"] for r in rejects.collect()}
    assert reasons[(0, 1)] == "got 1 items, expected 2"
    assert reasons[(1, 2)] == "no list of items in the answer"
    accepted, failed = va.accept_attempts(va.attempt_status(items, rejects), 3)
    assert [(r["batch_id"], r["attempt"]) for r in accepted.collect()] == [(0, 2)]
    assert [r["batch_id"] for r in failed.collect()] == [1]


def test_response_text_modes(spark):
    env = {"output": [{"type": "reasoning"}, {"type": "message", "content": [
        {"type": "output_text", "text": '{"a"'}, {"type": "refusal", "text": "x"},
        {"type": "output_text", "text": ": 1}"}]}]}
    chat = {"choices": [{"message": {"content": "[1]"}}]}
    df = spark.createDataFrame([(json.dumps(env), json.dumps(chat))], "r string, c string")
    o1, e1 = md.response_object(F.col("r"), "responses")
    o2, e2 = md.response_object(F.col("c"), "chat")
    row = df.select(o1.isNotNull().alias("ok1"), e1.alias("e1"), e2.alias("e2")).first()
    assert row["ok1"] and row["e1"] is None and row["e2"] == "model answer is no JSON object"


def test_hmac_equals_library(spark):
    body = b'{"zen": "Keep it logically awesome."}\xe2\x9c\x93'
    df = spark.createDataFrame([(bytearray(body),)], "b binary")
    got = df.select(hmac_sha256_hex("It's a Secret to Everybody", F.col("b"))).first()[0]
    assert got == hmac.new(b"It's a Secret to Everybody", body, hashlib.sha256).hexdigest()


def _envelope(payload, event, secret="s", delivery="d1", sign=True, b64=False):
    body = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
    sig = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    headers = {"X-GitHub-Delivery": delivery, "X-GitHub-Event": event}
    if sign:
        headers["X-Hub-Signature-256"] = sig
    text = base64.b64encode(body).decode() if b64 else body.decode()
    return (text, b64, headers)


def test_routing_rules(spark):
    repo = {"full_name": "o/r"}
    cases = [
        _envelope({"action": "opened", "number": 5, "pull_request": {"number": 5}, "repository": repo}, "pull_request"),
        _envelope({"action": "edited", "pull_request": {"number": 6}, "repository": repo}, "pull_request", b64=True),
        _envelope({"action": "created", "issue": {"number": 7}, "repository": repo}, "issue_comment"),
        _envelope({"action": "created", "issue": {"number": 8, "pull_request": {"url": "u"}}, "repository": repo},
                  "issue_comment"),
        _envelope({"action": "opened", "pull_request": {"number": 12.0}, "repository": repo}, "pull_request"),
        _envelope({"action": "opened", "pull_request": {"number": True}, "repository": repo}, "pull_request"),
        _envelope({"action": "opened", "number": 5, "repository": repo}, "pull_request", sign=False),
        _envelope({"action": "labeled", "number": 5, "repository": repo}, "pull_request"),
        _envelope(b"{not json", "pull_request"),
        _envelope({"action": "opened", "number": 5, "repository": repo}, "pull_request", delivery=""),
    ]
    df = spark.createDataFrame(cases, "body string, isBase64Encoded boolean, headers map<string,string>") \
        .withColumn("i", F.monotonically_increasing_id())
    out = ev.route_deliveries(df, "s").orderBy("i").collect()
    got = [(r["status"], r["work_type"], r["pr_number"]) for r in out]
    assert got == [(202, "review", 5), (202, "mining", 6), (202, None, None), (202, "mining", 8),
                   (400, None, None), (400, None, None), (401, None, None), (202, None, None),
                   (400, None, None), (400, None, None)]


def test_job_predicate_order(spark):
    jobs = spark.createDataFrame([(1, "a", "review", "O/R"), (2, "b", "mining", "o/r"), (1, "c", "review", "x/y"),
                                  (1, "d", "review", "o/r"), (1, "e", "mining", "o/r")],
                                 "version int, delivery_id string, work_type string, repo string")
    receipts = spark.createDataFrame([("d", "COMPLETED")], "delivery_id string, state string")
    got = {r["delivery_id"]: r["decision"] for r in ev.valid_jobs(jobs, "o/r", ["mining"], receipts).collect()}
    assert got == {"a": "fail", "b": "fail", "c": "fail", "d": "skip", "e": "dispatch"}


def test_transient_markers(spark):
    df = spark.createDataFrame([("unexpected EOF",), ("GEOFENCE",), ("HTTP 404",), (None,)], "e string")
    assert [r[0] for r in df.select(ev.is_transient(F.col("e"))).collect()] == [True, True, False, False]
