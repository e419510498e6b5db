"""Contracts of results and requests on small cases, each rule against what it is for."""

import copy
import json

import pytest

from lodestone.operators import contracts, jobs

ATTEMPTS = [
    {"operation": "semantic_retrieval", "tier": "p40-retrieval", "status": "succeeded", "gpu_count": 1, "model_profile": "m", "slurm_job_id": "1"},
    {"operation": "rerank", "tier": "p40-retrieval", "status": "succeeded", "gpu_count": 1, "model_profile": "m", "slurm_job_id": "2"},
    {"operation": "synthesis", "tier": "p40-synthesis", "status": "failed", "gpu_count": 1},
    {"operation": "synthesis", "tier": "v100-reasoning", "status": "succeeded", "gpu_count": 4, "model_profile": "m", "slurm_job_id": "3"},
]
GOOD = {
    "schema_name": "repo_inspection_v2",
    "schema_version": "2.0.0",
    "payload": {
        "mode": "answer",
        "query": " where is it ",
        "quality": {"result": "answer_ready", "retrieval": "gpu", "reranking": "gpu", "synthesis": "gpu", "answer_ready": True},
        "answer": "there",
        "findings": [{"evidence_refs": ["ev_1", "ev_2"]}],
        "evidence": [{"id": "ev_1", "source_refs": ["a"]}, {"id": "ev_2", "source_refs": ["b"]}],
        "retrieval": {},
        "runtime": {"attempts": ATTEMPTS},
        "warnings": [],
        "provenance": {},
    },
}


def changed(path: str, value=None, drop: bool = False):
    out = copy.deepcopy(GOOD)
    at = out
    *way, last = path.split(".")
    for step in way:
        at = at[int(step)] if step.isdigit() else at[step]
    if drop:
        del at[last]
    else:
        at[int(last) if last.isdigit() else last] = value
    return out


def unanswered(**quality):
    out = changed("payload.answer", drop=True)
    out["payload"]["findings"] = []
    out["payload"]["quality"] = {"result": "evidence_only", "retrieval": "gpu", "reranking": "gpu", "synthesis": "not_requested", "answer_ready": False} | quality
    return out


RESULTS = {
    "good": (GOOD, [], [], (2, 0, 0)),
    "version": (changed("schema_version", 2), ["schema_version"], [], (2, 0, 0)),
    "query": (changed("payload.query", "other"), ["query"], [], (2, 0, 0)),
    "ready is a text": (changed("payload.quality.answer_ready", "true"), ["answer_not_ready", "quality_answer_ready"], [], (2, 0, 0)),
    "findings are a text": (changed("payload.findings", "none"), ["findings", "no_findings"], [], (0, 0, 1)),
    "bare and wrong findings": (changed("payload.findings", [{}, {"evidence_refs": ["ev_9", "", "ev_1"]}]), [], [], (1, 1, 1)),
    "too much evidence": (changed("payload.evidence", [{"id": f"ev_{i}", "source_refs": ["a"]} for i in range(13)]), ["evidence_limit"], [], (2, 0, 0)),
    "evidence without ids, repeated, without sources": (changed("payload.evidence", [{"source_refs": ["a"]}, {"id": "ev_1", "source_refs": []}, {"id": "ev_1", "source_refs": ["a"]}, 5]), ["evidence_id", "evidence_repeats", "evidence_sources"], [], (1, 1, 0)),
    "blank answer": (changed("payload.answer", " "), ["answer_mode_unanswered", "answer_not_omitted", "answer_text", "evidence_only_expected", "findings_without_answer"], [], (0, 0, 0)),
    "answer is null": (changed("payload.answer", None), ["answer_mode_unanswered", "answer_not_omitted", "answer_text", "evidence_only_expected", "findings_without_answer"], [], (0, 0, 0)),
    "V100 first": (changed("payload.runtime.attempts.2.tier", "a100-single"), ["a100_before_v100", "v100_before_p40"], ["a100_before_v100[2]", "v100_before_p40[3]"], (2, 0, 0)),
    "GPUs of a success": (changed("payload.runtime.attempts.3.gpu_count", 1), ["synthesis_gpu_count"], ["tier_gpu_count[3]"], (2, 0, 0)),
    "half a GPU, an attempt that is a text": (changed("payload.runtime.attempts.2", "x"), ["v100_before_p40"], ["object[2]", "v100_before_p40[3]"], (2, 0, 0)),
    "no rerank": (changed("payload.runtime.attempts.1.status", "degraded"), ["missing_success"], [], (2, 0, 0)),
    "no model": (changed("payload.runtime.attempts.0.model_profile", " "), ["semantic_retrieval_model"], [], (2, 0, 0)),
    "order": (changed("payload.runtime.attempts", [ATTEMPTS[1], ATTEMPTS[0], *ATTEMPTS[2:]]), ["success_order"], [], (2, 0, 0)),
    "failed": (unanswered(result="failed"), [], [], (0, 0, 0)),
    "failed but ready": (unanswered(result="failed", answer_ready=True), ["failed_but_ready"], [], (0, 0, 0)),
    "answer mode without an answer": (unanswered(), ["answer_mode_unanswered"], [], (0, 0, 0)),
}


def test_each_rule_of_a_result(spark):
    rows = spark.createDataFrame([(k, json.dumps(v[0]), "answer", "where is it") for k, v in RESULTS.items()], "k string, result string, mode string, query string")
    for r in contracts.checked_results(rows).collect():
        _, errors, attempts, cites = RESULTS[r.k]
        assert r.errors == sorted(errors), r.k
        assert r.attempt_errors == attempts, r.k
        assert (r.valid_citations, r.invalid_citations, r.missing_references) == cites, r.k


@pytest.mark.parametrize("text", [None, "", "no json", "[]", "5", "null", "{}"])
def test_what_is_no_result_breaks_the_rules_that_need_a_value(spark, text):
    r = contracts.checked_results(spark.createDataFrame([(text, "auto", "q")], "result string, mode string, query string")).first()
    assert {"schema_name", "mode", "query", "quality_result", "evidence", "runtime"} <= set(r.errors)
    assert r.attempt_errors == [] and r.valid_citations == 0


def test_columns_stay_and_empty_tables_too(spark):
    rows = spark.createDataFrame([], "result string, mode string, query string, id long")
    got = contracts.checked_results(rows)
    assert got.count() == 0 and got.columns[:4] == ["result", "mode", "query", "id"]


REQUESTS = [
    ({"task_type": "inspect_repo", "output_schema": {"name": "repo_inspection_v2"}, "task_params": {"query": "q"}, "constraints": {}}, [], []),
    ({"task_type": "rag_compress", "constraints": {"max_runtime_seconds": 86401}}, ["runtime"], ["runtime"]),
    ({"task_type": "rag_compress", "constraints": {"max_runtime_seconds": 86400}}, [], []),
    ({"task_type": "inspect_repo", "output_schema": {"name": "x"}, "task_params": {"query": " ", "mode": "fast", "GPU_Services ": 1}, "constraints": {"retrieval_token_budget": -1}}, ["output_schema", "query_required", "mode", "reserved_key", "retrieval_token_budget"], []),
    ({"task_type": "inspect_repo", "output_schema": {"name": "repo_inspection_v2"}, "task_params": {"query": "é" * 1025}, "constraints": {"final_pack_token_budget": 0, "final_evidence_pack_budget": 2047}}, ["query_bytes", "final_pack_least"], ["final_pack_least"]),
    ({"task_type": "inspect_repo", "output_schema": {"name": "repo_inspection_v2"}, "task_params": {"query": "é" * 1024, "mode": " ANSWER"}, "constraints": {"final_pack_token_budget": 4095}}, ["final_pack_least"], ["final_pack_least"]),
]


def test_each_rule_of_a_request(spark):
    rows = spark.createDataFrame([(i, json.dumps(r[0])) for i, r in enumerate(REQUESTS)] + [(99, None), (98, "[]")], "i int, request string")
    got = {r.i: (r.errors, r.worker_errors) for r in contracts.checked_requests(rows).collect()}
    assert [got[i] for i in range(len(REQUESTS))] == [(r[1], r[2]) for r in REQUESTS]
    assert got[99] == got[98] == ([], [])


def test_a_running_job_counts_once_however_many_nodes_its_list_names(spark):
    nodes = spark.createDataFrame([("p", "n01", "idle"), ("p", "n02", "mixed"), ("p", "n03", "down"), ("q", "n09", "idle")], "partition string, node string, state string")
    queue = spark.createDataFrame([(1, "p", "running", "n[01-03]"), (2, "p", "running", "n03"), (3, "p", "pending", "(null)"), (4, "p", "running", " "), (5, "p", "running", "x,n02"), (6, "p", "running", None), (7, "p", "running", "n[a-b]")], "job_id int, partition string, state string, nodes string")
    got = {r.partition: (r.pending, r.running, r.score) for r in jobs.placement(nodes, jobs.queue_on_nodes(queue, nodes)).collect()}
    assert got == {"p": (1, 2, 105), "q": (0, 0, 100)}
