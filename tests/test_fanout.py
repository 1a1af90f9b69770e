import hashlib
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from arborlens.functions import paths
from arborlens.operators import fanout

BLOCKS = "project string, section int, block bigint, text string"


def test_model_names(column_values):
    cases = {" a/b, ,c,c ": ["a/b", "c", "c"], "": [], "\t x \n": ["x"], "a": ["a"]}
    got = column_values("m string", [(c,) for c in cases], fanout.parse_models(F.col("m")))
    assert got == list(cases.values())
    m = F.col("m")
    names = [("anthropic/a-4.6",), ("local",), ("a--b",)]
    got = column_values("m string", names, paths.model_key(m), paths.model_from_key(paths.model_key(m)), paths.provider(m))
    assert got == [("anthropic--a-4.6", "anthropic/a-4.6", "anthropic"), ("local", "local", "unknown"), ("a--b", "a/b", "unknown")]


def test_requests(spark):
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    rows = fanout.fan_out(projects, ["google/x", "a/y", "a/y"], max_tokens=128000, reasoning_effort="none").collect()
    assert len(rows) == 6
    by_pos = {(r.project, r.pos): r for r in rows}
    assert (by_pos["p", 0].max_tokens, by_pos["p", 1].max_tokens) == (65536, 128000)
    assert by_pos["q", 2].model == "a/y" and by_pos["q", 2].effort is None and not by_pos["q", 2].json_mode
    small = fanout.fan_out(projects, ["google/x"], max_tokens=100, reasoning_effort="xhigh", response_format="json").first()
    assert (small.max_tokens, small.effort, small.json_mode) == (100, "xhigh", True)
    table = spark.createDataFrame([("q", 0, "m/1"), ("q", 1, "m/2")], "project string, pos int, model string")
    assert sorted(r.model for r in fanout.fan_out(projects, table).collect()) == ["m/1", "m/2"]


def test_prompt_and_payload(spark, tmp_path):
    assert fanout.load_prompt(spark) == fanout.DEFAULT_PROMPT
    (tmp_path / "prompt.md").write_text("Look.\nNow.")
    assert fanout.load_prompt(spark, str(tmp_path / "prompt.md")) == "Look.\nNow."
    with pytest.raises(Exception):
        fanout.load_prompt(spark, str(tmp_path / "none.md"))
    blocks = spark.createDataFrame([("p", 0, 0, "fl"), ("p", 4, 0, "at"), ("q", 0, 0, "")], BLOCKS)
    payloads = fanout.build_payloads(blocks, "Look.")
    rows = payloads.where("project = 'p'").orderBy("section", "block").collect()
    assert [r.text for r in rows] == ["Look.\n\n", "fl", "at"]
    assert {r.project: r.payload_chars for r in fanout.payload_sizes(payloads).collect()} == {"p": 11, "q": 7}


# The client below travels to the tasks with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def client():
    def answer(request):
        kind = request["model"]
        if kind == "slow":
            raise TimeoutError
        if kind == "broken":
            raise RuntimeError("boom")
        if kind == "bare":
            return {"content": None}
        if kind == "digest":
            seen = hashlib.md5()
            for block in request["payload"]:
                seen.update(block.encode())
            return {"content": seen.hexdigest()}
        if kind == "half":
            return {"content": next(request["payload"])}
        return {
            "content": '{"consultation": "ok"}' if kind == "json" else "".join(request["payload"]).upper(),
            "finish_reason": "stop", "id": "g1", "prompt_tokens": request["max_tokens"], "completion_tokens": request["timeout"],
        }

    return answer


@pytest.mark.parametrize("max_concurrent", [1, 4, None])
def test_outcomes(spark, max_concurrent):
    payloads = spark.createDataFrame([("p", 4, 10, "c"), ("p", 0, 0, "a"), ("p", 4, 9, "b")], BLOCKS)
    projects = spark.createDataFrame([("p", 3), ("none", 0)], "project string, payload_chars bigint")
    requests = fanout.fan_out(projects, ["ok", "json", "bare", "slow", "broken"], 7, response_format="json")
    answers = fanout.dispatch(requests, payloads, client, timeout=9, max_concurrent=max_concurrent)
    assert "payload" not in answers.columns
    rows = {(r.project, r.model): r for r in answers.collect()}
    assert len(rows) == 10
    good = rows["p", "ok"]
    assert (good.status, good.raw_response, good.finish_reason, good.generation_id) == ("complete", "ABC", "stop", "g1")
    assert (good.tokens_prompt, good.tokens_completion, good.error, good.report) == (7, 9, None, None)
    assert good.cost_usd == 0.0 and good.latency_ms >= 0 and good.provider == "unknown"
    assert rows["p", "json"].report.consultation == "ok" and rows["p", "json"].report.key_concerns == []
    bare = rows["p", "bare"]
    assert (bare.status, bare.raw_response, bare.finish_reason, bare.generation_id) == ("complete", "", "unknown", "")
    slow, broken = rows["p", "slow"], rows["p", "broken"]
    assert (slow.status, slow.finish_reason, slow.error) == ("timeout", "timeout", "Timed out after 9s")
    assert (broken.status, broken.finish_reason, broken.error, broken.raw_response) == ("failed", "error", "boom", "")
    # A request without any block is sent as it is.
    assert (rows["none", "ok"].status, rows["none", "ok"].raw_response) == ("complete", "")


def test_a_payload_of_any_length_is_streamed(spark):
    """Seventeen million characters, read whole, in part and twice by a repeated model."""
    blocks = spark.range(17).selectExpr(
        "'p' AS project", "4 AS section", "id AS block", "repeat(chr(97 + cast(id AS int)), 1000000) AS text"
    )
    sizes = fanout.payload_sizes(blocks)
    assert sizes.first().payload_chars == 17_000_000
    models = ["half", "digest", "bare", "digest"]
    rows = fanout.dispatch(fanout.fan_out(sizes, models), blocks, client, max_concurrent=1).collect()
    whole = hashlib.md5("".join(chr(97 + n) * 1_000_000 for n in range(17)).encode()).hexdigest()
    by_pos = {r.pos: r for r in rows}
    assert {r.status for r in rows} == {"complete"} and sorted(by_pos) == [0, 1, 2, 3]
    assert by_pos[1].raw_response == by_pos[3].raw_response == whole
    assert by_pos[0].raw_response == "a" * 1_000_000


def test_a_call_past_its_limit_is_given_up():
    import time

    def slow(request):
        time.sleep(1)
        late.extend(request["payload"])
        return {"content": "late"}

    late, started = [], time.monotonic()
    row = fanout._outcome(slow, {}, iter("x"), 0.2)
    assert (row["status"], row["finish_reason"]) == ("timeout", "timeout") and time.monotonic() - started < 0.9
    time.sleep(1.2)
    assert late == []  # it reads nothing that belongs to the next request


def test_an_empty_prompt_file(spark, tmp_path):
    (tmp_path / "prompt.txt").write_text("")
    assert fanout.load_prompt(spark, str(tmp_path / "prompt.txt")) == ""


def counting_client(folder, stop_after=None):
    """Notes every call; ends its process, as a lost executor does, after ``stop_after`` answers."""

    def make():
        import os
        import uuid

        from pyspark import TaskContext

        def answer(request):
            if stop_after is not None and len(os.listdir(folder)) >= stop_after:
                os._exit(9)
            if request["model"] == "broken":
                raise RuntimeError("boom")
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(f"{request['project']} {request['pos']}")
            return {"content": str(TaskContext.get().partitionId()), "prompt_tokens": sum(map(len, request["payload"]))}

        return answer

    return make


def test_a_killed_job_asks_no_answered_request_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    blocks = spark.createDataFrame([(f"p{i}", 4, 0, "x" * i) for i in range(1, 9)], BLOCKS)
    requests = fanout.fan_out(fanout.payload_sizes(blocks), ["a", "b", "broken", "a"])
    ledger = str(tmp_path / "ledger")

    def send(make):
        return fanout.dispatch(requests, blocks, make, max_concurrent=2, ledger=ledger).collect()

    with pytest.raises(Exception):
        send(counting_client(str(calls), stop_after=9))
    before = len(list(calls.iterdir()))
    assert 9 <= before < 24
    rows = send(counting_client(str(calls)))
    noted = sorted(f.read_text() for f in calls.iterdir())
    assert noted == sorted(f"p{i} {pos}" for i in range(1, 9) for pos in (0, 1, 3))  # each once
    assert len(rows) == 32 and sorted(r.status for r in rows) == ["complete"] * 24 + ["failed"] * 8
    assert {(r.project, r.tokens_prompt) for r in rows if r.status == "complete"} == {(f"p{i}", i) for i in range(1, 9)}
    assert len(send(counting_client(str(calls)))) == 32 and len(list(calls.iterdir())) == 24


def test_requests_of_a_large_payload_are_tasks_of_their_own(spark, tmp_path):
    rows = [("hot", 4, b, "x" * 100) for b in range(50)] + [(f"p{i}", 4, 0, "y") for i in range(20)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    requests = fanout.fan_out(fanout.payload_sizes(blocks), [f"m{i}" for i in range(6)])
    make = counting_client(str(tmp_path))
    for limit, tasks in ((1000, 6), (10**6, 1)):
        found = fanout.dispatch(requests, blocks, make, max_concurrent=8, split_chars=limit).collect()
        assert len(found) == 126 and {r.tokens_prompt for r in found if r.project == "hot"} == {5000}
        assert len({r.raw_response for r in found if r.project == "hot"}) == tasks


def test_a_task_reads_one_large_payload_only(spark):
    """Large payloads of several projects, more requests than cores: none shares a task with another one."""
    blocks = spark.createDataFrame([(f"p{i}", 4, b, "x" * 100) for i in range(5) for b in range(20)], BLOCKS)
    requests = fanout.fan_out(fanout.payload_sizes(blocks), [f"m{i}" for i in range(6)])

    def make():
        from pyspark import TaskContext

        return lambda request: {"content": str(TaskContext.get().partitionId()), "prompt_tokens": sum(map(len, request["payload"]))}

    found = fanout.dispatch(requests, blocks, make, split_chars=1000).collect()
    assert {r.tokens_prompt for r in found} == {2000} and len({r.raw_response for r in found}) == len(found) == 30
    # A limit on the calls holds, and its tasks have equal shares.
    shares = {}
    for r in fanout.dispatch(requests, blocks, make, max_concurrent=3, split_chars=1000).collect():
        shares[r.raw_response] = shares.get(r.raw_response, 0) + 1
    assert sorted(shares.values()) == [10, 10, 10]


def test_texts_of_a_payload_are_no_side_that_a_join_holds(spark, tmp_path):
    """An outer join by project would keep all texts of a project in memory at once."""
    rows = [("p", 4, b, "x" * 100) for b in range(50)] + [("q", 0, 0, "y"), ("gone", 0, 0, "z")]
    spark.createDataFrame(rows, BLOCKS).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    projects = spark.createDataFrame([("p", 5000), ("q", 1), ("none", 0)], "project string, payload_chars bigint")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in ("-1", threshold):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            answers = fanout.dispatch(fanout.fan_out(projects, ["ok", "digest"]), blocks, client, split_chars=1000)
            plan = answers._jdf.queryExecution().executedPlan().toString()
            assert "Outer" not in plan and plan.count("blocks]") == 1 and ("SortMergeJoin" in plan) == (most == "-1")
            found = {(r.project, r.model): r.raw_response for r in answers.collect()}
            assert len(found) == 6 and (found["p", "ok"], found["q", "ok"], found["none", "ok"]) == ("X" * 5000, "Y", "")
            assert found["none", "digest"] == hashlib.md5(b"").hexdigest()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
