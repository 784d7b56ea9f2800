"""Runs that stop and go on, a pool of requests against a local endpoint, and counts that cost no second pass."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from casebook.operators import extraction, runs


def reports(spark, n):
    answer = F.when(F.col("id") % 4 == 0, "no record").otherwise(F.to_json(F.struct(F.concat(F.lit("d"), "id").alias("primary_diagnosis"))))
    return spark.range(n).select(F.col("id").alias("report_index"), F.col("id").alias("case_id"), answer.alias("text"))


class Counted(extraction.Backend):
    """Echo that counts its prompts, and dies on one."""

    def __init__(self, seen, fatal=None):
        self.seen, self.fatal = seen, fatal

    def generate(self, prompt, schema=None):
        self.seen.add(1)
        if self.fatal and self.fatal in prompt:
            raise SystemExit("the worker is lost")  # no Exception: the task fails
        return prompt


def test_a_run_that_stops_goes_on_with_what_is_left(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/run", spark.sparkContext.accumulator(0)
    assert runs.resume(reports(spark, 200), "{input_text}", Counted(seen), folder, size=40, most=2) == 2
    half = seen.value
    assert 0 < half < 200 and runs.answers(spark, folder).count() == half
    assert runs.resume(reports(spark, 200), "{input_text}", Counted(seen), folder, size=40) >= 3
    assert seen.value == 200 and runs.resume(reports(spark, 200), "{input_text}", Counted(seen), folder) == 0
    done = runs.answers(spark, folder)
    assert sorted(r["report_index"] for r in done.select("report_index").collect()) == list(range(200))
    assert runs.publish(spark, folder, f"{folder}/out") == {"n_good": 150, "n_broken": 50}
    assert spark.read.json(f"{folder}/out/predictions").count() == 150 and spark.read.json(f"{folder}/out/broken").count() == 50
    # more reports arrive
    runs.resume(reports(spark, 230), "{input_text}", Counted(seen), folder, size=1000)
    assert seen.value == 230 and runs.answers(spark, folder).count() == 230


def test_a_batch_that_fails_is_the_only_one_asked_again(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/run", spark.sparkContext.accumulator(0)
    with pytest.raises(Exception):  # noqa: B017
        runs.resume(reports(spark, 100), "{input_text}", Counted(seen, '"d61"'), folder, size=20)
    done = runs.answers(spark, folder)
    before = set() if done is None else {r["report_index"] for r in done.collect()}
    assert 61 not in before
    again = spark.sparkContext.accumulator(0)
    runs.resume(reports(spark, 100), "{input_text}", Counted(again), folder, size=20)
    assert again.value == 100 - len(before)
    found = [r["report_index"] for r in runs.answers(spark, folder).collect()]
    assert sorted(found) == list(range(100))


def test_leftovers_of_a_batch_without_a_commit_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    model = extraction.Echo()
    runs.resume(reports(spark, 20), "{input_text}", model, folder, size=20)
    made = extraction.validate(extraction.generate(extraction.prompts(reports(spark, 5), "{input_text}"), model))
    extraction.stored(made, f"{folder}/answers/batch=lost-0")
    assert runs.answers(spark, folder).count() == 20
    runs.resume(reports(spark, 25), "{input_text}", model, folder)
    assert runs.answers(spark, folder).count() == 25 and not (tmp_path / "run/answers/batch=lost-0").exists()


def test_a_report_without_a_key_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="a report has no report_index"):
        runs.resume(reports(spark, 3).withColumn("report_index", F.lit(None).cast("long")), "{input_text}", extraction.Echo(), f"file://{tmp_path}/run")


def test_counts_come_with_the_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    made = extraction.validate(extraction.generate(extraction.prompts(reports(spark, 40), "{input_text}"), Counted(seen)))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    done, counts = extraction.stored(made, f"file://{tmp_path}/done")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert counts == {"n_good": 30, "n_broken": 10} and seen.value == 40 and done.count() == 40 and jobs <= 1


class Endpoint(BaseHTTPRequestHandler):
    """A chat completion endpoint that fails, stalls and cuts off by what the prompt asks for."""

    lock, tries, running, most = threading.Lock(), {}, 0, 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        cls = type(self)
        with cls.lock:
            cls.tries[prompt] = n = cls.tries.get(prompt, 0) + 1
            cls.running += 1
            cls.most = max(cls.most, cls.running)
        try:
            if prompt.startswith("slow"):
                time.sleep(0.2)
            if prompt.startswith("stall") and n == 1:
                time.sleep(1.5)
            if prompt.startswith("busy") and n < 3:
                self.send_response(503 if n == 1 else 429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if prompt.startswith("bad"):
                self.send_response(400)
                self.end_headers()
                return
            if prompt.startswith("never"):
                self.send_response(500)
                self.end_headers()
                return
            reason = "length" if prompt.startswith("long") else "stop"
            raw = json.dumps({"choices": [{"message": {"content": f"<{prompt}>"}, "finish_reason": reason}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)
        except (BrokenPipeError, ConnectionResetError):
            pass
        finally:
            with cls.lock:
                cls.running -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    Endpoint.tries, Endpoint.running, Endpoint.most = {}, 0, 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    server.shutdown()


def test_requests_run_side_by_side_and_answers_keep_their_order(endpoint):
    model = extraction.Http(endpoint, concurrency=6, pause=0.01, timeout=5)
    prompts = [f"slow {k}" for k in range(24)]
    began = time.time()
    assert list(model.answer_all(prompts)) == [(f"<{p}>", None) for p in prompts]
    assert time.time() - began < 24 * 0.2 * 0.6 and 1 < Endpoint.most <= 6


def test_what_fails_for_now_is_tried_again(endpoint):
    model = extraction.Http(endpoint, concurrency=3, retries=2, pause=0.01, timeout=0.7)
    got = list(model.answer_all(["busy", "stall", "bad", "never", "long", "fine"]))
    assert got[0] == ("<busy>", None) and Endpoint.tries["busy"] == 3
    assert got[1] == ("<stall>", None) and Endpoint.tries["stall"] == 2
    assert got[2][0] is None and "400" in got[2][1] and Endpoint.tries["bad"] == 1
    assert got[3][0] is None and "500" in got[3][1] and Endpoint.tries["never"] == 3
    assert got[4] == ("<long>", "Truncated: the answer ends at the limit of tokens")
    assert got[5] == ("<fine>", None)


def test_a_cut_answer_is_a_broken_record_with_its_text(spark, endpoint):
    rows = spark.createDataFrame([(1, 1, "long {}"), (2, 2, "fine")], "report_index long, case_id long, text string")
    done = extraction.validate(extraction.generate(extraction.prompts(rows, "{input_text}"), extraction.Http(endpoint, pause=0.01)))
    broken = {r["report_index"]: r for r in extraction.split(done)[1].collect()}
    assert broken[1]["error"].startswith("generation: Truncated") and broken[1]["raw_output"] == "<long {}>"
