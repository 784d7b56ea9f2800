"""Model calls over prompts, with good records and broken ones apart.

A backend turns prompts into answers, a decoder tells it what shape an answer must have.  Only the HTTP backend applies a
schema, at its endpoint; constrained decoding in the worker (U8, U9) is not built, and asking for it is an error.  Both are made by name.  Backends are
built once in each worker; a failing prompt costs that record only.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from casebook import schemas
from casebook.functions import payload, text


class Truncated(Exception):
    """An answer that ends at the limit of tokens instead of its own end; ``raw`` is what there is of it."""

    def __init__(self, raw: str):
        super().__init__("the answer ends at the limit of tokens")
        self.raw = raw


#: An answer, and why there is none or only a part.
Answer = tuple[str | None, str | None]


class Backend:
    """Answers prompts."""

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        raise NotImplementedError

    def answer(self, prompt: str, schema: dict | None = None) -> Answer:
        """The answer to one prompt; a failure costs no other prompt."""
        try:
            return self.generate(prompt, schema), None
        except Truncated as e:
            return e.raw, f"Truncated: {e}"
        except Exception as e:  # the record goes to the broken ones with its reason
            return None, f"{type(e).__name__}: {e}"

    def answer_all(self, prompts: Iterable[str], schema: dict | None = None) -> Iterator[Answer]:
        """Answers in the order of their prompts."""
        for prompt in prompts:
            yield self.answer(prompt, schema)


@dataclass
class Echo(Backend):
    """Gives the prompt back; for tests."""

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        return prompt


@dataclass
class Replay(Backend):
    """Gives recorded answers by prompt; an unknown prompt fails."""

    answers: dict[str, str] = field(default_factory=dict)

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        return self.answers[prompt]


#: Statuses of an endpoint that is busy or failing for now, so that the same request may succeed later.
PASSING = (408, 425, 429, 500, 502, 503, 504)


@dataclass
class Http(Backend):
    """U4: a chat completion endpoint.

    ``concurrency`` requests of a partition are under way at a time, so an endpoint gets at most that many from each running task.  What fails
    for now is tried again up to ``retries`` times, after pauses that double from ``pause`` seconds, or as long as the endpoint asks, at most ``longest_pause``.
    """

    url: str = "http://localhost:8000/v1/chat/completions"
    model: str = ""
    max_tokens: int = 2048
    timeout: float = 300.0
    temperature: float = 0.0
    concurrency: int = 8
    retries: int = 4
    pause: float = 0.5
    longest_pause: float = 30.0

    def request(self, prompt: str, schema: dict | None) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": schema.get("title", "record"), "schema": schema}}
        return body

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        choice = self._sent(json.dumps(self.request(prompt, schema)).encode())["choices"][0]
        content = choice["message"]["content"] or ""
        if choice.get("finish_reason") == "length":
            raise Truncated(content)
        return content

    def _sent(self, body: bytes) -> dict:
        for k in range(self.retries + 1):
            pause = self.pause * 2**k
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or k == self.retries:
                    raise
                asked = e.headers.get("Retry-After", "")
                pause = float(asked) if asked.isdigit() else pause
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
            time.sleep(min(pause, self.longest_pause))
        raise AssertionError("unreachable")

    def answer_all(self, prompts: Iterable[str], schema: dict | None = None) -> Iterator[Answer]:
        waiting = iter(prompts)
        with ThreadPoolExecutor(self.concurrency) as pool:
            sent = deque(pool.submit(self.answer, p, schema) for p in islice(waiting, self.concurrency))
            while sent:
                yield sent.popleft().result()
                sent.extend(pool.submit(self.answer, p, schema) for p in islice(waiting, 1))


@dataclass
class Local(Backend):
    """A text-generation pipeline in the worker, loaded when it is first used; the library may be absent."""

    model: str = ""
    max_tokens: int = 512
    temperature: float = 0.0

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        if schema:
            raise NotImplementedError("the local backend cannot decode by a schema")
        if not hasattr(self, "_pipe"):
            try:
                from transformers import pipeline
            except ImportError as e:
                raise RuntimeError("the local backend needs a text-generation library") from e
            self._pipe = pipeline("text-generation", model=self.model)
        how = {"do_sample": False} if self.temperature == 0 else {"do_sample": True, "temperature": self.temperature}
        return self._pipe(prompt, max_new_tokens=self.max_tokens, return_full_text=False, **how)[0]["generated_text"]


@dataclass
class Unavailable(Backend):
    """A name kept for a backend that cannot generate yet."""

    name: str = ""

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        raise NotImplementedError(f"backend {self.name} cannot generate")


BACKENDS = {"echo": Echo, "replay": Replay, "http": Http, "vllm": Http, "local": Local, "hf": Local, "sglang": lambda **o: Unavailable("sglang"), "ollama": lambda **o: Unavailable("ollama")}
#: The backends that apply a decoder; all but "none" ask for the record's JSON schema.  No backend applies "guidance".
DECODERS = {"none": None, "schema": ("http", "vllm"), "outlines": ("http", "vllm"), "guidance": ()}


def backend(name: str, **options) -> Backend:
    """A backend by name, without regard to case."""
    made = BACKENDS.get(name.strip().lower())
    if made is None:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return made(**options)


def decoder(name: str, backend_name: str, version: str, vocabulary: list[str] | None = None) -> dict | None:
    """The JSON schema to decode by, or none."""
    key = name.strip().lower()
    if key not in DECODERS:
        raise ValueError(f"unknown decoder {name!r}; known: {', '.join(sorted(DECODERS))}")
    only = DECODERS[key]
    if only is not None and backend_name.strip().lower() not in only:
        raise ValueError(f"decoder {key} needs one of the backends {', '.join(only) or '(none is built)'}")
    return None if key == "none" else schemas.json_schema(schemas.get(version), version, vocabulary)


def prompts(reports: DataFrame, template: str, text_col: str = "text", vocabulary: list[str] | None = None, guard: bool = False) -> DataFrame:
    """Reports with their prompt; ids are no part of it."""
    made = text.fill_template(template, F.col(text_col))
    if vocabulary:
        made = text.vocabulary_suffix(made, vocabulary)
    return reports.withColumn("prompt", text.json_only(made) if guard else made)


def generate(prompted: DataFrame, model: Backend, schema: dict | None = None) -> DataFrame:
    """Prompts with ``raw`` answers, and ``generation_error`` where the backend failed or cut an answer off."""

    @F.pandas_udf("struct<raw:string,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(model.answer_all(part, schema)), columns=["raw", "error"])

    # an answer is wanted once: a model's answers may differ from call to call
    out = prompted.withColumn("_run", run.asNondeterministic()("prompt"))
    return out.withColumns({"raw": F.col("_run.raw"), "generation_error": F.col("_run.error")}).drop("_run")


def validate(answered: DataFrame, version: str = schemas.DEFAULT, vocabulary: list[str] | None = None) -> DataFrame:
    """Answers with ``record`` and ``errors`` (``stage: reason``): payload, types, vocabulary, differential clean-up."""
    out = payload.recover(answered, "raw", "payload", "_payload_error")
    out = payload.parse(out, "payload", version, "record", "_parse_errors")
    schema = schemas.get(version)
    reasons = [F.when(F.col("generation_error").isNotNull(), F.concat(F.lit("generation: "), F.col("generation_error")))]
    reasons.append(F.when(F.col("generation_error").isNull() & F.col("_payload_error").isNotNull(), F.concat(F.lit("parse: "), F.col("_payload_error"))))
    listed = F.transform(F.when(F.col("payload").isNotNull(), F.col("_parse_errors")).otherwise(F.array().cast("array<string>")), lambda e: F.concat(F.lit("parse: "), e))
    parts = [F.array(*reasons), listed]
    if vocabulary is not None:
        values = payload.constrained_values(F.col("record"), schema)
        outside = payload.outside_vocabulary(F.coalesce(values, F.array().cast("array<struct<path:string,term:string>>")), vocabulary)
        parts.append(F.transform(outside, lambda v: F.concat(F.lit("vocabulary: "), v["path"], F.lit(" = "), v["term"])))
    out = out.withColumn("errors", F.array_compact(F.concat(*parts)))
    record = F.col("record")
    if "differential_diagnoses" in schema.names:
        cleaned = payload.differential(record["primary_diagnosis"], record["differential_diagnoses"])
        record = record.withField("differential_diagnoses", cleaned).withField("has_differential_diagnosis", F.size(cleaned) > 0)
    if "case_id" in answered.columns:
        record = record.withField("case_id", F.col("case_id").cast("long"))
    return out.withColumn("record", F.when(F.size("errors") == 0, record)).drop("_payload_error", "_parse_errors")


def outcomes(validated: DataFrame) -> DataFrame:
    """``outcome`` of every report, good or broken, with its error, in one pass."""
    broken = F.size("errors") > 0
    return validated.select("report_index", F.when(broken, "broken").otherwise("good").alias("outcome"), F.when(broken, F.array_join("errors", "; ")).alias("error"))


def stored(validated: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """``validated`` written as Parquet and read back, so that no model answers twice whatever is made of it.

    Good and broken records are counted as they are written, in the same job.
    """
    seen = Observation("records")
    counts = (F.count_if(F.size("errors") == 0).alias("n_good"), F.count_if(F.size("errors") > 0).alias("n_broken"))
    validated.observe(seen, *counts).write.mode("overwrite").parquet(path)
    return validated.sparkSession.read.schema(validated.schema).parquet(path), dict(seen.get)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and broken ones as (report_index, error, raw_output), generation failures among them.

    Both are filters of ``validated``, which should be a stored table: else each repeats the parse, and the model's work.
    """
    good = validated.where(F.size("errors") == 0)
    broken = validated.where(F.size("errors") > 0).select("report_index", F.array_join("errors", "; ").alias("error"), F.col("raw").alias("raw_output"))
    return good, broken


Handler = Callable[[DataFrame], None]


def run(reports: DataFrame, template: str, model: Backend, path: str, version: str = schemas.DEFAULT, vocabulary: list[str] | None = None, on_success: Handler | None = None, on_error: Handler | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports to records, by way of a table stored under ``path``; handlers get the good records and the broken ones.

    A handler is called once with all rows it is for, and not at all where there are none.  A run without any good record is an error, after the handlers.
    """
    done, counts = stored(validate(generate(prompts(reports, template), model), version, vocabulary), path)
    good, broken = split(done)
    if on_success and counts["n_good"]:
        on_success(good)
    if on_error and counts["n_broken"]:
        on_error(broken)
    _some_good(**counts)
    return good, broken


def tally(validated: DataFrame) -> DataFrame:
    """Counts of good and broken records."""
    return validated.agg(F.count_if(F.size("errors") == 0).alias("n_good"), F.count_if(F.size("errors") > 0).alias("n_broken"))


def require_success(counts: DataFrame) -> None:
    """A run with no good record is an error."""
    _some_good(**counts.first().asDict())


def _some_good(n_good: int, n_broken: int) -> None:
    if not n_good:
        raise RuntimeError(f"no report gave a record; {n_broken} failed")
