"""The model-backed extractor: interface, replies, failures."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix
from ..schemas import PAIRS_JSON_SCHEMA, STRUCTURED
from ..sources.zip_datasets import JS_SPACE

JSON_ATTEMPTS = 3
CONCURRENCY = 3
PROMPT_UNITS = 200_000
TIMEOUT_S = 120
RETRIES = 4
MAX_REPLY_TOKENS = 16_000
#: Statuses below 500 that pass by themselves, and seconds between attempts.
RETRIED = (408, 409, 429)
WAIT_S, MOST_WAIT_S = 0.5, 8.0


class ExtractorError(Exception):
    """A failed request: ``kind`` names what failed, ``status`` is the service's (None: no answer)."""

    def __init__(self, message: str = "", *, kind: str = "other", status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status

    def __reduce__(self):
        return _rebuilt, (str(self), self.kind, self.status)


def _rebuilt(message: str, kind: str, status: int | None) -> ExtractorError:
    return ExtractorError(message, kind=kind, status=status)


class Extractor(Protocol):
    """What turns a prompt into a reply; an instance serves one task."""

    def complete(self, prompt: str, schema: dict | None = None) -> str: ...


@dataclass(frozen=True)
class Settings:
    """Of a service, from the environment; keys stay out of data and logs."""

    model: str
    key_variable: str

    @classmethod
    def from_environment(cls, model_variable: str = "LOAMWORKS_MODEL", key_variable: str = "LOAMWORKS_API_KEY", default_model: str = "default") -> Settings:
        if not os.environ.get(key_variable):
            raise ValueError(f"{key_variable} is not set")
        return cls(os.environ.get(model_variable) or default_model, key_variable)

    def key(self) -> str:
        return os.environ[self.key_variable]


class ServiceExtractor:
    """A model service behind ``send``, which takes (request, key, seconds) and returns the service's reply as an object.

    ``send`` raises ExtractorError with the service's status, or None if there
    was no answer.  Time limits, lost connections, rate limits and the service's
    own failures are tried again, up to ``retries`` times, each after twice the
    wait.  A declined or cut-off reply is an error that only its prompt has.
    """

    def __init__(self, settings: Settings, send: Callable[[dict, str, float], dict], *, retries: int = RETRIES, timeout: float = TIMEOUT_S, sleep: Callable[[float], None] = time.sleep):
        self.settings, self.send, self.retries, self.timeout, self.sleep = settings, send, retries, timeout, sleep

    def complete(self, prompt: str, schema: dict | None = None) -> str:
        request: dict = {"model": self.settings.model, "max_tokens": MAX_REPLY_TOKENS, "messages": [{"role": "user", "content": prompt}]}
        if schema is not None:
            request["output_config"] = {"format": {"type": "json_schema", "schema": schema}}
        for attempt in range(self.retries + 1):
            try:
                reply = self.send(request, self.settings.key(), self.timeout)
                break
            except ExtractorError as e:
                if attempt == self.retries or not (e.status is None or e.status in RETRIED or e.status >= 500):
                    raise
                self.sleep(min(WAIT_S * 2**attempt, MOST_WAIT_S))
        if reply.get("stop_reason") in ("refusal", "max_tokens"):
            raise ExtractorError(kind=reply["stop_reason"])
        return "".join(part["text"] for part in reply["content"] if part["type"] == "text")


MESSAGES = {
    "timeout": "No answer within the time limit; try again later.",
    "connection": "The service can't be reached; check the connection.",
    "authentication_error": "The service rejected the API key.",
    "billing_error": "The account is out of credit.",
    "permission_error": "The API key may not use this model.",
    "not_found_error": "This model isn't available to the API key.",
    "overloaded_error": "The service is overloaded; try again later.",
    "refusal": "The model declined to process this text.",
    "max_tokens": "The reply was too long and was cut off.",
}


def describe(error: BaseException) -> str:
    """One sentence for an error."""
    return MESSAGES.get(getattr(error, "kind", ""), str(error) or type(error).__name__)


def stops_all(error: BaseException) -> bool:
    """Whether every other request would fail alike: the service's own errors below 500, or none at all."""
    return isinstance(error, ExtractorError) and error.kind not in ("refusal", "max_tokens", "invalid_json") and (error.status is None or error.status < 500)


def strip_fences(text: str) -> str:
    for pattern in (rf"^```json[{JS_SPACE}]*", rf"^```[{JS_SPACE}]*", rf"[{JS_SPACE}]*```$"):
        text = re.sub(pattern, "", text, count=1, flags=re.M)
    return text.strip(JS_SPACE)


def _refuse(name: str) -> None:
    raise ValueError(name)


def ask_for_json(extractor: Extractor, prompt: str, schema: dict | None = None) -> object:
    """The reply as JSON; one that isn't is asked for again, JSON_ATTEMPTS times in all."""
    for attempt in range(1, JSON_ATTEMPTS + 1):
        reply = extractor.complete(prompt, schema)
        try:
            return json.loads(strip_fences(reply), parse_constant=_refuse)
        except ValueError:
            if attempt == JSON_ATTEMPTS:
                raise ExtractorError("The reply was not valid JSON in any attempt.", kind="invalid_json") from None
    raise AssertionError


PAIRS_PROMPT = """Below is a passage. Turn what it teaches into instruction and output pairs for training a model: up to six, none if it teaches nothing.
A reader of a pair has never seen the passage, so both sides have to stand alone, name what they are about, and say nothing that the passage doesn't.
Write in the passage's own language. Let the six differ in what they ask for and in how they ask.

Passage:
"""

_SHAPE = """Reply with one JSON object and nothing around it, with exactly these fields in this order: {fields}.
"""
_REJECT = """If the document is not of that kind, reply only with {{"error": "<why>"}}.
"""
MODE_PROMPTS = {
    "knowledge-base": "Extract the knowledge that this document holds.\n" + _SHAPE,
    "academic-research": "Extract the research data of this academic paper.\n" + _REJECT + _SHAPE,
    "student-summary": "Explain this document to a student of sixteen who is new to the subject, in short plain sentences, with six key points at most.\n" + _SHAPE,
    "analytics": "Extract the most important figures of this document and what they mean: at most 20 key metrics, 8 entries in every other list, 5 data sets.\n" + _REJECT + _SHAPE,
}


def pairs_prompt(passage: Column) -> Column:
    return F.concat(F.lit(PAIRS_PROMPT), passage)


def mode_prompt(mode: str, text: Column) -> Column:
    """The prompt of a structured mode: at most PROMPT_UNITS of the text."""
    if mode not in MODE_PROMPTS:
        raise ValueError(f"Unknown output type: {mode}")
    head = MODE_PROMPTS[mode].format(fields=", ".join(f"{f.name} ({f.dataType.simpleString()})" for f in STRUCTURED[mode]))
    return F.concat(F.lit(f"{head}\nDocument:\n"), prefix(text, PROMPT_UNITS))


def pairs_of(reply: object) -> list[dict]:
    """Trimmed pairs of a reply, without incomplete ones."""
    found = reply.get("pairs") if isinstance(reply, dict) else None
    out = []
    for p in found or []:
        instruction, output = (p[k].strip(JS_SPACE) for k in ("instruction", "output"))
        if instruction and output:
            out.append({"instruction": instruction, "output": output})
    return out


def ask_all(prompts: DataFrame, make: Callable[[], Extractor], *, schema: dict | None, concurrency: int = CONCURRENCY, progress: Accumulator | None = None) -> DataFrame:
    """``prompts`` with status, reply and error in place of the column ``prompt``.

    Each task keeps up to ``concurrency`` requests open.  An error that stops
    all ends the task's work: prompts that were not sent get the status
    ``not_attempted``.  Other errors fail their own row.  ``reply`` is JSON text.
    """
    kept = [f for f in prompts.schema.fields if f.name != "prompt"]
    names = [f.name for f in kept]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", status string, reply string, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor, stopped = make(), False

        def one(prompt: str) -> tuple[str, str | None, str | None]:
            nonlocal stopped
            if stopped:
                return "not_attempted", None, None
            try:
                out = "ok", json.dumps(ask_for_json(extractor, prompt, schema), ensure_ascii=False), None
            except Exception as e:  # becomes a row
                stopped = stopped or stops_all(e)
                out = "failed", None, describe(e)
            return out

        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                found = list(pool.map(one, part["prompt"]))
                if progress is not None:
                    progress.add(sum(f[0] != "not_attempted" for f in found))  # reaches the driver when the task ends
                yield part[names].assign(status=[f[0] for f in found], reply=[f[1] for f in found], error=[f[2] for f in found])

    return prompts.mapInPandas(run, ddl)


class OfflineExtractor:
    """A deterministic stand-in: one pair for each passage, made of its digest and length; fails where told to."""

    def __init__(self, fails: Callable[[str], Exception | None] | None = None):
        self.fails = fails or (lambda passage: None)

    def complete(self, prompt: str, schema: dict | None = None) -> str:
        import hashlib

        passage = prompt.partition("\nPassage:\n")[2] if schema == PAIRS_JSON_SCHEMA else prompt.partition("\nDocument:\n")[2]
        if error := self.fails(passage):
            raise error
        digest = hashlib.md5(passage.encode("utf-8", "surrogatepass")).hexdigest()
        if schema == PAIRS_JSON_SCHEMA:
            return json.dumps({"pairs": [{"instruction": f" What is {digest}? ", "output": f"A passage of {len(passage)} characters."}]})
        return f'```json\n{json.dumps({"digest": digest})}\n```'


