"""Model providers as table operators.

A provider maps a prompt to a reply. `ask` sends a prompt column through one, on executors, in Arrow batches, with retries; a failure
becomes the row's error instead of the job's. Calls are costly and impure: `replies` asks each distinct prompt once,
writes what comes back to a table by the prompt's hash, and reads it from there, so that neither a second use nor a second run asks again.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.sources.shared import checkpoint_folder
from basalt.sources.sinks import append_missing


class Provider(Protocol):
    def __call__(self, prompt: str) -> str: ...


class StubProvider:
    """A deterministic reply from the prompt's hash, for tests and dry runs; JSON if the prompt asks for it, which keeps every numbered fragment."""

    def __call__(self, prompt: str) -> str:
        h = hashlib.sha256(prompt.encode()).hexdigest()
        fragments = {int(k) - 1 for k in re.findall(r"^\[(\d+)\] ", prompt, re.M)}
        return json.dumps({"global_summary": f"summary {h[:8]}", "results": [{"index": k, "is_junk": False} for k in sorted(fragments)]}) if "JSON" in prompt else f"Computes value {h[:8]}."


class HttpProvider:
    """An endpoint of the chat-completions form; needs network on the executors."""

    def __init__(self, base_url: str, model: str, api_key: str, temperature: float = 0.1, max_tokens: int | None = None):
        self.base_url, self.model, self.api_key, self.temperature, self.max_tokens = base_url, model, api_key, temperature, max_tokens

    def __call__(self, prompt: str) -> str:
        return self._post(prompt)["message"]["content"]

    def with_logprobs(self, prompt: str) -> tuple[str, list[dict]]:
        """The reply, and its tokens with up to twenty alternatives each."""
        got = self._post(prompt, logprobs=True, top_logprobs=20)
        tokens = (got.get("logprobs") or {}).get("content") or []
        return got["message"]["content"], [{"token": t["token"], "top_logprobs": [{"token": x["token"], "logprob": x["logprob"]} for x in t["top_logprobs"]]} for t in tokens]

    def _post(self, prompt: str, **more) -> dict:
        import urllib.request

        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}], **more} | ({"max_tokens": self.max_tokens} if self.max_tokens else {})
        call = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(call, timeout=120) as reply:
            return json.load(reply)["choices"][0]


def with_retry(call: Callable[[], str], attempts: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, error): delays double from attempt to attempt."""
    error = None
    for k in range(attempts):
        try:
            return call(), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                sleep(delay * 2**k)
    return None, error


def ask(df: DataFrame, prompt: str, provider: Provider, reply: str = "reply", attempts: int = 3, delay: float = 2.0, accept: Callable[[str, dict], bool] | None = None, tries: int = 1, required: bool = False, logprobs: bool = False) -> DataFrame:
    """Add reply and <reply>_error. A reply that `accept` (given the reply and the row) refuses is asked for again, `tries` times in all; the last one stands, or is an error if an accepted one is required.

    logprobs: add <reply>_tokens, JSON of the reply's tokens with their alternatives, from a provider that has `with_logprobs`; null from others.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(p: str) -> tuple[str, str | None]:
            if logprobs and hasattr(provider, "with_logprobs"):
                text, tokens = provider.with_logprobs(p)
                return text, json.dumps(tokens)
            return provider(p), None

        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                for _ in range(max(1, tries)):
                    got, error = with_retry(lambda p=row[prompt]: call(p or ""), attempts, delay)
                    if got is None or accept is None or accept(got[0], row):
                        break
                else:
                    if required:
                        got, error = None, f"refused {tries} times"
                rows.append((*(got or (None, None)), error))
            out = b.assign(**{reply: [r[0] for r in rows], f"{reply}_error": [r[2] for r in rows]})
            yield out.assign(**{f"{reply}_tokens": [r[1] for r in rows]}) if logprobs else out

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.mapInPandas(run, f"{fields}, `{reply}` string, `{reply}_error` string" + f", `{reply}_tokens` string" * logprobs)


def ask_missing(df: DataFrame, path: str, key: str, prompt: str, provider: Provider, commits: int = 1, **how) -> None:
    """Ask for the keys that a table at path lacks, and append the replies to it."""
    append_missing(df, path, key, lambda todo: ask(todo, prompt, provider, **how).drop(prompt), commits)


def replies(df: DataFrame, prompt: str, provider: Provider, reply: str, store: str | None = None, carry: Sequence[str] = (), commits: int = 1, **how) -> DataFrame:
    """df without its prompt, with reply and <reply>_error (and _tokens). Distinct prompts are asked once, with the columns `carry` for `accept`; a table below `store` keeps the replies from run to run (below the checkpoint folder else).

    Failed calls are kept as errors of their prompt; delete their rows to ask again.
    """
    path = f"{store}/{reply}" if store else f"{checkpoint_folder(df.sparkSession)}/{reply}-{uuid.uuid4().hex}"
    hashed = df.withColumn("prompt_hash", F.sha2(F.col(prompt), 256))
    once = hashed.select("prompt_hash", prompt, *carry).dropDuplicates(["prompt_hash"])
    ask_missing(once, path, "prompt_hash", prompt, provider, commits, reply=reply, **how)
    got = df.sparkSession.read.parquet(path).drop(*carry)
    return hashed.drop(prompt).join(got, "prompt_hash", "left").drop("prompt_hash")
