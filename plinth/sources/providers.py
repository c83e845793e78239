"""Providers that draft answers: a chat model behind HTTP, and a model loaded in the tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from plinth.operators.grounding import SYSTEM_PROMPT

DRAFTS = "qid {kind}, text string"
#: Requests that a task has open at once, and tries of one before the stub answers.
OPEN, TRIES = 8, 3
#: Answers that ask to come again later.
LATER = (408, 429, 500, 502, 503, 504)


def _post(url: str, body: dict, headers: dict, timeout_s: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout_s) as answer:
        return json.loads(answer.read())


def completed(prompt: str, url: str, model: str, key: str | None, temperature: float, timeout_s: float, wait_s: float) -> str | None:
    """The text that a chat endpoint answers to one prompt; None after TRIES, or at once where trying again is no use."""
    body = {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": prompt}]}
    for k in range(TRIES):
        try:
            return _post(url, body, {"Authorization": f"Bearer {key}"} if key else {}, timeout_s)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as problem:
            if problem.code not in LATER:
                return None
            asked = problem.headers.get("Retry-After", "")
            pause = float(asked) if asked.isdigit() else wait_s * 2**k
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            pause = wait_s * 2**k
        if k < TRIES - 1:
            time.sleep(pause)
    return None


def remote(url: str, model: str, key: Callable[[], str | None] | None = None, temperature: float = 0.1, timeout_s: float = 60.0, wait_s: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A provider that asks a chat-completions endpoint for each prompt, OPEN at a time in a task.

    ``key`` is read in the tasks, so that no secret lies in a plan. A prompt
    that is not answered has a null draft; the stub then answers it alone.
    """

    def provider(prompts: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            secret = key() if key else None
            with ThreadPoolExecutor(OPEN) as pool:
                for f in frames:
                    texts = list(pool.map(lambda p: completed(p, url, model, secret, temperature, timeout_s, wait_s), f["prompt"]))
                    yield pd.DataFrame({"qid": f["qid"], "text": pd.Series(texts, index=f.index, dtype=object)})

        return prompts.select("qid", "prompt").mapInPandas(run, DRAFTS.format(kind=prompts.schema["qid"].dataType.simpleString()))

    return provider


def local(load: Callable[[], Callable[[str, list[str]], list[str]]]) -> Callable[[DataFrame], DataFrame]:
    """A provider whose model each task loads once: ``load()`` gives ``(system, prompts) -> texts``. Where it cannot be loaded or fails on a batch, drafts are null."""

    def provider(prompts: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                model = load()
            except Exception:
                model = None
            for f in frames:
                texts: list[str | None] = [None] * len(f)
                if model is not None:
                    try:
                        texts = list(model(SYSTEM_PROMPT, f["prompt"].tolist()))
                    except Exception:
                        texts = [None] * len(f)
                yield pd.DataFrame({"qid": f["qid"], "text": pd.Series(texts, index=f.index, dtype=object)})

        return prompts.select("qid", "prompt").mapInPandas(run, DRAFTS.format(kind=prompts.schema["qid"].dataType.simpleString()))

    return provider
