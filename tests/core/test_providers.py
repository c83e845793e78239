"""Drafting providers against a chat endpoint in this process."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from plinth.operators.grounding import SYSTEM_PROMPT
from plinth.sources import providers


@pytest.fixture
def endpoint():
    seen, tries = [], Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][1]["content"]
            seen.append((self.headers.get("Authorization"), body))
            tries[prompt] += 1
            code = 503 if prompt == "busy" and tries[prompt] < 3 else 401 if prompt == "refused" else 200
            self.send_response(code)
            if code == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            if code == 200:
                text = {"odd": b"{}", "broken": b"no json"}.get(prompt, json.dumps({"choices": [{"message": {"content": f"draft of {prompt}"}}]}).encode())
                self.wfile.write(text)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/v1/chat", seen, tries
    server.shutdown()


def test_remote_provider(spark, endpoint):
    url, seen, tries = endpoint
    prompts = spark.createDataFrame([(k, p, "q") for k, p in enumerate(["one", "two", "busy", "refused", "odd", "broken"])], "qid int, prompt string, question string")
    made = providers.remote(url, "some-model", key=lambda: "secret", wait_s=0.01)(prompts)
    assert "secret" not in made._jdf.queryExecution().toString()
    got = {r.qid: r.text for r in made.collect()}
    assert got == {0: "draft of one", 1: "draft of two", 2: "draft of busy", 3: None, 4: None, 5: None}
    assert tries["busy"] == 3 and tries["refused"] == 1 and tries["odd"] == tries["broken"] == providers.TRIES
    assert {a for a, _ in seen} == {"Bearer secret"} and all(b["messages"][0] == {"role": "system", "content": SYSTEM_PROMPT} and b["temperature"] == 0.1 and b["model"] == "some-model" for _, b in seen)
    assert providers.completed("x", "http://127.0.0.1:9/none", "m", None, 0.1, 1.0, 0.0) is None


def test_local_provider(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "qid long, prompt string").repartition(3)
    fine = providers.local(lambda: lambda system, texts: [t.upper() + str(system == SYSTEM_PROMPT) for t in texts])(prompts)
    assert sorted((r.qid, r.text) for r in fine.collect()) == [(k, f"P{k}True") for k in range(6)]

    def absent():
        raise ImportError("no such model")

    assert {r.text for r in providers.local(absent)(prompts).collect()} == {None}
    assert {r.text for r in providers.local(lambda: lambda system, texts: 1 / 0)(prompts).collect()} == {None}
