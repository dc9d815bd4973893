"""Model clients for the model job.

A client has ``complete(system, prompts)``, which returns an answer or an
exception for each prompt in order, and may have ``open()``, called once per
partition on the executor before the first call. Clients are plain picklable
objects. Models that answer whole tables are ``model_job.AnswerExchange``.
"""

from __future__ import annotations

import json
import os
import urllib.request

from pairwright.fixed_values import TEMPERATURE


class ChatCompletionsBackend:
    """Client for an HTTP chat-completions endpoint (JSON in, JSON out).

    ``url`` is the full endpoint, ``api_key`` is sent as a bearer token.
    One request per prompt; a prompt that fails gives its exception in place of
    an answer, and the model job calls it again. ``api_key_env`` names the
    environment variable that holds the key on the executors, so the key itself
    never travels with the job.
    """

    def __init__(self, url: str, model: str, api_key: str | None = None,
                 temperature: float = TEMPERATURE, timeout: float = 120.0, api_key_env: str | None = None):
        self.url, self.name, self.api_key, self.api_key_env = url, model, api_key, api_key_env
        self.temperature, self.timeout = temperature, timeout

    def _one(self, system: str, prompt: str) -> str:
        body = json.dumps({
            "model": self.name,
            "temperature": self.temperature,
            "messages": [{"role": "system", "content": system},
                         {"role": "user", "content": prompt}],
        }).encode("utf-8")
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.api_key_env) if self.api_key_env else self.api_key
        if key:
            headers["Authorization"] = f"Bearer {key}"
        req = urllib.request.Request(self.url, data=body, headers=headers, method="POST")
        with urllib.request.urlopen(req, timeout=self.timeout) as resp:
            data = json.loads(resp.read().decode("utf-8"))
        return data["choices"][0]["message"]["content"]

    def complete(self, system: str, prompts: list[str]) -> list[str | Exception]:
        out: list[str | Exception] = []
        for p in prompts:
            try:
                out.append(self._one(system, p))
            except Exception as exc:  # noqa: BLE001 - belongs to this prompt alone
                out.append(exc)
        return out
