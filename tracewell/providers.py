"""Analysis and embedding plug-ins, and the rules that choose one.

The rule-based analyser and the local TF-IDF embedder need nothing but this package and are the defaults.
Remote ones speak two public request formats over the standard library; they run inside partitions.
"""

from __future__ import annotations

import json
import math
import os
import re
import urllib.request
from collections import Counter
from collections.abc import Callable
from typing import Any, Protocol

from .functions.text import PACKAGE_MANAGERS

Transport = Callable[[str, dict[str, str], dict, float], dict]
#: Texts of the facts that name a package manager.
MANAGER_FACT, MANAGER_BODY = "项目使用 %s", "项目使用 %s 作为包管理器"


class ProviderError(Exception):
    """A provider gave no usable answer."""


class Analyser(Protocol):
    def analyze(self, summary: str, last_message: str = "") -> dict[str, list[dict]]: ...

    def summarize(self, previous: str, new_turns: str) -> str: ...

    def mine_procedure(self, steps: str, assistant: str, feedback: str = "") -> dict | None: ...


class Embedder(Protocol):
    supports_cache: bool
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def post_json(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read())
    except Exception as e:
        raise ProviderError(str(e)) from e


class RuleAnalyser:
    """Facts by rule: the package managers named as whole words. Summaries stay, procedures are not mined."""

    def analyze(self, summary: str, last_message: str = "") -> dict[str, list[dict]]:
        found = [m for m in PACKAGE_MANAGERS if re.search(rf"\b{m}\b", summary or "")]
        return {"instincts": [], "project_facts": [{"name": f"uses-{m}", "description": MANAGER_FACT % m, "body": MANAGER_BODY % m, "type": "project", "keywords": [m]} for m in found]}

    def summarize(self, previous: str, new_turns: str) -> str:
        return previous

    def mine_procedure(self, steps: str, assistant: str, feedback: str = "") -> dict | None:
        return None


_ANALYSE = 'Read the digest of a work session. Answer with JSON {"instincts": [{"id", "trigger", "action", "domain", "evidence"}], "project_facts": [{"name", "description", "body", "type", "keywords"}]}.'
_SUMMARISE = "Merge the new turns into the summary so far. Answer with the new summary only."
_MINE = 'Is this sequence of steps a procedure worth keeping? Answer with JSON {"id", "task_type", "steps", "note", "is_successful"} or null.'


class _Remote:
    def __init__(self, url: str, key: str, model: str, timeout: float = 10.0, transport: Transport = post_json):
        self.url, self.key, self.model, self.timeout, self.transport = url, key, model, timeout, transport

    def _ask(self, task: str, text: str, as_json: bool) -> str:
        raise NotImplementedError

    def _json(self, task: str, text: str) -> Any:
        try:
            return json.loads(self._ask(task, text, True))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"unusable answer: {e}") from e

    def analyze(self, summary: str, last_message: str = "") -> dict[str, list[dict]]:
        found = self._json(_ANALYSE, f"{summary}\n\n{last_message}".strip())
        found = found if isinstance(found, dict) else {}
        return {k: [x for x in found.get(k) or [] if isinstance(x, dict)] for k in ("instincts", "project_facts")}

    def summarize(self, previous: str, new_turns: str) -> str:
        try:
            return self._ask(_SUMMARISE, f"{previous}\n\n{new_turns}".strip(), False).strip()
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"unusable answer: {e}") from e

    def mine_procedure(self, steps: str, assistant: str, feedback: str = "") -> dict | None:
        found = self._json(_MINE, f"{steps}\n\n{assistant}\n\n{feedback}".strip())
        return found if isinstance(found, dict) and (found.get("task_type") or "").strip() else None


class ChatAnalyser(_Remote):
    """Chat-completions format: bearer key, JSON mode, low temperature."""

    def _ask(self, task: str, text: str, as_json: bool) -> str:
        body = {"model": self.model, "temperature": 0.2, "messages": [{"role": "system", "content": task}, {"role": "user", "content": text}]}
        body |= {"response_format": {"type": "json_object"}} if as_json else {}
        answer = self.transport(f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body, self.timeout)
        return answer["choices"][0]["message"]["content"]


class MessagesAnalyser(_Remote):
    """Messages format: key and version headers, blocks of text in the answer."""

    version_header, version, max_tokens = "anthropic-version", "2023-06-01", 4096

    def _ask(self, task: str, text: str, as_json: bool) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": task, "messages": [{"role": "user", "content": text}]}
        answer = self.transport(f"{self.url}/v1/messages", {"x-api-key": self.key, self.version_header: self.version}, body, self.timeout)
        said = "".join(b.get("text", "") for b in answer["content"] if b.get("type", "text") == "text")
        fenced = re.search(r"```(?:json)?\s*(.*?)```", said, re.S)
        return fenced.group(1) if as_json and fenced else said


class ItemEmbedder:
    """One request a text; both published shapes of the answer are read. The width is that of the first vector."""

    supports_cache = True

    def __init__(self, url: str, key: str, model: str, timeout: float = 5.0, transport: Transport = post_json):
        self.url, self.key, self.model, self.timeout, self.transport, self.name, self.dim = url, key, model, timeout, transport, model, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            data = self.transport(self.url, {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": [{"type": "text", "text": text}]}, self.timeout).get("data")
            first = data[0] if isinstance(data, list) and data else data
            if not isinstance(first, dict) or not isinstance(first.get("embedding"), list):
                raise ProviderError("no embedding in the answer")
            out.append([float(x) for x in first["embedding"]])
        self.dim = self.dim or (len(out[0]) if out else None)
        return out


class BatchEmbedder(ItemEmbedder):
    """All texts in one request; the answer is put back in order by its index. No texts, no request."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 10.0, transport: Transport = post_json):
        super().__init__(url, key, model, timeout, transport)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        data = self.transport(f"{self.url}/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": texts}, self.timeout).get("data")
        if not isinstance(data, list) or len(data) != len(texts):
            raise ProviderError("not one embedding for each text")
        out = [[float(x) for x in d["embedding"]] for d in sorted(data, key=lambda d: d["index"])]
        self.dim = self.dim or len(out[0])
        return out


class TfidfEmbedder:
    """Vectors over the vocabulary of the texts given together; spaces of two calls cannot be compared."""

    supports_cache, name = False, "tfidf"

    def embed(self, texts: list[str]) -> list[list[float]]:
        counts = [Counter(re.findall(r"[^\W]{2,}", t.lower())) for t in texts]
        df = Counter(w for c in counts for w in c)
        words = sorted(df)
        idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in words}
        out = []
        for c in counts:
            row = [c[w] * idf[w] for w in words]
            size = math.sqrt(sum(x * x for x in row)) or 1.0
            out.append([x / size for x in row])
        return out


#: The settings of each named provider - format, prefix of its variables, default address and model.
ANALYSERS = {
    "chat": ("chat", "LLM", "", ""),
    "messages": ("messages", "LLM", "", ""),
    "deepseek": ("chat", "DEEPSEEK", "https://api.deepseek.com", "deepseek-chat"),
    "openai": ("chat", "OPENAI", "https://api.openai.com/v1", "gpt-4o-mini"),
    "anthropic": ("messages", "ANTHROPIC", "https://api.anthropic.com", "claude-haiku-4-5-20251001"),
}
EMBEDDERS = {
    "item": ("item", "EMBEDDING_API_KEY", "EMBEDDING", "", "", True),
    "batch": ("batch", "EMBEDDING_API_KEY", "EMBEDDING", "", "", True),
    "ark": ("item", "ARK_API_KEY", "ARK_EMBEDDING", "", "", True),
    "openai": ("batch", "OPENAI_EMBEDDING_API_KEY", "OPENAI_EMBEDDING", "https://api.openai.com/v1", "text-embedding-3-small", False),
}


def _setting(env: dict[str, str], names: list[str], default: str) -> str:
    return next((v for n in names if (v := env.get(n, "").strip())), default)


def analyser(env: dict[str, str] | None = None, transport: Transport = post_json) -> Analyser:
    """The analyser ``LLM_PROVIDER`` names (any case); by rule if it is unknown or has no key. Variables are {prefix}_API_KEY, _BASE_URL (or _URL) and _MODEL."""
    env = dict(os.environ) if env is None else env
    form, prefix, url, model = ANALYSERS.get(env.get("LLM_PROVIDER", "").strip().lower(), ("", "", "", ""))
    key = env.get(f"{prefix}_API_KEY", "").strip()
    made = {"chat": ChatAnalyser, "messages": MessagesAnalyser}.get(form)
    if not made or not key:
        return RuleAnalyser()
    return made(_setting(env, [f"{prefix}_BASE_URL", f"{prefix}_URL"], url).rstrip("/"), key, _setting(env, [f"{prefix}_MODEL"], model), transport=transport)


def embedder(env: dict[str, str] | None = None, transport: Transport = post_json) -> Embedder:
    """The embedder ``EMBEDDING_PROVIDER`` names; TF-IDF if unknown, without key, or - where one is made - if a trial call fails."""
    env = dict(os.environ) if env is None else env
    form, key_name, prefix, url, model, tried = EMBEDDERS.get(env.get("EMBEDDING_PROVIDER", "").strip().lower(), ("", "", "", "", "", False))
    key = env.get(key_name, "").strip()
    made = {"item": ItemEmbedder, "batch": BatchEmbedder}.get(form)
    if not made or not key:
        return TfidfEmbedder()
    chosen = made(_setting(env, [f"{prefix}_BASE_URL", f"{prefix}_URL"], url).rstrip("/"), key, _setting(env, [f"{prefix}_MODEL"], model), transport=transport)
    if tried:
        try:
            chosen.embed(["ping"])
        except Exception:  # noqa: BLE001
            return TfidfEmbedder()
    return chosen
