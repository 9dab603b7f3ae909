"""Embedding and language models: local stand-ins, and connectors to HTTP services.

An embedder has ``embed(texts) -> list of vectors``; a chat model is a function from (system, prompt) to
an answer. Services are reached from the tasks, at most ``REQUEST_TEXTS`` texts a request; requests that a
service refuses for a while, or that do not reach it, are tried again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import Other


#: Texts of a request; tries, and seconds before the second one, doubled each time.
REQUEST_TEXTS, TRIES, WAIT = 64, 4, 0.5


#: From address, key and body of a request to the answer.
Post = Callable[[str, str, dict], dict]


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words and character trigrams, scaled to length 1; needs no model."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                for part, weight in [(word, 1.0), *((f"#{word[i : i + 3]}", 0.3) for i in range(max(1, len(word) - 2)))]:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    row[h % self.dimension] += weight if h >> 63 else -weight
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


def post_json(url: str, key: str, body: dict, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    for turn in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, ValueError) as e:
            passing = e.code == 429 or e.code >= 500 if isinstance(e, urllib.error.HTTPError) else isinstance(e, OSError)
            if turn == TRIES - 1 or not passing:
                raise Other(str(e)) from e
            time.sleep(WAIT * 2**turn)
    raise AssertionError


class ApiEmbedder:
    """A service that takes {model, input} and gives data[].embedding; `post` is what sends a request."""

    def __init__(self, url: str, key: str, model: str, post: Post | None = None):
        self.url, self.key, self.model, self.post = url, key, model, post or post_json

    @classmethod
    def from_env(cls) -> ApiEmbedder:
        for name in ("EMBED_API_URL", "EMBED_API_KEY", "EMBED_MODEL_NAME"):
            if name not in os.environ:
                raise Other(f"{name} not set")
        return cls(os.environ["EMBED_API_URL"], os.environ["EMBED_API_KEY"], os.environ["EMBED_MODEL_NAME"])

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), REQUEST_TEXTS):
            some = list(texts[a : a + REQUEST_TEXTS])
            found = [d["embedding"] for d in self.post(self.url, self.key, {"model": self.model, "input": some})["data"]]
            if len(found) != len(some):
                raise Other(f"{len(some)} texts sent, {len(found)} vectors received")
            out += found
        return out


class FolderEmbedder:
    """A model in a folder: `load` makes a function from texts to vectors of it, once a worker.

    The folder must be there on every worker, or be one that all of them share.
    """

    _loaded: dict[tuple[str, str], Callable[[Sequence[str]], list[list[float]]]] = {}

    def __init__(self, path: str, load: Callable[[str], Callable[[Sequence[str]], list[list[float]]]] | None = None):
        if not os.path.exists(path):
            raise Other(f"model path not found: {path}")
        self.path, self.load = path, load or onnx_model

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        key = (self.path, getattr(self.load, "__qualname__", ""))
        if key not in self._loaded:
            self._loaded[key] = self.load(self.path)
        return [[float(x) for x in v] for v in self._loaded[key](texts)]


def onnx_model(path: str) -> Callable[[Sequence[str]], list[list[float]]]:
    """A sentence model exported as model.onnx beside its tokenizer.json: means of the token vectors, of length 1."""
    import onnxruntime
    from tokenizers import Tokenizer

    session = onnxruntime.InferenceSession(f"{path}/model.onnx", providers=["CPUExecutionProvider"])
    tokenizer = Tokenizer.from_file(f"{path}/tokenizer.json")
    tokenizer.enable_padding()
    wanted = {i.name for i in session.get_inputs()}

    def run(texts: Sequence[str]) -> list[list[float]]:
        coded = tokenizer.encode_batch(list(texts))
        mask = np.array([c.attention_mask for c in coded], np.int64)
        given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
        tokens = session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
        means = (tokens * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)).tolist()

    return run


def auto_embedder() -> Embedder:
    """The service if EMBED_API_URL is set, else the model in NEARFIELD_MODEL_PATH, else the hashing embedder."""
    if "EMBED_API_URL" in os.environ:
        return ApiEmbedder.from_env()
    return FolderEmbedder(os.environ["NEARFIELD_MODEL_PATH"]) if "NEARFIELD_MODEL_PATH" in os.environ else HashingEmbedder()


def embedding(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embedder.embed(batch.fillna("").tolist()), index=batch.index)

    return run(text)


class ApiChat:
    """A chat service with messages in and choices out. The names of settings and their defaults are fixed values."""

    def __init__(self, url: str, key: str, model: str, post: Post | None = None):
        self.url, self.key, self.model, self.post = url, key, model, post or post_json

    @classmethod
    def from_env(cls) -> ApiChat:
        get = os.environ.get
        return cls(get("LLM_API_URL", "http://localhost:11434/v1/chat/completions"), get("LLM_API_KEY", "ollama"), get("LLM_MODEL_NAME", "llama3.2"))

    def __call__(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "temperature": 0.0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        choices = self.post(self.url, self.key, body)["choices"]
        return choices[0]["message"]["content"] if choices else ""
