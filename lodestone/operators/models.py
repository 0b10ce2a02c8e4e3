"""Adapters for real models: sub-word counts, encoders and cross-encoders from files; each loads once per Python worker, on first use."""

from __future__ import annotations

import threading
from typing import Any

import numpy as np

_held: dict[tuple, Any] = {}
_lock = threading.Lock()


def once(key: tuple, make) -> Any:
    """The object of ``key`` in this process, made by the first caller."""
    with _lock:
        if key not in _held:
            _held[key] = make()
        return _held[key]


def tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    return once(("tokenizer", path), lambda: Tokenizer.from_file(path))


def session(path: str) -> Any:
    import onnxruntime

    def make() -> Any:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # Spark runs a worker per core
        return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])

    return once(("session", path), make)


class SubwordCounter:
    """The number of a text's sub-word tokens, without special ones: a counter for chunk budgets, and a cut at a number of tokens."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return len(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def cut(self, text: str, most: int) -> str:
        """The longest beginning of ``text`` with ``most`` tokens at most."""
        ends = [b for _, b in tokenizer(self.path).encode(text, add_special_tokens=False).offsets]
        return text if len(ends) <= most else text[: ends[most - 1]] if most else ""


def padded(encoded: list, names: list[str]) -> dict[str, np.ndarray]:
    """The inputs of a model for tokenised texts, padded to the longest."""
    width = max(1, max(len(e.ids) for e in encoded))
    rows = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
    return {n: np.array([r + [0] * (width - len(r)) for r in rows[n]], np.int64) for n in names if n in rows}


def cut_to(encoded: list, most: int) -> list:
    for e in encoded:
        e.truncate(most)
    return encoded


class OnnxEmbedder:
    """An encoder: the mean (or the first) of the last hidden states, at unit length."""

    def __init__(self, model: str, tokens: str, dim: int, most_tokens: int = 512, first: bool = False):
        self.model, self.tokens, self.dim, self.most_tokens, self.first = model, tokens, dim, most_tokens, first

    def embed(self, texts: list[str]) -> np.ndarray:
        net = session(self.model)
        inputs = padded(cut_to(tokenizer(self.tokens).encode_batch(texts), self.most_tokens), [i.name for i in net.get_inputs()])
        states = np.asarray(net.run(None, inputs)[0], np.float32)
        if self.first:
            out = states[:, 0]
        else:
            mask = inputs["attention_mask"][:, :, None].astype(np.float32)
            out = (states * mask).sum(1) / np.maximum(mask.sum(1), 1.0)
        if out.shape[1] != self.dim:
            raise ValueError(f"the model gives {out.shape[1]} dimensions, not {self.dim}")
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OnnxPairScorer:
    """A cross-encoder: one logit per (question, passage) pair."""

    def __init__(self, model: str, tokens: str, most_tokens: int = 512):
        self.model, self.tokens, self.most_tokens = model, tokens, most_tokens

    def score(self, question: str, passages: list[str]) -> list[float]:
        net = session(self.model)
        encoded = cut_to(tokenizer(self.tokens).encode_batch([(question, p) for p in passages]), self.most_tokens)
        logits = np.asarray(net.run(None, padded(encoded, [i.name for i in net.get_inputs()]))[0], np.float64)
        return logits.reshape(len(passages), -1)[:, 0].tolist()
