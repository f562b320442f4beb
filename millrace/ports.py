"""Ports for models: text generation and embeddings never touch the numbers, and have offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ChatModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Token hashing with unit length; the same text always has the same vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class EchoModel:
    """Deterministic replies by the kind of prompt, so that every path runs offline."""

    def complete(self, system: str, user: str) -> str:
        kind = system.split(":", 1)[0]
        first = next((x for x in user.splitlines() if x.strip()), "")[:120]
        if kind == "explain":
            bad = re.search(r"(?i)\b(error|fatal|deadlock|outofmemory|warn)\w*", user)
            return json.dumps([{"category": "ERRORS", "severity": "ERROR", "title": f"{bad[0].lower()} in window", "explanation": first, "confidence": 0.5}] if bad else [])
        if kind == "correlate":
            return json.dumps({"narrative": first, "root_cause": "unknown"})
        if kind == "judge":
            return json.dumps({"grounded": True})
        if kind == "grade":
            return json.dumps({"useful": re.findall(r"\[([^\]\s]+)\]", user)[:10]})
        if kind == "rewrite":
            return " ".join(re.findall(r"\w{4,}", user))
        if kind == "answer":
            ids = re.findall(r"\[([^\]\s]+)\]", user)
            return json.dumps({"answer": first, "citations": ids[:3]})
        return user


def embed_column(df: DataFrame, text: str, out: str, embedder: Embedder, max_chars: int = 8000) -> DataFrame:
    """Adds vectors, a batch of rows a call."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed([(t or "")[:max_chars] for t in texts]))

    return df.withColumn(out, run(F.col(text)))


def explain_column(df: DataFrame, text: str, out: str, model: ChatModel) -> DataFrame:
    """Adds the model's raw reply for each window's text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.complete("explain: findings as a JSON array", t or ""))

    return df.withColumn(out, run(F.col(text)))
