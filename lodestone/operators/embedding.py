"""Embedders and the operator that applies one to chunks."""

from __future__ import annotations

import hashlib
import importlib.util
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.functions.text import PREFIXES, prefix_policy

#: What is known of models without loading them.
DIMENSIONS = {"sbintuitions/sarashina-embedding-v2-1b": 1792, "Qwen/Qwen3-Embedding-0.6B": 1024, "BAAI/bge-m3": 1024}
HALF_PRECISION = "sbintuitions/sarashina-embedding-v2-"
OWN_CODE = "pfnet/plamo-embedding-1b"
BATCH, ATTEMPTS = 32, 5


class NonFinite(ValueError):
    """A model gave numbers that are not finite."""


@dataclass(frozen=True)
class Config:
    """What an index remembers of the model it was made with."""

    model: str
    dim: int
    backend: str
    device: str = "cpu"
    batch: int = BATCH
    prefixes: str = "e5"


class Embedder(ABC):
    """Turns texts into unit vectors. It is sent to the workers, so it must pickle and load its model there."""

    config: Config

    @abstractmethod
    def raw(self, texts: list[str], role: str) -> np.ndarray:
        """One row of numbers a text, which has its prefix already; ``role`` is query or passage."""

    def embed(self, texts: list[str], role: str = "passage") -> list[list[float]]:
        """Unit vectors in single precision, in batches of the configured size."""
        head = PREFIXES[self.config.prefixes][0 if role == "query" else 1]
        out: list[list[float]] = []
        for begin in range(0, len(texts), self.config.batch):
            out += normalized(self.raw([head + t for t in texts[begin : begin + self.config.batch]], role)).tolist()
        return out


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Unit rows in single precision; zero rows stay, non-finite parts are an error."""
    vectors = np.asarray(vectors, np.float32)
    if not np.isfinite(vectors).all():
        raise NonFinite("embedding contains non-finite values")
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=vectors.copy(), where=norms > 0)


class HashingProvider(Embedder):
    """Deterministic embeddings by signed hashing of trigrams, for use without a model."""

    def __init__(self, dim: int = 64):
        self.config = Config("hashing", dim, "hashing", prefixes="bge-m3")

    def raw(self, texts: list[str], role: str) -> np.ndarray:
        out = np.zeros((len(texts), self.config.dim), np.float32)
        for row, text in enumerate(texts):
            folded = text.lower()
            for k in range(max(0, len(folded) - 2)):
                digest = int.from_bytes(hashlib.blake2b(folded[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[row, digest % self.config.dim] += 1 if digest >> 63 else -1
        return out


class SentenceTransformerProvider(Embedder):
    """A sentence-transformers model, loaded once in each worker; the library and weights must be there.

    Its dimension is given, or known by name, or asked of the model itself.
    """

    def __init__(self, model: str, dim: int | None = None, device: str = "auto", batch: int = BATCH):
        device = resolve_device(device)
        known = dim or DIMENSIONS.get(model) or int(_model(model, device).get_sentence_embedding_dimension())
        self.config = Config(model, known, "sentence-transformers", device, batch, prefix_policy(model))

    def raw(self, texts: list[str], role: str) -> np.ndarray:
        return _model(self.config.model, self.config.device).encode(texts, batch_size=self.config.batch)


class CustomModelProvider(Embedder):
    """A model with code of its own, as two functions that ``load`` makes in each worker: one for passages, one for queries.

    Such models now and then give non-finite numbers; a batch is then tried
    again, ``attempts`` times in all. Any other error is raised at once.
    """

    def __init__(self, model: str, dim: int, load: Callable[[str, str], dict[str, Callable]], device: str = "auto", batch: int = BATCH, attempts: int = ATTEMPTS):
        self.config = Config(model, dim, "custom", resolve_device(device), batch, prefix_policy(model))
        self.load, self.attempts = load, attempts

    def raw(self, texts: list[str], role: str) -> np.ndarray:
        run = _loaded(self.load, self.config.model, self.config.device)[role]
        for attempt in range(1, self.attempts + 1):
            found = np.asarray(run(texts), np.float32)
            if np.isfinite(found).all():
                return found
            warnings.warn(f"{self.config.model} gave non-finite values, attempt {attempt} of {self.attempts}", RuntimeWarning, stacklevel=2)
        raise NonFinite("embedding contains non-finite values")


def has_mps() -> bool:
    if importlib.util.find_spec("torch") is None:
        return False
    import torch

    return bool(torch.backends.mps.is_available())


def resolve_device(wanted: str) -> str:
    """cpu or mps as asked, or for ``auto`` mps where there is one."""
    if wanted not in ("auto", "cpu", "mps"):
        raise ValueError(f"unknown device: {wanted}")
    if wanted == "mps" and not has_mps():
        raise ValueError("mps was asked for and is not there")
    return "mps" if wanted != "cpu" and has_mps() else "cpu"


def load_arguments(model: str, device: str) -> dict:
    """How a model wants to be loaded: some in half precision where the device has it, some with code of their own."""
    out: dict = {"device": device}
    if model.startswith(HALF_PRECISION) and device != "mps":
        out["model_kwargs"] = {"torch_dtype": "bfloat16"}
    if model == OWN_CODE:
        out["trust_remote_code"] = True
    return out


@lru_cache(maxsize=1)
def _model(name: str, device: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name, **load_arguments(name, device))


@lru_cache(maxsize=1)
def _loaded(load: Callable[[str, str], dict[str, Callable]], name: str, device: str) -> dict[str, Callable]:
    return load(name, device)


def embed(chunks: DataFrame, model: Embedder) -> DataFrame:
    """``chunks`` with ``embedding``."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model.embed(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, embedding array<float>")
