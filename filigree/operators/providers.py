"""Models as the caller brings them, and identities of what they make: embedding with retries, fingerprints, costs."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
BATCH, ATTEMPTS = 10, 3
# Yuan for a thousand tokens read and written.
PRICES = {"strong": (0.0008, 0.002), "cheap": (0.00015, 0.0015), "light": (0.0003, 0.0006), "alternative": (0.0005, 0.0015), "embedding": (0.0005, 0.0)}


def hashed_embedding(dim: int = 64) -> Embed:
    """An offline stand-in: words are counted in hashed dimensions, the vector has length one."""

    def of(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return of


def with_retries(call: Embed, texts: list[str], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Waits 1, 2, 4 ... seconds between attempts; the last failure is the caller's."""
    for attempt in range(attempts):
        try:
            return call(texts)
        except Exception:
            if attempt == attempts - 1:
                raise
            wait(2**attempt)
    raise AssertionError


def embed(chunks: DataFrame, provider: Embed, batch: int = BATCH) -> DataFrame:
    """chunk_uid, v for chunks (chunk_uid, content), in batches of the provider's size."""

    def of(frames: Iterator):
        for frame in frames:
            texts = frame["content"].fillna("").tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in with_retries(provider, texts[k : k + batch])]
            yield frame.assign(v=vectors)[["chunk_uid", "v"]]

    return chunks.select("chunk_uid", "content").mapInPandas(of, "chunk_uid string, v array<float>")


class UnknownProfile(KeyError):
    """A profile that the registry does not have."""


class Registry:
    """Profiles of models by name, as a configuration has them: {profiles: {name: {kind, model, price_in, price_out, ...}}}, prices in yuan for a
    thousand tokens. What is not there is an error that says what is."""

    def __init__(self, settings: dict) -> None:
        self.profiles = dict(settings.get("profiles") or {})
        for name, profile in self.profiles.items():
            lacking = [key for key in ("kind", "model") if not profile.get(key)]
            if lacking:
                raise ValueError(f"profile {name} lacks {', '.join(lacking)}")

    def __getitem__(self, name: str) -> dict:
        if name not in self.profiles:
            raise UnknownProfile(f"no profile {name}; there are {', '.join(sorted(self.profiles)) or 'none'}")
        return self.profiles[name]

    def of_kind(self, kind: str) -> list[str]:
        return sorted(name for name, profile in self.profiles.items() if profile["kind"] == kind)

    def prices(self) -> dict[str, tuple[float, float]]:
        return {name: (float(p.get("price_in", 0)), float(p.get("price_out", 0))) for name, p in self.profiles.items()}


def cost(profile: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]] | None = None, strict: bool = False) -> Column:
    """Yuan, six decimals; a profile without a price gives null, or an error if strict."""
    prices = PRICES if prices is None else prices
    if strict:
        profile = F.when(profile.isin(list(prices)), profile).otherwise(F.raise_error(F.concat(F.lit("no price for profile "), F.coalesce(profile, F.lit("null")))).cast("string"))
    price = lambda k: F.element_at(F.create_map(*(x for name, p in prices.items() for x in (F.lit(name), F.lit(p[k])))), profile)
    return F.round(tokens_in / 1000 * price(0) + tokens_out / 1000 * price(1), 6)


def pipeline_fingerprint(sources: list[str], chunking: dict, embedding: str) -> str:
    """What decides how documents become chunks: code, settings, model. 16 hexadecimal digits."""
    h = hashlib.sha256()
    for path in sources:
        h.update(Path(path).name.encode() + hashlib.sha256(Path(path).read_bytes()).digest())
    h.update(json.dumps(chunking, sort_keys=True).encode() + embedding.encode())
    return h.hexdigest()[:16]


def answer_fingerprint(pipeline: str, sources: list[str], settings: dict) -> str:
    """What decides the answer to a question: the pipeline, the code that answers, its settings. 12 hexadecimal digits."""
    h = hashlib.sha256(pipeline.encode())
    for path in sources:
        h.update(hashlib.sha256(Path(path).read_bytes()).digest())
    h.update(json.dumps(settings, sort_keys=True).encode())
    return h.hexdigest()[:12]
