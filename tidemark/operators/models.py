"""Signature backends and the registry that names them."""

from __future__ import annotations

import tomllib
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.errors import ConfigError, IoError, ModelError

# Names under which a registry may ask for the perceptual backend, and those that need no entry.
BACKENDS = ("perceptual", "perceptual_hash", "blockhash")
BUILT_IN = ("perceptual", "perceptual_blockhash_64")


class ModelBackend(ABC):
    """Turns images into vectors of ``dim`` numbers."""

    name: str
    dim: int

    @abstractmethod
    def embed(self, image: bytes) -> list[float]:
        """The vector of an encoded image; ModelError where it can't be read."""

    def signatures(self, images: DataFrame) -> DataFrame:
        """``path, embedding`` for rows of path and content, in Arrow batches; null for an image that can't be read."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for content in f["content"]:
                    try:
                        out.append(self.embed(bytes(content)) if content is not None else None)
                    except ModelError:
                        out.append(None)
                yield pd.DataFrame({"path": f["path"], "embedding": pd.Series(out, dtype=object, index=f.index)})

        return images.select("path", "content").mapInPandas(run, "path string, embedding array<float>")


def pixels(image: bytes) -> np.ndarray:
    """Grey values of a plain or colour portable map (P5, P6), the one kind of image that needs no library."""
    words, at = [], 0
    while len(words) < 4:
        while at < len(image) and (image[at : at + 1].isspace() or image[at : at + 1] == b"#"):
            at = image.find(b"\n", at) if image[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise ModelError("the image has no pixels")
        end = at
        while end < len(image) and not image[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ModelError("the image has no header")
        words.append(image[at:end])
        at = end
    depth = {b"P5": 1, b"P6": 3}.get(words[0])
    if depth is None or not all(w.isdigit() for w in words[1:]) or int(words[3]) > 255:
        raise ModelError("not an image of a kind that can be read")
    width, height = int(words[1]), int(words[2])
    raw = np.frombuffer(image, np.uint8, offset=at + 1)
    if not width * height or len(raw) < width * height * depth:
        raise ModelError("the image has too few pixels")
    return raw[: width * height * depth].reshape(height, width, depth).mean(axis=2)


class PerceptualBackend(ModelBackend):
    """64 blocks of an image, each 1 where it is brighter than the median block."""

    name, dim = "perceptual_blockhash_64", 64

    def embed(self, image: bytes) -> list[float]:
        grey = pixels(image)
        rows = np.array_split(np.arange(grey.shape[0]), 8) if grey.shape[0] >= 8 else [np.array([i * grey.shape[0] // 8]) for i in range(8)]
        columns = np.array_split(np.arange(grey.shape[1]), 8) if grey.shape[1] >= 8 else [np.array([i * grey.shape[1] // 8]) for i in range(8)]
        means = np.array([grey[np.ix_(r, c)].mean() for r in rows for c in columns])
        return (means > np.median(means)).astype(float).tolist()


def backend(name: str) -> str:
    """The signature backend of a name; ConfigError for one that there is not."""
    if name.lower() in BACKENDS:
        return "perceptual"
    raise ConfigError(f"no signature backend is named {name!r}")


@dataclass
class ModelRegistry:
    """Models by name, from TOML: ``default_model`` and a table ``models`` of backend, model_path, embedding_dim, input_size."""

    default_model: str
    models: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def from_toml(cls, text: str) -> ModelRegistry:
        try:
            d = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"the registry is not TOML: {e}") from e
        models = d.get("models", {})
        if not isinstance(d.get("default_model"), str) or not isinstance(models, dict):
            raise ConfigError("the registry names no default model")
        for name, m in models.items():
            if not isinstance(m, dict) or not isinstance(m.get("backend"), str) or not isinstance(m.get("embedding_dim"), int):
                raise ConfigError(f"model {name!r} lacks a backend or an embedding_dim")
        return cls(d["default_model"], models)

    @classmethod
    def load(cls, path: str) -> ModelRegistry:
        try:
            with open(path, encoding="utf-8") as f:
                return cls.from_toml(f.read())
        except OSError as e:
            raise IoError(str(e)) from e

    def create(self, name: str | None = None) -> ModelBackend:
        name = name or self.default_model
        if name in self.models:
            if self.models[name]["backend"] not in BACKENDS:
                raise ConfigError(f"model {name!r} asks for a backend that there is not: {self.models[name]['backend']!r}")
        elif name not in BUILT_IN:
            raise ConfigError(f"no model is named {name!r} (the default is {self.default_model!r})")
        return PerceptualBackend()
