"""Settings of all stages; they are captured by the functions that use them, never put into the Spark session."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Parsing:
    parser: str = "auto"  # auto, native or docling
    enable_ocr: bool = False
    ocr_language: tuple[str, ...] = ("en", "id")  # accepted, without effect
    keep_images: bool = False  # accepted, without effect


@dataclass(frozen=True)
class Cleaning:
    remove_repeated_headers: bool = True
    remove_repeated_footers: bool = True
    remove_page_numbers: bool = True
    collapse_whitespace: bool = True
    collapse_blank_lines: bool = True
    fix_broken_ocr: bool = True
    fix_invalid_unicode: bool = True


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 500  # only used to split units above max_tokens
    min_tokens: int = 250
    max_tokens: int = 700
    overlap_tokens: int = 90
    encoding: str = "words"  # "words": words * 1.33; else the path of a .tiktoken or SentencePiece file
    split_on_paragraph: bool = True  # accepted, without effect
    respect_heading_boundary: bool = True
    prepend_context: bool = True


@dataclass(frozen=True)
class Validation:
    enabled: bool = True
    min_quality_score: int = 70  # accepted, without effect
    flag_duplicate: bool = True
    flag_oversized: bool = True
    flag_undersized: bool = True


@dataclass(frozen=True)
class Metadata:
    detect_language: bool = True


@dataclass(frozen=True)
class Export:
    format: str = "jsonl"
    output_dir: str = "./output"
    pretty_json: bool = True
    include_metadata: bool = True
    overwrite: bool = True  # accepted, without effect


@dataclass(frozen=True)
class Embedding:
    provider: str = "hashing"  # hashing, local, openai or custom
    model: str = ""
    dim: int = 64
    batch_size: int = 32
    api_key: str = ""
    api_base: str = ""

    def __post_init__(self) -> None:
        _choice("embedding.provider", self.provider, ("hashing", "local", "openai", "custom"))
        _needs_base("embedding", self)


@dataclass(frozen=True)
class Store:
    collection: str = "documents"
    path: str = "./vectorstore"
    distance: str = "cosine"

    def __post_init__(self) -> None:
        _choice("store.distance", self.distance, ("cosine",))


@dataclass(frozen=True)
class Llm:
    provider: str = "echo"  # echo, local, openai or custom
    model: str = ""
    api_key: str = ""
    api_base: str = ""
    temperature: float = 0.3
    max_tokens: int = 1024

    def __post_init__(self) -> None:
        _choice("llm.provider", self.provider, ("echo", "local", "openai", "custom"))
        _needs_base("llm", self)


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    score_threshold: float = 0.3
    filter_by_document: bool = False  # accepted, without effect


@dataclass(frozen=True)
class Config:
    parsing: Parsing = field(default_factory=Parsing)
    cleaning: Cleaning = field(default_factory=Cleaning)
    chunking: Chunking = field(default_factory=Chunking)
    validation: Validation = field(default_factory=Validation)
    metadata: Metadata = field(default_factory=Metadata)
    export: Export = field(default_factory=Export)
    embedding: Embedding = field(default_factory=Embedding)
    store: Store = field(default_factory=Store)
    llm: Llm = field(default_factory=Llm)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def __post_init__(self) -> None:
        _choice("parsing.parser", self.parsing.parser, ("auto", "native", "docling"))
        _choice("export.format", self.export.format, ("json", "jsonl", "markdown", "md"))


def _choice(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; it is {value!r}")


def _needs_base(name: str, part: Any) -> None:
    if part.provider == "custom" and not part.api_base.strip():
        raise ValueError(f"{name}.api_base is needed with provider 'custom'")


def from_dict(data: dict[str, Any] | None, kind: type = Config) -> Any:
    """Settings from nested dicts; what is missing has its default, unknown names are ignored."""
    given = {}
    for f in fields(kind):
        if data and f.name in data:
            default = f.default_factory() if callable(f.default_factory) else None  # type: ignore[misc]
            x = data[f.name]
            given[f.name] = from_dict(x, type(default)) if is_dataclass(default) else tuple(x) if isinstance(x, list) else x
    return kind(**given)


def load(path: str | Path | None = None) -> Config:
    """Settings of a YAML file, the defaults where there is no file."""
    if path is None or not Path(path).exists():
        return Config()
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def load_env(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file put into the environment, unless it has the name already."""
    import os

    found: dict[str, str] = {}
    p = Path(path)
    for line in p.read_text(encoding="utf-8").splitlines() if p.exists() else ():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found
