"""Settings: defaults, and files of ``key = value`` lines."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from lodestar.functions.text import atoi


@dataclass
class Settings:
    dim: int = 128
    M: int = 16
    ef_construction: int = 150
    ef_search: int = 128
    max_levels: int = 16
    port: int = 5555
    bind_addr: str = "0.0.0.0"
    embedding_model_path: str = ""
    tokenizer_normalization: int = 1
    save_interval: int = 15
    max_text_length: int = 4096
    persistence_path: str = "dump"
    log_level: int = 1
    log_file: str = "lodestar.log"

    def as_dict(self) -> dict[str, object]:
        return dataclasses.asdict(self)


def parse_settings(lines: list[str]) -> Settings:
    """Blank lines, # lines, lines without = and unknown keys are passed over; the last value wins."""
    found = Settings()
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    for line in lines:
        key, eq, value = line.strip().partition("=")
        key, value = key.strip(), value.strip()
        if eq and not key.startswith("#") and key in kinds:
            setattr(found, key, atoi(value) if kinds[key] is int else value)
    return found


def load_settings(spark, path: str) -> Settings:
    """From a file that Spark can read; its lines are few."""
    return parse_settings([r.value for r in spark.read.text(path).collect()])
