"""Settings of the ingest and crawl commands, with their defaults."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, fields


# The commands' option names and defaults.
@dataclass(frozen=True)
class IngestConfig:
    db: str = "bylaws"
    collection: str = "bylaw_chunks"
    city: str = ""
    input: str = ""
    chunk: int = 1000
    overlap: int = 150
    minchunk: int = 600
    batch: int = 64


@dataclass(frozen=True)
class CrawlConfig:
    output: str = "out"
    loglevel: str = "INFO"


def parse(kind: type, argv: list[str], env: dict[str, str] | None = None):
    """kind from --name value arguments; where one is missing, from the environment's CW_NAME, else the default."""
    env = os.environ if env is None else env
    p = argparse.ArgumentParser()
    for f in fields(kind):
        cast = type(f.default)
        p.add_argument(f"--{f.name}", type=cast, default=cast(env.get(f"CW_{f.name.upper()}", f.default)))
    return kind(**vars(p.parse_args(argv)))
