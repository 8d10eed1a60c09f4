"""Settings of the command line, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass
class Config:
    target: str = "."
    out: str = "facts"
    glob: str = "*.ts"
    local_references: bool = False
    unique_members: bool = False
    repository: str = "."
    path: str = ""
    commits: str = ""
    least_files: int = 100
    most_commits: int = 0
    min_nodes: int = 12
    runtime: str = ""

    @classmethod
    def from_env(cls, prefix: str = "FACTLENS_") -> Config:
        out = cls()
        for name, kind in cls.__annotations__.items():
            v = os.environ.get(prefix + name.upper())
            if v is not None:
                setattr(out, name, v.lower() in ("1", "true", "yes") if kind == "bool" else int(v) if kind == "int" else v)
        return out
