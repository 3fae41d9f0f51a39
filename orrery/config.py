"""Settings: defaults, then a file of KEY=VALUE lines, then the environment; and the list of repositories."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    home: str = "~/.orrery"
    data_dir: str = ""
    repos_file: str = ""
    sim_threshold: float = 0.25
    vector_top_k: int = 20
    fts_top_k: int = 10
    graph_hops: int = 2
    budget_tokens: int = 6000
    embed_dim: int = 64

    @property
    def data(self) -> Path:
        return Path(self.data_dir or f"{self.home}/data").expanduser()

    @property
    def repos(self) -> Path:
        return Path(self.repos_file or f"{self.home}/repos.yaml").expanduser()


def lines(text: str) -> dict[str, str]:
    pairs = (x.split("=", 1) for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def settings(env: dict[str, str] | None = None, file: str | None = None) -> Settings:
    """Names are ORRERY_ and the field's in capitals. An empty value counts as none."""
    found = lines(Path(file).read_text()) if file and Path(file).exists() else {}
    found |= {k: v for k, v in (os.environ if env is None else env).items() if v}
    got = {f.name: type(f.default)(found[k]) for f in fields(Settings) if found.get(k := f"ORRERY_{f.name.upper()}")}
    return Settings(**got)


def repositories(path: str | Path) -> list[dict]:
    """name, path, exclude of a YAML list (``repos:`` or bare) of mappings or of paths; none if there is no file."""
    import yaml

    if not Path(path).exists():
        return []
    found = yaml.safe_load(Path(path).read_text()) or []
    rows = found.get("repos") or [] if isinstance(found, dict) else found
    rows = [{"path": r} if isinstance(r, str) else r for r in rows]
    return [{"name": r.get("name") or Path(r["path"]).name, "path": str(Path(r["path"]).expanduser()), "exclude": list(r.get("exclude") or [])} for r in rows]
