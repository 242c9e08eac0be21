"""Settings in layers: defaults, a stored file, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; ranges are checked on creation."""

    spreadsheet_id: str = ""
    catalogue_id: str = ""
    sheet_name: str = "rows"
    log_sheet_name: str = "_log"
    hot_folder: str = ""
    invoices_root: str = "invoices"
    checkpoint_dir: str = ""
    flag_column: bool = True
    write_log: bool = True
    flag_unconfirmed_sku: bool = True
    catalogue_max_age_hours: int = 24
    quiet_seconds: float = 4.0
    max_pages: int = 200

    def __post_init__(self) -> None:
        if not 1 <= self.max_pages <= 1000:
            raise ValueError("max_pages must be 1 to 1000")
        if self.catalogue_max_age_hours < 0 or self.quiet_seconds <= 0:
            raise ValueError("ages and quiet periods must be positive")

    def missing(self) -> list[str]:
        """Names of the settings without which nothing can be written."""
        return [n for n in ("spreadsheet_id", "catalogue_id", "hot_folder") if not getattr(self, n)]

    def is_configured(self) -> bool:
        return not self.missing()


#: Settings that the environment fills only where they are empty.
_FILL = {"PAPERLOOM_SPREADSHEET_ID": "spreadsheet_id", "PAPERLOOM_CATALOGUE_ID": "catalogue_id"}
#: Settings that the environment always sets.
_OVERRIDE = {"PAPERLOOM_SHEET": "sheet_name", "PAPERLOOM_LOG_SHEET": "log_sheet_name"}


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes are dropped."""
    found = {}
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("\"'")
    return found


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    known = {f.name for f in fields(Settings)}
    stored = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    settings = Settings(**{k: v for k, v in stored.items() if k in known})
    env = dict(os.environ) if env is None else env
    changes = {n: env[k] for k, n in _FILL.items() if env.get(k) and not getattr(settings, n)}
    changes |= {n: env[k] for k, n in _OVERRIDE.items() if env.get(k)}
    return replace(settings, **changes)


def save(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2, sort_keys=True))
