"""Settings of a scan, with the file they are read from and written to."""

from __future__ import annotations

import configparser
import hashlib
import os
from dataclasses import dataclass, fields

# The section of the file and the names of its entries by field.
SECTION = "Settings"
NAMES = {"max_file_mb": "MaxFileSizeMB", "metadata_timeout": "ExifToolTimeout", "workers": "MaxWorkerThreads", "visual_pages": "VisualDiffPageLimit", "export_invalid_xref": "ExportInvalidXREF", "tool_path": "ExifToolPath", "tool_hash": "ExifToolHash", "signing_key": "SigningKeyPath", "language": "Language"}


@dataclass(frozen=True)
class Config:
    max_file_mb: int = 1000
    metadata_timeout: int = 30
    workers: int = 16
    visual_pages: int = 15
    export_invalid_xref: bool = False
    tool_path: str = ""
    tool_hash: str = ""
    signing_key: str = ""
    language: str = "en"


def load(path: str) -> Config:
    """The settings of a file. A file that is not there is made, with the values it would give; entries that cannot be read keep theirs."""
    if not os.path.exists(path):
        save(Config(), path)
    parser, found = configparser.ConfigParser(), {}
    parser.read(path, encoding="utf-8")
    if parser.has_section(SECTION):
        for f in fields(Config):
            try:
                get = parser.getboolean if isinstance(f.default, bool) else parser.getint if isinstance(f.default, int) else parser.get
                found[f.name] = get(SECTION, NAMES[f.name])
            except (configparser.NoOptionError, ValueError):
                continue
    return Config(**found)


def save(config: Config, path: str) -> None:
    parser = configparser.ConfigParser()
    parser[SECTION] = {NAMES[f.name]: str(getattr(config, f.name)) for f in fields(Config)}
    with open(path, "w", encoding="utf-8") as f:
        parser.write(f)


def tool_allowed(path: str, wanted_hash: str = "", trusted: tuple[str, ...] = ("/usr/bin", "/usr/local/bin", "/bin")) -> tuple[bool, str]:
    """Whether an external metadata tool may run, and why not: in a trusted folder it may, elsewhere only with the right SHA-256; a hash that
    is set has to match everywhere."""
    real = os.path.realpath(path)
    if not wanted_hash and os.path.dirname(real) in trusted:
        return True, ""
    if not wanted_hash:
        return False, "Security Error: the tool lies in a folder that is not trusted and no hash is set"
    try:
        with open(real, "rb") as f:
            own = hashlib.file_digest(f, "sha256").hexdigest()
    except OSError as e:
        return False, f"Security Error: {e}"
    return (True, "") if own == wanted_hash.strip().lower() else (False, "Security Error: hash mismatch")
