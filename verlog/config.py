"""Settings: defaults, a simple file of sections, and the environment, each over the one before."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """The defaults that logs are kept with."""

    memtable_write_buffer_size: int = 4 << 20
    wal_segment_size_bytes: int = 64 << 20
    bloom_bits_per_key: int = 10
    compaction_output_file_size_bytes: int = 64 << 20
    compaction_level_max_bytes: int = 256 << 20
    compaction_min_input_files: int = 2
    auto_compaction_enabled: bool = True
    expiry_cleanup_interval_ms: int = 1000
    cache_capacity: int = 1024
    cache_ttl_ms: int = 0
    requirepass: str = ""
    virtual_nodes: int = 8


def _value(text: str, kind: str):
    text = text.strip().strip("\"'")
    if kind == "bool":
        if text.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"not a yes or no: {text}")
        return text.lower() in ("true", "1", "yes", "on")
    return int(text) if kind == "int" else text


def parse_sections(text: str) -> dict[str, str]:
    """`section:` lines with indented `name: value` lines; the names alone matter, cache's get a prefix."""
    out, section = {}, ""
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        name, colon, value = line.strip().partition(":")
        if not colon:
            continue
        if not line[:1].isspace():
            section = name
        if value.strip():
            out[f"cache_{name}" if section == "cache" and not name.startswith("cache") else name] = value
    return out


def load(text: str = "", env: Mapping[str, str] | None = None, prefix: str = "KV_") -> Options:
    found = parse_sections(text) | {k.removeprefix(prefix).lower(): v for k, v in (env or {}).items() if k.startswith(prefix)}
    return Options(**{f.name: _value(found[f.name], f.type) for f in fields(Options) if f.name in found})
