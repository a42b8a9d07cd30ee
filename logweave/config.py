"""Settings of a log: presets, sizes derived from a memory budget, and checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

MIB = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values of the log's format and upkeep; times are in seconds, sizes in bytes."""

    max_file_size: int = 256 * MIB
    min_compress_size: int = 4096
    index_interval: int = 100
    max_index_nodes: int = 10_000
    checkpoint_s: float = 2.0
    checkpoint_entries: int = 100_000
    flush_s: float = 1.0
    flush_entries: int = 50_000
    max_age_s: float = 7 * 86400.0
    cleanup_s: float = 3600.0
    process: int = 0
    processes: int = 0


#: How the presets differ from the defaults.
PRESETS = {
    "default": {},
    "high compression": {"min_compress_size": 512},
    "high throughput": {"checkpoint_s": 10.0, "checkpoint_entries": 200_000, "flush_entries": 100_000, "min_compress_size": MIB, "index_interval": 1000},
}


def preset(name: str = "default", **changes) -> Settings:
    return checked(Settings(**(PRESETS[name] | changes)))


def for_shards(shards: int, budget_mib: int) -> Settings:
    """Segments share the budget, each between 10 MiB and 1 GiB; many shards are checkpointed less often."""
    size = sorted((10, budget_mib // shards, 1024))[1]
    return Settings(max_file_size=size * MIB, checkpoint_s=5.0 if shards >= 256 else Settings.checkpoint_s)


def open_files(max_file_size: int, memory: int = 2 << 30) -> int:
    """How many segments a reader keeps: twice what fits into memory at four fifths of their size, ten at least."""
    return 10 if max_file_size <= 0 else max(10, 2 * (memory // max(max_file_size * 4 // 5, 1)))


def checked(own: Settings) -> Settings:
    """own, with defaults for values out of range; an impossible share of processes is an error."""
    if own.processes < 0 or own.processes > 0 and not 0 <= own.process < own.processes:
        raise ValueError(f"process {own.process} is not one of {own.processes}")
    positive = ("max_file_size", "checkpoint_s", "checkpoint_entries", "index_interval")
    wrong = [n for n in positive if getattr(own, n) <= 0] + [n for n in ("flush_entries", "min_compress_size") if getattr(own, n) < 0]
    own = replace(own, **{n: getattr(Settings, n) for n in wrong})
    return replace(own, checkpoint_entries=2 * own.flush_entries) if own.checkpoint_entries < own.flush_entries else own
