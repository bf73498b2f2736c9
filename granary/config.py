"""Settings of a store, and the index presets."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, fields, replace

#: Fixed values of the store format.
CONTAINER_BYTES, CONTAINER_META_BYTES = 4_194_304, 32_768
CONTAINER_PAYLOAD = CONTAINER_BYTES - CONTAINER_META_BYTES
META_HEADER, META_ENTRY_FIELDS = 16, 8
SHA1_BYTES, SHA256_BYTES = 20, 32
CACHE_ENTRY_BYTES = 60
FEATURES_PER_RECIPE = 8


def entries_per_container(fp_bytes: int, meta_bytes: int = CONTAINER_META_BYTES) -> int:
    """The most chunks of a container: (n + 1) entries and the header must not exceed
    the metadata area when one more is added."""
    return (meta_bytes - META_HEADER) // (fp_bytes + META_ENTRY_FIELDS)


@dataclass(frozen=True)
class StoreConfig:
    """One field for each directive."""

    working_directory: str = "."
    simulation_level: str = "no"
    fake_containers: bool = False
    direct_reads: bool = False
    upgrade_phase: int = 0
    trace_format: str = "text"
    log_level: str = "notice"
    chunk_algorithm: str = "rabin"
    chunk_avg_size: int = 8192
    chunk_max_size: int = 65536
    chunk_min_size: int = 1024
    index_category: str = "exact"
    index_locality: str = "physical"
    index_preset: str | None = None
    index_cache_size: int = 4096
    external_cache_size: int = 0
    recipe_cdc_ratio: int = 0
    recipe_cdc_max_size: int = 0
    recipe_cdc_exp_size: int = 0
    recipe_cdc_min_size: int = 0
    index_key_value: str = "htable"
    upgrade_external_store: str = "rocksdb"
    index_key_size: int = 20
    index_value_length: int = 1
    bloom_filter_size: int = 0
    sampling_method: str = "uniform"
    sampling_ratio: int = 1
    segment_algorithm: str = "fixed"
    segment_avg: int = 1024
    segment_min: int = 128
    segment_max: int = 10240
    segment_selection: str = "base"
    segment_top_k: int = 1
    segment_prefetch: int = 0
    rewrite_algorithm: str = "no"
    rewrite_buffer: int = 1024
    cfl_switch: bool = False
    cfl_require: float = 0.6
    cfl_usage_threshold: float = 0.03
    cbr_limit: float = 0.05
    cbr_minimal_utility: float = 0.7
    capping_level: int = 20
    har: bool = False
    har_utilization_threshold: float = 0.5
    har_rewrite_limit: float = 0.05
    cache_aware: bool = False
    restore_cache: str = "lru"
    restore_cache_containers: int = 1024
    restore_opt_window: int = 1_000_000
    backup_retention: int = -1
    container_payload: int = CONTAINER_PAYLOAD

    def resolved(self) -> StoreConfig:
        """With the preset's settings, and the consequences of an exact index."""
        out = replace(self, **PRESETS.get(self.index_preset or "", {}))
        if out.index_category == "exact":
            out = replace(out, index_key_size=32, sampling_method="uniform", sampling_ratio=1)
            if out.index_locality == "physical":
                out = replace(out, segment_algorithm="fixed", segment_selection="base")
        return out

    def problems(self) -> list[str]:
        """What makes the settings unusable, if anything."""
        out = []
        if self.simulation_level not in ("no", "restore", "append", "all"):
            out.append("simulation-level")
        if self.index_preset is not None and self.index_preset not in PRESETS:
            out.append("fingerprint-index preset")
        if not 0 < self.chunk_min_size <= self.chunk_avg_size <= self.chunk_max_size:
            out.append("chunk sizes")
        if not 0 < self.index_key_size <= 32:
            out.append("fingerprint-index-key-size")
        return out


def levels_agree(last: str, now: str) -> bool:
    """Whether a store written at one simulation level can be used at another: whole
    containers and those without data do not mix."""
    whole = ("no", "restore")
    return (last in whole) == (now in whole)


#: Index designs, by the names that a configuration gives them.
PRESETS: dict[str, dict] = {
    "ddfs": {"index_category": "exact", "index_locality": "physical", "segment_algorithm": "fixed"},
    "block locality caching": {"index_category": "exact", "index_locality": "logical", "segment_prefetch": 16},
    "sampled index": {"index_category": "near-exact", "index_locality": "physical", "sampling_method": "uniform", "sampling_ratio": 128, "segment_algorithm": "fixed"},
    "sparse index": {"index_category": "near-exact", "index_locality": "logical", "sampling_method": "random", "sampling_ratio": 128, "segment_algorithm": "content-defined", "segment_selection": "top", "segment_prefetch": 1},
    "silo": {"index_category": "near-exact", "index_locality": "logical", "sampling_method": "min", "sampling_ratio": 0, "segment_algorithm": "fixed", "segment_selection": "top", "segment_top_k": 1, "segment_prefetch": 16},
    "extreme binning": {"index_category": "near-exact", "index_locality": "logical", "sampling_method": "min", "sampling_ratio": 0, "segment_algorithm": "file-defined", "segment_selection": "top", "segment_top_k": 1 << 30, "segment_prefetch": 0},
}

#: Directive -> field, and how its arguments are read.
_NUMBERS = {
    "upgrade-phase": "upgrade_phase", "chunk-avg-size": "chunk_avg_size", "chunk-max-size": "chunk_max_size", "chunk-min-size": "chunk_min_size",
    "fingerprint-index-cache-size": "index_cache_size", "fingerprint-external-cache-size": "external_cache_size", "recipe-cdc-ratio": "recipe_cdc_ratio",
    "recipe-cdc-max-size": "recipe_cdc_max_size", "recipe-cdc-exp-size": "recipe_cdc_exp_size", "recipe-cdc-min-size": "recipe_cdc_min_size",
    "fingerprint-index-key-size": "index_key_size", "fingerprint-index-value-length": "index_value_length", "fingerprint-index-bloom-filter": "bloom_filter_size",
    "fingerprint-index-segment-prefetching": "segment_prefetch", "rewrite-capping-level": "capping_level", "restore-opt-window-size": "restore_opt_window",
    "backup-retention-time": "backup_retention",
}
_SHARES = {
    "rewrite-cfl-require": "cfl_require", "rewrite-cfl-usage-threshold": "cfl_usage_threshold", "rewrite-cbr-limit": "cbr_limit",
    "rewrite-cbr-minimal-utility": "cbr_minimal_utility", "rewrite-har-utilization-threshold": "har_utilization_threshold", "rewrite-har-rewrite-limit": "har_rewrite_limit",
}
_FLAGS = {
    "fake-containers": "fake_containers", "direct-reads": "direct_reads", "rewrite-enable-cfl-switch": "cfl_switch", "rewrite-enable-har": "har",
    "rewrite-enable-cache-aware": "cache_aware",
}
_WORDS = {
    "working-directory": "working_directory", "simulation-level": "simulation_level", "trace-format": "trace_format", "log-level": "log_level",
    "chunk-algorithm": "chunk_algorithm", "fingerprint-index-key-value": "index_key_value", "upgrade-external-store": "upgrade_external_store",
}


def yes(word: str) -> bool:
    """yes or 1, no or 0."""
    if word.lower() in ("yes", "1"):
        return True
    if word.lower() in ("no", "0"):
        return False
    raise ValueError(f"yes or no, not {word!r}")


def _pairs(words: list[str], names: tuple[str, ...]) -> dict:
    return {n: int(w) if w.lstrip("-").isdigit() else w for n, w in zip(names, words, strict=False)}


def parse_config(text: str, base: StoreConfig | None = None) -> StoreConfig:
    """Lines of `directive value ...`; # begins a comment, quotes hold words together."""
    out: dict = {}
    for number, line in enumerate(text.splitlines(), 1):
        words = shlex.split(line, comments=True)
        if not words:
            continue
        name, args = words[0].lower(), words[1:]
        if not args:
            raise ValueError(f"line {number}: {name} has no value")
        if name in _NUMBERS:
            out[_NUMBERS[name]] = int(args[0])
        elif name in _SHARES:
            out[_SHARES[name]] = float(args[0])
        elif name in _FLAGS:
            out[_FLAGS[name]] = yes(args[0])
        elif name in _WORDS:
            out[_WORDS[name]] = args[0].lower() if name != "working-directory" else args[0]
        elif name == "fingerprint-index":
            out |= _pairs([a.lower() for a in args[:2]], ("index_category", "index_locality"))
            if len(args) > 2:
                out["index_preset"] = args[2].lower()
        elif name == "fingerprint-index-sampling-method":
            out |= _pairs(args, ("sampling_method", "sampling_ratio"))
        elif name == "fingerprint-index-segment-algorithm":
            out |= _pairs(args, ("segment_algorithm", "segment_avg"))
        elif name == "fingerprint-index-segment-boundary":
            out |= _pairs(args, ("segment_min", "segment_max"))
        elif name == "fingerprint-index-segment-selection":
            out |= _pairs(args, ("segment_selection", "segment_top_k"))
        elif name == "rewrite-algorithm":
            out |= _pairs(args, ("rewrite_algorithm", "rewrite_buffer"))
        elif name == "restore-cache":
            out |= _pairs(args, ("restore_cache", "restore_cache_containers"))
        else:
            raise ValueError(f"line {number}: unknown directive {name}")
    return replace(base or StoreConfig(), **out)


def apply_overrides(config: StoreConfig, text: str) -> StoreConfig:
    """Settings on a command line: directives parted by a comma and a space."""
    return parse_config("\n".join(text.split(", ")), config)


DIRECTIVES = sorted({*_NUMBERS, *_SHARES, *_FLAGS, *_WORDS, "fingerprint-index", "fingerprint-index-sampling-method", "fingerprint-index-segment-algorithm", "fingerprint-index-segment-boundary", "fingerprint-index-segment-selection", "rewrite-algorithm", "restore-cache"})
FIELDS = [f.name for f in fields(StoreConfig)]
