"""Options of the workflows: defaults, and bounds that are checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


def _within(name: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} must be between {least:g} and {most:g}")


#: The adapters that paired trimming takes when none are given.
ADAPTER_1, ADAPTER_2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"


@dataclass(frozen=True)
class TrimOptions:
    adapter: str = ADAPTER_1
    adapter2: str = ADAPTER_2
    min_overlap: int = 6
    max_mismatches: int = 0
    quality: int = 20
    min_length: int = 20

    def __post_init__(self) -> None:
        for a in (self.adapter, self.adapter2):
            if not a or set(a) - set("ACGTN"):
                raise ValueError("an adapter is letters of ACGTN")
            if self.min_overlap > len(a):
                raise ValueError("min_overlap must not exceed the adapter")
        _within("min_overlap", self.min_overlap, 3, 64)
        _within("max_mismatches", self.max_mismatches, 0, min(8, self.min_overlap - 1))
        _within("quality", self.quality, 0, 60)
        _within("min_length", self.min_length, 1, 1_000_000)


@dataclass(frozen=True)
class AlignOptions:
    max_mismatches: int = 2

    def __post_init__(self) -> None:
        _within("max_mismatches", self.max_mismatches, 0, 12)


@dataclass(frozen=True)
class SnvOptions:
    min_depth: int = 3
    min_alt_count: int = 2
    min_alt_fraction: float = 0.2
    min_mapq: int = 20
    min_base_quality: int = 20

    def __post_init__(self) -> None:
        _within("min_depth", self.min_depth, 1, 1_000_000)
        _within("min_alt_count", self.min_alt_count, 1, 1_000_000)
        _within("min_alt_fraction", self.min_alt_fraction, 0.01, 1)
        _within("min_mapq", self.min_mapq, 0, 60)
        _within("min_base_quality", self.min_base_quality, 0, 60)


@dataclass(frozen=True)
class VcfQcOptions:
    """A threshold of None switches its filter off."""

    min_dp: int | None = 3
    min_ac: int | None = 2
    min_af: float | None = 0.2
    min_abq: float | None = 20.0

    def __post_init__(self) -> None:
        for name, most in (("min_dp", 1_000_000), ("min_ac", 1_000_000), ("min_af", 1), ("min_abq", 10_000)):
            if (v := getattr(self, name)) is not None:
                _within(name, v, 0, most)


def options_from(kind: type, given: dict):
    """kind(**given), but an unknown name says which it is."""
    if unknown := set(given) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return kind(**given)
