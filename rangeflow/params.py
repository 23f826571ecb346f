"""Validated extraction parameters."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

#: forward: only forward reads, only reverse reads, both, or both kept apart ("split").
STRANDS = (True, False, None, "split")
PAIRED = ("none", "both", "first", "second")


@dataclass(frozen=True)
class ExtractParams:
    """How alignments become fragments.

    pe: single-end reads ("none"), pairs ("both"), or one read of each pair. max_frag: longest pair.
    min_mapq None: no threshold. restrict: axes to use, None for all. discard: (chrom, start, end)
    ranges; alignments wholly inside one are dropped.
    """

    pe: str = "none"
    max_frag: int | None = 500
    dedup: bool = False
    min_mapq: int | None = None
    forward: bool | str | None = None
    restrict: tuple[str, ...] | None = None
    discard: DataFrame | None = None

    def __post_init__(self):
        if self.pe not in PAIRED:
            raise ValueError(f"pe must be one of {PAIRED}")
        if self.forward not in STRANDS:
            raise ValueError(f"forward must be one of {STRANDS}")
        if self.max_frag is not None and self.max_frag <= 0:
            raise ValueError("max_frag must be positive")
        if self.pe == "both" and self.forward is not None:
            raise ValueError("pairs have no single strand: forward can't be set with pe='both'")
        if self.restrict is not None:
            object.__setattr__(self, "restrict", tuple(map(str, self.restrict)))
        if self.discard is not None and not {"chrom", "start", "end"} <= set(self.discard.columns):
            raise ValueError("discard needs chrom, start and end")

    def reform(self, **changes) -> ExtractParams:
        """A copy with changes; names may be shortened as long as they are unique."""
        full = {}
        for name, value in changes.items():
            matches = [f.name for f in fields(self) if f.name == name] or [f.name for f in fields(self) if f.name.startswith(name)]
            if len(matches) != 1:
                raise ValueError(f"{name} names {'no' if not matches else 'several'} parameters")
            full[matches[0]] = value
        return replace(self, **full)

    @property
    def strand_label(self) -> str:
        return {True: "+", False: "-"}.get(self.forward, "*")

    def __str__(self) -> str:
        lines = [f"extracting {'pairs' if self.pe == 'both' else 'single reads' if self.pe == 'none' else f'the {self.pe} read of each pair'}"]
        if self.pe == "both":
            lines.append(f"longest pair: {self.max_frag}")
        lines.append(f"duplicates: {'removed' if self.dedup else 'kept'}; least mapping quality: {self.min_mapq if self.min_mapq is not None else 'none'}")
        lines.append(f"strand: {self.strand_label}; axes: {', '.join(self.restrict) if self.restrict else 'all'}; discard: {'set' if self.discard is not None else 'none'}")
        return "\n".join(lines)


def fragment_lengths(ext, libraries: list[str]) -> tuple[dict[str, int | None], int | None]:
    """(extension of each library, final length) from ext.

    ext is a length, None (use the read length), or (lengths of each library, final length); with
    lengths that differ the final length is needed, and None for it means their mean, truncated.
    """
    if not isinstance(ext, tuple):
        _positive(ext)
        return dict.fromkeys(libraries, ext), None
    each, final = ext
    each = [each] * len(libraries) if each is None or isinstance(each, int) else list(each)
    if len(each) != len(libraries):
        raise ValueError("one extension for each library is needed")
    for x in [*each, final]:
        _positive(x)
    if final is None:
        if None in each:
            raise ValueError("read lengths have no mean before they are read: give a final length")
        final = int(sum(each) / len(each))
    return dict(zip(libraries, each, strict=True)), final


def _positive(x) -> None:
    if x is not None and x <= 0:
        raise ValueError("fragment lengths must be positive")


def warn(text: str) -> None:
    warnings.warn(text, stacklevel=3)
