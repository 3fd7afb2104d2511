"""Construct specifications: which fixed and variable regions a read holds, and what follows from that."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from readweave.errors import SpecError

_COMPLEMENT = str.maketrans("ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


@dataclass(frozen=True)
class Region:
    """A region of the construct: fixed if ``seq`` is given, else variable."""

    id: str
    seq: str | None = None
    min_length: int = 0
    max_length: int = 0
    max_distance: int | None = None

    @property
    def fixed(self) -> bool:
        return self.seq is not None

    @property
    def longest(self) -> int:
        return len(self.seq) if self.seq is not None else self.max_length

    def letters(self, shortest: bool = False) -> str:
        if self.seq is not None:
            return self.seq
        return "N" * (self.min_length if shortest else self.max_length)


@dataclass(frozen=True)
class Flanks:
    """Fixed sequences beside a variable region; an absent one is None."""

    before: str | None
    after: str | None


@dataclass(frozen=True)
class LibrarySpec:
    id: str
    forward_start_region: str
    forward_read_length: int
    reverse_start_region: str
    reverse_read_length: int
    regions: tuple[Region, ...] = field(default_factory=tuple)

    @classmethod
    def from_dict(cls, data: dict, **overrides) -> LibrarySpec:
        """Build and validate; ``overrides`` replace start regions and read lengths that are not None."""
        try:
            regions = []
            for r in data["regions"]:
                kind = r["seq_type"]
                if isinstance(kind, dict):  # {"Fixed": {...}} or {"Library": {...}}
                    ((kind, body),) = kind.items()
                    r = {**r, **body}
                if kind == "Fixed":
                    regions.append(Region(r["id"], seq=r["seq"]))
                elif kind == "Library":
                    regions.append(Region(r["id"], None, int(r["min_length"]), int(r["max_length"]), r.get("max_distance")))
                else:
                    raise SpecError([f"unknown seq_type {kind!r} of region {r['id']!r}"])
            spec = cls(
                data["id"], data["forward_start_region"], int(data["forward_read_length"]),
                data["reverse_start_region"], int(data["reverse_read_length"]), tuple(regions),
            )
        except (KeyError, TypeError, ValueError) as e:
            raise SpecError([f"malformed specification: {e!r}"]) from e
        spec.validate()
        given = {k: v for k, v in overrides.items() if v is not None}
        if given:
            spec = replace(spec, **given)
            spec.validate()
        return spec

    @classmethod
    def from_json(cls, path: str | Path, **overrides) -> LibrarySpec:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise SpecError([f"cannot read {path}: {e}"]) from e
        return cls.from_dict(data, **overrides)

    def validate(self) -> None:
        """Raise one error that names every problem."""
        problems, ids = [], [r.id for r in self.regions]
        for which in (self.forward_start_region, self.reverse_start_region):
            if which not in ids:
                problems.append(f"start region {which!r} is not a region")
        problems += [f"region id {i!r} is not unique" for i in sorted({i for i in ids if ids.count(i) > 1})]
        problems += [f"region {r.id!r}: min_length exceeds max_length" for r in self.regions if not r.fixed and r.min_length > r.max_length]
        problems += [
            f"variable regions {a.id!r} and {b.id!r} are adjacent"
            for a, b in zip(self.regions, self.regions[1:]) if not a.fixed and not b.fixed
        ]
        if problems:
            raise SpecError(problems)

    @property
    def variable(self) -> list[Region]:
        return [r for r in self.regions if not r.fixed]

    def max_distances(self) -> dict[str, int]:
        return {r.id: r.max_distance for r in self.variable if r.max_distance is not None}

    def n_variable_length(self) -> int:
        return sum(r.min_length != r.max_length for r in self.variable)

    def template(self) -> str:
        """The whole construct with N for every variable base, at maximum lengths."""
        return "".join(r.letters() for r in self.regions)

    def position(self, region: str) -> tuple[int, int]:
        """Half-open 0-based place of a region in the template."""
        at = 0
        for r in self.regions:
            if r.id == region:
                return at, at + r.longest
            at += r.longest
        raise SpecError([f"no region {region!r}"])

    def _index(self, region: str) -> int:
        return next(i for i, r in enumerate(self.regions) if r.id == region)

    def expected_forward(self) -> str:
        parts = [r.letters(shortest=True) for r in self.regions[self._index(self.forward_start_region) :]]
        return "".join(parts)[: self.forward_read_length]

    def expected_reverse(self) -> str:
        """What a reverse read looks like, in its own orientation."""
        upto = self.regions[: self._index(self.reverse_start_region) + 1]
        parts = [reverse_complement(r.letters(shortest=True)) for r in reversed(upto)]
        return "".join(parts)[: self.reverse_read_length]

    def flanks(self, region: str, length: int) -> Flanks:
        """Up to ``length`` bases of the unbroken fixed sequence on either side."""
        at = self._index(region)
        before = after = ""
        for r in reversed(self.regions[:at]):
            if not r.fixed or len(before) >= length:
                break
            before = (r.seq or "") + before
        for r in self.regions[at + 1 :]:
            if not r.fixed or len(after) >= length:
                break
            after += r.seq or ""
        return Flanks(before[-length:] if before and length else None, after[:length] if after and length else None)

    def all_flanks(self, length: int) -> list[Flanks]:
        """Flanks of all variable regions; they must allow the scan to tell where each region lies."""
        flanks = [self.flanks(r.id, length) for r in self.variable]
        problems = []
        for i, (r, f) in enumerate(zip(self.variable, flanks)):
            if f.before is None and f.after is None:
                problems.append(f"region {r.id!r} has no fixed flank")
            elif f.before is None and i > 0:
                problems.append(f"region {r.id!r} has no fixed sequence before it and is not the first")
            elif f.after is None and i < len(flanks) - 1:
                problems.append(f"region {r.id!r} has no fixed sequence after it and is not the last")
        if problems:
            raise SpecError(problems)
        return flanks
