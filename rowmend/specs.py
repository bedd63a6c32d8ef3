"""Job descriptions: plain frozen dataclasses that round-trip through JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from rowmend.columns import unique

WRITE_MODES = ("keep_input", "fill_if_blank", "overwrite")
KEY_TYPES = ("text", "mobile")
RESULT_COLUMNS = ("match_status", "reason")


@dataclass(frozen=True)
class Mapping:
    """One fetched lookup column and where it lands in the output."""

    lookup_column: str
    destination_type: str = "new"
    new_column_name: str = ""
    target_existing_column: str = ""
    write_mode: str = "keep_input"
    mandatory: bool = False

    @property
    def target(self) -> str:
        if self.destination_type == "existing":
            return self.target_existing_column
        return self.new_column_name


@dataclass(frozen=True)
class LookupSource:
    """One lookup table; `row_order` names a whole-number column that orders its rows.

    `file_order` names a column that tells where a row stands in a run of files; all sources of
    a kind that have one are ordered by it together, whichever source a file is in.
    """

    frame: DataFrame
    kind: str = "main_lookup"
    row_order: str = ""
    file_order: str = ""


@dataclass(frozen=True)
class LookupSpec:
    input_key: str
    keep_columns: tuple[str, ...]
    main_key: str
    main_mappings: tuple[Mapping, ...]
    special_key: str = ""
    special_mappings: tuple[Mapping, ...] = ()
    key_type: str = "text"

    @property
    def mappings(self) -> tuple[Mapping, ...]:
        return (*self.main_mappings, *self.special_mappings)

    @property
    def targets(self) -> list[str]:
        """Fetched output columns, first mention first."""
        return unique(m.target for m in self.mappings if m.target.strip())

    @property
    def headers(self) -> dict[str, list[str]]:
        """Column lists of the three outputs."""
        base = unique([*self.keep_columns, *self.targets])
        return {
            "matched": base,
            "unmatched": unique([*base, "reason"]),
            "consolidated": unique([*base, *RESULT_COLUMNS]),
        }

    def write_mode(self, target: str) -> str:
        """Mode for a target the input already has; added columns never replace input."""
        modes = [m.write_mode for m in self.mappings
                 if m.target == target and m.destination_type == "existing"]
        return modes[0] if modes else "keep_input"

    def validate(self, input_columns: Iterable[str]) -> None:
        columns = list(input_columns)
        if self.input_key not in columns:
            raise ValueError(f"input key column {self.input_key!r} not found")
        if self.key_type not in KEY_TYPES:
            raise ValueError(f"unknown key type {self.key_type!r}")
        taken = [c for c in RESULT_COLUMNS if c in [*columns, *self.targets]]
        if taken:
            raise ValueError(f"column names reserved for the result: {taken}")
        for side in (self.main_mappings, self.special_mappings):
            fetched = [m.lookup_column for m in side if m.lookup_column]
            repeated = unique(c for c in fetched if fetched.count(c) > 1)
            if repeated:
                raise ValueError(f"lookup columns mapped twice: {repeated}")
        for m in self.mappings:
            if m.write_mode not in WRITE_MODES:
                raise ValueError(f"unknown write mode {m.write_mode!r}")
        for target in self.targets:
            modes = {m.write_mode for m in self.mappings
                     if m.target == target and m.destination_type == "existing"}
            if len(modes) > 1:
                raise ValueError(f"conflicting write modes for {target!r}: {sorted(modes)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> LookupSpec:
        raw = json.loads(text)
        for side in ("main_mappings", "special_mappings"):
            raw[side] = tuple(Mapping(**m) for m in raw.get(side, ()))
        raw["keep_columns"] = tuple(raw["keep_columns"])
        return cls(**raw)


def map_all(columns: Iterable[str], key: str) -> tuple[Mapping, ...]:
    """Fetch every column but the key under its own name."""
    return tuple(Mapping(c, new_column_name=c) for c in columns if c != key)


@dataclass(frozen=True)
class CleanSpec:
    """Rules of the cleaning job; rule dictionaries keep the keys of the JSON form."""

    rename_map: dict[str, str] = field(default_factory=dict)
    replacement_rules: list[dict[str, Any]] = field(default_factory=list)
    cols_to_drop: list[str] = field(default_factory=list)
    add_rules: list[dict[str, Any]] = field(default_factory=list)
    filter_rules: list[dict[str, Any]] = field(default_factory=list)
    final_columns: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> CleanSpec:
        return cls(**json.loads(text))
