"""What a document consists of: typed fields, groups of fields, an external id."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.stages import STRING, U64, USIZE


class Supplement(Enum):
    """A side structure of a field: none, facets, or a hierarchy."""

    NONE = "none"
    FILTER = "filter"
    HIERARCHY = "hierarchy"


#: Term types besides text and unsigned numbers: any flat type of Spark that has a text form and an order.
OTHER_TYPES = re.compile(r"date|timestamp|boolean|tinyint|smallint|int|bigint|float|double|decimal\(\d+,\d+\)")


@dataclass(frozen=True)
class FieldDef:
    """A field: an inverted index over terms of one type. ``term_doc_ratio`` divides its terms' weights."""

    name: str
    type: str = STRING
    no_pipe: bool = False
    filter: bool = False
    term_doc_ratio: float = 1.0
    supplement: Supplement = Supplement.NONE
    group: str | None = None

    def __post_init__(self) -> None:
        if self.type not in (STRING, U64, USIZE) and not OTHER_TYPES.fullmatch(self.type):
            raise ValueError(f"field {self.name}: no such term type: {self.type}")
        if not self.term_doc_ratio > 0:
            raise ValueError(f"field {self.name}: term_doc_ratio must be positive")
        if self.filter and self.supplement is Supplement.NONE:
            object.__setattr__(self, "supplement", Supplement.FILTER)

    @property
    def numeric(self) -> bool:
        """Whether terms are stored as unsigned numbers; all others are stored as text."""
        return self.type in (U64, USIZE)

    def encode(self, term: Column) -> tuple[Column, Column]:
        """A term of the field's type as its stored text and number, one of which is null."""
        if self.numeric:
            return F.lit(None).cast("string"), term.cast("decimal(20,0)")
        return (term if self.type == STRING else term.cast(self.type)).cast("string"), F.lit(None).cast("decimal(20,0)")

    def decode(self, key: Column) -> Column:
        """A stored term's text as a value of the field's type, by which terms order."""
        return key if self.type == STRING else key.cast("decimal(20,0)" if self.numeric else self.type)


@dataclass(frozen=True)
class FieldGroup:
    """A named set of fields of one type that can grow at run time; queries of the group search all of them."""

    name: str
    type: str = STRING


@dataclass
class DocumentSchema:
    """The fields and groups of a document, and the type of its external id, if it has one."""

    fields: dict[str, FieldDef] = field(default_factory=dict)
    groups: dict[str, FieldGroup] = field(default_factory=dict)
    external_id: str | None = None

    @classmethod
    def of(cls, *members: FieldDef | FieldGroup, external_id: str | None = None) -> DocumentSchema:
        out = cls(external_id=external_id)
        for m in members:
            out.add(m)
        return out

    def add(self, member: FieldDef | FieldGroup) -> None:
        if member.name in self.fields or member.name in self.groups:
            raise ValueError(f"there already is a field {member.name}")
        (self.groups if isinstance(member, FieldGroup) else self.fields)[member.name] = member

    def add_field(self, group: str, name: str, supplement: Supplement = Supplement.NONE, term_doc_ratio: float = 1.0) -> FieldDef:
        """A new field of a group; ValueError if the name is taken."""
        new = FieldDef(name, self.groups[group].type, supplement=supplement, term_doc_ratio=term_doc_ratio, group=group)
        self.add(new)
        return new

    def set_ratio(self, name: str, ratio: float) -> None:
        self.fields[name] = replace(self.fields[name], term_doc_ratio=ratio)

    def members(self, target: str) -> list[FieldDef]:
        """The fields that a target names: a field itself, or all of a group."""
        if target in self.groups:
            return [f for f in self.fields.values() if f.group == target]
        return [self.fields[target]]

    def targets(self) -> dict[str, str]:
        return {n: f.type for n, f in self.fields.items()} | {n: g.type for n, g in self.groups.items()}
