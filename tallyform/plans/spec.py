"""Target specifications and mapping plans: small driver-side documents that compile to Columns."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions import fixed


class SpecError(ValueError):
    """A target specification or plan that cannot be compiled."""


class ApprovalError(ValueError):
    """A write was asked for with a plan that is not approved, or was changed since."""


def check_identifier(name: Any, label: str = "identifier") -> str:
    clean = str(name).strip()
    if not re.match(fixed.IDENTIFIER_PATTERN, clean):
        raise SpecError(f"Invalid {label} {name!r}: letters, digits and underscores only, 64 characters at most")
    return clean


def spark_type(data_type: str) -> T.DataType:
    """Storage type of a declared type name."""
    name = data_type.lower().strip()
    if name in fixed.INTEGER_TYPES:
        return T.LongType()
    if name in fixed.FLOAT_TYPES or name in fixed.MONEY_STORAGE_TYPES:
        return T.DoubleType()
    if name in fixed.BOOLEAN_TYPES:
        return T.BooleanType()
    if name in fixed.BINARY_TYPES:
        return T.BinaryType()
    return T.StringType()


@dataclass(frozen=True)
class TargetField:
    name: str
    data_type: str = "string"
    nullable: bool = True
    default: Any = None
    constraints: dict[str, Any] = field(default_factory=dict)

    @property
    def allowed(self) -> list[Any]:
        return list(self.constraints.get("enum") or self.constraints.get("allowed_values") or [])

    @property
    def pattern(self) -> str | None:
        return self.constraints.get("regex") or self.constraints.get("pattern") or None

    @property
    def unique(self) -> bool:
        return bool(self.constraints.get("unique"))


def _key_list(raw: Any) -> tuple[str, ...]:
    if not raw:
        return ()
    return tuple(str(k) for k in raw) if isinstance(raw, (list, tuple)) else (str(raw),)


@dataclass(frozen=True)
class TargetSpec:
    table_name: str
    fields: tuple[TargetField, ...]
    natural_key: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    schema_id: str = ""
    document: dict[str, Any] = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> TargetSpec:
        table = check_identifier(doc.get("table_name") or "target_records", "table name")
        fields = tuple(
            TargetField(
                name=check_identifier(f["name"], "column name"),
                data_type=f.get("data_type") or f.get("type") or "string",
                nullable=f.get("nullable", True),
                default=f.get("default"),
                constraints=dict(f.get("constraints") or {}),
            )
            for f in doc.get("fields", [])
        )
        if not fields:
            raise SpecError(f"Target schema for table {table!r} must define at least one field")
        natural = _key_list(doc.get("natural_key") or doc.get("primary_key"))
        primary = _key_list(doc.get("primary_key") or natural)
        return cls(table, fields, natural, primary, doc.get("schema_id", f"schema_{table}"), copy.deepcopy(doc))

    @classmethod
    def from_json(cls, path: str) -> TargetSpec:
        with open(path, encoding="utf-8") as fh:
            return cls.from_dict(json.load(fh))

    def by_name(self) -> dict[str, TargetField]:
        return {f.name: f for f in self.fields}

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.data_type), True) for f in self.fields])

    def keys(self) -> tuple[str, ...]:
        """Upsert key columns: a declared natural key, else the primary key."""
        names = self.by_name()
        if self.natural_key and all(k in names for k in self.natural_key):
            return self.natural_key
        if "natural_key" in names:
            return ("natural_key",)
        return tuple(k for k in self.primary_key if k in names) or (self.fields[0].name,)

    def surrogate(self) -> str | None:
        """The primary-key column, when it is not itself the upsert key."""
        names = self.by_name()
        found = [k for k in self.primary_key if k in names and k not in self.keys()]
        return found[0] if found else None


@dataclass(frozen=True)
class FieldMapping:
    target_field: str
    source_fields: tuple[str, ...]
    transformation: str
    parameters: dict[str, Any] = field(default_factory=dict)
    risk_level: str = "LOW"
    risk_rationale: str = ""
    notes: str = ""

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> FieldMapping:
        return cls(
            target_field=doc["target_field"],
            source_fields=tuple(doc.get("source_fields") or ()),
            transformation=doc["transformation"],
            parameters=copy.deepcopy(doc.get("parameters") or {}),
            risk_level=doc.get("risk_level", "LOW"),
            risk_rationale=doc.get("risk_rationale", ""),
            notes=doc.get("notes", ""),
        )

    def canonical(self) -> dict[str, Any]:
        return {
            "target_field": self.target_field,
            "source_fields": list(self.source_fields),
            "transformation": self.transformation,
            "parameters": self.parameters,
        }


@dataclass(frozen=True)
class Question:
    """An open policy question about one field and the answer given."""

    question_id: str
    field: str
    question: str
    options: tuple[str, ...] = ()
    answer: str | None = None


@dataclass(frozen=True)
class Plan:
    plan_id: str
    version: int
    mappings: tuple[FieldMapping, ...]
    source_schema_id: str = ""
    target_schema_id: str = ""
    status: str = "PROPOSED"
    approval_fingerprint: str | None = None
    approved_by: str | None = None
    questions: tuple[Question, ...] = ()

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> Plan:
        return cls(
            plan_id=doc["plan_id"],
            version=int(doc.get("version", 1)),
            mappings=tuple(FieldMapping.from_dict(m) for m in doc["field_mappings"]),
            source_schema_id=doc.get("source_schema_id", ""),
            target_schema_id=doc.get("target_schema_id", ""),
            status=doc.get("status", "PROPOSED"),
            approval_fingerprint=doc.get("approval_fingerprint"),
            approved_by=doc.get("approved_by"),
        )

    @classmethod
    def of(cls, *mappings: tuple | FieldMapping, plan_id: str = "plan_v1", version: int = 1) -> Plan:
        """Short form: ``Plan.of(("email", ["mail"], "EMAIL_NORMALIZE", {"required": True}), ...)``."""
        built = tuple(
            m if isinstance(m, FieldMapping) else FieldMapping(m[0], tuple(m[1]), m[2], dict(m[3]) if len(m) > 3 else {})
            for m in mappings
        )
        return cls(plan_id, version, built)

    def mapping_for(self, target_field: str) -> FieldMapping | None:
        return next((m for m in self.mappings if m.target_field == target_field), None)

    def with_parameters(self, target_field: str, changes: dict[str, Any], drop: tuple[str, ...] = ()) -> Plan:
        """Change parameters of one field; an approval does not survive the change."""
        edited = []
        for m in self.mappings:
            if m.target_field == target_field:
                params = {k: v for k, v in copy.deepcopy(m.parameters).items() if k not in drop}
                params.update(changes)
                m = replace(m, parameters=params)
            edited.append(m)
        return replace(self, mappings=tuple(edited)).back_to_draft()

    def back_to_draft(self) -> Plan:
        if self.status != "APPROVED":
            return self
        return replace(self, status="DRAFT", approval_fingerprint=None, approved_by=None)

    def fingerprint(self, spec: TargetSpec | None = None) -> str:
        """SHA-256 over the mappings (by target field) and, when given, the target schema."""
        target = None
        if spec is not None:
            target = hashlib.sha256(json.dumps(spec.document, sort_keys=True).encode()).hexdigest()
        body = {
            "plan_id": self.plan_id,
            "version": self.version,
            "source_schema_id": self.source_schema_id,
            "target_schema_id": self.target_schema_id,
            "mappings": [m.canonical() for m in sorted(self.mappings, key=lambda m: (m.target_field, m.source_fields))],
            "target_schema_hash": target,
        }
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def approve(self, by: str, spec: TargetSpec | None = None) -> Plan:
        return replace(self, status="APPROVED", approved_by=by, approval_fingerprint=self.fingerprint(spec))

    def require_approved(self, spec: TargetSpec | None = None) -> None:
        if self.status != "APPROVED":
            raise ApprovalError(f"Plan {self.plan_id!r} v{self.version} has status {self.status!r}; approve it first")
        if not self.approval_fingerprint or self.approval_fingerprint != self.fingerprint(spec):
            raise ApprovalError(f"Plan {self.plan_id!r} v{self.version} was changed after its approval")
