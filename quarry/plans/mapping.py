"""Export mappings, compiled to Columns.

A mapping is a list of fields. Each yields a string: a constant, the first non-empty value of a list
of metadata keys, or the record's own field; then a prefix and a suffix where the value isn't empty.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_bytes
from ..functions.values import FIELDS

MODES = ("no change", "name change", "map metadata", "fixed value")
#: Fields that are exported as they are, so a missing one reads "null".
BARE = ("name", "extension", "type", "sizeRaw", "lastModified", "source")


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    included: bool = True
    mode: str = "no change"
    metadata_key: str | None = None
    fallbacks: tuple[str | None, ...] = ()
    fixed: str = ""
    prefix: str = ""
    suffix: str = ""
    custom: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.key == "deepMeta" and self.mode != "no change":
            raise ValueError("deepMeta can't be mapped")


@dataclass(frozen=True)
class Mapping:
    name: str
    fields: tuple[Field, ...] = field(default_factory=lambda: tuple(Field(k, v) for k, v in FIELDS.items()))

    def with_field(self, key: str, **changes) -> Mapping:
        """A changed field; a new label alone sets mode ``name change``."""
        if "label" in changes and "mode" not in changes:
            changes["mode"] = "name change" if changes["label"] != FIELDS.get(key) else "no change"
        return replace(self, fields=tuple(replace(f, **changes) if f.key == key else f for f in self.fields))

    def with_custom(self, label: str, **values) -> Mapping:
        """A further field, custom_NN with the next free number."""
        used = [int(f.key[7:]) for f in self.fields if f.custom]
        return replace(self, fields=(*self.fields, Field(f"custom_{max(used, default=0) + 1:02d}", label, custom=True, **values)))

    def with_sources(self, key: str, keys: list[str]) -> Mapping:
        """The metadata keys a field is read from, in order: the first, then its fallbacks; none clears both."""
        return self.with_field(key, metadata_key=keys[0] if keys else None, fallbacks=tuple(keys[1:]))

    def sources(self, key: str) -> list[str]:
        f = next(f for f in self.fields if f.key == key)
        return [k for k in (f.metadata_key, *f.fallbacks) if k]

    def moved(self, key: str, at: int, to: int) -> Mapping:
        """A field's metadata key at place ``at`` moved to place ``to``."""
        keys = self.sources(key)
        keys.insert(to, keys.pop(at))
        return self.with_sources(key, keys)

    def duplicate(self) -> Mapping:
        return replace(self, name=f"{self.name} (copy)")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Mapping:
        x = json.loads(text)
        return Mapping(x["name"], tuple(Field(**f | {"fallbacks": tuple(f["fallbacks"])}) for f in x["fields"]))


@dataclass(frozen=True)
class Registry:
    """Named mappings and which of them is active. A value: every change gives a new registry."""

    mappings: dict[str, Mapping] = field(default_factory=dict)
    active: str | None = None

    def create(self, name: str, mapping: Mapping | None = None) -> tuple[Registry, str]:
        """With a new mapping of all fields, and its id: map_NN with the next free number."""
        key = f"map_{max((int(k[4:]) for k in self.mappings), default=0) + 1:02d}"
        return replace(self, mappings=self.mappings | {key: replace(mapping or Mapping(name), name=name)}), key

    def update(self, key: str, mapping: Mapping) -> Registry:
        if key not in self.mappings:
            raise KeyError(key)
        return replace(self, mappings=self.mappings | {key: mapping})

    def rename(self, key: str, name: str) -> Registry:
        return self.update(key, replace(self.mappings[key], name=name))

    def duplicate(self, key: str) -> tuple[Registry, str]:
        copy = self.mappings[key].duplicate()
        return self.create(copy.name, copy)

    def delete(self, key: str) -> Registry:
        """Without a mapping; if it was the active one, none is."""
        return Registry({k: m for k, m in self.mappings.items() if k != key}, None if self.active == key else self.active)

    def activate(self, key: str | None) -> Registry:
        if key is not None and key not in self.mappings:
            raise KeyError(key)
        return replace(self, active=key)

    def current(self) -> Mapping | None:
        return self.mappings.get(self.active or "")

    def to_json(self) -> str:
        return json.dumps({"active": self.active, "mappings": {k: json.loads(m.to_json()) for k, m in self.mappings.items()}})

    @staticmethod
    def from_json(text: str) -> Registry:
        x = json.loads(text)
        return Registry({k: Mapping.from_json(json.dumps(m)) for k, m in x["mappings"].items()}, x["active"])


def own_value(key: str) -> Column:
    """A record's field as the default projection shows it."""
    if key == "sizeRaw":
        return F.coalesce(F.col("size").cast("string"), F.lit("null"))
    if key == "sizeFormatted":
        return format_bytes(F.col("size"))
    if key in BARE:
        return F.coalesce(F.col(key), F.lit("null"))
    return F.coalesce(F.col(key), F.lit("")) if key in FIELDS else F.lit("")


def metadata_value(keys: list[str | None], parsed: Column | None = None) -> Column:
    """The first value that is neither missing, null nor empty; 0 and false count as values, and objects and lists are JSON text as it stood.

    ``parsed``: the metadata as a variant, where a plan has parsed it once for all fields.
    """
    parsed = F.try_parse_json("deepMeta") if parsed is None else parsed

    def value(key: str) -> Column:
        as_text = F.get_json_object("deepMeta", "$['" + key.replace("'", "\\'") + "']")
        if "'" in key:
            return as_text
        path = f"$['{key}']"
        nested = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike("^(OBJECT|ARRAY)")
        return F.when(nested, as_text).otherwise(F.try_variant_get(parsed, path, "string"))

    return F.coalesce(*[F.nullif(value(k), F.lit("")) for k in keys if k], F.lit(""))


def value_of(f: Field, parsed: Column | None = None) -> Column:
    if f.mode == "fixed value":
        value = F.lit(f.fixed or "")
    elif f.mode == "map metadata" and f.metadata_key:
        value = metadata_value([f.metadata_key, *f.fallbacks], parsed)
    else:
        value = F.lit("") if f.custom else own_value(f.key)
    if f.prefix:
        value = F.when(value != "", F.concat(F.lit(f.prefix), value)).otherwise(value)
    return F.when(value != "", F.concat(value, F.lit(f.suffix))).otherwise(value) if f.suffix else value


def compile_mapping(mapping: Mapping, parsed: Column | None = None) -> list[Column]:
    """A Column for each included field, named by its label; of equal labels the last stays."""
    return list({f.label: value_of(f, parsed).alias(f.label) for f in mapping.fields if f.included}.values())


def _parsed(records: DataFrame, mapping: Mapping) -> tuple[DataFrame, Column | None]:
    """``records`` with their metadata as a variant beside, parsed once a record, if the mapping reads any."""
    if not any(f.included and f.mode == "map metadata" and f.metadata_key for f in mapping.fields):
        return records, None
    return records.withColumn("k_parsed", F.try_parse_json("deepMeta")), F.col("k_parsed")


def project(records: DataFrame, mapping: Mapping | None = None, keep: list[str] | None = None) -> DataFrame:
    """The mapped rows; without a mapping all fields under their own labels."""
    mapping = mapping or Mapping("default")
    records, parsed = _parsed(records, mapping)
    return records.select(*(keep or []), *compile_mapping(mapping, parsed))


def apply_mapping(records: DataFrame, mapping: Mapping) -> DataFrame:
    """Write mapped values into the records themselves.

    Custom fields, deepMeta and the formatted size have no place in a record and are left out. A
    value that isn't a whole number leaves size null.
    """
    changes = {}
    records, parsed = _parsed(records, mapping)
    for f in mapping.fields:
        if f.included and not f.custom and f.key not in ("deepMeta", "sizeFormatted"):
            changes["size" if f.key == "sizeRaw" else f.key] = value_of(f, parsed).try_cast("long") if f.key == "sizeRaw" else value_of(f, parsed)
    return records.withColumns(changes).drop("k_parsed")
