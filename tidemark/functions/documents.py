"""Checked reading of one JSON document per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from tidemark.functions import props, times
from tidemark.functions.props import fence, let


def whole_json(text: Column) -> Column:
    """The document as VARIANT, or null unless the *whole* text is one JSON value.

    `try_parse_json` stops after the first value, so the text is read as the first item of a
    list whose second item, the text's own hash, proves that nothing else stood in it.
    """
    proof = F.xxhash64(text)
    framed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), proof, F.lit("]")))
    own_proof = lambda items: F.try_variant_get(F.get(items, F.lit(1)), "$", "long")
    return let(
        F.try_variant_get(framed, "$", "array<variant>"),
        lambda items: F.when((F.size(items) == 2) & (own_proof(items) == proof), F.get(items, F.lit(0))),
    )


def text(document: Column, path: str) -> Column:
    return F.try_variant_get(document, props.json_path(path), "string")


# A document of many fields is opened once, as a map; looking a field up there costs far less than a
# path into the whole document. The map is null for anything but an object.


def fields_of(document: Column) -> Column:
    return props.children(document)


def field(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def kind(fields: Column, name: str) -> Column:
    """Stored type of a field: null when absent, `VOID` for JSON null."""
    return F.schema_of_variant(field(fields, name))


def field_text(fields: Column, name: str) -> Column:
    return F.try_variant_get(field(fields, name), "$", "string")


def canonical_uuid(value: Column) -> Column:
    """Lower-case hyphenated form of the accepted spellings of a UUID; else null."""
    lower = F.lower(value)
    shape = r"\A(?:urn:uuid:)?{h}{8}-{h}{4}-{h}{4}-{h}{4}-{h}{12}\z|\A\{{h}{8}-{h}{4}-{h}{4}-{h}{4}-{h}{12}\}\z|\A{h}{32}\z"
    digits = F.regexp_replace(lower, r"\Aurn:uuid:|[{}-]", "")
    hyphenated = F.regexp_replace(digits, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    usual = r"\A{h}{8}-{h}{4}-{h}{4}-{h}{4}-{h}{12}\z"  # as nearly all are: nothing to rewrite
    match = lambda pattern: lower.rlike(pattern.replace("{h}", "[0-9a-f]"))
    return F.when(match(usual), lower).when(match(shape), hyphenated)


def _required(fields: Column, name: str) -> Column:
    return kind(fields, name) == "STRING"


def is_kind(value: Column, stored: str) -> Column:
    """Absent, null or stored as the given kind."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return kind.startswith("VOID") | kind.startswith(stored)


_TEXTS = ("session_id", "actor_id", "source", "correlation_id", "trace_id")
#: Fields of an event that are read as text.
TEXT_FIELDS = ("envelop_version", "id", "name", "occured_at", "arrived_at", "org_id", "workspace_id", "anon_id", *_TEXTS)


def kind_checks(fields: Column) -> dict[str, Column]:
    """Whether the fields of an event are stored as the kinds they should be, by name."""
    checks = {name: _required(fields, name) for name in ("envelop_version", "id", "name", "occured_at", "org_id", "workspace_id", "anon_id")}
    checks["arrived_at"] = is_kind(field(fields, "arrived_at"), "VOID")  # or a time
    checks |= {name: is_kind(field(fields, name), "STRING") for name in _TEXTS}
    checks["authenticated"] = is_kind(field(fields, "authenticated"), "BOOLEAN")
    checks["system_properties"] = is_kind(field(fields, "system_properties"), "OBJECT")
    return checks


def event_problem(fields: Column, kinds: Mapping[str, Column], found: Mapping[str, Column], version: str) -> Column:
    """Name of the first of an event's own fields that is wrong; null when sound.

    ``kinds`` are the `kind_checks`, ``found`` the texts of the fields, with `id` as `canonical_uuid` and the times as `rfc3339` gives them.
    """
    checks = {
        "object": fields,
        "envelop_version": kinds["envelop_version"] & (found["envelop_version"] == version),
        "id": kinds["id"] & found["id"].isNotNull(),
        "name": kinds["name"],
        "occured_at": kinds["occured_at"] & found["occured_at"].isNotNull(),
        "arrived_at": kinds["arrived_at"] | found["arrived_at"].isNotNull(),
    }
    checks |= {name: kinds[name] for name in ("org_id", "workspace_id", "anon_id", *_TEXTS, "authenticated", "system_properties")}
    return _first_failed(checks)


def system_problem(system: Column, geo: Column) -> Column:
    """`event_problem` of the system properties, by their fields and those of their `geo`; without any all is well."""
    return _first_failed(
        {
            "system_properties.geo": is_kind(field(system, "geo"), "OBJECT"),
            "system_properties.geo.country": is_kind(field(geo, "country"), "STRING"),
            "system_properties.timezone": is_kind(field(system, "timezone"), "STRING"),
            "system_properties.ip_address": is_kind(field(system, "ip_address"), "STRING"),
        }
    )


def _first_failed(checks: Mapping[str, Column]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(sound, F.lit(False)), F.lit(name)) for name, sound in checks.items()])


def read_text(name: str, text: Column) -> Column:
    """A field's text as the event model reads it."""
    if name == "id":
        return canonical_uuid(text)
    return times.rfc3339(text) if name in ("occured_at", "arrived_at") else text


def canonical_problem(fields: Column, version: str) -> Column:
    """Name of the first field that keeps a document from being a canonical event; null when sound."""
    found = {name: read_text(name, field_text(fields, name)) for name in TEXT_FIELDS}
    own = event_problem(fields.isNotNull(), kind_checks(fields), found, version)
    system = let(
        fields_of(field(fields, "system_properties")),
        lambda system: let(fields_of(field(system, "geo")), lambda geo: system_problem(system, geo)),
    )
    return F.coalesce(own, system)


def one_line(value: Column) -> Column:
    """A payload that holds a line break is re-encoded on one line; any other is untouched."""
    return F.when(value.contains("\n"), F.to_json(F.try_parse_json(value))).otherwise(value)


def merge_defaults(properties: Column, defaults: Column) -> Column:
    """Defaults under the event's own keys; properties that are no object pass unchanged."""
    own, given = props.children(properties), props.children(defaults)
    added = F.map_filter(given, lambda key, _: ~F.map_contains_key(own, key))
    merged = F.to_variant_object(F.map_concat(added, own))
    return F.when(own.isNotNull() & given.isNotNull(), merged).otherwise(properties)
