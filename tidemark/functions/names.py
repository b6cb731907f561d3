"""Rules for ids, destination names, request addresses and error text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: organisation and workspace ids.
SLUG = r"^[a-z][a-z0-9-]{4,28}[a-z0-9]$"
MAX_INDEX_BYTES = 255
MAX_TOPIC_CHARS = 249


def is_slug(text: Column) -> Column:
    # `$` also matches before a final line break, which no slug may hold.
    return F.coalesce(text.rlike(SLUG) & ~text.contains("\n"), F.lit(False))


def is_index_name(name: Column) -> Column:
    """A legal search destination: lower case, at most 255 bytes, no reserved characters."""
    legal = (
        (F.octet_length(name) > 0)
        & (F.octet_length(name) <= MAX_INDEX_BYTES)
        & ~name.isin(".", "..")
        & ~F.substring(name, 1, 1).isin("_", "-", "+")
        & ~name.rlike(r'[\\/*?"<>| ,#:]')
        & (F.lower(name) == name)
    )
    return F.coalesce(legal, F.lit(False))


def is_topic_name(name: Column) -> Column:
    legal = name.rlike(r"\A[A-Za-z0-9._-]{1,%d}\z" % MAX_TOPIC_CHARS) & ~name.isin(".", "..")
    return F.coalesce(legal, F.lit(False))


def render(template: Column | str, org_id: Column, workspace_id: Column) -> Column:
    """`{org_id}` / `{workspace_id}` replaced; ids are never rewritten."""
    template = F.lit(template) if isinstance(template, str) else template
    with_org = F.replace(template, F.lit("{org_id}"), org_id)
    return F.replace(with_org, F.lit("{workspace_id}"), workspace_id)


def client_ip(forwarded_for: Column, real_ip: Column, peer: Column) -> Column:
    """First hop of the forwarding header, else the real-ip header, else the peer.

    A forwarding header that exists but starts with an empty item goes straight to the peer.
    """
    forwarded, real = F.trim(forwarded_for), F.trim(real_ip)
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.length(forwarded) > 0, F.when(first != "", first).otherwise(peer)).otherwise(
        F.when(F.length(real) > 0, real).otherwise(peer)
    )


def redact(text: Column, destination: Column | str, org_id: Column | str) -> Column:
    as_col = lambda value: F.lit(value) if isinstance(value, str) else value
    hidden = F.replace(text, as_col(destination), F.lit("[index]"))
    return F.replace(hidden, as_col(org_id), F.lit("[redacted]"))


def name_like(name: Column, text: str) -> Column:
    return name.contains(text)
