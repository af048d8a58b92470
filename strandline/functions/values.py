"""Modes, message text, identifiers and token maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States in the order of the hidden Markov model; fixed values.
STATES = ("STILL", "RUN", "WALK", "DRIVE", "CYCLING", "UNKNOWN")
ACTIVE = ("RUN", "WALK", "CYCLING")
#: Other spellings of modes, and groups of segment activities; fixed values.
SYNONYMS = {"BIKE": "CYCLING", "RUNNING": "RUN", "WALKING": "WALK"}
GROUPS = {"cycling": "CYCLING", "running": "RUN", "walking": "WALK", "transport": "DRIVE", "trip": "DRIVE"}
MILES_PER_METRE = 0.000621371192


def is_active(mode: Column | str) -> Column:
    return (F.col(mode) if isinstance(mode, str) else mode).isin(*ACTIVE)


def normal_mode(raw: Column | str) -> Column:
    """Upper case, synonyms replaced, anything else UNKNOWN; null stays null."""
    up = F.upper(raw)
    named = F.coalesce(*[F.when(up == k, F.lit(v)) for k, v in SYNONYMS.items()], up)
    return F.when(up.isNotNull(), F.when(named.isin(*STATES), named).otherwise(F.lit("UNKNOWN")))


def group_state(group: Column | str) -> Column:
    """State of an activity group; a null group walks, an unknown one is an error."""
    g = F.coalesce(F.lower(group), F.lit("walking"))
    return F.coalesce(*[F.when(g == k, F.lit(v)) for k, v in GROUPS.items()], F.raise_error(F.concat(F.lit("unknown activity group: "), g)).cast("string"))


_HEADER = r"[ \t>]*(?:from|to|cc|bcc|subject|sent|date|time)[ \t]*:[^\n]*"
#: Where a quoted message begins: two header lines or more, with a line of dashes before them if there is one, or "On ... wrote:",
#: on one line or two. A line before a whole "On ... wrote:" is text, whatever it begins with.
REPLY = (
    r"(?im)^(?:[ \t>]*-+[ \t]*(?:original(?:[ \t]message)?|forwarded message|forwarded by[^\n]*?)?[ \t]*-+[ \t]*\n)?"
    rf"{_HEADER}(?:\n{_HEADER})+"
    r"|^[ \t>]*on [^\n]{0,200}(?:\n(?![ \t>]*on (?!behalf of )[^\n]{0,200}wrote[ \t]*:)[^\n]{0,100})?wrote[ \t]*:"
)


def clean_mail(content: Column | str) -> Column:
    """The text before the first quoted reply; all of it if there is none."""
    content = F.col(content) if isinstance(content, str) else content
    return F.split(content, REPLY, 2)[0]


def mac_to_long(mac: Column | str) -> Column:
    """48-bit hardware address as a number; null if it is none."""
    mac = F.col(mac) if isinstance(mac, str) else mac
    return F.when(mac.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.conv(F.replace(mac, F.lit(":"), F.lit("")), 16, 10).cast("long"))


def wifi_map(scan: Column | str) -> Column:
    """``array<struct<bssid, strength>>`` -> map of address to strength; null without a scan, bad addresses dropped."""
    pairs = F.transform(scan, lambda w: F.struct(mac_to_long(w["bssid"]).alias("k"), w["strength"].cast("double").alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull())
    # Of an address seen twice the last strength counts.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when((F.col(scan) if isinstance(scan, str) else scan).isNotNull(), F.map_from_entries(last))


def token_key(provider: Column | str, scope: Column | str) -> Column:
    return F.replace(F.concat_ws(":", provider, scope), F.lit("."), F.lit("_"))


def scopes(text: Column | str) -> Column:
    return F.filter(F.split(text, " "), lambda s: s != "")


def has_all(tokens: Column | str, keys: Column) -> Column:
    return F.forall(keys, lambda k: F.map_contains_key(tokens, k))


def put(tokens: Column | str, key: Column, value: Column) -> Column:
    """The map with one entry set."""
    others = F.map_filter(tokens, lambda k, _: k != key)
    return F.map_concat(others, F.create_map(key, value))


def remove(tokens: Column | str, key: Column) -> Column:
    return F.map_filter(tokens, lambda k, _: k != key)


def body(parts: Column | str) -> Column:
    """``array<struct<text, attachment>>`` -> the text of what is no attachment."""
    return F.concat_ws("", F.transform(F.filter(parts, lambda p: ~F.coalesce(p["attachment"], F.lit(False))), lambda p: p["text"]))


def email_of(meta: Column | str) -> Column:
    """The first ``email`` field of a JSON text at any depth, in its order; null if there is none or it is no text."""
    meta = F.col(meta) if isinstance(meta, str) else meta
    found = F.regexp_extract(meta, r'"email"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|.)', 1)
    return F.when(found != "", found)


def has_attachment(parts: Column | str) -> Column:
    return F.coalesce(F.exists(parts, lambda p: F.coalesce(p["attachment"], F.lit(False))), F.lit(False))
