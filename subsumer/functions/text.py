"""Scalar string functions of the OBO and OWL formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before(s: Column, separator: str) -> Column:
    """What stands before the first separator; all without one."""
    return F.substring_index(s, separator, 1)


def after(s: Column, separator: str) -> Column:
    """What stands behind the first separator; null without one."""
    at = F.instr(s, separator)
    return F.when(at > 0, F.substring(s, at + len(separator), F.length(s)))


def quoted(s: Column) -> Column:
    """Text between the first two double quotes; to the end without a second, all without any. Escapes aren't known."""
    at = F.instr(s, '"')
    return F.when(at == 0, s).otherwise(F.substring_index(F.substring(s, at + 1, F.length(s)), '"', 1))


def synonym(v: Column) -> Column:
    """`"text" SCOPE [TYPE] [xrefs]` as a struct; scope, type and xrefs are null where they are absent."""
    closing = F.instr(F.substring(v, 2, F.length(v)), '"') + 1
    rest = F.when(closing > 1, F.substring(v, closing + 2, F.length(v)))
    words = F.filter(F.split(rest, "\\s+"), lambda w: w != "")
    second = F.get(words, 1)
    opening, last = F.instr(rest, "["), F.length(rest) - F.instr(F.reverse(rest), "]") + 1
    xrefs = F.when((opening > 0) & (F.instr(rest, "]") > 0) & (last > opening + 1), F.split(F.substring(rest, opening + 1, last - opening - 1), ", "))
    return F.struct(
        quoted(v).alias("text"), F.get(words, 0).alias("scope"), F.when(~second.startswith("["), second).alias("type"), xrefs.alias("xrefs")
    )


def is_a(v: Column) -> Column:
    return F.struct(F.lit("is_a").alias("type"), before(v, " ! ").alias("target_id"), after(v, " ! ").alias("name"))


def relationship(v: Column) -> Column:
    """`type id ! name`: words behind the type up to ` ! ` are the id, whatever they are; one word has no target."""
    rest = F.coalesce(after(v, " "), F.lit(""))
    return F.struct(before(v, " ").alias("type"), before(rest, " ! ").alias("target_id"), after(rest, " ! ").alias("name"))


def intersection_part(v: Column) -> Column:
    """One word is a genus; two or more are a relationship and its target."""
    own = F.regexp_replace(before(v, " ! "), "^[\\s\\u0085\\u00a0\\u2000-\\u200a\\u3000]+|[\\s\\u0085\\u00a0\\u2000-\\u200a\\u3000]+$", "")
    two = F.instr(own, " ") > 0
    return F.struct(F.when(two, before(own, " ")).alias("relationship"), F.when(two, after(own, " ")).otherwise(own).alias("target_id"))


def property_value(v: Column) -> Column:
    """struct(key, value): key and quoted or bare value; a null key where there are fewer than two words."""
    words = F.split(v, " ", 3)
    second = F.get(words, 1)
    value = F.when(second.startswith('"'), quoted(after(v, " "))).otherwise(second)
    key = F.when(F.size(words) > 1, F.get(words, 0))
    return F.struct(F.when(key != "", key).alias("key"), value.alias("value"))


def last_entries(pairs: Column) -> Column:
    """A map of key and value structs in which the last of a key wins, keys in order; null if empty."""
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(F.array_sort(kept)))


def curie(iri: Column) -> Column:
    """An IRI under the OBO base with its first `_` as `:`; any other unchanged."""
    base = "http://purl.obolibrary.org/obo/"
    own = F.substring(iri, len(base) + 1, F.length(iri))
    at = F.instr(own, "_")
    short = F.when(at > 0, F.concat(F.substring(own, F.lit(1), at - 1), F.lit(":"), F.substring(own, at + 1, F.length(own)))).otherwise(own)
    return F.when(iri.startswith(base), short).otherwise(iri)


def none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)
