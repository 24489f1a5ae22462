"""Semi-structured values: JSON text, maps and arrays."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def drop_empty(m: Column) -> Column:
    """A map without null or blank values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge: the new map's values win where they are not empty."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(drop_empty(new)), k))
    return F.map_concat(kept, drop_empty(new))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])), 256)


def country_code(value: Column, names: dict[str, str]) -> Column:
    """A two-letter code from a code, a country's name, or an address object in JSON."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    one = lambda v: F.when(F.trim(v).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(v))).otherwise(F.try_element_at(table, F.lower(F.trim(v))))
    nested = [F.get_json_object(value, f"$.{k}") for k in ("addressCountry", "country_code", "name", "address.addressCountry")]
    return F.when(value.startswith("{"), F.coalesce(*map(one, nested))).otherwise(one(value))


def hiring_organization(metadata: Column) -> Column:
    """Employer's name from a string, an object, or flat fields of a posting's metadata (JSON text)."""
    get = lambda p: F.nullif(F.trim(F.get_json_object(metadata, p)), F.lit(""))
    whole = get("$.hiring_organization")
    return F.coalesce(get("$.hiring_organization.name"), F.when(~whole.startswith("{"), whole), get("$.hiringOrganization.name"), get("$.company"), get("$.employer"))


# Keys on a structured path that say what its text asks for, the first row that fits decides.
MODALITY = {
    "optional": "preferred optional nice_to_have desired",
    "requirements": "required mandatory must_have qualifications educationrequirements experiencerequirements",
    "duties": "responsibilities duties",
}
# Flags that say that a row is not open, on or off, and words of its state.
CLOSED_IF_TRUE = ("template", "isTemplate", "archived", "closed", "disabled", "expired", "deleted", "hidden", "inactive", "isClosed", "isExpired")
CLOSED_IF_FALSE = ("active", "enabled", "published", "isActive", "isPublished", "visible")
STATE_KEYS, CLOSED_STATES = ("status", "state", "availability"), r"(?i)closed|inactive|archiv|expired|filled|template|draft|disabled"


def section_modality(path: Column) -> Column:
    """optional, requirements, duties or neutral from the keys on a structured path like ``job.must_have[0]``."""
    keys = F.split(F.regexp_replace(F.lower(F.coalesce(path, F.lit(""))), r"\[\d+\]", ""), "[./]")
    out = F.lit("neutral")
    for name, words in reversed(MODALITY.items()):
        out = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, words.split()))), name).otherwise(out)
    return out


def inactive_row(m: Column) -> Column:
    """Whether a map of strings says by any flag or state that its row is not open."""
    value = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))))
    on = F.exists(F.array(*map(value, CLOSED_IF_TRUE)), lambda v: ~v.isin("", "false", "0", "no", "null"))
    off = F.exists(F.array(*map(value, CLOSED_IF_FALSE)), lambda v: v.isin("false", "0", "no"))
    return on | off | F.concat_ws(" ", *map(value, STATE_KEYS)).rlike(CLOSED_STATES)


def json_leaves(value: Column, *, nodes: int = 512, depth: int = 10, children: int = 80) -> Column:
    """array<struct<path, value>> of the scalar leaves of JSON text, depth first, within bounds."""
    @pandas_udf("array<struct<path:string,value:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        def leaves(text):
            try:
                stack = [("$", json.loads(text), 0)]
            except (TypeError, ValueError):
                return []
            out, seen = [], 0
            while stack and seen < nodes:
                path, v, d = stack.pop()
                seen += 1
                if isinstance(v, (dict, list)):
                    if d < depth:
                        pairs = [(f"{path}.{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{path}[{k}]", x) for k, x in enumerate(v)]
                        stack += [(p, x, d + 1) for p, x in reversed(pairs[:children])]
                elif v is not None:
                    out.append({"path": path, "value": v if isinstance(v, str) else json.dumps(v)})
            return out

        return texts.map(leaves)

    return walk(value)
