"""Redaction strategies and the splice that applies them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import let, row
from ..functions.labels import sensitivity
from ..plans.options import check_sensitivity

DOT = "•"
SUFFIXED = ["PHONE", "SSN"]


def mask(e: Column) -> Column:
    return F.repeat(F.lit(DOT), F.length(e["text"]))


def label(e: Column) -> Column:
    return F.concat(F.lit("["), e["label"], F.lit("]"))


def partial(e: Column) -> Column:
    """An address keeps its first character and domain, a number its last four digits."""
    name = F.substring_index(e["text"], "@", 1)
    domain = e["text"].substr(F.locate("@", e["text"]) + 1, F.length(e["text"]))
    address = F.concat(F.substring(name, 1, 1), F.repeat(F.lit(DOT), F.greatest(F.length(name) - 1, F.lit(1))), F.lit("@"), domain)
    number = F.concat(F.repeat(F.lit(DOT), F.length(e["text"]) - 4), F.right(e["text"], F.lit(4)))
    return F.when((e["label"] == "EMAIL") & F.contains(e["text"], F.lit("@")), address).when(
        e["label"].isin(SUFFIXED) & (F.length(e["text"]) > 4), number
    ).otherwise(mask(e))


def remove(e: Column) -> Column:
    return F.lit("")


def fnv_pseudonym(salt: str = ""):
    """The browser profile's pseudonym: the first six digits of a 32-bit FNV-1a hash."""

    def token(e: Column) -> Column:
        value = F.concat(F.lit(salt), e["label"], F.lower(e["text"]))
        step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619, F.lit(1 << 32))
        hashed = F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)
        return F.concat(e["label"], F.lit("_"), F.substring(F.lpad(F.lower(F.hex(hashed)), 6, "0"), 1, 6))

    return token


def pseudonyms(salt: str):
    """UDF (labels, texts) -> tokens: LABEL_ and three bytes of a salted BLAKE2s digest, for which SQL has no function."""

    @F.pandas_udf("array<string>")
    def tokens(labels: pd.Series, texts: pd.Series) -> pd.Series:
        name = lambda a, b: f"{a}_{hashlib.blake2s(f'{salt}{a}{b.lower()}'.encode(), digest_size=3).hexdigest()}"
        return pd.Series([[name(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(labels, texts, strict=True)])

    return tokens


#: Name -> token of an entity. The pseudonym is a function of arrays and handled apart.
STRATEGIES = {"label": label, "mask": mask, "partial": partial, "pseudonym": None, "remove": remove}


def strategy_names() -> list[str]:
    return sorted(STRATEGIES)


def tokens(entities: Column, strategy: str, salt: str = "", profile: str = "server") -> Column:
    """The token of each entity."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "pseudonym" and profile == "server":
        return pseudonyms(salt)(F.transform(entities, lambda e: e["label"]), F.transform(entities, lambda e: e["text"]))
    return F.transform(entities, fnv_pseudonym(salt) if strategy == "pseudonym" else STRATEGIES[strategy])


def targets(entities: Column, min_sensitivity: int = 0) -> Column:
    check_sensitivity(min_sensitivity)
    return F.filter(entities, lambda e: sensitivity(e["label"]) >= min_sensitivity)


def splice(text: Column, entities: Column, replaced: Column) -> Column:
    """struct<text, replaced, mapping>: tokens put in from right to left, entities of equal start in their order.

    Entities may overlap, so the splices are done one after another. Of equal texts the last one put in is mapped."""
    zipped = F.zip_with(entities, replaced, lambda e, t: row(start=e["start"], end=e["end"], text=e["text"], token=t))
    keyed = F.array_sort(F.transform(zipped, lambda z, i: row(less=-z["start"], i=i, z=z)))

    def apply(ordered: Column) -> Column:
        put = lambda acc, k: F.concat(acc.substr(F.lit(1), k["z"]["start"]), k["z"]["token"], acc.substr(k["z"]["end"] + 1, F.length(acc)))
        last = F.filter(ordered, lambda k, i: ~F.exists(F.slice(ordered, i + 2, F.size(ordered)), lambda o: o["z"]["text"] == k["z"]["text"]))
        pairs = F.transform(last, lambda k: F.struct(k["z"]["text"].alias("key"), k["z"]["token"].alias("value")))
        return row(text=F.aggregate(ordered, text, put), replaced=F.size(entities), mapping=F.map_from_entries(pairs))

    return let(keyed, apply)
