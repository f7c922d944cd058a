"""Attribute names: normal form, synonyms, tokens, types and similarity, as Column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The synonym groups, tested in this order.
SYNONYMS = {
    "name": ["name", "product_name", "productName", "item_name", "full_name", "username", "title"],
    "price": ["price", "cost", "amount", "value", "total", "sum", "price_amount"],
    "stock": ["stock", "quantity", "quantity_available", "inventory", "qty", "stock_level"],
    "gender": ["gender", "sex", "target_gender", "gender_type"],
    "email": ["email", "email_address", "emailAddress", "e_mail", "mail", "email_id"],
    "phone": ["phone", "phone_number", "phoneNumber", "mobile", "telephone", "contact_number"],
    "address": ["address", "location", "street_address", "full_address", "addr"],
    "date": ["date", "created_date", "date_created", "timestamp", "created_at", "updated_at"],
    "id": ["id", "_id", "id_", "identifier", "key", "primary_key"],
    "description": ["description", "desc", "details", "info", "notes", "comment"],
    "category": ["category", "type", "classification", "group", "tag"],
    "status": ["status", "state", "condition", "active"],
    "age": ["age", "years_old", "years"],
    "country": ["country", "nation", "country_code"],
    "city": ["city", "town", "location_city"],
    "zip": ["zip", "zipcode", "postal_code", "postcode"],
}
# Names that are identifiers by themselves.
ID_NAMES = ["id", "identifier", "key", "primary_key", "pk"]
# Weights and thresholds of attribute similarity.
NAME_WEIGHT, TYPE_WEIGHT, SYNONYM_SCORE, OVERLAP_WEIGHT, MATCH_LEAST, CANDIDATE_LEAST = 0.7, 0.3, 0.95, 0.8, 0.6, 0.4


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(name: Column | str) -> Column:
    """Lower case, runs of other characters than a-z, 0-9 as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9_]+", "_"), "_+", "_"), F.lit("_"))


def is_id(name: Column | str) -> Column:
    n = normalize(name)
    return n.isin(ID_NAMES) | n.endswith("_id") | n.startswith("id_")


def synonym_group(name: Column | str) -> Column:
    """The first synonym group that lists the normalised name, else null."""
    n, out = normalize(name), None
    for group, words in SYNONYMS.items():
        forms = sorted({plain_normalize(w) for w in words})
        out = F.when(n.isin(forms), group) if out is None else out.when(n.isin(forms), group)
    return out


def are_synonyms(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(synonym_group(a) == synonym_group(b), F.lit(False))


def tokens(name: Column | str) -> Column:
    """Distinct letter runs of the normalised name; digits vanish."""
    return F.array_distinct(F.regexp_extract_all(normalize(name), F.lit("[a-z]+"), F.lit(0)))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the token sets, 0 when either is empty."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def type_compatibility(a: Column | str, b: Column | str) -> Column:
    """1.0 for equal types, 0.8 within numbers, texts or times, else 0.3; names compare exactly."""
    a, b = _c(a), _c(b)
    families = (["INTEGER", "NUMERIC", "BIGINT"], ["VARCHAR", "TEXT", "CHAR"], ["TIMESTAMP", "DATE", "TIME"])
    near = F.lit(False)
    for f in families:
        near = near | (a.isin(f) & b.isin(f))
    return F.when(a == b, 1.0).when(near, 0.8).otherwise(0.3)


def infer_text_type(value: Column | str) -> Column:
    """Type of a text value: null TEXT, date-like TIMESTAMP (checked before length), long TEXT, else VARCHAR."""
    v = _c(value)
    return F.when(v.isNull(), "TEXT").when((F.char_length(v) > 10) & (v.contains("T") | v.contains("-")), "TIMESTAMP").when(F.char_length(v) > 255, "TEXT").otherwise("VARCHAR")


def infer_type(value: Column | str, spark_type: str) -> Column:
    """Type of a value of a typed column: nulls are TEXT."""
    v = _c(value)
    if spark_type == "string":
        return infer_text_type(v)
    simple = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "NUMERIC", "double": "NUMERIC", "timestamp": "TIMESTAMP", "date": "TIMESTAMP"}
    kind = "NUMERIC" if spark_type.startswith("decimal") else simple.get(spark_type, "TEXT")
    return F.when(v.isNull(), "TEXT").otherwise(kind)


def infer_kind_type(value: Column | str, kind: Column | str) -> Column:
    """Type of a parsed value kept as text beside its kind."""
    k = _c(kind)
    return F.when(k == "boolean", "BOOLEAN").when(k == "integer", "INTEGER").when(k == "double", "NUMERIC").when(k == "string", infer_text_type(value)).otherwise("TEXT")


def unified_type(kinds: Column, longest: Column) -> Column:
    """One type for a set of value types: none TEXT, several TEXT, VARCHAR with its width."""
    width = F.least((F.floor(F.coalesce(longest, F.lit(0)) / 50) + 1) * 50, F.lit(1000)).cast("int")
    return F.when(F.size(kinds) != 1, "TEXT").when(kinds[0] == "VARCHAR", F.concat(F.lit("VARCHAR("), width.cast("string"), F.lit(")"))).otherwise(kinds[0])


def table_name(names: Column, prefix: str = "table") -> Column:
    """prefix, then the first three normalised attributes, cut at 50 characters."""
    return F.substring(F.concat_ws("_", F.lit(prefix), F.transform(F.slice(names, 1, 3), normalize)), 1, 50)


def dynamic_threshold(attributes: Column | str) -> Column:
    return F.when(_c(attributes) < 10, 0.6).otherwise(0.8)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two names (1.0 when equal, 0.0 when either is empty); order of the arguments matters."""
    return pd.Series([plain_ratio(x, y) for x, y in zip(a, b)])


def name_similarity(new: Column | str, old: Column | str) -> Column:
    """1.0 same normal form, 0.95 synonyms, else the larger of the sequence ratio and 0.8 x token overlap."""
    a, b = normalize(new), normalize(old)
    open_ = ~((a == b) | are_synonyms(new, old))
    fuzzy = F.greatest(sequence_ratio(F.when(open_, a), F.when(open_, b)), F.lit(OVERLAP_WEIGHT) * token_overlap(new, old))
    return F.when(a == b, 1.0).when(are_synonyms(new, old), SYNONYM_SCORE).otherwise(fuzzy)


def attribute_similarity(new: Column | str, old: Column | str, type_score: Column | float = 1.0) -> Column:
    score = F.lit(type_score) if isinstance(type_score, float) else type_score
    return F.lit(NAME_WEIGHT) * name_similarity(new, old) + F.lit(TYPE_WEIGHT) * score


# The same rules on plain strings, for the order-dependent matching of small attribute lists.


def plain_normalize(name: str) -> str:
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in name.lower().replace("_", " "))
    return "_".join(kept.split())


_GROUP_OF = {}
for _g, _words in SYNONYMS.items():
    for _w in _words:
        _GROUP_OF.setdefault(plain_normalize(_w), _g)


def plain_is_id(name: str) -> bool:
    n = plain_normalize(name)
    return n in ID_NAMES or n.endswith("_id") or n.startswith("id_")


def plain_ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def plain_tokens(name: str) -> set[str]:
    return set("".join(c if c.isalpha() else " " for c in plain_normalize(name)).split())


def plain_similarity(new: str, old: str, type_score: float = 1.0) -> float:
    a, b = plain_normalize(new), plain_normalize(old)
    if a == b:
        name = 1.0
    elif (g := _GROUP_OF.get(a)) is not None and g == _GROUP_OF.get(b):
        name = SYNONYM_SCORE
    else:
        x, y = plain_tokens(new), plain_tokens(old)
        name = max(plain_ratio(a, b), OVERLAP_WEIGHT * (len(x & y) / len(x | y) if x and y else 0.0))
    return NAME_WEIGHT * name + TYPE_WEIGHT * type_score


def match_lists(new: list[str], old: list[str], type_scores: dict[tuple[str, str], float] | None = None, least: float = MATCH_LEAST) -> tuple[dict[str, str], list[str]]:
    """(mapping, new fields) of two attribute lists.

    Identifiers pair first: by equal normal form, else the single one of each side, else by
    one name holding the other. The rest take, in order, their best free column with a score
    of at least ``least``; the first of equals wins. No column is used twice.
    """
    mapping: dict[str, str] = {}
    used: set[str] = set()
    ids, old_ids = [a for a in new if plain_is_id(a)], [b for b in old if plain_is_id(b)]
    for a in ids:
        n = plain_normalize(a)
        free = [b for b in old_ids if b not in used]
        pick = next((b for b in free if plain_normalize(b) == n), None)
        if pick is None and len(ids) == 1 and len(old_ids) == 1 and free:
            pick = free[0]
        if pick is None:
            pick = next((b for b in free if "id" in n and "id" in plain_normalize(b) and (n in plain_normalize(b) or plain_normalize(b) in n)), None)
        if pick is not None:
            mapping[a] = pick
            used.add(pick)
    for a in new:
        if plain_is_id(a):
            continue
        best, score = None, 0.0
        for b in old:
            if b in used or plain_is_id(b):
                continue
            s = plain_similarity(a, b, (type_scores or {}).get((a, b), 1.0))
            if s > score:
                best, score = b, s
        if best is not None and score >= least:
            mapping[a] = best
            used.add(best)
    return mapping, [a for a in new if a not in mapping]
