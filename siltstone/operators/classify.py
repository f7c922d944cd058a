"""Scores of how relational or document-like an input is.

Each rule set adds points for SQL and NoSQL as native expressions and collects its reasons;
SQL wins ties, confidence is |s - n| / max(1, s, n). Only the recursion over nested JSON, XML
and YAML runs in an Arrow UDF. Null contents score as empty ones; malformed JSON or XML is
scored as unknown text.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.binding import bind

# Key patterns and cut-offs of the rules; of the key patterns those that hold no other one, which find the same keys.
RELATIONAL_KEYS = ["id", "key", "pk", "fk", "foreign"]
LARGE_TEXT_KEYS = ["content", "description", "html", "text", "body", "message"]
LARGE_TEXT, LONG_TEXT, LONG_DOCUMENT, MOSTLY = 500, 5000, 3000, 0.8



def _shape(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType() if n == "depth" else T.BooleanType()) for n in names.split()])


FACTS = _shape("parsed flat depth array_objects same_keys relational dynamic consistent primitive large_text")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass
class Points:
    """Rules that add to the scores: (condition, SQL points, NoSQL points, reason)."""

    rules: list[tuple[Column, int, int, str]] = field(default_factory=list)

    def when(self, condition: Column | bool, sql: int, nosql: int, reason: str) -> Points:
        self.rules.append((F.coalesce(F.lit(condition) if isinstance(condition, bool) else condition, F.lit(False)), sql, nosql, reason))
        return self

    def total(self, which: int) -> Column:
        out = F.lit(0)
        for rule in self.rules:
            if rule[which]:
                out = out + F.when(rule[0], rule[which]).otherwise(0)
        return out

    def reasons(self) -> Column:
        return F.array_compact(F.array(*[F.when(r[0], F.lit(r[3])) for r in self.rules])) if self.rules else F.expr("cast(array() as array<string>)")

    def struct(self) -> Column:
        return verdict(self.total(1), self.total(2), self.reasons())


def verdict(sql: Column, nosql: Column, reasons: Column) -> Column:

    def judged(v: Column) -> Column:
        s, n = v["s"], v["n"]
        confidence = F.abs(s - n) / F.greatest(F.lit(1), s, n)
        return F.struct(F.when(s >= n, "SQL").otherwise("NoSQL").alias("classification"), s.cast("double").alias("sql_score"), n.cast("double").alias("nosql_score"), F.bround(confidence.cast("double"), 2).alias("confidence"), v["reasons"].alias("reasons"))

    return bind(F.struct(sql.alias("s"), nosql.alias("n"), reasons.alias("reasons")), judged)


def delimited_lines(text: Column | str, delim: str, limit: int = 10) -> Column:
    """Whether the first lines that are not blank have as many fields as the first line, more than one."""
    lines = F.split(F.coalesce(_c(text), F.lit("")), "\n", limit + 1)
    count = lambda s: F.size(F.split(s, delim, -1))
    alike = lambda l, k: (F.size(l) > 1) & (k > 1) & F.forall(F.slice(l, 1, limit), lambda s: s.rlike("^(?U)\\s*$") | (count(s) == k))
    return bind(lines, lambda l: bind(count(l[0]), lambda k: alike(l, k)))


def text_points(text: Column | str) -> Points:
    t = F.coalesce(_c(text), F.lit(""))
    return Points().when(True, 0, 3, "text file").when(F.char_length(t) > LONG_TEXT, 0, 2, "large free text").when(delimited_lines(t, ","), 3, 0, "comma-separated lines")


def document_points(text: Column | str) -> Points:
    return Points().when(True, 0, 3, "document").when(F.char_length(_c(text)) > LONG_DOCUMENT, 0, 2, "large free text")


def html_points(html: Column | str) -> Points:
    h = F.lower(F.coalesce(_c(html), F.lit("")))
    table = h.contains("<table")
    bare = F.regexp_replace(h, "<[^>]+>", "")
    return Points().when(table, 3, 0, "tables").when((F.char_length(h) > LONG_TEXT) & ~table, 0, 1, "content without tables").when(F.char_length(bare) > LONG_DOCUMENT, 0, 2, "large free text")


def tabular_points(columns: Column) -> Points:
    ids = F.exists(columns, lambda c: F.lower(c).contains("id"))
    return Points().when(True, 5, 0, "tabular file").when(F.size(columns) > 0, 2, 0, "consistent schema").when(ids, 1, 0, "identifier column")


def json_points(facts: Column) -> Points:
    f = lambda k: facts[k]
    return (
        Points()
        .when(f("flat"), 4, 0, "flat")
        .when(~f("flat") & (f("depth") > 0), 0, 4, "nested")
        .when(f("array_objects") & f("same_keys"), 4, 0, "array of objects with equal keys")
        .when(f("array_objects") & ~f("same_keys"), 0, 3, "array of objects with different keys")
        .when(f("relational"), 1, 0, "relational keys")
        .when(f("dynamic"), 0, 2, "dynamic keys")
        .when(f("consistent"), 2, 0, "consistent schema")
        .when(~f("consistent"), 0, 2, "open schema")
        .when(f("primitive"), 1, 0, "mostly primitive values")
        .when(f("large_text"), 0, 2, "large free text")
    )


def yaml_points(facts: Column) -> Points:
    return Points().when(facts["flat"], 4, 0, "flat").when(~facts["flat"] & (facts["depth"] > 0), 0, 4, "nested").when(facts["consistent"], 2, 0, "consistent schema")


def unknown_points(text: Column | str) -> Points:
    t = F.coalesce(_c(text), F.lit(""))
    return Points().when(True, 0, 2, "unknown type").when(delimited_lines(t, ","), 3, 0, "comma-separated lines").when(delimited_lines(t, "\t"), 3, 0, "tab-separated lines").when(F.char_length(t) > LONG_TEXT, 0, 2, "large free text")


# --- recursion over parsed contents --------------------------------------------------


def nesting(value: object) -> int:
    """Depth of the deepest container, without recursion (contents may be nested at will)."""
    most, todo = 0, [(value, 0)]
    while todo:
        v, depth = todo.pop()
        most = max(most, depth)
        if isinstance(v, (dict, list)):
            todo += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def objects_within(value: object):
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo += v.values()
        elif isinstance(v, list):
            todo += v


def value_facts(value: object) -> tuple:
    nested = (dict, list)
    parts = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else None
    flat = parts is None or not any(isinstance(x, nested) for x in parts)
    listed = isinstance(value, list) and bool(value) and isinstance(value[0], dict)
    keys = {frozenset(x) for x in value if isinstance(x, dict)} if listed else set()
    rows = isinstance(value, list) and len(value) > 1 and all(isinstance(x, dict) for x in value)
    same = not rows or len({frozenset(x) for x in value}) == 1
    simple = sum(not isinstance(x, nested) for x in parts) / max(1, len(parts)) > MOSTLY if parts is not None else True
    relational = large = False
    for o in objects_within(value):
        for k, v in o.items():
            low = str(k).lower()
            relational = relational or any(p in low for p in RELATIONAL_KEYS)
            large = large or (isinstance(v, str) and len(v) > LARGE_TEXT and any(p in low for p in LARGE_TEXT_KEYS))
    return True, flat, nesting(value), listed, len(keys) == 1, relational, rows and not same, same, simple, large


@F.pandas_udf(FACTS)
def json_facts(text: pd.Series) -> pd.DataFrame:
    """What the JSON rules ask of a text; ``parsed`` is false for text that is no JSON."""
    rows = []
    for t in text:
        try:
            rows.append(value_facts(json.loads(t)))
        except (ValueError, TypeError, RecursionError):
            rows.append((False,) + (None,) * 9)
    return pd.DataFrame(rows, columns=FACTS.names)


@F.pandas_udf(FACTS)
def yaml_facts(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            import yaml

            rows.append(value_facts(yaml.safe_load(t)))
        except Exception:  # any broken document
            rows.append((False,) + (None,) * 9)
    return pd.DataFrame(rows, columns=FACTS.names)


XML_FACTS = _shape("parsed depth repeated same_attributes")


@F.pandas_udf(XML_FACTS)
def xml_facts(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            root = ET.fromstring(t)
        except (ET.ParseError, TypeError, ValueError):
            rows.append((False, None, None, None))
            continue
        most, todo = 0, [(root, 0)]
        while todo:
            e, depth = todo.pop()
            most = max(most, depth)
            todo += [(x, depth + 1) for x in e]
        children = list(root)
        rows.append((True, most, len(children) > 1 and len({c.tag for c in children}) == 1, len(children) > 1 and len({frozenset(c.attrib) for c in children}) == 1))
    return pd.DataFrame(rows, columns=XML_FACTS.names)


def xml_points(facts: Column) -> Points:
    return Points().when(facts["depth"] > 2, 0, 3, "deeply nested").when(facts["repeated"], 3, 0, "repeated tags").when(facts["same_attributes"], 2, 0, "consistent schema")


def classify_files(df: DataFrame, type_col: str = "file_type", text_col: str = "text", columns_col: str | None = None) -> DataFrame:
    """df + (classification, sql_score, nosql_score, confidence, reasons), by the rule set of each file's type.

    Contents reach the parsing UDFs only for the types that need them. Unknown types that hold
    valid JSON or XML are scored as such.
    """
    t, kind = F.col(text_col), F.col(type_col)
    trimmed = F.regexp_replace(F.coalesce(t, F.lit("")), "(?U)^\\s+|\\s+$", "")
    unknown = ~kind.isin("json", "csv", "excel", "xml", "html", "yaml", "text", "md", "log", "pdf", "docx", "ini")
    json_like = (trimmed.startswith("{") & trimmed.endswith("}")) | (trimmed.startswith("[") & trimmed.endswith("]"))
    rows = df.withColumn("_j", json_facts(F.when((kind == "json") | (unknown & json_like), t))).withColumn("_x", xml_facts(F.when((kind == "xml") | (unknown & trimmed.startswith("<")), t))).withColumn("_y", yaml_facts(F.when(kind == "yaml", t)))
    j, x, y = F.col("_j"), F.col("_x"), F.col("_y")
    unknowns, as_json, as_xml = unknown_points(t), json_points(j), xml_points(x)
    # A recognised content takes back the two points of the unknown type and what follows it.
    tables = Points(unknowns.rules[1:3])
    found_json = verdict(tables.total(1) + as_json.total(1), tables.total(2) + as_json.total(2), F.concat(tables.reasons(), as_json.reasons()))
    found_xml = verdict(tables.total(1) + as_xml.total(1), tables.total(2) + as_xml.total(2), F.concat(tables.reasons(), as_xml.reasons()))
    columns = F.col(columns_col) if columns_col else F.expr("cast(array() as array<string>)")
    result = (
        F.when((kind == "json") & j["parsed"], as_json.struct())
        .when(kind.isin("csv", "excel"), tabular_points(columns).struct())
        .when((kind == "xml") & x["parsed"], as_xml.struct())
        .when(kind == "html", html_points(t).struct())
        .when((kind == "yaml") & y["parsed"], yaml_points(y).struct())
        .when(kind.isin("text", "md", "log"), text_points(t).struct())
        .when(kind.isin("pdf", "docx"), document_points(t).struct())
        .when(kind == "ini", Points().when(True, 0, 2, "settings").struct())
        .when(unknown & j["parsed"], found_json)
        .when(unknown & x["parsed"], found_xml)
        .otherwise(unknowns.struct())
    )
    return rows.withColumn("_r", result).drop("_j", "_x", "_y").select("*", "_r.*").drop("_r")
