"""What a SQL text refers to: tables, columns, compared literals.

Single statements are read with Spark's own parser. Columns of statements at scale are read with patterns,
which stay in the JVM and give tables and quoted literals only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

COMPARES = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "In": "IN", "Like": "LIKE", "ILike": "ILIKE", "UnresolvedBetween": "BETWEEN", "Between": "BETWEEN"}

#: Comparisons that the parser leaves as calls.
COMPARE_CALLS = {"between": "BETWEEN", "like": "LIKE", "ilike": "ILIKE"}


def normalized(sql: str) -> str:
    """Without line comments and the final semicolon; double quotes after = and LIKE become single ones."""
    out = re.sub(r"--[^\n]*", "", sql).strip().rstrip(";").strip()
    return re.sub(r"(=|\blike)\s*\"([^\"]*)\"", lambda m: f"{m.group(1)} '{m.group(2)}'", out, flags=re.I)


def clean_answer(c: Column) -> Column:
    """The statement in a model's answer: out of its fence, from the first SELECT or WITH on, without semicolon."""
    inside = F.regexp_extract(c, "(?is)```(?:sql)?\\s*(.*?)\\s*```", 1)
    body = F.when(inside != "", inside).otherwise(c)
    start = F.regexp_extract(body, "(?is)((?:select|with)\\s.*)", 1)
    return F.nullif(F.regexp_replace(start, "[;\\s]+$", ""), F.lit(""))


def tables_in(c: Column) -> Column:
    """Lower-case names after FROM and JOIN, each once, sorted."""
    found = F.regexp_extract_all(c, F.lit("(?i)\\b(?:from|join)\\s+([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def quoted_literals(c: Column) -> Column:
    """Single-quoted literals, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))))


@dataclass
class Node:
    kind: str
    data: dict
    children: list["Node"] = field(default_factory=list)


def _tree(flat: list[dict]) -> Node:
    """Spark's pre-order list of nodes as a tree; expressions held in fields become children too."""
    at = 0

    def build() -> Node:
        nonlocal at
        data = flat[at]
        at += 1
        node = Node(data["class"].rpartition(".")[2], data)
        node.children = [build() for _ in range(data.get("num-children", 0))]
        for value in data.values():
            node.children += list(_inner(value))
        return node

    return build()


def _inner(value: object) -> Iterator[Node]:
    if isinstance(value, list) and value:
        if isinstance(value[0], dict) and "class" in value[0]:
            yield _tree(value)
        else:
            for v in value:
                yield from _inner(v)


def parsed(spark: SparkSession, sql: str) -> Node:
    """The unresolved plan of a statement; raises on a syntax error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(normalized(sql))
    return _tree(json.loads(plan.toJSON()))


def valid(spark: SparkSession, sql: str) -> bool:
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(normalized(sql))
        return True
    except Exception:  # noqa: BLE001 - any failure of the parser means the text is no statement
        return False


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from _walk(c)


def _names(raw: object) -> list[str]:
    if isinstance(raw, list):
        return [str(x) for x in raw]
    return [x.strip() for x in str(raw).strip("[]").split(",")]


@dataclass
class Anchors:
    tables: list[str]
    columns: list[str]
    literals: list[tuple[str | None, str, str]]


def anchors(spark: SparkSession, sql: str, columns: dict[str, list[str]]) -> Anchors:
    """Tables, `table.column` references and compared literals (reference, operator, literal) of a statement.

    `columns`: columns by table. Aliases are resolved; an unqualified column belongs to the one table of the
    statement that has it; what cannot be resolved is left out. Format arguments are no literals, `%` is
    stripped from patterns.
    """
    root = parsed(spark, sql)
    known = {t.lower(): {c.lower(): c for c in cols} for t, cols in columns.items()}
    spelled = {t.lower(): t for t in columns}
    alias: dict[str, str] = {}
    used: list[str] = []
    for n in _walk(root):
        if n.kind == "UnresolvedRelation":
            name = _names(n.data.get("multipartIdentifier"))[-1].lower()
            if name in known:
                alias[name] = name
                used.append(name)
        if n.kind == "SubqueryAlias":
            name = str(n.data.get("identifier", {}).get("name", "") if isinstance(n.data.get("identifier"), dict) else n.data.get("identifier", "")).lower()
            inner = [c for c in n.children if c.kind == "UnresolvedRelation"]
            if inner and name:
                target = _names(inner[0].data.get("multipartIdentifier"))[-1].lower()
                if target in known:
                    alias[name] = target

    def resolve(n: Node) -> str | None:
        parts = [p.lower().strip("`") for p in _names(n.data.get("nameParts"))]
        if len(parts) >= 2 and alias.get(parts[-2]) and parts[-1] in known[alias[parts[-2]]]:
            t = alias[parts[-2]]
            return f"{spelled[t]}.{known[t][parts[-1]]}"
        homes = [t for t in dict.fromkeys(used) if parts[-1] in known[t]] if len(parts) == 1 else []
        return f"{spelled[homes[0]]}.{known[homes[0]][parts[0]]}" if len(homes) == 1 else None

    refs = [r for n in _walk(root) if n.kind == "UnresolvedAttribute" and (r := resolve(n))]
    literals: list[tuple[str | None, str, str]] = []
    for n in _walk(root):
        operator = COMPARES.get(n.kind) or (COMPARE_CALLS.get(_names(n.data.get("nameParts"))[-1].lower()) if n.kind == "UnresolvedFunction" else None)
        if operator:
            own = [r for c in n.children for x in _walk(c) if x.kind == "UnresolvedAttribute" and (r := resolve(x))]
            for c in n.children:
                if c.kind == "Literal" and c.data.get("dataType") == "string":
                    text = str(c.data.get("value"))
                    literals.append((own[0] if own else None, operator, text.strip("%") if "LIKE" in operator else text))
    return Anchors(sorted({spelled[t] for t in used}), sorted(set(refs)), sorted(set(literals), key=str))
