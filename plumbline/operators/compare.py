"""Strict comparison of JSON documents and of row sets.

Documents are flattened to one entry per value: its route (the keys and positions that lead to it, each with the kind of
container it is in), path (JSON pointer), kind and text. Two documents are set against each other by a join on the route,
so values meet only where all containers around them are of one kind. What one side alone has is a difference if the
other side has the object that should hold it; positions past the end of an array are told by the array's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: reasons of a difference
TYPE, MISSING, UNEXPECTED, LENGTH, VALUE, MULTISET = "type", "missing_field", "unexpected_field", "array_length", "value", "multiset"
INVALID, POLICY = "invalid_json", "invalid_policy"
NAMES = ["pair_id", "path", "reason", "expected", "actual"]


def strict_json(text: str) -> Any:
    """Parsed JSON; repeated keys, NaN and infinities are refused."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key occurs more than once")
        return out

    def refuse(token: str) -> None:
        raise ValueError(f"{token} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def kind(v: Any) -> str:
    return {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null", list: "array", dict: "object"}[type(v)]


def tagged(v: Any) -> str:
    """Canonical text that tells 1, 1.0, true and "1" apart."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{tagged(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(tagged, v)) + "]"
    return f"{kind(v)}:{json.dumps(v)}"


def flatten(document: Any, unordered: frozenset[str]) -> Iterator[tuple]:
    """(route, parent route, path, in an object, kind, value) of each value. An unordered array is one value: the sorted
    texts of its members; a container's value is its size."""
    todo = [("", None, "", False, document)]
    while todo:
        route, parent, path, in_object, v = todo.pop()
        what = kind(v)
        if what == "array" and path in unordered:
            yield route, parent, path, in_object, "multiset", json.dumps(sorted(map(tagged, v)))
            continue
        inner = v.items() if what == "object" else enumerate(v) if what == "array" else ()
        yield route, parent, path, in_object, what, str(len(v)) if what in ("object", "array") else tagged(v)
        for k, x in inner:
            step = "/" + str(k).replace("~", "~0").replace("/", "~1")
            todo.append((f"{route}{'.' if what == 'object' else '#'}{step}", route, path + step, what == "object", x))


def flat_values(text: str | None, unordered: frozenset[str]) -> dict[str, tuple]:
    """Values of a document by route; what is no strict JSON raises."""
    if text is None:
        raise ValueError("no document")
    return {f[0]: f[1:] for f in flatten(strict_json(text), unordered)}


def refusal(sides: list[str | None], unordered: frozenset[str]) -> tuple[list[dict[str, tuple]], tuple | None]:
    """Both sides' values, or the one difference that names why the first unfit side is refused."""
    out: list[dict[str, tuple]] = []
    for text in sides:
        try:
            out.append(flat_values(text, unordered))
        except (ValueError, TypeError, RecursionError) as e:
            return out, ("", f"{INVALID}: {e}", None, None)
        lost = unordered - {path for _, path, _, what, _ in out[-1].values() if what == "multiset"}
        if lost:
            return out, (min(lost), f"{POLICY}: an unordered pointer must name an array in both documents", None, None)
    return out, None


def value_differences(expected: dict[str, tuple], actual: dict[str, tuple]) -> Iterator[tuple]:
    """(path, reason, expected, actual) by an outer join of the sides on the route."""
    shown = {"multiset": "array"}
    for one, other, reason in ((expected, actual, MISSING), (actual, expected, UNEXPECTED)):
        for route in one.keys() - other.keys():
            parent, path, in_object, _, value = one[route]
            # the other side has the object that should hold it
            if in_object and parent in other and other[parent][3] == "object":
                yield (path, reason, value, None) if reason == MISSING else (path, reason, None, value)
    for route in expected.keys() & actual.keys():
        (_, path, _, kind_a, a), (*_, kind_b, b) = expected[route], actual[route]
        if kind_a != kind_b:
            yield path, TYPE, shown.get(kind_a, kind_a), shown.get(kind_b, kind_b)
        elif a != b and kind_a != "object":
            yield path, {"array": LENGTH, "multiset": MULTISET}.get(kind_a, VALUE), a, b


def compare_documents(pairs: DataFrame, unordered: Iterable[str] = ()) -> DataFrame:
    """pairs (pair_id, expected, actual: JSON texts) -> pair_id, path, reason, expected, actual. The sides of a pair stand in
    one row, so pairs are compared where they are read, without a shuffle; rows that repeat a pair_id are pairs of their own.
    A pair with a refused text or pointer has one difference, that names why. Arrays at the unordered pointers are compared
    as multisets; such a pointer inside another fails."""
    free = frozenset(unordered)
    if any(a != b and b.startswith(f"{a}/") for a in free for b in free):
        raise ValueError("an unordered array cannot hold another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                sides, refused = refusal(texts, free)
                out += [(pair, *d) for d in ([refused] if refused else sorted(value_differences(*sides), key=lambda d: d[:2]))]
            columns = list(zip(*out)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=NAMES)

    return pairs.select(F.col("pair_id").cast("string"), "expected", "actual").mapInArrow(run, ", ".join(f"{n} string" for n in NAMES))


def multiset_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows by which two sets differ, repeats counted: the columns, surplus (in expected over actual; below 0 the
    other way). One aggregate over both sides; nulls are equal to each other."""
    n = expected.columns
    both = expected.select(*n, F.lit(1).alias("__w")).unionByName(actual.select(*n, F.lit(-1).alias("__w")))
    return both.groupBy(*n).agg(F.sum("__w").alias("surplus")).where("surplus != 0")
