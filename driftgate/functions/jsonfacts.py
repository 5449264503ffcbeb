"""What the checks need to know about a JSON text, extracted once a text.

The strict test and the comparison of values are expressions. Walking a document of unknown shape
isn't one, so small vectorised functions list its members, its numbers or its leaves, each for the
checks that need it; sets, counts and comparisons of paths are DataFrame work again.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 24


def unfenced(text: Column) -> Column:
    """The body of a fenced block, or the text itself, without outer white space."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?i:json)?", ""), "```[^`]*$", "")
    return F.trim(F.when(F.trim(text).startswith("```"), body).otherwise(text), F.lit(" \n\r\t"))


def is_json(text: Column) -> Column:
    """Strict: wrapping the text as an element and as a member must both parse, so junk behind it can't hide."""
    body = unfenced(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    return F.coalesce(wrapped & (F.length(body) > 0) & F.try_parse_json(body).isNotNull(), F.lit(False))


def deeper_than(text: Column, most: int) -> Column:
    """Whether brackets of a JSON text nest deeper than that; brackets inside strings don't count, and nothing is parsed."""
    aside = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(aside, '"[^"]*+"', ""), r"[^\[\]{}]", "")
    opened = F.length(F.regexp_replace(brackets, r"[\]}]", ""))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(seen: Column, bracket: Column) -> Column:
        now = seen["now"] + F.when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    # few brackets can't nest deep, wherever they are
    every = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(b), F.lit(""))) for b in "[{"), F.lit(0))
    return F.coalesce((every > most) & (opened > most) & (F.aggregate(F.split(brackets, "(?!^)"), start, step)["most"] > most), F.lit(False))


def canonical(text: Column) -> Column:
    """Key-sorted JSON text; what isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def _load(text: str | None):
    body = (text or "").strip()
    if body.startswith("```"):
        body = re.sub(r"^```(?:json)?", "", body, flags=re.I)
        body = body[: body.rfind("```")] if "```" in body else body
    if not body.strip():
        raise ValueError("empty")
    return json.loads(body)


def _leaves(value, path: str, depth: int, found: list) -> None:
    """(path, value) of each leaf in order; paths have list positions."""
    if value and depth <= DEPTH:
        if type(value) is dict:
            for key, child in value.items():
                _leaves(child, f"{path}.{key}" if path else key, depth + 1, found)
            return
        if type(value) is list:
            for place, child in enumerate(value):
                _leaves(child, f"{path}[{place}]", depth + 1, found)
            return
    if path or not isinstance(value, (dict, list)):
        found.append((path or "<root>", value))


def _fields(value, path: str, depth: int, found: set) -> None:
    """Paths of all members, without list positions."""
    if depth > DEPTH:
        return
    if type(value) is dict:
        for key, child in value.items():
            at = f"{path}.{key}" if path else key
            if depth < DEPTH:
                found.add(at)
            if child and type(child) in (dict, list):
                _fields(child, at, depth + 1, found)
    elif type(value) is list:
        for child in value:
            if child and type(child) in (dict, list):
                _fields(child, f"{path}[]", depth + 1, found)


_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False)


def _written(value) -> str:
    """JSON text of a leaf; strings and integers, the most frequent, without a call of the encoder."""
    if type(value) is str:
        return json.encoder.encode_basestring(value)
    return repr(value) if type(value) is int else _ENCODER.encode(value)


def _double(value) -> float | None:
    """A finite number as a double; null for all else."""
    if type(value) is not float and type(value) is not int:
        return None
    try:
        return float(value) if math.isfinite(value) else None
    except OverflowError:  # an integer beyond doubles
        return None


def _found(value) -> list:
    found: list = []
    _leaves(value, "", 0, found)
    return found


def _sorted_fields(value) -> list[str]:
    found: set = set()
    _fields(value, "", 0, found)
    return sorted(found)


def _values(texts: pa.Array) -> list:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _of_json(read: Callable, text: str | None):
    """What ``read`` makes of the document, null where the text isn't JSON."""
    try:
        return read(_load(text))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.BooleanType())
def reads(texts: pa.Array) -> pa.Array:
    """Whether a text is JSON."""
    return pa.array([_of_json(lambda _: True, t) is not None for t in _values(texts)], pa.bool_())


@F.arrow_udf(T.ArrayType(T.StringType()))
def fields(texts: pa.Array) -> pa.Array:
    """Paths of all members of a JSON text without list positions, sorted; null for other texts."""
    return pa.array([_of_json(_sorted_fields, t) for t in _values(texts)], pa.list_(pa.string()))


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def numbers(texts: pa.Array) -> pa.Array:
    """Finite numbers of a JSON text by path; null for other texts."""

    def read(value) -> list:
        return list({path: x for path, leaf in _found(value) if (x := _double(leaf)) is not None}.items())

    return pa.array([_of_json(read, t) for t in _values(texts)], pa.map_(pa.string(), pa.float64()))


def _texts(value) -> dict[str, str]:
    return {path: _written(leaf) for path, leaf in _found(value)}


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def leaves(texts: pa.Array) -> pa.Array:
    """Leaves of a JSON text by path; null for other texts."""
    rows = (_of_json(_texts, t) for t in _values(texts))
    return pa.array([row if row is None else list(row.items()) for row in rows], pa.map_(pa.string(), pa.string()))


_CHANGE = ("path", "before", "after")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _CHANGE])))
def changed_leaves(before: pa.Array, after: pa.Array) -> pa.Array:
    """Leaves that two JSON texts don't write alike, null on the side that lacks one; nothing where a text isn't JSON."""

    def one(a, b) -> list:
        if a == b or (old := _of_json(_texts, a)) is None or (new := _of_json(_texts, b)) is None:
            return []
        changed = [(path, x, new.get(path)) for path, x in old.items() if new.get(path) != x]
        return changed + [(path, None, x) for path, x in new.items() if path not in old]

    rows = [[dict(zip(_CHANGE, c, strict=True)) for c in one(a, b)] for a, b in zip(_values(before), _values(after), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([(n, pa.string()) for n in _CHANGE])))


#: A side's facts, their functions and types. Each is a function of its own, so a plan runs those that are read.
FACTS = {"is_json": reads, "fields": fields, "numbers": numbers, "leaves": leaves}
KINDS = {"is_json": "boolean", "fields": "array<string>", "numbers": "map<string,double>", "leaves": "map<string,string>"}


def gathered(columns: dict[str, Column]) -> Column:
    """is_json, fields, numbers and leaves in one struct; those of texts that aren't JSON are empty."""
    empty = {"is_json": F.lit(False), "fields": F.array(), "numbers": F.create_map(), "leaves": F.create_map()}
    return F.struct(*(F.coalesce(c, empty[n].cast(KINDS[n])).alias(n) for n, c in columns.items()))


def facts(text: Column) -> Column:
    """is_json, fields, numbers and leaves of a JSON text in one struct."""
    return gathered({n: f(text) for n, f in FACTS.items()})


#: Types, and keywords that say nothing about a value.
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": int | float}
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "contentMediaType", "contentEncoding"}
#: Where ``$ref`` chains end.
MOST_REFS = 32


class SchemaError(Exception):
    """The schema itself is wrong."""


def _same(a, b) -> bool:
    """JSON equality: true isn't 1, and 1 is 1.0."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _is_type(value, name: str) -> bool:
    if name not in TYPES:
        raise SchemaError(f"unknown type {name}")
    if isinstance(value, bool):
        return name == "boolean"
    return isinstance(value, TYPES[name]) or name == "integer" and isinstance(value, float) and value.is_integer()


def _matches(pattern: str, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except re.error as e:
        raise SchemaError(f"invalid pattern {pattern}") from e


class _Schema:
    """Validation of one value by a JSON Schema; ``problem`` is the first violation or None."""

    def __init__(self, root):
        self.root = root

    def resolved(self, ref: str):
        if not isinstance(ref, str) or not ref.startswith("#"):
            raise SchemaError(f"$ref {ref} leaves the schema")
        at = self.root
        for part in (p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/")[1:]):
            try:
                at = at[int(part)] if isinstance(at, list) else at[part]
            except (KeyError, IndexError, ValueError, TypeError) as e:
                raise SchemaError(f"$ref {ref} leads nowhere") from e
        return at

    def holds(self, value, schema, refs: int) -> bool:
        return self.problem(value, schema, "", refs) is None

    def problem(self, value, schema, path: str, refs: int = 0) -> str | None:
        if schema is True or schema == {}:
            return None
        here = path or "<root>"
        if schema is False:
            return f"{here}: nothing is allowed"
        if not isinstance(schema, dict):
            raise SchemaError("a schema must be an object")
        for keyword, wanted in schema.items():
            if keyword in NOTES or keyword in ("then", "else", "minContains", "maxContains"):
                continue
            rule = getattr(self, f"k_{keyword.replace('$', '')}", None)
            if rule is None:
                raise SchemaError(f"unknown keyword {keyword}")
            try:
                found = rule(value, wanted, schema, path, refs)
            except TypeError as e:
                raise SchemaError(f"{keyword}: {e}") from e
            if found:
                return found if ": " in found else f"{here}: {found}"
        return None

    def k_ref(self, value, wanted, schema, path, refs):
        if refs > MOST_REFS:
            raise SchemaError(f"$ref {wanted} doesn't end")
        return self.problem(value, self.resolved(wanted), path, refs + 1)

    def k_type(self, value, wanted, schema, path, refs):
        names = wanted if isinstance(wanted, list) else [wanted]
        return None if any([_is_type(value, n) for n in names]) else f"not of type {' or '.join(map(str, names))}"

    def k_enum(self, value, wanted, schema, path, refs):
        return None if any(_same(value, x) for x in wanted) else "not one of the listed values"

    def k_const(self, value, wanted, schema, path, refs):
        return None if _same(value, wanted) else "not the constant"

    def k_allOf(self, value, wanted, schema, path, refs):  # noqa: N802
        return next((p for s in wanted if (p := self.problem(value, s, path, refs))), None)

    def k_anyOf(self, value, wanted, schema, path, refs):  # noqa: N802
        return None if any([self.holds(value, s, refs) for s in wanted]) else "none of anyOf holds"

    def k_oneOf(self, value, wanted, schema, path, refs):  # noqa: N802
        n = sum(self.holds(value, s, refs) for s in wanted)
        return None if n == 1 else f"{n} of oneOf hold"

    def k_not(self, value, wanted, schema, path, refs):
        return "what not names holds" if self.holds(value, wanted, refs) else None

    def k_if(self, value, wanted, schema, path, refs):
        return self.problem(value, schema.get("then" if self.holds(value, wanted, refs) else "else", True), path, refs)

    def k_required(self, value, wanted, schema, path, refs):
        return next((f"{k} is required" for k in wanted if k not in value), None) if isinstance(value, dict) else None

    def k_dependentRequired(self, value, wanted, schema, path, refs):  # noqa: N802
        if not isinstance(value, dict):
            return None
        return next((f"{k} is required beside {own}" for own, more in wanted.items() if own in value for k in more if k not in value), None)

    def _members(self, value, schemas: dict, path, refs):
        return next((p for k, s in schemas.items() if k in value and (p := self.problem(value[k], s, f"{path}.{k}" if path else k, refs))), None)

    def k_properties(self, value, wanted, schema, path, refs):
        return self._members(value, wanted, path, refs) if isinstance(value, dict) else None

    def k_patternProperties(self, value, wanted, schema, path, refs):  # noqa: N802
        if not isinstance(value, dict):
            return None
        return next((p for pattern, s in wanted.items() if (p := self._members(value, {k: s for k in value if _matches(pattern, k)}, path, refs))), None)

    def k_additionalProperties(self, value, wanted, schema, path, refs):  # noqa: N802
        if not isinstance(value, dict):
            return None
        others = [k for k in value if k not in schema.get("properties", {}) and not any(_matches(p, k) for p in schema.get("patternProperties", {}))]
        if wanted is False:
            return f"{path}.{others[0]}: not allowed".removeprefix(".") if others else None
        return self._members(value, dict.fromkeys(others, wanted), path, refs)

    def k_propertyNames(self, value, wanted, schema, path, refs):  # noqa: N802
        return next((f"name {k}" for k in value if not self.holds(k, wanted, refs)), None) if isinstance(value, dict) else None

    def k_minProperties(self, value, wanted, schema, path, refs):  # noqa: N802
        return "number of properties" if isinstance(value, dict) and len(value) < wanted else None

    def k_maxProperties(self, value, wanted, schema, path, refs):  # noqa: N802
        return "number of properties" if isinstance(value, dict) and len(value) > wanted else None

    def k_prefixItems(self, value, wanted, schema, path, refs):  # noqa: N802
        if not isinstance(value, list):
            return None
        return next((p for k, (x, s) in enumerate(zip(value, wanted, strict=False)) if (p := self.problem(x, s, f"{path}[{k}]", refs))), None)

    def k_items(self, value, wanted, schema, path, refs):
        if not isinstance(value, list):
            return None
        if isinstance(wanted, list):
            return self.k_prefixItems(value, wanted, schema, path, refs)
        first = len(schema.get("prefixItems", []))
        return next((p for k, x in enumerate(value[first:], first) if (p := self.problem(x, wanted, f"{path}[{k}]", refs))), None)

    def k_contains(self, value, wanted, schema, path, refs):
        if not isinstance(value, list):
            return None
        n = sum(self.holds(x, wanted, refs) for x in value)
        return None if schema.get("minContains", 1) <= n <= schema.get("maxContains", n) else f"contains holds for {n} items"

    def k_minItems(self, value, wanted, schema, path, refs):  # noqa: N802
        return "number of items" if isinstance(value, list) and len(value) < wanted else None

    def k_maxItems(self, value, wanted, schema, path, refs):  # noqa: N802
        return "number of items" if isinstance(value, list) and len(value) > wanted else None

    def k_uniqueItems(self, value, wanted, schema, path, refs):  # noqa: N802
        if not wanted or not isinstance(value, list):
            return None
        return "items repeat" if any(_same(x, y) for k, x in enumerate(value) for y in value[:k]) else None

    def k_minLength(self, value, wanted, schema, path, refs):  # noqa: N802
        return "length" if isinstance(value, str) and len(value) < wanted else None

    def k_maxLength(self, value, wanted, schema, path, refs):  # noqa: N802
        return "length" if isinstance(value, str) and len(value) > wanted else None

    def k_pattern(self, value, wanted, schema, path, refs):
        return "pattern" if isinstance(value, str) and not _matches(wanted, value) else None

    @staticmethod
    def _is_number(value) -> bool:
        return isinstance(value, int | float) and not isinstance(value, bool)

    def k_minimum(self, value, wanted, schema, path, refs):
        return "range" if self._is_number(value) and value < wanted else None

    def k_maximum(self, value, wanted, schema, path, refs):
        return "range" if self._is_number(value) and value > wanted else None

    def k_exclusiveMinimum(self, value, wanted, schema, path, refs):  # noqa: N802
        return "range" if self._is_number(value) and value <= wanted else None

    def k_exclusiveMaximum(self, value, wanted, schema, path, refs):  # noqa: N802
        return "range" if self._is_number(value) and value >= wanted else None

    def k_multipleOf(self, value, wanted, schema, path, refs):  # noqa: N802
        if not self._is_number(value):
            return None
        ratio = value / wanted if isinstance(wanted, float) or isinstance(value, float) else value % wanted
        return None if (float(ratio).is_integer() if isinstance(ratio, float) else ratio == 0) else "not a multiple"


def _problem(value, schema) -> str | None:
    """First violation of a JSON Schema; '!' before it where the schema itself is wrong or says what isn't known."""
    try:
        return _Schema(schema).problem(value, schema, "")
    except SchemaError as e:
        return f"!{e}"


@F.pandas_udf(T.StringType())
def schema_problem(text: pd.Series, schema: pd.Series) -> pd.Series:
    """Null where the text satisfies the schema, else the first violation ('!' first: the schema is invalid)."""

    read = functools.cache(json.loads)  # many rows share a schema

    def one(t, s):
        if s is None:
            return None
        try:
            wanted = read(s)
        except ValueError:
            return "!<root>: the schema is not JSON"
        try:
            return _problem(_load(t), wanted)
        except ValueError as e:
            return f"<root>: {e}"

    return pd.Series([one(t, s) for t, s in zip(text, schema, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pattern_result(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """'hit', 'miss' or 'invalid': one row with an invalid pattern must not fail the job."""

    def one(t, p):
        if p is None:
            return None
        try:
            return "hit" if re.search(p, t or "", re.S) else "miss"
        except re.error:
            return "invalid"

    return pd.Series([one(t, p) for t, p in zip(text, pattern, strict=True)], dtype=object)
