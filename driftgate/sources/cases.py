"""The type of a stored case: what a dumped case may hold, where one goes wrong, its columns, and the dump itself.

The type is a nested description; the test of a record is generated from it as one expression
over the parsed record, which gives the path of the first field that doesn't fit, or null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, F.lit(path), kind)


def _absent(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _get(root: str, at: str, kind: str = "variant") -> str:
    return f"try_variant_get({root}, '{at}', '{kind}')"


def _some(wrong: str) -> str:
    """The first of an array that isn't null."""
    return f"get(filter({wrong}, p -> p is not null), 0)"


# A type's ``problem`` is SQL text, so that a test of any size is one expression to parse. It gives null for
# a value that fits, else the place and what is wrong. The value is at the path ``at`` of the variant
# ``root``, ``place`` is SQL text for what to call it, and ``deep`` counts the lambdas around it.


@dataclass(frozen=True)
class Scalar:
    """A value that reads as ``cast``, of one of ``kinds`` of JSON values."""

    what: str
    cast: str
    kinds: tuple[str, ...]
    pattern: str = ""
    among: tuple[str, ...] = ()

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        kind, read = f"schema_of_variant({_get(root, at)})", _get(root, at, self.cast)
        right = [f"split_part({kind}, '(', 1) in ({', '.join(map(repr, self.kinds))})", f"{read} is not null"]
        if self.pattern:
            right.append(f"{_get(root, at, 'string')} rlike r'{self.pattern}'")
        if self.among:
            right.append(f"{read} in ({', '.join(map(repr, self.among))})")
        return f"case when not coalesce({' and '.join(right)}, false) then concat({place}, ' is not {self.what}') end"


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
TEXT = Scalar("a text", "string", ("STRING",))
REAL = Scalar("a number", "double", (*NUMBERS, "STRING", "BOOLEAN"))
WHOLE = Scalar("a whole number", "bigint", (*NUMBERS, "STRING", "BOOLEAN"), r"^([+-]?\d+(\.0*)?|true|false)$")
TRUTH = Scalar("true or false", "boolean", ("BOOLEAN", "STRING", "BIGINT", "DECIMAL"), "^(?i:true|false|yes|no|on|off|[tfyn10])$")
TIME = Scalar("a time with a zone", "timestamp", ("STRING",), r"(Z|[+-]\d\d:?\d\d)$")
ROLE = Scalar(f"one of {', '.join(ROLES)}", "string", ("STRING",), among=ROLES)


@dataclass(frozen=True)
class Anything:
    """An object, whatever it holds."""

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        return f"case when {_get(root, at, 'map<string,variant>')} is null then concat({place}, ' is not an object') end"


@dataclass(frozen=True)
class Items:
    of: object
    least: int = 0

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        items, x, k = _get(root, at, "array<variant>"), f"x{deep}", f"k{deep}"
        each = self.of.problem(x, "$", f"concat({place}, '[', {k}, ']')", deep + 1)
        empty = f"when size({items}) < {self.least} then concat({place}, ' is empty') " if self.least else ""
        return f"case when {items} is null then concat({place}, ' is not a list') {empty}else {_some(f'transform({items}, ({x}, {k}) -> {each})')} end"


@dataclass(frozen=True)
class Values:
    """An object whose values are all of one type."""

    of: object

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        here, x = _get(root, at, "map<string,variant>"), f"x{deep}"
        each = self.of.problem(f"{x}.value", "$", f"concat({place}, '.', {x}.key)", deep + 1)
        return f"case when {here} is null then concat({place}, ' is not an object') else {_some(f'transform(map_entries({here}), {x} -> {each})')} end"


@dataclass(frozen=True)
class Object:
    """An object with these keys and no others; ``needed`` must be there, ``free`` may be null."""

    fields: dict = field(hash=False)
    needed: tuple[str, ...] = ()
    free: tuple[str, ...] = ()

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        here = _get(root, at, "map<string,variant>")
        strange = f"array_min(array_except(map_keys({here}), array({', '.join(map(repr, self.fields))})))"
        tests = [f"concat({place}, '.', {strange}, ' is not known')"]
        for name, kind in self.fields.items():
            value, named = _get(root, f"{at}.{name}"), f"concat({place}, '.{name}')"
            test = kind.problem(root, f"{at}.{name}", named, deep)
            if name in self.needed:
                test = f"if({value} is null, concat({named}, ' is missing'), {test})"
            elif name in self.free:
                test = f"if({value} is null or is_variant_null({value}), null, {test})"
            else:
                test = f"if({value} is null, null, {test})"
            tests.append(test)
        return f"case when {here} is null then concat({place}, ' is not an object') else coalesce({', '.join(tests)}) end"


@dataclass(frozen=True)
class Either:
    """A text or the other type."""

    other: object

    def problem(self, root: str, at: str, place: str, deep: int = 0) -> str:
        return f"if(coalesce(schema_of_variant({_get(root, at)}) = 'STRING', false), null, {self.other.problem(root, at, place, deep)})"


CALL = Object({"name": TEXT, "arguments": Anything(), "call_id": TEXT}, ("name",), ("call_id",))
MESSAGE = Object({"role": ROLE, "content": TEXT, "tool_calls": Items(CALL), "name": TEXT, "tool_call_id": TEXT}, ("role",), ("content", "name", "tool_call_id"))
PARAMS = Object({"temperature": REAL, "top_p": REAL, "max_tokens": WHOLE, "seed": WHOLE, "stop": Items(TEXT), "extra": Anything()}, (), ("temperature", "top_p", "max_tokens", "seed"))
INPUT = Object({"messages": Items(MESSAGE, 1), "params": PARAMS, "tools": Items(Anything()), "response_format": Anything()}, ("messages",), ("response_format",))
OUTPUT = Object({"text": TEXT, "tool_calls": Items(CALL), "finish_reason": TEXT, "model": TEXT, "usage": Values(WHOLE)}, (), ("finish_reason", "model"))
MODEL = Either(Object({"provider": TEXT, "model": TEXT}, ("provider", "model")))
EXPECTATIONS = Object(
    {"json_schema": Anything(), "required_fields": Items(TEXT), "format_regex": TEXT, "must_call_tools": Items(TEXT), "max_length_delta_ratio": REAL, "numeric_tolerance": REAL, "forbid_refusal": TRUTH, "exact_match": TRUTH, "skip_checks": Items(TEXT)},
    (), ("json_schema", "required_fields", "format_regex", "must_call_tools", "max_length_delta_ratio", "numeric_tolerance", "forbid_refusal"),
)
CASE = Object(
    {"case_id": TEXT, "input": INPUT, "output": OUTPUT, "reference": MODEL, "captured_at": TIME, "tags": Items(TEXT), "expectations": EXPECTATIONS, "redacted": TRUTH, "revision": WHOLE, "accepted_at": TIME, "previous_reference": MODEL},
    ("case_id", "input", "output", "reference"), ("accepted_at", "previous_reference"),
)


def problem(name: str) -> Column:
    """Path of the first field of the parsed case in a column that doesn't fit, and what is wrong there; null for a good one."""
    return F.ltrim(F.expr(CASE.problem(name, "$", "''")), F.lit("."))


#: What only a dumped case has besides its messages, output and parameters. ``details`` holds what no operator reads:
#: names and call ids by message, further parameters, usage and the model, each as it is in the record.
DETAILS = "struct<names:array<string>,answers:array<string>,asked:array<array<string>>,said:array<string>,extra:string,usage:string,model:string>"
COLUMNS = {
    "expect_schema": "string", "expect_fields": "array<string>", "expect_regex": "string", "expect_tools": "array<string>", "expect_length": "double", "expect_numbers": "double", "forbid_refusal": "boolean", "exact": "boolean", "skip_checks": "array<string>",
    "revision": "bigint", "captured_at": "timestamp", "accepted_at": "timestamp", "previous_reference": "string", "redacted": "boolean", "details": DETAILS,
}
#: What a record that doesn't say has in these columns; lists are empty, all else is null.
DEFAULTS = {"exact": False, "revision": 1, "redacted": False}


def model(v: Column, at: str) -> Column:
    """provider:model of a reference, a text or an object."""
    both = _at(v, f"{at}.provider", "string"), _at(v, f"{at}.model", "string")
    whole = F.when(both[0].isNotNull() & both[1].isNotNull(), F.concat_ws(":", *both))
    return F.coalesce(whole, F.when(F.coalesce(F.schema_of_variant(_at(v, at, "variant")) == "STRING", F.lit(False)), _at(v, at, "string")))


def columns(v: Column) -> dict[str, Column]:
    """The columns of ``COLUMNS`` of a parsed case."""
    get = lambda path, kind="string": _at(v, path, kind)
    json = lambda path: F.when(~_absent(get(path, "variant")), F.to_json(get(path, "variant")))
    e = "$.expectations"
    ids = lambda calls: F.transform(calls, lambda t: _at(t, "$.call_id", "string"))
    messages = get("$.input.messages", "array<variant>")
    details = F.struct(
        F.transform(messages, lambda m: _at(m, "$.name", "string")).alias("names"), F.transform(messages, lambda m: _at(m, "$.tool_call_id", "string")).alias("answers"),
        F.transform(messages, lambda m: ids(_at(m, "$.tool_calls", "array<variant>"))).alias("asked"), ids(get("$.output.tool_calls", "array<variant>")).alias("said"),
        json("$.input.params.extra").alias("extra"), json("$.output.usage").alias("usage"), get("$.output.model").alias("model"),
    )
    return {
        "expect_schema": json(f"{e}.json_schema"), "expect_fields": get(f"{e}.required_fields", "array<string>"), "expect_regex": get(f"{e}.format_regex"), "expect_tools": get(f"{e}.must_call_tools", "array<string>"),
        "expect_length": get(f"{e}.max_length_delta_ratio", "double"), "expect_numbers": get(f"{e}.numeric_tolerance", "double"), "forbid_refusal": get(f"{e}.forbid_refusal", "boolean"),
        "exact": F.coalesce(get(f"{e}.exact_match", "boolean"), F.lit(DEFAULTS["exact"])), "skip_checks": F.coalesce(get(f"{e}.skip_checks", "array<string>"), F.array().cast("array<string>")),
        "revision": F.coalesce(get("$.revision", "bigint"), F.lit(DEFAULTS["revision"])), "captured_at": get("$.captured_at", "timestamp"), "accepted_at": get("$.accepted_at", "timestamp"),
        "previous_reference": model(v, "$.previous_reference"), "redacted": F.coalesce(get("$.redacted", "boolean"), F.lit(DEFAULTS["redacted"])), "details": details,
    }


def dump(cases: DataFrame) -> DataFrame:
    """case_id and ``value``, the case as one line of JSON that reads back as the same case.

    ``cases`` has the columns that a log gives; those that it lacks count as null. JSON texts inside a
    case (arguments, tools, schemas) stand in the line as they are.
    """
    types = {
        "messages": "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>", "base_text": "string", "base_tools": "array<struct<name:string,arguments:string>>", "base_finish": "string", "reference": "string", "tags": "array<string>",
        "temperature": "double", "top_p": "double", "max_tokens": "bigint", "seed": "bigint", "stop": "array<string>", "tools": "string", "response_format": "string", **COLUMNS,
    }
    rows = cases.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in cases.columns})
    text = lambda x: F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    listed = lambda xs, one: F.concat(F.lit("["), F.array_join(F.transform(xs, one), ","), F.lit("]"))

    def members(**values: Column) -> Column:
        """An object of the members whose JSON text isn't null."""
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v) for n, v in values.items())), F.lit("}"))

    def calls(found: Column, ids: Column) -> Column:
        return listed(found, lambda t, k: members(name=text(t["name"]), arguments=F.coalesce(t["arguments"], F.lit("{}")), call_id=text(F.get(ids, k))))

    def message(m: Column, k: Column) -> Column:
        asked = F.get(F.col("details.asked"), k)
        return members(role=text(m["role"]), content=text(F.coalesce(m["content"], F.lit(""))), tool_calls=calls(m["tool_calls"], asked), name=text(F.get(F.col("details.names"), k)), tool_call_id=text(F.get(F.col("details.answers"), k)))

    def ref(name: str) -> Column:
        whole = F.col(name)
        provider = F.substring_index(whole, ":", 1)
        return F.when(whole.isNotNull(), members(provider=text(provider), model=text(F.expr(f"substr({name}, length(substring_index({name}, ':', 1)) + 2)"))))

    as_json = lambda name: text(F.col(name))
    time = lambda name: text(F.date_format(F.to_utc_timestamp(F.col(name), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    params = members(temperature=as_json("temperature"), top_p=as_json("top_p"), max_tokens=as_json("max_tokens"), seed=as_json("seed"), stop=listed(F.col("stop"), text), extra=F.col("details.extra"))
    expectations = members(
        json_schema=F.col("expect_schema"), required_fields=listed(F.col("expect_fields"), text), format_regex=as_json("expect_regex"), must_call_tools=listed(F.col("expect_tools"), text), max_length_delta_ratio=as_json("expect_length"),
        numeric_tolerance=as_json("expect_numbers"), forbid_refusal=as_json("forbid_refusal"), exact_match=as_json("exact"), skip_checks=listed(F.col("skip_checks"), text),
    )
    line = members(
        case_id=text(F.col("case_id")),
        input=members(messages=listed(F.col("messages"), message), params=params, tools=F.col("tools"), response_format=F.col("response_format")),
        output=members(text=text(F.coalesce("base_text", F.lit(""))), tool_calls=calls(F.col("base_tools"), F.col("details.said")), finish_reason=as_json("base_finish"), model=as_json("details.model"), usage=F.col("details.usage")),
        reference=ref("reference"), captured_at=time("captured_at"), tags=listed(F.col("tags"), text), expectations=expectations, redacted=as_json("redacted"), revision=as_json("revision"), accepted_at=time("accepted_at"), previous_reference=ref("previous_reference"),
    )
    return rows.select("case_id", line.alias("value"))
