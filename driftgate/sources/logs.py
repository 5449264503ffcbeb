"""Interaction logs of four shapes, read by schema on read into cases.

Lines are parsed once as VARIANT and every field is a path in it; a bad line is a row with a
reason, so a strict and a lenient import are the same plan with another ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.functions import jsonfacts
from driftgate.operators import baseline
from driftgate.sources import arrays, cases

ROLES = cases.ROLES
#: Characters of a payload, bytes of a line and depth of its JSON, at most.
MOST_CHARS, MOST_LINE_BYTES, MOST_DEPTH = 4 * 1024 * 1024, 64 * 1024 * 1024, 64
NATIVE = ("case_id", "input", "output", "reference")
#: Where a line stands: file, first byte of its block, place in the block; ordered like the lines.
POSITION = "struct<file:string,block:bigint,row:bigint>"


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(at.alias("position"), "value")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """position and value of each line that isn't blank; positions keep file and line order."""
    return _text(spark, path).where(F.trim("value") != "")


def read_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """position and value of the elements of files that are one JSON array each, of any size."""
    return arrays.read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines and of JSON arrays; a file whose first line begins with a bracket is an array.

    Looking at the first lines is a scan of its own; where all files are of one kind,
    ``read_lines`` or ``read_array`` does without.
    """
    lines = _text(spark, path)
    first = lines.groupBy("position.file").agg(F.min_by("value", F.struct("position.block", "position.row")).alias("first"))
    kinds = first.select("file", F.ltrim("first").startswith("[").alias("is_array")).collect()  # one short row a file
    arrays = [r.file for r in kinds if r.is_array]
    if not arrays:
        return read_lines(spark, path)
    others = [r.file for r in kinds if not r.is_array]
    found = read_array(spark, arrays)
    return found.unionByName(read_lines(spark, others)) if others else found


def line_numbers(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` (few, with the ``position`` of ``read_lines``) with ``line``, counted from one in the file.

    Blank lines count. Blocks are counted in one scan; their sums over a file give each block's first line.
    """
    blocks = _text(spark, path).groupBy("position.file", "position.block").agg(F.count(F.lit(1)).alias("n"), F.min("position.row").alias("least"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = blocks.select("file", "block", "least", before.alias("before"))
    keyed = rows.withColumns({"file": F.col("position.file"), "block": F.col("position.block")})
    return keyed.join(numbered, ["file", "block"]).withColumn("line", F.col("before") + F.col("position.row") - F.col("least") + 1).drop("file", "block", "least", "before")


def _get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), F.lit(path), kind)


def _is(path: str, kind: str) -> Column:
    """Whether the value there is an OBJECT, ARRAY, STRING and so on."""
    return F.coalesce(F.schema_of_variant(_get(path, "variant")).startswith(kind), F.lit(False))


def _content(m: Column) -> Column:
    """Text of a message: blocks of text a line each, nothing for null, JSON text for other values."""
    raw = F.try_variant_get(m, F.lit("$.content"), "variant")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit("VOID"))
    blocks = F.filter(F.try_variant_get(m, F.lit("$.content"), "array<variant>"), lambda b: F.try_variant_get(b, F.lit("$.type"), "string") == "text")
    lines = F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, F.lit("$.text"), "string")), lambda t: t.isNotNull() & (t != ""))
    return F.when(kind.startswith("ARRAY"), F.array_join(lines, "\n")).when(kind == "STRING", F.try_variant_get(m, F.lit("$.content"), "string")).when(kind == "VOID", "").otherwise(F.to_json(raw))


def tool_calls(raw: Column) -> Column:
    """Calls of an array of variants: bad items go, arguments become an object's JSON text."""
    named = F.filter(raw, lambda t: F.coalesce(F.try_variant_get(t, F.lit("$.function.name"), "string"), F.try_variant_get(t, F.lit("$.name"), "string")).isNotNull())

    def read(t: Column) -> Column:
        args = F.coalesce(F.try_variant_get(t, F.lit("$.function.arguments"), "variant"), F.try_variant_get(t, F.lit("$.arguments"), "variant"))
        name = F.coalesce(F.try_variant_get(t, F.lit("$.function.name"), "string"), F.try_variant_get(t, F.lit("$.name"), "string"))
        # a string comes as it is, an object as its JSON text
        return F.struct(name.alias("name"), F.trim(F.try_variant_get(args, F.lit("$"), "string")).alias("text"))

    def kinds(t: Column) -> Column:
        strict = F.try_parse_json(F.concat(F.lit("["), t["text"], F.lit("]")))
        return F.struct(t["name"].alias("name"), t["text"].alias("text"), F.schema_of_variant(strict).alias("kind"))

    def wrapped(t: Column) -> Column:
        whole = F.when(F.coalesce(t["text"], F.lit("")) == "", "{}").when(t["kind"].isNull(), F.to_json(F.struct(t["text"].alias("_raw")))).when(t["kind"].startswith("ARRAY<OBJECT"), t["text"])
        return F.struct(t["name"].alias("name"), whole.otherwise(F.concat(F.lit('{"_value":'), t["text"], F.lit("}"))).alias("arguments"))

    return F.transform(F.transform(F.transform(named, read), kinds), wrapped)


def _messages(raw: Column) -> Column:
    return F.transform(raw, lambda m: F.struct(F.try_variant_get(m, F.lit("$.role"), "string").alias("role"), _content(m).alias("content"), tool_calls(F.try_variant_get(m, F.lit("$.tool_calls"), "array<variant>")).alias("tool_calls")))


def _shape() -> Column:
    native = F.lit(True)
    for k in NATIVE:
        native = native & _get(f"$.{k}", "variant").isNotNull()
    proxy = _is("$.request", "OBJECT") & _is("$.response", "OBJECT")
    explicit = _is("$.input", "OBJECT") & _get("$.output", "variant").isNotNull()
    return (
        F.when(F.col("v").isNull(), "not JSON")
        .when(native, "native")
        .when(proxy, "proxy")
        .when(explicit, "explicit")
        .when(_is("$.messages", "ARRAY"), "flat")
        .otherwise("unknown")
    )


def _response(at: str) -> dict[str, Column]:
    """Text, finish reason, calls and model of a response body: chat choices, content blocks or plain text."""
    blocks = F.filter(_get(f"{at}.content", "array<variant>"), lambda b: F.try_variant_get(b, F.lit("$.type"), "string") == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.try_variant_get(b, F.lit("$.text"), "string")), "")
    said = F.when(_is(f"{at}.choices[0].message.content", "STRING"), _get(f"{at}.choices[0].message.content"))
    text = (
        F.when(_is(at, "STRING"), _get(at))
        .when(_get(f"{at}.text", "variant").isNotNull(), _get(f"{at}.text"))
        .when(_is(f"{at}.choices", "ARRAY"), F.coalesce(said, F.lit("")))
        .when(_is(f"{at}.content", "ARRAY"), joined)
    )
    return {
        "text": text,
        "finish": F.coalesce(_get(f"{at}.choices[0].finish_reason"), _get(f"{at}.stop_reason"), _get(f"{at}.finish_reason")),
        "calls": F.coalesce(_get(f"{at}.choices[0].message.tool_calls", "array<variant>"), _get(f"{at}.tool_calls", "array<variant>")),
        "model": _get(f"{at}.model"),
    }


#: Where each shape keeps its sampling parameters; an explicit input has them inside or beside ``params``.
_PARAMS = {"proxy": ("$.request",), "explicit": ("$.input.params", "$.input"), "flat": ("$",), "native": ("$.input.params",)}
_REQUEST = {"proxy": "$.request", "explicit": "$.input", "flat": "$", "native": "$.input"}
#: Columns of a case's input besides its messages, in the order of the fingerprint.
INPUT = ("temperature", "top_p", "max_tokens", "seed", "stop", "tools", "response_format")


def _number(shape: str, name: str, kind: str) -> Column:
    """A number where the shape keeps it; booleans and strings aren't numbers."""
    ok = lambda at: ~_is(f"{at}.{name}", "BOOLEAN") & ~_is(f"{at}.{name}", "STRING")
    return F.coalesce(*(F.when(ok(at), _get(f"{at}.{name}", kind)) for at in _PARAMS[shape]))


def _stop(shape: str) -> Column:
    """Stop sequences as a list; one string is a list of one."""
    here = lambda at: F.when(_is(f"{at}.stop", "ARRAY"), _get(f"{at}.stop", "array<string>")).when(_is(f"{at}.stop", "STRING"), F.array(_get(f"{at}.stop")))
    return F.coalesce(*(here(at) for at in _PARAMS[shape]), F.array().cast("array<string>"))


def _inputs(shape: str) -> dict[str, Column]:
    part = lambda name, kind: F.when(_is(f"{_REQUEST[shape]}.{name}", kind), F.to_json(_get(f"{_REQUEST[shape]}.{name}", "variant")))
    return {
        "temperature": _number(shape, "temperature", "double"),
        "top_p": _number(shape, "top_p", "double"),
        "max_tokens": F.coalesce(_number(shape, "max_tokens", "bigint"), _number(shape, "max_completion_tokens", "bigint")),
        "seed": _number(shape, "seed", "bigint"),
        "stop": _stop(shape),
        "tools": part("tools", "ARRAY"),
        "response_format": part("response_format", "OBJECT"),
    }


def _body(shape: str) -> dict[str, Column]:
    if shape != "flat":
        return _response("$.response" if shape == "proxy" else "$.output")
    string = lambda at: F.when(_is(at, "STRING"), _get(at))
    unsaid = _get("$.completion", "variant").isNull()
    completion = F.coalesce(string("$.completion"), F.when(unsaid, string("$.response_text")), F.when(unsaid & _get("$.response_text", "variant").isNull(), F.lit("")))
    return {"text": completion, "finish": F.lit("stop"), "calls": F.lit(None).cast("array<variant>"), "model": F.lit(None).cast("string")}


def _case(shape: str) -> Column:
    """Everything that a record of one shape says of its case, in one struct; all shapes have the same fields."""
    body = _body(shape)
    model = F.coalesce(_get("$.model"), *([_get("$.request.model")] if shape == "proxy" else []), body["model"], F.lit("unknown"))
    named = cases.model(F.col("v"), "$.reference")
    tags = F.when(_is("$.tags", "ARRAY"), _get("$.tags", "array<string>")).when(_is("$.tags", "STRING"), F.array(_get("$.tags")))
    unsaid = {n: F.lit(cases.DEFAULTS.get(n)).cast(t) if n != "skip_checks" else F.array().cast(t) for n, t in cases.COLUMNS.items()}
    fields = {
        "messages": _messages(_get(f"{_REQUEST[shape]}.messages", "array<variant>")),
        "base_text": F.coalesce(body["text"], F.lit("")) if shape == "native" else body["text"],
        "base_finish": body["finish"],
        "base_tools": tool_calls(body["calls"]),
        "reference": F.coalesce(named, F.concat_ws(":", F.coalesce(_get("$.provider"), F.lit("unknown")), model)),
        "tags": F.coalesce(tags, F.array().cast("array<string>")),
        "given_id": F.when(_is("$.case_id", "STRING"), _get("$.case_id")),
        **_inputs(shape),
        **(cases.columns(F.col("v")) if shape == "native" else unsaid),
        "problem": cases.problem("v") if shape == "native" else F.lit(None).cast("string"),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _reason() -> Column:
    bad_role = F.exists("messages", lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    longest = F.greatest(F.length(F.coalesce("base_text", F.lit(""))), F.array_max(F.transform("messages", lambda m: F.length(m["content"]))))
    return (
        F.when(F.col("guard").isNotNull(), F.col("guard"))
        .when(F.col("shape") == "not JSON", "not JSON")
        .when(F.col("shape") == "unknown", "unrecognised shape")
        .when(F.col("problem").isNotNull(), F.concat(F.lit("native case is invalid: "), F.col("problem")))
        .when(F.col("messages").isNull(), "messages must be a list")
        .when(F.size("messages") == 0, "no messages")
        .when(bad_role, "unsupported role")
        .when(F.col("base_text").isNull(), "no output text")
        .when((F.col("shape") != "native") & (longest > MOST_CHARS), "payload too large")
    )


def _guard() -> Column:
    """Why a line isn't parsed at all."""
    return F.when(F.octet_length("value") > MOST_LINE_BYTES, "line too large").when(jsonfacts.deeper_than(F.col("value"), MOST_DEPTH), "JSON too deep")


def _strict(rows: DataFrame) -> DataFrame:
    """``v``, the record of a line: an array around it must have one element, and it must fit into an object, so junk behind it can't hide.

    The array is a column of its own, so that it is parsed once.
    """
    whole = F.when(F.col("guard").isNull(), F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))))
    element = lambda k: F.try_variant_get("v", F.lit(f"$[{k}]"), "variant")
    alone = element(1).isNull() & F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))).isNotNull()
    return rows.withColumn("v", whole).withColumn("v", F.when(alone, element(0)))


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every line with its shape, the case's columns, and a reason where it can't be one.

    A record's shape is found first, and only the fields of that shape are looked for.
    """
    rows = _strict(lines.withColumnRenamed(value, "value").withColumn("guard", _guard())).withColumn("shape", _shape())
    made = {s: _case(s) for s in _REQUEST}
    case = F.coalesce(*(F.when(F.col("shape") == shape, struct) for shape, struct in made.items()))
    # a generator of one row: what is asked of the case's fields stays above the expressions behind them,
    # which would otherwise be worked out once for each mention of a field
    rows = rows.withColumn("case", F.explode(F.array(case))).drop("v")
    fields = rows.schema["case"].dataType.fieldNames()
    kept = [c for c in rows.columns if c != "case" and c not in (*fields, "reason")]
    rows = rows.select(*kept, "case.*").withColumn("reason", _reason()).drop("problem", "guard")
    # an id that the input itself gives is derived, and follows it when it is redacted
    return rows.withColumn("given_id", F.when(~F.col("given_id").eqNullSafe(F.when(F.col("given_id").isNotNull(), fingerprint())), F.col("given_id")))


def fingerprint() -> Column:
    """Identity of a case's input: messages and everything that was asked for with them."""
    return baseline.fingerprint(F.col("messages"), *(F.col(c) for c in INPUT))


def accepted(rows: DataFrame, tags: tuple[str, ...] = (), reference: str | None = None) -> DataFrame:
    """Good lines as cases; an id that isn't given is the fingerprint of the input."""
    good = rows.where("reason is null").withColumns({"case_id": F.coalesce("given_id", fingerprint()), "tags": baseline.merged_tags(F.col("tags"), tags), "id_is_derived": F.col("given_id").isNull()})
    return good.withColumn("reference", F.lit(reference)) if reference else good


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("position", "reason")


def strict(rows: DataFrame) -> DataFrame:
    """The same rows, failing the job at the first line that can't be a case."""
    ok = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("position").cast("string"), F.lit(": "), F.col("reason"))).cast("string"))
    return rows.withColumn("reason", F.coalesce(ok, F.col("reason")))
