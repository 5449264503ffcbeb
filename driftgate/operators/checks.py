"""The check pipeline: eleven checks of a candidate against its baseline, as one array column.

Checks run in a fixed order, since the first blocking failure is the reason that is reported. JSON
facts are extracted once a side; every check is an expression over the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions import jsonfacts, text

NAMES = ("empty_output", "truncation", "refusal", "json_parse", "json_schema", "required_fields", "tool_calls", "exact_match", "format_regex", "numeric_tolerance", "length_delta")
TOOL = "array<struct<name:string,arguments:string>>"
#: Columns of a pair and their types; those that a table lacks count as null.
COLUMNS = {
    "case_id": "string", "base_text": "string", "base_tools": TOOL, "base_finish": "string", "cand_text": "string", "cand_tools": TOOL, "cand_finish": "string", "error": "string",
    "tags": "array<string>", "expect_schema": "string", "expect_fields": "array<string>", "expect_regex": "string", "expect_tools": "array<string>", "expect_length": "double", "expect_numbers": "double",
    "forbid_refusal": "boolean", "exact": "boolean", "skip_checks": "array<string>", "response_format": "string", "judged": "string", "judge_note": "string",
}


@dataclass(frozen=True)
class Settings:
    disabled: tuple[str, ...] = ()
    infer_fields: bool = True
    infer_tools: bool = True
    length_ratio: float = 0.5
    length_severity: str = "warning"
    numeric_tolerance: float | None = None
    refusals: tuple[str, ...] = field(default=text.REFUSALS)
    warnings_break: bool = False
    ignore_whitespace: bool = True
    ignore_case: bool = False

    def __post_init__(self):
        if unknown := set(self.disabled) - set(NAMES):
            raise ValueError(f"no such check: {', '.join(sorted(unknown))}")


def completed(pairs: DataFrame) -> DataFrame:
    """The pair with every optional column there."""
    return pairs.withColumns({n: F.lit(None).cast(t) for n, t in COLUMNS.items() if n not in pairs.columns})


#: Status of one's own check on a row on which it raised; it is reported as a warning.
RAISED = "raised"


@dataclass(frozen=True)
class Check:
    """A check of one's own is one of these too: its status, and what is said where it fails."""

    status: Column
    severity: Column | str = "blocking"
    message: Column | str = ""
    evidence: Column | None = None

    def result(self, name: str) -> Column:
        """The struct, read from the column ``s_<name>`` that holds the status."""
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        raised, failed = F.col(f"s_{name}") == RAISED, F.col(f"s_{name}").isin("fail", RAISED)
        return F.struct(
            F.lit(name).alias("check"), F.when(raised, "fail").otherwise(F.col(f"s_{name}")).alias("status"), F.when(raised, "warning").when(failed, lit(self.severity)).otherwise("info").alias("severity"),
            F.when(failed, lit(self.message)).otherwise("").alias("message"), (F.when(failed & ~raised, self.evidence) if self.evidence is not None else F.lit(None)).cast("string").alias("evidence"),
        )

    def isolated(self) -> Check:
        """The same check, which gives a warning on rows on which one of its expressions raises."""
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        said = F.coalesce(tried(lit(self.message)), F.lit("check raised an error"))
        return Check(F.coalesce(tried(self.status), F.lit(RAISED)), F.coalesce(tried(lit(self.severity)), F.lit("warning")), F.when(tried(self.status).isNull(), "check raised an error").otherwise(said), None if self.evidence is None else tried(self.evidence))


def tried(value: Column) -> Column:
    """A text column, null on rows on which its expression raises (a cast, a division, an index under ANSI rules).

    The conversion to bytes is the built-in function that gives null for whatever is raised below it; a lambda
    around the expression keeps parts that it shares with others from being worked out outside.
    """
    inside = F.get(F.transform(F.array(F.lit(0)), lambda _: value.cast("string")), F.lit(0))
    return F.try_to_binary(inside, F.lit("utf-8")).cast("string")


@dataclass(frozen=True)
class Hosted:
    """A check of one's own in Python, over values of ``columns``, row by row in Arrow batches.

    The function gives True (pass), False (fail), None (skip), or a status and a message. Where it
    raises, that row has a warning that says so, and no other row notices.
    """

    function: Callable
    columns: tuple[str, ...]
    severity: str = "blocking"
    message: str = ""

    def column(self) -> Column:
        function, message = self.function, self.message

        def one(values: tuple) -> tuple[str, str]:
            try:
                found = function(*values)
                if found is None or isinstance(found, bool):
                    return {None: "skip", True: "pass", False: "fail"}[found], message
                status, said = found
                if status not in ("pass", "fail", "skip"):
                    raise ValueError(f"no status: {status!r}")
                return status, str(said)
            except Exception as e:  # whatever one's own code raises belongs to this row alone
                return RAISED, f"check raised {type(e).__name__}: {e}"

        @F.arrow_udf("struct<status:string,message:string>")
        def host(*arrays: pa.Array) -> pa.Array:
            rows = [one(values) for values in zip(*(a.to_pylist() for a in arrays), strict=True)]
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["status", "message"])

        return host(*self.columns)

    def check(self, name: str) -> Check:
        """The check that reads the column ``h_<name>``."""
        return Check(F.col(f"h_{name}.status"), self.severity, F.col(f"h_{name}.message"))


def _status(*rules: tuple[Column, str], otherwise: str = "pass") -> Column:
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for test, value in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(otherwise)


def _empty(side: str) -> Column:
    return (F.length(f"{side}_trim") == 0) & (F.coalesce(F.size(f"{side}_tools"), F.lit(0)) <= 0)


def multiset_difference(a: Column, b: Column) -> Column:
    """Names that ``a`` holds oftener than ``b``, with how often."""
    over = lambda k: F.size(F.filter(a, lambda x: x == k)) - F.size(F.filter(b, lambda x: x == k))
    return F.filter(F.transform(F.array_distinct(a), lambda k: F.struct(k.alias("name"), over(k).alias("n"))), lambda x: x["n"] > 0)


def _tool_names(side: str) -> Column:
    return F.coalesce(F.transform(f"{side}_tools", lambda t: t["name"]), F.array().cast("array<string>"))


def _shapes(side: str) -> Column:
    """name(sorted argument keys) of each call, in order."""
    keys = lambda t: F.array_join(F.array_sort(F.coalesce(F.json_object_keys(t["arguments"]), F.array().cast("array<string>"))), ",")
    return F.array_sort(F.transform(F.coalesce(F.col(f"{side}_tools"), F.array().cast(TOOL)), lambda t: F.concat(t["name"], F.lit("("), keys(t), F.lit(")"))))


def tool_signature(side: str) -> Column:
    """Calls as sorted (name, canonical arguments), whatever their order and ids."""
    return F.array_sort(F.transform(F.coalesce(F.col(f"{side}_tools"), F.array().cast(TOOL)), lambda t: F.struct(t["name"].alias("name"), F.coalesce(jsonfacts.canonical(t["arguments"]), F.lit("{}")).alias("arguments"))))


def _named(diff: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(diff), lambda x: F.concat(x["name"], F.lit(" x"), x["n"].cast("string"))), ", ")


def results(s: Settings) -> dict[str, Check]:
    """Every check, over a pair with its facts."""
    b, c = F.col("base_text"), F.col("cand_text")
    # facts are null where a text isn't JSON
    base, cand = ({n: F.col(f"{x}_{n}") for n in jsonfacts.FACTS} for x in ("base", "cand"))
    out: dict[str, Check] = {}
    out["empty_output"] = Check(_status((_empty("base"), "skip"), (_empty("cand"), "fail")), message="nothing came back where there was content before")
    cut = _status((~text.was_cut_off(F.col("cand_finish")), "pass"), (text.was_cut_off(F.col("base_finish")), "skip"), otherwise="fail")
    out["truncation"] = Check(cut, message="the output was cut off", evidence=F.col("cand_finish"))
    phrase = F.col("cand_refusal")
    refused = _status((F.col("forbid_refusal") == False, "skip"), (phrase.isNull(), "pass"), (F.col("base_refusal").isNotNull(), "skip"), otherwise="fail")  # noqa: E712
    out["refusal"] = Check(refused, message="the candidate declines the task", evidence=phrase)
    out["json_parse"] = Check(_status((~base["is_json"], "skip"), (~cand["is_json"], "fail")), message="the baseline is JSON, the candidate is not", evidence=F.substring(c, 1, 160))
    schema = F.coalesce("expect_schema", F.get_json_object("response_format", "$.json_schema.schema"))
    problem = F.col("schema_problem")
    out["json_schema"] = Check(
        _status((schema.isNull(), "skip"), (~cand["is_json"], "fail"), (problem.isNotNull(), "fail")),
        severity=F.when(cand["is_json"] & problem.startswith("!"), "warning").otherwise("blocking"),
        message=F.when(~cand["is_json"], "the candidate is not JSON, so the schema can't hold").otherwise(F.concat(F.lit("schema: "), problem)),
    )
    declared = F.col("expect_fields").isNotNull()
    none = F.array().cast("array<string>")
    expected, found, no_json = F.coalesce(F.array_distinct("expect_fields"), base["fields"], none), F.coalesce(cand["fields"], none), cand["fields"].isNull()
    missing, added = F.array_sort(F.array_except(expected, found)), F.array_sort(F.array_except(found, expected))
    unasked = ~declared & (F.lit(not s.infer_fields) | base["fields"].isNull())
    other = no_json | (F.size(missing) > 0) | (F.size(added) > 0)
    some = lambda label, names: F.concat(F.lit(label), F.array_join(F.slice(names, 1, 10), ", "))
    out["required_fields"] = Check(
        _status((unasked, "skip"), (F.size(expected) == 0, "skip"), (other, "fail")),
        severity=F.when(~no_json & (F.size(missing) == 0), "warning").otherwise("blocking"),
        message=F.when(no_json, "the candidate is not JSON, so no field can be there").when(F.size(missing) > 0, some("fields gone: ", missing)).otherwise(some("fields that are new: ", added)),
        evidence=F.to_json(F.struct(missing.alias("missing"), added.alias("added"))),
    )
    wanted = F.coalesce(F.col("expect_tools"), _tool_names("base") if s.infer_tools else F.array().cast("array<string>"))
    lost, extra = multiset_difference(wanted, _tool_names("cand")), multiset_difference(_tool_names("cand"), wanted)
    reshaped = ~_shapes("base").eqNullSafe(_shapes("cand"))
    undeclared = F.col("expect_tools").isNull() & F.lit(not s.infer_tools)
    out["tool_calls"] = Check(_status((undeclared | ((F.size(wanted) == 0) & (F.size(_tool_names("cand")) == 0)), "skip"), ((F.size(lost) > 0) | (F.size(extra) > 0) | reshaped, "fail")),
        severity=F.when(F.size(lost) > 0, "blocking").otherwise("warning"),
        message=F.when(F.size(lost) > 0, F.concat(F.lit("calls gone: "), _named(lost))).when(F.size(extra) > 0, F.concat(F.lit("calls that are new: "), _named(extra))).otherwise("calls have other arguments"),
    )
    out["exact_match"] = Check(_status((~F.coalesce("exact", F.lit(False)), "skip"), (F.col("base_norm") != F.col("cand_norm"), "fail")), message="the text must not change")
    hit = F.col("pattern_result")
    out["format_regex"] = Check(
        _status((F.col("expect_regex").isNull(), "skip"), (hit != "hit", "fail")),
        severity=F.when(hit == "invalid", "warning").otherwise("blocking"),
        message=F.when(hit == "invalid", "check failed: the pattern is invalid").otherwise("the text lacks the format"),
        evidence=F.col("expect_regex"),
    )
    tolerance = F.coalesce("expect_numbers", F.lit(s.numeric_tolerance).cast("double"))
    # paths meet by hash: looking each up in the other map takes the square of their number; where one side lacks a path, null
    apart = F.map_zip_with(base["numbers"], cand["numbers"], lambda _, x, y: F.coalesce(~text.within(x, y, tolerance), F.lit(False)))
    moved = F.map_keys(F.map_filter(apart, lambda _, x: x))
    numberless = tolerance.isNull() | (tolerance < 0) | base["numbers"].isNull() | cand["numbers"].isNull() | (F.size(base["numbers"]) == 0)
    out["numeric_tolerance"] = Check(
        _status((numberless, "skip"), (F.size(moved) > 0, "fail")),
        message="numbers moved beyond the tolerance",
        evidence=F.array_join(F.slice(moved, 1, 8), ", "),
    )
    limit = F.coalesce("expect_length", F.lit(s.length_ratio))
    before = F.length("base_trim")
    change = F.when(before > 0, F.abs(F.length("cand_trim") - before) / before)
    out["length_delta"] = Check(_status((limit <= 0, "skip"), (change.isNull(), "skip"), (change > limit, "fail")), severity=s.length_severity, message="the length changed beyond the limit", evidence=change.cast("string"))
    return out


def with_facts(pairs: DataFrame, settings: Settings, json: bool = True) -> DataFrame:
    """Facts that need more than an expression, a column each and together; without ``json`` no Python runs at all."""
    pairs = completed(pairs)
    trim = {f"{x}_trim": text.stripped(F.coalesce(F.col(f"{x}_text"), F.lit(""))) for x in ("base", "cand")}
    pairs = pairs.withColumns(trim)
    norms = {f"{x}_norm": text.normalised(F.col(f"{x}_trim"), settings.ignore_whitespace, settings.ignore_case) for x in ("base", "cand")}
    pairs = pairs.withColumns(norms | {f"{x}_refusal": text.refusal_phrase(F.col(f"{x}_trim"), settings.refusals) for x in ("base", "cand")})
    sides = {x: {n: F.col(f"{x}_{n}") for n in jsonfacts.FACTS} for x in ("base", "cand")}
    if not json:
        pairs = pairs.withColumns({f"{x}_{n}": F.lit(None).cast(t) for x in sides for n, t in jsonfacts.KINDS.items()} | {"schema_problem": F.lit(None).cast("string"), "pattern_result": F.lit(None).cast("string")})
    else:
        schema = F.coalesce("expect_schema", F.get_json_object("response_format", "$.json_schema.schema"))
        pairs = pairs.withColumns({
            **{f"{x}_{n}": f(F.col(f"{x}_text")) for x in sides for n, f in jsonfacts.FACTS.items()},
            "schema_problem": jsonfacts.schema_problem(F.col("cand_text"), schema), "pattern_result": jsonfacts.pattern_result(F.col("cand_text"), F.col("expect_regex")),
        })
    return pairs.withColumns({f"{x}_facts": jsonfacts.gathered(columns) for x, columns in sides.items()})


#: Checks of prose outputs, for which those on JSON, schemas and formats would all be skipped.
PROSE = ("empty_output", "truncation", "refusal", "tool_calls", "exact_match", "length_delta")


def evaluate(pairs: DataFrame, settings: Settings | None = None, json: bool = True, extra: dict[str, Check | Hosted] | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with ``checks``, an array of results in order; ``extra`` adds checks of one's own.

    ``json=False`` says that outputs are prose without declared formats: checks that would be
    skipped on each row are left out of the plan, and no Python runs but that of checks of one's own. ``only`` names the
    checks to run. A check of one's own that raises on a row is a warning on that row.
    """
    s = settings or Settings()
    extra = extra or {}
    hosted = {n: c for n, c in extra.items() if isinstance(c, Hosted)}
    own = {n: c.check(n) if isinstance(c, Hosted) else c.isolated() for n, c in extra.items()}
    every = {**results(s), **own}
    wanted = set(only or every) & set(every if json else (*PROSE, *own))
    every = {n: c for n, c in every.items() if n in wanted}
    every = {n: c for n, c in every.items() if n not in s.disabled}
    rows = with_facts(pairs, s, json).withColumns({f"h_{n}": c.column() for n, c in hosted.items() if n in every})
    # each status is a column of its own, so that it is worked out once a row
    rows = rows.withColumns({f"s_{n}": c.status for n, c in every.items()})
    run = F.array(*(c.result(n) for n, c in every.items()))
    kept = F.filter(run, lambda x: ~F.coalesce(F.array_contains(F.col("skip_checks"), x["check"]), F.lit(False)))
    if s.warnings_break:
        kept = F.transform(kept, lambda x: x.withField("severity", F.when(x["severity"] == "warning", "blocking").otherwise(x["severity"])))
    return rows.withColumn("checks", kept).drop(*(f"{k}_{n}" for n in every for k in "sh"), *(f"{x}_{n}" for x in ("base", "cand") for n in jsonfacts.FACTS))
