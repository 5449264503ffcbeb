"""Deliberate degradations of an output, as expressions: the offline candidate for tests and drills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the text of a declined request.
REFUSAL = "I'm sorry, but I can't help with that request."


def _without_first_key(text: Column) -> Column:
    """JSON object without its first key by name; other text as it is."""
    pairs = F.from_json(text, "map<string,string>")
    keys = F.array_sort(F.map_keys(pairs))
    left = F.transform(F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1))), lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), F.to_json(F.try_variant_get(F.try_parse_json(text), F.concat(F.lit("$['"), k, F.lit("']")), "variant"))))
    return F.when(F.size(keys) > 0, F.concat(F.lit("{"), F.array_join(F.transform(left, lambda x: F.regexp_replace(x, r"^\[(.*?)\]:", "$1:")), ","), F.lit("}"))).otherwise(text)


TEXTS = {
    "identical": lambda t: t,
    "reword": lambda t: F.concat(F.lit("Rephrased: "), t),
    "refuse": lambda t: F.lit(REFUSAL),
    "truncate": lambda t: F.substring(t, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(t) / 2).cast("int"))),
    "empty": lambda t: F.lit(""),
    "double": lambda t: F.concat(t, F.lit(" "), t),
    "spaces": lambda t: F.replace(t, F.lit(" "), F.lit("  ")),
    "inflate": lambda t: F.concat(t, F.lit(" "), F.repeat(F.lit("padding "), 200)),
    "break_json": lambda t: F.concat(t, F.lit(" <<not json>>")),
    "lost": lambda t: F.lit(None).cast("string"),
}


def mutated(cases: DataFrame) -> DataFrame:
    """cand_text and cand_finish after the row's ``mutation``; an unknown one leaves the output as it is."""
    text, kind = F.col("base_text"), F.col("mutation")
    new = F.coalesce(*(F.when(kind == k, F.struct(f(text).alias("t"))) for k, f in TEXTS.items()), F.when(kind == "drop_field", F.struct(_without_first_key(text).alias("t"))), F.struct(text.alias("t")))
    return cases.withColumns({"cand_text": new["t"], "cand_finish": F.when(kind == "truncate", "length").otherwise(F.col("base_finish"))})


def without_last_call(tools: Column) -> Column:
    return F.slice(tools, F.lit(1), F.greatest(F.size(tools) - 1, F.lit(0)))
