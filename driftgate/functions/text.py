"""Text expressions; all of them stay inside generated code."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the logs' producers see it: wider than Java's default class.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Phrases that open a refusal, and how far into the text they are looked for.
REFUSALS = (
    r"i can'?t help with that",
    r"i cannot help with that",
    r"i can'?t assist with",
    r"i cannot assist with",
    r"i'?m not able to help",
    r"i am not able to help",
    r"i'?m unable to (?:help|assist|provide)",
    r"i am unable to (?:help|assist|provide)",
    r"i (?:can'?t|cannot) (?:provide|create|generate) that",
    r"i (?:must|have to) decline",
    r"as an ai(?: language)? model,? i (?:can'?t|cannot)",
    r"sorry,? (?:but )?i (?:can'?t|cannot)",
)
REFUSAL_CHARS = 400
#: Finish reasons of an output that was cut off.
CUT_OFF = ("length", "max_tokens", "max_output_tokens")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that full case folding changes: those that become one character, and those that become several."""
    changed = {chr(k): chr(k).casefold() for k in range(0x110000) if chr(k).casefold() != chr(k)}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """Full case folding of Unicode: one pass over a table, and one more where a character becomes several."""
    single, several = _folds()
    passed = F.translate(text, "".join(single), "".join(single.values()))
    longer = F.map_from_arrays(F.split(F.lit(" ".join(several)), " "), F.split(F.lit(" ".join(several.values())), " "))
    each = F.array_join(F.transform(F.split(passed, ""), lambda c: F.coalesce(F.try_element_at(longer, c), c)), "")
    return F.when(passed.rlike("[" + "".join(several) + "]"), each).otherwise(passed)


def normalised(text: Column, ignore_whitespace: bool = True, ignore_case: bool = False) -> Column:
    """Text for comparison: spaces collapsed, and case-folded if asked."""
    if ignore_whitespace:
        text = F.regexp_replace(stripped(text), f"{SPACE}+", " ")
    return folded(text) if ignore_case else text


def refusal_phrase(trimmed: Column, patterns: tuple[str, ...] = REFUSALS) -> Column:
    """The first pattern that opens a trimmed text, or null; one search settles most texts."""
    head = F.substring(trimmed, 1, REFUSAL_CHARS)
    return F.when(head.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.coalesce(*(F.when(head.rlike(f"(?i){p}"), F.lit(p)) for p in patterns)))


def was_cut_off(finish: Column) -> Column:
    return F.coalesce(F.lower(finish).isin(*CUT_OFF), F.lit(False))


def within(before: Column, after: Column, tolerance: Column) -> Column:
    """Relative closeness, absolute where the first value is about zero."""
    gap, scale = F.abs(after - before), F.abs(before)
    return (before == after) | F.when(scale < 1e-9, gap <= tolerance).otherwise(F.try_divide(gap, scale) <= tolerance)
