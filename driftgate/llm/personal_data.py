"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Each kind of data has a pattern that proposes spans from left to right without overlaps, a validator
(part sizes of an address, Luhn for cards, digit counts for phones, mod-97 for IBANs, area rules for
social security numbers) and words whose presence before or behind a span raises or lowers its score.
Four kinds are *base* kinds: their valid spans always stay, whatever their score. The other kinds
stay from ``LEAST_SCORE`` on and give way to a base span that they overlap.

All patterns take time linear in the text: a run of characters is entered at its first one only, so a
megabyte of digits, dots or letters costs no more than prose. Texts are looked at whole, in the scan;
nothing is shuffled, and the other columns of a row never leave the JVM.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; spans
are ordered by start, then by kind in the order of ``KINDS``; repeated rows give repeated results;
null ids are carried; an empty table gives no rows; extra columns, ``spans`` among them, are left alone
by ``personal_spans``, which is a column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.work import SLICE, table

#: The kinds in the order that ties between spans follow.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
KINDS = BASE + ADDED

LEAST_SCORE = 0.5
#: Code points before and behind a span whose words count.
BEFORE, BEHIND = 60, 30
#: What a word that speaks for or against a kind adds or takes.
STEP = 0.35

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Shorter chains of digits can't be cards, and a part of a chain is never longer than the chain.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")
NOT_DIGIT = re.compile("[^0-9]")

#: Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 18, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(doubled[int(d)] for d in back[1::2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether the check digits of an account number without spaces are right."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """A mailbox is the run of its characters that ends at an @, cut where the span before it ended."""
    low = 0
    for m in DOMAIN.finditer(text):
        before = text[low : m.start()]
        name, low = len(before) - len(before.rstrip(LOCAL)), m.start() + 1
        if name:
            yield m.start() - name, m.end(), True
            low = m.end()


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.start(), m.end(), True


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), True


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.start(), m.end(), False


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """The account number has its country's length; words behind it may look like more of it."""
    for m in IBAN.finditer(text):
        left, end = IBAN_LENGTHS.get(m[0][:2], 0), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if end > m.start() and not left and not text[end : end + 1].isalnum() and mod_97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end, True


def _ssns(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), m.end(), False


def _local_phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in LOCAL_PHONE.finditer(text):
        yield m.start(), m.end(), False


@dataclass(frozen=True)
class Kind:
    """How spans of a kind are found, what a span is worth alone, and the words that change that."""

    find: object
    score: float
    sign: str
    words: frozenset[str]
    against: frozenset[str] = frozenset()


RULES = {
    "email": Kind(_emails, 0.8, "@", frozenset("email e mail contact correo courriel kontakt write".split()), frozenset("example".split())),
    "ip": Kind(_ips, 0.5, ".", frozenset("ip address host server client from login adresse".split()), frozenset("version release v build section chapter".split())),
    "card": Kind(_cards, 0.6, "", frozenset("card visa mastercard credit debit payment pay tarjeta carte karte".split()), frozenset("order tracking invoice isbn serial".split())),
    "phone": Kind(_phones, 0.6, "+", frozenset("phone tel telephone call mobile fax cell telefon téléphone teléfono".split())),
    "iban": Kind(_ibans, 0.9, "", frozenset("iban account bank konto cuenta compte".split())),
    "ssn": Kind(_ssns, 0.3, "-", frozenset("ssn social security".split()), frozenset("part order model".split())),
    "local_phone": Kind(_local_phones, 0.3, "", frozenset("phone tel telephone call mobile fax cell telefon téléphone teléfono".split()), frozenset("order part isbn".split())),
}


def _score(kind: Kind, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start])} | {w.lower() for w in WORD.findall(text[end : end + BEHIND])}
    return round(min(1.0, max(0.0, kind.score + STEP * bool(near & kind.words) - STEP * bool(near & kind.against))), 2)


def find(text: str, kinds: tuple[str, ...] = KINDS, least: float = LEAST_SCORE) -> list[dict]:
    """The spans of one text."""
    spans, taken = [], []
    for name in KINDS:
        rule = RULES[name]
        if name not in kinds or rule.sign not in text:
            continue
        base = name in BASE
        for start, end, checked in rule.find(text):
            score = _score(rule, text, start, end)
            if base or score >= least:
                spans.append({"kind": name, "start": start, "end": end, "score": score, "checksum": checked, "base": base})
                if base:
                    taken.append((start, end))
    if len(taken) < len(spans):
        spans = [s for s, free in zip(spans, _free(spans, taken), strict=True) if s["base"] or free]
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def _free(spans: list[dict], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps none of ``taken``: by the furthest end among those that start before its end."""
    taken = sorted(taken)
    ends = list(accumulate((end for _, end in taken), max))
    at = [bisect_left(taken, (s["end"],)) for s in spans]
    return [k == 0 or ends[k - 1] <= s["start"] for k, s in zip(at, spans, strict=True)]


SPAN = "struct<kind:string,start:int,end:int,score:double,checksum:boolean,base:boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("checksum", pa.bool_()), ("base", pa.bool_())]))


def personal_spans(text: str | Column = "text", kinds: tuple[str, ...] = KINDS, least: float = LEAST_SCORE) -> Column:
    """The spans of a text as an array of ``SPAN``; never null."""

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            # a slice at a time, so that few whole texts are Python strings at once
            parts = [pa.array([find(t, kinds, least) if t else [] for t in column.slice(k, SLICE).to_pylist()], _ARROW) for k in range(0, len(column), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return spans(F.col(text) if isinstance(text, str) else text)


def mask(text: str, spans: list[dict]) -> str:
    """``text`` with its spans replaced by their kinds in angle brackets; a span that begins inside another adds nothing of its own."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += text[at : s["start"]], f"<{s['kind']}>"
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with ``text`` masked; all rows and columns stay, and null stays null."""

    @F.arrow_udf("string")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [pa.array([mask(t, find(t, kinds, least)) if t else t for t in column.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(column), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), personal_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(F.filter("found.kind", lambda kind: kind == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


QUERIES = {"op11_personal_data": op11_personal_data}
