"""Personal data by patterns, checksums and context words.

Patterns propose spans, validators confirm them (Luhn for payment cards, mod-97 and the country's length for bank
accounts, ranges for addresses and social security numbers), and words near a span move its score.

The base kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their check; they stay whatever
their score. The added kinds need LEAST: an iban has a strong checksum and no need of context; a national phone number, a
social security number and a card of 13 digits are numbers like others and count only near a word that says what they are.
An added span that overlaps a base span or an earlier added one goes.

All patterns are linear in the text: runs of digits start a match only at their first digit, and an email is looked for
from its @ to the left. Positions are code points, the end exclusive. Work is by row; nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows get equal rows; an empty table gives an empty result;
columns of docs are kept, one named spans (or as `to` says) is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import read

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "national-phone", "short-card")
KINDS = BASE + ADDED
#: What a checked match is worth by itself, what a word near it adds, and what an added span must reach.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "national-phone": 0.4, "short-card": 0.4}
NEARBY, AGAINST, LEAST = 0.3, -0.3, 0.6
#: Code points before and after a span in which its words are looked for.
REACH_BEFORE, REACH_AFTER = 40, 20
#: Words that speak for a kind, and words that speak against any number being personal.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "address", "client", "login", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono", "móvil", "portable"),
    "iban": ("iban", "account", "bank", "bic", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
}
CONTEXT |= {"national-phone": CONTEXT["phone"], "short-card": CONTEXT["card"]}
DENIALS = ("version", "isbn", "issn", "order", "invoice", "build", "release", "serial", "part")
#: Fixed lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            after = found.end()
            yield start, after
        at = text.find("@", max(after, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) < 4 and int(p) < 256 for p in parts):
            yield m.span()


def _cards(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 2 * most:
            digits = m[0].replace(" ", "").replace("-", "")
            if least <= len(digits) <= most and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        length, taken, end = IBAN_LENGTHS.get(m[0][:2], 0), 0, m.start()
        while taken < length and end < m.end():  # the run may go on with other capitals
            taken += text[end] != " "
            end += 1
        whole = taken == length > 0 and (end == len(text) or not (text[end].isalnum() and text[end].isascii()))
        if whole and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


def _security_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH_BEFORE) : start] + " " + text[end : end + REACH_AFTER]
    words = set(_WORD.findall(near.lower()))
    words |= {part for w in words for part in w.split("-")}
    moved = WORTH[kind] + NEARBY * (not words.isdisjoint(CONTEXT[kind])) + AGAINST * (not words.isdisjoint(DENIALS))
    return round(min(1.0, max(0.0, moved)), 2)


def _disjoint(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover together."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """The spans of one text, by start, then kind."""
    if not text:
        return []
    digits = _DIGITS.search(text) is not None
    base = [("email", *s) for s in _emails(text)]
    if digits:
        base += [("ip", *s) for s in _addresses(text)] + [("card", *s) for s in _cards(text, 14, 19)]
        if "+" in text:
            base += [("phone", *s) for s in _phones(text)]
    out = [(k, a, b, _score(text, k, a, b)) for k, a, b in base]
    if digits:
        more = [("iban", *s) for s in _accounts(text)] + [("ssn", *s) for s in _security_numbers(text)]
        more += [("national-phone", *m.span()) for m in _NATIONAL.finditer(text)] + [("short-card", *s) for s in _cards(text, 13, 13)]
        starts, ends = _disjoint(base)
        for k, a, b in more:
            score, at = _score(text, k, a, b), bisect_right(starts, a)
            if score >= LEAST and (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((k, a, b, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """docs with the spans (kind, start, end, score) of their texts, by start, then kind."""
    names = ("kind", "start", "end", "score")

    @pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(names, s)) for s in spans_of(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    return docs.withColumn(to, spans(F.col(text)))


def masked(docs: DataFrame, text: str = "text", spans: str = "spans", to: str = "masked") -> DataFrame:
    """docs with their text where each span is its kind in brackets; of overlapping spans the first hides its part, later ones what is left of theirs."""
    s = F.col(spans)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        mark = F.when(x["end"] > acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, start - acc["at"]), mark).alias("out"))

    return docs.withColumn(to, F.aggregate(s, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_number_of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(_joined(base), "utf-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
