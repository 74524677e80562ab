"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits,
schemes and identifier cues ("token", "iban", ...). From each anchor a small parser expands to
the boundaries of an email address, IP address, card number, phone number or account value and
validates it. What is found for the first four kinds equals the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([ -]?[0-9])+, 13 to 19 digits that pass Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9], 9 to 15 digits

without those that fail their check. "account" adds values after a cue and user:password in a web
address, up to the last "@" of its authority. A cue counts in any case, in a compound (secret_key,
authToken) and with a word like "number" after it; its value runs to a blank, a quote or the end of the line, less
closing marks, and must have 8 characters, with a digit or of three kinds, or be a valid IBAN.
Offsets are code points, end exclusive.
Null text is empty and has no spans. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, ship, table, utf8

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account")
#: Words that announce a secret or account number; followed by ":" or "=" and the value.
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "account", "acct", "ssn", "passport", "iban")
SCHEMES = ("http://", "https://", "ftp://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NAME, WEB = re.compile(r"[_-][A-Za-z0-9_-]*"), re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://")
ASSIGNED = re.compile(r"(?:[ \t]+(?:number|num|no|nr|id|key|code|value|phrase)\b\.?)?[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*([\"']?)", re.I)
VALUES = {q: re.compile(p) for q, p in (("", r"[^\s\"'<>]+"), ("'", r"[^\s']+"), ('"', r'[^\s"]+'))}
CLOSING, LEAST_VALUE = ".,;:!?)]}>\"'", 8
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"[ \t]*(?:(?:number|no|nr)\b\.?[ \t]*)?(?:[:=][ \t]*)?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])", re.I)
LOGIN = re.compile(r"[^\s/?#:@]+:[^\s/?#]+(?=@)")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    """Of anchors in lower case."""
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for cue in CUES:
        found.add_word(cue, ("iban" if cue == "iban" else "cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str, ats: list[int]) -> list[Span]:
    found, free = [], 0
    for at in ats:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
    return found


def _runs(digits: list[int]) -> list[tuple[int, int]]:
    runs, start, before = [], -1, -2
    for p in digits:
        if p != before + 1:
            if start >= 0:
                runs.append((start, before + 1))
            start = p
        before = p
    return [*runs, (start, before + 1)] if digits else []


def _ips(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    found, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                found.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return found


def _cards(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    found, i = [], 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            found.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return found


def _phones(text: str, pluses: list[int]) -> list[Span]:
    found = []
    for p in pluses:
        if (m := PHONE.match(text, p)) and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", p, m.end()))
    return found


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest valid IBAN that starts after the cue; capitals that follow a blank may not be its own."""
    value = m[1] if (m := IBAN.match(text, at)) else ""
    while value and not _iban_ok(value):
        value = value.rpartition(" ")[0]
    return (m.start(1), m.start(1) + len(value)) if value else None


def _value(text: str, at: int) -> tuple[int, int, bool] | None:
    """What is assigned after a name that ends at at, and whether it looks like a secret or a number."""
    if not (m := ASSIGNED.match(text, at)) or WEB.match(text, m.end()) or not (v := VALUES[m[1]].match(text, m.end())):
        return None
    value = v[0].rstrip(CLOSING)
    kinds = (any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value), any(not c.isalnum() for c in value))
    return v.start(), v.start() + len(value), len(value) >= LEAST_VALUE and (kinds[0] or sum(kinds) >= 3) and not EMAIL.fullmatch(value)


def _accounts(text: str, cues: list[tuple[str, int, int]]) -> list[Span]:
    found, free = [], 0
    name, tried, dull = 0, -1, 0  # ends of the last compound, of the last name tried, and of values that aren't secrets
    for kind, start, end in cues:
        inside = start and text[start - 1].isalnum() and not (text[start].isupper() and text[start - 1].islower())
        if end < free or (kind != "scheme" and inside):
            continue
        span = None
        if kind == "scheme":
            span = (m.start(), m.end()) if (m := LOGIN.match(text, end)) else None
        elif kind == "iban":
            span = _iban(text, end)
        else:
            if text[end : end + 1] in ("_", "-"):
                name = max(name, NAME.match(text, end).end()) if end >= name else name
                end = name
            # names of one compound end alike, and no end of a dull value is a secret
            if end != tried and end >= dull:
                tried = end
                if value := _value(text, end):
                    span = value[:2] if value[2] else None
                    if not value[2] and text[value[1] : value[1] + 1] not in ("'", '"', "<", ">"):
                        dull = max(dull, value[1])
        if span and span[0] >= free:
            found.append(("account", *span))
            free = span[1]
    return found


def find(text: str, machine: ahocorasick.Automaton) -> list[Span]:
    """Spans (kind, start, end) by kind as listed in KINDS, then by start."""
    digits: list[int] = []
    ats: list[int] = []
    pluses: list[int] = []
    cues: list[tuple[str, int, int]] = []
    lower = text.lower()
    if len(lower) != len(text):  # a letter that is two in lower case
        lower = text.translate(_ASCII_LOWER)
    for last, (what, n) in machine.iter(lower):
        if what == "digit":
            digits.append(last)
        elif what == "at":
            ats.append(last)
        elif what == "plus":
            pluses.append(last)
        else:
            cues.append((what, last + 1 - n, last + 1))
    if not (digits or ats or cues):
        return []
    runs = _runs(digits)
    return [*_emails(text, ats), *_ips(text, runs), *_cards(text, runs), *_phones(text, pluses), *_accounts(text, sorted(cues, key=lambda c: c[1]))]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, and spans as array of (kind, start, end)."""
    return _marked(docs, "spans array<struct<kind:string,start:int,end:int>>", lambda found, _: {"spans": [{"kind": k, "start": a, "end": b} for k, a, b in found]})


def _marked(docs: DataFrame, extra: str, more) -> DataFrame:
    names = [x.split(" ")[0] for x in extra.split(", ")]

    def make():
        machine = automaton()

        def work(block):
            out: dict[str, list] = {k: [] for k in ("doc_id", *(f"n_{k}" for k in BASE_KINDS), *names)}
            out["doc_id"] = block["doc_id"]
            for raw in block["text"]:
                text = raw.decode("utf-8", "replace")
                found = find(text, machine)
                for kind in BASE_KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in found))
                for k, v in more(found, text).items():
                    out[k].append(v)
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    return per_block(rows, "text", make, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + f", {extra}")


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans
    the first one's kind stands for all."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text (null stays null) and n_chars, where
    there is one, counted anew. One narrow pass; all other columns as they are."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        machine = automaton()
        return texts.map(lambda t: None if t is None else redact(t, find(t, machine)))

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    more = lambda found, _: {
        "base_sha256": hashlib.sha256(line([s for s in found if s[0] in BASE_KINDS]).encode()).hexdigest(),
        "spans": line(found),
    }
    return _marked(table(spark, sf_dir, "documents"), "base_sha256 string, spans string", more)
