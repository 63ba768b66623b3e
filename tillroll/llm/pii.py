"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import map_slices

#: Order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_ENDS = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")

#: Length of an account by its country code.
ACCOUNT = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
        "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 "
        "YE30"
    ).split()
}

#: Words near a span that speak for its kind, and how far to look in code points.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
REACH = 40
_CONTEXT = {kind: re.compile("|".join(rf"\b{w}" for w in words), re.IGNORECASE) for kind, words in CONTEXT.items()}
#: Score of a span by pattern alone, what a checksum adds, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.3}
CONFIRMED, NEARBY = 0.4, 0.15


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of international bank account numbers."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The local part excludes "@", so walking back from each "@" is linear and finds the leftmost start.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts, start = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):  # each run of digits is taken whole, so matches are four parts each
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        start, most = m.span(1)
        if start < done:
            continue
        length = ACCOUNT.get(text[start : start + 2])
        ends = [e.end() for e in _ENDS.finditer(text, start, most) if not text[e.end() : e.end() + 1].isalnum() or not text[e.end()].isascii()]
        for end in reversed(ends):  # without a known length, the longest first
            account = text[start:end].replace(" ", "")
            if (len(account) == length if length else 15 <= len(account) <= 34) and mod97(account):
                done = end
                yield start, end
                break


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}
_CHECKED = {"card", "iban"}


def personal_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in order of kind and start; code points, end exclusive."""
    out = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            near = _CONTEXT[kind].search(text[max(0, start - REACH) : start]) or _CONTEXT[kind].search(text[end : end + REACH])
            score = PRIOR[kind] + CONFIRMED * (kind in _CHECKED) + NEARBY * bool(near)
            out.append((kind, start, end, round(min(1.0, score), 2)))
    return out


def find_personal_data(docs: DataFrame, floor: float = 0.0) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score) of every whole text, those of at least this score.

    A row for each row of docs, repeated ones and null ids included; null and empty texts have no spans. Other columns
    are ignored. Runs in one pass without a shuffle; each text is scanned in time linear in its length.
    """

    def scan(part: pa.RecordBatch) -> dict:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in personal_spans(t or "") if s[3] >= floor] for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "spans": found}

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(spans: list[dict], kinds: tuple[str, ...]) -> str:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def personal_data_report(docs: DataFrame) -> DataFrame:
    """The counts of base kinds, the digest of base spans, all spans as one string and their scores, from find_personal_data()."""
    spans = F.col("spans")
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:4]))
    return find_personal_data(docs).select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), spans["score"].alias("scores"))
