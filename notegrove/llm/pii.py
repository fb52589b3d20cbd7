"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import small_batches

#: Kinds of the base in their order; the method's own kinds follow.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret", "token", "jwt", "private_key")
ORDER = {kind: k for k, kind in enumerate(BASE + ADDED)}
#: A proposed span of an added kind stays from this score on.
LEAST_SCORE = 0.5
#: Characters to either side in which words count as nearby.
NEARBY = 40

# What the score of a kind starts from, what a passed checksum and a nearby word add.
# token: secrets whose maker's mark is in front; jwt: three parts, the first a JSON header; private_key: the PEM frame.
SCORES = {"iban": (0.1, 0.6, 0.2), "ssn": (0.2, 0.0, 0.4), "secret": (0.1, 0.3, 0.2), "token": (0.3, 0.3, 0.1), "jwt": (0.3, 0.4, 0.1), "private_key": (0.6, 0.0, 0.0)}
NEARBY_WORDS = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "credential", "bearer"),
    "token": ("token", "secret", "key", "bearer"),
    "jwt": ("token", "bearer", "authorization", "jwt"),
    "private_key": (),
}
MARKS = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxr-",
    "npm_", "hf_", "pypi-", "AIza", "AKIA", "ASIA", "SG.", "dop_v1_", "shpat_", "sk-ant-", "sk-proj-",
)

# Each pattern starts where a run of its first class starts: within a run every start fails alike, and trying each
# would cost the square of the run's length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[0-9a-fA-F]{32,128}|[A-Za-z0-9+/_-]{24,200}={0,2})(?![A-Za-z0-9+/_=-])")
_MARKED = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, MARKS))})[A-Za-z0-9_.-]{{16,255}}(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,2000}\.[A-Za-z0-9_-]{2,4000}\.[A-Za-z0-9_-]{10,1000}(?![A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----(?:[^-]{0,20000}+-----END (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----)?")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [*map(int, reversed(digits))]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """As the one pattern would find them: the local part is the run before an @, from the last match on."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            free = m.end()
            yield "email", start, free


def _part(digits: str) -> bool:
    return len(x := digits.lstrip("0")) <= 3 and int(x or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds by start and kind; code points, end exclusive."""
    found = [*emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return found
    found += (("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split("."))))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15)
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def _iban(match: str) -> bool:
    return 15 <= len(plain := match.replace(" ", "")) <= 34 and mod97(plain)


def _mixed_up(match: str) -> bool:
    """Whether a run of letters and digits looks drawn by lot: hexadecimal with many digits, or all kinds of characters."""
    body = match.rstrip("=")
    if _HEX.match(body):
        return len(body) in (32, 40, 48, 56, 64, 96, 128) and len({*body.lower()}) >= 10
    kinds = [any(map(str.isdigit, body)), any(map(str.isupper, body)), any(map(str.islower, body))]
    return all(kinds) and len({*body}) >= 14


def _header(match: str) -> bool:
    """Whether the first part of a token is a JSON object that names an algorithm."""
    part = match.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


PROPOSED: dict[str, tuple[re.Pattern, Callable[[str], bool]]] = {
    "iban": (_IBAN, _iban),
    "ssn": (_SSN, lambda match: False),
    "secret": (_SECRET, _mixed_up),
    "token": (_MARKED, lambda match: len({*match}) >= 12),
    "jwt": (_JWT, _header),
    "private_key": (_PEM, lambda match: False),
}


def added_spans(text: str) -> list[Span]:
    """Spans of the added kinds whose score reaches LEAST_SCORE; a secret within a span of a surer kind isn't named twice."""
    found: list[Span] = []
    for kind, (pattern, valid) in PROPOSED.items():
        start, passed, near = SCORES[kind]
        for m in pattern.finditer(text):
            score = start + passed * valid(m[0])
            around = (text[max(0, m.start() - NEARBY) : m.start()] + " " + text[m.end() : m.end() + NEARBY]).lower()
            score += near * any(word in around for word in NEARBY_WORDS[kind])
            if score >= LEAST_SCORE:
                found.append((kind, m.start(), m.end()))
    sure = [s for s in found if s[0] not in ("secret", "token")]
    sure += [s for s in found if s[0] == "token" and not any(a <= s[1] and s[2] <= b for _, a, b in sure)]
    return sure + [s for s in found if s[0] == "secret" and not any(a < s[2] and s[1] < b for _, a, b in sure)]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    more = added_spans(text) if _DIGIT.search(text) or "PRIVATE KEY" in text else []
    return base, sorted(base + more, key=lambda s: (s[1], ORDER[s[0]])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for kind, start, end in spans])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (of all kinds) of every whole text, of any length. A
    null or empty text has no span. Other columns of docs are ignored; repeated rows give repeated rows."""
    small_batches(docs.sparkSession)

    def run(batches):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, spans = all_spans(t) if t else ([], [])
                names = [s[0] for s in base]
                rows.append((*map(names.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, schema)
