"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always reported once they pass their checks. Added
kinds (secret, iban, national_id, local_phone) are reported when their score, raised by context words nearby, reaches a
threshold. Secrets are values given to names like token or password, tokens of well-known forms and private keys; a value
has to look drawn at random. National ids with check digits (Spain, France, Brazil, Italy) need no context, those without
(United States, United Kingdom) do. Patterns never look back over what they have rejected, so a text takes time in
proportion to its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "national_id", "local_phone")
KINDS = BASE + ADDED
#: Least score of an added span.
THRESHOLD = 0.6
#: Bytes on either side of a span in which context words count.
CONTEXT = 48

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NINO = re.compile(rb"(?<![A-Za-z0-9])[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![A-Za-z0-9])")
_DNI = re.compile(rb"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])")
_NIR = re.compile(rb"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])")
_CPF = re.compile(rb"(?<![A-Za-z0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![A-Za-z0-9])")
_FISCAL = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z](?![A-Za-z0-9])")
#: A name of secrets, and the value that it is given.
_NAMED = re.compile(rb"""(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|secret|(?:access|auth)[_-]?token|token|password|passwd|pwd|bearer)["']?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}["']?([A-Za-z0-9+/_.~!@#$%^&*-]{8,512})""")
#: Secrets that show their form.
_FORMED = re.compile(
    rb"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,64}|eyJ[A-Za-z0-9_-]{8,2048}\.eyJ[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{8,2048})(?![A-Za-z0-9_])"
    rb"|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,8192}(?:-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
)
_LOCAL_PHONE = re.compile(rb"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: Characters of an IBAN by country.
_IBAN_LENGTH = {c: int(n) for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 33:RU 32:LC"
).split() for n, _, names in [x.partition(":")] for c in names.encode().split(b",")}
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)

#: Words that raise the score of a kind when they stand nearby.
_WORDS = {
    "email": re.compile(rb"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(rb"(?i)\b(?:ip|host|server|address)\b"),
    "card": re.compile(rb"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b"),
    "phone": re.compile(rb"(?i)\b(?:phone|tel|call|mobile|fax|cell)\b"),
    "secret": re.compile(rb"(?i)(?:key|secret|token|password|passwd|pwd|bearer)"),
    "iban": re.compile(rb"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "national_id": re.compile(rb"(?i)\b(?:ssn|social security|national (?:id|insurance)|tax id|dni|nie|nif|cpf|codice fiscale|securite sociale)\b"),
    "local_phone": re.compile(rb"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b"),
}
#: Scores without and with a context word.
_SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.95), "card": (0.8, 1.0), "phone": (0.7, 0.95), "secret": (0.8, 0.95), "iban": (0.8, 1.0), "national_id": (0.3, 0.8), "local_phone": (0.3, 0.7)}


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def mod97(iban: bytes) -> bool:
    """The check of an IBAN: moved front to back, letters as 10 to 35, the remainder by 97 is 1."""
    value = 0
    for c in iban[4:] + iban[:4]:
        value = (value * 10 + c - 48 if c < 58 else value * 100 + c - 55) % 97
    return value == 1


def ibans(t: bytes) -> list[tuple[int, int]]:
    """Leftmost spans that pass the check of an IBAN, with capitals or numbers after them left out.

    A proposal runs on over such words, so it ends at its country's length or its own end, in countries without a known length
    at its last word border that passes. If none does, the next word is tried. A proposal has 64 bytes at most, so time stays in proportion to length.
    """
    found = []
    m = _IBAN.search(t)
    while m:
        s, e = m.span()
        ends = [k for k in range(e, s + 14, -1) if t[k - 1] != 32 and (k == e or t[k] == 32)]
        size = _IBAN_LENGTH.get(t[s : s + 2])
        if size:
            ends = [k for k in ends if len(t[s:k].replace(b" ", b"")) == size] + [e]
        end = next((k for k in ends if len(x := t[s:k].replace(b" ", b"")) >= 15 and mod97(x)), None)
        if end:
            found.append((s, end))
        m = _IBAN.search(t, end or s + 1)
    return found


def dni(x: bytes) -> bool:
    """The letter of a Spanish id: the number's remainder by 23; X, Y, Z stand for 0, 1, 2."""
    x = x.replace(b"-", b"")
    return b"TRWAGMYFPDXBNJZSQVHLCKE"[int(x[:-1].translate(bytes.maketrans(b"XYZ", b"012"))) % 23] == x[-1]


def nir(x: bytes) -> bool:
    """The key of a French number: 97 less the rest by 97; 2A and 2B count as 19 and 18."""
    x = x.replace(b" ", b"")
    return int(x[-2:]) == 97 - int(x[:-2].replace(b"2A", b"19").replace(b"2B", b"18")) % 97


def cpf(x: bytes) -> bool:
    """Two check digits by 11 of a Brazilian number; all digits alike don't count."""
    d = [c - 48 for c in x.translate(None, b".-")]
    return len(set(d)) > 1 and all(sum(v * (n + 1 - k) for k, v in enumerate(d[:n])) * 10 % 11 % 10 == d[n] for n in (9, 10))


#: What a character counts at the odd places of an Italian code: 0 to 9, and A to Z, whose first ten count alike.
_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def fiscal(x: bytes) -> bool:
    """The last letter of an Italian code: the sum of what its places count, by 26."""
    v = [c - 48 if c < 58 else c - 65 for c in x]
    return (sum(_ODD[c] for c in v[:15:2]) + sum(v[1:15:2])) % 26 == v[15]


#: National ids: pattern, check, and whether it needs a context word.
_NATIONAL_IDS = [
    (_NATIONAL, lambda x: x[:3] not in (b"000", b"666") and x[:1] != b"9" and x[4:6] != b"00" and x[7:] != b"0000", True), (_NINO, lambda x: x[:2] not in (b"BG", b"GB", b"KN", b"NK", b"NT", b"TN", b"ZZ"), True),
    (_DNI, dni, False), (_NIR, nir, False), (_CPF, cpf, False), (_FISCAL, fiscal, False),
]


def random_like(v: bytes) -> bool:
    """Whether a value may be a secret: letters with digits or marks, and 2.5 bits a character or more."""
    n = len(v)
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in v)
    if not letters or letters == n:
        return False
    return -sum(k / n * math.log2(k / n) for k in Counter(v).values()) >= 2.5


class _Taken:
    """Disjoint stretches of a text."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def take(self, s: int, e: int) -> bool:
        """Whether the stretch is free; then it is taken."""
        k = bisect_right(self.starts, s)
        if k and self.ends[k - 1] > s or k < len(self.starts) and self.starts[k] < e:
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


def secrets(t: bytes) -> list[tuple[int, int]]:
    """Spans of secrets: those that show their form, and values of names of secrets that look random, without a full stop
    at their end."""
    found = [m.span() for m in _FORMED.finditer(t)] if any(x in t for x in (b"AKIA", b"gh", b"xox", b"AIza", b"sk_", b"eyJ", b"-----BEGIN")) else []
    if b"=" in t or b":" in t:
        taken = _Taken(found)
        for m in _NAMED.finditer(t):
            v, s = m[1].rstrip(b".!"), m.start(1)
            if len(v) >= 8 and random_like(v) and taken.take(s, s + len(v)):
                found.append((s, s + len(v)))
    return sorted(found)


def emails(t: bytes) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+.

    The part before an @ is the run of its characters up to there, from the last match on; all its starts share that
    @ and what follows, so each @ is looked at once.
    """
    found, last, at = [], 0, t.find(b"@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        start = at
        if m:
            while start > last and t[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            found.append((start, m.end()))
            last = m.end()
        at = t.find(b"@", max(at + 1, last))
    return found


def base_spans(t: bytes) -> list[tuple[str, int, int]]:
    """Base matches as (kind, first byte, end byte)."""
    found = [("email", s, e) for s, e in emails(t)] if b"@" in t else []
    if len(t.translate(None, _NOT_DIGIT)) < 4:
        return found
    for m in _IP.finditer(t):
        if all(len(x := p.lstrip(b"0")) < 3 or len(x) == 3 and int(x) <= 255 for p in m[0].split(b".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        if 12 <= m.end() - m.start() and 12 <= len(digits := m[0].translate(None, b" -")) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if b"+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                found.append(("phone", *m.span()))
    return found


def added_spans(t: bytes, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Confirmed proposals of the added kinds that overlap no base span or earlier one, and whether each needs a context word."""
    taken = _Taken((s, e) for _, s, e in base)
    found = [("secret", s, e, False) for s, e in secrets(t) if taken.take(s, e)]
    if len(t.translate(None, _NOT_DIGIT)) < 6:
        return found
    found += [("iban", s, e, False) for s, e in ibans(t) if taken.take(s, e)]
    for pattern, check, context in _NATIONAL_IDS:
        found += [("national_id", *m.span(), context) for m in pattern.finditer(t) if check(m[0]) and taken.take(*m.span())]
    return found + [("local_phone", *m.span(), True) for m in _LOCAL_PHONE.finditer(t) if taken.take(*m.span())]


def spans(t: bytes, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by start and then kind, in code points; base kinds whatever their score."""
    base = base_spans(t)
    out = []
    for kind, s, e, context in [*((*x, False) for x in base), *added_spans(t, base)]:
        near = _WORDS[kind].search(t, max(0, s - CONTEXT), s) or _WORDS[kind].search(t, e, e + CONTEXT)
        score = _SCORES[kind][bool(near)] if context or kind != "national_id" else (0.7, 0.95)[bool(near)]
        if kind in BASE or score >= threshold:
            out.append((kind, s, e, score))
    if out and not t.isascii():
        points = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)
        out = [(k, int(points[s]) - 1, int(points[e - 1]), x) for k, s, e, x in out]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of personal data in every row of docs: doc_id, spans array<struct<kind, start, end, score>>.

    Offsets count code points, end exclusive. Null text is empty and has no spans. Rows are independent: repeated rows
    and null ids give one result each; an empty table gives none. Extra columns aren't read. Bytes that aren't UTF-8 in
    a text are never part of a span.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans(v.as_py(), threshold)] for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select("doc_id", text_bytes().alias("_x")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of the given kinds as kind:start:end, comma-joined."""
    some = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = F.aggregate(
        spans, start,
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return end
