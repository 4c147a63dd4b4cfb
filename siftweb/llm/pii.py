"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import drop_own, text_of

#: code points on either side in which context words count, and the score from which a further span is kept
CONTEXT = 48
ACCEPT = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Remainder test of bank account numbers: four leading characters go last, letters count from 10."""
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _small_parts(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


@dataclass(frozen=True)
class Kind:
    """``base``: spans are kept whatever their score."""

    name: str
    pattern: re.Pattern
    holds: Callable[[str], bool]
    score: float
    words: tuple[str, ...]
    base: bool = True


_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")

# The patterns of the base kinds. A match starts at the head of a digit run or right after the last match,
# which is what leftmost matching gives; the possessive forms keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

KINDS = (
    Kind("email", _DOMAIN, lambda s: True, 0.9, ("mail", "contact", "write")),
    Kind("ip", _IP, _small_parts, 0.6, ("ip", "address", "host", "server", "log")),
    Kind("card", _CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d), 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", _PHONE, lambda s: 9 <= len(_digits(s)) <= 15, 0.7, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", _IBAN, lambda s: mod97(s.replace(" ", "")), 0.8, ("iban", "account", "bank", "konto"), base=False),
    Kind("social", _SOCIAL, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", 0.4,
         ("ssn", "social", "security"), base=False),
)


def _emails(text: str):
    """Leftmost matches of local part, at sign and dotted domain, found from the at signs in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)


def _ibans(text: str):
    """Account numbers that pass mod-97: of the ends at blanks and the pattern's own, the longest that passes.

    The search goes on behind the end, or behind the first letter where no end passes.
    """
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        while len(code := text[start:end].replace(" ", "")) >= 15 and not mod97(code):
            end = max(start, text.rfind(" ", start, end))
        if len(code) >= 15:
            yield start, end
        at = end if len(code) >= 15 else start + 1


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all accepted spans, by kind, then start; positions count code points."""
    spans: list[tuple[str, int, int, float]] = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if kind.name == "email":
            found = _emails(text) if "@" in text else ()
        elif not digits or kind.name == "phone" and "+" not in text:
            found = ()
        elif kind.name == "iban":
            found = _ibans(text)
        else:
            found = (m.span() for m in kind.pattern.finditer(text))
        for start, end in found:
            if kind.holds(text[start:end]):
                around = text[max(0, start - CONTEXT):start].lower() + " " + text[end:end + CONTEXT].lower()
                near = any(w in kind.words or w.rstrip(":.") in kind.words for w in re.findall(r"[a-z]+[:.]?", around))
                score = min(1.0, kind.score + 0.25 * near)
                if kind.base or score >= ACCEPT:
                    spans.append((kind.name, start, end, score))
    return spans


def _scan(batches):
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(rows, out)], ["_key", "spans"])


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end, score), for every row; a null text counts as empty.

    Empty texts give an empty array, repeated rows repeat, null identifiers stay null, an empty table gives
    an empty result. Other columns are ignored. Texts are scanned whole; every pattern takes linear time on long runs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), text_of().alias("_text"))
    return (rows.mapInArrow(_scan, "_key long, spans array<struct<kind:string,start:long,end:long,score:double>>")
            .withColumnRenamed("_key", "doc_id"))


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "redacted") -> DataFrame:
    """``docs`` with a further column holding the masked text (null stays null)."""
    masked = F.pandas_udf(lambda texts: texts.map(mask, na_action="ignore"), "string")
    return drop_own(docs, [column]).withColumn(column, masked(F.col("text").cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    base = [k.name for k in KINDS if k.base]

    def count(name):
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return digest(find_spans(read(spark, folder, "documents")))
