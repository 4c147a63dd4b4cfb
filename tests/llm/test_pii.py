"""Personal data against plain regular expressions."""

import hashlib
import random
import re

from siftweb.llm.pii import digest, find, find_spans, luhn, mask, mod97, redact

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if holds(k, m.group())]


def base(text):
    return [s[:3] for s in find(text) if s[0] in PLAIN]


def test_base_kinds_are_those_of_the_patterns():
    rng = random.Random(1)
    for alphabet, most in (("a1.@-+ é%0", 25), ("12.. 9", 25), ("40-1 +()", 40), ("0123456789 -", 60)):
        for _ in range(15_000):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, most)))
            assert base(text) == plain(text), text


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    kinds = lambda t: [s[0] for s in find(t)]
    assert kinds("iban DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("iban DE88 3704 0044 0532 0130 00") == []
    assert kinds("ssn: 123-45-6789") == ["social"] and kinds("part 123-45-6789") == []
    near, far = find("visa card 4111 1111 1111 1111")[0][3], find("4111 1111 1111 1111")[0][3]
    assert near > far


def test_account_numbers_before_capitals_and_digits():
    ibans = lambda t: [t[a:b] for k, a, b, _ in find(t) if k == "iban"]
    one, two, three = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert ibans(f"{one} BIC: X") == [one] and ibans(f"{two} 250 EUR") == [two] and ibans(f"{three} OK") == [three]
    assert ibans(f"{one} {three} {two} A") == [one, three, two]
    assert ibans(f"AB12 CDEF 1234 {two} 250") == [two] and ibans("DE88 3704 0044 0532 0130 00 250 EUR") == []
    find("AB12 " * 60_000)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1" * 150_000, "A1" * 150_000, "1-" * 150_000):
        find(text)
    assert base("9" * 5000 + ".1.1.1") == []


def test_tables(spark):
    texts = ["mail a.b@c.de or é +1 (988) 555-2485", None, "", "1.2.3.4 x 999.1.1.1", "z" * 100_000 + " 10.0.0.1"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "q@r.st", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(map(tuple, digest(find_spans(docs)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        own = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        want.append((i, *(sum(s[0] == k for s in own) for k in PLAIN), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in find(t or ""))))
    assert got == sorted(want, key=str)
    masked = {r["doc_id"]: r["redacted"] for r in redact(docs).collect()}
    assert masked[0] == "mail [email] or é [phone]" and masked[1] is None and masked[2] == ""
    assert mask("no data") == "no data"
    assert find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
