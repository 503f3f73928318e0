"""Keyed tokens, check digits, names of secrets, and redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key of queries and tests, so that their SQL can compute the same tokens. Never for production.
TEST_KEY = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


def key_bytes(key_hex: str) -> bytes:
    """The key has no default: 64 hex digits or an error."""
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", key_hex or ""):
        raise ValueError("the token key must be 64 hex digits")
    return bytes.fromhex(key_hex)


def pads(key_hex: str) -> tuple[str, str]:
    key = key_bytes(key_hex).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(text: Column, key_hex: str) -> Column:
    """HMAC-SHA256 of a text, from SHA-256 alone."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key_hex))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def token(kind: str, text: Column, key_hex: str) -> Column:
    """``PII_<kind>_`` and the first 128 bits; null stays null."""
    return F.concat(F.lit(f"PII_{kind}_"), F.substring(hmac_hex(text, key_hex), 1, 32))


def fingerprint(text: Column, key_hex: str) -> Column:
    return F.substring(hmac_hex(text, key_hex), 1, 16)


def luhn(digits: Column) -> Column:
    """At least 13 digits with a valid Luhn check digit."""
    return F.coalesce((F.length(digits) >= 13) & F.call_function("luhn_check", digits), F.lit(False))


def _dihedral() -> tuple[list[int], list[int]]:
    """Products in the dihedral group of order 10 and the powers of the permutation, by their definitions, as flat lists."""
    def mul(a: int, b: int) -> int:
        return ((a + b) % 5 if b < 5 else 5 + (a + b) % 5) if a < 5 else (5 + (a - b) % 5 if b < 5 else (a - b) % 5)

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return [mul(a, b) for a in range(10) for b in range(10)], [x for r in rows for x in r]


MUL, PERM = _dihedral()


def verhoeff_valid(text: str) -> bool:
    """Whether the digits of a text end with a valid Verhoeff check digit."""
    c = 0
    for k, d in enumerate(reversed([int(x) for x in text if x.isdigit()])):
        c = MUL[c * 10 + PERM[k % 8 * 10 + d]]
    return c == 0


def verhoeff(digits: Column) -> Column:
    """Valid Verhoeff check digit, by an array fold over the digits from the right."""
    mul, perm = (F.array(*(F.lit(x) for x in t)) for t in (MUL, PERM))
    at = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    at = F.filter(at, lambda d: d.isNotNull())
    end = F.aggregate(F.arrays_zip(at.alias("d"), F.sequence(F.lit(0), F.size(at) - 1).alias("i")), F.lit(0), lambda c, x: F.get(mul, c * 10 + F.get(perm, F.pmod(x["i"], F.lit(8)) * 10 + x["d"])))
    return F.coalesce(digits.rlike(r"^\d+$") & (end == 0), F.lit(False))


# Names that denote secrets, after lower case and without - _ . [ ].
SECRET_PARTS = ("authorization", "cookie", "password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "credential", "session", "signature", "csrf", "xsrf")
SECRET_EXACT = ("pwd", "pin", "otp", "cvv", "cvc", "sid", "ssn", "key", "auth")
STRONG_PARTS = ("password", "passwd", "passphrase", "secret", "privatekey", "credential")
STRONG_EXACT = ("pwd", "pin", "otp", "cvv", "cvc", "ssn")


def plain_name(name: Column) -> Column:
    return F.lower(F.translate(name, "-_.[]", ""))


def secret_name(name: Column, parts: tuple[str, ...] = SECRET_PARTS, exact: tuple[str, ...] = SECRET_EXACT) -> Column:
    n = plain_name(name)
    out = n.isin(*exact)
    for p in parts:
        out = out | n.contains(p)
    return F.coalesce(out, F.lit(False))


# Shapes of personal data and credentials, in the order they are replaced.
SHAPES = (
    ("JWT", r"eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}"),
    ("GHPAT", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    ("SLACK", r"\bxox[baprs]-[A-Za-z0-9-]{10,200}\b"),
    ("STRIPE", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,99}\b"),
    ("GCPTOKEN", r"ya29\.[A-Za-z0-9_-]{20,}"),
    ("AWSKEY", r"AKIA[0-9A-Z]{16}"),
    ("TOKEN", r"(?i)Bearer\s+([A-Za-z0-9\-._~+/]+=*)"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("CARD", r"\b(?:4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}|6011[0-9]{12})\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PRIVATE_KEY", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|\z)"),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s][2-9]\d{2}[-.\s]\d{4}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b"),
)
#: Characters around tokens made in the same call, so that no later shape touches them.
OPEN, CLOSE = "\ue000", "\ue001"


def matches(text: Column, kind: str) -> Column:
    """All matches of one shape, check digits included."""
    found = F.regexp_extract_all(text, F.lit(dict(SHAPES)[kind]), 0)
    if kind == "CARD":
        return F.filter(found, luhn)
    if kind == "AADHAAR":
        return F.filter(found, lambda m: verhoeff(F.translate(m, " -\t\n", "")))
    return found


def redact_shapes(text: Column, key_hex: str, kinds: tuple[str, ...]) -> Column:
    """Matches of one or two shapes replaced by tokens in the JVM, pieces and matches interleaved.

    Each shape multiplies the expression by five; ``redact`` does all of them.
    """
    if len(kinds) > 2:
        raise ValueError("use redact.redact_text for more than two shapes")
    out = F.translate(text, OPEN + CLOSE, "")
    for kind, shape in SHAPES:
        if kind in kinds:
            out = _replace(out, kind, shape, key_hex)
    return F.translate(out, OPEN + CLOSE, "")


def _replace(text: Column, kind: str, shape: str, key_hex: str) -> Column:
    either = f"{OPEN}[^{CLOSE}]*{CLOSE}|{shape}"
    pieces, found = F.split(text, either, -1), F.regexp_extract_all(text, F.lit(f"(?:{either})"), 0)
    made = lambda m: F.lit("PII_PRIVATE_KEY_REDACTED") if kind == "PRIVATE_KEY" else token(kind, m, key_hex)
    ok = lambda m: luhn(m) if kind == "CARD" else verhoeff(F.translate(m, " -\t\n", "")) if kind == "AADHAAR" else F.lit(True)
    new = F.transform(found, lambda m: F.when(m.startswith(OPEN) | ~ok(m), m).otherwise(F.concat(F.lit(OPEN), made(m), F.lit(CLOSE))))
    return F.when(text.rlike(shape), F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def redact_cookie(value: Column, key_hex: str, names: bool = True) -> Column:
    """Cookie values replaced by tokens, names kept."""
    def one(p: Column) -> Column:
        value_ = F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
        return F.when((F.instr(p, "=") > 0) & (value_ != "") & (F.lit(names) | secret_name(F.substring_index(p, "=", 1))), F.concat(F.substring_index(p, "=", 1), F.lit("="), token("SECRET", value_, key_hex))).otherwise(p)

    return F.array_join(F.transform(F.split(value, ";", -1), one), ";")
