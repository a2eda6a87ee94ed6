"""PII (operator 7): format-preserving Feistel pseudonyms for validated numbers, dates and credentials.

Equal values get equal pseudonyms under one key, in whatever documents they stand, so links
survive.  What is permuted is the value (a phone's digits, the day, the 128 bits of an
address), not its spelling, so that spellings of one value stay linked.  Each pseudonym keeps
the original's format: separators, letter case, padding and whatever makes the value valid
(check digits, octet ranges, calendar dates).  The length stays but where a format has none:
days and months without leading zeros and shortened IPv6 addresses are as long as their value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("email", "phone", "ip", "ipv6", "card", "iban", "national_id", "date", "secret")


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): balanced Feistel over the next even number of
    bits, walked along its cycle until it lands inside."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(right.to_bytes((half + 7) // 8, "big"), key=key, person=bytes([r]), salt=hashlib.sha256(f"{tweak}|{size}".encode()).digest()[:16], digest_size=min(64, (half + 7) // 8))
            left, right = right, left ^ (int.from_bytes(f.digest(), "big") & mask)
        x = left << half | right
        if x < size:
            return x


def digits_permuted(s: str, key: bytes, tweak: str) -> str:
    return str(permuted(int(s), 10 ** len(s), key, f"{tweak}{len(s)}")).zfill(len(s)) if s else s


def refill(shape: str, chars: str, of: str) -> str:
    """``shape`` with its characters that match ``of`` replaced in turn by ``chars``."""
    it = iter(chars)
    return re.sub(of, lambda _: next(it), shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def card(s: str, key: bytes) -> str | None:
    """13 to 19 digits that pass the Luhn test: first digit and validity stay."""
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + digits_permuted(d[1:-1], key, "card")
    return refill(s, body + luhn_digit(body), r"\d")


def phone(s: str, key: bytes) -> str | None:
    """10 to 15 digits written as a phone number; what stands before the last ten stays.

    Bare digits are one only if area and exchange may begin so; the pseudonym of a number that
    may be written bare may be too, in whatever layout it stands."""
    d = re.sub(r"\D", "", s)
    if not 10 <= len(d) <= 15:
        return None
    if s == d and not NUMBERED.fullmatch(d):
        return None
    head = len(d) - 10
    own = new = d[head:]
    while True:  # numbers that may stand bare and others are permuted among themselves
        new = digits_permuted(new, key, "phone")
        if bool(NUMBERED.fullmatch(new)) == bool(NUMBERED.fullmatch(own)):
            return refill(s, d[:head] + new, r"\d")


#: Area and exchange of ten bare digits.
NUMBERED = re.compile(r"[2-9]\d{2}[2-9]\d{6}")


def ip(s: str, key: bytes) -> str | None:
    """Four octets of 0 to 255: permuted as one 32-bit number."""
    octets = s.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    x = permuted(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def ipv6(s: str, key: bytes) -> str | None:
    """An address in hexadecimal groups, permuted as one 128-bit number.

    Padded groups stay padded; a shortened address is written as short as its pseudonym
    allows.  Addresses below 2 ** 32, loopback and its kin, name nobody and stay."""
    import ipaddress

    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if x < 1 << 32:
        return None
    new = ipaddress.IPv6Address(permuted(x, 1 << 128, key, "ipv6"))
    if "::" in s:
        out = new.compressed
    else:
        padded = all(len(g) == 4 for g in s.split(":"))
        out = new.exploded if padded else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if s != s.lower() else out


def iban(s: str, key: bytes) -> str | None:
    """An IBAN that passes its mod-97 test: country and layout stay, check digits are renewed."""
    raw = s.replace(" ", "")
    if not 15 <= len(raw) <= 34 or number97(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = alnum_permuted(raw[4:], key, "iban")
    check = 98 - number97(body + raw[:2] + "00") % 97
    return refill(s, raw[:2] + f"{check:02d}" + body, r"\S")


def number97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def alnum_permuted(s: str, key: bytes, tweak: str) -> str:
    """Digits stay digits and letters keep their case; everything else stays in place.

    The value is permuted as one mixed-radix number, so that the map is a bijection on
    strings of the same shape."""
    alphabets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s if c.isascii() and c.isalnum()]
    shape = "".join("9" if c.isdigit() else "a" if c.islower() else "A" for c in s if c.isascii() and c.isalnum())
    x, size = 0, 1
    for c, a in zip((c for c in s if c.isascii() and c.isalnum()), alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    x = permuted(x, size, key, f"{tweak}:{shape}")
    out = []
    for a in reversed(alphabets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return refill(s, "".join(reversed(out)), r"[0-9A-Za-z]")


def national_id(s: str, key: bytes) -> str | None:
    """ddd-dd-dddd outside the areas that are never issued; the pseudonym is issuable too."""
    a, b, c = s.split("-")
    if a in ("000", "666") or a >= "900" or b == "00" or c == "0000":
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x = permuted((areas.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1, len(areas) * 99 * 9999, key, "national")
    x, c2 = divmod(x, 9999)
    a2, b2 = divmod(x, 99)
    return f"{areas[a2]:03d}-{b2 + 1:02d}-{c2 + 1:04d}"


DAYS = (date(1900, 1, 1), date(2100, 1, 1))


def day(s: str, key: bytes) -> str | None:
    """yyyy-mm-dd, or dd/mm/yyyy and its kin, naming a real day of 1900 to 2099.

    Where a day or month is written without a leading zero the pseudonym's are too; else
    both have two digits."""
    sep = next(c for c in s if not c.isdigit())
    p = s.split(sep)
    year_first = len(p[0]) == 4
    y, m, d = (p[0], p[1], p[2]) if year_first else (p[2], p[1], p[0])
    swap = not year_first and int(m) > 12 >= int(d)
    m, d = (d, m) if swap else (m, d)
    try:
        n = (date(int(y), int(m), int(d)) - DAYS[0]).days
    except ValueError:
        return None
    size = (DAYS[1] - DAYS[0]).days
    if not 0 <= n < size:
        return None
    x = DAYS[0] + timedelta(permuted(n, size, key, "day"))
    wide = 2 if len(m) == len(d) == 2 else 1
    m2, d2 = str(x.month).zfill(wide), str(x.day).zfill(wide)
    if swap:
        m2, d2 = d2, m2
    return sep.join((f"{x.year:04d}", m2, d2) if year_first else (d2, m2, f"{x.year:04d}"))


def email(s: str, key: bytes) -> str | None:
    """The local part and the domain's names are permuted apart; the last label stays.

    Letters are permuted in lower case and take their case from the original, so that one
    address in two spellings keeps one pseudonym."""
    low = s.lower()
    local, _, domain = low.rpartition("@")
    name, dot, last = domain.rpartition(".")
    new = f"{alnum_permuted(local, key, 'local')}@{alnum_permuted(name, key, 'domain')}{dot}{last}"
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, s, strict=True))


def secret(s: str, key: bytes) -> str | None:
    """The value of a named credential: long hexadecimal stays hexadecimal, in its case.

    Under 16 characters only a mix of letters and digits is one: other values are words."""
    if len(s) < 16 and not (re.search("[A-Za-z]", s) and re.search("[0-9]", s)):
        return None
    if len(s) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        new = f"{permuted(int(s, 16), 16 ** len(s), key, f'hex{len(s)}'):0{len(s)}x}"
        return new.upper() if s != s.lower() else new
    return alnum_permuted(s, key, "secret")


def key_id(s: str, key: bytes) -> str | None:
    """A credential known by its prefix, which stays."""
    head = next(h for h in KEY_HEADS if s.startswith(h))
    return head + alnum_permuted(s[len(head) :], key, f"key:{head}")


# Prefixes of published credential formats.
KEY_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ")

#: Patterns in order of precedence; the group named as the kind is what is replaced.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?i:token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<secret>[A-Za-z0-9_+/=-]{8,})"
    r"|(?<![A-Za-z0-9])(?i:bearer|authorization[\"']?\s*[:=]\s*[\"']?(?:basic|token|apikey))\s+(?P<bearer>[A-Za-z0-9._~+/=-]{16,})"
    r"|(?<![A-Za-z0-9_])(?P<key_id>(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{35}|gh[po]_[A-Za-z0-9]{36}|github_pat_\w{22,}|glpat-[\w-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[bp]-[A-Za-z0-9-]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?![A-Za-z0-9_])"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![\d/-]|\.\d))"
    r"|(?P<national_id>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4})*(?![\w:]))"
    r"|(?P<card>(?<![\d+-])(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,4}(?:(?P=s3)\d{1,3})?|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\d))"
    r"|(?P<phone>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d))"
)
#: Texts without any of these hold nothing to replace.
HINT = re.compile(r"\d\d|\d[./-]\d|@|[0-9A-Fa-f]:[:0-9A-Fa-f]|eyJ|xox[bp]-|A[KS]IA|AIza|gh[po]_|_pat_|glpat-|_live_|(?i:token|secret|passw|passp|pwd|[_-]?key|bearer|authoriz)")
MAKE = {"email": email, "phone": phone, "ip": ip, "ipv6": ipv6, "card": card, "iban": iban, "national_id": national_id, "date": day, "secret": secret, "bearer": secret, "key_id": key_id}
#: Groups that are reported as another kind.
SHOWN = {"key_id": "secret", "bearer": "secret"}


def pseudonymize(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, length) of each in it."""
    if not text or not HINT.search(text):
        return text, []
    out, found, at, length, made = [], [], 0, 0, {}
    pos = 0
    while m := PATTERN.search(text, pos):
        kind = m.lastgroup if m.lastgroup in MAKE else next(k for k in MAKE if m[k] is not None)
        value = m[kind]
        new = made[kind, value] if (kind, value) in made else made.setdefault((kind, value), MAKE[kind](value, key))
        if new is None:
            pos = m.start() + 1 if m.end() == m.start() + 1 else skip(text, m)
            continue
        a, b = m.span(kind)
        out += [text[at:a], new]
        length += a - at
        found.append((SHOWN.get(kind, kind), length, len(new)))
        length += len(new)
        at = pos = b
    return "".join([*out, text[at:]]), found


def skip(text: str, m: re.Match) -> int:
    """Where to look on after a value that failed its test: behind its first run of digits."""
    run = re.compile(r"\d+|\D").match(text, m.start())
    return max(run.end(), m.start() + 1)


def pseudonymize_documents(docs: DataFrame, key: str, text: str = "text", counts: str | None = "pii_counts", spans: str | None = "pii_spans") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by format-preserving pseudonyms.

    ``key`` is the secret of the permutation; the same key gives the same pseudonyms in any
    job.  ``counts`` (a map from kind to number) and ``spans`` (kind, start and length in the
    new text, in code points) are added unless None; columns of these names are replaced.
    Null and empty texts stay as they are, with empty maps and lists.  All other columns,
    rows, ties and repeats pass through.  Values that fail validation are left alone: cards
    without a right Luhn digit, octets over 255, dates not in the calendar, short
    credentials that are words.
    """
    keep = [f for f in docs.schema.fields if f.name not in (counts, spans)]
    schema = T.StructType([*keep])
    if counts:
        schema = schema.add(counts, T.MapType(T.StringType(), T.LongType()))
    if spans:
        schema = schema.add(spans, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))
    secret_key = hashlib.sha256(key.encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pseudonymize(t.as_py(), secret_key) for t in b.column(b.schema.get_field_index(text))]
            cols = [pa.array([t for t, _ in got], b.schema.field(text).type) if f.name == text else b.column(b.schema.get_field_index(f.name)) for f in keep]
            if counts:
                cols.append(pa.array([[(k, n) for k in KINDS if (n := sum(x[0] == k for x in found))] for _, found in got], pa.map_(pa.string(), pa.int64())))
            if spans:
                cols.append(pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in found] for _, found in got], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*[docs[f.name] for f in keep]).mapInArrow(run, schema)
