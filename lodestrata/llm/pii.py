"""Format-preserving Feistel pseudonyms for personal data (operator 8).

Numbers, dates and identifiers that pass their kind's check (Luhn, mod 97, octets, calendar, area codes) are replaced by
a keyed permutation of the values of their format: a Feistel network whose round function is keyed BLAKE2b. The
permutation depends on the key, the kind and the canonical value only, so that equal values stay equal in all
documents, in whatever notation, and different values stay different. The result has the same length, separators and
validity. Rows never move: one pass over Arrow batches, memory bounded by a batch.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROUNDS = 10
#: characters that one permutation covers at most
CHARS = 256
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


# -- the permutation ------------------------------------------------------------------------------------------------


def _round(key: bytes, kind: str, i: int, half: int, size: int) -> int:
    n = max(16, (size.bit_length() + 7) // 8 + 8)
    data = f"{kind}|{i}|{size}|{half}".encode()
    out = b"".join(hashlib.blake2b(data + b"|%d" % k, key=key, digest_size=64).digest() for k in range(-(-n // 64)))
    return int.from_bytes(out[:n], "big") % size


def feistel(key: bytes, kind: str, x: int, a: int, b: int, back: bool = False) -> int:
    """A permutation of range(a * b): halves of sizes a and b are shifted in turn by a keyed function of the other."""
    left, right = divmod(x, b)
    sign = -1 if back else 1
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            left = (left + sign * _round(key, kind, i, right, a)) % a
        else:
            right = (right + sign * _round(key, kind, i, left, b)) % b
    return left * b + right


def permute(key: bytes, kind: str, x: int, size: int, allowed=None, back: bool = False) -> int:
    """A permutation of the allowed numbers of range(size), by walking the cycle until one is met."""
    a = max(1, int(size**0.5)) if size < 1 << 100 else 1 << (size.bit_length() // 2)
    b = -(-size // a)
    while True:
        x = feistel(key, kind, x, a, b, back)
        if x < size and (allowed is None or allowed(x)):
            return x


def permute_chars(key: bytes, kind: str, s: str, back: bool = False) -> str:
    """Letters and digits of s within their class; the rest stays. Parts of CHARS characters are permuted each by itself."""
    if len(s) > CHARS:
        return "".join(permute_chars(key, f"{kind}+{a}" if a else kind, s[a : a + CHARS], back) for a in range(0, len(s), CHARS))
    classes = [next((c for c in (LOWER, UPPER, DIGITS) if ch in c), None) for ch in s]
    size = 1
    for c in classes:
        size *= len(c) if c else 1
    if size == 1:
        return s
    x = 0
    for ch, c in zip(s, classes, strict=True):
        x = x * len(c) + c.index(ch) if c else x
    shape = "".join({LOWER: "a", UPPER: "A", DIGITS: "0"}.get(c, ch) if c else ch for ch, c in zip(s, classes, strict=True))
    x = permute(key, f"{kind}:{shape}", x, size, back=back)
    out = []
    for ch, c in zip(reversed(s), reversed(classes), strict=True):
        if c:
            x, k = divmod(x, len(c))
            ch = c[k]  # noqa: PLW2901
        out.append(ch)
    return "".join(reversed(out))


def fill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if ch in DIGITS else ch for ch in shape)


# -- checks ---------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10, 0 for valid numbers."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97


def ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


# -- kinds: each maps (key, match) to the pseudonym, or None where the check fails --------------------------------------


def _digits(s: str) -> str:
    return "".join(ch for ch in s if ch in DIGITS)


def _email(key, m):
    local, _, domain = m.group().rpartition("@")
    host, dot, top = domain.rpartition(".")
    local = permute_chars(key, "email", local)
    return f"{local}@{permute_chars(key, 'email host', host.lower())}{dot}{top}"


def _card(key, m):
    d = _digits(m.group())
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    # the first digit names the network and stays
    body = d[0] + f"{permute(key, f'card {d[0]} {len(d)}', int(d[1:-1]), 10 ** (len(d) - 2)):0{len(d) - 2}d}"
    return fill(m.group(), body + str(-luhn(body + "0") % 10))


def _phone(key, m):
    s = m.group()
    plus = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    head, rest = (s[: plus.end()], s[plus.end() :]) if plus else ("", s)
    d = _digits(rest)
    if not 7 <= len(d) <= 12 or not plus and len(d) != 10:
        return None
    first = 1 if len(d) == 10 and d[0] >= "2" else 0  # ten digits: the area code begins with 2 to 9
    n = permute(key, f"phone {len(d)}", int(d), 10 ** len(d), (lambda x: x >= 2 * 10**9) if first else None)
    return head + fill(rest, f"{n:0{len(d)}d}")


def _ip(key, m):
    octets = [int(x) for x in m.group().split(".")]
    if any(x > 255 for x in octets) or octets[0] in (0, 127, 255):
        return None
    x = 0
    for o in octets:
        x = x << 8 | o
    x = permute(key, "ip", x, 1 << 32, lambda v: v >> 24 not in (0, 127, 255))
    return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))


def _ssn(key, m):
    d = _digits(m.group())
    if not ssn_ok(int(d)):
        return None
    return fill(m.group(), f"{permute(key, 'ssn', int(d), 10**9, ssn_ok):09d}")


def _iban(key, m):
    s = m.group().replace(" ", "")
    if not 15 <= len(s) <= 34 or mod97(s) != 1:
        return None
    body = permute_chars(key, f"iban {s[:2]}", s[4:])
    iter_ = iter(s[:2] + f"{98 - mod97(s[:2] + '00' + body):02d}" + body)
    return "".join(ch if ch == " " else next(iter_) for ch in m.group())


def _date(year, month, day, show):
    def replace(key, m):
        try:
            y, mo, d = int(m.group(year)), m.group(month), int(m.group(day))
            mo = int(mo) if mo.isdigit() else next(i for i, x in enumerate(MONTHS, 1) if x.lower().startswith(mo.lower().rstrip(".")[:3]))
            n = dt.date(y, mo, d).toordinal()
        except (ValueError, StopIteration):
            return None
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        new = dt.date.fromordinal(FIRST_DAY + permute(key, "date", n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        return show(m, new)

    return replace


def _secret(key, m):
    return m.group("label") + permute_chars(key, "secret", m.group("value"))


def _token(key, m):
    s = m.group()
    n = len(m.group("prefix"))
    return s[:n] + permute_chars(key, "token", s[n:])


# How tokens begin.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "sk_live_", "pk_live_", "xoxa-", "xoxb-", "xoxp-", "AIza"]

MONTH = "|".join(f"{m}|{m[:3]}\\.?" for m in MONTHS)
#: kind -> (pattern, replacement); the first that matches at a place wins.
KINDS = {
    "secret": (r"(?P<label>\b(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)[ \t]*[=:][ \t]*[\"']?)(?P<value>[A-Za-z0-9_+/=.-]{6,})", _secret),
    "token": (rf"\b(?P<prefix>{"|".join(PREFIXES)})[A-Za-z0-9_-]{{16,}}", _token),
    "email": (r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    "iban": (r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", _iban),
    "date_iso": (r"(?<![\d-])(?P<y1>\d{4})-(?P<m1>\d{2})-(?P<d1>\d{2})(?![\d-])", _date("y1", "m1", "d1", lambda m, x: x.isoformat())),
    "date_dmy": (r"(?<![\d/.])(?P<d2>\d{2})(?P<sep>[/.])(?P<m2>\d{2})(?P=sep)(?P<y2>(?:19|20)\d{2})(?![\d/])", _date("y2", "m2", "d2", lambda m, x: f"{x.day:02d}{m.group('sep')}{x.month:02d}{m.group('sep')}{x.year}")),
    "date_text": (rf"\b(?P<d3>\d{{1,2}}) (?P<m3>{MONTH}) (?P<y3>(?:19|20)\d{{2}})\b", _date("y3", "m3", "d3", lambda m, x: f"{x.day} {MONTHS[x.month - 1] if m.group('m3') in MONTHS else MONTHS[x.month - 1][:3]} {x.year}")),
    "date_us": (rf"\b(?P<m4>{MONTH}) (?P<d4>\d{{1,2}}), (?P<y4>(?:19|20)\d{{2}})\b", _date("y4", "m4", "d4", lambda m, x: f"{MONTHS[x.month - 1] if m.group('m4') in MONTHS else MONTHS[x.month - 1][:3]} {x.day}, {x.year}")),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ip),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "card": (r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?!\d|\.\d)", _card),
    "phone": (r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-])", _phone),
}
PATTERN = "|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items())
#: Every kind has one of these characters, or begins as a token does, and none crosses a line's end: other lines are not scanned.
HINT = r"[0-9@=:]"
_SCAN, _HINT, _SKIP = re.compile(PATTERN), re.compile(HINT), re.compile(r"\w+|.", re.S)
_KINDS = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}
_HINT_TOKEN = re.compile("|".join([HINT, *map(re.escape, PREFIXES)]))


def _shorter_card(m, key: bytes):
    """(match, pseudonym) of the longest card that ends at a separator within m; a date or security code may follow it."""
    shown = m.group()
    digits = _digits(shown)
    n = len(digits)
    for at in range(len(shown) - 1, 12, -1):
        if shown[at] not in DIGITS:
            if 13 <= n <= 19 and not luhn(digits[:n]) and (shorter := _KINDS["card"].match(m.string, m.start(), m.start() + at)) and shorter.end() == m.start() + at:
                new = _card(key, shorter)
                if new is not None:
                    return shorter, new
        else:
            n -= 1
    return None, None


def _replace(text: str, start: int, end: int, key: bytes):
    """The first match from start on in a line that ends at end: (kind, start, end, pseudonym), or where to go on, or None."""
    m = _SCAN.search(text, start, end)
    if m is None:
        return None
    # where the check of the kind that matched fails, another may still match at this place
    for kind, (_, make) in KINDS.items():
        m2 = m if m.group(kind) is not None else _KINDS[kind].match(text, m.start(), end)
        new = make(key, m2) if m2 else None
        if new is None and m2 and kind == "card":
            m2, new = _shorter_card(m2, key)
        if new is not None:
            return kind.partition("_")[0], m2.start(), m2.end(), new
    return _SKIP.match(text, m.start()).end()


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(text with pseudonyms, [(kind, start, end in the original, pseudonym)])."""
    out, found, at, pos = [], [], 0, 0
    hints = _HINT_TOKEN if any(p in text for p in PREFIXES) else _HINT
    while (hint := hints.search(text, pos)) is not None:
        start = max(pos, text.rfind("\n", pos, hint.start()) + 1)
        end = text.find("\n", hint.start())
        end = len(text) if end < 0 else end
        while (got := _replace(text, start, end, key)) is not None:
            if isinstance(got, int):
                start = got
                continue
            found.append(got)
            out += [text[at : got[1]], got[3]]
            at = start = got[2]
        pos = end
    return "".join([*out, text[at:]]) if found else text, found


def derive_key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def pseudonymise_frame(docs: DataFrame, secret: str, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with `text` rewritten and, if spans names a column, the list of (kind, start, end, pseudonym) found.

    Nulls stay null and empty texts empty, with an empty list. All other columns and rows are passed on unchanged.
    A column that already has the name in spans is an error.
    """
    key = derive_key(secret)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())]))
    if spans in docs.columns:
        raise ValueError(f"column {spans} exists")
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, span)] if spans else [])])
    place = docs.columns.index(text)

    def work(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            for a, b in common.text_batches(batch, place, 8_000_000):
                part = batch.slice(a, b - a)
                done = [(None, []) if t is None else pseudonymise(t, key) for t in part.column(place).to_pylist()]
                columns = part.columns
                columns[place] = pa.array([t for t, _ in done], batch.schema.field(place).type)
                if spans:
                    columns.append(pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in f] for _, f in done], kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)


def summary(marked: DataFrame, key: str, spans: str, text: str) -> DataFrame:
    """key, n_found, kinds (in order of the alphabet) and the rewritten text."""
    return marked.select(key, F.size(spans).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kind"]))), ",").alias("kinds"), F.col(text))
