"""Format-preserving pseudonyms for personal data.

A validated value is read as a number of its format's domain, permuted there by a
keyed Feistel network (cycle-walking back into the domain) and written in the same
format: a card number stays a card number, a date a date of the same style.  The
permutation depends on the key and the kind alone, so equal values stay equal in
all documents and, with the key, values can be told back.  Only where a new value
and the digits or letters right beside it would be read as another value does it
walk on, so that the text can still be told back.

Kinds: dates (days and months of one or two digits, whole or short month names);
card numbers (13 to 19 digits in any single-gapped groups; inside a longer run of
digits, in groups of four and more; Luhn, others of that length stay), IBANs (mod 97),
social security and telephone numbers, IPv4 addresses, e-mail names, and secrets
(hexadecimal or by character class).  All work is inside a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame

#: The key of the registered query; a deployment passes its own.
DEFAULT_KEY = b"pseudonym key of the example query"
ROUNDS = 10
#: Domains from here on have more decimal digits than Python writes.
LARGE = 10 ** 4300
FIRST_DAY, N_DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")


class Feistel:
    """A keyed permutation of ``range(n)`` for any n, another one for each kind."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, kind: str, n: int, i: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        if n < LARGE:
            data, width = f"{kind}|{n}|{i}|{half}".encode(), 1
        else:  # too long for decimal digits: hashed once, then block by block
            data, width = hashlib.blake2b(f"{kind}|x{n:x}|{i}|{half:x}".encode(), key=self.key).digest(), 8
        out = b"".join(hashlib.blake2b(data + block.to_bytes(width, "big"), key=self.key).digest() for block in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, kind: str, x: int, n: int, back: bool) -> int:
        bits = max(2, (n - 1).bit_length())
        low = bits // 2
        high = bits - low
        left, right = x >> low, x & ((1 << low) - 1)
        order = range(self.rounds)
        for i in reversed(order) if back else order:
            if i % 2:
                left ^= self._f(kind, n, i, right, high)
            else:
                right ^= self._f(kind, n, i, left, low)
        return left << low | right

    def permute(self, kind: str, x: int, n: int, ok: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The image of ``x``, walking on while it lies outside ``range(n)`` or ``ok``
        (which ``x`` itself fulfils) does not hold."""
        while True:
            x = self._once(kind, x, n, back)
            if x < n and (ok is None or ok(x)):
                return x


# --- formats ---------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def by_class(f: Feistel, kind: str, s: str, back: bool = False) -> str:
    """Letters stay letters of their case and digits digits, at their places."""
    base = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in s]
    zero = ["0" if b == 10 else "A" if c.isupper() else "a" for b, c in zip(base, s)]
    # Number and size of the domain by halves, and back: a long value costs few long products.
    levels = [[(ord(c) - ord(z) if b > 1 else 0, b) for b, z, c in zip(base, zero, s)]]
    while len(last := levels[-1]) > 1:
        levels.append([(x * m + y, n * m) for (x, n), (y, m) in zip(last[::2], last[1::2])] + last[len(last) & ~1:])
    x, n = levels[-1][0] if s else (0, 1)
    if n == 1:
        return s
    xs = [f.permute(kind, x, n, back=back)]
    for level in reversed(levels[:-1]):
        xs = [y for i, x in enumerate(xs) for y in (divmod(x, level[2 * i + 1][1]) if 2 * i + 1 < len(level) else (x,))]
    return "".join(chr(ord(z) + x) if b > 1 else c for b, z, c, x in zip(base, zero, s, xs))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def card(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    """Card numbers: the check digit must be right, and is right again after."""
    d = digits_of(s)
    if not 13 <= len(d) <= 19 or not luhn(d):
        return None
    head = f"{f.permute('card', int(d[:-1]), 10 ** (len(d) - 1), back=back):0{len(d) - 1}d}"
    return "card", fill(s, next(head + c for c in "0123456789" if luhn(head + c)))


def iban(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not iban_ok(plain):
        return None
    rest = by_class(f, "iban", plain[4:], back)
    check = 98 - int("".join(str(int(c, 36)) for c in rest + plain[:2] + "00")) % 97
    it = iter(f"{plain[:2]}{check:02d}{rest}")
    return "iban", "".join(c if c == " " else next(it) for c in s)


def ssn(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = digits_of(s)
    if not good(d):
        return None
    return "ssn", fill(s, f"{f.permute('ssn', int(d), 10 ** 9, lambda x: good(f'{x:09d}'), back):09d}")


def phone(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|", s)[0]
    rest = s[len(country):]
    d = digits_of(rest)
    if not 7 <= len(d) <= 14:
        return None
    return "phone", country + fill(rest, f"{f.permute('phone', int(d), 10 ** len(d), back=back):0{len(d)}d}")


def ipv4(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back=back)
    return "ip", ".".join(map(str, x.to_bytes(4, "big")))


def email(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    name, domain = s.split("@")
    return "email", f"{by_class(f, 'email', name, back)}@{domain}"


def secret(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and len(s) >= 16:
        upper = s != s.lower()
        # Case must survive: without letters the value counts as lower case.
        keep = (lambda x: f"{x:0{len(s)}X}" != f"{x:0{len(s)}x}") if upper else None
        x = f.permute("hex" + "U" * upper, int(s, 16), 16 ** len(s), keep, back)
        return "secret", f"{x:0{len(s)}{'X' if upper else 'x'}}"
    return "secret", by_class(f, "secret", s, back)


def _day(y: str, m: str, d: str) -> date | None:
    try:
        x = date(int(y), int(m), int(d))
    except ValueError:
        return None
    return x if 0 <= (x - FIRST_DAY).days < N_DAYS else None


def when(f: Feistel, s: str, back: bool = False) -> tuple[str, str] | None:
    """Dates, each written back in its own style."""
    def moved(x: date, style: str, ok=None) -> date:
        test = None if ok is None else lambda n: ok(FIRST_DAY + timedelta(n))
        return FIRST_DAY + timedelta(f.permute("date" + style, (x - FIRST_DAY).days, N_DAYS, test, back))

    def fits(d: str, m: str):
        """A field of one digit stays one; fields of two take all values."""
        return lambda z: (len(d) == 2 or z.day < 10) and (len(m) == 2 or z.month < 10)

    if m := re.fullmatch(r"(\d{4})([-/.])(\d\d?)\2(\d\d?)", s):
        if x := _day(m[1], m[3], m[4]):
            y = moved(x, "ymd", fits(m[4], m[3]))
            return "date", f"{y.year}{m[2]}{y.month:0{len(m[3])}d}{m[2]}{y.day:0{len(m[4])}d}"
    elif m := re.fullmatch(r"(\d\d?)([-/.])(\d\d?)\2(\d{4})", s):
        if x := _day(m[4], m[3], m[1]):
            y = moved(x, "dmy", fits(m[1], m[3]))
            return "date", f"{y.day:0{len(m[1])}d}{m[2]}{y.month:0{len(m[3])}d}{m[2]}{y.year}"
        if x := _day(m[4], m[1], m[3]):  # months first, told by the day above 12
            fit = fits(m[3], m[1])
            y = moved(x, "mdy", lambda z: z.day > 12 and fit(z))
            return "date", f"{y.month:0{len(m[1])}d}{m[2]}{y.day:0{len(m[3])}d}{m[2]}{y.year}"
    elif m := re.fullmatch(r"(\d{1,2}) ([A-Z][a-z]+\.?) (\d{4})", s):
        names, style = _months(m[2])
        if x := _day(m[3], str(names.index(m[2]) + 1), m[1]):
            y = moved(x, "d m y" + style, _written(names, m[1]))
            return "date", f"{y.day:0{1 + (m[1][0] == '0')}d} {names[y.month - 1]} {y.year}"
    elif m := re.fullmatch(r"([A-Z][a-z]+\.?) (\d{1,2}), (\d{4})", s):
        names, style = _months(m[1])
        if x := _day(m[3], str(names.index(m[1]) + 1), m[2]):
            y = moved(x, "m d, y" + style, _written(names, m[2]))
            return "date", f"{names[y.month - 1]} {y.day:0{1 + (m[2][0] == '0')}d}, {y.year}"
    return None


def _months(name: str) -> tuple[tuple[str, ...], str]:
    """The names in the style of ``name`` (empty: not in it), and the style.  A short
    May without a dot is the whole name; Sept has no other month of its style."""
    if name in MONTHS:
        return MONTHS, ""
    dot = "." if name.endswith(".") else ""
    if name == "Sept" + dot:
        return tuple(name if m == "September" else "" for m in MONTHS), " sept" + dot
    return tuple(m[:3] + dot if dot or m != "May" else "" for m in MONTHS), " short" + dot


def _written(names: tuple[str, ...], day: str) -> Callable[[date], bool]:
    return lambda z: names[z.month - 1] != "" and (day[0] != "0" or z.day < 10)


_SHORT = "(?:" + "|".join(["Sept", *(m[:3] for m in MONTHS)]) + r")\.?"
_MONTH = "(?:" + "|".join(MONTHS) + rf"|(?<![A-Za-z]){_SHORT})"
RULES: list[tuple[str, str, Callable]] = [
    ("secret", r"(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_-]{12,})", secret),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("hex", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])", secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    ("date", rf"(?<![0-9.])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}})(?![0-9])|(?<![0-9])[0-9]{{1,2}} {_MONTH} [0-9]{{4}}(?![0-9])|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])", when),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ipv4),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9][0-9]-[0-9]{4}(?![0-9-])", ssn),
    # A whole run of digits and single gaps, then one inside a longer run, of groups of four and more (the last any).
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", card),
    ("phone", r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", phone),
    ("inner_card", r"(?<![0-9])[0-9]{4}(?:(?:[ -](?=[0-9]{4}))?[0-9]){6,15}(?:[ -][0-9]{1,3})?(?![0-9])", card),
]


def _combined() -> re.Pattern:
    parts = []
    for name, pattern, _ in RULES:  # numbered back references become named ones
        for i in (1, 2):
            pattern = pattern.replace(rf"\{i}", f"(?P={name}_sep{i})").replace("([-/.])", f"(?P<{name}_sep{i}>[-/.])", 1) \
                if rf"\{i}" in pattern else pattern
        parts.append(f"(?P<{name}>{pattern})")
    return re.compile("|".join(parts))


_PATTERN = _combined()
_MAKE = {name: make for name, _, make in RULES}
_ONE = {name: re.compile(pattern) for name, pattern, _ in RULES}
#: Kinds of several groups: a rejected candidate may hold a value that ends at an earlier gap.
_GROUPED = {"iban": " ", "inner_card": " -", "phone": " .-"}
#: Characters beside a value that a candidate across its border can reach.
REACH = 64


class _Still(Feistel):
    """Moves nothing: the checks of the formats alone."""

    def permute(self, kind: str, x: int, n: int, ok: Callable[[int], bool] | None = None, back: bool = False) -> int:
        return x


_STILL = _Still(b"")


def _valid(name: str, value: str) -> bool:
    return name in ("secret", "email", "hex") or _MAKE[name](_STILL, value) is not None


def _candidates(text: str, m: re.Match) -> Iterator[tuple[str, int, int]]:
    """All values that may begin where ``m`` does: kinds in the order of the rules, the
    longest of each first."""
    names, start = list(_MAKE), m.start()
    name = m.lastgroup if m.lastgroup in _MAKE else next(n for n in names if m[n] is not None)
    yield name, *m.span("secret_value" if name == "secret" else name)
    for other in names[names.index(name):]:
        if found := _ONE[other].match(text, start):
            if other != name:
                yield other, *found.span("secret_value" if other == "secret" else 0)
            for end in range(found.end() - 1, start, -1) if other in _GROUPED else ():
                if text[end] in _GROUPED[other] and _ONE[other].fullmatch(text, start, end):
                    yield other, start, end


def _values(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(rule, start, end) of each value from ``at`` on.  Where all candidates of a place
    fail their check, the search goes on one place further."""
    while m := _PATTERN.search(text, at):
        at = m.start() + 1
        for name, a, b in _candidates(text, m):
            if _valid(name, text[a:b]):
                yield name, a, b
                at = b
                break


def _moved(f: Feistel, name: str, value: str, left: list[str], right: list[str], back: bool) -> tuple[str, str]:
    """Kind and image of a value between ``left`` and ``right`` (texts and values in
    turn), walking on while the new text would be read in another way: a group of
    digits beside it may make a card with a part of the new value."""
    size, i, j = 0, len(left), 0
    while i and size < REACH:
        i -= 1
        size += len(left[i])
    before = "".join(left[max(0, i - 2):i])[-2:]
    at = len(before)
    if i % 2 == 0 and size > REACH:  # a text may be cut, a value not
        rest = REACH - size + len(left[i])
        before = (before + left[i])[-2 - rest:]
        at = len(before) - rest
        before += "".join(left[i + 1:])
    else:
        before += "".join(left[i:])
    after, size = [], 0
    while j < len(right) and size < REACH:
        after.append(right[j] if j % 2 else right[j][:REACH])
        size += len(after[-1])
        j += 1
    after, a = "".join(after), len(before)

    def read(v: str) -> list[tuple[str, int, int]]:
        found = []
        for rule, x, y in _values(before + v + after, at):
            x, y = (p if p <= a else max(a, p - len(v)) for p in (x, y))
            if x > a + 2:
                break
            found.append((rule, x, y))
        return found

    want, first = read(value), None
    new = value
    for _ in range(1000):  # without end for an IBAN whose check digits no bank gives
        kind, new = _MAKE[name](f, new, back)
        first = first or new
        if read(new) == want:
            return kind, new
    return kind, first


def pseudonymise(f: Feistel, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all values replaced, and (kind, start, length) of each in it."""
    parts, names, at = [], [], 0
    for name, a, b in _values(text):
        parts += (text[at:a], text[a:b])
        names.append(name)
        at = b
    parts.append(text[at:])
    # Each value is moved between new ones on its left and old ones on its right; back, the last comes first.
    kinds = [""] * len(names)
    for i in reversed(range(len(names))) if back else range(len(names)):
        k = 2 * i + 1
        near = max(0, k - 2 * REACH), k + 2 * REACH
        near = near[0] + near[0] % 2, near[1]
        kinds[i], parts[k] = _moved(f, names[i], parts[k], parts[near[0]:k], parts[k + 1:near[1]], back)
    spans, size = [], 0
    for i, part in enumerate(parts):
        if i % 2:
            spans.append((kinds[i // 2], size, len(part)))
        size += len(part)
    return "".join(parts), spans


def pseudonyms(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text", spans_col: str | None = "spans",
               back: bool = False) -> DataFrame:
    """``docs`` with values in ``text_col`` replaced; all other columns stay as they
    are, and ``spans_col`` (if named; an equal column is replaced) tells kind, start
    and length of each pseudonym in the new text.

    A null text stays null, with no spans.  Values that fail their check (an octet
    above 255, a 30 February) stay."""
    import pyarrow as pa

    names = [c for c in docs.columns if c != spans_col]
    src = docs.select(*[docs[c] for c in names])
    place = names.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def batches(it):
        f = Feistel(key)
        for b in it:
            texts, spans, changed = b.column(place).to_pylist(), [], False
            for i, t in enumerate(texts):
                found = []
                # Every kind holds a digit or an at sign.
                if t and any(c in t for c in "0123456789@"):
                    texts[i], found = pseudonymise(f, t, back)
                    changed |= bool(found)
                spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
            columns = list(b.columns)
            if changed:
                columns[place] = pa.array(texts, b.schema.field(place).type)
            if spans_col:
                columns.append(pa.array(spans, span))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *([spans_col] if spans_col else [])])

    schema = src.schema
    if spans_col:
        from pyspark.sql import types as T

        item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                             T.StructField("length", T.IntegerType())])
        schema = T.StructType([*src.schema.fields, T.StructField(spans_col, T.ArrayType(item))])
    return src.mapInArrow(batches, schema)
