"""Format-preserving pseudonyms: a keyed Feistel permutation over the valid values of each format.

Every kind of value is a range of whole numbers: valid card numbers of a length and network digit,
phone numbers, dates of two centuries, letters and digits of an address. A value is ranked, the rank
is permuted within the range (Feistel rounds, walked until inside), and written back in the same
format. A permutation has an inverse and no collisions, so equal values stay equal in all documents
and different values stay different; who holds the key can undo it.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Setting of the session that holds the secret of a job.
KEY_SETTING = "spark.arborlens.pseudonyms.key"
ROUNDS = 8
MEMORY = 50_000


def job_key(spark: SparkSession) -> bytes:
    """The secret in ``KEY_SETTING``. Without one a job draws its own: its values are linked, but nobody can undo them."""
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(named.encode()).digest() if named else secrets.token_bytes(32)


def _feistel(x: int, a: int, b: int, key: bytes, tweak: bytes, back: bool) -> int:
    """One pass over ``[0, a * b)``: the halves, of ``a`` and ``b`` values, are shifted by turns."""
    left, right = divmod(x, b)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        other, size = (right, a) if r % 2 == 0 else (left, b)
        text = other.to_bytes((other.bit_length() + 7) // 8 or 1, "big")
        shift = int.from_bytes(hashlib.blake2b(tweak + bytes([r]) + text, key=key, digest_size=32).digest(), "big")
        if back:
            shift = -shift
        if r % 2 == 0:
            left = (left + shift) % size
        else:
            right = (right + shift) % size
    return left * b + right


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of ``[0, n)``; ``back`` undoes it."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        x = _feistel(x, a, b, key, tweak, back)
        if x < n:
            return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(value: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    # The first digit names the kind of card; the last one follows from the others.
    body = digits[1:-1]
    new = str(permute(int(body), 10 ** len(body), key, b"card" + digits[0].encode() + bytes([len(digits)]), back)).zfill(len(body))
    new = digits[0] + new
    return _fill(value, new + luhn_digit(new))


_NANP = 800 * 800 * 10_000


def _phone(value: str, key: bytes, back: bool) -> str | None:
    """Valid numbers, and beside them, as a range of its own, those that are written as numbers but not dealt out."""
    digits = re.sub(r"\D", "", value)
    head, national = digits[:-10], digits[-10:]
    if national[0] in "01" or national[3] in "01":
        while True:
            national = f"{permute(int(national), 10**10, key, b'phone, not valid', back):010d}"
            if national[0] in "01" or national[3] in "01":
                return _fill(value, head + national)
    rank = ((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200) * 10_000 + int(national[6:])
    rank = permute(rank, _NANP, key, b"phone", back)
    area, rest = divmod(rank, 800 * 10_000)
    exchange, line = divmod(rest, 10_000)
    return _fill(value, f"{head}{area + 200}{exchange + 200}{line:04d}")


def _address(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    rank = permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, key, b"ipv4", back)
    return ".".join(map(str, rank.to_bytes(4, "big")))


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = permute(rank, 898 * 99 * 9999, key, b"ssn", back)
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    area += 1
    area += area >= 666
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(value: str, key: bytes, back: bool) -> str | None:
    """Country and lengths stay; letters and digits of the account are permuted, check digits follow."""
    plain = value.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _characters(plain[4:], key, b"iban" + plain[:2].encode(), back)
    check = 98 - number(account + plain[:2] + "00") % 97
    new, it = plain[:2] + f"{check:02d}" + account, 0
    out = []
    for c in value:
        out.append(c if c == " " else new[it].lower() if value.islower() else new[it])
        it += c != " "
    return "".join(out)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(value: str, key: bytes, back: bool) -> str | None:
    """Days of two centuries. One permutation for all formats, so a day stays linked across them."""
    a, mark, b, _, c = re.fullmatch(r"(\d+)([-./])(\d+)([-./])(\d+)", value).groups()
    year_first = len(a) == 4
    if year_first:
        year, month, day = int(a), int(b), int(c)
    elif mark == "/":
        month, day, year = int(a), int(b), int(c)
    else:
        day, month, year = int(a), int(b), int(c)
    new = _day(year, month, day, key, back)
    if new is None:
        return None
    y, m, d = f"{new.year}", f"{new.month:02d}", f"{new.day:02d}"
    return mark.join((y, m, d) if year_first else (m, d, y) if mark == "/" else (d, m, y))


def _day(year: int, month: int, day: int, key: bytes, back: bool) -> datetime.date | None:
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    rank = permute(datetime.date(year, month, day).toordinal() - _FIRST, _LAST - _FIRST + 1, key, b"date", back)
    return datetime.date.fromordinal(rank + _FIRST)


def _short_date(value: str, key: bytes, back: bool) -> str | None:
    """``3.4.2021`` and ``4/3/2021``: no zeros before a number. The result may have two digits where the value has one."""
    mark = "/" if "/" in value else "."
    a, b, year = map(int, value.split(mark))
    month, day = (a, b) if mark == "/" else (b, a)
    new = _day(year, month, day, key, back)
    return new and mark.join(map(str, (new.month, new.day, new.year) if mark == "/" else (new.day, new.month, new.year)))


# Names of the months. How a date is written says which language it is in.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_WRITTEN = {
    "en": ("{d} {m} {y}", r"(?P<d>\d{1,2}) (?P<m>NAME) (?P<y>\d{4})"),
    "en, month first": ("{m} {d}, {y}", r"(?P<m>NAME) (?P<d>\d{1,2}), (?P<y>\d{4})"),
    "de": ("{d}. {m} {y}", r"(?P<d>\d{1,2})\. (?P<m>NAME) (?P<y>\d{4})"),
    "fr": ("{d} {m} {y}", r"(?P<d>\d{1,2}) (?P<m>NAME) (?P<y>\d{4})"),
    "es": ("{d} de {m} de {y}", r"(?P<d>\d{1,2}) de (?P<m>NAME) de (?P<y>\d{4})"),
}
_WRITTEN_FORMS = [(f, _MONTHS[n[:2]], re.compile(r.replace("NAME", "|".join(_MONTHS[n[:2]])))) for n, (f, r) in _WRITTEN.items()]
_ANY_WRITTEN = "|".join(re.sub(r"\?P<[dmy]>", "?:", r.pattern) for *_, r in _WRITTEN_FORMS)


def _written_date(value: str, key: bytes, back: bool) -> str | None:
    """``12 March 2021``, ``March 12, 2021``, ``12. März 2021``, ``12 mars 2021``, ``12 de marzo de 2021``."""
    for form, months, pattern in _WRITTEN_FORMS:
        m = pattern.fullmatch(value)
        if m and not m["d"].startswith("0"):
            new = _day(int(m["y"]), months.index(m["m"]) + 1, int(m["d"]), key, back)
            return new and form.format(d=new.day, m=months[new.month - 1], y=new.year)
    return None


#: Country codes of one and of two digits; all others have three.
_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58".split())
_CODES |= set("60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _national(number: str, code: str, key: bytes, back: bool) -> str:
    """Digits behind the country code; the first one stays apart from 0 if it is, so the length says what is valid."""
    zero = number[0] == "0"
    first = 0 if zero else 10 ** (len(number) - 1)
    n = 10 ** (len(number) - 1) if zero else 9 * 10 ** (len(number) - 1)
    tweak = b"phone of " + code.encode() + bytes([len(number), zero])
    return str(permute(int(number) - first, n, key, tweak, back) + first).zfill(len(number))


def _foreign_phone(value: str, key: bytes, back: bool) -> str | None:
    """A number with ``+`` and its country code, 8 to 15 digits in all. Code and length stay."""
    digits = re.sub(r"\D", "", value)
    code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])
    if not 8 <= len(digits) <= 15 or len(digits) - len(code) < 5:
        return None
    return _fill(value, code + _national(digits[len(code) :], code, key, back))


def _french_phone(value: str, key: bytes, back: bool) -> str | None:
    """``01 42 68 53 00`` is ``+33 1 42 68 53 00``."""
    return _fill(value, "0" + _national(re.sub(r"\D", "", value)[1:], "33", key, back))


def _address6(value: str, key: bytes, back: bool) -> str | None:
    """In its shortest form an address is a number of 128 bits; written otherwise, its hex digits are permuted as they stand."""
    try:
        address = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if len(re.sub(":", "", value)) < 4:
        return None
    if value == address.compressed:
        # The result is in its shortest form too, so it leads back.
        return ipaddress.IPv6Address(permute(int(address), 2**128, key, b"ipv6", back)).compressed
    digits = re.sub(":", "", value)
    new = permute(int(digits, 16), 16 ** len(digits), key, b"ipv6" + re.sub("[^:]", "x", value).encode(), back)
    it = iter(f"{new:0{len(digits)}X}" if value.upper() == value else f"{new:0{len(digits)}x}")
    made = "".join(c if c == ":" else next(it) for c in value)
    return made if made != ipaddress.IPv6Address(made).compressed and (value.upper() == value or value.lower() == value) else None


def _characters(value: str, key: bytes, tweak: bytes, back: bool, fold: bool = False) -> str:
    """Permute within the pattern of small letters, capitals and digits; all else stays.

    With ``fold``, letters are permuted as small ones and get their case back, so values that differ in
    case only stay linked.
    """
    shown, value = value, "".join(c.lower() if "A" <= c <= "Z" else c for c in value) if fold else value
    radix = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in value]
    base = ["0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in value]
    rank, n = 0, 1
    for c, r, b in zip(value, radix, base):
        rank = rank * r + (ord(c) - ord(b))
        n *= r
    rank = permute(rank, n, key, tweak + "".join(base).encode(), back)
    out = []
    for r, b, c in zip(reversed(radix), reversed(base), reversed(shown)):
        rank, digit = divmod(rank, r)
        new = chr(ord(b) + digit)
        out.append(new.upper() if fold and "A" <= c <= "Z" else new)
    return "".join(reversed(out))


def _email(value: str, key: bytes, back: bool) -> str | None:
    """Name and host labels are permuted; the last two labels of the domain stay. Case stays and counts for nothing."""
    name, _, domain = value.rpartition("@")
    labels = domain.split(".")
    hosts, rest = ".".join(labels[:-2]), ".".join(labels[-2:])
    name = _characters(name, key, b"name", back, fold=True)
    return f"{name}@{_characters(hosts, key, b'host', back, fold=True)}.{rest}" if hosts else f"{name}@{rest}"


def _secret(value: str, key: bytes, back: bool) -> str | None:
    return _characters(value, key, b"secret", back)


#: Kinds in the order they are tried at a place. A group named after the kind holds the value.
KINDS = {
    "email": (r"(?<![\w.+%-])(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", _email),
    "secret": (r"(?<![A-Za-z0-9])AKIA(?P<secret>[0-9A-Z]{16})(?![A-Za-z0-9])", _secret),
    "entry": (r"(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<entry>[A-Za-z0-9_\-]{8,})", _secret),
    "iban": (r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![\d./-])(?P<date>\d{4}([-./])\d{2}\2\d{2}|\d{2}([-./])\d{2}\3\d{4})(?![\d/-])", _date),
    "short date": (r"(?<![\w./-])(?P<short_date>(?:[1-9]|[123]\d)\.(?:[1-9]|1[0-2])\.\d{4}|(?:[1-9]|1[0-2])/(?:[1-9]|[123]\d)/\d{4})(?![\w/-]|\.\d)", _short_date),
    "written date": (rf"(?<![\w./-])(?P<written_date>{_ANY_WRITTEN})(?!\w)", _written_date),
    "ipv6": (r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:]|\.\d)", _address6),
    "ipv4": (r"(?<![\d.])(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)", _address),
    "ssn": (r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])", _ssn),
    "phone": (r"(?<![\d+])(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\d)", _phone),
    "foreign phone": (r"(?<![\w+])(?P<foreign_phone>\+[1-9]\d{0,2}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,12})){1,6})(?!\d)", _foreign_phone),
    "French phone": (r"(?<![\d.+-])(?P<French_phone>0[1-9](?: \d\d){4}|0[1-9](?:\.\d\d){4})(?![ .]?\d)", _french_phone),
    # All groups of digits that stand together; see ``_card_spans``.
    "card": (r"(?<!\d)(?P<card>\d(?:[ -]?\d){12,})(?!\d)", _card),
}


_PATTERNS = {kind: re.compile(pattern, re.ASCII) for kind, (pattern, _) in KINDS.items()}
_TELLTALE = re.compile(r"\d|@|[=:]")
_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 6, 4), (4, 4, 4, 1), (4, 3, 3, 3)}


def _card_spans(text: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Every run of whole groups with 13 to 19 digits of a stretch: those in the shape of a card first, then long before short.

    A card may stand beside other numbers (a date, a security code), so the stretch as a whole says nothing.
    """
    groups = [m.span() for m in re.compile(r"\d+", re.ASCII).finditer(text, first, last)]
    if first and text[first - 1] == ".":
        groups = groups[1:]
    found = []
    for i, (a, _) in enumerate(groups):
        n, shape = 0, []
        for c, b in groups[i:]:
            n += b - c
            shape.append(b - c)
            if n > 19:
                break
            if n >= 13:
                found.append((len(shape) > 1 and tuple(shape) not in _SHAPES, text[a] not in "23456", -n, a, b))
    for *_, a, b in sorted(found):
        yield a, b


def _spans(kind: str, text: str) -> Iterator[tuple[int, int]]:
    for m in _PATTERNS[kind].finditer(text):
        if kind == "card":
            yield from _card_spans(text, *m.span(kind))
        else:
            yield m.span(kind.replace(" ", "_"))


def pseudonymize(
    text: str | None, key: bytes, back: bool = False, memory: dict[tuple[str, str], str | None] | None = None
) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with every valid value replaced, and the spans ``(start, end, kind)`` of the values.

    Spans are in characters of the result. An earlier kind wins where two overlap. Null stays null.
    ``memory`` holds pseudonyms of recurring values; it is emptied when it has ``MEMORY`` entries.
    """
    if not text or not _TELLTALE.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order
    memory = {} if memory is None else memory
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        for a, b in _spans(kind, text):
            at = bisect(taken, (a, b))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            value = (kind, text[a:b])
            if value not in memory:
                if len(memory) >= MEMORY:
                    memory.clear()
                memory[value] = KINDS[kind][1](text[a:b], key, back)
            new = memory[value]
            if new is not None:
                found.append((a, b, kind, new))
                taken.insert(at, (a, b))
    if not found:
        return text, []
    found.sort()
    out, spans, last, size = [], [], 0, 0
    for a, b, kind, new in found:
        out += [text[last:a], new]
        size += a - last
        spans.append((size, size + len(new), kind))
        size += len(new)
        last = b
    out.append(text[last:])
    return "".join(out), spans


def restore(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    """The text before ``pseudonymize``, by its spans: exact also where numbers beside a card could be part of one."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], KINDS[kind][1](text[a:b], key, True)]
        last = b
    return "".join([*out, text[last:]])


def pseudonymize_documents(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``pii_spans`` added; one narrow stage.

    ``pii_spans`` is an array of ``(start, end, kind)`` in characters of the new text, empty where
    nothing was found; a column of that name is replaced. All other columns and all rows are kept.
    """
    rows = docs.drop("pii_spans")
    names = rows.columns
    at = names.index(text)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            # Few rows at a time: two copies of the texts are held, not of the whole batch.
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                done = [pseudonymize(x, key, memory=memory) for x in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], names=[*names, "pii_spans"])

    schema = rows.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{fields}, pii_spans array<struct<start:int,end:int,kind:string>>")
