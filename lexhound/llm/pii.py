"""Format-preserving pseudonyms of personal data by keyed Feistel permutations."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from datetime import date
from ipaddress import IPv6Address

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .feistel import Feistel, walk

#: Values whose pseudonyms one Python worker remembers; beyond that it starts anew.
REMEMBERED = 100_000
#: Texts without any of these hold nothing to replace.
_PREFILTER = r"[0-9@]|[=:][ \t]*[\"']?[A-Za-z0-9+/_-]{16}|(?i:passw|passphrase|pwd)|gh[pousr]_|github_pat_|AKIA|ASIA|PRIVATE KEY"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: Of longer values so many characters at a time are permuted.
_PIECE = 4096
# Every pattern starts at a border and repeats boundedly or possessively, so a text of any kind is scanned in linear time.
_EMAIL = re.compile(r"(?<![\w.%+&~-])[\w%+&~-][\w.%+&~'-]*+@(?:[^\W_](?:[\w-]{0,62})\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_IP6 = re.compile(r"(?<![\w.:])(?=[^\s]{0,38}[0-9])(?:(?:[0-9a-f]{1,4}:){1,7}(?::?[0-9a-f]{1,4}){1,7}|(?:[0-9A-F]{1,4}:){1,7}(?::?[0-9A-F]{1,4}){1,7})(?![\w:]|\.\d)")
_CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|(?=[ .-]?\d))(?:[ .-]?\d{1,4}){2,6}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,7})(?!\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOW_IBAN = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}\d{2}[a-z0-9]{11,30}(?![A-Za-z0-9])")
_ISO_DATE = re.compile(r"(?<![\d./-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d]|[./-]\d)")
_DAY_DATE = re.compile(r"(?<![\d./-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?![\d]|[./-]\d)")
_VALUE, _ASSIGNED = r"(?:[A-Za-z0-9+/_-]|\.(?=[A-Za-z0-9+/_-]))", r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
_NAME = r"(?i)(?<![A-Za-z0-9])(?:[a-z]{1,20}[_-]){0,3}"
_SECRET = re.compile(rf"{_NAME}(?:token|secret|api[_-]?key|apikey|access[_-]?key|private[_-]?key|bearer){_ASSIGNED}(?={_VALUE}{{16}})({_VALUE}++)")
# After a colon, where prose may follow, a password holds a digit.
_PASSWORD = re.compile(
    rf"{_NAME}(?:password|passwd|passphrase|pwd)[\"']?[ \t]{{0,4}}(?:=[ \t]{{0,4}}[\"']?|:[ \t]{{0,4}}[\"']?(?=[^\s\"'<>,;&=]*[0-9]))(?=[^\s\"'<>,;&=]{{4}})([^\s\"'<>,;&=]*[A-Za-z0-9])"
)
# Tokens that their beginning gives away, which stays.
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|gh[pousr]_(?=[A-Za-z0-9]{36})|github_pat_(?=\w{22})|xox[abprs]-(?=[A-Za-z0-9-]*\d)(?=[A-Za-z0-9-]{10})"
    r"|(?:sk|pk|rk)_(?:live|test)_(?=[A-Za-z0-9]{16})|(?:sk-|glpat-)(?=[A-Za-z_-]*\d)(?=[\w-]{20})|AIza(?=[\w-]{35})|eyJ(?=[\w-]{8,}+\.[\w-]{8})|[Bb]earer (?=[A-Za-z_./+~-]*\d)(?=[\w./+~-]{16}))([\w/+~-]+(?:\.[\w/+~-]+)*)"
)
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END")
# Runs of groups, in which cards and IBANs are looked for group by group, and what a card or an IBAN looks like.
_RUNS = {"card": re.compile(r"(?<![\d.+-])\d+(?:[ -]\d+)*+"), "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]++(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+")}
_GROUP = re.compile(r"[A-Z0-9]+")
_SHAPES = {
    "card": re.compile(r"\d{13,19}|(?=(?:[ -]?\d){13,19}$)(?:\d{4}(?:[ -]\d{3,7}){2,4}|\d{6}[ -]\d{7,13})"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
}
#: Groups of an IBAN in its longest form.
_MOST_GROUPS = 9
_HEX = re.compile(r"[0-9a-fA-F]+")


def _secret_kind(text: str) -> str | None:
    """How a value is permuted: as a hexadecimal number, or letter by letter. None: it isn't one."""
    digit = any("0" <= c <= "9" for c in text)
    if _HEX.fullmatch(text) and not text.isdigit() and text in (text.lower(), text.upper()):
        return "hex" if digit or len(text) >= 16 else None
    return "letters" if digit else None


def _password_kind(text: str) -> str:
    return _secret_kind(text) or "plain"


_ALPHABETS: dict[str, str] = {}


def _alphabet(c: str) -> str:
    """The characters that c may become: digits, ASCII letters of its case, or letters of its case near it in its script; else c alone."""
    got = _ALPHABETS.get(c)
    if got is None:
        if "0" <= c <= "9":
            got = "0123456789"
        elif c.isascii():
            got = "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else c
        elif c.isalpha():
            low = ord(c) & ~31
            near = (chr(k) for k in range(low, low + 32))
            got = "".join(x for x in near if x.isalpha() and not x.isascii() and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))
        else:
            got = c
        _ALPHABETS[c] = got
    return got


def luhn_digit(body: str) -> int:
    """The check digit that makes body valid."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = ord(c) - 48
        if k % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return -total % 10


def _mod97(text: str) -> int:
    n = 0
    for c in text:
        d = int(c, 36)
        n = (n * (10 if d < 10 else 100) + d) % 97
    return n


def _ip6_valid(text: str) -> bool:
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) >= 4


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card_valid(text: str) -> bool:
    d = _digits(text)
    return luhn_digit(d[:-1]) == int(d[-1]) and len(set(d)) > 1


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


_VALID = {"card": _card_valid, "iban": _iban_valid}


def _first(kind: str, run: str) -> tuple[int, int] | None:
    """The valid card or IBAN of whole groups of run that ends first, of those the longest."""
    groups, shape, valid = [g.span() for g in _GROUP.finditer(run)], _SHAPES[kind], _VALID[kind]
    for j, (_, b) in enumerate(groups):
        for a, _ in groups[max(0, j + 1 - _MOST_GROUPS) : j + 1]:
            if shape.fullmatch(run, a, b) and valid(run[a:b]):
                return a, b
    return None


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


class Pseudonymiser:
    """Finds validated values in a text and replaces each by another of its format; backwards undoes that.

    A value's pseudonym depends on the key, its kind and its normalised form alone, so equal values stay linked across
    documents, and within a kind and a length different values stay different. Only where a card or an IBAN would, with
    the numbers right before it, read as one of other bounds, which could not be undone, it takes the next that does not. What doesn't validate is left as it is.
    """

    def __init__(self, key: bytes, backwards: bool = False):
        f = Feistel(key)
        self._step = f.restore if backwards else f.permute
        self._memory: dict[tuple[str, ...], str] = {}
        #: In order of precedence where two overlap.
        self.kinds: list[tuple[str, re.Pattern, int, Callable[[str], str | None]]] = [
            ("secret", _SECRET, 1, self.secret), ("secret", _PASSWORD, 1, self.password), ("secret", _TOKEN, 1, self.token), ("secret", _PEM, 1, self.token), ("email", _EMAIL, 0, self.email), ("iban", _IBAN, 0, self.iban), ("iban", _LOW_IBAN, 0, self.low_iban), ("ip", _IP6, 0, self.ip6), ("date", _ISO_DATE, 0, self.iso_date),
            ("date", _DAY_DATE, 0, self.day_date), ("ip", _IP, 0, self.ip), ("ssn", _SSN, 0, self.ssn), ("card", _CARD, 0, self.card), ("phone", _PHONE, 0, self.phone),
        ]

    def _map(self, kind: str, value: int, size: int) -> int:
        return self._step(value, size, kind.encode())

    def letters(self, kind: str, text: str) -> str:
        """Digits become digits, letters letters of the same case and script; other characters stay."""
        if len(text) > _PIECE:
            return "".join(self.letters(kind, text[i : i + _PIECE]) for i in range(0, len(text), _PIECE))
        value, size = 0, 1
        for c in text:
            own = _alphabet(c)
            size *= len(own)
            value = value * len(own) + own.index(c)
        value, out = self._map(kind, value, size), []
        for c in reversed(text):
            own = _alphabet(c)
            value, d = divmod(value, len(own))
            out.append(own[d])
        return "".join(reversed(out))

    def _number(self, kind: str, digits: str) -> str:
        n = len(digits)
        return str(self._map(f"{kind}{n}", int(digits), 10**n)).zfill(n) if n else ""

    def secret(self, text: str) -> str | None:
        own = _secret_kind(text)
        if own is None:
            return None
        # what reads as the other kind would not be undone
        if own == "letters":
            return walk(lambda t: self.letters("secret", t), text, lambda t: _secret_kind(t) == own)
        got = walk(self._hex, text.lower(), lambda t: _secret_kind(t) == own)
        return got.upper() if text != text.lower() else got

    def password(self, text: str) -> str:
        own = _password_kind(text)
        if own != "hex":
            return walk(lambda t: self.letters("secret", t), text, lambda t: _password_kind(t) == own)
        return self.secret(text)

    def token(self, text: str) -> str:
        return self.letters("secret", text)

    def _hex(self, text: str) -> str:
        pieces = [text[i : i + _PIECE] for i in range(0, len(text), _PIECE)]
        return "".join(f"{self._map(f'hex{len(p)}', int(p, 16), 16 ** len(p)):0{len(p)}x}" for p in pieces)

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self.letters('mail', local)}@{self.letters('host', host)}.{top}"

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = self._map("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def ip6(self, text: str) -> str | None:
        """Whole, or with one "::"; of at least four written groups. Each group keeps its length."""
        if not _ip6_valid(text):
            return None
        upper = text != text.lower()
        digits = text.replace(":", "").lower()

        def whole(value: int) -> str:
            it = iter(f"{value:0{len(digits)}x}")
            got = "".join(c if c == ":" else next(it) for c in text)
            return got.upper() if upper else got

        def allowed(value: int) -> bool:
            got = whole(value)
            return (got != got.lower()) == upper and _IP6.fullmatch(got) is not None

        return whole(walk(lambda v: self._map(f"ip6{len(digits)}", v, 16 ** len(digits)), int(digits, 16), allowed))

    def card(self, text: str, allowed: Callable[[str], bool] | None = None) -> str | None:
        if not _card_valid(text):
            return None
        if allowed is None:
            alone = _first("card", text)
            allowed = lambda t: _first("card", t) == alone
        d = _digits(text)
        n = len(d)

        def ok(v: int) -> bool:
            got = self._card(d[0], v, n)
            return len(set(got)) > 1 and allowed(_refill(text, got))

        return _refill(text, self._card(d[0], walk(lambda v: self._map(f"card{n}", v, 10 ** (n - 2)), int(d[1:-1]), ok), n))

    @staticmethod
    def _card(first: str, value: int, n: int) -> str:
        body = first + str(value).zfill(n - 2)
        return body + str(luhn_digit(body))

    def ssn(self, text: str) -> str | None:
        def valid(v: int) -> bool:
            area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(_digits(text))
        if not valid(value):
            return None
        return _refill(text, str(walk(lambda v: self._map("ssn", v, 10**9), value, valid)).zfill(9))

    def phone(self, text: str) -> str | None:
        head = re.match(r"\+(?:1(?=\D*\d{3}\D*\d{3}\D*\d{4}$)|\d{1,3})|0(?=\d{2,4}[ /-]\d{5,7}$)", text)
        kept = head.group() if head else ""
        d = _digits(text[len(kept) :])
        if not 7 <= len(d) <= 14:
            return None
        return kept + _refill(text[len(kept) :], self._number("phone" + kept, d))

    def iban(self, text: str, allowed: Callable[[str], bool] | None = None) -> str | None:
        if not _iban_valid(text):
            return None
        if allowed is None:
            alone = _first("iban", text)
            allowed = lambda t: _first("iban", t) == alone
        plain = text.replace(" ", "")

        def whole(rest: str) -> str:
            it = iter(plain[:2] + f"{98 - _mod97(rest + plain[:2] + '00'):02d}" + rest)
            return "".join(c if c == " " else next(it) for c in text)

        return whole(walk(lambda r: self.letters("iban" + plain[:2], r), plain[4:], lambda r: allowed(whole(r))))

    def low_iban(self, text: str) -> str | None:
        got = self.iban(text.upper())
        return got and got.lower()

    def _grouped(self, kind: str, text: str, found: list[tuple[int, int, str, str]]) -> None:
        """Adds to found the cards or IBANs of whole groups of text, other numbers beside them or not.

        What ends first is taken first, and its pseudonym must be what is found first in its place, so that backwards
        finds the same: what follows doesn't count, and what is before it and wasn't taken stays as it is.
        """
        make = self.card if kind == "card" else self.iban
        for m in _RUNS[kind].finditer(text):
            if m.end() - m.start() < 13:
                continue
            start, end = m.span()
            if kind == "card" and text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit():
                end = max(start, *(g.start() for g in _GROUP.finditer(text, start, end)))
            free, at = [], bisect_left(found, (start,))
            at -= at > 0 and found[at - 1][1] > start
            while at < len(found) and found[at][0] < end:
                free.append((start, found[at][0]))
                start, at = found[at][1], at + 1
            for a, b in [*free, (start, end)]:
                while b - a >= 13 and (place := _first(kind, text[a:b])):
                    i, j = place
                    before, value = text[a : a + i], text[a + i : a + j]
                    key = (kind, before, value)
                    new = self._memory.get(key)
                    if new is None:
                        new = self._memory[key] = make(value, lambda t, before=before, place=place: _first(kind, before + t) == place)
                    found.insert(bisect_left(found, (a + i,)), (a + i, a + j, kind, new))
                    a += j

    def _date(self, kind: str, day: int, allowed=lambda v: True) -> date:
        base = FIRST_DAY
        return date.fromordinal(walk(lambda v: self._map(kind, v, LAST_DAY - base + 1), day - base, lambda v: allowed(date.fromordinal(v + base))) + base)

    def iso_date(self, text: str) -> str | None:
        y, m, d = (int(x) for x in re.split(r"[-/.]", text))
        day = _ordinal(y, m, d)
        if day is None:
            return None
        _, month, day_of = re.split(r"[-/.]", text)
        got = self._date("date", day, lambda x: _as_long(x.month, month) and _as_long(x.day, day_of))
        return f"{got.year:04d}{text[4]}{got.month:0{len(month)}d}{text[4]}{got.day:0{len(day_of)}d}"

    def day_date(self, text: str) -> str | None:
        """Day first where that is a date; else month first, and then it stays a date that can't be read day first."""
        first, second, year = re.split(r"[-/.]", text)
        a, b, y, mark = int(first), int(second), int(year), text[len(first)]
        if (day := _ordinal(y, b, a)) is not None:
            got = self._date("date", day, lambda x: _as_long(x.day, first) and _as_long(x.month, second))
            return f"{got.day:0{len(first)}d}{mark}{got.month:0{len(second)}d}{mark}{got.year:04d}"
        if (day := _ordinal(y, a, b)) is not None:
            got = self._date("date-month-first", day, lambda x: x.day > 12 and _as_long(x.month, first))
            return f"{got.month:0{len(first)}d}{mark}{got.day:0{len(second)}d}{mark}{got.year:04d}"
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end (code points of the given text) of each value in order."""
        found: list[tuple[int, int, str, str]] = []  # in order of place; none overlaps another
        if len(self._memory) > REMEMBERED:
            self._memory.clear()
        digit = any(c in text for c in "0123456789")
        for kind, pattern, group, make in self.kinds:
            if not digit and kind not in ("secret", "email") or kind == "email" and "@" not in text:
                continue
            if kind in _RUNS:
                self._grouped(kind, text, found)
            for m in pattern.finditer(text):
                a, b = m.span(group)
                at = bisect_left(found, (a,))
                if at < len(found) and found[at][0] < b:  # it may end before what has been found
                    m = pattern.match(text, m.start(), found[at][0])
                    if m is None:
                        continue
                    a, b = m.span(group)
                if at and found[at - 1][1] > a:
                    continue
                key = (kind, make.__name__, m.group(group))
                new = self._memory.get(key)
                if new is None:
                    new = make(key[2])
                    if new is None:
                        continue
                    self._memory[key] = new
                found.insert(at, (a, b, kind, new))
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]) if found else text, [(k, a, b) for a, b, k, _ in found]


def _as_long(value: int, written: str) -> bool:
    """Whether value can be written with as many digits: any with two, to 9 with one."""
    return len(written) == 2 or value < 10


def _ordinal(y: int, m: int, d: int) -> int | None:
    try:
        day = date(y, m, d).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


_workers: dict[tuple[bytes, bool], Pseudonymiser] = {}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans: str = "pii_spans", backwards: bool = False) -> DataFrame:
    """docs with validated personal data in text_col replaced by pseudonyms, and a column of what was found where.

    Kinds: e-mail addresses (of letters of any script), IPv4 and IPv6 addresses, card numbers (Luhn), IBANs (mod 97), US
    social security numbers, telephone numbers, dates of 1900 to 2099, tokens that begin as those of well-known services
    do, PEM private keys, and the values of assignments to tokens and keys (of 16 characters and more) and to passwords
    (of 4 and more, after a colon with a digit). Values of tokens are of ASCII letters, digits and + / _ - and dots within
    them, as long as they may be, and hold a digit or are of 16 and more hexadecimal characters; passwords are of
    anything but blanks, quotes and < > , ; & =. Others stay. Each keeps its length
    (but for octets of addresses), punctuation and check digits. With backwards and the same key it is undone. Rows stay
    as they are otherwise, repeated ones too; null text stays null with no spans, empty text empty. A column of docs
    that is called as spans is replaced. The whole text is scanned, in a narrow pass without a shuffle.
    """
    keep = [c for c in docs.columns if c not in (text_col, spans)]
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields, T.StructField("spans", SPANS)])
    names = [f.name for f in schema]

    def run(batches):
        own = _workers.get((key, backwards))
        if own is None:
            own = _workers[(key, backwards)] = Pseudonymiser(key, backwards)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = batch.slice(i, 1024)
                texts = rows.column(len(keep))
                hit = pc.fill_null(pc.match_substring_regex(texts, _PREFILTER), False)
                where = pc.indices_nonzero(hit)
                got = [own.replace(t) for t in texts.take(where).to_pylist()]
                at = where.to_pylist()
                found: list = [[]] * rows.num_rows
                for k, (_, s) in zip(at, got, strict=True):
                    found[k] = [{"kind": a, "start": b, "end": c} for a, b, c in s]
                changed = pc.replace_with_mask(texts, hit, pa.array([t for t, _ in got], texts.type)) if got else texts
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keep))), changed, pa.array(found, _SPANS)], names)

    got = source.mapInArrow(run, schema)
    back = {c: f"k{n}" for n, c in enumerate(keep)} | {text_col: "text"}
    return got.select(*(F.col(back[c]).alias(c) for c in docs.columns if c in back), F.col("spans").alias(spans))
