"""Operator 7: format-preserving pseudonyms for personal data.

Values that pass their format's validation (card numbers: Luhn; IBAN: mod 97;
dates: the calendar; IPv4 and IPv6 addresses: their octets or groups; phone
numbers, national ids, e-mail addresses and secrets: their pattern) are replaced by a keyed
permutation of the format's own domain: a Feistel network over the value's
index, with cycle walking to the domain's size.  The map is a bijection
without fixed points, so equal values stay equal in every document, distinct
values stay distinct, and the holder of the key can invert it.

A match may have swallowed text that follows the value.  An IBAN is read in
its country's length; cards and phone numbers are tried at every end of a
group of digits, the longest first.  A card keeps its Luhn sum at the other
parity, so digits after or before it read the same with its pseudonym.

A secret is what follows a key word (password, token, ...) and = or :, in
quotes, or without them if it holds a digit and a letter (among its first 512
characters) or follows =; what follows "password is" or "bearer" and holds
both; and keys that a prefix marks (AKIA, ghp_).  IBANs in small letters or
with hyphens get the pseudonym of the same IBAN in its plain form, addresses
in an IPv6 form that ends in an IPv4 address that of the IPv4 address.

Patterns begin at the start of a run of their characters and look ahead a
bounded way, so time is linear in the text, whatever it holds.

A null text stays null with no values; an empty text stays empty.  Rows are
independent: repeated rows get equal results.  Other columns pass unchanged;
where the table has a column ``n_values`` or ``value_kinds``, the new one gets
underscores behind its name.
"""

from __future__ import annotations

import datetime
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8

#: Alphabets that a character of a value may stand in.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")
#: Lengths of IBANs by country (other countries: the whole match).
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
        "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        seed = tweak + b"|" + bytes([k]) + bits.to_bytes(4, "big") + half.to_bytes(size, "big")
        out = b""
        while len(out) < size:
            out += hmac.digest(self.key, seed + len(out).to_bytes(4, "big"), "sha256")
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            for k in range(ROUNDS):
                if back:
                    a, b = b ^ self._round(tweak, ROUNDS - 1 - k, a, bits), a
                else:
                    a, b = b, a ^ self._round(tweak, k, b, bits)
            x = a << bits | b
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """A bijection of range(n) that leaves no value in place (for n > 1): one step along a keyed cycle."""
        return self._walk((self._walk(x, n, tweak, True) + (-1 if back else 1)) % n, n, tweak, False)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(pattern: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``pattern``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Finds and replaces the values of one text."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.known: dict[tuple[str, str], str | None] = {}

    def _number(self, digits: str, tweak: bytes) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), tweak + b"%d" % len(digits), self.back)).zfill(len(digits))

    def _mixed(self, text: str, tweak: bytes, classes=CLASSES) -> str:
        """Each character within its class; characters of no class stay and key the permutation."""
        value, size, kept, of = 0, 1, [], []
        for c in text:
            cls = next((k for k in classes if c in k), None)
            of.append(cls)
            kept.append(c if cls is None else classes.index(cls))
            if cls:
                value, size = value * len(cls) + cls.index(c), size * len(cls)
        if size < 2:
            return text
        value = self.feistel.permute(value, size, tweak + repr(kept).encode(), self.back)
        out = []
        for c, cls in zip(reversed(text), reversed(of)):
            if cls:
                value, k = divmod(value, len(cls))
                c = cls[k]
            out.append(c)
        return "".join(reversed(out))

    def _day(self, y: int, m: int, d: int) -> datetime.date:
        day = datetime.date(y, m, d).toordinal()
        if FIRST_DAY <= day <= LAST_DAY:
            return datetime.date.fromordinal(FIRST_DAY + self.feistel.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", self.back))
        before, all_days = FIRST_DAY - 1, datetime.date.max.toordinal()
        index = day - 1 if day < FIRST_DAY else before + day - LAST_DAY - 1
        index = self.feistel.permute(index, before + all_days - LAST_DAY, b"far date", self.back)
        return datetime.date.fromordinal(index + 1 if index < before else index - before + LAST_DAY + 1)

    # One method per kind: the replacement, or None where validation fails.

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        out = self._mixed(local, b"email@" + domain.lower().encode())
        return f"{out}@{domain}" if out != local else f"{out}@{self._mixed(domain, b'email domain')}"

    def secret(self, s: str) -> str | None:
        for alphabet in HEX:
            if len(s) >= 16 and all(c in alphabet for c in s):
                return self._mixed(s, b"hex", (alphabet,))
        return self._mixed(s, b"secret")

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # The check digit of a number that the card begins is the same for the pseudonym; a leading 0 would make it a phone number.
        new = digits
        while True:
            payload = self._number(new[:-1], b"card")
            new = payload + luhn_digit(payload)
            if luhn_digit(new) == luhn_digit(digits) and len(set(new)) > 1 and (new[0] == "0") == (digits[0] == "0"):
                return _fill(s, new)

    def iban(self, s: str) -> str | None:
        if s[0].islower():
            new = self.iban(s.upper()) if s[:2].upper() in IBAN_LENGTHS and len(re.sub("[ -]", "", s)) == IBAN_LENGTHS[s[:2].upper()] else None
            return new and new.lower()
        plain = re.sub("[ -]", "", s)
        as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = plain[4:]
        while True:
            body = self._mixed(body, b"iban" + plain[:2].encode())
            it = iter(plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02d}" + body)
            new = "".join(c if c in " -" else next(it) for c in s)
            # A value of another length than its country's must not begin with one of that length.
            short = re.sub("[ -]", "", new[: self._ends("iban", new, 0, len(new))[0]])
            if len(short) == len(plain) or as_number(short[4:] + short[:4]) % 97 != 1:
                return new

    def phone(self, s: str) -> str | None:
        head = re.match(r"\(\+\d{1,3}\)|00[1-9]\d{0,2}(?=[ .-])|0(?=[1-9]\d{8}\Z)|\+\d{1,3}(?=[\s.(-])|0(?=\d[ .-]\d\d[ .-])|\(?0(?=\d{1,4}[) /-])", s)
        rest = s[head.end() if head else 0 :]
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 14:
            return None
        bare, digits = head is not None and rest == digits and head[0] == "0", self._number(digits, b"phone")
        while bare and digits[0] == "0":  # 00 would begin an international number
            digits = self._number(digits, b"phone")
        return s[: len(s) - len(rest)] + _fill(rest, digits)

    def national_id(self, s: str) -> str | None:
        area, group, serial = s[:3], s[4:6], s[7:]
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        n = self.feistel.permute((areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1, len(areas) * 99 * 9999, b"national id", self.back)
        return f"{areas[n // 9999 // 99]:03d}{s[3]}{n // 9999 % 99 + 1:02d}{s[6]}{n % 9999 + 1:04d}"

    bare_secret = said_secret = bearer_secret = marked_secret = secret

    def ipv6(self, s: str) -> str | None:
        """The groups that are written, each in its own letters and length."""
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return None
        groups = [g for g in s.split(":") if g]
        if not groups or (len(groups) < 3 and not any(c.isdigit() for c in s)):
            return None  # "a::b" is rather a name in a program
        upper = any(c in "ABCDEF" for c in s)
        if upper and any(c in "abcdef" for c in s):
            return None
        n, tweak = sum(map(len, groups)), b"ipv6" + re.sub(r"\w", "h", s).encode()
        value = int("".join(groups), 16)
        while True:  # capital letters stay capital: the pseudonym has one, too
            value = self.feistel.permute(value, 16**n, tweak + b"ABC" * upper, self.back)
            text = f"{value:0{n}X}" if upper else f"{value:0{n}x}"
            it = iter(text)
            new = "".join(c if c == ":" else next(it) for c in s)
            if (any(map(str.isalpha, text)) or not upper) and (len(groups) > 2 or any(map(str.isdigit, text))):
                return new

    def ipv6_mapped(self, s: str) -> str | None:
        """An IPv6 address that ends in an IPv4 address: the latter's own pseudonym, and prefixes that are no fixed ones group by group."""
        head, _, tail = s.rpartition(":")
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return None
        if head.lower() not in self.MAPPED:
            groups = "".join(g for g in head.split(":"))
            it = iter(self._mixed(groups.lower(), b"ipv6 head" + re.sub(r"\w", "h", head).encode(), HEX[:1]))
            head = "".join(c if c == ":" else next(it) for c in head)
            if head.lower() in self.MAPPED:
                return None
        return f"{head}:{self.ipv4(tail)}"

    def card_dots(self, s: str) -> str | None:
        return self.card(s)

    def low_iban(self, s: str) -> str | None:
        return self.iban(s)

    def short_date(self, s: str) -> str | None:
        """Year, month and day without leading zeros; one of them has one digit, also in the pseudonym."""
        y, m, d = map(int, re.split("[-/]", s))
        try:
            day = self._day(y, m, d)
        except ValueError:
            return None
        while day.month > 9 and day.day > 9:
            day = self._day(day.year, day.month, day.day)
        return f"{day.year:04d}{s[4]}{day.month}{s[4]}{day.day}"

    def named_date(self, s: str) -> str | None:
        """Day, English month and year in either order; letters' case, short names and leading zeros stay."""
        d, name, y = re.search(r"\b\d\d?\b", s)[0], re.search(r"[A-Za-z]+", s)[0], s[-4:]
        short = name.lower() not in self.MONTHS
        month = next(k for k, m in enumerate(self.MONTHS, 1) if m.startswith(name.lower()))
        try:
            day = self._day(int(y), month, int(d))
        except ValueError:
            return None
        # "May" is read as a whole name, a day with a leading zero as one of a single digit.
        while (short and day.month == 5) or (d[0] == "0" and day.day > 9):
            day = self._day(day.year, day.month, day.day)
        new = self.MONTHS[day.month - 1][: 3 if short else None]
        new = new.upper() if name.isupper() else new if name.islower() else new.capitalize()
        number = f"{day.day:02d}" if d[0] == "0" else str(day.day)
        return re.sub(r"[A-Za-z]+", new, re.sub(r"\b\d\d?\b", number, s[:-4], count=1), count=1) + f"{day.year:04d}"

    def ipv4(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if any(x > 255 for x in parts):
            return None
        n = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ipv4", self.back)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def iso_date(self, s: str) -> str | None:
        try:
            return self._day(int(s[:4]), int(s[5:7]), int(s[8:])).strftime(f"%Y{s[4]}%m{s[7]}%d").zfill(10)
        except ValueError:
            return None

    def day_date(self, s: str) -> str | None:
        """Day first where that is a date, else month first; the same reading goes out."""
        a, b, y = (int(x) for x in re.split(r"[/.-]", s))
        sep = re.search(r"[/.-]", s)[0]
        for d, m, order in ((a, b, "dm"), (b, a, "md")):
            try:
                datetime.date(y, m, d)
            except ValueError:
                continue
            day = self._day(y, m, d)
            # A reading by month needs a day over 12, or the text would be read by day next time.
            while order == "md" and day.day <= 12:
                day = self._day(day.year, day.month, day.day)
            first, second = (day.day, day.month) if order == "dm" else (day.month, day.day)
            return f"{first:02d}{sep}{second:02d}{sep}{day.year:04d}"
        return None

    #: Prefixes of addresses that end in an IPv4 address.
    MAPPED = (":", "::ffff", "::ffff:0", "64:ff9b:")
    #: The months.
    MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    _MONTH = "(?:" + "|".join(f"(?i:{m[:3]}(?:{m[3:]})?)" for m in MONTHS) + ")"
    #: Words that name a secret.
    SECRET_WORDS = r"token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key"
    #: Tried in this order at each place.
    KINDS = {
        "secret": rf"""(?i:{SECRET_WORDS})["']?\s*[=:]\s*["'](?P<secret>[^"'\s]{{6,}})["']""",
        "bare_secret": rf"""(?i:{SECRET_WORDS})["']?(?:\s*=\s*|:\s*(?=[^\s"'<>,;]{{0,512}}\d)(?=[^\s"'<>,;]{{0,512}}[A-Za-z]))(?P<bare_secret>[^\s"'<>,;=][^\s"'<>,;]*[^\s"'<>,;.!?)\]}}]{{4,}})""",
        "said_secret": r"""(?<!\w)(?i:password|passwd|passphrase|pwd) (?i:is):? (?=[^\s"'<>,;]{0,512}\d)(?=[^\s"'<>,;]{0,512}[A-Za-z])(?P<said_secret>[^\s"'<>,;=][^\s"'<>,;]*[^\s"'<>,;.!?)\]}]{4,})""",
        "bearer_secret": r"(?<!\w)(?i:bearer) (?=[\w.~+/-]{0,512}\d)(?=[\w.~+/-]{0,512}[A-Za-z])(?P<bearer_secret>[A-Za-z0-9_.~+/-]{15,}[A-Za-z0-9_~+/-])",
        "marked_secret": r"(?<!\w)(?:A[KS]IA(?=[A-Z0-9]{16}(?!\w))|gh[pousr]_(?=[A-Za-z0-9]{36}))(?P<marked_secret>[A-Za-z0-9]{16,255})(?!\w)",
        "email": r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
        "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b)",
        "low_iban": r"(?P<low_iban>(?<![\w-])[a-z]{2}\d{2}(?:[ -]?[a-z0-9]){11,30}\b)",
        "ipv6_mapped": r"(?P<ipv6_mapped>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,6}\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))",
        "ipv6": r"(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d|[0-9A-Fa-f]*::|(?:[0-9A-Fa-f]+:){7})(?:[0-9A-Fa-f]{1,4}:){1,7}(?::(?:[0-9A-Fa-f]{1,4}:){0,6})?(?:[0-9A-Fa-f]{1,4})?(?![\w:]|\.\d)|(?<![\w:.])::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d))",
        "ipv4": r"(?P<ipv4>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))",
        "iso_date": r"(?P<iso_date>(?<![\d-])\d{4}[-/.]\d{2}[-/.]\d{2}(?![\d-]))",
        "short_date": r"(?P<short_date>(?<![\d/-])(?:19|20)\d\d(?:-(?:[1-9]-[1-9]\d?|[1-9]\d-[1-9])|/(?:[1-9]/[1-9]\d?|[1-9]\d/[1-9]))(?![\d/-]))",
        "named_date": rf"(?P<named_date>(?<![\w.-])\d{{1,2}} {_MONTH} (?:19|20)\d\d(?!\w)|(?<!\w){_MONTH} \d{{1,2}},? (?:19|20)\d\d(?!\w))",
        "day_date": r"(?P<day_date>(?<![\d/.-])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.|-\d{1,2}-)\d{4}(?![\d/-]))",
        "national_id": r"(?P<national_id>(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-]))",
        "card_dots": r"(?P<card_dots>(?<![\d.-])\d{4}(?:\.\d{4}){3}(?![\d-]|\.\d))",
        "phone": r"(?P<phone>\(\+\d{1,3}\)[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])00[1-9]\d{0,2}[ .-]\d{1,4}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])0[1-9]\d{8}(?![\w-]|\.\d)|\+\d{1,3}[ .-]?(?:\(\d\)[ .-]?)?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])0\d(?:[ .-]\d{2}){4}(?!\d|[.-]\d)|(?<![\w.-])(?:0\d{2,4}[ /-]|\(0\d{1,4}\) ?)\d{3,4}(?:[ -]?\d{2,4}){1,2}(?![\w-]|\.\d)|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))",
        "card": r"(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d))",
    }
    PATTERN = re.compile("|".join(KINDS.values()))
    CARD = re.compile(KINDS["card"])
    HINT = re.compile(r"[\d@]|[=:]\s*[\"']|::|(?i:%s)[\"']?\s*=" % SECRET_WORDS)

    @staticmethod
    def _ends(kind: str, text: str, a: int, b: int) -> list[int]:
        """Where a value that the match ``a`` to ``b`` begins with may end, in the order to try."""
        if kind in ("iban", "low_iban"):
            left = IBAN_LENGTHS.get(text[a : a + 2].upper(), 0)
            for end in range(a, b):
                left -= text[end] not in " -"
                if left == 0 and (end + 1 == b or text[end + 1] in " -"):
                    return [end + 1, b] if end + 1 < b else [b]
        if kind in ("card", "phone"):
            return [b, *(e for e in range(b - 1, a, -1) if text[e - 1].isdigit() and not text[e].isdigit())]
        return [b]

    def _known(self, kind: str, s: str) -> str | None:
        key = kind, s
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = getattr(self, kind)(s)
        return self.known[key]

    def _read(self, kind: str, text: str, a: int, b: int) -> tuple[int, str] | None:
        """End and replacement of the value at ``a``."""
        for end in self._ends(kind, text, a, b):
            new = self._known(kind, text[a:end])
            if new is not None:
                return None if kind == "card" and end < b and self._longer_card(text, a, end) else (end, new)
        return None

    def _longer_card(self, text: str, a: int, b: int) -> bool:
        """Whether a card of more digits begins at a later group of ``a`` to ``b``: the shorter one is a chance hit across its head."""
        digits = lambda x, y: sum(c.isdigit() for c in text[x:y])
        least = digits(a, b)
        for k in range(a + 1, b):
            if text[k].isdigit() and not text[k - 1].isdigit() and (m := self.CARD.match(text, k)):
                if any(digits(k, e) > least and self._known("card", text[k:e]) is not None for e in self._ends("card", text, k, m.end())):
                    return True
        return False

    def text(self, text: str) -> tuple[str, int, list[str]]:
        """The text with its values replaced, their number, and the kinds found."""
        if not self.HINT.search(text):
            return text, 0, []
        out, at, pos, kinds, n = [], 0, 0, set(), 0
        while m := self.PATTERN.search(text, pos):
            kind = m.lastgroup
            a, b = m.span(kind)
            read = self._read(kind, text, a, b)
            if read is None:
                pos = m.start() + 1
                while pos < len(text) and text[pos - 1].isdigit() and text[pos].isdigit():
                    pos += 1
                continue
            b, new = read
            out += [text[at:a], new]
            at = pos = b
            kinds.add(kind)
            n += 1
        return ("".join(out) + text[at:], n, sorted(kinds)) if n else (text, 0, [])


def pseudonyms(text: Column, key: bytes, back: bool = False) -> Column:
    """struct(text, n, kinds): the text with pseudonyms, the number of values replaced, and their kinds."""

    @F.arrow_udf("text string, n int, kinds string")
    def run(col: pa.Array) -> pa.Array:
        own = Pseudonyms(key, back)
        texts, counts, kinds = [], [], []
        for s in col:
            s = s.as_py()
            new, n, found = own.text(s) if s else (s, 0, [])
            texts.append(new)
            counts.append(n)
            kinds.append(",".join(found))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=["text", "n", "kinds"])

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; adds ``n_values`` and ``value_kinds`` if ``counts``."""
    name = free_name("_pseudonyms", docs.columns)
    out = docs.withColumn(name, pseudonyms(F.col(text_col), key)).withColumn(text_col, F.col(name)["text"])
    if counts:
        out = out.withColumn(free_name("n_values", docs.columns), F.col(name)["n"]).withColumn(free_name("value_kinds", docs.columns), F.col(name)["kinds"])
    return out.drop(name)
