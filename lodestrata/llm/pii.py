"""Personal data replaced by format-preserving pseudonyms.

Each value that passes its kind's validation is permuted within its format by a Feistel network keyed
with HMAC-SHA256 (ten rounds on a binary number, walking the cycle until the result is in the
format's domain). A permutation has no collisions, so different values stay different, and it depends
on key and value alone, so equal values stay linked across documents, machines and runs.

  card   13-19 digits that pass the Luhn check: leading digit kept, check digit computed anew
  iban   passes mod 97: country kept, letters and digits permuted in place, check digits anew
  ssn    ddd-dd-dddd with possible area, group and serial numbers
  phone  international form with + and 8-15 digits: country code 1 keeps possible area and exchange
         codes (and impossible ones impossible); others keep the first two digits
  ip     dotted quad
  date   possible dates of 1900-2099 as y-m-d, m/d/y or d/m/y (also with dots); a month or day of one
         digit becomes one of one digit
  email  the local part's letters and digits
  secret what follows token, password, api_key and the like: digits, hexadecimal (both digits and
         letters) or any other; each kind stays of its kind
  number other runs of 12-19 digits: all digits but the first; too long to be a count

A kind's domain always has the value itself: what doesn't hold for the value isn't asked of its
pseudonym. So the walk ends (at the value, at the latest) and is one-to-one within the domain.

The key is the caller's: who has it can undo every pseudonym.

Each text is worked on alone, whole: no shuffle. Texts without a digit and without @ are passed over.

Where numbers stand next to each other, the ends of digit groups within a match are tried: a card has
an issuer's first digits and length, an IBAN and a phone the length of their country where it has a
fixed one. Where nothing fits, the search goes on one group later.

Defined results: a null text stays null with nothing found; an empty text stays empty. Repeated rows
get equal results; all columns stay. Values that fail validation stay as they are.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, table

ROUNDS = 10
#: The key of the query, public and so for tests only.
EXAMPLE_KEY = b"an example, no secret"
FOUND = fields("text string, n_found long, kinds string")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS):
            if half <= 256:
                digest = hmac.digest(key, f"{tweak}|{size}|{r}|{b}".encode(), "sha256")
            else:  # as many bits as the half has
                seed = hmac.digest(key, f"{tweak}|{size:x}|{r}|{b:x}".encode(), "sha256")
                digest = hashlib.shake_256(seed).digest((half + 7) // 8)
            a, b = b, a ^ int.from_bytes(digest, "big") & mask
        value = a << half | b
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, tweak: str, fits) -> int:
    """permute() again and again until the result fits; a value that fits comes back at last, so it ends."""
    if not fits(value):
        raise ValueError("a value outside of its own domain")
    value = permute(value, size, key, tweak)
    while not fits(value):
        value = permute(value, size, key, tweak)
    return value


def luhn(digits: str) -> bool:
    d = list(map(int, digits[::-1]))
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _checked(body: str) -> str:
    """body and the digit that makes it pass the Luhn check."""
    return body + next(c for c in "0123456789" if luhn(body + c))


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 2
    whole = lambda v: _checked(f"{d[0]}{v:0{n}}")
    return _fill(text, whole(_walk(int(d[1:-1]), 10**n, key, f"card{n}{d[0]}", lambda v: len(set(whole(v))) > 1)))


def _number(text: str, key: bytes) -> str | None:
    d = _digits(text)
    n = len(d) - 1
    whole = lambda v: f"{d[0]}{v:0{n}}"
    fits = lambda v: len(set(whole(v))) > 1 and not (n >= 12 and luhn(whole(v)))
    v = int(d[1:])
    return _fill(text, whole(_walk(v, 10**n, key, f"number{len(d)}{d[0]}", fits))) if fits(v) else None


def _ssn(text: str, key: bytes) -> str | None:
    def fits(v):
        s = f"{v:09}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    v = int(_digits(text))
    return _fill(text, f"{_walk(v, 10**9, key, 'ssn', fits):09}") if fits(v) else None


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    n, fits = len(d) - 2, lambda v: True
    if d[0] == "1" and len(d) == 11:

        def possible(v):
            s = f"{v:010}"
            return s[0] in "23456789" and s[3] in "23456789"

        v = int(d[1:])
        if possible(v):
            return _fill(text, f"1{_walk(v, 10**10, key, 'phone1', possible):010}")
        fits = lambda v: not possible(int(f"{d[1]}{v:09}"))
    return _fill(text, d[:2] + f"{_walk(int(d[2:]), 10**n, key, f'phone{n}{d[:2]}', fits):0{n}}")


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(text: str, key: bytes) -> str | None:
    a, sep, b, _, c = re.split(r"([-/.])", text)
    order = "ymd" if len(a) == 4 else "mdy" if int(a) <= 12 else "dmy"
    parts = dict(zip(order, (a, b, c)))
    try:
        day = datetime.date(*(int(parts[k]) for k in "ymd"))
    except ValueError:
        return None
    if not 1900 <= day.year < 2100:
        return None
    at = lambda v: _DAY0 + datetime.timedelta(v)

    short = {k for k in "md" if len(parts[k]) == 1}
    plain = short and all(parts[k][0] != "0" for k in "md")  # written without filling zeros

    def fits(v):  # read back the same way, and as wide
        new = at(v)
        own = {"m": new.month, "d": new.day}
        return (order != "dmy" or new.day > 12) and all(own[k] < 10 if k in short else own[k] > 9 or not plain for k in "md")

    new = at(_walk((day - _DAY0).days, _DAYS, key, "date", fits))
    spelled = {"y": str(new.year), "m": f"{new.month:0{len(parts['m'])}}", "d": f"{new.day:0{len(parts['d'])}}"}
    return sep.join(spelled[k] for k in order)


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


#: Letters up to which a value is one number; longer ones are permuted letter by letter.
ONE_NUMBER = 128


@functools.lru_cache(1 << 16)
def _set_of(c: str) -> str:
    """The characters that c may become: ASCII letters of its case, digits of its script, or the letters of
    its case among the 128 code points around; '' if it stays."""
    if c < "\x80":
        return next((s for s in _SETS if c in s), "")
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    case = lambda x: (x.islower(), x.isupper())
    return "".join(x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if x.isalpha() and case(x) == case(c))


def _by_letters(value: np.ndarray, sizes: np.ndarray, key: bytes, tweak: str) -> np.ndarray:
    """A keyed permutation of vectors with value[k] < sizes[k]: each half in turn is shifted by what the other
    half and the key give (a Feistel network of additions), in time linear in the length."""
    value, half = value.copy(), len(value) // 2
    for r in range(ROUNDS):
        left, right = (slice(0, half), slice(half, None))[:: 1 if r % 2 else -1]
        seed = hmac.digest(key, f"{tweak}|{r}|".encode() + value[left].astype("<u4").tobytes(), "sha256")
        shift = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(value[right])), "<u8")
        value[right] = (value[right] + (shift % sizes[right].astype(np.uint64)).astype(np.int64)) % sizes[right]
    return value


def _in_place(text: str, key: bytes, tweak: str, sets=None, fits=lambda s: True) -> str:
    """Each character of a set becomes one of the same set. Up to ONE_NUMBER letters are one number of mixed
    radix, more are permuted as a vector; which of the two depends on the shape, which stays."""
    alphabet = [next((s for s in sets if c in s), "") for c in text] if sets else [*map(_set_of, text)]
    names = {s: "0aA"[_SETS.index(s)] if s in _SETS else "h" if sets else f"<{s[0]}>" for s in {*alphabet} - {""}}
    tweak = f"{tweak}|{''.join(names[s] if s else c for c, s in zip(text, alphabet))}"
    places = [k for k, s in enumerate(alphabet) if s]
    if len(places) > ONE_NUMBER:
        at = {s: {c: k for k, c in enumerate(s)} for s in names}
        value, sizes = np.array([at[alphabet[k]][text[k]] for k in places]), np.array([len(alphabet[k]) for k in places])
        while True:
            value, out = _by_letters(value, sizes, key, tweak), list(text)
            for k, v in zip(places, value.tolist()):
                out[k] = alphabet[k][v]
            new = "".join(out)
            if fits(new):  # the text itself fits, so the walk ends
                return new
    size, value = 1, 0
    for k in places:
        s = alphabet[k]
        value, size = value * len(s) + s.index(text[k]), size * len(s)

    def spelled(v):
        out = list(text)
        for k in reversed(places):
            v, at = divmod(v, len(alphabet[k]))
            out[k] = alphabet[k][at]
        return "".join(out)

    return spelled(_walk(value, size, key, tweak, lambda v: fits(spelled(v))))


def _email(text: str, key: bytes) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_in_place(local, key, 'email')}@{domain}"


def _hexadecimal(text: str) -> str | None:
    """The set of a text of hexadecimal digits in one case that has both digits and letters."""
    found = set(text)
    return next((s for s in _HEX if found <= set(s) and found & set(s[10:]) and found & set(s[:10])), None)


def _secret(text: str, key: bytes) -> str | None:
    if hexadecimal := _hexadecimal(text):
        return _in_place(text, key, "hex", (hexadecimal,), lambda t: _hexadecimal(t) is not None)
    return _in_place(text, key, "secret", fits=lambda t: _hexadecimal(t) is None)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat) != 1 or not 2 <= int(flat[2:4]) <= 98:
        return None
    body = _in_place(flat[4:], key, "iban" + flat[:2])
    check = 98 - _mod97(flat[:2] + "00" + body)
    it = iter(f"{flat[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(it) for c in text)


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card, "number": _number}
#: What follows the @ of an address, and what may stand before it.
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_LOCAL = re.compile(r"[\w.+-]")
#: In the order in which they are tried at a place, after addresses.
PATTERN = re.compile(
    r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b\s{0,4}[:=]\s{0,4}[\"']?)(?P<secret>[A-Za-z0-9_+/=-]{8,})"
    r"|(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?!\w)"
    r"|(?P<date>(?:[0-9]{4}([-/.])[0-9]{1,2}\4[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\5[0-9]{4}))(?!(?![Tt][0-9])\w|[-/.][0-9])"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?P<phone>\+[0-9](?:[ ().-]{0,2}[0-9]){7,14})(?!\w)"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\w-])"
    r"|(?P<number>[0-9]{12,19})(?!\w)"
    r")"
)
_MAY = re.compile(r"[0-9@]|(?i:token|secret|passw|pwd|key)")


#: Lengths of IBANs, and digits of phone numbers with their country code where they are fixed.
IBAN_LENGTHS = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
PHONE_DIGITS = {
    "1": (11,), "7": (11,), "30": (12,), "31": (11,), "32": (11, 10), "33": (11,), "34": (11,), "36": (11, 10), "41": (11,), "44": (12, 11), "45": (10,),
    "47": (10,), "48": (11,), "52": (12,), "55": (13, 12), "61": (11,), "65": (10,), "81": (12, 11), "90": (12,), "91": (12,),
    "351": (12,), "353": (12, 11), "380": (12,), "420": (12,), "421": (12,), "852": (11,), "886": (12, 11), "966": (12,), "971": (12, 11), "972": (12, 11),
}
#: First digits of card issuers, and how many digits their cards have.
_ISSUERS = (
    (re.compile(r"3[47]"), (15,)),
    (re.compile(r"3(?:0[0-5]|[689])"), (14, 16)),
    (re.compile(r"4"), (16, 13, 19)),
    (re.compile(r"5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)"), (16,)),
    (re.compile(r"35|6011|64[4-9]|65|62"), (16, 17, 18, 19)),
    (re.compile(r"5[06-8]|6"), (16, 13, 14, 15, 17, 18, 19)),
)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_GROUP = re.compile(r"[0-9]+")


def _usual(sizes: list[int]) -> bool:
    """Digit groups as cards are written."""
    return len(sizes) == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or (set(sizes[:-1]) == {4} and sizes[-1] <= 4)


def _card_span(text: str, a: int, b: int, first: bool) -> tuple[int, int] | None:
    """The likeliest card among whole groups from one that starts in text[a:b]; `first`: a isn't within a
    span that failed."""
    groups = []
    at = a
    while (m := _GROUP.match(text, at)) and (m.start() < b or sum(y - x for x, y in groups) < 38):
        groups.append(m.span())
        if text[m.end() : m.end() + 1] not in (" ", "-"):
            break
        at = m.end() + 1
    best = None
    for i, (x, _) in enumerate(groups):
        if x >= b:
            break
        d, sizes = "", []
        for _x, y in groups[i:]:
            d += text[_x:y]
            sizes.append(y - _x)
            if len(d) > 19 or (min(sizes) <= 2 and len(sizes) > 1 and set(sizes[:-1]) != {4}):  # neither usual nor of groups over 2
                break
            usual = _usual(sizes)
            if len(d) < 13 or not (usual or min(sizes) > 2) or not luhn(d) or len(set(d)) == 1 or re.match(r"\w|-(?![0-9])", text[y : y + 2]):
                continue
            lengths = next((n for p, n in _ISSUERS if p.match(d)), ())
            known = len(d) in lengths
            if (known and (usual or min(sizes) > 2)) or (usual and i == 0 and first):
                rank = (not usual, not known, lengths.index(len(d)) if known else 9, i)
                if best is None or rank < best[0]:
                    best = (rank, x, y)
    if best:
        return best[1:]
    return (a, b) if first else None


def _ends(text: str, a: int, b: int) -> list[int]:
    """Ends of groups in text[a:b], the last one first."""
    return [y for y in range(b, a, -1) if text[y - 1].isalnum() and not text[y : y + 1].isalnum()]


def _replaced(text: str, kind: str, a: int, b: int, key: bytes, first: bool) -> tuple[int, int, str, str] | None:
    """(start, end, kind, pseudonym) of the value found in text[a:b]."""
    if kind == "iban":
        length = IBAN_LENGTHS.get(text[a : a + 2])
        for y in sorted(_ends(text, a, b), key=lambda y: len(text[a:y].replace(" ", "")) != length):
            if (new := _iban(text[a:y], key)) is not None:
                return a, y, kind, new
        return None
    if kind == "phone":
        d = _digits(text[a:b])
        allowed = next((PHONE_DIGITS[d[:n]] for n in (1, 2, 3) if d[:n] in PHONE_DIGITS), ())
        ends = {len(_digits(text[a:y])): y for y in _ends(text, a, b)}
        y = next((ends[n] for n in allowed if n in ends), b)
        new = _phone(text[a:y], key)
        return new and (a, y, kind, new)
    if kind != "card":
        new = KINDS[kind](text[a:b], key)
        if new is not None:
            return a, b, kind, new
        m = _CARD.match(text, a) if kind in ("date", "ssn") else None
        if not m:
            return None
        kind, b = "card", m.end()
    if (span := _card_span(text, a, b, first)) and (new := _card(text[slice(*span)], key)) is not None:
        return *span, "card", new
    new = _number(text[a:b], key) if b - a <= 19 and text[a:b].isdigit() else None
    return new and (a, b, "number", new)


def _address(text: str, start: int) -> tuple[int, int] | None:
    """The first address at or after `start`: read back from each @, so that no run of letters is read twice."""
    since = start
    while (at := text.find("@", since)) >= 0:
        a = at
        while a > since and _LOCAL.match(text, a - 1):
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            return a, m.end()
        since = at + 1
    return None


def _small_groups(text: str, a: int, b: int) -> int | None:
    """Where the third last digit group of text[a:b] begins, if all have one or two digits: of such groups
    only the whole span may be a card, and no other value begins before that place."""
    starts = [m.start() for m in _GROUP.finditer(text, a, b) if m.end() - m.start() < 3]
    return starts[-3] if len(starts) > 3 and len(starts) == text.count(" ", a, b) + text.count("-", a, b) + 1 else None


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with its values replaced, and (start, end, kind) of each in the given text. A value that the
    permutation leaves as it is isn't counted."""
    if not text or not _MAY.search(text):
        return text, []
    found, out, done, at, tried = [], [], 0, 0, 0
    address, m = _address(text, 0), PATTERN.search(text)
    while m or address:
        if address and (not m or address[0] <= m.start()):
            a, b = address
            hit = (a, b, "email", _email(text[a:b], key))
        else:
            a, b = m.span(m.lastgroup)
            jump = _small_groups(text, a, b) if m.lastgroup == "card" else None
            if jump is None:
                hit = _replaced(text, m.lastgroup, a, b, key, a >= tried)
            else:
                new = _card(text[a:b], key) if a >= tried else None
                hit = new and (a, b, "card", new)
        if hit:
            a, at, kind, new = hit
            if new != text[a:at]:
                out += [text[done:a], new]
                found.append((a, at, kind))
                done = at
            if address and at > address[0]:
                address = _address(text, at)
        else:
            at, tried = jump or a + 1, b if a >= tried else tried
        if m and m.start() < at:
            m = PATTERN.search(text, at)
    return "".join([*out, text[done:]]), found


def pseudonyms(key: bytes):
    """A column function: text -> (text, n_found, kinds)."""

    @F.pandas_udf(FOUND)
    def replace(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            new, found = pseudonymise(t, key)
            rows.append((new, len(found), ",".join(f"{k}:{n}" for k, n in sorted(Counter(f[2] for f in found).items()))))
        return pd.DataFrame(rows, columns=FOUND.names)

    return replace


def mask(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with their own columns, personal data in the text replaced by means of the caller's key."""
    return docs.withColumn(text, pseudonyms(key)(F.col(text))["text"])


def op6_pii_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pseudonyms(EXAMPLE_KEY)("text").alias("p")).select("doc_id", "p.n_found", "p.kinds", "p.text")
