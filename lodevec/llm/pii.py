"""Operator 9, PII: format-preserving pseudonyms by keyed Feistel permutations.

Found and validated: payment card numbers (13 to 19 digits, single blanks or hyphens between
groups allowed), telephone numbers (international or with an area code), IPv4 addresses, dates
(ISO, and day or month first), social security numbers, IBANs, e-mail addresses and secrets
(named tokens and keys). Each value is replaced by one of the same format: digits by digits,
letters by letters of the same case, separators kept. The digits (for dates the day count, for
addresses the four bytes, for e-mail and secrets the characters) are one number below a known
bound, which a Feistel network over two halves permutes, keyed by HMAC-SHA256 and the kind;
walking the cycle keeps the number inside the bound. A value of more than WIDE characters isn't
made one number: its places are two halves of digits, each place with its own alphabet, and a
Feistel network adds keyed digits modulo that alphabet (`_wide`), in time linear in the length. As
a permutation it maps equal values alike wherever they stand and different ones apart, and with
the key it can be undone (`restore`). A number with a valid check digit gets a pseudonym with one;
a card number without, one without.

Cases: null text stays null with no finds; nothing else in a text changes; a text or value of any
length takes time linear in it, as every pattern is either of bounded length or tried only where
its run of characters begins; where a pattern's match turns out to be no valid value, the search
goes on one character later; other columns pass through, those named like a result are replaced;
rows are independent, so ties and repeated rows need no rule.
"""

import hashlib
import hmac
import re
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, WIDE = 8, 128
KEY = "lodevec-demo-key"


class Feistel:
    """A keyed permutation of range(bound)."""

    def __init__(self, key: str, tweak: str, bound: int):
        self.bound = bound
        self.half = max(1, -(-max(1, (bound - 1).bit_length()) // 2))
        self.mask = (1 << self.half) - 1
        self.mac = hmac.new(key.encode(), f"{tweak}:{bound:x}".encode(), hashlib.sha256)

    def _round(self, i: int, right: int) -> int:
        m = self.mac.copy()
        m.update(i.to_bytes(1, "big") + right.to_bytes((self.half + 7) // 8, "big"))
        out = m.digest()
        n = 1
        while len(out) * 8 < self.half:
            m.update(n.to_bytes(1, "big"))
            out += m.digest()
            n += 1
        return int.from_bytes(out, "big") & self.mask

    def __call__(self, x: int) -> int:
        if self.bound < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(ROUNDS):
                a, b = b, a ^ self._round(i, b)
            x = a << self.half | b
            if x < self.bound:
                return x

    def back(self, x: int) -> int:
        if self.bound < 2:
            return x
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.bound:
                return x


@lru_cache(4096)
def permutation(key: str, tweak: str, bound: int) -> Feistel:
    return Feistel(key, tweak, bound)


def _permute(key: str, tweak: str, x: int, bound: int, undo: bool) -> int:
    p = permutation(key, tweak, bound)
    return p.back(x) if undo else p(x)


def luhn(digits: str) -> int:
    """The digit that makes digits + it valid."""
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        s += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return -s % 10


def _digits_into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")


def _wide(key: str, tweak: str, digits: np.ndarray, bases: np.ndarray, undo: bool) -> np.ndarray:
    """A keyed permutation of digit strings, digits[i] below bases[i]: halves take turns to shift each other's digits."""
    cut = len(digits) // 2
    part, base = [digits[:cut].astype(np.uint64), digits[cut:].astype(np.uint64)], [bases[:cut].astype(np.uint64), bases[cut:].astype(np.uint64)]
    shape = hashlib.sha256(bases.astype(np.uint8).tobytes()).digest()
    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        own, other = i % 2, 1 - i % 2
        seed = hmac.new(key.encode(), tweak.encode() + b":wide:" + bytes([i]) + shape + part[other].astype(np.uint8).tobytes(), hashlib.sha256).digest()
        shift = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(part[own])), "<u8") % base[own]
        part[own] = (part[own] + (base[own] - shift if undo else shift)) % base[own]
    return np.concatenate(part)


def _hex(key: str, tweak: str, text: str, undo: bool) -> str:
    """Hexadecimal digits of one case; the walk goes on until a letter is among them, so that they are told from plain digits."""
    alphabet = "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"
    while True:
        if len(text) > WIDE:
            own, place = np.frombuffer(alphabet.encode(), np.uint8), np.zeros(128, np.uint8)
            place[own] = np.arange(16)
            text = own[_wide(key, tweak + "hex", place[np.frombuffer(text.encode(), np.uint8)], np.full(len(text), 16), undo)].tobytes().decode()
        else:
            n = _permute(key, tweak + "hex", int(text, 16), 16 ** len(text), undo)
            text = format(n, f"0{len(text)}{'X' if alphabet[-1] == 'F' else 'x'}")
        if not text.isdigit():
            return text


def _letters(key: str, tweak: str, text: str, undo: bool) -> str:
    """Letters within their case and alphabet, hexadecimal digits as such, digits as digits; other characters stay."""
    if _HEX.fullmatch(text) and not text.isdigit():
        return _hex(key, tweak, text, undo)
    if len(text) > WIDE:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        first, bases = codes.copy(), np.ones(len(codes), np.uint8)
        for own in _LETTERS:
            inside = (codes >= ord(own[0])) & (codes <= ord(own[-1]))
            first[inside], bases[inside] = ord(own[0]), len(own)
        new = first + _wide(key, tweak, (codes - first).astype(np.uint8), bases, undo).astype(np.uint32)
        return new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    of = [next((s for s in _LETTERS if c in s), None) for c in text]
    n, bound = 0, 1
    for c, s in zip(text, of):
        if s:
            n, bound = n * len(s) + s.index(c), bound * len(s)
    shape = "".join("-" if s is None else "aA0"[_LETTERS.index(s)] for s in of)
    n = _permute(key, tweak + shape, n, bound, undo)
    out = []
    for c, s in zip(reversed(text), reversed(of)):
        if s:
            n, i = divmod(n, len(s))
            out.append(s[i])
        else:
            out.append(c)
    return "".join(reversed(out))


# ---------------------------------------------------------------- kinds: value -> pseudonym, or None if it isn't one


def _card(key, v, undo):
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or d == d[0] * len(d):
        return None
    body, check = d[:-1], (int(d[-1]) - luhn(d[:-1])) % 10
    new = str(_permute(key, f"card{len(d)}", int(body), 10 ** len(body), undo)).zfill(len(body))
    # how far the last digit is from the check digit is kept, so that valid stays valid and nothing else becomes it
    return _digits_into(v, new + str((luhn(new) + check) % 10))


def _phone(key, v, undo):
    d = re.sub(r"\D", "", v)
    if not 7 <= len(d) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{1,3}(?=[ (.-]))?", v).group().strip("+")) if v[0] == "+" else 0
    own = d[keep:]
    return _digits_into(v, d[:keep] + str(_permute(key, f"phone{len(own)}", int(own), 10 ** len(own), undo)).zfill(len(own)))


def _ssn(key, v, undo):
    d = re.sub(r"\D", "", v)
    if d[:3] in ("000", "666") or d[3:5] == "00" or d[5:] == "0000":
        return None
    while True:
        d = str(_permute(key, "ssn", int(d), 10**9, undo)).zfill(9)
        if not (d[:3] in ("000", "666") or d[3:5] == "00" or d[5:] == "0000"):
            return _digits_into(v, d)


def _ip(key, v, undo):
    p = v.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in p):
        return None
    n = 0
    for x in p:
        n = n << 8 | int(x)
    n = _permute(key, "ip", n, 1 << 32, undo)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


_DAY0, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _date(key, v, undo):
    m = re.fullmatch(r"(\d+)([-/.])(\d+)\2(\d+)", v)
    a, sep, b, c = m.groups()
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        f = dict(zip(order, map(int, (a, b, c))))
        try:
            day = date(f["y"], f["m"], f["d"]).toordinal() - _DAY0
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        # which order a text means isn't known where both fit, so a pseudonym must read in the same orders
        kind = order if order == "ymd" else order + str(f["d"] <= 12)
        while True:
            day = _permute(key, "date", day, _DAYS, undo)
            n = date.fromordinal(day + _DAY0)
            if kind == "ymd" or (n.day <= 12) == (f["d"] <= 12):
                break
        parts = {"y": f"{n.year:04}", "m": f"{n.month:02}", "d": f"{n.day:02}"}
        return sep.join(parts[x] for x in order)
    return None


def _iban(key, v, undo):
    s = v.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _letters(key, "iban", s[4:], undo)
    out = s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02}" + body
    it = iter(out)
    return "".join(c if c == " " else next(it) for c in v)


def _email(key, v, undo):
    local, _, host = v.rpartition("@")
    name, dot, top = host.rpartition(".")
    return _letters(key, "local", local, undo) + "@" + _letters(key, "host", name, undo) + dot + top


_PREFIX = re.compile(r"AKIA|gh[pousr]_|sk[-_](?:live_|test_)?|xox[abprs]-")


def _secret(key, v, undo):
    m = _PREFIX.match(v)
    head = m.group() if m else ""  # names the kind of secret, not the secret
    return head + _letters(key, "secret", v[len(head) :], undo)


# what stands before a kind's value within its pattern: an address is looked for only where a run of its characters begins
_BEFORE = {"email": r"(?<![\w.+-])(?:(?![A-Za-z0-9])[\w.+-])*+"}
KINDS = (
    ("email", r"[A-Za-z0-9][\w.+-]*+@[\w-]++(?:\.[\w-]++)*\.[A-Za-z]{2,}", _email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_](?:live_|test_)?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)\b", _secret),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![./-]?\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?![\d-])", _card),
    ("phone", r"(?<![\w+-])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<!\.)\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)", _phone),
)
# every value has a digit, an @ or a secret's prefix; patterns are tried only around those
_HINT = re.compile(r"(?:[0-9@]|AKIA|gh[pousr]_|sk[-_]|xox[abprs]-)(?:.{0,24}[0-9@])*", re.S)


def _union(kinds) -> re.Pattern:
    """The kinds as named groups of one pattern; the groups of separators get names, as numbers would shift."""
    n = 0

    def named(m):
        nonlocal n
        n += 1
        return f"(?P<s{n}>["

    return re.compile("|".join(f"{_BEFORE.get(k, '')}(?P<{k}>{re.sub(r'(?<![?\\])\(\[', named, re.sub(r'\\([1-9])', r'(?P=s\1)', p))})" for k, p, _ in kinds))


PATTERN = _union(KINDS)
_GAP = re.compile(r"[ \n\t]")
_CHANGE = {n: f for n, _, f in KINDS}


def pseudonymize(text: str, key: str = KEY, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each value in the result."""
    out, found, last, n, seen = [], [], 0, 0, 0
    for h in _HINT.finditer(text):
        if h.end() <= seen:  # in a stretch that has been searched
            continue
        start = max(seen, *(text.rfind(c, seen, h.start()) + 1 for c in " \n\t"))
        gap = _GAP.search(text, h.end())
        end = gap.start() if gap else len(text)
        at = start
        while m := PATTERN.search(text, at, end):
            kind = next(k for k in _CHANGE if m.group(k) is not None)
            a, at = m.span(kind)
            new = _CHANGE[kind](key, m.group(kind), undo)
            if new is None:
                at = a + 1
                continue
            out += [text[last:a], new]
            n += a - last
            found.append((kind, n, len(new)))
            n, last = n + len(new), at
        seen = end
    if not found:
        return text, []
    out.append(text[last:])
    return "".join(out), found


def restore(text: str, key: str = KEY) -> str:
    """Undo pseudonymize with the same key."""
    return pseudonymize(text, key, undo=True)[0]


def mask(docs: DataFrame, text: str = "text", key: str = KEY, keep: list[str] | None = None, undo: bool = False) -> DataFrame:
    """docs (or its columns `keep`) with clean_text string and found array<struct<kind,start,length>>."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("clean_text", "found")]
    d = docs.select(*keep, F.col(text).alias("__text"))
    out = d.select(*keep).withColumns({"clean_text": F.lit(None).cast("string"), "found": F.lit(None).cast("array<struct<kind:string,start:int,length:int>>")}).schema

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        # a value has a digit or an @, so most texts are passed by a scan for those
        for b in batches:
            texts, finds = [], []
            for t in b.column("__text").to_pylist():
                new, found = (t, []) if t is None or not _HINT.search(t) else pseudonymize(t, key, undo)
                texts.append(new)
                finds.append([dict(zip(("kind", "start", "length"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(finds, kind)], [*keep, "clean_text", "found"])

    return d.mapInArrow(run, out)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = mask(docs, keep=["doc_id"])
    return m.select("doc_id", F.col("clean_text").alias("text"), F.size("found").alias("n_found"), "found")
