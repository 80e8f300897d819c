"""PII surrogates: detected entities receive keyed replacements of the same type, script and format.

Each entity is mapped by a keyed permutation of its own format: every character class (digits, vowels, consonants
of a script, upper and lower case) is a set, the positions' sets make a mixed-radix number, and a Feistel network
over that number's domain gives another number of the same domain. A permutation is injective, so distinct entities
stay distinct in all documents, and it depends on the key and the entity alone, so all mentions of one entity agree
in all documents (coreference) without any table of entities; phone and card numbers, IBANs, mail addresses and names
agree in all ways of writing them (separators, capitals). Given names are permuted within a list of the same
gender. A person's name is found behind a title, and is replaced word by word, so that a full name, a family name and
a given name agree; in the same document every other whole-word mention of its words, with or without a title, before
or after it, in capitals or not, is replaced too. A person without a title is found where a mail address of the same
document names them; others are not. A collision check walks on
along the permutation's cycle while the surrogate is the entity itself or not of the wanted form, which keeps it a
permutation, and a last one compares each document's surrogates.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: Character classes; a character is replaced by one of its class. Others stay as they are.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
)
_VOWELS = "aeiouαεηιουωаеиоуыэюя"


def _more_classes() -> list[str]:
    """Letters beyond those, of Latin, Greek and Cyrillic: by alphabet, case and whether their base letter is a vowel. Left
    out are letters whose other case is not one letter."""
    known, found = set("".join(CLASSES)), {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))):
        other = c.swapcase()
        if c.isalpha() and c not in known and len(other) == 1 and other != c and other.swapcase() == c:
            base = unicodedata.normalize("NFD", c)[0].lower()
            found.setdefault((unicodedata.name(c).split()[0], c.isupper(), base in _VOWELS), []).append(c)
    return ["".join(x) for x in found.values() if len(x) > 1]


_CLASS_OF = {c: chars for chars in (*CLASSES, *_more_classes()) for c in chars}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"} | {c: "0123456789ABCDEF" for c in "ABCDEF"}
_BASE32 = {c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
_ALNUM = {c: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
#: Given names by gender; a name of a list is replaced by another of the same list.
NAMES = {
    "f": "Alice Anna Carmen Charlotte Claire Elena Elisabeth Emma Eva Greta Hannah Ines Julia Laura Lena Louise Lucia Maria Marie Mary Nora Olivia Paula Rosa Sara Sofia Sophie Susan Teresa Ursula".split(),
    "m": "Adam Albert Andreas Antonio Carlos Charles David Diego Emil Felix Franz Georg Hans Henri Hugo Jack James Javier John Jonas Karl Louis Luis Martin Michael Otto Paul Peter Thomas William".split(),
}
_GENDER_OF = {name: g for g, names in NAMES.items() for name in names}
#: A word of a name: hyphens and apostrophes are within it (not a possessive 's); an initial; a particle.
_UPPER = "[" + "".join(c for c in map(chr, range(0x41, 0x2000)) if c.isupper()) + "]"
_WORD = rf"{_UPPER}(?:[^\W\d_]+|(?=['’]{_UPPER}))(?:(?:-|['’](?!s\b))[^\W\d_]+)*"
_INITIAL = rf"{_UPPER}\.(?:-?{_UPPER}\.)*"
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|do|dos|du|la|le|zu|zur|bin|ibn|al|el|y|af|av|ter|ten)"
#: Entity types, tried in this order at each place.
PATTERNS = {
    "login": r"://(?P<login>[^\s/:@]{1,64}:[^\s/@]{1,64})(?=@)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?\"?(?P<secret>[A-Za-z0-9_+/-]{8,})",
    "access_key": r"(?<![A-Z0-9])A[KS]IA(?P<access>[A-Z0-9]{16})(?![A-Z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_(?P<github>[A-Za-z0-9]{36,})",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "name": rf"\b(?P<title>Mrs|Mr|Ms|Miss|Mme|Monsieur|Madame|Herr|Frau|Señora|Señor|Sra|Sr|Dr|Prof)\b\.? (?P<name>(?:{_INITIAL} )*(?:{_PARTICLE} )*{_WORD}(?: (?:(?:{_INITIAL}|{_PARTICLE}) )*{_WORD})*)",
}
_FINDER = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS.items()))
#: A text with none of these holds no entity but a titled name.
_HINT = re.compile(r"[@0-9=:]|AKIA|ASIA|gh[pousr]_")
_TITLED = re.compile(PATTERNS["name"])
_NAME_PART = rf"\b{_WORD}"
_PARTS = re.compile(_NAME_PART)
_RUN = re.compile(rf"{_NAME_PART}(?: (?:(?:{_INITIAL}|{_PARTICLE}) )*{_WORD})+")


def _permuted(key: bytes, label: str, number: int, domain: int) -> int:
    """A keyed permutation of 0..domain-1: an alternating Feistel network over a x b >= domain, walked into it."""
    if domain <= 1:
        return number
    b = int(domain**0.5) if domain < 1 << 52 else 1 << (domain.bit_length() // 2)
    a = -(-domain // b)
    while True:
        left, right = divmod(number, b)
        for k in range(ROUNDS):
            seed = f"{label}|{domain}|{k}|{right if k % 2 == 0 else left}"
            pad = int.from_bytes(hmac.digest(key, seed.encode(), "sha256")[:24], "big")
            if k % 2 == 0:
                left = (left + pad) % a
            else:
                right = (right + pad) % b
        number = left * b + right
        if number < domain:
            return number


def _remixed(key: bytes, label: str, text: str, classes: dict[str, str], good: Callable[[str], bool] = lambda _: True) -> str:
    """``text`` with its characters' classes kept: the first good one, other than itself, along the permutation's cycle."""
    places = [(i, classes[c]) for i, c in enumerate(text) if c in classes]
    domain = 1
    for _, chars in places:
        domain *= len(chars)
    number = 0
    for i, chars in places:
        number = number * len(chars) + chars.index(text[i])
    shape = label + "|" + "".join(str(len(classes[c])) + classes[c][0] if c in classes else c for c in text)
    for _ in range(10_000):
        number, out = _permuted(key, shape, number, domain), list(text)
        rest = number
        for i, chars in reversed(places):
            rest, digit = divmod(rest, len(chars))
            out[i] = chars[digit]
        found = "".join(out)
        if domain == 1 or found != text and good(found):
            return found
        if found == text:
            return found  # the whole cycle holds no other good one
    return found


def _alike(key: bytes, label: str, text: str, classes: dict[str, str], skip: str = "", good: Callable[[str], bool] = lambda _: True) -> str:
    """The surrogate of ``text`` without the characters of ``skip`` and in lower case, written in its form: one entity in
    several forms has one surrogate in these forms."""
    bare = iter(_remixed(key, label, "".join(map(_small, (c for c in text if c not in skip))), classes, good))
    return "".join(c if c in skip else (_big(x, c) if c != _small(c) else x) for c in text for x in ([c] if c in skip else [next(bare)]))


def _small(c: str) -> str:
    """A letter in lower case, if that is one letter."""
    return c.lower() if len(c.lower()) == 1 else c


def _big(c: str, old: str) -> str:
    """A letter as a capital, if that is one letter; else what stood there."""
    return c.upper() if len(c.upper()) == 1 else old


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _octets(text: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))


def _check_digits(country: str, account: str) -> int:
    """The two digits that make an account number valid: what is missing to 98 of the number modulo 97."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(key: bytes, text: str) -> str:
    """Country and spaces stay, the account is permuted, and the check digits are as far from the valid ones as they were:
    a valid number stays valid, and another does not become so."""
    spaced = text[4:]
    new = _alike(key, "iban" + text[:2], spaced, _CLASS_OF, " ")
    valid, valid_new = (_check_digits(text[:2], x.replace(" ", "")) for x in (spaced, new))
    return f"{text[:2]}{(int(text[2:4]) - valid + valid_new) % 100:02d}{new}"


def _is_ipv6(text: str) -> bool:
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(g not in ("", "0", "00", "000", "0000") for g in text.split(":")) > 1 and not address.is_loopback


def _ipv6(key: bytes, text: str) -> str:
    """Groups of zeros stay, the others are permuted together, written as wide and in the case that they were."""
    groups = ipaddress.IPv6Address(text).exploded.split(":")
    values = [int(g, 16) for g in groups if int(g, 16)]
    number = 0
    for v in values:
        number = number * 0xFFFF + v - 1
    number = _permuted(key, "ipv6" + "".join("0" if not int(g, 16) else "x" for g in groups), number, 0xFFFF ** len(values))
    new = []
    for _ in values:
        number, v = divmod(number, 0xFFFF)
        new.append(v + 1)

    def one(m: re.Match) -> str:
        if not int(m[0], 16):
            return m[0]
        out = f"{new.pop():0{len(m[0]) if m[0][0] == '0' else 1}x}"
        return out.upper() if text != text.lower() else out

    return re.sub(r"[0-9A-Fa-f]+", one, text)


def _hex(text: str) -> bool:
    return set(text) <= set("0123456789abcdef") or set(text) <= set("0123456789ABCDEF")


def _from_list(key: bytes, name: str, gender: str) -> str:
    """The next name of the list in a keyed order, which none is for itself."""
    order = sorted(NAMES[gender], key=lambda x: hmac.digest(key, f"given-{gender}|{x}".encode(), "sha256"))
    return order[(order.index(name) + 1) % len(order)]


def _person(key: bytes, name: str) -> str:
    """Each word and initial has its own surrogate, whatever its place in the name and its capitals; particles stay. A
    listed given name gets one of its gender; any other word keeps its last vowel, by which names of many languages
    tell gender."""

    def one(m: re.Match) -> str:
        word = m[0]
        listed = word.capitalize() if word.isupper() else word
        if listed in _GENDER_OF:
            new = _from_list(key, listed, _GENDER_OF[listed])
            return new.upper() if word.isupper() else new
        end = word[-1] if len(word) > 2 and unicodedata.normalize("NFD", word[-1].lower())[0] in _VOWELS else ""
        stem = word[: len(word) - len(end)]
        return _alike(key, "family" + end.lower(), stem, _CLASS_OF, good=lambda x: (x + end.lower()).title() not in _GENDER_OF) + end

    return re.sub(rf"{_NAME_PART}|{_UPPER}(?=\.)", one, name)


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The replacement of one entity. Types keep what makes their format: a card its first digit and checksum, an
    email its last domain label, an IP its octets' range, a phone its country prefix, an IBAN its country and whether
    its check digits are right."""
    if kind == "email":
        local, _, host = entity.rpartition("@")
        host, dot, tld = host.rpartition(".")
        return _alike(key, "local", local, _CLASS_OF) + "@" + _alike(key, "host", host, _CLASS_OF) + dot + tld
    if kind == "card":
        return entity[0] + _alike(key, kind + entity[0], entity[1:], _CLASS_OF, " -", lambda x: _luhn(entity[0] + x) == _luhn(entity))
    if kind == "ip":
        if not _octets(entity):
            return _remixed(key, kind, entity, _CLASS_OF, lambda x: not _octets(x))
        # all addresses are one domain
        number = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        return ".".join(map(str, _permuted(key, kind, number, 1 << 32).to_bytes(4, "big")))
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=\D)|", entity)[0]
        return head + _alike(key, kind + head, entity[len(head) :], _CLASS_OF, " .-()")
    if kind == "access_key":
        plain = set(entity) <= _BASE32.keys()
        return _remixed(key, kind, entity, _BASE32 if plain else _ALNUM, lambda x: (set(x) <= _BASE32.keys()) == plain)
    if kind == "secret":
        return _remixed(key, kind, entity, _HEX if _hex(entity) else _CLASS_OF, lambda x: _hex(x) == _hex(entity))
    if kind == "iban":
        return _iban(key, entity)
    if kind == "ipv6":
        return _ipv6(key, entity)
    if kind == "name":
        return _person(key, entity)
    return _remixed(key, kind, entity, _CLASS_OF)


_kept_surrogate = functools.lru_cache(maxsize=1 << 16)(surrogate)
_INNER = {"secret": "secret", "access_key": "access", "github_token": "github", "login": "login", "name": "name"}


def _named_by_mail(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of two names and more, between the entities, a word of which is in the local part of one of the text's mail
    addresses: that person is named without a title."""
    words = {w for kind, a, b in found if kind == "email" for w in re.split(r"[^a-z]+", text[a : text.index("@", a)].lower()) if len(w) > 2}
    if not words:
        return []
    edges = [0, *(x for _, a, b in found for x in (a, b)), len(text)]
    runs = (m for a, b in zip(edges[::2], edges[1::2], strict=True) for m in _RUN.finditer(text, a, b))
    return [("name", *m.span()) for m in runs if not words.isdisjoint(x.lower() for x in _PARTS.findall(m[0]))]


def _entities(text: str) -> list[tuple[str, int, int]]:
    """Type and place of each entity, in order; places do not overlap."""
    finder, found = _FINDER if _HINT.search(text) else _TITLED, []
    for m in finder.finditer(text):
        kind = "name" if finder is _TITLED else next(k for k in PATTERNS if m[f"k_{k}"] is not None)
        if kind != "ipv6" or _is_ipv6(m[0]):
            found.append((kind, *m.span(_INNER.get(kind, 0))))
    found += _named_by_mail(text, found)
    parts = {x for kind, a, b in found if kind == "name" for x in _PARTS.findall(text[a:b])}
    parts |= {x.upper() for x in parts if len(x) > 2}
    if parts:
        found.sort(key=lambda x: x[1])
        # further mentions: runs of the names' words, between the entities
        word = "|".join(map(re.escape, sorted(parts, key=len, reverse=True)))
        mention = re.compile(rf"(?<!\w)(?:{word})(?: (?:(?:{_INITIAL}|{_PARTICLE}) )*(?:{word}))*(?!\w)")
        edges = [0, *(x for _, a, b in found for x in (a, b)), len(text)]
        found += [("name", *m.span()) for a, b in zip(edges[::2], edges[1::2], strict=True) for m in mention.finditer(text, a, b)]
        found.sort(key=lambda x: x[1])
    return found


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and each one's type and place in it."""
    out, spans, at, length, given = [], [], 0, 0, {}
    for kind, start, end in _entities(text):
        entity = text[start:end]
        new = _kept_surrogate(kind, entity, key)
        # collision check: within a document no two entities of a type share a surrogate
        while given.setdefault((kind, new), entity) != entity:
            new = _kept_surrogate(kind, new, key)
        out += [text[at:start], new]
        length += start - at
        spans.append((kind, length, length + len(new)))
        length, at = length + len(new), end
    out.append(text[at:])
    return "".join(out), spans


#: The session's setting that holds the key.
KEY_SETTING = "spark.embedaudit.pii.key"


def session_key(spark: SparkSession) -> str:
    """The key of all replacements: the session's setting, which a user keeps to get the same surrogates again. Without
    one the session draws a key of its own, so that nobody can invert the surrogates."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def with_surrogates(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the text's entities replaced, and ``pii``: type, first character and end of each surrogate.

    ``key`` keys all replacements; another key gives others. Null text stays null and has no entities, as has empty
    text. Rows are independent, whatever their ids; equal texts get equal results. A column named ``pii`` is
    replaced; all other columns stay.
    """
    kept = [c for c in df.columns if c != "pii"]
    at = kept.index(text_col)
    secret = hashlib.sha256(key.encode()).digest()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at).to_pylist():
                new, spans = (value, []) if not value else replaced(value, secret)
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, span)], [*kept, "pii"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "pii array<struct<kind:string,start:int,end:int>>"])
    return df.select(*kept).mapInArrow(work, schema)


def entity_counts(column: str = "pii") -> Column:
    """Entities by type in one string, sorted: ``card=1,email=2``."""
    kinds = F.transform(column, lambda x: x["kind"])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat_ws("=", k, F.size(F.filter(kinds, lambda x: x == k)).cast("string"))), ",")
