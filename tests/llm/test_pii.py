"""Surrogates: formats, check digits, spellings, and the recall of planted entities."""

import ipaddress
import random
import string

import pytest
from pyspark.sql import functions as F

from embedaudit.llm import pii

KEY = b"k" * 32


def _valid(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _made_iban(rng):
    account = "".join(rng.choice(string.digits) for _ in range(18))
    return f"DE{pii._check_digits('DE', account):02d}{account}"


def test_ibans_keep_their_validity():
    rng = random.Random(1)
    valid = [_made_iban(rng) for _ in range(60)] + ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]
    wrong = [x[:2] + f"{(int(x[2:4]) + 1) % 100:02d}" + x[4:] for x in valid[:30]]
    got = [pii.surrogate("iban", x, KEY) for x in [*valid, *wrong]]
    assert all(map(_valid, got[: len(valid)])) and not any(map(_valid, got[len(valid) :])) and len({x.replace(" ", "") for x in got}) == len(got)
    assert all(a[:2] == b[:2] and a != b and [c == " " for c in a] == [c == " " for c in b] for a, b in zip([*valid, *wrong], got, strict=True))
    assert pii.surrogate("iban", "DE89370400440532013000", KEY) == pii.surrogate("iban", "DE89 3704 0044 0532 0130 00", KEY).replace(" ", "")


def test_addresses_of_version_six_in_all_spellings():
    text = "2001:db8::ff00:42:8329 is 2001:0DB8:0000:0000:0000:FF00:0042:8329; not 12:30:45, 00:1A:2B:3C:4D:5E, a::b::c or std::map"
    new, spans = pii.replaced(text, KEY)
    a, b = (new[x:y] for kind, x, y in spans if kind == "ipv6")
    assert len(spans) == 2 and ipaddress.IPv6Address(a) == ipaddress.IPv6Address(b) != ipaddress.IPv6Address("2001:db8::ff00:42:8329")
    assert "::" in a and b.isupper() and len(b) == 39 and new.endswith("not 12:30:45, 00:1A:2B:3C:4D:5E, a::b::c or std::map")


def test_logins_in_addresses_of_hosts():
    new, spans = pii.replaced("open https://bob:s3cretpw@example.org/x now", KEY)
    assert [k for k, *_ in spans] == ["login"] and new.startswith("open https://") and new.endswith("@example.org/x now") and "s3cret" not in new and "bob" not in new


@pytest.mark.parametrize(
    ("text", "gone"),
    [
        ("Frau Anna Schmidt, née ANNA SCHMIDT, lacht. Anna geht.", ["Anna", "ANNA", "Schmidt", "SCHMIDT"]),
        ("Herr İlker ẞmith kam.", ["lker", "mith"]),
        ("Dr Žofia Řehořová met Žofia.", ["Žofia", "Řehořová", "Žof"]),
        ("John Smith wrote from john@x.org to us.", ["John", "Smith", "john"]),
        ("Kyr. Mr Γιώργος Παπαδόπουλος", ["Γιώργος", "Παπαδόπουλος"]),
    ],
)
def test_names_in_all_their_mentions(text, gone):
    new, _ = pii.replaced(text, KEY)
    assert not any(x in new for x in gone) and len(new) == len(new.strip()) and [c for c in new if c in ".,@"] == [c for c in text if c in ".,@"]


def test_words_keep_what_tells_gender_and_stay_apart():
    names = ["Kowalska", "Kowalski", "Kowalsko", "Nowaka", "Brown", "Browna", "Ėlė", "Žofia"]
    got = [pii.surrogate("name", x, KEY) for x in names]
    assert len(set(got)) == len(names) and all(a != b and (a[-1] == b[-1]) == (a[-1] in "aeiouė") for a, b in zip(names, got, strict=True))
    women, men = (pii.surrogate("name", x, KEY) for x in ("ANNA", "Peter"))
    assert women.isupper() and women.capitalize() in pii.NAMES["f"] and men in pii.NAMES["m"]


def test_planted_entities_are_found(spark):
    """Recall over planted entities of every type, and no entity in the prose between them."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    prose = "the river runs by an old mill and nobody counts the stones there".split()
    makers = {
        "email": lambda: f"{word(6)}.{word(5)}@{word(7)}.com", "iban": lambda: _made_iban(rng), "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "ipv6": lambda: ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8)), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "phone": lambda: f"+49 {digits(3)} {digits(4)} {digits(3)}",
        "card": lambda: f"4{digits(3)} {digits(4)} {digits(4)} {digits(4)}", "secret": lambda: f"api_key={word(10)}{digits(4)}", "access_key": lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase) for _ in range(16)),
        "github_token": lambda: "ghp_" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(36)), "login": lambda: f"ftp://{word(5)}:{word(8)}@host", "name": lambda: f"Frau {word(6).title()} {word(8).title()}",
    }
    rows, planted = [], []
    for i in range(240):
        kind = list(makers)[i % len(makers)]
        entity = makers[kind]()
        at = rng.randint(0, len(prose))
        rows.append((i, " ".join([*prose[:at], entity, *prose[at:]])))
        planted.append((kind, entity))
    got = pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "secret").withColumn("kinds", F.col("pii.kind")).orderBy("doc_id").collect()
    core = lambda kind, e: e.split("=")[1] if kind == "secret" else e[4:] if kind in ("access_key", "github_token") else e[6:-5] if kind == "login" else e.removeprefix("Frau ")
    missed = [(k, e) for (k, e), r in zip(planted, got, strict=True) if r["kinds"] != [k] or core(k, e) in r["text"]]
    assert not missed
    clean = pii.with_surrogates(spark.createDataFrame([(1, " ".join(prose)), (2, None), (3, "")], "doc_id long, text string"), "secret")
    assert [tuple(r) for r in clean.select("text", F.size("pii")).collect()] == [(" ".join(prose), 0), (None, 0), ("", 0)]
