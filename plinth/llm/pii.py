"""PII surrogates: keyed replacements of the same type, gender, script and format.

Entities are found by patterns in every whole text. Each distinct value (per
type, in canonical form) draws a surrogate from a keyed hash; the draws are
checked over the whole corpus against each other and against all original
values, and whoever collides draws again, so distinct values stay distinct
and no surrogate is a real value. Equal values get equal surrogates in all
documents: names part by part, e-mail hosts as values of their own, phone
numbers by their last ten digits, Cyrillic surnames by their masculine form.
Names are found by a title, a listed given name or a greeting, and their parts
(three letters or more, capitalised) are then looked for in the whole text, so
later bare mentions go too. A given name has one surrogate in the corpus,
whatever titles stand before it: listed names have their gender, others the
one that all their titles agree on, or else one that the key draws.
The surrogate is written in the format of its mention.

Each further draw of a value comes from a wider form (octets of any length,
one more letter, digit or syllable), so a form whose values are all taken is
left behind. A value that still collides after MAX_ROUNDS takes the fallback,
``surrogate-`` and 24 hexadecimal digits of its keyed hash.

The first draw is a function of key, type and value alone and is made where
the text is read; only values that had to draw again are looked up.

Defined cases: null and empty texts have no entities and stay as they are; a
null id is kept; repeated rows are changed alike; entities that overlap: the
one that starts first, then the longer, then the earlier type of ``PATTERNS``
(bare mentions of names last);
an empty table gives no rows; extra columns, whatever their names, are left
out.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.sizes import bounded
from plinth.session import materialize

#: Draws of a value before the fallback.
MAX_ROUNDS = 16
FALLBACK = "surrogate-"

# Titles by gender, and given names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа")
NEUTRAL_TITLES = ("Dr", "Prof")
FIRST = {
    ("m", "latin"): (
        "Adam", "Alexander", "Andrew", "Anthony", "Antonio", "Brian", "Carl", "Carlos", "Charles", "Daniel", "David", "Edgar", "Edward", "Felix", "Francisco", "Frank", "Georg", "George", "Hans", "Henry", "Hugo", "Ivan",
        "Jack", "James", "Jean", "John", "Jonas", "Jose", "Joseph", "Juan", "Karl", "Kevin", "Louis", "Luis", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Nils", "Oscar", "Patrick", "Paul", "Pedro", "Peter", "Philip",
        "Pierre", "Richard", "Robert", "Simon", "Stephen", "Steven", "Thomas", "Victor", "William",
    ),
    ("f", "latin"): (
        "Alice", "Amy", "Angela", "Anna", "Barbara", "Bella", "Carmen", "Carol", "Catherine", "Charlotte", "Clara", "Deborah", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Flora", "Greta", "Helen", "Irene", "Isabel", "Jane",
        "Jennifer", "Jessica", "Julia", "Karen", "Karin", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Monica", "Nancy", "Nora", "Olga", "Olivia", "Patricia", "Paula", "Rosa", "Ruth",
        "Sandra", "Sarah", "Sophie", "Susan", "Teresa", "Vera", "Victoria",
    ),
    ("m", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Глеб", "Денис", "Дмитрий", "Егор", "Иван", "Игорь", "Кирилл", "Лев", "Максим", "Михаил", "Николай", "Олег", "Павел", "Пётр", "Роман", "Сергей", "Юрий"),
    ("f", "cyrillic"): ("Александра", "Анастасия", "Анна", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Жанна", "Ирина", "Ксения", "Лидия", "Людмила", "Марина", "Мария", "Надежда", "Наталья", "Ольга", "Полина", "Раиса", "Светлана", "Софья", "Татьяна"),
}
# Words before a full name, by gender, and capitalised words that are no names after them.
CUES = {
    "m": ("Sehr geehrter", "Lieber", "Estimado", "Querido", "Cher", "Уважаемый", "Дорогой"),
    "f": ("Sehr geehrte", "Liebe", "Estimada", "Querida", "Chère", "Уважаемая", "Дорогая"),
    "n": ("Dear", "Hi", "Hello", "Sincerely,", "Regards,", "Signed,", "my name is", "My name is", "mein Name ist", "Mein Name ist", "me llamo", "Me llamo", "je m'appelle", "Je m'appelle", "меня зовут", "Меня зовут"),
}
NO_NAMES = ("Sir", "Sirs", "Madam", "Customer", "Customers", "Team", "All", "Everyone", "Friend", "Friends", "Colleague", "Colleagues", "Reader", "Readers", "Editor", "User", "Users", "Member", "Members", "Kunde", "Kunden", "Damen", "Herren", "Cliente", "Clientes", "Client", "Monsieur", "Madame", "Коллега", "Коллеги", "Друзья")
# Capitalised words that may follow a name and are not looked for elsewhere.
COMMON = ("the", "and", "but", "for", "this", "that", "then", "when", "who", "was", "with", "from", "has", "had", "der", "die", "das", "und", "ein", "eine", "los", "las", "que", "con", "por", "les", "des", "une", "est", "это", "что", "как", "она", "они")
# Russian surname endings that have a feminine form.
FEMININE = {"ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ына": "ын", "ская": "ский", "цкая": "цкий"}
MASCULINE = {m: f for f, m in FEMININE.items()}
# What surrogate names are made of: a beginning, a syllable (one more with each draw), and an ending by kind.
BEGIN = {"latin": ("al", "ba", "ber", "ca", "cor", "da", "del", "el", "fa", "fer", "ga", "gil", "ha", "il", "jo", "ka", "la", "lor", "ma", "mel", "na", "or", "pa", "ra", "ro", "sa", "ta", "ul", "va", "wi"), "cyrillic": ("ал", "бар", "вас", "гол", "дар", "ел", "жар", "зал", "ил", "кор", "лат", "мар", "нар", "ор", "пал", "рад", "сав", "тар", "ул", "фад", "хар", "чер", "шал", "юл", "яр")}
MIDDLE = {"latin": ("ba", "bri", "da", "den", "di", "fa", "fri", "ga", "gri", "hel", "ka", "ki", "la", "len", "li", "ma", "mi", "na", "ni", "pa", "ri", "ro", "sa", "si", "ta", "ti", "va", "ven", "vi", "zo"), "cyrillic": ("ба", "ве", "ви", "га", "да", "де", "ди", "ка", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "ни", "ра", "ре", "ри", "са", "се", "си", "та", "ти")}
ENDING = {
    ("m", "latin"): ("n", "r", "s", "d", "l", "no", "rto", "ck", "mir", "nd"), ("f", "latin"): ("na", "lia", "ra", "tte", "ssa", "da", "lla", "nne", "ria", "ta"),
    ("m", "cyrillic"): ("н", "р", "с", "д", "л", "мир", "й", "рт", "слав", "м"), ("f", "cyrillic"): ("на", "лия", "ра", "да", "ся", "лла", "рия", "та", "ша", "мира"),
    ("s", "latin"): ("son", "ley", "ton", "man", "ford", "well", "berg", "ner", "nez", "rini", "wood", "sen"), ("s", "cyrillic"): ("лов", "нов", "ров", "нин", "лин", "вский", "нский", "рцкий"), ("i", "cyrillic"): ("енко", "ченко", "юк", "чук"),
}
KNOWN = {name.lower(): gender for (gender, _), names in FIRST.items() for name in names}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]*"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]|\.\d)")),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{16}|[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w+])\+\d{8,15}(?!\w)")),
    ("akey", re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")),
    ("secret", re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)(\s*[:=]\s*[\"']?)([A-Za-z0-9_/+=.-]{12,})")),
    ("person", re.compile(rf"(?<!\w)(?P<title>{'|'.join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES))})\.?[  ](?P<name>{_NAME}(?: {_NAME}){{0,2}})")),
    ("named", re.compile(rf"(?<!\w)(?P<first>{'|'.join(n for names in FIRST.values() for n in names)}) (?P<last>{_NAME})(?!\w)")),
    ("cued", re.compile(rf"(?<!\w)(?P<cue>{'|'.join(c for cues in CUES.values() for c in cues)})\s+(?P<name>{_NAME}(?: {_NAME}){{1,2}})")),
)
_HINT = re.compile(r"[@\d]|AKIA|ASIA|(?i:token|secret|passw|key)")
_TITLE_HINT = re.compile(rf"(?<!\w)(?:{'|'.join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES, *(n for names in FIRST.values() for n in names), *(c for cues in CUES.values() for c in cues)))})[.\s]")
_WORD = re.compile(rf"(?<!\w){_NAME}")
#: Letters of a name's part from which on it is looked for without title.
PART_LETTERS = 3


def script(text: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", text) else "latin"


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of each entity, in order and without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, int, str, str]] = []
    if _HINT.search(text):
        for rank, (kind, pattern) in enumerate(PATTERNS[:9]):
            if (kind == "email" and "@" not in text) or (kind == "ipv6" and text.count(":") < 2):
                continue
            for m in pattern.finditer(text):
                start, end = m.span(2) if kind == "secret" else m.span()
                value = text[start:end].rstrip(".") if kind == "email" else text[start:end]
                digits = re.sub(r"\D", "", value)
                if kind == "secret" and not re.search(r"\d", value):
                    continue
                if kind == "ipv6" and not (value := _exploded(value)):
                    continue
                end = start + len(text[start:end].rstrip(".")) if kind == "email" else end
                canon = {"email": value.lower(), "phone": digits[-10:], "card": digits, "iban": value.replace(" ", "")}.get(kind, value)
                found.append((start, -end, rank, kind, canon))
    if _TITLE_HINT.search(text):
        named: list[tuple[int, int, int, str, str]] = []
        for m in PATTERNS[9][1].finditer(text):
            title = m["title"]
            parts = m["name"].split(" ")
            named += _parts(m.start("name"), parts, "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "n", 9, len(parts) > 1)
        for m in PATTERNS[10][1].finditer(text):
            named += _parts(m.start("first"), [m["first"], m["last"]], "n", 10, True)
        for m in PATTERNS[11][1].finditer(text):
            parts = m["name"].split(" ")
            titled = (*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES, *NO_NAMES)
            if not any(p in titled for p in parts):
                named += _parts(m.start("name"), parts, next(g for g, cues in CUES.items() if m["cue"] in cues), 11, True)
        found += named + _bare(text, named)
    found.sort()
    out, last = [], 0
    for start, minus_end, _, kind, canon in found:
        if start >= last:
            out.append((start, -minus_end, kind, canon))
            last = -minus_end
    return out


def _parts(start: int, parts: list[str], gender: str, rank: int, has_first: bool) -> list[tuple[int, int, int, str, str]]:
    """Each part of a name on its own: given names by gender, the last part as surname; a possessive ending is no part of it."""
    out = []
    for k, part in enumerate(parts):
        name = _bare_form(part)
        given = has_first and k < len(parts) - 1
        canon = name.lower()
        kind = f"given_{KNOWN.get(canon, gender)}" if given else "surname"
        if not given and (end := _ending(canon, FEMININE)) and gender != "m":
            canon = canon.removesuffix(end) + FEMININE[end]
        out.append((start, -(start + len(name)), rank, f"{kind}_{script(name)}", canon))
        start += len(part) + 1
    return out


def _bare_form(part: str) -> str:
    return re.sub(r"(?<=\w)(?:['’]s?|-)$", "", part)


def _bare(text: str, named: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Other mentions of the parts of a text's names: capitalised words, the surname before a given name that is written alike."""
    known: dict[str, tuple[str, str]] = {}
    for start, minus_end, _, kind, canon in sorted(named, key=lambda n: (n[3].startswith("given"), n[0])):
        for form in (text[start:-minus_end].lower(), canon):
            if len(form) >= PART_LETTERS and form not in COMMON:
                known.setdefault(form, (kind, canon))
    out = []
    for m in _WORD.finditer(text) if known else ():
        name = _bare_form(m.group())
        if name.lower() in known:
            out.append((m.start(), -(m.start() + len(name)), 12, *known[name.lower()]))
    return out


def _ending(name: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if name.endswith(e) and len(name) > len(e) + 1), None)


def _exploded(value: str) -> str | None:
    """The eight groups of an IPv6 address that has a digit, or None."""
    try:
        return ipaddress.IPv6Address(value).exploded if re.search(r"\d", value) else None
    except ValueError:
        return None


class Stream:
    """Keyed pseudo-random numbers for one value and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int) -> None:
        self._seed = hashlib.blake2b(json.dumps([kind, canon, attempt]).encode(), key=key[:64]).digest()
        self._block, self._left = 0, b""

    def below(self, n: int) -> int:
        if len(self._left) < 8:
            self._left += hashlib.blake2b(self._seed + self._block.to_bytes(8, "big")).digest()
            self._block += 1
        value, self._left = int.from_bytes(self._left[:8], "big"), self._left[8:]
        return value % n


def _letter(s: Stream, c: str) -> str:
    """A letter of the same kind (as Unicode has it) among the 32 code points around ``c``."""
    base = ord(c) & ~31
    near = [chr(p) for p in range(base, base + 32) if unicodedata.category(chr(p)) == unicodedata.category(c)]
    return near[s.below(len(near))]


def _swap(s: Stream, value: str, more: int = 0) -> str:
    """Digits for digits and letters for letters, of the same case and script; first digits that are not zero stay so. ``more`` characters of the last one's kind follow."""
    out = []
    tail = next((c for c in reversed(value) if c.isalnum()), "a")
    for k, c in enumerate(value + tail * more):
        lead = not k or not out[k - 1].isdigit()
        if c.isdigit() and c.isascii():
            out.append(str(1 + s.below(9)) if lead and c != "0" else str(s.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + s.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + s.below(26)))
        else:
            out.append(_letter(s, c) if c.isalpha() else c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + (k % 2)), 10)) for k, d in enumerate(reversed(digits))) % 10


def _ipv4(s: Stream, canon: str, wider: int) -> str:
    """Octets of the same length, private networks kept; wider: octets of any length, then 10/8 for private ones, then all of the space."""
    octets = canon.split(".")
    private = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] else 0
    if not wider:
        spans = {1: (0, 9), 2: (10, 99), 3: (100, 255)}
        return ".".join(o if k < private else str(low + s.below(high - low + 1)) for k, o in enumerate(octets) for low, high in [spans[len(o)]])
    start = octets[:private] if wider < 3 else ["10"] if private and wider < 6 else []
    return ".".join([*start, *(str(s.below(256)) for _ in range(4 - len(start)))])


def _ipv6(s: Stream, canon: str, wider: int) -> str:
    """The network's kind stays, and groups of zeros; other groups keep their length, or with a wider form fill up, the last four first."""
    groups = canon.split(":")
    first = {"2001": 2 if groups[1] == "0db8" else 0}.get(groups[0], 1 if groups[0] >= "fc00" else 0)
    out = []
    for k, g in enumerate(groups):
        digits = 4 if wider and (k >= 4 or wider > 3) else len(g.lstrip("0"))
        if k < first:
            out.append(g)
        elif not k:
            out.append(f"{0x2000 + s.below(0x2000):04x}")
        else:
            low = 16 ** (digits - 1) if digits > 1 else min(1, digits)
            out.append(f"{low + s.below(16**digits - low) if digits else 0:04x}")
    return ":".join(out)


def draw(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of a value at an attempt; it has the value's form, or a wider one."""
    s = Stream(key, kind, canon, attempt)
    wider = attempt // 2
    if attempt >= MAX_ROUNDS:
        return FALLBACK + "".join("0123456789abcdef"[s.below(16)] for _ in range(24))
    if kind == "email":  # the local part; its host is a value of its own
        local, _, host = canon.partition("@")
        return f"{_swap(s, local, wider)}@{host}"
    if kind == "host":
        labels = canon.split(".")
        return ".".join([_swap(s, labels[0], wider), *(_swap(s, x) for x in labels[1:-1]), labels[-1]])
    if kind == "ipv4":
        return _ipv4(s, canon, wider)
    if kind == "ipv6":
        return _ipv6(s, canon, wider)
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in canon[1:-1])
        last = next(str(d) for d in range(10) if _luhn(body + str(d)) == 0) if _luhn(canon) == 0 else str(s.below(10))
        return body + last
    if kind == "iban":
        body = _swap(s, canon[4:])
        rest = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{rest:02d}{body}"
    if kind == "akey":
        return canon[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in canon[4:])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
        hexes = "0123456789ABCDEF" if canon.upper() == canon else "0123456789abcdef"
        return "".join(hexes[s.below(16)] for _ in canon + "0" * wider)
    if kind.startswith(("given", "surname")):
        return _name(s, kind, canon, attempt)
    return _swap(s, canon, wider)


def _name(s: Stream, kind: str, canon: str, attempt: int) -> str:
    """A made-up name of the kind's gender and script, a syllable longer with each attempt."""
    own, written = kind.split("_")[-2], kind.rsplit("_", 1)[1]
    if kind.startswith("surname"):
        own = "i" if written == "cyrillic" and not _ending(canon, MASCULINE) else "s"
    elif own not in "mf":
        own = "mf"[s.below(2)]
    pick = lambda options: options[s.below(len(options))]
    return pick(BEGIN[written]) + "".join(pick(MIDDLE[written]) for _ in range(1 + attempt)) + pick(ENDING[own, written])


def render(mention: str, kind: str, surrogate: str, canon: str) -> str:
    """The surrogate in the format of the mention: its digits in place of the mention's, its case, its spacing."""
    if surrogate.startswith(FALLBACK):
        return surrogate
    if kind in ("phone", "card"):
        left = list(surrogate[: len(canon)])
        out = [left.pop() if c.isdigit() and left else c for c in reversed(mention)]
        return "".join(reversed(out)) + surrogate[len(canon) :]
    if kind == "iban":
        rest = iter(surrogate)
        return "".join(next(rest, "") if c != " " else c for c in mention)
    if kind == "ipv6":
        short = ipaddress.IPv6Address(surrogate).compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in surrogate.split(":"))
        return short.upper() if mention.upper() == mention else short
    if kind == "email":
        return "".join(c.upper() if k < len(mention) and mention[k].isupper() else c for k, c in enumerate(surrogate))
    if kind.startswith(("given", "surname")):
        if mention.lower() != canon and (end := _ending(surrogate, MASCULINE)):  # a feminine form of the canonical surname
            surrogate = surrogate.removesuffix(end) + MASCULINE[end]
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[:1].upper() + surrogate[1:]
    return surrogate


def values_in(spans: list[tuple[int, int, str, str]]) -> set[tuple[str, str]]:
    """(kind, canonical value) of all that draws a surrogate of its own; the host of an e-mail address does."""
    return {(kind, canon) for _, _, kind, canon in spans} | {("host", canon.partition("@")[2]) for _, _, kind, canon in spans if kind == "email"}


def _finder(batches):
    for batch in batches:
        ids, hashes, kinds, canons = [], [], [], []
        for k, text in enumerate(batch.column(2)):
            seen = values_in(detect(text.as_py()))
            for kind, canon in sorted(seen):
                ids.append(batch.column(0)[k].as_py())
                hashes.append(batch.column(1)[k].as_py())
                kinds.append(kind)
                canons.append(canon)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], names=["doc_id", "h", "kind", "canon"])


def _drawer(key: bytes):
    def run(batches):
        for batch in batches:
            kinds, canons, attempts = (batch.column(k).to_pylist() for k in range(3))
            made = [draw(key, k, c, a) for k, c, a in zip(kinds, canons, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canon", "attempt", "surrogate"])

    return run


def redraws(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) of the values whose first draw met another surrogate or an original value.

    Of the claimants of a surrogate the least keeps it, and nobody draws it
    later; given names share one name space for all genders. A first look
    compares all draws; after that only those drawn again move.
    """
    schema = "kind string, canon string, attempt int, surrogate string"
    space = F.regexp_replace("kind", "^given_._", "given_").alias("space")
    drawn = lambda rows, k: rows.select("kind", "canon", F.lit(k).alias("attempt")).mapInArrow(_drawer(key), schema).select(space, "kind", "canon", "attempt", "surrogate")
    originals = values.select(space, F.col("canon").alias("surrogate")).distinct()
    claims = materialize(drawn(values, 0), "pii-draw0")
    taken = [materialize(originals, "pii-originals")]
    settled = []
    for k in range(MAX_ROUNDS + 1):
        met = taken[0]
        if k:
            keys = bounded(claims.select("space", "surrogate").distinct())
            met = taken[0].join(keys, ["space", "surrogate"], "left_semi")
            for held in taken[1:]:
                met = met.unionByName(held.join(keys, ["space", "surrogate"], "left_semi"))
        owners = claims.groupBy("space", "surrogate").agg(F.min(F.struct("canon", "kind")).alias("owner"))
        lost = owners.join(met.withColumn("held", F.lit(True)), ["space", "surrogate"], "left")
        judged = claims.join(lost, ["space", "surrogate"]).withColumn("again", F.col("held").isNotNull() | (F.struct("canon", "kind") != F.col("owner")))
        judged = materialize(judged.select("space", "kind", "canon", "attempt", "surrogate", "again"), f"pii-round{k}")
        kept = judged if k == MAX_ROUNDS else judged.filter("not again")
        settled.append(kept.select("kind", "canon", "attempt", "surrogate"))
        again = judged.filter("again")
        if k == MAX_ROUNDS or not again.limit(1).count():
            break
        taken.append(kept.select("space", "surrogate"))
        claims = materialize(drawn(again, k + 1), f"pii-draw{k + 1}")
    out = settled[0].filter("attempt > 0")
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("kind", "canon", "surrogate")


def given_kinds(values: DataFrame) -> DataFrame:
    """(kind, canon, settled) of each given name: the gender that all its mentions agree on, or none."""
    given = values.filter(F.col("kind").startswith("given_")).withColumn("written", F.substring_index("kind", "_", -1))
    said = given.groupBy("written", "canon").agg(F.max(F.col("kind").startswith("given_m")).alias("m"), F.max(F.col("kind").startswith("given_f")).alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    return given.join(said, ["written", "canon"]).select("kind", "canon", F.concat(F.lit("given_"), gender, F.lit("_"), F.col("written")).alias("settled"))


def replaced(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) of the values whose surrogate is not the first draw of their own kind."""
    kinds = materialize(given_kinds(values), "pii-given")
    others = values.filter(~F.col("kind").startswith("given_"))
    settled = materialize(others.unionByName(kinds.select(F.col("settled").alias("kind"), "canon")).distinct(), "pii-settled")
    redrawn = materialize(redraws(settled, key), "pii-redrawn")
    moved = kinds.filter("kind <> settled")
    first = moved.select(F.col("settled").alias("kind"), "canon", F.lit(0).alias("attempt")).distinct().mapInArrow(_drawer(key), "kind string, canon string, attempt int, surrogate string")
    first = first.select(F.col("kind").alias("settled"), "canon", F.col("surrogate").alias("first"))
    later = redrawn.select(F.col("kind").alias("settled"), "canon", F.col("surrogate").alias("later"))
    alike = moved.join(first, ["settled", "canon"]).join(later, ["settled", "canon"], "left").select("kind", "canon", F.coalesce("later", "first").alias("surrogate"))
    return redrawn.join(moved.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(alike)


def _replacer(key: bytes):
    def run(batches):
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = detect(text)
                special = {(k, c): s for k, c, s in json.loads(known)} if known else {}
                parts, last = [], 0
                known_or_drawn = lambda kind, canon: special.get((kind, canon)) or draw(key, kind, canon)  # noqa: B023, E731
                for start, end, kind, canon in spans:
                    made = known_or_drawn(kind, canon)
                    if kind == "email" and not made.startswith(FALLBACK):
                        made = made.partition("@")[0] + "@" + known_or_drawn("host", canon.partition("@")[2])
                    parts += [text[last:start], render(text[start:end], kind, made, canon)]
                    last = end
                texts.append(text if not spans else "".join([*parts, text[last:]]))
                counts.append(len(spans))
                kinds.append(",".join(sorted({s[2].split("_")[0] for s in spans})))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_entities", "kinds"])

    return run


def surrogate_text(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of each row, its entities replaced."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    mentions = materialize(rows.mapInArrow(_finder, "doc_id long, h long, kind string, canon string"), "pii-mentions", spread=True)
    changed = materialize(replaced(materialize(mentions.select("kind", "canon").distinct(), "pii-values"), key), "pii-replaced")
    if changed.limit(1).count():
        triple = F.array("kind", "canon", "surrogate")
        special = mentions.join(changed, ["kind", "canon"]).groupBy("doc_id", "h").agg(F.to_json(F.collect_set(triple)).alias("known"))
        special = materialize(special.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "known"), "pii-special")
        rows = rows.join(bounded(special), rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["h"] == F.col("__h")), "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    return rows.select("doc_id", "text", "known").mapInArrow(_replacer(key), "doc_id long, text string, n_entities int, kinds string")
