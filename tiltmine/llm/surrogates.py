"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed ones of their own kind and format: digits
stay digits, letters keep their script, case and whether they are vowels, a card
number stays valid if it was, an address stays public if it was, a given name stays
one of its gender and script.  A surrogate is a keyed permutation of all values of
the same format, so two entities never get one surrogate, and one entity gets the
same surrogate everywhere, however it is written.  Parts that stand for themselves
are entities of their own: a person's given name and surname, a mail's domain, so
they are the same wherever they stand.  A person whom a text names in full is known
by either part in the rest of that text.

Names are found after a title, or as a listed given name and another capitalised
word.  Listed given names are permuted among those of their gender and script;
others, of which a title tells the gender, get permuted letters and an ending of it.

A surrogate can still be another real entity of the corpus, or, where formats were
mended, another's surrogate.  Both are looked for over all documents; entities in
such a collision are permuted once more, until none is left (given names are left
out: they are permuted among themselves, and tell nobody apart without a surname).  A format can be
exhausted (more than half of its values are real) or have nothing to permute; after
NARROW attempts surrogates are therefore drawn from wider formats, longer by one more
character each attempt, so there is always a free one.

The key is the caller's.  ``session_key`` takes it from the session's configuration, or
draws one that lasts as long as the session; who has the key can undo the permutations.

Defined results: null texts stay null, texts without entities stay as they are.
Overlapping finds keep the one that starts first, then the longer.  A secret that
is one sign repeated ("________") is a blank and no entity; one with letters of which
no alphabet is known gets Latin letters for them.  Letters of a name without a pool of
their own are permuted among those of their kind in their part of Unicode; accents stay.
Repeated rows get the same text.  All columns are kept; ``n_chars`` follows the new text where it
is there.  Text inside a surrogate is not searched again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmine.llm import textkit
from tiltmine.llm.shared import discard, materialize

#: The setting that holds the key, in hexadecimal; Spark hides settings of such a name in its logs and pages.
KEY_SETTING = "spark.tiltmine.surrogates.secret"
#: Exceptions (entities in a collision) up to which they are broadcast; beyond, they are joined to their documents.
EXCEPTIONS_MOST = 50_000
#: Rounds of collision checks after which the key is at fault.
MOST_ROUNDS = 20
#: Attempts within an entity's own format; those after it are longer by one character more each time.
NARROW = 4

# Titles and the gender that they tell, and common given names by script and gender.
_TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m", "Κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Госпожа": "f", "Κυρία": "f"}
_GIVEN = {
    ("latin", "m"): ["Adam", "Alexander", "Andrew", "Antonio", "Bruno", "Carlos", "Charles", "Daniel", "David", "Edward", "Felix", "Francis", "George", "Hans", "Henry", "Ivan", "James", "John", "Jürgen", "Karl", "Louis", "Martin", "Michael", "Miguel", "Nicolas", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Stefan", "Thomas", "Victor", "William"],
    ("latin", "f"): ["Alice", "Amanda", "Anna", "Barbara", "Carmen", "Catherine", "Clara", "Diana", "Elena", "Elizabeth", "Emma", "Flora", "Greta", "Helen", "Ingrid", "Irene", "Jane", "Julia", "Kate", "Laura", "Linda", "Lucy", "Maria", "Mary", "Monica", "Nora", "Olivia", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Teresa", "Yvonne"],
    ("cyrillic", "m"): ["Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Григорий", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей"],
    ("cyrillic", "f"): ["Александра", "Анна", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("greek", "m"): ["Αλέξανδρος", "Γεώργιος", "Γιάννης", "Δημήτριος", "Κωνσταντίνος", "Νικόλαος", "Παύλος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Αικατερίνη", "Ελένη", "Ευαγγελία", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
#: Endings of given names that are on no list, by script and gender.
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("greek", "m"): "ν", ("greek", "f"): "α"}
def _plain(name: str) -> str:
    return unicodedata.normalize("NFC", name.lower()).replace("ς", "σ")


_GENDER = {_plain(name): key for key, names in _GIVEN.items() for name in names}
_POOLS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "æœø", "łđßþð", "ъь"]
_POOLS += ["".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3))]  # parts of Korean syllables
_POOL = {c: pool for pool in _POOLS for c in pool}
_HEX = "0123456789abcdef"
_ALPHABET = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": _POOLS[3] + _POOLS[4], "greek": _POOLS[5] + _POOLS[6]}

_PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), "@"),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"), "d"),
    ("ip6", re.compile(r"(?<![\w:.])[23fF][0-9A-Fa-f]{2,3}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])"), ":"),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), "d"),
    ("card", re.compile(r"(?<![\d+])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<![\d+])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)"), "d"),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "d"),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)"), "d"),
    ("key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|sk|pk|xox[bp])[-_][A-Za-z0-9_-]{16,}"), "d"),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?([^\s\"'&$#%*,;]{6,})"), "="),
    ("name", re.compile(r"(?<!\w)(?:" + "|".join(sorted(_TITLES, key=len, reverse=True)) + r")\.? ((?:[^\W\d_]+ )?[^\W\d_]+)"), ""),
]
_DIGIT = re.compile(r"\d")
_FULL_NAME = re.compile(r"(?<!\w)(?:" + "|".join(n for names in _GIVEN.values() for n in names) + r") [^\W\d_]+")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip6_ok(s: str) -> bool:
    try:
        return ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


def _titled(text: str, m: re.Match) -> list[tuple[int, int, str]]:
    """The parts of a name after a title: given name and surname, or a surname alone."""
    start, own = m.start(1), m[1].split(" ")
    if own[0][0].islower():
        return []
    gender = _TITLES[re.match(r"[^\W\d_]+", m[0])[0]]
    if len(own) == 1 or not own[1][0].isupper():  # letters without case do not begin a second word
        return [(start, start + len(own[0]), "surname")]
    at = start + len(own[0]) + 1
    kind = "given" if _GENDER.get(_plain(own[0])) else f"given-{gender}"
    return [(start, at - 1, kind), (at, at + len(own[1]), "surname")]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    hints = {"": True, "@": "@" in text, "d": bool(_DIGIT.search(text)), "=": "=" in text or ":" in text, ":": text.count(":") > 1}
    found, persons = [], {}
    for kind, pattern, hint in _PATTERNS:
        if not hints[hint]:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 0)
            own = text[start:end]
            if kind == "secret" and len(set(own)) == 1 and not own[0].isalnum():
                continue
            if kind == "iban" and not _iban_ok(own.replace(" ", "")):
                continue
            if kind == "card" and not 13 <= sum(c.isdigit() for c in own) <= 19:
                continue
            if kind == "ip6":
                end -= own.endswith(":") and not own.endswith("::")
                if not _ip6_ok(text[start:end]):
                    continue
            found += _titled(text, m) if kind == "name" else [(start, end, kind)]
    for m in _FULL_NAME.finditer(text):
        given, family = m.group().split(" ")
        if family[0].isupper() and family != given:
            at = m.start() + len(given) + 1
            found += [(m.start(), at - 1, "given"), (at, m.end(), "surname")]
    for start, end, kind in found:
        if kind == "surname" or kind.startswith("given"):
            persons.setdefault(text[start:end], kind)
            persons.setdefault(text[start:end].upper(), kind)
    if persons:  # who is known is known by either name
        alone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted((p for p in persons if len(p) > 1), key=len, reverse=True))) + r")(?!\w)") if any(len(p) > 1 for p in persons) else None
        found += [(*m.span(), persons[m[0]]) for m in alone.finditer(text)] if alone else []
    found.sort(key=lambda x: (x[0], -x[1]))  # of equal spans the first found stays
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until it is back in range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            f = hmac.new(key, f"{tweak}\0{size}\0{r}\0{right}".encode(), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def _shuffled(key: bytes, tweak: str, value: str, pools: list[str]) -> str:
    """``value`` permuted among all strings with its characters' pools ("" keeps a character)."""
    size, x = 1, 0
    for c, pool in zip(value, pools):
        if pool:
            x, size = x * len(pool) + pool.index(c), size * len(pool)
    x = permute(key, f"{tweak}\0{''.join(p[:1] or c for c, p in zip(value, pools))}", x, size)
    out = []
    for c, pool in zip(reversed(value), reversed(pools)):
        if pool:
            x, at = divmod(x, len(pool))
            c = pool[at]
        out.append(c)
    return "".join(reversed(out))


@lru_cache(maxsize=10_000)
def _pool_of(c: str) -> str:
    """The characters that a letter is permuted among; "" for what is no letter or digit."""
    if c in _POOL:
        return _POOL[c]
    kind = unicodedata.category(c)
    if not kind.startswith("L"):
        return ""
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and unicodedata.normalize("NFD", x) == x and x not in _POOL and x.lower() == x)


def _word(key: bytes, tweak: str, value: str) -> str:
    """Letters by their pools; accents stay on the letters that come in their place."""
    apart = unicodedata.normalize("NFD", value)
    return unicodedata.normalize("NFC", _shuffled(key, tweak, apart, [p if c in (p := _pool_of(c)) else "" for c in apart]))


def _drawn(key: bytes, tweak: str, value: str, pools: list[str]) -> str:
    """A character of each pool, drawn by all of ``value``; a character of ``value`` for an empty pool."""
    at = [hmac.new(key, f"{tweak}\0drawn\0{i}\0{value}".encode(), hashlib.sha256).digest()[:8] if p else b"" for i, p in enumerate(pools)]
    return "".join(p[int.from_bytes(a, "big") % len(p)] if p else value[i] for i, (p, a) in enumerate(zip(pools, at)))


def _broad(c: str) -> str:
    """All letters of a letter's script and case (Latin ones where it has no alphabet here), all digits for a digit."""
    if c.isdigit():
        return _POOLS[0]
    alphabet = _ALPHABET[_script(c)] if c.isalpha() else ""
    return alphabet.upper() if c.isupper() else alphabet


def _wider(key: bytes, tweak: str, value: str, more: int, kept: int = 0) -> str:
    """``value`` drawn anew but for its first ``kept`` characters, with ``more`` letters of its script after it."""
    pools = ["" if i < kept else _broad(c) for i, c in enumerate(value)]
    pools = pools if any(pools) else [""] * kept + [_ALPHABET["latin"]] * (len(value) - kept)
    return _drawn(key, tweak, value, pools + [_ALPHABET[_script(value)]] * more)


def _script(word: str) -> str:
    """The alphabet that letters are added from."""
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def canonical(kind: str, text: str) -> str:
    """What all ways to write an entity have in common."""
    if kind in ("card", "ssn", "phone"):
        digits = "".join(c for c in text if c.isdigit())
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return text.replace(" ", "").lower()
    if kind == "ip6":
        return ":".join(f"{int(g, 16):x}" for g in ipaddress.ip_address(text).exploded.split(":"))
    if kind == "surname" or kind.startswith("given"):
        return unicodedata.normalize("NFC", text.lower()).replace("ς", "σ")
    return text if kind in ("key", "secret", "ip") else text.lower()


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a canonical value; another one for each attempt, longer ones from NARROW on."""
    tweak = f"{kind}\0{attempt}"
    more = max(0, attempt - NARROW + 1)
    extra = lambda pool: _drawn(key, tweak, value, [pool] * more)
    if kind == "email":
        local, domain = value.split("@")
        labels, top = domain.rsplit(".", 1)
        return f"{_word(key, tweak, local)}{extra(_ALPHABET['latin'])}@{_word(key, tweak + 'domain', labels)}.{top}"
    if kind == "ip":
        private = lambda n: n >> 24 in (0, 10, 127) or n >> 24 >= 224 or n >> 16 in (0xA9FE, 0xC0A8) or n >> 20 == 0xAC1
        n = own = int.from_bytes(bytes(map(int, value.split("."))), "big")
        while True:
            n = permute(key, tweak, n, 1 << 32)
            if private(n) == private(own):
                return ".".join([*map(str, n.to_bytes(4, "big")), *extra(_POOLS[0])])
    if kind == "card":
        valid, body = luhn(value), value[1:-1]
        if valid:
            out = value[0] + _shuffled(key, tweak + "valid", body, [_POOLS[0]] * len(body)) + extra(_POOLS[0])
            return next(out + d for d in _POOLS[0] if luhn(out + d))
        out = value
        while True:
            out = value[0] + _shuffled(key, tweak, out[1:], [_POOLS[0]] * (len(out) - 1))
            if not luhn(out):
                return next(x for d in _POOLS[0] if not luhn(x := out + extra(_POOLS[0])[1:] + d)) if more else out
    if kind in ("phone", "ssn"):
        ten = kind == "phone" and len(value) == 10
        good = lambda s: s[0] != "0" and not (ten and (s[0] < "2" or s[3] < "2"))
        out, wanted = value, good(value)
        while True:
            out = _shuffled(key, tweak, out, [_POOLS[0]] * len(out))
            if (not wanted or good(out)) and not (more == 1 and len(out) == 10 and out[0] == "1"):  # that would be read without its 1
                return out + extra(_POOLS[0])
    if kind == "iban":
        n = [(_POOLS[0] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz") for c in value[4:]]
        body = _shuffled(key, tweak, value[4:], n) + extra(_POOLS[0])
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "ip6":
        # the first group tells what the address is for; zero groups stay until a format is exhausted
        groups = value.split(":")
        groups = groups[:1] + ["1000" if more and g == "0" else g for g in groups[1:]]
        pools = [("" if i == 0 or g == "0" else _HEX[1:] if j == 0 else _HEX) for i, g in enumerate(groups) for j in range(len(g))]
        flat = _shuffled(key, tweak + ":".join(map(str, map(len, groups))), "".join(groups), pools) if not more else _drawn(key, tweak, "".join(groups), pools)
        at = [sum(map(len, groups[:i])) for i in range(9)]
        return ":".join(flat[a:b] for a, b in zip(at, at[1:]))
    if kind == "given":
        place = _GENDER[_plain(value)]
        names = sorted({_plain(n) for n in _GIVEN[place]})
        return names[permute(key, f"given{place}", names.index(_plain(value)), len(names))]
    if kind.startswith("given-"):
        script = _script(value)
        return _word(key, f"{kind}\0{script}", value) + _ENDINGS[script, kind[-1]]
    if kind == "surname":
        return _wider(key, tweak, value, more) if more else _word(key, f"{tweak}\0{_script(value)}", value)
    if kind == "secret" and all(c in _HEX for c in value):
        return _shuffled(key, tweak, value, [_HEX] * len(value)) + extra(_HEX)
    fixed = 4 if kind == "key" and value[:4] in ("AKIA", "ASIA") else 3 if kind == "key" else 0
    if more or any(c.isalnum() and not c.isascii() for c in value) or not any(c.isalnum() for c in value[fixed:]):
        return _wider(key, tweak, value, more, fixed)
    pools = ["" if i < fixed else _POOLS[0] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "" for i, c in enumerate(value)]
    return _shuffled(key, tweak, value, pools)


def render(kind: str, text: str, value: str) -> str:
    """A surrogate written as the entity was: its separators, its case."""
    if kind in ("email", "ip", "key", "secret"):
        if kind != "email":
            return value
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text, value)) if len(text) == len(value) else value
    if kind == "surname" or kind.startswith("given"):
        if len(text) > 1 and text.isupper():
            return value.upper()
        value = value[:-1] + "ς" if value.endswith("σ") else value
        return value[:1].upper() + value[1:] if text[:1].isupper() else value
    if kind == "ip6":
        short = str(ipaddress.ip_address(value)) if "::" in text else value
        return short.upper() if text.upper() == text and text.lower() != text else short
    places = [i for i, c in enumerate(text) if c.isalnum()]
    out, own = list(text), value[: len(places)]
    for i, c in zip(places[len(places) - len(own) :], own):
        out[i] = c.upper() if text[i].isupper() else c
    return "".join(out) + value[len(places) :]


def replace(key: bytes, text: str, attempts: dict[tuple[str, str], int], known=None) -> tuple[str, int]:
    """The text with its entities replaced, and their number."""
    spans = find(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for start, end, kind in spans:
        own = text[start:end]
        value = canonical(kind, own)
        out += [text[at:start], render(kind, own, (known or surrogate)(key, kind, value, attempts.get((kind, value), 0)))]
        at = end
    return "".join(out) + text[at:], len(spans)


@lru_cache(maxsize=100_000)
def _cached(key: bytes, kind: str, value: str, attempt: int) -> str:
    return surrogate(key, kind, value, attempt)


_ENTITY = "kind string, value string, attempt int, surrogate string"


def _entities(key: bytes):
    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            found = {(kind, canonical(kind, t[a:b])) for t in batch.column("text").to_pylist() if t for a, b, kind in find(t) if not kind.startswith("given")}
            rows = [(k, v, 0, _cached(key, k, v, 0)) for k, v in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["kind", "value", "attempt", "surrogate"])

    return run


def _again(key: bytes):
    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_cached(key, r["kind"], r["value"], r["attempt"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("kind", "value", "attempt")] + [pa.array(made, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def collision_free(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) of every distinct entity of the corpus: no surrogate is an entity or shared."""
    now = materialize(docs.select("text").mapInArrow(_entities(key), _ENTITY).dropDuplicates(["kind", "value"]), "entities")
    for _ in range(MOST_ROUNDS):
        real = now.select("kind", F.col("value").alias("surrogate")).withColumn("real", F.lit(True))
        shared = now.groupBy("kind", "surrogate").agg(F.min("value").alias("keeps"))
        marked = now.join(real, ["kind", "surrogate"], "left").join(shared, ["kind", "surrogate"])
        marked = marked.withColumn("bad", F.coalesce("real", F.lit(False)) | (F.col("keeps") != F.col("value")))
        if marked.where("bad").isEmpty():
            return now
        redone = marked.where("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_again(key), _ENTITY)
        after = materialize(marked.where("not bad").select("kind", "value", "attempt", "surrogate").unionByName(redone), "entities")
        discard(now)
        now = after
    raise RuntimeError("surrogates still collide")


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; without one, a random key that is kept there for this session."""
    if not (found := spark.conf.get(KEY_SETTING, None)):
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return bytes.fromhex(found)


def anonymise(docs: DataFrame, key: bytes | None = None, count_column: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``count_column``, also how many entities were replaced.

    Without a key, that of the session is used.
    """
    key = session_key(docs.sparkSession) if key is None else key
    if not key:
        raise ValueError("surrogates need a key")
    names = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])  # our own columns cannot clash with the caller's
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    kinds = collision_free(held.select(F.col(f"c{text}").alias("text")), key)
    exceptions = kinds.where("attempt > 0")
    few = exceptions.limit(EXCEPTIONS_MOST + 1).collect()
    if len(few) <= EXCEPTIONS_MOST:
        attempts, rows = {(r.kind, r.value): r.attempt for r in few}, held
    else:
        attempts, rows = None, _with_exceptions(held, f"c{text}", exceptions, key)

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, f"c{text}"):
            own = [{(a["kind"], a["value"]): a["attempt"] for a in x or []} for x in batch.column("attempts").to_pylist()] if attempts is None else None
            done = [(None, 0) if t is None else replace(key, t, attempts if own is None else own[i], _cached) for i, t in enumerate(batch.column(f"c{text}").to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[text] = pa.array([t for t, _ in done], pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t, _ in done], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns + [pa.array([n for _, n in done], pa.int32())], names=[*(f"c{i}" for i in range(len(names))), "found"])

    out = rows.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("found", T.IntegerType())]))
    return out.toDF(*names, count_column) if count_column else out.drop("found").toDF(*names)


def _with_exceptions(held: DataFrame, text: str, exceptions: DataFrame, key: bytes) -> DataFrame:
    """Rows with the exceptions that their own text has."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            rows = [(m, k, v) for m, t in zip(batch.column("mark").to_pylist(), batch.column("text").to_pylist()) if t for k, v in {(kind, canonical(kind, t[a:b])) for a, b, kind in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["mark", "kind", "value"])

    mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = held.select(mark.alias("mark"), F.col(text).alias("text")).mapInArrow(run, "mark string, kind string, value string").distinct()
    lists = own.join(exceptions.select("kind", "value", "attempt"), ["kind", "value"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("attempts"))
    return held.withColumn("mark", mark).join(lists, "mark", "left").drop("mark")
