"""Detection of personal data and secrets, and their replacement by keyed surrogates.

A surrogate has its entity's type and format: digits stay digits, letters keep their script
and case, separators stay, a card number and an IBAN keep their check digits' validity, an
address of a private network stays in it, a known given name becomes one of the same gender
and script, a surname one of keyed syllables of its script that keeps a gendered ending.
The value of an entity, a mixed-radix number x below N, is mapped by a keyed Feistel
permutation P to P'(P(x) + 1 mod N), P' being the inverse.  That map is one-to-one and has
no fixed point, so different entities of a format never share a surrogate, equal ones always
do, in any document and on any executor, and nothing keeps its value; ``collisions`` checks
just that over a corpus.  Case and separators do not take part in x: one number written in
two ways gets the same digits in both.  Later and earlier mentions of a name found in a text,
by its given name or surname alone, get the same surrogates.

Entities are looked for around anchors (an @, a word's beginning, a digit) within the lengths
that their formats allow, so the time grows in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm._spark import dealt, stash
from strandlake.llm._text import column_bytes, slices

# Given names by gender and script.
NAMES = {
    ("f", "latin"): "Anna Maria Emma Sophie Laura Julia Sarah Clara Elena Lucia Carmen Isabel Camille Chloe Ingrid Greta Helen Alice Nora Irene Mary Patricia Jennifer Linda Elizabeth Susan Jessica Karen Nancy Lisa Margaret Emily Michelle Amanda Fatima Aisha Marta Ana".split(),
    ("m", "latin"): "John Peter Thomas Michael David Daniel Lucas Martin Paul Simon Carlos Diego Miguel Pierre Louis Hans Karl Oskar Henry George James Robert William Richard Joseph Charles Christopher Matthew Anthony Andrew Ahmed Mohammed Omar Juan Luis Antonio Jean Jacques".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Дарья".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Олег".split(),
}
_NAME_OF = {n: (kind, i) for kind, names in NAMES.items() for i, n in enumerate(names)}
# What a surname may follow, and endings of surnames by gender.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Sr Sra г-н г-жа".split()
ENDINGS = ("ова", "ева", "ёва", "ина", "ая", "ов", "ев", "ёв", "ин", "ий", "ska", "ski", "ová")

# Letters that replace each other, lower case; upper case follows the lower.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâäãåæçèéêëìíîïñòóôöõøùúûüýœß",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "αβγδεζηθικλμνξοπρσςτυφχψω",
    "אבגדהוזחטיכלמנסעפצקרשת",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
]
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
CYRILLIC = ALPHABETS[3]
_RANGES = [(0x3041, 86), (0x30A1, 86), (0x4E00, 20902), (0xAC00, 11172)]  # kana, Han, Hangul

# Consonants and vowels of which surnames are made, as many in each script.
SYLLABLES = {"latin": ("bdfghjklmnprstvz", "aeiou"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоу")}

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAPITAL = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЁ"
#: The longest local part and domain of an address.
LOCAL, DOMAIN = 64, 253
#: A longer secret is replaced in parts of so many characters; the longest surname.
LONGEST, LONGEST_NAME = 256, 64
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}")
_LOCAL = re.compile(r"[^\W_](?:[\w.+%-]*\w)?\Z")
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[A-F]*[0-9])[0-9A-F]{32,})(?![A-Za-z0-9])"
    r"|(?i:(?<=token = \")|(?<=token=\")|(?<=secret = \")|(?<=api_key = \")|(?<=password = \"))[^\s\"]{8,}(?=\")"
)
NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.[0-9])"
    r"|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\w:]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w.+-])[0-9]{4}(?:([ -]?)[0-9]{4})(?:\4[0-9]{4})(?:\4[0-9]{1,7})(?![\w]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w])|(?<![\w.])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![\w])"
    r"|(?<![\w.,+-])(?=(?:[ /-]?[0-9]){9,13}(?![\w]))0[0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,8}){0,3}(?![\w]))"
)
#: A capitalised word before another, or a title; the surname is looked at in code.
_FULL = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?=[{_CAPITAL}])|(?<!\w)(?P<given>[{_CAPITAL}][^\W\d_]*) (?:[A-Z]\. )?(?=[{_CAPITAL}])")
_SURNAME = re.compile(_WORD)
#: Bytes of which at least one occurs in every entity but a name, and a secret that _PLAIN begin.
_MARKS = np.zeros(256, bool)
_MARKS[[*range(48, 58), 64, 61, 95]] = True
_PLAIN = ("AKIA", "sk-")


class Permutation:
    """A keyed one-to-one map of 0..n-1 without fixed points (n of 2 or more)."""

    ROUNDS = 6

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self._key = blake2b(kind.encode() + b"\0" + str(n).encode(), key=key[:64], digest_size=32).digest()

    def _mix(self, r: int, x: int) -> int:
        size = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += blake2b(bytes([r, block]) + x.to_bytes(size, "big"), key=self._key, digest_size=min(64, max(8, size))).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & self.mask

    def _walk(self, x: int, rounds: list[int], back: bool) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in rounds:
                a, b = (b ^ self._mix(r, a), a) if back else (b, a ^ self._mix(r, b))
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        ahead = self._walk(x, list(range(self.ROUNDS)), False)
        return self._walk((ahead + 1) % self.n, list(range(self.ROUNDS))[::-1], True)


def _slots(text: str) -> list[tuple[int, int, int, bool, str | int]]:
    """(position, radix, digit, upper case, alphabet or first code point) of replaceable characters."""
    out = []
    for i, c in enumerate(text):
        low = c.lower()
        if low in _PLACE:
            alphabet, digit = _PLACE[low]
            out.append((i, len(alphabet), digit, c != low, alphabet))
            continue
        for first, count in _RANGES:
            if first <= ord(c) < first + count:
                out.append((i, count, ord(c) - first, False, first))
    return out


class Surrogates:
    """Keyed surrogates of entities."""

    def __init__(self, key: bytes):
        self._key = key
        self._permutation = lru_cache(maxsize=4096)(lambda kind, n: Permutation(key, kind, n))
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _permuted(self, kind: str, text: str, fixed: frozenset[int] = frozenset()) -> str:
        slots = [s for s in _slots(text) if s[0] not in fixed]
        n, x = 1, 0
        for _, radix, digit, _, _ in slots:
            n, x = n * radix, x * radix + digit
        if n < 2:
            return text
        form = "".join(str(ALPHABETS.index(s[4])) if isinstance(s[4], str) else chr(s[4]) for s in slots)
        y = self._permutation(f"{kind}:{form}", n)(x)
        chars = list(text)
        for i, radix, _, upper, alphabet in reversed(slots):
            y, digit = divmod(y, radix)
            c = alphabet[digit] if isinstance(alphabet, str) else chr(alphabet + digit)
            chars[i] = (c.upper() if len(c.upper()) == 1 else c) if upper else c
        return "".join(chars)

    def _of(self, kind: str, text: str) -> str:
        """The surrogate of an entity."""
        if kind == "name":
            group, i = _NAME_OF[text if text in _NAME_OF else text.capitalize()]
            new = NAMES[group][self._permutation("name" + "".join(group), len(NAMES[group]))(i)]
            return new.upper() if text.isupper() and len(text) > 1 else new
        if kind == "surname":
            return re.sub(r"[^\W\d_]+", lambda m: self._surname(m[0]), text)
        if kind == "email":
            end = text.rindex(".")
            return self._permuted(kind, text, frozenset(range(end, len(text))))
        if kind == "card":
            return self._card(text)
        if kind == "ip":
            return self._ip(text) if ":" not in text else self._ip6(text)
        if kind == "phone" and text.startswith("+"):
            return self._permuted(kind, text, frozenset(range(2)))
        if kind == "phone" and text.startswith("0"):
            return self._permuted(kind, text, frozenset(range(1)))
        if kind == "iban":
            return self._iban(text)
        if kind == "secret" and len(text) > LONGEST:
            return "".join(self._of(kind, text[i : i + LONGEST]) for i in range(0, len(text), LONGEST))
        if kind == "secret" and re.fullmatch("[0-9a-fA-F]+", text):
            n = 16 ** len(text)
            out = format(self._permutation("hex", n)(int(text, 16)), f"0{len(text)}x")
            return out.upper() if text.upper() == text else out
        if kind == "secret":
            head = re.match(r"AKIA|gh[pousr]_|sk-", text)
            return self._permuted(kind, text, frozenset(range(head.end() if head else 0)))
        return self._permuted(kind, text)

    def _surname(self, word: str) -> str:
        """One part of a surname: syllables that number all words of as many syllables, with a
        closing letter where the word has others than the script's first alphabet has.  A
        single letter, as in O'Brien, stays."""
        low = word.lower()
        if len(word) < 2:
            return word
        ending = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")
        stem = low[: len(low) - len(ending)]
        script = "cyrillic" if any(c in CYRILLIC for c in low) else "latin"
        plain = CYRILLIC if script == "cyrillic" else ALPHABETS[1]
        letters = plain if all(c in plain for c in stem) else ALPHABETS[1] + ALPHABETS[2]
        if not all(c in letters for c in stem):
            return self._permuted("surname", word)  # another script, or several
        a, (consonants, vowels) = len(letters), SYLLABLES[script]
        per = len(consonants) * len(vowels)
        x = 0
        for c in stem:
            x = x * a + letters.index(c) + 1  # bijective, so that lengths differ
        count, below = 1, per
        while below <= x:
            count, below = count + 1, below * per
        first = below // per if count > 1 else 0
        y = first + self._permutation(f"surname:{script}{a}{ending}", below - first)(x - first)
        out = ""
        for _ in range(count):
            y, z = divmod(y, per)
            out = consonants[z // len(vowels)] + vowels[z % len(vowels)] + out
        out += ("" if letters is plain else consonants[8]) + ending
        return out.upper() if word.isupper() else out.capitalize() if word[0].isupper() else out

    def _iban(self, text: str) -> str:
        """Country and format stay; a valid number gets valid check digits."""
        chars = [c for c in text if c != " "]
        if _iban_rest(chars) == 1 and 2 <= int("".join(chars[2:4])) <= 98:
            body = self._permuted("iban", "".join(chars[4:]))
            fresh = [*chars[:2], *f"{98 - _iban_rest([*chars[:2], '0', '0', *body]):02d}", *body]
        else:
            fresh = list(self._permuted("iban?", "".join(chars), frozenset(range(2))))
            while _iban_rest(fresh) == 1 and 2 <= int("".join(fresh[2:4])) <= 98:
                fresh = list(self._permuted("iban?", "".join(fresh), frozenset(range(2))))
        it = iter(fresh)
        return "".join(c if c == " " else next(it) for c in text)

    def _ip6(self, text: str) -> str:
        """The first group and the lengths of the others stay."""
        head, rest = text.split(":", 1)
        digits = rest.replace(":", "")
        fresh = iter(format(self._permutation("ip6", 16 ** len(digits))(int(digits, 16)), f"0{len(digits)}x"))
        out = "".join(c if c == ":" else next(fresh) for c in rest)
        return f"{head}:{out.upper() if text.upper() == text else out}"

    def _card(self, text: str) -> str:
        digits = [c for c in text if c.isdigit()]
        body, last = digits[:-1], int(digits[-1])
        new = self._permutation("card", 10 ** len(body))(int("".join(body)))
        fresh = str(new).zfill(len(body))
        shift = (last - _luhn("".join(body))) % 10
        fresh += str((_luhn(fresh) + shift) % 10)
        it = iter(fresh)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def _ip(self, text: str) -> str:
        a, b, c, d = (int(x) for x in text.split("."))
        x = a << 24 | b << 16 | c << 8 | d
        for size, net in ((24, 10 << 24), (20, 172 << 24 | 16 << 16), (16, 192 << 24 | 168 << 16), (24, 127 << 24)):
            if x >> size == net >> size:
                y = net | self._permutation(f"ip{net}", 1 << size)(x & ((1 << size) - 1))
                break
        else:
            permute = self._permutation("ip", 1 << 32)
            y = permute(x)
            while any(y >> s == n >> s for s, n in ((24, 10 << 24), (20, 172 << 24 | 16 << 16), (16, 192 << 24 | 168 << 16), (24, 127 << 24))):
                y = permute(y)  # walks along the cycle, which stays one-to-one
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def _luhn(body: str) -> int:
    """The check digit of a card number's other digits."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(chars: list[str]) -> int:
    """The remainder by 97 that is 1 in a valid number."""
    return int("".join(str(int(c, 36)) for c in [*chars[4:], *chars[:4]])) % 97


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and at - begin < LOCAL and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-"):
            begin -= 1
        local = _LOCAL.search(text, begin, at)
        domain = _DOMAIN.match(text, at + 1, at + 1 + DOMAIN) if local else None
        if domain:
            yield local.start(), domain.end()
        at = text.find("@", domain.end() if domain else at + 1)


def _known(word: str) -> bool:
    return word in _NAME_OF or (word.isupper() and word.capitalize() in _NAME_OF)


def _names(text: str) -> Iterator[tuple[str, int, int]]:
    """Given names of NAMES with the surname after them, surnames after titles, and all
    mentions of either alone in a text that has them."""
    found: dict[str, str] = {}
    places = []
    for m in _FULL.finditer(text):
        given = m["given"]
        if given and not _known(given):
            continue
        begin, end = _span(_SURNAME.match(text, m.end()))
        last = text[begin:end]
        if not 2 <= len(last) <= LONGEST_NAME or (given is None and _known(last)):
            continue
        if given:
            places.append((m.start("given"), m.end("given"), "name"))
            found[given] = "name"
        places.append((begin, end, "surname"))
        found.setdefault(last, "surname")
    if not found:
        return
    at = {p[0]: p for p in places}
    for m in _SURNAME.finditer(text):
        begin, end = _span(m)
        if begin in at:
            begin, end, kind = at[begin]
            yield kind, begin, end
        elif kind := found.get(text[begin:end]):
            yield kind, begin, end


def _span(m: re.Match) -> tuple[int, int]:
    """Where a word stands without a possessive ending."""
    return m.start(), m.end() - (2 if m[0][-2:] in ("'s", "’s", "'S", "’S") else 0)


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, in order, without overlaps: of two that
    overlap the one that begins first stays, then the one of the kind named first."""
    found = [(a, 0, b, "email") for a, b in _emails(text)]
    found += [(m.start(), 1, m.end(), "secret") for m in SECRET.finditer(text)]
    found += [(m.start(), 2, m.end(), m.lastgroup) for m in NUMBERS.finditer(text)]
    found += [(a, 3, b, kind) for kind, a, b in _names(text)]
    out, end = [], 0
    for a, _, b, kind in sorted(found):
        if a >= end:
            out.append((kind, a, b))
            end = b
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and (kind, start, length, original, surrogate) of each."""
    out, at, spans = [], 0, []
    for kind, start, end in entities(text):
        new = surrogates.of(kind, text[start:end])
        out += [text[at:start], new]
        spans.append((kind, start, end - start, text[start:end], new))
        at = end
    return "".join([*out, text[at:]]), spans


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("original", T.StringType()), T.StructField("surrogate", T.StringType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("original", pa.string()), ("surrogate", pa.string())]))


def replace_private(docs: DataFrame, key: bytes, keep: list[str] | None = None, spans: str | None = "entities") -> DataFrame:
    """docs with surrogates in text, and, unless ``spans`` is None, a column of that name
    with array<struct<kind, start, length, original, surrogate>> (places in the old text).

    A null text stays null, an empty one empty; texts without entities stay as they are;
    repeated rows are treated alike; an empty table gives no rows; other columns stay,
    unless ``keep`` names fewer, but one named as ``spans`` is replaced.  Whole texts are
    searched, one at a time, in time proportional to their lengths.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != spans]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *([T.StructField(spans, SPAN)] if spans else [])])
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in slices(batches):
            at = batch.schema.get_field_index
            column = batch.column(at("text"))
            buf, off = column_bytes(column)
            marks = np.concatenate([[0], np.cumsum(_MARKS[buf])])
            marked = marks[off[1:]] > marks[off[:-1]]
            changed: dict[int, tuple[str, list]] = {}
            for i in range(len(column)):
                text = column[i].as_py()
                if text and (marked[i] or any(x in text for x in _PLAIN) or _may_name(text)):
                    new, found = replace(text, surrogates)
                    if found:
                        changed[i] = (new, found)
            out = {c: batch.column(at(c)) for c in keep}
            if changed and "text" in out:
                texts = column.to_pylist()
                for i, (new, _) in changed.items():
                    texts[i] = new
                out["text"] = pa.array(texts, column.type)
            if spans:
                empty: list = []
                out[spans] = pa.array([[dict(zip(("kind", "start", "length", "original", "surrogate"), x, strict=True)) for x in changed[i][1]] if i in changed else empty for i in range(len(column))], _SPAN)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return dealt(source).mapInArrow(run, schema)


def _may_name(text: str) -> bool:
    return any(m["given"] is None or _known(m["given"]) for m in _FULL.finditer(text))


#: Kinds whose separators do not take part in their value.
SPACED = ("phone", "card", "iban", "ssn")


def collisions(replaced: DataFrame, spans: str = "entities") -> DataFrame:
    """Entities against the promise: (kind, value, fault) of surrogates of several originals
    that differ in more than case and separators ("shared"), or of originals with several
    surrogates ("split").  It should be empty."""
    bare = lambda c: F.when(F.col("e.kind").isin(*SPACED), F.lower(F.regexp_replace(c, r"[\s().+/-]", ""))).otherwise(F.lower(c))
    rows = replaced.select(F.explode(spans).alias("e")).select("e.kind", bare("e.original").alias("original"), bare("e.surrogate").alias("surrogate")).distinct()
    shared = rows.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("surrogate").alias("value"), F.lit("shared").alias("fault"))
    split = rows.groupBy("kind", "original").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("original").alias("value"), F.lit("split").alias("fault"))
    return shared.union(split)


def count_collisions(replaced: DataFrame, spans: str = "entities", name: str = "n_collisions") -> DataFrame:
    """replaced with the number of each row's entities that are in ``collisions`` of all rows."""
    replaced = stash(replaced)
    faults = stash(collisions(replaced, spans))
    if faults.isEmpty():
        return replaced.withColumn(name, F.lit(0).cast("long"))
    bare = lambda c: F.when(F.col("kind").isin(*SPACED), F.lower(F.regexp_replace(c, r"[\s().+/-]", ""))).otherwise(F.lower(c))
    key = F.md5(F.to_json(spans))
    each = replaced.where(F.size(spans) > 0).select(key.alias("_key"), spans).dropDuplicates(["_key"]).select("_key", F.posexplode(spans).alias("at", "e")).select("_key", "at", "e.*")
    one = each.select("_key", "at", "kind", F.explode(F.array(F.struct(F.lit("shared").alias("fault"), bare("surrogate").alias("value")), F.struct(F.lit("split").alias("fault"), bare("original").alias("value")))).alias("f"))
    hit = one.select("_key", "at", "kind", "f.*").join(faults, ["kind", "value", "fault"], "left_semi").groupBy("_key").agg(F.countDistinct("at").alias(name))
    return replaced.withColumn("_key", key).join(hit, "_key", "left").select(*replaced.columns, F.coalesce(name, F.lit(0).cast("long")).alias(name))
