"""Surrogates for personal data: detected entities get keyed replacements of their own kind.

A surrogate follows from the key and the entity alone, so every mention of an entity gets the same one wherever it
stands. It keeps the entity's format: digits for digits with the separators in place, a valid check digit where there was
one, the network class of an address, the script and the case of letters, the script of digits, and the gender of a
name. Surrogates of numbers are permutations of their domain without fixed points. Over all documents, Spark then checks
that no two entities share a surrogate and that none is itself an entity of the corpus; the few that do get another.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, slices

#: Entities with another than their first surrogate go to the tasks as a table up to so many; beyond it, by a join.
BROADCAST = 200_000
#: Surrogates that are tried before an entity of a crowded number space falls back on its first one.
ROUNDS = 8
#: Kinds whose first surrogates are a permutation of their domain, and so differ from each other.
PERMUTED = ("ipv4", "ipv6", "card", "ssn", "phone")
#: Alphabets of scripts; letters of others stand for letters of the same kind and block of 64 code points.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")

#: Titles before names, by gender.
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Frau|Mme|Mlle|Madame|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|г-жа|госпожа"
NEUTRAL = "Dr|Prof|Mx"
#: Given names that tell a gender.
GIVEN_MALE = frozenset("james john robert michael william david richard joseph thomas charles daniel peter paul hans karl jürgen pierre jean jacques luc juan josé carlos luis miguel иван пётр сергей".split())
GIVEN_FEMALE = frozenset("mary patricia jennifer linda elizabeth barbara susan sarah anna emma maria julia claire marie sophie camille ana lucía carmen elena petra ursula анна мария елена".split())
#: Syllables of made-up names by script, and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za ze".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве за зе".split(),
    "greek": "βα βε βο γα δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {
    ("latin", "male"): "bert dor lon mus rik win".split(), ("latin", "female"): "lina nella ria sandra tessa vina".split(), ("latin", ""): "ley man ner son ton ver".split(),
    ("cyrillic", "male"): "дор мир слав тин".split(), ("cyrillic", "female"): "лина рия сана вина".split(), ("cyrillic", ""): "нов рин сен тов".split(),
    ("greek", "male"): "νος ρος τας".split(), ("greek", "female"): "λια νη ρα".split(), ("greek", ""): "δης κος πουλος".split(),
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = r"[^\W\d_](?:[^\W\d_]|-(?=[^\W\d_])|['’](?=[^\W\d_])(?!s(?!\w)))+"

EMAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]++(?<![.])@(?:[\w\-]+\.)+[^\W\d_]{2,}")
NUMBERS = re.compile(
    rf"""(?<![\w.])(?P<ipv4>(?:{OCTET}\.){{3}}{OCTET})(?!\w|\.\w)
    |(?<![\w:])(?P<ipv6>(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:])
        |(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})?::(?:(?:[0-9A-Fa-f]{{1,4}}:){{0,6}}(?:(?:{OCTET}\.){{3}}{OCTET}|[0-9A-Fa-f]{{1,4}}))?(?!\w|:[\w:]|\.\w))
    |(?<![\w])(?P<iban>[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?!\w)
    |(?<![\w\-])(?P<card>\d{{4}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}|3\d{{3}}[ \-]\d{{6}}[ \-]\d{{4,5}})(?![\w\-])
    |(?<![\w\-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w\-])
    |(?<![\w+])(?P<phone>\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{1,4}}(?:[ .\-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ ]?\d{{3}}[ .\-]\d{{4}}|\d{{3}}(?P<gap>[ .\-])\d{{3}}(?P=gap)\d{{4}})(?!\w|[.\-]\d)""",
    re.X,
)
SECRET = re.compile(
    r"""(?i:(?:token|secret|password|passwd|pwd|api[_\- ]?key|access[_\- ]?key|auth[_\- ]?key)["']?\s*[:=]\s*["']?)(?P<value>[A-Za-z0-9_\-./+]{12,}=*)
    |(?<![A-Za-z0-9])(?P<bare>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,})(?![A-Za-z0-9])""",
    re.X,
)
#: A label with its value: all between quotes, or all up to a blank or to the next label; closing signs at its end are cut off by open_end.
LABELLED = re.compile(
    r"""(?i:(?P<plain>password|passwd|pwd|api[_\- ]?key|access[_\- ]?key|auth[_\- ]?key)|token|secret)["']?\s*[:=]\s*
    (?:(?P<q>["'])(?P<quoted>[^\n]+?)(?P=q)|(?P<open>(?:[^\s"'<>&,;]|&(?!\w+=)|[,;](?!["']?\w+["']?[:=]))+))""",
    re.X,
)
CLOSING = ".,;:)]}"
LONG_SECRET = re.compile(r"[A-Za-z0-9_\-./+]{12,}=*")
DIGIT, OTHER_DIGIT = re.compile(r"\d"), re.compile(r"(?![0-9])\d")
TITLED = re.compile(rf"(?<!\w)(?P<title>(?P<male>{MALE})|(?P<female>{FEMALE})|{NEUTRAL})(?!\w)\.?(?:[ \u00a0]+|[ \u00a0]*\r?\n[ \u00a0]*)")
NAMES = re.compile(NAME)
WORD, PART = re.compile(rf"(?<!\w){NAME}(?!\w)"), re.compile(r"[^\W\d_]+")
TITLES = frozenset(f"{MALE}|{FEMALE}|{NEUTRAL}".split("|"))


def names_after(text: str, at: int) -> list[re.Match[str]]:
    """The capitalised words in a row from a place on, with a blank between two, up to the next title."""
    found = []
    while (m := NAMES.match(text, at)) and m[0][0].isupper() and m[0] not in TITLES:
        found.append(m)
        at = m.end() + 1
        if text[m.end() : at] not in (" ", "\u00a0"):
            break
    return found


def open_end(text: str, begin: int, end: int) -> int:
    """Where an unquoted value ends: before the signs that close a sentence or bracket, if a blank or nothing follows them."""
    if end < len(text) and not text[end].isspace():
        return end
    while end > begin and text[end - 1] in CLOSING:
        end -= 1
    return end


def luhn(digits: str) -> int:
    """The check digit that makes digits valid."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(text: str) -> int:
    """The number modulo 97 of an IBAN: 1 if valid."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


@functools.cache
def _digit_table() -> dict[int, int]:
    """Each decimal digit outside 0-9 with the one that it means."""
    return {k: 48 + d for k in range(128, sys.maxunicode + 1) if (d := unicodedata.decimal(chr(k), -1)) >= 0}


def plain_digits(text: str) -> str:
    """The text with digits of any script as 0-9, place by place."""
    return text.translate(_digit_table()) if not text.isascii() and OTHER_DIGIT.search(text) else text


@functools.cache
def alphabet(letter: str) -> str:
    """The letters that may stand for a letter without case or in lower case."""
    for known in ALPHABETS:
        if letter in known:
            return known
    base, kind = ord(letter) & ~63, unicodedata.category(letter)
    return "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and x.lower() == x) or letter


def people(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, and their other mentions in the text. A form has one kind and gender in a text.

    It is a given name where a title's names go on after it, or by the list of given names; else a family name. The
    gender of a given name is that of its first title that has one, else that of the lists.
    """
    mentions: list[tuple[int, int, str]] = []
    given: set[str] = set()
    gender: dict[str, str] = {}
    forms: set[str] = set()
    for m in TITLED.finditer(text):
        names = names_after(text, m.end())
        for k, x in enumerate(names):
            form, begin = x[0].casefold(), x.start()
            mentions.append((begin, begin + len(x[0]), form))
            forms.add(form)
            if k < len(names) - 1:
                given.add(form)
            if k < len(names) - 1 or k == 0:
                said = "male" if m["male"] else "female" if m["female"] else ""
                gender[form] = gender.get(form) or said
    if not mentions:
        return []
    titled = {x[0] for x in mentions}
    for m in WORD.finditer(text):
        if m[0].casefold() in forms:
            parts = [m.span()]
        else:  # parts of a double name
            parts = [x.span() for x in PART.finditer(text, *m.span())] if not m[0].isalpha() else []
        mentions += [(a, b, text[a:b].casefold()) for a, b in parts if text[a].isupper() and a not in titled and text[a:b].casefold() in forms]
    out = []
    for begin, end, form in mentions:
        listed = "male" if form in GIVEN_MALE else "female" if form in GIVEN_FEMALE else ""
        kind = f"given-{gender.get(form) or listed or 'neutral'}" if form in given or listed else "family"
        out.append((begin, end, kind, form))
    return out


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of the entities in a text, in order and apart from each other.

    The canonical form is what coreference goes by: it leaves out case, separators, formatting and the digits' script.
    """
    text = plain_digits(text or "")
    found: list[tuple[int, int, str, str]] = []
    if any(c in text for c in "=:") or "AKIA" in text or "_" in text or "-" in text:
        for m in SECRET.finditer(text):
            k = "value" if m["value"] else "bare"
            if any(c.isalnum() for c in m[k]):
                found.append((*m.span(k), "secret", m[k]))
        for m in LABELLED.finditer(text):
            k = "quoted" if m["quoted"] else "open"
            begin, end = m.span(k)
            value = text[begin : (end := end if k == "quoted" else open_end(text, begin, end))]
            # after token and secret, which are words of prose too, short plain words stay
            sure = m["plain"] or len(value) >= (4 if k == "quoted" else 12) or len(value) >= 4 and not value.isalpha()
            if sure and any(c.isalnum() for c in value):
                found.append((begin, end, "secret", value))
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in NUMBERS.finditer(text) if "::" in text or DIGIT.search(text) else ():
        plain = re.sub(r"[ .\-()+]", "", m[0])
        kind = next(k for k in ("ipv4", "ipv6", "iban", "card", "ssn", "phone") if m[k])
        if kind == "iban" and iban_check(plain) != 1 or kind == "card" and not 13 <= len(plain) <= 19 or kind == "phone" and not 8 <= len(plain) <= 15:
            continue
        if kind == "ipv6":
            try:
                value = f"{int(ipaddress.IPv6Address(m[0])):032x}"
            except ValueError:
                continue
            if not any(c.isalnum() for c in m[0]):
                continue
            plain = ":".join(value[4 * k : 4 * k + 4] for k in range(8))
        found.append((*m.span(), kind, m[0] if kind == "ipv4" else plain))
    found += people(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class Surrogates:
    """Surrogates under a key. of() is a function of kind, canonical form and attempt alone."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def number(self, *parts: object, below: int) -> int:
        """A keyed number; below may be large."""
        seed = hmac.new(self.key, "\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        size = (below.bit_length() + 71) // 8
        return int.from_bytes(hashlib.shake_256(seed).digest(size), "big") % below

    def mix(self, value: int, radix: int, length: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of the numbers of so many digits, two at least, or its inverse: an alternating Feistel network."""
        left, right = length // 2, length - length // 2
        a, b = divmod(value, radix**right)
        sign = -1 if back else 1
        for k in reversed(range(10)) if back else range(10):
            if k % 2 == 0:
                a = (a + sign * self.number(tweak, k, length, b, below=radix**left)) % radix**left
            else:
                b = (b + sign * self.number(tweak, k, length, a, below=radix**right)) % radix**right
        return a * radix**right + b

    def permute(self, value: int, radix: int, length: int, tweak: str) -> int:
        """A keyed permutation without fixed points: one place further in a keyed order of all numbers of so many digits."""
        if length < 2:
            return (value + 1 + self.number("shift", tweak, below=radix**length - 1)) % radix**length
        return self.mix((self.mix(value, radix, length, tweak) + 1) % radix**length, radix, length, tweak, back=True)

    def digits(self, text: str, tweak: str) -> str:
        return str(self.permute(int(text), 10, len(text), tweak)).zfill(len(text)) if text else ""

    def letters(self, text: str, *tweak: object) -> str:
        """Letters of the same script for letters and digits for digits, one by one."""
        out = []
        for k, c in enumerate(text):
            if c.isdecimal():
                out.append(str(self.number(*tweak, text, k, below=10)))
            elif c.isalpha():
                low = c.lower()
                known = alphabet(low) if len(low) == 1 else ALPHABETS[0]
                x = known[self.number(*tweak, text, k, below=len(known))]
                out.append(x.upper() if c.isupper() and len(x.upper()) == 1 else x)
            else:
                out.append(c)
        return "".join(out)

    def name(self, text: str, gender: str, attempt: int) -> str:
        script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "greek" if any("Ͱ" <= c <= "Ͽ" for c in text) else "latin"
        if script == "latin" and not any("LATIN" in unicodedata.name(c, "") for c in text):  # no made-up names: letter by letter
            return self.letters(text, "name", gender, attempt) + self.letters(text[-1] * (attempt // 2), "more", attempt, text)
        pick = lambda what, n: what[self.number("name", gender, script, text, attempt, n, below=len(what))]
        ending = pick(ENDINGS[script, gender if gender in ("male", "female") else ""], "end")
        return "".join(pick(SYLLABLES[script], k) for k in range(3 + attempt // 2)) + ending

    def of(self, kind: str, text: str, attempt: int = 0) -> str:
        """The surrogate of a canonical form, itself canonical."""
        tweak = f"{kind} {attempt}"
        if kind == "ipv4":
            value = int(ipaddress.IPv4Address(text))
            private = lambda x: (a := ipaddress.IPv4Address(x)).is_private or a.is_multicast or a.is_reserved
            was = private(value)
            for _ in range(100_000):  # walk the permutation's cycle to the next address of the same class
                value = self.permute(value, 2, 32, tweak)
                if private(value) == was:
                    break
            return str(ipaddress.IPv4Address(value))
        if kind == "ipv6":
            parts = text.split(":")
            value = self.permute(int("".join(p.zfill(4) for p in parts), 16), 16, 32, tweak)
            full = f"{value:032x}"
            return ":".join(full[4 * k : 4 * k + 4] for k in range(8))
        if kind == "card":
            if luhn(text[:-1]) == int(text[-1]):
                body = text[0] + self.digits(text[1:-1], tweak)
                return body + str(luhn(body))
            for _ in range(100_000):
                text = text[0] + self.digits(text[1:], tweak)
                if luhn(text[:-1]) != int(text[-1]):
                    return text
        if kind == "iban":
            body = "".join(self.letters(x, tweak, text[4:]) if x.isalpha() else self.digits(x, tweak) for x in re.findall(r"\d+|[A-Z]+", text[4:]))
            return text[:2] + f"{98 - iban_check(text[:2] + '00' + body):02d}" + body
        if kind in ("ssn", "phone"):
            kept = max(0, len(text) - 10)  # the country's prefix
            return text[:kept] + self.digits(text[kept:], tweak)
        if kind == "email":
            local, _, domain = text.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.letters(local, 'local', domain, attempt)}{attempt if attempt > 2 else ''}@{self.letters(host, 'domain')}.{top}"
        if kind == "secret":
            if not LONG_SECRET.fullmatch(text):  # short or with other signs: a drawn one, since a permutation may hit another entity
                made = self.letters("".join(c if c.isascii() or not c.isalnum() else "x" for c in text), "secret", attempt, text)
                return made if attempt < 3 else made + self.letters("x" * (attempt - 2), "more", attempt, text)
            if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
                value = f"{self.permute(int(text, 16), 16, len(text), tweak):x}".zfill(len(text))
                return value.upper() if text.isupper() else value
            lead = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-", text)
            n = lead.end() if lead else 0
            return text[:n] + self.letters(text[n:], "secret", attempt, text)
        return self.name(text, kind.removeprefix("given-"), attempt)


def fit(surrogate: str, kind: str, mention: str) -> str:
    """The canonical surrogate in the format of a mention: its separators, its case, the script of its digits."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(surrogate)
        return "".join(_digit_like(next(left), c) if c.isalnum() else c for c in mention)
    if kind == "family" or kind.startswith("given-"):
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[0].upper() + surrogate[1:]
    if kind == "email" and mention.isupper():
        surrogate = surrogate.upper()
    model = OTHER_DIGIT.search(mention) if not mention.isascii() else None
    return "".join(_digit_like(c, model[0]) for c in surrogate) if model else surrogate


def _digit_like(c: str, model: str) -> str:
    """A digit 0-9 in the script of another digit."""
    return chr(ord(model) - unicodedata.decimal(model) + int(c)) if not model.isascii() and model.isdecimal() and c.isdecimal() else c


def space(kind: str) -> str:
    """Kinds whose forms could be taken for each other share a space."""
    return "name" if kind == "family" or kind.startswith("given-") else kind


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, entity: each distinct canonical form of all documents once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = {(kind, form) for text in batch.column(0).to_pylist() for _, _, kind, form in detect(text)}
            kinds, forms = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["kind", "entity"])

    return docs.select(F.col(text_col)).mapInArrow(run, "kind string, entity string").distinct()


def _with_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in slices(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([space(k) for k, _, _ in rows], pa.string()), pa.array([made.of(k, e, a) for k, e, a in rows], pa.string())], ["kind", "entity", "attempt", "space", "surrogate"])

    return found.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, space string, surrogate string")


def resolve(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, entity, surrogate of the entities that can't have their first surrogate.

    Afterwards all surrogates differ from each other and from all entities. An entity moves on if its surrogate is an
    entity, or another's: of those that share one, the first keeps it. What was tried once is never given out again, so
    each round looks at the moved ones only. In a number space so full that rounds run out, an entity goes back to its
    first surrogate: that is no one else's, but may be an entity of the corpus. Other kinds grow longer until they are free.
    """
    named = (F.col("kind") == "family") | F.col("kind").startswith("given-")
    same, one = ["space", "surrogate"], ["kind", "entity"]
    # one entity under several kinds of a name (a family name that is also a given name) keeps a surrogate for each
    real = durable(found.select(F.when(named, "name").otherwise(F.col("kind")).alias("space"), F.col("entity").alias("surrogate")).distinct(), "real")
    first = now = durable(_with_surrogates(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    tried, settled, attempt = [], [], 0
    while True:
        owner = now.groupBy(*same).agg(F.min(F.struct(*one)).alias("owner"), F.count("*").alias("n")).where("n > 1")
        bad = [now.join(owner, same).where(F.struct(*one) != F.col("owner")), *(now.join(x.select(*same), same) for x in (real, *tried))]
        bad = durable(functools.reduce(DataFrame.union, (x.select(*one) for x in bad)).distinct(), "collisions")
        if attempt:
            settled.append(now.join(bad, one, "left_anti"))
        attempt += 1
        if attempt > rounds:
            crowded = F.col("kind").isin(*PERMUTED)
            settled.append(first.join(bad.where(crowded), one))
            bad = bad.where(~crowded)
        if bad.isEmpty():
            return functools.reduce(DataFrame.union, (x.select(*one, "surrogate") for x in settled), now.limit(0).select(*one, "surrogate"))
        tried.append(now)
        now = durable(_with_surrogates(bad.withColumn("attempt", F.lit(attempt)), key), "surrogates")


def replace(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST) -> DataFrame:
    """id, text with surrogates, n_entities, kinds (map of kind to number), and the columns named in keep.

    Null texts stay null and empty ones empty; texts without entities stay as they are, byte for byte. Null and repeated
    ids and repeated rows give a row each; an empty table gives none; other columns are not read. Texts are scanned whole,
    twice: for the corpus' entities, and to replace them. The scan is cheaper than writing and reading all texts once.
    """
    kinds = dict(docs.dtypes)
    spark = docs.sparkSession
    moved = durable(resolve(durable(entities(docs, text_col), "entities"), key), "moved")
    few = moved.count() <= broadcast_rows
    shared = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["surrogate"] for r in moved.collect()} if few else {})
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    if not few:  # each document gets the attempts of its own entities, by a join on its text
        key_of = F.sha2(F.coalesce("_text", F.lit("")), 256)
        mentioned = rows.select(key_of.alias("_key"), "_text").mapInArrow(_mentions, "_key string, kind string, entity string").distinct()
        own = mentioned.join(moved, ["kind", "entity"]).groupBy("_key").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("_moved"))
        rows = rows.withColumn("_key", key_of).join(own, "_key", "left").select("_id", "_text", *keep, "_moved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cache = Surrogates(key), {}
        for batch in slices(batches):
            listed = batch.column(batch.num_columns - 1).to_pylist() if not few else [None] * batch.num_rows
            texts, n, counts = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), listed, strict=True):
                moved_to = shared.value if few else {(x["kind"], x["entity"]): x["surrogate"] for x in own or ()}
                parts, at, by = [], 0, {}
                for begin, end, kind, form in detect(text):
                    if len(cache) > 100_000:
                        cache.clear()
                    one = (kind, form)
                    if (surrogate := moved_to.get(one)) is None:
                        if one not in cache:
                            cache[one] = made.of(*one)
                        surrogate = cache[one]
                    parts += [text[at:begin], fit(surrogate, kind, text[begin:end])]
                    at, by[kind] = end, by.get(kind, 0) + 1
                texts.append(text if not parts else "".join(parts) + text[at:])
                n.append(sum(by.values()))
                counts.append(sorted(by.items()))
            kept = batch.columns[2 : 2 + len(keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *kept, pa.array(n, pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], [id_col, text_col, *keep, "n_entities", "kinds"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, text_col, *keep)) + ", n_entities long, kinds map<string, long>"
    return rows.mapInArrow(run, schema)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = {(key, kind, form) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, kind, form in detect(text)}
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["_key", "kind", "entity"])


def demo_key() -> bytes:
    """The key of the registered query. A production run passes its own secret."""
    return b"registered query"
