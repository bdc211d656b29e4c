"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text itself. Disguised ones are found in a normalised copy: transducers rewrite
homoglyphs, spelled digits and at/dot disguises, and keep for every rewritten piece its place in the source, so that a
span found in the copy is mapped back to source characters. Plain spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -().+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _PART.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(b - a <= 3 or not text[a:b].strip("0") or len(text[a:b].lstrip("0")) <= 3 for a, b in four) and all(int(text[a:b].lstrip("0") or "0") <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    """Whether a string of digits passes Luhn's check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_SEPARATORS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(_SEPARATORS)) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, by kind, then start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", s, e) for s, e in _ips(text)]
        found += [("card", s, e) for s, e in _cards(text)]
        found += [("phone", s, e) for s, e in _phones(text)] if "+" in text else []
    return found


# Letters and digits of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕһԁԛАВЕКМНОРСТХІ"
        "οανιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡİ",
        "aeopcyxijshdqABEKMHOPCTXI" "oavipABEZHIKMNOPTYXigI",
    )
)


class _Glyphs(dict):
    """What a character outside ASCII reads as: by the list, as a digit of its script, nothing if it isn't visible, or by its compatibility form."""

    def __missing__(self, c: str) -> str | None:
        form = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if c in HOMOGLYPHS:
            found = HOMOGLYPHS[c]
        elif digit is not None:
            found = str(digit)
        elif unicodedata.category(c) == "Cf":
            found = ""
        else:
            found = HOMOGLYPHS.get(form, form if form.isascii() else None)
        self[c] = found
        return found


_GLYPHS = _Glyphs()


# The digits' names in the four languages of the corpus.
SPELLED = {
    name: str(digit)
    for names in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, name in enumerate(names.split())
} | {"oh": "0"}

_NAMES = "|".join(sorted(SPELLED, key=len, reverse=True))
_TOKEN = rf"(?:(?:double|triple)[ -])?(?:{_NAMES})(?!\w)|[0-9]+(?!\w)"
#: Digits, spelled or not, told apart by a blank, dash or dot or by the word "dot"; a leading "plus" counts.
_RUN = re.compile(rf"(?<!\w)(?:plus[ -]|\+ ?)?(?:{_TOKEN})(?:(?: (?:dot|point) |[ .-])(?:{_TOKEN}))+", re.IGNORECASE)
_PIECE = re.compile(rf"(?P<plus>plus[ -]|\+ ?)|(?P<dot> (?:dot|point) )|(?P<mark>[ .-])|(?P<token>{_TOKEN})", re.IGNORECASE)
_BRACKETS = re.compile(r"[ ]?[(\[{<][ ]?(at|dot|@|\.)[ ]?[)\]}>][ ]?", re.IGNORECASE)
_HOST = r"[A-Za-z0-9-]{1,63}(?:(?: dot |\.)[A-Za-z0-9-]{1,63}){0,3}(?: dot |\.)[A-Za-z]{2,24}(?![A-Za-z0-9])"
# Words before " at " that are no mailbox but prose.
PROSE = frozenset(
    "a all also am an and any anyone are around as available back be been being best both bought but by call check click contact do done download each else ever everyone "
    "few find first for found free from get go good had happened has have he held help her here hers him his home hosted how i in info information is it its join just last listed "
    "live located log look looked looking looks made me meet meeting met more my new news no not now of on one online only open or order our ours out over own page published read "
    "registered released reading said sale see seen she shop sign site sold some someone start started stay still stop stored team that the their them then there these they this those "
    "time to today tomorrow up us visit visited visiting was watch we web website welcome went were what when where who will with work worked working works you your yours yourself".split()
)
_WORDY = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<box>[A-Za-z0-9._%+-]*[A-Za-z0-9])(?P<at> at )(?!www\b)(?={_HOST})", re.IGNORECASE)
_DOT = re.compile(r" dot ", re.IGNORECASE)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]{1,63}(?:(?: dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)


class Tape:
    """A text, and where its pieces stand in the source."""

    def __init__(self, text: str):
        self.text = text
        #: Each change as (start, end) here and (start, end) in the source, in order.
        self.changes: list[tuple[int, int, int, int]] = []

    def source(self, at: int, end: bool) -> int:
        """The source offset of a boundary; one within a change goes to that change's own edge."""
        i = bisect_right(self.changes, (at - (1 if end else 0), len(self.text), 0, 0)) - 1
        if i < 0:
            return at
        start, stop, first, last = self.changes[i]
        if at < stop or (end and at == stop):
            if at == start and not end:
                return first
            return last if end else first
        return last + at - stop

    def apply(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A new tape with (start, end, replacement) edits, which are in order and don't overlap."""
        if not edits:
            return self
        out, at, size, moved = [], 0, 0, []
        for start, end, new in edits:
            out += [self.text[at:start], new]
            size += start - at
            moved.append((size, size + len(new), start, end))
            size += len(new)
            at = end
        made = Tape("".join([*out, self.text[at:]]))
        edge = {}
        for start, stop, first, last in moved:
            edge[start] = (stop, self.source(first, False), self.source(last, True))
        # Changes that no edit covers move along.
        shift, i = 0, 0
        for start, stop, first, last in self.changes:
            while i < len(moved) and moved[i][3] <= start:
                shift = moved[i][1] - moved[i][3]
                i += 1
            if i < len(moved) and moved[i][2] < stop and start < moved[i][3]:
                continue
            edge[start + shift] = (stop + shift, first, last)
        made.changes = [(start, *edge[start]) for start in sorted(edge)]
        return made

    def changed(self, start: int, end: int) -> bool:
        """Whether a change lies within [start, end)."""
        i = bisect_right(self.changes, (end - 1, len(self.text) + 1, 0, 0)) - 1
        return i >= 0 and self.changes[i][1] > start


def _digits(run: str) -> str | None:
    """A run's digits; null if none is spelled and no dot either, or a word is no digit's name. Marks beside a spelled digit go, but for the three dots of an address."""
    pieces = [(m.lastgroup, m[0]) for m in _PIECE.finditer(run)]
    if not any(kind == "dot" or (kind == "token" and not text.isdigit()) for kind, text in pieces):
        return None
    address = sum(kind == "dot" or text == "." for kind, text in pieces) == 3
    out = []
    for i, (kind, text) in enumerate(pieces):
        if kind == "plus":
            out.append("+")
        elif kind == "token":
            times, name = 1, text.lower()
            for word, n in (("double", 2), ("triple", 3)):
                if name.startswith(word):
                    times, name = n, name[len(word) + 1 :]
            # Matching without case knows letters that have no lower case of their own among the names.
            if not name.isdigit() and name not in SPELLED:
                return None
            out.append(name if name.isdigit() else SPELLED[name] * times)
        elif kind == "dot" or (text == "." and address):
            out.append(".")
        elif pieces[i - 1][1].isdigit() and pieces[i + 1][1].isdigit():
            out.append(text)
    return "".join(out)


def _glyphs(text: str) -> list[tuple[int, int, str]]:
    strange = {c: g for c in set(text) if c > "\x7f" and (g := _GLYPHS[c]) is not None}
    if not strange:
        return []
    pattern = re.compile("[" + "".join(map(re.escape, strange)) + "]")
    return [(m.start(), m.end(), strange[m[0]]) for m in pattern.finditer(text)]


def normalised(text: str) -> Tape:
    """The text after the transducers, in order: glyphs, at/dot disguises, spelled digits. Each reads what the one before wrote."""
    tape = Tape(text)
    if not text.isascii():
        tape = tape.apply(_glyphs(text))
    if any(c in tape.text for c in "([{<"):
        tape = tape.apply([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETS.finditer(tape.text)])
    low = tape.text.lower()
    if " at " in low:
        tape = tape.apply([(*m.span("at"), "@") for m in _WORDY.finditer(tape.text) if m["box"].lower() not in PROSE])
    if " dot " in low and "@" in tape.text:
        tape = tape.apply([(d.start() + m.start(), d.end() + m.start(), ".") for m in _AFTER_AT.finditer(tape.text) for d in _DOT.finditer(m[0])])
    if " dot " in low or " point " in low or not _NAMELESS(low.replace("-", " ").replace(".", " ").split()):
        tape = tape.apply([(m.start(), m.end(), new) for m in _RUN.finditer(tape.text) if (new := _digits(m[0])) is not None])
    return tape


_NAMELESS = frozenset(SPELLED).isdisjoint


def all_spans(text: str, plain: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Plain spans and those found by normalising, by kind, then start.

    A span of the normalised text counts if it has a rewritten piece and lies in no plain span of its kind.
    """
    plain = base_spans(text) if plain is None else plain
    tape = normalised(text)
    if not tape.changes:
        return plain
    found = list(plain)
    for kind, start, end in base_spans(tape.text):
        if tape.changed(start, end):
            first, last = tape.source(start, False), tape.source(end, True)
            if not any(k == kind and s <= first and last <= e for k, s, e in found):
                found.append((kind, first, last))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    """Spans as ``kind:start:end``, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = pa.struct([("plain", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("spans", pa.string()), ("base", pa.string())])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_TYPE = T.StructType([T.StructField("plain", T.ArrayType(_SPAN)), T.StructField("spans", T.StringType()), T.StructField("base", T.StringType())])


def _find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        out = []
        for text in batch:
            text = text.as_py() or ""
            plain = base_spans(text)
            out.append({"plain": [{"kind": k, "start": s, "end": e} for k, s, e in plain], "spans": joined(all_spans(text, plain)), "base": joined(plain)})
        yield pa.array(out, _FOUND)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii`` to every row: ``plain`` spans, and ``base`` and ``spans`` as text (all spans, with disguised ones).

    Offsets are code points of the source, ends exclusive. Null and empty texts have none; repeated rows each get
    their own; other columns stay, but one named ``pii`` is replaced.
    """
    return docs.withColumn("pii", F.arrow_udf(_find, _TYPE).asNondeterministic()(F.col(text)))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii.plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), F.col("pii.spans").alias("spans"))


_BRUTE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_force(text: str | None) -> tuple[str, str]:
    """(spans, sha256) of plain identifiers by the four patterns as they are."""
    out = []
    for kind, pattern in _BRUTE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    spans = ",".join(out)
    return spans, hashlib.sha256(spans.encode()).hexdigest()
