"""Personal information inside free text.

Detection: e-mail addresses (also written out), phone numbers, identity numbers and
street addresses by their notation; names of persons by a lexicon of given and family
names, in any order, case and script variant, with initials.  The lexicon comes from
the corpus' own records of persons (the operators of the manifest), counted in Spark.
A lexicon of at most ``LEXICON`` names is sent to the tasks; of a larger one every text
gets the names among its own words by an equi-join.  Both ways give the same rows.

Method for the replacements: surrogate generation.  Every value gets a keyed
replacement of its type: a typed placeholder (``[NAME_3f9a1c...]``) and a surrogate of
the same format: digits for digits, letters for letters of the same case and script,
country prefixes, domains' last labels and street words kept.  Equal values, however
written, get the same one.  Names are replaced part by part: a given name, a family name
and the letter of an initial have one replacement each, and the first letters follow a
keyed permutation, so "J. Smith" still stands for "John Smith".  A given name that titles
in the corpus (Mr, Frau, Sra and the like) call a woman's or a man's gets an ending of
that kind.  Replacements that collide are re-keyed until all are distinct, else it is an
error.  Findings, a few thousandths of the text, are joined with the table of
replacements and then, line by line, with the texts.

Defined results: null and blank texts hold nothing; a value that stands in a text
several times is one row and is replaced everywhere; of overlapping findings the one
that starts first wins, then the longer one, so a name inside an e-mail address is no
finding; service logins (git, root, noreply and the like), repository and package
addresses, digests and credentials in URLs are none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenlake.llm.tokenize import bounded
from provenlake.session import discard, written

LEXICON = 200_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Logins of services, not of persons.
SERVICE = frozenset("git svn hg root admin administrator noreply no-reply donotreply mailer-daemon postmaster webmaster hostmaster abuse support info help sales security ci bot build deploy robot notifications ubuntu ec2-user user oauth2 x-access-token".split())

EMAIL = re.compile(r"(?<![\w.+%@/:-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-])(?!:[\w/])")
EMAIL_BRACKETS = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?: ?[\[({] ?(?:dot|DOT|Dot) ?[\])}] ?[\w+-]+)* ?[\[({] ?(?:at|AT|At) ?[\])}] ?[\w-]+(?: ?[\[({] ?(?:dot|DOT|Dot) ?[\])}] ?[\w-]+|\.[\w-]+)+")
EMAIL_WORDS = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w+-]*(?: (?:dot|DOT) [\w+-]+)* (?:at|AT) [\w-]+(?: (?:dot|DOT) [\w-]+)+(?! (?:dot|DOT|at|AT) )(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.+/#-])(?:"
    r"\+\d{1,3}(?:[ .\-]?(?:\(\d{1,5}\)|\d{1,5})){1,6}"
    r"|00\d{2}(?:[ .\-](?:\(\d{1,5}\)|\d{1,5})){2,6}"
    r"|(?:1[ .\-])?\(\d{3}\) ?\d{3}[ .\-]\d{4}"
    r"|(?:1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}"
    r"|0\d(?:([ .\-])\d\d)(?:\2\d\d){3}"
    r"|\(?0\d{2,4}\)?[ /\-]\d{3,4}[ \-]\d{3,4}"
    r"|\(?0\d{3,4}\)?[ /]\d{6,8}"
    r")(?![\w@])(?!\.\d)(?!-\d)"
)
IDENTITY = re.compile(
    r"(?<![\w.\-/@#+])(?:"
    r"\d{3}-\d{2}-\d{4}"
    r"|(?<!\d )\d{3} \d{2} \d{4}(?! \d)"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]"
    r"|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]\d{8}|[A-Z]{2}\d{7}"
    r"|\d{8}-?[A-HJ-NP-TV-Z]"
    r"|[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) \d[\dAB] \d{3} \d{3} \d{2}"
    r")(?![\w@/])(?!-\d)(?!\.\d)"
)
_W = r"[^\W\d_][\w'’\-]*"
_UP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_TOWN = rf"{_UP}(?: (?:{_UP}|(?:am|an der|sur|upon|on|de|la|le) {_UP})){{0,2}}"
_SUFFIX = r"(?:Street|Road|Lane|Avenue|Boulevard|Drive|Court|Close|Crescent|Terrace|Square|Place|Gardens|Grove|Way|Row|Hill|Mews|Park|Walk|Parade|Highway|Circle|Trail|(?:St|Rd|Ln|Ave|Blvd|Dr|Ct|Cres|Ter|Sq|Pl|Hwy|Cir)\b\.?)"
_UNIT = r"(?:,? (?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|No|Room)\.? ?#?\w+|,? #\w+)?"
_POST = r"(?:,? (?:[A-Z]{2} )?\d{5}(?:-\d{4})?\b|,? [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b)"
ADDRESS = re.compile(
    rf"(?<![\w.\-/@])(?:"
    rf"\d{{1,5}}[A-Za-z]?,? (?:{_UP} ){{1,4}}{_SUFFIX}{_UNIT},? {_TOWN}{_POST}?"
    rf"|{_UP}(?:straße|strasse|str\.|gasse|platz|allee|weg|ring|damm|ufer) \d{{1,5}} ?[a-z]?,? (?:D-)?\d{{4,5}} {_TOWN}"
    rf"|(?:[A-ZÄÖÜ][\wäöüß]+(?:er|e|es) )?(?:Straße|Strasse|Platz|Allee|Weg) \d{{1,5}} ?[a-z]?, (?:D-)?\d{{4,5}} {_TOWN}"
    rf"|\d{{1,5}} ?(?:bis|ter|[A-Za-z])?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|cours|square) (?:(?:de la|de l['’]|des|du|de|d['’]|la|le) ?)?{_UP}(?: {_UP}){{0,3}},? \d{{5}} {_TOWN}"
    rf"|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|C/|Carrer|Ronda) (?:(?:de la|de los|de las|del|de) )?{_UP}(?: {_UP}){{0,3}},? (?:n[º°.] ?)?\d{{1,5}}(?:, ?\d{{1,2}} ?[º°ª]? ?[A-Z]?)?,? (?:\d{{5}} )?{_TOWN}"
    rf"|(?:Via|Viale|Piazza|Corso) {_UP}(?: {_UP}){{0,3}},? \d{{1,5}}, \d{{5}} {_TOWN}"
    rf")"
)
# one of these words stands in every address: a quick test before the full pattern
STREET = ("straße", "strasse", "str.", "gasse", "latz", "allee", "Allee", "weg", "Weg", "ring", "damm", "ufer", "rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse", "route", "cours", "square", "Calle", "Avda", "Paseo", "Camino", "C/", "Carrer", "Ronda", "Via", "Piazza", "Corso", "Road", "Lane", "Boulevard", "Court", "Close", "Gardens", "Grove", "Way", "Row", "Hill", "Mews", "Park", "Walk", "Parade", "Highway", "Trail", "St", "Rd", "Ln", "Ave", "Blvd", "Dr", "Ct", "Cres", "Ter", "Sq", "Pl", "Hwy", "Cir")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
MARKS = re.compile(r"[^\W\d_]+")


def bare(word: str) -> str:
    """A name apart from case, accents, hyphens and apostrophes."""
    if word.isascii() and word.isalpha():
        return word.lower()
    s = unicodedata.normalize("NFKD", word.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in s if c.isalpha()).casefold()


class Names:
    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.memo: dict[str, str] = {}

    def find(self, t: str) -> list[tuple[int, int, str]]:
        """(start, end, roles) of names in a text whose line wraps are blanks; a role is g, i or f for each word."""
        out: list[tuple[int, int, str]] = []
        memo, given, family = self.memo, self.given, self.family
        if len(memo) > 200_000:
            memo.clear()

        def kind(w: str) -> str:
            k = memo.get(w)
            if k is None:
                b = bare(w)
                memo[w] = k = ("g" if b in given else "") + ("f" if b in family else "") + ("i" if len(b) == 1 else "") or "-"
            return k

        kinds = [memo.get(w) or kind(w) for w in WORD.findall(t)]
        if not any("f" in k for k in kinds):
            return out
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(t)]
        n, last = len(words), 0

        def initial(i: int, z: int, gaps: tuple[str, ...]) -> bool:
            """Whether word i is an initial with its full stop, at one of these gaps from z."""
            return i < n and "i" in kinds[i] and t[z : words[i][0]] in gaps and t[words[i][1] : words[i][1] + 1] == "." and words[i][2].isupper()

        for i in range(n):
            if "f" not in kinds[i] or words[i][0] < last:
                continue
            a, z, _ = words[i]
            # before: [given or initial] [initials] family
            j, start, roles, got = i - 1, a, "f", False
            while j >= 0 and i - j <= 3 and words[j][0] >= last:
                gap = t[words[j][1] : start]
                if "g" in kinds[j] and gap == " ":
                    start, roles, got = words[j][0], "g" + roles, True
                    break
                if "i" not in kinds[j] or gap not in (". ", " ", ".") or not words[j][2].isalpha() or (gap == " " and not words[j][2].isupper()):
                    break
                start, roles, got = words[j][0], "i" + roles, gap != " " or got
                j -= 1
            if not got:
                # after: family, given [initial] or family given, family, initial
                start, roles = a, ""
                if i + 1 < n and "g" in kinds[i + 1] and t[z : words[i + 1][0]] in (", ", " ", ","):
                    z, roles = words[i + 1][1], "fg"
                    if initial(i + 2, z, (" ",)):
                        z, roles = words[i + 2][1] + 1, "fgi"
                # an initial before another family name belongs to that one
                elif initial(i + 1, z, (", ", " ", ",")) and not (i + 2 < n and "f" in kinds[i + 2]):
                    z, roles = words[i + 1][1] + 1, "fi"
            if roles:
                out.append((start, z, roles))
                last = z
        return out


def find_all(text: str | None, wrapped: bool, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every personal value, without overlaps."""
    return [f[:3] for f in findings(text, wrapped, names)]


def findings(text: str | None, wrapped: bool, names: Names) -> list[tuple]:
    """As ``find_all``; names have their roles as a fourth value."""
    if not text:
        return []
    t = text.replace("\n", " ") if wrapped and "\n" in text else text
    found: list[tuple] = []
    if "@" in t:
        for m in EMAIL.finditer(t):
            local = m[0].split("@")[0].lower()
            if local not in SERVICE and not re.fullmatch(r"[0-9a-f]{16,}", local):
                found.append((m.start(), m.end(), "email"))
    if "at" in t or "AT" in t or "At" in t:
        if "[" in t or "(" in t or "{" in t:
            found += [(m.start(), m.end(), "email") for m in EMAIL_BRACKETS.finditer(t)]
        if " dot " in t or " DOT " in t:
            found += [(m.start(), m.end(), "email") for m in EMAIL_WORDS.finditer(t)]
    if any(c.isdigit() for c in t):
        for m in PHONE.finditer(t):
            digits = sum(c.isdigit() for c in m[0])
            if 8 <= digits <= 15:
                found.append((m.start(), m.end(), "phone"))
        found += [(m.start(), m.end(), "id_number") for m in IDENTITY.finditer(t)]
        if any(w in t for w in STREET):
            found += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(t)]
    found += [(a, z, "name", roles) for a, z, roles in names.find(t)]
    if len(found) < 2:
        return found
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    out = [found[0]]
    for f in found[1:]:
        if f[0] >= out[-1][1]:
            out.append(f)
    return out


def name_lexicon(operators: DataFrame, column: str) -> DataFrame:
    """(w, given, family): names of persons recorded as given and family name, apart from case, accents and signs."""

    @F.pandas_udf("string")
    def plain(words: pd.Series) -> pd.Series:
        return words.map(bare)

    parts = F.filter(F.split(F.lower(F.trim(F.col(column))), r"[^\p{L}'’]+"), lambda p: F.length(p) > 2)
    two = operators.select(parts.alias("p")).where("size(p) = 2").distinct()
    roles = F.array(F.struct(F.col("p")[0].alias("w"), F.lit(True).alias("given")), F.struct(F.col("p")[1].alias("w"), F.lit(False).alias("given")))
    once = two.select(F.inline(roles)).distinct().select(plain("w").alias("w"), "given").where("w <> ''")
    return once.groupBy("w").agg(F.max("given").alias("given"), F.max(~F.col("given")).alias("family"))


KEY = ["session", "seq", "block"]
SPANS = "session string, seq long, block long, start int, stop int, kind string, found_text string, first boolean, value string, parts array<struct<kind:string,value:string>>, sign string"
NONE = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("found_text", pa.string()), ("first", pa.bool_()), ("value", pa.string()), ("parts", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))), ("sign", pa.string())])
MAN = re.compile(r"\b(?:Mr|Herrn?|Hrn?|Sr|Señor|Monsieur|Mister|M|г-н)\.? $")
WOMAN = re.compile(r"\b(?:Mrs|Ms|Miss|Frau|Fr|Sra|Señora|Srta|Mme|Mlle|Madame|г-жа)\.? $")


def sign_before(text: str, at: int) -> str:
    """f or m where a title before a name says so."""
    before = text[max(0, at - 12) : at].replace("\n", " ")
    return "f" if WOMAN.search(before) else "m" if MAN.search(before) else ""


def _rows(batch: pa.RecordBatch, hits: list[list[tuple]]) -> pa.RecordBatch:
    pick, rows = [], []
    for i, (t, found) in enumerate(zip(batch.column(4).to_pylist(), hits)):
        seen = set()
        for a, z, kind, *roles in found:
            v = t[a:z]
            name = kind == "name"
            pick.append(i)
            rows.append((a, z, kind, v, (kind, v) not in seen, canonical(kind, v), parts_of(v, roles[0]) if name else None, sign_before(t, a) if name else ""))
            seen.add((kind, v))
    columns = [*zip(*rows)] if rows else [()] * 8
    at = pa.array(pick, pa.int64())
    parts = [p if p is None else [{"kind": k, "value": v} for k, v in p] for p in columns[6]]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *(pa.array(parts if k == 6 else c, NONE.field(3 + k).type) for k, c in enumerate(columns))], schema=NONE)


def personal_spans(texts: DataFrame, persons: DataFrame, column: str = "operator") -> DataFrame:
    """Every place of a personal value: the key of the text, start, stop, kind, found_text, whether it is the first such of
    its text, and for replacements its canonical value, the parts of a name and the sign of a title before it.

    ``texts`` has session, seq, block, btype, text; ``persons`` a column of persons.
    """
    lexicon, _ = written(name_lexicon(persons, column))
    slim = texts.select(*KEY, "btype", "text")
    if lexicon.count() <= LEXICON:
        rows = lexicon.toArrow()
        pairs = list(zip(rows["w"].to_pylist(), rows["given"].to_pylist(), rows["family"].to_pylist()))
        shared = texts.sparkSession.sparkContext.broadcast(({w for w, g, _ in pairs if g}, {w for w, _, f in pairs if f}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = Names(*shared.value)
            for whole in batches:
                for x in bounded(whole, 4):
                    yield _rows(x, [findings(t, k == "text", names) for t, k in zip(x.column(4).to_pylist(), x.column(3).to_pylist())])

        return slim.mapInArrow(run, SPANS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in bounded(whole, 3):
                pairs = [(i, w) for i, t in enumerate(x.column(3).to_pylist()) if t for w in {bare(w) for w in WORD.findall(t)}]
                at = pa.array([i for i, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([*(x.column(k).take(at) for k in range(3)), pa.array([w for _, w in pairs], pa.string())], names=[*KEY, "w"])

    words = slim.select(*KEY, "text").mapInArrow(own, "session string, seq long, block long, w string")
    held = words.join(lexicon, "w").groupBy(*KEY).agg(F.collect_list(F.when(F.col("given"), F.col("w"))).alias("g"), F.collect_list(F.when(F.col("family"), F.col("w"))).alias("f"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in bounded(whole, 4):
                c = [x.column(k).to_pylist() for k in (4, 3, 5, 6)]
                yield _rows(x, [findings(t, k == "text", Names(set(g or ()), set(f or ()))) for t, k, g, f in zip(*c)])

    return slim.join(held, KEY, "left").select(*KEY, "btype", "text", "g", "f").mapInArrow(each, SPANS)


def personal_values(texts: DataFrame, persons: DataFrame, column: str = "operator") -> DataFrame:
    """(session, seq, block, kind, found_text) of every personal value of every text, once."""
    return personal_spans(texts, persons, column).where("first").select(*KEY, "kind", "found_text")


def canonical(kind: str, value: str) -> str:
    """One spelling for all notations of a value, so that coreference survives."""
    if kind == "email":
        v = re.sub(AT, "@", value.lower())
        return re.sub(DOT, ".", v)
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z]", "", value.lower().replace("(0)", ""))
    if kind == "name":
        return " ".join(f"{v}." if k == "initial" else v for k, v in sorted(parts_of(value), key=lambda p: ORDER.index(p[0])))
    return re.sub(r"[\W_]+", " ", value.casefold()).strip()


AT, DOT = r" ?[\[({] ?at ?[\])}] ?| at ", r" ?[\[({] ?dot ?[\])}] ?| dot "
ORDER = ("given", "initial", "family")


def parts_of(value: str, roles: str = "") -> list[tuple[str, str]]:
    """(kind, value) of the words of a name; without ``roles`` the family name stands last, or first before a comma."""
    words = WORD.findall(value)
    if not roles:
        roles = "".join("i" if len(bare(w)) == 1 else "g" for w in words)
        at = 0 if "," in value else len(words) - 1
        roles = roles[:at] + "f" + roles[at + 1 :]
    return [({"g": "given", "i": "initial", "f": "family"}[r], bare(w)) for r, w in zip(roles, words)]


def keyed(key: str, *parts: str) -> bytes:
    return hmac.new(key.encode(), "\x1f".join(parts).encode("utf-8", "replace"), hashlib.sha256).digest()


def token(kind: str, value: str, key: str, attempt: int = 0) -> str:
    return keyed(key, "token", kind, value, str(attempt)).hex()[:12]


def placeholder(kind: str, value: str, key: str) -> str:
    return f"[{kind.upper()}_{token(kind, canonical(kind, value), key)}]"


def spliced(text: str, hits: list[tuple[int, int, str]]) -> str:
    """A text with (start, end, replacement) put in."""
    out, at = [], 0
    for a, z, r in sorted(hits):
        out += [text[at:a], r]
        at = z
    return "".join(out) + text[at:]


def redacted(text: str | None, hits: list[tuple[int, int, str]], key: str) -> str | None:
    return spliced(text, [(a, z, placeholder(k, text[a:z], key)) for a, z, k in hits]) if text and hits else text


VOWELS = "aeiouyаеиоуыэюяαεηιουω"


@lru_cache(4096)
def letters_like(c: str) -> str:
    """Lower-case letters of the script (the same 128 code points) of a letter, vowels apart from consonants where known."""
    if c.isascii():
        pool = "abcdefghijklmnopqrstuvwxyz"
    elif "а" <= c <= "я":
        pool = "абвгдежзиклмнопрстуфхцчшэюя"
    elif "α" <= c <= "ω":
        pool = "αβγδεζηθικλμνξοπρστυφχψω"
    else:
        at = ord(c) // 128 * 128
        pool = "".join(x for x in map(chr, range(at, at + 128)) if unicodedata.category(x) == unicodedata.category(c)) or c
    return "".join(x for x in pool if (x in VOWELS) == (c in VOWELS))


@lru_cache(4096)
def first_letter(c: str, key: str) -> str:
    """A keyed permutation of the letters of a script."""
    pool = sorted({*letters_like(c), *(letters_like("a" if c.isascii() else "а" if "а" <= c <= "я" else c) + (letters_like("b") if c.isascii() else letters_like("б") if "а" <= c <= "я" else ""))})
    mixed = pool[:]
    random.Random(keyed(key, "first", "".join(pool))).shuffle(mixed)
    return mixed[pool.index(c)] if c in pool else c


def stream(key: str, *parts: str) -> Iterator[int]:
    n = 0
    while True:
        yield from keyed(key, *parts, str(n))
        n += 1


def name_part(kind: str, value: str, sign: str, key: str, attempt: int = 0) -> str:
    """A given or family name of the same script, with the first letter of the permutation, in small letters."""
    x = stream(key, kind, value, str(attempt))
    out = [first_letter(value[0], key)]
    like = value[0] if value[0].isascii() or "а" <= value[0] <= "я" else None
    size = max(4, len(value)) + attempt // 8 if like else len(value) + attempt // 8
    while len(out) < size:
        if like:
            vowel = out[-1] not in VOWELS
            pool = letters_like(("a" if vowel else "b") if like.isascii() else ("а" if vowel else "б"))
        else:
            pool = letters_like(value[min(len(out), len(value) - 1)])
        out.append(pool[next(x) % len(pool)])
    if like and kind == "given" and sign:
        vowels, rest = ("a", letters_like("b")) if like.isascii() else ("а", letters_like("б"))
        out[-1] = vowels if sign == "f" else rest[next(x) % len(rest)]
        if (out[-2] in VOWELS) == (sign == "f"):
            pool = rest if sign == "f" else "aeio" if like.isascii() else "аеио"
            out[-2] = out[-2] if len(out) == 2 else pool if isinstance(pool, str) and len(pool) == 1 else pool[next(x) % len(pool)]
    return "".join(out)


KEPT = frozenset(w.lower().strip("./") for w in STREET) | frozenset("street avenue drive terrace place circle highway apt apartment suite unit flat floor de la las los del des du le calle avenida plaza viale".split())


def surrogate_value(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The letters and digits that replace those of a canonical value, in order."""
    x = stream(key, kind, value, str(attempt))
    kept: set[int] = set()
    if kind == "email":
        kept = set(range(value.rfind("."), len(value)))
    elif kind == "phone":
        kept = {0, 1}
    elif kind == "address":
        kept = {i for m in re.finditer(r"\S+", value) if m[0] in KEPT for i in range(*m.span())}
    out = []
    for i, c in enumerate(value):
        n = next(x)
        if not c.isalnum():
            continue
        if i in kept or c in "ºª" or not (c.isdigit() or c.isalpha()):
            out.append(c)
        elif c.isdigit():
            out.append(str(n % 10))
        else:
            pool = letters_like(c)
            out.append(pool[n % len(pool)] if pool else c)
    return "".join(out)


def cased(new: str, old: str) -> str:
    """``new`` in the case of ``old``, with its hyphens and apostrophes."""
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        new = new.upper()
    elif letters and letters[0].isupper():
        new = new[:1].upper() + new[1:]
    out, k = new, 0
    for i, c in enumerate(old):
        if not c.isalpha():
            out = out[: i + k] + c + (out[i + k : i + k + 1].upper() if old[i + 1 : i + 2].isupper() else out[i + k : i + k + 1]) + out[i + k + 1 :]
    return out


def rendered(kind: str, found: str, surrogate: str) -> str:
    """A surrogate value in the notation of the value found."""
    rest, out = iter(surrogate), []
    split = rf"(?i)({AT}|{DOT})" if kind == "email" else r"(\(0\))" if kind == "phone" else None
    for i, piece in enumerate(re.split(split, found) if split else [found]):
        for c in piece:
            n = next(rest, c) if i % 2 == 0 and c.isalnum() else c
            out.append(n.upper() if c.isupper() else n)
    return "".join(out)


def named(found: str, parts: list[tuple[str, str]], new: list[str]) -> str:
    """A name with its words replaced; separators stay."""
    places = [m.span() for m in WORD.finditer(found)]
    return spliced(found, [(a, z, cased(n, found[a:z])) for (a, z), n in zip(places, new)])


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """A replacement of one value on its own, without a check against others."""
    if kind != "name":
        return rendered(kind, value, surrogate_value(kind, canonical(kind, value), key, attempt))
    parts = parts_of(value)
    return named(value, parts, [first_letter(v, key) if k == "initial" else name_part(k, v, "", key, attempt) for k, v in parts])


ROUNDS = 64


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate, token): one replacement per value, all distinct within a kind.

    ``found`` has kind and found_text, or what ``personal_spans`` gives.  ``value`` is the canonical spelling; names have
    rows of their own, with a token only, and rows for their given and family names.  Values whose replacements collide
    are re-keyed with the next attempt until none does.
    """

    @F.pandas_udf("value string, parts array<struct<kind:string,value:string>>")
    def described(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = [(canonical(k, v), [{"kind": a, "value": b} for a, b in parts_of(v)] if k == "name" else None) for k, v in zip(kinds, values)]
        return pd.DataFrame(rows, columns=["value", "parts"])

    @F.pandas_udf("surrogate string, token string")
    def made(kinds: pd.Series, values: pd.Series, signs: pd.Series, attempts: pd.Series) -> pd.DataFrame:
        rows = []
        for k, v, s, a in zip(kinds, values, signs, attempts):
            t = token(k, v, key, a)
            rows.append((name_part(k, v, s, key, a) if k in ("given", "family") else t if k == "name" else surrogate_value(k, v, key, a), t))
        return pd.DataFrame(rows, columns=["surrogate", "token"])

    if "value" not in found.columns:
        found = found.withColumn("_d", described("kind", "found_text")).select("kind", "_d.*", F.lit("").alias("sign"))
    whole = F.array(F.struct("kind", "value"))
    rows = found.select("sign", F.explode(F.concat(whole, F.filter(F.coalesce("parts", F.array().cast("array<struct<kind:string,value:string>>")), lambda p: p["kind"] != "initial"))).alias("p"))
    count = lambda s: F.count_if(F.col("sign") == s)
    values = rows.groupBy("p.kind", "p.value").agg(F.when(count("f") > count("m"), "f").when(count("m") > count("f"), "m").otherwise("").alias("sign"))

    def replaced(v: DataFrame) -> DataFrame:
        return v.withColumn("_m", made("kind", "value", "sign", "attempt")).select("kind", "value", "sign", "attempt", "_m.surrogate", "_m.token")

    table, path = written(replaced(values.withColumn("attempt", F.lit(0))))
    for _ in range(ROUNDS):
        rank = lambda c: F.row_number().over(Window.partitionBy("kind", c).orderBy("attempt", "value"))
        ranked = table.withColumn("_n", F.greatest(rank("surrogate"), rank("token")))
        if ranked.where("_n > 1").limit(1).count() == 0:
            return table.select("kind", "value", "surrogate", "token")
        again = ranked.where("_n > 1").select("kind", "value", "sign", (F.col("attempt") + 1).alias("attempt"))
        nxt, new = written(ranked.where("_n = 1").drop("_n").unionByName(replaced(again)))
        discard(table.sparkSession, path)
        table, path = nxt, new
    raise ValueError(f"replacements still collide after {ROUNDS} attempts: some kind has more values than its format has replacements")


def replaced_texts(texts: DataFrame, spans: DataFrame, table: DataFrame, key: str, surrogate: bool = False) -> DataFrame:
    """(session, seq, block, text): all texts with every finding replaced by its placeholder, or with ``surrogate`` by its surrogate."""
    place = [*KEY, "start"]
    own = F.array(F.struct(F.lit(-1).alias("pos"), "kind", "value"))
    parts = F.transform(F.coalesce("parts", F.array().cast("array<struct<kind:string,value:string>>")), lambda p, i: F.struct(i.alias("pos"), p["kind"].alias("kind"), p["value"].alias("value")))
    needs = spans.select(*place, F.inline(F.filter(F.concat(own, parts) if surrogate else own, lambda p: p["kind"] != "initial")))
    got = needs.join(table, ["kind", "value"]).groupBy(*place).agg(F.collect_list(F.struct("pos", "surrogate", "token")).alias("new"))
    lines = spans.select(*place, "stop", "kind", "found_text", "parts").join(got, place).groupBy("session", "seq").agg(F.collect_list(F.struct("block", "start", "stop", "kind", "found_text", "parts", "new")).alias("hits"))

    def replacement(h: dict) -> str:
        new = {x["pos"]: x for x in h["new"]}
        if not surrogate:
            return f"[{h['kind'].upper()}_{new[-1]['token']}]"
        if h["kind"] != "name":
            return rendered(h["kind"], h["found_text"], new[-1]["surrogate"])
        parts = [(p["kind"], p["value"]) for p in h["parts"]]
        return named(h["found_text"], parts, [first_letter(v, key) if k == "initial" else new[i]["surrogate"] for i, (k, v) in enumerate(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in bounded(whole, 3):
                out = []
                for block, t, hits in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist()):
                    mine = [(h["start"], h["stop"], replacement(h)) for h in hits or () if h["block"] == block]
                    out.append(spliced(t, mine) if mine else t)
                yield pa.RecordBatch.from_arrays([*(x.column(k) for k in range(3)), pa.array(out, pa.string())], names=[*KEY, "text"])

    return texts.select(*KEY, "text").join(lines, ["session", "seq"], "left").select(*KEY, "text", "hits").mapInArrow(run, "session string, seq long, block long, text string")
