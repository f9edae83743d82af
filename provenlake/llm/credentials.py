"""Credentials embedded in source code, configuration and logs.

Method.  1. Literals are indexed corpus-wide: every value that stands where a
credential would (known token formats, assignments to secret names, URLs, command
lines, headers, encoded values, private key blocks).  2. Values shared by more than ``OWNERS`` owners
are placeholders and are suppressed; rare values from a credential's place are
confirmed.  3. Every text that holds a confirmed value anywhere, also without
context, is re-scanned with an Aho-Corasick automaton of its confirmed values, which
gives all places; redaction replaces exactly those stretches.

At scale: the index is (owner, value) pairs, counted with partial aggregation; the
link from confirmed values to texts is an equi-join on the hash of an anchor, a run of
code points of the value that is looked for at every place of every text; only a bit
for each anchor is broadcast, at most ``MOST_BITS``, so a text without any hit is not
joined; each automaton holds only the values of one batch of texts.

Defined results: null and empty texts hold nothing; empty values, references
($X, ${X}, env:, vault paths, function calls, secret names), prompts, placeholders,
digests, ids, public keys and certificates are none; a value written in pieces starts
where its first piece does; a private key block is its BEGIN line and is redacted
line by line, so line numbers stay; text without credentials comes back unchanged.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.tokenize import bounded
from provenlake.session import written

OWNERS = 8  # a value that more owners have is a placeholder
SHORTEST = 6
GRAMS = (4, 6, 12)  # lengths of the runs of code points by which values are looked for; no indexed value is shorter
GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MOST_BITS = 1 << 27  # 16 MB

# Public formats of issued tokens.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_+/-])(?:"
    r"(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{12,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|glpat-[A-Za-z0-9_-]{12,}|npm_[A-Za-z0-9]{12,}|pypi-[A-Za-z0-9_-]{12,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{10,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}"
    r"|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{20,}"
    r"|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-f]{24,}|ya29\.[\w-]{20,}|hvs\.[\w-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}"
    r")"
)
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
OPENED = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
CLOSED = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")
# a line of a block, also numbered, quoted, indented or in a diff; lines end with a newline or its escape
BODY_LINE = re.compile(r"((?:[^\n\\]|\\(?!r?\\?n))*+)(\\r\\n|\\n|\n|\Z)")
BODY = re.compile(r"[ \t]*(?:\d+[\t:|→])?[\s\"'`+\-,;()|>#*\\]*+(?:([A-Za-z0-9+/]*+={0,2}|=[A-Za-z0-9+/]{4})|[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*: .*)[\s\"'`+,;()\\]*")
# a quoted string, also in pieces joined over lines (with printed line numbers or diff signs between)
JOINT = r"[ \t]*(?:\+|\.|\\)?[ \t]*\n(?:[ \t]*\d+\t)?[+-]?[ \t]*(?:\+[ \t]*)?"
PIECES = re.compile(rf"(['\"])([^'\"\s`]{{4,}})\1(?:{JOINT}\1([^'\"\s`]{{4,}})\1)+")
JOINED = re.compile(r"['\"][ \t]*[+.\\]?[ \t]*\n")
PREFIXES = ("AKIA", "ASIA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "pypi-", "xox", "_live_", "_test_", "sk-", "AIza", "SG.", "hf_", "dop_v1_", "shpat_", "ya29.", "hvs.", "eyJ")
NAMED = re.compile(r"(?i)pass|pwd|secret|token|key|credential|dsn|jwt|sid|bearer")
SECRET_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret|(?:private|signing|encryption|master|account|secret|storage|license)[_-]?key|credentials?|dsn|jwt|sid|key)"
ASSIGNED = re.compile(
    rf"((?i:{SECRET_NAME}))[\"'`\]]{{0,2}}[ \t]*(?::=|=>|=|:)[ \t]*"
    r"(?:[fbru]{0,2}(\"\"\"|'''|[\"'`])((?:(?!\2)[^\n\\]|\\.)++)\2|([^\s\"'`,;<>(){}\[\]]++))"
)
TAGGED = re.compile(rf"<(?i:[\w.:-]*{SECRET_NAME})(?: [^<>]*)?>([^<>\n]+)</|(?i:(?:key|name)=[\"'][\w.:-]*{SECRET_NAME}[\"'][ \t]+value=)[\"']([^\"'\n]+)[\"']")
IN_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/@:'\"<>]*:([^\s/@'\"<>]+)@")
COMMAND = re.compile(
    r"(?:\bcurl\b[^\n]*?[ \t](?:-u|--user)[ =]?[\"']?[^\s:'\"]+:([^\s'\"]+)"
    r"|\b(?:mysql|mysqldump|mariadb|mysqladmin)\b[^\n]*?[ \t]-p[\"']?([^\s'\"]{4,})"
    r"|[ \t]--(?:password|pass|token|secret|api-key|auth-token)[ =][\"']?([^\s'\"]{4,})"
    r"|\bsshpass\b[^\n]*?-p[ ]?[\"']?([^\s'\"]{4,})"
    r"|\bdocker login\b[^\n]*?[ \t]-p[ ]?[\"']?([^\s'\"]{4,}))"
)
SAID = re.compile(
    r"(?i:\b(?:password|passwd|passphrase|pass|secret|token)(?:[ \t]+(?:is|was|of \S+ is))?[ \t]+)[\"'`]?([^\s\"'`,;<>(){}]{6,})"
    r"|(?i:\bidentified (?:with \w+ )?by[ \t]+)[\"']([^\"'\n]+)[\"']"
    r"|(?i:\bwith password[ \t]+)[\"']([^\"'\n]+)[\"']"
    r"|(?:BasicAuth|basic_auth|HTTPBasicAuth|auth|login|connect)[ \t]*=?[ \t]*\([ \t]*[\"'][^\"'\n]*[\"'][ \t]*,[ \t]*[\"']([^\"'\n]+)[\"']"
    r"|(?i:authorization[\"']?[ \t]*[:=,][ \t]*[\"']?(?:bearer|token|basic|apikey)[ \t]+)([^\s\"'<>,;]+)"
    r"|(?i:\b(?:bearer)[ \t]+)([A-Za-z0-9_\-.+/=]{16,})"
)
ENCODED = re.compile(r"(?m)(?i:value|data|b64|base64|encoded|auth|dockerconfigjson|secret|password|token|key)[\"']?[ \t]*[:=][ \t]*[\"']?((?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)(?=[\"']?[ \t]*(?:#.*)?$)")
AUTH = re.compile(r"\"auth\"\s*:\s*\"[A-Za-z0-9+/]{8,}={0,2}\"")
ROW_OF_SECRETS = re.compile(r"(?i)\binsert[ \t]+into[ \t]+[\w.\"`]*(?:client|token|secret|cred|key|user|account|auth)\w*[\"`]?[^\n]*")
QUOTED = re.compile(r"['\"`]([A-Za-z0-9+/=_\-.]{20,})['\"`]")
SIGN_BEFORE = re.compile(r"[\"']?[ \t]*(?::=|=>|=|:|\()[ \t(]*$")
DIGEST_NAME = re.compile(r"(?i)(?:sha\d*|md5|digest|checksum|hash|etag|integrity|commit|rev(?:ision)?|uuid|guid|fingerprint|signature|nonce|salt|version|public|pub|cert|(?:^|[_.\-])id|ref|path|file|url|uri|name|host|hint|policy|label)$")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
REFERENCE = re.compile(
    r"(?i)^\$[A-Za-z_]\w*$|^\$[{(]|\$\{|^\{\{|^%\(|^%[A-Z_]+%$|^%[a-z]$|^![a-z]+$|^[&*@][a-z_.]+$|^<[^>]*>?$|^\[[a-z_ ]+\]?$"
    r"|^(?:env|vault|ssm|arn|secret|secrets|file|ref|sops|op|aws|gcp|keyring|kms|azure)[:/]|^(?:/run/|/etc/|/var/|~/|\./|\.\./|/[\w.-]+/)|[A-Za-z]:\\"
    r"|^(?:process\.env|os\.environ|os\.getenv|System\.getenv|ENV|config|settings|secrets|req|request|self|this|args|opts|options|params|props|getpass|input|prompt|var|local|data)[.\[(]"
)
RANDOM = re.compile(r"(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=\D*\d)[A-Za-z0-9+/]{32,}={0,2}")
UNEVEN = re.compile(r"(?=.*[a-z]).*[A-Z][a-z]?[A-Z]")
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|#{3,}|0{4,}|1234\d*|abc\d*|none|null|nil|undefined|true|false|todo|tbd|fixme|n/?a|default|dummy|fake|test|testing|demo|sample|example|secret|password|passwd|pass|pwd|token|key|apikey|api[_-]?key|string|value|empty|unset|admin|root|user|guest|change[_-]?(?:me|it|this)|replace[_-]?(?:me|this)|insert[_-].*|your[_-].*|my[_-]?(?:secret|password|token|key)|redacted.*|masked|hidden|removed|placeholder|foo|bar|baz|hunter2|letmein|qwerty\d*|strict|required|optional|bearer|basic)$"
    r"|your[_\- ]|<[^>]*>|\[redacted|example\.|EXAMPLE|placeholder|changeme|dummy|xxxx|\*\*\*\*|\.\.\.\."
)


def name_before(text: str, i: int, signs: str = "_.-[]") -> str:
    """The name, of any length, that ends at a place."""
    a = i
    while a and (text[a - 1].isalnum() or text[a - 1] in signs):
        a -= 1
    return text[a:i]


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def plausible(value: str, name: str, quoted: bool) -> bool:
    """Whether a value from a credential's place can be one."""
    v = value
    if len(v) < SHORTEST or PLACEHOLDER.search(v) or UUID.fullmatch(v) or (REFERENCE.search(v) and not RANDOM.fullmatch(v)):
        return False
    low = name.lower().replace("-", "_")
    if any(x in low for x in ("public", "pub_key", "pubkey")) or v.startswith(("ssh-", "sha256:", "sha512-", "h1:")):
        return False
    letters, digits = any(c.isalpha() for c in v), any(c.isdigit() for c in v)
    special = any(not c.isalnum() and c not in "._-/" for c in v)
    if not letters or v[0] == "?":
        return False
    if not digits and not special and not (quoted and re.fullmatch(r"[A-Za-z_-]{8,}", v) and UNEVEN.match(v)):
        return False
    if quoted and " " in v:
        return False
    if not quoted and re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?", v) and not any(c.isdigit() for c in v):
        return False
    # a bare "key" names many things: only random-looking values count
    if re.search(r"key$", low) and not re.search(r"(?:api|access|auth|private|signing|encryption|master|account|secret|storage|license)_?key$", low):
        return len(v) >= 16 and (digits or UNEVEN.match(v) is not None) and entropy(v) >= 3.0 and not re.fullmatch(r"[a-z]+(?:[-_.:/][a-z0-9]+)+", v)
    return True


def decodes(v: str) -> str | None:
    """The readable text a Base64 value holds, if any."""
    try:
        raw = base64.b64decode(v, validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw.decode() if len(raw) >= 6 and all(32 <= c < 127 or c in b"\t\r\n" for c in raw) else None


def encodes(d: str) -> bool:
    """Whether a decoded text is a credential or, as a key file or a configuration, holds one."""
    if len(d) <= 200 and not any(c.isspace() for c in d):
        return plausible(d, "password", True)
    return any(s for _, _, s in literals(d)) or AUTH.search(d) is not None or (d[0] not in "{[<" and plausible(d, "password", True))


def block_at(text: str, start: int) -> tuple[int, bool]:
    """(end, whether it holds a key) of the block that begins here; an open one ends before the first line that is no Base64."""
    at = OPENED.match(text, start).end()
    m = CLOSED.search(text, at)
    if m and m[1] == "END":
        lines = [x[1] for x in BODY_LINE.finditer(text, at, m.start()) if x[1].strip(" \t\r\"'`+-\\,;")]
        if 2 * sum(BODY.fullmatch(x) is not None for x in lines) >= len(lines) > 0:
            return m.end(), True
    end, key = at, False
    for x in BODY_LINE.finditer(text, at):
        b = BODY.fullmatch(x[1])
        if not b or b[1] and len(b[1]) < 16:
            break
        if b[1]:
            end, key = x.end(1), True
        if x.end() == len(text):
            break
    return end, key


def literals(text: str) -> list[tuple[int, str, bool]]:
    """(position, value, from a credential's place) of every indexed literal; a key block's value is its first lines."""
    out: dict[int, tuple[str, bool]] = {}
    blocked = []
    if "-----BEGIN" in text:
        for m in OPENED.finditer(text):
            if blocked and m.start() < blocked[-1][1]:
                continue
            end, key = block_at(text, m.start())
            blocked.append((m.start(), end))
            if key and BEGIN.match(text, m.start()):
                out[m.start()] = (text[m.start() : end], True)

    def free(i: int) -> bool:
        return not any(a <= i < z for a, z in blocked)

    def add(i: int, v: str, sure: bool = True) -> None:
        if free(i) and (i not in out or (len(v) > len(out[i][0]) and not out[i][1])):
            out[i] = (v, sure)

    for m in PIECES.finditer(text) if JOINED.search(text) else ():
        first = m.start(2)
        whole = "".join(re.findall(r"['\"]([^'\"\s`]{4,})['\"]", m[0]))
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        sign = SIGN_BEFORE.search(line)
        name = name_before(line, sign.start(), "_.-") if sign else ""
        if len(whole) >= 20 and not DIGEST_NAME.search(name) and not REFERENCE.search(whole) and (any(c.isdigit() for c in whole) or UNEVEN.match(whole)) and re.fullmatch(r"[\w+/=.\-]+", whole):
            add(first, m[2], True)
            blocked.append((m.start() + 1 + len(m[2]), m.end()))
    for m in FORMATS.finditer(text) if any(x in text for x in PREFIXES) else ():
        if not PLACEHOLDER.search(m[0]):
            add(m.start(), m[0].rstrip("."))
    named = NAMED.search(text) is not None
    for m in ASSIGNED.finditer(text) if named else ():
        v, at, quoted = (m[3], m.start(3), True) if m[3] is not None else (m[4], m.start(4), False)
        if not quoted:
            v = v.rstrip(".:")
        if v.startswith("LS0t") and (d := decodes(v)) and "-----BEGIN" in d and not BEGIN.search(d):
            continue  # an encoded certificate or public key
        name = name_before(text, m.start()) + m[1]
        if plausible(v, name, quoted) and text[m.start() - len(name) + len(m[1]) - 2 : m.start() - len(name) + len(m[1])] != "${":
            add(at, v)
    if "://" in text:
        for m in IN_URL.finditer(text):
            if len(m[1]) >= 4 and not REFERENCE.search(m[1]) and not PLACEHOLDER.search(m[1]):
                add(m.start(1), m[1])
    if named and ("</" in text or "value=" in text):
        for m in TAGGED.finditer(text):
            k = 1 if m[1] is not None else 2
            if plausible(m[k].strip(), "password", True):
                add(m.start(k), m[k].strip())
    commands = any(x in text for x in ("curl", "mysql", "mariadb", " --", "sshpass", "docker login"))
    for rx in [COMMAND] * commands + [SAID] * (named or "uth" in text or "dentified" in text or "DENTIFIED" in text or "login" in text):
        for m in rx.finditer(text):
            k = m.lastindex
            v = m[k].rstrip(".:")
            # in a line about a login a bare mixed-case word is a password, elsewhere it needs digits or signs
            if plausible(v, "password", rx is COMMAND or k in (2, 3, 4) or "login" in text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
                add(m.start(k), v)
    for m in ENCODED.finditer(text) if named or "value" in text or "data" in text else ():
        d = decodes(m[1])
        if d and encodes(d):
            add(m.start(1), m[1])
    for row in ROW_OF_SECRETS.finditer(text) if "insert" in text or "INSERT" in text else ():
        for m in QUOTED.finditer(text, row.start(), row.end()):
            if any(c.isdigit() for c in m[1]) and not UUID.fullmatch(m[1]) and not REFERENCE.search(m[1]) and not PLACEHOLDER.search(m[1]) and entropy(m[1]) >= 3.0:
                add(m.start(1), m[1])
    return [(i, v, s) for i, (v, s) in sorted(out.items())]


def digest_of(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).digest()


def index_literals(texts: DataFrame) -> DataFrame:
    """(owner, value digest, value) of all literals in a credential's place, one row per text and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 1):
                pick, value = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    own = {v for _, v, s in literals(t) if s} if t else set()
                    pick += [i] * len(own)
                    value += own
                digest = [digest_of(v) for v in value]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pick, pa.int64())), pa.array(digest, pa.binary()), pa.array(value, pa.string())], names=["owner", "digest", "value"])

    return texts.select("owner", "text").mapInArrow(run, "owner string, digest binary, value string")


def confirmed(index: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(digest, value) of the values that stand in a credential's place and that at most so many owners have."""
    pairs = index.groupBy("digest", "owner").agg(F.min("value").alias("value"))
    return pairs.groupBy("digest").agg(F.count("*").alias("n"), F.min("value").alias("value")).where(F.col("n") <= owners).select("digest", "value")


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Hash of each run of k code points, by its place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + c[j : j + n]) * GRAM_FACTOR
    return (h ^ (h >> np.uint64(29))) * GRAM_FACTOR + np.uint64(k)


def anchor_of(value: str) -> int:
    """Hash of the run of code points by which a value is looked for: its end, of a key block the middle."""
    k = max(g for g in GRAMS if g <= len(value))
    end = (len(value) + k) // 2 if "\n" in value else len(value)
    return int(gram_hashes(value[end - k : end], k)[0].astype(np.int64))


def anchored(known: DataFrame) -> DataFrame:
    """(gram, value): the confirmed values with their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(anchor_of, b.column(0).to_pylist()), pa.int64()), b.column(0)], names=["gram", "value"])

    return known.select("value").mapInArrow(run, "gram long, value string")


def anchors_in(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(session, seq, block, gram): every run of code points of every text that may be an anchor; bits has a bit for each anchor's hash."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = shared.value
        mask = np.uint64(8 * len(b_) - 1)
        for whole in batches:
            for b in bounded(whole, 3):
                pick, grams = [], []
                for i, t in enumerate(b.column(3).to_pylist()):
                    for k in GRAMS if t else ():
                        h = gram_hashes(t, k)
                        at = h & mask
                        g = np.unique(h[(b_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                        pick.append(np.full(len(g), i))
                        grams.append(g.view(np.int64))
                at = pa.array(np.concatenate(pick) if pick else [], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(np.concatenate(grams) if grams else [], pa.int64())], names=["session", "seq", "block", "gram"])

    return texts.select("session", "seq", "block", "text").mapInArrow(run, "session string, seq long, block long, gram long")


def anchor_bits(known: DataFrame) -> np.ndarray:
    """A bit for each anchor's hash, at least 64 bits an anchor up to MOST_BITS."""
    n = known.count()
    size = min(MOST_BITS, 1 << max(16, (64 * n).bit_length()))
    bits = np.zeros(size // 8, np.uint8)
    places = known.select(F.col("gram").bitwiseAND(size - 1).cast("int").alias("p")).distinct().toArrow().column(0).to_numpy()
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits


def secrets_of_texts(texts: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(session, seq, block, values) of every text that may hold a confirmed value: it holds the value's anchor."""
    known, _ = written(anchored(confirmed(index_literals(texts), owners)))
    held = anchors_in(texts, anchor_bits(known)).join(known, "gram")
    return held.groupBy("session", "seq", "block").agg(F.collect_set("value").alias("values"))


def rescan(texts: list[str], values: list[list[str]]) -> list[list[tuple[int, int]]]:
    """Spans of the confirmed values of each text, found by one automaton over the batch."""
    automaton = ahocorasick.Automaton()
    every = {v for vs in values for v in vs}
    if not every:
        return [[] for _ in texts]
    for v in every:
        automaton.add_word(v, v)
    automaton.make_automaton()
    out = []
    for t, vs in zip(texts, values):
        own, spans = set(vs), []
        for end, v in automaton.iter(t):
            a = end - len(v) + 1
            # a whole literal, not a part of a longer word
            if v in own and not (v[0].isalnum() and a and t[a - 1].isalnum() and not re.search(r"(?:[\s'\"]-p|\\n|\\t)$", t[max(0, a - 3) : a])) and not (v[-1].isalnum() and t[end + 1 : end + 2].isalnum()):
                spans.append((a, end + 1))
        spans.sort(key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int]] = []
        for s in spans:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        out.append(kept)
    return out


def credential_lines(texts: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(session, seq, block, line_no) of every line on which a credential starts."""
    held = secrets_of_texts(texts, owners)
    both = texts.select("session", "seq", "block", "text").join(held, ["session", "seq", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 3):
                t = b.column(3).to_pylist()
                pick, lines = [], []
                for i, spans in enumerate(rescan(t, b.column(4).to_pylist())):
                    for n in sorted({t[i].count("\n", 0, a) + 1 for a, _ in spans}):
                        pick.append(i)
                        lines.append(n)
                at = pa.array(pick, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(lines, pa.int64())], names=["session", "seq", "block", "line_no"])

    return both.select("session", "seq", "block", "text", "values").mapInArrow(run, "session string, seq long, block long, line_no long")


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """Values replaced so that quoting, line numbers and the code around stay as they are."""
    out, at = [], 0
    for a, z in spans:
        v = text[a:z]
        out.append(text[at:a])
        if "\n" in v:
            out.append("\n".join(line if "-----" in line else re.sub(r"[A-Za-z0-9+/=]{8,}", "REDACTED", line) for line in v.split("\n")))
        else:
            out.append("REDACTED_" + hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=4).hexdigest())
        at = z
    return "".join(out) + text[at:]


def redacted_texts(texts: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(session, seq, block, text): all texts, with confirmed credentials replaced."""
    both = texts.select("session", "seq", "block", "text").join(secrets_of_texts(texts, owners), ["session", "seq", "block"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 3):
                t = b.column(3).to_pylist()
                spans = rescan([x or "" for x in t], [v or [] for v in b.column(4).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array([redact(x, s) if x and s else x for x, s in zip(t, spans)], pa.string())], names=["session", "seq", "block", "text"])

    return both.select("session", "seq", "block", "text", "values").mapInArrow(run, "session string, seq long, block long, text string")
