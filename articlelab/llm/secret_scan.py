"""Secret scan: fixed patterns, and strings that a primed compressor cannot predict."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN, ACCESS_MIN = 8, 16

# Words that make a context sensitive, and what may stand for a secret in it.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api key", "api-key",
                 "credential", "bearer", "private key", "private_key", "access key", "access_key", "client_key",
                 "signing key", "auth_key", "authorization")
CONTEXT = re.compile("|".join(CONTEXT_WORDS))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Characters on either side of a context word, and of a candidate, that are looked at.
AROUND = 256
#: Compressed bytes per character from which a candidate counts as incompressible.
NOVEL_RATE = 0.6

# The code and identifier dictionary that primes the compressor.
DICTIONARY = """
abstract access_key access_token account address admin algorithm allow api_key apikey application args array assert async
auth authorization await base64 bearer boolean break bytes cache callback catch certificate char class client client_id
client_secret code config connection const constructor content continue cookie count create credential data database
date debug decode default delete description dict disable document double else email enable encode encoding endpoint
enum environment error event except export extends false file filename final finally float for format from function get
global group handler hash header hostname http https id if implements import in index input insert instance int interface
internal is json key lambda length let list localhost login long main map message method mode module name namespace new
null number object offset option or order output override package parameter params parse pass passphrase passwd password
path port print private private_key process profile protected protocol public query raise random read record redirect
refresh_token region register release remove request require response result return role root row salt schema secret
secret_key select self send server service session set setting signature size socket source ssh-rsa start state static
status stdin stdout stop store stream string struct switch system table target test text this thread throw time timeout
timestamp title token true try type undefined update upload url user user_id username utf-8 uuid value values var version
void warning where while with write www yield example sample changeme placeholder your_api_key_here your_password
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx
"""

# Prose that goes before the surroundings of strings of one class
# (letters of one case, capitalised, or no letters), so that common words and
# the letters of prose are cheap to the compressor and only the rest is not.
COMMON = """
The administration and the government of the country have announced an international programme for the development of
information and communication technology, which is responsible for the understanding of environmental conditions,
particularly the relationship between organisations and their representatives. Nevertheless, the documentation
describes the configuration, implementation, authentication, authorisation and requirements of applications; the
following instructions are straightforward, although responsibilities, characteristics, opportunities and
recommendations sometimes require investigation, interpretation, transformation or acknowledgement. Everything should
have been considerably more comfortable, immediately available, professional, educational, experimental, mathematical
and philosophical; misunderstanding, unfortunately, is extraordinary. Manufacturing infrastructure, pharmaceutical
laboratories, telecommunications, electromagnetic measurement, internationalisation.
Die Verwaltung und die Entwicklung der Gesellschaft haben sich zwischen verschiedenen Wissenschaften verändert; die
Geschwindigkeit, die Verantwortung, die Bundesregierung und das Verfassungsgericht sind selbstverständlich
unterschiedlich, wahrscheinlich ausgezeichnet, grundsätzlich verständlich, möglicherweise Zusammenarbeit,
Veröffentlichung, Unterstützung, Wirtschaftlichkeit, Begrenzung und Einrichtungen.
Le gouvernement et le développement de la connaissance sont généralement indépendants; malheureusement, les
renseignements, l'environnement, l'établissement, la reconnaissance et les caractéristiques administratives restent
particulièrement extraordinaires, immédiatement, quelquefois, aujourd'hui.
El gobierno y el desarrollo de las comunicaciones internacionales son responsabilidad de la administración;
desafortunadamente, el conocimiento, el funcionamiento, la investigación, las características y los establecimientos
son especialmente independientes, inmediatamente, aproximadamente.
THE FOLLOWING INFORMATION IS CONFIDENTIAL AND REQUIRES AUTHENTICATION, CONFIGURATION, AUTHORISATION AND DOCUMENTATION
FOR INTERNATIONAL ADMINISTRATION 2023-12-31 1970 1999 2000 2010 2024 123456789 0123456789 1000000 -------- ========
........ ________ ////////
"""
UPPER = COMMON + DICTIONARY.upper()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Novelty:
    """Marginal compressed size of a string after its surroundings, with the
    identifier dictionary in the window of the compressor."""

    def __init__(self, dictionary: str = DICTIONARY, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def rate(self, around: str, candidate: str) -> float:
        """Extra compressed bytes per byte of ``candidate`` after ``around``."""
        before, added = around.encode(), candidate.encode()
        size = len(self.compressor.compress(before + added)) - len(self.compressor.compress(before))
        return size / max(1, len(added))


def primer(s: str) -> str:
    """What the compressor reads before the surroundings of ``s``: nothing for
    mixed strings (a digit next to letters, upper case inside a word), common
    words for strings of one class, with the identifiers in upper case if all
    their letters are."""
    body = s.strip(".=-_/+")
    letters, digits = any(c.isalpha() for c in body), any(c.isdigit() for c in body)
    if (letters and digits) or (body[1:] != body[1:].lower() and body != body.upper()):
        return ""
    return UPPER if letters and body == body.upper() else COMMON


def candidates(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts) of every possible secret that reaches into the ``AROUND``
    characters before or after a context word, on whatever line; ``parts`` are its
    pieces beside context words inside it. Where only space and punctuation stand
    between two of them (the lines of a key), one in context brings in the other."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: keep positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = [m.span() for m in CONTEXT.finditer(low)]
    if not words:
        return
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends, starts = [e for _, e in words], [s for s, _ in words]
    near = []
    for a, b in runs:
        i = bisect_left(ends, a - AROUND + 1)  # the first word that ends less than AROUND before
        near.append(i < len(words) and starts[i] < b + AROUND)
    wraps = [not any(c.isalnum() for c in text[b:c0]) for (_, b), (c0, _) in zip(runs, runs[1:])]
    for i in range(1, len(runs)):
        near[i] = near[i] or (near[i - 1] and wraps[i - 1])
    for i in range(len(runs) - 2, -1, -1):
        near[i] = near[i] or (near[i + 1] and wraps[i])
    for (a, b), use in zip(runs, near):
        if use:
            cuts = [(max(a, s), min(b, e)) for s, e in words[bisect_right(ends, a):bisect_left(starts, b)]]
            at = [a, *[x for cut in cuts for x in cut], b]
            yield a, b, [m.span() for s, e in zip(at[::2], at[1::2]) for m in CANDIDATE.finditer(text, s, e)] if cuts else []


def all_spans(text: str, novelty: Novelty, rate: float = NOVEL_RATE) -> tuple[list, list]:
    """Base spans, and base with novel spans. What a base span covers is reported
    already; of a candidate that touches one the rest is measured."""
    base = base_spans(text)
    taken = merged([(s, e) for s, e, _ in base])
    ends, starts = [e for _, e in taken], [s for s, _ in taken]
    extra = []

    def novel(a: int, b: int) -> list[tuple[int, int]]:
        beside = taken[bisect_right(ends, a):bisect_left(starts, b)]
        at = [a, *[x for s, e in beside for x in (max(a, s), min(b, e))], b]
        free = [m.span() for s, e in zip(at[::2], at[1::2]) for m in CANDIDATE.finditer(text, s, e)] if beside else [(a, b)]
        return [(s, e) for s, e in free if novelty.rate(
            primer(text[s:e]) + text[max(0, s - AROUND):s] + text[e:e + AROUND], text[s:e]) >= rate]

    for a, b, parts in candidates(text):
        extra += [(*p, "novel") for p in [x for part in parts for x in novel(*part)] or novel(a, b)]
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id {id}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: str = DICTIONARY,
                 rate: float = NOVEL_RATE) -> DataFrame:
    """One row per document row: counts by kind, ``base_sha256`` and ``spans``
    (``kind:start:end`` in code points, end exclusive, comma-joined).

    Each document is scanned whole where it is: no shuffle. Base patterns are
    always reported. A string of 12 or more characters within ``AROUND``
    characters of a context word, before or after it and across lines, is also
    reported (``novel``) when it takes at least ``rate`` compressed bytes per
    character after its surroundings and the dictionary; so is what goes on
    from such a string over further lines, however many. Strings of any make-up
    are measured (``primer``), those next to an ``@`` too; of a string that a base
    span touches, what is left beside it.

    Null text counts as empty: no spans, the digest of ''. Repeated rows are
    scanned each; an empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))

    def scan(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text, novelty, rate)
                kinds = [k for _, _, k in spans]
                for column, value in zip(out, (*[kinds.count(k) for k in KINDS],
                                               hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:4]], *[pa.array(x, pa.string()) for x in out[4:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return rows.mapInArrow(scan, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
