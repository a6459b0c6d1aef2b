"""Word tokens by an ordered table of rewrite rules.

The conventions are those of the Penn Treebank: quotes become `` and '',
brackets and most punctuation stand alone, a contraction is cut before its
second part (``do n't``, ``it 's``, ``can not``), and a full stop is cut only at the
end of the sentence, so abbreviations and numbers keep theirs. Each rule is one
``regexp_replace`` over the whole sentence, in the order of the table; what is
left is split on spaces. No rule looks around, so the same patterns run
in Java and in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articlelab.functions.text import WS_CLASS, _c

# ---------------------------------------------------------------------------
# The published conventions of the Penn Treebank tokeniser, in
# their order (pattern, replacement; $1 is the first group).
OPENING_QUOTES = (
    ('^"', "``"),
    ("(``)", " $1 "),
    (r"([ (\[{<])" + '("|\'{2})', "$1 `` "),
)
PUNCTUATION = (
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"([^.])(\.)([\]\)}>\"']*) *$", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
)
BRACKETS = (
    (r"([\]\[\(\)\{\}\<\>])", " $1 "),
    (r"--", " -- "),
)
CLOSING_QUOTES = (
    ("''", " '' "),
    ('"', " '' "),
    (r"([^' ])('[sSmMdD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
)
CONTRACTIONS = (
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na) ", " $1 $2 "),
    (r"(?i) ('t)(is)\b", " $1 $2 "),
    (r"(?i) ('t)(was)\b", " $1 $2 "),
)
# ---------------------------------------------------------------------------

#: All rules in order; between brackets and closing quotes the sentence gets a
#: space on either side, so that its first and last words have neighbours.
BEFORE, AFTER = OPENING_QUOTES + PUNCTUATION + BRACKETS, CLOSING_QUOTES + CONTRACTIONS


def _apply(s: Column, rules) -> Column:
    for pattern, replacement in rules:
        s = F.regexp_replace(s, pattern, replacement)
    return s


def rewritten(sentence) -> Column:
    """The sentence with spaces between all tokens (white space of any kind
    counts as a space)."""
    s = F.regexp_replace(F.regexp_replace(_c(sentence), f"[{WS_CLASS}]+", " "), "^ | $", "")
    return _apply(F.concat(F.lit(" "), _apply(s, BEFORE), F.lit(" ")), AFTER)


def treebank_tokens(sentence, lower: bool = False) -> Column:
    """G7 (+ G8): ARRAY<STRING> of tokens; a blank sentence has none, null none."""
    s = rewritten(sentence)
    return F.array_remove(F.split(F.lower(s) if lower else s, " +"), "")
