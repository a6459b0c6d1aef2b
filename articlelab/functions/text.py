"""Text column expressions.

Every function returns a ``Column`` built from built-in Spark SQL
functions, so it runs inside whole-stage code generation on the
executors. The regular expressions avoid look-around so that the same
pattern runs unchanged in Java regex and in RE2 (the oracle's engine).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Whitespace = the characters Python's ``str.split()`` / ``str.strip()``
# treat as space: \t \n \v \f \r, \x1c-\x1f, \x85 and every Unicode
# separator (\p{Z}).
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
# Sentence boundary: a run of . ! ? followed by spaces.
SENTENCE_BOUNDARY = r"([.!?]+)[ ]+"
# Word rule: a run of letters/digits, or one other non-space character.
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + WS_CLASS + r"]"
# Sentence boundary tokens of the sentence encoder (version 2 / version 1).
BOS, EOS = "<p>", "</p>"
BOS_V1, EOS_V1 = "<s>", "</s>"
# Tokeniser contraction fix: " n't " becomes "n 't ".
CONTRACTION_FROM, CONTRACTION_TO = " n't ", "n 't "
# Prompt template of the query generator; the slots are title, length,
# headline and section label, in that order.
PROMPT_PARTS = (
    "I am writing an article titled '",
    "' for a WikiHow page. Write a paragraph of length ",
    " whose title is '",
    "' for the ",
    " section of this article.",
)
# Minimum word count of the WikiHow subset.
MIN_WORDS = 40
# ---------------------------------------------------------------------------

_SENT_MARK = "\u0001"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_newlines(text) -> Column:
    """Newline -> space."""
    return F.regexp_replace(_c(text), "\n", " ")


def split_sentences(text, newlines_to_space: bool = True) -> Column:
    """ARRAY<STRING> of sentences (a boundary is a run of ``.!?``
    followed by spaces; the punctuation stays with its sentence)."""
    t = remove_newlines(text) if newlines_to_space else _c(text)
    marked = F.regexp_replace(t, SENTENCE_BOUNDARY, "$1" + _SENT_MARK)
    return F.split(marked, _SENT_MARK)


def _lower_all(tokens: Column) -> Column:
    """Lower-case every token with one ``lower`` call on the joined list
    (no per-element lambda, so the stage keeps whole-stage codegen).
    The separator is a control character no token contains; lower-casing
    is per character, so this equals lower-casing each token. Tokens are
    never empty, so ``array_remove(.., '')`` only drops the artefact of an
    empty list, and ``tokens`` is referenced once (no duplicated regex)."""
    return F.array_remove(F.split(F.lower(F.array_join(tokens, _SENT_MARK)), _SENT_MARK), "")


# Characters whose lower-casing depends on their neighbours or changes the
# token split (dotted capital I -> "i" + combining dot; capital sigma ->
# final/medial sigma). Texts containing one take the exact per-token path.
_CONTEXT_CASE = "[\u0130\u03a3]"


def _regex_words(s) -> Column:
    return F.regexp_extract_all(s, F.lit(WORD_PATTERN), 0)


def word_tokens(sentence, lower: bool = True) -> Column:
    """ARRAY<STRING> of word tokens, punctuation kept as tokens.
    Lower-casing is per token; for ordinary text that equals tokenising the
    lower-cased text, which is the fast path."""
    s = _c(sentence)
    if not lower:
        return _regex_words(s)
    return F.when(s.rlike(_CONTEXT_CASE), _lower_all(_regex_words(s))).otherwise(_regex_words(F.lower(s)))


def sentence_tokens(text, lower: bool = True, newlines_to_space: bool = True) -> Column:
    """G5-G8 + C15: ARRAY<ARRAY<STRING>>, one token list per non-empty
    sentence. Sentence boundaries (``.!?`` and spaces) do not change under
    lower-casing, so the fast path lower-cases the whole text first."""
    t = _c(text)

    def per_sentence(src):
        return F.filter(F.transform(split_sentences(src, newlines_to_space), _regex_words),
                        lambda s: F.size(s) > 0)

    if not lower:
        return per_sentence(t)
    # exact path: lower-case all tokens in one call on the joined lists
    raw = per_sentence(t)
    sep2 = "\u0002"
    joined = F.lower(F.array_join(F.transform(raw, lambda s: F.array_join(s, _SENT_MARK)), sep2))
    exact = F.filter(F.transform(F.split(joined, sep2), lambda s: F.array_remove(F.split(s, _SENT_MARK), "")),
                     lambda s: F.size(s) > 0)
    return F.when(t.rlike(_CONTEXT_CASE), exact).otherwise(per_sentence(F.lower(t)))


def flat_tokens(text, lower: bool = True) -> Column:
    """All tokens of a text. Sentence boundaries only fall on spaces, which
    never belong to a token, so this is one regex pass over the whole text
    (equal to flattening :func:`sentence_tokens`)."""
    return word_tokens(text, lower)


def drop_blank_tokens(tokens) -> Column:
    """Drop tokens that are empty or whitespace only."""
    return F.filter(_c(tokens), lambda x: x.rlike(f"[^{WS_CLASS}]"))


def is_blank(text) -> Column:
    """C6 complement: true when text has no non-space character."""
    return ~_c(text).rlike(f"[^{WS_CLASS}]")


def word_count(text) -> Column:
    """Null-safe word count, words split on whitespace like
    Python's ``str.split()``; null text counts 0."""
    n = F.size(F.regexp_extract_all(_c(text), F.lit(f"[^{WS_CLASS}]+"), 0))
    return F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint"))


def clean_title(title) -> Column:
    """G1: strip, collapse inner whitespace to one space, then drop a
    trailing run of digits (a space before the digits stays)."""
    t = F.regexp_replace(_c(title), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    t = F.regexp_replace(t, f"[{WS_CLASS}]+", " ")
    return F.regexp_replace(t, r"\p{Nd}+$", "")


def length_label(n_words) -> Column:
    """``"<n> words"``."""
    return F.concat(_c(n_words).cast("string"), F.lit(" words"))


def prompt(title, length, headline, section) -> Column:
    """Prompt text; any null slot gives a null prompt."""
    p = PROMPT_PARTS
    return F.concat(F.lit(p[0]), _c(title), F.lit(p[1]), _c(length), F.lit(p[2]),
                    _c(headline), F.lit(p[3]), _c(section), F.lit(p[4]))


def join_tokens(tokens, sep: str = " ") -> Column:
    """Token list -> sentence string."""
    return F.array_join(_c(tokens), sep)


def fix_contractions(joined) -> Column:
    """G9 on a space-joined token string."""
    return F.replace(_c(joined), F.lit(CONTRACTION_FROM), F.lit(CONTRACTION_TO))


def with_boundaries(tokens, bos: str = BOS, eos: str = EOS) -> Column:
    """[bos] + tokens + [eos]."""
    return F.concat(F.array(F.lit(bos)), _c(tokens), F.array(F.lit(eos)))
