"""Column expressions for review text: cleaning, sentence split, model normalisation, tokens.

Every function takes and returns a ``Column`` and stays a built-in (JVM, codegen'd)
expression, so it runs equally on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Numbered heading line, section titles, sentence boundary, unknown-word mask and the
# special tokens the classifier expects.
HEADING_PATTERN = r"\d+\.\s+[^\n]+"
SECTION_TITLES = ("Strengths:", "Weaknesses:", "General Comment:", "Overall Assessment")
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z])"
MASK_WORD = "xxx"
UNK_TOKEN = "[UNK]"
SEP_TOKEN = "[SEP]"
FEWSHOT_SEP = " . "
# ---------------------------------------------------------------------------------------------

# Whitespace class for tokens, written out so that Java regex and RE2 (the SQL oracle) agree.
TOKEN = r"\[[A-Z]+\]|[^ \t\n\x0B\f\r\p{P}]+|\p{P}"
LETTER_SPLIT = r"[^\p{L}]+"

_REGEX_META = set("\\^$.|?*+()[]{}")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def strip_headings(c, line_anchored: bool = False, unicode: bool = True) -> Column:
    """Remove numbered headings such as ``1. Scientific Relevance`` up to the line end.

    Like the reference, the default pattern is not anchored, so ``in 2020. Results`` is
    cut to the line end too; ``line_anchored=True`` only removes headings at line start.
    """
    pattern = HEADING_PATTERN
    if line_anchored:
        pattern = r"(?m)^[ \t]*" + pattern
    if unicode:
        pattern = "(?U)" + pattern
    return F.regexp_replace(_c(c), pattern, "")


def strip_titles(c, titles=SECTION_TITLES) -> Column:
    """Remove section titles, case-insensitively."""
    pattern = "(?i)(" + "|".join(regex_escape(t) for t in titles) + ")"
    return F.regexp_replace(_c(c), pattern, "")


def flatten_whitespace(c) -> Column:
    """Newline and tab become a space."""
    return F.translate(_c(c), "\n\t", "  ")


def collapse_whitespace(c, unicode: bool = True) -> Column:
    """Runs of whitespace become one space; a space that stands alone is not touched.
    ``unicode`` gives Python's meaning of ``\\s``."""
    pattern = r"\s{2,}|[^\S ]"
    return F.regexp_replace(_c(c), "(?U)" + pattern if unicode else pattern, " ")


def is_ascii(c) -> Column:
    return F.octet_length(_c(c)) == F.char_length(_c(c))


def clean_review(c, titles=SECTION_TITLES, line_anchored: bool = False,
                 unicode: bool = True) -> Column:
    """Headings, titles, line breaks and extra spaces removed; ends stripped.

    The dear patterns run only where they can matter: Unicode classes on texts beyond ASCII, the
    titles on texts that hold one of them in some case. Headings end at a line break, so removing
    them brings no title about that was not there.
    """
    def chain(wide: bool, with_titles: bool) -> Column:
        t = strip_headings(c, line_anchored=line_anchored, unicode=wide)
        t = strip_titles(t, titles) if with_titles else t
        return F.trim(collapse_whitespace(flatten_whitespace(t), unicode=wide))

    def by_script(with_titles: bool) -> Column:
        narrow = chain(False, with_titles)
        return F.when(is_ascii(c), narrow).otherwise(chain(True, with_titles)) if unicode else narrow

    if not titles:
        return by_script(False)
    if not all(x.isascii() and "\n" not in x for x in titles):
        return by_script(True)
    low = F.lower(_c(c))
    return F.when(_any([F.contains(low, F.lit(x.lower())) for x in titles]), by_script(True)).otherwise(by_script(False))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def split_sentences(c, boundary: str = SENTENCE_BOUNDARY) -> Column:
    """Array of sentences: split at ``.!?`` + whitespace when a capital follows."""
    return F.split(_c(c), boundary)


def lower_all(arr) -> Column:
    return F.transform(_c(arr), lambda s: F.lower(s))


def with_context(arr) -> Column:
    """Array of ``struct(pos, sentence_pre, sentence, sentence_post)`` from a sentence array.

    The neighbours come from the same array, so no window or shuffle is needed; the
    first sentence has a null ``sentence_pre`` and the last a null ``sentence_post``.
    """
    a = _c(arr)
    return F.transform(a, lambda s, i: F.struct(
        i.alias("pos"),
        F.get(a, i - 1).alias("sentence_pre"),
        s.alias("sentence"),
        F.get(a, i + 1).alias("sentence_post")))


def null_to_empty(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def context_text(pre, sentence, post) -> Column:
    """``pre + ' ' + sentence + ' ' + post``; missing sides become empty, spaces stay."""
    return F.concat_ws(" ", null_to_empty(pre), null_to_empty(sentence), null_to_empty(post))


def model_text(c, sep_replacement: str = " [SEP] ") -> Column:
    """Lower-case, mask word to ``[UNK]``, special tokens restored with spaces around them.

    ``sep_replacement=FEWSHOT_SEP`` gives the few-shot variant.
    """
    t = F.lower(null_to_empty(c))
    t = F.replace(t, F.lit(MASK_WORD), F.lit(f" {UNK_TOKEN} "))
    t = F.replace(t, F.lit(SEP_TOKEN.lower()), F.lit(sep_replacement))
    t = F.replace(t, F.lit(UNK_TOKEN.lower()), F.lit(f" {UNK_TOKEN} "))
    return t


def tokens(c) -> Column:
    """Words and punctuation marks of an already normalised text. A bracketed special token
    (``[UNK]``, ``[SEP]``) stays whole; any other punctuation mark is a token of its own, so
    ``word`` and ``word.`` share a feature."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN), F.lit(0))


def leading(token_array, max_length: int) -> Column:
    """The tokens that a text of ``max_length`` places keeps beside its start and end token: what
    token ids hold and what a truncating scorer reads."""
    return F.slice(_c(token_array), 1, max_length - 2)


def letter_words(c) -> Column:
    """Lower-cased runs of letters, for language profiles."""
    return F.filter(F.split(F.lower(_c(c)), LETTER_SPLIT), lambda x: x != "")
