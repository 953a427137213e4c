"""DuckDB SQL fragments that mirror the Spark column functions (used by the oracle queries)."""

from __future__ import annotations

# Java's Unicode whitespace class ((?U)\s) written out for RE2.
UWS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
       r"\x{202F}\x{205F}\x{3000}]")
UDIGIT = r"\p{Nd}"
TOKEN = r"\[[A-Z]+\]|[^ \t\n\x0B\f\r\p{P}]+|\p{P}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    t = f"regexp_replace({expr}, {q(UDIGIT + r'+\.' + UWS + r'+[^\n]+')}, '', 'g')"
    t = (f"regexp_replace({t}, "
         f"{q('(?i)(Strengths:|Weaknesses:|General Comment:|Overall Assessment)')}, '', 'g')")
    t = f"translate({t}, chr(10) || chr(9), '  ')"
    t = f"regexp_replace({t}, {q(UWS + '+')}, ' ', 'g')"
    return f"trim({t})"


def sentence_array(expr: str) -> str:
    marked = (f"regexp_replace({expr}, {q('([.!?])' + UWS + '+([A-Z])')}, "
              f"'\\1' || chr(1) || '\\2', 'g')")
    return f"string_split({marked}, chr(1))"


def model_text(expr: str, sep: str = " [SEP] ") -> str:
    t = f"lower(coalesce({expr}, ''))"
    t = f"replace({t}, 'xxx', ' [UNK] ')"
    t = f"replace({t}, '[sep]', {q(sep)})"
    return f"replace({t}, '[unk]', ' [UNK] ')"


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(TOKEN)})"


def letter_words(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}]+'), lambda x: x <> '')"


def md5_key(seed: int, *exprs: str) -> str:
    parts = ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return f"md5(concat_ws('|', '{seed}', {parts}))"
