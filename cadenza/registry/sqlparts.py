"""DuckDB-dialect snippets shared by the oracle SQL texts."""

from __future__ import annotations

from cadenza.functions.text import PUNCTUATION, STOP_WORDS, TREEBANK_RULES, WORDPUNCT_PATTERN
from cadenza.registry.base import _lit


# White space of str.split(), in this engine's regex dialect.
BLANKS_SQL = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"


def word_count_sql(col: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({col}, '{BLANKS_SQL}'), lambda w: w <> '')) AS INTEGER)"


def file_name_sql(artist: str, title: str) -> str:
    return (f"regexp_replace(replace({artist}, ' ', '_') || '___' || replace({title}, ' ', '_'), "
            f"'[^\\p{{L}}\\p{{N}}_]', '', 'g')")


def doc_title_sql(doc_id: str = "doc_id") -> str:
    return f"('doc ' || CAST({doc_id} AS VARCHAR))"


def treebank_sql(text: str) -> str:
    t = f"(' ' || {text} || ' ')"
    for pattern, repl in TREEBANK_RULES:
        r = repl.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        t = f"regexp_replace({t}, {_lit(pattern)}, {_lit(r)}, 'g')"
    return f"list_filter(regexp_split_to_array({t}, '{BLANKS_SQL}'), lambda w: w <> '')"


def wordpunct_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {_lit(WORDPUNCT_PATTERN.replace('x0B', 'x{0B}').replace('x1C-', 'x{1C}-').replace('x1F', 'x{1F}').replace('x85', 'x{85}'))})"


def stop_list_sql(remove_stop=True, remove_punc=True) -> str:
    words = (STOP_WORDS if remove_stop else []) + (PUNCTUATION if remove_punc else [])
    return "[" + ", ".join(_lit(w) for w in words) + "]"


def remove_terms_sql(tokens: str, remove_stop=True, remove_punc=True) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({stop_list_sql(remove_stop, remove_punc)}, t))"


def preprocess_sql(text: str, tok="treebank", remove_stop=True, remove_punc=True) -> str:
    low = f"lower({text})"
    toks = treebank_sql(low) if tok == "treebank" else wordpunct_sql(low)
    return remove_terms_sql(toks, remove_stop, remove_punc)


def line_shuffle_sql(text: str, key: str, seed=42) -> str:
    """Lines ordered by md5(seed|key|line_no) with 0-based line numbers."""
    return (f"array_to_string(list_transform(list_sort(list_transform(string_split({text}, chr(10)), "
            f"lambda x, i: {{'k': md5('{seed}|' || {key} || '|' || CAST(i - 1 AS VARCHAR)), 'x': x}})), "
            f"lambda s: s.x), chr(10))")
