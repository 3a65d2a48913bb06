"""Text column functions. Every function returns a Column built from
built-in expressions (regexp_replace, split, filter, transform, ...), so it
runs inside whole-stage codegen with no Python on the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The English stop-word list (179 words) and the 32 ASCII
# punctuation characters removed as single tokens.
# ---------------------------------------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't",
    "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PAD = "<PAD>"

# White space as str.split() has it: ASCII blanks and controls, the four
# information separators, NEL, and every Unicode space, line or paragraph mark.
BLANK = r"\s\x0B\x1C-\x1F\x85\p{Z}"

# Word / punctuation runs (Unicode letters, digits, underscore vs the rest).
WORDPUNCT_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]+"

# Ordered rewrite rules of the Penn-Treebank-style word
# tokeniser, applied to ' ' + text + ' ' before splitting on white space.
# Written without look-around so the same rules run in other SQL engines.
TREEBANK_RULES: list[tuple[str, str]] = [
    (r'^"', r"`` "),
    (r'([ (\[{<])"', r"$1 `` "),
    (r"(``)", r" $1 "),
    (r"([:,])([^0-9])", r" $1 $2"),
    (r"\.\.\.", r" ... "),
    (r"([;@#$%&])", r" $1 "),
    (r"([^.])(\.)([\])}>\"']*)\s", r"$1 $2$3 "),
    (r"([?!])", r" $1 "),
    (r"([^'])' ", r"$1 ' "),
    (r"([\]\[(){}<>])", r" $1 "),
    (r"--", r" -- "),
    (r'"', r" '' "),
    (r"([^' ])('s|'m|'d|') ", r"$1 $2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"$1 $2 "),
    (r"\b(can)(not)\b", r"$1 $2"),
    (r"\b(gim|lem)(me)\b", r"$1 $2"),
    (r"\b(gon|wan)(na)\b", r"$1 $2"),
    (r"\b(got)(ta)\b", r"$1 $2"),
    (r"\b(more)('n)\b", r"$1 $2"),
    (r"\b(d)('ye)\b", r"$1 $2"),
    (r" ('t)(is|was)\b", r" $1 $2"),
]


def word_count(text: Column) -> Column:
    """number of white-space separated words (``len(text.split())``):
    the count of maximal non-space runs, counted without building an array."""
    return F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("int")


def safe_file_name(artist: Column, title: Column) -> Column:
    """spaces -> '_', joined with '___', only letters, digits and '_' kept."""
    raw = F.concat_ws("___", F.regexp_replace(artist, " ", "_"),
                      F.regexp_replace(title, " ", "_"))
    return F.regexp_replace(raw, r"[^\p{L}\p{N}_]", "")


def text_path(lyrics_dir: str, name: Column) -> Column:
    """``<dir>/<name>.txt``."""
    return F.concat(F.lit(lyrics_dir.rstrip("/") + "/"), name, F.lit(".txt"))


def wordpunct_tokens(text: Column) -> Column:
    """runs of word characters or of other non-space characters."""
    return F.regexp_extract_all(text, F.lit(WORDPUNCT_PATTERN), 0)


# A rule can only fire when one of these substrings is present; checking
# them first (a fast substring search) skips most regex passes. Rules whose
# only anchor is a character class have no guard.
TREEBANK_GUARDS: dict[str, list[str]] = {
    r'^"': ['"'],
    r'([ (\[{<])"': ['"'],
    r"(``)": ["``"],
    r"([:,])([^0-9])": [":", ","],
    r"\.\.\.": ["..."],
    r"([^.])(\.)([\])}>\"']*)\s": ["."],
    r"([?!])": ["?", "!"],
    r"([^'])' ": ["' "],
    r"--": ["--"],
    r'"': ['"'],
    r"([^' ])('s|'m|'d|') ": ["'"],
    r"([^' ])('ll|'re|'ve|n't) ": ["'"],
    r"\b(can)(not)\b": ["cannot"],
    r"\b(gim|lem)(me)\b": ["gimme", "lemme"],
    r"\b(gon|wan)(na)\b": ["gonna", "wanna"],
    r"\b(got)(ta)\b": ["gotta"],
    r"\b(more)('n)\b": ["more'n"],
    r"\b(d)('ye)\b": ["d'ye"],
    r" ('t)(is|was)\b": [" 't"],
}


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and apply ``fn`` to it (a one-element
    ``transform`` binds it to a lambda variable), so a chain of rules that
    each mention their input twice stays a linear expression tree."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def treebank_tokens(text: Column) -> Column:
    """Treebank-style tokens (splits punctuation and contractions)."""
    t = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, repl in TREEBANK_RULES:
        t = _let(t, _rule(pattern, repl, TREEBANK_GUARDS.get(pattern)))
    return F.filter(F.split(t, f"[{BLANK}]+"), lambda w: w != "")


def _rule(pattern: str, repl: str, guards: list[str] | None):
    def step(x: Column) -> Column:
        replaced = F.regexp_replace(x, pattern, repl)
        if not guards:
            return replaced
        cond = x.contains(guards[0])
        for g in guards[1:]:
            cond = cond | x.contains(g)
        return F.when(cond, replaced).otherwise(x)

    return step


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


# Tokeniser registry, id <-> function.
TOKENIZERS = {0: whitespace_tokens, 1: treebank_tokens, 2: wordpunct_tokens}
TOKENIZER_NAMES = {"none": 0, "treebank": 1, "wordpunct": 2}


def tokenizer(which) -> callable:
    """A tokeniser by id or name, or the caller's own: a function from a text
    Column to an array<string> Column (with a UDF inside, if it must)."""
    if callable(which):
        return which
    if isinstance(which, str):
        which = TOKENIZER_NAMES[which]
    return TOKENIZERS[which]


def remove_terms(tokens: Column, remove_stop: bool = True, remove_punc: bool = True) -> Column:
    """drop tokens equal to a stop word or a single punctuation mark."""
    stop = (STOP_WORDS if remove_stop else []) + (PUNCTUATION if remove_punc else [])
    if not stop:
        return tokens
    # IN over a literal list becomes a hash-set lookup (InSet)
    return F.filter(tokens, lambda t: ~t.isin(stop))


def pad_or_truncate(tokens: Column, cutoff) -> Column:
    """F8: cut to ``cutoff`` tokens or pad with '<PAD>' up to it."""
    k = cutoff if isinstance(cutoff, Column) else F.lit(int(cutoff))
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(PAD), k)), 1, k)


def preprocess(text: Column, tok="treebank", remove_stop=True, remove_punc=True,
               do_padding=False, cutoff=None) -> Column:
    """Lower-case, tokenise, drop stop words/punctuation, optionally pad."""
    tokens = remove_terms(tokenizer(tok)(F.lower(text)), remove_stop, remove_punc)
    if do_padding:
        tokens = pad_or_truncate(tokens, cutoff)
    return tokens


def line_shuffle(text: Column, key: Column, seed: int = 42) -> Column:
    """lines in a seeded pseudo-random order (md5 of seed, key, line no.)."""
    lines = F.split(text, "\n")
    keyed = F.transform(lines, lambda x, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("k"),
        x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "\n")


def prefix_match(c: Column, prefix: str) -> Column:
    """Case-insensitive prefix test."""
    return F.lower(c).startswith(prefix.lower())
