"""Mood lexicons as DataFrames.

A lexicon maps each mood to three term lists: *exact* tags, *like* terms
(a tag that contains the term is a hit) and *filter* terms (occurrences
inside a liked tag are subtracted). The lists are small, fixed driver-side
literals, so their DataFrames have a proven size bound and are broadcast.

Two orders matter and both are kept as explicit ordinals:
* exact mode walks the moods in lexicon (insertion) order;
* expanded mode reads a JSON written with sorted keys, so its moods are
  in alphabetical order (ties of the scoreboard go to the earlier mood).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN_MOOD = "unknown"

# ---------------------------------------------------------------------------
# These must equal the published mood lexicon for equal labels.
# 18 moods with their exact tag lists, in the published order.
# ---------------------------------------------------------------------------
MOOD_EXACT_TERMS: dict[str, list[str]] = {
    "calm": ["calm", "comfort", "quiet", "serene", "mellow", "chill out"],
    "sad": ["sadness", "unhappy", "melancholic", "melancholy"],
    "happy": ["happy", "happiness", "happy songs", "happy music"],
    "romantic": ["romantic", "romantic music"],
    "upbeat": ["upbeat", "gleeful", "high spirits", "zest", "enthusiastic"],
    "depressed": ["depressed", "blue", "dark", "depressive", "dreary"],
    "anger": ["anger", "angry", "choleric", "fury", "outraged", "rage"],
    "grief": ["grief", "heartbreak", "mournful", "sorrow", "sorry"],
    "dreamy": ["dreamy"],
    "cheerful": ["cheerful", "cheer up", "festive", "jolly", "jovial", "merry"],
    "brooding": ["brooding", "contemplative", "meditative", "reflective"],
    "aggression": ["aggression", "aggressive"],
    "confident": ["confident", "encouraging", "encouragement", "optimism"],
    "angst": ["angst", "anxiety", "anxious", "jumpy", "nervous", "angsty"],
    "earnest": ["earnest", "heartfelt"],
    "desire": ["desire", "hope", "hopeful", "mood: hopeful"],
    "pessimism": ["pessimism", "cynical", "pessimistic", "weltschmerz"],
    "excitement": ["excitement", "exciting", "exhilarating", "thrill", "ardor"],
}

# Like terms per mood (substring hits), as published.
MOOD_LIKE_TERMS: dict[str, list[str]] = {
    "aggression": ["aggress"],
    "anger": ["anger", "angry", "choleric", "fury", "outraged", "rage"],
    "angst": ["angst", "anxiety", "anxious", "jumpy", "nervous", "angsty"],
    "brooding": ["brood", "contemplat", "meditat", "reflect"],
    "calm": ["calm", "comfort", "quiet", "serene", "mellow", "chill"],
    "cheerful": ["cheer", "festive", "jolly", "jovial", "merry"],
    "confident": ["confident", "encourag", "optimis"],
    "depressed": ["depress", "dark", "drear"],
    "desire": ["desire", "desirin", "hope", "hopin"],
    "dreamy": ["dreamy"],
    "earnest": ["earnest", "heartfelt", "devout", "wholeheart", "sincere",
                "impassion", "fervent", "ardent"],
    "excitement": ["excite", "exhilarating", "thrill", "ardor"],
    "grief": ["grief", "heartbreak", "mournful", "sorrow", "sorry"],
    "happy": ["happy", "happiness"],
    "pessimism": ["pessimis", "cynic", "weltschmerz"],
    "romantic": ["romant"],
    "sad": ["sad", "unhappy", "melanchol"],
    "upbeat": ["upbeat", "gleeful", "high spirits", "zest", "enthusias"],
}

# Filter terms per mood, as published. Duplicates are kept on
# purpose (a duplicated filter subtracts twice).
MOOD_FILTER_TERMS: dict[str, list[str]] = {
    "aggression": ["not so aggressive"],
    "anger": [
        "garage", "entourage", "daranger", "danger", "underage", "banger",
        "ranger", "doppleganger", "doppelganger", "traged", "piangere", "stranger",
        "beverage", "coverage", "zangeres", "average", "mirage", "underage",
        "langer", "not in anger", "tanger", "fuleragem", "fragements", "enouragement",
        "suffragette", "avarage", "leverage", "changer", "courage", "hervorragend",
        "bursdagsanger", "tragedies", "rage against the machine", "volkzangers",
        "getragen", "frageze", "tanger", "arragem", "not rage", "wangerFamilie",
        "cooperage", "anchorage", "sanger", "manger", "sangerin", "kenneth anger",
        "svanger", "songs that take all the anger out of you", "pandeiragem", "behangers",
        "fragen", "angerls", "frage", "korageklimper", "sjanger", "umbrageous",
    ],
    "angst": ["gangst", "langstrumpf", "farangstar", "gaaangstaa", "klangstark"],
    "brooding": ["broodcast", "marilyn manson - the reflecting god",
                 "silverchair-reflections of a sound"],
    "calm": [
        "calminha", "schill-das", "dragonland", "clelia felix", "schiller", "quiet riot",
        "chillung", "alex gopher", "royksoppia", "bob baldwin", "uncomfortabl",
        "chili con carnage", "hot as chilli", "smokey robinson", "quiet roit",
        "grover washington", "stvari", "mobb deep", "scott matthews", "shadow puppets",
        "red hot chilli pipers", "feeder-2002", "piehti", "peter schilling",
        "the main ingredient", "red hot chilli pepper", "impossible to listen to quietly",
        "cannot be played quietly", "probably have listened to the chills", "rustycanuckchill",
        "southern comfort", "most serene republic", "john mayer", "nusrat fateh", "pink martini",
        "skunk anansie", "tonight is glory", "brutal metal for quiet people", "calmeback",
        "red hot chilli pepers", "comfort food", "chilli peppers", "comfortably numb",
        "simon cooper", "redhotchillypeppers", "the sea is calm once more", "paul brown",
        "maria mena", "chilli pepers", "comfortable liar", "unrequieted", "carly simon",
        "shai", "quietdrive", "red hot chillis", "buddha-bar", "discomfort",
        "red hot chilly pepers", "children of bodom", "not calming",
    ],
    "cheerful": ["cheerlead", "samples jolly roger", "pretty depressing", "cheerless",
                 "Sophie Merry"],
    "confident": ["confidential"],
    "depressed": [
        "billy squier", "david benoit", "dark alley", "john fogerty", "jacks mannequin",
        "naglfar", "brenda russell", "uncle tupelo", "omarion", "ozzy osbourne",
        "donnie darko", "donny darko", "its dark outside", "julenzeit", "the hoosiers",
        "black shuck", "hot chip", "mary gauthier", "zombie girl", "tuna sandwiches",
        "dark sky demo", "macbeth", "poisonblack", "oxide and neutrino",
        "motion picture soundtrack",
    ],
    "desire": [
        "hope of the states mix", "hopelorn", "you hope that he get what", "trip-hop",
        "hope sandoval", "hopeless", "swallow the sun", "trip hop", "hopelessness", "chopin",
        "the white ship of hope", "no hope", "hope is gone", "hopeton", "hip-hope",
        "james hope", "hoperas", "randy hope", "falsehope", "i hope not", "rapid hope loss",
        "hopek", "give up all hope", "barbershopesque", "miridesire", "i hope my neighbour",
        "pirates of the caribbean",
    ],
    "dreamy": ["wasnt jake dreamy", "val kilmer is dreamy", "alex james", "roots manuva"],
    "earnest": [
        "fervent qawwali", "sincerely frightening", "not sincere", "sincere mj cole nero rmx",
        "brand nubian", "i would clap", "insincere", "monneglows", "sri radha",
        "new found glory",
    ],
    "excitement": [
        "juat travelling through", "tardor", "excited for full album", "michael jackson",
        "richardor", "thrilla riddim", "hardore", "the pointer sisters", "the thrills",
        "in his excitement", "jagged edge", "the theme", "thrill is gone", "thrillseekers",
        "fall out boy",
    ],
    "grief": [
        "the heartbreakers", "1st album", "femi kuti", "glenn jones", "brenda lee",
        "kenny g", "kings of convenience", "madonna", "maria mena", "markus schulz",
        "matt wertz", "mcfly", "moonsorrow", "mustard plug", "my chemical romance",
        "pat benatar", "paul cardall", "jonas brothers", "ferry corsten",
        "taylor swift", "ted leo", "not sorry", "impalas", "pillows",
        "whitney houston", "calvin johnston", "jackson browne", "johnny cash",
    ],
    "happy": [
        "al green", "altered image", "angelique", "avril lavigne", "bert kaempfert",
        "black uhuru", "bud powell trio", "cloudy", "enrico rava", "edwin hawkins singers",
        "faith evans", "garbage", "tim hughes", "kotaro oshio", "junior jack", "jill cunniff",
        "modeselektor", "phillip walker", "siouxsie and the banshees", "snow patrol",
        "all-american rejects", "all american rejects", "the cure", "tomas andersson",
        "neil sedaka", "happy feet soundtrack", "happy gilmore", "not happy",
    ],
    "pessimism": ["veil of maya", "marshal crenshaw"],
    "romantic": [
        "ace of base", "aiden", "ana gabriel", "romantic warrior", "nekromantix",
        "negromantix", "romantic worrior", "the swan romantic", "necromanti",
        "nekromanti", "phil collins",
    ],
    "sad": [
        "crusade", "cat stevens", "sadie", "cansado", "palisades", "ablusado",
        "sadist", "pasad", "sade", "pesad", "masada", "all-american rejects",
        "prasad", "sadventure", "sadiddy", "chris garneau", "the ataris",
        "moody blues", "toni braxton", "casada", "incubus", "nick cave",
        "ryan cabrera", "wayne wonder", "cassady",
    ],
    "upbeat": [
        "too upbeat", "lemon zest", "niemogeprzestacsluchac", "zestcooooooool",
        "zestfunk", "zesthop", "zestig", "zestjazzy", "zestoko", "zestpsy",
        "zestteuf",
    ],
}

# Moods folded into four quadrants (applied as ordered substring rewrites)
# and the moods dropped afterwards. Fixed values.
QUADRANT_REWRITES: list[tuple[str, list[str]]] = [
    ("anger", ["aggression", "angst", "anger"]),
    ("happy", ["excitement", "upbeat", "cheerful", "happy"]),
    ("sad", ["depressed", "sad", "grief"]),
    ("calm", ["calm", "confident"]),
]
QUADRANT_EXCLUDED = ["dreamy", "desire", "earnest", "pessimism", "romantic", "brooding"]

_REGEX_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


@dataclass(frozen=True)
class Lexicon:
    """mood -> (exact, like, filter) lists plus the two mood orders."""

    exact: dict[str, list[str]]
    like: dict[str, list[str]] = field(default_factory=dict)
    filters: dict[str, list[str]] = field(default_factory=dict)

    @property
    def moods_exact_order(self) -> list[str]:
        return list(self.exact.keys())

    @property
    def moods_sorted(self) -> list[str]:
        return sorted(self.exact.keys())

    def is_literal(self) -> bool:
        """True when no like/filter term has a regex metacharacter, so
        substring search equals the regex search of the published code."""
        terms = [t for v in self.like.values() for t in v]
        terms += [t for v in self.filters.values() for t in v]
        return not any(_REGEX_META.search(t) for t in terms)

    def to_json(self) -> str:
        """The expanded-lexicon document: {mood: [exact, like, filter]}."""
        doc = {m: [self.exact[m], self.like.get(m, []), self.filters.get(m, [])]
               for m in self.exact}
        return json.dumps(doc, indent=4, sort_keys=True)


def full_lexicon() -> Lexicon:
    return Lexicon(MOOD_EXACT_TERMS, MOOD_LIKE_TERMS, MOOD_FILTER_TERMS)


def exact_terms_df(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """(mood, mood_ord, term): exact tags, mood_ord in lexicon order (1-based)."""
    rows = [(m, i + 1, t) for i, m in enumerate(lex.moods_exact_order)
            for t in lex.exact[m]]
    schema = "mood string, mood_ord int, term string"
    return spark.createDataFrame(rows, schema)


def like_terms_df(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """(mood, mood_ord, like_ord, term): mood_ord alphabetical (1-based)."""
    rows = [(m, i + 1, j + 1, t) for i, m in enumerate(lex.moods_sorted)
            for j, t in enumerate(lex.like.get(m, []))]
    return spark.createDataFrame(rows, "mood string, mood_ord int, like_ord int, term string")


def filter_terms_df(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """(mood, filter_ord, term): duplicates kept."""
    rows = [(m, j + 1, t) for m in lex.moods_sorted
            for j, t in enumerate(lex.filters.get(m, []))]
    return spark.createDataFrame(rows, "mood string, filter_ord int, term string")


def mood_table(spark: SparkSession, lex: Lexicon) -> DataFrame:
    """(mood, mood_ord) in alphabetical (expanded) order."""
    rows = [(m, i + 1) for i, m in enumerate(lex.moods_sorted)]
    return spark.createDataFrame(rows, "mood string, mood_ord int")


LEXICON_JSON_SCHEMA = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType())))


def lexicon_from_json_column(doc: DataFrame, col: str = "value") -> DataFrame:
    """Parse lexicon JSON text rows into (mood, kind, term_ord, term).

    kind is 0 = exact, 1 = like, 2 = filter. Runs as column expressions,
    so a stored lexicon can be joined without a driver round trip.
    """
    parsed = doc.select(F.from_json(F.col(col), LEXICON_JSON_SCHEMA).alias("m"))
    per_mood = parsed.select(F.explode("m").alias("mood", "lists"))
    per_kind = per_mood.select("mood", F.posexplode("lists").alias("kind", "terms"))
    return per_kind.select("mood", "kind",
                           F.posexplode("terms").alias("term_ord", "term"))
