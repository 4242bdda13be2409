"""URLs and sources: tiers, relevance, keywords. The tables are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URL pattern -> tier for citations; the first match counts, else 5.
CITATION_TIERS = (
    (r"djmag\.com", 2),
    (r"residentadvisor\.net", 2),
    (r"mixmag\.net", 2),
    (r"xlr8r\.com", 2),
    (r"thequietus\.com", 2),
    (r"pitchfork\.com", 2),
    (r"factmag\.com", 2),
    (r"19hz\.info", 3),
    (r"flyerarchive", 3),
    (r"discogs\.com/forum", 6),
    (r"reddit\.com", 6),
    (r"discogs\.com", 4),
    (r"musicbrainz\.org", 4),
    (r"wikipedia\.org", 5),
)
#: URL pattern -> tier for research; else 6.
RESEARCH_TIERS = (
    (r"residentadvisor\.net|ra\.co", 1),
    (r"djmag\.com", 1),
    (r"mixmag\.net", 1),
    (r"xlr8r\.com", 2),
    (r"pitchfork\.com", 2),
    (r"thequietus\.com", 2),
    (r"factmag\.com|factmagazine\.co\.uk", 2),
    (r"discogs\.com", 3),
    (r"musicbrainz\.org", 3),
    (r"bandcamp\.com", 3),
    (r"beatport\.com", 3),
    (r"soundcloud\.com", 4),
    (r"youtube\.com|youtu\.be", 4),
    (r"wikipedia\.org", 4),
    (r"reddit\.com", 5),
    (r"facebook\.com|instagram\.com|twitter\.com|x\.com", 5),
)
#: URL pattern -> (type, tier) for articles; else ("article", 5).
ARTICLE_TIERS = (
    (r"residentadvisor\.net", "press", 2),
    (r"ra\.co", "press", 2),
    (r"mixmag\.net", "press", 2),
    (r"djmag\.com", "press", 2),
    (r"thequietus\.com", "press", 2),
    (r"pitchfork\.com", "press", 2),
    (r"factmag\.com", "press", 2),
    (r"thefader\.com", "press", 2),
    (r"xlr8r\.com", "press", 2),
    (r"electronicbeats\.net", "press", 2),
    (r"redbullmusicacademy\.", "interview", 3),
    (r"rbma\.", "interview", 3),
    (r"boilerroom\.", "interview", 3),
    (r"wikipedia\.org", "reference", 4),
    (r"discogs\.com", "reference", 4),
    (r"musicbrainz\.org", "reference", 4),
    (r"reddit\.com", "forum", 6),
    (r"forums?\.", "forum", 6),
)
GENRE_KEYWORDS = (
    "house", "techno", "rave", "drum", "bass", "jungle", "detroit", "disco", "acid", "garage", "dubstep", "breakbeat",
    "chicago", "ambient", "trance", "gabber", "hardcore", "industrial", "electro", "minimal", "dub", "deep",
    "electronic", "dance", "club", "warehouse", "underground", "303", "808", "909", "synth", "remix", "turntable",
    "vinyl", "bpm", "nightclub", "soundsystem", "pirate-radio", "free-party",
)
LEAST_KEYWORDS = 3
MUSIC_DOMAINS = (
    r"ra\.co|residentadvisor|djmag\.com|mixmag\.net|xlr8r\.com|pitchfork\.com|thequietus\.com|factmag\.com|factmagazine|"
    r"discogs\.com|musicbrainz\.org|bandcamp\.com|beatport\.com|soundcloud\.com|youtube\.com|youtu\.be|boilerroom\.tv|"
    r"traxsource\.com|juno\.co\.uk|boomkat\.com|electronicbeats\.net|djtechtools\.com|attackmagazine\.com"
)
MUSIC_TERMS = (
    r"\b(?:dj|producer|remix|techno|house|drum\s*(?:and|&|n)\s*bass|electronic\s*music|rave|club|vinyl|label|release|mix|"
    r"track|bpm|ep\b|lp\b|album|record|boiler\s*room|soundsystem|beatport|discogs|bandcamp|resident\s*advisor|soundcloud|"
    r"dance\s*music|edm|jungle|garage|dubstep|acid|trance|breakbeat|ambient|industrial|synth|turntable|decks|festival|"
    r"warehouse|nightclub|set\b|lineup|b2b)\b"
)


def first_match(url: Column, table: tuple, place: int, otherwise) -> Column:
    """The entry of the first pattern that a URL has, whatever its case."""
    cases = reduce(lambda c, row: c.when(url.rlike(f"(?i){row[0]}"), F.lit(row[place])), table, F.when(F.lit(False), F.lit(otherwise)))
    return cases.otherwise(F.lit(otherwise))


def first_match_sql(url: str, table: tuple, place: int, otherwise) -> str:
    """`first_match` as SQL."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"when regexp_matches({url}, '(?i){row[0]}') then {value(row[place])}" for row in table)
    return f"case {whens} else {value(otherwise)} end"


def domain(url: Column) -> Column:
    """The host without www., lower case; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def last_segment(url: Column) -> Column:
    """The last part of the path, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def keywords_in(text: Column, keywords: tuple[str, ...] = GENRE_KEYWORDS) -> Column:
    """Those of the keywords that a text contains."""
    return F.filter(F.array(*[F.lit(k) for k in sorted(keywords)]), lambda k: F.contains(F.lower(text), k))


def is_music_relevant(url: Column, title: Column, snippet: Column) -> Column:
    text = F.concat_ws(" ", title, snippet)
    return F.coalesce(url.rlike(f"(?i){MUSIC_DOMAINS}"), F.lit(False)) | text.rlike(f"(?i){MUSIC_TERMS}")


def normal_url(url: Column) -> Column:
    """Without query, fragment and trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""))
