"""Fixed parameters of the registered queries (FIXTURES.md: small literal
tables for search tests)."""

import datetime as _dt

# Search terms, hashtags, communities, platforms of the tests.
KEYWORDS = ["the", "license", "zzz"]
# All pairs of ten consonants and ten vowels or endings: 100 terms.
MANY_KEYWORDS = [a + b for a in "bcdfglmnrt" for b in ("a", "e", "i", "o", "u", "an", "en", "er", "es", "on")]
# All triples of eight consonants, five vowels and ten consonants: 400 terms.
LONG_KEYWORDS = [a + b + c for a in "bcdlmprt" for b in "aeiou" for c in "bcdgklmnrs"]
HASHTAGS = ["topic1", "#topic2"]
SUBREDDITS = ["src0", "src1", "nosuch"]
PLATFORMS = ["reddit", "bluesky", "mastodon", "lemmy"]
INSTANCES = ["https://mastodon.social", "mastodon.technology", "nosuch.example"]
BSKY_AUTHORS = ["u7.bsky.app", "u8.bsky.app", "nobody.bsky.app"]
MASTO_ACCOUNTS = ["@m7@mastodon.technology", "m8@mastodon.social", "@m7@mastodon.social"]
FLAIRS = ["EN", "de"]
FLAIR_WINDOW = ("2024-01-06 00:00:00", "2024-01-21 12:00:00")
NEWS_KEYWORDS = ["the"]
NEWS_DOMAINS = ["example.com"]
NEWS_WINDOW = ("2024-01-05", "2024-01-20")

AS_OF = "2024-01-29 00:00:00"
SEARCH_AS_OF = "2024-01-29 00:00:00"


def epoch_us(ts: str) -> int:
    d = _dt.datetime.strptime(ts, "%Y-%m-%d %H:%M:%S").replace(tzinfo=_dt.timezone.utc)
    return int(d.timestamp()) * 1_000_000


DAY_US = 86400 * 1_000_000
