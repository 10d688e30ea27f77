"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions propose spans.  Binary labelers vote on each: a stricter
pattern, a gazetteer (country codes, card issuers, mail suffixes), words of its
own kind in the context, general contact words, and words that speak against
it.  Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; a
logistic classifier of kind, votes and length is then trained on these soft
labels.  Spans of the base kinds always stay; spans of the other kinds are added
if the classifier gives them ``threshold`` or more and no base span overlaps.

The only rows that reach the driver are counts of feature patterns, at most
``len(KINDS) * 2 ** len(LABELERS) * 3`` of them whatever the input.

Kinds beyond the base ones: IBANs, social security numbers, local phone numbers, and
secrets (keys, tokens and passwords of 16 characters or more that are assigned to a
name that says so, or begin as their issuers begin them).

Spans are code points, end exclusive.  Patterns that repeat groups are rewritten
to character classes over equally long texts, so that long runs neither
backtrack nor overflow the stack.

Defined results: null texts count as empty; an empty text has no spans.  Each row
is judged on its own, repeated rows alike.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import stored

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "local_phone", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
LABELERS = ("strict", "gazetteer", "own_context", "contact_context", "against")
CONTEXT = 30  # characters before and after a span
THRESHOLD = 0.5
EM_ROUNDS, FIT_ROUNDS, RATE = 30, 300, 0.5

# Gazetteers and context words of the labelers (any may be replaced).
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
MAIL_SUFFIXES = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|ch|at|be|eu"
OWN_WORDS = {
    "email": "e-?mail|mail|write to|contact", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|mastercard|amex|payment",
    "phone": "phone|tel|call|mobile|fax|cell|contact", "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security", "local_phone": "phone|tel|call|mobile|fax|cell|contact",
    "secret": "token|secret|key|passw|bearer|auth|credential",
}
CONTACT_WORDS = "name|contact|address|reach|call|phone|mail|customer|patient|mr|mrs|dr"
AGAINST_WORDS = "version|release|isbn|issn|order|invoice|serial|build|figure|section|doi|commit|checksum|md5|sha1|sha256|digest|etag"
# How issuers of keys begin them, and what a key is assigned to.
KEY_STARTS = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_|rk_|pk_|xox[abprs]-|AIza|eyJ|ya29"
KEY_NAMES = (r"(token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth[_ -]?key|passw(or)?d|passwd|pwd|bearer|authorization|credentials?)"
             r"[a-z_-]{0,12}[\"']?\s*(=>?|:|\bis\b)?\s*[\"']?$")

# The base patterns, in a form that cannot backtrack far.  A match may start
# where the last one ended, or where no earlier start would have matched too.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"

# A run that could be a key or a token; longer ones are data.
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,256}+(?![A-Za-z0-9+/_-])"

SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
CHUNK = 256


def matches(text: Column, pattern: str) -> Column:
    """All matches with offsets and context, as an array of SPAN.  The spans are
    gathered in chunks, so that n matches don't cost n copies of the array."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    steps = F.zip_with(F.arrays_zip(found.alias("v"), F.slice(gaps, 1, n).alias("b")), F.slice(gaps, 2, n),
                       lambda x, after: F.struct(x["v"].alias("v"), x["b"].alias("b"), after.alias("a")))
    none, empty = F.array().cast(f"array<{SPAN}>"), F.array().cast(f"array<array<{SPAN}>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["v"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"),
                                F.right(x["b"], F.lit(CONTEXT)).alias("before"),
                                F.substring(x["a"], 1, CONTEXT).alias("after")))
        full = F.size(s["part"]) >= CHUNK
        return F.struct(end.alias("at"), F.when(full, span).otherwise(F.concat(s["part"], span)).alias("part"),
                        F.when(full, F.concat(s["done"], F.array(s["part"]))).otherwise(s["done"]).alias("done"))

    start = F.struct(F.lit(0).alias("at"), none.alias("part"), empty.alias("done"))
    return F.aggregate(steps, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["part"]))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _only(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> list[Column]:
    """Spans of each of KINDS, failing matches already dropped."""
    # Dots that no label follows cannot be in a domain; as "%" they still may be
    # before the "@".  Separators that are not between two digits end a number.
    mail = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "%")
    number = F.regexp_replace(text, r"(?<![0-9])[ -]|[ -](?![0-9])", "_")
    size = lambda x: F.length(digits(x["value"]))
    parts = lambda x: F.split(x["value"], r"\.")
    return [
        _only(F.contains(text, F.lit("@")), matches(mail, EMAIL)),
        _only(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda x: F.forall(
            parts(x), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)
            & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255)))),
        _only(text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), F.filter(matches(number, CARD), lambda x: size(x).between(12, 19) & luhn(digits(x["value"])))),
        _only(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: size(x).between(9, 15))),
        _only(text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), matches(text, IBAN)),
        _only(text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), matches(text, SSN)),
        _only(text.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), matches(text, LOCAL_PHONE)),
        _only(text.rlike(f"(?i)token|secret|key|passw|pwd|bearer|auth|credential|{KEY_STARTS}"), F.filter(matches(text, SECRET), _secret)),
    ]


def _letters(value: Column) -> Column:
    """The number of different characters."""
    return F.size(F.array_distinct(F.split(value, "")))


def _secret(x: Column) -> Column:
    """Whether a run may be a secret at all: letters and digits that hardly repeat,
    begun as an issuer begins its keys, or assigned to a name of a secret."""
    value = x["value"]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (_letters(value) >= 8)
    return mixed & (value.rlike(f"^({KEY_STARTS})") | F.lower(x["before"]).rlike(KEY_NAMES))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every candidate span of every row, ordered by start and
    kind, with the kind's place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def tag(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"),
            x["before"].alias("before"), x["after"].alias("after")))

    tagged = [tag(spans, k) for k, spans in enumerate(candidates(text))]
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.array_sort(F.concat(*tagged)).alias("spans"))


def _by_kind(kind: Column, choices: dict[str, Column], other: Column) -> Column:
    out = other
    for name, choice in choices.items():
        out = F.when(kind == KINDS.index(name), choice).otherwise(out)
    return out


def votes(x: Column) -> list[Column]:
    """The labelers' votes (0 or 1) on a span."""
    value, kind, yes = x["value"], x["kind"], F.lit(True)
    around = F.lower(F.concat_ws(" ", x["before"], x["after"]))
    number = digits(value)
    strict = _by_kind(kind, {
        "email": value.rlike(r"\.[A-Za-z]{2,}$"), "ip": ~value.rlike(r"^(0|127|255)\."), "card": value.rlike("^[3-6]"),
        "phone": F.length(number).between(10, 13), "ssn": ~value.rlike("^(000|666|9)"),
        "iban": F.length(value).between(15, 42), "local_phone": value.rlike(r"^\(?[2-9]"), "secret": _letters(value) >= 10}, yes)
    gazetteer = _by_kind(kind, {
        "email": value.rlike(rf"\.({MAIL_SUFFIXES})$"), "ip": ~value.rlike(r"^(10|192\.168)\."),
        "card": number.rlike("^(4|5[1-5]|3[47]|6011|65)"), "phone": number.rlike(f"^({COUNTRY_CODES})"),
        "iban": value.rlike(f"^({IBAN_COUNTRIES})"), "ssn": ~value.rlike("-0000$"), "local_phone": ~value.rlike(r"^\(?(911|555)"),
        "secret": value.rlike(f"^({KEY_STARTS})") | value.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")}, yes)
    own = _by_kind(kind, {k: F.lower(x["before"]).rlike(w) for k, w in OWN_WORDS.items()}, yes)
    contact = around.rlike(rf"\b({CONTACT_WORDS})\b")
    against = F.lower(x["before"]).rlike(rf"\b({AGAINST_WORDS})\b")
    return [v.cast("int") for v in (strict, gazetteer, own, contact, against)]


def _length_class(x: Column) -> Column:
    n = x["end"] - x["start"]
    return F.when(n < 12, 0).when(n < 20, 1).otherwise(2)


def pattern_counts(spans: DataFrame) -> list[tuple]:
    """((kind, length class, votes...), count) over all spans: a bounded table."""
    each = spans.select(F.explode("spans").alias("x"))
    names = [f"v{j}" for j in range(len(LABELERS))]
    x = F.col("x")
    rows = each.select(x["kind"].alias("kind"), _length_class(x).alias("size"), *[v.alias(n) for v, n in zip(votes(x), names)])
    return [(tuple(r)[:-1], r["count"]) for r in rows.groupBy("kind", "size", *names).count().collect()]


def estimate(counts: list[tuple]) -> tuple[dict, list[tuple[float, float]]]:
    """Expectation-maximisation for two classes and independent labelers: the
    posterior of each vote pattern, and each labeler's rates of 1 in the classes."""
    patterns: dict[tuple, int] = defaultdict(int)
    for key, n in counts:
        patterns[key[2:]] += n
    share = 0.5
    rates = [(0.2, 0.6) if name == "against" else (0.7, 0.3) for name in LABELERS]
    posterior: dict[tuple, float] = {}
    for _ in range(EM_ROUNDS):
        for pattern in patterns:
            yes, no = share, 1 - share
            for vote, (p, q) in zip(pattern, rates):
                yes, no = yes * (p if vote else 1 - p), no * (q if vote else 1 - q)
            posterior[pattern] = yes / (yes + no)
        total = sum(patterns.values())
        weight = sum(posterior[p] * n for p, n in patterns.items())
        share = min(0.99, max(0.01, (weight + 1) / (total + 2)))
        # Smoothed with two observations of the starting rates, so nothing becomes certain.
        rates = [((sum(posterior[p] * n for p, n in patterns.items() if p[j]) + (0.4 if name == "against" else 1.4)) / (weight + 2),
                  (sum((1 - posterior[p]) * n for p, n in patterns.items() if p[j]) + (1.2 if name == "against" else 0.6)) / (total - weight + 2))
                 for j, name in enumerate(LABELERS)]
    return posterior, rates


def _features(key: tuple) -> list[float]:
    kind, size, *cast = key
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(size == s) for s in range(3)), *map(float, cast)]


def train(counts: list[tuple], posterior: dict) -> list[float]:
    """Logistic regression on the pattern counts, with the posteriors as soft labels."""
    rows = [(_features(key), posterior[key[2:]], n) for key, n in counts]
    total = sum(n for _, _, n in rows) or 1
    weights = [0.0] * (1 + len(KINDS) + 3 + len(LABELERS))
    for _ in range(FIT_ROUNDS):
        slope = [0.0] * len(weights)
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x))))
            for j, v in enumerate(x):
                slope[j] += (p - y) * v * n / total
        weights = [w - RATE * (g + 1e-4 * w) for w, g in zip(weights, slope)]
    return weights


def probability(x: Column, weights: list[float]) -> Column:
    """The classifier's probability for a span."""
    n = len(KINDS)
    logit = F.lit(weights[0]) + F.element_at(F.array(*map(F.lit, weights[1:1 + n])), x["kind"] + 1)
    logit = logit + F.element_at(F.array(*map(F.lit, weights[1 + n:4 + n])), _length_class(x) + 1)
    for w, v in zip(weights[4 + n:], votes(x)):
        logit = logit + F.lit(w) * v
    return 1 / (1 + F.exp(-logit))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (doc_id, base, spans), both arrays of
    (start, kind, end, kind_name, probability) by start, then kind."""
    found = stored(find_spans(docs, id_col, text_col), "spans")
    counts = pattern_counts(found)
    posterior, _ = estimate(counts)
    weights = train(counts, posterior)
    names = F.array(*map(F.lit, KINDS))
    scored = F.transform("spans", lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
        F.element_at(names, x["kind"] + 1).alias("name"), probability(x, weights).alias("probability")))
    each = found.select("doc_id", F.when(F.size("spans") > 0, scored).otherwise(
        F.array().cast("array<struct<start:int,kind:int,end:int,name:string,probability:double>>")).alias("scored"))
    base = F.filter("scored", lambda x: x["kind"] < len(BASE_KINDS))
    split = each.select("doc_id", base.alias("base"), "scored")
    stays = F.filter("scored", lambda x: (x["kind"] < len(BASE_KINDS)) | (
        (x["probability"] >= threshold) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    return split.select("doc_id", "base", stays.alias("spans"))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
