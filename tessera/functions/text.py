"""Column functions on text: tokens, words, hashes, chunk ids, splits and refusal reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns, stopwords, secret shapes and query markers.
TOKEN = r"(?i)[a-z0-9](?:[a-z0-9_./:-]*[a-z0-9])?"
WORD = r"(?i)[a-z0-9]+"
SCAN_TOKEN = r"(?i)[a-z0-9][a-z0-9_./:-]*"
STOPWORDS = """
a about after all also an and any are as at be because been before being both but by came can
could did do does done for from get gets got had has have he her here hers him his how i if in into is
it its just like made make many may me might more most much must my never no nor not now of off on one
only or other our out over own said same see she should since so some such than that the their them
then there these they this those through to too under until up use used using very was way we well
were what when where which while who why will with within without would you your
""".split()
SECRETS = [
    ("private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("AWS access key id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("API token", r"\b(?:sk|ghp|github_pat)[_-][A-Za-z0-9_-]{20,}\b"),
    ("Slack token", r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b"),
    ("key or token assignment", r"""(?im)^\s*(?:api[_-]?key|access[_-]?token|client[_-]?secret)\s*[=:]\s*['"]?[A-Za-z0-9_./+-]{20,}"""),
]
PRIVATE_MARKERS = [".env", "access token", "api key", "credential locker", "password", "personal memory", "private conversation", "secret key"]
#: White space as Python's str.strip and \s take it.
SPACE = r"[\s\x1c-\x1f]"


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def tokens(text: Column) -> Column:
    """Identifiers stay whole; both ends are letters or digits."""
    return _all(text, TOKEN)


def words(text: Column) -> Column:
    return _all(text, WORD)


def scan_tokens(text: Column) -> Column:
    """Tokens of the scanning baselines, which keep trailing punctuation."""
    return _all(text, SCAN_TOKEN)


def _without_stopwords(terms: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(terms, lambda t: ~F.array_contains(stop, t))


def keyword_terms(question: Column) -> Column:
    """A query's terms without stopwords, repeats kept; all of them if none is left."""
    bound = F.transform(F.array(tokens(question)), lambda t: F.struct(t.alias("all"), _without_stopwords(t).alias("some")))
    return F.element_at(F.transform(bound, lambda b: F.when(F.size(b["some"]) == 0, b["all"]).otherwise(b["some"])), 1)


def scan_terms(question: Column) -> Column:
    """Distinct terms of the scanning baselines in order; none if all are stopwords."""
    return F.array_distinct(_without_stopwords(scan_tokens(question)))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def chunk_id(path: Column, ordinal: Column, text_hash: Column) -> Column:
    return F.substring(sha256(F.concat_ws(":", path, ordinal.cast("string"), text_hash)), 1, 24)


def split_of(query_id: Column) -> Column:
    """dev for three tenths of the ids: the sha256 as a number, modulo 10, below 3."""
    h = sha256(query_id)
    values = F.transform(F.split(h, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    high = F.aggregate(F.slice(values, 1, 63), F.lit(0), lambda a, v: a + v)
    return F.when((6 * high + F.element_at(values, 64)) % 10 < 3, "dev").otherwise("test")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def secret_reason(text: Column) -> Column:
    """Name of the first secret shape in a text, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in SECRETS])


def private_query_reason(question: Column) -> Column:
    """The marker, or else the secret shape, for which a question is refused; null if it is not."""
    low = folded(question)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in PRIVATE_MARKERS], secret_reason(question))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regex over the whole path; * crosses folders."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = end
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO-8601 (Z, an offset, or none for UTC) to epoch seconds."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6
