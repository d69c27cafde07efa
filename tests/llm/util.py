"""Small tables with the awkward cases, and plain brute-force helpers."""

import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}

LONG = " ".join(f"word{i % 700} and" for i in range(30_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away from the angry bear",
    "the quick brown fox jumps over the lazy dog and runs away from the angry bear",
    "The Quick brown fox jumps over the lazy dog and runs away from the angry wolf",
    "der schnelle braune fuchs springt über den faulen hund und läuft davon",
    "", None, "   \n\t ", "one two", "ÄÖÜ  ß \u2581 \U0001F600 emoji", "1234 5678 !!!", LONG, LONG,
    "line one here\nline two here\nline one here\n\nline three here",
]


def fold(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def docs(spark, texts=None, extra=True):
    """Documents with null and repeated ids, null sources, and columns that clash with results."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "a", None, "b"][i % 4], 7.0, "x", -1) for i, t in enumerate(texts)]
    if texts:
        rows += [(None, "the quick brown fox", "en", "a", 7.0, "x", -1), rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string, score double, component_id string, shard int"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source")


def words(t):
    return WORDS.findall((t or "").translate(UP))
