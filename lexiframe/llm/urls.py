"""URL filter: host/path rules, then a weighted URL vocabulary counted by Aho-Corasick.

The vocabulary has strict and soft terms.  One automaton finds every term in
one pass over the lower-cased URL; a hit counts only between boundaries (no
ASCII letter or digit on either side).  A URL is rejected on one strict term
or on ``min_soft`` distinct soft terms.  A rule that fits the URL overrides
the vocabulary.

Defined results: a null URL, or one without ``://``, has empty host and path
and no rule; a null URL has no hits (allow).  Ties between rules of the same
length cannot fit the same URL unless the rules are equal; the first given
wins.  Repeated rows are judged alike; an empty table gives an empty result.
One narrow pass: no shuffle, and memory is one batch plus the automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiframe.llm.common import lower_az

# Production vocabulary (parameters of the registered query).
STRICT_TERMS = ("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "porn",
                "sex", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bet", "bets", "bonus", "cheap", "click", "crack", "deal", "discount", "farm", "free",
              "jackpot", "loan", "pills", "poker", "prize", "promo", "track", "tracker", "win", "winner")
MIN_SOFT = 2
# (verdict, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))

SCHEMA = "host string, path string, rule string, verdict string, n_strict long, n_soft long"

_SPLIT = re.compile(r"^(?s:.*?)://([^/?#]*)([^?#]*)")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host (up to ``/``, ``?``, ``#`` or the end) and path (up to ``?``, ``#`` or the end)."""
    m = _SPLIT.match(url) if url is not None else None
    return (lower_az(m[1]), m[2]) if m else ("", "")


def build_automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            if t:
                auto.add_word(lower_az(t), (kind, lower_az(t)))  # a term in both lists is strict
    if len(auto):
        auto.make_automaton()
    return auto


def count_terms(auto, url: str | None) -> tuple[int, int]:
    """Strict hits and distinct soft terms of one URL, boundaries checked."""
    if not url or not len(auto):
        return 0, 0
    s = lower_az(url)
    n_strict, soft = 0, set()
    for end, (kind, term) in auto.iter(s):
        start = end - len(term) + 1
        if (start and s[start - 1] in _ALNUM) or (end + 1 < len(s) and s[end + 1] in _ALNUM):
            continue
        if kind == "strict":
            n_strict += 1
        else:
            soft.add(term)
    return n_strict, len(soft)


def index_rules(rules: Iterable[tuple[str, str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host, the longest path first: ``host -> [(path, rule text, verdict)]``."""
    out: dict[str, list] = {}
    for verdict, host, path in rules:
        out.setdefault(lower_az(host), []).append((path, host + path, verdict))
    return {h: sorted(r, key=lambda x: -len(x[0])) for h, r in out.items()}


def best_rule(by_host: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule whose host is the URL's or a parent domain and whose path begins the URL's."""
    best, at = None, 0
    while host and at >= 0:
        name = host[at:]
        for rule_path, text, verdict in by_host.get(name, ()):
            if path.startswith(rule_path):
                if best is None or len(text) > len(best[0]):
                    best = (text, verdict)
                break
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return best


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url",
               strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
               min_soft: int = MIN_SOFT, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(key, host, path, rule, verdict, n_strict, n_soft)``, one row per row of ``pages``."""
    rows = pages.select(key, url)
    kind = rows.schema[key].dataType.simpleString()
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, by_host = build_automaton(strict, soft), index_rules(rules)
        for b in batches:
            out = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                n_strict, n_soft = count_terms(auto, u)
                rule = best_rule(by_host, host, path)
                own = "block" if n_strict >= 1 or n_soft >= min_soft else "allow"
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else own, n_strict, n_soft))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=[key, "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def oracle_sql(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, min_soft: int = MIN_SOFT,
               rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """The same judgement as DuckDB SQL: term counts by regular expressions."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # a boundary is zero-width in the automaton, so neighbouring hits may share it: double it before counting
    u = "regexp_replace(coalesce(u, ''), '([^a-z0-9])', '\\1\\1', 'g')"
    n_strict = " + ".join(f"len(regexp_extract_all({u}, '(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)'))" for t in strict)
    n_soft = " + ".join(f"CAST(regexp_matches(coalesce(u, ''), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in soft)
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in by_length]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, by_length))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, by_length))
    return f"""
WITH parts AS (
  SELECT page_id, {low.format('url')} AS u,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, u, coalesce({low.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
hits AS (
  SELECT *, CAST({n_strict} AS BIGINT) AS n_strict, CAST({n_soft} AS BIGINT) AS n_soft FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {int(min_soft)} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM hits"""
