"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where it stands by itself: the characters before and after it
are no ASCII letters or digits. One strict term, or ``min_soft`` different soft
terms, reject a url. Host rules come first: the longest rule that fits decides,
of equally long ones the first given.

A vocabulary is read from a table of terms and their class (``vocabulary``) and
sent to the executors once; a worker builds its automaton once and keeps it for
all tasks that use the same terms.

A null url, or one without ``://``, has an empty host and path and fits no
rule; a null url has no terms and is allowed. Repeated rows are judged each by
itself, an empty table gives an empty result, and columns besides the id and
the url are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.common import table
from tallygrain.llm.registry import query


class Rule(NamedTuple):
    """``host`` and its subdomains, paths from ``path`` on: ``verdict``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
STRICT = ("spam-farm", "cheap-pills", "casino-bonus", "porn", "xxx", "hentai", "escort-girls", "warez", "torrents")
SOFT = ("spam", "farm", "cheap", "pills", "casino", "bonus", "free", "win", "sexy", "adult", "betting", "click", "buy")
MIN_SOFT = 2
MOST_TERMS = 1 << 20  # of a vocabulary that is read from a table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER_OR_DIGIT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case up to the first ``/``, ``?`` or ``#``; path from there up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    # the last that fits counts, so the first given of equally long rules comes last
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def vocabulary(terms: DataFrame, term_col: str = "term", class_col: str = "class") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table whose classes are ``strict`` and ``soft``.

    Terms are put in lower case; null and empty ones are left out; a term of both
    classes is strict. More than ``MOST_TERMS`` are refused, as every worker
    holds them all.
    """
    term = F.translate(F.trim(F.col(term_col)), UPPER, LOWER).alias("term")
    given = terms.select(term, F.col(class_col).alias("class")).filter("term != '' and class in ('strict', 'soft')")
    found = given.groupBy("term").agg(F.max("class").alias("class")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    by_class = {c: tuple(sorted(r["term"] for r in found if r["class"] == c)) for c in ("strict", "soft")}
    return by_class["strict"], by_class["soft"]


# the automaton of a worker, by the checksum of its terms: the last one used
_KEPT: dict[str, ahocorasick.Automaton] = {}


def kept_automaton(key: str, strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = automaton(strict, soft)
    return _KEPT[key]


def terms_in(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Occurrences of strict terms and the number of different soft terms."""
    strict, soft = 0, set()
    for last, (term, is_strict) in found.iter(url):
        first = last - len(term) + 1
        if first and url[first - 1] in LETTER_OR_DIGIT:
            continue
        if last + 1 < len(url) and url[last + 1] in LETTER_OR_DIGIT:
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def filter_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """One row per row: id, url, host, path, rule, n_strict, n_soft, verdict."""

    sent = df.sparkSession.sparkContext.broadcast((tuple(strict), tuple(soft)))
    key = hashlib.sha256("\n".join([*strict, "", *soft]).encode()).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = kept_automaton(key, *sent.value)
        for batch in batches:
            hits = [terms_in(u or "", found) for u in batch.column("_lower").to_pylist()]
            columns = [pa.array([h[i] for h in hits], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["_id", "_url", "n_strict", "n_soft"]
            )

    lower = F.translate(F.col(url_col), UPPER, LOWER)
    given = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), lower.alias("_lower"))
    id_type = given.schema["_id"].dataType.simpleString()
    counted = given.mapInArrow(count, f"_id {id_type}, _url string, n_strict int, n_soft int")
    host, path = host_and_path(F.col("_url"))
    parts = counted.withColumns({"host": host, "path": path})
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("n_strict") > 0) | (F.col("n_soft") >= min_soft)
    return parts.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        "host",
        "path",
        rule.alias("rule"),
        "n_strict",
        "n_soft",
        F.coalesce(decided, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
    )


def _times(term: str) -> str:
    """DuckDB: how often ``term`` stands by itself in ``u``; a boundary may serve two neighbours."""
    spread = f"regexp_replace(u, '[^a-z0-9]', '\\0\\0', 'g')"
    wide = "".join(c if c.isalnum() else c + c for c in term)
    return f"len(regexp_extract_all({spread}, '(^|[^a-z0-9]){wide}([^a-z0-9]|$)'))"


def _check_sql() -> str:
    fits = [f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')" for r in RULES]
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i].text))
    rule = " ".join(f"when {fits[i]} then '{RULES[i].text}'" for i in order)
    decided = " ".join(f"when rule = '{r.text}' then '{r.verdict}'" for r in RULES)
    strict = " + ".join(_times(t) for t in STRICT)
    soft = " + ".join(f"({_times(t)} > 0)::int" for t in SOFT)
    return rf"""
with lowered as (
  select page_id, url,
    coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as u,
    case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select page_id, u, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path,
    ({strict})::int as n_strict, ({soft})::int as n_soft
  from lowered
), ruled as (select *, case {rule} end as rule from parts)
select page_id, host, path, rule, n_strict, n_soft,
  case {decided} when n_strict > 0 or n_soft >= {MIN_SOFT} then 'block' else 'allow' end as verdict
from ruled"""


@query("op1_url_filter", _check_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("url")
