"""URL filtering with host rules and a weighted vocabulary.

An Aho-Corasick automaton finds all vocabulary terms of a url in one pass; a hit counts if no letter or digit touches it.  One
strict hit rejects, as do soft hits on distinct terms whose weights reach the limit.  The vocabulary can be loaded from a table.  Rules come first: the longest rule that
fits host and path decides alone.

A null url, or one with no `://`, has an empty host and path; no rule fits it, and its terms count as in any other.  Rows are
judged one by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import LOWER_AZ, UPPER_AZ, lower_az


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


# Terms of which one rejects.
STRICT = (
    "anal", "bestiality", "blowjob", "bukkake", "camgirl", "camgirls", "casino", "cialis", "creampie", "cumshot", "deepthroat", "escort", "escorts",
    "fetish", "gangbang", "hardcore", "hentai", "jackpot", "keygen", "levitra", "milf", "nsfw", "orgy", "porn", "porno", "pornstar", "roulette", "sexcam",
    "sportsbook", "viagra", "warez", "xnxx", "xvideos", "xxx",
)
# Terms of which several reject, with their weights.
SOFT = (
    ("adult", 1.0), ("affiliate", 0.5), ("babes", 1.0), ("bet", 1.0), ("bets", 1.0), ("betting", 1.0), ("bingo", 1.0), ("bonus", 0.5), ("buy", 0.5), ("cam", 0.5), ("cams", 1.0),
    ("cash", 0.5), ("cheap", 1.0), ("clickbait", 1.0), ("click", 1.0), ("crack", 1.0), ("cracked", 1.0), ("credit", 0.5), ("crypto", 0.5), ("dating", 1.0), ("deals", 0.5),
    ("discount", 0.5), ("download", 0.5), ("erotic", 1.0), ("farm", 0.5), ("forex", 1.0), ("free", 0.5), ("gambling", 1.0), ("girls", 0.5), ("giveaway", 1.0), ("hot", 0.5),
    ("hookup", 1.0), ("lingerie", 0.5), ("loan", 1.0), ("loans", 1.0), ("lottery", 1.0), ("meds", 1.0), ("naked", 1.0), ("nude", 1.0), ("nudes", 1.0), ("offer", 0.5),
    ("online", 0.5), ("payday", 1.0), ("pharmacy", 1.0), ("pills", 1.0), ("poker", 1.0), ("promo", 0.5), ("replica", 1.0), ("rx", 0.5), ("sale", 0.5), ("seo", 1.0), ("serial", 0.5),
    ("sex", 1.0), ("sexy", 1.0), ("singles", 0.5), ("slot", 0.5), ("slots", 1.0), ("spam", 1.0), ("spin", 0.5), ("torrent", 1.0), ("torrents", 1.0), ("wager", 1.0),
    ("weightloss", 1.0), ("win", 0.5), ("winner", 0.5), ("x", 0.5),
)


@dataclass(frozen=True)
class UrlVocabulary:
    strict: tuple[str, ...] = STRICT
    #: Terms with their weights.
    soft: tuple[tuple[str, float], ...] = SOFT
    #: Least number of distinct soft terms, and least sum of their weights, that reject.
    soft_terms: int = 2
    soft_weight: float = 1.5

    @classmethod
    def from_table(cls, terms: DataFrame, most_terms: int = 1_000_000) -> UrlVocabulary:
        """A vocabulary of rows (term, weight), a null weight for strict terms; A to Z lower-cased, empty terms left out, of equal terms the heaviest.

        The automaton goes to all tasks, so a table of more than most_terms rows is an error.
        """
        found = terms.where("term <> ''").groupBy(F.translate("term", UPPER_AZ, LOWER_AZ).alias("term")).agg(F.max(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
        rows = found.orderBy("term").limit(most_terms + 1).collect()
        if len(rows) > most_terms:
            raise ValueError(f"more than {most_terms} vocabulary terms")
        return cls(tuple(r["term"] for r in rows if r["strict"]), tuple((r["term"], float(r["weight"])) for r in rows if not r["strict"]))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for t in self.strict:
            out.add_word(t, (t, None))
        for t, w in self.soft:
            out.add_word(t, (t, w))
        out.make_automaton()
        return out


def _open(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def vocabulary_hits(url: str | None, automaton: ahocorasick.Automaton) -> tuple[int, dict[str, float]]:
    """Strict hits, and the weights of the distinct soft terms, with nothing alphanumeric (ASCII) beside them."""
    strict, soft = 0, {}
    text = lower_az(url or "")
    for last, (term, weight) in automaton.iter(text):
        first = last - len(term) + 1
        if (first == 0 or _open(text[first - 1])) and (last + 1 == len(text) or _open(text[last + 1])):
            if weight is None:
                strict += 1
            else:
                soft[term] = weight
    return strict, soft


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = DEFAULT_RULES, vocabulary: UrlVocabulary | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight for each row of (page_id, url)."""
    v = vocabulary or UrlVocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = v.automaton()
        for batch in batches:
            hits = [vocabulary_hits(u, automaton) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in hits], pa.int32()), pa.array([len(s) for _, s in hits], pa.int32()), pa.array([float(sum(s.values())) for _, s in hits], pa.float64())],
                names=["page_id", "url", "n_strict", "n_soft", "soft_weight"],
            )

    found = pages.select("page_id", "url").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, n_strict int, n_soft int, soft_weight double")
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    found = found.withColumn("_after", after).withColumn("_host", F.regexp_extract("_after", r"^([^/?#]*)", 1))
    host = F.translate("_host", UPPER_AZ, LOWER_AZ)
    path = F.regexp_extract(F.expr("substring(_after, length(_host) + 1)"), r"^([^?#]*)", 1)
    found = found.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "n_strict", "n_soft", "soft_weight")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later ones, the longer, go before
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    rejected = (F.col("n_strict") > 0) | ((F.col("n_soft") >= v.soft_terms) & (F.col("soft_weight") >= v.soft_weight))
    own = F.when(rejected, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft", "soft_weight")


def oracle_sql(rules: tuple[UrlRule, ...] = DEFAULT_RULES, vocabulary: UrlVocabulary | None = None) -> str:
    """The same in DuckDB SQL over a table pages; vocabulary terms hold letters, digits and hyphens only."""
    v = vocabulary or UrlVocabulary()
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)]
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    soft = [(f"CAST({hit(t)} AS INT)", w) for t, w in v.soft]
    one = f"translate(u, '{UPPER_AZ}', '{LOWER_AZ}')"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, {one} AS low, CASE WHEN contains(u, '://') THEN substring(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM b),
d AS (SELECT page_id, low, translate(h, '{UPPER_AZ}', '{LOWER_AZ}') AS host, regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path FROM c),
e AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r.text}'" for c, r in fits)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)} END AS ruled,
  {' OR '.join(hit(t) for t in v.strict)} AS strict_hit,
  {' + '.join(c for c, _ in soft)} AS n_soft, {' + '.join(f'{c} * {w}' for c, w in soft)} AS weight FROM d)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hit OR (n_soft >= {v.soft_terms} AND weight >= {v.soft_weight}) THEN 'block' ELSE 'allow' END) AS verdict FROM e"""
