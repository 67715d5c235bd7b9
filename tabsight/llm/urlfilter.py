"""URL filter: host/path rules, then a weighted vocabulary of strict and soft terms.

Terms are found by one Aho-Corasick pass over the lower-cased url; a hit counts only where neither neighbour is a letter
or digit (a-z, 0-9).  One strict term rejects, and so do soft terms whose weights (each distinct term once) sum to the
vocabulary's limit or more.  Null, empty or scheme-less urls have an empty host and path; a null url holds no term.  Repeated rows
are judged one by one, an empty table gives no rows, and other columns (also ones named like the results) take no part.

A :class:`Vocabulary` is a tab-separated file: ``# version`` and ``# limit`` lines, then term, category, strict or soft, and the
weight of a soft term.  The package's own file is a default; callers load theirs by path.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import process_cache

DEFAULT_TERMS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_terms.tsv")
#: most terms that a vocabulary may have: it travels with every task
MAX_TERMS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms: ``strict`` ones with their category, ``soft`` ones with category and weight, and the limit of summed weights."""
    version: str
    strict: dict[str, str]
    soft: dict[str, tuple[str, float]]
    limit: float
    digest: str = field(init=False)

    def __post_init__(self):
        text = repr((self.version, sorted(self.strict.items()), sorted(self.soft.items()), self.limit))
        object.__setattr__(self, "digest", hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def parse_vocabulary(lines: Iterable[str]) -> Vocabulary:
    """A vocabulary from the lines of its file; the order of lines does not matter.  A malformed line, a term listed twice, or more
    than ``MAX_TERMS`` terms are errors."""
    version, limit, strict, soft = "", 2.0, {}, {}
    for line in lines:
        line = line.rstrip("\r\n")
        cells = line.split("\t")
        if line.startswith("#"):
            if cells[0] == "# version":
                version = cells[1]
            elif cells[0] == "# limit":
                limit = float(cells[1])
            continue
        if not line.strip():
            continue
        if len(cells) < 3 or cells[2] not in ("strict", "soft") or not cells[0]:
            raise ValueError(f"not a vocabulary line: {line!r}")
        term = cells[0].lower()
        if term in strict or term in soft:
            raise ValueError(f"term listed twice: {term!r}")
        if cells[2] == "strict":
            strict[term] = cells[1]
        else:
            soft[term] = cells[1], float(cells[3]) if len(cells) > 3 and cells[3] else 1.0
        if len(strict) + len(soft) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms")
    return Vocabulary(version, strict, soft, limit)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """A vocabulary file in any store that Spark reads (read line by line; more than ``MAX_TERMS`` terms are an error)."""
    return parse_vocabulary(r["value"] for r in spark.read.text(path).toLocalIterator())


def default_vocabulary() -> Vocabulary:
    with open(DEFAULT_TERMS, encoding="utf-8") as f:
        return parse_vocabulary(f)


#: (verdict, host, path); the longest host + path that fits decides
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):   # later, longer rules override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def vocabulary_hits(urls: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``urls`` (url, ...) with n_strict, soft_weight and categories added: distinct strict terms, the summed weights of distinct soft
    terms, and the sorted categories of both.  Columns of these names are replaced."""
    known = vocabulary or default_vocabulary()
    urls = urls.drop("n_strict", "soft_weight", "categories")
    fields = [f"`{n}` {t}" for n, t in urls.dtypes]

    def run(batches):
        import ahocorasick
        cache, mark = process_cache(), ("urlfilter", known.digest)
        if mark not in cache:
            auto = ahocorasick.Automaton()
            for t in (*known.strict, *known.soft):
                auto.add_word(t, (t, len(t)))
            auto.make_automaton()
            cache[mark] = auto
        auto = cache[mark]
        for b in batches:
            n_strict, weight, categories = [], [], []
            for u in b.column(b.schema.get_field_index("url")).to_pylist():
                u, hits = (u or "").lower(), set()
                for end, (t, n) in auto.iter(u) if len(auto) else ():
                    at = end - n + 1
                    if not _word_char(u[at - 1:at] if at else "") and not _word_char(u[end + 1:end + 2]):
                        hits.add(t)
                n_strict.append(sum(t in known.strict for t in hits))
                weight.append(float(sum(known.soft[t][1] for t in sorted(hits) if t in known.soft)))
                categories.append(sorted({known.strict[t] if t in known.strict else known.soft[t][0] for t in hits}))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n_strict, pa.int32()), pa.array(weight, pa.float64()), pa.array(categories, pa.list_(pa.string()))],
                names=[*b.schema.names, "n_strict", "soft_weight", "categories"])

    return urls.mapInArrow(run, ", ".join([*fields, "n_strict int", "soft_weight double", "categories array<string>"]))


def _word_char(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, soft_weight, categories) per row of ``pages``."""
    known = vocabulary or default_vocabulary()
    hits = vocabulary_hits(pages.select("page_id", F.col("url").cast("string").alias("url")), known)
    split = hits.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("n_strict") > 0) | (F.col("soft_weight") >= known.limit)
    return split.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(ruled, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                        "n_strict", "soft_weight", "categories")
