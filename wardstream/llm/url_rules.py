"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with a verdict. Each rule is posted under the one of its literal
tokens that the urls at hand hold least often; a url's tokens fetch the rules that could match, and
only those run their expressions. Rules without a literal token are tried on every url.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import A_TO_Z, map_rows

TOKEN = r"[a-z0-9]+"
HOST = re.compile(r"://([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    """pattern runs on `host + path`, host lower-cased; tokens are whole alphanumeric runs that any match implies."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int = 0


def site_rule(verdict: str, rule: str) -> Rule:
    """A rule such as `example.net/en/`: it fits the host and all subdomains, if the url's path starts with its path."""
    host, slash, path = rule.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}" if slash else rf"^(?:[^/]*\.)?{re.escape(host)}(?:/|$)"
    # a path may end inside one of the url's tokens: only tokens followed by a separator are whole
    return Rule(rule, verdict, pattern, tuple(re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?=[^a-z0-9])", path.translate(A_TO_Z))), len(rule))


def word_rule(verdict: str, words: str) -> Rule:
    """A nameless rule that fits any host with these words, hyphenated, as a part of a label."""
    return Rule(None, verdict, rf"^[^/]*(?<![a-z0-9]){re.escape(words)}(?![a-z0-9])[^/]*", tuple(re.findall(TOKEN, words)))


def folder_rule(verdict: str, name: str) -> Rule:
    """A nameless rule that fits any path with this folder or file."""
    return Rule(None, verdict, rf"(?i)/{re.escape(name)}(?:/|\Z)", tuple(re.findall(TOKEN, name)))


def file_rule(verdict: str, kind: str) -> Rule:
    """A nameless rule that fits any path that ends in a file of this kind."""
    return Rule(None, verdict, rf"(?i)/[^/]*\.{re.escape(kind)}\Z", (kind,))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; a null, or a url without ://, has neither."""
    m = HOST.search(url) if url else None
    return (m[1].translate(A_TO_Z), m[2]) if m else ("", "")


def url_tokens(host: str, path: str) -> set[str]:
    return set(re.findall(TOKEN, f"{host}/{path.translate(A_TO_Z)}"))


def token_counts(df: DataFrame, rules: list[Rule], url_col: str) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: a count over all rows, as large as the rules' vocabulary."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(TOKEN), 0))
    kept = F.array_intersect(held, F.array(*map(F.lit, wanted))) if len(wanted) <= 1000 else held
    counts = df.select(F.explode(kept).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.where(F.col("token").isin(wanted)).collect()}


def judge_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    Among the named rules that fit, the longest wins and its name is returned (ties: the first in
    the list). Where none fits, rule is null and the nameless rules decide: block before allow, else
    `default`. A null or empty url, or one without ://, has empty host and path, fits no site rule and
    gets the default. Repeated rows are judged each; other columns are not read. The rules are few
    enough for one Python list, and the index that goes to the tasks is as large as that list.
    """
    counts = Counter(token_counts(df, rules, url_col))
    index: dict[str | None, list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        index[min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else None].append(i)
    index, compiled = dict(index), [re.compile(r.pattern) for r in rules]

    def rows(batch):
        hosts, paths, names, verdicts = [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            found = [
                i
                for t in (*url_tokens(host, path), None)
                for i in index.get(t, ())
                if host and compiled[i].search(host + path)
            ]
            named = [i for i in found if rules[i].name is not None]
            best = rules[min(named, key=lambda i: (-rules[i].weight, i))] if named else None
            said = {rules[i].verdict for i in found}
            hosts.append(host)
            paths.append(path)
            names.append(best.name if best else None)
            verdicts.append(best.verdict if best else "block" if "block" in said else "allow" if "allow" in said else default)
        return {id_col: batch.column(0), "host": hosts, "path": paths, "rule": names, "verdict": verdicts}

    text = StringType()
    schema = StructType([StructField(id_col, df.schema[id_col].dataType or LongType()), *[StructField(n, text) for n in ("host", "path", "rule", "verdict")]])
    return map_rows(df.select(id_col, url_col), rows, schema)
