"""Configuration files: property values by profile, and prefix rules of development proxies."""

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.lexers import Bad, lex, tree

try:
    import yaml
except ImportError:  # then no property file can be read, and every value is a gap
    yaml = None

_REF = re.compile(r"^\$\{([^:{}#]+)(?::([^{}]*))?\}$")
_URL = re.compile(r"^https?://[^\s$]+$")
_APPLICATION = re.compile(r"(?:^|/)application(?:-([^/]+))?\.ya?ml$")
_PROXY = re.compile(r"(?:^|/)(?:vite\.config\.(?:ts|js|mts|cts)|svelte\.config\.js)$")


def value_ref(text: str | None) -> tuple[str, str | None] | None:
    """(key, default) of a `${key:default}` reference and nothing else; expressions give None."""
    m = _REF.match((text or "").strip())
    return (m[1].strip(), m[2]) if m else None


def looked_up(values, key: str):
    """The leaf that a dotted key addresses, level by level or else as one flat key; never a branch."""
    at = values
    for part in key.split("."):
        at = at.get(part) if isinstance(at, Mapping) else None
    if at is None and isinstance(values, Mapping):
        at = values.get(key)
    return None if isinstance(at, (Mapping, list)) else at


def properties(files: DataFrame, keys: DataFrame) -> DataFrame:
    """repo, key, profile, value of the asked keys (repo, key) in `application.yml` and its profiles. files: repo, path, content.

    An unreadable file is an empty one. Only the addressed leaves come out, never their siblings. The keys that a repository asks for are gathered per repository.
    """
    asked = keys.where(F.col("key").isNotNull()).groupBy("repo").agg(F.collect_set("key").alias("keys"))
    f = files.where(F.col("path").rlike(_APPLICATION.pattern)).select("repo", "path", "content").join(asked, "repo")

    def run(batches):
        for b in batches:
            out = []
            for repo, path, content, wanted in zip(b["repo"], b["path"], b["content"], b["keys"]):
                try:
                    parsed = [x for x in yaml.safe_load_all(content or "") if isinstance(x, Mapping)] if yaml else []
                except yaml.YAMLError:
                    parsed = []
                profile = _APPLICATION.search(path)[1]
                out += [(repo, k, profile, v) for x in parsed for k in wanted if isinstance(v := looked_up(x, k), str)]
            yield pd.DataFrame(out, columns=["repo", "key", "profile", "value"])

    return f.mapInPandas(run, "repo string, key string, profile string, value string")


def grounded(refs: DataFrame, values: DataFrame) -> DataFrame:
    """repo, field, host of each reference (repo, field, text): the one address that all profiles agree on, else the default in the reference if it is one, else null.

    An address has a scheme and no placeholder. Profiles that disagree give none, whatever the default.
    """
    r = refs.select("repo", "field", F.trim("text").alias("t"))
    r = r.select("repo", "field", F.nullif(F.trim(F.regexp_extract("t", _REF.pattern, 1)), F.lit("")).alias("key"), F.nullif(F.regexp_extract("t", _REF.pattern, 2), F.lit("")).alias("default"))
    v = values.where(F.col("value").rlike(_URL.pattern)).groupBy("repo", "key").agg(F.count_distinct("value").alias("n"), F.max("value").alias("value"))
    fallback = F.when(F.col("default").rlike(_URL.pattern), F.col("default"))
    host = F.when(F.col("key").isNull(), None).when(F.col("n") == 1, F.col("value")).when(F.col("n").isNull(), fallback)
    return r.join(v, ["repo", "key"], "left").select("repo", "field", host.cast("string").alias("host"))


def _target(items: list[tuple]) -> str | None:
    """A literal, or the first literal among the ways of an `||` chain; None if it can't be read here."""
    ways, way = [], []
    for x in items:
        if x[0] == "o" and x[1] == "||":
            ways.append(way)
            way = []
        else:
            way.append(x)
    for w in [*ways, way]:
        if len(w) == 1 and w[0][0] == "s" and w[0][1] != "``":
            return w[0][1][1:-1]
    return None


def _pairs(items: list[tuple]) -> list[tuple[str, list[tuple]]]:
    """(name, value) of an object's entries."""
    out, part = [], []
    for x in [*items, ("o", ",", False)]:
        if x[0] == "o" and x[1] == ",":
            if len(part) >= 3 and part[1][:2] == ("o", ":"):
                out.append((part[0][1].strip("'\"`"), part[2:]))
            elif len(part) >= 3 and part[0][0] == "w" and part[1][0] == "(":
                out.append((part[0][1], part[1:]))
            part = []
        else:
            part.append(x)
    return out


def _objects(items: list[tuple]):
    for x in items:
        if isinstance(x[1], list):
            if x[0] == "{":
                yield x[1]
            yield from _objects(x[1])


def proxy_rules_of(text: str) -> list[tuple[str, str | None, bool]]:
    """(prefix, target, gap) of every entry under a `proxy` key. A function that rewrites, or a target that only the environment knows, is a gap."""
    try:
        items = tree(lex(text, "typescript"))
    except (Bad, RecursionError):
        return []
    out = []
    for body in _objects(items):
        for name, value in _pairs(body):
            if name == "proxy" and len(value) == 1 and value[0][0] == "{":
                for prefix, rule in _pairs(value[0][1]):
                    if len(rule) == 1 and rule[0][0] == "{":
                        fields = dict(_pairs(rule[0][1]))
                        target = _target(fields.get("target", []))
                        out.append((prefix, target, "rewrite" in fields or target is None))
                    else:
                        target = _target(rule)
                        out.append((prefix, target, target is None))
    return out


def proxy_rules(files: DataFrame) -> DataFrame:
    """repo, prefix, target, gap of the development proxies that a repository's build configuration sets up. files: repo, path, content."""

    def run(batches):
        for b in batches:
            out = [(repo, *rule) for repo, content in zip(b["repo"], b["content"]) for rule in proxy_rules_of(content or "")]
            yield pd.DataFrame(out, columns=["repo", "prefix", "target", "gap"])

    return files.where(F.col("path").rlike(_PROXY.pattern)).select("repo", "content").mapInPandas(run, "repo string, prefix string, target string, gap boolean")
