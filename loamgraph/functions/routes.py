"""Route paths, match keys, content ids, scores: scalar rules as column expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def endpoint_path(p: Column) -> Column:
    """One leading slash, no empty segments, no trailing slash; parameter names kept."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(p, "/"), lambda s: s != ""), "/"))


def route_host(p: Column) -> Column:
    """Scheme and authority of an absolute URL, else null."""
    return F.nullif(F.regexp_extract(p, r"^(https?://[^/]*)", 1), F.lit(""))


def canonical_path(p: Column) -> Column:
    """Host gone; each segment literal, `{}` for a variable, `{**}` for a rest; applying it twice changes nothing."""
    bare = F.regexp_replace(p, r"^https?://[^/]*", "")

    def segment(s: Column) -> Column:
        rest = s.rlike(r"^\[\[?\.\.\.[^\]]*\]?\]$") | (s == "**") | s.rlike(r"^\{\*[^}]*\}$")
        variable = s.rlike(r"^\[.*\]$") | s.rlike(r"^\{.*\}$") | s.rlike(r"^:.+$") | s.rlike(r"\$\{.*\}")
        return F.when(rest, F.lit("{**}")).when(variable, F.lit("{}")).otherwise(s)

    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(bare, "/"), lambda s: s != ""), segment), "/"))


def match_verb(qn: Column) -> Column:
    return F.element_at(F.split(_unprefixed(qn), " "), 1)


def match_path(qn: Column) -> Column:
    u = _unprefixed(qn)
    return canonical_path(F.substring(u, F.locate(" ", u) + 1, F.length(u)))


def _unprefixed(qn: Column) -> Column:
    """Without a namespace, which ends in a colon before the first blank."""
    colon, blank = F.locate(":", qn), F.locate(" ", qn)
    return F.when((colon > 0) & ((colon < blank) | (blank == 0)), F.substring(qn, colon + 1, F.length(qn))).otherwise(qn)


def api_call_name(verb: Column, literal: Column) -> Column:
    """`apicall:VERB /path` of a quoted literal; null if it isn't quoted or has no fixed segment."""
    quoted = literal.rlike(r"""(?s)^(["'`]).*\1$""") & (F.length(literal) >= 2)
    inner = F.regexp_replace(F.substring(literal, F.lit(2), F.length(literal) - 2), r"\$\{[^}]*\}", "{}")
    path = endpoint_path(inner)
    fixed = F.exists(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: ~s.contains("{}"))
    return F.when(quoted & fixed, F.concat(F.lit("apicall:"), F.upper(verb), F.lit(" "), path))


def hashed_id(prefix: str, parts: Column) -> Column:
    """prefix and the SHA-256 of an array's parts, joined by a null character in the array's order."""
    return F.concat(F.lit(prefix), F.sha2(F.array_join(parts, "\x00"), 256))


def stale(bound: Column, committed: Column) -> Column:
    """Both texts there, and unequal as texts."""
    return bound.isNotNull() & committed.isNotNull() & (bound != committed)


def match_confidence(templated: Column, wildcard: Column, host_grounded: Column, candidates: Column) -> Column:
    """1.0 for one literal match; at most 0.7 for a templated path or several candidates, 0.4 for a wildcard verb; a host-grounded call has 0.7 if unique, else 0.4."""
    one = F.lit(1.0)
    return F.least(
        F.when(templated, 0.7).otherwise(one),
        F.when(wildcard, 0.4).otherwise(one),
        F.when(candidates > 1, 0.7).otherwise(one),
        F.when(host_grounded & (candidates == 1), 0.7).when(host_grounded, 0.4).otherwise(one),
    )


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a length differs or a vector is all zero."""
    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(da, da) * dot(db, db))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(da, db) / n)


def relevance(cos: Column) -> Column:
    """(1 + cos) / 2 with negative cosines as 0."""
    return (1 + F.greatest(cos, F.lit(0.0))) / 2


def check_query_vector(v: Sequence[float], dimension: int) -> list[float]:
    """The vector as floats; ValueError names what is wrong with it."""
    try:
        out = [float(x) for x in v]
    except (TypeError, ValueError) as e:
        raise ValueError("the query vector must be a sequence of numbers") from e
    if len(out) != dimension:
        raise ValueError(f"the query vector has {len(out)} values; {dimension} are needed")
    if any(x != x or x in (float("inf"), float("-inf")) for x in out):
        raise ValueError("the query vector must be finite")
    return out
