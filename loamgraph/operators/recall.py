"""Answers about one node: items within some hops, what was said about them, and what the answer leaves open."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.routes import stale
from loamgraph.operators import answers
from loamgraph.schema import ITEM_COLS, RELATION_TYPES, WALKED


@dataclass
class Handle:
    """Where a further hop goes on."""

    frontier: list[str]
    visited: list[str]
    depth: int
    relations: list[str]


@dataclass
class Answer:
    items: list[dict] = field(default_factory=list)
    summaries: list[dict] = field(default_factory=list)
    risks: list[dict] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    gaps: list[str] = field(default_factory=list)
    confidence: float = 0.0
    handle: Handle | None = None


class Graph:
    """The present nodes and edges (`graph.nodes_now`, `graph.edges_now`). Every answer is bounded by its limit, so what comes to the driver is too."""

    def __init__(self, now: DataFrame, edges: DataFrame):
        self.now, self.edges = now, edges

    def _items(self, ids: dict[str, tuple[str | None, int]]) -> list[dict]:
        """Of each id the node of the smallest kind, without its author; in the order given."""
        cols = [c for c in ITEM_COLS if c in self.now.columns]
        rows = self.now.where(F.col("id").isin(list(ids))).select(*cols).collect()
        best: dict[str, dict] = {}
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["kind"]):
            best.setdefault(r["id"], r)
        return [{**best[i], "relation": rel, "depth": d} for i, (rel, d) in ids.items() if i in best]

    def _hop(self, frontier: list[str], visited: list[str], relations: list[str], budget: int) -> tuple[list[tuple[str, str]], bool]:
        """(id, relation) of up to `budget` new neighbours in order of id, and whether there are more. New ones are told from seen ones before the cut."""
        e = self.edges.where(F.col("kind").isin(relations))
        out = e.where(F.col("src").isin(frontier)).select(F.col("dst").alias("id"), "kind")
        new = out.union(e.where(F.col("dst").isin(frontier)).select("src", "kind")).where(~F.col("id").isin(visited))
        new = new.groupBy("id").agg(F.min("kind").alias("relation")).join(self.now.select("id").distinct(), "id", "left_semi")
        rows = [(r["id"], r["relation"]) for r in new.orderBy("id").limit(budget + 1).collect()]
        return rows[:budget], len(rows) > budget

    def _about(self, kinds: list[str], ids: list[str], limit: int) -> list[dict]:
        """Entities that point at the ids, each with all that it points at; the first `limit` (entity, reference) rows count. Staleness is that at the ids asked about."""
        e = self.edges.where(F.col("kind").isin(kinds))
        hit = e.where(F.col("dst").isin(ids))
        at = answers.newest_committed(self.now).select(F.col("id").alias("dst"), F.col("committed_at").alias("node_at"))
        old = hit.join(at, "dst").groupBy("src").agg(F.max(stale(F.col("code_bound_at"), F.col("node_at"))).alias("stale"))
        rows = e.join(old, "src").select("src", "dst", "kind", "stale").distinct().orderBy("src", "dst", "kind").limit(limit).collect()
        out: dict[str, dict] = {}
        for r in rows:
            one = out.setdefault(r["src"], {"id": r["src"], "stale": r["stale"], "refs": []})
            one["refs"].append({"id": r["dst"], "relation": r["kind"]})
        return list(out.values())

    def _said(self, answer: Answer, limit: int) -> Answer:
        ids = [i["id"] for i in answer.items]
        if ids:
            answer.summaries = self._about(["SUMMARIZES"], ids, limit)
            answer.risks = self._about(["RISKS"], ids, limit)
            answer.decisions = self._about(["DECIDES", "SUPERSEDES", "ADDRESSES_RISK"], ids, limit)
            ended = {r["dst"]: r["created_at"] for r in self.edges.where((F.col("kind") == "SUPERSEDES") & F.col("dst").isin([d["id"] for d in answer.decisions])).collect()}
            for d in answer.decisions:
                d["valid_to"], d["live"] = ended.get(d["id"]), d["id"] not in ended
            e = self.edges.where(F.col("kind").isin(RELATION_TYPES) & (F.col("src").isin(ids) | F.col("dst").isin(ids)))
            answer.relations = [r.asDict() for r in e.select("src", "kind", "dst").distinct().orderBy("src", "kind", "dst").limit(limit).collect()]
        # the share of items that are there as nodes with a commit behind them
        answer.confidence = round(sum(i.get("source_commit") is not None for i in answer.items) / len(answer.items), 3) if answer.items else 0.0
        return answer

    def recall(self, query: str, depth: int = 1, limit: int = 25, relations: list[str] | None = None) -> Answer:
        """The neighbourhood of a node, the node itself first and counted; `relations` narrows the walk, never beyond the walked kinds."""
        walked = [r for r in (relations or WALKED) if r in WALKED]
        if not self.now.where(F.col("id") == query).limit(1).count():
            return Answer(gaps=[f"{query!r} is no node of the graph"])
        found: dict[str, tuple[str | None, int]] = {query: (None, 0)}
        return self._walk(found, [query], 0, depth, limit, walked, relations is not None and query)

    def expand(self, handle: Handle, limit: int = 25) -> Answer:
        """One further hop."""
        if not handle.frontier:
            return Answer(gaps=["nothing is left to expand"])
        new, more = self._hop(handle.frontier, handle.visited, handle.relations, limit)
        found = {i: (rel, handle.depth) for i, rel in new}
        visited = [*handle.visited, *found]
        nxt = Handle(handle.frontier if more else list(found), visited, handle.depth + (not more), handle.relations)
        answer = self._said(Answer(self._items(found)), limit)
        answer.handle = nxt if more or (found and self._hop(nxt.frontier, visited, nxt.relations, 1)[0]) else None
        return answer

    def _walk(self, found, frontier, at, depth, limit, walked, explicit) -> Answer:
        more, upto = False, at + depth
        while frontier and at < upto and len(found) < limit and not more:
            new, more = self._hop(frontier, list(found), walked, limit - len(found))
            at += 1
            found.update({i: (rel, at) for i, rel in new})
            frontier = frontier if more else [i for i, _ in new]
        answer = self._said(Answer(self._items(found)), limit)
        if more:
            answer.handle = Handle(frontier, list(found), at, walked)
        elif frontier and self._hop(frontier, list(found), walked, 1)[0]:
            answer.handle = Handle(frontier, list(found), at + 1, walked)
        if explicit:
            e = self.edges.where(F.col("kind").isin(walked) & ((F.col("src") == explicit) | (F.col("dst") == explicit)))
            there = {r["kind"] for r in e.select("kind").distinct().collect()}
            answer.gaps = [f"{explicit!r} has no {r} relation" for r in walked if r not in there]
        return answer

    def _listed(self, rows: DataFrame, what: str, limit: int, channels: bool = False) -> Answer:
        """rows: id, relation."""
        got = rows.join(self.now.select("id").distinct(), "id", "left_semi").distinct().orderBy("id", "relation").limit(limit).collect()
        if not got:
            return Answer(gaps=[f"{what} is not in the graph or has nothing"])
        answer = Answer(self._items({r["id"]: (r["relation"], 1) for r in got}))
        return self._said(answer, limit) if channels else answer

    def community(self, community_id: str, limit: int = 25) -> Answer:
        """All members of a community, with their kind, and what was said about them."""
        m = self.edges.where((F.col("kind") == "MEMBER_OF") & (F.col("dst") == community_id))
        return self._listed(m.select(F.col("src").alias("id"), F.col("kind").alias("relation")), community_id, limit, channels=True)

    def risk(self, risk_id: str, limit: int = 25) -> Answer:
        """Nodes that a risk flags."""
        m = self.edges.where((F.col("kind") == "RISKS") & (F.col("src") == risk_id))
        return self._listed(m.select(F.col("dst").alias("id"), F.col("kind").alias("relation")), risk_id, limit)

    def decision(self, decision_id: str, limit: int = 25) -> Answer:
        """What a decision decides, supersedes and addresses."""
        m = self.edges.where(F.col("kind").isin("DECIDES", "SUPERSEDES", "ADDRESSES_RISK") & (F.col("src") == decision_id))
        rows = m.select(F.col("dst").alias("id"), F.col("kind").alias("relation")).distinct().orderBy("id", "relation").limit(limit).collect()
        if not rows:
            return Answer(gaps=[f"{decision_id} is not in the graph or has nothing"])
        known = {i["id"]: i for i in self._items({r["id"]: (r["relation"], 1) for r in rows})}
        return Answer([{**known.get(r["id"], {"id": r["id"]}), "relation": r["relation"], "depth": 1} for r in rows])

    def peers(self, qualified_name: str, branches: list[str] | None = None, limit: int = 25) -> list[tuple[dict, Answer]]:
        """The node of that name in each plane, newest first, each with what was said about it there."""
        p = answers.peers(self.now.where(F.col("qualified_name") == qualified_name))
        p = p if branches is None else p.where(F.col("branch").isin(*branches))
        ids = {r["branch"]: r["id"] for r in self.now.where(F.col("qualified_name") == qualified_name).select("branch", "id").collect()}
        rows = [r.asDict() for r in p.orderBy("kind", "rank").limit(limit).collect()]
        return [(r, self._said(Answer(self._items({ids[r["branch"]]: (None, 0)})), limit)) for r in rows]


def text_of(answer: Answer) -> str:
    """The answer as sections of lines, facts apart from what was inferred and from what is open."""
    line = lambda i: f"  {i.get('kind', '?')} {i['id']}" + (f"  <- {i['relation']}" if i.get("relation") else "") + (f"  [{i['path']}]" if i.get("path") else "")
    refs = lambda x: f"  {x['id']}{' (stale)' if x['stale'] else ''}: " + ", ".join(r["id"] for r in x["refs"])
    parts = [("items", [line(i) for i in answer.items])]
    parts += [(n, [refs(x) for x in getattr(answer, n)]) for n in ("summaries", "risks", "decisions")]
    parts += [("relations", [f"  {r['src']} {r['kind']} {r['dst']}" for r in answer.relations]), ("gaps", [f"  {g}" for g in answer.gaps])]
    out = [f"{name}\n" + "\n".join(lines) for name, lines in parts if lines]
    return "\n\n".join([*out, *(["more can be expanded"] if answer.handle else [])])
