"""Tables of the graph: columns, kinds, layers."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: Kinds of nodes and of edges, each edge kind with the layer that alone may write it.
NODE_KINDS = ["Repo", "Package", "File", "Class", "Method", "Function", "Variable", "Community", "Route", "Endpoint", "Layout", "Hook", "ApiCall"]
EDGE_LAYERS = {
    "CONTAINS": "deterministic",
    "IMPORTS": "deterministic",
    "CALLS": "deterministic",
    "DEPENDS_ON": "deterministic",
    "MEMBER_OF": "deterministic",
    "REALIZES": "deterministic",
    "HANDLES": "deterministic",
    "LOADS": "deterministic",
    "GUARDS": "deterministic",
    "MODIFIES": "deterministic",
    "SUMMARIZES": "inferred",
    "RISKS": "inferred",
    "DECIDES": "inferred",
    "SUPERSEDES": "inferred",
    "ADDRESSES_RISK": "inferred",
    "CAUSALLY_RELATES": "inferred",
    "RELATES_TO": "inferred",
    "CONFLICTS_WITH": "inferred",
    "CALLS_API": "inferred",
    "COVERS": "runtime",
}
#: Relations that recall walks, and those that a relation payload may have.
WALKED = ["CALLS", "DEPENDS_ON", "CONTAINS", "IMPORTS"]
RELATION_TYPES = ["CAUSALLY_RELATES", "RELATES_TO", "CONFLICTS_WITH"]

NODES_DDL = "kind string, id string, qualified_name string, name string, branch string, path string, start_line int, end_line int, is_test boolean, server_only boolean, dataflow_derived boolean, role string, source_commit string, author string, committed_at string, code_bound_at string, ingested_at timestamp"
EDGES_DDL = "kind string, src string, dst string, edge_kind string, resolution string, source_commit string, author string, committed_at string, code_bound_at string, created_at string, generator string, model string, confidence double, semantic_verdict string, ingested_at timestamp"
#: What an answer may show of a node: never its author.
ITEM_COLS = ["id", "kind", "name", "qualified_name", "path", "start_line", "end_line", "source_commit", "committed_at"]
