"""Identity of nodes across branch planes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a node in a named plane has the id `branch:<branch>` + this + qualified name.
PLANE_SEPARATOR = "\x1f"


def scoped_id(branch: Column, qualified_name: Column) -> Column:
    """Bare name without a plane, else the plane's prefix and the name."""
    return F.when(branch.isNull(), qualified_name).otherwise(
        F.concat(F.lit("branch:"), branch, F.lit(PLANE_SEPARATOR), qualified_name)
    )


def bare_name(node_id: Column) -> Column:
    """The qualified name inside an id of any plane."""
    cut = F.locate(PLANE_SEPARATOR, node_id)
    return F.when(node_id.startswith("branch:") & (cut > 0), F.substring(node_id, cut + 1, F.length(node_id))).otherwise(node_id)


def plane_of(node_id: Column) -> Column:
    """The branch of an id, null for the bare plane."""
    cut = F.locate(PLANE_SEPARATOR, node_id)
    return F.when(node_id.startswith("branch:") & (cut > 0), F.substring(node_id, F.lit(8), cut - 8))


def repository_of(node_id: Column) -> Column:
    """First path segment after the plane's prefix."""
    return F.element_at(F.split(bare_name(node_id), "/"), 1)
