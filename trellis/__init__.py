"""Graph queries over relational tables on Spark."""

from trellis.errors import GraphError
from trellis.functions import filters
from trellis.functions.paths import NodeRef, format_path, node_ref_string
from trellis.session import Session
from trellis.settings import Settings

__all__ = ["GraphError", "NodeRef", "Session", "Settings", "filters", "format_path", "node_ref_string"]
