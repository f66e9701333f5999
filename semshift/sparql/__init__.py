"""Ad-hoc SPARQL over triples, compiled to DataFrames."""

from .compiler import query
from .parser import SparqlError, parse

__all__ = ["SparqlError", "parse", "query"]
