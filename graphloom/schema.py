"""Schemas of the engine's tables. Every table carries ``ord``, since order decides ties."""

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}


def _struct(spec: str) -> T.StructType:
    """From "name kind, ..."; without a session, so that executors can import this module."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in spec.split(", "))])


NODES = _struct("ord long, id string, label string, type string, source_file string, source_location string, description string, community int, centrality double")
EDGES = _struct("ord long, source string, target string, relation string, confidence string, confidence_score double")
FILES = _struct("ord int, path string, ext string, lang string, length long, mtime double, hash string")
CACHE = T.StructType([
    *_struct("file string, hash string"),
    T.StructField("nodes", T.ArrayType(_struct("local_ord int, id string, label string, type string, source_location string, description string"))),
    T.StructField("edges", T.ArrayType(_struct("local_ord int, source string, target string, relation string, confidence string, confidence_score double"))),
])
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
MODES = ("bfs", "dfs")
