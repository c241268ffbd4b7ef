"""Canonical schemas of the code graph."""

from __future__ import annotations



VERSION = 1

SYMBOL_KINDS = ("Function", "AsyncFunction", "Class", "Method", "Interface", "TypeAlias", "Constant", "Export", "Module", "Trait", "Struct", "Enum")
EDGE_KINDS = ("Calls", "Imports", "Inherits", "Implements", "Exports", "ReExports", "TypeReference")
CONFIDENCES = ("Certain", "Inferred", "Unresolved")
VISIBILITIES = ("Export", "Public", "Private", "Default")
KEY = ["file", "name", "kind"]



FILES = "path string, rel_path string, ext string, language string, content string, content_hash string, is_test_path boolean, partial_parse boolean"
SYMBOLS = "file string, name string, kind string, line_start int, line_end int, signature string, params array<string>, return_type string, visibility string, body_hash bigint, is_async boolean, embedding_id bigint"
EDGES = "src_file string, src_name string, src_kind string, dst_file string, dst_name string, dst_kind string, kind string, line int, confidence string, spec string"
LIBRARY_IMPORTS = "library string, symbol string, file string, line int"
EDIT_LOG = "seq bigint, ts timestamp, file string, name string, kind string"
FAILURES = "run_id string, test_name string, file string, line int, message string, stack array<struct<file:string,line:int>>"
HITS = "rank int, file string, line int, signature string, snippet string, context string, is_hint boolean"
WARNINGS = "kind string, file string, name string, symbol_kind string, body string"
