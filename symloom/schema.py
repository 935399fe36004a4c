"""Tables and vocabularies of the symbol-graph model."""

from __future__ import annotations




# Store side: one row set a commit.
COMMITS = "commit_id long, commit_sha string, ts long"
FILES = "commit_id long, path string, content_hash string, size_bytes long"
SYMBOLS = (
    "seq long, commit_id long, symbol_id string, lang string, kind string, name string, fqn string, signature string, file_path string, "
    "start_line int, start_col int, end_line int, end_col int, visibility string, doc string, sig_hash string, lang_version string"
)
EDGES = (
    "seq long, commit_id long, edge_type string, src_symbol string, dst_symbol string, file_src string, file_dst string, "
    "resolution string, meta map<string,string>, provenance map<string,string>"
)
OCCURRENCES = (
    "seq long, commit_id long, file_path string, symbol_id string, role string, start_line int, start_col int, end_line int, end_col int, token string"
)

# Query side: the views all lookups, graph operators and rules are defined on.
VIEW_FILES = "id long, path string, hash string, language string"
VIEW_SYMBOLS = "id long, file_id long, fqn string, name string, kind string, line int, `column` int, signature string, docstring string"
VIEW_EDGES = "id long, src string, dst string, edge_type string, resolution string"

# Fixed vocabularies (spelled in lower case).
LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "java", "c", "cpp", "csharp", "unknown")
SYMBOL_KINDS = (
    "function", "method", "class", "interface", "variable", "type", "module", "package", "namespace", "enum", "enum_member", "struct",
    "trait", "constant", "field", "property", "type_alias", "typedef", "union",
)
EDGE_TYPES = ("contains", "declares", "calls", "imports", "extends", "implements", "overrides", "returns", "reads", "writes", "uses", "throws", "inherits")
RESOLUTIONS = ("syntactic", "semantic")
ROLES = ("reference", "read", "write", "call", "extend", "implement", "definition")
SEVERITIES = ("critical", "high", "medium", "low", "info")


def struct(spec: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(spec)
