"""The star-schema test tables read as a symbol graph.

Parts are symbols, brands are files, consecutive lines of an order are edges,
events are occurrences, documents are commit snapshots.  ``ORACLE`` is the same
mapping as common table expressions of DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = (
    "handle_request", "execute_query", "validate_input", "authenticate_user", "login_view", "parse_body", "eval_expr", "system_exec",
    "load_config", "save_order", "send_email", "api_endpoint", "route_handler", "get_user", "post_payment", "delete_record",
    "fetch_data", "hash_password", "encrypt_token", "secret_key", "main_loop", "start_server", "init_app", "test_order",
    "log_event", "render_ui", "controller_base", "service_core", "repository_model", "sanitize_text", "pickle_loads", "yaml_load",
)
LANGS = ("python", "typescript", "go", "rust", "java")
KINDS = ("function", "class", "method", "variable")
SIGNATURES = ("()", "(a: int)", "(a: int, b: str) -> bool", "(self, x, y=1, *args) -> Dict[str, Any]", "(a, b, c, d, e, f, g) -> None", None)


def _pick(items, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (index + 1).cast("int"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    word = _pick(WORDS, F.col("p_size") % 32)
    long = F.when(F.col("p_size") == 49, F.concat(F.lit("_"), F.repeat(F.lit("x"), 50))).otherwise("")
    return p.withColumn("name", F.concat(word, F.lit("_"), F.col("p_partkey").cast("string"), long)).withColumn("file_id", F.substring_index("p_brand", "#", -1).cast("long")).withColumn(
        "fqn", F.concat(F.lit("pkg"), F.col("file_id").cast("string"), F.lit("::"), F.col("name"))
    )


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        "file_id",
        "fqn",
        "name",
        _pick(KINDS, k % 4).alias("kind"),
        F.col("p_size").cast("int").alias("line"),
        (k % 80).cast("int").alias("column"),
        F.concat(F.col("name"), _pick(SIGNATURES, k % 6)).alias("signature"),
        F.concat_ws(" ", F.lower("p_type"), "p_name").alias("docstring"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    b = _parts(spark, sf).select("file_id").distinct()
    path = F.concat(F.lit("src/mod"), F.floor(F.col("file_id") / 5).cast("string"), F.lit("/file"), F.col("file_id").cast("string"), F.lit(".py"))
    return b.select(F.col("file_id").alias("id"), path.alias("path"), F.md5(path).alias("hash"), _pick(LANGS, F.col("file_id") % 5).alias("language"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    a = li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    b = li.select(F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_part"))
    kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "imports").otherwise("uses")).otherwise("calls")
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("from_part"), "to_part", kind.alias("edge_type")).distinct()
    name = _parts(spark, sf).select("p_partkey", "fqn")
    code = F.array_position(F.array(*map(F.lit, ("calls", "imports", "uses"))), F.col("edge_type"))
    return (
        pairs.join(name.select(F.col("p_partkey").alias("from_part"), F.col("fqn").alias("src")), "from_part")
        .join(name.select(F.col("p_partkey").alias("to_part"), F.col("fqn").alias("dst")), "to_part")
        .select(
            ((F.col("from_part") * 10_000_000 + F.col("to_part")) * 4 + code).cast("long").alias("id"),
            "src",
            "dst",
            "edge_type",
            F.when((F.col("from_part") + F.col("to_part")) % 3 == 0, "semantic").otherwise("syntactic").alias("resolution"),
        )
    )


def file_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between files, by the symbols' files."""
    s = symbols(spark, sf).join(files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id").select("fqn", "path")
    e = edges(spark, sf)
    return (
        e.join(s.select(F.col("fqn").alias("src"), F.col("path").alias("file_src")), "src")
        .join(s.select(F.col("fqn").alias("dst"), F.col("path").alias("file_dst")), "dst")
        .select("edge_type", "file_src", "file_dst")
    )


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("symbol_id"), F.col("event_type").alias("role"), F.unix_timestamp("ts").alias("ts"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """File versions: a document's language is its commit (1 to 4)."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    commit = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang"))
    return d.select(
        commit.cast("long").alias("commit_id"),
        F.concat(F.lit("src/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".py")).alias("path"),
        F.md5("text").alias("content_hash"),
        F.col("doc_id").alias("seq"),
        F.col("n_chars").alias("size_bytes"),
    )


_words = ", ".join(f"'{w}'" for w in WORDS)
_sigs = ", ".join("NULL" if s is None else f"'{s}'" for s in SIGNATURES)

#: Common table expressions; a query follows directly.
ORACLE = f"""WITH RECURSIVE parts AS MATERIALIZED (
  SELECT p_partkey, p_size, p_type, p_name, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS file_id,
    [{_words}][1 + p_size % 32] || '_' || p_partkey || CASE WHEN p_size = 49 THEN '_' || repeat('x', 50) ELSE '' END AS name
  FROM part),
symbols AS MATERIALIZED (
  SELECT p_partkey AS id, file_id, 'pkg' || file_id || '::' || name AS fqn, name, ['function', 'class', 'method', 'variable'][1 + p_partkey % 4] AS kind,
    CAST(p_size AS INTEGER) AS line, CAST(p_partkey % 80 AS INTEGER) AS "column", name || [{_sigs}][1 + p_partkey % 6] AS signature, lower(p_type) || ' ' || p_name AS docstring
  FROM parts),
files AS MATERIALIZED (
  SELECT id, path, md5(path) AS hash, ['python', 'typescript', 'go', 'rust', 'java'][1 + id % 5] AS language
  FROM (SELECT DISTINCT file_id AS id, 'src/mod' || (file_id // 5) || '/file' || file_id || '.py' AS path FROM parts)),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.l_partkey AS f, b.l_partkey AS t,
    CASE WHEN a.l_returnflag = 'R' THEN CASE WHEN a.l_linestatus = 'F' THEN 'imports' ELSE 'uses' END ELSE 'calls' END AS edge_type
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1),
edges AS MATERIALIZED (
  SELECT CAST((f * 10000000 + t) * 4 + CASE edge_type WHEN 'calls' THEN 1 WHEN 'imports' THEN 2 ELSE 3 END AS BIGINT) AS id, x.fqn AS src, y.fqn AS dst, edge_type,
    CASE WHEN (f + t) % 3 = 0 THEN 'semantic' ELSE 'syntactic' END AS resolution
  FROM pairs JOIN symbols x ON x.id = f JOIN symbols y ON y.id = t),
file_edges AS MATERIALIZED (
  SELECT edge_type, p.path AS file_src, q.path AS file_dst FROM edges e JOIN symbols a ON a.fqn = e.src JOIN symbols b ON b.fqn = e.dst
    JOIN files p ON p.id = a.file_id JOIN files q ON q.id = b.file_id),
snapshots AS MATERIALIZED (
  SELECT CAST(list_position(['de', 'en', 'es', 'fr'], lang) AS BIGINT) AS commit_id, 'src/' || source || '/' || (doc_id % 50) || '.py' AS path, md5(text) AS content_hash, doc_id AS seq, n_chars AS size_bytes
  FROM documents),
calls AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'calls'),
seed AS MATERIALIZED (SELECT dst AS node FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)
"""
