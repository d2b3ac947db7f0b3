"""Row types of the engine's tables and of its helper functions."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()),
}


def struct(spec: str) -> T.StructType:
    """"a:int b:string" -> StructType, without needing a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in spec.split())])


def versioned(schema: T.StructType) -> T.StructType:
    """The schema of a table's root folder, below which every version has its own."""
    return T.StructType([*schema.fields, T.StructField("version", T.LongType())])


KEYS = T.ArrayType(struct("key:string line:int"))
CHUNK_FIELDS = (
    "start_line:int end_line:int body:string language:string symbol_name:string symbol_kind:string "
    "scope_path:string definition_of:string chunk_mode:string config_file:string config_env:string"
)
CHUNKS = struct(
    "chunk_id:string path:string start_line:int end_line:int header:string body:string vector:vector "
    "definition_of:string dl:bigint path_bucket:int"
)
POSTINGS = struct("term:string chunk_id:string path:string tf:bigint dl:bigint path_bucket:int")
LISTING = struct("path:string size:bigint mtime_ms:double is_dir:boolean error:string")
MANIFEST = struct("path:string sha256:string size:bigint mtime_ms:double path_bucket:int")
META = struct("embedding_model:string embedding_dim:int watch_root:string last_full_scan_at:timestamp")
CHANGES = struct("seq:bigint path:string event:string")
HITS = struct(
    "query_id:bigint ord:int chunk_id:string path:string start_line:int end_line:int text:string score:double "
    "rerank_score:double definition_of:string cross_encoder_logit:double"
)
