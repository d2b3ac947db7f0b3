"""The catalog's queries again in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from seekspark.functions.confidence import HINTS
from seekspark.sources.corpus import FILE_PATHS, SOURCES, VARIED_PATHS

ORACLE: dict[str, str] = {}


def _literal(template: str) -> str:
    return ("'" + template.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'") + "'")


def _case(key: str, choices: list[str]) -> str:
    arms = " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(choices))
    return f"CASE {key} % {len(choices)} {arms} END"


def _path(templates) -> str:
    return _case("doc_id", [_literal(t).replace("{d}", "'||doc_id||'").replace("{s}", "'||source||'") for t in templates])


SPACES = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINES = r"string_split_regex(text, '\r?\n')"
FILES = f"""files AS (SELECT doc_id, {_path(FILE_PATHS)} AS path, text, length(text)::BIGINT AS size,
  1700000000000 + doc_id AS mtime_ms FROM documents)"""
PATHS = f"""{FILES}, paths AS (SELECT doc_id, path FROM files UNION ALL
  SELECT doc_id, {_path(VARIED_PATHS)} FROM documents)"""
BASE = "string_split(path, '/')[-1]"
PATHS_EXT = PATHS + f""", named AS (SELECT doc_id, path, lower({BASE}) AS base,
  lower(regexp_extract({BASE}, '^.+\\.([^.]*)$', 1)) AS ext FROM paths)"""
CORPUS = f"""{FILES}, corpus AS (SELECT path, text FROM files
  UNION ALL SELECT 'web/p' || page_id || '.html', html FROM pages)"""


def _source_text(first: str, template: str, last: str | None) -> str:
    fill = lambda t: _literal(t).replace("{d}", "'||doc_id||'").replace("{w}", "'||w||'").replace("{l}", "'||l||'")
    each = fill(template).replace("'||w||'", "'||lower(regexp_extract(x,'([A-Za-z]+)',1))||'_'||(i-1)||'").replace(
        "'||l||'", "'||regexp_replace(x,'[^A-Za-z0-9 ]',' ','g')||'"
    )
    tail = f" || [{_literal(last)}]" if last else ""
    return f"array_to_string([{fill(first)}] || list_transform(ls, lambda x, i: {each}){tail}, chr(10))"


SOURCE_FILES = f"""src AS (SELECT doc_id, {_case('doc_id', [_literal(p).replace('{d}', "'||doc_id||'") for p, *_ in SOURCES])} AS path,
  {_case('doc_id', [_source_text(*rest) for _, *rest in SOURCES])} AS text, len(ls) AS n_src
  FROM (SELECT doc_id, {LINES} AS ls FROM documents))"""


def config_form(number: int) -> str:
    """CTE src with every document in one form."""
    path, *rest = SOURCES[number]
    where = _literal(path).replace("{d}", "'||doc_id||'")
    return f"src AS (SELECT doc_id, {where} AS path, {_source_text(*rest)} AS text, len(ls) AS n_src FROM (SELECT doc_id, {LINES} AS ls FROM documents))"


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql


add("scan_stats", f"""WITH {FILES} SELECT count(*) AS n_files,
  sum(1 + greatest(0, ceil((len({LINES}) - 60) / 48.0)))::BIGINT AS n_chunks, sum(length(text))::BIGINT AS total_chars FROM files""")
add("ext_filter", f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE lower(path) LIKE '%.rb' OR lower(path) LIKE '%.tsx' OR lower(path) LIKE '%.d.ts'")
add("lang_filter", f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE regexp_matches(lower(path), '\\.(json|yaml|yml)$')")
add("prefix_filter", f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE path = 'lib' OR path LIKE 'lib/%'")
add("glob_filter", f"""WITH {PATHS} SELECT doc_id, path, {BASE} LIKE '%.rb' AS g_name,
  regexp_matches(path, '^src/(.*/)?[^/]*\\.ts$') AS g_deep,
  regexp_matches({BASE}, '^d.*[0-4]\\.(md|json)$') AS g_braces, path LIKE '.claude/%' AS g_dot FROM paths""")
add("combined_filter", f"""WITH {PATHS} SELECT doc_id, path FROM paths
  WHERE regexp_matches(lower(path), '\\.(rb|ts|mts|cts|tsx|vue)$') AND regexp_matches({BASE}, '^d.*[02468]\\..*$')""")
# Fixed values.
TEXT_EXT = """'adoc','bash','c','cc','cfg','cjs','conf','cpp','css','csv','cxx','dockerfile','feature','go','graphql','gql','h','hpp',
 'htm','html','ini','java','js','jsx','json','kt','md','mdx','mjs','plist','prisma','proto','py','rb','rake','gemspec','rs','rst',
 'scss','sh','sql','svelte','swift','toml','ts','tsx','tsv','txt','vue','xml','yaml','yml','zsh'"""
add("safety_filter", f"""WITH {PATHS_EXT} SELECT doc_id, path,
  base IN ('dockerfile','makefile','rakefile','gemfile') OR ext IN ({TEXT_EXT})
   OR (ext = '' AND base IN ('license','notice','contributors','codeowners')) AS indexable,
  list_contains(string_split(path,'/'),'.git') OR list_contains(string_split(path,'/'),'node_modules')
   OR regexp_matches(lower(path), '\\.(pem|key|p12|pfx|env|env\\.local|env\\.production)$') AS unsafe FROM named""")
add("ignore_filter", f"""WITH {PATHS} SELECT doc_id, path,
  path LIKE 'node_modules/%' OR path LIKE '%.pem' OR {BASE} = '.env' OR starts_with({BASE}, '.env.') OR path LIKE 'build/%'
  OR (path LIKE '%.lock' AND NOT starts_with({BASE}, 'd1')) OR path LIKE 'vendor/%'
  OR (starts_with(path, 'docs/') AND {BASE} = 'README.txt')
  OR (starts_with(path, 'img/') AND path LIKE '%.PNG' AND NOT starts_with(path, 'img/d1')) AS ignored FROM paths""")
add("watch_filter", f"""WITH {PATHS} SELECT doc_id, path, regexp_matches(path, '(^|/)(node_modules|build|vendor)(/|$)')
  AND NOT starts_with(path, '.claude/docs/') AS skipped FROM paths""")
add("workdocs_omit", f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE NOT starts_with(path, '.claude/docs/')")
BUCKET = """CASE WHEN starts_with(path, '.claude/docs/') THEN 'docs'
  WHEN ext IN ('json','jsonc','yaml','yml','toml','tf','tfvars','hcl','properties','ini','cfg','conf') THEN 'config'
  WHEN starts_with(base, '.env') OR stem = 'env' OR stem LIKE '%.env' THEN 'config'
  WHEN ext IN ('md','mdx','markdown','rst','adoc') THEN 'docs'
  WHEN ext = 'txt' AND stem IN ('readme','changelog','contributing') THEN 'docs' ELSE 'code' END"""
STEMMED = PATHS_EXT + ", stemmed AS (SELECT *, CASE WHEN ext = '' THEN base ELSE left(base, length(base) - length(ext) - 1) END AS stem FROM named)"
add("content_bucket", f"WITH {STEMMED} SELECT doc_id, path, {BUCKET} AS bucket FROM stemmed")
add("language_detect", f"""WITH {PATHS_EXT} SELECT doc_id, path, CASE WHEN ext = '' AND base IN ('rakefile','gemfile') THEN 'ruby'
   WHEN ext = '' THEN 'text' WHEN ext IN ('ts','tsx','js','jsx','mjs','cjs') THEN 'javascript' WHEN ext = 'py' THEN 'python'
   WHEN ext = 'rs' THEN 'rust' WHEN ext IN ('rb','rake','rbi','gemspec') THEN 'ruby' WHEN ext = 'yml' THEN 'yaml' ELSE ext END AS language,
  CASE WHEN g IN ('ts','tsx','py','go','java','rs') THEN g WHEN g IN ('js','jsx','mjs','cjs') THEN 'js' WHEN g IN ('rb','rake','rbi') THEN 'rb' END AS grammar
  FROM (SELECT *, CASE WHEN contains(path,'.') THEN lower(string_split(path,'.')[-1]) ELSE '' END AS g FROM named)""")
add("path_family", f"""WITH {PATHS} SELECT doc_id, path, CASE WHEN g IN ('rb','rake','rbi') THEN 'ruby'
  WHEN g IN ('ts','tsx','js','jsx','mjs','cjs','vue','svelte') THEN 'tsish' WHEN g IN ('css','scss','less','sass') THEN 'webstyle' ELSE 'other' END AS family
  FROM (SELECT *, CASE WHEN contains(path,'.') THEN lower(string_split(path,'.')[-1]) ELSE '' END AS g FROM paths)""")


def windows(source: str, size: int, overlap: int, extra: str = "") -> str:
    """path, ordinal, start_line, end_line, body of every window of source(path, text)."""
    step = max(1, size - overlap)
    return f"""(SELECT path, k::INT AS ordinal, (k*{step}+1)::INT AS start_line, least(k*{step}+{size}, n)::INT AS end_line,
      array_to_string(ls[k*{step}+1 : least(k*{step}+{size}, n)], chr(10)) AS body FROM (
      SELECT path, ls, len(ls) AS n, unnest(generate_series(0, greatest(0, ceil((len(ls)-{size})/{step}.0))::BIGINT)) AS k
      FROM (SELECT path, {LINES} AS ls FROM {source} {extra})))"""


for size, overlap in ((60, 12), (36, 9), (10, 3)):
    add(f"line_chunks_{size}_{overlap}", f"WITH {CORPUS} SELECT * FROM {windows('corpus', size, overlap)}")
add("storage_texts", f"""WITH {CORPUS} SELECT path, ordinal, path||' '||{BASE}||' '||replace({BASE},'-',' ')||' '||replace(path,'/',' ')
  ||chr(10)||chr(9246)||chr(10)||body AS stored FROM {windows('corpus', 36, 9)}""")
YAML = f"""{config_form(6)}, ylines AS (SELECT path, ls, i, regexp_extract(ls[i], '^["'']?([A-Za-z0-9_.-]+)["'']?\\s*:', 1) AS k FROM
   (SELECT path, {LINES} AS ls, unnest(generate_series(1, len({LINES}))) AS i FROM src)),
  ysec AS (SELECT path, ls, k, i AS s, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, len(ls)) AS e FROM ylines WHERE k <> '')"""
add("yaml_sections", f"""WITH {YAML} SELECT path, s::INT AS start_line, e::INT AS end_line, k AS symbol_name, k AS definition_of,
  regexp_extract(path, '([^/]+)\\.yml$', 1) AS config_file, array_to_string(ls[s:e], chr(10)) AS body FROM ysec""")
add("embed_texts", f"""WITH {YAML} SELECT path, s::INT AS start_line, '[path='||path||'][lang=yaml][symbol='||k||'][kind=config_key][file_kind=config][config_file='
  ||regexp_extract(path, '([^/]+)\\.yml$', 1)||'][config_key='||k||'][def='||k||']'||chr(10)||array_to_string(ls[s:e], chr(10)) AS embedded FROM ysec""")
add("json_sections", f"""WITH {config_form(7)}, j AS (SELECT path, {LINES} AS ls, n_src FROM src),
  x AS (SELECT path, ls, n_src, unnest(generate_series(1, n_src)) AS i FROM j)
  SELECT path, (i+1)::INT AS start_line, CASE WHEN i = n_src THEN i+2 ELSE i+1 END::INT AS end_line,
   string_split(ls[i+1], '"')[2] AS symbol_name, string_split(ls[i+1], '"')[2] AS definition_of, regexp_extract(path, '([^/]+)\\.json$', 1) AS config_file,
   array_to_string(ls[i+1 : CASE WHEN i = n_src THEN i+2 ELSE i+1 END], chr(10)) AS body FROM x""")
ID = "([A-Za-z_][A-Za-z0-9_]*)"
JS = "([A-Za-z_$][A-Za-z0-9_$]*)"
# Fixed values.
PATTERNS = [
    ("javascript", "function", rf"^(?:export\s+)?(?:async\s+)?function\s+{JS}\s*\("),
    ("javascript", "class", rf"^(?:export\s+)?class\s+{JS}\b"), ("javascript", "interface", rf"^(?:export\s+)?interface\s+{JS}\b"),
    ("javascript", "type", rf"^(?:export\s+)?type\s+{JS}(?:<[^>]+>)?(?:\s*=\s*|\s+extends\b)"), ("javascript", "type", rf"^(?:export\s+)?enum\s+{JS}\b"),
    ("javascript", "function", rf"^(?:export\s+)?(?:const|let|var)\s+{JS}\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    ("javascript", "function", rf"^(?:export\s+)?(?:const|let|var)\s+{JS}\s*=\s*(?:async\s*)?function\b"),
    ("python", "function", rf"^def\s+{ID}\s*\("), ("python", "class", rf"^class\s+{ID}\b"),
    ("ruby", "function", rf"^def\s+self\.{ID}"), ("ruby", "function", r"^def\s+([A-Za-z_][A-Za-z0-9_]*[!?]?)(?:[\s(#&;!]|$)"),
    ("ruby", "class", r"^([A-Z][A-Za-z0-9_]*)\s*=\s*(?:::)?(?:Struct\.new|Data\.define|Class\.new|Module\.new)"),
    ("ruby", "type", rf"^enum\s+:{ID}\b"), ("ruby", "type", rf"^enum\s+{ID}\s*:"),
    ("ruby", "class", r"^class\s+([A-Z][A-Za-z0-9_:]*)\b"), ("ruby", "class", r"^module\s+([A-Z][A-Za-z0-9_:]*)\b"),
    ("*", "function", rf"^(?:export\s+)?(?:func|fn)\s+{ID}\s*\("), ("*", "type", rf"^(?:export\s+)?(?:class|struct|interface|trait|type)\s+{ID}\b"),
]


def _pattern_case(kind: bool) -> str:
    arms = []
    for language, label, pattern in PATTERNS:
        applies = "language NOT IN ('javascript','python')" if language == "*" else f"language = '{language}'"
        value = f"'{label}'" if kind else f"regexp_extract(t, '{pattern}', 1)"
        arms.append(f"WHEN {applies} AND regexp_matches(t, '{pattern}') THEN {value}")
    return f"CASE WHEN t = '' OR starts_with(t, '//') OR starts_with(t, '#') THEN NULL {' '.join(arms)} END"


LANGUAGE = """CASE WHEN regexp_matches(path,'\\.(ts|tsx)$') THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rb' THEN 'ruby' ELSE 'x' END"""
SYMBOLS = f"""syms AS (SELECT path, i, n, {_pattern_case(False)} AS name, {_pattern_case(True)} AS kind FROM (
   SELECT path, i, n, {LANGUAGE} AS language, regexp_replace(ls[i], '^{SPACES}+|{SPACES}+$', '', 'g') AS t FROM (
   SELECT path, ls, len(ls) AS n, unnest(generate_series(1, len(ls))) AS i FROM (SELECT path, {LINES} AS ls FROM code))))"""
add("regex_symbols", f"""WITH {FILES}, {SOURCE_FILES}, code AS (SELECT path, text FROM files UNION ALL SELECT path, text FROM src), {SYMBOLS}
  SELECT path, i::INT AS start_line, name, kind FROM syms WHERE kind IS NOT NULL""")
WORDS = f"""(SELECT doc_id, i, unnest(regexp_extract_all(x, '[A-Za-z]+')) AS name FROM
  (SELECT doc_id, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i FROM documents))"""
add("one_symbol_per_line", f"""SELECT doc_id, i::INT AS start_line, name, CASE WHEN length(name) % 2 = 0 THEN 'class' ELSE 'function' END AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY lower(name) DESC,
    translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') DESC) AS rn
  FROM {WORDS}) WHERE rn = 1""")
add("ast_regex_merge", f"""SELECT doc_id, i::INT AS start_line, regexp_extract(x, '([A-Za-z]+)', 1) AS name, CASE WHEN i % 2 = 1 THEN 'class' ELSE 'function' END AS kind
  FROM (SELECT doc_id, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i FROM documents) WHERE regexp_matches(x, '[A-Za-z]')""")
# Sections from each symbol to the next, cut into pieces of 60; preamble before; windows without symbols.
SYMBOL_PARTS = f"""{SOURCE_FILES}, code AS (SELECT path, text FROM src), {SYMBOLS},
  lined AS (SELECT path, text, {LINES} AS ls, len({LINES}) AS n FROM src),
  sec AS (SELECT path, i AS s, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n) AS e, name, kind FROM syms WHERE kind IS NOT NULL),
  first_of AS (SELECT path, min(s) AS f FROM sec GROUP BY path),
  pieces AS (SELECT path, s + k*60 AS a, least(s + k*60 + 59, e) AS b, name, kind, k, e - s + 1 > 60 AS split FROM
     (SELECT *, unnest(generate_series(0, (e - s) // 60)) AS k FROM sec)),
  parts AS (SELECT path, a, b, name, kind, CASE WHEN k = 0 THEN name END AS def, CASE WHEN split THEN 'symbol_split' ELSE 'symbol' END AS mode FROM pieces
    UNION ALL SELECT path, 1, f - 1, NULL, NULL, NULL, 'preamble' FROM first_of WHERE f > 1
    UNION ALL SELECT path, start_line, end_line, NULL, NULL, NULL, 'fallback_lexical' FROM {windows('src', 36, 9, 'WHERE path NOT IN (SELECT path FROM first_of)')})"""
add("symbol_chunks", f"""WITH {SYMBOL_PARTS}
  SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a) - 1)::INT AS ordinal, a::INT AS start_line, b::INT AS end_line, name AS symbol_name, kind AS symbol_kind,
   NULL::VARCHAR AS scope_path, def AS definition_of, mode AS chunk_mode, array_to_string(ls[a:b], chr(10)) AS body FROM parts JOIN lined USING (path)""")
KNOWN = f"""{FILES}, known AS (SELECT CASE WHEN doc_id % 7 = 6 THEN path||'.old' ELSE path END AS path,
  CASE WHEN doc_id % 5 = 2 THEN sha256(text||'!') ELSE sha256(text) END AS sha, CASE WHEN doc_id % 5 = 2 THEN size + 1 ELSE size END AS ksize,
  CASE WHEN doc_id % 5 = 1 THEN mtime_ms - 5 ELSE mtime_ms END AS kmtime FROM files WHERE doc_id % 5 <> 3),
  beside AS (SELECT f.path, text, sha256(text) AS now, sha, coalesce(size = ksize AND mtime_ms = kmtime, false) AS same FROM files f LEFT JOIN known USING (path))"""
add("content_sha", f"WITH {FILES} SELECT path, sha256(text) AS sha256 FROM files")
add("stat_skip", f"WITH {KNOWN} SELECT path, same AS skipped FROM beside")
add("hash_skip", f"WITH {KNOWN} SELECT path, coalesce(now = sha, false) AS unchanged FROM beside WHERE NOT same")
add("reconcile_removed", f"WITH {KNOWN} SELECT path FROM known WHERE path NOT IN (SELECT path FROM files)")
add("upsert_result", f"""WITH {KNOWN}, result AS (SELECT path, CASE WHEN same OR coalesce(now = sha, false) THEN text ELSE 'new'||chr(10)||text END AS text FROM beside)
  SELECT * FROM {windows('result', 10, 3)}""")
EVENTS = """ev AS (SELECT event_id AS seq, 'u/'||user_id AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event, value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)"""
add("events_last_state", f"WITH {EVENTS} SELECT path, event, seq FROM ev WHERE rn = 1")
add("events_replay_upsert", f"WITH {EVENTS} SELECT path, round(value, 6) AS value FROM ev WHERE rn = 1 AND event <> 'unlink'")

add("events_settled", """WITH e AS (SELECT event_id AS seq, 'u/'||user_id AS path, ts, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event FROM events),
  m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) >= INTERVAL 6 HOURS, true)::INT AS fresh FROM e),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, seq) AS run FROM m)
  SELECT path, arg_max(event, seq) AS event, max(seq) AS seq, count(*) AS n_events FROM r GROUP BY path, run
   HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM e)""")
add("stream_replay", f"WITH {EVENTS} SELECT path||'.txt' AS path, event||' '||floor(value * 1000)::BIGINT AS body, 3 AS version FROM ev WHERE rn = 1 AND event <> 'unlink'")

DISTANCE = "list_sum(list_transform(list_zip(v, q), lambda p: (p[1]-p[2])*(p[1]-p[2])))"


def knn(queries: str, k: int) -> str:
    """queries: CTE q(query_id, q DOUBLE[])."""
    return f"""WITH {queries}, vec AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
     d AS (SELECT query_id, chunk_id, {DISTANCE} AS distance FROM q, vec), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS ord FROM d)
     SELECT query_id, ord::INT AS ord, chunk_id, round(distance, 6) AS distance, round(1/(1+distance), 6) AS score FROM r WHERE ord <= {k}"""


def center(key: str) -> str:
    return f"""q AS (SELECT query_id, list(m ORDER BY i) AS q FROM (SELECT query_id, i, avg(x) AS m FROM
      (SELECT {key}::BIGINT AS query_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY query_id)"""


ASKED_VECTORS = "q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"
add("knn_topk", knn(center("0"), 10))
add("label_centroid_topk", knn(center("label"), 5))
add("knn_batch", knn(ASKED_VECTORS, 10))


def _far(column: str) -> str:
    return f"list_transform({column}::DOUBLE[], lambda x: x * 0.5::DOUBLE + 100000)"


add("knn_large_norms", f"""WITH q AS (SELECT item_id AS query_id, {_far('embedding')} AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
   vec AS (SELECT vec_id AS chunk_id, {_far('embedding')} AS v FROM embeddings), d AS (SELECT query_id, chunk_id, {DISTANCE} AS distance FROM q, vec),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS ord FROM d)
   SELECT query_id, ord::INT AS ord, chunk_id, round(distance, 6) AS distance, round(1/(1+distance), 6) AS score FROM r WHERE ord <= 10""")
add("knn_prefix_overfetch", f"""WITH {FILES}, {ASKED_VECTORS}, vec AS (SELECT path||'#0' AS chunk_id, path, embedding::DOUBLE[] AS v FROM files JOIN embeddings ON vec_id = doc_id),
   d AS (SELECT query_id, chunk_id, path, {DISTANCE} AS distance FROM q, vec), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rn FROM d),
   f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS ord FROM r WHERE rn <= 80 AND path LIKE 'lib/%')
   SELECT query_id, ord::INT AS ord, chunk_id, round(1/(1+distance), 6) AS score FROM f WHERE ord <= 10""")
TERMS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
ASKED = "asked AS (SELECT item_id AS query_id, {query} AS query, {focus} AS focus FROM benchmark)"


def bm25(query: str = "text", focus: str = "'auto'") -> str:
    return f"""{FILES}, {ASKED.format(query=query, focus=focus)}, {ASKED_VECTORS},
     dl AS (SELECT path||'#0' AS chunk_id, path, doc_id, text, len({TERMS.format('text')}) AS dl FROM files), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
     post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT path||'#0' AS chunk_id, unnest({TERMS.format('text')}) AS term FROM files) GROUP BY ALL),
     dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
     qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM asked) GROUP BY ALL),
     bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS bm25
       FROM qt JOIN dfs USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL)"""


def ranked(source: str, order: str, k: int, name: str = "ord") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS {name} FROM {source}) WHERE {name} <= {k})"


add("postings_stats", f"WITH t AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
add("bm25_topk", f"WITH {bm25()} SELECT query_id, ord::INT AS ord, chunk_id, round(bm25, 6) AS score FROM {ranked('bm', 'bm25 DESC, chunk_id', 10)}")
add("retrieval_quality", f"""WITH {bm25()} SELECT query_id, count(*) AS judged, round(avg(quality::DOUBLE), 6) AS precision
  FROM {ranked('bm', 'bm25 DESC, chunk_id', 10)} JOIN dl USING (chunk_id) JOIN labels USING (doc_id) GROUP BY query_id""")


def hybrid(query: str = "text", focus: str = "'auto'", depth: int | str = 100, limit: int = 100, where: str = "true") -> str:
    """CTE fused(query_id, chunk_id, score, ord). depth and where may depend on query_id."""
    return f"""{bm25(query, focus)}, vec AS (SELECT path||'#0' AS chunk_id, path, embedding::DOUBLE[] AS v FROM files JOIN embeddings ON vec_id = doc_id),
     d AS (SELECT query_id, chunk_id, {DISTANCE} AS distance FROM q, vec WHERE {where}), vleg AS {ranked('d', 'distance, chunk_id', depth)},
     tleg AS {ranked(f'(SELECT bm.* FROM bm JOIN dl USING (chunk_id) WHERE {where})', 'bm25 DESC, chunk_id', depth)},
     both_legs AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE/(60+v.ord), 0) + coalesce(1.0::DOUBLE/(60+t.ord), 0) AS score FROM vleg v FULL JOIN tleg t USING (query_id, chunk_id)),
     fused AS {ranked('both_legs', 'score DESC, chunk_id', limit)}"""


LISTED = "query_id, ord::INT AS ord, chunk_id"
add("rrf_fusion", f"WITH {hybrid()} SELECT {LISTED}, round(score, 6) AS score FROM fused")
RUBY = "regexp_matches(path, '\\.(rb|rake|gemspec)$') AND regexp_matches(path, '/?d[^/]*[02468][^/]*\\.rb$') AND NOT starts_with(path, '.claude/docs/')"
add("hybrid_filtered", f"WITH {hybrid(depth=400, limit=10, where=RUBY)} SELECT {LISTED}, round(score, 6) AS score FROM fused")
add("hashing_vectors", f"""WITH t AS (SELECT doc_id, term, (('0x'||substr(md5(term),1,8))::BIGINT) AS h FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents)),
  s AS (SELECT doc_id, (h % 64)::INT AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM t GROUP BY ALL),
  n AS (SELECT doc_id, sqrt(sum(x*x)) AS norm FROM s GROUP BY doc_id)
  SELECT doc_id, slot, round((x/norm)::FLOAT::DOUBLE, 5) AS x FROM s JOIN n USING (doc_id) WHERE x <> 0""")

ALL_ASKED = "a AS (SELECT 'b' AS source, item_id AS id, text AS query FROM benchmark UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations)"
TOKENS = "list_filter(list_transform(regexp_extract_all({q}, '[A-Za-z0-9_.$/-]+'), lambda t: lower(t)), lambda t: length(t) >= 2)"
CAMEL = r"\b[A-Za-z]+[A-Z][A-Za-z0-9]*\b"
SYMBOL_LIST = "list_distinct({tokens})"
add("query_tokens", f"WITH {ALL_ASKED} SELECT source, id, array_to_string({TOKENS.format(q='query')}, ' ') AS tokens, len({TOKENS.format(q='query')})::INT AS n_tokens FROM a")
add("symbol_tokens", f"""WITH {ALL_ASKED}, m AS (SELECT source, id, query||' '||regexp_replace(query, '[ \n]+([a-z])', '_\\1X', 'g') AS query FROM a),
  t AS (SELECT source, id, query, list_concat(list_filter({TOKENS.format(q='query')}, lambda t: regexp_matches(t, '[_./$-]')),
     list_transform(regexp_extract_all(query, '{CAMEL}'), lambda t: lower(t))) AS s FROM m)
  SELECT source, id, coalesce(array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' '), '') AS symbols,
   len(list_filter({TOKENS.format(q='query')}, lambda t: contains(t,'_') OR contains(t,'/'))) > 0 OR regexp_matches(query, '{CAMEL}') AS symbol_query FROM t""")


def questions() -> str:
    from seekspark.plans.catalog import QUESTIONS

    cap = "upper(word[1])||lower(word[2:])"
    filled = _case("(length(word)*7+ascii(word))", [_literal(t).replace("{W}", f"'||{cap}||'").replace("{w}", "'||word||'") for t in QUESTIONS])
    return f"""w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), questions AS (SELECT word, {filled} AS query FROM w)"""


# Fixed values.
TESTS = r"(?i)\b(test|spec|rspec|minitest|pytest|jest|vitest|examples?|shoulda|factory_bot|capybara|vcr)\b"
FRONTEND = (
    r"(?i)\b(react|usestate|useeffect|usecallback|usememo|redux|zustand|next\.js|nextjs|jsbundle|components?|userouter|stimulus|webpack|vite|hotwire|turbo|"
    r"tailwind|styled-?components?|framer|storybook|portal|navbar|dropdown|viewcomponent|shadcn|mui|chakra|jsx?|client[- ]?side|frontend|browser|typescript)\b"
)
add("query_context", f"""WITH {questions()}, c AS (SELECT word, ['rspec for ','React components of ','next.js and ','client side ','latest '][length(word) % 5 + 1]||query AS q FROM questions)
  SELECT word, regexp_matches(q, '{TESTS}') AS tests, regexp_matches(q, '{FRONTEND}') AS frontend FROM c""")
NAME = r"`?([A-Za-z_][A-Za-z0-9_$]*)`?"
# Fixed values.
INTENTS = [
    rf"where\s+(?:is|are)\s+(?:the\s+)?{NAME}\s+(?:class|interface|type|enum|struct|trait|record|method|module)\s+defined\b",
    rf"\bdefinitions?\s+of\s+(?:the\s+)?{NAME}\s+(?:class|interface|type|enum|method|module)\b",
    rf"where\s+(?:is|are)\s+(?:the\s+)?{NAME}\s+defined\b", rf"\bdefinitions?\s+of\s+(?:the\s+)?{NAME}\b",
    rf"\bfind\s+(?:the\s+)?{NAME}\s+definition\b", rf"\b{NAME}\s+definition\s*$", rf"^define\s+{NAME}$",
]
add("definition_intent", f"""WITH {questions()} SELECT word, query, CASE WHEN length(query) >= 4 THEN coalesce({', '.join(f"nullif(regexp_extract(query, '(?i){p}', 1), '')" for p in INTENTS)}) END AS target FROM questions""")
VERB = r"(?:find|locate|show|open|get|lookup)\s+"
add("definition_infer", f"""WITH {questions()}, g AS (SELECT word, query, regexp_extract(query, '(?i)^(?:{VERB}|navigate\\s+to\\s+|search\\s+for\\s+|go\\s+to\\s+)(?:the\\s+)?([A-Za-z][A-Za-z0-9_]{{3,63}})\\s*[?.!,;:]*$', 1) AS studly,
   nullif(regexp_extract(query, '(?i)^{VERB}(?:the\\s+)?(.+?)\\s+base\\s+class\\b[?.!,;:]*$', 1), '') AS base,
   regexp_extract(query, '(?i)^{VERB}(?:the\\s+)?([a-z][a-z0-9_]{{3,63}})\\s*[?.!,;:]*$', 1) AS snake,
   regexp_extract(query, '^([A-Z][A-Za-z0-9_]{{3,63}})[?.!,:;]*$', 1) AS bare, regexp_extract(query, '^([a-z][a-z0-9_]{{3,63}})[?.!,:;]*$', 1) AS bare_snake FROM questions),
  j AS (SELECT *, string_split_regex(base, '\\s+') AS parts FROM g),
  k AS (SELECT *, array_to_string(list_transform(parts, lambda p: upper(p[1])||lower(p[2:])), '') AS joined FROM j)
  SELECT word, query, CASE WHEN length(query) BETWEEN 4 AND 128 THEN coalesce(CASE WHEN regexp_matches(studly, '^[A-Z]') THEN studly END,
   CASE WHEN length(base) <= 80 AND len(parts) <= 6 AND length(joined) BETWEEN 4 AND 64 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[A-Za-z][A-Za-z0-9_]*$'))) = 0 THEN joined END,
   CASE WHEN contains(snake, '_') THEN snake END, CASE WHEN NOT regexp_matches(query, '\\s') THEN coalesce(nullif(bare, ''), CASE WHEN contains(bare_snake, '_') THEN bare_snake END) END) END AS target FROM k""")
AMBIGUOUS = r"length({q}) BETWEEN 2 AND 64 AND (regexp_matches({q}, '^[A-Za-z_][A-Za-z0-9_]*$') OR regexp_matches({q}, '(?i)^(the|a|an)\s+[A-Za-z_][A-Za-z0-9_]*$'))"
add("ambiguous_literal", f"""WITH {questions()}, {ALL_ASKED}, u AS (SELECT query FROM questions UNION SELECT query FROM a)
  SELECT query, {AMBIGUOUS.format(q=f"regexp_replace(query, '^{SPACES}+|{SPACES}+$', '', 'g')")} AS ambiguous FROM u""")

TESTISH = "(contains(p,'/spec/') OR starts_with(p,'spec/') OR contains(p,'/test/') OR starts_with(p,'test/') OR contains(p,'__tests__'))"
FRONTISH = """(regexp_matches(p, '\\.(tsx|jsx|vue|svelte)$') OR regexp_matches(p, '/(components|ui|frontend|client|web)/|app/javascript|packages/ui|src/packs')
  OR regexp_matches(p, '^(frontend|client|web)/'))"""
CONFIG_EXT = "regexp_matches(p, '[^/]\\.(json|jsonc|yaml|yml|toml|tf|tfvars|hcl|properties|ini|cfg|conf)$')"


def path_prior(symbol: str, tests: str, frontend: str, focus: str) -> str:
    """Over p, the lower-cased path."""
    return f"""(CASE WHEN regexp_matches(p, '^(app/(models|controllers|services)|lib|src)/') THEN CASE WHEN {focus} = 'config' THEN 0.08 ELSE 0.2 END ELSE 0 END::DOUBLE
     + CASE WHEN {TESTISH} THEN CASE WHEN {tests} THEN 0.12 ELSE -0.12 END WHEN {frontend} AND {FRONTISH} THEN 0.1 ELSE 0 END::DOUBLE
     + CASE WHEN regexp_matches(p, '/(fixtures|locales|assets)/') THEN CASE WHEN {symbol} THEN -0.2 ELSE -0.08 END ELSE 0 END::DOUBLE
     + CASE WHEN {focus} = 'config' AND {CONFIG_EXT} THEN 0.12 WHEN {focus} <> 'config' AND regexp_matches(p, '\\.ya?ml$') THEN CASE WHEN {symbol} THEN -0.15 ELSE -0.05 END ELSE 0 END::DOUBLE)"""


FOCUS_OF = "['auto','code','config','docs'][{} % 4 + 1]"
add("code_path_prior", f"""WITH {PATHS}, l AS (SELECT *, lower(path) AS p, {FOCUS_OF.format('doc_id')} AS focus FROM paths)
  SELECT doc_id, path, round({path_prior('doc_id % 2 = 0', 'doc_id % 3 = 0', 'doc_id % 5 < 3', 'focus')}, 6) AS prior FROM l""")


def demotion(per: float) -> str:
    return f"-least(0.4, {per} * (contains(p,'fixtures')::INT + contains(p,'docs/src1')::INT + contains(p,'spec')::INT))::DOUBLE"


add("user_demote", f"WITH {PATHS}, l AS (SELECT *, lower(path) AS p FROM paths) SELECT doc_id, path, round({demotion(0.15)}, 6) + 0.0 AS demotion FROM l")
FOCUS_PRIOR = """CASE WHEN focus = 'auto' THEN 0 WHEN focus = bucket THEN CASE focus WHEN 'config' THEN 0.22 ELSE 0.16 END
  WHEN focus = 'code' THEN CASE bucket WHEN 'config' THEN -0.1 ELSE -0.14 END WHEN focus = 'config' THEN CASE bucket WHEN 'code' THEN -0.07 ELSE -0.11 END
  ELSE CASE bucket WHEN 'code' THEN -0.09 ELSE -0.06 END END::DOUBLE"""
add("classifier_prior", f"""WITH {STEMMED}, b AS (SELECT doc_id, path, {BUCKET} AS bucket, unnest(['auto','code','config','docs']) AS focus FROM stemmed)
  SELECT doc_id, path, focus, round({FOCUS_PRIOR}, 6) AS prior FROM b""")


def share(tokens: str, test: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN 0 ELSE len(list_filter({tokens}, lambda t: {test})) / len({tokens}) END"


WHOLE = r"contains({x}, t) AND regexp_matches({x}, '(^|[^a-z0-9_])'||regexp_replace(t, '([.$])', '\\\1', 'g')||'([^a-z0-9_]|$)')"


def features(source: str) -> str:
    """CTE feat over source(query_id, ord, chunk_id, ...)."""
    return f"""qf AS (SELECT query_id, query, focus, {TOKENS.format(q='query')} AS toks FROM asked),
     qs AS (SELECT *, list_distinct(list_concat(list_filter(toks, lambda t: regexp_matches(t, '[_./$-]')), list_transform(regexp_extract_all(query, '{CAMEL}'), lambda t: lower(t)))) AS syms,
       len(list_filter(toks, lambda t: contains(t,'_') OR contains(t,'/'))) > 0 OR regexp_matches(query, '{CAMEL}') AS symq,
       regexp_matches(query, '{TESTS}') AS tests, regexp_matches(query, '{FRONTEND}') AS frontend FROM qf),
     cand AS (SELECT s.*, qs.* EXCLUDE (query_id), dl.path, lower(dl.path) AS p, lower(dl.text) AS low, length(dl.text) AS n_text, dl.text FROM {source} s JOIN qs USING (query_id) JOIN dl USING (chunk_id)),
     feat AS (SELECT *, ({share('toks', 'contains(low, t)')})::DOUBLE AS lexical, ({share('toks', WHOLE.format(x='low'))})::DOUBLE AS exact, ({share('toks', WHOLE.format(x='p'))})::DOUBLE AS exact_path,
       ({share('toks', 'contains(p, t)')})::DOUBLE AS path_hint, ({share('syms', 'contains(low, t) OR contains(p, t)')})::DOUBLE AS symbol FROM cand)"""


add("lexical_features", f"""WITH {bm25()}, top AS {ranked('bm', 'bm25 DESC, chunk_id', 100)}, {features('top')}
  SELECT {LISTED}, round(lexical, 6) AS lexical, round(exact, 6) AS exact, round(exact_path, 6) AS exact_path, round(path_hint, 6) AS path_hint, round(symbol, 6) AS symbol FROM feat""")
FILE_BUCKET = """CASE WHEN starts_with(path,'.claude/docs/') THEN 'docs' WHEN regexp_matches(path,'\\.(yml|json)$') THEN 'config' WHEN path LIKE '%.md' THEN 'docs' ELSE 'code' END"""
FOCUS_ITEM = FOCUS_OF.format("item_id")
OUTSIDE = "NOT starts_with(path, '.claude/docs/')"


def reranked(query: str, k: int | str, demoted: str = "0", focus: str = FOCUS_ITEM, depth: int | str = 400, where: str = OUTSIDE) -> str:
    """CTE rr(query_id, ord, chunk_id, score, rerank_score)."""
    return f"""{hybrid(query, focus, depth, 100, where)}, {features('fused')},
     pri AS (SELECT *, {path_prior('symq', 'tests', 'frontend', 'focus')} + {demoted} AS pp, {FILE_BUCKET} AS bucket FROM feat),
     sc AS (SELECT * EXCLUDE (ord), ord AS was, pp + {FOCUS_PRIOR} AS prior FROM pri),
     scored AS (SELECT *, CASE WHEN symq THEN score*0.35 + lexical*0.2 + exact*0.2 + exact_path*0.15 + symbol*0.15 + prior
        ELSE score*0.5 + lexical*0.2 + exact*0.1 + path_hint*0.1 + symbol*0.05 + prior END AS rerank_score FROM sc),
     rr AS {ranked('scored', 'rerank_score DESC, was', k)}"""


add("rerank_natural", f"WITH {reranked('text', 10)} SELECT {LISTED}, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM rr")
OWN_FILTER = f"""CASE query_id % 5 WHEN 0 THEN {OUTSIDE} WHEN 1 THEN path = 'lib' OR path LIKE 'lib/%'
  WHEN 2 THEN (lower(path) LIKE '%.rb' OR lower(path) LIKE '%.tsx' OR lower(path) LIKE '%.d.ts') AND {OUTSIDE}
  WHEN 3 THEN regexp_matches(lower(path), '\\.(yaml|yml)$') ELSE regexp_matches({BASE}, '^d.*[0-4]\\.(md|json)$') AND {OUTSIDE} END"""
_OWN = reranked("text", "[10, 3, 7, 5, 50][query_id % 5 + 1]", "0", "CASE WHEN item_id % 5 = 4 THEN 'docs' ELSE 'auto' END", "CASE WHEN query_id % 5 = 1 THEN 100 ELSE 400 END", OWN_FILTER)
add("search_filtered_batch", f"WITH {_OWN} SELECT {LISTED}, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM rr")
FIND_USER = "'findUser '||text"
add("rerank_symbol", f"WITH {reranked(FIND_USER, 10, demotion(0.1))} SELECT {LISTED}, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM rr")
add("classifier_sort", f"""WITH {hybrid('text', FOCUS_ITEM, 400, 100, OUTSIDE)}, c AS (SELECT fused.* EXCLUDE (ord), ord AS was, focus, {FILE_BUCKET} AS bucket FROM fused JOIN dl USING (chunk_id) JOIN asked USING (query_id)),
  s AS (SELECT *, score + {FOCUS_PRIOR} AS key FROM c) SELECT {LISTED}, round(score, 6) AS score FROM {ranked('s', 'CASE WHEN focus = ' + "'auto'" + ' THEN -was ELSE key END DESC, score DESC, was', 10)}""")
DEFINE = "'define '||regexp_extract(text, '([A-Za-z]+)', 1)"
add("definition_sort", f"""WITH {hybrid(DEFINE, "'auto'", 400, 100, OUTSIDE)}, c AS (SELECT fused.* EXCLUDE (ord), ord AS was, score + CASE WHEN lower(regexp_extract(text, '([A-Za-z]+)', 1)) = lower(query[8:]) AND query <> 'define ' THEN 0.18 ELSE 0 END::DOUBLE AS key
  FROM fused JOIN dl USING (chunk_id) JOIN asked USING (query_id)) SELECT {LISTED}, round(score, 6) AS score FROM {ranked('c', 'key DESC, was', 10)}""")
add("cross_encoder", f"""WITH {reranked('text', 50)}, ce AS (SELECT query_id, chunk_id, ord AS was, score, rerank_score, (n_text % 17 - 8)::DOUBLE AS logit FROM rr)
  SELECT {LISTED}, round(1/(1+exp(-logit)), 6) AS score, round(rerank_score, 6) AS rerank_score, round(logit, 6) AS cross_encoder_logit FROM {ranked('ce', 'logit DESC, was', 10)}""")


def confidence(amb: str, diverge: str) -> str:
    """Over t0, t1, sep."""
    tight = "(t1 IS NOT NULL AND sep < 0.05)"
    extra = f"CASE WHEN {amb} THEN 'possible_ambiguous_literal_query,' ELSE '' END || CASE WHEN {diverge} THEN 'top_hits_different_path_families,' ELSE '' END"
    return f"""CASE WHEN t0 IS NULL OR t0 < 0.35 THEN 'low' WHEN t0 >= 0.55 AND NOT {tight} AND NOT ({amb}) AND NOT ({diverge}) THEN 'high' ELSE 'medium' END AS match_confidence,
     CASE WHEN t0 IS NULL THEN 'no_hits' WHEN t0 < 0.35 THEN CASE WHEN {tight} THEN 'tight_top_scores,' ELSE '' END || 'low_primary_score'
      WHEN t0 >= 0.55 AND NOT {tight} THEN {extra} || 'strong_top_and_separation' WHEN t0 >= 0.55 THEN 'strong_score_but_tight_top,tight_top_scores'
      WHEN {tight} THEN 'tight_top_scores' ELSE 'below_strong_threshold' END AS reasons"""


FAMILY = "CASE WHEN {x} LIKE '%.rb' THEN 'r' WHEN regexp_matches({x}, '\\.tsx?$') THEN 't' WHEN {x} LIKE '%.css' THEN 'w' END"
DIVERGE = f"coalesce(({FAMILY.format(x='p0')}) <> ({FAMILY.format(x='p1')}), false)"
SEPARATION = "CASE WHEN t1 IS NULL THEN 1 ELSE (t0 - t1) / greatest(abs(t0), 1e-9) END"
add("match_confidence", f"""WITH {reranked('text', 2)}, two AS (SELECT query_id, max(CASE WHEN ord=1 THEN rerank_score END) AS t0, max(CASE WHEN ord=2 THEN rerank_score END) AS t1,
   max(CASE WHEN ord=1 THEN path END) AS p0, max(CASE WHEN ord=2 THEN path END) AS p1 FROM rr GROUP BY query_id),
  x AS (SELECT query_id, asked.query, t0, t1, p0, p1, {SEPARATION} AS sep FROM asked LEFT JOIN two USING (query_id))
  SELECT query_id, {confidence(AMBIGUOUS.format(q='query'), DIVERGE)}, round(t0, 6) AS top_primary_score, CASE WHEN t1 IS NOT NULL THEN round(sep, 6) END AS separation FROM x""")
_S = "((length(word)*{n} + ascii(word)) % 83) / 100.0::DOUBLE"
_E = "['rb','ts','css','md'][length(word)*{n} % 4 + 1]"
add("match_confidence_words", f"""WITH {questions()}, two AS (SELECT word, query, greatest({_S.format(n=3)}, {_S.format(n=5)}) AS t0, CASE WHEN length(word) % 7 <> 0 THEN least({_S.format(n=3)}, {_S.format(n=5)}) END AS t1,
   'a.'||{_E.format(n=1)} AS p0, CASE WHEN length(word) % 7 <> 0 THEN 'b.'||{_E.format(n=3)} END AS p1 FROM questions), x AS (SELECT *, {SEPARATION} AS sep FROM two)
  SELECT word, {confidence(AMBIGUOUS.format(q='query'), DIVERGE)}, round(t0, 6) AS t0, CASE WHEN t1 IS NOT NULL THEN round(sep, 6) END AS separation FROM x""")


def hashed(source: str, key: str, text: str) -> str:
    """(key, v DOUBLE[64]): the stand-in embedding of a text column."""
    return f"""(SELECT {key}, list_transform(slots, lambda x: (x / norm)::FLOAT::DOUBLE) AS v FROM (
      SELECT {key}, list(x ORDER BY slot) AS slots, sqrt(sum(x * x)) AS norm FROM (
       SELECT {key}, slot, coalesce(sum(sign), 0)::DOUBLE AS x FROM (SELECT {key}, unnest(range(64)) AS slot FROM {source}) LEFT JOIN (
        SELECT {key}, h % 64 AS slot, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (
         SELECT {key}, ('0x'||substr(md5(term),1,8))::BIGINT AS h FROM (SELECT {key}, unnest({TERMS.format(text)}) AS term FROM {source}))
       ) USING ({key}, slot) GROUP BY ALL) GROUP BY ALL))"""


_HEADER = f"path||' '||{BASE}||' '||replace({BASE},'-',' ')||' '||replace(path,'/',' ')"


def searched(chunks: str) -> str:
    """The whole search over dl(chunk_id, path, start_line, end_line, text, stored, embedded, def), the last CTE of `chunks`."""
    return f"""WITH {chunks}, {ASKED.format(query='text', focus="'auto'")}, vec AS {hashed('dl', 'chunk_id', 'embedded')},
  q AS (SELECT query_id, v AS q FROM {hashed('asked', 'query_id', 'query')}),
  post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TERMS.format('stored')}) AS term FROM dl) GROUP BY ALL),
  lens AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY chunk_id), st AS (SELECT (SELECT count(*) FROM dl) AS n, (SELECT sum(dl) FROM lens) / (SELECT count(*) FROM dl) AS a),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM asked) GROUP BY ALL),
  bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS bm25
     FROM qt JOIN dfs USING (term) JOIN post USING (term) JOIN lens USING (chunk_id), st GROUP BY ALL),
  d AS (SELECT query_id, chunk_id, {DISTANCE} AS distance FROM q, vec JOIN dl USING (chunk_id) WHERE {OUTSIDE}), vleg AS {ranked('d', 'distance, chunk_id', 400)},
  tleg AS {ranked(f'(SELECT bm.* FROM bm JOIN dl USING (chunk_id) WHERE {OUTSIDE})', 'bm25 DESC, chunk_id', 400)},
  both_legs AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE/(60+v.ord), 0) + coalesce(1.0::DOUBLE/(60+t.ord), 0) AS score FROM vleg v FULL JOIN tleg t USING (query_id, chunk_id)),
  fused AS {ranked('both_legs', 'score DESC, chunk_id', 100)}, {features('fused')},
  sc AS (SELECT * EXCLUDE (ord), ord AS was, {path_prior('symq', 'tests', 'frontend', 'focus')} AS prior FROM feat),
  scored AS (SELECT *, CASE WHEN symq THEN score*0.35 + lexical*0.2 + exact*0.2 + exact_path*0.15 + symbol*0.15 + prior
     ELSE score*0.5 + lexical*0.2 + exact*0.1 + path_hint*0.1 + symbol*0.05 + prior END AS rerank_score FROM sc),
  rr AS {ranked('scored', 'rerank_score DESC, was', 10)},
  two AS (SELECT query_id, max(CASE WHEN ord=1 THEN rerank_score END) AS t0, max(CASE WHEN ord=2 THEN rerank_score END) AS t1,
     max(CASE WHEN ord=1 THEN path END) AS p0, max(CASE WHEN ord=2 THEN path END) AS p1 FROM rr GROUP BY query_id),
  x AS (SELECT query_id, asked.query, t0, t1, p0, p1, {SEPARATION} AS sep FROM asked JOIN two USING (query_id)),
  conf AS (SELECT query_id, {confidence(AMBIGUOUS.format(q='query'), DIVERGE)} FROM x)
  SELECT query_id, ord::INT AS ord, rr.path, start_line, end_line, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score,
   dl.def AS definition_of, match_confidence FROM rr JOIN dl USING (chunk_id) JOIN conf USING (query_id)"""


add("search_chunks", searched(f"""{FILES}, dl AS (SELECT path||'#'||ordinal AS chunk_id, path, start_line, end_line, body AS text, {_HEADER}||' '||body AS stored,
  '[path='||path||']'||chr(10)||body AS embedded, NULL::VARCHAR AS def FROM {windows('files', 60, 12)})"""))
# The language label of each form of source file.
FORM_LANGUAGE = """CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'rs' THEN 'rust'
  WHEN 'yml' THEN 'yaml' ELSE regexp_extract(path, '\\.([a-z]+)$', 1) END"""
add("search_e2e", searched(f"""{SYMBOL_PARTS}, numbered AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a) - 1) AS ordinal, a::INT AS start_line, b::INT AS end_line,
    name, kind, def, array_to_string(ls[a:b], chr(10)) AS body FROM parts JOIN lined USING (path)),
  dl AS (SELECT path||'#'||ordinal AS chunk_id, path, start_line, end_line, body AS text, {_HEADER}||' '||body AS stored, '[path='||path||'][lang='||{FORM_LANGUAGE}||']'
    ||coalesce('[symbol='||name||']', '')||coalesce('[kind='||kind||']', '')||coalesce('[def='||def||']', '')||chr(10)||body AS embedded, def FROM numbered)"""))

INDEXED = "SELECT path, a::INT AS start_line, b::INT AS end_line, array_to_string(ls[a:b], chr(10)) AS body, def AS definition_of FROM parts JOIN lined USING (path)"
add("index_build", f"WITH {SYMBOL_PARTS} {INDEXED}")
add("file_scan", f"WITH {SYMBOL_PARTS} {INDEXED}")
add("index_upsert", f"WITH {SYMBOL_PARTS} {INDEXED}")
add("index_remove", f"WITH {SYMBOL_PARTS} {INDEXED} WHERE path IN (SELECT path FROM src WHERE doc_id % 3 = 1)")
add("index_wipe", "SELECT 0::BIGINT AS n_chunks, 32 AS dim")
add("index_stats", f"""WITH {SYMBOL_PARTS}, numbered AS (SELECT path, a, {_HEADER}||' '||array_to_string(ls[a:b], chr(10)) AS stored FROM parts JOIN lined USING (path)),
  post AS (SELECT DISTINCT path, a, unnest({TERMS.format('stored')}) AS term FROM numbered)
  SELECT (SELECT count(*) FROM src) AS indexed_file_count, (SELECT count(*) FROM numbered) AS chunk_count,
   (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT count(*) FROM post) AS n_postings""")
add("index_versions", f"""WITH {FILES}, old AS (SELECT path, CASE WHEN doc_id % 5 = 2 THEN 'old'||chr(10)||text ELSE text END AS text FROM files WHERE doc_id % 7 <> 1),
  c AS (SELECT 'old' AS state, * FROM {windows('old', 60, 12)} UNION ALL SELECT 'new', * FROM {windows('files', 60, 12)}),
  p AS (SELECT DISTINCT state, path, ordinal, unnest({TERMS.format(f"{_HEADER}||' '||body")}) AS term FROM c)
  SELECT state, path, start_line, end_line, body, n_postings, n_files FROM c JOIN (SELECT state, count(*) AS n_postings FROM p GROUP BY state) USING (state)
   JOIN (SELECT state, count(DISTINCT path) AS n_files FROM c GROUP BY state) USING (state)""")
add("index_migrated", f"""WITH {SYMBOL_PARTS}, kept AS (SELECT path, a, b, array_to_string(ls[a:b], chr(10)) AS body FROM parts JOIN lined USING (path)
   WHERE path IN (SELECT path FROM src WHERE doc_id % 3 <> 0))
  SELECT path, a::INT AS start_line, b::INT AS end_line, '' AS definition_of, len({TERMS.format(f"{_HEADER}||' '||body")})::BIGINT AS dl FROM kept""")
add("safety_parents", f"""WITH {PATHS} SELECT doc_id, path||'/inner.txt' AS path, list_contains(string_split(path,'/'),'.git') OR list_contains(string_split(path,'/'),'node_modules')
   OR regexp_matches(lower(path), '\\.(pem|key|p12|pfx|env|env\\.local|env\\.production)(/|$)') AS unsafe FROM paths""")
add("cover_ancestors", f"""WITH {PATHS}, above AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path FROM (
    SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT string_split(path, '/') AS parts FROM paths)))
  SELECT path, path = '.claude/docs' OR starts_with(path, '.claude/docs/') OR starts_with('.claude/docs', path||'/') AS covered FROM above""")
add("snippets", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000)||'…' ELSE text END AS snippet FROM documents")
add("env_sections", f"""WITH l AS (SELECT doc_id, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) - 1 AS line FROM documents),
   k AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN ['development', ' TEST', 'Production ', 'staging'][doc_id % 4 + 1] ELSE regexp_extract(x, '([A-Za-z]+)', 1) END AS key FROM l)
   SELECT doc_id, line::INT AS line, CASE WHEN lower(trim(key)) IN ('development', 'test', 'production') THEN lower(trim(key)) END AS section FROM k""")
_SOME_BLANK = "CASE WHEN item_id % 2 = 0 THEN ' ' ELSE text END"
add("blank_queries", f"""WITH {hybrid(_SOME_BLANK, limit=10)} SELECT query_id, ord::INT AS ord, chunk_id, 'hybrid' AS retrieval_mode, round(score, 6) AS score FROM fused WHERE query_id % 2 = 1
  UNION ALL SELECT query_id, ord::INT, chunk_id, 'vector', round(1/(1+distance), 6) FROM vleg WHERE query_id % 2 = 0 AND ord <= 10""")
_HINT = {k: "'" + v.replace("'", "''") + "'" for k, v in HINTS.items()}
add("confidence_hints", f"""SELECT word, match_confidence, CASE match_confidence WHEN 'low' THEN {_HINT['low']} WHEN 'high' THEN {_HINT['high']} ELSE
   CASE WHEN contains(reasons, 'possible_ambiguous_literal_query') THEN {_HINT['possible_ambiguous_literal_query']}
   WHEN contains(reasons, 'top_hits_different_path_families') THEN {_HINT['top_hits_different_path_families']} ELSE {_HINT['medium']} END END AS hint FROM ({ORACLE['match_confidence_words']})""")
