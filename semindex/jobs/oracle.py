"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from semindex.functions import constants as K
from semindex.sources.derived import FILES_SQL, MANIFEST_SQL, MODELS, PREFIXES, PROVIDERS, SIZE_CAP, listed

EXT = r"regexp_extract(lower(file_path), '(\.[^./]*)$', 1)"
TOKENS = "ceil(length({}) / 4.0)::bigint"

DIFF = f"""
{MANIFEST_SQL.strip()}, change AS (
  SELECT coalesce(f.collection_id, m.collection_id) AS collection_id, coalesce(f.file_path, m.file_path) AS file_path, f.content,
    CASE WHEN f.file_path IS NULL THEN 'deleted' WHEN f.size_bytes > {SIZE_CAP} THEN 'skipped' WHEN m.file_path IS NULL THEN 'new'
      WHEN m.file_hash <> sha256(f.content) THEN 'changed' ELSE 'unchanged' END AS change
  FROM files f FULL JOIN prev_manifest m ON f.collection_id = m.collection_id AND f.file_path = m.file_path
)"""


def packed(source: str, tag: str = "") -> str:
    """Recursive packing of the lines of ``source`` (collection_id, file_path, content): a step per line, then ``blocks``. ``tag`` ends the names."""
    return f"""
t{tag} AS (
  SELECT collection_id, file_path, string_split(content, chr(10)) AS lines FROM {source}
), u{tag} AS (
  SELECT *, len(lines) AS n, list_transform(lines, lambda x: length(x)) AS raw FROM t{tag}
), w{tag} AS (
  SELECT *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(raw[1:i]), 0)::bigint) AS upto FROM u{tag}
), step{tag}(collection_id, file_path, i, first, told, held, e_first, e_end, e_told, e_border) AS (
  SELECT collection_id, file_path, 0::bigint, 0::bigint, 0::bigint, 0::bigint, NULL::bigint, NULL::bigint, NULL::bigint, NULL::bigint FROM w{tag}
  UNION ALL
  SELECT collection_id, file_path, i + 1,
    CASE kind WHEN 'long' THEN i + 1 WHEN 'full' THEN i ELSE first END,
    CASE kind WHEN 'long' THEN i + 1 WHEN 'full' THEN border + 1 ELSE told END,
    CASE kind WHEN 'long' THEN 0 WHEN 'full' THEN size ELSE held + size END,
    CASE WHEN flush THEN first END, CASE WHEN flush THEN i END, CASE WHEN flush THEN told END, CASE WHEN flush THEN border END
  FROM (
    SELECT *, kind <> 'add' AND held >= {K.MIN_BLOCK_CHARS} AND i > first AS flush,
      CASE WHEN kind = 'full' AND held >= {K.MIN_BLOCK_CHARS} AND rest < {K.MIN_REMAINDER_CHARS} AND i - first > 1
        THEN coalesce(list_max(list_filter(range(told, i - 1), lambda k:
          upto[k + 2] - upto[told + 1] + (k - told) + 1 >= {K.MIN_BLOCK_CHARS} AND upto[n + 1] - upto[k + 2] + (n - k - 2) + 1 >= {K.MIN_REMAINDER_CHARS})), i - 1)
        ELSE i - 1 END AS border
    FROM (
      SELECT s.collection_id, s.file_path, s.i, s.first, s.told, s.held, w.n, w.upto,
        w.raw[s.i + 1] + (s.i < w.n - 1)::int AS size, w.upto[w.n + 1] - w.upto[s.i + 1] + (w.n - 1 - s.i) AS rest,
        CASE WHEN w.raw[s.i + 1] + (s.i < w.n - 1)::int > {K.MAX_PACK_CHARS} THEN 'long'
          WHEN s.held > 0 AND s.held + w.raw[s.i + 1] + (s.i < w.n - 1)::int > {K.MAX_PACK_CHARS} THEN 'full' ELSE 'add' END AS kind
      FROM step{tag} s JOIN w{tag} w ON s.collection_id = w.collection_id AND s.file_path = w.file_path WHERE s.i < w.n
    )
  )
), packs{tag} AS (
  SELECT collection_id, file_path, e_first AS a, e_end AS b, e_told AS told, e_border AS border FROM step{tag} WHERE e_first IS NOT NULL
  UNION ALL
  SELECT s.collection_id, s.file_path, s.first, w.n, s.told, w.n - 1 FROM step{tag} s JOIN w{tag} w ON s.collection_id = w.collection_id AND s.file_path = w.file_path
  WHERE s.i = w.n AND s.held >= {K.MIN_BLOCK_CHARS} AND w.n > s.first
), raw_blocks{tag} AS (
  SELECT p.collection_id, p.file_path, told + 1 AS start_line, border + 1 AS end_line, NULL::bigint AS piece_offset, array_to_string(w.lines[a + 1:b], chr(10)) AS content
  FROM packs{tag} p JOIN w{tag} w ON p.collection_id = w.collection_id AND p.file_path = w.file_path
  UNION ALL
  SELECT collection_id, file_path, i, i, o, substr(lines[i], o + 1, {K.MAX_BLOCK_CHARS})
  FROM (SELECT *, unnest(range(0, raw[i], {K.MAX_BLOCK_CHARS})) AS o FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM w{tag}) WHERE raw[i] + (i < n)::int > {K.MAX_PACK_CHARS})
), blocks{tag} AS (
  SELECT DISTINCT collection_id, file_path, start_line, end_line, piece_offset, content,
    sha256(collection_id || '/' || file_path || '-' || start_line || '-' || end_line || '-' || CASE WHEN piece_offset IS NULL THEN '' ELSE piece_offset || '-' END
      || length(content) || '-' || substr(content, 1, 100)) AS segment_hash
  FROM raw_blocks{tag}
)"""


TODO = f"""todo AS (SELECT collection_id, file_path, content FROM change WHERE change IN ('new', 'changed')), {packed("todo").strip()},
todo_blocks AS (SELECT collection_id, count(*) AS n_blocks FROM blocks GROUP BY collection_id)"""

SUMMARY = f"""
c AS (
  SELECT collection_id, count(*) FILTER (change IN ('new', 'changed')) AS processed_files, count(*) FILTER (change IN ('unchanged', 'skipped')) AS skipped_files, count(*) FILTER (change = 'deleted') AS deleted_files
  FROM change GROUP BY collection_id
), summary AS (
  SELECT collection_id, processed_files, skipped_files, deleted_files, processed_files + deleted_files > 0 AS performed, processed_files + deleted_files > 0 AS triggered,
    CASE WHEN processed_files + deleted_files > 0 THEN '{K.RUN_REASONS["applied"]}' ELSE '{K.RUN_REASONS["fresh"]}' END AS reason,
    CASE WHEN processed_files + deleted_files > 0 THEN coalesce(n_blocks, 0) ELSE 0 END AS indexed_blocks
  FROM c LEFT JOIN todo_blocks USING (collection_id)
)"""

DRY = f"""
SELECT c.collection_id, count(*) FILTER (change = 'changed') AS changed_files, count(*) FILTER (change = 'new') AS new_files,
  count(*) FILTER (change = 'deleted') AS deleted_files, count(*) FILTER (change = 'skipped') AS skipped_files,
  coalesce(any_value(n_blocks), 0) AS estimated_blocks, ceil(coalesce(any_value(n_blocks), 0) / {K.BATCH_BLOCKS}.0)::bigint AS estimated_batches
FROM change c LEFT JOIN todo_blocks b ON b.collection_id = c.collection_id GROUP BY c.collection_id"""

def hashed_id(path: str, start: str, end: str, offset: str, content: str) -> str:
    return f"""sha256({path} || '-' || {start} || '-' || {end} || '-' || CASE WHEN {offset} IS NULL THEN '' ELSE {offset} || '-' END || length({content}) || '-' || substr({content}, 1, 100))"""


def uuid5(name: str) -> str:
    """Of a text column that holds the name."""
    x = f"sha1(from_hex('{K.POINT_NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"""substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-5' || substr({x}, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr({x}, 17, 1))::int % 4 + 1] || substr({x}, 18, 3) || '-' || substr({x}, 21, 12)"""


def sections(source: str, tag: str = "") -> str:
    """Markdown sections of ``source`` (collection_id, file_path, lines)."""
    return f"""
heads{tag} AS (
  SELECT *, list_sort(list_filter(list_transform(range(1, len(lines) + 1), lambda i: CASE
    WHEN regexp_matches(lines[i], '^(#{{1,6}})\\s+(.+)$') THEN i - 1
    WHEN i > 1 AND regexp_matches(lines[i], '^(={{3,}}|-{{3,}})\\s*$') AND regexp_matches(lines[i - 1], '^\\s*[^#<>!\\[\\]`\\t]+[^\\n]$') THEN i - 2 END), lambda r: r IS NOT NULL)) AS starts
  FROM {source}
), cuts{tag} AS (
  SELECT *, CASE WHEN len(starts) > 0 AND starts[1] = 0 THEN starts ELSE list_concat([0], starts) END AS c FROM heads{tag}
), every{tag} AS (
  SELECT collection_id, file_path, c[k] + 1 AS start_line, coalesce(c[k + 1], len(lines)) AS end_line, array_to_string(lines[c[k] + 1:coalesce(c[k + 1], len(lines))], chr(10)) AS content
  FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM cuts{tag})
), sections{tag} AS (
  SELECT * FROM every{tag} WHERE length(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')) >= {K.MIN_BLOCK_CHARS}
)"""


def markdown_blocks(source: str, tag: str) -> str:
    """Blocks of markdown ``source``, as ``md_blocks``: sections, and packs of those over the limit with their own line numbers."""
    return f"""{sections(source, tag).strip()}, large{tag} AS (
  SELECT collection_id, file_path || chr(1) || start_line AS file_path, content FROM sections{tag} WHERE length(content) > {K.MAX_PACK_CHARS}
), {packed("large" + tag, tag).strip()}, md_blocks AS (
  SELECT collection_id, file_path, start_line, end_line, NULL::bigint AS piece_offset, content FROM sections{tag} WHERE length(content) <= {K.MAX_PACK_CHARS}
  UNION ALL SELECT collection_id, string_split(file_path, chr(1))[1], start_line + string_split(file_path, chr(1))[2]::bigint - 1, end_line + string_split(file_path, chr(1))[2]::bigint - 1, piece_offset, content FROM blocks{tag}
)"""


MARKDOWN = f"""
{FILES_SQL.strip()}, ml AS (
  SELECT collection_id, file_path, doc_id, list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN '## ' || x ELSE x END) AS l FROM files
), md AS (
  SELECT collection_id, file_path, CASE WHEN doc_id % 3 = 0 AND len(l) >= 2 THEN list_concat(list_concat(l[1:2], ['---']), l[3:]) ELSE l END AS lines FROM ml
), {sections("md").strip()}"""

QUERY_SET = """
q AS (
  SELECT vec_id AS query_id, CASE WHEN vec_id % 40 = 0 THEN 'src' END AS prefix, 5 + vec_id % 7 AS k, embedding::double[] AS qv FROM embeddings WHERE vec_id % 20 = 0
)"""

SCOPED = f"""
{FILES_SQL.strip()}, {QUERY_SET.strip()}, p AS (
  SELECT f.doc_id::varchar AS point_id, file_path, content, embedding::double[] AS v FROM files f JOIN embeddings e ON e.vec_id = f.doc_id
), s AS (
  SELECT query_id, k, point_id, file_path, content, round(list_cosine_similarity(v, qv), 6) AS score FROM q JOIN p ON q.prefix IS NULL OR starts_with(p.file_path, q.prefix || '/')
), top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= k
)"""

DOC_PATH = "(lower(file_path) LIKE '%/readme' OR lower(file_path) LIKE '%/docs/%' OR regexp_matches(lower(file_path), '\\.(md|markdown|txt|rst|adoc)$'))"

#: Millionths by hundredths, as integers.
WEIGHTED = f"""(round(score * 1e6)::bigint * CASE WHEN regexp_matches(lower(query), '\\b(readme|docs?|documentation|guide|tutorial|explain|overview)\\b')
    THEN CASE WHEN {DOC_PATH} THEN 108 ELSE 98 END ELSE CASE WHEN {DOC_PATH} THEN 90 ELSE 103 END END) / 1e8"""

RANKED = f"""
{SCOPED.strip()}, said AS (
  SELECT conv_id, arg_min(text, turn) AS words FROM conversations WHERE role = 'user' GROUP BY conv_id
), asked AS (
  SELECT t.*, coalesce(CASE WHEN query_id % 3 = 0 THEN 'explain ' || words ELSE words END, 'where is it') AS query FROM top t LEFT JOIN said ON conv_id = query_id WHERE content <> ''
), weighed AS (
  SELECT *, {WEIGHTED} AS weighted FROM asked
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, score DESC, rank) AS final_rank FROM weighed
)"""


def embedded(name: str, source: str, key: str, text: str) -> str:
    """Hashed bags of words of trimmed texts within the item limit, as 64 float values at unit length."""
    return f"""
{name}_t AS (
  SELECT {key} AS id, regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '') AS text FROM {source}
), {name}_b AS (
  SELECT id, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 AS dim, count(*) AS n
  FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS tok FROM {name}_t WHERE {TOKENS.format("text")} <= {K.MAX_ITEM_TOKENS}) WHERE tok <> '' GROUP BY ALL
), {name} AS (
  SELECT id, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::float AS v FROM {name}_b
)"""


SNAPSHOTS = """
ev AS (
  SELECT user_id % 20 AS key, ts::date AS "at", user_id, event_type, ts, event_id FROM events
), day AS (
  SELECT key, "at", count(*) AS n, arg_max(event_type, (ts, event_id)) <> 'error' AS indexing_complete FROM ev GROUP BY ALL
), fresh AS (
  SELECT key, "at", count(*) AS m FROM (SELECT key, user_id, min("at") AS "at" FROM ev GROUP BY ALL) GROUP BY ALL
), snap AS (
  SELECT key, "at", sum(n) OVER o AS points, sum(coalesce(m, 0)) OVER o AS cache_entries, indexing_complete
  FROM day LEFT JOIN fresh USING (key, "at") WINDOW o AS (PARTITION BY key ORDER BY "at")
)"""

TRIGGERS = """
trig AS (
  SELECT event_id, '/w/' || (user_id % 20) AS worktree, epoch_us(ts) // 1000 AS ms, event_type IN ('purchase', 'click') AS urgent,
    CASE event_type WHEN 'signup' THEN 'session.created' WHEN 'view' THEN 'session.idle' ELSE 'file.watcher.updated' END AS kind
  FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'click')
), due AS (
  SELECT *, ms + CASE WHEN urgent THEN 600000 ELSE 9000000 END AS due FROM trig
)"""

FIRED = """
f AS (
  SELECT *, coalesce(lead(ms) OVER o >= due, true) AS fires FROM due WINDOW o AS (PARTITION BY worktree ORDER BY ms, event_id)
), b AS (
  SELECT *, coalesce(sum(fires::int) OVER (PARTITION BY worktree ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS burst FROM f
), fired AS (
  SELECT worktree, arg_max(kind, (ms, event_id)) AS reason, arg_max(due, (ms, event_id)) AS fire_ms, bool_or(urgent) AS urgent FROM b GROUP BY worktree, burst
)"""

def pointed(todo: str) -> str:
    """Ids of the blocks of the files that ``todo`` selects (collection_id, file_path, content, ext), as ``ided``; non-blank blocks, once each."""
    return f"""todo AS ({todo}), md AS (SELECT collection_id, file_path, string_split(content, chr(10)) AS lines FROM todo WHERE list_contains({listed(K.MARKDOWN_EXTENSIONS)}, ext)),
      {markdown_blocks("md", "_m")}, others AS (
        SELECT collection_id, file_path, content FROM todo WHERE NOT list_contains({listed(K.MARKDOWN_EXTENSIONS + K.NO_GRAMMAR_EXTENSIONS)}, ext)
      ), {packed("others", "_o").strip()}, every AS (
        SELECT * FROM md_blocks UNION ALL SELECT collection_id, file_path, start_line, end_line, piece_offset, content FROM blocks_o
      ), hashes AS (
        SELECT *, {hashed_id("collection_id || '/' || file_path", "start_line", "end_line", "piece_offset", "content")} AS segment_hash FROM every WHERE regexp_matches(content, '\\S')
      ), ided AS (SELECT DISTINCT collection_id, file_path, start_line, end_line, {uuid5("segment_hash")} AS point_id FROM hashes)"""  # one block of each id


SUPPORTED = f"supported AS (SELECT *, {EXT} AS ext, size_bytes > {SIZE_CAP} AS big FROM files WHERE list_contains({listed(K.EXTENSIONS)}, {EXT}))"

SQL: dict[str, str] = {
    "corpus_filter": f"""WITH {FILES_SQL.strip()} SELECT collection_id, file_path, size_bytes FROM files
      WHERE list_contains({listed(K.EXTENSIONS)}, {EXT}) AND size_bytes <= {SIZE_CAP}
      AND NOT list_has_any(string_split(file_path, '/')[1:-2], {listed(K.IGNORED_DIRS)})""",
    "ignore_rules": f"""WITH {FILES_SQL.strip()} SELECT collection_id, file_path FROM files
      WHERE NOT (file_path LIKE 'src/auth/%' OR file_path LIKE 'node_modules/%' OR file_path LIKE '.hidden/%' OR file_path LIKE '%.log' OR regexp_matches(file_path, '^docs/src2[^/]*/'))""",
    "path_scope": f"""WITH {FILES_SQL.strip()}, p AS (
        SELECT no - 1 AS prefix_no, ps[no] AS prefix FROM (SELECT {listed(PREFIXES)} AS ps, unnest(range(1, {len(PREFIXES)} + 1)) AS no)
      ), q AS (SELECT prefix_no, nullif(trim(regexp_replace(regexp_replace(replace(prefix, '\\', '/'), '[^/]+/\\.\\./', ''), '^\\./|^\\.$', ''), '/'), '') AS norm FROM p)
      SELECT collection_id, prefix_no, count(*) AS n_files FROM files JOIN q ON norm IS NULL OR starts_with(file_path, norm || '/') GROUP BY ALL""",
    "segment_ids": f"""WITH {FILES_SQL.strip()}, h AS (
        SELECT doc_id, {EXT} AS extension, sha256(content) AS file_hash, {TOKENS.format("content")} AS est_tokens,
          sha256('/w/' || file_path || '-1-' || len(string_split(content, chr(10))) || CASE WHEN doc_id % 2 = 0 THEN '-1000' ELSE '' END || '-' || length(content) || '-' || substr(content, 1, 100)) AS segment_hash
        FROM files
      ), i AS (SELECT *, sha1(from_hex('{K.POINT_NAMESPACE.replace("-", "")}') || encode(segment_hash)) AS x FROM h)
      SELECT doc_id, extension, file_hash, segment_hash, est_tokens, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
        || ['8', '9', 'a', 'b'][('0x' || substr(x, 17, 1))::int % 4 + 1] || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS point_id FROM i""",
    "change_diff": f"WITH {DIFF.strip()} SELECT collection_id, file_path, change FROM change",
    "delete_set": f"WITH {DIFF.strip()} SELECT collection_id, file_path FROM change WHERE change IN ('deleted', 'changed')",
    "index_summary": f"WITH RECURSIVE {DIFF.strip()}, {TODO}, {SUMMARY.strip()} SELECT * FROM summary",
    "dry_run_status": f"WITH RECURSIVE {DIFF.strip()}, {TODO} {DRY}",
    "mode_assessments": f"""WITH RECURSIVE {DIFF.strip()}, {TODO}, dry AS ({DRY}), pts AS (
        SELECT collection_id, count(*) AS n_points, row_number() OVER (ORDER BY collection_id) AS no FROM files GROUP BY collection_id
      ), h AS (
        SELECT *, no <> 3 AS ready, CASE no WHEN 1 THEN 3 WHEN 2 THEN 90 END AS age, changed_files + new_files + deleted_files AS pending FROM pts JOIN dry USING (collection_id)
      )
      SELECT collection_id, 'disabled' AS mode, CASE WHEN ready THEN 'ok' ELSE 'problem' END AS severity,
        CASE WHEN ready THEN '{K.SAYS_READY[0]}' || n_points || '{K.SAYS_READY[1]}' ELSE '{K.SAYS_MISSING}' END AS explanation FROM h
      UNION ALL SELECT collection_id, 'query', CASE WHEN pending = 0 THEN 'ok' WHEN pending < 50 THEN 'warning' ELSE 'problem' END,
        CASE WHEN pending = 0 THEN '{K.SAYS_FRESH}' WHEN pending < 50 THEN pending || '{K.SAYS_PENDING}' || estimated_batches || ' embedding batches).'
        ELSE pending || '{K.SAYS_PENDING}' || estimated_blocks || ' blocks, ~' || estimated_batches || ' embedding batches).' END FROM h
      UNION ALL SELECT collection_id, 'background', CASE WHEN age IS NULL THEN 'problem' WHEN pending = 0 AND age <= 5 THEN 'ok' WHEN pending > 0 AND age >= 60 THEN 'problem' ELSE 'warning' END,
        CASE WHEN age IS NULL THEN '{K.SAYS_NEVER}' WHEN pending = 0 AND age <= 5 THEN '{K.SAYS_CAUGHT_UP[0]}' || age || 'm ago{K.SAYS_CAUGHT_UP[1]}'
        WHEN pending > 0 AND age >= 60 THEN '{K.SAYS_STALE[0]}' || pending || '{K.SAYS_STALE[1]}' || age || 'm ago{K.SAYS_STALE[2]}' ELSE pending || '{K.SAYS_WAITING[0]}' || age || 'm ago{K.SAYS_WAITING[1]}' END FROM h""",
    "chunk_lines": f"WITH RECURSIVE {FILES_SQL.strip()}, {packed('files').strip()} SELECT collection_id, file_path, start_line, end_line, length(content) AS n_chars, segment_hash FROM blocks",
    "markdown_sections": f"WITH {MARKDOWN.strip()} SELECT collection_id, file_path, start_line, end_line, sha256(content) AS content_hash FROM sections",
    "markdown_chunks": f"""WITH RECURSIVE {MARKDOWN.strip()}, {markdown_blocks("md", "_m")}
      SELECT collection_id, file_path, start_line, end_line, piece_offset, {hashed_id("collection_id || '/' || file_path", "start_line", "end_line", "piece_offset", "content")} AS segment_hash FROM md_blocks""",
    "refresh_index": f"""WITH RECURSIVE {DIFF.strip()}, todo AS (
        SELECT collection_id, file_path, content, {EXT} AS ext FROM change WHERE change IN ('new', 'changed') AND list_contains({listed(K.EXTENSIONS)}, {EXT})
      ), md AS (SELECT collection_id, file_path, string_split(content, chr(10)) AS lines FROM todo WHERE list_contains({listed(K.MARKDOWN_EXTENSIONS)}, ext)),
      {markdown_blocks("md", "_m")}, others AS (
        SELECT collection_id, file_path, content FROM todo WHERE NOT list_contains({listed(K.MARKDOWN_EXTENSIONS + K.NO_GRAMMAR_EXTENSIONS)}, ext)
      ), {packed("others", "_o").strip()}, every AS (
        SELECT * FROM md_blocks UNION ALL SELECT collection_id, file_path, start_line, end_line, piece_offset, content FROM blocks_o
      ), ided AS (
        SELECT *, {hashed_id("collection_id || '/' || file_path", "start_line", "end_line", "piece_offset", "content")} AS segment_hash FROM every WHERE regexp_matches(content, '\\S')
      ) SELECT DISTINCT collection_id, file_path, start_line, end_line, {uuid5("segment_hash")} AS point_id, 64 AS dim FROM ided""",
    "rebuild_index": f"""WITH RECURSIVE {FILES_SQL.strip()}, todo AS (
        SELECT collection_id, file_path, content, {EXT} AS ext, size_bytes > {SIZE_CAP} AS big FROM files WHERE list_contains({listed(K.EXTENSIONS)}, {EXT})
      ), md AS (SELECT collection_id, file_path, string_split(content, chr(10)) AS lines FROM todo WHERE NOT big AND list_contains({listed(K.MARKDOWN_EXTENSIONS)}, ext)),
      {markdown_blocks("md", "_m")}, others AS (
        SELECT collection_id, file_path, content FROM todo WHERE NOT big AND NOT list_contains({listed(K.MARKDOWN_EXTENSIONS + K.NO_GRAMMAR_EXTENSIONS)}, ext)
      ), {packed("others", "_o").strip()}, every AS (
        SELECT collection_id, content FROM md_blocks UNION ALL SELECT collection_id, content FROM blocks_o
      ), n AS (SELECT collection_id, count(*) AS n_blocks FROM every WHERE regexp_matches(content, '\\S') GROUP BY 1)
      SELECT collection_id, count(*) FILTER (NOT big) AS processed_files, count(*) FILTER (big) AS skipped_files, 0::bigint AS deleted_files, count(*) FILTER (NOT big) > 0 AS performed,
        count(*) FILTER (NOT big) > 0 AS triggered, CASE WHEN count(*) FILTER (NOT big) > 0 THEN '{K.RUN_REASONS["applied"]}' ELSE '{K.RUN_REASONS["fresh"]}' END AS reason,
        coalesce(any_value(n_blocks), 0) AS indexed_blocks FROM todo LEFT JOIN n USING (collection_id) GROUP BY collection_id""",
    "scoped_runs": f"""WITH RECURSIVE {FILES_SQL.strip()}, {SUPPORTED}, {pointed("SELECT collection_id, file_path, content, ext FROM supported WHERE NOT big AND (collection_id >= 'ws-8' OR doc_id % 2 = 0)")}
      SELECT *, 64 AS dim FROM ided""",
    "applied_changes": f"""WITH RECURSIVE {FILES_SQL.strip()}, now AS (
        SELECT collection_id, file_path, CASE WHEN doc_id % 5 = 0 THEN content || chr(10) || 'one line more of this file, as it is now' ELSE content END AS content, content AS before, {EXT} AS ext,
          doc_id % 5 = 0 AS moved FROM files WHERE doc_id % 7 <> 0 AND list_contains({listed(K.EXTENSIONS)}, {EXT})
      ), {pointed(f"SELECT collection_id, file_path, CASE WHEN strlen(content) > {SIZE_CAP} THEN before ELSE content END AS content, ext FROM now WHERE strlen(content) <= {SIZE_CAP} OR strlen(before) <= {SIZE_CAP}")}
      SELECT *, 64 AS dim FROM ided""",
    "corpus_of_files": f"WITH {FILES_SQL.strip()}, {SUPPORTED} SELECT file_path, size_bytes, sha256(content) AS file_hash FROM supported WHERE NOT big",
    "tree_runs": f"""WITH RECURSIVE {FILES_SQL.strip()}, now AS (
        SELECT collection_id, file_path, CASE WHEN doc_id % 9 = 0 THEN content || chr(10) || 'one line more of this file' ELSE content END AS content, {EXT} AS ext FROM files WHERE list_contains({listed(K.EXTENSIONS)}, {EXT})
      ), {pointed(f"SELECT collection_id, file_path, content, ext FROM now WHERE strlen(content) <= {SIZE_CAP}")}
      SELECT DISTINCT file_path, start_line, end_line, 64 AS dim, sha256(content) AS content_hash FROM hashes""",
    "adopt_index": f"""WITH RECURSIVE {MANIFEST_SQL.strip()}, {SUPPORTED}, change AS (
        SELECT coalesce(f.collection_id, m.collection_id) AS collection_id, coalesce(f.file_path, m.file_path) AS file_path, content, ext,
          CASE WHEN f.file_path IS NULL THEN 'deleted' WHEN big THEN 'skipped' WHEN m.file_path IS NULL THEN 'new' WHEN m.file_hash <> sha256(content) THEN 'changed' ELSE 'unchanged' END AS change
        FROM supported f FULL JOIN (SELECT * FROM prev_manifest WHERE collection_id < 'ws-8') m ON f.collection_id = m.collection_id AND f.file_path = m.file_path
      ), {pointed("SELECT collection_id, file_path, content, ext FROM change WHERE change IN ('new', 'changed')")}, n AS (SELECT collection_id, count(*) AS n_blocks FROM ided GROUP BY 1
      ), c AS (
        SELECT collection_id, count(*) FILTER (change IN ('new', 'changed')) AS processed_files, count(*) FILTER (change IN ('unchanged', 'skipped')) AS skipped_files,
          count(*) FILTER (change = 'deleted') AS deleted_files, count(*) FILTER (change <> 'deleted') AS n_files FROM change GROUP BY collection_id
      )
      SELECT collection_id, 'r1' AS run_id, processed_files, skipped_files, deleted_files, true AS performed, true AS triggered, coalesce(n_blocks, 0) AS indexed_blocks, true AS indexing_complete, 64 AS vector_dim,
        CASE WHEN collection_id < 'ws-8' THEN '{K.RUN_REASONS["applied"]}' ELSE '{K.RUN_REASONS["adopted_applied"]}' END AS reason FROM c LEFT JOIN n USING (collection_id)
      UNION ALL SELECT collection_id, 'r2', 0, n_files, 0, false, false, 0, true, 64, '{K.RUN_REASONS["fresh"]}' FROM c""",
    "points_sink": f"""WITH {FILES_SQL.strip()} SELECT collection_id, doc_id::varchar AS point_id, CASE WHEN collection_id < 'ws-8' THEN 'new' ELSE 'old' END AS state FROM files
      WHERE collection_id >= 'ws-8' OR doc_id % 2 = 0""",
    "manifest_versions": f"WITH {MANIFEST_SQL.strip()} SELECT collection_id, file_path, file_hash FROM prev_manifest WHERE file_path NOT LIKE '%.old'",
    "run_markers": f"""WITH {FILES_SQL.strip()}, c AS (SELECT DISTINCT collection_id, substr(collection_id, -1) < '8' AS done FROM files)
      SELECT collection_id, 'r1' AS run_id, true AS indexing_complete, epoch_ms(TIMESTAMP '2024-01-01') AS started_ms, epoch_ms(TIMESTAMP '2024-01-01') AS completed_ms, 64 AS vector_dim FROM c
      UNION ALL SELECT collection_id, 'r2', done, epoch_ms(CASE WHEN done THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-02' END), CASE WHEN done THEN epoch_ms(TIMESTAMP '2024-01-03') END, 64 FROM c""",
    # Values written out once more, for the models that the query asks for.
    "model_profiles": f"""WITH a AS (
        SELECT doc_id, {listed(PROVIDERS)}[doc_id % {len(PROVIDERS)} + 1] AS provider, {listed(MODELS)}[(doc_id // {len(PROVIDERS)}) % {len(MODELS)} + 1] AS model,
          CASE WHEN doc_id % 7 = 0 THEN 100 END AS dimension, CASE WHEN doc_id % 5 = 1 THEN 0.25::double END AS min_score FROM documents
      ), k AS (
        SELECT *, CASE provider || '/' || model WHEN 'openai/text-embedding-3-small' THEN 1536 WHEN 'openai-compatible/text-embedding-3-small' THEN 1536 WHEN 'ollama/nomic-embed-code' THEN 3584
            WHEN 'openai-compatible/nomic-embed-code' THEN 3584 WHEN 'gemini/gemini-embedding-001' THEN 3072 WHEN 'mistral/codestral-embed-2505' THEN 1536 WHEN 'ollama/all-minilm' THEN 384
            WHEN 'bedrock/amazon.titan-embed-text-v2:0' THEN 1024 WHEN 'openrouter/qwen/qwen3-embedding-4b' THEN 2560 WHEN 'vercel-ai-gateway/google/text-embedding-005' THEN 768 END AS d,
          model = 'nomic-embed-code' AND provider IN ('ollama', 'openai-compatible') AS code FROM a
      ) SELECT doc_id, provider, model, coalesce(dimension, d) AS dimension, coalesce(min_score, CASE WHEN code THEN 0.15::double END, 0.4::double) AS min_score,
        CASE WHEN code THEN 'Represent this query for searching relevant code: ' END AS query_prefix FROM k""",
    "query_prefixes": f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{K.CODE_PREFIX}' ELSE '' END || coalesce(text, '') AS text FROM documents),
      b AS (SELECT doc_id, CASE WHEN starts_with(text, '{K.CODE_PREFIX}') OR {TOKENS.format("'" + K.CODE_PREFIX + "' || text")} > {K.MAX_ITEM_TOKENS} THEN text ELSE '{K.CODE_PREFIX}' || text END AS text FROM a)
      SELECT doc_id, sha256(text) AS text_hash, {TOKENS.format("text")} AS tokens FROM b""",
    "decoded_vectors": "SELECT vec_id, i - 1 AS dim, embedding[i] AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "dimension_check": "SELECT label, coalesce(bool_or(vec_id % 11 = 0 AND label > 5), false) AS needs_rebuild FROM embeddings GROUP BY label",
    "external_links": f"WITH {FILES_SQL.strip()} SELECT collection_id, file_path, file_path AS logical_path FROM files WHERE doc_id % 6 > 1",
    "cosine_pairs": """WITH v AS (SELECT vec_id, embedding::double[] AS v, vec_id % 9 = 0 AS none FROM embeddings)
      SELECT a.vec_id, CASE WHEN NOT a.none AND NOT b.none THEN round(list_cosine_similarity(a.v, b.v), 6) END AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "newest_requests": f"""WITH {TRIGGERS.strip()}, {FIRED.strip()} SELECT worktree, arg_max(reason, fire_ms) AS reason, max(fire_ms) AS fire_ms FROM fired GROUP BY worktree""",
    "search_reasons": f"""WITH RECURSIVE {DIFF.strip()}, {TODO}, {SUMMARY.strip()}, pts AS (
        SELECT collection_id, row_number() OVER (ORDER BY collection_id) <> 3 AS ready, bool_or(doc_id = 0) AS waiting FROM files GROUP BY collection_id
      ) SELECT collection_id, 'disabled' AS mode, false AS performed, false AS triggered, CASE WHEN ready THEN '{K.SEARCH_REASONS["ready"]}' ELSE '{K.SEARCH_REASONS["missing"]}' END AS reason FROM pts
      UNION ALL SELECT collection_id, 'background', false, true, CASE WHEN waiting THEN '{K.SEARCH_REASONS["scheduled"]}' ELSE '{K.SEARCH_REASONS["idle"]}' END FROM pts
      UNION ALL SELECT collection_id, 'query', performed, triggered, reason FROM summary""",
    "tree_descent": f"""WITH {FILES_SQL.strip()}, n AS (
        SELECT collection_id, file_path, string_split(content, chr(10)) AS l, content FROM files
      ), g AS (
        SELECT collection_id, file_path, l, a, l[a + 1:a + 4] AS part FROM (SELECT *, unnest(range(0, len(l), 4)) AS a FROM n WHERE length(content) > {K.MAX_PACK_CHARS})
      ), s AS (
        SELECT collection_id, file_path, i, l[i + 1] AS line FROM (SELECT *, unnest(range(a, a + len(part))) AS i FROM g WHERE length(array_to_string(part, chr(10))) > {K.MAX_PACK_CHARS})
      ), b AS (
        SELECT collection_id, file_path, 1 AS start_line, len(l) AS end_line, NULL::bigint AS piece_offset, content FROM n WHERE length(content) BETWEEN {K.MIN_BLOCK_CHARS} AND {K.MAX_PACK_CHARS}
        UNION ALL SELECT collection_id, file_path, a + 1, a + len(part), NULL, array_to_string(part, chr(10)) FROM g WHERE length(array_to_string(part, chr(10))) BETWEEN {K.MIN_BLOCK_CHARS} AND {K.MAX_PACK_CHARS}
        UNION ALL SELECT collection_id, file_path, i + 1, i + 1, NULL, line FROM s WHERE length(line) BETWEEN {K.MIN_BLOCK_CHARS} AND {K.MAX_PACK_CHARS}
        UNION ALL SELECT collection_id, file_path, i + 1, i + 1, o, substr(line, o + 1, 1000) FROM (SELECT *, unnest(range(0, length(line), 1000)) AS o FROM s WHERE length(line) > {K.MAX_PACK_CHARS})
      ) SELECT DISTINCT collection_id, file_path, start_line, end_line, piece_offset, sha256(content) AS content_hash FROM b""",
    "code_node_chunks": f"""WITH {FILES_SQL.strip()}, n AS (
        SELECT collection_id, file_path, doc_id, list_transform(string_split(content, chr(10)), lambda x: '  ' || trim(regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g'), ' ') || ';') AS l FROM files
      ), g AS (
        SELECT *, doc_id % 3 = 0 AND i = 1 AS broken, l[i * 3 + 1:i * 3 + 3] AS part, i * 5 - (doc_id % 3 = 0 AND i > 1)::int AS row FROM (SELECT *, unnest(range(0, (len(l) - 1) // 3 + 1)) AS i FROM n)
      ), f AS (
        SELECT *, 'function f' || i || '() {{' || chr(10) || array_to_string(part, chr(10)) || CASE WHEN broken THEN '' ELSE chr(10) || '}}' END AS whole FROM g
      ), s AS (
        SELECT collection_id, file_path, row + j AS line, ltrim(part[j], ' ') AS t FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM f WHERE length(whole) > {K.MAX_PACK_CHARS})
      ), b AS (
        SELECT collection_id, file_path, row + 1 AS start_line, row + len(part) + 2 - broken::int AS end_line, NULL::bigint AS piece_offset, whole AS content FROM f WHERE length(whole) BETWEEN {K.MIN_BLOCK_CHARS} AND {K.MAX_PACK_CHARS}
        UNION ALL SELECT collection_id, file_path, line + 1, line + 1, NULL, t FROM s WHERE length(t) BETWEEN {K.MIN_BLOCK_CHARS} AND {K.MAX_PACK_CHARS}
        UNION ALL SELECT collection_id, file_path, line + 1, line + 1, o, substr(t, o + 1, {K.MAX_BLOCK_CHARS}) FROM (SELECT *, unnest(range(0, length(t), {K.MAX_BLOCK_CHARS})) AS o FROM s WHERE length(t) > {K.MAX_PACK_CHARS})
      ) SELECT DISTINCT collection_id, file_path, start_line, end_line, piece_offset, sha256(content) AS content_hash FROM b""",
    "chunk_lines_sql": f"WITH RECURSIVE {FILES_SQL.strip()}, {packed('files').strip()} SELECT collection_id, file_path, start_line, end_line, piece_offset, length(content) AS n_chars FROM blocks",
    "token_batches": f"""WITH RECURSIVE i AS (
        SELECT source || '/' || (doc_id // 1000) AS batch_key, doc_id AS seq, {TOKENS.format("coalesce(text, '')")} AS tokens FROM documents
      ), r AS (SELECT *, row_number() OVER (PARTITION BY batch_key ORDER BY seq) AS no FROM i),
      f AS (
        SELECT batch_key, seq, tokens, no, CASE WHEN tokens > 4000 THEN 0 ELSE tokens END AS held, 0::bigint AS b, tokens > 4000 AS big FROM r WHERE no = 1
        UNION ALL
        SELECT r.batch_key, r.seq, r.tokens, r.no, CASE WHEN r.tokens > 4000 THEN f.held WHEN f.held > 0 AND f.held + r.tokens > 10000 THEN r.tokens ELSE f.held + r.tokens END,
          CASE WHEN r.tokens <= 4000 AND f.held > 0 AND f.held + r.tokens > 10000 THEN f.b + 1 ELSE f.b END, r.tokens > 4000
        FROM f JOIN r ON r.batch_key = f.batch_key AND r.no = f.no + 1
      ) SELECT batch_key, seq, tokens, CASE WHEN NOT big THEN b END AS batch_no FROM f""",
    "token_usage": f"SELECT source || '/' || (doc_id // 1000) AS batch_key, sum({TOKENS.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})::bigint AS prompt_tokens, count(*) AS n_items FROM documents GROUP BY ALL",
    "embed_batches": f"""WITH {FILES_SQL.strip()}, l AS (SELECT collection_id, file_path, string_split(content, chr(10)) AS l FROM files),
      x AS (SELECT collection_id, file_path, i - 1 AS start_line, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l))
      SELECT collection_id, file_path, start_line, (row_number() OVER (PARTITION BY collection_id, file_path ORDER BY start_line) - 1) // {K.BATCH_BLOCKS} AS batch_no FROM x WHERE regexp_matches(line, '\\S')""",
    "hash_embeddings": f"WITH {embedded('e', 'documents', 'doc_id', 'text').strip()} SELECT id AS doc_id, dim, round(v::double, 5) AS value FROM e",
    "vector_table": f"""WITH t AS (
        SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS a, regexp_replace(regexp_replace(CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END, '^\\s+', ''), '\\s+$', '') AS b FROM documents
      ), u AS (SELECT CASE WHEN a <> '' AND {TOKENS.format("a")} <= {K.MAX_ITEM_TOKENS} THEN a END AS a, CASE WHEN b <> '' AND {TOKENS.format("b")} <= {K.MAX_ITEM_TOKENS} THEN b END AS b FROM t)
      SELECT 1 AS run, count(*) AS n_rows, count(a) AS n_vectors, count(DISTINCT a) AS n_sent FROM u
      UNION ALL SELECT 2, count(*), count(b), (SELECT count(DISTINCT b) FROM u WHERE b NOT IN (SELECT a FROM u WHERE a IS NOT NULL)) FROM u""",
    "cosine_topk": f"""WITH {QUERY_SET.strip()}, s AS (SELECT query_id, k, vec_id::varchar AS point_id, round(list_cosine_similarity(embedding::double[], qv), 6) AS score FROM q, embeddings)
      SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank, FROM s WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) <= k""",
    "scoped_topk": f"WITH {SCOPED.strip()} SELECT query_id, point_id, score, rank FROM top",
    "rerank": f"WITH {RANKED.strip()} SELECT query_id, point_id, file_path, score, rank, weighted AS weighted_score, final_rank FROM ranked",
    "response_json": f"""WITH {RANKED.strip()} SELECT query_id, count(*) AS n_results, arg_min(file_path, final_rank) AS first_path, arg_min(score, final_rank) AS first_score FROM ranked GROUP BY query_id""",
    "search_end_to_end": f"""WITH RECURSIVE {FILES_SQL.strip()}, {packed("files").strip()}, pts AS (
        SELECT {uuid5("segment_hash")} AS point_id, file_path, start_line, end_line, content FROM blocks WHERE regexp_matches(content, '\\S')
      ), {embedded("e", "pts", "point_id", "content").strip()}, qt AS (
        SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'readme ' || text ELSE text END AS query FROM benchmark
      ), {embedded("b", "qt", "item_id", "query").strip()}, en AS (SELECT id, sqrt(sum(v::double * v::double)) AS n FROM e GROUP BY id), bn AS (SELECT id, sqrt(sum(v::double * v::double)) AS n FROM b GROUP BY id),
      s AS (SELECT b.id AS query_id, e.id AS point_id, round(sum(b.v::double * e.v::double) / any_value(bn.n * en.n), 6) AS score FROM b JOIN e USING (dim) JOIN en ON en.id = e.id JOIN bn ON bn.id = b.id GROUP BY ALL),
      top AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) <= 20),
      weighed AS (SELECT top.*, file_path, start_line, end_line, {WEIGHTED} AS weighted FROM top JOIN pts USING (point_id) JOIN qt ON item_id = query_id)
      SELECT query_id, point_id, file_path, start_line, end_line, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, score DESC, rank) AS final_rank FROM weighed""",
    "upsert_points": f"""WITH {DIFF.strip()}, d AS (SELECT c.collection_id, c.file_path, 'p-' || doc_id AS point_id, change, doc_id % 11 <> 0 AS was FROM change c JOIN files f ON f.collection_id = c.collection_id AND f.file_path = c.file_path)
      SELECT collection_id, file_path, point_id, CASE WHEN change IN ('new', 'changed') THEN 'new' ELSE 'old' END AS state FROM d WHERE change IN ('new', 'changed') OR was""",
    "manifest_round_trip": f"WITH {MANIFEST_SQL.strip()} SELECT collection_id, file_path, file_hash FROM prev_manifest",
    "watch_deltas": f"""WITH {SNAPSHOTS.strip()} SELECT key, "at"::varchar AS "at", points, cache_entries, indexing_complete, coalesce(points - lag(points) OVER o, 0) AS points_delta,
      coalesce(cache_entries - lag(cache_entries) OVER o, 0) AS cache_delta, coalesce(indexing_complete <> lag(indexing_complete) OVER o, false) AS completion_changed FROM snap WINDOW o AS (PARTITION BY key ORDER BY "at")""",
    "watch_totals": f"""WITH {SNAPSHOTS.strip()} SELECT key, count(*) AS n_snapshots, arg_max(points, "at") - arg_min(points, "at") AS points_delta, arg_max(cache_entries, "at") - arg_min(cache_entries, "at") AS cache_delta,
      arg_max(indexing_complete, "at") <> arg_min(indexing_complete, "at") AS completion_changed FROM snap GROUP BY key""",
    "debounce_triggers": f"WITH {TRIGGERS.strip()}, {FIRED.strip()} SELECT worktree, reason, fire_ms FROM fired UNION ALL SELECT worktree, 'urgent-followup', fire_ms FROM fired WHERE urgent",
    "session_triggers": f"""WITH {TRIGGERS.strip()}, m AS (SELECT *, coalesce(max(due) OVER (PARTITION BY worktree ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM due),
      b AS (SELECT *, sum((ms > before)::int) OVER (PARTITION BY worktree ORDER BY ms, event_id) AS s FROM m)
      SELECT worktree, min(ms) AS start_ms, max(due) AS fire_ms, count(*) AS n_events, bool_or(urgent) AS urgent FROM b GROUP BY worktree, s""",
    "trigger_rate": f"WITH {TRIGGERS.strip()} SELECT worktree, (ms // 86400000) * 86400000 AS start_ms, count(*) AS n_events FROM trig GROUP BY ALL",
}
SQL["bounded_topk"] = SQL["cosine_topk"]
SQL["ann_recall"] = f"SELECT count(*) AS n_exact, true AS nine_in_ten FROM ({SQL['cosine_topk']})"
