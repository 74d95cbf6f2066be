"""DuckDB SQL with the rows of the queries, written apart from them."""

from __future__ import annotations


# Values are written out here, not taken from the library, so that a wrong one there shows.
_PATH = """concat('/vault/', source, CASE doc_id % 11 WHEN 3 THEN '/trash/' WHEN 5 THEN '/.trash-1000/' WHEN 8 THEN '/album-b/' ELSE '/' END,
 CASE doc_id % 13 WHEN 1 THEN 'copy of ' WHEN 2 THEN 'thumb_' ELSE '' END, 'doc_', CAST(doc_id AS VARCHAR),
 CASE doc_id % 7 WHEN 1 THEN ' - Copy' WHEN 2 THEN '_edited' WHEN 4 THEN '_copy' ELSE '' END,
 CASE doc_id % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.txt' WHEN 4 THEN '.gif' WHEN 5 THEN '.heic' WHEN 6 THEN '' WHEN 7 THEN '.ts' WHEN 8 THEN '.mov' ELSE '.pdf' END)"""
_NESTED = "concat('/vault/', source, CASE doc_id % 17 WHEN 4 THEN '/node_modules' WHEN 9 THEN '/.git/objects' WHEN 12 THEN '/venv2' ELSE '' END, '/doc_', CAST(doc_id AS VARCHAR), '.jpg')"
_NAME = "list_extract(string_split({p}, '/'), -1)"
_EXCLUDED = "list_has_any(string_split(substr(path, 8), '/'), ['.git', '.svn', 'node_modules', '__pycache__', '.cache', '_duplicate_quarantine', '_dedupe_reports', '_logs', '_zips', '.vscode', '.idea', '$RECYCLE.BIN', 'System Volume Information', '.venv', 'venv'])"
_PHOTO = "('jpg', 'jpeg', 'png', 'webp', 'bmp', 'tiff', 'tif', 'heic', 'heif', 'psd')"
_VIDEO = "('mp4', 'mkv', 'avi', 'mov', 'webm', 'flv', 'wmv', 'm4v', 'ts', 'mp')"
_MIME = """CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'webp', 'gif', 'bmp') THEN 'image/' || ext WHEN ext = 'svg' THEN 'image/svg+xml' WHEN ext IN ('mp4', 'webm') THEN 'video/' || ext
WHEN ext = 'mov' THEN 'video/quicktime' WHEN ext = 'mkv' THEN 'video/x-matroska' WHEN ext = 'pdf' THEN 'application/pdf' WHEN ext = 'csv' THEN 'text/csv' WHEN ext = 'sh' THEN 'application/x-sh' ELSE 'application/octet-stream' END"""
_SCORE = """CAST(100 - CASE WHEN regexp_matches(lower(replace(path, chr(92), '/')), '/trash/|/[.]trash|/recycle|[$]recycle[.]bin') THEN 500 ELSE 0 END
- CASE WHEN regexp_matches(lower(fname), ' - copy|-copy|_copy|[(]copy[)]| copy[.]| copy |^copy |^copy_|^copy of ') THEN 25 ELSE 0 END
- CASE WHEN contains(lower(fname), 'thumb') THEN 50 ELSE 0 END - CASE WHEN contains(lower(fname), 'edited') THEN 10 ELSE 0 END AS BIGINT)"""

FILES = f"""f0 AS (SELECT doc_id, text AS content, {_PATH} AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, 1700000000 + doc_id * 60 AS modified_epoch FROM documents),
f1 AS (SELECT *, {_NAME.format(p="path")} AS fname, lower(regexp_extract({_NAME.format(p="path")}, '^.+\\.([^.]*)$', 1)) AS ext FROM f0 WHERE size_bytes > 0),
f AS (SELECT *, (ext IN {_PHOTO} OR ext IN {_VIDEO}) AS is_media,
  CASE WHEN ext IN {_VIDEO} THEN 'VIDEO' WHEN ext IN {_PHOTO} THEN 'PHOTO' ELSE 'FILE' END AS category FROM f1)"""


def _members(source: str, by: str) -> str:
    """Ranked and numbered members of clusters, from groupings rather than windows where there is a choice."""
    key = f"{by}, " if by else ""
    using = f"({key}size_bytes, digest)"
    part = f"PARTITION BY {by} " if by else ""
    return f"""{source},
h AS (SELECT *, sha256(content) AS digest FROM s),
k AS (SELECT {key}size_bytes, digest, count(*) AS n_members FROM h GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT h.*, n_members, {_SCORE} AS score FROM h JOIN k USING {using}),
g AS (SELECT {key}size_bytes, digest, row_number() OVER ({part}ORDER BY size_bytes DESC, digest) AS group_id FROM k),
r AS (SELECT m.*, group_id, row_number() OVER (PARTITION BY {key}size_bytes, digest ORDER BY score DESC, string_split(path, '/')) AS rank FROM m JOIN g USING {using}),
rec AS (SELECT *, CASE WHEN rank = 1 THEN 'KEEP' ELSE 'DUPLICATE' END AS action, CAST(size_bytes AS DOUBLE) / 1048576 AS size_mb FROM r)"""


ONE = f"WITH {FILES}, " + _members("s AS (SELECT * FROM f)", "")
ALL = f"WITH {FILES}, " + _members("s AS (SELECT f.*, CAST(k AS BIGINT) AS run_no, 'run_' || CAST(k AS VARCHAR) AS run_id FROM f, (SELECT unnest([1, 2, 3]) AS k) ks WHERE doc_id % 4 <= k)", "run_id, run_no") + """,
cl AS (SELECT run_no * 1099511627776 + group_id AS id, run_id, group_id AS cluster_id, 'EXACT_HASH' AS match_type, category, 1.0::DOUBLE AS similarity_score FROM rec WHERE rank = 1),
it AS (SELECT run_no * 1099511627776 + row_number() OVER (PARTITION BY run_no ORDER BY group_id, rank) AS id, run_no * 1099511627776 + group_id AS cluster_id, path, action, size_bytes FROM rec),
ru AS (SELECT s.run_id, count(*) AS total_files FROM s GROUP BY 1),
rr AS (SELECT ru.run_id, total_files, coalesce(g, 0) AS duplicate_groups, CAST(coalesce(w, 0) AS BIGINT) AS wasted_bytes, 'completed' AS status FROM ru LEFT JOIN
  (SELECT run_id, count(*) FILTER (rank = 1) AS g, sum(size_bytes) FILTER (rank > 1) AS w FROM rec GROUP BY 1) x USING (run_id)),
del AS (SELECT path FROM f WHERE doc_id % 3 = 0),
it2 AS (SELECT * FROM it WHERE path NOT IN (SELECT path FROM del)),
spent AS (SELECT id FROM cl WHERE id NOT IN (SELECT cluster_id FROM it2 WHERE action = 'DUPLICATE'))"""
_QUICK = "md5(encode(content)[1:4096])"
INDEX = f"""WITH {FILES}, ix AS (SELECT CASE WHEN doc_id % 19 = 0 THEN path || '.old' ELSE path END AS path, size_bytes, CASE WHEN doc_id % 7 = 0 THEN modified_epoch - 10 ELSE modified_epoch END AS modified_epoch,
  {_QUICK} AS quick_hash, category, 'run_1' AS last_seen_run FROM f WHERE doc_id % 5 <> 0),
dl AS (SELECT coalesce(f.path, ix.path) AS path, CASE WHEN f.path IS NULL THEN 'gone' WHEN ix.path IS NULL THEN 'new' WHEN f.size_bytes = ix.size_bytes AND f.modified_epoch = ix.modified_epoch THEN 'unchanged' ELSE 'changed' END AS state
  FROM f FULL JOIN ix ON f.path = ix.path)"""
EVENTS = """WITH ev AS (SELECT event_id, ts AS event_ts, user_id, CASE WHEN event_type = 'view' THEN 'access' ELSE 'modify' END AS kind,
  CASE WHEN event_id % 25 = 3 THEN NULL WHEN event_id % 10 = 0 THEN '/vault/store/tidemark.db-wal' WHEN event_id % 10 = 1 THEN '/vault/.git/obj_' ELSE '/vault/f' END AS path FROM events)"""
_DOC_PATHS = f"WITH d AS (SELECT {_NESTED} AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents)"
_DIFFERS = "list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: CASE WHEN (x.embedding[i] > 0) <> (y.embedding[i] > 0) THEN 1 ELSE 0 END))"
_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, CAST({_DIFFERS} AS INTEGER) AS distance FROM embeddings x, embeddings y WHERE x.vec_id < y.vec_id AND {_DIFFERS} <= 19"
WATCHED = """WITH s AS (SELECT source, min(doc_id) AS d FROM documents GROUP BY 1),
now AS (SELECT d + 1 AS id, '/vault/' || source AS path, true AS recursive, d % 2 = 0 AS enabled FROM s WHERE d % 3 <> 0),
want AS (SELECT '/vault/' || source AS path, d % 5 = 0 AS recursive FROM s WHERE d % 4 <> 1)"""
_ROUND = "floor({x} * {n} + 0.5) / {n}"

ORACLE_SQL: dict[str, str] = {
    "scan_classified": f"WITH {FILES} SELECT path, size_bytes, modified_epoch, is_media, category FROM f",
    "scan_stats": f"WITH {FILES} SELECT count(*) AS total_files, count(*) FILTER (is_media) AS media_files FROM f",
    "scan_catalog": f"{_DOC_PATHS} SELECT path, size_bytes FROM d WHERE NOT {_EXCLUDED} AND size_bytes > 0",
    "excluded_paths": f"{_DOC_PATHS} SELECT path FROM d WHERE {_EXCLUDED}",
    "mime_type": f"WITH {FILES} SELECT path, {_MIME} AS mime FROM f",
    "media_candidates": f"WITH {FILES} SELECT path, category FROM f WHERE is_media",
    "content_digest": f"WITH {FILES} SELECT path, sha256(content) AS digest FROM f",
    "quick_hash_head": f"WITH {FILES} SELECT path, {_QUICK} AS quick_hash FROM f",
    "similarity_label": """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 1.0::DOUBLE ELSE (vec_id % 200) / 200.0::DOUBLE END AS s FROM embeddings)
SELECT vec_id, CASE WHEN abs(s - 1) < 1e-4 THEN '100%' ELSE CAST(CAST(round_even(s * 100, 0) AS INTEGER) AS VARCHAR) || '%' END AS label FROM s""",
    "progress_pct": """SELECT event_id, CAST(trunc(CASE WHEN event_id % 3 <> 0 THEN least(100.0, event_id::DOUBLE * 100 / 5000) WHEN event_id > 0 THEN least(85.0, log10(event_id::DOUBLE) * 18) ELSE 0 END) AS INTEGER) AS pct FROM events""",
    "drive_roots": """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/mnt/' || source WHEN 2 THEN '/Volumes/' || source ELSE '/mnt/' || source || '/x' END AS path FROM documents)
SELECT doc_id, path, doc_id % 4 <> 3 AS is_root FROM d""",
    "size_round_trip": f"WITH {FILES} SELECT path, size_bytes AS bytes, {_ROUND.format(x='(size_bytes::DOUBLE / 1048576)', n='100.0::DOUBLE')} AS mb FROM f",
    "browse_directories": f"""WITH {FILES}, p AS (SELECT string_split(substr(path, 8), '/') AS p FROM f) SELECT p[1] AS name, max(len(p) > 2) AS has_children FROM p
WHERE len(p) > 1 AND p[1] NOT LIKE '.%' GROUP BY 1 ORDER BY lower(p[1]), 1 LIMIT 300""",
    "manifest_explode": f"{ONE} SELECT group_id, action, category, path FROM rec",
    "size_collisions": f"WITH {FILES} SELECT path, size_bytes, n_same_size FROM f JOIN (SELECT size_bytes, count(*) AS n_same_size FROM f GROUP BY 1 HAVING count(*) >= 2) c USING (size_bytes)",
    "exact_clusters": f"{ONE} SELECT size_bytes, digest, n_members, min(path) AS first_path FROM m GROUP BY ALL",
    "funnel_clusters": f"{ONE} SELECT size_bytes, digest, n_members, min(path) AS first_path FROM m GROUP BY ALL",
    "keeper_scores": f"WITH {FILES} SELECT path, {_SCORE} AS score FROM f",
    "keeper_choice": f"{ONE} SELECT path, digest, score, CAST(rank AS INTEGER) AS rank, action FROM rec",
    "duplicate_records": f"{ONE} SELECT group_id, 'EXACT_HASH' AS match_type, action, category, '100%' AS similarity, 1.0::DOUBLE AS similarity_score, size_mb, path, CAST(NULL AS VARCHAR) AS dimensions FROM rec",
    "pipeline_records": f"{ONE} SELECT group_id, 'EXACT_HASH' AS match_type, action, path FROM rec",
    "tier2_candidates": f"{ONE} SELECT path, category FROM f WHERE is_media AND path NOT IN (SELECT path FROM m)",
    "vision_clusters": "SELECT CAST(1 AS BIGINT) AS group_id, '' AS match_type, '' AS path WHERE false",
    "category_breakdown": f"{ONE} SELECT category, count(*) AS n FROM rec WHERE rank > 1 GROUP BY 1",
    "scan_summary": f"""{ONE}, w AS (SELECT count(*) FILTER (rank = 1) AS g, CAST(coalesce(sum(size_bytes) FILTER (rank > 1), 0) AS BIGINT) AS wasted_bytes FROM rec)
SELECT (SELECT count(*) FROM f) AS total_files, (SELECT count(*) FROM f WHERE is_media) AS media_files, g AS exact_duplicate_groups, CAST(0 AS BIGINT) AS visual_ai_groups, CAST(0 AS BIGINT) AS content_duplicate_groups,
g AS total_duplicate_groups, wasted_bytes, {_ROUND.format(x='(wasted_bytes::DOUBLE / 1048576)', n='100.0::DOUBLE')} AS wasted_mb, {_ROUND.format(x='(wasted_bytes::DOUBLE / 1048576 / 1024)', n='1000.0::DOUBLE')} AS wasted_gb FROM w""",
    "summary_json": f"""{ONE} SELECT '{{"total_files":' || (SELECT count(*) FROM f) || ',"media_files":' || (SELECT count(*) FROM f WHERE is_media) || ',"exact_duplicate_groups":' || count(*) FILTER (rank = 1) || ',"wasted_bytes":' ||
coalesce(sum(size_bytes) FILTER (rank > 1), 0) || ',"csv_report":"","quarantine_script":""}}' AS json FROM rec""",
    "table_sorted": f"{ONE} SELECT row_number() OVER (ORDER BY size_bytes DESC, lower(fname), path) AS place, path, size_bytes, action FROM rec",
    "groups_ordered": f"""{ONE} SELECT group_id, count(*) AS n_members, '["' || string_agg(path, '","' ORDER BY rank > 1, path) || '"]' AS paths FROM rec GROUP BY 1""",
    "newest_keeper": f"{ONE} SELECT group_id, path, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY modified_epoch DESC, string_split(path, '/')) = 1 THEN 'KEEP' ELSE 'DUPLICATE' END AS action FROM rec",
    "progress_text": f"""WITH {FILES} SELECT path, regexp_replace(CAST(size_bytes AS VARCHAR) || '000', '^(\\d{{1,3}}?)((?:\\d{{3}})+)$', '\\1') || regexp_replace(regexp_replace(CAST(size_bytes AS VARCHAR) || '000', '^(\\d{{1,3}}?)((?:\\d{{3}})+)$', '\\2'), '(\\d{{3}})', ',\\1', 'g') AS bytes,
CASE WHEN length(path) <= 24 THEN path ELSE path[1:21] || '...' END AS short,
CASE WHEN size_bytes >= 2000 THEN printf('%.1f', size_bytes / 2000.0::DOUBLE) || 'k/s' ELSE CAST(CAST(round_even(size_bytes / 2.0, 0) AS BIGINT) AS VARCHAR) || '/s' END AS rate,
lpad(CAST(size_bytes // 600 AS VARCHAR), CAST(greatest(2, length(CAST(size_bytes // 600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(size_bytes // 10 % 60 AS VARCHAR), 2, '0') AS clock FROM f""",
    "saved_clusters": f"{ALL} SELECT * FROM cl",
    "saved_items": f"{ALL} SELECT * FROM it",
    "run_history_top": f"{ALL} SELECT run_id, total_files, duplicate_groups, wasted_bytes, status FROM rr ORDER BY run_id DESC LIMIT 2",
    "latest_run": f"{ALL} SELECT run_id, total_files, duplicate_groups, wasted_bytes FROM rr ORDER BY run_id DESC LIMIT 1",
    "clusters_with_items": f"""{ALL} SELECT cl.id, run_id, cl.cluster_id, category, CAST(count(*) AS INTEGER) AS n_items, '["' || string_agg(path, '","' ORDER BY it.id) || '"]' AS paths FROM cl JOIN it ON it.cluster_id = cl.id GROUP BY ALL""",
    "cluster_page": f"{ALL} SELECT id, cluster_id, category FROM cl WHERE run_id = 'run_3' ORDER BY id LIMIT 10 OFFSET 5",
    "cluster_page_by_category": f"{ALL} SELECT id, cluster_id, category FROM cl WHERE run_id = 'run_3' AND category = 'PHOTO' ORDER BY id LIMIT 10",
    "cluster_count": f"{ALL} SELECT run_id, category, count(*) AS n FROM cl GROUP BY ALL",
    "groups_by_match_type": f"{ALL} SELECT run_id, match_type, count(*) AS n_groups FROM cl GROUP BY ALL",
    "distinct_duplicate_paths": f"{ALL} SELECT DISTINCT path FROM it WHERE action = 'DUPLICATE'",
    "keeper_override": f"{ALL} SELECT id, path, CASE WHEN cluster_id <> 3298534883329 THEN action WHEN id = 3298534883330 THEN 'KEEP' ELSE 'DUPLICATE' END AS action FROM it",
    "runs_upsert": f"{ALL} SELECT run_id, total_files, CASE run_id WHEN 'run_2' THEN 'repeated' ELSE status END AS status FROM rr UNION ALL SELECT 'run_4', total_files, status FROM rr WHERE run_id = 'run_2'",
    "items_added": f"""{ALL} SELECT id, cluster_id, path, size_bytes FROM it UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM it) + row_number() OVER (ORDER BY path), 1099511627777, path, size_bytes FROM f WHERE is_media""",
    "items_after_delete": f"{ALL} SELECT id, path, action FROM it2",
    "freed_space": f"{ALL} SELECT count(*) FILTER (action = 'DUPLICATE') AS removed, CAST(coalesce(sum(size_bytes) FILTER (action = 'DUPLICATE'), 0) AS BIGINT) AS freed_bytes FROM it WHERE path IN (SELECT path FROM del)",
    "exhausted_clusters": f"{ALL} SELECT cl.id, run_id FROM cl LEFT JOIN it2 ON it2.cluster_id = cl.id AND it2.action = 'DUPLICATE' GROUP BY ALL HAVING count(it2.id) = 0",
    "recomputed_runs": f"""{ALL} SELECT run_id, (SELECT count(DISTINCT cl.id) FROM cl WHERE cl.run_id = rr.run_id) AS duplicate_groups,
CAST((SELECT coalesce(sum(size_bytes), 0) FROM cl JOIN it2 ON it2.cluster_id = cl.id WHERE cl.run_id = rr.run_id AND it2.action = 'DUPLICATE') AS BIGINT) AS wasted_bytes FROM rr""",
    "delete_cascade": f"""{ALL}, c2 AS (SELECT * FROM cl WHERE id NOT IN (SELECT id FROM spent)), i3 AS (SELECT it2.*, run_id FROM it2 JOIN c2 ON c2.id = it2.cluster_id)
SELECT run_id, (SELECT count(*) FROM c2 WHERE c2.run_id = rr.run_id) AS duplicate_groups, CAST((SELECT coalesce(sum(size_bytes), 0) FROM i3 WHERE i3.run_id = rr.run_id AND action = 'DUPLICATE') AS BIGINT) AS wasted_bytes,
(SELECT count(*) FROM i3 WHERE i3.run_id = rr.run_id) AS n_items FROM rr""",
    "prune_missing": f"{ALL} SELECT DISTINCT path FROM it WHERE action = 'DUPLICATE' AND path NOT IN (SELECT path FROM f WHERE doc_id % 6 <> 0)",
    "prune_cascade": f"""{ALL}, gone AS (SELECT path FROM f WHERE doc_id % 6 = 0 AND path IN (SELECT path FROM it WHERE action = 'DUPLICATE')), i4 AS (SELECT * FROM it WHERE path NOT IN (SELECT path FROM gone)),
c4 AS (SELECT cl.* FROM cl WHERE EXISTS (SELECT 1 FROM i4 WHERE i4.cluster_id = cl.id AND action = 'DUPLICATE'))
SELECT run_id, (SELECT count(*) FROM c4 WHERE c4.run_id = rr.run_id) AS duplicate_groups,
CAST((SELECT coalesce(sum(size_bytes), 0) FROM i4 JOIN c4 ON c4.id = i4.cluster_id WHERE c4.run_id = rr.run_id AND action = 'DUPLICATE') AS BIGINT) AS wasted_bytes FROM rr""",
    "prune_counts": f"""{ALL} SELECT count(*) FILTER (action = 'DUPLICATE') AS removed, CAST(coalesce(sum(size_bytes) FILTER (action = 'DUPLICATE'), 0) AS BIGINT) AS freed_bytes FROM it
WHERE path IN (SELECT path FROM f WHERE doc_id % 6 = 0) AND path IN (SELECT path FROM it WHERE action = 'DUPLICATE')""",
    "file_index_forget": f"{INDEX} SELECT path, last_seen_run FROM ix WHERE path NOT IN (SELECT path FROM f WHERE doc_id = 1)",
    "file_index_lookup": f"{INDEX} SELECT path, size_bytes, modified_epoch, quick_hash, category, last_seen_run FROM ix WHERE path IN (SELECT path FROM f WHERE doc_id = 1)",
    "watched_toggle": f"{WATCHED} SELECT id, path, recursive, enabled AND id <> (SELECT min(id) FROM now) AS enabled FROM now",
    "watched_remove": f"{WATCHED} SELECT id, path, recursive, enabled FROM now WHERE id <> (SELECT min(id) FROM now)",
    "watched_touch": f"{WATCHED} SELECT id, path, enabled, enabled AS scanned FROM now ORDER BY id",
    "cascade_delete_run": f"{ALL} SELECT run_id, count(*) AS n_clusters, any_value(total_files) AS total_files FROM cl JOIN rr USING (run_id) WHERE run_id <> 'run_2' GROUP BY 1",
    "index_after_run_delete": f"{INDEX} SELECT CAST(NULL AS VARCHAR) AS last_seen_run, count(*) AS n FROM ix",
    "reloaded_summary": f"""{ALL} SELECT run_id, category, CAST(count(it.id) AS BIGINT) AS n_duplicates, total_files, duplicate_groups, wasted_bytes::DOUBLE / 1048576 AS wasted_mb
FROM cl LEFT JOIN it ON it.cluster_id = cl.id AND it.action = 'DUPLICATE' JOIN rr USING (run_id) GROUP BY ALL""",
    "delta_changed_files": f"{INDEX} SELECT path, state FROM dl WHERE state IN ('changed', 'new')",
    "delta_unchanged_files": f"{INDEX} SELECT path FROM dl WHERE state = 'unchanged'",
    "delta_states": f"{INDEX} SELECT state, count(*) AS n FROM dl GROUP BY 1",
    "file_index_upsert": f"""{INDEX}, nw AS (SELECT path, size_bytes, modified_epoch, {_QUICK} AS quick_hash, category, 'run_2' AS last_seen_run FROM f WHERE doc_id % 2 = 0)
SELECT * FROM ix WHERE path NOT IN (SELECT path FROM nw) UNION ALL SELECT * FROM nw""",
    "file_index_after_run": f"{INDEX} SELECT path, f.modified_epoch, CASE WHEN state = 'unchanged' THEN 'run_1' ELSE 'run_2' END AS last_seen_run FROM f JOIN dl USING (path)",
    "watch_sync_plan": f"{WATCHED} SELECT path, 'add' AS op FROM want WHERE path NOT IN (SELECT path FROM now) UNION ALL SELECT path, 'remove' AS op FROM now WHERE path NOT IN (SELECT path FROM want)",
    "watched_paths_upsert": f"""{WATCHED} SELECT id, path, coalesce(want.recursive, now.recursive) AS recursive, enabled OR want.path IS NOT NULL AS enabled FROM now LEFT JOIN want USING (path)
UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM now) + row_number() OVER (ORDER BY path) AS id, path, recursive, true AS enabled FROM want WHERE path NOT IN (SELECT path FROM now)""",
    "csv_report": f"""{ONE} SELECT group_id || ',ExactHash,' || CASE action WHEN 'KEEP' THEN 'Keep' ELSE 'Duplicate' END || ',' || upper(category[1]) || lower(category[2:]) || ',100%,' || printf('%.2f', size_mb) || ',"' || replace(path, '"', '""') || '",""' AS line FROM rec""",
    "delete_script": f"""{ONE} SELECT 'mv "' || replace(path, '"', chr(92) || '"') || '" "$TRASH_DIR/"' AS line FROM rec WHERE rank > 1""",
    "keeper_map": f"{ONE} SELECT a.path, b.path AS keeper FROM rec a JOIN rec b ON a.group_id = b.group_id AND b.rank = 1 WHERE a.rank > 1",
    "clean_targets": f"{ONE} SELECT path, size_bytes AS bytes FROM rec WHERE rank > 1",
    "clean_batches": f"{ONE} SELECT path, CAST((row_number() OVER (ORDER BY group_id, rank) - 1) // 10 AS BIGINT) AS batch_no FROM rec WHERE rank > 1",
    "delete_plan_trash": f"""{ONE}, p AS (SELECT *, row_number() OVER (PARTITION BY fname ORDER BY path) AS k2 FROM rec WHERE rank > 1 AND doc_id % 3 = 0)
SELECT 'trash' AS op, path AS src, '/vault/.tidemark_trash/' || CASE WHEN k2 = 1 THEN fname ELSE regexp_extract(fname, '^(.+?)(\\.[^.]*)?$', 1) || '_' || (k2 - 1) || regexp_extract(fname, '^(.+?)(\\.[^.]*)?$', 2) END AS dst, size_bytes FROM p""",
    "delete_plan_permanent": f"{ONE} SELECT 'permanent' AS op, path AS src, CAST(NULL AS VARCHAR) AS dst, size_bytes FROM rec WHERE rank > 1 AND doc_id % 3 = 0",
    "delete_plan_hardlink": f"{ONE} SELECT 'hardlink' AS op, a.path AS src, b.path AS dst, a.size_bytes FROM rec a JOIN rec b ON a.group_id = b.group_id AND b.rank = 1 WHERE a.rank > 1 AND a.doc_id % 3 = 0",
    "quarantine_dry_run": f"{ONE} SELECT count(*) AS total_files_moved, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes_moved, true AS dry_run FROM rec WHERE rank > 1",
    "trash_status": f"""WITH {FILES}, t AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, size_bytes FROM f)
SELECT count(*) AS items_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, count(DISTINCT dir) AS trash_dirs FROM t WHERE dir LIKE '%/trash' OR dir LIKE '%/.trash-1000'""",
    "smart_clean_tracks": f"{ONE} SELECT 'exact' AS track, count(*) AS files, count(DISTINCT group_id) AS groups, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM rec WHERE rank > 1 HAVING count(*) > 0",
    "relevant_events": f"{EVENTS} SELECT event_id, kind FROM ev WHERE kind <> 'access' AND (path IS NULL OR path = '/vault/f')",
    "events_outside_pause": f"{EVENTS}, pz AS (SELECT event_ts AS a, event_ts + INTERVAL 60 SECOND AS b FROM ev WHERE event_id % 50 = 0) SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM pz WHERE event_ts >= a AND event_ts < b)",
    "sweeps_due": f"""{EVENTS}, pz AS (SELECT event_ts AS a, event_ts + INTERVAL 60 SECOND AS b FROM ev WHERE event_id % 50 = 0
UNION ALL SELECT event_ts, event_ts + INTERVAL 5 SECOND FROM ev WHERE kind <> 'access' AND (path IS NULL OR path = '/vault/f')),
tk AS (SELECT event_id, event_ts + INTERVAL 6 SECOND AS t FROM ev WHERE event_id % 10 = 7) SELECT event_id FROM tk WHERE NOT EXISTS (SELECT 1 FROM pz WHERE t >= a AND t < b)""",
    "debounce_sessions": f"""{EVENTS}, g AS (SELECT event_ts, CASE WHEN event_ts - lag(event_ts) OVER (ORDER BY event_ts) < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS new FROM ev),
n AS (SELECT event_ts, sum(new) OVER (ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(event_ts) AS first_ts, count(*) AS n_events FROM n GROUP BY k""",
    "debounce_by_user": f"""{EVENTS}, g AS (SELECT user_id, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ev)
SELECT user_id, CAST(sum(new) AS BIGINT) AS n_sessions FROM g GROUP BY 1""",
    "sweep_windows": f"{EVENTS} SELECT time_bucket(INTERVAL 1 HOUR, event_ts) + INTERVAL 1 HOUR AS sweep_ts, count(*) AS n_events FROM ev GROUP BY 1",
    "perceptual_bits": """SELECT vec_id AS id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS ones,
array_to_string(list_transform(range(64, 0, -1), lambda i: CASE WHEN coalesce(embedding[i], 0) > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings""",
    "hamming_pairs": _PAIRS,
    "cosine_pairs": "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id < y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4",
    "visual_clusters": f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
w(id, r) AS (SELECT u, u FROM e UNION SELECT e.v, w.r FROM w JOIN e ON e.u = w.id) SELECT id, min(r) AS label FROM w GROUP BY 1""",
}
ORACLE_SQL["sessions_by_gap"] = ORACLE_SQL["debounce_by_user"]
