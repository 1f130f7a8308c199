"""DuckDB statements for the queries of :mod:`taskfold.plans.catalog`, written on their own."""

from __future__ import annotations

from taskfold import fixed

AS_OF = 1711843200
LAMBDA = f"({fixed.LN_2} / {fixed.HALF_LIFE_SECONDS})"


def score(as_of: str | int, updated: str = "last_updated") -> str:
    return f"greatest(0.01::double, least(1.0::double, exp(-{LAMBDA}::double * ({as_of} - {updated})::double)))"


FEATURE = f"""
f0 AS (
  SELECT d.source AS project_id, concat('doc-', d.doc_id) AS id,
         concat(upper(d.lang), ' note ', d.doc_id) AS name, d.lang AS domain,
         string_split(concat_ws(',', d.source, CASE WHEN l.quality = 1 THEN 'HQ' END,
                                CASE WHEN l.toxic = 1 THEN 'Toxic' END), ',') AS tags,
         CASE d.doc_id % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Blocked' ELSE 'Complete' END AS status,
         d.text AS description,
         CASE WHEN l.doc_id IS NOT NULL THEN concat('quality ', l.quality) END AS context,
         string_split(concat('src/', d.lang, '/f', d.doc_id % 50, '.rs,lib/', d.source, '/g', d.doc_id % 7, '.py'), ',')
           AS files_involved,
         (1704067200 + (d.doc_id * 7919) % 7776000 - 86400 * (d.doc_id % 30))::bigint AS created_at,
         (1704067200 + (d.doc_id * 7919) % 7776000)::bigint AS last_updated,
         0::bigint AS ord_batch, d.doc_id AS ord_pos
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT *, {score(AS_OF)} AS recency_score FROM f0)
"""

RAW_LOG = """
u AS (
  SELECT (user_id % 10)::varchar AS project_id, day(ts)::bigint AS batch_seq,
         (1704067200 + day(ts) * 86400)::bigint AS batch_ts,
         CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS op_rank,
         event_id AS pos, concat('f-', user_id) AS id,
         CASE WHEN event_type <> 'view' THEN concat('Feature ', user_id, ' v', event_id % 10) END AS name,
         CASE WHEN event_type <> 'view' THEN event_type END AS domain,
         CASE WHEN event_type <> 'view' THEN concat('from ', event_type) END AS description,
         CASE event_type WHEN 'purchase' THEN 'Complete' WHEN 'click' THEN 'InProgress' WHEN 'error' THEN 'Blocked' END AS status,
         CASE WHEN event_id % 4 = 0 THEN string_split(concat(event_type, ',t', event_id % 6), ',')
              WHEN event_id % 31 = 0 THEN []::varchar[] END AS tags,
         CASE WHEN event_id % 3 = 0 THEN props END AS context,
         CASE WHEN event_id % 7 = 0 THEN [concat('src/f', user_id, '.rs')] END AS files_involved
  FROM events)
"""


def generations(source: str, order: str) -> str:
    """Number the generations of each item, and find the first named upsert of each."""
    return f"""
g AS (SELECT *, coalesce(sum(op_rank) OVER (PARTITION BY project_id, id ORDER BY {order}
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM {source}),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY {order}) AS seq FROM g),
o AS (SELECT *, min(CASE WHEN op_rank = 0 AND name IS NOT NULL THEN seq END)
                  OVER (PARTITION BY project_id, id, gen) AS opened FROM n),
c AS (SELECT * FROM o WHERE op_rank = 1 OR seq >= opened)
"""


def registry(as_of: str | int = AS_OF, rows: str = "c") -> str:
    """Fold the last generation of each item; fields by the last non-null value."""
    last = lambda n: f"arg_max({n}, seq) FILTER ({n} IS NOT NULL)"
    return f"""
t AS (SELECT *, max(gen) OVER (PARTITION BY project_id, id) AS last_gen,
             sum(op_rank) OVER (PARTITION BY project_id, id) AS n_removed FROM {rows}),
live AS (SELECT * FROM t WHERE op_rank = 0 AND gen = n_removed),
r AS (SELECT project_id, id, {last('name')} AS name, {last('domain')} AS domain, {last('description')} AS description,
             coalesce({last('status')}, 'Pending') AS status,
             coalesce({last('tags')}, []::varchar[]) AS tags, {last('context')} AS context,
             coalesce({last('files_involved')}, []::varchar[]) AS files_involved,
             arg_min(batch_ts, seq) AS created_at, arg_max(batch_ts, seq) AS last_updated,
             arg_min(batch_seq, seq) AS ord_batch, arg_min(pos, seq) AS ord_pos
      FROM live GROUP BY project_id, id)
SELECT project_id, id, name, domain, description, status, array_to_string(tags, ',') AS tags, context,
       array_to_string(files_involved, ',') AS files_involved, created_at, last_updated,
       round({score(as_of)}, 6) AS recency_score, ord_batch, ord_pos
FROM r"""


BY_DOCUMENT = "batch_seq, op_rank, pos"
CLEAN = RAW_LOG + "," + generations("u", BY_DOCUMENT)
SINGLE = (
    RAW_LOG
    + """, e AS (SELECT * REPLACE (pos AS batch_seq, 0::bigint AS pos, batch_ts + pos % 86400 AS batch_ts) FROM u),"""
    + generations("e", "batch_seq")
)

LISTING = """
p AS (
  SELECT DISTINCT (l_suppkey % 20)::varchar AS project_id,
    concat(CASE l_partkey % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'app' WHEN 3 THEN 'pkg'
                              WHEN 4 THEN 'docs' WHEN 5 THEN 'target' ELSE '.github' END, '/',
           CASE l_orderkey % 8 WHEN 0 THEN 'user_auth' WHEN 1 THEN 'api-routes' WHEN 2 THEN 'db'
                               WHEN 3 THEN 'UI_components' WHEN 4 THEN 'latest' WHEN 5 THEN '.cache'
                               WHEN 6 THEN 'bin' ELSE 'core' END, '/f', l_partkey,
           CASE l_linenumber WHEN 1 THEN '.rs' WHEN 2 THEN '.RS' WHEN 3 THEN '.tar.gz' WHEN 4 THEN ''
                             WHEN 5 THEN '.py' WHEN 6 THEN '.md' ELSE '.' END) AS path
  FROM lineitem),
""" + f"""
q AS (SELECT *, string_split(path, '/') AS parts,
             list_has_any(string_split(path, '/')[:-2], {list(fixed.SKIP_DIRS)}) AS skipped FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(parts[-1], '^.+\\.[^.]*$') THEN lower(regexp_extract(parts[-1], '\\.([^.]*)$', 1)) END
             AS ext FROM q WHERE NOT skipped),
sub AS (SELECT project_id, parts[1] AS source_root, parts[2] AS suggested_id, path FROM k
        WHERE parts[1] IN {fixed.SOURCE_ROOTS} AND len(parts) >= 3 AND NOT starts_with(parts[2], '.')),
big AS (SELECT project_id, source_root, suggested_id, count(*) AS n_files FROM sub GROUP BY ALL HAVING count(*) >= 2),
hist AS (SELECT project_id, ext, count(*) AS n_files FROM k WHERE ext IS NOT NULL GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n_files DESC, ext) AS rank FROM hist),
dirs AS (SELECT project_id, parts[1] AS directory, count(*) AS n FROM q
         WHERE len(parts) >= 2 AND NOT starts_with(parts[1], '.') AND NOT list_contains({list(fixed.SKIP_DIRS)}, parts[1])
         GROUP BY ALL)
"""

# Names of the five kinds of sub-directories in the listing, told by eye.
NAMED = """
  CASE suggested_id WHEN 'user_auth' THEN 'User Auth' WHEN 'api-routes' THEN 'Api Routes' WHEN 'db' THEN 'Db'
                    WHEN 'UI_components' THEN 'UI Components' WHEN 'latest' THEN 'Latest' ELSE 'Core' END AS suggested_name,
  CASE suggested_id WHEN 'user_auth' THEN 'security' WHEN 'api-routes' THEN 'api' WHEN 'db' THEN 'storage'
                    WHEN 'UI_components' THEN 'ui' WHEN 'latest' THEN 'testing' ELSE 'core' END AS suggested_domain
"""


def keyword(word: str) -> str:
    """The predicate for a lower-case SQL string."""
    fields = " OR ".join(
        f"contains(lower({c}), {word})" for c in ("id", "name", "domain", "description", "coalesce(context, '')")
    )
    return f"({fields} OR len([t for t in tags if contains(lower(t), {word})]) > 0)"


def tagged(tag: str) -> str:
    return f"list_contains([lower(t) for t in tags], {tag})"


def _features(select: str) -> str:
    return f"WITH {FEATURE} {select}"


def _found(where: str) -> str:
    return _features(f"SELECT project_id, id, name, ord_pos FROM f WHERE {where}")


def _listing(select: str) -> str:
    return f"WITH {LISTING} {select}"


STORED = """project_id, id, name, domain, description, status, array_to_string(tags, ',') AS tags, context,
  array_to_string(files_involved, ',') AS files_involved, created_at, last_updated,
  round(recency_score, 6) AS recency_score, ord_batch, ord_pos"""

MANY = f"""
, s AS (SELECT doc_id AS query_id,
       CASE WHEN doc_id % 3 <> 0 THEN concat('note ', doc_id) END AS kw,
       CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'fr' ELSE 'de' END END AS dom,
       CASE WHEN doc_id % 6 = 0 THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE 'hq' END END AS tag,
       CASE WHEN doc_id % 9 = 0 THEN 'blocked' WHEN doc_id % 11 = 0 THEN 'in progress' END AS st
  FROM labels)
SELECT query_id, project_id, id, ord_batch, ord_pos FROM f JOIN s
  ON (kw IS NULL OR {keyword('kw')}) AND (dom IS NULL OR lower(domain) = dom)
 AND (tag IS NULL OR {tagged('tag')}) AND (st IS NULL OR lower(status) = st)
"""

MISSING = "CASE WHEN name IS NULL THEN 'name' WHEN domain IS NULL THEN 'domain' WHEN description IS NULL THEN 'description' END"
OPENERS = f"""
b AS (SELECT *, lag(op_rank) OVER (PARTITION BY project_id, id ORDER BY {BY_DOCUMENT}) AS before FROM u),
bad AS (SELECT project_id, batch_seq, pos, id, {MISSING} AS field FROM b
        WHERE op_rank = 0 AND (before IS NULL OR before = 1) AND {MISSING} IS NOT NULL)
"""

# One project after the other, document by document, with the list of items alive.
WALK = f"""{RAW_LOG},
item AS (SELECT project_id, batch_seq, id, max(op_rank) = 1 AS dead,
           coalesce(arg_min({MISSING} IS NOT NULL, pos) FILTER (op_rank = 0), false) AS needy FROM u GROUP BY ALL),
doc AS (SELECT project_id, batch_seq, row_number() OVER (PARTITION BY project_id ORDER BY batch_seq) AS k,
          coalesce(list(id) FILTER (needy), []) AS needs, coalesce(list(id) FILTER (dead), []) AS ends,
          coalesce(list(id) FILTER (NOT dead), []) AS lives FROM item GROUP BY project_id, batch_seq),
walk AS (
  SELECT DISTINCT project_id, 0::bigint AS k, NULL::bigint AS batch_seq, []::varchar[] AS alive, true AS accepted FROM doc
  UNION ALL
  SELECT w.project_id, d.k, d.batch_seq,
         CASE WHEN list_has_all(w.alive, d.needs)
              THEN [x for x in list_distinct(list_concat(w.alive, d.lives)) if NOT list_contains(d.ends, x)]
              ELSE w.alive END,
         list_has_all(w.alive, d.needs)
  FROM walk w JOIN doc d ON d.project_id = w.project_id AND d.k = w.k + 1),
verdict AS (SELECT project_id, batch_seq, accepted FROM walk WHERE k > 0),
ok AS (SELECT u.* FROM u JOIN verdict USING (project_id, batch_seq) WHERE accepted)
"""

WORDS = r"words AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS word FROM documents)"


def statements() -> dict[str, str]:
    top = f"{score(AS_OF)}"
    s = {
        "top_keyword_in_domain": _features(
            f"SELECT project_id, id, name, status, round(recency_score, 6) AS recency_score FROM f "
            f"WHERE {keyword(chr(39) + 'eau' + chr(39))} AND lower(domain) = 'fr' "
            "ORDER BY recency_score DESC, project_id, ord_batch, ord_pos LIMIT 20"
        ).replace("ORDER BY recency_score", f"ORDER BY {top}"),
        "search_keyword": _found(keyword("'eau'")),
        "search_phrase": _found(keyword("'note 1'")),
        "search_domain": _found("lower(domain) = 'fr'"),
        "search_tag": _found(tagged("'hq'")),
        "search_status": _found("lower(status) = 'inprogress'"),
        "search_all_filters": _found(
            f"{keyword(chr(39) + 'quality' + chr(39))} AND lower(domain) = 'en' AND {tagged(chr(39) + 'hq' + chr(39))} "
            "AND lower(status) = 'pending'"
        ),
        "search_unknown_status": _features("SELECT count(*) AS n_matches FROM f WHERE lower(status) = 'in progress'"),
        "search_match_count": _features(
            f"SELECT count(*) AS n_matches FROM f WHERE {keyword(chr(39) + 'der' + chr(39))} AND status = 'Blocked'"
        ),
        "search_many_queries": f"WITH {FEATURE} {MANY}",
        "search_many_queries_by_gram": f"WITH {FEATURE} {MANY}",
        "search_results_as_json": _features(f"SELECT {STORED} FROM f WHERE {tagged(chr(39) + 'toxic' + chr(39))}"),
        "point_lookup": _found("project_id = 'src7' AND id = 'doc-7'"),
        "lookup_by_key_table": _found("ord_pos IN (SELECT doc_id FROM labels)"),
        "complete_items": _found("status = 'Complete'"),
        "recency_scores": _features("SELECT project_id, id, round(recency_score, 6) AS recency_score FROM f"),
        "recency_rescored": _features(
            f"SELECT project_id, id, round({score(AS_OF - 45 * 86400)}, 6) AS recency_score FROM f"
        ),
        "ranked_report": _features(
            """SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY recency_score DESC, ord_batch, ord_pos) AS rank,
               CASE WHEN length(id) <= 19 THEN id ELSE substr(id, 1, 17) || '..' END AS id,
               CASE WHEN length(domain) <= 13 THEN domain ELSE substr(domain, 1, 11) || '..' END AS domain,
               status, concat(round_even(recency_score * 100, 0)::int, '%') AS recency, name FROM f"""
        ),
        "top_by_recency": _features(
            "SELECT project_id, id, round(recency_score, 6) AS recency_score FROM (SELECT * FROM f "
            "ORDER BY recency_score DESC, project_id, ord_batch, ord_pos LIMIT 20)"
        ),
        "top_by_recency_per_project": _features(
            "SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY recency_score DESC, ord_batch, ord_pos)"
            " AS rank FROM f QUALIFY rank <= 5"
        ),
        "completion_summary": _features(
            """, pr AS (SELECT DISTINCT project_id FROM f UNION ALL SELECT concat('region-', r_regionkey) FROM region)
            SELECT project_id, count(*) FILTER (status = 'Complete') AS n_complete, count(id) AS n_total,
                   concat(count(*) FILTER (status = 'Complete'), '/', count(id)) AS label
            FROM pr LEFT JOIN f USING (project_id) GROUP BY project_id"""
        ),
        "feature_counts": _features("SELECT project_id, count(*) AS n_features FROM f GROUP BY project_id"),
        "parse_and_flatten_documents": f"""WITH {RAW_LOG}
            SELECT project_id, pos AS batch_seq, batch_ts, op_rank::bigint AS op_rank, 0::bigint AS pos, id,
                   CASE WHEN op_rank = 0 THEN name END AS name, CASE WHEN op_rank = 0 THEN domain END AS domain,
                   CASE WHEN op_rank = 0 THEN description END AS description,
                   CASE WHEN op_rank = 0 THEN status END AS status,
                   CASE WHEN op_rank = 0 THEN array_to_string(tags, ',') END AS tags,
                   CASE WHEN op_rank = 0 THEN context END AS context,
                   CASE WHEN op_rank = 0 THEN array_to_string(files_involved, ',') END AS files_involved FROM u
            UNION ALL
            SELECT project_id, pos, batch_ts, 0, 1, id || '-copy', name, NULL, NULL, NULL, array_to_string(tags, ','), NULL, NULL
            FROM u WHERE op_rank = 0""",
        "document_errors": """SELECT event_id, CASE event_id % 16 WHEN 0 THEN 'blank input' WHEN 1 THEN 'malformed document'
            WHEN 2 THEN 'null list' WHEN 3 THEN 'change without id' WHEN 5 THEN 'unknown status' WHEN 6 THEN 'null list'
            WHEN 7 THEN 'malformed document' WHEN 9 THEN 'wrong type' WHEN 10 THEN 'wrong type' WHEN 11 THEN 'malformed document'
            WHEN 12 THEN 'wrong type' WHEN 13 THEN 'change without id' WHEN 14 THEN 'malformed document' WHEN 15 THEN 'wrong type'
            END AS error FROM events""",
        "stream_rejects": """WITH t AS (SELECT event_id, CASE event_id % 16 WHEN 0 THEN '  ' WHEN 1 THEN '{"features": [' WHEN 2 THEN '{"features": null}'
              WHEN 3 THEN concat('{"features": [{"name": "x', user_id, '"}]}')
              WHEN 5 THEN concat('{"features": [{"id": "f-', user_id, '", "status": "complete"}]}')
              WHEN 6 THEN '{"remove_features": null}' WHEN 7 THEN '[1]' WHEN 9 THEN concat('{"features": [{"id": ', user_id, '}]}')
              WHEN 10 THEN concat('{"features": [{"id": "f-', user_id, '", "tags": "t', user_id, '"}]}')
              WHEN 11 THEN concat('{"features": [{"id": "f-', user_id, '"}]} ', user_id)
              WHEN 12 THEN concat('{"features": {"id": "f-', user_id, '"}}')
              WHEN 13 THEN concat('{"remove_features": ["f-', user_id, '", null]}')
              WHEN 14 THEN concat('{"features": [], "features": [{"id": "f-', user_id, '"}]}')
              WHEN 15 THEN concat('{"features": [{"id": "f-', user_id, '", "files_involved": ["a", ', user_id, ']}]}') END AS json,
            CASE WHEN event_id % 16 = 0 THEN 'blank input' WHEN event_id % 16 IN (1, 7, 11, 14) THEN 'malformed document'
              WHEN event_id % 16 IN (2, 6) THEN 'null list' WHEN event_id % 16 IN (3, 13) THEN 'change without id'
              WHEN event_id % 16 = 5 THEN 'unknown status' ELSE 'wrong type' END AS error
            FROM events WHERE event_id % 16 NOT IN (4, 8)),
            s AS (SELECT error, CASE WHEN json LIKE '{"%' THEN concat('{"project_id": "p", "batch_seq": ', event_id, ', "batch_ts": 9, ', json[2:])
              ELSE json END AS json FROM t) SELECT json, error, count(*) AS n FROM s GROUP BY json, error""",
        "ingest_plain_documents": f"""SELECT 'inbox' AS project_id, concat('f-', user_id) AS id, concat('n', user_id) AS name,
            concat('e', max(event_id)) AS description, 't' AS tags, {AS_OF}::bigint AS created_at, 'Pending' AS status
            FROM events GROUP BY user_id""",
        "touch_items": _features(
            f"SELECT project_id, id, CASE WHEN status = 'Blocked' THEN {AS_OF}::bigint ELSE last_updated END AS last_updated FROM f"
        ),
        "search_in_stored_order": _features(
            "SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY ord_batch, ord_pos) AS position FROM f "
            f"WHERE {keyword(chr(39) + 'eau' + chr(39))}"
        ),
        "sorted_by_recency": _features(
            "SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY recency_score DESC, ord_batch, ord_pos) AS position FROM f"
        ),
        "suggestions_in_order": _listing(
            "SELECT project_id, source_root, suggested_id, row_number() OVER (PARTITION BY project_id "
            "ORDER BY suggested_id, list_position(['src', 'lib', 'app', 'pkg'], source_root)) AS position FROM big"
        ),
        "stored_listing": _listing("SELECT project_id, path FROM p"),
        "bad_status_documents": f"""WITH {RAW_LOG} SELECT DISTINCT project_id, batch_seq FROM u
            WHERE status IS NOT NULL AND pos % 17 = 0""",
        "invalid_creations": f"WITH {RAW_LOG}, {OPENERS} SELECT * FROM bad",
        "first_bad_documents": f"""WITH {RAW_LOG}, {OPENERS} SELECT * FROM bad
            QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY batch_seq, pos) = 1""",
        "fold_one_document": f"""WITH {RAW_LOG}, up AS (SELECT * FROM u)
            SELECT project_id, id, batch_seq, count(*) FILTER (op_rank = 0) AS n_patches, max(op_rank) = 1 AS removed,
              arg_max(name, pos) FILTER (op_rank = 0 AND name IS NOT NULL) AS name,
              arg_max(status, pos) FILTER (op_rank = 0 AND status IS NOT NULL) AS status,
              array_to_string(arg_max(tags, pos) FILTER (op_rank = 0 AND tags IS NOT NULL), ',') AS tags,
              arg_max(context, pos) FILTER (op_rank = 0 AND context IS NOT NULL) AS context,
              arg_max(domain, pos) FILTER (op_rank = 0 AND domain IS NOT NULL) AS domain,
              arg_max(description, pos) FILTER (op_rank = 0 AND description IS NOT NULL) AS description,
              array_to_string(arg_max(files_involved, pos) FILTER (op_rank = 0 AND files_involved IS NOT NULL), ',') AS files_involved
            FROM up GROUP BY project_id, id, batch_seq""",
        "replay_log": f"WITH {CLEAN}, {registry()}",
        "replay_log_split_keys": f"WITH {CLEAN}, {registry()}",
        "merge_into_registry": f"WITH {CLEAN}, {registry()}",
        "merge_with_project_clocks": f"""WITH {CLEAN}, clock AS (SELECT project_id, max(batch_ts) AS as_of FROM c GROUP BY 1), """
        + registry("(SELECT as_of FROM clock WHERE clock.project_id = r.project_id)"),
        "touched_projects": f"""WITH {RAW_LOG}
            SELECT DISTINCT source AS project_id, concat('Project ', source) AS project_name, 1704067200::bigint AS created_at,
                   {AS_OF}::bigint AS last_updated FROM documents
            UNION ALL SELECT concat('region-', r_regionkey), r_name, 1704067200, {AS_OF} FROM region
            UNION ALL SELECT project_id, '{fixed.DEFAULT_PROJECT_NAME}', 1704067200, max(batch_ts) FROM u GROUP BY project_id""",
        "remove_items": _found("ord_pos NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
        "append_items": _features(
            "SELECT project_id, id, CASE WHEN status = 'Complete' THEN 2 ELSE 1 END::bigint AS n_rows FROM f"
        ),
        "duplicate_items": _features("SELECT project_id, id, 2::bigint AS n_rows FROM f WHERE status = 'Complete'"),
        "mark_complete": _features(
            f"""SELECT project_id, id, CASE WHEN status = 'Blocked' THEN 'Complete' ELSE status END AS status,
            CASE WHEN status = 'Blocked' THEN {AS_OF}::bigint ELSE last_updated END AS last_updated FROM f"""
        ),
        "snapshot_round_trip": _features(f"SELECT {STORED} FROM f"),
        "state_documents": _features(
            """, pr AS (SELECT DISTINCT project_id, concat('Project ', project_id) AS project_name FROM f
                        UNION ALL SELECT concat('region-', r_regionkey), r_name FROM region),
            num AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord_batch, ord_pos) - 1 AS rn FROM f)
            SELECT project_id, coalesce(rn // 1000, 0)::bigint AS part, project_name, (rn % 1000)::bigint AS pos, id, name, status,
                   context, array_to_string(tags, ',') AS tags, created_at, round(recency_score, 6) AS recency_score,
                   domain, description, array_to_string(files_involved, ',') AS files_involved, last_updated
            FROM pr LEFT JOIN num USING (project_id)"""
        ),
        "item_json": _features(
            "SELECT project_id, 'id,name,domain,tags,status,description,context,files_involved,created_at,last_updated,recency_score' AS fields,"
            " context IS NULL AS null_context, id, name, domain, array_to_string(tags, ',') AS tags, status, description, context,"
            " array_to_string(files_involved, ',') AS files_involved, created_at, last_updated, round(recency_score, 6) AS recency_score FROM f"
        ),
        "counted_files": _listing("SELECT project_id, path FROM k"),
        "extension_histogram": _listing("SELECT * FROM hist"),
        "total_files": _listing("SELECT project_id, count(*) FILTER (NOT skipped) AS total_files FROM q GROUP BY project_id"),
        "top_directories": _listing("SELECT project_id, directory FROM dirs"),
        "suggested_features": _listing(
            f"SELECT project_id, source_root, suggested_id, {NAMED}, n_files FROM big"
        ),
        "suggestion_files": _listing("SELECT sub.* FROM sub JOIN big USING (project_id, source_root, suggested_id)"),
        "suggestion_counts": _listing("SELECT project_id, count(*) AS n_suggestions FROM big GROUP BY project_id"),
        "top_extensions": _listing("SELECT * FROM best WHERE rank <= 5"),
        "extension_summary": _listing(
            """SELECT project_id, coalesce(s, 'none detected') AS summary FROM (SELECT DISTINCT project_id FROM p)
            LEFT JOIN (SELECT project_id, string_agg(concat(ext, ' (', n_files, ')'), ', ' ORDER BY rank) AS s
                       FROM best WHERE rank <= 5 GROUP BY project_id) USING (project_id)"""
        ),
        "profile_counts": _listing(
            """SELECT project_id, 'total' AS kind, NULL AS name, NULL AS root, count(*) AS n FROM k GROUP BY ALL
            UNION ALL SELECT project_id, 'listed', NULL, NULL, count(*) FROM p GROUP BY ALL
            UNION ALL SELECT project_id, 'ext', ext, NULL, n_files FROM hist
            UNION ALL SELECT project_id, 'dir', directory, NULL, n FROM dirs
            UNION ALL SELECT project_id, 'sub', suggested_id, source_root, count(*) FROM sub GROUP BY ALL"""
        ),
        "discovery_reports": _listing(
            f""", placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY suggested_id,
                list_position(['src', 'lib', 'app', 'pkg'], source_root)) - 1 AS place FROM big)
            SELECT project_id, 0::bigint AS part, project_id AS root, total_files, place, suggested_id, {NAMED}, path,
                row_number() OVER (PARTITION BY project_id, place ORDER BY path) - 1 AS file_place
            FROM sub JOIN placed USING (project_id, source_root, suggested_id)
            JOIN (SELECT project_id, count(*) FILTER (NOT skipped) AS total_files FROM q GROUP BY project_id) USING (project_id)"""
        ),
        "discovery_report_headers": _listing(
            """SELECT project_id, ext AS name, n_files AS n FROM hist UNION ALL SELECT project_id, directory, NULL FROM dirs"""
        ),
        "page_extensions": r"""SELECT page_id, CASE WHEN regexp_matches(string_split(url, '/')[-1], '^.+\.[^.]*$')
            THEN lower(regexp_extract(url, '\.([^./]*)$', 1)) END AS ext FROM pages""",
        "name_functions": f"""WITH {WORDS}, w AS (SELECT DISTINCT translate(word, '.,', '_-') AS word FROM words WHERE word <> '')
            SELECT word,
              array_to_string([CASE x[1] WHEN 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:] for x in string_split_regex(word, '[_-]') if x <> ''], ' ') AS title,
              CASE WHEN length(word) <= 9 THEN word ELSE left(word, 7) || '..' END AS short,
              CASE WHEN length(word) <= 5 THEN word ELSE left(word, 3) || '..' END AS shorter
            FROM w""",
        "inferred_domains": f"""WITH {WORDS} SELECT word, CASE
            WHEN regexp_matches(lower(word), 'auth|login|session') THEN 'security'
            WHEN regexp_matches(lower(word), 'api|routes|endpoints') THEN 'api'
            WHEN regexp_matches(lower(word), 'db|storage|models|schema') THEN 'storage'
            WHEN regexp_matches(lower(word), 'ui|components|views|pages') THEN 'ui'
            WHEN regexp_matches(lower(word), 'test|spec') THEN 'testing' ELSE lower(word) END AS domain FROM words""",
        "percent_labels": f"""SELECT event_id,
            concat(round_even({score(AS_OF, f'({AS_OF} - event_id * 61)')} * 100, 0)::int, '%') AS label FROM events""",
        "relative_paths": _listing(
            "SELECT project_id, path, CASE WHEN project_id::int < 7 THEN path END AS relative FROM p"
        ),
        "file_postings": _features("SELECT DISTINCT project_id, unnest(files_involved) AS file, id FROM f"),
        "file_index": _features(
            """, x AS (SELECT DISTINCT project_id, unnest(files_involved) AS file, id FROM f),
            y AS (SELECT *, (row_number() OVER (PARTITION BY project_id, file ORDER BY id) - 1) // 1000 AS part FROM x)
            SELECT project_id, file, part::bigint AS part, string_agg(id, ',' ORDER BY id) AS ids FROM y GROUP BY ALL"""
        ),
        "facets": _features(
            """SELECT project_id, 'status' AS facet, status AS value, count(*) AS n_features FROM f GROUP BY ALL
            UNION ALL SELECT project_id, 'domain', domain, count(*) FROM f GROUP BY ALL
            UNION ALL SELECT project_id, 'tag', tag, count(*) FROM (SELECT project_id, unnest(list_distinct(tags)) AS tag FROM f)
            GROUP BY ALL"""
        ),
        "live_items": _found(f"last_updated >= {AS_OF} - 60 * 86400"),
        "archived_items": _found(f"last_updated < {AS_OF} - 60 * 86400"),
        "drop_stale_files": _features(
            """, have AS (SELECT DISTINCT project_id, unnest(files_involved) AS path FROM f WHERE context IS NOT NULL),
            m AS (SELECT project_id, id, unnest(files_involved) AS path, generate_subscripts(files_involved, 1) AS i FROM f),
            kept AS (SELECT project_id, id, string_agg(path, ',' ORDER BY i) AS s FROM m JOIN have USING (project_id, path) GROUP BY ALL)
            SELECT project_id, id, coalesce(s, '') AS files_involved FROM f LEFT JOIN kept USING (project_id, id)"""
        ),
        "distinct_files": _features("SELECT project_id, id, array_to_string(files_involved, ',') AS files_involved FROM f"),
        "shorten_descriptions": _features("SELECT project_id, id, left(description, 2048) AS description FROM f"),
        "limit_audit": _features(
            """, x AS (SELECT project_id, count(DISTINCT path) AS n_files, max(length(path)) AS max_path
                       FROM (SELECT project_id, unnest(files_involved) AS path FROM f) GROUP BY project_id),
            y AS (SELECT project_id, count(*) AS n_features, max(length(description)) AS max_description FROM f GROUP BY project_id)
            SELECT project_id, n_features, n_files, max_path, max_description,
                   n_features > 1000 OR n_files > 5000 OR max_path > 512 OR max_description > 2048 AS over_limit
            FROM y JOIN x USING (project_id)"""
        ),
        "attention_map": """SELECT (user_id % 10)::varchar AS project_id, concat('f-', user_id) AS feature_id,
            event_type AS target, count(*) AS n_visits FROM events GROUP BY ALL""",
        "facets_by_changes": f"""WITH q AS (WITH {CLEAN}, {registry()})
            SELECT project_id, 'status' AS facet, status AS value, count(*) AS n FROM q GROUP BY ALL
            UNION ALL SELECT project_id, 'domain', domain, count(*) FROM q GROUP BY ALL
            UNION ALL SELECT project_id, 'tag', tag, count(*) FROM (SELECT project_id, unnest(list_distinct(string_split(tags, ','))) AS tag
              FROM q WHERE tags <> '') GROUP BY ALL""",
        "completion_by_changes": f"""WITH q AS (WITH {CLEAN}, {registry()})
            SELECT project_id, count(*) FILTER (status = 'Complete') AS n_complete, count(*) AS n_total,
              concat(count(*) FILTER (status = 'Complete'), '/', count(*)) AS label, count(*) AS n_features FROM q GROUP BY project_id""",
        "postings_by_changes": _features(
            """SELECT DISTINCT project_id, unnest(CASE WHEN ord_pos % 3 = 1 THEN files_involved[1:1] ELSE files_involved END) AS file, id FROM f"""
        ),
        "nearest_many_in_subsets": """WITH e AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings),
            c AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(e.x, q.x) / (sqrt(list_inner_product(e.x, e.x)) * sqrt(list_inner_product(q.x, q.x))) AS s
                  FROM e AS q JOIN e ON q.vec_id % 100 = 0 AND (q.vec_id % 200 <> 0 OR e.label = q.label)),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM c)
            SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 10""",
        "nearest_in_subset": """WITH v AS (SELECT [(((i * 7) % 13 - 6) / 10)::double for i in range(64)] AS d),
            e AS (SELECT vec_id, embedding::double[] AS x, d FROM embeddings, v WHERE label = 1)
            SELECT vec_id, round(list_inner_product(x, d) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(d, d))), 6)
              AS similarity FROM e ORDER BY list_inner_product(x, d) / sqrt(list_inner_product(x, x)) DESC, vec_id LIMIT 10""",
    }
    s["lenient_replay"] = f"WITH RECURSIVE {WALK}, {generations('ok', BY_DOCUMENT)}, {registry()}"
    s["lenient_replay_in_rounds"] = f"WITH RECURSIVE {WALK} SELECT * FROM verdict"
    for name in ("lenient_replay_single_changes", "stream_merge", "stream_keyed_state"):
        s[name] = f"WITH {SINGLE}, {registry()}"
    return s
