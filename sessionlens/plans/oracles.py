"""The same questions in plain SQL, as an independent check of :mod:`sessionlens.plans.queries`."""

from __future__ import annotations

import re

MONTH = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * ({})"
NOW = "TIMESTAMP '2024-01-31 12:00:00'"
EMPTY = "''"

ORACLES: dict[str, str] = {}


# ---------------------------------------------------------------- expressions


def month(minutes: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({minutes} AS BIGINT)))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\pZ\p{{Cc}}]+', ' ', 'g'))"


def not_blank(x: str) -> str:
    return rf"regexp_matches({x}, '[^\pZ\s\x0b\x{{85}}]')"


def truncate(x: str, n: int = 80) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN rtrim(left({x}, {n})) || '…' ELSE {x} END)"


def truncate_words(x: str, n: int) -> str:
    back = f"instr(reverse(left({x}, {n})), ' ')"
    cut = f"(CASE WHEN {back} > 0 AND {n} - {back} > {n * 3 // 4} THEN {n} - {back} ELSE {n} END)"
    return f"(CASE WHEN length({x}) > {n} THEN rtrim(left({x}, {cut})) || '…' ELSE {x} END)"


def clean(x: str) -> str:
    for tag in ("ide_selection", "notice", "page_view"):
        x = f"regexp_replace({x}, '<{tag}>.*?</{tag}\\s*>', ' ', 'gs')"
    line = f"nullif({collapse(x)}, '')"
    return f"(CASE WHEN NOT starts_with({line}, '[Request interrupted') AND NOT starts_with({line}, 'Caveat: The messages below') THEN {line} END)"


def folder_display(x: str) -> str:
    text = rf"regexp_replace({x}, '^[\pZ\s]+|[\pZ\s]+$', '', 'g')"
    bare = rf"regexp_replace({text}, '[\\/]+$', '')"
    return f"nullif(CASE WHEN {bare} = '' THEN left({text}, 1) WHEN regexp_matches({bare}, '^\\pL:$') THEN {bare} || '\\' ELSE {bare} END, '')"


def folder_key(x: str) -> str:
    return f"upper(replace({x}, '/', '\\'))"


def base_name(x: str) -> str:
    last = rf"regexp_extract(regexp_replace({x}, '[\\/]+$', ''), '[\\/]([^\\/]+)$', 1)"
    return f"(CASE WHEN coalesce({x}, '') = '' THEN '(folder unknown)' WHEN {last} = '' THEN {x} ELSE {last} END)"


def count_noun(n: str, noun: str) -> str:
    return f"(CAST({n} AS VARCHAR) || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\pL\pN]+')"


def short_day(x: str) -> str:
    return f"strftime({x}, '%a, %b %-d')"


def day_label(day: str, today: str) -> str:
    label = short_day(day)
    return f"(CASE WHEN {day} = {today} THEN 'Today so far (' || {label} || ')' WHEN {day} = {today} - 1 THEN 'Yesterday (' || {label} || ')' ELSE {label} END)"


def clock(ts: str) -> str:
    return f"strftime({ts} - INTERVAL 3 HOUR, '%H:%M')"


def span(first: str, last: str) -> str:
    return f"(CASE WHEN {clock(first)} = {clock(last)} THEN {clock(first)} ELSE {clock(first)} || '–' || {clock(last)} END)"


def working_day(ts: str) -> str:
    return f"CAST({ts} - INTERVAL 7 HOUR AS DATE)"


def recency(last: str, now: str, weight: float = 0.6, decay: float = 30.0) -> str:
    days = f"(epoch_us({now}) - epoch_us({last})) / 86400000000.0"
    return f"(CASE WHEN {last} IS NULL THEN 1.0 ELSE 1.0 + {weight} * exp(-greatest(0.0, {days}) / {decay}) END)"


def kind_weight(kind: str) -> str:
    return f"(CASE {kind} WHEN 1 THEN 8.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 WHEN 4 THEN 1.5 WHEN 5 THEN 0.6 ELSE 1.0 END)"


# ---------------------------------------------------------------- shared table expressions

RECORDS = f"""
raw_records AS (
  SELECT CAST(conv_id // 40 AS VARCHAR) AS owner, conv_id, turn, CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS seq,
    CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'ai-title' WHEN role = 'assistant' AND turn = 5 THEN 'custom-title'
         WHEN role = 'user' AND turn = 6 THEN 'last-prompt' ELSE role END AS type,
    {month('(conv_id * 197) % 43200 + turn * 3')} AS ts,
    '/work/p' || (conv_id % 7) AS project,
    CASE conv_id % 4 WHEN 1 THEN 'HEAD' WHEN 2 THEN 'main' WHEN 3 THEN 'fix/' || (conv_id % 5) END AS branch,
    CASE WHEN role = 'user' AND turn % 5 = 4 THEN '[Request interrupted by user]'
         WHEN role = 'user' AND turn % 3 = 0 THEN '<ide_selection>line ' || turn || '</ide_selection>' || text ELSE text END AS spoken, text
  FROM conversations),
records AS (
  SELECT *, type IN ('custom-title', 'ai-title', 'last-prompt') AS is_title, type IN ('user', 'assistant') AS is_message,
    CASE WHEN type IN ('user', 'assistant') THEN CASE WHEN turn >= 4 THEN project || '/src' WHEN conv_id % 2 = 1 THEN upper(project) || '/' ELSE project END END AS cwd,
    CASE WHEN type IN ('user', 'assistant') THEN branch END AS git_branch,
    CASE WHEN type IN ('custom-title', 'ai-title', 'last-prompt') THEN text END AS title_text
  FROM raw_records)"""


def sessions_of(records: str = "records", name: str = "sessions", before: str = "") -> str:
    """Session rows of a records relation."""
    place = f"CASE WHEN root_cwd IS NOT NULL THEN {folder_display('root_cwd')} ELSE {folder_display('seen_cwd')} END"
    return f"""
{name}_state AS (
  SELECT owner, session_id,
    arg_min(cwd, seq) FILTER (type = 'user' AND turn <= 1) AS root_cwd, arg_min(cwd, seq) FILTER (cwd IS NOT NULL) AS seen_cwd,
    arg_min(CASE WHEN git_branch IS NULL THEN '' ELSE git_branch END, seq) FILTER (type = 'user' AND turn <= 1) AS root_branch,
    arg_min(CASE WHEN git_branch IS NULL THEN '' ELSE git_branch END, seq) FILTER (cwd IS NOT NULL) AS seen_branch,
    left(arg_max(title_text, seq) FILTER (type = 'custom-title'), 512) AS custom_title,
    left(arg_max(title_text, seq) FILTER (type = 'ai-title'), 512) AS ai_title,
    nullif(arg_max(title_text, seq) FILTER (type = 'last-prompt'), '') AS last_prompt,
    left(arg_min(spoken, seq) FILTER (type = 'user' AND {not_blank('spoken')}), 512) AS first_prompt,
    min(ts) AS first_activity, max(ts) AS last_activity, count(*) FILTER (is_message) AS message_count
  FROM {records} GROUP BY owner, session_id),
{name} AS (
  SELECT owner, session_id,
    {truncate(f"coalesce(nullif({collapse('custom_title')}, ''), nullif({collapse('ai_title')}, ''), nullif({collapse('first_prompt')}, ''), 'conversation ' || session_id)")} AS title,
    CAST(CASE WHEN nullif({collapse('custom_title')}, '') IS NOT NULL THEN 1 WHEN nullif({collapse('ai_title')}, '') IS NOT NULL THEN 2
      WHEN nullif({collapse('first_prompt')}, '') IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS title_source,
    custom_title, ai_title, first_prompt, {place} AS folder_display, {folder_key(place)} AS folder_key,
    CAST(CASE WHEN {place} IS NULL THEN 0 ELSE 1 END AS INTEGER) AS folder_source,
    coalesce(nullif(root_branch, ''), nullif(seen_branch, '')) AS git_branch, last_prompt, first_activity, last_activity, message_count,
    CAST(NULL AS VARCHAR) AS parse_error
  FROM {name}_state)"""


def chunks_of(records: str = "records", sessions: str = "sessions", name: str = "chunks") -> str:
    """Chunks of conversations; no conversation text is long enough to be split."""
    return f"""
{name}_derived AS (
  SELECT owner, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY kind) - 1 AS BIGINT) AS chunk_no, kind, ts, text FROM (
    SELECT owner, session_id, CAST(1 AS INTEGER) AS kind, last_activity AS ts, title AS text FROM {sessions}
    UNION ALL SELECT owner, session_id, 2, last_activity, folder_display || CASE WHEN {not_blank('git_branch')} THEN ' ' || git_branch ELSE '' END FROM {sessions} WHERE folder_display IS NOT NULL
    UNION ALL SELECT owner, session_id, 3, last_activity, last_prompt FROM {sessions} WHERE {not_blank('last_prompt')})),
{name}_said AS (
  SELECT owner, session_id, CAST(seq * 268435456 AS BIGINT) AS chunk_no, CAST(CASE type WHEN 'user' THEN 4 ELSE 5 END AS INTEGER) AS kind, ts, spoken AS text
  FROM {records} WHERE is_message AND {not_blank('spoken')}),
{name} AS (SELECT * FROM {name}_derived UNION ALL SELECT * FROM {name}_said)"""


BASE = f"WITH {RECORDS}, {sessions_of()}"
TABLES = f"{BASE}, {chunks_of()}"

WINDOW_TEXT = r"regexp_replace(substr(text, start + 4097, 4096), '[\t\n\r\f\x0b\x{A0}]', ' ', 'g')"
DOCUMENT_CHUNKS = rf"""
blocks AS (
  SELECT CAST(doc_id // 4 AS VARCHAR) AS session_id, doc_id % 4 + 1 AS seq, CAST(doc_id % 5 + 1 AS INTEGER) AS kind, {month('(doc_id * 37) % 43200')} AS ts, text FROM documents),
pieces(session_id, seq, kind, ts, text, n, start, stop) AS (
  SELECT session_id, seq, kind, ts, text, 0, 0, CAST(CASE WHEN length(text) <= 8192 THEN length(text) ELSE NULL END AS BIGINT) FROM blocks
  UNION ALL
  SELECT session_id, seq, kind, ts, text, n + 1, nextstart,
    CASE WHEN length(text) - nextstart <= 8192 THEN length(text) END
  FROM (SELECT *, start + CASE WHEN instr(reverse({WINDOW_TEXT}), ' ') > 0 THEN 8192 - instr(reverse({WINDOW_TEXT}), ' ') ELSE 8192 END AS nextstart
        FROM pieces WHERE stop IS NULL)),
cut AS (SELECT *, coalesce(stop, lead(start) OVER (PARTITION BY session_id, seq ORDER BY n)) AS finish FROM pieces),
said AS (SELECT session_id, seq, kind, ts, n, substr(text, start + 1, finish - start) AS text FROM cut),
chunks AS (
  SELECT session_id, CAST(seq * 268435456 + row_number() OVER (PARTITION BY session_id, seq ORDER BY n) - 1 AS BIGINT) AS chunk_no, kind, ts, text
  FROM said WHERE {not_blank('text')})"""

FORWARD = f"forward AS MATERIALIZED (SELECT session_id, chunk_no, kind, {tokens('text')} AS tokens FROM chunks)"
POSITIONS = """
positions AS MATERIALIZED (
  SELECT session_id, chunk_no, kind, CAST(len(tokens) AS INTEGER) AS n_tokens, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM forward)"""
BENCHMARK = r"""
searches AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 1 THEN regexp_replace(text, '^(\S+)\s+', '\1-') ELSE text END AS text FROM benchmark)"""
TERMS = rf"""
typed AS (SELECT query_id, unnest(regexp_split_to_array(text, '\s+')) AS word, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS i FROM searches),
folded AS (SELECT query_id, i, array_to_string({tokens('word')}, ' ') AS term FROM typed WHERE regexp_matches(word, '[\pL\p{{Nd}}]')),
firsts AS (SELECT query_id, term, min(i) AS i FROM folded GROUP BY query_id, term),
terms AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS term_no, term, CAST(count(*) OVER (PARTITION BY query_id) AS INTEGER) AS n_terms FROM firsts)"""
HITS = """
wanted AS (SELECT DISTINCT term, string_split(term, ' ') AS t FROM terms),
expanded AS MATERIALIZED (SELECT term, token FROM (SELECT DISTINCT token FROM positions) JOIN wanted ON len(t) = 1 AND starts_with(token, term)),
single AS (
  SELECT term, session_id, chunk_no, kind, n_tokens, CAST(count(*) AS BIGINT) AS tf
  FROM positions JOIN expanded USING (token) GROUP BY term, session_id, chunk_no, kind, n_tokens),
phrased AS (
  SELECT term, a.session_id, a.chunk_no, a.kind, a.n_tokens, CAST(count(*) AS BIGINT) AS tf
  FROM wanted JOIN positions a ON len(t) = 2 AND a.token = t[1]
  JOIN positions b ON b.session_id = a.session_id AND b.chunk_no = a.chunk_no AND b.pos = a.pos + 1 AND starts_with(b.token, t[2]) GROUP BY ALL),
hits AS MATERIALIZED (SELECT * FROM single UNION ALL SELECT * FROM phrased)"""
RELEVANCE = """
corpus AS (SELECT count(*) AS n_chunks, avg(len(tokens)) AS mean_length FROM forward),
frequency AS (SELECT term, greatest(ln((n_chunks - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hits, corpus GROUP BY term, n_chunks),
relevant AS (
  SELECT term, session_id, chunk_no, kind, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean_length)) AS relevance
  FROM hits JOIN frequency USING (term), corpus)"""
MATCHES = """
matches AS MATERIALIZED (SELECT * FROM terms JOIN relevant USING (term)),
qualified AS (SELECT query_id, session_id FROM matches GROUP BY query_id, session_id, n_terms HAVING count(DISTINCT term) = n_terms)"""


def scores(co: str = "2.0", repeat: str = "0.0", extra: str = "", source: str = "matches") -> str:
    return f"""
per_chunk AS (
  SELECT {extra} query_id, session_id, chunk_no, kind, count(*) AS terms, sum(relevance) AS total,
    arg_min(term, row(-round(relevance, 9), term_no)) AS best_term,
    round(sum(relevance) * {kind_weight('kind')} * (1 + {co} * (count(*) - 1)), 9) AS weighted
  FROM {source} SEMI JOIN qualified USING (query_id, session_id) GROUP BY {extra} query_id, session_id, chunk_no, kind),
per_session AS (
  SELECT {extra} query_id, session_id, round(max(weighted) + {repeat} * (sum(weighted) - max(weighted)), 9) AS lexical_score, count(*) AS match_count,
    array_to_string(list_sort(list(DISTINCT kind)), ',') AS matched_kinds,
    arg_max(chunk_no, row(weighted, -chunk_no)) AS chunk_no, arg_max(best_term, row(weighted, -chunk_no)) AS term
  FROM per_chunk GROUP BY {extra} query_id, session_id)"""


DOC_SESSIONS = f"""
doc_sessions AS (SELECT CAST(doc_id // 4 AS VARCHAR) AS session_id, min(source) AS title, max({month('(doc_id * 37) % 43200')}) AS last_activity,
  '/corpus/' || min(lang) AS folder_display, max(lang) AS git_branch, '/corpus/' || min(doc_id) || '.jsonl' AS file_path, count(*) AS message_count FROM documents GROUP BY 1)"""
RANKED = f"""
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, session_id) AS candidate FROM per_session) WHERE candidate <= 200),
boosted AS (SELECT *, {recency('last_activity', NOW)} AS recency, round(lexical_score * {recency('last_activity', NOW)}, 9) AS score FROM candidates JOIN doc_sessions USING (session_id)),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, last_activity DESC NULLS LAST, session_id) AS INTEGER) AS rank FROM boosted) WHERE rank <= 30)"""

DOCS = f"WITH RECURSIVE {DOCUMENT_CHUNKS}, {FORWARD}, {POSITIONS}"
SEARCH = f"{DOCS}, {BENCHMARK}, {TERMS}, {HITS}, {RELEVANCE}, {MATCHES}"

EVENT_CHUNKS = """
event_slots AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS slot, event_type || ' worth ' || printf('%.2f', value) || ' props ' || props AS said FROM events),
event_chunks AS (
  SELECT CAST(user_id AS VARCHAR) AS owner, user_id || '-' || slot AS session_id, event_id AS chunk_no,
    CAST(CASE event_type WHEN 'error' THEN 5 ELSE 4 END AS INTEGER) AS kind, date_trunc('second', ts) AS ts,
    CASE event_type WHEN 'signup' THEN '<notice>' || props || '</notice>' WHEN 'view' THEN '<page_view>' || props || '</page_view> look at' || chr(10) || said ELSE said END AS text
  FROM event_slots)"""


def messages_of(chunks: str) -> str:
    return f"""
flagged AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS starts FROM {chunks} WHERE kind IN (4, 5) WINDOW w AS (PARTITION BY owner, session_id, ts ORDER BY chunk_no)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY owner, session_id, ts ORDER BY chunk_no) AS run FROM flagged),
messages AS (
  SELECT owner, {working_day('ts')} AS day, session_id, ts, min(chunk_no) AS chunk_no, kind, string_agg(text, chr(10) ORDER BY chunk_no) AS text
  FROM runs GROUP BY owner, session_id, ts, run, kind),
cleaned AS (SELECT *, CASE WHEN kind = 4 THEN {clean('text')} END AS prompt FROM messages),
active AS (SELECT DISTINCT owner, day FROM cleaned WHERE prompt IS NOT NULL)"""


SESSION_DAYS = f"""
session_days AS (
  SELECT owner, day, session_id, count(prompt) AS prompt_count, min(ts) AS first_activity, max(ts) AS last_activity,
    min(ts) FILTER (kind = 4) AS first_prompt_at, max(ts) FILTER (kind = 4) AS last_prompt_at,
    nullif({truncate_words(collapse("arg_max(text, row(ts, chunk_no)) FILTER (kind = 5)"), 400)}, '') AS outcome, count(prompt) <= 2 AS is_quick
  FROM cleaned GROUP BY owner, day, session_id HAVING count(prompt) > 0)"""
KEY_PROMPTS = f"""
distinct_prompts AS (
  SELECT owner, day, session_id, arg_min(prompt, row(ts, chunk_no)) AS prompt, min(row(ts, chunk_no)) AS told_at
  FROM cleaned WHERE prompt IS NOT NULL GROUP BY owner, day, session_id, lower(prompt)),
longest AS (SELECT *, row_number() OVER (PARTITION BY owner, day, session_id ORDER BY length(prompt) DESC, told_at) AS n FROM distinct_prompts),
key_prompts AS (SELECT owner, day, session_id, list({truncate_words('prompt', 160)} ORDER BY told_at) AS key_prompts FROM longest WHERE n <= 3 GROUP BY owner, day, session_id)"""
EVENT_SESSIONS = f"""
event_sessions AS (
  SELECT owner, session_id, 'Session ' || session_id AS title,
    '/home/u' || owner || '/app' || (slot % 2) || CASE WHEN slot >= 2 THEN '/web' ELSE '' END AS folder_display,
    CASE slot WHEN 1 THEN 'HEAD' WHEN 2 THEN 'main' WHEN 3 THEN 'fix/web' END AS git_branch
  FROM (SELECT DISTINCT owner, session_id, CAST(string_split(session_id, '-')[-1] AS INTEGER) AS slot FROM event_chunks)),
repos AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS owner, '/home/u' || user_id || '/app0' AS root, 'dev' || user_id AS author FROM events),
commit_log AS (
  SELECT CAST(o_custkey AS VARCHAR) AS owner, '/home/u' || o_custkey || '/app0' AS repo_root,
    CASE WHEN o_orderstatus = 'P' THEN 'somebody else' ELSE 'Dev <dev' || o_custkey || '@example.org>' END AS author,
    left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS sha, 'Order ' || o_orderkey || ' ' || o_orderpriority AS subject, {month('(o_orderkey * 7) % 43200')} AS ts FROM orders)"""
CONVERSATION_REPOS = f"""
repos AS (SELECT DISTINCT CAST(conv_id // 40 AS VARCHAR) AS owner, '/work/p' || (conv_id % 7) AS root, 'owner' || (conv_id // 40) AS author FROM conversations WHERE conv_id % 7 <> 6),
commit_log AS (
  SELECT CAST(o_custkey // 500 AS VARCHAR) AS owner, '/work/p' || (o_orderkey % 7) AS repo_root,
    CASE WHEN o_orderstatus = 'P' THEN 'somebody else' ELSE 'Owner <owner' || (o_custkey // 500) || '@example.org>' END AS author,
    left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS sha, 'Order ' || o_orderkey || ' ' || o_orderpriority AS subject, {month('(o_orderkey * 7) % 43200')} AS ts FROM orders)"""
OWN = """
own AS (SELECT l.owner, l.repo_root, l.sha, l.subject, l.ts FROM commit_log l JOIN repos r ON r.owner = l.owner AND r.root = l.repo_root AND contains(l.author, r.author))"""


def recaps_of(sessions: str) -> str:
    """Recaps, projects and commits from ``cleaned``, ``repos``, ``own`` and a sessions relation."""
    return f"""
rooted AS (
  SELECT s.owner, s.session_id, s.title, CASE WHEN s.git_branch <> 'HEAD' THEN s.git_branch END AS branch,
    coalesce((SELECT arg_max(r.root, length(r.root)) FROM repos r WHERE r.owner = s.owner
       AND ({folder_key('s.folder_display')} = {folder_key('r.root')} OR starts_with({folder_key('s.folder_display')}, {folder_key('r.root')} || '\\'))), s.folder_display, '') AS path
  FROM {sessions} s),
recaps AS MATERIALIZED (
  SELECT d.*, k.key_prompts, p.title, p.branch, p.path, {folder_key('p.path')} AS project_key
  FROM session_days d JOIN key_prompts k USING (owner, day, session_id) JOIN rooted p USING (owner, session_id)),
commits AS MATERIALIZED (SELECT owner, {working_day('ts')} AS day, {folder_key('repo_root')} AS project_key, ts, sha, subject FROM own),
branch_order AS (SELECT owner, day, project_key, branch, min(row(first_activity, session_id)) AS o FROM recaps WHERE branch IS NOT NULL GROUP BY ALL),
branch_lists AS (SELECT owner, day, project_key, list(branch ORDER BY o) AS branches FROM branch_order GROUP BY ALL),
commit_counts AS (SELECT owner, day, project_key, count(*) AS commit_count FROM commits GROUP BY ALL),
totals AS (
  SELECT owner, day, project_key, arg_min(path, session_id) AS path, count(*) AS session_count, count(*) FILTER (is_quick) AS quick_count,
    CAST(sum(prompt_count) AS BIGINT) AS prompt_count, min(first_activity) AS first_activity, max(last_activity) AS last_activity, max(last_prompt_at) AS last_prompt_at
  FROM recaps GROUP BY ALL),
projects AS MATERIALIZED (
  SELECT t.*, {base_name('path')} AS name, coalesce(branches, []) AS branches, coalesce(commit_count, 0) AS commit_count,
    CAST(row_number() OVER (PARTITION BY owner, day ORDER BY prompt_count DESC, last_activity DESC, project_key) AS INTEGER) AS pos,
    CAST(row_number() OVER (PARTITION BY owner, day ORDER BY prompt_count DESC, last_prompt_at DESC, project_key) AS INTEGER) AS earlier_pos
  FROM totals t LEFT JOIN branch_lists USING (owner, day, project_key) LEFT JOIN commit_counts USING (owner, day, project_key))"""


FRAMES = """
frames AS MATERIALIZED (
  SELECT owner, focus, focus + 1 AS today, day, CAST(age AS INTEGER) AS age FROM (
    SELECT f.owner, f.day AS focus, d.day, row_number() OVER (PARTITION BY f.owner, f.day ORDER BY d.day DESC) - 1 AS age
    FROM active f JOIN active d ON d.owner = f.owner AND d.day <= f.day) WHERE age <= 4)"""
ROLLUP = """
entries AS (SELECT * FROM frames JOIN projects USING (owner, day)),
week_branches AS (
  SELECT owner, focus, project_key, list(branch ORDER BY o) AS branches FROM (
    SELECT owner, focus, project_key, branch, min(row(age, i)) AS o FROM (
      SELECT owner, focus, project_key, age, unnest(branches) AS branch, unnest(range(len(branches))) AS i FROM entries) GROUP BY ALL) GROUP BY ALL),
week_totals AS (
  SELECT owner, focus, today, project_key, arg_max(name, day) AS name, arg_max(path, day) AS path, max(day) AS last_day, count(*) AS active_days,
    CAST(sum(session_count) AS BIGINT) AS session_count, CAST(sum(quick_count) AS BIGINT) AS quick_count, CAST(sum(prompt_count) AS BIGINT) AS prompt_count, CAST(sum(commit_count) AS BIGINT) AS commit_count
  FROM entries GROUP BY ALL),
rollup_rows AS (
  SELECT t.*, coalesce(branches, []) AS branches, CAST(row_number() OVER (PARTITION BY owner, focus ORDER BY prompt_count DESC, last_day DESC, project_key) AS INTEGER) AS pos
  FROM week_totals t LEFT JOIN week_branches USING (owner, focus, project_key))"""
TITLES = """
early_titles AS (SELECT owner, day, project_key, list(title ORDER BY o) AS titles FROM (SELECT owner, day, project_key, title, min(row(first_prompt_at, session_id)) AS o FROM recaps WHERE NOT is_quick GROUP BY ALL) GROUP BY ALL),
focus_titles AS (SELECT owner, day, project_key, list(title ORDER BY o) AS titles FROM (SELECT owner, day, project_key, title, min(row(first_activity, session_id)) AS o FROM recaps WHERE NOT is_quick GROUP BY ALL) GROUP BY ALL)"""

EVENT_MESSAGES = f"WITH {EVENT_CHUNKS}, {messages_of('event_chunks')}"
EVENT_RECAPS = f"{EVENT_MESSAGES}, {SESSION_DAYS}, {KEY_PROMPTS}, {EVENT_SESSIONS}, {OWN}, {recaps_of('event_sessions')}"
CONVERSATION_RECAPS = f"{TABLES}, {messages_of('chunks_said')}, {SESSION_DAYS}, {KEY_PROMPTS}, {CONVERSATION_REPOS}, {OWN}, {recaps_of('sessions')}, {FRAMES}, {TITLES}"

# ---------------------------------------------------------------- sessions and chunks

ORACLES["recent_sessions"] = f"""{BASE}
SELECT session_id, title, folder_display, git_branch, last_activity, message_count FROM sessions ORDER BY last_activity DESC NULLS LAST, session_id LIMIT 30"""
ORACLES["sessions"] = f"""{BASE}
SELECT owner, session_id, title, title_source, folder_display, folder_key, folder_source, git_branch, last_prompt, first_activity, last_activity, message_count, parse_error FROM sessions"""
ORACLES["titles"] = f"{BASE} SELECT session_id, custom_title, ai_title, first_prompt, title, title_source FROM sessions"
ORACLES["record_filter"] = f"""WITH {RECORDS}
SELECT type, count(*) AS records, count(*) FILTER (type = 'user') AS prompts, count(*) FILTER (type = 'assistant') AS replies, count(cwd) AS with_folder, count(title_text) AS with_title FROM records GROUP BY type"""
ORACLES["record_types"] = "SELECT CASE WHEN turn IN (3, 7) THEN 'unknown' ELSE role END AS type, count(*) AS n FROM conversations GROUP BY 1"
ORACLES["records_json"] = f"""WITH {RECORDS}
SELECT session_id, seq, type, turn > 1 AND type <> 'system' AS has_parent, cwd, git_branch, ts, title_text, is_message AS has_message,
  CASE WHEN is_message AND {not_blank('spoken')} THEN spoken END AS text, FALSE AS malformed FROM records"""
ORACLES["props_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NOT json_valid(props) AS malformed FROM events"
ORACLES["malformed_count"] = """SELECT 'unknown' AS type, count(*) AS lines, count(*) FILTER (NOT coalesce(try_cast(html AS JSON) IS NOT NULL, FALSE)) AS malformed,
  count(*) FILTER (NOT coalesce(try_cast(html AS JSON) IS NOT NULL, FALSE)) || ' line(s) skipped: not well-formed JSON.' AS parse_error FROM pages"""
ORACLES["session_ids"] = """WITH h AS (SELECT page_id, url, md5(CAST(page_id AS VARCHAR)) AS h FROM pages),
u AS (SELECT page_id, contains(url, '?') AS bad, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM h)
SELECT page_id, CASE WHEN bad THEN '/logs/x' || id || '.jsonl' ELSE 'C:\\logs\\' || upper(id) || '.jsonl' END AS path, CASE WHEN NOT bad THEN id END AS session_id FROM u""".replace("\\\\", "\\")
ORACLES["file_heads"] = """WITH f AS (SELECT page_id, encode(coalesce(html, '') || chr(10)) AS bytes FROM pages)
SELECT page_id, CAST(octet_length(bytes) AS BIGINT) AS size, upper(sha256(bytes[1:4096])) AS head_sha256, TRUE AS readable FROM f"""
ORACLES["chunks_split"] = f"WITH RECURSIVE {DOCUMENT_CHUNKS} SELECT session_id, chunk_no, kind, ts, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM chunks"
ORACLES["chunks_derived"] = f"{TABLES} SELECT session_id, chunk_no, kind, ts, text FROM chunks_derived"
ORACLES["chunks_all"] = f"{TABLES} SELECT session_id, chunk_no, kind, ts, md5(text) AS digest FROM chunks"
ORACLES["chunk_kinds"] = f"""{TABLES}, counts AS (SELECT kind, count(*) AS n FROM chunks GROUP BY kind)
SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind, CAST(sum(n) AS BIGINT) AS chunks FROM counts"""
ORACLES["kinds_pivot"] = f"""{TABLES}
SELECT session_id, count(*) AS chunks, count(*) FILTER (kind = 1) AS title, count(*) FILTER (kind = 2) AS folder, count(*) FILTER (kind = 3) AS last_prompt,
  count(*) FILTER (kind = 4) AS user_prompt, count(*) FILTER (kind = 5) AS assistant_text FROM chunks GROUP BY session_id"""
ORACLES["index_stats"] = f"""{TABLES}, counts AS (SELECT kind, count(*) AS n FROM chunks GROUP BY kind)
SELECT count(*) AS sessions, count(parse_error) AS parse_errors, count(*) FILTER (folder_source = 0) AS unknown_folders, max(last_activity) AS newest_activity,
  (SELECT CAST(sum(n) AS BIGINT) FROM counts) AS chunks, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM counts) AS by_kind,
  (SELECT date_trunc('second', max(ts)) FROM events) AS last_reconcile FROM sessions"""
ORACLES["activity_window"] = f"""{TABLES}
SELECT c.session_id, c.ts, c.chunk_no, c.kind, s.title, s.git_branch, md5(c.text) AS digest FROM chunks c JOIN sessions s USING (session_id)
WHERE s.last_activity >= TIMESTAMP '2024-01-02' AND s.first_activity < TIMESTAMP '2024-01-09' AND c.kind IN (4, 5) AND c.ts >= TIMESTAMP '2024-01-02' AND c.ts < TIMESTAMP '2024-01-09'"""

# ---------------------------------------------------------------- scalar functions

ORACLES["collapse_text"] = f"SELECT doc_id, md5({collapse('text')}) AS line, {truncate(collapse('text'))} AS title FROM documents"
ORACLES["truncate_words"] = f"""WITH d AS (SELECT doc_id, text, {collapse('text')} AS line FROM documents)
SELECT doc_id, {truncate_words('line', 160)} AS short, {truncate_words('line', 400)} AS long, CAST(least(length(text), 512) AS INTEGER) AS stored FROM d"""
ORACLES["prompt_clean"] = f"""WITH {RECORDS}
SELECT session_id, seq, {clean('spoken')} AS prompt, {clean('spoken')} IS NOT NULL AS is_human FROM records WHERE type = 'user'"""
ORACLES["folders"] = f"""WITH raw AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS raw FROM pages),
p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN raw || '//' WHEN page_id % 7 = 0 THEN '///' WHEN page_id % 11 = 0 THEN ' c:\\ ' ELSE raw END AS path FROM raw),
d AS (SELECT page_id, {folder_display('path')} AS display FROM p)
SELECT page_id, display, {folder_key('display')} AS key, {base_name('display')} AS name, display || CASE WHEN page_id % 3 = 0 THEN ' main' ELSE '' END AS searched FROM d""".replace("c:\\\\", "c:\\")
ORACLES["branches"] = f"WITH {RECORDS} SELECT CASE WHEN git_branch <> 'HEAD' THEN git_branch END AS branch, count(*) AS n, count(git_branch) AS named FROM records GROUP BY 1"
ORACLES["working_day"] = f"SELECT event_id, {working_day('ts')} AS day, {clock('ts')} AS clock FROM events"
ORACLES["day_start"] = f"SELECT DISTINCT {working_day('ts')} AS day, CAST({working_day('ts')} AS TIMESTAMP) + INTERVAL 7 HOUR AS starts_at FROM events"
ORACLES["relative_age"] = """WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events), a AS (SELECT event_id, ts, CAST(epoch(TIMESTAMP '2024-01-24 12:00:00') - epoch(ts) AS BIGINT) AS s FROM e)
SELECT event_id, CASE WHEN s < 0 OR s >= 604800 THEN strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN s // 60 || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  ELSE s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM a"""
ORACLES["day_labels"] = f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, DATE '2000-06-15' AS today FROM orders)
SELECT day, {day_label('day', 'today')} AS label,
  CASE WHEN today = day THEN 'Today so far' WHEN today - day = 1 THEN 'Yesterday' WHEN day > today THEN 'Later' ELSE (today - day) || ' days ago' END AS heading,
  CASE WHEN day >= today THEN 'Week of ' || {short_day('day')} ELSE 'Week of ' || {short_day('day')} || ' – ' || {short_day('today')} END AS week FROM d"""
ORACLES["spans"] = f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, {span('first', 'last')} AS span, {count_noun('n', 'event')} AS counted FROM e"""
ORACLES["epoch_millis"] = """SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('millisecond', ts) AS back, date_trunc('second', ts) AS parsed, CAST(NULL AS TIMESTAMP) AS not_a_time FROM events"""
ORACLES["recency"] = f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, round({recency('ts', "TIMESTAMP '2024-01-20'")}, 9) AS recency, CAST({kind_weight('event_id % 7')} AS DOUBLE) AS weight FROM e"""
ORACLES["tokens"] = f"""WITH t AS (SELECT 'conversations' AS corpus, text FROM conversations UNION ALL SELECT 'documents', text FROM documents UNION ALL SELECT 'pages', html FROM pages),
u AS (SELECT corpus, unnest({tokens('text')}) AS token FROM t) SELECT corpus, token, count(*) AS n FROM u GROUP BY ALL"""

# ---------------------------------------------------------------- full-text search

ORACLES["postings"] = f"""{DOCS}
SELECT token, session_id, chunk_no, kind, n_tokens, CAST(count(*) AS INTEGER) AS tf, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS positions FROM positions GROUP BY token, session_id, chunk_no, kind, n_tokens"""
ORACLES["prefix_vocab"] = f"""{DOCS}, vocab AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT token, session_id, chunk_no FROM positions) GROUP BY token),
keys AS (SELECT DISTINCT token, df, left(token, n) AS prefix FROM vocab, (VALUES (1), (2), (3), (4)) v(n))
SELECT prefix, count(*) AS tokens, CAST(sum(df) AS BIGINT) AS chunks FROM keys GROUP BY prefix"""
ORACLES["query_terms"] = f"WITH {BENCHMARK}, {TERMS} SELECT query_id, term_no, term, n_terms FROM terms"
ORACLES["phrase_hits"] = f"{DOCS}, {BENCHMARK}, {TERMS}, {HITS} SELECT term, session_id, chunk_no, tf FROM phrased"
ORACLES["term_hits"] = f"{DOCS}, {BENCHMARK}, {TERMS}, {HITS} SELECT term, session_id, chunk_no, kind, n_tokens, tf FROM hits"
ORACLES["bm25"] = f"{SEARCH} SELECT term, session_id, chunk_no, round(relevance, 6) AS relevance FROM relevant"
ORACLES["qualified"] = f"{SEARCH} SELECT query_id, session_id FROM qualified"
ORACLES["chunk_scores"] = f"{SEARCH}, {scores()} SELECT query_id, session_id, chunk_no, kind, terms, best_term, round(weighted, 6) AS weighted FROM per_chunk"
ORACLES["session_scores"] = f"{SEARCH}, {scores()} SELECT query_id, session_id, round(lexical_score, 6) AS lexical_score, match_count, matched_kinds, chunk_no, term FROM per_session"
ORACLES["search_batch"] = f"""{SEARCH}, {scores()}, {DOC_SESSIONS}, {RANKED}
SELECT query_id, rank, session_id, title, last_activity, folder_display, git_branch, file_path, message_count, match_count, matched_kinds, FALSE AS is_recent, round(lexical_score, 6) AS lexical_score, round(recency, 6) AS recency, round(score, 6) AS score FROM ranked"""
ORACLES["snippets"] = rf"""{SEARCH}, {scores()}, {DOC_SESSIONS}, {RANKED},
best AS (SELECT r.query_id, r.session_id, string_split(r.term, ' ') AS p, regexp_extract_all(c.text, '[\pL\pN\pM]+') AS w, regexp_split_to_array(c.text, '[\pL\pN\pM]+') AS g
  FROM ranked r JOIN chunks c USING (session_id, chunk_no)),
found AS (SELECT *, len(w) AS size, list_filter(range(len(w) - len(p) + 1), lambda i: starts_with(strip_accents(lower(w[i + len(p)])), p[-1]) AND (len(p) = 1 OR strip_accents(lower(w[i + 1])) = p[1])) AS hits FROM best),
counted AS (SELECT *, unnest(hits) AS h FROM found),
windows AS (SELECT *, len(list_filter(hits, lambda x: x >= h AND x + len(p) <= h + 12)) AS c, list_max(list_filter(hits, lambda x: x >= h AND x + len(p) <= h + 12)) AS last FROM counted),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY c DESC, h) AS n FROM windows) WHERE n = 1),
placed AS (SELECT *, greatest(0, least(h - (12 - (last + len(p) - h)) // 2, size - 12)) AS start FROM chosen),
ended AS (SELECT *, least(start + 12, size) AS finish FROM placed),
marked AS (SELECT *, unnest(range(start, finish)) AS i FROM ended),
shown AS (SELECT query_id, session_id, start, finish, size, g, i, CASE WHEN list_contains(hits, i) THEN '[' ELSE '' END || w[i + 1] || CASE WHEN list_contains(hits, i - len(p) + 1) THEN ']' ELSE '' END || CASE WHEN i + 1 < finish THEN g[i + 2] ELSE '' END AS part FROM marked)
SELECT query_id, session_id, CASE WHEN start > 0 THEN '…' ELSE g[1] END || string_agg(part, '' ORDER BY i) || CASE WHEN finish < size THEN '…' ELSE g[size + 1] END AS snippet
FROM shown GROUP BY query_id, session_id, start, finish, size, g"""
ORACLES["search_recent_mode"] = f"""WITH {DOC_SESSIONS},
listing AS (SELECT *, CAST(row_number() OVER (ORDER BY last_activity DESC NULLS LAST, session_id) AS INTEGER) AS rank FROM doc_sessions),
q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 1 THEN 0.0 ELSE 1.0 END AS short FROM benchmark)
SELECT query_id, session_id, rank, CAST(0.0 AS DOUBLE) AS lexical_score, round({recency('last_activity', NOW)}, 6) AS recency, round(short * {recency('last_activity', NOW)}, 6) AS score, TRUE AS is_recent, CAST(0 AS BIGINT) AS match_count, folder_display, git_branch, file_path, message_count
FROM q, listing WHERE rank <= 30"""
LABELLED = """
labelled AS (
  SELECT DISTINCT b.item_id AS query_id, f.session_id FROM (SELECT session_id, ' ' || array_to_string(tokens, ' ') AS joined FROM forward) f
  JOIN (SELECT item_id, ' ' || array_to_string({tokens}, ' ') AS joined FROM benchmark) b ON contains(f.joined, b.joined))""".replace("{tokens}", tokens("text"))


def sweep(settings: str) -> str:
    return f"""{SEARCH}, {LABELLED}, settings(setting, co_occurrence, repeat) AS (VALUES {settings}),
spread AS (SELECT * FROM matches, settings),
{scores('co_occurrence', 'any_value(repeat)', 'setting, ', 'spread').replace("GROUP BY setting,  query_id, session_id, chunk_no, kind", "GROUP BY setting, co_occurrence, repeat, query_id, session_id, chunk_no, kind").replace("SELECT setting,  query_id, session_id, chunk_no, kind, count(*) AS terms", "SELECT setting, repeat, query_id, session_id, chunk_no, kind, count(*) AS terms")}, {DOC_SESSIONS},
placed AS (SELECT setting, query_id, session_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(lexical_score * {recency('last_activity', NOW)}, 9) DESC, session_id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY lexical_score DESC, session_id) AS candidate FROM per_session) JOIN doc_sessions USING (session_id) WHERE candidate <= 200),
answers AS (SELECT setting, query_id, min(rank) AS rank FROM placed SEMI JOIN labelled USING (query_id, session_id) GROUP BY ALL)
SELECT setting, count(*) AS queries, round(avg(rank), 6) AS mean_rank, round(avg(1.0 / rank), 6) AS mean_reciprocal_rank FROM answers GROUP BY setting"""


ORACLES["mean_rank"] = sweep("('default', 2.0, 0.0)")
ORACLES["weight_sweep"] = sweep("('0/0', 0.0, 0.0), ('1/0', 2.0, 0.0), ('0/1', 0.0, 1.0), ('1/1', 2.0, 1.0)")

# ---------------------------------------------------------------- recap

ORACLES["messages_merged"] = f"{EVENT_MESSAGES} SELECT owner, day, session_id, ts, chunk_no, kind, text, prompt FROM cleaned"
ORACLES["active_days"] = f"{EVENT_MESSAGES} SELECT owner, day FROM active"
ORACLES["adjacent_days"] = f"{EVENT_MESSAGES} SELECT owner, day, lag(day) OVER w AS previous_day, lead(day) OVER w AS next_day FROM active WINDOW w AS (PARTITION BY owner ORDER BY day)"
ORACLES["lookback_days"] = f"{EVENT_MESSAGES}, {FRAMES} SELECT owner, focus, day, age FROM frames"
ORACLES["focus_day"] = f"""{EVENT_MESSAGES},
asked AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS owner, DATE '2024-01-31' AS today, CASE WHEN user_id % 2 = 0 THEN DATE '2024-01-10' + CAST(user_id % 15 AS INTEGER) END AS requested FROM events),
chosen AS (SELECT owner, today, coalesce(requested, (SELECT max(day) FROM active a WHERE a.owner = q.owner AND a.day < q.today)) AS focus FROM asked q)
SELECT owner, today, focus, (SELECT max(day) FROM active a WHERE a.owner = c.owner AND a.day < c.focus) AS previous_day,
  (SELECT min(day) FROM active a WHERE a.owner = c.owner AND a.day > c.focus AND a.day <= c.today) AS next_day,
  EXISTS (SELECT 1 FROM active a WHERE a.owner = c.owner AND a.day = c.focus) AS is_active FROM chosen c WHERE focus IS NOT NULL"""
ASKED = """
asked AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS owner, DATE '2024-01-31' AS today, CASE WHEN user_id % 2 = 0 THEN DATE '2024-01-10' + CAST(user_id % 15 AS INTEGER) END AS requested FROM events),
chosen AS (SELECT * FROM (SELECT owner, today, coalesce(requested, (SELECT max(day) FROM active a WHERE a.owner = q.owner AND a.day < q.today)) AS focus FROM asked q) WHERE focus IS NOT NULL)"""
FOCUS_MESSAGES = re.sub(r"\b(flagged|runs|messages|cleaned|active)\b", r"focus_\1", messages_of("focus_chunks"))
ORACLES["focus_recap"] = f"""WITH {EVENT_CHUNKS}, prompt_chunks AS (SELECT * FROM event_chunks WHERE kind = 4), {messages_of('prompt_chunks')}, {ASKED},
asked_frames AS (
  SELECT owner, focus, focus AS day, 0 AS age FROM chosen UNION ALL
  SELECT owner, focus, day, CAST(age AS INTEGER) FROM (SELECT c.owner, c.focus, a.day, row_number() OVER (PARTITION BY c.owner, c.focus ORDER BY a.day DESC) AS age FROM chosen c JOIN active a ON a.owner = c.owner AND a.day < c.focus) WHERE age <= 4),
focus_chunks AS (SELECT e.* FROM event_chunks e WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.owner = e.owner AND c.focus = {working_day('e.ts')})), {FOCUS_MESSAGES},
told AS (SELECT * FROM focus_cleaned UNION ALL SELECT * FROM cleaned c WHERE NOT EXISTS (SELECT 1 FROM chosen f WHERE f.owner = c.owner AND f.focus = c.day)), {SESSION_DAYS.replace('FROM cleaned', 'FROM told')}
SELECT owner, focus, day, age, session_id, prompt_count, first_activity, last_activity, first_prompt_at, last_prompt_at, outcome, is_quick FROM asked_frames JOIN session_days USING (owner, day)"""
ORACLES["key_prompts"] = f"{EVENT_MESSAGES}, {KEY_PROMPTS} SELECT owner, day, session_id, array_to_string(key_prompts, ' | ') AS key_prompts FROM key_prompts"
ORACLES["session_recap"] = f"{EVENT_MESSAGES}, {SESSION_DAYS} SELECT * FROM session_days"
PLAIN = collapse("replace(replace(coalesce(outcome, key_prompts[1]), '**', ''), '`', '')")
ORACLES["outcome"] = f"""{CONVERSATION_RECAPS}
SELECT owner, day, session_id, prompt_count, is_quick, outcome, array_to_string(key_prompts, ' | ') AS key_prompts, {truncate_words(PLAIN, 180)} AS description FROM recaps"""
ORACLES["repo_roots"] = f"""WITH {EVENT_CHUNKS}, {EVENT_SESSIONS}
SELECT DISTINCT s.owner, {folder_key('s.folder_display')} AS folder_key, r.root FROM event_sessions s JOIN repos r ON r.owner = s.owner AND (s.folder_display = r.root OR starts_with(s.folder_display, r.root || '/'))"""
ORACLES["page_roots"] = f"""WITH p AS (SELECT DISTINCT {folder_key(folder_display("regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '')"))} AS folder_key FROM pages),
r AS (SELECT DISTINCT regexp_extract(url, '^https?:/(/[^/]*)', 1) AS root FROM pages)
SELECT folder_key, arg_max(root, length(root)) AS root FROM p JOIN r ON folder_key = {folder_key('root')} OR starts_with(folder_key, {folder_key('root')} || '\\') GROUP BY folder_key""".replace("'\\\\'", "'\\'")
ORACLES["own_commits"] = f"WITH {EVENT_CHUNKS}, {EVENT_SESSIONS}, {OWN} SELECT owner, repo_root, sha, subject, ts FROM own"
ORACLES["commit_log"] = """SELECT o_orderkey, left(md5(CAST(o_orderkey AS VARCHAR)), 7) AS sha, o_orderpriority AS subject, o_orderdate + INTERVAL 3 HOUR AS ts FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate + INTERVAL 3 HOUR >= TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 3 HOUR < TIMESTAMP '2000-01-01'"""
ORACLES["commits_by_day"] = f"""WITH {EVENT_CHUNKS}, {EVENT_SESSIONS}, {OWN}
SELECT owner, {folder_key('repo_root')} AS project_key, {working_day('ts')} AS day, count(*) AS commits, min(ts) AS first FROM own GROUP BY 1, 2, 3"""
PROJECT_COLUMNS = "owner, day, project_key, name, path, session_count, quick_count, prompt_count, commit_count, first_activity, last_activity, array_to_string(branches, ',') AS branches, pos"
ORACLES["project_recap"] = f"{EVENT_RECAPS} SELECT {PROJECT_COLUMNS} FROM projects"
ORACLES["conversation_projects"] = f"{CONVERSATION_RECAPS} SELECT {PROJECT_COLUMNS} FROM projects"
ORACLES["week_rollup"] = f"""{EVENT_RECAPS}, {FRAMES}, {ROLLUP}
SELECT owner, focus, project_key, name, last_day, active_days, session_count, quick_count, prompt_count, commit_count, array_to_string(branches, ',') AS branches, pos FROM rollup_rows"""
DAY_TOTALS = "day_totals AS (SELECT owner, day, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(commit_count) AS BIGINT) AS commits, string_agg(name, ', ' ORDER BY earlier_pos) AS projects FROM projects GROUP BY owner, day)"
ORACLES["earlier_days"] = f"{EVENT_RECAPS}, {DAY_TOTALS} SELECT owner, day, sessions, commits, projects FROM day_totals"
ORACLES["headings"] = f"""{CONVERSATION_RECAPS}, {DAY_TOTALS},
sums AS (SELECT owner, focus, sum(sessions) FILTER (age = 0) AS fs, sum(commits) FILTER (age = 0) AS fc, count(*) AS days, sum(sessions) AS ws, sum(commits) AS wc FROM frames JOIN day_totals USING (owner, day) GROUP BY owner, focus)
SELECT owner, focus, concat_ws(' · ', 'Yesterday', {count_noun('fs', 'session')}, CASE WHEN fc > 0 THEN {count_noun('fc', 'commit')} END) AS focus_heading,
  concat_ws(' · ', {count_noun('days', 'active day')}, {count_noun('ws', 'session')}, CASE WHEN wc > 0 THEN {count_noun('wc', 'commit')} END) AS week_heading FROM sums"""


def _line(block: str, group: str, part: str, when: str, then: str, name: str, line: str, text: str, source: str) -> str:
    return f"SELECT owner, focus, {block} AS b, {group} AS g, {part} AS p, CAST({when} AS BIGINT) AS w, CAST({then} AS BIGINT) AS t, CAST({name} AS VARCHAR) AS n, {line} AS l, {text} AS line FROM {source}"


def _assemble(parts: list[str]) -> str:
    return "lines AS (" + "\nUNION ALL ".join(parts) + ") SELECT owner, focus, string_agg(line, chr(10) ORDER BY b, g, p, w, t, n, l) || chr(10) AS text FROM lines GROUP BY owner, focus"


DAY_SOURCES = """
focus_frames AS (SELECT * FROM frames WHERE age = 0),
day_projects AS (SELECT f.focus, f.today, p.* FROM focus_frames f JOIN projects p USING (owner, day)),
day_work AS (SELECT d.focus, d.today, d.pos, r.* FROM day_projects d JOIN recaps r USING (owner, day, project_key) WHERE NOT r.is_quick),
day_commits AS (SELECT d.focus, d.pos, c.* FROM day_projects d JOIN commits c USING (owner, day, project_key)),
day_prompts AS (SELECT *, unnest(key_prompts) AS asked, unnest(range(1, len(key_prompts) + 1)) AS i FROM day_work),
early AS (SELECT f.focus, f.today, f.age, p.*, coalesce(t.titles, []) AS titles FROM frames f JOIN projects p USING (owner, day) LEFT JOIN early_titles t USING (owner, day, project_key) WHERE f.age > 0),
early_commits AS (SELECT e.focus, e.age, e.earlier_pos, c.* FROM early e JOIN commits c USING (owner, day, project_key)),
early_frames AS (SELECT * FROM frames WHERE age > 0)"""


def day_text(bold: str, bullets: tuple[str, str, str], prompts: bool) -> str:
    a, b, c = (f"'{x}'" for x in bullets)
    strong = lambda x: f"'{bold}' || {x} || '{bold}'"
    head = (f"{a} || concat_ws(' · ', {strong('name')}, CASE WHEN len(branches) > 0 THEN array_to_string(list_transform(branches, lambda x: '`' || x || '`'), ', ') END, "
            f"{count_noun('session_count', 'session')}, {span('first_activity', 'last_activity')})")
    quick = f"{b} || '_' || CASE WHEN quick_count < session_count THEN 'plus ' ELSE '' END || {count_noun('quick_count', 'quick question')} || '_'"
    shown = "array_to_string(titles[1:4], '; ') || CASE WHEN len(titles) > 4 THEN '; +' || (len(titles) - 4) || ' more' ELSE '' END"
    brief = (f"concat_ws(' · ', CASE WHEN len(titles) > 0 THEN {shown} END, CASE WHEN quick_count > 0 THEN {count_noun('quick_count', 'quick question')} END, "
             f"CASE WHEN commit_count > 0 THEN {count_noun('commit_count', 'commit')} END)")
    parts = [
        _line("0", "0", "0", "0", "0", EMPTY, "0", strong(day_label("focus", "today")), "focus_frames"),
        _line("2", "pos", "0", "0", "0", EMPTY, "0", head, "day_projects"),
        _line("2", "pos", "1", "epoch_us(first_activity)", "0", "session_id", "0", f"{b} || title || ' (' || {count_noun('prompt_count', 'prompt')} || ')'", "day_work"),
        _line("2", "pos", "2", "0", "0", EMPTY, "0", quick, "day_projects WHERE quick_count > 0"),
        _line("2", "pos", "3", "0", "0", EMPTY, "0", f"{b} || 'Commits:'", "day_projects WHERE commit_count > 0"),
        _line("2", "pos", "4", "epoch_us(ts)", "0", "sha", "0", f"{c} || '`' || sha || '` ' || subject", "day_commits"),
        _line("3", "0", "0", "0", "0", EMPTY, "0", "''", "early_frames WHERE age = 1"),
        _line("4", "0", "0", "0", "0", EMPTY, "0", strong("'Earlier'"), "early_frames WHERE age = 1"),
        _line("5", "age", "0", "0", "0", EMPTY, "0", f"{a} || {strong(day_label('day', 'today'))}", "early_frames"),
        _line("5", "age", "1", "earlier_pos", "0", EMPTY, "0", f"{b} || name || ': ' || {brief}", "early"),
    ]
    if prompts:
        parts.append(_line("2", "pos", "1", "epoch_us(first_activity)", "0", "session_id", "i", f"{c} || '\"' || asked || '\"'", "day_prompts"))
    return f"{CONVERSATION_RECAPS}, {DAY_SOURCES}, {_assemble(parts)}"


ORACLES["recap_text"] = day_text("**", ("- ", "  - ", "    - "), False)
ORACLES["recap_text_slack"] = day_text("*", ("• ", "    ◦ ", "        ▪ "), True)

WEEK_HEAD = ("'- ' || concat_ws(' · ', '**' || name || '**', CASE WHEN len(branches) > 0 THEN array_to_string(list_transform(branches, lambda x: '`' || x || '`'), ', ') END, "
             f"{count_noun('session_count', 'session')} || ' over ' || {count_noun('active_days', 'day')}, CASE WHEN commit_count > 0 THEN {count_noun('commit_count', 'commit')} END)")
ORACLES["week_text"] = f"""{CONVERSATION_RECAPS}, {ROLLUP},
bounds AS (SELECT owner, focus, min(day) AS first_day, max(day) AS last_day FROM frames GROUP BY owner, focus),
week_entries AS (SELECT f.*, r.project_key, r.pos FROM frames f JOIN rollup_rows r USING (owner, focus)),
told AS (SELECT w.*, t.titles FROM week_entries w JOIN focus_titles t USING (owner, day, project_key) WHERE age = 0 UNION ALL SELECT w.*, t.titles FROM week_entries w JOIN early_titles t USING (owner, day, project_key) WHERE age > 0),
week_commits AS (SELECT w.owner, w.focus, w.pos, w.age, c.ts, c.sha, c.subject FROM week_entries w SEMI JOIN projects p ON p.owner = w.owner AND p.day = w.day AND p.project_key = w.project_key JOIN commits c USING (owner, day, project_key)),
""" + _assemble([
    _line("0", "0", "0", "0", "0", EMPTY, "0", f"'**Week of ' || CASE WHEN first_day = last_day THEN {short_day('first_day')} ELSE {short_day('first_day')} || ' – ' || {short_day('last_day')} END || '**'", "bounds"),
    _line("1", "pos", "0", "0", "0", EMPTY, "0", WEEK_HEAD, "rollup_rows"),
    _line("1", "pos", "1", "age", "0", EMPTY, "0", f"'  - ' || {short_day('day')} || ': ' || array_to_string(titles, '; ')", "told"),
    _line("1", "pos", "2", "0", "0", EMPTY, "0", f"'  - _' || CASE WHEN quick_count < session_count THEN 'plus ' ELSE '' END || {count_noun('quick_count', 'quick question')} || '_'", "rollup_rows WHERE quick_count > 0"),
    _line("1", "pos", "3", "0", "0", EMPTY, "0", "'  - Commits:'", "rollup_rows WHERE commit_count > 0"),
    _line("1", "pos", "4", "age", "epoch_us(ts)", "sha", "0", "'    - `' || sha || '` ' || subject", "week_commits"),
])

INSTRUCTIONS = (
    "'You read a work journal and say in at most 120 words what a team should hear.'",
    "'Stay with the journal: no guesses, no praise.'",
    "'1. Results of the day before, one sentence per project; mention what was committed.'",
    "'2. Open ends, if the journal shows any.'",
    "'3. Obstacles, if the journal names any.'",
    "'Use the older days only to tell what is new.'",
)
ORACLES["summary_prompts"] = f"{CONVERSATION_RECAPS}, {DAY_SOURCES}, " + _assemble([
    *[_line("0", str(i), "0", "0", "0", EMPTY, "0", text, "focus_frames") for i, text in enumerate(INSTRUCTIONS)],
    _line("1", "-age", "0", "0", "0", EMPTY, "0", f"'## Before: ' || {short_day('day')}", "early_frames"),
    _line("1", "-age", "1", "earlier_pos", "0", EMPTY, "0", "name || ' | ' || array_to_string(titles, ' / ')", "early"),
    _line("1", "-age", "1", "earlier_pos", "epoch_us(ts)", "sha", "1", "'  committed | ' || subject || ' | ' || sha", "early_commits"),
    _line("2", "0", "0", "0", "0", EMPTY, "0", f"'## Journal: ' || {day_label('focus', 'today')}", "focus_frames"),
    _line("3", "pos", "0", "0", "0", EMPTY, "0", "'### ' || name || CASE WHEN len(branches) > 0 THEN ' on ' || array_to_string(branches, ', ') ELSE '' END", "day_projects"),
    _line("3", "pos", "1", "epoch_us(ts)", "0", "sha", "0", "'committed | ' || subject || ' | ' || sha", "day_commits"),
    _line("3", "pos", "2", "epoch_us(first_activity)", "0", "session_id", "0", f"title || ' | ' || {span('first_activity', 'last_activity')} || ' | ' || {count_noun('prompt_count', 'prompt')}", "day_work"),
    _line("3", "pos", "2", "epoch_us(first_activity)", "0", "session_id", "i", "'  > ' || asked", "day_prompts"),
    _line("3", "pos", "2", "epoch_us(first_activity)", "0", "session_id", "1000", "'  < ' || outcome", "day_work WHERE outcome IS NOT NULL"),
    _line("3", "pos", "3", "0", "0", EMPTY, "0", f"{count_noun('quick_count', 'brief exchange')} || ' left out'", "day_projects WHERE quick_count > 0"),
])

# ---------------------------------------------------------------- merge

SNAPSHOTS = """
stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime,
  CASE WHEN o_orderstatus <> 'P' THEN upper(sha256(CAST(o_orderkey AS VARCHAR))) END AS head_sha256, CAST(floor(floor(o_totalprice) * 3 / 4) AS BIGINT) AS parse_offset FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
current_files AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN floor(o_totalprice) + 1000 WHEN '2-HIGH' THEN floor(floor(o_totalprice) / 2) ELSE floor(o_totalprice) END AS BIGINT) AS size,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderdate ELSE TIMESTAMP '2001-12-31' END AS mtime,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN upper(sha256('rewritten')) ELSE lower(sha256(CAST(o_orderkey AS VARCHAR))) END AS head_sha256 FROM orders WHERE o_orderpriority <> '5-LOW')"""
PLANS = """
compared AS (SELECT coalesce(s.session_id, c.session_id) AS session_id, s.session_id IS NOT NULL AS known, c.session_id IS NOT NULL AS seen, s.size AS ssize, c.size AS csize, s.mtime AS smtime, c.mtime AS cmtime,
  s.head_sha256 AS shead, c.head_sha256 AS chead, s.parse_offset FROM stored s FULL JOIN current_files c ON s.session_id = c.session_id),
plans AS (SELECT session_id, csize AS size, parse_offset,
  CASE WHEN NOT seen THEN 'prune' WHEN NOT known THEN 'full' WHEN ssize = csize AND smtime = cmtime THEN 'skip' WHEN csize < parse_offset THEN 'full' WHEN upper(shead) <> upper(chead) THEN 'full' ELSE 'resume' END AS plan,
  CASE WHEN NOT seen THEN NULL WHEN NOT known THEN 'never_indexed' WHEN ssize = csize AND smtime = cmtime THEN NULL WHEN csize < parse_offset THEN 'file_truncated' WHEN upper(shead) <> upper(chead) THEN 'head_changed' END AS reason FROM compared)"""
ORACLES["change_plan"] = f"WITH {SNAPSHOTS}, {PLANS} SELECT session_id, plan, reason, CASE WHEN plan = 'resume' THEN parse_offset ELSE 0 END AS \"offset\" FROM plans"
ORACLES["forced_plan"] = f"WITH {SNAPSHOTS}, {PLANS}, f AS (SELECT CASE plan WHEN 'prune' THEN 'prune' ELSE 'full' END AS plan, CASE plan WHEN 'prune' THEN NULL ELSE 'forced' END AS reason FROM plans) SELECT plan, reason, count(*) AS n FROM f GROUP BY 1, 2"
ORACLES["prune"] = f"WITH {SNAPSHOTS} SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM current_files) THEN 'kept' ELSE 'pruned' END AS fate FROM stored"
ORACLES["upsert"] = f"""WITH {SNAPSHOTS}
SELECT session_id, size, mtime, head_sha256 FROM current_files UNION ALL SELECT session_id, size, mtime, head_sha256 FROM stored WHERE session_id NOT IN (SELECT session_id FROM current_files)"""
ORACLES["tail_merge"] = f"{BASE} SELECT session_id, title, title_source, folder_display, folder_source, git_branch, last_prompt, first_activity, last_activity, message_count, parse_error FROM sessions"
HALVES = f"""{TABLES}, head AS (SELECT * FROM records WHERE seq <= 4), {sessions_of('head', 'head_sessions')}, {chunks_of('head', 'head_sessions', 'before_rows')},
tail AS (SELECT * FROM records WHERE seq > 4), grown AS (SELECT DISTINCT session_id FROM tail), grown_sessions AS (SELECT * FROM sessions SEMI JOIN grown USING (session_id)), {chunks_of('tail', 'grown_sessions', 'after_rows')}"""
ORACLES["derived_replace"] = f"""{HALVES}
SELECT session_id, chunk_no, kind, ts, md5(text) AS digest FROM before_rows b WHERE NOT EXISTS (SELECT 1 FROM after_rows a WHERE a.session_id = b.session_id AND a.kind = b.kind AND a.kind <= 3)
UNION ALL SELECT session_id, chunk_no, kind, ts, md5(text) FROM after_rows"""
ORACLES["full_replace"] = f"{TABLES} SELECT session_id, chunk_no, kind, ts, md5(text) AS digest FROM chunks_said"
#: Records of transcripts: lines of tools and of the program stand after every fourth message of every third conversation. What a second
#: pass leaves: a tenth of the files goes, a tenth is as it was, the rest is whole.
PASSES = rf"""{RECORDS}, lines AS (
  SELECT *, lower(printf('%08X', conv_id)) AS hex8, turn + 1 + CASE WHEN conv_id % 3 = 0 THEN CAST(count(*) FILTER (turn % 4 = 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) ELSE 0 END AS place FROM records),
named AS (SELECT * REPLACE (hex8 || '-1111-4222-8333-444455556666' AS session_id, place AS seq, '' AS owner) FROM lines),
early AS (SELECT * FROM named WHERE turn < 4 AND conv_id % 10 NOT IN (7, 9)
  UNION ALL SELECT * REPLACE ('user' AS type, TRUE AS is_message, FALSE AS is_title, NULL AS title_text, repeat('a draft that goes ', 40) AS spoken) FROM named WHERE turn < 4 AND conv_id % 10 = 7),
late AS (SELECT * FROM named WHERE conv_id % 10 <> 8 AND (conv_id % 10 <> 6 OR turn < 4)),
{sessions_of('early', 'early_sessions')}, {chunks_of('early', 'early_sessions', 'early_chunks')},
{sessions_of('late', 'late_named')}, late_sessions AS (SELECT * REPLACE (CASE WHEN title_source = 4 THEN session_id ELSE title END AS title) FROM late_named), {chunks_of('late', 'late_sessions', 'late_chunks')},
files AS (SELECT conv_id, session_id, conv_id % 10 AS fate, max(turn) AS last_turn FROM named GROUP BY ALL),
told AS (
  SELECT 1 AS pass, session_id, 'full' AS plan, 'indexed' AS outcome FROM files WHERE fate <> 9
  UNION ALL
  SELECT 2, session_id, CASE WHEN fate = 8 THEN 'prune' WHEN fate = 6 OR fate < 6 AND last_turn < 4 THEN 'skip' WHEN fate IN (7, 9) THEN 'full' ELSE 'resume' END,
    CASE WHEN fate = 8 THEN 'pruned' WHEN fate = 6 OR fate < 6 AND last_turn < 4 THEN 'skipped' WHEN fate IN (7, 9) THEN 'indexed'
      WHEN EXISTS (SELECT 1 FROM named r WHERE r.conv_id = files.conv_id AND turn >= 4 AND is_message AND {not_blank('spoken')}) THEN 'appended' ELSE 'title_refreshed' END
  FROM files),
written AS (
  SELECT 1 AS pass, count(*) AS n FROM early_chunks
  UNION ALL
  SELECT 2, count(*) FROM late_chunks c JOIN told USING (session_id) WHERE pass = 2 AND (plan = 'full' OR plan = 'resume' AND (c.kind <= 3 OR c.chunk_no >> 28 >= (
    SELECT min(seq) FROM named r WHERE r.session_id = c.session_id AND r.turn >= 4))))"""
ORACLES["pass_outcomes"] = f"WITH {PASSES} SELECT CAST(pass AS INTEGER) AS pass, plan, outcome, count(*) AS n FROM told GROUP BY ALL"
ORACLES["reconcile_tally"] = f"""WITH {PASSES}
SELECT CAST(pass AS INTEGER) AS pass, count(*) FILTER (outcome <> 'pruned') AS discovered, count(*) FILTER (outcome IN ('indexed', 'appended', 'title_refreshed')) AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped,
  CAST(0 AS BIGINT) AS failed, count(*) FILTER (outcome = 'pruned') AS pruned, CAST(any_value(w.n) AS BIGINT) AS chunks_written, CAST(0 AS BIGINT) AS parse_errors FROM told JOIN written w USING (pass) GROUP BY pass"""
ORACLES["reconcile_sessions"] = f"""WITH {PASSES},
counted AS (SELECT session_id, max(seq) + max(CASE WHEN conv_id % 3 = 0 AND turn % 4 = 1 AND turn = last_kept THEN 1 ELSE 0 END) AS line_count
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_kept FROM late) GROUP BY session_id)
SELECT session_id, title, title_source, folder_display, folder_source, git_branch, last_prompt, first_activity, last_activity, message_count, CAST(line_count AS BIGINT) AS line_count, parse_error FROM late_sessions JOIN counted USING (session_id)"""
ORACLES["reconcile_chunks"] = f"WITH {PASSES} SELECT session_id, chunk_no, kind, ts, md5(text) AS digest FROM late_chunks"
ORACLES["reconcile_vocabulary"] = f"""WITH {PASSES}, words AS (SELECT session_id, chunk_no, unnest({tokens('text')}) AS token FROM late_chunks)
SELECT token, count(DISTINCT session_id || ':' || chunk_no) AS chunks, count(*) AS tf, count(DISTINCT session_id || ':' || chunk_no) AS df FROM words GROUP BY token"""

# ---------------------------------------------------------------- change streams

KEYED = "seen AS (SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('second', ts) AS ts FROM events), ordered AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM (SELECT DISTINCT key, ts FROM seen))"
ORACLES["debounce"] = f"""WITH RECURSIVE {KEYED},
walk(key, n, first, last, changes, batch) AS (
  SELECT key, n, ts, ts, CAST(1 AS BIGINT), 1 FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.n, CASE WHEN cut THEN o.ts ELSE first END, o.ts, CASE WHEN cut THEN 1 ELSE changes + 1 END, batch + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT w.*, o.ts AS nextts, o.n AS nextn, o.ts - w.last > INTERVAL 8 HOUR OR o.ts - w.first > INTERVAL 20 HOUR AS cut FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1) x
  JOIN ordered o ON o.key = x.key AND o.n = x.nextn)
SELECT key, first AS first_seen, max(last) AS last_seen, max(changes) AS changes, least(max(last) + INTERVAL 8 HOUR, first + INTERVAL 20 HOUR) AS ready_at FROM walk GROUP BY key, batch, first"""
ORACLES["throttle"] = f"""WITH RECURSIVE {KEYED},
walk(key, n, ts, passed) AS (
  SELECT key, n, ts, ts FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.n, o.ts, CASE WHEN o.ts - w.passed >= INTERVAL 20 HOUR THEN o.ts ELSE w.passed END FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, ts FROM walk WHERE ts = passed"""

_STREAMED = f"{BASE} SELECT session_id, title, title_source, folder_display, git_branch, first_activity, last_activity, message_count FROM sessions"
ORACLES["follow_segments"] = _STREAMED
ORACLES["running_sessions"] = _STREAMED
