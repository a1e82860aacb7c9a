"""SQL (DuckDB) for those registered queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_tiled_cosine"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(n, r) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a
), component AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component ON n = v.vec_id
"""

SQL["op3_arc"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SQL["op11_hard_negatives"] = """
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM scores WHERE same) WHERE k <= 5
), negatives AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.id)::INTEGER AS rank
    FROM positives p JOIN scores n ON n.r = p.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

SQL["op12_spelling"] = r"""
WITH RECURSIVE remainders AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)
), occurrences AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
        unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), runs AS (
    SELECT id, run, count(*) AS n FROM occurrences WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))),
        lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) AS h
    FROM runs, remainders
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
    SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), deleted AS (SELECT DISTINCT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.rest
), near AS (
    SELECT a, b FROM deleted UNION SELECT b, a FROM deleted
    UNION SELECT x.word, y.word FROM shorter x JOIN shorter y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
), best AS (
    SELECT a AS word, count(*)::BIGINT AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM near JOIN words ON words.word = b GROUP BY a
), forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), reach(word, root, steps) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT reach.word, forms.form, steps + 1 FROM reach JOIN forms ON forms.word = reach.root WHERE forms.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, steps) AS root FROM reach GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
