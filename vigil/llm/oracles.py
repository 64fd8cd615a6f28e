"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

from vigil.llm.licenses import BASE_PHRASES, LOWER, TEMPLATES, UPPER, stride

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _licenses() -> str:
    rows = ", ".join(f"({k}, '{label}', {sorted(set(words.split()))})" for k, (label, words) in enumerate(TEMPLATES))
    places = []
    for phrase in BASE_PHRASES:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
        places.append(f"list_filter(range(len(w)), lambda i: {test})")
    labels = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE_PHRASES.values())]
    step = stride(TEMPLATES)
    every = " || ".join(f"p{k}" for k in range(len(BASE_PHRASES)))
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lo
      FROM documents),
    w AS (SELECT r, doc_id, list_filter(string_split_regex(lo, '{SPLIT}'), lambda x: x <> '') AS w FROM d),
    p AS (SELECT r, doc_id, w, {", ".join(f"{p} AS p{k}" for k, p in enumerate(places))} FROM w),
    b AS (SELECT r, doc_id, w, {every} AS places,
                 list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS found FROM p),
    places AS (SELECT r, w, unnest(range(greatest(1, (len(w) + {step - 1}) // {step} - 1))) AS i FROM w),
    held AS (SELECT r, list_distinct(w[i * {step} + 1 : i * {step} + {2 * step}]) AS held FROM places),
    t(k, label, words) AS (VALUES {rows}),
    m AS (SELECT r, label, len(list_intersect(held, words)) AS shared, len(words) AS size FROM held, t),
    hit AS (SELECT r, list(DISTINCT label) AS matched, max(shared / size) AS best
            FROM m WHERE 10 * shared >= 9 * size GROUP BY r)
    SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
           coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(found || coalesce(matched, []))), ','), '') AS labels,
           CASE WHEN len(found) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM b LEFT JOIN hit USING (r)
    """


WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
                 max(page_id) OVER (PARTITION BY html) AS newest FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
    FROM q
    """

_LEAVES = "list_transform(string_split({0}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,32}}'), lambda c: left(sha256(c), 32)))"
_ROOT = """sha256(array_to_string(list_transform(string_split(regexp_replace(
    array_to_string(list_transform({0}, lambda p: sha256(array_to_string(p, ''))), ' '), ' ([01])', chr(10) || '\\1', 'g'), chr(10)),
    lambda s: sha256(s)), ' '))"""
_LIKE = """CASE WHEN len(flatten({0})) + len(flatten({1})) = 0 THEN 1.0::DOUBLE ELSE
    2.0::DOUBLE * len(list_intersect(flatten({0}), flatten({1})))
    / (len(list_distinct(flatten({0}))) + len(list_distinct(flatten({1})))) END"""

MERKLE = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nx FROM d
          WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)),
    e AS (SELECT *, left(text, n - n // 4) || left(nx, n // 4) AS edited FROM o),
    t AS (SELECT doc_id, n, edited, {_LEAVES.format("text")} AS a, {_LEAVES.format("edited")} AS b,
                 {_LEAVES.format("nx")} AS c FROM e)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_ROOT.format("a")} AS fingerprint,
           {_ROOT.format("b")} AS edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited,
           {_LIKE.format("a", "c")} AS near_next
    FROM t
    """

NEGATIVES = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                 list_inner_product(a.v, b.v)::BIGINT AS score
          FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS place
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM n WHERE place <= 10
    """


def all_sql() -> dict[str, str]:
    return {"op2_licenses": _licenses(), "op3_warc": WARC, "op4_merkle": MERKLE, "op12_negatives": NEGATIVES}
