"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

# Control strings of the chat template. Each one in a text, and each
# backslash, is a character more when it is escaped.
_CONTROLS = ["<sys>", "</sys>", "[INST]", "[/INST]", "<s>", "</s>", "{{role", "=}}", "{{/role}}", "\\"]
_ESCAPES = "(" + " + ".join(
    f"(length({{x}}) - length(replace({{x}}, '{c}', ''))) // length('{c}')" for c in _CONTROLS
) + ")"

SQL = {
    "op1_format_chats": f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM every
), w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    lead(n) OVER (PARTITION BY conv_id ORDER BY n) IS NULL AS is_last,
    length(text) + {_ESCAPES.format(x="text")} + CASE role
      WHEN 'system' THEN 6 + 8 WHEN 'user' THEN 7 + 9 WHEN 'assistant' THEN 3 + 5
      ELSE 6 + length(role) + {_ESCAPES.format(x="role")} + 3 + 8 END AS size
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before = 'user' ELSE false END IS TRUE
    AND (NOT is_last OR role IN ('user', 'assistant'))) AS valid
FROM w GROUP BY conv_id
""",
    "op6_mix_sources": """
WITH d AS (
  SELECT doc_id, source,
    CAST(CASE WHEN text IS NULL THEN 0
      ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0'), 1, 13))
        AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (0.05::DOUBLE + 1.0::DOUBLE - coalesce(
        CAST(length(text) - length(regexp_replace(text, '[0-9#*$%&|<>]', '', 'g')) AS DOUBLE)
        / CAST(greatest(length(text), 1) AS DOUBLE), 0.0::DOUBLE)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3
      WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    row_number() OVER o AS rk,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0.0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS lvl
  FROM s
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source COLLATE "binary" NULLS LAST),
    b AS (ORDER BY 2.0::DOUBLE * source_size / w, source COLLATE "binary" NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(cap, w * (
    SELECT arg_min(lvl, rk) FROM l WHERE cap / w > lvl)), cap) AS target
  FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT)
    ELSE 0 END AS epochs
  FROM t
), r AS (
  SELECT doc_id, size, source_size, target, epochs,
    CAST(floor(target) AS BIGINT) - epochs * source_size
      - (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
        ROWS UNBOUNDED PRECEDING) - size) AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(rest, size)) AS BIGINT) AS taken
FROM r
""",
    "op10_decontaminate": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
    FROM b WHERE len(w) > 0)
), g AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM d, (SELECT DISTINCT n FROM i))
), h AS (
  SELECT r, item_id, g.n AS n, p FROM g JOIN i ON g.n = i.n AND g.x = i.x
), c AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS x FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
""",
    "op12_prefix_trie": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id,
    list(md5(length(role) || ':' || role || ':' || text) ORDER BY turn NULLS FIRST, role, text) AS keys,
    list(CAST(strlen(text) AS BIGINT) ORDER BY turn NULLS FIRST, role, text) AS sizes
  FROM t GROUP BY conv_id
), h AS (
  SELECT *, CAST(xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT,
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))
  )) % 9 AS INTEGER) AS h
  FROM own
), r AS (
  SELECT o.conv_id,
    list_concat(coalesce(b.keys[1:o.h], []), o.keys[o.h + 1:]) AS keys,
    list_concat(coalesce(b.sizes[1:o.h], []), o.sizes[o.h + 1:]) AS sizes
  FROM h o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), d AS (
  SELECT *, unnest(range(0, len(keys) + 1)) AS depth FROM r
), m AS (
  SELECT conv_id, depth, len(keys) = depth AS ends_here,
    md5(array_to_string(keys[1:depth], ',')) AS node,
    CASE WHEN depth > 0 THEN md5(array_to_string(keys[1:depth - 1], ',')) END AS up,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes
  FROM d
), n AS (
  SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (WHERE ends_here), '')) AS ends_sha256
  FROM m GROUP BY depth, node
), c AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), v AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, node)
), s AS (
  SELECT a.depth, a.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves,
    sum((v.n_convs - 1) * v.bytes) AS saved_tokens
  FROM v JOIN m a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs,
  v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, node) LEFT JOIN v p ON p.depth = v.depth - 1 AND p.node = v.up
""",
    "op13_fill_in_middle": """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
    CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) AS h1,
    CAST(('0x' || substr(digest, 9, 8)) AS BIGINT) AS h2,
    CAST(('0x' || substr(digest, 17, 8)) AS BIGINT) AS h3,
    CAST(('0x' || substr(digest, 25, 8)) AS BIGINT) AS h4
  FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, n, form, text,
    coalesce(array_to_string(units[1:low], ''), '') AS pre,
    coalesce(array_to_string(units[low + 1:high], ''), '') AS mid,
    coalesce(array_to_string(units[high + 1:n], ''), '') AS suf
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
}
