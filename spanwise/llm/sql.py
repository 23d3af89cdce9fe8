"""The results of operators that SQL can express, written out for DuckDB."""

# The checksum's table and its value for the bytes in hexadecimal digits.
CRC_TABLE = """
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i))
"""


def crc32(text: str, table: str) -> str:
    """SQL for the unsigned checksum of a text's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length({digits}) + 1, 2),
            lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"""


# Words that share what is left when the letter at some place is dropped, or the whole of a shorter one.
OP13_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), summed AS (
    SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run", "t")} AS h FROM counted, crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
            ELSE run END AS word FROM summed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), dropped AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM dropped a JOIN dropped b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM dropped a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM dropped a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS (
    SELECT word, min(other) AS form, any_value(top) AS form_n
    FROM near JOIN best USING (word) JOIN words USING (word) WHERE other_n = top AND top >= 10 * n GROUP BY word
), chain AS (
    SELECT word, form AS reached FROM forms
    UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.reached = forms.word
), roots AS (
    SELECT word, reached AS root FROM chain WHERE reached NOT IN (SELECT word FROM forms)
)
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n::BIGINT AS form_n, coalesce(root, word) AS root
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""

# Beginnings are named by the digests of their turns; a node's ancestors are read off its smallest member.
OP11_SQL = f"""
WITH crc AS ({CRC_TABLE}), turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS number
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
    WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, {crc32("conv_id::VARCHAR", "t")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
    SELECT c.conv_id, 0 AS own, number, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20
    WHERE number <= h
    UNION ALL SELECT c.conv_id, 1, number, role, text FROM convs c JOIN turns t USING (conv_id) WHERE number > h
), items AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, number) AS depth,
        sha256(sha256(role) || sha256(text)) AS turn, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM rebuilt
), paths AS (
    SELECT conv_id, depth, words,
        string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM items
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
    SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, any_value(words) AS words FROM paths
    GROUP BY depth, path
), owned AS (
    SELECT p.conv_id, p.depth, n.conv_id AS owner FROM paths p JOIN nodes n USING (depth, path)
), parents AS (
    SELECT n.conv_id, n.depth, n.n_convs, n.words, o.owner AS parent_conv_id
    FROM nodes n LEFT JOIN owned o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1
), kids AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0
    GROUP BY ALL
), figures AS (
    SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids USING (conv_id, depth)
), sums AS (
    SELECT o.owner AS conv_id, o.depth, count(*) FILTER (f.n_children = 0) AS n_leaves,
        sum((f.n_convs - 1) * f.words) AS saved_tokens
    FROM figures f JOIN owned o ON o.conv_id = f.conv_id AND o.depth <= f.depth GROUP BY ALL
), ends AS (
    SELECT owner AS conv_id, depth, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids
    FROM (SELECT conv_id AS id, depth, owner FROM owned
        QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM figures JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""

# All pairs of a label compared, and what links reach.
OP12_SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b USING (label)
    WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, b FROM reached r JOIN linked ON r.other = a
), components AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counts AS (
    SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY a
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
