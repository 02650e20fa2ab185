"""DuckDB SQL for the corpus operators that plain SQL can state."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM raw),
marked AS (
  SELECT *, NOT regexp_full_match(line, '[\x20\x09-\x0D]*') AS full_line FROM lines),
numbered AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
  FROM marked WHERE full_line),
long_later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth
    FROM numbered WHERE length(line) >= 120) WHERE nth > 1),
pairs AS (
  SELECT doc_id, place, line, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS next FROM numbered),
later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, place) AS nth
    FROM pairs WHERE next IS NOT NULL) WHERE nth > 1),
gone AS (
  SELECT DISTINCT doc_id, place FROM (
    SELECT doc_id, place FROM later UNION ALL SELECT doc_id, place + 1 FROM later
    UNION ALL SELECT doc_id, place FROM long_later)),
fate AS (
  SELECT m.doc_id, m.i, m.line, m.full_line, n.place, g.place IS NOT NULL AS removed
  FROM marked m LEFT JOIN numbered n ON n.doc_id = m.doc_id AND n.i = m.i
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.place = n.place),
-- A blank line shares the fate of the last line before it that is not blank.
spread AS (
  SELECT *, coalesce(last_value(CASE WHEN full_line THEN removed END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY i), false) AS dropped FROM fate),
built AS (
  SELECT doc_id, count(*) FILTER (WHERE full_line) AS n_lines,
    count(*) FILTER (WHERE full_line AND removed) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text
  FROM spread GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, b.text
FROM documents d LEFT JOIN built b ON b.doc_id = d.doc_id
"""

OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
plain AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth
  FROM rows),
built AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS told,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
      + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g'))
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS formatted_chars
  FROM plain GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM built
"""

OP6 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
      ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) m ON m.u = d.doc_id
"""

OP9 = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM totals),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(no - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, no, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
n AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS n, sum(target) AS total, max(no) AS last FROM targets),
edges AS (
  SELECT no, CAST(ceil(source_size / 64.0) AS BIGINT) AS blocks, target,
    CASE WHEN no = last THEN 4294967296
      ELSE CAST(floor(sum(target) OVER (ORDER BY no) / total * 4294967296.0::DOUBLE) AS BIGINT) END AS high
  FROM targets, n),
shares AS (
  SELECT no, blocks, high, coalesce(lag(high) OVER (ORDER BY no), 0) AS low FROM edges WHERE target > 0),
points AS (
  SELECT i, CAST((i::HUGEINT * 2654435769) % 4294967296 AS BIGINT) AS point FROM (SELECT unnest(range(n)) AS i FROM n)),
slots AS (
  SELECT no, nth % blocks AS block FROM (
    SELECT s.no, s.blocks, row_number() OVER (PARTITION BY s.no ORDER BY i) - 1 AS nth
    FROM points p JOIN shares s ON p.point >= s.low AND p.point < s.high) WHERE nth < 2 * blocks),
uses AS (SELECT no, block, count(*) AS times FROM slots GROUP BY no, block),
placed AS (
  SELECT doc_id, t.no, size, t.source_size, t.target,
    CAST(sum(size) OVER (PARTITION BY t.no
      ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || ':0'), 1, 15), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT no, doc_id, start, size, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block
  FROM placed WHERE size > 0),
used AS (
  SELECT p.doc_id, sum(times * (least(start + size, (p.block + 1) * 64) - greatest(start, p.block * 64))) AS taken
  FROM pieces p JOIN uses u ON u.no = p.no AND u.block = p.block GROUP BY p.doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(u.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN used u ON u.doc_id = p.doc_id
"""

#: Levels that the SQL unrolls: enough for 3**12 rows of a source, and as many sources.
OP12_LEVELS = 12


def _op12() -> str:
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))), "
        "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )

    def digest(*fields: str) -> str:
        told = " || ".join(
            f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields
        )
        return f"sha256({told})"

    whole = ("doc_id", "source", "lang", "n_chars")
    steps = [
        f"rows AS (SELECT doc_id, source, {digest(*whole, 'text')} AS leaf, "
        f"{digest(*whole, "replace(text, chr(10), '')")} AS cut, {crc} % 2 = 0 AS tampered FROM documents)",
        "sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n "
        "FROM rows GROUP BY source)",
        "leaves AS (SELECT doc_id, leaf, CASE WHEN tampered THEN cut ELSE leaf END AS shown, tree, n, "
        "row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos "
        "FROM rows JOIN sources ON rows.source IS NOT DISTINCT FROM sources.source)",
    ]

    def tree(name: str, begin: str, keys: str) -> None:
        """Nodes of every level, then the siblings and the folded digest of every lowest node."""
        steps.append(f"{name}_n0 AS ({begin})")
        steps.append(f"{name}_p0 AS (SELECT {keys}, tree, pos, shown, '' AS proof FROM {name}_begin)")
        for i in range(OP12_LEVELS):
            steps.append(
                f"{name}_n{i + 1} AS (SELECT tree, pos // 3 AS pos, (max(n) + 2) // 3 AS n, "
                "CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest "
                f"FROM {name}_n{i} GROUP BY tree, pos // 3)"
            )
            steps.append(
                f"{name}_p{i + 1} AS (SELECT {keys}, p.tree, p.pos // 3 AS pos, "
                "CASE WHEN max(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.pos = p.pos THEN p.shown ELSE s.digest END, '' ORDER BY s.pos)) "
                "ELSE max(p.shown) END AS shown, "
                "max(p.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos <> p.pos), '') AS proof "
                f"FROM {name}_p{i} p JOIN {name}_n{i} s ON s.tree = p.tree AND s.pos // 3 = p.pos // 3 GROUP BY {keys}, p.tree, p.pos)"
            )

    steps.append("low_begin AS (SELECT row_number() OVER () AS nth, doc_id, leaf, tree, n, pos, shown FROM leaves)")
    tree("low", "SELECT tree, pos, n, leaf AS digest FROM low_begin", "nth, doc_id, leaf")
    steps.append(
        f"high_begin AS (SELECT nth, doc_id, leaf, tree AS its_tree, proof AS low_proof, 0 AS tree, tree AS pos, shown FROM low_p{OP12_LEVELS})"
    )
    tree(
        "high", f"SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM sources) AS n, digest FROM low_n{OP12_LEVELS}",
        "nth, doc_id, leaf, its_tree, low_proof",
    )
    return (
        "WITH " + ",\n".join(steps)
        + "\nSELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(low_proof || proof) AS proof_sha256, "
        f"p.shown AS folded_root, p.shown = r.digest AS verified FROM high_p{OP12_LEVELS} p "
        f"JOIN low_n{OP12_LEVELS} s ON s.tree = p.its_tree CROSS JOIN high_n{OP12_LEVELS} r"
    )


OP12 = _op12()

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (
  SELECT lang, w[i:i + m - 1] AS g, m FROM (SELECT *, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM starts)),
f AS (SELECT lang, array_to_string(g, ' ') AS p, any_value(g) AS g, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, p),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE m >= 2 AND a >= 30),
parts AS (
  SELECT lang, p, a, k, array_to_string(g[1:k], ' ') AS left_part, array_to_string(g[k + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
cuts AS (
  SELECT c.lang, c.p, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.p = c.left_part JOIN f r ON r.lang = c.lang AND r.p = c.right_part),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM cuts),
inside AS (
  SELECT DISTINCT lang, array_to_string(g[i:i + x - 1], ' ') AS p, a AS longer
  FROM (SELECT *, unnest(range(1, m - x + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS x FROM candidates))),
dropped AS (
  SELECT DISTINCT c.lang, c.p FROM candidates c JOIN inside s ON s.lang = c.lang AND s.p = c.p
  WHERE 100::HUGEINT * s.longer >= 80::HUGEINT * c.a),
ranked AS (
  SELECT c.lang, c.p AS phrase, c.a, l, r, CAST(score AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, c.p) AS rank
  FROM candidates c JOIN lowest w ON w.lang = c.lang AND w.p = c.p AND w.nth = 1
  ANTI JOIN dropped d ON d.lang = c.lang AND d.p = c.p)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

ORACLE = {
    "op1_line_dedup": OP1, "op3_chat_formatting": OP3, "op6_minhash_near_dedup": OP6, "op9_source_mixing": OP9,
    "op12_merkle_manifest": OP12, "op13_phrase_collocations": OP13,
}
