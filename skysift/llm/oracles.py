"""SQL of the training-data queries that SQL can express."""

# crc32 over the bytes of a text: the table of its polynomial, then one step a byte.
CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS steps
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS c
        FROM range(256) r(i)))
"""


def crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text, beside crc_table."""
    digits = f"hex(encode({text}))"
    nibble = "(instr('0123456789ABCDEF', {d}[{i}:{i}]) - 1)"
    byte = f"{nibble.format(d=digits, i='2*i-1')} * 16 + {nibble.format(d=digits, i='2*i')}"
    data = f"list_transform(range(1, (length({digits}) // 2 + 1)::BIGINT), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda acc, b: xor(acc >> 8, steps[(xor(acc, b) & 255) + 1])), 4294967295)"


def _features(table: str, key: str) -> str:
    return (f"SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            f"'[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM {table}")


OP12_IMPORTANCE = f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM ({_features("documents", "doc_id")}) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT w, count(*) AS n FROM ({_features("benchmark", "item_id")}) GROUP BY 1),
hashed AS MATERIALIZED (SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b) x, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM d JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS n FROM b JOIN hashed USING (w) GROUP BY 1),
gain AS MATERIALIZED (
  SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
         / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) k(bucket) LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


def _more(value: str, cost: str, edit: str) -> str:
    """A state's value, its cost in nine digits before its audit, after one more edit."""
    return f"(lpad((({value})[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || ({value})[10:] || '{edit}')"


def _inserted(v: list[str]) -> list[str]:
    """The values of the four states once any number of rows may be inserted."""
    user = f"least({', '.join([v[2], _more(v[0], '3', 'I'), _more(v[1], '3', 'I'), _more(v[3], '3', 'I')])})"
    assistant = f"least({', '.join([v[3], _more(v[2], '3', 'I'), _more(_more(v[0], '3', 'I'), '3', 'I'), _more(_more(v[1], '3', 'I'), '3', 'I')])})"
    return [v[0], v[1], user, assistant]


def _after_row(v: list[str]) -> list[str]:
    late = "CASE WHEN r.fault = 3 THEN 3 ELSE 0 END"

    def to(state: int, sources: list[int], initial: str, rerole: bool) -> str:
        found = [_more(v[state], "4", "D")]
        for s in sources:
            found.append(f"CASE WHEN r.fault NOT IN (1, 2) AND r.initial = '{initial}' THEN {_more(v[s], late, 'K')} END")
            if rerole:
                found.append(f"CASE WHEN r.fault NOT IN (1, 2) THEN {_more(v[s], '3 + ' + late, 'R')} END")
        return f"least({', '.join(found)})"

    return [to(0, [], "", False), to(1, [0], "s", False), to(2, [0, 1, 3], "u", True), to(3, [2], "a", True)]


_STATES = [f"v{k}" for k in range(4)]
_BEFORE = [f"i{k}" for k in range(4)]

# The cheapest edits row by row, forwards; the query itself parses spans.
OP13_REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) c(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered),
faults AS MATERIALIZED (
  SELECT *, role[1:1] AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
  FROM numbered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
steps(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM counts
  UNION ALL
  SELECT b.conv_id, r.i, {", ".join(_after_row(_BEFORE))}
  FROM (SELECT conv_id, i, {", ".join(f"{x} AS {n}" for x, n in zip(_inserted(_STATES), _BEFORE, strict=True))} FROM steps) b
  JOIN faults r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1),
ends AS (
  SELECT s.conv_id, least(v0, {_inserted(_STATES)[3]}) AS v FROM steps s JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n),
audits AS (SELECT conv_id, v[1:9]::BIGINT AS cost, v[10:] AS audit FROM ends),
edits AS (SELECT conv_id, audit, k, audit[k:k] AS e FROM audits, unnest(range(1, length(audit) + 1)) AS x(k)),
placed AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS o,
         length(replace(audit, 'D', '')) % 2 AS has_system
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
lines AS (
  SELECT p.conv_id, p.k, CASE WHEN e = 'K' THEN f.role WHEN (o - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE e <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashes s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""
