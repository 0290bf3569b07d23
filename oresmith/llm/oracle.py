"""SQL for DuckDB with the results of those queries that SQL can express."""

from __future__ import annotations


def url_sql(patterns: list[str]) -> str:
    lower = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = []
    for p in sorted(patterns, key=lambda p: (len(p), p), reverse=True):
        start, rest = "(^|[^a-z0-9_.%-])", p[1:].replace(".", "[.]").replace("*", ".*").replace("^", "([^a-z0-9_.%-]|$)")
        cases.append(f"WHEN regexp_matches({lower}, '{start}{rest}', 's') THEN 'pattern:{p}'")
    fits = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = [("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]
    whens = []
    for rule, _ in rules:
        h, _, p = rule.partition("/")
        whens.append("WHEN " + fits.format(h=h, p="/" + p) + f" THEN '{rule}'")
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    return f"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's') AS raw_host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
hosts AS (
  SELECT page_id, url, path,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parts),
ruled AS (
  SELECT *, CASE {' '.join(whens)} END AS rule, CASE {' '.join(cases)} END AS fitting FROM hosts)
SELECT page_id, host, path, rule,
       CASE {verdicts} WHEN fitting IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN fitting END AS pattern
FROM ruled
"""


LINES_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_number FROM docs),
taking_part AS (SELECT *, length(line) AS n FROM numbered WHERE length(trim(line, ' ')) >= 10),
firsts AS (
  SELECT line, n, min((doc_id, line_number)) AS first FROM taking_part GROUP BY line, n),
halves AS (
  SELECT line, n, first, unnest([
    ('a', n, left(line, n // 2)), ('b', n, right(line, n - n // 2)),
    ('a', n - 1, left(line, (n - 1) // 2)), ('b', n - 1, right(line, n - 1 - (n - 1) // 2))]) AS half
  FROM firsts),
near AS (
  SELECT DISTINCT x.line FROM halves x JOIN halves y ON x.half = y.half
  WHERE y.first < x.first AND abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 1),
marked AS (
  SELECT t.doc_id, t.line_number
  FROM taking_part t JOIN firsts f ON t.line = f.line LEFT JOIN near n ON n.line = t.line
  WHERE n.line IS NOT NULL OR (t.doc_id, t.line_number) > f.first),
left_over AS (
  SELECT n.doc_id, count(*) AS n_lines, count(m.doc_id) AS n_dropped,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.line_number) FILTER (m.doc_id IS NULL), '') AS text
  FROM numbered n LEFT JOIN marked m ON n.doc_id = m.doc_id AND n.line_number = m.line_number
  GROUP BY n.doc_id)
SELECT doc_id, n_lines, n_dropped,
       n_dropped > 0 AND trim(translate(text, chr(10) || chr(9) || chr(13), '')) = '' AS emptied,
       md5(text) AS text_md5
FROM left_over
"""


def merkle_sql(levels: int = 15) -> str:
    """Trees of up to 3 ** levels leaves, level by level; a tree with one node left stays as it is."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def grow(name: str, tree: str) -> list[str]:
        """``name``_0 (tree, i, digest) and upwards: left and right siblings, then the parents."""
        steps = []
        for level in range(levels):
            run = f"PARTITION BY {tree}, i // 3 ORDER BY i ROWS BETWEEN"
            steps.append(f"""
{name}_way_{level} AS (
  SELECT {tree}, i, digest, count(*) OVER (PARTITION BY {tree}) AS n,
         coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_{level}),
{name}_{level + 1} AS (
  SELECT {tree}, i // 3 AS i, CASE WHEN n = 1 THEN digest ELSE sha256(l || digest || r) END AS digest
  FROM {name}_way_{level} WHERE i % 3 = 0)""")
        return steps

    def climb(before: str, name: str, tree: str, place: str) -> list[str]:
        steps = []
        for level in range(levels):
            steps.append(f"""
{name}_climb_{level} AS (
  SELECT c.* EXCLUDE (i, node, proof), c.i // 3 AS i,
         CASE WHEN w.n = 1 THEN node ELSE sha256(w.l || node || w.r) END AS node,
         CASE WHEN w.n = 1 THEN proof ELSE proof || w.l || w.r END AS proof
  FROM {before if level == 0 else f"{name}_climb_{level - 1}"} c
  JOIN {name}_way_{level} w ON {place} AND c.i = w.i)""")
        return steps

    steps = [
        f"""
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf('text')} AS leaf,
         CASE WHEN h % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS start
  FROM (SELECT *, {crc32_sql('doc_id')} AS h FROM documents)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
src_0 AS (SELECT tree, i, leaf AS digest FROM placed)""",
        *grow("src", "tree"),
        f"""
all_0 AS MATERIALIZED (
  SELECT 0 AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS i, digest FROM src_{levels})""",
        *grow("all", "tree"),
        "\nfrom_leaf AS (SELECT doc_id, tree, leaf, i, start AS node, '' AS proof FROM placed)",
        *climb("from_leaf", "src", "tree", "c.tree = w.tree"),
        f"""
from_subroot AS (
  SELECT c.* EXCLUDE (i), a.i, a.digest AS subroot FROM src_climb_{levels - 1} c JOIN all_0 a ON c.tree = a.of)""",
        *climb("from_subroot", "all", "tree", "true"),
    ]
    body = ",".join(steps).replace("WITH ", "")
    return f"""
WITH {body}
SELECT doc_id, leaf, subroot, a.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = a.digest AS verified
FROM all_climb_{levels - 1} CROSS JOIN all_{levels} a
"""


def crc32_sql(column: str) -> str:
    """Unsigned crc32 of the decimal text, bit by bit."""
    byte = f"ascii(substr({column}::VARCHAR, i::BIGINT, 1))::UBIGINT"
    shift = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    eight = f"list_reduce(list_prepend(xor(crc, {byte}), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {shift})"
    whole = f"list_reduce(list_prepend(4294967295::UBIGINT, range(1, length({column}::VARCHAR) + 1)::UBIGINT[]), lambda crc, i: {eight})"
    return f"xor({whole}, 4294967295::UBIGINT)"


COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def statements() -> dict[str, str]:
    from oresmith.llm.queries import PAGE_PATTERNS

    return {
        "op7_rarest_token_rules": url_sql(PAGE_PATTERNS),
        "op10_deletion_neighbourhood": LINES_SQL,
        "op11_incremental_merkle": merkle_sql(),
        "op12_salted_exact_dedup": COPIES_SQL,
    }
