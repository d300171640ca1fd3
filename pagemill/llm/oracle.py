"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS
from .sharding import ROUNDS

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
SPACES = "[\\x20\\x09-\\x0D]"


def quality() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(STOP_WORDS))
    broken = ", ".join(
        f"CASE WHEN {r.measure} < {r.low} OR {'FALSE' if r.high == float('inf') else f'{r.measure} > {r.high}::DOUBLE'} THEN '{r.name}' END" for r in RULES
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
    g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM t),
    c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop FROM d LEFT JOIN c USING (r)),
    x AS (SELECT *, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio,
      coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) AS stop_ratio,
      coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    y AS (SELECT *, array_to_string(list_filter([{broken}], lambda b: b IS NOT NULL), ',') AS broken FROM x)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM y"""


def embeddings(t: float = 0.98) -> str:
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    f AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= {t}::DOUBLE),
    c AS (WITH RECURSIVE w(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT w.a, p.b FROM w JOIN p ON p.a = w.b) SELECT a, min(b) AS component_id FROM w GROUP BY a),
    l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e LEFT JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def sharding(shards: int = 40) -> str:
    """The checksum is folded over the bytes of a text; positions walk along their cycle in a recursive query."""
    table = ", ".join(map(str, _crc_table()))
    rounds = []
    left, right = "l0", "r0"
    for k, (a, b) in enumerate(ROUNDS):
        f = f"(({right} * {a} + {b}) % 1000003 * 7919 // 13)"
        rounds.append(f"f{k} AS (SELECT *, {right} AS l{k + 1}, ({left} + {f} + {right} // 7) % side AS r{k + 1} FROM {'z' if k == 0 else f'f{k - 1}'})")
        left, right = f"l{k + 1}", f"r{k + 1}"
    side = "(SELECT greatest(1, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1) FROM documents)"
    last = len(ROUNDS)

    chain = ", ".join(rounds)
    return f"""WITH RECURSIVE t AS (SELECT [{table}] AS t),
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    b AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END) AS bytes FROM d),
    c AS (SELECT doc_id, strlen(text) + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_filter(bytes, lambda x: x IS NOT NULL)), lambda a, x: xor(t.t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS text_crc32 FROM b, t),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS total, {side} AS side FROM c),
    w AS (SELECT r, r AS x, side, total, 0 AS k FROM n UNION ALL
      (WITH z AS (SELECT r, side, total, k, x // side AS l0, x % side AS r0 FROM w WHERE k = 0 OR x >= total), {chain}
       SELECT r, l{last} * side + r{last} AS x, side, total, k + 1 FROM f{last - 1}))
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM n JOIN (SELECT r, x FROM w WHERE k > 0 AND x < total) USING (r)"""
