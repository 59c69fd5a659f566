"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: crc32 of a text column, by eight steps a byte.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '.'), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, o: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

_LEVELS = 8  # trees of up to 16^8 nodes


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _tree(name: str, base: str) -> list[str]:
    """CTEs of a tree over ``base(key, rank, n, digest)``: level k is ``name_k``, a lone node is handed up as it is."""
    out = [f"{name}_0 AS (SELECT key, rank, n AS m, digest FROM {base})"]
    for k in range(_LEVELS):
        out.append(f"""{name}_{k + 1} AS (SELECT key, rank // 16 AS rank, max(ceil(m / 16))::BIGINT AS m,
            CASE WHEN max(m) > 1 THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE max(digest) END AS digest FROM {name}_{k} GROUP BY key, rank // 16)""")
    return out


def _sides(name: str, key: str, rank: str) -> tuple[list[str], list[str], list[str]]:
    """Joins to the siblings of each level, and the expressions of the digests left and right."""
    joins, left, right = [], [], []
    for k in range(_LEVELS):
        here = f"{name}s_{k}"
        joins.append(f"JOIN (SELECT key, rank, coalesce(string_agg(digest, '') OVER (PARTITION BY key, rank // 16 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                     f" coalesce(string_agg(digest, '') OVER (PARTITION BY key, rank // 16 ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, m FROM {name}_{k}) {here}"
                     f" ON {here}.key = {key} AND {here}.rank = {rank} // {16 ** k}")
        left.append(f"{here}.l")
        right.append(f"{here}.r")
    return joins, left, right


def _merkle() -> str:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = CRC32.format("doc_id::VARCHAR")
    one = _sides("a", "d.key", "d.rank")
    two = _sides("b", "0", "s.rank")
    folds, at = [], "d.other"
    for name, k in [("a", k) for k in range(_LEVELS)] + [("b", k) for k in range(_LEVELS)]:
        folds.append((name, k))
    # Each level of the fold is a CTE of its own, so that no expression grows.
    steps = ["f_0 AS (SELECT d.*, s.digest AS subroot, "
             + ", ".join(f"{n}s_{k}.l AS {n}l_{k}, {n}s_{k}.r AS {n}r_{k}, {n}s_{k}.m AS {n}m_{k}" for n, k in folds)
             + f", {at} AS h FROM d JOIN s ON s.key_name = d.key {' '.join(one[0])} {' '.join(two[0])})"]
    for i, (n, k) in enumerate(folds):
        steps.append(f"f_{i + 1} AS (SELECT * REPLACE (CASE WHEN {n}m_{k} > 1 THEN sha256({n}l_{k} || h || {n}r_{k}) ELSE h END AS h) FROM f_{i})")
    ctes = [
        f"""d AS (SELECT CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, doc_id, {_leaf('text')} AS digest,
            CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {_leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {_leaf('text')} END AS other,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf('text')}) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
        *_tree("a", "d"),
        f"s AS (SELECT 0 AS key, key AS key_name, row_number() OVER (ORDER BY encode(key)) - 1 AS rank, count(*) OVER () AS n, digest FROM a_{_LEVELS})",
        *_tree("b", "s"), *steps]
    path = " || ".join(f"{n}l_{k} || {n}r_{k}" for n, k in folds)
    return f"""WITH {", ".join(ctes)}
        SELECT doc_id, f.digest AS leaf, subroot, r.digest AS root, sha256({path}) AS proof_sha256, h AS folded_root, h = r.digest AS verified
        FROM f_{len(folds)} f, b_{_LEVELS} r"""


MERKLE = _merkle()

BLOCK_REPEATS = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM words, unnest(range(1, len(ws) - 18)) AS t(i)),
    repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeats, range(20) AS t(k)),
    placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM words),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

HARD_NEGATIVES = """WITH r AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
