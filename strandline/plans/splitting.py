"""The splitter's rules as SQL (DuckDB): paragraphs are packed by bytes, long blocks by sentences, long sentences cut hard."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _packed(name: str, source: str, key: str, gap: int, limit: int) -> str:
    """The rows (key, i, t) of ``source`` with the number of the chunk that each goes to; a chunk starts at its first
    piece that isn't empty."""
    return f"""{name}_n AS MATERIALIZED (SELECT *, strlen(t) AS n FROM {source}),
{name}_walk({key}, i, g, size) AS (SELECT {key}, i, 0, n FROM {name}_n WHERE i = 1 UNION ALL
  SELECT w.{key}, w.i + 1, CASE WHEN w.size > 0 AND w.size + {gap} + p.n > {limit} THEN w.g + 1 ELSE w.g END, CASE WHEN w.size > 0 AND w.size + {gap} + p.n <= {limit} THEN w.size + {gap} + p.n ELSE p.n END
  FROM {name}_walk w JOIN {name}_n p ON p.{key} = w.{key} AND p.i = w.i + 1)"""


def split_sql(texts: str, key: str, limit: int) -> str:
    """(key, part, parts, content) of ``texts``, a query of (key, content)."""
    return f"""WITH RECURSIVE th AS ({texts}),
para AS (SELECT {key}, unnest(b) AS t, unnest(range(1, len(b) + 1)) AS i FROM (SELECT {key}, string_split(content, chr(10) || chr(10)) AS b FROM th WHERE strlen(content) > {limit})),
{_packed("a", "para", key, 2, limit)},
block AS (SELECT {key}, g, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM a_walk JOIN a_n USING ({key}, i) WHERE size > 0 GROUP BY {key}, g),
long AS (SELECT row_number() OVER () AS b, {key}, g, t FROM block WHERE strlen(t) > {limit}),
cut AS (SELECT b, string_split(regexp_replace(t, '([.!?])[ \\n]', '\\1' || chr(1), 'g'), chr(1)) AS c FROM long),
kept AS (SELECT b, CASE WHEN len(c) = 1 AND c[1] = '' THEN c ELSE list_transform(CASE WHEN trim(c[-1], {SPACE}) = '' THEN c[:-2] ELSE c END, lambda s: trim(s, {SPACE})) END AS c FROM cut),
sent AS (SELECT b, unnest(c) AS t, unnest(range(1, len(c) + 1)) AS i FROM kept),
{_packed("s", "sent", "b", 1, limit)},
piece AS (SELECT row_number() OVER () AS p, b, g, string_agg(t, ' ' ORDER BY i) AS t FROM s_walk JOIN s_n USING (b, i) WHERE size > 0 GROUP BY b, g),
hard(p, k, t, rest) AS (SELECT p, 0, CASE WHEN strlen(t) <= {limit} THEN t ELSE '' END, CASE WHEN strlen(t) <= {limit} THEN '' ELSE t END FROM piece UNION ALL
  SELECT p, k + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT p, k, rest, (SELECT max(x.n) FROM (SELECT unnest(range(1, {limit} + 1)) AS n) x WHERE strlen(left(rest, x.n)) <= {limit}) AS n FROM hard WHERE rest <> '')),
all_ AS (SELECT {key}, 0 AS g, 0 AS h, 0 AS k, content AS t FROM th WHERE strlen(content) <= {limit}
  UNION ALL SELECT {key}, g, 0, 0, t FROM block WHERE strlen(t) <= {limit}
  UNION ALL SELECT long.{key}, long.g, piece.g, k, hard.t FROM hard JOIN piece USING (p) JOIN long USING (b) WHERE hard.t <> '')
SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY g, h, k) AS INTEGER) AS part, CAST(count(*) OVER (PARTITION BY {key}) AS INTEGER) AS parts, t AS content FROM all_"""
