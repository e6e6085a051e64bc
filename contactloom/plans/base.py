"""Common table expressions of the DuckDB statements: the same genome data as ``sources.tables``."""

from __future__ import annotations

CTE = {
    "mates": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS m,
  1 + l_partkey % 5 AS chrom, (l_partkey // 5) * 1000 AS pos, CAST(l_quantity AS INT) AS mapq, l_linestatus = 'O' AS rev,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 4 ELSE 0 END AS flag FROM lineitem""",
    "pairs": """SELECT a.l_orderkey * 10000 + a.m * 100 + b.m AS read_id, a.l_orderkey % 2 AS sample, a.chrom AS chrom1, a.pos AS pos1, a.mapq AS mapq1, a.rev AS rev1, a.flag AS flag1,
  b.chrom AS chrom2, b.pos AS pos2, b.mapq AS mapq2, b.rev AS rev2, b.flag AS flag2 FROM mates a JOIN mates b ON a.l_orderkey = b.l_orderkey AND a.m < b.m""",
    "classed": """SELECT *, CASE WHEN flag1 & 4 <> 0 OR flag2 & 4 <> 0 THEN 'one mate unmapped' WHEN (mapq1 < 15 OR mapq2 < 15) AND mapq1 = 0 THEN 'one mate not unique'
  WHEN mapq1 < 15 OR mapq2 < 15 THEN 'one mate low quality' END AS q,
  CASE WHEN chrom1 <> chrom2 THEN 'different chromosome' WHEN NOT l AND r THEN 'inward' WHEN l AND NOT r THEN 'outward' WHEN l AND r THEN 'same-strand-left' ELSE 'same-strand-right' END AS o,
  CASE WHEN chrom1 <> chrom2 THEN 'inter' WHEN abs(pos1 - pos2) < 20000 THEN 'short' ELSE 'long' END AS len
  FROM (SELECT *, CASE WHEN pos1 <= pos2 THEN rev1 ELSE rev2 END AS l, CASE WHEN pos1 <= pos2 THEN rev2 ELSE rev1 END AS r FROM pairs)""",
    "accepted": """SELECT * FROM classed WHERE q IS NULL QUALIFY row_number() OVER (PARTITION BY least(chrom1, chrom2), greatest(chrom1, chrom2), least(pos1, pos2), greatest(pos1, pos2) ORDER BY read_id) = 1""",
    "px": """SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // 10000 AS a, chrom2 * 1000000 + (pos2 + 18) // 10000 AS b FROM pairs) GROUP BY ALL""",
    "pxs": """SELECT sample, least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT sample, chrom1 * 1000000 + (pos1 + 18) // 10000 AS a, chrom2 * 1000000 + (pos2 + 18) // 10000 AS b FROM pairs) GROUP BY ALL""",
    "full_px": "SELECT bin1, bin2, value FROM px UNION ALL SELECT bin2, bin1, value FROM px WHERE bin1 <> bin2",
    "intra": "SELECT *, bin1 // 1000000 AS chrom, bin2 - bin1 AS d FROM px WHERE bin1 // 1000000 = bin2 // 1000000",
    "sizes": "SELECT 1 + p_partkey % 5 AS chrom, max(p_partkey // 5) * 1000 + 1000 AS size FROM part GROUP BY 1",
    "bins": "SELECT chrom * 1000000 + s // 10000 AS bin_id, chrom, s AS start, least(s + 10000, size) AS \"end\" FROM (SELECT chrom, size, unnest(range(0, size, 10000)) AS s FROM sizes)",
    "perchrom": "SELECT chrom, count(*) AS n FROM bins GROUP BY 1",
    "iv": "SELECT event_type AS chrom, CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) AS start, CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) + 60 + 10 * (event_id % 50) AS \"end\", event_id AS id, value AS score FROM events",
    "doms": """SELECT * FROM (SELECT chrom, start, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS "end", chrom * 1000 + row_number() OVER (PARTITION BY chrom ORDER BY start) AS id FROM bins WHERE (start // 10000) % 5 = chrom % 3) WHERE "end" IS NOT NULL""",
    "points": "SELECT 1 + p_partkey % 5 AS chrom, (p_partkey // 5) * 1000 AS start, (p_partkey // 5) * 1000 + 1000 AS \"end\", p_name AS gene, p_partkey AS id, (1 + p_partkey % 5) * 1000000 + (p_partkey // 5) * 1000 // 10000 AS bin_id FROM part WHERE p_size = 1",
    "track": """SELECT bin_id, round(v - avg(v) OVER (PARTITION BY bin_id // 1000000), 6) AS value FROM (SELECT (1 + p_partkey % 5) * 1000000 + (p_partkey // 5) * 1000 // 10000 AS bin_id, avg(p_retailprice) AS v FROM part GROUP BY 1)""",
}


def sql(query: str, *tables: str, **more: str) -> str:
    """``query`` with the named expressions, and those in ``more``, ahead of it; ``tables`` are in order of their needs."""
    parts = [f"{t} AS ({CTE[t]})" for t in tables] + [f"{t} AS ({q})" for t, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query


PX = ("mates", "pairs", "px")
BINS = ("sizes", "bins", "perchrom")
