"""URL filters: rules first, then a path-template tree with smoothed labelled purity.

The rules' verdicts are the labels. Per host, paths become a tree of templates, level by level down to the deepest path: runs of digits turn into
``#``; a node with many different children that rarely repeat (VARIED children or more, more than SHARE of its pages each its own)
has them replaced by ``*``; then the children of one node are compared next to each other in order of their share
of blocked labels, and neighbours whose shares do not differ significantly (two-proportion z below Z) become one branch, named after its
first child with a ``~``, whose children are looked at together on the next level. Children without labels make one branch. A node's
purity is its share of blocked labels smoothed by its parent's: all pages, domain (last two labels), host, first segment and so on to the leaf;
from REJECT on, pages of the leaf are blocked.

One SQL text, written for Spark and for DuckDB (they differ in one function); every step is an aggregation over
(host, template) counts or a window over the different label shares at one node: children of one share never part, so only the
last child of a share and the first of the next are compared, and a node may have any number of children. Paths may be of any depth; a
level looks only at paths that reach it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import table, written

#: Rules (host and path prefix, verdict); fixed values.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
VARIED = 10
SHARE = 0.3
Z = 1.96
PRIOR = 4.0
REJECT = 0.5


def _replace_digits(column: str, dialect: str) -> str:
    return f"regexp_replace({column}, '[0-9]+', '#'" + (", 'g')" if dialect == "duckdb" else ")")


def steps(dialect: str, levels: int, rules: tuple[tuple[str, str], ...] = RULES) -> list[tuple[str, str, bool]]:
    """Name, SQL and whether Spark writes the rows of each step, each from steps before it and ``pages`` (page_id, url without nulls).

    ``levels`` is the depth of the deepest path, more do no harm. The last step is the result.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, path = rule.split("/", 1)
        fits.append(f"WHEN (host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(path) + 1}) = '/{path}' THEN '{rule}'")
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in rules)
    out = [
        ("p0", """SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages"""),
        ("p1", """SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0"""),
        ("p2", f"""SELECT *, CASE {' '.join(fits)} END AS rule, {_replace_digits('path', dialect)} AS shape FROM p1"""),
        ("u", f"""SELECT host, shape, length(shape) - length(replace(shape, '/', '')) AS depth, count(*) AS n,
  sum(CASE CASE rule {verdicts} END WHEN 'block' THEN 1 ELSE 0 END) AS bad, count(rule) AS labelled FROM p2 GROUP BY host, shape"""),
        ("h", r"""SELECT host, regexp_extract(host, '[^.]*\.?[^.]*$', 0) AS domain, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(labelled) AS DOUBLE) AS labelled FROM u GROUP BY host"""),
        ("d", """SELECT domain, sum(bad) AS bad, sum(labelled) AS labelled FROM h GROUP BY domain"""),
        ("w", f"""SELECT (sum(bad) + 0.5 * {PRIOR}) / (sum(labelled) + {PRIOR}) AS purity FROM d"""),
        ("dp", f"""SELECT domain, (bad + {PRIOR} * (SELECT purity FROM w)) / (labelled + {PRIOR}) AS purity FROM d"""),
        ("hp", f"""SELECT host, (bad + {PRIOR} * dp.purity) / (labelled + {PRIOR}) AS purity FROM h JOIN dp ON dp.domain = h.domain"""),
        ("t0", """SELECT u.host AS host, shape, depth, '' AS template, hp.purity AS purity, n, bad, labelled FROM u JOIN hp ON hp.host = u.host"""),
    ]
    for level in range(1, levels + 1):
        segment = f"split_part(shape, '/', {level + 1})"
        out += [
            (f"c{level}", f"""SELECT host, template, {segment} AS seg, sum(n) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(labelled) AS DOUBLE) AS labelled, max(purity) AS above
  FROM t{level - 1} WHERE depth >= {level} GROUP BY 1, 2, 3"""),
            (f"v{level}", f"""SELECT host, template, count(*) >= {VARIED} AND count(*) > {SHARE} * sum(n) AS varied FROM c{level} GROUP BY host, template"""),
            (f"k{level}", f"""SELECT c.host AS host, c.template AS template, CASE WHEN varied AND seg <> '' THEN '*' ELSE seg END AS seg, sum(bad) AS bad, sum(labelled) AS labelled, max(above) AS above
  FROM c{level} c JOIN v{level} v ON v.host = c.host AND v.template = c.template GROUP BY 1, 2, 3"""),
            (f"x{level}", f"""SELECT *, CASE WHEN labelled > 0 THEN 1 ELSE 0 END AS known, CASE WHEN labelled > 0 THEN bad / labelled ELSE 0 END AS share FROM k{level}"""),
            (f"e{level}", f"""SELECT host, template, share, min_by(bad, seg) AS bad, min_by(labelled, seg) AS labelled, max_by(bad, seg) AS bad_z, max_by(labelled, seg) AS labelled_z
  FROM x{level} WHERE known = 1 GROUP BY host, template, share"""),
            (f"y{level}", f"""SELECT *, lag(bad_z) OVER w AS bad0, lag(labelled_z) OVER w AS labelled0 FROM e{level} WINDOW w AS (PARTITION BY host, template ORDER BY share)"""),
            (f"z{level}", f"""SELECT *, CASE WHEN bad0 IS NULL THEN 1 WHEN (bad + bad0) = 0 OR (bad + bad0) = (labelled + labelled0) THEN 0
    WHEN abs(share - bad0 / labelled0) >= {Z} * sqrt((bad + bad0) / (labelled + labelled0) * (1 - (bad + bad0) / (labelled + labelled0)) * (1 / labelled + 1 / labelled0)) THEN 1 ELSE 0 END AS breaks FROM y{level}"""),
            (f"r{level}", f"""SELECT host, template, share, sum(breaks) OVER (PARTITION BY host, template ORDER BY share ROWS UNBOUNDED PRECEDING) AS branch FROM z{level}"""),
            (f"b{level}", f"""SELECT x.host AS host, x.template AS template, seg, bad, labelled, above, known, coalesce(branch, 0) AS branch FROM x{level} x
  LEFT JOIN r{level} r ON r.host = x.host AND r.template = x.template AND r.share = x.share AND x.known = 1"""),
            (f"g{level}", f"""SELECT host, template, known, branch, CASE WHEN count(*) > 1 THEN min(seg) || '~' ELSE min(seg) END AS name, (sum(bad) + {PRIOR} * max(above)) / (sum(labelled) + {PRIOR}) AS purity
  FROM b{level} GROUP BY host, template, known, branch"""),
            (f"s{level}", f"""SELECT b.host AS host, b.template AS template, b.seg AS seg, g.name AS name, g.purity AS purity FROM b{level} b
  JOIN g{level} g ON g.host = b.host AND g.template = b.template AND g.known = b.known AND g.branch = b.branch"""),
            (f"q{level}", f"""SELECT t.*, CASE WHEN varied AND {segment} <> '' THEN '*' ELSE {segment} END AS seg FROM t{level - 1} t JOIN v{level} v ON v.host = t.host AND v.template = t.template WHERE depth >= {level}"""),
            (f"t{level}", f"""SELECT q.host AS host, shape, depth, q.template || '/' || s.name AS template, s.purity AS purity, n, bad, labelled FROM q{level} q
  JOIN s{level} s ON s.host = q.host AND s.template = q.template AND s.seg = q.seg"""),
        ]
    ended = " UNION ALL ".join(f"SELECT host, shape, template, purity FROM t{level} WHERE depth = {level}" for level in range(levels + 1))
    out.append(("leaves", ended))
    out.append(
        (
            "judged",
            f"""SELECT page_id, p.host AS host, path, rule, CASE rule {verdicts} ELSE CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END END AS verdict,
  template, round(purity, 6) AS purity FROM p2 p LEFT JOIN leaves t ON t.host = p.host AND t.shape = p.shape""",
        )
    )
    return [(name, sql, name == "u" or name[0] in "tb" and name[1:].isdigit()) for name, sql in out]


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url); other columns are ignored.

    A null url, and one without ``://``, has empty host and path, fits no rule and is judged by its (empty) template. Repeated
    rows count and are all returned; a null page_id stays null; ties of shares go by the segment's text; an empty table gives no rows.
    """
    frames = {"pages": pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))}

    def add(name: str, sql: str, keep: bool) -> DataFrame:
        named = re.sub(r"\b(FROM|JOIN) (\w+)( [a-z]\b)?", lambda m: f"{m[1]} {{{m[2]}}}{m[3] or f' AS {m[2]}'}", sql)
        frame = pages.sparkSession.sql(named, **{k: v for k, v in frames.items() if f"{{{k}}}" in named})
        frames[name] = written(frame, f"url-{name}") if keep else frame
        return frame

    plan = steps("spark", 0)
    first = [name for name, *_ in plan].index("u")
    for step in plan[: first + 1]:
        add(*step)
    (depth,) = frames["u"].agg(F.max("depth")).first()
    for step in steps("spark", depth or 0)[first + 1 :]:
        add(*step)
    return frames["judged"]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page; see ``judge`` for nulls, repeats and empty tables."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


#: Depth of the SQL that checks the query on the test tables, whose paths have fewer segments.
ORACLE_LEVELS = 6


def _oracle() -> str:
    pages = "pages0 AS (SELECT page_id, coalesce(url, '') AS url FROM pages)"
    ctes = [f"{name} AS {'MATERIALIZED ' if keep else ''}({sql.replace('FROM pages', 'FROM pages0')})" for name, sql, keep in steps("duckdb", ORACLE_LEVELS)]
    return "WITH " + ",\n".join([pages, *ctes]) + "\nSELECT * FROM judged"


ORACLE_OP6 = _oracle()
