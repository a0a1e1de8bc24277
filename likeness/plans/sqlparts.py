"""SQL fragments shared by the oracle texts."""

from __future__ import annotations


def draw(*parts: str, seed: str) -> str:
    args = ", ".join([*parts, f"'{seed}'"])
    return f"(('0x'||substr(md5(concat_ws('|', {args})),1,15))::BIGINT)"


def position(key: str, seed: str, partition: str = "") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"(row_number() OVER ({part}ORDER BY md5(concat_ws('|', {key}, '{seed}')), {key}) - 1)")


def random_pairs(name: str, source: str, key: str, per: int, seed: str) -> str:
    return f"""{name}_idx AS (SELECT {key}, {position(key, seed)} AS idx, count(*) OVER () AS n FROM {source}),
{name}_d AS (SELECT n, idx*{per} + j AS draw FROM {name}_idx, range({per}) r(j)),
{name}_lr AS (SELECT draw, {draw('draw', seed=seed + 'L')} % n AS l, {draw('draw', seed=seed + 'R')} % n AS r FROM {name}_d),
{name} AS (SELECT draw, x.{key} AS a, y.{key} AS b FROM {name}_lr JOIN {name}_idx x ON x.idx=l
 JOIN {name}_idx y ON y.idx=r WHERE l <> r)"""


def group_pairs(name: str, source: str, group: str, key: str, seed: str, per_member: int = 2) -> str:
    return f"""{name}_idx AS MATERIALIZED (SELECT {group}, {key}, {position(key, seed, group)} AS idx FROM {source}),
{name}_g AS (SELECT {group}, count(*) AS n FROM {source} GROUP BY {group} HAVING count(*) >= 2),
{name}_d AS MATERIALIZED (SELECT {group}, n, unnest(range({per_member}*n)) AS draw FROM {name}_g),
{name}_lr AS MATERIALIZED (SELECT {group}, draw, {draw(group, 'draw', seed=seed + 'L')} % n AS l,
 {draw(group, 'draw', seed=seed + 'R')} % n AS r FROM {name}_d),
{name} AS (SELECT d.{group}, draw, x.{key} AS a, y.{key} AS b FROM {name}_lr d
 JOIN {name}_idx x ON x.{group}=d.{group} AND x.idx=l JOIN {name}_idx y ON y.{group}=d.{group} AND y.idx=r WHERE l <> r)"""


def cosine(name: str, pairs: str, profiles: str) -> str:
    return f"""{name}_n AS (SELECT entity, sqrt(sum(value*value)) AS norm FROM {profiles} GROUP BY entity),
{name} AS (SELECT p.a, p.b, coalesce(any_value(d.dot / nullif(x.norm*y.norm, 0)), 0.0) AS raw
 FROM (SELECT DISTINCT a, b FROM {pairs}) p
 LEFT JOIN (SELECT q.a, q.b, sum(l.value*r.value) AS dot FROM (SELECT DISTINCT a, b FROM {pairs}) q
  JOIN {profiles} l ON l.entity=q.a JOIN {profiles} r ON r.entity=q.b AND r.target=l.target GROUP BY 1,2) d
  ON d.a=p.a AND d.b=p.b
 LEFT JOIN {name}_n x ON x.entity=p.a LEFT JOIN {name}_n y ON y.entity=p.b GROUP BY p.a, p.b)"""


def bins(name: str, profiles: str) -> str:
    edges = (1, 2, 3, 5, 8, 13, 21, 34, 10**6)
    terms = " + ".join(f"(count(*) >= {e})::INT" for e in edges)
    return f"{name} AS (SELECT entity, {terms} AS bin FROM {profiles} GROUP BY entity)"


def background(sample: str, bin_table: str) -> str:
    """CTEs bg_b, bg_stats and bg_all from ``sample(a, b, raw)``."""
    return f"""bg_b AS (SELECT s.*, coalesce(x.bin,0) AS bin_a, coalesce(y.bin,0) AS bin_b FROM {sample} s
 LEFT JOIN {bin_table} x ON x.entity=s.a LEFT JOIN {bin_table} y ON y.entity=s.b),
bg_stats AS (SELECT bin_a, bin_b, count(*) AS n, avg(raw) AS mean,
 CASE WHEN stddev_pop(raw) > 0 THEN stddev_pop(raw) ELSE 1.0 END AS std FROM bg_b GROUP BY 1,2 HAVING count(*) >= 50),
bg_all AS (SELECT avg(raw) AS mean, CASE WHEN stddev_pop(raw) > 0 THEN stddev_pop(raw) ELSE 1.0 END AS std FROM bg_b)"""


def doc_tokens(name: str = "tok", table: str = "documents", key: str = "doc_id") -> str:
    return (f"{name} AS MATERIALIZED (SELECT {key} AS id, list_filter(regexp_split_to_array(lower(text), "
            f"'[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM {table})")


_CLASS = ("list_transform(w, lambda x: least(length(x),8)::VARCHAR || "
          "CASE WHEN regexp_matches(x,'[0-9]') THEN 'd' ELSE 'w' END)")


def feature_rows(kind: str) -> tuple[str, str]:
    """(list of features starting at word x, expression w is replaced by)."""
    ahead = lambda i: f"lead(x,{i}) OVER o"
    gram = lambda n: " || ' ' || ".join(["x"] + [ahead(i) for i in range(1, n)])
    upto = lambda n: "[" + ", ".join(gram(i) for i in range(1, n + 1)) + "]"
    if kind == "pair":
        return "[" + ", ".join(f"x || ' ' || {ahead(g)} || ' {g}'" for g in range(1, 6)) + "]", "w"
    if kind == "quad":
        return f"[{gram(4)}]", "w"
    widths = {"ngram2": 2, "ngram3": 3, "class": 2, "path": 7}
    return upto(widths[kind]), _CLASS if kind == "class" else "w"


def fp(name: str, tok: str, kind: str = "ngram2", distinct: bool = True) -> str:
    feats, words = feature_rows(kind)
    d = "DISTINCT " if distinct else ""
    return (f"{name} AS MATERIALIZED (SELECT {d}id, ('0x'||substr(md5(f),1,8))::BIGINT % 2048 AS bit FROM "
            f"(SELECT id, unnest({feats}) AS f FROM (SELECT id, unnest({words}) AS x, generate_subscripts(w,1) AS p FROM {tok}) "
            f"WINDOW o AS (PARTITION BY id ORDER BY p)) WHERE f IS NOT NULL)")


def features(name: str, tok: str, kind: str = "ngram2") -> str:
    """Distinct unfolded features: (id, f)."""
    feats, words = feature_rows(kind)
    return (f"{name} AS MATERIALIZED (SELECT DISTINCT id, f FROM (SELECT id, unnest({feats}) AS f FROM (SELECT id, unnest({words}) AS x, "
            f"generate_subscripts(w,1) AS p FROM {tok}) WINDOW o AS (PARTITION BY id ORDER BY p)) WHERE f IS NOT NULL)")


def close_pairs(name: str, feats: str, floor: float) -> str:
    """All pairs with a Tanimoto similarity of at least ``floor``, both ways round: (a, b, sim)."""
    return f"""{name}_n AS (SELECT id, count(*) AS n FROM {feats} GROUP BY 1),
{name}_c AS (SELECT f, row_number() OVER () AS code FROM {feats} GROUP BY f HAVING count(*) > 1),
{name}_k AS MATERIALIZED (SELECT id, code FROM {feats} JOIN {name}_c USING (f)),
{name} AS MATERIALIZED (SELECT a, b, s::DOUBLE/(x.n+y.n-s) AS sim FROM (SELECT l.id AS a, r.id AS b, count(*) AS s FROM {name}_k l
 JOIN {name}_k r USING (code) WHERE l.id <> r.id GROUP BY 1,2) JOIN {name}_n x ON x.id=a JOIN {name}_n y ON y.id=b WHERE s::DOUBLE/(x.n+y.n-s) >= {floor})"""


def tanimoto_all(name: str, left: str, right: str) -> str:
    """All pairs with at least one shared position: (a, b, sim)."""
    return f"""{name}_na AS (SELECT id, count(*) AS n FROM {left} GROUP BY 1),
{name}_nb AS (SELECT id, count(*) AS n FROM {right} GROUP BY 1),
{name} AS MATERIALIZED (SELECT a, b, s::DOUBLE/(x.n+y.n-s) AS sim FROM (SELECT l.id AS a, r.id AS b, count(*) AS s FROM {left} l
 JOIN {right} r USING (bit) GROUP BY 1,2) JOIN {name}_na x ON x.id=a JOIN {name}_nb y ON y.id=b)"""


def tanimoto_pairs(name: str, pairs: str, prints: str) -> str:
    """Tanimoto of the distinct listed pairs, 0 without a shared position."""
    return f"""{name}_n AS (SELECT id, count(*) AS n FROM {prints} GROUP BY 1),
{name}_s AS (SELECT p.a, p.b, count(*) AS s FROM (SELECT DISTINCT a, b FROM {pairs}) p JOIN {prints} l ON l.id=p.a
 JOIN {prints} r ON r.id=p.b AND r.bit=l.bit GROUP BY 1,2),
{name} AS MATERIALIZED (SELECT p.a, p.b, coalesce(s::DOUBLE/(x.n+y.n-s), 0.0) AS sim FROM (SELECT DISTINCT a, b FROM {pairs}) p
 LEFT JOIN {name}_s q ON q.a=p.a AND q.b=p.b LEFT JOIN {name}_n x ON x.id=p.a LEFT JOIN {name}_n y ON y.id=p.b)"""


MICRO = "lambda x: round_even(x*1e6, 0)::BIGINT"
