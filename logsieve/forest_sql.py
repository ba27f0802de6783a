"""The isolation forest in plain SQL: draws, growth level by level, and scores.

The statements repeat the numbers of ``operators/iforest.py`` (digits of md5 and arithmetic), so another
engine grows the same trees from the relation ``feat`` (event_id and one column for each feature).
"""

from __future__ import annotations

from . import fixed_values as fv
from .operators.iforest import PRIME, _EULER, draw_factors


def digits(text: str, start: int, count: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, {count}))::BIGINT"


def average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {_EULER}::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END"


def forest_parts(trees: int = fv.FOREST_TREES, sample: int = fv.FOREST_SAMPLE_SIZE, seed: int = fv.FOREST_SEED, depth: int = 8) -> list[str]:
    """Named sub-queries up to ``raw`` (event_id, raw) and ``nodes``; ``depth`` is log2 of the sample size."""
    factors = draw_factors(trees, seed)
    values = ", ".join(f"({tree}, " + ", ".join(str(part[tree]) for part in factors) + ")" for tree in range(trees))
    names = ", ".join(f"{{'f': {at}, 'x': {name}::DOUBLE}}" for at, name in enumerate(fv.FEATURE_NAMES))
    row = f"'{seed}:row:' || event_id::VARCHAR"
    parts = [
        f"vals AS MATERIALIZED (SELECT event_id, u.f AS f, u.x AS x FROM (SELECT event_id, unnest([{names}]) AS u FROM feat))",
        f"factor AS (SELECT * FROM (VALUES {values}) AS t(tree, a, b, c, d, e, g))",
        "chance AS (SELECT *, 1.0::DOUBLE - pow(1.0::DOUBLE - alone, "
        f"{trees}) AS overall FROM (SELECT count(*) AS n, least(1.0::DOUBLE, (1.5::DOUBLE * least({sample}, count(*)) + 64.0::DOUBLE) / count(*)) AS alone FROM feat))",
        f"numbers AS (SELECT event_id, {digits(row, 1, 8)} % {PRIME} AS x, {digits(row, 9, 8)} % {PRIME} AS y FROM feat, chance "
        f"WHERE {digits(row, 17, 12)} / {float(1 << 48)}::DOUBLE < overall)",
        f"drawn AS (SELECT tree, event_id, ((a * x + b * y + c) % {PRIME}) * {PRIME} + (d * x + e * y + g) % {PRIME} AS draw FROM numbers, factor)",
        "s0 AS MATERIALIZED (SELECT tree, event_id, 0::BIGINT AS node FROM drawn, chance "
        f"WHERE draw::DOUBLE < alone / overall * {float(PRIME)}::DOUBLE * {float(PRIME)}::DOUBLE "
        f"QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, event_id) <= {sample})",
    ]
    node = f"'{seed}:node:' || tree::VARCHAR || ':' || node::VARCHAR"
    for level in range(depth + 1):
        split = f"size > 1 AND len(ranges) > 0 AND {level} < {depth}"
        which = f"ranges[floor({digits(node, 1, 12)} / {float(1 << 48)}::DOUBLE * len(ranges))::BIGINT + 1]"
        parts.append(f"""n{level} AS MATERIALIZED (
  WITH spread AS (
    SELECT tree, node, f, min(x) AS low, max(x) AS high FROM s{level} JOIN vals USING (event_id) GROUP BY ALL),
  sizes AS (SELECT tree, node, count(*) AS size FROM s{level} GROUP BY ALL),
  listed AS (
    SELECT tree, node, coalesce(list(struct_pack(f := f, low := low, high := high) ORDER BY f) FILTER (high > low), []) AS ranges FROM spread GROUP BY ALL),
  chosen AS (SELECT tree, node, size, CASE WHEN {split} THEN {which} END AS pick FROM sizes JOIN listed USING (tree, node)),
  cut AS (SELECT *, pick.low + {digits(node, 13, 12)} / {float(1 << 48)}::DOUBLE * (pick.high - pick.low) AS t FROM chosen)
  SELECT tree, node, CASE WHEN pick IS NULL THEN -1 ELSE pick.f END AS feature,
         CASE WHEN t >= pick.high THEN pick.low ELSE t END AS threshold, size,
         CASE WHEN pick IS NULL THEN {level} + {average_path('size')} ELSE 0.0::DOUBLE END AS path_length FROM cut)""")
        if level < depth:
            parts.append(
                f"s{level + 1} AS MATERIALIZED (SELECT s.tree, s.event_id, 2 * s.node + CASE WHEN x > threshold THEN 2 ELSE 1 END AS node "
                f"FROM s{level} s JOIN n{level} n USING (tree, node) JOIN vals v ON v.event_id = s.event_id AND v.f = n.feature)")
    parts.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{level}" for level in range(depth + 1)) + ")")
    parts.append(f"t0 AS (SELECT event_id, tree, 0::BIGINT AS node FROM feat, (SELECT unnest(range({trees})) AS tree))")
    for level in range(depth):
        parts.append(
            f"t{level + 1} AS MATERIALIZED (SELECT t.event_id, t.tree, 2 * t.node + CASE WHEN x > threshold THEN 2 ELSE 1 END AS node "
            f"FROM t{level} t JOIN n{level} n USING (tree, node) JOIN vals v ON v.event_id = t.event_id AND v.f = n.feature)")
    ends = " UNION ALL ".join(
        f"SELECT event_id, tree, path_length FROM t{level} JOIN n{level} USING (tree, node) WHERE feature < 0" for level in range(depth + 1))
    usual = f"(SELECT {average_path(f'least({sample}, n)')} FROM chance)"
    parts.append(
        f"raw AS MATERIALIZED (SELECT event_id, pow(2.0::DOUBLE, -(list_sum(list(path_length ORDER BY tree)) / {trees}) / {usual}) AS raw FROM ({ends}) GROUP BY 1)")
    parts.append("scored AS MATERIALIZED (SELECT event_id, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS score FROM raw)")
    return parts
