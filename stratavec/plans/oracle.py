"""DuckDB text of the panel's base relations, independent of the DataFrame code and generated from the same settings."""

from __future__ import annotations

from stratavec.config import DEFAULT, PanelConfig

_DIST = "round(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip({a}, {b})]), 9)"


def base(cfg: PanelConfig = DEFAULT) -> str:
    """CTEs gal, vec, codes, cb, pstat and sc (sc holds all pairs of queries and items)."""
    K, out = cfg.codes, []
    out.append(f"g AS (SELECT vec_id::BIGINT AS item_id, embedding::DOUBLE[] AS x, label::BIGINT AS label, row_number() OVER (ORDER BY sha256('{cfg.seed}:' || vec_id), vec_id) - 1 AS rk, count(*) OVER () AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0)")
    out.append("gal0 AS (SELECT item_id, x, label, CASE WHEN rk * 100 < 20 * n AND rk < 5000 THEN 'calibration' WHEN rk * 100 < 25 * n AND rk < 5500 THEN 'validation' WHEN rk * 100 < 35 * n AND rk < 6000 THEN 'test' ELSE 'pool' END AS role FROM g)")
    out.append("gal AS (SELECT item_id, role, label FROM gal0)")
    out.append("vec AS (SELECT item_id, x FROM gal0)")
    out.append(f"t0 AS (SELECT item_id, row_number() OVER (ORDER BY sha256('{cfg.seed + 6}:' || item_id), item_id) - 1 AS k FROM gal WHERE role = 'pool')")
    out.append("r0 AS (SELECT v.item_id, v.x AS r, t.k FROM vec v LEFT JOIN t0 t USING (item_id))")
    for t in range(cfg.stages):
        out.append(f"i{t} AS (SELECT k - {t * K} AS code, r AS c FROM r{t} WHERE k BETWEEN {t * K} AND {t * K + K - 1})")
        out.append(f"x{t} AS (SELECT item_id, any_value(r) AS r, arg_min(code, (d, code)) AS code FROM (SELECT a.item_id, a.r, i.code, {_DIST.format(a='a.r', b='i.c')} AS d FROM r{t} a, i{t} i WHERE a.k < {cfg.train_rows}) GROUP BY item_id)")
        out.append(f"m{t} AS (SELECT code, list(v ORDER BY dim) AS c FROM (SELECT code, dim, round(avg(v), 9) AS v FROM (SELECT code, unnest(r) AS v, generate_subscripts(r, 1) AS dim FROM x{t}) GROUP BY code, dim) GROUP BY code)")
        out.append(f"b{t} AS (SELECT i.code, coalesce(m.c, i.c) AS c FROM i{t} i LEFT JOIN m{t} m USING (code))")
        out.append(f"a{t} AS (SELECT item_id, arg_min(code, (d, code)) AS code FROM (SELECT a.item_id, b.code, {_DIST.format(a='a.r', b='b.c')} AS d FROM r{t} a, b{t} b) GROUP BY item_id)")
        out.append(f"r{t + 1} AS (SELECT r.item_id, [p[1] - p[2] for p in list_zip(r.r, b.c)] AS r, r.k FROM r{t} r JOIN a{t} a USING (item_id) JOIN b{t} b USING (code))")
    out.append("codes AS (" + " UNION ALL ".join(f"SELECT item_id, {t}::BIGINT AS stage, code FROM a{t}" for t in range(cfg.stages)) + ")")
    out.append("cb AS (" + " UNION ALL ".join(f"SELECT {t}::BIGINT AS stage, code, c FROM b{t}" for t in range(cfg.stages)) + ")")
    opts = []
    for j, length in enumerate(cfg.lengths):
        opts.append(f"SELECT v.item_id, {j + 1}::BIGINT AS option, v.x, [p[1] - p[2] for p in list_zip(v.x, r.r)] AS y FROM vec v JOIN r{length} r USING (item_id)")
    out.append("rec AS (" + " UNION ALL ".join(opts) + ")")
    out.append("pstat AS (SELECT item_id, option, sqrt(list_inner_product(y, y)) AS norm, list_inner_product(x, y) / greatest(sqrt(list_inner_product(y, y)), 1e-12) / sqrt(list_inner_product(x, x)) AS cos, y FROM rec)")
    cols = ", ".join(f"round(list_inner_product(q.x, p{j + 1}.y) / greatest(p{j + 1}.norm, 1e-12), 9) AS a{j + 1}" for j in range(len(cfg.lengths)))
    joins = " ".join(f"JOIN pstat p{j + 1} ON p{j + 1}.item_id = v.item_id AND p{j + 1}.option = {j + 1}" for j in range(len(cfg.lengths)))
    out.append(f"sc AS (SELECT q.item_id AS query_id, v.item_id, round(list_inner_product(q.x, v.x), 9) AS f, {cols} FROM gal0 q JOIN vec v ON q.role <> 'pool' AND q.item_id <> v.item_id {joins})")
    return ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)
