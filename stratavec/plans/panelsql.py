"""The panel's relational queries: one portable SQL text each, over base relations that each engine makes in its own way.

Spark reads gal, vec, codes, cb, pstat and sc as views over DataFrame plans (stratavec.plans.state); the oracle makes
the same relations from the raw table in DuckDB's SQL (stratavec.plans.oracle). Scores are rounded to 9 decimals before
any ranking and ties go to the smaller id; results are rounded to 6 decimals.
"""

from __future__ import annotations

import re

from stratavec.config import DEFAULT, PanelConfig
from stratavec.functions import student_t_quantile

#: Resamples of the bootstrap queries.
BOOTSTRAPS = 50
#: Random allocations that the chosen one is compared with.
RANDOM_SEEDS = 5
#: Upper share of the scores that the tail is fitted to, and the least number of them.
TAIL = 0.05
TAIL_ROWS = 50
#: Allocation strategies that spend the budget by a risk: name -> risk of (item_id, opt) as SQL.
STRATEGIES = {
    "ordinal": "SELECT item_id, opt, round(v * 1e3, 6) AS v FROM risk",
    "per_exposure": "SELECT r.item_id, r.opt, round(r.v * 1e3 / greatest(c.n, 1), 6) AS v FROM risk r JOIN cov c ON c.item_id = r.item_id",
    "frequency": "SELECT item_id, opt, CAST(v AS DOUBLE) AS v FROM freq",
    "reconstruction": "SELECT item_id, option AS opt, round(1e0 - cos, 6) AS v FROM pstat",
    "query_ip": "SELECT item_id, opt, round(v * 1e3, 6) AS v FROM qip",
}
#: Strategies that keep what `ordinal` gives items seen in calibration and spend the rest on unseen ones by another risk.
FALLBACKS = {"unseen_reconstruction": "reconstruction", "unseen_query_ip": "query_ip"}


def sources() -> str:
    """(strategy, item_id, opt, v) of all strategies."""
    return " UNION ALL ".join(f"SELECT '{name}' AS strategy, item_id, opt, v FROM ({sql}) t" for name, sql in STRATEGIES.items())


def allocation_oracle(cfg: PanelConfig = DEFAULT) -> str:
    """DuckDB CTEs from srisk, cov and opts to allocs: hull steps by self-joins, the budget by running sums."""
    budget = f"(SELECT count(*) * {cfg.cost(cfg.target)} FROM gal)"

    def solved(name: str, rows: str, limit: str) -> list[str]:
        step = "JOIN {n}_x b ON b.strategy = a.strategy AND b.item_id = a.item_id AND b.from_opt = a.to_opt".format(n=name)
        steps = [f"{name}_1 AS (SELECT strategy, item_id, from_opt, to_opt, slope FROM {name}_x WHERE from_opt = 1)"]
        steps += [f"{name}_{i} AS (SELECT b.strategy, b.item_id, b.from_opt, b.to_opt, b.slope FROM {name}_{i - 1} a {step})" for i in range(2, len(cfg.lengths))]
        every = " UNION ALL ".join(f"SELECT * FROM {name}_{i}" for i in range(1, len(cfg.lengths)))
        return [
            f"{name}_r AS MATERIALIZED ({rows})",
            f"{name}_x AS MATERIALIZED (SELECT strategy, item_id, from_opt, arg_max(to_opt, (slope, to_opt)) AS to_opt, max(slope) AS slope FROM (SELECT a.strategy, a.item_id, a.opt AS from_opt, b.opt AS to_opt, round((a.v - b.v) / (p.cost - o.cost), 9) AS slope FROM {name}_r a JOIN {name}_r b ON b.strategy = a.strategy AND b.item_id = a.item_id AND b.opt > a.opt AND b.v < a.v JOIN opts o ON o.opt = a.opt JOIN opts p ON p.opt = b.opt) t WHERE slope > 0 GROUP BY strategy, item_id, from_opt)",
            *steps,
            f"{name}_s AS MATERIALIZED (SELECT s.*, p.cost - o.cost AS extra, sum(p.cost - o.cost) OVER (PARTITION BY strategy ORDER BY slope DESC, item_id, from_opt ROWS UNBOUNDED PRECEDING) AS spent FROM ({every}) s JOIN opts o ON o.opt = s.from_opt JOIN opts p ON p.opt = s.to_opt)",
            f"{name}_a AS MATERIALIZED (SELECT r.strategy, r.item_id, coalesce(max(s.to_opt), 1) AS opt FROM (SELECT DISTINCT strategy, item_id FROM {name}_r) r LEFT JOIN {name}_s s ON s.strategy = r.strategy AND s.item_id = r.item_id AND s.spent <= {limit} GROUP BY r.strategy, r.item_id)",
        ]

    seen = "SELECT a.item_id, a.opt FROM al_a a JOIN cov c ON c.item_id = a.item_id AND c.n > 0 WHERE a.strategy = 'ordinal'"
    left = f"({budget} - (SELECT coalesce(sum(o.cost), 0) FROM ({seen}) s JOIN opts o ON o.opt = s.opt))"
    cases = " ".join(f"WHEN '{base}' THEN '{name}'" for name, base in FALLBACKS.items())
    unseen = f"SELECT CASE r.strategy {cases} END AS strategy, r.item_id, r.opt, r.v FROM srisk r JOIN cov c ON c.item_id = r.item_id AND c.n = 0 WHERE r.strategy IN ({', '.join(repr(b) for b in FALLBACKS.values())})"
    names = " UNION ALL ".join(f"SELECT '{name}' AS strategy" for name in FALLBACKS)
    target = cfg.lengths.index(cfg.target) + 1
    parts = [*solved("al", "SELECT * FROM srisk", budget), *solved("un", unseen, left)]
    parts.append(f"allocs AS MATERIALIZED (SELECT strategy, item_id, opt FROM al_a UNION ALL SELECT 'uniform', item_id, {target} FROM gal UNION ALL SELECT strategy, item_id, opt FROM un_a UNION ALL SELECT n.strategy, s.item_id, s.opt FROM ({seen}) s CROSS JOIN ({names}) n)")
    return ",\n".join(parts)
#: The few functions that the engines spell differently: @sha<x> is the hex SHA-256 of x, @int<x> its first 32 bits.
SPARK = {"series": r"(SELECT id AS i FROM range(\1))", "sha": r"sha2(\1, 256)", "int": r"CAST(conv(substr(sha2(\1, 256), 1, 8), 16, 10) AS BIGINT)"}
DUCKDB = {"series": r"(SELECT range AS i FROM range(\1))", "sha": r"sha256(\1)", "int": r"CAST(concat('0x', substr(sha256(\1), 1, 8)) AS BIGINT)"}


def _spelled(sql: str, engine: dict[str, str]) -> str:
    for name, form in engine.items():
        sql = re.sub(rf"@{name}<([^<>]*)>", form, sql)
    return sql


def fragments(cfg: PanelConfig = DEFAULT) -> dict[str, str]:
    """Named sub-queries in dependency order."""
    k, hard, depth = cfg.k, cfg.hard, cfg.rerank
    options = " UNION ALL ".join(f"SELECT CAST({j + 1} AS BIGINT) AS opt, CAST({n} AS BIGINT) AS len, CAST({cfg.cost(n)} AS BIGINT) AS cost" for j, n in enumerate(cfg.lengths))
    wide = " UNION ALL ".join(f"SELECT query_id, item_id, f, CAST({j + 1} AS BIGINT) AS opt, a{j + 1} AS a FROM hd" for j in range(len(cfg.lengths)))
    tops = " UNION ALL ".join(f"SELECT query_id, CAST({j + 1} AS BIGINT) AS opt, item_id, f, a{j + 1} AS a FROM sc" for j in range(len(cfg.lengths)))
    near = {"near": "round(abs(f - tau), 9)", "over": "-round(a1 - f, 9)", "base": "-a1"}
    ranks = ", ".join(f"row_number() OVER (PARTITION BY query_id, positive ORDER BY {e}, item_id) AS by_{n}" for n, e in near.items())
    sigmoid = "1e0 / (1e0 + exp(-greatest(least({z}, 40e0), -40e0)))"
    soft = "(greatest({z}, 0e0) + ln(1e0 + exp(-abs({z}))))"
    p = sigmoid.format(z="zt")
    seeds = " UNION ALL ".join(f"SELECT {i + 1} AS seed" for i in range(RANDOM_SEEDS))
    resamples = " UNION ALL ".join(f"SELECT {i + 1} AS b" for i in range(BOOTSTRAPS))
    kl = f"greatest({soft.format(z='zs')} - {p} * zs - ({soft.format(z='zt')} - {p} * zt), 0e0)"
    return {
        "opts": options,
        "te": f"SELECT query_id, item_id, f, CAST(r AS BIGINT) AS rk FROM (SELECT query_id, item_id, f, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, item_id) AS r FROM sc) t WHERE r <= {k + max(hard, 1) + 1}",
        "cut": f"SELECT a.query_id, a.rk AS c, (a.f + b.f) / 2e0 AS tau FROM te a JOIN te b ON a.query_id = b.query_id AND b.rk = a.rk + 1 WHERE a.rk <= {k}",
        "sg": f"SELECT a.query_id, c.tau, greatest(a.f - b.f, 1e-9) AS sigma FROM te a JOIN te b ON a.query_id = b.query_id AND a.rk = {k} AND b.rk = {k + hard} JOIN cut c ON c.query_id = a.query_id AND c.c = {k}",
        "cd": f"SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY a1 DESC, item_id) AS br FROM sc) t WHERE br <= {depth}",
        "cl": f"SELECT cd.*, sg.tau, sg.sigma, coalesce(te.rk - 1, {k}) AS trk, CASE WHEN te.rk <= {k} THEN 1 ELSE 0 END AS positive FROM cd JOIN gal q ON q.item_id = cd.query_id AND q.role = 'calibration' JOIN sg ON sg.query_id = cd.query_id LEFT JOIN te ON te.query_id = cd.query_id AND te.item_id = cd.item_id AND te.rk <= {k}",
        "mn": f"SELECT cl.*, {ranks} FROM cl",
        "hd": f"SELECT * FROM mn WHERE positive = 1 OR by_near <= {hard} OR by_over <= {hard} OR by_base <= {hard}",
        "cov": "SELECT g.item_id, count(h.item_id) AS n FROM gal g LEFT JOIN hd h ON h.item_id = g.item_id GROUP BY g.item_id",
        "lb": "SELECT hd.query_id, hd.item_id, cut.c, cut.tau AS tau_c, hd.sigma, hd.f, CASE WHEN hd.trk < cut.c THEN 1 ELSE 0 END AS y FROM hd JOIN cut ON cut.query_id = hd.query_id",
        "wt": "SELECT lb.*, CASE WHEN min(y) OVER (PARTITION BY query_id, c) = max(y) OVER (PARTITION BY query_id, c) THEN 1e0 ELSE 5e-1 END / count(*) OVER (PARTITION BY query_id, c, y) AS w FROM lb",
        "ap": wide,
        "nq": "SELECT count(*) AS n FROM gal WHERE role = 'calibration'",
        "ot": f"SELECT item_id, opt, c, w * {kl} AS v FROM (SELECT wt.item_id, ap.opt, wt.c, wt.w, (wt.f - wt.tau_c) / wt.sigma AS zt, (ap.a - wt.tau_c) / wt.sigma AS zs FROM wt JOIN ap ON ap.query_id = wt.query_id AND ap.item_id = wt.item_id) t",
        "risk": f"SELECT g.item_id, o.opt, round(coalesce(t.v, 0e0) / ({k} * nq.n), 12) AS v FROM gal g CROSS JOIN opts o CROSS JOIN nq LEFT JOIN (SELECT item_id, opt, sum(v) AS v FROM ot GROUP BY item_id, opt) t ON t.item_id = g.item_id AND t.opt = o.opt",
        "brisk": f"SELECT item_id, opt, sum(v) / max(nq.n) AS v FROM ot CROSS JOIN nq WHERE c = {k} GROUP BY item_id, opt",
        "adc": f"SELECT query_id, opt, item_id, f, a, rk FROM (SELECT t.*, CAST(row_number() OVER (PARTITION BY t.query_id, t.opt ORDER BY t.a DESC, t.item_id) AS BIGINT) AS rk FROM ({tops}) t JOIN gal q ON q.item_id = t.query_id AND q.role = 'test') t WHERE rk <= {k}",
        "hits": f"SELECT adc.query_id, adc.opt, adc.item_id, adc.rk, adc.f, adc.a, CASE WHEN te.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM adc LEFT JOIN te ON te.query_id = adc.query_id AND te.item_id = adc.item_id AND te.rk <= {k}",
        "rcl": f"SELECT query_id, opt, sum(hit) / {k}e0 AS recall FROM hits GROUP BY query_id, opt",
        "idcg": f"SELECT query_id, sum((power(2e0, f) - 1e0) / log2(rk + 1e0)) AS idcg FROM te WHERE rk <= {k} GROUP BY query_id",
        "ndcg": "SELECT h.query_id, h.opt, sum((power(2e0, h.f) - 1e0) / log2(h.rk + 1e0)) / max(greatest(i.idcg, 1e-9)) AS ndcg FROM hits h JOIN idcg i ON i.query_id = h.query_id GROUP BY h.query_id, h.opt",
        "rel": "SELECT h.query_id, h.opt, h.rk, CASE WHEN g.label = q.label THEN 1 ELSE 0 END AS y FROM hits h JOIN gal g ON g.item_id = h.item_id JOIN gal q ON q.item_id = h.query_id AND q.label >= 0",
        "nrel": "SELECT q.item_id AS query_id, l.n - 1 AS n FROM gal q JOIN (SELECT label, count(*) AS n FROM gal GROUP BY label) l ON l.label = q.label WHERE q.role = 'test' AND q.label >= 0",
        "ap10": f"SELECT t.query_id, t.opt, CASE WHEN max(n.n) = 0 THEN NULL ELSE sum(CASE WHEN y = 1 THEN run / CAST(rk AS DOUBLE) ELSE 0e0 END) / least(max(n.n), {k}) END AS ap FROM (SELECT rel.*, sum(y) OVER (PARTITION BY query_id, opt ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM rel) t JOIN nrel n ON n.query_id = t.query_id GROUP BY t.query_id, t.opt",
        "clus": "SELECT item_id, code AS cluster FROM codes WHERE stage = 0",
        "lam": "SELECT item_id, opt, cost FROM (SELECT r.item_id, r.opt, o.cost, row_number() OVER (PARTITION BY r.item_id ORDER BY round(r.v * 1e6 + 5e-1 * o.cost, 9), o.cost) AS n FROM risk r JOIN opts o ON o.opt = r.opt) t WHERE n = 1",
        "freq": "SELECT c.item_id, o.opt, c.n * (m.len - o.len) AS v FROM cov c CROSS JOIN opts o CROSS JOIN (SELECT max(len) AS len FROM opts) m",
        "srisk": sources(),
        "allocs": "SELECT * FROM allocs",
        "alloc": "SELECT a.item_id, a.opt, o.len FROM allocs a JOIN opts o ON o.opt = a.opt WHERE a.strategy = 'ordinal'",
        "spans": "SELECT opt, len, items, CAST(sum(items) OVER (ORDER BY opt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - items AS BIGINT) AS row_start, CAST(sum(items) OVER (ORDER BY opt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS row_end FROM (SELECT opt, len, count(*) AS items FROM alloc GROUP BY opt, len) t",
        "sal": f"SELECT a.seed, a.item_id, min(h.opt) AS opt FROM (SELECT d.seed, g.item_id, @int<concat(d.seed, ':', g.item_id)> / 4294967296e0 AS u FROM gal g CROSS JOIN ({seeds}) d) a CROSS JOIN (SELECT count(*) AS n FROM gal) t JOIN spans h ON a.u * t.n < h.row_end GROUP BY a.seed, a.item_id",
        "scored": f"SELECT cd.query_id, cd.item_id, cd.f, o.opt, CASE o.opt {' '.join(f'WHEN {j + 1} THEN a{j + 1}' for j in range(len(cfg.lengths)))} END AS s FROM cd JOIN gal q ON q.item_id = cd.query_id AND q.role = 'test' CROSS JOIN opts o",
        "srec": f"SELECT strategy, query_id, sum(hit) / {k}e0 AS recall FROM (SELECT t.strategy, t.query_id, CASE WHEN te.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT a.strategy, c.query_id, c.item_id, row_number() OVER (PARTITION BY a.strategy, c.query_id ORDER BY c.s DESC, c.item_id) AS rk FROM scored c JOIN allocs a ON a.item_id = c.item_id AND a.opt = c.opt) t LEFT JOIN te ON te.query_id = t.query_id AND te.item_id = t.item_id AND te.rk <= {k} WHERE t.rk <= {k}) t GROUP BY strategy, query_id",
        "rrec": f"SELECT seed, query_id, sum(hit) / {k}e0 AS recall FROM (SELECT t.seed, t.query_id, CASE WHEN te.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT a.seed, c.query_id, c.item_id, row_number() OVER (PARTITION BY a.seed, c.query_id ORDER BY c.s DESC, c.item_id) AS rk FROM scored c JOIN sal a ON a.item_id = c.item_id AND a.opt = c.opt) t LEFT JOIN te ON te.query_id = t.query_id AND te.item_id = t.item_id AND te.rk <= {k} WHERE t.rk <= {k}) t GROUP BY seed, query_id",
        "dlt": "SELECT 'ordinal' AS cell, d.seed, o.query_id, o.recall - u.recall AS delta FROM srec o JOIN srec u ON u.query_id = o.query_id AND u.strategy = 'uniform' CROSS JOIN (SELECT DISTINCT seed FROM rrec) d WHERE o.strategy = 'ordinal' UNION ALL SELECT 'random' AS cell, r.seed, r.query_id, r.recall - u.recall AS delta FROM rrec r JOIN srec u ON u.query_id = r.query_id AND u.strategy = 'uniform'",
        "qidx": "SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM (SELECT DISTINCT query_id FROM rrec) t",
        "two": f"SELECT query_id, item_id, s, CAST(rk AS BIGINT) AS rk FROM (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rk FROM (SELECT cd.query_id, cd.item_id, CASE a.opt {' '.join(f'WHEN {j + 1} THEN a{j + 1}' for j in range(len(cfg.lengths)))} END AS s FROM cd JOIN gal q ON q.item_id = cd.query_id AND q.role = 'test' JOIN alloc a ON a.item_id = cd.item_id) t) t WHERE rk <= {k}",
        "pd": f"SELECT a.query_id, b.recall - a.recall AS delta, row_number() OVER (ORDER BY a.query_id) - 1 AS idx FROM rcl a JOIN rcl b ON b.query_id = a.query_id AND a.opt = 1 AND b.opt = {len(cfg.lengths)}",
        "draws": f"SELECT b.b, p.idx AS slot, @int<concat('{cfg.seed}:', b.b, ':', p.idx)> % n.n AS pick FROM ({resamples}) b CROSS JOIN pd p CROSS JOIN (SELECT count(*) AS n FROM pd) n",
        "boot": "SELECT d.b, avg(p.delta) AS m FROM draws d JOIN pd p ON p.idx = d.pick GROUP BY d.b",
        "bseed": f"SELECT b, pick + 1 AS seed, count(*) AS w FROM (SELECT b.b, @int<concat('{cfg.seed}:s:', b.b, ':', s.seed)> % {RANDOM_SEEDS} AS pick FROM ({resamples}) b CROSS JOIN ({seeds}) s) t GROUP BY b, pick",
        "bquery": f"SELECT t.b, q.query_id, count(*) AS w FROM (SELECT b.b, @int<concat('{cfg.seed}:q:', b.b, ':', i.idx)> % n.n AS pick FROM ({resamples}) b CROSS JOIN qidx i CROSS JOIN (SELECT count(*) AS n FROM qidx) n) t JOIN qidx q ON q.idx = t.pick GROUP BY t.b, q.query_id",
        "cross_": f"SELECT d.cell, q.b, sum(d.delta * q.w * s.w) / (max(n.n) * {RANDOM_SEEDS}e0) AS m FROM dlt d JOIN bquery q ON q.query_id = d.query_id JOIN bseed s ON s.b = q.b AND s.seed = d.seed CROSS JOIN (SELECT count(*) AS n FROM qidx) n GROUP BY d.cell, q.b",
        "est": "SELECT cell, avg(delta) AS est FROM dlt GROUP BY cell",
        "tot": "SELECT item_id, max(v) - min(v) AS gain FROM risk GROUP BY item_id",
        "rgain": "SELECT item_id, round(gain, 12) AS gain, row_number() OVER (ORDER BY round(gain, 12), item_id) AS i FROM tot",
        "rnk": f"SELECT item_id, row_number() OVER (ORDER BY @sha<concat('{cfg.seed}:', item_id)>, item_id) - 1 AS rk FROM gal",
        "half": "SELECT c.item_id, count(h.item_id) AS n FROM gal c LEFT JOIN (SELECT hd.item_id FROM hd JOIN (SELECT query_id, row_number() OVER (ORDER BY @sha<concat('33:', query_id)>, query_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM hd) t) q ON q.query_id = hd.query_id WHERE 2 * q.r <= q.n) h ON h.item_id = c.item_id GROUP BY c.item_id",
    }


def chao(counts: str, asked: str) -> str:
    """f1, f2, seen, q and f0 (items still unseen, at most the rest of the pool) of a table of counts by item; asked: its queries."""
    rest = "greatest(pool - seen, 0)"
    return f"SELECT f1, f2, seen, q, least(CASE WHEN f2 > 0 THEN (q - 1e0) / q * f1 * f1 / (2e0 * f2) WHEN f1 > 0 THEN (q - 1e0) / q * f1 * (f1 - 1) / 2e0 ELSE 0e0 END, {rest}) AS f0 FROM (SELECT count(CASE WHEN n = 1 THEN 1 END) AS f1, count(CASE WHEN n = 2 THEN 1 END) AS f2, count(CASE WHEN n > 0 THEN 1 END) AS seen, count(*) AS pool FROM {counts}) t CROSS JOIN ({asked}) q"


def queries(cfg: PanelConfig = DEFAULT) -> dict[str, str]:
    """Query name -> SQL over fragments and base relations."""
    k, last = cfg.k, len(cfg.lengths)
    target = cfg.lengths.index(cfg.target) + 1
    bits = cfg.code_bits
    top, bottom = cfg.lengths[-1], cfg.lengths[0]
    return {
        "scan_gallery": "SELECT count(*) AS items, min(item_id) AS first_id, max(item_id) AS last_id, count(DISTINCT label) AS labels FROM gal",
        "role_split": "SELECT role, count(*) AS items FROM gal GROUP BY role",
        "role_overlap": "SELECT count(*) AS overlapping FROM (SELECT item_id FROM gal GROUP BY item_id HAVING count(DISTINCT role) > 1) t",
        "codec_pool": "SELECT g.item_id FROM gal g WHERE NOT EXISTS (SELECT 1 FROM gal q WHERE q.item_id = g.item_id AND q.role <> 'pool')",
        "eligible_classes": "SELECT label, count(*) AS items FROM gal GROUP BY label HAVING count(*) >= 4",
        "distinct_labels": "SELECT role, count(DISTINCT label) AS labels FROM gal GROUP BY role",
        "id_lookup": "SELECT t.query_id, t.item_id, g.role FROM te t JOIN gal g ON g.item_id = t.item_id WHERE t.rk = 1",
        "label_lookup": "SELECT g.item_id, coalesce(l.label, -1) AS label FROM gal g LEFT JOIN (SELECT item_id, label FROM gal WHERE role = 'pool') l ON l.item_id = g.item_id",
        "rq_encode": "SELECT item_id, stage, code FROM codes",
        "prefix_stats": "SELECT item_id, option AS opt, round(norm, 6) AS norm, round(1e0 - cos, 6) AS distortion FROM pstat",
        "prefix_scores": f"SELECT query_id, item_id, round(f, 6) AS f, {', '.join(f'round(a{j + 1}, 6) AS a{j + 1}' for j in range(last))} FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.f DESC, sc.item_id) AS r FROM sc JOIN gal q ON q.item_id = sc.query_id AND q.role = 'test') t WHERE r <= {k}",
        "base_candidates": "SELECT cd.query_id, cd.item_id, CAST(br AS BIGINT) AS base_rank FROM cd JOIN gal q ON q.item_id = cd.query_id AND q.role = 'validation'",
        "candidate_recall_curve": f"SELECT CAST(d.depth AS BIGINT) AS depth, round(avg(CASE WHEN cd.br <= d.depth THEN 1e0 ELSE 0e0 END), 6) AS recall FROM te JOIN gal q ON q.item_id = te.query_id AND q.role = 'validation' CROSS JOIN (VALUES (10), (20), (40), (60), (80), (100)) AS d(depth) LEFT JOIN cd ON cd.query_id = te.query_id AND cd.item_id = te.item_id WHERE te.rk <= {k} GROUP BY d.depth",
        "rerank_depth": f"SELECT CAST(min(depth) AS BIGINT) AS depth FROM (SELECT d.depth, avg(CASE WHEN cd.br <= d.depth THEN 1e0 ELSE 0e0 END) AS recall FROM te JOIN gal q ON q.item_id = te.query_id AND q.role = 'validation' CROSS JOIN (VALUES (10), (20), (40), (60), (80), (100)) AS d(depth) LEFT JOIN cd ON cd.query_id = te.query_id AND cd.item_id = te.item_id WHERE te.rk <= {k} GROUP BY d.depth) t WHERE recall >= 5e-1",
        "mined_candidates": "SELECT query_id, item_id, CAST(positive AS BIGINT) AS positive, CAST(trk AS BIGINT) AS teacher_rank FROM hd",
        "exposure_coverage": "SELECT item_id, n AS queries FROM cov",
        "unseen_items": "SELECT item_id FROM cov WHERE n = 0",
        "balanced_weights": "SELECT query_id, c AS cutoff, CAST(y AS BIGINT) AS y, count(*) AS items, round(sum(w), 6) AS weight FROM wt GROUP BY query_id, c, y",
        "bernoulli_kl": "SELECT opt, c AS cutoff, round(sum(v), 6) AS divergence FROM ot GROUP BY opt, c",
        "ordinal_kl_risk": "SELECT item_id, opt, round(v * 1e3, 6) AS risk FROM risk",
        "boundary_kl_risk": "SELECT item_id, opt, round(v * 1e3, 6) AS risk FROM brisk",
        "risk_per_exposure": "SELECT r.item_id, r.opt, round(r.v * 1e3 / greatest(c.n, 1), 6) AS risk FROM risk r JOIN cov c ON c.item_id = r.item_id",
        "frequency_risk": "SELECT item_id, opt, CAST(v AS BIGINT) AS risk FROM freq",
        "cluster_risk": "SELECT c.cluster, r.opt, count(*) AS items, round(sum(r.v) * 1e3, 6) AS risk FROM risk r JOIN clus c ON c.item_id = r.item_id GROUP BY c.cluster, r.opt",
        "cluster_histogram": "SELECT cluster, count(*) AS items FROM clus GROUP BY cluster",
        "lagrangian_choice_at_lambda": "SELECT item_id, opt, cost FROM lam",
        "alloc_uniform": f"SELECT g.item_id, o.opt, o.len FROM gal g JOIN opts o ON o.opt = {target}",
        "alloc_fixed": f"SELECT opt, round(sum(v) * 1e3, 6) AS risk, cost * count(*) AS spent FROM (SELECT r.opt, r.v, o.cost FROM risk r JOIN opts o ON o.opt = r.opt) t GROUP BY opt, cost HAVING cost <= {cfg.cost(cfg.target)}",
        "allocation_histogram": "SELECT opt, len, count(*) AS items FROM alloc GROUP BY opt, len",
        "bucket_spans": "SELECT opt, len, items, row_start, row_end FROM spans",
        "span_check": "SELECT count(*) AS broken FROM (SELECT row_start, lag(row_end, 1, 0) OVER (ORDER BY opt) AS before FROM spans) t WHERE row_start <> before",
        "packed_ledger": f"SELECT c.cluster, a.len, count(*) AS items, CAST(ceil(count(*) * (a.len - {bottom}) * {bits} / 8e0) AS BIGINT) AS code_bytes FROM alloc a JOIN clus c ON c.item_id = a.item_id GROUP BY c.cluster, a.len",
        "storage_breakdown": f"SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(items * CAST(ceil(len * {bits} / 8e0) AS BIGINT)) AS BIGINT) AS code_bytes, CAST(sum(items) * 4 AS BIGINT) AS id_bytes, CAST(sum(items) * 2 AS BIGINT) AS norm_bytes FROM spans",
        "required_coverage": f"SELECT len AS target, round((len - {bottom}) / {top - bottom}e0, 6) AS coverage FROM opts",
        "unseen_budget": "SELECT a.strategy, CASE WHEN c.n = 0 THEN 'unseen' ELSE 'seen' END AS part, count(*) AS items, CAST(sum(o.cost) AS BIGINT) AS spent FROM allocs a JOIN cov c ON c.item_id = a.item_id JOIN opts o ON o.opt = a.opt WHERE a.strategy = 'ordinal' OR a.strategy LIKE 'unseen%' GROUP BY a.strategy, CASE WHEN c.n = 0 THEN 'unseen' ELSE 'seen' END",
        "strategy_histogram": "SELECT a.strategy, a.opt, count(*) AS items, CAST(sum(o.cost) AS BIGINT) AS spent FROM allocs a JOIN opts o ON o.opt = a.opt GROUP BY a.strategy, a.opt",
        "strategy_risk": "SELECT a.strategy, round(sum(r.v) * 1e3, 6) AS risk FROM allocs a JOIN risk r ON r.item_id = a.item_id AND r.opt = a.opt GROUP BY a.strategy",
        "strategy_recall": "SELECT strategy, round(avg(recall), 6) AS recall, count(*) AS test_queries FROM srec GROUP BY strategy",
        "strategy_comparison": "SELECT s.strategy, round(avg(s.recall - u.recall), 6) AS delta, round(stddev_samp(s.recall - u.recall), 6) AS sd, count(CASE WHEN s.recall > u.recall THEN 1 END) AS wins, count(CASE WHEN s.recall < u.recall THEN 1 END) AS losses FROM srec s JOIN srec u ON u.query_id = s.query_id AND u.strategy = 'uniform' GROUP BY s.strategy",
        "random_allocations": "SELECT s.seed, s.opt, count(*) AS items FROM sal s GROUP BY s.seed, s.opt",
        "random_recall": "SELECT seed, round(avg(recall), 6) AS recall FROM rrec GROUP BY seed",
        "adc_topk": "SELECT query_id, opt, rk, item_id, round(a, 6) AS score FROM adc",
        "two_phase_search": "SELECT query_id, rk, item_id, round(s, 6) AS score FROM two",
        "recall_at_k": "SELECT opt, round(avg(recall), 6) AS recall FROM rcl GROUP BY opt",
        "boundary_inversion": "SELECT opt, round(avg(1e0 - recall), 6) AS inversion FROM rcl GROUP BY opt",
        "candidate_recall": f"SELECT round(avg(CASE WHEN cd.item_id IS NULL THEN 0e0 ELSE 1e0 END), 6) AS recall FROM te JOIN gal q ON q.item_id = te.query_id AND q.role = 'test' LEFT JOIN cd ON cd.query_id = te.query_id AND cd.item_id = te.item_id WHERE te.rk <= {k}",
        "ndcg_at_k": "SELECT opt, round(avg(ndcg), 6) AS ndcg FROM ndcg GROUP BY opt",
        "map_at_10": "SELECT opt, round(avg(ap), 6) AS map FROM ap10 GROUP BY opt",
        "semantic_recall": "SELECT opt, round(avg(CAST(y AS DOUBLE)), 6) AS recall_1 FROM rel WHERE rk = 1 GROUP BY opt",
        "eval_panel": "SELECT r.opt, round(avg(r.recall), 6) AS recall, round(avg(n.ndcg), 6) AS ndcg, round(avg(a.ap), 6) AS map, count(*) AS test_queries FROM rcl r JOIN ndcg n ON n.query_id = r.query_id AND n.opt = r.opt LEFT JOIN ap10 a ON a.query_id = r.query_id AND a.opt = r.opt GROUP BY r.opt",
        "best_under_cap": f"SELECT family, name, round(recall, 6) AS recall FROM (SELECT t.*, row_number() OVER (PARTITION BY family ORDER BY round(recall, 9) DESC, name) AS r FROM (SELECT 'fixed' AS family, concat('length ', o.len) AS name, avg(r.recall) AS recall FROM rcl r JOIN opts o ON o.opt = r.opt WHERE o.cost <= {cfg.cost(cfg.target)} GROUP BY o.len UNION ALL SELECT 'allocated' AS family, s.strategy AS name, avg(s.recall) AS recall FROM srec s JOIN (SELECT a.strategy FROM allocs a JOIN opts o ON o.opt = a.opt GROUP BY a.strategy HAVING sum(o.cost) <= {cfg.cost(cfg.target)} * count(*)) c ON c.strategy = s.strategy GROUP BY s.strategy) t) t WHERE r = 1",
        "depth_choice": f"SELECT CAST(coalesce(min(CASE WHEN len >= {cfg.target} THEN len END), max(len)) AS BIGINT) AS len FROM opts",
        "paired_delta": f"SELECT a.query_id, round(b.recall - a.recall, 6) AS delta FROM rcl a JOIN rcl b ON b.query_id = a.query_id AND a.opt = 1 AND b.opt = {last}",
        "metric_summary": "SELECT opt, round(avg(recall), 6) AS mean, round(stddev_samp(recall), 6) AS sd, round(min(recall), 6) AS least, round(max(recall), 6) AS most FROM rcl GROUP BY opt",
        "score_quantiles": "SELECT opt, round(percentile_cont(0.05) WITHIN GROUP (ORDER BY a), 6) AS p05, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY a), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY a), 6) AS p95 FROM adc GROUP BY opt",
        "percentile_rank": "SELECT s.strategy, round(avg(CASE WHEN r.m < s.m THEN 1e0 ELSE 0e0 END), 6) AS below, round((max(s.m) - avg(r.m)) / nullif(stddev_samp(r.m), 0e0), 4) AS z, round(max(s.m) - max(r.m), 6) AS margin FROM (SELECT strategy, round(avg(recall), 9) AS m FROM srec GROUP BY strategy) s CROSS JOIN (SELECT seed, round(avg(recall), 9) AS m FROM rrec GROUP BY seed) r GROUP BY s.strategy",
        "score_histogram": f"SELECT CAST(b.bin AS BIGINT) AS bin, count(t.bin) AS pairs FROM ({' UNION ALL '.join(f'SELECT {i} AS bin' for i in range(-10, 10))}) b LEFT JOIN (SELECT CAST(least(greatest(floor(f * 10e0), -10e0), 9e0) AS INT) AS bin FROM te) t ON t.bin = b.bin GROUP BY b.bin",
        "binned_outcome": f"SELECT bin, count(*) AS items, round(avg(gain) * 1e3, 6) AS mean, round(stddev_samp(gain) * 1e3 / sqrt(count(*)), 6) AS se FROM (SELECT t.gain, CASE WHEN c.n = 0 THEN 'a 0' WHEN c.n <= 5 THEN 'b 1-5' WHEN c.n <= 15 THEN 'c 6-15' ELSE 'd over 15' END AS bin FROM tot t JOIN cov c ON c.item_id = t.item_id) t GROUP BY bin",
        "spearman": "SELECT round(corr(x.x, CASE WHEN r.gain = 0e0 THEN z.y ELSE coalesce(y.y, r.i) END), 6) AS rho FROM rgain r JOIN cov c ON c.item_id = r.item_id JOIN (SELECT n, sum(k) OVER (ORDER BY n) - (k - 1) / 2e0 AS x FROM (SELECT n, count(*) AS k FROM cov GROUP BY n) t) x ON x.n = c.n CROSS JOIN (SELECT coalesce(avg(i), 0e0) AS y FROM rgain WHERE gain = 0e0) z LEFT JOIN (SELECT gain, avg(i) AS y FROM rgain WHERE gain <> 0e0 GROUP BY gain HAVING count(*) > 1) y ON y.gain = r.gain",
        "loglog_slope": "SELECT round(regr_slope(ln(spread), ln(CAST(opt AS DOUBLE))), 6) AS slope FROM (SELECT option AS opt, avg(1e0 - cos) AS spread FROM pstat GROUP BY option) t",
        "risk_gini": "SELECT round(2e0 * sum(i * gain) / (count(*) * nullif(sum(gain), 0e0)) - (count(*) + 1e0) / nullif(count(*), 0), 6) AS gini FROM rgain",
        "risk_entropy": "SELECT round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 4) AS effective_items FROM (SELECT t.gain / s.s AS p FROM tot t CROSS JOIN (SELECT nullif(sum(gain), 0e0) AS s FROM tot) s) t WHERE p > 0",
        "risk_top_share": "SELECT round(sum(CASE WHEN (n.n - r.i + 1) * 100 <= n.n THEN gain ELSE 0e0 END) / nullif(sum(gain), 0e0), 6) AS share FROM rgain r CROSS JOIN (SELECT count(*) AS n FROM tot) n",
        "chao_coverage": f"SELECT f1, f2, seen, round(f0, 6) AS unseen_estimate, CAST(e.extra AS BIGINT) AS more_queries, round(CASE WHEN f0 > 0 THEN seen + f0 * (1e0 - power(1e0 - f1 / (q * f0 + f1), e.extra)) ELSE seen END, 6) AS expected FROM ({chao('cov', 'SELECT max(n) AS q FROM nq')}) t CROSS JOIN (SELECT 0 AS extra UNION ALL SELECT 100 AS extra UNION ALL SELECT 1000 AS extra UNION ALL SELECT 10000 AS extra) e",
        "chao_validation": f"SELECT q AS fitted_on, seen AS seen_by_half, round(CASE WHEN f0 > 0 THEN seen + f0 * (1e0 - power(1e0 - f1 / (q * f0 + f1), w.n - q)) ELSE seen END, 6) AS predicted, w.seen_all, round(abs(CASE WHEN f0 > 0 THEN seen + f0 * (1e0 - power(1e0 - f1 / (q * f0 + f1), w.n - q)) ELSE seen END - w.seen_all) / greatest(w.seen_all, 1), 6) AS relative_error FROM ({chao('half', 'SELECT CAST(floor(count(DISTINCT query_id) / 2e0) AS BIGINT) AS q FROM hd')}) t CROSS JOIN (SELECT count(DISTINCT query_id) AS n, count(DISTINCT item_id) AS seen_all FROM hd) w",
        "exposure_ecdf": "SELECT n AS queries, round(sum(k) OVER (ORDER BY n) / CAST(t.t AS DOUBLE), 6) AS share FROM (SELECT n, count(*) AS k FROM cov GROUP BY n) c CROSS JOIN (SELECT count(*) AS t FROM cov) t",
        "mining_width": f"SELECT CAST(d.depth AS BIGINT) AS depth, count(CASE WHEN m.best <= d.depth THEN 1 END) AS items FROM (VALUES (5), (10), (20), (40)) AS d(depth) CROSS JOIN (SELECT item_id, min(best) AS best FROM (SELECT item_id, row_number() OVER (PARTITION BY query_id ORDER BY a1 DESC, item_id) AS best FROM sc UNION ALL SELECT item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(a1 - f, 9) DESC, item_id) FROM sc UNION ALL SELECT item_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, item_id) FROM sc) t GROUP BY item_id) m GROUP BY d.depth",
        "workload_alignment": "SELECT count(DISTINCT c.label) AS test_labels, count(DISTINCT CASE WHEN k.label IS NOT NULL THEN c.label END) AS shared_labels FROM (SELECT label FROM gal WHERE role = 'test') c LEFT JOIN (SELECT DISTINCT label FROM gal WHERE role = 'calibration') k ON k.label = c.label",
        "workload_transfer": f"SELECT round(avg(CASE WHEN c.n > 0 THEN 1e0 ELSE 0e0 END), 6) AS needed_covered, round(avg(CAST(c.n AS DOUBLE)), 6) AS needed_exposure, round(avg(CASE WHEN a.opt = 1 THEN 1e0 ELSE 0e0 END), 6) AS starved FROM (SELECT DISTINCT te.item_id FROM te JOIN gal q ON q.item_id = te.query_id AND q.role = 'test' WHERE te.rk <= {k}) w JOIN cov c ON c.item_id = w.item_id JOIN alloc a ON a.item_id = w.item_id",
        "provenance_check": f"SELECT count(*) AS reports, count(*) - count(DISTINCT strategy) AS repeated, count(DISTINCT items) AS item_counts, count(DISTINCT test_queries) AS query_counts, count(CASE WHEN spent > {cfg.cost(cfg.target)} * items THEN 1 END) AS over_cap FROM (SELECT a.strategy, a.items, a.spent, s.test_queries FROM (SELECT a.strategy, count(*) AS items, sum(o.cost) AS spent FROM allocs a JOIN opts o ON o.opt = a.opt GROUP BY a.strategy) a JOIN (SELECT strategy, count(*) AS test_queries FROM srec GROUP BY strategy) s ON s.strategy = a.strategy) t",
        "gpd_tail_fit": f"SELECT n AS exceedances, round(cut, 6) AS threshold, CASE WHEN usable THEN round(k, 5) END AS shape, CASE WHEN usable THEN round(scale, 6) END AS scale, CASE WHEN usable AND k > 0 THEN round(cut + scale / k, 5) END AS ceiling, CASE WHEN usable THEN round(CASE WHEN k > 0 AND 1e0 - cut >= scale / k THEN 0e0 ELSE {TAIL}e0 * power(1e0 - k * (1e0 - cut) / scale, 1e0 / k) END, 6) END AS chance_of_one FROM (SELECT t.*, n >= {TAIL_ROWS} AND abs(a0 - 2e0 * a1) >= 1e-12 AND 2e0 * a0 * a1 / nullif(a0 - 2e0 * a1, 0e0) > 0 AS usable, a0 / nullif(a0 - 2e0 * a1, 0e0) - 2e0 AS k, 2e0 * a0 * a1 / nullif(a0 - 2e0 * a1, 0e0) AS scale FROM (SELECT count(*) AS n, max(cut) AS cut, avg(x) AS a0, sum(x * (m - i) / nullif(m - 1e0, 0e0)) / nullif(count(*), 0) AS a1 FROM (SELECT x, cut, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS m FROM (SELECT round(te.f - c.cut, 9) AS x, c.cut FROM te CROSS JOIN (SELECT round(percentile_cont({1 - TAIL}) WITHIN GROUP (ORDER BY f), 9) AS cut FROM te) c WHERE te.f > c.cut) t) t) t) t",
        "alloc_shuffled_histogram": "SELECT r.item_id, s.opt FROM rnk r JOIN spans s ON r.rk >= s.row_start AND r.rk < s.row_end",
        "alloc_within_cluster": f"SELECT a.item_id, a.cluster, b.opt FROM (SELECT c.item_id, c.cluster, row_number() OVER (PARTITION BY c.cluster ORDER BY @sha<concat('{cfg.seed}:', c.item_id)>, c.item_id) AS n FROM clus c) a JOIN (SELECT c.cluster, l.opt, row_number() OVER (PARTITION BY c.cluster ORDER BY l.opt, l.item_id) AS n FROM alloc l JOIN clus c ON c.item_id = l.item_id) b ON b.cluster = a.cluster AND b.n = a.n",
        "paired_bootstrap": "SELECT round(e.est, 6) AS estimate, round(stddev_samp(m), 6) AS se, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY m), 6) AS lo, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY m), 6) AS hi, round(avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive FROM boot CROSS JOIN (SELECT avg(delta) AS est FROM pd) e GROUP BY e.est",
        "crossed_bootstrap": "SELECT cell, CAST(b AS BIGINT) AS b, round(m, 6) AS mean_delta FROM cross_",
        "simultaneous_band": "SELECT c.cell, round(max(e.est), 6) AS estimate, round(stddev_samp(c.m), 6) AS se, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY c.m), 6) AS lo, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY c.m), 6) AS hi, round(max(w.half), 6) AS half_width FROM cross_ c JOIN est e ON e.cell = c.cell CROSS JOIN (SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY gap) AS half FROM (SELECT c.b, max(abs(c.m - e.est)) AS gap FROM cross_ c JOIN est e ON e.cell = c.cell GROUP BY c.b) t) w GROUP BY c.cell",
        "seed_interval": f"SELECT count(*) AS seeds, round(avg(m), 6) AS mean, round({student_t_quantile(0.975, RANDOM_SEEDS - 1)!r}e0 * stddev_samp(m) / sqrt(count(*)), 6) AS half_width FROM (SELECT seed, round(avg(recall), 9) AS m FROM rrec GROUP BY seed) t",
        "evaluation_data": "SELECT item_id AS query_id, item_id AS exclude_id, label FROM gal WHERE role = 'validation'",
        "rarefaction": "SELECT round(sum(1e0 - CASE WHEN c.n = 0 THEN 1e0 WHEN c.n > q.n - floor(q.n / 2e0) THEN 0e0 ELSE s.miss END) / count(*), 6) AS half_coverage FROM cov c CROSS JOIN nq q LEFT JOIN (SELECT c.n, exp(sum(ln((q.n - floor(q.n / 2e0) - i.i) / (q.n - i.i)))) AS miss FROM (SELECT DISTINCT n FROM cov) c CROSS JOIN nq q JOIN @series<5000> i ON i.i < c.n WHERE c.n <= q.n - floor(q.n / 2e0) GROUP BY c.n) s ON s.n = c.n",
    }


def needs(sql: str, parts: dict[str, str], base: set[str]) -> list[str]:
    """Fragments that a text uses, in dependency order; base relations are left out."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in parts:
            if name not in base and name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                visit(parts[name])

    visit(sql)
    return [name for name in parts if name in found]


def composed(sql: str, cfg: PanelConfig = DEFAULT, base: set[str] = frozenset()) -> str:
    """The text with its fragments as common table expressions."""
    parts = fragments(cfg)
    used = needs(sql, parts, set(base))
    return _spelled(f"WITH {', '.join(f'{n} AS ({parts[n]})' for n in used)} {sql}" if used else sql, SPARK)


def oracle(sql: str, cfg: PanelConfig = DEFAULT) -> str:
    """The text with base relations and fragments, for DuckDB."""
    from stratavec.plans.oracle import base

    from stratavec.plans import codecs

    parts = fragments(cfg)
    parts["allocs"] = "SELECT * FROM srisk JOIN cov ON true JOIN opts ON true"
    used = needs(sql, parts, set())
    made = [allocation_oracle(cfg) if n == "allocs" else f"{n} AS MATERIALIZED ({parts[n]})" for n in used]
    if "srisk" in used:
        made.insert(0, codecs.query_ip_oracle())
    return _spelled(f"WITH {base(cfg)}" + "".join(f",\n{m}" for m in made) + f"\n{sql}", DUCKDB)
