"""DuckDB oracle SQL for the registered queries (same fixed parameters as ``queries.py``).

The SQL is assembled from CTE builders so the long plans (MDL levels, votes,
threshold sweep) are written once. Plain window functions stand in for the
bucketed ranks and running sums of the Spark side: same results, no scale
concerns in an oracle. The MDL recursion is unrolled to ``MDL_LEVELS`` levels.
"""

from __future__ import annotations

from votesel.plans.queries import ALPHA, EMB_K, EMB_PARTS, OVERLAP, PARTS, ROUNDS, SEED, TOP_K

MDL_LEVELS = 10
BAND_CLASSES = ["high", "low", "mid"]
EMB_CLASSES = [str(i) for i in range(10)]
BAND_NUM = ["qty", "qty_disc", "price", "disc", "tax", "line"]
BAND_NOM = ["flag", "status"]
BAND_FEATS = BAND_NUM + BAND_NOM
EMB_FEATS = [f"att_{i}" for i in range(64)]


def xlogx(c: str) -> str:
    return f"(CASE WHEN ({c}) > 0 THEN ({c}) * log2({c}) ELSE 0.0 END)"


def h_of(s: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN log2({n}) - ({s}) / ({n}) ELSE 0.0 END)"


def rnd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BAND = """band AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
         l_quantity AS qty, l_quantity + l_discount * 20.0 AS qty_disc, l_extendedprice AS price, l_discount AS disc,
         l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS line, l_returnflag AS flag, l_linestatus AS status,
         CASE WHEN l_quantity <= 17 THEN 'low' WHEN l_quantity <= 34 THEN 'mid' ELSE 'high' END AS class
  FROM lineitem)"""

FOLDS = """folds AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 3 AS BIGINT) AS fold FROM band)"""

TRAIN = "train AS (SELECT * EXCLUDE (fold) FROM folds WHERE fold <> 0)"

ROUNDS_CTE = f"rounds AS (SELECT unnest(generate_series(1, {ROUNDS})) AS round)"

ASSIGN = f"""assign AS (
  SELECT r.round,
         CAST((row_number() OVER (PARTITION BY r.round, t.class ORDER BY md5(concat_ws('|', {SEED}, r.round, t.row_id))) - 1) % {PARTS} AS BIGINT) AS part,
         t.row_id
  FROM train t CROSS JOIN rounds r)"""

SCOPED = "scoped AS (SELECT a.round, a.part, t.* FROM assign a JOIN train t USING (row_id))"
GLOBAL = "scoped AS (SELECT 0 AS round, 0 AS part, t.* FROM train t)"


def cells_cte(src: str, num: list[str], nom: list[str], name: str = "cells", scoped: bool = True) -> str:
    keys = "round, part, " if scoped else ""
    parts = []
    for i, f in enumerate(num + nom):
        n = f if f in num else "NULL"
        c = f"CAST({f} AS VARCHAR)" if f in nom else "NULL"
        parts.append(
            f"SELECT {keys}row_id, class, {i} AS idx, '{f}' AS feature, CAST({n} AS DOUBLE) AS num, CAST({c} AS VARCHAR) AS cat FROM {src}"
        )
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def mdl_ctes(classes: list[str], levels: int = MDL_LEVELS, cells: str = "cells") -> list[str]:
    """hist, cum, iv1/act1 and per level cand/best/acc; cuts = union of accepted."""
    k = len(classes)
    K = "round, part, idx"
    ns = ", ".join(f"count_if(class = '{c}') AS n{i}" for i, c in enumerate(classes))
    cns = ", ".join(f"sum(n{i}) OVER w AS cn{i}" for i in range(k))
    out = [
        f"hist AS (SELECT {K}, num AS value, {ns} FROM {cells} WHERE num IS NOT NULL GROUP BY {K}, num)",
        f"cum AS (SELECT *, {cns}, row_number() OVER w AS dpos FROM hist "
        f"WINDOW w AS (PARTITION BY {K} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        f"iv1 AS (SELECT {K}, 1 AS node, 0 AS lo_d, count(*) AS hi_d, "
        + ", ".join(f"0 AS lo{i}" for i in range(k))
        + ", "
        + ", ".join(f"sum(n{i}) AS hi{i}" for i in range(k))
        + f" FROM hist GROUP BY {K})",
        f"act1 AS (SELECT {K}, value, dpos, " + ", ".join(f"cn{i}" for i in range(k)) + ", 1 AS node FROM cum)",
    ]
    ls = [f"l{i}" for i in range(k)]
    rs = [f"r{i}" for i in range(k)]
    for L in range(1, levels + 1):
        lr = ", ".join(f"a.cn{i} - i.lo{i} AS l{i}" for i in range(k)) + ", " + ", ".join(f"i.hi{i} - a.cn{i} AS r{i}" for i in range(k))
        los = ", ".join(f"i.lo{i}" for i in range(k))
        out.append(
            f"cand{L} AS (SELECT a.round, a.part, a.idx, a.node, a.value, a.dpos, i.lo_d, i.hi_d, {los}, {lr} "
            f"FROM act{L} a JOIN iv{L} i ON a.round = i.round AND a.part = i.part AND a.idx = i.idx AND a.node = i.node "
            f"WHERE a.dpos < i.hi_d)"
        )
        out.append(f"cande{L} AS (SELECT *, {'+'.join(ls)} AS nl, {'+'.join(rs)} AS nr FROM cand{L})")
        e = f"({xlogx('nl')} + {xlogx('nr')} - ({' + '.join(xlogx(x) for x in ls)}) - ({' + '.join(xlogx(x) for x in rs)})) / (nl + nr)"
        out.append(f"candx{L} AS (SELECT *, {e} AS e FROM cande{L})")
        out.append(
            f"best{L} AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {K}, node ORDER BY round(e, 12), value) AS rk "
            f"FROM candx{L}) WHERE rk = 1)"
        )
        ts = [f"(l{i} + r{i})" for i in range(k)]
        hl = f"(({xlogx('nl')} - ({' + '.join(xlogx(x) for x in ls)})) / nl)"
        hr = f"(({xlogx('nr')} - ({' + '.join(xlogx(x) for x in rs)})) / nr)"
        hp = f"(({xlogx('(nl + nr)')} - ({' + '.join(xlogx(x) for x in ts)})) / (nl + nr))"
        kp = lambda cols: "(" + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cols) + ")"
        out.append(
            f"bm{L} AS (SELECT *, nl + nr AS n, {hl} AS h_l, {hr} AS h_r, {hp} AS h_prior, {kp(ts)} AS k_all, {kp(ls)} AS k_l, {kp(rs)} AS k_r FROM best{L})"
        )
        delta = "(log2(pow(3.0, k_all) - 2) - (k_all * h_prior - k_r * h_r - k_l * h_l))"
        out.append(
            f"bmx{L} AS (SELECT *, h_prior - e AS gain, "
            f"(round(e, 12) < round(h_prior, 12) AND (h_prior - e) > (log2(hi_d - lo_d - 1) + {delta}) / n) AS accepted, {L} AS depth FROM bm{L})"
        )
        out.append(f"acc{L} AS (SELECT * FROM bmx{L} WHERE accepted)")
        if L < levels:
            lo = ", ".join(f"lo{i}" for i in range(k))
            hi_left = ", ".join(f"lo{i} + l{i} AS hi{i}" for i in range(k))
            lo_right = ", ".join(f"lo{i} + l{i} AS lo{i}" for i in range(k))
            hi_right = ", ".join(f"lo{i} + l{i} + r{i} AS hi{i}" for i in range(k))
            out.append(
                f"iv{L + 1} AS (SELECT {K}, node * 2 AS node, lo_d, dpos AS hi_d, {lo}, {hi_left} FROM acc{L} "
                f"UNION ALL SELECT {K}, node * 2 + 1 AS node, dpos AS lo_d, hi_d, {lo_right}, {hi_right} FROM acc{L})"
            )
            out.append(
                f"act{L + 1} AS (SELECT a.round, a.part, a.idx, a.value, a.dpos, "
                + ", ".join(f"a.cn{i}" for i in range(k))
                + ", a.node * 2 + CASE WHEN a.dpos > c.dpos THEN 1 ELSE 0 END AS node "
                f"FROM act{L} a JOIN acc{L} c ON a.round = c.round AND a.part = c.part AND a.idx = c.idx AND a.node = c.node)"
            )
    out.append("cuts AS (" + " UNION ALL ".join(f"SELECT {K}, value AS cut, depth FROM acc{L}" for L in range(1, levels + 1)) + ")")
    return out


def ct_ctes(classes: list[str], cells: str = "cells") -> list[str]:
    """Contingency of every feature with the class (MDL codes for numeric), then IG/SU."""
    K = "round, part, idx"
    un = " UNION ALL ".join(
        f"SELECT {K}, CAST(code AS VARCHAR) AS code, '{c}' AS class, sum(n{i}) AS n FROM coded GROUP BY {K}, code" for i, c in enumerate(classes)
    )
    return [
        f"coded AS (SELECT h.*, (SELECT count(*) FROM cuts c WHERE c.round = h.round AND c.part = h.part AND c.idx = h.idx AND h.value > c.cut) AS code FROM hist h)",
        f"ct AS (SELECT * FROM ({un}) WHERE n > 0 UNION ALL SELECT {K}, cat AS code, class, count(*) AS n FROM {cells} WHERE cat IS NOT NULL GROUP BY {K}, cat, class)",
        f"sa AS (SELECT {K}, sum({xlogx('m')}) AS sa FROM (SELECT {K}, code, sum(n) AS m FROM ct GROUP BY {K}, code) GROUP BY {K})",
        f"sb AS (SELECT {K}, sum({xlogx('m')}) AS sb FROM (SELECT {K}, class, sum(n) AS m FROM ct GROUP BY {K}, class) GROUP BY {K})",
        f"sab AS (SELECT {K}, sum({xlogx('n')}) AS sab, sum(n) AS ntot FROM ct GROUP BY {K})",
        f"hh AS (SELECT {K}, {h_of('sa', 'ntot')} AS h_a, {h_of('sb', 'ntot')} AS h_b, {h_of('sab', 'ntot')} AS h_ab "
        f"FROM sab JOIN sa USING ({K}) JOIN sb USING ({K}))",
        f"scores AS (SELECT {K}, h_a + h_b - h_ab AS ig, CASE WHEN h_a + h_b > 0 THEN 2 * (h_a + h_b - h_ab) / (h_a + h_b) ELSE 0.0 END AS su FROM hh)",
    ]


def band_ig_ctes() -> list[str]:
    return [BAND, FOLDS, TRAIN, ROUNDS_CTE, ASSIGN, SCOPED, cells_cte("scoped", BAND_NUM, BAND_NOM)] + mdl_ctes(BAND_CLASSES) + ct_ctes(BAND_CLASSES)


def band_global_ctes() -> list[str]:
    return [BAND, FOLDS, TRAIN, GLOBAL, cells_cte("scoped", BAND_NUM, BAND_NOM)] + mdl_ctes(BAND_CLASSES) + ct_ctes(BAND_CLASSES)


FEATS = "feats AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(BAND_FEATS)) + ") t(idx, feature))"

PICKED = f"""picked AS (SELECT round, part, idx FROM (
  SELECT *, row_number() OVER (PARTITION BY round, part ORDER BY round(ig, 9) DESC, idx) AS rk FROM scores) WHERE rk <= {TOP_K})"""
BLOCKS = "blocks AS (SELECT DISTINCT round, part FROM assign)"
REMOVED = """removed AS (
  SELECT b.round, b.part, f.idx FROM blocks b CROSS JOIN feats f
  WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.round = b.round AND p.part = b.part AND p.idx = f.idx))"""
ROUND_VOTES = """round_votes AS (
  SELECT r.round, f.idx, f.feature, CAST(coalesce(v.votes, 0) AS BIGINT) AS votes
  FROM feats f CROSS JOIN rounds r
  LEFT JOIN (SELECT round, idx, count(*) AS votes FROM removed GROUP BY round, idx) v ON v.round = r.round AND v.idx = f.idx)"""
TOTALS = "totals AS (SELECT idx, feature, CAST(sum(votes) AS BIGINT) AS votes FROM round_votes GROUP BY idx, feature)"
VSTATS = """vstats AS (SELECT count(*) AS n_voted, coalesce(avg(votes), 0.0) AS avg_votes, coalesce(stddev_pop(votes), 0.0) AS std_votes
  FROM totals WHERE votes > 0)"""
VRANGE = "vrange AS (SELECT CAST(trunc(avg_votes - std_votes / 2) AS BIGINT) AS lo, CAST(trunc(avg_votes + std_votes / 2) AS BIGINT) AS hi, 5 AS step FROM vstats)"


def vote_ctes() -> list[str]:
    return band_ig_ctes() + [FEATS, PICKED, BLOCKS, REMOVED, ROUND_VOTES, TOTALS]


# complexity measures on the band training table (nominal codes from the train domain)
DOMS = "doms AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) AS BIGINT) AS code FROM (SELECT DISTINCT feature, cat AS value FROM tcells WHERE cat IS NOT NULL))"
XCELLS = "xcells AS (SELECT c.row_id, c.class, c.idx, c.feature, coalesce(c.num, CAST(d.code AS DOUBLE)) AS x FROM tcells c LEFT JOIN doms d ON d.feature = c.feature AND d.value = c.cat)"
STATS = "stats AS (SELECT idx, feature, class, count(*) AS n, avg(x) AS mu, var_pop(x) AS var, min(x) AS mn, max(x) AS mx FROM xcells GROUP BY idx, feature, class)"
FISHER = """fisher AS (
  SELECT idx, feature,
         CASE WHEN den > 0 THEN greatest(num, 0.0) / den WHEN greatest(num, 0.0) > 0 THEN CAST('inf' AS DOUBLE) ELSE NULL END AS ratio
  FROM (SELECT idx, feature, sum(p * m * m) - pow(sum(p * m), 2) AS num, sum(p * v) AS den
        FROM (SELECT *, p * (var + pow(mu - p * mu, 2)) AS v, p * mu AS m
              FROM (SELECT *, n / sum(n) OVER (PARTITION BY idx) AS p FROM stats))
        GROUP BY idx, feature))"""
F2 = """f2t AS (
  SELECT f.idx, f.feature, coalesce(s.f2, 0.0) AS f2 FROM (SELECT DISTINCT idx, feature FROM stats) f
  LEFT JOIN (SELECT a.idx, sum(greatest(0.0, least(a.mx, b.mx) - greatest(a.mn, b.mn)) /
                    CASE WHEN greatest(a.mx, b.mx) - least(a.mn, b.mn) = 0 THEN 0.01 ELSE greatest(a.mx, b.mx) - least(a.mn, b.mn) END) AS f2
             FROM stats a JOIN stats b ON a.idx = b.idx AND a.class < b.class GROUP BY a.idx) s ON s.idx = f.idx)"""


def complexity_ctes(with_train: bool = True) -> list[str]:
    base = [BAND, FOLDS, TRAIN] if with_train else []
    return base + [cells_cte("train", BAND_NUM, BAND_NOM, "tcells", scoped=False), DOMS, XCELLS, STATS, FISHER, F2]


F1_EXPR = "(CASE WHEN max_ratio IS NULL THEN CAST('inf' AS DOUBLE) WHEN max_ratio = CAST('inf' AS DOUBLE) THEN 0.0 WHEN max_ratio > 0 THEN 1.0 / max_ratio ELSE CAST('inf' AS DOUBLE) END)"

SWEEP = f"""ths AS (SELECT unnest(generate_series(lo, hi, step)) AS a FROM vrange WHERE hi >= lo),
lv AS (SELECT t.idx, CASE WHEN t.votes = 0 THEN -1000000000 ELSE t.votes END AS lvl, fi.ratio, f2t.f2
       FROM totals t LEFT JOIN fisher fi ON fi.idx = t.idx LEFT JOIN f2t ON f2t.idx = t.idx),
per_a AS (SELECT a, count(lv.idx) AS n_features, count(lv.idx) + 1 AS size, max(lv.ratio) AS max_ratio, coalesce(sum(lv.f2), 0.0) AS sum_f2
          FROM ths LEFT JOIN lv ON lv.lvl < ths.a GROUP BY a),
cands AS (SELECT p.* FROM per_a p JOIN (SELECT size, min(a) AS a FROM per_a WHERE size > 1 GROUP BY size) f ON f.size = p.size AND f.a = p.a),
sweep AS (
  SELECT 'F1' AS measure, a, n_features, size, {F1_EXPR} AS complexity, 100.0 * size / {len(BAND_FEATS) + 1} AS retained_pct FROM cands
  UNION ALL
  SELECT 'F2' AS measure, a, n_features, size, sum_f2 AS complexity, 100.0 * size / {len(BAND_FEATS) + 1} AS retained_pct FROM cands),
scored AS (SELECT *, {ALPHA} * complexity + {1 - ALPHA} * retained_pct AS score FROM sweep),
choice AS (SELECT measure, arg_min(a, (round(score, 9), a)) AS a, min(score) AS score FROM scored GROUP BY measure)"""


def sweep_ctes() -> list[str]:
    return vote_ctes() + complexity_ctes(with_train=False) + [VSTATS, VRANGE, SWEEP]


def q(ctes: list[str], select: str) -> str:
    return with_(*ctes) + select


TEXT = """lines AS (
  SELECT row_id, concat_ws(',', CAST(CAST(qty AS BIGINT) AS VARCHAR), CAST(CAST(line AS BIGINT) AS VARCHAR), flag, status, class) AS value,
         concat_ws(',', class, CAST(CAST(qty AS BIGINT) AS VARCHAR), CAST(CAST(line AS BIGINT) AS VARCHAR), flag, status) AS value_cf
  FROM band),
parsed AS (SELECT row_id, string_split(value, ',') AS f FROM lines),
parsed_cf AS (SELECT row_id, string_split(value_cf, ',') AS f FROM lines),
text_t AS (SELECT row_id, f[1] AS att_0, f[2] AS att_1, f[3] AS att_2, f[4] AS att_3, f[5] AS class FROM parsed WHERE len(f) = 5)"""

ORACLES: dict[str, str] = {}

ORACLES["csv_scan"] = q([BAND, TEXT], "SELECT * FROM text_t")
ORACLES["class_first"] = q(
    [BAND, TEXT], "SELECT row_id, f[2] AS att_0, f[3] AS att_1, f[4] AS att_2, f[5] AS att_3, f[1] AS class FROM parsed_cf WHERE len(f) = 5"
)
ORACLES["text_file_scan"] = q([BAND, TEXT], "SELECT att_0, att_1, att_2, att_3, class FROM text_t WHERE att_1 <> '7'")
ORACLES["quarantine_lines"] = q(
    [BAND], "SELECT concat_ws(',', CAST(qty AS BIGINT), CAST(line AS BIGINT), flag, class) AS value, CAST(4 AS BIGINT) AS n_fields FROM band WHERE line = 7"
)
ORACLES["infer_attributes"] = q(
    [BAND, TEXT, "first_row AS (SELECT * FROM text_t ORDER BY row_id LIMIT 1)"],
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS idx, 'att_{i}' AS feature, CASE WHEN try_cast(att_{i} AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'nominal' END AS kind FROM first_row"
        for i in range(4)
    )
    + " UNION ALL SELECT CAST(4 AS BIGINT), 'class', 'class'",
)
ORACLES["cast_numeric"] = q(
    [BAND, TEXT],
    "SELECT row_id, round(CAST(att_0 AS DOUBLE), 6) AS att_0, round(CAST(att_1 AS DOUBLE), 6) AS att_1, att_2, att_3, class FROM text_t",
)
ORACLES["nominal_domains"] = q(
    [BAND, cells_cte("band", BAND_NUM, BAND_NOM, "bcells", scoped=False)],
    "SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) AS BIGINT) AS code "
    "FROM (SELECT DISTINCT feature, cat AS value FROM bcells WHERE cat IS NOT NULL)",
)
ORACLES["encode_nominal"] = q(
    [
        BAND,
        cells_cte("band", BAND_NUM, BAND_NOM, "bcells", scoped=False),
        "d AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS code FROM (SELECT DISTINCT feature, cat AS value FROM bcells WHERE cat IS NOT NULL))",
    ],
    "SELECT c.row_id, c.feature, CAST(d.code AS BIGINT) AS code FROM bcells c JOIN d ON d.feature = c.feature AND d.value = c.cat",
)
ORACLES["drop_rare_classes"] = q(
    [
        """ol AS (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
                 CAST(l_orderkey AS VARCHAR) AS class FROM lineitem)"""
    ],
    "SELECT row_id, class FROM ol WHERE class IN (SELECT class FROM ol GROUP BY class HAVING count(*) >= 2)",
)
ORACLES["melt_cells"] = q(
    [BAND, cells_cte("band", BAND_NUM, BAND_NOM, "bcells", scoped=False)],
    f"SELECT row_id, class, CAST(idx AS BIGINT) AS idx, feature, {rnd('num')} AS num, cat FROM bcells",
)
ORACLES["project_selected"] = q([BAND], "SELECT row_id, " + ", ".join(f"{rnd(c)} AS {c}" for c in BAND_NUM) + ", class FROM band")
ORACLES["class_priors"] = q(
    [BAND, FOLDS, TRAIN], f"SELECT class, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER ()')} AS p FROM train GROUP BY class"
)
ORACLES["train_test_split"] = q([BAND, FOLDS], "SELECT row_id, class, fold FROM folds")
ORACLES["union_train_test"] = q([BAND, FOLDS], "SELECT row_id, class, fold = 0 AS is_test FROM folds")
ORACLES["horizontal_partition"] = q([BAND, FOLDS, TRAIN, ROUNDS_CTE, ASSIGN], "SELECT CAST(round AS BIGINT) AS round, part, row_id FROM assign")


def _vpart(overlap: float) -> str:
    return f"""va AS (
  SELECT CAST(r.round AS BIGINT) AS round, i.idx, 'att_' || i.idx AS feature, md5(concat_ws('|', {SEED}, r.round, 'att_' || i.idx)) AS h,
         (CAST(('0x' || substring(md5(concat_ws('|', {SEED}, r.round, 'att_' || i.idx, 'overlap')), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0) < {overlap} AS shared
  FROM (SELECT unnest(generate_series(0, 63)) AS idx) i CROSS JOIN rounds r),
vpart AS (
  SELECT round, CAST((row_number() OVER (PARTITION BY round ORDER BY h) - 1) % {EMB_PARTS} AS BIGINT) AS part, CAST(idx AS BIGINT) AS idx, feature, shared FROM va WHERE NOT shared
  UNION ALL
  SELECT round, CAST(p.part AS BIGINT), CAST(idx AS BIGINT), feature, shared FROM va CROSS JOIN (SELECT unnest(generate_series(0, {EMB_PARTS - 1})) AS part) p WHERE shared)"""


# set below, where the embedding CTEs are defined: vertical_partition, vertical_overlap
ORACLES["contingency"] = q(
    [BAND, FOLDS, TRAIN, ROUNDS_CTE, ASSIGN, SCOPED, cells_cte("scoped", BAND_NUM, BAND_NOM)],
    "SELECT CAST(round AS BIGINT) AS round, part, CAST(idx AS BIGINT) AS idx, cat AS code, class, count(*) AS n FROM cells WHERE cat IS NOT NULL GROUP BY ALL",
)
ORACLES["class_entropy"] = q(
    [BAND, FOLDS, TRAIN, ROUNDS_CTE, ASSIGN, SCOPED],
    f"SELECT CAST(round AS BIGINT) AS round, part, CAST(sum(m) AS BIGINT) AS n, {rnd(h_of(f'sum({xlogx(chr(109))})', 'sum(m)'))} AS h_class "
    "FROM (SELECT round, part, class, count(*) AS m FROM scoped GROUP BY ALL) GROUP BY round, part",
)
ORACLES["mdl_best_cut"] = q(
    band_global_ctes(),
    f"SELECT CAST(idx AS BIGINT) AS idx, {rnd('value')} AS cut, {rnd('e')} AS e, {rnd('gain')} AS gain, CAST(n AS BIGINT) AS n, accepted FROM bmx1",
)
ORACLES["mdl_discretize"] = q(band_global_ctes(), f"SELECT CAST(idx AS BIGINT) AS idx, {rnd('cut')} AS cut, CAST(depth AS BIGINT) AS depth FROM cuts")
ORACLES["info_gain"] = q(band_ig_ctes(), f"SELECT CAST(round AS BIGINT) AS round, CAST(part AS BIGINT) AS part, CAST(idx AS BIGINT) AS idx, {rnd('ig')} AS ig FROM scores")
ORACLES["symm_uncertainty_class"] = q(
    band_ig_ctes(), f"SELECT CAST(round AS BIGINT) AS round, CAST(part AS BIGINT) AS part, CAST(idx AS BIGINT) AS idx, {rnd('su')} AS su FROM scores"
)
ORACLES["rank_top_k"] = q(band_ig_ctes() + [PICKED], "SELECT CAST(round AS BIGINT) AS round, CAST(part AS BIGINT) AS part, CAST(idx AS BIGINT) AS idx FROM picked")

ROWCODES = """rowcodes AS (
  SELECT c.row_id, c.idx, CASE WHEN c.num IS NULL THEN c.cat ELSE CAST((SELECT count(*) FROM cuts k WHERE k.idx = c.idx AND c.num > k.cut) AS VARCHAR) END AS code
  FROM cells c)"""
PAIRSU = f"""pct AS (SELECT a.idx AS ia, b.idx AS ib, a.code AS ca, b.code AS cb, count(*) AS n FROM rowcodes a JOIN rowcodes b ON a.row_id = b.row_id GROUP BY ALL),
pa AS (SELECT ia, ib, sum({xlogx('m')}) AS sa FROM (SELECT ia, ib, ca, sum(n) AS m FROM pct GROUP BY ALL) GROUP BY ALL),
pb AS (SELECT ia, ib, sum({xlogx('m')}) AS sb FROM (SELECT ia, ib, cb, sum(n) AS m FROM pct GROUP BY ALL) GROUP BY ALL),
pab AS (SELECT ia, ib, sum({xlogx('n')}) AS sab, sum(n) AS ntot FROM pct GROUP BY ALL),
ph AS (SELECT ia, ib, {h_of('sa', 'ntot')} AS h_a, {h_of('sb', 'ntot')} AS h_b, {h_of('sab', 'ntot')} AS h_ab FROM pab JOIN pa USING (ia, ib) JOIN pb USING (ia, ib)),
pairsu AS (SELECT ia, ib, CASE WHEN h_a + h_b > 0 THEN 2 * (h_a + h_b - h_ab) / (h_a + h_b) ELSE 0.0 END AS su FROM ph)"""
ORACLES["symm_uncertainty_pair"] = q(
    band_global_ctes() + [ROWCODES, PAIRSU], f"SELECT CAST(ib AS BIGINT) AS idx_a, CAST(ia AS BIGINT) AS idx_b, {rnd('su')} AS su FROM pairsu"
)
ORACLES["cfs_merit"] = q(
    band_global_ctes() + [ROWCODES, PAIRSU],
    f"SELECT CAST(idx AS BIGINT) AS idx_a, CAST(idx AS BIGINT) AS idx_b, {rnd('su')} AS merit FROM scores "
    f"UNION ALL SELECT CAST(p.ia AS BIGINT), CAST(p.ib AS BIGINT), {rnd('(a.su + b.su) / sqrt(2 + 2 * p.su)')} "
    "FROM pairsu p JOIN scores a ON a.idx = p.ia JOIN scores b ON b.idx = p.ib WHERE p.ia < p.ib",
)

ORACLES["partition_votes_h"] = q(vote_ctes(), "SELECT CAST(round AS BIGINT) AS round, CAST(idx AS BIGINT) AS idx, feature, votes FROM round_votes")
ORACLES["vote_totals"] = q(vote_ctes(), "SELECT CAST(idx AS BIGINT) AS idx, feature, votes FROM totals")
ORACLES["vote_stats"] = q(
    vote_ctes() + [VSTATS], f"SELECT CAST(n_voted AS BIGINT) AS n_voted, {rnd('avg_votes')} AS avg_votes, {rnd('std_votes')} AS std_votes FROM vstats"
)
ORACLES["zero_vote_features"] = q(vote_ctes(), "SELECT CAST(idx AS BIGINT) AS idx, feature FROM totals WHERE votes = 0")
ORACLES["part_stats"] = q(
    vote_ctes(),
    "SELECT CAST(count(*) AS BIGINT) AS n_blocks, round(avg(n), 6) AS mean_selected, round(stddev_pop(n), 6) AS std_selected, "
    "CAST(max(n) AS BIGINT) AS max_selected, CAST(min(n) AS BIGINT) AS min_selected "
    "FROM (SELECT b.round, b.part, count(p.idx) AS n FROM blocks b LEFT JOIN picked p ON p.round = b.round AND p.part = b.part GROUP BY ALL)",
)

# vertical: embeddings, global MDL + IG, Ranker inside each block's features
EMB = "emb AS (SELECT vec_id AS row_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS att_{i}" for i in range(64)) + ", CAST(label AS VARCHAR) AS class FROM embeddings)"
EMB_FOLDS = "efolds AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 3 AS fold FROM emb)"
EMB_TRAIN = "etrain AS (SELECT 0 AS round, 0 AS part, * EXCLUDE (fold) FROM efolds WHERE fold <> 0)"
EMB_HELD = cells_cte("emb", EMB_FEATS, [], scoped=False) + ", held AS (SELECT idx, count(num) AS n_values, round(min(num), 6) AS lowest, round(max(num), 6) AS highest FROM cells GROUP BY idx)"
for _name, _overlap in (("vertical_partition", 0.0), ("vertical_overlap", OVERLAP)):
    ORACLES[_name] = q([ROUNDS_CTE, _vpart(_overlap), EMB, EMB_HELD], "SELECT v.*, h.n_values, h.lowest, h.highest FROM vpart v JOIN held h ON h.idx = v.idx")
EMB_FEATS_CTE = "efeats AS (SELECT unnest(generate_series(0, 63)) AS idx)"


def _vertical_votes(overlap: float) -> list[str]:
    return (
        [EMB, EMB_FOLDS, EMB_TRAIN, cells_cte("etrain", EMB_FEATS, [])]
        + mdl_ctes(EMB_CLASSES)
        + ct_ctes(EMB_CLASSES)
        + [
            ROUNDS_CTE,
            _vpart(overlap),
            EMB_FEATS_CTE,
            f"""vpicked AS (SELECT round, part, idx FROM (
              SELECT v.round, v.part, v.idx, row_number() OVER (PARTITION BY v.round, v.part ORDER BY round(s.ig, 9) DESC, v.idx) AS rk
              FROM vpart v JOIN scores s ON s.idx = v.idx) WHERE rk <= {EMB_K})""",
            "vblocks AS (SELECT DISTINCT round, part FROM vpart)",
            """vremoved AS (SELECT b.round, b.part, f.idx FROM vblocks b CROSS JOIN efeats f
              WHERE NOT EXISTS (SELECT 1 FROM vpicked p WHERE p.round = b.round AND p.part = b.part AND p.idx = f.idx))""",
        ]
    )


ORACLES["partition_votes_v"] = q(
    _vertical_votes(0.0),
    "SELECT CAST(r.round AS BIGINT) AS round, CAST(f.idx AS BIGINT) AS idx, 'att_' || f.idx AS feature, CAST(coalesce(v.votes, 0) AS BIGINT) AS votes "
    "FROM efeats f CROSS JOIN rounds r LEFT JOIN (SELECT round, idx, count(*) AS votes FROM vremoved GROUP BY ALL) v ON v.round = r.round AND v.idx = f.idx",
)
ORACLES["run_selection_vertical"] = " UNION ALL ".join(
    "("
    + q(
        _vertical_votes(overlap),
        f"SELECT CAST({overlap} AS DOUBLE) AS overlap, CAST(f.idx AS BIGINT) AS idx, CAST(count(v.idx) AS BIGINT) AS votes FROM efeats f LEFT JOIN vremoved v ON v.idx = f.idx GROUP BY f.idx",
    )
    + ")"
    for overlap in (0.0, OVERLAP)
)

ORACLES["fisher_ratio"] = q(complexity_ctes(), f"SELECT CAST(idx AS BIGINT) AS idx, feature, {rnd('ratio')} AS ratio FROM fisher")
ORACLES["f1_complexity"] = q(complexity_ctes() + ["mr AS (SELECT max(ratio) AS max_ratio FROM fisher)"], f"SELECT {rnd(F1_EXPR)} AS f1 FROM mr")
ORACLES["f2_overlap"] = q(complexity_ctes(), f"SELECT CAST(idx AS BIGINT) AS idx, feature, {rnd('f2')} AS f2 FROM f2t")
ORACLES["f2_complexity"] = q(complexity_ctes(), f"SELECT {rnd('sum(f2)')} AS f2 FROM f2t")

ORACLES["vote_range"] = q(vote_ctes() + [VSTATS, VRANGE], "SELECT lo, hi, CAST(step AS BIGINT) AS step FROM vrange")
ORACLES["candidate_subsets"] = q(sweep_ctes(), "SELECT CAST(a AS BIGINT) AS a, CAST(n_features AS BIGINT) AS n_features, CAST(size AS BIGINT) AS size FROM cands")
ORACLES["threshold_sweep"] = q(
    sweep_ctes(),
    f"SELECT CAST(a AS BIGINT) AS a, CAST(n_features AS BIGINT) AS n_features, CAST(size AS BIGINT) AS size, {rnd('complexity')} AS complexity, "
    f"{rnd('retained_pct')} AS retained_pct, {rnd('score')} AS score, measure FROM scored",
)
ORACLES["select_threshold"] = q(sweep_ctes(), f"SELECT CAST(a AS BIGINT) AS a, {rnd('score')} AS score, false AS fallback, measure FROM choice")
ORACLES["selected_features"] = q(
    sweep_ctes(),
    "SELECT CAST(t.idx AS BIGINT) AS idx, t.feature, t.votes FROM totals t, choice c WHERE c.measure = 'F2' AND (t.votes = 0 OR t.votes < c.a)",
)
ORACLES["run_selection"] = q(
    sweep_ctes(),
    "SELECT 'IG' AS selector, c.measure, t.feature FROM totals t, choice c WHERE t.votes = 0 OR t.votes < c.a",
)

# ------------------------------------------------------------------ prep and models
DOC = """docs AS (
  SELECT d.doc_id AS row_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
         CAST(length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) AS DOUBLE) / greatest(length(d.text), 1) AS alpha_ratio,
         CAST(len(list_distinct(string_split(d.text, ' '))) AS DOUBLE) / len(string_split(d.text, ' ')) AS uniq_ratio,
         d.lang, d.source, CAST(l.quality AS VARCHAR) AS class
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
DOC_NUM = ["n_chars", "n_words", "alpha_ratio", "uniq_ratio"]
DOC_MM = "mm AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in DOC_NUM) + " FROM docs)"
DOC_SCALED = (
    "sdocs AS (SELECT row_id, class, "
    + ", ".join(f"CASE WHEN mx_{c} = mn_{c} THEN 0.5 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}" for c in DOC_NUM)
    + " FROM docs, mm)"
)
DOC_SPLIT = "dfolds AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 3 AS fold FROM sdocs)"
D2 = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in DOC_NUM)
KNN = f"""knn AS (
  SELECT q.row_id, q.class AS truth, arg_min(t.class, ({D2}, t.row_id)) AS prediction
  FROM dfolds q JOIN dfolds t ON q.fold = 0 AND t.fold <> 0 GROUP BY q.row_id, q.class)"""
ORACLES["knn_1nn"] = q([DOC, DOC_MM, DOC_SCALED, DOC_SPLIT, KNN], "SELECT row_id, prediction FROM knn")
ORACLES["accuracy"] = q([DOC, DOC_MM, DOC_SCALED, DOC_SPLIT, KNN], "SELECT round(avg(CASE WHEN prediction = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM knn")
BAND_NUM = ["qty", "qty_disc", "price", "disc", "tax", "line"]
BAND_MM = "bmm AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in BAND_NUM) + " FROM folds)"
BAND_SCALED = (
    "sband AS (SELECT row_id, class, fold, flag, status, "
    + ", ".join(f"CASE WHEN mx_{c} = mn_{c} THEN 0.5 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}" for c in BAND_NUM)
    + " FROM folds, bmm)"
)
#: An unequal nominal value is two unequal indicators.
BAND_D2 = "CASE WHEN q.flag <> t.flag THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q.status <> t.status THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + " + " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in BAND_NUM)
ORACLES["knn_lineitem"] = q(
    [BAND, FOLDS, BAND_MM, BAND_SCALED],
    f"SELECT q.row_id, arg_min(t.class, ({BAND_D2}, t.row_id)) AS prediction FROM sband q JOIN sband t ON q.fold = 0 AND t.fold <> 0 GROUP BY q.row_id",
)


def _order_index(col: str, name: str) -> str:
    """Values of a column by falling count, then value, from 0; ``k`` values in all."""
    return f"{name} AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS i, count(*) OVER () AS k FROM (SELECT {col} AS value, count(*) AS n FROM docs GROUP BY {col}))"


ORACLES["prep_pipeline"] = q(
    [DOC, DOC_MM, DOC_SCALED, _order_index("lang", "li"), _order_index("source", "si"), _order_index("class", "ci")],
    "SELECT s.row_id, CAST(ci.i AS DOUBLE) AS label, CAST(v.slot AS BIGINT) AS slot, round(v.value, 6) AS value FROM sdocs s JOIN docs d ON d.row_id = s.row_id JOIN ci ON ci.value = s.class "
    "JOIN ("
    + " UNION ALL ".join(f"SELECT row_id, {i} AS slot, {c} AS value FROM sdocs" for i, c in enumerate(DOC_NUM))
    + f" UNION ALL SELECT d.row_id, {len(DOC_NUM)} + a.i, CASE WHEN a.value = d.lang THEN 1.0 ELSE 0.0 END FROM docs d JOIN li a ON a.i < a.k - 1"
    + f" UNION ALL SELECT d.row_id, {len(DOC_NUM)} + (SELECT count(*) - 1 FROM li) + a.i, CASE WHEN a.value = d.source THEN 1.0 ELSE 0.0 END FROM docs d JOIN si a ON a.i < a.k - 1"
    + ") v ON v.row_id = s.row_id",
)
ORACLES["minmax_scale"] = q(
    [DOC, DOC_MM], "SELECT row_id, " + ", ".join(f"round(CASE WHEN mx_{c} = mn_{c} THEN 0.5 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END, 6) AS {c}" for c in DOC_NUM) + " FROM docs, mm"
)
ORACLES["string_index"] = q(
    [BAND],
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS BIGINT) AS index "
        f"FROM (SELECT {c} AS value, count(*) AS n FROM band GROUP BY {c})"
        for c in ["flag", "status", "class"]
    ),
)
ORACLES["one_hot"] = q(
    [BAND, "fi AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS i FROM (SELECT flag AS value, count(*) AS n FROM band GROUP BY flag))"],
    "SELECT b.row_id, CASE WHEN fi.i = 0 THEN 1.0 ELSE 0.0 END AS flag_0, CASE WHEN fi.i = 1 THEN 1.0 ELSE 0.0 END AS flag_1 FROM band b JOIN fi ON fi.value = b.flag",
)

# ------------------------------------------------------------------ ReliefF (brute force over each block)
from votesel.plans.queries import DOC_PARTS, RELIEF_K  # noqa: E402

DOC_NOM = ["lang", "source"]
_NX = ", ".join(f"CASE WHEN mx{i} > mn{i} THEN ({c} - mn{i}) / (mx{i} - mn{i}) ELSE 0.0 END AS x{i}" for i, c in enumerate(DOC_NUM))
_DN = " + ".join(f"abs(a.x{i} - b.x{i})" for i in range(len(DOC_NUM)))
_DC = " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0.0 ELSE 1.0 END" for c in DOC_NOM)
_DIFFS = ", ".join(f"abs(a.x{i} - b.x{i}) AS d{i}" for i in range(len(DOC_NUM))) + ", " + ", ".join(
    f"CASE WHEN a.{c} = b.{c} THEN 0.0 ELSE 1.0 END AS d{len(DOC_NUM) + j}" for j, c in enumerate(DOC_NOM)
)
RELIEF = [
    DOC,
    "rtrain AS (SELECT * EXCLUDE (fold) FROM (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 3 AS fold FROM docs) WHERE fold <> 0)",
    ROUNDS_CTE,
    f"""rassign AS (SELECT r.round, (row_number() OVER (PARTITION BY r.round, t.class ORDER BY md5(concat_ws('|', {SEED}, r.round, t.row_id))) - 1) % {DOC_PARTS} AS part, t.row_id
        FROM rtrain t CROSS JOIN rounds r)""",
    "rrows AS (SELECT a.round, a.part, t.* FROM rassign a JOIN rtrain t USING (row_id))",
    "rrng AS (SELECT round, part, " + ", ".join(f"min({c}) AS mn{i}, max({c}) AS mx{i}" for i, c in enumerate(DOC_NUM)) + " FROM rrows GROUP BY round, part)",
    f"nrows AS (SELECT round, part, row_id, class, {_NX}, lang, source FROM rrows JOIN rrng USING (round, part))",
    f"""rpairs AS (SELECT a.round, a.part, a.row_id AS qid, a.class AS qclass, b.row_id AS tid, b.class AS nclass, {_DIFFS}, ({_DN}) + ({_DC}) AS d
        FROM nrows a JOIN nrows b ON a.round = b.round AND a.part = b.part AND a.row_id <> b.row_id)""",
    f"rnb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round, part, qid, nclass ORDER BY round(d, 12), tid) AS rk FROM rpairs) WHERE rk <= {RELIEF_K})",
    "rcnt AS (SELECT *, count(*) OVER (PARTITION BY round, part, qid, nclass) AS cnt FROM rnb)",
    "rprior AS (SELECT round, part, class, count(*) / sum(count(*)) OVER (PARTITION BY round, part) AS p FROM rrows GROUP BY round, part, class)",
    "rsize AS (SELECT round, part, count(*) AS n_inst FROM rrows GROUP BY round, part)",
    """rf AS (SELECT c.*, CASE WHEN c.nclass = c.qclass THEN -1.0 ELSE pn.p / (1 - pq.p) END / c.cnt AS f
        FROM rcnt c JOIN rprior pn ON pn.round = c.round AND pn.part = c.part AND pn.class = c.nclass
                    JOIN rprior pq ON pq.round = c.round AND pq.part = c.part AND pq.class = c.qclass)""",
]
ORACLES["relieff_weights"] = q(
    RELIEF,
    " UNION ALL ".join(
        f"SELECT CAST(rf.round AS BIGINT) AS round, CAST(rf.part AS BIGINT) AS part, CAST({i} AS BIGINT) AS idx, round(sum(f * d{i}) / any_value(s.n_inst), 6) AS weight "
        f"FROM rf JOIN rsize s ON s.round = rf.round AND s.part = rf.part GROUP BY rf.round, rf.part"
        for i in range(len(DOC_NUM) + len(DOC_NOM))
    ),
)

#: Line items by (class, vector): rows of one vector have the same neighbours but for themselves, so a vector's
#: other rows come first among its hits and any vector's ten lowest ids stand for it.
RELIEF_LINES = [
    BAND,
    "lrows AS (SELECT row_id, qty, CAST(CAST(line AS BIGINT) AS VARCHAR) AS line, flag, status, class FROM band)",
    "lrng AS (SELECT min(qty) AS mn, max(qty) AS mx, count(*) AS n FROM lrows)",
    f"""lpts AS (SELECT class, (qty - mn) / (mx - mn) AS x, line, flag, status, count(*) AS w, min(row_id) AS pid, list_sort(list(row_id))[1:{RELIEF_K}] AS ids
        FROM lrows, lrng GROUP BY ALL)""",
    "lprior AS (SELECT class, sum(w) / (SELECT n FROM lrng) AS p FROM lpts GROUP BY class)",
    """ldiff AS (SELECT a.pid, a.class AS qclass, a.w, b.class AS nclass, b.pid AS tid, b.ids, abs(a.x - b.x) AS d0, CASE WHEN a.line = b.line THEN 0.0 ELSE 1.0 END AS d1,
        CASE WHEN a.flag = b.flag THEN 0.0 ELSE 1.0 END AS d2, CASE WHEN a.status = b.status THEN 0.0 ELSE 1.0 END AS d3 FROM lpts a JOIN lpts b ON a.pid <> b.pid)""",
    f"lnear AS (SELECT *, round(d0 + d1 + d2 + d3, 12) AS d FROM ldiff QUALIFY row_number() OVER (PARTITION BY pid, nclass ORDER BY d, tid) <= {RELIEF_K})",
    f"leach AS (SELECT *, CASE WHEN qclass = nclass THEN least(w - 1, {RELIEF_K}) ELSE 0 END AS z, unnest(ids) AS id FROM lnear)",
    f"ltaken AS (SELECT * FROM leach QUALIFY row_number() OVER (PARTITION BY pid, nclass ORDER BY d, id) <= {RELIEF_K} - z)",
    "lcnt AS (SELECT *, z + count(*) OVER (PARTITION BY pid, nclass) AS cnt FROM ltaken)",
    """lf AS (SELECT c.*, w * CASE WHEN nclass = qclass THEN -1.0 ELSE pn.p / (1 - pq.p) END / cnt AS f
        FROM lcnt c JOIN lprior pn ON pn.class = c.nclass JOIN lprior pq ON pq.class = c.qclass)""",
]
ORACLES["relieff_lineitem"] = q(
    RELIEF_LINES, " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS idx, round(sum(f * d{i}) / (SELECT n FROM lrng), 6) AS weight FROM lf" for i in range(4))
)

# ------------------------------------------------------------------ CFS (pair SU by brute force, search unrolled)
M_BAND = len(BAND_FEATS)
BROWCODES = """browcodes AS (
  SELECT c.round, c.part, c.row_id, c.idx,
         CASE WHEN c.num IS NULL THEN c.cat
              ELSE CAST((SELECT count(*) FROM cuts k WHERE k.round = c.round AND k.part = c.part AND k.idx = c.idx AND c.num > k.cut) AS VARCHAR) END AS code
  FROM cells c)"""
BPAIRSU = f"""bpct AS (SELECT a.round, a.part, a.idx AS ia, b.idx AS ib, a.code AS ca, b.code AS cb, count(*) AS n
           FROM browcodes a JOIN browcodes b ON a.round = b.round AND a.part = b.part AND a.row_id = b.row_id GROUP BY ALL),
bpa AS (SELECT round, part, ia, ib, sum({xlogx('m')}) AS sa FROM (SELECT round, part, ia, ib, ca, sum(n) AS m FROM bpct GROUP BY ALL) GROUP BY ALL),
bpb AS (SELECT round, part, ia, ib, sum({xlogx('m')}) AS sb FROM (SELECT round, part, ia, ib, cb, sum(n) AS m FROM bpct GROUP BY ALL) GROUP BY ALL),
bpab AS (SELECT round, part, ia, ib, sum({xlogx('n')}) AS sab, sum(n) AS ntot FROM bpct GROUP BY ALL),
bph AS (SELECT round, part, ia, ib, {h_of('sa', 'ntot')} AS h_a, {h_of('sb', 'ntot')} AS h_b, {h_of('sab', 'ntot')} AS h_ab
        FROM bpab JOIN bpa USING (round, part, ia, ib) JOIN bpb USING (round, part, ia, ib)),
psu AS (SELECT round, part, ia, ib, CASE WHEN h_a + h_b > 0 THEN 2 * (h_a + h_b - h_ab) / (h_a + h_b) ELSE 0.0 END AS su FROM bph),
rcf AS (SELECT round, part, idx, su AS rcf FROM scores)"""


def cfs_ctes(m: int = M_BAND) -> list[str]:
    out = [
        BROWCODES,
        BPAIRSU,
        "st0 AS (SELECT DISTINCT round, part, CAST([] AS INTEGER[]) AS sel, 0 AS k, 0.0 AS srcf, 0.0 AS srff, 0.0 AS merit FROM assign)",
    ]
    for s in range(m + 1):
        out.append(
            f"""cd{s} AS (SELECT st.round, st.part, f.idx, f.rcf,
                   (st.srcf + f.rcf) / sqrt(st.k + 1 + 2 * (st.srff + coalesce((SELECT sum(p.su) FROM psu p WHERE p.round = st.round AND p.part = st.part
                        AND p.ia = f.idx AND list_contains(st.sel, p.ib)), 0.0))) AS m_new,
                   coalesce((SELECT sum(p.su) FROM psu p WHERE p.round = st.round AND p.part = st.part AND p.ia = f.idx AND list_contains(st.sel, p.ib)), 0.0) AS acc,
                   st.merit
            FROM st{s} st JOIN rcf f ON f.round = st.round AND f.part = st.part WHERE NOT list_contains(st.sel, f.idx))"""
        )
        out.append(
            f"""bs{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round, part ORDER BY round(m_new, 9) DESC, idx) AS rk FROM cd{s})
            WHERE rk = 1 AND round(m_new, 9) > round(merit, 9))"""
        )
        out.append(
            f"""st{s + 1} AS (SELECT st.round, st.part,
                   CASE WHEN b.idx IS NULL THEN st.sel ELSE list_append(st.sel, CAST(b.idx AS INTEGER)) END AS sel,
                   st.k + CASE WHEN b.idx IS NULL THEN 0 ELSE 1 END AS k,
                   st.srcf + coalesce(b.rcf, 0.0) AS srcf, st.srff + coalesce(b.acc, 0.0) AS srff, coalesce(b.m_new, st.merit) AS merit
            FROM st{s} st LEFT JOIN bs{s} b ON b.round = st.round AND b.part = st.part)"""
        )
    g = m + 1
    out.append(f"lp0 AS (SELECT round, part, sel FROM st{g})")
    for s in range(m):
        out.append(
            f"""lc{s} AS (SELECT l.round, l.part, f.idx, f.rcf,
                   greatest(0.0, coalesce((SELECT max(p.su) FROM psu p WHERE p.round = l.round AND p.part = l.part AND p.ia = f.idx AND list_contains(l.sel, p.ib)), 0.0)) AS mx
            FROM lp{s} l JOIN rcf f ON f.round = l.round AND f.part = l.part WHERE NOT list_contains(l.sel, f.idx))"""
        )
        out.append(
            f"""lb{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round, part ORDER BY round(rcf, 9) DESC, idx) AS rk FROM lc{s}
                 WHERE round(rcf, 9) > 0 AND round(mx, 9) < round(rcf, 9)) WHERE rk = 1)"""
        )
        out.append(
            f"""lp{s + 1} AS (SELECT l.round, l.part, CASE WHEN b.idx IS NULL THEN l.sel ELSE list_append(l.sel, CAST(b.idx AS INTEGER)) END AS sel
            FROM lp{s} l LEFT JOIN lb{s} b ON b.round = l.round AND b.part = l.part)"""
        )
    out.append(f"cfs AS (SELECT round, part, unnest(sel) AS idx, unnest(generate_series(1, len(sel))) AS step FROM lp{m})")
    return out


ORACLES["cfs_select"] = q(
    band_ig_ctes() + cfs_ctes(),
    "SELECT CAST(round AS BIGINT) AS round, CAST(part AS BIGINT) AS part, CAST(idx AS BIGINT) AS idx, CAST(step AS BIGINT) AS step FROM cfs",
)
ORACLES["cfs_mean_size"] = q(
    band_ig_ctes()
    + cfs_ctes()
    + [
        FEATS,
        BLOCKS,
        "csize AS (SELECT b.round, b.part, count(c.idx) AS n FROM blocks b LEFT JOIN cfs c ON c.round = b.round AND c.part = b.part GROUP BY ALL)",
        """crem AS (SELECT b.round, b.part, f.idx FROM blocks b CROSS JOIN feats f
                    WHERE NOT EXISTS (SELECT 1 FROM cfs c WHERE c.round = b.round AND c.part = b.part AND c.idx = f.idx))""",
        "cper AS (SELECT r.round, r.idx, max(s.n + 1) AS max_n FROM crem r JOIN csize s ON s.round = r.round AND s.part = r.part GROUP BY ALL)",
    ],
    "SELECT CAST(floor(avg(max_n)) AS BIGINT) AS cfs_mean_size, CAST(count(*) AS BIGINT) AS n_records FROM cper",
)


# ------------------------------------------------------------------ naive Bayes on nested subsets


def bayes_ctes(fit: str, train: str, score: str, num: list[str], nom: list[str], subsets: str) -> list[str]:
    """``said``: the class predicted for each row of ``score`` under each subset ``(a, idx)`` of ``subsets``,
    every subset fitted by itself from the rows of ``train``."""

    def values(src: str) -> str:
        return (
            f"x_{src} AS (SELECT c.row_id, c.class, c.idx, '' AS slot, CASE WHEN hi = lo THEN 0.5 ELSE (c.num - lo) / (hi - lo) END AS x FROM cells_{src} c JOIN ends USING (idx) WHERE c.num IS NOT NULL "
            f"UNION ALL SELECT c.row_id, c.class, c.idx, c.cat, 1.0 FROM cells_{src} c JOIN kinds k ON k.idx = c.idx AND k.cat = c.cat AND k.r > 1)"
        )

    tables = list(dict.fromkeys([fit, train, score]))
    return [
        *[cells_cte(t, num, nom, name=f"cells_{t}", scoped=False) for t in tables],
        f"ends AS (SELECT idx, min(num) AS lo, max(num) AS hi FROM cells_{fit} WHERE num IS NOT NULL GROUP BY idx)",
        f"kinds AS (SELECT idx, cat, row_number() OVER (PARTITION BY idx ORDER BY count(*), cat DESC) AS r FROM cells_{fit} WHERE cat IS NOT NULL GROUP BY idx, cat)",
        *[values(t) for t in dict.fromkeys([train, score])],
        "slots AS (SELECT idx, '' AS slot FROM ends UNION ALL SELECT idx, cat FROM kinds WHERE r > 1)",
        f"ranked AS (SELECT class, row_number() OVER (ORDER BY count(*) DESC, class) AS ord FROM {fit} GROUP BY class)",
        f"priors AS (SELECT r.class, r.ord, ln(count(t.class) + 1) - ln((SELECT count(*) FROM {train}) + (SELECT count(*) FROM ranked)) AS prior FROM ranked r LEFT JOIN {train} t ON t.class = r.class GROUP BY ALL)",
        f"sums AS (SELECT s.idx, s.slot, p.class, coalesce(sum(x.x), 0) AS s FROM slots s CROSS JOIN priors p LEFT JOIN x_{train} x ON x.idx = s.idx AND x.slot = s.slot AND x.class = p.class GROUP BY ALL)",
        f"subsets AS ({subsets})",
        "theta AS (SELECT u.a, s.idx, s.slot, s.class, ln(s.s + 1) - ln(sum(s.s) OVER (PARTITION BY u.a, s.class) + count(*) OVER (PARTITION BY u.a, s.class)) AS w FROM subsets u JOIN sums s USING (idx))",
        f"likely AS (SELECT t.a, x.row_id, t.class, sum(x.x * t.w) AS l FROM x_{score} x JOIN theta t ON t.idx = x.idx AND t.slot = x.slot GROUP BY ALL)",
        f"""said AS (
  SELECT u.a, r.row_id, r.class AS truth, arg_max(p.class, (round(p.prior + coalesce(l.l, 0), 9), -p.ord)) AS prediction
  FROM (SELECT DISTINCT a FROM subsets) u CROSS JOIN {score} r CROSS JOIN priors p
  LEFT JOIN likely l ON l.a = u.a AND l.row_id = r.row_id AND l.class = p.class GROUP BY ALL)""",
    ]


ORACLES["classifier_complexity_nb"] = q(
    sweep_ctes() + bayes_ctes("train", "train", "train", BAND_NUM, BAND_NOM, "SELECT c.a, t.idx FROM cands c JOIN totals t ON t.votes = 0 OR t.votes < c.a"),
    f"SELECT CAST(a AS BIGINT) AS a, {rnd('1 - avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END)')} AS complexity FROM said GROUP BY a",
)
ORACLES["nested_bayes"] = q(
    [BAND] + bayes_ctes("band", "band", "band", BAND_NUM, BAND_NOM, f"SELECT a, idx FROM (SELECT unnest(range(1, {len(BAND_FEATS) + 1})) AS a), (SELECT unnest(range({len(BAND_FEATS)})) AS idx) WHERE idx < a"),
    "SELECT a AS n_features, truth AS class, prediction, count(*) AS n FROM said GROUP BY ALL",
)
_FOLDED = "docfolds AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY row_id) - 1) % 3 AS fold FROM docs)"
ORACLES["nb_predictions"] = q(
    [DOC, _FOLDED, "doctrain AS (SELECT * FROM docfolds WHERE fold <> 0)", "doctest AS (SELECT * FROM docfolds WHERE fold = 0)"]
    + bayes_ctes("docs", "doctrain", "doctest", DOC_NUM, ["lang", "source"], "SELECT 0 AS a, unnest(range(6)) AS idx"),
    "SELECT row_id, truth, prediction FROM said",
)
