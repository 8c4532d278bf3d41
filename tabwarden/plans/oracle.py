"""DuckDB SQL that says from the definitions what the registered queries return."""

from __future__ import annotations

from .frames import TREES

R = "(round(({})::DOUBLE, 6) + 0.0)"


def r(x: str) -> str:
    return R.format(x)


ORD = """ord AS (
  SELECT o_orderkey AS k, (c_acctbal >= 0)::BIGINT AS a, c_mktsegment AS seg, (o_orderstatus = 'F')::BIGINT AS y,
    (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::BIGINT AS y3, o_orderpriority AS s, o_totalprice AS price, c_acctbal AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
EMB = "emb AS (SELECT vec_id AS id, label::BIGINT AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(10)) + " FROM embeddings)"
DOC = "doc AS (SELECT doc_id, lang, source, quality::BIGINT AS y, toxic::BIGINT AS t FROM documents JOIN labels USING (doc_id))"
BIN = ORD + """, sb AS (
  SELECT 'blind' AS model, (k % 5)::BIGINT AS fold, y, ((k * 7919) % 1000) / 1000.0::DOUBLE AS p FROM ord
  UNION ALL SELECT 'keen', (k % 5)::BIGINT, y, round(((k * 7717) % 997 + y * 300) / 1297.0::DOUBLE, 3) FROM ord
)"""
SOFT = """sc AS (
  SELECT 'softmax' AS model, (vec_id % 3)::BIGINT AS fold, vec_id AS id, label::BIGINT AS y,
    list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p
  FROM (SELECT vec_id, label, list_transform(embedding[2:11], lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
), ovr AS (
  SELECT model, fold, c AS class, (y = c)::BIGINT AS y, p[c + 1] AS p FROM sc, (SELECT unnest(range(10)) AS c)
), hard AS (SELECT model, fold, y, (list_position(p, list_max(p)) - 1)::BIGINT AS predicted FROM sc)"""
SHAP = "shap AS (" + " UNION ALL ".join(
    f"SELECT id, {c}::BIGINT AS class, 'f{i}' AS feature, f{i} AS value, f{i} * ({(i + 1) * (c + 1) % 7 - 3}) AS shap FROM emb" for c in range(3) for i in range(10)
) + ")"


def ct(facet: str = "a", outcome: str = "y") -> str:
    return f"WITH {ORD}, x AS (SELECT {facet} AS a, {outcome} AS y, s, price FROM ord)"


def case_of(node, c: int) -> str:
    """A tree's value for class c as nested CASE."""
    return f"{node[c]}::DOUBLE" if isinstance(node, list) else f"CASE WHEN f{node[0]} <= {node[1]} THEN {case_of(node[2], c)} ELSE {case_of(node[3], c)} END"


def som_sql(k: int, epochs: int, last: float = 0.3, d: int = 10) -> str:
    """A self-organising map over the embeddings' components, trained in SQL: each epoch's units from the means of the rows nearest to the units before."""
    import math

    dx = math.ceil(math.sqrt(k))
    dy = math.ceil(k / dx)
    first = max(min(dx, dy) / 2, last)
    parts = [
        EMB, "l AS (SELECT id, u.f, u.v FROM emb, (SELECT unnest([" + ", ".join(f"{{f: {i}, v: f{i}}}" for i in range(d)) + "]) AS u))",
        "m AS (SELECT f, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY f)",
        "z AS MATERIALIZED (SELECT id, f, CASE WHEN std > 0 THEN (v - mean) / std ELSE 0 END AS x FROM l JOIN m USING (f))",
        f"c AS (SELECT i * {dy} + j AS c, i, j FROM (SELECT unnest(range({dx})) AS i), (SELECT unnest(range({dy})) AS j))",
        f"u0 AS MATERIALIZED (SELECT c, f, CASE WHEN f % 2 = 0 THEN (2 * i + 1)::DOUBLE / {dx} - 1 ELSE (2 * j + 1)::DOUBLE / {dy} - 1 END AS w FROM c, (SELECT unnest(range({d})) AS f))",
    ]
    nearest = "b{0} AS MATERIALIZED (SELECT id, arg_min(c, d) AS c FROM (SELECT id, c, sum((x - w) * (x - w)) AS d FROM z JOIN u{0} USING (f) GROUP BY id, c ORDER BY c) GROUP BY id)"
    for e in range(epochs):
        sigma = first * (last / first) ** (e / max(1, epochs - 1))
        parts += [
            nearest.format(e), f"s{e} AS (SELECT c, f, sum(x) AS s, count(*) AS n FROM b{e} JOIN z USING (id) GROUP BY c, f)",
            f"u{e + 1} AS MATERIALIZED (SELECT a.c, s.f, sum(h * s.s) / sum(h * s.n) AS w FROM (SELECT p.c, q.c AS o, exp(-((p.i - q.i) ** 2 + (p.j - q.j) ** 2) / {2 * sigma**2!r}::DOUBLE) AS h FROM c p, c q) a JOIN s{e} s ON s.c = a.o GROUP BY a.c, s.f)",
        ]
    return "WITH " + ", ".join([*parts, nearest.format(epochs)]) + f" SELECT c::INTEGER AS cluster, count(*)::BIGINT AS n FROM b{epochs} GROUP BY c"


ONE = "'Overall' AS scope"
#: Facet by outcome with zeros where no row is.
GRID = """, g AS (
  SELECT a, y, (SELECT count(*) FROM x z WHERE z.a = u.a AND z.y = v.y)::BIGINT AS n
  FROM (SELECT DISTINCT a FROM x) u, (SELECT DISTINCT y FROM x) v
)"""
PMF = GRID + ", pm AS (SELECT a, y, n / (sum(n) OVER (PARTITION BY a))::DOUBLE AS p FROM g)"
TWO = PMF + ", t AS (SELECT y, max(p) FILTER (WHERE a = 1) AS p1, max(p) FILTER (WHERE a = 0) AS p0 FROM pm GROUP BY y)"


def metrics(prefix: str, values: dict[str, str], of: str) -> str:
    return prefix + " " + " UNION ALL ".join(f"SELECT {ONE}, '{m}' AS metric, {r(v)} AS value FROM {of}" for m, v in values.items())


KL = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * ln({p} / (CASE WHEN {q} > 0 THEN {q} ELSE 1e-10 END)) ELSE 0 END"
M_ = "((p1 + p0) / 2)"
MI = """, c AS (SELECT a, y, count(*)::DOUBLE AS n FROM x GROUP BY a, y),
  m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)"""
NMI = "sum(n / t * ln(n * t / (na * ny))) / ((-sum(n / t * ln(na / t)) - sum(n / t * ln(ny / t))) / 2)"
NCMI = """, c AS (SELECT s, a, y, count(*)::DOUBLE AS n FROM x GROUP BY s, a, y),
  m AS (SELECT s, n, sum(n) OVER (PARTITION BY s, a) AS na, sum(n) OVER (PARTITION BY s, y) AS ny, sum(n) OVER (PARTITION BY s) AS ns, sum(n) OVER () AS t FROM c)"""
MEANS = "(avg(y) FILTER (WHERE a = 1))", "(avg(y) FILTER (WHERE a = 0))"
CBD = ", d AS (SELECT count(*) AS n, avg(y) FILTER (WHERE a = 1) - avg(y) FILTER (WHERE a = 0) AS b FROM x GROUP BY s)"
DTAB = GRID + ", dt AS (SELECT a, y, n / (sum(n) OVER (PARTITION BY a))::DOUBLE - (sum(n) OVER (PARTITION BY y)) / (sum(n) OVER ())::DOUBLE AS d FROM g)"
CTAB = """, g AS (
  SELECT u.s, u.a, v.y, (SELECT count(*) FROM x z WHERE z.s = u.s AND z.a = u.a AND z.y = v.y)::BIGINT AS n
  FROM (SELECT DISTINCT s, a FROM x) u, (SELECT DISTINCT y FROM x) v
), dt AS (
  SELECT s, a, y, (n / (sum(n) OVER (PARTITION BY s, a))::DOUBLE - (sum(n) OVER (PARTITION BY y)) / (sum(n) OVER ())::DOUBLE)
    * (sum(n) OVER (PARTITION BY s)) / (sum(n) OVER ()) AS d FROM g
)"""
CHI = """, q AS (SELECT a, y, n, (sum(n) OVER (PARTITION BY a)) * (sum(n) OVER (PARTITION BY y)) / (sum(n) OVER ())::DOUBLE AS e FROM g),
  h AS (SELECT sum({t} * {t} / e) AS chi, sum(n) AS n, least(count(DISTINCT a), count(DISTINCT y)) AS m FROM q)"""
RANK = """, u AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE y = 1) AS p FROM x GROUP BY a),
  w AS (SELECT n, p, row_number() OVER (ORDER BY n DESC, a) AS rn, row_number() OVER (ORDER BY p DESC, a) AS rp FROM u)"""
AT = lambda c, i: f"(max({c}) FILTER (WHERE r{c} = {i}))"

RATES = {
    "sensitivity": "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "specificity": "coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "accuracy": "(tp + tn) / (tp + fp + tn + fn)::DOUBLE",
}
RATES["balanced_accuracy"] = f"(({RATES['sensitivity']}) + ({RATES['specificity']})) / 2"


def conf(by: str, t: str = "0.5::DOUBLE", source: str = "sb") -> str:
    return f"""SELECT {by}, count(*) FILTER (WHERE y = 1 AND p > {t}) AS tp, count(*) FILTER (WHERE y = 0 AND p > {t}) AS fp,
    count(*) FILTER (WHERE y = 0 AND p <= {t}) AS tn, count(*) FILTER (WHERE y = 1 AND p <= {t}) AS fn FROM {source} GROUP BY {by}"""


def auc(by: str, source: str) -> str:
    """From ranks with ties at their mean: (sum of positives' ranks - P (P + 1) / 2) / (P N)."""
    return f"""SELECT {by}, (sum(rk) FILTER (WHERE y = 1) - P * (P + 1) / 2.0) / (P::DOUBLE * N) AS auc FROM (
    SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS rk,
      count(*) FILTER (WHERE y = 1) OVER (PARTITION BY {by}) AS P, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY {by}) AS N FROM {source}) GROUP BY {by}, P, N"""


PER_CLASS = """pc AS (
  SELECT model, fold, c AS class, count(*) FILTER (WHERE y = c AND predicted = c) AS tp, count(*) FILTER (WHERE y <> c AND predicted = c) AS fp,
    count(*) FILTER (WHERE y <> c AND predicted <> c) AS tn, count(*) FILTER (WHERE y = c AND predicted <> c) AS fn
  FROM hard, (SELECT unnest(range(10)) AS c) GROUP BY model, fold, c)"""
MACRO = {n: f"avg({RATES[n]})" for n in ("sensitivity", "specificity", "f1")} | {"accuracy": "sum(tp) / sum(tp + fn)::DOUBLE", "balanced_accuracy": f"avg({RATES['sensitivity']})"}


def rate(name: str) -> str:
    return f"""WITH {BIN}, {SOFT}, {PER_CLASS}, b AS ({conf('model, fold')})
SELECT model, fold, {r(RATES[name])} AS {name} FROM b UNION ALL SELECT model, fold, {r(MACRO[name])} FROM pc GROUP BY model, fold"""


GRID20 = "(SELECT (2 + 5 * unnest(range(20))) / 100.0::DOUBLE AS t)"
BEST = f"""tt AS (SELECT sb.*, t FROM sb, {GRID20} g), tc AS (
  SELECT model, fold, t, count(*) FILTER (WHERE y = 1 AND p > t) AS tp, count(*) FILTER (WHERE y = 0 AND p > t) AS fp,
    count(*) FILTER (WHERE y = 0 AND p <= t) AS tn, count(*) FILTER (WHERE y = 1 AND p <= t) AS fn FROM tt GROUP BY model, fold, t
), best AS (
  SELECT model, fold, t AS threshold, round({RATES['balanced_accuracy']}, 12) AS score FROM tc
  QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY round({RATES['balanced_accuracy']}, 12) DESC, t) = 1)"""


def cum(by: str, source: str) -> str:
    """At each distinct score: rows at or above it."""
    return f"""SELECT {by}, p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS P, sum(neg) OVER (PARTITION BY {by}) AS N
  FROM (SELECT {by}, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM {source} GROUP BY {by}, p) WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)"""


def ap(by: str, source: str) -> str:
    return f"""SELECT {by}, sum((rec - prev) * prec) AS ap FROM (SELECT {by}, tp / P::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS prec,
    coalesce(lag(tp / P::DOUBLE) OVER (PARTITION BY {by} ORDER BY threshold DESC), 0) AS prev FROM ({cum(by, source)})) GROUP BY {by}"""


MACRO_AUC = f"""cu AS ({cum('model, class', 'ovr')}), pt AS (
  SELECT model, class, fp / N::DOUBLE AS fpr, max(tp / P::DOUBLE) AS tpr, min(tp / P::DOUBLE) AS foot FROM cu GROUP BY ALL
  UNION SELECT DISTINCT model, class, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM cu WHERE NOT EXISTS (SELECT 1 FROM cu z WHERE z.model = cu.model AND z.class = cu.class AND z.fp = 0)
), xs AS (SELECT DISTINCT model, fpr FROM pt), gr AS (
  SELECT xs.model, xs.fpr, c.class FROM xs JOIN (SELECT DISTINCT model, class FROM pt) c ON c.model = xs.model
), lo AS (SELECT gr.model, gr.class, gr.fpr, pt.fpr AS x0, pt.tpr AS y0 FROM gr ASOF JOIN pt ON pt.model = gr.model AND pt.class = gr.class AND gr.fpr >= pt.fpr
), hi AS (SELECT gr.model, gr.class, gr.fpr, pt.fpr AS x1, pt.foot AS y1 FROM gr ASOF JOIN pt ON pt.model = gr.model AND pt.class = gr.class AND gr.fpr <= pt.fpr
), me AS (
  SELECT model, fpr, avg(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (fpr - x0) / (x1 - x0) END) AS tpr FROM lo JOIN hi USING (model, class, fpr) GROUP BY model, fpr
), ma AS (SELECT model, sum(w) AS auc FROM (
  SELECT model, (fpr - lag(fpr) OVER q) * (tpr + lag(tpr) OVER q) / 2 AS w FROM me WINDOW q AS (PARTITION BY model ORDER BY fpr)) GROUP BY model)"""

FOLDS = "fl AS (" + " UNION ALL ".join(f"SELECT model, fold, '{n}' AS metric, {v} AS value FROM b" for n, v in RATES.items()) + " UNION ALL SELECT model, fold, 'auc', auc FROM u)"
BUNDLE = f"b AS ({conf('model, fold')}), u AS ({auc('model, fold', 'sb')})"
ALL_METRICS = ("sensitivity", "specificity", "auc", "f1", "accuracy", "balanced_accuracy")
NUMBERED = lambda src, y, k, seed: f"SELECT *, row_number() OVER (PARTITION BY {y} ORDER BY md5({k}::VARCHAR || '|{seed}'), {k}) AS rk, count(*) OVER (PARTITION BY {y}) AS nc FROM {src}"
IMPORT = "SELECT feature, avg(abs(shap)) AS importance FROM {} GROUP BY feature ORDER BY round(avg(abs(shap)), 12) DESC, feature LIMIT 5"


def whole_audit(x: str, with_subgroup: bool) -> str:
    """All metrics per scope from rows x(scope, s, a, y)."""
    parts = {
        "CI": "SELECT scope, (max(n) - min(n)) / sum(n)::DOUBLE AS v FROM (SELECT scope, a, count(*) AS n FROM x GROUP BY scope, a) GROUP BY scope",
        "DPL": "SELECT scope, avg((y = 1)::INT) FILTER (WHERE a = 1) - avg((y = 1)::INT) FILTER (WHERE a = 0) AS v FROM x GROUP BY scope",
        "DD": "SELECT scope, 0.0::DOUBLE AS v FROM x GROUP BY scope",
        "DD_max": "SELECT scope, max(abs(d)) AS v FROM (SELECT scope, pm.a, pm.y, p - py AS d FROM pm JOIN py USING (scope, y)) GROUP BY scope",
        "JS": f"SELECT scope, sum(({KL('p1', M_)} + {KL('p0', M_)}) / 2) AS v FROM t GROUP BY scope",
        "L2": "SELECT scope, sqrt(sum((p1 - p0) ** 2)) AS v FROM t GROUP BY scope", "KS": "SELECT scope, max(abs(p1 - p0)) AS v FROM t GROUP BY scope",
        "TVD": "SELECT scope, sum(abs(p1 - p0)) / 2 AS v FROM t GROUP BY scope",
        "NMI": f"SELECT scope, {NMI} AS v FROM mi GROUP BY scope",
        "BR": "SELECT scope, avg(y) FILTER (WHERE a = 1) / avg(y) FILTER (WHERE a = 0) AS v FROM x GROUP BY scope",
        "BD": "SELECT scope, avg(y) FILTER (WHERE a = 1) - avg(y) FILTER (WHERE a = 0) AS v FROM x GROUP BY scope",
        "CORR": "SELECT scope, corr(a, y) AS v FROM x GROUP BY scope",
    }
    if with_subgroup:
        parts |= {
            "CDD": "SELECT scope, 0.0::DOUBLE AS v FROM x GROUP BY scope",
            "CDD_max": "SELECT 'Overall' AS scope, max(abs(d)) AS v FROM dt",
            "NCMI": "SELECT 'Overall' AS scope, sum(n / t * ln(n * ns / (na * ny))) / ln(count(DISTINCT s)) AS v FROM nc",
            "CBD": "SELECT 'Overall' AS scope, sum(n * b) / sum(n) AS v FROM d",
        }
    extra = CTAB.replace(", g AS", ", cg AS").replace("FROM g\n", "FROM cg\n") + NCMI.replace(", c AS", ", cc AS").replace("m AS", "nc AS").replace("FROM c)", "FROM cc)") + CBD if with_subgroup else ""
    base = f"""WITH {ORD}, x AS ({x}), gg AS (
  SELECT u.scope, u.a, v.y, (SELECT count(*) FROM x z WHERE z.scope = u.scope AND z.a = u.a AND z.y = v.y)::BIGINT AS n
  FROM (SELECT DISTINCT scope, a FROM x) u JOIN (SELECT DISTINCT scope, y FROM x) v USING (scope)
), pm AS (SELECT scope, a, y, n / (sum(n) OVER (PARTITION BY scope, a))::DOUBLE AS p FROM gg),
py AS (SELECT scope, y, count(*) / (sum(count(*)) OVER (PARTITION BY scope))::DOUBLE AS py FROM x GROUP BY scope, y),
t AS (SELECT scope, y, max(p) FILTER (WHERE a = 1) AS p1, max(p) FILTER (WHERE a = 0) AS p0 FROM pm GROUP BY scope, y),
mi AS (SELECT scope, n, sum(n) OVER (PARTITION BY scope, a) AS na, sum(n) OVER (PARTITION BY scope, y) AS ny, sum(n) OVER (PARTITION BY scope) AS t
  FROM (SELECT scope, a, y, count(*)::DOUBLE AS n FROM x GROUP BY scope, a, y)){extra},
v AS ({" UNION ALL ".join(f"SELECT scope, '{m}' AS metric, v AS value FROM ({q})" for m, q in parts.items())}),
w AS (SELECT scope, metric, value, CASE WHEN metric = 'CI' THEN 0.9 WHEN metric IN ('DPL', 'DD', 'CDD', 'JS', 'L2', 'TVD', 'KS') THEN 0.1 END::DOUBLE AS threshold FROM v)"""
    beyond = "CASE WHEN metric = 'CI' THEN abs(round(value, 2)) >= threshold ELSE abs(value) > threshold END AS biased"
    columns = f"scope, metric, {r('value')} AS value" + (", threshold" if with_subgroup else "")
    return f"{base} SELECT {columns}, {beyond} FROM w"


SULOV_F = [f"f{i}" for i in range(10)] + ["g0", "g1"]
SULOV = f"""WITH {EMB}, e AS (SELECT *, f0 * 2 + f1 * 0.1::DOUBLE AS g0, f2 - f3 * 0.2::DOUBLE AS g1 FROM emb),
l AS ({" UNION ALL ".join(f"SELECT id, y, '{f}' AS feature, {f} AS x FROM e" for f in SULOV_F)}),
b AS (SELECT feature, y, least(floor((x - min(x) OVER (PARTITION BY feature)) * 10 / (max(x) OVER (PARTITION BY feature) - min(x) OVER (PARTITION BY feature))), 9) AS b FROM l),
c AS (SELECT feature, b, y, count(*)::DOUBLE AS n FROM b GROUP BY feature, b, y),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c),
mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM m GROUP BY feature),
co AS (SELECT p.feature AS a, q.feature AS b, corr(p.x, q.x) AS r FROM l p JOIN l q ON p.id = q.id AND p.feature <> q.feature GROUP BY ALL)
SELECT feature, {r('mi')} AS mi, NOT EXISTS (
  SELECT 1 FROM co JOIN mi o ON o.feature = co.b WHERE co.a = mi.feature AND abs(co.r) > 0.7
    AND (round(mi.mi, 9) < round(o.mi, 9) OR (round(mi.mi, 9) = round(o.mi, 9) AND mi.feature > o.feature))) AS kept FROM mi"""
CORRS = f"WITH {EMB} " + " UNION ALL ".join(f"SELECT 'f{i}' AS f1, 'f{j}' AS f2, {r(f'corr(f{i}, f{j})')} AS r FROM emb" for i in range(10) for j in range(i + 1, 10))
DB_F = [f"f{i}" for i in range(10)]
SUMSQ = lambda a, b: "sqrt(" + " + ".join(f"({a}.{f} - {b}.{f}) ** 2" for f in DB_F) + ")"

ORACLE_SQL = {
    # Newton's steps on the sum of losses and half the squared weight, over the four cells.
    "b18_logistic": f"""WITH RECURSIVE {ORD}, c AS (SELECT a::DOUBLE AS a, y::DOUBLE AS y, count(*)::DOUBLE AS n FROM ord GROUP BY ALL), it AS (
  SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM (
    SELECT i, w, b, sum(n * (p - y) * a) + w AS gw, sum(n * (p - y)) AS gb, sum(n * p * (1 - p) * a * a) + 1 AS hww, sum(n * p * (1 - p) * a) AS hwb, sum(n * p * (1 - p)) AS hbb
    FROM (SELECT it.i, it.w, it.b, c.a, c.y, c.n, 1 / (1 + exp(-(it.w * c.a + it.b))) AS p FROM it, c WHERE it.i < 30) GROUP BY i, w, b)
)
SELECT 'LR' AS metric, round(w, 4) + 0.0 AS value FROM it WHERE i = 30 UNION ALL SELECT 'LR_intercept', round(b, 4) + 0.0 FROM it WHERE i = 30""",
    "l1_logistic_optimum": f"""WITH {EMB}, x AS ({" UNION ALL ".join(f"SELECT id % 3 AS y, '{n}' AS feature, {v} AS x FROM emb" for n, v in [("(one)", "1.0::DOUBLE"), *((f"f{i}", f"f{i}") for i in range(4))])})
SELECT k::BIGINT AS class, feature, round(avg(CASE WHEN y = k THEN x ELSE 0 END), 4) + 0.0 AS mean FROM x, (SELECT unnest(range(3)) AS k) GROUP BY k, feature""",
    **{f"s2_{kind}_scan": f"SELECT event_type, count(*)::BIGINT AS n, count(props ->> '$.k')::BIGINT AS n_prop, {r('sum(value)')} AS total FROM events GROUP BY event_type" for kind in ("json", "orc")},
    "s11_class_profile": f"WITH {ORD} SELECT y3 AS class, count(*)::BIGINT AS n, {r('round(count(*) * 100 / (sum(count(*)) OVER ())::DOUBLE, 2)')} AS percent FROM ord GROUP BY y3",
    "p1_target_check": f"WITH {DOC} SELECT y AS class, count(*)::BIGINT AS n, {r('round(count(*) * 100 / (sum(count(*)) OVER ())::DOUBLE, 2)')} AS percent FROM doc GROUP BY y",
    "p2_index": "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_keys FROM nation",
    "p3_drop_nulls": f"SELECT event_type, count(*)::BIGINT AS n, {r('sum(value)')} AS total FROM events WHERE value > 20 AND event_type <> 'view' GROUP BY event_type",
    "p4_domain_match": f"""WITH {ORD}, h AS (SELECT k, seg, s, CASE WHEN k % 97 = 0 THEN 'odd' ELSE seg END AS seg2 FROM ord),
tr AS (SELECT * FROM h WHERE k % 2 = 0), te AS (SELECT * FROM h WHERE k % 2 = 1 AND seg <> 'BUILDING')
""" + " UNION ALL ".join(f"""SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM tr)::BIGINT AS n_train, (SELECT count(DISTINCT {c}) FROM te)::BIGINT AS n_test,
  ((SELECT count(*) FROM (SELECT {c} FROM tr EXCEPT SELECT {c} FROM te)) + (SELECT count(*) FROM (SELECT {c} FROM te EXCEPT SELECT {c} FROM tr)))::BIGINT AS n_unmatched""" for c in ("seg", "s", "seg2")),
    "p5_prepare": """SELECT CASE WHEN event_id % 4 <> 0 THEN 'train' ELSE 'test' END AS side, user_id % 2 AS target, count(*)::BIGINT AS n FROM events
WHERE value > 20 AND event_type <> 'view' GROUP BY 1, 2""",
    "p6_split_label": f"WITH {DOC} SELECT doc_id, lang, t FROM doc",
    "p7_integer_codes": f"""WITH {DOC}, n AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN lang END AS lang, source FROM doc)
SELECT doc_id, CASE WHEN lang IS NULL THEN -1 ELSE (SELECT count(DISTINCT z.lang) FROM n z WHERE z.lang < n.lang) END::BIGINT AS lang,
  (SELECT count(DISTINCT z.source) FROM n z WHERE z.source < n.source)::BIGINT AS source FROM n""",
    "p8_age_bins": """SELECT (CASE WHEN age <= 0 THEN NULL WHEN age <= 39 THEN 1 WHEN age <= 59 THEN 2 WHEN age > 59 THEN 3 END)::BIGINT AS age, count(*)::BIGINT AS n
FROM (SELECT CASE WHEN p_size % 11 <> 0 THEN p_size * 2 - 3 END AS age FROM part) GROUP BY 1""",
    "p9_filter": f"WITH {ORD} SELECT y3, count(*)::BIGINT AS n, {r('sum(price)')} AS total FROM ord WHERE s = '1-URGENT' AND a = 1 GROUP BY y3",
    "p10_folds": f"WITH {ORD}, q AS ({NUMBERED('ord', 'y3', 'k', 10)}) SELECT ((rk - 1) % 5)::BIGINT AS fold, y3, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys FROM q GROUP BY 1, 2",
    "p11_sample_binary": f"""WITH {ORD}, q AS ({NUMBERED('ord', 'y', 'k', 42)}) SELECT y, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys FROM q
WHERE rk <= floor(nc * least(1.0::DOUBLE, 100.0::DOUBLE / (SELECT count(*) FROM ord))) GROUP BY y""",
    **{name: f"""WITH {EMB}, q AS ({NUMBERED('emb', 'y', 'id', 42)}) SELECT y, count(*)::BIGINT AS n, sum(id)::BIGINT AS keys FROM q
WHERE rk <= least(floor({cap}.0::DOUBLE * nc / (SELECT count(*) FROM emb)), nc) GROUP BY y""" for name, cap in (("p12_sample_multiclass", 100), ("x2_explained_rows", 14))},
    "p13_train_test": f"""WITH {EMB}, q AS ({NUMBERED('emb', 'y', 'id', 42)}) SELECT CASE WHEN (rk - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS side, y, count(*)::BIGINT AS n,
sum(id)::BIGINT AS keys FROM q GROUP BY 1, 2""",
    "b1_class_imbalance": metrics(ct("seg"), {"CI": "(max(n) - min(n)) / sum(n)::DOUBLE"}, "(SELECT a, count(*) AS n FROM x GROUP BY a)"),
    "b2_label_difference": metrics(ct(), {"DPL": f"{MEANS[0]} - {MEANS[1]}"}, "x"),
    "b2_label_difference_by_rank": metrics(ct() + RANK, {"DPL_rank": f"{AT('p', 2)} / {AT('n', 2)}::DOUBLE - {AT('p', 1)} / {AT('n', 1)}::DOUBLE"}, "w"),
    "b3_disparity": metrics(ct("seg", "y3") + DTAB, {"DD": "max(0.0)", "DD_max": "max(abs(d))"}, "dt"),
    "b3_disparity_table": f"{ct('seg', 'y3')}{DTAB} SELECT {ONE}, a, y, {r('d')} AS d FROM dt",
    "b4_conditional_disparity": metrics(ct() + CTAB, {"CDD": "max(0.0)", "CDD_max": "max(abs(d))"}, "dt"),
    "b4_conditional_table": f"{ct()}{CTAB} SELECT {ONE}, s, a, y, {r('d')} AS d FROM dt",
    "b5_pmf": f"{ct('seg', 'y3')}{PMF} SELECT {ONE}, a, y, {r('p')} AS p FROM pm",
    "b6_kl": metrics(ct("a", "y3") + TWO, {"KL": f"sum({KL('p1', 'p0')})"}, "t"),
    "b7_b8_b10_distances": metrics(ct("a", "y3") + TWO, {"JS": f"sum(({KL('p1', M_)} + {KL('p0', M_)}) / 2)", "L2": "sqrt(sum((p1 - p0) ** 2))", "KS": "max(abs(p1 - p0))"}, "t"),
    "b9_total_variation": metrics(ct("seg", "y3") + PMF, {"TVD": "avg(d)"}, "(SELECT u.a, v.a AS b, sum(abs(u.p - v.p)) / 2 AS d FROM pm u JOIN pm v ON u.y = v.y AND u.a < v.a GROUP BY 1, 2)"),
    "b11_nmi": metrics(ct("seg", "y3") + MI, {"NMI": NMI}, "m"),
    "b12_ncmi": metrics(ct("seg", "y3") + NCMI, {"NCMI": "sum(n / t * ln(n * ns / (na * ny))) / ln(count(DISTINCT s))"}, "m"),
    "b13_b14_binary_means": metrics(ct(), {"BR": f"{MEANS[0]} / {MEANS[1]}", "BD": f"{MEANS[0]} - {MEANS[1]}"}, "x"),
    "b15_conditional_difference": metrics(ct() + CBD, {"CBD": "sum(n * b) / sum(n)"}, "d"),
    "b16_correlation": metrics(ct("a", "y3"), {"CORR": "corr(a, y)"}, "x"),
    "b17_cramers_v": f"""{ct('seg', 'y3')}{GRID}{CHI.format(t='(n - e)')} SELECT {ONE}, 'V' AS metric, {r('sqrt(chi / (n * (m - 1)))')} AS value FROM h
UNION ALL SELECT 'two', 'V', value FROM ({ct()}{GRID}{CHI.format(t='(abs(n - e) - least(0.5, abs(n - e)))')} SELECT {r('sqrt(chi / (n * (m - 1)))')} AS value FROM h)""",
    "b19_audit": whole_audit(f"SELECT {ONE}, s, a, y FROM ord", True),
    "b20_bands": f"""WITH {ORD}, v AS (SELECT 'BR' AS metric, {MEANS[0]} / {MEANS[1]} AS value FROM ord UNION ALL SELECT 'BD', {MEANS[0]} - {MEANS[1]} FROM ord
UNION ALL SELECT 'CI', (max(n) - min(n)) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM ord GROUP BY a)),
w AS (SELECT metric, value, CASE WHEN metric = 'BR' THEN 0.8 ELSE -0.1 END::DOUBLE AS low, CASE WHEN metric = 'BR' THEN 1.25 ELSE 0.1 END::DOUBLE AS high FROM v)
SELECT metric, {r('value')} AS value, low, high, value BETWEEN low AND high AS fair FROM w""",
    "c2_davies_bouldin": f"""WITH {EMB}, ce AS (SELECT y, {", ".join(f"avg({f}) AS {f}" for f in DB_F)} FROM emb GROUP BY y),
sc AS (SELECT emb.y, avg({SUMSQ('emb', 'ce')}) AS s FROM emb JOIN ce USING (y) GROUP BY emb.y),
w AS (SELECT p.y, max((u.s + v.s) / {SUMSQ('p', 'q')}) AS r FROM ce p JOIN ce q ON p.y <> q.y JOIN sc u ON u.y = p.y JOIN sc v ON v.y = q.y GROUP BY p.y)
SELECT {r('avg(r)')} AS "index" FROM w""",
    "c5_cluster_audit": whole_audit("SELECT 'Cluster ' || s AS scope, s, a, y FROM ord", False),
    "f1_sulov": SULOV, "f1_correlations": CORRS,
    "f8_z_scores": f"WITH {EMB} SELECT id, {r('(f0 - avg(f0) OVER ()) / stddev_pop(f0) OVER ()')} AS f0, {r('(f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER ()')} AS f1, 0.0::DOUBLE AS one FROM emb",
    "f9_one_hot": f"WITH {ORD} SELECT k, " + ", ".join(f"(seg = '{s}')::BIGINT AS seg_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM ord",
    "f10_routing": "SELECT * FROM (VALUES ('a', 'numeric'), ('y3', 'numeric'), ('price', 'numeric'), ('bal', 'numeric'), ('seg', 'text'), ('s', 'text')) v(feature, kind)",
    "f12_class_weight": f"WITH {ORD} SELECT {r('count(*) FILTER (WHERE y = 0) / (count(*) FILTER (WHERE y = 1))::DOUBLE')} AS weight FROM ord",
    "m1_predictions": f"""WITH {BIN}, {SOFT} SELECT model, fold, y, (p > 0.5)::BIGINT AS predicted, count(*)::BIGINT AS n FROM sb GROUP BY ALL
UNION ALL SELECT model, fold, y, predicted, count(*)::BIGINT FROM hard GROUP BY ALL""",
    "m2_confusion": f"WITH {BIN}, b AS ({conf('model, fold')}) SELECT model, fold::INTEGER AS fold, tp, fp, tn, fn FROM b",
    "m2_class_confusion": f"""WITH {SOFT} SELECT f.model, f.fold, a AS actual, b AS predicted, (SELECT count(*) FROM hard h WHERE h.fold = f.fold AND h.y = a AND h.predicted = b)::BIGINT AS n
FROM (SELECT DISTINCT model, fold FROM hard) f, (SELECT unnest(range(10)) AS a), (SELECT unnest(range(10)) AS b)""",
    "m2_class_counts": f"WITH {SOFT}, {PER_CLASS} SELECT model, fold, class, tp, fp, tn, fn FROM pc",
    "m3_sensitivity": rate("sensitivity"), "m4_specificity": rate("specificity"), "m6_f1": rate("f1"), "m7_accuracy": rate("accuracy"), "m8_balanced_accuracy": rate("balanced_accuracy"),
    "m5_auc": f"""WITH {BIN}, {SOFT}, u AS ({auc('model, fold', 'sb')}), v AS ({auc('model, fold, class', 'ovr')})
SELECT model, fold, {r('auc')} AS auc FROM u UNION ALL SELECT model, fold, {r('avg(coalesce(auc, 0.5))')} FROM v GROUP BY model, fold""",
    "m9_bundle": f"WITH {BIN}, {BUNDLE} SELECT model, fold, tp, fp, tn, fn, " + ", ".join(f"{r('auc' if n == 'auc' else RATES[n])} AS {n}" for n in ALL_METRICS) + " FROM b JOIN u USING (model, fold)",
    "m10_sweep": f"""WITH {BIN}, tt AS (SELECT sb.*, t FROM sb, (SELECT unnest(range(11)) / 10.0::DOUBLE AS t)), b AS ({conf('model, fold, t', 't', 'tt')})
SELECT model, fold, t AS threshold, {r(RATES['sensitivity'])} AS sensitivity, {r(RATES['specificity'])} AS specificity, {r(RATES['f1'])} AS f1 FROM b""",
    "m11_thresholds": f"""WITH {BIN}, {BEST}, u AS ({auc('model, fold', 'sb')}) SELECT model, fold, threshold, {r('score')} AS score, 'balanced_accuracy' AS "by" FROM best
UNION ALL SELECT model, fold, 0.02::DOUBLE, {r('auc')}, 'auc' FROM u""",
    "m12_roc": f"""WITH {BIN}, c AS ({cum('model', 'sb')}) SELECT model, {r('threshold')} AS threshold, {r('fp / N::DOUBLE')} AS fpr, {r('tp / P::DOUBLE')} AS tpr FROM c
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c""",
    "m12_class_auc": f"WITH {SOFT}, u AS ({auc('model, class', 'ovr')}) SELECT model, class, {r('auc')} AS auc FROM u",
    "m13_micro_roc": f"WITH {SOFT}, u AS ({auc('model', 'ovr')}) SELECT model, {r('auc')} AS auc FROM u",
    "m14_macro_roc": f"WITH {SOFT}, {MACRO_AUC} SELECT model, {r('auc')} AS auc FROM ma",
    "m15_pr_curve": f"WITH {BIN}, c AS ({cum('model', 'sb')}) SELECT model, {r('threshold')} AS threshold, {r('tp / (tp + fp)::DOUBLE')} AS precision, {r('tp / P::DOUBLE')} AS recall FROM c",
    "m15_average_precision": f"WITH {BIN}, {SOFT} SELECT model, {r('ap')} AS ap FROM ({ap('model', 'sb')}) UNION ALL SELECT model, {r('ap')} FROM ({ap('model', 'ovr')})",
    "m16_curves": f"""WITH {SOFT}, {MACRO_AUC} SELECT model, 'roc' AS curve, class::BIGINT AS class, {r('auc')} AS value FROM ({auc('model, class', 'ovr')})
UNION ALL SELECT model, 'roc_micro', NULL, {r('auc')} FROM ({auc('model', 'ovr')}) UNION ALL SELECT model, 'roc_macro', NULL, {r('auc')} FROM ma
UNION ALL SELECT model, 'pr', class, {r('ap')} FROM ({ap('model, class', 'ovr')}) UNION ALL SELECT model, 'pr_micro', NULL, {r('ap')} FROM ({ap('model', 'ovr')})""",
    "r1_fold_summary": f"WITH {BIN}, {BUNDLE}, {FOLDS} SELECT model, metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM fl GROUP BY model, metric",
    "r2_mean_confusion": f"""WITH {BIN}, {SOFT}, b AS ({conf('model, fold')})
SELECT model, 1::BIGINT AS actual, 1::BIGINT AS predicted, {r('avg(tp)')} AS n FROM b GROUP BY model UNION ALL SELECT model, 1, 0, {r('avg(fn)')} FROM b GROUP BY model
UNION ALL SELECT model, 0, 1, {r('avg(fp)')} FROM b GROUP BY model UNION ALL SELECT model, 0, 0, {r('avg(tn)')} FROM b GROUP BY model
UNION ALL SELECT 'softmax', a, b, {r('(SELECT count(*) FROM hard WHERE y = a AND predicted = b) / (SELECT count(DISTINCT fold) FROM hard)::DOUBLE')}
FROM (SELECT unnest(range(10)) AS a), (SELECT unnest(range(10)) AS b)""",
    "r3_wide_report": f"WITH {BIN}, {BUNDLE} SELECT model, " + ", ".join(f"{r(f'avg({"auc" if n == "auc" else RATES[n]})')} AS {n}" for n in ALL_METRICS) + " FROM b JOIN u USING (model, fold) GROUP BY model",
    "r4_hold_out_summary": f"WITH {BIN}, s0 AS (SELECT * FROM sb WHERE fold = 0), b AS ({conf('model', source='s0')}), u AS ({auc('model', 's0')}) SELECT model, "
    + ", ".join(f"{r('auc' if n == 'auc' else RATES[n])} AS {n}" for n in ALL_METRICS) + " FROM b JOIN u USING (model)",
    "r5_confusion_layout": f"WITH {BIN} SELECT model, y AS actual, (p > 0.5)::BIGINT AS predicted, count(*)::BIGINT AS n FROM sb GROUP BY ALL",
    "r6_mean_threshold": f"WITH {BIN}, {BEST} SELECT model, {r('avg(threshold)')} AS threshold FROM best GROUP BY model",
    "t4_search_score": f"""WITH {BIN}, {SOFT} SELECT model, {r('auc')} AS auc FROM ({auc('model', 'sb')})
UNION ALL SELECT model, {r('avg(auc)')} FROM ({auc('model, class', 'ovr')}) GROUP BY model""",
    "c1_clusters": som_sql(5, 10),
    "l7_best_split": f"""WITH {EMB}, x AS (SELECT id, (y < 5)::INT AS t, u.f AS feature, round(u.v, 1) AS v FROM emb, (SELECT unnest([{", ".join(f"{{f: 'f{i}', v: f{i}}}" for i in range(4))}]) AS u)),
n AS (SELECT feature, v, sum(0.5 - t) AS g, sum(0.25) AS h FROM x GROUP BY feature, v),
c AS (
  SELECT feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS ga, sum(h) OVER (PARTITION BY feature) AS ha, max(v) OVER (PARTITION BY feature) AS top
  FROM n WINDOW w AS (PARTITION BY feature ORDER BY v)
), s AS (
  SELECT feature, v, gl / (hl + 1) AS l, (ga - gl) / (ha - hl + 1) AS r, (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2 AS gain FROM c WHERE v < top
)
SELECT feature, {r("v")} AS threshold, {r("gain")} AS gain, {r("-l")} AS below, {r("-r")} AS above FROM s ORDER BY round(gain, 9) DESC, feature, v LIMIT 1""",
    **dict.fromkeys(("x5_tree_shap", "x6_kernel_shap"), f"""WITH {EMB}, q AS ({NUMBERED('emb', 'y', 'id', 42)}), b AS (
  SELECT f0, f1, f2, f3 FROM q WHERE rk <= least(floor(100.0::DOUBLE * nc / (SELECT count(*) FROM emb)), nc)
), h AS (
  SELECT e.id, s.s, {", ".join(f"CASE WHEN (s.s >> {i}) & 1 = 1 THEN e.f{i} ELSE b.f{i} END AS f{i}" for i in range(4))}
  FROM emb e, b, (SELECT unnest(range(16)) AS s) s
), v AS (SELECT id, s, {", ".join(f"avg({' + '.join(case_of(t, c) for t in TREES)}) AS v{c}" for c in (0, 1))} FROM h GROUP BY id, s),
w AS (SELECT id, c AS class, s, CASE c WHEN 0 THEN v0 ELSE v1 END AS v FROM v, (SELECT unnest([0, 1]) AS c))
""" + " UNION ALL ".join(
        f"""SELECT w.id, w.class::BIGINT AS class, 'f{i}' AS feature, {r(f"sum((CASE WHEN (s >> {i}) & 1 = 1 THEN 1 ELSE -1 END) * v / (4 * [1, 3, 3, 1][bit_count(s & {15 - (1 << i)}) + 1]))")} AS shap FROM w GROUP BY w.id, w.class""" for i in range(4)
    )),
    "x4_linear_shap": f"WITH {EMB} " + " UNION ALL ".join(f"SELECT id, 'f{i}' AS feature, {r(f'{(i - 4.5) / 10}::DOUBLE * (f{i} - avg(f{i}) OVER ())')} AS shap FROM emb" for i in range(10)),
    "x7_telling_class": f"WITH {EMB}, {SHAP} SELECT class, {r('avg(abs(shap))')} AS mean FROM shap GROUP BY class ORDER BY round(avg(abs(shap)), 12) DESC, class LIMIT 1",
    "x8_importance": f"WITH {EMB}, {SHAP} SELECT feature, {r('importance')} AS importance FROM ({IMPORT.format('shap')})",
    "x9_class_importance": f"WITH {EMB}, {SHAP} SELECT feature, class, {r('avg(abs(shap))')} AS importance FROM shap WHERE feature IN (SELECT feature FROM ({IMPORT.format('shap')})) GROUP BY feature, class",
    "x10_beeswarm": f"""WITH {EMB}, {SHAP}, s0 AS (SELECT * FROM shap WHERE class = 0), top AS ({IMPORT.format('s0')})
SELECT id, feature, {r('value')} AS value, {r('shap')} AS shap FROM s0 WHERE feature IN (SELECT feature FROM top)
UNION ALL SELECT id, '(rest)', NULL::DOUBLE, {r('sum(shap)')} FROM s0 WHERE feature NOT IN (SELECT feature FROM top) GROUP BY id""",
}
