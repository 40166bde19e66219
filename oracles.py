"""SQL counterparts of the registered queries, in the dialect of the check tool."""

from __future__ import annotations

ANNOTATED = """ann AS (
  SELECT d.doc_id AS id, d.text AS text, d.lang AS lang, d.n_chars AS n_chars,
    CASE WHEN l.doc_id IS NOT NULL THEN 1e0 + 2e0*l.quality + 2e0*(1 - l.toxic) END AS V,
    CASE WHEN l.doc_id IS NOT NULL THEN 1e0 + 4e0*(d.n_chars/(CAST(d.n_chars AS DOUBLE) + 2000e0)) END AS A,
    CASE WHEN l.doc_id IS NOT NULL THEN 1e0 + 4e0*(d.doc_id % 97)/96e0 END AS D
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

GOLD = """gold AS (
  SELECT * FROM ann WHERE text IS NOT NULL AND V IS NOT NULL AND A IS NOT NULL AND D IS NOT NULL)"""

PREDICTIONS = """pred AS (
  SELECT id, text, lang,
    coalesce(V, 3e0) + ((id*31) % 11 - 5)*0.0731e0 AS V_pred,
    coalesce(A, 3e0) + ((id*17) % 13 - 6)*0.0517e0 AS A_pred,
    3e0 AS D_pred
  FROM ann)"""

ALIGNED = """al AS (
  SELECT p.id AS id, g.lang AS lang, p.V_pred, p.A_pred, p.D_pred, g.V, g.A, g.D
  FROM pred p JOIN ann g ON p.id IS NOT DISTINCT FROM g.id)"""

LONG = """u AS (
  SELECT lang, 'V' AS dim, V AS y, V_pred AS p FROM al
  UNION ALL SELECT lang, 'A', A, A_pred FROM al
  UNION ALL SELECT lang, 'D', D, D_pred FROM al)"""

LOSSES = """loss_log AS (
  SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY d) AS INT) AS epoch, loss
  FROM (SELECT event_type AS run, CAST(ts AS DATE) AS d, avg(value) AS loss
        FROM events GROUP BY event_type, CAST(ts AS DATE)) x)"""

TOKENS = """words AS (
  SELECT doc_id, idx, token FROM (
    SELECT doc_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS idx
    FROM (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f]+') AS parts FROM documents) s) t
  WHERE token <> ''),
vocabulary AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INT) AS token_id
  FROM (SELECT token, count(*) AS n FROM words GROUP BY token) c)"""


def _r(y: str = "y", p: str = "p") -> str:
    spread = f"(stddev_pop({y})*stddev_pop({p}))"
    return f"CASE WHEN {spread} = 0e0 THEN 0e0 ELSE coalesce(covar_pop({y}, {p})/nullif({spread}, 0e0), 0e0) END"


def _metrics(by: str, source: str = "u", digits: int = 6) -> str:
    """MAE and r over complete rows; counts of complete and incomplete rows."""
    return f"""SELECT {by},
      count(*) FILTER (WHERE y IS NOT NULL AND p IS NOT NULL) AS n,
      count(*) FILTER (WHERE y IS NULL OR p IS NULL) AS n_missing,
      round(avg(abs(y - p)), {digits}) AS mae,
      round({_r("CASE WHEN p IS NOT NULL THEN y END", "CASE WHEN y IS NOT NULL THEN p END")}, {digits}) AS pearson_r
    FROM {source} GROUP BY {by}"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (ANNOTATED, PREDICTIONS, ALIGNED, LONG)

STOPS = """p AS (
  SELECT run, epoch, loss,
    loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    CAST('inf' AS DOUBLE)) AS improved
  FROM loss_log {limit}),
s AS (
  SELECT run, epoch, loss, improved,
    epoch - coalesce(max(CASE WHEN improved THEN epoch END)
      OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS waited
  FROM p),
t AS (
  SELECT run, min(CASE WHEN waited >= {patience} THEN epoch END) AS stop, max(epoch) AS n FROM s GROUP BY run)"""


def _encoded(max_len: int, special: bool) -> str:
    room = max_len - 2 if special else max_len
    start, end = ("2 ", " 3") if special else ("", "")
    marks = 2 if special else 0
    return _with(
        TOKENS,
        f"""ranked AS (
  SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM words),
cut AS (
  SELECT r.doc_id, string_agg(CAST(v.token_id AS VARCHAR), ' ' ORDER BY r.pos) AS ids, count(*) AS n
  FROM ranked r JOIN vocabulary v ON r.token = v.token WHERE r.pos <= {room} GROUP BY r.doc_id),
enc AS (
  SELECT d.doc_id, '{start}' || coalesce(c.ids, '') || '{end}' AS ids, coalesce(c.n, 0) + {marks} AS n
  FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id)""",
    )


def _dot(divisor: int, intercept: str) -> str:
    products = f"sum(x*((idx % {divisor}) - 2)/10e0)"
    return f"round(({products} + {intercept})*5e0, 6)"


_VECTORS = """vec AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1,
    CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings)"""

_EXACT = (
    _with(_VECTORS)
    + """SELECT id, round(3e0 + e0*1.7071e0 - e1, 4) AS V_pred, round(2.5e0 + e2*0.9137e0, 4) AS A_pred,
      round(3.5e0 - e0*1.3193e0 + e2*0.4811e0, 4) AS D_pred FROM vec"""
)

_NAMES = "CASE dim WHEN 'V' THEN 'Valence' WHEN 'A' THEN 'Arousal' ELSE 'Dominance' END"

def _epochs(dim: str, run: str, epochs: int, rate: str) -> str:
    """Full-batch epochs of Adam on one standardised feature, each epoch a table: ``(run, epoch, train_loss, val_loss)``."""
    clip = "greatest(-1e0, least(1e0, b + w*z - y))"
    loss = _smooth("b + w*z - y")
    steps = [
        f"""x AS (SELECT g.id AS id, split, length(text)/1000e0 AS x, {dim}/5e0 AS y FROM gold g JOIN sp ON g.id = sp.id)""",
        "st AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM x WHERE split = 'train')",
        "tr AS (SELECT (x - m)/s AS z, y FROM x, st WHERE split = 'train')",
        """va AS (SELECT (x - m)/s AS z, y, floor((row_number() OVER (ORDER BY id) - 1)/16e0) AS batch
  FROM x, st WHERE split = 'val')""",
        "p0 AS (SELECT avg(y) AS b, 0e0 AS w, 0e0 AS mb, 0e0 AS mw, 0e0 AS vb, 0e0 AS vw FROM tr)",
    ]
    for k in range(1, epochs + 1):
        new = {c: f"(0.9e0*m{c} + 0.1e0*g{c})" for c in "bw"} | {f"v{c}": f"(0.999e0*v{c} + 0.001e0*g{c}*g{c})" for c in "bw"}

        def moved(c: str, k: int = k, new: dict = new) -> str:
            first, second = f"{new[c]}/(1 - power(0.9e0, {k}))", f"{new['v' + c]}/(1 - power(0.999e0, {k}))"
            return f"{c} - {rate}*({first})/(sqrt({second}) + 1e-8) AS {c}"

        steps += [
            f"a{k} AS (SELECT avg({clip}) AS gb, avg({clip}*z) AS gw, avg({loss}) AS train_loss FROM tr, p{k - 1})",
            f"g{k} AS (SELECT CASE WHEN abs(gb) < 1e-9*greatest(abs(gb), abs(gw)) THEN 0e0 ELSE gb END AS gb, gw FROM a{k})",
            f"""p{k} AS (SELECT {moved("b")}, {moved("w")}, {new["b"]} AS mb, {new["w"]} AS mw, {new["vb"]} AS vb, {new["vw"]} AS vw
  FROM p{k - 1}, g{k})""",
            f"l{k} AS (SELECT avg(one) AS val_loss FROM (SELECT batch, avg({loss}) AS one FROM va, p{k} GROUP BY batch) o)",
        ]
    rows = [
        f"SELECT '{run}' AS run, CAST({k} AS INT) AS epoch, round(train_loss, 8) AS train_loss, round(val_loss, 8) AS val_loss FROM a{k}, l{k}"
        for k in range(1, epochs + 1)
    ]
    return _with(ANNOTATED, GOLD, _split("gold", _CEIL), *steps) + "\nUNION ALL ".join(rows)


def _minibatches(dim: str, epochs: int, workers: int, rate: str, batch: int = 16, scores: bool = False) -> str:
    """Steps of Adam on one standardised feature for every ``batch`` rows of a shard, and averages over shards after each epoch."""
    loss = _smooth("b + w*z - y")
    error = "greatest(-1e0, least(1e0, b + w*p.z - p.y))"
    new = {c: f"(0.9e0*m{c} + 0.1e0*g{c})" for c in "bw"} | {f"v{c}": f"(0.999e0*v{c} + 0.001e0*g{c}*g{c})" for c in "bw"}

    def moved(c: str) -> str:
        return f"{c} - {rate}*({new[c]}/(1 - power(0.9e0, t + 1)))/(sqrt({new['v' + c]}/(1 - power(0.999e0, t + 1))) + 1e-8) AS {c}"

    steps = [
        f"""x AS (SELECT g.id AS id, split, length(text)/1000e0 AS x, {dim}/5e0 AS y FROM gold g JOIN sp ON g.id = sp.id)""",
        "st AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM x WHERE split = 'train')",
        f"""tr AS (SELECT id, ('0x' || substr(md5(concat('42-', id)), 1, 8))::BIGINT % {workers} AS shard, (x - m)/s AS z, y
  FROM x, st WHERE split = 'train')""",
        """va AS (SELECT (x - m)/s AS z, y, floor((row_number() OVER (ORDER BY id) - 1)/16e0) AS batch
  FROM x, st WHERE split = 'val')""",
        "n AS (SELECT shard, count(*) AS n FROM tr GROUP BY shard)",
        "p0 AS (SELECT avg(y) AS b, 0e0 AS w, 0e0 AS mb, 0e0 AS mw, 0e0 AS vb, 0e0 AS vw, 0 AS t FROM tr)",
    ]
    for k in range(1, epochs + 1):
        steps += [
            f"""o{k} AS (SELECT shard, floor((row_number() OVER (PARTITION BY shard ORDER BY md5(concat('42-{k}-', id)), id) - 1)/{batch}e0) + 1 AS i, z, y FROM tr)""",
            f"b{k} AS MATERIALIZED (SELECT shard, i, list({{'z': z, 'y': y}}) AS rows FROM o{k} GROUP BY shard, i)",
            f"""r{k} AS (SELECT shard, 0e0 AS i, p{k - 1}.*, 0e0 AS loss FROM n, p{k - 1}
  UNION ALL SELECT shard, i + 1, {moved("b")}, {moved("w")}, {new["b"]}, {new["w"]}, {new["vb"]}, {new["vw"]}, t + 1, one
  FROM (SELECT r{k}.*, list_avg(list_transform(rows, lambda p: {error})) AS gb, list_avg(list_transform(rows, lambda p: p.z*({error}))) AS gw,
          list_avg(list_transform(rows, lambda p: {_smooth("b + w*p.z - p.y")})) AS one
        FROM r{k} JOIN b{k} ON r{k}.shard = b{k}.shard AND r{k}.i + 1 = b{k}.i) s)""",
            f"e{k} AS (SELECT n, r{k}.* FROM r{k} JOIN n USING (shard) JOIN (SELECT shard, max(i) AS i FROM b{k} GROUP BY shard) USING (shard, i))",
            f"p{k} AS (SELECT {', '.join(f'sum(n*{c})/sum(n) AS {c}' for c in ('b', 'w', 'mb', 'mw', 'vb', 'vw'))}, max(t) AS t FROM e{k})",
            f"t{k} AS (SELECT avg(loss) AS train_loss FROM r{k} WHERE i > 0)",
            f"l{k} AS (SELECT avg(one) AS val_loss FROM (SELECT batch, avg({loss}) AS one FROM va, p{k} GROUP BY batch) o)",
        ]
    if scores:
        every = " UNION ALL ".join(f"SELECT {k} AS k, val_loss, b, w FROM l{k}, p{k}" for k in range(1, epochs + 1))
        rows = [
            f"""SELECT id, round(5e0*(b + w*(length(text)/1000e0 - m)/s), 6) AS {dim}_pred
  FROM ann, st, (SELECT b, w FROM ({every}) e ORDER BY val_loss, k LIMIT 1) best"""
        ]
    else:
        rows = [
            f"SELECT 'joint' AS run, CAST({k} AS INT) AS epoch, round(train_loss, 8) AS train_loss, round(val_loss, 8) AS val_loss FROM t{k}, l{k}"
            for k in range(1, epochs + 1)
        ]
    return _with(ANNOTATED, GOLD, _split("gold", _CEIL), *steps).replace("WITH", "WITH RECURSIVE", 1) + "\nUNION ALL ".join(rows)


_REPORTED = _with(*BASE, f"m AS ({_metrics('lang, dim', digits=12)})", f"""rep AS (
  SELECT lang AS run, dim, CASE dim WHEN 'V' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS idx,
    printf('%.4f', mae) AS mae, printf('%.4f', pearson_r) AS r FROM m)""")

_COMPARED = _with(
    *BASE,
    """u2 AS (SELECT lang, 'V' AS dim, V AS y, 3e0 AS p FROM al UNION ALL SELECT lang, 'A', A, V_pred FROM al)""",
    f"ma AS ({_metrics('lang, dim')})",
    f"mb AS ({_metrics('lang, dim', 'u2')})",
    f"""cmp AS (
  SELECT ma.lang AS lang, ma.mae AS mae_a, ma.pearson_r AS pearson_r_a, mb.mae AS mae_b, mb.pearson_r AS pearson_r_b,
    CASE ma.dim WHEN 'V' THEN 'Valence' WHEN 'A' THEN 'Arousal' ELSE 'Dominance' END AS dimension
  FROM ma LEFT JOIN mb ON ma.lang IS NOT DISTINCT FROM mb.lang AND ma.dim = mb.dim)""",
)


def _split(source: str, n_train: str) -> str:
    return f"""r AS (
  SELECT id, row_number() OVER (ORDER BY md5(concat('42-', CAST(id AS VARCHAR))), id) AS pos, count(*) OVER () AS n
  FROM {source}),
sp AS (SELECT id, CASE WHEN pos <= {n_train} THEN 'train' ELSE 'val' END AS split FROM r)"""


_ROUND, _CEIL = "round_even(0.8e0*n, 0)", "n - ceil(0.2e0*n)"

_LOSS_ROWS = (ANNOTATED, GOLD, PREDICTIONS, """lr AS (
  SELECT g.id AS id, g.V, g.A, g.D, p.V_pred, p.A_pred, p.D_pred,
    CAST(floor((row_number() OVER (ORDER BY g.id) - 1)/16e0) AS BIGINT) AS batch_id
  FROM pred p JOIN gold g ON p.id = g.id)""")


def _smooth(error: str) -> str:
    return f"CASE WHEN abs({error}) < 1 THEN 0.5e0*({error})*({error}) ELSE abs({error}) - 0.5e0 END"


def _profile(name: str, columns: str, has_text: bool, target: str | None, numeric: bool) -> str:
    n = columns.count(",") + 1
    return f"""SELECT '{name}' AS name, '{columns}' AS columns, {n} AS n_columns, count(*) AS n_rows,
      {has_text} AS has_text, {n == 2} AS two_columns, '{target}' AS target, {numeric} AS target_numeric FROM {name}"""


_PARSED = (
    _REPORTED
    + f"""SELECT run, CAST(idx AS INT) AS section_no, {_NAMES} AS dimension, CAST(mae AS DOUBLE) AS mae,
      CAST(r AS DOUBLE) AS pearson_r FROM rep"""
)

_MD5_ORDER = "md5(concat('42-3-', CAST(doc_id AS VARCHAR)))"

_COUNTED = """cnt AS (
  SELECT d.doc_id AS id, ln(1 + count(*) FILTER (WHERE token = 'the')) AS t1, ln(1 + count(*) FILTER (WHERE token = 'of')) AS t2,
    ln(1 + count(*) FILTER (WHERE token = 'de')) AS t3 FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id)"""


def _ridge_of_three(dim: str, reg: str) -> tuple[str, str]:
    """Tables with the weights of ``dim``/5 on x1, x2 and x3 of table ``tr``, by determinants; their names."""

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a}*({e}*{i} - {f}*{h}) - {b}*({d}*{i} - {f}*{g}) + {c}*({d}*{h} - {e}*{g}))"

    a = [[f"c{min(i, j)}{max(i, j)}" for j in (1, 2, 3)] for i in (1, 2, 3)]
    solved = []
    for k in range(3):
        replaced = [[f"r{i + 1}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
        solved.append(f"{det(replaced)}/{det(a)} AS w{k + 1}")
    cells = [
        f"covar_pop(x{i}, x{j})" + (f" + {reg}/stddev_pop({dim}/5e0)" if i == j else "") + f" AS c{i}{j}" for i in (1, 2, 3) for j in range(i, 4)
    ]
    goal = [f"covar_pop(x{i}, {dim}/5e0) AS r{i}, avg(x{i}) AS m{i}" for i in (1, 2, 3)]
    tables = [
        f"q{dim} AS (SELECT {', '.join(cells + goal)}, avg({dim}/5e0) AS my FROM tr)",
        f"w{dim} AS (SELECT *, my - w1*m1 - w2*m2 - w3*m3 AS b FROM (SELECT *, {', '.join(solved)} FROM q{dim}) s)",
    ]
    return ",\n".join(tables), f"w{dim}"


_IDF_FIT = _with(
    ANNOTATED,
    GOLD,
    TOKENS,
    _split("gold", _CEIL),
    _COUNTED,
    """tc AS (SELECT cnt.*, V, A, D FROM cnt JOIN gold g ON cnt.id = g.id JOIN sp ON g.id = sp.id WHERE split = 'train')""",
    "idf AS (SELECT " + ", ".join(f"ln((count(*) + 1)/(count(*) FILTER (WHERE t{i} > 0) + 1)) AS i{i}" for i in (1, 2, 3)) + " FROM tc)",
    "tr AS (SELECT t1*i1 AS x1, t2*i2 AS x2, t3*i3 AS x3, V, A, D FROM tc, idf)",
    *[_ridge_of_three(d, "0.02e0")[0] for d in "VAD"],
) + (
    "SELECT cnt.id AS id, "
    + ", ".join(f"round(5e0*(w{d}.b + w{d}.w1*t1*i1 + w{d}.w2*t2*i2 + w{d}.w3*t3*i3), 6) AS {d}_pred" for d in "VAD")
    + " FROM cnt, idf, wV, wA, wD"
)

_SCALED_TERMS = _with(
    TOKENS,
    _COUNTED,
    "st AS (SELECT " + ", ".join(f"avg(t{i}) AS m{i}, stddev_samp(t{i}) AS s{i}" for i in (1, 2, 3)) + " FROM cnt)",
    "z AS (SELECT id, " + ", ".join(f"(t{i} - m{i})/s{i} AS z{i}" for i in (1, 2, 3)) + " FROM cnt, st)",
) + "SELECT id, round(z1 + z2 + z3, 6) AS total, round(z1*z1 + z2*z2 + z3*z3, 6) AS square, round(greatest(z1, z2, z3, 0e0), 6) AS top FROM z"

_ONE_HOT = """WITH l AS (SELECT doc_id, doc_id // 10 AS g, n_chars/(n_chars + 2000e0) AS v, (n_chars % 7)/5e0 AS a, (doc_id % 97)/100e0 AS d FROM documents),
n AS (SELECT count(*) AS n, 0.0001e0/stddev_pop(v) AS lv, 0.0001e0/stddev_pop(a) AS la, 0.0001e0/stddev_pop(d) AS ld FROM l),
s AS (SELECT g, count(*)/max(n) AS c, sum(v)/max(n) AS v, sum(a)/max(n) AS a, sum(d)/max(n) AS d FROM l, n GROUP BY g),
b AS (SELECT sum(v/(c + lv))/sum(c/(c + lv)) AS bv, sum(a/(c + la))/sum(c/(c + la)) AS ba, sum(d/(c + ld))/sum(c/(c + ld)) AS bd FROM s, n)
SELECT doc_id, round(5e0*(bv + (s.v - bv*c)/(c + lv)), 6) AS V_pred,
  round(5e0*(ba + (s.a - ba*c)/(c + la)), 6) AS A_pred, round(5e0*(bd + (s.d - bd*c)/(c + ld)), 6) AS D_pred
FROM l JOIN s USING (g), n, b"""

ORACLES = {
    "evaluate_by_dim": _with(*BASE) + _metrics("dim"),
    "evaluate_by_run": _with(*BASE) + _metrics("lang, dim"),
    "evaluate_text_pairs": _with(
        ANNOTATED,
        PREDICTIONS,
        """j AS (SELECT p.V_pred, p.A_pred, p.D_pred, g.V, g.A, g.D
            FROM pred p JOIN ann g ON p.text IS NOT DISTINCT FROM g.text),
u AS (SELECT 'V' AS dim, V AS y, V_pred AS p FROM j UNION ALL SELECT 'A', A, A_pred FROM j
      UNION ALL SELECT 'D', D, D_pred FROM j)""",
    )
    + _metrics("dim"),
    "evaluate_auto_unscale": _with(*BASE)
    + """, top AS (SELECT dim AS d, max(p/7e0) <= 1e0 + 1e-8 AS scaled FROM u GROUP BY dim),
v AS (SELECT dim, y, CASE WHEN scaled THEN p/7e0*5e0 ELSE p/7e0 END AS p FROM u JOIN top ON dim = d)
"""
    + _metrics("dim", "v"),
    "auto_unscale": _with(ANNOTATED, PREDICTIONS, """top AS (
  SELECT max(V_pred/7e0) <= 1e0 + 1e-8 AS v, max(A_pred) <= 1e0 + 1e-8 AS a, max(D_pred) <= 1e0 + 1e-8 AS d FROM pred)""")
    + """SELECT id, round(CASE WHEN v THEN V_pred/7e0*5e0 ELSE V_pred/7e0 END, 6) AS V_pred,
      round(CASE WHEN a THEN A_pred*5e0 ELSE A_pred END, 6) AS A_pred,
      round(CASE WHEN d THEN D_pred*5e0 ELSE D_pred END, 6) AS D_pred FROM pred, top""",
    "pearson_plain": """SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity)), 4) AS mae,
      round(corr(l_extendedprice, l_quantity), 6) AS pearson_r FROM lineitem GROUP BY l_returnflag""",
    "pearson_constant": f"""SELECT l_returnflag, 0e0 AS r_flat, CAST(NULL AS DOUBLE) AS r_null,
      round({_r("l_tax", "l_discount")}, 6) AS r_both FROM lineitem GROUP BY l_returnflag""",
    "drop_missing_any": _with(ANNOTATED, GOLD)
    + "SELECT id, round(V, 6) AS V, round(A, 6) AS A, round(D, 6) AS D FROM gold",
    "drop_missing_all": _with(ANNOTATED)
    + """SELECT id, V, CAST(e.label AS DOUBLE) AS label FROM ann LEFT JOIN embeddings e ON id = e.vec_id
      WHERE V IS NOT NULL OR e.label IS NOT NULL""",
    "select_target": _with(ANNOTATED)
    + "SELECT id, md5(text) AS text_md5, round(A, 6) AS A FROM ann WHERE text IS NOT NULL AND A IS NOT NULL",
    "scale_roundtrip": _with(ANNOTATED, GOLD)
    + "SELECT id, "
    + ", ".join(f"round({d}/5e0, 6) AS {d}_01, round({d}/5e0*5e0, 6) AS {d}_01_back" for d in "VAD")
    + " FROM gold",
    "lenient_numbers": """SELECT p_partkey, round(CASE WHEN p_size > 40 THEN try_cast(p_name AS DOUBLE)
      ELSE try_cast(trim(' ' || CAST(p_retailprice AS VARCHAR)) AS DOUBLE) END, 4) AS number FROM part""",
    "head_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 3",
    "table_profile": "\nUNION ALL ".join(
        [
            _profile("documents", "doc_id,text,lang,source,n_chars", True, "doc_id", True),
            _profile("labels", "doc_id,quality,toxic", False, "doc_id", True),
            _profile("pages", "page_id,url,html", False, "page_id", True),
            _profile("conversations", "conv_id,turn,role,text", True, "conv_id", True),
            _profile("benchmark", "item_id,text", True, "item_id", True),
        ]
    ),
    "split_round": _with(ANNOTATED, GOLD, _split("gold", _ROUND)) + "SELECT id, split FROM sp",
    "split_ceil": _with(ANNOTATED, GOLD, _split("gold", _CEIL)) + "SELECT id, split FROM sp",
    "split_sizes": """WITH c AS (SELECT count(*) AS n FROM documents),
s AS (SELECT n, CAST(round_even(0.8e0*n, 0) AS BIGINT) AS a, CAST(n - ceil(0.2e0*n) AS BIGINT) AS b FROM c)
SELECT 'train' AS split, a AS n, 'round' AS rule FROM s UNION ALL SELECT 'val', n - a, 'round' FROM s
UNION ALL SELECT 'train', b, 'ceil' FROM s UNION ALL SELECT 'val', n - b, 'ceil' FROM s""",
    "split_complement": _with(ANNOTATED, GOLD) + "SELECT id, lang FROM ann WHERE id NOT IN (SELECT id FROM gold)",
    "targets_long": _with(
        ANNOTATED,
        GOLD,
        _split("gold", _ROUND),
        """rows3 AS (
  SELECT g.id AS id, md5(text) AS text_md5, split, V, A, D FROM gold g JOIN sp ON g.id = sp.id
  UNION ALL SELECT -1 - item_id, md5(text), 'test', 1e0, 3e0, 5e0 FROM benchmark WHERE text IS NOT NULL)""",
    )
    + """SELECT id, text_md5, split, 'V' AS dim, round(V, 6) AS value FROM rows3
UNION ALL SELECT id, text_md5, split, 'A', round(A, 6) FROM rows3
UNION ALL SELECT id, text_md5, split, 'D', round(D, 6) FROM rows3""",
    "align_id": _with(ANNOTATED, GOLD, PREDICTIONS)
    + "SELECT p.id AS id, md5(g.text) AS text_md5, "
    + ", ".join(f"round({d}_pred, 6) AS {d}_pred, round({d}, 6) AS {d}" for d in "VAD")
    + " FROM pred p JOIN gold g ON p.id IS NOT DISTINCT FROM g.id",
    "align_text": _with(ANNOTATED, GOLD, PREDICTIONS, """pr AS (
  SELECT md5(g.text) AS text_md5, round(V_pred, 6) AS V_pred, round(A_pred, 6) AS A_pred, round(D_pred, 6) AS D_pred,
    round(V, 6) AS V, round(A, 6) AS A, round(D, 6) AS D
  FROM pred p JOIN gold g ON p.text IS NOT DISTINCT FROM g.text)""")
    + """SELECT text_md5, V_pred, A_pred, D_pred, V, A, D, count(*) AS n_rows FROM pr
      GROUP BY text_md5, V_pred, A_pred, D_pred, V, A, D""",
    "align_position": _with(ANNOTATED, GOLD, PREDICTIONS, """l AS (
  SELECT p.id AS p, V_pred, row_number() OVER (ORDER BY p.id) AS pos FROM pred p JOIN gold g ON p.id = g.id),
r AS (SELECT id AS g, V, row_number() OVER (ORDER BY id DESC) AS pos FROM gold)""")
    + "SELECT l.pos AS pos, p, g, round(V, 6) AS V, round(V_pred, 6) AS V_pred FROM l JOIN r ON l.pos = r.pos",
    "align_prefix": _with(ANNOTATED, GOLD, """l AS (
  SELECT id AS p, round(A + 0.25e0, 6) AS A_pred, row_number() OVER (ORDER BY id) AS pos FROM gold),
r AS (SELECT doc_id AS g, n_chars, row_number() OVER (ORDER BY doc_id) AS pos FROM documents)""")
    + "SELECT l.pos AS pos, p, A_pred, g, n_chars FROM l JOIN r ON l.pos = r.pos",
    "align_coverage": _with(ANNOTATED, GOLD, PREDICTIONS)
    + "\nUNION ALL ".join(
        f"""SELECT (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gold) AS n_gold,
      (SELECT count(*) FROM pred p JOIN gold g ON p.{k} = g.{k}) AS n_aligned,
      (SELECT count(*) FROM pred WHERE {k} NOT IN (SELECT {k} FROM gold)) AS lost_pred,
      (SELECT count(*) FROM gold WHERE {k} NOT IN (SELECT {k} FROM pred)) AS lost_gold,
      (SELECT count(*) FROM (SELECT p.{k} FROM pred p JOIN gold g ON p.{k} = g.{k} GROUP BY p.{k} HAVING count(*) > 1) x)
        AS repeated_keys, '{k}' AS key"""
        for k in ("id", "text")
    ),
    "smooth_l1_batches": _with(*_LOSS_ROWS)
    + f"SELECT batch_id, count(*) AS n, round(avg({_smooth('V_pred - V')}), 6) AS batch_loss FROM lr GROUP BY batch_id",
    "epoch_loss": _with(
        *_LOSS_ROWS,
        "b AS (SELECT batch_id, avg(("
        + " + ".join(_smooth(f"{d}_pred/5e0 - {d}/5e0") for d in "VAD")
        + ")/3e0) AS batch_loss FROM lr GROUP BY batch_id)",
    )
    + "SELECT count(*) AS n_batches, round(avg(batch_loss), 8) AS loss FROM b",
    "smooth_l1_lines": f"""SELECT l_returnflag, l_linenumber, count(*) AS n,
      round(avg({_smooth("l_tax*20e0 - l_discount*20e0")}), 6) AS batch_loss
      FROM lineitem GROUP BY l_returnflag, l_linenumber""",
    "shuffle_batches": f"""WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {_MD5_ORDER}, doc_id) AS pos
      FROM documents) SELECT id, pos, CAST(floor((pos - 1)/16e0) AS BIGINT) AS batch_id FROM o""",
    "early_stopping": _with(LOSSES, STOPS.format(limit="", patience=3), """k AS (
  SELECT t.run AS run, coalesce(t.stop, t.n) AS epochs_run, t.stop IS NOT NULL AS stopped_early,
      max(CASE WHEN s.improved AND s.epoch <= coalesce(t.stop, t.n) THEN s.epoch END) AS best_epoch
  FROM t JOIN s ON t.run = s.run GROUP BY t.run, t.stop, t.n)""")
    + """SELECT k.*, round(loss, 6) AS best_loss FROM k LEFT JOIN loss_log l ON k.run = l.run AND k.best_epoch = l.epoch""",
    "best_epoch": _with(
        LOSSES,
        STOPS.format(limit="WHERE epoch <= 20", patience=5),
        """k AS (SELECT t.run AS run,
      max(CASE WHEN s.improved AND s.epoch <= coalesce(t.stop, t.n) THEN s.epoch END) AS best_epoch
      FROM t JOIN s ON t.run = s.run GROUP BY t.run)""",
    )
    + """SELECT k.run AS run, best_epoch, round(loss, 6) AS best_loss
      FROM k JOIN loss_log l ON k.run = l.run AND k.best_epoch = l.epoch""",
    "vocab": _with(TOKENS) + "SELECT token, token_id, n FROM vocabulary",
    "encode_sequences": _encoded(64, True)
    + "SELECT doc_id, ids || repeat(' 0', CAST(64 - n AS INT)) AS input_ids FROM enc",
    "encode_sequences_joined": _encoded(128, False)
    + "SELECT doc_id, trim(ids || repeat(' 0', CAST(128 - n AS INT))) AS input_ids FROM enc",
    "encode_unknown": """WITH rows AS (
  SELECT doc_id, CASE WHEN doc_id % 13 <> 5 THEN lang END AS lang, CASE WHEN doc_id % 13 <> 7 THEN text END AS text, lang AS own, text AS whole FROM documents),
words AS (
  SELECT doc_id, own, idx, token FROM (SELECT doc_id, own, unnest(parts) AS token, generate_subscripts(parts, 1) AS idx
    FROM (SELECT doc_id, own, string_split_regex(whole, '[ \\t\\n\\r\\f]+') AS parts FROM rows) s) t WHERE token <> ''),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
  FROM (SELECT token, count(*) AS n FROM words WHERE own <> 'en' GROUP BY token) c),
ranked AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM words),
cut AS (SELECT r.doc_id, string_agg(CAST(coalesce(v.token_id, 1) AS VARCHAR), ' ' ORDER BY r.pos) AS ids, count(*) AS n
  FROM ranked r LEFT JOIN vocabulary v ON r.token = v.token WHERE r.pos <= 30 GROUP BY r.doc_id),
enc AS (SELECT lang, CASE WHEN text IS NOT NULL THEN '2 ' || coalesce(c.ids || ' ', '') || '3' || repeat(' 0', CAST(30 - coalesce(c.n, 0) AS INT)) END AS input_ids
  FROM rows LEFT JOIN cut c ON rows.doc_id = c.doc_id)
SELECT lang, input_ids, count(*) AS n FROM enc GROUP BY lang, input_ids""",
    "attention_mask": _encoded(64, True)
    + "SELECT doc_id, trim(repeat('1 ', CAST(n AS INT)) || repeat('0 ', CAST(64 - n AS INT))) AS attention_mask FROM enc",
    "score_fixed_weights": """WITH c AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings)
"""
    + f"""SELECT vec_id, {_dot(5, "0.6e0")} AS V_pred, {_dot(6, "0.5e0")} AS A_pred, {_dot(7, "0.4e0")} AS D_pred
      FROM c GROUP BY vec_id""",
    "gram_sums": """WITH c AS (
  SELECT vec_id, i, z FROM (
    SELECT vec_id, 0 AS i, 1e0 AS z FROM embeddings
    UNION ALL SELECT vec_id, generate_subscripts(embedding, 1), CAST(unnest(embedding) AS DOUBLE) FROM embeddings
    UNION ALL SELECT vec_id, 65, CAST(label AS DOUBLE) FROM embeddings) s)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.z*b.z), 6) AS value
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
    "fit_single_scalar": _with(ANNOTATED, GOLD, """x AS (
  SELECT 'V' AS dim, V/5e0 AS y, length(text)/1000e0 AS x FROM gold
  UNION ALL SELECT 'A', A/5e0, length(text)/1000e0 FROM gold
  UNION ALL SELECT 'D', D/5e0, length(text)/1000e0 FROM gold)""")
    + "SELECT dim, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM x GROUP BY dim",
    "single_chain": _with(ANNOTATED, GOLD, _split("gold", _ROUND), """z AS (
  SELECT g.id, split, length(text)/1000e0 AS x, V, A FROM gold g JOIN sp ON g.id = sp.id),
w AS (SELECT regr_slope(V/5e0, x) AS sv, regr_intercept(V/5e0, x) AS iv, regr_slope(A/5e0, x) AS sa, regr_intercept(A/5e0, x) AS ia
  FROM z WHERE split = 'train'),
u AS (SELECT 'V' AS dim, V AS y, CASE WHEN id % 13 <> 7 THEN 5e0*(sv*x + iv) END AS p FROM z, w WHERE split = 'val'
  UNION ALL SELECT 'A', A, CASE WHEN id % 13 <> 7 THEN 5e0*(sa*x + ia) END FROM z, w WHERE split = 'val')""")
    + _metrics("dim"),
    "epochs_joint": _epochs("V", "joint", 3, "0.01e0"),
    "epochs_separate": f"SELECT * FROM ({_epochs('V', 'V', 3, '0.01e0')}) v UNION ALL SELECT * FROM ({_epochs('A', 'A', 3, '0.01e0')}) a",
    "epochs_minibatch": _minibatches("V", 3, 3, "0.003e0"),
    "minibatch_scores": _minibatches("V", 3, 3, "0.003e0", scores=True),
    "fit_idf_terms": _IDF_FIT,
    "scaled_terms": _SCALED_TERMS,
    "fit_wide_groups": _ONE_HOT,
    "fit_multi_exact": _EXACT,
    "stored_vectors": _EXACT,
    "fit_single_exact": _EXACT,
    "align_spread": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 7 THEN lang END AS id, length(text)/1000e0 AS x FROM documents),
g AS (SELECT id, count(*) AS n, avg(x) AS a FROM d GROUP BY id)
SELECT d.id AS id, doc_id, round(x, 6) AS A_pred, n, round(a, 6) AS A FROM d JOIN g ON d.id IS NOT DISTINCT FROM g.id""",
    "align_bucketed": _with(ANNOTATED, PREDICTIONS)
    + "SELECT p.id AS id, "
    + ", ".join(f"round(p.{d}_pred, 6) AS {d}_pred, round(a.{d}, 6) AS {d}" for d in "VAD")
    + " FROM pred p JOIN ann a ON p.id = a.id",
    "split_files_counted": _with(ANNOTATED, GOLD, _split("gold", _ROUND), """l AS (
  SELECT 'V' AS dim, id, V AS value FROM gold UNION ALL SELECT 'A', id, A FROM gold UNION ALL SELECT 'D', id, D FROM gold)""")
    + "SELECT l.id AS id, dim, split, round(value, 6) AS value, count(*) OVER (PARTITION BY dim, split) AS n FROM l JOIN sp ON l.id = sp.id",
    "aligned_files_counted": _with(ANNOTATED, GOLD, PREDICTIONS, """j AS (
  SELECT p.id AS id, V_pred, A_pred, D_pred, g.V AS V, g.A AS A, g.D AS D FROM pred p JOIN gold g ON p.id = g.id WHERE p.id % 7 <> 0)""")
    + "SELECT id, "
    + ", ".join(f"round({d}_pred, 6) AS {d}_pred, round({d}, 6) AS {d}" for d in "VAD")
    + """, count(*) OVER () AS n_aligned, (SELECT count(*) FROM pred WHERE id % 7 <> 0) - count(*) OVER () AS lost_pred,
  (SELECT count(*) FROM gold) - count(*) OVER () AS lost_gold FROM j""",
    "appended_epochs": _with(LOSSES)
    + """SELECT run, epoch, round(CASE WHEN run = 'click' AND epoch IN (3, 20, 21) THEN -loss ELSE loss END, 6) AS loss
      FROM loss_log WHERE epoch <= 20 OR run <> 'view'""",
    "refused_tables": _with(ANNOTATED)
    + """SELECT 'all' AS part, id, 2e0 AS V_pred, FALSE AS refused FROM ann UNION ALL SELECT 'labelled', id, 2e0, FALSE FROM ann WHERE V IS NOT NULL
UNION ALL SELECT 'unknown language', -1, NULL, TRUE""",
    "position_ties": "SELECT row_number() OVER (ORDER BY lang) AS pos, lang FROM documents",
    "stored_model": _EXACT,
    "stored_pipeline": _EXACT,
    "stored_encoder": _with(ANNOTATED, GOLD, """w AS (
  SELECT regr_slope(V, length(text)/1000e0) AS sv, regr_intercept(V, length(text)/1000e0) AS iv,
    regr_slope(A, length(text)/1000e0) AS sa, regr_intercept(A, length(text)/1000e0) AS ia FROM gold)""")
    + """SELECT id, CASE WHEN id % 13 <> 7 THEN round(iv + sv*length(text)/1000e0, 6) END AS V_pred,
      CASE WHEN id % 13 <> 7 THEN round(ia + sa*length(text)/1000e0, 6) END AS A_pred FROM ann, w""",
    "csv_round_trip": _with(ANNOTATED)
    + "SELECT id, md5(text) AS text_md5, round(V, 6) AS V, round(A, 6) AS A, round(D, 6) AS D FROM ann",
    "folder_profile": _with(ANNOTATED, GOLD)
    + """SELECT 'text,target' AS columns, 2 AS n_columns, TRUE AS has_text, TRUE AS two_columns, 'target' AS target,
      TRUE AS target_numeric, count(*) AS n_rows, CAST(0 AS BIGINT) AS errors FROM gold
UNION ALL SELECT 'text,target,A', 3, TRUE, FALSE, 'target', FALSE, count(*), 0 FROM gold
UNION ALL SELECT 'text,' || string_agg('f' || i, ',' ORDER BY i), 81, TRUE, FALSE, 'f0', TRUE, (SELECT count(*) FROM gold), 0
  FROM range(80) r(i)""",
    "csv_folder": _with(ANNOTATED, GOLD)
    + """SELECT id, md5(text) AS text_md5, CASE WHEN id % 2 = 1 THEN lang END AS lang, round(V, 6) AS V, round(A, 6) AS A,
      round(D, 6) AS D FROM gold""",
    "prepare_without_id": _with(ANNOTATED, GOLD)
    + """SELECT count(*) AS n, CAST(count(*) - ceil(0.2e0*count(*)) AS BIGINT) AS n_train, CAST(1 AS BIGINT) AS first_id,
      count(*) AS last_id, count(*) AS ids, round(sum(V), 6) AS V, round(sum(A), 6) AS A, round(sum(D), 6) AS D FROM gold""",
    "texts_round_trip": "SELECT doc_id AS id, CASE WHEN doc_id % 13 <> 7 THEN md5(text) END AS text_md5 FROM documents",
    "split_files": _with(ANNOTATED, GOLD, _split("gold", _ROUND), """rows3 AS (
  SELECT 'V' AS dim, split, V AS v FROM gold JOIN sp ON gold.id = sp.id
  UNION ALL SELECT 'A', split, A FROM gold JOIN sp ON gold.id = sp.id
  UNION ALL SELECT 'D', split, D FROM gold JOIN sp ON gold.id = sp.id)""")
    + "SELECT dim, split, count(*) AS n, round(sum(v), 4) AS total FROM rows3 GROUP BY dim, split",
    "prediction_files": _with(ANNOTATED, PREDICTIONS)
    + """SELECT id, round(V_pred, 6) AS V_pred, round(A_pred, 6) AS A_pred, round(D_pred, 6) AS D_pred,
      CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS eval_set FROM pred""",
    "appended_losses": _with(LOSSES) + "SELECT run, epoch, round(loss, 6) AS loss FROM loss_log",
    "evaluate_text_id": _with(*BASE) + _metrics("dim"),
    "loss_log_files": _with(LOSSES)
    + """SELECT run, CAST(epoch AS INT) AS epoch, round(CAST(printf('%.4f', loss*0.37731e0) AS DOUBLE), 4) AS loss FROM loss_log""",
    "report_render": _REPORTED
    + """SELECT run, 'Evaluation - ' || run || chr(10) || repeat('=', length('Evaluation - ' || run)) || chr(10) || chr(10)
      || string_agg(dim || ':' || chr(10) || '  MAE = ' || mae || chr(10) || '  Pearson’s r = ' || r || chr(10) || chr(10),
                    '' ORDER BY idx) AS value FROM rep GROUP BY run""",
    "report_parse": _PARSED,
    "report_files": _PARSED,
    "report_missing": _REPORTED
    + """SELECT run, dim, CAST(mae AS DOUBLE) AS mae, dim = 'D' AS missing, CASE WHEN dim <> 'D' THEN CAST(r AS DOUBLE) END AS pearson_r
      FROM rep""",
    "section_carry": _REPORTED
    + """SELECT run, CAST(3 + 4*(idx - 1) + k AS INT) AS line_no, dim, CAST(idx AS INT) AS section_no
      FROM rep, (VALUES (0), (1), (2), (3)) x(k)
UNION ALL SELECT DISTINCT run, CAST(k AS INT), CAST(NULL AS VARCHAR), CAST(0 AS INT) FROM rep, (VALUES (0), (1), (2)) x(k)
UNION ALL SELECT run, CAST(3 + 4*max(idx) AS INT), 'D', CAST(max(idx) AS INT) FROM rep GROUP BY run""",
    "report_single": _REPORTED
    + f"""SELECT run, {_NAMES} AS dimension, CAST(mae AS DOUBLE) AS mae, CAST(r AS DOUBLE) AS pearson_r
      FROM rep WHERE dim IN ('V', 'D')""",
    "compare_runs": _COMPARED + "SELECT * FROM cmp",
    "chart_long": _COMPARED
    + "\nUNION ALL ".join(
        f"SELECT lang, dimension, '{n}' AS run, '{m}' AS metric, {m}_{n} AS value FROM cmp WHERE {m}_{n} IS NOT NULL"
        for n in "ab"
        for m in ("mae", "pearson_r")
    ),
    "any_present": _with(ANNOTATED)
    + """SELECT bool_or(V IS NOT NULL) AS V, bool_or(A IS NOT NULL) AS A,
      coalesce(bool_or(lang = 'no such language'), FALSE) AS nothing FROM ann""",
    "learning_curve": _with(
        LOSSES,
        STOPS.format(limit="", patience=3),
    )
    + """SELECT l.run AS run, l.epoch AS epoch, round(l.loss, 6) AS train_loss,
      round(CASE WHEN l.epoch <= coalesce(t.stop, t.n) THEN l.loss*1.1e0 END, 6) AS val_loss
      FROM loss_log l JOIN t ON l.run = t.run""",
    "row_counts": _with(ANNOTATED, GOLD, PREDICTIONS)
    + "SELECT count(*) AS n, 'preds' AS input FROM pred UNION ALL SELECT count(*), 'gold' FROM gold",
}
