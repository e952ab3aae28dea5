"""DuckDB twins of the registered queries (the correctness oracle).

Written independently of the Spark code, as plain SQL over the driver's views.
Literals are cast to DOUBLE where the Spark side multiplies by a double
(DuckDB would otherwise use exact DECIMAL arithmetic).
"""

from __future__ import annotations

import re

WS = (r"[ \t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda q: q <> '')"


def wc(x: str) -> str:
    return f"len({words(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lm_tokens(x: str) -> str:
    return words(f"lower({x})")


def d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


SENTENCES = f"""
sentences AS (
  SELECT doc_id, lang, source, pos, text, {wc('text')} AS length FROM (
    SELECT doc_id, lang, source, pos, {strip('piece')} AS text FROM (
      SELECT doc_id, lang, source, unnest(pcs) AS piece, unnest(range(len(pcs))) AS pos
      FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') AS pcs FROM documents)))
  WHERE text <> '')"""

FLAT = """
docl AS (SELECT doc_id, coalesce(lang, '') AS l, row_number() OVER (ORDER BY coalesce(lang, ''), doc_id) - 1 AS g FROM documents),
runs AS (SELECT l, min(g) AS first, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM docl GROUP BY l),
donors AS (SELECT a.doc_id, o.doc_id AS donor_id FROM docl a JOIN runs USING (l)
           JOIN docl o ON o.g = (first + n + (a.g - first) % (total - n)) % total WHERE total > n),
flat AS (SELECT h.source AS topic, h.doc_id, h.pos, h.text AS sentence, o.text AS alternative FROM sentences h
         LEFT JOIN donors dn ON dn.doc_id = h.doc_id AND h.pos % 3 = 1
         LEFT JOIN sentences o ON o.doc_id = dn.donor_id AND o.pos = h.pos)"""


def atoms_cte(name: str, ratio: float, max_sentences: int | None = None, lo: int = 10, hi: int = 100) -> str:
    m = max_sentences
    c0 = f" AND ob < {m} AND otot >= {m}" if m else ""
    c1 = f" AND ob + eb < {m} AND otot + etot >= {m}" if m else ""
    return f"""
{name}_w AS (
  SELECT *, CASE WHEN {wc('sentence')} BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS orig_ok,
         CASE WHEN alternative IS NOT NULL AND {wc('alternative')} BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS alt_ok,
         {wc('sentence')} AS olen, {wc('alternative')} AS alen
  FROM flat),
{name}_w2 AS (
  SELECT *, count(*) OVER wa AS n_sent,
         coalesce(sum(orig_ok) OVER wb, 0) AS ob, sum(orig_ok) OVER wa AS otot,
         coalesce(sum(alt_ok) OVER wb, 0) AS eb_raw, sum(alt_ok) OVER wa AS etot_raw
  FROM {name}_w
  WINDOW wa AS (PARTITION BY topic, doc_id),
         wb AS (PARTITION BY topic, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_w3 AS (SELECT *, CAST(floor(n_sent * {d(ratio)}) AS BIGINT) AS budget FROM {name}_w2),
{name}_w4 AS (SELECT *, (alt_ok = 1 AND eb_raw + 1 <= budget) AS inc, least(eb_raw, budget) AS eb,
                     least(etot_raw, budget) AS etot FROM {name}_w3),
{name} AS (
  SELECT topic, doc_id, pos, 0 AS edited, 0 AS kind, sentence AS text, olen AS length, 'no edits' AS tag,
         ob + 1 AS atom_no FROM {name}_w4 WHERE orig_ok = 1{c0}
  UNION ALL
  SELECT topic, doc_id, pos, 1, 0, sentence, olen, 'no edits', ob + eb + 1 FROM {name}_w4 WHERE orig_ok = 1{c1}
  UNION ALL
  SELECT topic, doc_id, pos, 1, 1, alternative, alen, '<edit>', ob + eb + orig_ok + 1 FROM {name}_w4 WHERE inc{c1})"""


LM = f"""
docmodel AS (SELECT doc_id, coalesce(lang, '') || ':' || CAST(doc_id % 2 AS VARCHAR) AS model,
                    coalesce(lang, '') || ':' || CAST((doc_id + 1) % 2 AS VARCHAR) AS trains FROM documents),
train_tok AS (SELECT m.trains AS model, {lm_tokens('text')} AS t FROM sentences JOIN docmodel m USING (doc_id)),
uni AS (SELECT model, w, count(*) AS c_w FROM (SELECT model, unnest(t) AS w FROM train_tok) GROUP BY model, w),
big AS (SELECT model, u, w, count(*) AS c_uw FROM (
          SELECT model, unnest(t[1:len(t) - 1]) AS u, unnest(t[2:len(t)]) AS w FROM train_tok WHERE len(t) >= 2)
        GROUP BY model, u, w),
pre AS (SELECT model, u, sum(c_uw) AS c_u FROM big GROUP BY model, u),
nv AS (SELECT model, CAST(sum(c_w) + count(*) + 1 AS DOUBLE) AS denom FROM uni GROUP BY model)"""


def score_cte(name: str, src: str) -> str:
    """``name(tid, model, response)`` for the distinct texts (``tid`` = md5) of ``src(doc_id, text)``, each by its document's model."""
    return f"""
{name}_tok AS (SELECT md5(text) AS tid, model, any_value(text) AS text FROM {src} JOIN docmodel USING (doc_id)
               WHERE text IS NOT NULL GROUP BY 1, 2),
{name}_pairs AS (SELECT tid, model, unnest(t[1:len(t) - 1]) AS u, unnest(t[2:len(t)]) AS w
                 FROM (SELECT tid, model, {lm_tokens('text')} AS t FROM {name}_tok) WHERE len(t) >= 2),
{name}_nll AS (
  SELECT p.tid, p.model, -ln((coalesce(b.c_uw, 0) + {d(5.0)} * ((coalesce(un.c_w, 0) + {d(1.0)}) / coalesce(nv.denom, {d(1.0)})))
                    / (coalesce(pr.c_u, 0) + {d(5.0)})) AS nll
  FROM {name}_pairs p LEFT JOIN big b USING (model, u, w) LEFT JOIN pre pr USING (model, u)
  LEFT JOIN uni un USING (model, w) LEFT JOIN nv USING (model)),
{name} AS (SELECT tid, model, round(avg(nll), 9) AS response FROM {name}_nll GROUP BY tid, model)"""


def scored_cte(name: str, src: str, ts: str = "ts") -> str:
    """``name`` = ``src`` with its model and response."""
    return (f"{name} AS (SELECT a.*, m.model, {ts}.response FROM {src} a JOIN docmodel m USING (doc_id) "
            f"LEFT JOIN {ts} ON {ts}.tid = md5(a.text) AND {ts}.model = m.model)")


def roles_cte(src: str, gkeys: str = "topic, edit_ratio", k: int = 10, split: float = 0.8) -> str:
    """fold roles over ``src(topic, edit_ratio, doc_id)`` (default block = floor(i k / n))."""
    return f"""
idx AS (SELECT *, row_number() OVER (PARTITION BY {gkeys} ORDER BY doc_id) - 1 AS row_index,
               count(*) OVER (PARTITION BY {gkeys}) AS n_rows FROM {src}),
grp AS (SELECT DISTINCT {gkeys}, n_rows FROM idx),
bt0 AS (SELECT grp.*, f.fold, b.block FROM grp, range(0, {k}) f(fold), range(0, {k}) b(block)),
bt1 AS (SELECT *, CAST(floor(((block + 1) * n_rows + {k - 1}) / {k}) - floor((block * n_rows + {k - 1}) / {k}) AS BIGINT)
                  AS block_rows, (block = fold) AS is_test FROM bt0),
bt2 AS (SELECT *, coalesce(sum(CASE WHEN is_test THEN block_rows END) OVER (
                  PARTITION BY {gkeys}, fold ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS test_before,
               coalesce(sum(CASE WHEN NOT is_test THEN block_rows END) OVER (PARTITION BY {gkeys}, fold), 0) AS n_null
        FROM bt1),
bt AS (SELECT *, floor(n_null * {d(split)}) AS cut FROM bt2),
roles AS (SELECT i.topic, i.edit_ratio, i.doc_id, bt.fold, bt.block, i.row_index,
                 CASE WHEN bt.is_test THEN 'test' WHEN i.row_index - bt.test_before < bt.cut THEN 'null'
                      ELSE 'calibration' END AS role
          FROM idx i JOIN bt ON i.topic = bt.topic AND i.edit_ratio = bt.edit_ratio
                             AND CAST(floor(i.row_index * {k} / i.n_rows) AS BIGINT) = bt.block)"""


def grid_cte(null_src: str, K: str, G: int = 43, p: str = "", fill: bool = True, xrange=None, log: bool = True) -> str:
    """null grid over ``null_src(K..., length, x)``; K = comma separated key list;
    CTE names get the prefix ``p``; ``xrange`` fixes the x range."""
    g1 = G - 1
    first, last = (d(0), "ln(CAST(n AS DOUBLE))") if log else (d(1), d(0))
    zlo, zhi = ("(-ln((above + cmlo) / n))", "(-ln(above / n))") if log else ("((above + cmlo) / n)", "(above / n)")
    if xrange is None:
        xs = f"min(x) AS xmin, max(x) AS xmax, (max(x) - min(x))"
    else:
        xs = f"{d(xrange[0])} AS xmin, {d(xrange[1])} AS xmax, ({d(xrange[1])} - {d(xrange[0])})"
    body = f"""
st AS (SELECT {K}, {xs} / {d(max(g1, 1))} AS dx FROM {null_src} GROUP BY {K}),
vc AS (SELECT {K}, length, x, count(*) AS cnt FROM {null_src} GROUP BY {K}, length, x),
nl AS (SELECT {K}, length, sum(cnt) AS n FROM vc GROUP BY {K}, length),
valid AS (SELECT * FROM nl WHERE n > 1),
ag AS (SELECT {K}, length, g, sum(cnt) AS c, min(x) AS mnx, max(x) AS mxx, arg_max(cnt, x) AS cm FROM (
         SELECT vc.*, CAST(CASE WHEN st.dx > 0 THEN least({g1}, greatest(0, ceil((vc.x - st.xmin) / st.dx))) ELSE 0 END
                      AS INTEGER) AS g
         FROM vc JOIN st USING ({K})) GROUP BY {K}, length, g),
scaf AS (SELECT valid.*, st.xmin, st.xmax, st.dx, gg.g FROM valid JOIN st USING ({K}), range(0, {G}) gg(g)),
gr AS (SELECT scaf.*, ag.c, ag.mnx, ag.mxx, ag.cm FROM scaf LEFT JOIN ag USING ({K}, length, g)),
gr2 AS (SELECT *, max(mxx) OVER wu AS xlo, last_value(cm IGNORE NULLS) OVER wu AS cmlo,
               min(mnx) OVER wa AS xhi, coalesce(sum(c) OVER wa, 0) AS above,
               CASE WHEN g = {g1} THEN xmax ELSE g * dx + xmin END AS xg
        FROM gr WINDOW wu AS (PARTITION BY {K}, length ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       wa AS (PARTITION BY {K}, length ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
gr3 AS (SELECT {K}, length, g, xg, xmin, xmax, dx,
               CASE WHEN xlo IS NULL THEN {first} WHEN xhi IS NULL THEN {last}
                    ELSE ({zhi} - {zlo}) / (xhi - xlo) * (xg - xlo) + {zlo} END AS z FROM gr2),
lr AS (SELECT {K}, min(length) AS lmin, max(length) AS lmax, any_value(xmin) AS xmin, any_value(xmax) AS xmax,
              any_value(dx) AS dx FROM gr3 GROUP BY {K}),"""
    if fill:
        body += f"""
gcols AS (SELECT DISTINCT {K}, g, xg FROM gr3),
dense AS (SELECT * FROM (SELECT {K}, lmin, lmax, xmin, xmax, dx, unnest(range(lmin, lmax + 1)) AS length FROM lr)
          JOIN gcols USING ({K})),
dz AS (SELECT dense.*, gv.zv, gv.lv FROM dense
       LEFT JOIN (SELECT {K}, length, g, z AS zv, length AS lv FROM gr3) gv USING ({K}, length, g)),
dz2 AS (SELECT *, last_value(zv IGNORE NULLS) OVER wu AS zl, last_value(lv IGNORE NULLS) OVER wu AS ll,
               first_value(zv IGNORE NULLS) OVER wf AS zh, first_value(lv IGNORE NULLS) OVER wf AS lh
        FROM dz WINDOW wu AS (PARTITION BY {K}, g ORDER BY length ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       wf AS (PARTITION BY {K}, g ORDER BY length ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
grid0 AS (SELECT {K}, length, g, xg, xmin, xmax, dx, lmin, lmax,
                 CASE WHEN ll = lh THEN zl ELSE zl + (length - ll) / (lh - ll) * (zh - zl) END AS z FROM dz2),
"""
    else:
        body += f"""
grid0 AS (SELECT gr3.*, lr.lmin, lr.lmax FROM gr3 JOIN (SELECT {K}, lmin, lmax FROM lr) lr USING ({K})),"""
    body += f"""
grid AS (SELECT *, lead(xg) OVER w AS xg_next, lead(z) OVER w AS z_next FROM grid0
         WINDOW w AS (PARTITION BY {K}, length ORDER BY g))"""
    for nm in ("grid0", "grid", "gcols", "dense", "dz2", "dz", "gr3", "gr2", "gr", "scaf", "ag", "valid", "nl", "vc", "st", "lr"):
        body = re.sub(rf"\b{nm}\b", p + nm, body) if p else body
    return body


def policy_sql(length: str = "length", response: str = "response", mn: int = 10, mx: int = 50,
               policy: str = "max_available") -> tuple[str, str]:
    nan = f"({response} IS NULL OR isnan({response}))"
    if policy == "truncate":
        long_len, long_c = str(mx), f"'truncated to {mx} tokens'"
    elif policy == "ignore":
        long_len, long_c = "NULL", "'ignored (above maximum limit)'"
    else:
        long_len, long_c = str(mx), "'exceeding length limit; resorting to max-available length'"
    eff = (f"CAST(CASE WHEN {nan} THEN NULL WHEN {length} < {mn} THEN NULL WHEN {length} > {mx} THEN {long_len} "
           f"ELSE {length} END AS INTEGER)")
    com = (f"CASE WHEN {nan} THEN 'ignored (no response)' WHEN {length} < {mn} THEN 'ignored (below minimal length)' "
           f"WHEN {length} > {mx} THEN {long_c} ELSE 'OK' END")
    return eff, com


def pvalue_cte(name: str, src: str, K: str, on: str, grid: str = "grid") -> str:
    """``name`` = ``src`` (with eff_length, response) + pvalue from ``grid``; ``on`` joins grid keys."""
    return f"""
{name}_b AS (SELECT b.*, nc.gmax FROM (SELECT DISTINCT {K}, lmin, lmax, xmin, xmax, dx FROM {grid}) b
             JOIN (SELECT {K}, max(g) AS gmax FROM {grid} GROUP BY {K}) nc USING ({K})),
{name}_j AS (SELECT s.*, b.lmin, b.lmax, b.xmin, b.xmax, b.dx, b.gmax FROM {src} s LEFT JOIN {name}_b b USING ({K})),
{name}_j2 AS (SELECT *, least(greatest(eff_length, lmin), lmax) AS _l, least(greatest(response, xmin), xmax) AS _x
              FROM {name}_j),
{name}_j3 AS (SELECT *, CAST(CASE WHEN dx > 0 THEN least(greatest(floor((_x - xmin) / dx), 0), greatest(gmax - 1, 0))
                             ELSE 0 END AS INTEGER) AS _g FROM {name}_j2),
{name}_z AS (SELECT j.*, CASE WHEN gg.xg_next IS NULL OR gg.xg_next = gg.xg THEN gg.z
                         ELSE (gg.z_next - gg.z) / (gg.xg_next - gg.xg) * (j._x - gg.xg) + gg.z END AS zi
             FROM {name}_j3 j LEFT JOIN {grid} gg ON {on} AND gg.length = j._l AND gg.g = j._g),
{name} AS (SELECT *, CASE WHEN eff_length IS NULL OR response IS NULL OR zi IS NULL THEN NULL
                          ELSE least({d(1.0)}, exp(-zi)) END AS pvalue FROM {name}_z)"""


def tests_cte(src: str, K: str, gamma: float = 0.15, variant: str = "2004") -> str:
    """per-document tests over ``src(K..., pvalue)``."""
    base = "p * (1 - p)" if variant == "2004" else "(CAST(i AS DOUBLE) / n) * (1 - CAST(i AS DOUBLE) / n)"
    return f"""
vp AS (SELECT {K}, pvalue AS p FROM {src} WHERE pvalue IS NOT NULL),
per_doc AS (SELECT {K}, count(*) AS n_valid, sum(-2 * ln(p)) AS fisher, min(p) AS pmin FROM vp GROUP BY {K}),
tg AS (SELECT {K}, p, count(*) AS m FROM vp GROUP BY {K}, p),
tg2 AS (SELECT *, sum(m) OVER (PARTITION BY {K} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               sum(m) OVER (PARTITION BY {K}) AS n FROM tg),
tg3 AS (SELECT *, greatest(1, floor(n * {d(gamma)} + {d(0.5)})) AS imax FROM tg2),
tg4 AS (SELECT *, least(c, imax) AS i FROM tg3 WHERE c - m + 1 <= imax),
tg5 AS (SELECT *, sqrt(CAST(n AS DOUBLE)) * (CAST(i AS DOUBLE) / CAST(n AS DOUBLE) - p)
                  / greatest(sqrt({base}), {d(1.0)} / ({d(100.0)} + CAST(n AS DOUBLE) * CAST(n AS DOUBLE))) AS hc
        FROM tg4),
hcs AS (SELECT {K}, max(hc) AS HC, arg_max(p, row(hc, -p)) AS hc_threshold FROM tg5 GROUP BY {K}),
tests AS (SELECT per_doc.*, hcs.HC, hcs.hc_threshold,
                 CASE WHEN fisher <= 0 THEN {d(1.0)} ELSE least({d(1.0)}, list_sum(list_transform(range(0, n_valid),
                      lambda k: exp(k * ln(fisher / 2) - fisher / 2 - lgamma(k + 1))))) END AS fisher_pvalue,
                 -ln(pmin) AS minP, least({d(1.0)}, n_valid * pmin) AS bonf
          FROM per_doc JOIN hcs USING ({K}))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def normalise(sql: str, spec: list[tuple[str, str]]) -> str:
    """Final projection with the declared types; doubles rounded to 6 decimals."""
    cols = []
    for c, t in spec:
        if t == "double":
            cols.append(f"CAST(round(CAST({c} AS DOUBLE), 6) AS DOUBLE) + CAST(0 AS DOUBLE) AS {c}")  # no -0.0
        elif t == "bigint":
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
        elif t == "string":
            cols.append(f"CAST({c} AS VARCHAR) AS {c}")
        else:
            cols.append(f"CAST({c} AS {t.upper()}) AS {c}")
    return f"SELECT {', '.join(cols)} FROM ({sql}) q"
