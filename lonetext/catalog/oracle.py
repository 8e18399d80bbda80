"""The same results in plain SQL over the given tables, for the queries that SQL can express."""

from __future__ import annotations

from ..functions import text as tx
from ..plans import report
from ..plans.benchmark import LEVELS, ROUNDS
from . import inputs as src


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


DOC = """doc AS (SELECT d.doc_id, d.doc_id AS row_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
WIKI = f"wiki AS (SELECT doc_id AS row_id, source AS title, {src.WIKI_NS} AS ns, {src.WIKI_TEXT} AS text FROM documents)"
RES = f"res AS ({src.RESULT_ROWS})"


def _words(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')")


# --- hashed vectors: (row_id, vec) with 64 dimensions

HASHED = f"""
tok AS (SELECT row_id, md5(w) AS h FROM (SELECT row_id, unnest({_words('text')}) AS w FROM doc)),
buckets AS (SELECT row_id, CAST(concat('0x', substr(h, 1, 7)) AS BIGINT) % 64 AS dim,
    sum(CASE WHEN CAST(concat('0x', substr(h, 8, 1)) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v
  FROM tok GROUP BY ALL),
norms AS (SELECT row_id, sqrt(sum(v * v)) AS norm FROM buckets GROUP BY row_id),
dense AS (SELECT d.row_id, g.dim, coalesce(CASE WHEN n.norm > 0 THEN b.v / n.norm END, 0.0::DOUBLE) AS value
  FROM doc d CROSS JOIN (SELECT unnest(range(64)) AS dim) g
  LEFT JOIN buckets b ON b.row_id = d.row_id AND b.dim = g.dim LEFT JOIN norms n ON n.row_id = d.row_id),
hashed AS (SELECT row_id, list(value ORDER BY dim) AS vec FROM dense GROUP BY row_id)"""

# --- labelling, contamination, split, known labels over the vectors

BINARY = """majority AS (SELECT label FROM embeddings WHERE label IS NOT NULL GROUP BY label
  ORDER BY count(*) DESC, label LIMIT 1),
bin AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label,
  CASE WHEN label = (SELECT label FROM majority) THEN 0 ELSE 1 END AS y FROM embeddings)"""


def _place(seed: str = "42") -> str:
    return f"md5(concat_ws(':', CAST({seed} AS VARCHAR), CAST(row_id AS VARCHAR))), row_id"


THIN = f"""{BINARY},
thin AS (SELECT row_id, vec, label, y FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_place()}) AS rk FROM bin)
  WHERE y = 0 OR rk <= (SELECT floor(count(*) * CAST({src.SHARE} AS DOUBLE)) FROM bin WHERE y = 0))"""


def _quotas(source: str, cls: str, wanted: str) -> str:
    """Largest-remainder shares of `wanted` rows per class: table quota(cls, k)."""
    return f"""sizes AS (SELECT {cls} AS cls, count(*) AS n FROM {source} GROUP BY {cls}),
need AS (SELECT sum(n)::BIGINT AS total, ({wanted})::BIGINT AS want FROM sizes),
floors AS (SELECT cls, n, n * want // total AS k, n * want % total AS rem, want FROM sizes, need),
quota AS (SELECT cls, k + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= want - sum(k) OVER ()
  THEN 1 ELSE 0 END AS k FROM floors)"""


def _split(tables: str, source: str) -> str:
    return f"""{tables}, {_quotas(source, "y", "sum(n) - ceil(CAST(0.2 AS DOUBLE) * sum(n))")},
spl AS (SELECT t.row_id, t.vec, t.y, CASE WHEN t.rk <= q.k THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_place()}) AS rk FROM {source}) t
  JOIN quota q ON q.cls = t.y),
train AS (SELECT * FROM spl WHERE split = 'train')"""


SPLIT = _split(BINARY, "bin")
THIN_SPLIT = _split(THIN, "thin")

SEMI = f"""{SPLIT},
known AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_place()}) AS rk FROM train WHERE y = 1)
  WHERE rk <= (SELECT floor(CAST({src.LEVEL} AS DOUBLE) * count(*)) FROM train)),
sco AS (SELECT row_id, split, y, CASE WHEN row_id IN (SELECT row_id FROM known) THEN 1 ELSE 0 END AS y_semi,
  floor(vec[1] * 10) / 10.0::DOUBLE AS score FROM spl)"""


def _grid() -> str:
    levels = ", ".join(f"(CAST({c} AS DOUBLE))" for c in LEVELS)
    return f"""{SPLIT},
grid AS (SELECT contamination, CAST(r AS INTEGER) AS round FROM (VALUES {levels}) l(contamination),
  (SELECT unnest(range({ROUNDS})) AS r)),
gridded AS (SELECT t.row_id, t.y, g.contamination, g.round, CASE WHEN y = 1 AND row_number() OVER (
    PARTITION BY y, contamination, round ORDER BY {_place('42 + round')})
    <= floor(contamination * (SELECT count(*) FROM train)) THEN 1 ELSE 0 END AS y_semi
  FROM train t CROSS JOIN grid g)"""


# --- detectors in SQL; `fit` and `rows` hold (row_id, vec)


def _hbos(fit: str, rows: str, out: str = "hbos") -> str:
    return f"""fv AS (SELECT row_id, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM {fit}),
rv AS (SELECT row_id, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM {rows}),
edge AS (SELECT dim, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  (CASE WHEN min(x) = max(x) THEN (max(x) + 0.5) - (min(x) - 0.5) ELSE max(x) - min(x) END) / 10 AS width,
  count(*) AS n FROM fv GROUP BY dim),
bins AS (SELECT e.dim, least(floor((x - lo) / width), 9) AS bin, count(*) / (any_value(n) * any_value(width)) AS density
  FROM fv JOIN edge e USING (dim) GROUP BY ALL),
logs AS (SELECT e.dim, b.bin, log2(coalesce(bins.density, 0) + 0.1::DOUBLE) AS v
  FROM edge e CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN bins ON bins.dim = e.dim AND bins.bin = b.bin),
lowest AS (SELECT dim, min(v) AS v FROM logs GROUP BY dim),
placed AS (SELECT row_id, rv.dim, (x - lo) / width AS place FROM rv JOIN edge USING (dim)),
{out} AS (SELECT p.row_id, -sum(CASE WHEN p.place >= -0.5 AND p.place <= 10.5 THEN l.v ELSE m.v END) AS score
  FROM placed p JOIN logs l ON l.dim = p.dim AND l.bin = greatest(least(floor(p.place), 9), 0)
  JOIN lowest m ON m.dim = p.dim GROUP BY p.row_id)"""


def _lof(fit: str, rows: str, k: int = 20) -> str:
    """Rank all pairs; ties by distance to 9 decimals go to the vector with the smallest row, then the row."""
    return f"""pts AS (SELECT row_id, vec, min(row_id) OVER (PARTITION BY vec) AS loc FROM {fit}),
kk AS (SELECT greatest(1, least({k}, count(*) - 1)) AS k FROM pts),
fd AS (SELECT a.row_id AS a, b.row_id AS b, b.loc, list_distance(a.vec, b.vec) AS d FROM pts a JOIN pts b
  ON a.row_id <> b.row_id),
fn AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), loc, b) AS rk FROM fd)
  WHERE rk <= (SELECT k FROM kk)),
kd AS (SELECT a AS b, max(d) AS kd FROM fn GROUP BY a),
lrd AS (SELECT fn.a AS b, 1.0 / (sum(greatest(kd.kd, fn.d)) / (SELECT k FROM kk) + 1e-10) AS lrd
  FROM fn JOIN kd ON kd.b = fn.b GROUP BY fn.a),
sd AS (SELECT q.row_id AS a, b.row_id AS b, b.loc, list_distance(q.vec, b.vec) AS d FROM {rows} q CROSS JOIN pts b),
sn AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), loc, b) AS rk FROM sd)
  WHERE rk <= (SELECT k FROM kk)),
lof AS (SELECT sn.a AS row_id, sum(lrd.lrd) / (SELECT k FROM kk)
    * (sum(greatest(kd.kd, sn.d)) / (SELECT k FROM kk) + 1e-10) AS score
  FROM sn JOIN kd ON kd.b = sn.b JOIN lrd ON lrd.b = sn.b GROUP BY sn.a)"""


def _kde(fit: str, rows: str, bandwidth: float = 1.0) -> str:
    return f"""kde AS (SELECT q.row_id, ln((SELECT count(*) FROM {fit}))
    + len(any_value(q.vec)) * ln({bandwidth}::DOUBLE * sqrt(2 * pi()))
    - ln(sum(exp(-pow(list_distance(q.vec, t.vec) / {bandwidth}::DOUBLE, 2) / 2))) AS score
  FROM {rows} q CROSS JOIN {fit} t GROUP BY q.row_id)"""


def _mahalanobis(fit: str, rows: str, dim: int = 64) -> str:
    """z' C^-1 z, which the sum over all principal axes equals; C is inverted by elimination, a step per dimension."""
    return f"""pv AS (SELECT row_id, unnest(range(1, {dim + 1})) AS i, unnest(vec) AS x FROM {fit}),
moment AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM pv GROUP BY i),
zt AS (SELECT row_id, i, (x - m) / s AS z FROM pv JOIN moment USING (i)),
cv AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / ((SELECT count(*) FROM {fit}) - 1) AS c
  FROM zt a JOIN zt b USING (row_id) GROUP BY a.i, b.i),
elim(k, i, r) AS (
  SELECT 0, i, list_concat(list(c ORDER BY j),
    list_transform(range(1, {dim + 1}), lambda q: CASE WHEN q = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))
  FROM cv GROUP BY i
  UNION ALL
  SELECT a.k + 1, a.i, CASE WHEN a.i = p.i THEN list_transform(a.r, lambda x: x / p.r[p.i])
    ELSE list_transform(range(1, {2 * dim + 1}), lambda q: a.r[q] - p.r[q] * a.r[p.i] / p.r[p.i]) END
  FROM elim a JOIN elim p ON p.i = a.k + 1 WHERE a.k < {dim}),
inverse AS (SELECT i, unnest(range(1, {dim + 1})) AS j, unnest(r[{dim + 1}:]) AS v FROM elim WHERE k = {dim}),
za AS (SELECT row_id, i, (x - m) / s AS z FROM (
  SELECT row_id, unnest(range(1, {dim + 1})) AS i, unnest(vec) AS x FROM {rows}) JOIN moment USING (i)),
pca AS (SELECT a.row_id, sum(a.z * v * b.z) AS score FROM za a JOIN inverse USING (i)
  JOIN za b ON b.row_id = a.row_id AND b.i = j GROUP BY a.row_id)"""


def _forest(fit: str, rows: str, n_trees: int = 100, psi: int = 256, height: int = 8, seed: int = 42) -> str:
    """Trees grown level by level from hashed draws, with the scored rows walking along: forest(row_id, score, spread).

    `grow{l}` and `walk{l}` hold the rows that are at a node of level l; `cut{l}` the nodes that are split.
    """
    def mean_path(n: str) -> str:
        return f"""CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n}
          WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""

    def number(first: int, digits: int) -> str:
        return f"(CAST(concat('0x', substr(h, {first}, {digits})) AS BIGINT) / {2 ** (4 * digits)}::DOUBLE)"

    parts = [f"""tree AS (SELECT CAST(unnest(range({n_trees})) AS INTEGER) AS tree),
grow0 AS (SELECT tree, 1 AS node, row_id, vec FROM (SELECT tree, row_id, vec, row_number() OVER (PARTITION BY tree
    ORDER BY md5(concat('{seed}:', tree, ':row:', row_id)), row_id) AS rk FROM {fit}, tree) WHERE rk <= {psi}),
walk0 AS (SELECT tree, 1 AS node, row_id, vec FROM {rows}, tree)"""]
    for level in range(height):
        parts.append(f"""box{level} AS (SELECT tree, node, dim, min(x) AS lo, max(x) AS hi FROM (SELECT tree, node,
    unnest(range(1, len(vec) + 1)) AS dim, unnest(vec) AS x FROM grow{level}) GROUP BY ALL HAVING max(x) > min(x)),
cut{level} AS (SELECT tree, node, pick['dim'] AS dim,
    pick['lo'] + {number(9, 12)} * (pick['hi'] - pick['lo']) AS cut
  FROM (SELECT tree, node, h, d[1 + floor({number(1, 8)} * len(d))::INT] AS pick FROM (SELECT tree, node,
      list(struct_pack(dim := dim, lo := lo, hi := hi) ORDER BY dim) AS d,
      md5(concat('{seed}:', tree, ':node:', node)) AS h FROM box{level} GROUP BY tree, node)))""")
        for name in ("grow", "walk"):
            parts.append(f"""{name}{level + 1} AS (SELECT tree, 2 * node + CASE WHEN vec[dim] <= cut THEN 0 ELSE 1 END
    AS node, row_id, vec FROM {name}{level} JOIN cut{level} USING (tree, node))""")
        parts.append(f"size{level} AS (SELECT tree, node, count(*) AS n FROM grow{level} GROUP BY tree, node)")
        parts.append(f"""stop{level} AS (SELECT row_id, tree, {level} + {mean_path('n')} AS path FROM walk{level}
    JOIN size{level} USING (tree, node) ANTI JOIN cut{level} USING (tree, node))""")
    parts.append(f"""size{height} AS (SELECT tree, node, count(*) AS n FROM grow{height} GROUP BY tree, node),
stop{height} AS (SELECT row_id, tree, {height} + {mean_path('coalesce(n, 0)')} AS path FROM walk{height}
    LEFT JOIN size{height} USING (tree, node))""")
    every = " UNION ALL ".join(f"SELECT * FROM stop{i}" for i in range(height + 1))
    parts.append(f"""norm AS (SELECT {mean_path('n')} AS c FROM (SELECT count(*) AS n FROM grow0 WHERE tree = 0)),
forest AS (SELECT row_id, pow(2, -avg(path / c)) AS score, stddev_pop(path / c) AS spread
  FROM ({every}), norm GROUP BY row_id)""")
    return ",\n".join(parts)


def _detected(score: str) -> str:
    return f"SELECT s.row_id, s.split, s.y, round(d.score, 6) AS score FROM spl s JOIN {score} d USING (row_id)"


DOC_VECTORS = f"{DOC}, {HASHED}, vecs AS (SELECT row_id, vec, toxic AS y FROM hashed JOIN doc USING (row_id))"


# --- metrics by comparing all positive and negative pairs


def _metrics(source: str, by: str) -> str:
    """Tables auc(by, auc) and ap(by, ap) for source(by, y, score)."""
    return f"""runs AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY ALL),
totals AS (SELECT {by}, sum(pos) AS p, sum(neg) AS n FROM runs GROUP BY ALL),
auc AS (SELECT {by}, CASE WHEN any_value(p) * any_value(n) > 0 THEN won / (any_value(p) * any_value(n)) END AS auc
  FROM (SELECT a.{by}, sum(a.pos * b.neg * CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score
      THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS won FROM runs a JOIN runs b ON a.{by} = b.{by} GROUP BY a.{by})
    JOIN totals USING ({by}) GROUP BY {by}, won),
steps AS (SELECT {by}, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM runs
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
ap AS (SELECT {by}, CASE WHEN any_value(p) > 0 THEN sum(CASE WHEN pos > 0 THEN pos::DOUBLE * tp / (tp + fp) ELSE 0 END)
    / any_value(p) ELSE 0.0::DOUBLE END AS ap FROM steps JOIN totals USING ({by}) GROUP BY {by})"""


def _curve(x: str) -> str:
    digest = "md5(concat_ws(':', '42', replicate, run_id, model, dataset, round))"
    reached = " + ".join(f"(u >= {_double(p)})::INT" for p in report.POISSON)
    return f"""SELECT model, dataset, {x}, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, any_value(n) AS n,
  CASE WHEN any_value(n) > 1 THEN round(quantile_cont(m, 0.025), 8) END AS lo,
  CASE WHEN any_value(n) > 1 THEN round(quantile_cont(m, 0.975), 8) END AS hi
FROM (SELECT model, dataset, {x}, avg(test_auc) AS mean, stddev_samp(test_auc) AS sd, count(*) AS n
    FROM curve WHERE test_auc IS NOT NULL GROUP BY ALL)
  JOIN (SELECT model, dataset, {x}, replicate, sum(times * test_auc) / nullif(sum(times), 0) AS m
    FROM (SELECT *, {reached} AS times FROM (SELECT model, dataset, {x}, replicate, test_auc,
      ('0x' || left({digest}, 13))::BIGINT / {_double(float(1 << 52))} AS u
      FROM curve, range(1, {report.REPLICATES + 1}) r(replicate) WHERE test_auc IS NOT NULL)) GROUP BY ALL)
  USING (model, dataset, {x}) GROUP BY model, dataset, {x}"""


def _replace(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {_q(pattern.replace('(?id)', '(?i)'))}, {_q(to.replace('$1', chr(92) + '1'))}, 'g')"


def _plain(categories: bool) -> str:
    """What is left of the pages of `inputs.WIKI_TEXT`, written piece by piece and not by patterns."""
    last = """'Categoria:', CASE doc_id % 7 WHEN 0 THEN 'Cultura' WHEN 1 THEN 'economia do Brasil' WHEN 2 THEN 'Política'
        WHEN 3 THEN 'Esporte' WHEN 4 THEN 'Saúde' WHEN 5 THEN 'Ciência e Tecnologia' ELSE 'Mundo' END,
      CASE WHEN doc_id % 3 = 0 THEN 'categoria:Economia' ELSE '' END"""
    pieces = f"""concat(CASE WHEN doc_id % 11 = 0 THEN concat('#Redirect ', source, chr(10)) ELSE '' END, chr(10), source,
      ' ', source, ' Lisboa site ', ' 3 < 5 and 7 > 2 & more x   ', chr(10), lang, chr(10), text, chr(10), chr(10),
      {last if categories else "''"})"""
    return _replace(pieces, f"^{tx.BLANK}+|{tx.BLANK}+$")


def _main_category(text: str = "text") -> str:
    cats = f"regexp_extract_all({text}, {_q(tx.CATEGORY)}, 1)"
    cases = " ".join(f"WHEN len(list_filter({cats}, lambda c: contains(lower(c), {_q(p.lower())}))) > 0 THEN {_q(p)}"
                     for p in tx.PRIORITY)
    return f"CASE {cases} END"


NOT_REDIRECT = "NOT regexp_matches(text, '(?i)#redirect \\[\\[.*?\\]\\]')"
NOT_EMPTY = f"regexp_matches(text, {_q('[^' + tx.BLANK[1:-1] + ']')})"
LONG = "SELECT row_id, CAST(unnest(range(len(vec))) AS INTEGER) AS dim, round(unnest(vec), 6) AS value"
TOKENS = f"""{DOC}, words AS (SELECT row_id, unnest({_words('text')}) AS token,
  CAST(unnest(range(len({_words('text')}))) AS INTEGER) AS pos FROM doc),
tv AS (SELECT row_id, pos, list_transform(range(1, 9), lambda j:
    CAST(concat('0x', substr(md5(token), j, 1)) AS BIGINT)::DOUBLE / 15) AS vec,
  CASE WHEN pos % 5 = 4 THEN 0 ELSE 1 END AS mask FROM words)"""
SPLIT_NAME = "CASE row_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END"
ENCODERS = "(VALUES ('m1', 'multi'), ('m2', 'multi'), ('m3', 'multi'), ('e1', 'en'), ('d1', 'de')) e(name, lang)"
EVALUATE_SETS = """(SELECT 'train' AS part, y, score FROM sco WHERE split = 'train'
  UNION ALL SELECT 'train_semi', y_semi, score FROM sco WHERE split = 'train'
  UNION ALL SELECT 'test', y, score FROM sco WHERE split = 'test')"""

ORACLE: dict[str, str] = {
    "read_splits": f"WITH {DOC} SELECT row_id, text, toxic AS label, {SPLIT_NAME} AS split FROM doc",
    "split_rename": f"WITH {DOC} SELECT row_id, text, toxic AS label, 'train' AS split FROM doc WHERE row_id % 3 = 0",
    "csv_corpus": f"WITH {DOC} SELECT row_id, text, toxic AS label FROM doc",
    "xml_pages": f"WITH {WIKI} SELECT row_id, title, ns, text FROM wiki",
    "artifact_store": f"""WITH {DOC_VECTORS}, stored AS (SELECT row_id, y, list_transform(vec, lambda v: v::FLOAT::DOUBLE)
        AS vec FROM vecs) {LONG}, y AS label FROM stored""",
    "cached_preparation": f"WITH {DOC} SELECT true AS first_built, false AS second_built, count(*) AS n_rows FROM doc",
    "combine": f"""{LONG}, label FROM (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label
        FROM embeddings)""",
    "candidate_recall": """SELECT count(*) AS n_queries, 20 * count(*) AS n_true, true AS nine_in_ten
        FROM embeddings WHERE vec_id % 50 = 0""",
    "result_append": f"""WITH {DOC}, {RES} SELECT run_id, model, dataset, contamination, round, n_known_outliers, train_size, test_size,
          round(test_auc, 6) AS test_auc, round(test_ap, 6) AS test_ap FROM res""",
    "result_readback": f"""WITH {DOC}, {RES} SELECT model, dataset, count(*) AS n, round(avg(test_auc), 6) AS mean_auc
        FROM res WHERE model IN ('m0', 'm2') AND dataset = 'en' GROUP BY model, dataset""",
    "labelled_index_log": f"""WITH {_grid()} SELECT concat('run-', contamination, '-', round) AS run_id, contamination,
          round, count(*) AS n_indices,
          concat('[', string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id), ']') AS indices
        FROM gridded WHERE y_semi = 1 GROUP BY contamination, round""",
    "namespace_filter": f"WITH {WIKI} SELECT row_id, title FROM wiki WHERE ns = 0",
    "redirect_filter": f"WITH {WIKI} SELECT row_id, title FROM wiki WHERE {NOT_REDIRECT}",
    "extract_categories": f"""WITH {WIKI} SELECT row_id,
        array_to_string(regexp_extract_all(text, {_q(tx.CATEGORY)}, 1), '|') AS categories,
        {_replace('text', tx.CATEGORY)} AS text FROM wiki""",
    "pick_category": f"""WITH {WIKI}, c AS (SELECT row_id, {_main_category()} AS label FROM wiki)
        SELECT row_id, label FROM c WHERE label IS NOT NULL""",
    "strip_templates": f"WITH {WIKI} SELECT row_id, {_replace('text', tx.SOURCE)} AS text FROM wiki",
    "extract_dates": f"""WITH {WIKI} SELECT row_id,
        array_to_string(regexp_extract_all(text, {_q(tx.DATE)}, 1), '|') AS dates,
        {_replace('text', tx.DATE)} AS text FROM wiki""",
    "strip_markup": f"SELECT doc_id AS row_id, {_plain(True)} AS text FROM documents",
    "drop_empty": f"""WITH t AS (SELECT doc_id AS row_id, {src.MAYBE_EMPTY} AS text FROM documents)
        SELECT row_id, text FROM t WHERE {NOT_EMPTY}""",
    "wiki_articles": f"""WITH {WIKI}, a AS (SELECT row_id, {_plain(False)} AS text, {_main_category("page")} AS label
          FROM (SELECT w.* EXCLUDE text, w.text AS page, d.* FROM wiki w JOIN documents d ON d.doc_id = w.row_id)
          WHERE ns = 0 AND {NOT_REDIRECT.replace("text", "page")})
        SELECT row_id, text, label FROM a WHERE label IS NOT NULL AND {NOT_EMPTY}""",
    "detect_columns": "SELECT doc_id AS row_id, text, lang AS label FROM documents",
    "join_list_text": "SELECT doc_id AS row_id, array_to_string(string_split(text, ' '), ' ') AS text, lang AS label "
                      "FROM documents",
    "cast_text": "SELECT doc_id AS row_id, CAST(n_chars AS VARCHAR) AS text, lang AS label FROM documents "
                 "WHERE doc_id % 9 <> 0",
    "head_sample": "SELECT doc_id AS row_id, text, lang FROM documents ORDER BY doc_id LIMIT 500",
    "stratified_sample": f"""WITH rws AS (SELECT doc_id AS row_id, text, source AS label FROM documents),
        {_quotas('rws', 'label', 'least(500, sum(n))')}
        SELECT r.row_id, r.text, r.label FROM (SELECT *, row_number() OVER (
          PARTITION BY label ORDER BY {_place()}) AS rk FROM rws) r JOIN quota q ON q.cls = r.label WHERE r.rk <= q.k""",
    "parity_check": """SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing_embeddings,
        count(*) FILTER (WHERE d.doc_id IS NULL) AS missing_texts
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "encode_batches": f"""{LONG} FROM (SELECT doc_id AS row_id, [length(text)::DOUBLE, {', '.join(
        f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE" for v in 'aeiou')}] AS vec FROM documents)""",
    "encode_hashed": f"WITH {DOC}, {HASHED} {LONG} FROM hashed",
    "pool_cls": f"WITH {TOKENS} {LONG} FROM tv WHERE pos = 0",
    "pool_mean": f"""WITH {TOKENS}, p AS (SELECT row_id, mask, CAST(unnest(range(8)) AS INTEGER) AS dim, unnest(vec) AS v
          FROM tv) SELECT row_id, dim, round(sum(v * mask) / greatest(sum(mask)::DOUBLE, 1e-9), 9) AS value
        FROM p GROUP BY row_id, dim""",
    "truncate_tokens": f"""WITH t AS (SELECT doc_id AS row_id, {_words('text')}[1:128] AS w FROM documents)
        SELECT row_id, len(w) AS n_tokens, array_to_string(w, ' ') AS text FROM t""",
    "encoder_pairs": f"""SELECT d.name AS dataset, d.lang, e.name AS encoder, e.lang AS encoder_lang
        FROM (SELECT DISTINCT source AS name, lang FROM documents) d, {ENCODERS}
        WHERE e.lang = 'multi' OR e.lang = d.lang""",
    "label_binary": f"WITH {BINARY} SELECT row_id, label, y FROM bin",
    "label_binary_named": "SELECT vec_id AS row_id, label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y FROM embeddings",
    "class_report": f"""WITH {BINARY} SELECT label, count(*) AS n, CASE WHEN any_value(y) = 0 THEN 'normal'
        ELSE 'anomaly' END AS role FROM bin GROUP BY label""",
    "adjust_contamination": f"WITH {THIN} SELECT row_id, label, y FROM thin",
    "data_summary": f"""WITH {THIN} SELECT count(*) AS n_rows, CAST(max(len(vec)) AS INTEGER) AS dim,
        sum(y)::BIGINT AS n_anomalies, sum(1 - y)::BIGINT AS n_normal, round(avg(y), 6) AS share_anomalies FROM thin""",
    "stratified_split": f"WITH {SPLIT} SELECT row_id, y, split FROM spl",
    "split_summary": f"""WITH {SPLIT} SELECT split, count(*) AS n_rows, sum(y)::BIGINT AS n_outliers,
        sum(1 - y)::BIGINT AS n_inliers FROM spl GROUP BY split""",
    "partial_labels_n": f"""WITH {SPLIT} SELECT row_id, y, CASE WHEN y = 1 AND row_number() OVER (
        PARTITION BY y ORDER BY {_place()}) <= 5 THEN 1 ELSE 0 END AS y_semi FROM train""",
    "partial_labels_c": f"WITH {SEMI} SELECT row_id, y, y_semi FROM sco WHERE split = 'train'",
    "partial_labels_grid": f"WITH {_grid()} SELECT row_id, y, contamination, round, y_semi FROM gridded",
    "iforest": f"WITH {SPLIT}, {_forest('train', 'spl')} {_detected('forest')}",
    "iforest_uncertainty": f"""WITH {SPLIT}, {_forest('train', 'spl')} SELECT s.row_id, s.split, s.y,
        round(d.score, 6) AS score, round(d.spread, 6) AS uncertainty FROM spl s JOIN forest d USING (row_id)""",
    "hbos": f"WITH {SPLIT}, {_hbos('train', 'spl')} {_detected('hbos')}",
    "lof": f"WITH {SPLIT}, {_lof('train', 'spl')} {_detected('lof')}",
    "kde": f"WITH {SPLIT}, {_kde('train', 'spl')} {_detected('kde')}",
    "pca_score": f"WITH RECURSIVE {SPLIT}, {_mahalanobis('train', 'spl')} {_detected('pca')}",
    "hbos_documents": f"""WITH {DOC_VECTORS}, {_hbos('vecs', 'vecs')}
        SELECT row_id, y, round(score, 6) AS score FROM vecs JOIN hbos USING (row_id)""",
    "lof_documents": f"""WITH {DOC_VECTORS}, {_lof('vecs', 'vecs')}
        SELECT row_id, y, round(score, 6) AS score FROM vecs JOIN lof USING (row_id)""",
    "kde_documents": f"""WITH {DOC_VECTORS}, {_kde('vecs', 'vecs')}
        SELECT row_id, y, round(score, 6) AS score FROM vecs JOIN kde USING (row_id)""",
    "lof_cells": f"""WITH {DOC_VECTORS}, {_lof('vecs', 'vecs')}
        SELECT row_id, y, round(score, 6) AS score FROM vecs JOIN lof USING (row_id)""",
    "kde_cells": f"""WITH {DOC_VECTORS}, {_kde('vecs', 'vecs', 0.2)}
        SELECT row_id, y, round(score, 6) AS score FROM vecs JOIN kde USING (row_id)""",
    "keyless_corpus": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text, lang AS label FROM documents",
    "positional_artifacts": f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label,
          CAST(embedding AS DOUBLE[]) AS vec, concat('text ', vec_id) AS text FROM embeddings) {LONG}, text, label FROM e""",
    "roc_auc": f"WITH {SEMI}, {_metrics('sco', 'split')} SELECT split, round(auc, 6) AS auc FROM auc",
    "average_precision": f"WITH {SEMI}, {_metrics('sco', 'split')} SELECT split, round(ap, 6) AS ap FROM ap",
    "split_sizes": f"""WITH {SPLIT} SELECT count(*) FILTER (WHERE split = 'train') AS train_size,
        count(*) FILTER (WHERE split = 'test') AS test_size FROM spl""",
    "evaluate": f"""WITH {SEMI}, sets AS {EVALUATE_SETS}, {_metrics('sets', 'part')},
        m AS (SELECT part, auc, ap, p, n FROM totals JOIN auc USING (part) JOIN ap USING (part))
        SELECT CAST(max(p) FILTER (part = 'train_semi') AS INTEGER) AS n_known_outliers,
          CAST(max(p + n) FILTER (part = 'train') AS BIGINT) AS train_size,
          CAST(max(p + n) FILTER (part = 'test') AS BIGINT) AS test_size,
          round(max(auc) FILTER (part = 'train_semi'), 6) AS train_auc_semi,
          round(max(auc) FILTER (part = 'train'), 6) AS train_auc, round(max(auc) FILTER (part = 'test'), 6) AS test_auc,
          round(max(ap) FILTER (part = 'train_semi'), 6) AS train_ap_semi,
          round(max(ap) FILTER (part = 'train'), 6) AS train_ap, round(max(ap) FILTER (part = 'test'), 6) AS test_ap
        FROM m""",
    "document_length_auc": f"""WITH {DOC}, s AS (SELECT lang, toxic AS y, n_chars // 100 AS score FROM doc),
        {_metrics('s', 'lang')} SELECT lang, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(auc, 6) AS auc,
          round(ap, 6) AS ap FROM totals JOIN auc USING (lang) JOIN ap USING (lang)""",
    "flagship": f"""WITH {THIN}, {_hbos('thin', 'thin')},
        s AS (SELECT 1 AS one, y, score FROM thin JOIN hbos USING (row_id)), {_metrics('s', 'one')}
        SELECT p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(auc, 6) AS auc, round(ap, 6) AS ap
        FROM totals JOIN auc USING (one) JOIN ap USING (one)""",
    "bench_exact": f"""WITH {THIN_SPLIT}, {_hbos('train', 'spl')}, {_lof('train', 'spl')}, {_kde('train', 'spl')},
        sco AS (SELECT model, split, y, d.score FROM spl JOIN (SELECT 'HBOS' AS model, row_id, score FROM hbos
          UNION ALL SELECT 'LOF', row_id, score FROM lof UNION ALL SELECT 'KDE', row_id, score FROM kde) d
          USING (row_id)),
        sets AS (SELECT concat(model, '/', split) AS part, y, score FROM sco), {_metrics('sets', 'part')},
        m AS (SELECT split_part(part, '/', 1) AS model, split_part(part, '/', 2) AS split, auc, ap, p + n AS size
          FROM totals JOIN auc USING (part) JOIN ap USING (part))
        SELECT 'run-exact' AS run_id, model, 'embeddings' AS dataset, CAST(NULL AS DOUBLE) AS contamination,
          CAST(0 AS INTEGER) AS round, CAST(0 AS INTEGER) AS n_known_outliers,
          CAST(max(size) FILTER (split = 'train') AS BIGINT) AS train_size,
          CAST(max(size) FILTER (split = 'test') AS BIGINT) AS test_size, CAST(NULL AS DOUBLE) AS train_auc_semi,
          round(max(auc) FILTER (split = 'train'), 6) AS train_auc,
          round(max(auc) FILTER (split = 'test'), 6) AS test_auc, CAST(0 AS DOUBLE) AS train_ap_semi,
          round(max(ap) FILTER (split = 'train'), 6) AS train_ap, round(max(ap) FILTER (split = 'test'), 6) AS test_ap
        FROM m GROUP BY model""",
    "score_histogram": f"""WITH {BINARY},
        s AS (SELECT CASE WHEN y = 0 THEN 'Normal' ELSE 'Anomaly' END AS label, vec[1] AS s FROM bin),
        e AS (SELECT min(s) AS low, (max(s) - min(s)) / 30 AS width FROM s),
        t AS (SELECT label, count(*) AS total FROM s GROUP BY label),
        c AS (SELECT label, CAST(least(floor((s - low) / width), 29) AS INTEGER) AS bin, count(*) AS n
          FROM s, e GROUP BY ALL)
        SELECT label, bin, round(low + bin * width, 6) AS lo, round(low + (bin + 1) * width, 6) AS hi, n,
          round(n / (total * width), 6) AS density FROM c JOIN t USING (label), e""",
    "score_density": f"""WITH {BINARY},
        s AS (SELECT CASE WHEN y = 0 THEN 'Normal' ELSE 'Anomaly' END AS label, vec[1] AS s FROM bin),
        t AS (SELECT label, count(*) AS n, min(s) AS lo, max(s) AS hi,
          stddev_samp(s) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS bw FROM s GROUP BY label),
        g AS (SELECT label, n, bw, point, lo + point * (hi - lo) / 199 AS x
          FROM t, (SELECT CAST(unnest(range(200)) AS INTEGER) AS point))
        SELECT label, point, round(any_value(x), 6) AS x,
          round(sum(exp(-0.5 * ((x - s) / bw) * ((x - s) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6)
            AS density
        FROM s JOIN g USING (label) GROUP BY label, point""",
    "curve_known": f"WITH {DOC}, {RES}, curve AS (SELECT * FROM res) {_curve('n_known_outliers')}",
    "curve_percent": f"""WITH {DOC}, {RES}, curve AS (SELECT *, round(100::DOUBLE * n_known_outliers / train_size, 6)
        AS labeled_percentage FROM res) {_curve('labeled_percentage')}""",
}
