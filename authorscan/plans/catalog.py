"""Registered queries: Spark builder + DuckDB twin + output types, per query.

Every query reads the driver tables (or data Spark derives from them) whole.
Stage outputs (LM tables, scored atoms, fold roles, grids, p-values) are shared
by the queries of one session through :class:`Corpus`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorscan.functions.text import cache_key, truncate_tokens
from authorscan.operators import corpus as C
from authorscan.operators import detect as D
from authorscan.operators import evaluate as E
from authorscan.operators import folds as FO
from authorscan.operators import lm as L
from authorscan.operators import survival as S
from authorscan.operators.scan import Acc, row_index, scan
from authorscan.params import Params
from authorscan.plans import oracle as O
from authorscan.session import checkpoint_dir, cut_lineage, note_stage, recorded_stages, remove_stages, tables_version
from authorscan.plans.experiments import HC_BUCKETS, Corpus, accuracy_run, context_scores, detect_folds, power_run
from authorscan.sources import articles as A
from authorscan.sources.cache import ScoreStore

PARAMS = Params()
RATIO = 0.15
FK = ["topic", "edit_ratio", "fold"]
DK = [*FK, "doc_id", "edited"]

_CORPORA: dict = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The stages shared by the queries of one session and state of the tables: changed tables make a new one."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    seen = tables_version(spark, sf_dir)
    if key not in _CORPORA or _CORPORA[key][0] != seen:
        _CORPORA[key] = (seen, Corpus(spark, sf_dir))
    return _CORPORA[key][1]


def _memo(c: Corpus, key, fn):
    return c._memo(key, fn)


def normalise(df: DataFrame, spec) -> DataFrame:
    cols = []
    for name, t in spec:
        if t == "double":
            cols.append(F.round(F.col(name).cast("double"), 6).alias(name))
        else:
            cols.append(F.col(name).cast(t).alias(name))
    return df.select(*cols)


@dataclass
class Query:
    name: str
    ids: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    spec: list


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, spec: list, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, ids, lambda spark, sf: normalise(fn(spark, sf), spec),
                               O.normalise(sql, spec) if sql else None, spec)
        return fn
    return deco


# ---------------------------------------------------------------- shared stages

def _atoms(c: Corpus, ratio=RATIO, max_sentences=None) -> DataFrame:
    settings = [C.Setting(v, ratio, max_sentences) for v in (0, 1)]
    return C.atoms_of(c.candidates(PARAMS), settings).withColumn("edit_ratio", F.lit(float(ratio)))


def _detect(c: Corpus) -> dict:
    return _memo(c, ("detect", RATIO), lambda: detect_folds(c, PARAMS, (RATIO,)))


def _scored(c: Corpus) -> DataFrame:
    """Scored atoms of both versions (narrow: no text)."""
    return _detect(c)["atoms"]


def _labelled(c: Corpus) -> DataFrame:
    return (c.table("documents").join(c.table("labels"), "doc_id")
            .select("doc_id", "lang", "n_chars", "quality", "toxic",
                    F.log(F.col("n_chars").cast("double")).alias("log_chars")))


SQL_BASE = [O.SENTENCES, O.FLAT]
SQL_LM = [*SQL_BASE, O.LM]
SQL_ATOMS = [*SQL_BASE, O.atoms_cte("atoms", RATIO)]
SQL_SCORED = [*SQL_LM, O.atoms_cte("atoms", RATIO), O.score_cte("ts", "atoms"),
              O.scored_cte("scored", "atoms")]
KS = "topic, edit_ratio, fold"
DKS = "topic, edit_ratio, fold, doc_id, edited"
SQL_DETECT = [
    *SQL_SCORED,
    f"arts AS (SELECT DISTINCT topic, {O.d(RATIO)} AS edit_ratio, doc_id FROM flat)",
    O.roles_cte("arts"),
    f"wr AS (SELECT s.*, {O.d(RATIO)} AS edit_ratio, r.fold, r.role FROM scored s JOIN roles r "
    f"ON r.topic = s.topic AND r.doc_id = s.doc_id)",
    "nul AS (SELECT topic, edit_ratio, fold, length, response AS x FROM wr "
    "WHERE role = 'null' AND edited = 0 AND response IS NOT NULL)",
    O.grid_cte("nul", KS),
    "docs AS (SELECT * FROM wr WHERE role <> 'null')",
    "pol AS (SELECT *, {0} AS eff_length, {1} AS comment FROM docs)".format(*O.policy_sql()),
    O.pvalue_cte("pv", "pol", KS, "gg.topic = j.topic AND gg.edit_ratio = j.edit_ratio AND gg.fold = j.fold"),
    O.tests_cte("pv", DKS),
    f"doclist AS (SELECT DISTINCT {DKS}, role FROM docs)",
    f"tests_all AS (SELECT doclist.*, coalesce(t.n_valid, 0) AS n_valid2, t.* EXCLUDE ({DKS}) "
    f"FROM doclist LEFT JOIN tests t USING ({DKS}))",
]


# ---------------------------------------------------------------- corpus

@register("sentence_atoms", "T1 T3 F1 W1",
          [("doc_id", "bigint"), ("pos", "bigint"), ("text", "string"), ("length", "bigint"), ("atom_no", "bigint")],
          O.with_(*SQL_BASE) + """
SELECT doc_id, pos, text, length, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS atom_no
FROM sentences WHERE length BETWEEN 10 AND 100""")
def q_sentence_atoms(spark, sf):
    s = corpus(spark, sf).sentences().filter(F.col("length").between(10, 100))
    return scan(s, ["doc_id"], ["pos"], [Acc("atom_no", "sum", F.lit(1), "upto")])


@register("cache_key", "T2", [("doc_id", "bigint"), ("pos", "bigint"), ("sent_key", "string")],
          O.with_(*SQL_BASE) + f"""
SELECT doc_id, pos, {O.strip("lower(trim(" + O.strip("regexp_replace(text, '\\\\[nrt]', '', 'g')") + ", ''''))")} AS sent_key
FROM sentences""")
def q_cache_key(spark, sf):
    return corpus(spark, sf).sentences().select("doc_id", "pos", cache_key("text").alias("sent_key"))


@register("truncate_tokens", "O5", [("doc_id", "bigint"), ("pos", "bigint"), ("length", "bigint"),
                                    ("truncated", "string"), ("truncated_length", "bigint")],
          O.with_(*SQL_BASE) + f"""
SELECT doc_id, pos, length, array_to_string({O.words('text')}[1:50], ' ') AS truncated,
       least(length, 50) AS truncated_length FROM sentences WHERE length > 50""")
def q_truncate_tokens(spark, sf):
    s = corpus(spark, sf).sentences().filter(F.col("length") > 50)
    return s.select("doc_id", "pos", "length", truncate_tokens("text", 50).alias("truncated"),
                    F.least(F.col("length"), F.lit(50)).alias("truncated_length"))


def _articles_nested(c: Corpus) -> DataFrame:
    return _memo(c, "nested", lambda: A.build_articles(c.flat_articles()))


SQL_NESTED_COUNTS = O.with_(*SQL_BASE) + """
SELECT topic, doc_id, count(*) AS n_sentences, count(alternative) AS n_alternatives,
       count(DISTINCT pos // 10) AS n_sub_titles FROM flat GROUP BY topic, doc_id"""


@register("article_counts", "A1 S1 T4", [("topic", "string"), ("doc_id", "bigint"), ("n_sentences", "bigint"),
                                        ("n_alternatives", "bigint"), ("n_sub_titles", "bigint")], SQL_NESTED_COUNTS)
def q_article_counts(spark, sf):
    # through the JSON form: build -> to_json -> from_json (the article file format)
    c = corpus(spark, sf)
    js = A.to_article_json(_articles_nested(c))
    parsed, _bad = A.parse_articles(js)
    return A.article_counts(parsed)


@register("article_files", "S1 S2 T4", [("topic", "string"), ("edit_ratio", "double"), ("article_index", "bigint"), ("title", "string"),
                                        ("n_sentences", "bigint"), ("n_alternatives", "bigint"), ("n_sub_titles", "bigint")],
          O.with_(*SQL_BASE) + f"""
SELECT topic, {O.d(RATIO)} AS edit_ratio, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS article_index,
       'doc ' || CAST(doc_id AS VARCHAR) AS title, count(*) AS n_sentences, count(alternative) AS n_alternatives,
       count(DISTINCT pos // 10) AS n_sub_titles FROM flat GROUP BY topic, doc_id""")
def q_article_files(spark, sf):
    """The articles written as files by topic and edit ratio, and read from them."""
    c = corpus(spark, sf)
    def build():
        path = f"{checkpoint_dir(spark).rstrip('/')}/stage-articles-{uuid.uuid4().hex}"
        articles = row_index(_articles_nested(c), ["topic"], ["doc_id"], "article_index").withColumn("edit_ratio", F.lit(RATIO))
        A.write_article_lines(articles, path)
        note_stage(path)
        return A.read_articles(spark, f"{path}/*/*", "lines", "jsonl")[0]
    files = _memo(c, "article_files", build).withColumn("title", F.col("article.title"))
    return A.article_counts(files, ("topic", "edit_ratio", "article_index", "title"))


@register("render_articles", "S16", [("topic", "string"), ("doc_id", "bigint"), ("text", "string")],
          O.with_(*SQL_BASE) + """,
lines AS (SELECT topic, doc_id, pos // 10 AS block, pos,
                 CASE WHEN alternative IS NOT NULL THEN alternative || chr(10) || sentence ELSE sentence END AS l
          FROM flat),
blocks AS (SELECT topic, doc_id, block,
                  chr(10) || '==part ' || CAST(block AS VARCHAR) || '==' || chr(10)
                  || string_agg(l, chr(10) ORDER BY pos) || chr(10) AS b
           FROM lines GROUP BY topic, doc_id, block)
SELECT topic, doc_id, 'doc ' || CAST(doc_id AS VARCHAR) || chr(10) || string_agg(b, '' ORDER BY block) AS text
FROM blocks GROUP BY topic, doc_id""")
def q_render_articles(spark, sf):
    return A.render_articles(_articles_nested(corpus(spark, sf)), edited=True)


ATOM_SPEC = [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"), ("kind", "bigint"),
             ("pos", "bigint"), ("atom_no", "bigint"), ("length", "bigint"), ("tag", "string")]


@register("edit_budget", "F1 F2 W1 W2 U4 F12", ATOM_SPEC,
          O.with_(*SQL_ATOMS) + "\nSELECT topic, doc_id, edited, kind, pos, atom_no, length, tag FROM atoms")
def q_edit_budget(spark, sf):
    return _atoms(corpus(spark, sf))


@register("atom_counts", "A11", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                 ("n_atoms", "bigint"), ("n_edits", "bigint"), ("edit_rate", "double")],
          O.with_(*SQL_ATOMS) + """
SELECT topic, doc_id, edited, count(*) AS n_atoms, sum(CASE WHEN tag = '<edit>' THEN 1 ELSE 0 END) AS n_edits,
       avg(CASE WHEN tag = '<edit>' THEN 1.0 ELSE 0.0 END) AS edit_rate FROM atoms GROUP BY topic, doc_id, edited""")
def q_atom_counts(spark, sf):
    return C.atoms_per_document(_atoms(corpus(spark, sf)))


@register("fixed_length_docs", "F5 W3", ATOM_SPEC,
          O.with_(*SQL_BASE, O.atoms_cte("atoms", 0.2, 50))
          + "\nSELECT topic, doc_id, edited, kind, pos, atom_no, length, tag FROM atoms")
def q_fixed_length_docs(spark, sf):
    return _atoms(corpus(spark, sf), 0.2, 50)


@register("prev_context", "W9", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                  ("atom_no", "bigint"), ("context", "string")],
          O.with_(*SQL_ATOMS) + """
SELECT topic, doc_id, edited, atom_no,
       lag(text) OVER (PARTITION BY topic, doc_id, edited ORDER BY atom_no) AS context FROM atoms""")
def q_prev_context(spark, sf):
    a = _atoms(corpus(spark, sf)).select("topic", "doc_id", "edited", "atom_no", "text")
    return C.previous_context(a, ("topic", "doc_id", "edited"), "atom_no")


@register("tag_spans", "T6 T7 W10 F14", [("topic", "string"), ("doc_id", "bigint"), ("piece_no", "bigint"),
                                          ("text", "string"), ("tag", "string")],
          O.with_(*SQL_BASE) + f""",
lines AS (SELECT topic, doc_id, pos // 10 AS block, pos,
                 CASE WHEN alternative IS NOT NULL THEN '<edit>' || alternative || '</edit>' || chr(10) || sentence
                      ELSE sentence END AS l FROM flat),
blocks AS (SELECT topic, doc_id, block, chr(10) || '==part ' || CAST(block AS VARCHAR) || '==' || chr(10)
                  || string_agg(l, chr(10) ORDER BY pos) || chr(10) AS b FROM lines GROUP BY topic, doc_id, block),
docs AS (SELECT topic, doc_id, 'doc ' || CAST(doc_id AS VARCHAR) || chr(10) || string_agg(b, '' ORDER BY block) AS text
         FROM blocks GROUP BY topic, doc_id),
toks AS (SELECT topic, doc_id, unnest(tk) AS tok, unnest(range(len(tk))) AS piece_no
         FROM (SELECT topic, doc_id, regexp_extract_all(text, '</?edit>|[^<]+|<') AS tk FROM docs)),
st AS (SELECT *, CASE WHEN tok = '<edit>' THEN 1 WHEN tok = '</edit>' THEN -1 ELSE 0 END AS dlt FROM toks),
st2 AS (SELECT *, sum(dlt) OVER (PARTITION BY topic, doc_id ORDER BY piece_no) AS state,
               sum(dlt) OVER (PARTITION BY topic, doc_id) AS final FROM st),
bad AS (SELECT DISTINCT topic, doc_id FROM st2 WHERE state < 0 OR state > 1 OR final <> 0)
SELECT topic, doc_id, piece_no, {O.strip('tok')} AS text, CASE WHEN state = 1 THEN '<edit>' END AS tag
FROM st2 WHERE dlt = 0 AND length({O.strip('tok')}) >= 3
  AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.topic = st2.topic AND bad.doc_id = st2.doc_id)""")
def q_tag_spans(spark, sf):
    c = corpus(spark, sf)
    txt = A.render_articles(_articles_nested(c), edited=True, tag_edits=True)
    spans, _quarantine = C.tag_spans(txt, ("topic", "doc_id"))
    return spans


@register("pair_long", "S7 S8 S9", [("id", "bigint"), ("author", "string"), ("text", "string")],
          """
WITH pairs AS (SELECT u.conv_id, u.turn, u.text AS human_text, a.text AS machine_text
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
               WHERE u.role = 'user' AND a.role = 'assistant'),
ided AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS id FROM pairs)
SELECT id, 'human' AS author, human_text AS text FROM ided
UNION ALL SELECT id, 'machine', machine_text FROM ided""")
def q_pair_long(spark, sf):
    from authorscan.sources.pairs import conversation_pairs, pairs_long
    return pairs_long(conversation_pairs(corpus(spark, sf).table("conversations")))


@register("pair_registry", "S8 S9 O3", [("name", "string"), ("form", "string"), ("id", "bigint"), ("shuffle_rank", "bigint"), ("human_text", "string"),
                                        ("machine_text", "string")],
          """
WITH pairs AS (SELECT u.conv_id, u.turn, u.text AS human_text, a.text AS machine_text, CASE WHEN u.conv_id % 5 = 0 THEN 'evaluation' ELSE 'train' END AS split
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
               WHERE u.role = 'user' AND a.role = 'assistant'),
one AS (SELECT name, 'split' AS form, row_number() OVER (PARTITION BY name ORDER BY conv_id, turn) - 1 AS id, human_text, machine_text
        FROM pairs JOIN (VALUES ('wiki-intro', 'train'), ('wikibio', 'evaluation')) r(name, split) USING (split))
SELECT name, form, id, row_number() OVER (PARTITION BY name ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) - 1 AS shuffle_rank, human_text, machine_text FROM one
UNION ALL SELECT 'news-long', 'long', NULL, NULL, human_text, machine_text FROM pairs
WHERE len(list_filter(regexp_extract_all(machine_text, '[^.!?\\n]+[.!?]*'), lambda q: regexp_matches(q, '[^ \\t\\n\\f\\r]'))) >= 15""")
def q_pair_registry(spark, sf):
    """Three registered datasets (two splits with ids and seeded shuffle, one long form) over the pairs of ``conversations``."""
    from authorscan.sources.pairs import PAIR_REGISTRY, conversation_pairs, load_registered
    base = (conversation_pairs(corpus(spark, sf).table("conversations")).drop("id")
            .withColumn("split", F.when(F.col("conv_id") % 5 == 0, "evaluation").otherwise("train")))
    out = []
    for name, form in (("wiki-intro", "split"), ("wikibio", "split"), ("news-long", "long")):
        machine, human, _ = PAIR_REGISTRY[name]
        df = load_registered(base.withColumnsRenamed({"machine_text": machine, "human_text": human}), name, long_form=form == "long",
                             shuffle=form != "long", order=["conv_id", "turn"])
        none = {c: F.lit(None).cast("long") for c in ("id", "shuffle_rank") if c not in df.columns}
        out.append(df.withColumns({"name": F.lit(name), "form": F.lit(form), **none}).select("name", "form", "id", "shuffle_rank", "human_text", "machine_text"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- language model

@register("ngram_counts", "M1", [("model", "string"), ("u", "string"), ("w", "string"), ("c_uw", "bigint"),
                                 ("c_u", "bigint"), ("c_w", "bigint"), ("p_w_given_u", "double")],
          O.with_(*SQL_LM) + f"""
SELECT b.model, b.u, b.w, b.c_uw, pr.c_u, un.c_w,
       (b.c_uw + {O.d(5.0)} * (un.c_w + {O.d(1.0)}) / nv.denom) / (pr.c_u + {O.d(5.0)}) AS p_w_given_u
FROM big b JOIN pre pr USING (model, u) JOIN uni un USING (model, w) JOIN nv USING (model)""")
def q_ngram_counts(spark, sf):
    return L.ngram_counts(corpus(spark, sf).lm())


@register("ngram_logloss", "M1 M3", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                     ("atom_no", "bigint"), ("kind", "bigint"), ("response", "double")],
          O.with_(*SQL_SCORED) + "\nSELECT topic, doc_id, edited, atom_no, kind, response FROM scored")
def q_ngram_logloss(spark, sf):
    return _scored(corpus(spark, sf))


@register("truncate_logloss", "O5 M1 F8", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"), ("atom_no", "bigint"),
                                           ("length", "bigint"), ("eff_length", "bigint"), ("comment", "string"), ("response", "double")],
          O.with_(*SQL_LM, O.atoms_cte("whole", RATIO),
                  f"atoms AS (SELECT * REPLACE (CASE WHEN length > 50 THEN array_to_string({O.words('text')}[1:50], ' ') ELSE text END AS text) FROM whole)",
                  O.score_cte("ts", "atoms"), O.scored_cte("scored", "atoms"))
          + "\nSELECT topic, doc_id, edited, atom_no, length, {0} AS eff_length, {1} AS comment, response FROM scored".format(*O.policy_sql(policy="truncate")))
def q_truncate_logloss(spark, sf):
    """The ``truncate`` policy: a long sentence is cut before it is scored."""
    c, p = corpus(spark, sf), PARAMS.with_(length_policy="truncate")
    return D.apply_length_policy(_memo(c, "detect_truncate", lambda: detect_folds(c, p, (RATIO,)))["atoms"], p)


@register("context_logloss", "M1 W9", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"), ("atom_no", "bigint"), ("response", "double")],
          O.with_(*SQL_LM, O.atoms_cte("atoms", RATIO), """ctx AS (SELECT topic, doc_id, edited, atom_no, model, text,
       lag(text) OVER (PARTITION BY topic, doc_id, edited ORDER BY atom_no) AS context FROM atoms JOIN docmodel USING (doc_id))""",
                  f"""cpair AS (SELECT topic, doc_id, edited, atom_no, model, unnest(t[1:len(t) - 1]) AS u, unnest(t[2:len(t)]) AS w FROM (
    SELECT * EXCLUDE (text, context), CASE WHEN context IS NULL THEN {O.lm_tokens('text')}
        ELSE list_concat(list_slice({O.lm_tokens('context')}, -1, -1), {O.lm_tokens('text')}) END AS t
    FROM ctx) WHERE len(t) >= 2)""",
                  f"""cnll AS (SELECT topic, doc_id, edited, atom_no, round(avg(-ln((coalesce(b.c_uw, 0) + {O.d(5.0)} * ((coalesce(un.c_w, 0) + {O.d(1.0)})
        / coalesce(nv.denom, {O.d(1.0)}))) / (coalesce(pr.c_u, 0) + {O.d(5.0)}))), 9) AS response
    FROM cpair p LEFT JOIN big b USING (model, u, w) LEFT JOIN pre pr USING (model, u) LEFT JOIN uni un USING (model, w) LEFT JOIN nv USING (model)
    GROUP BY topic, doc_id, edited, atom_no)""")
          + "\nSELECT a.topic, a.doc_id, a.edited, a.atom_no, n.response FROM atoms a LEFT JOIN cnll n USING (topic, doc_id, edited, atom_no)")
def q_context_logloss(spark, sf):
    """Each atom scored after the previous one of its document (conditioned on, not scored)."""
    return context_scores(corpus(spark, sf), PARAMS, [C.Setting(v, RATIO) for v in (0, 1)])


def _cache_table(c: Corpus) -> DataFrame:
    """Score cache: bigram responses of the sentences that more than one document has (the least, if models differ)."""
    def build():
        s = c.sentences()
        # a repeated text's id decides; the texts themselves are not grouped
        ided = s.select("doc_id", "model", "text", F.unhex(F.md5("text")).alias("_id"))
        shared = (ided.groupBy("_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                  .filter(F.col("a") < F.col("b")).select("_id"))
        sc = L.score_bigram(ided.join(shared, "_id", "left_semi").select("model", "text").distinct(), c.lm())
        return (sc.filter(F.col("response").isNotNull()).withColumn("sent_key", cache_key("text"))
                .groupBy("sent_key").agg(F.min("response").alias("response")))
    return _memo(c, "cache", build)


SQL_KEY = O.strip("lower(trim(" + O.strip("regexp_replace(text, '\\\\[nrt]', '', 'g')") + ", ''''))")
SQL_CACHE = [*SQL_SCORED, "shared AS (SELECT md5(text) AS tid FROM sentences GROUP BY 1 HAVING min(doc_id) < max(doc_id))",
             "trs AS (SELECT * FROM sentences WHERE md5(text) IN (SELECT tid FROM shared))",
             O.score_cte("cs", "trs"),
             f"cache AS (SELECT {SQL_KEY} AS sent_key, min(response) AS response FROM cs JOIN cs_tok USING (tid, model) "
             "WHERE response IS NOT NULL GROUP BY 1)",
             f"keyed AS (SELECT *, {SQL_KEY} AS sent_key FROM scored)"]


@register("cache_lookup", "J1", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                 ("atom_no", "bigint"), ("from_cache", "boolean"), ("response", "double")],
          O.with_(*SQL_CACHE) + """
SELECT a.topic, a.doc_id, a.edited, a.atom_no, c.response IS NOT NULL AS from_cache,
       coalesce(c.response, a.response) AS response
FROM keyed a LEFT JOIN cache c USING (sent_key)""")
def q_cache_lookup(spark, sf):
    c = corpus(spark, sf)
    atoms = _atoms(c).select("topic", "doc_id", "model", "edited", "atom_no", "text")
    cache = _cache_table(c)
    return L.with_cache(atoms, cache, lambda df: L.score_bigram(df, c.lm()))


@register("cache_misses", "J1", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                 ("atom_no", "bigint"), ("sent_key", "string")],
          O.with_(*SQL_CACHE) + """
SELECT a.topic, a.doc_id, a.edited, a.atom_no, a.sent_key FROM keyed a
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.sent_key = a.sent_key)""")
def q_cache_misses(spark, sf):
    c = corpus(spark, sf)
    return L.cache_misses(_atoms(c), _cache_table(c))


@register("score_store", "S6 J1 M3", [("doc_id", "bigint"), ("pos", "bigint"), ("response", "double")],
          O.with_(*SQL_LM, O.score_cte("cs", "sentences"), f"""keys AS (SELECT doc_id, pos, text, m.model, {SQL_KEY} AS sent_key, cs.response
    FROM sentences JOIN docmodel m USING (doc_id) LEFT JOIN cs ON cs.tid = md5(text) AND cs.model = m.model)""",
                  """kept AS (SELECT sent_key, response, row_number() OVER (PARTITION BY sent_key ORDER BY doc_id % 2, text, model) AS r FROM keys)""")
          + "\nSELECT k.doc_id, k.pos, s.response FROM keys k JOIN kept s ON s.sent_key = k.sent_key AND s.r = 1")
def q_score_store(spark, sf):
    """A store that grows: a first run scores the sentences of the even documents, a second those that the store lacks."""
    c = corpus(spark, sf)
    def build():
        path = f"{checkpoint_dir(spark).rstrip('/')}/stage-scores-{uuid.uuid4().hex}"
        store, s = ScoreStore(spark, path), c.sentences().select("doc_id", "model", "pos", "text")
        note_stage(path)
        scorer = lambda df: L.score_bigram(df, c.lm(), keep=["sent_key"])
        c.lm()
        for run, rows in (("first", s.filter(F.col("doc_id") % 2 == 0)), ("second", s)):
            with recorded_stages() as passing:
                out = store.score(rows, scorer, run, carry=("model",))
            remove_stages(spark, passing)
        return out
    return _memo(c, "score_store", build)


# ---------------------------------------------------------------- survival / p-values

@register("null_survival", "F3 A2 T8", [("length", "bigint"), ("x", "double"), ("cnt", "bigint"),
                                        ("n", "bigint"), ("surv", "double"), ("z", "double")],
          O.with_(*SQL_SCORED) + """,
nul AS (SELECT length, response AS x FROM scored WHERE edited = 0 AND response IS NOT NULL),
vc AS (SELECT length, x, count(*) AS cnt FROM nul GROUP BY length, x),
s AS (SELECT *, sum(cnt) OVER (PARTITION BY length ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ge,
             sum(cnt) OVER (PARTITION BY length) AS n FROM vc)
SELECT length, x, cnt, n, ge / n AS surv, -ln(ge / n) AS z FROM s""")
def q_null_survival(spark, sf):
    sc = _scored(corpus(spark, sf)).filter(F.col("edited") == 0)
    return S.survival_1d(S.null_sample(sc), ["length"])


@register("null_grid", "A3 A4 A29 F10 F11", [("topic", "string"), ("edit_ratio", "double"), ("fold", "bigint"),
                                            ("length", "bigint"), ("g", "bigint"), ("xg", "double"), ("z", "double")],
          O.with_(*SQL_DETECT) + f"\nSELECT {KS}, length, g, xg, z FROM grid")
def q_null_grid(spark, sf):
    return _detect(corpus(spark, sf))["grid"].withColumn("edit_ratio", F.lit(RATIO))


SQL_LINEAR = [x.replace(O.grid_cte("nul", KS), O.grid_cte("nul", KS, log=False)).replace("exp(-zi)", "zi") for x in SQL_DETECT[:-3]]


@register("linear_pvalue", "A3 J2", [("topic", "string"), ("edit_ratio", "double"), ("fold", "bigint"), ("doc_id", "bigint"), ("edited", "bigint"),
                                     ("atom_no", "bigint"), ("pvalue", "double")],
          O.with_(*SQL_LINEAR) + f"\nSELECT {DKS}, atom_no, pvalue FROM pv")
def q_linear_pvalue(spark, sf):
    """P-values from grids in linear space (S itself is interpolated)."""
    c, p = corpus(spark, sf), PARAMS.with_(log_space=False)
    d = _detect(c)

    def build():
        docs, counts, roles = d["docs_report"].select(*DK, "atom_no", "length", "response"), d["null_counts"], d["segments"][1]
        with recorded_stages() as passing:
            grid = cut_lineage(S.fit_fold_grids(counts, roles, p))
        out = d["in_rounds"](lambda own: D.sentence_pvalues(docs.filter(own), grid, p, ["topic", "fold"]).select(*DK, "atom_no", "pvalue"))
        remove_stages(spark, passing)
        return out
    return _memo(c, ("linear", RATIO), build)


PV_SPEC = [("topic", "string"), ("edit_ratio", "double"), ("fold", "bigint"), ("doc_id", "bigint"),
           ("edited", "bigint"), ("atom_no", "bigint"), ("eff_length", "bigint"), ("comment", "string"),
           ("pvalue", "double")]


@register("grid_pvalue", "J2 M6 P2 F8 F9", PV_SPEC,
          O.with_(*SQL_DETECT) + f"\nSELECT {DKS}, atom_no, eff_length, comment, pvalue FROM pv")
def q_grid_pvalue(spark, sf):
    return _detect(corpus(spark, sf))["pvalues_report"]


@register("exact_pvalue", "J3", PV_SPEC, O.with_(*SQL_DETECT) + f""",
ev AS (SELECT d.*,
         (SELECT max(n.x) FROM nul n WHERE n.topic = d.topic AND n.fold = d.fold AND n.length = d.eff_length
                                        AND n.x <= d.response) AS xlo,
         (SELECT min(n.x) FROM nul n WHERE n.topic = d.topic AND n.fold = d.fold AND n.length = d.eff_length
                                        AND n.x > d.response) AS xhi,
         (SELECT count(*) FROM nul n WHERE n.topic = d.topic AND n.fold = d.fold AND n.length = d.eff_length
                                        AND n.x > d.response) AS above,
         (SELECT count(*) FROM nul n WHERE n.topic = d.topic AND n.fold = d.fold AND n.length = d.eff_length) AS nn
       FROM pol d WHERE d.eff_length IS NOT NULL AND d.response IS NOT NULL),
ev2 AS (SELECT ev.*, (SELECT count(*) FROM nul n WHERE n.topic = ev.topic AND n.fold = ev.fold
                       AND n.length = ev.eff_length AND n.x = ev.xlo) AS cmlo FROM ev),
ez AS (SELECT *, CASE WHEN nn = 0 THEN NULL WHEN xlo IS NULL THEN {O.d(0)} WHEN xhi IS NULL THEN ln(CAST(nn AS DOUBLE))
                      ELSE ((-ln(above / nn)) - (-ln((above + cmlo) / nn))) / (xhi - xlo) * (response - xlo)
                           + (-ln((above + cmlo) / nn)) END AS zz FROM ev2)
SELECT p.topic, p.edit_ratio, p.fold, p.doc_id, p.edited, p.atom_no, p.eff_length, p.comment,
       CASE WHEN ez.zz IS NOT NULL THEN least({O.d(1.0)}, exp(-ez.zz)) END AS pvalue
FROM pol p LEFT JOIN ez USING (topic, edit_ratio, fold, doc_id, edited, atom_no)""")
def q_exact_pvalue(spark, sf):
    c = corpus(spark, sf)
    d = _detect(c)

    def build():
        docs, null = d["docs_report"].select(*DK, "atom_no", "length", "response"), d["null"]

        def step(own):  # the comments follow from the rows and aren't dealt
            pol = D.apply_length_policy(docs.filter(own), PARAMS).drop("comment")
            pv = S.exact_pvalue(pol, null.filter(own), ["topic", "fold"], "eff_length", "response", ("doc_id", "edited", "atom_no"))
            return D.apply_length_policy(pv, PARAMS).select(*DK, "atom_no", "eff_length", "comment", "pvalue")
        return d["in_rounds"](step, by_fold=True)
    return _memo(c, ("exact", RATIO), build)


def _policy_sql_union() -> str:
    parts = []
    for pol in ("truncate", "ignore", "max_available"):
        eff, com = O.policy_sql(policy=pol)
        parts.append(f"SELECT '{pol}' AS policy, doc_id, pos, length, {eff} AS eff_length, {com} AS comment "
                     "FROM sc")
    return "\nUNION ALL\n".join(parts)


@register("length_policy", "F8 F9", [("policy", "string"), ("doc_id", "bigint"), ("pos", "bigint"),
                                     ("length", "bigint"), ("eff_length", "bigint"), ("comment", "string")],
          O.with_(*SQL_LM, O.score_cte("ts", "sentences"), O.scored_cte("sc", "sentences")) + "\n" + _policy_sql_union())
def q_length_policy(spark, sf):
    c = corpus(spark, sf)
    sc = c.scored_sentences()
    outs = [D.apply_length_policy(sc, PARAMS.with_(length_policy=p)).withColumn("policy", F.lit(p))
            for p in ("truncate", "ignore", "max_available")]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@register("first_sentence", "F6", [("topic", "string"), ("doc_id", "bigint"), ("edited", "bigint"),
                                   ("atom_no", "bigint"), ("eff_length", "bigint"), ("comment", "string")],
          O.with_(*SQL_SCORED) + """,
pol AS (SELECT *, {0} AS eff0, {1} AS com0, min(atom_no) OVER (PARTITION BY topic, doc_id, edited) AS first FROM scored)
SELECT topic, doc_id, edited, atom_no, CASE WHEN atom_no = first THEN NULL ELSE eff0 END AS eff_length,
       CASE WHEN atom_no = first THEN 'ignored (first sentence)' ELSE com0 END AS comment FROM pol""".format(
              *O.policy_sql()))
def q_first_sentence(spark, sf):
    sc = _scored(corpus(spark, sf))
    return D.apply_length_policy(sc, PARAMS.with_(ignore_first_sentence=True),
                                 doc_keys=("topic", "doc_id", "edited"))


# ---------------------------------------------------------------- document tests

DOC_SPEC = [("topic", "string"), ("edit_ratio", "double"), ("fold", "bigint"), ("doc_id", "bigint"),
            ("edited", "bigint")]


@register("doc_hc", "F4 A5 A6 A10 W11 M4 Q1", [*DOC_SPEC, ("n_valid", "bigint"), ("HC", "double"),
                                                 ("hc_threshold", "double")],
          O.with_(*SQL_DETECT) + f"\nSELECT {DKS}, n_valid2 AS n_valid, HC, hc_threshold FROM tests_all")
def q_doc_hc(spark, sf):
    return _detect(corpus(spark, sf))["tests_report"]


@register("doc_fisher", "A7", [*DOC_SPEC, ("fisher", "double"), ("fisher_pvalue", "double")],
          O.with_(*SQL_DETECT) + f"\nSELECT {DKS}, fisher, fisher_pvalue FROM tests_all")
def q_doc_fisher(spark, sf):
    return _detect(corpus(spark, sf))["tests_report"]


@register("doc_minp_bonf", "A8 A9", [*DOC_SPEC, ("minP", "double"), ("bonf", "double")],
          O.with_(*SQL_DETECT) + f"\nSELECT {DKS}, minP, bonf FROM tests_all")
def q_doc_minp_bonf(spark, sf):
    return _detect(corpus(spark, sf))["tests_report"]


@register("doc_hc_mask", "W12", [*DOC_SPEC, ("atom_no", "bigint"), ("pvalue", "double"), ("mask", "boolean")],
          O.with_(*SQL_DETECT) + f"""
SELECT pv.topic, pv.edit_ratio, pv.fold, pv.doc_id, pv.edited, pv.atom_no, pv.pvalue,
       CASE WHEN pv.pvalue IS NOT NULL AND t.hc_threshold IS NOT NULL THEN pv.pvalue <= t.hc_threshold END AS mask
FROM pv LEFT JOIN tests t USING ({DKS})""")
def q_doc_hc_mask(spark, sf):
    c = corpus(spark, sf)
    d = _detect(c)

    def build():
        masked = d["masked_report"].select(*DK, "atom_no", "pvalue", "mask")
        return d["in_rounds"](lambda own: masked.filter(own))
    return _memo(c, ("mask", RATIO), build)


@register("doc_top_sentences", "O6", [*DOC_SPEC, ("atom_no", "bigint"), ("pvalue", "double"), ("rank", "bigint")],
          O.with_(*SQL_DETECT) + f""",
rk AS (SELECT {DKS}, atom_no, pvalue, row_number() OVER (PARTITION BY {DKS} ORDER BY pvalue, atom_no) AS rank
       FROM pv WHERE pvalue IS NOT NULL)
SELECT * FROM rk WHERE rank <= 3""")
def q_doc_top_sentences(spark, sf):
    c = corpus(spark, sf)
    d = _detect(c)

    def build():
        pv, keys = d["pvalues_report"].select(*DK, "atom_no", "pvalue"), [k for k in DK if k != "edit_ratio"]  # one ratio
        top = d["in_rounds"](lambda own: D.top_sentences(pv.filter(own).drop("edit_ratio"), keys, 3))
        return top.withColumn("edit_ratio", F.lit(RATIO))
    return _memo(c, ("top", RATIO), build)


@register("doc_precision_recall", "A12 A11", [*DOC_SPEC, ("edit_rate", "double"), ("precision", "double"),
                                              ("recall", "double")],
          O.with_(*SQL_DETECT) + f""",
mk AS (SELECT pv.*, coalesce(pv.pvalue IS NOT NULL AND t.hc_threshold IS NOT NULL AND pv.pvalue <= t.hc_threshold,
                             false) AS m FROM pv LEFT JOIN tests t USING ({DKS})),
agg AS (SELECT {DKS}, sum(CASE WHEN m AND tag = '<edit>' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN m THEN 1 ELSE 0 END) AS mm,
               sum(CASE WHEN tag = '<edit>' THEN 1 ELSE 0 END) AS ee,
               avg(CASE WHEN tag = '<edit>' THEN 1.0 ELSE 0.0 END) AS edit_rate FROM mk GROUP BY {DKS})
SELECT {DKS}, edit_rate, CASE WHEN mm > 0 THEN tp / mm END AS precision,
       CASE WHEN ee > 0 THEN tp / ee END AS recall FROM agg""")
def q_doc_precision_recall(spark, sf):
    return _detect(corpus(spark, sf))["marks_report"]


@register("doc_stats_responses", "M5 P4", [("doc_id", "bigint"), ("n_valid", "bigint"), ("HC", "double"),
                                           ("hc_threshold", "double"), ("fisher", "double"),
                                           ("fisher_pvalue", "double"), ("minP", "double"), ("bonf", "double")],
          O.with_(*SQL_LM, O.score_cte("ts", "sentences"), O.scored_cte("sc0", "sentences"),
                  "sc AS (SELECT *, doc_id % 2 AS _k FROM sc0)",
                  "nul AS (SELECT 1 - _k AS _k, length, response AS x FROM sc WHERE length BETWEEN 10 AND 100 "
                  "AND response IS NOT NULL AND NOT isnan(response))",
                  O.grid_cte("nul", "_k"),
                  "pol AS (SELECT *, {0} AS eff_length, {1} AS comment FROM sc)".format(*O.policy_sql()),
                  O.pvalue_cte("pv", "pol", "_k", "gg._k = j._k"),
                  O.tests_cte("pv", "doc_id"))
          + "\nSELECT doc_id, n_valid, HC, hc_threshold, fisher, fisher_pvalue, minP, bonf FROM tests")
def q_doc_stats_responses(spark, sf):
    """M5: tests straight from (document, length, response) rows. Cross-fitted: the null
    of an even document comes from the odd ones and the other way round, so every
    sentence of every document is tested, and none against itself."""
    c = corpus(spark, sf)
    sc = c.scored_sentences().withColumn("_k", F.col("doc_id") % 2)
    null = S.null_sample(sc.filter(F.col("length").between(10, 100)).withColumn("_k", 1 - F.col("_k")), ["_k"])
    grid = S.fit_null_grid(null, PARAMS, ["_k"])
    pv = D.sentence_pvalues(sc, grid, PARAMS, ["_k"])
    return D.document_tests(pv, ["doc_id"], PARAMS)


@register("event_windows", "X2 P4 M5", [("window_start", "string"), ("user_id", "bigint"), ("n_valid", "bigint"), ("HC", "double"),
                                        ("hc_threshold", "double"), ("fisher", "double"), ("fisher_pvalue", "double"), ("minP", "double"), ("bonf", "double")],
          O.with_("ev AS (SELECT ts, user_id, event_type, user_id % 2 AS half, CAST(1 AS INTEGER) AS eff_length, value AS response FROM events)",
                  "nul AS (SELECT 1 - user_id % 2 AS half, event_type, CAST(1 AS INTEGER) AS length, value AS x FROM events "
                  "WHERE value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL)",
                  O.grid_cte("nul", "half, event_type"),
                  O.pvalue_cte("pw", "ev", "half, event_type", "gg.half = j.half AND gg.event_type = j.event_type"),
                  "pe AS (SELECT date_trunc('day', ts) AS window_start, user_id, round(pvalue, 9) AS pvalue FROM pw WHERE pvalue IS NOT NULL)",
                  O.tests_cte("pe", "window_start, user_id"))
          + "\nSELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, n_valid, HC, hc_threshold, fisher, fisher_pvalue, minP, bonf FROM tests")
def q_event_windows(spark, sf):
    """The batch form of the event stream: every user's days, tested against the null of their event types."""
    from authorscan.streaming.event_windows import event_null_grid, event_pvalues, window_counts, window_tests
    events = corpus(spark, sf).table("events")
    pv = event_pvalues(events, event_null_grid(events, PARAMS))
    out = window_tests(window_counts(pv), PARAMS)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# ---------------------------------------------------------------- HC null

HCN_SIZES = HC_BUCKETS


def _bucket_sql(col: str) -> str:
    s = sorted(HCN_SIZES)
    expr = f"{s[-1]}"
    for a, b in reversed(list(zip(s, s[1:]))):
        expr = f"CASE WHEN {col} <= {O.d((a + b) / 2.0)} THEN {a} ELSE {expr} END"
    return expr


SQL_HCN = [*SQL_DETECT, f"""hnull AS (SELECT {KS}, {_bucket_sql('t.n_valid2')} AS length, t.HC AS x
    FROM tests_all t WHERE t.edited = 0 AND t.role = 'calibration' AND t.HC IS NOT NULL)""",
           O.grid_cte("hnull", KS, 57, p="h", fill=False, xrange=(-1.0, 8.0))]


@register("hc_null", "A30 S15", [("topic", "string"), ("edit_ratio", "double"), ("fold", "bigint"),
                                 ("length", "bigint"), ("g", "bigint"), ("xg", "double"), ("z", "double")],
          O.with_(*SQL_HCN) + f"\nSELECT {KS}, length, g, xg, z FROM hgrid")
def q_hc_null(spark, sf):
    return _detect(corpus(spark, sf))["hc_null"].withColumn("edit_ratio", F.lit(RATIO))


def _hcp_sql(tested: str) -> list[str]:
    """HC p-values (``hp``) of the documents that ``tested`` selects."""
    return [*SQL_HCN, f"hpres AS (SELECT DISTINCT {KS}, length FROM hgrid)",
            f"tested AS ({tested})",
            f"hnear AS (SELECT {DKS}, arg_min(h.length, row(abs(h.length - t.n_valid2), h.length)) AS eff_length "
            f"FROM tested t JOIN hpres h USING ({KS}) GROUP BY {DKS})",
            f"hsrc AS (SELECT {DKS}, t.n_valid2 AS n_valid, t.HC, n.eff_length, t.HC AS response "
            f"FROM tested t LEFT JOIN hnear n USING ({DKS}))",
            O.pvalue_cte("hp", "hsrc", KS, "gg.topic = j.topic AND gg.edit_ratio = j.edit_ratio AND gg.fold = j.fold",
                         grid="hgrid")]


SQL_HCP = _hcp_sql("SELECT * FROM tests_all WHERE role = 'test'")  # the others make the null


@register("hc_pvalue", "J4", [*DOC_SPEC, ("n_valid", "bigint"), ("HC", "double"), ("HC_pvalue", "double")],
          O.with_(*_hcp_sql("SELECT * FROM tests_all")) + f"\nSELECT {DKS}, n_valid, HC, pvalue AS HC_pvalue FROM hp")
def q_hc_pvalue(spark, sf):
    """Every tested document's p-value, the calibration documents' too."""
    d = _detect(corpus(spark, sf))
    return D.hc_pvalue(d["tests_report"], d["hc_null"], ["topic", "fold"])


SQL_PR = [f"""mk AS (SELECT pv.*, coalesce(pv.pvalue IS NOT NULL AND t.hc_threshold IS NOT NULL AND pv.pvalue <= t.hc_threshold,
                             false) AS m FROM pv LEFT JOIN tests t USING ({DKS}))""",
          f"""agg AS (SELECT {DKS}, sum(CASE WHEN m AND tag = '<edit>' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN m THEN 1 ELSE 0 END) AS mm,
               sum(CASE WHEN tag = '<edit>' THEN 1 ELSE 0 END) AS ee,
               avg(CASE WHEN tag = '<edit>' THEN 1.0 ELSE 0.0 END) AS edit_rate FROM mk GROUP BY {DKS})"""]


@register("doc_scores", "S14 M9 J4 T13 A10 A11 A12", [
    *DOC_SPEC, ("role", "string"), ("name", "string"), ("model", "string"), ("n_valid", "bigint"), ("edit_rate", "double"), ("HC", "double"),
    ("HC_pvalue", "double"), ("precision", "double"), ("recall", "double"), ("fisher", "double"), ("fisher_pvalue", "double"), ("minP", "double")],
          O.with_(*SQL_HCP, *SQL_PR) + f"""
SELECT t.topic, t.edit_ratio, t.fold, t.doc_id, t.edited, t.role,
       'article_' || CAST(t.doc_id AS VARCHAR) || '_sentences_' || CASE WHEN t.edited = 1 THEN 'edited' ELSE 'original' END AS name, 'bigram' AS model,
       t.n_valid2 AS n_valid, agg.edit_rate, t.HC, hp.pvalue AS HC_pvalue, CASE WHEN mm > 0 THEN tp / mm END AS precision,
       CASE WHEN ee > 0 THEN tp / ee END AS recall, t.fisher, t.fisher_pvalue, t.minP
FROM tests_all t LEFT JOIN agg USING ({DKS}) LEFT JOIN hp USING ({DKS})""")
def q_doc_scores(spark, sf):
    return _detect(corpus(spark, sf))["doc_scores"]


# ---------------------------------------------------------------- folds

@register("fold_roles", "W4 W5 W6 J5", [("topic", "string"), ("edit_ratio", "double"), ("doc_id", "bigint"),
                                       ("fold", "bigint"), ("role", "string")],
          O.with_(*SQL_BASE, f"arts AS (SELECT DISTINCT topic, {O.d(RATIO)} AS edit_ratio, doc_id FROM flat)",
                  O.roles_cte("arts")) + "\nSELECT topic, edit_ratio, doc_id, fold, role FROM roles")
def q_fold_roles(spark, sf):
    return _detect(corpus(spark, sf))["roles"].withColumn("edit_ratio", F.lit(RATIO))


@register("shuffled_split", "W7 O3 O4", [("edited", "bigint"), ("vec_id", "bigint"), ("shuffle_rank", "bigint"),
                                         ("part", "string")],
          """
WITH e AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS edited FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY edited ORDER BY md5(CAST(vec_id AS VARCHAR) || '|555'), vec_id) - 1 AS rk,
             count(*) OVER (PARTITION BY edited) AS n FROM e)
SELECT edited, vec_id, rk AS shuffle_rank,
       CASE WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS part FROM r""")
def q_shuffled_split(spark, sf):
    e = corpus(spark, sf).table("embeddings").select(
        "vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("edited"))
    return FO.shuffled_split(e, ["edited"], "vec_id", 555, 0.8)


# ---------------------------------------------------------------- evaluation on labels

SQL_LAB = """labelled AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, ln(CAST(d.n_chars AS DOUBLE)) AS log_chars
    FROM documents d JOIN labels l USING (doc_id))"""


@register("binary_metrics", "A13 A14 A15 A16", [("lang", "string"), ("TP", "bigint"), ("FN", "bigint"),
                                                ("FP", "bigint"), ("TN", "bigint"), ("TPR", "double"),
                                                ("FPR", "double"), ("accuracy", "double")],
          O.with_(SQL_LAB, """pr AS (SELECT *, CASE WHEN n_chars >= avg(n_chars) OVER (PARTITION BY lang) THEN 1 ELSE 0 END
              AS pred FROM labelled)""") + """,
c AS (SELECT lang, count(*) FILTER (WHERE pred = 1 AND quality = 1) AS TP, count(*) FILTER (WHERE pred = 0 AND quality = 1) AS FN,
             count(*) FILTER (WHERE pred = 1 AND quality = 0) AS FP, count(*) FILTER (WHERE pred = 0 AND quality = 0) AS TN
      FROM pr GROUP BY lang)
SELECT lang, TP, FN, FP, TN, CASE WHEN TP + FN > 0 THEN TP / (TP + FN) END AS TPR,
       CASE WHEN FP + TN > 0 THEN FP / (FP + TN) END AS FPR, (TP + TN) / (TP + TN + FP + FN) AS accuracy FROM c""")
def q_binary_metrics(spark, sf):
    lab = _labelled(corpus(spark, sf))
    avg = lab.groupBy("lang").agg(F.avg("n_chars").alias("_avg"))
    pr = lab.join(avg, "lang").withColumn("pred", (F.col("n_chars") >= F.col("_avg")).cast("int"))
    return E.binary_metrics(pr, "quality", "pred", ["lang"])


def roc_sql(y: str, score: str) -> list:
    return [SQL_LAB, f"""rg AS (SELECT lang, {score} AS threshold, sum({y}) AS pos, sum(1 - {y}) AS neg
                        FROM labelled GROUP BY lang, {score})""",
            """rc AS (SELECT *, sum(pos) OVER wf AS tp, sum(neg) OVER wf AS fp,
                    coalesce(sum(pos) OVER wa, 0) AS tp_after, coalesce(sum(neg) OVER wa, 0) AS fp_after,
                    sum(pos) OVER (PARTITION BY lang) AS P, sum(neg) OVER (PARTITION BY lang) AS N FROM rg
             WINDOW wf AS (PARTITION BY lang ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                    wa AS (PARTITION BY lang ORDER BY threshold ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
            """roc AS (SELECT lang, threshold, tp, fp, CASE WHEN P > 0 THEN tp / P END AS tpr,
                      CASE WHEN N > 0 THEN fp / N END AS fpr, CASE WHEN P > 0 THEN tp_after / P END AS tpr_prev,
                      CASE WHEN N > 0 THEN fp_after / N END AS fpr_prev FROM rc
               UNION ALL SELECT DISTINCT lang, CAST('infinity' AS DOUBLE), 0, 0, 0, 0, 0, 0 FROM labelled)"""]


YOUDEN_SQL = "arg_max(threshold, row(coalesce(tpr - fpr, 0), threshold)) AS threshold_youden"


SQL_ROC = roc_sql("quality", "n_chars")


def _roc(spark, sf):
    c = corpus(spark, sf)
    return _memo(c, "roc_labels", lambda: E.roc_curve(_labelled(c), "quality", "n_chars", ["lang"]))


@register("roc", "A18", [("lang", "string"), ("threshold", "double"), ("tp", "bigint"), ("fp", "bigint"),
                         ("tpr", "double"), ("fpr", "double")],
          O.with_(*SQL_ROC) + "\nSELECT lang, threshold, tp, fp, tpr, fpr FROM roc")
def q_roc(spark, sf):
    return _roc(spark, sf)


@register("auc", "A19", [("lang", "string"), ("auc", "double")],
          O.with_(*SQL_ROC) + "\nSELECT lang, sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2) AS auc FROM roc GROUP BY lang")
def q_auc(spark, sf):
    return E.auc(_roc(spark, sf), ["lang"])


@register("youden", "A20", [("lang", "string"), ("threshold_youden", "double")],
          O.with_(*SQL_ROC) + f"\nSELECT lang, {YOUDEN_SQL} FROM roc GROUP BY lang")
def q_youden(spark, sf):
    return E.youden_threshold(_roc(spark, sf), ["lang"])


@register("fpr_cut", "A25", [("lang", "string"), ("threshold_fpr_cut", "double")],
          O.with_(*SQL_ROC) + "\nSELECT lang, min(threshold) AS threshold_fpr_cut FROM roc WHERE fpr <= 0.05 GROUP BY lang")
def q_fpr_cut(spark, sf):
    return E.fpr_cut_threshold(_roc(spark, sf), 0.05, ["lang"])


def _sweep_sql(y: str, score: str, step: float, max_fpr: float | None, out: str) -> str:
    s = O.d(step)
    j0 = f"floor(({score} - mn) / {s})"
    b = (f"least({j0} + CASE WHEN mn + ({j0} + 1) * {s} <= {score} THEN 1 ELSE 0 END "
         f"- CASE WHEN mn + {j0} * {s} > {score} THEN 1 ELSE 0 END, J - 1)")
    cond = f" AND fpr <= {O.d(max_fpr)}" if max_fpr is not None else ""
    return f"""
st AS (SELECT lang, min({score}) AS mn, max({score}) AS mx,
              CAST(ceil((max({score}) - min({score})) / {s}) AS INTEGER) AS J FROM labelled GROUP BY lang),
bk AS (SELECT l.lang, {b} AS b, l.{y} AS y FROM labelled l JOIN st USING (lang)),
cnt AS (SELECT lang, b, sum(y) AS pos, sum(1 - y) AS neg FROM bk GROUP BY lang, b),
tot AS (SELECT lang, sum(pos) AS P, sum(neg) AS N FROM cnt GROUP BY lang),
scaf AS (SELECT lang, mn, unnest(range(0, J)) AS b FROM st WHERE J > 0),
t AS (SELECT scaf.lang, scaf.mn, scaf.b, tot.P, tot.N,
             coalesce(sum(cnt.pos) OVER w, 0) AS TP, coalesce(sum(cnt.neg) OVER w, 0) AS FP
      FROM scaf LEFT JOIN cnt USING (lang, b) JOIN tot USING (lang)
      WINDOW w AS (PARTITION BY scaf.lang ORDER BY scaf.b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t2 AS (SELECT *, (TP + (N - FP)) / (P + N) AS acc, CASE WHEN N > 0 THEN FP / N END AS fpr FROM t),
best AS (SELECT lang, arg_max(mn + b * {s}, row(acc, -b)) AS th FROM t2 WHERE acc > 0{cond} GROUP BY lang)
SELECT st.lang, coalesce(best.th, st.mx) AS {out} FROM st LEFT JOIN best USING (lang)"""


@register("threshold_fpr", "A21 T10", [("lang", "string"), ("threshold", "double")],
          O.with_(SQL_LAB) + "," + _sweep_sql("toxic", "log_chars", 0.01, 0.05, "threshold"))
def q_threshold_fpr(spark, sf):
    return E.threshold_sweep(_labelled(corpus(spark, sf)), "toxic", "log_chars", ["lang"], 0.01, 0.05)


@register("threshold_acc", "A22 T10", [("lang", "string"), ("threshold", "double")],
          O.with_(SQL_LAB) + "," + _sweep_sql("toxic", "log_chars", 0.01, None, "threshold"))
def q_threshold_acc(spark, sf):
    return E.threshold_sweep(_labelled(corpus(spark, sf)), "toxic", "log_chars", ["lang"], 0.01, None)


@register("calibrate", "A23", [("lang", "string"), ("threshold_youden", "double"), ("auc", "double"),
                               ("threshold_fpr", "double"), ("threshold_acc", "double")],
          O.with_(*roc_sql("toxic", "log_chars")) + f"""
SELECT yd.lang, yd.threshold_youden, au.auc, tf.threshold_fpr, ta.threshold_acc FROM
  (SELECT lang, {YOUDEN_SQL} FROM roc GROUP BY lang) yd
  JOIN (SELECT lang, sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2) AS auc FROM roc GROUP BY lang) au USING (lang)
  JOIN (WITH """ + _sweep_sql("toxic", "log_chars", 0.01, 0.05, "threshold_fpr") + """) tf USING (lang)
  JOIN (WITH """ + _sweep_sql("toxic", "log_chars", 0.01, None, "threshold_acc") + """) ta USING (lang)""")
def q_calibrate(spark, sf):
    return E.calibrate(_labelled(corpus(spark, sf)), "toxic", "log_chars", ["lang"], 0.01, 0.05)


def _null_threshold_sql() -> str:
    s = O.d(0.1)
    x = "log_chars"
    j0 = f"(ceil(({x} - f) / {s}) - 1)"
    b = (f"least({j0} + CASE WHEN f + ({j0} + 1) * {s} < {x} THEN 1 ELSE 0 END "
         f"- CASE WHEN f + {j0} * {s} >= {x} THEN 1 ELSE 0 END, J - 1)")
    return f"""
nl AS (SELECT * FROM labelled WHERE quality = 1),
st AS (SELECT lang, CAST(floor(min({x})) AS DOUBLE) AS f, CAST(ceil(max({x})) AS DOUBLE) AS c, count(*) AS n,
              CAST(ceil((CAST(ceil(max({x})) AS DOUBLE) - CAST(floor(min({x})) AS DOUBLE)) / {s}) AS INTEGER) AS J
       FROM nl GROUP BY lang),
bk AS (SELECT nl.lang, {b} AS b FROM nl JOIN st USING (lang)),
cnt AS (SELECT lang, b, count(*) AS cnt FROM bk WHERE b >= 0 GROUP BY lang, b),
scaf AS (SELECT lang, f, n, unnest(range(0, J)) AS b FROM st WHERE J > 0),
t AS (SELECT scaf.*, coalesce(sum(cnt.cnt) OVER w, 0) AS FP FROM scaf LEFT JOIN cnt USING (lang, b)
      WINDOW w AS (PARTITION BY scaf.lang ORDER BY scaf.b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ok AS (SELECT lang, min(b) AS jb, any_value(f) AS f0 FROM t WHERE FP / n <= {O.d(0.05)} GROUP BY lang),
th AS (SELECT st.lang, coalesce(ok.f0 + ok.jb * {s}, {O.d(-1.0)}) AS threshold FROM st LEFT JOIN ok USING (lang))"""


@register("null_threshold", "A24", [("lang", "string"), ("threshold", "double")],
          O.with_(SQL_LAB) + "," + _null_threshold_sql() + "\nSELECT lang, threshold FROM th")
def q_null_threshold(spark, sf):
    lab = _labelled(corpus(spark, sf)).filter(F.col("quality") == 1)
    return E.null_threshold(lab, "log_chars", ["lang"], 0.1, 0.05)


@register("power_tpr", "J7 T12 A17", [("lang", "string"), ("TPR", "double"), ("accuracy", "double")],
          O.with_(SQL_LAB) + "," + _null_threshold_sql() + """
SELECT l.lang, avg(CASE WHEN l.log_chars > th.threshold THEN 1.0 ELSE 0.0 END) AS TPR,
       avg(CASE WHEN l.log_chars > th.threshold THEN 1.0 ELSE 0.0 END) AS accuracy
FROM labelled l JOIN th USING (lang) WHERE l.quality = 0 GROUP BY l.lang""")
def q_power_tpr(spark, sf):
    lab = _labelled(corpus(spark, sf))
    th = E.null_threshold(lab.filter(F.col("quality") == 1), "log_chars", ["lang"], 0.1, 0.05)
    pred = E.apply_threshold(lab.filter(F.col("quality") == 0), th, "log_chars", ["lang"], strict=True)
    return E.power_tpr(pred, ["lang"])


# ---------------------------------------------------------------- experiments

def detect_sql(ratios) -> list:
    """Detection chain for several edit ratios (``edit_ratio`` column throughout)."""
    atoms = [O.atoms_cte(f"atoms_{i}", r) for i, r in enumerate(ratios)]
    union = " UNION ALL ".join(f"SELECT *, {O.d(r)} AS edit_ratio FROM atoms_{i}" for i, r in enumerate(ratios))
    rlist = ", ".join(f"({O.d(r)})" for r in ratios)
    return [
        *SQL_LM, *atoms, f"atoms_all AS ({union})", O.score_cte("ts", "atoms_all"),
        O.scored_cte("scored", "atoms_all"),
        f"arts AS (SELECT DISTINCT f.topic, r.edit_ratio, f.doc_id FROM flat f, (VALUES {rlist}) r(edit_ratio))",
        O.roles_cte("arts"),
        "wr AS (SELECT s.*, r.fold, r.role FROM scored s JOIN roles r USING (topic, edit_ratio, doc_id))",
        "nul AS (SELECT topic, edit_ratio, fold, length, response AS x FROM wr "
        "WHERE role = 'null' AND edited = 0 AND response IS NOT NULL)",
        O.grid_cte("nul", KS),
        "docs AS (SELECT * FROM wr WHERE role <> 'null')",
        "pol AS (SELECT *, {0} AS eff_length, {1} AS comment FROM docs)".format(*O.policy_sql()),
        O.pvalue_cte("pv", "pol", KS, "gg.topic = j.topic AND gg.edit_ratio = j.edit_ratio AND gg.fold = j.fold"),
        O.tests_cte("pv", DKS),
        f"doclist AS (SELECT DISTINCT {DKS}, role FROM docs)",
        f"tests_all AS (SELECT doclist.*, coalesce(t.n_valid, 0) AS n_valid2, t.* EXCLUDE ({DKS}) "
        f"FROM doclist LEFT JOIN tests t USING ({DKS}))",
    ]


CK = "topic, edit_ratio, fold, statistic"


def _sweep_keys_sql(src: str, step: float, max_fpr: float | None, name: str) -> str:
    s = O.d(step)
    j0 = f"floor((x.value - st.mn) / {s})"
    b = (f"least({j0} + CASE WHEN st.mn + ({j0} + 1) * {s} <= x.value THEN 1 ELSE 0 END "
         f"- CASE WHEN st.mn + {j0} * {s} > x.value THEN 1 ELSE 0 END, st.J - 1)")
    cond = f" AND fpr <= {O.d(max_fpr)}" if max_fpr is not None else ""
    return f"""
{name}_st AS (SELECT {CK}, min(value) AS mn, max(value) AS mx,
                     CAST(ceil((max(value) - min(value)) / {s}) AS INTEGER) AS J FROM {src} GROUP BY {CK}),
{name}_cnt AS (SELECT {CK}, b, sum(edited) AS pos, sum(1 - edited) AS neg FROM (
                 SELECT x.topic, x.edit_ratio, x.fold, x.statistic, x.edited, {b} AS b
                 FROM {src} x JOIN {name}_st st USING ({CK})) GROUP BY {CK}, b),
{name}_tot AS (SELECT {CK}, sum(pos) AS P, sum(neg) AS N FROM {name}_cnt GROUP BY {CK}),
{name}_scaf AS (SELECT {CK}, mn, unnest(range(0, J)) AS b FROM {name}_st WHERE J > 0),
{name}_t AS (SELECT sc.*, tt.P, tt.N, coalesce(sum(c.pos) OVER w, 0) AS TP, coalesce(sum(c.neg) OVER w, 0) AS FP
             FROM {name}_scaf sc LEFT JOIN {name}_cnt c USING ({CK}, b) JOIN {name}_tot tt USING ({CK})
             WINDOW w AS (PARTITION BY sc.topic, sc.edit_ratio, sc.fold, sc.statistic ORDER BY sc.b DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_t2 AS (SELECT *, (TP + (N - FP)) / (P + N) AS acc, CASE WHEN N > 0 THEN FP / N END AS fpr FROM {name}_t),
{name}_best AS (SELECT {CK}, arg_max(mn + b * {s}, row(acc, -b)) AS th FROM {name}_t2
                WHERE acc > 0{cond} GROUP BY {CK}),
{name} AS (SELECT st.topic, st.edit_ratio, st.fold, st.statistic, coalesce(bb.th, st.mx) AS t
           FROM {name}_st st LEFT JOIN {name}_best bb USING ({CK}))"""


def _metrics_sql(name: str, th: str) -> str:
    return f"""
{name} AS (SELECT {CK}, TP, FN, FP, TN, CASE WHEN TP + FN > 0 THEN TP / (TP + FN) END AS TPR,
                  CASE WHEN FP + TN > 0 THEN FP / (FP + TN) END AS FPR, (TP + TN) / (TP + TN + FP + FN) AS accuracy
           FROM (SELECT x.topic, x.edit_ratio, x.fold, x.statistic,
                        count(*) FILTER (WHERE x.value >= h.t AND x.edited = 1) AS TP,
                        count(*) FILTER (WHERE x.value < h.t AND x.edited = 1) AS FN,
                        count(*) FILTER (WHERE x.value >= h.t AND x.edited = 0) AS FP,
                        count(*) FILTER (WHERE x.value < h.t AND x.edited = 0) AS TN
                 FROM test_l x JOIN {th} h USING ({CK}) GROUP BY x.topic, x.edit_ratio, x.fold, x.statistic))"""


def cv_summary_sql(ratios) -> str:
    return O.with_(*detect_sql(ratios), f"""longs AS (
    SELECT topic, edit_ratio, fold, doc_id, edited, role, 'HC' AS statistic, CAST(HC AS DOUBLE) AS value
    FROM tests_all WHERE HC IS NOT NULL
    UNION ALL SELECT topic, edit_ratio, fold, doc_id, edited, role, 'minP', CAST(minP AS DOUBLE) FROM tests_all
    WHERE minP IS NOT NULL)""",
        "calib_l AS (SELECT * FROM longs WHERE role = 'calibration')",
        "test_l AS (SELECT * FROM longs WHERE role = 'test')",
        f"""crg AS (SELECT {CK}, value AS threshold, sum(edited) AS pos, sum(1 - edited) AS neg
               FROM calib_l GROUP BY {CK}, value)""",
        f"""crc AS (SELECT *, sum(pos) OVER wf AS tp, sum(neg) OVER wf AS fp,
                sum(pos) OVER (PARTITION BY {CK}) AS P, sum(neg) OVER (PARTITION BY {CK}) AS N FROM crg
                WINDOW wf AS (PARTITION BY {CK} ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        f"""yd AS (SELECT {CK}, arg_max(threshold, row(CASE WHEN P > 0 THEN tp / P END - CASE WHEN N > 0 THEN fp / N END,
                  threshold)) AS t FROM crc GROUP BY {CK})""",
        _sweep_keys_sql("calib_l", 0.01, 0.05, "tf"), _sweep_keys_sql("calib_l", 0.01, None, "ta"),
        _metrics_sql("m0", "yd"), _metrics_sql("m1", "tf"), _metrics_sql("m2", "ta"),
        f"""pf AS (SELECT * FROM (SELECT {CK}, TPR, FPR, accuracy FROM m0)
               FULL JOIN (SELECT {CK}, TPR AS TPR_005, FPR AS FPR_005, accuracy AS accuracy_005 FROM m1) USING ({CK})
               FULL JOIN (SELECT {CK}, TPR AS TPR_optimal_acc, FPR AS FPR_optimal_acc,
                                 accuracy AS accuracy_optimal_acc FROM m2) USING ({CK}))""") + """
SELECT topic, statistic, edit_ratio, avg(accuracy_optimal_acc) AS accuracy, stddev_samp(accuracy_optimal_acc) AS accuracy_std,
       avg(FPR_optimal_acc) AS FPR, stddev_samp(FPR_optimal_acc) AS FPR_std, avg(accuracy_005) AS accuracy_005,
       stddev_samp(accuracy_005) AS accuracy_005_std
FROM pf GROUP BY topic, statistic, edit_ratio"""


@register("cv_summary", "M9 A26 F13 T13 A21 A22 A20", [
    ("topic", "string"), ("statistic", "string"), ("edit_ratio", "double"), ("accuracy", "double"),
    ("accuracy_std", "double"), ("FPR", "double"), ("FPR_std", "double"), ("accuracy_005", "double"),
    ("accuracy_005_std", "double")], cv_summary_sql((0.05, 0.1, 0.15)))
def q_cv_summary(spark, sf):
    return accuracy_run(corpus(spark, sf), PARAMS)["summary"]


def power_summary_sql(ratios=(0.1, 0.2), sizes=(50, 100, 200)) -> str:
    K = "topic, number_sentence, edit_ratio, fold"
    DKP = f"{K}, doc_id, edited"
    CKP = f"{K}, statistic"
    atoms, parts = [], []
    for i, r in enumerate(ratios):
        for j, m in enumerate(sizes):
            atoms.append(O.atoms_cte(f"atoms_{i}_{j}", r, m))
            parts.append(f"SELECT *, {O.d(r)} AS edit_ratio, {m} AS number_sentence FROM atoms_{i}_{j}")
    rlist = ", ".join(f"({O.d(r)})" for r in ratios)
    on = " AND ".join(f"gg.{c} = j.{c}" for c in ("topic", "number_sentence", "edit_ratio", "fold"))
    s01 = O.d(0.1)
    j0 = f"(ceil((x.value - pst.f) / {s01}) - 1)"
    b = (f"least({j0} + CASE WHEN pst.f + ({j0} + 1) * {s01} < x.value THEN 1 ELSE 0 END "
         f"- CASE WHEN pst.f + {j0} * {s01} >= x.value THEN 1 ELSE 0 END, pst.J - 1)")
    return O.with_(
        *SQL_LM, *atoms, f"atoms_all AS ({' UNION ALL '.join(parts)})", O.score_cte("ts", "atoms_all"),
        O.scored_cte("scored", "atoms_all"),
        f"arts AS (SELECT DISTINCT f.topic, r.edit_ratio, f.doc_id FROM flat f, (VALUES {rlist}) r(edit_ratio))",
        O.roles_cte("arts"),
        "wr AS (SELECT s.*, r.fold, r.role FROM scored s JOIN roles r USING (topic, edit_ratio, doc_id))",
        f"nul AS (SELECT {K}, length, response AS x FROM wr WHERE role = 'null' AND edited = 0 AND response IS NOT NULL)",
        O.grid_cte("nul", K),
        "docs AS (SELECT * FROM wr WHERE role <> 'null')",
        "pol AS (SELECT *, {0} AS eff_length, {1} AS comment FROM docs)".format(*O.policy_sql()),
        O.pvalue_cte("pv", "pol", K, on),
        O.tests_cte("pv", DKP),
        f"doclist AS (SELECT DISTINCT {DKP}, role FROM docs)",
        f"tests_all AS (SELECT doclist.*, t.* EXCLUDE ({DKP}) FROM doclist LEFT JOIN tests t USING ({DKP}))",
        f"""longs AS (SELECT {K}, doc_id, edited, 'HC' AS statistic, CAST(HC AS DOUBLE) AS value FROM tests_all
                     WHERE HC IS NOT NULL
                     UNION ALL SELECT {K}, doc_id, edited, 'minP', CAST(minP AS DOUBLE) FROM tests_all
                     WHERE minP IS NOT NULL)""",
        f"""pst AS (SELECT {CKP}, CAST(floor(min(value)) AS DOUBLE) AS f, count(*) AS n,
                  CAST(ceil((CAST(ceil(max(value)) AS DOUBLE) - CAST(floor(min(value)) AS DOUBLE)) / {s01}) AS INTEGER) AS J
                  FROM longs WHERE edited = 0 GROUP BY {CKP})""",
        f"""pcnt AS (SELECT {CKP}, b, count(*) AS c FROM (
                  SELECT x.topic, x.number_sentence, x.edit_ratio, x.fold, x.statistic, {b} AS b
                  FROM longs x JOIN pst USING ({CKP}) WHERE x.edited = 0) WHERE b >= 0 GROUP BY {CKP}, b)""",
        f"pscaf AS (SELECT {CKP}, f, n, unnest(range(0, J)) AS b FROM pst WHERE J > 0)",
        f"""ptt AS (SELECT sc.*, coalesce(sum(c.c) OVER w, 0) AS FP FROM pscaf sc LEFT JOIN pcnt c USING ({CKP}, b)
                 WINDOW w AS (PARTITION BY sc.topic, sc.number_sentence, sc.edit_ratio, sc.fold, sc.statistic
                              ORDER BY sc.b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"pok AS (SELECT {CKP}, min(b) AS jb, any_value(f) AS f0 FROM ptt WHERE FP / n <= {O.d(0.05)} GROUP BY {CKP})",
        f"pth AS (SELECT pst.*, coalesce(pok.f0 + pok.jb * {s01}, {O.d(-1.0)}) AS t FROM pst LEFT JOIN pok USING ({CKP}))",
        f"""pf AS (SELECT x.topic, x.number_sentence, x.edit_ratio, x.fold, x.statistic,
                  avg(CASE WHEN x.value > pth.t THEN 1.0 ELSE 0.0 END) AS TPR
                  FROM longs x JOIN pth USING ({CKP}) WHERE x.edited = 1
                  GROUP BY x.topic, x.number_sentence, x.edit_ratio, x.fold, x.statistic)""") + """
SELECT topic, statistic, edit_ratio, number_sentence, avg(TPR) AS accuracy_at_FPR_005,
       stddev_samp(TPR) AS accuracy_at_FPR_005_std, avg(TPR) AS TPR_at_FPR_005, stddev_samp(TPR) AS TPR_at_FPR_005_std
FROM pf GROUP BY topic, statistic, edit_ratio, number_sentence"""


@register("power_summary", "M10 A27", [
    ("topic", "string"), ("statistic", "string"), ("edit_ratio", "double"), ("number_sentence", "bigint"),
    ("accuracy_at_FPR_005", "double"), ("accuracy_at_FPR_005_std", "double"), ("TPR_at_FPR_005", "double"),
    ("TPR_at_FPR_005_std", "double")], power_summary_sql())
def q_power_summary(spark, sf):
    return power_run(corpus(spark, sf), PARAMS)["summary"]


SQL_EMBEDDED = """embedded AS (SELECT vec_id, 'pair_' || CAST(label // 2 AS VARCHAR) AS topic, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS edited,
    CASE vec_id % 3 WHEN 0 THEN CAST(0.05 AS DOUBLE) WHEN 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS edit_ratio FROM embeddings)"""


def _lor(c: Corpus) -> dict:
    """The classifier on ``embeddings``: two labels make a topic (the even one is edited), ids are dealt to three edit ratios."""
    from authorscan.operators.classify import embedding_features, lor_cv
    ratio = F.element_at(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.15)), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = embedding_features(c.table("embeddings")).select(
        F.concat(F.lit("pair_"), F.floor(F.col("label") / 2).cast("string")).alias("topic"), ratio.alias("edit_ratio"), "vec_id",
        (F.col("label") % 2 == 0).cast("int").alias("edited"), "features")
    return _memo(c, "lor", lambda: lor_cv(rows, PARAMS, ["topic", "edit_ratio"], "vec_id"))


@register("lor_folds", "U2 W4 W7 M8", [("topic", "string"), ("edit_ratio", "double"), ("edited", "bigint"), ("vec_id", "bigint"),
                                      ("fold", "bigint"), ("part", "string")],
          O.with_(SQL_EMBEDDED, """placed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY topic, edit_ratio, edited) AS n
    FROM embedded WINDOW w AS (PARTITION BY topic, edit_ratio, edited ORDER BY vec_id))""",
                  "folded AS (SELECT p.*, f.fold, floor(i * 10 / n) = f.fold AS test FROM placed p, range(0, 10) f(fold))",
                  """ranked AS (SELECT *, row_number() OVER (PARTITION BY topic, edit_ratio, fold, test
        ORDER BY md5(CAST(vec_id AS VARCHAR) || '|555'), vec_id, edited) - 1 AS r,
    count(*) OVER (PARTITION BY topic, edit_ratio, fold, test) AS m FROM folded)""") + f"""
SELECT topic, edit_ratio, edited, vec_id, fold,
       CASE WHEN test THEN 'test' WHEN r < floor(m * {O.d(0.8)}) THEN 'train' ELSE 'validation' END AS part FROM ranked""")
def q_lor_folds(spark, sf):
    part = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("_p") + 1)
    return _lor(corpus(spark, sf))["parts"].select("topic", "edit_ratio", "edited", "vec_id", F.posexplode("parts").alias("fold", "_p")).withColumn("part", part)


@register("lor_cv", "S4 U2 S5 M7 M8 A25 A28", [
    ("topic", "string"), ("model", "string"), ("statistics", "string"), ("edit_ratio", "double"),
    ("accuracy", "double"), ("accuracy_std", "double"), ("FPR", "double"), ("FPR_std", "double"),
    ("accuracy_005", "double"), ("accuracy_005_std", "double")], None)
def q_lor_cv(spark, sf):
    return _lor(corpus(spark, sf))["summary"]
