"""Every query of the annotation operators, by SURVEY row, with the SQL that must give the same rows where there is
any. Each query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions.packs import GENERIC_LABELS, LABEL_RANKING, PATTERNS, RISK_PROFILES
from annolake.functions.text import count_all, surface
from annolake.operators import analytics, audit, compare, corpus, detect, evaluate, labels, output, resolve, tagging
from annolake.plans import fixtures
from annolake.plans.fixtures import GOLD, GOLD_SQL, PRED, PRED_SQL, greedy_sql, spans_sql
from annolake.schema import flat
from annolake.sources import scratch

QUERIES, ORACLES = {}, {}
RANGE = ["doc_id", "start", "end", "label"]
STOP_WORDS = {"STOP_EN": ["the", "and", "of", "that the"], "STOP_DE": ["und", "der", "von der"], "STOP_ES": ["que", "de la"]}
EMAIL, IPV4, PHONE = r"[a-z0-9._]+@[a-z0-9.]+[a-z]", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES


def _pred(s, d):
    return flat(fixtures.pred(s, d))


def _gold(s, d):
    return flat(fixtures.gold(s, d))


def _both(s, d):
    return _pred(s, d), _gold(s, d)


def _rows(df):
    return flat(df).select(*RANGE)


def _split_docs(s, d):
    """Documents with a split by doc_id: three named ones, one blank and one missing."""
    k = F.col("doc_id") % 10
    return fixtures.docs(s, d).withColumn("split", F.when(k < 5, "train").when(k < 7, " valid ").when(k == 7, "test").when(k == 8, "  "))


SPLIT_SQL = "sd AS (SELECT *, CASE WHEN doc_id % 10 < 5 THEN 'train' WHEN doc_id % 10 < 7 THEN ' valid ' WHEN doc_id % 10 = 7 THEN 'test' WHEN doc_id % 10 = 8 THEN '  ' END AS split FROM documents)"
MD5_SQL = "md5('{seed}:' || CAST(doc_id AS VARCHAR))"

# --------------------------------------------------------------------------- flagship


def flagship(spark, sf_dir):
    """Entity counts and redacted characters by source."""
    d = fixtures.pred(spark, sf_dir)
    d = d.withColumn("redacted", output.redact(F.col("text"), F.col("spans")))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("spans")).cast("long").alias("spans"), F.sum((F.length("redacted") - F.length("text")).cast("long")).alias("char_delta"))


query(
    "flagship_redaction_by_source",
    f"""WITH RECURSIVE {PRED_SQL}, {greedy_sql('"start" - "end", "start", label')},
    c AS (SELECT doc_id, sum(length(label) + 2 - ("end" - "start")) AS delta FROM chosen GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id)
    SELECT source, count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS spans, CAST(coalesce(sum(delta), 0) AS BIGINT) AS char_delta FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY source""",
)(flagship)

# --------------------------------------------------------------------------- D: detectors


def _scan(rx, label):
    return lambda s, d: _rows(detect.regex_ner(fixtures.docs(s, d), {label: [rx]}, dedupe=False, flags=""))


for _name, _rx, _label in (("scan_regex_email", EMAIL, "EMAIL"), ("scan_regex_ipv4", IPV4, "IP_ADDRESS"), ("scan_regex_phone", PHONE, "PHONE")):
    query(_name, f'SELECT doc_id, "start", "end", label FROM ({spans_sql({_label: [_rx]})})')(_scan(_rx, _label))


def _pack_sql(pack: dict, name: str = "pred") -> str:
    """A pack's spans in SQL, narrowed to the first group of the alternative that fits the match. RE2 takes letters beyond
    ASCII for no part of words, so they are read as underscores, which are."""
    base = r"(SELECT doc_id, regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2B8}\x{370}-\x{1FFF}\x{2C00}-\x{D7FF}]', '_', 'g') AS text FROM documents)"

    def narrowed(label, alternatives):
        found = f"SELECT * FROM ({spans_sql({label: ['(?i)' + '|'.join(alternatives)]}, base=base)})"
        groups = [a.replace("'", "''") for a in alternatives if fixtures.has_group(a)]
        if not groups:
            return found
        e = "coalesce(" + ", ".join(f"nullif(regexp_extract(surface, '(?i)^(?:{g})$', 1), '')" for g in groups) + ", surface)"
        place = "CASE WHEN e = surface THEN \"start\" ELSE CAST(\"start\" + instr(surface, e) - 1 AS INTEGER) END"
        return f"SELECT doc_id, label, a AS \"start\", CAST(a + length(e) AS INTEGER) AS \"end\", e AS surface, span_ord FROM (SELECT *, {place} AS a FROM (SELECT *, {e} AS e FROM ({found})))"

    return f"{name} AS ({' UNION ALL '.join(narrowed(k, v) for k, v in pack.items())})"


_GENERIC = {k: PATTERNS[k] for k in GENERIC_LABELS if k != "DATE"} | {"SECRET": ["[0-9a-f]{32,}"]}


@query(
    "regex_pack_generic_remapped",
    f"""WITH RECURSIVE {_pack_sql(_GENERIC)}, {greedy_sql('"start" - "end", label, "start"')} SELECT doc_id, "start", "end", CASE label WHEN 'EMAIL' THEN 'CONTACT' ELSE label END AS label FROM chosen""",
)
def regex_pack_generic(s, d):
    """D3, D4, C4."""
    return _rows(detect.regex_ner(fixtures.docs(s, d), "generic_pii", {"EMAIL": {"remap": "CONTACT"}, "DATE": {"enabled": False}, "SECRET": {"pattern": "[0-9a-f]{32,}"}}))


@query("regex_pack_clinical", f"""WITH RECURSIVE {_pack_sql(PATTERNS)}, {greedy_sql('"start" - "end", label, "start"')} SELECT doc_id, "start", "end", label FROM chosen""")
def regex_pack_clinical(s, d):
    """The whole clinical pack, longest matches first."""
    return _rows(detect.regex_ner(fixtures.docs(s, d)))


@query(
    "regex_dedupe_longest",
    f"""WITH RECURSIVE {PRED_SQL}, {greedy_sql('"start" - "end", label, "start"')} SELECT doc_id, "start", "end", label FROM chosen""",
)
def regex_dedupe(s, d):
    """A detector's own spans without overlaps; ties by label, then by place."""
    return _rows(detect.regex_ner(fixtures.docs(s, d), PRED, flags=""))


TOKEN_SQL = r"""tok AS (
  SELECT doc_id, n, CAST(st AS INTEGER) AS "start", CAST(st + length(t) AS INTEGER) AS "end", t AS token FROM (
    SELECT doc_id, i // 2 - 1 AS n, i, t, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (
      SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[\p{L}\p{N}\p{M}_]+', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS p FROM documents))) WHERE i % 2 = 0)"""
_PHRASES = ", ".join(f"('{k}', '{t}')" for k, v in STOP_WORDS.items() for t in v)
_TERMS = ", ".join(f"('{k}', '{t}')" for k, v in STOP_WORDS.items() for t in v if " " not in t)


@query("whitelist_terms", f"""WITH {TOKEN_SQL}, terms(label, term) AS (VALUES {_TERMS}) SELECT doc_id, "start", "end", label FROM tok JOIN terms ON lower(token) = term""")
def whitelist_terms(s, d):
    """Words of texts meet single-word terms in an equi-join."""
    t = s.createDataFrame([(k, t) for k, v in STOP_WORDS.items() for t in v if " " not in t], "label string, term string")
    return detect.term_matches(fixtures.docs(s, d), t)


@query("whitelist_phrases", rf"""WITH {TOKEN_SQL}, terms(label, term) AS (VALUES {_PHRASES}),
    two AS (SELECT t.doc_id, t."start", u."end", lower(regexp_replace(substr(text, t."start" + 1, u."end" - t."start"), '\s+', ' ', 'g')) AS x FROM tok t JOIN tok u ON t.doc_id = u.doc_id AND u.n = t.n + 1 JOIN documents d ON d.doc_id = t.doc_id)
    SELECT doc_id, "start", "end", label FROM tok JOIN terms ON lower(token) = term UNION ALL SELECT doc_id, "start", "end", label FROM two JOIN terms ON x = term""")
def whitelist_phrases(s, d):
    """D5 with phrases."""
    t = s.createDataFrame([(k, t) for k, v in STOP_WORDS.items() for t in v], "label string, term string")
    return detect.term_matches(fixtures.docs(s, d), t)


_STOPPED = "upper(x) IN ('THAN', 'ED', 'REED', 'OF', 'LA')"


@query(
    "blacklist_any_token",
    rf"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE len(list_filter(regexp_extract_all(surface, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: {_STOPPED})) = 0""",
)
def blacklist_any_token(s, d):
    """D18."""
    return _rows(detect.blacklist(fixtures.pred(s, d), ["than", "ed", "reed", "of", "la"]))


@query("blacklist_whole_span", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE label <> 'ID' OR surface NOT IN ('1', '2', '3', '10')""")
def blacklist_whole_span(s, d):
    """The old name of the mode, and labels that it is for."""
    return _rows(detect.blacklist(fixtures.pred(s, d), ["1", "2", "3", "10"], "exact_span", labels=["ID"]))


@query("blacklist_substring", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE NOT contains(lower(surface), 'tion') AND NOT contains(lower(surface), 'an')""")
def blacklist_substring(s, d):
    """D18."""
    return _rows(detect.blacklist(fixtures.pred(s, d), ["tion", "An"], "substring"))


@query(
    "blacklist_regions",
    rf"""WITH {TOKEN_SQL}, m AS (SELECT doc_id, "start", "end" FROM tok WHERE lower(token) IN ('the', 'of')),
    f AS (SELECT *, CASE WHEN "start" > max("end") OVER w THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY "start", "end") AS i FROM f)
    SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY doc_id, i""",
)
def blacklist_regions(s, d):
    """D19, D20."""
    r = detect.blacklist_regions(F.col("text"), ["the", "of"])
    return fixtures.docs(s, d).select("doc_id", F.explode(r).alias("r")).select("doc_id", "r.start", "r.end")


@query(
    "blacklist_overlap_document",
    rf"""WITH {PRED_SQL}, {TOKEN_SQL}, m AS (SELECT doc_id, "start" AS a, "end" AS b FROM tok WHERE lower(token) IN ('the', 'of'))
    SELECT doc_id, "start", "end", label FROM pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND a < p."end" AND p."start" < b)""",
)
def blacklist_overlap(s, d):
    """D18, G7."""
    return _rows(detect.blacklist(fixtures.pred(s, d), ["the", "of"], "overlap_document"))


@query(
    "accumulate_skip_overlapping",
    f"""WITH {PRED_SQL}, {GOLD_SQL} SELECT doc_id, "start", "end", label FROM gold UNION ALL
    SELECT doc_id, "start", "end", label FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g."start" < p."end" AND p."start" < g."end")""",
)
def accumulate_skip(s, d):
    """D16, G6."""
    return _rows(detect.regex_ner(fixtures.gold(s, d), PRED, dedupe=False, skip_overlapping=True, flags=""))


@query(
    "propagate",
    f"""WITH {PRED_SQL}, seed AS (SELECT DISTINCT doc_id, surface, label FROM pred WHERE label IN ('NAME', 'EMAIL', 'DATE') AND coalesce(confidence, 1) >= 0.5),
    part AS (SELECT doc_id, surface, label, unnest(p) AS x, generate_subscripts(p, 1) AS k, len(p) AS n FROM (SELECT s.*, string_split(text, surface) AS p FROM seed s JOIN documents USING (doc_id))),
    hit AS (SELECT doc_id, label, n, k, surface, CAST(sum(length(x)) OVER (PARTITION BY doc_id, surface, label ORDER BY k) + (k - 1) * length(surface) AS INTEGER) AS st FROM part)
    SELECT doc_id, "start", "end", label FROM pred UNION SELECT doc_id, st, CAST(st + length(surface) AS INTEGER), label FROM hit WHERE k < n""",
)
def propagate(s, d):
    """Emails and names to all their occurrences."""
    return _rows(detect.propagate(fixtures.pred(s, d), 0.5, ["NAME", "EMAIL", "DATE"]))


@query("token_windows", r"""WITH n AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS n FROM documents), w AS (SELECT doc_id, n, CAST(unnest(range(0, greatest(n, 1), 92)) AS INTEGER) AS s FROM n) SELECT doc_id, s AS "start", least(s + 124, n) AS "end" FROM w WHERE s = 0 OR s + 32 < n""")
def token_windows(s, d):
    """Windows of 128 tokens that overlap by 32."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    return fixtures.docs(s, d).select("doc_id", F.explode(detect.windows(n, 128, 2, 32)).alias("w")).select("doc_id", "w.start", "w.end")


def upper_words():
    """A stand-in for a model: words of three capitals or more."""
    import re

    return lambda texts: [[(m.start(), m.end(), "CAPS", 0.9, "fake") for m in re.finditer(r"[A-Z]{3,}", t)] for t in texts]


@query("external_detector", r"""SELECT doc_id, "start", "end", 'ORGANIZATION' AS label FROM (""" + spans_sql({"CAPS": [r"[A-Z]{3,}"]}) + ")")
def external_detector(s, d):
    """The Arrow path of model detectors, with a fake model."""
    return _rows(detect.external(fixtures.docs(s, d), upper_words, {"CAPS": "ORGANIZATION"}))


@query("placeholders_found", "SELECT doc_id, \"start\", \"end\", substr(surface, 4, length(surface) - 6) AS content FROM (" + spans_sql({"P": [r"\[\*\*[^*]+\*\*\]"]}, base=r"(SELECT doc_id, regexp_replace(text, '([0-9]+)', '[**\1**]', 'g') AS text FROM documents)") + ")")
def placeholders_found(s, d):
    """documents' numbers as [** **] placeholders, found again."""
    t = F.regexp_replace("text", "([0-9]+)", "[**$1**]")
    return fixtures.docs(s, d).select("doc_id", F.explode(detect.placeholders(t)).alias("m")).select("doc_id", "m.start", "m.end", "m.content")


# --------------------------------------------------------------------------- C: labels


@query("label_filter_keep", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE label IN ('NAME', 'ID')""")
def label_filter_keep(s, d):
    """C1, C2."""
    return _rows(labels.filter_labels(fixtures.pred(s, d), keep=["NAME", "ID"]))


@query("label_filter_drop", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE label NOT IN ('NAME', 'ID')""")
def label_filter_drop(s, d):
    return _rows(labels.filter_labels(fixtures.pred(s, d), drop=["NAME", "ID"]))


@query("label_mapper", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", CASE label WHEN 'CITY' THEN 'LOCATION' ELSE label END AS label FROM pred WHERE label <> 'ID'""")
def label_mapper(s, d):
    """CITY is renamed, ID dropped by null, others stay."""
    return _rows(labels.map_labels(fixtures.pred(s, d), {"CITY": "LOCATION", "ID": None}))


@query("label_mapper_strict", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", 'LOCATION' AS label FROM pred WHERE label = 'CITY'""")
def label_mapper_strict(s, d):
    return _rows(labels.map_labels(fixtures.pred(s, d), {"CITY": "LOCATION", "ID": None}, drop_unmapped=True))


@query("label_space_normalise", "SELECT source AS raw, 'OTHER' AS label FROM documents UNION ALL SELECT 'zip-' || lang, CASE lang WHEN 'code' THEN 'ZIP_CODE' ELSE 'OTHER' END FROM documents UNION ALL SELECT 'phone number', 'PHONE' FROM documents")
def label_space(s, d):
    """Unknown labels fall back, aliases lead to canonical ones."""
    t = fixtures.docs(s, d).select(F.explode(F.array(F.col("source"), F.concat(F.lit("zip-"), F.col("lang")), F.lit("phone number"))).alias("raw"))
    return t.select("raw", labels.normalise(F.col("raw")).alias("label"))


# --------------------------------------------------------------------------- F, K: resolving

_CHOSEN = 'SELECT doc_id, "start", "end", label FROM chosen'
_RANK = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABEL_RANKING)) + f" ELSE {len(LABEL_RANKING)} END"
for _name, _order, _f in (
    ("longest_non_overlapping", '"start" - "end", span_ord', resolve.longest),
    ("max_confidence", "coalesce(confidence, 1.0) DESC, span_ord", resolve.max_confidence),
    ("left_to_right", '"start", "start" - "end", span_ord', resolve.left_to_right),
    ("label_priority", f'{_RANK}, "start" - "end", "start", span_ord', resolve.label_priority),
    ("drop_overlapping", '"start", "end", span_ord', resolve.drop_overlapping),
    ("tag_replace_selection", '"start" - "end", "start", label', resolve.for_replacement),
    ("leftmost_shortest", '"start", "end" - "start", span_ord', resolve.leftmost_shortest),
    ("longest_leftmost", '"start" - "end", "start", span_ord', resolve.longest_leftmost),
):
    query(_name, f"WITH RECURSIVE {PRED_SQL}, {greedy_sql(_order)} {_CHOSEN}")(lambda s, d, f=_f: _rows(resolve.resolve(fixtures.pred(s, d), f)))


@query("span_union_sorted", f"""WITH {PRED_SQL} SELECT doc_id, span_ord, "start", "end", label FROM pred""")
def span_union(s, d):
    """F2, L1."""
    return flat(resolve.resolve(fixtures.pred(s, d), "union")).select("doc_id", "span_ord", "start", "end", "label")


def _doubled(s, d):
    return fixtures.pred(s, d).withColumn("spans", F.concat("spans", F.filter("spans", lambda x: x["start"] % 2 == 0)))


@query("exact_dedupe", f"""WITH {PRED_SQL} SELECT DISTINCT doc_id, "start", "end", label FROM pred""")
def exact_dedupe(s, d):
    """F3 over spans of which half occur twice."""
    return _rows(resolve.resolve(_doubled(s, d), "exact_dedupe"))


@query(
    "consensus_by_source",
    f"""WITH RECURSIVE {PRED_SQL}, {GOLD_SQL},
    everything AS (SELECT doc_id, "start", "end", label, source, span_ord FROM pred UNION ALL SELECT doc_id, "start", "end", label, 'regex_ner', 10000 + span_ord FROM gold),
    voted AS (SELECT * FROM everything a WHERE (SELECT count(DISTINCT b.source) FROM everything b WHERE a.doc_id = b.doc_id AND a.label = b.label AND a."start" < b."end" AND b."start" < a."end") >= 2),
    {greedy_sql('"start", "start" - "end", span_ord', "voted", "k.l = o.label")} {_CHOSEN}""",
)
def consensus_by_source(s, d):
    """F4 with a vote for each source."""
    g = fixtures.gold(s, d).select("doc_id", F.col("spans").alias("g"))
    both = fixtures.pred(s, d).join(g, "doc_id").withColumn("spans", F.concat("spans", "g"))
    return _rows(resolve.resolve(both, "consensus", threshold=2, groups="source"))


@query("consensus_single_group", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label FROM pred WHERE 1 = 0""")
def consensus_single(s, d):
    """F4 as one group: two votes are out of reach."""
    return _rows(resolve.resolve(fixtures.pred(s, d), "consensus"))


def _islands_sql(base: str, keys: str, gap: int, compare: str) -> str:
    return f"""f AS (SELECT *, CASE WHEN "start" {compare} max("end") OVER w + {gap} THEN 1 ELSE 0 END AS fresh FROM {base} WINDOW w AS (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    isl AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM f)"""


@query(
    "reconcile_windows",
    f"""WITH {PRED_SQL}, {_islands_sql("pred", "doc_id, label", 1, ">")} SELECT doc_id, min("start") AS "start", max("end") AS "end", label, max(coalesce(confidence, 1.0)) AS confidence FROM isl GROUP BY doc_id, label, i""",
)
def reconcile(s, d):
    """F9."""
    return flat(resolve.resolve(fixtures.pred(s, d), resolve.reconcile)).select(*RANGE, "confidence")


@query("overlap_groups", f"""WITH {PRED_SQL}, {_islands_sql("pred", "doc_id", 0, ">=")} SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM isl GROUP BY doc_id, i HAVING count(*) >= 2""")
def overlap_groups(s, d):
    """K3, I4."""
    return resolve.overlap_groups(_pred(s, d)).select("doc_id", "start", "end", "n")


@query(
    "keep_in_overlap_groups",
    f"""WITH {PRED_SQL}, {_islands_sql("pred", "doc_id", 0, ">=")}, c AS (SELECT *, max(CASE WHEN label = 'NAME' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i) AS has_name FROM isl)
    SELECT doc_id, "start", "end", label FROM c WHERE has_name = 0 OR label = 'NAME'""",
)
def keep_in_groups(s, d):
    """K4: in groups with a NAME only its spans stay."""
    p = _pred(s, d)
    return resolve.keep_in_groups(p, p.where("label = 'NAME'")).select(*RANGE)


@query(
    "coverage_segments",
    f"""WITH {PRED_SQL}, e AS (SELECT doc_id, "start" AS pos, 1 AS d FROM pred UNION ALL SELECT doc_id, "end", -1 FROM pred UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, CAST(length(text) AS INTEGER), 0 FROM documents WHERE length(text) > 0),
    p AS (SELECT doc_id, pos, sum(d) AS d FROM e GROUP BY doc_id, pos), r AS (SELECT doc_id, pos, sum(d) OVER w AS depth, lead(pos) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos AS "start", nxt AS "end", CASE WHEN depth = 0 THEN 'plain' WHEN depth = 1 THEN 'span' ELSE 'overlap' END AS kind FROM r WHERE nxt IS NOT NULL""",
)
def coverage_segments(s, d):
    """K5."""
    return resolve.coverage_segments(fixtures.pred(s, d))


@query("join_duplicates", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", label, coalesce(confidence, 1.0) AS confidence, source FROM pred""")
def join_duplicates(s, d):
    """K6."""
    return resolve.join_duplicates(flat(_doubled(s, d))).select(*RANGE, "confidence", "source")


@query(
    "primary_labels",
    f"""WITH {PRED_SQL}, {GOLD_SQL}, a AS (SELECT doc_id, "start", "end", label, coalesce(confidence, 1.0) AS c FROM pred UNION ALL SELECT doc_id, "start", "end", label, 1.0 FROM gold)
    SELECT doc_id, "start", "end", label FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, "start", "end" ORDER BY c DESC, label) = 1""",
)
def primary_labels(s, d):
    """K7."""
    p, g = _both(s, d)
    return resolve.primary_labels(p.unionByName(g)).select(*RANGE)


# --------------------------------------------------------------------------- G, H: evaluation

_MODE = """SELECT count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn{by} FROM (
  SELECT {keys}, bool_or(side = 'p') AS p, bool_or(side = 'g') AS g FROM (SELECT {keys}, 'p' AS side FROM pred UNION ALL SELECT {keys}, 'g' FROM gold) GROUP BY {keys}) {group}"""
_KEYS = 'doc_id, "start", "end", label'
_PRF = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1"
_SPANS = f"{PRED_SQL}, {GOLD_SQL}"


def _prf_sql(counts: str) -> str:
    return f"SELECT *, {_F1} FROM (SELECT *, {_PRF} FROM ({counts}))"


@query("strict_prf", f"WITH {_SPANS} " + _prf_sql(_MODE.format(keys=_KEYS, by="", group="")))
def strict_prf(s, d):
    """G1, H1, H2, L9."""
    return evaluate.prf(evaluate.strict(fixtures.both_sides(s, d)))


@query("boundary_prf", f"WITH {_SPANS} " + _prf_sql(_MODE.format(keys='doc_id, "start", "end"', by="", group="")))
def boundary_prf(s, d):
    """G2."""
    return evaluate.prf(evaluate.boundary(fixtures.both_sides(s, d)))


@query(
    "partial_prf",
    f"""WITH RECURSIVE {_SPANS}, pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY span_ord) AS r FROM pred),
    gd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY span_ord) AS r FROM gold),
    gl AS (SELECT doc_id, label, list({{'s': "start", 'e': "end", 'i': CAST(r AS INTEGER)}} ORDER BY r) AS g FROM gd GROUP BY doc_id, label),
    walk(doc_id, label, r, taken, part) AS (
      SELECT DISTINCT doc_id, label, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), 0 FROM pr
      UNION ALL
      SELECT doc_id, label, r, CASE WHEN best.n > 0 THEN list_append(taken, -best.i) ELSE taken END, part + CASE WHEN best.n > 0 AND NOT (g[-best.i].s = s AND g[-best.i].e = e) THEN 1 ELSE 0 END FROM (
        SELECT w.doc_id, w.label, p.r, w.taken, w.part, l.g, p."start" AS s, p."end" AS e,
               list_max(list_transform(l.g, lambda x: {{'n': CASE WHEN list_contains(w.taken, x.i) THEN 0 ELSE greatest(0, least(p."end", x.e) - greatest(p."start", x.s)) END, 'i': -x.i}})) AS best
        FROM walk w JOIN pr p ON p.doc_id = w.doc_id AND p.label = w.label AND p.r = w.r + 1 LEFT JOIN gl l ON l.doc_id = p.doc_id AND l.label = p.label)),
    fin AS (SELECT doc_id, label, len(taken) AS tp, part FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY r DESC) = 1)
    """ + _prf_sql("SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST((SELECT count(*) FROM pred) - sum(tp) AS BIGINT) AS fp, CAST((SELECT count(*) FROM gold) - sum(tp) AS BIGINT) AS fn, CAST(sum(part) AS BIGINT) AS partial FROM fin"),
)
def partial_prf(s, d):
    """G3."""
    return evaluate.prf(evaluate.partial(fixtures.both_sides(s, d)))


_CHARS = """tags AS (SELECT side, doc_id, pos, CASE WHEN pos = "start" THEN 'B-' ELSE 'I-' END || label AS tag FROM (
    SELECT *, unnest(range("start", "end")) AS pos FROM (SELECT 'p' AS side, doc_id, span_ord, "start", "end", label FROM pred UNION ALL SELECT 'g', doc_id, span_ord, "start", "end", label FROM gold))
  QUALIFY row_number() OVER (PARTITION BY side, doc_id, pos ORDER BY "start", "start" - "end", span_ord) = 1),
  ch AS (SELECT doc_id, pos, max(tag) FILTER (WHERE side = 'p') AS p, max(tag) FILTER (WHERE side = 'g') AS g FROM tags GROUP BY doc_id, pos)"""


@query("char_prf", f"WITH {_SPANS}, {_CHARS} " + _prf_sql("SELECT count(*) FILTER (WHERE p = g) AS tp, count(*) FILTER (WHERE p IS NOT NULL AND (g IS NULL OR p <> g)) AS fp, count(*) FILTER (WHERE g IS NOT NULL AND (p IS NULL OR p <> g)) AS fn FROM ch"))
def char_prf(s, d):
    """H5, E8."""
    return evaluate.prf(evaluate.characters(fixtures.both_sides(s, d)))


_LABELS = _MODE.format(keys=_KEYS, by=", label", group="GROUP BY label")


@query("per_label_prf", f"WITH {_SPANS}, m AS ({_prf_sql(_LABELS)}), sup AS (SELECT label, count(*) AS support FROM gold GROUP BY label) SELECT m.*, coalesce(support, 0) AS support FROM m LEFT JOIN sup USING (label)")
def per_label_prf(s, d):
    """H3."""
    return evaluate.per_label(fixtures.both_sides(s, d))


@query("macro_prf", f"WITH {_SPANS}, m AS ({_prf_sql(_LABELS)}) SELECT CAST(count(*) AS BIGINT) AS label_count, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM m")
def macro_prf(s, d):
    """H4. Sums of doubles depend on their order, so ratios are compared to nine places."""
    return evaluate.macro(evaluate.per_label(fixtures.both_sides(s, d))).select("label_count", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("mode_bundle", " UNION ALL ".join(f"SELECT '{m}' AS mode, tp, fp, fn, precision, recall, f1 FROM ({ORACLES[q]})" for m, q in (("strict", "strict_prf"), ("exact_boundary", "boundary_prf"), ("partial_overlap", "partial_prf"), ("char_level", "char_prf"))))
def mode_bundle(s, d):
    """H26."""
    at = scratch.folder(s, "sides")  # four modes read the spans, the texts are searched once
    fixtures.both_sides(s, d).write.parquet(at)
    return evaluate.bundle(s.read.parquet(at))


@query("false_negatives", f"""WITH {_SPANS} SELECT doc_id, "start", "end", label FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p."start" = g."start" AND p."end" = g."end" AND p.label = g.label)""")
def false_negatives(s, d):
    """G4."""
    return evaluate.false_negatives(*_both(s, d)).select(*RANGE)


@query("low_confidence_false_positives", f"""WITH {_SPANS} SELECT doc_id, "start", "end", label, confidence FROM pred p WHERE confidence < 0.5 AND NOT EXISTS (SELECT 1 FROM gold g WHERE p.doc_id = g.doc_id AND p."start" = g."start" AND p."end" = g."end" AND p.label = g.label)""")
def low_confidence(s, d):
    """C14."""
    return evaluate.low_confidence(*_both(s, d), 0.5).select(*RANGE, "confidence")


@query(
    "confusion_matrix",
    f"""WITH {_SPANS}, b AS (SELECT g.doc_id, g.span_ord AS go, g.label AS gl, p.span_ord AS po, p.label AS pl FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g."start" < p."end" AND p."start" < g."end"
      QUALIFY row_number() OVER (PARTITION BY g.doc_id, g.span_ord ORDER BY least(g."end", p."end") - greatest(g."start", p."start") DESC, p.span_ord) = 1),
    cells AS (SELECT g.label AS gold_label, coalesce(b.pl, '<MISSED>') AS pred_label FROM gold g LEFT JOIN b ON b.doc_id = g.doc_id AND b.go = g.span_ord UNION ALL
      SELECT '<SPURIOUS>', p.label FROM pred p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.po = p.span_ord))
    SELECT gold_label, pred_label, count(*) AS n FROM cells GROUP BY gold_label, pred_label""",
)
def confusion_matrix(s, d):
    """G5, H6."""
    return evaluate.confusion(fixtures.both_sides(s, d))


_CLINICAL = RISK_PROFILES["clinical_phi"]
_W = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CLINICAL.weights.items()) + " ELSE 1.0 END"


@query(
    "risk_weighted_recall",
    f"""WITH {_SPANS}, g AS (SELECT CAST({_W} AS DOUBLE) AS w, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = gold.doc_id AND p."start" = gold."start" AND p."end" = gold."end" AND p.label = gold.label) AS hit FROM gold)
    SELECT sum(w) AS gold_weight, coalesce(sum(w) FILTER (WHERE NOT hit), 0.0) AS missed_weight, greatest(0.0, 1.0 - coalesce(sum(w) FILTER (WHERE NOT hit), 0.0) / sum(w)) AS risk_weighted_recall FROM g""",
)
def risk_weighted_recall(s, d):
    """H7."""
    return evaluate.risk_weighted_recall(fixtures.both_sides(s, d), None, _CLINICAL)


_COVERS = ", ".join(f"('{x}', '{k}')" for x, ks in _CLINICAL.covers.items() for k in ks)
_IDS = ", ".join(f"('{k}', '{n}', {r})" for k, (n, r) in _CLINICAL.identifiers.items())


@query(
    "coverage_report",
    f"""WITH {PRED_SQL}, covers(label, identifier) AS (VALUES {_COVERS}), ids(identifier, name, required) AS (VALUES {_IDS}),
    n AS (SELECT identifier, count(*) AS total, count(*) FILTER (WHERE label IN (SELECT label FROM pred)) AS there FROM covers GROUP BY identifier)
    SELECT ids.identifier, name, CASE WHEN NOT required THEN 'n/a' WHEN coalesce(there, 0) = 0 THEN 'uncovered' WHEN there = total THEN 'covered' ELSE 'partial' END AS status FROM ids LEFT JOIN n USING (identifier)""",
)
def coverage_report(s, d):
    """H8."""
    return evaluate.coverage(_pred(s, d), _CLINICAL)


@query(
    "worst_docs",
    f"""WITH {_SPANS}, m AS ({_MODE.format(keys=_KEYS, by=", doc_id", group="GROUP BY doc_id")}), p AS ({_prf_sql("SELECT * FROM m")}), n AS (SELECT doc_id, count(*) AS n_gold FROM gold GROUP BY doc_id)
    SELECT d.doc_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(n_gold, 0) AS n_gold, coalesce(f1, 0.0) AS f1,
      CAST(row_number() OVER (ORDER BY coalesce(tp + fp + fn, 0) = 0, coalesce(f1, 0.0), coalesce(n_gold, 0) DESC, d.doc_id) AS INTEGER) AS rank
    FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id) QUALIFY rank <= 500""",
)
def worst_docs(s, d):
    """A report of the 500 worst."""
    return evaluate.worst_documents(fixtures.docs(s, d), *_both(s, d), 500)


@query("compare_runs", f"WITH {_SPANS}, m AS ({_prf_sql(_LABELS)}) SELECT label, round(recall - precision, 6) AS precision, round(precision - recall, 6) AS recall, 0.0::DOUBLE AS f1 FROM m")
def compare_runs(s, d):
    """Per-label metrics of swapped runs."""
    both = fixtures.both_sides(s, d)
    return evaluate.compare_runs(evaluate.per_label(both), evaluate.per_label(evaluate.swapped(both)), "label", ["precision", "recall", "f1"])


# --------------------------------------------------------------------------- H9-H11, J: outputs


@query(
    "redact_text",
    f"""WITH RECURSIVE {PRED_SQL}, {greedy_sql('"start" - "end", "start", label')},
    cut AS (SELECT doc_id, "start", '[' || label || ']' AS v, "end", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM chosen),
    parts AS (SELECT c.doc_id, string_agg(substr(text, before + 1, "start" - before) || v, '' ORDER BY "start") AS t, max("end") AS upto FROM cut c JOIN documents d USING (doc_id) GROUP BY c.doc_id)
    SELECT d.doc_id, coalesce(t || substr(text, upto + 1), text) AS redacted FROM documents d LEFT JOIN parts p USING (doc_id)""",
)
def redact_text(s, d):
    """J1, J2."""
    return output.rendered(fixtures.pred(s, d)).select("doc_id", F.col("output_text").alias("redacted"))


def _leaky(s, d):
    """Gold spans, and a text redacted by predictions alone."""
    g = fixtures.gold(s, d).select("doc_id", F.col("spans").alias("gold"))
    return output.rendered(fixtures.pred(s, d)).join(g, "doc_id").select("doc_id", "text", "output_text", F.col("gold").alias("spans"))


@query("leakage_by_label", f"""WITH RECURSIVE {_SPANS}, {greedy_sql('"start" - "end", "start", label')},
    cut AS (SELECT doc_id, "start", '[' || label || ']' AS v, "end", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM chosen),
    parts AS (SELECT c.doc_id, string_agg(substr(text, before + 1, "start" - before) || v, '' ORDER BY "start") AS t, max("end") AS upto FROM cut c JOIN documents d USING (doc_id) GROUP BY c.doc_id),
    red AS (SELECT d.doc_id, lower(coalesce(t || substr(text, upto + 1), text)) AS r FROM documents d LEFT JOIN parts p USING (doc_id)),
    k AS (SELECT doc_id, label, surface, count(*) AS n FROM gold WHERE trim(surface) <> '' GROUP BY ALL),
    h AS (SELECT k.*, least(n, len(list_filter(range(1, length(r) + 1), lambda i: substr(r, i, length(surface)) = lower(surface)))) AS hit FROM k JOIN red USING (doc_id))
    SELECT label, CAST(sum(n) AS BIGINT) AS gold_count, CAST(sum(hit) AS BIGINT) AS leaked_count, CAST(sum(hit) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS leakage_rate FROM h GROUP BY label""")
def leakage_by_label(s, d):
    """H9, H10, X9."""
    return output.leakage_by_label(_leaky(s, d))


@query("overlapping_occurrences", """SELECT doc_id, CAST(len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'nn')) AS BIGINT) AS n FROM documents""")
def overlapping_occurrences(s, d):
    """Overlapping hits of a string."""
    return fixtures.docs(s, d).select("doc_id", count_all(F.col("text"), F.lit("nn")).cast("long").alias("n"))


@query("surrogate_text")
def surrogate_text(s, d):
    """Aligned surrogates, and their spans' surfaces."""
    out = output.with_surrogates(fixtures.pred(s, d), on_overlap="drop")
    return out.select("doc_id", "output_text", F.to_json("output_spans").alias("spans"))


@query("fill_placeholders")
def fill_placeholders(s, d):
    """J7, M22 over placeholders made of the documents' numbers."""
    t = F.regexp_replace("text", r"([0-9]+)", "[**Telephone/Fax $1**]")
    out = output.fill_placeholders(fixtures.docs(s, d).withColumn("text", t))
    return out.select("doc_id", F.length("text").alias("chars"), F.size("spans").alias("n"))


@query("identities")
def identities(s, d):
    """J8."""
    return output.identity(fixtures.docs(s, d)).select("doc_id", "person", "record_number", "age")


# --------------------------------------------------------------------------- H12-H22: analytics


@query("doc_length_summary", "SELECT count(*) AS n, avg(CAST(length(text) AS DOUBLE)) AS mean, CAST(min(length(text)) AS DOUBLE) AS min, CAST(max(length(text)) AS DOUBLE) AS max, round(stddev_samp(length(text)), 6) AS std FROM documents")
def doc_length_summary(s, d):
    """H12."""
    return analytics.numeric_summary(fixtures.docs(s, d).select(F.length("text").alias("x")), "x").withColumn("std", F.round("std", 6))


@query("docs_by_span_count", f"WITH {PRED_SQL}, n AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id) SELECT CASE WHEN coalesce(n, 0) <= 20 THEN CAST(coalesce(n, 0) AS VARCHAR) ELSE '21+' END AS bucket, count(*) AS docs FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1")
def docs_by_span_count(s, d):
    """H13."""
    return analytics.docs_by_span_count(fixtures.pred(s, d))


@query("span_length_histogram", f"""WITH {PRED_SQL} SELECT CASE WHEN l <= 10 THEN '1-10' WHEN l <= 20 THEN '11-20' WHEN l <= 50 THEN '21-50' WHEN l <= 100 THEN '51-100' ELSE '101+' END AS bucket, count(*) AS spans FROM (SELECT "end" - "start" AS l FROM pred) GROUP BY 1""")
def span_length_histogram(s, d):
    """H14."""
    return analytics.span_lengths(fixtures.pred(s, d))


@query("label_counts", f"WITH {PRED_SQL} SELECT label, count(*) AS spans FROM pred GROUP BY label")
def label_counts(s, d):
    """H15, H20, H22."""
    return analytics.label_counts(fixtures.pred(s, d))


@query("label_cooccurrence", f"WITH {PRED_SQL}, l AS (SELECT DISTINCT doc_id, label FROM pred) SELECT a.label AS label_a, b.label AS label_b, count(*) AS docs FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY 1, 2")
def label_cooccurrence(s, d):
    """G10."""
    return analytics.label_cooccurrence(fixtures.pred(s, d))


@query("overlap_pairs", f"""WITH {PRED_SQL} SELECT d.doc_id, count(a.doc_id) AS pairs FROM documents d LEFT JOIN (pred a JOIN pred b ON a.doc_id = b.doc_id AND a.span_ord < b.span_ord AND a."start" < b."end" AND b."start" < a."end") ON d.doc_id = a.doc_id GROUP BY d.doc_id""")
def overlap_pairs(s, d):
    """G9, F1."""
    return analytics.overlapping_pairs(fixtures.pred(s, d))


@query("token_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS tokens FROM documents")
def token_counts(s, d):
    """E3."""
    return analytics.token_counts(fixtures.docs(s, d))


@query("split_counts", f"WITH {SPLIT_SQL} SELECT coalesce(nullif(trim(split), ''), '(none)') AS split, count(*) AS docs FROM sd GROUP BY 1")
def split_counts(s, d):
    """H17."""
    return analytics.split_counts(_split_docs(s, d))


@query("has_split_metadata", f"WITH {SPLIT_SQL} SELECT bool_or(coalesce(trim(split), '') <> '') AS has_splits FROM sd")
def has_splits(s, d):
    """H18."""
    return analytics.has_splits(_split_docs(s, d))


@query("unique_labels", f"WITH {PRED_SQL} SELECT (SELECT count(*) FROM documents) AS docs, list(DISTINCT label ORDER BY label) AS labels FROM pred")
def unique_labels(s, d):
    """H19."""
    return analytics.unique_labels(fixtures.pred(s, d))


@query("analytics_bundle", rf"""WITH {PRED_SQL}, c AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id), d AS (SELECT CAST(length(text) AS DOUBLE) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS tokens, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM documents LEFT JOIN c USING (doc_id))
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS spans, {", ".join(f"round(avg({x}), 6) AS {x}_mean, min({x}) AS {x}_min, max({x}) AS {x}_max, round(stddev_samp({x}), 6) AS {x}_std" for x in ("chars", "tokens", "n"))} FROM d""")
def analytics_bundle(s, d):
    """H16."""
    out = analytics.bundle(fixtures.pred(s, d))
    return out.select([F.round(c, 6).alias(c) if c.endswith(("_mean", "_std")) else c for c in out.columns])


@query(
    "doc_preview_page",
    f"""WITH {PRED_SQL}, n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM pred GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview, CAST(coalesce(n, 0) AS INTEGER) AS span_count, coalesce(l, '') AS labels FROM documents LEFT JOIN n USING (doc_id) ORDER BY doc_id LIMIT 50 OFFSET 100""",
)
def doc_preview(s, d):
    """The third page of fifty."""
    return analytics.preview(fixtures.pred(s, d), 100, 50).withColumn("labels", F.array_join("labels", ","))


@query("spans_of_label", f"""WITH {PRED_SQL} SELECT doc_id, "start", "end", surface FROM pred WHERE label = 'ID'""")
def spans_of_label(s, d):
    """C11, X4."""
    return analytics.spans_of_label(fixtures.pred(s, d), "id", ignore_case=True)


# --------------------------------------------------------------------------- M: corpora


@query("filter_splits_exact", f"WITH {SPLIT_SQL} SELECT doc_id, split FROM sd WHERE split IN ('train', 'valid')")
def filter_splits(s, d):
    """Values aren't trimmed, so ' valid ' is none of them."""
    return corpus.filter_splits(_split_docs(s, d), ["train", "valid"]).select("doc_id", "split")


@query("filter_split_query", f"WITH {SPLIT_SQL} SELECT doc_id, split FROM sd WHERE coalesce(nullif(trim(split), ''), '(none)') IN ('valid', '(none)')")
def filter_split_query(s, d):
    """C7."""
    return corpus.filter_split_query(_split_docs(s, d), ["valid", "(none)"]).select("doc_id", "split")


@query("work_and_rest", f"WITH {SPLIT_SQL} SELECT CASE WHEN coalesce(split IN ('train', 'test'), FALSE) THEN 'work' ELSE 'rest' END AS part, count(*) AS docs FROM sd GROUP BY 1")
def work_and_rest(s, d):
    """C8, C9."""
    work, rest = corpus.work_and_rest(_split_docs(s, d), ["train", "test"])
    return corpus.strip_splits(work).withColumn("part", F.lit("work")).unionByName(rest.withColumn("part", F.lit("rest"))).groupBy("part").agg(F.count("*").alias("docs"))


@query(
    "reassign_splits",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {MD5_SQL.format(seed=42)}, doc_id) - 1 AS r FROM documents), n AS (SELECT count(*) AS n FROM documents),
    q AS (SELECT i, name, floor(round(n * f, 6)) AS base, round(n * f, 6) - floor(round(n * f, 6)) AS part, n FROM n, (VALUES (0, 'train', 0.7), (1, 'valid', 0.2), (2, 'test', 0.1)) v(i, name, f)),
    g AS (SELECT i, name, base + CASE WHEN row_number() OVER (ORDER BY part DESC, i DESC) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM q),
    c AS (SELECT name, sum(k) OVER (ORDER BY i) - k AS lo, sum(k) OVER (ORDER BY i) AS hi FROM g)
    SELECT doc_id, name AS split FROM r JOIN c ON r.r >= lo AND r.r < hi""",
)
def reassign_splits(s, d):
    """M3-M5: by largest remainders, whatever the size."""
    return corpus.reassign_splits(fixtures.docs(s, d), {"train": 0.7, "valid": 0.2, "test": 0.1}).select("doc_id", "split")


@query(
    "resize_down",
    f"SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {MD5_SQL.format(seed=42)}, CAST(doc_id AS VARCHAR)) <= 150",
)
def resize_down(s, d):
    """A sampling operator; 150 documents in hash order."""
    return corpus.resize(fixtures.docs(s, d), 150).select("doc_id")


@query("resize_up", "SELECT count(*) + 500 AS docs, count(*) + 500 AS ids, CAST(500 AS BIGINT) AS copies FROM documents")
def resize_up(s, d):
    """M1: 500 more than there are."""
    docs = fixtures.docs(s, d)
    up = corpus.resize(docs, docs.count() + 500)
    return up.agg(F.count("*").alias("docs"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.contains("doc_id", F.lit("__rs"))).alias("copies"))


@query("boost_label", f"WITH {PRED_SQL} SELECT count(*) + 2 * (SELECT count(DISTINCT doc_id) FROM pred WHERE label = 'EMAIL') AS docs FROM documents")
def boost_label(s, d):
    """M2."""
    return corpus.boost(fixtures.pred(s, d), "EMAIL", 2).agg(F.count_distinct("doc_id").alias("docs"))


@query("interleave", "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS turn FROM documents")
def interleave(s, d):
    """M11, I2."""
    return corpus.interleave(fixtures.docs(s, d), "source").select("doc_id", "source", "turn")


@query("proportional_sample", f"""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {MD5_SQL.format(seed=42)}, doc_id) <= 3""")
def proportional_sample(s, d):
    """Of all sources alike, three documents each."""
    docs = fixtures.docs(s, d)
    names = [r[0] for r in docs.select("source").distinct().collect()]
    return corpus.proportional(docs, dict.fromkeys(names, 1.0), 3 * len(names)).select("doc_id", "source")


@query("compose_merge", "SELECT 's' || CAST(i AS VARCHAR) || '__' || CAST(doc_id AS VARCHAR) AS doc_id, i AS source_index, CAST(doc_id AS VARCHAR) AS original_id FROM (SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS INTEGER) AS i FROM documents)")
def compose_merge(s, d):
    """Three sources that make up the table."""
    docs = fixtures.docs(s, d).withColumn("lang", F.coalesce("lang", F.lit("")))
    return corpus.compose([docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("lang NOT IN ('en', 'de')")]).select("doc_id", "source_index", "original_id")


@query("transform_preview", f"WITH {PRED_SQL} SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS spans, count(*) FILTER (WHERE label = 'ID') AS dropped, count(*) FILTER (WHERE label = 'CITY') AS renamed FROM pred")
def transform_preview(s, d):
    """H24, M8."""
    return corpus.transform_preview(fixtures.pred(s, d), ["ID"], {"CITY": "LOCATION"})


@query("transform_steps", f"WITH {PRED_SQL} SELECT CASE label WHEN 'CITY' THEN 'LOCATION' ELSE label END AS label, count(*) AS spans FROM pred WHERE label <> 'ID' GROUP BY 1")
def transform_steps(s, d):
    """M6, M7, M18."""
    return analytics.label_counts(corpus.transform(fixtures.pred(s, d), drop=["ID"], mapping={"CITY": "LOCATION"}))


@query("unique_stems", "SELECT doc_id, CASE WHEN r = 1 THEN source ELSE source || '__' || CAST(r AS VARCHAR) END AS stem FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def unique_stems(s, d):
    """I5, B2."""
    return corpus.unique_names(fixtures.docs(s, d), "source", ["doc_id"]).select("doc_id", "stem")


# --------------------------------------------------------------------------- E: tags

_TOK = r"""t AS (SELECT doc_id, i // 2 - 1 AS n, CAST(st AS INTEGER) AS "start", CAST(st + length(x) AS INTEGER) AS "end", x AS token FROM (
    SELECT doc_id, i, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (
      SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\S+', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS p FROM documents))) WHERE i % 2 = 0)"""


@query(
    "bio_tags",
    f"""WITH {PRED_SQL}, {_TOK},
    h AS (SELECT t.doc_id, n, span_ord, label FROM t JOIN pred p ON t.doc_id = p.doc_id AND t."start" < p."end" AND p."start" < t."end" QUALIFY row_number() OVER (PARTITION BY t.doc_id, n ORDER BY p."start", p."start" - p."end", span_ord) = 1),
    g AS (SELECT doc_id, n, CASE WHEN row_number() OVER (PARTITION BY doc_id, span_ord ORDER BY n) = 1 THEN 'B-' ELSE 'I-' END || label AS tag FROM h)
    SELECT t.doc_id, CAST(t.n AS INTEGER) AS n, token, coalesce(tag, 'O') AS tag FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.n = g.n""",
)
def bio_tags(s, d):
    """E1, E2, G16."""
    return tagging.bio_rows(fixtures.pred(s, d))


@query("bio_label_list", f"WITH {PRED_SQL}, l AS (SELECT DISTINCT label FROM pred) SELECT 'O,' || string_agg('B-' || label || ',I-' || label, ',' ORDER BY label) AS tags FROM l")
def bio_label_list(s, d):
    """E6."""
    return tagging.tag_list(fixtures.pred(s, d)).select(F.array_join("tags", ",").alias("tags"))


@query("bioes_round_trip", "SELECT doc_id, TRUE AS same, TRUE AS valid FROM documents")
def bioes_round_trip(s, d):
    """Documents whose tags come back from BIOES as they were."""
    t = tagging.tagged(fixtures.pred(s, d), ["doc_id"]).withColumn("bioes", tagging.bioes(F.col("tags")))
    return t.select("doc_id", (tagging.bio_of_bioes(F.col("bioes")) == F.col("tags")).alias("same"), tagging.valid_bio(F.col("tags")).alias("valid"))


@query("entities_of_tags")
def entities_of_tags(s, d):
    """Spans rebuilt from tags, widened to whole tokens."""
    rows = tagging.tag_rows(fixtures.pred(s, d), {"tag": "spans"})
    return tagging.entities_of_rows(rows, gapless=True).select("doc_id", "start", "end", "label")


@query("sentences")
def sentences(s, d):
    """E4, E5, G15."""
    return tagging.by_sentence(fixtures.pred(s, d)).select("doc_id", "sentence_offset", "text", F.size("spans").alias("n"))


@query("merge_adjacent_names", f"""WITH {PRED_SQL}, f AS (SELECT p.*, CASE WHEN label IN ('NAME', 'DATE') AND lag(label) OVER w = label AND "start" = lag("end") OVER w + 1 AND substr(text, "start", 1) = ' ' THEN 0 ELSE 1 END AS fresh FROM pred p JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY p.doc_id ORDER BY span_ord)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY span_ord) AS i FROM f) SELECT doc_id, min("start") AS "start", max_by("end", span_ord) AS "end", min(label) AS label FROM g GROUP BY doc_id, i""")
def merge_adjacent(s, d):
    """E10."""
    return _rows(tagging.merge_adjacent(fixtures.pred(s, d), ("NAME", "DATE")))


# --------------------------------------------------------------------------- K8-K14: comparisons


@query(
    "span_set_diff",
    f"""WITH {_SPANS} SELECT doc_id, "start", "end", label, CASE WHEN b AND a THEN 'kept' WHEN a THEN 'added' ELSE 'removed' END AS status FROM (
      SELECT doc_id, "start", "end", label, bool_or(x = 'b') AS b, bool_or(x = 'a') AS a FROM (SELECT {_KEYS}, 'b' AS x FROM pred UNION ALL SELECT {_KEYS}, 'a' FROM gold) GROUP BY ALL)""",
)
def span_set_diff(s, d):
    """K8."""
    return compare.span_diff(*_both(s, d))


@query(
    "pipeline_summary",
    f"""WITH {_SPANS}, a AS (SELECT doc_id, "start", "end", string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM pred GROUP BY ALL), b AS (SELECT doc_id, "start", "end", string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM gold GROUP BY ALL)
    SELECT CASE WHEN b.l IS NULL THEN 'only_a' WHEN a.l IS NULL THEN 'only_b' WHEN a.l = b.l THEN 'agreed' ELSE 'relabeled' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a."start" = b."start" AND a."end" = b."end" GROUP BY 1""",
)
def pipeline_summary(s, d):
    """K9."""
    return compare.pipeline_summary(*_both(s, d))


@query("label_conflicts", f"""WITH {_SPANS} SELECT p.doc_id, p."start", p."end", p.label AS label_a, g.label AS label_b FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p."start" = g."start" AND p."end" = g."end" WHERE p.label <> g.label""")
def label_conflicts(s, d):
    """K13."""
    p, g = _both(s, d)
    return compare.label_conflicts(p, g, p).drop("final_labels")


@query("frame_stats", f"""WITH RECURSIVE {PRED_SQL}, {greedy_sql('"start" - "end", span_ord')}, n AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS c FROM chosen GROUP BY doc_id)
    SELECT doc_id, 0 AS added, CAST(coalesce(n - c, 0) AS INTEGER) AS removed, FALSE AS text_changed, 0 AS char_delta FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def frame_stats(s, d):
    """From all predicted spans to the longest ones."""
    p = fixtures.pred(s, d)
    return compare.frame_stats(p, resolve.resolve(p, "longest_non_overlapping"))


@query("fingerprints")
def fingerprints(s, d):
    """K14."""
    return fixtures.pred(s, d).select("doc_id", compare.fingerprint(F.col("text"), F.col("spans")).alias("fingerprint"))


# --------------------------------------------------------------------------- audit


def _log(s, d):
    """``events`` as a log of runs."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("command"), F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string")).alias("pipeline_name"), F.lit(1).cast("long").alias("span_count"), F.col("value").alias("duration_seconds"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"))


_LOG = "log AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, event_type AS command, 'p' || CAST(user_id % 25 AS VARCHAR) AS pipeline_name, value, 's' || CAST(user_id % 3 AS VARCHAR) AS source FROM events)"


@query("audit_stats", f"WITH {_LOG} SELECT count(*) AS runs, CAST(count(*) AS BIGINT) AS spans, round(avg(value), 6) AS avg_duration FROM log")
def audit_stats(s, d):
    """H21."""
    return audit.totals(_log(s, d)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("audit_top_pipelines", f"WITH {_LOG} SELECT pipeline_name, count(*) AS runs FROM log GROUP BY 1 ORDER BY runs DESC, min(ts), pipeline_name LIMIT 10")
def audit_top(s, d):
    """A top ten."""
    return audit.top_pipelines(_log(s, d)).select("pipeline_name", "runs")


@query("audit_by_source", f"WITH {_LOG} SELECT source, count(*) AS runs FROM log GROUP BY 1")
def audit_by_source(s, d):
    """H21."""
    return audit.by_source(_log(s, d))


@query("audit_page", f"WITH {_LOG} SELECT id, command FROM log WHERE source = 's1' ORDER BY ts DESC, id LIMIT 50 OFFSET 50")
def audit_page(s, d):
    """The second page of one source's runs."""
    return audit.page(audit.select(_log(s, d), source="s1"), 50, 50).select("id", "command")


@query("audit_find", f"WITH {_LOG} SELECT id, command FROM log WHERE starts_with(id, '12') ORDER BY ts DESC, id LIMIT 1")
def audit_find(s, d):
    """L7."""
    return audit.find(_log(s, d), "12").select("id", "command")


@query("surface_texts", f"""WITH {GOLD_SQL} SELECT doc_id, label, surface, count(*) AS n FROM gold GROUP BY ALL""")
def surface_texts(s, d):
    """What gold spans say."""
    g = fixtures.gold(s, d).select("doc_id", "text", F.explode("spans").alias("s"))
    return g.select("doc_id", F.col("s.label").alias("label"), surface(F.col("text"), F.col("s.start"), F.col("s.end")).alias("surface")).groupBy("doc_id", "label", "surface").agg(F.count("*").alias("n"))
