"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences
from .alignment import align
from .decontaminate import decontaminate
from .embedding_dedup import near_vectors
from .html_text import extract
from .licences import scan
from .lm_scoring import lm_scores
from .merkle import fold, manifest, proof_digest
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import quality
from .quotations import link
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, _table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, _table(spark, sf_dir, "embeddings"), every=100)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files ``source/lang/doc_id.txt``."""
    docs = _table(spark, sf_dir, "documents")
    path = F.format_string("%s/%s/%d.txt", "source", "lang", "doc_id")
    return scan(spark, docs.select("doc_id", path.alias("path"), "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, _table(spark, sf_dir, "pages"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, _table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, checked against a table in which a seventh of the rows has one more in ``n_chars``."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1)
    made = manifest(spark, _table(spark, sf_dir, "documents"), changed=tampered)
    made = made.withColumn("folded_root", fold(F.coalesce("other_leaf", "leaf"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, _table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_licence_scan": op6_licence_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_html_text": op10_html_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS win FROM b WHERE len(ws) > 0),
ls AS (SELECT DISTINCT l FROM iw),
dp AS (SELECT doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS i FROM d, ls WHERE len(ws) >= l),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i+l-1], ' ') AS win FROM dp),
h AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN iw USING (l, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_BARE = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[^a-z0-9.-]+'), lambda w: trim(w, '.-')), lambda w: w <> '')"
_SAYS = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(licences.TEMPLATES))
_IN = lambda names: ", ".join(f"'{x}'" for x in names)
_OP6_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_SAYS}) v(k, name, text)),
tc AS (SELECT k, w, count(*) AS tf FROM (SELECT k, unnest({_BARE.format("text")}) AS w FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS id, doc_id, source || '/' || lang AS dir, source || '/' || lang || '/' || doc_id || '.txt' AS path, {_BARE.format("coalesce(text, '')")} AS ws FROM documents),
df AS (SELECT w, count(DISTINCT id) AS df FROM (SELECT id, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM tc) GROUP BY w),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
idf AS (SELECT w, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1.0::DOUBLE AS idf FROM (SELECT DISTINCT w FROM tc) LEFT JOIN df USING (w), n),
tn AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tc JOIN idf USING (w) GROUP BY k),
tw AS (SELECT k, w, tf * idf / norm AS weight FROM tc JOIN idf USING (w) JOIN tn USING (k)),
w AS (SELECT id, ws, ws[i] AS w, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
p AS (SELECT id, 0 AS pl, 0 AS b, 0 AS a, ws AS own FROM d WHERE list_has_any(ws, [{_IN(licences.TRIGGERS + licences.OPENERS)}])
 UNION ALL SELECT id, i, b, a, ws[greatest(1, i - b):i + a] FROM w, (SELECT unnest({list(licences.BEFORE)}) AS b), (SELECT unnest({list(licences.AFTER)}) AS a) WHERE w IN ({_IN(licences.TRIGGERS)})
 UNION ALL SELECT id, i, 0, a, ws[i:i + a] FROM w, (SELECT unnest({list(licences.REACH)}) AS a) WHERE w IN ({_IN(licences.OPENERS)})),
pc AS (SELECT id, pl, b, a, w, count(*) AS tf FROM (SELECT id, pl, b, a, unnest(own) AS w FROM p) GROUP BY ALL),
pw AS (SELECT id, pl, b, a, w, tf * coalesce(idf, ln(1.0::DOUBLE + n) + 1.0::DOUBLE) AS weight FROM pc LEFT JOIN idf USING (w), n),
pn AS (SELECT id, pl, b, a, sqrt(sum(weight * weight)) AS norm FROM pw GROUP BY ALL),
c AS (SELECT id, pl, b, a, k, sum(pw.weight * tw.weight) AS dot FROM pw JOIN tw USING (w) GROUP BY ALL),
h AS (SELECT id, pl, round(dot / norm, 6) AS similarity, name FROM c JOIN pn USING (id, pl, b, a) JOIN t USING (k)),
g AS (SELECT * FROM h WHERE similarity >= CASE WHEN pl = 0 THEN {licences.WHOLE} ELSE {licences.LEAST} END),
o AS (SELECT id, pl = 0 AS whole, name AS own_license, similarity FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY pl = 0 DESC, least(9, floor(10 * similarity)) DESC, pl, similarity DESC, name) = 1),
s AS (SELECT id, count(DISTINCT pl) FILTER (pl > 0) AS n_statements FROM g GROUP BY id),
f AS (SELECT d.doc_id, dir, path, n_statements, own_license, similarity, regexp_matches(path, '{licences.FILE_NAME}') OR coalesce(whole, false) AS is_file FROM d LEFT JOIN o USING (id) LEFT JOIN s USING (id)),
u AS (SELECT dir AS above, arg_min(own_license, (path, own_license)) AS license FROM f WHERE is_file AND own_license IS NOT NULL AND dir IS NOT NULL GROUP BY dir),
x AS (SELECT dir, arg_max(above, length(above)) AS above, arg_max(license, length(above)) AS license FROM (SELECT DISTINCT dir FROM f) y JOIN u ON u.above = '' OR u.above = y.dir OR starts_with(y.dir, u.above || '/') GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(n_statements, 0)::BIGINT AS n_statements, own_license, similarity, coalesce(own_license, x.license) AS license,
       CASE WHEN own_license IS NULL THEN x.above END AS inherited_from FROM f LEFT JOIN x USING (dir)
"""

_OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_have >= 75 * (na.n + nb.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_OP9_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS s FROM conversations),
x AS (SELECT id, conv_id, turn, i, s[i] AS line FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM m)),
l AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '{_MARKS}', '') AS bare,
 trim(regexp_replace(lower(regexp_replace(line, '{_MARKS}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words FROM x),
k AS (SELECT *, sum(CASE WHEN words = '' OR level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS p FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY i) AS before FROM l)),
g AS (SELECT id, conv_id, turn, p, level, string_agg(words, ' ' ORDER BY i) AS whole, list(words) AS parts FROM k WHERE words <> '' GROUP BY ALL),
u AS (SELECT DISTINCT id, conv_id, turn, p, level, unit, unit = whole AS is_whole FROM (SELECT *, unnest(list_distinct(list_append(parts, whole))) AS unit FROM g)),
o AS (SELECT conv_id, unit, min(turn) AS origin FROM u WHERE level = 0 GROUP BY ALL),
f AS (SELECT id, p, level, coalesce(max(origin) FILTER (is_whole), max(origin)) AS origin FROM u JOIN o USING (conv_id, unit) WHERE level > 0 AND origin < turn GROUP BY ALL),
q AS (SELECT id, count(*) AS n_linked, coalesce(max(origin) FILTER (level = 1), max(origin)) AS reply_to FROM f GROUP BY id),
z AS (SELECT id, count(DISTINCT p) FILTER (level > 0) AS n_quotes FROM g GROUP BY id),
c AS (SELECT id, trim(coalesce(string_agg(bare, chr(10) ORDER BY i) FILTER (level = 0), '')) AS text FROM l GROUP BY id),
a AS (SELECT m.id, conv_id, turn, role, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, text FROM m JOIN c USING (id) LEFT JOIN z USING (id) LEFT JOIN q USING (id)),
t AS (SELECT conv_id, turn, arg_min(reply_to, (role, text, id)) AS reply_to FROM a GROUP BY ALL),
r AS (SELECT conv_id, turn, turn AS thread FROM t WHERE reply_to IS NULL UNION ALL SELECT t.conv_id, t.turn, r.thread FROM t JOIN r ON t.conv_id = r.conv_id AND t.reply_to = r.turn)
SELECT conv_id, turn, role, n_quotes::BIGINT AS n_quotes, n_linked::BIGINT AS n_linked, reply_to, thread, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, text, id) - 1 AS position, text FROM a JOIN r USING (conv_id, turn)
"""

_OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
d AS (SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
 CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS changed FROM documents, tab),
v AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
h AS (SELECT id, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || tail) AS other FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS members FROM h),
r AS (SELECT 0 AS level, lang, place, members, leaf AS digest FROM p UNION ALL
 SELECT * FROM (SELECT level + 1 AS level, lang, place // 2 AS place, (members + 1) // 2 AS members, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY lang ORDER BY place), '')) AS digest FROM r WHERE members > 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY place) % 2 = 1)),
s AS (SELECT lang, digest AS subroot, level AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS members FROM r WHERE members = 1),
t AS (SELECT 0 AS level, place, members, subroot AS digest FROM s UNION ALL
 SELECT * FROM (SELECT level + 1 AS level, place // 2 AS place, (members + 1) // 2 AS members, sha256(digest || coalesce(lead(digest) OVER (ORDER BY place), '')) AS digest FROM t WHERE members > 1 QUALIFY row_number() OVER (ORDER BY place) % 2 = 1)),
k AS (SELECT p.id, level, (p.place >> level) % 2 AS slot, (SELECT digest FROM r q WHERE q.level = r.level AND q.lang IS NOT DISTINCT FROM p.lang AND q.place = xor(p.place >> r.level, 1)) AS beside
 FROM p JOIN (SELECT DISTINCT lang, level FROM r WHERE members > 1) r ON r.lang IS NOT DISTINCT FROM p.lang UNION ALL
 SELECT p.id, levels + level, (s.place >> level) % 2, (SELECT digest FROM t q WHERE q.level = t.level AND q.place = xor(s.place >> t.level, 1))
 FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, (SELECT DISTINCT level FROM t WHERE members > 1) t),
f AS (SELECT id, 0 AS level, other AS digest FROM p UNION ALL
 SELECT f.id, f.level + 1, sha256(CASE WHEN slot = 1 THEN beside || digest ELSE digest || coalesce(beside, '') END) FROM f JOIN k USING (id, level)),
e AS (SELECT id, arg_max(digest, level) AS folded_root FROM f GROUP BY id),
o AS (SELECT id, sha256(string_agg(coalesce(beside, ''), '' ORDER BY level)) AS proof_sha256 FROM k GROUP BY id)
SELECT doc_id, leaf, subroot, (SELECT digest FROM t WHERE members = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM t WHERE members = 1) AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN e USING (id) LEFT JOIN o USING (id)
"""

_OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS id, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.label = b.label AND a.id <> b.id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m USING (id) LEFT JOIN n USING (id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": _OP3_SQL,
    "op9_quotation_linking": _OP9_SQL,
    "op6_licence_scan": _OP6_SQL,
    "op7_decontaminate": _OP7_SQL,
    "op11_merkle_manifest": _OP11_SQL,
    "op12_embedding_near_dedup": _OP12_SQL,
}
