"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwise.llm import (
    bagminhash,
    conversations,
    exact_dedup,
    kneser_ney,
    langid,
    line_dedup,
    mixing,
    packing,
    secrets,
    sentencepieces,
    token_files,
    topk,
    vector_codes,
)
from cairnwise.llm.shipping import ship_package

#: Folder of the vocabulary files; TOKENIZER_DIR names another one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.document_quality(read(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(kind))
    base = F.filter("spans", lambda s: s["kind"] < secrets.KINDS.index("entropy"))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_documents(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("piece_ends", 256).alias("spans_sha256"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return token_files.read_token_files(manifest)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit_language_model(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversations.repair_report(turns, conversations.damage(turns))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: DuckDB SQL of the same results; a query without one is compared with brute force in tests/llm.
OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)"""

OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keys AS (SELECT doc_id, pos, line,
 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keys WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(first_id <> doc_id, false) AS dropped FROM keys LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP8_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, q.row AS query_row, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
 md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighted AS (SELECT source, total, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS w FROM sources),
filled AS (SELECT *, row_number() OVER o AS rank, sum(w) OVER (ORDER BY 2 * total / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
 1.5 * sum(total) OVER () - coalesce(sum(2.0 * total) OVER (ORDER BY 2 * total / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words
 FROM weighted WINDOW o AS (ORDER BY 2 * total / w, source)),
cut AS (SELECT rank, left_words, open_w FROM filled WHERE CAST(left_words AS DOUBLE) * w / open_w <= 2 * total ORDER BY rank LIMIT 1),
targets AS (SELECT source, total, CASE WHEN f.rank < coalesce(c.rank, 1000000000) THEN CAST(2 * total AS DOUBLE) ELSE CAST(c.left_words AS DOUBLE) * w / c.open_w END AS target
 FROM filled f LEFT JOIN cut c ON true),
running AS (SELECT doc_id, size, total, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
 sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
 FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS full_epochs FROM running),
taken AS (SELECT *, greatest(0, least(size, budget - full_epochs * total - ahead)) AS part FROM epochs)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target, CAST(full_epochs * size + part AS BIGINT) AS taken,
 CAST(CASE WHEN size = 0 THEN 0 ELSE full_epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END END AS INTEGER) AS epochs FROM taken"""

#: Places of a pattern's matches: running sums of the lengths of pieces and matches.
_PLACES = """(SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'start':
 CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT), 'hit': hits[i]}}), recursive := true)
 FROM (SELECT doc_id, string_split_regex(text, '{0}') AS pieces, regexp_extract_all(text, '{0}') AS hits FROM docs))"""


def _secrets_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    places = lambda p: _PLACES.format(quoted(p))
    w = secrets.WINDOW
    allowed = quoted("|".join(f"(?:{p})" for p in secrets.ALLOWED))
    names = "['assign', 'access', 'hex', 'entropy']"
    joined = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) {{}}, '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
candidates AS (SELECT doc_id, start, CASE WHEN regexp_matches(hit, '{allowed}') THEN array_to_string(list_transform(
 list_zip(string_split_regex(hit, '{allowed}'), regexp_extract_all(hit, '{allowed}')), lambda z: z[1] || repeat('{secrets.MASK}', coalesce(length(z[2]), 0))), '') ELSE hit END AS hit
 FROM {places(secrets.CANDIDATE)}),
windows AS (SELECT doc_id, start, pos, hit[pos + 1:pos + {w}] AS part FROM (SELECT *, unnest(range(0, length(hit) - {w - 1})) AS pos FROM candidates)),
hot AS (SELECT doc_id, start, pos FROM windows WHERE NOT contains(part, '{secrets.MASK}') AND NOT regexp_full_match(part, '[0-9]+') AND round(list_entropy(string_split(part, '')), 6) >=
 CASE WHEN regexp_full_match(part, '[0-9A-Fa-f]+') THEN {secrets.THRESHOLDS['hex']} ELSE {secrets.THRESHOLDS['base64']} END),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER o + {w} THEN 0 ELSE 1 END AS fresh FROM hot WINDOW o AS (PARTITION BY doc_id, start ORDER BY pos)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY pos) AS island FROM marked),
spans AS (
 SELECT doc_id, 0 AS kind, start, start + length(hit) AS stop FROM {places(secrets.ASSIGN)} WHERE length(regexp_extract(hit, '{quoted(secrets.ASSIGN)}', 2)) >= {secrets.ASSIGN_LEAST}
 UNION ALL SELECT doc_id, 1, start, start + length(hit) FROM {places(secrets.ACCESS)}
 UNION ALL SELECT doc_id, 2, start, start + length(hit) FROM {places(secrets.HEX)}
 UNION ALL SELECT doc_id, 3, start + min(pos), start + max(pos) + {w} FROM islands GROUP BY doc_id, start, island)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256({joined.format('FILTER (kind < 3)')}) AS base_sha256, {joined.format('')} AS spans
FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id"""


def _conversations_sql() -> str:
    """The cheapest edits by dynamic programming over rows: a state's best is a string of nine digits of cost and the audit."""
    c = conversations

    def paid(x: str, cost: str | int, letter: str) -> str:
        return f"lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}'"

    def insert(x: str) -> str:
        return paid(x, c.INSERT, "I")

    def delete(x: str) -> str:
        return paid(x, f"{c.DELETE}", "D")

    def stays(x: str, initial: str) -> str:
        keep, rerole = paid(x, "stay", "K"), paid(x, f"stay + {c.REROLE}", "R")
        return f"CASE WHEN NOT doomed AND initial = '{initial}' THEN {keep} END, CASE WHEN NOT doomed THEN {rerole} END"

    blanks = " || ".join(f"chr({ord(x)})" for x in c.BLANKS)
    space = "coalesce({}, ' ')".format
    conv, turn = space("CAST(conv_id AS VARCHAR)"), space("CAST(turn AS VARCHAR)")
    return f"""
WITH RECURSIVE seeded AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
  list_transform(string_split({conv} || ':' || {turn}, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
  CAST(4294967295 AS BIGINT))) % 20 AS kind FROM conversations),
damaged AS (
 SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM seeded WHERE kind <> 0),
placed AS (
 SELECT conv_id, turn, role, text, left(role, 1) AS initial, trim(text, {blanks}) AS said,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat_ws(':', {conv}, {turn}, length(role), role || text))) AS i
 FROM damaged),
faults AS (
 SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated,
  said <> '' AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM placed),
rows AS MATERIALIZED (
 SELECT *, blank OR repeated AS doomed, cut AND NOT repeated AS truncated, CASE WHEN cut THEN {c.TRUNCATED} ELSE 0 END AS stay,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS off FROM faults),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
 SELECT conv_id, 0 AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM ids
 UNION ALL
 SELECT conv_id, CAST(i AS INTEGER), {delete('s0')}, least({delete('s1')}, CASE WHEN NOT doomed AND initial = 's' THEN {paid('s0', 'stay', 'K')} END),
  least({delete('s2')}, {stays('s0', 'u')}, {stays('s1', 'u')}, {stays('f3', 'u')}), least({delete('s3')}, {stays('f2', 'a')})
 FROM (SELECT *, least(s3, {insert('f2')}) AS f3 FROM (
  SELECT w.s0, w.s1, w.s2, w.s3, r.conv_id, r.i, r.initial, r.doomed, r.stay,
   least(w.s2, {insert('w.s0')}, {insert('w.s1')}, {insert('w.s3')}) AS f2
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
ends AS (SELECT conv_id, least(s0, s3, {insert('s2')}, {insert(f"({insert('s1')})")}) AS best FROM walk
 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
solved AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ends),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM solved WHERE audit <> ''),
steps AS (SELECT conv_id, letter, p, sum(CAST(letter <> 'I' AS INTEGER)) OVER o AS i, sum(CAST(letter <> 'D' AS INTEGER)) OVER o AS place FROM letters
 WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
written AS (
 SELECT s.conv_id, s.letter, s.p, s.place, r.role, r.text, max(CAST(s.letter = 'K' AND s.place = 1 AND r.initial = 's' AS INTEGER)) OVER (PARTITION BY s.conv_id) AS system
 FROM steps s LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.letter <> 'D'),
repaired AS (
 SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS lines FROM written GROUP BY conv_id),
counts AS (
 SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (repeated) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (off) AS illegal FROM rows GROUP BY conv_id)
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM solved s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM s.conv_id"""


def _vector_codes_sql() -> str:
    v = vector_codes

    def assigned(k: int) -> str:
        """``best`` packs distance and index, so that the least one also breaks ties."""
        difference = "list_sum(list_transform(range(1, len(s.part) + 1), lambda d: (s.part[d] - b.part[d]) * (s.part[d] - b.part[d])))"
        return f"""a{k} AS MATERIALIZED (SELECT s.row, s.p, CAST(min({difference} * {v.ENTRIES} + b.entry) AS BIGINT) AS best
 FROM parts s JOIN b{k} b USING (p) GROUP BY s.row, s.p)"""

    def updated(k: int) -> str:
        return f"""m{k} AS (SELECT p, a.best % {v.ENTRIES} AS entry, d, sum(part[d]) AS total, count(*) AS many
 FROM (SELECT p, best, part, unnest(range(1, len(part) + 1)) AS d FROM a{k} JOIN parts USING (row, p)) a GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(n.part, b.part) AS part FROM b{k} b LEFT JOIN (
 SELECT p, entry, list(CAST((total - ((total % many) + many) % many) // many AS BIGINT) ORDER BY d) AS part FROM m{k} GROUP BY p, entry) n USING (p, entry))"""

    rounds = ",\n".join(f"{assigned(k)},\n{updated(k)}" for k in range(v.ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
 SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row,
  list_transform(embedding, lambda x: CAST(floor({v.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
parts AS MATERIALIZED (SELECT row, p, x[p * len(x) // {v.PARTS} + 1:(p + 1) * len(x) // {v.PARTS}] AS part FROM kept, range({v.PARTS}) t(p)),
b0 AS (SELECT p, row - 1 AS entry, part FROM parts WHERE row <= {v.ENTRIES}),
{rounds},
{assigned(v.ROUNDS)},
book AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{v.ROUNDS}),
coded AS (SELECT row, string_agg(printf('%02x', best % {v.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {v.ENTRIES}) AS BIGINT) AS error
 FROM a{v.ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), book"""


CHECKS: dict = {
    "op1_quality": (op1_quality, None),
    "op2_secrets": (op2_secrets, _secrets_sql()),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_token_files": (op6_token_files, None),
    "op7_near_dedup": (op7_near_dedup, None),
    "op8_topk": (op8_topk, OP8_SQL),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_language_id": (op10_language_id, None),
    "op11_conversations": (op11_conversations, _conversations_sql()),
    "op12_vector_codes": (op12_vector_codes, _vector_codes_sql()),
    "op13_packing": (op13_packing, None),
    "pipeline": (pipeline, None),
}
