"""The registered queries of this package and the SQL that some must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import bpe, language, line_dedup, merkle, mixing, ngram_join, perplexity, simhash, token_counts, top_k, toxicity, warc, whitening
from canopy.session import run_dir

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


def read(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_token_counts")
def op1(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.cache_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 512).alias("over_limit"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
w AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM l),
c AS (SELECT s, len(s) AS n, min((doc_id, line_no)) AS spot, row_number() OVER () AS id FROM w WHERE len(s) >= 1 GROUP BY s),
t AS (SELECT id, n, spot, unnest(s) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
r AS (SELECT id, n, spot, tok, row_number() OVER (PARTITION BY id ORDER BY df, tok) AS pos FROM t JOIN f USING (tok)),
p AS (SELECT * FROM r WHERE pos <= n - (4 * n + 4) // 5 + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.tok = b.tok AND a.spot < b.spot AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (
  SELECT DISTINCT y.id FROM k JOIN c x ON x.id = k.a JOIN c y ON y.id = k.b
  WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
g AS (
  SELECT w.doc_id, w.line_no FROM w JOIN c ON w.s = c.s LEFT JOIN v ON v.id = c.id WHERE v.id IS NOT NULL OR (w.doc_id, w.line_no) <> c.spot)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, count(g.line_no)::BIGINT AS n_removed,
       coalesce(string_agg(g.line_no::VARCHAR, ',' ORDER BY g.line_no), '') AS removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark, sf):
    cleaned = line_dedup.dedup_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def held_out(parts: int, rest: int):
    """Whether crc32 of the id as text leaves rest; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


@query("op4_toxicity")
def op4(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    learn = F.col("doc_id").isNotNull() & ~held_out(3, 1)
    scored = toxicity.score_toxicity(docs, read(spark, sf, "labels"), learn, keep=["doc_id"])
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


@query("op5_language_id")
def op5(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, F.col("doc_id").isNotNull() & ~held_out(5, 0), keep=["doc_id"])
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@query("op7_quality_rules")
def op7(spark, sf):
    judged = perplexity.judge(read(spark, sf, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


@query("op8_simhash_near_dedup")
def op8(spark, sf):
    found = simhash.near_duplicates(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_bpe_round_trip")
def op10(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    back = bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), path, decoded="decoded", keep=["doc_id"])
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '42', doc_id::VARCHAR)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(no % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS w_all,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / w <= (total - cap_before) / (w_all - w_before) AS is_full FROM l),
r AS (
  SELECT *, total - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, sum(w) FILTER (NOT is_full) OVER () AS w_rest FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE rest * w / w_rest END AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS due,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(a + size, due) - a, 0) + greatest(least(a + source_size + size, due) - a - source_size, 0))::BIGINT AS taken
FROM p"""


@query("op2_source_mix", OP2_SQL)
def op2(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    _, mixed = mixing.mix(docs, ["doc_id"], [3, 1, 2], share=1.5, limit=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
b AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS first FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i:i])::INT), 4, '0')), lambda x, y: x || y) AS s FROM b)
SELECT page_id, n AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         (16 * s[5*i+1:5*i+1]::INT + 8 * s[5*i+2:5*i+2]::INT + 4 * s[5*i+3:5*i+3]::INT + 2 * s[5*i+4:5*i+4]::INT + s[5*i+5:5*i+5]::INT + 1)::INT]),
         lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""


@query("op6_warc_revisits", OP6_SQL)
def op6(spark, sf):
    path = run_dir(spark, "warc")
    warc.deduplicate(read(spark, sf, "pages"), path)
    found = warc.restore(warc.read_archives(spark, path))
    return found.select(warc.key_of().alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of("refers_to_id").alias("refers_to"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op9_exact_top_k", OP9_SQL)
def op9(spark, sf):
    return top_k.exact_top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def _op11_sql(levels: int = 8, fanout: int = 16) -> str:
    """The manifest as SQL, for up to fanout^levels rows of a source and as many sources. l are the nodes of a level with
    their position in a group, g the runs, and f the rows on their way up with the siblings met so far."""
    crc = ("list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: "
           "[ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
           "lambda s, e: xor(xor(s, e) >> 1, CASE WHEN xor(s, e) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))")
    code = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(code(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""WITH d AS (
  SELECT *, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
         CASE WHEN xor({crc}, 4294967295::UBIGINT) % 5 = 0 THEN {leaf('changed')} ELSE {leaf('text')} END AS seen
  FROM (SELECT *, {small} AS changed FROM documents)),
l0 AS (SELECT doc_id, tree, leaf, seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node FROM d),
f0 AS (SELECT doc_id, tree, leaf, pos, seen AS folded, '' AS proof FROM l0)"""]

    def climb(n: str, f: str, i: int) -> str:
        return f"""{n}g{i} AS (SELECT tree, pos // {fanout} AS run, list(node ORDER BY pos) AS ds, sum(count(*)) OVER (PARTITION BY tree) > 1 AS up
  FROM {n}{i} GROUP BY tree, pos // {fanout}),
{n}{i + 1} AS (SELECT tree, run AS pos, CASE WHEN up THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS node FROM {n}g{i}),
{f}{i + 1} AS (
  SELECT x.* EXCLUDE (pos, folded, proof), x.pos // {fanout} AS pos,
         CASE WHEN up THEN sha256(array_to_string(ds[:pos % {fanout}], '') || folded || array_to_string(ds[pos % {fanout} + 2:], '')) ELSE folded END AS folded,
         CASE WHEN up THEN proof || array_to_string(ds[:pos % {fanout}], '') || array_to_string(ds[pos % {fanout} + 2:], '') ELSE proof END AS proof
  FROM {f}{i} x JOIN {n}g{i} g ON g.tree = x.tree AND g.run = x.pos // {fanout})"""

    parts += [climb("l", "f", i) for i in range(levels)]
    parts.append(f"""t0 AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM l{levels}),
h0 AS (SELECT f.doc_id, f.leaf, '' AS tree, t.node AS subroot, t.pos AS pos, f.folded, f.proof FROM f{levels} f JOIN t0 t ON t.of = f.tree)""")
    parts += [climb("t", "h", i) for i in range(levels)]
    return ",\n".join(parts) + f"""
SELECT h.doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM h{levels} h CROSS JOIN t{levels} t"""


@query("op11_merkle_manifest", _op11_sql())
def op11(spark, sf):
    docs = read(spark, sf, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    seen = F.when(tampered, merkle.leaf_digest(*[F.col(c) for c in fields[:-1]], small))
    proven = merkle.manifest(docs, fields, "source", "doc_id", {"seen": seen})
    folded = proven.withColumn("folded_root", merkle.fold(F.coalesce("seen", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_embedding_whitening")
def op12(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s)::BIGINT AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, unnest(s) AS g FROM c),
e AS (
  SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.g = y.g AND x.id <> y.id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT id, id AS root FROM c UNION SELECT e.b AS id, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.id = c.id"""


@query("op13_ngram_jaccard_join", OP13_SQL)
def op13(spark, sf):
    return ngram_join.near_groups(read(spark, sf, "documents").select("doc_id", "text"))
