"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from polyview.llm import bpe, chat, counts, decontam, jaccard, langid, merkle, pii, ranked, sharding, topk, toxicity, warc
from polyview.llm.common import table
from polyview.llm.registry import CHECKS, QUERIES, query  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sharding")
def op1_sharding(spark, sf_dir):
    tree = sharding.Tree.even(regions=2, racks=2, shards=4)
    docs = sharding.sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    placed = sharding.place(docs, "doc_id", tree)
    placed = sharding.place(placed, "doc_id", tree.grown(), ("grown_region", "grown_rack", "grown_shard"))
    return sharding.slots(placed, "shard", "doc_id", ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


@query("op9_bpe")
def op9_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, VOCABULARY)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op10_jaccard")
def op10_jaccard(spark, sf_dir):
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train_all(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "flagged")


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query("op7_pii")
def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    def of(column, kind):
        return F.filter(column, lambda s: s["kind"] == kind)

    every = F.concat(*[F.array_sort(F.concat(of("base", k), of("added", k))) for k in pii.KINDS])
    counts = [F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


_LEAKS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i2 AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM i2),
ish AS (SELECT item_id, n, k, array_to_string(w[p:p+k-1], ' ') AS s FROM i2, unnest(range(1, n-k+2)) AS t(p)),
dsh AS (SELECT doc_id, k, p, len(w) AS size, array_to_string(w[p:p+k-1], ' ') AS s FROM d, ks, unnest(range(1, len(w)-k+2)) AS t(p)),
windows AS (SELECT DISTINCT doc_id, p AS start, n, a.k FROM dsh a JOIN ish b ON a.s = b.s AND a.k = b.k),
ws AS (SELECT v.doc_id, start, n, v.k, s, count(*) AS c FROM windows v JOIN dsh a ON a.doc_id = v.doc_id AND a.k = v.k
       AND a.p BETWEEN start AND start + n - v.k GROUP BY ALL),
sizes AS (SELECT doc_id, start, n, k, sum(c) AS total FROM ws GROUP BY ALL),
ics AS (SELECT item_id, n, k, s, count(*) AS c FROM ish GROUP BY ALL),
pairs AS (SELECT ws.doc_id, item_id, ws.start, ws.n, ws.k, sum(least(ws.c, ics.c)) AS shared FROM ws JOIN ics ON ws.s = ics.s AND ws.n = ics.n AND ws.k = ics.k GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, shared, total + n - k + 1 - shared AS united FROM pairs JOIN sizes USING (doc_id, start, n, k))
SELECT doc_id, item_id, (start - 1)::INT AS start, shared::INT AS n_shared, united::INT AS n_union FROM scored WHERE 100 * shared >= 75 * united
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / united DESC, start) = 1"""


@query("op6_decontamination", _LEAKS)
def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op3_warc")
def op3_warc(spark, sf_dir):
    pages = warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(warc.normalise(warc.write_archives(pages))).drop("payload")


_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


@query("op4_topk", _TOP)
def op4_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


@query("op5_counts")
def op5_counts(spark, sf_dir):
    return counts.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).drop("text")


_PAIRS = """
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
c AS (SELECT * FROM p WHERE side = 'chosen'), r AS (SELECT * FROM p WHERE side = 'rejected'),
s AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place,
  coalesce(c.role = r.role AND c.text = r.text, false) AS same FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.place = r.place),
f AS (SELECT pair_id, coalesce(min(place) FILTER (NOT same), max(place) + 1) AS shared FROM s GROUP BY pair_id),
u AS (SELECT pair_id, CASE WHEN place < shared THEN 'prompt' ELSE side END AS part, place, role, length(role) + length(text) + 12 AS size,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(text) + 8 AS tail FROM p JOIN f USING (pair_id) WHERE place >= shared OR side = 'chosen'),
o AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, part ORDER BY place) AS stop FROM u)
SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'prompt'), '') AS prompt,
 coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen,
 coalesce(string_agg((stop - tail)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
 coalesce(string_agg(shown, '' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected,
 coalesce(string_agg((stop - tail)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
 count(*) FILTER (part = 'prompt') AS prompt_turns, count(*) FILTER (part = 'chosen') AS chosen_turns, count(*) FILTER (part = 'rejected') AS rejected_turns
FROM o GROUP BY pair_id"""


@query("op8_preferences", _PAIRS)
def op8_preferences(spark, sf_dir):
    return chat.preference_texts(chat.neighbours(table(spark, sf_dir, "conversations")))


def _manifest_sql(depth: int = 7) -> str:
    """The manifest with ``depth`` levels written out, for up to 16 ** depth rows a source and as many sources."""
    def leaf(text):
        fields = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    byte_step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda t: unicode(t)::BIGINT)), lambda a, b: {byte_step}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""d AS (SELECT coalesce('=' || source, '-') AS tree, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed FROM documents),
l0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)"""]
    for name in ("l", "u"):
        if name == "u":
            parts.append(f"u0 AS (SELECT '' AS tree, tree AS source_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{depth})")
        for k in range(depth):
            parts.append(f"""{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (max(n) + 15) // 16 AS n
 FROM {name}{k} GROUP BY tree, pos // 16)""")
            frame = "OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{name}s{k} AS (SELECT tree, pos, n = 1 AS alone, coalesce(string_agg(digest, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
 coalesce(string_agg(digest, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM {name}{k})""")
    last = "SELECT doc_id, leaf, l0.tree, l0.pos, u0.pos AS top, u0.digest AS subroot, '' AS path, changed AS folded FROM l0 JOIN u0 ON l0.tree = u0.source_tree"
    for step, (name, k) in enumerate([(n, k) for n in ("l", "u") for k in range(depth)]):
        on = f"s.tree = f.tree AND s.pos = f.pos // {16**k}" if name == "l" else f"s.pos = f.top // {16**k}"
        parts.append(f"f{step} AS ({last})")
        last = f"""SELECT f.* REPLACE (path || before || behind AS path, CASE WHEN alone THEN folded ELSE sha256(before || folded || behind) END AS folded)
 FROM f{step} f JOIN {name}s{k} s ON {on}"""
    return f"""WITH {', '.join(parts)}, f AS ({last})
SELECT doc_id, leaf, subroot, u{depth}.digest AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = u{depth}.digest AS verified FROM f, u{depth}"""


@query("op11_merkle", _manifest_sql())
def op11_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.proofs(merkle.build(merkle.leaves(table(spark, sf_dir, "documents"), tampered)))


@query("op12_langid")
def op12_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.label(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "spans")


_RANKED = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
p AS (SELECT uid, doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT uid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, uid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
 FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query("op13_ranked", _RANKED)
def op13_ranked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
