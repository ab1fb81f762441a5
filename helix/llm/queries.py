"""The operators over the tables, with the parameters of production, and their DuckDB forms."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.llm.shared import load
from helix.shipping import ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

URL_ORACLE = """
WITH l AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1) ELSE '' END AS h0,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path FROM pages),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM l),
g AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM p LEFT JOIN g ON p.page_id = g.doc_id GROUP BY host),
h AS (SELECT host, n, k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS s FROM c),
u AS (SELECT *, CASE WHEN array_to_string(s[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN 2 ELSE 1 END AS t FROM h),
d AS (SELECT host, n, k, array_to_string(s[-t:], '.') AS suffix, array_to_string(s[-t - 1:], '.') AS domain FROM u),
a AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS up FROM d),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
s2 AS (SELECT s1.*, up FROM s1, a),
s3 AS (SELECT sum((k - n * up) ^ 2) AS s, sum(n * up * (1 - up)) AS b, sum(n * (n - 1) * up * (1 - up)) AS c FROM s2),
s4 AS (SELECT suffix, (k + kappa * up) / (n + kappa) AS up FROM s2, (SELECT CASE WHEN coalesce(c, 0) <= 0 OR s <= b THEN 1000.0 ELSE least(greatest(c / (s - b) - 1, 1.0), 1000.0) END AS kappa FROM s3) q),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY domain, suffix),
d2 AS (SELECT d1.*, up FROM d1 JOIN s4 USING (suffix)),
d3 AS (SELECT sum((k - n * up) ^ 2) AS s, sum(n * up * (1 - up)) AS b, sum(n * (n - 1) * up * (1 - up)) AS c FROM d2),
d4 AS (SELECT domain, suffix, (k + kappa * up) / (n + kappa) AS up FROM d2, (SELECT CASE WHEN coalesce(c, 0) <= 0 OR s <= b THEN 1000.0 ELSE least(greatest(c / (s - b) - 1, 1.0), 1000.0) END AS kappa FROM d3) q),
h2 AS (SELECT d.host, d.n, d.k, up FROM d JOIN d4 USING (domain, suffix)),
h3 AS (SELECT sum((k - n * up) ^ 2) AS s, sum(n * up * (1 - up)) AS b, sum(n * (n - 1) * up * (1 - up)) AS c FROM h2),
h4 AS (SELECT host, k + kappa * up AS a, n - k + kappa * (1 - up) AS b FROM h2, (SELECT CASE WHEN coalesce(c, 0) <= 0 OR s <= b THEN 1000.0 ELSE least(greatest(c / (s - b) - 1, 1.0), 1000.0) END AS kappa FROM h3) q),
h5 AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h4),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, rh, rp)),
m AS (SELECT p.page_id, p.host, p.path, max_by(struct_pack(rule := rh || rp, verdict := r.verdict), length(rh || rp)) AS m
    FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.m.rule AS rule, coalesce(m.m.verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN h5 USING (host) LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path
"""


@query(URL_ORACLE)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. A page's labelled outcome is that of the labels row with its number: good if of quality and not toxic."""
    from helix.llm.url_filter import url_filter

    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.coalesce("quality", F.lit(0)) == 1).__and__(F.coalesce("toxic", F.lit(1)) == 0).alias("good"))
    return url_filter(load(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


CHAT_ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (SELECT *, length(text) + 3 * len(regexp_extract_all(text, '</?s>|<</?SYS>>')) + 4 * len(regexp_extract_all(text, '\[/?INST\]')) + 4 * len(regexp_extract_all(text, '&(?:amp;)*(?:lt;|#91;)')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n + length('<s>[INST]') + length(role) + length('[/INST]') + 1 + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(CHAT_ORACLE)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each row an event of kind "message" at its turn, and conversation -1; what is read back from the output."""
    from helix.llm.chat_format import format_chat, read_back

    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], rows.schema)
    events = rows.unionByName(one).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))
    formatted = format_chat(events)
    back = read_back(formatted)
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    digests = back.select(
        F.col("conv_id").alias("c"), F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
    )
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars")).join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query(r"""
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents) d
JOIN (SELECT sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s, min(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.s = g.s
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact group."""
    from helix.llm.exact_dedup import exact_dedup

    return exact_dedup(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
dw AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dp),
h AS (SELECT dw.row, dw.i, bw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hw AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM h) x GROUP BY row),
hi AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM h) x GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (row) LEFT JOIN hi USING (row)
""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    from helix.llm.decontaminate import decontaminate

    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    from helix.llm.pack import pack

    return pack(load(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled ones of two thirds of all."""
    from helix.llm.langid import crc_part, predict, train

    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = train(docs.filter("NOT held_out").select("doc_id", "text", "lang"))
    return predict(docs, model, carry=("doc_id", "held_out"))


@query()
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    from helix.llm.near_dedup import near_dedup

    return near_dedup(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query()
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score, learned from six sevenths of all."""
    from helix.llm.langid import crc_part
    from helix.llm.lm_score import lm_score

    return lm_score(load(spark, sf_dir, "documents"), crc_part(F.col("doc_id"), 7) == 2)


@query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines and those of them that go."""
    from helix.llm.line_dedup import line_decisions

    found = line_decisions(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


@query()
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates."""
    from helix.llm.pii import replace_pii

    return replace_pii(load(spark, sf_dir, "documents").select("doc_id", "text"), "a key of this corpus").select("doc_id", "text", "n_entities")


PHRASES_ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) q WHERE len(w) >= m) x GROUP BY ALL),
tot AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE a >= 30),
c AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) x),
s AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, part FROM (SELECT lang, a, n, array_to_string(w[i:i + n - 1], ' ') AS part FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS n) q WHERE m > n) x) y JOIN f z USING (lang) WHERE z.phrase = part AND 100::HUGEINT * y.a >= 80::HUGEINT * z.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.part = b.phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN tot USING (lang) WHERE rank <= 2000
"""


@query(PHRASES_ORACLE)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases."""
    from helix.llm.phrases import mine

    return mine(load(spark, sf_dir, "documents"))


MANIFEST_ORACLE = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, tab),
h AS (SELECT r, doc_id, lang, crc, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, low], lambda x: CASE WHEN x IS NULL THEN '-' ELSE octet_length(encode(x)) || ':' || x END) AS f FROM d),
l AS (SELECT r, doc_id, lang, sha256(array_to_string(f[1:5], '')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(array_to_string(f[1:4], '') || f[6]) END AS changed FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
nodes(lvl, g, n, idx, digest) AS (SELECT 0, g, n, idx, leaf FROM p UNION ALL SELECT lvl + 1, g, (n + 7) // 8, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, g, n, idx // 8),
sub AS (SELECT g, lvl AS height, digest AS subroot FROM nodes WHERE n = 1),
tops(lvl, n, idx, digest) AS (SELECT 0, (SELECT count(*) FROM sub), g, subroot FROM sub UNION ALL SELECT lvl + 1, (n + 7) // 8, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, n, idx // 8),
top AS (SELECT digest AS root FROM tops WHERE n = 1),
runs AS (SELECT lvl, g, idx // 8 AS up, list(digest ORDER BY idx) AS run FROM nodes WHERE n > 1 GROUP BY lvl, g, idx // 8),
toprun AS (SELECT lvl, idx // 8 AS up, list(digest ORDER BY idx) AS run FROM tops WHERE n > 1 GROUP BY lvl, idx // 8),
steps AS (SELECT p.r, runs.lvl AS k, (p.idx // (8 ** runs.lvl)::BIGINT) % 8 AS digit, run FROM p JOIN runs ON runs.g = p.g AND runs.up = p.idx // (8 ** (runs.lvl + 1))::BIGINT
    UNION ALL SELECT p.r, sub.height + t.lvl, (p.g // (8 ** t.lvl)::BIGINT) % 8, run FROM p JOIN sub USING (g) JOIN toprun t ON t.up = p.g // (8 ** (t.lvl + 1))::BIGINT),
s AS (SELECT r, k, array_to_string(run[1:digit], '') AS a, array_to_string(run[digit + 2:], '') AS b FROM steps),
proof AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof, max(k) AS last FROM s GROUP BY r),
fold(r, k, now) AS (SELECT r, 0, coalesce(changed, leaf) FROM p UNION ALL SELECT s.r, s.k + 1, sha256(a || now || b) FROM fold JOIN s ON s.r = fold.r AND s.k = fold.k),
ends AS (SELECT r, max_by(now, k) AS now FROM fold GROUP BY r)
SELECT p.doc_id, p.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, now AS folded_root, now = root AS verified FROM p JOIN sub USING (g) JOIN ends USING (r) LEFT JOIN proof USING (r), top
"""


@query(MANIFEST_ORACLE)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and what a third of them give when their text is tampered with."""
    from helix.llm.manifest import manifest_proofs

    return manifest_proofs(load(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


EMBEDDINGS_ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT * FROM ok WHERE norm > 0 AND isfinite(norm)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query(EMBEDDINGS_ORACLE)
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    from helix.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(load(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
