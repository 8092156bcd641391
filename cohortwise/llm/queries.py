"""One query per operator over its whole table, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import (
    chaining,
    divergence,
    embedding_dedup,
    license_scan,
    merkle,
    minhash_dedup,
    mixing,
    packing,
    suffix_dedup,
    token_packing,
    topk_search,
    toxicity,
    url_cascade,
)
from cohortwise.llm.texts import word_count

# Fixed values: (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
TOXIC_FROM = 0.3
SOURCE_WEIGHTS = (5, 2, 1)
# Documents of a usual length are twice as likely to be in the sample of a source.
_USUAL = (20, 2000)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def likely_of(size):
    return F.when(size.between(*_USUAL), 2.0).otherwise(1.0)


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack(docs, word_count(F.col("text")), F.md5("text"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    units = mixing.allocate(
        docs, F.col("size"), likely=likely_of(F.col("size")), weights=SOURCE_WEIGHTS, percent=150, most=2
    )
    return mixing.mix_report(units)


def op4_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return url_cascade.judge_urls(_table(spark, folder, "pages"), URL_RULES)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_substrings(_table(spark, folder, "documents"), length=400))


def op6_collinear_chaining(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.fuzzy_passages(_table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents"))


def held_out(doc_id):
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels, train=~held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings"), threshold=0.9)


def op10_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return topk_search.top_by_product(vectors, F.col("vec_id") % 20 == 0, k=20, factor=64)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # As a decimal, so that one more than the largest long is a number too.
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    leaf = merkle.leaf_of(*fields.values())
    leaves = _table(spark, folder, "documents").select(
        "doc_id", "lang", leaf.alias("leaf"), F.when(tampered, merkle.leaf_of(*more.values())).alias("forged")
    )
    proven = merkle.manifest(leaves, "lang", ["doc_id"])
    found = proven.withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_of(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, folder, "documents")
    packed = token_packing.pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024)
    return token_packing.pieces_of(packed).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergences(_table(spark, folder, "documents"), top=200, least_docs=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_minhash_dedup, op2_best_fit_packing, op3_source_mixing, op4_url_cascade, op5_suffix_dedup,
        op6_collinear_chaining, op7_license_scan, op8_toxicity, op9_embedding_dedup, op10_topk_search,
        op11_merkle_manifest, op12_token_packing, op13_source_divergence,
    )
    return {f.__name__: f for f in every}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), {_WORDS}), []) AS ws
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

_OP4 = """
WITH cut AS (
  SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
""".format(upper=_UPPER, lower=_UPPER.lower(), rules=", ".join(str(r) for r in URL_RULES))

_OP9 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id <> y.vec_id
  AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

_OP10 = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), scored AS (
  SELECT x.vec_id AS query_id, y.vec_id AS vec_id, list_inner_product(x.q, y.q)::BIGINT AS score
  FROM valid x JOIN valid y ON x.vec_id <> y.vec_id AND len(x.q) = len(y.q) WHERE x.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


# One step of CRC-32 for each bit of each byte of the id's digits.
_CRC32 = """
list_reduce(list_transform(range(1, length({digits}) + 1), lambda i: ascii(substr({digits}, i, 1))::BIGINT),
  lambda crc, byte: list_reduce(range(0, 8),
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295)
"""

_OP11 = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, * FROM documents
), told AS (
  SELECT r, doc_id, lang, {whole} AS leaf, {forged} AS forged, tampered FROM (
    SELECT *, coalesce(xor({crc}, 4294967295) % 7 = 0, false) AS tampered FROM docs)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM told
), low(lang, level, pos, node, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM low WHERE n > 1 GROUP BY lang, pos // 2
), subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM low WHERE n = 1
), high(level, pos, node, n) AS (
  SELECT 0, pos, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM high WHERE n > 1 GROUP BY pos // 2
), climb(r, lang, high, level, pos, n, folded, proof) AS (
  SELECT r, lang, false, 0, pos, count(*) OVER (PARTITION BY lang),
    CASE WHEN tampered THEN forged ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT c.r, c.lang, c.high OR c.n = 1, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN s.pos ELSE c.pos // 2 END,
    CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 1) // 2 END,
    CASE WHEN c.n = 1 THEN folded WHEN c.pos % 2 = 1 THEN sha256(b.node || folded)
      ELSE sha256(folded || coalesce(b.node, '')) END,
    proof || CASE WHEN c.n = 1 THEN '' ELSE coalesce(b.node, '') END
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN (SELECT false AS high, lang, level, pos, node FROM low UNION ALL SELECT true, NULL, level, pos, node FROM high) b
    ON b.high = c.high AND (c.high OR b.lang IS NOT DISTINCT FROM c.lang)
    AND b.level = c.level AND b.pos = c.pos + 1 - 2 * (c.pos % 2)
  WHERE NOT (c.high AND c.n = 1)
)
SELECT doc_id, leaf, s.node AS subroot, h.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = h.node AS verified
FROM leaves JOIN climb c USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaves.lang
JOIN high h ON h.n = 1 WHERE c.high AND c.n = 1
"""


def _merkle_sql() -> str:
    def leaf(*fields: str) -> str:
        parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields]
        return f"sha256({' || '.join(parts)})"

    crc = _CRC32.format(digits="doc_id::VARCHAR").strip()
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    forged = ["(n_chars::HUGEINT + 1)" if f == "n_chars" else f for f in fields]
    return _OP11.format(crc=crc, whole=leaf(*fields), forged=leaf(*forged))


_OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), words AS (SELECT r, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(any_value(s.v), 0) AS v, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counted c USING (lang, source)
  LEFT JOIN sizes s USING (lang) GROUP BY g.lang, g.source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), wholes AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM cells GROUP BY lang, term
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
  FROM cells JOIN wholes USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _mixing_sql(cell_units: int = 1000, fills: int = 3, least: float = 0.001) -> str:
    weights = ", ".join(f"{w}.0" for w in SOURCE_WEIGHTS)
    steps, last = [], "edge0"
    for step in range(fills + 1):
        half = "size / 2.0::DOUBLE" if step == fills else "0.0::DOUBLE"
        steps.append(f"""
skip{step} AS (
  SELECT *, (n - extra = 0 OR size > gap + {half}) AS skipped FROM {last}
), ahead{step} AS (
  SELECT *, coalesce(sum(CASE WHEN NOT skipped THEN (n - extra) * size END) OVER (PARTITION BY source
    ORDER BY skipped, odds, id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM skip{step}
), fit{step} AS (
  SELECT * EXCLUDE (skipped, earlier), CASE WHEN skipped OR earlier > gap THEN 0 WHEN size = 0 THEN n - extra
    ELSE greatest(0, least(n - extra, floor((gap - earlier + {half}) / size)::BIGINT)) END AS fit FROM ahead{step}
), edge{step + 1} AS (
  SELECT * EXCLUDE (fit, extra, gap), extra + fit AS extra,
    gap - (sum(fit * size) OVER (PARTITION BY source))::BIGINT AS gap FROM fit{step}
)""")
        last = f"edge{step + 1}"
    return rf"""
WITH docs AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size FROM documents
), units AS (
  SELECT source, id, size, count(*) AS n,
    CASE WHEN size BETWEEN {_USUAL[0]} AND {_USUAL[1]} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS likely
  FROM docs GROUP BY source, id, size
), sizes AS (
  SELECT source, sum(n * size)::BIGINT AS words, sum(n * size * likely)::DOUBLE AS weighed, count(*) AS units
  FROM units GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS name_rank,
    (2 * words)::DOUBLE AS cap, (sum(words) OVER ())::DOUBLE * 150 / 100.0::DOUBLE AS total FROM sizes
), weighted AS (
  SELECT *, ([{weights}]::DOUBLE[])[((name_rank - 1) % {len(SOURCE_WEIGHTS)} + 1)::INTEGER] AS weight FROM named
), filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER fill, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0.0)) AS level
  FROM weighted
  WINDOW fill AS (ORDER BY cap / weight, name_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, max(CASE WHEN cap / weight > level THEN level END) OVER () AS share FROM filled
), targets AS (
  SELECT source, units, weighed, words AS source_size,
    CASE WHEN cap / weight <= level THEN cap ELSE share * weight END AS target FROM shared
), joined AS (
  SELECT u.*, t.units, t.weighed, t.source_size, t.target,
    floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END)::BIGINT AS whole
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, target - whole * source_size AS rest,
    (('0x' || substr(md5(coalesce(id::VARCHAR, '') || '|' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u FROM joined
), chance AS (
  SELECT *, least(greatest(coalesce(CASE WHEN source_size > 0 AND weighed > 0
    THEN rest / source_size * likely / (weighed / source_size) END, 0.0::DOUBLE), {least}::DOUBLE), 1 - {least}::DOUBLE) AS p FROM drawn
), ranked AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds FROM chance
), celled AS (
  SELECT *, least(floor(odds / (1 + odds) * greatest(1, ceil(units / {cell_units}.0)))::BIGINT,
    greatest(1, ceil(units / {cell_units}.0))::BIGINT - 1) AS cell FROM ranked
), cells AS (
  SELECT source, cell, sum(n * size)::BIGINT AS cell_words, any_value(rest) AS rest FROM celled GROUP BY source, cell
), summed AS (
  SELECT *, coalesce(sum(cell_words) OVER (PARTITION BY source ORDER BY cell
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cells
), placed AS (
  SELECT c.*, s.before, CASE WHEN s.before + s.cell_words <= s.rest THEN 2 WHEN s.before < s.rest THEN 1 ELSE 0 END AS part
  FROM celled c JOIN summed s ON c.cell = s.cell AND c.source IS NOT DISTINCT FROM s.source
), edge0 AS (
  SELECT *, 0::BIGINT AS extra, rest - before AS gap FROM placed WHERE part = 1
), {','.join(steps)},
decided AS (
  SELECT id, size, n, source_size, target, whole, extra FROM {last}
  UNION ALL
  SELECT id, size, n, source_size, target, whole, CASE WHEN part = 2 THEN n ELSE 0 END FROM placed WHERE part <> 1
), rows AS (SELECT *, unnest(range(n)) AS copy FROM decided)
SELECT id AS doc_id, size, source_size, target,
  ((whole + CASE WHEN copy < extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM rows
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": _OP1,
        "op3_source_mixing": _mixing_sql(),
        "op4_url_cascade": _OP4,
        "op9_embedding_dedup": _OP9,
        "op10_topk_search": _OP10,
        "op11_merkle_manifest": _merkle_sql(),
        "op13_source_divergence": _OP13,
    }
